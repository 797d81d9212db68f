"""Reports of bounded size, rendered on the driver: quality as JSON and HTML, queries as CSV and Markdown, graphs as GraphML and Cypher."""

from __future__ import annotations

import csv
import json
from collections.abc import Iterable, Mapping
from html import escape
from pathlib import Path
from xml.sax.saxutils import quoteattr

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Rows that a report lists of stale or incomplete assets, at most.
LISTED = 25
#: Rows that an export brings to the driver, at most; larger results are refused, not cut.
EXPORTED = 100_000


def _small(frame: DataFrame, most: int) -> list:
    rows = frame.limit(most + 1).collect()
    if len(rows) > most:
        raise ValueError(f"more than {most} rows: write them with Spark")
    return rows


def of_batch(results: DataFrame, batch_id: str | None = None) -> DataFrame:
    """A batch's rule results; those of the latest batch, if it has none or none is named."""
    own = results.where(F.col("batch_id") == batch_id)
    if batch_id is not None and not own.isEmpty():
        return own
    latest = results.agg(F.max_by("batch_id", F.struct("evaluated_at", "batch_id"))).first()[0]
    return results.where(F.col("batch_id") == latest)


def quality_metrics(results: DataFrame, freshness: DataFrame | None = None, completeness: DataFrame | None = None, batch_id: str = "latest", quarantined: Mapping[str, Mapping[str, int]] | None = None) -> dict:
    """What a quality report says: rules, dimensions, breaches, the stalest and least complete assets, and a verdict."""
    rules = [r.asDict() for r in results.orderBy("rule_id").collect()]
    dimensions: dict[str, dict[str, int]] = {}
    by_table: dict[str, dict[str, int]] = {}
    for r in rules:
        for group, key in ((dimensions, r["dimension"]), (by_table, r.get("table_name") or "all")):
            d = group.setdefault(key, {"rules": 0, "failed": 0, "breached": 0})
            d["rules"] += 1
            d["failed"] += r["failed"]
            d["breached"] += not r["passed"]
    breached = [r for r in rules if not r["passed"]]
    verdict = "FAIL" if any(r["severity"] == "BLOCKING" for r in breached) else "WARN" if breached else "PASS"
    top = lambda df, order: [r.asDict() for r in df.orderBy(*order).limit(LISTED).collect()] if df is not None else []
    return {
        "batch_id": batch_id,
        "verdict": verdict,
        "evaluated": max((r["evaluated"] for r in rules), default=0),
        "rules": rules,
        "by_dimension": dimensions,
        "by_table": by_table,
        "quarantined": {n: dict(reasons) for n, reasons in (quarantined or {}).items()},
        "stale": top(freshness.where("is_stale") if freshness is not None else None, (F.desc("lag_minutes"), "asset_id")),
        "incomplete": top(completeness.where("missing > 0") if completeness is not None else None, ("completeness_pct", "asset_id", "event_date")),
    }


def _html_table(rows: list[dict]) -> str:
    if not rows:
        return "<p>none</p>"
    head = "".join(f"<th>{escape(str(k))}</th>" for k in rows[0])
    body = "".join("<tr>" + "".join(f"<td>{escape(str(v))}</td>" for v in r.values()) + "</tr>" for r in rows)
    return f"<table><tr>{head}</tr>{body}</table>"


def write_quality_report(metrics: dict, folder: str) -> list[str]:
    """Write a batch's report as JSON and HTML, and as the latest of both; returns the paths."""
    out, made = Path(folder), []
    out.mkdir(parents=True, exist_ok=True)
    dimensions = [{"dimension": k, **v} for k, v in metrics["by_dimension"].items()]
    page = f"<!doctype html><meta charset=utf-8><title>Quality {escape(metrics['batch_id'])}</title><h1>{metrics['verdict']}</h1><p>{metrics['evaluated']} records</p>"
    page += "".join(f"<h2>{title}</h2>{_html_table(rows)}" for title, rows in (("Dimensions", dimensions), ("Rules", metrics["rules"]), ("Stale", metrics["stale"]), ("Incomplete", metrics["incomplete"])))
    for stem in (f"quality_{metrics['batch_id']}", "quality_latest"):
        for suffix, text in ((".json", json.dumps(metrics, indent=1, default=str)), (".html", page)):
            path = out / f"{stem}{suffix}"
            path.write_text(text, encoding="utf-8")
            made.append(str(path))
    return made


def export_queries(frames: Mapping[str, DataFrame], folder: str, shown: int = 20, most: int = EXPORTED) -> dict[str, str]:
    """Write each result as CSV and all as one Markdown digest; a query that fails, or gives over ``most`` rows, is noted and the others go on."""
    out, digest, state = Path(folder), [], {}
    out.mkdir(parents=True, exist_ok=True)
    for name, frame in frames.items():
        try:
            rows, columns = _small(frame, most), frame.columns
        except Exception as problem:  # noqa: BLE001 - recorded, not raised
            state[name] = f"failed: {type(problem).__name__}"
            digest.append(f"## {name}\n\n{state[name]}\n")
            continue
        with (out / f"{name}.csv").open("w", newline="", encoding="utf-8") as file:
            writer = csv.writer(file)
            writer.writerow(columns)
            writer.writerows(rows)
        state[name] = f"{len(rows)} rows"
        table = [" | ".join(columns), " | ".join("---" for _ in columns), *(" | ".join("" if v is None else str(v) for v in r) for r in rows[:shown])]
        digest.append(f"## {name}\n\n{state[name]}\n\n" + "\n".join(f"| {line} |" for line in table) + "\n")
    (out / "results.md").write_text("\n".join(digest), encoding="utf-8")
    return state


def graphml(nodes: Iterable[Mapping], edges: Iterable[Mapping]) -> str:
    """A GraphML text; null attributes are empty, others are written as text."""
    show = lambda v: quoteattr("" if v is None else str(v))
    lines = ['<?xml version="1.0" encoding="UTF-8"?>', '<graphml xmlns="http://graphml.graphdrawing.org/xmlns"><graph edgedefault="directed">']
    lines += [f"<node id={show(n['node_id'])}><data key=\"type\">{escape(str(n['node_type']))}</data></node>" for n in nodes]
    lines += [f"<edge source={show(e['source_id'])} target={show(e['target_id'])}><data key=\"type\">{escape(str(e['edge_type']))}</data></edge>" for e in edges]
    return "\n".join([*lines, "</graph></graphml>"])


CYPHER = {
    "constraint": "CREATE CONSTRAINT node_id IF NOT EXISTS FOR (n:Node) REQUIRE n.id IS UNIQUE;",
    "load_nodes": "LOAD CSV WITH HEADERS FROM $nodes AS row MERGE (n:Node {id: row.node_id}) SET n.kind = row.node_type;",
    "load_edges": "LOAD CSV WITH HEADERS FROM $edges AS row MATCH (a:Node {id: row.source_id}), (b:Node {id: row.target_id}) MERGE (a)-[:LINK {kind: row.edge_type}]->(b);",
    "under_site": "MATCH (:Node {id: $site})-[:LINK*]->(n {kind: 'Asset'}) RETURN DISTINCT n.id;",
    "parent_and_children": "MATCH (n:Node {id: $asset}) OPTIONAL MATCH (p)-[:LINK]->(n) OPTIONAL MATCH (n)-[:LINK]->(c) RETURN p.id, collect(c.id);",
    "downstream": "MATCH path = (:Node {id: $asset})-[:LINK {kind: 'FEEDS'}*]->(n) RETURN n.id, min(length(path)) AS hops;",
    "disconnected": "MATCH (n:Node) WHERE NOT (n)--() RETURN n.id;",
    "critical": "MATCH (n:Node)-[:LINK {kind: 'FEEDS'}*]->(m) RETURN n.id, count(DISTINCT m) AS blast_radius ORDER BY blast_radius DESC LIMIT 10;",
    "subtree": "MATCH (n:Node {id: $asset})-[:LINK*0..]->(m) RETURN collect(DISTINCT m.id);",
}


def export_graph(nodes: DataFrame, edges: DataFrame, folder: str, most: int = EXPORTED) -> None:
    """GraphML and Cypher of a topology; raises if it has over ``most`` nodes or edges, as drawing tools need it whole."""
    out = Path(folder)
    out.mkdir(parents=True, exist_ok=True)
    (out / "topology.graphml").write_text(graphml((r.asDict() for r in _small(nodes.orderBy("node_id"), most)), (r.asDict() for r in _small(edges.orderBy("source_id", "target_id"), most))), encoding="utf-8")
    (out / "topology.cypher").write_text("\n".join(CYPHER.values()), encoding="utf-8")
