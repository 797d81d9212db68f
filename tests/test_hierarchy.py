import os
import random

import pytest

from meterlake.operators import conform, hierarchy
from meterlake.plans.reporting import CYPHER, graphml
from meterlake.sources.scratch import shared_folder

COLUMNS = "asset_id string, asset_name string, asset_type string, site_id string, building_id string, parent_asset_id string"
ESTATE = {"C": None, "H1": "C", "H2": "C", "S1": "H1", "P": None, "F": "P", "B": None, "G": "NOWHERE"}


def assets(spark, parents):
    rows = spark.createDataFrame([(k, f"name {k}", "T", "SITE", "BLD", p) for k, p in parents.items()], COLUMNS)
    return conform.conformed_assets(rows)


@pytest.fixture(scope="module")
def estate(spark):
    a = assets(spark, ESTATE)
    pairs = hierarchy.closure(a).cache()
    return a, pairs, hierarchy.hierarchy(a, pairs).cache()


def test_closure(estate):
    _, pairs, _ = estate
    got = {(r.ancestor_id, r.descendant_id): (r.depth, r.path) for r in pairs.collect()}
    assert sum(d == 0 for d, _ in got.values()) == 8
    assert got["C", "S1"] == (2, "C > H1 > S1") and ("P", "C") not in got


def test_hierarchy(estate):
    rows = {r.asset_id: r for r in estate[2].collect()}
    s1 = rows["S1"]
    assert (s1.level, s1.root_asset_id, s1.hierarchy_path, s1.is_leaf) == (2, "C", "C > H1 > S1", True)
    assert (rows["C"].descendant_count, rows["C"].child_count) == (3, 2)
    assert {k for k, r in rows.items() if r.is_orphan} == {"G"} and {k for k, r in rows.items() if r.is_disconnected} == {"B", "G"}
    assert {k: rows[k].connectivity_status for k in ("G", "B", "C")} == {"G": "ORPHANED", "B": "STANDALONE", "C": "CONNECTED"}
    assert not rows["G"].is_root and rows["B"].is_root


def test_questions(estate):
    a, pairs, rows = estate
    assert {(r.relationship, r.asset_id) for r in hierarchy.parent_and_children(rows, pairs, "H1").collect()} == {("parent", "C"), ("child", "S1")}
    assert {(r.asset_id, r.hops) for r in hierarchy.downstream(rows, pairs, "C").collect()} == {("H1", 1), ("H2", 1), ("S1", 2)}
    assert {r.asset_id: r.blast_radius for r in hierarchy.blast_radius(rows, pairs).collect()} == {"C": 3, "H1": 1, "P": 1}
    assert hierarchy.under_site(rows, "SITE").count() == 8 and hierarchy.under_site(rows, "OTHER").count() == 0


def test_cycles_end_and_are_found(spark):
    a = assets(spark, {"A": "B", "B": "A", "C": "B", "D": "D"})
    pairs = hierarchy.closure(a).cache()
    assert {(r.parent, r.child) for r in hierarchy.cycles(a, pairs).collect()} == {("A", "B"), ("B", "A"), ("D", "D")}
    assert pairs.where("ancestor_id = 'A' and descendant_id = 'C'").count() == 1


def test_walks_of_many_ways_stop_at_the_depth_and_leave_one_table(spark):
    """Several parents, cycles and a chain, against walks made one step at a time."""
    rng, folder = random.Random(7), shared_folder(spark)
    ids = [f"N{i:02d}" for i in range(14)]
    links = {(ids[i], ids[i + 1]) for i in range(9)} | {(rng.choice(ids), rng.choice(ids)) for _ in range(9)}
    rows = [(c, f"name {c}", "T", "SITE", "BLD", p) for p, c in sorted(links)] + [(ids[0], "n", "T", "SITE", "BLD", None)]
    known = {r[0] for r in rows}
    for limit in (1, 2, 3, 5, 12):
        expect, level = {(k, k, 0): k for k in known}, [(k,) for k in known]
        for depth in range(1, limit + 1):
            level = [(*w, c) for w in level for p, c in links if p == w[-1] and c not in w]
            for w in level:
                key, path = (w[0], w[-1], depth), " > ".join(w)
                expect[key] = min(path, expect.get(key, path))
        before = set(os.listdir(f"{folder}/meterlake"))
        pairs = hierarchy.closure(spark.createDataFrame(rows, COLUMNS), max_depth=limit)
        assert {(r.ancestor_id, r.descendant_id, r.depth): r.path for r in pairs.collect()} == expect
        assert len(set(os.listdir(f"{folder}/meterlake")) - before) == 1


def test_random_forests_agree_with_a_walk(spark):
    rng = random.Random(3)
    parents = {f"N{i:03d}": None if i < 4 or rng.random() < 0.05 else f"N{rng.randrange(max(0, i - 12), i):03d}" for i in range(120)}
    expect = set()
    for k in parents:
        at, depth = k, 0
        while at is not None and depth <= 30:
            expect.add((at, k, depth))
            at, depth = parents[at], depth + 1
    a = assets(spark, parents)
    pairs = hierarchy.closure(a, max_depth=40)
    assert {(r.ancestor_id, r.descendant_id, r.depth) for r in pairs.collect()} == expect
    assert {(r.ancestor_id, r.descendant_id, r.depth) for r in hierarchy.closure_recursive(spark, a, 40).collect()} == expect


def test_topology(spark, estate):
    a, pairs, _ = estate
    sites = spark.createDataFrame([("SITE",)], "site_id string")
    buildings = spark.createDataFrame([("BLD", "SITE"), ("ALONE", "SITE2")], "building_id string, site_id string")
    nodes, edges = hierarchy.graph(a, buildings.where("building_id = 'BLD'"), sites)
    report = hierarchy.topology_report(nodes, edges, pairs, a).first()
    assert (report.nodes, report.edges, report.components, report.largest_component, report.is_forest, report.cycle_edges, report.isolated) == (10, 9, 1, 10, True, 0, 0)
    text = graphml([r.asDict() for r in nodes.collect()], [r.asDict() for r in edges.collect()])
    assert text.count("<node ") == 10 and text.count("<edge ") == 9 and all(q.rstrip().endswith(";") for q in CYPHER.values())
