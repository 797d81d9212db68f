import json

import pytest
from pyspark.sql import functions as F

from meterlake.config import Settings
from meterlake.plans import reporting
from meterlake.plans.lake import Lake, Run
from meterlake.schemas import TELEMETRY_RAW
from meterlake.sources import landing, tables
from meterlake.sources.datagen import Generator, Plan
from meterlake.streaming import pipeline


@pytest.fixture(scope="module")
def landed(spark, tmp_path_factory):
    path = str(tmp_path_factory.mktemp("landing"))
    generator = Generator(spark, Plan(sites=2, buildings_per_site=1, days=3, interval_seconds=1800, rates={"missing": 0.02, "duplicate": 0.02, "bad_time": 0.01, "outlier": 0.01, "unknown_asset": 0.01, "late": 0.02, "corrupt": 0.01}))
    return path, generator, generator.land(path)


def test_generator_is_repeatable(landed):
    path, generator, manifest = landed
    assert generator.land(path) == manifest and all(manifest[k] > 0 for k in ("clean", "missing", "bad_time", "outlier", "unknown_asset", "late", "corrupt", "duplicate"))


def test_batch_finds_what_was_planted(spark, landed, tmp_path):
    path, _, manifest = landed
    lake = Lake(spark, Settings(root=str(tmp_path / "lake"), sampling_seconds=1800), path, as_of="2026-06-10T00:00:00Z")
    run = lake.run()
    failed = {r.rule_id: r.failed for r in lake.read("quality", "dq_results").where("table_name = 'telemetry'").collect()}
    assert lake.read("quarantine", "telemetry_dlq").count() == manifest["corrupt"]
    # records with one bad time share a key, and a copy of a corrupt record stands alone
    assert -manifest["corrupt"] <= failed["tel.uniqueness.business_key"] - manifest["duplicate"] <= manifest["bad_time"]
    assert failed["tel.consistency.asset_registered"] == manifest["unknown_asset"]
    assert failed["tel.completeness.temperature_present"] == manifest["missing"]
    assert failed["tel.accuracy.temperature_in_range"] == manifest["outlier"]
    assert failed["tel.validity.timestamp_parseable"] + failed["tel.validity.timestamp_plausible"] >= manifest["bad_time"]
    clean, bad = lake.read("silver", "telemetry").count(), lake.read("quarantine", "telemetry").count()
    assert clean + bad + manifest["corrupt"] == sum(manifest.values())
    assert run.metrics["quality"]["verdict"] in ("PASS", "WARN") and set(run.seconds) == {"bronze", "silver", "gold", "hierarchy", "report"}
    first = lake.read("gold", "agg_site_daily").orderBy("site_id", "event_date").collect()
    versions = lake.read("gold", "dim_asset/v0").count()
    again = lake.run()
    assert lake.read("gold", "agg_site_daily").orderBy("site_id", "event_date").collect() == first
    assert tables.read_version(spark, lake.s.table("gold", "dim_asset")).count() == versions
    assert lake.restate(Run()) == sorted({str(r.event_date) for r in lake.read("silver", "telemetry").where("_is_late").collect()})
    made = reporting.write_quality_report(run.metrics["quality"], str(tmp_path / "report"))
    assert len(made) == 4 and json.loads(open(made[0]).read())["batch_id"] == run.batch_id


    # a batch's rule results stay, and one that has none reads the latest
    history = lake.read("quality", "dq_results")
    assert {r.batch_id for r in history.select("batch_id").distinct().collect()} == {run.batch_id, again.batch_id}
    assert reporting.of_batch(history, run.batch_id).where(f"batch_id = '{run.batch_id}'").count() == reporting.of_batch(history, "none").where(f"batch_id = '{again.batch_id}'").count() > 0
    report = run.metrics["quality"]
    assert set(report["by_table"]) == {"telemetry", "events"} and report["quarantined"]["telemetry"]["tel.consistency.asset_registered"] == manifest["unknown_asset"]


GOLD = "fact_telemetry fact_event readings fact_energy_hourly curated_hourly_energy curated_daily_utilization curated_daily_environment agg_asset_daily agg_building_daily agg_site_daily curated_fault_statistics dim_date".split()


def contents(lake, layer, names, drop=()):
    """Tables as sorted rows, numbers to 9 digits."""
    tidy = lambda v: float(f"{v:.9g}") if isinstance(v, float) else v
    found = {}
    for n in names:
        rows = lake.read(layer, n).drop(*drop)
        found[n] = sorted((tuple(tidy(r[c]) for c in sorted(rows.columns)) for r in rows.collect()), key=str)
    return found


def test_batches_by_date_give_what_one_batch_gives(spark, landed, tmp_path):
    path, _, _ = landed
    made = lambda name: Lake(spark, Settings(root=str(tmp_path / name), sampling_seconds=1800, fail_on_breach=False), path, as_of="2026-06-10T00:00:00Z")
    whole, parts = made("whole"), made("parts")
    whole.run(("bronze", "silver", "gold"))
    days = [str(r.ingest_date) for r in whole.read("bronze", "telemetry").select("ingest_date").distinct().orderBy("ingest_date").collect()]
    assert len(days) > 3
    for some in (days[:2], days[2:-1], days[-1:]):
        parts.run(("bronze", "silver"), some)
        if some == days[2:-1]:
            parts.run(("gold",))  # before the last date lands
    audit = ("_ingested_at", "_batch_id", "_batch")
    assert contents(parts, "silver", ("telemetry", "events"), audit) == contents(whole, "silver", ("telemetry", "events"), audit)
    assert whole.read("quarantine", "telemetry").count() == parts.read("quarantine", "telemetry").count()
    assert whole.read("quarantine", "telemetry_dlq").count() == parts.read("quarantine", "telemetry_dlq").count()
    # the last landing date holds late records alone: gold is mended by its dates
    parts.restate(Run())
    assert contents(parts, "gold", GOLD, audit) == contents(whole, "gold", GOLD, audit)


def test_maintenance_of_a_lake(spark, landed, tmp_path):
    import time

    path, _, _ = landed
    lake = Lake(spark, Settings(root=str(tmp_path / "lake"), sampling_seconds=1800, compact_files=2, fail_on_breach=False), path, as_of="2026-06-10T00:00:00Z")
    first = lake.run(("bronze", "silver", "gold"))
    lake.run(("gold",))
    before = contents(lake, "gold", GOLD) | contents(lake, "silver", ("telemetry",))
    done = lake.maintain()
    assert list(done.seconds) == ["late", "compact", "vacuum", "prune"] and done.metrics["late"] and done.metrics["vacuumed"] == done.metrics["pruned"] == []
    assert contents(lake, "gold", GOLD) | contents(lake, "silver", ("telemetry",)) == before
    later = lake.maintain(time.time() + 40 * 86_400)
    assert later.metrics["vacuumed"] == [0] and first.batch_id in later.metrics["pruned"]


def test_stream_agrees_with_the_batch(spark, landed, tmp_path):
    path, generator, manifest = landed
    lines = landing.stream_lines(spark, f"{path}/telemetry/*", files_per_trigger=10_000)
    got = pipeline.run(spark, lines, TELEMETRY_RAW, str(tmp_path / "out"), register=generator.assets().withColumn("asset_id", F.upper("asset_id")), as_of="2026-06-10T00:00:00Z")
    assert got["dlq"].count() == manifest["corrupt"]
    total = got["clean"].count() + got["quarantine"].count() + manifest["corrupt"] + manifest["duplicate"]
    assert total == sum(manifest.values())
    assert got["rollup"].count() > 0 and got["rollup"].agg(F.sum("readings")).first()[0] <= got["clean"].count()


def test_late_stream_records_are_dropped_behind_the_watermark(spark, tmp_path):
    folder = tmp_path / "in"
    folder.mkdir()
    record = lambda i, t: json.dumps({"timestamp": t, "site_id": "S", "building_id": "B", "asset_id": "A", "sensor_id": str(i), "temperature": "20", "humidity": "40", "pressure": "300", "vibration": "1", "power_consumption": "5", "operating_mode": "RUNNING"})
    for n, t in enumerate(["2026-06-01T12:00:00Z", "2026-06-01T12:05:00Z", "2026-06-01T06:00:00Z"]):
        (folder / f"{n}.json").write_text(record(n, t) + "\n")
        import os

        os.utime(folder / f"{n}.json", (1_700_000_000 + n, 1_700_000_000 + n))
    out = pipeline.run(spark, landing.stream_lines(spark, str(folder), files_per_trigger=1), TELEMETRY_RAW, str(tmp_path / "out"), sinks=("clean",), as_of="2026-06-10T00:00:00Z")
    assert out["clean"].count() == 2


def test_upserts(spark, tmp_path):
    path = str(tmp_path / "t")
    frame = lambda *rows: spark.createDataFrame(list(rows), "k string, v int, d string")
    tables.upsert(spark, frame(("a", 1, "x"), ("b", 2, "x"), (None, 3, "y"), ("m", 4, "y"), ("z", 9, "q")), path, ["k"], ["d"])
    change = frame(("a", 10, "x"), (None, 30, "y"), ("n", 5, "y"), ("m", 40, "x"), ("n", 4, "y"), ("z", 9, "x"))
    for _ in range(2):  # a second time changes nothing
        tables.upsert(spark, change, path, ["k"], ["d"])
        got = sorted(((r.k, r.v, r.d) for r in tables.read(spark, path).collect()), key=str)
        assert got == sorted([("a", 10, "x"), ("b", 2, "x"), (None, 30, "y"), ("m", 40, "x"), ("n", 5, "y"), ("z", 9, "x")], key=str)


@pytest.mark.parametrize("home", [None, "a:b", "x=y/z%20 w"])
def test_a_key_leaves_any_partition(spark, tmp_path, home):
    path = str(tmp_path / "t")
    frame = lambda *rows: spark.createDataFrame(list(rows), "k string, v int, d string")
    tables.upsert(spark, frame(("z", 1, home), ("a", 2, "q")), path, ["k"], ["d"])
    tables.upsert(spark, frame(("z", 3, "x")), path, ["k"], ["d"])
    assert sorted(tuple(r) for r in tables.read(spark, path).select("k", "v", "d").collect()) == [("a", 2, "q"), ("z", 3, "x")]


def test_maintenance(spark, tmp_path):
    path = str(tmp_path / "t")
    assert not tables.exists(spark, path)
    tables.write(spark.range(100).withColumn("d", F.col("id") % 3), path, partition_by=["d"])
    assert tables.exists(spark, path) and tables.prune(spark, path, "d", "1") == ["0"]
    assert tables.read(spark, path).count() == 66
    flat = str(tmp_path / "flat")
    tables.write(spark.range(1000).repartition(8), flat)
    tables.compact(spark, flat, ["id"], 2)
    assert tables.read(spark, flat).count() == 1000 and len(list((tmp_path / "flat").glob("*.parquet"))) == 2
    root = str(tmp_path / "v")
    for n in (1, 2, 3):
        tables.write_version(spark.range(n), root)
    assert tables.read_version(spark, root, 1).count() == 2 and tables.vacuum_versions(spark, root) == [0, 1]
    with pytest.raises(ValueError):
        tables.read_version(spark, root, 0)
    assert tables.resolved_format(spark, "delta") == "parquet"
    tables.drop(spark, root)
    assert not tables.exists(spark, root)


def test_settings_and_exports(spark, tmp_path):
    s = Settings().with_environment(environ={"METERLAKE__LATE_SECONDS": "60", "METERLAKE__ROOT": "s3://x", "OTHER": "1"})
    assert (s.late_seconds, s.root, s.table("gold", "t")) == (60, "s3://x", "s3://x/gold/t")
    bad = spark.range(1).select(F.raise_error(F.lit("no")).alias("x"))
    state = reporting.export_queries({"q": spark.range(3).toDF("n"), "bad": bad, "large": spark.range(9).toDF("n")}, str(tmp_path), most=5)
    assert state["q"] == "3 rows" and state["bad"].startswith("failed: ") and state["large"] == "failed: ValueError"
    assert (tmp_path / "q.csv").read_text().split() == ["n", "0", "1", "2"] and not (tmp_path / "bad.csv").exists() and not (tmp_path / "large.csv").exists()
    nodes = spark.createDataFrame([("a", "Site"), ("b&", None)], "node_id string, node_type string")
    edges = spark.createDataFrame([("a", "b&", "CONTAINS")], "source_id string, target_id string, edge_type string")
    reporting.export_graph(nodes, edges, str(tmp_path))
    drawn = (tmp_path / "topology.graphml").read_text()
    assert drawn.count("<node ") == 2 and drawn.count("<edge ") == 1 and "b&amp;" in drawn and "CREATE CONSTRAINT" in (tmp_path / "topology.cypher").read_text()
    with pytest.raises(ValueError):
        reporting.export_graph(nodes, edges, str(tmp_path), most=1)
    rows = spark.createDataFrame([("S1", 1), ("S2", 2)], "site_id string, v int")
    assert landing.visible_to(rows, ["S2"]).count() == 1 and landing.visible_to(rows, None).count() == 2
