import datetime as dt
import random

from pyspark.sql import functions as F

from meterlake.llm import urls
from meterlake.llm.queries import op6_url_temporal_lists
from tests.conftest import TINY


def brute(captures, entries):
    """Lists of each capture: the last entry of a pattern on or before the day decides; of a day's, a removal."""
    out = []
    for page, url, day in captures:
        host = (url or "").lower().split("//", 1)[-1].split("/")[0].split("?")[0].split("#")[0].split("@")[-1].split(":")[0].rstrip(".") if url and "//" in url else ""
        path = "/" + "/".join(s for s in (url or "").split("?")[0].split("#")[0].split("//", 1)[-1].lower().split("/")[1:] if s)
        on = set()
        for name, kind, pattern in {e[:3] for e in entries}:
            log = sorted((e[3], e[4]) for e in entries if e[:3] == (name, kind, pattern) and day and e[3] <= day)
            if not log or log[-1][1] != "add":
                continue
            hit = {"host": host == pattern, "domain": host == pattern or host.endswith("." + pattern), "prefix": (host + path + "/").startswith(pattern + "/")}[kind]
            if host and hit:
                on.add(name)
        out.append((page, ",".join(sorted(on)), bool(on) and "allowed" not in on))
    return sorted(out, key=str)


def test_captures_agree_with_a_walk_over_the_log(spark):
    rng = random.Random(4)
    day = lambda: str(dt.date(2024, 1, 1) + dt.timedelta(days=rng.randrange(60)))
    hosts = ["a.com", "b.a.com", "c.b.a.com", "x.org", "y.x.org", "z.net"]
    patterns = [(k, p) for k in ("domain", "host") for p in hosts] + [("prefix", f"{h}/{p}") for h in hosts for p in ("de", "de/1", "en")]
    entries = [(rng.choice(["spam", "adult", "allowed"]), *rng.choice(patterns), day(), rng.choice(["add", "add", "remove"])) for _ in range(250)]
    forms = ["http://{h}{p}", "HTTPS://user@{h}:8080{p}?q=/x", "https://{h}.{p}#f"]
    captures = [(i, rng.choice(forms).format(h=rng.choice(hosts), p=rng.choice(["", "/", "/de", "/de/1/2", "/en/x.html", "/DE//1", "/dex"])), day()) for i in range(400)]
    frame = urls.evaluated(spark.createDataFrame(captures, "page_id long, url string, fetched_on string"), spark.createDataFrame(entries, urls.ENTRY))
    assert sorted(((r.page_id, r.lists, r.blocked) for r in frame.collect()), key=str) == brute(captures, entries)


def test_a_large_list_is_not_broadcast(spark, monkeypatch):
    entries = spark.createDataFrame([("spam", "host", f"h{i}.com", "2024-01-01", "add") for i in range(50)], urls.ENTRY)
    captures = spark.createDataFrame([(i, f"http://h{i}.com/", "2024-02-01") for i in range(80)], "page_id long, url string, fetched_on string")
    monkeypatch.setattr(urls, "BROADCAST_INTERVALS", 10)
    assert urls.evaluated(captures, entries).where("blocked").count() == 50


def test_odd_and_no_captures(spark):
    rows = [(1, None, "2024-02-01"), (2, "", "2024-02-01"), (3, "no url", "2024-02-01"), (None, "http://a.com", "2024-02-01"), (4, "http://a.com", None), (5, "http://a.com", "2024-02-01"), (5, "http://a.com", "2024-02-01"), (6, "http://" + "b." * 20_000 + "a.com/" + "c/" * 20_000, "2024-02-01")]
    captures = spark.createDataFrame([(*r, "l", "k") for r in rows], "page_id long, url string, fetched_on string, lists string, key string")
    entries = spark.createDataFrame([("spam", "domain", "a.com", "2024-01-01", "add"), ("spam", "domain", "a.com", "2024-01-01", "add"), (None, "host", "x", "2024-01-01", "add"), ("spam", "host", None, "2024-01-01", "add"), ("spam", "host", "x", "never", "add"), ("spam", "nonsense", "x", "2024-01-01", "add")], urls.ENTRY)
    got = urls.evaluated(captures, entries).collect()
    assert sorted(str(r.page_id) for r in got if r.blocked) == ["5", "5", "6", "None"] and len(got) == len(rows)
    assert urls.evaluated(captures, entries.where("false")).where("blocked").count() == 0
    assert urls.evaluated(captures.where("false"), entries).count() == 0


def test_the_query_runs_no_python(spark):
    plan = op6_url_temporal_lists(spark, TINY)._jdf.queryExecution().executedPlan().toString()
    assert not any(w in plan for w in ("Python", "Pandas", "Arrow"))
    assert op6_url_temporal_lists(spark, TINY).where(F.col("n_lists") > 0).count() > 0
