import random

from meterlake.llm import containment
from tests.conftest import SMALL
from tests.llm.cases import no_documents, odd_documents
from tests.llm.test_text import plain_words


def shingles(text, width):
    w = plain_words(text)
    return {tuple(w[i : i + width]) for i in range(len(w) - width + 1)}


def brute(docs, items, width=5, threshold=0.8):
    out = []
    for item, text in items:
        n = min(len(plain_words(text)), width)
        want = shingles(text, n) if n else set()
        for doc, body in docs:
            common = len(want & shingles(body, n)) if n else 0
            if want and common >= threshold * len(want) - 1e-12:
                out.append((doc, item, len(want), common))
    return sorted(out, key=str)


def found(frame):
    return sorted(((r.doc_id, r.item_id, r.n_shingles, r.n_common) for r in frame.collect()), key=str)


def test_documents_agree_with_all_pairs(spark):
    docs, bench = (spark.read.parquet(f"{SMALL}/{t}.parquet") for t in ("documents", "benchmark"))
    pairs = brute([(r.doc_id, r.text) for r in docs.collect()], [(r.item_id, r.text) for r in bench.collect()])
    assert pairs and found(containment.contained_items(docs, bench)) == pairs
    left = {r.doc_id for r in containment.without_leaks(docs, bench).collect()}
    assert left == {r.doc_id for r in docs.collect()} - {p[0] for p in pairs}


def test_partial_and_short_items_in_blocks(spark, monkeypatch):
    rng = random.Random(3)
    word = lambda: f"w{rng.randrange(60)}"
    docs = [(i, " ".join(word() for _ in range(rng.randrange(0, 300)))) for i in range(40)]
    items = [(1, "w1 w2"), (2, "w3"), (3, ""), (4, None)]
    for k in range(40):
        text = rng.choice(docs)[1].split()
        if len(text) > 60:
            start = rng.randrange(len(text) - 50)
            piece = text[start : start + rng.randrange(3, 50)]
            for _ in range(rng.randrange(3)):
                piece[rng.randrange(len(piece))] = "new"
            items.append((10 + k, " ".join(piece)))
    monkeypatch.setattr(containment, "BLOCK_BYTES", 500)
    frame = containment.contained_items(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string"))
    assert found(frame) == brute(docs, items)


def test_odd_and_no_tables(spark):
    items = spark.createDataFrame([(1, "one two"), (None, "one"), (2, None), (3, "one two")], "item_id long, text string")
    pairs = found(containment.contained_items(odd_documents(spark), items))
    assert {p[:2] for p in pairs} == {(8, 1), (9, 1), (8, 3), (9, 3), (7, None), (8, None), (9, None)}
    none = items.where("false")
    assert containment.contained_items(odd_documents(spark), none).count() == 0
    assert containment.contained_items(no_documents(spark), items).count() == 0
    docs = odd_documents(spark)
    kept = containment.without_leaks(docs, items)
    assert kept.columns == docs.columns and kept.count() == docs.count() - 3
    assert containment.without_leaks(docs, none).count() == docs.count()
