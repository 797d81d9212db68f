import time

import numpy as np
from hypothesis import given, settings
from hypothesis import strategies as st

from meterlake.llm import toxicity
from meterlake.llm.common import held_out
from meterlake.llm.queries import op8_toxic_segments
from tests.conftest import SMALL
from tests.llm.cases import no_documents, odd_documents


def plain_segments(scores):
    """All maximal scoring segments by their recursive definition: the best one, then those beside it."""

    def search(lo, hi):
        best = None
        for i in range(lo, hi):
            total = 0.0
            for j in range(i, hi):
                total += scores[j]
                key = (total, -(j - i), -i)
                if total > 1e-12 and (best is None or key > best[0]):
                    best = (key, i, j)
        if best is None:
            return []
        _, i, j = best
        return [*search(lo, i), (i, j), *search(j + 1, hi)]

    return search(0, len(scores))


@settings(max_examples=300, deadline=None)
@given(st.lists(st.sampled_from([None, None, None, 1.013, 2.0371, 3.511, 0.2907]), max_size=14))
def test_segments_agree_with_their_definition(tokens):
    penalty = -0.777
    scores = [penalty if t is None else t for t in tokens]
    at = np.array([i for i, t in enumerate(tokens) if t is not None], dtype=int)
    got = toxicity.segments(at, np.array([scores[i] for i in at]), penalty)
    assert [(a, b) for a, b, _ in got] == plain_segments(scores)
    assert all(abs(s - sum(scores[a : b + 1])) < 1e-9 for a, b, s in got)


def test_segments_take_linear_time():
    at = np.arange(0, 400_000, 2)
    for scores in (np.full(200_000, 0.9), np.linspace(0.5, 1.5, 200_000), np.tile([3.0, 0.1, 0.2, 0.1], 50_000)):
        began = time.process_time()
        toxicity.segments(at, scores, -1.0)
        assert time.process_time() - began < 3


def test_held_out_documents(spark):
    got = op8_toxic_segments(spark, SMALL).toPandas().merge(spark.read.parquet(f"{SMALL}/labels.parquet").toPandas(), on="doc_id")
    assert got.score.between(0, 1).all() and (got.predicted == (got.score >= 0.3)).all()
    unseen = got[got.held_out]
    assert unseen[unseen.toxic == 0].predicted.mean() < 0.05
    assert unseen[unseen.toxic == 1].predicted.mean() > 0.5  # 37 toxic rows to learn from in four languages


def test_passages_hold_the_toxic_words(spark):
    rows = [(i, "quiet words about the weather and " * 3 + ("you rotten vile toad " if i % 4 == 0 else "my good old friend ") + "who sat by the door all day") for i in range(400)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    labels = spark.createDataFrame([(i, int(i % 4 == 0)) for i in range(400)], "doc_id long, toxic int")
    model = toxicity.fit(docs, labels, usable=~held_out())
    scored = toxicity.scores(docs, model).collect()
    assert all((r.score >= 0.3) == (r.doc_id % 4 == 0) for r in scored)
    found = toxicity.passages(docs, model).collect()
    assert {r.doc_id for r in found} == {i for i in range(0, 400, 4)}
    texts = dict(rows)
    assert all("rotten vile toad" in r.passage and texts[r.doc_id].encode()[r.start_byte : r.end_byte].decode() == r.passage for r in found)


def test_odd_and_no_tables(spark):
    labels = spark.createDataFrame([(1, 0), (2, 1), (2, 0), (3, None), (None, 1), (14, 1), (15, 1), (99, 1)], "doc_id long, toxic int")
    docs = odd_documents(spark)
    model = toxicity.fit(docs, labels)
    got = toxicity.scores(docs, model).collect()
    assert len(got) == docs.count() and all(0 <= r.score <= 1 for r in got)
    assert len({r.score for r in got if not r.n_tokens}) == 1
    assert toxicity.scores(no_documents(spark), model).count() == 0
    assert toxicity.passages(no_documents(spark), model).count() == 0
    for none in (labels.where("false"), labels.where("toxic = 0")):
        blank = toxicity.fit(docs, none)
        assert len({r.score for r in toxicity.scores(docs, blank).collect()}) == 1


def test_equal_texts_score_alike_wherever_they_stand(spark):
    rows = [(i, "quiet words about the weather and " * 3 + ("you rotten vile toad " if i % 4 == 0 else "my good old friend ") + "who sat by the door all day") for i in range(400)]
    model = toxicity.fit(spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame([(i, int(i % 4 == 0)) for i in range(400)], "doc_id long, toxic int"))
    texts = ["toad"] * 5 + ["", "toad", None, "toad"] + ["toad among the words, toad"] * 5 + ["toad toad"] * 2 + [""]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").coalesce(1)
    evidence = {}
    for r in toxicity.scores(docs, model).collect():
        evidence.setdefault(texts[r.doc_id], []).append(r.evidence)
    assert all(len(set(e)) == 1 and (e[0] > 0) == bool(t) for t, e in evidence.items()), evidence
    assert evidence["toad toad"][0] < evidence["toad"][0]
    assert len({r.segment_score for r in toxicity.passages(docs.where("text = 'toad'"), model).collect()}) == 1
    assert toxicity.passages(docs.where("text = 'toad'"), model).count() == 7
