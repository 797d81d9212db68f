import random

import numpy as np
import pytest

from meterlake.llm import jaccard
from tests.conftest import TINY
from tests.llm.cases import no_documents, odd_documents, odd_rows
from tests.llm.test_text import plain_words


def brute(rows, width, percent):
    """Components by comparing all pairs: (doc_id, size, component) of each row."""
    sets = []
    for _, text in rows:
        w = plain_words(text)
        sets.append({tuple(w[i : i + width]) for i in range(len(w) - width + 1)} if len(w) >= width else {tuple(w)} if w else set())
    group = list(range(len(rows)))

    def find(i):
        while group[i] != i:
            i = group[i]
        return i

    for i in range(len(rows)):
        for j in range(i):
            a, b = sets[i], sets[j]
            if a and b and rows[i][0] is not None and rows[j][0] is not None and 100 * len(a & b) >= percent * len(a | b):
                group[find(i)] = find(j)
    names = {}
    for i, (doc, _) in enumerate(rows):
        if doc is not None:
            names[find(i)] = min(doc, names.get(find(i), doc))
    return sorted(((doc, len(s), None if doc is None else names[find(i)]) for i, ((doc, _), s) in enumerate(zip(rows, sets, strict=True))), key=str)


def found(frame):
    return sorted(((r.doc_id, r.n_shingles, r.component_id) for r in frame.collect()), key=str)


@pytest.mark.parametrize(("width", "percent"), [(3, 90), (5, 80)])
def test_documents_agree_with_all_pairs(spark, width, percent):
    docs = spark.read.parquet(f"{TINY}/documents.parquet")
    rows = [(r.doc_id, r.text) for r in docs.select("doc_id", "text").collect()]
    assert found(jaccard.jaccard_groups(docs, width, percent)) == brute(rows, width, percent)


def test_chains_of_edits_agree_with_all_pairs(spark):
    """Near copies of which neighbours alone are linked, and a shared passage that links nothing."""
    rng = random.Random(5)
    rows, passage = [], [f"p{i}" for i in range(40)]
    for g in range(6):
        text = [f"g{g}w{rng.randrange(500)}" for _ in range(rng.randrange(5, 150))]
        for _ in range(8):
            rows.append((len(rows) + 1, " ".join(text)))
            for _ in range(rng.choice([0, 1, 1, 2])):
                text[rng.randrange(len(text))] = f"e{rng.randrange(10**6)}"
    rows += [(len(rows) + 1 + k, " ".join(passage + [f"q{rng.randrange(10**6)}" for _ in range(20)])) for k in range(8)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
    assert found(jaccard.jaccard_groups(docs, 3, 90)) == brute(rows, 3, 90)


def test_odd_and_no_documents(spark):
    rows = [(r[0], r[1]) for r in odd_rows()]
    assert found(jaccard.jaccard_groups(odd_documents(spark), 3, 90)) == brute(rows, 3, 90)
    assert jaccard.jaccard_groups(no_documents(spark)).count() == 0


def test_linked_sets_share_a_signature():
    rng = np.random.default_rng(2)
    for percent in (80, 90):
        bands = jaccard.Bands(percent)
        for _ in range(400):
            size = int(rng.integers(1, 400))
            a = np.unique(rng.integers(0, 1 << 62, size).astype(np.uint64))
            gone = int(rng.integers(0, len(a) * (100 - percent) // 100 + 1))
            most = int((100 * (len(a) - gone) - percent * len(a)) // percent)  # elements that may be new
            new = int(rng.integers(0, most + 1)) if most > 0 else 0
            b = np.unique(np.concatenate([rng.permutation(a)[gone:], rng.integers(0, 1 << 62, new).astype(np.uint64)]))
            common = len(np.intersect1d(a, b))
            if len(b) and 100 * common >= percent * (len(a) + len(b) - common):
                assert set(bands.signatures(a)) & set(bands.signatures(b))


@pytest.mark.parametrize(("percent", "size"), [(80, 9), (80, 23), (80, 400), (80, 3400), (80, 4700), (90, 400)])
def test_strangers_share_no_signature(percent, size):
    """Sets that are small for a band have many parts with empty subsets; these must not make them meet."""
    rng = np.random.default_rng(3)
    bands = jaccard.Bands(percent)
    signs = [np.unique(bands.signatures(np.unique(rng.integers(0, 1 << 64, size, dtype=np.uint64)))) for _ in range(100)]
    assert len(np.unique(np.concatenate(signs))) == sum(map(len, signs))


@pytest.mark.parametrize("share", [0.02, 0.2, 0.7])
def test_linked_sets_share_a_signature_whatever_is_heavy(share):
    """With any bitmap of heavy signatures, and none but those that they have without one."""
    rng = np.random.default_rng(4)
    heavy = np.packbits(rng.random(1 << 16) < share).view(np.uint64)
    levels = set()
    for percent in (80, 90):
        bands = jaccard.Bands(percent)
        for _ in range(300):
            size = int(np.exp(rng.uniform(0, np.log(3000))))
            a = np.unique(rng.integers(0, 1 << 64, size, dtype=np.uint64))
            gone = int(rng.integers(0, len(a) * (100 - percent) // 100 + 1))
            b = np.sort(rng.permutation(a)[gone:])
            x, y = set(bands.signatures(a, heavy)), set(bands.signatures(b, heavy))
            assert x & y and x <= set(bands.signatures(a)) and y <= set(bands.signatures(b))
        levels |= {level for _, level in bands._parts}
    assert levels == {0, 1, 2}


def test_representatives_keep_one_of_each_group(spark):
    docs = odd_documents(spark)
    kept = jaccard.representatives(docs, 3, 90)
    assert kept.columns == docs.columns
    ids = sorted(r.doc_id for r in kept.collect() if r.doc_id is not None)
    assert ids == sorted({c for d, _, c in brute([(r[0], r[1]) for r in odd_rows()], 3, 90) if d is not None})
    assert kept.where("doc_id is null").count() == 2
    assert jaccard.representatives(no_documents(spark)).count() == 0


def test_texts_that_share_an_id_stand_for_their_own_groups(spark):
    rng = random.Random(9)
    a, b, c = (" ".join(f"{k}{rng.randrange(10**6)}" for _ in range(100)) for k in "abc")
    near = lambda text, word: " ".join(text.split()[:-1] + [word])
    rows = [(1, a), (5, near(a, "x")), (5, b), (7, near(b, "y")), (7, c), (7, c), (7, ""), (8, near(a, "z")), (8, near(b, "z")), (None, a)]
    kept = jaccard.representatives(spark.createDataFrame(rows, "doc_id long, text string").repartition(3), 5, 80)
    assert sorted(map(tuple, kept.collect()), key=str) == sorted([(1, a), (5, b), (7, c), (7, ""), (None, a)], key=str)
