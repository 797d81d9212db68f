import numpy as np
import pyarrow as pa
import regex
from hypothesis import given, settings
from hypothesis import strategies as st

from meterlake.llm.text import HashArray, slices, whole_hash, words_of

TEXTS = st.lists(st.one_of(st.none(), st.text(alphabet=" \t\nabABé你,.", max_size=40)), max_size=12)


def plain_words(text):
    lowered = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
    return regex.findall(r"[^\x20\x09-\x0D]+", lowered)


@settings(max_examples=150, deadline=None)
@given(TEXTS)
def test_words_and_shingles_agree_with_a_plain_version(texts):
    by_words, by_shingles = {}, {}
    for row, end, w in words_of(pa.array(texts, pa.string())):
        hashes, bounds = w.shingles(3)
        for i in range(len(w)):
            expect = plain_words(texts[row + i])
            got = [bytes(w.data[w.start[k] : w.end[k]]).decode() for k in range(w.bounds[i], w.bounds[i + 1])]
            assert [plain_words(g)[0] for g in got] == expect
            for word, h in zip(expect, w.hashes[w.bounds[i] : w.bounds[i + 1]], strict=True):
                assert by_words.setdefault(word, h) == h
            runs = [tuple(expect[k : k + 3]) for k in range(len(expect) - 2)]
            assert bounds[i + 1] - bounds[i] == len(runs)
            for run, h in zip(runs, hashes[bounds[i] : bounds[i + 1]], strict=True):
                assert by_shingles.setdefault(run, h) == h
                assert whole_hash(w.hashes[w.bounds[i] :][:3]) == hashes[bounds[i]]
    assert len(set(by_words.values())) == len(by_words)
    assert len(set(by_shingles.values())) == len(by_shingles)


def test_slices_cover_every_row_once():
    texts = pa.array(["a" * 900_000, "b" * 900_000, None, "", "c" * 3_000_000, "d"])
    seen = []
    for row, end, data, offsets in slices(texts):
        assert len(offsets) == end - row + 1 and offsets[-1] == len(data)
        seen += list(range(row, end))
    assert seen == list(range(6))


def test_hash_array_finds_what_it_holds():
    rng = np.random.default_rng(0)
    keys = np.unique(rng.integers(0, 1 << 63, 5_000).astype(np.uint64) * np.uint64(2))
    array = HashArray(keys)
    assert (array.find(keys) == np.arange(len(keys))).all()
    assert (array.find(keys + np.uint64(1)) == -1).all()
    assert (HashArray(keys[:0]).find(keys) == -1).all()
