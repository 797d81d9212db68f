import numpy as np

from meterlake.llm import embeddings
from tests.conftest import SMALL


def brute(rows, least=0.9):
    """Links, component and id of each row by all pairs."""
    fine = {i: np.array(v, dtype=float) for i, (_, v) in enumerate(rows) if v and rows[i][0] is not None and all(x is not None and np.isfinite(x) for x in v) and any(v)}
    group, links = list(range(len(rows))), [0] * len(rows)

    def find(i):
        while group[i] != i:
            i = group[i]
        return i

    for i, a in fine.items():
        for j, b in fine.items():
            if j < i and len(a) == len(b) and (np.array_equal(a, b) or a @ b / (np.linalg.norm(a) * np.linalg.norm(b)) >= least):
                links[i] += 1
                links[j] += 1
                group[find(i)] = find(j)
    names = {}
    for i, (k, _) in enumerate(rows):
        if k is not None:
            names[find(i)] = min(k, names.get(find(i), k))
    return sorted(((k, links[i], None if k is None else names[find(i)]) for i, (k, _) in enumerate(rows)), key=str)


def found(frame):
    got = frame.collect()
    assert all(r.kept == (r.vec_id is None or r.vec_id == r.component_id) for r in got)
    return sorted(((r.vec_id, r.n_links, r.component_id) for r in got), key=str)


def test_transform_keeps_lengths_and_is_its_own_inverse():
    x = np.random.default_rng(0).normal(size=(5, 64))
    y = embeddings.hadamard(x)
    assert np.allclose(np.linalg.norm(x, axis=1), np.linalg.norm(y, axis=1)) and np.allclose(embeddings.hadamard(y), x)


def test_pairs_at_the_threshold_meet_in_any_dimension():
    rng = np.random.default_rng(5)
    for dim in (64, 128, 384, 768):
        a, b = rng.normal(size=(2, 400, dim))
        a /= np.linalg.norm(a, axis=1, keepdims=True)
        b -= (a * b).sum(axis=1, keepdims=True) * a
        b = 0.9 * a + np.sqrt(0.19) * b / np.linalg.norm(b, axis=1, keepdims=True)
        a, b = (np.pad(x, ((0, 0), (0, (1 << (dim - 1).bit_length()) - dim))) for x in (a, b))
        met = np.zeros(len(a), bool)
        for table in range(embeddings.TABLES):
            pa, pb = embeddings.bucket_probes(a, table), embeddings.bucket_probes(b, table)
            met |= (pa == pb[:, :1]).any(axis=1) | (pb == pa[:, :1]).any(axis=1)
        assert met.mean() >= 0.99


def test_large_clusters_agree_with_all_pairs_at_fewer_comparisons(spark, monkeypatch):
    """Tight clusters, wide ones and two that touch in part."""
    rng, rows = np.random.default_rng(2), []
    centre = rng.normal(size=(3, 64))
    beside = centre[0] + 0.45 * rng.normal(size=64)
    for c, noise, n in ((centre[0], 0.05, 150), (beside, 0.05, 100), (centre[1], 0.3, 60), (centre[2], 0.12, 120)):
        rows += [(c + noise * rng.normal(size=64)).tolist() for _ in range(n)]
    rows = [(k, v) for k, v in enumerate(rows + rows[:40])]
    compared, plain = [], embeddings._cosines

    def counted(pairs, nodes):
        compared.append(pairs.count())
        return plain(pairs, nodes)

    monkeypatch.setattr(embeddings, "_cosines", counted)
    got, expect = found(embeddings.near_duplicates(spark.createDataFrame(rows, "vec_id long, embedding array<double>").repartition(4))), brute(rows)
    links = sum(n for _, n, _ in expect) / 2
    assert [g[2] for g in got] == [e[2] for e in expect]
    assert links * 0.99 <= sum(n for _, n, _ in got) / 2 <= links
    assert all(g[1] <= e[1] for g, e in zip(got, expect, strict=True))
    assert sum(compared) < links


def test_planted_groups_agree_with_all_pairs(spark):
    rng, rows = np.random.default_rng(1), []
    for g in range(60):
        centre = rng.normal(size=64)
        for _ in range(rng.integers(1, 9)):
            rows.append((len(rows), (centre + rng.normal(size=64) * rng.choice([0, 0.05, 0.1, 0.25])).astype(np.float32).tolist()))
    frame = spark.createDataFrame(rows, "vec_id long, embedding array<float>").repartition(4)
    expect, got = brute([(k, np.float32(v).astype(float).tolist()) for k, v in rows]), found(embeddings.near_duplicates(frame))
    assert sum(n for _, n, _ in got) >= 0.99 * sum(n for _, n, _ in expect)
    assert all(g[1] <= e[1] for g, e in zip(got, expect, strict=True))
    assert got == expect or sum(g != e for g, e in zip(got, expect, strict=True)) < 5


def test_table_has_no_false_links(spark):
    table = spark.read.parquet(f"{SMALL}/embeddings.parquet")
    rows = [(r.vec_id, r.embedding) for r in table.collect()]
    assert found(embeddings.near_duplicates(table)) == brute(rows)


def test_odd_and_no_vectors(spark):
    nan, inf = float("nan"), float("inf")
    one = [1.0, 2.0, 3.0]
    rows = [(5, one), (3, one), (3, one), (9, [2.0, 4.0, 6.0]), (4, [-1.0, -2.0, -3.0]), (6, [0.0, 0.0, 0.0]), (7, None), (8, []), (10, [1.0, None, 3.0]), (11, [nan, 1.0, 1.0]), (12, [inf, 1.0, 1.0]), (None, one), (13, [1.0, 2.0]), (14, [1e-40, 2e-40, 3e-40]), (15, [1e300, 2e300, 3e300]), (16, [-0.0, 1.0, 0.0]), (17, [0.0, 1.0, 0.0]), (3, [0.0, 0.0, 1.0])]
    frame = spark.createDataFrame([(k, v, 1, "n") for k, v in rows], "vec_id long, embedding array<double>, label int, node string")
    got = found(embeddings.near_duplicates(frame))
    linked = {3, 5, 9, 14, 15}
    for k, n, c in got:
        if k in linked - {3}:
            assert (n, c) == (5, 3)
        elif k in (16, 17):
            assert (n, c) == (1, 16)
        elif k not in (3, None):
            assert (n, c) == (0, k)
    assert sorted(n for k, n, _ in got if k == 3) == [0, 5, 5]
    assert [g for g in got if g[0] is None] == [(None, 0, None)]
    assert embeddings.near_duplicates(frame.where("false")).count() == 0
