"""Documents that every operator has to get along with."""

import random

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, node string, label string, id_slot long, gumbel_noise double, mixed_id long"


def words(rng, n, of=200):
    return " ".join(f"w{rng.randrange(of)}" for _ in range(n))


def odd_rows():
    """Nulls in every column, empty and very long texts, ties and repeated rows, clashing names."""
    rng = random.Random(1)
    base = words(rng, 120)
    near = base.replace(base.split()[60], "changed", 1)
    texts = [
        (1, base, "en", "a"),
        (2, base, "en", "a"),
        (2, base, "en", "a"),
        (3, near, "en", None),
        (4, "", "en", "b"),
        (5, None, None, None),
        (6, " \t\n ", "de", "b"),
        (7, "one", "de", "b"),
        (8, "one two", "de", "c"),
        (9, "ONE two", None, "c"),
        (10, words(rng, 60_000, 5_000), "en", "c"),
        (11, "x" * 200_000, "fr", "c"),
        (None, base, "en", "a"),
        (None, None, None, None),
        (12, "été 你好 \U0001f600 déjà", "fr", "d"),
        (13, "12345 !!! ???", "en", "d"),
        (14, words(rng, 300), "en", "a"),
        (15, words(rng, 300), "de", "a"),
    ]
    return [(i, t, la, s, None if t is None else len(t), "n", "l", 1, 0.5, 2) for i, t, la, s in texts]


def odd_documents(spark):
    return spark.createDataFrame(odd_rows(), SCHEMA).repartition(3)


def no_documents(spark):
    return spark.createDataFrame([], SCHEMA)
