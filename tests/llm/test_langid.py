import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F

from meterlake.llm import langid
from meterlake.llm.common import held_out
from meterlake.llm.queries import op1_language_kneser_ney
from tests.conftest import SMALL
from tests.llm.cases import no_documents, odd_documents


def test_characters_agree_with_a_plain_version():
    texts = ["Ab, cd!  E", "", "  x", "é你 \U0001f600 Straße", "123", "a\n\nb "]
    _, data, offsets = (None, *langid.slices(pa.array(texts)).__next__()[2:])
    chars, bounds = langid.characters(data, offsets)
    for i, text in enumerate(texts):
        plain = " ".join("".join(c.lower() if c.isalpha() else " " for c in text).split()) + " "
        got = "".join(map(chr, chars[bounds[i] : bounds[i + 1]]))
        assert got == plain if plain.strip() else not got.strip()


def test_models_are_distributions():
    text = "abracadabra abrakadabra candelabra bar car" * 3
    data = np.frombuffer(text.encode(), dtype=np.uint8)
    grams, counts = np.unique(langid.ngrams(*langid.characters(data, np.array([0, len(data)]))), return_counts=True)
    alphabet = len(set(text)) + 1
    model = langid.KneserNey(grams, counts, alphabet)
    both = langid.LanguageModel.build({"x": model}, alphabet)
    signs = [ord(c) for c in set(text)] + [ord("z")]
    for context in ("abr", "a b", "qqq", "zab", "   "):
        packed = [sum(ord(c) << (16 * (3 - i)) for i, c in enumerate(context)) + s for s in signs]
        p = np.exp(both.log_probabilities(np.array(packed, dtype=np.uint64)).astype(float))
        assert abs(p.sum() - 1) < 1e-5 and (p > 0).all()


def test_interpolation_agrees_with_a_plain_version():
    rng = np.random.default_rng(0)
    text = "".join(rng.choice(list("abc "), 400))
    data = np.frombuffer(text.encode(), dtype=np.uint8)
    chars, bounds = langid.characters(data, np.array([0, len(data)]))
    grams = langid.ngrams(chars, bounds)
    unique, counts = np.unique(grams, return_counts=True)
    model = langid.KneserNey(unique, counts, 5)
    split = lambda g: tuple((int(g) >> (16 * k)) & 0xFFFF for k in (3, 2, 1, 0))
    tables = {4: {split(g): int(c) for g, c in zip(unique, counts, strict=True)}}
    for n in (3, 2, 1):
        tables[n] = {}
        for g in tables[n + 1]:
            tables[n][g[1:]] = tables[n].get(g[1:], 0) + 1

    def p(g):
        if not g:
            return 1 / 5
        table = tables[len(g)]
        values = np.array(list(table.values()))
        d = langid._discount(values)
        own = {k: c for k, c in table.items() if k[:-1] == g[:-1]}
        if not own:
            return p(g[1:])
        return max(own.get(g, 0) - d, 0) / sum(own.values()) + d * len(own) / sum(own.values()) * p(g[1:])

    both = langid.LanguageModel.build({"x": model}, 5)
    seen = [split(g) for g in unique]
    asked = seen + [(97, 98, 99, 122), (122, 97, 98, 99), (98, 98, 98, 98)]
    packed = np.array([sum(c << (16 * (3 - i)) for i, c in enumerate(g)) for g in asked], dtype=np.uint64)
    assert np.allclose(np.exp(both.log_probabilities(packed)[:, 0].astype(float)), [p(g) for g in asked], rtol=1e-4)


def test_held_out_documents(spark):
    truth = spark.read.parquet(f"{SMALL}/documents.parquet").select("doc_id", "lang").toPandas()
    got = op1_language_kneser_ney(spark, SMALL).toPandas().merge(truth, on="doc_id")
    assert len(got) == len(truth) and got.score.between(0, 1).all()
    assert (got.lang == got.lang_pred)[got.held_out].mean() > 0.98
    assert got.rejected.mean() < 0.05


def test_rejects_another_script(spark):
    docs = spark.read.parquet(f"{SMALL}/documents.parquet")
    model = langid.fit(docs, ~held_out())
    other = spark.createDataFrame([(1, "это совсем другой язык " * 10), (2, "zzqx jjkw vvxq " * 20)], "doc_id long, text string")
    assert all(r.rejected for r in langid.identified(other, model).collect())


def test_odd_and_no_documents(spark):
    docs = odd_documents(spark)
    model = langid.fit(docs, F.lit(True))
    got = {(r.doc_id, r.n_chars_scored > 0): r for r in langid.identified(docs, model).collect()}
    for key in ((4, False), (5, False), (6, False), (13, False), (None, False)):
        assert got[key].lang_pred == "und" and got[key].score == 0 and got[key].rejected
    assert {r.lang_pred for r in got.values()} <= {"en", "de", "fr", "und"}
    assert langid.identified(no_documents(spark), model).count() == 0
    marks = spark.createDataFrame([(1, "\u0301\u0302 \u093e 12"), (2, "e\u0301t\u00e9")], "doc_id long, text string")
    assert [r.lang_pred == "und" for r in langid.identified(marks, model).orderBy("doc_id").collect()] == [True, False]
    nothing = langid.fit(no_documents(spark), F.lit(True))
    assert {r.lang_pred for r in langid.identified(docs, nothing).collect()} == {"und"}


def test_every_language_with_a_usable_text_is_learned(spark):
    rows = [(i, f"word{chr(97 + i % 26) * 3} and some more letters {chr(98 + i % 24) * 4} " * 5, f"l{i:02d}") for i in range(40)]
    rows += [(100 + i, "12 34 " * 9, "l00") for i in range(9)] + [(200, "12 34", "none")]
    model = langid.fit(spark.createDataFrame(rows, "doc_id long, text string, lang string"), F.lit(True))
    assert sorted(model.languages) == [f"l{i:02d}" for i in range(40)]
    assert langid.SAMPLE_CHARS < 3_000_000
    long = spark.createDataFrame([(i, "x") for i in range(3)], "doc_id long, lang string").withColumn("text", F.expr("repeat('some words ', 900000)"))
    assert langid.fit(long, F.lit(True)).languages == ["x"]
