import random
import tracemalloc
import zlib

import numpy as np
import pytest

from nearmark.llm import language
from nearmark.llm.language import Subwords, fit, held_out, identify, train

WORDS = {"en": "the of and with that this from have".split(), "fr": "où les être pour avec été dans nous".split()}


def corpus(documents, n=240, extra=()):
    rng = random.Random(2)
    rows = []
    for i in range(n):
        lang = ("en", "fr")[i % 2]
        rows.append((i, " ".join(rng.choice(WORDS[lang]) for _ in range(rng.randrange(3, 40))), lang))
    return documents(rows, extra)


@pytest.fixture(scope="module")
def model(spark):
    from pyspark.sql import functions as F

    rng = random.Random(2)
    rows = [(i, " ".join(rng.choice(WORDS[lang]) for _ in range(rng.randrange(3, 40))), lang) for i, lang in enumerate(["en", "fr"] * 120)]
    df = spark.createDataFrame(rows, "doc_id bigint, text string, lang string").withColumn("x", F.lit(1))
    return fit(df)


def test_held_out_rows_are_told(spark, documents, model):
    df = corpus(documents, extra=["score", "lang_pred", "_body"])
    out, names = identify(df, model)
    rows = out.withColumn("h", held_out(out.doc_id)).collect()
    for r in rows:
        assert r.h == (zlib.crc32(str(r.doc_id).encode()) % 4 == 2)
    right = [r[names["lang_pred"]] == r.lang for r in rows if r.h]
    assert len(right) > 30 and np.mean(right) > 0.97
    assert all(0 <= r[names["score"]] <= 1 for r in rows)


def test_held_out_labels_are_never_read(spark, documents):
    df = corpus(documents).cache()
    from pyspark.sql import functions as F

    spoiled = df.withColumn("lang", F.when(held_out(F.col("doc_id")), F.lit("zz")).otherwise(F.col("lang")))
    a, b = fit(df), fit(spoiled.repartition(5))
    assert a.languages == b.languages == ["en", "fr"]
    assert np.array_equal(a.weights, b.weights)


def test_texts_without_letters_and_odd_rows(spark, documents, model):
    df = documents([(1, None), (2, ""), (3, "123 %%% ½"), (4, "the of and with that"), (4, "the of and with that"), (None, "les être avec")])
    out, _ = identify(df, model)
    rows = sorted(out.collect(), key=lambda r: (r.doc_id or 9, r.text or ""))
    assert [r.lang_pred for r in rows] == ["und", "und", "und", "en", "en", "fr"]
    assert [r.rejected for r in rows[:4]] == [True, True, True, False]
    assert identify(df.where("false"), model)[0].count() == 0
    nothing = fit(df)
    assert nothing.languages == [] and {r.lang_pred for r in identify(df, nothing)[0].collect()} == {"und"}


def test_long_texts_count_as_one(monkeypatch):
    subwords = Subwords()
    data = np.frombuffer(("The quick Été brown " * 500).encode(), np.uint8)
    offsets = np.array([0, len(data)])
    whole = subwords.counts(data, offsets)
    monkeypatch.setattr(language, "SLICE", 997)
    assert np.abs(subwords.counts(data, offsets) - whole).sum() < 0.01 * whole.sum()


FOUR = WORDS | {"de": "und der nicht mit sich auch werden über".split(), "es": "los que para una pero más está muy".split()}
FOREIGN = ["szczęście jest zawsze możliwe gdzie ludzie chcą żyć", "εδώ είναι μια ξένη γλώσσα που δεν ξέρει κανείς", "это совсем другой язык который никто не учил", "kaikki ihmiset syntyvät vapaina ja tasavertaisina"]


@pytest.mark.parametrize("languages", [1, 2, 3, 4])
def test_foreign_and_random_texts_are_rejected(spark, documents, languages):
    rng = random.Random(4)
    known = list(FOUR)[:languages]
    rows = [(i, " ".join(rng.choice(FOUR[known[i % languages]]) for _ in range(rng.randrange(5, 40))), known[i % languages]) for i in range(120 * languages)]
    learned = fit(documents(rows))
    junk = ["".join(rng.choice("abcdefghijklmnopqrstuvwxyz ") for _ in range(300)) for _ in range(40)]
    out, _ = identify(documents([*rows, *((10_000 + i, t) for i, t in enumerate([*FOREIGN, *junk]))]), learned)
    gone = {r.doc_id: r.rejected for r in out.collect()}
    assert all(v for k, v in gone.items() if k >= 10_000)
    assert sum(v for k, v in gone.items() if k < 10_000) <= 0.02 * len(rows)


def test_a_repeated_key_does_not_fill_the_sample(spark, documents, monkeypatch):
    from nearmark.llm import language

    rows = [(0, f"the word number {i}", "en") for i in range(400)] + [(i, f"le mot {i}", "fr") for i in range(1, 60)]
    seen = []
    monkeypatch.setattr(language, "train", lambda rows: seen.append(len(rows)))
    language.fit(documents(rows), rows=20, per_language=10)
    assert 1 <= seen[0] <= 40


def test_training_holds_the_rows_once():
    rng = np.random.default_rng(3)
    rows = [(np.arange(20_000, dtype=np.int16), rng.integers(1, 9, 20_000).astype(np.int32), "ab"[i % 2]) for i in range(400)]
    tracemalloc.start()
    model = train(rows)
    _, peak = tracemalloc.get_traced_memory()
    tracemalloc.stop()
    # The rows have 48 MB; their shares, all at once, had 64 MB more.
    assert peak < 40e6
    wide = train([(b.astype(np.int64), c.astype(np.float64), lang) for b, c, lang in rows])
    assert (model.weights == wide.weights).all() and model.floor == wide.floor and model.temperature == wide.temperature
