import math
import random
import re
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from nearmark.llm import crossent
from nearmark.llm.crossent import packed, score_report, score_words, unpacked


def test_good_texts_score_lower(spark):
    folder = "/root/testdata/sf0.01"
    labels = {r.doc_id: r.quality for r in spark.read.parquet(f"{folder}/labels.parquet").collect()}
    rows = [(r.score, labels[r.doc_id]) for r in score_report(spark, folder).collect() if r.doc_id in labels]
    good, bad = [s for s, q in rows if q], [s for s, q in rows if not q]
    assert sum(g < b for g in good for b in bad) / (len(good) * len(bad)) > 0.9


def plain_word_losses(texts, size, kinds, scale=1.0, k=crossent.SMOOTHING):
    three, two, one = Counter(), Counter(), Counter()
    for t in texts:
        seq = word_tokens(t)
        three.update(zip(seq, seq[1:], seq[2:]))
        two.update(zip(seq, seq[1:]))
        one.update(seq[1:])

    def loss(a, b, c):
        p1 = (one[c] * scale + 1) / (size + kinds + 1)
        p2 = (two[b, c] * scale + k * p1) / (one[b] * scale + k)
        return -math.log((three[a, b, c] * scale + k * p2) / (two[a, b] * scale + k))

    return loss


def word_tokens(text):
    return [1, 2, *re.findall(r"[^\x20\x09-\x0D]+", text or ""), 3]


@pytest.mark.parametrize(("block", "bucket"), [(1 << 23, 1 << 21), (40, 1 << 21), (40, 50)])
def test_word_trigrams_same_as_plain_models(spark, documents, monkeypatch, block, bucket):
    monkeypatch.setattr(crossent, "COUNTED_BYTES", block)
    monkeypatch.setattr(crossent, "BUCKET_TOKENS", bucket)
    rng = random.Random(1)
    texts = [rng.choice(" \n").join(rng.choice(["a", "of", "é日", "the", "x" * 30]) for _ in range(rng.randrange(0, 60))) for _ in range(60)] + [None, "", " \t ", "of the " * 40, "of the " * 40, "\xa0 one\u2028two"]
    df = documents(list(enumerate(texts)), ["score", "n_tokens", "_text", "h", "target_mean"]).repartition(3)
    n, total = (sum(len(word_tokens(t)) - 2 for i, t in enumerate(texts) if i % m == 0) for m in (3, 1))
    kinds = len({w for t in texts for w in word_tokens(t)[2:]})
    ours = plain_word_losses([t for i, t in enumerate(texts) if i % 3 == 0], n, kinds)
    theirs = plain_word_losses(texts, n, kinds, n / total)
    rows = score_words(df, F.col("doc_id") % 3 == 0).collect()
    assert sorted(r["doc_id"] for r in rows) == list(range(len(texts)))
    for r in rows:
        seq = word_tokens(r["text"])
        grams = list(zip(seq, seq[1:], seq[2:]))
        assert r["_n_tokens"] == len(grams) and r["score"] == "kept"
        assert r["target_loss"] == pytest.approx(sum(ours(*g) for g in grams) / len(grams))
        assert r["background_loss"] == pytest.approx(sum(theirs(*g) for g in grams) / len(grams))
        assert r["_score"] == pytest.approx(r["target_loss"] - r["background_loss"], abs=1e-9)
    assert score_words(df.where("false"), F.lit(True)).count() == 0


def test_nothing_to_learn_from(spark, documents):
    df = documents([(1, "some text"), (1, "some text"), (None, None), (None, " ")])
    rows = score_words(df, F.lit(None).cast("boolean")).collect()
    assert sorted(r["n_tokens"] for r in rows) == [1, 1, 3, 3] and all(math.isfinite(r["score"]) for r in rows)
    assert len({r["score"] for r in rows if r["n_tokens"] == 3}) == 1


def test_packed_numbers():
    for values in ([], [0], [0, 255, 256], [1 << 63, 5], list(range(1000))):
        assert unpacked(packed(np.array(values, np.uint64))).tolist() == values


def test_counts_grow_with_the_corpus_and_hot_words_do_not(spark, documents, monkeypatch):
    monkeypatch.setattr(crossent, "COUNTED_BYTES", 300)
    words = [f"w{i}" for i in range(20)]
    rng = random.Random(3)

    def asked(n):
        docs = documents([(i, " ".join(rng.choices(words, k=50))) for i in range(n)])
        picked = docs.select("text", F.lit(True).alias("wanted"))
        rows = crossent.ask(crossent.gathered(picked, "text", "wanted"), "text", "wanted", 1).collect()
        per_block = [len(unpacked(bytes(r["keys"]))) for r in rows if r["order"] == 1]
        return sum(len(unpacked(bytes(r["keys"]))) for r in rows), max(per_block)

    (few, _), (many, most) = asked(10), asked(40)
    # More words follow one another, but a word is named once a block however often it occurs.
    assert many > 3 * few and most <= 22


def test_word_order_tells_texts_of_equal_words(spark, tmp_path):
    rng = random.Random(5)
    kinds = ["red fox runs home", "home red runs fox"]
    rows = [(i, " ".join(kinds[i % 2] for _ in range(rng.randrange(3, 9)))) for i in range(80)]
    spark.createDataFrame(rows, "doc_id bigint, text string").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(i, (i + 1) % 2) for i in range(40)], "doc_id bigint, quality int").write.parquet(f"{tmp_path}/labels.parquet")
    out = {r.doc_id: r for r in score_report(spark, str(tmp_path)).collect()}
    assert all(out[i].n_tokens == len(t.split()) + 1 for i, t in rows)
    assert max(out[i].score for i in range(0, 80, 2)) < min(out[i].score for i in range(1, 80, 2))
