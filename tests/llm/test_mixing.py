import random

import pytest
from pyspark.sql import functions as F

from nearmark.llm.mixing import mix, mixed, targets


def shares(words):
    """Weights 1, 2, 3 in turn; what does not fit is shared again until nothing exceeds."""
    total, full = sum(words), set()
    while True:
        rest = [i for i in range(len(words)) if i not in full]
        left = total - sum(3 * words[i] for i in full)
        weight = sum(1 + i % 3 for i in rest)
        out = {i: left * (1 + i % 3) / weight for i in rest}
        over = {i for i in rest if out[i] > 3 * words[i]}
        if not over:
            return [float(3 * words[i]) if i in full else out[i] for i in range(len(words))]
        full |= over


@pytest.mark.parametrize("seed", range(6))
def test_targets_as_by_resharing(spark, seed):
    rng = random.Random(seed)
    words = [rng.choice([0, 1, 5, 50, 1000, 40000]) * rng.randrange(1, 9) for _ in range(17)]
    names = [f"s{i:02}" for i in range(16)] + [None]
    df = spark.createDataFrame(list(zip(names, words, strict=True)), "source string, words bigint")
    got = {r["source"]: r["target"] for r in targets(df).collect()}
    want = shares(words)
    assert [got[n] for n in names] == pytest.approx(want)
    assert sum(want) == pytest.approx(sum(words))


def corpus(documents, n=600):
    rng = random.Random(1)
    rows = [(i, "w " * int(rng.lognormvariate(3, 1)), None, rng.choice(["a", "a", "a", "b", "ü", None])) for i in range(n)]
    return documents([*rows, (None, "x y", None, "b"), (None, "x y", None, "b"), (7, None, None, "a"), (8, "", None, "empty")], ["size", "copies", "target", "_rank", "_of_source", "class", "part", "words", "_s"])


def test_takes_come_near_the_targets(spark, documents):
    df = corpus(documents)
    out, names = mix(df)
    rows = out.select("source", *[F.col(c).alias(k) for k, c in names.items()]).collect()
    assert len(rows) == df.count() and sorted(r.source or "~" for r in rows) == sorted(r.source or "~" for r in df.collect())
    assert max(r["copies"] for r in rows) <= 3 and min(r["copies"] for r in rows) >= 0
    for source in {r.source for r in rows}:
        of = [r for r in rows if r.source == source]
        target = of[0]["target"]
        assert of[0]["source_size"] == sum(r["size"] for r in of)
        assert abs(sum(r["copies"] * r["size"] for r in of) - target) <= max(3 * max(r["size"] for r in of), 0.02 * target)
        each = target / of[0]["source_size"] if of[0]["source_size"] else 0
        assert all(int(each) <= r["copies"] <= int(each) + 1 for r in of)


def test_reruns_agree_and_rows_repeat(spark, documents):
    df = corpus(documents)
    first, names = mix(df)
    key = lambda d: sorted((r.doc_id or -1, r.text or "", r[names["copies"]]) for r in d.collect())
    assert key(first) == key(mix(df.repartition(7))[0])
    repeated = mixed(df)
    assert repeated.columns == df.columns
    assert repeated.count() == first.agg(F.sum(names["copies"])).first()[0]
    assert mixed(df.where("false")).count() == 0 and mix(df.where("false"))[0].count() == 0
