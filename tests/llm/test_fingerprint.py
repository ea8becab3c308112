import hashlib
import random

import numpy as np
import pytest

from nearmark.llm.fingerprint import fingerprint, fingerprint_report, fingerprints, gammas, sample, spliced, with_next


def test_draws_are_gamma_and_uniform():
    x = np.random.default_rng(0).integers(0, 2**64, 400_000, dtype=np.uint64)
    r, log_c, b = gammas(x)
    c = np.exp(log_c)
    for g in (r, c):
        assert abs(g.mean() - 2) < 0.02 and abs(g.var() - 2) < 0.06
        # Distribution function of Gamma(2, 1).
        for q in (0.5, 1.5, 4.0):
            assert abs((g < q).mean() - (1 - np.exp(-q) * (1 + q))) < 0.005
    for q in (0.1, 0.5, 0.9):
        assert abs((b < q).mean() - q) < 0.005
    assert abs(np.corrcoef([r, c, b]) - np.eye(3)).max() < 0.01


def test_least_hash_has_the_least_sample_at_weight_one():
    x = np.sort(np.random.default_rng(1).integers(0, 2**64, 1000, dtype=np.uint64))
    log_a, t = sample(x, np.ones(1000))
    assert (np.diff(log_a) > 0).all() and not t.any()


@pytest.mark.parametrize("weights", ["one", "few", "many"])
def test_collisions_are_the_generalised_jaccard(weights):
    rng = np.random.default_rng(2)
    h = np.sort(rng.integers(0, 2**64, 120, dtype=np.uint64))
    top = {"one": 2, "few": 4, "many": 60}[weights]
    v = rng.integers(0, top, 120)
    w = np.where(rng.random(120) < 0.6, v, rng.integers(0, top, 120))
    want = np.minimum(v, w).sum() / np.maximum(v, w).sum()
    both = np.concatenate([h[v > 0], h[w > 0]])
    weight = np.concatenate([v[v > 0], w[w > 0]])
    marks = fingerprints(both, weight, np.array([0, (v > 0).sum(), len(both)]), 4000)
    assert abs((marks[0] == marks[1]).mean() - want) < 0.03


def rows():
    rng = random.Random(3)
    word = lambda: rng.choice(["a", "é", "日本", "word", "🙂"]) + str(rng.randrange(50))
    out = [(i, rng.choice([" ", "\n"]).join(word() for _ in range(rng.randrange(0, 60)))) for i in range(90)]
    return [*out, (200, None), (201, ""), (202, "x " * 500), (203, out[5][1]), (None, "null key here"), (None, "null key here"), (7, "same key")]


@pytest.mark.parametrize("parts", [1, 4])
def test_next_texts_and_edits(spark, documents, parts):
    df = documents(rows(), ["key", "tie", "part"]).repartition(parts)
    by = {}
    for r in fingerprint(df, keep=("doc_id", "text")).collect():
        by.setdefault(r["text"] or "", set()).add(r["fingerprint"])
    assert all(len(v) == 1 for v in by.values())
    got = with_next(df).collect()
    assert len(got) == len(rows())
    keyed = sorted((r for r in rows() if r[0] is not None and r[0] != 7), key=lambda r: -r[0])
    found = {r["key"]: r for r in got}
    for (key, text), (after, other) in zip(keyed, keyed[1:], strict=False):
        if key - after > 1 and 7 in range(after, key):
            continue
        edited = spliced(text or "", other or "")
        r = found[key]
        assert r["n_chars"] == len(text or "")
        assert r["edited_sha256"] == hashlib.sha256(edited.encode()).hexdigest()
        assert r["fingerprint"].hex() in by[text or ""] and r["next_fingerprint"].hex() in by[other or ""]
    last = [r for r in got if r["key"] is None]
    first = spliced("null key here", rows()[93][1])
    assert {r["edited_sha256"] for r in last} == {hashlib.sha256(t.encode()).hexdigest() for t in (first, spliced("null key here", "null key here"))}
    assert with_next(df.where("false")).count() == 0


def test_one_document_follows_itself(spark, documents):
    (r,) = with_next(documents([(1, "a b c d e f")])).collect()
    assert r["edited_sha256"] == hashlib.sha256(b"a b c a b c"[:11]).hexdigest() or r["n_chars"] == 11
    assert r["next_fingerprint"] == r["fingerprint"]


def test_report_over_the_table(spark):
    out = fingerprint_report(spark, "/root/testdata/sf0.001").collect()
    docs = {r.doc_id: r.text or "" for r in spark.read.parquet("/root/testdata/sf0.001/documents.parquet").collect()}
    assert len(out) == len(docs)
    order = sorted(docs, reverse=True)
    after = dict(zip(order, order[1:] + order[:1], strict=True))
    by_text = {}
    for r in out:
        edited = spliced(docs[r.doc_id], docs[after[r.doc_id]])
        assert r.edited_sha256 == hashlib.sha256(edited.encode()).hexdigest()
        assert 0 <= r.near_next <= 1 and 0 <= r.near_edited <= 1
        assert by_text.setdefault(docs[r.doc_id], r.fingerprint) == r.fingerprint
    assert np.mean([r.near_edited for r in out]) > 0.2 > np.mean([r.near_next for r in out])
