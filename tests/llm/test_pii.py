import hashlib
import itertools
import random
import re

import numpy as np
from pyspark.sql import functions as F

from nearmark.llm import pii
from nearmark.llm.pii import KINDS, LABELS, OTHER, Graph, Mention, Weights, base_spans, beliefs, find_personal, label, learn

# The kinds as they are stated.
STATED = {
    "email": re.compile(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+"),
    "ip": re.compile(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)"),
    "card": re.compile(r"[0-9]([\x20-]?[0-9])+"),
    "phone": re.compile(r"\+[0-9][\x20().0-9-]+[0-9]"),
}
PARTS = ["a", "B.c", "@", "@", ".", "..", "x-y", "_%+", "é", " ", "-", "+", "1", "0", "255", "256", "0007", "4539 1488 0343 6467", "4539148803436467", "(33)", "\n", "12", ".1.2.3", "+49 30 1234567", "@mail.example.com", "joe@m.org", "٣", "79927398713"]


def holds(kind, text):
    digits = re.sub("[^0-9]", "", text)
    if kind == "ip":
        return all(int(p) <= 255 for p in text.split("."))
    if kind == "card":
        doubled = [sum(divmod(2 * int(d), 10)) if i % 2 else int(d) for i, d in enumerate(digits[::-1])]
        return 13 <= len(digits) <= 19 and sum(doubled) % 10 == 0
    return kind == "email" or 9 <= len(digits) <= 15


def stated(text):
    return [(k, *m.span()) for k, p in STATED.items() for m in p.finditer(text) if holds(k, m[0])]


def texts():
    rng = random.Random(5)
    return ["", " ", *("".join(rng.choice(PARTS) for _ in range(rng.randrange(1, 30))) for _ in range(4000))]


def test_base_as_stated():
    found = 0
    for text in texts():
        got = [(KINDS[k], a, b) for k, a, b in base_spans(text)]
        assert got == stated(text), text
        found += len(got)
    assert found > 1000


def test_long_runs_take_no_square():
    for part in ("a", "1", "1.", "@a", "+1(", "1 ", "a.", "a@", "+"):
        base_spans(part * 400_000)


def weights(seed):
    rng = np.random.default_rng(seed)
    pair = rng.normal(size=(2, LABELS, LABELS))
    return Weights(rng.normal(size=(pii.FEATURES, LABELS)), pair + pair.transpose(0, 2, 1))


def exact(w, graph):
    """Probabilities by summing over all labellings."""
    n = len(graph.kind)
    at = np.concatenate([[0], np.cumsum(graph.looks)])
    out = np.zeros((n, LABELS))
    for y in itertools.product(range(LABELS), repeat=n):
        if any(not f and y[i] != graph.kind[i] for i, f in enumerate(graph.free)):
            continue
        score = sum(w.look[f, y[i]] for i in range(n) if graph.free[i] for f in graph.look[at[i] : at[i + 1]])
        score += sum(w.pair[s, y[a], y[b]] for a, b, s in graph.edges)
        for i, v in enumerate(y):
            out[i, v] += np.exp(score)
    return out / out.sum(axis=1, keepdims=True)


def mention(text, kind=OTHER):
    return Mention(0, len(text), text, kind)


def test_messages_are_exact_on_chains_and_close_on_loops(monkeypatch):
    monkeypatch.setattr(pii, "MESSAGES", 60)
    chain, loop = Graph(), Graph()
    chain.add([mention("a@b"), mention("123456"), mention("1.2.3.4", 1), mention("+49 654321"), mention("c@d.e")])
    loop.add([mention("a@b.c", 0), mention("123456"), mention("A@b"), mention("12-3456"), mention("654321")])
    assert {s for _, _, s in chain.edges} == {0} and {s for _, _, s in loop.edges} == {0, 1}
    for seed in range(4):
        w = weights(seed)
        node, _, _ = beliefs(w, chain.arrays())
        assert np.abs(node - exact(w, chain)).max() < 1e-6
        mild = Weights(w.look, w.pair / 4)
        node, _, _ = beliefs(mild, loop.arrays())
        assert np.abs(node - exact(mild, loop)).max() < 0.05


BASE = ["mail joe.x{0}@mail8.example.com", "call +1 (337) 555-7{0:03d}", "host 10.20.{0}.51", "card 4539 1488 0343 6467"]
AGAIN = ["joe.x{0}@mail8", "337-555-7{0:03d}", "10-20-{0}-51", "4539.1488.0343.6467"]


def known():
    return learn([[(m.kind, m.text) for m in pii.mentions(t, base_spans(t))] for t in (b.format(i) for i in range(100, 140) for b in BASE)])


def test_labels_are_consistent_over_a_text():
    w = known()
    filler = " word" * 500
    for i in range(200, 210):
        for k, (base, again) in enumerate(zip(BASE, AGAIN, strict=True)):
            again = again.format(i)
            for between in (", ", filler, filler + " 5550001111 " + filler):
                text = base.format(i) + between + " x " + again
                found, added = label(w, [text])
                assert len(found[0]) == 1
                assert [(KINDS[a], text[s:e]) for a, s, e in added[0]] == [(KINDS[(0, 3, 1, 2)[k]], again)]
            # Alone, or beside something else, it is nothing.
            assert label(w, [again, "card 4539 1488 0343 6467 " + "77 66 55 44 33", "plain words"])[1] == [[], [], []]


def test_a_text_does_not_depend_on_others():
    w = known()
    some = [b.format(i) + " x " + a.format(i) for i in range(30) for b, a in zip(BASE, AGAIN, strict=True)]
    assert label(w, some)[1] == [label(w, [t])[1][0] for t in some]


def test_tables(spark, documents):
    body = [b.format(i) + " x" * 50 + " " + a.format(i) for i in range(100, 130) for b, a in zip(BASE, AGAIN, strict=True)]
    body += [None, "", "no data", body[0], "x " * 1_500_000 + body[1], *texts()[:50]]
    rows = [(i, t) for i, t in enumerate(body)] + [(0, body[0])] * 2
    found = find_personal(documents(rows, ["base", "added", "_searched"]).repartition(3))
    assert found.columns == ["doc_id", "text", "lang", "source", "n_chars", "base", "added", "_searched", "_base", "_added"]
    got = {r["doc_id"]: r for r in found.collect()}
    assert found.count() == len(rows)
    for i, text in rows:
        assert [(s["kind"], s["start"], s["end"]) for s in got[i]["_base"]] == sorted(stated(text or ""), key=lambda s: (KINDS.index(s[0]), s[1]))
        assert got[i]["base"] == got[i]["added"] == "kept"
    assert sum(len(got[i]["_added"]) for i in range(120)) == 120
    assert len(got[124]["_added"]) == 1 and not got[120]["_added"] and not got[121]["_added"]
    assert find_personal(documents([])).collect() == []
    assert find_personal(documents([(1, "nothing here"), (None, None)])).where(F.size("added") + F.size("base") > 0).count() == 0


def test_report(spark, documents, tmp_path):
    rows = [(1, "a@b.c 1.2.3.4 and a@b"), (2, None), (3, "b@c.d, a@b.c")]
    documents(rows).write.parquet(f"{tmp_path}/documents.parquet")
    got = {r["doc_id"]: r for r in pii.personal_report(spark, str(tmp_path)).collect()}
    base = {i: ",".join(f"{k}:{a}:{b}" for k, a, b in stated(t or "")) for i, t in rows}
    for i, own in base.items():
        assert got[i]["base_sha256"] == hashlib.sha256(own.encode()).hexdigest()
        assert set(own.split(",")) <= set(got[i]["spans"].split(","))
        assert (got[i]["n_email"], got[i]["n_ip"], got[i]["n_card"], got[i]["n_phone"]) == tuple(own.count(k + ":") for k in KINDS)
    assert got[3]["spans"] == "email:0:5,email:7:12"
