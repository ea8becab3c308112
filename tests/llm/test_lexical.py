import math
import random
import re
from collections import Counter

import pytest

from nearmark.llm import lexical
from nearmark.llm.lexical import TABLE, build, search, terms_of

TERM = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")
LOWER = {c: c + 32 for c in range(65, 91)}


def terms(text):
    return TERM.findall((text or "").translate(LOWER))


def plain(docs, items, top):
    """The ranking as it is stated."""
    own = [(i, Counter(terms(t))) for i, t in docs]
    own = [(i, c) for i, c in own if c]
    n, length, df = len(own), sum(sum(c.values()) for _, c in own), Counter()
    for _, c in own:
        df.update(c.keys())
    out = []
    for item, text in items:
        scores = []
        for i, c in own:
            m = 50 + (50 * sum(c.values()) * n) // length
            s = sum(
                math.floor(1000 * math.log((2 * n + 2) / (2 * df[t] + 1))) * ((10**9 * c[t]) // (1000 * c[t] + 20 * m))
                for t in set(terms(text))
                if t in c
            )
            if s:
                scores.append((-s, i is not None, i or 0, i))
        out += [(item, r, i, -s) for r, (s, _, _, i) in enumerate(sorted(scores)[:top], 1)]
    return out


WORDS = ["a", "B", "the", "The", "é", "ÀB", "x1", "x_1", "x-1", "日本", "😀z", "\x7fq", "[w]", "w", "", "ſ", "0"]


def corpus(rng, n):
    texts = [" ".join(rng.choice(WORDS) for _ in range(rng.randrange(0, 30))) for _ in range(n)]
    return [(i, t) for i, t in enumerate(texts)]


def test_terms_of_parts(monkeypatch):
    rng = random.Random(1)
    assert TABLE[0x41] == 0x61 and TABLE[0x80] == 0x80 and TABLE[0x5F] == 0x20
    for size in (1, 3, 10):
        monkeypatch.setattr(lexical, "BLOCK_BYTES", size)
        for _, text in corpus(rng, 200):
            assert {k.decode(): v for k, v in terms_of(text.encode()).items()} == Counter(terms(text))


@pytest.mark.parametrize("small", [False, True])
def test_same_as_stated(spark, documents, monkeypatch, small):
    if small:
        # Many blocks, first ones that settle little, and several portions of queries.
        for name, value in {"BLOCK_DOCS": 3, "FIRST_BLOCKS": 1, "POSTINGS": 2, "QUERY_BYTES": 300}.items():
            monkeypatch.setattr(lexical, name, value)
    rng = random.Random(2)
    docs = corpus(rng, 300)
    docs += [(i, "the w w 日本") for i in range(300, 400)] + [(5, docs[5][1])] * 3 + [(401, None), (402, ""), (403, "_ - _"), (None, "é é w")]
    docs += [(404, "word the " * 3000)]
    items = [(i, " ".join(rng.choice(WORDS) for _ in range(rng.randrange(1, 12)))) for i in range(20)]
    items += [(20, None), (21, ""), (22, "unheard"), (3, items[3][1]), (24, "THE the tHe w")]
    index = build(documents(docs, ["m", "n", "terms", "key", "score"]).repartition(7))
    asked = spark.createDataFrame([(*i, "x") for i in items], "item_id int, text string, rank string")
    got = search(index, asked, top=20)
    assert got.columns == ["item_id", "rank", "doc_id", "score"]
    assert sorted(map(repr, map(tuple, got.collect()))) == sorted(map(repr, plain(docs, items, 20)))


def test_empty_tables(spark, documents):
    asked = spark.createDataFrame([(1, "a b")], "item_id bigint, text string")
    assert search(build(documents([])), asked).collect() == []
    assert search(build(documents([(1, None), (2, "--")])), asked).collect() == []
    none = search(build(documents([(1, "a")])), asked.where("item_id > 1"))
    assert none.collect() == [] and none.columns == ["item_id", "rank", "doc_id", "score"]


def test_postings_stay_where_they_are(documents):
    index = build(documents(corpus(random.Random(3), 200)).repartition(6))
    assert index.blocks.schema.fieldNames() == lexical.NAMES
    strata = index.blocks.groupBy("block").agg({"m": "count"}).collect()
    assert all(r[1] == 1 for r in strata)
