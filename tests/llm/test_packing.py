import random
import zlib

import numpy as np
import pyarrow as pa
import pytest

from nearmark.llm import packing
from nearmark.llm.common import per_process
from nearmark.llm.packing import WordEncoder, default_tokenizer, fill, pack

pytest.importorskip("tokenizers")
pytest.importorskip("public_tokenizers")

ODD = ["the", "Naïve", "ÉTÉ", "…", "日本", "\n", "\t", "\x1c", "\xa0", " ", "don't", "it's.", "<|endoftext|>", "x" * 50, "🙂", "é", "İ", "Σ", "1234", "a.b", "!!", "ﬁ", "µ", "ß"]


def texts():
    rng = random.Random(6)
    made = ["".join(rng.choice(ODD) + rng.choice(["", " ", " ", "  "]) for _ in range(rng.randrange(0, 60))) for _ in range(300)]
    return [*made, "", " ", "́ a", "a ́", "a\ń"]


def test_ids_are_the_librarys(monkeypatch):
    encoder = WordEncoder(default_tokenizer())
    want = [np.asarray(encoder.tokenizer.encode(t, add_special_tokens=False).ids, "<u4").tobytes() for t in texts()]
    assert encoder.ids(texts()) == want
    monkeypatch.setattr(packing, "MEMORY_WORDS", 40)
    encoder = WordEncoder(default_tokenizer())
    assert [encoder.ids([t])[0] for t in texts()] == want and encoder.ids(texts()) == want


@pytest.mark.parametrize("seed", range(30))
def test_fill_is_the_best_sum(seed):
    rng = random.Random(seed)
    counts = {rng.randrange(1, 60): rng.randrange(1, 4) for _ in range(rng.randrange(0, 7))}
    room = rng.randrange(0, 120)
    sums = {0}
    for n, times in counts.items():
        sums = {s + n * k for s in sums for k in range(times + 1)}
    taken = fill(counts, room)
    assert all(taken[n] <= counts[n] for n in taken)
    assert sum(n * k for n, k in taken.items()) == max(s for s in sums if s <= room)


def test_every_id_lies_in_one_piece(spark, documents):
    rng = random.Random(8)
    rows = [(i, " ".join(rng.choice(ODD) for _ in range(rng.choice([0, 3, 20, 100, 700])))) for i in range(120)]
    rows += [(None, "a b"), (None, "a b"), (5, None), (6, "")]
    df = documents(rows, ["start", "offset"]).repartition(3)
    window = 256
    pieces = pack(df, default_tokenizer(), window=window, keep=("doc_id", "text")).collect()
    encoder = WordEncoder(default_tokenizer()).tokenizer
    ids = {t: np.asarray([*encoder.encode(t or "", add_special_tokens=False).ids, 2], "<u4") for _, t in rows}
    total = sum(len(ids[t]) for _, t in rows)
    assert sum(p.length for p in pieces) == total
    by_doc, by_sequence = {}, {}
    for p in pieces:
        own = ids[p.text]
        assert p.doc_tokens == len(own) and p.length > 0
        assert p.ids_crc32 == zlib.crc32(own[p.start : p.start + p.length].tobytes())
        by_doc.setdefault((p.doc_id, p.text), []).append((p.start, p.length))
        by_sequence.setdefault(p.sequence_id, []).append((p.offset, p.length))
    for (key, text), own in by_doc.items():
        times = sum(r == (key, text) for r in rows)
        covered = sorted(x for s, n in own for x in range(s, s + n))
        assert covered == sorted(list(range(len(ids[text]))) * times)
    for own in by_sequence.values():
        at = 0
        for offset, length in sorted(own):
            assert offset == at
            at += length
        assert at <= window and at & (at - 1) == 0
    assert pack(df.where("false"), default_tokenizer()).count() == 0


@pytest.mark.parametrize("group", [256, 5])
def test_many_small_partitions_fill_windows_together(spark, documents, monkeypatch, group):
    monkeypatch.setattr("nearmark.llm.packing.GROUP", group)
    rows = [(i, "a b c d " * (i % 11)) for i in range(400)]
    df = documents(rows, ["_group", "_ids"]).repartition(200)
    window = 512
    pieces = pack(df, default_tokenizer(), window=window, keep=("doc_id", "_group", "_ids")).collect()
    assert {(p._group, p._ids) for p in pieces} == {("kept", "kept")}
    sizes = {}
    for p in pieces:
        sizes[p.sequence_id] = sizes.get(p.sequence_id, 0) + p.length
    total = sum(sizes.values())
    assert total == sum(4 * (i % 11) + 1 for i in range(400))
    # No task has a window of its own; what all leave is less than one.
    assert sorted(sizes.values())[::-1] == [window] * (total // window) + [b for b in (256, 128, 64, 32, 16, 8, 4, 2, 1) if total % window & b]
    assert len({p.doc_id for p in pieces}) == 400
    # Documents are not shredded: a piece more a window at most.
    assert len(pieces) <= 400 + total // window + 9


def test_remembered_words_go_when_another_operator_works(spark, documents):
    from nearmark.llm.neardup import read_signatures

    def keep(batches):
        per_process("words:kept", dict)["x"] = 1
        yield from batches

    def look(batches):
        for batch in batches:
            yield pa.record_batch({"id": pa.array([per_process("words:kept", dict).get("x", 0)] * batch.num_rows, pa.int64())})

    one = lambda f: spark.range(0, 40, 1, 1).mapInArrow(f, "id bigint").agg({"id": "sum"}).first()[0]
    one(keep)
    # Tasks run one after the other, in the worker that is at hand.
    assert one(look) == 40
    read_signatures(documents([(1, "a b c d e f")], []).coalesce(1), "doc_id", "text").collect()
    assert one(look) == 0


def test_words_in_use_are_remembered_when_memory_is_full(monkeypatch):
    monkeypatch.setattr(packing, "MEMORY_WORDS", 400)
    encoder = WordEncoder(default_tokenizer())
    letters = "abcdefghijklmnopqrstuvwxyz"
    common = [a + b for a in letters for b in "xyz"]
    rare = ["".join(random.Random(i).choices(letters, k=9)) for i in range(4000)]
    learned = []
    learn = encoder._learn_letters
    monkeypatch.setattr(encoder, "_learn_letters", lambda words: (learned.extend(words), learn(words))[1])
    for i in range(0, 4000, 20):
        text = " ".join([*common, *rare[i : i + 20], "Été,"])
        assert encoder.ids([text])[0] == encoder.direct(text)
        assert len(encoder.known) + len(encoder.older) <= 600
    # A word that every text has is learned once, a rare one too.
    assert len(learned) == len(set(learned))
