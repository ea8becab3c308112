"""The pipeline's stages, one after the other, against plain Python."""

import os
import random
import re
import sys
import zlib

import numpy as np
import pytest

sys.path.insert(0, os.path.join(os.path.dirname(os.path.abspath(__file__)), "..", ".."))

import corpus_pipeline  # noqa: E402

pytest.importorskip("tokenizers")
pytest.importorskip("public_tokenizers")

EN = "the of and with that this from have were which their about would there could other".split()
FR = "où les être pour avec été dans nous leurs était même après sans très encore déjà".split()
SECRET = re.compile(r"password=[a-z0-9]{16}")


def shingles(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    return {tuple(words[i : i + 5]) for i in range(max(1, len(words) - 4))}


def corpus(spark, folder):
    rng = random.Random(11)
    rows = []
    for i in range(160):
        words = rng.choice((EN, FR))
        text = [rng.choice(words) + rng.choice(["", "", "s", "r"]) for _ in range(rng.randrange(20, 140))]
        if i % 7 == 0:
            text.insert(5, "password=" + "".join(rng.choice("abcdef0123456789") for _ in range(16)))
        rows.append((i, " ".join(text), "en" if words is EN else "fr", rng.choice(["a", "b", None])))
        if i % 5 == 0:
            near = list(text)
            near[3] = "changed"
            rows.append((1000 + i, " ".join(near), rows[-1][2], "c"))
            rows.append((2000 + i, "  ".join(text), None, "a"))
    rows += [(5000, None, "en", "a"), (5001, "", "en", "a"), (5002, "123 456 %%%", None, "b"), (None, rows[0][1], "en", "a"), (None, "un texte sans clé pour nous avec les autres", "fr", "b")]
    rows += [(7, rows[7][1], "en", "z"), rows[7]]
    df = spark.createDataFrame([(*r, None if r[1] is None else len(r[1])) for r in rows], "doc_id bigint, text string, lang string, source string, n_chars bigint")
    for name in ("score", "_key", "size", "copies", "secrets", "_rank", "start"):
        from pyspark.sql import functions as F

        df = df.withColumn(name, F.lit("kept"))
    df.repartition(3).write.parquet(f"{folder}/documents.parquet")
    return f"file://{folder}"


def test_stages(spark, tmp_path):
    folder = corpus(spark, tmp_path)
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    columns, tables = docs.columns, [docs.collect()]
    for k, (_, stage) in enumerate(corpus_pipeline.STAGES):
        path = f"file://{tmp_path}/{k}"
        stage(spark, docs, folder).write.parquet(path)
        docs = spark.read.parquet(path)
        tables.append(docs.collect())
        if k < 4:
            assert docs.columns == columns
    given, language, single, masked, mixture, pieces = tables

    lost = sorted(map(str, (r.text for r in set(given) - set(language))))
    assert lost == ["", "123 456 %%%", "None"] and len(language) == len(given) - 3

    # One row of each component of similar texts, that of the least key.
    groups = []
    for r in language:
        own, rest = [r], []
        for g in groups:
            near = any(len(shingles(r.text) & shingles(o.text)) >= 0.8 * len(shingles(r.text) | shingles(o.text)) for o in g)
            (own.extend(g) if near else rest.append(g))
        groups = [*rest, own]
    want = []
    for g in groups:
        keys = [r.doc_id for r in g if r.doc_id is not None]
        want.append(min(keys) if keys else None)
    assert sorted((r.doc_id for r in single), key=str) == sorted(want, key=str)
    assert set(single) <= set(language) and len(single) <= len(language) - 60

    plain = lambda rows: sorted((str(r.doc_id), r.text, r.n_chars) for r in rows)
    hidden = [(str(r.doc_id), SECRET.sub("[secret]", r.text)) for r in single]
    assert plain(masked) == sorted((d, t, len(t)) for d, t in hidden)
    assert sum("[secret]" in r.text for r in masked) > 15

    size = lambda t: len(re.findall(r"[^\x20\x09-\x0D]+", t))
    times = {r: 0 for r in masked}
    for r in mixture:
        times[r] += 1
    total = sum(size(r.text) for r in masked)
    assert max(times.values()) <= 3 and abs(sum(size(r.text) for r in mixture) - total) < 0.1 * total

    from tokenizers import Tokenizer

    from nearmark.llm.packing import default_tokenizer

    tokenizer = Tokenizer.from_file(default_tokenizer())
    ids = {r.doc_id: np.asarray([*tokenizer.encode(r.text, add_special_tokens=False).ids, 2], "<u4") for r in mixture}
    assert sum(p.length for p in pieces) == sum(len(ids[r.doc_id]) for r in mixture)
    for p in pieces:
        assert p.ids_crc32 == zlib.crc32(ids[p.doc_id][p.start : p.start + p.length].tobytes())
    sizes = {}
    for p in pieces:
        sizes[p.sequence_id] = sizes.get(p.sequence_id, 0) + p.length
    assert all(n <= 4096 and n & (n - 1) == 0 for n in sizes.values())


def test_nothing_in_nothing_out(spark, tmp_path):
    docs = spark.createDataFrame([], "doc_id bigint, text string, lang string, source string, n_chars bigint")
    docs.write.parquet(f"file://{tmp_path}/documents.parquet")
    assert corpus_pipeline.run(spark, f"file://{tmp_path}").count() == 0


def test_a_corpus_without_labels_stays(spark, tmp_path):
    rows = [(1, "the of and", None), (2, "", None), (3, None, None), (4, "12 %", None)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, lang string")
    assert [tuple(r) for r in corpus_pipeline.language(spark, docs, str(tmp_path)).collect()] == [rows[0]]
