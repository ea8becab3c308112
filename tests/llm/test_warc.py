import gzip
import io
import itertools
import os
import random
import zlib

import pytest
from pyspark.sql import functions as F

from nearmark.llm import warc
from nearmark.llm.warc import Bytes, archived, read_warc, record, salvage, write_warc


def made(n=12, compress=False, seed=0):
    rng = random.Random(seed)
    out = []
    for i in range(n):
        body = bytes(rng.randrange(256) for _ in range(rng.randrange(0, 900))) + b"WARC/1.0\r\nnot a record"
        digest = warc.hashlib.sha256(body).hexdigest()
        data = record(str(i), f"http://x/{i}\r\né", body, digest, len(body), None, False)
        out.append(gzip.compress(data) if compress else data)
    return out


def run(data):
    out = list(salvage(Bytes(io.BytesIO(data), len(data))))
    # What is read and what is lost covers the file, without overlap.
    assert [b for b, *_ in out] == [0, *[e for _, e, *_ in out[:-1]]][: len(out)] and (not out or out[-1][1] == len(data))
    ids = [r.headers["warc-record-id"][10:-1] for _, _, rs, _ in out for r in rs]
    return ids, [(b, e, why) for b, e, rs, why in out if why]


@pytest.mark.parametrize("compress", [False, True])
def test_undamaged_files_have_no_gap(compress):
    assert run(b"".join(made(compress=compress))) == ([str(i) for i in range(12)], [])
    assert run(b"") == ([], [])


@pytest.mark.parametrize("compress", [False, True])
@pytest.mark.parametrize("seed", range(8))
def test_damage_costs_the_damaged_record_only(compress, seed):
    rng = random.Random(seed)
    parts = made(compress=compress, seed=seed)
    hit = rng.randrange(12)
    bad = bytearray(parts[hit])
    kind = seed % 4
    if kind == 0:
        at = rng.randrange(len(bad) // 2, len(bad) - 8)
        bad[at] ^= 0xFF
    elif kind == 1:
        del bad[rng.randrange(4, len(bad) - 4) :]
    elif kind == 2:
        bad[0:4] = b"\0\0\0\0"
    else:
        bad[len(bad) // 2 : len(bad) // 2] = b"\x1f\x8b\x08junk WARC/1.1\r\nContent-Length: 5\r\n\r\n"
    lost = bytes(bad)
    ids, gaps = run(b"".join([*parts[:hit], lost, *parts[hit + 1 :]]))
    assert ids == [str(i) for i in range(12) if i != hit]
    before = sum(map(len, parts[:hit]))
    assert len(gaps) == 1 and gaps[0][:2] == (before, before + len(lost)) and gaps[0][2]


def test_junk_before_between_and_after():
    a, b = made(2)
    ids, gaps = run(b"junk" + a + b"\r\nmore junk" + gzip.compress(b) + b"WARC/1.1\r\n")
    assert ids == ["0", "1"] and len(gaps) == 3
    assert run(b"\x1f\x8b\x08")[0] == [] and run(b"nothing here")[1][0][:2] == (0, 12)


def pages(spark):
    long, short = "é" * 60, "s" * 99
    rows = [(5, "http://a b/ü\n", long), (3, None, long), (9, "u", long), (3, "u", short), (4, "u", short), (6, "u", None), (7, "u", ""), (None, "u", long), (None, "u", "n" * 100), (8, "u", "y" * 200), (8, "v", "y" * 200), (10, "v", "y" * 200), (11, "w", "\r\n\r\nWARC/1.1\r\n\r\n" * 9)]
    return spark.createDataFrame(rows, "page_id bigint, url string, html string").selectExpr("*", "1 AS digest", "2 AS key", "3 AS first")


@pytest.mark.parametrize("compress", [True, False])
def test_round_trip(spark, tmp_path, compress):
    path = f"file://{tmp_path}/out"
    df = pages(spark).repartition(3)
    write_warc(df, path, compress, limit=600)
    assert not [f for f in os.listdir(tmp_path / "out") if f.startswith("_")]
    found = read_warc(spark, path).cache()
    assert found.where("damage is not null").count() == 0
    rows = archived(found, "bigint").collect()
    want = {}
    for r in df.collect():
        body = (r.html or "").encode()
        group = [p for p in df.collect() if p.html == r.html and p.page_id is not None]
        least = min((p.page_id for p in group), default=None)
        revisit = len(body) >= 100 and least is not None and r.page_id != least
        key = (r.page_id, len(body), warc.hashlib.sha256(body).hexdigest(), "revisit" if revisit else "response", least if revisit else None)
        want[key] = want.get(key, 0) + 1
    got = {}
    for r in rows:
        got[tuple(r)] = got.get(tuple(r), 0) + 1
    assert got == want
    bodies = found.where(F.col("headers")["warc-type"] == "response").select("payload").collect()
    assert {bytes(b.payload).decode() for b in bodies} == {r.html or "" for r in df.collect()}


def test_gaps_are_logged_through_spark(spark, tmp_path):
    path = tmp_path / "out"
    write_warc(pages(spark).coalesce(1), f"file://{path}")
    (name,) = os.listdir(path)
    data = (path / name).read_bytes()
    (path / name).write_bytes(data[:300] + b"????" + data[304:])
    out = read_warc(spark, f"file://{path}")
    (gap,) = out.where("damage is not null").collect()
    assert gap["begin"] <= 300 < gap["end"] and gap["payload"] is None
    assert out.where("damage is null").count() == 12


def test_no_pages(spark, tmp_path):
    write_warc(pages(spark).where("false"), f"file://{tmp_path}/none")
    assert archived(read_warc(spark, f"file://{tmp_path}/none"), "bigint").count() == 0


@pytest.mark.parametrize("compress", [False, True])
def test_headers_of_any_length(spark, tmp_path, compress):
    rows = [(1, "data:" + "a" * 70_000, "p" * 200), (2, "http://" + "\u65e5" * 400_000, "q" * 200), (3, "u", "p" * 200)]
    write_warc(spark.createDataFrame(rows, "page_id bigint, url string, html string"), f"file://{tmp_path}/out", compress)
    found = read_warc(spark, f"file://{tmp_path}/out", whole=True)
    assert sorted((r.key, r.record_type, r.refers_to) for r in archived(found, "bigint").collect()) == [(1, "response", None), (2, "response", None), (3, "revisit", 1)]
    assert {len(r.u) for r in found.select(F.col("headers")["warc-target-uri"].alias("u")).collect()} == {70_005, 3_600_007, 1}


def test_report_fails_if_a_page_cannot_be_read(spark, tmp_path, monkeypatch):
    pages(spark).select("page_id", "url", "html").write.parquet(f"{tmp_path}/pages.parquet")

    def damaged(df, path):
        write_warc(df.coalesce(1), path)
        folder = path.removeprefix("file:")
        (name,) = os.listdir(folder)
        with open(f"{folder}/{name}", "r+b") as file:
            file.seek(300)
            file.write(b"????")

    monkeypatch.setattr(warc, "scratch_path", lambda *_: f"file:{tmp_path}/archives")
    assert warc.archive_report(spark, str(tmp_path)).count() == 13
    monkeypatch.setattr(warc, "scratch_path", lambda *_: f"file:{tmp_path}/again")
    monkeypatch.setattr(warc, "write_warc", damaged)
    with pytest.raises(Exception, match="bytes [0-9]+ to"):
        warc.archive_report(spark, str(tmp_path)).collect()


@pytest.mark.parametrize("seed", range(4))
def test_one_member_of_all_records_loses_the_damaged_one_only(seed):
    parts = made(seed=seed)
    hit = random.Random(seed).randrange(1, 11)
    bad = bytearray(parts[hit])
    bad[-9] ^= 0xFF
    alone, after = gzip.compress(b"".join([*parts[:hit], bytes(bad), *parts[hit + 1 :]])), gzip.compress(made(13)[12])
    ids, gaps = run(alone + after)
    assert ids == [str(i) for i in range(13) if i != hit]
    begin = sum(map(len, parts[:hit]))
    assert [g[:2] for g in gaps] == [(0, len(alone))] and f"bytes {begin} to {begin + len(bad)} of" in gaps[0][2]


@pytest.mark.parametrize("follows", [False, True])
def test_what_precedes_a_cut_or_a_wrong_checksum_is_kept(monkeypatch, follows):
    parts = made(40)
    packed, after = gzip.compress(b"".join(parts)), gzip.compress(made(41)[40]) if follows else b""
    last = ["40"] * follows
    for size in (1 << 16, 100):
        monkeypatch.setattr(warc, "PACKED_BYTES", size)
        for cut in (len(packed) // 2, len(packed) - 4):
            ids, gaps = run(packed[:cut] + after)
            held = len(zlib.decompressobj(31).decompress(packed[:cut]))
            kept = sum(end <= held for end in itertools.accumulate(map(len, parts)))
            assert kept > 10 and ids == [str(i) for i in range(kept)] + last and [g[:2] for g in gaps] == [(0, cut)]
        wrong = bytearray(packed)
        wrong[-6] ^= 0xFF
        ids, gaps = run(bytes(wrong) + after)
        assert ids == [str(i) for i in range(40)] + last and len(gaps) == 1 and "member: " in gaps[0][2]


def test_records_and_gaps_inside_a_member_through_spark(spark, tmp_path):
    parts = made(9)
    bad = [p[:-9] + b"?" + p[-8:] if i in (3, 6) else p for i, p in enumerate(parts)]
    (tmp_path / "a.warc.gz").write_bytes(gzip.compress(b"".join(bad)))
    out = read_warc(spark, f"file://{tmp_path}").collect()
    assert [r.headers["warc-record-id"][10:-1] for r in out if r.headers] == [i for i in "012345678" if i not in "36"]
    assert sum(r.damage is not None for r in out) == 2


def test_files_are_read_by_tasks_of_their_own(spark, tmp_path):
    pages = spark.createDataFrame([(i, f"http://a/{i}", "x" * 200 + str(i)) for i in range(60)], "page_id bigint, url string, html string")
    write_warc(pages.repartition(12), f"file://{tmp_path}/out", limit=500)
    found = read_warc(spark, f"file://{tmp_path}/out")
    files = found.select("file").distinct().count()
    assert found.rdd.getNumPartitions() == min(files, 4 * spark.sparkContext.defaultParallelism) > 8
    # Dealt evenly, as names that are hashed would not be.
    tasks = found.groupBy(F.spark_partition_id().alias("task")).agg(F.count_distinct("file").alias("n")).collect()
    assert len(tasks) > 8
