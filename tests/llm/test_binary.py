"""Training-order shards and transport streams: exact round trips."""

from __future__ import annotations

import hashlib
import os
import zlib

import numpy as np
import pyarrow as pa
import pytest
from hypothesis import given, settings, strategies as st

from pyspark.sql import functions as F

from sluicegate.llm import queries, training_order, transport_stream as ts

# --- training order ---------------------------------------------------------


@settings(max_examples=60, deadline=None)
@given(st.integers(1, 3000), st.integers(0, 1 << 62))
def test_slots_are_a_permutation(size, key):
    got = training_order.permute(np.arange(size), size, key)
    assert sorted(got.tolist()) == list(range(size))
    assert training_order.permute(np.arange(size)[::2], size, key).tolist() == got[::2].tolist()


def test_keys_give_different_orders():
    a, b = (training_order.permute(np.arange(1000), 1000, k) for k in (1, 2))
    assert (a != b).mean() > 0.9 and (a != np.arange(1000)).mean() > 0.9


IDS = [(1, [*range(60_000, 60_150)]), (2, None), (3, []), (4, [7]), (4, [7]), (None, [1, 2]), (5, [*range(25_000)])]


def sequences(rows, seq_len):
    return sorted((-1 if i is None else i, k // seq_len, t[k : k + seq_len]) for i, t in rows for t in [t or []] for k in range(0, len(t), seq_len))


def written(spark, folder, rows, seq_len, shard_rows, width=4, key=9, parts=3):
    """(number of sequences, folder of the shards) of (id, ids) rows."""
    spark.createDataFrame(rows, "doc_id long, ids array<int>").repartition(parts).write.parquet(f"{folder}/table")
    return training_order.materialise(spark.read.parquet(f"{folder}/table"), f"{folder}/shards", key, seq_len, shard_rows, width, ids_col="ids"), f"{folder}/shards"


def plain(rows, width):
    return [(r["slot"], r["id"], r["seq"], r["n_tokens"], np.frombuffer(r["tokens"], dtype="<u2" if width == 2 else "<i4").tolist()) for r in rows]


@pytest.mark.parametrize("width", [2, 4])
def test_shards_hold_every_sequence_once_and_resume_anywhere(spark, tmp_path, width):
    n, path = written(spark, tmp_path, IDS, 64, 10, width)
    want = sequences(IDS, 64)
    rows = plain(training_order.read_slots(spark, path).orderBy("slot").collect(), width)
    assert n == len(want) == len(rows)
    assert [r[0] for r in rows] == list(range(n))
    assert sorted((r[1], r[2], r[4]) for r in rows) == want
    assert all(r[3] == len(r[4]) for r in rows)
    assert plain(training_order.read_slots(spark, path, 57, 123).orderBy("slot").collect(), width) == rows[57:123]
    assert training_order.read_slots(spark, path, n, None).collect() == []
    about = training_order.manifest(path)
    assert sorted(os.listdir(path)) == ["manifest.json", *about["shards"]] and len(about["shards"]) >= n // 10
    sizes = [b - a for a, b in zip(about["firsts"], about["firsts"][1:])]
    assert max(sizes) <= 10 and [os.path.getsize(f"{path}/{f}") for f in about["shards"]] == [(16 + 64 * width) * k for k in sizes]
    # record i of a shard begins at i strides
    at = about["firsts"][4] + 2
    raw = open(f"{path}/{about['shards'][4]}", "rb").read()[2 * about["stride"] : 3 * about["stride"]]
    assert int.from_bytes(raw[:8], "little", signed=True) == rows[at][1]


def test_resuming_reads_the_needed_bytes_only(spark, tmp_path):
    n, path = written(spark, tmp_path, IDS, 64, 50)
    about = training_order.manifest(path)
    want = [r for b in training_order.records(path, about, 0, n) for r in b.to_pylist()]
    # all else is overwritten with a byte that no record could come out of
    for first, name in zip(about["firsts"], about["shards"]):
        whole = open(f"{path}/{name}", "rb").read()
        raw = bytearray(b"\xff" * len(whole))
        lo, hi = (min(max(0, x - first) * about["stride"], len(whole)) for x in (120, 260))
        raw[lo:hi] = whole[lo:hi]
        open(f"{path}/{name}", "wb").write(raw)
    assert [r for b in training_order.records(path, about, 120, 260, block=7) for r in b.to_pylist()] == want[120:260]


def test_reruns_give_the_same_files_and_other_keys_other_orders(spark, tmp_path):
    rows = [(i, [i] * (1 + i % 40)) for i in range(300)]
    got = []
    for k, key in enumerate((5, 5, 6)):
        n, path = written(spark, tmp_path / str(k), rows, 8, 16, key=key, parts=1)
        got.append([r["id"] for r in training_order.read_slots(spark, path).orderBy("slot").collect()])
    assert got[0] == got[1] != got[2] and sorted(got[0]) == sorted(got[2])
    assert got[0] != sorted(got[0])


def test_a_table_that_changes_between_the_scans_is_noticed(spark, tmp_path):
    size = F.unix_micros(F.current_timestamp()) % 997 + 1  # of the time of each scan
    moved = spark.range(4).select(F.col("id").alias("doc_id"), F.sequence(F.lit(1), size.cast("int")).alias("ids"))
    with pytest.raises(Exception, match="changed between two scans"):
        training_order.materialise(moved, str(tmp_path / "s"), 1, 1, ids_col="ids")


def test_ids_that_do_not_fit_and_no_sequences(spark, tmp_path):
    with pytest.raises(Exception, match="doesn't fit"):
        written(spark, tmp_path / "a", [(1, [70_000])], 8, 4, width=2)
    n, path = written(spark, tmp_path / "b", [(1, None), (2, [])], 8, 4)
    assert n == 0 and training_order.read_slots(spark, path).collect() == []


def test_clashing_columns_do_not_matter(spark, tmp_path):
    df = spark.createDataFrame([(1, "abc", 5, "z"), (2, None, 6, "y"), (None, "", 7, "x")], "doc_id long, text string, part int, ids string")
    assert training_order.materialise(df, f"{tmp_path}/s", 1, 8) == 1
    assert training_order.read_slots(spark, f"{tmp_path}/s").first()["id"] == 1


def test_order_query_equals_brute_force(spark, data):
    from sluicegate.llm.tokenizers import byte_bpe

    encode, rows = byte_bpe().encode_ordinary, spark.read.parquet(f"{data}/documents.parquet").collect()
    want = sorted((i, k, len(ids), zlib.crc32(np.array(ids, "<u2").tobytes())) for i, k, ids in sequences([(r["doc_id"], encode(r["text"] or "")) for r in rows], queries.SEQ_LEN))
    got = queries.op7_training_order(spark, data).collect()
    assert sorted((r["doc_id"], r["seq"], r["n_tokens"], r["tokens_crc32"]) for r in got) == want
    assert sorted(r["slot"] for r in got) == list(range(len(want)))


def shuffled(spark):
    """Bytes that the session's stages have written for a shuffle so far."""
    spark.sparkContext._jsc.sc().listenerBus().waitUntilEmpty()
    stages = spark.sparkContext._jsc.sc().statusStore().stageList(None, False, False, spark.sparkContext._gateway.new_array(spark._jvm.double, 0), None)
    return sum(stages.apply(k).shuffleWriteBytes() for k in range(stages.size()))


def test_sequences_do_not_pass_through_the_executors_heap(spark, tmp_path):
    rng = np.random.default_rng(1)
    spark.createDataFrame([(i, rng.integers(0, 1 << 16, 4096).tolist()) for i in range(500)], "doc_id long, ids array<int>").write.parquet(f"{tmp_path}/table")
    before = shuffled(spark)
    n = training_order.materialise(spark.read.parquet(f"{tmp_path}/table"), f"{tmp_path}/s", 9, 512, 1000, 2, ids_col="ids")
    assert n == 4000 and shuffled(spark) - before < 4000 * 1040 / 8


def test_many_runs_of_one_partition(spark, tmp_path):
    spark.range(0, 150_000, 1, 1).select(F.col("id").alias("doc_id"), F.array(F.col("id").cast("int")).alias("ids")).write.parquet(f"{tmp_path}/table")
    assert training_order.materialise(spark.read.parquet(f"{tmp_path}/table"), f"{tmp_path}/s", 3, 4, 40_000, ids_col="ids") == 150_000 > 2 * training_order.RUN_ROWS
    rows = plain(training_order.read_slots(spark, f"{tmp_path}/s").orderBy("slot").collect(), 4)
    want = np.argsort(training_order.permute(np.arange(150_000), 150_000, 3)).tolist()
    assert [(r[1], r[4]) for r in rows] == [(i, [i]) for i in want]


@pytest.mark.parametrize("block", [1, 7, 4096])
def test_pieces_merge_in_any_block(tmp_path, block):
    fs, pieces, want = training_order._place(str(tmp_path))[0], [], []
    slots = np.random.default_rng(2).permutation(60)
    for k, own in enumerate((range(0, 1), range(1, 40), range(40, 60))):
        rows = [(s, s * 10 - 1, s + 1, s % 5, bytes([s]) * (2 * (s % 5))) for s in sorted(int(slots[i]) for i in own)]
        raw = np.array([r[:4] for r in rows], training_order.RUN).tobytes() + b"".join(r[4] for r in rows)
        packed = pa.compress(raw, training_order.CODEC, asbytes=True)
        open(f"{tmp_path}/{k}", "wb").write(b"skip" + packed)
        pieces.append([f"{tmp_path}/{k}", 4, len(packed), len(rows), len(raw)])
        want += rows
    blocks = list(training_order.merged(fs, pieces, 4, 2, block))
    assert b"".join(blocks) == b"".join(i.to_bytes(8, "little", signed=True) + q.to_bytes(4, "little") + m.to_bytes(4, "little") + raw.ljust(8, b"\0") for _, i, q, m, raw in sorted(want))
    assert max(map(len, blocks)) <= 24 * block
    os.truncate(f"{tmp_path}/2", os.path.getsize(f"{tmp_path}/2") - 1)
    with pytest.raises(OSError, match="ends before"):
        list(training_order.merged(fs, pieces, 4, 2))


def test_shards_of_several_ranges(spark, tmp_path):
    # 40 kB a record: 1,677 records of a range, two ranges a shard
    spark.range(0, 2500, 1, 1).select(F.col("id").alias("doc_id"), F.array(F.col("id").cast("int")).alias("ids")).write.parquet(f"{tmp_path}/table")
    assert training_order.materialise(spark.read.parquet(f"{tmp_path}/table"), f"{tmp_path}/s", 3, 10_000, 2000, ids_col="ids") == 2500
    rows = plain(training_order.read_slots(spark, f"{tmp_path}/s").orderBy("slot").collect(), 4)
    assert [(r[1], r[4]) for r in rows] == [(i, [i]) for i in np.argsort(training_order.permute(np.arange(2500), 2500, 3)).tolist()]
    assert len(training_order.manifest(f"{tmp_path}/s")["shards"]) == 2


def test_digests_are_those_of_the_tokens(spark, tmp_path):
    _, path = written(spark, tmp_path, IDS, 64, 50)
    a, b = training_order.read_slots(spark, path, 3, 300), training_order.read_slots(spark, path, 3, 300, digest=True)
    assert sorted((r["slot"], r["id"], r["seq"], r["n_tokens"], zlib.crc32(r["tokens"])) for r in a.collect()) == sorted(tuple(r) for r in b.collect())
    assert b.columns[-1] == "tokens_crc32" == training_order.read_slots(spark, path, 9, 9, digest=True).columns[-1]


def test_runs_are_gone_after_a_failure(spark, tmp_path):
    with pytest.raises(Exception, match="doesn't fit"):
        written(spark, tmp_path, [(1, [1] * 100), (2, [70_000])], 8, 4, width=2)
    assert os.listdir(f"{tmp_path}/shards") == []


# --- transport streams ------------------------------------------------------


def test_crc_is_the_published_one():
    assert ts.crc32_mpeg(b"123456789") == 0x0376E6E7


@settings(max_examples=80, deadline=None)
@given(st.integers(0, 900), st.integers(1, 400), st.integers(1, 5), st.integers(0, 255))
def test_streams_round_trip(size, unit, rap, start):
    payload = bytes((start + i * 7) % 256 for i in range(size))
    media = ts.write(payload, unit, rap)
    s = ts.parse(media)
    assert len(media) % ts.PACKET == 0 and not s.errors
    assert s.payload == payload
    n = max(1, -(-size // unit))
    assert s.stamps == [k * ts.TICKS for k in range(n)]
    assert s.random_access == list(range(0, n, rap))
    assert s.offsets == [k * unit for k in range(n)]
    assert s.clocks == [k * ts.TICKS * 300 for k in range(0, n, rap)]
    assert (s.program, s.stream_type, s.pid) == (1, ts.STREAM_TYPE, ts.ES_PID)


def packets(media):
    return [media[i : i + ts.PACKET] for i in range(0, len(media), ts.PACKET)]


def test_lost_repeated_and_broken_packets_are_noticed():
    payload = bytes(range(256)) * 20
    p = packets(ts.write(payload, 2048, 2))
    assert ts.parse(b"".join(p[:9] + p[8:])).payload == payload  # a packet may come twice
    lost = ts.parse(b"".join(p[:8] + p[9:]))
    assert lost.gaps == 1 and "continuity" in lost.errors
    pat = bytearray(p[0])
    pat[13] ^= 1
    assert "pat crc" in ts.parse(bytes(pat) + b"".join(p[1:])).errors
    pmt = bytearray(p[1])
    pmt[17] ^= 1
    assert ts.parse(p[0] + bytes(pmt) + b"".join(p[2:])).errors == ["pmt crc", "no stream"]
    bad = bytearray(b"".join(p))
    bad[ts.PACKET * 3] = 0
    assert ts.parse(bytes(bad)).errors == ["sync"]
    assert ts.parse(b"".join(p)[:-1]).errors == ts.parse(None).errors == ts.parse(b"").errors == ["length"]
    other = bytes([ts.SYNC, 0x1F, 0xFF, 0x10]) + b"\xff" * 184  # a null packet between
    assert ts.parse(b"".join([*p[:5], other, *p[5:]])).payload == payload


def section_packets(pid, section):
    """A section of any length in packets of one PID."""
    out, data = [], b"\0" + section
    for k in range(0, len(data), 184):
        out.append((bytes([ts.SYNC, (0 if k else 0x40) | pid >> 8, pid & 0xFF, 0x10 | k // 184]) + data[k : k + 184]).ljust(ts.PACKET, b"\xff"))
    return out


def elementary(payload, pid, unit):
    """The packets of ``write`` without tables, on another PID."""
    return [p[:1] + bytes([p[1] & 0xE0 | pid >> 8, pid & 0xFF]) + p[3:] for p in packets(ts.write(payload, unit, 1))[2:]]


def several_streams():
    """Two programs: one of two streams with a map of 400 bytes and more, one of a single stream."""
    two = lambda x: (0xE000 | x).to_bytes(2, "big")
    entry = lambda kind, pid, info=b"": bytes([kind]) + two(pid) + (0xF000 | len(info)).to_bytes(2, "big") + info
    pat = ts._section(0, 1, b"".join(n.to_bytes(2, "big") + two(pid) for n, pid in ((0, 0x10), (1, 0x1000), (2, 0x1001))))
    first = ts._section(2, 1, two(0x100) + b"\xf0\x00" + entry(0x1B, 0x100, b"d" * 250) + entry(0x0F, 0x101, b"e" * 150))
    second = ts._section(2, 2, two(0x200) + b"\xf0\x00" + entry(0x06, 0x200))
    payloads = {0x100: b"video" * 300, 0x101: b"sound" * 90, 0x200: b"other" * 200}
    bodies = [elementary(p, pid, 200) for pid, p in payloads.items()]
    mixed = [p for k in range(max(map(len, bodies))) for b in bodies for p in b[k : k + 1]]
    tables = [p for pid, sec in ((0, pat), (0x1000, first), (0x1001, second)) for p in section_packets(pid, sec)]
    return b"".join(tables + mixed), payloads


def test_all_programs_and_streams_are_read(spark):
    media, payloads = several_streams()
    got = ts.parse_all(media)
    assert [(s.program, s.stream_type, s.pid) for s in got] == [(1, 0x1B, 0x100), (1, 0x0F, 0x101), (2, 0x06, 0x200)]
    for s in got:
        assert (s.payload, s.errors) == (payloads[s.pid], [])
        assert s.random_access == list(range(-(-len(s.payload) // 200)))
    assert ts.parse(media).errors == ["2 more streams"]
    df = spark.createDataFrame([(1, 0, bytearray(media)), (2, 0, None)], "doc_id long, n_bytes long, media binary")
    rows = ts.probe(df).collect()
    assert {(r["doc_id"], r["pid"]): r["payload"] for r in rows} == {(1, pid): p for pid, p in payloads.items()} | {(2, -1): b""}


def test_a_lost_packet_of_a_long_map_is_told():
    media, _ = several_streams()
    p = packets(media)
    assert [s.errors for s in ts.parse_all(b"".join(p[:2] + p[3:]))][0] == ["pmt crc", "no stream"]


def test_features_tell_all_random_access_points_apart():
    a = ts.parse(ts.write(b"x" * 1000, 100, 1))
    b = ts.parse(ts.write(b"x" * 1000, 100, 1))
    b.stamps[7] += 1
    assert max(a.stamps) == max(b.stamps) and ts.features(a) != ts.features(b)


def test_media_columns_in_a_table(spark):
    df = spark.createDataFrame([(1, "abc", "x"), (2, None, "y"), (3, "é" * 40_000, "z"), (None, "", "w")], "doc_id long, text string, media string")
    stored = ts.store(df)
    got = {r["doc_id"]: r for r in ts.probe(stored).collect()}
    assert got[1]["payload"] == b"abc".ljust(64, b"\0") and got[2]["n_bytes"] == 0 and got[None]["n_bytes"] == 0
    assert got[3]["payload"] == ("é" * 40_000).encode() and got[3]["random_access"] == [0, 4] and len(got[3]["stamps"]) == 5
    assert all(r["errors"] == [] and r["gaps"] == 0 for r in got.values())
    broken = spark.createDataFrame([(1, 0, b"\x47"), (2, 0, None)], "doc_id long, n_bytes long, media binary")
    assert [r["errors"] for r in ts.probe(broken).collect()] == [["length"], ["length"]]
    assert ts.probe(stored.limit(0)).collect() == []


def test_media_query_equals_its_definition(spark, data):
    texts = {r["doc_id"]: r["text"] for r in spark.read.parquet(f"{data}/documents.parquet").collect()}
    rows = queries.op8_transport_stream(spark, data).collect()
    assert len(rows) == len(texts)
    by_text = {}
    for r in rows:
        raw = (texts[r["doc_id"]] or "").encode()
        size = max(64, -(-len(raw) // 64) * 64)
        whole = raw.ljust(size, b"\0")
        assert (r["n_bytes"], r["payload_bytes"]) == (len(raw), size)
        assert r["payload_sha256"] == hashlib.sha256(whole).hexdigest() and r["tail_crc32"] == zlib.crc32(whole[-64:])
        media = ts.write(whole)
        assert (r["media_bytes"], r["media_sha256"]) == (len(media), hashlib.sha256(media).hexdigest())
        assert by_text.setdefault(texts[r["doc_id"]], r["feature"]) == r["feature"]
    assert ts.summary(ts.store(spark.createDataFrame([], "doc_id long, text string"))).collect() == []
    broken = spark.createDataFrame([(1, 0, b"\x47"), (2, 0, None)], "doc_id long, n_bytes long, media binary")
    assert [(r["payload_bytes"], r["feature"].endswith("errors=length")) for r in ts.summary(broken).collect()] == [(0, True)] * 2
