"""Training-order materialisation of token ids as fixed-stride shards.

Token ids are cut to sequences of at most ``seq_len``.  Each document owns as
many numbers as it can have sequences, which is known from its length before
it is encoded; a keyed Feistel permutation with cycle-walking spreads all these
numbers over their domain.  Ranges of permuted numbers, closed up where no sequence
took a number, give every sequence its global slot.  Each range is a raw file
of records of one length; record i of a file begins at i times the stride.  A
reader that stopped at a slot goes on by seeking.

Texts are encoded once.  Between the two stages the sequences lie in run files
beside the shards, cut into compressed pieces by range; Spark's shuffle moves
only where a range's pieces are, so no sequence passes through the executors'
heap.  The runs are deleted when the shards are written.
"""

from __future__ import annotations

from bisect import bisect_right
import json
import uuid
from collections.abc import Iterator
from itertools import groupby
import zlib

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import pyarrow.fs
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, functions as F

from .common import slices
from .tokenizers import FOLDER, byte_bpe

MANIFEST = "manifest.json"
CODEC = "zstd"
HEAD = 16  # int64 document id, int32 sequence number, int32 tokens
#: What a run's sequence has before its ids; the permuted number goes before the record's own head.
RUN = np.dtype([("slot", "<i8"), ("id", "<i8"), ("seq", "<i4"), ("n", "<i4")])
#: Bytes and sequences of a run that a worker holds, and bytes of records of a range that it puts in order at once.
RUN_BYTES, RUN_ROWS, RANGE_BYTES = 1 << 24, 1 << 16, 1 << 26


def _mix(x: np.ndarray, key: int) -> np.ndarray:
    x = x + np.uint64(key & 0xFFFFFFFFFFFFFFFF)
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def permute(numbers: np.ndarray, size: int, key: int, rounds: int = 6) -> np.ndarray:
    """A keyed permutation of 0..size-1, applied to ``numbers``."""
    half = max(1, (max(1, int(size - 1)).bit_length() + 1) // 2)
    low = np.uint64((1 << half) - 1)
    shift = np.uint64(half)
    out = np.asarray(numbers, dtype=np.uint64).copy()
    todo = np.arange(len(out))
    while len(todo):
        a, b = out[todo] >> shift, out[todo] & low
        for r in range(rounds):
            a, b = b, a ^ (_mix(b, key * 0x9E3779B97F4A7C15 + r * 0xD1342543DE82EF95) & low)
        out[todo] = (a << shift) | b
        todo = todo[out[todo] >= np.uint64(size)]
    return out.astype(np.int64)


def _place(path: str) -> tuple[pyarrow.fs.FileSystem, str]:
    """The file system of a folder's URI and the folder in it."""
    if path.startswith("file:"):
        path = "/" + path.removeprefix("file:").lstrip("/")
    return pyarrow.fs.FileSystem.from_uri(path) if "://" in path else (pyarrow.fs.LocalFileSystem(), path)


def _shares(x, n: int, total: int):
    """Which of ``n`` equal shares of 0..total-1 a number, or each of an array, is in."""
    return x * n // total if isinstance(x, int) else (x.astype(object) * n // total).astype(np.int64) if n * total >= 1 << 62 else x * n // total


def _read(fs: pyarrow.fs.FileSystem, name: str, at: int, n: int) -> bytes:
    with fs.open_input_file(name) as f:
        data = f.read_at(n, at)
    if len(data) != n:
        raise OSError(f"{name} ends before {at + n}")
    return data


def merged(fs: pyarrow.fs.FileSystem, pieces: list, seq_len: int, width: int, block: int = 4096) -> Iterator[bytes]:
    """The records of (run file, begin, bytes there, sequences, bytes) pieces by permuted number, ``block`` at a time.

    A piece is the heads of its sequences, then their ids, compressed.
    """
    every, begins, held = [], [], []
    for run, at, packed, n, size in pieces:
        held.append(memoryview(pa.decompress(_read(fs, run, at, packed), size, CODEC, asbytes=True)))
        every.append(np.frombuffer(held[-1], RUN, n))
        ends = n * RUN.itemsize + np.cumsum(every[-1]["n"].astype(np.int64) * width)
        begins.append(ends - every[-1]["n"].astype(np.int64) * width)
    piece, begin, every = np.repeat(np.arange(len(held)), [len(x) for x in every]), np.concatenate(begins), np.concatenate(every)
    order, pad = np.argsort(every["slot"]), bytes(seq_len * width)
    for a in range(0, len(order), block):
        own = order[a : a + block]
        head, out = every[["id", "seq", "n"]][own].astype([("id", "<i8"), ("seq", "<i4"), ("n", "<i4")]).tobytes(), []
        for k, (p, at, m) in enumerate(zip(piece[own].tolist(), begin[own].tolist(), (every["n"][own] * width).tolist())):
            out += (head[k * HEAD : (k + 1) * HEAD], held[p][at : at + m], pad[m:])
        yield b"".join(out)


def materialise(docs: DataFrame, path: str, key: int, seq_len: int, shard_rows: int = 65_536, width: int = 4, id_col: str = "doc_id", text_col: str = "text", ids_col: str | None = None, vocabulary: str = "byte_bpe_50k.tiktoken", folder: str = FOLDER) -> int:
    """Write the sequences of a table's token ids as shards below ``path``; returns their number.

    The ids are a byte-level vocabulary's for each whole text, or with
    ``ids_col`` that column's array<int>.  A record is the document's id (8
    bytes), the sequence's number in it (4), its number of ids (4), and
    ``seq_len`` ids of ``width`` bytes (2 or 4), the rest zeros; numbers are
    little-endian.  An id that ``width`` can't hold is an error.  Null and
    empty texts or arrays have no sequence; a null id is written as -1;
    repeated rows are sequences of their own; other columns are ignored.

    ``docs`` must be a table that is scanned with nothing but projections and
    filters, so that its partitions hold the same rows whenever they are
    computed; their rows' digests are compared.  Runs have names of the attempt's
    own, and only those of attempts that ended well are read; a shard is written
    under a name of the attempt's own and then renamed, so lost executors and
    repeated tasks leave whole shards only; the manifest comes last.  The driver
    holds a number for each partition and each shard.  A range has as many
    numbers as ``RANGE_BYTES`` have records, ``shard_rows`` at most, and is what
    a worker holds; the ranges of a shard are written one after the other.  What
    is shuffled is a row for each run's piece of each range, about 100 bytes;
    their number is that of the runs times that of the ranges, so it grows with
    the square of the table.
    """
    if width not in (2, 4):
        raise ValueError("an id has 2 or 4 bytes")
    spark = docs.sparkSession
    source = F.col(text_col) if ids_col is None else F.col(ids_col).cast("array<int>")
    size = F.octet_length("source") if ids_col is None else F.size("source")
    base = docs.select(F.coalesce(F.col(id_col).cast("long"), F.lit(-1)).alias("id"), source.alias("source")).where(F.col("source").isNotNull()).withColumn("most", F.ceil(size / seq_len).cast("long")).where("most > 0")
    told = base.select("most", F.spark_partition_id().alias("p"), F.hash("id", "most").cast("long").alias("h")).groupBy("p").agg(F.sum("most").alias("n"), F.sum("h").alias("h")).collect()
    offsets, total = {}, 0
    for r in sorted(told, key=lambda r: r["p"]):
        offsets[r["p"]] = (total, r["n"], r["h"])
        total += r["n"]
    shared = spark.sparkContext.broadcast(offsets)
    kind, top = ("<u2", 1 << 16) if width == 2 else ("<i4", 1 << 31)
    files = max(1, -(-total // shard_rows))
    split = -(-shard_rows // max(1, RANGE_BYTES // (seq_len * width)))  # ranges of a shard
    parts = min(files, 4 * int(spark.conf.get("spark.sql.shuffle.partitions", "200")))
    fs, where = _place(path)
    runs = f"{where}/.runs-{uuid.uuid4().hex}"
    fs.create_dir(runs, recursive=True)
    placed = pa.schema([("part", pa.int32()), ("range", pa.int64()), ("run", pa.string()), ("at", pa.int64()), ("packed", pa.int64()), ("n", pa.int64()), ("size", pa.int64())])

    def sequences(batches):
        enc = None if ids_col is not None else byte_bpe(vocabulary, folder)
        at, n, h = shared.value.get(TaskContext.get().partitionId(), (0, 0, 0))
        end = at + n
        numbers, own, no, sizes, raw = [], [], [], [], []
        name, held, out = uuid.uuid4().hex, 0, None

        def flush():
            nonlocal held, out
            if out is None:
                out = _place(path)[0].open_output_stream(f"{runs}/{name}", buffer_size=1 << 20)
            slots = permute(np.array(numbers), total, key)
            order = np.argsort(slots)
            head = np.empty(len(order), RUN)
            for field, x in (("slot", slots), ("id", own), ("seq", no), ("n", sizes)):
                head[field] = np.asarray(x)[order]
            of = _shares(head["slot"], files * split, total)
            cuts = [*np.flatnonzero(np.diff(of, prepend=-1)).tolist(), len(order)]
            places, order = [], order.tolist()
            for lo, hi in zip(cuts, cuts[1:]):
                piece = head[lo:hi].tobytes() + b"".join([raw[k] for k in order[lo:hi]])
                packed = pa.compress(piece, CODEC, asbytes=True)
                places.append((_shares(int(of[lo]) // split, parts, files), int(of[lo]), name, out.tell(), len(packed), hi - lo, len(piece)))
                out.write(packed)
            for x in (numbers, own, no, sizes, raw):
                x.clear()
            held = 0
            return pa.RecordBatch.from_arrays([pa.array(x, f.type) for x, f in zip(zip(*places), placed)], schema=placed)

        for b in slices(batches):
            h -= int(pc.sum(b.column(3)).as_py() or 0)
            for i, t, most in zip(*(b.column(c).to_pylist() for c in range(3))):
                ids = np.asarray(enc.encode_ordinary(t) if enc else t, dtype=np.int64)
                if ids.max() >= top or ids.min() < 0:
                    raise ValueError(f"an id doesn't fit into {width} bytes")
                data = ids.astype(kind).tobytes()
                for q, a in enumerate(range(0, len(data), seq_len * width)):
                    numbers.append(at + q)
                    own.append(i)
                    no.append(q)
                    raw.append(data[a : a + seq_len * width])
                    sizes.append(len(raw[-1]) // width)
                    held += len(raw[-1])
                    if held >= RUN_BYTES or len(raw) >= RUN_ROWS:
                        yield flush()
                at += most
        if at != end or h:
            raise RuntimeError("the table's partitions changed between two scans")
        if raw:
            yield flush()
        if out is not None:
            out.close()

    stride = HEAD + seq_len * width
    coded = base.withColumn("h", F.hash("id", "most").cast("long")).mapInArrow(sequences, "part int, range long, run string, at long, packed long, n long, size long")

    def shards(batches):
        fs, where = _place(path)
        pieces: dict[int, list] = {}
        for b in batches:
            for r, name, *piece in zip(*(b.column(c).to_pylist() for c in placed.names[1:])):
                pieces.setdefault(r, []).append((f"{runs}/{name}", *piece))
        done = []
        for r, own in groupby(sorted(pieces), lambda k: k // split):
            name = f"shard-{r:09d}.bin"
            mine, n = f"{where}/.{name}-{uuid.uuid4().hex}", 0
            with fs.open_output_stream(mine, buffer_size=1 << 20) as out:
                for k in own:
                    for block in merged(fs, pieces.pop(k), seq_len, width):
                        out.write(block)
                        n += len(block) // stride
            try:
                fs.move(mine, f"{where}/{name}")
            except OSError:  # another attempt was first; its shard is the same
                if fs.get_file_info(f"{where}/{name}").type != pyarrow.fs.FileType.File:
                    raise
                fs.delete_file(mine)
            done.append({"name": name, "no": r, "n": n})
        yield pa.RecordBatch.from_pylist(done, schema=pa.schema([("name", pa.string()), ("no", pa.int64()), ("n", pa.int64())]))

    try:
        written = sorted(coded.repartitionById(parts, F.col("part")).mapInArrow(shards, "name string, no long, n long").collect(), key=lambda r: r["no"])
    finally:
        if fs.get_file_info(runs).type == pyarrow.fs.FileType.Directory:
            fs.delete_dir(runs)
    firsts = [0]
    for r in written:
        firsts.append(firsts[-1] + r["n"])
    with fs.open_output_stream(f"{where}/{MANIFEST}") as f:
        f.write(json.dumps({"records": firsts[-1], "stride": stride, "seq_len": seq_len, "width": width, "shards": [r["name"] for r in written], "firsts": firsts}).encode())
    return firsts[-1]


_SLOTS = "slot long, id long, seq int, n_tokens int, tokens binary"


def _batch(slot, own, no, size, raw) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(slot, pa.int64()), pa.array(own, pa.int64()), pa.array(no, pa.int32()), pa.array(size, pa.int32()), pa.array(raw, pa.binary())], names=["slot", "id", "seq", "n_tokens", "tokens"])


def manifest(path: str) -> dict:
    fs, folder = _place(path)
    with fs.open_input_stream(f"{folder}/{MANIFEST}") as f:
        return json.loads(f.read())


def records(path: str, about: dict, start: int, stop: int, block: int = 512) -> Iterator[pa.RecordBatch]:
    """The records of the slots from ``start`` up to ``stop``, in order; nothing else of the files is read."""
    fs, folder = _place(path)
    stride, width, firsts = about["stride"], about["width"], about["firsts"]
    k = bisect_right(firsts, start) - 1
    while start < stop:
        hi = min(stop, firsts[k + 1])
        with fs.open_input_file(f"{folder}/{about['shards'][k]}") as f:
            for at in range(start, hi, block):
                n = min(block, hi - at)
                f.seek((at - firsts[k]) * stride)
                data = f.read(n * stride)
                cut = [data[i * stride : (i + 1) * stride] for i in range(n)]
                size = [int.from_bytes(r[12:16], "little") for r in cut]
                yield _batch(np.arange(at, at + n), [int.from_bytes(r[:8], "little", signed=True) for r in cut], [int.from_bytes(r[8:12], "little") for r in cut], size, [r[HEAD : HEAD + m * width] for r, m in zip(cut, size)])
        start, k = hi, k + 1


def read_slots(spark: SparkSession, path: str, start: int = 0, stop: int | None = None, digest: bool = False) -> DataFrame:
    """(slot, id, seq, n_tokens, tokens as bytes) of the slots from ``start`` up to ``stop``; a task reads a shard or a few.

    With ``digest`` the last column is tokens_crc32, as the worker that reads
    the bytes finds it, and the tokens themselves don't leave the worker.
    """
    about = manifest(path)
    stop = about["records"] if stop is None else min(stop, about["records"])
    kinds = _SLOTS.replace("tokens binary", "tokens_crc32 long") if digest else _SLOTS
    if start >= stop:
        return spark.createDataFrame([], kinds)
    firsts = about["firsts"]
    first, last = bisect_right(firsts, start) - 1, bisect_right(firsts, stop - 1)
    shared = spark.sparkContext.broadcast(about)

    def run(batches):
        for b in batches:
            for k in b.column(0).to_pylist():
                for found in records(path, shared.value, max(start, firsts[k]), min(stop, firsts[k + 1])):
                    crc = [zlib.crc32(t.as_buffer()) for t in found.column(4)] if digest else None
                    yield pa.RecordBatch.from_arrays([*found.columns[:4], pa.array(crc, pa.int64())], names=[*found.schema.names[:4], "tokens_crc32"]) if digest else found

    parts = max(1, min(last - first, 4 * int(spark.conf.get("spark.sql.shuffle.partitions", "200"))))
    return spark.range(first, last, 1, parts).mapInArrow(run, kinds)
