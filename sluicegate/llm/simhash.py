"""SimHash near-dedup with covering locality-sensitive hashing.

A fingerprint has 64 bits.  For a radius r, every bit position gets a nonzero
vector of r+1 bits; each nonzero vector v of r+1 bits makes a mask of the
positions whose vector has an odd inner product with v.  Any r differing
positions span at most r dimensions, so some v is orthogonal to all of them:
in that table the two fingerprints agree on all masked bits.  Thus every pair
within the radius collides in one of the 2**(r+1)-1 tables.

Within a bucket no pairs are listed.  Fingerprints that differ in two bits at
most share a word that is one flip away from each or equal to one, so each
member of a bucket of two or more emits itself with each free bit flipped, and
equal words link their few holders.  Work is linear in a bucket's size.

``near_duplicates`` links by differing bits.  ``similar_texts`` links by the
Jaccard similarity of the shingle sets: the covering tables and a few min-wise
tables propose, whole texts decide.  64 bits alone can't do that: texts of
similarity 0.8 differ in 4 to 15 bits, and so do many that share little.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window, functions as F

from .common import components, cut, slices


def shingle_hashes(text: str | None, words: int) -> np.ndarray:
    """XXH64 (seed 42) of each word shingle, repeats included."""
    w = (text or "").encode("utf-8", "surrogatepass").lower().split()
    if not w:
        return np.empty(0, dtype=np.uint64)
    h, told = xxhash.xxh64_intdigest, b" ".join(w)
    if len(w) <= words:
        return np.array([h(told, 42)], dtype=np.uint64)
    # a shingle is a slice of the words joined by single spaces
    gaps = np.flatnonzero(np.frombuffer(told, dtype=np.uint8) == 32)
    starts = [0, *(gaps + 1).tolist()]
    ends = [*gaps[words - 1 :].tolist(), len(told)]
    return np.array([h(told[a:b], 42) for a, b in zip(starts, ends)], dtype=np.uint64)


def fingerprint(hashes: np.ndarray) -> int:
    """The 64 majority bits; zero where there are no hashes."""
    n = len(hashes)
    if not n:
        return 0
    ones = np.zeros(64, dtype=np.int64)
    for i in range(0, n, 8192):
        part = np.ascontiguousarray(hashes[i : i + 8192].astype(">u8")).view(np.uint8).reshape(-1, 8)
        ones += np.unpackbits(part, axis=1).sum(axis=0, dtype=np.int64)
    return int.from_bytes(np.packbits(ones * 2 > n).tobytes(), "big")


def fingerprints(docs: DataFrame, words: int = 3, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, fp): the fingerprint of each whole text as a signed 64-bit number."""

    def run(batches):
        for b in slices(batches):
            fps = np.fromiter((fingerprint(shingle_hashes(t, words)) for t in b.column(1).to_pylist()), np.uint64, b.num_rows)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(fps.view(np.int64))], names=["id", "fp"])

    return docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text")).mapInArrow(run, "id long, fp long")


def masks(radius: int) -> list[int]:
    """The 2**(radius+1)-1 masks of 64 bits, as unsigned numbers."""
    top = 1 << (radius + 1)
    own = [1 + i % (top - 1) for i in range(64)]
    return [sum(1 << i for i in range(64) if (own[i] & v).bit_count() % 2) for v in range(1, top)]


def signed(x: int) -> int:
    return x - (1 << 64) if x >= 1 << 63 else x


def links(fps: DataFrame, radius: int = 2) -> DataFrame:
    """(a, b): links that connect all distinct fingerprints at ``radius`` or fewer differing bits.

    ``fps`` has the bigint column ``fp``.  The links' closure is that of all
    such pairs; a pair that others connect may be left out.  radius: 1 or 2.
    """
    if radius not in (1, 2):
        raise ValueError("radius must be 1 or 2")
    table = masks(radius)
    keyed = F.array(*[F.struct(F.lit(t).alias("t"), F.col("fp").bitwiseAND(F.lit(signed(m))).alias("key")) for t, m in enumerate(table)])
    rows = fps.select("fp").distinct().select("fp", F.explode(keyed).alias("k")).select("fp", "k.t", "k.key")
    crowded = rows.groupBy("t", "key").count().where("count > 1").select("t", "key")
    flips = F.array(*[F.array(F.lit(0).cast("long"), *[F.lit(signed(1 << i)) for i in range(64) if not m >> i & 1]) for m in table])
    words = rows.join(crowded, ["t", "key"]).select("fp", F.explode(F.element_at(flips, F.col("t") + 1)).alias("flip")).select("fp", F.col("fp").bitwiseXOR(F.col("flip")).alias("word")).distinct()
    shared = words.groupBy("word").agg(F.collect_set("fp").alias("own")).where(F.size("own") > 1)  # 65 holders at most
    if radius == 1:
        pairs = shared.select("word", F.explode("own").alias("b")).where("word <> b").select(F.col("word").alias("a"), "b")
        return pairs.join(fps.select(F.col("fp").alias("a")).distinct(), "a", "left_semi").select("a", "b").distinct()
    return shared.select(F.array_min("own").alias("a"), F.explode("own").alias("b")).where("a <> b").distinct()


def near_duplicates(docs: DataFrame, words: int = 3, radius: int = 2, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: id, fingerprint (16 hex digits), component_id, copies, kept.

    component_id is the smallest id reachable by links, itself included.  A
    null or wordless text has fingerprint zero and is linked like any other.
    A row with a null id gets its fingerprint and a null component.  Each row
    of a repeated id gets its own text's component; texts whose smallest id is
    the same one are joined.  Further columns are ignored.
    """
    fps = cut(fingerprints(docs, words, id_col, text_col))
    groups = fps.groupBy("fp").agg(F.min("id").alias("rep"), F.count("*").alias("copies"))
    groups = cut(groups)
    named = groups.where("rep is not null")
    found = links(named, radius)
    edges = found.join(named.select(F.col("fp").alias("a"), F.col("rep").alias("ra")), "a").join(named.select(F.col("fp").alias("b"), F.col("rep").alias("rb")), "b")
    roots = components(edges, "ra", "rb")
    whole = groups.join(roots.withColumnRenamed("node", "rep"), "rep", "left").select("fp", "copies", F.coalesce("root", "rep").alias("component_id"))
    return fps.join(whole, "fp").select(
        F.col("id").alias(id_col),
        F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"),
        F.when(F.col("id").isNotNull(), F.col("component_id")).alias("component_id"),
        "copies",
        (F.col("id") == F.col("component_id")).alias("kept"),
    )


#: Min-wise tables of two shingles each: a pair at similarity 0.8 misses all with probability 0.0009.
BANDS, BAND_ROWS = 7, 2
BLOCK = 512


def band_keys(hashes: np.ndarray) -> np.ndarray:
    """A key for each min-wise table, from the smallest shingle under each of its permutations."""
    least = np.empty(BANDS * BAND_ROWS, dtype=np.uint64)
    for i in range(len(least)):
        x = (hashes ^ np.uint64(0x9E3779B97F4A7C15 * (i + 1) & 0xFFFFFFFFFFFFFFFF)) * np.uint64(0xD6E8FEB86659FD93)
        least[i] = (x ^ (x >> np.uint64(32))).min()
    pairs = least.reshape(BANDS, BAND_ROWS)
    return (pairs[:, 0] * np.uint64(0xC2B2AE3D27D4EB4F)) ^ pairs[:, 1]


def sketches(texts: DataFrame, words: int) -> DataFrame:
    """(k, fp, bands) of (k, text); a text without words has no bands."""

    def run(batches):
        for b in slices(batches):
            fps, bands = [], []
            for t in b.column(1).to_pylist():
                h = shingle_hashes(t, words)
                fps.append(fingerprint(h))
                bands.append(band_keys(h).view(np.int64).tolist() if len(h) else [])
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(np.array(fps, dtype=np.uint64).view(np.int64)), pa.array(bands, pa.list_(pa.int64()))], names=["k", "fp", "bands"])

    return texts.mapInArrow(run, "k string, fp long, bands array<bigint>")


def similar_pairs(sets: list[np.ndarray], similarity: float, columns: int = 4096) -> tuple[np.ndarray, np.ndarray]:
    """(u, v), u < v, of the sets whose Jaccard similarity is high enough, by exact counts."""
    n = len(sets)
    if n < 2:
        return np.empty(0, int), np.empty(0, int)
    sizes = np.array([len(s) for s in sets], dtype=np.int64)
    owner, x = np.repeat(np.arange(n), sizes), np.concatenate(sets)
    _, place, times = np.unique(x, return_inverse=True, return_counts=True)
    number = np.cumsum(times > 1) - 1
    shared = times[place] > 1  # what only one set has is in no intersection
    owner, place = owner[shared], number[place[shared]]
    order = np.argsort(place, kind="stable")
    owner, place = owner[order], place[order]
    common = np.zeros((n, n), dtype=np.float32)
    for at in range(0, int(place[-1]) + 1 if len(place) else 0, columns):
        lo, hi = np.searchsorted(place, [at, at + columns])
        part = np.zeros((n, columns), dtype=np.float32)
        part[owner[lo:hi], place[lo:hi] - at] = 1
        common += part @ part.T
    u, v = np.nonzero(np.triu(common, 1))
    both = common[u, v].astype(np.int64)
    near = both >= similarity * (sizes[u] + sizes[v] - both) - 1e-9
    return u[near], v[near]


def _similar_digests(rows: DataFrame, words: int, similarity: float) -> DataFrame:
    """(a, b): links between the digests k of similar texts, of rows (k, text); checkpointed.

    Equal texts are folded first; of buckets that hold the same texts one is
    looked into.  A bucket's texts are compared within a task, chunk by chunk
    where it has more than a block of them, and only the links that span its
    components leave the task.
    """
    drawn = cut(sketches(rows.select("k", "text"), words))
    one = drawn.groupBy("k").agg(F.first("fp").alias("fp"), F.first("bands").alias("bands"))
    covering = [F.struct(F.lit(t).alias("t"), F.col("fp").bitwiseAND(F.lit(signed(m))).alias("key")) for t, m in enumerate(masks(2))]
    minwise = F.transform("bands", lambda x, i: F.struct((i + len(covering)).cast("int").alias("t"), x.alias("key")))
    tables = one.select("k", F.explode(F.concat(F.array(*covering), minwise)).alias("b")).select("k", "b.t", "b.key")
    sizes = tables.groupBy("t", "key").agg(F.count("*").alias("n"), F.bit_xor(F.xxhash64("k")).alias("x"), F.sum(F.hash("k").cast("long")).alias("y")).where("n > 1")
    sizes = sizes.groupBy("n", "x", "y").agg(F.min(F.struct("t", "key")).alias("b")).select("b.t", "b.key", F.ceil(F.col("n") / BLOCK).cast("int").alias("chunks"))
    members = cut(tables.join(sizes, ["t", "key"]))
    needed = members.select("k").distinct()
    texts = rows.join(needed, "k", "left_semi").groupBy("k").agg(F.first("text").alias("text"))
    chunk = F.pmod(F.xxhash64("k"), F.col("chunks")).cast("int")
    blocks = (
        members.withColumn("chunk", chunk)
        .withColumn("other", F.explode(F.sequence(F.lit(0), F.col("chunks") - 1)))
        .select("t", "key", F.least("chunk", "other").alias("i"), F.greatest("chunk", "other").alias("j"), "k")
        .join(texts, "k")
    )
    keys = ["t", "key", "i", "j"]

    def compare(batches):
        at, names, sets, out = None, [], [], []

        def close():
            u, v = similar_pairs(sets, similarity)
            roots = spanning(len(sets), u, v)
            out.extend((names[i], names[r]) for i, r in enumerate(roots.tolist()) if i != r)
            names.clear()
            sets.clear()

        def told():
            a, b = zip(*out) if out else ([], [])
            out.clear()
            return pa.RecordBatch.from_arrays([pa.array(a, pa.string()), pa.array(b, pa.string())], names=["a", "b"])

        for batch in slices(batches):
            for *key, k, text in zip(*(c.to_pylist() for c in batch.columns)):
                if key != at:
                    close()
                    at = key
                h = np.unique(shingle_hashes(text, words))
                names.append(k)
                sets.append(h if len(h) else np.zeros(1, np.uint64))
            yield told()
        close()
        yield told()

    sorted_blocks = blocks.select(*keys, "k", "text").repartition(*keys).sortWithinPartitions(*keys, "k")
    return cut(sorted_blocks.mapInArrow(compare, "a string, b string").distinct())


def similar_texts(docs: DataFrame, words: int = 5, similarity: float = 0.8, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: id, component_id, kept.  Links are shingle sets of enough similarity.

    component_id is the smallest id reachable by links, itself included.
    Null texts and those without words are all alike.  A row with a null id
    has a null component and ``kept``.  Repeated ids are as in
    ``near_duplicates``.  Further columns are ignored.
    """
    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.coalesce(F.col(text_col), F.lit("")).alias("text")).withColumn("k", F.md5("text"))
    found = _similar_digests(rows.where("id is not null").select("k", "text"), words, similarity)
    named = cut(rows.where("id is not null").groupBy("k").agg(F.min("id").alias("rep")))
    edges = found.join(named.toDF("a", "ra"), "a").join(named.toDF("b", "rb"), "b")
    roots = components(edges, "ra", "rb")
    whole = named.join(roots.withColumnRenamed("node", "rep"), "rep", "left").select("k", F.coalesce("root", "rep").alias("component_id"))
    out = rows.select("id", "k").join(whole, "k", "left").select("id", F.when(F.col("id").isNotNull(), F.col("component_id")).alias("component_id"))
    return out.select(F.col("id").alias(id_col), "component_id", (F.col("id") == F.col("component_id")).alias("kept"))


def keep_one(docs: DataFrame, words: int = 5, similarity: float = 0.8, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of ``docs`` that are the first of their group of similar texts.

    Groups are of texts, not of ids: two unlike texts of one id stay apart.
    The first row has the smallest id, null ids last, then the smallest digest
    of the text; of rows equal in both, one stays.  Links are as in
    ``similar_texts``; all columns are kept.
    """
    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.coalesce(F.col(text_col), F.lit("")).alias("text")).withColumn("k", F.md5("text"))
    found = _similar_digests(rows.select("k", "text"), words, similarity)
    # numbers are fixed by the checkpoint
    nodes = cut(found.select(F.col("a").alias("k")).union(found.select("b")).distinct().withColumn("node", F.monotonically_increasing_id()))
    edges = found.join(nodes.toDF("a", "na"), "a").join(nodes.toDF("b", "nb"), "b")
    roots = components(edges, "na", "nb")
    group = nodes.join(roots, "node", "left").select("k", F.coalesce("root", "node").alias("root"))
    copies = rows.groupBy("id", "k").agg(F.count("*").alias("n")).join(group, "k", "left")
    copies = cut(copies.select(F.struct(F.col("id").isNull().alias("last"), "id", "k").alias("row"), "n", F.coalesce(F.col("root").cast("string"), F.col("k")).alias("g")))
    first = copies.groupBy("g").agg(F.min("row").alias("first"))
    named = lambda x: x.select(F.col("row.id").alias("_id"), F.col("row.k").alias("_k"))
    gone = named(copies.join(first, "g").where("row <> first"))
    own = docs.select(F.struct(*docs.columns).alias("row"))
    same = F.col(f"row.{id_col}").cast("long").eqNullSafe(F.col("_id")) & (F.md5(F.coalesce(F.col(f"row.{text_col}"), F.lit(""))) == F.col("_k"))
    left = own.join(gone, same, "left_anti")
    twice = named(copies.where("n > 1"))
    if not twice.isEmpty():
        order = Window.partitionBy("_id", "_k").orderBy(F.xxhash64("row"))
        repeated = left.join(twice, same).withColumn("no", F.row_number().over(order)).where("no = 1").select("row")
        left = left.join(twice, same, "left_anti").union(repeated)
    return left.select("row.*")


def spanning(n: int, u: np.ndarray, v: np.ndarray) -> np.ndarray:
    """The smallest member of each one's component."""
    root = np.arange(n)
    while len(u):
        low = np.minimum(root[u], root[v])
        new = root.copy()
        for x in (u, v, root[u], root[v]):
            np.minimum.at(new, x, low)
        new = new[new]
        if (new == root).all():
            break
        root = new
    return root
