"""SentencePiece encoding and decoding.

``encode`` gives the library's ids for any model, in Arrow batches.

``lattice_encode`` is the relational form for unigram piece tables: words are
exploded to substrings of bounded length, equi-joined to the piece table, the
edges are grouped by word, and a higher-order aggregate folds Viterbi over
them.  A model of merges (BPE) has no such optimum: its scores are ranks, and
the best-scored path differs from what its merges give for many words, so for
these ``encode`` must be used.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from .common import slices
from .tokenizers import FOLDER, pieces


def encode(docs: DataFrame, model: str = "piece_bpe_32k.model", folder: str = FOLDER, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, ids array<int>, round_trip): null and empty texts have no ids."""
    part = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    kind = part.schema[0].dataType.simpleString()

    def run(batches):
        enc = pieces(model, folder)
        for b in slices(batches):
            texts = b.column(1).to_pylist()
            got = [enc.encode(t) for t in texts]
            same = [enc.decode(g) == (t or "") for g, t in zip(got, texts)]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(got, pa.list_(pa.int32())), pa.array(same, pa.bool_())], names=["id", "ids", "round_trip"])

    return part.mapInArrow(run, f"id {kind}, ids array<int>, round_trip boolean").withColumnRenamed("id", id_col)


def decode(encoded: DataFrame, model: str = "piece_bpe_32k.model", folder: str = FOLDER, id_col: str = "doc_id", ids_col: str = "ids") -> DataFrame:
    """(id, text) from (id, ids); null ids give a null text."""
    part = encoded.select(F.col(id_col).alias("id"), F.col(ids_col).alias("ids"))
    kind = part.schema[0].dataType.simpleString()

    def run(batches):
        enc = pieces(model, folder)
        for b in slices(batches):
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([None if i is None else enc.decode(i) for i in b.column(1).to_pylist()], pa.string())], names=["id", "text"])

    return part.mapInArrow(run, f"id {kind}, text string").withColumnRenamed("id", id_col)


def digests(docs: DataFrame, model: str = "piece_bpe_32k.model", folder: str = FOLDER, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, n_tokens, ids_sha256 of the ids as little-endian 32-bit numbers, round_trip)."""
    part = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    kind = part.schema[0].dataType.simpleString()

    def run(batches):
        enc = pieces(model, folder)
        for b in slices(batches):
            n, sha, same = [], [], []
            for t in b.column(1).to_pylist():
                ids = enc.encode(t)
                n.append(len(ids))
                sha.append(hashlib.sha256(np.array(ids, dtype="<i4").tobytes()).hexdigest())
                same.append(enc.decode(ids) == (t or ""))
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(n, pa.int64()), pa.array(sha, pa.string()), pa.array(same, pa.bool_())], names=["id", "n_tokens", "ids_sha256", "round_trip"])

    return part.mapInArrow(run, f"id {kind}, n_tokens long, ids_sha256 string, round_trip boolean").withColumnRenamed("id", id_col)


def lattice_encode(words: DataFrame, table: DataFrame, max_piece: int, word_col: str = "word", unknown_id: int = 0, unknown_penalty: float = 10.0, max_run: int = 256) -> DataFrame:
    """(word, ids) of distinct non-empty words under a unigram table (piece, id, score).

    Every character is also an edge to ``unknown_id`` at the worst score less
    the penalty.  Among equal scores the path whose last pieces are longer
    wins.  A word of more than ``max_run`` characters is cut to runs of so many,
    and no piece spans two runs, so the work is linear in a word's length.
    Null and empty words have no row, repeated ones a single one.  The table of
    pieces is broadcast; a vocabulary bounds it.
    """
    w = words.select(F.col(word_col).alias("word")).where("length(word) > 0").distinct()
    worst = F.coalesce(F.lit(table.agg(F.min("score")).first()[0]), F.lit(0.0)) - unknown_penalty
    cut_at = F.sequence(F.lit(1), F.length("word"), F.lit(max_run))
    runs = w.select("word", F.posexplode(F.transform(cut_at, lambda a: F.substring(F.col("word"), a, F.lit(max_run)))).alias("run", "part"))
    starts = runs.select("word", "run", "part", F.explode(F.sequence(F.lit(1), F.length("part"))).alias("s"))
    spans = starts.select("word", "run", "s", "part", F.explode(F.sequence(F.lit(1), F.least(F.lit(max_piece), F.length("part") - F.col("s") + 1))).alias("n"))
    subs = spans.select("word", "run", "s", (F.col("s") + F.col("n")).alias("e"), F.substring(F.col("part"), F.col("s"), F.col("n")).alias("piece"))
    pieces_ = table.select("piece", F.col("id").cast("int").alias("id"), F.col("score").cast("double").alias("score"))
    known = subs.join(F.broadcast(pieces_), "piece").select("word", "run", "s", "e", "id", "score")
    single = starts.select("word", "run", "s", (F.col("s") + 1).alias("e"), F.lit(unknown_id).cast("int").alias("id"), worst.cast("double").alias("score"))
    # of the edges into a place the fold needs those of its last max_piece places only
    into = known.union(single).groupBy("word", "run", "e").agg(F.collect_list(F.struct("s", "score", "id")).alias("edges"))
    lattice = into.groupBy("word", "run").agg(F.array_sort(F.collect_list(F.struct("e", "edges"))).alias("places"))
    init = F.struct(F.array(F.lit(0.0).cast("double")).alias("last"), F.array().cast("array<struct<s:int,id:int>>").alias("back"))

    def step(state, place):
        last = state["last"]
        # place e has its predecessors e-1, e-2, ... at the end of ``last``
        score = lambda x: F.element_at(last, (x["s"] - place["e"]).cast("int")) + x["score"]
        best = F.array_max(F.transform(place["edges"], lambda x: F.struct(score(x).alias("score"), (-x["s"]).alias("s"), x["id"].alias("id"))))
        kept = F.slice(last, -F.least(F.size(last), F.lit(max_piece - 1)), F.lit(max_piece)) if max_piece > 1 else F.array().cast("array<double>")
        return F.struct(F.concat(kept, F.array(best["score"])).alias("last"), F.concat(state["back"], F.array(F.struct((-best["s"]).alias("s"), best["id"].alias("id")))).alias("back"))

    def walk(state, k):
        here = F.element_at(F.col("back"), k)
        return F.when(k == state["at"], F.struct((here["s"] - 1).alias("at"), F.concat(state["ids"], F.array(here["id"])).alias("ids"))).otherwise(state)

    folded = lattice.select("word", "run", F.aggregate("places", init, step)["back"].alias("back"))
    end = F.struct(F.size("back").alias("at"), F.array().cast("array<int>").alias("ids"))
    ids = F.reverse(F.aggregate(F.sequence(F.size("back"), F.lit(1), F.lit(-1)), end, walk)["ids"])
    parts = folded.select("word", "run", ids.alias("ids")).groupBy("word").agg(F.array_sort(F.collect_list(F.struct("run", "ids"))).alias("runs"))
    return parts.select("word", F.flatten(F.transform("runs", lambda r: r["ids"])).alias("ids"))


def piece_table(spark, model: str = "piece_bpe_32k.model", folder: str = FOLDER) -> DataFrame:
    """(piece, id, score) of a model's ordinary pieces; the space mark is as in the model."""
    sp = pieces(model, folder).sp
    rows = [(sp.id_to_piece(i), i, float(sp.get_score(i))) for i in range(sp.get_piece_size()) if not (sp.is_byte(i) or sp.is_control(i) or sp.is_unknown(i) or sp.is_unused(i))]
    return spark.createDataFrame(rows, "piece string, id int, score double")
