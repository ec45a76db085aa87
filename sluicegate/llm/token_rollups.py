"""Token counts as delta-maintained rollups.

A batch is a set of signed rows (source, lang, tokenizer, docs, tokens): +1
for an inserted document, -1 for a deleted one, and -1 with the old and +1
with the new count for a revised one.  A batch is folded to its sums and
written as one folder named by its id; Spark's commit marker makes it visible.
Committing an id again changes nothing.  Totals are the sums over the last
compaction and the batches after it.

A compaction writes a new base with the list of the batches that it took in,
and then moves their folders to ``merged``; what broke off between the two is
finished by the next one.  So what is listed, read and held on the driver grows
with the batches since the last compaction, not with all there ever were.
"""

from __future__ import annotations

import re
import zlib

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from .common import WORD, slices
from .tokenizers import FOLDER, byte_bpe

KEYS = ["source", "lang", "tokenizer_version"]


def count_tokens(docs: DataFrame, vocabulary: str = "byte_bpe_50k.tiktoken", folder: str = FOLDER, keep: tuple[str, ...] = ("doc_id", "source", "lang"), text_col: str = "text") -> DataFrame:
    """The ``keep`` columns with n_words and n_tokens of each whole text (null text: 0)."""
    part = docs.select(*keep, F.coalesce(F.regexp_count(F.col(text_col), F.lit(WORD)), F.lit(0)).cast("long").alias("n_words"), F.col(text_col).alias("_text"))
    out = part.drop("_text").schema.add("n_tokens", "long")

    def run(batches):
        enc = byte_bpe(vocabulary, folder)
        for b in slices(batches):
            n = [len(enc.encode_ordinary(t)) if t else 0 for t in b.column(b.num_columns - 1).to_pylist()]
            yield pa.RecordBatch.from_arrays([*b.columns[:-1], pa.array(n, pa.int64())], names=out.names)

    return part.mapInArrow(run, out)


def _signed(counts: DataFrame, version: str, tokens: Column, sign: int) -> DataFrame:
    return counts.select("source", "lang", F.lit(version).alias("tokenizer_version"), F.lit(sign).cast("long").alias("n_docs"), (tokens * sign).cast("long").alias("n_tokens"))


def inserts(counts: DataFrame, version: str, tokens: str = "n_tokens") -> DataFrame:
    return _signed(counts, version, F.coalesce(F.col(tokens), F.lit(0)), 1)


def deletes(counts: DataFrame, version: str, tokens: str = "n_tokens") -> DataFrame:
    return _signed(counts, version, F.coalesce(F.col(tokens), F.lit(0)), -1)


def revisions(counts: DataFrame, old_version: str, old_tokens: str, new_version: str, new_tokens: str) -> DataFrame:
    """Each row's old count taken out and its new one put in."""
    return deletes(counts, old_version, old_tokens).union(inserts(counts, new_version, new_tokens))


class Rollup:
    """Totals in a folder that all nodes share.

    Null sources and languages are groups of their own.  One writer at a time
    per batch id; different ids may be committed at the same time.
    """

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")

    def _fs(self, path: str):
        p = self.spark._jvm.org.apache.hadoop.fs.Path(path)
        return p.getFileSystem(self.spark._jsc.hadoopConfiguration()), p

    def _done(self, folder: str) -> bool:
        fs, p = self._fs(f"{self.path}/{folder}/_SUCCESS")
        return fs.exists(p)

    def _folders(self, kind: str) -> list[str]:
        fs, p = self._fs(self.path)
        names = [s.getPath().getName() for s in fs.listStatus(p)] if fs.exists(p) else []
        return sorted(n for n in names if n.startswith(f"{kind}-") and self._done(n))

    @staticmethod
    def _merged(batch: str) -> str:
        return f"merged/{zlib.crc32(batch.encode()) % 256:02x}/{batch}"

    def commit(self, batch_id: str, deltas: DataFrame) -> bool:
        """Add a batch once; False if it was there already."""
        if not re.fullmatch(r"[A-Za-z0-9_.]+", batch_id):
            raise ValueError(f"bad batch id {batch_id!r}")
        name = f"batch-{batch_id}"
        if self._done(name) or self._done(self._merged(name)):
            return False
        sums = deltas.groupBy(*KEYS).agg(F.sum("n_docs").alias("n_docs"), F.sum("n_tokens").alias("n_tokens"))
        sums.coalesce(1).write.mode("overwrite").parquet(f"{self.path}/{name}")
        return True

    def _state(self) -> tuple[list[str], list[str], list[str]]:
        """(the base, if any; its batches that weren't moved yet; batches after it)."""
        bases = self._folders("base")[-1:]
        batches = self._folders("batch")
        inside = set()
        if bases and batches:  # the list is of one compaction's batches
            inside = {r["batch"] for r in self.spark.read.parquet(f"{self.path}/{bases[0].replace('base-', 'members-')}").collect()}
        return bases, [b for b in batches if b in inside], [b for b in batches if b not in inside]

    def _rows(self, folders: list[str]) -> DataFrame:
        return self.spark.read.parquet(*[f"{self.path}/{f}" for f in folders])

    def _move(self, batches: list[str]) -> None:
        for b in batches:
            fs, to = self._fs(f"{self.path}/{self._merged(b)}")
            fs.mkdirs(to.getParent())
            if not fs.rename(self._fs(f"{self.path}/{b}")[1], to):
                raise OSError(f"can't move {b}")

    def totals(self) -> DataFrame:
        """source, lang, tokenizer_version, n_docs, n_tokens; groups at zero are left out."""
        base, _, after = self._state()
        if not base + after:
            return self.spark.createDataFrame([], "source string, lang string, tokenizer_version string, n_docs long, n_tokens long")
        rows = self._rows(base + after)
        sums = rows.groupBy(*KEYS).agg(F.sum("n_docs").alias("n_docs"), F.sum("n_tokens").alias("n_tokens"))
        return sums.where("n_docs <> 0 or n_tokens <> 0")

    def compact(self) -> None:
        """Fold the batches since the last base into a new one; readers see the old or the new one."""
        base, inside, after = self._state()
        self._move(inside)
        if not after:
            return
        n = 1 + int(base[0].removeprefix("base-")) if base else 0
        self.spark.createDataFrame([(b,) for b in after], "batch string").coalesce(1).write.mode("overwrite").parquet(f"{self.path}/members-{n:08d}")
        sums = self._rows(base + after).groupBy(*KEYS).agg(F.sum("n_docs").alias("n_docs"), F.sum("n_tokens").alias("n_tokens"))
        sums.where("n_docs <> 0 or n_tokens <> 0").coalesce(1).write.mode("overwrite").parquet(f"{self.path}/base-{n:08d}")
        self._move(after)
        for kind in ("base", "members"):  # the last base stays for those who read it now
            fs, p = self._fs(f"{self.path}/{kind}-{n - 2:08d}")
            fs.delete(p, True)
