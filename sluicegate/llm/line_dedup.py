"""Line dedup over overlapping windows of three lines.

Native: DataFrame functions only.  Every window of three consecutive lines is
hashed to 96 bits.  A window that occurs more than once keeps its first
occurrence, by id and position; the lines of all later ones are covered, and
covered lines are removed.  Where a later occurrence overlaps the first one in
the same text, only the lines beyond the first are covered.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from .common import cut

LINES = 3


def _windows(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(id, th, pos, w1, w2) of all windows that aren't blank; th tells texts of equal id apart."""
    lines = F.split(F.col(text_col), "\n")
    rows = docs.select(F.col(id_col).alias("id"), F.xxhash64(text_col).alias("th"), lines.alias("lines")).where(F.size("lines") >= LINES)
    rows = rows.select("id", "th", F.transform("lines", lambda x: F.struct(F.xxhash64(x).alias("a"), F.hash(x).alias("b"), (F.trim(x) == "").alias("blank"))).alias("h"))
    at = lambda i, k: F.element_at("h", i + k)
    windows = F.transform(
        F.sequence(F.lit(1), F.size("h") - 2),
        lambda i: F.struct(
            i.alias("pos"),
            F.xxhash64(at(i, 0)["a"], at(i, 1)["a"], at(i, 2)["a"]).alias("w1"),
            F.hash(at(i, 0)["b"], at(i, 1)["b"], at(i, 2)["b"]).alias("w2"),
            (at(i, 0)["blank"] & at(i, 1)["blank"] & at(i, 2)["blank"]).alias("blank"),
        ),
    )
    return rows.select("id", "th", F.explode(windows).alias("w")).where("not w.blank").select("id", "th", "w.pos", "w.w1", "w.w2")


def covered(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, th, lines): the sorted positions (from 1) that later occurrences cover."""
    windows = cut(_windows(docs, id_col, text_col))
    first = windows.groupBy("w1", "w2").agg(F.min(F.struct("id", "th", "pos")).alias("first"), F.count("*").alias("n")).where("n > 1").drop("n")
    joined = windows.join(first, ["w1", "w2"])
    same_text = F.col("id").eqNullSafe(F.col("first.id")) & (F.col("th") == F.col("first.th"))
    start = F.when(same_text, F.greatest(F.col("pos"), F.col("first.pos") + LINES)).otherwise(F.col("pos"))
    # positions, not pairs: a hot window's rows meet one row each
    later = joined.where(~(same_text & (F.col("pos") == F.col("first.pos")))).select("id", "th", start.alias("start"), (F.col("pos") + LINES - 1).alias("end")).where("start <= end")
    return later.select("id", "th", F.explode(F.sequence("start", "end")).alias("line")).groupBy("id", "th").agg(F.array_sort(F.collect_set("line")).alias("lines"))


def dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", count_col: str | None = None) -> DataFrame:
    """``docs`` with the text less its covered lines, and the columns _n_lines and _n_removed.

    A null text stays null with no lines.  Texts of fewer than three lines
    stay as they are.  Null ids come first and are told apart by their text;
    rows of equal id and text are one document and all keep what it keeps.
    ``count_col`` names a column to set to the new text's length.  Columns that
    are named like the two new ones are replaced; all others are kept.
    """
    cover = covered(docs, id_col, text_col)
    own = [c for c in docs.columns if c not in ("_n_lines", "_n_removed")]
    rows = docs.select(F.struct(*own).alias("row"))
    text = F.col(f"row.{text_col}")
    d = rows.join(cover, F.col(f"row.{id_col}").eqNullSafe(F.col("id")) & (F.xxhash64(text) == F.col("th")), "left").select("row", F.col("lines").alias("gone"))
    lines = F.split(text, "\n")
    left = F.transform(F.array_except(F.sequence(F.lit(1), F.size(lines)), F.col("gone")), lambda i: F.element_at(lines, i))
    hit = F.col("gone").isNotNull()
    n_lines = F.when(text.isNull(), 0).otherwise(F.size(lines)).cast("long")
    d = d.select("row", F.when(hit, F.array_join(left, "\n")).otherwise(text).alias("new"), n_lines.alias("_n_lines"), F.when(hit, F.size("gone")).otherwise(0).cast("long").alias("_n_removed"))
    kind = dict(docs.dtypes)
    cols = [F.col("new").alias(c) if c == text_col else F.length("new").cast(kind[c]).alias(c) if c == count_col else F.col(f"row.{c}") for c in own]
    return d.select(*cols, "_n_lines", "_n_removed")


ORACLE = """
WITH lines AS (
  SELECT doc_id, text, string_split(text, chr(10)) AS l FROM documents WHERE text IS NOT NULL
), wins AS (
  SELECT doc_id, text, unnest(range(1, len(l) - 1)) AS pos, l FROM lines WHERE len(l) >= 3
), keyed AS (
  SELECT doc_id, text, pos, l[pos] || chr(10) || l[pos + 1] || chr(10) || l[pos + 2] AS k FROM wins
), ranked AS (
  SELECT doc_id, pos, k,
         first_value(doc_id) OVER w AS fd, first_value(pos) OVER w AS fp
  FROM keyed WHERE trim(replace(k, chr(10), ' ')) <> ''
  WINDOW w AS (PARTITION BY k ORDER BY doc_id, pos ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING)
), cover AS (
  SELECT DISTINCT doc_id, unnest(range(CASE WHEN doc_id = fd THEN greatest(pos, fp + 3) ELSE pos END, pos + 3)) AS ln
  FROM ranked WHERE NOT (doc_id = fd AND pos = fp)
), kept AS (
  SELECT a.doc_id, a.i, a.line FROM
    (SELECT doc_id, unnest(range(1, len(l) + 1)) AS i, unnest(l) AS line FROM lines) a
  LEFT JOIN cover c ON a.doc_id = c.doc_id AND a.i = c.ln WHERE c.ln IS NULL
), joined AS (
  SELECT doc_id, string_agg(line, chr(10) ORDER BY i) AS t, count(*) AS n FROM kept GROUP BY doc_id
)
SELECT d.doc_id, CASE WHEN d.text IS NULL THEN 0 ELSE len(string_split(d.text, chr(10))) END::BIGINT AS n_lines,
       CASE WHEN d.text IS NULL THEN 0 ELSE len(string_split(d.text, chr(10))) - coalesce(j.n, 0) END::BIGINT AS n_removed,
       CASE WHEN d.text IS NULL THEN NULL ELSE md5(coalesce(j.t, '')) END AS text_md5
FROM documents d LEFT JOIN joined j ON d.doc_id = j.doc_id
"""
