"""EDI segments without a grammar."""

from __future__ import annotations

import re

import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from ..schema import validate
from ..schema.errors import FatalError, SchemaError
from ..shipping import ship
from .readers import edi_segments, unescape

ELEMS = "array<struct<elem_index:int,comp_index:int,data:string>>"


def raw_segments(df: DataFrame, decl: dict, text: str = "text", name: str | None = None) -> DataFrame:
    """(input_name, seg_no, name, raw, elems) of the segments of each row's text.

    Without a release character all of it is native; with one, texts are split
    by the reader.  A segment without a name has a null name and nothing after
    it is read in the second case.
    """
    out: list[str] = []
    validate.check(decl, validate.RAW_EDI, "file_declaration", out)
    if out:
        raise SchemaError("; ".join(out))
    part = df.select((F.lit("") if name is None else F.col(name).cast("string")).alias("input_name"), F.col(text).alias("t"))
    if decl.get("release_character"):
        ship(df.sparkSession)
        return part.mapInArrow(_reader(decl), f"input_name string, seg_no int, name string, raw string, elems {ELEMS}")
    seg, elem = re.escape(decl["segment_delimiter"]), re.escape(decl["element_delimiter"])
    rep, comp = decl.get("repetition_delimiter"), decl.get("component_delimiter")
    t = F.translate("t", "\r\n", "") if decl.get("ignore_crlf") else F.col("t")
    tokens = F.split(t, seg, -1)
    if decl["segment_delimiter"] == "\n":
        tokens = F.transform(tokens, lambda x: F.regexp_replace(x, "\r$", ""))
    tokens = F.filter(tokens, lambda x: F.regexp_replace(x, "[\r\n]", "") != "")
    rows = part.select("input_name", F.posexplode(tokens).alias("k", "raw"))

    def components(v, i):
        if not comp:
            return F.array(F.struct(i.cast("int").alias("elem_index"), F.lit(1).alias("comp_index"), v.alias("data")))
        return F.transform(F.split(v, re.escape(comp), -1), lambda c, j: F.struct(i.cast("int").alias("elem_index"), (j + 1).cast("int").alias("comp_index"), c.alias("data")))

    def element(e, i):
        if not rep:
            return components(e, i)
        return F.flatten(F.transform(F.split(e, re.escape(rep), -1), lambda v: components(v, i)))

    elems = F.flatten(F.transform(F.split(F.regexp_replace("raw", "^[\r\n]+", ""), elem, -1), element))
    rows = rows.select("input_name", (F.col("k") + 1).cast("int").alias("seg_no"), "raw", elems.alias("elems"))
    return rows.select("input_name", "seg_no", F.nullif(F.element_at("elems", 1)["data"], F.lit("")).alias("name"), "raw", "elems")


def _reader(decl: dict):
    names = ["input_name", "seg_no", "name", "raw", "elems"]
    kind = pa.list_(pa.struct([("elem_index", pa.int32()), ("comp_index", pa.int32()), ("data", pa.string())]))

    def run(batches):
        esc = decl["release_character"]
        for b in batches:
            rows = []
            for n, t in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                try:
                    for no, _, _, name, raw, elems in edi_segments(t or "", decl):
                        rows.append((n, no, name, raw, [{"elem_index": i, "comp_index": j, "data": unescape(d, esc)} for i, j, d in elems]))
                except FatalError:
                    rows.append((n, (rows[-1][1] if rows else 0) + 1, None, None, None))
            cols = list(zip(*rows)) if rows else [[]] * 5
            yield pa.RecordBatch.from_arrays([pa.array(list(cols[0]), pa.string()), pa.array(list(cols[1]), pa.int32()), pa.array(list(cols[2]), pa.string()), pa.array(list(cols[3]), pa.string()), pa.array(list(cols[4]), kind)], names=names)

    return run
