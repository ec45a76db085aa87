"""Where records go: JSON lines, a JSON array in order, Parquet."""

from __future__ import annotations

from pyspark.sql import DataFrame


def write_json_lines(rows: DataFrame, path: str, mode: str = "error") -> None:
    """One compact JSON value per line; errors are left out."""
    rows.where("error is null").select("value").write.mode(mode).text(path)


def write_ordered(rows: DataFrame, path: str, mode: str = "error") -> None:
    """JSON lines in the order of inputs and records, range-sorted."""
    rows.where("error is null").orderBy("input_name", "rec_no").select("value").write.mode(mode).text(path)


def write_typed(typed: DataFrame, path: str, mode: str = "error") -> None:
    typed.write.mode(mode).parquet(path)


def json_array(rows: DataFrame):
    """The text of one JSON array, piece by piece, on the driver; stops at the first error."""
    first = True
    for r in rows.orderBy("input_name", "rec_no").toLocalIterator():
        if r["error"] is not None:
            raise RuntimeError(r["error"])
        yield ("[\n\t" if first else ",\n\t") + r["value"]
        first = False
    yield "[]" if first else "\n]"
