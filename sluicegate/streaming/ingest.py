"""Ingestion from streams.

Files or rows that are whole inputs need no state: a plan's front doors take
streaming DataFrames as they are.  An endless stream of lines whose records
span several lines keeps the open record of each input in state.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from ..plans.engine import Plan
from ..shipping import ship


def stream_files(plan: Plan, path: str) -> DataFrame:
    """JSON records of the files that arrive in a folder."""
    files = plan.spark.readStream.format("binaryFile").schema("path string, modificationTime timestamp, length long, content binary").load(path)
    return plan.transform_bytes(files, "content", "path")


class Framer:
    """Cuts lines to records: by number of lines, or from a header to a footer."""

    def __init__(self, rows: int | None = None, header: str | None = None, footer: str | None = None):
        if (rows is None) == (header is None):
            raise ValueError("give either rows or header")
        self.rows, self.header, self.footer = rows, header, footer

    def feed(self, open_: list[str], lines: list[str]) -> tuple[list[str], list[str]]:
        """(complete records, lines still open); lines outside of any record are skipped."""
        head = re.compile(self.header) if self.header else None
        foot = re.compile(self.footer) if self.footer else None
        out, now = [], list(open_)
        for line in lines:
            line = line.removesuffix("\r")
            if not line:
                continue
            if head is not None and not now and not head.search(line):
                continue
            now.append(line)
            if len(now) >= self.rows if self.rows else foot is None or foot.search(line):
                out.append("\n".join(now))
                now = []
        return out, now


def frame_lines(lines: DataFrame, framer: Framer, name: str = "input_name", order: str = "line_no", line: str = "line") -> DataFrame:
    """(input_name, text): complete records of a stream of lines, with the open one in state.

    Lines of one input that arrive in one batch are put in ``order``; batches
    must come in order.  The state of an input is its open record only.
    """
    ship(lines.sparkSession)

    def step(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        open_ = list(state.get[0]) if state.exists else []
        pdf = pd.concat(list(batches)).sort_values(order, kind="stable")
        out, open_ = framer.feed(open_, pdf[line].tolist())
        state.update((open_,))
        yield pd.DataFrame({"input_name": [key[0]] * len(out), "text": out})

    part = lines.select(name, order, line)
    return part.groupBy(name).applyInPandasWithState(step, "input_name string, text string", "open array<string>", "append", GroupStateTimeout.NoTimeout)


def transform_stream(plan: Plan, lines: DataFrame, framer: Framer, **columns: str) -> DataFrame:
    """JSON records of a stream of lines; each framed record is an input of its own."""
    return plan.rows(frame_lines(lines, framer, **columns), "text", "input_name")
