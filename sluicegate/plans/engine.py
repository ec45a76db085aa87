"""The engine: schemas compiled on the driver, inputs transformed as DataFrames.

There are two plans for a schema.  The native one expresses framing, selection
and output as Catalyst columns over lines; it serves schemas whose records are
single lines.  The row plan runs the interpreter over whole inputs in Arrow
batches; it serves everything.  Both give the same records: the front doors
take the native plan where a schema allows it, and within it send single inputs
that it can't read (quotes over several lines, a missing header, lines that
start no record) through the row plan.
"""

from __future__ import annotations

import gc
import json
from collections.abc import Callable
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from ..functions import builtin
from ..functions.columns import uuid_v3
from ..operators.evaluate import Context, Evaluator
from ..operators.nodes import Node, RenderError, render, to_value
from ..schema import bind, validate
from ..schema.errors import FatalError, RecordError, SchemaError
from ..shipping import ship
from ..sources.files import decode_column, read_inputs, read_lines
from ..sources.readers import FORMATS, Format
from . import native

MODES = ("PERMISSIVE", "DROP", "FAILFAST")
ROWS = "input_name string, rec_no long, value string, error string, fatal boolean, raw string"


class TransformError(RuntimeError):
    """A record or an input failed under FAILFAST."""


class Program:
    """All that a worker needs to run the row plan; compiled again where it arrives."""

    def __init__(self, schema: dict, functions: dict, parsers: dict, formats: dict, param=None):
        self.schema, self.functions, self.parsers, self.formats, self.param = schema, functions, parsers, formats, param
        self._ready = None

    def __getstate__(self):
        return self.__dict__ | {"_ready": None}

    def ready(self) -> tuple[Format, bind.Decl]:
        if self._ready is None:
            settings = validate.header(self.schema)
            decls = validate.transforms(self.schema)
            arity = {k: v for k, v in builtin.ARITY.items() if self.functions.get(k) is builtin.BUILTIN[k]}
            root = bind.bind(decls, self.functions, self.parsers, arity)
            kind = settings["file_format_type"]
            if kind not in self.formats:
                raise SchemaError(f"unsupported file format type '{kind}'")
            self._ready = self.formats[kind](self.schema, root.xpath), root
        return self._ready

    def run(self, name: str, text: str, external: dict[str, str], want_raw: bool):
        """(record number, value, error, fatal, raw) of each record of one input."""
        fmt, root = self.ready()
        ev, ctx = Evaluator(root, self.functions, self.parsers), Context(name, external, self.param)
        n = 0
        try:
            for rec in fmt.records(name, text or ""):
                n += 1
                if isinstance(rec, RecordError):
                    yield n, None, str(rec), False, None
                    continue
                raw = render(to_value(rec)) if want_raw else None
                try:
                    yield n, render(ev.record(rec, ctx)), None, False, raw
                except (RecordError, RenderError) as e:
                    yield n, None, str(e), False, raw
        except FatalError as e:
            yield n + 1, None, str(e), True, None
        except RecursionError:
            yield n + 1, None, f"input '{name}' is nested too deep", True, None


#: When a Python worker of the row plan collects garbage.
_COLLECT = (50_000, 20, 20)

#: Tasks a core for the interpreter, and the least bytes a task, where a scan's own tasks are few.
_TASKS, _TASK_BYTES = 4, 1 << 14


def _spread(df: DataFrame) -> DataFrame:
    """``df`` over enough tasks for all cores, where it comes straight from a scan that has fewer.

    Columnar files are small for what the interpreter does with their rows: a
    million rows may be one row group.  Rows behind a shuffle stay as they are.
    """
    if df.isStreaming:
        return df
    query = df._jdf.queryExecution()
    plan = query.executedPlan()
    if plan.getClass().getSimpleName() == "AdaptiveSparkPlanExec":
        return df
    size = int(query.optimizedPlan().stats().sizeInBytes())
    want = min(_TASKS * df.sparkSession.sparkContext.defaultParallelism, -(-size // _TASK_BYTES))
    return df.repartition(want) if plan.execute().getNumPartitions() < want else df


@lru_cache(maxsize=64)
def _schema_type(ddl: str):
    from pyspark.sql.types import _parse_datatype_string

    return _parse_datatype_string(ddl)


def output_type(d: bind.Decl, hints: dict[str, str]) -> str:
    """The SQL type of a declaration's values; hints are by path below FINAL_OUTPUT."""
    path = d.name.removeprefix("FINAL_OUTPUT").lstrip(".")
    if path in hints:
        return hints[path]
    if d.type:
        return {"int": "bigint", "float": "double", "boolean": "boolean", "string": "string"}[d.type]
    if d.kind == "object" and d.children:
        return "struct<" + ",".join(f"`{k}`:{output_type(c, hints)}" for k, c in d.children) + ">"
    if d.kind == "array":
        kinds = {output_type(c, hints) for _, c in d.children}
        return f"array<{kinds.pop() if len(kinds) == 1 else 'string'}>"
    return "string"


class Plan:
    """A compiled schema."""

    def __init__(self, spark: SparkSession, program: Program, mode: str, external: dict[str, str], hints: dict[str, str], column_functions: dict):
        if mode not in MODES:
            raise ValueError(f"mode must be one of {', '.join(MODES)}")
        self.spark, self.program, self.mode, self.external, self.hints, self.column_functions = spark, program, mode, external, hints, column_functions
        self.format, self.root = program.ready()
        self.encoding = program.schema["parser_settings"].get("encoding", "utf-8")

    # -- the row plan --------------------------------------------------------

    def rows(self, df: DataFrame, text: str = "text", name: str | None = None, external: str | None = None, raw: bool = False) -> DataFrame:
        """The records of each row's text as JSON: input_name, rec_no, value, error, fatal, raw.

        ``name`` and ``external`` (a map of strings) are columns.  Records are
        numbered from 1 in each input.  A null text has no records.  A fatal
        error is the input's last row; what came before it is valid.
        """
        ship(self.spark)
        program, mode, fixed = self.program, self.mode, self.external
        extra = F.lit(None).cast("map<string,string>") if external is None else F.col(external)
        part = df.select((F.lit("") if name is None else F.col(name).cast("string")).alias("n"), F.col(text).cast("string").alias("t"), extra.alias("e"))
        part = _spread(part)
        names = ["input_name", "rec_no", "value", "error", "fatal", "raw"]
        kinds = [pa.string(), pa.int64(), pa.string(), pa.string(), pa.bool_(), pa.string()]

        def run(batches):
            out: list[tuple] = []

            def flush():
                cols = list(zip(*out)) if out else [[]] * 6
                out.clear()
                return pa.RecordBatch.from_arrays([pa.array(list(c), k) for c, k in zip(cols, kinds)], names=names)

            # a record's tree refers to itself: rare collections go through less that is still in use
            gc.set_threshold(*_COLLECT)
            size = 0
            for b in batches:
                for n, t, e in zip(*(c.to_pylist() for c in b.columns)):
                    if t is None:
                        continue
                    for rec in program.run(n or "", t, {**fixed, **dict(e or {})}, raw):
                        if rec[2] is not None:
                            if mode == "FAILFAST":
                                raise TransformError(rec[2])
                            if mode == "DROP":
                                continue
                        out.append((n, *rec))
                        size += len(rec[1] or "")
                        if len(out) >= 4096 or size > 1 << 24:
                            yield flush()
                            size = 0
            if out:
                yield flush()

        return part.mapInArrow(run, ROWS)

    def with_checksum(self, rows: DataFrame) -> DataFrame:
        """Adds the checksum of the raw record (needs ``raw=True``)."""
        return rows.withColumn("checksum", uuid_v3(F.col("raw")))

    def typed(self, rows: DataFrame, keep: tuple[str, ...] = ("input_name", "rec_no")) -> DataFrame:
        """The rows' values as columns, beside ``keep`` and ``_error``.

        An object's fields become columns; any other output is the column
        ``value``.  Types follow the declarations and the result hints.
        """
        kind = output_type(self.root, self.hints)
        if self.root.kind == "object":
            v = F.from_json("value", _schema_type(kind))
            fields = [v[k].alias(k) for k, _ in self.root.children]
            return rows.select(*keep, *fields, F.col("error").alias("_error"))
        v = F.from_json(F.concat(F.lit('{"v":'), F.coalesce("value", F.lit("null")), F.lit("}")), _schema_type(f"struct<v:{kind}>"))["v"]
        return rows.select(*keep, v.alias("value"), F.col("error").alias("_error"))

    # -- the native plan -----------------------------------------------------

    @property
    def is_native(self) -> bool:
        """Whether whole inputs can be transformed without the interpreter."""
        return self._whole(self.spark.range(0).select(F.lit("").alias("text")), "text") is not None

    def _whole(self, df: DataFrame, text: str):
        """(inputs for the row plan or None if there can't be any, records, node, error); None if the schema needs the row plan."""
        try:
            return native.compile_inputs(df, text, self.format, self.root, self.external, self.column_functions)
        except native.Unsupported:
            return None

    def _moded(self, df: DataFrame, error: Column) -> DataFrame:
        """``df`` with the column _error as the mode has it."""
        if self.mode == "FAILFAST":
            error = F.when(error.isNotNull(), F.raise_error(error)).otherwise(F.lit(None)).cast("string")
        # a filter on a result would be moved below all that the result is made of and repeat it there
        out = df.withColumn("_error", F.when(F.spark_partition_id() >= 0, error))
        return out.where("_error is null") if self.mode == "DROP" else out

    def lines(self, df: DataFrame, line: str = "line", keep: tuple[str, ...] = (), first: str | None = None) -> DataFrame:
        """Records of a DataFrame of data lines, one line a record, all in Catalyst.

        The lines may come from any splittable source in any order; blank ones
        are skipped.  Where inputs may begin with a header record, ``first``
        names the boolean column that tells which line is an input's first.  A
        csv schema's own header and skipped rows must not be among the lines.
        A line that is no record by itself is an error row.  Raises Unsupported
        if the schema needs the row plan.
        """
        kept, node, error = native.compile_lines(df, line, self.format, self.root, self.external, self.column_functions, first)
        out = self._moded(kept.withColumn("_value", node.value), error)
        return out.select(*keep, *self._values(), "_error")

    def _values(self) -> list[Column]:
        """The column _value as the columns of a typed result."""
        ok, value = F.col("_error").isNull(), F.col("_value")
        return [F.when(ok, value[k]).alias(k) for k, _ in self.root.children] if self.root.kind == "object" else [F.when(ok, value).alias("value")]

    # -- front doors ---------------------------------------------------------

    def transform_df(self, df: DataFrame, text: str = "text", name: str | None = None, external: str | None = None) -> DataFrame:
        """Typed records of inputs that are rows: input_name, rec_no, the values, _error."""
        part = df.select((F.lit("") if name is None else F.col(name).cast("string")).alias("_name"), F.col(text).cast("string").alias("_text"), *([] if external is None else [F.col(external).alias("_external")]))
        whole = None if external is not None else self._whole(part, "_text")
        by_rows = lambda some: self.typed(self.rows(some, "_text", "_name", None if external is None else "_external"))
        if whole is None or native.ddl(whole[2].kind) != output_type(self.root, self.hints):
            return by_rows(part)
        rest, records, node, error = whole
        out = self._moded(records.withColumn("_value", node.value), error)
        out = out.select(F.col("_name").alias("input_name"), F.col("_no").alias("rec_no"), *self._values(), "_error")
        return out if rest is None else out.union(by_rows(rest))

    def transform_texts(self, df: DataFrame, text: str = "text", name: str | None = None, external: str | None = None, raw: bool = False) -> DataFrame:
        """JSON records of inputs that are rows, as ``rows`` gives them."""
        part = df.select((F.lit("") if name is None else F.col(name).cast("string")).alias("_name"), F.col(text).cast("string").alias("_text"), *([] if external is None else [F.col(external).alias("_external")]))
        by_rows = lambda some: self.rows(some, "_text", "_name", None if external is None else "_external", raw)
        try:
            whole = None if external is not None or raw else self._whole(part, "_text")
            value = None if whole is None else F.coalesce(native.json_text(F.col("_value"), whole[2].kind), F.lit("null"))
        except native.Unsupported:
            whole = None
        if whole is None:
            return by_rows(part)
        rest, records, node, error = whole
        out = self._moded(records.withColumn("_value", node.value), error)
        told = [F.col("_name").alias("input_name"), F.col("_no").alias("rec_no"), F.when(F.col("_error").isNull(), value).alias("value"), F.col("_error").alias("error"), F.lit(False).alias("fatal"), F.lit(None).cast("string").alias("raw")]
        return out.select(*told) if rest is None else out.select(*told).union(by_rows(rest))

    def transform_files(self, paths: str | list[str], raw: bool = False) -> DataFrame:
        """JSON records of files, in the schema's encoding."""
        return self.transform_texts(read_inputs(self.spark, paths, self.encoding), "text", "input_name", raw=raw)

    def transform_lines(self, paths: str | list[str]) -> DataFrame:
        """Typed records of UTF-8 files of single-line records, which are split over tasks: input_name, the values, _error.

        For schemas without header records or header rows; Unsupported otherwise.
        """
        form = native.Lines(self.format)
        if self.encoding != "utf-8" or form.header is not None or form.head_row is not None or (form.data_row or 0) > 1:
            raise native.Unsupported("the files' first lines, or their encoding, need whole inputs")
        return self.lines(read_lines(self.spark, paths), "line", ("input_name",))

    def transform_bytes(self, df: DataFrame, content: str = "content", name: str | None = None) -> DataFrame:
        """JSON records of binary inputs."""
        cols = [F.lit("").alias("n") if name is None else F.col(name).alias("n"), decode_column(F.col(content), self.encoding).alias("t")]
        return self.transform_texts(df.select(*cols), "t", "n")

    def transform_text(self, text: str, name: str = "") -> list:
        """The values of one text, on the driver; stops at the first error."""
        out = []
        for _, value, error, _, _ in self.program.run(name, text.removeprefix("﻿"), self.external, False):
            if error is not None:
                raise TransformError(error)
            out.append(json.loads(value))
        return out


class Engine:
    """Compiles schemas.

    ``custom_funcs``: name to callable (context, *arguments), merged over the
    built-in ones, the later wins.  ``column_functions``: name to a function of
    columns that returns (column, kind), used by the native plan in place of
    the callable.  ``custom_parsers``: name to callable (context, node).
    ``formats``: name to Format, tried before the built-in ones.  ``handlers``:
    callables (schema, engine) tried in turn before the default, each gives a
    plan or None.
    """

    def __init__(self, spark: SparkSession, custom_funcs: dict[str, Callable] | None = None, custom_parsers: dict[str, Callable] | None = None, formats: dict[str, type[Format]] | None = None, handlers: list[Callable] | None = None, column_functions: dict[str, Callable] | None = None):
        self.spark = spark
        self.functions = {**builtin.BUILTIN, **(custom_funcs or {})}
        self.parsers = custom_parsers or {}
        self.formats = {**FORMATS, **(formats or {})}
        self.handlers = handlers or []
        self.column_functions = column_functions or {}

    def compile(self, schema: str | dict, mode: str = "PERMISSIVE", external: dict[str, str] | None = None, result_types: dict[str, str] | None = None, param=None) -> Plan:
        """A plan for a schema; raises SchemaError."""
        if isinstance(schema, str):
            try:
                schema = json.loads(schema)
            except ValueError as e:
                raise SchemaError(f"schema is no valid JSON: {e}") from None
        validate.header(schema, any_version=True)
        for h in self.handlers:
            plan = h(schema, self)
            if plan is not None:
                return plan
        validate.header(schema)
        return Plan(self.spark, Program(schema, self.functions, self.parsers, self.formats, param), mode, external or {}, result_types or {}, self.column_functions)


def record_json(n: Node) -> str:
    """A record's raw JSON."""
    return render(to_value(n))


__all__ = ["Engine", "Plan", "TransformError", "output_type", "record_json", "Column"]
