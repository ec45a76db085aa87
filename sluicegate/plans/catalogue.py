"""The engine's registered queries, each with the SQL that gives the same rows.

Every query renders a table to text inside Spark, runs a schema over the text,
and returns typed columns, so that SQL on the table itself is an independent
check.  Queries over single-line records use the native plan; the others group
a table's rows to inputs (one per customer, nation, user or day) and use the
row plan.
"""

from __future__ import annotations

import json
import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from ..functions.builtin import takes_null
from ..operators.nodes import DOC, Node, dump
from ..schema.errors import RecordError, SchemaError
from ..sources.readers import Format
from ..sources.segments import raw_segments
from ..streaming.ingest import Framer, frame_lines, stream_files
from .engine import Engine, Plan
from .sinks import json_array, write_json_lines

VERSION = "sluice.2.1"
QUERIES: dict = {}
ORACLE: dict[str, str] = {}


def query(sql: str | None = None):
    def register(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLE[f.__name__] = sql
        return f

    return register


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def schema(kind: str, output: dict, declaration: dict | None = None, encoding: str | None = None, **templates) -> dict:
    settings = {"version": VERSION, "file_format_type": kind} | ({"encoding": encoding} if encoding else {})
    out = {"parser_settings": settings, "transform_declarations": {"FINAL_OUTPUT": output, **templates}}
    return out | ({"file_declaration": declaration} if declaration is not None else {})


def x(path: str, kind: str | None = None, **more) -> dict:
    """A field declaration."""
    return {"xpath": path, **({"type": kind} if kind else {}), **more}


def obj(xpath: str | None = None, **fields) -> dict:
    return ({"xpath": xpath} if xpath else {}) | {"object": fields}


def func(name: str, *args, **more) -> dict:
    top = {k: more.pop(k) for k in ("type", "xpath", "no_trim", "keep_empty_or_null") if k in more}
    return {"custom_func": {"name": name, "args": [{"const": a} if isinstance(a, str) else a for a in args], **more}, **top}


def script(code: str, **args) -> dict:
    kind = args.pop("type", None)
    pairs = [y for k, v in args.items() for y in (k, v)]
    return func("javascript", code, *pairs, **({"type": kind} if kind else {}))


def columns(*names: str) -> list[dict]:
    return [{"name": n} for n in names]


def joined(sep: str, *cols) -> Column:
    return F.concat_ws(sep, *[c if isinstance(c, Column) else F.coalesce(F.col(c).cast("string"), F.lit("")) for c in cols])


def inputs(df: DataFrame, key: str, order: list[str], text: Column, sep: str = "\n", head: Column | None = None, tail: Column | None = None) -> DataFrame:
    """One input per key: the rows' texts in order, between a head and a tail."""
    rows = df.select(F.col(key).alias("_k"), F.struct(*order, text.alias("_t")).alias("_r"))
    body = F.array_join(F.transform(F.array_sort(F.collect_list("_r")), lambda r: r["_t"]), sep)
    parts = [p for p in (head, body, tail) if p is not None]
    return rows.groupBy("_k").agg(F.concat_ws(sep, *parts).alias("text")).select(F.col("_k").cast("string").alias("input_name"), "text")


def ran(spark: SparkSession, s: dict, df: DataFrame, hints: dict | None = None, engine: Engine | None = None, errors: bool = False, **more) -> DataFrame:
    plan = (engine or Engine(spark)).compile(s, result_types=hints, **more)
    out = plan.transform_df(df, "text", "input_name").drop("input_name", "rec_no")
    return out if errors else out.where("_error is null").drop("_error")


def lined(spark: SparkSession, s: dict, lines: DataFrame, engine: Engine | None = None, errors: bool = False, first: str | None = None, **more) -> DataFrame:
    out = (engine or Engine(spark)).compile(s, **more).lines(lines, first=first)
    return out if errors else out.where("_error is null").drop("_error")


# --- delimited -------------------------------------------------------------

_ORDER_LINE = {"delimiter": "|", "records": [{"name": "HEADER", "header": "^ORDERKEY", "min": 1, "max": 1}, {"name": "ORDER", "is_target": True, "columns": columns("KEY", "PRICE", "STATUS", "PRIORITY")}]}


def _order_lines(spark, sf_dir):
    rows = table(spark, sf_dir, "orders").select(joined("|", "o_orderkey", "o_totalprice", "o_orderstatus", "o_orderpriority").alias("line"), F.lit(False).alias("first"))
    return rows.union(spark.range(1).select(F.lit("ORDERKEY|PRICE|STATUS|PRIORITY"), F.lit(True)))


@query("SELECT o_orderkey AS orderkey, o_totalprice AS price, o_orderstatus AS status FROM orders")
def csv2_single_row(spark, sf_dir):
    return lined(spark, schema("csv2", obj(orderkey=x("KEY", "int"), price=x("PRICE", "float"), status=x("STATUS")), _ORDER_LINE), _order_lines(spark, sf_dir), first="first")


@query("SELECT o_orderkey AS orderkey, o_totalprice AS price, o_orderstatus AS status FROM orders WHERE o_orderstatus <> 'F'")
def csv2_selector_filter(spark, sf_dir):
    return lined(spark, schema("csv2", obj(".[STATUS != 'F']", orderkey=x("KEY", "int"), price=x("PRICE", "float"), status=x("STATUS")), _ORDER_LINE), _order_lines(spark, sf_dir), first="first")


@query("SELECT o_orderkey AS orderkey FROM orders WHERE o_totalprice < 100000 AND NOT (o_orderpriority = '5-LOW' OR o_orderstatus = 'P')")
def selector_boolean_number(spark, sf_dir):
    s = schema("csv2", obj(".[PRICE < 100000 and not(PRIORITY = '5-LOW' or STATUS = 'P')]", orderkey=x("KEY", "int")), _ORDER_LINE)
    return lined(spark, s, _order_lines(spark, sf_dir), first="first")


_CUSTOMER = {"delimiter": "|", "records": [{"name": "C", "columns": columns("KEY", "NAME", "BAL", "SEG")}]}


def _customers(spark, sf_dir):
    return table(spark, sf_dir, "customer").select(joined("|", "c_custkey", "c_name", "c_acctbal", "c_mktsegment").alias("line"))


@query("SELECT c_custkey AS custkey, c_mktsegment AS segment FROM customer WHERE regexp_full_match(c_mktsegment, 'BUILDING|MACHINERY')")
def selector_regex(spark, sf_dir):
    return lined(spark, schema("csv2", obj(".[matches(SEG, '^(BUILDING|MACHINERY)$')]", custkey=x("KEY", "int"), segment=x("SEG")), _CUSTOMER), _customers(spark, sf_dir))


@query("SELECT p_partkey AS partkey, p_name AS name FROM part WHERE starts_with(p_name, 'small') OR contains(p_name, 'dget') OR ends_with(p_name, 'bolt')")
def selector_prefix_contains(spark, sf_dir):
    lines = table(spark, sf_dir, "part").select(joined("|", "p_partkey", "p_name").alias("line"))
    s = schema("csv2", obj(".[starts-with(NAME, 'small') or contains(NAME, 'dget') or ends-with(NAME, 'bolt')]", partkey=x("KEY", "int"), name=x("NAME")), {"delimiter": "|", "records": [{"name": "P", "columns": columns("KEY", "NAME")}]})
    return lined(spark, s, lines)


@query("SELECT s_suppkey AS suppkey, s_name AS name, s_acctbal AS balance FROM supplier")
def csv_v1_alias_header(spark, sf_dir):
    df = inputs(table(spark, sf_dir, "supplier"), "s_nationkey", ["s_suppkey"], joined(",", "s_suppkey", "s_name", "s_acctbal"), head=F.lit("a title line, \"ignored\n\nSUPP KEY , SUPP NAME,BAL,EXTRA"))
    d = {"delimiter": ",", "header_row_index": 3, "data_row_index": 4, "columns": [{"name": "SUPP KEY", "alias": "KEY"}, {"name": "SUPP NAME", "alias": "NAME"}, {"name": "BAL"}]}
    return ran(spark, schema("csv", obj(suppkey=x("KEY", "int"), name=x("NAME"), balance=x("BAL", "float")), d), df)


@query("SELECT s_suppkey AS suppkey, CASE WHEN s_suppkey % 3 = 0 THEN NULL ELSE s_name END AS name, CASE WHEN s_suppkey % 3 = 0 THEN NULL ELSE s_acctbal END AS balance FROM supplier")
def csv_v1_ragged(spark, sf_dir):
    whole = joined(",", "s_suppkey", "s_name", "s_acctbal", F.lit("one,cell,too,many"))
    lines = table(spark, sf_dir, "supplier").select(F.when(F.col("s_suppkey") % 3 == 0, F.col("s_suppkey").cast("string")).otherwise(whole).alias("line"))
    d = {"delimiter": ",", "data_row_index": 1, "columns": columns("KEY", "NAME", "BAL")}
    return lined(spark, schema("csv", obj(suppkey=x("KEY", "int"), name=x("NAME"), balance=x("BAL", "float")), d), lines)


@query("SELECT s_suppkey AS suppkey, CASE WHEN s_suppkey % 3 = 0 THEN NULL ELSE s_name END AS name, s_suppkey % 3 = 0 AS failed FROM supplier")
def csv2_missing_col_empty(spark, sf_dir):
    """A missing cell is "" here: the text is dropped, the typed one is an error."""
    df = inputs(table(spark, sf_dir, "supplier"), "s_nationkey", ["s_suppkey"], F.when(F.col("s_suppkey") % 3 == 0, F.col("s_suppkey").cast("string")).otherwise(joined(",", "s_suppkey", "s_name", "s_acctbal")))
    d = {"delimiter": ",", "records": [{"name": "S", "columns": columns("KEY", "NAME", "BAL")}]}
    good = ran(spark, schema("csv2", obj(suppkey=x("KEY", "int"), name=x("NAME")), d), df)
    bad = ran(spark, schema("csv2", obj(suppkey=x("KEY", "int"), balance=x("BAL", "float")), d), df).select("suppkey", F.lit(False).alias("failed"))
    return good.join(bad, "suppkey", "left").select("suppkey", "name", F.coalesce("failed", F.lit(True)).alias("failed"))


@query("SELECT c_custkey AS custkey, 'the ''' || c_name || ''' of ''' || c_mktsegment AS name FROM customer")
def csv_quote_replace(spark, sf_dir):
    lines = table(spark, sf_dir, "customer").select(joined("|", "c_custkey", F.concat(F.lit('the "'), "c_name", F.lit('" of "'), "c_mktsegment")).alias("line"))
    d = {"delimiter": "|", "replace_double_quotes": True, "records": [{"name": "C", "columns": columns("KEY", "NAME")}]}
    return lined(spark, schema("csv2", obj(custkey=x("KEY", "int"), name=x("NAME")), d), lines)


@query("SELECT c_custkey AS custkey, c_name || ', \"x\"' || chr(10) || c_mktsegment AS name FROM customer")
def csv_quoted_cells(spark, sf_dir):
    """Quoted cells with delimiters, doubled quotes and line ends."""
    text = F.concat(F.col("c_custkey").cast("string"), F.lit(',"'), "c_name", F.lit(', ""x""\n'), "c_mktsegment", F.lit('"'))
    df = inputs(table(spark, sf_dir, "customer"), "c_nationkey", ["c_custkey"], text)
    d = {"delimiter": ",", "data_row_index": 1, "columns": columns("KEY", "NAME")}
    return ran(spark, schema("csv", obj(custkey=x("KEY", "int"), name=x("NAME")), d), df)


@query("SELECT o_orderkey AS orderkey, o_orderstatus AS status, o_totalprice AS price, o_orderpriority AS priority FROM orders")
def csv2_rows_n(spark, sf_dir):
    text = F.concat(joined(",", "o_orderkey", "o_orderstatus"), F.lit("\n"), joined(",", "o_totalprice", "o_orderpriority"))
    df = inputs(table(spark, sf_dir, "orders"), "o_custkey", ["o_orderkey"], text)
    d = {"delimiter": ",", "records": [{"name": "O", "rows": 2, "columns": [{"name": "KEY", "line_index": 1}, {"name": "STATUS", "line_index": 1}, {"name": "PRICE", "index": 1, "line_index": 2}, {"name": "PRIORITY", "line_index": 2}]}]}
    return ran(spark, schema("csv2", obj(orderkey=x("KEY", "int"), status=x("STATUS"), price=x("PRICE", "float"), priority=x("PRIORITY")), d), df)


@query("SELECT o_orderkey AS orderkey, o_totalprice AS price FROM orders")
def csv2_header_footer(spark, sf_dir):
    text = F.concat(F.lit("B\n"), joined(",", F.lit("K"), "o_orderkey"), F.lit("\n\n"), joined(",", F.lit("P"), "o_totalprice"), F.lit("\nE"))
    df = inputs(table(spark, sf_dir, "orders"), "o_custkey", ["o_orderkey"], text)
    d = {"delimiter": ",", "records": [{"name": "O", "header": "^B$", "footer": "^E$", "columns": [{"name": "KEY", "index": 2, "line_pattern": "^K"}, {"name": "PRICE", "index": 2, "line_pattern": "^P"}]}]}
    return ran(spark, schema("csv2", obj(orderkey=x("KEY", "int"), price=x("PRICE", "float")), d), df)


_ITEMS = "string_agg(l_partkey::VARCHAR, ',' ORDER BY l_linenumber, l_partkey)"
_NESTED_SQL = f"""SELECT o_orderkey AS orderkey, o_orderstatus AS status, parts, n FROM orders LEFT JOIN
 (SELECT l_orderkey, {_ITEMS} AS parts, count(*) AS n FROM lineitem GROUP BY l_orderkey) ON l_orderkey = o_orderkey"""


def _orders_with_items(spark, sf_dir, head: Column, line: Column, sep: str = "\n", tail: Column | None = None, by: str = "o_custkey") -> DataFrame:
    """One input per customer: each order's text, then its items' texts."""
    items = table(spark, sf_dir, "lineitem").groupBy("l_orderkey").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("l_linenumber", "l_partkey", line.alias("t")))), lambda r: r["t"]), sep).alias("_items"))
    orders = table(spark, sf_dir, "orders").join(items, F.col("o_orderkey") == F.col("l_orderkey"), "left")
    parts = [head, F.col("_items"), *([tail] if tail is not None else [])]
    return inputs(orders, by, ["o_orderkey"], F.concat_ws(sep, *parts), sep)


_PARTS_HINT = {"parts": "string", "n": "bigint"}


@query(_NESTED_SQL)
def csv2_nested(spark, sf_dir):
    df = _orders_with_items(spark, sf_dir, joined(",", F.lit("H"), "o_orderkey", "o_orderstatus"), joined(",", F.lit("D"), "l_partkey", "l_quantity"))
    d = {"delimiter": ",", "records": [{"name": "H", "header": "^H", "is_target": True, "columns": [{"name": "KEY", "index": 2}, {"name": "STATUS"}], "child_records": [{"name": "D", "header": "^D", "columns": [{"name": "PART", "index": 2}, {"name": "QTY"}]}]}]}
    s = schema("csv2", obj(orderkey=x("KEY", "int"), status=x("STATUS"), parts={"array": [x("D/PART")]}), d)
    out = ran(spark, s, df)
    return out.select("orderkey", "status", F.when(F.col("parts").isNotNull(), F.array_join("parts", ",")).alias("parts"), F.when(F.col("parts").isNotNull(), F.size("parts")).cast("long").alias("n"))


@query("SELECT o_orderkey AS orderkey, o_custkey AS custkey FROM orders")
def csv2_groups_context(spark, sf_dir):
    """A group without lines of its own, and an ancestor's earlier sibling through ``..``."""
    rows = table(spark, sf_dir, "orders")
    df = inputs(rows, "o_custkey", ["o_orderkey"], F.concat(joined(",", F.lit("O"), "o_orderkey"), F.lit("\n"), joined(",", F.lit("T"), "o_orderstatus")), head=F.concat(F.lit("C,"), F.first("_k").cast("string")))
    d = {"delimiter": ",", "records": [{"name": "C", "header": "^C", "min": 1, "max": 1, "columns": [{"name": "KEY", "index": 2}]}, {"name": "G", "type": "record_group", "child_records": [{"name": "O", "header": "^O", "is_target": True, "columns": [{"name": "KEY", "index": 2}]}, {"name": "T", "header": "^T"}]}]}
    return ran(spark, schema("csv2", obj(orderkey=x("KEY", "int"), custkey=x("../../C/KEY", "int")), d), df)


# --- fixed length ----------------------------------------------------------


def _pad(c: str, n: int) -> Column:
    return F.rpad(F.coalesce(F.col(c).cast("string"), F.lit("")), n, " ")


@query("SELECT c_custkey AS custkey, c_name AS name, c_acctbal AS balance FROM customer WHERE c_mktsegment <> 'BUILDING'")
def fixed2_single_row(spark, sf_dir):
    lines = table(spark, sf_dir, "customer").select(F.concat(_pad("c_custkey", 12), _pad("c_name", 25), _pad("c_acctbal", 14), _pad("c_mktsegment", 12)).alias("line"))
    d = {"envelopes": [{"columns": [{"name": "KEY", "start_pos": 1, "length": 12}, {"name": "NAME", "start_pos": 13, "length": 25}, {"name": "BAL", "start_pos": 38, "length": 14}, {"name": "SEG", "start_pos": 52, "length": 12}, {"name": "BEYOND", "start_pos": 90, "length": 3}]}]}
    return lined(spark, schema("fixedlength2", obj(".[not(starts-with(SEG, 'BUILDING'))]", custkey=x("KEY", "int"), name=x("NAME"), balance=x("BAL", "float")), d), lines)


@query("SELECT c_custkey AS custkey, c_name AS name FROM customer")
def fixed_v1_rows(spark, sf_dir):
    """Three lines an envelope, columns chosen by pattern."""
    text = F.concat(F.lit("A1"), _pad("c_custkey", 10), F.lit("\nA2filler\nA3"), _pad("c_name", 20))
    df = inputs(table(spark, sf_dir, "customer"), "c_nationkey", ["c_custkey"], text)
    d = {"envelopes": [{"by_rows": 3, "columns": [{"name": "KEY", "start_pos": 3, "length": 10, "line_pattern": "^A1"}, {"name": "NAME", "start_pos": 3, "length": 20, "line_pattern": "^A3"}]}]}
    return ran(spark, schema("fixed-length", obj(custkey=x("KEY", "int"), name=x("NAME")), d), df)


@query("SELECT n_nationkey AS nationkey, n_name AS name, r_name AS region FROM nation JOIN region ON n_regionkey = r_regionkey")
def fixed_global_context(spark, sf_dir):
    """A region's header envelope stays visible to the nations after it."""
    n, r = table(spark, sf_dir, "nation"), table(spark, sf_dir, "region")
    both = n.join(r, n["n_regionkey"] == r["r_regionkey"])
    df = inputs(both, "r_name", ["n_nationkey"], F.concat(F.lit("N1"), _pad("n_nationkey", 6), F.lit("\nN9"), _pad("n_name", 20)), head=F.concat(F.lit("R1"), F.first("_k"), F.lit("\nR9")), tail=F.lit("T1\nT9"))
    hf = lambda a, b: {"by_header_footer": {"header": a, "footer": b}}
    d = {"envelopes": [{"name": "REGION", "not_target": True, **hf("^R1", "^R9"), "columns": [{"name": "name", "start_pos": 3, "length": 30, "line_pattern": "^R1"}]}, {"name": "NATION", **hf("^N1", "^N9"), "columns": [{"name": "key", "start_pos": 3, "length": 6, "line_pattern": "^N1"}, {"name": "name", "start_pos": 3, "length": 20, "line_pattern": "^N9"}]}, {"name": "TRAILER", "not_target": True, **hf("^T1", "^T9")}]}
    return ran(spark, schema("fixed-length", obj(nationkey=x("key", "int"), name=x("name"), region=x("../REGION/name")), d), df)


@query(_NESTED_SQL)
def fixed2_nested(spark, sf_dir):
    df = _orders_with_items(spark, sf_dir, F.concat(F.lit("HDR"), _pad("o_orderkey", 12), F.col("o_orderstatus")), F.concat(F.lit("ITM"), _pad("l_partkey", 12)))
    d = {"envelopes": [{"name": "H", "header": "^HDR", "is_target": True, "columns": [{"name": "KEY", "start_pos": 4, "length": 12}, {"name": "STATUS", "start_pos": 16, "length": 1}], "child_envelopes": [{"name": "I", "header": "^ITM", "columns": [{"name": "PART", "start_pos": 4, "length": 12}]}]}]}
    s = schema("fixedlength2", obj(orderkey=x("KEY", "int"), status=x("STATUS"), parts={"array": [x("I/PART")]}), d)
    out = ran(spark, s, df)
    return out.select("orderkey", "status", F.when(F.col("parts").isNotNull(), F.array_join("parts", ",")).alias("parts"), F.when(F.col("parts").isNotNull(), F.size("parts")).cast("long").alias("n"))


# --- EDI -------------------------------------------------------------------


@query("""SELECT n_nationkey AS nationkey, unnest([1, 2, 3])::INTEGER AS seg_no, unnest(['NA', 'RG', 'ZZ']) AS name,
 unnest([n_name, n_regionkey::VARCHAR, 'end']) AS first, unnest([2, 1, 1])::BIGINT AS n FROM nation""")
def edi_raw_segments(spark, sf_dir):
    n = table(spark, sf_dir, "nation")
    df = n.select(F.col("n_nationkey").cast("string").alias("input_name"), F.concat(F.lit("NA*"), "n_name", F.lit(">x~\r\nRG*"), F.col("n_regionkey").cast("string"), F.lit("~\nZZ*end~\n")).alias("text"))
    out = raw_segments(df, {"segment_delimiter": "~", "element_delimiter": "*", "component_delimiter": ">"}, name="input_name")
    return out.select(F.col("input_name").cast("int").alias("nationkey"), "seg_no", F.regexp_replace("name", "[\r\n]", "").alias("name"), F.element_at("elems", 2)["data"].alias("first"), (F.size("elems") - 1).cast("long").alias("n"))


_EDI_ORDER = {
    "segment_delimiter": "~",
    "element_delimiter": "*",
    "ignore_crlf": True,
    "segment_declarations": [
        {
            "name": "ISA",
            "child_segments": [
                {"name": "order", "type": "segment_group", "min": 0, "max": -1, "is_target": True, "child_segments": [{"name": "ST", "elements": [{"name": "key", "index": 1}, {"name": "status", "index": 2}]}, {"name": "item", "type": "segment_group", "min": 0, "max": -1, "child_segments": [{"name": "LX", "elements": [{"name": "part", "index": 1}]}, {"name": "QTY", "min": 0, "elements": [{"name": "qty", "index": 1}]}]}, {"name": "SE"}]},
                {"name": "IEA", "min": 0},
            ],
        }
    ],
}


@query(f"""SELECT o_orderkey AS orderkey, o_orderstatus AS status, parts, n, first_qty FROM orders LEFT JOIN
 (SELECT l_orderkey, {_ITEMS} AS parts, count(*) AS n, first(l_quantity ORDER BY l_linenumber, l_partkey, l_quantity) AS first_qty FROM lineitem GROUP BY l_orderkey) ON l_orderkey = o_orderkey""")
def edi_groups(spark, sf_dir):
    items = table(spark, sf_dir, "lineitem").groupBy("l_orderkey").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("l_linenumber", "l_partkey", "l_quantity"))), lambda r: F.concat(F.lit("LX*"), r["l_partkey"].cast("string"), F.lit("~\nQTY*"), r["l_quantity"].cast("string"), F.lit("~"))), "\n").alias("_items"))
    orders = table(spark, sf_dir, "orders").join(items, F.col("o_orderkey") == F.col("l_orderkey"), "left")
    text = F.concat_ws("\n", F.concat(F.lit("ST*"), joined("*", "o_orderkey", "o_orderstatus"), F.lit("~")), "_items", F.lit("SE*1~"))
    df = inputs(orders, "o_custkey", ["o_orderkey"], text, head=F.lit("ISA*00~"), tail=F.lit("IEA*1~"))
    s = schema("edi", obj(orderkey=x("ST/key", "int"), status=x("ST/status"), parts={"array": [x("item/LX/part")]}, first_qty=x("item[position()=1]/QTY/qty", "float")), _EDI_ORDER)
    out = ran(spark, s, df)
    return out.select("orderkey", "status", F.when(F.col("parts").isNotNull(), F.array_join("parts", ",")).alias("parts"), F.when(F.col("parts").isNotNull(), F.size("parts")).cast("long").alias("n"), "first_qty")


@query("SELECT p_partkey AS partkey, p_brand || ',' || p_type || ',' AS tags, p_size AS size, 'cm' AS unit, 'none' AS note FROM part")
def edi_repetition_component(spark, sf_dir):
    text = F.concat(F.lit("P*"), F.col("p_partkey").cast("string"), F.lit("*"), joined("^", "p_brand", "p_type", F.lit("")), F.lit("*"), joined(":", "p_size", F.lit("cm")), F.lit("~"))
    df = inputs(table(spark, sf_dir, "part"), "p_brand", ["p_partkey"], text)
    d = {"segment_delimiter": "~", "element_delimiter": "*", "component_delimiter": ":", "repetition_delimiter": "^", "ignore_crlf": True, "segment_declarations": [{"name": "P", "min": 0, "max": -1, "is_target": True, "elements": [{"name": "key", "index": 1}, {"name": "tag", "index": 2}, {"name": "size", "index": 3, "component_index": 1}, {"name": "unit", "index": 3, "component_index": 2}, {"name": "note", "index": 9, "default": "none"}, {"name": "gone", "index": 8, "empty_if_missing": True}]}]}
    tags = {"array": [x("tag", keep_empty_or_null=True)]}
    s = schema("edi", obj(partkey=x("key", "int"), tags=tags, size=x("size", "int"), unit=x("unit"), note=x("note"), gone=x("gone")), d)
    return ran(spark, s, df).select("partkey", F.array_join("tags", ",").alias("tags"), F.col("size").cast("int").alias("size"), "unit", "note")


@query("SELECT p_partkey AS partkey, p_name || '*~?:' || p_type AS name FROM part")
def edi_release_char(spark, sf_dir):
    text = F.concat(F.lit("P*"), F.col("p_partkey").cast("string"), F.lit("*"), "p_name", F.lit("?*?~???:"), "p_type", F.lit("~"))
    df = inputs(table(spark, sf_dir, "part"), "p_brand", ["p_partkey"], text, sep="")
    d = {"segment_delimiter": "~", "element_delimiter": "*", "component_delimiter": ":", "release_character": "?", "segment_declarations": [{"name": "P", "min": 0, "max": -1, "is_target": True, "elements": [{"name": "key", "index": 1}, {"name": "name", "index": 2}]}]}
    return ran(spark, schema("edi", obj(partkey=x("key", "int"), name=x("name")), d), df)


@query("SELECT n_nationkey AS nationkey, n_name AS name FROM nation")
def edi_root_repeats(spark, sf_dir):
    """The root sequence starts again with each interchange."""
    text = F.concat(F.lit("A*"), F.col("n_nationkey").cast("string"), F.lit("|B*"), F.col("n_name"), F.lit("|"))
    df = inputs(table(spark, sf_dir, "nation"), "n_regionkey", ["n_nationkey"], text, sep="")
    d = {"segment_delimiter": "|", "element_delimiter": "*", "segment_declarations": [{"name": "A", "elements": [{"name": "key", "index": 1}]}, {"name": "B", "is_target": True, "elements": [{"name": "name", "index": 1}]}]}
    out = ran(spark, schema("edi", obj(name=x("name"), keys={"array": [x("../A/key", "int")]}), d), df)
    return out.select(F.element_at("keys", -1).cast("int").alias("nationkey"), "name")


# --- JSON, XML, JSON lines -------------------------------------------------


@query("SELECT event_id, json_extract(props, '$.k')::BIGINT AS k FROM events")
def json_path_extract(spark, sf_dir):
    e = table(spark, sf_dir, "events")
    df = inputs(e, "user_id", ["event_id"], F.concat(F.lit('{"id":'), F.col("event_id").cast("string"), F.lit(',"props":'), "props", F.lit("}")), sep=",", head=F.lit('[{"skip":1}'), tail=F.lit("null]"))
    return ran(spark, schema("json", obj("/*[props]", event_id=x("id", "int"), k=x("props/k", "int"))), df)


def _json_orders(spark, sf_dir) -> DataFrame:
    items = table(spark, sf_dir, "lineitem").groupBy("l_orderkey").agg(F.array_sort(F.collect_list(F.struct("l_linenumber", F.col("l_partkey").alias("part"), F.col("l_quantity").alias("qty"), F.col("l_returnflag").alias("flag")))).alias("items"))
    orders = table(spark, sf_dir, "orders").join(items, F.col("o_orderkey") == F.col("l_orderkey"), "left")
    return inputs(orders, "o_custkey", ["o_orderkey"], F.to_json(F.struct(F.col("o_orderkey").alias("key"), "items")), sep=",", head=F.lit('{"orders":[null'), tail=F.lit("null]}"))


@query(f"SELECT o_orderkey AS orderkey, parts FROM orders LEFT JOIN (SELECT l_orderkey, {_ITEMS} AS parts FROM lineitem GROUP BY l_orderkey) ON l_orderkey = o_orderkey")
def json_multi_select(spark, sf_dir):
    s = schema("json", obj("/orders/*[key]", orderkey=x("key", "int"), parts={"array": [x("items/*/part")]}))
    out = ran(spark, s, _json_orders(spark, sf_dir))
    return out.select("orderkey", F.when(F.col("parts").isNotNull(), F.array_join("parts", ",")).alias("parts"))


@query("""SELECT o_orderkey AS orderkey, second_part, returned FROM orders LEFT JOIN
 (SELECT l_orderkey, list(l_partkey ORDER BY l_linenumber, l_partkey, l_quantity, l_returnflag)[2] AS second_part,
  string_agg(l_partkey::VARCHAR, ',' ORDER BY l_linenumber, l_partkey, l_quantity, l_returnflag) FILTER (WHERE l_returnflag = 'R') AS returned
  FROM lineitem GROUP BY l_orderkey) ON l_orderkey = o_orderkey""")
def json_predicate_position(spark, sf_dir):
    s = schema("json", obj("/orders/*[key]", orderkey=x("key", "int"), second_part=x("items/*[position()=2]/part", "int"), returned={"array": [x("items/*[flag='R']/part")]}))
    out = ran(spark, s, _json_orders(spark, sf_dir))
    return out.select("orderkey", "second_part", F.when(F.col("returned").isNotNull(), F.array_join("returned", ",")).alias("returned"))


@query("""SELECT o_orderkey AS orderkey, n, total, last_part FROM orders JOIN
 (SELECT l_orderkey, count(*)::DOUBLE AS n, sum(l_quantity) AS total, list(l_partkey ORDER BY l_linenumber, l_partkey, l_quantity, l_returnflag)[-1] AS last_part
  FROM lineitem GROUP BY l_orderkey) ON l_orderkey = o_orderkey WHERE n > 2""")
def xpath_core(spark, sf_dir):
    """Core functions in predicates and paths: count, sum, last, string functions, descendant steps."""
    out = obj("/orders/*[count(items/*) > 2]", orderkey=x("key", "int"), last_part=x("items/*[last()]/part", "int"), qty={"array": [x(".//qty", "float")]}, odd=x("items/*[position()=1][string-length(normalize-space(flag)) = 7]/part"))
    got = ran(spark, schema("json", out), _json_orders(spark, sf_dir))
    return got.select("orderkey", F.size("qty").cast("double").alias("n"), F.aggregate("qty", F.lit(0.0), lambda a, b: a + b).alias("total"), "last_part")


@query("SELECT p_partkey AS partkey, CASE p_size % 3 WHEN 0 THEN p_brand WHEN 1 THEN p_type ELSE NULL END AS picked FROM part")
def json_xpath_dynamic(spark, sf_dir):
    p = table(spark, sf_dir, "part")
    text = F.to_json(F.struct(F.col("p_partkey").alias("key"), F.col("p_brand").alias("opt0"), F.col("p_type").alias("opt1"), F.array(F.struct(F.lit("which").alias("name"), (F.col("p_size") % 3).alias("index"))).alias("options")))
    df = inputs(p, "p_brand", ["p_partkey"], text, sep=",", head=F.lit('[{"key":-1}'), tail=F.lit('{"key":-1}]'))
    s = schema("json", obj("/*[key >= 0]", partkey=x("key", "int"), picked={"xpath_dynamic": func("concat", "opt", x("options/*[name='which']/index"))}))
    return ran(spark, s, df)


@query("SELECT p_partkey AS partkey, p_name AS name, p_size::BIGINT AS size, p_retailprice AS price FROM part")
def json_copy(spark, sf_dir):
    text = F.to_json(F.struct(F.struct(F.col("p_partkey").alias("key"), F.struct(F.col("p_name").alias("name"), F.col("p_size").alias("size"), F.col("p_retailprice").alias("price")).alias("of")).alias("part")))
    df = table(spark, sf_dir, "part").select(F.lit("").alias("input_name"), text.alias("text"))
    s = schema("json", obj(whole=func("copy", xpath="part")))
    got = ran(spark, s, df, {"whole": "struct<key:bigint,of:struct<name:string,size:bigint,price:double>>"})
    return got.select(F.col("whole.key").alias("partkey"), "whole.of.name", "whole.of.size", "whole.of.price")


@query("SELECT p_partkey AS partkey, p_name AS name, p_brand AS brand, p_size::BIGINT AS size FROM part")
def xml_attr_ns(spark, sf_dir):
    """Attributes, prefixed elements, and a name taken from the parent's earlier child."""
    text = F.concat(F.lit('<p:part key="'), F.col("p_partkey").cast("string"), F.lit('" size="'), F.col("p_size").cast("string"), F.lit('"> <p:name>'), "p_name", F.lit("</p:name></p:part>"))
    df = inputs(table(spark, sf_dir, "part"), "p_brand", ["p_partkey"], text, head=F.concat(F.lit('<?xml version="1.0" encoding="UTF-8"?>\n<p:parts xmlns:p="urn:parts"><brand>'), F.first("_k"), F.lit("</brand>")), tail=F.lit("<!-- end --></p:parts>"))
    s = schema("xml", obj("p:parts/p:part[@key >= 0]", partkey=x("@key", "int"), name=x("p:name"), brand=x("../brand"), size=x("@size", "int")))
    return ran(spark, s, df)


@query("SELECT event_id, upper(event_type) AS kind FROM events WHERE event_type IN ('error', 'purchase') AND value > 20")
def jsonlog_filter(spark, sf_dir):
    e = table(spark, sf_dir, "events")
    df = inputs(e, "user_id", ["event_id"], F.concat(F.to_json(F.struct("event_id", "event_type", "value")), F.lit("\n")))
    return ran(spark, schema("jsonlog", obj(".[matches(event_type, '^(error|purchase)$') and value > 20]", event_id=x("event_id", "int"), kind=func("upper", x("event_type")))), df)


# --- functions -------------------------------------------------------------


@query("SELECT c_custkey AS custkey, c_name AS first, c_name || '-' || c_mktsegment AS both, lower(c_mktsegment) AS low, upper(c_name) AS up FROM customer")
def fn_string(spark, sf_dir):
    out = obj(custkey=x("KEY", "int"), first=func("coalesce", "", x("NONE"), x("NAME"), x("SEG")), both=func("concat", x("NAME"), "-", x("SEG"), x("NONE")), low=func("lower", x("SEG")), up=func("upper", x("NAME")))
    return lined(spark, schema("csv2", out, _CUSTOMER), _customers(spark, sf_dir))


@query("""SELECT n_name AS name, h[1:8] || '-' || h[9:12] || '-3' || h[14:16] || '-' ||
 ['8','9','a','b'][1 + (strpos('0123456789abcdef', h[17:17]) - 1) % 4] || h[18:20] || '-' || h[21:32] AS uuid
 FROM (SELECT n_name, md5(unhex(repeat('00', 16)) || encode(n_name)) AS h FROM nation)""")
def fn_uuidv3(spark, sf_dir):
    lines = table(spark, sf_dir, "nation").select(F.col("n_name").alias("line"))
    return lined(spark, schema("csv2", obj(name=x("NAME"), uuid=func("uuidv3", x("NAME"))), {"delimiter": "|", "records": [{"columns": columns("NAME")}]}), lines)


def _event_lines(spark, sf_dir, *cols):
    return table(spark, sf_dir, "events").select(joined("|", *cols).alias("line"))


_PLAIN = lambda *names: {"delimiter": "|", "records": [{"columns": columns(*names)}]}


@query("""SELECT event_id, strftime(ts, '%Y-%m-%dT%H:%M:%S') AS plain, strftime(ts, '%Y-%m-%dT%H:%M:%S') || '-08:00' AS stamped,
 strftime(ts + INTERVAL 5 HOUR, '%Y-%m-%dT%H:%M:%S') || 'Z' AS moved FROM events""")
def fn_datetime_rfc3339(spark, sf_dir):
    df = _event_lines(spark, sf_dir, "event_id", F.date_format("ts", "yyyy/MM/dd HH:mm:ss"), F.date_format("ts", "yyyyMMdd'T'HHmmss'-05'"))
    out = obj(event_id=x("A", "int"), plain=func("dateTimeToRFC3339", x("B"), "", ""), stamped=func("dateTimeToRFC3339", x("B"), "America/Los_Angeles", ""), moved=func("dateTimeToRFC3339", x("C"), "Asia/Tokyo", "UTC"))
    return lined(spark, schema("csv2", out, _PLAIN("A", "B", "C")), df)


@query("SELECT o_orderkey AS orderkey, strftime(o_orderdate, '%Y-%m-%dT00:00:00') AS day, strftime(o_orderdate, '%Y-%m-%dT10:30:00') || '+09:00' AS stamped FROM orders")
def fn_datetime_layout(spark, sf_dir):
    df = table(spark, sf_dir, "orders").select(joined("|", "o_orderkey", F.date_format("o_orderdate", "dd.MM.yyyy"), F.date_format("o_orderdate", "MMM d, yyyy '10:30 AM'")).alias("line"))
    out = obj(orderkey=x("A", "int"), day=func("dateTimeLayoutToRFC3339", x("B"), "02.01.2006", "false", "", ""), stamped=func("dateTimeLayoutToRFC3339", x("C"), "Jan 2, 2006 3:04 PM", "false", "Asia/Tokyo", ""))
    return lined(spark, schema("csv2", out, _PLAIN("A", "B", "C")), df)


@query("SELECT event_id, epoch(date_trunc('second', ts))::BIGINT::VARCHAR AS seconds, (epoch(date_trunc('second', ts))::BIGINT * 1000 + 5 * 3600000)::VARCHAR AS millis FROM events")
def fn_epoch(spark, sf_dir):
    df = _event_lines(spark, sf_dir, "event_id", F.date_format("ts", "yyyy-MM-dd HH:mm:ss"))
    out = obj(event_id=x("A", "int"), seconds=func("dateTimeToEpoch", x("B"), "", "SECOND"), millis=func("dateTimeToEpoch", x("B"), "Etc/GMT+5", "MILLISECOND"))
    return lined(spark, schema("csv2", out, _PLAIN("A", "B")), df)


def _since_1970(unit: str) -> Column:
    return F.timestamp_diff(unit, F.lit("1970-01-01").cast("timestamp_ntz"), F.col("ts"))


@query("SELECT event_id, strftime(ts, '%Y-%m-%dT%H:%M:%S') || 'Z' AS back FROM events")
def fn_epoch_to_dt(spark, sf_dir):
    lines = table(spark, sf_dir, "events").select(joined("|", "event_id", _since_1970("MILLISECOND")).alias("line"))
    return lined(spark, schema("csv2", obj(event_id=x("A", "int"), back=func("epochToDateTimeRFC3339", x("B"), "MILLISECOND")), _PLAIN("A", "B")), lines)


@query("SELECT event_id, strftime(ts + INTERVAL 9 HOUR, '%Y-%m-%dT%H:%M:%S') || '+09:00' AS back FROM events")
def fn_epoch_to_zone(spark, sf_dir):
    df = _event_lines(spark, sf_dir, "event_id", _since_1970("SECOND"))
    return lined(spark, schema("csv2", obj(event_id=x("A", "int"), back=func("epochToDateTimeRFC3339", x("B"), "SECOND", "Asia/Tokyo")), _PLAIN("A", "B")), df)


# --- scripts ---------------------------------------------------------------

_LINEITEM = ("ORDER", "PART", "PRICE", "DISC", "TAX", "FLAG", "STATUS")


def _lineitems(spark, sf_dir):
    return table(spark, sf_dir, "lineitem").select(joined("|", "l_orderkey", "l_partkey", "l_extendedprice", "l_discount", "l_tax", "l_returnflag", "l_linestatus").alias("line"))


@query("SELECT l_orderkey AS orderkey, l_partkey AS partkey, floor(l_extendedprice * (1 - l_discount) * 100) / 100 AS net FROM lineitem")
def script_arith(spark, sf_dir):
    out = obj(orderkey=x("ORDER", "int"), partkey=x("PART", "int"), net=script("Math.floor(p * (1 - d) * 100) / 100", p=x("PRICE", "float"), d=x("DISC", "float")))
    return lined(spark, schema("csv2", out, _PLAIN(*_LINEITEM)), _lineitems(spark, sf_dir))


@query("SELECT l_orderkey AS orderkey, CASE l_returnflag WHEN 'R' THEN 'returned' WHEN 'A' THEN 'accepted' ELSE 'none' END AS flag, l_linestatus = 'F' AND l_tax > 0.04 AS final FROM lineitem")
def script_case(spark, sf_dir):
    out = obj(orderkey=x("ORDER", "int"), flag=script("f=='R'?'returned':f=='A'?'accepted':'none'", f=x("FLAG")), final=script("s == 'F' && t > 0.04", s=x("STATUS"), t=x("TAX", "float")))
    return lined(spark, schema("csv2", out, _PLAIN(*_LINEITEM)), _lineitems(spark, sf_dir))


@query("SELECT l_orderkey AS orderkey, count(*) AS n, sum(l_quantity) AS total FROM lineitem JOIN orders ON l_orderkey = o_orderkey GROUP BY l_orderkey")
def script_fold(spark, sf_dir):
    code = "t=0; for (i=0; i<q.length; i++) { t += q[i]; } t"
    s = schema("json", obj("/orders/*[items]", orderkey=x("key", "int"), n=script("q.length", q={"array": [x("items/*/qty", "float")]}, type="int"), total=script(code, q={"array": [x("items/*/qty", "float")]}, type="float")))
    return ran(spark, s, _json_orders(spark, sf_dir))


@query("SELECT p_partkey AS partkey, p_name || ' (' || p_size || ')' AS label, length(p_name)::BIGINT AS n FROM part")
def script_with_context(spark, sf_dir):
    df = table(spark, sf_dir, "part").select(F.lit("").alias("input_name"), joined("|", "p_partkey", "p_name", "p_size").alias("text"))
    out = obj(partkey=x("A", "int"), label=func("javascript_with_context", "var o = JSON.parse(_node); o.B + ' (' + o.C + ')'"), n=func("javascript_with_context", "JSON.parse(_node).B.split('').map(c => 1).reduce((a, b) => a + b, 0)", type="int"))
    return ran(spark, schema("csv2", out, _PLAIN("A", "B", "C")), df)


# --- declarations ----------------------------------------------------------

_NATION = _PLAIN("KEY", "NAME", "REGION")


def _nations(spark, sf_dir, pad: str = ""):
    return table(spark, sf_dir, "nation").select(joined("|", "n_nationkey", F.concat(F.lit(pad), "n_name", F.lit(pad)), "n_regionkey").alias("line"))


@query("SELECT n_nationkey AS key, upper(n_name) AS name, n_regionkey::BIGINT AS region, '<' || lower(n_name) || '>' AS wrapped FROM nation")
def template_reuse(spark, sf_dir):
    s = schema("csv2", obj(key=x("KEY", "int"), name={"template": "loud"}, region={"xpath": "REGION", "template": "number"}, wrapped=func("concat", "<", {"template": "quiet"}, ">")), _NATION, loud=func("upper", x("NAME")), quiet=func("lower", {"template": "name"}), name=x("NAME"), number=func("concat", x("."), type="int"))
    plan = Engine(spark).compile(s)
    return plan.transform_df(_nations(spark, sf_dir).select(F.lit("").alias("input_name"), F.col("line").alias("text")), "text", "input_name").select(F.col("key").cast("int").alias("key"), "name", "region", "wrapped")


@query("SELECT n_nationkey AS key, 'fixed' AS const, 42::BIGINT AS number, 'acme' AS tenant FROM nation")
def external_const(spark, sf_dir):
    s = schema("csv2", obj(key=x("KEY", "int"), const={"const": " fixed "}, number={"const": "42", "type": "int"}, tenant={"external": "tenant"}), _NATION)
    return lined(spark, s, _nations(spark, sf_dir), external={"tenant": "acme"}).withColumn("key", F.col("key").cast("int"))


@query("""SELECT n_nationkey AS key, '{"a":"","b":null,"c":{},"d":null,"key":"' || n_nationkey || '"}' AS value FROM nation""")
def keep_empty(spark, sf_dir):
    """JSON output with kept empty text, null, object and array."""
    keep = {"keep_empty_or_null": True}
    s = schema("csv2", obj(key=x("KEY"), a={"const": "", **keep}, b=x("NONE", **keep), c={"object": {"z": x("NONE")}, **keep}, d={"array": [x("NONE")], **keep}, e=x("NONE"), f={"const": " "}), _NATION)
    rows = Engine(spark).compile(s).rows(_nations(spark, sf_dir), "line")
    return rows.select(F.get_json_object("value", "$.key").cast("int").alias("key"), "value")


@query("SELECT n_nationkey AS key, n_name AS trimmed, '  ' || n_name || '  ' AS untrimmed FROM nation")
def no_trim(spark, sf_dir):
    s = schema("csv2", obj(key=x("KEY", "int"), trimmed=x("NAME"), untrimmed=x("NAME", no_trim=True)), _NATION)
    return lined(spark, s, _nations(spark, sf_dir, "  ")).withColumn("key", F.col("key").cast("int"))


@query("""SELECT o_orderkey AS orderkey, o_totalprice AS price, o_orderstatus = 'F' AS done, o_orderkey::VARCHAR AS text,
 CASE WHEN o_orderstatus = 'P' THEN true ELSE false END AS failed FROM orders""")
def type_casts(spark, sf_dir):
    done = F.when(F.col("o_orderstatus") == "F", "T").otherwise("0")
    lines = table(spark, sf_dir, "orders").select(joined("|", "o_orderkey", "o_totalprice", done, F.when(F.col("o_orderstatus") == "P", "1d").otherwise("7")).alias("line"))
    d = _PLAIN("KEY", "PRICE", "DONE", "ODD")
    out = obj(orderkey=x("KEY", "int"), price=x("PRICE", "float"), done=x("DONE", "boolean"), text=x("KEY", "string"))
    odd = Engine(spark).compile(schema("csv2", obj(odd=x("ODD", "float")), d)).lines(lines, keep=("line",)).select("line", F.col("_error").isNotNull().alias("failed"))
    return Engine(spark).compile(schema("csv2", out, d)).lines(odd, keep=("failed",)).drop("_error")


@query("SELECT o_orderkey AS orderkey, CASE WHEN o_orderstatus = 'F' THEN NULL ELSE strftime(o_orderdate, '%Y-%m-%dT00:00:00') END AS day FROM orders")
def ignore_error(spark, sf_dir):
    df = table(spark, sf_dir, "orders").select(joined("|", "o_orderkey", F.when(F.col("o_orderstatus") == "F", "no date").otherwise(F.date_format("o_orderdate", "yyyy-MM-dd"))).alias("line"))
    return lined(spark, schema("csv2", obj(orderkey=x("A", "int"), day=func("dateTimeToRFC3339", x("B"), "", "", ignore_error=True)), _PLAIN("A", "B")), df)


@query("SELECT CASE WHEN o_orderstatus = 'P' THEN NULL ELSE o_orderkey END AS orderkey, CASE WHEN o_orderstatus = 'P' THEN 'fail to convert value ''' || o_orderkey || 'x'' to type ''int'' on ''FINAL_OUTPUT.orderkey'': no whole number of 64 bits' END AS error FROM orders")
def record_error_channel(spark, sf_dir):
    """Records that fail come out with their error; the others go on."""
    lines = table(spark, sf_dir, "orders").select(F.concat(F.col("o_orderkey").cast("string"), F.when(F.col("o_orderstatus") == "P", "x").otherwise("")).alias("line"))
    return lined(spark, schema("csv2", obj(orderkey=x("KEY", "int")), _PLAIN("KEY")), lines, errors=True).withColumnRenamed("_error", "error")


@query("""SELECT n_nationkey AS nationkey, 1::BIGINT AS good, CASE WHEN n_nationkey % 2 = 0 THEN 1 ELSE 0 END::BIGINT AS fatal FROM nation""")
def fatal_error_row(spark, sf_dir):
    """An input whose grammar breaks keeps what came before, and ends in a fatal row."""
    text = F.concat(F.lit("H,"), F.col("n_name"), F.when(F.col("n_nationkey") % 2 == 0, F.lit("\nX,1")).otherwise(F.lit("\nT,1")))
    df = table(spark, sf_dir, "nation").select(F.col("n_nationkey").cast("string").alias("input_name"), text.alias("text"))
    d = {"delimiter": ",", "records": [{"name": "H", "header": "^H", "is_target": True, "columns": columns("K", "NAME")}, {"name": "T", "header": "^T"}]}
    rows = Engine(spark).compile(schema("csv2", obj(name=x("NAME")), d)).rows(df, "text", "input_name")
    return rows.groupBy(F.col("input_name").cast("int").alias("nationkey")).agg(F.count_if(F.col("error").isNull()).alias("good"), F.count_if(F.col("fatal")).alias("fatal"))


@query("SELECT n_nationkey AS key, 'v10,v11,v1,v2,v3,v4,v5,v6,v7,v8,v9' AS items FROM nation")
def array_mixed_order(spark, sf_dir):
    """Eleven elements come in the order of their keys elem[1] to elem[11] as texts, in which ] follows the digits."""
    s = schema("csv2", obj(key=x("KEY", "int"), items={"array": [{"const": f"v{i}"} for i in range(1, 12)]}), _NATION)
    out = lined(spark, s, _nations(spark, sf_dir))
    return out.select(F.col("key").cast("int").alias("key"), F.array_join("items", ",").alias("items"))


_SEVERITY = {"error": "E", "purchase": "P"}


@takes_null
def _severity(ctx, kind):
    return _SEVERITY.get(kind or "", "-")


@query("SELECT event_id, CASE event_type WHEN 'error' THEN 'E' WHEN 'purchase' THEN 'P' ELSE '-' END AS code FROM events")
def custom_func_udf(spark, sf_dir):
    engine = Engine(spark, custom_funcs={"severity": _severity})
    df = _event_lines(spark, sf_dir, "event_id", "event_type").select(F.lit("").alias("input_name"), F.col("line").alias("text"))
    return ran(spark, schema("csv2", obj(event_id=x("A", "int"), code=func("severity", x("B"))), _PLAIN("A", "B")), df, engine=engine)


@query("SELECT event_id, CASE event_type WHEN 'error' THEN 'E' WHEN 'purchase' THEN 'P' ELSE '-' END AS code FROM events")
def custom_func_column(spark, sf_dir):
    """The same function as a column expression, in the native plan."""
    case = lambda kind: (F.when(kind == "error", "E").when(kind == "purchase", "P").otherwise("-"), "string")
    engine = Engine(spark, custom_funcs={"severity": _severity}, column_functions={"severity": case})
    lines = table(spark, sf_dir, "events").select(joined("|", "event_id", "event_type").alias("line"))
    return lined(spark, schema("csv2", obj(event_id=x("A", "int"), code=func("severity", x("B"))), _PLAIN("A", "B")), lines, engine=engine)


class KeyValue(Format):
    """A format of its own: lines of key=value pairs, one record a line."""

    def records(self, name, text):
        for no, line in enumerate(text.split("\n"), 1):
            pairs = [p.partition("=") for p in line.split(";") if p]
            if any(not sep for _, sep, _ in pairs):
                yield RecordError(f"input '{name}' line {no}: no pair")
                continue
            n = Node(DOC)
            for k, _, v in pairs:
                n.leaf(k, v)
            if pairs and self.keep(n):
                yield n


@query("SELECT event_id, event_type AS kind FROM events WHERE event_type <> 'view'")
def custom_format(spark, sf_dir):
    engine = Engine(spark, formats={"pairs": KeyValue})
    df = inputs(table(spark, sf_dir, "events"), "user_id", ["event_id"], F.concat(F.lit("id="), F.col("event_id").cast("string"), F.lit(";kind="), "event_type"))
    return ran(spark, schema("pairs", obj(".[kind != 'view']", event_id=x("id", "int"), kind=x("kind"))), df, engine=engine)


@query("SELECT n_nationkey AS key, n_name || '/' || n_regionkey AS parsed FROM nation")
def custom_parse(spark, sf_dir):
    engine = Engine(spark, custom_parsers={"pair": lambda ctx, node: "/".join(c.text() for c in node.children[1:])})
    df = _nations(spark, sf_dir).select(F.lit("").alias("input_name"), F.col("line").alias("text"))
    return ran(spark, schema("csv2", obj(key=x("KEY", "int"), parsed={"custom_parse": "pair"}), _NATION), df, engine=engine).withColumn("key", F.col("key").cast("int"))


@query("""SELECT n_nationkey AS key, raw, h[1:8] || '-' || h[9:12] || '-3' || h[14:16] || '-' ||
 ['8','9','a','b'][1 + (strpos('0123456789abcdef', h[17:17]) - 1) % 4] || h[18:20] || '-' || h[21:32] AS checksum
 FROM (SELECT *, md5(unhex(repeat('00', 16)) || encode(raw)) AS h FROM
 (SELECT n_nationkey, '{"KEY":"' || n_nationkey || '","NAME":"' || n_name || '","REGION":"' || n_regionkey || '"}' AS raw FROM nation))""")
def raw_record_checksum(spark, sf_dir):
    plan = Engine(spark).compile(schema("csv2", obj(key=x("KEY")), _NATION))
    rows = plan.with_checksum(plan.rows(_nations(spark, sf_dir), "line", raw=True))
    return rows.select(F.get_json_object("value", "$.key").cast("int").alias("key"), "raw", "checksum")


@query("SELECT n_nationkey AS key, n_name || ' é€ü' AS name FROM nation")
def encoding_windows_1252(spark, sf_dir):
    """Bytes in windows-1252, decoded natively."""
    n = table(spark, sf_dir, "nation")
    content = F.concat(F.encode(joined("|", "n_nationkey", F.concat("n_name", F.lit(" "))), "iso-8859-1"), F.unhex(F.lit("E980FC")))
    plan = Engine(spark).compile(schema("csv2", obj(key=x("A", "int"), name=x("B")), _PLAIN("A", "B"), encoding="windows-1252"))
    out = plan.typed(plan.transform_bytes(n.select(content.alias("content"))))
    return out.select(F.col("key").cast("int").alias("key"), "name")


@query("SELECT o_orderkey AS orderkey, o_orderstatus AS status FROM orders")
def framed_lines(spark, sf_dir):
    """The framing that streams of lines use, over a table's whole texts."""
    text = F.concat(joined(",", F.lit("B"), "o_orderkey"), F.lit("\n"), joined(",", F.lit("S"), "o_orderstatus"), F.lit("\nE\nnoise"))
    df = inputs(table(spark, sf_dir, "orders"), "o_custkey", ["o_orderkey"], text)
    framer = Framer(header="^B", footer="^E")

    def frame(batches):
        for pdf in batches:
            yield pdf.assign(text=[framer.feed([], t.split("\n"))[0] for t in pdf["text"]]).explode("text")

    framed = df.mapInPandas(frame, "input_name string, text string").where("text is not null")
    d = {"delimiter": ",", "records": [{"name": "O", "header": "^B", "footer": "^E", "columns": [{"name": "KEY", "index": 2, "line_pattern": "^B"}, {"name": "STATUS", "index": 2, "line_pattern": "^S"}]}]}
    return ran(spark, schema("csv2", obj(orderkey=x("KEY", "int"), status=x("STATUS")), d), framed)


# --- both plans agree ------------------------------------------------------


@query("SELECT c_custkey AS custkey, c_name || ', \"' || c_mktsegment || '\"' AS name, c_acctbal AS balance FROM customer")
def native_quoted_cells(spark, sf_dir):
    """Quoted cells with delimiters and doubled quotes, read line by line in Catalyst."""
    lines = table(spark, sf_dir, "customer").select(F.concat(F.col("c_custkey").cast("string"), F.lit(',"'), "c_name", F.lit(', ""'), "c_mktsegment", F.lit('""","'), F.col("c_acctbal").cast("string"), F.lit('"')).alias("line"))
    s = schema("csv", obj(custkey=x("KEY", "int"), name=x("NAME"), balance=x("BAL", "float")), {"delimiter": ",", "data_row_index": 1, "columns": columns("KEY", "NAME", "BAL")})
    return lined(spark, s, lines)


_HEADED = {"delimiter": "|", "records": [{"name": "H", "header": "^K", "max": 1}, {"name": "R", "is_target": True, "columns": columns("KEY", "NAME")}]}


@query("SELECT c_nationkey::VARCHAR AS nation, 'K' || c_custkey AS key, c_name AS name FROM customer")
def native_header_once(spark, sf_dir):
    """Data lines that look like the header are records; only an input's first line is its header."""
    df = inputs(table(spark, sf_dir, "customer"), "c_nationkey", ["c_custkey"], F.concat(F.lit("K"), joined("|", "c_custkey", "c_name")), head=F.lit("KEY|NAME"))
    out = Engine(spark).compile(schema("csv2", obj(key=x("KEY"), name=x("NAME")), _HEADED)).transform_df(df, "text", "input_name")
    return out.select(F.col("input_name").alias("nation"), "key", "name")


@query("SELECT n_nationkey AS nationkey, CASE WHEN n_nationkey % 2 = 0 THEN 2 ELSE 0 END::BIGINT AS good, CASE WHEN n_nationkey % 2 = 0 THEN 0 ELSE 1 END::BIGINT AS failed FROM nation")
def native_header_missing(spark, sf_dir):
    """An input without the header record that it must begin with gives nothing but its fatal row."""
    text = F.concat(F.when(F.col("n_nationkey") % 2 == 0, "KEY|NAME\n").otherwise(""), F.lit("1|a\n2|b"))
    df = table(spark, sf_dir, "nation").select(F.col("n_nationkey").cast("string").alias("input_name"), text.alias("text"))
    d = {**_HEADED, "records": [{**_HEADED["records"][0], "min": 1}, _HEADED["records"][1]]}
    out = Engine(spark).compile(schema("csv2", obj(key=x("KEY", "int"), name=x("NAME")), d)).transform_df(df, "text", "input_name")
    return out.groupBy(F.col("input_name").cast("int").alias("nationkey")).agg(F.count_if(F.col("_error").isNull()).alias("good"), F.count_if(F.col("_error").isNotNull()).alias("failed"))


@query("SELECT o_orderkey AS orderkey, CASE WHEN o_orderstatus = 'F' THEN NULL ELSE o_totalprice END AS price, o_orderstatus = 'F' AS failed FROM orders")
def float_overflow(spark, sf_dir):
    """A number beyond a float's range is a record's error, in both plans."""
    price = F.when(F.col("o_orderstatus") == "F", F.concat(F.col("o_totalprice").cast("string"), F.lit("e400"))).otherwise(F.col("o_totalprice").cast("string"))
    lines = table(spark, sf_dir, "orders").select("o_orderkey", price.alias("line"))
    out = Engine(spark).compile(schema("csv2", obj(price=x("PRICE", "float")), _PLAIN("PRICE"))).lines(lines, keep=("o_orderkey",))
    return out.select(F.col("o_orderkey").alias("orderkey"), "price", F.col("_error").isNotNull().alias("failed"))


@query("SELECT c_custkey AS custkey, c_name AS name FROM customer")
def csv2_pattern_unquoted(spark, sf_dir):
    """Patterns see a row without its quotes."""
    lines = table(spark, sf_dir, "customer").select(F.concat(F.lit('"C","'), F.col("c_custkey").cast("string"), F.lit('","'), "c_name", F.lit('"')).alias("line"))
    d = {"delimiter": ",", "records": [{"header": "^C,[0-9]+,", "columns": [{"name": "KEY", "index": 2}, {"name": "NAME"}]}]}
    return lined(spark, schema("csv2", obj(custkey=x("KEY", "int"), name=x("NAME")), d), lines)


# --- how inputs end, and what fails ----------------------------------------


def _outcome(spark, s: dict, df: DataFrame, **more) -> DataFrame:
    """Good, failed and fatal records of each nation's input."""
    rows = Engine(spark).compile(s, **more).rows(df, "text", "input_name")
    return rows.groupBy(F.col("input_name").cast("int").alias("nationkey")).agg(F.count_if(F.col("error").isNull()).alias("good"), F.count_if(F.col("error").isNotNull() & ~F.col("fatal")).alias("failed"), F.count_if(F.col("fatal")).alias("fatal"))


def _by_nation(spark, sf_dir, even: str, odd: str) -> DataFrame:
    n = table(spark, sf_dir, "nation")
    return n.select(F.col("n_nationkey").cast("string").alias("input_name"), F.when(F.col("n_nationkey") % 2 == 0, even).otherwise(odd).alias("text"))


def _outcome_sql(even: tuple[int, int, int], odd: tuple[int, int, int]) -> str:
    cols = ", ".join(f"CASE WHEN n_nationkey % 2 = 0 THEN {a} ELSE {b} END::BIGINT AS {c}" for a, b, c in zip(even, odd, ("good", "failed", "fatal")))
    return f"SELECT n_nationkey AS nationkey, {cols} FROM nation"


def _between(a: str, b: str, **more) -> dict:
    return {"by_header_footer": {"header": a, "footer": b}, "columns": [{"name": "v", "start_pos": 2, "length": 1}], **more}


_ENVELOPES = {"envelopes": [{"name": "A", "not_target": True, **_between("^A", "^Z")}, {"name": "B", **_between("^B", "^Z")}]}


@query(_outcome_sql((1, 0, 0), (2, 0, 0)))
def fixed_forward_only(spark, sf_dir):
    """Envelopes go forward only: a line that no later one starts with ends the input without an error."""
    df = _by_nation(spark, sf_dir, "A1\nZ\nB1\nZ\nA2\nZ\nB3\nZ", "A1\nZ\nB1\nZ\nB2\nZ\nX")
    return _outcome(spark, schema("fixed-length", obj(v=x("v")), _ENVELOPES), df)


@query(_outcome_sql((1, 0, 1), (2, 0, 0)))
def fixed_incomplete(spark, sf_dir):
    """An envelope without its footer is the input's fatal end."""
    return _outcome(spark, schema("fixed-length", obj(v=x("v")), _ENVELOPES), _by_nation(spark, sf_dir, "B1\nZ\nB2\n", "B1\nZ\nB2\nZ"))


@query(_outcome_sql((2, 0, 0), (3, 0, 0)))
def fixed2_blank_lines(spark, sf_dir):
    s = schema("fixedlength2", obj(v=x("v")), {"envelopes": [{"columns": [{"name": "v", "start_pos": 1, "length": 1}]}]})
    return _outcome(spark, s, _by_nation(spark, sf_dir, "\n\na\n\r\nb\n", "a\nb\n\nc"))


_LIMITS = {"delimiter": ",", "records": [{"name": "H", "header": "^H", "is_target": True, "min": 1, "max": 2, "columns": columns("V")}, {"name": "T", "header": "^T", "min": 1}]}


@query(_outcome_sql((2, 0, 1), (1, 0, 0)))
def occurrence_limits(spark, sf_dir):
    """A third record of at most two is unexpected."""
    return _outcome(spark, schema("csv2", obj(v=x("V")), _LIMITS), _by_nation(spark, sf_dir, "H\nH\nH\nT", "H\nT\nT"))


@query(_outcome_sql((1, 0, 1), (0, 0, 1)))
def occurrence_at_end(spark, sf_dir):
    """At the end of an input the open declarations still ask for their least number."""
    return _outcome(spark, schema("csv2", obj(v=x("V")), _LIMITS), _by_nation(spark, sf_dir, "H", "T"))


@query(_outcome_sql((2, 1, 0), (1, 0, 0)))
def csv_bad_row_goes_on(spark, sf_dir):
    """A row that can't be read is an error of its own; reading goes on."""
    s = schema("csv", obj(v=x("V")), {"delimiter": ",", "data_row_index": 1, "columns": columns("V")})
    return _outcome(spark, s, _by_nation(spark, sf_dir, 'a\nb"c\nd', "a"))


@query(_outcome_sql((2, 0, 1), (3, 0, 0)))
def json_that_breaks_off(spark, sf_dir):
    """The records before the break are kept."""
    return _outcome(spark, schema("json", obj("/*", v=x("v"))), _by_nation(spark, sf_dir, '[{"v": 1}, {"v": [2]}, {"v": "', '[{"v": 1}, {"v": 2}, {"v": {"v": 3}}]'))


@query(_outcome_sql((1, 0, 1), (2, 0, 0)))
def edi_element_missing(spark, sf_dir):
    """A declared element without a default that is missing ends the input."""
    d = {"segment_delimiter": "~", "element_delimiter": "*", "segment_declarations": [{"name": "P", "min": 0, "max": -1, "is_target": True, "elements": [{"name": "k", "index": 1}]}]}
    return _outcome(spark, schema("edi", obj(k=x("k")), d), _by_nation(spark, sf_dir, "P*1~P~", "P*1~P*2~"))


@query(_outcome_sql((1, 0, 1), (1, 0, 0)))
def xml_unknown_prefix(spark, sf_dir):
    s = schema("xml", obj("r/a", v=x(".")))
    return _outcome(spark, s, _by_nation(spark, sf_dir, "<r><a>1</a><p:a>2</p:a></r>", "<r xmlns:p='u'><a>1</a><p:b/></r>"))


@query(_outcome_sql((1, 1, 0), (2, 0, 0)))
def render_error(spark, sf_dir):
    """A value that JSON can't hold is a record's error."""
    engine = Engine(spark, custom_funcs={"odd": lambda ctx, v: float("nan") if v == "n" else v})
    rows = engine.compile(schema("csv2", obj(v=func("odd", x("V"))), _PLAIN("V"))).rows(_by_nation(spark, sf_dir, "a\nn", "a\nb"), "text", "input_name")
    return rows.groupBy(F.col("input_name").cast("int").alias("nationkey")).agg(F.count_if(F.col("error").isNull()).alias("good"), F.count_if(F.col("error").isNotNull() & ~F.col("fatal")).alias("failed"), F.count_if(F.col("fatal")).alias("fatal"))


@query("SELECT n_nationkey AS nationkey, 2::BIGINT AS dropped, CASE WHEN n_nationkey % 2 = 0 THEN 3 ELSE 2 END::BIGINT AS permissive FROM nation")
def modes(spark, sf_dir):
    """PERMISSIVE tells of failed records, DROP leaves them out."""
    df = _by_nation(spark, sf_dir, "1\nx\n3", "1\n3")
    s = schema("csv2", obj(v=x("V", "int")), _PLAIN("V"))
    of = lambda mode: Engine(spark).compile(s, mode=mode).transform_df(df, "text", "input_name").groupBy("input_name").count()
    both = of("DROP").withColumnRenamed("count", "dropped").join(of("PERMISSIVE").withColumnRenamed("count", "permissive"), "input_name")
    return both.select(F.col("input_name").cast("int").alias("nationkey"), "dropped", "permissive")


# --- schemas that are refused ----------------------------------------------

_ONE = lambda **more: {"delimiter": "|", "records": [{"columns": columns("A"), **more}]}
_REFUSED = {
    "no version": {**schema("csv2", x("A"), _ONE()), "parser_settings": {"file_format_type": "csv2"}},
    "unknown format": schema("none", x("A"), _ONE()),
    "unknown encoding": schema("csv2", x("A"), _ONE(), encoding="utf-7"),
    "long delimiter": schema("csv2", x("A"), {**_ONE(), "delimiter": "||"}),
    "unknown key": schema("csv2", x("A"), {**_ONE(), "more": 1}),
    "least above most": schema("csv2", x("A"), _ONE(min=2, max=1)),
    "bad pattern": schema("csv2", x("A"), _ONE(header="(")),
    "rows and header": schema("csv2", x("A"), _ONE(rows=2, header="^A")),
    "footer alone": schema("csv2", x("A"), _ONE(footer="^A")),
    "group without children": schema("csv2", x("A"), {"delimiter": "|", "records": [{"type": "record_group"}]}),
    "two targets": schema("csv2", x("A"), {"delimiter": "|", "records": [{"name": "a", "is_target": True}, {"name": "b", "is_target": True}]}),
    "index and pattern": schema("csv2", x("A"), {"delimiter": "|", "records": [{"columns": [{"name": "A", "line_index": 1, "line_pattern": "^A"}]}]}),
    "edi without target": schema("edi", x("A"), {"segment_delimiter": "~", "element_delimiter": "*", "segment_declarations": [{"name": "A"}]}),
    "csv name with space": schema("csv", x("A"), {"delimiter": ",", "data_row_index": 1, "columns": columns("A B")}),
    "csv header after data": schema("csv", x("A"), {"delimiter": ",", "header_row_index": 2, "data_row_index": 2, "columns": columns("A")}),
    "envelopes of two kinds": schema("fixed-length", x("A"), {"envelopes": [{"name": "A", "by_rows": 1}, {"name": "B", "not_target": True, **_between("^B", "^Z")}]}),
    "no output": {**schema("csv2", x("A"), _ONE()), "transform_declarations": {}},
    "unknown template": schema("csv2", {"template": "none"}, _ONE()),
    "template of itself": schema("csv2", {"template": "a"}, _ONE(), a={"template": "a"}),
    "unknown function": schema("csv2", func("none"), _ONE()),
    "wrong arguments": schema("csv2", func("lower"), _ONE()),
    "array in array": schema("csv2", {"array": [{"array": []}]}, _ONE()),
    "invalid xpath": schema("csv2", x("a["), _ONE()),
    "unknown type": schema("csv2", {"const": "1", "type": "date"}, _ONE()),
    "two paths": schema("csv2", {"xpath": "a", "template": "t"}, _ONE(), t={"xpath": "b"}),
    "jsonlog without selector": schema("jsonlog", obj(a=x("a"))),
}
_ACCEPTED = {"_comment": schema("csv2", {**obj(a=x("A")), "_comment": "said"}, _ONE()), "kinds without names": schema("csv2", obj(a={"const": "1"}, b=x("A"), c={"external": "e"}, d={"array": [x("A")]}, e=obj(z=x("A"))), _ONE())}


@query("SELECT unnest(['" + "', '".join([*_REFUSED, *_ACCEPTED]) + f"']) AS schema, unnest([{', '.join(['true'] * len(_REFUSED) + ['false'] * len(_ACCEPTED))}]) AS refused")
def schema_refusals(spark, sf_dir):
    """Faulty schemas are refused when they are compiled, before any input is read."""

    def refused(s):
        try:
            Engine(spark).compile(s)
            return False
        except SchemaError:
            return True

    return spark.createDataFrame([(k, refused(s)) for k, s in {**_REFUSED, **_ACCEPTED}.items()], "schema string, refused boolean")


# --- sinks, streams, extensions --------------------------------------------


def _folder(spark: SparkSession) -> str:
    """A new folder for what a query writes, in the shared checkpoint folder where one is set."""
    base = spark.sparkContext.getCheckpointDir() or spark.conf.get("spark.checkpoint.dir", None) or tempfile.mkdtemp(prefix="sluicegate-")
    return f"{base}/{uuid.uuid4().hex}"


@query("SELECT n_nationkey AS key, n_name AS name FROM nation")
def sink_json_lines(spark, sf_dir):
    """Written as lines of JSON and read back."""
    path = _folder(spark)
    plan = Engine(spark).compile(schema("csv2", obj(key=x("KEY", "int"), name=x("NAME")), _NATION))
    write_json_lines(plan.transform_texts(_nations(spark, sf_dir), "line"), path)
    return spark.read.schema("key int, name string").json(path)


@query("SELECT count(*)::BIGINT AS n, string_agg(n_name, ',' ORDER BY n_nationkey) AS names FROM nation")
def sink_json_array(spark, sf_dir):
    """One JSON array in the order of the records, and the same values from a text on the driver."""
    plan = Engine(spark).compile(schema("csv2", obj(key=x("KEY", "int"), name=x("NAME")), _NATION))
    text = "\n".join(r["line"] for r in _nations(spark, sf_dir).orderBy(F.split("line", "[|]")[0].cast("int")).collect())
    values = json.loads("".join(json_array(plan.transform_texts(spark.createDataFrame([(text,)], "text string")))))
    assert values == plan.transform_text(text)
    return spark.createDataFrame([(len(values), ",".join(v["name"] for v in values))], "n long, names string")


@query("SELECT n_nationkey AS key, n_name AS name FROM nation")
def stream_of_files(spark, sf_dir):
    """Files that arrive in a folder, as a stream to Parquet."""
    path = _folder(spark)
    _nations(spark, sf_dir).withColumnRenamed("line", "value").repartition(2).write.text(f"{path}/in")
    plan = Engine(spark).compile(schema("csv2", obj(key=x("KEY", "int"), name=x("NAME")), _NATION))
    stream_files(plan, f"{path}/in").writeStream.format("parquet").option("path", f"{path}/out").option("checkpointLocation", f"{path}/state").trigger(availableNow=True).start().awaitTermination()
    rows = spark.read.parquet(f"{path}/out")
    return rows.select(F.get_json_object("value", "$.key").cast("int").alias("key"), F.get_json_object("value", "$.name").alias("name"))


@query("SELECT n_nationkey AS key, n_name AS name FROM nation")
def stream_framed_state(spark, sf_dir):
    """Records of three lines over a stream of lines, which comes in several batches; open ones are kept in state."""
    path = _folder(spark)
    parts = F.array(F.concat(F.lit("B,"), F.col("n_nationkey").cast("string")), F.concat(F.lit("N,"), F.col("n_name")), F.lit("E"))
    lines = table(spark, sf_dir, "nation").select(F.concat(F.lit("r"), F.col("n_regionkey").cast("string")).alias("input_name"), F.col("n_nationkey").alias("k"), F.posexplode(parts).alias("p", "line"))
    lines = lines.select("input_name", (F.col("k") * 3 + F.col("p")).cast("long").alias("line_no"), "line")
    for at in (0, 1, 2):  # the second batch begins within records
        lo, hi = (0, 31, 53, 1 << 30)[at], (31, 53, 1 << 30)[at]
        lines.where(F.col("line_no").between(lo, hi - 1)).coalesce(1).write.mode("append").json(f"{path}/in")
        source = spark.readStream.schema(lines.schema).json(f"{path}/in")
        framed = frame_lines(source, Framer(header="^B", footer="^E"))
        framed.writeStream.format("parquet").option("path", f"{path}/out").option("checkpointLocation", f"{path}/state").trigger(availableNow=True).start().awaitTermination()
    d = {"delimiter": ",", "records": [{"header": "^B", "footer": "^E", "columns": [{"name": "KEY", "index": 2, "line_pattern": "^B"}, {"name": "NAME", "index": 2, "line_pattern": "^N"}]}]}
    return ran(spark, schema("csv2", obj(key=x("KEY", "int"), name=x("NAME")), d), spark.read.parquet(f"{path}/out")).withColumn("key", F.col("key").cast("int"))


@query("SELECT n_nationkey AS key, true AS recent FROM nation")
def fn_now(spark, sf_dir):
    df = _nations(spark, sf_dir).select(F.lit("").alias("input_name"), F.col("line").alias("text"))
    out = ran(spark, schema("csv2", obj(key=x("KEY", "int"), at=func("now")), _NATION), df)
    age = F.unix_timestamp() - F.unix_timestamp(F.to_timestamp("at"))
    return out.select(F.col("key").cast("int").alias("key"), (F.col("at").rlike("^[0-9]{4}-[0-9]{2}-[0-9]{2}T[0-9:]{8}Z$") & age.between(-600, 600)).alias("recent"))


@query("SELECT n_nationkey AS key, 'handled:' || n_name AS name FROM nation")
def schema_handlers(spark, sf_dir):
    """A handler takes the schemas of its own version; others go on to the default one."""

    def own(s, engine):
        if s["parser_settings"]["version"] != "own.1":
            return None
        return engine.compile({**s, "parser_settings": {**s["parser_settings"], "version": VERSION}, "transform_declarations": {"FINAL_OUTPUT": obj(key=x("KEY", "int"), name=func("concat", "handled:", x("NAME")))}})

    s = schema("csv2", obj(key=x("KEY", "int")), _NATION)
    plan: Plan = Engine(spark, handlers=[own]).compile({**s, "parser_settings": {**s["parser_settings"], "version": "own.1"}})
    return plan.transform_df(_nations(spark, sf_dir), "line").select(F.col("key").cast("int").alias("key"), "name")


@query("SELECT n_nationkey AS key, 'document ' || q || q || n || '  element ' || q || 'KEY' || q || n || '    text ' || q || n_nationkey || q || n || '  element ' || q || 'NAME' || q || n || '    text ' || q || n_name || q || n AS tree FROM nation, (SELECT chr(39) AS q, chr(10) AS n)")
def tree_dump(spark, sf_dir):
    """A record's tree as text, by a parser of one's own."""
    engine = Engine(spark, custom_parsers={"show": lambda ctx, node: dump(node)})
    d = {"delimiter": "|", "data_row_index": 1, "columns": columns("KEY", "NAME")}
    df = _nations(spark, sf_dir).select(F.lit("").alias("input_name"), F.regexp_extract("line", r"^[^|]*\|[^|]*", 0).alias("text"))
    return ran(spark, schema("csv", obj(key=x("KEY", "int"), tree={"custom_parse": "show", "no_trim": True}), d), df, engine=engine).withColumn("key", F.col("key").cast("int"))


@query("SELECT n_nationkey AS key, n_name || ' éü' AS name FROM nation")
def encoding_iso_8859_1(spark, sf_dir):
    n = table(spark, sf_dir, "nation")
    content = F.concat(F.encode(joined("|", "n_nationkey", F.concat("n_name", F.lit(" "))), "iso-8859-1"), F.unhex(F.lit("E9FC")))
    plan = Engine(spark).compile(schema("csv2", obj(key=x("A", "int"), name=x("B")), _PLAIN("A", "B"), encoding="iso-8859-1"))
    out = plan.typed(plan.transform_bytes(n.select(content.alias("content"))))
    return out.select(F.col("key").cast("int").alias("key"), "name")


@query("SELECT o_orderkey AS orderkey, o_totalprice AS price FROM orders")
def files_of_lines(spark, sf_dir):
    """Text files whose lines are records, split over tasks and read in Catalyst."""
    path = _folder(spark)
    table(spark, sf_dir, "orders").select(joined("|", "o_orderkey", "o_totalprice").alias("value")).write.text(path)
    plan = Engine(spark).compile(schema("csv2", obj(orderkey=x("KEY", "int"), price=x("PRICE", "float")), _PLAIN("KEY", "PRICE")))
    return plan.transform_lines(path).select("orderkey", "price")
