"""Validation, declarations, functions, readers, plans and streaming of the engine."""

from __future__ import annotations

import cProfile
import json
import os
import pstats
import shutil
import subprocess
import sys
import time
import uuid

import pytest
from hypothesis import HealthCheck, Phase, given, settings, strategies as st
from pyspark.sql import functions as F

from sluicegate import Engine, SchemaError, TransformError
from sluicegate.functions import builtin, datetimes as dt
from sluicegate.functions.script import run_script
from sluicegate.operators import xpath as xp
from sluicegate.operators.evaluate import cast
from sluicegate.operators.nodes import DOC, Node, plain_number, render, to_value
from sluicegate.plans.catalogue import columns, func, obj, schema, x
from sluicegate.plans.engine import Program
from sluicegate.plans.sinks import json_array
from sluicegate.sources.readers import FORMATS, csv_rows
from sluicegate.streaming.ingest import Framer, frame_lines, stream_files

PIPE = {"delimiter": "|", "records": [{"columns": columns("A", "B")}]}


@pytest.fixture
def values(spark):
    """The output values of a schema over a text."""

    def run(output, text, kind="csv2", declaration=PIPE, external=None, **templates):
        return Engine(spark).compile(schema(kind, output, declaration, **templates), external=external).transform_text(text)

    return run


# --- schemas ----------------------------------------------------------------


@pytest.mark.parametrize(
    "change",
    [
        lambda s: s.pop("parser_settings"),
        lambda s: s["parser_settings"].update(version="1"),
        lambda s: s["parser_settings"].update(encoding="utf-7"),
        lambda s: s["parser_settings"].update(file_format_type="no"),
        lambda s: s["transform_declarations"].pop("FINAL_OUTPUT"),
        lambda s: s["file_declaration"].update(delimiter="||"),
        lambda s: s["file_declaration"].update(other=1),
        lambda s: s["file_declaration"]["records"][0].update(min=2, max=1),
        lambda s: s["file_declaration"]["records"][0].update(header="("),
        lambda s: s["file_declaration"]["records"].append({"type": "record_group"}),
        lambda s: s["transform_declarations"].update(FINAL_OUTPUT={"template": "none"}),
        lambda s: s["transform_declarations"].update(FINAL_OUTPUT={"template": "a"}, a={"template": "b"}, b={"template": "a"}),
        lambda s: s["transform_declarations"].update(FINAL_OUTPUT={"custom_func": {"name": "none"}}),
        lambda s: s["transform_declarations"].update(FINAL_OUTPUT={"array": [{"array": []}]}),
        lambda s: s["transform_declarations"].update(FINAL_OUTPUT={"xpath": "a[", "object": {}}),
        lambda s: s["transform_declarations"].update(FINAL_OUTPUT={"const": "1", "type": "date"}),
        lambda s: s["transform_declarations"].update(FINAL_OUTPUT={"xpath": "a", "template": "t"}, t={"xpath": "b"}),
    ],
)
def test_bad_schemas_are_refused(spark, change):
    s = json.loads(json.dumps(schema("csv2", obj(a=x("A")), PIPE)))
    Engine(spark).compile(s)
    change(s)
    with pytest.raises(SchemaError):
        Engine(spark).compile(s)
    with pytest.raises(SchemaError):
        Engine(spark).compile("{not json")


# --- values -----------------------------------------------------------------


@pytest.mark.parametrize("v,kind,want", [("12", "int", 12), ("-3", "int", -3), ("1.5", "float", 1.5), ("T", "boolean", True), ("0", "boolean", False), (3.9, "int", 3), (2, "float", 2.0), (2.0, "string", "2"), (True, "string", "true")])
def test_casts(v, kind, want):
    assert cast(v, kind) == want


@pytest.mark.parametrize("v,kind", [("", "int"), ("1.0", "int"), (" 1", "int"), ("yes", "boolean"), ("1d", "float"), (True, "int"), ({}, "string"), (str(1 << 63), "int")])
def test_casts_that_fail(v, kind):
    with pytest.raises(ValueError):
        cast(v, kind)


def test_emptiness_rules(values):
    keep = {"keep_empty_or_null": True}
    out = obj(a=x("A"), b=x("B"), none=x("C"), kept=x("C", **keep), empty={"object": {"z": x("C")}}, kept_empty={"object": {"z": x("C")}, **keep}, list={"array": [x("A"), x("C"), x("B")]})
    assert values(out, "1|  \n") == [{"a": "1", "kept": None, "kept_empty": {}, "list": ["1"]}]
    assert values(func("coalesce", x("C")), "1|2") == [None]
    assert values(x("C"), "1|2") == []  # FINAL_OUTPUT's path selects records


def test_record_errors_and_null_types(values):
    with pytest.raises(TransformError):
        values(obj(a=x("B", "int")), "1|")
    assert values(obj(a=x("A"), b=x("C", "int")), "1|") == [{"a": "1"}]
    with pytest.raises(TransformError):
        values(obj(a={"external": "none"}), "1|2")
    assert values(obj(a={"external": "t"}), "1|2", external={"t": " v "}) == [{"a": "v"}]


def test_more_than_one_match_is_an_error(values):
    with pytest.raises(TransformError):
        values(obj(a=x("b")), '{"b": 1, "c": 2}', "json", None) and values(obj(a=x("*")), '{"b": 1, "c": 2}', "json", None)


def test_nested_templates_and_arrays(values):
    out = obj(items={"array": [{"xpath": "items/*", "template": "item"}]})
    got = values(out, '{"items": [{"n": 1, "t": "a"}, {"n": 2}]}', "json", None, item=obj(id=x("n", "int"), tag=x("t"), up=x("../../name")))
    assert got == [{"items": [{"id": 1, "tag": "a"}, {"id": 2}]}]


def test_copy_and_dynamic_paths(values):
    doc = '{"a": {"b": [1, true, null, "x"], "c": {}}, "pick": "a/c", "n": 1e3}'
    assert values(func("copy"), doc, "json", None)[0]["a"]["b"] == [1, True, None, "x"]
    assert values(obj(v={"xpath_dynamic": x("pick"), "custom_func": {"name": "copy", "args": []}, "keep_empty_or_null": True}, n=x("n", "int")), doc, "json", None)[0]["n"] == 1000


def test_rendering():
    assert render({"b": 1.0, "a": "<x&>", "c": [None, True, 1e21, 1e-7]}) == '{"a":"\\u003cx\\u0026\\u003e","b":1,"c":[null,true,1e+21,1e-7]}'
    assert [plain_number(v) for v in (1e7, 0.1, 1e-7, -0.0)] == ["10000000", "0.1", "0.0000001", "-0"]
    n = Node(DOC)
    for k, v in (("a", "1"), ("b", "2"), ("a", "3")):
        n.leaf(k, v)
    assert to_value(n) == {"a": ["1", "3"], "b": "2"}


# --- functions --------------------------------------------------------------


@pytest.mark.parametrize("s", ["", "a", "été", "{}"])
def test_name_uuids(s):
    assert builtin.uuid_v3(s) == str(uuid.uuid3(uuid.UUID(int=0), s))


def test_the_checksum_of_an_empty_object():
    assert builtin.uuid_v3("{}") == "41665284-dab9-300d-b647-7ace9cb514b4"


@pytest.mark.parametrize(
    "args,want",
    [
        (("2031/02/03", "", ""), "2031-02-03T00:00:00"), (("02/03/2031 23:01:09", "", ""), "2031-02-03T23:01:09"), (("02-03-2031  23:01:09Z", "", ""), "2031-02-03T23:01:09Z"),
        (("07/04/31T23:01:09-Europe/Madrid", "", ""), "2031-07-04T23:01:09+02:00"), (("2031/02/03T23:01:09-0330", "", ""), "2031-02-03T23:01:09-03:30"), (("20310203T230109", "", ""), "2031-02-03T23:01:09"),
        (("203102032301", "", ""), "2031-02-03T23:01:00"), (("19990131", "", ""), "1999-01-31T00:00:00"), (("2031/02/03T23:01:09+07", "Asia/Seoul", "UTC"), "2031-02-03T16:01:09Z"),
        (("2031/02/03T23:01:09", "Europe/Madrid", "Asia/Seoul"), "2031-02-04T07:01:09+09:00"), (("2031/02/03T23:01:09", "", "Asia/Seoul"), "2031-02-03T23:01:09+09:00"), (("", "", ""), ""),
    ],
)
def test_date_times(args, want):
    assert dt.to_rfc3339(*args) == want


def test_date_time_errors_layouts_and_epochs():
    with pytest.raises(ValueError, match="unable to parse 'x'"):
        dt.to_rfc3339("x")
    with pytest.raises(ValueError):
        dt.to_rfc3339("2020/01/01", "No/Where")
    with pytest.raises(ValueError):
        dt.layout_to_rfc3339("", "2006", "maybe")
    assert dt.layout_to_rfc3339("30.11.2031 09:07 PM", "02.01.2006 03:04 PM", "false", "", "UTC") == "2031-11-30T21:07:00Z"
    assert dt.to_epoch("2020-01-01T00:00:01Z", "", "MILLISECOND") == "1577836801000"
    assert dt.from_epoch("-1", "SECOND") == "1969-12-31T23:59:59Z"
    with pytest.raises(ValueError):
        dt.from_epoch("1", "HOUR")


@pytest.mark.parametrize(
    "code,args,want",
    [
        ("p * q", {"p": 3, "q": 4}, 12), ("u==='m'?'metre':'foot'", {"u": "m"}, "metre"), ("Math.ceil(c * 18 / 10 + 32)", {"c": 21}, 70), ("l.split(';').map(function(w) { return w.trim() }).filter(w => w !== '')", {"l": " p ;q; "}, ["p", "q"]),
        ("n=1; for (k=0; k<m.length; k++) { n *= m[k]; } n", {"m": [2, 1.5, 4]}, 12), ("JSON.parse(d).rows[0].id", {"d": '{"rows":[{"id":"r7"}]}'}, "r7"), ("h ? parseFloat(h) : 'none'", {"h": ""}, "none"), ("if (k) { 'on' } else { 'off' }", {"k": 0}, "off"),
        ("/^[a-f]+$/.test(h)", {"h": "beef"}, True), ("parseFloat(r).toFixed(1)", {"r": "2.25kg"}, "2.3"), ("w.toLowerCase().substring(2, 4)", {"w": "QRSTU"}, "st"), ("`${k * 2}/${k}`", {"k": 4}, "8/4"),
    ],
)
def test_scripts(code, args, want):
    assert run_script(code, args) == want


@pytest.mark.parametrize("code", ["0/0", "1/0", "null", "undefined", "throw 'x'", "a.b.c", "var ="])
def test_scripts_that_fail(code):
    with pytest.raises(Exception):
        run_script(code, {})
    assert run_script("typeof leaked", {}) == "undefined"


@pytest.mark.parametrize("code", ["while (true) {}", "for (;;) { x = 1; }", "do { x = 1 } while (1)", "function f() { return f() } f()", "i = 0; while (i >= 0) { i++; } i"])
def test_scripts_that_do_not_end_are_errors(monkeypatch, code):
    from sluicegate.functions import script

    monkeypatch.setattr(script, "STEPS", 5000)
    with pytest.raises(Exception):
        run_script(code, {})


def test_xpath_core():
    n = Node(DOC)
    for i in range(3):
        b = n.add(Node(1, "b"))
        b.leaf("v", str(i))
    pick = lambda p: [m.text() for m in xp.select(n, p)]
    assert pick("b/v") == ["0", "1", "2"] and pick("b[2]/v") == ["1"] and pick("b[last()]/v") == ["2"] and pick("b[v > 0]/v") == ["1", "2"]
    assert pick("b[v != '0' and not(v = 2)]") == ["1"] and pick("//v[contains(., '2')]") == ["2"] and pick("b/v/../..") == ["012"] and pick("*[position() < 3]") == ["0", "1"]


# --- readers ----------------------------------------------------------------


@settings(max_examples=80, deadline=None)
@given(st.lists(st.lists(st.text(alphabet='ab,"\n é', max_size=5), min_size=2, max_size=3), max_size=4))
def test_quoted_rows_round_trip(rows):
    text = "".join(",".join('"' + c.replace('"', '""') + '"' for c in r) + "\n" for r in rows)
    assert [r for _, r in csv_rows(text, ",")] == rows


def fatal(spark, s, text):
    df = spark.createDataFrame([("f", text)], "n string, t string")
    return [(r["value"], r["fatal"]) for r in Engine(spark).compile(s).rows(df, "t", "n").orderBy("rec_no").collect()]


def test_fatal_errors_keep_what_came_before(spark):
    s = schema("csv", obj(a=x("A")), {"delimiter": ",", "header_row_index": 1, "data_row_index": 2, "columns": columns("A")})
    assert fatal(spark, s, "A\n1\n2") == [('{"a":"1"}', False), ('{"a":"2"}', False)]
    assert fatal(spark, s, "B\n1") == [(None, True)]
    assert fatal(spark, s, 'A\n1\nx"y\n2') == [('{"a":"1"}', False), (None, False), ('{"a":"2"}', False)]
    assert [f for _, f in fatal(spark, schema("xml", obj("r/a", a=x("."))), "<r><a>1</a><a>2</b></r>")] == [False, True]


def test_json_that_breaks_off_keeps_what_came_before(spark):
    s = schema("json", obj("/*", a=x("a")))
    assert [f for _, f in fatal(spark, s, '[{"a":1}, {"a":')] == [False, True]
    for broken in ('[{"a":1}, {a:2}]', '[{"a":1} {"a":2}]', '[{"a":1}, {"a" 2}]', '[{"a":1}, NaN]', '[{"a":1}, "x\ny"]', "[" + '{"a":1},' * 3 + "[" * 5000):
        assert fatal(spark, s, broken)[0] == ('{"a":"1"}', False) and fatal(spark, s, broken)[-1] == (None, True)


@settings(max_examples=60, deadline=None)
@given(st.recursive(st.none() | st.booleans() | st.integers(-9, 9) | st.text(alphabet='a"\\ é{[', max_size=3), lambda v: st.lists(v, max_size=3) | st.dictionaries(st.text(alphabet="ab", max_size=1), v, max_size=3), max_leaves=8))
def test_json_read_in_pieces_is_the_json_read_at_once(value):
    from sluicegate.sources.readers import Json

    form = Json(schema("json", obj(a=x("a"))), None)
    text, docs = json.dumps(value, indent=1), (Node(DOC, tag="json-root"), Node(DOC, tag="json-root"))
    whole = [*form.records("", text)]
    for _ in form.partly(docs[0], text, 0, None, docs[0]):
        pass
    assert render(to_value(docs[0])) == render(to_value(whole[0]))


def test_modes(spark):
    s = schema("csv2", obj(a=x("A", "int")), PIPE)
    df = spark.createDataFrame([("1|\nx|\n3|",)], "text string")
    n = lambda mode: Engine(spark).compile(s, mode=mode).rows(df).count()
    assert n("PERMISSIVE") == 3 and n("DROP") == 2
    with pytest.raises(Exception):
        n("FAILFAST")


OUT = obj(".[B != 'a']", n=x("A", "float"), t=x("B"), up=func("upper", x("B")), both=func("concat", x("A"), "-", x("B")), s={"array": [x("A"), x("B")]})
CELL = st.sampled_from(["1", "-7", " 5 ", "x", "", "1.5", "1e400", "K", "a", " b ", "é", "A", '"q|r"', '"d""e"', '"open', 'bare"quote', '""', "'s'"])
FORMS = {
    "csv2": {"delimiter": "|", "records": [{"columns": columns("A", "B")}]},
    "csv2 header": {"delimiter": "|", "records": [{"name": "H", "header": "^K", "max": 1}, {"name": "R", "is_target": True, "columns": columns("A", "B")}]},
    "csv2 required": {"delimiter": "|", "records": [{"name": "H", "header": "^K", "min": 1, "max": 1}, {"name": "R", "is_target": True, "header": "[^z]$", "columns": columns("A", "B")}]},
    "csv": {"delimiter": "|", "header_row_index": 2, "data_row_index": 3, "columns": columns("A", "B")},
    "csv replaced": {"delimiter": "|", "replace_double_quotes": True, "data_row_index": 2, "columns": columns("A", "B")},
    "fixedlength2": {"envelopes": [{"columns": [{"name": "A", "start_pos": 1, "length": 3}, {"name": "B", "start_pos": 4, "length": 2}]}]},
}


@pytest.mark.parametrize("form", FORMS)
@settings(max_examples=5, deadline=None, phases=(Phase.explicit, Phase.generate), suppress_health_check=[*HealthCheck])
@given(inputs=st.lists(st.lists(st.lists(CELL, min_size=1, max_size=3), min_size=1, max_size=6), min_size=1, max_size=6), head=st.booleans(), mode=st.sampled_from(["PERMISSIVE", "DROP"]))
def test_the_front_doors_give_what_the_row_plan_gives(spark, form, inputs, head, mode):
    texts = ["\n".join((["", "A| B |C"] if head else []) + ["|".join(r) + "\r" * (len(r) == 3) for r in rows]) for rows in inputs]
    df = spark.createDataFrame([*enumerate(texts), (99, None)], "i int, text string").withColumn("name", F.concat(F.lit("i"), "i"))
    plan = Engine(spark).compile(schema(form.split()[0], OUT, FORMS[form]), mode=mode)
    assert plan.is_native
    by_rows = plan.rows(df, "text", "name")
    want = sorted(map(repr, (tuple(r) for r in plan.typed(by_rows).collect())))
    assert sorted(map(repr, (tuple(r) for r in plan.transform_df(df, "text", "name").collect()))) == want
    text_plan = Engine(spark).compile(schema(form.split()[0], obj(".[B != 'a']", t=x("B"), n=x("A", "int"), odd=func("concat", "<&\\\"\u2028>", x("A"))), FORMS[form]), mode=mode)
    rows = lambda d: sorted(repr(tuple(r)) for r in d.select("input_name", "rec_no", "value", "error", "fatal").collect())
    assert rows(text_plan.transform_texts(df, "text", "name")) == rows(text_plan.rows(df, "text", "name"))


def test_lines_that_are_no_records_are_errors(spark):
    plan = Engine(spark).compile(schema("csv2", obj(a=x("A"), b=x("B")), FORMS["csv2 required"]))
    lines = [("K", True), ("K", False), ('"u|v"|w', False), ('x"y|z', False), ("end z", False), ("", False)]
    got = [(r["a"], r["b"], r["_error"] is None) for r in plan.lines(spark.createDataFrame(lines, "line string, first boolean"), first="first").collect()]
    assert sorted(got, key=str) == sorted([("K", None, True), ("u|v", "w", True), (None, None, False), (None, None, False)], key=str)
    with pytest.raises(Exception, match="first lines"):
        plan.lines(spark.createDataFrame(lines, "line string, first boolean"))


def test_generated_code_stays_small(spark, data):
    """Operands are bound once, and no method is too long for the JVM to compile."""
    from sluicegate.plans.catalogue import QUERIES

    for name in ("script_arith", "script_case", "fn_datetime_rfc3339"):
        plan = QUERIES[name](spark, data)._jdf.queryExecution()
        codes = plan.debug().codegenToSeq()
        sizes = [codes.apply(i)._3().maxMethodCodeSize() for i in range(codes.size())]
        assert sizes and 0 < max(sizes) < 8000 and len(plan.optimizedPlan().toString()) < 120_000


def test_files_sinks_and_streams(spark, tmp_path):
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "a.csv").write_bytes("﻿1|é\n2|b".encode())
    plan = Engine(spark).compile(schema("csv2", obj(a=x("A", "int"), b=x("B")), PIPE))
    rows = plan.transform_files(str(tmp_path / "in"))
    want = [{"a": 1, "b": "é"}, {"a": 2, "b": "b"}]
    assert json.loads("".join(json_array(rows))) == want
    q = stream_files(plan, str(tmp_path / "in")).writeStream.format("memory").queryName("streamed").trigger(availableNow=True).option("checkpointLocation", str(tmp_path / "c")).start()
    q.awaitTermination()
    assert [json.loads(r["value"]) for r in spark.sql("select value from streamed order by rec_no").collect()] == want


def test_framing_across_stream_batches(spark, tmp_path):
    src = tmp_path / "lines"
    src.mkdir()
    one = "input_name string, line_no long, line string"
    for k, part in enumerate([["B1", "x"], ["y", "E"], ["B2", "E", "noise"]]):
        spark.createDataFrame([("i", k * 10 + j, v) for j, v in enumerate(part)], one).coalesce(1).write.mode("append").json(str(src))
        q = frame_lines(spark.readStream.schema(one).json(str(src)), Framer(header="^B", footer="^E")).writeStream.format("parquet").option("path", str(tmp_path / "out")).option("checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True).start()
        q.awaitTermination()
    assert sorted(r["text"] for r in spark.read.parquet(str(tmp_path / "out")).collect()) == ["B1\nx\ny\nE", "B2\nE"]


def test_the_rest_works_without_the_training_data_operators(tmp_path):
    """On a copy that lacks both folders and the pipeline."""
    root = __file__.rsplit("/tests/", 1)[0]
    shutil.copytree(root, tmp_path / "copy", ignore=lambda d, names: [n for n in names if n in ("llm", "corpus_pipeline.py", ".git", "__pycache__", ".hypothesis", ".pytest_cache")])
    code = "import __spark_entry__ as e; assert len(e.queries()) == len(e.oracle_sql()) > 50"
    assert subprocess.run([sys.executable, "-c", code], cwd=tmp_path / "copy", timeout=120, env={**os.environ, "PYTHONPATH": ""}).returncode == 0


def test_native_plans_run_no_python(spark, data):
    from sluicegate.plans.catalogue import QUERIES

    for name in ("csv2_single_row", "script_arith", "fixed2_single_row", "fn_epoch_to_dt", "fn_datetime_rfc3339", "fn_datetime_layout", "fn_epoch", "fn_epoch_to_zone", "native_quoted_cells"):
        text = QUERIES[name](spark, data)._jdf.queryExecution().toString()
        assert "Python" not in text and "Arrow" not in text
    assert F is not None


def test_an_input_is_split_into_lines_once(spark):
    """Not again for each of its lines, as it was where the header decides which lines are data."""
    declaration = {"delimiter": "|", "records": [{"name": "H", "header": "^K", "max": 1}, {"name": "R", "is_target": True, "columns": columns("A", "B")}]}
    inputs = spark.range(3).select(F.col("id").cast("string").alias("n"), F.concat_ws("\n", F.lit("K|n"), F.transform(F.sequence(F.lit(1), F.lit(3000)), lambda i: F.concat(F.lit("K"), i.cast("string"), F.lit("|b")))).alias("t"))
    out = Engine(spark).compile(schema("csv2", obj(a=x("A"), b=x("B")), declaration)).transform_df(inputs, "t", "n")
    assert out._jdf.queryExecution().optimizedPlan().toString().count("\n, -1)") == 2  # one for each of the two plans
    assert out.groupBy("input_name").agg(F.count("a"), F.min("rec_no"), F.max("rec_no"), F.min("a"), F.max(F.length("a"))).orderBy("input_name").collect() == [(str(i), 3000, 1, 3000, "K1", 5) for i in range(3)]


def test_a_large_xml_document_takes_time_in_proportion(spark):
    """The parent's children, among them the text between the records, aren't gone through for each record."""
    plan = Engine(spark).compile(schema("xml", obj("ps/p", id=x("@id", "int"), brand=x("../brand"))))

    def seconds(n):
        text = "<ps><brand>b</brand>\n" + "\n".join(f'<p id="{i}"> <n>x</n></p>' for i in range(n)) + "</ps>"
        began = time.process_time()
        assert plan.transform_text(text) == [{"id": i, "brand": "b"} for i in range(n)]
        return time.process_time() - began

    assert seconds(12000) < 30 * seconds(1000)


def test_children_by_name_follow_the_tree():
    n = Node(DOC)
    kids = [n.leaf("ab"[i % 2], str(i)) for i in range(40)]
    assert [c.text() for c in xp.select(n, "a")] == [str(i) for i in range(0, 40, 2)]
    kids[0].detach(), kids[38].detach(), n.leaf("a", "new")
    assert [c.text() for c in xp.select(n, "a")] == [*(str(i) for i in range(2, 38, 2)), "new"]
    assert xp.select(n, "p:a") == [] and len(xp.select(n, "*")) == 39


def test_the_row_plan_uses_all_cores(spark, tmp_path):
    """Rows of a file that is one task's scan are interpreted by many tasks; a few rows aren't spread."""
    plan = Engine(spark).compile(schema("csv2", obj(a=x("A")), PIPE))
    spark.range(50000).select(F.concat(F.col("id").cast("string"), F.lit("|"), F.md5(F.col("id").cast("string"))).alias("t")).coalesce(1).write.parquet(f"{tmp_path}/many")
    out = plan.rows(spark.read.parquet(f"{tmp_path}/many"), "t")
    assert out.groupBy(F.spark_partition_id()).count().count() >= spark.sparkContext.defaultParallelism
    assert out.select(F.countDistinct("value")).first()[0] == 50000
    few = spark.createDataFrame([("1|x",)], "t string").coalesce(1)
    assert plan.rows(few, "t").select("value").collect() == [('{"a":"1"}',)]


@pytest.mark.parametrize("most, form", [(850, "json"), (1150, "csv2")])
def test_the_interpreter_takes_few_calls_a_record(most, form):
    """What no record is in is read without a generator for each node; the records stay the same."""
    ids = range(200)
    if form == "json":
        s = schema("json", obj("/o/*[k]", k=x("k", "int"), q={"array": [x(".//q", "float")]}, p=x("i/*[position()=2]/p"), r={"array": [x("i/*[f='R']/p")]}))
        text = json.dumps({"o": [None, *({"k": i, "i": [{"p": j, "q": j + 0.5, "f": "RA"[j % 2]} for j in range(4)]} for i in ids)]})
    else:
        d = {"delimiter": ",", "records": [{"name": "H", "header": "^H", "is_target": True, "columns": [{"name": "K", "index": 2}], "child_records": [{"name": "G", "type": "record_group", "child_records": [{"name": "D", "header": "^D", "columns": [{"name": "P", "index": 2}], "child_records": [{"name": "E", "header": "^E", "max": 1, "columns": [{"name": "Q", "index": 2}]}]}]}]}]}
        s = schema("csv2", obj(k=x("K", "int"), p=x("G/D[position()=2]/P"), q={"array": [x(".//Q", "float")]}, r={"array": [x("G/D[P='0' or P='2']/P")]}), d)
        text = "\n".join(f"H,{i}\n" + "\n".join(f"D,{j}\nE,{j}.5" for j in range(4)) for i in ids)
    program = Program(s, dict(builtin.BUILTIN), {}, dict(FORMATS))
    program.ready()
    calls = cProfile.Profile()
    got = calls.runcall(lambda: [json.loads(v) for _, v, _, _, _ in program.run("", text, {}, False)])
    assert got == [{"k": i, "p": "1", "q": [0.5, 1.5, 2.5, 3.5], "r": ["0", "2"]} for i in ids]
    assert pstats.Stats(calls).total_calls / len(ids) < most
