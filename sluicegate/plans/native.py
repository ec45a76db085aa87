"""The native plan: schemas whose records are single lines, as Catalyst expressions.

A declaration becomes a pair of columns (value, error); the error half is left
out where nothing can fail.  What is used more than once is bound to a column
of its own, so that expressions stay as small as their declarations.  Whatever
can't be compiled raises Unsupported, and the plan's front doors then take the
row interpreter.
"""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, functions as F

from ..functions import columns as fc
from ..operators import nodes, xpath as xp
from ..operators.evaluate import SPACE
from ..schema.bind import Decl
from ..sources import readers
from .script_lowering import lower


class Unsupported(Exception):
    """The schema needs the row interpreter."""


def trim(c: Column) -> Column:
    return F.btrim(c, F.lit(SPACE))


#: What the row interpreter says of texts that don't convert.
_REASON = {"int": "no whole number of 64 bits", "float": "no number, or one out of range", "boolean": "neither true nor false"}


def cast(c: Column, kind: str, to: str) -> tuple[Column, Column | None]:
    """(cast value, whether it fails) of a non-null value of ``kind``."""
    if kind == to:
        return c, None
    if kind == "string":
        if to == "int":
            v = F.when(c.rlike(r"^[+-]?[0-9]+$"), c.try_cast("bigint"))
        elif to == "float":
            v = F.when(c.rlike(r"^[+-]?(?:[0-9]+\.?[0-9]*|\.[0-9]+)(?:[eE][+-]?[0-9]+)?$"), c.try_cast("double"))
            v = F.when(F.abs(v) != float("inf"), v)
        else:
            v = F.when(c.isin("1", "t", "T", "TRUE", "true", "True"), F.lit(True)).when(c.isin("0", "f", "F", "FALSE", "false", "False"), F.lit(False))
        return v, c.isNotNull() & v.isNull()
    if (kind, to) == ("int", "float"):
        return c.cast("double"), None
    if (kind, to) == ("float", "int"):
        return c.cast("bigint"), None
    if to == "string" and kind in ("int", "boolean"):
        return c.cast("string"), None
    raise Unsupported(f"cast of {kind} to {to}")


class Node:
    """A compiled declaration."""

    def __init__(self, value: Column, kind, error: Column | None = None):
        self.value, self.kind, self.error = value, kind, error


def first_error(errors: list[Column | None]) -> Column | None:
    errors = [e for e in errors if e is not None]
    return F.coalesce(*errors) if len(errors) > 1 else errors[0] if errors else None


class Compiler:
    """Declarations over a flat record of string columns."""

    def __init__(self, fields: dict[str, Column], external: dict[str, str], column_functions: dict | None = None, bind=lambda c: c):
        self.fields, self.external, self.own, self.bind = fields, external, column_functions or {}, bind

    # -- paths -------------------------------------------------------------

    def path(self, xpath: str | None) -> Column | None:
        """The text a path selects; None for the record itself."""
        if xpath is None or xpath == ".":
            return None
        e = xp.parse(xpath)
        if e[0] != "path" or e[1] is not None:
            raise Unsupported(xpath)
        steps = [s for s in e[2] if s != ("self", ("node",), [])]
        if not steps:
            return None
        if len(steps) != 1 or steps[0][0] != "child" or steps[0][2] or steps[0][1][0] != "name" or steps[0][1][1]:
            raise Unsupported(xpath)
        return self.fields.get(steps[0][1][2], F.lit(None).cast("string"))

    def everything(self) -> Column:
        return F.concat_ws("", *self.fields.values())

    def predicate(self, selector: str | None) -> Column | None:
        """The record selector as a filter."""
        if selector is None or selector == ".":
            return None
        e = xp.parse(selector)
        if e[0] != "path" or e[1] is not None or len(e[2]) != 1 or e[2][0][0] != "self":
            raise Unsupported(selector)
        out = None
        for p in e[2][0][2]:
            c = self.truth(p)
            out = c if out is None else out & c
        return None if out is None else F.coalesce(out, F.lit(False))

    def operand(self, e) -> tuple[Column, str]:
        if e[0] == "lit":
            return F.lit(e[1]), "string"
        if e[0] == "num":
            return F.lit(e[1]), "number"
        if e[0] == "path" and e[1] is None and len(e[2]) == 1:
            axis, test, preds = e[2][0]
            if not preds and axis == "child" and test[0] == "name" and not test[1]:
                return self.fields.get(test[2], F.lit(None).cast("string")), "node"
            if not preds and axis == "self":
                return self.everything(), "node"
        if e[0] == "call" and e[1] in ("lower-case", "upper-case", "normalize-space", "string") and len(e[2]) == 1:
            c, _ = self.operand(e[2][0])
            c = F.coalesce(c, F.lit(""))
            return {"lower-case": F.lower, "upper-case": F.upper, "normalize-space": lambda x: F.trim(F.regexp_replace(x, r"\s+", " ")), "string": lambda x: x}[e[1]](c), "string"
        if e[0] == "call" and e[1] == "string-length" and len(e[2]) == 1:
            return F.length(F.coalesce(self.operand(e[2][0])[0], F.lit(""))).cast("double"), "number"
        raise Unsupported(str(e))

    def truth(self, e) -> Column:
        if e[0] == "bin" and e[1] in ("and", "or"):
            a, b = F.coalesce(self.truth(e[2]), F.lit(False)), F.coalesce(self.truth(e[3]), F.lit(False))
            return a & b if e[1] == "and" else a | b
        if e[0] == "bin" and e[1] in ("=", "!=", "<", "<=", ">", ">="):
            (a, ka), (b, kb) = self.operand(e[2]), self.operand(e[3])
            if e[1] in ("<", "<=", ">", ">=") or "number" in (ka, kb):
                a, b = (c if k == "number" else F.coalesce(F.when(F.trim(c).rlike(r"^-?(?:[0-9]+\.?[0-9]*|\.[0-9]+)$"), F.trim(c).try_cast("double")), F.lit(None)) for c, k in ((a, ka), (b, kb)))
            # a missing node or a text that is no number compares to nothing
            return {"=": a == b, "!=": a != b, "<": a < b, "<=": a <= b, ">": a > b, ">=": a >= b}[e[1]]
        if e[0] == "call":
            if e[1] == "not" and len(e[2]) == 1:
                return ~F.coalesce(self.truth(e[2][0]), F.lit(False))
            if e[1] in ("true", "false"):
                return F.lit(e[1] == "true")
            if e[1] in ("starts-with", "ends-with", "contains") and len(e[2]) == 2:
                a, b = (F.coalesce(self.operand(x)[0], F.lit("")) for x in e[2])
                return {"starts-with": F.startswith, "ends-with": F.endswith, "contains": F.contains}[e[1]](a, b)
            if e[1] == "matches" and len(e[2]) == 2 and e[2][1][0] == "lit":
                return F.coalesce(self.operand(e[2][0])[0], F.lit("")).rlike(e[2][1][1])
        if e[0] == "path":
            return self.operand(e)[0].isNotNull()
        raise Unsupported(str(e))

    # -- declarations ------------------------------------------------------

    def compile(self, d: Decl, here: Column | None = None, moved: bool = False) -> Node:
        """``here`` is the text of the current node, None for the record."""
        if d.dynamic is not None or d.kind == "custom_parse":
            raise Unsupported(d.name)
        if d.kind == "const":
            return self.settle(Node(F.lit(d.value), "string"), d)
        if d.kind == "external":
            if d.value not in self.external:
                return Node(F.lit(None).cast("string"), "string", F.lit(f"cannot find external property '{d.value}' on '{d.name}'"))
            return self.settle(Node(F.lit(self.external[d.value]), "string"), d)
        if d.kind == "array":
            return self.array(d, here)
        present = None
        if not moved and d.xpath is not None and d.xpath != ".":
            if here is not None:
                raise Unsupported(d.xpath)
            here = self.path(d.xpath)
            present = None if here is None else here.isNotNull()
        if d.kind == "field":
            return self.settle(Node(self.everything() if here is None else here, "string"), d)
        if d.kind == "object":
            return self.object(d, here, present)
        return self.settle(self.call(d, here, present), d)

    def settle(self, n: Node, d: Decl) -> Node:
        v, error, kind = n.value, n.error, n.kind
        if kind == "string" and not d.no_trim:
            v = trim(v)
        if d.type is not None and not isinstance(kind, tuple):
            v = self.bind(v)
            new, fails = cast(v, kind, d.type)
            if fails is not None:
                new = self.bind(new)
                fails = v.isNotNull() & new.isNull()
                told = F.when(fails, F.concat(F.lit("fail to convert value '"), v, F.lit(f"' to type '{d.type}' on '{d.name}': {_REASON[d.type]}")))
                error = first_error([error, told])
            v, kind = new, d.type
        if kind == "string" and not d.keep:
            v = self.bind(v)
            v = F.when(v != "", v)
        return Node(self.bind(v) if d.kind == "custom_func" else v, kind, error)

    def object(self, d: Decl, here, present) -> Node:
        if d.keep:
            raise Unsupported(d.name)
        kids = [(k, self.compile(c, here)) for k, c in d.children]
        if not kids:
            raise Unsupported(d.name)
        value = F.struct(*[n.value.alias(k) for k, n in kids])
        some = None
        for _, n in kids:
            some = n.value.isNotNull() if some is None else some | n.value.isNotNull()
        if present is not None:
            some = present & some
        return Node(F.when(some, value), ("struct", {k: n.kind for k, n in kids}), first_error([n.error for _, n in kids]))

    def array(self, d: Decl, here) -> Node:
        kids = []
        for _, c in d.children:
            if c.xpath is not None and c.xpath != ".":
                if here is not None:
                    raise Unsupported(c.xpath)
                kids.append(self.compile(c, self.path(c.xpath), moved=True))
            else:
                kids.append(self.compile(c, here, moved=True))
        kinds = {str(n.kind) for n in kids}
        if len(kinds) != 1:
            raise Unsupported("an array of different types")
        value = F.filter(F.array(*[n.value for n in kids]), lambda x: x.isNotNull())
        return Node(F.when(F.size(value) > 0, value), ("array", kids[0].kind), first_error([n.error for n in kids]))

    def call(self, d: Decl, here, present) -> Node:
        if present is not None and d.func not in ("javascript",):
            raise Unsupported(d.name)
        args = [self.compile(c, here) for _, c in d.children]
        errors = [a.error for a in args]
        if d.func in self.own:
            value, kind = self.own[d.func](*[F.coalesce(a.value, F.lit("")) if a.kind == "string" else a.value for a in args])
            return Node(value, kind, first_error(errors))
        if d.func == "javascript":
            if d.children[0][1].kind != "const":
                raise Unsupported(d.name)
            names = [c for _, c in d.children[1::2]]
            if len(d.children) % 2 == 0 or any(c.kind != "const" for c in names):
                raise Unsupported(d.name)
            if any(a.kind not in ("string", "int", "float", "boolean") for a in args[2::2]):
                raise Unsupported(d.name)
            got = lower(d.children[0][1].value, {c.value: (self.bind(a.value), a.kind) for c, a in zip(names, args[2::2])}, self.bind)
            if got is None:
                raise Unsupported(d.name)
            value, kind, fails = got
            told = None if fails is None or d.ignore_error else F.when(fails, F.lit(f"fail to transform '{d.name}'"))
            if fails is not None:
                value = F.when(~F.coalesce(fails, F.lit(False)), value)
            if present is not None:
                value = F.when(present, value)
                told = None if told is None else F.when(present, told)
            return Node(value, kind, first_error([*errors, told]))
        f = fc.COLUMN_FUNCTIONS.get(d.func)
        if f is None or any(a.kind != "string" for a in args):
            raise Unsupported(d.func)
        consts = [c.value if c.kind == "const" else None for _, c in d.children]
        got = f([F.coalesce(a.value, F.lit("")) for a in args], consts, self.bind)
        if got is None:
            raise Unsupported(d.func)
        value, fails = got
        told = None
        if fails is not None:
            told = None if d.ignore_error else F.when(fails, F.lit(f"fail to transform '{d.name}'"))
            value = F.when(~F.coalesce(fails, F.lit(False)), value)
        return Node(value, "string", first_error([*errors, told]))


def ddl(kind) -> str:
    """The SQL type of a compiled kind."""
    if isinstance(kind, tuple):
        if kind[0] == "array":
            return f"array<{ddl(kind[1])}>"
        return "struct<" + ",".join(f"`{k}`:{ddl(v)}" for k, v in kind[1].items()) + ">"
    return {"string": "string", "int": "bigint", "float": "double", "boolean": "boolean"}[kind]


# --- framing ---------------------------------------------------------------

#: Stand for a delimiter and a quote inside of a quoted cell; a line that holds one of them is not read natively.
_MARKS = "\x01\x02"
_SINGLE = "records of several lines"


def quoted_parts(line: Column) -> Column:
    """The line cut at its quotes: what is outside of quotes stands at odd places."""
    return F.split(line, '"', -1)


def malformed(line: Column, delim: str) -> Column:
    """Whether a line's quotes don't enclose whole cells of it."""
    parts = quoted_parts(line)
    n = F.size(parts)
    d = F.lit(delim)

    def fits(o: Column, i: Column) -> Column:
        # around a quoted cell there is a delimiter or the line's end; nothing between two quotes is a doubled quote
        opens = (i == 0) | F.startswith(o, d)
        closes = (i == n - 1) | F.endswith(o, d)
        return (i % 2 == 1) | (o == "") | (opens & closes)

    wrong = (n % 2 == 0) | F.exists(F.transform(parts, lambda o, i: ~fits(o, i)), lambda x: x) | line.rlike(f"[{_MARKS}]")
    return F.contains(line, F.lit('"')) & wrong


def split_quoted(line: Column, delim: str) -> Column:
    """The cells of a line that isn't malformed."""
    parts = quoted_parts(line)
    n = F.size(parts)
    marked = F.transform(
        parts,
        lambda o, i: F.when(i % 2 == 1, F.replace(o, F.lit(delim), F.lit(_MARKS[0]))).when((o == "") & (i > 0) & (i < n - 1), F.lit(_MARKS[1])).otherwise(o),
    )
    cells = F.split(F.array_join(marked, ""), re.escape(delim), -1)
    return F.transform(cells, lambda c: F.replace(F.replace(c, F.lit(_MARKS[0]), F.lit(delim)), F.lit(_MARKS[1]), F.lit('"')))


class Lines:
    """How single lines of a format become records; all its methods are of columns.

    ``header`` is the pattern of a record that may come first, once, and
    ``required`` tells whether it must; ``pattern`` is what records match.
    ``skip`` and ``names`` are the line numbers and header names of positional
    csv.  Raises Unsupported where records may span lines.
    """

    def __init__(self, fmt: readers.Format):
        self.fmt, self.header, self.required, self.pattern = fmt, None, False, None
        self.head_row = self.data_row = None
        self.delim, self.replace = None, False
        if isinstance(fmt, readers.Csv):
            d = fmt.decl
            self.delim, self.replace = d["delimiter"], d.get("replace_double_quotes", False)
            self.head_row, self.data_row = d.get("header_row_index"), d["data_row_index"]
            self.head_names = [c["name"].strip() for c in d["columns"]]
            self.columns = [(n, lambda c, i=i: F.get(c, F.lit(i))) for i, n in enumerate(fmt.names)]
            return
        if isinstance(fmt, readers.Fixed):
            if fmt.rows != 1 or any(p is not None for _, p, _ in fmt.envelopes[0][4]):
                raise Unsupported(_SINGLE)
            self.columns = [(c["name"], self._cut(c)) for c, _, _ in fmt.envelopes[0][4]]
            return
        if not isinstance(fmt, (readers.Csv2, readers.Fixed2)):
            raise Unsupported(type(fmt).__name__)
        *before, r = fmt.recs if fmt.recs[-1].target else [None, None]
        if r is None or len(before) > 1 or any(x.group or x.children for x in fmt.recs):
            raise Unsupported("records around the target")
        if r.decl.get("rows", 1) != 1 or "footer" in r.decl or r.max >= 0 or r.min > 0 or any(c.get("line_index", 1) != 1 or "line_pattern" in c for c in r.decl.get("columns", [])):
            raise Unsupported(_SINGLE)
        for o in before:
            if "header" not in o.decl or "footer" in o.decl or o.max != 1:
                raise Unsupported("records around the target")
            self.header, self.required = o.decl["header"], o.min > 0
        self.pattern = r.decl.get("header")
        if isinstance(fmt, readers.Fixed2):
            self.columns = [(c["name"], self._cut(c)) for c in r.decl.get("columns", [])]
        else:
            self.delim, self.replace = fmt.decl["delimiter"], fmt.decl.get("replace_double_quotes", False)
            self.columns = [(c["name"], lambda x, c=c: F.coalesce(F.get(x, F.lit(c["index"] - 1)), F.lit(""))) for c in r.decl.get("columns", [])]

    @staticmethod
    def _cut(c: dict):
        return lambda line: F.substring(line, c["start_pos"], c["length"])

    def clean(self, line: Column) -> Column:
        line = F.when(F.endswith(line, F.lit("\r")), F.left(line, F.length(line) - 1)).otherwise(line)
        return F.translate(line, '"', "'") if self.replace else line

    def odd(self, line: Column) -> Column | None:
        """Lines whose quotes need the row reader."""
        return None if self.delim is None or self.replace else malformed(line, self.delim)

    def cells(self, line: Column) -> Column:
        """What the columns are taken from: the cells, or the line itself."""
        if self.delim is None:
            return line
        plain = F.split(line, re.escape(self.delim), -1)
        return plain if self.replace else F.when(F.contains(line, F.lit('"')), split_quoted(line, self.delim)).otherwise(plain)

    def subject(self, line: Column) -> Column:
        """What patterns are matched with: the line without its quotes."""
        if self.delim is None or self.replace:
            return line
        return F.when(F.contains(line, F.lit('"')), F.array_join(split_quoted(line, self.delim), self.delim)).otherwise(line)

    def fields(self, cells: Column) -> dict[str, Column]:
        return {n: f(cells) for n, f in self.columns}


class Stages:
    """Columns computed once and then referred to by name.

    Whole-stage code is one method for all projections of a chain, and the JVM
    doesn't compile methods of 8,000 bytes and more.  So every tenth column goes
    through a higher-order function, which has no generated code; its
    projection ends one stage's method and the next one begins another.
    """

    APART = 10

    def __init__(self):
        self.made: list[tuple[str, Column]] = []

    def bind(self, c: Column) -> Column:
        name = f"_stage{len(self.made)}"
        if len(self.made) % self.APART == self.APART - 1:
            c = F.get(F.transform(F.array(c), lambda x: x), F.lit(0))
        self.made.append((name, c))
        return F.col(name)

    def over(self, df: DataFrame) -> DataFrame:
        for name, c in self.made:
            df = df.withColumn(name, c)
        return df


def once(c: Column, f) -> Column:
    """``f`` of a value that is computed once, not for each element that a function within ``f`` goes over."""
    return F.get(F.transform(F.array(c), f), F.lit(0))


def fixed(c: Column) -> Column:
    """A column that filters above it refer to; the optimizer would write out all that it is made of in them."""
    return F.when(F.spark_partition_id() >= 0, c)


def compile_lines(df: DataFrame, line_col: str, fmt: readers.Format, root: Decl, external: dict[str, str], column_functions: dict | None = None, first: str | None = None):
    """(DataFrame of records, node, error) of data lines, each of which is a record.

    ``first`` names a boolean column that tells which line is the first of its
    input; a schema whose inputs may begin with a header record needs it.
    """
    form = Lines(fmt)
    stages = Stages()
    line = stages.bind(form.clean(F.col(line_col)))
    cells = stages.bind(form.cells(line))
    c = Compiler(form.fields(cells), external, column_functions, stages.bind)
    node = c.compile(root, moved=True)
    keep = F.length(line) > 0
    told = []
    odd = form.odd(line)
    if odd is not None:
        told.append(F.when(odd, F.lit("the line's quotes don't enclose whole cells of it")))
    if form.header is not None:
        if first is None:
            raise Unsupported("a header record, and no column tells the first lines")
        head = F.col(first) & form.subject(line).rlike(form.header)
        keep = keep & ~head
        if form.required:
            told.append(F.when(F.col(first), F.lit("the input does not begin with its header record")))
    if form.pattern is not None:
        told.append(F.when(~form.subject(line).rlike(form.pattern), F.lit("the line starts no record")))
    where = c.predicate(fmt.selector)
    if where is not None:
        broken = F.coalesce(*told).isNotNull() if told else F.lit(False)
        keep = keep & (where | broken)
    error = first_error([*told, node.error])
    return stages.over(df).where(keep), node, F.lit(None).cast("string") if error is None else error


def compile_inputs(df: DataFrame, text_col: str, fmt: readers.Format, root: Decl, external: dict[str, str], column_functions: dict | None = None):
    """(inputs that aren't read here or None, the records of the others, node, error).

    The records have the columns of ``df`` and ``_no``, their number in the
    input.  Inputs with quotes over several lines or broken ones, without a
    header that must be there, or with lines that start no record are not
    read here.
    """
    form = Lines(fmt)
    stages = Stages()
    numbered = F.transform(F.split(F.col(text_col), "\n", -1), lambda x, i: F.struct((i + 1).alias("no"), form.clean(x).alias("line")))
    lines = F.filter(numbered, lambda s: F.length(s["line"]) > 0)
    good, sure = F.lit(True), form.head_row is None and not form.required and form.pattern is None
    if form.odd(F.lit("")) is not None:
        sure = False
        good = ~F.contains(F.col(text_col), F.lit('"')) | ~F.exists("_lines", lambda s: form.odd(s["line"]))
    head_no = F.lit(0)
    if form.head_row is not None:
        head = F.get(F.filter("_lines", lambda s: s["no"] >= form.head_row), F.lit(0))
        names = F.transform(form.cells(head["line"]), trim)
        good = good & F.coalesce((F.size(names) >= len(form.head_names)) & (F.slice(names, 1, len(form.head_names)) == F.array(*map(F.lit, form.head_names))), F.lit(False))
        head_no = head["no"]
    if form.header is not None:
        begins = F.coalesce(form.subject(F.get(F.col("_lines"), F.lit(0))["line"]).rlike(form.header), F.lit(False))
        if form.required:
            good = good & begins
        head_no = F.when(begins, F.get(F.col("_lines"), F.lit(0))["no"]).otherwise(0)
    start = form.data_row or 0
    data = once(F.col("_head"), lambda head: F.filter("_lines", lambda s: (s["no"] > head) & (s["no"] >= start)))
    if form.pattern is not None:
        good = good & ~F.exists("_data", lambda s: ~form.subject(s["line"]).rlike(form.pattern))
    base = df.withColumn("_lines", fixed(lines)).withColumn("_head", head_no).withColumn("_data", fixed(data)).withColumn("_good", F.coalesce(good, F.lit(False)))
    probe = Compiler({}, external, column_functions, stages.bind)
    if fmt.selector not in (None, "."):
        probe.predicate(fmt.selector)  # Unsupported before anything is built

    def chosen(s: Column) -> Column:
        return Compiler(form.fields(form.cells(s["line"])), external, column_functions, stages.bind).predicate(fmt.selector)

    kept = F.col("_data") if fmt.selector in (None, ".") else F.filter("_data", chosen)
    records = (base if sure else base.where("_good")).select(*df.columns, F.posexplode(kept).alias("_no", "_one"))
    cells = stages.bind(form.cells(F.col("_one.line")))
    node = Compiler(form.fields(cells), external, column_functions, stages.bind).compile(root, moved=True)
    records = stages.over(records.withColumn("_no", F.col("_no").cast("long") + 1))
    error = F.lit(None).cast("string") if node.error is None else node.error
    return None if sure else base.where("not _good").select(*df.columns), records, node, error


# --- JSON ------------------------------------------------------------------

_SPECIAL = "[\\x00-\\x1f\"\\\\<>&\u2028\u2029]"


def _json_string(c: Column) -> Column:
    out = F.replace(c, F.lit("\\"), F.lit("\\\\"))
    for code, escape in nodes.ESCAPES.items():
        if chr(code) != "\\":
            out = F.replace(out, F.lit(chr(code)), F.lit(escape))
    return F.concat(F.lit('"'), F.when(c.rlike(_SPECIAL), out).otherwise(c), F.lit('"'))


def json_text(value: Column, kind) -> Column:
    """The compact JSON of a compiled value, as the row plan renders it; Unsupported for floats."""
    if isinstance(kind, tuple) and kind[0] == "array":
        return F.concat(F.lit("["), F.array_join(F.transform(value, lambda x: json_text(x, kind[1])), ","), F.lit("]"))
    if isinstance(kind, tuple):
        pairs = [F.concat(F.lit(nodes.render(k) + ":"), json_text(value[k], v)) for k, v in sorted(kind[1].items(), key=lambda x: x[0].encode())]
        return F.concat(F.lit("{"), F.concat_ws(",", *pairs), F.lit("}"))
    if kind == "string":
        return _json_string(value)
    if kind in ("int", "boolean"):
        return value.cast("string")
    raise Unsupported("floats as JSON text")
