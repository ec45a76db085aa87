"""Readers: the text of one input to record trees, in order.

A reader yields nodes, or RecordError objects for records that can't be read
while the next ones can; it raises FatalError where reading must end.
"""

from __future__ import annotations

import json
import re
from collections.abc import Iterator
from xml.parsers import expat

from ..operators import xpath as xp
from ..operators.grammar import Units, build, run
from ..operators.nodes import ATTR, DOC, ELEM, TEXT, Node, plain_number
from ..schema import validate
from ..schema.errors import FatalError, RecordError, SchemaError


def _regex(p: str, what: str) -> re.Pattern:
    try:
        return re.compile(p)
    except re.error as e:
        raise SchemaError(f"{what} has an invalid regexp '{p}': {e}") from None


class Format:
    """A file format bound to a schema; ``selector`` is FINAL_OUTPUT's xpath."""

    def __init__(self, schema: dict, selector: str | None):
        self.schema, self.selector = schema, selector

    def keep(self, n: Node) -> bool:
        return self.selector is None or bool(xp.select(n, self.selector))

    def records(self, name: str, text: str) -> Iterator[Node | RecordError]:
        raise NotImplementedError


# --- delimited ------------------------------------------------------------


class BadRow(ValueError):
    pass


def csv_rows(text: str, delim: str, unquote: bool = False) -> Iterator[tuple[int, list[str] | BadRow]]:
    """(line number, cells) of the rows of a delimited text; blank lines are skipped.

    Quotes may enclose a cell, delimiters, line ends and doubled quotes; a
    quote elsewhere makes the row a BadRow.
    """
    if unquote:
        text = text.replace('"', "'")
    lines = text.split("\n")
    if lines and lines[-1] == "":
        lines.pop()
    at = 0
    while at < len(lines):
        line, no = lines[at].removesuffix("\r"), at + 1
        at += 1
        if not line:
            continue
        if '"' not in line:
            yield no, line.split(delim)
            continue
        cells, bad, i = [], None, 0
        while True:
            if i < len(line) and line[i] == '"':
                cell, i = [], i + 1
                while True:
                    j = line.find('"', i)
                    if j < 0:
                        cell.append(line[i:] + "\n")
                        if at >= len(lines):
                            bad = f'record on line {no}: extraneous or missing " in quoted-field'
                            break
                        line, i = lines[at].removesuffix("\r"), 0
                        at += 1
                        continue
                    cell.append(line[i:j])
                    i = j + 1
                    if i < len(line) and line[i] == '"':
                        cell.append('"')
                        i += 1
                        continue
                    if i < len(line) and not line.startswith(delim, i):
                        bad = f'parse error on line {no}, column {i + 1}: extraneous or missing " in quoted-field'
                    break
                cells.append("".join(cell))
            else:
                j = line.find(delim, i)
                cell = line[i:] if j < 0 else line[i:j]
                if '"' in cell:
                    bad = f'parse error on line {no}, column {i + cell.index(chr(34)) + 1}: bare " in non-quoted-field'
                cells.append(cell)
                i += len(cell)
            if bad or i >= len(line):
                break
            i += len(delim)
            if i >= len(line):
                cells.append("")
                break
        yield no, BadRow(bad) if bad else cells


class Csv(Format):
    """Delimited rows by position, with an optional header to verify."""

    def __init__(self, schema, selector):
        super().__init__(schema, selector)
        d = self.decl = validate.file_declaration(schema, "csv")
        head = d.get("header_row_index")
        if head is not None and head >= d["data_row_index"]:
            raise SchemaError(f"file_declaration.data_row_index({d['data_row_index']}) must be greater than file_declaration.header_row_index({head})")
        for key in ("name", "alias"):
            names = [c[key] for c in d["columns"] if key in c]
            for n in names:
                if names.count(n) > 1:
                    raise SchemaError(f"file_declaration.columns contains duplicate {key} '{n}'")
        for c in d["columns"]:
            if "alias" not in c and re.search(r"\s", c["name"]):
                raise SchemaError(f"column name '{c['name']}' contains space; an alias is needed")
        self.names = [c.get("alias", c["name"]) for c in d["columns"]]

    def records(self, name, text):
        d = self.decl
        rows = csv_rows(text, d["delimiter"], d.get("replace_double_quotes", False))
        head = d.get("header_row_index")
        if head is not None:
            own = next(((no, r) for no, r in rows if no >= head), None)
            if own is None:
                raise FatalError(f"input '{name}' line {head}: the input ends before its header")
            no, cells = own
            if isinstance(cells, BadRow):
                raise FatalError(f"input '{name}' line {no}: broken header: {cells}")
            if len(cells) < len(d["columns"]):
                raise FatalError(f"input '{name}' line {no}: the header has {len(cells)} cells for {len(d['columns'])} declared columns")
            for i, (c, x) in enumerate(zip(d["columns"], cells), 1):
                if c["name"].strip() != x.strip():
                    raise FatalError(f"input '{name}' line {no}: cell {i} of the header is '{x.strip()}', declared is '{c['name'].strip()}'")
        for no, cells in rows:
            if no < d["data_row_index"]:
                continue
            if isinstance(cells, BadRow):
                yield RecordError(f"input '{name}' line {no}: failed to fetch record: {cells}")
                continue
            n = Node(DOC)
            for c, x in zip(self.names, cells):
                n.leaf(c, x)
            if self.keep(n):
                yield n


def _columns(decls: list[dict], what: str) -> list[tuple[dict, re.Pattern | None, int | None]]:
    out = []
    for c in decls:
        if "line_index" in c and "line_pattern" in c:
            raise SchemaError(f"{what} column '{c['name']}' cannot have both 'line_index' and 'line_pattern'")
        out.append((c, _regex(c["line_pattern"], what) if "line_pattern" in c else None, c.get("line_index")))
    return out


class Lines(Units):
    """Rows or lines as the grammar's units; a unit is (line number, subject, cells)."""

    def __init__(self, name: str, units, cell):
        self.name, self.units, self.cell, self.at = name, units, cell, 0
        self.buffer: list = []
        self.prepared: dict[int, dict] = {}

    def unit(self, k: int):
        """The k-th unit from here, or None at the end."""
        while len(self.buffer) <= k:
            got = next(self.units, None)
            if got is None:
                return None
            if isinstance(got[1], BadRow):
                raise FatalError(f"input '{self.name}' line {got[0]}: {got[1]}")
            self.buffer.append(got)
        return self.buffer[k]

    def more(self):
        return self.unit(0) is not None

    def where(self):
        u = self.unit(0)
        return f"input '{self.name}' line {u[0] if u else self.at + 1}"

    def ready(self, r) -> dict:
        p = self.prepared.get(id(r))
        if p is None:
            p = self.prepared[id(r)] = _prepare(r)
        return p

    def span(self, r) -> int:
        """How many units an instance takes from here; 0 if none starts."""
        p = self.ready(r)
        if p["header"] is None:
            return p["rows"] if self.unit(p["rows"] - 1) is not None else 0
        if not p["header"].search(self.unit(0)[1]):
            return 0
        if p["footer"] is None:
            return 1
        k = 0
        while (u := self.unit(k)) is not None:
            if p["footer"].search(u[1]):
                return k + 1
            k += 1
        return 0

    def starts(self, r):
        return self.span(r) > 0

    def take(self, r, into):
        n = self.span(r)
        lines = self.buffer[:n]
        del self.buffer[:n]
        self.at = lines[-1][0]
        for c, pattern, index in self.ready(r)["columns"]:
            for i, line in enumerate(lines, 1):
                if (index is None or index == i) and (pattern is None or pattern.search(line[1])):
                    into.leaf(c["name"], self.cell(c, line))
                    break


def _prepare(r) -> dict:
    d = r.decl
    if "rows" in d and "header" in d:
        raise SchemaError(f"'{r.path}' cannot have both 'rows' and 'header'")
    if "footer" in d and "header" not in d:
        raise SchemaError(f"'{r.path}' has 'footer' but no 'header'")
    what = f"'{r.path}'"
    return {"rows": d.get("rows", 1), "header": _regex(d["header"], what) if "header" in d else None, "footer": _regex(d["footer"], what) if "footer" in d else None, "columns": _columns(d.get("columns", []), what)}


def _check_all(recs) -> None:
    for r in recs:
        if not r.group:
            _prepare(r)
        _check_all(r.children)


def _number_columns(decls: list[dict]) -> None:
    """A column without an index is the one after its predecessor."""
    for d in decls:
        last = 0
        for c in d.get("columns", []):
            last = c["index"] = c.get("index", last + 1)
        _number_columns(d.get("child_records", []))


class Csv2(Format):
    """Hierarchical delimited records."""

    def __init__(self, schema, selector):
        super().__init__(schema, selector)
        self.decl = json.loads(json.dumps(validate.file_declaration(schema, "csv2")))
        _number_columns(self.decl["records"])
        self.recs = build(self.decl["records"], "child_records", "record_group", 0, -1, False, "record")
        _check_all(self.recs)

    def records(self, name, text):
        delim = self.decl["delimiter"]
        units = ((no, r if isinstance(r, BadRow) else delim.join(r), r) for no, r in csv_rows(text, delim, self.decl.get("replace_double_quotes", False)))
        cell = lambda c, line: line[2][c["index"] - 1] if c["index"] <= len(line[2]) else ""
        root = Node(DOC, "#root")
        yield from run(self.recs, Lines(name, units, cell), root, self.keep)


def _plain_lines(text: str) -> Iterator[tuple[int, str, str]]:
    for no, line in enumerate(text.split("\n"), 1):
        line = line.removesuffix("\r")
        if line:
            yield no, line, line


def _cut(c: dict, line) -> str:
    return line[1][c["start_pos"] - 1 : c["start_pos"] - 1 + c["length"]]


class Fixed2(Format):
    """Hierarchical fixed-length records."""

    def __init__(self, schema, selector):
        super().__init__(schema, selector)
        self.decl = validate.file_declaration(schema, "fixedlength2")
        self.recs = build(self.decl["envelopes"], "child_envelopes", "envelope_group", 0, -1, False, "envelope")
        _check_all(self.recs)

    def records(self, name, text):
        yield from run(self.recs, Lines(name, _plain_lines(text), _cut), Node(DOC, "#root"), self.keep)


class Fixed(Format):
    """Fixed-length envelopes, by rows or by header and footer, in forward order."""

    def __init__(self, schema, selector):
        super().__init__(schema, selector)
        d = self.decl = validate.file_declaration(schema, "fixed-length")
        self.rows = None
        self.envelopes = []
        names = set()
        for i, e in enumerate(d["envelopes"]):
            name = e.get("name", str(i))
            if name in names:
                raise SchemaError(f"more than one envelope has the name '{name}'")
            names.add(name)
            columns = [c["name"] for c in e.get("columns", [])]
            for c in columns:
                if columns.count(c) > 1:
                    raise SchemaError(f"more than one column has the name '{c}' in envelope '{name}'")
            if ("by_rows" in e) and ("by_header_footer" in e):
                raise SchemaError(f"envelope '{name}' is cut either by rows or by header and footer")
            hf = e.get("by_header_footer")
            self.envelopes.append((name, not e.get("not_target", False), _regex(hf["header"], name) if hf else None, _regex(hf["footer"], name) if hf else None, _columns(e.get("columns", []), name)))
        plain = [e for e in d["envelopes"] if "by_header_footer" not in e]
        if plain:
            if len(d["envelopes"]) > 1:
                raise SchemaError("a by_rows envelope must be the only one")
            self.rows = plain[0].get("by_rows", 1)
        if sum(e[1] for e in self.envelopes) != 1:
            raise SchemaError("exactly one envelope must be the target")

    def records(self, name, text):
        lines = list(_plain_lines(text))
        root, at, now = Node(DOC, "#root"), 0, 0
        while at < len(lines):
            if self.rows is not None:
                end, env = at + self.rows, self.envelopes[0]
                if end > len(lines):
                    raise FatalError(f"input '{name}' line {lines[at][0]}: the envelope lacks {end - len(lines)} of its rows")
            else:
                hit = next((i for i in range(now, len(self.envelopes)) if self.envelopes[i][2].search(lines[at][1])), None)
                if hit is None:
                    return
                now, env, end = hit, self.envelopes[hit], at
                while end < len(lines) and not env[3].search(lines[end][1]):
                    end += 1
                if end >= len(lines):
                    raise FatalError(f"input '{name}' line {lines[at][0]}: the envelope has no footer")
                end += 1
            node = root.add(Node(ELEM, env[0]))
            for c, pattern, _ in env[4]:
                line = next((x for x in lines[at:end] if pattern is None or pattern.search(x[1])), None)
                if line is not None:
                    node.leaf(c["name"], _cut(c, line))
            at = end
            if env[1]:
                if self.keep(node):
                    yield node
                node.detach()


# --- EDI ------------------------------------------------------------------


def split_escaped(s: str, delim: str, escape: str | None) -> list[str]:
    """Split at delimiters that no release character precedes; nothing is unescaped."""
    if not escape or escape not in s:
        return s.split(delim)
    out, at, i = [], 0, 0
    while i < len(s):
        if s.startswith(escape, i):
            i += len(escape) + 1
        elif s.startswith(delim, i):
            out.append(s[at:i])
            i += len(delim)
            at = i
        else:
            i += 1
    return [*out, s[at:]]


def unescape(s: str, escape: str | None) -> str:
    if not escape or escape not in s:
        return s
    out, i = [], 0
    while i < len(s):
        if s.startswith(escape, i):
            i += len(escape)
            if i >= len(s):
                break
        out.append(s[i])
        i += 1
    return "".join(out)


def edi_segments(text: str, decl: dict) -> Iterator[tuple[int, int, int, str, str, list[tuple[int, int, str]]]]:
    """(number, first character, last character, name, raw, [(element, component, data)]) of the segments.

    The text after the last delimiter is a segment too, unless it is blank.
    """
    seg, elem, esc = decl["segment_delimiter"], decl["element_delimiter"], decl.get("release_character")
    comp, rep = decl.get("component_delimiter"), decl.get("repetition_delimiter")
    if decl.get("ignore_crlf"):
        text = text.replace("\r", "").replace("\n", "")
    at, no = 0, 0
    for token in split_escaped(text, seg, esc):
        begin, at = at + 1, at + len(token) + len(seg)
        raw = token.removesuffix("\r") if seg == "\n" else token
        body = raw.lstrip("\r\n")
        if not body.strip("\r\n"):
            continue
        no += 1
        elems = []
        for i, e in enumerate(split_escaped(body, elem, esc)):
            for v in split_escaped(e, rep, esc) if rep else [e]:
                elems += [(i, j, c) for j, c in enumerate(split_escaped(v, comp, esc), 1)] if comp else [(i, 1, v)]
        if not elems[0][2]:
            raise FatalError(f"segment no.{no} (char[{begin},{at}]): missing segment name")
        yield no, begin, at, elems[0][2], token, elems


class _Segments(Units):
    def __init__(self, name, text, decl):
        self.name, self.esc = name, decl.get("release_character")
        self.source = edi_segments(text, decl)
        self.now = None
        self.last = (0, 0, 0)
        self.step()

    def step(self):
        try:
            self.now = next(self.source, None)
        except FatalError as e:
            raise FatalError(f"input '{self.name}' at {e}") from None
        if self.now:
            self.last = self.now[:3]

    def more(self):
        return self.now is not None

    def where(self):
        return f"input '{self.name}' at segment no.{self.last[0]} (char[{self.last[1]},{self.last[2]}])"

    def starts(self, r):
        return self.now[3] == r.name

    def take(self, r, into):
        elems = self.now[5]
        for e in r.decl.get("elements", []):
            index, comp = e["index"], e.get("component_index", 1)
            found = [x for i, j, x in elems if i == index and j == comp]
            if not found:
                if "default" not in e and not e.get("empty_if_missing"):
                    raise FatalError(f"{self.where()}: unable to find element '{e['name']}' on segment '{r.path}'")
                found = [e.get("default", "")]
            for x in found:
                into.leaf(e["name"], unescape(x, self.esc))
        self.step()


class Edi(Format):
    """Segments matched to a grammar; the root sequence may repeat."""

    def __init__(self, schema, selector):
        super().__init__(schema, selector)
        self.decl = validate.file_declaration(schema, "edi")
        self.recs = build(self.decl["segment_declarations"], "child_segments", "segment_group", 1, 1, True, "segment")

    def records(self, name, text):
        yield from run(self.recs, _Segments(name, text, self.decl), Node(DOC, "#root"), self.keep, repeat_root=True)


# --- JSON and XML ---------------------------------------------------------


class _Selector:
    """A record selector over a growing tree: the path at an element's start, its last filter at its end."""

    def __init__(self, selector: str | None):
        self.expr, self.last = xp.split_last_filter(xp.parse(selector or "."))
        self.simple = self.expr[0] == "path" and self.expr[1] in ("root", None) and all(a == "child" and t[0] in ("name", "any") and not p for a, t, p in self.expr[2])
        self.steps = self.expr[2] if self.expr[0] == "path" else []
        self.itself = self.expr[0] == "path" and (not self.steps or all(a == "self" for a, _, _ in self.steps))

    def opens(self, n: Node, doc: Node) -> bool:
        if self.simple:
            for _, test, _ in reversed(self.steps):
                if n is None or n is doc or not xp._test(test, n):
                    return False
                n = n.parent
            return n is doc
        return any(n is m for m in xp.evaluate(self.expr, doc, 1, 1, doc))

    def closes(self, n: Node, doc: Node) -> bool:
        return bool(xp._predicates([n], self.last, doc))


class _Pairs(list):
    """The members of a JSON object in order; a name may come twice."""


class Json(Format):
    """One JSON value; every node that the selector matches is a record.

    An input that breaks off, or is broken, gives the records that end before
    that place, and then its fatal error.
    """

    def __init__(self, schema, selector):
        super().__init__(schema, selector)
        _Selector(selector)

    def records(self, name, text):
        if not text.strip():
            return
        sel, doc = _Selector(self.selector), Node(DOC, tag="json-root")
        whole = None if sel.itself else sel
        try:
            value, _ = json.JSONDecoder(parse_int=float, parse_constant=_bad_constant, object_pairs_hook=_Pairs).raw_decode(text.lstrip())
        except (ValueError, RecursionError):
            try:
                yield from self.partly(doc, text, _blank(text, 0), whole, doc)
            except ValueError as e:
                raise FatalError(f"input '{name}' before/near line {getattr(e, 'lineno', 1)}: {e}") from None
        else:
            yield from self.fill(doc, value, whole, doc)
        if sel.itself and sel.closes(doc, doc):
            yield doc

    def partly(self, n: Node, text: str, at: int, sel, doc):
        """``fill`` for a text that is read piece by piece; returns the place after the value, raises ValueError."""
        c = text[at : at + 1]
        if c not in ("{", "["):
            value, end = json.JSONDecoder(parse_int=float, parse_constant=_bad_constant).raw_decode(text, at)
            yield from self.fill(n, value, sel, doc)
            return end
        n.tag, close = ("json-obj", "}") if c == "{" else ("json-arr", "]")
        at = _blank(text, at + 1)
        if text.startswith(close, at):
            return at + 1
        while True:
            key = ""
            if c == "{":
                if not text.startswith('"', at):
                    raise json.JSONDecodeError("a member's name is missing", text, at)
                key, at = json.decoder.scanstring(text, at + 1, True)
                at = _blank(text, at)
                if not text.startswith(":", at):
                    raise json.JSONDecodeError("a colon is missing", text, at)
                at = _blank(text, at + 1)
            kid = n.add(Node(ELEM, key, "json-prop" if c == "{" else "json-item"))
            hit = sel is not None and sel.opens(kid, doc)
            at = _blank(text, (yield from self.partly(kid, text, at, None if hit else sel, doc)))
            if hit:
                if sel.closes(kid, doc):
                    yield kid
                kid.detach()
            if text.startswith(close, at):
                return at + 1
            if not text.startswith(",", at):
                raise json.JSONDecodeError("a comma or the end is missing", text, at)
            at = _blank(text, at + 1)

    def fill(self, n: Node, v, sel, doc) -> Iterator[Node]:
        if sel is None:
            _grow(n, v)
        elif isinstance(v, _Pairs):
            n.tag = "json-obj"
            for k, x in v:
                yield from self.child(n.add(Node(ELEM, k, "json-prop")), x, sel, doc)
        elif isinstance(v, list):
            n.tag = "json-arr"
            for x in v:
                yield from self.child(n.add(Node(ELEM, "", "json-item")), x, sel, doc)
        else:
            _grow(n, v)

    def child(self, n: Node, v, sel, doc) -> Iterator[Node]:
        hit = sel is not None and sel.opens(n, doc)
        yield from self.fill(n, v, None if hit else sel, doc)
        if hit:
            if sel.closes(n, doc):
                yield n
            n.detach()


def _grow(n: Node, v) -> None:
    """Add a JSON value to a new node without children, of which nothing is a record."""
    kids = n.children
    if isinstance(v, list):
        named = isinstance(v, _Pairs)
        n.tag, tag = ("json-obj", "json-prop") if named else ("json-arr", "json-item")
        for x in v:
            k, x = x if named else ("", x)
            c = Node(ELEM, k, tag)
            c.parent = n
            kids.append(c)
            if isinstance(x, float):
                t = Node(TEXT, plain_number(x), "json-num")
                t.parent = c
                c.children.append(t)
            else:
                _grow(c, x)
        return
    if v is None:
        t = Node(TEXT, "", "json-null")
    elif v is True or v is False:
        t = Node(TEXT, "true" if v else "false", "json-bool")
    elif isinstance(v, float):
        t = Node(TEXT, plain_number(v), "json-num")
    else:
        t = Node(TEXT, v, "json-str")
    t.parent = n
    kids.append(t)


def _blank(text: str, at: int) -> int:
    """The next place that holds no white space."""
    while at < len(text) and text[at] in " \t\r\n":
        at += 1
    return at


def _bad_constant(s):
    raise ValueError(f"invalid character in {s}")


class JsonLog(Format):
    """One JSON object per line; a bad line is an error of its own."""

    def __init__(self, schema, selector):
        super().__init__(schema, selector)
        if selector is None:
            raise SchemaError("FINAL_OUTPUT needs an xpath filter")

    def records(self, name, text):
        json_format = Json(self.schema, None)
        for no, line in enumerate(text.split("\n"), 1):
            if not line.strip():
                continue
            try:
                v = json.loads(line, parse_int=float, parse_constant=_bad_constant, object_pairs_hook=_Pairs)
            except ValueError as e:
                yield RecordError(f"input '{name}' line {no}: {e}")
                continue
            doc = Node(DOC, tag="json-root")
            for _ in json_format.fill(doc, v, None, doc):
                pass
            if self.keep(doc):
                yield doc


class Xml(Format):
    """One XML document; every element that the selector matches is a record."""

    def __init__(self, schema, selector):
        super().__init__(schema, selector)
        _Selector(selector)

    def records(self, name, text):
        if not text.strip():
            return
        parser = expat.ParserCreate()
        parser.ordered_attributes = True
        parser.buffer_text = True
        sel, doc = _Selector(self.selector), Node(DOC)
        stack, ready, prefixes, hits = [doc], [], {"http://www.w3.org/XML/1998/namespace": "xml"}, []
        scopes = [{"xml": "http://www.w3.org/XML/1998/namespace"}]

        def fit(q: str, plain: str) -> tuple[str, str]:
            prefix, _, local = q.rpartition(":")
            if not prefix and plain == "attribute":
                return "", local
            uri = scopes[-1].get(prefix)
            if uri is None:
                if prefix:
                    raise FatalError(f"unknown namespace prefix '{prefix}'")
                return "", local
            return prefixes.get(uri, prefix), local

        def start(q, attrs):
            pairs = list(zip(attrs[::2], attrs[1::2]))
            scope = dict(scopes[-1])
            for k, v in pairs:
                if k == "xmlns" or k.startswith("xmlns:"):
                    p = k[6:]
                    scope[p] = v
                    prefixes[v] = p
            scopes.append(scope)
            prefix, local = fit(q, "element")
            n = stack[-1].add(Node(ELEM, local, prefix))
            for k, v in pairs:
                p, a = ("xmlns", k[6:]) if k.startswith("xmlns:") else ("", "xmlns") if k == "xmlns" else fit(k, "attribute")
                n.add(Node(ATTR, a, p)).add(Node(TEXT, v))
            stack.append(n)
            if not hits and (sel.itself and n.parent is doc or not sel.itself and sel.opens(n, doc)):
                hits.append(n)

        def end(q):
            n = stack.pop()
            scopes.pop()
            if hits and hits[-1] is n:
                hits.pop()
                if sel.closes(n, doc):
                    ready.append(n)
                else:
                    n.detach()

        def data(s):
            if stack[-1] is not doc:
                stack[-1].add(Node(TEXT, s))

        parser.StartElementHandler, parser.EndElementHandler, parser.CharacterDataHandler = start, end, data
        raw = re.sub(r"^\s*(<\?xml[^>]*?)\s+encoding\s*=\s*(\"[^\"]*\"|'[^']*')", r"\1", text)
        # the document is fed tag by tag, so that a record is seen before what follows it
        at = 0
        try:
            for m in re.finditer(r"</[^>]*>|/>", raw):
                parser.Parse(raw[at : m.end()], False)
                at = m.end()
                while ready:
                    n = ready.pop(0)
                    yield n
                    n.detach()
            parser.Parse(raw[at:], True)
            while ready:
                n = ready.pop(0)
                yield n
                n.detach()
        except expat.ExpatError as e:
            raise FatalError(f"input '{name}' near line {e.lineno}: {e}") from None
        except FatalError as e:
            raise FatalError(f"input '{name}' near line {parser.CurrentLineNumber}: {e}") from None


FORMATS: dict[str, type[Format]] = {"csv": Csv, "delimited": Csv, "csv2": Csv2, "fixed-length": Fixed, "fixedlength2": Fixed2, "edi": Edi, "json": Json, "xml": Xml, "jsonlog": JsonLog}
