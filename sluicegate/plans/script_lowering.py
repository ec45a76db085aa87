"""Lowering of pure script expressions to Catalyst columns."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

from ..functions.script import ScriptError, _Parser


class _No(Exception):
    pass


_DECIMAL = r"^[+-]?(?:[0-9]+\.?[0-9]*|\.[0-9]+)(?:[eE][+-]?[0-9]+)?$"


def _number(v: tuple[Column, str], bind) -> Column:
    c, kind = v
    if kind in ("int", "float"):
        return c.cast("double")
    if kind == "boolean":
        return c.cast("int").cast("double")
    t = bind(F.trim(c))
    return bind(F.when(t == "", F.lit(0.0)).when(t.rlike(_DECIMAL), t.try_cast("double")).otherwise(F.lit(float("nan"))))


def _truth(v: tuple[Column, str]) -> Column:
    c, kind = v
    if kind == "boolean":
        return F.coalesce(c, F.lit(False))
    if kind == "string":
        return F.coalesce(c != "", F.lit(False))
    return F.coalesce((c != 0) & ~F.isnan(c.cast("double")), F.lit(False))


_NUMERIC = ("int", "float")


def _expr(e, names, bind):
    """(value, kind) of an expression; what is computed is bound, so that its users name it."""
    value, kind = _plain(e, names, bind)
    return (value if e[0] in ("const", "name") else bind(value)), kind


def _plain(e, names, bind):
    kind = e[0]
    if kind == "const":
        v = e[1]
        if isinstance(v, bool):
            return F.lit(v), "boolean"
        if isinstance(v, float):
            return F.lit(v), "float"
        if isinstance(v, str):
            return F.lit(v), "string"
        raise _No
    if kind == "name":
        if e[1] not in names:
            raise _No
        return names[e[1]]
    if kind == "cond":
        c, a, b = _truth(_expr(e[1], names, bind)), _expr(e[2], names, bind), _expr(e[3], names, bind)
        if a[1] in _NUMERIC and b[1] in _NUMERIC:
            return F.when(c, a[0].cast("double")).otherwise(b[0].cast("double")), "float"
        if a[1] != b[1]:
            raise _No
        return F.when(c, a[0]).otherwise(b[0]), a[1]
    if kind == "un" and e[1] in ("!", "-", "+"):
        v = _expr(e[2], names, bind)
        return (~_truth(v), "boolean") if e[1] == "!" else (-_number(v, bind) if e[1] == "-" else _number(v, bind), "float")
    if kind == "bin":
        op = e[1]
        a, b = _expr(e[2], names, bind), _expr(e[3], names, bind)
        if op in ("&&", "||") and a[1] == b[1] == "boolean":
            return (_truth(a) & _truth(b) if op == "&&" else _truth(a) | _truth(b)), "boolean"
        if op in ("==", "===", "!=", "!=="):
            if a[1] == b[1] == "string":
                same = F.equal_null(a[0], b[0])
            elif a[1] in _NUMERIC and b[1] in _NUMERIC or (len(op) == 2 and {a[1], b[1]} <= {"string", "int", "float"}):
                x, y = _number(a, bind), _number(b, bind)
                same = F.coalesce((x == y) & ~F.isnan(x) & ~F.isnan(y), F.lit(False))
            else:
                raise _No
            return (same if op[0] == "=" else ~same), "boolean"
        if op in ("<", "<=", ">", ">=") and "boolean" not in (a[1], b[1]):
            x, y = (a[0], b[0]) if a[1] == b[1] == "string" else (_number(a, bind), _number(b, bind))
            r = {"<": x < y, "<=": x <= y, ">": x > y, ">=": x >= y}[op]
            if not a[1] == b[1] == "string":
                r = r & ~F.isnan(x) & ~F.isnan(y)
            return F.coalesce(r, F.lit(False)), "boolean"
        if op == "+":
            if a[1] == b[1] == "string":
                return F.concat(F.coalesce(a[0], F.lit("null")), F.coalesce(b[0], F.lit("null"))), "string"
            if "string" in (a[1], b[1]):
                raise _No
            return _number(a, bind) + _number(b, bind), "float"
        if op in ("-", "*"):
            x, y = _number(a, bind), _number(b, bind)
            return (x - y if op == "-" else x * y), "float"
        if op == "/":
            x, y = _number(a, bind), _number(b, bind)
            return F.when(y == 0, F.lit(float("nan"))).otherwise(F.try_divide(x, y)), "float"
        raise _No
    if kind == "call" and e[1][0] == "get" and e[1][2][0] == "const" and not any(s for s, _ in e[2]):
        o, name, args = e[1][1], e[1][2][1], [a for _, a in e[2]]
        if o == ("name", "Math") and len(args) == 1 and name in ("floor", "ceil", "abs", "round", "sqrt"):
            x = _number(_expr(args[0], names, bind), bind)
            big = F.isnan(x) | (F.abs(x) > 9e15)
            f = {"floor": lambda: F.floor(x).cast("double"), "ceil": lambda: F.ceil(x).cast("double"), "abs": lambda: F.abs(x), "round": lambda: F.floor(x + 0.5).cast("double"), "sqrt": lambda: F.sqrt(x)}[name]()
            return (F.when(big, x).otherwise(f) if name in ("floor", "ceil", "round") else f), "float"
        v = _expr(o, names, bind)
        if v[1] != "string":
            raise _No
        if not args and name in ("toUpperCase", "toLowerCase", "trim"):
            return {"toUpperCase": F.upper, "toLowerCase": F.lower, "trim": lambda c: F.regexp_replace(c, r"^\s+|\s+$", "")}[name](v[0]), "string"
        if name == "substring" and 1 <= len(args) <= 2 and all(a[0] == "const" and isinstance(a[1], float) and a[1] >= 0 for a in args):
            lo = int(args[0][1])
            hi = int(args[1][1]) if len(args) == 2 else None
            if hi is not None and hi < lo:
                lo, hi = hi, lo
            return F.substring(v[0], lo + 1, (1 << 30) if hi is None else hi - lo), "string"
        if name in ("startsWith", "endsWith", "includes") and len(args) == 1:
            x = _expr(args[0], names, bind)
            if x[1] != "string":
                raise _No
            return F.coalesce({"startsWith": F.startswith, "endsWith": F.endswith, "includes": F.contains}[name](v[0], x[0]), F.lit(False)), "boolean"
        raise _No
    if kind == "call" and e[1] in (("name", "parseFloat"), ("name", "Number")) and len(e[2]) == 1:
        v = _expr(e[2][0][1], names, bind)
        if e[1][1] == "parseFloat" and v[1] == "string":
            m = F.regexp_extract(v[0], r"^\s*([+-]?(?:[0-9]+\.?[0-9]*|\.[0-9]+)(?:[eE][+-]?[0-9]+)?)", 1)
            return F.coalesce(F.when(m != "", m.try_cast("double")), F.lit(float("nan"))), "float"
        return _number(v, bind), "float"
    raise _No


def lower(code: str, names: dict[str, tuple[Column, str]], bind=lambda c: c):
    """(value, kind, whether it fails) of a program of one pure expression, or None.

    ``bind`` makes a column of its own of an expression and returns its name.

    String arguments that are null make the script see null; so that it never
    does, a program over them compiles only if null and "" can't be told apart
    here: null strings are passed as null to comparisons and as "null" to
    concatenation, as the interpreter does.
    """
    try:
        tree = _Parser(code).program()
        if len(tree) != 1 or tree[0][0] != "expr":
            return None
        value, kind = _expr(tree[0][1], names, bind)
    except (_No, ScriptError):
        return None
    if kind in _NUMERIC:
        value = value.cast("double")
        return value, "float", F.coalesce(F.isnan(value) | (F.abs(value) == float("inf")), F.lit(False))
    return value, kind, None
