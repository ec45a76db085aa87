"""Binding of transform declarations: kinds, inlined templates, checked functions and xpaths."""

from __future__ import annotations

import copy
from dataclasses import dataclass, field

from ..operators.xpath import XPathError, parse
from .errors import SchemaError

KINDS = ("const", "external", "custom_func", "custom_parse", "object", "array", "template")


@dataclass
class Decl:
    """A bound declaration; ``name`` is its full path in the schema."""

    kind: str
    name: str
    xpath: str | None = None
    dynamic: "Decl | None" = None
    value: str | None = None
    func: str | None = None
    ignore_error: bool = False
    children: list[tuple[str, "Decl"]] = field(default_factory=list)
    type: str | None = None
    no_trim: bool = False
    keep: bool = False
    under_array: bool = False


def _kind(d: dict) -> str:
    return next((k for k in KINDS if k in d), "field")


def bind(decls: dict, functions: dict, parsers: dict, arity: dict | None = None) -> Decl:
    """The bound FINAL_OUTPUT."""
    arity = arity or {}

    def inline(d: dict, name: str, seen: tuple[str, ...]) -> dict:
        while "template" in d:
            ref = d["template"]
            if ref not in decls:
                raise SchemaError(f"'{name}' refers to non-existent template '{ref}'")
            if ref in seen:
                raise SchemaError(f"'{name}' refers to itself through templates: {' -> '.join((*seen, ref))}")
            t = copy.deepcopy(decls[ref])
            if ("xpath" in d or "xpath_dynamic" in d) and ("xpath" in t or "xpath_dynamic" in t):
                raise SchemaError(f"'{name}' and its template '{ref}' can't both have an xpath")
            for k in ("xpath", "xpath_dynamic"):
                if k in d:
                    t[k] = d[k]
            for k in ("type", "no_trim", "keep_empty_or_null"):
                if k in d and k not in t:
                    t[k] = d[k]
            d, seen = t, (*seen, ref)
        d["_seen"] = seen
        return d

    def one(d: dict, name: str, seen: tuple[str, ...], under_array: bool = False) -> Decl:
        if "xpath" in d and "xpath_dynamic" in d:
            raise SchemaError(f"'{name}' cannot set both 'xpath' and 'xpath_dynamic' at the same time")
        d = inline(dict(d), name, seen)
        seen = d.pop("_seen")
        kind = _kind(d)
        out = Decl(kind, name, d.get("xpath"), None, None, type=d.get("type"), no_trim=d.get("no_trim", False), keep=d.get("keep_empty_or_null", False), under_array=under_array)
        if out.xpath is not None:
            try:
                parse(out.xpath)
            except XPathError as e:
                raise SchemaError(f"'{name}' has an invalid xpath '{out.xpath}': {e}") from None
        if "xpath_dynamic" in d:
            out.dynamic = one(d["xpath_dynamic"], f"{name}.xpath_dynamic", seen)
        if kind in ("const", "external"):
            out.value = d[kind]
        elif kind == "custom_func":
            f = d["custom_func"]
            out.func, out.ignore_error = f["name"], f.get("ignore_error", False)
            if out.func not in functions:
                raise SchemaError(f"unknown custom_func '{out.func}' on '{name}'")
            args = f.get("args", [])
            low, high = arity.get(out.func, (0, 1 << 30))
            if not low <= len(args) <= high:
                raise SchemaError(f"custom_func '{out.func}' on '{name}' has {len(args)} arguments")
            out.children = [(f"arg[{i + 1}]", one(a, f"{name}.custom_func({out.func}).arg[{i + 1}]", seen)) for i, a in enumerate(args)]
        elif kind == "custom_parse":
            out.func = d["custom_parse"]
            if out.func not in parsers:
                raise SchemaError(f"unknown custom_parse '{out.func}' on '{name}'")
        elif kind == "object":
            out.children = [(k, one(c, f"{name}.{k}", seen)) for k, c in sorted(d["object"].items()) if k != "_comment"]
        elif kind == "array":
            # children stand in the order of the texts elem[1], elem[10], elem[2]
            numbered = [(f"elem[{i + 1}]", c) for i, c in enumerate(d["array"])]
            out.children = [(k, one(c, f"{name}.{k}", seen, True)) for k, c in sorted(numbered, key=lambda x: x[0])]
        return out

    return one(decls["FINAL_OUTPUT"], "FINAL_OUTPUT", ())


def literals(d: Decl) -> list[Decl]:
    """A declaration and all below it."""
    out = [d]
    for _, c in d.children:
        out += literals(c)
    if d.dynamic:
        out += literals(d.dynamic)
    return out
