"""The built-in functions as the row interpreter calls them.

A function takes (context, *arguments), or (context, node, *arguments) if it
is marked by ``needs_node``.  Null arguments arrive as "" unless the function
is marked by ``takes_null``.
"""

from __future__ import annotations

import hashlib

from ..operators.nodes import render, to_value
from . import datetimes
from .script import run_script


class FunctionError(ValueError):
    """A function's own failure."""


def needs_node(f):
    f.needs_node = True
    return f


def takes_null(f):
    f.takes_null = True
    return f


def uuid_v3(s: str) -> str:
    """The name-based UUID (MD5) of a text in the nil namespace."""
    h = bytearray(hashlib.md5(b"\0" * 16 + s.encode()).digest())
    h[6] = h[6] & 0x0F | 0x30
    h[8] = h[8] & 0x3F | 0x80
    x = h.hex()
    return f"{x[:8]}-{x[8:12]}-{x[12:16]}-{x[16:20]}-{x[20:]}"


@needs_node
def copy(ctx, node):
    return to_value(node)


def _script(code, pairs):
    if len(pairs) % 2:
        raise FunctionError("invalid number of args to 'javascript'")
    return run_script(code, {pairs[i]: pairs[i + 1] for i in range(0, len(pairs), 2)})


@takes_null
def script(ctx, code, *pairs):
    return _script(code, pairs)


@takes_null
@needs_node
def script_with_context(ctx, node, code, *pairs):
    return _script(code, (*pairs, "_node", render(to_value(node))))


BUILTIN = {
    "coalesce": lambda ctx, *a: next((x for x in a if x), ""),
    "concat": lambda ctx, *a: "".join(a),
    "lower": lambda ctx, s: s.lower(),
    "upper": lambda ctx, s: s.upper(),
    "uuidv3": lambda ctx, s: uuid_v3(s),
    "now": lambda ctx: datetimes.now(),
    "dateTimeToRFC3339": lambda ctx, s, a, b: datetimes.to_rfc3339(s, a, b),
    "dateTimeLayoutToRFC3339": lambda ctx, s, layout, flag, a, b: datetimes.layout_to_rfc3339(s, layout, flag, a, b),
    "dateTimeToEpoch": lambda ctx, s, a, unit: datetimes.to_epoch(s, a, unit),
    "epochToDateTimeRFC3339": lambda ctx, s, unit, *tz: datetimes.from_epoch(s, unit, *tz),
    "copy": copy,
    "javascript": script,
    "javascript_with_context": script_with_context,
}
#: (least, most) number of arguments.
ARITY = {"lower": (1, 1), "upper": (1, 1), "uuidv3": (1, 1), "now": (0, 0), "dateTimeToRFC3339": (3, 3), "dateTimeLayoutToRFC3339": (5, 5), "dateTimeToEpoch": (3, 3), "epochToDateTimeRFC3339": (2, 99), "copy": (0, 0), "javascript": (1, 999), "javascript_with_context": (1, 999)}
