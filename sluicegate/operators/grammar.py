"""The record grammar: sequences, occurrence limits, groups and nesting over framed units."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass, field

from ..schema.errors import FatalError, SchemaError
from .nodes import ELEM, Node


@dataclass
class Rec:
    """One declaration of the grammar.  ``max`` below 0 is no limit."""

    name: str
    decl: dict
    group: bool = False
    target: bool = False
    min: int = 0
    max: int = -1
    children: list["Rec"] = field(default_factory=list)
    path: str = ""

    def first(self) -> "Rec":
        return self.children[0].first() if self.group else self


def build(decls: list[dict], children_key: str, group_type: str, default_min: int, default_max: int, need_target: bool, what: str) -> list[Rec]:
    """The checked grammar; without a target the first top-level declaration is it, unless one is needed."""
    targets: list[Rec] = []

    def one(d: dict, path: str, i: int) -> Rec:
        name = d.get("name", "")
        r = Rec(name, d, d.get("type") == group_type, d.get("is_target", False), d.get("min", default_min), d.get("max", default_max), path=f"{path}/{name}" if path else name)
        if r.max >= 0 and r.min > r.max:
            raise SchemaError(f"{what} '{r.path}' has 'min' value {r.min} > 'max' value {r.max}")
        kids = d.get(children_key, [])
        if r.group and not kids:
            raise SchemaError(f"{what} group '{r.path}' must have at least one child")
        if r.group and (d.get("columns") or d.get("elements")):
            raise SchemaError(f"{what} group '{r.path}' must not have any columns")
        if r.target:
            targets.append(r)
            if len(targets) > 1:
                raise SchemaError(f"a second {what} with 'is_target' = true ('{r.path}') is not allowed")
        r.children = [one(k, r.path, j) for j, k in enumerate(kids)]
        return r

    out = [one(d, "", i) for i, d in enumerate(decls)]
    if not targets:
        if need_target or not out:
            raise SchemaError(f"missing {what} with 'is_target' = true")
        out[0].target = True
    return out


class Units:
    """What a grammar reads: ``starts`` looks ahead, ``take`` consumes one instance."""

    def more(self) -> bool:
        raise NotImplementedError

    def starts(self, r: Rec) -> bool:
        raise NotImplementedError

    def take(self, r: Rec, into: Node) -> None:
        raise NotImplementedError

    def where(self) -> str:
        return ""


def run(recs: list[Rec], units: Units, root: Node, keep: Callable[[Node], bool], repeat_root: bool = False) -> Iterator[Node]:
    """The target records in order; a record leaves the tree once the next one is asked for.

    Matching is greedy: a declaration takes instances as long as they start
    and its limit allows, then the next one has its turn.
    """

    def targets(r: Rec) -> bool:
        below = [targets(c) for c in r.children]  # all of them, for what they note
        if r.target or any(below):
            around.add(id(r))
        return id(r) in around

    around: set[int] = set()
    for r in recs:
        targets(r)

    def whole(decls: list[Rec], parent: Node) -> None:
        """``sequence`` where no target is."""
        for r in decls:
            n, first = 0, r.first()
            while (r.max < 0 or n < r.max) and units.more() and units.starts(first):
                node = parent.add(Node(ELEM, r.name))
                if not r.group:
                    units.take(r, node)
                if r.children:
                    whole(r.children, node)
                n += 1
            if n < r.min:
                raise FatalError(f"{units.where()}: '{r.path}' needs min occur {r.min}, but only got {n}")

    def sequence(decls: list[Rec], parent: Node) -> Iterator[Node]:
        for r in decls:
            if id(r) not in around:
                whole([r], parent)
                continue
            n, first = 0, r.first()
            while (r.max < 0 or n < r.max) and units.more() and units.starts(first):
                node = parent.add(Node(ELEM, r.name))
                if not r.group:
                    units.take(r, node)
                if r.target:
                    whole(r.children, node)
                else:
                    yield from sequence(r.children, node)
                n += 1
                if r.target:
                    if keep(node):
                        yield node
                    node.detach()
            if n < r.min:
                raise FatalError(f"{units.where()}: '{r.path}' needs min occur {r.min}, but only got {n}")

    yield from sequence(recs, root)
    while repeat_root and units.more() and recs and units.starts(recs[0].first()):
        yield from sequence(recs, root)
    if units.more():
        raise FatalError(f"{units.where()}: unexpected data")
