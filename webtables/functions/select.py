"""Selector objects: axes and predicates over a preorder node array.

A selector is built in Python and compiled to column expressions::

    descendant("div", has_class("info")).child("p", has_child("span")).first().descendant("a")

Node sets are arrays of node structs in document order.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, replace

from pyspark.sql import Column
from pyspark.sql import functions as F

from webtables.functions import dom as D
from webtables.functions.text import WHITE_SPACE, let

Predicate = Callable[[Column, Column], Column]  # (dom, node) -> boolean


# -- predicates ---------------------------------------------------------------------------------
def has_attr(name: str) -> Predicate:
    return lambda dom, n: D.node_attr(n, name).isNotNull()


def attr_is(name: str, value: str) -> Predicate:
    return lambda dom, n: F.coalesce(D.node_attr(n, name) == value, F.lit(False))


def attr_contains(name: str, value: str) -> Predicate:
    return lambda dom, n: F.contains(F.coalesce(D.node_attr(n, name), F.lit("")), F.lit(value))


def attr_starts_with(name: str, value: str) -> Predicate:
    return lambda dom, n: F.startswith(F.coalesce(D.node_attr(n, name), F.lit("")), F.lit(value))


def has_class(token: str) -> Predicate:
    """The class attribute holds ``token`` as one of its white-space separated words."""
    return lambda dom, n: F.array_contains(
        F.split(F.coalesce(D.node_attr(n, "class"), F.lit("")), r"[ \t\n\r]+"), token
    )


def text_contains(value: str) -> Predicate:
    return lambda dom, n: F.contains(D.node_text(dom, n), F.lit(value))


def direct_text_contains(value: str) -> Predicate:
    return lambda dom, n: F.contains(D.node_direct_text(dom, n), F.lit(value))


def text_is(value: str) -> Predicate:
    """White-space normalised text equals ``value``."""
    return lambda dom, n: F.regexp_replace(
        F.btrim(D.node_text(dom, n), F.lit(WHITE_SPACE)), r"[ \t\n\r]+", " "
    ) == F.lit(value)


def tag_is(tag: str) -> Predicate:
    return lambda dom, n: n["tag"] == tag


def has_descendant(tag: str = "*", *preds: Predicate) -> Predicate:
    return lambda dom, n: F.exists(_subtree(dom, n), lambda m: _matches(dom, m, tag, preds))


def has_child(tag: str = "*", *preds: Predicate) -> Predicate:
    return lambda dom, n: F.exists(_kids(dom, n["k0"], n["kn"]), lambda m: _matches(dom, m, tag, preds))


def all_of(*preds: Predicate) -> Predicate:
    return lambda dom, n: _conj([p(dom, n) for p in preds])


def any_of(*preds: Predicate) -> Predicate:
    def check(dom, n):
        out = preds[0](dom, n)
        for p in preds[1:]:
            out = out | p(dom, n)
        return out

    return check


def not_(pred: Predicate) -> Predicate:
    return lambda dom, n: ~pred(dom, n)


def _conj(cols: list[Column]) -> Column:
    out = cols[0] if cols else F.lit(True)
    for c in cols[1:]:
        out = out & c
    return out


def _matches(dom: Column, n: Column, tag: str, preds) -> Column:
    tests = [] if tag == "*" else [n["tag"] == tag]
    return _conj(tests + [p(dom, n) for p in preds])


def _subtree(dom: Column, n: Column) -> Column:
    """Proper descendants; preorder makes them one slice."""
    return F.slice(dom["nodes"], n["pre"] + 2, n["last"] - n["pre"])


def _kids(dom: Column, start: Column, count: Column) -> Column:
    """Nodes of a slice of the list of children."""
    return F.transform(F.slice(dom["kids"], start + 1, count), lambda i: F.get(dom["nodes"], i))


def _first_kid(dom: Column, start: Column, count: Column, test) -> Column:
    """The first match of a slice of the list of children, as an array of one or none.

    Looked for in runs of growing length, so that a near match costs no more than the way to it.
    """
    tries, at = [], 0
    for run in (1, 32, None):
        left = F.greatest(count - at, F.lit(0))
        part = _kids(dom, start + at, left if run is None else F.least(left, F.lit(run)))
        tries.append(F.get(F.filter(part, test), F.lit(0)))
        at += run or 0
    return F.filter(F.array(F.coalesce(*tries)), lambda m: m.isNotNull())


# -- selectors ----------------------------------------------------------------------------------
@dataclass(frozen=True)
class _Step:
    axis: str
    tag: str = "*"
    preds: tuple = ()
    position: int | None = None  # per parent / per context; -1 = last


@dataclass(frozen=True)
class Selector:
    steps: tuple = ()

    def _add(self, axis, tag, preds) -> "Selector":
        return replace(self, steps=self.steps + (_Step(axis, tag, tuple(preds)),))

    def descendant(self, tag: str = "*", *preds: Predicate) -> "Selector":
        return self._add("descendant", tag, preds)

    def child(self, tag: str = "*", *preds: Predicate) -> "Selector":
        return self._add("child", tag, preds)

    def parent(self) -> "Selector":
        return self._add("parent", "*", ())

    def following_sibling(self, tag: str = "*", *preds: Predicate) -> "Selector":
        return self._add("following", tag, preds)

    def nth(self, n: int) -> "Selector":
        """Position among the last step's matches, counted per parent (1-based; -1 = last)."""
        return replace(self, steps=self.steps[:-1] + (replace(self.steps[-1], position=n),))

    def first(self) -> "Selector":
        """First node of the whole set."""
        return self._add("pick", "1", ())

    def last(self) -> "Selector":
        """Last node of the whole set."""
        return self._add("pick", "-1", ())

    def apply(self, dom: Column, context: Column, only_first: bool = False) -> Column:
        """Matching nodes in document order, starting at ``context``; ``only_first``: at least the first of them."""
        nodes, single = F.array(context), True
        for no, step in enumerate(self.steps):
            if only_first and single and no == len(self.steps) - 1 and step.axis in ("child", "following") and step.position is None:
                step = replace(step, position=1)  # all matches have one parent
            if step.axis == "pick":
                nodes = F.slice(nodes, int(step.tag), 1)
                single = True
                continue
            if single:
                found = let(F.get(nodes, F.lit(0)), lambda n: _axis(dom, n, step)) if step.axis else nodes
                nodes = F.coalesce(found, F.slice(dom["nodes"], 1, 0))
            else:
                found = F.flatten(F.transform(nodes, lambda n: _axis(dom, n, step)))
                nodes = found if step.axis == "child" and _flat(self.steps, step) else _document_order(dom, found)
            single = step.axis == "parent" and single
        return nodes


def _flat(steps, step) -> bool:
    """Children of a set reached by child steps only never interleave."""
    before = steps[: steps.index(step)]
    return all(s.axis in ("child", "pick") for s in before)


def _document_order(dom: Column, nodes: Column) -> Column:
    order = F.array_sort(F.array_distinct(F.transform(nodes, lambda n: n["pre"])))
    return F.transform(order, lambda i: F.get(dom["nodes"], i))


def _axis(dom: Column, n: Column, step: _Step) -> Column:
    if step.axis == "parent":
        return F.when(n["parent"] >= 0, F.slice(dom["nodes"], n["parent"] + 1, F.lit(1))).otherwise(
            F.slice(dom["nodes"], 1, 0)
        )
    if step.axis in ("following", "child"):
        if step.axis == "child":
            start, count = n["k0"], n["kn"]
        else:
            up = F.get(dom["nodes"], n["parent"])
            start, count = up["k0"] + n["rank"] + 1, up["kn"] - n["rank"] - 1
        found = _among(dom, start, count, step)
        return F.coalesce(found, F.slice(dom["nodes"], 1, 0))
    found = F.filter(_subtree(dom, n), lambda m: _matches(dom, m, step.tag, step.preds))
    if step.position is None:
        return found
    return _ranked(dom, found, step.position)


def _among(dom: Column, start: Column, count: Column, step: _Step) -> Column:
    """The matches among siblings, all or the one at the step's position; only siblings are looked at."""
    plain = step.tag == "*" and not step.preds
    if plain and step.position is not None and step.position > 0:
        return _kids(dom, start + (step.position - 1), F.least(F.greatest(count - (step.position - 1), F.lit(0)), F.lit(1)))
    if step.position == 1 and step.axis == "following":
        return _first_kid(dom, start, count, lambda m: _matches(dom, m, step.tag, step.preds))
    found = _kids(dom, start, count)
    return _at(found if plain else F.filter(found, lambda m: _matches(dom, m, step.tag, step.preds)), step.position)


def _at(nodes: Column, position: int | None) -> Column:
    if position is None:
        return nodes
    if position > 0:
        return F.slice(nodes, position, 1)
    return let(nodes, lambda a: F.when(F.size(a) > 0, F.slice(a, -1, 1)).otherwise(a))


def _ranked(dom: Column, nodes: Column, position: int) -> Column:
    """Those of ``nodes`` that are the position-th (or last) among the ones of the same parent.

    Sorted by parent, a node's place among its own is seen from two neighbours, so the cost is that of the sort.
    """

    def pick(keys: Column) -> Column:
        def pre(k: Column, i: Column) -> Column:
            def same(at: Column) -> Column:
                return F.when(at >= 0, F.coalesce(F.get(keys, at)["parent"] == k["parent"], F.lit(False))).otherwise(F.lit(False))

            if position < 0:
                hit = ~same(i + 1)
            else:
                hit = same(i - (position - 1)) & ~same(i - position)
            return F.when(hit, k["pre"])

        return F.sort_array(F.filter(F.transform(keys, pre), lambda x: x.isNotNull()))

    keys = F.sort_array(F.transform(nodes, lambda m: F.struct(m["parent"].alias("parent"), m["pre"].alias("pre"))))
    return F.transform(let(keys, pick), lambda i: F.get(dom["nodes"], i))


def descendant(tag: str = "*", *preds: Predicate) -> Selector:
    return Selector().descendant(tag, *preds)


def child(tag: str = "*", *preds: Predicate) -> Selector:
    return Selector().child(tag, *preds)


def self_node() -> Selector:
    return Selector()


def parent() -> Selector:
    return Selector().parent()


def following_sibling(tag: str = "*", *preds: Predicate) -> Selector:
    return Selector().following_sibling(tag, *preds)
