"""Expressions as typed Spark columns. Kinds are checked here, before anything runs."""

from __future__ import annotations

import contextlib
import threading
from collections.abc import Iterator
from dataclasses import dataclass, field, replace

from pyspark.sql import Column, SparkSession
from pyspark.sql import functions as F

from ..errors import ColumnNotFound, PlanError, TableNotFound, TypeMismatch, Unsupported
from ..plans import nodes as n
from ..plans.kinds import Kind, kind_of

DIVISION = "tessera: division by zero"
#: Levels of a column's tree that Spark's recursion stands.
DEEPEST = 120
OPS = {"=": "__eq__", "!=": "__ne__", "<>": "__ne__", "<": "__lt__", "<=": "__le__", ">": "__gt__", ">=": "__ge__", "+": "__add__", "-": "__sub__", "*": "__mul__"}


#: Sessions in other threads share Spark's settings, so plans are built one at a time.
BUILDING = threading.RLock()


@contextlib.contextmanager
def wrapping(spark: SparkSession) -> Iterator[None]:
    """Integers wrap in what is built inside: the mode is fixed when a DataFrame is analysed."""
    key = "spark.sql.ansi.enabled"
    with BUILDING:
        before = spark.conf.get(key)
        spark.conf.set(key, "false")
        try:
            yield
        finally:
            spark.conf.set(key, before)


@dataclass(frozen=True)
class Typed:
    col: Column
    kind: Kind
    literal: bool = False
    depth: int = 1  # levels of the column's tree

    def to(self, kind: Kind) -> Column:
        return self.col if kind == self.kind else self.col.cast(kind.spark)


@dataclass
class Scope:
    """What names mean. Above an aggregation, whole expressions have columns too."""

    table: str
    names: dict[str, Typed]
    exprs: dict[str, Typed] = field(default_factory=dict)
    grouped: bool = False
    hidden: frozenset[str] = frozenset()
    below: Scope | None = None

    def of(self, e: n.Name) -> Typed:
        if e.table and e.table != self.table:
            raise TableNotFound(e.table)
        if e.name in self.hidden:
            raise Unsupported(f"column {self.table}.{e.name} has a type outside the dialect")
        if e.name in self.names:
            return self.names[e.name]
        if self.grouped:
            if self.below:
                self.below.of(e)
            raise PlanError(f'column "{e.name}" must appear in the GROUP BY clause or be used in an aggregate')
        raise ColumnNotFound(f"{self.table}.{e.name}")


def constant(value: object) -> Typed:
    kind = kind_of(value)
    return Typed(F.lit(value).cast(kind.spark), kind, literal=value is not None)


def null(kind: Kind) -> Typed:
    return Typed(F.lit(None).cast(kind.spark), kind)


def condition(t: Typed) -> Column:
    if t.kind not in (Kind.BOOL, Kind.NULL):
        raise TypeMismatch(f"a {t.kind.value} is not a condition")
    return t.to(Kind.BOOL)


def aligned(a: Typed, b: Typed) -> tuple[Column, Column] | None:
    """Two sides of a comparison as columns of one type; None if one is NULL as written."""
    if Kind.NULL in (a.kind, b.kind):
        return None
    if a.kind != b.kind and not (a.kind.numeric and b.kind.numeric):
        raise TypeMismatch(f"cannot compare {a.kind.value} with {b.kind.value}")
    kind = Kind.FLOAT if a.kind != b.kind else a.kind
    return a.to(kind), b.to(kind)


def compare(op: str, a: Typed, b: Typed) -> Column:
    sides = aligned(a, b)
    return getattr(sides[0], OPS[op])(sides[1]) if sides else null(Kind.BOOL).col


def arithmetic(op: str, a: Typed, b: Typed) -> Typed:
    if Kind.NULL in (a.kind, b.kind):
        return null(Kind.NULL)
    if not (a.kind.numeric and b.kind.numeric):
        raise TypeMismatch(f"{op} wants numbers, found {a.kind.value} and {b.kind.value}")
    if op == "%" and Kind.FLOAT in (a.kind, b.kind):
        raise TypeMismatch(f"% wants integers, found {a.kind.value} and {b.kind.value}")
    kind = Kind.INT if a.kind == b.kind == Kind.INT else Kind.FLOAT
    x, y = a.to(kind), b.to(kind)
    if op not in "/%":
        return Typed(getattr(x, OPS[op])(y), kind)
    zero = F.lit(0).cast(kind.spark)
    result = x % y if op == "%" else F.call_function("div", x, y) if kind == Kind.INT else x / y
    return Typed(F.when(y == zero, F.raise_error(F.lit(DIVISION)).cast(kind.spark)).otherwise(result), kind)


def like(a: Typed, p: Typed, pattern: n.Expr) -> Column:
    for t in (a, p):
        if t.kind not in (Kind.TEXT, Kind.NULL):
            raise TypeMismatch(f"LIKE wants TEXT, found {t.kind.value}")
    if Kind.NULL in (a.kind, p.kind):
        return null(Kind.BOOL).col
    # a backslash is an ordinary character of the dialect's patterns
    if isinstance(pattern, n.Literal):
        return F.like(a.col, F.lit(pattern.value.replace("\\", "\\\\")))
    return F.like(a.col, F.replace(p.col, F.lit("\\"), F.lit("\\\\")))


def compiled(e: n.Expr, scope: Scope) -> Typed:
    """The column of an expression. Chains of AND, OR and of integer sums become flat trees, and pairs of NOT
    or of signs vanish; what is deeper still than Spark's own recursion allows is refused."""
    if scope.exprs and (known := scope.exprs.get(str(e))) is not None:
        return known
    found = built(e, scope)
    if found.depth > DEEPEST:
        raise Unsupported(f"an expression of more than {DEEPEST} nested operations")
    return found


def chain(e: n.Binary, scope: Scope) -> list[n.Expr]:
    """The operands of a chain of AND or of OR, from left to right; whole expressions that have columns stay whole."""
    out, todo = [], [e]
    while todo:
        x = todo.pop()
        if isinstance(x, n.Binary) and x.op == e.op and not (scope.exprs and str(x) in scope.exprs):
            todo += [x.right, x.left]
        else:
            out.append(x)
    return out


def added(e: n.Binary, scope: Scope) -> Typed:
    """A chain to the left of sums and differences, or of products. Integers wrap, so theirs may be joined in
    any order; others are joined from left to right."""
    alike, steps, x = ("*",) if e.op == "*" else ("+", "-"), [], e
    while isinstance(x, n.Binary) and x.op in alike and not (steps and scope.exprs and str(x) in scope.exprs):
        steps.append((x.op, x.right))
        x = x.left
    first, rest = compiled(x, scope), [(op, compiled(y, scope)) for op, y in reversed(steps)]
    if all(t.kind == Kind.INT for t in (first, *(t for _, t in rest))):
        columns = [(first.col, first.depth), *((-t.col if op == "-" else t.col, t.depth + 1) for op, t in rest)]
        col, depth = balanced(columns, Column.__mul__ if e.op == "*" else Column.__add__)
        return Typed(col, Kind.INT, depth=depth)
    out = first
    for op, t in rest:
        out = replace(arithmetic(op, out, t), depth=1 + max(out.depth, t.depth))
        if out.depth > DEEPEST:
            break
    return out


def balanced(columns: list[tuple[Column, int]], join) -> tuple[Column, int]:
    """Neighbours joined in pairs, pairs in pairs and so on: a tree as deep as the logarithm of the chain."""
    while len(columns) > 1:
        pairs = [columns[i : i + 2] for i in range(0, len(columns), 2)]
        columns = [(join(p[0][0], p[1][0]), 1 + max(p[0][1], p[1][1])) if len(p) == 2 else p[0] for p in pairs]
    return columns[0]


def signed(e: n.Unary, scope: Scope) -> Typed:
    """A chain of NOT or of minus signs: two of them are none, but operands are still checked."""
    op, times, x = e.op, 0, e
    while isinstance(x, n.Unary) and x.op == op and not (times and scope.exprs and str(x) in scope.exprs):
        x, times = x.expr, times + 1
    t = compiled(x, scope)
    if op == "NOT":
        c = condition(t)
        return Typed(~c if times % 2 else c, Kind.BOOL, depth=t.depth + 1)
    if t.kind == Kind.NULL:
        return t
    if not t.kind.numeric:
        raise TypeMismatch(f"- wants a number, found {t.kind.value}")
    return Typed(-t.col if times % 2 else t.col, t.kind, depth=t.depth + 1)


def built(e: n.Expr, scope: Scope) -> Typed:
    match e:
        case n.Literal(value):
            return constant(value)
        case n.Name():
            return scope.of(e)
        case n.Aggregate():
            raise PlanError(f"aggregate {e} is not allowed here")
        case n.Unary():
            return signed(e, scope)
        case n.Binary("AND" | "OR" as op, _, _):
            parts = [compiled(x, scope) for x in chain(e, scope)]
            col, depth = balanced([(condition(t), t.depth) for t in parts], Column.__and__ if op == "AND" else Column.__or__)
            return Typed(col, Kind.BOOL, depth=depth)
        case n.Binary("+" | "-" | "*", _, _):
            return added(e, scope)
        case n.Binary():
            return pair(e, scope)
        case n.IsNull(x, negated):
            t = compiled(x, scope)
            return Typed(t.col.isNotNull() if negated else t.col.isNull(), Kind.BOOL, depth=t.depth + 1)
    t = compiled(e.expr, scope)
    depth = t.depth
    match e:
        case n.Between(low=low, high=high):
            lo, hi = compiled(low, scope), compiled(high, scope)
            depth = max(depth, lo.depth, hi.depth)
            out = compare(">=", t, lo) & compare("<=", t, hi)
        case n.In(items=items):
            out, most = member(t, items, scope)
            depth = max(depth, most)
        case n.Like(pattern=p):
            q = compiled(p, scope)
            depth = max(depth, q.depth)
            out = like(t, q, p)
        case _:
            raise Unsupported(str(e))
    return Typed(~out if e.negated else out, Kind.BOOL, depth=depth + 2)


def pair(e: n.Binary, scope: Scope) -> Typed:
    x, y = compiled(e.left, scope), compiled(e.right, scope)
    out = arithmetic(e.op, x, y) if e.op in "+-*/%" else Typed(compare(e.op, x, y), Kind.BOOL)
    return replace(out, depth=1 + max(x.depth, y.depth))


def member(t: Typed, items: tuple[n.Expr, ...], scope: Scope) -> tuple[Column, int]:
    """An OR of equalities; literals of one kind become a set, which scans can prune by."""
    if t.kind != Kind.NULL and all(isinstance(x, n.Literal) and kind_of(x.value) == t.kind for x in items):
        return t.col.isin(*(F.lit(x.value).cast(t.kind.spark) for x in items)), 1
    found = [(y := compiled(x, scope)) and (compare("=", t, y), y.depth) for x in items]
    return balanced(found, Column.__or__)
