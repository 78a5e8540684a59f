"""SELECT as a DataFrame: filter, group, sort, project, distinct, limit, in that order.

A result is ordered where order can be seen: under ORDER BY, LIMIT or OFFSET, or when the caller
reads rows. Ties follow the primary key, or the group key above an aggregation. A lazy DataFrame
without those clauses is left unordered, so that it costs no sort."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..errors import PlanError
from ..functions.aggregates import aggregated
from ..functions.scalars import Scope, Typed, compiled, condition, wrapping
from ..plans import nodes as n
from ..sources.tables import Table


def scope_of(table: Table) -> Scope:
    return Scope(table.name, {c.name: Typed(F.col(c.physical), c.kind) for c in table.columns}, hidden=frozenset(table.hidden))


def star(table: Table) -> list[n.Output]:
    return [n.Output(n.Name(c.name), c.name) for c in table.columns]


def select(s: n.Select, table: Table, *, ordered: bool = False) -> DataFrame:
    spark = table.frame.sparkSession
    with wrapping(spark):
        scope, df = scope_of(table), table.frame
        if s.where is not None:
            df = df.filter(condition(compiled(s.where, scope)))
        outputs = [x for o in s.outputs for x in ([o] if o.expr is not None else star(table))]
        ties = [F.col(c.physical) for c in table.columns if c.primary_key]
        if s.grouped:
            if any(o.expr is None for o in s.outputs):
                raise PlanError("SELECT * cannot be combined with aggregation")
            df, scope, ties = grouped(s, df, scope)
        keys = [(str(o.expr), compiled(o.expr, scope).col, o.descending) for o in s.order_by]
        cols = [(str(o.expr), compiled(o.expr, scope), o.name) for o in outputs]
        seen = ordered or s.limit is not None or s.offset > 0 or bool(keys)
        out = (distinct if s.distinct else projected)(df, cols, keys, ties, seen, s)
        return out.toDF(*(name for _, _, name in cols))


def directed(col: Column, descending: bool) -> Column:
    return col.desc() if descending else col.asc()


def cut(df: DataFrame, s: n.Select) -> DataFrame:
    df = df.offset(s.offset) if s.offset else df
    return df if s.limit is None else df.limit(s.limit)


def projected(df: DataFrame, cols: list, keys: list, ties: list, seen: bool, s: n.Select) -> DataFrame:
    if seen and (keys or ties):
        df = df.orderBy(*(directed(c, d) for _, c, d in keys), *ties)
    return cut(df, s).select(*(t.col.alias(f"o{i}") for i, (_, t, _) in enumerate(cols)))


def distinct(df: DataFrame, cols: list, keys: list, ties: list, seen: bool, s: n.Select) -> DataFrame:
    """Equal output rows count once, at the place of the first of them in sorted order."""
    names = [f"o{i}" for i in range(len(cols))]
    outs = [t.col.alias(o) for o, (_, t, _) in zip(names, cols, strict=True)]
    if not seen or not (keys or ties):
        return cut(df.select(*outs).distinct(), s)
    at = {text: o for o, (text, _, _) in zip(names, cols, strict=True)}
    if {text for text, _, _ in keys} == set(at):  # the keys order distinct rows without ties
        return cut(df.select(*outs).distinct().orderBy(*(directed(F.col(at[text]), d) for text, _, d in keys)), s)
    order = [*((c, d) for _, c, d in keys), *((c, False) for c in ties)]
    marked = df.select(*outs, *(c.alias(f"k{i}") for i, (c, _) in enumerate(order)))
    by = [directed(F.col(f"k{i}"), d) for i, (_, d) in enumerate(order)]
    # the first row of each group: map tasks keep only their own first rows before the shuffle
    first = F.row_number().over(Window.partitionBy(*names).orderBy(*by))
    return cut(marked.withColumn("first", first).filter("first = 1").orderBy(*by), s).select(*names)


def grouped(s: n.Select, df: DataFrame, scope: Scope) -> tuple[DataFrame, Scope, list[Column]]:
    out = Scope(scope.table, {}, grouped=True, hidden=scope.hidden, below=scope)
    keys = []
    for i, g in enumerate(s.group_by):
        if n.has_aggregate(g):
            raise PlanError("GROUP BY cannot contain an aggregate")
        t = compiled(g, scope)
        keys.append(t.col.alias(f"g{i}"))
        out.exprs[str(g)] = Typed(F.col(f"g{i}"), t.kind)
        if isinstance(g, n.Name):
            out.names[g.name] = out.exprs[str(g)]
    calls = []
    for e in (*(o.expr for o in s.outputs), *(o.expr for o in s.order_by)):
        for x in e.walk():
            if isinstance(x, n.Aggregate) and str(x) not in out.exprs:
                t = aggregated(x, scope)
                out.exprs[str(x)] = Typed(F.col(f"a{len(calls)}"), t.kind)
                calls.append(t.col.alias(f"a{len(calls)}"))
    if calls:
        made = df.groupBy(*keys).agg(*calls) if keys else df.agg(*calls)
    else:
        made = df.select(*keys).distinct()
    return made, out, [F.col(f"g{i}") for i in range(len(keys))]
