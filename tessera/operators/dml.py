"""INSERT, UPDATE and DELETE as deltas: the rows that a statement adds, changes or deletes."""

from __future__ import annotations

from pyspark.sql import Column as SparkColumn
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..errors import ColumnNotFound, DuplicateKey, NotNullViolated, NullKey, PlanError, TypeMismatch
from ..functions.constants import evaluated
from ..functions.scalars import compiled, condition, wrapping
from ..plans import nodes as n
from ..plans.kinds import Kind, kind_of, shown
from ..sources.catalog import Entry
from ..sources.store import DELETED, delta_schema
from ..sources.tables import Column, Table
from .select import scope_of


def stored(value: object, c: Column, table: str) -> object:
    """value as column c keeps it: integers become floats there, nothing else is converted."""
    kind = kind_of(value)
    if kind == Kind.NULL:
        if c.primary_key:
            raise NullKey(f"{table}.{c.name}")
        if c.not_null:
            raise NotNullViolated(f"{table}.{c.name}")
        return None
    check_kind(kind, c, table)
    return float(value) if c.kind == Kind.FLOAT else value


def check_kind(kind: Kind, c: Column, table: str) -> None:
    if kind not in (c.kind, Kind.NULL) and not (kind == Kind.INT and c.kind == Kind.FLOAT):
        raise TypeMismatch(f"{table}.{c.name}: cannot store {kind.value} in a {c.kind.value} column")


def insert(s: n.Insert, entry: Entry, table: Table) -> tuple[DataFrame, int]:
    for i, name in enumerate(s.columns):
        if name in s.columns[:i]:
            raise PlanError(f'column "{name}" listed twice in INSERT')
    targets = [entry.column(c) for c in s.columns] or list(entry.columns)
    for i, row in enumerate(s.rows):
        if len(row) != len(targets):
            raise PlanError(f"row {i + 1} has {len(row)} values, table {entry.name} wants {len(targets)}")
    key, rows, seen = entry.key, [], {}
    for row in s.rows:
        given = {c.name: evaluated(e) for c, e in zip(targets, row, strict=True)}
        made = tuple(stored(given.get(c.name), c, entry.name) for c in entry.columns)
        k = made[key.position]
        if k in seen:
            raise DuplicateKey(f"{entry.name}.{key.name} = {shown(k)}")
        seen[k] = True
        rows.append((*made, False))
    spark = table.frame.sparkSession
    clash = table.frame.filter(F.col(key.physical).isin(list(seen))).select(key.physical).limit(len(seen)).collect()
    if clash:
        taken = {r[0] for r in clash}
        raise DuplicateKey(f"{entry.name}.{key.name} = {shown(next(k for k in seen if k in taken))}")
    return spark.createDataFrame(rows, delta_schema(entry)).coalesce(1), len(rows)


def matched(where: n.Expr | None, table: Table) -> DataFrame:
    if where is None:
        return table.frame
    return table.frame.filter(condition(compiled(where, scope_of(table))))


def delete(s: n.Delete, entry: Entry, table: Table) -> DataFrame:
    with wrapping(table.frame.sparkSession):
        return matched(s.where, table).withColumn(DELETED, F.lit(True))


def update(s: n.Update, entry: Entry, table: Table) -> tuple[DataFrame, bool]:
    """(old rows with their new values beside them, whether keys move)."""
    with wrapping(table.frame.sparkSession):
        scope, new = scope_of(table), {}
        for name, e in s.sets:
            if name not in {c.name for c in entry.columns}:
                raise ColumnNotFound(f"{entry.name}.{name}")
            c, t = entry.column(name), compiled(e, scope)
            check_kind(t.kind, c, entry.name)
            new[c.position] = t.to(c.kind)
        rows = matched(s.where, table)
        values: list[SparkColumn] = [new.get(c.position, F.col(c.physical)).alias(f"n{c.position}") for c in entry.columns]
        return rows.select("*", *values), entry.key.position in new


def check_update(rows: DataFrame, entry: Entry, table: Table, moves: bool) -> int:
    """The number of matched rows, once their new values are allowed."""
    required = [c for c in entry.columns if c.not_null]
    counts = rows.agg(F.count(F.lit(1)), *(F.count_if(F.col(f"n{c.position}").isNull()) for c in required)).first()
    for c, bad in zip(required, counts[1:], strict=True):
        if bad:
            raise (NullKey if c.primary_key else NotNullViolated)(f"{entry.name}.{c.name}")
    if moves and (taken := conflict(rows, entry, table)) is not None:
        raise DuplicateKey(f"{entry.name}.{entry.key.name} = {shown(taken)}")
    return counts[0]


def conflict(rows: DataFrame, entry: Entry, table: Table) -> object:
    """The first new key that is taken when its turn comes, in order of the old keys.

    A row moving from o to k meets another row that has k and does not move, or moves later
    (its own old key is above o), or one that moved to k before (its old key is below o)."""
    old, new = entry.key.physical, f"n{entry.key.position}"
    pairs = rows.select(F.col(old).alias("o"), F.col(new).alias("k"))
    moving = pairs.filter("o <> k")
    # of all that want one key, the first may go: the others meet it there
    wanted = moving.groupBy("k").agg(F.min("o").alias("first"), F.count(F.lit(1)).alias("n"))
    holders = table.frame.select(F.col(old).alias("k")).join(pairs.select(F.col("o").alias("k"), F.col("k").alias("to")), "k", "left")
    met = moving.join(wanted, "k").join(holders.withColumn("held", F.lit(True)), "k", "left")
    stays = F.col("held") & (F.col("to").isNull() | (F.col("to") == F.col("k")) | (F.col("k") > F.col("o")))
    bad = met.filter(F.coalesce(stays, F.lit(False)) | (F.col("o") > F.col("first"))).orderBy("o").select("k").first()
    return bad[0] if bad else None


def rewritten(s: n.Update | n.Delete, entry: Entry, table: Table, old: DataFrame) -> DataFrame:
    """old, rows of some of the table's files, as the statement leaves them; keys do not move."""
    with wrapping(old.sparkSession):
        scope = scope_of(table)
        hit = F.lit(True) if s.where is None else F.coalesce(condition(compiled(s.where, scope)), F.lit(False))
        if isinstance(s, n.Delete):
            return old.filter(~hit)
        new = {entry.column(name).position: compiled(e, scope).to(entry.column(name).kind) for name, e in s.sets}
        return old.select(*(F.when(hit, new[c.position]).otherwise(F.col(c.physical)).alias(c.physical) if c.position in new else F.col(c.physical) for c in entry.columns))


def updated(rows: DataFrame, entry: Entry, moves: bool) -> DataFrame:
    fresh = rows.select(*(F.col(f"n{c.position}").alias(c.physical) for c in entry.columns), F.lit(False).alias(DELETED))
    if not moves:
        return fresh
    old = entry.key.physical
    gone = rows.filter(F.col(old) != F.col(f"n{entry.key.position}")).select(*(F.col(c.physical) for c in entry.columns), F.lit(True).alias(DELETED))
    gone = gone.join(fresh.select(old), old, "left_anti").select(*fresh.columns)
    return fresh.unionByName(gone)
