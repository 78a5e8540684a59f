"""A table as queries see it: named, typed columns over a DataFrame with columns c0, c1, ..."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..plans.kinds import Kind, kind_of_type


@dataclass(frozen=True)
class Column:
    name: str
    kind: Kind
    position: int
    not_null: bool = False
    primary_key: bool = False

    @property
    def physical(self) -> str:
        return f"c{self.position}"


@dataclass(frozen=True)
class Table:
    name: str
    columns: tuple[Column, ...]
    frame: DataFrame = field(compare=False)
    hidden: tuple[str, ...] = ()

    @property
    def key(self) -> Column | None:
        return next((c for c in self.columns if c.primary_key), None)


def physical_schema(columns: tuple[Column, ...]) -> T.StructType:
    return T.StructType([T.StructField(c.physical, c.kind.spark, True) for c in columns])


def registered(name: str, data: DataFrame | str, key: str | None, spark: SparkSession) -> Table:
    """External data, read-only. Columns of types outside the dialect are hidden."""
    df = spark.read.parquet(data) if isinstance(data, str) else data
    fits = [(f.name, kind_of_type(f.dataType)) for f in df.schema]
    columns = tuple(Column(n, k, i, primary_key=n == key) for i, (n, k) in enumerate((n, k) for n, k in fits if k))
    quoted = lambda n: F.col("`" + n.replace("`", "``") + "`")
    types = {f.name: f.dataType for f in df.schema}
    frame = df.select(*((quoted(c.name) if types[c.name] == c.kind.spark else quoted(c.name).cast(c.kind.spark)).alias(c.physical) for c in columns))
    return Table(name, columns, frame, tuple(n for n, k in fits if not k))
