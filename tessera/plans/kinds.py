"""The five kinds of value and how they look."""

from __future__ import annotations

import math
from decimal import Decimal
from enum import Enum

from pyspark.sql import types as T


class Kind(str, Enum):
    NULL = "NULL"
    BOOL = "BOOL"
    INT = "INT"
    FLOAT = "FLOAT"
    TEXT = "TEXT"

    @property
    def spark(self) -> T.DataType:
        return SPARK[self]

    @property
    def numeric(self) -> bool:
        return self in (Kind.INT, Kind.FLOAT)


#: A NULL literal needs some type; every other kind casts from it.
SPARK = {Kind.NULL: T.LongType(), Kind.BOOL: T.BooleanType(), Kind.INT: T.LongType(), Kind.FLOAT: T.DoubleType(), Kind.TEXT: T.StringType()}
# The type names of the dialect.
SPELLINGS = {"bool": Kind.BOOL, "boolean": Kind.BOOL, "int": Kind.INT, "integer": Kind.INT, "bigint": Kind.INT, "float": Kind.FLOAT, "real": Kind.FLOAT, "double": Kind.FLOAT, "text": Kind.TEXT, "string": Kind.TEXT, "varchar": Kind.TEXT}


def kind_named(name: str) -> Kind | None:
    return SPELLINGS.get(name.lower())


def kind_of_type(t: T.DataType) -> Kind | None:
    """The kind that holds a Spark type without loss, if there is one."""
    if isinstance(t, T.BooleanType):
        return Kind.BOOL
    if isinstance(t, (T.ByteType, T.ShortType, T.IntegerType, T.LongType)):
        return Kind.INT
    if isinstance(t, (T.FloatType, T.DoubleType)):
        return Kind.FLOAT
    return Kind.TEXT if isinstance(t, (T.StringType, T.VarcharType, T.CharType)) else None


def kind_of(value: object) -> Kind:
    for types, kind in ((bool, Kind.BOOL), (int, Kind.INT), (float, Kind.FLOAT), (str, Kind.TEXT)):
        if isinstance(value, types):
            return kind
    return Kind.NULL


def shown_float(x: float) -> str:
    """The shortest text that reads back as x, never without a point or an exponent."""
    if math.isnan(x):
        return "NaN"
    if math.isinf(x):
        return "+Inf" if x > 0 else "-Inf"
    sign, digits, exponent = Decimal(repr(x)).as_tuple()
    text = "".join(map(str, digits)).rstrip("0") or "0"
    power = len(digits) + exponent - 1 if text != "0" else 0
    minus = "-" if sign else ""
    if power < -4 or power >= 6:
        tail = f".{text[1:]}" if len(text) > 1 else ""
        return f"{minus}{text[0]}{tail}e{'-' if power < 0 else '+'}{abs(power):02d}"
    plain = repr(abs(x))
    if "e" in plain:
        plain = format(Decimal(plain), "f")
    return minus + (plain if "." in plain else f"{plain}.0")


def shown(value: object) -> str:
    """A value as a result table prints it."""
    if value is None:
        return "NULL"
    if isinstance(value, bool):
        return "true" if value else "false"
    return shown_float(value) if isinstance(value, float) else str(value)


def literal(value: object) -> str:
    """A value as the dialect writes it."""
    return "'" + value.replace("'", "''") + "'" if isinstance(value, str) else shown(value)
