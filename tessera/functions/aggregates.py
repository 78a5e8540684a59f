"""The five aggregates."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..errors import TypeMismatch
from ..plans import nodes as n
from ..plans.kinds import Kind
from .scalars import Scope, Typed, compiled


def aggregated(call: n.Aggregate, scope: Scope) -> Typed:
    if call.arg is None:
        return Typed(F.count(F.lit(1)), Kind.INT)
    arg = compiled(call.arg, scope)
    if call.func == "COUNT":
        return Typed(F.count(arg.col), Kind.INT)
    if call.func in ("MIN", "MAX"):
        return Typed((F.min if call.func == "MIN" else F.max)(arg.col), arg.kind)
    if not arg.kind.numeric and arg.kind != Kind.NULL:
        raise TypeMismatch(f"{call.func} wants numbers, found {arg.kind.value}")
    if call.func == "SUM":
        return Typed(F.sum(arg.col), arg.kind)
    return Typed(F.avg(arg.to(Kind.FLOAT)), Kind.FLOAT)
