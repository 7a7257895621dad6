"""Column-expression helpers (all JVM-side, codegen friendly)."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import StructField, StructType


def dlit(x: float) -> Column:
    """A double literal (a bare Python float is a double in Spark, but be explicit)."""
    return F.lit(float(x)).cast("double")


def clip(c: Column, lo: float | None = None, hi: float | None = None) -> Column:
    """Clip to [lo, hi] keeping null as null.

    ``least``/``greatest`` skip nulls, so a plain ``least(greatest(x, lo), hi)`` would turn a
    null into ``hi``; pandas ``clip`` keeps NaN.
    """
    out = c
    if lo is not None:
        out = F.greatest(out, dlit(lo))
    if hi is not None:
        out = F.least(out, dlit(hi))
    return F.when(c.isNull(), F.lit(None).cast("double")).otherwise(out)


def nan_to_null(c: Column) -> Column:
    """NaN -> null (Spark orders NaN above every number and treats NaN = NaN as true)."""
    return F.nanvl(c, F.lit(None).cast("double"))


def seeded_hash_hex(key: Column, seed: int) -> Column:
    """md5 of ``key || '|' || seed`` as lower-case hex: a repartition-proof pseudo-random order."""
    return F.md5(F.concat(key.cast("string"), F.lit(f"|{int(seed)}")))


def round6(c: Column) -> Column:
    """Round aggregates to 6 decimals: summation order differs between engines."""
    return F.round(c, 6)


def schema_with(schema: StructType, **more: str) -> StructType:
    """A copy of ``schema`` with more fields, types as DDL."""
    return StructType([*schema.fields, *(StructField(n, StructType.fromDDL(f"c {t}")[0].dataType) for n, t in more.items())])
