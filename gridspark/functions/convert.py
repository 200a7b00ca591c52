"""Conversions between element types as column expressions.

Numbers saturate, floats are cut toward zero, NaN becomes 0, and everything that becomes a float passes through a double.
Spark's casts raise on overflow and order NaN above all numbers, so values are clamped and NaN is taken out first.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

from .. import types as G
from ..errors import ConversionError

_I64 = (-(1 << 63), (1 << 63) - 1)


def saturate(v: Column, src: G.Type, dst: G.Type) -> Column:
    """A number of type src as dst."""
    if src == dst:
        return v
    if isinstance(dst, G.Float):
        return v.cast("double") if dst.bytes == 8 else v.cast("double").cast("float")
    lo, hi = dst.bounds
    spark = dst.spark().simpleString()
    if isinstance(src, G.Float):
        x = v.cast("double")
        cut = F.when(x >= 0, F.floor(x)).otherwise(F.ceil(x))
        if hi < 1 << 53:
            inside = F.greatest(F.least(x, F.lit(float(hi))), F.lit(float(lo))).cast(spark)
        elif isinstance(dst, G.Integer):
            inside = F.when(x >= 2.0**63, F.lit(hi)).when(x <= -(2.0**63), F.lit(lo)).otherwise(cut).cast("bigint")
        else:  # above 2^53 a double is an integer of 53 bits and a power of two: shift it exactly
            half = F.floor(x / 2.0**32).cast("decimal(20,0)")
            low = (x - F.floor(x / 2.0**32) * F.lit(2.0**32)).cast("bigint").cast("decimal(20,0)")
            exact = (half * F.lit(1 << 32).cast("decimal(20,0)") + low).cast("decimal(20,0)")
            inside = F.when(x >= 2.0**64, F.lit(str(hi)).cast("decimal(20,0)")).when(x <= 0, F.lit(0).cast("decimal(20,0)")).otherwise(exact)
        return F.when(F.isnan(x), F.lit(0).cast(spark)).otherwise(inside)
    s_lo, s_hi = src.bounds
    wide = "decimal(20,0)" if max(hi, s_hi) > _I64[1] else "bigint"
    x = v.cast(wide)
    if s_hi > hi:
        x = F.least(x, F.lit(str(hi)).cast(wide))
    if s_lo < lo:
        x = F.greatest(x, F.lit(str(lo)).cast(wide))
    return x.cast(spark)


def fixed_bytes(v: Column, n: int) -> Column:
    """The first n bytes of a string. A character that is cut through is lost to its string, so the result is binary-safe text."""
    return F.substring(v.cast("binary"), 1, n).cast("string")


def trim_padding(v: Column) -> Column:
    return F.rtrim(v, F.lit("\0"))


def convert(v: Column, src: G.Type, dst: G.Type) -> Column:
    """v of type src as dst; the path must exist."""
    if G.conversion_path(src, dst) is None:
        raise ConversionError(f"no conversion from {src} to {dst}")
    if src == dst:
        return v
    if isinstance(dst, (G.Integer, G.Unsigned, G.Float)):
        return saturate(v, src, dst)
    if isinstance(dst, G.FixedString):
        return trim_padding(fixed_bytes(v, dst.bytes))
    if isinstance(dst, G.VarLenString):
        return trim_padding(v)
    if isinstance(dst, G.Boolean):
        return v != 0
    if isinstance(dst, G.Enum):
        return v.cast(dst.spark())
    if isinstance(dst, G.Compound):
        by = {f.name: f.type for f in src.fields}
        return F.when(v.isNotNull(), F.struct(*[convert(v.getField(f.name), by[f.name], f.type).alias(f.name) for f in dst.fields]))
    return F.transform(v, lambda x: convert(x, src.item, dst.item))


def converter(src: G.Type, dst: G.Type, allowed: G.Conversion = G.Conversion.SOFT) -> Callable[[Column], Column]:
    G.check_conversion(src, dst, allowed)
    return lambda v: convert(v, src, dst)


def enum_name(v: Column, t: G.Enum) -> Column:
    """The member's name; null for a value without one."""
    names = F.create_map(*[F.lit(x) for n, value in t.members for x in (value, n)])
    return F.try_element_at(names, v.cast("int"))


def tensor_f32(v: Column, src: G.Type) -> Column:
    """What a tensor reader takes: any number as a float, booleans and enumerations as 0 and 1 or their value."""
    if isinstance(src, G.Boolean):
        return v.cast("int").cast("float")
    if isinstance(src, G.Enum):
        src = src.base
    if not isinstance(src, (G.Integer, G.Unsigned, G.Float)):
        raise ConversionError(f"{src} is no tensor element")
    return saturate(v, src, G.F32)
