"""Float values as four bytes of a pixel: sign and mantissa in three, the exponent in the fourth."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def floor_log2(x: Column) -> Column:
    """floor(log2(x)) corrected for the logarithm's last bit."""
    e = F.floor(F.log2(x))
    return e - F.when(F.pow(F.lit(2.0), e) > x, 1).otherwise(0) + F.when(F.pow(F.lit(2.0), e + 1) <= x, 1).otherwise(0)


def float_to_rgba(v: Column, nodata: float, with_sign: bool = True) -> tuple[Column, ...]:
    """r, g, b, a; all 0 where v is null or at most nodata.  with_sign=False leaves out the unit added by the sign."""
    masked = v.isNull() | (v <= nodata)
    size, sign = F.abs(v), F.signum(v)
    e = floor_log2(size + (1.0 - sign * sign))
    m = 8388608 + (sign if with_sign else F.lit(0.0)) + sign * 8388608 * (size / F.pow(F.lit(2.0), e) - 1.0)
    r, g = F.floor(m / 65536), F.floor(F.pmod(m, F.lit(65536.0)) / 256)
    parts = r, g, F.floor(m - r * 65536 - g * 256), e + 128
    return tuple(F.when(masked, F.lit(0)).otherwise(p).cast("int") for p in parts)


def rgba_to_float(r: Column, g: Column, b: Column, a: Column) -> Column:
    """The value of float_to_rgba's bytes, to 23 bits; null where alpha is 0."""
    m = r * 65536 + g * 256 + b - 8388608
    sign = F.signum(m.cast("double"))
    return F.when(a == 0, F.lit(None).cast("double")).when(m == 0, F.lit(0.0)).otherwise(sign * F.pow(F.lit(2.0), a - 128) * ((F.abs(m) - 1) / 8388608.0 + 1.0))


def nodata_of_type(kind: Column) -> Column:
    """Default nodata of a band by the name of its type."""
    return F.when(kind.startswith("uint"), 0).when(kind == "int8", -128).when(kind == "int16", -32000).when(kind == "float16", -65000).otherwise(-99999).cast("int")
