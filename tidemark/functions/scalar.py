"""Column functions of one row."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def col(x: str | Column) -> Column:
    return F.col(x) if isinstance(x, str) else x


def midpoint() -> Column:
    return (F.col("low") + F.col("high")) / 2


def is_green() -> Column:
    return F.col("close") >= F.col("open")


def wax_top() -> Column:
    return F.greatest("open", "close")


def wax_bottom() -> Column:
    return F.least("open", "close")


def wax_height() -> Column:
    return wax_top() - wax_bottom()


def upper_wick() -> Column:
    return F.col("high") - wax_top()


def lower_wick() -> Column:
    return wax_bottom() - F.col("low")


def wax_contains(v: str | Column) -> Column:
    return (wax_bottom() < col(v)) & (col(v) < wax_top())


def weighted_price(wo: float, wl: float, wh: float, wc: float) -> Column:
    return (F.col("open") * wo + F.col("low") * wl + F.col("high") * wh + F.col("close") * wc) / (wo + wl + wh + wc)


def opening_wick() -> Column:
    return F.when(is_green(), F.col("open") - F.col("low")).otherwise(F.col("high") - F.col("open"))


def simple_signal(bias: str | Column) -> Column:
    return F.when(col(bias) == "Buy", 1).otherwise(-1)


def bias(x: str | Column) -> Column:
    return F.when(col(x) >= 0, "Buy").otherwise("Sell")


def pct_of(a: str | Column, b: str | Column) -> Column:
    """(a - b) / a * 100; null where a is 0."""
    return F.try_divide(col(a) - col(b), col(a)) * 100


def quantize(v: str | Column, least: float, step: float) -> Column:
    """Nearest multiple of step above least; ties to the even multiple."""
    return F.rint((col(v) - least) / step) * step + least


def clamp(v: str | Column, low: Column | float, high: Column | float) -> Column:
    lit = lambda x: x if isinstance(x, Column) else F.lit(x)
    return F.least(lit(high), F.greatest(lit(low), col(v)))


def whole(v: str | Column) -> Column:
    """Gene as a whole number, ties to even."""
    return F.rint(col(v)).cast("int")


def gaussian(sd: float, x: str | Column) -> Column:
    """exp(-(x / sd)^2), without the half."""
    return F.exp(-F.pow(col(x) / sd, 2))


def logistic(x: str | Column) -> Column:
    return 1 / (1 + F.exp(-col(x)))


def dot(a: str | Column, b: str | Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x * y), F.lit(0.0), lambda s, x: s + x)


def norm2(a: str | Column) -> Column:
    return F.sqrt(F.aggregate(a, F.lit(0.0), lambda s, x: s + x * x))


def squared_gap(a: str | Column, b: str | Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: (x - y) * (x - y)), F.lit(0.0), lambda s, x: s + x)


def complement_code(a: str | Column) -> Column:
    return F.concat(a, F.transform(a, lambda v: 1 - v))


def uniform(seed: int, low: float, high: float, *keys: str) -> Column:
    """A draw from low..high, high left out, that depends on the keys and the seed alone: 32 bits of an MD5, the same on every engine."""
    text = F.concat_ws(":", F.lit(seed), *[F.col(k).cast("string") for k in keys])
    return F.conv(F.substring(F.md5(text), 1, 8), 16, 10).cast("double") / float(1 << 32) * (high - low) + low


def with_prob(seed: int, p: float, *keys: str) -> Column:
    """True with probability p."""
    return uniform(seed, 0.0, 1.0, *keys) < p


def random_vector(seed: int, n: int, low: float, high: float, *keys: str) -> Column:
    """n draws from low..high, each its own."""
    return F.array(*[uniform(seed * 65536 + i, low, high, *keys) for i in range(n)])
