"""Column builders: distances, hash uniforms, guarded ratios."""

from __future__ import annotations

import hashlib

from pyspark.sql import Column
from pyspark.sql import functions as F


def _fold(a: Column, b: Column, term) -> Column:
    return F.aggregate(F.zip_with(a, b, term), F.lit(0.0), lambda s, v: s + v)


def squared(a, b) -> Column:
    return _fold(a, b, lambda p, q: (p - q) * (p - q))


def l1(a, b) -> Column:
    return _fold(a, b, lambda p, q: F.abs(p - q))


def l2(a, b) -> Column:
    return F.sqrt(squared(a, b))


def lp(a, b, p: float) -> Column:
    return F.pow(_fold(a, b, lambda x, y: F.pow(F.abs(x - y), F.lit(p))), F.lit(1.0 / p))


METRICS = {"L1": l1, "L2": l2}


def squared_to(x: Column, centre: list[float]) -> Column:
    """Unrolled literal arithmetic, left to right: stays in generated code."""
    out = None
    for j, c in enumerate(centre):
        t = (x[j] - F.lit(float(c))) * (x[j] - F.lit(float(c)))
        out = t if out is None else out + t
    return out


def nearest(x: Column, centres: list[list[float]]) -> Column:
    """struct(d2, cluster) of the nearest centre; the first wins ties; null without centres."""
    if not centres:
        return F.lit(None).cast("struct<d2:double,cluster:int>")
    return F.array_min(F.array(*[F.struct(squared_to(x, c).alias("d2"), F.lit(i).alias("cluster")) for i, c in enumerate(centres)]))


def uniform(seed: int, salt: str, key: str = "id") -> Column:
    """In (0, 1], from the first 32 bits of md5('seed:salt:key'); the same in any engine."""
    h = F.conv(F.substring(F.md5(F.concat_ws(":", F.lit(str(seed)), F.lit(salt), F.col(key).cast("string"))), 1, 8), 16, 10).cast("long")
    return (h + 1) / F.lit(4294967296.0)


def uniform_of(seed: int, salt: str, key: int) -> float:
    """`uniform` of one key, on the driver."""
    return (int(hashlib.md5(f"{seed}:{salt}:{key}".encode()).hexdigest()[:8], 16) + 1) / 4294967296.0


def race(seed: int, salt: str, weight: Column, key: str = "id") -> Column:
    """The row with the least value is drawn with probability in proportion to its weight."""
    return -F.ln(uniform(seed, salt, key)) / weight


def ratio(a: Column, b: Column) -> Column:
    return F.when(b == 0, 0.0).otherwise(a / b)
