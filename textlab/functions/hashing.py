"""Deterministic pseudo-random order from md5.

Every "random" choice in the library (splits, samples, shuffles, draws) is an
order by ``md5(seed ':' salt ':' key)``. The value depends on the row's key
only, so the result is the same on any partitioning, any executor count and on
DuckDB (whose ``md5`` gives the same hex string).
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def _col(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def hash_order(key, seed: int | str = 42, salt: str = "") -> Column:
    """Hex md5 string; sort ascending (then by key) for a seeded shuffle."""
    return F.md5(F.concat(F.lit(str(seed)), F.lit(":"), F.lit(salt), F.lit(":"),
                          _col(key).cast("string")))


def hfrac(salt, key) -> Column:
    """Uniform number in [0, 1) from the first 32 bits of ``md5(salt ':' key)``.

    ``salt`` may be a literal or a column.
    """
    s = F.lit(salt) if isinstance(salt, str) else salt
    h = F.md5(F.concat(s, F.lit(":"), _col(key).cast("string")))
    return F.conv(F.substring(h, 1, 8), 16, 10).cast("bigint") / F.lit(4294967296.0)


def hash_bucket(key, n: int, seed: int | str = 42, salt: str = "") -> Column:
    """Integer in [0, n) from the hash order, for blocking and draws."""
    h = hash_order(key, seed, salt)
    return (F.conv(F.substring(h, 1, 8), 16, 10).cast("bigint") % F.lit(n)).cast("int")
