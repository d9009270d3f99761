"""Seeded draws as pure functions of row identity.

``rand()`` depends on partitioning; these depend only on (seed, stream, keys), so
a retried task or another cluster size gives the same rows.
"""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

SPAN = 4294967296.0  # 2^32


def _col(key) -> Column:
    return F.col(key) if isinstance(key, str) else key


def raw32(seed: int, stream: str, *keys) -> Column:
    """Unsigned 32-bit integer from the md5 of ``seed|stream|keys``."""
    parts = [F.lit(str(seed)), F.lit(stream)] + [_col(k).cast("string") for k in keys]
    digest = F.md5(F.concat_ws("|", *parts).cast("binary"))
    return F.conv(F.substring(digest, 1, 8), 16, 10).cast("bigint")


def uniform(seed: int, stream: str, *keys) -> Column:
    """U[0, 1)."""
    return raw32(seed, stream, *keys) / F.lit(SPAN)


def pick(seed: int, stream: str, n, *keys) -> Column:
    """Uniform integer in ``0 .. n-1``."""
    return F.floor(uniform(seed, stream, *keys) * _col(n)).cast("bigint")


def normal(seed: int, stream: str, *keys) -> Column:
    """Standard normal by Box-Muller on the streams ``<stream>a`` and ``<stream>b``."""
    first = (raw32(seed, stream + "a", *keys) + F.lit(1)) / F.lit(SPAN + 1)
    angle = uniform(seed, stream + "b", *keys) * F.lit(2 * math.pi)
    return F.sqrt(F.lit(-2.0) * F.log(first)) * F.cos(angle)
