"""One fit a group, for models that Spark ML fits one by one."""

from __future__ import annotations

from collections.abc import Sequence
from concurrent.futures import ThreadPoolExecutor

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

PARALLEL_FITS = 4


def each_group(rows: DataFrame, grp: Sequence[str]):
    """(key, rows of the key) for every group; groups are datasets, folds, classes."""
    if not grp:
        yield {}, rows
        return
    for key in rows.select(*grp).distinct().orderBy(*grp).collect():
        part = rows
        for c in grp:
            part = part.filter(F.col(c).eqNullSafe(F.lit(key[c])))
        yield key, part


def map_groups(rows: DataFrame, grp: Sequence[str], fn) -> list:
    """``fn(key, rows)`` for every group, several independent fits at a time."""
    with ThreadPoolExecutor(PARALLEL_FITS) as pool:
        return list(pool.map(lambda item: fn(*item), list(each_group(rows, grp))))
