"""Exact quantiles of many columns without holding a column in one place."""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from evenkeel.operators.runtime import SMALL_ROWS

DIRECT_ROWS = 1_000_000  # up to here one aggregate that keeps distinct values is cheap
BANDS = 1024


def exact_quantiles(df: DataFrame, cols: Sequence[str], probs: Sequence[float], direct_rows: int = DIRECT_ROWS) -> dict[str, list]:
    """Linearly interpolated quantiles of the values, ``{column: [one per prob]}``. Nulls and NaN are missing.

    Beyond ``direct_rows`` rows, band counts (combined before the shuffle) narrow an
    interval around each wanted rank until it holds few distinct values.
    """
    cols = list(cols)
    if not cols:
        return {}
    finite = [F.when(F.abs(_value(c)) < math.inf, _value(c)) for c in cols]
    head = df.agg(*[a for i, c in enumerate(cols) for a in (
        F.count(_value(c)).alias(f"n{i}"), F.min(finite[i]).alias(f"lo{i}"), F.max(finite[i]).alias(f"hi{i}"))]).first()
    if max(head[f"n{i}"] for i in range(len(cols))) <= direct_rows:
        levels = F.array(*[F.lit(float(p)) for p in probs])
        row = df.agg(*[F.percentile(_value(c), levels).alias(f"q{i}") for i, c in enumerate(cols)]).first()
        return {c: [float(v) for v in row[f"q{i}"]] if row[f"q{i}"] else [None] * len(probs) for i, c in enumerate(cols)}
    ranks = {}
    for i, c in enumerate(cols):
        n = head[f"n{i}"]
        for p in probs:
            for r in {math.floor(p * (n - 1)), math.ceil(p * (n - 1))} if n else ():
                ranks[c, r] = None
    found = _values_at(df, ranks, {c: (head[f"lo{i}"], head[f"hi{i}"]) for i, c in enumerate(cols)})
    out = {}
    for i, c in enumerate(cols):
        n = head[f"n{i}"]
        out[c] = []
        for p in probs:
            if not n:
                out[c].append(None)
                continue
            at = p * (n - 1)
            low, high = found[c, math.floor(at)], found[c, math.ceil(at)]
            out[c].append(low if low == high else low + (high - low) * (at - math.floor(at)))
    return out


def _value(c: str) -> Column:
    return F.nullif(F.col(c).cast("double"), F.lit(math.nan))


def _values_at(df: DataFrame, ranks: dict, span: dict) -> dict:
    """Value at each (column, 0-based rank); ``span`` has the finite bounds, infinities are bands of their own."""
    # interval [lo, hi], rows below lo, rows inside (unknown at first), bounds of the bands
    open_ = {key: (-math.inf, math.inf, 0, None, *(0.0 if b is None else b for b in span[key[0]])) for key in ranks}
    found = {}
    while open_:
        targets = list(open_)
        rows = F.array(*[
            F.struct(F.lit(t).alias("t"), _value(c).alias("v"), *[F.lit(float(open_[c, r][i])).alias(n) for i, n in ((0, "lo"), (1, "hi"), (4, "from"), (5, "to"))])
            for t, (c, r) in enumerate(targets)])
        long = df.select(F.explode(rows).alias("s")).select("s.*").filter("v >= lo AND v <= hi")
        counts = long.groupBy("t", "v").agg(F.count(F.lit(1)).alias("n"))
        few = [t for t, key in enumerate(targets) if open_[key][3] is not None and open_[key][3] <= SMALL_ROWS]
        if few:
            values: dict[int, list] = {}
            for row in counts.filter(F.col("t").isin(few)).collect():  # SMALL_ROWS values per target
                values.setdefault(row["t"], []).append((row["v"], row["n"]))
            for t in few:
                before = open_[targets[t]][2]
                for v, n in sorted(values[t]):
                    before += n
                    if before > targets[t][1]:
                        found[targets[t]] = v
                        break
                del open_[targets[t]]
        many = [t for t in range(len(targets)) if t not in few]
        if not many:
            continue
        wide = F.col("to") / BANDS - F.col("from") / BANDS
        band = F.when(F.col("v") == -math.inf, -1).when(F.col("v") == math.inf, BANDS).when(
            wide > 0, F.least((F.col("v") - F.col("from")) / wide, F.lit(float(BANDS - 1))).cast("int")).otherwise(0)
        bands = long.filter(F.col("t").isin(many)).withColumn("b", band).groupBy("t", "b").agg(
            F.count(F.lit(1)).alias("n"), F.min("v").alias("lo"), F.max("v").alias("hi")).collect()  # BANDS rows per target
        for t in many:
            key = targets[t]
            before = open_[key][2]
            for row in sorted((r for r in bands if r["t"] == t), key=lambda r: r["b"]):
                if before + row["n"] > key[1]:
                    if row["lo"] == row["hi"]:
                        found[key] = row["lo"]
                        del open_[key]
                    else:
                        open_[key] = (row["lo"], row["hi"], before, row["n"], row["lo"], row["hi"])
                    break
                before += row["n"]
    return found
