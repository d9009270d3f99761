"""Compare queries with their SQL twins: python tests/check_queries.py <sf> [name or prefix ...]"""

import os
import sys
import time

import duckdb
import numpy as np
import pandas as pd

TABLES = ("region nation customer supplier part orders lineitem events documents embeddings pages benchmark "
          "labels conversations").split()


def connect(sf_dir):
    con = duckdb.connect()
    con.execute("SET TimeZone='UTC'")
    for name in TABLES:
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{sf_dir}/{name}.parquet'")
    return con


def tidy(pdf: pd.DataFrame) -> pd.DataFrame:
    pdf = pdf[sorted(pdf.columns)].copy()
    for c in pdf.columns:
        if pd.api.types.is_bool_dtype(pdf[c]):
            pdf[c] = pdf[c].astype("int64")
        if pd.api.types.is_numeric_dtype(pdf[c]):
            pdf[c] = pdf[c].astype("float64")
        elif not pd.api.types.is_datetime64_any_dtype(pdf[c]):
            pdf[c] = pdf[c].map(lambda v: None if v is None or v is pd.NA or v != v else str(v))
    return pdf.sort_values(list(pdf.columns), ignore_index=True, na_position="first")


def difference(got: pd.DataFrame, want: pd.DataFrame) -> str | None:
    if sorted(got.columns) != sorted(want.columns):
        return f"columns {sorted(got.columns)} vs {sorted(want.columns)}"
    kinds = {c: (str(got[c].dtype), str(want[c].dtype)) for c in got.columns if got[c].dtype != want[c].dtype}
    odd = {c: k for c, k in kinds.items() if not ("int" in k[0] and "int" in k[1])
           and not any(w in k[0] + k[1] for w in ("datetime", "str", "object")) and k != ("float64", "Int64")}  # a column of whole numbers and nulls
    if odd and len(got):
        return f"types {odd}"
    if len(got) != len(want):
        return f"rows {len(got)} vs {len(want)}"
    a, b = tidy(got), tidy(want)
    for c in a.columns:
        if a[c].dtype == "float64":
            bad = ~((a[c] == b[c]) | (a[c].isna() & b[c].isna()))
            if bad.any():
                i = int(np.nonzero(bad.to_numpy())[0][0])
                return f"{int(bad.sum())} values differ in {c}, e.g. {a.iloc[i].to_dict()} vs {b.iloc[i].to_dict()}"
        elif not a[c].equals(b[c]) and not (a[c].isna() & b[c].isna() | (a[c] == b[c])).all():
            return f"values differ in {c}"
    return None


def main():
    from pyspark.sql import SparkSession

    sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
    import __spark_entry__ as entry

    sf_dir = f"/root/testdata/sf{sys.argv[1]}"
    wanted = sys.argv[2:]
    spark = (
        SparkSession.builder.master("local[8]").config("spark.sql.shuffle.partitions", "8")
        .config("spark.ui.enabled", "false").config("spark.ui.showConsoleProgress", "false").config("spark.driver.memory", "12g")
        .config("spark.sql.session.timeZone", "UTC").getOrCreate())
    spark.sparkContext.setLogLevel("ERROR")
    con = connect(sf_dir)
    queries, oracles = entry.queries(), entry.oracle_sql()
    for name, fn in queries.items():
        if wanted and not any(name == w or name.startswith(w) for w in wanted):
            continue
        start = time.time()
        try:
            got = fn(spark, sf_dir).toPandas()
            took = time.time() - start
            if name not in oracles:
                print(f"rows {len(got):7d} {took:6.1f}s {name} (no SQL)", flush=True)
                continue
            start = time.time()
            want = con.execute(oracles[name]).df()
            sql_took = time.time() - start
            why = difference(got, want)
            print(f"{'OK  ' if why is None else 'DIFF'} {len(got):7d} {took:6.1f}s sql {sql_took:5.1f}s {name} {why or ''}", flush=True)
        except Exception as error:  # noqa: BLE001  (a report over all queries)
            print(f"FAIL {name}: {type(error).__name__} {str(error)[:1500]}", flush=True)
    spark.stop()


if __name__ == "__main__":
    main()
