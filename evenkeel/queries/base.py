"""Registry of demonstration queries and their SQL twins, and shared inputs."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from evenkeel.functions.vectors import explode_features, pack

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}

DIM = 64  # width of the embedding vectors


def query(name: str, sql: str | None = None):
    def add(fn):
        QUERIES[name] = fn
        if sql:
            ORACLES[name] = sql
        return fn

    return add


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


# ---- points from the given tables, and the same in SQL ------------------


def embedding_points(spark, sf_dir) -> DataFrame:
    """Embeddings, label 0 against the rest (about 1 : 9)."""
    return table(spark, sf_dir, "embeddings").select(
        F.col("vec_id").alias("row_id"), (F.col("label") == 0).cast("int").alias("label"),
        F.col("embedding").cast("array<double>").alias("features"))


PTS = """pts AS (SELECT vec_id AS row_id, CASE WHEN label = 0 THEN 1 ELSE 0 END AS label,
  embedding::DOUBLE[] AS x FROM embeddings)"""

LINE_COLS = ["l_quantity", "l_extendedprice", "l_discount", "l_tax"]
LINE_KEY = ["l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice", "l_shipdate", "l_quantity",
            "l_discount", "l_tax", "l_returnflag", "l_linestatus"]


def flat(df: DataFrame) -> DataFrame:
    """A resampled frame as plain columns, provenance nulls as -1."""
    cols = [F.coalesce(c, F.lit(-1).cast("bigint")).alias(c) for c in ("base_id", "nbr_id", "rep")]
    by = [c for c in df.columns if c not in ("row_id", "label", "features", "is_synthetic", "base_id", "nbr_id", "rep")]
    keep = [*by, "row_id", "label", F.col("is_synthetic").cast("int").alias("is_synthetic"), *cols]
    return explode_features(df.select(*keep, "features"), keep=[*by, "row_id", "label", "is_synthetic", "base_id", "nbr_id", "rep"])


# ---- SQL fragments -------------------------------------------------------


def raw(stream: str, *keys, seed=42) -> str:
    parts = ", ".join([f"'{seed}'", f"'{stream}'", *[str(k) for k in keys]])
    return f"('0x' || substr(md5(concat_ws('|', {parts})), 1, 8))::BIGINT"


def u(stream: str, *keys, seed=42) -> str:
    return f"({raw(stream, *keys, seed=seed)} / 4294967296::DOUBLE)"


def z(stream: str, *keys, seed=42) -> str:
    first = f"(({raw(stream + 'a', *keys, seed=seed)} + 1) / 4294967297::DOUBLE)"
    return f"(sqrt(-2 * ln({first})) * cos(2 * pi() * {u(stream + 'b', *keys, seed=seed)}))"


def pick(stream: str, n: str, *keys) -> str:
    return f"floor({u(stream, *keys)} * {n})::BIGINT"


def with_(*ctes: str) -> str:
    return "WITH " + ",\n".join(ctes)


def knn(name: str, q: str, r: str, k: int, by: str = "", skip_self: bool = True, carry: str = "") -> str:
    """CTE (q_id, rk, nbr_id, dist) by brute force."""
    conds = [f"a.{c} = b.{c}" for c in by.split()] + (["a.row_id <> b.row_id"] if skip_self else [])
    group = "".join(f"a.{c} AS {c}, " for c in by.split())
    part = ", ".join([*by.split(), "q_id"])
    more = "".join(f", b.{c} AS nbr_{c}" for c in carry.split())
    return f"""{name} AS (SELECT *, row_number() OVER (PARTITION BY {part} ORDER BY dist, nbr_id) AS rk FROM (
  SELECT {group}a.row_id AS q_id, b.row_id AS nbr_id, round(list_distance(a.x, b.x), 9) AS dist{more}
  FROM {q} a JOIN {r} b ON {' AND '.join(conds) or 'true'}) QUALIFY rk <= {k})"""


MIN_CTES = [
    PTS,
    "p AS (SELECT * FROM pts WHERE label = 1)",
    "need AS (SELECT greatest(0, count(*) FILTER (label = 0) - count(*) FILTER (label = 1)) AS g FROM pts)",
    "slots AS (SELECT unnest(range(1, g + 1)) AS rep FROM need)",
]
OWN = knn("own", "p", "p", 5)
OWNK = "ownk AS (SELECT q_id, count(*) AS kk FROM own GROUP BY q_id)"
CROWD = [
    knn("near", "p", "pts", 5, carry="label"),
    "crowd AS (SELECT q_id AS row_id, sum((nbr_label <> 1)::INT)::BIGINT AS m, count(*) AS kk FROM near GROUP BY q_id)",
]


def uniform_draw(bases: str, name: str = "draw", stream: str = "base", made: str = "slots", out: str = "base_id") -> str:
    """CTEs drawing a row of ``bases`` for every slot."""
    return f"""{name}_idx AS (SELECT row_id, row_number() OVER (ORDER BY {u('idx', 'row_id')}, row_id) AS idx FROM {bases}),
{name}_aim AS (SELECT s.*, {pick(stream, 'c.n', 1, 's.rep')} + 1 AS aim FROM {made} s CROSS JOIN (SELECT count(*) AS n FROM {bases}) c),
{name} AS (SELECT s.* EXCLUDE (aim), i.row_id AS {out} FROM {name}_aim s JOIN {name}_idx i ON i.idx = s.aim)"""


NBR = f"""paired AS (SELECT d.*, o.nbr_id FROM draw d LEFT JOIN ownk k ON k.q_id = d.base_id
  LEFT JOIN own o ON o.q_id = d.base_id AND o.rk = {pick('nbr', 'k.kk', 1, 'd.rep')} + 1)"""


def resampled(ctes: list[str], source: str, value: str, originals: str = "pts", dim: int = DIM, keep: str = "true") -> str:
    """Originals and synthetic rows; ``source`` has rep, base_id, nbr_id, and ``value`` gives
    feature ``pos`` (0-based) of a synthetic row."""
    return f"""{with_(*ctes)}
SELECT row_id, label::INT AS label, 0 AS is_synthetic, -1::BIGINT AS base_id, -1::BIGINT AS nbr_id, -1::BIGINT AS rep,
  pos::INT AS pos, round(x[pos + 1], 6) + 0.0::DOUBLE AS val FROM {originals} CROSS JOIN range(0, {dim}) r(pos)
UNION ALL
SELECT -(rep * 1000 + 1)::BIGINT, 1, 1, base_id::BIGINT, coalesce(nbr_id, -1)::BIGINT, rep::BIGINT,
  pos::INT, round({value}, 6) + 0.0::DOUBLE FROM {source} s CROSS JOIN range(0, {dim}) r(pos) WHERE {keep}"""
