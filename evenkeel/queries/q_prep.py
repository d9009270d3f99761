"""Queries for profiling and cleaning, with nulls and duplicates derived from the tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from evenkeel.operators import prep
from evenkeel.plans.recipes import Recipe, prepare
from evenkeel.operators.runtime import settle
from evenkeel.queries.base import query, table, u
from evenkeel.queries.q_split import LINE_ID, line_id
from evenkeel.functions.rng import uniform

# ---- tables with nulls: one value in sixteen is blanked by a hash of id and column ------


def blank(df, id, cols):
    hit = {c: F.substring(F.md5(F.concat(F.col(id).cast("string"), F.lit(c)).cast("binary")), 1, 1) == "0" for c in cols}
    return df.withColumns({c: F.when(~hit[c], F.col(c)) for c in cols})


def blank_sql(name, source, id, cols, rest=()):
    parts = [f"CASE WHEN substr(md5(concat({id}, '{c}')), 1, 1) = '0' THEN NULL ELSE {c} END AS {c}" for c in cols]
    return f"{name} AS (SELECT {', '.join([id, *parts, *rest])} FROM {source})"


CUST = ["c_nationkey", "c_acctbal", "c_mktsegment"]
CUST_SQL = blank_sql("t", "customer", "c_custkey", CUST)
PART = ["p_size", "p_retailprice", "p_brand"]
PART_SQL = blank_sql("t", "part", "p_partkey", PART)


def customers(spark, sf_dir):
    return blank(table(spark, sf_dir, "customer").select("c_custkey", *CUST), "c_custkey", CUST)


def parts(spark, sf_dir):
    return blank(table(spark, sf_dir, "part").select("p_partkey", *PART), "p_partkey", PART)


def shown(df):
    """Nulls as plain values: -1 for numbers, ``none`` for text."""
    fill = {f.name: "none" if f.dataType.typeName() == "string" else -1 for f in df.schema.fields}
    return df.withColumns({c: F.coalesce(F.col(c), F.lit(v).cast(df.schema[c].dataType)) for c, v in fill.items()})


SHOWN_CUST = "c_custkey, coalesce(c_nationkey, -1)::INT AS c_nationkey, coalesce(c_acctbal, -1) AS c_acctbal, coalesce(c_mktsegment, 'none') AS c_mktsegment"


def rounded(df, *cols):
    return df.withColumns({c: F.round(F.col(c).cast("double"), 6) + F.lit(0.0) for c in cols})


# ---- profiling -----------------------------------------------------------

LINE = ["l_quantity", "l_extendedprice", "l_discount", "l_tax"]


@query("p_distinct_ratio", "SELECT " + ", ".join(f"round(count(DISTINCT {c}) / count(*), 6) AS {c}" for c in LINE) + " FROM lineitem")
def p_distinct_ratio(spark, sf_dir):
    return rounded(prep.distinct_ratio(table(spark, sf_dir, "lineitem").select(*LINE), LINE), *LINE)


CONT_SQL = """WITH r AS (SELECT count(DISTINCT p_partkey) / count(*) AS p_partkey, count(DISTINCT p_size) / count(*) AS p_size,
  count(DISTINCT p_retailprice) / count(*) AS p_retailprice FROM part), l AS (UNPIVOT r ON COLUMNS(*) INTO NAME c VALUE v)
SELECT c AS "column" FROM l WHERE v > 0.1 """


def _continuous(spark, sf_dir, extra=()):
    df = table(spark, sf_dir, "part")
    numeric, _ = prep.split_columns(df)
    names = prep.continuous_columns(df, numeric, extra=extra)
    # the chosen columns, as rows
    return df.agg(*[F.count(c).alias(c) for c in names]).unpivot([], names, "column", "n").select("column")


query("p_continuous_columns", CONT_SQL)(lambda spark, sf_dir: _continuous(spark, sf_dir))
query("p_continuous_with_extra", CONT_SQL + " UNION SELECT 'p_size'")(
    lambda spark, sf_dir: _continuous(spark, sf_dir, ["p_size"]).distinct())


@query("p_missing_profile", f"WITH {CUST_SQL}, m AS (SELECT " + ", ".join(f"count(*) - count({c}) AS {c}" for c in CUST) +
       ' FROM t) UNPIVOT m ON COLUMNS(*) INTO NAME "column" VALUE missing')
def p_missing_profile(spark, sf_dir):
    return prep.missing_profile(customers(spark, sf_dir), CUST)


@query("p_value_range", "WITH r AS (" + " UNION ALL ".join(
    f"""SELECT '{c}' AS "column", min({c}) AS lo, max({c}) AS hi FROM lineitem""" for c in LINE) +
    """) SELECT "column", round(lo, 6) AS lo, round(hi, 6) AS hi FROM r UNION ALL SELECT '*', round(min(lo), 6), round(max(hi), 6) FROM r""")
def p_value_range(spark, sf_dir):
    return rounded(prep.value_range(table(spark, sf_dir, "lineitem").select(*LINE), LINE), "lo", "hi")


query("p_distinct_labels", "SELECT DISTINCT o_orderpriority FROM orders")(
    lambda spark, sf_dir: prep.distinct_labels(table(spark, sf_dir, "orders"), "o_orderpriority"))

# ---- cleaning ------------------------------------------------------------

query("p_sentinel_to_null", "SELECT o_orderkey, coalesce(nullif(o_orderpriority, '4-NOT SPECIFIED'), 'none') AS o_orderpriority, coalesce(nullif(o_orderstatus, 'P'), 'none') AS o_orderstatus FROM orders")(
    lambda spark, sf_dir: shown(prep.sentinel_to_null(
        prep.sentinel_to_null(table(spark, sf_dir, "orders").select("o_orderkey", "o_orderpriority", "o_orderstatus"), ["o_orderpriority"], "4-NOT SPECIFIED"),
        ["o_orderstatus"], "P")))
query("p_canonicalise", "SELECT o_orderkey, CASE o_orderpriority WHEN '4-NOT SPECIFIED' THEN 'LOW' WHEN '5-LOW' THEN 'LOW' ELSE o_orderpriority END AS o_orderpriority FROM orders")(
    lambda spark, sf_dir: prep.canonicalise(
        table(spark, sf_dir, "orders").select("o_orderkey", "o_orderpriority"), "o_orderpriority", {"4-NOT SPECIFIED": "LOW", "5-LOW": "LOW"}))
query("p_dedupe", "SELECT o_orderkey, o_custkey, o_orderstatus, o_orderpriority FROM orders QUALIFY row_number() OVER (PARTITION BY o_custkey, o_orderstatus ORDER BY o_orderkey) = 1")(
    lambda spark, sf_dir: prep.dedupe(
        table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey", "o_orderstatus", "o_orderpriority"), ["o_custkey", "o_orderstatus"], "o_orderkey"))
query("p_dedupe_nulls", f"WITH {CUST_SQL} SELECT c_custkey, coalesce(c_nationkey, -1)::INT AS c_nationkey, coalesce(c_mktsegment, 'none') AS c_mktsegment FROM t QUALIFY row_number() OVER (PARTITION BY c_nationkey, c_mktsegment ORDER BY c_custkey) = 1")(
    lambda spark, sf_dir: shown(prep.dedupe(customers(spark, sf_dir).drop("c_acctbal"), ["c_nationkey", "c_mktsegment"], "c_custkey")))
query("p_keep_mostly_present", f"WITH {CUST_SQL} SELECT {SHOWN_CUST} FROM t WHERE ((c_nationkey IS NULL)::INT + (c_acctbal IS NULL)::INT + (c_mktsegment IS NULL)::INT) / 3 < 0.35")(
    lambda spark, sf_dir: shown(prep.keep_mostly_present(customers(spark, sf_dir), CUST, 0.35)))
query("p_drop_missing", f"WITH {CUST_SQL} SELECT * FROM t WHERE c_nationkey IS NOT NULL AND c_acctbal IS NOT NULL AND c_mktsegment IS NOT NULL")(
    lambda spark, sf_dir: prep.drop_missing(customers(spark, sf_dir), CUST))
query("p_drop_column", "SELECT c_custkey, c_name, c_nationkey, c_acctbal FROM customer")(
    lambda spark, sf_dir: table(spark, sf_dir, "customer").drop("c_mktsegment"))
query("p_binarise_members", "SELECT c_custkey, (c_nationkey IN (1, 2, 3))::INT AS c_nationkey FROM customer")(
    lambda spark, sf_dir: prep.binarise_members(table(spark, sf_dir, "customer").select("c_custkey", "c_nationkey"), "c_nationkey", [1, 2, 3]))
query("p_binarise_map", "SELECT event_id, CASE event_type WHEN 'error' THEN 1 WHEN 'click' THEN 0 ELSE -1 END::INT AS event_type FROM events")(
    lambda spark, sf_dir: shown(prep.binarise_map(table(spark, sf_dir, "events").select("event_id", "event_type"), "event_type", {"error": 1, "click": 0})))

# ---- imputation ----------------------------------------------------------

IMPUTE_SQL = f"""WITH {CUST_SQL}, f AS (SELECT quantile_cont(c_nationkey::DOUBLE, 0.5) AS a, quantile_cont(c_acctbal, 0.5) AS b,
  (SELECT c_mktsegment FROM t WHERE c_mktsegment IS NOT NULL GROUP BY 1 ORDER BY count(*) DESC, 1 LIMIT 1) AS m FROM t)
SELECT c_custkey, round(coalesce(c_nationkey, a), 6) AS c_nationkey, round(coalesce(c_acctbal, b), 6) AS c_acctbal, coalesce(c_mktsegment, m) AS c_mktsegment FROM t CROSS JOIN f"""


@query("p_impute_median_mode", IMPUTE_SQL)
def p_impute(spark, sf_dir):
    df = customers(spark, sf_dir)
    return rounded(prep.fit_impute(df, ["c_nationkey", "c_acctbal"], ["c_mktsegment"]).transform(df), "c_nationkey", "c_acctbal")


def knn_sql(source: str, id: str, a: str, b: str, k: str, value: str) -> str:
    """Nearest-neighbour imputation of two columns by brute force."""
    dist = """round(sqrt(2 / nullif((q.a IS NOT NULL AND r.a IS NOT NULL)::INT + (q.b IS NOT NULL AND r.b IS NOT NULL)::INT, 0)
    * (coalesce((q.a - r.a) * (q.a - r.a), 0) + coalesce((q.b - r.b) * (q.b - r.b), 0))), 9)"""
    return f"""WITH {source}, s AS (SELECT {id} AS id, {a}::DOUBLE AS a, {b}::DOUBLE AS b FROM t), n AS (SELECT {k} AS k FROM s),
pairs AS (SELECT q.id, c.c, CASE c.c WHEN 'a' THEN r.a ELSE r.b END AS v, r.id AS nid, {dist} AS d
  FROM s q JOIN (VALUES ('a'), ('b')) c(c) ON (c.c = 'a' AND q.a IS NULL) OR (c.c = 'b' AND q.b IS NULL)
  JOIN s r ON r.id <> q.id AND CASE c.c WHEN 'a' THEN r.a ELSE r.b END IS NOT NULL),
best AS (SELECT * FROM pairs WHERE d IS NOT NULL QUALIFY row_number() OVER (PARTITION BY id, c ORDER BY d, nid) <= (SELECT k FROM n)),
fill AS (SELECT id, c, {value} AS v FROM best GROUP BY id, c)
SELECT s.id AS {id}, round(coalesce(a, fa.v, (SELECT avg(a) FROM s)), 6) AS {a}, round(coalesce(b, fb.v, (SELECT avg(b) FROM s)), 6) AS {b}
FROM s LEFT JOIN fill fa ON fa.id = s.id AND fa.c = 'a' LEFT JOIN fill fb ON fb.id = s.id AND fb.c = 'b'"""


@query("p_knn_impute_uniform", knn_sql(PART_SQL, "p_partkey", "p_size", "p_retailprice", "least(5, count(*) // 10)", "avg(v)"))
def p_knn_uniform(spark, sf_dir):
    df = parts(spark, sf_dir).drop("p_brand")
    return rounded(prep.knn_impute(df, "p_partkey", ["p_size", "p_retailprice"]), "p_size", "p_retailprice")


WEIGHTED = """CASE WHEN min(d) = 0 THEN avg(v) FILTER (d = 0) ELSE sum(v / nullif(d, 0)) / sum(1 / nullif(d, 0)) END"""


@query("p_knn_impute_distance", knn_sql(CUST_SQL, "c_custkey", "c_nationkey", "c_acctbal", "any_value(5)", WEIGHTED))
def p_knn_distance(spark, sf_dir):
    df = customers(spark, sf_dir).drop("c_mktsegment")
    return rounded(prep.knn_impute(df, "c_custkey", ["c_nationkey", "c_acctbal"], 5, "distance"), "c_nationkey", "c_acctbal")


# ---- outliers ------------------------------------------------------------

IQR_SQL = """WITH q AS (SELECT quantile_cont(value, 0.25) AS q1, quantile_cont(value, 0.75) AS q3 FROM events)
SELECT event_id, round(value, 6) AS value FROM events CROSS JOIN q WHERE value >= q1 - 1.5::DOUBLE * (q3 - q1) AND value <= q3 + 1.5::DOUBLE * (q3 - q1)"""
query("p_outliers_iqr", IQR_SQL)(
    lambda spark, sf_dir: rounded(prep.drop_outliers(table(spark, sf_dir, "events").select("event_id", "value"), ["value"], "iqr"), "value"))
query("p_outliers_zscore", """SELECT event_id, round(value, 6) AS value FROM events CROSS JOIN (SELECT avg(value) AS m, stddev_pop(value) AS s FROM events)
  WHERE abs((value - m) / s) < 3""")(
    lambda spark, sf_dir: rounded(prep.drop_outliers(table(spark, sf_dir, "events").select("event_id", "value").withColumn("flat", F.lit(1.0)),
                                                     ["value", "flat"], "zscore").drop("flat"), "value"))
query("p_outliers_none", "SELECT event_id, round(value, 6) AS value FROM events")(
    lambda spark, sf_dir: rounded(prep.drop_outliers(table(spark, sf_dir, "events").select("event_id", "value"), ["value"], "none"), "value"))

# ---- encoders ------------------------------------------------------------


@query("p_label_encode", """WITH lv AS (SELECT c_mktsegment AS v, dense_rank() OVER (ORDER BY c_mktsegment) - 1 AS code FROM (SELECT DISTINCT c_mktsegment FROM customer)),
  nm AS (SELECT c_name AS v, dense_rank() OVER (ORDER BY c_name) - 1 AS code FROM (SELECT DISTINCT c_name FROM customer))
  SELECT c_custkey, nm.code AS c_name, lv.code AS c_mktsegment FROM customer JOIN lv ON lv.v = c_mktsegment JOIN nm ON nm.v = c_name""")
def p_label_encode(spark, sf_dir):
    df = table(spark, sf_dir, "customer").select("c_custkey", "c_name", "c_mktsegment")
    return prep.fit_encode(df, ["c_name", "c_mktsegment"], "label").transform(df)


@query("p_label_encode_unseen", """WITH lv AS (SELECT v, dense_rank() OVER (ORDER BY v) - 1 AS code FROM (SELECT DISTINCT event_type AS v FROM events WHERE event_type <> 'error'))
  SELECT event_id, coalesce(code, 0) AS event_type FROM events LEFT JOIN lv ON v = event_type""")
def p_label_unseen(spark, sf_dir):
    """Levels fitted on events other than errors; errors are then unseen."""
    df = table(spark, sf_dir, "events").select("event_id", "event_type")
    return prep.fit_encode(df.filter("event_type <> 'error'"), ["event_type"], "label").transform(df)


EVENT_TYPES = ["click", "purchase", "signup", "view"]


@query("p_onehot", "SELECT event_id, " + ", ".join(f"(event_type = '{t}')::INT AS {t}" for t in EVENT_TYPES) + " FROM events")
def p_onehot(spark, sf_dir):
    """Unknown levels (errors) become all zeros; columns renamed to the bare level for the comparison."""
    df = table(spark, sf_dir, "events").select("event_id", "event_type")
    out = prep.fit_encode(df.filter("event_type <> 'error'"), ["event_type"], "onehot").transform(df)
    return out.select("event_id", *[F.col(f"`{c}`").alias(c.removeprefix("event_type_")) for c in out.columns if c != "event_id"])


SEGMENTS = ["AUTOMOBILE", "BUILDING", "FURNITURE", "HOUSEHOLD", "MACHINERY"]
query("p_dummies", "SELECT c_custkey, " + ", ".join(f"(c_mktsegment = '{s}')::INT AS c_mktsegment_{s}" for s in SEGMENTS) + " FROM customer")(
    lambda spark, sf_dir: prep.dummies(table(spark, sf_dir, "customer").select("c_custkey", "c_mktsegment"), ["c_mktsegment"]))

# ---- scalers -------------------------------------------------------------


def lines(spark, sf_dir):
    return table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", *LINE).withColumn("flat", F.lit(7.0))


STD_SQL = "SELECT l_orderkey, l_linenumber, " + ", ".join(
    f"round(({c} - (SELECT avg({c}) FROM lineitem)) / (SELECT stddev_pop({c}) FROM lineitem), 6) + 0.0::DOUBLE AS {c}" for c in LINE) + ", 0.0::DOUBLE AS flat FROM lineitem"
MM_SQL = "SELECT l_orderkey, l_linenumber, " + ", ".join(
    f"round(({c} - (SELECT min({c}) FROM lineitem)) / (SELECT max({c}) - min({c}) FROM lineitem), 6) AS {c}" for c in LINE) + ", 0.0::DOUBLE AS flat FROM lineitem"
query("p_standard_scale", STD_SQL)(
    lambda spark, sf_dir: rounded(prep.fit_scale(lines(spark, sf_dir), [*LINE, "flat"], "standard").transform(lines(spark, sf_dir)), *LINE, "flat"))
query("p_minmax_scale", MM_SQL)(
    lambda spark, sf_dir: rounded(prep.fit_scale(lines(spark, sf_dir), [*LINE, "flat"], "minmax").transform(lines(spark, sf_dir)), *LINE, "flat"))
query("p_scale_none", "SELECT l_orderkey, l_linenumber, " + ", ".join(f"round({c}, 6) AS {c}" for c in LINE) + ", 7.0::DOUBLE AS flat FROM lineitem")(
    lambda spark, sf_dir: rounded(prep.fit_scale(lines(spark, sf_dir), LINE, "none").transform(lines(spark, sf_dir)), *LINE, "flat"))
query("p_selective_scale", "SELECT l_orderkey, l_linenumber, round(l_quantity, 6) AS l_quantity, " + ", ".join(
    f"round(({c} - (SELECT min({c}) FROM lineitem)) / (SELECT max({c}) - min({c}) FROM lineitem), 6) AS {c}" for c in LINE[1:]) + " FROM lineitem")(
    lambda spark, sf_dir: rounded(prep.selective_scale(lines(spark, sf_dir).drop("flat"), LINE, ["l_quantity"], "minmax"), *LINE))

# ---- pipelines -----------------------------------------------------------

TRAIN = u("train", "c_custkey") + " < 0.8"
FIT_SQL = f"""WITH {CUST_SQL}, tr AS (SELECT * FROM t WHERE {TRAIN}),
f AS (SELECT quantile_cont(c_nationkey::DOUBLE, 0.5) AS a, quantile_cont(c_acctbal, 0.5) AS b,
  (SELECT c_mktsegment FROM tr WHERE c_mktsegment IS NOT NULL GROUP BY 1 ORDER BY count(*) DESC, 1 LIMIT 1) AS m FROM tr),
filled AS (SELECT c_custkey, coalesce(c_nationkey, a) AS x, coalesce(c_acctbal, b) AS y, coalesce(c_mktsegment, m) AS s FROM t CROSS JOIN f),
ft AS (SELECT * FROM filled WHERE {TRAIN}),
q AS (SELECT quantile_cont(x, [0.25, 0.75]) AS qx, quantile_cont(y, [0.25, 0.75]) AS qy FROM ft),
kept AS (SELECT * FROM ft CROSS JOIN q WHERE x BETWEEN qx[1] - 1.5::DOUBLE * (qx[2] - qx[1]) AND qx[2] + 1.5::DOUBLE * (qx[2] - qx[1])
  AND y BETWEEN qy[1] - 1.5::DOUBLE * (qy[2] - qy[1]) AND qy[2] + 1.5::DOUBLE * (qy[2] - qy[1])),
lv AS (SELECT s, dense_rank() OVER (ORDER BY s) - 1 AS code FROM (SELECT DISTINCT s FROM kept)),
st AS (SELECT avg(x) AS mx, stddev_pop(x) AS sx, avg(y) AS my, stddev_pop(y) AS sy FROM kept)
SELECT c_custkey, round((x - mx) / sx, 6) + 0.0::DOUBLE AS c_nationkey, round((y - my) / sy, 6) + 0.0::DOUBLE AS c_acctbal, coalesce(code, 0) AS c_mktsegment
FROM filled CROSS JOIN st LEFT JOIN lv ON lv.s = filled.s"""


@query("p_fit_transform", FIT_SQL)
def p_fit_transform(spark, sf_dir):
    """Fit on four fifths of the customers, transform all of them."""
    df = customers(spark, sf_dir)
    model = prep.Prep(["c_nationkey", "c_acctbal"], ["c_mktsegment"], "simple", "iqr", "label", "standard", "c_custkey").fit(
        df.filter(uniform(42, "train", "c_custkey") < 0.8))
    return rounded(model.transform(df), "c_nationkey", "c_acctbal")


RECIPE_SQL = f"""WITH {PART_SQL}, b AS (SELECT p_partkey, p_size, p_retailprice, (p_brand IN ('Brand#1', 'Brand#2', 'Brand#3'))::INT AS p_brand FROM t),
dd AS (SELECT * FROM b QUALIFY row_number() OVER (PARTITION BY p_size, p_retailprice ORDER BY p_partkey) = 1),
k AS (SELECT * FROM dd WHERE ((p_size IS NULL)::INT + (p_retailprice IS NULL)::INT) / 2 < 0.6),
f AS (SELECT quantile_cont(p_size::DOUBLE, 0.5) AS a, quantile_cont(p_retailprice, 0.5) AS c FROM k),
fl AS (SELECT p_partkey, coalesce(p_size, a)::DOUBLE AS x, coalesce(p_retailprice, c) AS y, p_brand FROM k CROSS JOIN f),
w AS (SELECT *, avg(y) OVER () AS m, stddev_pop(y) OVER () AS s FROM fl),
z AS (SELECT * FROM w WHERE abs((y - m) / s) < 3)
SELECT p_partkey, round((x - min(x) OVER ()) / (max(x) OVER () - min(x) OVER ()), 6) AS p_size,
  round((y - min(y) OVER ()) / (max(y) OVER () - min(y) OVER ()), 6) AS p_retailprice, coalesce(p_brand, -1) AS p_brand FROM z"""


@query("p_recipe", RECIPE_SQL)
def p_recipe(spark, sf_dir):
    recipe = Recipe("p_brand", positive=["Brand#1", "Brand#2", "Brand#3"], max_missing=0.6, impute="simple", outliers="zscore", scaling="minmax")
    return shown(rounded(prepare(parts(spark, sf_dir), recipe, "p_partkey"), "p_size", "p_retailprice"))


@query("p_clean_lineitem", f"""WITH i AS (SELECT {LINE_ID} AS row_id, l_quantity, l_extendedprice, l_discount, l_tax, l_returnflag FROM lineitem),
dd AS (SELECT * FROM i QUALIFY row_number() OVER (PARTITION BY {', '.join(LINE)} ORDER BY row_id) = 1),
st AS (SELECT {', '.join(f'avg({c}) AS m_{c}, stddev_pop({c}) AS s_{c}' for c in LINE)} FROM dd),
k AS (SELECT dd.* FROM dd CROSS JOIN st WHERE {' AND '.join(f'abs(({c} - m_{c}) / s_{c}) < 3' for c in LINE)}),
mm AS (SELECT {', '.join(f'min({c}) AS a_{c}, max({c}) AS b_{c}' for c in LINE)} FROM k)
SELECT row_id, l_returnflag, {', '.join(f'round(({c} - a_{c}) / (b_{c} - a_{c}), 6) AS {c}' for c in LINE)} FROM k CROSS JOIN mm""")
def p_clean_lineitem(spark, sf_dir):
    """Dedupe on four numeric columns, z-score filter, min-max scaling."""
    df = table(spark, sf_dir, "lineitem").select(line_id().alias("row_id"), *LINE, "l_returnflag")
    df = settle(prep.dedupe(df, LINE, "row_id"))
    kept = prep.drop_outliers(df, LINE, "zscore")
    return rounded(prep.fit_scale(kept, LINE, "minmax").transform(kept), *LINE)
