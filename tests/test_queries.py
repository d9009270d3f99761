"""SQL twins at the smallest scale: a part by default, all with EVENKEEL_ALL=1."""

import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

import __spark_entry__ as entry  # noqa: E402
from check_queries import connect, difference  # noqa: E402

SF_DIR = "/root/testdata/sf0.001"
PART = [
    "o_smote", "o_adasyn", "o_ccr_wide", "o_akmeans_smote", "p_fit_transform", "p_knn_impute_distance", "e_expand_folds",
    "m_all_metrics", "r_comparison", "k_within_class_knn", "d_publish", "x_final_evaluation"]
QUERIES, ORACLES = entry.queries(), entry.oracle_sql()


@pytest.mark.parametrize("name", sorted(ORACLES) if os.environ.get("EVENKEEL_ALL") else PART)
def test_query_matches_sql(spark, name):
    got = QUERIES[name](spark, SF_DIR).toPandas()
    assert difference(got, connect(SF_DIR).execute(ORACLES[name]).df()) is None


def test_every_twin_has_a_query():
    assert set(ORACLES) <= set(QUERIES) and len(QUERIES) > 100


def test_entry(spark):
    assert entry.entry(spark).count() > 0


def test_search_of_k_is_not_narrowed(spark, monkeypatch, tmp_path):
    """The query leaves the limit on clusters and the restarts at their defaults."""
    from evenkeel.methods import registry, smote
    from evenkeel.queries import load

    seen = []
    monkeypatch.setitem(registry.METHODS, "AKMeans_SMOTE", lambda job: seen.append(job.options) or smote.original(job))
    rows = spark.createDataFrame([(i, int(i > 3), [float(i), 1.0]) for i in range(12)], "vec_id long, label int, embedding array<float>")
    rows.write.parquet(str(tmp_path / "embeddings.parquet"))
    load().QUERIES["x_search_k"](spark, str(tmp_path))
    assert seen == [{"search_k": True}]
