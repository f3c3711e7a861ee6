"""Registered queries: contract of the entry module and SQL agreement on the smallest data."""

import os
from collections import Counter

import duckdb
import pytest

import __spark_entry__ as entry
from check_queries import TABLES, normal

FOLDER = "/root/testdata/sf0.001"
SAMPLE = [
    "dose_from_fluence", "structure_dose_summary", "dvh", "low_dose_voxels", "bev_mask", "bev_compact_grid", "sparsify_rmr", "structure_expression",
    "connected_regions", "cohort_filter", "beam_dedup", "criteria_report", "score_metric", "objective_gradient", "voxel_map_build",
    "body_entry", "ray_march", "openness_to_leaf", "training_features", "predicted_matrix", "metadata_scan", "fluence_export",
]
NAMES = list(entry.queries()) if os.environ.get("ALL_QUERIES") else SAMPLE


def test_every_oracle_has_a_query():
    assert set(entry.oracle_sql()) <= set(entry.queries())
    assert len(entry.queries()) > 150


@pytest.fixture(scope="module")
def sql():
    con = duckdb.connect()
    for name in TABLES:
        con.execute(f"create view {name} as select * from '{FOLDER}/{name}.parquet'")
    return con


@pytest.mark.parametrize("name", NAMES)
def test_query_equals_sql(spark, sql, name):
    df = entry.queries()[name](spark, FOLDER)
    columns = sorted(df.columns)
    got = Counter(tuple(normal(v) for v in r) for r in df.select(*columns).collect())
    text = entry.oracle_sql().get(name)
    if text is None:
        assert got
        return
    cursor = sql.execute(text)
    names = [d[0] for d in cursor.description]
    assert sorted(names) == columns
    order = [names.index(c) for c in columns]
    assert got == Counter(tuple(normal(r[i]) for i in order) for r in cursor.fetchall())


def test_flagship_runs(spark):
    assert entry.entry(spark).count() > 0


@pytest.mark.parametrize("name", [
    "dose_to_grid", "grid_to_dose", "training_features", "training_features_resized", "feature_channels", "augment_affine", "augment_seeded", "fluence_export",
])
def test_plan_wide_query_has_every_plan(spark, sql, name):
    """Rows of all plans, each plan's as the SQL has them, and those of plan A as the query of one plan."""
    wide = entry.queries()[f"{name}_plans"](spark, FOLDER).toPandas()
    assert set(wide["plan_id"]) == {"A", "B"}
    one = entry.queries()[name](spark, FOLDER).toPandas()
    columns = sorted(one.columns)
    assert Counter(map(tuple, wide[wide["plan_id"] == "A"][columns].values.tolist())) == Counter(map(tuple, one[columns].values.tolist()))
    test_query_equals_sql(spark, sql, f"{name}_plans")
