"""Every registered query against its SQL on the given tables, and whatever the rows' order and partitions."""

import datetime
import decimal
import glob
import math
import os
from collections import Counter

import duckdb
import pytest

import __spark_entry__
from tallowmere import catalog


def cell(v):
    if isinstance(v, bool):
        return int(v)
    if isinstance(v, decimal.Decimal):
        v = float(v)
    if isinstance(v, float):
        return "nan" if math.isnan(v) else float(f"{v:.9g}") + 0.0
    if isinstance(v, (list, tuple)):
        return tuple(map(cell, v))
    if isinstance(v, (datetime.date, datetime.datetime)):
        return str(v)
    return v


@pytest.fixture(scope="module")
def duck(small):
    con = duckdb.connect()
    con.execute("SET TimeZone='UTC'")
    for f in glob.glob(f"{small}/*.parquet"):
        con.execute(f"CREATE VIEW {os.path.basename(f)[:-8]} AS SELECT * FROM read_parquet('{f}')")
    return con


@pytest.mark.parametrize("name", sorted(catalog.QUERIES))
def test_query_equals_its_sql(spark, small, duck, name):
    df = catalog.QUERIES[name](spark, small)
    names = sorted(df.columns)
    got = Counter(tuple(map(cell, r)) for r in df.select(*names).collect())
    if name not in catalog.ORACLE_SQL:
        return
    r = duck.execute(catalog.ORACLE_SQL[name])
    own = [d[0] for d in r.description]
    assert sorted(own) == names
    place = [own.index(n) for n in names]
    assert got == Counter(tuple(cell(x[i]) for i in place) for x in r.fetchall())


def test_all_but_a_few_queries_have_sql():
    assert set(catalog.QUERIES) - set(catalog.ORACLE_SQL) == {"signed_rank_tests", "rm_anova_pvalues", "model_scores", "permutation_attribution", "coverage_subset", "sensitivity_summary", "boosted_attribution", "validator_sensitivity"}


def test_entry_gives_rows(spark):
    assert __spark_entry__.entry(spark).count() > 0
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())


@pytest.mark.parametrize("name", ["entity_history_profile", "panel_target_12m", "adaptive_coverage", "rank_kinds", "grouping_set_summary", "hash_bootstrap_ci"])
def test_partitions_change_nothing(spark, small, tmp_path, name):
    """The same rows in seven files, dealt at random, give the same result."""
    for f in glob.glob(f"{small}/*.parquet"):
        spark.read.parquet(f).repartition(7).write.parquet(f"{tmp_path}/{os.path.basename(f)}")
    one, other = (Counter(tuple(map(cell, r)) for r in catalog.QUERIES[name](spark, d).collect()) for d in (small, str(tmp_path)))
    assert one == other


def test_attributions_add_up(spark, small):
    rows = catalog.QUERIES["permutation_attribution"](spark, small).collect()
    by: dict[int, list] = {}
    for r in rows:
        by.setdefault(r.s_suppkey, []).append(r)
    for rs in by.values():
        assert sum(r.shap_value for r in rs) == pytest.approx(rs[0].model_output - rs[0].base_value, abs=1e-9)


def test_model_scores_every_row(spark, small):
    rows = catalog.QUERIES["model_scores"](spark, small).collect()
    assert len(rows) == spark.read.parquet(f"{small}/lineitem.parquet").count()
    assert {r.split for r in rows} == {"train", "valid", "test"} and all(0 <= r.score <= 1 for r in rows)
