"""The stored index against exact search: pruning, appending, recall."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from frameweave.operators import retrieval as R
from frameweave.operators.vector_index import VectorIndex

SCHEMA = "id long, x array<double>"


def rows_of(n, seed, first=0, dim=8):
    rng = np.random.default_rng(seed)
    middles = np.random.default_rng(0).normal(size=(25, dim)) * 4
    return [(first + i, (middles[rng.integers(25)] + rng.normal(size=dim)).tolist()) for i in range(n)]


def pairs(df):
    return {(r.query_id, r["rank"]): (r.row_id, round(r.score, 9)) for r in df.collect()}


@pytest.mark.parametrize("metric", ["l2", "cosine"])
def test_exact_and_pruned_search(spark, tmp_path, metric):
    rows = rows_of(2000, 1) + [(5000 + i, rows_of(1, 1)[0][1]) for i in range(300)] + [(9000, None)]  # many copies of one
    table = spark.createDataFrame(rows, SCHEMA)
    index = VectorIndex(spark, str(tmp_path / "ix"), metric, block=100)
    index.create(table.where("id % 3 > 0"), "id", "x", cells=30).append(table.where("id % 3 = 0"), "id", "x")
    asked = table.where("id % 20 = 0")
    known = table.where("x is not null")
    want = pairs(R.nearest(asked.where("x is not null"), known, 5, metric, "id", "id", "x", skip_self=True))
    assert pairs(index.search(asked, 5, "id", "x", probes=2, skip_self=True)) == want
    got = pairs(index.search(asked, 5, "id", "x", probes=3, exact=False, skip_self=True))
    assert sum(got.get(key) == hit for key, hit in want.items()) / len(want) >= 0.9


def test_only_visited_cells_are_read(spark, tmp_path):
    table = spark.createDataFrame(rows_of(1000, 2), SCHEMA)
    index = VectorIndex(spark, str(tmp_path / "ix")).create(table, "id", "x", cells=20)
    cells = sorted(r.cell for r in index.rows().select("cell").distinct().collect())
    assert len(cells) > 10 and index.rows().count() == 1000
    some = index.rows(cells[:2])
    plan = some._jdf.queryExecution().toString()
    assert "PartitionFilters: [cell" in plan or "PartitionFilters: [isnotnull(cell" in plan
    assert {f.split("cell=")[1].split("/")[0] for f in some.select("row_id").inputFiles()} >= {str(c) for c in cells[:2]}
    files = [r.f for r in some.select(F.input_file_name().alias("f")).distinct().collect()]
    assert {int(f.split("cell=")[1].split("/")[0]) for f in files} == set(cells[:2])


def test_empty_index_and_queries(spark, tmp_path):
    table = spark.createDataFrame(rows_of(30, 3), SCHEMA)
    index = VectorIndex(spark, str(tmp_path / "a")).create(table, "id", "x", cells=4)
    assert index.search(table.limit(0), 3, "id", "x").count() == 0
    assert index.search(table, 100, "id", "x").count() == 900  # fewer rows than asked for
    with pytest.raises(ValueError):
        VectorIndex(spark, "x", "l1")
