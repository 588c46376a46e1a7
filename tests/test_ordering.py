"""Block-wise order work equals plain windows, also when one key holds most rows and keys tie."""

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from frameweave.functions import vectors as V
from frameweave.operators import corpus, joining, memory, scoring, sequencing
from frameweave.plans.ordering import order_rows, top_rows
from frameweave.plans.staging import fits

SMALL = 40  # rows per block, far below the hot key


@pytest.fixture(scope="module")
def data():
    rng = np.random.default_rng(7)
    n = 900
    return pd.DataFrame(
        {
            "k": np.where(rng.random(n) < 0.6, 0, rng.integers(1, 6, n)),
            "ts": rng.integers(0, 50, n),  # many ties
            "id": rng.permutation(n),
            "v": rng.normal(size=n).round(3),
        }
    )


@pytest.fixture(scope="module")
def df(spark, data):
    return spark.createDataFrame(data).repartition(5)


def rows(df, *cols):
    return sorted(map(tuple, df.select(*cols).collect()), key=repr)


@pytest.mark.parametrize("keys", [["k"], []])
def test_numbers(df, data, keys):
    ordered = order_rows(df, keys, ["ts", "id"], size="n", group_rows=SMALL)
    assert ordered.blocked
    got = {r.id: (r.seq, r.n) for r in ordered.df.collect()}
    part = data.sort_values(["ts", "id"])
    seq = part.groupby("k").cumcount() if keys else pd.Series(range(len(part)), index=part.index)
    size = part.groupby("k")["id"].transform("size") if keys else pd.Series(len(part), index=part.index)
    assert got == {i: (s, n) for i, s, n in zip(part["id"], seq, size)}


def test_null_key_is_a_group(spark):
    df = spark.createDataFrame([(None, i) for i in range(90)] + [("a", i) for i in range(10)], "k string, i int")
    out = order_rows(df, ["k"], ["i"], group_rows=20).df
    assert rows(out, "k", "i", "seq") == rows(out, "k", "i", "i")


@pytest.mark.parametrize("offset", [1, 3, -2, 57, -57])
def test_shift(df, offset):
    small = order_rows(df, ["k"], ["ts", "id"], group_rows=SMALL).shift(offset, p="v").df
    plain = order_rows(df, ["k"], ["ts", "id"]).shift(offset, p="v").df
    assert rows(small, "id", "p") == rows(plain, "id", "p")


@pytest.mark.parametrize("inclusive", [True, False])
def test_running(df, inclusive):
    one = {"s": F.col("id").cast("long")}
    small = order_rows(df, ["k"], ["ts", "id"], group_rows=SMALL).running(inclusive, **one).df
    plain = order_rows(df, ["k"], ["ts", "id"]).running(inclusive, **one).df
    assert rows(small, "id", "s") == rows(plain, "id", "s")


def test_next_known(df):
    mark = F.when(F.col("id") % 97 == 0, F.col("id"))  # gaps longer than a block
    small = order_rows(df, ["k"], ["ts", "id"], group_rows=SMALL).next_known(q=mark).df
    plain = order_rows(df, ["k"], ["ts", "id"]).next_known(q=mark).df
    assert rows(small, "id", "q") == rows(plain, "id", "q")


def test_pages_are_whole(df, data):
    pages = order_rows(df, ["k"], ["ts", "id"], group_rows=SMALL).pages(16, ids=F.col("id")).collect()
    assert max(len(p.ids) for p in pages) == 16
    joined = {}
    for p in sorted(pages, key=lambda p: p.page):
        joined.setdefault(p.k, []).extend(p.ids)
    want = data.sort_values(["ts", "id"]).groupby("k")["id"].apply(list).to_dict()
    assert joined == want


@pytest.mark.parametrize("k", [3, 1500])
def test_top_rows(df, data, k):
    got = rows(top_rows(df, ["k"], [F.col("v").desc(), "id"], k), "id")
    want = data.sort_values(["v", "id"], ascending=[False, True]).groupby("k").head(k)
    assert got == sorted([(i,) for i in want["id"]], key=repr)


@pytest.mark.parametrize(
    "job",
    [
        lambda d, **o: memory.change_gate(d.withColumn("x", F.array("v")), ["k"], ["ts", "id"], "x", 0.8, **o),
        lambda d, **o: memory.short_memory(d, ["k"], ["ts", "id"], "id", **o),
        lambda d, **o: sequencing.sample_rows(d, ["k"], ["ts", "id"], "spread", 33, **o),
        lambda d, **o: sequencing.sample_rows(d, ["k"], ["ts", "id"], "linspace", 33, **o),
        lambda d, **o: sequencing.chunk_rows(d, ["k"], ["ts", "id"], 7, **o),
        lambda d, **o: sequencing.event_cuts(
            d, ["k"], ["ts", "id"], F.abs(F.col("v") - F.col("_p")), {"_p": "v"}, **o
        ),
        lambda d, **o: joining.assign_segments(
            d.where("id % 9 <> 0").select("k", "ts", "id"),
            d.where("id % 9 = 0").select("k", "ts", F.col("id").alias("q")),
            "k",
            ["id"],
            "ts",
            "q",
            **o,
        ),
    ],
)
def test_operators_agree_on_both_paths(df, job):
    small, plain = job(df, group_rows=SMALL), job(df)
    cols = sorted(set(plain.columns))
    assert rows(small, *cols) == rows(plain, *cols)


def test_close_operators_agree_on_both_paths(df):
    def advantage(**o):
        d = df.withColumn("b", F.floor(F.col("ts") / 10))
        out = sequencing.prompt_advantage(d, "k", "b", ["ts", "id"], "v", 25, 10, **o)
        return rows(out.withColumn("a", F.round("advantage", 8)), "id", "a")

    assert advantage(group_rows=SMALL) == advantage()

    def step(**o):
        return sequencing.mean_step(df, [], ["ts", "id"], "v", **o).first()[0]

    assert step(group_rows=SMALL) == pytest.approx(step())

    def paired(**o):
        return rows(
            scoring.paired_accuracy(df, "k", ["ts", "id"], F.col("v") > 0, F.col("v") > 1, **o), "k", "acc_plus"
        )

    assert paired(group_rows=SMALL) == paired()


def test_token_blocks_on_both_paths(spark):
    rng = np.random.default_rng(1)
    docs = [(i, [f"{i}.{j}" for j in range(rng.integers(0, 60))]) for i in range(80)]
    df = spark.createDataFrame(docs, "id int, t array<string>")
    flat = [x for _, t in docs for x in [*t, "."]]
    want = {b: flat[b * 50 : b * 50 + 50] for b in range(len(flat) // 50)}
    for size in (16, 10**6):
        out = corpus.token_blocks(df, ["id"], "t", 50, F.lit("."), group_rows=size)
        assert {r.block: r.tokens for r in out.collect()} == want


def test_size_check_counts_rows_and_bytes(spark):
    df = spark.range(100).withColumn("v", F.array_repeat(F.lit(1.0), 1000))
    assert fits(df, 100) and not fits(df, 99) and not fits(df, 100, max_bytes=100_000)


def test_distance_functions(spark):
    row = spark.range(1).select(
        F.array(F.lit(3.0), F.lit(4.0)).alias("a"),
        F.array(F.lit(0.0), F.lit(0.0)).alias("z"),
        F.array(F.lit(6.0), F.lit(8.0)).alias("b"),
    )
    got = row.select(
        V.dot("a", "b"), V.norm("a"), V.euclidean("a", "b"), V.lp(1)("a", "b"), V.lp(3)("a", "b"),
        V.cosine("a", "b"), V.cosine("a", "z"), V.ssim("a", "a"), V.unit("z"), V.minmax("a"), V.minmax("z"),
    ).first()
    assert got[0] == 50 and got[1] == 5 and got[2] == 5 and got[3] == 7
    assert got[4] == pytest.approx((27 + 64) ** (1 / 3))
    assert got[5] == pytest.approx(1) and got[6] == 0 and got[7] == pytest.approx(1)
    assert got[8] == [0, 0] and got[9] == [0, 1] and got[10] == [0, 0]


def test_staging_folder_comes_from_the_session():
    from types import SimpleNamespace as NS

    from frameweave.plans.staging import staging_root

    def session(folder, master):
        context = NS(master=master, applicationId=f"{master}-app")
        return NS(conf=NS(get=lambda key, default: folder), sparkContext=context)

    assert staging_root(session("hdfs://shared/ck/", "yarn")) == "hdfs://shared/ck"
    with pytest.raises(ValueError):
        staging_root(session(None, "yarn"))
    assert "frameweave-stage-" in staging_root(session(None, "local[2]"))


def test_wide_rows_lower_the_window_bound(spark):
    from frameweave.plans import ordering

    narrow = spark.range(100).withColumn("k", F.col("id") % 2)
    # Only the last rows are wide: all rows are measured, not the first ones.
    wide = narrow.withColumn("v", F.array_repeat(F.lit(1.0), F.when(F.col("id") < 90, 0).otherwise(4096)))
    assert ordering.group_extent(narrow, ["k"]) == (50, 0)
    rows, size = ordering.group_extent(wide, ["k"])
    assert rows == 50 and size == 5 * 4096 * 8
    assert ordering.rows_per_task(1_000_000, rows, size) == 1_000_000
    assert ordering.rows_per_task(1_000_000, 10_000_000, 4 << 40) < 2_000
