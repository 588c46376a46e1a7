"""Registered queries on rows that the given tables lack."""

from types import SimpleNamespace

from pyspark.sql import functions as F

from frameweave.operators import joining as J
from frameweave.suite import joins


def test_review_display_of_long_conversations(spark):
    turns = [(1, 0, "user", "a"), (1, 1, "assistant", "bb"), (1, 2000, "user", "ccc"), (1, 2001, "assistant", "dddd")]
    turns += [(2, 0, "user", "eeeee"), (2, 1, "assistant", "ffffff")]
    t = SimpleNamespace(
        conversations=spark.createDataFrame(turns, "conv_id long, turn long, role string, text string"),
        benchmark=spark.createDataFrame([(1, "8\nfine"), (2, "9\ngood")], "item_id long, text string"),
    )
    got = sorted((r.qid, r.turn, r.question_chars, r.answer_chars) for r in joins.review_display(t).collect())
    assert got == [(1000, 0, 1, 2), (2000, 0, 5, 6), (2000, 2000, 3, 4)]


def test_compared_items_shuffle_no_items(spark):
    rows = spark.createDataFrame(
        [(1, ["a", "b", "a"], ["b", "c", "c"]), (2, [], ["x"]), (3, ["y"], None), (4, None, None)], "id long, a array<string>, b array<string>"
    ).repartition(3, "id")
    out = J.compared_items(rows, "id", F.col("a"), F.col("b"))
    got = {r.id: (r.n_a, r.n_b, r.missed, r.invented) for r in out.collect()}
    assert got == {1: (3, 3, 2, 2), 2: (0, 1, 1, 0), 3: (1, 0, 0, 1), 4: (0, 0, 0, 0)}
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert plan.split("Initial Plan")[-1].count("Exchange") == 1  # the one made above
