"""Hand-worked cases for the text expressions."""

import pytest
from pyspark.sql import functions as F

from frameweave.functions import text as X
from frameweave.operators import conversations as C
from frameweave.operators import scoring, selecting


def one(spark, column, **values):
    row = spark.range(1).select(F.lit(1).alias("id"), *[_lit(v).alias(k) for k, v in values.items()])
    return row.select(column.alias("out")).first()[0]


def _lit(v):
    return F.array(*[F.lit(x) for x in v]) if isinstance(v, list) else F.lit(v)


T = F.col("t")


@pytest.mark.parametrize(
    "text, want",
    [
        ("The best answer is C.", "C"),
        ("Best option:B", "B"),
        ("The answer is (D) dog", "D"),
        ("none", ""),
        ("it seems to me that this one is not in the list", ""),
    ],
)
def test_choice_letter(spark, text, want):
    assert one(spark, X.choice_letter(T), t=text) == want


@pytest.mark.parametrize(
    "text, want",
    [
        ("(A) or maybe (C)", "C"),
        ("(C) or maybe (A)", "A"),
        ("A", "A"),
        ("'B'.", "B"),
        ("I would go with B and not A at all", "A"),
        ("what you see there is clearly a cat", "A"),
        ("a dog and then a cat and a dog again", "B"),
    ],
)
def test_parse_choice(spark, text, want):
    options = F.array(F.lit("Cat"), F.lit("Dog"), F.lit("Cow"))
    assert one(spark, X.parse_choice(T, ["A", "B", "C"], options, 1, F.col("id")), t=text) == want


def test_parse_choice_falls_back_repeatably(spark):
    column = X.parse_choice(T, ["A", "B"], None, 1, F.col("id"))
    got = {one(spark, column, t="no idea") for _ in range(3)}
    assert len(got) == 1 and got <= {"A", "B"}


def test_parse_open(spark):
    got = one(spark, X.parse_open(T), t="We look.\nSo the total is 1,234.567")
    assert 1234.57 in got.numbers and "1,234.567" not in got.words
    got = one(spark, X.parse_open(T), t="x = 3\ny = 4")  # '=' counts on the last line only
    assert got.numbers == [4.0]
    got = one(spark, X.parse_open(T), t="blue")
    assert got.words == ["blue"]
    assert one(spark, X.open_correct(F.col("g"), X.parse_open(T)), t="The answer is 3 apples", g=["3"])
    assert not one(spark, X.open_correct(F.col("g"), X.parse_open(T)), t="The answer is 30", g=["3"])
    assert one(spark, X.open_correct(F.col("g"), X.parse_open(T)), t="it is a Red Fox", g=["cow", "red fox"])


@pytest.mark.parametrize(
    "text, want",
    [
        ("Two dogs, the cat!", "2 dogs cat"),
        ("dont know", "don't know"),
        ("1,000.5 kg", "1000.5 kg"),
        ("well-known", "well known"),
        ("a b.", "b"),
        ("cat's", "cat 's"),
        ("", ""),
    ],
)
def test_canonical(spark, text, want):
    assert one(spark, X.canonical_answer(T), t=text) == want


@pytest.mark.parametrize(
    "answer, note, mode, want",
    [
        ("104", "100", "annotation", True),
        ("106", "100", "annotation", False),
        ("50%", "0.5", "annotation", True),
        ("Yes", "yes", "annotation", True),
        ("0", "0", "annotation", True),
        ("105.2", "100", "literal", True),
        ("105.2", "100", "annotation", False),
    ],
)
def test_relaxed(spark, answer, note, mode, want):
    assert one(spark, X.relaxed_match(F.col("a"), F.col("n"), mode=mode), a=answer, n=note) is want


def test_graded(spark):
    assert one(spark, X.edit_similarity(T, F.lit("Kitten")), t="sitting") == pytest.approx(1 - 3 / 7)
    assert one(spark, X.edit_similarity(T, F.lit("abcdef")), t="xyz") == 0
    assert one(spark, X.closest(T, F.array(F.lit("dog"), F.lit("dot"))), t="dos") == "dog"
    gt = ["a"] * 2 + ["b"] * 5 + ["c"] * 3
    for said, n in (("a", 2), ("b", 5), ("z", 0)):
        want = (n * min(1, max(n - 1, 0) / 3) + (10 - n) * min(1, n / 3)) / 10
        assert one(spark, X.soft_vote(T, F.col("g")), t=said, g=gt) == pytest.approx(want)


@pytest.mark.parametrize(
    "reply, want",
    [
        ("{'llama_pred': 'yes', 'score': 4}", ("yes", 4.0, None)),
        ("{'pred': 'no', 'score': 4.8} {'pred': 'yes', 'score': 1}", ("yes", 1.0, None)),
        ("{'llama_pred': 'yes'}", (None, None, "not readable")),
        ("{'llama_pred': 'yes', 'score': ", (None, None, "no object")),
    ],
)
def test_judge_reply(spark, reply, want):
    assert tuple(one(spark, X.judge_reply(T), t=reply)) == want


def test_sentences_and_chunks(spark):
    cut = lambda t: one(spark, X.sentences(T), t=t)
    assert cut('A b. "C d." E?!F') == ["A b.", ' "C d."', " E?!", "F"]
    assert cut("一。“二。”三") == ["一。“二。”", "三"]
    assert cut("") == []
    assert one(spark, X.cut_repetition(T), t="One. two. ONE. three") == "One. two. ONE. three"
    assert one(spark, X.cut_repetition(T), t="One.two.ONE.three") == "One.two"
    text = "! ".join(f"part {i} " + "x" * (i % 40) for i in range(60))
    chunks = one(spark, X.document_chunks(100, 30)(T), t=text)
    assert all(len(c) <= 100 for c in chunks) and len(chunks) > 10
    assert all(f"part {i} " in "|".join(chunks) + " " for i in range(60))
    long = one(spark, X.document_chunks(10, 3)(T), t="y" * 25 + "!z")
    assert "".join(long) == "y" * 25 + "!z"


def test_typed_and_times(spark):
    def typed(ext, kind, answer):
        return one(
            spark,
            X.typed_answer(T, F.array(F.lit("red"), F.lit("blue")), F.lit(kind), F.lit(answer), F.lit(2)),
            t=ext,
        )

    assert typed("(b) blue", "multi_choice", "text") == "blue"
    assert typed("rad", "multi_choice", "text") == "red"
    assert typed("7.9", "free", "integer") == "7"
    assert typed("3.14159", "free", "float") == "3.14"
    assert typed("abc", "free", "integer") is None
    assert one(spark, X.clock_to_seconds(T), t="1:02:03.5") == 3723.5
    assert one(spark, X.seconds_to_clock(F.lit(3723.9))) == "01:02:03"
    assert one(spark, X.reasoning_steps(F.col("s")), s=["select: dog", "exist: ?", "filter: red"]) == 2
    assert one(spark, X.yes_no_sentence(T), t="It is, not there. Yes") == "no"
    assert one(spark, X.science_answer(T, ["A", "B"]), t="B. since") == "B"


def test_option_rounds(spark):
    df = spark.createDataFrame([("x", "y", "nan", "w", "B")], "A string, B string, C string, D string, r string")
    got = selecting.option_rounds(df, ["A", "B", "C", "D"], answer="r").orderBy("round").collect()
    assert [(r.options, r.answer_letter) for r in got] == [(["x", "y"], "B"), (["y", "x"], "A")]


def test_score_pair_and_choice_answer(spark):
    assert one(spark, scoring.score_pair(T), t="8, 7.5\nfine") == [8.0, 7.5]
    assert one(spark, scoring.score_pair(T), t="eight 7") == [-1.0, -1.0]
    assert one(spark, X.choice_answer(F.col("o"), F.lit("b")), o=["a", "b", "b"]) == "(C) b"


@pytest.mark.parametrize(
    "style, want",
    [
        ("single", "###Human: hi###Assistant: yo###"),
        ("two", " USER: hi ASSISTANT: yo</s>"),
        ("chatml", "<|im_start|>user\nhi<|im_end|>\n<|im_start|>assistant\nyo<|im_end|>\n"),
        ("mpt", "<|im_start|>user\nhi<|im_end|><|im_start|>assistant\nyo<|im_end|>"),
        ("llama2", "[INST] hi [/INST] yo </s>"),
        ("plain", "hi\nyo\n"),
        (
            "llama3",
            "<|begin_of_text|><|start_header_id|>user<|end_header_id|>\n\nhi<|eot_id|>"
            "<|start_header_id|>assistant<|end_header_id|>\n\nyo<|eot_id|>",
        ),
    ],
)
def test_render(spark, style, want):
    turns = spark.createDataFrame([(1, 0, 0, "hi"), (1, 1, 1, "yo")], "c int, i int, s int, t string")
    row = C.render(turns, "c", ["i"], "s", "t", C.STYLES[style]).first()
    assert (row.prompt, row.rejected) == (want, False)


def test_labels(spark):
    rows = [(1, 0, 0, [1, 2]), (1, 1, 1, [3]), (2, 0, 1, [9]), (2, 1, 0, [4]), (2, 2, 1, [5]), (3, 0, 0, [6]), (3, 1, 0, [7])]
    turns = spark.createDataFrame(rows, "c int, i int, s int, ids array<int>")
    got = {r.c: (r.input_ids, r.labels) for r in C.training_labels(turns, "c", ["i"], "s", "ids").collect()}
    x = C.IGNORE
    assert got == {1: ([1, 2, 3], [x, x, 3]), 2: ([4, 5], [x, 5]), 3: ([6, 7], [x, x])}
    assert one(spark, C.completion_labels(F.col("v"), [7, 8]), v=[1, 7, 8, 2, 7, 8, 3]) == [x] * 6 + [3]
    assert one(spark, C.completion_labels(F.col("v"), [7, 8]), v=[1, 7]) == [x, x]


def test_judging_resumes(spark):
    rows = [(i, f"q{i}", "a", "b") for i in range(4)]
    preds = spark.createDataFrame(rows, "id int, question string, label string, predict string")

    @F.pandas_udf("string")
    def model(prompts):
        return prompts.map(lambda p: "{'llama_pred': 'no', 'score': 1}" if "q3" not in p else "pardon?")

    first = scoring.judge_predictions(preds.where("id < 2"), None, ["id"], model)
    saved = first.withColumn("score", F.lit(5.0))
    out = {r.id: (r.llama_pred, r.score, r.reject) for r in scoring.judge_predictions(preds, saved, ["id"], model).collect()}
    assert out == {0: ("no", 5.0, None), 1: ("no", 5.0, None), 2: ("no", 1.0, None), 3: (None, None, "no object")}
