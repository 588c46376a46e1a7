"""Incremental secret scanning over a ledger of blobs; built-in functions only.

Every historical version of a file is a blob, addressed by the SHA-256 of its text. The ledger
records which rule versions have seen which blob and what they found. A scan reads the versions,
takes the (blob, rule version) pairs that the ledger lacks, runs the rules on one copy of each
such blob, appends the findings, and joins the ledger back to all paths and versions. A second
scan over the same history scans nothing; a changed rule rescans with that rule only.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from frameweave.llm.spans import SPAN, find, joined
from frameweave.plans.staging import materialise


@dataclass(frozen=True)
class Rule:
    """`pattern` finds candidates in texts for which `hint` holds; `keep` tests a matched text."""

    kind: str
    version: int
    pattern: str
    hint: Callable[[Column], Column]
    keep: Callable[[Column], Column] = lambda value: F.lit(True)

    @property
    def key(self) -> str:
        return f"{self.kind}@{self.version}"


ASSIGN = (
    r"(?i:(password|passwd|secret|token|api_?key))[\"']?\x20*[:=]\x20*[\"']?([A-Za-z0-9+/_.=-]+)"
)

#: The first three are the base kinds, in listed order; the others add spans.
RULES = (
    Rule(
        "assign", 1, ASSIGN,
        lambda t: t.rlike(ASSIGN),
        lambda v: F.char_length(F.regexp_extract(v, ASSIGN, 2)) >= 8,
    ),
    # A run shorter than 16 in all cannot hold a longer one, so the length may stand in the pattern.
    Rule("access", 1, r"AKIA[A-Z0-9]{12,}+", lambda t: t.contains("AKIA")),
    Rule("hex", 1, r"[0-9a-f]{32,}+", lambda t: t.rlike(r"[0-9a-f]{32}")),
    Rule("pem", 1, r"-----BEGIN [A-Z ]{0,24}PRIVATE KEY-----", lambda t: t.contains("PRIVATE KEY-----")),
    Rule("url", 2, r"[a-z][a-z0-9+]{1,9}://[^\s:/@]{1,64}:[^\s:/@]{3,}+@", lambda t: t.contains("://")),
)
#: Findings in the ledger name the rule version that made them; what a scan returns does not.
FOUND = "array<struct<rule:string,kind:string,start:int,end:int>>"
LEDGER = T.StructType(
    [
        T.StructField("blob", T.StringType()),
        T.StructField("rules", T.ArrayType(T.StringType())),
        T.StructField("found", T.ArrayType(T.StructType([
            T.StructField("rule", T.StringType()),
            T.StructField("kind", T.StringType()),
            T.StructField("start", T.IntegerType()),
            T.StructField("end", T.IntegerType()),
        ]))),
    ]
)


def blob_id(text: Column) -> Column:
    return F.sha2(F.coalesce(text, F.lit("")).cast("binary"), 256)


def read_ledger(spark, path: str) -> DataFrame:
    """Ledger rows (blob, rules, found): one per blob and scan."""
    return spark.read.schema(LEDGER).parquet(path)


def create_ledger(spark, path: str) -> str:
    """An empty ledger at `path`, if none is there."""
    spark.createDataFrame([], LEDGER).write.mode("ignore").parquet(path)
    return path


def unseen(versions: DataFrame, ledger: DataFrame, rules: tuple[Rule, ...]) -> DataFrame:
    """(blob, row_id, todo): the rules each blob lacks, and one row that holds its text."""
    keys = F.array(*[F.lit(r.key) for r in rules])
    blobs = versions.groupBy("blob").agg(F.min("row_id").alias("row_id"))
    done = ledger.groupBy("blob").agg(F.flatten(F.collect_list("rules")).alias("done"))
    todo = F.array_except(keys, F.coalesce("done", F.array().cast("array<string>")))
    return blobs.join(done, "blob", "left").select("blob", "row_id", todo.alias("todo")).where(F.size("todo") > 0)


def _kept(spans: Column, rule: Rule) -> Column:
    spans = F.coalesce(spans, F.array().cast(f"array<{SPAN}>"))
    good = F.filter(spans, lambda s: rule.keep(s["value"]))
    named = F.transform(good, lambda s: F.struct(F.lit(rule.key).alias("rule"), F.lit(rule.kind).alias("kind"), s["start"].alias("start"), s["end"].alias("end")))
    return named.cast(FOUND)


def scan_texts(texts: DataFrame, rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """Runs each text's `todo` rules: (blob, rules, found) from (blob, todo, text)."""
    df = texts
    for r in rules:
        asked = F.array_contains("todo", r.key) & r.hint(F.col("text"))
        df = df.withColumn(f"_{r.kind}", F.when(asked, find(F.col("text"), r.pattern)))
    arrays = [_kept(F.col(f"_{r.kind}"), r) for r in rules]
    return df.select("blob", F.col("todo").alias("rules"), F.concat(*arrays).alias("found"))


def scan_history(
    history: DataFrame, ledger_path: str, path: str = "path", text: str = "text", rules: tuple[Rule, ...] = RULES
) -> DataFrame:
    """Scan what is new in `history` and return (path, blob, found) for each of its rows.

    `history` has a row per path and version. A null text counts as empty; null paths, repeated
    rows and ties each give their own row; an empty table gives none. `found` lists all findings of
    the current rule versions as (kind, start, end) in code points. Texts are moved once, and only to pick
    one copy of each unseen blob; findings travel by blob id. The ledger at `ledger_path` must exist
    (`create_ledger`) on storage that all executors share.
    """
    spark = history.sparkSession
    rows = history.select(F.col(path).alias("path"), F.coalesce(F.col(text), F.lit("")).alias("text"))
    versions = materialise(
        rows.select("path", blob_id(F.col("text")).alias("blob"), F.xxhash64("path").alias("row_id"))
    )
    todo = unseen(versions, read_ledger(spark, ledger_path), rules)
    # The small side is built per partition, so the texts are neither sorted nor spilled.
    texts = rows.withColumns({"blob": blob_id(F.col("text")), "row_id": F.xxhash64("path")}).join(
        todo.hint("shuffle_hash"), ["blob", "row_id"]
    )
    found = materialise(scan_texts(texts, rules).dropDuplicates(["blob"]))
    found.write.mode("append").parquet(ledger_path)
    current = F.array(*[F.lit(r.key) for r in rules])
    ledger = read_ledger(spark, ledger_path).where(F.arrays_overlap("rules", current))
    # What replaced or removed rules have found stays in the ledger but is no finding any more.
    mine = F.filter("found", lambda s: F.array_contains(current, s["rule"]))
    plain = F.transform(mine, lambda s: F.struct(s["kind"].alias("kind"), s["start"].alias("start"), s["end"].alias("end")))
    # Written out: otherwise the join would share the aggregation's partitioning, and a blob with very many
    # paths could not be split over tasks.
    merged = materialise(ledger.groupBy("blob").agg(F.array_distinct(F.flatten(F.collect_list(plain))).alias("found")))
    return versions.select("path", "blob").join(merged, "blob").select("path", "blob", "found")


def scan_report(found: DataFrame, rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """Digest columns: doc_id, n_assign, n_access, n_hex, base_sha256, spans."""
    order = F.create_map(*[x for i, r in enumerate(rules) for x in (F.lit(r.kind), F.lit(i))])
    spans = F.array_sort(
        F.transform(
            "found",
            lambda s: F.struct(s["start"].alias("start"), order[s["kind"]].alias("no"), s["end"].alias("end"), s["kind"].alias("kind")),
        )
    )
    df = found.withColumn("_spans", spans)
    count = lambda kind: F.size(F.filter("_spans", lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")
    base = F.filter("_spans", lambda s: s["no"] < 3)
    return df.select(
        F.col("path").alias("doc_id"), count("assign"), count("access"), count("hex"),
        F.sha2(joined(base), 256).alias("base_sha256"), joined(F.col("_spans")).alias("spans"),
    )
