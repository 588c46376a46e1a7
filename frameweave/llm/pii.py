"""Personal data in texts; built-in functions only, one pass without a shuffle.

Regular expressions propose spans, validators confirm them (Luhn for cards, mod-97 for account
numbers, ranges for addresses, digit counts for phones), and context words shortly before a span
raise its score. A kind whose form alone says little (national ids) is reported only with context.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from frameweave.llm.spans import SPAN, find, joined

#: Code points before a span that are searched for context words, and what one adds to the score.
WINDOW = 40
BOOST = 0.25


def digits(value: Column) -> Column:
    return F.regexp_replace(value, "[^0-9]", "")


def luhn(number: Column) -> Column:
    """True if a string of digits passes the Luhn check."""

    def weight(c: Column, i: Column) -> Column:
        d = c.cast("int") * (1 + i % 2)
        return F.when(d > 9, d - 9).otherwise(d)

    chars = F.split(F.reverse(number), "(?<=[0-9])(?=[0-9])", -1)
    total = F.aggregate(F.transform(chars, weight), F.lit(0), lambda a, x: a + x)
    return total % 10 == 0


def mod97(value: Column) -> Column:
    """True if an international account number has remainder 1."""
    plain = F.regexp_replace(value, " ", "")
    turned = F.concat(F.substr(plain, F.lit(5)), F.substring(plain, 1, 4))
    codes = F.transform(F.split(turned, "(?<=.)(?=.)", -1), lambda c: F.conv(c, 36, 10).cast("int"))
    rest = F.aggregate(codes, F.lit(0), lambda a, x: (a * F.when(x > 9, 100).otherwise(10) + x) % 97)
    return F.char_length(plain).between(15, 34) & (rest == 1)


#: Characters of an account number written in words at most: 34 with blanks between them.
ACCOUNT = 67


def account(text: Column, span: Column) -> Column:
    """The longest account number that begins at a span and ends at a word border; null value if none."""
    near = F.substring(text, span["start"] + 1, F.lit(ACCOUNT + 1))
    run = F.regexp_extract(near, r"^[A-Z0-9]++\b(?: [A-Z0-9]++\b)*+", 0)
    longest = F.least(F.char_length(run), F.lit(ACCOUNT))
    lengths = F.when(longest >= 15, F.sequence(longest, F.lit(15), F.lit(-1)))
    whole = lambda n: F.substring(run, n + 1, F.lit(1)).isin("", " ") & (F.substring(run, n, F.lit(1)) != " ")
    good = F.filter(lengths, lambda n: whole(n) & mod97(F.substring(run, F.lit(1), n)))
    n = F.get(good, F.lit(0))
    return F.struct(
        span["start"].alias("start"), (span["start"] + n).alias("end"), F.substring(run, F.lit(1), n).alias("value")
    ).cast(SPAN)


def _apart(spans: Column) -> Column:
    """Spans without those that begin inside an earlier one."""

    def step(acc: Column, s: Column) -> Column:
        inside = F.coalesce(s["start"] < F.get(acc, F.size(acc) - 1)["end"], F.lit(False))
        return F.when(inside, acc).otherwise(F.concat(acc, F.array(s)))

    return F.aggregate(spans, F.array().cast(f"array<{SPAN}>"), step)


def _octets(value: Column) -> Column:
    parts = F.transform(F.split(value, r"\."), lambda p: F.ltrim(p, F.lit("0")))
    return F.forall(parts, lambda p: (F.char_length(p) <= 3) & (F.coalesce(p.try_cast("int"), F.lit(0)) <= 255))


@dataclass(frozen=True)
class Kind:
    """`pattern` proposes spans in texts for which `hint` holds, `valid` confirms them. The score is
    `score`, plus BOOST if one of the `context` words stands before the span; at least `least`."""

    name: str
    pattern: str
    hint: Callable[[Column], Column]
    valid: Callable[[Column], Column]
    context: str
    score: float
    least: float = 0.0
    #: Makes the whole span from the text and what the pattern found, which is then only its beginning.
    whole: Callable[[Column, Column], Column] | None = None


# A match can only begin where a run of its first class begins or where the last match ended, which
# keeps the search linear; possessive repeats keep the Java stack flat.
#: The first four are the base kinds, in listed order; the others add spans.
KINDS = (
    Kind(
        "email",
        r"(?:(?<![A-Za-z0-9._%+-])|\G)[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
        lambda t: t.contains("@"), lambda v: F.lit(True), "mail|contact|write|reach", 0.7,
    ),
    Kind(
        "ip",
        r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
        lambda t: t.rlike(r"[0-9]\.[0-9]++\.[0-9]++\.[0-9]"), _octets, "ip|host|server|address|login", 0.5,
    ),
    Kind(
        "card",
        r"[0-9](?:[ -]?+[0-9])++",
        lambda t: t.rlike(r"(?:[0-9][ -]?+){11}[0-9]"),
        lambda v: F.char_length(digits(v)).between(12, 19) & luhn(digits(v)),
        "card|visa|credit|payment|pay", 0.6,
    ),
    Kind(
        "phone",
        r"\+[0-9][ ().0-9-]+[0-9]",
        lambda t: t.rlike(r"\+[0-9]"), lambda v: F.char_length(digits(v)).between(9, 15),
        "phone|call|tel|mobile|fax|dial", 0.6,
    ),
    Kind(
        "iban",
        r"\b[A-Z]{2}[0-9]{2}(?= ?[A-Z0-9])",
        lambda t: t.rlike(r"\b[A-Z]{2}[0-9]{2} ?[A-Z0-9]{4}"), lambda v: v.isNotNull(), "iban|account|bank|transfer", 0.7,
        whole=account,
    ),
    Kind(
        "ssn",
        r"(?<![0-9-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9-])",
        lambda t: t.rlike(r"[0-9]{3}-[0-9]{2}-[0-9]{4}"), lambda v: ~v.rlike("^(?:000|666|9)|-00-|-0000$"),
        "ssn|social|security", 0.3, 0.5,
    ),
)
SCORED = "array<struct<start:int,no:int,end:int,kind:string,score:double>>"


def _scored(text: Column, spans: Column, no: int, kind: Kind) -> Column:
    spans = F.coalesce(spans, F.array().cast(f"array<{SPAN}>"))
    if kind.whole:
        spans = F.transform(spans, lambda s: kind.whole(text, s))
    good = F.filter(spans, lambda s: kind.valid(s["value"]))
    good = _apart(good) if kind.whole else good

    def score(s: Column) -> Column:
        start = F.greatest(s["start"] - WINDOW, F.lit(0))
        before = F.lower(F.substring(text, start + 1, s["start"] - start))
        near = before.rlike(rf"\b(?:{kind.context})")
        return F.struct(
            s["start"].alias("start"), F.lit(no).alias("no"), s["end"].alias("end"), F.lit(kind.name).alias("kind"),
            (F.lit(kind.score) + F.when(near, BOOST).otherwise(0.0)).alias("score"),
        )

    return F.filter(F.transform(good, score).cast(SCORED), lambda s: s["score"] >= kind.least)


def find_personal_data(docs: DataFrame, text: str = "text", out: str = "pii", kinds: tuple[Kind, ...] = KINDS) -> DataFrame:
    """Adds `out`: array<struct<start, no, end, kind, score>>, by start, then kind as listed.

    Positions are code points, end exclusive. Null and empty texts give an empty array. Rows are
    handled one by one, so repeated rows, null ids and other columns pass through; column names
    that begin with `_pii_` are reserved.
    """
    df = docs.withColumn("_pii_text", F.coalesce(F.col(text), F.lit("")))
    for k in kinds:
        asked = k.hint(F.col("_pii_text"))
        df = df.withColumn(f"_pii_{k.name}", F.when(asked, find(F.col("_pii_text"), k.pattern)))
    arrays = [_scored(F.col("_pii_text"), F.col(f"_pii_{k.name}"), no, k) for no, k in enumerate(kinds)]
    return df.withColumn(out, F.array_sort(F.concat(*arrays))).drop("_pii_text", *[f"_pii_{k.name}" for k in kinds])


def personal_data_report(docs: DataFrame) -> DataFrame:
    """Digest columns: doc_id, n_email, n_ip, n_card, n_phone, base_sha256, spans, scores."""
    df = find_personal_data(docs.select("doc_id", "text")).drop("text")
    count = lambda kind: F.size(F.filter("pii", lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")
    base = F.filter("pii", lambda s: s["no"] < 4)
    return df.select(
        "doc_id", *[count(k) for k in ("email", "ip", "card", "phone")],
        F.sha2(joined(base), 256).alias("base_sha256"), joined(F.col("pii")).alias("spans"),
        F.transform("pii", lambda s: s["score"]).alias("scores"),
    )
