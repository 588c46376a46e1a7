"""Toxicity by a learned lexicon, misspellings included, with context windows.

1. Lexicon. On a bounded sample of labelled rows, words and word beginnings are counted per class;
   those that mark toxic texts beyond chance become terms. A beginning (with letters to follow) becomes a stem when no single
   word explains it, as in languages that put endings on it.
2. Matching. The terms form a trie, and a Levenshtein automaton of one or two edits runs over it.
   Their product is made deterministic while texts are read, so a word costs one look-up per letter,
   and a word seen before one look-up in all.
3. Context. A hit between quotation marks or next to words of reporting counts as quotation, one
   near an address ("you") counts more. Both sums, their density and the number of different terms
   feed a logistic model fitted on the same sample.
"""

from __future__ import annotations

import math
import re
from array import array
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field, replace

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from frameweave.llm.chunks import release, remembered
from frameweave.llm.columns import shielded
from frameweave.plans.staging import materialise

#: Labelled rows that are fitted on at most; documented bound of the sample.
SAMPLE = 20_000
#: Terms kept at most, best first.
TERMS = 2_000
STEM_LENGTHS = (4, 5, 6, 7)
#: A term must be this many times as frequent in toxic texts as in clean ones; at FULL_LIFT a hit
#: counts fully, below it by the logarithm.
LIFT, FULL_LIFT = 6.0, 100.0
#: Share of clean sample texts in which misspelled hits of a term may occur by accident.
ACCIDENTS = 2e-4
#: Code points on each side of a hit that are looked at.
WINDOW = 48
#: What a hit counts by its number of edits.
BY_EDITS = (1.0, 0.7, 0.5)
QUOTES = "\"“”„«»‹›"
REPORTING = re.compile(
    r"\b(?:said|says|called|wrote|writes|quoted?|word|term|slur|insult|sagte|nannte|wort|zitat|dit|appel\w+|mot|dijo|llam\w+|palabra)\b"
)
ADDRESS = re.compile(r"\b(?:you|your|you're|u|du|dein|dich|ihr|tu|toi|vous|ton|tú|usted|eres|ti)\b")
_WORD = re.compile(r"[^\W_]+")
MEMORY = 500_000


# ---- matching -----------------------------------------------------------------------------------


@dataclass(frozen=True)
class Term:
    text: str
    stem: bool
    edits: int
    weight: float = 1.0


def allowed_edits(text: str, stem: bool) -> int:
    if stem:
        return 1 if len(text) >= 6 else 0
    return 0 if len(text) < 4 else 1 if len(text) < 8 else 2


class Matcher:
    """Product of a lexicon trie and a Levenshtein automaton, made deterministic on demand.

    `match(word)` gives (term number, edits) of the closest term, the first listed on ties, or None.
    A stem matches if a beginning of the word is close enough to it and more letters follow.
    """

    def __init__(self, terms: list[Term]):
        self.terms = terms
        self._children: list[dict[str, int]] = [{}]
        self._ends: list[list[int]] = [[]]
        self._most = [0]  # edits that some term below the node allows
        for no, term in enumerate(terms):
            node = 0
            self._most[0] = max(self._most[0], term.edits)
            for c in term.text:
                if c not in self._children[node]:
                    self._children[node][c] = len(self._children)
                    self._children.append({})
                    self._ends.append([])
                    self._most.append(0)
                node = self._children[node][c]
                self._most[node] = max(self._most[node], term.edits)
            self._ends[node].append(no)
        self._reset()

    def _reset(self) -> None:
        # A set of (node, least edits) is held as packed numbers: some ten times smaller than as objects.
        self._number: dict[bytes, int] = {}
        self._sets: list[bytes] = []
        self._next: list[dict[str, int]] = []
        self._at_end: list[tuple[int, int] | None] = []  # best (edits, term) of words that end here
        self._passing: list[tuple[int, int] | None] = []  # best (edits, stem) reached so far
        self._start = self._add({0: 0} if self.terms else {})
        self._words: dict[str, tuple[int, int] | None] = {}

    def _add(self, nodes: dict[int, int]) -> int:
        """Number of the state with these (node: least edits), letters of terms may be left out."""
        open_nodes = list(nodes.items())
        while open_nodes:
            node, e = open_nodes.pop()
            if e > nodes.get(node, e):
                continue
            for child in self._children[node].values():
                if e + 1 <= self._most[child] and e + 1 < nodes.get(child, 99):
                    nodes[child] = e + 1
                    open_nodes.append((child, e + 1))
        key = array("I", sorted(node << 2 | e for node, e in nodes.items())).tobytes()
        if key in self._number:
            return self._number[key]
        ends, passing = [], []
        for node, e in nodes.items():
            for no in self._ends[node]:
                if e <= self.terms[no].edits:
                    (passing if self.terms[no].stem else ends).append((e, no))
        self._number[key] = len(self._sets)
        self._sets.append(key)
        self._next.append({})
        self._at_end.append(min(ends, default=None))
        self._passing.append(min(passing, default=None))
        return len(self._sets) - 1

    def _step(self, state: int, c: str) -> int:
        out: dict[int, int] = {}
        for packed in array("I", self._sets[state]):
            node, e = packed >> 2, packed & 3
            if e + 1 <= self._most[node]:
                out[node] = min(out.get(node, 99), e + 1)  # a letter too many
            for letter, child in self._children[node].items():
                cost = e if letter == c else e + 1
                if cost <= self._most[child]:
                    out[child] = min(out.get(child, 99), cost)
        found = self._next[state][c] = self._add(out)
        return found

    def match(self, word: str) -> tuple[int, int] | None:
        if word in self._words:
            return self._words[word]
        if len(self._words) >= MEMORY or len(self._sets) >= MEMORY // 10:
            self._reset()
        state, best = self._start, None
        last = len(word) - 1
        for i, c in enumerate(word):
            found = self._next[state].get(c)
            state = self._step(state, c) if found is None else found
            if not self._sets[state]:
                break
            stem = self._passing[state]
            if stem and i < last and (best is None or stem < best):
                best = stem
        else:
            end = self._at_end[state]
            if end and (best is None or end < best):
                best = end
        found = (best[1], best[0]) if best else None
        if len(word) < 64:
            self._words[word] = found
        return found

    def hits(self, text: str) -> tuple[int, list[tuple[int, int, int, int]]]:
        """Number of words, and (term, edits, start, end) of each hit, in a lower-case text."""
        words = _WORD.findall(text)
        found = list(map(self.match, words))
        if not any(found):
            return len(words), []
        places = _WORD.finditer(text)
        return len(words), [(*hit, m.start(), m.end()) for hit, m in zip(found, places) if hit]


def in_quotation(text: str, start: int, end: int) -> bool:
    """True if the window holds a quotation mark on both sides of the hit, or a reporting word."""
    left, right = text[max(0, start - WINDOW) : start], text[end : end + WINDOW]
    if any(q in left for q in QUOTES) and any(q in right for q in QUOTES):
        return True
    return bool(REPORTING.search(left) or REPORTING.search(right))


def features(matcher: Matcher, text: str) -> list[float]:
    """Direct weight, quoted weight, direct weight per 100 words and different terms of a text."""
    text = text.lower()
    n, hits = matcher.hits(text)
    direct, quoted, terms = 0.0, 0.0, set()
    for term, edits, start, end in hits:
        weight = BY_EDITS[edits] * matcher.terms[term].weight
        if in_quotation(text, start, end):
            quoted += weight
            continue
        terms.add(term)
        near = text[max(0, start - WINDOW) : end + WINDOW]
        direct += weight * (1.5 if ADDRESS.search(near) else 1.0)
    return [math.log1p(direct), math.log1p(quoted), min(3.0, 30 * direct / n) if n else 0.0, math.sqrt(len(terms))]


# ---- learning -----------------------------------------------------------------------------------


@dataclass
class Model:
    terms: list[Term] = field(default_factory=list)
    weights: np.ndarray = field(default_factory=lambda: np.zeros(4))
    bias: float = -4.0

    def score(self, x: list[float]) -> float:
        return 1 / (1 + math.exp(-max(-30.0, min(30.0, self.bias + float(np.dot(self.weights, x))))))


def held_out(doc_id: Column) -> Column:
    """True for the fifth of documents that no label is learned from; a null id is held out."""
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")) % 5 == 0


def training_rows(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> DataFrame:
    """(text, toxic) of at most `sample` labelled rows, chosen by a hash of the id.

    Rows without an id or a label are left out; of several labels of one id the larger counts.
    """
    known = labels.where(F.col("doc_id").isNotNull() & F.col("toxic").isNotNull() & ~held_out(F.col("doc_id")))
    known = known.groupBy("doc_id").agg((F.max("toxic") > 0).alias("toxic"))
    known = known.orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample)  # bounded, so it is broadcast
    rows = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text")).join(F.broadcast(known), "doc_id")
    return materialise(rows.select("text", "toxic"))


def count_terms(rows: DataFrame) -> DataFrame:
    """(term, stem, toxic, clean): documents of each class with a word or a beginning of a word."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        release()
        counts = {True: Counter(), False: Counter()}
        for batch in batches:
            for text, toxic in zip(batch.column(0), batch.column(1)):
                words = {w for w in _WORD.findall(text.as_py().lower()) if 3 <= len(w) <= 40}
                stems = {w[:k] + "*" for w in words for k in STEM_LENGTHS if len(w) > k}
                counts[toxic.as_py()].update(words | stems)
        terms = list(counts[True].keys() | counts[False].keys())
        for i in range(0, len(terms), 50_000):
            part = terms[i : i + 50_000]
            yield pa.RecordBatch.from_arrays(
                [pa.array(part), *[pa.array([counts[c][t] for t in part], pa.int64()) for c in (True, False)]],
                ["term", "toxic", "clean"],
            )

    each = rows.select("text", "toxic").mapInArrow(run, "term string, toxic long, clean long")
    return each.groupBy("term").agg(F.sum("toxic").alias("toxic"), F.sum("clean").alias("clean"))


def _tail(t: Column, c: Column, q: float) -> Column:
    """Log of a bound on the chance that t of t + c texts are toxic where a share q is (Chernoff)."""
    n, p = t + c, t / (t + c)
    rest = F.when(c > 0, (1 - p) * F.log((1 - p) / F.lit(1 - q))).otherwise(0.0)
    return -n * (p * F.log(p / F.lit(q)) + rest)


def choose_terms(found: list[tuple[str, int, float]]) -> list[Term]:
    """Words and stems from (candidate, toxic texts, lift); a trailing * marks a beginning.

    Of beginnings that contain each other the shortest leads: if one word makes up most of its
    texts, the words themselves are terms; otherwise it is a stem, made as long as it stays as
    frequent.
    """
    words = {t: n for t, n, _ in found if not t.endswith("*")}
    starts = {t[:-1]: n for t, n, _ in found if t.endswith("*")}
    lifts = {t: lift for t, _, lift in found}
    stems: list[str] = []
    led: list[str] = []
    for p in sorted(starts, key=lambda s: (len(s), s)):
        if any(p.startswith(s) for s in led):
            continue
        led.append(p)
        if max((n for w, n in words.items() if w.startswith(p)), default=0) >= 0.6 * starts[p]:
            continue
        longer = [q for q in starts if q.startswith(p) and starts[q] >= 0.95 * starts[p]]
        stems.append(max(longer, key=lambda q: (len(q), q)))
    plain = [w for w in words if not any(w.startswith(s) for s in stems)]
    out = [(words[w], w, False) for w in plain] + [(starts[s], s, True) for s in stems]
    out.sort(key=lambda x: (-x[0], x[1]))
    return [
        Term(text, stem, allowed_edits(text, stem), min(1.0, math.log(lifts[text + "*" * stem]) / math.log(FULL_LIFT)))
        for _, text, stem in out[:TERMS]
    ]


def accidental_terms(rows: DataFrame, terms: list[Term], n_clean: int) -> set[int]:
    """Terms whose misspellings occur in clean texts too often to be taken for them."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        release()
        matcher, counts = Matcher(terms), Counter()
        for batch in batches:
            for text in batch.column(0):
                counts.update({h[0] for h in matcher.hits(text.as_py().lower())[1] if h[1]})
        yield pa.RecordBatch.from_arrays(
            [pa.array(list(counts), pa.int32()), pa.array(list(counts.values()), pa.int64())], ["term", "n"]
        )

    clean = rows.where("not toxic").select("text").mapInArrow(run, "term int, n long")
    each = clean.groupBy("term").agg(F.sum("n").alias("n")).where(F.col("n") > max(1.0, ACCIDENTS * n_clean))
    return {r.term for r in each.collect()}  # at most one row per term


def fit_logistic(x: np.ndarray, y: np.ndarray, ridge: float = 1.0, rounds: int = 30) -> tuple[np.ndarray, float]:
    """Newton's method with a ridge on the weights."""
    x = np.hstack([x, np.ones((len(x), 1))])
    w, penalty = np.zeros(x.shape[1]), np.r_[np.full(x.shape[1] - 1, ridge), 1e-3]
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        h = (x * (p * (1 - p))[:, None]).T @ x + np.diag(penalty)
        step = np.linalg.solve(h, x.T @ (y - p) - penalty * w)
        w = w + step
        if np.abs(step).max() < 1e-8:
            break
    return w[:-1], float(w[-1])


def train(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> Model:
    """Model from a bounded sample of labelled rows outside the held-out fifth.

    Without labels of both classes, or without a term beyond chance, every text scores near 0.
    """
    rows = training_rows(docs, labels, sample)
    sizes = {r.toxic: r["count"] for r in rows.groupBy("toxic").count().collect()}
    n_toxic, n_clean = sizes.get(True, 0), sizes.get(False, 0)
    if not n_toxic or not n_clean:
        return Model()
    q = n_toxic / (n_toxic + n_clean)
    counts = materialise(count_terms(rows).where("toxic >= 3"))
    tested = max(1, counts.count())
    t, c = F.col("toxic"), F.col("clean")
    lift = ((t + 0.5) / (n_toxic + 1)) / ((c + 0.5) / (n_clean + 1))
    chance = _tail(t, c, q)
    good = counts.where((t / (t + c) > q) & (lift >= LIFT) & (chance + math.log(tested) <= 0))
    best = good.orderBy(chance, "term").limit(8 * TERMS).select("term", "toxic", lift.alias("lift")).collect()
    terms = choose_terms([tuple(r) for r in best])
    if not terms:
        return Model()
    strict = accidental_terms(rows, terms, n_clean)
    terms = [replace(t, edits=0) if i in strict else t for i, t in enumerate(terms)]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        release()
        matcher = Matcher(terms)
        for batch in batches:
            x = [features(matcher, v.as_py()) for v in batch.column(0)]
            yield pa.RecordBatch.from_arrays([batch.column(1), pa.array(x, pa.list_(pa.float64()))], ["toxic", "x"])

    got = rows.mapInArrow(run, "toxic boolean, x array<double>").toArrow()  # at most `sample` rows
    x = np.array(got.column("x").to_pylist())
    weights, bias = fit_logistic(x, got.column("toxic").to_numpy(zero_copy_only=False).astype(float))
    return Model(terms, weights, bias)


def score_texts(docs: DataFrame, model: Model, text: str = "text", out: str = "toxicity") -> DataFrame:
    """Adds `out` (double, 0 to 1). Only the text is read; null counts as empty.

    Rows are handled one by one, so repeated rows, null ids, empty tables and other columns pass.
    """
    from pyspark.sql import types as T

    @F.arrow_udf(T.DoubleType())
    def scores(column: pa.Array) -> pa.Array:
        matcher = _matcher(model)
        return pa.array([model.score(features(matcher, v.as_py() or "")) for v in column], pa.float64())

    return docs.withColumn(out, scores(F.col(text)))


_matchers: dict[tuple, Matcher] = remembered()


def _matcher(model: Model) -> Matcher:
    """One matcher per Python worker and lexicon."""
    key = tuple(model.terms)
    if key not in _matchers:
        release()
        _matchers[key] = Matcher(model.terms)
    return _matchers[key]


def toxicity_report(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> DataFrame:
    """doc_id, held_out, score, predicted (1 if score >= 0.5) of every document."""
    model = train(docs, labels, sample)
    scored = score_texts(docs.select("doc_id", "text"), model, out="score")
    return scored.select(
        "doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted")
    )


@shielded("doc_id", "text")
def keep_clean(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> DataFrame:
    """`docs` without those that the model calls toxic; same columns."""
    model = train(docs, labels, sample)
    return score_texts(docs, model, out="_toxicity").where("_toxicity < 0.5").select(*docs.columns)
