"""Answer parsing, normalisation and text splitting as column expressions."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from frameweave.functions.binding import let
from frameweave.functions.hashing import u


def strip(c: Column) -> Column:
    """Trim any white space at both ends."""
    return F.regexp_replace(c, r"^\s+|\s+$", "")


def words(c: Column) -> Column:
    """Non-empty pieces between white space."""
    return F.filter(F.split(c, r"\s+"), lambda x: x != "")


def word_count(c: Column) -> Column:
    return F.size(words(c)).cast("long")


def last_index(text: Column, part: Column) -> Column:
    """0-based start of the last occurrence, -1 if there is none."""
    back = F.instr(F.reverse(text), F.reverse(part))
    return F.when(back == 0, F.lit(-1)).otherwise(F.length(text) - back - F.length(part) + 1)


# ---- choice letters ---------------------------------------------------------------------------

# Lead-ins removed before the letter is looked for.
ANSWER_LEADS = (
    "The best answer is",
    "The correct answer is",
    "The answer is",
    "The answer",
    "The best option is",
    "The correct option is",
    "Best answer:",
    "Best option:",
)


def choice_letter(text: Column) -> Column:
    """First of A-D after removing lead-ins; empty for a long text without a letter."""
    s = strip(text)
    for lead in ANSWER_LEADS:
        s = F.replace(s, F.lit(lead), F.lit(""))
    return F.regexp_extract(s, "[ABCD]", 0)


# Marks stripped from both ends of a response, in this order.
EDGE_MARKS = (",", ".", "!", "?", ";", ":", "'")


def parse_choice(
    response: Column,
    choices: Sequence[str],
    texts: Column | None,
    seed: int,
    row_id: Column,
) -> Column:
    """Chosen letter: bracketed, else between spaces, else by option text in a longer response.

    The last mentioned candidate wins; with no candidate the pick is a repeatable random one.
    """
    for mark in EDGE_MARKS:
        response = F.trim(response, F.lit(mark))
    letters = F.array(*[F.lit(c) for c in choices])
    guess = F.get(letters, F.floor(u(seed, row_id) * len(choices)).cast("int"))
    padded = F.concat(F.lit(" "), response, F.lit(" "))
    return F.coalesce(let(padded, lambda p: _mentioned(p, letters, texts)), guess)


def _mentioned(padded: Column, letters: Column, texts: Column | None) -> Column:
    def latest(found: Column) -> Column:
        # Largest start wins, the earlier option on a tie.
        best = F.array_max(F.filter(found, lambda x: x["start"] >= 0))
        return let(best, lambda b: F.get(letters, -b["back"]))

    def mention(left: str, right: str) -> Column:
        return F.transform(
            letters,
            lambda c, i: F.struct(
                last_index(padded, F.concat(F.lit(left), c, F.lit(right))).alias("start"),
                (-i).alias("back"),
            ),
        )

    picked = F.coalesce(latest(mention("(", ")")), latest(mention(" ", " ")))
    if texts is not None:
        content = F.transform(
            texts,
            lambda t, i: F.struct(
                last_index(F.lower(padded), F.lower(t)).alias("start"), (-i).alias("back")
            ),
        )
        picked = F.coalesce(picked, F.when(word_count(padded) > 5, latest(content)))
    return picked


def science_answer(text: Column, options: Sequence[str]) -> Column:
    """Letter alone, `X.` at the start, or exactly one `The answer is X.`; else FAILED."""
    allowed = list(options)
    said = F.regexp_extract_all(text, F.lit(r"The answer is ([A-Z])."), F.lit(1))
    first = F.substring(text, 1, 1)
    return (
        F.when(text.isin(allowed), text)
        .when(first.isin(allowed) & (F.substring(text, 2, 1) == "."), first)
        .when(F.size(said) == 1, F.get(said, 0))
        .otherwise("FAILED")
    )


def option_index(letter: Column, options: Sequence[str], n_choices: Column) -> Column:
    """Position of the letter among the first `n_choices` options, -1 otherwise."""
    at = F.array_position(F.array(*[F.lit(o) for o in options]), letter) - 1
    return F.when((at >= 0) & (at < n_choices), at).otherwise(F.lit(-1)).cast("long")


# ---- yes / no ---------------------------------------------------------------------------------


def yes_no_sentence(text: Column) -> Column:
    """`no` if the first sentence holds the word No, not or no; `yes` otherwise."""
    head = F.replace(F.split_part(text, F.lit("."), F.lit(1)), F.lit(","), F.lit(""))
    negative = F.array(F.lit("No"), F.lit("not"), F.lit("no"))
    return F.when(F.arrays_overlap(F.split(head, " "), negative), "no").otherwise("yes")


def yes_no_prefix(text: Column) -> Column:
    """`yes` or `no` if found in the first four characters, else `other`."""
    head = F.substring(text, 1, 4)
    return F.when(head.contains("yes"), "yes").when(head.contains("no"), "no").otherwise("other")


# ---- open answers -----------------------------------------------------------------------------

# Words before the answer, and tails that say nothing.
KEY_LEADS = ("could be ", "so ", "is ", "thus ", "therefore ", "final ", "answer ", "result ")
EMPTY_TAILS = (":", ",", ".", "!", "?", ";", "'")
# Fixed patterns: numbers with thousands commas, in scientific form, and plain.
NUMBER_PATTERNS = (
    r"-?\b\d{1,3}(?:,\d{3})+\b",
    r"-?\d+(?:\.\d+)?[eE][+-]?\d+",
    r"-?(?:\d+\.\d+|\.\d+|\d+\b)(?![eE][+-]?\d+)(?![,\d])",
)


def as_number(text: Column) -> Column:
    """Number without thousands commas, NULL if the text is not a number."""
    bare = F.replace(strip(text), F.lit(","), F.lit(""))
    shape = r"^[+-]?(\d+\.?\d*|\.\d+)([eE][+-]?\d+)?$"
    return F.when(bare.rlike(shape), bare.try_cast("double"))


def _normal_words(items: Column) -> Column:
    """Lower-cased strings; a single character is padded so that it cannot match by chance."""
    low = F.transform(F.filter(items, lambda x: as_number(x).isNull()), lambda x: F.lower(strip(x)))
    return F.array_distinct(
        F.flatten(
            F.transform(
                low,
                lambda x: F.when(
                    F.length(x) == 1, F.array(F.concat(F.lit(" "), x), F.concat(x, F.lit(" ")))
                ).otherwise(F.array(x)),
            )
        )
    )


def _normal_numbers(items: Column) -> Column:
    return F.array_distinct(
        F.transform(
            F.filter(items, lambda x: as_number(x).isNotNull()), lambda x: F.round(as_number(x), 2)
        )
    )


def parse_open(response: Column) -> Column:
    """Candidate answers in a free response as struct(words, numbers).

    Each line gives its shortest tail after a lead word (an equals sign too on the last line); the
    tails and the numbers in them are normalised.
    """
    leads = F.array(*[F.lit(x) for x in KEY_LEADS])
    with_equals = F.array(*[F.lit(x) for x in (*KEY_LEADS, "=")])

    def tail(clause: Column, marks: Column) -> Column:
        said = F.filter(marks, lambda m: clause.contains(m))
        after = F.transform(said, lambda m: strip(F.element_at(_split_plain(clause, m), -1)))
        return F.aggregate(
            after,
            F.lit(""),
            lambda kept, a: F.when((kept == "") | (F.length(a) < F.length(kept)), a).otherwise(kept),
        )

    def keys(text: Column) -> Column:
        clauses = F.split(text, "\n")
        tails = F.transform(
            clauses, lambda c, i: tail(c, F.when(i == F.size(clauses) - 1, with_equals).otherwise(leads))
        )
        told = F.filter(tails, lambda k: (k != "") & ~k.isin(*EMPTY_TAILS))
        return let(told, lambda k: F.when(F.size(k) == 0, F.array(text)).otherwise(k))

    def numbers(found: Column) -> Column:
        return F.flatten(
            F.transform(
                found,
                lambda k: F.concat(*[F.regexp_extract_all(k, F.lit(p), F.lit(0)) for p in NUMBER_PATTERNS]),
            )
        )

    text = F.lower(F.trim(strip(response), F.lit(".")))
    return let(
        let(let(text, keys), lambda k: F.concat(k, numbers(k))),
        lambda found: F.struct(
            _normal_words(found).alias("words"), _normal_numbers(found).alias("numbers")
        ),
    )


def _split_plain(text: Column, mark: Column) -> Column:
    """Split at a literal mark."""
    return F.split(text, F.concat(F.lit(r"\Q"), mark, F.lit(r"\E")))


def open_correct(gold: Column, parsed: Column) -> Column:
    """True if a gold string lies in a predicted string, or a gold number is predicted."""

    def check(both: Column) -> Column:
        said = F.exists(
            both["words"], lambda p: F.exists(both["gold_words"], lambda g: p.contains(g))
        )
        return said | F.arrays_overlap(both["numbers"], both["gold_numbers"])

    return let(
        let(
            parsed,
            lambda p: F.struct(
                p["words"].alias("words"),
                p["numbers"].alias("numbers"),
                _normal_words(gold).alias("gold_words"),
                _normal_numbers(gold).alias("gold_numbers"),
            ),
        ),
        check,
    )


# ---- canonical answers ------------------------------------------------------------------------

# Number words, articles and marks of the public VQA answer normalisation.
NUMBER_WORDS = {
    "none": "0", "zero": "0", "one": "1", "two": "2", "three": "3", "four": "4", "five": "5",
    "six": "6", "seven": "7", "eight": "8", "nine": "9", "ten": "10",
}
ARTICLES = ("a", "an", "the")
MARKS = (";", "/", "[", "]", '"', "{", "}", "(", ")", "=", "+", "\\", "_", "-", ">", "<", "@", "`", ",", "?", "!")
# Spellings without (all of) their apostrophes -> the full form.
CONTRACTIONS = {
    "aint": "ain't",
    "arent": "aren't",
    "cant": "can't",
    "couldve": "could've",
    "couldnt": "couldn't",
    "couldn'tve": "couldn't've",
    "couldnt've": "couldn't've",
    "didnt": "didn't",
    "doesnt": "doesn't",
    "dont": "don't",
    "hadnt": "hadn't",
    "hadnt've": "hadn't've",
    "hadn'tve": "hadn't've",
    "hasnt": "hasn't",
    "havent": "haven't",
    "hed": "he'd",
    "hed've": "he'd've",
    "he'dve": "he'd've",
    "hes": "he's",
    "howd": "how'd",
    "howll": "how'll",
    "hows": "how's",
    "isnt": "isn't",
    "itd": "it'd",
    "itd've": "it'd've",
    "it'dve": "it'd've",
    "itll": "it'll",
    "let's": "let's",
    "maam": "ma'am",
    "mightnt": "mightn't",
    "mightnt've": "mightn't've",
    "mightn'tve": "mightn't've",
    "mightve": "might've",
    "mustnt": "mustn't",
    "mustve": "must've",
    "neednt": "needn't",
    "notve": "not've",
    "oclock": "o'clock",
    "oughtnt": "oughtn't",
    "ow's'at": "'ow's'at",
    "'ows'at": "'ow's'at",
    "'ow'sat": "'ow's'at",
    "shant": "shan't",
    "shed've": "she'd've",
    "she'dve": "she'd've",
    "she's": "she's",
    "shouldve": "should've",
    "shouldnt": "shouldn't",
    "shouldnt've": "shouldn't've",
    "shouldn'tve": "shouldn't've",
    "somebody'd": "somebodyd",
    "somebodyd've": "somebody'd've",
    "somebody'dve": "somebody'd've",
    "somebodyll": "somebody'll",
    "somebodys": "somebody's",
    "someoned": "someone'd",
    "someoned've": "someone'd've",
    "someone'dve": "someone'd've",
    "someonell": "someone'll",
    "someones": "someone's",
    "somethingd": "something'd",
    "somethingd've": "something'd've",
    "something'dve": "something'd've",
    "somethingll": "something'll",
    "thats": "that's",
    "thered": "there'd",
    "thered've": "there'd've",
    "there'dve": "there'd've",
    "therere": "there're",
    "theres": "there's",
    "theyd": "they'd",
    "theyd've": "they'd've",
    "they'dve": "they'd've",
    "theyll": "they'll",
    "theyre": "they're",
    "theyve": "they've",
    "twas": "'twas",
    "wasnt": "wasn't",
    "wed've": "we'd've",
    "we'dve": "we'd've",
    "weve": "we've",
    "werent": "weren't",
    "whatll": "what'll",
    "whatre": "what're",
    "whats": "what's",
    "whatve": "what've",
    "whens": "when's",
    "whered": "where'd",
    "wheres": "where's",
    "whereve": "where've",
    "whod": "who'd",
    "whod've": "who'd've",
    "who'dve": "who'd've",
    "wholl": "who'll",
    "whos": "who's",
    "whove": "who've",
    "whyll": "why'll",
    "whyre": "why're",
    "whys": "why's",
    "wont": "won't",
    "wouldve": "would've",
    "wouldnt": "wouldn't",
    "wouldnt've": "wouldn't've",
    "wouldn'tve": "wouldn't've",
    "yall": "y'all",
    "yall'll": "y'all'll",
    "y'allll": "y'all'll",
    "yall'd've": "y'all'd've",
    "y'alld've": "y'all'd've",
    "y'all'dve": "y'all'd've",
    "youd": "you'd",
    "youd've": "you'd've",
    "you'dve": "you'd've",
    "youll": "you'll",
    "youre": "you're",
    "youve": "you've",
}


def literal_map(values: dict[str, str]) -> Column:
    return F.create_map(*[F.lit(x) for pair in values.items() for x in pair])


def canonical_answer(text: Column) -> Column:
    """Lower case, marks removed or spaced, number words to digits, no articles, full contractions."""
    low = F.lower(text)
    for old, new in ((",", ""), ("?", ""), ("'s", " 's")):
        low = F.replace(low, F.lit(old), F.lit(new))
    return let(strip(F.translate(strip(low), "\n\t", "  ")), _canonical)


def _canonical(base: Column) -> Column:
    digits_with_comma = base.rlike(r"\d,+\d")
    out = base
    for mark in MARKS:
        beside_space = base.contains(mark + " ") | base.contains(" " + mark)
        out = F.replace(
            out, F.lit(mark), F.when(beside_space | digits_with_comma, F.lit("")).otherwise(F.lit(" "))
        )
    out = F.regexp_replace(out, r"\.(?!\d)", "")
    numbers, full = literal_map(NUMBER_WORDS), literal_map(CONTRACTIONS)
    tokens = F.transform(words(F.lower(out)), lambda w: F.coalesce(F.try_element_at(numbers, w), w))
    tokens = F.filter(tokens, lambda w: ~w.isin(*ARTICLES))
    return F.array_join(F.transform(tokens, lambda w: F.coalesce(F.try_element_at(full, w), w)), " ")


def soft_vote(prediction: Column, answers: Column) -> Column:
    """Mean over annotators of `min(1, matches among the others / 3)`.

    With c of n annotators giving the predicted answer, c of them see c-1 matches and n-c see c.
    """
    n, third = F.size(answers), F.lit(3.0)
    return let(
        F.size(F.filter(answers, lambda a: a == prediction)),
        lambda c: (
            c * F.least(F.lit(1.0), F.greatest(c - 1, F.lit(0)) / third)
            + (n - c) * F.least(F.lit(1.0), c / third)
        )
        / n,
    )


# ---- graded matches ---------------------------------------------------------------------------


def percent_or_number(text: Column) -> Column:
    is_percent = F.endswith(text, F.lit("%"))
    return F.when(is_percent, F.rtrim(text, F.lit("%")).try_cast("double") / 100).otherwise(
        text.try_cast("double")
    )


def relaxed_match(
    answer: Column, annotation: Column, tolerance: float = 0.05, mode: str = "annotation"
) -> Column:
    """Within `tolerance` as numbers, else equal ignoring case.

    The change is relative to the annotation; `mode="literal"` takes it relative to the answer.
    """
    a, b = percent_or_number(answer), percent_or_number(annotation)
    base, other = (a, b) if mode == "literal" else (b, a)
    numeric = F.abs(other - base) / F.abs(base) <= tolerance
    usable = a.isNotNull() & b.isNotNull() & (base != 0)
    return F.when(usable, numeric).otherwise(F.lower(answer) == F.lower(annotation))


def best_relaxed(answer: Column, annotations: Column, **kwargs) -> Column:
    return F.exists(annotations, lambda a: relaxed_match(F.trim(answer), a, **kwargs))


def edit_similarity(a: Column, b: Column) -> Column:
    """1 - edit distance / longer length, zero below one half."""
    x, y = F.lower(strip(a)), F.lower(strip(b))
    longer = F.greatest(F.length(x), F.length(y))
    score = F.when(longer > 0, 1 - F.levenshtein(x, y) / longer).otherwise(F.lit(1.0))
    return F.when(score >= 0.5, score).otherwise(F.lit(0.0))


def closest(prediction: Column, choices: Column) -> Column:
    """Choice at the least edit distance, the first on a tie."""
    ranked = F.transform(
        choices, lambda c, i: F.struct(F.levenshtein(prediction, c).alias("d"), i.alias("i"), c.alias("c"))
    )
    return F.array_min(ranked)["c"]


def typed_answer(
    extraction: Column, choices: Column, question_type: Column, answer_type: Column, precision: Column
) -> Column:
    """Answer in the form its type asks for: option text, integer, rounded float or as it is."""
    text = F.trim(extraction)
    bracket = F.upper(F.regexp_extract(text, r"\(([a-zA-Z])\)", 1))
    letter = F.when(bracket != "", bracket).otherwise(text)
    at = F.when(F.length(letter) == 1, F.ascii(letter) - 65)
    option = F.when((at >= 0) & (at < F.size(choices)), F.get(choices, at)).otherwise(
        closest(letter, choices)
    )
    number = text.try_cast("double")
    rounded = F.floor(F.abs(number) * F.pow(F.lit(10.0), precision) + 0.5) / F.pow(F.lit(10.0), precision)
    return (
        F.when(question_type == "multi_choice", option)
        .when(answer_type == "integer", number.cast("long").cast("string"))
        .when(answer_type == "float", (F.signum(number) * rounded).cast("string"))
        .otherwise(extraction)
    )


def quick_answer(response: Column, choices: Column, question_type: Column, answer_type: Column) -> Column:
    """Answer readable without a model: a choice, a number of the right type, or a quoted text."""
    quoted = F.regexp_extract(response, r'The answer is "(.*)"\.', 1)
    whole = F.when(response.rlike(r"^\s*[+-]?\d+\s*$"), F.trim(response).try_cast("long"))
    return (
        F.when(response == "", "")
        .when((question_type == "multi_choice") & F.array_contains(choices, response), response)
        .when((answer_type == "integer") & whole.isNotNull(), whole.cast("string"))
        .when(
            (answer_type == "float") & response.try_cast("double").isNotNull(),
            response.try_cast("double").cast("string"),
        )
        .when(quoted != "", quoted)
    )


# ---- judge ------------------------------------------------------------------------------------

JUDGE_FIELDS = "llama_pred string, pred string, score double"


def judge_prompt(question: Column, answer: Column, prediction: Column) -> Column:
    """Request for a yes/no verdict and a score from 0 to 5 as one dictionary."""
    return F.concat(
        F.lit("Compare the predicted answer with the correct one by meaning.\n\nQuestion: "),
        question,
        F.lit("\nCorrect Answer: "),
        answer,
        F.lit("\nPredicted Answer: "),
        prediction,
        F.lit("\n\nReply only with {'llama_pred': 'yes' or 'no', 'score': integer from 0 to 5}."),
    )


def judge_reply(reply: Column) -> Column:
    """Last `{...}` of a reply as struct(pred, score, reject); nothing is ever evaluated."""
    found = F.regexp_extract_all(reply, F.lit(r"\{.*?\}"), F.lit(0))
    parsed = F.from_json(F.element_at(found, -1), JUDGE_FIELDS, {"allowSingleQuotes": "true"})
    pred = F.coalesce(parsed["llama_pred"], parsed["pred"])
    score = parsed["score"]
    reject = F.when(F.size(found) == 0, "no object").when(
        pred.isNull() | score.isNull(), "not readable"
    )
    return F.struct(
        F.when(reject.isNull(), pred).alias("pred"),
        F.when(reject.isNull(), score).alias("score"),
        reject.alias("reject"),
    )


# ---- captions and documents -------------------------------------------------------------------


def cut_repetition(text: Column) -> Column:
    """Text up to the first sentence that was said before, ignoring case."""
    parts, low = F.split(text, r"\."), F.split(F.lower(text), r"\.")
    # Distinct sentences stand in the order of their first use, so both lists part at the first repeat;
    # telling them apart is a hash look-up per sentence.
    first = let(
        F.struct(low.alias("all"), F.array_distinct(low).alias("once")),
        lambda s: F.array_position(F.transform(s["all"], lambda x, i: ~x.eqNullSafe(F.get(s["once"], i))), True),
    )
    return let(
        first.cast("int"),
        lambda f: F.array_join(F.when(f == 0, parts).otherwise(F.slice(parts, F.lit(1), f - 1)), "."),
    )


# Sentence ends, closing quotes that stay with them, opening quotes.
ENDS = "﹒﹔﹖﹗．。！？?.!"
CLOSING = "\"’”」』"
OPENING = "\"‘“「『"


def sentences(text: Column) -> Column:
    """Sentences with their end mark and up to two closing quotes.

    A piece that opens with a quote right after a sentence end stays with that sentence.
    """
    ends = ENDS.replace(".", r"\.").replace("?", r"\?")
    follows = f"(?![{ends}{CLOSING}{OPENING}]|\\z)"
    # Marking the ends and cutting at the mark needs no look-behind at every character. A text that
    # holds the mark itself is cut with one.
    mark = "\u0001"
    marked = F.split(F.regexp_replace(text, f"([{ends}][{CLOSING}]{{0,2}}){follows}", f"$1{mark}"), mark)
    behind = F.split(text, f"(?<=[{ends}][{CLOSING}]{{0,2}}){follows}")
    return F.filter(F.when(text.contains(mark), behind).otherwise(marked), lambda x: x != "")


def _pieces(text: str, marks: Sequence[str], size: int) -> list[str]:
    """Cut before each separator; a piece that is still too long uses the next separator."""
    mark = next((m for m in marks if m in text), None)
    if mark is None:
        return [text] if text else []
    rest = marks[list(marks).index(mark) + 1 :]
    head, *tail = text.split(mark)
    out: list[str] = []
    for piece in [head, *[mark + p for p in tail]]:
        out.extend(_pieces(piece, rest, size) if len(piece) > size and rest else [piece] if piece else [])
    return out


def _windows(pieces: Sequence[str], size: int, overlap: int) -> list[str]:
    """Join neighbouring pieces up to `size`, starting each window with at most `overlap` of the last."""
    out, held, length = [], [], 0
    for piece in pieces:
        if held and length + len(piece) > size:
            out.append("".join(held).strip())
            while held and (length > overlap or length + len(piece) > size):
                length -= len(held.pop(0))
        held.append(piece)
        length += len(piece)
    if held:
        out.append("".join(held).strip())
    return [w for w in out if w]


def document_chunks(size: int = 500, overlap: int = 150, marks: Sequence[str] = ("!", "?", "।")):
    """Arrow UDF: text -> overlapping chunks, cut at separators tried in the order given."""
    marks = tuple(marks)

    @F.pandas_udf(T.ArrayType(T.StringType()))
    def chunks(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for texts in batches:
            yield texts.map(
                lambda t: None if t is None else _windows(_pieces(t, marks, size), size, overlap)
            )

    return chunks


# ---- prompts, times, question features --------------------------------------------------------


def lettered(options: Column, left: str = "(", right: str = ") ", sep: str = "\n") -> Column:
    """`(A) first`, `(B) second`, ... joined by `sep`."""
    return F.array_join(
        F.transform(
            options, lambda o, i: F.concat(F.lit(left), F.char(i + 65), F.lit(right), o)
        ),
        sep,
    )


def choice_prompt(question: Column, options: Column) -> Column:
    return F.concat(F.lit("Question: "), question, F.lit("\nOptions:\n"), lettered(options))


def choice_answer(options: Column, answer: Column) -> Column:
    """`(C) text` for the option equal to the answer; the last one if it is listed twice."""
    at = F.size(options) - F.array_position(F.reverse(options), answer)
    return F.concat(F.lit("("), F.char(at + 65), F.lit(") "), answer)


def number_placeholders(text: Column, name: str = "image") -> Column:
    """`<image>` marks renamed to `<image 1>`, `<image 2>`, ... in order of appearance."""
    parts = F.split(text, f"<{name}>")
    return F.array_join(
        F.transform(
            parts,
            lambda p, i: F.when(i == 0, p).otherwise(
                F.concat(F.lit(f"<{name} "), i.cast("string"), F.lit(">"), p)
            ),
        ),
        "",
    )


def clock_to_seconds(text: Column) -> Column:
    """`H:M:S.f` to seconds."""
    part = F.split(text, ":")
    return (
        F.get(part, 0).cast("double") * 3600 + F.get(part, 1).cast("double") * 60 + F.get(part, 2).cast("double")
    )


def seconds_to_clock(seconds: Column) -> Column:
    """Whole seconds as HH:MM:SS."""
    whole = F.floor(seconds)

    def two(c: Column) -> Column:
        text = c.cast("string")
        return F.when(F.length(text) < 2, F.lpad(text, 2, "0")).otherwise(text)

    return F.concat_ws(
        ":", two(F.floor(whole / 3600)), two(F.floor(whole % 3600 / 60)), two(F.floor(whole % 60))
    )


# Operations that add no reasoning step.
FREE_STEPS = ("exist", "query: name", "choose name")


def reasoning_steps(steps: Column) -> Column:
    """Operations other than the closing ones; `steps` holds `operation: argument` strings."""
    return F.size(F.filter(steps, lambda s: ~_any_of(s, FREE_STEPS))).cast("long")


def _any_of(text: Column, parts: Sequence[str]) -> Column:
    hit = text.contains(parts[0])
    for p in parts[1:]:
        hit = hit | text.contains(p)
    return hit
