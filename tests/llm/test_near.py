"""N-gram Jaccard join and components against brute force."""

import random
import re

import numpy as np
import public_tokenizers
import pytest

import brute
from frameweave.llm import bpe, chunks, components, ngram_join, toxicity


def word_set(text, k):
    words = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    if not words:
        return frozenset()
    return frozenset(tuple(words[i : i + k]) for i in range(max(1, len(words) - k + 1)))


def brute_groups(rows, k, num, den):
    sets = {i: word_set(t, k) for i, t in rows}
    ids = sorted(sets)
    links = []
    for x in range(len(ids)):
        for y in range(x):
            a, b = sets[ids[x]], sets[ids[y]]
            if a and b and den * len(a & b) >= num * len(a | b):
                links.append((ids[x], ids[y]))
    roots = brute.components(ids, links)
    return {i: (len(sets[i]), roots[i]) for i in ids}, links


def test_components(spark):
    rng = random.Random(5)
    pairs = [(rng.randrange(400), rng.randrange(400)) for _ in range(260)] + [(i, i + 1) for i in range(500, 560)]
    links = spark.createDataFrame(pairs, "a long, b long")
    got = {r.node: r.root for r in components.components(links).collect()}
    ids = {i for p in pairs if p[0] != p[1] for i in p}
    want = brute.components(ids, [p for p in pairs if p[0] != p[1]])
    assert got == want
    assert components.components(links.limit(0)).count() == 0


def test_word_hashes_do_not_depend_on_place():
    text = b"  Some words\tsome \n more\x0bwords\x1c \xc3\xa9 "
    got = ngram_join.word_hashes(text)
    words = text.lower().split()
    one = {w: ngram_join.word_hashes(w)[0] for w in words}
    assert [one[w] for w in words] == list(got)
    assert len(set(got)) == len(set(words))
    long = b"x" * (3 << 20) + b" end " + b"y z " * 700_000
    again = ngram_join.word_hashes(long)
    assert len(again) == 2 + 1_400_000
    assert again[1] == ngram_join.word_hashes(b"end")[0] and again[-1] == ngram_join.word_hashes(b"Z")[0]
    assert again[0] == ngram_join._long_word(b"x" * (3 << 20))


def test_bound_holds():
    rng = np.random.default_rng(2)
    for n in (1, 30, 700):
        pool = rng.integers(0, 1 << 62, 2 * n, dtype=np.uint64)
        a, b = np.unique(rng.choice(pool, n)), np.unique(rng.choice(pool, n))
        x, y = ngram_join.bitmap(a).view(np.uint64), ngram_join.bitmap(b).view(np.uint64)
        only = sum(int(v).bit_count() for v in x & ~y)
        assert len(np.intersect1d(a, b)) <= len(a) - only


def test_overlaps_of_many_arrays(monkeypatch):
    monkeypatch.setattr(ngram_join, "_CELLS", 300)  # some columns at a time
    rng = np.random.default_rng(4)
    pool = rng.integers(0, 1 << 62, 400, dtype=np.uint64)
    xs, ys = ([np.unique(rng.choice(pool, n)) for n in sizes] for sizes in ((3, 90, 200), (1, 150, 260, 40)))
    got = ngram_join.overlaps(xs, ys)
    assert got.tolist() == [[len(np.intersect1d(x, y)) for y in ys] for x in xs]
    assert ngram_join.overlaps(xs, [np.array([5], np.uint64)]).tolist() == [[0]] * 3
    bits = [[ngram_join.bitmap(x) for x in side] for side in (xs, ys)]
    n_a, n_b = (np.array([len(x) for x in side]) for side in (xs, ys))
    assert (ngram_join.most_overlap(n_a, bits[0], n_b, bits[1]) >= got).all()


def corpus():
    rng = random.Random(11)
    vocabulary = [f"w{i}" for i in range(3000)]
    passage = rng.choices(vocabulary, k=60)
    rows = []
    for _ in range(60):
        base = rng.choices(vocabulary, k=rng.choice([3, 5, 20, 60, 200, 500]))
        if rng.random() < 0.4:
            base[len(base) // 2 : len(base) // 2] = passage
        rows.append(base)
        for _ in range(rng.choice([0, 0, 1, 4])):
            copy = list(base)
            for _ in range(rng.randint(0, max(1, len(base) // 40))):
                copy[rng.randrange(len(copy))] = rng.choice(vocabulary)
            rows.append(copy)
    chain = rng.choices(vocabulary, k=300)  # a chain whose ends are far apart
    for i in range(12):
        chain = list(chain)
        chain[20 * i : 20 * i + 5] = rng.choices(vocabulary, k=5)
        rows.append(chain)
    texts = [" ".join(w.upper() if rng.random() < 0.1 else w for w in words) for words in rows]
    return texts + [None, "", " \t ", "one", "One", "one two", texts[0], "\x1c"]


@pytest.mark.parametrize("k,num,den", [(4, 85, 100), (2, 50, 100)])
def test_groups_equal_brute_force(spark, k, num, den):
    rows = list(enumerate(corpus()))
    random.Random(1).shuffle(rows)
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    want, links = brute_groups(rows, k, num, den)
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in ngram_join.near_duplicates(docs, k, num, den).collect()}
    assert got == want
    assert len(links) > 5


def test_large_group_of_near_copies(spark):
    rng = random.Random(3)
    base = [f"w{rng.randrange(5000)}" for _ in range(200)]
    rows = []
    for i in range(300):
        words = list(base)
        for _ in range(2):
            words[rng.randrange(200)] = f"x{i}"
        rows.append((i, " ".join(words)))
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = {r.doc_id: r.component_id for r in ngram_join.near_duplicates(docs, 4, 85, 100).collect()}
    want, _ = brute_groups(rows, 4, 85, 100)
    assert got == {i: v[1] for i, v in want.items()}


@pytest.mark.parametrize("block", [8, 512])
def test_groups_below_the_threshold_meet_in_blocks(spark, monkeypatch, block):
    """Texts between 0.6 and 0.9 alike: many share first n-grams, some link across blocks."""
    monkeypatch.setattr(ngram_join, "BLOCK", block)
    rng = random.Random(8)
    rows = []
    for group in range(2):
        base = [f"w{group}_{rng.randrange(5000)}" for _ in range(220)]
        for i in range(90):
            words = list(base)
            for _ in range(rng.choice([2, 6, 9, 12])):
                words[rng.randrange(220)] = f"x{group}_{rng.randrange(60)}"
            rows.append((len(rows), " ".join(words[: 220 - rng.randrange(25)])))
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    got = {r.doc_id: r.component_id for r in ngram_join.near_duplicates(docs, 4, 85, 100).collect()}
    want, links = brute_groups(rows, 4, 85, 100)
    assert got == {i: v[1] for i, v in want.items()}
    assert 10 < len(set(got.values())) < 170


def test_no_table_holds_pairs_of_classes(spark, monkeypatch):
    """Classes that share first n-grams without a link are rows per pair of blocks."""
    rng = random.Random(6)
    base = [f"w{rng.randrange(9000)}" for _ in range(200)]
    rows = []
    for i in range(700):
        words = list(base)
        for j in range(12):
            words[rng.randrange(200)] = f"x{i}_{j}"
        rows.append((i, " ".join(words)))
    sizes, write = [], ngram_join.materialise

    def counted(df):
        out = write(df)
        sizes.append(out.count())
        return out

    monkeypatch.setattr(ngram_join, "materialise", counted)
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    got = ngram_join.near_duplicates(docs, 4, 85, 100).agg({"component_id": "sum"}).first()[0]
    assert got == sum(range(700))
    assert max(sizes) <= 700 * 200  # first n-grams; pairs would be 244,650


def test_ids_and_empty_tables(spark):
    text = "a b c d e f g h i j k l m n o p q r s t u v w x y z"
    rows = [(None, text), (7, text), (7, text), (7, "other words here"), (3, text + " z1"), (None, "alone it is")]
    docs = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "1 as node", "2 as token", "3 as n")
    got = sorted(map(str, ((r.doc_id, r.component_id) for r in ngram_join.near_duplicates(docs).collect())))
    assert got == sorted(map(str, [(None, 3), (7, 3), (7, 3), (7, 7), (3, 3), (None, None)]))
    assert ngram_join.near_duplicates(docs.limit(0)).count() == 0
    assert ngram_join.keep_one(docs).columns == docs.columns


def test_keep_one_row_of_each_group(spark):
    text = "a b c d e f g h i j k l m n o p q r s t u v w x y z"
    rows = [(None, text), (7, text), (7, text), (7, "other words here"), (3, text + " z1"), (None, "alone it is"), (8, " ")]
    other = " ".join(f"w{i}" for i in range(40))  # id 3 is a later member here
    rows += [(1, other), (3, other + " end"), (5, "Same id and Set"), (5, "same id and set"), (6, "twice the same"), (6, "twice the same")]
    kept = ngram_join.keep_one(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    got = sorted((str(r.doc_id), r.text.lower()) for r in kept)
    want = [(3, text + " z1"), (7, "other words here"), (None, "alone it is"), (8, " "), (1, other), (5, "same id and set"), (6, "twice the same")]
    assert got == sorted((str(i), t) for i, t in want)


def test_memories_of_other_operators_are_released():
    held = chunks.remembered()
    held["words"] = 1
    chunks.release()
    assert not held


def test_toxicity_lets_go_of_what_encoding_remembers():
    path = public_tokenizers.path("word_bpe_49k.json")
    first = bpe.codec(path)
    assert bpe.codec(path) is first
    toxicity._matcher(toxicity.Model([toxicity.Term("vile", False, 0)]))
    assert not bpe._codecs
    bpe.codec(path)
    assert not toxicity._matchers


def test_shared_first_ngrams_of_linked_sets():
    rng = random.Random(9)
    limit = ngram_join.Threshold(85, 100)
    need = lambda a, b: -(-85 * (a + b) // 185) - max(-(-85 * a // 100) - 1, -(-85 * b // 100) - 1)
    linked = 0
    for _ in range(400):
        x = set(rng.sample(range(10_000), rng.choice([7, 40, 300])))
        y = set(rng.sample(sorted(x), len(x) - rng.randint(0, len(x) // 8))) | set(rng.sample(range(10_000), rng.randint(0, len(x) // 9)))
        if 100 * len(x & y) >= 85 * len(x | y):
            linked += 1
            firsts = [set(sorted(s)[: limit.prefix(len(s))]) for s in (x, y)]
            assert len(firsts[0] & firsts[1]) >= need(len(x), len(y))
    assert linked > 50


@pytest.mark.parametrize("num,den", [(85, 100), (80, 100), (50, 100), (100, 100)])
def test_shared_within_is_a_lower_bound(spark, num, den):
    limit = ngram_join.Threshold(num, den)
    rows = []
    for n in [*range(1, 60), 333, 1000]:
        sizes = range(-(-num * n // den), den * n // num + 1)
        need = [int(limit.shared(np.int64(n), np.int64(m))) for m in sizes]
        for x, y in ((0, len(sizes) - 1), (len(sizes) // 3, len(sizes) // 2), (len(sizes) // 2, len(sizes) - 1)):
            rows.append((n, sizes[x], sizes[y], min(need[x : y + 1])))
    table = spark.createDataFrame(rows, "n int, least int, most int, need int")
    bound = limit.shared_within(*(ngram_join.F.col(c) for c in ("n", "least", "most")))
    assert table.where(bound > ngram_join.F.col("need")).count() == 0
