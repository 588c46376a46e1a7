"""Range coding and BPE: exact round trips and the tokenizers library."""

import random
import zlib

import numpy as np
import pyarrow as pa
import corpus_pipeline
import public_tokenizers
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

import brute
from frameweave.llm import bpe, chunks, rans

BYTES = public_tokenizers.path("byte_bpe_50k.json")
WORDS = public_tokenizers.path("word_bpe_49k.json")
TEXTS = [
    "",
    None,
    "Hello world's end, don't",
    "a <|endoftext|> b<|startoftext|>c",
    "Ünïcödé ŁÓDŹ ΑΣ Σ İstanbul ǅ ﬁ é Å ½²",
    "日本語 and русский 😀👍🏽‍",
    "x" * 5000,
    "tab\tnew\nline\x0b\x0c\x1c\x85\xa0end",
    "12345 !!?? ... --- 'S 'LL it's",
]


def frame(spark, texts, start=0):
    return spark.createDataFrame([(start + i, t) for i, t in enumerate(texts)], "doc_id long, text string")


def test_words_equal_library(spark):
    library = Tokenizer.from_file(WORDS)
    rng = random.Random(3)
    pool = [chr(c) for r in ((0, 0x250), (0x2010, 0x2030), (0x370, 0x400)) for c in range(*r)] + ["<|endoftext|>", "'s "]
    texts = TEXTS + ["".join(rng.choices(pool, k=rng.randint(0, 40))) for _ in range(2000)]
    rows = bpe.round_trip_report(frame(spark, texts), WORDS).collect()
    assert len(rows) == len(texts)
    for r in rows:
        ids = library.encode(texts[r.doc_id] or "", add_special_tokens=False).ids
        assert r.n_tokens == len(ids)
        assert r.ids_sha256 == brute.sha(" ".join(map(str, ids))), texts[r.doc_id]
        assert r.decoded_sha256 == brute.sha(library.decode(ids, skip_special_tokens=False))


def test_cuts_are_forced():
    codec = bpe.WordBpe(WORDS)
    word = "".join(chunks.byte_letters())
    assert "".join(codec.fragments(word)) == word
    assert len(codec.fragments(word)) > 100
    for piece in codec.fragments(word):
        assert all(piece[i : i + 2] in codec.inside for i in range(len(piece) - 1))


def test_words_columns(spark):
    docs = frame(spark, TEXTS).withColumn("decoded_before", F.lit(1))
    rows = bpe.decode_ids(bpe.encode_texts(docs, WORDS), WORDS).collect()
    library = Tokenizer.from_file(WORDS)
    for r in rows:
        assert r.ids == library.encode(r.text or "", add_special_tokens=False).ids
        assert r.decoded == library.decode(r.ids, skip_special_tokens=False)
    assert bpe.round_trip_report(docs.limit(0), WORDS).count() == 0


def test_one_pass_over_texts(spark, monkeypatch):
    monkeypatch.setattr(bpe, "SLICE", 500)
    texts = [*TEXTS, None, "", "word " * 300_000, TEXTS[0]]
    docs = frame(spark, texts).withColumns({"source": F.lit(None).cast("string"), "_row": F.lit(1)}).coalesce(2)
    library = Tokenizer.from_file(WORDS)
    got = bpe.encode_and_check(docs, WORDS)
    assert got.columns == ["doc_id", "source", "_row", "ids", "n_tokens", "decoded_sha256"]
    rows = got.collect()
    assert sorted(r.doc_id for r in rows) == list(range(len(texts)))
    for r in rows:
        ids = library.encode(texts[r.doc_id] or "", add_special_tokens=False).ids
        assert r.ids == ids and r.n_tokens == len(ids) and r.source is None
        assert r.decoded_sha256 == brute.sha(library.decode(ids, skip_special_tokens=False))
    assert bpe.encode_and_check(docs.limit(0), WORDS).collect() == []
    for clash in ("ids", "IDS", "n_tokens"):
        with pytest.raises(ValueError):
            bpe.encode_and_check(docs.withColumn(clash, F.lit(1)), WORDS)


@pytest.mark.parametrize("n", [0, 1, 63, 64, 65, 5000, 140_000])
def test_blocks_round_trip(n):
    rng = np.random.default_rng(n)
    ids = (rng.zipf(1.3, n) % 3000).astype(np.uint32)
    table = rans.Table(rans.frequencies(np.bincount(ids, minlength=3000)))
    lanes, payload, states, offsets, crcs = rans.encode_block(ids, table, step=16)
    row = dict(part=0, block=0, n=n, lanes=lanes, payload=payload, payload_crc=zlib.crc32(payload), states=states, offsets=offsets, crcs=crcs)
    assert np.array_equal(rans.decode_block(row, table, step=16), ids)
    if crcs:
        j = len(crcs) - 1
        assert np.array_equal(rans.decode_block(row, table, j, step=16), ids[j * 16 * lanes :])
        row["payload"] = bytes([payload[0] ^ 1]) + payload[1:] if payload else b"x"
        with pytest.raises(ValueError):
            rans.decode_block(row, table, step=16)


def test_frequencies_sum():
    rng = np.random.default_rng(1)
    for counts in (np.array([5]), np.array([0, 1, 10**9]), rng.integers(0, 3, 50257), np.ones(50257, int)):
        freq = rans.frequencies(counts)
        assert freq.sum() == 1 << rans.SCALE_BITS
        assert ((freq > 0) == (counts > 0)).all()


def want_tokens(rows):
    library, start, want = Tokenizer.from_file(BYTES), 0, []
    for doc_id, text in rows:
        ids = library.encode(text or "", add_special_tokens=False).ids + [0]
        want.append((doc_id, start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())))
        start += len(ids)
    return want


def test_chunks_equal_library():
    library, encoder, rng = Tokenizer.from_file(BYTES), rans.ChunkEncoder(BYTES, 2), random.Random(9)
    pool = [" ", " ", "  ", "\n", "\t", "\xa0", "\u2003", "\x1c", "'s", "don't", "a", "É", "1", ".", "<|endoftext|>", "é́", "😀"]
    texts = ["".join(rng.choices(pool, k=rng.randint(0, 25))) for _ in range(5000)] + [t or "" for t in TEXTS]
    for text in texts:
        assert np.frombuffer(encoder.encode(text), "<u2").tolist() == library.encode(text, add_special_tokens=False).ids, text


def test_token_files(spark, tmp_path):
    texts = TEXTS + [f"word{i} " * (i % 50) for i in range(300)]
    docs = frame(spark, texts).repartition(5)
    path = str(tmp_path / "tokens")
    tokens = rans.tokenize(docs, BYTES, 0, 50257)
    rans.write_tokens(tokens, path, 50257, block=700)  # many documents span blocks
    got = sorted((r.doc_id, r.start, r.n_tokens, r.ids_crc32) for r in rans.token_report(spark, path).collect())
    assert got == want_tokens(list(enumerate(texts)))
    pieces = rans.read_pieces(spark, path).orderBy("part", "block", "doc_no").collect()
    assert b"".join(bytes(p.ids) for p in pieces)[-4:] == bytes(4)


def test_token_files_null_ids_and_repeats(spark, tmp_path):
    rows = [(None, "n"), (3, "b"), (3, "b"), (1, "z")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    path = str(tmp_path / "tokens")
    rans.write_tokens(rans.tokenize(docs, BYTES, 0, 50257), path, 50257)
    got = sorted(((r.doc_id, r.start, r.n_tokens, r.ids_crc32) for r in rans.token_report(spark, path).collect()), key=lambda r: r[1])
    assert got == want_tokens([(None, "n"), (1, "z"), (3, "b"), (3, "b")])


def test_no_documents(spark, tmp_path):
    path = str(tmp_path / "tokens")
    docs = spark.createDataFrame([], "doc_id long, text string, start int")
    rans.write_tokens(rans.tokenize(docs, BYTES, 0, 50257), path, 50257)
    assert rans.token_report(spark, path).count() == 0


@pytest.mark.parametrize("text", ["a  b", " a", "a\n b", "a\t b c", "\xa0 a", "a ", "  ", "a\x1c b", "one\u3000 two three", "word. " * 99])
def test_runs_that_end_in_white_space_are_not_cut_apart(text):
    encoder = rans.ChunkEncoder(BYTES, 2)
    got = np.frombuffer(encoder.encode(text), "<u2").tolist()
    assert got == encoder.library.encode(text, add_special_tokens=False).ids
    with pytest.raises(rans._NotApart):
        encoder._after_space[""]
    with pytest.raises(rans._NotApart):
        encoder._after_space["x\n"]


def test_runs_are_remembered_without_their_signs():
    library, encoder, rng = Tokenizer.from_file(BYTES), rans.ChunkEncoder(BYTES, 2), random.Random(4)
    encoder.encode("The house, the house!!\nA house.\nThe end &&& the house***")
    assert set(encoder._after_space) == {"house", "the", "end", "&&&"}
    parts = ["\n", " ", "a", "house", "Foo", "é", "'s", "!!", ".", ",", "\t", "\r\n", "\x1c", "\xa0", "&&&", "5", "<|endoftext|>", "漢", "don't"]
    for _ in range(2000):
        text = "".join(rng.choices(parts, k=rng.randrange(1, 14)))
        assert np.frombuffer(encoder.encode(text), "<u2").tolist() == library.encode(text, add_special_tokens=False).ids


def test_pipeline_sends_batches_of_bounded_bytes(spark):
    limit = "spark.sql.execution.arrow.maxBytesPerBatch"
    docs = spark.range(0, 40, 1, 1).selectExpr("id AS doc_id", "'s' AS source", "repeat('a ', 1 << 19) AS text")

    def sizes(batches):
        for batch in batches:
            yield pa.RecordBatch.from_arrays([pa.array([batch.nbytes], pa.int64())], ["n"])

    before = spark.conf.get(limit, None)
    try:
        corpus_pipeline.encoded(spark, docs, "")
        assert max(r.n for r in docs.mapInArrow(sizes, "n long").collect()) < 8 << 20
    finally:
        spark.conf.unset(limit) if before is None else spark.conf.set(limit, before)
