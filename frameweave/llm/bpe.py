"""Word-level BPE with forced cuts, equal to the tokenizers library on the same vocabulary file.

A pair of adjacent bytes that stands inside no vocabulary token can never be merged across, so it
marks a certain cut: the fragments of a word on both sides are encoded on their own and their ids
concatenated. Fragments and whole runs between white space are remembered, as most recur.
"""

from __future__ import annotations

import hashlib
import json
import re
from collections.abc import Iterator
from operator import add

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from frameweave.llm.chunks import LETTERS, UNUSUAL, Memory, in_letters, packed, release, remembered

#: Runs between white space, words and fragments that a Python worker remembers, about 200 bytes each
#: and so at most about 120 MB.
CHUNKS, WORDS, FRAGMENTS = 200_000, 200_000, 200_000
#: Bytes of text whose ids are held at once.
SLICE = 4 << 20

# Fixed by the vocabulary file: contractions, runs of letters, single digits, runs of other signs.
_PIECES = re.compile(rf"[{LETTERS}]+|'(?:s|t|re|ve|m|ll|d)|[0-9]|[^\s0-9{LETTERS}]+")
_SEPARATORS = re.compile("[\x1c-\x1f]")  # white space for str.split(), not for the library
_OTHER_SPACE = re.compile(r"[^\S\x1c-\x1f]+")


class WordBpe:
    """Encoder and decoder for a vocabulary file of the word-end kind.

    `encode` gives the ids of a whole text, `decode` the text of ids, special tokens included.
    """

    def __init__(self, path: str):
        from tokenizers import Tokenizer
        from tokenizers.models import BPE

        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        model = spec["model"]
        self.vocab: dict[str, int] = model["vocab"]
        self.end: str = model["end_of_word_suffix"] or ""
        merges = [tuple(m.split(" ")) if isinstance(m, str) else tuple(m) for m in model["merges"]]
        # A fragment inside a word has no end mark, the last one has; merging itself is the library's.
        self._inner = BPE(self.vocab, merges)
        self._last = BPE(self.vocab, merges, end_of_word_suffix=self.end or None)
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self.token = {i: t for t, i in (self.vocab | self.special).items()}
        self.number = {i: str(i) for i in self.token}
        self._cut_special = re.compile("|".join(map(re.escape, self.special)) or r"(?!)")
        self.width = 2 if len(self.token) <= 1 << 16 else 4
        self.inside = self._inside_pairs()
        self._fragment = Memory(self._of_fragment, FRAGMENTS)
        self._chunk = Memory(self._of_chunk, CHUNKS)
        self._word = Memory(self._of_word, WORDS)
        self._library = Tokenizer.from_file(path)

    def _inside_pairs(self) -> frozenset[str]:
        """Pairs of letters that occur inside at least one token; any other pair is a cut."""
        pairs: set[str] = set()
        for token in self.vocab:
            body = token.removesuffix(self.end) if self.end else token
            pairs.update(map("".join, zip(body, body[1:])))
        return frozenset(pairs)

    def fragments(self, word: str) -> list[str]:
        """`word` (in byte letters) cut at every pair that no token holds."""
        cuts = [i for i, pair in enumerate(map(add, word, word[1:]), 1) if pair not in self.inside]
        if not cuts:
            return [word]
        return [word[a:b] for a, b in zip([0, *cuts], [*cuts, len(word)])]

    def _of_fragment(self, fragment: str) -> bytes:
        """Ids of a fragment (in byte letters); one that ends a word has a trailing blank."""
        model = self._last if fragment[-1] == " " else self._inner
        return packed([t.id for t in model.tokenize(fragment.removesuffix(" "))], self.width)

    def _of_word(self, word: str) -> bytes:
        return self._of_letters(in_letters(word))

    def _of_letters(self, coded: str) -> bytes:
        *inner, last = self.fragments(coded)
        if not inner:
            return self._of_fragment(last + " ")  # the word itself is remembered
        return b"".join(map(self._fragment.__getitem__, [*inner, last + " "]))

    def _of_chunk(self, chunk: str) -> bytes:
        """Ids of a run without white space."""
        if UNUSUAL.search(chunk):
            # Signs of other scripts: the library itself normalises and splits, with its tables.
            whole = self._library.normalizer.normalize_str(chunk)
            return b"".join(self._of_letters(c) for c, _ in self._library.pre_tokenizer.pre_tokenize_str(whole))
        return b"".join(map(self._word.__getitem__, _PIECES.findall(chunk.lower())))

    def _plain(self, text: str) -> bytes:
        # The tokenizer drops white space, so no id depends on signs on both sides of it.
        chunks = _OTHER_SPACE.split(text) if _SEPARATORS.search(text) else text.split()
        return b"".join(map(self._chunk.__getitem__, chunks))

    def encode(self, text: str) -> list[int]:
        return self.encode_array(text).tolist()

    def encode_array(self, text: str) -> np.ndarray:
        """Ids of a whole text, special tokens in it included, two or four bytes each."""
        parts, at = [], 0
        for m in self._cut_special.finditer(text):
            parts += [self._plain(text[at : m.start()]), packed([self.special[m[0]]], self.width)]
            at = m.end()
        parts.append(self._plain(text[at:]))
        return np.frombuffer(b"".join(parts), f"<u{self.width}")

    def decode(self, ids: list[int]) -> str:
        return " ".join(map(self.token.__getitem__, ids))


_codecs: dict[str, WordBpe] = remembered()


def codec(path: str) -> WordBpe:
    """One codec per Python worker and file."""
    if path not in _codecs:
        release()
        _codecs[path] = WordBpe(path)
    return _codecs[path]


def _lists(arrays: list[np.ndarray]) -> pa.ListArray:
    """Arrays of numbers as one column, without a Python object per number."""
    offsets = np.r_[0, np.cumsum([len(a) for a in arrays], dtype=np.int64)].astype(np.int32)
    values = np.concatenate(arrays) if arrays else np.zeros(0)
    return pa.ListArray.from_arrays(pa.array(offsets), pa.array(values.astype(np.int32)))


def encode_texts(docs: DataFrame, path: str, text: str = "text", out: str = "ids") -> DataFrame:
    """Adds `out` (array<int>): the ids of each whole text; a null text counts as empty.

    Rows are handled one by one in Arrow batches, so empty tables, repeated rows, null ids and
    other columns pass through. A column named `out` must not exist (ValueError).
    """
    _absent(docs, out)

    @F.arrow_udf(T.ArrayType(T.IntegerType()))
    def ids(column: pa.Array) -> pa.Array:
        bpe = codec(path)
        return _lists([bpe.encode_array(x.as_py() or "") for x in column])

    return docs.withColumn(out, ids(F.col(text)))


def _absent(docs: DataFrame, *names: str) -> None:
    there = {c.lower() for c in docs.columns} & {n.lower() for n in names}
    if there:
        raise ValueError(f"columns {sorted(there)} exist")


def encode_and_check(docs: DataFrame, path: str, text: str = "text") -> DataFrame:
    """`docs` without `text` but with ids (array<int>), n_tokens and decoded_sha256, each text encoded once.

    decoded_sha256 is the digest of the decoded ids, which are not kept. A null text counts as empty;
    empty tables, repeated rows, nulls in and other columns pass through; columns named like an
    added one must not exist (ValueError). Ids of SLICE bytes of text, or of one longer text, are
    held at once.
    """
    keep = docs.drop(text)
    _absent(keep, "ids", "n_tokens", "decoded_sha256")
    names = [*keep.columns, "ids", "n_tokens", "decoded_sha256"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = codec(path)
        for batch in batches:
            ids, digests, held, start = [], [], 0, 0
            for i, value in enumerate(batch.column(batch.num_columns - 1)):
                value = value.as_py() or ""
                ids.append(bpe.encode_array(value))
                digests.append(hashlib.sha256(bpe.decode(ids[-1].tolist()).encode()).hexdigest())
                held += len(value)
                if held >= SLICE or i == batch.num_rows - 1:
                    counts = pa.array([len(a) for a in ids], pa.int64())
                    kept = batch.slice(start, i + 1 - start).columns[:-1]
                    yield pa.RecordBatch.from_arrays([*kept, _lists(ids), counts, pa.array(digests, pa.string())], names)
                    ids, digests, held, start = [], [], 0, i + 1

    schema = T.StructType(
        [*keep.schema, T.StructField("ids", T.ArrayType(T.IntegerType())), T.StructField("n_tokens", T.LongType()),
         T.StructField("decoded_sha256", T.StringType())]
    )
    return docs.select(*keep.columns, text).mapInArrow(run, schema)


def decode_ids(docs: DataFrame, path: str, ids: str = "ids", out: str = "decoded") -> DataFrame:
    """Adds `out`: the text of each id array, special tokens included; null ids give empty text.

    A column named `out` must not exist (ValueError).
    """
    _absent(docs, out)

    @F.arrow_udf(T.StringType())
    def texts(column: pa.Array) -> pa.Array:
        bpe = codec(path)
        return pa.array([bpe.decode(x.as_py() or []) for x in column], pa.string())

    return docs.withColumn(out, texts(F.col(ids)))


def round_trip_report(docs: DataFrame, path: str) -> DataFrame:
    """doc_id, n_tokens, ids_sha256, decoded_sha256 of each row; the ids never leave the task."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = codec(path)
        number = bpe.number.__getitem__
        for batch in batches:
            counts, ids_hash, text_hash = [], [], []
            for value in batch.column(1):
                ids = bpe.encode(value.as_py() or "")
                counts.append(len(ids))
                ids_hash.append(hashlib.sha256(" ".join(map(number, ids)).encode()).hexdigest())
                text_hash.append(hashlib.sha256(bpe.decode(ids).encode()).hexdigest())
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(counts, pa.int64()), pa.array(ids_hash, pa.string()), pa.array(text_hash, pa.string())],
                ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"],
            )

    return docs.select("doc_id", "text").mapInArrow(
        run, "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string"
    )
