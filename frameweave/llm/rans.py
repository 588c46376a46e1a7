"""Token ids as static range-ANS blocks, with checkpoints and checksums for parallel decoding.

File format: a Parquet folder with one row per block, and beside it the shared frequency table.

* The ids of all documents, in ascending order of document id, form one sequence per part; parts
  are consecutive ranges of documents. A block holds `BLOCK` consecutive ids of its part (the last
  one fewer) and depends on no other block. A document may span blocks.
* `lanes` coders work interleaved: id number i of a block belongs to lane i modulo `lanes`. Each
  has a 64-bit state in [2^31, 2^63) and passes on 32-bit words (`payload`, little-endian). In one
  row of `lanes` ids the lanes read their words in ascending order.
* Every `STEP` rows of ids the encoder notes all lane states and the word offset (`states`,
  `offsets`), so each segment can be decoded on its own. `crcs` holds the CRC-32 of each segment's
  ids as unsigned 32-bit integers and `payload_crc` that of the payload; both are checked on reading.
* `doc_ids`, `doc_lens` and `first_doc` say which documents the ids belong to.
* The frequency table (symbol, freq) sums to 2^SCALE_BITS; every id that occurs has at least 1.
"""

from __future__ import annotations

import os
import re
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from frameweave.llm.chunks import CHUNKS, LETTERS, PIECES, UNUSUAL, Memory, in_letters, packed
from frameweave.plans.staging import materialise, small_side

SCALE_BITS = 20
LOW = 1 << 31  # least state after a step
BLOCK = 1 << 18  # ids per block
LANES = 1024
STEP = 128  # rows of ids between checkpoints


class Table:
    """Frequencies, cumulated frequencies and, for decoding, the symbol of every slot."""

    def __init__(self, freq: np.ndarray):
        self.freq = freq.astype(np.uint64)
        self.start = np.concatenate([[0], np.cumsum(self.freq)[:-1]]).astype(np.uint64)
        self.slots = np.repeat(np.arange(len(freq), dtype=np.uint32), freq.astype(np.int64))


def frequencies(counts: np.ndarray) -> np.ndarray:
    """Counts scaled to sum 2^SCALE_BITS, at least 1 for each id that occurs.

    The surplus of the ids that were raised to 1 is taken from the most frequent ids.
    """
    total, size = int(counts.sum()), 1 << SCALE_BITS
    if not total:
        return np.zeros(len(counts), np.int64)
    if np.count_nonzero(counts) > size:
        raise ValueError("more symbols than slots")
    freq = np.where(counts > 0, np.maximum(1, counts.astype(float) * size // total), 0).astype(np.int64)
    order, rest, i = np.lexsort((np.arange(len(freq)), -freq)), size - int(freq.sum()), 0
    while rest:
        at = order[i % len(order)]
        step = rest if rest > 0 else -min(-rest, max(0, int(freq[at]) // 2))
        freq[at] += step
        rest -= step
        i += 1
    return freq


def encode_block(ids: np.ndarray, table: Table, lanes: int = LANES, step: int = STEP):
    """(lanes, payload, states, offsets, crcs): the coded ids and a checkpoint per segment."""
    n = len(ids)
    while lanes > 1 and lanes * 64 > max(n, 1):
        lanes //= 2  # a short block does not carry states for lanes that it hardly uses
    rows = -(-n // lanes)
    f, c = table.freq[ids], table.start[ids]
    state = np.full(lanes, LOW, np.uint64)
    words: list[np.ndarray] = []
    states, counts = {}, np.zeros(rows + 1, np.int64)
    shift = np.uint64(63 - SCALE_BITS)
    bits, half = np.uint64(SCALE_BITS), np.uint64(32)
    for r in range(rows - 1, -1, -1):
        fr, cr = f[r * lanes : (r + 1) * lanes], c[r * lanes : (r + 1) * lanes]
        x = state[: len(fr)]
        full = (x >> shift) >= fr
        out = x[full]
        words.append(out.astype(np.uint32))
        counts[r] = len(out)
        x[full] = out >> half
        q = x // fr
        state[: len(fr)] = (q << bits) + (x - q * fr) + cr
        if r % step == 0:
            states[r] = state.copy()
    payload = np.concatenate(words[::-1]) if words else np.zeros(0, np.uint32)
    before = np.concatenate([[0], np.cumsum(counts)])
    marks = sorted(states)
    crcs = [zlib.crc32(ids[r * lanes : (r + step) * lanes].astype("<u4").tobytes()) for r in marks]
    return (
        lanes,
        payload.astype("<u4").tobytes(),
        b"".join(states[r].astype("<u8").tobytes() for r in marks),
        [int(before[r]) for r in marks],
        crcs,
    )


def decode_segment(
    payload: np.ndarray, state: np.ndarray, offset: int, n: int, table: Table
) -> np.ndarray:
    """The `n` ids that follow a checkpoint (lane states and word offset)."""
    lanes = len(state)
    x, at = state.copy(), offset
    out = np.empty(n, np.uint32)
    mask, bits, half = np.uint64((1 << SCALE_BITS) - 1), np.uint64(SCALE_BITS), np.uint64(32)
    for i in range(0, n, lanes):
        live = x[: min(lanes, n - i)]
        slot = live & mask
        sym = table.slots[slot]
        out[i : i + len(live)] = sym
        live = table.freq[sym] * (live >> bits) + slot - table.start[sym]
        low = live < LOW
        m = int(np.count_nonzero(low))
        if m:
            live[low] = (live[low] << half) | payload[at : at + m]
            at += m
        x[: len(live)] = live
    return out


def decode_block(row: dict, table: Table, segment: int | None = None, step: int = STEP) -> np.ndarray:
    """Ids of a block row, or of one of its segments; raises ValueError if a checksum differs."""
    if zlib.crc32(row["payload"]) != row["payload_crc"]:
        raise ValueError(f"payload of block {row['part']}/{row['block']} is damaged")
    lanes, n = row["lanes"], row["n"]
    payload = np.frombuffer(row["payload"], "<u4").astype(np.uint64)
    states = np.frombuffer(row["states"], "<u8").astype(np.uint64).reshape(-1, lanes)
    wanted = range(len(states)) if segment is None else [segment]
    parts = []
    for j in wanted:
        length = min(n - j * step * lanes, step * lanes)
        ids = decode_segment(payload, states[j], row["offsets"][j], length, table)
        if zlib.crc32(ids.astype("<u4").tobytes()) != row["crcs"][j]:
            raise ValueError(f"segment {j} of block {row['part']}/{row['block']} is damaged")
        parts.append(ids)
    return np.concatenate(parts) if parts else np.zeros(0, np.uint32)


# ---- tables -------------------------------------------------------------------------------------

class ChunkEncoder:
    """Byte-level tokenizer of the tokenizers library, with memories of runs and pre-tokens.

    A pre-token of the byte-level pattern holds a space only at its beginning or within a run of
    white space, so a text may be cut before any space that follows another sign, and around a line
    break between other signs, and the ids of the runs concatenated. A new run is cut by the pattern,
    and the library's model merges each new pre-token. Runs with special tokens or signs of other
    scripts go to the library whole.
    """

    def __init__(self, path: str, width: int):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # Spark's tasks are the parallel unit
        from tokenizers import Tokenizer

        self.library = Tokenizer.from_file(path)
        self.library.no_truncation()
        self.library.no_padding()
        self.model, self.width = self.library.model, width
        special = [t.content for t in self.library.get_added_tokens_decoder().values()]
        self._whole = re.compile("|".join([UNUSUAL.pattern, *map(re.escape, special)]))
        self._after_space = Runs(self._of_later, CHUNKS)
        self._piece = self._after_space.ends = Memory(self._of_piece, PIECES)
        self._after_space.signs = "".join(c for c in _SIGNS if not any(c in s for s in special))
        self._break = self._of_piece("\n")
        self._by_line = not any("\n" in s for s in special)

    def _of_piece(self, piece: str) -> bytes:
        return packed([t.id for t in self.model.tokenize(in_letters(piece))], self.width)

    def _of_later(self, chunk: str) -> bytes:
        """Ids of a run that follows a space, with that space."""
        if _is_word(chunk):
            return self._of_piece(" " + chunk)  # the run itself is remembered
        if chunk[-1:].isspace() or not chunk:
            raise _NotApart
        return self._of_chunk(" " + chunk)

    def _of_chunk(self, chunk: str) -> bytes:
        if _is_word(chunk):
            return self._piece[chunk]
        if self._whole.search(chunk):
            return packed(self.library.encode(chunk, add_special_tokens=False).ids, self.width)
        return b"".join(map(self._piece.__getitem__, _PRE_TOKEN.findall(chunk)))

    def _of_line(self, line: str) -> bytes:
        head, *rest = line.split(" ")
        if head[-1:].isspace():
            raise _NotApart
        return self._of_chunk(head) + b"".join(map(self._after_space.__getitem__, rest))

    def _of_lines(self, text: str) -> bytes:
        first, *later = text.split("\n")
        if not all(later) or any(line[0].isspace() for line in later):
            raise _NotApart
        return self._break.join(map(self._of_line, [first, *later]))

    def encode(self, text: str) -> bytes:
        """Ids of a whole text as little-endian integers."""
        for cut in (self._of_lines, self._of_line) if self._by_line and "\n" in text else (self._of_line,):
            try:
                return cut(text)
            except _NotApart:
                pass
        return b"".join(map(self._of_chunk, _CUT.split(text)))


class _NotApart(Exception):
    """A run ends in white space, or is empty, so what follows it is no place to cut a text."""


def _is_word(run: str) -> bool:
    """Whether a run holds usual letters alone, and so is one pre-token."""
    return run.isalpha() and (run.isascii() or not UNUSUAL.search(run))


class Runs(Memory):
    """A memory of runs that looks up a run that ends in signs without them, and does not remember it.

    Signs after a usual letter or digit are one pre-token, up to the end of the run.
    """

    signs: str
    ends: Memory

    def __missing__(self, run: str) -> bytes:
        word = run.rstrip(self.signs)
        if word[-1:] in _USUAL and len(word) < len(run) and word:
            return self[word] + self.ends[run[len(word) :]]
        return super().__missing__(run)


#: Signs that often end a run.
_SIGNS = ".,!?;:&%$*#)"
_USUAL = frozenset(re.findall(f"[0-9{LETTERS}]", "".join(map(chr, range(0x2c70)))))
_CUT = re.compile(r"(?<=\S)(?= )")
# Fixed by the byte-level tokenizer, with the letters and digits of usual signs spelled out.
_PRE_TOKEN = re.compile(
    rf"'(?:s|t|re|ve|m|ll|d)| ?[{LETTERS}]+| ?[0-9]+| ?[^\s0-9{LETTERS}]+|\s+(?!\S)|\s+"
)
_encoders: dict[str, ChunkEncoder] = {}


def _encoder(path: str, width: int) -> ChunkEncoder:
    if path not in _encoders:
        _encoders[path] = ChunkEncoder(path, width)
    return _encoders[path]


def id_width(vocabulary: int) -> int:
    """Bytes in which an id is held before it is coded."""
    return 2 if vocabulary <= 1 << 16 else 4


def unpack(data: bytes, width: int) -> np.ndarray:
    return np.frombuffer(zstandard.decompress(data), f"<u{width}")


def tokenize(
    docs: DataFrame, path: str, end_id: int, vocabulary: int, doc_id: str = "doc_id", text: str = "text"
) -> DataFrame:
    """(doc_id, ids) with the ids of each whole text and `end_id`, packed (see `unpack`).

    A null text counts as empty and gives the end id alone.
    """
    width = id_width(vocabulary)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder, end = _encoder(path, width), packed([end_id], width)
        compress = zstandard.ZstdCompressor(level=3).compress
        for batch in batches:
            ids = [compress(encoder.encode(v.as_py() or "") + end) for v in batch.column(1)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(ids, pa.binary())], ["doc_id", "ids"])

    return docs.select(F.col(doc_id).cast("long"), F.col(text)).mapInArrow(run, "doc_id long, ids binary")


def count_ids(tokens: DataFrame, vocabulary: int) -> DataFrame:
    """(symbol, n) over all documents; each task sends one row per id that it met."""
    width = id_width(vocabulary)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(vocabulary, np.int64)
        held: list[np.ndarray] = []
        for batch in batches:
            for value in batch.column(0):
                held.append(unpack(value.as_py(), width))
                if len(held) == 500:
                    total += np.bincount(np.concatenate(held), minlength=vocabulary)
                    held = []
        if held:
            total += np.bincount(np.concatenate(held), minlength=vocabulary)
        at = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(at, pa.int64()), pa.array(total[at], pa.int64())], ["symbol", "n"])

    return tokens.select("ids").mapInArrow(run, "symbol long, n long").groupBy("symbol").agg(F.sum("n").alias("n"))


BLOCKS = T.StructType(
    [
        T.StructField("part", T.IntegerType()),
        T.StructField("block", T.IntegerType()),
        T.StructField("first", T.LongType()),
        T.StructField("n", T.IntegerType()),
        T.StructField("lanes", T.IntegerType()),
        T.StructField("payload", T.BinaryType()),
        T.StructField("payload_crc", T.LongType()),
        T.StructField("states", T.BinaryType()),
        T.StructField("offsets", T.ArrayType(T.IntegerType())),
        T.StructField("crcs", T.ArrayType(T.LongType())),
        T.StructField("first_doc", T.LongType()),
        T.StructField("doc_ids", T.ArrayType(T.LongType())),
        T.StructField("doc_lens", T.ArrayType(T.IntegerType())),
    ]
)
_ARROW = pa.schema(
    [
        ("part", pa.int32()), ("block", pa.int32()), ("first", pa.int64()), ("n", pa.int32()), ("lanes", pa.int32()),
        ("payload", pa.binary()), ("payload_crc", pa.int64()), ("states", pa.binary()), ("offsets", pa.list_(pa.int32())),
        ("crcs", pa.list_(pa.int64())), ("first_doc", pa.int64()), ("doc_ids", pa.list_(pa.int64())),
        ("doc_lens", pa.list_(pa.int32())),
    ]
)


def write_tokens(tokens: DataFrame, path: str, vocabulary: int, block: int = BLOCK) -> None:
    """Write (doc_id, ids) to `path`/blocks and `path`/table in ascending order of doc_id.

    Null ids come first; rows of the same id are ordered by their packed token ids. Documents are
    range-partitioned by id, so a part is a bounded range and a long document only fills more
    blocks. The frequency table has one entry per vocabulary id, whatever the size of the corpus.
    """
    spark = tokens.sparkSession
    counts = np.zeros(vocabulary, np.int64)
    for row in count_ids(tokens, vocabulary).collect():  # at most one row per vocabulary id
        counts[row.symbol] = row.n
    freq = frequencies(counts)
    spark.createDataFrame([(i, int(f)) for i, f in enumerate(freq)], "symbol long, freq long").coalesce(1).write.parquet(
        f"{path}/table"
    )
    sent = spark.sparkContext.broadcast(freq)
    width = id_width(vocabulary)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = Table(sent.value)
        held: list[np.ndarray] = []
        docs: list[tuple] = []  # (doc_id, ids of it in `held`)
        n, number, first, first_doc, part = 0, 0, 0, 0, 0

        def send(goes_on: bool) -> pa.RecordBatch:
            nonlocal held, docs, n, number, first, first_doc
            ids = np.concatenate(held) if held else np.zeros(0, np.uint32)
            lanes, payload, states, offsets, crcs = encode_block(ids, table)
            row = [
                part, number, first, len(ids), lanes, payload, zlib.crc32(payload), states, offsets, crcs,
                first_doc, [d for d, _ in docs], [k for _, k in docs],
            ]
            number, first = number + 1, first + len(ids)
            first_doc += len(docs) - goes_on
            held, docs, n = [], [], 0
            return pa.RecordBatch.from_arrays([pa.array([v], f.type) for v, f in zip(row, _ARROW)], schema=_ARROW)

        for batch in batches:
            for doc, value, at in zip(batch.column(0), batch.column(1), batch.column(2)):
                part, doc = at.as_py(), doc.as_py()
                ids = unpack(value.as_py(), width)
                while n + len(ids) >= block:
                    room = block - n
                    held.append(ids[:room])
                    docs.append((doc, room))
                    ids = ids[room:]
                    yield send(goes_on=len(ids) > 0)
                    if not len(ids):
                        break
                if len(ids):
                    held.append(ids)
                    docs.append((doc, len(ids)))
                    n += len(ids)
        if held:
            yield send(goes_on=False)

    laid = tokens.repartitionByRange("doc_id").sortWithinPartitions("doc_id", "ids")
    laid.withColumn("part", F.spark_partition_id()).mapInArrow(run, BLOCKS).write.option("compression", "zstd").parquet(
        f"{path}/blocks"
    )
    sent.unpersist()


def read_blocks(spark, path: str) -> DataFrame:
    return spark.read.schema(BLOCKS).parquet(f"{path}/blocks")


def read_table(spark, path: str) -> np.ndarray:
    rows = spark.read.schema("symbol long, freq long").parquet(f"{path}/table").orderBy("symbol").collect()
    return np.array([r.freq for r in rows], np.int64)


def read_pieces(spark, path: str) -> DataFrame:
    """(part, doc_no, block, doc_id, first, n, ids): decoded ids of each document by block.

    Both checksums of every block are verified; a damaged one raises.
    """
    return _decoded(spark, path, keep_ids=True)


def _decoded(spark, path: str, keep_ids: bool) -> DataFrame:
    sent = spark.sparkContext.broadcast(read_table(spark, path))
    out = "part int, doc_no long, block int, doc_id long, first long, n long, " + ("ids binary" if keep_ids else "crc long")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = Table(sent.value)
        for batch in batches:
            for i in range(batch.num_rows):
                row = batch.slice(i, 1).to_pylist()[0]
                raw = decode_block(row, table).astype("<u4").tobytes()
                k = len(row["doc_lens"])
                ends = np.cumsum(row["doc_lens"])
                starts = ends - row["doc_lens"]
                cuts = [raw[4 * a : 4 * b] for a, b in zip(starts, ends)]
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array([row["part"]] * k, pa.int32()),
                        pa.array(range(row["first_doc"], row["first_doc"] + k), pa.int64()),
                        pa.array([row["block"]] * k, pa.int32()),
                        pa.array(row["doc_ids"], pa.int64()),
                        pa.array(starts + row["first"], pa.int64()),
                        pa.array(row["doc_lens"], pa.int64()),
                        pa.array(cuts, pa.binary()) if keep_ids else pa.array(map(zlib.crc32, cuts), pa.int64()),
                    ],
                    names=["part", "doc_no", "block", "doc_id", "first", "n", "ids" if keep_ids else "crc"],
                )

    return read_blocks(spark, path).mapInArrow(run, out)


@F.arrow_udf(T.LongType())
def _joined_crc(pieces: pa.Array) -> pa.Array:
    """CRC-32 of concatenated pieces from the (block, n, crc) of each, in order.

    Appending data to a checksum equals appending as many zero bytes, up to two exclusive ors.
    """
    out = []
    for row in pieces.to_pylist():
        crc = row[0]["crc"]
        for piece in row[1:]:
            zeros = bytes(4 * piece["n"])
            crc = piece["crc"] ^ zlib.crc32(zeros, crc) ^ zlib.crc32(zeros)
        out.append(crc)
    return pa.array(out, pa.int64())


def token_report(spark, path: str) -> DataFrame:
    """doc_id, start, n_tokens, ids_crc32 of each document, from the files at `path`."""
    pieces = materialise(_decoded(spark, path, keep_ids=False))
    docs = pieces.groupBy("part", "doc_no").agg(
        F.first("doc_id").alias("doc_id"),
        F.min("first").alias("first"),
        F.sum("n").alias("n_tokens"),
        F.array_sort(F.collect_list(F.struct("block", "n", "crc"))).alias("pieces"),  # one per block it spans
    )
    sums = pieces.groupBy("part").agg(F.sum("n").alias("sum"))
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)  # one row per part
    sums = sums.select("part", F.coalesce(F.sum("sum").over(before), F.lit(0)).alias("base"))
    single = F.size("pieces") == 1
    crc = F.when(single, F.col("pieces")[0]["crc"]).otherwise(_joined_crc("pieces"))
    return docs.join(small_side(materialise(sums)), "part").select(
        "doc_id", (F.col("base") + F.col("first")).alias("start"), "n_tokens", crc.alias("ids_crc32")
    )
