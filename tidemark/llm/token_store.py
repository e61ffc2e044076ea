"""Operator 2: token ids in directly addressable codes, written in order of document and read back.

An id is split into chunks of eight bits. Level k holds chunk k of every id that has one, and a bitmap says which of them
go on to level k + 1; a directory of ranks, one for each RANK_BITS bits, finds their place there. Any token is read from a
few bytes, without decoding a block.

The files are Parquet files of segments: rows (part, segment, n_tokens, doc_ids, doc_tokens, codes) whose `codes` are the
levels of up to SEGMENT_TOKENS tokens. Spark's commit protocol writes them, so a lost executor leaves no half-written file.
Parts ascend with the ids of documents; `starts` gives the number of tokens before each segment by two sums, within a part
and over parts, of which there is one row each.

Texts are encoded as the library does by default: the string of a special token in a text becomes its id. Null and empty
texts have the end id only. Null ids come first. Rows with equal ids stay separate, in order of text. An
empty table gives no segments and an empty result. Further columns are not stored.
"""

from __future__ import annotations

import functools
import struct
import zlib
from collections.abc import Iterator

import numpy as np
import public_tokenizers
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tidemark.llm import _text
from tidemark.llm._encode import ChunkEncoder, cuts_before_white
from tidemark.llm._store import free_names, new_path, small_batches

TOKENIZER, END_ID = "byte_bpe_50k.json", 0
SEGMENT_TOKENS, RANK_BITS, CHUNK_BITS = 1 << 20, 512, 8
#: Tokens of a segment whose positions are read at once; below one position in so many tokens each is read by itself.
SLICE_TOKENS, FEW = 1 << 16, 64
MAGIC = b"DAC1"
SCHEMA = "part int, segment int, n_tokens long, doc_ids binary, doc_tokens binary, codes binary"


def pack(ids: np.ndarray) -> bytes:
    """The levels of some ids: each its length, chunks, bitmap of those that go on, and ranks."""
    rest, levels = ids.astype(np.uint32), []
    while True:
        more = rest >> np.uint32(CHUNK_BITS) > 0
        bits = np.packbits(more, bitorder="little").tobytes()
        sums = np.concatenate(([0], np.cumsum(more)))
        ranks = sums[: max(1, len(rest)) : RANK_BITS].astype("<u4")
        levels.append(struct.pack("<QII", len(rest), len(bits), len(ranks)) + (rest & np.uint32(255)).astype(np.uint8).tobytes() + bits + ranks.tobytes())
        rest = rest[more] >> np.uint32(CHUNK_BITS)
        if not len(rest):
            return MAGIC + struct.pack("<I", len(levels)) + b"".join(levels)


class Codes:
    """Reads what pack() wrote."""

    def __init__(self, block: bytes):
        if block[:4] != MAGIC:
            raise ValueError("not a block of directly addressable codes")
        (count,) = struct.unpack_from("<I", block, 4)
        at, self.levels = 8, []
        for _ in range(count):
            n, n_bits, n_ranks = struct.unpack_from("<QII", block, at)
            chunks = np.frombuffer(block, np.uint8, n, at + 16)
            bits = np.frombuffer(block, np.uint8, n_bits, at + 16 + n)
            ranks = np.frombuffer(block, "<u4", n_ranks, at + 16 + n + n_bits)
            self.levels.append((chunks, bits, ranks))
            at += 16 + n + n_bits + 4 * n_ranks

    def __len__(self) -> int:
        return len(self.levels[0][0])

    def __getitem__(self, i: int) -> int:
        """Token i: at each level one chunk, one bit and one rank."""
        if not 0 <= i < len(self):
            raise IndexError(i)
        out, shift = 0, 0
        for chunks, bits, ranks in self.levels:
            out |= int(chunks[i]) << shift
            if not bits[i >> 3] >> (i & 7) & 1:
                return out
            line = i // RANK_BITS * RANK_BITS
            within = np.unpackbits(bits[line >> 3 : (i >> 3) + 1], bitorder="little")[: i - line]
            i, shift = int(ranks[i // RANK_BITS]) + int(within.sum()), shift + CHUNK_BITS
        return out

    def all(self) -> np.ndarray:
        out = np.zeros(0, np.uint32)
        for chunks, bits, _ in reversed(self.levels):
            own = chunks.astype(np.uint32)
            if len(out):
                own[np.unpackbits(bits, count=len(chunks), bitorder="little").astype(bool)] |= out << np.uint32(CHUNK_BITS)
            out = own
        return out


@functools.lru_cache(maxsize=2)
def _encoder(name: str) -> ChunkEncoder:
    """One for each Python worker: what one task has learned serves the next."""
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(public_tokenizers.path(name))
    # A byte is one character of a byte-level piece.
    lengths = np.array([len(tokenizer.id_to_token(i) or "") for i in range(tokenizer.get_vocab_size())], np.int64)
    return ChunkEncoder(lambda texts: [x.ids for x in tokenizer.encode_batch_fast(texts, add_special_tokens=False)], cuts_before_white, lengths=lengths)


def write(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text", tokenizer: str = TOKENIZER, end_id: int = END_ID, segment_tokens: int = SEGMENT_TOKENS) -> None:
    """Encode the texts and write their segments under `path`, in ascending order of (integer) id."""
    small_batches(docs.sparkSession)

    def segments(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode, part, number = _encoder(tokenizer), TaskContext.get().partitionId(), 0
        for batch in batches:
            data, offsets = _text.text_buffers(batch.column(1))
            doc_ids = batch.column(0)
            for a, b in _text.slices(offsets):
                ids, counts = encode(data[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a])
                out = np.full(len(ids) + b - a, end_id, np.uint32)
                keep = np.ones(len(out), bool)
                keep[np.cumsum(counts + 1) - 1] = False
                out[keep] = ids
                ends = np.cumsum(counts + 1)
                first = 0
                while first < b - a:
                    before = int(ends[first - 1]) if first else 0
                    last = max(first + 1, int(np.searchsorted(ends, before + segment_tokens, "right")))
                    own = doc_ids.slice(a + first, last - first)
                    known = pa.array(own.is_valid()).to_numpy(zero_copy_only=False)
                    names = np.packbits(known, bitorder="little").tobytes() + own.cast(pa.int64()).fill_null(0).to_numpy().astype("<i8").tobytes()
                    rows = ([part], [number], [int(ends[last - 1]) - before], [names], [(counts[first:last] + 1).astype("<u4").tobytes()], [pack(out[before : int(ends[last - 1])])])
                    yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(rows, (pa.int32(), pa.int32(), pa.int64(), pa.binary(), pa.binary(), pa.binary()), strict=True)], [x.split()[0] for x in SCHEMA.split(", ")])
                    first, number = last, number + 1

    ordered = docs.select(id_col, text_col).repartitionByRange(F.col(id_col)).sortWithinPartitions(id_col, text_col)
    ordered.mapInArrow(segments, SCHEMA).write.parquet(path)


def starts(spark: SparkSession, path: str) -> DataFrame:
    """(part, segment, start): how many tokens come before each segment."""
    sizes = spark.read.schema(SCHEMA).parquet(path).select("part", "segment", "n_tokens")
    parts = sizes.groupBy("part").agg(F.sum("n_tokens").alias("words"))
    over = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)  # one row for each part of the file
    parts = parts.select("part", F.coalesce(F.sum("words").over(over), F.lit(0)).alias("before"))
    within = Window.partitionBy("part").orderBy("segment").rowsBetween(Window.unboundedPreceding, -1)
    return sizes.withColumn("within", F.coalesce(F.sum("n_tokens").over(within), F.lit(0))).join(parts, "part").select("part", "segment", (F.col("before") + F.col("within")).alias("start"))


def documents(spark: SparkSession, path: str, id_col: str = "doc_id") -> DataFrame:
    """Every document of the files: id, start, n_tokens, unsigned crc32 of its ids as little-endian 32-bit integers."""
    # The codes stay where they are read: only the small start column comes by a join.
    local = spark.read.schema(SCHEMA).parquet(path)

    def digests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part, segment, names, tokens, codes in zip(*(batch.column(k).to_pylist() for k in range(5)), strict=True):
                counts = np.frombuffer(tokens, "<u4").astype(np.int64)
                n_known = -(-len(counts) // 8)
                known = np.unpackbits(np.frombuffer(names, np.uint8, n_known), count=len(counts), bitorder="little").astype(bool)
                doc_ids = pa.array(np.frombuffer(names, "<i8", len(counts), n_known), mask=~known)
                ids = memoryview(Codes(codes).all().astype("<u4").tobytes())
                ends = np.cumsum(counts)
                sums = [zlib.crc32(ids[4 * (b - n) : 4 * b]) for b, n in zip(ends.tolist(), counts.tolist(), strict=True)]
                n = len(counts)
                yield pa.RecordBatch.from_arrays([pa.array(np.full(n, part), pa.int32()), pa.array(np.full(n, segment), pa.int32()), doc_ids, pa.array(ends - counts), pa.array(counts), pa.array(sums, pa.int64())], ["part", "segment", "id", "at", "n_tokens", "ids_crc32"])

    read = local.select("part", "segment", "doc_ids", "doc_tokens", "codes").mapInArrow(digests, "part int, segment int, id long, at long, n_tokens long, ids_crc32 long")
    start, n_tokens, crc = free_names([id_col], ["start", "n_tokens", "ids_crc32"])
    placed = read.join(starts(spark, path), ["part", "segment"])
    return placed.select(F.col("id").alias(id_col), (F.col("start") + F.col("at")).alias(start), F.col("n_tokens").alias(n_tokens), F.col("ids_crc32").alias(crc))


def tokens_at(spark: SparkSession, path: str, positions: DataFrame, col: str = "position") -> DataFrame:
    """(position, token) of global positions, a row for each that is asked: each is read from its segment alone. The segment is
    found by bins of SEGMENT_TOKENS positions, without its codes. These meet the distinct positions asked of SLICE_TOKENS of their
    tokens at once, so they move and are parsed once a slice, however many positions are asked."""
    store = spark.read.schema(SCHEMA).parquet(path)

    def bin_of(position: Column) -> Column:
        return F.floor(position / SEGMENT_TOKENS)

    places = store.select("part", "segment", "n_tokens").join(starts(spark, path), ["part", "segment"]).where(F.col("n_tokens") > 0)
    places = places.withColumn("bin", F.explode(F.sequence(bin_of(F.col("start")), bin_of(F.col("start") + F.col("n_tokens") - 1))))
    wanted = positions.select(F.col(col).cast("long").alias("position"))
    asked = wanted.distinct().withColumn("bin", bin_of(F.col("position")))
    found = asked.join(places, "bin").where(F.col("position").between(F.col("start"), F.col("start") + F.col("n_tokens") - 1))
    found = found.withColumn("at", F.col("position") - F.col("start")).withColumn("slice", F.floor(F.col("at") / SLICE_TOKENS))
    asked_of = found.groupBy("part", "segment", "start", "slice").agg(F.collect_list("at").alias("at"))
    met = asked_of.join(store.select("part", "segment", "codes"), ["part", "segment"])

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for start, at, block in zip(batch.column(0).to_pylist(), batch.column(1), batch.column(2), strict=True):
                places, codes = at.values.to_numpy(), Codes(block.as_py())
                few = len(places) * FEW < len(codes)
                tokens = np.array([codes[i] for i in places.tolist()], np.int64) if few else codes.all()[places].astype(np.int64)
                yield pa.RecordBatch.from_arrays([pa.array(places + start), pa.array(tokens)], ["position", "token"])

    answers = met.select("start", "at", "codes").mapInArrow(read, "position long, token long")
    return wanted.join(answers, "position").select("position", "token")


def query(spark, sf_dir: str) -> DataFrame:
    """op2: every document as the files give it back."""
    path = new_path(spark, "token-store")
    write(spark.read.parquet(f"{sf_dir}/documents.parquet"), path)
    return documents(spark, path)
