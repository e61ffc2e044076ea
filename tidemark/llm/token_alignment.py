"""Operator 13: alignment of two tokenizers' tokens.

Each document, a space before it, is encoded by a byte-level BPE (A) and by a SentencePiece model (B, which adds the space). Whole
Arrow batches, in slices of about a megabyte, stand one after another in one range of byte offsets. The ends of A's and B's
tokens are counted once over it; where both have one, the range is cut. Prefix sums of the cuts give every token's group, and
their differences at the documents' ends the numbers of each document.

A cut links the A token and the B token that end there. How often an id pair is linked is summed over the corpus in two steps, in
tasks and then by pair. Pairs with a COMMON-th of all links or more, COMMON pairs at most, and the highest count of each B id are
sent to the tasks, as their size is bounded; links of rarer pairs meet their counts in a join by pair, in which no pair is hot.

A null or empty text, and one whose tokens don't spell it (white space or marks that B's normaliser changes), has no tokens:
zeros and an empty digest. Strings of special tokens are plain text. Null ids stay; repeated rows are separate documents, and
their links count each time. An empty table gives an empty result. Other columns are not kept.
"""

from __future__ import annotations

import functools
from collections.abc import Iterator
from hashlib import sha256

import numpy as np
import public_tokenizers
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidemark.llm import _text, sentencepiece_codec
from tidemark.llm._encode import ChunkEncoder, cuts_before_white, gather
from tidemark.llm._store import keep, small_batches

A, B = "byte_bpe_50k.json", "piece_bpe_32k.model"
#: So many pairs are sent to all tasks at most.
COMMON = 400_000
#: Distinct pairs that a task sums before it passes them on.
HELD_PAIRS = 1_000_000


class Side:
    """One tokenizer: its encoder, the bytes of each id and each id in decimal, followed by `,`, `|` or `;`."""

    def __init__(self, encode, spelled: list[bytes]):
        if not all(spelled):
            raise ValueError("every token must have bytes")
        self.encode = encode
        self.size = len(spelled)
        self.counts = np.array([len(x) for x in spelled], np.int64)
        self.starts = np.cumsum(self.counts) - self.counts
        self.pool = np.frombuffer(b"".join(spelled), np.uint8)
        names = [f"{i}{mark}".encode() for i in range(self.size) for mark in ",|;"]
        self.name_counts = np.array([len(x) for x in names], np.int64)
        self.name_starts = np.cumsum(self.name_counts) - self.name_counts
        self.names = np.frombuffer(b"".join(names), np.uint8)


def byte_letters() -> dict[str, int]:
    """The letter of each byte in byte-level vocabularies: itself if it prints in Latin-1, else the next one from U+0100 on."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in plain]
    return {chr(b): b for b in plain} | {chr(256 + k): b for k, b in enumerate(rest)}


@functools.lru_cache(maxsize=2)
def side_a(name: str) -> Side:
    """One for each Python worker."""
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(public_tokenizers.path(name))
    tokenizer.encode_special_tokens = True
    letters = byte_letters()
    spelled = [bytes(letters[c] for c in tokenizer.id_to_token(i)) for i in range(tokenizer.get_vocab_size())]
    lengths = np.array([len(x) for x in spelled], np.int64)
    return Side(ChunkEncoder(lambda texts: [x.ids for x in tokenizer.encode_batch_fast(texts, add_special_tokens=False)], cuts_before_white, lengths=lengths), spelled)


@functools.lru_cache(maxsize=2)
def side_b(name: str) -> Side:
    model = sentencepiece_codec.load(name)
    spelled = [bytes([int(p[3:5], 16)]) if kind == sentencepiece_codec.BYTE else p.replace(sentencepiece_codec.MARK, " ").encode() for p, _, kind in model.pieces]
    return Side(sentencepiece_codec.worker_encoder(name, sentencepiece_codec.THREADS), spelled)


def _spells(side: Side, ids: np.ndarray, counts: np.ndarray, text: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """Which texts the bytes of their ids spell."""
    sums = np.concatenate(([0], np.cumsum(side.counts[ids])))
    edges = np.concatenate(([0], np.cumsum(counts)))
    good = np.diff(sums[edges]) == sizes
    some = np.repeat(good, counts)
    raw = gather(side.pool, side.starts[ids[some]], side.counts[ids[some]])
    wrong = np.flatnonzero(raw != text[np.repeat(good, sizes)])
    if len(wrong):
        good[np.flatnonzero(good)[np.searchsorted(np.cumsum(sizes[good]), wrong, "right")]] = False
    return good


def align(a: Side, b: Side, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, ...]:
    """Of texts without empty ones: which have tokens; of those with tokens n_a, n_b and n_groups; the groups as text, one after
    another, and where each text's end; the A and B ids of all links, and how many each text has."""
    sizes = np.diff(offsets) + 1
    text = np.insert(data, offsets[:-1], 32)
    ends = np.cumsum(sizes)
    (ids_a, n_a), (ids_b, n_b) = a.encode(text, np.concatenate(([0], ends))), b.encode(data, offsets)
    good = _spells(a, ids_a, n_a, text, sizes) & _spells(b, ids_b, n_b, text, sizes)
    ids_a, ids_b, n_a, n_b, sizes = ids_a[np.repeat(good, n_a)], ids_b[np.repeat(good, n_b)], n_a[good], n_b[good], sizes[good]
    total = int(sizes.sum())
    ends_a, ends_b = np.cumsum(a.counts[ids_a]), np.cumsum(b.counts[ids_b])
    cut = (np.bincount(ends_a, minlength=total + 1) > 0) & (np.bincount(ends_b, minlength=total + 1) > 0)
    before = np.cumsum(cut)
    n_groups = np.diff(before[np.concatenate(([0], np.cumsum(sizes)))])
    group_a, group_b = before[ends_a - 1], before[ends_b - 1]
    cuts = np.flatnonzero(cut)
    links_a, links_b = ids_a[np.searchsorted(ends_a, cuts)], ids_b[np.searchsorted(ends_b, cuts)]
    # A group's A tokens, then its B tokens: each goes behind all tokens of the groups before.
    of_a, of_b = np.bincount(group_a, minlength=len(cuts)), np.bincount(group_b, minlength=len(cuts))
    place_a = np.arange(len(ids_a)) + (np.cumsum(of_b) - of_b)[group_a]
    place_b = np.arange(len(ids_b)) + np.cumsum(of_a)[group_b]
    starts, counts = np.zeros((2, len(ids_a) + len(ids_b)), np.int64)
    mark_a = np.append(group_a[1:] != group_a[:-1], True)[: len(ids_a)].astype(np.int64)  # `|` after the last of a group
    mark_b = 2 * np.append(group_b[1:] != group_b[:-1], True)[: len(ids_b)].astype(np.int64)
    for side, ids, place, mark, shift in ((a, ids_a, place_a, mark_a, 0), (b, ids_b, place_b, mark_b, len(a.names))):
        at = ids.astype(np.int64) * 3 + mark
        starts[place], counts[place] = side.name_starts[at] + shift, side.name_counts[at]
    names = gather(np.concatenate((a.names, b.names)), starts, counts)
    sums = np.concatenate(([0], np.cumsum(counts)))
    return good, n_a, n_b, n_groups, names, sums[np.cumsum(n_a + n_b)], links_a, links_b, n_groups


def _pairs(codes: np.ndarray, n_links: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct codes of each text in order, how often it has each, and how many each text has."""
    doc = np.repeat(np.arange(len(n_links)), n_links)
    order = np.lexsort((codes, doc))
    codes, doc = codes[order], doc[order]
    new = np.ones(len(codes), bool)
    new[1:] = (codes[1:] != codes[:-1]) | (doc[1:] != doc[:-1])
    at = np.flatnonzero(new)
    return codes[at], np.diff(np.append(at, len(codes))), np.bincount(doc[at], minlength=len(n_links))


def encoded(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", a: str = A, b: str = B, groups: bool = False) -> DataFrame:
    """(row, id, n_a, n_b, n_groups, n_links, groups_sha256, pairs, times): a row for each document, with its distinct linked
    pairs (A id times B's size plus B id, as 64-bit integers) and how often it links each (32-bit); groups: their text too."""
    small_batches(docs.sparkSession)
    kind = docs.schema[id_col].dataType
    schema = T.StructType([T.StructField("id", kind)])
    for name in ("n_a", "n_b", "n_groups", "n_links"):
        schema.add(name, "long")
    schema.add("groups_sha256", "string").add("pairs", "binary").add("times", "binary")
    if groups:
        schema.add("groups", "string")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        one, two = side_a(a), side_b(b)
        for batch in batches:
            data, offsets = _text.text_buffers(batch.column(1))
            for lo, hi in _text.slices(offsets):
                full = np.flatnonzero(np.diff(offsets[lo : hi + 1]) > 0)
                numbers = np.zeros((4, hi - lo), np.int64)
                digests, pairs, times, texts = ([x] * (hi - lo) for x in ("", b"", b"", ""))
                if len(full):
                    own = np.append(offsets[lo:hi][full], offsets[hi]) - offsets[lo]
                    good, n_a, n_b, n_groups, names, ends, links_a, links_b, n_links = align(one, two, data[offsets[lo] : offsets[hi]], own)
                    at = full[good]
                    for k, x in enumerate((n_a, n_b, n_groups, n_links)):
                        numbers[k, at] = x
                    codes, often, each = _pairs(links_a.astype(np.int64) * two.size + links_b, n_links)
                    raw, raw_codes, raw_often = memoryview(names), codes.astype("<i8").tobytes(), often.astype("<u4").tobytes()
                    begin = np.concatenate(([0], ends[:-1])).tolist()
                    stop = np.cumsum(each).tolist()
                    for k, x, y, p, q in zip(at.tolist(), begin, ends.tolist(), [0, *stop[:-1]], stop, strict=True):
                        digests[k] = sha256(raw[x : y - 1]).hexdigest()
                        pairs[k], times[k] = raw_codes[8 * p : 8 * q], raw_often[4 * p : 4 * q]
                        if groups:
                            texts[k] = str(raw[x : y - 1], "ascii")
                columns = [batch.column(0).slice(lo, hi - lo), *[pa.array(x) for x in numbers], pa.array(digests), pa.array(pairs, pa.binary()), pa.array(times, pa.binary())]
                yield pa.RecordBatch.from_arrays([*columns, *([pa.array(texts)] if groups else [])], schema.names)

    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).mapInArrow(run, schema)
    return rows.select(F.monotonically_increasing_id().alias("row"), "*")


def _unpacked(batch: pa.RecordBatch, at: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Codes and times of all documents of a batch, and how many pairs each has."""
    pairs, times = batch.column(at).to_pylist(), batch.column(at + 1).to_pylist()
    return np.frombuffer(b"".join(pairs), "<i8"), np.frombuffer(b"".join(times), "<u4").astype(np.int64), np.array([len(x) // 8 for x in pairs], np.int64)


def _summed(codes: np.ndarray, times: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    order = np.argsort(codes, kind="stable")
    codes = codes[order]
    at = np.flatnonzero(np.append(True, codes[1:] != codes[:-1])[: len(codes)])
    return codes[at], np.add.reduceat(times[order], at) if len(at) else times


def pair_counts(table: DataFrame) -> DataFrame:
    """(pair, n): how many links of the corpus hold each pair. table: what encoded() gives, written."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codes, times = np.zeros(0, np.int64), np.zeros(0, np.int64)

        def out() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(codes, pa.int64()), pa.array(times, pa.int64())], ["pair", "n"])

        for batch in batches:
            own = _unpacked(batch, 0)
            codes, times = _summed(np.concatenate((codes, own[0])), np.concatenate((times, own[1])))
            if len(codes) > HELD_PAIRS:
                yield out()
                codes, times = codes[:0], times[:0]
        yield out()

    return table.select("pairs", "times").mapInArrow(run, "pair long, n long").groupBy("pair").agg(F.sum("n").alias("n"))


def scores(table: DataFrame, size_b: int, common: int = COMMON) -> DataFrame:
    """The rows of encoded(), written, without pairs, with n_best (links whose count is the highest of their B id) and
    count_sum (the counts of all links)."""
    spark = table.sparkSession
    every = keep(pair_counts(table), "pair-counts")
    best = every.groupBy((F.col("pair") % size_b).alias("b")).agg(F.max("n").alias("most"))
    counts = every.join(F.broadcast(best), F.col("pair") % size_b == F.col("b"))  # one row an id of B at most
    counts = keep(counts.select("pair", "n", (F.col("n") == F.col("most")).alias("is_best")), "pair-bests")
    total = counts.agg(F.sum("n")).first()[0] or 0
    bar = max(1, -(-total // common))
    top = counts.where(F.col("n") >= bar).toArrow().sort_by("pair")  # `common` rows at most
    known = spark.sparkContext.broadcast(tuple(top.column(k).to_numpy() for k in ("pair", "n", "is_best")))

    def met(batch: pa.RecordBatch, at: int) -> tuple[np.ndarray, ...]:
        codes, times, each = _unpacked(batch, at)
        pairs = known.value[0]
        place = np.minimum(np.searchsorted(pairs, codes), max(0, len(pairs) - 1))
        hit = pairs[place] == codes if len(pairs) else np.zeros(len(codes), bool)
        return codes, times, each, place, hit

    def partial(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        _, n, is_best = known.value
        for batch in batches:
            _, times, each, place, hit = met(batch, batch.num_columns - 2)
            edges = np.concatenate(([0], np.cumsum(each)))
            sums = np.zeros((2, len(times) + 1), np.int64)
            for k, x in enumerate((is_best.astype(np.int64), n)):
                if len(n):
                    np.cumsum(np.where(hit, times * x[place], 0), out=sums[k, 1:])
            found = [pa.array(np.diff(s[edges])) for s in sums]
            yield pa.RecordBatch.from_arrays([*batch.columns[:-2], *found], [*batch.schema.names[:-2], "n_best", "count_sum"])

    def rare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            codes, times, each, _, hit = met(batch, 1)
            rows = np.repeat(batch.column(0).to_numpy(), each)[~hit]
            yield pa.RecordBatch.from_arrays([pa.array(rows, pa.int64()), pa.array(codes[~hit], pa.int64()), pa.array(times[~hit], pa.int64())], ["row", "pair", "times"])

    kept = [c for c in table.columns if c not in ("pairs", "times")]
    schema = T.StructType([table.schema[c] for c in kept]).add("n_best", "long").add("count_sum", "long")
    docs = table.select(*kept, "pairs", "times").mapInArrow(partial, schema)
    if not counts.where(F.col("n") < bar).isEmpty():
        left = table.select("row", "pairs", "times").mapInArrow(rare, "row long, pair long, times long")
        hits = left.join(counts.where(F.col("n") < bar).hint("merge"), "pair")
        more = hits.groupBy("row").agg(F.sum(F.col("times") * F.col("is_best").cast("long")).alias("more_best"), F.sum(F.col("times") * F.col("n")).alias("more_sum"))
        docs = docs.join(more.hint("merge"), "row", "left").withColumn("n_best", F.col("n_best") + F.coalesce("more_best", F.lit(0))).withColumn("count_sum", F.col("count_sum") + F.coalesce("more_sum", F.lit(0)))
    return docs.select(*kept, "n_best", "count_sum")


def aligned(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", a: str = A, b: str = B, groups: bool = False, common: int = COMMON) -> DataFrame:
    """(id, n_a, n_b, n_groups, n_links, groups_sha256, n_best, count_sum) of each document; groups: their text as well."""
    table = keep(encoded(docs, id_col, text_col, a, b, groups), "token-alignment")
    out = scores(table, len(sentencepiece_codec.load(b).pieces), common)
    return out.select(F.col("id").alias(id_col), *[c for c in out.columns if c not in ("row", "id")])


def query(spark, sf_dir: str) -> DataFrame:
    """op13: every document's tokens, groups, links and their counts."""
    return aligned(spark.read.parquet(f"{sf_dir}/documents.parquet"))
