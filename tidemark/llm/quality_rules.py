"""Operator 5: quality rules on zstandard compression bands, with base counts.

A text is rejected if it is repetitive (compresses too well) or incompressible (noise, encoded data). The ratio of the whole
text must lie within limits that depend on its length, and at most MAX_BAD_CHUNKS of its fixed chunks may leave theirs, so
that a bad stretch within a long text counts too. Base rules run first.

Null and empty texts have counts of 0 and fail the base rules. Repeated rows give repeated results. Other columns pass
through `filter_documents` unchanged; `signals` returns the counts only.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm import _text
from tidemark.llm._store import free_names, small_batches

LEVEL = 3
#: Fixed values: (bytes at least, lowest ratio, highest ratio) of whole texts. Short texts compress less.
WHOLE_LIMITS = [(0, 0.35, 1.20), (256, 0.35, 0.90), (512, 0.32, 0.85), (1024, 0.30, 0.78), (2048, 0.28, 0.72), (4096, 0.25, 0.68), (8192, 0.23, 0.66), (32768, 0.21, 0.64)]
#: Fixed chunks of so many bytes, the last one if it has CHUNK_LEAST; limits of a chunk's ratio; share that may leave them.
CHUNK, CHUNK_LEAST, CHUNK_LIMITS, MAX_BAD_CHUNKS = 4096, 1024, (0.22, 0.72), 0.3
MIN_WORDS, MAX_REPEAT_PERCENT = 50, 50

SYMBOLS = np.zeros(256, bool)
SYMBOLS[list(b"#*$%&|<>")] = True
COUNTS = "n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long"
SCHEMA = f"{COUNTS}, ratio double, bad_chunks double, base_failed boolean, kept boolean"


def _per_document(flags: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """How many of the flags between one offset and the next are set."""
    sums = np.zeros(len(flags) + 1, np.int64)
    np.cumsum(flags, out=sums[1:])
    return sums[offsets[1:]] - sums[offsets[:-1]]


def _repeated(keys: np.ndarray) -> np.ndarray:
    """Which of the keys occur twice or more."""
    order = np.argsort(keys)
    same = keys[order[1:]] == keys[order[:-1]]
    out = np.zeros(len(keys), bool)
    out[order[1:]] |= same
    out[order[:-1]] |= same
    return out


def _counts(data: np.ndarray, offsets: np.ndarray) -> list[np.ndarray]:
    starts, ends, first = _text.word_spans(data, offsets)
    n_words = np.diff(first)
    word_chars = _per_document(~_text.WHITE[data] & ((data & 0xC0) != 0x80), offsets)
    n_symbols = _per_document(SYMBOLS[data], offsets)

    cuts = np.flatnonzero(data == 10)
    line_starts = np.unique(np.concatenate((offsets[:-1], cuts + 1)))
    # An empty text has no line of its own here, and an empty line no word: neither counts.
    line_starts = line_starts[line_starts < len(data)]
    owner = np.searchsorted(offsets, line_starts, "right") - 1
    line_ends = np.minimum(np.append(cuts, len(data))[np.searchsorted(cuts, line_starts)], offsets[owner + 1])
    has_word = np.searchsorted(starts, line_ends) > np.searchsorted(starts, line_starts)
    line_starts, line_ends, owner = line_starts[has_word], line_ends[has_word], owner[has_word]
    keys = _text.span_hashes(data, line_starts, line_ends) + _text.mix(owner.astype(np.uint64) + np.uint64(1))
    _, firsts = np.unique(keys, return_index=True)
    n_dup_lines = np.bincount(owner, minlength=len(n_words)) - np.bincount(owner[firsts], minlength=len(n_words))

    words = _text.span_hashes(data, starts, ends)
    owner = np.repeat(np.arange(len(n_words)), n_words)
    within = np.zeros(len(words), bool)
    windows = _text.shingle_hashes(words, 3)
    if len(windows):
        inside = owner[2:] == owner[:-2]
        windows += _text.mix(owner[: len(windows)].astype(np.uint64) + np.uint64(1))
        twice = np.zeros(len(windows), bool)
        twice[inside] = _repeated(windows[inside])
        for k in range(3):
            within[k : k + len(windows)] |= twice
    return [n_words, word_chars, n_symbols, n_dup_lines, _per_document(within, first)]


def compression(text: bytes | memoryview, compressor: zstandard.ZstdCompressor) -> tuple[float, float]:
    """The ratio of compressed to plain bytes of the whole text, and the share of its chunks outside their limits."""
    n = len(text)
    if not n:
        return 0.0, 0.0
    ratio = len(compressor.compress(text)) / n
    chunks = [text[i : i + CHUNK] for i in range(0, n, CHUNK) if n - i >= CHUNK_LEAST] if n > CHUNK else []
    low, high = CHUNK_LIMITS
    bad = sum(not low <= len(compressor.compress(x)) / len(x) <= high for x in chunks)
    return ratio, bad / max(1, len(chunks))


def within_bands(n_bytes: int, ratio: float, bad_chunks: float) -> bool:
    """The verdict of the method."""
    low, high = next((low, high) for least, low, high in reversed(WHOLE_LIMITS) if n_bytes >= least)
    return low <= ratio <= high and bad_chunks <= MAX_BAD_CHUNKS


def _batch(texts: pa.Array) -> dict[str, np.ndarray]:
    data, offsets = _text.text_buffers(texts)
    parts = [_counts(data[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a]) for a, b in _text.slices(offsets)]
    n_words, word_chars, n_symbols, n_dup_lines, n_repeat = (np.concatenate(x) for x in zip(*parts, strict=True)) if parts else [np.zeros(0, np.int64)] * 5
    base_failed = (n_words < MIN_WORDS) | (100 * n_repeat > MAX_REPEAT_PERCENT * n_words)
    compressor, view = zstandard.ZstdCompressor(level=LEVEL, write_content_size=False), memoryview(np.ascontiguousarray(data))
    measured = [compression(view[a:b], compressor) for a, b in zip(offsets[:-1], offsets[1:], strict=True)]
    ratio, bad = (np.array([x[k] for x in measured], float) for k in (0, 1))
    kept = [not failed and within_bands(n, r, b) for failed, n, r, b in zip(base_failed, np.diff(offsets), ratio, bad, strict=True)]
    return {"n_words": n_words, "word_chars": word_chars, "n_symbols": n_symbols, "n_dup_lines": n_dup_lines, "n_repeat_words": n_repeat, "ratio": ratio, "bad_chunks": bad, "base_failed": base_failed, "kept": np.array(kept, bool)}


def _types(schema: str) -> dict[str, pa.DataType]:
    kinds = {"long": pa.int64(), "double": pa.float64(), "boolean": pa.bool_()}
    return {name: kinds[kind] for name, kind in (x.split() for x in schema.split(", "))}


def signals(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row for each document: its id, the counts, the ratios and the verdicts. These get underscores if the id has such a
    name."""
    small_batches(docs.sparkSession)
    types = _types(SCHEMA)
    names = free_names([id_col], list(types))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = _batch(batch.column(1))
            yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(out[k], t) for k, t in types.items())], [id_col, *names])

    kind = dict(docs.dtypes)[id_col]
    kinds = [x.split()[1] for x in SCHEMA.split(", ")]
    return docs.select(id_col, text_col).mapInArrow(run, ", ".join(f"`{n}` {k}" for n, k in zip([id_col, *names], [kind, *kinds], strict=True)))


def filter_documents(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """The documents that pass, with all their columns: one pass, without a join."""
    small_batches(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            kept = _batch(batch.column(batch.schema.get_field_index(text_col)))["kept"]
            yield batch.filter(pa.array(kept))

    return docs.mapInArrow(run, docs.schema)


def query(spark, sf_dir: str) -> DataFrame:
    """op5: every document of the table with its counts and verdicts."""
    out = signals(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    return out.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", F.round("ratio", 6).alias("ratio"), "base_failed", "kept")
