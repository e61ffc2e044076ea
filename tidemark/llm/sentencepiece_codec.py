"""Operator 6: SentencePiece encoding and decoding on the tokenizers library.

The model's protobuf is parsed here: pieces with scores and types, trainer and normaliser settings. From it the normaliser,
the metaspace marker, the unigram scores or the BPE merges, and the byte fallback are rebuilt as a tokenizers model. Batches
are encoded multithreaded; where no piece reaches over the start of a run of markers, distinct chunks are encoded once.
`parity` compares the result with the sentencepiece library for every document.

Null and empty texts have no ids and decode to an empty text. Repeated rows give repeated results; an empty table an empty
one. `encode` keeps the other columns; added columns get underscores if their names are taken.
"""

from __future__ import annotations

import functools
import os
import struct
import zlib
from collections.abc import Callable, Iterator
from dataclasses import dataclass, field

import numpy as np
import public_tokenizers
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from tidemark.llm import _text
from tidemark.llm._encode import ChunkEncoder, cuts_before_space, gather
from tidemark.llm._store import free_names, small_batches

MODEL, THREADS = "piece_bpe_32k.model", 2
MARK = "▁"
#: Fixed values of the format: types of pieces and of models.
NORMAL, UNKNOWN, CONTROL, USER_DEFINED, UNUSED, BYTE = 1, 2, 3, 4, 5, 6
UNIGRAM, BPE = 1, 2


def _fields(data: bytes) -> Iterator[tuple[int, int | bytes]]:
    """(number, value) of a protobuf message; varints as integers, the rest as bytes."""
    at = 0

    def varint() -> int:
        nonlocal at
        out = shift = 0
        while True:
            byte = data[at]
            at += 1
            out |= (byte & 127) << shift
            shift += 7
            if byte < 128:
                return out

    while at < len(data):
        tag = varint()
        kind = tag & 7
        if kind == 0:
            yield tag >> 3, varint()
        else:
            size = {1: 8, 5: 4}[kind] if kind in (1, 5) else varint()
            yield tag >> 3, data[at : at + size]
            at += size


@dataclass
class Model:
    pieces: list[tuple[str, float, int]] = field(default_factory=list)
    kind: int = UNIGRAM
    byte_fallback: bool = False
    charsmap: bytes = b""
    dummy_prefix: bool = True
    strip_spaces: bool = True
    escape_spaces: bool = True

    @classmethod
    def parse(cls, data: bytes) -> Model:
        out = cls()
        for number, value in _fields(data):
            if number == 1:
                own = dict(_fields(value))
                out.pieces.append((own[1].decode(), struct.unpack("<f", own[2])[0] if 2 in own else 0.0, own.get(3, NORMAL)))
            elif number == 2:
                own = dict(_fields(value))
                out.kind, out.byte_fallback = own.get(3, UNIGRAM), bool(own.get(35, 0))
                if own.get(24, 0):
                    raise ValueError("models with white space as a suffix aren't supported")
            elif number == 3:
                own = dict(_fields(value))
                out.charsmap = own.get(2, b"")
                out.dummy_prefix, out.strip_spaces, out.escape_spaces = (bool(own.get(k, 1)) for k in (3, 4, 5))
        return out

    @property
    def unknown(self) -> int:
        return next(i for i, (_, _, kind) in enumerate(self.pieces) if kind == UNKNOWN)

    def merges(self) -> list[tuple[str, str]]:
        """BPE: the pairs that make a piece, best score first."""
        scores = {piece: score for piece, score, kind in self.pieces if kind in (NORMAL, USER_DEFINED, UNUSED)}
        found = []
        for piece, score in scores.items():
            pairs = [(piece[:k], piece[k:]) for k in range(1, len(piece)) if piece[:k] in scores and piece[k:] in scores]
            found += [(-score, sorted((-scores[a], -scores[b])), a, b) for a, b in pairs]
        return [(a, b) for _, _, a, b in sorted(found)]

    @property
    def chunks_at_marks(self) -> bool:
        """No piece has a mark after another character, and the normaliser is nothing but the marker: then a run of marks
        begins a chunk of its own."""
        return self.kind == BPE and not self.charsmap and not self.strip_spaces and self.escape_spaces and not any(MARK in p.lstrip(MARK) for p, _, kind in self.pieces if kind in (NORMAL, USER_DEFINED)) and not any(kind == USER_DEFINED for _, _, kind in self.pieces)

    def tokenizer(self, prefix: bool = True):
        """The tokenizers backend; without the dummy prefix for chunks."""
        from tokenizers import Tokenizer, decoders, models, normalizers

        if any(kind == USER_DEFINED for _, _, kind in self.pieces):
            raise ValueError("user-defined pieces aren't supported")
        if self.kind == UNIGRAM:
            if not self.escape_spaces:
                raise ValueError("unigram models that keep spaces aren't supported")
            # Only normal pieces may match: the others get names with a space, which no normalised text holds. Bytes of
            # unknown characters are put in afterwards (with_bytes).
            backend = models.Unigram([(p, s) if kind == NORMAL else (f"{i} {p}", s) for i, (p, s, kind) in enumerate(self.pieces)], unk_id=self.unknown, byte_fallback=False)
        elif self.kind == BPE:
            backend = models.BPE({p: i for i, (p, _, _) in enumerate(self.pieces)}, self.merges(), unk_token=self.pieces[self.unknown][0], fuse_unk=True, byte_fallback=self.byte_fallback)
        else:
            raise ValueError("only unigram and BPE models are supported")
        steps = [normalizers.Precompiled(self.charsmap)] if self.charsmap else []
        if self.strip_spaces:
            from tokenizers import Regex

            steps += [normalizers.Strip(), normalizers.Replace(Regex(" {2,}"), " ")]
        if self.dummy_prefix and prefix:
            steps.append(normalizers.Prepend(" "))
        if self.escape_spaces:
            steps.append(normalizers.Replace(" ", MARK))
        out = Tokenizer(backend)
        out.normalizer = normalizers.Sequence(steps)
        out.decoder = decoders.Sequence([decoders.Replace(MARK, " "), decoders.ByteFallback(), decoders.Fuse(), *([decoders.Strip(" ", 1, 0)] if self.dummy_prefix else [])])
        return out


def load(name: str = MODEL) -> Model:
    with open(public_tokenizers.path(name), "rb") as f:
        return Model.parse(f.read())


@functools.lru_cache(maxsize=2)
def worker_encoder(name: str, threads: int) -> Callable[[np.ndarray, np.ndarray], tuple[np.ndarray, np.ndarray]]:
    """One for each Python worker: what one task has learned serves the next."""
    return encoder(load(name), threads)


def encoder(model: Model, threads: int = THREADS) -> Callable[[np.ndarray, np.ndarray], tuple[np.ndarray, np.ndarray]]:
    """Encodes text buffers to (ids of all texts, how many each text has)."""
    os.environ.setdefault("RAYON_NUM_THREADS", str(threads))
    os.environ.setdefault("TOKENIZERS_PARALLELISM", "true")
    if model.chunks_at_marks:
        backend = model.tokenizer(prefix=False)
        return ChunkEncoder(lambda chunks: [x.ids for x in backend.encode_batch_fast(chunks, add_special_tokens=False)], cuts_before_space, " " if model.dummy_prefix else "")
    backend = model.tokenizer()

    in_bytes = model.kind == UNIGRAM and model.byte_fallback
    of_byte = {int(p[3:5], 16): i for i, (p, _, kind) in enumerate(model.pieces) if kind == BYTE} if in_bytes else {}

    def with_bytes(found) -> list[int]:
        """The ids, and for an unknown run those of its bytes."""
        if model.unknown not in found.ids:
            return found.ids
        return [k for i, surface in zip(found.ids, found.tokens, strict=True) for k in ([of_byte[b] for b in surface.encode()] if i == model.unknown else [i])]

    def whole(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        view = memoryview(np.ascontiguousarray(data))
        code = backend.encode_batch if in_bytes else backend.encode_batch_fast  # the fast one keeps no surfaces
        found = code([str(view[a:b], "utf-8") for a, b in zip(offsets[:-1], offsets[1:], strict=True)], add_special_tokens=False)
        ids = [with_bytes(x) if in_bytes else x.ids for x in found]
        return np.fromiter((x for own in ids for x in own), np.uint32), np.fromiter(map(len, ids), np.int64, len(ids))

    return whole


class Decoder:
    """Bytes of ids by a table of the pieces' bytes; one marker space at the start of a text goes."""

    def __init__(self, model: Model):
        def spelled(piece: str, kind: int) -> bytes:
            if kind == BYTE:
                return bytes([int(piece[3:5], 16)])
            return b"" if kind == CONTROL else " ⁇ ".encode() if kind == UNKNOWN else piece.replace(MARK, " ").encode()

        table = [spelled(p, kind) for p, _, kind in model.pieces]
        self.counts = np.array([len(x) for x in table], np.int64)
        self.starts = np.cumsum(self.counts) - self.counts
        self.pool = np.frombuffer(b"".join(table), np.uint8)
        self.prefix = model.dummy_prefix

    def __call__(self, ids: np.ndarray) -> str:
        raw = gather(self.pool, self.starts[ids], self.counts[ids]).tobytes()
        return raw.removeprefix(b" ").decode("utf-8", "replace") if self.prefix else raw.decode("utf-8", "replace")


def encode(docs: DataFrame, text_col: str = "text", model: str = MODEL, threads: int = THREADS) -> DataFrame:
    """The documents with their ids as an array of integers (token_ids)."""
    small_batches(docs.sparkSession)
    (name,) = free_names(docs.columns, ["token_ids"])
    schema = T.StructType([*docs.schema.fields, T.StructField(name, T.ArrayType(T.IntegerType()))])
    at = docs.columns.index(text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        code = worker_encoder(model, threads)
        for batch in batches:
            ids, counts = code(*_text.text_buffers(batch.column(at)))
            lists = pa.ListArray.from_arrays(pa.array(np.concatenate(([0], np.cumsum(counts))), pa.int32()), pa.array(ids.astype(np.int32)))
            yield pa.RecordBatch.from_arrays([*batch.columns, lists], [*batch.schema.names, name])

    return docs.mapInArrow(run, schema)


def decode(docs: DataFrame, ids_col: str = "token_ids", model: str = MODEL) -> DataFrame:
    """The documents with the text of their ids (decoded); null ids give an empty text."""
    small_batches(docs.sparkSession)
    (name,) = free_names(docs.columns, ["decoded"])
    schema = T.StructType([*docs.schema.fields, T.StructField(name, T.StringType())])
    at = docs.columns.index(ids_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        read = Decoder(load(model))
        for batch in batches:
            column = batch.column(at)
            texts = [read(np.asarray(x.values.to_numpy(zero_copy_only=False), np.int64)) if x.is_valid else "" for x in column]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(texts, pa.string())], [*batch.schema.names, name])

    return docs.mapInArrow(run, schema)


def parity(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", model: str = MODEL) -> DataFrame:
    """(id, same_ids, same_text) against the sentencepiece library, for every document."""
    small_batches(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import sentencepiece

        parsed = load(model)
        code, read = encoder(parsed), Decoder(parsed)
        peer = sentencepiece.SentencePieceProcessor(model_file=public_tokenizers.path(model))
        for batch in batches:
            ids, counts = code(*_text.text_buffers(batch.column(1)))
            own = np.split(ids, np.cumsum(counts)[:-1])
            theirs = peer.encode([x or "" for x in batch.column(1).to_pylist()], num_threads=1)
            same = [a.tolist() == b for a, b in zip(own, theirs, strict=True)]
            text = [read(a) == peer.decode(b) for a, b in zip(own, theirs, strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(same), pa.array(text)], [id_col, "same_ids", "same_text"])

    return docs.select(id_col, text_col).mapInArrow(run, f"`{id_col}` {dict(docs.dtypes)[id_col]}, same_ids boolean, same_text boolean")


def digests(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", model: str = MODEL, threads: int = THREADS) -> DataFrame:
    """(id, n_tokens, ids_crc32, same_ids, round_trip) of each document: its ids are compared with those of the sentencepiece
    library, decoded and compared with its text."""
    small_batches(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import sentencepiece

        parsed = load(model)
        code, read = worker_encoder(model, threads), Decoder(parsed)
        peer = sentencepiece.SentencePieceProcessor(model_file=public_tokenizers.path(model))
        for batch in batches:
            data, offsets = _text.text_buffers(batch.column(1))
            view = memoryview(np.ascontiguousarray(data))
            sums, same, trips, all_counts = [], [], [], []
            for a, b in _text.slices(offsets):
                ids, counts = code(data[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a])
                texts = [str(view[offsets[k] : offsets[k + 1]], "utf-8") for k in range(a, b)]
                raw = memoryview(ids.astype("<u4").tobytes())
                ends = np.cumsum(counts)
                for end, n, text in zip(ends.tolist(), counts.tolist(), texts, strict=True):
                    own = ids[end - n : end]
                    sums.append(zlib.crc32(raw[4 * (end - n) : 4 * end]))
                    same.append(bool(np.array_equal(own, np.array(peer.encode(text), np.uint32))))
                    trips.append(read(own) == text)
                all_counts.append(counts)
            n_tokens = np.concatenate(all_counts) if all_counts else np.zeros(0, np.int64)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(n_tokens, pa.int64()), pa.array(sums, pa.int64()), pa.array(same, pa.bool_()), pa.array(trips, pa.bool_())], [id_col, "n_tokens", "ids_crc32", "same_ids", "round_trip"])

    return docs.select(id_col, text_col).mapInArrow(run, f"`{id_col}` {dict(docs.dtypes)[id_col]}, n_tokens long, ids_crc32 long, same_ids boolean, round_trip boolean")


def query(spark, sf_dir: str) -> DataFrame:
    """op6: every document's number of ids, their crc32, whether the sentencepiece library has the same ids, and whether they
    decode to the text."""
    return digests(spark.read.parquet(f"{sf_dir}/documents.parquet"))
