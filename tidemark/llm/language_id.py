"""Operator 3: language identification by string kernels.

The kernel of two texts is the number of n-grams (1 to SPECTRUM bytes of the lower-cased UTF-8 text) that both hold, divided
by the root of the product of their own numbers: a blended-spectrum presence kernel. N-grams are exact numbers, not hashes, so
that texts of any length stay apart. Landmarks are texts of the training sample; with the landmark kernel matrix K_mm and the
sample's K_nm the Nystroem form of kernel ridge regression, one column for each language against the rest, is
    (K_nm' K_nm + ridge n K_mm) weights = K_nm' Y.
A batch of texts becomes its distinct n-grams; those that landmarks hold are looked up and counted by landmark, and one
product with the weights scores the batch.

Fitting uses a sample of about SAMPLE labelled texts at most, or EACH_LEAST a language where that is more, evenly over all
languages, drawn by hash of the row over the whole table. The sample's n-grams stay in a written table; the n-grams of LANDMARKS texts and the sample's kernels with them (LANDMARKS
numbers a text) reach the driver. Scoring covers all rows and whole texts.

A null text or one without letters is `und` with score 0. Rows with a null language teach nothing. If no labelled row is
left, every text is `und`. Repeated rows give repeated results, ties go to the language first by code point, an empty table
gives an empty result, other columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.llm import _text
from tidemark.llm._encode import gather
from tidemark.llm._store import free_names, keep, small_batches

SPECTRUM = 4
#: An n-gram is SPECTRUM places of PLACE_BITS bits, each a byte plus 1, or 0 after its end; the text's number stands above.
PLACE_BITS = 9
GRAM_BITS = np.int64(SPECTRUM * PLACE_BITS)
#: Bounds of the fit: labelled texts over all languages, or so many of each if there are many languages; landmarks, or one of
#: each language.
SAMPLE, EACH_LEAST, LANDMARKS = 3000, 8, 256
RIDGE = 1e-4
UNKNOWN = "und"
#: Bytes of a text that are cut into n-grams at once, and pairs of n-gram and landmark that are counted at once.
PIECE_BYTES, PAIRS = 1 << 20, 1 << 20
#: Up to so many pairs of n-gram and language, the landmarks are summed to one weight for each before texts are scored.
SUMMED = 1 << 23

LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32


def windows(data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """The sorted distinct n-grams of SPECTRUM bytes of each text, shorter ones at its end, with the text's number above."""
    sizes = np.diff(offsets)
    row = np.repeat(np.arange(len(sizes), dtype=np.int64), sizes)
    padded = np.zeros(len(data) + (SPECTRUM - 1) * len(sizes), np.int64)
    at = np.arange(len(data)) + (SPECTRUM - 1) * row
    padded[at] = LOWER[data].astype(np.int64) + 1
    key = row
    for k in range(SPECTRUM):
        key = key << PLACE_BITS | padded[at + k]
    key = np.sort(key)
    new = np.ones(len(key), bool)
    new[1:] = key[1:] != key[:-1]
    return key[new]


def grams(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(row, gram): the distinct n-grams of 1 to SPECTRUM bytes of each text. Shorter ones are beginnings of the longest. A
    long text is cut into pieces that overlap, so that memory follows its distinct n-grams and not its length."""
    if len(offsets) == 2 and len(data) > PIECE_BYTES:
        longest = np.zeros(0, np.int64)
        for a in range(0, len(data), PIECE_BYTES):
            b = min(a + PIECE_BYTES + SPECTRUM - 1, len(data))
            own = windows(data[a:b], np.array([0, b - a]))
            # What is short because the piece ends is no end of the text.
            longest = np.union1d(longest, own if b == len(data) else own[own & ((1 << PLACE_BITS) - 1) > 0])
    else:
        longest = windows(data, offsets)
    found = []
    for n in range(SPECTRUM, 0, -1):
        shift = np.int64(PLACE_BITS * (SPECTRUM - n))
        key = longest >> shift
        new = np.ones(len(key), bool)
        new[1:] = key[1:] != key[:-1]
        found.append(key[new & (key & ((1 << PLACE_BITS) - 1) > 0)] << shift)
    every = np.concatenate(found)
    return every >> GRAM_BITS, every & ((np.int64(1) << GRAM_BITS) - 1)


def texts_grams(texts: pa.Array) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(texts, row, gram) of a column, in blocks of some documents."""
    data, offsets = _text.text_buffers(texts)
    for a, b in _text.slices(offsets, 1 << 20):
        yield b - a, *grams(data[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a])


class Landmarks:
    """The n-grams of the landmarks: of each the landmarks that hold it, held sparsely."""

    def __init__(self, held: list[np.ndarray]):
        self.sizes = np.array([len(x) for x in held], np.int64)
        self.grams, place = np.unique(np.concatenate(held), return_inverse=True)
        self.holders = np.repeat(np.arange(len(held), dtype=np.uint16), self.sizes)[np.argsort(place, kind="stable")]
        self.counts = np.bincount(place, minlength=len(self.grams))
        self.starts = np.cumsum(self.counts) - self.counts

    def places(self, gram: np.ndarray) -> np.ndarray:
        """Where the n-grams stand; those of no landmark have the place after the last."""
        place = np.minimum(np.searchsorted(self.grams, gram), len(self.grams) - 1)
        return np.where(self.grams[place] == gram, place, len(self.grams))

    def kernels(self, n: int, row: np.ndarray, gram: np.ndarray) -> np.ndarray:
        """(n, landmarks): the kernel of each text with each landmark."""
        m = len(self.sizes)
        place = self.places(gram)
        known = np.flatnonzero(place < len(self.grams))
        place, owner = place[known], row[known] * m
        ends = np.cumsum(self.counts[place])
        both, a = np.zeros(n * m, np.int64), 0
        while a < len(place):
            b = max(a + 1, int(np.searchsorted(ends, (ends[a - 1] if a else 0) + PAIRS, "right")))
            counts = self.counts[place[a:b]]
            both += np.bincount(np.repeat(owner[a:b], counts) + gather(self.holders, self.starts[place[a:b]], counts), minlength=n * m)
            a = b
        own = np.bincount(row, minlength=n)
        return both.reshape(n, m) / np.sqrt(np.maximum(own, 1)[:, None] * np.maximum(self.sizes, 1)[None, :])


@dataclass
class Model:
    languages: list[str]
    landmarks: Landmarks
    weights: np.ndarray

    def __post_init__(self):
        own, self.summed = self.landmarks, None
        if len(own.grams) * len(self.languages) <= SUMMED:
            of, each = np.repeat(np.arange(len(own.grams)), own.counts), self.weights / np.sqrt(np.maximum(own.sizes, 1))[:, None]
            # The last row is for n-grams that no landmark holds.
            self.summed = np.stack([np.bincount(of, weights=x[own.holders], minlength=len(own.grams) + 1) for x in each.T])

    def scores(self, n: int, row: np.ndarray, gram: np.ndarray) -> np.ndarray:
        if self.summed is None:
            return self.landmarks.kernels(n, row, gram) @ self.weights
        place = self.landmarks.places(gram)
        return np.stack([np.bincount(row, weights=x[place], minlength=n) for x in self.summed], 1) / np.sqrt(np.maximum(np.bincount(row, minlength=n), 1))[:, None]


def in_turn(labels: list[str], landmarks: int = LANDMARKS) -> np.ndarray:
    """The places of the landmarks, taken from the languages in turn."""
    languages = sorted(set(labels))
    codes = np.array([languages.index(v) for v in labels])
    turn = np.zeros(len(codes), np.int64)
    for k in range(len(languages)):
        turn[codes == k] = np.arange((codes == k).sum())
    return np.lexsort((codes, turn))[: max(landmarks, len(languages))]


def fit_arrays(k_nm: np.ndarray, labels: list[str], landmarks: Landmarks, k_mm: np.ndarray, ridge: float = RIDGE) -> Model:
    """The model of the sample's kernels with the landmarks."""
    languages = sorted(set(labels))
    target = (np.array([languages.index(v) for v in labels])[:, None] == np.arange(len(languages))).astype(float)
    left = k_nm.T @ k_nm + ridge * len(k_nm) * k_mm + 1e-8 * len(k_nm) * np.eye(len(k_mm))
    return Model(languages, landmarks, np.linalg.solve(left, k_nm.T @ target))


def fit(docs: DataFrame, teaches: Column, lang_col: str = "lang", text_col: str = "text", sample: int = SAMPLE) -> Model | None:
    """Fit on rows where `teaches` holds and language and text are there. The rows are counted by language first; a row is
    drawn if the hash of its text and id falls below its language's share."""
    spark = docs.sparkSession
    small_batches(spark)
    known = docs.where(teaches & F.col(lang_col).isNotNull() & (F.length(text_col) > 0))
    # Repeated rows are drawn once, so they count once, by their ids.
    n_of = F.greatest(F.count_distinct("doc_id"), F.lit(1)) if "doc_id" in docs.columns else F.count("*")
    counts = keep(known.groupBy(F.col(lang_col).alias("of")).agg(n_of.alias("n_of")), "languages")
    n_languages = counts.count()
    if not n_languages:
        return None
    each = max(sample / n_languages, EACH_LEAST)
    shares = counts.select("of", F.least(F.lit(1.0), F.lit(each) / F.col("n_of")).alias("share"))
    drawn = known.join(shares, F.col(lang_col) == F.col("of"))
    # The hash must not run with the rows' order: equal texts are drawn apart by their id.
    unit = F.pmod(F.xxhash64(F.lit("sample"), *[F.col(c) for c in ("doc_id", text_col) if c in docs.columns]), F.lit(1 << 30)) / float(1 << 30)

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[tuple] = set()
        for batch in batches:
            for k, key in enumerate(zip(batch.column(2).to_pylist(), batch.column(0).to_pylist(), strict=True)):
                if key in seen:
                    continue
                seen.add(key)
                (_, _, held), *_ = texts_grams(batch.column(1).slice(k, 1))
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(k, 1), pa.array([np.sort(held).tobytes()], pa.binary()), batch.column(2).slice(k, 1)], ["lang", "grams", "unit"])

    packed = drawn.withColumn("unit", unit).where(F.col("unit") < F.col("share")).select(lang_col, text_col, "unit").mapInArrow(pack, "lang string, grams binary, unit double")
    found, bound = keep(packed.withColumn("mark", F.xxhash64("grams")).dropDuplicates(["unit", "lang", "mark"]), "language-sample"), int(2 * each * n_languages) + 1000
    rows = found.select("unit", "lang", "mark").orderBy("unit", "lang", "mark").limit(bound).collect()
    if not rows:
        return None
    marks = [rows[k][2] for k in in_turn([r[1] for r in rows])]
    held = {r[0]: np.frombuffer(r[1], np.int64) for r in found.where(F.col("mark").isin(marks)).groupBy("mark").agg(F.first("grams")).collect()}  # a row a landmark
    landmarks = Landmarks([held[x] for x in marks])
    k_mm = np.concatenate([landmarks.kernels(1, np.zeros(len(held[x]), np.int64), held[x]) for x in marks])
    shared = spark.sparkContext.broadcast(landmarks)

    def measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            own = [np.frombuffer(x.as_buffer(), np.int64) for x in batch.column(1)]
            values = [shared.value.kernels(1, np.zeros(len(x), np.int64), x).tobytes() for x in own]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(values, pa.binary()), batch.column(2)], ["lang", "kernels", "unit"])

    some = found.where(F.col("unit") <= rows[-1][0])  # as many as `rows`
    got = sorted(some.select("lang", "grams", "unit").mapInArrow(measure, "lang string, kernels binary, unit double").collect(), key=lambda r: (r[2], r[0], r[1]))
    return fit_arrays(np.stack([np.frombuffer(r[1]) for r in got]), [r[0] for r in got], landmarks, k_mm)


def predict(docs: DataFrame, model: Model | None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, lang_pred, score): the language of the largest score, cut to 0 and 1."""
    small_batches(docs.sparkSession)
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = shared.value
        for batch in batches:
            texts = batch.column(1)
            readable = np.array([bool(x) and any(map(str.isalpha, x)) for x in texts.to_pylist()], bool)
            best, score = np.zeros(len(texts), np.int64), np.zeros(len(texts))
            at = 0
            for n, row, gram in texts_grams(texts) if own else ():
                values = own.scores(n, row, gram)
                best[at : at + n], score[at : at + n] = values.argmax(1), values.max(1)
                at += n
            readable &= own is not None
            names = [own.languages[k] if r else UNKNOWN for k, r in zip(best.tolist(), readable.tolist(), strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(names, pa.string()), pa.array(np.where(readable, np.clip(score, 0, 1), 0.0))], [id_col, *added])

    added = free_names([id_col], ["lang_pred", "score"])
    return docs.select(id_col, text_col).mapInArrow(run, f"`{id_col}` {dict(docs.dtypes)[id_col]}, {added[0]} string, {added[1]} double")


def query(spark, sf_dir: str) -> DataFrame:
    """op3: the language of every document; documents whose crc32(doc_id) mod 4 is 2 are held out."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    held_out = F.coalesce(F.crc32(F.col("doc_id").cast("string")) % 4 == 2, F.lit(False))
    model = fit(docs, ~held_out)
    return predict(docs, model).select("doc_id", held_out.alias("held_out"), "lang_pred", "score")
