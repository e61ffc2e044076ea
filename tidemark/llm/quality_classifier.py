"""Operator 7: quality classifier, naive Bayes support vectors.

Features are indicators of n-grams: runs of 1 to SPECTRUM bytes, words and pairs of words, hashed to FEATURES places. Each is
scaled by its log-count ratio r = log((p / |p|) / (q / |q|)), p and q being the smoothed numbers of good and bad labelled
texts that hold it; these counts cover every labelled text and are summed where the texts are read. A linear hinge-loss model
on the scaled, length-normalised indicators is fitted by dual coordinate descent on about SAMPLE labelled texts at most with
indices of SAMPLE_BYTES, as many of either class as there are, drawn by hash over the whole table. A logistic curve over the margins, weighted to the classes'
shares in all labelled texts, turns a margin into a score from 0 to 1.

Null and empty texts hold no n-gram and get the score of margin `bias`. Labels that are null, and labels without a document,
teach nothing; of repeated labels each counts. Without labels of both classes the score is the share of good labels, or 0.5.
Repeated rows give repeated results; an empty table an empty one; other columns are not read.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm import _text
from tidemark.llm._store import free_names, keep, small_batches

#: So many places that texts of megabytes don't fill them.
FEATURES, SPECTRUM = 1 << 20, 4
#: Bounds of the fit: labelled texts, and the bytes of their indices, which reach the driver.
SAMPLE, SAMPLE_BYTES = 3000, 64 << 20
EPOCHS, COST, SMOOTHING = 8, 1.0, 1.0
THRESHOLD = 0.3
#: Pairs of equal words are n-grams of their own, whatever the word: indicators of so many of them.
REPEATS, REPEAT_PLACES = (1, 2, 4, 8, 16), (FEATURES - 5, FEATURES - 4, FEATURES - 3, FEATURES - 2, FEATURES - 1)
#: Counts travel to the driver in chunks of so many places, and are summed in rounds of SUM_ROWS parts.
COUNT_CHUNK, SUM_ROWS = 1 << 14, 64


def indicators(texts: pa.Array) -> Iterator[np.ndarray]:
    """Of each text the sorted numbers of the features that it holds."""
    data, offsets = _text.text_buffers(texts)
    shift = np.uint64(64 - FEATURES.bit_length() + 1)
    held = np.zeros(FEATURES, bool)
    for a, b in _text.slices(offsets, 1 << 18):
        part, at = data[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a]
        places, key = [], np.zeros(len(part), np.uint32)
        for n in range(1, SPECTRUM + 1):
            key = key[: max(0, len(part) - n + 1)] * np.uint32(257) + part[n - 1 :] + np.uint32(1)
            places.append((key ^ (key >> np.uint32(15))) * np.uint32(0x85EBCA6B) >> np.uint32(shift - np.uint64(32)))
        starts, ends, first = _text.word_spans(part, at)
        words = _text.span_hashes(part, starts, ends)
        pairs = _text.shingle_hashes(words, 2)
        again = words[1:] == words[:-1]
        word_places, pair_places = (words >> shift).astype(np.uint32), (pairs >> shift).astype(np.uint32)
        for k in range(b - a):
            x, y, u, v = int(at[k]), int(at[k + 1]), int(first[k]), int(first[k + 1])
            own = [p[x : max(x, y - n)] for n, p in enumerate(places)]
            own += [word_places[u:v], pair_places[u : max(u, v - 1)]]
            repeats = int(again[u : max(u, v - 1)].sum())
            own.append(np.array([place for least, place in zip(REPEATS, REPEAT_PLACES, strict=True) if repeats >= least], np.uint32))
            own = np.concatenate(own)
            # Few places are sorted; many are marked in the whole space.
            if len(own) < 1 << 15:
                own.sort()
                new = np.ones(len(own), bool)
                new[1:] = own[1:] != own[:-1]
                yield own[new]
            else:
                held[own] = True
                found = np.flatnonzero(held)
                held[found] = False
                yield found


@dataclass
class Model:
    weights: np.ndarray
    bias: float
    slope: float
    offset: float

    def score(self, held: np.ndarray, ratios: np.ndarray) -> float:
        return float(1 / (1 + np.exp(-np.clip(self.slope * self.margin(held, ratios) + self.offset, -40, 40))))

    def margin(self, held: np.ndarray, ratios: np.ndarray) -> float:
        own = ratios[held].astype(np.float64)
        return float(self.weights[held] @ own / max(1e-12, np.sqrt(own @ own)) + self.bias) if len(held) else self.bias


def log_count_ratios(good: np.ndarray, bad: np.ndarray) -> np.ndarray:
    p, q = good + SMOOTHING, bad + SMOOTHING
    return np.log(p / p.sum()) - np.log(q / q.sum())


def fit_arrays(held: list[np.ndarray], labels: np.ndarray, ratios: np.ndarray, share: float, cost: float = COST, epochs: int = EPOCHS, seed: int = 7, times: np.ndarray | None = None) -> Model:
    """Dual coordinate descent: each step solves the hinge loss of one text exactly; then the logistic curve of margins.
    share: that of good labels among all; times: how many rows each text stands for."""
    times = np.ones(len(held)) if times is None else times.astype(float)
    weights, bias, alpha = np.zeros(len(ratios)), 0.0, np.zeros(len(held))
    rows = []
    for x in held:
        own = ratios[x]
        rows.append(own / max(1e-12, np.sqrt(own @ own)))
    sign, order = np.where(labels > 0, 1.0, -1.0), np.random.Generator(np.random.PCG64(seed))
    for _ in range(epochs):
        for i in order.permutation(len(held)):
            x, v = held[i], rows[i]
            slack = sign[i] * (weights[x] @ v + bias) - 1
            new = min(max(alpha[i] - slack / 2.0, 0.0), cost * times[i])  # |x|^2 = 1, and 1 for the bias
            step = (new - alpha[i]) * sign[i]
            if step:
                weights[x] += step * v
                bias += step
                alpha[i] = new
    margins = np.array([weights[x] @ v + bias for x, v in zip(held, rows, strict=True)])
    n_good, n_bad = max(1.0, times[labels > 0].sum()), max(1.0, times[labels <= 0].sum())
    weight = np.where(labels > 0, share / n_good, (1 - share) / n_bad) * times.sum() * times
    target = np.where(labels > 0, (n_good + 1) / (n_good + 2), 1 / (n_bad + 2))
    a, b = 1.0, 0.0
    for _ in range(50):  # Newton's steps
        p = 1 / (1 + np.exp(-np.clip(a * margins + b, -40, 40)))
        g = weight * (p - target)
        h = weight * np.maximum(p * (1 - p), 1e-9)
        grad = np.array([g @ margins, g.sum()]) + 1e-3 * np.array([a, b])
        hess = np.array([[h @ margins**2, h @ margins], [h @ margins, h.sum()]]) + 1e-3 * np.eye(2)
        step = np.linalg.solve(hess, grad)
        a, b = a - step[0], b - step[1]
        if np.abs(step).max() < 1e-8:
            break
    return Model(weights, bias, max(a, 1e-3), b)


def fit(labelled: DataFrame, text_col: str = "text", label_col: str = "quality", id_col: str = "doc_id", sample: int = SAMPLE) -> tuple[Model | float, np.ndarray]:
    """The model and the ratios from rows of text and label; a plain share where there are not both classes."""
    known = labelled.where(F.col(label_col).isNotNull()).select(F.col(id_col).alias("id"), F.col(text_col).alias("text"), (F.col(label_col) > 0).cast("int").alias("label"))
    # Rows by label, and how many different ids they have: repeated rows are drawn once, with their number.
    numbers = {r[0]: r[1:] for r in known.groupBy("label", "id").agg(F.count("*").alias("n")).groupBy("label").agg(F.sum("n"), F.count("*")).collect()}
    (good, good_ids), (bad, bad_ids) = (numbers.get(k, (0, 0)) for k in (1, 0))
    if not good or not bad:
        return (good / (good + bad) if good + bad else 0.5), np.zeros(FEATURES)

    share = [min(1.0, sample / 2 / bad_ids), min(1.0, sample / 2 / good_ids)]
    mark = F.xxhash64(F.lit("sample"), "id", "text")
    schema = "chunk long, part long, counts binary, label int, held binary, unit double, mark long, times long"

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        # One pass over the texts: the counts of the task's texts, and the features of the texts that are drawn.
        sums, part = np.zeros((FEATURES, 2), np.int64), TaskContext.get().partitionId()
        again: dict[tuple, int] = {}
        for batch in batches:
            drawn: list[tuple] = []
            for label, mark, held in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist(), indicators(batch.column(0)), strict=True):
                sums[held, label] += 1
                at = (mark % (1 << 30)) / (1 << 30)
                if at < share[label]:
                    key = (label, at, mark)
                    if key in again:
                        again[key] += 1
                    else:
                        again[key] = 0
                        drawn.append((None, None, None, label, held.astype("<u4").tobytes(), at, mark, 1))
            yield _rows(drawn, schema)
        yield _rows([(None, None, None, *key[:1], None, *key[1:], n) for key, n in again.items() if n], schema)
        for a in range(0, FEATURES, COUNT_CHUNK):
            if sums[a : a + COUNT_CHUNK].any():
                yield _rows([(a, part, _packed(sums[a : a + COUNT_CHUNK]), *[None] * 5)], schema)

    def add(pdf: pd.DataFrame) -> pd.DataFrame:
        total = sum(_unpacked(x) for x in pdf["counts"])
        return pd.DataFrame({"chunk": [int(pdf["chunk"].iloc[0])], "part": [int(pdf["part"].iloc[0])], "counts": [_packed(total)]})

    found = keep(known.select("text", "label", mark.alias("mark")).mapInArrow(read, schema), "label-features")
    sums = found.where(F.col("chunk").isNotNull()).select("chunk", "part", "counts")
    n_parts = 1 + (sums.agg(F.max("part")).first()[0] or 0)
    while True:
        sums = sums.withColumn("part", F.floor(F.col("part") / SUM_ROWS)).groupBy("chunk", "part").applyInPandas(add, "chunk long, part long, counts binary")
        n_parts = -(-n_parts // SUM_ROWS)
        if n_parts == 1:
            break
    counts = np.zeros((FEATURES, 2))
    for chunk, _, some in sums.toLocalIterator():  # of fixed size
        counts[chunk : chunk + COUNT_CHUNK] = _unpacked(some)
    ratios = log_count_ratios(counts[:, 1], counts[:, 0])
    # Each task has a drawn text once; here it is one row again.
    held = keep(found.where(F.col("label").isNotNull()).groupBy("unit", "label", "mark").agg(F.max("held").alias("held"), F.sum("times").alias("times")), "label-sample")
    sizes = held.select("unit", "label", F.length("held").alias("n")).orderBy("unit", "label", "mark").limit(2 * sample + 1000).collect()
    # Texts in order of the draw, as long as their indices stay within the bound.
    room = np.cumsum([r[2] for r in sizes]) <= SAMPLE_BYTES
    room[: 1] = True
    last = {k: max((r[0] for r, fits in zip(sizes, room, strict=True) if fits and r[1] == k), default=-1.0) for k in (0, 1)}
    got = sorted(held.where(F.col("unit") <= F.when(F.col("label") == 1, last[1]).otherwise(last[0])).select("unit", "label", "held", "times").collect())
    if len({r[1] for r in got}) < 2:
        return good / (good + bad), ratios
    return fit_arrays([np.frombuffer(r[2], "<u4").astype(np.int64) for r in got], np.array([r[1] for r in got]), ratios, good / (good + bad), times=np.array([r[3] for r in got])), ratios


def _packed(counts: np.ndarray) -> bytes:
    """Counts by place and label; most are 0."""
    return zlib.compress(counts.astype("<i8").tobytes(), 1)


def _unpacked(packed: bytes) -> np.ndarray:
    return np.frombuffer(zlib.decompress(packed), "<i8").reshape(-1, 2)


def _rows(rows: list[tuple], schema: str) -> pa.RecordBatch:
    kinds = {"long": pa.int64(), "int": pa.int32(), "double": pa.float64(), "binary": pa.binary()}
    fields = [x.split() for x in schema.split(", ")]
    return pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], kinds[kind]) for k, (_, kind) in enumerate(fields)], [name for name, _ in fields])


def predict(docs: DataFrame, model: Model | float, ratios: np.ndarray, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, score) of every document."""
    small_batches(docs.sparkSession)
    if isinstance(model, Model):
        model = Model(model.weights.astype(np.float32), model.bias, model.slope, model.offset)
    shared = docs.sparkSession.sparkContext.broadcast((model, ratios.astype(np.float32)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own, scale = shared.value
        for batch in batches:
            if isinstance(own, float):
                scores = [own] * len(batch)
            else:
                scores = [own.score(x, scale) for x in indicators(batch.column(1))]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(scores, pa.float64())], [id_col, name])

    (name,) = free_names([id_col], ["score"])
    return docs.select(id_col, text_col).mapInArrow(run, f"`{id_col}` {dict(docs.dtypes)[id_col]}, {name} double")


def query(spark, sf_dir: str) -> DataFrame:
    """op7: the quality score of every document; documents whose crc32(doc_id) mod 5 is 0 are held out."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet").select("doc_id", "quality")
    held_out = F.coalesce(F.crc32(F.col("doc_id").cast("string")) % 5 == 0, F.lit(False))
    # Labels grow with the documents, so both sides are dealt by id at every size; the held-out rows go before that.
    model, ratios = fit(docs.where(~held_out).join(labels.where(~held_out).hint("merge"), "doc_id"))
    return predict(docs, model, ratios).select("doc_id", held_out.alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))
