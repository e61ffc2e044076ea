"""Operator 8: line dedup. A sharded minimal perfect hash over distinct line hashes indexes fingerprint, count and
largest-document arrays; documents probe the arrays instead of joining lines.

A line's key is the line without [\\x20\\x09-\\x0D] at both ends and with A-Z lower-cased. A key of `min_chars` code points
or more that is found in `min_docs` documents or more loses all its lines, except in the document with the largest id.

1. Each document gives the 128-bit hashes of its distinct long keys; counts are aggregated in two steps, first by key and
   document, so that a line that a third of all documents hold is summed where it is read.
2. Keys found often enough go, by hash, to shards of about SHARD_KEYS keys; each shard is one block of bytes.
3. Probes (hashes, no text) are dealt to the shards; a shard with many probes is copied to several tasks, and a task streams
   its probes past one block. Only hits leave.
4. Documents take their hits by id and drop the lines.

Null and empty texts are one empty line. Documents with a null id are one document, below all others. Repeated rows of an
id are one document: each row loses the same lines. An empty table gives an empty result. Other columns stay as they are.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidemark.llm import _mph, _text
from tidemark.llm._store import free_names, keep, small_batches

MIN_CHARS, MIN_DOCS = 20, 3
#: Keys in a shard, and probes in a task, about.
SHARD_KEYS, TASK_PROBES = 200_000, 200_000

FOLD = np.arange(256, dtype=np.uint8)
FOLD[65:91] += 32


def _line_keys(data: np.ndarray, offsets: np.ndarray, min_chars: int) -> Iterator[tuple[list[bytes], list[int], int]]:
    """Of each text: the digests of its long keys, the numbers of their lines, and how many lines there are."""
    folded = memoryview(np.ascontiguousarray(FOLD[data]))
    starts, ends, _ = _text.word_spans(data, offsets)
    cuts = np.flatnonzero(data == 10)
    chars = np.zeros(len(data) + 1, np.int64)
    np.cumsum((data & 0xC0) != 0x80, out=chars[1:])
    for a, b in zip(offsets[:-1], offsets[1:], strict=True):
        own = cuts[np.searchsorted(cuts, a) : np.searchsorted(cuts, b)]
        lo, hi = np.append(a, own + 1), np.append(own, b)
        first, last = np.searchsorted(starts, lo), np.searchsorted(starts, hi)
        full = np.flatnonzero(last > first)
        s, e = starts[first[full]], ends[last[full] - 1]
        long = chars[e] - chars[s] >= min_chars
        yield [xxhash.xxh3_128_digest(folded[x:y]) for x, y in zip(s[long], e[long], strict=True)], full[long].tolist(), len(lo)


def _all_keys(column: pa.Array, min_chars: int) -> Iterator[tuple[list[bytes], list[int], int]]:
    data, offsets = _text.text_buffers(column)
    for a, b in _text.slices(offsets):
        yield from _line_keys(data[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a], min_chars)


def _halves(digests: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    both = np.frombuffer(b"".join(digests), "<i8").reshape(-1, 2)
    return both[:, 0].copy(), both[:, 1].copy()


def line_hashes(docs: DataFrame, id_col: str, text_col: str, min_chars: int) -> DataFrame:
    """(doc, h1, h2) of each distinct long key of each row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [list(set(keys)) for keys, _, _ in _all_keys(batch.column(1), min_chars)]
            h1, h2 = _halves([x for own in found for x in own])
            ids = batch.column(0).take(pa.array(np.repeat(np.arange(len(found)), [len(x) for x in found])))
            yield pa.RecordBatch.from_arrays([ids, pa.array(h1), pa.array(h2)], ["doc", "h1", "h2"])

    return docs.select(id_col, text_col).mapInArrow(run, f"doc {dict(docs.dtypes)[id_col]}, h1 long, h2 long")


def build_index(hashes: DataFrame, min_docs: int, shard_keys: int = SHARD_KEYS) -> tuple[DataFrame, int]:
    """The shards (shard, block) over the keys of `min_docs` documents or more, and how many shards there are. Documents
    are longs here."""
    counts = hashes.groupBy("h1", "h2", "doc").agg(F.lit(1).alias("one")).groupBy("h1", "h2").agg(F.count("*").alias("n"), F.max("doc").alias("largest"))
    frequent = keep(counts.where(F.col("n") >= min_docs), "line-counts")
    n_shards = max(1, -(-frequent.count() // shard_keys))

    def build(pdf: pd.DataFrame) -> pd.DataFrame:
        keys = pdf["h1"].to_numpy(np.int64).view(np.uint64)
        if len(np.unique(keys)) < len(keys):  # two keys that share a half: the other half decides, then no key is lost
            keys = _text.mix(keys) ^ pdf["h2"].to_numpy(np.int64).view(np.uint64)
            mixed = True
        else:
            mixed = False
        levels = _mph.build(keys)
        place = _mph.Places(levels)(keys)
        arrays = [np.array([mixed], np.uint8)]
        for name, kind in (("h1", np.int64), ("h2", np.int64), ("n", np.uint32), ("largest", np.int64)):
            values = np.zeros(len(keys), kind)
            values[place] = np.minimum(pdf[name].to_numpy(), 0xFFFFFFFF) if name == "n" else pdf[name].to_numpy(np.int64)
            arrays.append(values)
        return pd.DataFrame({"shard": [int(pdf["shard"].iloc[0])], "block": [_mph.pack(levels, arrays)]})

    shards = frequent.withColumn("shard", F.pmod(F.col("h2"), F.lit(n_shards))).groupBy("shard").applyInPandas(build, "shard long, block binary")
    return keep(shards, "line-index"), n_shards


def probe(hashes: DataFrame, shards: DataFrame, n_shards: int, task_probes: int = TASK_PROBES) -> DataFrame:
    """(doc, h1, h2) of the probes that must go: their key is in the index and `doc` isn't its largest document."""
    probes = hashes.withColumn("shard", F.pmod(F.col("h2"), F.lit(n_shards)))
    copies = probes.groupBy("shard").agg(F.ceil(F.count("*") / task_probes).alias("copies"))
    blocks = shards.join(copies, "shard").select("shard", F.explode(F.sequence(F.lit(0), F.col("copies") - 1)).alias("copy"), F.lit(0).alias("kind"), "block")
    dealt = probes.join(copies, "shard").select("shard", F.pmod(F.xxhash64("doc", "h1"), "copies").alias("copy"), F.lit(1).alias("kind"), "doc", "h1", "h2")
    rows = dealt.unionByName(blocks, allowMissingColumns=True).repartition("shard", "copy").sortWithinPartitions("shard", "copy", "kind")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, places, arrays = None, None, []
        for batch in batches:
            shard, kind = batch.column("shard").to_numpy(), batch.column("kind").to_numpy()
            doc = batch.column("doc").fill_null(-(1 << 63)).to_numpy()
            h1, h2 = (batch.column(x).fill_null(0).to_numpy() for x in ("h1", "h2"))
            block = batch.column("block")
            cuts = [*np.unique(np.concatenate(([0], np.flatnonzero(kind == 0), np.flatnonzero(kind == 0) + 1, np.flatnonzero(np.diff(shard)) + 1))), len(kind)]
            gone = np.zeros(len(kind), bool)
            for a, b in zip(cuts[:-1], cuts[1:], strict=True):
                if a == b:
                    continue
                if kind[a] == 0:
                    at, (places, arrays) = shard[a], _mph.unpack(block[int(a)].as_py())
                elif at == shard[a]:
                    mixed, f1, f2, count, largest = arrays
                    keys = h1[a:b].view(np.uint64)
                    place = places(_text.mix(keys) ^ h2[a:b].view(np.uint64) if mixed[0] else keys)
                    hit = place >= 0
                    hit[hit] = (f1[place[hit]] == h1[a:b][hit]) & (f2[place[hit]] == h2[a:b][hit]) & (count[place[hit]] > 0)
                    gone[a:b][hit] = largest[place[hit]] != doc[a:b][hit]
            yield pa.RecordBatch.from_arrays([x.filter(pa.array(gone)) for x in (batch.column("doc"), batch.column("h1"), batch.column("h2"))], ["doc", "h1", "h2"])

    return rows.select("shard", "kind", "block", "doc", "h1", "h2").mapInArrow(run, "doc long, h1 long, h2 long")


def dedup_lines(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_chars: int = MIN_CHARS, min_docs: int = MIN_DOCS, shard_keys: int = SHARD_KEYS, task_probes: int = TASK_PROBES) -> DataFrame:
    """The documents with their columns, their texts without the dropped lines, and n_lines and n_dropped of each. A text
    that loses nothing stays as it was. The id is an integer column; added columns get underscores if their names are
    taken."""
    small_batches(docs.sparkSession)
    n_lines, n_dropped, *dropped, owner = free_names(docs.columns, ["n_lines", "n_dropped", "dropped_keys1", "dropped_keys2", "dropped_doc"])
    hashes = keep(line_hashes(docs, id_col, text_col, min_chars).withColumn("doc", F.col("doc").cast("long")), "line-hashes")
    shards, n_shards = build_index(hashes, min_docs, shard_keys)
    gone = probe(hashes, shards, n_shards, task_probes).distinct().groupBy("doc").agg(F.collect_list(F.struct("h1", "h2")).alias("keys"))
    gone = gone.select(F.col("doc").alias(owner), F.transform("keys", lambda x: x["h1"]).alias(dropped[0]), F.transform("keys", lambda x: x["h2"]).alias(dropped[1]))
    joined = docs.join(gone, docs[id_col].cast("long").eqNullSafe(gone[owner]), "left").drop(owner)
    schema = T.StructType([*docs.schema.fields, T.StructField(n_lines, T.LongType()), T.StructField(n_dropped, T.LongType())])
    at = docs.columns.index(text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts, lines, lost = batch.column(at), [], []
            changed: dict[int, str] = {}
            d1, d2 = batch.column(len(schema) - 2), batch.column(len(schema) - 1)
            for i, (keys, numbers, count) in enumerate(_all_keys(texts, min_chars)):
                lines.append(count)
                drop: set[int] = set()
                if d1[i].is_valid:
                    goes = {a.to_bytes(8, "little", signed=True) + b.to_bytes(8, "little", signed=True) for a, b in zip(d1[i].as_py(), d2[i].as_py(), strict=True)}
                    drop = {k for key, k in zip(keys, numbers, strict=True) if key in goes}
                if drop:
                    changed[i] = "\n".join(x for k, x in enumerate(texts[i].as_py().split("\n")) if k not in drop)
                lost.append(len(drop))
            if changed:
                texts = pa.array([changed.get(i, x) for i, x in enumerate(texts.to_pylist())], texts.type)
            columns = [texts if k == at else batch.column(k) for k in range(len(schema) - 2)]
            yield pa.RecordBatch.from_arrays([*columns, pa.array(lines, pa.int64()), pa.array(lost, pa.int64())], schema.names)

    return joined.mapInArrow(run, schema)


def query(spark, sf_dir: str) -> DataFrame:
    """op8: every document with its number of lines, of dropped lines, and the sha256 of what is left."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    return dedup_lines(docs).select("doc_id", "n_lines", "n_dropped", F.sha2(F.coalesce("text", F.lit("")).cast("binary"), 256).alias("kept_sha256"))


SQL = r"""
WITH lines AS (
  SELECT doc_id, ord, line, regexp_replace(regexp_replace(translate(line, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '^[\x20\x09-\x0D]+', ''), '[\x20\x09-\x0D]+$', '') AS key
  FROM (SELECT doc_id, unnest(l) AS line, unnest(range(len(l))) AS ord FROM (SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS l FROM documents))
), frequent AS (
  SELECT key, max(doc_id) AS largest FROM lines WHERE length(key) >= 20 GROUP BY key HAVING count(DISTINCT doc_id) >= 3
)
SELECT doc_id, CAST(count(*) AS BIGINT) AS n_lines, CAST(count(largest) FILTER (WHERE largest <> doc_id) AS BIGINT) AS n_dropped,
  sha256(coalesce(string_agg(line, chr(10) ORDER BY ord) FILTER (WHERE largest IS NULL OR largest = doc_id), '')) AS kept_sha256
FROM lines LEFT JOIN frequent USING (key) GROUP BY doc_id
"""
