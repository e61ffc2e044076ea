"""Operator 12: a Merkle manifest of a table, with the proof of every row.

Leaves are native sha256 expressions. Their places within a group (a source) come from one range partitioning of (group, order)
and offsets of one row a partition, so a group with a third of all rows lies in many tasks. Places are cut into aligned blocks
of FANOUT ** LEVELS leaves; a block is one contiguous matrix of 64-byte hex digests, reshaped by the fanout and hashed row by
row, level after level. The digests of blocks are the members of the next tier of blocks, until each group has one; the groups'
digests go through the same tiers as one last group. Proofs come down the same way: a block gets the siblings above it in one
row, and the siblings of its own members by index arithmetic.

Nulls are `-` in a leaf; a null group is first, null orders are first within their group. Rows with equal order are in order of
their leaves; repeated rows are separate leaves, and each of them gets a proof. An empty table has no rows and no root. Texts of
any length are hashed whole. Other columns of the table don't matter.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from hashlib import sha256

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidemark.llm._store import keep, small_batches

#: Fixed values of the contract: nodes of a run, fields of a leaf.
FANOUT = 3
FIELDS = ("doc_id", "source", "lang", "n_chars", "text")
#: Levels of the tree in a block: 729 leaves.
LEVELS = 6
BLOCK = FANOUT**LEVELS
HEX = 64


def field(value: Column) -> Column:
    """A value as a leaf holds it: its UTF-8 bytes after their count and a colon, or `-` if null."""
    text = value.cast("string")
    return F.coalesce(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text), F.lit("-"))


def leaf(values: list[Column]) -> Column:
    """The digest of some values, as hex text."""
    return F.sha2(F.concat(*[field(v) for v in values]), 256)


def group_key(group: Column) -> Column:
    """A text without nulls in the order of the groups, null first and then by bytes."""
    return F.coalesce(F.concat(F.lit("s"), group.cast("string")), F.lit("n"))


def ranked(rows: DataFrame, order: list[str]) -> DataFrame:
    """`rows` with `place`, from 0 within each `key` by `order`. rows: a written table, as it is read twice."""
    dealt = rows.repartitionByRange("key", *order).sortWithinPartitions("key", *order)
    schema = T.StructType([*rows.schema.fields, T.StructField("part", T.IntegerType()), T.StructField("place", T.LongType())])
    at = rows.columns.index("key")

    def number(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, last, seen = TaskContext.get().partitionId(), None, 0
        for batch in batches:
            n, keys = batch.num_rows, batch.column(at)
            if not n:
                continue
            new = np.ones(n, bool)
            new[1:] = pc.not_equal(keys.slice(1), keys.slice(0, n - 1)).to_numpy(zero_copy_only=False)
            starts = np.flatnonzero(new)
            place = np.arange(n) - starts[np.cumsum(new) - 1]
            if keys[0].as_py() == last:
                place[: starts[1] if len(starts) > 1 else n] += seen
            last, seen = keys[n - 1].as_py(), int(place[-1]) + 1
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(np.full(n, part, np.int32)), pa.array(place)], schema.names)

    numbered = keep(dealt.mapInArrow(number, schema), "merkle-ranks")
    over = Window.partitionBy("key").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)  # one row for each key and part
    before = numbered.groupBy("key", "part").agg(F.count("*").alias("n")).withColumn("before", F.sum("n").over(over))
    # Only a part's first key can have begun in an earlier part: one row a part at most.
    before = before.where(F.col("before") > 0).select("key", "part", "before")
    found = numbered.join(F.broadcast(before), ["key", "part"], "left")
    return found.select(*rows.columns, (F.col("place") + F.coalesce("before", F.lit(0))).alias("place"))


def _blocks(members: DataFrame, payload: list[str]) -> DataFrame:
    """(key, block, members) of aligned blocks, BLOCK members at most, in order of place. members: key, place, digest, payload."""
    at = F.pmod("place", F.lit(BLOCK)).cast("int")
    one = F.struct(at.alias("at"), "digest", *payload)
    dealt = members.select("key", F.floor(F.col("place") / BLOCK).alias("block"), one.alias("one"))
    return dealt.groupBy("key", "block").agg(F.array_sort(F.collect_list("one")).alias("members"))


def hex_matrix(raw: pa.Array) -> np.ndarray:
    """Binary digests as rows of 64 hex characters."""
    data = b"".join(raw.to_pylist())
    return np.frombuffer(data.hex().encode(), np.uint8).reshape(-1, HEX)


def tree_levels(leaves: np.ndarray, block: int) -> list[np.ndarray]:
    """The matrices of all levels of a block, its leaves first and one row last. The first block of a group may be all of it and
    ends at one node; any other has LEVELS levels."""
    out = [np.ascontiguousarray(leaves)]
    while len(out[-1]) > 1 or block and len(out) <= LEVELS:
        level = out[-1]
        full = len(level) // FANOUT * FANOUT
        rows = [*level[:full].reshape(-1, FANOUT * HEX), *([level[full:].ravel()] if full < len(level) else [])]
        out.append(np.frombuffer("".join([sha256(x).hexdigest() for x in rows]).encode(), np.uint8).reshape(-1, HEX))
    return out


def siblings(levels: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of each leaf and level the nodes of its run (leaf, level, FANOUT, HEX), which of them exist and which is its own."""
    n, depth = len(levels[0]), len(levels) - 1
    nodes = np.arange(n)[:, None] // FANOUT ** np.arange(depth)[None, :]
    runs = (nodes // FANOUT * FANOUT)[:, :, None] + np.arange(FANOUT)
    sizes = np.array([len(x) for x in levels[:depth]], np.int64)
    there, own = runs < sizes[None, :, None], runs == nodes[:, :, None]
    digests = np.zeros((n, depth, FANOUT, HEX), np.uint8)
    for k in range(depth):
        digests[:, k] = levels[k][np.minimum(runs[:, k], sizes[k] - 1)]
    return digests, there, own


def fold(start: np.ndarray, digests: np.ndarray, there: np.ndarray, own: np.ndarray) -> np.ndarray:
    """The block's digest as each leaf's own value and its siblings give it."""
    nodes, at = start.copy(), np.arange(len(start))
    for k in range(digests.shape[1]):
        runs = digests[:, k].copy()
        runs[at, own[:, k].argmax(1)] = nodes
        counts = there[:, k].sum(1) * HEX  # what exists comes first
        flat = runs.reshape(len(runs), -1)
        nodes = np.frombuffer("".join([sha256(x[:c]).hexdigest() for x, c in zip(flat, counts.tolist(), strict=True)]).encode(), np.uint8).reshape(-1, HEX)
    return nodes


def climb(node: bytes, above: bytes, shape: bytes) -> bytes:
    """From a block's digest to the root. above: hex siblings level by level; shape: how many lie left and right at each."""
    at = 0
    for left, right in zip(shape[::2], shape[1::2], strict=True):
        middle, end = at + left * HEX, at + (left + right) * HEX
        node, at = sha256(above[at:middle] + node + above[middle:end]).hexdigest().encode(), end
    return node


def _parts(batch: pa.RecordBatch, name: str) -> Iterator[tuple[int, pa.StructArray]]:
    """(row, members) of each block in a batch."""
    lists = batch.column(batch.schema.get_field_index(name))
    for k in range(batch.num_rows):
        yield k, lists[k].values


def _roots(blocks: DataFrame) -> DataFrame:
    """(key, place, digest): the digest of each block, whose number is its place in the next tier."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            numbers, out = batch.column(1).to_pylist(), []
            for k, members in _parts(batch, "members"):
                out.append(bytes.fromhex(tree_levels(hex_matrix(members.field("digest")), numbers[k])[-1].tobytes().decode()))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(out, pa.binary())], ["key", "place", "digest"])

    return blocks.mapInArrow(run, "key string, place long, digest binary")


@dataclass
class Tree:
    """tiers: tables of blocks, those of the leaves first; roots: (key, digest), one row a key."""

    tiers: list[DataFrame]
    roots: DataFrame


def grow(members: DataFrame, payload: list[str], name: str) -> Tree:
    """The tiers over (key, place, digest, payload)."""
    tiers = [keep(_blocks(members, payload), f"merkle-{name}-1")]
    while True:
        roots = keep(_roots(tiers[-1]), f"merkle-{name}-roots-{len(tiers)}")
        if not (roots.agg(F.max("place")).first()[0] or 0):
            return Tree(tiers, roots.select("key", "digest"))
        tiers.append(keep(_blocks(roots, []), f"merkle-{name}-{len(tiers) + 1}"))


ABOVE = "above binary, shape binary, subroot binary"


def _descend(blocks: DataFrame, above: DataFrame, child: Column) -> DataFrame:
    """What lies above each member of a tier, from what lies above its blocks. child: names a member (key, place) below."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            numbers, over, shapes, subroots = (batch.column(k).to_pylist() for k in (1, 3, 4, 5))
            for k, members in _parts(batch, "members"):
                digests, there, own = siblings(tree_levels(hex_matrix(members.field("digest")), numbers[k]))
                beside = there & ~own
                raw = digests[beside].tobytes()
                ends = np.cumsum(beside.sum((1, 2))) * HEX
                before = beside & (np.cumsum(own, 2) == 0)
                left = before.sum(2)
                sides = np.stack((left, beside.sum(2) - left), 2).astype(np.uint8)
                starts = np.concatenate(([0], ends[:-1]))
                own_above = [raw[a:b] + over[k] for a, b in zip(starts.tolist(), ends.tolist(), strict=True)]
                own_shape = [x.tobytes() + shapes[k] for x in sides]
                keys = members.field("source") if "source" in [f.name for f in members.type] else pa.array([batch.column(0)[k].as_py()] * len(members), pa.string())
                places = numbers[k] * BLOCK + np.arange(len(members))
                raw_digests = members.field("digest") if subroots[k] is None else pa.array([subroots[k]] * len(members), pa.binary())
                yield pa.RecordBatch.from_arrays([keys, pa.array(places, pa.int64()), pa.array(own_above, pa.binary()), pa.array(own_shape, pa.binary()), raw_digests], ["key", "place", "above", "shape", "subroot"])

    both = blocks.join(above.withColumnRenamed("place", "block"), ["key", "block"]).select("key", "block", "members", "above", "shape", "subroot")
    return both.mapInArrow(run, f"key string, place long, {ABOVE}").withColumn("place", child)


@dataclass
class Manifest:
    """root: hex text, None for an empty table; sources: the tree of the groups; groups: the trees within them."""

    root: str | None
    sources: Tree
    groups: Tree
    id_type: str

    def subroots(self) -> DataFrame:
        """(key, subroot): one row a group; the key is `n` for null, else `s` and the group."""
        return self.groups.roots.select("key", F.lower(F.hex("digest")).alias("subroot"))

    def proofs(self) -> DataFrame:
        """A row for each leaf: id, leaf, subroot, root, proof (siblings as hex text, level by level up to the root, left to
        right), proof_sha256, folded_root (from the changed leaf where there is one) and verified."""
        spark = self.groups.roots.sparkSession
        here = F.col("place")
        top = self.groups.roots.limit(0)
        empty = F.lit(b"")
        over = spark.range(1).select(F.lit("all").alias("key"), F.lit(0).cast("long").alias("place"), empty.alias("above"), empty.alias("shape"), F.lit(None).cast("binary").alias("subroot"))
        if self.root is None:
            over = over.join(top.select("key"), "key", "left_semi")
        for k, tier in enumerate(reversed(self.sources.tiers)):
            last = k == len(self.sources.tiers) - 1
            over = _descend(tier, over, F.lit(0).cast("long") if last else here)
            if not last:
                over = over.withColumn("subroot", F.lit(None).cast("binary"))
        for tier in reversed(self.groups.tiers[1:]):
            over = _descend(tier, over, here)
        return self._leaves(keep(over, "merkle-above"))

    def _leaves(self, over: DataFrame) -> DataFrame:
        root = self.root or ""

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                numbers, above, shapes, subroots = (batch.column(k).to_pylist() for k in (1, 3, 4, 5))
                for k, members in _parts(batch, "members"):
                    leaves = hex_matrix(members.field("digest"))
                    levels = tree_levels(leaves, numbers[k])
                    digests, there, own = siblings(levels)
                    changed = members.field("changed")
                    start = leaves.copy()
                    other = np.flatnonzero(pc.is_valid(changed).to_numpy(zero_copy_only=False))
                    if len(other):
                        start[other] = hex_matrix(changed.take(pa.array(other)))
                    nodes = fold(start, digests, there, own).tobytes()
                    beside = there & ~own
                    raw = digests[beside].tobytes()
                    ends = np.cumsum(beside.sum((1, 2))) * HEX
                    proofs = [raw[a:b] + above[k] for a, b in zip([0, *ends[:-1].tolist()], ends.tolist(), strict=True)]
                    roots: dict[bytes, str] = {}
                    folded = []
                    for a in range(0, len(nodes), HEX):
                        node = nodes[a : a + HEX]
                        if node not in roots:
                            roots[node] = climb(node, above[k], shapes[k]).decode()
                        folded.append(roots[node])
                    n, text = len(members), leaves.tobytes().decode()
                    columns = [
                        members.field("id"), pa.array([text[a : a + HEX] for a in range(0, n * HEX, HEX)]), pa.array([subroots[k].hex()] * n), pa.array([root] * n),
                        pa.array([x.decode() for x in proofs]), pa.array([sha256(x).hexdigest() for x in proofs]), pa.array(folded), pa.array([x == root for x in folded]),
                    ]
                    yield pa.RecordBatch.from_arrays(columns, ["id", "leaf", "subroot", "root", "proof", "proof_sha256", "folded_root", "verified"])

        both = self.groups.tiers[0].join(over.withColumnRenamed("place", "block"), ["key", "block"]).select("key", "block", "members", "above", "shape", "subroot")
        return both.mapInArrow(run, f"id {self.id_type}, leaf string, subroot string, root string, proof string, proof_sha256 string, folded_root string, verified boolean")


def manifest(docs: DataFrame, id_col: str = "doc_id", group_col: str = "source", fields: tuple[str, ...] = FIELDS, changed: dict[str, Column] | None = None, where: Column | None = None) -> Manifest:
    """The manifest of a table. changed: other values of fields, for rows where `where` is true; the proofs then fold from the
    leaf of these values instead, so that verified tells whether the change is seen."""
    small_batches(docs.sparkSession)
    digest = F.unhex(leaf([F.col(f) for f in fields]))
    other = F.unhex(leaf([(changed or {}).get(f, F.col(f)) for f in fields])) if changed else F.lit(None).cast("binary")
    other = F.when(F.coalesce(where, F.lit(False)), other) if changed and where is not None else other
    rows = docs.select(group_key(F.col(group_col)).alias("key"), F.col(id_col).alias("id"), digest.alias("digest"), other.alias("changed"), F.monotonically_increasing_id().alias("tie"))
    leaves = keep(rows, "merkle-leaves")
    groups = grow(ranked(leaves, ["id", "digest", "tie"]), ["id", "changed"], "groups")
    # The groups are the members of one more tree.
    named = keep(groups.roots.select(F.lit("all").alias("key"), F.col("key").alias("source"), "digest"), "merkle-sources")
    sources = grow(ranked(named, ["source"]), ["source"], "sources")
    first = sources.roots.first()  # one row
    return Manifest(first["digest"].hex() if first else None, sources, groups, dict(docs.dtypes)[id_col])


def query(spark, sf_dir: str) -> DataFrame:
    """op12: the manifest of the documents; where 2 divides the crc32 of the id, the text has lost its line ends."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    even = F.pmod(F.crc32(F.col("doc_id").cast("string")), F.lit(2)) == 0
    text = F.regexp_replace("text", "\n", "")
    found = manifest(docs, changed={"text": text}, where=even & F.col("text").contains("\n")).proofs()
    return found.select(F.col("id").alias("doc_id"), "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified")


SQL = r"""
WITH RECURSIVE crc AS (
  SELECT *, list_reduce(list_prepend(4294967295::BIGINT, [ord(c)::BIGINT FOR c IN string_split(CAST(doc_id AS VARCHAR), '')]),
    lambda c, b: list_reduce([xor(c, b), 0, 0, 0, 0, 0, 0, 0, 0], lambda u, z: xor(u >> 1, 3988292384 * (u & 1)))) AS c
  FROM documents
), leaves AS (
  SELECT doc_id, source, row_number() OVER (PARTITION BY source ORDER BY doc_id) - 1 AS i, count(*) OVER (PARTITION BY source) AS n,
    sha256(concat(coalesce(concat(strlen(CAST(doc_id AS VARCHAR)), ':', doc_id), '-'), coalesce(concat(strlen(source), ':', source), '-'), coalesce(concat(strlen(lang), ':', lang), '-'),
      coalesce(concat(strlen(CAST(n_chars AS VARCHAR)), ':', n_chars), '-'), coalesce(concat(strlen(text), ':', text), '-'))) AS leaf,
    sha256(concat(coalesce(concat(strlen(CAST(doc_id AS VARCHAR)), ':', doc_id), '-'), coalesce(concat(strlen(source), ':', source), '-'), coalesce(concat(strlen(lang), ':', lang), '-'),
      coalesce(concat(strlen(CAST(n_chars AS VARCHAR)), ':', n_chars), '-'), coalesce(concat(strlen(replace(text, chr(10), '')), ':', replace(text, chr(10), '')), '-'))) AS changed,
    (c & 1) = 1 AS even
  FROM crc
), nodes AS (
  SELECT source, 0 AS level, i, n, leaf AS digest FROM leaves
  UNION ALL
  SELECT source, level + 1, i // 3, max((n + 2) // 3), sha256(string_agg(digest, '' ORDER BY i)) FROM nodes WHERE n > 1 GROUP BY source, level, i // 3
), subroots AS (
  SELECT source, digest AS subroot, row_number() OVER (ORDER BY source NULLS FIRST) - 1 AS i, count(*) OVER () AS n FROM nodes WHERE n = 1
), upper AS (
  SELECT 0 AS level, i, n, subroot AS digest FROM subroots
  UNION ALL
  SELECT level + 1, i // 3, max((n + 2) // 3), sha256(string_agg(digest, '' ORDER BY i)) FROM upper WHERE n > 1 GROUP BY level, i // 3
), runs AS (
  SELECT source, level, i // 3 AS run, list(digest ORDER BY i) AS run_digests FROM nodes WHERE n > 1 GROUP BY source, level, i // 3
), upper_runs AS (
  SELECT level, i // 3 AS run, list(digest ORDER BY i) AS run_digests FROM upper WHERE n > 1 GROUP BY level, i // 3
), folds AS (
  SELECT doc_id, source, leaf, 0 AS level, i, n, CASE WHEN even THEN changed ELSE leaf END AS node, '' AS proof FROM leaves
  UNION ALL
  SELECT doc_id, f.source, leaf, f.level + 1, i // 3, (n + 2) // 3, sha256(concat(array_to_string(run_digests[1:i % 3], ''), node, array_to_string(run_digests[i % 3 + 2:], ''))),
    concat(proof, array_to_string(run_digests[1:i % 3], ''), array_to_string(run_digests[i % 3 + 2:], ''))
  FROM folds f JOIN runs r ON f.source IS NOT DISTINCT FROM r.source AND f.level = r.level AND f.i // 3 = r.run WHERE f.n > 1
), upper_folds AS (
  SELECT doc_id, leaf, s.subroot, 0 AS level, s.i, s.n, node, proof FROM folds f JOIN subroots s ON f.source IS NOT DISTINCT FROM s.source WHERE f.n = 1
  UNION ALL
  SELECT doc_id, leaf, subroot, f.level + 1, i // 3, (n + 2) // 3, sha256(concat(array_to_string(run_digests[1:i % 3], ''), node, array_to_string(run_digests[i % 3 + 2:], ''))),
    concat(proof, array_to_string(run_digests[1:i % 3], ''), array_to_string(run_digests[i % 3 + 2:], ''))
  FROM upper_folds f JOIN upper_runs r ON f.level = r.level AND f.i // 3 = r.run WHERE f.n > 1
)
SELECT doc_id, leaf, subroot, u.digest AS root, sha256(proof) AS proof_sha256, node AS folded_root, node = u.digest AS verified
FROM upper_folds f, (SELECT digest FROM upper WHERE n = 1) u WHERE f.n = 1
"""
