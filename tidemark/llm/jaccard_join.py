"""Operator 1: n-gram Jaccard join on a token-group matrix.

A document's set holds the hashes of its distinct n-word shingles. Two documents link when den * |both| >= num * |either|;
the result names each document's component, the smallest id that links lead to.

1. Texts with equal sets are one class; only classes are compared, so copies cost nothing.
2. A sketch of fixed size counts how many documents hold each shingle, over all documents, and gives one order for all sets,
   rare shingles first. Linked sets share SHARED shingles (or all that they must share, if that is less) among their first
   size - ceil(t * size) + SHARED; those are the tokens.
3. Classes with equal min-hash are compared with one of them, their pivot, and those that link with it are its group; all
   others are groups of their own. A group lies within one component by construction.
4. Similar classes are one family, linked or not: those whose most frequent token is the same. The token-group matrix says
   which token is in which family, once a family, whatever its size, with the sizes of its sets. A class meets its own and
   the larger families that share enough tokens and a possible size with it: these are its candidates.
5. Families are stored in blocks of some members, those of equal min-hash together, with the union of their tokens and of their
   shingles. A class's tokens meet the blocks' tokens first; its text travels only to blocks that hold enough of them. There
   |query & union| < ceil(t * |query|) rules the block out; only blocks that qualify are opened, and members are compared whose
   groups the block has not joined yet.
6. Components of groups follow from these links, and components of documents from their classes.

Nothing is capped: a frequent token only costs rows of the matrix, one a family. Classes with many copies and tokens and
min-hashes of many classes come to their rows by broadcast where they are a ten-thousandth of all rows or more (_skew). Shingles and sets are known by 64-bit hashes.

Null and empty texts, and texts without words, have empty sets and link with nothing. Texts with fewer than n words have one
shingle, all their words. Rows with a null id are compared with none and have a null component. Rows with equal ids are
separate documents. An empty table gives an empty result. Other columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.llm import _text
from tidemark.llm._components import components
from tidemark.llm._encode import gather
from tidemark.llm._skew import left_join
from tidemark.llm._store import dropped, free_shuffles, keep, keep_buckets, small_batches

SKETCH_BITS, SKETCH_CHUNK, SUM_ROWS = 20, 1 << 14, 64
#: Tokens that linked sets share. More of them cost as many rows a class and leave fewer classes and candidates.
SHARED = 12
#: Members of a block, and queries that a task compares with it, about.
BLOCK_MEMBERS, TASK_QUERIES = 64, 500
#: Blocks whose tokens a candidate meets at once, and candidates that a task compares with them, about.
SHELF_BLOCKS, SHELF_QUERIES = 64, 20_000


@dataclass(frozen=True)
class Rule:
    """Shingles of n words; linked at num / den."""

    n: int = 3
    num: int = 90
    den: int = 100

    def least(self, size: int) -> int:
        """What a set of this size shares at least with any that it links with."""
        return -(-self.num * size // self.den)

    def tokens_shared(self, size: Column) -> Column:
        """How many tokens a set of this size shares at least with any that it links with."""
        return F.least(F.lit(SHARED).cast("long"), F.ceil(size * self.num / self.den).cast("long"))

    def tokens_shared_with(self, size: Column, low: Column, high: Column) -> Column:
        """The same for partners with sizes from low to high. Two linked sets share at least t / (1 + t) of their sizes' sum;
        of what they share, what isn't among the tokens of both comes after the tokens of one of them, so it is at most what
        that set holds besides its tokens. The difference is least at an end of the range of sizes; one is taken off for
        rounding."""
        part = lambda x: F.ceil(x * self.num / self.den)

        def at(other: Column) -> Column:
            other = F.greatest(part(size), F.least(other, F.floor(size * self.den / self.num)))
            both = F.ceil((size + other) * self.num / (self.num + self.den))
            return both - F.greatest(F.lit(0), F.greatest(part(size), part(other)) - SHARED)

        return F.greatest(F.lit(1), F.least(at(low), at(high)) - 1)

    def tokens_shared_at_least(self, size: int, low: np.ndarray, high: np.ndarray) -> np.ndarray:
        """tokens_shared_with for one size and arrays of ranges."""

        def part(x):
            return np.ceil(np.asarray(x) * self.num / self.den)

        def at(other: np.ndarray) -> np.ndarray:
            other = np.maximum(part(size), np.minimum(other, np.floor(size * self.den / self.num)))
            both = np.ceil((size + other) * self.num / (self.num + self.den))
            return both - np.maximum(0, np.maximum(part(size), part(other)) - SHARED)

        return np.maximum(1, np.minimum(at(low), at(high)) - 1)

    def linked(self, a: np.ndarray, b: np.ndarray) -> bool:
        if min(len(a), len(b)) * self.den < self.num * max(len(a), len(b)):
            return False
        both = common(a, b)
        return both > 0 and self.den * both >= self.num * (len(a) + len(b) - both)


def common(a: np.ndarray, b: np.ndarray) -> int:
    """How many values two sorted distinct arrays share."""
    if len(a) > len(b):
        a, b = b, a
    if not len(a):
        return 0
    at = np.searchsorted(b, a)
    at[at == len(b)] = 0
    return int((b[at] == a).sum())


def class_of(shingles: np.ndarray) -> int:
    """A 64-bit hash of a set that isn't empty."""
    total = _text.mix(shingles ^ np.uint64(0x6A09E667F3BCC909)).sum(dtype=np.uint64) ^ np.uint64(len(shingles))
    return int(_text.mix(np.array([total], np.uint64)).view(np.int64)[0])


def shingle_sketch(docs: DataFrame, text_col: str, n: int) -> np.ndarray:
    """How many documents hold a shingle of each cell: 2**SKETCH_BITS counts whatever the input, summed in rounds of SUM_ROWS
    parts."""
    size, n_parts = 1 << SKETCH_BITS, max(1, docs.select(text_col).rdd.getNumPartitions())

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums = np.zeros(size, np.int64)
        for batch in batches:
            for own in _text.shingle_sets(batch.column(0), n):
                np.add.at(sums, own >> np.uint64(64 - SKETCH_BITS), 1)
        part = TaskContext.get().partitionId()
        for a in range(0, size, SKETCH_CHUNK):
            chunk = sums[a : a + SKETCH_CHUNK]
            if chunk.any():
                yield pa.RecordBatch.from_arrays([pa.array([a]), pa.array([part], pa.int64()), pa.array([chunk.tobytes()], pa.binary())], ["chunk", "part", "counts"])

    def add(pdf: pd.DataFrame) -> pd.DataFrame:
        total = sum(np.frombuffer(x, np.int64) for x in pdf["counts"])
        return pd.DataFrame({"chunk": [int(pdf["chunk"].iloc[0])], "part": [int(pdf["part"].iloc[0])], "counts": [total.tobytes()]})

    schema = "chunk long, part long, counts binary"
    sums = docs.select(text_col).mapInArrow(count, schema)
    while True:
        sums = sums.withColumn("part", F.floor(F.col("part") / SUM_ROWS)).groupBy("chunk", "part").applyInPandas(add, schema)
        n_parts = -(-n_parts // SUM_ROWS)
        if n_parts == 1:
            break
    out = np.zeros(size, np.int64)
    for chunk, _, counts in sums.collect():  # of fixed size
        out[chunk : chunk + SKETCH_CHUNK] = np.frombuffer(counts, np.int64)
    return np.minimum(out, np.iinfo(np.int32).max).astype(np.int32)


def signatures(docs: DataFrame, id_col: str, text_col: str, rule: Rule, sketch: np.ndarray) -> DataFrame:
    """(doc, n_shingles, class, min_hash, tokens) of each document."""
    shared = docs.sparkSession.sparkContext.broadcast(sketch)
    seed = np.uint64(0x1234567890ABCDEF)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = shared.value
        for batch in batches:
            sizes, classes, mins, tokens = [], [], [], []
            for own in _text.shingle_sets(batch.column(1), rule.n):
                size = len(own)
                sizes.append(size)
                if not size:
                    classes.append(0), mins.append(0), tokens.append(own)
                    continue
                classes.append(class_of(own))
                mins.append(int(_text.mix(own ^ seed).min().view(np.int64)))
                first = min(size, size - rule.least(size) + SHARED)
                order = np.lexsort((own, counts[own >> np.uint64(64 - SKETCH_BITS)]))[:first]
                tokens.append(own[order])
            offsets = np.concatenate(([0], np.cumsum([len(x) for x in tokens]))).astype(np.int32)
            flat = np.concatenate([*tokens, np.zeros(0, np.uint64)]).view(np.int64)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(sizes, pa.int64()), pa.array(classes, pa.int64()), pa.array(mins, pa.int64()), pa.ListArray.from_arrays(pa.array(offsets), pa.array(flat))], ["doc", "n_shingles", "class", "min_hash", "tokens"])

    return docs.select(F.col(id_col).cast("long"), text_col).mapInArrow(run, "doc long, n_shingles long, class long, min_hash long, tokens array<long>")


def _groups(classes: DataFrame, texts: DataFrame, rule: Rule) -> DataFrame:
    """(class, n_shingles, n_shared, family, group): the pivot of its min-hash where they link, else itself."""
    # The class with most tokens that others hold too is the most usual of its kind.
    pivots = classes.groupBy("min_hash").agg(F.max_by("class", F.struct("n_shared", "class")).alias("pivot"), F.count("*").alias("n_alike")).where(F.col("n_alike") > 1)
    pairs = left_join(classes.select("class", "min_hash"), pivots, ["min_hash"], "n_alike", classes.count(), F.col("class"))
    pairs = pairs.where(F.col("class") != F.col("pivot")).select("class", F.col("class").alias("own"), F.col("pivot").alias("family"))
    members = pivots.select(*[F.col("pivot").alias(x) for x in ("class", "group", "family")], F.lit(0).cast("long").alias("block"))
    linked = _opened(pairs.withColumn("block", F.lit(0).cast("long")), members, texts, rule).select(F.col("a").alias("class"), F.col("b").alias("group"))
    return classes.join(linked, "class", "left").select("class", "n_shingles", "n_shared", "min_hash", "family", F.coalesce("group", "class").alias("group"))


def _candidates(tokens: DataFrame, groups: DataFrame, rule: Rule) -> DataFrame:
    """(class, own, family): the families that a class may link with, by the token-group matrix."""
    parts = groups.groupBy("family", "group").agg(F.count("*").alias("n"))
    families = parts.groupBy("family").agg(F.sum("n").alias("members"), F.max_by("group", F.struct("n", "group")).alias("main"))
    sized = groups.join(families, "family")
    cells = tokens.join(sized, "class").select("token", "class", "n_shingles", "n_shared", F.col("group").alias("own"), F.col("family").alias("home"), F.col("members").alias("home_members"), (F.col("group") == F.col("main")).alias("in_main"))
    matrix = cells.groupBy("token", F.col("home").alias("family"), F.col("home_members").alias("members")).agg(F.min("n_shingles").alias("low"), F.max("n_shingles").alias("high"), F.max("n_shared").alias("most"), F.count("*").alias("held"))
    size = F.col("n_shingles")
    fits = (F.col("high") * rule.den >= size * rule.num) & (F.col("low") * rule.num <= size * rule.den)
    # Of two families the members of the smaller one ask the larger one. Within a family all but its largest group ask, by
    # tokens that another member holds too.
    larger = (F.col("members") > F.col("home_members")) | (F.col("members") == F.col("home_members")) & (F.col("family") < F.col("home"))
    asks = F.when(F.col("family") == F.col("home"), ~F.col("in_main") & (F.col("held") > 1)).otherwise(larger)
    enough = rule.tokens_shared_with(size, F.col("low"), F.col("high"))
    met = cells.join(matrix.hint("merge"), (cells["token"] == matrix["token"]) & asks & fits & (enough <= F.least("n_shared", "most")))
    met = met.groupBy("class", "n_shingles", "own", "family").agg(F.count("*").alias("n"), F.min("low").alias("low"), F.max("high").alias("high"))
    return met.where(F.col("n") >= rule.tokens_shared_with(size, F.col("low"), F.col("high"))).select("class", "own", "family")


def _blocks(members: DataFrame) -> DataFrame:
    """(class, group, family, block, ...): members with their block of BLOCK_MEMBERS, about. Those of equal min-hash share
    blocks, so that blocks of a family differ."""
    many = members.groupBy("family").agg(F.ceil(F.count("*") / BLOCK_MEMBERS).alias("n_blocks"))
    placed = members.join(many, "family").withColumn("block", F.pmod(F.xxhash64("min_hash"), "n_blocks")).drop("n_blocks")
    full = placed.groupBy("family", "block").agg(F.ceil(F.count("*") / BLOCK_MEMBERS).alias("parts"))
    return placed.join(full, ["family", "block"]).withColumn("block", F.col("block") * (1 << 20) + F.pmod(F.xxhash64("class"), "parts")).drop("parts")


def _qualifying(candidates: DataFrame, placed: DataFrame, tokens: DataFrame, rule: Rule) -> DataFrame:
    """(class, own, family, block): the blocks of a family that hold as many tokens of a candidate as it shares at least with a
    set that it links with, by tokens (class, n_shingles, tokens). Only tokens travel; SHELF_BLOCKS blocks, about, are asked at once."""
    own = placed.join(tokens.select("class", "tokens"), "class")
    blocks = own.groupBy("family", "block").agg(F.min("n_shingles").alias("low"), F.max("n_shingles").alias("high"), F.array_distinct(F.flatten(F.collect_list("tokens"))).alias("union"))
    asked = candidates.groupBy("family").agg(F.ceil(F.count("*") / SHELF_QUERIES).alias("copies"))
    shelved = placed.groupBy("family").agg(F.ceil(F.count_distinct("block") / SHELF_BLOCKS).alias("n_shelves")).join(asked, "family")
    shelves = blocks.join(shelved, "family").withColumn("shelf", F.pmod(F.xxhash64("block"), "n_shelves"))
    shelves = shelves.groupBy("family", "shelf", "copies").agg(F.collect_list(F.struct("block", "low", "high", "union")).alias("blocks"))
    shelves = shelves.select("family", "shelf", F.explode(F.sequence(F.lit(0).cast("long"), F.col("copies") - 1)).alias("copy"), F.lit(0).alias("kind"), "blocks")
    queries = candidates.join(tokens, "class").join(shelved, "family").select("family", F.explode(F.sequence(F.lit(0).cast("long"), F.col("n_shelves") - 1)).alias("shelf"), F.pmod(F.xxhash64("class"), "copies").alias("copy"), F.lit(1).alias("kind"), "class", "own", "n_shingles", "tokens")
    rows = queries.unionByName(shelves, allowMissingColumns=True).repartition("family", "shelf", "copy").sortWithinPartitions("family", "shelf", "copy", "kind")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        numbers, low, high, token, of = (np.zeros(0, np.int64) for _ in range(5))
        for batch in batches:
            found: list[tuple] = []
            for i, kind in enumerate(batch.column(0).to_pylist()):
                if kind == 0:
                    held = batch.column(6)[i].as_py()
                    numbers, low, high = (np.array([x[k] for x in held], np.int64) for k in ("block", "low", "high"))
                    token = np.concatenate([np.array(x["union"], np.int64) for x in held])
                    of = np.repeat(np.arange(len(held)), [len(x["union"]) for x in held])
                    order = np.argsort(token, kind="stable")
                    token, of = token[order], of[order]
                    continue
                mine = np.array(batch.column(5)[i].as_py(), np.int64)
                a, b = np.searchsorted(token, mine, "left"), np.searchsorted(token, mine, "right")
                both = np.bincount(gather(of, a, b - a), minlength=len(numbers)) if (b > a).any() else np.zeros(len(numbers), np.int64)
                enough = rule.tokens_shared_at_least(batch.column(4)[i].as_py(), low, high)
                found += [(batch.column(1)[i].as_py(), batch.column(2)[i].as_py(), batch.column(3)[i].as_py(), x) for x in numbers[both >= enough].tolist()]
            yield pa.RecordBatch.from_arrays([pa.array([x[k] for x in found], pa.int64()) for k in range(4)], ["class", "own", "family", "block"])

    return rows.select("kind", "class", "own", "family", "n_shingles", "tokens", "blocks").mapInArrow(run, "class long, own long, family long, block long")


def _opened(candidates: DataFrame, placed: DataFrame, texts: DataFrame, rule: Rule) -> DataFrame:
    """(a, b): groups that a class of one and a class of the other link, from candidates (class, own, family, block), members
    (class, group, family, block) and texts (class, text). Texts travel, a fraction of their sets in size, and become sets where
    they are compared; of rows with equal ids those count whose text is the class's. Of the links that a block shows, those that
    follow from others are left out."""
    asked = candidates.groupBy("family", "block").agg(F.ceil(F.count("*") / TASK_QUERIES).alias("copies"))
    queries = candidates.join(asked, ["family", "block"]).join(texts, "class").select("family", "block", F.pmod(F.xxhash64("class"), "copies").alias("copy"), F.lit(1).alias("kind"), "class", "own", "text")
    blocks = placed.join(asked, ["family", "block"]).join(texts, "class").groupBy("family", "block", "copies").agg(F.collect_list(F.struct("class", "group", "text")).alias("members"))
    blocks = blocks.select("family", "block", F.explode(F.sequence(F.lit(0).cast("long"), F.col("copies") - 1)).alias("copy"), F.lit(0).alias("kind"), "members")
    rows = queries.unionByName(blocks, allowMissingColumns=True).repartition("family", "block", "copy").sortWithinPartitions("family", "block", "copy", "kind")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        block: list[tuple[int, np.ndarray]] = []
        union, joined = np.zeros(0, np.uint64), {}

        def first(group: int) -> int:
            while (above := joined.get(group, group)) != group:
                group = above
            return group

        for batch in batches:
            found = []
            kinds, classes, owns = (batch.column(k).to_pylist() for k in range(3))
            for i, query in enumerate(_text.shingle_sets(batch.column(3), rule.n)):
                if kinds[i] == 0:
                    held = batch.column(4)[i].values
                    of_class, groups = (held.field(k).to_pylist() for k in ("class", "group"))
                    block = [(g, x) for c, g, x in zip(of_class, groups, _text.shingle_sets(held.field("text"), rule.n), strict=True) if len(x) and c == class_of(x)]
                    union, joined = block[0][1] if len(block) == 1 else np.unique(np.concatenate([np.zeros(0, np.uint64), *[x for _, x in block]])), {}
                    continue
                if not len(query) or classes[i] != class_of(query):
                    continue
                own = owns[i]
                if common(query, union) < rule.least(len(query)):
                    continue
                for group, other in block:
                    if first(own) != first(group) and rule.linked(query, other):
                        joined[first(own)] = first(group)
                        found.append((own, group))
            yield pa.RecordBatch.from_arrays([pa.array([x[k] for x in found], pa.int64()) for k in (0, 1)], ["a", "b"])

    return rows.select("kind", "class", "own", "text", "members").mapInArrow(run, "a long, b long").distinct()


def _shared_tokens(classes: DataFrame) -> DataFrame:
    """(token, class, often) of tokens in several classes, kept; others lead nowhere. Tokens are counted where they are read."""
    once = classes.select("class", F.explode("tokens").alias("token"))
    stats = once.groupBy("token").agg(F.count("*").alias("often")).where(F.col("often") > 1)  # a class has a token once
    n_once = classes.agg(F.coalesce(F.sum(F.size("tokens")), F.lit(0))).first()[0]
    tokens = left_join(once, stats, ["token"], "often", n_once, F.col("class")).where(F.col("often").isNotNull())
    return keep(tokens.select("token", "class", "often"), "tokens")


def _kept_texts(docs: DataFrame, involved: DataFrame) -> DataFrame:
    """(class, text) in buckets of their class: later joins don't move them."""
    texts = docs.join(involved.select(F.col("doc").alias("id"), "class").hint("merge"), "id").select("class", "text")
    return keep_buckets(texts, "texts", "class")


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", rule: Rule = Rule()) -> DataFrame:  # noqa: B008
    """(doc, n_shingles, component) of each row."""
    small_batches(docs.sparkSession)
    docs = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    marked = keep(signatures(docs, "id", "text", rule, shingle_sketch(docs, "text", rule.n)), "signatures")
    # Equal classes have equal tokens, so one row of a class has all that is known of it.
    # They lie in buckets of their class, as their tokens are asked for again.
    classes = keep_buckets(marked.where((F.col("n_shingles") > 0) & F.col("doc").isNotNull()).groupBy("class").agg(F.min("doc").alias("doc"), F.count("*").alias("n_class"), F.first("n_shingles").alias("n_shingles"), F.first("min_hash").alias("min_hash"), F.first("tokens").alias("tokens")), "classes", "class", dealt=True)
    of_doc = F.when((F.col("n_shingles") > 0) & F.col("doc").isNotNull(), F.col("class")).alias("class")
    named = keep(marked.select("doc", "n_shingles", of_doc), "named")
    dropped(marked)
    free_shuffles(docs.sparkSession)
    tokens = _shared_tokens(classes)
    free_shuffles(docs.sparkSession)
    shared = tokens.groupBy("class").agg(F.count("*").alias("n_shared"), F.max(F.struct("often", "token"))["token"].alias("family"))
    involved = classes.join(shared, "class").where(F.col("n_shared") >= rule.tokens_shared(F.col("n_shingles")))
    involved = keep(involved.select("class", "doc", "n_shingles", "min_hash", "n_shared", "family"), "involved")
    texts = _kept_texts(docs, involved)
    free_shuffles(docs.sparkSession)
    groups = keep(_groups(involved, texts, rule), "groups")
    free_shuffles(docs.sparkSession)
    candidates = keep(_candidates(tokens.select("token", "class"), groups, rule), "candidates")
    placed = keep(_blocks(groups.select("class", "group", "family", "n_shingles", "min_hash").join(candidates.select("family").distinct(), "family", "left_semi")), "blocks")
    qualifying = keep(_qualifying(candidates, placed, classes.select("class", "n_shingles", "tokens").join(groups.select("class"), "class", "left_semi"), rule), "qualifying")
    roots = components(_opened(qualifying, placed, texts, rule))
    # Nothing reads these any more.
    for table in (texts, tokens, candidates, placed, qualifying):
        dropped(table)
    free_shuffles(docs.sparkSession)
    rooted = groups.select("class", "group").join(roots, groups["group"] == roots["node"], "left").select("class", F.coalesce("root", "group").alias("root"))
    least = rooted.join(classes.select("class", "doc"), "class").groupBy("root").agg(F.min("doc").alias("component"))
    of_class = classes.select("class", "doc", "n_class").join(rooted.join(least, "root").select("class", "component"), "class", "left").select("class", "n_class", F.coalesce("component", "doc").alias("component"))
    out = left_join(named, of_class, ["class"], "n_class", named.count(), F.xxhash64(F.lit("salt"), "doc"))
    return out.select("doc", "n_shingles", F.coalesce("component", "doc").alias("component"))


def query(spark, sf_dir: str) -> DataFrame:
    """op1: every document with the size of its set and its component at 90 %, by 3-word shingles."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return near_duplicates(docs).select(F.col("doc").alias("doc_id"), "n_shingles", F.col("component").alias("component_id"))


SQL = r"""
WITH RECURSIVE words AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents
), sets AS MATERIALIZED (
  SELECT doc_id, list_distinct(CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 3 THEN [array_to_string(w, ' ')]
    ELSE list_transform(range(1, len(w) - 1), lambda i: array_to_string(w[i:i + 2], ' ')) END) AS s FROM words
), items AS MATERIALIZED (
  SELECT doc_id, len(s) AS n, unnest(s) AS item FROM sets
), links AS MATERIALIZED (
  SELECT a.doc_id AS a, b.doc_id AS b FROM items a JOIN items b ON a.item = b.item AND a.doc_id <> b.doc_id
  GROUP BY a.doc_id, b.doc_id HAVING 100 * count(*) >= 90 * (min(a.n) + min(b.n) - count(*))
), reached AS (
  SELECT doc_id, doc_id AS reach FROM documents UNION SELECT r.doc_id, l.b FROM reached r JOIN links l ON r.reach = l.a
)
SELECT doc_id, CAST(len(s) AS BIGINT) AS n_shingles, component_id FROM sets JOIN (SELECT doc_id, min(reach) AS component_id FROM reached GROUP BY doc_id) USING (doc_id)
"""
