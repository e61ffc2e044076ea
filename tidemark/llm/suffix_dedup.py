"""Operator 4: removal of long repeated strings by a logarithmic family of sparse suffix arrays.

A byte goes if a string of `length` bytes that covers it also starts anywhere else, in any document.

1. Equal texts are one text with a number of copies. Texts come in batches (BATCHES of them for a whole table).
2. Every window of `length` bytes has one anchor, the smallest hash among its K-byte strings, so equal windows have equal
   anchors at equal places. The suffixes at anchors are those that the index holds, about one in 85 bytes; the bytes that an
   anchor's windows cover are its context. Equal contexts are one entry with their number.
3. A batch's entries, in order of the hash of the K bytes and of the context, are its suffix array. It is a level of the index:
   a table in buckets of that order in the shared folder. `add` merge-scans the batch's array against itself and against every
   level, by joins that move neither side, for entries with equal beginnings. Before that, levels of like size become one, with
   their texts, so that there are as many as the logarithm of the number of batches. A saved index is opened again by its path.
4. Entries met with equal contexts match wholly. Of the others the bytes are read, and a task puts those of its hashes in order
   of their following bytes and in order of their preceding bytes. Two entries share the window that begins o bytes before the
   anchor if no neighbour between them in the first order has a common prefix below length - o and none in the second one below
   o, so one pass over both arrays of common prefixes for each o finds every match, without pairs. Matches of either side are
   noted: those of the batch and those of older texts.
5. A hash with more than HOT entries in all (the edge of a passage that very many documents share) would fill a task. Its
   windows are cut by o into FAN stretches: the windows of a stretch share a core, longer than the K bytes, by whose hash the
   entries part. Those that agree in all that the stretch covers match wholly and go on as one; of the others, cores with HOT
   entries or fewer are compared as in step 4, and those with more are cut again, down to stretches of one window.
6. Spans go to their texts, which drop them, and what is left to the documents. A text with copies goes whole.

Rows with null ids count as any other. Null and empty texts have no bytes; texts shorter than `length` neither lose bytes nor
match. Repeated rows are documents of their own, so each is a copy of the others. An empty table gives an empty result. Texts,
contexts, and stretches of hot hashes are known by 64-bit hashes (two for texts); matches of step 4 are compared byte by byte.
"""

from __future__ import annotations

import functools
import hashlib
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tidemark.llm import _text
from tidemark.llm._skew import left_join
from tidemark.llm._store import drop_table, dropped, folders, give_back, keep, keep_table, released, small_batches

LENGTH, K = 200, 32
#: Batches of a whole table; entries of one hash, in a batch and all levels, that a task compares at most.
BATCHES, HOT = 4, 2000
#: Stretches that the windows of a hot hash, and longer stretches, are cut into.
FAN = 4
#: Entries that a task compares at once, about; bytes of texts that are cut into anchors at once.
BLOCK, SLICE = 8192, 1 << 19
#: Levels become one where the older has less than this many times the entries of the newer.
LIKE = 1.5
TEXT, ENTRY = ["h1", "h2"], ["h1", "h2", "first", "last", "anchor"]


def anchors(data: np.ndarray, offsets: np.ndarray, length: int = LENGTH, k: int = K) -> tuple[np.ndarray, ...]:
    """(hash, owner, first window, last window, anchor) of each anchor of some documents; places count from the start of
    `data`."""
    none = tuple(np.zeros(0, t) for t in (np.uint64, np.int64, np.int64, np.int64, np.int64))
    n, width = len(data), length - k + 1
    if n < length:
        return none
    sums = np.zeros(n + 1, np.uint64)
    np.cumsum(_text.BYTE_VALUES[data] * _text.powers(_text.BASE, n), out=sums[1:])
    grams = _text.mix((sums[k:] - sums[:-k]) * _text.powers(_text.BASE_INVERSE, n - k + 1))
    bits = np.uint64(max(20, int(n).bit_length()))
    value = (grams >> bits << bits) | np.arange(len(grams), dtype=np.uint64)
    blocks = np.full(-(-len(value) // width) * width, np.iinfo(np.uint64).max, np.uint64)
    blocks[: len(value)] = value
    blocks = blocks.reshape(-1, width)
    ahead = np.minimum.accumulate(blocks, axis=1).reshape(-1)
    behind = np.minimum.accumulate(blocks[:, ::-1], axis=1)[:, ::-1].reshape(-1)
    n_windows = n - length + 1
    best = np.minimum(behind[:n_windows], ahead[width - 1 : width - 1 + n_windows]) & ((np.uint64(1) << bits) - np.uint64(1))
    best = best.astype(np.int64)
    starts = np.arange(n_windows)
    owner = np.searchsorted(offsets, starts, "right") - 1
    inside = starts + length <= offsets[owner + 1]
    starts, best, owner = starts[inside], best[inside], owner[inside]
    if not len(starts):
        return none
    new = np.concatenate(([True], (best[1:] != best[:-1]) | (owner[1:] != owner[:-1])))
    first = np.flatnonzero(new)
    last = np.append(first[1:], len(starts)) - 1
    return grams[best[first]], owner[first], starts[first], starts[last], best[first]


def _merged(starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The union of spans, as maximal runs."""
    order = np.argsort(starts, kind="stable")
    starts, reach = starts[order], np.maximum.accumulate(ends[order])
    new = np.concatenate(([True], starts[1:] > reach[:-1]))
    return starts[new], reach[np.append(np.flatnonzero(new)[1:], len(starts)) - 1]


def _padded(parts: list[bytes], width: int) -> tuple[np.ndarray, np.ndarray]:
    counts = np.array([len(x) for x in parts], np.int64)
    return np.frombuffer(b"".join(x.ljust(width, b"\0") for x in parts), np.uint8).reshape(-1, width), counts


def text_names(text: Column) -> list[Column]:
    """The two hashes that name a text."""
    return [F.xxhash64(text).alias("h1"), F.xxhash64(F.lit("second"), text).alias("h2")]


def distinct_texts(docs: DataFrame, length: int) -> DataFrame:
    """(h1, h2, text, copies) of the texts of at least `length` bytes, from rows (h1, h2, text)."""
    long = docs.where(F.octet_length("text") >= length)
    return long.groupBy("h1", "h2").agg(F.first("text").alias("text"), F.count("*").alias("copies"))


def _anchor_rows(texts: DataFrame, length: int) -> DataFrame:
    """(key, context, h1, h2, first, last, anchor, n, copies, spans): a row for each distinct context of a text; one with spans
    for what repeats within it."""
    names = ["key", "context", *ENTRY, "n", "copies", "spans"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, offsets = _text.text_buffers(batch.column(2))
            h1, h2, copies = (batch.column(k).to_numpy() for k in (0, 1, 3))
            for a, b in _text.slices(offsets, SLICE):
                part, at = data[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a]
                key, owner, first, last, anchor = anchors(part, at, length)
                if not len(key):
                    continue
                context = _text.span_hashes(part, first, last + length) ^ _text.mix((anchor - first).astype(np.uint64) + np.uint64(1))
                context ^= _text.mix(key)
                local = _text.mix(owner.astype(np.uint64) + np.uint64(1)) + context
                _, rows, place, times = np.unique(local, return_index=True, return_inverse=True, return_counts=True)
                again, base, text = times[place] > 1, at[owner], a + owner
                out = [key[rows].view(np.int64), context[rows].view(np.int64), h1[text[rows]], h2[text[rows]]]
                out += [(x - base)[rows] for x in (first, last, anchor)] + [times * copies[text[rows]], copies[text[rows]]]
                spans: list[bytes | None] = [None] * len(rows)
                for own in np.unique(owner[again]).tolist():
                    mine = again & (owner == own)
                    s, e = _merged(first[mine] - at[own], last[mine] + length - at[own])
                    spans.append(np.stack([s, e], 1).astype("<i8").tobytes())
                    extra = (0, 0, h1[a + own], h2[a + own], 0, 0, 0, 0, copies[a + own])
                    out = [np.append(c, np.int64(x)) for c, x in zip(out, extra, strict=True)]
                yield pa.RecordBatch.from_arrays([*(pa.array(x, pa.int64()) for x in out), pa.array(spans, pa.binary())], names)
        give_back()

    schema = ", ".join(f"{x} long" for x in names[:-1]) + ", spans binary"
    return texts.select("h1", "h2", "text", "copies").mapInArrow(run, schema)


def _unpacked(rows: DataFrame) -> DataFrame:
    """(h1, h2, start, end) of rows with spans."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            spans = [np.frombuffer(x, "<i8").reshape(-1, 2) for x in batch.column(2).to_pylist()]
            at = pa.array(np.repeat(np.arange(len(spans)), [len(x) for x in spans]))
            both = np.concatenate([*spans, np.zeros((0, 2), np.int64)])
            yield pa.RecordBatch.from_arrays([batch.column(0).take(at), batch.column(1).take(at), pa.array(both[:, 0]), pa.array(both[:, 1])], ["h1", "h2", "start", "end"])

    return rows.select("h1", "h2", "spans").mapInArrow(run, "h1 long, h2 long, start long, end long")


def _entries(rows: DataFrame) -> DataFrame:
    """(key, context, n, h1, h2, first, last, anchor): a row a context, with one place where it stands."""
    own = rows.groupBy("key", "context").agg(F.sum("n").alias("n"), F.min(F.struct(*ENTRY)).alias("one"))
    return own.select("key", "context", "n", "one.*")


def common_prefixes(rows: np.ndarray, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(order, common): the order of rows of bytes within each key, keys ascending, and how many bytes each has in common with
    the one before it; -1 for the first of a key."""
    record = np.concatenate([keys.astype(">u8").view(np.uint8).reshape(-1, 8), rows], 1)
    order = np.argsort(np.ascontiguousarray(record).view(np.dtype((np.void, record.shape[1]))).reshape(-1), kind="stable")
    differ = record[order[1:]] != record[order[:-1]]
    common = np.where(differ.any(1), differ.argmax(1) - 8, rows.shape[1])
    return order, np.concatenate(([-1], np.where(common < 0, -1, common)))


def matched_windows(keys: np.ndarray, n: np.ndarray, before: np.ndarray, contexts: list[bytes], length: int) -> np.ndarray:
    """(row, o): the windows of some entries that occur twice among those of equal key. before: where the anchor stands in its
    context, which ends length bytes after the start of the last window; o: how far a window begins before the anchor."""
    right, _ = _padded([x[a:] for x, a in zip(contexts, before.tolist(), strict=True)], length)
    left, _ = _padded([x[:a][::-1] for x, a in zip(contexts, before.tolist(), strict=True)], max(1, int(before.max())))
    least = before - (np.array([len(x) for x in contexts], np.int64) - length)
    by_right, with_next = common_prefixes(right, keys)
    by_left, with_last = common_prefixes(left, keys)
    found = []
    same_right, same_left = (np.zeros(len(keys), np.int64) for _ in range(2))
    for o in range(int(before.max()) + 1):
        own = np.flatnonzero((least <= o) & (o <= before))
        if len(own) < 2 and (not len(own) or n[own[0]] < 2):
            continue
        same_right[by_right] = np.cumsum(with_next < length - o)
        same_left[by_left] = np.cumsum(with_last < o)
        both = same_right[own] * (len(keys) + 1) + same_left[own]
        order = np.argsort(both, kind="stable")
        new = np.concatenate(([True], np.diff(both[order]) != 0))
        total = np.add.reduceat(n[own[order]], np.flatnonzero(new))
        twice = own[order[(total > 1)[np.cumsum(new) - 1]]]
        found.append(np.stack([twice, np.full(len(twice), o)], 1))
    return np.concatenate([*found, np.zeros((0, 2), np.int64)])


def _compared(contexts: DataFrame, length: int) -> DataFrame:
    """(h1, h2, start, end) of entries that occur once, from rows sorted by key within their task."""
    names = ["h1", "h2", "start", "end"]

    def flush(rows: list[tuple]) -> pa.RecordBatch:
        key, n, h1, h2, anchor, first = (np.array([x[k] for x in rows], np.int64) for k in range(6))
        found = matched_windows(key.view(np.uint64), n, anchor - first, [x[6] for x in rows], length)
        found = found[n[found[:, 0]] == 1]
        # Windows next to each other make one span.
        found = found[np.lexsort((found[:, 1], found[:, 0]))]
        if not len(found):
            return pa.RecordBatch.from_arrays([pa.array([], pa.int64())] * 4, names)
        new = np.concatenate(([True], (np.diff(found[:, 0]) != 0) | (np.diff(found[:, 1]) != 1)))
        row, low = found[new].T
        high = found[np.append(np.flatnonzero(new)[1:], len(found)) - 1, 1]
        return pa.RecordBatch.from_arrays([pa.array(x) for x in (h1[row], h2[row], anchor[row] - high, anchor[row] - low + length)], names)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows: list[tuple] = []
        for batch in batches:
            for row in zip(*(batch.column(k).to_pylist() for k in range(7)), strict=True):
                if len(rows) >= BLOCK and rows[-1][0] != row[0]:
                    yield flush(rows)
                    rows = []
                rows.append(row)
        if rows:
            yield flush(rows)
        rows.clear()
        give_back()

    return contexts.select("key", "n", "h1", "h2", "anchor", "first", "bytes").mapInArrow(run, ", ".join(f"{x} long" for x in names))


def stretches(key: np.ndarray, before: np.ndarray, contexts: list[bytes], width: int, length: int) -> tuple[np.ndarray, ...]:
    """(row, core, cover, low, high) of each stretch of `width` values of o that some entries have windows in: the entry, a hash of
    its key and of the bytes that all windows of the stretch hold, one of the bytes that its own ones cover, and its own o."""
    data = np.frombuffer(b"".join(contexts), np.uint8)
    sizes = np.array([len(x) for x in contexts], np.int64)
    least, at = before - (sizes - length), np.cumsum(sizes) - sizes + before
    counts = before // width - least // width + 1
    row = np.repeat(np.arange(len(contexts)), counts)
    begin = (least // width)[row] * width + (np.arange(len(row)) - np.repeat(np.cumsum(counts) - counts, counts)) * width
    end = np.minimum(begin + width - 1, length - K)
    low, high, at = np.maximum(begin, least[row]), np.minimum(end, before[row]), at[row]
    core = _text.span_hashes(data, at - begin, at - end + length) ^ _text.mix(key[row] + (begin * length + end).astype(np.uint64))
    cover = _text.span_hashes(data, at - high, at - low + length) ^ _text.mix((high * length + low).astype(np.uint64) + np.uint64(1))
    return row, core, cover, low, high


def _stretches(contexts: DataFrame, width: int, length: int) -> DataFrame:
    """(key, context, n, h1, h2, first, last, anchor, bytes): the entries cut into stretches, each an entry of its own whose key is
    the hash of its core."""
    names = ["key", "context", "n", *ENTRY]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            key, n, h1, h2, anchor, first = (batch.column(k).to_numpy() for k in range(6))
            parts = batch.column(6).to_pylist()
            row, core, cover, low, high = stretches(key.view(np.uint64), anchor - first, parts, width, length)
            start, end = anchor[row] - high, anchor[row] - low
            own = [parts[r][a:b] for r, a, b in zip(row.tolist(), (start - first[row]).tolist(), (end - first[row] + length).tolist(), strict=True)]
            out = (core.view(np.int64), cover.view(np.int64), n[row], h1[row], h2[row], start, end, anchor[row])
            yield pa.RecordBatch.from_arrays([*(pa.array(x, pa.int64()) for x in out), pa.array(own, pa.binary())], [*names, "bytes"])

    schema = ", ".join(f"{x} long" for x in names) + ", bytes binary"
    return contexts.select("key", "n", "h1", "h2", "anchor", "first", "bytes").mapInArrow(run, schema)


class Level(NamedTuple):
    """Names of the tables of entries and of their texts, and the number of entries."""

    entries: str
    texts: str
    n: int


class Index:
    """Levels of suffix arrays, and the texts that they point into, in the shared folder. `add` gives the spans of `length`
    bytes or more that a batch repeats or makes repeated; together they are those of one batch of all texts. `save` notes where
    the tables are and `open` takes the index up again from there, in another session too."""

    def __init__(self, spark: SparkSession, length: int = LENGTH, hot: int = HOT):
        self.spark, self.length, self.hot_contexts = spark, length, hot
        self.levels: list[Level] = []
        #: Hashes with too many contexts for a task, and their entries.
        self.hot: list[DataFrame] = []
        self.held: list[DataFrame] = []
        #: Tables that a saved state refers to: they stay when levels merge.
        self.saved: set[str] = set()

    def save(self, path: str) -> None:
        """Write the state, a row a table, to a new path. Its tables outlive clean() and later merges of this index."""
        rows = [("settings", str(self.length), str(self.hot_contexts), 0)]
        for level in self.levels:
            made = [self.spark.sql(f"SHOW CREATE TABLE {name}").first()[0] for name in (level.entries, level.texts)]
            rows += [("level", level.entries, made[0], level.n), ("texts", level.texts, made[1], level.n)]
            self.saved |= {level.entries, level.texts}
        for kind, tables in (("hot", self.hot), ("held", self.held)):
            for table in tables:
                (folder,) = folders(table)
                rows.append((kind, folder, ", ".join(f"{c} {t}" for c, t in table.dtypes), 0))
                self.saved.add(folder.rsplit("/", 1)[1].replace("-", "_"))
        released(self.saved)
        numbered = [(k, *row) for k, row in enumerate(rows)]
        self.spark.createDataFrame(numbered, "place int, kind string, name string, made string, n long").coalesce(1).write.parquet(path)

    @classmethod
    def open(cls, spark: SparkSession, path: str) -> Index:
        """The index as it was saved."""
        rows = spark.read.parquet(path).orderBy("place").collect()  # a row a table
        out = cls(spark, int(rows[0].name), int(rows[0].made))
        for row in rows[1:]:
            if row.kind in ("level", "texts"):
                spark.sql(row.made.replace("CREATE TABLE ", "CREATE TABLE IF NOT EXISTS ", 1))
                out.saved.add(row.name)
            else:
                (out.hot if row.kind == "hot" else out.held).append(spark.read.schema(row.made).parquet(row.name))
        out.levels = [Level(a.name, b.name, a.n) for a, b in zip(rows, rows[1:], strict=False) if a.kind == "level"]
        return out

    def texts(self) -> list[DataFrame]:
        return [self.spark.table(level.texts) for level in self.levels]

    def _stored(self) -> list[DataFrame]:
        """The tables of entries. Those of hashes that became hot later stay in them until levels merge: they meet nothing, as no
        newer level has such hashes."""
        return [self.spark.table(level.entries) for level in self.levels]

    def entries(self) -> list[DataFrame]:
        """The entries of each level whose hash isn't hot."""
        return [old.join(self.hot[0], "key", "left_anti") if self.hot else old for old in self._stored()]

    def add(self, docs: DataFrame, more: bool = False) -> DataFrame:
        """(h1, h2, start, end): spans that go, from rows (h1, h2, text) named by text_names. more: another batch follows, which
        gives the matches of hot hashes for this one too."""
        self._merge()
        texts = keep_table(distinct_texts(docs, self.length), "texts", "h1")
        every = [*self.texts(), self.spark.table(texts)]
        rows = keep(_anchor_rows(every[-1], self.length), "anchors")
        found = [_unpacked(rows.where(F.col("spans").isNotNull() & (F.col("copies") == 1)))]
        held = rows.where(F.col("spans").isNull())
        entries, hot = self._without_hot(held)
        name = keep_table(entries, "level", "key", "context")
        level = self.spark.table(name)
        often = (level if hot is None else level.unionByName(hot)).where(F.col("n") > 1).select("key", "context")
        found.append(self._whole(held.where(F.col("copies") == 1).join(often, ["key", "context"], "left_semi")))
        met = keep(self._met(level), "met")
        found.append(self._whole(met.where((F.col("n") == 1) & (F.col("total") > 1))))
        contested = met.where((F.col("low") != F.col("high")) & (F.col("single") == 1) & (F.col("place") == 1)).select("key", F.col("total").alias("n"), *ENTRY)
        found.append(_compared(self._with_bytes(contested, every).repartition("key").sortWithinPartitions("key"), self.length))
        self.levels.append(Level(name, texts, level.count()))
        working = [rows, met]
        if self.held and not more:
            entries = functools.reduce(DataFrame.unionByName, self.held).select("key", "n", *ENTRY)
            found += self._settled(self._with_bytes(entries, every), working)
        spans = keep(functools.reduce(DataFrame.unionByName, found), "spans")
        for table in working:
            dropped(table)
        return spans

    def _drop(self, *tables: str) -> None:
        for table in set(tables) - self.saved:
            drop_table(self.spark, table)

    def _merge(self) -> None:
        """Make one level of the last two, and one table of their texts, as long as they are of like size."""
        while len(self.levels) > 1 and self.levels[-2].n < LIKE * self.levels[-1].n:
            (old, new), rows, texts = self.levels[-2:], self.entries()[-2:], self.texts()[-2:]
            both = keep_table(_entries(rows[0].unionByName(rows[1])), "level", "key", "context")
            whole = keep_table(texts[0].unionByName(texts[1]), "texts", "h1")
            self.levels[-2:] = [Level(both, whole, self.spark.table(both).count())]
            self._drop(*old[:2], *new[:2])

    def _whole(self, rows: DataFrame) -> DataFrame:
        return rows.select("h1", "h2", F.col("first").alias("start"), (F.col("last") + self.length).alias("end"))

    def _met(self, level: DataFrame) -> DataFrame:
        """The entries of a new level and of the older ones that meet an entry of the new one with the same hash: their own
        number `n`, that of their context `total`, the least of the hash `single`, its contexts `low` to `high`. Hashes have a
        bounded number of entries, so windows over them are short."""
        columns = ["key", "context", "n", *ENTRY]
        own = level.select(*columns).join(level.groupBy("key").agg(F.count("*").alias("entries")), "key")
        older = []
        for k, old in enumerate(self._stored()):
            own = own.join(old.select("key").distinct().withColumn(f"in_{k}", F.lit(True)), "key", "left")
            older.append(old.select(*columns).join(level.select("key"), "key", "left_semi"))
        again = functools.reduce(lambda a, b: a | b, [F.col(f"in_{k}").isNotNull() for k in range(len(older))], F.col("entries") > 1)
        rows = functools.reduce(DataFrame.unionByName, older, own.where(again).select(*columns)).repartition("key")
        of_key, of_context = Window.partitionBy("key"), Window.partitionBy("key", "context")
        rows = rows.withColumn("total", F.sum("n").over(of_context)).withColumn("place", F.row_number().over(of_context.orderBy(*ENTRY)))
        return rows.withColumn("single", F.min("total").over(of_key)).withColumn("low", F.min("context").over(of_key)).withColumn("high", F.max("context").over(of_key))

    def _new_hot(self, rows: DataFrame) -> DataFrame:
        """(key): hashes that a batch makes hot. One with too many entries in all has more than an even share of these in the
        batch or in some level, so only such hashes are counted everywhere; levels lie by hash and are counted in place."""
        parts = [part.groupBy("key").agg(F.count("*").alias("held")) for part in (rows, *self._stored())]
        likely = functools.reduce(DataFrame.unionByName, [part.where(F.col("held") > self.hot_contexts / len(parts)).select("key") for part in parts])
        for known in self.hot:
            likely = likely.join(known, "key", "left_anti")
        likely = keep(likely.distinct(), "likely-hashes")
        if likely.isEmpty():
            return likely
        counts = functools.reduce(DataFrame.unionByName, [part.join(likely, "key", "left_semi") for part in parts])
        hot = counts.groupBy("key").agg(F.sum("held").alias("held")).where(F.col("held") > self.hot_contexts).select("key")
        return keep(hot, "hot-hashes")

    def _without_hot(self, rows: DataFrame) -> tuple[DataFrame, DataFrame | None]:
        """The entries of a batch whose hash isn't hot, and those whose hash is. The latter are held, as are older entries with
        hashes that have become hot."""
        new = self._new_hot(rows)
        if not new.isEmpty():
            late = [old.join(new, "key", "left_semi") for old in self._stored()]
            if late:
                self.held.append(keep(functools.reduce(DataFrame.unionByName, late), "hot-entries"))
            # One table of all hot hashes.
            self.hot = [keep(functools.reduce(DataFrame.unionByName, [*self.hot, new]), "hot-hashes")]
        if not self.hot:
            return _entries(rows), None
        hot = keep(_entries(rows.join(self.hot[0], "key", "left_semi")), "hot-entries")
        self.held.append(hot)
        return _entries(rows.join(self.hot[0], "key", "left_anti")), hot

    def _settled(self, rows: DataFrame, working: list[DataFrame]) -> list[DataFrame]:
        """(h1, h2, start, end) of the entries of hot hashes that occur once. Tables that these read are added to `working`."""
        found, width = [], 1
        while width * FAN < self.length:
            width *= FAN
        while width:
            cut = keep(_stretches(rows, width, self.length), "stretches")
            alike = cut.groupBy("key", "context").agg(F.sum("n").alias("n"), F.min(F.struct(*ENTRY, "bytes")).alias("one"))
            left = keep(alike.select("key", "context", "n", "one.*"), "cores")
            often = left.where(F.col("n") > 1).select("key", "context")
            found.append(self._whole(cut.where(F.col("n") == 1).join(often, ["key", "context"], "left_semi")))
            sizes = keep(left.groupBy("key").agg(F.count("*").alias("entries")).where(F.col("entries") > 1), "core-sizes")
            working += [cut, left, sizes]
            full = F.col("entries") > self.hot_contexts
            hot, few = sizes.where(full).select("key"), sizes.where(~full).select("key")
            some = left.join(hot, "key", "left_anti").join(few, "key", "left_semi")
            found.append(_compared(some.repartition("key").sortWithinPartitions("key"), self.length))
            if hot.isEmpty():
                break
            rows, width = left.join(hot, "key", "left_semi"), width // FAN
        return found

    def _with_bytes(self, wanted: DataFrame, texts: list[DataFrame]) -> DataFrame:
        """The rows (key, n, h1, h2, first, last, anchor) with the bytes of their contexts. Texts stay in their buckets."""
        packed = keep(wanted.groupBy("h1").agg(F.collect_list(F.struct("key", "n", *ENTRY)).alias("contexts")), "wanted")
        length, names = self.length, ["key", "n", "h1", "h2", "first", "anchor", "bytes"]

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                rows = []
                for h2, text, contexts in zip(*(batch.column(k).to_pylist() for k in range(3)), strict=True):
                    raw = text.encode()
                    rows += [(c["key"], c["n"], c["h1"], h2, c["first"], c["anchor"], raw[c["first"] : c["last"] + length]) for c in contexts if c["h2"] == h2]
                yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], pa.binary() if k == 6 else pa.int64()) for k in range(7)], names)
            give_back()

        schema = ", ".join(f"{x} long" for x in names[:-1]) + ", bytes binary"
        return functools.reduce(DataFrame.unionByName, [x.join(packed, "h1").select("h2", "text", "contexts").mapInArrow(run, schema) for x in texts])


def _cut(index: Index, spans: DataFrame, with_text: bool) -> DataFrame:
    """(h1, h2, copies, n_removed, n_spans, kept, kept_sha256) of each text that loses bytes; kept is null without text."""
    names = ["h1", "h2", "copies", "n_removed", "n_spans", "kept", "kept_sha256"]
    packed = keep(spans.groupBy("h1").agg(F.collect_list(F.struct("h2", "start", "end")).alias("spans")), "text-spans")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out: list[tuple] = []
            for h1, h2, text, copies, spans in zip(*(batch.column(k).to_pylist() for k in range(5)), strict=True):
                raw = text.encode()
                own = [(0, len(raw))] if copies > 1 else [(x["start"], x["end"]) for x in spans or () if x["h2"] == h2]
                if not own:
                    continue
                both = np.array(own, np.int64)
                s, e = _merged(both[:, 0], both[:, 1])
                kept = b"".join(raw[x:y] for x, y in zip([0, *e.tolist()], [*s.tolist(), len(raw)], strict=True))
                out.append((h1, h2, copies, int((e - s).sum()), len(s), kept if with_text else None, hashlib.sha256(kept).hexdigest()))
            types = (*[pa.int64()] * 5, pa.binary(), pa.string())
            yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in out], t) for k, t in enumerate(types)], names)
        give_back()

    schema = ", ".join(f"{x} long" for x in names[:5]) + ", kept binary, kept_sha256 string"
    return functools.reduce(DataFrame.unionByName, [x.join(packed, "h1", "left").where(F.col("spans").isNotNull() | (F.col("copies") > 1)).select("h1", "h2", "text", "copies", "spans").mapInArrow(run, schema) for x in index.texts()])


def dedup_strings(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", length: int = LENGTH, batches: int = BATCHES, hot: int = HOT, with_text: bool = True) -> DataFrame:
    """(id, n_bytes, n_removed, n_spans, kept bytes, kept_sha256) of each document; kept is null without text."""
    small_batches(docs.sparkSession)
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    plain = docs.select(F.col(id_col).alias("id"), text.alias("text")).select("id", *text_names(F.col("text")), "text")
    index = Index(docs.sparkSession, length, hot)
    spans = [index.add(plain.where(F.pmod("h2", F.lit(batches)) == k).select("h1", "h2", "text"), k < batches - 1) for k in range(batches)]
    for level in index.levels:
        drop_table(docs.sparkSession, level.entries)
    cut = keep(_cut(index, functools.reduce(DataFrame.unionByName, spans), with_text), "cut-texts")
    own = plain.select("id", "h1", "h2", F.octet_length("text").cast("long").alias("n_bytes"), *([F.col("text").cast("binary").alias("whole")] if with_text else [F.lit(None).cast("binary").alias("whole")]), F.sha2(F.col("text").cast("binary"), 256).alias("whole_sha256"))
    done = left_join(own, cut, TEXT, "copies", docs.count(), F.xxhash64(F.lit("salt"), "id", "h1"))
    lost = F.col("n_removed").isNotNull()
    return done.select(F.col("id").alias(id_col), "n_bytes", F.coalesce("n_removed", F.lit(0).cast("long")).alias("n_removed"), F.coalesce("n_spans", F.lit(0).cast("long")).alias("n_spans"), F.when(lost, F.col("kept")).otherwise(F.col("whole")).alias("kept"), F.when(lost, F.col("kept_sha256")).otherwise(F.col("whole_sha256")).alias("kept_sha256"))


def query(spark, sf_dir: str) -> DataFrame:
    """op4: every document with the bytes that repeated strings of 200 bytes cover."""
    return dedup_strings(spark.read.parquet(f"{sf_dir}/documents.parquet"), with_text=False).drop("kept")
