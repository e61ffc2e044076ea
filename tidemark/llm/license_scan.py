"""Operator 11: fuzzy search for short license notices.

Texts become words [^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+ with A-Z lower-cased, joined by single spaces. A notice with up to k edits is
split into k + 1 pieces, one of which any match holds exactly (pigeonhole). One automaton over all pieces finds these seeds; each
seed's window goes to the regex library, whose bounded-error matching verifies the notice and counts its edits (in code points).
Matches begin and end at words. Notices with k = 0, the base phrases among them, are their own only seed.

Matches of one notice with k > 0 that overlap count once, the one with fewer edits, then the first. Null and empty texts have no
words and no matches. Repeated rows give repeated results; an empty table an empty one. Texts are searched whole, however long.
"""

from __future__ import annotations

import functools
from collections import defaultdict
from collections.abc import Iterator
from dataclasses import dataclass

import ahocorasick
import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidemark.llm import _text
from tidemark.llm._store import small_batches


@dataclass(frozen=True)
class Notice:
    """text: lower-case words with single spaces; edits: how many insertions, deletions and substitutions may be in it."""

    label: str
    text: str
    edits: int = 0
    base: bool = False


#: Fixed values of the contract: base phrases and their labels.
BASE = (
    Notice("gpl", "gnu general public license", base=True),
    Notice("apache", "apache license", base=True),
    Notice("cc-by", "cc by", base=True),
    Notice("mit", "mit license", base=True),
)
#: Short notices as licenses word them. Some letters may differ: fewer where another notice is near, five at most, so that the
#: pieces of a long notice are long and rare.
NOTICES = (
    Notice("gpl", "gnu general public license", 2),
    Notice("gpl", "this program is free software you can redistribute it and or modify it under the terms of the gnu general public license", 5),
    Notice("lgpl", "gnu lesser general public license", 3),
    Notice("agpl", "gnu affero general public license", 3),
    Notice("apache", "licensed under the apache license version 2 0", 3),
    Notice("apache", "apache license", 1),
    Notice("mit", "released under the mit license", 2),
    Notice("mit", "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files", 5),
    Notice("bsd", "redistribution and use in source and binary forms with or without modification are permitted", 4),
    Notice("mpl", "mozilla public license", 2),
    Notice("isc", "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted", 5),
    Notice("epl", "eclipse public license", 2),
    Notice("bsl", "boost software license", 2),
    Notice("unlicense", "this is free and unencumbered software released into the public domain", 3),
    Notice("cc-by", "creative commons attribution", 2),
    Notice("cc-by-nc", "creative commons attribution noncommercial", 3),
    Notice("cc-by-sa", "creative commons attribution sharealike", 3),
    Notice("cc-by-nc", "licensed under cc by nc 4 0", 1),
    Notice("cc-by-sa", "licensed under cc by sa 4 0", 1),
    Notice("cc0", "cc0 1 0 universal", 1),
    Notice("proprietary", "all rights reserved", 1),
)
#: Windows and notices whose verdict a worker remembers: notices repeat over documents.
REMEMBERED = 100_000
MATCH = "struct<label:string,base:boolean,edits:int,score:double,first_word:long,n_words:int,start:long,end:long,found:string>"

_WORD = np.zeros(256, bool)
_WORD[list(range(48, 58)) + list(range(97, 123)) + list(range(128, 256))] = True
_FOLD = np.arange(256, dtype=np.uint8)
_FOLD[65:91] += 32


def pieces(notice: Notice) -> list[tuple[int, str]]:
    """(offset, piece) of edits + 1 pieces of nearly equal length."""
    k, n = notice.edits + 1, len(notice.text)
    cuts = [n * i // k for i in range(k + 1)]
    return [(a, notice.text[a:b]) for a, b in zip(cuts, cuts[1:], strict=False)]


class Scanner:
    """Searches slices of texts for a set of notices."""

    def __init__(self, notices: tuple[Notice, ...]):
        self.notices = notices
        seeds: dict[str, list[tuple[int, int]]] = defaultdict(list)
        for k, notice in enumerate(notices):
            if not notice.text.isascii() or " ".join(regex.findall(r"[0-9a-z]+", notice.text)) != notice.text:
                raise ValueError(f"a notice is lower-case ASCII words with single spaces: {notice.text!r}")
            if 9 * notice.edits > len(notice.text):
                raise ValueError(f"at most a ninth of a notice may differ: {notice.text!r}")
            for offset, piece in pieces(notice):
                seeds[piece].append((k, offset))
        self.seeds = ahocorasick.Automaton()
        for piece, uses in seeds.items():
            self.seeds.add_word(piece, (len(piece), uses))
        self.seeds.make_automaton()
        self.patterns = [regex.compile(rf"(?b)(?<= )(?:{regex.escape(n.text, literal_spaces=True)}){{e<={n.edits}}}(?= )") for n in notices]
        self.verdicts: dict[tuple[int, str], tuple[int, int, int] | None] = {}

    def _verified(self, k: int, window: str) -> tuple[int, int, int] | None:
        """(start, end, edits) in bytes of the best match in a window of whole words with a space before each and after the last."""
        key = (k, window)
        if key not in self.verdicts:
            if len(self.verdicts) >= REMEMBERED:
                self.verdicts.clear()
            text = window.encode("latin-1").decode()
            found = self.patterns[k].search(text)
            self.verdicts[key] = found and (len(text[: found.start()].encode()), len(text[: found.end()].encode()), sum(found.fuzzy_counts))
        return self.verdicts[key]

    def _exact(self, words: str, k: int, at: int) -> bool:
        return words[at - 1] in " \n" and words[at + len(self.notices[k].text)] in " \n"

    def _windows(self, words: str, k: int, seeds: list[tuple[int, int]]) -> Iterator[tuple[int, int, int]]:
        """(start, end, edits) of the matches of a notice, by its seeds: (where it would begin, where the seed is)."""
        notice, last, bounds = self.notices[k], -1, (0, -1)
        slack, n = 4 * notice.edits, len(self.notices[k].text)
        for place, seed in sorted(seeds):
            if last <= place <= last + notice.edits and bounds[0] <= seed < bounds[1]:
                continue  # the window of `last` reaches as far
            low, high = max(0, place - slack - 1), min(len(words), place + n + notice.edits + slack + 2)
            # No window reaches into another document.
            low = max(low, words.rfind("\n", low, seed))
            line = words.find("\n", seed, high)
            high = line + 1 if line >= 0 else high
            last, bounds = place, (low, high)
            # Matches begin and end at words: whole words only.
            first = min((x for x in (words.find(" ", low, high), words.find("\n", low, high)) if x >= 0), default=high)
            end = max(words.rfind(" ", low, high), words.rfind("\n", low, high))
            if end <= first:
                continue
            found = self._verified(k, f" {words[first + 1 : end]} ")
            if found:
                yield first + found[0], first + found[1], found[2]

    def __call__(self, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, dict[int, list[tuple]]]:
        """How many words each text has, and of texts with matches (notice, edits, first word, words, first and last byte)."""
        low = _FOLD[data]
        word = np.zeros(len(data) + 1, bool)
        word[:-1] = _WORD[low]
        begins = word[:-1].copy()
        begins[1:] &= ~word[:-2]
        begins[offsets[:-1][np.diff(offsets) > 0]] |= word[offsets[:-1][np.diff(offsets) > 0]]
        starts = np.flatnonzero(begins)
        firsts = np.searchsorted(starts, offsets)
        counts = np.diff(firsts)
        if not len(starts):
            return counts, {}
        marks = np.full(len(starts), 32, np.uint8)
        marks[firsts[:-1][counts > 0]] = 10
        rank = np.cumsum(word[:-1])
        # A mark comes before each word, a line end after the last.
        words = np.insert(low[word[:-1]], rank[starts] - 1, marks).tobytes().decode("latin-1") + "\n"
        word_at = rank[starts] - 1 + np.arange(len(starts)) + 1
        places: dict[int, list[tuple[int, int]]] = defaultdict(list)
        for end, (size, uses) in self.seeds.iter(words):
            for k, offset in uses:
                places[k].append((end + 1 - size - offset, end + 1 - size))
        found: dict[int, list[tuple]] = defaultdict(list)
        lengths = np.diff(np.append(word_at, len(words))) - 1
        for k, own in places.items():
            notice = self.notices[k]
            if not notice.edits:
                spans = [(p, p + len(notice.text), 0) for p, _ in sorted(own) if self._exact(words, k, p)]
            else:
                spans = []
                for span in sorted(set(self._windows(words, k, own))):
                    if spans and span[0] < spans[-1][1]:
                        if span[2] < spans[-1][2]:
                            spans[-1] = span
                    else:
                        spans.append(span)
            for a, b, edits in spans:
                first, last = (int(np.searchsorted(word_at, x, "right")) - 1 for x in (a, b - 1))
                doc = int(np.searchsorted(firsts, first, "right")) - 1
                found[doc].append((k, edits, first - int(firsts[doc]), last - first + 1, int(starts[first]), int(starts[last] + lengths[last])))
        return counts, found


@functools.lru_cache(maxsize=4)
def _scanner(notices: tuple[Notice, ...]) -> Scanner:
    """One for each Python worker."""
    return Scanner(notices)


def scan(docs: DataFrame, text_col: str = "text", notices: tuple[Notice, ...] = BASE + NOTICES, keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """The columns `keep` of each document with n_words and matches: an array of label, base, edits, score (1 less the share of
    edits), first_word and n_words (from 0), start and end (code points of the text) and the words as found, in order of start.
    The added columns get underscores if their names are taken."""
    small_batches(docs.sparkSession)
    names = ["n_words", "matches"]
    while {x.lower() for x in names} & {x.lower() for x in keep}:
        names = [x + "_" for x in names]
    own = docs.select(*keep, F.col(text_col).alias("text__"))
    schema = T.StructType([*own.schema.fields[:-1], T.StructField(names[0], T.LongType())]).add(names[1], T.DataType.fromDDL(f"array<{MATCH}>"))
    match_type = pa.struct([("label", pa.string()), ("base", pa.bool_()), ("edits", pa.int32()), ("score", pa.float64()), ("first_word", pa.int64()), ("n_words", pa.int32()), ("start", pa.int64()), ("end", pa.int64()), ("found", pa.string())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        search = _scanner(notices)
        for batch in batches:
            data, offsets = _text.text_buffers(batch.column(batch.num_columns - 1))
            n_words, matches = [], []
            for a, b in _text.slices(offsets):
                part = data[offsets[a] : offsets[b]]
                counts, found = search(part, offsets[a : b + 1] - offsets[a])
                n_words.append(counts)
                for k in range(b - a):
                    if k not in found:
                        matches.append([])
                        continue
                    at = int(offsets[a + k] - offsets[a])
                    points = np.concatenate(([0], np.cumsum((part[at : int(offsets[a + k + 1] - offsets[a])] & 0xC0) != 0x80)))
                    rows = []
                    for notice, edits, first, n, start, end in sorted(found[k], key=lambda x: (x[4], x[5], x[0])):
                        x = notices[notice]
                        rows.append((x.label, x.base, edits, 1 - edits / len(x.text), first, n, int(points[start - at]), int(points[end - at]), part[start:end].tobytes().decode()))
                    matches.append([dict(zip(("label", "base", "edits", "score", "first_word", "n_words", "start", "end", "found"), r, strict=True)) for r in rows])
            total = np.concatenate([*n_words, np.zeros(0, np.int64)]).astype(np.int64)
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.array(total), pa.array(matches, pa.list_(match_type))], schema.names)

    return own.mapInArrow(run, schema)


def joined_labels(matches: Column) -> Column:
    """The distinct labels of matches, sorted and joined by commas."""
    return F.array_join(F.array_sort(F.array_distinct(F.transform(matches, lambda m: m["label"]))), ",")


def query(spark, sf_dir: str) -> DataFrame:
    """op11: every document with the places of the base phrases and all labels."""
    found = scan(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    base = F.filter("matches", lambda m: m["base"])
    firsts = F.transform(base, lambda m: m["first_word"])
    score = F.coalesce(F.array_max(F.transform("matches", lambda m: m["score"])), F.lit(0.0))
    return found.select(
        "doc_id", "n_words", F.size(base).cast("long").alias("n_base"), F.array_min(firsts).alias("first_word"), F.array_max(firsts).alias("last_word"),
        joined_labels(base).alias("base_labels"), joined_labels(F.col("matches")).alias("labels"), score.alias("score"),
    )
