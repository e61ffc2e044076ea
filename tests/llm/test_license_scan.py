"""The notice search against a search without seeds: every run of words, by edit distance."""

import random
import re

import numpy as np
import pytest

from tests.llm.test_llm import documents, lower
from tidemark.llm import license_scan

WORDS = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def words_of(text):
    return WORDS.findall(lower(text or ""))


def distance(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        new = [i]
        for j, y in enumerate(b, 1):
            new.append(min(row[j] + 1, new[j - 1] + 1, row[j - 1] + (x != y)))
        row = new
    return row[-1]


def fewest_edits(words, notice):
    """Over all runs of words whose length allows it."""
    best = None
    for i in range(len(words)):
        for j in range(i, len(words)):
            run = " ".join(words[i : j + 1])
            if len(run) > len(notice.text) + notice.edits:
                break
            if len(run) >= len(notice.text) - notice.edits:
                d = distance(run, notice.text)
                if d <= notice.edits and (best is None or d < best):
                    best = d
    return best


def base_places(words):
    return [(k, n.label) for n in license_scan.BASE for k in range(len(words)) if words[k : k + len(n.text.split())] == n.text.split()]


def mutated(seed, n=60):
    rng = random.Random(seed)
    filler = "the a of license gnu public mit cc by general apache free software rights é 日本 x1 all reserved any person copy".split()
    out = [None, "", "  \n", "é", "cc by", "CC-BY", "mit\nlicense", "xmit license", "mit licenses", "MIT License. MIT license"]
    for _ in range(n):
        parts = []
        for _ in range(rng.randrange(1, 4)):
            parts += [rng.choice(filler) for _ in range(rng.randrange(4))]
            letters = list(rng.choice(license_scan.BASE + license_scan.NOTICES).text)
            for _ in range(rng.choice([0, 0, 1, 1, 2, 3, 5])):
                at = rng.randrange(len(letters))
                letters[at : at + 1] = rng.choice([[], [letters[at], rng.choice("xyé日 ")], [rng.choice("abé ")]])
            parts.append("".join(letters))
        out.append(rng.choice([" ", ", ", "\n"]).join(parts))
    return out


def scanned(spark, texts, **options):
    return {r.doc_id: r for r in license_scan.scan(documents(spark, texts).repartition(3), **options).collect()}


@pytest.mark.parametrize("seed", [1, 2])
def test_finds_what_edit_distance_finds(spark, seed):
    texts = mutated(seed)
    got = scanned(spark, texts)
    for k, text in enumerate(texts):
        words, row = words_of(text), got[k]
        assert row.n_words == len(words)
        assert sorted((m.first_word, m.label) for m in row.matches if m.base) == sorted(base_places(words))
        want, own = {}, {}
        for notice in license_scan.NOTICES:
            edits = fewest_edits(words, notice)
            if edits is not None:
                want[notice.label] = max(want.get(notice.label, 0), 1 - edits / len(notice.text))
        for m in row.matches:
            if not m.base:
                own[m.label] = max(own.get(m.label, 0), m.score)
        assert own == pytest.approx(want), text
        for m in row.matches:
            assert text[m.start : m.end] == m.found
            assert words_of(m.found) == words[m.first_word : m.first_word + m.n_words]


def test_long_texts_ties_repeats_and_an_empty_table(spark):
    notice = license_scan.Notice("own", "all of these words belong together", 3)
    long = "filler words in a row " * 70_000 + "All of theze words, belong  togther!" + " and more" * 10
    texts = [long, "all of these words belong together", "all of these words belong together"]
    got = scanned(spark, texts, notices=(notice,))
    assert [(m.edits, m.first_word, m.n_words) for m in got[0].matches] == [(2, 350_000, 6)]
    assert got[1][1:] == got[2][1:] and got[1].matches[0].score == 1
    assert license_scan.scan(documents(spark, []).limit(0)).count() == 0
    clashing = documents(spark, ["mit license"]).withColumnRenamed("doc_id", "Matches")
    assert license_scan.scan(clashing, keep=("Matches",)).columns == ["Matches", "n_words_", "matches_"]


def test_bad_notices():
    for bad in (license_scan.Notice("x", "Upper case"), license_scan.Notice("x", "a  b"), license_scan.Notice("x", "short", 1)):
        with pytest.raises(ValueError):
            license_scan.Scanner((bad,))


def test_slices_keep_documents_apart():
    scanner = license_scan.Scanner(license_scan.BASE)
    data, offsets = np.frombuffer(b"mitlicensemit license", np.uint8), np.array([0, 3, 10, 10, 21])
    counts, found = scanner(data, offsets)
    assert counts.tolist() == [1, 1, 0, 2] and list(found) == [3]


def test_query(spark, data):
    got = {r.doc_id: r for r in license_scan.query(spark, data).collect()}
    for doc in spark.read.parquet(f"{data}/documents.parquet").collect():
        places = base_places(words_of(doc.text))
        row, firsts = got.pop(doc.doc_id), [k for k, _ in places]
        assert (row.n_words, row.n_base, row.first_word, row.last_word) == (len(words_of(doc.text)), len(places), min(firsts, default=None), max(firsts, default=None))
        assert row.base_labels == ",".join(sorted({x for _, x in places})) and set(row.base_labels.split(",")) <= set(row.labels.split(",")) | {""}
        assert 0 <= row.score <= 1
    assert not got
