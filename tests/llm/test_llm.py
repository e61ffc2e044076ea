"""Every operator against brute force on small fixtures: nulls, empty and long texts, ties, repeated rows, empty tables,
columns with clashing names; and against its SQL on the tables."""

import hashlib
import random
import re
import struct
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from tests.oracle import assert_same
from tidemark.llm import _components, _encode, _mph, _text, block_knn, jaccard_join, language_id, line_dedup, quality_classifier, quality_rules, registry, sentencepiece_codec, source_mixing, suffix_dedup, token_store

WORD = re.compile(r"[^\x20\x09-\x0D]+")
DOCS = "doc_id long, text string, lang string, source string, n_chars long"
NASTY = ["", None, " ", "  a  b 　c   d\n\n x\t\ty", "é à\u0085 z", "it's we'll  don't\r\n<|endoftext|> <s> x", "日本語 テキスト　です", "🙂 🙂  ok​ x", "a\x1c b\x1f c\x7f d e", " lead", "trail  ", "\n\n\n", "12 345  67,8 ...", "a▁b ▁ c▁", "\u0000a", "word " * 3000]
SHARED = "A line that several documents hold."


def documents(spark, texts, extra=""):
    rows = [(i, t, "en", f"s{i % 3}" if i % 5 else None, len(t or "")) for i, t in enumerate(texts)]
    return spark.createDataFrame(rows, DOCS)


def lower(text):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text)


def near_copies(seed, n_bases=6, copies=12, length=60):
    rng = random.Random(seed)
    vocabulary = [f"w{k}" for k in range(400)]
    out = [None, "", "one", "One", "one two", "x y z", "X  y\nz"]
    for _ in range(n_bases):
        base = [rng.choice(vocabulary) for _ in range(rng.choice([8, 30, length, 3 * length]))]
        for _ in range(copies):
            own = list(base)
            for _ in range(rng.choice([0, 1, 1, 2, 3, 6])):
                k = rng.randrange(len(own))
                own[k : k + 1] = rng.choice([[rng.choice(vocabulary)], [], [own[k], "extra"]])
            out.append(" ".join(own))
    rng.shuffle(out)
    return out


def brute_components(texts, n, num, den):
    sets = []
    for t in texts:
        w = WORD.findall(lower(t or ""))
        sets.append({tuple(w[k : k + n]) for k in range(len(w) - n + 1)} if len(w) >= n else {tuple(w)} if w else set())
    root = list(range(len(texts)))

    def find(k):
        while root[k] != k:
            k = root[k]
        return k

    for a in range(len(texts)):
        for b in range(a):
            both = len(sets[a] & sets[b])
            if both and den * both >= num * len(sets[a] | sets[b]):
                x, y = sorted((find(a), find(b)))
                root[y] = x
    return {k: (len(sets[k]), find(k)) for k in range(len(texts))}


@pytest.mark.parametrize("seed,rule", [(1, (3, 90, 100)), (2, (5, 80, 100)), (3, (3, 80, 100))])
def test_jaccard_join(spark, seed, rule):
    texts = near_copies(seed)
    docs = documents(spark, texts).withColumn("class", F.lit("taken")).withColumn("doc", F.lit(1))
    got = {r.doc: (r.n_shingles, r.component) for r in jaccard_join.near_duplicates(docs, rule=jaccard_join.Rule(*rule)).collect()}
    assert got == brute_components(texts, *rule)


def test_jaccard_join_edges(spark):
    assert jaccard_join.near_duplicates(documents(spark, []).limit(0)).count() == 0
    rows = [(None, "a b c d", "en", "s", 1), (4, "a b c d", "en", "s", 1), (4, "a b c d", "en", "s", 1), (9, "a b c d", None, None, None)]
    got = sorted(((r.doc, r.component) for r in jaccard_join.near_duplicates(spark.createDataFrame(rows, DOCS)).collect()), key=str)
    assert got == sorted([(None, None), (4, 4), (4, 4), (9, 4)], key=str)


def test_components(spark):
    links = [(k, k + 1) for k in range(50, 90)] + [(90, 3), (7, 8), (8, 7), (5, 5)]
    got = {r.node: r.root for r in _components.components(spark.createDataFrame(links, "a long, b long")).collect()}
    assert got == {**{k: 3 for k in [3, *range(50, 91)]}, 7: 7, 8: 7}


def test_token_store(spark, tmp_path, monkeypatch):
    import public_tokenizers
    from tokenizers import Tokenizer

    tok = Tokenizer.from_file(public_tokenizers.path(token_store.TOKENIZER))
    texts = [*NASTY, *NASTY[::-1], "a<|endoftext|>b", "<|endoftext|> <|endoftext|>\n\nx  <|endoftext|>", "it's<|endoftext|>'s <|endoftext|>  <|endoftext|>y"] * 2
    path = f"file://{tmp_path}/store"
    token_store.write(documents(spark, texts), path, segment_tokens=50)
    got = {r.doc_id: (r.start, r.n_tokens, r.ids_crc32) for r in token_store.documents(spark, path).collect()}
    stream, want = [], {}
    for k, t in enumerate(texts):
        ids = [*tok.encode(t or "", add_special_tokens=False).ids, 0]
        want[k] = (len(stream), len(ids), zlib.crc32(np.array(ids, "<u4").tobytes()))
        stream += ids
    assert got == want
    some = list(range(0, len(stream), 97))
    found = {r.position: r.token for r in token_store.tokens_at(spark, path, spark.createDataFrame([(k,) for k in some], "position long")).collect()}
    assert [found[k] for k in some] == [stream[k] for k in some]
    # Every position of every segment, one asked 50 times, and positions that no segment has.
    asked = [(k,) for k in range(len(stream))] + [(7,)] * 49 + [(None,), (-1,), (len(stream),)]
    answers = token_store.tokens_at(spark, path, spark.createDataFrame(asked, "position long"))
    assert sorted((r.position, r.token) for r in answers.collect()) == sorted([*enumerate(stream), *[(7, stream[7])] * 49])
    monkeypatch.setattr(token_store, "FEW", 0)
    assert sorted(r.token for r in token_store.tokens_at(spark, path, spark.createDataFrame([(7,), (7,), (8,)], "position long")).collect()) == sorted([stream[7]] * 2 + [stream[8]])
    monkeypatch.undo()
    plan = token_store.tokens_at(spark, path, spark.createDataFrame([(1,)], "position long"))._jdf.queryExecution().toString()
    assert "NestedLoop" not in plan and "Cartesian" not in plan
    token_store.write(documents(spark, []).limit(0), path + "-empty")
    assert token_store.documents(spark, path + "-empty").count() == 0
    token_store.write(spark.createDataFrame([(None, "a"), (1, "b"), (1, "b")], "doc_id long, text string"), path + "-ids")
    assert [r.doc_id for r in token_store.documents(spark, path + "-ids").orderBy("start").collect()] == [None, 1, 1]


def test_codes():
    ids = np.random.default_rng(1).integers(0, 1 << 20, 5000).astype(np.uint32)
    ids[::3] %= 200
    codes = token_store.Codes(token_store.pack(ids))
    assert (codes.all() == ids).all() and [codes[k] for k in range(0, 5000, 7)] == ids[::7].tolist() and len(codes) == 5000
    with pytest.raises(IndexError):
        codes[5000]
    assert len(token_store.Codes(token_store.pack(ids[:0]))) == 0


def test_encoder_forgets_and_learns(monkeypatch):
    encode = token_store._encoder.__wrapped__(token_store.TOKENIZER)
    monkeypatch.setattr(_encode, "CACHE_CHUNKS", 4)
    monkeypatch.setattr(_encode, "LATE_CHUNKS", 2)
    import pyarrow as pa

    for texts in (["a b c d e f g", "h i"], ["b c x", None], ["a b c d e f g"]):
        ids, counts = encode(*_text.text_buffers(pa.array(texts, pa.string())))
        assert len(ids) == counts.sum() == len(re.findall(r"\S+", " ".join(t or "" for t in texts)))


def test_language_id(spark, data):
    docs = spark.read.parquet(f"{data}/documents.parquet")
    got = language_id.query(spark, data).toPandas().merge(docs.select("doc_id", "lang").toPandas(), on="doc_id")
    held = got[got.held_out]
    assert (held.lang == held.lang_pred).mean() > 0.95 and got.score.between(0, 1).all()
    model = language_id.fit(docs, F.lit(True))
    odd = {r.doc_id: (r.lang_pred, r.score) for r in language_id.predict(documents(spark, ["", None, "123 !!", "the and of to in is"]), model).collect()}
    assert odd[0] == odd[1] == odd[2] == ("und", 0.0) and odd[3][0] != "und"
    assert {r.lang_pred for r in language_id.predict(documents(spark, ["abc"]), language_id.fit(docs, F.lit(False))).collect()} == {"und"}
    assert language_id.predict(documents(spark, []).limit(0), model).count() == 0


def test_language_id_tells_texts_of_megabytes(spark):
    docs = spark.read.parquet("/root/testdata/sf0.1/documents.parquet")
    taught = F.crc32(F.col("doc_id").cast("string")) % 4 == 0
    joined = docs.where(~taught & F.col("lang").isNotNull()).groupBy("lang").agg(F.concat_ws("\n", F.array_sort(F.collect_list("text"))).alias("text")).toPandas()
    assert joined.text.str.len().min() > 1_500_000
    model = language_id.fit(docs, taught)
    got = language_id.predict(documents(spark, joined.text.tolist()), model).orderBy("doc_id").toPandas()
    assert got.lang_pred.tolist() == joined.lang.tolist()
    import pyarrow as pa

    (block,) = language_id.texts_grams(pa.array(["the and of to in is", "", "der die und 日本"]))
    assert np.allclose(model.scores(*block), model.landmarks.kernels(*block) @ model.weights)


def test_language_id_takes_exact_n_grams(monkeypatch):
    import pyarrow as pa

    monkeypatch.setattr(language_id, "PIECE_BYTES", 7)
    texts = ["", "a", "Abab\0b", "é日本🙂 The end of it, the END.", None, "xyz" * 40 + "é"]
    for some in (texts, *[[t] for t in texts]):
        got = [(base + r, g) for base, (n, row, gram) in enumerate_blocks(language_id.texts_grams(pa.array(some, pa.string()))) for r, g in zip(row.tolist(), gram.tolist(), strict=True)]
        want = set()
        for k, t in enumerate(some):
            b = lower(t or "").encode()
            want |= {(k, sum((b[s + i] + 1) << 9 * (3 - i) for i in range(n))) for n in range(1, 5) for s in range(len(b) - n + 1)}
        assert sorted(got) == sorted(want)


def enumerate_blocks(blocks):
    at = 0
    for block in blocks:
        yield at, block
        at += block[0]


def passages(seed):
    rng = random.Random(seed)
    piece = lambda n: "".join(rng.choice("abcdefgh é") for _ in range(n))
    shared = [piece(n) for n in (150, 210, 260, 700)]
    out = [None, "", "short", "ab" * 300, "ab" * 300, piece(199)]
    for _ in range(24):
        out.append("".join(piece(rng.choice([0, 5, 90, 300])) + rng.choice(shared) for _ in range(rng.choice([1, 2, 3]))) + piece(rng.choice([0, 50])))
    for _ in range(3):
        whole = piece(500)
        out += [whole, whole[:250] + "X" + whole[250:], whole[20:]]
    return out


def brute_removed(texts, length=200):
    seen = Counter()
    raw = [(t or "").encode() for t in texts]
    for b in raw:
        seen.update(b[s : s + length] for s in range(len(b) - length + 1))
    out = {}
    for k, b in enumerate(raw):
        gone = np.zeros(len(b) + 1, bool)
        for s in range(len(b) - length + 1):
            if seen[b[s : s + length]] > 1:
                gone[s : s + length] = True
        kept = np.frombuffer(b, np.uint8)[~gone[:-1]].tobytes()
        out[k] = (len(b), int(gone.sum()), int((np.diff(gone.astype(int), prepend=0) == 1).sum()), hashlib.sha256(kept).hexdigest())
    return out


def digest(rows):
    return {r.doc_id: (r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in rows.collect()}


@pytest.mark.parametrize("seed,hot,batches", [(1, 2000, 2), (2, 2, 3)])
def test_suffix_dedup(spark, seed, hot, batches):
    texts = passages(seed)
    docs = documents(spark, texts).withColumn("key", F.lit(1)).withColumn("h1", F.lit("x"))
    got = suffix_dedup.dedup_strings(docs, batches=batches, hot=hot)
    assert digest(got) == brute_removed(texts)
    assert all(hashlib.sha256(r.kept).hexdigest() == r.kept_sha256 for r in got.collect())


def test_suffix_dedup_edges(spark):
    assert suffix_dedup.dedup_strings(documents(spark, []).limit(0), batches=1).count() == 0
    long, other = passages(5)[-1], passages(6)[-1]
    rows = spark.createDataFrame([(3, long), (None, long), (4, long[::-1]), (5, other), (5, other), (6, "y" + other), (None, None)], "doc_id long, text string")
    got = sorted(((r.doc_id, r.n_bytes - r.n_removed) for r in suffix_dedup.dedup_strings(rows, batches=1).collect()), key=str)
    assert got == sorted([(3, 0), (None, 0), (4, len(long.encode()[::-1])), (5, 0), (5, 0), (6, 1), (None, 0)], key=str)


def test_suffix_dedup_of_a_text_of_megabytes(spark):
    rng = random.Random(9)
    parts = ["".join(rng.choice("abcdefghijklmnop ") for _ in range(100_000)) for _ in range(30)]
    texts = ["".join(parts), "x" * 50 + parts[20][777:2777] + "y", parts[3][:500], "é" * 600_000]
    got = digest(suffix_dedup.dedup_strings(documents(spark, texts), batches=1))
    assert len(texts[0]) == 3_000_000 and got[0][:3] == (3_000_000, 2500, 2) and got[1][:3] == (2051, 2000, 1) and got[2][1] == 500 and got[3][1] == 1_200_000


def test_index_finds_the_same_in_batches(spark):
    texts = [x for x in passages(8) if x]
    rows = documents(spark, texts).select("doc_id", *suffix_dedup.text_names(F.col("text")), "text")

    def covered(parts, hot):
        index, out = suffix_dedup.Index(spark, hot=hot), defaultdict(set)
        for k in range(parts):
            for r in index.add(rows.where(F.col("doc_id") % parts == k).select("h1", "h2", "text")).collect():
                out[r.h1] |= set(range(r.start, r.end))
        return dict(out), [level.n for level in index.levels]

    whole, one = covered(1, 2000)
    # The only copies of whole texts are those of one text, which a batch counts instead of noting their spans.
    copies = {r.h1 for r in rows.groupBy("h1").count().where("count > 1").collect()}
    for parts, hot in ((5, 2000), (3, 2)):
        batches, levels = covered(parts, hot)
        assert {k: v for k, v in batches.items() if k not in copies} == {k: v for k, v in whole.items() if k not in copies}
        assert len(levels) <= 3 and len(one) == 1


def test_hot_hashes_are_counted_over_all_levels(spark):
    """Each batch has few entries of the hash at the edge of a shared passage, all batches together many."""
    rng = random.Random(4)
    word = lambda n: "".join(rng.choice("abcdefghijklmnopqrst ") for _ in range(n))
    shared = word(260)
    texts = [word(300) + shared + word(300) for _ in range(24)]
    rows = documents(spark, texts).select("doc_id", *suffix_dedup.text_names(F.col("text")), "text")
    index, out = suffix_dedup.Index(spark, hot=8), defaultdict(set)
    for k in range(6):
        for r in index.add(rows.where(F.col("doc_id") % 6 == k).select("h1", "h2", "text")).collect():
            out[r.h1] |= set(range(r.start, r.end))
        held = [old.groupBy("key").count() for old in index.entries()]
        most = held[0].unionByName(held[-1]) if len(held) > 1 else held[0]
        for more in held[1:-1]:
            most = most.unionByName(more)
        assert most.groupBy("key").agg(F.sum("count").alias("n")).agg(F.max("n")).first()[0] <= 8
    assert not index.hot[0].isEmpty() and len(index.levels) <= 3
    removed = {r.h1: brute_removed([r.text])[0] for r in rows.collect()}
    assert set(out) == set(removed) and all(len(x) >= 260 for x in out.values())
    whole = brute_removed(texts)
    assert sorted(len(x) for x in out.values()) == sorted(v[1] for v in whole.values())


def test_hot_hashes_make_few_rows(spark, monkeypatch):
    """Shared passages shorter than, as long as and longer than a window, and near copies, under a low limit: no table has a row for
    each window of the entries of a hot hash."""
    rng = random.Random(12)
    word = lambda n: "".join(rng.choice("abcdefghijklmnopqrst é") for _ in range(n))
    whole, made, read = word(420), [], []
    shared = [word(n)[:n] for n in (150, 190, 240)] + [word(500)]
    texts = [word(rng.choice([0, 40, 250])) + part + word(rng.choice([0, 40, 250])) for part in shared for _ in range(30)]
    texts += [whole[:k] + "#" + whole[k + 1 :] for k in range(0, 420, 14)] + [shared[3][k:] for k in range(0, 120, 12)]
    written, held = suffix_dedup.keep, suffix_dedup.Index._without_hot

    def keep(rows, name):
        out = written(rows, name)
        made.append((name, out.count()))
        return out

    def without_hot(index, rows, *more):
        rows = written(rows, "rows")
        read.append(rows.count())
        return held(index, rows, *more)

    monkeypatch.setattr(suffix_dedup, "keep", keep)
    monkeypatch.setattr(suffix_dedup.Index, "_without_hot", without_hot)
    for batches in (1, 3):
        made.clear(), read.clear()
        assert digest(suffix_dedup.dedup_strings(documents(spark, texts), batches=batches, hot=6)) == brute_removed(texts)
        assert sum(n for name, n in made if name == "hot-entries") > 100
        assert max(n for _, n in made) <= suffix_dedup.FAN * sum(read)


def test_stretches_hold_every_window():
    rng = random.Random(3)
    length, width = 200, 16
    text = bytes(rng.randrange(97, 123) for _ in range(600))
    before, last = [168, 90, 33, 0], [20, 90, 1, 0]
    contexts = [text[300 - a : 300 - b + length] for a, b in zip(before, last, strict=True)]
    row, core, cover, low, high = suffix_dedup.stretches(np.full(4, 5, np.uint64), np.array(before), contexts, width, length)
    got = sorted((r, o) for r, a, b in zip(row.tolist(), low.tolist(), high.tolist(), strict=True) for o in range(a, b + 1))
    assert got == [(r, o) for r in range(4) for o in range(last[r], before[r] + 1)]
    # One text: entries meet in each stretch that both have windows in, and only equal ranges have equal covers.
    assert len(set(core.tolist())) == len(set((low // width).tolist()))
    assert len(set(cover.tolist())) == len(set(zip(low.tolist(), high.tolist(), strict=True)))


def test_a_saved_index_is_opened_again(spark, tmp_path):
    texts = [x for x in passages(8) if x]
    rows = documents(spark, texts).select("doc_id", *suffix_dedup.text_names(F.col("text")), "text")
    batch = lambda k: rows.where(F.col("doc_id") % 3 == k).select("h1", "h2", "text")
    place = "file://" + str(tmp_path / "state")
    for hot in (2000, 2):
        plain = suffix_dedup.Index(spark, hot=hot)
        want = [sorted(plain.add(batch(k)).collect()) for k in range(3)]
        index = suffix_dedup.Index(spark, hot=hot)
        got = [sorted(index.add(batch(k)).collect()) for k in range(2)]
        index.save(f"{place}-{hot}")
        # What another session has: the files, and no table of the catalogue.
        for level in index.levels:
            spark.sql(f"DROP TABLE {level.entries}"), spark.sql(f"DROP TABLE {level.texts}")
        again = suffix_dedup.Index.open(spark, f"{place}-{hot}")
        assert again.levels == index.levels and (again.length, again.hot_contexts) == (200, hot)
        assert [*got, sorted(again.add(batch(2)).collect())] == want
        # The saved state is as it was, though the opened index has merged levels.
        assert sorted(suffix_dedup.Index.open(spark, f"{place}-{hot}").add(batch(2)).collect()) == want[2]


def test_matched_windows():
    rng = random.Random(7)
    for _ in range(20):
        bases = [bytes(rng.choice(b"ab\0") for _ in range(60)) for _ in range(2)]
        keys, n, before, contexts = [], [], [], []
        for _ in range(rng.randint(1, 14)):
            key, text = rng.randrange(2), bytearray(rng.choice(bases))
            for _ in range(rng.randint(0, 2)):
                text[rng.choice([*range(26), *range(34, 60)])] = 99
            a, b = rng.randint(10, 20), rng.randint(40, 50)
            keys.append(key), n.append(rng.choice([1, 1, 2])), before.append(30 - a), contexts.append(bytes(text[a:b]))
        order = sorted(range(len(keys)), key=keys.__getitem__)
        keys, n, before, contexts = ([x[i] for i in order] for x in (keys, n, before, contexts))
        counts = Counter()
        windows = [(i, o, (keys[i], o, c[b - o : b - o + 20])) for i, (c, b) in enumerate(zip(contexts, before, strict=True)) for o in range(b + 1) if len(c) - (b - o) >= 20]
        for i, _, w in windows:
            counts[w] += n[i]
        got = suffix_dedup.matched_windows(np.array(keys, np.uint64), np.array(n), np.array(before), contexts, 20)
        assert sorted(map(tuple, got.tolist())) == sorted((i, o) for i, o, w in windows if counts[w] > 1)


def test_quality_counts(spark):
    rng = random.Random(3)
    clean = " ".join(rng.choice(["alpha", "beta", "gamma", "delta"]) + rng.choice(["ing", "ed", "s", "ly"]) + str(rng.randrange(50)) for _ in range(300))
    noise = " ".join("".join(rng.choice("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/") for _ in range(60)) for _ in range(60))
    texts = NASTY + [clean, clean + "\n" + clean + "\n\n" + clean, noise, "a\nb\na\n \n \nb", "x y z x y z q x y z", " ".join(f"{k % 60}" for k in range(70)), "same words here " * 100]
    got = {r.doc_id: r for r in quality_rules.signals(documents(spark, texts)).collect()}
    for k, text in enumerate(texts):
        t = text or ""
        w = WORD.findall(t)
        lines = [x for x in t.split("\n") if WORD.search(x)]
        windows = Counter(tuple(w[i : i + 3]) for i in range(len(w) - 2))
        inside = {i + j for i in range(len(w) - 2) if windows[tuple(w[i : i + 3])] > 1 for j in range(3)}
        r = got[k]
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) == (len(w), sum(map(len, w)), sum(c in "#*$%&|<>" for c in t), len(lines) - len(set(lines)), len(inside))
        assert r.base_failed == (len(w) < 50 or 100 * len(inside) > 50 * len(w)) and not (r.base_failed and r.kept)
    at = len(NASTY)
    assert got[at].kept and not got[at + 1].kept and not got[at + 2].kept
    kept = quality_rules.filter_documents(documents(spark, texts).withColumn("kept", F.lit("x")))
    assert {r.doc_id for r in kept.collect()} == {k for k, r in got.items() if r.kept} and kept.columns[-1] == "kept"
    assert quality_rules.signals(documents(spark, []).limit(0)).count() == 0


def test_sentencepiece(spark):
    docs = documents(spark, NASTY)
    model = sentencepiece_codec.load(sentencepiece_codec.MODEL)
    peer = __import__("sentencepiece").SentencePieceProcessor(model_file=__import__("public_tokenizers").path(sentencepiece_codec.MODEL))
    twice = docs.unionByName(docs).withColumn("n_tokens", F.lit("taken"))
    got = defaultdict(set)
    for r in sentencepiece_codec.digests(twice).collect():
        got[r.doc_id].add((r.n_tokens, r.ids_crc32, r.same_ids, r.round_trip))
    for k, t in enumerate(NASTY):
        ids = peer.encode(t or "")
        assert got[k] == {(len(ids), zlib.crc32(np.array(ids, "<u4").tobytes()), True, (t or "") == sentencepiece_codec.Decoder(model)(np.array(ids, np.uint32)))}
    assert sentencepiece_codec.digests(docs.limit(0)).count() == 0 and sentencepiece_codec.parity(docs.limit(0)).count() == 0
    assert [tuple(r) for r in sentencepiece_codec.parity(docs).select("same_ids", "same_text").distinct().collect()] == [(True, True)]
    back = sentencepiece_codec.decode(sentencepiece_codec.encode(docs.withColumn("token_ids", F.lit("taken"))), "token_ids_")
    assert all(r.decoded == (r.text or "").replace("▁", " ") and r.token_ids == "taken" for r in back.collect())
    assert sentencepiece_codec.encode(documents(spark, []).limit(0)).count() == 0


def test_unigram_models_match_the_library():
    import sentencepiece

    def varint(n):
        out = b""
        while n > 127:
            out, n = out + bytes([n & 127 | 128]), n >> 7
        return out + bytes([n])

    def message(number, body):
        return varint(number << 3 | 2) + varint(len(body)) + body

    pieces = [("<unk>", 0.0, 2), ("<s>", 0.0, 3), ("</s>", 0.0, 3)] + [(p, s, 1) for p, s in (("▁", -2.0), ("▁the", -1.5), ("the", -3.0), ("t", -5.0), ("h", -5.1), ("e", -5.2), ("▁he", -3.3), ("r", -5.5), ("er", -4.0), ("▁there", -2.9))]
    body = b"".join(message(1, message(1, p.encode()) + varint(2 << 3 | 5) + struct.pack("<f", s) + varint(3 << 3) + varint(k)) for p, s, k in pieces)
    body += message(2, varint(3 << 3) + varint(1)) + message(3, varint(3 << 3) + varint(1) + varint(4 << 3) + varint(0) + varint(5 << 3) + varint(1))
    model, peer = sentencepiece_codec.Model.parse(body), sentencepiece.SentencePieceProcessor(model_proto=body)
    assert model.kind == sentencepiece_codec.UNIGRAM and not model.chunks_at_marks
    encode = sentencepiece_codec.encoder(model)
    import pyarrow as pa

    texts = ["the", "there he the", "her  the", "there's", ""]
    ids, counts = encode(*_text.text_buffers(pa.array(texts)))
    assert [x.tolist() for x in np.split(ids, np.cumsum(counts)[:-1])] == [peer.encode(t) for t in texts]


def test_quality_classifier(spark):
    folder = "/root/testdata/sf0.01"
    labels = spark.read.parquet(f"{folder}/labels.parquet").toPandas()
    got = quality_classifier.query(spark, folder).toPandas()
    held = got[got.held_out].merge(labels, on="doc_id")
    assert (held.predicted == held.quality).mean() >= 0.93 and got.score.between(0, 1).all() and len(got) == 1000
    one = spark.createDataFrame([(1, "abc", 1), (2, None, 1), (3, "x", None)], "doc_id long, text string, quality int")
    assert quality_classifier.fit(one)[0] == 1.0 and quality_classifier.fit(one.limit(0))[0] == 0.5
    scores = quality_classifier.predict(documents(spark, ["", None]), *quality_classifier.fit(one)).collect()
    assert [r.score for r in scores] == [1.0, 1.0]
    both = spark.createDataFrame([(1, "good text here", 1), (2, "bad $$$ %%% text", 0), (3, "", 0), (4, None, 1)] * 5, "doc_id long, text string, quality int")
    model, ratios = quality_classifier.fit(both)
    a, b = (r.score for r in quality_classifier.predict(documents(spark, ["good text here", "bad $$$ %%% text"]), model, ratios).orderBy("doc_id").collect())
    assert a > b


def test_minimal_perfect_hash():
    keys = np.unique(np.random.default_rng(2).integers(0, 1 << 63, 20_000, dtype=np.uint64))
    levels = _mph.build(keys)
    places, (values,) = _mph.unpack(_mph.pack(levels, [np.arange(5)]))
    assert sorted(places(keys).tolist()) == list(range(len(keys))) and values.tolist() == [0, 1, 2, 3, 4]
    with pytest.raises(ValueError):
        _mph.build(np.array([1, 1], np.uint64))


def test_line_dedup(spark):
    texts = [None, "", SHARED, f" {SHARED.upper()}\t\nshort\nown line number one, long enough", f"{SHARED}\n{SHARED}\n", "twice held line of some length\nx", "twice held line of some length", "short\n\n", f"é{SHARED}"] + [f"{SHARED}\nmore {k}" for k in range(4)]
    docs = documents(spark, texts)
    docs = docs.unionByName(docs.where("doc_id = 5")).unionByName(docs.where("doc_id = 5")).withColumn("n_lines", F.lit("taken"))
    holders = defaultdict(set)
    key = lambda x: lower(x.strip(" \t\n\v\f\r"))
    for k, t in enumerate(texts):
        for x in (t or "").split("\n"):
            holders[key(x)].add(k)
    out = line_dedup.dedup_lines(docs, shard_keys=1, task_probes=2).collect()
    assert len(out) == len(texts) + 2
    for r in out:
        lines = (texts[r.doc_id] or "").split("\n")
        kept = [x for x in lines if len(key(x)) < 20 or len(holders[key(x)]) < 3 or max(holders[key(x)]) == r.doc_id]
        assert (r.text or "", r.n_lines, r.n_lines_, r.n_dropped_) == ("\n".join(kept), "taken", len(lines), len(lines) - len(kept))
    assert line_dedup.dedup_lines(documents(spark, []).limit(0)).count() == 0


def test_source_mixing(spark):
    docs = documents(spark, [None, "", "a b c"] * 30 + ["word " * 500] + ["x y"] * 60).withColumn("size", F.lit("taken"))
    docs = docs.unionByName(docs.limit(3))
    out = source_mixing.mix(docs, bucket_docs=3)
    rows = out.collect()
    assert len(rows) == docs.count() and all(0 <= r.taken_ <= 2 * r.size_ for r in rows)
    by = defaultdict(int)
    for r in rows:
        by[r.source, r.source_size_, r.target_] += r.taken_
    assert sum(k[2] for k in by) == pytest.approx(1.5 * sum(k[1] for k in by)) and all(abs(v - k[2]) <= 0.5 for k, v in by.items())
    again = {(r.doc_id, r.taken_) for r in source_mixing.mix(docs, bucket_docs=1000).collect()}
    assert again == {(r.doc_id, r.taken_) for r in rows}
    mixed = source_mixing.mixed_documents(docs)
    assert mixed.columns == docs.columns and mixed.count() == sum(r.copies_ for r in rows)
    assert source_mixing.mix(documents(spark, []).limit(0)).count() == 0


def test_block_knn_edges(spark):
    rng = np.random.default_rng(4)
    rows = [(k, rng.normal(size=8).tolist()) for k in range(100)] + [(100 + k, [1.0] * 8) for k in range(40)]
    rows += [(200, None), (220, [0.0] * 8), (240, [None] + [1.0] * 7), (260, [float("nan")] * 8), (280, [float("inf")] + [1.0] * 7), (None, [1.0] * 8), (300, [1.0, 2.0])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>").withColumn("shard", F.lit(1))
    got = defaultdict(list)
    for r in block_knn.search(df, df.where("vec_id % 20 = 0"), shard_rows=30, group_rows=2).orderBy("query_id", "rank").collect():
        got[r.query_id].append((r.vec_id, r.score))
    good = {k: np.array(v, np.float32).astype(float) for k, v in rows[:140]}
    assert set(got) == {k for k in good if k % 20 == 0}
    for q, found in got.items():
        want = sorted(((-float(sum(a * b for a, b in zip(good[q], v, strict=True))), k) for k, v in good.items() if k != q))[:20]
        assert [(k, s) for k, s in found] == [(k, -s) for s, k in want]
    assert block_knn.search(df.limit(0), df.limit(0)).count() == 0


@pytest.mark.parametrize("name", sorted(registry.oracle_sql()))
def test_query_equals_its_sql(spark, data, name):
    assert_same(spark, data, registry.queries()[name], registry.oracle_sql()[name])


def test_pipeline(spark, data):
    import corpus_pipeline

    docs = spark.read.parquet(f"{data}/documents.parquet")
    assert 4 <= len(corpus_pipeline.STAGES) <= 5
    for name, stage in corpus_pipeline.STAGES:
        before = {r.doc_id: r.text for r in docs.collect()}
        out = corpus_pipeline.keep(stage(spark, docs, data), "test-stage")
        rows = out.collect()
        if name == "quality rules":
            assert {r.doc_id for r in rows} == {r.doc_id for r in quality_rules.signals(docs).where("kept").collect()}
        elif name == "line dedup":
            counts = defaultdict(set)
            for k, t in before.items():
                for x in t.split("\n"):
                    counts[lower(x.strip(" \t\n\v\f\r"))].add(k)
            for r in rows:
                held = [x for x in before[r.doc_id].split("\n") for y in [lower(x.strip(" \t\n\v\f\r"))] if len(y) < 20 or len(counts[y]) < 3 or max(counts[y]) == r.doc_id]
                assert r.text == "\n".join(held)
            assert len(rows) == len(before)
        elif name == "near duplicates":
            ids = sorted(before)
            want = brute_components([before[k] for k in ids], 5, 80, 100)
            assert sorted(r.doc_id for r in rows) == [k for n, k in enumerate(ids) if want[n][1] == n]
        elif name == "source mixing":
            copies = Counter(r.doc_id for r in rows)
            assert copies == {r.doc_id: r.copies for r in source_mixing.mix(docs).where("copies > 0").collect()} and all(r.text == before[r.doc_id] for r in rows)
        else:
            peer = __import__("sentencepiece").SentencePieceProcessor(model_file=__import__("public_tokenizers").path(sentencepiece_codec.MODEL))
            assert all(r.token_ids == peer.encode(before[r.doc_id]) for r in rows)
        if name != corpus_pipeline.STAGES[-1][0]:
            assert out.columns == docs.columns
        docs = out


def test_sets_travel_to_qualifying_blocks_only(spark, monkeypatch):
    rng = random.Random(11)
    kinds = [[f"k{k}w{i}" for i in range(40)] for k in range(500)]
    # One frequent shingle makes all classes one family; ten variants of each of 500 kinds are alike, no kinds are.
    texts = []
    for own in kinds:
        for _ in range(10):
            words = list(own)
            words[rng.randrange(10, 40)] = f"x{rng.randrange(10**9)}"
            texts.append(" ".join(["all of them", *words]))
    docs = documents(spark, texts).select(F.col("doc_id").alias("id"), "text")
    rule = jaccard_join.Rule(3, 80, 100)
    rows = jaccard_join.signatures(docs, "id", "text", rule, jaccard_join.shingle_sketch(docs, "text", 3)).selectExpr("class", "n_shingles", "min_hash", "tokens", "doc as `group`", "1L as family").cache()
    placed = jaccard_join._blocks(rows.drop("tokens"))
    candidates = rows.selectExpr("class", "`group` as own", "family")
    sizes = placed.groupBy("block").count().toPandas()["count"]
    found = jaccard_join._qualifying(candidates, placed, rows.select("class", "n_shingles", "tokens"), rule).toPandas()
    kind = {r["class"]: r["group"] // 10 for r in rows.collect()}
    held = {(r["block"], kind[r["class"]]) for r in placed.collect()}
    # Every block with one of its own kind is found, and few others: about ten a class of more than 78 blocks.
    assert {(b, kind[c]) for b, c in zip(found["block"], found["class"], strict=True)} >= held
    assert len(sizes) >= 78 and sizes.max() <= 128 and len(found) <= 12 * 5000 and (5000 * len(sizes)) / len(found) > 6
    monkeypatch.setattr(jaccard_join, "BLOCK_MEMBERS", 5)
    monkeypatch.setattr(jaccard_join, "TASK_QUERIES", 3)
    monkeypatch.setattr(jaccard_join, "SHELF_BLOCKS", 2)
    some = near_copies(21, n_bases=3, copies=40, length=70)
    got = {r.doc: (r.n_shingles, r.component) for r in jaccard_join.near_duplicates(documents(spark, some), rule=rule).collect()}
    assert got == brute_components(some, 3, 80, 100)


def test_hot_keys_join(spark):
    from tidemark.llm._skew import left_join

    left = spark.createDataFrame([(k, 1 if k < 50 else k if k < 90 else None) for k in range(100)], "id long, key long")
    right = spark.createDataFrame([(1, 50, "hot"), (60, 1, "one"), (61, 1, None)], "key long, n long, value string")
    got = {r.id: r.value for r in left_join(left, right, ["key"], "n", 100, F.col("id")).collect()}
    assert got == {k: "hot" if k < 50 else "one" if k == 60 else None for k in range(100)}
