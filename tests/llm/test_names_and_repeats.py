"""Columns of the user pass every operator unchanged, whatever their names; repeated rows count; literals stay text."""

import random
import struct

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from tests.llm.test_llm import documents
from tidemark.llm import _text, language_id, line_dedup, quality_classifier, quality_rules, sentencepiece_codec, source_mixing, token_store

#: Names that operators use for columns of their own, in other cases too.
NAMES = ["Size", "N_LINES", "offset", "of", "row", "key", "bucket", "dropped_keys1", "Dropped_Keys2", "copy_number", "STAYS", "Token_ids", "score", "start", "taken", "Kept"]


def named(spark):
    line = "This is one of the lines that all of these documents share, word for word."
    good = quality_rules.signals(spark.read.parquet("/root/testdata/sf0.001/documents.parquet")).where("kept").select("doc_id")
    prose = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").join(good, "doc_id").orderBy("doc_id").limit(14).collect()
    texts = [f"{line}\n{d.text}" for d in prose] + [None, ""]
    docs = documents(spark, texts)
    docs = docs.unionByName(docs.where("doc_id = 3")).unionByName(docs.where("doc_id = 4").withColumn("doc_id", F.lit(None).cast("long")))
    return docs.select("*", *[F.concat(F.lit(f"{n} of "), F.coalesce(F.col("doc_id").cast("string"), F.lit("none"))).alias(n) for n in NAMES])


def values(df):
    return sorted({tuple(r[n] for n in NAMES) for r in df.select(*NAMES).collect()})


@pytest.mark.parametrize("operator", [line_dedup.dedup_lines, source_mixing.mix, sentencepiece_codec.encode, source_mixing.mixed_documents, quality_rules.filter_documents], ids=lambda f: f.__name__)
def test_columns_stay(spark, operator):
    docs = named(spark)
    out = operator(docs)
    assert out.columns[: len(docs.columns)] == docs.columns and len({c.lower() for c in out.columns}) == len(out.columns)
    assert set(values(out)) <= set(values(docs)) and len(values(out)) >= 9


def test_columns_pass_all_stages(spark):
    docs = before = named(spark)
    for name, stage in corpus_pipeline.STAGES[:-1]:
        docs = stage(spark, docs, "")
        assert docs.columns == before.columns, name
        assert set(values(docs)) <= set(values(before)) and docs.count() >= 9, name
    assert corpus_pipeline.STAGES[-1][1](spark, docs, "").count() == docs.count()
    empty = before.limit(0)
    for _, stage in corpus_pipeline.STAGES:
        empty = stage(spark, empty, "")
        assert empty.count() == 0


def test_ids_with_names_of_added_columns(spark, tmp_path):
    docs = documents(spark, ["one two three", None]).withColumnRenamed("doc_id", "Score").withColumn("n_words", F.col("Score")).withColumn("START", F.col("Score"))
    assert quality_rules.signals(docs, id_col="n_words").columns[:2] == ["n_words", "n_words_"]
    assert quality_classifier.predict(docs, 0.5, np.zeros(1), id_col="Score").columns == ["Score", "score_"]
    assert language_id.predict(docs, None, id_col="Score").columns == ["Score", "lang_pred_", "score_"]
    token_store.write(docs, str(tmp_path / "tokens"), id_col="START")
    assert token_store.documents(spark, str(tmp_path / "tokens"), id_col="START").columns == ["START", "start_", "n_tokens_", "ids_crc32_"]


def test_a_classifier_of_repeated_rows(spark):
    rows = [(1, "good text here", 1)] * 3000 + [(2, "bad $$$ %%% text", 0)] * 3000
    model, ratios = quality_classifier.fit(spark.createDataFrame(rows, "doc_id long, text string, quality int").repartition(4))
    scores = [r.score for r in quality_classifier.predict(documents(spark, ["good text here", "bad $$$ %%% text"]), model, ratios).orderBy("doc_id").collect()]
    assert isinstance(model, quality_classifier.Model) and scores[0] > 0.9 and scores[1] < 0.1


def test_weighted_fit_equals_repeated_texts():
    """Dual coordinate descent with weights against the optimality conditions of the repeated problem."""
    rng = np.random.default_rng(3)
    held = [np.flatnonzero(rng.random(40) < 0.3) for _ in range(30)]
    labels, times = (rng.random(30) < 0.5).astype(int), rng.integers(1, 4, 30)
    ratios = rng.normal(size=40)
    one = quality_classifier.fit_arrays(held, labels, ratios, 0.5, epochs=400, times=times)
    again = np.repeat(np.arange(30), times)
    many = quality_classifier.fit_arrays([held[k] for k in again], labels[again], ratios, 0.5, epochs=400)
    assert np.allclose(one.weights, many.weights, atol=2e-2) and abs(one.slope - many.slope) < 0.1

    def loss(m):
        rows = np.array([m.weights[x] @ ratios[x] / np.linalg.norm(ratios[x]) + m.bias for x in held])
        return (m.weights @ m.weights + m.bias**2) / 2 + quality_classifier.COST * (times * np.maximum(0, 1 - np.where(labels > 0, 1, -1) * rows)).sum()

    for _ in range(20):  # no step from the solution lowers the loss
        other = quality_classifier.Model(one.weights + rng.normal(size=40) * 0.02, one.bias + rng.normal() * 0.02, 1, 0)
        assert loss(other) > loss(one) - 1e-6


def test_languages_of_repeated_rows(spark):
    texts = {"en": "the quick brown fox jumps over the lazy dog", "de": "der schnelle braune Fuchs springt über den faulen Hund"}
    rows = [(k, t, lang, "s", 1) for k, (lang, t) in enumerate(texts.items())] * 2000
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").repartition(4)
    model = language_id.fit(docs, F.lit(True), sample=50)
    got = {r.lang_pred for r in language_id.predict(docs.where("doc_id = 1").limit(1), model).collect()}
    assert got == {"de"} and len(model.languages) == 2


def proto(pieces, byte_fallback):
    def varint(n):
        out = b""
        while n > 127:
            out, n = out + bytes([n & 127 | 128]), n >> 7
        return out + bytes([n])

    def message(number, body):
        return varint(number << 3 | 2) + varint(len(body)) + body

    body = b"".join(message(1, message(1, p.encode()) + varint(2 << 3 | 5) + struct.pack("<f", s) + varint(3 << 3) + varint(k)) for p, s, k in pieces)
    trainer = varint(3 << 3) + varint(1) + (varint(35 << 3) + varint(1) if byte_fallback else b"")
    return body + message(2, trainer) + message(3, varint(3 << 3) + varint(1) + varint(4 << 3) + varint(0) + varint(5 << 3) + varint(1))


@pytest.mark.parametrize("byte_fallback", [False, True])
def test_unigram_literals_are_text(byte_fallback):
    import sentencepiece

    pieces = [("<unk>", 0.0, 2), ("<s>", 0.0, 3), ("</s>", 0.0, 3)]
    pieces += [(f"<0x{b:02X}>", 0.0, 6) for b in range(256)] if byte_fallback else []
    pieces += [(p, s, 1) for p, s in (("▁", -2.0), ("▁the", -1.5), ("the", -3.0), ("t", -5.0), ("h", -5.1), ("e", -5.2), ("<", -6.0), (">", -6.1), ("s", -5.5), ("0", -6.3), ("x", -6.4), ("▁he", -3.3))]
    pieces += [("hers", -1.0, 5)]
    body = proto(pieces, byte_fallback)
    encode, peer = sentencepiece_codec.encoder(sentencepiece_codec.Model.parse(body)), sentencepiece.SentencePieceProcessor(model_proto=body)
    rng = random.Random(5)
    parts = ["the", " ", "<s>", "</s>", "<unk>", "<0x0A>", "<0x41>", "\n", "é", "日本", "🙂", "hers", "h", "x0", "▁", "1 <unk>", "0 <s>"]
    texts = ["the <s> the", "<0x0A>", "</s>", "<unk> hers", "", "日本é the"] + ["".join(rng.choice(parts) for _ in range(rng.randrange(1, 9))) for _ in range(200)]
    ids, counts = encode(*_text.text_buffers(pa.array(texts)))
    assert [x.tolist() for x in np.split(ids, np.cumsum(counts)[:-1])] == [peer.encode(t) for t in texts]


def test_user_defined_pieces_raise():
    body = proto([("<unk>", 0.0, 2), ("a", -1.0, 1), ("own", 0.0, 4)], False)
    with pytest.raises(ValueError):
        sentencepiece_codec.Model.parse(body).tokenizer()
