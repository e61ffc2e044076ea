"""The alignment against both libraries, token by token."""

import random
from collections import Counter, defaultdict
from hashlib import sha256

import public_tokenizers
import pytest

from tests.llm.test_llm import NASTY, documents
from tidemark.llm import token_alignment

NUMBERS = ("n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum")


def plain(texts):
    import sentencepiece
    from tokenizers import Tokenizer

    a = Tokenizer.from_file(public_tokenizers.path(token_alignment.A))
    a.encode_special_tokens = True
    b = sentencepiece.SentencePieceProcessor(model_file=public_tokenizers.path(token_alignment.B))
    letters, found, count = token_alignment.byte_letters(), [], Counter()
    for text in texts:
        want = (" " + text).encode() if text else b""
        ids_a, ids_b = (a.encode(" " + text, add_special_tokens=False).ids, b.encode(text)) if text else ([], [])
        raw_a = [bytes(letters[c] for c in a.id_to_token(i)) for i in ids_a]
        raw_b = [bytes([int(b.id_to_piece(i)[3:5], 16)]) if b.is_byte(i) else b.id_to_piece(i).replace("▁", " ").encode() for i in ids_b]
        if not text or b"".join(raw_a) != want or b"".join(raw_b) != want:
            found.append(None)
            continue
        ends = []
        for raw in (raw_a, raw_b):
            at, own = 0, {}
            for k, x in enumerate(raw):
                at += len(x)
                own[at] = k
            ends.append(own)
        cuts = sorted(set(ends[0]) & set(ends[1]))
        links = [(ids_a[ends[0][c]], ids_b[ends[1][c]]) for c in cuts]
        groups, i, j = [], 0, 0
        for c in cuts:
            groups.append(",".join(map(str, ids_a[i : ends[0][c] + 1])) + "|" + ",".join(map(str, ids_b[j : ends[1][c] + 1])))
            i, j = ends[0][c] + 1, ends[1][c] + 1
        count.update(links)
        found.append((len(ids_a), len(ids_b), len(cuts), links, ";".join(groups)))
    best = defaultdict(int)
    for (_, y), n in count.items():
        best[y] = max(best[y], n)
    for x in found:
        if x is None:
            yield (0, 0, 0, 0, 0, 0), "", ""
        else:
            links = x[3]
            yield (*x[:3], len(links), sum(count[p] == best[p[1]] for p in links), sum(count[p] for p in links)), x[4], sha256(x[4].encode()).hexdigest()


def corpus(seed):
    rng = random.Random(seed)
    vocabulary = "Hello hello wörld Straße 日本語 テキスト naïve 12345 3.14 foo_bar don't 🙂 \n \t 　 <s> </s> <unk> <|endoftext|> <0x0A> http://x.y/z ▁ é ﬁ".split(" ")
    out = [*NASTY, "same text", "same text"]
    return out + ["".join(rng.choice(vocabulary) + rng.choice(["", " ", " ", "  "]) for _ in range(rng.randrange(1, 60))) for _ in range(60)]


@pytest.mark.parametrize("common", [token_alignment.COMMON, 40, 1])
def test_equals_the_libraries(spark, common):
    """Whether pairs are sent to the tasks or joined, all counts are the same."""
    texts = corpus(7)
    rows = {r.doc_id: r for r in token_alignment.aligned(documents(spark, texts).repartition(3), groups=True, common=common).collect()}
    for k, want in enumerate(plain(texts)):
        r = rows[k]
        assert (tuple(r[c] for c in NUMBERS), r.groups, r.groups_sha256) == want, texts[k][:80]
    assert sum(r.n_a == 0 for r in rows.values()) >= 3


def test_a_long_text_and_an_empty_table(spark):
    text = "A long text, with some words; and marks.\n" * 40_000
    (row,) = token_alignment.aligned(documents(spark, [text])).collect()
    ((numbers, _, digest),) = plain([text])
    assert (tuple(row[c] for c in NUMBERS), row.groups_sha256) == (numbers, digest)
    empty = token_alignment.aligned(documents(spark, []).limit(0))
    assert empty.count() == 0 and "groups_sha256" in empty.columns


def test_null_ids_and_clashing_columns(spark):
    docs = documents(spark, ["one text", "one text"]).selectExpr("cast(null as long) as row", "text", "lang as pair", "1 as n_a")
    rows = token_alignment.aligned(docs, id_col="row").collect()
    assert len(rows) == 2 and rows[0] == rows[1] and rows[0][0] is None and rows[0].n_links == 2


def test_query(spark, data):
    docs = spark.read.parquet(f"{data}/documents.parquet").orderBy("doc_id").collect()
    rows = {r.doc_id: r for r in token_alignment.query(spark, data).collect()}
    for doc, want in zip(docs, plain([d.text for d in docs]), strict=True):
        assert (tuple(rows[doc.doc_id][c] for c in NUMBERS), rows[doc.doc_id].groups_sha256) == (want[0], want[2])
