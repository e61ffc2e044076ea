"""The manifest against a plain tree, with small blocks so that there are several tiers."""

from hashlib import sha256

import pytest
from pyspark import cloudpickle
from pyspark.sql import functions as F

from tests.llm.test_llm import DOCS, NASTY
from tests.oracle import assert_same
from tidemark.llm import merkle_manifest


def digest(*parts):
    return sha256("".join(parts).encode()).hexdigest()


def plain_leaf(row):
    return digest(*["-" if v is None else f"{len(str(v).encode())}:{v}" for v in (row.doc_id, row.source, row.lang, row.n_chars, row.text)])


def plain_tree(nodes):
    """(root, siblings of each node level by level)."""
    paths, at, level = [[] for _ in nodes], list(range(len(nodes))), list(nodes)
    while len(level) > 1:
        for k, i in enumerate(at):
            run = level[i // 3 * 3 : i // 3 * 3 + 3]
            paths[k] += [x for j, x in enumerate(run) if j != i % 3]
        level = [digest(*level[i : i + 3]) for i in range(0, len(level), 3)]
        at = [i // 3 for i in at]
    return level[0], paths


def plain_manifest(rows):
    """(id, leaf, subroot, root, proof) of all rows, sorted."""
    groups = {}
    for r in rows:
        groups.setdefault(r.source, []).append((r.doc_id is not None, r.doc_id or 0, plain_leaf(r)))
    order = sorted(groups, key=lambda s: (s is not None, (s or "").encode()))
    trees = {s: plain_tree([x[2] for x in sorted(groups[s])]) for s in order}
    root, upper = plain_tree([trees[s][0] for s in order])
    out = []
    for s, above in zip(order, upper, strict=True):
        for (known, i, leaf), path in zip(sorted(groups[s]), trees[s][1], strict=True):
            out.append((i if known else None, leaf, trees[s][0], root, "".join(path + above)))
    return sorted(out, key=str)


def many(n, n_sources):
    texts = [NASTY[k % len(NASTY)] for k in range(n)]
    source = [None, "é", "a", "a\n", "b"]
    return [(k if k % 17 else None, t, None if k % 7 == 0 else "en", source[k % n_sources] if k % 3 else "hot", None if k % 5 == 0 else len(t or "")) for k, t in enumerate(texts)]


@pytest.fixture
def by_value():
    """Workers get the module's functions with the sizes that a test has set."""
    cloudpickle.register_pickle_by_value(merkle_manifest)
    yield
    cloudpickle.unregister_pickle_by_value(merkle_manifest)


@pytest.mark.parametrize("n,n_sources,levels", [(1, 1, 6), (9, 1, 1), (200, 5, 1), (200, 5, 2), (90, 3, 6)])
def test_equals_a_plain_tree(spark, monkeypatch, by_value, n, n_sources, levels):
    monkeypatch.setattr(merkle_manifest, "LEVELS", levels)
    monkeypatch.setattr(merkle_manifest, "BLOCK", 3**levels)
    docs = spark.createDataFrame([*many(n, n_sources), *many(n, n_sources)[:3]], DOCS).withColumn("Place", F.lit("own")).repartition(3)
    found = merkle_manifest.manifest(docs)
    assert levels == 6 or n < 9 or len(found.groups.tiers) > 1
    rows = found.proofs().collect()
    assert sorted(((r.id, r.leaf, r.subroot, r.root, r.proof) for r in rows), key=str) == plain_manifest(docs.collect())
    assert all(r.verified and r.folded_root == r.root and r.proof_sha256 == digest(r.proof) for r in rows)


def test_many_sources(spark):
    """More sources than a block holds: the upper tree has two tiers."""
    rows = [(k, f"t{k}", "en", f"s{k:04d}", 1) for k in range(900)]
    found = merkle_manifest.manifest(spark.createDataFrame(rows, DOCS))
    assert len(found.sources.tiers) == 2
    docs = spark.createDataFrame(rows, DOCS).collect()
    assert sorted(((r.id, r.leaf, r.subroot, r.root, r.proof) for r in found.proofs().collect()), key=str) == plain_manifest(docs)


def test_changes_are_seen(spark):
    rows = [(k, f"line {k}\nmore" if k % 2 else "plain", "en", "s", 1) for k in range(10)]
    docs = spark.createDataFrame(rows, DOCS)
    changed = {"text": F.regexp_replace("text", "\n", "")}
    got = {r.id: r.verified for r in merkle_manifest.manifest(docs, changed=changed, where=F.col("doc_id") < 6).proofs().collect()}
    assert got == {k: not (k < 6 and k % 2) for k in range(10)}


def test_a_long_text_and_an_empty_table(spark):
    long = spark.createDataFrame([(1, "x\n" * 2_000_000, None, None, None)], DOCS)
    (row,) = merkle_manifest.manifest(long).proofs().collect()
    assert row.leaf == row.subroot == row.root == plain_leaf(long.first()) and row.proof == ""
    empty = merkle_manifest.manifest(long.limit(0))
    assert empty.root is None and empty.proofs().count() == 0


def test_query_equals_its_sql(spark, data):
    assert_same(spark, data, merkle_manifest.query, merkle_manifest.SQL)
