import hashlib
import zlib

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from tidemark.llm import merkle
from tidemark.llm.queries import ORACLE, SPARK
from tools.check import compare, oracle_connection

FIELDS = ["doc_id", "source", "lang", "n_chars", "text"]


def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


def plain_leaf(row):
    return sha("".join("-" if v is None else f"{len(str(v).encode())}:{v}" for v in row))


def plain_tree(nodes, arity):
    """(root, [(before, after) by level] of every leaf), level by level over the whole list."""
    paths, place = [[] for _ in nodes], list(range(len(nodes)))
    while len(nodes) > 1:
        runs = [nodes[i : i + arity] for i in range(0, len(nodes), arity)]
        for leaf, at in enumerate(place):
            run, i = runs[at // arity], at % arity
            paths[leaf].append(("".join(run[:i]), "".join(run[i + 1 :])))
        nodes, place = [sha("".join(r)) for r in runs], [at // arity for at in place]
    return nodes[0], paths


def plain_manifest(rows, arity=3):
    """{(row): [(leaf, witness, subroot, root)]} of rows in the order of FIELDS."""
    groups = {}
    for r in rows:
        groups.setdefault(r[1], []).append(r)
    order = sorted(groups, key=lambda s: (s is not None, (s or "").encode()))
    trees = []
    for s in order:
        mine = sorted(((r[0] is not None, r[0] or 0, plain_leaf(r), r) for r in groups[s]), key=lambda x: x[:3])
        trees.append((mine, *plain_tree([x[2] for x in mine], arity)))
    root, over = plain_tree([t[1] for t in trees], arity) if trees else (None, [])
    return sorted((leaf, repr(r[0]), path + over[g], sub, root) for g, (mine, sub, paths) in enumerate(trees) for (_, _, leaf, r), path in zip(mine, paths))


def found(df, **more):
    out = merkle.manifest(df, key=F.col("doc_id"), group=F.col("source"), fields=[F.col(c) for c in FIELDS], **more)
    return sorted((r["leaf"], repr(r["key"]), [tuple(s) for s in r["witness"]], r["subroot"], r["root"]) for r in out.collect())


@settings(max_examples=60, deadline=None)
@given(st.integers(1, 130), st.integers(2, 4))
def test_frontier_is_the_plain_tree(n, arity):
    leaves = [sha(str(i)) for i in range(n)]
    frontier = merkle.Frontier(arity)
    for leaf in leaves:
        frontier.append(leaf)
    root, paths = plain_tree(leaves, arity)
    assert frontier.finish(merkle.depth(n, arity)) == root
    assert frontier.witness == paths
    assert all(merkle.fold(leaf, path) == root for leaf, path in zip(leaves, paths))


KIND = "doc_id bigint, source string, lang string, n_chars bigint, text string, tree string, pos string, witness string"


def frame(spark, rows):
    return spark.createDataFrame([(*r, "x", "y", "z") for r in rows], KIND).repartition(5)


def test_odd_rows(spark):
    rows = [(1, None, None, None, None), (2, None, "en", 1, ""), (None, "a", "en", 3, "né"), (None, None, None, None, None), (7, "a", "en", 5, "x\ny")]
    rows += [(7, "a", "en", 5, "x\ny")] * 5 + [(7, "a", "en", 5, "other")] + [(9, "é", "de", 2, "long " * 300_000), (9, "z", "de", 2, "\n"), (3, "", "fr", 0, "-")]
    assert found(frame(spark, rows)) == plain_manifest(rows)
    assert found(frame(spark, rows), arity=2, levels=1) == plain_manifest(rows, 2)


def test_several_rounds_of_blocks(spark):
    """Blocks of 9 leaves, so that block roots are appended again and again; one source holds most rows."""
    rows = [(i, "hot" if i % 3 else f"s{i % 100}", "en", i, f"text {i}") for i in range(1500)]
    assert found(frame(spark, rows), levels=2) == plain_manifest(rows)
    one = [(i, "only", "en", i, "t") for i in range(28)]
    assert found(frame(spark, one), levels=1) == plain_manifest(one)


def test_empty_table(spark):
    assert found(frame(spark, []).limit(0)) == []


def test_query_is_its_definition(spark, sf):
    docs = [tuple(r) for r in spark.read.parquet(f"{sf}/documents.parquet").select(*FIELDS).collect()]
    want = {i: (leaf, sha("".join(b + a for b, a in path)), path, sub, root) for leaf, i, path, sub, root in plain_manifest(docs)}
    texts = {repr(r[0]): r for r in docs}
    got = SPARK["op13_merkle"](spark, sf).collect()
    assert len(got) == len(docs) == len(want)
    tampered = 0
    for r in got:
        leaf, proof, path, sub, root = want[repr(r["doc_id"])]
        assert (r["leaf"], r["proof_sha256"], r["subroot"], r["root"]) == (leaf, proof, sub, root)
        row = texts[repr(r["doc_id"])]
        if zlib.crc32(str(r["doc_id"]).encode()) % 2 == 0 and row[4]:
            row = (*row[:4], row[4].replace("\n", ""))
        folded = merkle.fold(plain_leaf(row), path)
        tampered += folded != root
        assert r["folded_root"] == folded and r["verified"] == (folded == root)
    assert tampered


def test_trees_need_an_arity(spark):
    with pytest.raises(ValueError):
        merkle.manifest(frame(spark, []), key=F.col("doc_id"), group=F.col("source"), fields=[], arity=1)


def test_oracle(spark, sf):
    ok, message = compare(spark, oracle_connection(sf), sf, SPARK["op13_merkle"], ORACLE["op13_merkle"])
    assert ok, message
