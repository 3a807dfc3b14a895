import zlib

import numpy as np
import pytest
from tokenizers import Tokenizer

import __spark_entry__ as entry
import corpus_pipeline
from tests.llm.test_minhash import shingle_set, similarity
from tests.llm.test_pii import brute as brute_pii
from tests.llm.test_substrings import brute as brute_repeats
from tidemark.llm import pii
from tidemark.llm.common import crc_fold
from tidemark.llm.queries import ORACLE, SPARK, vocabulary
from tools.check import compare, oracle_connection

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


@pytest.fixture(scope="module")
def stages(spark, sf, tmp_path_factory):
    """What each stage returns, written and read again as the contract says."""
    docs, out = spark.read.parquet(f"{sf}/documents.parquet"), {}
    out["documents"] = docs
    for name, stage in corpus_pipeline.STAGES:
        path = str(tmp_path_factory.mktemp("stage") / name)
        stage(spark, docs, sf).write.parquet(path)
        docs = out[name] = spark.read.parquet(path)
    return {name: df.collect() for name, df in out.items()}


def test_columns(stages):
    for name in list(stages)[:-1]:
        assert [f for f in stages[name][0].asDict()] == COLUMNS


def test_toxic_documents_go(spark, sf, stages):
    scored = {r["doc_id"]: r["predicted"] for r in SPARK["op1_toxicity"](spark, sf).collect()}
    assert {r["doc_id"] for r in stages["toxicity"]} == {i for i, p in scored.items() if not p}
    before = {r["doc_id"]: r for r in stages["documents"]}
    assert all(r == before[r["doc_id"]] for r in stages["toxicity"])
    assert any(not crc_fold(i) for i, p in scored.items() if p)


def test_one_of_each_group_stays(stages):
    """The smallest id of each class of all pairs with a similarity of 0.8 over their 5-word shingles."""
    rows = sorted(stages["toxicity"], key=lambda r: r["doc_id"])
    sets = [shingle_set(r["text"]) for r in rows]
    label = list(range(len(rows)))

    def top(i):
        while label[i] != i:
            i = label[i]
        return i

    for i in range(len(rows)):
        for j in range(i):
            if similarity(sets[i], sets[j]) >= 0.8:
                a, b = sorted((top(i), top(j)))
                label[b] = a
    assert sorted(r["doc_id"] for r in stages["near_duplicates"]) == [r["doc_id"] for i, r in enumerate(rows) if label[i] == i]


def test_repeats_go(stages):
    rows = sorted(stages["near_duplicates"], key=lambda r: r["doc_id"])
    want = brute_repeats([(r["doc_id"], r["text"]) for r in rows], 20)
    text = {r["doc_id"]: r["text"] for r in rows}
    got = {r["doc_id"]: r for r in stages["repeated_passages"]}
    assert len(got) == len(rows)
    for key, (words, kept) in want.items():
        assert got[key]["text"] == (text[key] if len(words) == len(kept) else " ".join(kept))
        assert got[key]["n_chars"] == len(got[key]["text"])


def test_personal_data_is_masked(stages):
    before = {r["doc_id"]: r["text"] for r in stages["repeated_passages"]}
    masked = 0
    for r in stages["personal_data"]:
        spans = brute_pii(before[r["doc_id"]])
        assert not brute_pii(r["text"])
        assert r["text"] == before[r["doc_id"]] if not spans and "<ID>" not in r["text"] else r["text"] != before[r["doc_id"]]
        masked += bool(spans)
    assert masked and len(stages["personal_data"]) == len(before)


def test_every_token_is_packed_once(stages):
    codec = Tokenizer.from_file(vocabulary())
    pieces = {(r["doc_id"], r["piece"]): r for r in stages["packing"]}
    expected = 0
    for r in stages["personal_data"]:
        ids = np.array([*codec.encode(r["text"], add_special_tokens=False).ids, 0], "<u4")
        first = len(ids) % 2048 or 2048
        for i, a in enumerate([0, *range(first, len(ids), 2048)]):
            piece = pieces[r["doc_id"], i]
            assert piece["ids_crc32"] == zlib.crc32(ids[a : a + piece["length"]].tobytes())
            expected += 1
    assert expected == len(pieces)


def test_run_is_the_stages(spark, sf, stages):
    key = lambda r: (r["doc_id"], r["piece"], r["ids_crc32"])
    assert sorted(map(key, entry.queries()["pipeline"](spark, sf).collect())) == sorted(map(key, stages["packing"]))


@pytest.fixture(scope="module")
def odd(spark, tmp_path_factory):
    """Documents with nulls, empty texts, repeated rows and clashing columns, and their labels."""
    folder = str(tmp_path_factory.mktemp("odd"))
    rows = [(1, "same words here " * 40, "en", "s", 5, "x"), (1, "same words here " * 40, "en", "s", 5, "x"), (2, None, None, None, None, None),
            (3, "", "en", "s", 0, "x"), (None, "mail a@b.cd please", "en", "s", 1, "x"), (None, None, None, None, None, None), (4, "mail a@b.cd please", "de", "s", 1, "y")]
    kind = "doc_id bigint, text string, lang string, source string, n_chars bigint, fp string"
    spark.createDataFrame(rows, kind).write.parquet(f"{folder}/full/documents.parquet")
    spark.createDataFrame([], kind).write.parquet(f"{folder}/empty/documents.parquet")
    for name in ("full", "empty"):
        spark.createDataFrame([(1, 0, 1), (3, None, None)] if name == "full" else [], "doc_id bigint, quality int, toxic int").limit(1).write.parquet(f"{folder}/{name}/labels.parquet")
    return folder


@pytest.mark.parametrize("name", ["full", "empty"])
def test_stages_on_odd_rows(spark, odd, name):
    docs = spark.read.parquet(f"{odd}/{name}/documents.parquet")
    sizes = []
    for _, stage in corpus_pipeline.STAGES[1:]:
        rows = stage(spark, docs, f"{odd}/{name}").collect()
        sizes.append(len(rows))
    assert sizes[0] == (5 if name == "full" else 0)  # id 1 once, empty text joins null text, rows without an id stay
    assert sizes[1] == sizes[2] == (7 if name == "full" else 0)
    assert corpus_pipeline.run(spark, f"{odd}/{name}").columns[0] == "doc_id"


@pytest.mark.parametrize("name", sorted(ORACLE))
def test_oracles(spark, sf, name):
    ok, message = compare(spark, oracle_connection(sf), sf, SPARK[name], ORACLE[name])
    assert ok, message


def test_native_plan_of_the_masking_stage(spark, sf):
    plan = corpus_pipeline.without_personal_data(spark, spark.read.parquet(f"{sf}/documents.parquet"), sf)._jdf.queryExecution().toString()
    assert not any(x in plan for x in ("Python", "Pandas", "Arrow"))


def test_masks_leave_words_between(spark):
    frame = spark.createDataFrame([("a x@y.z b 1.2.3.4 c",)], "text string")
    assert pii.redact(frame).first()["text"] == "a <EMAIL> b <IP> c"
