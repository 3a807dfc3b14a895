import hashlib
import itertools
import random
import re
import time

import pytest

from tidemark.llm import pii
from tidemark.llm.queries import SPARK

PLAIN = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    "card": r"[0-9]([\x20-]?[0-9])+", "phone": r"\+[0-9][\x20().0-9-]+[0-9]"}


def luhn(d):
    return sum(sum(divmod(int(c) * (1 + i % 2), 10)) for i, c in enumerate(reversed(d))) % 10 == 0


def valid(kind, m):
    d = re.sub(r"[^0-9]", "", m)
    if kind == "ip":
        return all(int(p) <= 255 for p in m.split("."))
    return {"email": True, "card": 12 <= len(d) <= 19 and luhn(d), "phone": 9 <= len(d) <= 15}[kind]


def brute(text):
    found = [(m.start(), i, m.end(), k) for i, (k, p) in enumerate(PLAIN.items()) for m in re.finditer(p, text or "") if valid(k, m.group())]
    return sorted(found)


ODD = [
    None, "", "a@b.c%x@d.e", "..a.b@c-d.e.f. x@y x@y.z", "é 4111 1111 1111 1111 ü 4111-1111-1111-1112", "1.2.3.4.5.6.7.8 256.1.1.1 001.002.003.0004 1.2.3.99999999999",
    "+1 (555) 555-5555. +12345678 +123456789012345 +1234567890123456 +49 30 1234567 -", "9" * 3000, "a" * 50_000 + " 12", "1." * 3000, "x@" + "a." * 5000 + "b",
    "😀 a@b.cd 😀 +1 (555) 555-5555", "a@b.c\n\x0b1.1.1.1 2.2.2.2", "4111111111111111" * 3, "- ".join(["u@v.w"] * 700), "%" * 400 + "@x.y", "+4 111111111111111 11 5",
]


def test_base_spans_of_odd_texts(spark):
    rng = random.Random(8)
    texts = ODD + ["".join(rng.choice("ab@.+-%() 0123456789é\n") for _ in range(rng.randint(1, 80))) for _ in range(300)]
    texts += ["".join(rng.choice(["4111111111111111", " ", "+1 ", "(2)", "1.2.3.4", "a@b", ".c", "-", "x", "255", "."]) for _ in range(12)) for _ in range(300)]
    frame = spark.createDataFrame([(i, t, "c", 1) for i, t in enumerate(texts)], "doc_id bigint, text string, base string, start int")
    out = {r["doc_id"]: r for r in pii.extract(frame).collect()}
    assert len(out) == len(texts)
    for i, t in enumerate(texts):
        assert [(x["start"], x["rank"], x["end"], x["kind"]) for x in out[i]["base"]] == brute(t), t
        assert {tuple(x) for x in out[i]["base"]} <= {tuple(x) for x in out[i]["spans"]}


@pytest.fixture(scope="module")
def contextual(spark):
    """Seeds and unseen identifiers introduced by the same words, and other numbers that are not."""
    rows = [(i, f"the form says account holder 10.0.{i}.7 and more words {i}0000 here") for i in range(12)]
    rows += [(100 + i, f"again account holder AB-{i}12345-X, thanks") for i in range(5)]
    rows += [(200 + i, f"a total of {i}54321 items") for i in range(5)] + [(300, None), (301, ""), (None, "account holder ZZ99999")]
    return spark.createDataFrame(rows, "doc_id bigint, text string")


def test_patterns_discover_unseen_identifiers(contextual):
    for r in pii.extract(contextual).collect():
        more = [(x["start"], x["end"]) for x in r["spans"] if x["kind"] == "id"]
        if r["doc_id"] is None:
            assert more == [(15, 22)]
        elif 100 <= r["doc_id"] < 200:
            text = f"again account holder AB-{r['doc_id'] - 100}12345-X, thanks"
            assert [text[a:b] for a, b in more] == [f"AB-{r['doc_id'] - 100}12345-X"]
        else:
            assert more == []


def test_redaction(spark, contextual):
    out = {r["doc_id"]: r["text"] for r in pii.redact(contextual).collect()}
    assert out[100] == "again account holder <ID>, thanks" and out[200] == "a total of 054321 items" and out[300] is None and out[301] == ""
    assert out[3] == "the form says account holder <IP> and more words 30000 here"
    rows = [(1, "x +4111111111111111 y", "a"), (1, "x +4111111111111111 y", "a"), (2, "a@b.c", None)]
    again = pii.redact(spark.createDataFrame(rows, "doc_id bigint, text string, base string")).collect()
    assert sorted(r["text"] for r in again) == ["<EMAIL>", "x <CARD> y", "x <CARD> y"] or sorted(r["text"] for r in again) == ["<EMAIL>", "x +<CARD> y", "x +<CARD> y"]
    empty = contextual.limit(0)
    assert pii.extract(empty).count() == pii.redact(empty).count() == 0


def test_query(spark, sf):
    docs = {r["doc_id"]: r["text"] for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    for r in SPARK["op7_pii"](spark, sf).collect():
        want = brute(docs[r["doc_id"]])
        digest = ",".join(f"{k}:{a}:{b}" for a, _, b, k in want)
        assert r["base_sha256"] == hashlib.sha256(digest.encode()).hexdigest()
        assert [r[f"n_{k}"] for k in PLAIN] == [sum(x[3] == k for x in want) for k in PLAIN]
        assert set(filter(None, digest.split(","))) <= set(r["spans"].split(","))


def test_no_python_in_the_plan(spark, sf):
    plan = SPARK["op7_pii"](spark, sf)._jdf.queryExecution().toString()
    assert not re.search("Python|Pandas|Arrow", plan)


def test_very_long_texts_take_linear_time(spark):
    """100,000 matches in one text: positions, seeds and masks without a step that grows with the square."""
    n = 100_000
    frame = spark.createDataFrame([(1, "; ".join(["u@v.w"] * n)), (2, "a " + "12 " * n + "x@y.z")], "doc_id bigint, text string")
    began = time.time()
    out = {r["doc_id"]: r for r in pii.extract(frame).selectExpr("doc_id", "size(base) AS n", "element_at(base, -1) AS last").collect()}
    assert out[1]["n"] == n and out[1]["last"]["start"] == 7 * (n - 1) and out[1]["last"]["end"] == 7 * n - 2
    assert out[2]["n"] == 1 and out[2]["last"]["start"] == 3 * n + 2
    text = {r["doc_id"]: r["text"] for r in pii.redact(frame).collect()}
    assert text[1] == "; ".join(["<EMAIL>"] * n) and text[2] == "a " + "12 " * n + "<EMAIL>"
    assert time.time() - began < 120


def test_masks_of_any_spans(spark):
    """Against cutting a list of characters: overlapping spans, ends on block edges, characters beyond 16 bits."""
    rng, rows = random.Random(4), []
    for i in range(60):
        text = "".join(rng.choice("ab😀é ") for _ in range(rng.choice([0, 5, 255, 256, 257, 700, 1500])))
        spans = sorted((a, rng.randint(0, 4), min(len(text), a + rng.choice([1, 3, 256, 300])), "k") for a in (rng.randrange(len(text)) for _ in range(rng.randint(0, 6)))) if text else []
        rows.append((i, text, spans))
    frame = spark.createDataFrame(rows, "i int, t string, s array<struct<start:bigint,rank:int,end:bigint,kind:string>>")
    for r, (_, text, spans) in zip(pii.masked(frame, "t", "s").orderBy("i").collect(), rows):
        want, at = "", 0
        for a, _, b, _ in spans:
            want, at = (want + text[at:a] + "<K>" if a >= at else want), max(at, b)
        assert r["t"] == want + text[at:]


def test_running_values(spark):
    rows = [([],), ([5],), (list(range(700)),), ([3, -1, 9] * 30_000,)]
    frame = spark.createDataFrame(rows, "v array<bigint>")
    for r in pii.running(pii.running(frame, "v", "s"), "v", "m", "greatest(a, x)").collect():
        assert r["s"] == [0, *itertools.accumulate(r["v"])][: len(r["v"])]
        assert r["m"] == [0, *itertools.accumulate(r["v"], max, initial=0)][1 : len(r["v"]) + 1]


def test_discovery_goes_on_until_nothing_changes(spark):
    """A chain: each kind of identifier is introduced by words that the kind before it made confident."""
    sizes, rows = [1600, 400, 100, 25, 6, 1], []
    for step in range(5):
        for i in range(sizes[step]):
            rows.append((step, f"words word{chr(97 + step)} " + (f"10.0.{i // 250}.{i % 250}" if step == 0 else f"K{step}{i:04d}77") + " end"))
        rows += [(100 + step, f"words word{chr(97 + step)} K{step + 1}{i:04d}77 end") for i in range(sizes[step + 1])]
    out = pii.extract(spark.createDataFrame(rows, "doc_id bigint, text string")).collect()
    for step in range(5):
        new = [r for r in out if r["doc_id"] == 100 + step]
        assert len(new) == sizes[step + 1] and all(any(x["kind"] == "id" for x in r["spans"]) for r in new), step
