import math

import pytest
from pyspark.sql import functions as F

from tidemark.llm import langid, toxicity
from tidemark.llm.common import crc_fold, held_out
from tidemark.llm.queries import SPARK, toxicity_model
from tidemark.llm.toxicity import Model, Tokens

LARGER = "/root/testdata/sf0.1"


def test_held_out_is_crc32_of_the_id(spark):
    rows = spark.range(500).select("id", held_out(F.col("id")).alias("h")).collect()
    assert all(r["h"] == crc_fold(r["id"]) for r in rows)


def weight(text, words=("idiot",), stems=()):
    return [w for *_, w in Tokens(Model({w: 1.0 for w in words}, {s: 1.0 for s in stems})).clauses(text)]


def test_grammar():
    assert weight("the idiot went home") == [1.0]
    assert weight("You IDIOT!") == [1.5]
    assert weight("not an idiot") == [0.5]
    assert weight("not very many of the idiot") == [1.0]
    assert weight("he said you idiot") == pytest.approx([0.9])
    assert weight("they say. you idiot") == [1.5]
    assert weight("never mind. an idiot; two idiot") == [1.0, 1.0]
    assert weight("I will kill you") == weight("we kill time") == [0.4]
    assert weight("you, I will kill") == [1.5]
    assert weight("loweiung der", (), ("lowei",)) == [1.0]
    assert weight("") == weight("   ") == weight("idiots") == []


def test_composition_has_every_state():
    assert len(toxicity.FOLLOW) == 2 * 4 * 2
    assert all(len(x) == 7 for x in toxicity.FOLLOW + toxicity.FACTOR)


@pytest.fixture(scope="module")
def toxic_scores(spark):
    labels = {r["doc_id"]: r["toxic"] for r in spark.read.parquet(f"{LARGER}/labels.parquet").collect()}
    return [(r, labels[r["doc_id"]]) for r in SPARK["op1_toxicity"](spark, LARGER).collect() if r["doc_id"] in labels]


def test_toxicity_on_held_out_rows(toxic_scores):
    held = [(r, y) for r, y in toxic_scores if r["held_out"]]
    assert all(r["held_out"] == crc_fold(r["doc_id"]) and r["predicted"] == (r["score"] >= 0.5) and 0 <= r["score"] <= 1 for r, _ in held)
    hit = sum(r["predicted"] and y for r, y in held)
    assert hit >= 0.85 * sum(y for _, y in held)
    assert hit >= 0.95 * sum(r["predicted"] for r, _ in held)


def test_toxicity_edges(spark):
    rows = [(1, None, 1, "x"), (2, "", 0, "x"), (2, "", 0, "x"), (None, "idiot " * 40_000, None, "x")]
    df = spark.createDataFrame(rows, "doc_id bigint, text string, toxic int, score string")
    out = toxicity.score(df, Model({"idiot": 1.0}, {})).collect()
    assert len(out) == 4 and all(math.isfinite(r["score"]) for r in out)
    assert [len(r["clauses"]) for r in out] == [0, 0, 0, 1]
    empty = df.limit(0)
    assert toxicity.score(empty, toxicity.fit(empty)).count() == 0
    assert toxicity.fit(df.filter("doc_id = 2")).probability(0) < 0.5


def test_language_on_held_out_rows(spark):
    lang = {r["doc_id"]: r["lang"] for r in spark.read.parquet(f"{LARGER}/documents.parquet").collect()}
    out = SPARK["op6_langid"](spark, LARGER).collect()
    held = [r for r in out if r["held_out"]]
    assert len(out) == len(lang) and all(r["held_out"] == crc_fold(r["doc_id"]) and 0 <= r["score"] <= 1 for r in out)
    assert sum(r["lang_pred"] == lang[r["doc_id"]] for r in held) >= 0.97 * len(held)


def test_language_edges(spark):
    rows = [(i, "der die das und nicht", "de") for i in range(30)] + [(i, "the and of to in", "en") for i in range(30, 60)]
    model = langid.fit(spark.createDataFrame(rows, "doc_id bigint, text string, lang string"), key=F.col("doc_id"))
    odd = [(1, None, "a"), (2, "", "a"), (3, "12 .. 34", "a"), (4, "²Ⅷ", "a"), (None, "nicht und das", "a"), (5, "to the " * 30_000, "a"), (6, "\0", "a"), (7, "漢", "a")]
    df = spark.createDataFrame(odd, "doc_id bigint, text string, lang string")
    got = {r["doc_id"]: r["lang"] for r in langid.predict(df, model).collect()}
    assert got | {7: ""} == {1: "und", 2: "und", 3: "und", 4: "und", None: "de", 5: "en", 6: "und", 7: ""}
    assert got[7] in ("de", "en")
    none = langid.fit(df.limit(0))
    assert {r["lang"] for r in langid.predict(df, none).collect()} == {"und"}
    assert langid.predict(df.limit(0), model).count() == 0


def test_score_does_not_depend_on_neighbours(spark):
    model = langid.Model(["a", "b"], __import__("numpy").random.default_rng(0).normal(size=(langid.BUCKETS, 2)), 0.0)
    alone = model.logits(["über den Fluss"])
    assert (alone == model.logits(["x" * 99, "über den Fluss", ""])[1]).all()


def plain_clauses(model, text):
    """Weights of the matched clauses by the rules in words: who was addressed, denied or quoted before an insult or threat."""
    lists = {name: set(getattr(toxicity, name).split()) for name in ("TARGETS", "NEGATIONS", "REPORTS", "THREATS")}
    out, addressed, quoted, denied, weight = [], False, False, 0, 0.0
    tokens = (text or "").lower().split()
    for i, token in enumerate(tokens):
        word = token.strip(toxicity.EDGE)
        own = max([model.words.get(word, 0.0)] + [model.stems.get(word[:n], 0.0) for n in toxicity.STEMS if len(word) >= n])
        threat = not own and word in lists["THREATS"] and not any(word in lists[k] for k in ("TARGETS", "NEGATIONS", "REPORTS"))
        if own or threat:
            gain = own or 1.0
            gain *= 1.5 if addressed else 0.4 if threat else 1.0
            gain *= 0.5 if denied else 1.0
            gain *= 0.6 if quoted else 1.0
            weight += gain
        if not own and word in lists["NEGATIONS"]:
            denied = 3
        else:
            denied = max(0, denied - 1)
        addressed |= not own and word in lists["TARGETS"]
        quoted |= not own and word in lists["REPORTS"]
        tail = token[len(token.rstrip(toxicity.EDGE)) :]
        if any(c in ".!?;:|" for c in tail) or i == len(tokens) - 1:
            out += [weight] if weight else []
            addressed, quoted, denied, weight = False, False, 0, 0.0
    return out


def test_toxicity_is_the_rules_in_words(spark, sf):
    """Every document of the small tables, scored by the plain rules over the lexicon that the query learns."""
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    model = toxicity_model(docs, spark.read.parquet(f"{sf}/labels.parquet"))
    got = {r["doc_id"]: r["score"] for r in SPARK["op1_toxicity"](spark, sf).collect()}
    matched = 0
    for r in docs.collect():
        weights = plain_clauses(model, r["text"])
        matched += bool(weights)
        evidence = math.log1p(sum(weights))
        assert got[r["doc_id"]] == pytest.approx(1 / (1 + math.exp(-(model.slope * evidence + model.offset))), rel=1e-9)
    assert matched > 10


def test_language_is_a_plain_softmax_over_subwords(spark, sf):
    """Every document of the small tables, by counting its byte n-grams one by one."""
    import numpy as np

    docs = spark.read.parquet(f"{sf}/documents.parquet")
    model = langid.fit(docs.filter(~held_out(F.col("doc_id"))).select("doc_id", "text", "lang"), key=F.col("doc_id"))
    got = {r["doc_id"]: r for r in SPARK["op6_langid"](spark, sf).collect()}
    mask = (1 << 64) - 1

    def bucket(gram):
        x = (int.from_bytes(gram, "big") + (len(gram) << 40)) & mask
        x = ((x ^ x >> 30) * 0xBF58476D1CE4E5B9) & mask
        x = ((x ^ x >> 27) * 0x94D049BB133111EB) & mask
        return (x ^ x >> 31) % langid.BUCKETS

    for r in docs.collect():
        text = (r["text"] or "").lower().encode().replace(b"\0", b" ")
        if not any(c.isalpha() for c in (r["text"] or "")):
            assert got[r["doc_id"]]["lang_pred"] == "und"
            continue
        rows = [model.table[bucket(text[i : i + n])] for n in langid.LENGTHS for i in range(len(text) - n + 1)]
        z = (np.mean(rows, axis=0) + model.bias) / model.temperature
        p = np.exp(z - z.max()) / np.exp(z - z.max()).sum()
        assert got[r["doc_id"]]["lang_pred"] == model.labels[int(p.argmax())]
        assert got[r["doc_id"]]["score"] == pytest.approx(p.max(), abs=1e-9)
