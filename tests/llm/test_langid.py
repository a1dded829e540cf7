"""Language identification: the forward sum against enumeration, held-out accuracy, edge cases."""

import math
from collections import Counter

import pytest
from pyspark.sql import types as T

from tutorlens.llm import langid

PROBS = {"▁": (.1, .2), "a": (.1, .05), "b": (.2, .1), "▁a": (.1, .1), "ab": (.05, .2), "ba": (.1, .1), "▁ab": (.02, .03),
         "bab": (.01, .3)}


def segmentations(s, probs):
    if not s:
        yield []
    for j in range(1, len(s) + 1):
        if s[:j] in probs:
            for rest in segmentations(s[j:], probs):
                yield [s[:j], *rest]


def test_forward_sums_all_segmentations():
    model = langid.Pieces(PROBS, ["x", "y"])
    for word in ["a", "b", "abab", "babba", "aabbababa"]:
        for k in (0, 1):
            total = sum(math.prod(PROBS[p][k] for p in seg) for seg in segmentations("▁" + word, PROBS))
            assert model.log_probability(word)[k] == pytest.approx(math.log(total))
            want: Counter = Counter()
            for seg in segmentations("▁" + word, PROBS):
                for p in seg:
                    want[p] += math.prod(PROBS[q][k] for q in seg) / total
            got: Counter = Counter()
            for p, x in model.expected(word, k):
                got[p] += x
            assert got == pytest.approx(want)


def test_words_in_step_equal_words_one_by_one():
    import random
    rng = random.Random(3)
    model = langid.Pieces(PROBS, ["x", "y"])
    words = ["".join(rng.choice("abé") for _ in range(rng.randint(1, 70))) for _ in range(300)]
    got = model.log_probabilities(words)
    for w, row in zip(words, got):
        assert row.tolist() == pytest.approx(model.log_probability(w))


def test_long_and_uncovered_words():
    model = langid.Pieces(PROBS, ["x", "y"])
    long = "ab" * 3000
    assert all(math.isfinite(v) for v in model.log_probability(long))
    two, four = (model.log_probability("ab" * n)[0] for n in (100, 200))
    six = model.log_probability("ab" * 300)[0]
    assert six - four == pytest.approx(four - two)
    assert model.log_probability("é")[0] == pytest.approx(math.log(.1 * langid.UNKNOWN))


def test_held_out_accuracy(spark):
    rows = langid.op7_langid(spark, "/root/testdata/sf0.01").collect()
    docs = {r["doc_id"]: r["lang"] for r in spark.read.parquet("/root/testdata/sf0.01/documents.parquet").collect()}
    assert len(rows) == len(docs)
    out = [r for r in rows if r["held_out"] and docs[r["doc_id"]]]
    assert len(out) > 150
    assert sum(r["lang_pred"] == docs[r["doc_id"]] for r in out) / len(out) > 0.97
    assert all(0 <= r["score"] <= 1 for r in rows)


SCHEMA = T.StructType([T.StructField(c, t) for c, t in (("doc_id", T.LongType()), ("text", T.StringType()), (
    "lang", T.StringType()), ("score", T.StringType()), ("lang_pred", T.LongType()), ("word", T.LongType()))])


def test_edge_cases(spark):
    rows = [(i, t, lang) for i, (t, lang) in enumerate([("the cat and the dog", "en"), ("der hund und die katze", "de")] * 12)]
    rows += [(100, None, "en"), (101, "", None), (102, "12 ½ _ !?", "en"), (103, "the " * 20000, None), (None, "und der", None),
             (104, "the and", None), (104, "the and", None)]
    docs = spark.createDataFrame([(*r, "s", 1, 2) for r in rows], SCHEMA)
    got = [(r["doc_id"], r["lang_pred"], r["score"]) for r in langid.predict(docs, langid.fit_on_documents(docs)).collect()]
    assert len(got) == len(rows)
    by = {r[0]: r[1:] for r in got}
    assert by[100] == by[101] == by[102] == ("und", 0.0)
    assert by[103][0] == by[104][0] == "en" and by[None][0] == "de" and 0.5 < by[103][1] <= 1.0
    empty = docs.where("doc_id > 999")
    assert langid.predict(empty, langid.fit_on_documents(empty)).count() == 0
    unlabelled = langid.predict(docs, langid.fit_on_documents(docs.where("lang is null"))).collect()
    assert {(r["lang_pred"], r["score"]) for r in unlabelled} == {("und", 0.0)}


def test_long_runs_train_the_model(spark):
    model = langid.Pieces(PROBS, ["x", "y"])
    short = "ab" * 30
    assert dict_of(model.expected_long(model.arcs(short), 0)) == pytest.approx(dict_of(model.expected(short, 0)))
    long = dict_of(model.expected("ab" * 5000, 1))      # its probability is far below the smallest float
    spelled = sum(x * len(p.replace("▁", "")) for p, x in long.items())
    assert spelled == pytest.approx(10_000)
    rows = [(i, "the cat and the dog", "en", "s", 1, 2) for i in range(12)]
    rows += [(i, "漢字仮名交文" * 30, "run", "s", 1, 2) for i in range(100, 112)]
    docs = spark.createDataFrame(rows, SCHEMA)
    model = langid.fit_on_documents(docs)
    assert model.languages == ["en", "run"]
    got = {r["doc_id"]: r["lang_pred"] for r in langid.predict(docs, model).collect()}
    assert got == {r[0]: r[2] for r in rows}


def dict_of(uses):
    total: Counter = Counter()
    for p, x in uses:
        total[p] += x
    return total


def test_character_model_is_a_product_over_characters():
    model = langid.Pieces(PROBS, ["x", "y"], {"▁": .3, "a": .6, "z": .1})
    for word in ["a", "ab", "babba", "é", "ab" * 40]:
        want = math.log(.3) + sum(math.log({"a": .6, "b": langid.NEW_CHARACTER, "é": langid.UNKNOWN}[c]) for c in word)
        assert model.log_probability(word)[2] == pytest.approx(want)
        assert model.log_probabilities([word])[0].tolist() == pytest.approx(model.log_probability(word))
        assert model.log_probability(word)[:2] == pytest.approx(langid.Pieces(PROBS, ["x", "y"]).log_probability(word))


def test_character_shares(spark):
    words = spark.createDataFrame([("x", "aab", 2), ("x", "b", 4), ("y", "é", 1)], "lang string, word string, n long")
    want = {"▁": (6 / 16 + 1 / 2) / 2, "a": 4 / 16 / 2, "b": 6 / 16 / 2, "é": 1 / 4}
    assert langid.character_shares(words, 2) == pytest.approx(want)


def test_texts_of_other_languages_go(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "text", "lang")
    other = ["Kielimalli oppii verkon teksteistä, joten toistuvat kappaleet on poistettava ennen koulutusta huolellisesti.",
             "Mfano wa lugha hujifunza kutokana na maandishi ya mtandao, kwa hiyo ni lazima kuondoa sehemu zinazojirudia.",
             "Языковая модель учится на текстах из сети, поэтому повторяющиеся части нужно удалять.",
             "语言模型从网络文本中学习,因此需要删除重复的部分。", "xqzvk wjhgf qqpzx kkjvw zxcvb qwrtp mnbvc lkjhg"]
    own = ["Large language models are trained on text from the web, and cleaning this data matters a great deal.",
           "Los modelos de lenguaje se entrenan con textos de la red y la limpieza de estos datos es muy importante."]
    more = spark.createDataFrame([(10**6 + i, t, None) for i, t in enumerate(own + other)], docs.schema)
    kept = {r["doc_id"] for r in langid.keep_identified(docs.unionByName(more)).select("doc_id").collect()}
    assert kept == {r["doc_id"] for r in docs.select("doc_id").collect()} | {10**6 + i for i in range(len(own))}
