"""The stages' decisions, and the chain of them, against plain Python."""

from collections import Counter, defaultdict

import pytest
from pyspark.sql import types as T

import corpus_pipeline
from tutorlens.llm import langid, mixing, simhash, suffix_dedup
from tutorlens.llm.encoding import Encoder, tokenizer_path

SCHEMA = T.StructType([T.StructField(c, t) for c, t in (
    ("doc_id", T.LongType()), ("text", T.StringType()), ("lang", T.StringType()), ("source", T.StringType()),
    ("n_chars", T.LongType()), ("row", T.StringType()), ("tk", T.StringType()), ("key", T.LongType()), ("id", T.LongType()))])


def frame(spark, rows):
    return spark.createDataFrame([(d, t, lang, s, len(t or ""), "r", "k", 1, 2) for d, t, lang, s in rows], SCHEMA)


def base_rows():
    en = "the cat and the dog of this house are in the garden with that man and his wife number "
    de = "der hund und die katze sind mit dem mann und der frau in dem haus bei den kindern nummer "
    rows = [(i, (en if i % 2 else de) + " ".join(f"w{i * j % 101}" for j in range(3 + i % 9)), "en" if i % 2 else "de", f"s{i % 3}")
            for i in range(30)]
    return rows


def test_language_stage(spark):
    rows = base_rows() + [(50, None, "en", "s"), (51, "", "en", None), (52, "123 !!", None, "s0"), (None, "the man and the dog", None, None),
                          (7, base_rows()[7][1], "en", "s1")]
    docs = frame(spark, rows)
    got = langid.keep_identified(docs)
    assert got.schema == docs.schema or got.columns == docs.columns
    assert Counter(r["doc_id"] for r in got.collect()) == Counter([r[0] for r in base_rows()] + [None, 7])
    assert langid.keep_identified(docs.where("doc_id > 99")).count() == 0


def test_near_duplicate_stage(spark):
    rows = base_rows()
    text = " ".join(f"u{i}" for i in range(2000))
    rows += [(90, text, "en", "s0"), (80, text + " more", "en", "s1"), (95, text, "en", "s0"), (95, text, "en", "s0"),
             (None, text, None, None), (60, None, None, "s0"), (61, "", None, "s0"), (70, "solo", None, None), (70, "solo", None, None),
             (None, "alone", None, None)]
    docs = frame(spark, rows)
    kept = Counter(r["doc_id"] for r in simhash.one_of_each(docs).collect())
    groups = defaultdict(list)
    for r in simhash.simhash_components(docs).collect():
        groups[r["component_id"]].append(r["doc_id"])
    assert kept == Counter(g if g is not None else None for g in groups)
    assert 80 in kept and 90 not in kept and kept[60] == kept[70] == kept[None] == 1
    assert simhash.one_of_each(docs.where("doc_id > 99")).count() == 0


def test_passage_stage(spark):
    passage = " ".join(f"p{i}" for i in range(150))
    rows = base_rows() + [(100, "start one. " + passage + " end one.", "en", "s0"), (101, "other start " + passage + " é", "en", "s1"),
                          (102, passage, "en", "s1"), (103, None, None, None), (104, "", "en", None), (None, "x" + passage, None, None)]
    docs = frame(spark, rows)
    got = {(r["doc_id"]): r for r in suffix_dedup.without_repeats(docs).collect()}
    assert got[100]["text"] == "start one.  end one." or got[100]["text"].startswith("start one.")
    assert passage not in got[101]["text"] and got[101]["n_chars"] == len(got[101]["text"])
    assert 102 not in got and got[103]["text"] is None and got[104]["text"] == "" and got[None]["text"] == "x"
    assert all(got[d]["text"] == t for d, t, *_ in base_rows())
    assert suffix_dedup.without_repeats(docs).columns == docs.columns


def test_mixing_stage(spark):
    rows = base_rows() + [(40, "w " * 200, "en", None), (41, None, "en", "s1"), (None, "one two", None, "s2"), (42, "twin words", "en", "s0"),
                          (42, "twin words", "en", "s0")]
    docs = frame(spark, rows)
    got = mixing.mixed(docs)
    assert got.columns == docs.columns
    times = Counter((r["doc_id"], r["text"]) for r in got.collect())
    size = Counter()
    for r in mixing.plan_rows(docs).collect():
        copies = r["whole"] + (r["extra"] > 0 and 2 * r["extra"] >= r["size"])
        assert copies <= 3
        size[r["source"]] += copies * r["size"] - r["target"] / len([x for x in rows if x[3] == r["source"]])
    assert all(abs(x) <= 210 for x in size.values())
    assert max(times.values()) <= 6
    assert mixing.mixed(docs.where("doc_id > 99")).count() == 0


def test_whole_pipeline(spark):
    sf = "/root/testdata/sf0.001"
    assert [n for n, _ in corpus_pipeline.STAGES] == ["language", "near_duplicates", "repeated_passages", "mixing", "packing"]
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    columns, stages = docs.columns, {}
    for name, stage in corpus_pipeline.STAGES:
        rows = stage(spark, docs, sf)
        if name != "packing":
            assert rows.columns == columns
            rows = rows.cache()
        stages[name], docs = rows, rows
    before = {r["doc_id"]: r["text"] for r in stages["near_duplicates"].collect()}
    after = {r["doc_id"]: r["text"] for r in stages["repeated_passages"].collect()}
    size = suffix_dedup.PASSAGE_WORDS
    words = {d: t.split() for d, t in before.items()}
    count = Counter(tuple(w[i:i + size]) for w in words.values() for i in range(len(w) - size + 1))
    for d, w in words.items():
        gone = {k for i in range(len(w) - size + 1) if count[tuple(w[i:i + size])] > 1 for k in range(i, i + size)}
        assert after.get(d, "").split() == [x for i, x in enumerate(w) if i not in gone]
        assert gone or after[d] == before[d]
    enc = Encoder(tokenizer_path())
    tokens = sum(len(enc.tokenizer.encode(r["text"], add_special_tokens=False).ids) + 1 for r in stages["mixing"].collect())
    assert sum(r["length"] for r in stages["packing"].collect()) == tokens
    whole = sorted(tuple(r) for r in corpus_pipeline.run(spark, sf).select("doc_id", "doc_tokens").where("start = 0").collect())
    assert whole == sorted(tuple(r) for r in stages["packing"].select("doc_id", "doc_tokens").where("start = 0").collect())


@pytest.mark.parametrize("name", ["language", "near_duplicates", "repeated_passages", "mixing", "packing"])
def test_stages_take_empty_tables(spark, name):
    docs = spark.createDataFrame([], SCHEMA)
    assert dict(corpus_pipeline.STAGES)[name](spark, docs, "").count() == 0


