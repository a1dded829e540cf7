"""Token trees against encoding the edited text anew."""

import random

from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import types as T

from tutorlens.llm import edit_counts as ec
from tutorlens.llm.encoding import Encoder, tokenizer_path

ENC = Encoder(tokenizer_path())
LETTERS = st.text(alphabet=st.sampled_from(list("ab's.,1 \n \t  é日")), max_size=25)


def count(text):
    return len(ENC.tokenizer.encode(text, add_special_tokens=False).ids)


@settings(max_examples=400, deadline=None)
@given(LETTERS, st.lists(st.tuples(st.integers(-2, 40), st.integers(-1, 12), LETTERS), max_size=6))
def test_tree_equals_encoding_anew(text, edits):
    tree = ec.TokenTree(ENC, text)
    for pos, size, ins in edits:
        tree.edit(pos, size, ins)
        at = min(max(pos, 0), len(text))
        text = text[:at] + ins + text[min(at + max(size, 0), len(text)):]
        assert (tree.n_tokens, tree.n_chars) == (count(text), len(text))
        assert "".join(c for own in tree.leaves for c in own) == text


def test_long_text_is_encoded_again_only_near_the_edit():
    rng = random.Random(2)
    text = " ".join(f"word{rng.randrange(999)}" for _ in range(5000))
    tree = ec.TokenTree(ENC, text)
    for _ in range(60):
        pos = rng.randrange(len(text))
        assert tree.edit(pos, 5, "new text ") < 120
        text = text[:pos] + "new text " + text[pos + 5:]
    assert tree.n_tokens == count(text)
    big = "inserted words " * 400
    tree.edit(777, 3, big)
    text = text[:777] + big + text[780:]
    assert tree.n_tokens == count(text)


SCHEMA = T.StructType([
    T.StructField("doc_id", T.LongType()), T.StructField("text", T.StringType()),
    T.StructField("edits", T.ArrayType(T.StructType([T.StructField("pos", T.LongType()), T.StructField("del", T.LongType()),
                                                     T.StructField("ins", T.StringType())]))),
    T.StructField("n_tokens", T.StringType()), T.StructField("n_edits", T.LongType())])


def test_table(spark):
    long = "some words " * 20000
    rows = [(1, "one two three", [(4, 3, "2")]), (2, None, [(0, 0, "x y")]), (3, "", None), (4, "tie", []), (4, "tie", []),
            (None, "no id", [(None, None, None), None, (99, 5, "!")]), (5, long, [(7, 100, " "), (0, 1, "S")])]
    docs = spark.createDataFrame([(*r, "clash", 1) for r in rows], SCHEMA)
    got = {(r["doc_id"], r["n_tokens"], r["n_edits"], r["n_chars_after"], r["n_tokens_after"])
           for r in ec.count_with_edits(docs, tokenizer_path()).collect()}
    edited = long[:7] + " " + long[107:]
    edited = "S" + edited[1:]
    assert got == {(1, 3, 1, 11, count("one 2 three")), (2, 0, 1, 3, 2), (3, 0, 0, 0, 0), (4, count("tie"), 0, 3, count("tie")),
                   (None, 2, 3, 6, count("no id!")), (5, count(long), 2, len(edited), count(edited))}
    assert ec.count_with_edits(docs.where("doc_id > 9"), tokenizer_path()).count() == 0


def test_sample_edits_equal_whole_encoding(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    got = {r["doc_id"]: r for r in ec.op6_edit_counts(spark, "/root/testdata/sf0.001").collect()}
    for r in ec.sample_edits(docs).collect():
        text = r["text"] or ""
        for e in r["edits"]:
            text = text[:e["pos"]] + e["ins"] + text[e["pos"] + e["del"]:]
        own = got[r["doc_id"]]
        assert (own["n_tokens"], own["n_tokens_after"]) == (count(r["text"] or ""), count(text))
        assert own["reencoded_chars"] <= max(1000, len(text))
    assert len(got) == docs.count()


def test_edits_that_make_and_break_added_tokens():
    import tokenizers

    plain = tokenizers.Tokenizer.from_file(tokenizer_path())
    rng = random.Random(5)
    parts = ["<|endoftext|>", "<|endof", "text|>", " ", "a", "word ", "  ", "\n"]
    for _ in range(150):
        text = "".join(rng.choices(parts, k=rng.randrange(12)))
        tree = ec.TokenTree(ENC, text)
        for _ in range(5):
            pos, size, ins = rng.randrange(len(text) + 1), rng.randrange(4), "".join(rng.choices(parts, k=rng.randrange(3)))
            tree.edit(pos, size, ins)
            text = text[:pos] + ins + text[pos + size:]
            assert tree.n_tokens == len(plain.encode(text, add_special_tokens=False).ids)
