"""Token encoding, record files and packing against brute force."""

import random
import zlib

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import types as T

from tutorlens.llm import packing, token_records
from tutorlens.llm.encoding import Encoder, tokenizer_path

SCHEMA = T.StructType([T.StructField("doc_id", T.LongType()), T.StructField("text", T.StringType()),
                       T.StructField("shard", T.StringType()), T.StructField("start", T.LongType())])
ROWS = [(3, "alpha beta  gamma\n delta", "x", 1), (1, None, None, None), (2, "", "y", 2), (5, "word " * 6000, "z", 3),
        (7, " lead and trail ", "q", 0), (7, "same id, other text", "q", 0), (9, "tie tie", "a", 0), (9, "tie tie", "a", 0),
        (None, "no id", None, None), (4, "naïve café – 日本語  x   y's <|endoftext|>", None, None)]


@pytest.fixture(scope="module")
def enc():
    return Encoder(tokenizer_path())


def whole(enc, text):
    return list(enc.tokenizer.encode(text or "", add_special_tokens=False).ids)


@settings(max_examples=2000, deadline=None)
@given(st.text(alphabet=st.sampled_from(list("ab'st.,1 \n\t\r  \x1cé日")), max_size=40))
def test_chunked_encoding_equals_whole_text_encoding(text):
    enc = test_chunked_encoding_equals_whole_text_encoding.__dict__.setdefault("enc", None) or Encoder(tokenizer_path())
    test_chunked_encoding_equals_whole_text_encoding.enc = enc
    assert np.frombuffer(enc.encode_bytes(text), "<u4").tolist() == whole(enc, text)


def test_frames_detect_damage():
    import io
    payload = token_records.serialize(-5, np.arange(10, dtype="<u4"), False)
    data = token_records.frame(payload)
    doc_id, ids = token_records.parse(token_records.read_record(io.BytesIO(data)))
    assert doc_id == -5 and ids.tolist() == list(range(10))
    for at in (0, 9, 20, len(data) - 1):
        bad = bytearray(data)
        bad[at] ^= 1
        with pytest.raises(ValueError):
            token_records.read_record(io.BytesIO(bytes(bad)))


def test_records_round_trip(spark, tmp_dir, enc):
    docs = spark.createDataFrame(ROWS, SCHEMA).repartition(3)
    index = token_records.write_token_records(docs, tmp_dir + "/r", tokenizer_path())
    got = sorted(token_records.record_digests(index, tmp_dir + "/r").collect(), key=lambda r: r["start"])
    want, at = [], 0
    for doc_id, text, *_ in sorted(ROWS, key=lambda r: (r[0] is not None, r[0] or 0, r[1] or "")):
        ids = whole(enc, text) + [2]
        want.append((doc_id, at, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())))
        at += len(ids)
    assert [tuple(r) for r in got] == want
    some = index.where("doc_id in (3, 5)").orderBy("n_tokens")
    back = {r["doc_id"]: list(r["ids"]) for r in token_records.read_token_records(some, tmp_dir + "/r").collect()}
    assert back == {3: whole(enc, ROWS[0][1]) + [2], 5: whole(enc, ROWS[3][1]) + [2]}


def test_empty_tables(spark, tmp_dir):
    none = spark.createDataFrame([], SCHEMA)
    index = token_records.write_token_records(none, tmp_dir + "/e", tokenizer_path())
    assert token_records.record_digests(index, tmp_dir + "/e").count() == 0
    assert packing.pack_documents(none, tokenizer_path()).count() == 0


@settings(max_examples=100, deadline=None)
@given(st.lists(st.integers(1, 9000), max_size=60))
def test_pack_places_every_token_once_without_padding(lengths):
    windows = packing.pack(lengths)
    seen = {}
    for tier, pieces in windows:
        assert sum(n for _, _, n in pieces) == tier
        for doc, start, n in pieces:
            seen.setdefault(doc, []).append((start, n))
    for doc, n in enumerate(lengths):
        at = 0
        for start, k in sorted(seen[doc]):
            assert start == at
            at += k
        assert at == n
    groups = packing.step_groups(windows)
    for g in set(groups):
        own = [w[0] for w, k in zip(windows, groups) if k == g]
        assert len(set(own)) == 1 and len(own) <= packing.STEP_WINDOWS


def test_smallest_tier_is_padded_at_most_once():
    windows = packing.pack([100, 700, 33], tiers=(512, 256))
    assert sum(sum(n for *_, n in p) for _, p in windows) == 833
    assert [sum(n for *_, n in p) for t, p in windows] == [512, 256, 65]


def test_step_groups_balance_costs():
    rng = random.Random(1)
    windows = packing.pack([rng.randint(1, 2048) for _ in range(400)])
    groups = packing.step_groups(windows)
    cost = {}
    for (tier, pieces), g in zip(windows, groups):
        if tier == 2048:
            cost[g] = cost.get(g, 0) + sum(n * n for *_, n in pieces)
    assert max(cost.values()) < 1.5 * min(cost.values())


def test_pack_documents_against_encoding(spark, enc):
    docs = spark.createDataFrame(ROWS, SCHEMA).repartition(2)
    rows = packing.pack_documents(docs, tokenizer_path(), buffer_tokens=3000).collect()
    by_seq, by_doc = {}, {}
    for r in rows:
        by_seq.setdefault(r["sequence_id"], []).append((r["offset"], r["length"], r["tier"]))
    for pieces in by_seq.values():
        at = 0
        for offset, length, tier in sorted(pieces):
            assert offset == at
            at += length
        assert at == tier
    want = sorted(len(whole(enc, r[1])) + 1 for r in ROWS)
    assert sum(r["length"] for r in rows) == sum(want)
    assert sorted(r["doc_tokens"] for r in rows if r["start"] == 0) == want
    ids = whole(enc, ROWS[3][1]) + [1]
    for r in rows:
        if r["doc_id"] == 5:
            piece = np.array(ids[r["start"]:r["start"] + r["length"]], "<u4").tobytes()
            assert r["ids_crc32"] == zlib.crc32(piece)


ADDED = ["a <|endoftext|> b", "<|endoftext|>", "x<|endoftext|>y's  <|endoftext|>\n", " <|endoftext|><|endoftext|> <|endoftext", "é <|endoftext|>日"]


def plain_tokenizer(path):
    import tokenizers

    made = tokenizers.Tokenizer.from_file(path)
    return lambda text: made.encode(text, add_special_tokens=False).ids


@settings(max_examples=500, deadline=None)
@given(st.lists(st.sampled_from(["<|endoftext|>", "<|", " ", "  ", "a", "'s", "é", "\n", "1"]), max_size=12).map("".join))
def test_added_tokens_are_encoded_as_the_file_says(text):
    made = test_added_tokens_are_encoded_as_the_file_says.__dict__
    if "enc" not in made:
        made.update(enc=Encoder(tokenizer_path()), plain=plain_tokenizer(tokenizer_path()))
    for t in (text, *ADDED):
        assert np.frombuffer(made["enc"].encode_bytes(t), "<u4").tolist() == made["plain"](t)
    assert made["plain"](ADDED[0]) == [64, 220, 50256, 275]


def test_added_tokens_that_reach_over_a_space(tmp_path):
    import tokenizers

    from tutorlens.llm.edit_counts import TokenTree

    made = tokenizers.Tokenizer.from_file(tokenizer_path())
    made.add_tokens([tokenizers.AddedToken("two words"), tokenizers.AddedToken("<eat>", lstrip=True, rstrip=True)])
    made.save(str(tmp_path / "t.json"))
    enc, plain = Encoder(str(tmp_path / "t.json")), plain_tokenizer(str(tmp_path / "t.json"))
    for text in ("a two words b", "a <eat> b <|endoftext|> c", "no such token"):
        assert np.frombuffer(enc.encode_bytes(text), "<u4").tolist() == plain(text)
        tree = TokenTree(enc, text)
        assert tree.n_tokens == len(plain(text))
        tree.edit(2, 0, "two ")
        assert tree.n_tokens == len(plain(text[:2] + "two " + text[2:]))


def test_each_tier_packs_its_own_documents():
    rng = random.Random(4)
    lengths = [int(2 ** rng.uniform(3, 11)) for _ in range(4000)]
    windows = packing.pack(lengths)
    tier_of = lambda n: min(t for t in packing.TIERS if t >= n)
    count = {t: sum(w[0] == t for w in windows) for t in packing.TIERS}
    for tier in (2048, 1024, 512, 256, 128):
        own = [p for t, p in windows if t == tier]
        assert count[tier] > 50
        # each window is opened by a piece that was routed to its tier; what follows fills its gap
        assert all(tier_of(p[0][2]) == tier for p in own)
    # a document of a tier lies in a window of its tier, but for those that fill the gaps of longer ones
    at_home = sum(len(p) == 1 or tier_of(p[0][2]) == t for t, p in windows)
    assert at_home == len(windows)
    groups, cost = packing.step_groups(windows), {}
    for (tier, pieces), g in zip(windows, groups):
        cost.setdefault(tier, {}).setdefault(g, []).append(sum(n * n for *_, n in pieces))
    for tier in (2048, 1024, 512):
        mean = [sum(c) / len(c) for c in cost[tier].values()]
        assert len(mean) > 5 and max(mean) < 1.3 * min(mean)


def test_short_documents_do_not_go_to_the_longest_tier():
    windows = packing.pack([200] * 3000)
    assert {t for t, _ in windows if t > 256} == set()
    assert sum(n for _, p in windows for *_, n in p) == 600_000
