"""Suffix arrays and removal of repeats against brute force."""

import hashlib
import random
from collections import Counter

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import types as T

from tutorlens.llm import suffix_dedup as sd


@settings(max_examples=200, deadline=None)
@given(st.lists(st.binary(min_size=1, max_size=40).map(lambda b: bytes(x % 3 for x in b)), min_size=1, max_size=6))
def test_suffix_array_and_prefixes(parts):
    data = b"".join(parts)
    arr = np.frombuffer(data, np.uint8)
    sa = sd.suffix_array(arr)
    assert sa.tolist() == sorted(range(len(data)), key=lambda i: data[i:])
    starts = np.cumsum([0, *map(len, parts)])[:-1]
    lcp = sd.common_prefixes(arr, sa, starts, 12)
    for r in range(1, len(data)):
        a, b = data[sa[r - 1]:], data[sa[r]:]
        same = next((i for i, (x, y) in enumerate(zip(a, b)) if x != y), min(len(a), len(b)))
        assert lcp[r] == min(12, same)


def test_large_suffix_array_without_packing(monkeypatch):
    rng = np.random.default_rng(5)
    data = rng.integers(0, 2, 1 << 21, dtype=np.uint8)
    data[1000:3000] = data[50_000:52_000]
    sa = sd.suffix_array(data)
    raw = data.tobytes()
    for r in rng.integers(1, len(raw), 2000).tolist():
        assert raw[sa[r - 1]:][:3000] < raw[sa[r]:][:3000]


def plain(texts, window=400):
    data = [(t or "").encode() for t in texts]
    count = Counter(d[i:i + window] for d in data for i in range(len(d) - window + 1))
    out = []
    for d in data:
        gone = np.zeros(len(d), bool)
        for i in range(len(d) - window + 1):
            if count[d[i:i + window]] > 1:
                gone[i:i + window] = True
        edges = np.diff(np.concatenate(([0], gone.astype(int), [0])))
        kept = np.frombuffer(d, np.uint8)[~gone].tobytes()
        out.append((len(d), int(gone.sum()), int((edges == 1).sum()), hashlib.sha256(kept).hexdigest()))
    return out


def corpus():
    rng = random.Random(11)
    words = lambda n: " ".join("".join(rng.choice("abcdefgé") for _ in range(rng.randint(1, 7))) for _ in range(n))
    passages = [words(150) for _ in range(4)]
    base = words(400)
    texts = [words(300) for _ in range(25)]
    texts += [words(40) + passages[i % 4] + words(40) for i in range(24)]
    for i in range(40):          # near copies of one text: most bytes shared, many different segments a key
        at = rng.randrange(len(base) - 10)
        texts.append(base[:at] + f"<{i}>" + base[at + 5:])
    texts += [words(200)] * 3 + [None, "", "x" * 399, "y" * 399, "z" * 401, "ab" * 1500, "ab" * 300, "q" * 6000]
    again = words(120)
    texts += [again + " middle " + again, passages[0], passages[1][:401], passages[1][:400], passages[2][3:403] + "tail"]
    return texts


SCHEMA = T.StructType([T.StructField(c, t) for c, t in (("doc_id", T.LongType()), ("text", T.StringType()), (
    "id", T.StringType()), ("tk", T.LongType()), ("covers", T.LongType()), ("sd", T.LongType()))])


@pytest.mark.parametrize("hot", [500, 3])
def test_repeats_equal_brute_force(spark, hot):
    texts = corpus()
    docs = spark.createDataFrame([(i, t, "c", 1, 2, 3) for i, t in enumerate(texts)], SCHEMA).repartition(5)
    rows = sd.repeats(docs, hot_segments=hot).collect()
    got = {r["doc_id"]: tuple(r)[1:5] for r in rows}
    assert [got[i] for i in range(len(texts))] == plain(texts)
    for r in rows:
        kept = r["text"].encode()
        assert len(kept) <= r["n_bytes"] - r["n_removed"] and (
            hashlib.sha256(kept).hexdigest() == r["kept_sha256"] or r["n_removed"])


def test_ids_that_are_null_or_repeat(spark):
    text = "".join(f"{i} " for i in range(200))
    rows = [(1, text), (1, text), (None, "k" + text), (None, "other"), (2, text + "!"), (2, "again other")]
    docs = spark.createDataFrame([(*r, "c", 1, 2, 3) for r in rows], SCHEMA)
    got = sorted(tuple(r)[1:5] for r in sd.repeats(docs).collect())
    assert got == sorted(plain([t for _, t in rows]))
    assert sd.repeats(docs.where("doc_id > 5")).count() == 0
    kept = sorted(r["text"] for r in sd.without_repeats(docs).collect())
    assert kept == ["!", "again other", "k", "other"]


def test_dealt_out_keys_pass_sorted_runs_not_rows(spark):
    base = " ".join(f"b{i * i % 977}" for i in range(300))
    texts = [base[:i * 11] + f"[{i}]" + base[i * 11:] for i in range(60)]
    docs = sd.keyed_rows(spark.createDataFrame([(i, t, "c", 1, 2, 3) for i, t in enumerate(texts)], SCHEMA))
    h1 = np.array([-2**63, -1, 0, 5, 2**63 - 1])
    assert sd.digest_part(h1, 7).tolist() == [3, 6, 0, 0, 3]
    covers = {r["id"]: r["covers"] for r in sd.covered_windows(docs.select("id", "text"), hot_segments=4).collect()}
    assert sum(1 for c in covers.values() if c) == len([1 for _, n, *_ in plain(texts) if n])


def test_blocks_of_a_long_text_cover_every_window_once():
    rng = np.random.default_rng(1)
    data = rng.integers(97, 100, 3 * sd.BLOCK + 12345, dtype=np.uint8).tobytes()
    at = 0
    for start, n, *_ in sd.segments_of(data):
        assert start == at
        at += n
    assert at == len(data) - sd.WINDOW + 1


def plain_passages(texts, words):
    data = [(t or "").split() for t in texts]
    count = Counter(tuple(d[i:i + words]) for d in data for i in range(len(d) - words + 1))
    out = []
    for t, d in zip(texts, data):
        gone = set()
        for i in range(len(d) - words + 1):
            if count[tuple(d[i:i + words])] > 1:
                gone.update(range(i, i + words))
        out.append(None if gone and len(gone) == len(d) else [w for i, w in enumerate(d) if i not in gone])
    return out


def test_passages_of_words_equal_brute_force(spark):
    """Planted passages of 51 to 60 short words, under 400 bytes, and one of 49 that stays."""
    rng = random.Random(3)
    words = lambda n: [rng.choice("abcdefgé") * rng.randint(1, 2) + str(rng.randrange(60)) for _ in range(n)]
    planted = {n: " ".join(words(n)) for n in (49, 50, 51, 53, 55, 58, 60)}
    assert all(len(p.encode()) < sd.WINDOW for p in planted.values())
    texts = [" ".join(words(200)) for _ in range(30)] + [None, "", "tail", "same " * 400, "a b " * 300, planted[51], "\n".join(words(30))]
    for n, p in planted.items():
        for k in range(3):
            texts.append(" ".join(words(40 + k)) + "\n" * (k + 1) + p + "\t" * k + " " + " ".join(words(70 - k)))
    docs = spark.createDataFrame([(i, t, "c", 1, 2, 3) for i, t in enumerate(texts)], SCHEMA).repartition(5)
    got = {r["doc_id"]: r["text"] for r in sd.without_passages(docs).collect()}
    for i, want in enumerate(plain_passages(texts, sd.PASSAGE_WORDS)):
        assert (got[i] or "").split() == want if want is not None else i not in got, (i, texts[i])
    assert got[30] is None and got[31] == "" and planted[49] in "".join(filter(None, got.values()))
    assert sd.without_passages(docs).columns == docs.columns
    assert sd.without_passages(docs.where("doc_id > 999")).isEmpty()


def test_hot_segments_and_keys_are_broadcast(spark, monkeypatch):
    """A text that most rows repeat, without an id, and a key with many different segments."""
    monkeypatch.setattr(sd, "HOT_SHARE", 5)
    passage = "".join(f"{i * 7 % 997} " for i in range(200))
    rows = [(None, passage)] * 60 + [(i, f"<{i}>" + passage + f"<{i}>") for i in range(20)] + [(99, "alone " * 3)]
    docs = spark.createDataFrame([(*r, "c", 1, 2, 3) for r in rows], SCHEMA).repartition(4)
    got = sorted(tuple(r)[1:5] for r in sd.repeats(docs, hot_segments=4).collect())
    assert got == sorted(plain([t for _, t in rows]))


def test_words_leave_no_memory():
    """A worker keeps nothing of the words that it has hashed, however many different ones it meets."""
    import tracemalloc

    sd.word_keys("warm up")
    tracemalloc.start()
    try:
        for i in range(40):
            assert len(sd.word_keys(" ".join(f"w{i}x{j}" for j in range(5000)))) == 5000 * sd.WORD_BYTES
        held = tracemalloc.get_traced_memory()[0]
    finally:
        tracemalloc.stop()
    assert held < 4 << 20
    assert sd.word_keys("a b\x1cc\x85 d\n\x0b\x0c e") == b"".join(sd.xxhash.xxh64_digest(w.encode(), 7) for w in ("a", "b\x1cc\x85", "d", "e"))


def test_passages_hold_the_text_once(spark, monkeypatch):
    """The exchange that brings documents and their covers together carries each text in its row only."""
    seen = []
    docs = spark.createDataFrame([(1, " ".join(f"w{i}" for i in range(60)), "s"), (2, None, "s"), (3, " ".join(f"w{i}" for i in range(60)), "t")],
                                 "doc_id long, text string, source string")
    cls = type(docs)
    real = cls.mapInArrow

    def spy(self, func, schema, *args, **kwargs):
        seen.append(self.columns)
        return real(self, func, schema, *args, **kwargs)

    monkeypatch.setattr(cls, "mapInArrow", spy)
    rows = sd.without_passages(docs).collect()
    assert [(r["doc_id"], r["text"], r["source"]) for r in rows] == [(2, None, "s")]
    assert ["row", "covers"] in seen
