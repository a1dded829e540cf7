"""Syncmer fingerprints against a plain implementation; next documents and edits against sorting."""

import hashlib
import re
import struct

import xxhash
from pyspark.sql import types as T

from tutorlens.llm import syncmers


def sg(x):
    return x - 2**64 if x >> 63 else x


def chain(*values):
    seed = 42
    for v in values:
        seed = xxhash.xxh64_intdigest(v.encode() if isinstance(v, str) else struct.pack("<q", v), seed)
    return sg(seed)


def plain_anchors(text, k=5, s=2):
    words = [chain(w) for w in re.findall(r"[^\x20\x09-\x0D]+", text)]
    if not words:
        return {}
    if len(words) < k:
        return {0: chain(*words)}
    inner = [chain(*words[i:i + s]) for i in range(len(words) - s + 1)]
    out = {}
    for i in range(len(words) - k + 1):
        own = inner[i:i + k - s + 1]
        if min(own) in (own[0], own[-1]):
            out[i] = chain(inner[i], inner[i + 2], words[i + 4])
    return out


def plain_print(text, sketch=128):
    return sorted({(x % 2**64) >> 32 for x in plain_anchors(text).values()})[:sketch]


def plain_likeness(a, b, sketch=128):
    union = sorted(set(a) | set(b))[:sketch]
    return len([x for x in union if x in a and x in b]) / len(union) if union else 1.0


SCHEMA = T.StructType([T.StructField(c, t) for c, t in (("doc_id", T.LongType()), ("text", T.StringType()), (
    "id", T.StringType()), ("bucket", T.LongType()), ("own", T.LongType()), ("fingerprint", T.LongType()))])


def rows_for(n):
    words = [f"w{i * i % 97}" for i in range(4000)]
    rows = [(i * 7 % 1001 * 3, " ".join(words[i % 50: i % 50 + 3 * (i % 40)])) for i in range(n)]
    return rows + [(5, None), (11, ""), (14, " \n\t "), (17, "é日本 one"), (20, "a b c d e"), (23, " ".join(words)),
                   (26, "x" * 50001), (29, "same text here as the next one"), (32, "same text here as the next one"),
                   (35, "tied"), (35, "tied"), (35, "other tied"), (None, "no id"), (None, None)]


def check(spark, rows, bucket_rows):
    docs = spark.createDataFrame([(*r, "c", 1, 2, 3) for r in rows], SCHEMA).repartition(3)
    got = [tuple(r) for r in syncmers.fingerprints(docs, bucket_rows=bucket_rows).collect()]
    order = sorted(((d if d is not None else -2**63, t or "") for d, t in rows), key=lambda r: (-r[0], r[1].encode()))
    want = []
    for i, (doc, text) in enumerate(order):
        following = order[(i + 1) % len(order)][1]
        half = len(text) // 2
        edited = text[:len(text) - half] + following[:half]
        a, b, c = map(plain_print, (text, edited, following))
        want.append((None if doc == -2**63 else doc, len(text), hashlib.sha256(edited.encode()).hexdigest(),
                     "".join(f"{x:08x}" for x in a), "".join(f"{x:08x}" for x in b), plain_likeness(a, b),
                     plain_likeness(a, c)))
    key = lambda r: tuple((x is not None, x) for x in r)
    assert sorted(got, key=key) == sorted(want, key=key)


def test_fingerprints_equal_brute_force(spark):
    check(spark, rows_for(120), 5)
    check(spark, rows_for(20), 256)
    check(spark, [(3, "one row alone is its own next document")], 256)


def test_empty_table_and_positions(spark):
    assert syncmers.fingerprints(spark.createDataFrame([], SCHEMA)).count() == 0
    docs = spark.createDataFrame([(*r, "c", 1, 2, 3) for r in rows_for(40)], SCHEMA)
    got = {(r["doc_id"], r["position"], r["anchor"]) for r in syncmers.anchors(docs).collect()}
    assert got == {(d, p, a) for d, t in rows_for(40) for p, a in plain_anchors(t or "").items()}


def test_anchors_do_not_depend_on_context():
    core = " ".join(f"c{i}" for i in range(60))
    inside = set(plain_anchors(core).values())
    assert inside <= set(plain_anchors(f"left words {core} right words").values())
    assert 0.3 < len(inside) / 56 < 0.7


def test_native_plan(spark):
    docs = spark.createDataFrame([(*r, "c", 1, 2, 3) for r in rows_for(20)], SCHEMA)
    plan = syncmers.fingerprints(docs)._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Pandas" not in plan and "Arrow" not in plan


def test_whole_fingerprints_find_a_short_common_passage(spark):
    words = lambda name, n: [f"{name}{i}" for i in range(n)]
    core = words("c", 100)
    texts = {2: " ".join(words("a", 5000) + core + words("b", 4900)), 1: " ".join(words("d", 900) + core + words("e", 9000)),
             0: None, -1: "two words", -2: "x"}
    docs = spark.createDataFrame([(d, t, "c", 1, 2, 3) for d, t in texts.items()], SCHEMA)
    got = {r["doc_id"]: r for r in syncmers.whole_fingerprints(docs).collect()}
    sketched = {r["doc_id"]: r for r in syncmers.fingerprints(docs).collect()}
    order = sorted(texts, reverse=True)
    for d, after in zip(order, order[1:] + order[:1]):
        text, following = texts[d] or "", texts[after] or ""
        half = len(text) // 2
        edited = text[:len(text) - half] + following[:half]
        own, changed, other = (set(plain_anchors(t).values()) for t in (text, edited, following))
        assert {(p, a) for p, a in got[d]["anchors"]} == set(plain_anchors(text).items())
        assert {(p, a) for p, a in got[d]["edited_anchors"]} == set(plain_anchors(edited).items())
        assert got[d]["near_edited"] == (len(own & changed) / len(own | changed) if own | changed else 1.0)
        assert got[d]["near_next"] == (len(own & other) / len(own | other) if own | other else 1.0)
        assert got[d]["fingerprint"] == "".join(f"{x % 2**64:016x}" for x in sorted(own))
        assert got[d]["edited_fingerprint"] == "".join(f"{x % 2**64:016x}" for x in sorted(changed))
        assert got[d]["edited_sha256"] == sketched[d]["edited_sha256"]
        # the likenesses follow from the returned strings alone
        prints = [{f[i:i + 16] for i in range(0, len(f), 16)} for f in (
            got[d]["fingerprint"], got[d]["edited_fingerprint"], got[after]["fingerprint"])]
        for name, print_ in (("near_edited", prints[1]), ("near_next", prints[2])):
            every = prints[0] | print_
            assert got[d][name] == (len(prints[0] & print_) / len(every) if every else 1.0)
    assert got[2]["near_next"] > 0
    plan = syncmers.whole_fingerprints(docs)._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan
