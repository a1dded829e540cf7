"""Exact dedup against a dictionary, over loads, reopened and compacted indexes."""

import collections
import hashlib

import pytest

from tutorlens.llm import exact_dedup as ed
from tutorlens.session import scratch_path

SCHEMA = "doc_id long, text string, digest string, n int"
ROWS = ([(i, f"text {i % 7}", "x", i) for i in range(40)] + [(None, "text 1", "x", 1), (None, "only null ids", None, 2),
        (None, "only null ids", "y", 3), (50, None, "x", 4), (51, "", "x", 5), (7, "text 0", "x", 6), (60, " ", None, 7),
        (61, "é\u0000 long " * 20_000, "x", 8), (62, "é\u0000 long " * 20_000, "x", 9)]
        + [(35, "text 0", "x", 10)] * 3 + [(100 + i, "hot", "x", i) for i in range(60)])


def expected(rows):
    by = collections.defaultdict(list)
    for doc_id, text, *_ in rows:
        by[text or ""].append(doc_id)
    out = []
    for text, ids in by.items():
        ids.sort(key=lambda i: (i is not None, i or 0), reverse=True)
        out += [(i, ids[0], len(ids), k == 0, hashlib.sha256(text.encode()).hexdigest()) for k, i in enumerate(ids)]
    return collections.Counter(out)


@pytest.mark.parametrize("loads", [1, 2, 5])
def test_every_row_of_every_group(spark, loads):
    docs = spark.createDataFrame(ROWS, SCHEMA).repartition(5)
    index = ed.DigestIndex(spark, scratch_path(spark, "index"), buckets=3)
    got = collections.Counter(tuple(r) for r in ed.exact_duplicates(docs, index, loads).collect())
    assert got == expected(ROWS)


def test_later_loads_meet_the_index_without_shuffling_it(spark):
    path = scratch_path(spark, "index")
    docs = spark.createDataFrame(ROWS, SCHEMA)
    first = ed.unseen(docs.where("n < 6"), ed.DigestIndex(spark, path, buckets=4))
    assert first.columns == docs.columns
    first = {r["text"] or "" for r in first.collect()}
    assert first == {t or "" for _, t, _, n in ROWS if n < 6}
    index = ed.DigestIndex(spark, path)            # opened again: the layout is the index's own
    assert index.buckets == 4
    second = ed.unseen(docs.where("n >= 6"), index).collect()
    assert {r["text"] for r in second} == {t for _, t, _, n in ROWS if n >= 6} - first
    assert len(second) == len({r["text"] for r in second})
    before = {bytes(r["digest"]): (r["top"]["doc_id"], r["group_size"]) for r in index.groups().collect()}
    assert sum(n for _, n in before.values()) == len(ROWS)
    index.compact()
    again = ed.DigestIndex(spark, path)
    assert {bytes(r["digest"]): (r["top"]["doc_id"], r["group_size"]) for r in again.groups().collect()} == before
    assert again.log().count() == len(before)
    assert ed.unseen(docs, again).isEmpty()
    plan = again.log().groupBy("digest").count()._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan
    known = again.log().select("digest").hint("merge")
    plan = ed.digests(docs).join(known, "digest", "left_anti")._jdf.queryExecution().executedPlan().toString()
    assert "SortMergeJoin" in plan and plan.count("Exchange hashpartitioning") == 1


def test_a_broken_load_is_never_read(spark, monkeypatch):
    index = ed.DigestIndex(spark, scratch_path(spark, "index"), buckets=2)
    rows = ed.numbered(ed.digests(spark.createDataFrame(ROWS, SCHEMA)))
    index.append(rows)
    whole = index.groups().count()
    other = ed.numbered(ed.digests(spark.createDataFrame([(1, "new", "", 0)], SCHEMA)))
    monkeypatch.setattr(index, "loads", lambda kept=index.loads(): kept)
    index.append(other)
    assert index.groups().count() == whole


def test_empty_table(spark):
    docs = spark.createDataFrame([], SCHEMA)
    index = ed.DigestIndex(spark, scratch_path(spark, "index"), buckets=2)
    assert ed.exact_duplicates(docs, index).isEmpty() and ed.unseen(docs, index).isEmpty()
