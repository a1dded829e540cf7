"""Water-filling and sampling against an iterative brute force and DuckDB."""

import duckdb
import pytest
from pyspark.sql import types as T

from tutorlens.llm import mixing

SCHEMA = T.StructType([T.StructField(c, t) for c, t in (("doc_id", T.LongType()), ("text", T.StringType()), (
    "source", T.StringType()), ("size", T.StringType()), ("target", T.LongType()))])


def iterate(sizes, weights=(5, 2, 1), cap=3):
    """Redistribute excess by weight until none is above its cap."""
    names = sorted(sizes, key=lambda s: (s is None, s))
    w = {s: weights[i % len(weights)] for i, s in enumerate(names)}
    total, fixed = sum(sizes.values()), {}
    while True:
        free = [s for s in names if s not in fixed]
        left, share = total - sum(fixed.values()), sum(w[s] for s in free)
        over = [s for s in free if w[s] * left >= cap * sizes[s] * share]
        if not over:
            return {**fixed, **{s: w[s] * left / share for s in free}}
        fixed.update({s: cap * sizes[s] for s in over})
        if len(fixed) == len(names):
            return fixed


@pytest.mark.parametrize("sizes", [
    {"a": 100, "b": 100, "c": 100}, {"a": 1, "b": 1000, "c": 5, "d": 70, None: 30}, {"a": 0, "b": 10}, {"a": 0},
    {f"s{i:02}": (i * 37) % 101 for i in range(40)}, {"é": 5, "z": 50, "Z": 500, None: 1}])
def test_targets_equal_the_iteration(spark, sizes):
    table = spark.createDataFrame(list(sizes.items()), "source string, source_size long")
    got = {r["source"]: r["target"] for r in mixing.source_targets(table).collect()}
    assert got == pytest.approx(iterate(sizes))
    assert sum(got.values()) == pytest.approx(sum(sizes.values()))


def rows_for():
    rows = [(i, "w " * (i * 13 % 57), f"s{i % 7 % 4}") for i in range(300)] + [(i, "hot word", "s0") for i in range(300, 500)]
    return rows + [(600, None, "s1"), (601, "", None), (602, "null source", None), (603, None, None), (None, "no id", "s2"),
                   (604, "long " * 9000, "s3"), (605, "twice", "s1"), (605, "twice", "s1"), (605, "twice other", "s1"),
                   (606, None, "only null")]


def test_mix_reaches_targets_and_equals_sql(spark):
    rows = rows_for()
    docs = spark.createDataFrame([(*r, "clash", 5) for r in rows], SCHEMA).repartition(5)
    got = [tuple(r) for r in mixing.mix(docs).collect()]
    assert len(got) == len(rows)
    taken, target = {}, {}
    for _, source, size, own, t, k in got:
        assert 0 <= k <= 3 * size
        taken[source] = taken.get(source, 0) + k
        target[source] = t
        assert size <= own
    assert all(abs(taken[s] - target[s]) <= 0.5 + 1e-6 for s in target)
    con = duckdb.connect()
    con.execute("create table documents(doc_id bigint, text varchar, source varchar)")
    con.executemany("insert into documents values (?, ?, ?)", rows)
    key = lambda r: tuple((x is not None, x) for x in r)
    want = con.sql(mixing.MIX_SQL.format(docs="documents")).fetchall()
    assert sorted(map(tuple, want), key=key) == sorted(got, key=key)
    again = [tuple(r) for r in mixing.mix(docs.repartition(2)).collect()]
    assert sorted(again, key=key) == sorted(got, key=key)
    assert mixing.mix(docs.where("doc_id > 9999")).count() == 0


def test_the_mix_is_the_same_over_any_partitions(spark):
    """Rows with one doc_id and equal sizes, and different texts."""
    rows = [(i % 9, f"word{i} two three", f"s{i % 3}", "x", i) for i in range(400)] + [(None, f"a{i} b", "s1", None, i) for i in range(40)]
    docs = spark.createDataFrame(rows, SCHEMA)
    got = [sorted(map(str, mixing.mixed(docs.repartition(n)).collect())) for n in (3, 7)]
    assert got[0] == got[1] and got[0]


@pytest.mark.parametrize("hot", [1000, 2])
def test_repeated_rows_are_taken_one_by_one(spark, monkeypatch, hot):
    """300 rows alike in a source whose target ends among them."""
    from tutorlens.llm import common
    monkeypatch.setattr(common, "HOT_SHARE", hot)
    rows = [(1, "same words here", "a", "x", 1)] * 300 + [(i, "other " * 7, "b", "x", 1) for i in range(100)] + [
        (i, "third " * 5, "c", "x", 1) for i in range(200)]
    docs = spark.createDataFrame(rows, SCHEMA).repartition(5)
    target = {r["source"]: r["target"] for r in mixing.plan_rows(docs).collect()}
    words = {}
    for r in mixing.mixed(docs).collect():
        words[r["source"]] = words.get(r["source"], 0) + len(r["text"].split())
    assert all(abs(words[s] - t) <= 7 for s, t in target.items()), (words, target)
    assert 900 < target["a"] < 2700 and target["a"] % 900
