"""The prefix trie against a plain dictionary of prefixes."""

import collections
import hashlib
import random
import zlib

import pytest

from tutorlens.llm import prefix_trie as pt

SCHEMA = "conv_id long, turn long, role string, text string, depth int, k1 string"


def brute(rows):
    own = collections.defaultdict(list)
    for conv, turn, role, text, *_ in rows:
        if conv is not None:
            role, text = role or "", text or ""
            tid = hashlib.sha256(f"{len(role)}:{role}{text}".encode()).hexdigest()[:32]
            own[conv].append(((turn is not None, turn or 0, role, tid), (role, text)))
    own = {c: [x for _, x in sorted(t)] for c, t in own.items()}
    members = collections.defaultdict(list)
    for c in sorted(own):
        h = zlib.crc32(str(c).encode()) % 6
        base = c - (abs(c) % 100) * (1 if c >= 0 else -1)
        path = tuple(own.get(base, [])[:h] + own[c][h:])
        for d in range(len(path) + 1):
            members[path[:d]].append((c, len(path)))
    saved, leaves, children = collections.Counter(), collections.Counter(), collections.Counter()
    for prefix, own_members in members.items():
        if prefix:
            children[prefix[:-1]] += 1
        leaf = all(n == len(prefix) for _, n in own_members)
        for d in range(len(prefix) + 1):
            saved[prefix[:d]] += (len(own_members) - 1) * len(prefix[-1][1]) if prefix else 0
            leaves[prefix[:d]] += leaf
    return sorted((m[0][0], len(p), members[p[:-1]][0][0] if p else None, len(m), children[p], leaves[p], saved[p],
                   hashlib.sha256(",".join(str(c) for c, n in m if n == len(p)).encode()).hexdigest())
                  for p, m in members.items())


def tidy(df):
    names = ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256"]
    return sorted(tuple(r[n] for n in names) for r in df.collect())


def conversations(seed, convs=60, longest=9):
    rng = random.Random(seed)
    rows = []
    for c in [0, 100, 200, -100, *rng.sample(range(-250, 330), convs)]:
        for t in range(rng.randint(1, longest)):
            rows.append((c, rng.choice([t, t, t // 2, None]), rng.choice(["user", "assistant", None]),
                         rng.choice(["a", "b", "", None, "é" * 5]), t, "x"))
    return rows


@pytest.mark.parametrize("seed,width", [(1, 8), (2, 2), (3, 3)])
def test_equals_brute_force(spark, seed, width):
    rows = conversations(seed)
    rows += [(None, 0, "user", "no conversation", 0, ""), (7, 0, "user", "same", 0, ""), (7, 0, "user", "same", 1, "")]
    df = spark.createDataFrame(rows, SCHEMA).repartition(5)
    assert tidy(pt.conversation_trie(df, width)) == brute(rows)


def test_long_and_common_conversations(spark, monkeypatch):
    """A conversation over many ranges, blocks and spans; a beginning that most share; many ids that end at one node."""
    monkeypatch.setattr(pt, "SPAN", 4)
    monkeypatch.setattr(pt, "JOINED", 40)
    rows = [(300, t, "user", f"turn {t % 3}" * 3, 0, "") for t in range(200)]
    rows += [(301, t, "user", f"turn {t % 3}" * 3, 0, "") for t in range(120)]
    rows += [(c, t, "user", "hello" if t < 2 else f"{c % 3}", 0, "") for c in range(1000, 1090) for t in range(3)]
    rows += [(c, 0, "user", "hi " * 40_000, 0, "") for c in (2001, 2002)]
    df = spark.createDataFrame(rows, SCHEMA).repartition(6)
    assert tidy(pt.conversation_trie(df, 4)) == brute(rows)


def test_turnless_conversations_and_empty_tables(spark):
    short = [c for c in range(1, 99) if zlib.crc32(str(c).encode()) % 6 > 0][:5]
    rows = [(c, 0, "user", "only", 0, "") for c in short]     # the lending conversation 0 is absent
    got = tidy(pt.conversation_trie(spark.createDataFrame(rows, SCHEMA)))
    assert got == brute(rows)
    assert [r[:2] for r in got] == [(short[0], 0)] and got[0][3] == 5
    assert pt.conversation_trie(spark.createDataFrame([], SCHEMA)).isEmpty()


def test_one_rollup_aggregates_all_levels(spark):
    plan = pt.rolled_up(spark.createDataFrame([(1, 0, 0, 0, "x:1", None)], "conv_id long, block long, k1 long, k2 long, t1 string, t2 string"),
                        2, ["count(1) AS n_convs"])._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Expand") == 1 and plan.count("Exchange hashpartitioning") == 1
