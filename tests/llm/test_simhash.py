"""SimHash fingerprints, covering masks and components against brute force."""

import random
from itertools import combinations

import numpy as np
import xxhash
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tutorlens.llm import simhash
from tutorlens.llm.graph import connected_components


def plain_simhash(text, k=3):
    import re
    low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    words = re.findall(r"[^\x20\x09-\x0D]+", low)
    if not words:
        return 0
    shingles = [" ".join(words[i:i + k]) for i in range(len(words) - k + 1)] or [" ".join(words)]
    hashes = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def components(values, radius=3):
    parent = {v: v for v in values}

    def find(x):
        while parent[x] != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x
    for a, b in combinations(sorted(parent), 2):
        if (a ^ b).bit_count() <= radius:
            parent[find(a)] = find(b)
    return {v: find(v) for v in parent}


def partition(pairs):
    groups = {}
    for k, g in pairs:
        groups.setdefault(g, set()).add(k)
    return sorted(map(sorted, groups.values()))


def test_fingerprint_equals_definition():
    rng = random.Random(3)
    for text in ["", " \n", "One", "ONE two", "a b c", "É ÀB x\x0by   z", "x " * 500,
                 *(" ".join(rng.choice(["Aa", "bé", "ccc", "d"]) for _ in range(n)) for n in range(1, 60))]:
        assert simhash.simhash(text) == plain_simhash(text)


def test_masks_cover_every_pair_within_the_radius():
    for radius, level in ((3, 0), (3, 1), (2, 0), (1, 5)):
        masks = simhash.covering_masks(radius, level)
        assert len(masks) == 2 ** (radius + 1) - 1
        rng = random.Random(level)
        for _ in range(3000):
            diff = sum(1 << b for b in rng.sample(range(64), radius))
            assert any(not diff & m for m in masks)
        union = 0
        for m in masks:
            union |= m
        assert union == (1 << 64) - 1


def hot_values(rng):
    base = rng.getrandbits(64)
    values = {base}
    while len(values) < 900:   # one dense cloud around a value, and others at random or in chains
        values.add(base ^ sum(1 << b for b in rng.sample(range(64), rng.randint(1, 5))))
    for _ in range(20):
        x = rng.getrandbits(64)
        for _ in range(6):
            values.add(x)
            x ^= sum(1 << b for b in rng.sample(range(64), rng.randint(1, 4)))
    return values


def test_links_with_split_buckets_give_the_brute_force_components(spark):
    values = hot_values(random.Random(8))
    nodes = spark.createDataFrame([(simhash.signed(v),) for v in values], "fp long")
    links = [(r["a"] % 2**64, r["b"] % 2**64) for r in simhash.near_links(nodes, bucket_limit=20).collect()]
    assert all((a ^ b).bit_count() <= 3 for a, b in links)
    assert len(links) <= 15 * 15 * 15 * len(values)
    parent = {v: v for v in values}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x
    for a, b in links:
        parent[find(a)] = find(b)
    assert partition((v, find(v)) for v in values) == partition(components(values).items())


def test_forest_is_smaller_than_all_pairs():
    values = np.array(sorted(hot_values(random.Random(4))), np.uint64)
    assert len(simhash.spanning_links(values, 3)) < len(values)


def test_components_of_a_long_path_and_a_star(spark):
    edges = [(i, i + 1) for i in range(100, 140)] + [(7, x) for x in range(200, 260)] + [(5, 5)]
    got = {r["node"]: r["root"] for r in connected_components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {**{i: 100 for i in range(100, 141)}, 7: 7, **{x: 7 for x in range(200, 260)}}


SCHEMA = T.StructType([T.StructField("doc_id", T.LongType()), T.StructField("text", T.StringType()),
                       T.StructField("fp", T.StringType()), T.StructField("key", T.LongType()),
                       T.StructField("component_id", T.LongType())])


def test_documents_edge_cases(spark):
    long = " ".join(f"w{i}" for i in range(3000))
    rows = [(9, long), (4, long + " extra"), (6, None), (8, ""), (2, " \t"), (5, "solo"), (5, "solo"), (None, "solo"),
            (None, "alone text here now"), (1, long.upper())]
    docs = spark.createDataFrame([(a, b, "clash", 1, 7) for a, b in rows], SCHEMA)
    got = [(r["doc_id"], r["fingerprint"], r["component_id"]) for r in simhash.simhash_components(docs).collect()]
    prints = [plain_simhash(b) for _, b in rows]
    comp = components(set(prints))
    want = []
    for (doc, _), p in zip(rows, prints):
        own = [d for (d, _), q in zip(rows, prints) if comp[q] == comp[p] and d is not None]
        want.append((doc, f"{p:016x}", min(own, default=None)))
    key = lambda r: tuple((x is not None, x) for x in r)
    assert sorted(got, key=key) == sorted(want, key=key)
    assert simhash.simhash_components(docs.where("doc_id > 99")).count() == 0
    assert "clash" not in simhash.simhash_components(docs).columns and F
