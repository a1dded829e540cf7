"""Removal of repeated byte strings with suffix arrays.

Every byte covered by a ``WINDOW``-byte string that also starts anywhere else (same document or another) is removed.

1. Segments. Each document's windows (start positions of ``WINDOW`` bytes) are keyed by the smallest
   hash of the ``GRAM``-byte strings inside; neighbouring windows with one key form a segment. Equal windows have
   equal keys, and every window lies in exactly one segment, so repeats can only be found between segments of
   one key. Segments with equal bytes are merged with a partially aggregated count first; those that occur
   twice are repeated as a whole. Only keys with several different segments need their bytes compared.
2. Shards. The segments of a key go to one shard. A key with more than ``hot_segments`` different ones is dealt
   over as many shards as it needs. Each shard (some keys, about ``SHARD_BYTES`` long) builds a suffix array by
   Larsson-Sadakane refinement (only unsorted groups are sorted again, by the rank ``h`` further, ``h`` doubling) and
   its common prefixes by Kasai's rule, run over all segments in step. Suffixes whose common
   prefixes reach ``WINDOW`` are one class; a class with two windows is repeated.
3. Merging. Shards of a dealt-out key pass on one digest per class, sorted, in as many ranges as the key has shards. The
   digests of one range from all shards meet, and each is looked up by binary search; found twice means repeated in two shards.
4. Runs of repeated windows go back to every document that holds the segment, and the covered bytes are cut out.

``without_passages`` removes passages of ``PASSAGE_WORDS`` or more words in the same way: each word is a number of ``WORD_BYTES``
bytes (its hash), a document the string of these, and the window as many words long.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import HOT_SHARE, WORD_PATTERN, documents, ids_and_text, join_groups, values, written

WINDOW = 400
GRAM = 32
SHARD_BYTES = 1 << 20
HOT_SEGMENTS = 500
MAX_SEGMENT_WINDOWS = 2048
BLOCK = 1 << 20
PREFIX = 4            # bytes that the first sort of a suffix array looks at
STRIDE = 64           # positions from one start of Kasai's rule to the next
PASSAGE_WORDS = 50
WORD_BYTES = 8
NO_ID = -(1 << 63)

SEGMENT_SCHEMA = "id long, tk long, start long, windows int, mv long, sd binary, again boolean"


# --- segments ---------------------------------------------------------------------------------------------------

def gram_hashes(data: np.ndarray) -> np.ndarray:
    """A 64-bit hash of the GRAM bytes at each position, by doubling."""
    h = data.astype(np.uint64) + np.uint64(1)
    size, mult = 1, 0x9E3779B97F4A7C15
    while size < GRAM:
        m = np.uint64(mult)
        h = h[:-size] * m + h[size:]
        h ^= h >> np.uint64(31)
        size, mult = 2 * size, (mult * 0xD1342543DE82EF95 + 0x2545F4914F6CDD1D | 1) % (1 << 64)
    h *= np.uint64(0xBF58476D1CE4E5B9)
    return h ^ (h >> np.uint64(32))


def sliding_min(h: np.ndarray, width: int) -> np.ndarray:
    out, size = h, 1
    while 2 * size <= width:
        out = np.minimum(out[:-size], out[size:])
        size *= 2
    rest = width - size
    return np.minimum(out[:-rest], out[rest:]) if rest else out


def segments_of(data: bytes, window: int = WINDOW):
    """Per segment: first window's start, number of windows, key, digest, whether the key's hash occurs twice inside."""
    reach = window - GRAM + 1
    for at in range(0, len(data) - window + 1, BLOCK):
        part = data[at:at + BLOCK + window - 1]
        h = gram_hashes(np.frombuffer(part, np.uint8))
        low = sliding_min(h, reach)
        begin = np.concatenate(([0], np.flatnonzero(low[1:] != low[:-1]) + 1))
        size = np.diff(np.append(begin, len(low)))
        if size.max() > MAX_SEGMENT_WINDOWS:
            cuts = [np.arange(b, b + n, MAX_SEGMENT_WINDOWS) for b, n in zip(begin, size)]
            begin = np.concatenate(cuts)
            size = np.diff(np.append(begin, len(low)))
        span = size + reach - 1
        first = np.cumsum(span) - span
        place = np.repeat(begin - first, span) + np.arange(span.sum())
        twice = np.add.reduceat(h[place] == np.repeat(low[begin], span), first, dtype=np.int32) > 1
        keys = low[begin].view(np.int64)
        for b, n, mv, again in zip(begin.tolist(), size.tolist(), keys.tolist(), twice.tolist()):
            yield at + b, n, mv, xxhash.xxh3_128_digest(part[b:b + n + window - 1]), again


WORD = re.compile(WORD_PATTERN)


def word_keys(text: str) -> bytes:
    """The words of a text, WORD_BYTES bytes each. Bytes split at the white space of WORD_PATTERN; nothing is held between texts."""
    digest = xxhash.xxh64_digest
    return b"".join([digest(word, 7) for word in text.encode().split()])


def segment_table(docs: DataFrame, window: int, data_of: Callable[[str], bytes] = str.encode) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for key, text in zip(batch.column(0).to_pylist(), values(batch.column(1))):
                data = data_of(text)
                if len(data) >= window:
                    tk = xxhash.xxh64_intdigest(text.encode(), 42)
                    tk -= (tk >> 63) << 64
                    rows.extend((key, tk, *s) for s in segments_of(data, window))
                if len(rows) > 50_000:
                    yield as_batch(rows)
                    rows = []
            if rows:
                yield as_batch(rows)

    def as_batch(rows):
        kinds = (pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.int64(), pa.binary(), pa.bool_())
        names = [c.split()[0] for c in SEGMENT_SCHEMA.split(", ")]
        return pa.record_batch({n: pa.array(c, k) for n, c, k in zip(names, zip(*rows), kinds)})

    return docs.select("id", "text").mapInArrow(run, SEGMENT_SCHEMA)


# --- suffix arrays ------------------------------------------------------------------------------------------------

def suffix_array(data: np.ndarray) -> np.ndarray:
    """All suffixes in order, by Larsson-Sadakane refinement. A shorter suffix comes before those it begins."""
    n = len(data)
    packs = n < 1 << 21        # rank, rank further on and position fit one 64-bit number: one plain sort a round
    bits = np.uint64(21)
    mask = np.uint64((1 << 21) - 1)
    padded = np.concatenate((data.astype(np.uint64) + np.uint64(1), np.zeros(PREFIX, np.uint64)))
    key = np.zeros(n, np.uint64)
    for j in range(PREFIX):
        key = (key << np.uint64(9)) | padded[j:j + n]
    if packs:
        packed = np.sort((key << bits) | np.arange(n, dtype=np.uint64))
        sa, key = (packed & mask).astype(np.int64), packed >> bits
    else:
        sa = np.argsort(key, kind="stable")
        key = key[sa]
    starts = np.flatnonzero(np.concatenate(([True], key[1:] != key[:-1])))
    rank = np.empty(n + 1, np.int64)
    rank[n] = -1
    rank[sa] = np.repeat(starts, np.diff(np.append(starts, n)))
    where, h = np.arange(n), PREFIX
    while h < n:
        size = np.bincount(rank[sa[where]], minlength=n)
        where = where[size[rank[sa[where]]] > 1]          # only unsorted groups are refined
        if not len(where):
            break
        idx = sa[where]
        further = rank[np.minimum(idx + h, n)] + 1
        if packs:
            packed = np.sort((rank[idx].astype(np.uint64) << (bits * np.uint64(2)))
                             | (further.astype(np.uint64) << bits) | idx.astype(np.uint64))
            idx, pair = (packed & mask).astype(np.int64), packed >> bits
            new = np.concatenate(([True], pair[1:] != pair[:-1]))
        else:
            order = np.lexsort((further, rank[idx]))
            idx, further = idx[order], further[order]
            group = rank[idx]
            new = np.concatenate(([True], (group[1:] != group[:-1]) | (further[1:] != further[:-1])))
        sa[where] = idx
        rank[idx] = where[np.maximum.accumulate(np.where(new, np.arange(len(idx)), 0))]
        h *= 2
    return sa


def words_at(data: np.ndarray) -> np.ndarray:
    """The 8 bytes at each position as a big-endian number (zeros after the end)."""
    padded = np.concatenate((data, np.zeros(8, np.uint8))).astype(np.uint64)
    out = np.zeros(len(data), np.uint64)
    for j in range(8):
        out = (out << np.uint64(8)) | padded[j:j + len(data)]
    return out


def common_prefixes(data: np.ndarray, sa: np.ndarray, starts: np.ndarray, depth: int) -> np.ndarray:
    """lcp[r]: common prefix (up to ``depth``) of the suffixes at ranks r-1 and r; lcp[0] = 0.

    Kasai's rule: the prefix of position i+1 with its predecessor in order is at least that of i less
    one. The rule runs from every position of ``starts`` (0 first) to the next in step, 8 bytes a comparison."""
    n = len(data)
    before = np.full(n, -1, np.int64)
    before[sa[1:]] = sa[:-1]
    text = np.append(words_at(data), np.zeros(depth + 8, np.uint64))
    plcp = np.zeros(n, np.int64)
    at, end = starts.copy(), np.append(starts[1:], n)
    known = np.zeros(len(at), np.int64)
    shifts = np.uint64(8) * np.arange(1, 8, dtype=np.uint64)
    while len(at):
        other = before[at]
        have = np.where(other < 0, 0, known)
        most = np.minimum(depth, n - np.maximum(at, other))     # never past the end of the data
        grow = np.flatnonzero((other >= 0) & (have < most))
        while len(grow):
            a, b, l = at[grow], other[grow], have[grow]
            diff = text[a + l] ^ text[b + l]
            same = np.where(diff == 0, 8, ((diff[:, None] >> shifts) == 0).sum(axis=1))   # leading bytes that agree
            have[grow] = np.minimum(l + same, most[grow])
            grow = grow[(diff == 0) & (have[grow] < most[grow])]
        plcp[at] = have
        known = np.maximum(have - 1, 0)
        at = at + 1
        on = at < end
        at, end, known = at[on], end[on], known[on]
    lcp = plcp[sa]
    lcp[0] = 0
    return lcp


def window_classes(parts: list[bytes], window: int = WINDOW) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """For all windows of the parts, in order: the class (equal windows: equal class), the part and the start in it."""
    data = np.frombuffer(b"".join(parts), np.uint8)
    length = np.array([len(p) for p in parts])
    first = np.cumsum(length) - length
    sa = suffix_array(data)
    lcp = common_prefixes(data, sa, np.union1d(first, np.arange(0, len(data), STRIDE)), window)
    of = np.empty(len(data), np.int64)
    of[sa] = np.cumsum(lcp < window)
    count = length - window + 1
    part = np.repeat(np.arange(len(parts)), count)
    off = np.arange(count.sum()) - np.repeat(np.cumsum(count) - count, count)
    return of[first[part] + off], part, off


def runs(flags: np.ndarray) -> list[tuple[int, int]]:
    """(start, length) of the runs of True."""
    edge = np.flatnonzero(np.diff(np.concatenate(([0], flags.astype(np.int8), [0]))))
    return list(zip(edge[::2].tolist(), (edge[1::2] - edge[::2]).tolist()))


FOUND_SCHEMA = ("sd binary, runs array<struct<off:int,len:int>>, mv long, part int, h1 array<long>, h2 array<long>, "
                "seg array<int>, off array<int>, single array<boolean>, sds array<binary>")
RUNS_SCHEMA = "sd binary, runs array<struct<off:int,len:int>>"
RUNS = pa.list_(pa.struct([("off", pa.int32()), ("len", pa.int32())]))


def compare_shards(segments: DataFrame, window: int) -> DataFrame:
    """segments(mv, salt, shards, sd, bytes) -> one row per segment with repeated windows (sd, runs), and for keys dealt
    over several shards one row per shard and digest range (part) with the sorted digests of the shard's classes: h1, h2, and
    of one window of each class the segment (place in sds), the start, and whether it is alone in the shard."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, key, seen, size = [], None, set(), 0
        for batch in batches:
            for mv, salt, shards, sd, data in zip(*(c.to_pylist() for c in batch.columns)):
                if (mv, salt) != key:
                    if size >= SHARD_BYTES // 2 or held and (shards > 1 or held[0][1] > 1):
                        yield from shard(held, key[0])
                        held, size = [], 0
                    key, seen = (mv, salt), set()
                if sd not in seen:   # a table may hold the same row twice
                    seen.add(sd)
                    held.append((sd, shards, data))
                    size += len(data)
        if held:
            yield from shard(held, key[0])

    def shard(held, mv):
        sds, shards, parts = zip(*held)
        of, part, off = window_classes(list(parts), window)
        again = np.bincount(of)[of] > 1
        edge = np.searchsorted(part, np.arange(len(parts) + 1))
        rows = []
        for p in range(len(parts)):
            own = runs(again[edge[p]:edge[p + 1]])
            if own:
                rows.append((sds[p], [{"off": a, "len": n} for a, n in own], *[None] * 8))
        if shards[0] > 1:    # a shard of a dealt-out key holds that key alone
            _, one = np.unique(of, return_index=True)
            digest = np.array([np.frombuffer(xxhash.xxh3_128_digest(parts[p][a:a + window]), np.int64)
                               for p, a in zip(part[one].tolist(), off[one].tolist())]).reshape(-1, 2)
            order = np.lexsort((digest[:, 1], digest[:, 0]))
            one, digest = one[order], digest[order]
            slot = digest_part(digest[:, 0], shards[0])
            for k in np.unique(slot).tolist():
                own = slot == k
                used, place = np.unique(part[one[own]], return_inverse=True)
                rows.append((None, None, mv, k, digest[own, 0], digest[own, 1], place, off[one[own]], ~again[one[own]],
                             [sds[p] for p in used.tolist()]))
        longs, ints = pa.list_(pa.int64()), pa.list_(pa.int32())
        kinds = (pa.binary(), RUNS, pa.int64(), pa.int32(), longs, longs, ints, ints, pa.list_(pa.bool_()), pa.list_(pa.binary()))
        names = [c.split()[0] for c in FOUND_SCHEMA.split(", ")]
        for at in range(0, len(rows), 4096):
            yield pa.record_batch({n: pa.array(c, k) for n, c, k in zip(names, zip(*rows[at:at + 4096]), kinds)})

    return segments.select("mv", "salt", "shards", "sd", "bytes").repartition("mv", "salt").sortWithinPartitions(
        "mv", "salt").mapInArrow(run, FOUND_SCHEMA)


def digest_part(h1: np.ndarray, parts: int) -> np.ndarray:
    """The range of a digest among ``parts`` equal ranges: as many as the key has shards."""
    return ((h1.view(np.uint64) >> np.uint64(33)).astype(np.int64) * parts) >> 31


def merge_shards(classes: DataFrame) -> DataFrame:
    """Sorted digests of the shards of dealt-out keys -> (sd, runs) of windows that are alone in their shard but also stand
    in another. All shards' digests of one range meet in one task; each is looked up there by binary search."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, held = None, []
        for batch in batches:
            for i in range(batch.num_rows):
                row = {n: batch.column(j)[i] for j, n in enumerate(batch.schema.names)}
                at = (row["mv"].as_py(), row["part"].as_py())
                if at != key:
                    yield from look_up(held)
                    key, held = at, []
                held.append(row)
        yield from look_up(held)

    def look_up(held):
        if len(held) < 2:
            return
        h1 = [r["h1"].values.to_numpy() for r in held]
        h2 = [r["h2"].values.to_numpy() for r in held]
        every = np.concatenate(h1)
        order = np.lexsort((np.concatenate(h2), every))
        every, second = every[order], np.concatenate(h2)[order]
        found: dict[bytes, list[int]] = {}
        for r, a, b in zip(held, h1, h2):
            single = r["single"].values.to_numpy(zero_copy_only=False)
            left, right = np.searchsorted(every, a, "left"), np.searchsorted(every, a, "right")
            for i in np.flatnonzero(single & (right - left > 1)).tolist():
                if (second[left[i]:right[i]] == b[i]).sum() > 1:
                    found.setdefault(r["sds"].values[r["seg"].values[i].as_py()].as_py(), []).append(r["off"].values[i].as_py())
        if found:
            yield pa.record_batch({"sd": pa.array(list(found), pa.binary()), "runs": pa.array(
                [[{"off": a, "len": 1} for a in sorted(own)] for own in found.values()], RUNS)})

    return classes.select("mv", "part", "h1", "h2", "seg", "off", "single", "sds").repartition(
        "mv", "part").sortWithinPartitions("mv", "part").mapInArrow(run, RUNS_SCHEMA)


# --- the operator --------------------------------------------------------------------------------------------------

def covered_windows(docs: DataFrame, window: int = WINDOW, hot_segments: int = HOT_SEGMENTS,
                    data_of: Callable[[str], bytes] = str.encode) -> DataFrame:
    """docs(id, text) -> id, tk, covers: array of (start, len) runs of repeated windows, for documents that have any."""
    segs = written(segment_table(docs, window, data_of), "segments")
    same = written(segs.groupBy("mv", "sd").agg(
        F.count(F.lit(1)).alias("copies"), F.min(F.struct("id", "tk", "start")).alias("at"),
        F.first("windows").alias("windows"), F.first("again").alias("again")), "segments-distinct")
    per_key = written(same.groupBy("mv").agg(F.count(F.lit(1)).alias("different")).where("different > 1"), "segment-keys")
    alone = same.where("again").join(per_key, "mv", "left_anti").withColumn("different", F.lit(1).cast("long"))
    several = join_groups(same, per_key, ["mv"], "different").unionByName(alone).select(
        "mv", "sd", "at.id", "at.tk", "at.start", "windows", "different")
    several = several.withColumn("shards", F.ceil(F.col("different") / hot_segments).cast("int")).withColumn(
        "salt", F.pmod(F.xxhash64("sd"), F.col("shards")))
    wanted = several.groupBy("id", "tk").agg(F.collect_list(
        F.struct("mv", "salt", "shards", "sd", "start", "windows")).alias("cuts"))
    keyed = docs.withColumn("tk", F.xxhash64("text"))

    def slices(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows, size = [], 0
        for batch in batches:
            for text, cuts in zip(values(batch.column(0)), values(batch.column(1))):
                data = data_of(text)
                for c in cuts:
                    rows.append((c["mv"], c["salt"], c["shards"], c["sd"],
                                 data[c["start"]:c["start"] + c["windows"] + window - 1]))
                    size += len(rows[-1][-1])
                    if size > 4 << 20:
                        yield sliced(rows)
                        rows, size = [], 0
        if rows:
            yield sliced(rows)

    def sliced(rows):
        kinds = (pa.int64(), pa.int64(), pa.int32(), pa.binary(), pa.binary())
        return pa.record_batch({n: pa.array(c, k) for n, c, k in zip(
            ("mv", "salt", "shards", "sd", "bytes"), zip(*rows), kinds)})

    loaded = keyed.join(wanted, ["id", "tk"]).select("text", "cuts").mapInArrow(
        slices, "mv long, salt long, shards int, sd binary, bytes binary")
    found = written(compare_shards(loaded, window), "segment-runs")
    merged = merge_shards(found.where("sd is null"))
    whole = same.where("copies > 1").select("sd", F.array(F.struct(F.lit(0).alias("off"), F.col("windows").alias("len"))).alias("runs"))
    every = whole.unionByName(found.where("sd is not null").select("sd", "runs")).unionByName(merged)
    every = every.groupBy("sd").agg(F.flatten(F.collect_list("runs")).alias("runs"))
    # segments that a thousandth of all rows hold, fewer than a thousand of them, are broadcast with their runs
    hot = F.broadcast(same.where(F.col("copies") * HOT_SHARE > segs.count()).select("sd"))
    places = segs.select("id", "tk", "sd", "start")
    back = places.join(hot, "sd", "left_anti").join(every, "sd").unionByName(
        places.join(F.broadcast(every.join(hot, "sd", "left_semi")), "sd"))
    moved = F.transform("runs", lambda r: F.struct((F.col("start") + r["off"]).alias("start"), r["len"].alias("len")))
    # rows that repeat id and text hold the same runs: a set, so that their number does not matter
    return back.groupBy("id", "tk").agg(F.flatten(F.collect_set(moved)).alias("covers"))


def removed_spans(covers, window: int = WINDOW) -> list[tuple[int, int]]:
    """Maximal byte spans (begin, end) covered by runs of windows given as (start, len)."""
    out: list[list[int]] = []
    for start, n in sorted(covers):
        end = start + n - 1 + window
        if out and start <= out[-1][1]:
            out[-1][1] = max(out[-1][1], end)
        else:
            out.append([start, end])
    return [(a, b) for a, b in out]


def kept_bytes(data: bytes, spans) -> bytes:
    out, at = [], 0
    for a, b in spans:
        out.append(data[at:a])
        at = b
    out.append(data[at:])
    return b"".join(out)


def removed_words(covers, words: int) -> list[tuple[int, int]]:
    """Maximal spans (first, past the last) of words covered by runs of windows over ``word_keys``. Windows that do not begin at
    a word's first byte (they repeat where one word does) are passed over."""
    runs = []
    for start, n in covers:
        first, last = -(-start // WORD_BYTES), (start + n - 1) // WORD_BYTES
        if first <= last:
            runs.append((first, last - first + 1))
    return removed_spans(runs, words)


def without_words(text: str, spans: list[tuple[int, int]]) -> str:
    """The text without those words and the white space between them."""
    places = [m.span() for m in WORD.finditer(text)] if spans else []
    out, at = [], 0
    for first, stop in spans:
        out.append(text[at:places[first][0]])
        at = places[stop - 1][1]
    return "".join(out) + text[at:]


def with_covers(docs: DataFrame, window: int, hot_segments: int, data_of: Callable[[str], bytes] = str.encode) -> DataFrame:
    """All columns of docs(id, text, ...) with covers (null if nothing is repeated)."""
    found = covered_windows(docs.select("id", "text"), window, hot_segments, data_of)
    return docs.withColumn("tk", F.xxhash64("text")).join(found, ["id", "tk"], "left")


def repeats(docs: DataFrame, window: int = WINDOW, hot_segments: int = HOT_SEGMENTS) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept_sha256 and text (the bytes kept, without broken characters) for every row.

    Null text: empty. Texts shorter than the window keep all their bytes. Rows that repeat a text of at least
    ``window`` bytes lose all of it, whatever their ids. An empty table gives no row; extra columns are ignored.
    """
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            size, removed, spans, sha, texts = [], [], [], [], []
            for text, covers in zip(values(batch.column(1)), values(batch.column(2))):
                data = text.encode()
                cuts = removed_spans([(c["start"], c["len"]) for c in covers or ()], window)
                size.append(len(data))
                removed.append(sum(b - a for a, b in cuts))
                spans.append(len(cuts))
                kept = kept_bytes(data, cuts)
                sha.append(hashlib.sha256(kept).hexdigest())
                texts.append(kept.decode(errors="ignore"))
            yield pa.record_batch({"doc_id": batch.column(0), "n_bytes": pa.array(size, pa.int64()),
                                   "n_removed": pa.array(removed, pa.int64()), "n_spans": pa.array(spans, pa.int64()),
                                   "kept_sha256": pa.array(sha, pa.string()), "text": pa.array(texts, pa.string())})

    rows = with_covers(keyed_rows(docs), window, hot_segments).select("doc_id", "text", "covers")
    return rows.mapInArrow(run, "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string, text string")


def keyed_rows(docs: DataFrame) -> DataFrame:
    return ids_and_text(docs).withColumn("id", F.coalesce("doc_id", F.lit(NO_ID)))


def without_repeats(docs: DataFrame, window: int = WINDOW, hot_segments: int = HOT_SEGMENTS) -> DataFrame:
    """The rows of docs, all columns, with the repeated bytes cut out of ``text`` (bytes of a character that is cut in
    two go with it) and ``n_chars``, if there, counted anew. Rows of which nothing but white space is left go."""
    def cut(text, covers):
        return kept_bytes(text.encode(), removed_spans(covers, window)).decode(errors="ignore")

    return rewritten(docs, window, hot_segments, str.encode, cut)


def without_passages(docs: DataFrame, words: int = PASSAGE_WORDS, hot_segments: int = HOT_SEGMENTS) -> DataFrame:
    """The rows of docs, all columns, without every word of ``text`` that lies in a passage of ``words`` words which also begins
    anywhere else, same document included; overlaps count, and passages are judged on the input. Words are runs of other than
    white space, and only they are compared. ``n_chars``, if there, is counted anew. Rows of which nothing but white space is left go."""
    def cut(text, covers):
        return without_words(text, removed_words(covers, words))

    return rewritten(docs, words * WORD_BYTES, hot_segments, word_keys, cut)


def rewritten(docs: DataFrame, window: int, hot_segments: int, data_of, cut) -> DataFrame:
    """docs with cut(text, covers) as the text of rows that have covers.

    Null and empty texts stay as they are. Rows that repeat id and text are cut alike. An empty table stays empty; columns of
    any name are passed on."""
    place = docs.columns.index("text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            kept = []
            for text, covers in zip(values(batch.column(0).field(place)), values(batch.column(1))):
                text = text or ""
                if covers:
                    text = cut(text, [(c["start"], c["len"]) for c in covers])
                    text = text if text.strip() else None
                kept.append(text)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(kept, pa.string())], ["row", "kept"])

    # the text travels inside the row alone: shuffles and batches hold it once
    rows = docs.withColumn("text", F.col("text").cast("string")).select(
        F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"),
        F.coalesce(F.col("doc_id").cast("long"), F.lit(NO_ID)).alias("id"))
    text = F.coalesce("row.text", F.lit(""))
    covers = covered_windows(rows.select("id", text.alias("text")), window, hot_segments, data_of)
    found = rows.withColumn("tk", F.xxhash64(text)).join(covers, ["id", "tk"], "left").select("row", "covers")
    done = found.mapInArrow(run, T.StructType([found.schema["row"], T.StructField("kept", T.StringType())]))
    columns = {"text": F.when(F.col("row.text").isNotNull(), F.col("kept")), "n_chars": F.char_length("kept").cast("long")}
    return done.where("kept is not null").select(
        *[columns.get(c, F.col(f"row.`{c}`")).alias(c) for c in docs.columns])


def op10_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repeats(documents(spark, sf_dir))
