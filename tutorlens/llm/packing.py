"""Hierarchical packing of token sequences into several context sizes.

Each task packs the documents of its own input partition, buffer by buffer, so no text is
shuffled. A document longer than the largest context gives full windows first; what remains
is routed to the smallest tier that holds it and waits in that tier's list. Tiers are packed from
the longest down, each for as long as its own list has pieces: a window is opened by the longest piece of
its tier and its gap is filled with the longest pieces that fit, from the tier's own list and those of the
shorter tiers (best fit); the last bit of a gap is closed by cutting the shortest waiting piece, whose rest is routed anew.
When all that waits is less than a window, the tier's pieces are passed to the next tier (in full windows, the rest routed),
so the only padding is what remains below the smallest tier.
Windows of one tier are then dealt to step groups of equal size so that the attention cost
(sum of squared piece lengths) is balanced between the groups.
"""

from __future__ import annotations

import zlib
from bisect import bisect_left, bisect_right, insort
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession

from .common import documents, ids_and_text
from .encoding import encoder, tokenizer_path

TIERS = (2048, 1024, 512, 256, 128, 64, 32, 16, 8, 4, 2, 1)
BUFFER_TOKENS = 4_000_000
STEP_WINDOWS = 8

PIECE_SCHEMA = ("doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, "
                "offset long, tier int, step_group long")


class Waiting:
    """Pieces that wait, a list per tier: (length, document, start), shortest first. ``tiers``: longest first."""

    def __init__(self, tiers, pieces):
        self.bounds = sorted(tiers)
        self.lists: dict[int, list[tuple[int, int, int]]] = {t: [] for t in tiers}
        for length, doc, start in pieces:
            if length:
                self.lists[self.tier_of(length)].append((length, doc, start))
        for own in self.lists.values():
            own.sort()
        self.tokens = sum(n for own in self.lists.values() for n, _, _ in own)

    def tier_of(self, length: int) -> int:
        """The smallest tier that holds ``length`` tokens."""
        return self.bounds[bisect_left(self.bounds, length)]

    def put(self, length: int, doc: int, start: int) -> None:
        if length:
            insort(self.lists[self.tier_of(length)], (length, doc, start))
            self.tokens += length

    def take(self, tier: int, at: int) -> tuple[int, int, int]:
        item = self.lists[tier].pop(at)
        self.tokens -= item[0]
        return item

    def take_within(self, gap: int) -> tuple[int, int, int]:
        """The longest piece of at most ``gap`` tokens; if none fits, the shortest of all."""
        for i in range(bisect_left(self.bounds, gap), -1, -1):
            at = bisect_right(self.lists[self.bounds[i]], (gap, 1 << 62, 0)) - 1
            if at >= 0:
                return self.take(self.bounds[i], at)
        return self.take(next(t for t in self.bounds if self.lists[t]), 0)


def pack(lengths: list[int], tiers=TIERS) -> list[tuple[int, list[tuple[int, int, int]]]]:
    """Windows ``(tier, [(document, start, length), ...])`` that hold every token of documents of these
    lengths once. ``tiers``: context sizes, longest first. Every window is full but at most one, which
    holds what is left below the smallest tier."""
    top = tiers[0]
    windows: list[tuple[int, list[tuple[int, int, int]]]] = []
    for doc, n in enumerate(lengths):
        for start in range(0, n - n % top, top):
            windows.append((top, [(doc, start, top)]))
    waiting = Waiting(tiers, ((n % top, doc, n - n % top) for doc, n in enumerate(lengths)))
    for tier, below in zip(tiers, [*tiers[1:], None]):
        own = waiting.lists[tier]
        while own and waiting.tokens >= tier:
            length, doc, start = waiting.take(tier, -1)
            gap, window = tier - length, [(doc, start, length)]
            while gap:
                length, doc, start = waiting.take_within(gap)
                used = min(length, gap)
                window.append((doc, start, used))
                waiting.put(length - used, doc, start + used)
                gap -= used
            windows.append((tier, window))
        if own and below is None:
            windows.append((tier, [(doc, start, n) for n, doc, start in own]))
        while own and below is not None:
            length, doc, start = waiting.take(tier, -1)
            whole = length - length % below
            windows += [(below, [(doc, at, below)]) for at in range(start, start + whole, below)]
            waiting.put(length - whole, doc, start + whole)
    return windows


def step_groups(windows, size: int = STEP_WINDOWS) -> list[int]:
    """A group number per window: windows of one tier, at most ``size`` to a group; costs dealt in
    serpentine order, so that the groups of a tier are about as heavy as each other."""
    out = [0] * len(windows)
    base = 0
    for tier in sorted({t for t, _ in windows}, reverse=True):
        own = sorted((i for i, w in enumerate(windows) if w[0] == tier),
                     key=lambda i: (-sum(n * n for _, _, n in windows[i][1]), i))
        groups = -(-len(own) // size)
        for k, i in enumerate(own):
            lap, at = divmod(k, groups)
            out[i] = base + (at if lap % 2 == 0 else groups - 1 - at)
        base += groups
    return out


def pack_documents(docs: DataFrame, tokenizer: str, tiers=TIERS, end_id: int = 1,
                   buffer_tokens: int = BUFFER_TOKENS) -> DataFrame:
    """One row per piece (``PIECE_SCHEMA``); ``tier`` is the window's context size.

    A null text is empty: the document is its end id alone. Repeated rows are packed each for
    itself. An empty table gives no row; extra columns are ignored. Sequence ids are unique over
    the table (partition number in the high bits) and the same on a rerun over the same splits.
    """
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoder(tokenizer)
        end = np.array([end_id], "<u4").tobytes()
        base = TaskContext.get().partitionId() << 32
        sequence = group = held = 0
        ids: list[int | None] = []
        tokens: list[bytes] = []

        def flush():
            nonlocal sequence, group
            windows = pack([len(x) // 4 for x in tokens], tiers)
            groups = step_groups(windows)
            rows = []
            for (tier, pieces), g in zip(windows, groups):
                offset = 0
                for doc, start, length in pieces:
                    crc = zlib.crc32(memoryview(tokens[doc])[4 * start:4 * (start + length)])
                    rows.append((ids[doc], start, length, crc, len(tokens[doc]) // 4, base + sequence, offset, tier,
                                 base + group + g))
                    offset += length
                sequence += 1
            group += max(groups, default=-1) + 1
            cols = list(zip(*rows))
            names = [c.split()[0] for c in PIECE_SCHEMA.split(", ")]
            return pa.record_batch({k: pa.array(v, pa.int32() if k == "tier" else pa.int64())
                                    for k, v in zip(names, cols)})

        for batch in batches:
            for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                ids.append(doc_id)
                tokens.append(enc.encode_bytes(text) + end)
                held += len(tokens[-1]) // 4
                if held >= buffer_tokens:
                    yield flush()
                    ids, tokens, held = [], [], 0
        if ids:
            yield flush()

    return ids_and_text(docs).mapInArrow(run, PIECE_SCHEMA)


def op8_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack_documents(documents(spark, sf_dir), tokenizer_path())
