"""Token counts that follow edits without encoding the whole text again.

A document is held as a segment tree over runs of its pre-token chunks (see ``encoding``: chunks never share a token). A
leaf holds about ``LEAF_CHARS`` characters of chunks, their characters and tokens; inner nodes hold the sums. An edit descends by
character sums to the leaves it touches, takes one whole chunk of context at either side of the characters it changes (a new or
lost space there can join chunks, none further away), encodes that region as it was and as it is, and adds the difference to the
leaf and the sums on the paths above. An added token (``<|endoftext|>``) lies inside one chunk; for a tokenizer with added tokens that
reach over a space a document is a single chunk.
"""

from __future__ import annotations

import re
from bisect import bisect_left, bisect_right
from collections.abc import Iterator
from operator import add

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import documents
from .encoding import SAFE_CUT, Encoder, encoder, tokenizer_path

LEAF_CHARS = 64
MAX_LEAF_CHARS = 2048   # a leaf that edits have made longer is cut anew

RESULT_SCHEMA = ("doc_id long, n_tokens long, n_edits int, n_chars_after long, n_tokens_after long, "
                 "reencoded_chars long")


#: whole chunks of LEAF_CHARS characters or more; all leaves but the first begin with the space before a chunk
LEAF = re.compile(rf"(?s).{{{LEAF_CHARS - 1}}}.*?\S(?= \S)|.+")


class TokenTree:
    def __init__(self, enc: Encoder, text: str):
        self.enc = enc
        self.build(*self.counted(text))

    def counted(self, text: str) -> tuple[list[str], list[int], list[int]]:
        """The leaves of a text, and their characters and tokens."""
        leaves = LEAF.findall(text) if not self.enc.wide else [text] if text else []
        return leaves, list(map(len, leaves)), list(map(self.enc.count, leaves))

    def build(self, leaves: list[str], chars: list[int], tokens: list[int]) -> None:
        """The tree over leaves with known characters and tokens."""
        self.leaves = leaves
        self.width = 1 << max(0, len(leaves) - 1).bit_length()
        spare = [0] * (self.width - len(leaves))
        self.chars, self.tokens = self.sums(chars + spare), self.sums(tokens + spare)

    @staticmethod
    def sums(row: list[int]) -> list[int]:
        """An implicit tree: node i has the children 2i and 2i+1; node 1 is the root."""
        rows = [row]
        while len(rows[-1]) > 1:
            rows.append(list(map(add, rows[-1][::2], rows[-1][1::2])))
        return [0, *[x for r in reversed(rows) for x in r]]

    @property
    def n_chars(self) -> int:
        return self.chars[1]

    @property
    def n_tokens(self) -> int:
        return self.tokens[1]

    def leaf_at(self, at: int) -> tuple[int, int]:
        """The leaf that holds the character at ``at``, and the place of its first character."""
        node, begin = 1, 0
        while node < self.width:
            node *= 2
            if at - begin >= self.chars[node]:
                begin += self.chars[node]
                node += 1
        return node - self.width, begin

    def set_leaf(self, leaf: int, text: str, tokens: int) -> None:
        self.leaves[leaf] = text
        node = self.width + leaf
        self.chars[node], self.tokens[node] = len(text), tokens
        while node > 1:
            node //= 2
            self.chars[node] = self.chars[2 * node] + self.chars[2 * node + 1]
            self.tokens[node] = self.tokens[2 * node] + self.tokens[2 * node + 1]

    def region(self, text: str, pos: int, stop: int) -> tuple[int, int]:
        """From where to where ``text``, some leaves, has to be encoded if the characters from pos to stop change."""
        if self.enc.wide:
            return 0, len(text)
        cuts = [m.start() for m in SAFE_CUT.finditer(text)]
        before, after = bisect_left(cuts, pos) - 2, bisect_right(cuts, stop) + 1
        return cuts[before] if before >= 0 else 0, cuts[after] if after < len(cuts) else len(text)

    def edit(self, pos: int, delete: int, insert: str) -> int:
        """Replace ``delete`` characters at ``pos`` by ``insert`` (both cut to the text). Returns the number of
        characters that were encoded for it, old and new."""
        n = self.n_chars
        pos = min(max(pos, 0), n)
        stop = min(pos + max(delete, 0), n)
        if pos == stop and not insert:
            return 0
        if not n:
            self.build(*self.counted(insert))
            return len(insert)
        left, begin = self.leaf_at(max(pos - 1, 0))
        if begin:
            left, begin = self.leaf_at(begin - 1)
        right, end = self.leaf_at(min(stop, n - 1))
        end += self.chars[self.width + right]
        if end < n:
            right, end = self.leaf_at(end)
        text = "".join(self.leaves[left:right + 1])
        pos, stop = pos - begin, stop - begin
        a, b = self.region(text, pos, stop)
        new = text[a:pos] + insert + text[stop:b]
        w = self.width
        tokens = sum(self.tokens[w + left:w + right + 1]) + self.enc.count(new) - self.enc.count(text[a:b])
        text = text[:a] + new + text[b:]
        if len(text) > MAX_LEAF_CHARS and not self.enc.wide:      # leaves of their own
            leaves, count = self.counted(text), len(self.leaves)
            self.build(*[old[:left] + own + old[right + 1:] for old, own in zip(
                (self.leaves, self.chars[w:w + count], self.tokens[w:w + count]), leaves)])
            return b - a + len(text)
        for i in range(left + 1, right + 1):
            self.set_leaf(i, "", 0)
        self.set_leaf(left, text, tokens)
        return b - a + len(new)


def count_with_edits(docs: DataFrame, tokenizer: str) -> DataFrame:
    """docs(doc_id, text, edits: array of (pos, del, ins), applied in order, each to the text as it then is) ->
    ``RESULT_SCHEMA``: tokens before and after all edits, and how many characters the edits had encoded again.

    A null text is empty, a null list has no edit; a null or negative position or length counts as 0, one beyond the
    text as its end, a null insertion as none. Repeated rows each have a row. An empty table gives no row; extra columns
    are ignored.
    """
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoder(tokenizer)
        for batch in batches:
            rows = []
            for doc_id, text, edits in zip(*(c.to_pylist() for c in batch.columns)):
                tree = TokenTree(enc, text or "")
                before, again = tree.n_tokens, 0
                for e in edits or ():
                    if e is not None:
                        again += tree.edit(e["pos"] or 0, e["del"] or 0, e["ins"] or "")
                rows.append((doc_id, before, len(edits or ()), tree.n_chars, tree.n_tokens, again))
            names = [c.split() for c in RESULT_SCHEMA.split(", ")]
            cols = list(zip(*rows)) or [[]] * len(names)
            yield pa.record_batch({n: pa.array(c, pa.int32() if t == "int" else pa.int64())
                                   for (n, t), c in zip(names, cols)})

    edits = F.col("edits").cast("array<struct<pos:long,del:long,ins:string>>")
    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string"), edits.alias("edits")).mapInArrow(
        run, RESULT_SCHEMA)


def sample_edits(docs: DataFrame) -> DataFrame:
    """A stand-in edit script for every document: a deletion, an insertion and a replacement."""
    n = F.char_length("text")
    edit = lambda pos, size, ins: F.struct(F.floor(pos).cast("long").alias("pos"), F.lit(size).cast("long").alias("del"),
                                           ins.alias("ins"))
    return docs.select("doc_id", "text", F.array(
        edit(n / 4, 12, F.lit("")), edit(n / 2, 0, F.concat(F.lit(" [note "), F.col("doc_id").cast("string"), F.lit("] "))),
        edit(3 * n / 4, 20, F.substring("text", 1, 20))).alias("edits"))


def op6_edit_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The token counts of all documents before and after a script of three edits each."""
    return count_with_edits(sample_edits(documents(spark, sf_dir)), tokenizer_path())
