"""Whole-text encoding with the tokenizers library, memoised over the pieces of the word pattern.

A text of ASCII and Latin letters without added tokens, nearly every text there is, is cut into the pieces of the
byte-level word pattern; the library's BPE model encodes each new piece once, and the ids of a text are the ids of its pieces in order.

Any other text is cut into chunks first: a byte-level BPE with the usual word pattern never forms a token across a single
space that stands between two non-space characters, as the space opens the next token. Texts with other runs of white
space are cut only where that condition holds. Chunks of ASCII and Latin letters go on as above; a chunk with other
characters, or one that holds an added token such as ``<|endoftext|>``, is encoded by the library as it stands. A text with an
added token that has white space of its own, or takes white space beside it, is encoded whole. The result equals
``Tokenizer.from_file(path).encode(text, add_special_tokens=False).ids`` (tested).
"""

from __future__ import annotations

import re
import struct

import numpy as np
import tokenizers

from .common import process_cache

SAFE_CUT = re.compile(r"(?<=\S) (?=\S)")
MAX_CACHED = 1_000_000   # chunks, and pieces, held per worker
MAX_CHUNK = 64         # longer ones are encoded but not kept
BLOCK = 1 << 20        # characters of a long text that are cut into pieces at a time

LETTER = "A-Za-z\u00c0-\u00d6\u00d8-\u00f6\u00f8-\u024f"
SPACE = " \\t\\n\\x0b\\x0c\\r"
#: the byte-level pattern for texts of ASCII and Latin letters alone
PIECE = re.compile(f" ?[{LETTER}]+|'(?:s|t|re|ve|m|ll|d)| ?[0-9]+| ?[^{SPACE}{LETTER}0-9]+|[{SPACE}]+(?![^{SPACE}])|[{SPACE}]+")
OTHER = re.compile(f"[^\\x00-\\x7f{LETTER}]")


def byte_symbols() -> list[str]:
    """The printable character that a byte-level vocabulary writes for each byte: printable Latin-1 bytes stand
    for themselves, the others for the code points from 256 on, in order."""
    own = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = [b for b in range(256) if b not in own]
    return [chr(b) if b in own else chr(256 + rest.index(b)) for b in range(256)]


class NotSeparable(Exception):
    """A chunk that is empty or has white space at an edge."""


class NotPlain(Exception):
    """A piece with other characters than ASCII and Latin letters: the pattern may have cut it wrongly."""


class Memo(dict):
    """Short keys in two generations of ``MAX_CACHED / 2``: a key that is met again moves to the younger one, and the
    older one is dropped when the younger is full."""

    def __init__(self):
        super().__init__()
        self.older: dict[str, bytes] = {}

    def __missing__(self, key: str) -> bytes:
        value = self.older.get(key)
        if value is None:
            value = self.make(key)
        if len(key) <= MAX_CHUNK:
            if len(self) >= MAX_CACHED // 2:
                self.older = dict(self)
                self.clear()
            self[key] = value
        return value


class PieceMemo(Memo):
    """piece of the word pattern -> its ids. Only plain pieces are held."""

    def __init__(self, tokenizer):
        super().__init__()
        self.model, self.symbols = tokenizer.model, dict(enumerate(byte_symbols()))

    def make(self, piece: str) -> bytes:
        if OTHER.search(piece):
            raise NotPlain
        ids = [t.id for t in self.model.tokenize(piece.encode().decode("latin-1").translate(self.symbols))]
        return struct.pack(f"<{len(ids)}I", *ids)


class ChunkMemo(Memo):
    """chunk (after ``lead``) -> its ids."""

    def __init__(self, encoder: Encoder, lead: str):
        super().__init__()
        self.encoder, self.lead = encoder, lead

    def ids_of(self, chunk: str) -> bytes:
        text, enc = self.lead + chunk, self.encoder
        if not enc.holds_added(text):
            try:
                return enc.plain_bytes(text)
            except NotPlain:
                pass
        return np.array(enc.tokenizer.encode(text, add_special_tokens=False).ids, "<u4").tobytes()

    def make(self, chunk: str) -> bytes:
        if not chunk or chunk[0].isspace() or chunk[-1].isspace():
            raise NotSeparable
        return self.ids_of(chunk)


class Encoder:
    """``encode_bytes(text)``: the ids as little-endian unsigned 32-bit integers."""

    def __init__(self, path: str):
        self.tokenizer = tokenizers.Tokenizer.from_file(path)
        tokens = self.tokenizer.get_added_tokens_decoder().values()
        self.added = [t.content for t in tokens]
        #: added tokens that reach over a cut; every other one lies inside a chunk
        self.wide = [t.content for t in tokens if t.lstrip or t.rstrip or any(map(str.isspace, t.content))]
        self.pieces = PieceMemo(self.tokenizer)
        self.first, self.rest = ChunkMemo(self, ""), ChunkMemo(self, " ")

    @property
    def vocab_size(self) -> int:
        return self.tokenizer.get_vocab_size()

    def holds_added(self, text: str) -> bool:
        for a in self.added:
            if a in text:
                return True
        return False

    def encode_bytes(self, text: str) -> bytes:
        if not text:
            return b""
        if not self.holds_added(text):
            try:
                return self.plain_bytes(text)
            except NotPlain:
                pass
        elif any(a in text for a in self.wide):
            return self.first.ids_of(text)
        return b"".join(self.chunk_ids(text))

    def plain_bytes(self, text: str) -> bytes:
        """The ids of a text without added tokens; ``NotPlain`` if it has other characters."""
        if len(text) <= BLOCK:
            return b"".join(map(self.pieces.__getitem__, PIECE.findall(text)))
        out, at = [], 0
        while at < len(text):
            cut = SAFE_CUT.search(text, at + BLOCK)
            stop = cut.start() if cut else len(text)
            out.append(b"".join(map(self.pieces.__getitem__, PIECE.findall(text[at:stop]))))
            at = stop
        return b"".join(out)

    def count(self, text: str) -> int:
        return len(self.encode_bytes(text)) // 4

    def chunk_ids(self, text: str) -> list[bytes]:
        """The ids of each chunk of ``text``, in order."""
        parts = text.split(" ")
        try:
            return [self.first[parts[0]], *map(self.rest.__getitem__, parts[1:])]
        except NotSeparable:
            parts = SAFE_CUT.split(text)
            return [self.first.ids_of(parts[0]), *(self.edge(p) for p in parts[1:])]

    def edge(self, chunk: str) -> bytes:
        try:
            return self.rest[chunk]
        except NotSeparable:   # the last chunk may end in white space
            return self.rest.ids_of(chunk)


def encoder(path: str) -> Encoder:
    held = process_cache(tokenizers, "encoders")
    if path not in held:
        held[path] = Encoder(path)
    return held[path]


def tokenizer_path(name: str = "byte_bpe_50k.json") -> str:
    import public_tokenizers

    return public_tokenizers.path(name)
