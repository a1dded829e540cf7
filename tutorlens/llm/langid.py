"""Language identification with segmentation-marginalised unigrams.

Every language has a probability for each piece of a fixed public vocabulary. The probability of a
word under a language is the sum over *all* its segmentations into pieces, computed by the forward
algorithm; a text's score is the product over its words (runs of letters, lower-cased, each with the
vocabulary's word-start mark). Piece probabilities are fitted by expectation-maximisation over the words
of labelled training documents: each round is a Spark job that runs forward-backward over the distinct words
and sums expected piece counts; only piece counts (vocabulary x languages at most) reach the driver.

The fit uses a sample of about ``FIT_DOCS`` training documents of each language, chosen by a hash (a documented bound; the
whole texts of these documents count). Everything else covers all rows.

Beside the languages stands a character model: the same vocabulary with single characters only, each with its mean share
over the languages' training words, ``NEW_CHARACTER`` for others. It scores a text in the same forward pass. A text that it
makes far likelier than every language does is not made of the pieces of any of them: its language was not learned.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import documents, ids_and_text, values, written

FIT_DOCS = 500
FIT_FILES = 64
ROUNDS = 3
UNKNOWN = 1e-7        # probability of a character that no piece covers
SMOOTHING = 0.05      # weight of the mean over languages in each language's probabilities
MAX_MEMO = 200_000    # distinct words whose scores a task holds
BLOCK_WORDS = 200_000  # words of neighbouring texts that are looked up together
UNDETERMINED = "und"
NEW_CHARACTER = 0.01  # share of a character of the vocabulary that no training word holds, in the character model
MIN_SCORE = 0.01      # below it (4.6 nats a word) the character model explains a text better than any learned language

MARK = "▁"           # word start in the vocabulary
MAX_BATCH_WORD = 64    # longer words are scored one by one

HASH_BASE = np.uint64(0x9E3779B97F4A7C15)

RUN = re.compile(r"[^\W\d_]+")


def words_of(text: str) -> list[str]:
    """Lower-cased runs of letters."""
    return [w for w in RUN.findall(text.lower()) if w.isalpha() or any(map(str.isalpha, w))]


def vocabulary(path: str) -> list[str]:
    """The pieces of a sentencepiece model that a marked word can hold."""
    import sentencepiece

    sp = sentencepiece.SentencePieceProcessor(model_file=path)
    pieces = [sp.id_to_piece(i) for i in range(sp.get_piece_size())
              if not (sp.is_control(i) or sp.is_unknown(i) or sp.is_byte(i) or sp.is_unused(i))]
    # words are lower-cased runs of letters after one word-start mark: no other piece can occur in them
    return [p for p in pieces if p == MARK or (b := p.removeprefix(MARK)).isalpha() and b == b.lower()]


def piece_key(piece: str) -> int:
    key = 0
    for c in piece:
        key = (key * int(HASH_BASE) + ord(c)) % (1 << 64)
    return key


class Pieces:
    """Probabilities of pieces for K languages, and the forward algorithm over them. ``characters`` (share of each
    character) adds the character model as a last column."""

    def __init__(self, probs: dict[str, tuple[float, ...]], languages: list[str], characters: dict[str, float] | None = None):
        self.languages, self.characters = languages, characters
        if characters is not None:
            probs = {p: (*row, characters.get(p, NEW_CHARACTER) if len(p) == 1 else 0.0) for p, row in probs.items()}
        self.probs, self.columns = probs, len(languages) + (characters is not None)
        self.longest = max(map(len, probs), default=1)
        self.unknown = (UNKNOWN,) * self.columns
        # rows: absent, an uncovered character, then the pieces; keys: the pieces' 64-bit hashes in order, and an end mark
        keys = np.array([piece_key(p) for p in probs] + [(1 << 64) - 1], np.uint64)
        self.key_rows = np.argsort(keys, kind="stable")
        self.keys = keys[self.key_rows]
        self.key_rows = np.where(self.key_rows < len(probs), self.key_rows + 2, 0)
        self.matrix = np.array([(0.0,) * self.columns, self.unknown, *probs.values()]).reshape(len(probs) + 2, self.columns)

    def arcs(self, word: str) -> list[list[tuple[int, str | None]]]:
        """For each end in the marked word: (begin, piece); an uncovered character is an arc of its own."""
        s = MARK + word
        probs, longest = self.probs, self.longest
        out: list[list[tuple[int, str | None]]] = [[]]
        for j in range(1, len(s) + 1):
            own = [(i, s[i:j]) for i in range(max(0, j - longest), j) if s[i:j] in probs]
            if s[j - 1] not in probs:
                own.append((j - 1, None))
            out.append(own)
        return out

    def log_probability(self, word: str) -> list[float]:
        """log P(word) per column, summed over all segmentations."""
        probs, unknown = self.probs, self.unknown
        ks = range(self.columns)
        arcs = self.arcs(word)
        alpha: list[list[float] | None] = [[1.0] * len(ks)]
        log = [0.0] * len(ks)
        keep = self.longest
        for j in range(1, len(arcs)):
            row = [0.0] * len(ks)
            for i, piece in arcs[j]:
                a, p = alpha[i], unknown if piece is None else probs[piece]
                for k in ks:
                    row[k] += a[k] * p[k]
            alpha.append(row)
            if j % 16 == 0:   # long words: bring what is still needed back to about 1
                for k in ks:
                    top = max(alpha[i][k] for i in range(max(0, j - keep + 1), j + 1))
                    log[k] += math.log(top)
                    for i in range(max(0, j - keep + 1), j + 1):
                        alpha[i][k] /= top
                if j >= 2 * keep:
                    for i in range(max(0, j - keep - 15), j - keep + 1):
                        alpha[i] = None
        last = alpha[-1]
        return [log[k] + math.log(last[k]) for k in ks]

    def log_probabilities(self, words: list[str]) -> np.ndarray:
        """``log_probability`` of many words: the forward algorithm runs over words of one length in step."""
        k = self.columns
        out = np.empty((len(words), k))
        groups: dict[int, list[int]] = {}
        for i, w in enumerate(words):
            groups.setdefault(len(w), []).append(i)
        step = max(64, 16384 // max(k, 1))
        for n, at in groups.items():
            if n > MAX_BATCH_WORD:
                for i in at:
                    out[i] = self.log_probability(words[i])
                continue
            for lo in range(0, len(at), step):
                part = at[lo:lo + step]
                out[part] = self.forward([MARK + words[i] for i in part], n + 1)
        return out

    def forward(self, marked: list[str], n: int) -> np.ndarray:
        """log P of marked words, all of n characters."""
        w = len(marked)
        code = np.frombuffer("".join(marked).encode("utf-32-le", "surrogatepass"), "<u4").reshape(w, n).astype(np.uint64)
        alpha = np.zeros((n + 1, w, self.columns))
        alpha[0] = 1
        log = np.zeros(alpha.shape[1:])
        for i in range(n):
            key = np.zeros(w, np.uint64)
            for j in range(i + 1, min(n, i + self.longest) + 1):
                key = key * HASH_BASE + code[:, j - 1]
                at = np.searchsorted(self.keys, key)
                row = np.where(self.keys[at] == key, self.key_rows[at], 1 if j - i == 1 else 0)
                if row.any():
                    alpha[j] += alpha[i] * self.matrix[row]
            if i % 16 == 15 and i + 1 < n:    # bring what is still needed back to about 1
                ahead = slice(i + 1, i + 1 + self.longest)
                top = alpha[ahead].max(axis=0)
                log += np.log(top)
                alpha[ahead] /= top
        return log + np.log(alpha[n])

    def expected(self, word: str, k: int) -> list[tuple[str, float]]:
        """Expected number of uses of each piece in the word under language k (forward-backward)."""
        probs, arcs = self.probs, self.arcs(word)
        n = len(arcs) - 1
        if n > MAX_BATCH_WORD:
            return self.expected_long(arcs, k)
        alpha, beta = [1.0] + [0.0] * n, [0.0] * n + [1.0]
        value = [[UNKNOWN if p is None else probs[p][k] for _, p in own] for own in arcs]
        for j in range(1, n + 1):
            alpha[j] = sum(alpha[i] * v for (i, _), v in zip(arcs[j], value[j]))
        for j in range(n, 0, -1):
            for (i, _), v in zip(arcs[j], value[j]):
                beta[i] += beta[j] * v
        if not alpha[n]:
            return []
        return [(p, alpha[i] * v * beta[j] / alpha[n]) for j in range(1, n + 1)
                for (i, p), v in zip(arcs[j], value[j]) if p is not None]

    def expected_long(self, arcs: list[list[tuple[int, str | None]]], k: int) -> list[tuple[str, float]]:
        """``expected`` with logarithms, for words whose probability no float holds."""
        probs, n = self.probs, len(arcs) - 1
        value = [[math.log(x) if (x := UNKNOWN if p is None else probs[p][k]) else -math.inf for _, p in own] for own in arcs]

        def add(a: float, b: float) -> float:
            top, low = (a, b) if a >= b else (b, a)
            return top if low == -math.inf else top + math.log1p(math.exp(low - top))

        alpha, beta = [0.0] + [-math.inf] * n, [-math.inf] * n + [0.0]
        for j in range(1, n + 1):
            for (i, _), v in zip(arcs[j], value[j]):
                alpha[j] = add(alpha[j], alpha[i] + v)
        for j in range(n, 0, -1):
            for (i, _), v in zip(arcs[j], value[j]):
                beta[i] = add(beta[i], beta[j] + v)
        if alpha[n] == -math.inf:
            return []
        return [(p, math.exp(alpha[i] + v + beta[j] - alpha[n])) for j in range(1, n + 1)
                for (i, p), v in zip(arcs[j], value[j]) if p is not None]


def training_words(train: DataFrame, fit_docs: int = FIT_DOCS) -> DataFrame:
    """(lang, word, n) over the whole texts of about ``fit_docs`` documents of each language, all if it has no more.
    train: doc_id, text, lang; rows with a null language are left out."""
    train = train.where("lang is not null")
    counts = train.groupBy("lang").count().collect()    # one row per language
    share = F.lit(0.0)
    for r in counts:
        share = F.when(F.col("lang") == r["lang"], F.lit(fit_docs / r["count"])).otherwise(share)
    chosen = train.where(F.pmod(F.xxhash64("doc_id", "text"), F.lit(1 << 30)) < share * (1 << 30))

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            total: Counter = Counter()
            for lang, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                total.update((lang, w) for w in words_of(text))
            yield pa.record_batch({"lang": pa.array([k[0] for k in total], pa.string()),
                                   "word": pa.array([k[1] for k in total], pa.string()),
                                   "n": pa.array(total.values(), pa.int64())})

    return chosen.select("lang", "text").mapInArrow(count, "lang string, word string, n long").groupBy(
        "lang", "word").agg(F.sum("n").alias("n"))


def fit(train: DataFrame, model_path: str, fit_docs: int = FIT_DOCS, rounds: int = ROUNDS) -> Pieces:
    """Fit piece probabilities on labelled documents (doc_id, text, lang). Without any word the model has no
    language, and every text is undetermined."""
    # a bounded table, in enough files that the rounds below run side by side
    words = written(training_words(train, fit_docs).repartition(FIT_FILES, "lang", "word"), "langid-words")
    languages = sorted(r["lang"] for r in words.select("lang").distinct().collect())
    vocab = vocabulary(model_path)
    start = 1.0 / max(len(vocab), 1)
    pieces = Pieces({p: (start,) * len(languages) for p in vocab}, languages)
    for _ in range(rounds if languages else 0):
        pieces = reestimate(words, pieces)
    return Pieces(pieces.probs, languages, character_shares(words, len(languages))) if languages else pieces


def character_shares(words: DataFrame, n_languages: int) -> dict[str, float]:
    """Mean over the languages of each character's share (word-start marks too) of the training words; one entry for each
    distinct character reaches the driver."""
    counts = words.select("lang", "n", F.explode(F.split(F.concat(F.lit(MARK), "word"), "")).alias("c")).groupBy("lang", "c").agg(
        F.sum("n").alias("n"))
    share = F.col("n") / F.sum("n").over(Window.partitionBy("lang"))
    return {r["c"]: r["x"] for r in counts.select("c", share.alias("x")).groupBy("c").agg(
        F.round(F.sum("x") / n_languages, 12).alias("x")).collect()}


def reestimate(words: DataFrame, pieces: Pieces) -> Pieces:
    """One expectation-maximisation round."""
    def expect(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        place = {lang: k for k, lang in enumerate(pieces.languages)}
        total: Counter = Counter()
        for batch in batches:
            for lang, word, n in zip(*(c.to_pylist() for c in batch.columns)):
                for piece, x in pieces.expected(word, place[lang]):
                    total[place[lang], piece] += n * x
        yield pa.record_batch({"k": pa.array([k for k, _ in total], pa.int32()),
                               "piece": pa.array([p for _, p in total], pa.string()),
                               "x": pa.array(total.values(), pa.float64())})

    # the order of floating-point sums may differ between runs in the last bits: rounded to 1e-6 of a use
    counts = words.select("lang", "word", "n").mapInArrow(expect, "k int, piece string, x double").groupBy(
        "k", "piece").agg(F.round(F.sum("x"), 6).alias("x")).collect()
    table = np.zeros((len(pieces.probs), len(pieces.languages)))
    row = {p: i for i, p in enumerate(pieces.probs)}
    for r in counts:
        table[row[r["piece"]], r["k"]] = r["x"]
    share = table / np.maximum(table.sum(axis=0), 1e-12)
    floor = 1e-3 / len(row)
    mixed = (1 - SMOOTHING) * share + SMOOTHING * (share.mean(axis=1, keepdims=True) + floor)
    return Pieces({p: tuple(mixed[i].tolist()) for p, i in row.items()}, pieces.languages)


class WordScores:
    """Scores of the distinct words met so far, at most about ``MAX_MEMO`` of them."""

    def __init__(self, pieces: Pieces):
        self.pieces, self.memo = pieces, {}
        self.table = np.empty((0, pieces.columns))

    def add(self, total: np.ndarray, held: list[tuple[int, list[str]]]) -> None:
        """Add the scores of (row of total, words) to their rows; new words are scored together."""
        words = set().union(*(own for _, own in held))
        new = sorted(words.difference(self.memo))
        if len(self.memo) + len(new) > MAX_MEMO:
            self.memo, self.table, new = {}, self.table[:0], sorted(words)
        self.memo.update(zip(new, range(len(self.memo), len(self.memo) + len(new))))
        self.table = np.concatenate((self.table, self.pieces.log_probabilities(new)))
        for at, own in held:
            total[at] += self.table[np.fromiter(map(self.memo.__getitem__, own), np.int64, len(own))].sum(axis=0)


def with_language(docs: DataFrame, pieces: Pieces) -> DataFrame:
    """row (all columns of docs as a struct), lang_pred, score. score: the predicted language's share of the text's probability
    a word (geometric mean) over all languages and the character model, so it does not saturate with the length of the
    text. A null text, or one without a letter, is ``und`` with score 0."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scores = WordScores(pieces)
        k = len(pieces.languages)
        for batch in batches:
            total, n_words = np.zeros((batch.num_rows, pieces.columns)), np.zeros(batch.num_rows, np.int64)
            held, size = [], 0
            for at, text in enumerate(values(batch.column(0).field(place) if inside else batch.column(1))):
                words = words_of(text or "") if k else []
                n_words[at] = len(words)
                for lo in range(0, len(words), BLOCK_WORDS):
                    held.append((at, words[lo:lo + BLOCK_WORDS]))
                    size += len(held[-1][1])
                    if size >= BLOCK_WORDS:
                        scores.add(total, held)
                        held, size = [], 0
            scores.add(total, held)
            pred, score = [UNDETERMINED] * batch.num_rows, np.zeros(batch.num_rows)
            for at in np.flatnonzero(n_words).tolist():
                best = int(total[at, :k].argmax())
                pred[at] = pieces.languages[best]
                score[at] = 1 / np.exp(np.clip((total[at] - total[at, best]) / n_words[at], -700, 700)).sum()
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(pred, pa.string()), pa.array(score, pa.float64())], ["row", "lang_pred", "score"])

    # a text that is a string travels inside the row alone: batches hold it once
    inside = dict(docs.dtypes).get("text") == "string"
    place = docs.columns.index("text") if inside else None
    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"),
                       *([] if inside else [F.col("text").cast("string").alias("text")]))
    return rows.mapInArrow(run, T.StructType([rows.schema["row"], T.StructField("lang_pred", T.StringType()),
                                              T.StructField("score", T.DoubleType())]))


def predict(docs: DataFrame, pieces: Pieces) -> DataFrame:
    """doc_id, lang_pred, score for every row (see ``with_language``); repeated rows each have a row, an empty table gives
    none, extra columns are ignored."""
    return with_language(ids_and_text(docs), pieces).select("row.doc_id", "lang_pred", "score")


def keep_identified(docs: DataFrame, min_score: float = MIN_SCORE) -> DataFrame:
    """The rows of docs, all columns, whose language is determined with a score of at least ``min_score``, by a model
    fitted on the documents of docs that are not held out."""
    found = with_language(docs, fit_on_documents(docs))
    return found.where((F.col("lang_pred") != UNDETERMINED) & (F.col("score") >= min_score)).select("row.*")


def held_out(doc_id: str = "doc_id"):
    """crc32 of the id as text leaves remainder 2 by 4 (a null id counts as empty text)."""
    return F.crc32(F.coalesce(F.col(doc_id).cast("string"), F.lit("")).cast("binary")) % 4 == 2


def model_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("piece_bpe_32k.model")


def fit_on_documents(docs: DataFrame) -> Pieces:
    """The model of the documents that are not held out."""
    train = ids_and_text(docs).withColumn("lang", F.lit(None).cast("string")) if "lang" not in docs.columns else \
        docs.select(F.col("doc_id").cast("long").alias("doc_id"),
                    F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"), F.col("lang").cast("string"))
    return fit(train.where(~held_out()), model_path())


def op7_langid(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    return predict(docs, fit_on_documents(docs)).select("doc_id", held_out().alias("held_out"), "lang_pred", "score")
