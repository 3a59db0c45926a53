"""Language by unigram pieces, summed over all segmentations.

Each language has a probability for each piece of a fixed public vocabulary. A
word's probability under a language is the sum, over all ways to cut it into
pieces, of the product of their probabilities; a forward pass over the word's
positions gives that sum. A text's score is the sum of its words' logarithms.

Piece probabilities are fitted by expectation maximisation (forward and
backward passes over the words of a bounded sample). Words are handled by the
batch: substrings are found by their polynomial hashes in a table, for all
words of a length at once. A worker keeps the words that it has scored. Words
of more than AT_ONCE letters are taken one by one, letter by letter, with the
probabilities scaled on the way, so no run of letters is too long.
"""

from __future__ import annotations

import pickle
import re
from collections import Counter
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from plumbline.llm import common

#: Documents a language that training reads, about: the documented bound of the sample. All their words count.
PER_LANGUAGE = 400
ROUNDS = 4
#: Probability of a letter that is no piece, added count of each piece.
FLOOR, ADDED = 1e-7, 0.05
#: Letters of the words that are scored by the batch: FLOOR to this power is a double still.
AT_ONCE = 40
#: Letters of a longer word whose pieces are looked up together, and a number below which probabilities are scaled.
SLICE, FAINT = 4096, 1e-150
BASE = np.uint64(0x9E3779B97F4A7C15)
SPREAD = np.uint64(0xD6E8FEB86659FD93)
START = "▁"
WORD = re.compile(r"[^\W\d_]+")
#: Words that a worker keeps, and their letters.
_KEPT_WORDS, _KEPT_LETTERS = 300_000, 10_000_000


def words_of(text: str) -> list[str]:
    """Runs of letters in lower case."""
    return WORD.findall(text.lower())


class Table:
    """Pieces by hash: rows of a piece matrix for many substrings at once."""

    BITS = 18

    def __init__(self, hashes: np.ndarray):
        self.levels: list[tuple[np.ndarray, np.ndarray]] = []
        left, rows = hashes, np.arange(len(hashes))
        while len(left):
            slots = self.slot(left)
            _, first = np.unique(slots, return_index=True)
            keys, values = np.zeros(1 << self.BITS, np.uint64), np.full(1 << self.BITS, -1, np.int32)
            keys[slots[first]], values[slots[first]] = left[first], rows[first]
            self.levels.append((keys, values))
            rest = np.setdiff1d(np.arange(len(left)), first)
            left, rows = left[rest], rows[rest]

    def slot(self, hashes: np.ndarray) -> np.ndarray:
        return (hashes * SPREAD >> np.uint64(64 - self.BITS)).astype(np.int64)

    def find(self, hashes: np.ndarray) -> np.ndarray:
        """The row of each hash, or -1."""
        slots = self.slot(hashes)
        out = np.full(hashes.shape, -1, np.int32)
        for keys, values in self.levels:
            hit = keys[slots] == hashes
            out[hit] = values[slots[hit]]
        return out


def prefix_hashes(codes: np.ndarray) -> np.ndarray:
    """Polynomial hashes of all prefixes of each row of code points."""
    out = np.zeros((codes.shape[0], codes.shape[1] + 1), np.uint64)
    for j in range(codes.shape[1]):
        out[:, j + 1] = out[:, j] * BASE + codes[:, j].astype(np.uint64) + np.uint64(1)
    return out


def codes_of(words: list[str], length: int) -> np.ndarray:
    return np.frombuffer("".join(words).encode("utf-32-le"), "<u4").reshape(len(words), length)


def piece_hashes(pieces: list[str]) -> np.ndarray:
    out = np.zeros(len(pieces), np.uint64)
    by: dict[int, list[int]] = {}
    for k, p in enumerate(pieces):
        by.setdefault(len(p), []).append(k)
    for n, some in by.items():
        out[some] = prefix_hashes(codes_of([pieces[k] for k in some], n))[:, -1]
    return out


def vocabulary(path: str) -> list[str]:
    """The file's pieces that are letters, in lower case, perhaps after a word's start."""
    import sentencepiece

    p = sentencepiece.SentencePieceProcessor(model_file=path)
    found = dict.fromkeys(p.id_to_piece(k) for k in range(p.get_piece_size()))
    return [x for x in found if x.removeprefix(START).isalpha() and x == x.lower() or x == START]


class Segments:
    """Which pieces stand where, for words of one length: by start and length, rows of the piece matrix."""

    def __init__(self, table: Table, words: list[str], longest: int):
        self.length = len(words[0])
        hashes = prefix_hashes(codes_of(words, self.length))
        self.rows: dict[tuple[int, int], np.ndarray] = {}
        for n in range(1, min(longest, self.length) + 1):
            power = np.uint64(pow(int(BASE), n, 1 << 64))
            for i in range(self.length - n + 1):
                found = table.find(hashes[:, i + n] - hashes[:, i] * power)
                if n == 1 or (found >= 0).any():
                    self.rows[i, n] = found

    def probabilities(self, p: np.ndarray, i: int, n: int) -> np.ndarray:
        """Per word and language; p's last row is 0, which -1 picks."""
        found = self.rows[i, n]
        out = p[found]
        return np.where((found < 0)[:, None], FLOOR, out) if n == 1 else out

    def forward(self, p: np.ndarray) -> list[np.ndarray]:
        size = len(next(iter(self.rows.values())))
        at = [np.ones((size, p.shape[1]))]
        ending: dict[int, list[int]] = {}
        for i, n in self.rows:
            ending.setdefault(i + n, []).append(n)
        for j in range(1, self.length + 1):
            at.append(sum((at[j - n] * self.probabilities(p, j - n, n) for n in ending[j]), np.zeros_like(at[0])))
        return at

    def backward(self, p: np.ndarray) -> list[np.ndarray]:
        size = len(next(iter(self.rows.values())))
        at: list = [None] * self.length + [np.ones((size, p.shape[1]))]
        beginning: dict[int, list[int]] = {}
        for i, n in self.rows:
            beginning.setdefault(i, []).append(n)
        for i in range(self.length - 1, -1, -1):
            at[i] = sum((at[i + n] * self.probabilities(p, i, n) for n in beginning[i]), np.zeros((size, p.shape[1])))
        return at


def pieces_at(table: Table, word: str, longest: int):
    """For each letter of a word of any length: rows of the pieces of 1, 2, ... `longest` letters that begin there."""
    for a in range(0, len(word), SLICE):
        codes = codes_of([word[a : a + SLICE + longest - 1]], min(len(word) - a, SLICE + longest - 1))[0].astype(np.uint64)
        n_here = min(SLICE, len(word) - a)
        found = np.full((n_here, longest), -1, np.int32)
        hashes = np.zeros(len(codes), np.uint64)
        for n in range(1, min(longest, len(codes)) + 1):
            hashes = hashes[: len(codes) - n + 1] * BASE + codes[n - 1 :] + np.uint64(1)
            some = hashes[:n_here]
            found[: len(some), n - 1] = table.find(some)
        yield from found


def long_word(table: Table, p: np.ndarray, longest: int, word: str) -> np.ndarray:
    """The logarithm of a marked word's probability under each language, over all segmentations."""
    ahead = np.zeros((longest + 1, p.shape[1]))  # sums of the segmentations that end 0, 1, ... letters on
    ahead[0] = 1
    log = np.zeros(p.shape[1])
    for rows in pieces_at(table, word, longest):
        here = ahead[0]
        if here.min() < FAINT:
            log += np.log(here)
            ahead /= here.copy()
            here = ahead[0]
        chances = p[rows]
        if rows[0] < 0:
            chances[0] = FLOOR
        ahead[1:] += chances * here
        ahead[:-1] = ahead[1:]
        ahead[-1] = 0
    return log + np.log(ahead[0])


def long_expected(table: Table, own: np.ndarray, longest: int, word: str) -> np.ndarray:
    """Expected count of each piece in a marked word of any length; the last place is for letters that are no piece."""
    rows = np.array(list(pieces_at(table, word, longest)))
    chances = own[rows, 0]
    chances[:, 0] = np.where(rows[:, 0] < 0, FLOOR, chances[:, 0])

    def sums(chances: np.ndarray) -> np.ndarray:
        """Logarithms of the sums over segmentations up to each place; chances[k, n - 1] is of the piece that begins at k."""
        ahead, log, out = np.zeros(longest + 1), 0.0, np.zeros(len(chances) + 1)
        ahead[0] = 1
        for k, some in enumerate(chances):
            if ahead[0] < FAINT:
                log += np.log(ahead[0])
                ahead /= ahead[0]
            out[k] = log + np.log(ahead[0])
            ahead[1:] += some * ahead[0]
            ahead[:-1] = ahead[1:]
            ahead[-1] = 0
        out[-1] = log + np.log(ahead[0])
        return out

    size = len(word)
    forward = sums(chances)
    turned = np.zeros_like(chances)  # read from the end, a piece begins where it ended
    for n in range(1, min(longest, size) + 1):
        turned[: size - n + 1, n - 1] = chances[: size - n + 1, n - 1][::-1]
    backward = sums(turned)[::-1]
    out = np.zeros(len(own))
    for n in range(1, min(longest, size) + 1):
        part = np.exp(forward[: size - n + 1] + backward[n:] - forward[-1]) * chances[: size - n + 1, n - 1]
        at = rows[: size - n + 1, n - 1]
        out += np.bincount(np.where(at < 0, len(own) - 1, at), part, len(own))
    return out


def by_length(words: list[str], most: int = 20_000):
    """(positions, words with a start mark) of each length up to AT_ONCE, in batches."""
    groups: dict[int, list[int]] = {}
    for k, w in enumerate(words):
        if len(w) <= AT_ONCE:
            groups.setdefault(len(w), []).append(k)
    for n in sorted(groups):
        for a in range(0, len(groups[n]), most):
            some = groups[n][a : a + most]
            yield some, [START + words[k] for k in some]


def log_probabilities(table: Table, p: np.ndarray, longest: int, words: list[str]) -> np.ndarray:
    """Each word's logarithm of probability under each language, over all segmentations."""
    out = np.zeros((len(words), p.shape[1]))
    for some, marked in by_length(words):
        out[some] = np.log(np.maximum(Segments(table, marked, longest).forward(p)[-1], 1e-300))
    for k, w in enumerate(words):
        if len(w) > AT_ONCE:
            out[k] = long_word(table, p, longest, START + w)
    return out


def fit(counts: list[dict[str, int]], pieces: list[str], rounds: int = ROUNDS) -> np.ndarray:
    """Piece probabilities, a column for each language's word counts, and a last row of zeros."""
    table, longest = Table(piece_hashes(pieces)), max(map(len, pieces))
    p = np.zeros((len(pieces) + 1, len(counts)))
    for k, words in enumerate(counts):
        own = np.full((len(pieces) + 1, 1), 1.0 / len(pieces))
        own[-1] = 0
        segments = [(Segments(table, marked, longest), np.array([list(words.values())[i] for i in some], float)) for some, marked in by_length(list(words))]
        long = [(START + w, n) for w, n in words.items() if len(w) > AT_ONCE]
        for _ in range(rounds):
            expected = np.zeros(len(pieces) + 1)
            for w, n in long:
                expected += n * long_expected(table, own, longest, w)
            for s, n in segments:
                f, b = s.forward(own), s.backward(own)
                scale = n / np.maximum(f[-1][:, 0], 1e-300)
                for (i, length), rows in s.rows.items():
                    part = f[i][:, 0] * s.probabilities(own, i, length)[:, 0] * b[i + length][:, 0] * scale
                    expected += np.bincount(np.where(rows < 0, len(pieces), rows), part, len(pieces) + 1)
            expected[:-1] += ADDED
            own[:-1, 0] = expected[:-1] / expected[:-1].sum()
        p[:, k] = own[:, 0]
    return p


@dataclass(frozen=True)
class Model:
    languages: tuple[str, ...]
    pieces: tuple[str, ...]
    p: np.ndarray
    prior: np.ndarray


class Scorer:
    """A model at work, with the words it has met."""

    def __init__(self, model: Model):
        self.model = model
        self.table, self.longest = Table(piece_hashes(list(model.pieces))), max(map(len, model.pieces))
        self.forget()

    def forget(self) -> None:
        self.known: dict[str, int] = {}
        self.letters = 0
        self.logs = np.zeros((1024, len(self.model.languages)))

    def learn(self, words: set[str]) -> None:
        new = [w for w in words if w not in self.known]
        if not new:
            return
        if len(self.known) + len(new) > _KEPT_WORDS or self.letters > _KEPT_LETTERS:
            self.forget()
            new = list(words)
        self.letters += sum(map(len, new))
        n = len(self.known)
        while len(self.logs) < n + len(new):
            self.logs = np.concatenate([self.logs, np.zeros_like(self.logs)])
        self.logs[n : n + len(new)] = log_probabilities(self.table, self.model.p, self.longest, new)
        self.known.update(zip(new, range(n, n + len(new)), strict=True))

    def predict(self, texts: list[list[str]]) -> list[tuple[str, float]]:
        out = []
        for at in range(0, len(texts), 128):
            some = texts[at : at + 128]
            self.learn(set().union(*some))
            for words in some:
                if not any(c.isalpha() for w in words for c in w):
                    out.append(("und", 0.0))
                    continue
                total = self.model.prior + self.logs[np.fromiter(map(self.known.__getitem__, words), np.int64, len(words))].sum(axis=0)
                best = int(total.argmax())
                calm = np.exp((total - total[best]) / np.sqrt(len(words)))
                out.append((self.model.languages[best], float(1 / calm.sum())))
        return out


_scorers: dict[int, Scorer] = {}


def train(spark: SparkSession, scratch: common.Scratch, docs: DataFrame, pieces_path: str, per_language: int = PER_LANGUAGE) -> Model:
    """A model from about per_language documents of each lang of docs (lang, text, doc_id); rows without lang are left out.

    Documents are drawn by a hash of their id and text, at the rate that their
    language's number calls for; rows that repeat both id and text are drawn
    together and add to the counts of the same words. Each language is fitted by
    one task, from the counts of all words of its drawn documents.
    """
    docs = docs.filter("lang is not null").select(F.col("doc_id").cast("long").alias("doc_id"), F.col("lang").cast("string").alias("lang"), F.col("text").cast("string").alias("text"))
    sizes = {r.lang: r["count"] for r in docs.groupBy("lang").count().collect()}
    languages = tuple(sorted(sizes))
    pieces = vocabulary(pieces_path)
    if not languages:
        return Model((), tuple(pieces), np.zeros((len(pieces) + 1, 0)), np.zeros(0))
    rates = F.create_map(*[F.lit(x) for k in languages for x in (k, min(1.0, per_language / sizes[k]))])
    drawn = docs.filter(F.pmod(F.xxhash64(F.col("doc_id"), F.col("text"), F.lit(9)), F.lit(1 << 30)) < rates[F.col("lang")] * (1 << 30))

    def count(batches):
        for batch in batches:
            found: Counter = Counter()
            for lang, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                found.update((lang, w) for w in words_of(text or ""))
            yield pa.RecordBatch.from_pydict({"lang": pa.array([k[0] for k in found], pa.string()), "word": pa.array([k[1] for k in found], pa.string()), "n": pa.array(found.values(), pa.int64())})

    words = drawn.select("lang", "text").mapInArrow(count, "lang string, word string, n long").groupBy("lang", "word").agg(F.sum("n").alias("n"))
    words = scratch.keep(words, "words")

    def fit_one(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("word")
        own = vocabulary(pieces_path)
        p = fit([dict(zip(pdf["word"], pdf["n"], strict=True))], own)
        return pd.DataFrame({"lang": [key[0]], "p": [p[:, 0]]})

    spread = words.repartition(max(len(languages), common.partitions(spark)), "lang")
    fitted = {r.lang: r.p for r in spread.groupBy("lang").applyInPandas(fit_one, "lang string, p array<double>").collect()}
    plain = fit([{}], pieces)[:, 0]  # of a language whose drawn documents have no words
    total = sum(sizes.values())
    p = np.column_stack([fitted.get(k, plain) for k in languages])
    return Model(languages, tuple(pieces), p, np.log(np.array([sizes[k] / total for k in languages])))


def identify(spark: SparkSession, docs: DataFrame, pieces_path: str, folds: int = 3, fold: int = 1) -> DataFrame:
    """doc_id, held_out, lang_pred, score for each of docs (doc_id, text, lang).

    Learns from rows that are not held out (crc32 of the id as text is `fold`
    modulo `folds`) and have a lang. A null text, or one without a letter, is
    `und` with score 0, as is every text where nothing could be learned. score
    is the predicted language's share of the calmed likelihoods. A text of any
    length is scored whole, its runs of letters too. Repeated rows are predicted
    alike; a null doc_id is not held out. An empty table gives no rows; other
    columns are ignored.
    """
    scratch = common.Scratch(spark, "language")
    held = common.held_out(F.col("doc_id"), folds, fold)
    model = train(spark, scratch, docs.filter(~held), pieces_path)
    packed = pickle.dumps(model)
    key = hash(scratch.root)

    def task(batches):
        if key not in _scorers:
            _scorers.clear()
            _scorers[key] = Scorer(pickle.loads(packed))
        scorer = _scorers[key]
        for batch in batches:
            texts = [words_of(t or "") for t in batch.column(1).to_pylist()]
            found = scorer.predict(texts) if scorer.model.languages else [("und", 0.0)] * len(texts)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([x[0] for x in found], pa.string()), pa.array([x[1] for x in found], pa.float64())], names=["doc_id", "lang_pred", "score"])

    found = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(task, "doc_id long, lang_pred string, score double")
    return found.select("doc_id", held.alias("held_out"), "lang_pred", "score")
