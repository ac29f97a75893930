"""Language of a text by unigram pieces, summed over all segmentations of its words."""

from __future__ import annotations

import re
from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import releasing, settle
from .hashing import _BACK, _BASE

SHORT = 32  # longer words are summed one by one, in logarithms
BLOCK = 4096  # places of a long word whose pieces are looked up at once
UNKNOWN = 1e-7  # probability of a character outside the vocabulary
SAMPLE = 600  # labelled documents of a language that the pieces are learnt from
ROUNDS = 3  # expectation-maximisation steps
CACHE = 150_000  # words whose scores a worker remembers
_LETTERS = re.compile(r"[^\W\d_]+")


def vocabulary(model_path: str) -> list[str]:
    """The lower-case pieces of letters, with and without the mark of a word's start."""
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=model_path)
    pieces = (model.id_to_piece(i) for i in range(model.get_piece_size()))
    plain = {p for p in pieces if p.lstrip("▁").isalpha() and p == p.lower()}
    return sorted(plain | {"▁"})


def words_of(text: str) -> list[str]:
    """Whole runs of letters, in lower case."""
    out = []
    for run in _LETTERS.findall(text.lower()):
        if not run.isalpha():  # other numerals
            run = "".join(c for c in run if c.isalpha())
        if run:
            out.append(run)
    return out


class Lattice:
    """Piece numbers of all substrings of words of one length, and sums over their paths.

    Words of fewer than SHORT letters are summed many at a time.  A longer one is summed alone, in
    logarithms (its probability would leave the doubles) and by blocks of places.
    """

    def __init__(self, pieces: list[str]):
        self.longest = max(map(len, pieces), default=1)  # characters of a piece
        size = self.longest + max(SHORT, BLOCK) + 2
        self.power = np.cumprod(np.array([1] + [_BASE] * size, dtype=np.uint64), dtype=np.uint64)
        self.back = np.cumprod(np.array([1] + [_BACK] * size, dtype=np.uint64), dtype=np.uint64)
        self.unknown = len(pieces)  # number of the stand-in for unknown characters
        hashes = np.array([self._hash(p) for p in pieces], dtype=np.uint64)
        self.order = np.argsort(hashes)
        self.hashes = hashes[self.order]

    def _hash(self, piece: str) -> int:
        return sum(ord(c) * int(self.power[i]) for i, c in enumerate(piece)) % (1 << 64)

    def pieces_of(self, words: list[str]) -> dict[tuple[int, int], np.ndarray]:
        """``(start, end) -> piece numbers`` for marked words of one length; -1 where none is in the vocabulary."""
        n = len(words[0]) + 1
        codes = np.frombuffer("".join("▁" + w for w in words).encode("utf-32-le"), "<u4").reshape(len(words), n).astype(np.uint64)
        sums = np.zeros((len(words), n + 1), dtype=np.uint64)
        np.cumsum(codes * self.power[:n], axis=1, out=sums[:, 1:])
        out = {}
        for i in range(n):
            for j in range(i + 1, min(n, i + self.longest) + 1):
                h = (sums[:, j] - sums[:, i]) * self.back[i]
                at = np.minimum(np.searchsorted(self.hashes, h), len(self.hashes) - 1)
                hit = self.hashes[at] == h
                if j == i + 1:
                    out[i, j] = np.where(hit, self.order[at], self.unknown)
                elif hit.any():
                    out[i, j] = np.where(hit, self.order[at], -1)
        return out

    def forward(self, words: list[str], prob: np.ndarray) -> np.ndarray:
        """Log of the sum over all segmentations, words x languages; ``prob`` has a row of zeros at its end."""
        if len(words[0]) >= SHORT:
            return np.stack([self._long_forward(w, prob) for w in words])
        spans, n = self.pieces_of(words), len(words[0]) + 1
        alpha = np.zeros((n + 1, len(words), prob.shape[1]))
        alpha[0] = 1
        for (i, j), piece in sorted(spans.items(), key=lambda x: x[0][1]):
            alpha[j] += alpha[i] * prob[piece]
        return np.log(alpha[n])

    def expected(self, words: list[str], times: np.ndarray, prob: np.ndarray) -> np.ndarray:
        """Expected uses of each piece over all segmentations of the words, under one language's ``prob``."""
        if len(words[0]) >= SHORT:
            return sum((self._long_expected(w, k, prob) for w, k in zip(words, times, strict=True)), np.zeros(len(prob)))
        spans, n = self.pieces_of(words), len(words[0]) + 1
        alpha, beta = np.zeros((n + 1, len(words))), np.zeros((n + 1, len(words)))
        alpha[0] = beta[n] = 1
        for (i, j), piece in sorted(spans.items(), key=lambda x: x[0][1]):
            alpha[j] += alpha[i] * prob[piece]
        for (i, j), piece in sorted(spans.items(), key=lambda x: -x[0][0]):
            beta[i] += beta[j] * prob[piece]
        uses = np.zeros(len(prob))
        for (i, j), piece in spans.items():
            uses += np.bincount(piece % len(prob), weights=times * alpha[i] * beta[j] * prob[piece] / alpha[n], minlength=len(prob))
        return uses

    def _ends(self, word: str):
        """For each end of a piece in the marked word, in order: the end, the starts of its pieces and their numbers."""
        codes = np.frombuffer(("▁" + word).encode("utf-32-le"), "<u4").astype(np.uint64)
        for at in range(0, len(codes), BLOCK):
            low, stop = max(0, at + 1 - self.longest), min(len(codes), at + BLOCK)
            sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum(codes[low:stop] * self.power[: stop - low], dtype=np.uint64)])
            ends, starts, numbers = [], [], []
            for size in range(1, min(self.longest, stop) + 1):
                j = np.arange(max(at + 1, size), stop + 1)
                h = (sums[j - low] - sums[j - size - low]) * self.back[j - size - low]
                place = np.minimum(np.searchsorted(self.hashes, h), len(self.hashes) - 1)
                hit = self.hashes[place] == h
                number = np.where(hit, self.order[place], self.unknown)
                keep = hit | (size == 1)
                ends.append(j[keep])
                starts.append(j[keep] - size)
                numbers.append(number[keep])
            ends, starts, numbers = (np.concatenate(x) for x in (ends, starts, numbers))
            order = np.argsort(ends, kind="stable")
            ends, starts, numbers = ends[order], starts[order], numbers[order]
            cuts = np.searchsorted(ends, np.arange(at + 1, stop + 2))
            for j, a, b in zip(range(at + 1, stop + 1), cuts[:-1], cuts[1:], strict=True):
                yield j, starts[a:b], numbers[a:b]

    def _long_forward(self, word: str, prob: np.ndarray) -> np.ndarray:
        """``forward`` of one word; only the last sums that a piece can reach are kept."""
        last = np.zeros((self.longest + 1, prob.shape[1]))
        for j, starts, numbers in self._ends(word):
            last[j % len(last)] = np.logaddexp.reduce(last[starts % len(last)] + np.log(prob[numbers]), axis=0)
        return last[(len(word) + 1) % len(last)]

    def _long_expected(self, word: str, times: float, prob: np.ndarray) -> np.ndarray:
        """``expected`` of one word; memory grows with its length."""
        n = len(word) + 1
        alpha, beta, uses = np.zeros(n + 1), np.full(n + 1, -np.inf), np.zeros(len(prob))
        spans = []
        for j, starts, numbers in self._ends(word):
            alpha[j] = np.logaddexp.reduce(alpha[starts] + np.log(prob[numbers]))
            spans.append((starts, numbers))
        beta[n] = 0
        for j in range(n, 0, -1):
            starts, numbers = spans.pop()
            way = np.log(prob[numbers]) + beta[j]
            beta[starts] = np.logaddexp(beta[starts], way)  # starts of one end differ
            np.add.at(uses, numbers, times * np.exp(alpha[starts] + way - alpha[n]))
        return uses


def _by_length(words):
    groups: dict[int, list[int]] = {}
    for i, w in enumerate(words):
        groups.setdefault(len(w), []).append(i)
    for some in groups.values():
        for at in range(0, len(some), 4096):
            yield some[at : at + 4096]


def word_counts(docs: DataFrame) -> DataFrame:
    """``lang, word, n`` of labelled documents."""

    def run(batches):
        for batch in batches:
            seen: dict[str, Counter] = {}
            for lang, text in zip(batch.column("lang").to_pylist(), batch.column("text").to_pylist(), strict=True):
                seen.setdefault(lang, Counter()).update(words_of(text))
            rows = [(lang, w, n) for lang, c in seen.items() for w, n in c.items()]
            yield pa.RecordBatch.from_pydict({"lang": pa.array([r[0] for r in rows], pa.string()), "word": pa.array([r[1] for r in rows], pa.string()), "n": pa.array([r[2] for r in rows], pa.int64())})

    return docs.select("lang", "text").mapInArrow(releasing(run), "lang string, word string, n long").groupBy("lang", "word").agg(F.sum("n").alias("n"))


def sample_of(docs: DataFrame, per_language: int = SAMPLE) -> DataFrame:
    """At most ``per_language`` labelled documents of each language, those of the smallest digests of their ids.

    Only ids are ranked; texts are joined to at most ``per_language`` ids of each language, which
    are broadcast if that bound is below a million.
    """
    labelled = docs.where("lang is not null and text is not null and doc_id is not null")
    order = Window.partitionBy("lang").orderBy(F.xxhash64("doc_id"), "doc_id")
    ids = labelled.select("lang", "doc_id").withColumn("_rank", F.row_number().over(order)).where(F.col("_rank") <= per_language).select("lang", "doc_id").distinct()
    languages = labelled.select("lang").distinct().count()
    return labelled.join(F.broadcast(ids) if languages * per_language < 1_000_000 else ids, ["lang", "doc_id"], "left_semi")


class Model:
    """Languages, pieces, and the pieces' probabilities (pieces + unknown + none, languages)."""

    def __init__(self, languages, pieces, prob):
        self.languages, self.pieces, self.prob = languages, pieces, prob


def fit(docs: DataFrame, model_path: str, rounds: int = ROUNDS) -> Model:
    """Learns each language's piece probabilities from labelled documents, by expectation-maximisation.

    The steps run over the word counts on the executors; what comes back is one number for each
    language and piece of the fixed vocabulary, whatever the input's size.
    """
    counts = settle(word_counts(docs))
    languages = sorted(r["lang"] for r in counts.select("lang").distinct().collect())
    pieces = vocabulary(model_path)
    size = len(pieces)
    prob = np.full((size + 2, len(languages)), 1 / size)
    prob[size], prob[size + 1] = UNKNOWN, 0

    def step(prob):
        def run(batches):
            lattice = Lattice(pieces)
            uses = np.zeros((size + 2, len(languages)))
            for batch in batches:
                lang, word, n = (batch.column(c).to_pylist() for c in ("lang", "word", "n"))
                for k, name in enumerate(languages):
                    own = [i for i, x in enumerate(lang) if x == name]
                    words, times = [word[i] for i in own], np.array([n[i] for i in own], dtype=float)
                    for some in _by_length(words):
                        uses[:, k] += lattice.expected([words[i] for i in some], times[some], prob[:, k])
            at = np.argwhere(uses[:size] > 1e-6)
            yield pa.RecordBatch.from_pydict({"piece": pa.array(at[:, 0], pa.int64()), "k": pa.array(at[:, 1], pa.int64()), "uses": pa.array(uses[:size][at[:, 0], at[:, 1]], pa.float64())})

        return counts.mapInArrow(run, "piece long, k long, uses double").groupBy("piece", "k").agg(F.sum("uses").alias("uses")).collect()

    for _ in range(rounds if languages else 0):
        uses = np.full((size, len(languages)), 0.01)
        for r in step(prob):
            uses[r["piece"], r["k"]] += r["uses"]
        prob = np.vstack([uses / uses.sum(axis=0), prob[size:]])
    return Model(languages, pieces, prob)


def mark(docs: DataFrame, model: Model, language: str = "lang_pred", posterior: str = "score", keep: list[str] | None = None) -> DataFrame:
    """Adds two columns to those in ``keep`` (all): the likeliest language of each whole text and its posterior.

    Runs of letters of any length count as one word each.
    The posterior supposes equally frequent languages.  A null text, or one without letters,
    is ``und`` with score 0, as is every text if no language was learnt.  Ties go to the first
    language in order of names.  Nothing but ``text`` is looked at; a null doc_id stays null;
    rows that repeat get the same answer; other columns are kept; no rows give no rows.
    """
    keep = [c for c in docs.columns if c not in (language, posterior)] if keep is None else keep
    shared = docs.sparkSession.sparkContext.broadcast((model.languages, model.pieces, model.prob))  # vocabulary x languages

    def run(batches):
        languages, pieces, prob = shared.value
        lattice = Lattice(pieces)
        known: dict[str, int] = {}
        letters = 0
        table = np.zeros((1024, len(languages)))

        def learn(words):
            nonlocal table, letters
            if len(known) > CACHE or letters > 16 * CACHE:
                known.clear()
                letters = 0
            new = [w for w in set(words) if w not in known]
            letters += sum(map(len, new))
            while len(known) + len(new) > len(table):
                table = np.vstack([table, np.zeros_like(table)])
            for some in _by_length(new):
                rows = np.arange(len(known), len(known) + len(some))
                table[rows] = lattice.forward([new[i] for i in some], prob)
                known.update(zip((new[i] for i in some), rows.tolist(), strict=True))

        def score(words):
            try:
                rows = [known[w] for w in words]
            except KeyError:
                learn(words)
                rows = [known[w] for w in words]
            total = table[rows].sum(axis=0)
            share = np.exp(total - total.max())
            return int(total.argmax()), float(1 / share.sum())

        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                part = batch.slice(at, 256)
                texts = [words_of(t or "") for t in part.column("text").to_pylist()]
                if languages:
                    learn([w for words in texts for w in words])
                best = [score(words) if words and languages else None for words in texts]
                yield pa.RecordBatch.from_arrays(
                    [*(part.column(c) for c in keep), pa.array([languages[b[0]] if b else "und" for b in best], pa.string()), pa.array([b[1] if b else 0.0 for b in best], pa.float64())],
                    names=[*keep, language, posterior],
                )

    docs = docs.select(*dict.fromkeys([*keep, "text"]))
    fields = [*docs.select(*keep).schema.fields, T.StructField(language, T.StringType()), T.StructField(posterior, T.DoubleType())]
    return docs.mapInArrow(releasing(run), T.StructType(fields))


def predict(docs: DataFrame, model: Model) -> DataFrame:
    """``doc_id, lang_pred, score``, see ``mark``; other columns are ignored."""
    return mark(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text"), model, keep=["doc_id"])
