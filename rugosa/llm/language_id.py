"""Language identification by segmentation-marginalised unigram models.

Every language has a probability for each piece of a fixed public vocabulary.
A word (a run of letters, lower-cased, with the vocabulary's word mark before
it) has, in a language, the sum over all its segmentations of the product of
piece probabilities, which a forward algorithm gives in log space; a text has
the product over its words. The prediction is the language of the highest
posterior under equal priors.

Training is expectation-maximisation over the same sums: a forward-backward
pass gives each piece's expected count per language in Spark tasks, over a table
of word counts, and the driver turns at most ``vocabulary x languages`` sums
into probabilities. The word counts come from a bounded, documented sample:
about ``TRAIN_DOCS`` documents a language, those with the smallest id hashes.

No piece spans two words, so a worker computes each distinct word once and adds
up its rows. Runs of more than ``CHUNK`` letters are cut there, all of them
scored.

Defined results: null texts and texts without a letter are ``und`` with score 0,
and so is everything when there is nothing to learn from; ties go to the first
language in string order; repeated rows are scored alike; an empty table gives
an empty result; extra columns are ignored.
"""

from __future__ import annotations

import re

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rugosa.llm.common import arrow_rows, store
from rugosa.session import ship_package

#: Documents per language that training reads, about (bound of the sample).
TRAIN_DOCS = 2000
#: Languages at most (bounds what the driver and the tasks hold).
MAX_LANGUAGES = 400
ITERATIONS = 3
#: Letters of a run scored in one go.
CHUNK = 48
#: Words a worker remembers before it starts anew.
CACHE_WORDS = 400_000
#: Added to the expected count of every piece.
SMOOTH = 0.05
#: Log probability of a letter that no piece covers.
UNKNOWN = -18.0
MARK = "▁"
UNDETERMINED = "und"

_LETTERS = re.compile(r"[^\W\d_]+")


def words(text: str | None) -> list[str]:
    return _LETTERS.findall((text or "").lower())


def parts(word: str) -> list[str]:
    """The letters of a word, marked, in runs of at most CHUNK."""
    word = MARK + "".join(filter(str.isalpha, word))
    return [word[i : i + CHUNK] for i in range(0, len(word), CHUNK)] if len(word) > 1 else []


class Vocabulary:
    """Piece numbers of a sentencepiece model, and piece spans of words."""

    def __init__(self, model_file: str):
        import sentencepiece

        sp = sentencepiece.SentencePieceProcessor(model_file=model_file)
        normal = (i for i in range(sp.get_piece_size()) if not (sp.is_byte(i) or sp.is_control(i) or sp.is_unknown(i)))
        self.size = sp.get_piece_size()
        self.number = {p: i for i in normal if (p := sp.id_to_piece(i)) == p.lower() and p.strip(MARK)}
        self.longest = max(map(len, self.number))

    def lattices(self, runs: list[str]):
        """Runs of one length at a time: their positions in ``runs`` and, for each
        end and length, the piece number or -1."""
        by_length: dict[int, list[int]] = {}
        for i, r in enumerate(runs):
            by_length.setdefault(len(r), []).append(i)
        get = self.number.get
        for n, at in by_length.items():
            spans = [(t - k, t) for t in range(1, n + 1) for k in range(1, min(t, self.longest) + 1)]
            for low in range(0, len(at), 8192):
                own = at[low : low + 8192]
                flat = [get(r[a:b], -1) for r in (runs[i] for i in own) for a, b in spans]
                yield own, n, spans, np.array(flat, dtype=np.int64).reshape(len(own), len(spans))


def _sum_exp(x: np.ndarray) -> np.ndarray:
    top = x.max(axis=1)
    return top + np.log(np.exp(x - top[:, None]).sum(axis=1))


def _weights(pieces: np.ndarray, spans: list, log_p: np.ndarray) -> np.ndarray:
    """Log probability of each span; letters without a piece cost UNKNOWN."""
    alone = np.array([UNKNOWN if b - a == 1 else -np.inf for a, b in spans])
    return np.where(pieces >= 0, log_p[pieces], alone)


def forward(weights: np.ndarray, n: int, longest: int) -> np.ndarray:
    """Log sums over all segmentations of the first t letters, t from 0 to n."""
    alpha = np.zeros((len(weights), n + 1))
    at = 0
    for t in range(1, n + 1):
        k = min(t, longest)
        # spans that end at t start at t-1, t-2, ... t-k
        before = alpha[:, t - k : t][:, ::-1]
        alpha[:, t] = _sum_exp(before + weights[:, at : at + k])
        at += k
    return alpha


def backward(weights: np.ndarray, n: int, longest: int) -> np.ndarray:
    """Log sums over all segmentations of the letters from t on."""
    first = np.cumsum([0] + [min(t, longest) for t in range(1, n + 1)])  # of the spans that end at t+1
    beta = np.zeros((len(weights), n + 1))
    for t in range(n - 1, -1, -1):
        k = min(n - t, longest)
        ends = np.arange(t + 1, t + k + 1)
        own = first[ends - 1] + (ends - t - 1)
        beta[:, t] = _sum_exp(weights[:, own] + beta[:, ends])
    return beta


def expected_counts(vocabulary: Vocabulary, runs: list[str], n_runs: np.ndarray, log_p: np.ndarray) -> np.ndarray:
    """Expected number of uses of each piece over runs that occur n_runs times."""
    total = np.zeros(vocabulary.size)
    for own, n, spans, pieces in vocabulary.lattices(runs):
        w = _weights(pieces, spans, log_p)
        alpha, beta = forward(w, n, vocabulary.longest), backward(w, n, vocabulary.longest)
        start, end = np.array(spans).T
        share = np.exp(alpha[:, start] + w + beta[:, end] - alpha[:, n:]) * n_runs[own][:, None]
        used = pieces >= 0
        total += np.bincount(pieces[used], weights=share[used], minlength=vocabulary.size)
    return total


def sample(docs: DataFrame, per_language: int = TRAIN_DOCS) -> tuple[DataFrame, list[str]]:
    """``lang, text`` of about ``per_language`` documents of every language."""
    known = docs.where("lang is not null and text is not null")
    sizes = known.groupBy("lang").agg(F.count(F.lit(1)).alias("n"))
    found = [(r["lang"], r["n"]) for r in sizes.orderBy("lang").limit(MAX_LANGUAGES + 1).collect()]
    if len(found) > MAX_LANGUAGES:
        raise ValueError(f"more than {MAX_LANGUAGES} languages")
    if not found:
        return known.select("lang", "text").limit(0), []
    share = F.create_map(*[F.lit(x) for lang, n in found for x in (lang, min(1.0, per_language / n))])
    chance = F.pmod(F.xxhash64(F.col("doc_id"), F.lit(10)), F.lit(1 << 30)) / float(1 << 30)
    return known.where(chance < share[F.col("lang")]).select("lang", "text"), [lang for lang, _ in found]


def word_counts(rows: DataFrame) -> DataFrame:
    """``lang, run, n`` of ``lang, text`` rows, pre-aggregated per task."""
    ship_package(rows.sparkSession)

    def run(batches):
        held: dict[tuple[str, str], int] = {}

        def flush():
            keys = list(held)
            return pa.RecordBatch.from_arrays(
                [pa.array([k[0] for k in keys], pa.string()), pa.array([k[1] for k in keys], pa.string()), pa.array(list(held.values()), pa.int64())],
                names=["lang", "run", "n"],
            )

        for batch in batches:
            for lang, text in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                for w in words(text):
                    held[lang, w] = held.get((lang, w), 0) + 1
                if len(held) > CACHE_WORDS:
                    yield flush()
                    held.clear()
        yield flush()

    return rows.select("lang", "text").mapInArrow(run, "lang string, run string, n long").groupBy("lang", "run").agg(F.sum("n").alias("n"))


def train(docs: DataFrame, model_file: str, per_language: int = TRAIN_DOCS, iterations: int = ITERATIONS) -> tuple[list[str], np.ndarray]:
    """Languages and their log probabilities, one row a language."""
    spark = docs.sparkSession
    rows, languages = sample(docs, per_language)
    vocabulary = Vocabulary(model_file)
    usable = np.zeros(vocabulary.size)
    usable[list(vocabulary.number.values())] = 1
    # at first, pieces are as likely as their rank in the vocabulary suggests
    first = usable / (100 + np.arange(vocabulary.size))
    with np.errstate(divide="ignore"):
        log_p = np.log(np.repeat(first[None] / first.sum(), max(1, len(languages)), axis=0))
    if not languages:
        return [], log_p
    counts = store(word_counts(rows).repartition("lang", "run"), "language-words")
    number = {lang: i for i, lang in enumerate(languages)}
    for _ in range(iterations):
        shared = spark.sparkContext.broadcast(log_p)  # vocabulary x languages

        def expect(batches, shared=shared):
            vocab = Vocabulary(model_file)
            total = np.zeros(shared.value.shape)
            for batch in batches:
                by_lang: dict[int, tuple[list, list]] = {}
                for lang, word, n in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                    own = by_lang.setdefault(number[lang], ([], []))
                    for p in parts(word):
                        own[0].append(p)
                        own[1].append(n)
                for i, (runs, n) in by_lang.items():
                    if runs:
                        total[i] += expected_counts(vocab, runs, np.array(n, dtype=np.float64), shared.value[i])
            lang, piece = np.nonzero(total)
            if len(lang):
                yield pa.RecordBatch.from_arrays([pa.array(lang), pa.array(piece), pa.array(total[lang, piece])], names=["lang", "piece", "n"])

        got = counts.mapInArrow(expect, "lang long, piece long, n double").groupBy("lang", "piece").agg(F.sum("n").alias("n"))
        sums = np.zeros(log_p.shape)
        found = got.toArrow()  # at most vocabulary x languages rows
        sums[found["lang"].to_numpy(), found["piece"].to_numpy()] = found["n"].to_numpy()
        sums += SMOOTH * usable
        with np.errstate(divide="ignore"):
            log_p = np.log(sums / sums.sum(axis=1, keepdims=True))
    return languages, log_p


class WordScores:
    """Log likelihoods of words in every language, remembered within bounds."""

    def __init__(self, model_file: str, log_p: np.ndarray):
        self.vocabulary = Vocabulary(model_file)
        self.log_p = log_p
        self.row: dict[str, int] = {}
        self.rows = np.zeros((0, len(log_p) + 1))

    def learn(self, new: list[str]) -> None:
        runs, owner = [], []
        for i, w in enumerate(new):
            for p in parts(w):
                runs.append(p)
                owner.append(i)
        out = np.zeros((len(new), len(self.log_p) + 1))
        owners = np.array(owner, dtype=np.int64)
        for own, n, spans, pieces in self.vocabulary.lattices(runs):
            at = owners[own]
            out[at, -1] = 1  # it has a letter
            for i, log_p in enumerate(self.log_p):
                np.add.at(out[:, i], at, forward(_weights(pieces, spans, log_p), n, self.vocabulary.longest)[:, n])
        start = len(self.rows)
        self.rows = np.concatenate([self.rows, out])
        self.row.update((w, start + i) for i, w in enumerate(new))

    def score(self, texts: list[str | None]) -> list[np.ndarray | None]:
        """Per text the log likelihoods, or None without a letter."""
        cut = [words(t) for t in texts]
        if len(self.row) > CACHE_WORDS:
            self.row, self.rows = {}, self.rows[:0]
        new = list({w for c in cut for w in c if w not in self.row})
        for at in range(0, len(new), 100_000):
            self.learn(new[at : at + 100_000])
        out = []
        for c in cut:
            rows = self.rows[np.fromiter(map(self.row.__getitem__, c), dtype=np.int64, count=len(c))]
            total = rows.sum(axis=0)
            out.append(total[:-1] if total[-1] else None)
        return out


def identify(docs: DataFrame, training: DataFrame, model_file: str, per_language: int = TRAIN_DOCS) -> DataFrame:
    """doc_id, lang_pred, score of every document; learns from ``training``
    (doc_id, lang, text)."""
    languages, log_p = train(training, model_file, per_language)
    # vocabulary x languages, see MAX_LANGUAGES
    shared = docs.sparkSession.sparkContext.broadcast((languages, log_p))

    def make():
        names, table = shared.value
        scores = WordScores(model_file, table) if names else None

        def rows(part):
            got = scores.score([t for _, t in part]) if scores else [None] * len(part)
            out = []
            for (d, _), ll in zip(part, got, strict=True):
                if ll is None:
                    out.append((d, UNDETERMINED, 0.0))
                else:
                    best = int(ll.argmax())
                    out.append((d, names[best], float(1 / np.exp(ll - ll[best]).sum())))
            return out

        return rows

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return arrow_rows(rows, "doc_id long, lang_pred string, score double", ["doc_id", "lang_pred", "score"], make)
