"""Toxicity: a weighted lexicon matched by Aho-Corasick on folded texts."""

from __future__ import annotations

import unicodedata
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass
from math import exp, log, log1p, sqrt

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from stocktide.llm.common import held_out, learning_texts, staged, text_or_empty

#: Labelled rows per class that the lexicon and the calibration are learned from.
PER_CLASS = 20_000
#: Share of toxic learning texts that a term must occur in, and the fewest of them.
MIN_SHARE, MIN_TEXTS = 0.005, 8
#: Least log ratio of a lexicon term's rates among the words of toxic and of clean texts, two standard errors off.
MIN_WEIGHT = 1.5
#: Lengths of word beginnings that are tried as terms beside whole words.
PREFIXES = (4, 5, 6, 7)
#: Share of toxic texts that the scores are calibrated for, however many of each class were learned from.
PRIOR = 0.1
#: Repeats of a word in one text that count when the rates of terms are learned.
REPEATS = 5
#: Phrases in which a lexicon word is harmless.
EXCEPTIONS = ("trash can", "trash bin", "trash bag", "class clown", "clown fish", "pond scum", "soap scum")

# Characters that look like a Latin letter, and the letter.
LOOKALIKES = {
    "а": "a", "е": "e", "о": "o", "р": "p", "с": "c", "у": "y", "х": "x", "і": "i", "ј": "j", "ѕ": "s", "ԁ": "d", "һ": "h", "в": "b",
    "к": "k", "м": "m", "т": "t", "н": "h", "ɡ": "g", "ո": "n", "ս": "u", "α": "a", "β": "b", "ε": "e", "ι": "i", "κ": "k", "ν": "v",
    "ο": "o", "ρ": "p", "τ": "t", "υ": "u", "χ": "x", "ı": "i",
    "0": "o", "1": "i", "3": "e", "4": "a", "5": "s", "7": "t", "8": "b", "9": "g", "@": "a", "$": "s", "!": "i", "|": "i", "€": "e",
}


class _Folding(dict):
    """Translation table that is filled as characters are met: one letter, or a space, for each."""

    def __missing__(self, code: int) -> str:
        c = unicodedata.normalize("NFKC", chr(code)).lower()[:1]
        plain = LOOKALIKES.get(c, c)
        if unicodedata.combining(chr(code)):
            plain = ""
        elif not plain.isalpha():
            plain = " "
        self[code] = out = "i" if plain == "l" else plain  # l, 1 and I are one letter
        return out


_FOLDING = _Folding()


def fold(text: str | None) -> str:
    """Words of letters between single or repeated spaces, framed by spaces.

    Lookalikes of other scripts, width forms and digit substitutions become
    plain letters; accents that tell letters of a language apart stay.
    """
    words = (text or "").translate(_FOLDING)
    return f" {words} "


def _terms(folded: str) -> Counter[str]:
    """Terms of a text and how often they occur: whole words (framed) and word beginnings (space in front only)."""
    out: Counter[str] = Counter()
    for w, n in Counter(folded.split()).items():
        n = min(n, REPEATS)
        out[f" {w} "] += n
        for k in PREFIXES:
            if len(w) > k:
                out[f" {w[:k]}"] += n
    return out


def _term_counts(texts: DataFrame, wanted: frozenset[str] | None) -> DataFrame:
    """Texts that hold each term (``n``) and its occurrences (``times``), added up inside tasks before the shuffle.

    The term of the empty string stands for all words.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts: Counter[str] = Counter()
        times: Counter[str] = Counter()

        def out() -> pa.RecordBatch:
            terms = list(times)
            made = pa.RecordBatch.from_arrays(
                [pa.array(terms, pa.string()), pa.array([counts[t] for t in terms], pa.int64()), pa.array(list(times.values()), pa.int64())],
                names=["term", "n", "times"],
            )
            counts.clear()
            times.clear()
            return made

        for b in batches:
            for t in b.column(0):
                folded = fold(t.as_py())
                found = _terms(folded)
                if wanted is not None:
                    found = Counter({t: found[t] for t in found.keys() & wanted})
                counts.update(found.keys())
                times.update(found)
                times[""] += sum(min(n, REPEATS) for n in Counter(folded.split()).values())
                if len(counts) > 400_000:
                    yield out()
        yield out()

    found = texts.select("text").mapInArrow(run, "term string, n long, times long")
    return found.groupBy("term").agg(F.sum("n").alias("n"), F.sum("times").alias("times"))


@dataclass(frozen=True)
class ToxicityModel:
    lexicon: dict[str, float]
    exceptions: tuple[str, ...]
    coefficients: tuple[float, float, float]


class _Matcher:
    def __init__(self, lexicon: dict[str, float], exceptions: tuple[str, ...]):
        self.words = ahocorasick.Automaton()
        for term, weight in lexicon.items():
            self.words.add_word(term, (len(term), weight))
        for phrase in exceptions:
            p = fold(phrase)
            self.words.add_word(p, (len(p), None))
        self.words.make_automaton()

    def features(self, text: str | None) -> tuple[float, float]:
        """Log of the matched weight, and of the matched weight per thousand letters."""
        folded = fold(text)
        hits, safe = [], []
        if len(self.words):
            for end, (n, weight) in self.words.iter(folded):
                (safe if weight is None else hits).append((end - n + 1, end, weight))
        total, taken = 0.0, -1
        for start, end, weight in sorted(hits, key=lambda h: (h[0], -h[1])):
            if start == taken or any(a <= start and end <= b for a, b, _ in safe):
                continue  # one hit for each word, none inside an exception
            total, taken = total + weight, start
        return log1p(total), log1p(1000.0 * total / max(40, len(folded)))


def _features(texts: DataFrame, model: ToxicityModel, label: str) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        matcher = _Matcher(model.lexicon, model.exceptions)
        for b in batches:
            found = np.array([matcher.features(t.as_py()) for t in b.column(0)], dtype=float).reshape(-1, 2)
            yield pa.RecordBatch.from_arrays([pa.array(found[:, 0]), pa.array(found[:, 1]), b.column(1).cast(pa.int64())], names=["total", "density", "label"])

    return texts.select("text", label).mapInArrow(run, "total double, density double, label long")


def _lexicon(toxic: dict[str, tuple[int, int]], clean: dict[str, tuple[int, int]]) -> dict[str, float]:
    """Terms that are far likelier among the words of toxic texts, and the log of that ratio.

    Of a chain of word beginnings the longest that loses no toxic text stays,
    and longer terms that it implies go.
    """
    all_toxic, all_clean = toxic[""][1] + 1, clean.get("", (0, 0))[1] + 1
    weight = {}
    for t, (n, times) in toxic.items():
        n_clean, times_clean = clean.get(t, (0, 0))
        ratio = log((times + 0.5) / all_toxic) - log((times_clean + 0.5) / all_clean)
        weight[t] = ratio - 2 * sqrt(1 / (n + 0.5) + 1 / (n_clean + 4)) if t else 0.0
    strong = sorted((t for t, w in weight.items() if w >= MIN_WEIGHT), key=len, reverse=True)
    longest: dict[str, int] = {}  # most texts of any longer term that begins so
    closed = []
    for t in strong:
        if longest.get(t, 0) < 0.98 * toxic[t][0]:
            closed.append(t)
        word = t.rstrip()
        for k in range(2, len(word) + (t != word)):
            longest[word[:k]] = max(longest.get(word[:k], 0), toxic[t][0])
    kept: dict[str, float] = {}
    for t in sorted(closed, key=len):
        if not any(t[:k] in kept for k in range(2, len(t))):
            kept[t] = weight[t]
    return kept


def _logistic(x: np.ndarray, y: np.ndarray, ridge: float = 0.1, steps: int = 30) -> tuple[float, ...]:
    """Ridge logistic regression by Newton steps; the toxic class gets the weight ``PRIOR``."""
    x = np.column_stack([x, np.ones(len(x))])
    weight = np.where(y == 1, PRIOR / max(1, (y == 1).sum()), (1 - PRIOR) / max(1, (y == 0).sum())) * len(y)
    beta = np.zeros(x.shape[1])
    keep = np.diag([ridge, ridge, 1e-3])
    for _ in range(steps):
        p = 1 / (1 + np.exp(-np.clip(x @ beta, -30, 30)))
        gradient = x.T @ (weight * (p - y)) + keep @ beta
        beta -= np.linalg.solve(x.T @ (x * (weight * p * (1 - p))[:, None]) + keep, gradient)
    return tuple(float(v) for v in beta)


def fit(docs: DataFrame, labels: DataFrame, per_class: int = PER_CLASS, exceptions: tuple[str, ...] = EXCEPTIONS) -> ToxicityModel:
    """Lexicon, weights and calibration from at most about ``per_class`` labelled texts of each class.

    Rows of ``labels`` without id or label, and held-out ids, are not used; an id
    with several labels counts as toxic if one of them says so. Without both
    classes the model scores everything 0.
    """
    labelled = labels.select(F.col("doc_id"), (F.col("toxic") == 1).cast("int").alias("toxic"))
    texts = staged(learning_texts(docs, labelled, "toxic", per_class))
    sizes = {r.toxic: r.n for r in texts.groupBy("toxic").agg(F.count(F.lit(1)).alias("n")).collect()}
    n_toxic, n_clean = sizes.get(1, 0), sizes.get(0, 0)
    if not n_toxic or not n_clean:
        return ToxicityModel({}, exceptions, (0.0, 0.0, -10.0))
    least = max(min(MIN_TEXTS, n_toxic / 8), MIN_SHARE * n_toxic)  # so the terms are at most (terms of a text) / MIN_SHARE
    frequent = _term_counts(texts.where("toxic = 1"), None).where((F.col("n") >= least) | (F.col("term") == ""))
    toxic = {r.term: (r.n, r.times) for r in frequent.collect()}
    clean = {r.term: (r.n, r.times) for r in _term_counts(texts.where("toxic = 0"), frozenset(toxic)).collect()}
    model = ToxicityModel(_lexicon(toxic, clean), exceptions, (0.0, 0.0, 0.0))
    rows = np.array([tuple(r) for r in _features(texts, model, "toxic").collect()], dtype=float)
    return ToxicityModel(model.lexicon, exceptions, _logistic(rows[:, :2], rows[:, 2]))


def score(docs: DataFrame, model: ToxicityModel, id_col: str = "doc_id", text_col: str = "text", threshold: float = 0.3) -> DataFrame:
    """``(id, held_out, score, predicted)`` for every row.

    Null and empty texts hold no term and get the score of a text without hits;
    repeated rows and ids give one row each; a null id is never held out; whole
    texts are matched. An empty table gives no row.
    """
    a, b, c = model.coefficients

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        matcher = _Matcher(model.lexicon, model.exceptions)
        for batch in batches:
            scores = []
            for t in batch.column(1):
                total, density = matcher.features(t.as_py())
                scores.append(1 / (1 + exp(-max(-30.0, min(30.0, a * total + b * density + c)))))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(scores, pa.float64())], names=["id", "score"])

    rows = docs.select(F.col(id_col).cast("long").alias("id"), text_or_empty(text_col).alias("text"))
    found = rows.mapInArrow(run, "id long, score double")
    return found.select(
        F.col("id").alias(id_col), held_out("id").alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted")
    )


def keep_clean(docs: DataFrame, model: ToxicityModel, threshold: float = 0.3) -> DataFrame:
    """Rows of ``docs`` below the threshold, with all their columns."""
    columns = docs.columns
    a, b, c = model.coefficients

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        matcher = _Matcher(model.lexicon, model.exceptions)
        limit = log(threshold / (1 - threshold))
        for batch in batches:
            found = (matcher.features(t.as_py()) for t in batch.column(batch.schema.get_field_index("text")))
            yield batch.filter(pa.array([a * total + b * density + c < limit for total, density in found], pa.bool_()))

    return docs.mapInArrow(run, docs.schema).select(*columns)
