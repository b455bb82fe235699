"""Language ID: blended-spectrum presence kernel, Nystroem landmarks, one-versus-rest kernel ridge regression.

A text is the set of its letter n-grams (lengths 1 to 3, one space between
words, hashed to ``HASHED`` codes). The kernel of two texts is the number of
codes of a vocabulary that both hold, over the root of the product of what each
holds. Landmark texts of every language span the feature space: the kernel row
of a text against the landmarks, times the inverse root of the landmarks' own
kernel matrix. Ridge regression on those features has a target of 1 for the own
language and -1 for the rest. Scoring is two matrix products per batch of texts.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from stocktide.llm.common import held_out, learning_texts, staged, text_or_empty

#: Learning texts per language, and how many of them are landmarks.
PER_LANGUAGE, LANDMARKS = 400, 40
#: Codes that n-grams are hashed to, codes kept as vocabulary, longest n-gram.
HASHED, VOCABULARY, LONGEST = 1 << 17, 4096, 3
#: Texts whose rows are multiplied at once.
BLOCK = 256
RIDGE = 1e-2
UNKNOWN = "und"

_LETTER: np.ndarray | None = None


def _letters() -> np.ndarray:
    """True for code points that are letters."""
    global _LETTER
    if _LETTER is None:
        _LETTER = np.fromiter((chr(c).isalpha() for c in range(0x110000)), bool, 0x110000)
    return _LETTER


def gram_codes(text: str | None) -> np.ndarray:
    """Codes of the n-grams of a text, repeats included; empty if it has no letter."""
    points = np.frombuffer((text or "").lower().encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.int64)
    letter = _letters()[points]
    if not letter.any():
        return np.empty(0, np.int64)
    points = np.where(letter, points, 32)
    points = np.concatenate(([32], points, [32]))
    points = points[np.concatenate(([True], (points[1:] != 32) | (points[:-1] != 32)))]
    out, code = [], np.zeros(len(points), np.int64)
    for n in range(1, LONGEST + 1):
        code = code[: len(points) - n + 1] * 1_000_003 + points[n - 1:]
        mixed = (code + n) * 0x9E3779B1
        out.append((mixed ^ (mixed >> 15)) & (HASHED - 1))
    return np.concatenate(out)


@dataclass(frozen=True)
class LanguageModel:
    """``place`` maps a code to its column or -1; ``landmarks`` is vocabulary x landmarks; ``weights`` landmarks x languages."""

    languages: tuple[str, ...]
    place: np.ndarray
    landmarks: np.ndarray
    landmark_sizes: np.ndarray
    weights: np.ndarray


def _presence(texts: list[str | None], place: np.ndarray, columns: int) -> tuple[np.ndarray, np.ndarray]:
    """0/1 rows over the vocabulary, and which texts have a letter."""
    x = np.zeros((len(texts), columns + 1), np.float32)  # the last column takes what is not in the vocabulary
    lettered = np.zeros(len(texts), bool)
    for i, t in enumerate(texts):
        codes = gram_codes(t)
        lettered[i] = len(codes) > 0
        x[i, place[codes]] = 1
    return x[:, :columns], lettered


def _kernel(x: np.ndarray, landmarks: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    held = np.maximum(x.sum(axis=1), 1)
    return (x @ landmarks) / np.sqrt(held[:, None] * sizes[None, :])


def fit(docs: DataFrame, per_language: int = PER_LANGUAGE, landmarks: int = LANDMARKS) -> LanguageModel | None:
    """Model from about ``per_language`` texts of each non-null language, held-out ids excluded; None without any.

    The sample is bounded, so landmarks and kernel matrix fit on the driver.
    """
    known = docs.select("doc_id", F.col("lang").cast("string").alias("lang"))
    texts = staged(learning_texts(docs, known, "lang", per_language))
    rows = [(r.text, r.lang) for r in texts.orderBy(F.xxhash64("text"), "text", "lang").collect()]
    codes = [np.unique(gram_codes(t)) for t, _ in rows]
    rows = [(c, lang) for c, (_, lang) in zip(codes, rows) if len(c)]
    if not rows:
        return None
    languages = tuple(sorted({lang for _, lang in rows}))
    y = np.array([languages.index(lang) for _, lang in rows])
    share = np.zeros((len(languages), HASHED), np.float32)
    for c, k in zip((c for c, _ in rows), y):
        share[k, c] += 1
    share /= np.bincount(y, minlength=len(languages))[:, None]
    telling = share.max(axis=0) - share.min(axis=0) if len(languages) > 1 else share[0]
    chosen = np.argsort(-telling, kind="stable")[:VOCABULARY]
    chosen = np.sort(chosen[telling[chosen] > 0])
    place = np.full(HASHED, len(chosen), np.int32)
    place[chosen] = np.arange(len(chosen))
    x = np.zeros((len(rows), len(chosen) + 1), np.float32)
    for i, (c, _) in enumerate(rows):
        x[i, place[c]] = 1
    x = x[:, : len(chosen)]
    marks = np.concatenate([np.flatnonzero(y == k)[:landmarks] for k in range(len(languages))])
    z, sizes = np.ascontiguousarray(x[marks].T), np.maximum(x[marks].sum(axis=1), 1)
    own = _kernel(x[marks], z, sizes).astype(float)
    values, vectors = np.linalg.eigh(own)
    keep = values > 1e-6 * values.max()
    root = vectors[:, keep] / np.sqrt(values[keep])  # kernel row -> Nystroem features
    features = _kernel(x, z, sizes) @ root
    target = np.where(y[:, None] == np.arange(len(languages))[None, :], 1.0, -1.0)
    balance = np.sqrt(1.0 / np.bincount(y, minlength=len(languages))[y])[:, None]
    a, b = features * balance, target * balance
    solved = np.linalg.solve(a.T @ a + RIDGE * np.eye(a.shape[1]) / max(1, a.shape[1]), a.T @ b)
    return LanguageModel(languages, place, z, sizes.astype(np.float32), (root @ solved).astype(np.float32))


def predict(docs: DataFrame, model: LanguageModel | None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``(id, held_out, lang_pred, score)`` for every row.

    A null text or one without any letter is ``und`` with score 0, as is every
    text when no model could be learned. Ties go to the first language by name.
    Repeated rows and ids give one row each; a null id is not held out; whole
    texts are read.
    """
    spark = docs.sparkSession
    shared = spark.sparkContext.broadcast(model)  # bounded by vocabulary, landmarks and languages

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = shared.value
        for b in batches:
            names, scores = [], []
            for at in range(0, b.num_rows, BLOCK):
                texts = b.column(1).slice(at, BLOCK).to_pylist()
                if m is None:
                    names += [UNKNOWN] * len(texts)
                    scores += [0.0] * len(texts)
                    continue
                x, lettered = _presence(texts, m.place, m.landmarks.shape[0])
                decision = _kernel(x, m.landmarks, m.landmark_sizes) @ m.weights
                best = decision.argmax(axis=1)
                top = np.clip((decision[np.arange(len(best)), best] + 1) / 2, 0, 1)
                names += [m.languages[k] if ok else UNKNOWN for k, ok in zip(best, lettered)]
                scores += np.where(lettered, top, 0.0).astype(float).tolist()
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(names, pa.string()), pa.array(scores, pa.float64())], names=["id", "lang_pred", "score"])

    rows = docs.select(F.col(id_col).cast("long").alias("id"), text_or_empty(text_col).alias("text"))
    found = rows.mapInArrow(run, "id long, lang_pred string, score double")
    return found.select(F.col("id").alias(id_col), held_out("id").alias("held_out"), "lang_pred", "score")
