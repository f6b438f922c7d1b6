"""Language identification in two steps: the language family, then the language within it.

Both steps are one-versus-one linear support vector machines (squared hinge, dual coordinate descent) over hashed
byte 2- and 3-grams of the whole lower-cased text. They are fitted on a sample of labelled rows of at most about
``per_language`` documents a language (chosen by a hash of the id, so that every part of the table is drawn from) and
applied to every text; prediction reads the text alone.

Defined cases: a text that is null or has no letter is ``und`` with score 0; rows whose lang is null teach nothing;
without any labelled row all is ``und``; a family of one language needs no second step; ids may repeat or be null;
extra columns are ignored; an empty table gives an empty result.
"""

from __future__ import annotations

from itertools import combinations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from latticework.llm.common import fold

BUCKETS = 4096
#: Families of language codes. A code that is not listed is a family of its own.
FAMILIES = {
    "germanic": "en de nl sv da no nb nn is fy af lb yi",
    "romance": "fr es it pt ro ca gl oc",
    "slavic": "ru uk be pl cs sk bg sr hr bs sl mk",
    "uralic": "fi et hu",
    "baltic": "lt lv",
    "turkic": "tr az kk uz ky tk",
    "indic": "hi bn mr ne gu pa ur",
    "semitic": "ar he mt",
    "celtic": "ga cy gd br",
    "malayic": "id ms",
}
FAMILY_OF = {code: family for family, codes in FAMILIES.items() for code in codes.split()}
KEEP = bytes(c if c >= 0x80 or chr(c).isalpha() else 0x20 for c in range(256))


def features(text: str) -> np.ndarray:
    """Square roots of n-gram shares, of length 1; a last constant 1 is the bias."""
    b = np.frombuffer(f" {text.lower()} ".encode("utf-8", "surrogatepass").translate(KEEP), np.uint8).astype(np.uint32)
    two = (b[:-1] << np.uint32(8)) | b[1:]
    three = (two[:-1] << np.uint32(8)) | b[2:]
    h = np.concatenate([(two * np.uint32(0x9E3779B1)) >> np.uint32(20), (three * np.uint32(0x85EBCA77)) >> np.uint32(20)])
    x = np.empty(BUCKETS + 1, np.float32)
    x[:BUCKETS] = np.sqrt(np.bincount(h, minlength=BUCKETS))
    x[:BUCKETS] /= max(np.sqrt(len(h)), 1.0)
    x[BUCKETS] = 1.0
    return x


def has_letter(text) -> bool:
    return isinstance(text, str) and any(map(str.isalpha, text))


def fit_svm(x: np.ndarray, y: np.ndarray, c: float = 10.0, epochs: int = 15) -> np.ndarray:
    """L2-loss linear SVM by dual coordinate descent; classes weigh the same whatever their sizes."""
    share = np.where(y > 0, len(y) / (2.0 * max((y > 0).sum(), 1)), len(y) / (2.0 * max((y < 0).sum(), 1)))
    diag = 1.0 / (2.0 * c * share)
    q = (x * x).sum(1) + diag
    a, w, rng = np.zeros(len(y)), np.zeros(x.shape[1], np.float64), np.random.default_rng(0)
    for _ in range(epochs):
        for i in rng.permutation(len(y)):
            g = y[i] * (x[i] @ w) - 1.0 + diag[i] * a[i]
            new = max(a[i] - g / q[i], 0.0)
            if new != a[i]:
                w += (new - a[i]) * y[i] * x[i]
                a[i] = new
    return w


class Votes:
    """One-versus-one machines over a list of classes."""

    def __init__(self, classes: list[str]):
        self.classes = classes
        self.pairs = list(combinations(range(len(classes)), 2))
        self.w = np.zeros((len(self.pairs), BUCKETS + 1))

    def fit(self, x: np.ndarray, label: np.ndarray) -> "Votes":
        for k, (i, j) in enumerate(self.pairs):
            rows = (label == self.classes[i]) | (label == self.classes[j])
            self.w[k] = fit_svm(x[rows], np.where(label[rows] == self.classes[i], 1.0, -1.0))
        return self

    def predict(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Winning class index (votes, then margins) and its least chance against another class."""
        n, k = len(x), len(self.classes)
        won, sure = np.zeros((n, k)), np.ones((n, k))
        margins = x @ self.w.T
        for m, (i, j) in zip(margins.T, self.pairs):
            p = 1.0 / (1.0 + np.exp(-np.clip(4.0 * m, -30, 30)))
            won[:, i] += (m >= 0) + 1e-3 * np.tanh(m)
            won[:, j] += (m < 0) - 1e-3 * np.tanh(m)
            sure[:, i], sure[:, j] = np.minimum(sure[:, i], p), np.minimum(sure[:, j], 1 - p)
        best = won.argmax(1)
        return best, sure[np.arange(n), best]


class Model:
    def __init__(self, x: np.ndarray, lang: np.ndarray):
        family = np.array([FAMILY_OF.get(v, v) for v in lang], dtype=object)
        self.top = Votes(sorted(set(family))).fit(x, family)
        self.inner = [Votes(sorted(set(lang[family == f]))).fit(x[family == f], lang[family == f]) for f in self.top.classes]

    def predict(self, x: np.ndarray) -> tuple[list[str], np.ndarray]:
        fam, p = self.top.predict(x)
        out = np.empty(len(x), object)
        for f, inner in enumerate(self.inner):
            rows = np.flatnonzero(fam == f)
            if len(rows):
                best, q = inner.predict(x[rows])
                out[rows] = [inner.classes[b] for b in best]
                p[rows] *= q
        return list(out), p


def fit(docs: DataFrame, learn: Column, per_language: int = 600) -> Model | None:
    """A model from rows where ``learn`` holds; at most about ``per_language`` of each language."""
    labelled = docs.where(learn & F.col("lang").isNotNull())
    counts = {r["lang"]: r["n"] for r in labelled.groupBy("lang").agg(F.count("*").alias("n")).collect()}
    if not counts:
        return None
    span = 1 << 30
    limit = F.lit(0)
    for lang, n in counts.items():
        limit = F.when(F.col("lang") == lang, int(span * min(1.0, per_language / n))).otherwise(limit)
    # equal texts of a language, as of rows that repeat an id, teach once
    sample = labelled.where(F.pmod(F.xxhash64(F.col("doc_id"), "text", F.lit("sample")), F.lit(span)) < limit).select("lang", "text").distinct()

    def featurise(batches):
        for pdf in batches:
            keep = pdf[pdf["text"].map(has_letter).astype(bool)]
            yield pd.DataFrame({"lang": keep["lang"], "x": [features(t).astype(np.float16).tobytes() for t in keep["text"]]})

    rows = sample.mapInPandas(featurise, "lang string, x binary").collect()
    if not rows:
        return None
    x = np.stack([np.frombuffer(r["x"], np.float16) for r in rows]).astype(np.float32)
    order = np.lexsort((x @ np.arange(x.shape[1], dtype=np.float32), [r["lang"] for r in rows]))  # the same whatever order rows come in
    return Model(x[order], np.array([r["lang"] for r in rows], object)[order])


def predict(docs: DataFrame, model: Model | None) -> DataFrame:
    """All columns of ``docs``, then ``lang_pred`` and ``score`` of its text."""

    @F.pandas_udf("lang_pred string, score double")
    def apply(text: pd.Series) -> pd.DataFrame:
        ok = np.flatnonzero(text.map(has_letter).to_numpy(bool)) if model is not None else np.empty(0, int)
        lang, score = np.full(len(text), "und", object), np.zeros(len(text))
        values = text.to_numpy(object)
        for part in np.array_split(ok, max(1, -(-len(ok) // 256))):
            if len(part):
                lang[part], score[part] = model.predict(np.stack([features(values[i]) for i in part]))
        return pd.DataFrame({"lang_pred": lang, "score": score})

    kept = [F.col(f"`{c}`") for c in docs.columns if c not in ("lang_pred", "score")]
    return docs.select(*kept, apply("text").alias("_guess")).select(*kept, "_guess.lang_pred", "_guess.score")


def identify(docs: DataFrame, per_language: int = 600, parts: int = 4, held: int = 2) -> DataFrame:
    """``(doc_id, held_out, lang_pred, score)``, learning from rows outside the held-out fold."""
    held_out = F.coalesce(fold(F.col("doc_id"), parts) == held, F.lit(False))
    docs = docs.select("doc_id", held_out.alias("held_out"), "text", "lang")
    return predict(docs, fit(docs, ~F.col("held_out"), per_language)).select("doc_id", "held_out", "lang_pred", "score")
