"""Quality rules on tokeniser fertility.

Three public vocabularies measure each whole text in one pass: a byte-level one, one of the same kind for many
languages, and one with byte fallback. Each gives characters per token and the share of tokens that are bytes or
pieces of a character, the last over the words one by one; words are cut into tokens once for many texts; the first also gives the entropy of its token ids, relative to that of as many different tokens.

Rejection bands are fitted for each language (values of the column ``language``) or, where that is null, script: over
all documents that pass the base rules, a measure may be some times (``WIDTH``) as far from the median as the quartile
on that side, and always as far as a slack. Quartiles stay put while less than a quarter of a language is junk. Groups of fewer than ``least`` documents have the fixed band of their
script instead. The base counts (words, symbols, repeated lines and word triples) come from the same pass, and a
text that fails them is rejected whatever its fertility.

Defined cases: null or empty text has no words, measures 0 and fails; a script without a band of its own takes that
of ``other``; if most documents of a language are junk, its band is that of junk; ids may repeat or be null; extra
columns are ignored; an empty table gives an empty result.
"""

from __future__ import annotations

import re
from itertools import chain

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from latticework.llm import tokens
from latticework.llm.common import encode
from latticework.storage import Scratch

SPACE = b"\x20\x09\x0a\x0b\x0c\x0d"
#: A word with the space before it, or white space up to the last before a word: no token of the byte-level vocabularies crosses these.
CHUNKS = re.compile(r" ?[^ \t-\r]+|[ \t-\r]+(?![^ \t-\r])|[ \t-\r]").findall
#: Chunks of white space, and those that begin or end with white space that isn't ASCII: the vocabularies join it with what stands beside.
BLANK = r"^[ \t-\r]+$"
WIDE = r"[\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]"
ODD = rf"^ ?{WIDE}|{WIDE}$"
#: First code points of blocks and the script each starts.
BLOCKS = (
    (0x41, "latin"), (0x370, "greek"), (0x400, "cyrillic"), (0x530, "other"), (0x590, "hebrew"), (0x600, "arabic"),
    (0x780, "other"), (0x900, "indic"), (0xA00, "south"), (0xB80, "indic"), (0xC00, "south"), (0xE00, "thai"),
    (0xE80, "other"), (0x1100, "hangul"), (0x1200, "other"), (0x1E00, "latin"), (0x1F00, "greek"), (0x2000, "symbols"),
    (0x2C00, "other"), (0x3040, "kana"), (0x3100, "other"), (0x31F0, "kana"), (0x3200, "other"),
    (0x3400, "han"), (0xA000, "other"), (0xAC00, "hangul"),
    (0xD7B0, "other"), (0xF900, "han"), (0xFB00, "other"), (0xFFF0, "symbols"), (0x10000, "other"), (0x1D000, "symbols"),
    (0x1E000, "other"), (0x1F000, "symbols"), (0x20000, "han"), (0x30000, "other"),
)
STARTS = np.array([b for b, _ in BLOCKS], np.uint32)
NAMES = [n for _, n in BLOCKS]
#: Fixed values, for groups too small to fit: (least, most) characters per token, most byte share and least relative entropy
#: by the first vocabulary, most byte share of the one for many languages, most byte fallback share. A share of 1.00 decides
#: nothing: that vocabulary splits ordinary text of the script to the end, and the byte fallback decides. ``south``
#: (Gurmukhi to Malayalam and Sinhala, without Tamil) and the letters of ``other`` have few or no tokens in any of the three.
BANDS = {
    "latin": (1.3, 8.0, 0.30, 0.40, 0.30, 0.30),
    "greek": (0.7, 5.0, 0.70, 0.40, 0.50, 0.30),
    "cyrillic": (0.7, 5.0, 0.70, 0.40, 0.40, 0.30),
    "hebrew": (0.4, 4.0, 0.95, 0.30, 0.60, 0.40),
    "arabic": (0.4, 4.0, 0.85, 0.30, 0.50, 0.40),
    "indic": (0.25, 4.0, 1.00, 0.30, 1.00, 0.60),
    "thai": (0.25, 4.0, 1.00, 0.30, 0.60, 0.40),
    "hangul": (0.25, 4.0, 1.00, 0.30, 0.85, 0.50),
    "han": (0.3, 2.5, 1.00, 0.35, 0.70, 0.50),
    "kana": (0.3, 2.5, 1.00, 0.35, 0.70, 0.50),
    "south": (0.25, 6.0, 1.00, 0.30, 1.00, 1.00),
    "symbols": (0.25, 6.0, 0.60, 0.30, 0.60, 0.60),
    "other": (0.25, 6.0, 1.00, 0.30, 1.00, 1.00),
}
#: Measures by what they measure, in the order in which a rejection is put down to one.
PER_TOKEN = ("chars_per_token", "multi_chars_per_token", "piece_chars_per_token")
SHARES = ("byte_share", "multi_byte_share", "fallback_share")
MEASURES = (*PER_TOKEN, *SHARES, "entropy")
#: How far a fitted band reaches: times the distance from the median to the quartile (of entropy, whose quartiles lie far
#: apart: fewer times), and at least so far: a part of the median for characters per token, else as it is.
WIDTH, ENTROPY_WIDTH = 12.0, 4.0
SLACK, SHARE_SLACK, ENTROPY_SLACK = 0.20, 0.10, 0.15
#: So many fitted groups are sent to all executors; beyond it their bands are joined by shuffle.
GROUPS = 10_000
#: Characters of the texts that are cut into tokens together; a longer text is by itself.
BLOCK = 8_000_000
OUT = (
    "doc_id long, n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, "
    "base_failed boolean, script string, band string, n_tokens long, " + ", ".join(f"{m} double" for m in MEASURES)
)


def script_of(text: str) -> str:
    """The script of most letters; ``latin`` for pure ASCII."""
    if text.isascii():
        return "latin"
    points = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)
    points = points[(points >= 0x80) | ((points >= 0x41) & (points < 0x5B)) | ((points >= 0x61) & (points < 0x7B))]
    counts: dict[str, int] = {}
    for block, n in enumerate(np.bincount(np.searchsorted(STARTS, points, "right"), minlength=len(STARTS) + 1)):
        if n and block:
            counts[NAMES[block - 1]] = counts.get(NAMES[block - 1], 0) + int(n)
    return max(sorted(counts), key=counts.get) if counts else "other"


def repeated_words(words: list[bytes]) -> int:
    """Words in three-word windows that the text has twice or more."""
    n = len(words) - 2
    if n < 2:
        return 0
    seen: dict[bytes, int] = {}
    ids = np.fromiter([seen.setdefault(w, len(seen)) for w in words], np.int64, len(words))
    size = len(seen)
    pair = ids[:-2] * size + ids[1:-1]
    if size > 1_000_000:  # keeps the combined number within 64 bits
        pair = np.unique(pair, return_inverse=True)[1].astype(np.int64)
    window = pair * size + ids[2:]
    order = np.argsort(window, kind="stable")
    same = window[order[1:]] == window[order[:-1]]
    twice = np.zeros(n, bool)
    twice[order[1:][same]] = True
    twice[order[:-1][same]] = True
    covered = np.zeros(len(words), bool)
    for j in range(3):
        covered[j : j + n] |= twice
    return int(covered.sum())


def base_counts(text) -> tuple[int, int, int, int, int]:
    """n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words."""
    b = encode(text)
    words = b.split()
    if not words:
        return 0, 0, 0, 0, 0
    spaces = len(b) - len(b.translate(None, SPACE))
    lines = [x for x in b.split(b"\n") if x.strip(SPACE)]
    symbols = len(b) - len(b.translate(None, b"#*$%&|<>"))
    return len(words), len(text) - spaces, symbols, len(lines) - len(set(lines)), repeated_words(words)


def entropy_of(ids: np.ndarray) -> float:
    """Of the ids of a text, relative to that of as many different ones (2,000 at most)."""
    n = len(ids)
    if n < 2:
        return 0.0
    counts = np.diff(np.flatnonzero(np.concatenate([[True], np.diff(np.sort(ids)) != 0, [True]])))
    return float((np.log(n) - (counts * np.log(counts)).sum() / n) / np.log(min(n, 2000)))


def cut(encoder, is_byte: np.ndarray, lengths: np.ndarray, chunks: pa.Array, apart: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Tokens of each chunk, all of them, and those of each chunk that are bytes.

    Chunks are cut in one call, with an end of line between them, which is a token of its own and is taken out again by its place; those of
    white space and odd ones are cut ``apart``.
    """
    whole, apart = np.flatnonzero(~apart), np.flatnonzero(apart)
    lines = "\n".join(chunks.take(pa.array(whole)).to_pylist())
    ids = np.asarray(encoder.encode_to_numpy(lines, allowed_special=set(), disallowed_special=()), np.uint32)
    ends = np.cumsum(pc.binary_length(chunks).to_numpy()[whole] + np.int64(1)) - 1
    size = lengths[ids]
    starts = np.cumsum(size) - size
    at = np.searchsorted(ends, starts)
    inside = starts != ends[at]
    ids, owner = ids[inside], whole[at[inside]]
    more = [encoder.encode_ordinary(c) for c in chunks.take(pa.array(apart)).to_pylist()]
    if more:
        ids = np.concatenate([ids, np.fromiter(chain.from_iterable(more), np.uint32)])
        owner = np.concatenate([owner, np.repeat(apart, list(map(len, more)))])
        order = np.argsort(owner, kind="stable")
        ids, owner = ids[order], owner[order]
    return np.bincount(owner, minlength=len(chunks)), ids, np.bincount(owner, is_byte[ids], len(chunks)).astype(np.int64)


class Measures:
    """The vocabularies of a task.

    A text's tokens are those of its chunks (``CHUNKS``), since the byte-level vocabularies cut there too. So the different chunks of many
    texts are cut into tokens together, each once, and a text is sums over its chunks.
    """

    def __init__(self, vocabulary: str | None = None):
        multi = tokens.multi_path()
        self.bpe, self.bpe_bytes, self.bpe_lengths = (f(vocabulary) for f in (tokens.byte_bpe, tokens.token_kinds, tokens.token_lengths))
        self.multi, self.multi_bytes, self.multi_lengths = (f(multi) for f in (tokens.byte_bpe, tokens.token_kinds, tokens.token_lengths))
        self.pieces, self.piece_bytes = tokens.piece_bpe()

    def __call__(self, text) -> tuple:
        """n_tokens, then ``MEASURES``; all 0 without a token."""
        return self.many([text])[0]

    def many(self, texts: list) -> list[tuple]:
        """The same for each text."""
        texts = [t if isinstance(t, str) else "" for t in texts]
        block = np.cumsum([len(t) for t in texts], dtype=np.int64) // BLOCK
        cuts = [0, *(np.flatnonzero(np.diff(block)) + 1).tolist(), len(texts)]
        return [row for a, z in zip(cuts, cuts[1:]) for row in self.block(texts[a:z])]

    def words(self, chunks: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Tokens of each chunk's word by the vocabulary with byte fallback, and those that are bytes."""
        found = self.pieces.encode(pc.ascii_trim(chunks, SPACE.decode()).to_pylist(), num_threads=1)
        sizes = np.fromiter(map(len, found), np.int64, len(found))
        flat = np.fromiter(chain.from_iterable(found), np.int64, int(sizes.sum()))
        return sizes, np.bincount(np.repeat(np.arange(len(found)), sizes), self.piece_bytes[flat], len(found)).astype(np.int64)

    def block(self, texts: list[str]) -> list[tuple]:
        found = list(map(CHUNKS, texts))
        edges = np.cumsum([0, *map(len, found)])
        coded = pa.array(chain.from_iterable(found), pa.string()).dictionary_encode()
        del found
        chunks, at = coded.dictionary, coded.indices.to_numpy()
        if not len(chunks):
            return [(0, *[0.0] * len(MEASURES))] * len(texts)
        odd = pc.match_substring_regex(chunks, ODD).to_numpy(zero_copy_only=False)
        apart = odd | pc.match_substring_regex(chunks, BLANK).to_numpy(zero_copy_only=False)
        sizes, ids, n_bytes = cut(self.bpe, self.bpe_bytes, self.bpe_lengths, chunks, apart)
        multi, _, multi_bytes = cut(self.multi, self.multi_bytes, self.multi_lengths, chunks, apart)
        columns = (sizes, n_bytes, multi, multi_bytes, *self.words(chunks), odd)
        n, n_bytes, multi, multi_bytes, pieces, fallbacks, odd = (np.diff(np.concatenate([[0], np.cumsum(c[at])])[edges]).tolist() for c in columns)
        start, sizes = (np.cumsum(sizes) - sizes)[at], sizes[at]
        ids = np.split(ids[np.repeat(start - np.cumsum(sizes) + sizes, sizes) + np.arange(sizes.sum())], np.cumsum(n)[:-1])
        out = []
        for k, text in enumerate(texts):
            if odd[k] or tokens.END in text:  # cut otherwise around its wide spaces or end marker
                ids[k], others = tokens.ids_of(self.bpe, text), tokens.ids_of(self.multi, text)
                n[k], n_bytes[k], multi[k], multi_bytes[k] = len(ids[k]), int(self.bpe_bytes[ids[k]].sum()), len(others), int(self.multi_bytes[others].sum())
            if not n[k]:
                out.append((0, *[0.0] * len(MEASURES)))
                continue
            letters = len(text) - sum(map(text.count, SPACE.decode()))
            rates = len(text) / n[k], len(text) / max(multi[k], 1), letters / max(pieces[k], 1)
            out.append((n[k], *rates, n_bytes[k] / n[k], multi_bytes[k] / max(multi[k], 1), fallbacks[k] / max(pieces[k], 1), entropy_of(ids[k])))
        return out


def measured(docs: DataFrame, language: str | None = None, vocabulary: str | None = None) -> DataFrame:
    """A row per document with base counts, ``MEASURES`` and the name of its band."""

    def run(batches):
        measure = Measures(vocabulary)
        for pdf in batches:
            rows = []
            for doc, text, lang, found in zip(pdf["doc_id"], pdf["text"], pdf["lang"], measure.many(pdf["text"].tolist())):
                counts = base_counts(text)
                n_words, n_repeat = counts[0], counts[-1]
                script = script_of(text) if n_words else "other"
                rows.append((doc, *counts, n_words < 50 or 100 * n_repeat > 50 * n_words, script, lang if isinstance(lang, str) else f"script {script}", *found))
            out = pd.DataFrame(rows, columns=[c.split()[0] for c in OUT.split(", ")])
            yield out.assign(doc_id=out["doc_id"].astype("Int64"))

    lang = F.col(language).cast("string") if language else F.lit(None).cast("string")
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", lang.alias("lang")).mapInPandas(run, OUT)


def fit_bands(measures: DataFrame, least: int = 100) -> DataFrame:
    """``(band, low_<measure>, high_<measure>)`` of groups with ``least`` documents that pass the base rules, from all of them."""
    quantiles = [F.percentile_approx(m, [0.25, 0.5, 0.75], 1000).alias(m) for m in MEASURES]
    found = measures.where("not base_failed").groupBy("band").agg(F.count("*").alias("n"), *quantiles).where(F.col("n") >= least)
    out = []
    for m in MEASURES:
        low, mid, high = (F.col(m)[k] for k in range(3))
        slack = SLACK * mid if m in PER_TOKEN else F.lit(SHARE_SLACK if m in SHARES else ENTROPY_SLACK)
        width = ENTROPY_WIDTH if m == "entropy" else WIDTH
        out.append((mid - F.greatest(width * (mid - low), slack)).alias(f"low_{m}"))
        out.append((mid + F.greatest(width * (high - mid), slack)).alias(f"high_{m}"))
    return found.select("band", *out)


def judge(docs: DataFrame, language: str | None = None, least: int = 100, vocabulary: str | None = None) -> DataFrame:
    """A row per document with base counts, measures, ``kept`` and ``rejected_by`` (``base``, or the first measure outside its band)."""
    scratch = Scratch(docs.sparkSession)
    rows = scratch.put(measured(docs, language, vocabulary))
    bands = scratch.put(fit_bands(rows, least))
    joined = rows.join(F.broadcast(bands) if bands.count() <= GROUPS else bands, "band", "left")

    def fixed(k: int):
        found = F.lit(BANDS["other"][k])
        for script, band in BANDS.items():
            found = F.when(F.col("script") == script, band[k]).otherwise(found)
        return found

    lows = {"chars_per_token": fixed(0), "entropy": fixed(3)}
    highs = {"chars_per_token": fixed(1), "byte_share": fixed(2), "multi_byte_share": fixed(4), "fallback_share": fixed(5)}
    fitted, verdict = F.col("low_entropy").isNotNull(), F.lit(None).cast("string")
    for m in reversed(MEASURES):
        outside = F.lit(False)
        if m not in SHARES:  # few bytes are no fault
            outside = outside | (F.col(m) < F.when(fitted, F.col(f"low_{m}")).otherwise(lows.get(m, F.lit(float("-inf")))))
        if m != "entropy":  # nor is a rich vocabulary
            outside = outside | (F.col(m) > F.when(fitted, F.col(f"high_{m}")).otherwise(highs.get(m, F.lit(float("inf")))))
        verdict = F.when(outside, m).otherwise(verdict)
    out = joined.withColumn("rejected_by", F.when(F.col("base_failed"), "base").otherwise(verdict))
    names = [c.split()[0] for c in OUT.split(", ")]
    return out.select(*names[:7], F.col("rejected_by").isNull().alias("kept"), "rejected_by", *names[7:])
