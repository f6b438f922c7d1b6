"""Language-model scoring with a Brown class bigram.

``p(text) = product of p(class | class before) * p(word | class)``, each text between end tokens. Counts of every word
are gathered from all training texts, and classes come from the exchange algorithm in two parts:

1. The seed: the ``frequent`` words by count are units of their own; every other word, seen or not, belongs to the unit
   of its ending (or that of words with digits, or a last one for all others). Units in turn move to the class that
   raises the likelihood of the class bigrams most, until nothing moves or for ``sweeps`` rounds. It needs unit bigram counts only,
   at most (frequent + endings + 2) squared numbers.
2. Every other word seen twice or more takes one exchange step of its own: how often each class comes before and
   after it is counted by word in the cluster, and the word moves to its class of greatest gain. Words seen once
   stay with their ending: one context says less about them (moving them too lowers the held-out likelihood).

Class transitions, counted with the final classes, are interpolated with class frequencies (Witten-Bell). Emissions use
absolute discounting with each class's own discount, and what it frees is the probability of the class's one unknown
word, so that probabilities of all known words and the unknown ones add up to one.

Texts are cut into words to count them and once more to write them as numbers of words, which all later passes read. Counts and
classes of the ``broadcast_words`` most frequent words travel with the code; those of all others are joined by word.
Defined cases: null or empty text is the end token alone; without training text every word is unknown; rows that
share an id are scored each; a null id is in no fold, thus trained on; extra columns are ignored; an empty table
gives an empty result.
"""

from __future__ import annotations

from itertools import repeat

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from latticework.llm.common import fold, most_frequent
from latticework.storage import Scratch

#: The end token: no word holds a space.
END = b" "
PUNCTUATION = b".,;:!?\"')("
DIGITS = frozenset(b"0123456789")
FLUSH = 1_000_000
#: Bytes of text, and of numbers of words (4 each), that a task works on at once, whatever the batches that Spark sends.
TEXT = 1 << 23
PIECE = 1 << 20
#: Contexts that a task gathers before it sends them on, and those of a word in one row.
GATHER = 1 << 20
CHUNK = 64
#: Numbers in each array of ``best_classes``.
BLOCK = 1 << 20
#: Mark of a word in a class sequence whose class is joined later; classes are numbered below it.
AWAY = 255


def pieces(batch: pa.RecordBatch, column: str, size: int):
    """The rows of a batch in runs that hold about ``size`` bytes in a column; a longer text is a run of its own."""
    ends = np.cumsum(pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False), dtype=np.int64)
    cuts = [0, *(np.flatnonzero(np.diff(ends // size)) + 1).tolist(), batch.num_rows]
    for a, z in zip(cuts, cuts[1:]):
        if a < z:
            yield batch.slice(a, z - a)


def words_of(texts: pa.Array) -> tuple[pa.Array, np.ndarray, np.ndarray]:
    """The different words of texts, the number there of each word, and where texts end; every text ends with ``END``."""
    lists = pc.ascii_split_whitespace(pc.ascii_lower(pc.fill_null(texts, "")))
    coded = lists.flatten().dictionary_encode()
    words, at = coded.dictionary.cast(pa.binary()), coded.indices.to_numpy()
    text = np.repeat(np.arange(len(texts)), np.diff(lists.offsets.to_numpy()))
    empty = words.index(b"").as_py()
    if empty >= 0:
        keep = at != empty
        at, text = at[keep], text[keep]
    ends = np.cumsum(np.bincount(text, minlength=len(texts)) + 1)
    out = np.full(ends[-1], len(words), np.int32)
    inside = np.ones(len(out), bool)
    inside[ends - 1] = False
    out[inside] = at
    return pa.concat_arrays([words, pa.array([END], pa.binary())]), out, ends


def ending(word: bytes) -> bytes:
    """The last two characters before closing punctuation and the first closing mark; ``#`` if there is a digit."""
    if not DIGITS.isdisjoint(word):
        return b"#"
    core = word.rstrip(PUNCTUATION)
    return core.decode("utf-8", "replace")[-2:].encode() + b" " + word[len(core) : len(core) + 1]


def count_words(docs: DataFrame) -> DataFrame:
    """``(word, c)`` of all texts; tasks add up before they shuffle."""

    def rows(found):
        words = pa.concat_arrays([w for w, _ in found]).dictionary_encode()
        n = np.bincount(words.indices.to_numpy(), np.concatenate([n for _, n in found])).astype(np.int64)
        return pa.RecordBatch.from_arrays([words.dictionary, pa.array(n)], names=["word", "c"])

    def run(batches):
        found, held = [], 0
        for piece in (piece for batch in batches for piece in pieces(batch, "text", TEXT)):
            words, at, _ = words_of(piece.column("text"))
            n = np.bincount(at, minlength=len(words))
            there = np.flatnonzero(n)
            found.append((words.take(pa.array(there)), n[there]))
            held += len(there)
            if held > FLUSH:
                yield rows(found)
                found, held = [], 0
        if found:
            yield rows(found)

    return docs.select("text").mapInArrow(run, "word binary, c long").groupBy("word").agg(F.sum("c").alias("c"))


class Lexicon:
    """Unit and count of words: those that were sent along by look-up, others by their ending."""

    def __init__(self, words: list[bytes], counts: np.ndarray, frequent: int, endings: list[bytes]):
        self.words, self.counts, self.frequent, self.endings = words, counts, frequent, endings

    def __getstate__(self):
        return {k: v for k, v in self.__dict__.items() if k != "index"}

    def ready(self) -> "Lexicon":
        """Look-ups, made once: units travel with the words, the index is built by each worker."""
        if hasattr(self, "unit"):
            if not hasattr(self, "index"):
                self.index = {w: k for k, w in enumerate(self.words)}
            return self
        own = min(self.frequent, len(self.words))
        self.by_ending = {e: own + k for k, e in enumerate(self.endings)}
        self.other = own + len(self.endings)
        self.units = self.other + 1
        self.index = {w: k for k, w in enumerate(self.words)}
        self.unit = np.array([k if k < own else self.unit_of(w) for k, w in enumerate(self.words)], np.int64)
        return self

    def unit_of(self, word: bytes) -> int:
        """Unit of a word that is not frequent."""
        return self.by_ending.get(ending(word), self.other)

    def read(self, texts: pa.Array) -> list[pa.Array]:
        """For each text: its words' numbers, and its different words that weren't sent along with their units; the first of these has number -1, the next -2."""
        words, at, ends = words_of(texts)
        values = words.to_pylist()
        numbers = np.fromiter(map(self.index.get, values, repeat(-1)), np.int32, len(values))[at]
        away = np.flatnonzero(numbers < 0)
        text = np.searchsorted(ends, away, "right")
        name, slot = np.unique(text * len(values) + at[away], return_inverse=True)
        starts = np.searchsorted(name, np.arange(len(ends) + 1) * len(values))
        numbers[away] = starts[text] - slot - 1
        name, unit = name % len(values), np.zeros(len(values), np.int32)
        for k in np.unique(name).tolist():
            unit[k] = self.unit_of(values[k])
        offsets = pa.array(starts.astype(np.int32))
        bounds = np.concatenate([[0], ends * 4]).astype(np.int32)
        return [
            pa.Array.from_buffers(pa.binary(), len(ends), [None, pa.py_buffer(bounds), pa.py_buffer(numbers)]),
            pa.ListArray.from_arrays(offsets, words.take(pa.array(name))), pa.ListArray.from_arrays(offsets, pa.array(unit[name])),
        ]


ENCODED = "uid long, doc_id long, held_out boolean, at binary, rare array<binary>, units array<int>"


def encode_texts(docs: DataFrame, lexicon) -> DataFrame:
    """Each text as numbers of its words (``Lexicon.read``), which all later passes read."""

    def run(batches):
        lex, uid = lexicon.value.ready(), TaskContext.get().partitionId() << 40
        for piece in (piece for batch in batches for piece in pieces(batch, "text", TEXT)):
            columns = [pa.array(np.arange(uid, uid + piece.num_rows)), piece.column("doc_id"), piece.column("held_out"), *lex.read(piece.column("text"))]
            uid += piece.num_rows
            yield pa.RecordBatch.from_arrays(columns, names=[c.split()[0] for c in ENCODED.split(", ")])

    return docs.select("doc_id", "held_out", "text").mapInArrow(run, ENCODED)


class Texts:
    """The words of a batch of encoded texts, one after another."""

    def __init__(self, batch: pa.RecordBatch, unit: np.ndarray):
        data, rare = batch.column("at").to_pylist(), batch.column("rare")
        self.ends = np.cumsum(np.fromiter(map(len, data), np.int64, len(data)) // 4)
        self.starts = np.concatenate([[0], self.ends[:-1]])
        self.at = np.frombuffer(b"".join(data), np.int32)
        #: Which words weren't sent along, and where those are among ``names``, the different ones of each text.
        self.away = np.flatnonzero(self.at < 0)
        self.slots = -1 - self.at[self.away]
        self.names, offsets = rare.flatten(), rare.offsets.to_numpy().astype(np.int64)
        self.name = offsets[np.searchsorted(self.ends, self.away, "right")] - offsets[0] + self.slots
        self.units = batch.column("units").flatten().to_numpy()
        self.unit = unit[np.maximum(self.at, 0)] if len(unit) else np.zeros(len(self.at), np.int64)
        self.unit[self.away] = self.units[self.name]

    def before(self, x: np.ndarray) -> np.ndarray:
        """Of each word, the value of the one before it; texts are rings."""
        out = np.roll(x, 1)
        out[self.starts] = x[self.ends - 1]
        return out

    def after(self, x: np.ndarray) -> np.ndarray:
        out = np.roll(x, -1)
        out[self.ends - 1] = x[self.starts]
        return out


def count_bigrams(encoded: DataFrame, lexicon) -> DataFrame:
    """``(pair, n)`` with pair = unit before * units + unit."""

    def run(batches):
        lex = lexicon.value
        for batch in batches:
            found = []
            for piece in pieces(batch, "at", PIECE):
                texts = Texts(piece, lex.unit)
                found.append(np.unique(texts.before(texts.unit) * lex.units + texts.unit, return_counts=True))
            if found:
                pair, at = np.unique(np.concatenate([p for p, _ in found]), return_inverse=True)
                n = np.bincount(at, np.concatenate([n for _, n in found])).astype(np.int64)
                yield pa.RecordBatch.from_arrays([pa.array(pair), pa.array(n)], names=["pair", "n"])

    return encoded.select("at", "rare", "units").mapInArrow(run, "pair long, n long").groupBy("pair").agg(F.sum("n").alias("n"))


def _xlogx(x: np.ndarray) -> np.ndarray:
    return x * np.log(np.maximum(x, 1e-12))


def exchange(bigrams: np.ndarray, classes: int, sweeps: int = 8) -> np.ndarray:
    """A class for each unit by the exchange algorithm; ``bigrams[a, b]`` counts b after a."""
    total = bigrams.sum(0) + bigrams.sum(1)
    order = np.argsort(-total, kind="stable")
    member = np.empty(len(total), np.int64)
    member[order] = np.arange(len(total)) % classes
    hot = np.eye(classes)[member]
    m = hot.T @ bigrams @ hot
    for _ in range(sweeps):
        moved = 0
        for w in order.tolist():
            if not total[w]:
                continue
            out = np.bincount(member, bigrams[w], classes)
            into = np.bincount(member, bigrams[:, w], classes)
            own, k = bigrams[w, w], member[w]
            out[k] -= own
            into[k] -= own
            m[k] -= out
            m[:, k] -= into
            m[k, k] -= own
            rows, columns = m.sum(1), m.sum(0)
            gain = (_xlogx(m + out) - _xlogx(m)).sum(1) + (_xlogx(m + into[:, None]) - _xlogx(m)).sum(0)
            d = np.diagonal(m)
            gain += _xlogx(d + out + into + own) + _xlogx(d) - _xlogx(d + out) - _xlogx(d + into)
            gain -= _xlogx(rows + out.sum() + own) - _xlogx(rows) + _xlogx(columns + into.sum() + own) - _xlogx(columns)
            best = int(gain.argmax())
            if gain[best] <= gain[k] + 1e-9:
                best = int(k)
            member[w] = best
            moved += best != k
            m[best] += out
            m[:, best] += into
            m[best, best] += own
        if not moved:
            break
    return member


def count_contexts(encoded: DataFrame, lexicon, member: np.ndarray, classes: int) -> DataFrame:
    """``(at, word, contexts)`` of words that aren't units of their own and are there twice or more: how often which classes stand around each.

    at: index among the words sent along; -1 with ``word``. A context is n, class before and class after in one number. A
    word has several rows, of at most ``CHUNK`` contexts each and one after another; what its rows share is to be added up.
    """
    pairs = classes * classes

    def run(batches):
        lex = lexicon.value
        own, sent = min(lex.frequent, len(lex.words)), len(lex.words)

        def rows(found, names):
            key, same = np.unique(np.concatenate([k for k, _ in found]), return_inverse=True)
            n = np.bincount(same, np.concatenate([n for _, n in found])).astype(np.int64)
            who = key // pairs
            start = np.flatnonzero(np.concatenate([[True], who[1:] != who[:-1]]))
            place = np.arange(len(key)) - np.repeat(start, np.diff(np.append(start, len(key))))
            first = np.flatnonzero(place % CHUNK == 0)
            who = who[first]
            known = who < sent
            columns = [
                pa.array(np.where(known, who, -1).astype(np.int32)), names.take(pa.array(who - sent, mask=known)),
                pa.ListArray.from_arrays(pa.array(np.append(first, len(key)).astype(np.int32)), pa.array(n * pairs + key % pairs)), pa.array(np.add.reduceat(n, first)),
            ]
            return pa.RecordBatch.from_arrays(columns, names=["at", "word", "contexts", "n"])

        for batch in batches:
            names = batch.column("rare").flatten().dictionary_encode()
            index, at, found, held = names.indices.to_numpy(), 0, [], 0
            for piece in pieces(batch, "at", PIECE):
                texts = Texts(piece, lex.unit)
                cls, who = member[texts.unit], texts.at.astype(np.int64)
                who[texts.away] = sent + index[at + texts.name]
                at += len(texts.names)
                key = (who * pairs + texts.before(cls) * classes + texts.after(cls))[who >= own]
                if len(key):
                    found.append(np.unique(key, return_counts=True))
                    held += len(found[-1][0])
                if held > GATHER:
                    yield rows(found, names.dictionary)
                    found, held = [], 0
            if found:
                yield rows(found, names.dictionary)

    found = encoded.select("at", "rare", "units").mapInArrow(run, "at int, word binary, contexts array<long>, n long").repartition("at", "word")
    found = found.withColumn("_hash", F.xxhash64("at", "word"))
    found = found.withColumn("_all", F.sum("n").over(Window.partitionBy("_hash", "at", "word")))
    return found.where("_all >= 2").select("at", "word", "contexts")


def best_classes(contexts: DataFrame, lexicon, member: np.ndarray, seed: np.ndarray) -> DataFrame:
    """``(at, word, cls)``: the class of greatest gain for each word.

    ``seed[a, b]`` counts class b after class a. All words move at once, each against the seed. The rows of a word
    (``count_contexts``) are added up by class before and by class after, so that no array grows with how often words are used.
    """
    k = len(seed)
    forth, back = seed.astype(np.float64), np.ascontiguousarray(seed.T, np.float64)

    def side(m, own, table):
        """What joining each class gains each word; ``table[word, class]`` counts its neighbours of one side."""
        word, cls = np.nonzero(table)
        n = table[word, cls]
        now = m.T[cls]
        more = now + n[:, None]
        gain = more * np.log(more) - _xlogx(now)
        rows, mine = np.arange(len(n)), own[word]
        now = m[mine, cls]
        gain[rows, mine] = _xlogx(now) - _xlogx(np.maximum(now - n, 0))
        start = np.flatnonzero(np.concatenate([[True], word[1:] != word[:-1]]))
        gain, total, sums = np.add.reduceat(gain, start), table.sum(1), m.sum(1)
        whole = _xlogx(sums + total[:, None]) - _xlogx(sums)
        whole[np.arange(len(own)), own] = _xlogx(sums[own]) - _xlogx(np.maximum(sums[own] - total, 0))
        return gain - whole

    def whole_words(batches):
        """Words of a batch, and how often each class comes before and after them; the last one waits for rows of the next batch."""
        last, sums = None, np.zeros((2, k))
        for batch in batches:
            if not batch.num_rows:
                continue
            lists, at, names = batch.column("contexts"), batch.column("at").to_pylist(), batch.column("word").to_pylist()
            flat = lists.flatten().to_numpy()
            keys = list(zip(at, names))
            new = np.array([a != b for a, b in zip(keys, [last, *keys])])
            keys = [last, *(keys[i] for i in np.flatnonzero(new))]
            word = np.repeat(np.cumsum(new), np.diff(lists.offsets.to_numpy())) * k
            n, code = flat // (k * k), flat % (k * k)
            tables = np.stack([np.bincount(word + c, n, len(keys) * k).reshape(-1, k) for c in (code // k, code % k)])
            tables[:, 0] += sums
            skip = int(last is None)
            last, sums = keys[-1], tables[:, -1].copy()
            yield keys[skip:-1], tables[:, skip:-1]
        if last is not None:
            yield [last], sums[:, None]

    def run(batches):
        lex = lexicon.value
        for keys, (before, after) in whole_words(batches):
            own = np.array([member[lex.unit[a] if a >= 0 else lex.unit_of(w)] for a, w in keys], np.int64)
            out = own.copy()
            block = np.cumsum(np.maximum(np.count_nonzero(before, 1), np.count_nonzero(after, 1))) * k // BLOCK
            cuts = [0, *(np.flatnonzero(np.diff(block)) + 1).tolist(), len(keys)]
            for a, z in zip(cuts, cuts[1:]):
                if a < z:
                    gain = side(forth, own[a:z], after[a:z]) + side(back, own[a:z], before[a:z])
                    best, rows = gain.argmax(1), np.arange(z - a)
                    out[a:z] = np.where(gain[rows, best] > gain[rows, own[a:z]] + 1e-3, best, own[a:z])
            moved = np.flatnonzero(out != own)
            columns = [pa.array([keys[i][0] for i in moved], pa.int32()), pa.array([keys[i][1] for i in moved], pa.binary()), pa.array(out[moved].astype(np.int32))]
            yield pa.RecordBatch.from_arrays(columns, names=["at", "word", "cls"])

    return contexts.mapInArrow(run, "at int, word binary, cls int")


def transitions(m: np.ndarray) -> np.ndarray:
    """log10 p(class b | class a) from counts ``m[a, b]``."""
    before, kinds = m.sum(1, keepdims=True), np.maximum((m > 0).sum(1, keepdims=True), 1)
    share = (m.sum(0) + 1) / (m.sum() + len(m))
    return np.log10((m + kinds * share) / (before + kinds))


class Emissions:
    """log10 p(word | class), in parts: ``stats[class]`` has words, their tokens, words seen once, words seen twice."""

    def __init__(self, classes: int, stats: dict):
        self.discount, self.log_total, self.unknown = np.full(classes, 0.5), np.zeros(classes), np.zeros(classes)
        for k, (words, tokens, once, twice) in stats.items():
            d = self.discount[k] = min(max(once / max(once + 2 * twice, 1), 0.05), 0.95)
            self.log_total[k] = np.log10(tokens)
            self.unknown[k] = np.log10(d * words / tokens)


def train(docs: DataFrame, scratch: Scratch, frequent: int, endings: int, classes: int, broadcast_words: int, sweeps: int):
    """``(encoded texts, rare words with count and class, N, V, broadcast lexicon, classes of its words, classes of units, class sizes)``."""
    sc, every = docs.sparkSession.sparkContext, docs
    docs = docs.where("not held_out")
    vocabulary = scratch.put(count_words(docs))
    size = vocabulary.agg(F.sum("c").alias("n"), F.count("*").alias("v")).first()
    top = most_frequent(vocabulary, "c", broadcast_words).toArrow().sort_by([("c", "descending"), ("word", "ascending")])
    words, counts = top["word"].to_pylist(), top["c"].to_numpy()
    del top

    def by_ending(batches):
        for pdf in batches:
            yield pd.DataFrame({"ending": [ending(bytes(w)) for w in pdf["word"]], "c": pdf["c"]}).groupby("ending", as_index=False).sum()

    ends = vocabulary.mapInPandas(by_ending, "ending binary, c long").groupBy("ending").agg(F.sum("c").alias("c"))
    ends = [bytes(r["ending"]) for r in ends.orderBy(F.desc("c"), "ending").limit(endings).collect()]
    lex = Lexicon(words, counts, frequent, ends).ready()
    lexicon = sc.broadcast(lex)

    encoded = scratch.put(encode_texts(every, lexicon))
    learned = encoded.where("not held_out")
    pairs = scratch.put(count_bigrams(learned, lexicon)).toArrow()
    bigrams = np.zeros(lex.units * lex.units, np.float32)
    bigrams[pairs["pair"].to_numpy()] = pairs["n"].to_numpy()
    bigrams = bigrams.reshape(lex.units, lex.units)
    member = exchange(bigrams, classes, sweeps)
    hot = np.eye(classes)[member]
    moved = scratch.put(best_classes(count_contexts(learned, lexicon, member, classes), lexicon, member, hot.T @ bigrams @ hot))

    cls = member[lex.unit] if len(lex.unit) else np.empty(0, np.int64)
    sent = moved.where("at >= 0").select("at", "cls").toArrow()
    cls[sent["at"].to_numpy()] = sent["cls"].to_numpy()

    def rare_words(batches):
        lex = lexicon.value.ready()
        for pdf in batches:
            pdf = pdf[[bytes(w) not in lex.index for w in pdf["word"]]]
            yield pdf.assign(own=[int(member[lex.unit_of(bytes(w))]) for w in pdf["word"]])

    step = moved.where("at < 0").select(F.col("word").alias("_word"), "cls")
    rare = vocabulary.mapInPandas(rare_words, "word binary, c long, own int")
    rare = scratch.put(rare.join(step, F.col("word") == F.col("_word"), "left").select("word", "c", F.coalesce("cls", "own").alias("cls")))
    stats = rare.groupBy("cls").agg(F.count("*").alias("words"), F.sum("c").alias("tokens"), F.count_if(F.col("c") == 1).alias("once"), F.count_if(F.col("c") == 2).alias("twice"))
    stats = {r["cls"]: np.array(tuple(r)[1:], np.int64) for r in stats.collect()}
    for k in np.unique(cls).tolist():
        c = counts[cls == k]
        stats[k] = stats.get(k, 0) + np.array([len(c), c.sum(), (c == 1).sum(), (c == 2).sum()])
    scratch.drop(vocabulary)
    scratch.drop(moved)
    return encoded, rare, size["n"] or 0, size["v"], lexicon, cls, member, stats


READ = "uid long, doc_id long, held_out boolean, seq binary, known long, base double, emission double, rare array<binary>, slots array<int>, own array<int>"
DONE = "doc_id long, held_out boolean, seq binary, known long, base double, emission double"


def _read(encoded: DataFrame, lexicon, cls: np.ndarray, member: np.ndarray, out_of: Emissions, n: int, v: int) -> DataFrame:
    """Each text's classes and sums over the words sent along; ``rare``: its other words, ``slots``: which of them where."""

    def run(batches):
        lex = lexicon.value
        base_of = np.append(np.log10((lex.counts + 1) / (n + v + 1)), 0.0)
        emit = np.append(np.log10(np.maximum(lex.counts - out_of.discount[cls], 1e-9)) - out_of.log_total[cls], 0.0)
        kind = np.append(cls, AWAY).astype(np.uint8)
        for batch in (piece for batch in batches for piece in pieces(batch, "at", PIECE)):
            texts, rare = Texts(batch, lex.unit), batch.column("rare")
            at = np.maximum(texts.at, -1)
            seq = kind[at].tobytes()
            edges = np.concatenate([[0], np.cumsum(np.bincount(np.searchsorted(texts.ends, texts.away, "right"), minlength=batch.num_rows))])
            columns = [
                *(batch.column(c) for c in ("uid", "doc_id", "held_out")),
                pa.array([seq[a:z] for a, z in zip(texts.starts.tolist(), texts.ends.tolist())], pa.binary()),
                pa.array(np.add.reduceat((at >= 0).astype(np.int64), texts.starts)),
                pa.array(np.add.reduceat(base_of[at], texts.starts)), pa.array(np.add.reduceat(emit[at], texts.starts)), rare,
                pa.ListArray.from_arrays(pa.array(edges.astype(np.int32)), pa.array(texts.slots.astype(np.int32))),
                pa.ListArray.from_arrays(pa.array(rare.offsets.to_numpy() - rare.offsets[0].as_py()), pa.array(member[texts.units].astype(np.int32))),
            ]
            yield pa.RecordBatch.from_arrays(columns, names=[c.split()[0] for c in READ.split(", ")])

    return encoded.mapInArrow(run, READ)


def _complete(read: DataFrame, rare: DataFrame, out_of: Emissions, n: int, v: int) -> DataFrame:
    """The texts with counts and classes of their rare words joined in."""
    words = read.where("size(rare) > 0").select("uid", F.posexplode("rare").alias("k", "_rare"), "own").select("uid", "k", "_rare", F.col("own")[F.col("k")].alias("own"))
    found = words.join(rare, F.col("_rare") == F.col("word"), "left")
    slot = F.struct("k", F.coalesce("c", F.lit(0)).alias("c"), F.coalesce("cls", "own").alias("cls"))
    found = found.groupBy("uid").agg(F.array_sort(F.collect_list(slot)).alias("w")).select("uid", F.col("w.c").alias("c"), F.col("w.cls").alias("cls"))

    def run(batches):
        for pdf in batches:
            seqs, known, base, emission = [], pdf["known"].to_numpy().copy(), pdf["base"].to_numpy().copy(), pdf["emission"].to_numpy().copy()
            for i, (seq, slots, c, cls) in enumerate(zip(pdf["seq"], pdf["slots"], pdf["c"], pdf["cls"])):
                if len(slots):
                    c, kind, slots = np.asarray(c, np.int64), np.asarray(cls, np.int64), np.asarray(slots)
                    log = np.where(c > 0, np.log10(np.maximum(c - out_of.discount[kind], 1e-9)) - out_of.log_total[kind], out_of.unknown[kind])
                    seq = np.frombuffer(seq, np.uint8).copy()
                    seq[seq == AWAY] = kind[slots]
                    seq = seq.tobytes()
                    known[i] += int((c > 0)[slots].sum())
                    base[i] += np.log10((c + 1) / (n + v + 1))[slots].sum()
                    emission[i] += log[slots].sum()
                seqs.append(seq)
            yield pd.DataFrame({"doc_id": pdf["doc_id"].astype("Int64"), "held_out": pdf["held_out"], "seq": seqs, "known": known, "base": base, "emission": emission})

    both = read.drop("rare", "own").join(found, "uid", "left")
    return both.select("doc_id", "held_out", "seq", "known", "base", "emission", "slots", "c", "cls").mapInPandas(run, DONE)


def _pairs(seq: bytes, classes: int) -> np.ndarray:
    """Class before and class of each token, in one number."""
    cls = np.frombuffer(seq, np.uint8).astype(np.int64)
    return np.concatenate([cls[-1:], cls[:-1]]) * classes + cls


def class_bigrams(done: DataFrame, classes: int) -> np.ndarray:
    """Counts of class b after class a over the training texts."""

    def run(batches):
        total = np.zeros(classes * classes, np.int64)
        for pdf in batches:
            for seq in pdf["seq"]:
                total += np.bincount(_pairs(seq, classes), minlength=classes * classes)
        yield pd.DataFrame({"pair": np.flatnonzero(total), "n": total[total > 0]})

    found = done.where("not held_out").select("seq").mapInPandas(run, "pair long, n long").groupBy("pair").agg(F.sum("n").alias("n")).toArrow()
    m = np.zeros(classes * classes)
    m[found["pair"].to_numpy()] = found["n"].to_numpy()
    return m.reshape(classes, classes)


RESULT = "doc_id long, held_out boolean, n_tokens long, n_known long, base_score double, score double"


def score_documents(
    docs: DataFrame, parts: int = 7, held: int = 2, frequent: int = 2000, endings: int = 500, classes: int = 64, broadcast_words: int = 300_000, sweeps: int = 8
) -> DataFrame:
    """``(doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score)``."""
    if not 1 <= classes < AWAY:
        raise ValueError(f"classes must be from 1 to {AWAY - 1}")
    scratch = Scratch(docs.sparkSession)
    held_out = F.coalesce(fold(F.col("doc_id"), parts) == held, F.lit(False))
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), held_out.alias("held_out"), "text")
    encoded, rare, n, v, lexicon, cls, member, stats = train(docs, scratch, frequent, endings, classes, broadcast_words, sweeps)
    out_of = Emissions(classes, stats)
    read = scratch.put(_read(encoded, lexicon, cls, member, out_of, n, v))
    scratch.drop(encoded)
    done = scratch.put(_complete(read, rare, out_of, n, v))
    scratch.drop(read)
    scratch.drop(rare)
    transition = transitions(class_bigrams(done, classes)).ravel()

    def run(batches):
        for pdf in batches:
            moves = np.array([transition[_pairs(seq, classes)].sum() for seq in pdf["seq"]], np.float64)
            size = np.array([len(seq) for seq in pdf["seq"]], np.int64)
            yield pd.DataFrame({"doc_id": pdf["doc_id"].astype("Int64"), "held_out": pdf["held_out"], "n_tokens": size, "n_known": pdf["known"], "base_score": pdf["base"], "score": pdf["emission"] + moves})

    scored = done.mapInPandas(run, RESULT)
    return scored.select("doc_id", "held_out", "n_tokens", "n_known", F.lit(n).cast("long").alias("train_tokens"), "base_score", "score")
