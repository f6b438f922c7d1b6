"""Exact Jaccard join of word-shingle sets as a metric-space join, and the groups that its links make.

1. Documents with equal sets are one class. Every class orders its shingles in one global order (those frequent in a
   sample last, then by hash) and keeps a prefix, long enough that linked classes share at least ``need`` shingles of
   it. Classes with fewer shared prefix shingles than that cannot link and are done. Shingles of at most ``FEW``
   classes are regions small enough to be joined as they are, by the number of shingles that two classes share.
2. Pivots: each other prefix shingle elects one of its classes, and the distance of its other classes to that pivot is
   measured exactly. Those within ``NEAR`` make up the pivot's region. By the triangle inequality a class beyond
   can only link with classes farther than ``NEAR`` less the threshold; these boundary classes are replicated to the
   remainder of the shingle, which elects a pivot again, recursively, ``rounds`` times.
3. A region is joined exactly from its members' differences to the pivot. Members lie in shells one threshold wide
   by their distance; only members of one shell or of neighbouring ones can link, and the innermost, who all link with
   the pivot, need not meet each other. Shells are cut into blocks of bounded size, and each pair of blocks is one
   product of bit matrices that returns a spanning forest of its links, not its pairs.
4. What no region has taken in meets by shared prefix shingles, ``need`` of them at least.

Shingles are 64-bit hashes.

Defined cases: null text, or one without words, has 0 shingles, links with nothing and is its own component; fewer
than ``words`` words make one shingle of the whole sequence; rows that share an id are separate texts; a null id
is never a component's smallest id (a component of such rows alone is null); extra columns are ignored; an empty
table gives an empty result.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from latticework.llm.common import encode, mix, most_frequent
from latticework.operators.components import connected_components
from latticework.storage import Scratch

CACHE = 400_000
#: A sampled document share and the sample count from which a shingle is frequent; at most so many are kept.
SAMPLE, FREQUENT, MOST_FREQUENT = 64, 3, 1_000_000
BROADCAST_IDS = 1_000_000
#: Jaccard distance up to which a class belongs to a pivot's region.
NEAR = 0.5
#: Classes that share a shingle up to which they meet directly, without pivots.
FEW = 8
#: Parts that a region's members are dealt to when they learn its block counts.
SALTS = 32


class Shingler:
    """Sorted distinct shingle hashes of texts; word hashes are kept while a task runs."""

    def __init__(self, words: int):
        self.k, self.known = words, {}

    def __call__(self, text) -> np.ndarray:
        words = encode(text).lower().split()
        if not words:
            return np.empty(0, np.uint64)
        if len(self.known) > CACHE:
            self.known = {}
        known, hashed = self.known, xxhash.xxh3_64_intdigest
        h = np.empty(len(words), np.uint64)
        try:
            h[:] = [known[w] for w in words]
        except KeyError:
            for w in set(words).difference(known):
                known[w] = hashed(w)
            h[:] = [known[w] for w in words]
        k = min(self.k, len(words))
        n = len(words) - k + 1
        out = np.full(n, k, np.uint64)
        for j in range(k):
            out = mix(out * np.uint64(0x9E3779B97F4A7C15) + h[j : j + n])
        return np.unique(out)


def _fingerprint(shingles: np.ndarray) -> int:
    return xxhash.xxh3_64_intdigest(shingles.tobytes()) - (1 << 63)


def _need(n: np.ndarray | int):
    """Prefix shingles that linked classes share at least; does not fall with n.

    With sizes y <= x and a similarity p of 0.03 or more, two linked classes have ceil(p x) shingles in common at least, so
    the prefixes (n - ceil(p n) + need(n) long) share need(x) on the one side and need(y) + ceil(p x) - ceil(p y) on the
    other, which is floor(0.03 x) or more on both. At most half of need(y) may be in small groups without the direct
    join finding the pair, so large groups hold more than 0.012 x of them.
    """
    return 1 + (n * 3) // 100


def _frequent(docs: DataFrame, words: int) -> np.ndarray:
    """Shingles frequent in a sample of the documents; they only change the order of prefixes, never a result."""

    def shingles(batches):
        of = Shingler(words)
        for pdf in batches:
            sets = {_fingerprint(s): s for s in map(of, pdf["text"]) if len(s)}
            yield pd.DataFrame({"fp": np.array(list(sets), np.int64), "s": [s.view(np.int64) for s in sets.values()]})

    sample = docs.where(F.pmod(F.xxhash64("doc_id", F.lit("order")), F.lit(SAMPLE)) == 0).select("text")
    sets = sample.mapInPandas(shingles, "fp long, s array<long>").dropDuplicates(["fp"])
    often = sets.select(F.explode("s").alias("s")).groupBy("s").count().where(F.col("count") >= FREQUENT)
    top = most_frequent(often, "count", MOST_FREQUENT).select("s").toArrow()
    return np.sort(top["s"].to_numpy().view(np.uint64))


def _prefixes(docs: DataFrame, words: int, percent: int, frequent: np.ndarray) -> DataFrame:
    """``(doc_id, n, fp, prefix)`` of every document."""

    def run(batches):
        of = Shingler(words)
        for pdf in batches:
            n, fp, prefix = [], [], []
            for s in map(of, pdf["text"]):
                n.append(len(s))
                fp.append(_fingerprint(s))
                keep = len(s) - -(-percent * len(s) // 100) + _need(len(s)) if len(s) else 0
                if len(frequent) and len(s):
                    at = np.minimum(np.searchsorted(frequent, s), len(frequent) - 1)
                    late = frequent[at] == s
                    s = np.concatenate([s[~late], s[late]])
                prefix.append(s[:keep].view(np.int64))
            yield pd.DataFrame({"doc_id": pdf["doc_id"], "n": np.array(n, np.int64), "fp": np.array(fp, np.int64), "prefix": prefix})

    return docs.select("doc_id", "text").mapInPandas(run, "doc_id long, n long, fp long, prefix array<long>")


def _sets(docs: DataFrame, wanted: DataFrame, words: int) -> DataFrame:
    """``(fp, set)`` of the classes ``wanted(fp, rep)``, computed again from their first document.

    Ids are broadcast up to ``BROADCAST_IDS`` of them; beyond it the texts are shuffled to them.
    """

    def run(batches):
        of = Shingler(words)
        for pdf in batches:
            sets = {_fingerprint(s): s for s in map(of, pdf["text"]) if len(s)}
            yield pd.DataFrame({"fp": np.array(list(sets), np.int64), "set": [s.tobytes() for s in sets.values()]})

    ids = wanted.select(F.col("rep").alias("doc_id")).distinct()
    ids = F.broadcast(ids) if wanted.count() <= BROADCAST_IDS else ids
    again = docs.join(ids, "doc_id", "left_semi").select("text").mapInPandas(run, "fp long, set binary")
    return again.groupBy("fp").agg(F.first("set").alias("set"))


def _measure(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """``(x, y, nx, ny, both)`` and, where x is near y, what x has of y as bits and what it has besides."""

    def run(batches):
        for pdf in batches:
            nx, ny, both, bits, extra = [], [], [], [], []
            for a, b in zip(pdf["sx"], pdf["sy"]):
                a, b = np.frombuffer(a, np.uint64), np.frombuffer(b, np.uint64)
                at = np.minimum(np.searchsorted(b, a), len(b) - 1)
                shared = b[at] == a
                n = int(shared.sum())
                near = n >= (1 - NEAR) * (len(a) + len(b) - n)
                if near:
                    has = np.zeros(len(b), bool)
                    has[at[shared]] = True
                nx.append(len(a))
                ny.append(len(b))
                both.append(n)
                bits.append(np.packbits(has).tobytes() if near else None)
                extra.append(a[~shared].tobytes() if near else None)
            yield pd.DataFrame({"x": pdf["x"], "y": pdf["y"], "nx": nx, "ny": ny, "both": both, "bits": bits, "extra": extra})

    left = sets.select(F.col("fp").alias("x"), F.col("set").alias("sx"))
    right = sets.select(F.col("fp").alias("y"), F.col("set").alias("sy"))
    schema = "x long, y long, nx long, ny long, both long, bits binary, extra binary"
    return pairs.select("x", "y").join(left, "x").join(right, "y").mapInPandas(run, schema)


def _forest(rows: np.ndarray, columns: np.ndarray) -> list[int]:
    """Positions of pairs that already connect all that the pairs connect."""
    root: dict[int, int] = {}
    out = []
    for k, (a, b) in enumerate(zip(rows.tolist(), columns.tolist())):
        while (up := root.get(a, a)) != a:
            root[a] = root.get(up, up)
            a = up
        while (up := root.get(b, b)) != b:
            root[b] = root.get(up, up)
            b = up
        if a != b:
            root[a] = b
            out.append(k)
    return out


def _join_blocks(blocks: DataFrame, percent: int) -> DataFrame:
    """Links between the blocks ``i`` and ``j`` (or within one) of each region; whole pairs of blocks come together."""

    def links(part: pd.DataFrame) -> tuple[np.ndarray, np.ndarray]:
        i, j, block = part["i"].iat[0], part["j"].iat[0], part["block"].to_numpy()
        left, right = np.flatnonzero(block == i), np.flatnonzero(block == j)
        if not len(left) or not len(right):
            return np.empty(0, np.int64), np.empty(0, np.int64)
        n = part["nx"].to_numpy()
        own = np.unpackbits(np.stack([np.frombuffer(x, np.uint8) for x in part["bits"]]), axis=1).astype(np.float32)
        both = own[left] @ own[right].T
        extra = [np.frombuffer(x, np.uint64) for x in part["extra"]]
        who = np.repeat(np.arange(len(extra)), [len(x) for x in extra])
        values, code, count = np.unique(np.concatenate(extra), return_inverse=True, return_counts=True)
        often = np.flatnonzero(count > 1)
        for at in range(0, len(often), 4096):
            column = np.full(len(values), -1)
            column[often[at : at + 4096]] = np.arange(len(often[at : at + 4096]))
            keep = column[code] >= 0
            m = np.zeros((len(extra), len(often[at : at + 4096])), np.float32)
            m[who[keep], column[code[keep]]] = 1
            both += m[left] @ m[right].T
        found = 100 * both >= percent * (n[left][:, None] + n[right][None, :] - both)
        a, b = np.nonzero(found)
        a, b = left[a], right[b]
        keep = np.flatnonzero(a < b) if i == j else np.arange(len(a))
        keep = keep[_forest(a[keep], b[keep])]
        fp = part["x"].to_numpy()
        return fp[a[keep]], fp[b[keep]]

    key = ["y", "i", "j"]

    def run(batches):
        held = None
        for pdf in batches:
            held = pdf if held is None else pd.concat([held, pdf], ignore_index=True)
            change = np.flatnonzero((held[key].to_numpy()[1:] != held[key].to_numpy()[:-1]).any(1)) + 1
            if len(change):
                xs, ys = zip(*[links(held.iloc[a:b]) for a, b in zip([0, *change[:-1]], change)])
                yield pd.DataFrame({"x": np.concatenate(xs), "y": np.concatenate(ys)})
                held = held.iloc[change[-1] :]
        if held is not None and len(held):
            x, y = links(held)
            yield pd.DataFrame({"x": x, "y": y})

    return blocks.repartition(*key).sortWithinPartitions(*key).mapInPandas(run, "x long, y long")


class Groups:
    """The join; ``docs`` has ``doc_id`` (long) and ``text``."""

    def __init__(self, docs: DataFrame, words: int = 4, percent: int = 85, rounds: int = 3, block: int = 256):
        self.docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
        if not 3 <= percent <= 100:
            raise ValueError("percent must be from 3 to 100: the bounds on shared prefixes don't hold below")
        self.words, self.percent, self.rounds, self.block = words, percent, rounds, block
        self.t = (100 - percent) / 100
        self.scratch = Scratch(docs.sparkSession)

    def _linked(self, measured: DataFrame) -> DataFrame:
        return measured.where(100 * F.col("both") >= self.percent * (F.col("nx") + F.col("ny") - F.col("both"))).select("x", "y")

    def _sharing(self, tokens: DataFrame, least: str) -> DataFrame:
        """Pairs ``(x, y)`` of ``tokens(token, fp, n)`` of fitting sizes with at least ``least`` shingles in common."""
        a = tokens.select("token", F.col("fp").alias("x"), F.col("n").alias("nx"))
        b = tokens.select("token", F.col("fp").alias("y"), F.col("n").alias("ny"))
        met = a.join(b, "token").where("x < y").where(100 * F.least("nx", "ny") >= self.percent * F.greatest("nx", "ny"))
        met = met.groupBy("x", "y").agg(F.count("*").alias("c"), (1 + F.expr("least(first(nx), first(ny)) * 3 div 100")).alias("need"))
        return met.where(f"c >= {least}").select("x", "y")

    def _region_links(self, measured: DataFrame) -> DataFrame:
        """Links among the members of each region; ``measured`` has their distances to the pivot y."""
        d = 1 - F.col("both") / (F.col("nx") + F.col("ny") - F.col("both"))
        linked = 100 * F.col("both") >= self.percent * (F.col("nx") + F.col("ny") - F.col("both"))
        shell = F.when(linked, 0).otherwise(F.greatest(F.lit(1), F.floor(d / self.t - 1e-9).cast("int")))
        near = measured.where("bits is not null").select("x", "y", "nx", "bits", "extra", shell.alias("shell"))
        count = near.groupBy("y", "shell").agg(F.ceil(F.count("*") / self.block).cast("int").alias("k"))
        shells = int(NEAR / self.t) + 2
        count = count.groupBy("y").agg(*[F.coalesce(F.max(F.when(F.col("shell") == s, F.col("k"))), F.lit(0)).alias(f"k{s}") for s in range(shells)])
        first = [" + ".join(["0", *[f"k{r}" for r in range(s)]]) for s in range(shells + 1)]  # first block of each shell
        pick = lambda f: "case shell " + " ".join(f"when {s} then {f(s)}" for s in range(shells)) + " end"
        # the innermost shell meets the next only, any other its neighbours and itself
        low = pick(lambda s: first[1] if s <= 0 else (first[s - 1]))
        high = pick(lambda s: first[min(s + 2, shells)])
        # the counts are a row a region: copied to every salt, so that the members of a large one meet them in many tasks
        count = count.where(" + ".join(f"k{s}" for s in range(1, shells)) + " > 0").withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
        salted = near.withColumn("salt", F.pmod(F.xxhash64("x", F.lit("salt")), F.lit(SALTS)).cast("int"))
        placed = salted.join(count, ["y", "salt"]).select(
            "x", "y", "nx", "bits", "extra",
            F.expr(f"({pick(lambda s: first[s])}) + pmod(xxhash64(x), greatest({pick(lambda s: f'k{s}')}, 1))").cast("int").alias("block"),
            F.expr(low).cast("int").alias("low"),
            F.expr(high).cast("int").alias("high"),
        )
        met = placed.where("low < high").withColumn("other", F.explode(F.expr("sequence(low, high - 1)")))
        blocks = met.select("x", "y", "nx", "bits", "extra", "block", F.least("block", "other").alias("i"), F.greatest("block", "other").alias("j"))
        return _join_blocks(blocks, self.percent)

    def links(self, classes: DataFrame) -> DataFrame:
        """Links that connect every pair of linked classes, directly or through others. ``classes(fp, n, rep, prefix)``."""
        put, drop = self.scratch.put, self.scratch.drop
        spread = classes.select("fp", F.explode("prefix").alias("token"))
        # a table of its own, so that a join on a frequent shingle can be split
        shared = put(spread.groupBy("token").agg(F.count("*").alias("k")).where("k > 1"))
        hits = spread.join(shared, "token").groupBy("fp").agg(
            F.collect_list(F.when(F.col("k") <= FEW, F.col("token"))).alias("few"), F.collect_list(F.when(F.col("k") > FEW, F.col("token"))).alias("many")
        )
        alive = hits.join(classes.select("fp", "n", "rep"), "fp").where("size(few) + size(many) >= greatest(1, n * 3 div 100)")
        alive = put(alive)
        drop(shared)
        sets = put(_sets(self.docs, alive.select("fp", "rep"), self.words))
        # of the shingles that a pair must share, half are in small groups, or more than half in large ones
        pairs = self._sharing(alive.select("fp", "n", F.explode("few").alias("token")), "(need + 1) div 2")
        close = put(self._linked(_measure(pairs, sets)))
        left = alive.where("size(many) > n * 12 div 1000").select("fp", "n", F.explode("many").alias("token"))
        links = [close]
        for turn in range(self.rounds):
            first = F.min(F.struct(F.xxhash64("fp", F.lit(turn)), "fp"))
            pivots = left.groupBy("token").agg(first["fp"].alias("pivot"), F.count("*").alias("k")).where("k > 1").drop("k")
            pivots = put(pivots)
            members = put(left.join(pivots, "token"))
            drop(pivots)
            pairs = members.where("fp <> pivot").select(F.col("fp").alias("x"), F.col("pivot").alias("y")).distinct()
            measured = put(_measure(pairs, sets))
            links += [put(self._linked(measured)), put(self._region_links(measured))]
            distance = measured.select(F.col("x").alias("fp"), F.col("y").alias("pivot"), (1 - F.col("both") / (F.col("nx") + F.col("ny") - F.col("both"))).alias("d"))
            distance = distance.where(F.col("d") > NEAR - self.t - 1e-9)
            far = members.where("fp <> pivot").join(distance, ["fp", "pivot"])
            left = put(far.select("token", "fp", "n"))
            drop(members)
            drop(measured)
        rest = self._sharing(left, "need div 2 + 1")
        links.append(put(self._linked(_measure(rest, sets))))
        out = links[0]
        for more in links[1:]:
            out = out.unionByName(more)
        return out

    def result(self) -> DataFrame:
        """``(doc_id, n_shingles, component_id)``, a row per row of the input."""
        put = self.scratch.put
        rows = put(_prefixes(self.docs, self.words, self.percent, _frequent(self.docs, self.words)))
        slim = put(rows.drop("prefix"))
        some = rows.where("n > 0")
        classes = put(some.groupBy("fp").agg(F.first("n").alias("n"), F.min("doc_id").alias("rep"), F.first("prefix").alias("prefix")))
        self.scratch.drop(rows)
        links = self.links(classes.where("rep is not null"))
        roots = put(connected_components(links.selectExpr("x as u", "y as v"), self.scratch)).withColumnRenamed("node", "fp")
        named = put(roots.join(classes.select("fp", "rep"), "fp"))
        least = put(named.groupBy("root").agg(F.min("rep").alias("component_id")))
        linked = put(named.join(least, "root").select("fp", "component_id"))
        known = put(classes.select("fp", "rep").join(linked, "fp", "left").select("fp", F.coalesce("component_id", "rep").alias("component_id")))
        full = slim.where("n > 0").join(known, "fp").select("doc_id", F.col("n").alias("n_shingles"), "component_id")
        none = slim.where("n = 0").select("doc_id", F.lit(0).cast("long").alias("n_shingles"), F.col("doc_id").alias("component_id"))
        return full.unionByName(none)


def near_duplicates(docs: DataFrame, words: int = 4, percent: int = 85, **options) -> DataFrame:
    return Groups(docs, words, percent, **options).result()
