"""Operator 5: Jaccard join of documents on word n-grams, as components of linked documents.

Two documents link when den * |A and B| >= num * |A or B| for their sets of n-grams. N-grams are ordered rare first, by
counts in a hashed table over all documents (the table's size is fixed; the order only steers cost, never the result), then
by hash. Linked documents share one of their first n - ceil(num * n / den) + 1 n-grams, their prefixes.

1. Prefix rows (n-gram, position, size, hash and histogram of the set from there on) are kept where two different sets
   share the n-gram.
2. Rows of one n-gram whose remaining sets are equal are one class. If few enough n-grams precede it, all in a class are
   linked to each other, so one of them stands for it; copies and near copies fall together here, before any pair is made.
3. Classes of an n-gram meet the one with the fewest rarer n-grams (its hub), then only classes of other components meet.
   Candidates must pass the length filter, the positional filter (what can still be shared) and the suffix filter (the
   least difference of the remaining sets by counts in eight cells, then of the whole sets by parities of as many cells as
   they have n-grams). Classes meet by bands of sizes that may link, and those of a hot n-gram on several tasks.
4. Each pair is verified once, on whole sets.

Cases: null and empty texts have no set and link with nothing; rows with the same id are one document that links where
any of its texts does, and each keeps its row; a null id gets a row with null component; texts of any length are compared
whole; an empty table gives an empty one; other columns are left out.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from daybook.llm.byte_bpe import packed
from daybook.llm.common import discard, id_and_text, summed, written
from daybook.llm.components import components
from daybook.llm.shingles import cells, mix, shingle_hashes, split_at_texts, word_hashes

#: Counters of each of the two tables that order n-grams (of n-grams and of words): 2^19, whatever the size of the input;
#: what is broadcast is 4 bytes for each.
COUNTERS = 1 << 19
#: Least number of cells of a whole set whose parities are kept with each document, for a second suffix filter. A larger set
#: has as many as n-grams, rounded up to a power of two: about an eighth of a byte for an n-gram whatever a text's length.
LEAST_CELLS = 512
#: Classes of one n-gram that meet all others in one task; more are dealt to as many tasks as it takes.
CLASSES_A_TASK = 1024
#: Bits of the map that tells which n-grams may be shared: 8 MB. It only spares shuffling rows of n-grams that aren't; with
#: far more shared n-grams than an eighth of it, it spares less.
MAP_BITS = 1 << 26
#: Up to so many ids (8 bytes each) are broadcast to find documents again; more are joined by shuffle.
MOST_BROADCAST = 500_000


def _order(rows: DataFrame, k: int) -> tuple[np.ndarray, np.ndarray]:
    """What the order of n-grams rests on, from counts over all documents: for each counter of n-grams log2 of what stands out
    of the mean, for each counter of words log2 of its share, to which log2 of all words is added k-th by k-th.

    How often an n-gram occurs is guessed as the larger of what its counter shows above the others' level and of what its
    words' shares make likely; the second holds at any size of input.
    """

    def count(batches: Iterator[pa.RecordBatch]) -> np.ndarray:
        grams, words = np.zeros(COUNTERS, np.int64), np.zeros(COUNTERS, np.int64)
        for batch in batches:
            for _, _, data, bounds in packed(batch.column("text")):
                own, _, _ = shingle_hashes(data, bounds, k)
                grams += np.bincount(cells(own, COUNTERS), minlength=COUNTERS)
                words += np.bincount(cells(word_hashes(split_at_texts(data, bounds)[0])[1], COUNTERS), minlength=COUNTERS)
        return np.concatenate([grams, words])

    counts = summed(rows.select("text"), count, 2 * COUNTERS).astype(np.float64)
    grams, words = counts[:COUNTERS], counts[COUNTERS:]
    usual = float(np.median(grams))
    above = np.log2(np.maximum(grams - usual - 4 * np.sqrt(usual + 1), 2.0**-20))
    total = max(float(words.sum()), 1.0)
    share = np.log2(np.maximum(words, 1) / total) + np.log2(total) / k
    return above.astype(np.float32), share.astype(np.float32)


def _tokens(data: bytes, bounds: np.ndarray, k: int, order: tuple[np.ndarray, np.ndarray]) -> tuple[np.ndarray, list[int]]:
    """N-grams as numbers in the global order (level in six bits, then hash, below 2^63), and where each text's begin."""
    above, share = order
    grams, heads, sums = shingle_hashes(data, bounds, k, share)
    guess = np.maximum(above[cells(grams, COUNTERS)], sums)
    level = np.clip(np.round(2 * guess) + 16, 0, 63).astype(np.uint64)
    return (level << np.uint64(57)) | (mix(grams) >> np.uint64(7)), heads.tolist()


def _marks(tokens: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    h = mix(tokens.astype(np.uint64))
    return (h >> np.uint64(38)).astype(np.int64), ((h >> np.uint64(12)) & np.uint64(MAP_BITS - 1)).astype(np.int64)


def _map(tokens: DataFrame) -> np.ndarray:
    """Bits that tokens set: two for each."""

    def mark(batches: Iterator[pa.RecordBatch]) -> np.ndarray:
        bits = np.zeros(MAP_BITS, np.uint8)
        for batch in batches:
            for at in _marks(batch.column("token").to_numpy()):
                bits[at] = 1
        return np.packbits(bits)

    return summed(tokens, mark, MAP_BITS // 8, kind="u1", add=np.bitwise_or)


def _cells(column: Column, c: int) -> Column:
    return F.shiftrightunsigned(column, 8 * c).bitwiseAND(F.lit(255))


def _parities(hashes: np.ndarray) -> np.ndarray:
    """Parities of how many n-grams fall on each cell, 64 cells a word. Cells of half as many come by folding the words."""
    size = max(LEAST_CELLS, 1 << (len(hashes) - 1).bit_length())
    odd = np.bincount((hashes >> np.uint64(20)).astype(np.int64) & (size - 1), minlength=size) & 1
    return np.packbits(odd.astype(np.uint8), bitorder="little").view("<i8")


def _folded(words: Column, n: Column) -> Column:
    """Parities of n words from those of a multiple."""
    at = lambda k: F.aggregate(F.sequence(F.lit(0), (F.size(words) / n).cast("int") - 1), F.lit(0).cast("long"), lambda x, j: x.bitwiseXOR(F.get(words, k + j * n)))
    return F.when(F.size(words) == n, words).otherwise(F.transform(F.sequence(F.lit(0), n - 1), at))


def _apart(a: Column, b: Column) -> Column:
    """At least so many n-grams are in one of two sets only: differences of eight counts, each known modulo 256."""
    out = F.lit(0)
    for c in range(8):
        d = F.abs(_cells(a, c) - _cells(b, c))
        out = out + F.least(d, 256 - d)
    return out


class JaccardJoin:
    def __init__(self, docs: DataFrame, k: int, num: int, den: int, doc_id: str = "doc_id", text: str = "text"):
        if not 0 < num <= den or k < 1:
            raise ValueError("the threshold num / den lies in (0, 1], n-grams have a word or more")
        self.spark: SparkSession = docs.sparkSession
        self.rows, self.k, self.num, self.den = id_and_text(docs, doc_id, text), k, num, den
        self.order = self.spark.sparkContext.broadcast(_order(self.rows, k))

    def _prefix_rows(self) -> DataFrame:
        """doc_id, n, the set's identity (two hashes of 64 bits), and for each prefix position the n-gram, the hash of the
        rest and its histogram."""
        k, num, den, shared = self.k, self.num, self.den, self.order

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            order = shared.value
            for batch in batches:
                for i, j, data, bounds in packed(batch.column("text")):
                    tokens, edges = _tokens(data, bounds, k, order)
                    sizes, sums, others, cols, parities = [], [], [], ([], [], []), []
                    for a, b in zip(edges[:-1], edges[1:], strict=True):
                        t = np.sort(tokens[a:b])
                        if len(t) > 1:
                            t = t[np.concatenate([[True], t[1:] != t[:-1]])]
                        n = len(t)
                        p = n - -(-num * n // den) + 1 if n else 0
                        hashes = mix(t + np.uint64(0x5851F42D4C957F2D))
                        rest = np.cumsum(hashes[::-1])[::-1][:p] if n else hashes
                        cell = (t & np.uint64(7)).astype(np.int64)
                        hist = np.zeros(p, np.uint64)
                        if n:
                            total = np.bincount(cell, minlength=8)
                            gone = np.zeros((p, 8), np.int64)
                            if p > 1:
                                gone[np.arange(1, p), cell[: p - 1]] = 1
                                gone = np.cumsum(gone, axis=0)
                            left = ((total[None, :] - gone) & 255).astype(np.uint64)
                            hist = (left << (np.arange(8, dtype=np.uint64) * np.uint64(8))).sum(axis=1, dtype=np.uint64)
                        parities.append(_parities(hashes))
                        sizes.append(n)
                        sums.append(int(rest[0].astype(np.int64)) if n else 0)
                        others.append(int(mix(hashes ^ np.uint64(0xD6E8FEB86659FD93)).sum(dtype=np.uint64).astype(np.int64)))
                        for column, x in zip(cols, (t[:p], rest, hist), strict=True):
                            column.append(x.astype(np.int64))
                    offsets = pa.array(np.concatenate([[0], np.cumsum([len(x) for x in cols[0]])]).astype(np.int32))
                    lists = [pa.ListArray.from_arrays(offsets, pa.array(np.concatenate(x) if x else np.zeros(0, np.int64))) for x in cols]
                    words = pa.array(np.concatenate([[0], np.cumsum([len(x) for x in parities])]).astype(np.int32))
                    lists.append(pa.ListArray.from_arrays(words, pa.array(np.concatenate(parities))))
                    yield pa.RecordBatch.from_arrays([batch.column("doc_id").slice(i, j - i), pa.array(sizes, pa.int32()), pa.array(sums, pa.int64()), pa.array(others, pa.int64()), *lists], ["doc_id", "n", "sig", "sig2", "token", "rest", "hist", "parity"])

        return self.rows.mapInArrow(run, "doc_id long, n int, sig long, sig2 long, token array<long>, rest array<long>, hist array<long>, parity array<long>")

    def _marked_rows(self, prefixes: DataFrame, shared: DataFrame) -> DataFrame:
        """A row for each n-gram of a prefix that may be shared: doc_id, n, i, token, rest, hist."""
        bits = self.spark.sparkContext.broadcast(_map(shared))

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            marked = bits.value
            for batch in batches:
                sizes = batch.column("token").value_lengths().to_numpy(zero_copy_only=False).astype(np.int64)
                token, rest, hist = (batch.column(c).flatten().to_numpy(zero_copy_only=False) for c in ("token", "rest", "hist"))
                heads = np.concatenate([[0], np.cumsum(sizes)])
                row = np.repeat(np.arange(len(sizes)), sizes)
                hit = np.ones(len(token), bool)
                for at in _marks(token):
                    hit &= (marked[at >> 3] >> (7 - (at & 7)).astype(np.uint8) & 1).astype(bool)
                at = np.flatnonzero(hit)
                own = pa.array(row[at])
                yield pa.RecordBatch.from_arrays(
                    [batch.column("doc_id").take(own), batch.column("n").take(own), pa.array((at - heads[row[at]]).astype(np.int32)), *(pa.array(x[at]) for x in (token, rest, hist))],
                    ["doc_id", "n", "i", "token", "rest", "hist"],
                )

        return prefixes.select("doc_id", "n", "token", "rest", "hist").mapInArrow(run, "doc_id long, n int, i int, token long, rest long, hist long")

    def _sets(self, ids: DataFrame) -> DataFrame:
        """doc_id, tokens of the documents in ids (doc_id): whole sets."""
        shared, k = self.order, self.k
        few = ids.count() <= MOST_BROADCAST
        wanted = self.rows.join(F.broadcast(ids) if few else ids, "doc_id", "left_semi")

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for i, j, data, bounds in packed(batch.column("text")):
                    tokens, edges = _tokens(data, bounds, k, shared.value)
                    sets = [np.unique(tokens[a:b].astype(np.int64)) for a, b in zip(edges[:-1], edges[1:], strict=True)]
                    offsets = pa.array(np.concatenate([[0], np.cumsum([len(x) for x in sets])]).astype(np.int32))
                    yield pa.RecordBatch.from_arrays([batch.column("doc_id").slice(i, j - i), pa.ListArray.from_arrays(offsets, pa.array(np.concatenate(sets)))], ["doc_id", "tokens"])

        return wanted.mapInArrow(run, "doc_id long, tokens array<long>")

    def _needed(self, n: Column, m: Column) -> Column:
        """den * s >= num * (n + m - s), as (num + den) * s >= num * (n + m)."""
        return F.lit(self.num) * (n + m)

    def _near_enough(self, pairs: DataFrame) -> DataFrame:
        """The suffix filter once for each pair, on whole sets and in finer cells: a cell whose parity differs holds at least
        one n-gram of only one set."""
        side = lambda key, n, p: self.parities.select(F.col("doc_id").alias(key), F.col("n").alias(n), F.col("parity").alias(p))
        met = pairs.join(side("a", "n", "p"), "a").join(side("b", "m", "q"), "b")
        cells = F.least(F.size("p"), F.size("q"))
        differ = F.zip_with(_folded(F.col("p"), cells), _folded(F.col("q"), cells), lambda x, y: F.bit_count(x.bitwiseXOR(y)))
        apart = F.aggregate(differ, F.lit(0), lambda x, y: x + y)
        n, m = F.col("n"), F.col("m")
        spare = n + m - 2 * F.ceil(self._needed(n, m) / F.lit(self.num + self.den))
        return met.where(apart <= spare).select("a", "b").distinct()

    def _verified(self, pairs: DataFrame) -> DataFrame:
        """Those of pairs (a, b) that link, each compared once on whole sets."""
        pairs = written(self._near_enough(pairs.select("a", "b").distinct()), "pairs")
        sets = written(self._sets(pairs.select(F.col("a").alias("doc_id")).union(pairs.select("b")).distinct()), "sets")
        left = sets.select(F.col("doc_id").alias("a"), F.col("tokens").alias("x"))
        right = sets.select(F.col("doc_id").alias("b"), F.col("tokens").alias("y"))
        met = pairs.join(left, "a").join(right, "b")
        shared = F.size(F.array_intersect("x", "y"))
        links = written(met.where((self.num + self.den) * shared >= self._needed(F.size("x"), F.size("y"))).select("a", "b"), "links")
        discard(pairs, sets)
        return links

    def _band(self) -> Column:
        """Sizes by powers of the largest ratio that may link, a hair more, so linked sizes lie in one band or in neighbours."""
        ratio = self.den / self.num if self.num < self.den else 2.0
        return F.floor(F.log(F.col("n").cast("double")) / F.lit(float(np.log(ratio)) * (1 + 1e-9)))

    def _far_pairs(self, rest: DataFrame) -> DataFrame:
        """Pairs of classes of an n-gram that are in different components. rest: classes with `classes`, their number for the
        n-gram. A class meets those that are not smaller, of its band and the next; where an n-gram has many classes, the
        smaller ones are dealt to tasks and the others go to all of these."""
        tasks = F.ceil(F.col("classes") / F.lit(CLASSES_A_TASK)).cast("int")
        small = rest.withColumn("task", F.pmod(F.xxhash64("head", "n"), tasks).cast("int"))
        large = rest.withColumn("band", F.explode(F.array("band", F.col("band") - 1))).withColumn("task", F.explode(F.sequence(F.lit(0), tasks - 1)))
        rising = (F.col("x_n") < F.col("y_n")) | ((F.col("x_n") == F.col("y_n")) & (F.col("x_head") < F.col("y_head")))
        return self._candidates(small, large, ["token", "band", "task"], rising & (F.col("x_component") != F.col("y_component")) & (F.col("x_head") != F.col("y_head")))

    def _candidates(self, x: DataFrame, y: DataFrame, on: list[str], other: Column) -> DataFrame:
        """Pairs of classes of an n-gram that pass the length, positional and suffix filters."""
        x = x.select(*on, *(F.col(c).alias(f"x_{c}") for c in ("n", "i", "hist", "head", "component")))
        y = y.select(*on, *(F.col(c).alias(f"y_{c}") for c in ("n", "i", "hist", "head", "component")))
        n, m, i, j = (F.col(c) for c in ("x_n", "y_n", "x_i", "y_i"))
        need = self._needed(n, m)
        # floor of what may be in one set only: n + m - 2 * ceil(need / (num + den))
        spare = n + m - 2 * F.ceil(need / F.lit(self.num + self.den))
        length = self.den * F.least(n, m) >= self.num * F.greatest(n, m)
        positional = (self.num + self.den) * F.least(n - i, m - j) >= need
        suffix = i + j + _apart(F.col("x_hist"), F.col("y_hist")) <= spare
        joined = x.join(y, on).where(length & positional & suffix & other)
        return joined.select(F.least("x_head", "y_head").alias("a"), F.greatest("x_head", "y_head").alias("b"))

    def linked(self) -> tuple[DataFrame, DataFrame]:
        """All documents (doc_id, n, sig, sig2), and components of those that link with another set."""
        table = written(self._prefix_rows(), "prefixes")
        docs = written(table.select("doc_id", "n", "sig", "sig2"), "sizes")
        self.parities = written(table.where("n > 0 AND doc_id IS NOT NULL").select("doc_id", "n", "parity"), "parities")
        prefixes, sets = (x.where("n > 0 AND doc_id IS NOT NULL") for x in (table, docs))
        same = ["n", "sig", "sig2"]
        first = written(sets.groupBy(*same).agg(F.min("doc_id").alias("rep")), "sets-of-copies")
        tight = (self.num + self.den) * (F.col("n") - F.col("i")) >= 2 * self.num * F.col("n")
        # which n-grams different sets share: numbers only, added up before they are shuffled
        grams = prefixes.select("sig", F.explode("token").alias("token"))
        shared = written(grams.groupBy("token").agg(F.min("sig").alias("low"), F.max("sig").alias("high")).where("low <> high").select("token"), "shared")
        kept = self._marked_rows(prefixes, shared).join(shared, "token", "left_semi")
        kept = written(kept.join(first.select(F.col("rep").alias("doc_id")), "doc_id", "left_semi").withColumn("own", F.when(tight, F.lit(None).cast("long")).otherwise(F.col("doc_id"))), "rows")
        discard(table, shared)
        key = ["token", "n", "rest", "own"]
        classes = written(kept.groupBy(key).agg(F.min("doc_id").alias("head"), F.count(F.lit(1)).alias("members"), F.min("i").alias("i"), F.min("hist").alias("hist")).withColumn("band", self._band()), "classes")
        several = classes.where("members > 1 AND own IS NULL").select("token", "n", "rest", "head")
        inner = kept.where("own IS NULL").join(several, ["token", "n", "rest"]).where("doc_id <> head").select(F.col("head").alias("a"), F.col("doc_id").alias("b")).distinct()
        inner = written(inner, "inner")
        discard(kept)

        alone = classes.withColumn("component", F.col("head"))
        hubs = alone.groupBy("token", "band").agg(F.min(F.struct("i", "head", "n", "hist", "component")).alias("hub"), F.count(F.lit(1)).alias("classes")).where("classes > 1").select("token", "band", "hub.*")
        near = self._verified(self._candidates(alone, hubs, ["token", "band"], F.col("x_head") != F.col("y_head")))
        several_sets = sets.groupBy("doc_id").agg(F.min(F.struct("sig", "sig2")).alias("low"), F.max(F.struct("sig", "sig2")).alias("high")).where("low <> high").select("doc_id")
        same_id = sets.select("doc_id", *same).join(several_sets, "doc_id", "left_semi").join(first, same).select(F.col("doc_id").alias("a"), F.col("rep").alias("b"))
        known = components(inner.union(near).union(same_id))
        discard(inner, near)
        placed = classes.join(known.select(F.col("node").alias("head"), "component"), "head", "left").withColumn("component", F.coalesce("component", "head"))
        placed = written(placed.select("token", "band", "n", "i", "hist", "head", "component"), "placed")
        discard(classes)
        # n-grams whose classes are all in one component need no more pairs
        open_ = placed.groupBy("token").agg(F.min("component").alias("low"), F.max("component").alias("high"), F.count(F.lit(1)).alias("classes")).where("low <> high").select("token", "classes")
        far = self._verified(self._far_pairs(placed.join(open_, "token")))
        discard(placed, self.parities)
        moved = far.join(known.select(F.col("node").alias("a"), F.col("component").alias("ca")), "a", "left").join(known.select(F.col("node").alias("b"), F.col("component").alias("cb")), "b", "left")
        joined = components(moved.select(F.coalesce("ca", "a").alias("a"), F.coalesce("cb", "b").alias("b")))
        nodes = known.select("node", "component").union(far.select("a", "a")).union(far.select("b", "b")).groupBy("node").agg(F.min("component").alias("component"))
        final = nodes.join(joined.select(F.col("node").alias("component"), F.col("component").alias("over")), "component", "left").select("node", F.coalesce("over", "component").alias("component"))
        # from sets of copies to their documents: an equal set links with all others of its kind
        by_set = first.join(final, first.rep == final.node, "left").select(*same, F.coalesce("component", "rep").alias("component"))
        return docs, by_set


def link_documents(docs: DataFrame, k: int = 5, num: int = 80, den: int = 100, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, n_shingles (size of its set), component_id (smallest id that links reach, its own included)."""
    rows, by_set = JaccardJoin(docs, k, num, den, doc_id, text).linked()
    found = rows.join(by_set, ["n", "sig", "sig2"], "left")
    component = F.when(F.col("n") > 0, F.col("component")).otherwise(F.col("doc_id"))
    return found.select("doc_id", F.col("n").cast("long").alias("n_shingles"), F.when(F.col("doc_id").isNotNull(), component).alias("component_id"))
