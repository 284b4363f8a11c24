"""Benchmark decontamination: seeds that no aligned copy can avoid, then Smith-Waterman alignment.

Texts are aligned word by word: a match counts 2, a mismatch or a gap costs 1.
A score is the alignment's share of the item's full score, so that edited and
paraphrased copies score by how much of them is left.

Candidates are found without loss.  A score of at least ``least`` leaves room for
``slack`` = 2L - ceil(2L least) of an item of L words: 3 for each word replaced
or left out, 2 for each at the ends that isn't aligned, 1 for each put in.  A pair
of neighbouring item words stands in the text one or two words apart unless a word of
it was lost (two pairs for 3) or two words were put in between (one for 2), so at
most two thirds of the slack of the L - 1 pairs are gone and ``need`` of them are
left.  Hence any L - need of them hold one that is left: the rarest by number of
documents are the item's seeds.  Items too short for that are sought by their
single words in the same way.  Documents that have a seed are aligned with the
item around its pairs, where ``need`` of them stand close together.

The items are broadcast in slices of at most ``slice_bytes`` of text, some 5 bytes
a byte of it, with the counts of their pairs (16 bytes each on the driver); a
larger benchmark takes more slices, each two passes over the documents.  Documents
don't move: their words meet the slice's pairs in a hash join of its own, by
sorted hashes.

Defined results for odd input: a null or empty text matches nothing; items with
fewer than ``n`` words match nothing; items with a null item_id are left out;
rows with an equal doc_id are each reported; a null doc_id is reported as null;
other columns are ignored (and kept by ``drop_leaks``); empty tables give an
empty result (and leave the documents as they are).
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from millrace.llm import packed as P
from millrace.llm.quality import pieces

SEED_WORDS = 3
MIN_SCORE = 0.5
SLICE_BYTES = 8 << 20
#: Regions of a text that overlap are aligned as one up to so many times the length of a single one.
JOINED = 8

#: Bytes that part words: all ASCII but letters and digits. Letters are read in lower case.
APART = np.ones(256, bool)
APART[ord("0") : ord("9") + 1] = APART[ord("a") : ord("z") + 1] = APART[ord("A") : ord("Z") + 1] = False
APART[128:] = False
LOWER = np.arange(256, dtype=np.uint8)
LOWER[ord("A") : ord("Z") + 1] += 32
FOUND = "key long, item_id long, score double, n_places long, first_word long, last_word long"


def read_words(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hash and row of every word."""
    starts, ends, row = P.words_of(data, offsets, APART)
    return P.slice_hashes(LOWER[data], starts, ends), row


def best_end(item: np.ndarray, text: np.ndarray, anchored: bool = False) -> tuple[int, int, int]:
    """Best score of an alignment, and how many words of the item and of the text it ends after; the first of equals.

    One row of scores is held at a time.  An ``anchored`` alignment begins at the first words of both.
    """
    j = np.arange(len(text) + 1, dtype=np.int32)
    last = -j if anchored else np.zeros(len(text) + 1, np.int32)
    best = (0, 0, 0)
    for i, word in enumerate(item, 1):
        row = np.empty(len(text) + 1, np.int32)
        row[0] = -i if anchored else 0
        row[1:] = np.maximum(last[:-1] + np.where(text == word, np.int32(2), np.int32(-1)), last[1:] - 1)
        if not anchored:
            np.maximum(row, 0, out=row)
        last = np.maximum.accumulate(row + j) - j  # gaps along the text
        k = int(np.argmax(last))
        if last[k] > best[0]:
            best = (int(last[k]), i, k)
    return best


def align(item: np.ndarray, text: np.ndarray) -> tuple[int, int, int]:
    """Best local alignment of two word sequences: score, first and last aligned word of the text.

    The same words are walked back from its end to find where it begins.
    """
    best, i, k = best_end(item, text)
    if not best:
        return 0, 0, -1
    _, _, back = best_end(item[:i][::-1], text[:k][::-1], anchored=True)
    return best, k - back, k - 1


def pair_keys(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Hash of two words in this order."""
    with np.errstate(over="ignore"):
        return P.mix(P.mix(a, 1) + b * P.U64(P.BASE))


def word_keys(a: np.ndarray) -> np.ndarray:
    return P.mix(a, 2)


def slack_of(length: int, least: float) -> int:
    """What an alignment of the least score may lose of an item's full score."""
    return 2 * length - max(1, math.ceil(2 * length * least - 1e-9))


def needed(length: int, least: float) -> tuple[bool, int]:
    """Whether an item is sought by pairs or by single words, and how many of them every alignment has."""
    slack = slack_of(length, least)
    pairs = length - 1 - 2 * slack // 3
    return (True, pairs) if pairs >= 1 else (False, (2 * length - slack + 1) // 2)


class Items:
    """Words of test items and the places of their pairs (or words), sorted by hash."""

    def __init__(self, ids: list[int], texts: list[str], n: int = SEED_WORDS, least: float = MIN_SCORE):
        self.ids, self.least = ids, least
        data, offsets = P.text_buffer(pa.array(texts, pa.string()))
        h, row = read_words(data, offsets)
        bounds = np.searchsorted(row, np.arange(len(ids) + 1))
        self.words = [h[a:b] for a, b in zip(bounds[:-1], bounds[1:], strict=True)]
        self.need, self.keys = np.zeros(len(ids), np.int64), []
        self.singles = False
        for k, words in enumerate(self.words):
            pairs, self.need[k] = needed(len(words), least)
            self.singles |= not pairs and len(words) >= n
            own = pair_keys(words[:-1], words[1:]) if pairs else word_keys(words)
            self.keys.append(own if len(words) >= n else own[:0])
        gram = np.concatenate([*self.keys, np.empty(0, np.uint64)])
        item = np.repeat(np.arange(len(ids)), [len(k) for k in self.keys])
        order = np.argsort(gram, kind="stable")
        self.gram, self.item = gram[order], item[order]
        self.seed = np.ones(len(gram), bool)
        # each item's own keys by hash, with their places
        self.orders = [np.argsort(k, kind="stable") for k in self.keys]
        self.keys = [k[o] for k, o in zip(self.keys, self.orders, strict=True)]
        self.sift()

    def sift(self) -> None:
        self.maybe = np.zeros(1 << 20, bool)
        self.maybe[self.gram >> P.U64(44)] = True

    def __getstate__(self) -> dict:
        return {k: v for k, v in self.__dict__.items() if k != "maybe"}

    def __setstate__(self, state: dict) -> None:
        self.__dict__.update(state)
        self.sift()

    def grams_of(self, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """All words and rows; positions, rising, and hashes of the pairs and words that items have."""
        h, row = read_words(data, offsets)
        found = [(np.empty(0, np.int64), np.empty(0, np.uint64))]
        for apart in (0, 1, 2) if self.singles else (1, 2):
            end = max(0, len(h) - apart)
            g = pair_keys(h[:end], h[apart:]) if apart else word_keys(h)
            at = np.flatnonzero(self.maybe[g >> P.U64(44)])
            at = at[row[at] == row[at + apart]]
            g = g[at]
            if len(self.gram):
                hit = self.gram[np.minimum(np.searchsorted(self.gram, g), len(self.gram) - 1)] == g
                found.append((at[hit], g[hit]))
        at, g = np.concatenate([x for x, _ in found]), np.concatenate([x for _, x in found])
        order = np.argsort(at, kind="stable")
        return h, row, at[order], g[order]

    def keep_rare(self, gram: np.ndarray, n: np.ndarray) -> None:
        """Seeds are as many of each item's rarest pairs by number of documents as no alignment can avoid."""
        order = np.argsort(gram)
        gram, n = np.r_[gram[order], P.U64(0)], np.r_[n[order], 0]
        at = np.searchsorted(gram[:-1], self.gram)
        df = np.where(gram[at] == self.gram, n[at], 0)
        order = np.lexsort((self.gram, df, self.item))
        item = self.item[order]
        nth = np.arange(len(item)) - np.searchsorted(item, item)
        size = np.searchsorted(item, item, side="right") - np.searchsorted(item, item)
        self.seed = np.zeros(len(order), bool)
        self.seed[order] = nth <= size - self.need[item]

    def regions(self, k: int, at: np.ndarray, g: np.ndarray, base: int, end: int) -> list[tuple[int, int]]:
        """Stretches of a text that hold every alignment with item ``k``, from its pairs' positions and hashes."""
        keys, size = self.keys[k], len(self.words[k])
        slack = slack_of(size, self.least)
        low, high = np.searchsorted(keys, g), np.searchsorted(keys, g, side="right")
        entry = P.expand(low, high - low)
        at = np.repeat(at, high - low)
        need = int(self.need[k])
        if len(at) < need:
            return []
        # positions rise: runs of ``need`` of them within the most words that an alignment takes
        close = at[need - 1 :] - at[: len(at) - need + 1] < size + slack
        edge = np.zeros(len(at) + 1, np.int64)
        first = np.flatnonzero(close)
        np.add.at(edge, first, 1)
        np.add.at(edge, first + need, -1)
        inside = np.cumsum(edge[:-1]) > 0
        shift = np.unique(at[inside] - self.orders[k][entry[inside]])
        out: list[tuple[int, int]] = []
        most = JOINED * (size + 2 * slack)
        for s in shift.tolist():
            lo, hi = max(base, s - slack), min(end, s + size + slack)
            if out and lo <= out[-1][1] and hi - out[-1][0] <= most:
                out[-1] = (out[-1][0], max(hi, out[-1][1]))
            else:
                out.append((lo, hi))
        return out

    def places(self, k: int, h: np.ndarray, regions: list[tuple[int, int]]) -> tuple[int, list[list[int]]]:
        """Best score of item ``k`` in the regions, and the stretches, apart from each other, where it aligns."""
        words, best, spans = self.words[k], 0, []
        least = 2 * len(words) - slack_of(len(words), self.least)
        while regions:
            lo, hi = regions.pop()
            if 2 * (hi - lo) < least:
                continue
            score, a, b = align(words, h[lo:hi])
            if score >= least:
                best = max(best, score)
                spans.append([lo + a, lo + b])
                regions += [(lo, lo + a), (lo + b + 1, hi)]
        apart: list[list[int]] = []
        for a, b in sorted(spans):
            if apart and a <= apart[-1][1]:
                apart[-1][1] = max(b, apart[-1][1])
            else:
                apart.append([a, b])
        return best, apart

    def matches(self, data: np.ndarray, offsets: np.ndarray) -> list[tuple[int, int, float, int, int, int]]:
        """(row, item_id, score, places, first word, last word) of each pair that aligns."""
        h, row, at, g = self.grams_of(data, offsets)
        if not len(at):
            return []
        low, high = np.searchsorted(self.gram, g), np.searchsorted(self.gram, g, side="right")
        seeds = np.r_[0, np.cumsum(self.seed)]
        some = np.flatnonzero(seeds[high] > seeds[low])
        entry = P.expand(low[some], (high - low)[some])
        both = row[np.repeat(at[some], (high - low)[some])] * len(self.ids) + self.item[entry]
        begin, begin_at = np.searchsorted(row, np.arange(len(offsets))), np.searchsorted(row[at], np.arange(len(offsets)))
        out = []
        for pair in np.unique(both[self.seed[entry]]).tolist():
            r, k = divmod(pair, len(self.ids))
            base, x, y = int(begin[r]), int(begin_at[r]), int(begin_at[r + 1])
            best, spans = self.places(k, h, self.regions(k, at[x:y], g[x:y], base, int(begin[r + 1])))
            if spans:
                out.append((r, self.ids[k], best / (2 * len(self.words[k])), len(spans), spans[0][0] - base, spans[-1][1] - base))
        return out


def item_slices(docs: DataFrame, benchmark: DataFrame, least: float, n: int, slice_bytes: int) -> Iterator[Broadcast]:
    """Items with their seeds chosen, in slices of bounded size, broadcast."""
    named = benchmark.where("item_id is not null and text is not null").groupBy(F.col("item_id").cast("long").alias("item_id"), F.col("text").cast("string").alias("text")).count()
    total = named.agg(F.coalesce(F.sum(F.octet_length("text") + 64), F.lit(0))).first()[0]
    slices = max(1, -(-total // slice_bytes))
    for k in range(slices):
        rows = sorted(named.where(F.pmod(F.xxhash64("item_id", "text"), F.lit(slices)) == k).select("item_id", "text").toLocalIterator())
        if not rows:
            continue
        items = Items([r[0] for r in rows], [r[1] for r in rows], n, least)
        shared = docs.sparkSession.sparkContext.broadcast(items)

        def count(batches: Iterator[pa.RecordBatch], shared: Broadcast = shared) -> Iterator[pa.RecordBatch]:
            items = shared.value
            total = np.zeros(len(items.gram), np.int64)
            for batch in batches:
                for _, _, data, offsets in pieces(batch, 0):
                    _, row, at, g = items.grams_of(data, offsets)
                    pairs = np.unique(np.stack([row[at].astype(np.uint64), np.searchsorted(items.gram, g).astype(np.uint64)]), axis=1)
                    np.add.at(total, pairs[1].astype(np.int64), 1)
            seen = np.flatnonzero(total)
            yield pa.RecordBatch.from_arrays([pa.array(items.gram[seen].view(np.int64)), pa.array(total[seen])], ["gram", "n"])

        counted = docs.select(F.col("text").cast("string")).mapInArrow(count, "gram long, n long").groupBy("gram").agg(F.sum("n").alias("n")).toPandas()
        items.keep_rare(counted["gram"].to_numpy(np.int64).view(np.uint64), counted["n"].to_numpy(np.int64))
        yield docs.sparkSession.sparkContext.broadcast(items)


def find_leaks(docs: DataFrame, benchmark: DataFrame, least: float = MIN_SCORE, n: int = SEED_WORDS, slice_bytes: int = SLICE_BYTES) -> DataFrame:
    """(doc_id, item_id, score, n_places, first_word, last_word) of each document and item that align."""
    out = docs.sparkSession.createDataFrame([], FOUND)
    for items in item_slices(docs, benchmark, least, n, slice_bytes):

        def each(batches: Iterator[pa.RecordBatch], items: Broadcast = items) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                rows = []
                for a, _, data, offsets in pieces(batch, 1):
                    rows += [(batch.column(0)[a + i].as_py(), *x) for i, *x in items.value.matches(data, offsets)]
                columns = list(zip(*rows, strict=True)) or [()] * 6
                yield pa.RecordBatch.from_arrays([pa.array(c, pa.float64() if k == 2 else pa.int64()) for k, c in enumerate(columns)], ["key", "item_id", "score", "n_places", "first_word", "last_word"])

        out = out.unionByName(docs.select(F.col("doc_id").cast("long").alias("key"), F.col("text").cast("string")).mapInArrow(each, FOUND))
    # an item_id that stands for several texts is reported by its best one
    best = F.row_number().over(Window.partitionBy("key", "item_id").orderBy(F.desc("score"), "first_word"))
    if benchmark.groupBy("item_id").agg(F.count_distinct("text").alias("n")).where("n > 1").limit(1).count():
        out = out.withColumn("_best", best).where("_best = 1").drop("_best")
    return out.withColumnRenamed("key", "doc_id")


def drop_leaks(docs: DataFrame, benchmark: DataFrame, least: float = MIN_SCORE, n: int = SEED_WORDS, slice_bytes: int = SLICE_BYTES) -> DataFrame:
    """The documents that no test item aligns with, with all their columns."""
    at = docs.columns.index("text")
    out = docs
    for items in item_slices(docs, benchmark, least, n, slice_bytes):

        def each(batches: Iterator[pa.RecordBatch], items: Broadcast = items) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                clean = np.ones(batch.num_rows, bool)
                for a, _, data, offsets in pieces(batch, at):
                    clean[[a + m[0] for m in items.value.matches(data, offsets)]] = False
                yield batch.filter(pa.array(clean))

        out = out.mapInArrow(each, docs.schema)
    return out
