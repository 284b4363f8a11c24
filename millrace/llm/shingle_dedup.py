"""Candidates for near duplicates: texts that share rare word shingles.

Two texts are near duplicates if they share ``least`` or more of all their distinct
word shingles (Jaccard).  Every such pair becomes a candidate and is decided by
the sets themselves:

Blocks of documents send their distinct shingles to buckets, once a block however
many texts have them, and are told in how many sets each stands.  By rising number
of sets, the first n - ceil(n least) + 1 of a text's n shingles are its prefix: of
two near duplicates the prefixes have a shingle in common, whatever the order.  A
text whose own shingles fill its prefix meets nobody.  The others are connected by
their prefixes; what is connected is compared, in tiles where it is much.

Equal sets are one vertex, and of equal texts only the first sends.  Texts, sets and
shingles are told apart by 64-bit hashes.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from millrace.llm import packed as P
from millrace.llm.components import FEW, components, cut_lineage, tiled
from millrace.llm.decontamination import LOWER
from millrace.llm.quality import pieces

SHINGLE, LEAST = 5, 0.8
BLOCK_BYTES = 3 << 20
#: Connected sets that one task compares; more of them meet in pairs of tiles.
TILE_SETS = 1_024
SENT = "bucket long, block long, payload binary"


def least_shared(n: np.ndarray | int, least: float) -> np.ndarray:
    """Shingles that a set of n shares at least with any near duplicate."""
    return np.maximum(1, np.ceil(np.asarray(n) * least - 1e-9)).astype(np.int64)


def shingle_sets(data: np.ndarray, offsets: np.ndarray, shingle: int) -> tuple[np.ndarray, np.ndarray]:
    """Distinct shingles of every text, by text and hash: hash and row of each."""
    low = LOWER[data]
    starts, ends, row = P.words_of(low, offsets)
    prefix = P.prefix_sums(P.slice_hashes(low, starts, ends))
    grams = P.grams(prefix, shingle)
    at = np.flatnonzero(row[: len(grams)] == row[shingle - 1 :]) if len(grams) else np.empty(0, np.int64)
    bounds = np.searchsorted(row, np.arange(len(offsets)))
    size = np.diff(bounds)
    short = np.flatnonzero((size > 0) & (size < shingle))
    grams = np.r_[grams[at], P.slices(prefix, bounds[short], bounds[short + 1])]
    row = np.r_[row[at], short]
    order = np.lexsort((grams, row))
    grams, row = grams[order], row[order]
    new = np.ones(len(grams), bool)
    new[1:] = (grams[1:] != grams[:-1]) | (row[1:] != row[:-1])
    return grams[new], row[new]


def names_of(grams: np.ndarray, row: np.ndarray, rows: int) -> tuple[np.ndarray, np.ndarray]:
    """A hash that stands for each text's set, and the set's size."""
    bounds = np.searchsorted(row, np.arange(rows + 1))
    sums = np.r_[np.uint64(0), np.cumsum(P.mix(grams, 3))]
    with np.errstate(over="ignore"):
        return P.mix(sums[bounds[1:]] - sums[bounds[:-1]], 4), np.diff(bounds)


def link_sets(n: np.ndarray, sets: list[np.ndarray], prefixes: list[np.ndarray], least: float, maybe: Callable[[int, np.ndarray], np.ndarray] | None = None, side: np.ndarray | None = None) -> np.ndarray:
    """A label for each set, equal for those that near duplicates connect; sets are sorted arrays.

    ``maybe`` says which of some sets may be near duplicates of one; with ``side``
    only sets of different sides are compared.
    """
    label = np.arange(len(n))
    gram = np.concatenate([*prefixes, np.empty(0, np.uint64)])
    owner = np.repeat(np.arange(len(n)), [len(p) for p in prefixes])
    order = np.lexsort((owner, gram))
    gram, owner = gram[order], owner[order]
    for i, prefix in enumerate(prefixes):
        tried = np.zeros(i, bool)
        for low, high in zip(np.searchsorted(gram, prefix).tolist(), np.searchsorted(gram, prefix, side="right").tolist(), strict=True):
            others = owner[low:high]
            others = others[: np.searchsorted(others, i)]  # each pair once
            others = others[(label[others] != label[i]) & ~tried[others]]
            if side is not None:
                others = others[side[others] != side[i]]
            if not len(others):
                continue
            tried[others] = True
            others = others[np.minimum(n[others], n[i]) >= least * np.maximum(n[others], n[i]) - 1e-9]
            if maybe is not None and len(others):
                others = others[maybe(i, others)]
            while len(others):
                j, others = int(others[0]), others[1:]
                both = len(np.intersect1d(sets[i], sets[j], assume_unique=True))
                if both >= least * (int(n[i]) + int(n[j]) - both) - 1e-9:
                    label[label == label[j]] = label[i]
                    others = others[label[others] != label[i]]
    return label


def near_duplicates(docs: DataFrame, sketch: Callable[[np.ndarray, np.ndarray, int], np.ndarray], maybe: Callable[..., np.ndarray], shingle: int = SHINGLE, least: float = LEAST, block_bytes: int = BLOCK_BYTES, tile: int = TILE_SETS, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, mark, group) of every document; near duplicates, and what they connect, have one group.

    ``sketch`` gives each text's fingerprint (rows x words of 64 bits) from the hashes
    and rows of its shingles, ``maybe`` which fingerprints may be near duplicates of one.
    """
    shape = P.corpus_shape(docs, block_bytes, key, text)
    parts, spark = P.block_parts(docs, shape), docs.sparkSession
    # payloads of a bucket stay near 2 MB; four bytes name a shingle beside the bucket's bits: a clash only counts
    # two shingles as one, the same for all texts, so that some seem shared that are not
    bits = max(0, math.ceil(math.log2(max(1, shape["bytes"] / (2 << 20)))))
    # copies of a text that came before: these rows of a block don't send
    firsts = cut_lineage(shape["places"].groupBy("mark").agg(F.min("key").alias("first"), F.count(F.lit(1)).alias("_n")).where("_n > 1").select("mark", "first"))
    again = shape["places"].join(F.broadcast(firsts) if firsts.limit(FEW + 1).count() <= FEW else firsts, "mark").where(~F.col("key").eqNullSafe(F.col("first")))
    again = again.select("key", "mark", F.lit(None).cast("string").alias("text"), F.lit(True).alias("again"))
    texts = P.placed(docs, key, text, (F.lit(False).alias("again"),))
    told = P.in_blocks(texts, shape).unionByName(P.in_blocks(again, shape)).repartition(parts, "block")

    def own_sets(table: pa.Table) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Shingles and rows of a block's first texts; their marks, names and sizes."""
        is_again = table.column("again").to_numpy()
        skip = set(P.place_names(*(table.filter(pa.array(is_again)).column(c).combine_chunks() for c in ("key", "mark"))).tolist())
        texts = table.filter(pa.array(~is_again)).sort_by([("key", "ascending"), ("mark", "ascending")]).combine_chunks()
        places = P.place_names(*(texts.column(c).combine_chunks() for c in ("key", "mark"))).tolist()
        keep = [p not in skip and (i == 0 or places[i - 1] != p) for i, p in enumerate(places)]
        texts = texts.filter(pa.array(keep, pa.bool_())).combine_chunks()
        none = np.empty(0, np.int64)
        if not len(texts):
            return np.empty(0, np.uint64), none, none, np.empty(0, np.uint64), none
        found, base = [], 0
        for a, b, data, offsets in pieces(texts.select(["text"]).to_batches()[0], 0):
            grams, row = shingle_sets(data, offsets, shingle)
            found.append((grams, row + base, *names_of(grams, row, b - a)))
            base += b - a
        grams, row, name, n = (np.concatenate(x) for x in zip(*found, strict=True))
        return grams, row, texts.column("mark").to_numpy(), name, n

    def distinct(grams: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, list]:
        """Distinct shingles by bucket, each value's rank in them, in how many sets, and the runs of buckets."""
        values, rank, count = np.unique(P.mix(grams, 5), return_inverse=True, return_counts=True)
        bucket = (values >> P.U64(64 - bits)).astype(np.int64) if bits else np.zeros(len(values), np.int64)
        return values, rank, count, P.split_sorted(bucket)

    def send(group_key: tuple, table: pa.Table) -> pa.Table:
        values, _, count, runs = distinct(own_sets(table)[0])
        short, few = ((values << P.U64(bits)) >> P.U64(32)).astype(np.uint32), np.minimum(count, 255).astype(np.uint8)
        return pa.table({"bucket": pa.array([r[0] for r in runs], pa.int64()), "block": pa.array([group_key[0].as_py()] * len(runs), pa.int64()), "payload": pa.array([P.pack(short[i:j], few[i:j]) for _, i, j in runs], pa.binary())})

    def answer(group_key: tuple, table: pa.Table) -> pa.Table:
        payloads = [P.unpack(p, np.uint32, np.uint8) for p in table.column("payload").to_pylist()]
        short, few = (np.concatenate(x) for x in zip(*payloads, strict=True))
        _, rank = np.unique(short, return_inverse=True)
        df = np.minimum(np.bincount(rank, weights=few), 65_535).astype(np.uint16)[rank]
        parts_ = np.split(df, np.cumsum([len(p[0]) for p in payloads])[:-1])
        return pa.table({"bucket": pa.array([group_key[0].as_py()] * len(parts_), pa.int64()), "block": table.column("block"), "payload": pa.array([x.tobytes() for x in parts_], pa.binary())})

    def choose(group_key: tuple, table: pa.Table, answers: pa.Table) -> pa.Table:
        every, of, mark, name, n = own_sets(table)
        _, rank, _, _ = distinct(every)
        got = answers.sort_by("bucket").column("payload").to_pylist()
        df = np.concatenate([np.frombuffer(p, np.uint16) for p in got])[rank] if got else np.empty(0, np.uint16)
        shared = df > 1
        grams, row, df = every[shared], of[shared], df[shared]
        order = np.lexsort((grams, df, row))
        grams, row = grams[order], row[order]
        runs = [(r, a, b, b - a - int(least_shared(n[r], least)) + 1) for r, a, b in P.split_sorted(row)]
        runs = [x for x in runs if x[3] > 0]
        at = [x[0] for x in runs]
        is_open = np.zeros(len(name), bool)
        is_open[at] = True
        here = is_open[of]
        marks = sketch(every[here], of[here], len(name))[at]
        full = lambda values: pa.array(values, pa.binary())
        rest = np.flatnonzero(~is_open)
        opened = pa.table({
            "mark": pa.array(mark[at], pa.int64()), "name": pa.array(name[at].view(np.int64)), "n": pa.array(n[at], pa.int64()), "prefix": pa.array([grams[a : a + k].view(np.int64) for _, a, _, k in runs], pa.list_(pa.int64())),
            "grams": full([np.sort(grams[a:b]).tobytes() for _, a, b, _ in runs]), "sketch": full([m.tobytes() for m in marks]),
        })
        closed = pa.table({"mark": pa.array(mark[rest], pa.int64()), "name": pa.array(name[rest].view(np.int64)), "n": pa.array(n[rest], pa.int64()), **{c: pa.nulls(len(rest), opened.schema.field(c).type) for c in ("prefix", "grams", "sketch")}})
        return pa.concat_tables([opened, closed])

    sent = told.groupBy("block").applyInArrow(send, SENT)
    spread = max(parts, int(spark.conf.get("spark.sql.shuffle.partitions")))
    answers = sent.repartition(spread, "bucket").groupBy("bucket").applyInArrow(answer, SENT)
    chosen = told.groupBy("block").cogroup(answers.repartition(parts, "block").groupBy("block")).applyInArrow(choose, "mark long, name long, n long, prefix array<long>, grams binary, sketch binary")
    chosen = cut_lineage(chosen)
    open_ = chosen.where("prefix is not null").drop("mark")
    met = open_.select("name", F.explode("prefix").alias("gram"))
    first = cut_lineage(met.groupBy("gram").agg(F.min("name").alias("b"), F.count(F.lit(1)).alias("_n")).where("_n > 1").select("gram", "b"))
    together = components(met.join(F.broadcast(first) if first.count() <= FEW else first, "gram").where("name <> b").select(F.col("name").alias("a"), "b").distinct())
    near = tiled(open_.join(together, open_["name"] == together["node"]).drop("node"), ["component"], "name", tile)
    tasks = max(16, 4 * int(spark.conf.get("spark.sql.shuffle.partitions")))

    def link(table: pa.Table) -> pa.Table:
        table = table.sort_by([(c, "ascending") for c in ("component", "tile_a", "tile_b", "_own", "name")]).combine_chunks()
        if len(table):  # a set may come from several texts
            names = [table.column(c).to_numpy() for c in ("component", "tile_a", "tile_b", "name")]
            table = table.filter(pa.array(np.r_[True, np.any([x[1:] != x[:-1] for x in names], axis=0)])).combine_chunks()
        component, a, b, own, name, n = (table.column(c).to_numpy() for c in ("component", "tile_a", "tile_b", "_own", "name", "n"))
        new = np.r_[0, np.cumsum((component[1:] != component[:-1]) | (a[1:] != a[:-1]) | (b[1:] != b[:-1]))] if len(table) else np.empty(0, np.int64)
        sets = [np.frombuffer(x, np.uint64) for x in table.column("grams").to_pylist()]
        prefixes = [np.array(x, np.int64).view(np.uint64) for x in table.column("prefix").to_pylist()]
        marks = np.stack([np.frombuffer(x, np.uint64) for x in table.column("sketch").to_pylist()]) if len(table) else None
        out: list[np.ndarray] = [np.empty((0, 2), np.int64)]
        for _, lo, hi in P.split_sorted(new):
            here, sizes = marks[lo:hi], n[lo:hi]
            may = lambda i, others, here=here, sizes=sizes: maybe(here[i], here[others], np.minimum(sizes[i], sizes[others]), least)
            label = link_sets(sizes, sets[lo:hi], prefixes[lo:hi], least, may, own[lo:hi] if a[lo] != b[lo] else None)
            root = name[lo:hi][label]
            out.append(np.stack([name[lo:hi], root], axis=1)[root != name[lo:hi]])
        edges = np.concatenate(out)
        return pa.table({"a": pa.array(edges[:, 0], pa.int64()), "b": pa.array(edges[:, 1], pa.int64())})

    edges = near.withColumn("_task", F.pmod(F.xxhash64("component", "tile_a", "tile_b"), F.lit(tasks))).groupBy("_task").applyInArrow(link, "a long, b long")
    groups = components(edges)
    group_of = chosen.select("mark", "name").join(groups, F.col("name") == F.col("node"), "left").select("mark", F.coalesce("component", "name").alias("group"))
    return shape["places"].join(group_of, "mark").select(F.col("key").alias(key), "mark", "group")
