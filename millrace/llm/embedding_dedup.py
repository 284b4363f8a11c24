"""Embedding near-dedup: cross-polytope hashing after fast Hadamard rotations.

A unit vector is rotated pseudo-randomly (three rounds of random signs and a
fast Hadamard transform); its hash is the nearest vertex of the cross-polytope,
the coordinate of largest size with its sign.  A vector stands in the buckets of
its ``probes`` nearest vertices in each table (multiprobe, on both sides).

What stands in the buckets is a name and a sketch of 128 signs, not the vector.
Vectors of one label that share a bucket and whose sketches differ in few enough
bits are candidates; the *home* of a vector, its nearest vertex in the first
table, and that of its candidate make a block.  Each block fetches the vectors
that have candidates in it once, and verifies all their pairs by cosine in double
precision: a pair has one block, however many buckets it shares.

Equal vectors of a label are one class with a size.  Buckets and blocks above a
tile's size meet in pairs of tiles; a task emits one row a class (links counted,
root of its spanning forest), not pairs.

Buckets get finer as the largest label grows: ``hashes_for`` joins so many hashes
to a bucket's key that buckets stay near a tile's size, and ``tables_for`` takes as
many tables as keep the share of links that are missed the same, some 1 in 10,000 at
the threshold and fewer above it.

Defined results for odd input: a null, empty or zero vector, one with null or
non-finite components, a null label or a null vec_id links with nothing; vectors
of unequal length do not link; every row counts as a vector, and classes with an
equal smallest vec_id are one vertex for components; other columns are ignored; an
empty table gives an empty result.  Classes and labels are told apart by 64-bit
hashes.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from itertools import product

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from millrace.llm import packed as P
from millrace.llm.components import Forest, components, cut_lineage, runs_of_pairs, tiled

COSINE = 0.93
PROBES = 2
SEED = 42
#: Share of the pairs at the threshold that have one of two probes in common in a table, measured; and the share that may be missed.
HIT, MISS = 0.763, 1e-4
#: Rows of a label that buckets of one hash are meant for: for every VERTICES times as many, keys take another hash.
ROOM, VERTICES = 1 << 19, 128
#: Rows of a bucket that meet in one task; they are names and sketches.
TILE_NAMES = 16_384
#: Rows of a block that meet in one task, with their vectors.
TILE_VECTORS = 8_192
#: Signs of a sketch, and how many standard deviations above the mean the differences of a link may lie.
SKETCH, SPREAD = 128, 4.0
CHUNK = 1 << 18
#: Runs of rows up to this length are paired together, longer ones by blocks.
SHORT_RUN = 48
MARKED = "vec_id long, cls long"
SIGNED = "cls long, vec_id long, home long, s0 long, s1 long, entries array<long>"


def hashes_for(rows: int) -> int:
    """Hashes joined to a bucket's key, by the rows of the largest label."""
    return 1 + max(0, math.ceil(math.log(max(1, rows) / ROOM, VERTICES)))


def tables_for(hashes: int) -> int:
    """Tables that miss the same share of links with so many hashes."""
    return math.ceil(math.log(MISS) / math.log(1 - HIT**hashes))


def sketch_limit(cosine: float) -> int:
    """Differing signs of two sketches that a link practically never exceeds."""
    p = math.acos(min(1.0, max(-1.0, cosine))) / math.pi
    return min(SKETCH, math.ceil(SKETCH * p + SPREAD * math.sqrt(SKETCH * p * (1 - p))))


def hadamard(x: np.ndarray) -> np.ndarray:
    """Fast Walsh-Hadamard transform of each row, scaled to keep lengths."""
    n = x.shape[1]
    h = 1
    while h < n:
        y = x.reshape(len(x), -1, 2, h)
        x = np.concatenate([y[:, :, :1] + y[:, :, 1:], y[:, :, :1] - y[:, :, 1:]], axis=2).reshape(len(x), n)
        h *= 2
    return x / np.sqrt(n)


def vertices(x: np.ndarray, turn: int, probes: int, seed: int) -> np.ndarray:
    """The nearest cross-polytope vertices of each row after rotation ``turn``: coordinate * 2 + sign."""
    width = 1 << max(0, int(x.shape[1] - 1).bit_length())
    y = np.zeros((len(x), width))
    y[:, : x.shape[1]] = x
    for k in range(3):
        y = hadamard(y * np.random.default_rng([seed, turn, k, width]).choice([-1.0, 1.0], width))
    probes = min(probes, width)
    near = np.argsort(-np.abs(y), axis=1, kind="stable")[:, :probes]
    return near * 2 + (np.take_along_axis(y, near, axis=1) < 0)


def codes_of(x: np.ndarray, tables: int, probes: int, hashes: int, seed: int) -> np.ndarray:
    """Bucket numbers (rows x tables x entries) of unit vectors."""
    out = []
    for t in range(tables):
        turns = [vertices(x, t * hashes + k, probes, seed) for k in range(hashes)]
        out.append(np.stack([sum(turns[k][:, c] * (1 << 20) ** k for k, c in enumerate(choice)) for choice in product(*(range(v.shape[1]) for v in turns))], axis=1))
    return np.stack(out, axis=1).astype(np.int64)


def matrix(column: pa.Array) -> np.ndarray:
    """Rows of equal length as unit vectors in double precision."""
    values = pc.fill_null(column.flatten().cast(pa.float64()), float("nan")).to_numpy(zero_copy_only=False)
    x = values.reshape(len(column), -1)
    x = x / np.abs(x).max(axis=1, keepdims=True)
    return x / np.sqrt((x * x).sum(axis=1, keepdims=True))


def sketches(x: np.ndarray, seed: int) -> np.ndarray:
    """Signs of random projections, as two 64-bit numbers a row."""
    turns = np.random.default_rng([seed, SKETCH, x.shape[1]]).normal(size=(x.shape[1], SKETCH))
    return np.packbits(x @ turns >= 0, axis=1).view(np.uint64)


def sound_rows(batch: pa.RecordBatch) -> np.ndarray:
    """Which rows of (vec_id, label hash, embedding) can link at all."""
    column = batch.column(2)
    size = pc.fill_null(pc.list_value_length(column), 0).to_numpy(zero_copy_only=False)
    good = (size > 0) & pc.is_valid(batch.column(0)).to_numpy(zero_copy_only=False) & pc.is_valid(batch.column(1)).to_numpy(zero_copy_only=False)
    values = pc.fill_null(column.flatten().cast(pa.float64()), float("nan")).to_numpy(zero_copy_only=False)
    if len(values):
        starts = np.cumsum(size) - size
        some = size > 0
        good[some] &= np.logical_and.reduceat(np.isfinite(values), starts[some]) & np.logical_or.reduceat(values != 0, starts[some])
    return good


def class_names(column: pa.Array, label: np.ndarray) -> np.ndarray:
    """A hash of each row's label and vector; zeros are equal whatever their sign."""
    values = column.flatten().cast(pa.float64()).to_numpy(zero_copy_only=False) + 0.0
    size = pc.list_value_length(column).to_numpy(zero_copy_only=False)
    raw, ends = values.tobytes(), (np.cumsum(size) * 8).tolist()
    own = [xxhash.xxh3_64_intdigest(raw[b - 8 * n : b]) for b, n in zip(ends, size.tolist(), strict=True)]
    return P.mix(np.array(own, np.uint64) ^ P.mix(label.view(np.uint64), 1), 2).view(np.int64)


def close_sketches(s: np.ndarray, key: np.ndarray, own: np.ndarray, limit: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Index pairs i < j of equal keys whose sketches are close, in pieces; of two tiles, only pairs across them.

    Rows are sorted by key and own; a run with two values of ``own`` is a pair of tiles.
    """
    runs = P.split_sorted(key)
    short = np.ones(len(key), bool)
    for _, lo, hi in runs:
        if hi - lo > SHORT_RUN:
            short[lo:hi] = False
            cut = lo + int(np.searchsorted(own[lo:hi], own[lo], side="right"))
            across = cut < hi
            step = max(1, (1 << 20) // (hi - lo))
            for i0 in range(lo, cut, step):
                i1 = min(i0 + step, cut)
                j0 = cut if across else i0
                apart = np.bitwise_count(s[i0:i1, None, 0] ^ s[None, j0:hi, 0]) + np.bitwise_count(s[i0:i1, None, 1] ^ s[None, j0:hi, 1])
                i, j = np.nonzero(apart <= limit)
                i, j = i + i0, j + j0
                later = i < j
                yield i[later], j[later]
    at = np.flatnonzero(short)
    two = np.zeros(len(key), bool)
    for _, lo, hi in runs:
        two[lo:hi] = own[lo] != own[hi - 1]
    for i, j in runs_of_pairs(key[at]):
        i, j = at[i], at[j]
        fits = (np.bitwise_count(s[i] ^ s[j]).sum(1, dtype=np.int64) <= limit) & (~two[i] | (own[i] != own[j]))
        yield i[fits], j[fits]


def new_keys(col: dict[str, np.ndarray], names: tuple[str, ...]) -> np.ndarray:
    """A number for each run of rows that are equal in all the columns."""
    new = np.zeros(len(col[names[0]]), bool)
    for c in names:
        new[1:] |= col[c][1:] != col[c][:-1]
    return np.cumsum(new)


def near_vectors(vectors: DataFrame, cosine: float = COSINE, tables: int | None = None, probes: int = PROBES, seed: int = SEED, hashes: int | None = None) -> DataFrame:
    """(vec_id, n_links, component_id, kept) of every row of (vec_id, embedding, label)."""
    spark = vectors.sparkSession
    label = F.when(F.col("label").isNotNull(), F.xxhash64("label"))
    rows = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), label.alias("label"), "embedding")
    sizes = rows.where("label is not null").groupBy("label").agg(F.count(F.lit(1)).alias("n")).agg(F.coalesce(F.sum("n"), F.lit(0)).alias("total"), F.coalesce(F.max("n"), F.lit(0)).alias("most")).first()
    total = sizes["total"]
    hashes = hashes or hashes_for(sizes["most"])
    tables = tables or tables_for(hashes)
    limit = sketch_limit(cosine)

    def mark(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Every row's class; null where it can't link."""
        for batch in batches:
            good = sound_rows(batch)
            part = batch.filter(pa.array(good))
            name = np.zeros(batch.num_rows, np.int64)
            name[good] = class_names(part.column(2), part.column(1).to_numpy())
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(name, pa.int64(), mask=~good)], ["vec_id", "cls"])

    def sign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Class, home, sketch and buckets of the rows that can link."""
        for batch in batches:
            good = batch.filter(pa.array(sound_rows(batch)))
            length = pc.list_value_length(good.column(2)).to_numpy(zero_copy_only=False)
            for d in np.unique(length).tolist():
                part = good.filter(pa.array(length == d))
                lab, x = part.column(1).to_numpy().view(np.uint64), matrix(part.column(2))
                codes = codes_of(x, tables, probes, hashes, seed)
                n, t, p = codes.shape
                space = P.mix(lab ^ P.U64(d), 3)
                home = P.mix(space ^ codes[:, 0, 0].astype(np.uint64), 4)
                table = np.arange(t, dtype=np.uint64)[None, :, None]
                entries = P.mix(P.mix(space[:, None, None] ^ table, 5) ^ codes.astype(np.uint64), 6).view(np.int64)
                s = sketches(x, seed).view(np.int64)
                lists = pa.ListArray.from_arrays(pa.array(np.arange(0, codes.size + 1, t * p), pa.int32()), pa.array(entries.ravel()))
                name = class_names(part.column(2), lab.view(np.int64))
                yield pa.RecordBatch.from_arrays([pa.array(name), part.column(0), pa.array(home.view(np.int64)), pa.array(s[:, 0].copy()), pa.array(s[:, 1].copy()), lists], ["cls", "vec_id", "home", "s0", "s1", "entries"])

    signed = rows.mapInArrow(sign, SIGNED)
    same = [F.first(c).alias(c) for c in ("home", "s0", "s1", "entries")]
    classes = cut_lineage(signed.groupBy("cls").agg(F.min("vec_id").alias("rep"), F.count(F.lit(1)).alias("n"), *same))
    entries = classes.select(F.explode("entries").alias("bucket"), "cls", "home", "s0", "s1")
    many = max(16, 4 * int(spark.conf.get("spark.sql.shuffle.partitions")))
    dealt = lambda df, keys, n: df.withColumn("_group", F.pmod(F.xxhash64(*keys, "tile_a", "tile_b"), F.lit(n))).groupBy("_group")

    def meet(table: pa.Table) -> pa.Table:
        """The blocks (two homes) that need a class, once each."""
        table = table.sort_by([(c, "ascending") for c in ("bucket", "tile_a", "tile_b", "_own", "cls")])
        col = {c: table.column(c).to_numpy() for c in ("bucket", "tile_a", "tile_b", "_own", "cls", "home", "s0", "s1")}
        key = new_keys(col, ("bucket", "tile_a", "tile_b")) if len(table) else np.empty(0, np.int64)
        s = np.stack([col["s0"], col["s1"]], axis=1).view(np.uint64)
        homes, home = np.unique(col["home"], return_inverse=True)
        names, cls = np.unique(col["cls"], return_inverse=True)
        asked = [np.empty((0, 3), np.int64)]
        for i, j in close_sketches(s, key, col["_own"], limit):
            a, b = np.minimum(home[i], home[j]), np.maximum(home[i], home[j])
            for k in (i, j):
                asked.append(np.unique(np.stack([a, b, cls[k]], axis=1), axis=0) if len(k) else asked[0])
        every = np.unique(np.concatenate(asked), axis=0)
        return pa.table({"a": pa.array(homes[every[:, 0]], pa.int64()), "b": pa.array(homes[every[:, 1]], pa.int64()), "cls": pa.array(names[every[:, 2]], pa.int64())})

    found = dealt(tiled(entries, ["bucket"], "cls", TILE_NAMES), ["bucket"], max(many, total * tables * probes**hashes // 50_000)).applyInArrow(meet, "a long, b long, cls long")
    asked = cut_lineage(found.distinct())
    blocks = tiled(asked.join(classes.select("cls", "home", "rep", "n"), "cls"), ["a", "b"], "cls", TILE_VECTORS)
    texts = rows.where("vec_id is not null and label is not null").select(F.col("vec_id").alias("rep"), "label", "embedding")

    def link(table: pa.Table) -> pa.Table:
        """Links of each class in the block, and the root of its spanning forest."""
        if not len(table):
            return pa.table({"cls": pa.array([], pa.int64()), "a": pa.array([], pa.int64()), "b": pa.array([], pa.int64()), "links": pa.array([], pa.int64())})
        # a vec_id may stand for other vectors too, and rows may repeat
        batch = table.select(["rep", "label", "embedding"]).combine_chunks().to_batches()[0]
        good = sound_rows(batch)
        table = table.filter(pa.array(good))
        table = table.filter(pa.array(class_names(table.column("embedding").combine_chunks(), table.column("label").to_numpy()) == table.column("cls").to_numpy()))
        table = table.sort_by([(c, "ascending") for c in ("a", "b", "tile_a", "tile_b", "_own", "cls")]).combine_chunks()
        col = {c: table.column(c).to_numpy() for c in ("a", "b", "tile_a", "tile_b", "_own", "cls", "home", "rep", "n")}
        out = [np.empty((0, 4), np.int64)]
        if len(table):
            again = np.r_[False, np.diff(new_keys(col, ("a", "b", "tile_a", "tile_b", "_own", "cls"))) == 0]
            if again.any():
                table = table.filter(pa.array(~again)).combine_chunks()
                col = {c: v[~again] for c, v in col.items()}
            vectors_ = table.column("embedding").chunk(0)
            for _, lo, hi in P.split_sorted(new_keys(col, ("a", "b", "tile_a", "tile_b"))):
                if hi - lo < 2:
                    continue
                x = matrix(vectors_.slice(lo, hi - lo))
                rep, size, own, home = (col[c][lo:hi] for c in ("rep", "n", "_own", "home"))
                one_home = col["a"][lo] == col["b"][lo]
                cut = int(np.searchsorted(own, own[0], side="right"))
                across = cut < hi - lo  # two tiles: rows of the first meet rows of the second
                forest, links = Forest(hi - lo), np.zeros(hi - lo, np.int64)
                step = max(1, CHUNK // max(1, hi - lo))
                for i0 in range(0, cut, step):
                    i1 = min(i0 + step, cut)
                    j0 = cut if across else i0
                    i, j = np.nonzero(x[i0:i1] @ x[j0:].T >= cosine)
                    i, j = i + i0, j + j0
                    fits = (i < j) & (one_home | (home[i] != home[j]))
                    i, j = i[fits], j[fits]
                    np.add.at(links, i, size[j])
                    np.add.at(links, j, size[i])
                    forest.link(i, j)
                some = np.flatnonzero(links > 0)
                least = np.full(hi - lo, np.iinfo(np.int64).max)
                np.minimum.at(least, forest.label, rep)
                out.append(np.stack([col["cls"][lo:hi][some], rep[some], least[forest.label[some]], links[some]], axis=1))
        every = np.concatenate(out)
        return pa.table({c: pa.array(every[:, k], pa.int64()) for k, c in enumerate(("cls", "a", "b", "links"))})

    fetched = blocks.join(texts, "rep")
    found = cut_lineage(dealt(fetched, ["a", "b"], many).applyInArrow(link, "cls long, a long, b long, links long"))
    links = found.groupBy("cls").agg(F.sum("links").alias("links"))
    groups = components(found.select("a", "b"))
    of_class = classes.select("cls", "rep", "n").join(links, "cls", "left").join(groups, F.col("rep") == F.col("node"), "left")
    of_class = of_class.select("cls", (F.coalesce("links", F.lit(0)) + F.col("n") - 1).alias("n_links"), F.coalesce("component", "rep").alias("component_id"))
    marked = rows.mapInArrow(mark, MARKED)
    linked = marked.where("cls is not null").join(of_class, "cls").select("vec_id", "n_links", "component_id", (F.col("vec_id") == F.col("component_id")).alias("kept"))
    alone = marked.where("cls is null").select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"), F.col("vec_id").isNotNull().alias("kept"))
    return linked.unionByName(alone)
