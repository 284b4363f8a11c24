"""SimHash near-dedup with pigeonring filtering.

A fingerprint has the majority of each bit over the XXH64 hashes of a text's
word shingles.  Two fingerprints that differ in at most ``distance`` of 64 bits,
cut into ``distance + 1`` segments in a ring, must have a segment from which the
differences of 1, 2, 3 ... consecutive segments stay within their share of
the distance (for four bits over five segments: 0, 1, 2, 3, 4).  The first
``chain`` segments of that run are the key of a bucket; the rest of the run
prunes candidates before the full Hamming check.  Longer chains, tried with the
differences that they allow, make finer buckets for larger corpora and find the
same links.

Equal fingerprints are one vertex.  Buckets above a tile's size meet in pairs of
tiles.  A task emits a spanning forest of the links it found, not the links.

``keep_one`` decides by likeness: texts that share ``least`` or more of their
shingles.  Such texts may differ in a quarter of their bits, too many for any
segment to be a key, so its candidates come from rare shingles
(``shingle_dedup``); the pigeonring over fingerprints of 256 bits prunes them
before the full Hamming check, and the shingles themselves decide.

Defined results for odd input: a null or empty text has fingerprint zero and
links like any other; fewer words than a shingle make one shingle of all words;
rows with an equal doc_id are each given their own fingerprint; a null doc_id
gets a fingerprint and the component of the rows it links with (null if all of
them have none); other columns are ignored (and kept by ``keep_one``); an empty
table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations, product

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from millrace.llm import packed as P
from millrace.llm import shingle_dedup
from millrace.llm.components import Forest, components, cut_lineage, fresh, runs_of_pairs, tiled

SHINGLE = 4
DISTANCE = 4
SEED = 42
BITS = 64
#: For keep_one: words of a shingle and the least likeness; numbers of 64 bits in a fingerprint, bits of a segment, segments of a chain.
STAGE_SHINGLE, LEAST, WORDS, SEGMENT, CHAIN = 5, 0.8, 4, 16, 4
#: Ids of documents that go, 8 bytes each, up to which their list is broadcast; beyond it, documents meet them by a shuffle.
FEW_IDS = 1_000_000
#: Standard deviations that a near duplicate's differences may lie above their mean; sets below so many shingles aren't pruned.
SPREAD, ENOUGH = 6.0, 32
#: Runs of equal keys above this length are compared by blocks; buckets above TILE_ROWS in pairs of tiles.
LONG_RUN, TILE_ROWS = 64, 8_192


def majority(hashes: np.ndarray) -> int:
    """The bits that over half of the 64-bit hashes have."""
    bits = np.unpackbits(hashes.astype(">u8").view(np.uint8)).reshape(-1, BITS)
    count = np.zeros(BITS, np.int64)
    for i in range(0, len(bits), 255):
        count += np.add.reduce(bits[i : i + 255], axis=0, dtype=np.uint8)
    return int.from_bytes(np.packbits(2 * count > len(bits)).tobytes(), "big")


def fingerprint(text: bytes, shingle: int = SHINGLE, seed: int = SEED) -> int:
    """SimHash of a text's word shingles, repeats included."""
    words = text.lower().split()  # bytes: A-Z only, and the ASCII white space
    if not words:
        return 0
    line = b" ".join(words)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
    starts = np.r_[0, ends[:-1] + 1]
    n = max(1, len(words) - shingle + 1)
    digest = xxhash.xxh64_digest
    hashes = b"".join([digest(line[a:b], seed) for a, b in zip(starts[:n].tolist(), ends[-n:].tolist(), strict=True)])
    return majority(np.frombuffer(hashes, ">u8").astype(np.uint64))


def fingerprints(docs: DataFrame, shingle: int = SHINGLE, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, bits) of every document; no shuffle."""

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, offsets = P.text_buffer(batch.column(1))
            raw, at = data.tobytes(), offsets.tolist()
            out = np.array([fingerprint(raw[a:b], shingle) for a, b in zip(at[:-1], at[1:], strict=True)], np.uint64).view(np.int64)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(out)], ["key", "bits"])

    return docs.select(F.col(key).cast("long").alias("key"), F.col(text).cast("string")).mapInArrow(each, "key long, bits long")


def wide_fingerprints(grams: np.ndarray, row: np.ndarray, rows: int) -> np.ndarray:
    """SimHash of 64 * WORDS bits of each row's distinct shingles (rows x WORDS), from their hashes; ``row`` rises."""
    out = np.zeros((rows, WORDS), np.uint64)
    some, first, size = np.unique(row, return_index=True, return_counts=True)
    step = 1 << 16
    for k in range(WORDS):
        hashes = P.mix(grams, 16 + k)
        count = np.zeros((len(some), BITS), np.int32)
        for a in range(0, len(grams), step):  # sums of bits, some thousand shingles at once
            part = np.unpackbits(hashes[a : a + step].astype(">u8").view(np.uint8)).reshape(-1, BITS)
            lo, hi = np.searchsorted(first, a, side="right") - 1, np.searchsorted(first, a + len(part))
            cuts = np.maximum(first[lo:hi] - a, 0)
            count[lo:hi] += np.add.reduceat(part, cuts, axis=0, dtype=np.int32)
        out[some, k] = np.packbits(2 * count > size[:, None], axis=1).view(">u8").ravel()
    return out


def wide_limit(least: float) -> int:
    """Differing bits that the fingerprints of two sets of a likeness of ``least`` practically never exceed."""
    bits, p = BITS * WORDS, np.arccos(2 * least / (1 + least)) / np.pi
    return min(bits, int(np.ceil(bits * p + SPREAD * np.sqrt(bits * p * (1 - p)))))


def near_enough(one: np.ndarray, others: np.ndarray, shingles: np.ndarray, least: float) -> np.ndarray:
    """Which fingerprints may belong to near duplicates of one: pigeonring chains of segments, then the full distance.

    In a ring of m segments with at most ``limit`` differences, some segment begins a
    run whose sums of 1, 2 ... segments never exceed their share of the limit.
    """
    limit, m = wide_limit(least), BITS * WORDS // SEGMENT
    apart = np.bitwise_count((others ^ one).view(np.uint16)).astype(np.int16).reshape(len(others), m)
    sums, fits = np.zeros_like(apart), np.ones(apart.shape, bool)
    for length in range(1, CHAIN + 1):
        sums = sums + np.roll(apart, 1 - length, axis=1)
        fits &= sums * m <= length * limit
    alike = fits.any(1)
    alike[alike] = apart[alike].sum(1) <= limit
    return alike | (shingles < ENOUGH)


def ring(distance: int) -> tuple[list[int], list[int], list[int]]:
    """Low bit and width of each segment, and the differences allowed in runs of 1, 2, ... segments."""
    m = distance + 1
    widths = [BITS // m + (i < BITS % m) for i in range(m)]
    lows = [sum(widths[:i]) for i in range(m)]
    return lows, widths, [k * distance // m for k in range(1, m + 1)]


def probe_masks(widths: list[int], budgets: list[int]) -> list[int]:
    """Differences within a chain of segments that the budgets allow, as bit masks over the chain."""
    lows = [sum(widths[:i]) for i in range(len(widths))]
    most = budgets[len(widths) - 1]
    flips = [[sum(1 << (low + b) for b in c) for c in (c for n in range(most + 1) for c in combinations(range(w), n))] for low, w in zip(lows, widths, strict=True)]
    out = []
    for parts in product(*flips):
        total, fits = 0, True
        for part, budget in zip(parts, budgets, strict=False):
            total += part.bit_count()
            fits &= total <= budget
        if fits:
            out.append(sum(parts))
    return sorted(out, key=int.bit_count)


def close_pairs(bits: np.ndarray, key: np.ndarray, distance: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Index pairs i < j of equal keys, in pieces; in long runs only those within the distance, by blocks."""
    runs = P.split_sorted(key)
    short = np.ones(len(key), bool)
    for _, lo, hi in runs:
        if hi - lo > LONG_RUN:
            short[lo:hi] = False
            step = max(1, (1 << 19) // (hi - lo))
            for i0 in range(lo, hi, step):
                i1 = min(i0 + step, hi)
                i, j = np.nonzero(np.bitwise_count(bits[i0:i1, None] ^ bits[None, i0:hi]) <= distance)
                later = i < j
                yield i[later] + i0, j[later] + i0
    at = np.flatnonzero(short)
    for i, j in runs_of_pairs(key[at]):
        yield at[i], at[j]


def similar_classes(classes: DataFrame, distance: int = DISTANCE, chain: int | None = None) -> DataFrame:
    """(a, b): a spanning forest of the links between (bits, rep) classes at ``distance`` or fewer differing bits."""
    lows, widths, budgets = ring(distance)
    m = len(widths)
    n = classes.count()
    if chain is None:  # longer keys for more classes and for shorter segments; every chain finds the same links
        chain = next((k for k in range(1, 4) if n >> (13 + sum(widths[:k])) == 0), 3)
    turned = lambda i: F.shiftleft("bits", (BITS - lows[i]) % BITS).bitwiseOR(F.shiftrightunsigned("bits", lows[i])) if lows[i] else F.col("bits")
    starts, masks = [], []
    for i in range(m):
        own = [widths[(i + k) % m] for k in range(chain)]
        starts.append(F.struct(F.lit(i).alias("start"), turned(i).bitwiseAND(F.lit((1 << sum(own)) - 1)).alias("part")))
        masks.append(F.array(*[F.lit(x).cast("long") for x in probe_masks(own, budgets)]))
    rows = classes.where("rep is not null").select("bits", "rep", F.explode(F.array(*starts)).alias("s")).select("bits", "rep", "s.*")
    rows = rows.select("bits", "rep", "start", "part", F.posexplode(F.element_at(F.array(*masks), F.col("start") + 1)).alias("nth", "mask"))
    rows = rows.select("bits", "rep", "start", F.col("part").bitwiseXOR(F.col("mask")).alias("part"), (F.col("nth") > 0).alias("probe"))
    met = tiled(rows, ["start", "part"], "bits", TILE_ROWS)
    # one task takes many small buckets; a pair of tiles of a large bucket has a group of its own
    groups = max(16, 4 * int(classes.sparkSession.conf.get("spark.sql.shuffle.partitions")), n * m // 50_000)
    group = F.pmod(F.xxhash64("start", "part", "tile_a", "tile_b"), F.lit(groups))

    def link(table: pa.Table) -> pa.Table:
        table = table.sort_by([(c, "ascending") for c in ("start", "part", "tile_a", "tile_b", "bits", "probe")])
        col = {c: table.column(c).to_numpy() for c in ("start", "part", "tile_a", "tile_b", "_own", "bits", "rep", "probe")}
        key_new = np.zeros(len(table), bool)
        for c in ("start", "part", "tile_a", "tile_b"):
            key_new[1:] |= col[c][1:] != col[c][:-1]
        key = np.cumsum(key_new)
        names, vertex = np.unique(col["rep"], return_inverse=True)
        forest = Forest(len(names))
        bits = col["bits"].view(np.uint64)
        across = col["tile_a"] != col["tile_b"]
        for i, j in close_pairs(bits, key, distance):
            # tiles that differ meet each other only; two probes never make a pair
            fits = (~across[i] | (col["_own"][i] != col["_own"][j])) & ~(col["probe"][i] & col["probe"][j])
            i, j = i[fits], j[fits]
            start = col["start"][i]
            apart = bits[i] ^ bits[j]
            sofar = np.zeros(len(i), np.int64)
            for k, budget in enumerate(budgets):
                segment = (start + k) % m
                low = np.array(lows, np.uint64)[segment]
                mask = (np.uint64(1) << np.array(widths, np.uint64)[segment]) - np.uint64(1)
                sofar = sofar + np.bitwise_count((apart >> low) & mask)
                fits = sofar <= budget
                i, j, start, apart, sofar = i[fits], j[fits], start[fits], apart[fits], sofar[fits]
            hit = np.bitwise_count(apart) <= distance
            forest.link(vertex[i[hit]], vertex[j[hit]])
        linked = np.flatnonzero(forest.label != np.arange(len(names)))
        return pa.table({"a": pa.array(names[linked], pa.int64()), "b": pa.array(names[forest.label[linked]], pa.int64())})

    return met.withColumn("_group", group).groupBy("_group").applyInArrow(link, "a long, b long").distinct()


def near_duplicates(docs: DataFrame, shingle: int = SHINGLE, distance: int = DISTANCE, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, fingerprint, component_id) of every document."""
    marked = cut_lineage(fingerprints(docs, shingle, key, text))
    classes = cut_lineage(marked.groupBy("bits").agg(F.min("key").alias("rep")))
    groups = components(similar_classes(classes, distance))
    of_class = classes.join(groups, classes["rep"] == groups["node"], "left").select("bits", F.coalesce("component", "rep").alias("component_id"))
    shown = F.lower(F.lpad(F.hex("bits"), 16, "0"))
    return marked.join(of_class, ["bits"]).select(F.col("key").alias(key), shown.alias("fingerprint"), "component_id")


def keep_one(docs: DataFrame, shingle: int = STAGE_SHINGLE, least: float = LEAST) -> DataFrame:
    """One document of each group of near duplicates, with all its columns: the one with the smallest doc_id.

    Of rows with an equal doc_id, one with the smallest text of the group's stays;
    rows with a null doc_id all stay and link with nobody; texts without a word are
    one group.
    """
    named = docs.where("doc_id is not null")
    near = cut_lineage(shingle_dedup.near_duplicates(named, wide_fingerprints, near_enough, shingle, least))
    kept = near.groupBy("group").agg(F.min("doc_id").alias("_kept")).select("_kept").distinct()
    gone = cut_lineage(near.select(F.col("doc_id").alias("_gone")).distinct().join(kept, F.col("_gone") == F.col("_kept"), "left_anti"))
    side = F.broadcast(gone) if gone.limit(FEW_IDS + 1).count() <= FEW_IDS else gone
    out = named.join(side, F.col("doc_id").cast("long") == F.col("_gone"), "left_anti")
    if near.groupBy("doc_id").count().where("count > 1").limit(1).count():
        name = fresh(docs.columns, "_nth")
        out = out.withColumn(name, F.row_number().over(Window.partitionBy("doc_id").orderBy("text"))).where(F.col(name) == 1).drop(name)
    return out.unionByName(docs.where("doc_id is null"))
