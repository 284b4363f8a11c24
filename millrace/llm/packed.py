"""Shared building blocks: ordered document blocks and packed numpy payloads.

Windows over whole texts outnumber documents by a factor of thousands, so the
substring operators do not ship one row per window.  Documents are cut into
*blocks*: contiguous ranges of (doc_id, hash of the text) of a few MB.  A block
sends one binary payload of sorted hashes per bucket, the bucket answers each
block, and the block - regrouped over the same exchange - applies the answers to
its texts.  A value that is hot in the corpus occurs at most once per block in a
payload, so no key gathers more rows than there are blocks.

Where blocks begin is measured, not guessed: (doc_id, hash, bytes) of every row
are sorted over the cluster and the bytes added up, so that ids with gaps, one
hot id or no ids at all make blocks of like size.  Only rows alike in id and
text can't be parted.
"""

from __future__ import annotations

import math
import struct
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from millrace.llm.components import cut_lineage

U64 = np.uint64
BASE = 0x9E3779B97F4A7C15 | 1
MASK = (1 << 64) - 1


def mix(h: np.ndarray, seed: int = 0) -> np.ndarray:
    """Finalise 64-bit hashes so that every output bit depends on every input bit."""
    with np.errstate(over="ignore"):
        h = h ^ U64(seed & MASK)
        h = (h ^ (h >> U64(33))) * U64(0xFF51AFD7ED558CCD)
        h = (h ^ (h >> U64(33))) * U64(0xC4CEB9FE1A85EC53)
        return h ^ (h >> U64(33))


class Powers:
    """Powers of an odd base modulo 2**64 and their inverses, grown on demand."""

    def __init__(self, base: int = BASE):
        self.base, self.inverse = base & MASK, pow(base, -1, 1 << 64)
        self.up = np.ones(1, U64)
        self.down = np.ones(1, U64)

    @staticmethod
    def _grow(old: np.ndarray, base: int, n: int) -> np.ndarray:
        out = old
        with np.errstate(over="ignore"):
            while len(out) < n:
                out = np.concatenate([out, out * U64(pow(base, len(out), 1 << 64))])
        return out

    def get(self, n: int) -> tuple[np.ndarray, np.ndarray]:
        if len(self.up) < n:
            self.up = self._grow(self.up, self.base, n)
            self.down = self._grow(self.down, self.inverse, n)
        return self.up[:n], self.down[:n]


POWERS = Powers()


def prefix_sums(values: np.ndarray) -> np.ndarray:
    """Rabin-Karp prefix sums: gram(i, k) = (out[i+k] - out[i]) * base**-i modulo 2**64."""
    up, _ = POWERS.get(len(values))
    out = np.empty(len(values) + 1, U64)
    out[0] = 0
    with np.errstate(over="ignore"):
        np.cumsum(values.astype(U64, copy=False) * up, out=out[1:])
    return out


def grams(prefix: np.ndarray, k: int) -> np.ndarray:
    """Hash of every k consecutive values, from ``prefix_sums``."""
    n = len(prefix) - k
    if n <= 0:
        return np.empty(0, U64)
    _, down = POWERS.get(n)
    with np.errstate(over="ignore"):
        return mix((prefix[k:] - prefix[:n]) * down)


def slices(prefix: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Hash of values[start:end] for each pair, independent of where the slice lies."""
    if not len(starts):
        return np.empty(0, U64)
    _, down = POWERS.get(int(starts.max()) + 1)
    with np.errstate(over="ignore"):
        return mix(((prefix[ends] - prefix[starts]) * down[starts]) ^ ((ends - starts).astype(U64) << U64(48)))


def sliding_min(h: np.ndarray, w: int) -> np.ndarray:
    """Minimum of every w consecutive values, by doubling."""
    if len(h) < w:
        return np.empty(0, h.dtype)
    span, out = 1, h
    while span * 2 <= w:
        out = np.minimum(out[:-span], out[span:])
        span *= 2
    if span < w:
        n = len(h) - w + 1
        out = np.minimum(out[:n], out[w - span : w - span + n])
    return out


def text_buffer(column: pa.ChunkedArray | pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """UTF-8 bytes of a string column and the n+1 offsets into them; null counts as empty."""
    if isinstance(column, pa.ChunkedArray):
        column = pa.concat_arrays(column.chunks) if column.num_chunks else pa.array([], column.type)
    if column.null_count:
        column = pc.fill_null(column, "")
    kind = np.int64 if pa.types.is_large_string(column.type) else np.int32
    _, offsets, data = column.buffers()
    if offsets is None or not len(column):
        return np.empty(0, np.uint8), np.zeros(len(column) + 1, np.int64)
    at = np.frombuffer(offsets, kind)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    raw = np.frombuffer(data, np.uint8) if data is not None else np.empty(0, np.uint8)
    return raw[at[0] : at[-1]], at - at[0]


#: 1 for the bytes that end a word: space and the controls from tab to carriage return.
SPACE = np.zeros(256, bool)
SPACE[[0x20, *range(0x09, 0x0E)]] = True


def words_of(data: np.ndarray, offsets: np.ndarray, apart: np.ndarray = SPACE) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start, end and document of every maximal run of bytes not in ``apart``; words never cross documents."""
    if not len(data):
        empty = np.empty(0, np.int64)
        return empty, empty, empty
    solid = ~apart[data]
    first = solid.copy()
    first[1:] &= ~solid[:-1]
    cuts = offsets[1:-1]
    cuts = cuts[cuts < len(data)]
    first[cuts] = solid[cuts]
    last = solid.copy()
    last[:-1] &= ~solid[1:]
    cuts = offsets[1:-1] - 1
    cuts = cuts[cuts >= 0]
    last[cuts] = solid[cuts]
    starts, ends = np.flatnonzero(first), np.flatnonzero(last) + 1
    return starts, ends, np.searchsorted(offsets, starts, side="right") - 1


def slice_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, span: int = 1 << 20) -> np.ndarray:
    """64-bit hash of data[start:end] for rising starts, in pieces so that temporaries stay small."""
    out = np.empty(len(starts), U64)
    i = 0
    while i < len(starts):
        a = int(starts[i])
        j = int(np.searchsorted(starts, a + span))
        b = int(ends[i:j].max())
        out[i:j] = slices(prefix_sums(data[a:b].astype(U64) + U64(1)), starts[i:j] - a, ends[i:j] - a)
        i = j
    return out


def pack(*arrays: np.ndarray) -> bytes:
    """Arrays as one payload: their byte lengths, then their bytes."""
    parts = [np.ascontiguousarray(a).tobytes() for a in arrays]
    return struct.pack(f"<{len(parts)}q", *map(len, parts)) + b"".join(parts)


def unpack(payload: bytes, *kinds: type) -> list[np.ndarray]:
    sizes = struct.unpack_from(f"<{len(kinds)}q", payload)
    at, out = 8 * len(kinds), []
    for n, kind in zip(sizes, kinds, strict=True):
        out.append(np.frombuffer(payload, kind, n // np.dtype(kind).itemsize, at))
        at += n
    return out


#: Blocks that a corpus is cut into at most; beyond it, blocks grow. The driver and every task hold 16 bytes for each.
MOST_BLOCKS = 1 << 20
#: Bytes that a row counts besides its text.
ROW_BYTES = 64


def place_names(key: pa.Array, mark: pa.Array) -> np.ndarray:
    """(key, hash) as 17 bytes that sort like them, null keys last."""
    missing = pc.is_null(key)
    parts = (pc.fill_null(key, 0).to_numpy(zero_copy_only=False), mark.to_numpy(zero_copy_only=False))
    big = [(x.astype(np.int64).view(U64) ^ U64(1 << 63)).astype(">u8").view(np.uint8).reshape(-1, 8) for x in parts]
    big[0] = np.where(missing.to_numpy(zero_copy_only=False)[:, None], np.uint8(0), big[0])
    return np.concatenate([missing.to_numpy(zero_copy_only=False).astype(np.uint8)[:, None] + np.uint8(1), *big], axis=1).view("V17").ravel()


def sorted_places(names: np.ndarray) -> np.ndarray:
    """As strings that numpy can search; a closing 1 keeps zero bytes at the end."""
    raw = np.ones((len(names), 18), np.uint8)
    raw[:, :17] = names.view(np.uint8).reshape(-1, 17)
    return raw.view("S18").ravel()


def corpus_shape(docs: DataFrame, block_bytes: int, key: str = "doc_id", text: str = "text") -> dict:
    """Rows and bytes of the corpus, the place (key, hash of the text, bytes) of every row, and the first place of each block of some ``block_bytes``."""
    place = docs.select(F.col(key).cast("long").alias("key"), F.xxhash64(F.coalesce(F.col(text).cast("string"), F.lit(""))).alias("mark"), F.coalesce(F.octet_length(F.col(text)), F.lit(0)).cast("long").alias("n"))
    light = cut_lineage(place)
    row = light.agg(F.count(F.lit(1)).alias("rows"), F.coalesce(F.sum("n"), F.lit(0)).alias("bytes")).first()
    total = int(row["bytes"]) + ROW_BYTES * int(row["rows"])
    size = max(block_bytes, math.ceil(total / MOST_BLOCKS))
    order = [F.col("key").asc_nulls_last(), F.col("mark")]

    def begin(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """First place and bytes of each run of some half a block; the driver joins runs to blocks."""
        total, label, last, found, offsets = 0, -1, None, [], []
        for batch in batches:
            if not batch.num_rows:
                continue
            names, n = place_names(batch.column(0), batch.column(1)), batch.column(2).to_numpy() + ROW_BYTES
            ends = total + np.cumsum(n)
            labels = (ends - n) // max(1, size // 2)
            new = labels != np.r_[label, labels[:-1]]
            new[1:] &= names[1:] != names[:-1]
            new[0] &= names[0].tobytes() != last
            at = np.flatnonzero(new)
            found += [names[k].tobytes() for k in at.tolist()]
            offsets.append((ends - n)[at])
            total, label, last = int(ends[-1]), labels[-1], names[-1].tobytes()
        sizes = np.diff(np.r_[np.concatenate(offsets), total]) if found else np.empty(0, np.int64)
        yield pa.RecordBatch.from_arrays([pa.array(found, pa.binary()), pa.array(sizes, pa.int64())], ["name", "n"])

    parts = min(max(1, math.ceil(total / size)), int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    measured = light.repartitionByRange(parts, *order).sortWithinPartitions(*order).mapInArrow(begin, "name binary, n long").toArrow()
    runs = sorted(zip(measured.column("name").to_pylist(), measured.column("n").to_pylist(), strict=True))
    begins, held = [], size
    for name, n in runs:
        if held + n > size:
            begins.append(name)
            held = 0
        held += n
    return {"rows": int(row["rows"]), "bytes": int(row["bytes"]), "begins": np.frombuffer(b"".join(begins), "V17"), "places": light}


def in_blocks(rows: DataFrame, shape: dict) -> DataFrame:
    """``rows``, whose first columns are key and mark (the text's hash), with their block in front; blocks rise with (key, mark)."""
    begins = sorted_places(shape["begins"])

    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at = np.searchsorted(begins, sorted_places(place_names(batch.column(0), batch.column(1))), side="right") - 1
            yield pa.RecordBatch.from_arrays([pa.array(np.maximum(at, 0), pa.int64()), *batch.columns], ["block", *batch.schema.names])

    return rows.mapInArrow(find, T.StructType([T.StructField("block", T.LongType()), *rows.schema.fields]))


def placed(docs: DataFrame, key: str = "doc_id", text: str = "text", more: tuple = ()) -> DataFrame:
    """(key, mark, text, *more) of every row."""
    mark = F.xxhash64(F.coalesce(F.col(text).cast("string"), F.lit("")))
    return docs.select(F.col(key).cast("long").alias("key"), mark.alias("mark"), F.col(text).cast("string").alias("text"), *more)


def block_parts(docs: DataFrame, shape: dict) -> int:
    """Partitions that blocks are dealt to, two or so to each."""
    return max(int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")), math.ceil(len(shape["begins"]) / 2))


def ordered_blocks(docs: DataFrame, shape: dict, key: str = "doc_id", text: str = "text", more: tuple = ()) -> tuple[DataFrame, int]:
    """(block, key, mark, text, *more) dealt out by block, and the number of partitions."""
    parts = block_parts(docs, shape)
    return in_blocks(placed(docs, key, text, more), shape).repartition(parts, "block"), parts


def sort_block(table: pa.Table) -> tuple[pa.Table, np.ndarray]:
    """A block's rows by key, hash and text; and each row's dense rank by key (nulls last)."""
    table = table.sort_by([("key", "ascending"), ("mark", "ascending"), ("text", "ascending")])
    key = table.column("key")
    missing = np.asarray(pc.is_null(key).combine_chunks().to_numpy(zero_copy_only=False))
    values = pc.fill_null(key, 0).to_numpy()
    new = np.ones(len(values), bool)
    new[1:] = (values[1:] != values[:-1]) | (missing[1:] != missing[:-1])
    return table, np.cumsum(new) - 1


def expand(at: np.ndarray, size: np.ndarray) -> np.ndarray:
    """at, at+1, ... at+size-1 of every pair, one after the other."""
    ends = np.cumsum(size)
    return np.arange(int(ends[-1]) if len(ends) else 0) + np.repeat(at - (ends - size), size)


def split_sorted(bucket: np.ndarray) -> list[tuple[int, int, int]]:
    """(value, from, to) for each run of a sorted array."""
    if not len(bucket):
        return []
    at = np.flatnonzero(np.r_[True, bucket[1:] != bucket[:-1]])
    return list(zip(bucket[at].tolist(), at.tolist(), np.r_[at[1:], len(bucket)].tolist(), strict=True))
