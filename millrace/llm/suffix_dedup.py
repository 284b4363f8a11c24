"""Suffix-array dedup: a logarithmic family of suffix-array indexes, in shards.

Texts are UTF-8 bytes.  A byte goes if a string of ``length`` bytes that covers
it also starts in a document with a smaller doc_id.

Two equal strings of ``length`` bytes have the same smallest ``SEED``-byte gram
(by hash), so suffixes are shared out by that gram: the bytes around it, a
*segment*, hold every start that it leads.  First, each block of documents asks
which of its seeds other blocks have; a suffix whose seed occurs in one document
only can't match.  Then the segments of repeated seeds go to shards.  A shard
takes them block by block as batches into a ``SuffixFamily``: the batch gets a
suffix array, is merge-scanned against the levels for matches of ``length``
bytes, and levels of like size merge geometrically.  Equal segments enter a
shard once.  Seeds with very many surroundings (common lines) are not kept
together: their suffixes are dealt out one by one, by their whole ``length``
bytes.

Defined results for odd input: a null or empty text has no bytes; documents
shorter than ``length`` lose nothing; rows with an equal doc_id belong to one
document and never match each other; a null doc_id comes after all others;
other columns are ignored; an empty table gives an empty result.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame

from millrace.llm import packed as P

LENGTH = 50
SEED = 24
#: A seed with so many surroundings in all blocks together is dealt out by whole strings.
WIDE_SEED = 8_192
BLOCK_BYTES = 8 << 20
CHUNK = 1 << 20
PIECE = 32
BATCH_BYTES = 256 << 10
#: Owner of the rows without a doc_id: they come after all others.
NOBODY = (1 << 63) - 1
SENT = "bucket long, block long, payload binary"
CUT = "bucket long, block long, known boolean, payload binary"


class SuffixFamily:
    """Suffix arrays, cut at ``length`` bytes, in levels that double in size.

    A level is a text, the sorted start positions of its suffixes, the first eight
    bytes of each as a number and, for each, the smallest owner of that string in the level.
    """

    def __init__(self, length: int = LENGTH):
        self.length = length
        self.levels: list[dict] = []

    def _keys(self, text: np.ndarray, at: np.ndarray) -> np.ndarray:
        """The first ``length`` bytes of each suffix; a closing 1 keeps zero bytes at the end."""
        rows = np.ones((len(at), self.length + 1), np.uint8)
        if len(at):
            rows[:, :-1] = np.lib.stride_tricks.sliding_window_view(text, self.length)[at]
        return rows.view(f"S{self.length + 1}").ravel()

    @staticmethod
    def _heads(keys: np.ndarray) -> np.ndarray:
        """The first eight bytes of keys, as numbers that sort like them."""
        raw = np.zeros((len(keys), 8), np.uint8)
        width = min(8, keys.dtype.itemsize)
        raw[:, :width] = keys.view(np.uint8).reshape(len(keys), -1)[:, :width]
        return raw.view(">u8").ravel().astype(np.uint64)

    def _level(self, text: np.ndarray, at: np.ndarray, owner: np.ndarray) -> tuple[dict, np.ndarray, np.ndarray]:
        """A level of the suffixes, by sorting them; its keys; and for each suffix the entry it belongs to."""
        keys = self._keys(text, at)
        order = np.lexsort((owner, keys)) if len(keys) else np.empty(0, np.int64)
        ranked = keys[order]
        new = np.ones(len(order), bool)
        new[1:] = ranked[1:] != ranked[:-1]
        entry = np.empty(len(order), np.int64)
        entry[order] = np.cumsum(new) - 1
        lead = order[new]
        return {"text": text, "at": at[lead], "head": self._heads(keys[lead]), "owner": owner[lead]}, keys[lead], entry

    def _find(self, level: dict, keys: np.ndarray, heads: np.ndarray) -> np.ndarray:
        """The entry of a level that each sorted key is, or -1: by heads, then by halving among equal heads."""
        low, high = np.searchsorted(level["head"], heads), np.searchsorted(level["head"], heads, side="right")
        end = high.copy()
        open_ = np.flatnonzero(low < high)
        while len(open_):
            middle = (low[open_] + high[open_]) // 2
            less = self._keys(level["text"], level["at"][middle]) < keys[open_]
            low[open_[less]], high[open_[~less]] = middle[less] + 1, middle[~less]
            open_ = open_[low[open_] < high[open_]]
        some = np.flatnonzero(low < end)
        some = some[self._keys(level["text"], level["at"][low[some]]) == keys[some]]
        out = np.full(len(keys), -1)
        out[some] = low[some]
        return out

    def _merge(self, a: dict, b: dict) -> dict:
        """Two levels as one: both are sorted, so that their entries only have to be counted past each other."""
        one, two = self._keys(a["text"], a["at"]), self._keys(b["text"], b["at"])
        place = np.searchsorted(one, two)
        same = one[np.minimum(place, len(one) - 1)] == two if len(one) else np.zeros(len(two), bool)
        owner = a["owner"].copy()
        owner[place[same]] = np.minimum(owner[place[same]], b["owner"][same])
        rest = np.flatnonzero(~same)
        mine = np.zeros(len(one) + len(rest), bool)
        mine[place[rest] + np.arange(len(rest))] = True  # where the second level's entries go
        out = {"text": np.concatenate([a["text"], b["text"]])}
        for name, left, right in (("at", a["at"], b["at"][rest] + len(a["text"])), ("head", a["head"], b["head"][rest]), ("owner", owner, b["owner"][rest])):
            merged_ = np.empty(len(mine), left.dtype)
            merged_[~mine], merged_[mine] = left, right
            out[name] = merged_
        return out

    def add(self, text: np.ndarray, at: np.ndarray, owner: np.ndarray) -> np.ndarray:
        """Index suffixes at ``at``; the smallest owner of each one's string, in this batch or before it."""
        level, keys, entry = self._level(text, at, owner)
        least = level["owner"].copy()
        for old in self.levels:
            found = self._find(old, keys, level["head"])
            hit = found >= 0
            least[hit] = np.minimum(least[hit], old["owner"][found[hit]])
        self.levels.append(level)
        while len(self.levels) > 1 and len(self.levels[-2]["at"]) <= 2 * len(self.levels[-1]["at"]):
            b, a = self.levels.pop(), self.levels.pop()
            self.levels.append(self._merge(a, b))
        return least[entry]


def segments(data: np.ndarray, offsets: np.ndarray, length: int, seed: int) -> tuple[np.ndarray, ...]:
    """Seed, first start, number of starts, row and content hash of every segment of a block's texts.

    A segment is a run of starts whose strings have the same smallest seed, cut
    at PIECE starts.  Long texts are read in chunks that overlap.
    """
    out: list[tuple[np.ndarray, ...]] = []
    total = len(data)
    step = CHUNK
    for a in range(0, total, step):
        b = min(total, a + step + length - 1)  # starts a .. a+step-1
        if b - a < length:
            break
        prefix = P.prefix_sums(data[a:b].astype(P.U64) + P.U64(1))
        least = P.sliding_min(P.grams(prefix, seed), length - seed + 1)
        row = np.searchsorted(offsets, np.arange(a, a + len(least)), side="right") - 1
        inside = np.arange(a, a + len(least)) + length <= offsets[row + 1]
        at = np.flatnonzero(inside)
        if not len(at):
            continue
        m, r = least[at], row[at]
        new = np.ones(len(at), bool)
        new[1:] = (m[1:] != m[:-1]) | (r[1:] != r[:-1]) | (at[1:] != at[:-1] + 1)
        first = np.flatnonzero(new)
        n = np.diff(np.r_[first, len(at)])
        pieces = -(-n // PIECE)
        which = np.repeat(np.arange(len(first)), pieces)
        nth = np.arange(len(which)) - np.repeat(np.cumsum(pieces) - pieces, pieces)
        begin = first[which] + nth * PIECE
        size = np.minimum(PIECE, first[which] + n[which] - begin)
        out.append((m[begin], at[begin] + a, size, r[begin], P.slices(prefix, at[begin], at[begin] + size + length - 1)))
    if not out:
        none = np.empty(0, np.int64)
        return np.empty(0, P.U64), none, none, none, np.empty(0, P.U64)
    return tuple(np.concatenate(x) for x in zip(*out, strict=True))


def remove_repeats(docs: DataFrame, length: int = LENGTH, block_bytes: int = BLOCK_BYTES, wide_seed: int = WIDE_SEED, batch_bytes: int = BATCH_BYTES, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, n_bytes, n_removed, n_spans, kept_sha256) of every document."""
    seed = min(SEED, length)
    shape = P.corpus_shape(docs, block_bytes, key, text)
    blocks, parts = P.ordered_blocks(docs, shape, key, text)
    # about one seed in 14 bytes; payloads of a bucket stay near 2 MB
    bits = max(0, int(np.ceil(np.log2(max(1, shape["bytes"] / 14 * 8 / (2 << 20))))))
    # segments are some 5 times the text; shards stay below 16 MB of it
    shards = max(1, int(np.ceil(shape["bytes"] * 5 / (16 << 20))))
    spread = max(parts, int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")))

    def ranked(m: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, list]:
        """Distinct mixed seeds in order, each segment's rank in them, counts, and runs by bucket."""
        mixed = P.mix(m, 3)
        distinct, rank, count = np.unique(mixed, return_inverse=True, return_counts=True)
        bucket = (distinct >> P.U64(64 - bits)).astype(np.int64) if bits else np.zeros(len(distinct), np.int64)
        return distinct, rank, count, P.split_sorted(bucket)

    def send(group_key: tuple, table: pa.Table) -> pa.Table:
        table, _ = P.sort_block(table)
        data, offsets = P.text_buffer(table.column("text"))
        distinct, _, count, runs = ranked(segments(data, offsets, length, seed)[0])
        few = np.minimum(count, 255).astype(np.uint8)
        short = (distinct << P.U64(bits)) >> P.U64(16)  # 48 bits beside the bucket's: a clash only sends a segment in vain
        high, low = (short >> P.U64(16)).astype(np.uint32), (short & P.U64(0xFFFF)).astype(np.uint16)
        return pa.table({"bucket": pa.array([r[0] for r in runs], pa.int64()), "block": pa.array([group_key[0].as_py()] * len(runs), pa.int64()), "payload": pa.array([P.pack(high[i:j], low[i:j], few[i:j]) for _, i, j in runs], pa.binary())})

    def answer(group_key: tuple, table: pa.Table) -> pa.Table:
        payloads = [P.unpack(p, np.uint32, np.uint16, np.uint8) for p in table.column("payload").to_pylist()]
        high, low, few = (np.concatenate(x) for x in zip(*payloads, strict=True))
        _, rank, blocks_with = np.unique((high.astype(np.uint64) << P.U64(16)) | low, return_inverse=True, return_counts=True)
        places = np.bincount(rank, weights=few)
        code = ((blocks_with > 1).astype(np.uint8) + (places > wide_seed) * 2).astype(np.uint8)[rank]
        parts_ = np.split(code, np.cumsum([len(p[0]) for p in payloads])[:-1])
        return pa.table({"bucket": pa.array([group_key[0].as_py()] * len(parts_), pa.int64()), "block": table.column("block"), "payload": pa.array([x.tobytes() for x in parts_], pa.binary())})

    def cut(group_key: tuple, table: pa.Table, answers: pa.Table) -> pa.Table:
        """The segments of repeated seeds, to shards; rows of kind -1 carry what the block knows itself."""
        table, rank_of_key = P.sort_block(table)
        block = group_key[0].as_py()
        data, offsets = P.text_buffer(table.column("text"))
        m, at, size, row, whole = segments(data, offsets, length, seed)
        _, rank, _, _ = ranked(m)
        codes = np.concatenate([np.frombuffer(p, np.uint8) for p in answers.sort_by("bucket").column("payload").to_pylist()]) if answers.num_rows else np.empty(0, np.uint8)
        doc = rank_of_key[row]
        owners = pc.fill_null(table.column("key"), NOBODY).to_numpy()
        low, high = np.full(len(codes), 1 << 62), np.full(len(codes), -1)
        np.minimum.at(low, rank, doc)
        np.maximum.at(high, rank, doc)
        use = (((codes & 1) > 0) | (low < high))[rank]
        wide = (codes[rank] & 2) > 0
        m, at, size, doc, row, wide, whole = m[use], at[use], size[use], doc[use], row[use], wide[use], whole[use]
        # a segment that an earlier document of this block has goes at once
        order = np.lexsort((doc, whole))
        new = np.ones(len(order), bool)
        new[1:] = whole[order][1:] != whole[order][:-1]
        owner = np.empty(len(order), np.int64)
        owner[order] = doc[order[new]][np.cumsum(new) - 1]
        later = doc > owner
        out: list[tuple[int, bool, bytes]] = []
        if later.any():
            out.append((block % shards, True, P.pack(*merged(row[later], at[later] - offsets[row[later]], size[later] + length - 1))))
        for pick, dealt in ((~later & ~wide, False), (~later & wide, True)):
            if not pick.any():
                continue
            a, s, r = at[pick], size[pick], row[pick]
            if dealt:  # one by one, by whole strings
                a, r, s = P.expand(a, s), np.repeat(r, s), np.ones(int(s.sum()), np.int64)
                name = P.slice_hashes(data, a, a + length)
            else:
                name = P.mix(m[pick], 5)
            shard = (name % P.U64(shards)).astype(np.int64)
            order = np.argsort(shard, kind="stable")
            for value, i, j in P.split_sorted(shard[order]):
                o = order[i:j]
                rows, nth = np.unique(r[o], return_inverse=True)
                out.append((value, False, P.pack((name[o] >> P.U64(32)).astype(np.uint32), nth.astype(np.int32), rows.astype(np.int32), owners[rows], (a[o] - offsets[r[o]]).astype(np.int32), s[o].astype(np.uint8), squeezed(data[P.expand(a[o], s[o] + length - 1)]))))
        return pa.table({"bucket": pa.array([x[0] for x in out], pa.int64()), "block": pa.array([block] * len(out), pa.int64()), "known": pa.array([x[1] for x in out], pa.bool_()), "payload": pa.array([x[2] for x in out], pa.binary())})

    def scan(group_key: tuple, table: pa.Table) -> pa.Table:
        """A shard's batches through its suffix family; the removed intervals of each block."""
        found: list[np.ndarray] = []  # block, row, start, size
        first: dict[bytes, int] = {}  # the segments that came, and their first owner
        lone: dict[int, bytes] = {}  # seeds with one segment so far: it waits outside the family
        family = SuffixFamily(length)
        texts: list[bytes] = []
        owners: list[int] = []
        asked: list[tuple[int, int, int]] = []

        def flush() -> None:
            if texts:
                data = np.frombuffer(b"".join(texts), np.uint8)
                sizes = np.array([len(x) - length + 1 for x in texts])
                begins = np.cumsum([0, *map(len, texts[:-1])])
                own = np.repeat(np.array(owners), sizes)
                hit = family.add(data, P.expand(begins, sizes), own) < own
                which = np.repeat(np.arange(len(texts)), sizes)[hit]
                block, row, at = np.array(asked)[which].T
                at = at + P.expand(np.zeros(len(sizes), np.int64), sizes)[hit]
                found.append(np.stack([block, row, at, np.full(len(at), length)])[:, block >= 0])
                for x in (texts, owners, asked):
                    x.clear()

        room = batch_bytes
        table = table.sort_by("block")
        for block, known, payload in zip(*(table.column(c).to_pylist() for c in ("block", "known", "payload")), strict=True):
            if known:
                r, a, n = P.unpack(payload, np.int32, np.int32, np.int32)
                found.append(np.stack([np.full(len(r), block), r, a, n]).astype(np.int64))
                continue
            name, nth, rows, owner_of, a, s, raw = P.unpack(payload, np.uint32, np.int32, np.int32, np.int64, np.int32, np.uint8, np.uint8)
            r = rows[nth]
            ends = np.cumsum(s.astype(np.int64) + length - 1).tolist()
            blob, begin, gone = pa.decompress(raw.tobytes(), ends[-1], "zstd", asbytes=True), 0, []
            for i, (end, owner, name_) in enumerate(zip(ends, owner_of[nth].tolist(), name.tolist(), strict=True)):
                segment, begin = blob[begin:end], end
                had, other = first.setdefault(segment, owner), lone.get(name_)
                if had < owner:
                    gone.append(i)
                elif other is None:
                    lone[name_] = segment
                elif other != segment:
                    if other:
                        texts.append(other)
                        owners.append(first[other])
                        asked.append((-1, 0, 0))
                        lone[name_] = b""
                    texts.append(segment)
                    owners.append(owner)
                    asked.append((block, int(r[i]), int(a[i])))
                    room -= len(segment)
            if gone:
                found.append(np.stack([np.full(len(gone), block), r[gone], a[gone], s[gone].astype(np.int64) + length - 1]))
            if room <= 0:
                flush()
                room = batch_bytes
        flush()
        every = np.concatenate(found, axis=1) if found else np.empty((4, 0), np.int64)
        every = every[:, np.argsort(every[0], kind="stable")]
        runs = P.split_sorted(every[0])
        return pa.table({"bucket": pa.array([group_key[0].as_py()] * len(runs), pa.int64()), "block": pa.array([x[0] for x in runs], pa.int64()), "payload": pa.array([P.pack(*merged(*every[1:, i:j])) for _, i, j in runs], pa.binary())})

    def apply(group_key: tuple, table: pa.Table, answers: pa.Table) -> pa.Table:
        table, _ = P.sort_block(table)
        data, offsets = P.text_buffer(table.column("text"))
        raw = data.tobytes()
        got = [P.unpack(p, np.int32, np.int32, np.int32) for p in answers.column("payload").to_pylist()]
        r, a, n = merged(*(np.concatenate(x) for x in zip(*got, strict=True))) if got else (np.empty(0, np.int32),) * 3
        bounds = np.searchsorted(r, np.arange(table.num_rows + 1)).tolist()
        base, a, n = offsets.tolist(), a.tolist(), n.tolist()
        removed, spans, kept = [], [], []
        for i in range(table.num_rows):
            lo, hi = bounds[i], bounds[i + 1]
            h, at = hashlib.sha256(), base[i]
            for k in range(lo, hi):
                h.update(raw[at : base[i] + a[k]])
                at = base[i] + a[k] + n[k]
            h.update(raw[at : base[i + 1]])
            removed.append(sum(n[lo:hi]))
            spans.append(hi - lo)
            kept.append(h.hexdigest())
        return pa.table({"key": table.column("key"), "n_bytes": pa.array(np.diff(offsets), pa.int64()), "n_removed": pa.array(removed, pa.int64()), "n_spans": pa.array(spans, pa.int64()), "kept_sha256": pa.array(kept, pa.string())})

    seeds = blocks.groupBy("block").applyInArrow(send, SENT)
    repeated = seeds.repartition(spread, "bucket").groupBy("bucket").applyInArrow(answer, SENT)
    cuts = blocks.groupBy("block").cogroup(repeated.repartition(parts, "block").groupBy("block")).applyInArrow(cut, CUT)
    removed = cuts.repartition(spread, "bucket").groupBy("bucket").applyInArrow(scan, SENT)
    out = blocks.groupBy("block").cogroup(removed.repartition(parts, "block").groupBy("block")).applyInArrow(apply, "key long, n_bytes long, n_removed long, n_spans long, kept_sha256 string")
    return out.withColumnRenamed("key", key) if key != "key" else out


def squeezed(raw: np.ndarray) -> np.ndarray:
    """Bytes compressed better than the shuffle does it."""
    return np.frombuffer(pa.compress(raw.tobytes(), "zstd", asbytes=True), np.uint8)


def merged(row: np.ndarray, at: np.ndarray, size: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Union of intervals in each row, as maximal intervals in order."""
    if not len(row):
        return (np.empty(0, np.int32),) * 3
    row, at, size = row.astype(np.int64), at.astype(np.int64), size.astype(np.int64)
    order = np.lexsort((at, row))
    lift = row[order] << 32
    a, b = at[order] + lift, at[order] + size[order] + lift
    reach = np.maximum.accumulate(b)
    new = np.ones(len(a), bool)
    new[1:] = a[1:] > reach[:-1]
    first = np.flatnonzero(new)
    last = np.r_[first[1:] - 1, len(a) - 1]
    begin, end = a[first], reach[last]
    r = begin >> 32
    return r.astype(np.int32), (begin - (r << 32)).astype(np.int32), (end - begin).astype(np.int32)


def digest(docs: DataFrame) -> DataFrame:
    """The contract's columns of ``remove_repeats``."""
    return remove_repeats(docs).select("doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256")
