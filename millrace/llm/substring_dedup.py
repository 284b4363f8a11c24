"""Substring dedup: Rabin-Karp hashes of every fixed-length token window.

Every window of ``window`` consecutive words of a document gets a rolling
hash.  The windows of a block go to hash buckets once per distinct hash; a
bucket learns which block holds the first place of each hash and tells the
others.  Repeated windows, one after the other, merge into maximal removal
intervals, which are cut out of the texts.

Defined results for odd input: a null or empty text has no words and hashes as
the empty string; documents shorter than a window lose nothing; rows with an
equal doc_id count as one document, in the order of their texts' hashes, and so
do those without one, after all others; other columns are ignored; an empty table gives an
empty result.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from millrace.llm import packed as P

WINDOW = 20
BLOCK_BYTES = 4 << 20
SENT = "bucket long, block long, payload binary"


def block_windows(table: pa.Table, window: int) -> dict:
    """Words, window hashes and window starts of a block; windows in reading order."""
    data, offsets = P.text_buffer(table.column("text"))
    starts, ends, doc = P.words_of(data, offsets)
    h = P.slice_hashes(data, starts, ends)
    first = P.grams(P.prefix_sums(h), window)
    second = P.mix(first ^ P.grams(P.prefix_sums(P.mix(h, 7)), window), 11)
    whole = np.flatnonzero(doc[: len(first)] == doc[window - 1 :]) if len(first) else np.empty(0, np.int64)
    return {"data": data, "offsets": offsets, "starts": starts, "ends": ends, "doc": doc, "at": whole, "key": first[whole], "spread": second[whole]}


def bucket_order(w: dict, bits: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Distinct windows by (bucket, key): bucket and key of each, its first window, and each window's rank."""
    bucket = (w["spread"] >> P.U64(64 - bits)).astype(np.int64) if bits else np.zeros(len(w["key"]), np.int64)
    order = np.lexsort((w["key"], bucket))
    b, k = bucket[order], w["key"][order]
    new = np.ones(len(order), bool)
    new[1:] = (b[1:] != b[:-1]) | (k[1:] != k[:-1])
    rank = np.empty(len(order), np.int64)
    rank[order] = np.cumsum(new) - 1
    at = np.flatnonzero(new)
    return b[at], k[at], order[at], rank


def removed_words(n: int, at: np.ndarray, window: int) -> np.ndarray:
    """Which of n words lie in a window that starts at one of ``at``."""
    edge = np.zeros(n + 1, np.int32)
    edge[at] += 1  # starts are distinct
    np.subtract.at(edge, at + window, 1)
    return np.cumsum(edge[:-1]) > 0


def kept_texts(w: dict, gone: np.ndarray, rows: int) -> list[bytes]:
    """Each row's kept words joined by one space."""
    raw = w["data"].tobytes()
    bounds = np.searchsorted(w["doc"], np.arange(rows + 1))
    out = []
    for i in range(rows):
        a, b = bounds[i], bounds[i + 1]
        if not gone[a:b].any():
            out.append(b" ".join(raw[w["offsets"][i] : w["offsets"][i + 1]].split()))
        else:
            keep = np.flatnonzero(~gone[a:b]) + a
            out.append(b" ".join([raw[s:e] for s, e in zip(w["starts"][keep].tolist(), w["ends"][keep].tolist(), strict=True)]))
    return out


def remove_repeated_windows(docs: DataFrame, window: int = WINDOW, block_bytes: int = BLOCK_BYTES, key: str = "doc_id", text: str = "text", carry: bool = False) -> DataFrame:
    """(key, n_words, n_removed, kept_sha256) of every document; with ``carry`` also kept_text and row, all its columns.

    A word goes if a window that covers it has a word sequence that also starts
    earlier: in a document with a smaller key, or before it in the same one.
    """
    shape = P.corpus_shape(docs, block_bytes, key, text)
    row = F.struct(*[docs[c] for c in docs.columns if c != text]).alias("row")
    blocks, parts = P.ordered_blocks(docs, shape, key, text, (row,) if carry else ())
    # about one hash a word, some 6 bytes of text; payloads of a bucket stay near 4 MB
    bits = max(0, int(np.ceil(np.log2(max(1, shape["bytes"] / 6 * 8 / (4 << 20))))))

    def send(group_key: tuple, table: pa.Table) -> pa.Table:
        table, _ = P.sort_block(table)
        b, k, _, _ = bucket_order(block_windows(table, window), bits)
        runs = P.split_sorted(b)
        return pa.table({"bucket": pa.array([r[0] for r in runs], pa.int64()), "block": pa.array([group_key[0].as_py()] * len(runs), pa.int64()), "payload": pa.array([k[i:j].tobytes() for _, i, j in runs], pa.binary())})

    def answer(group_key: tuple, table: pa.Table) -> pa.Table:
        table = table.sort_by("block")
        blocks_, payloads = table.column("block").to_pylist(), table.column("payload").to_pylist()
        keys = [np.frombuffer(p, np.uint64) for p in payloads]
        every = np.concatenate(keys)
        order = np.argsort(every, kind="stable")  # blocks ascend within equal keys
        same = every[order]
        later = np.zeros(len(every), bool)
        later[order[1:]] = same[1:] == same[:-1]
        cuts = np.cumsum([len(k) for k in keys])[:-1]
        flags = [np.packbits(x).tobytes() for x in np.split(later, cuts)]
        return pa.table({"bucket": pa.array([group_key[0].as_py()] * len(flags), pa.int64()), "block": pa.array(blocks_, pa.int64()), "payload": pa.array(flags, pa.binary())})

    def apply(group_key: tuple, table: pa.Table, answers: pa.Table) -> pa.Table:
        table, rank_of_key = P.sort_block(table)
        w = block_windows(table, window)
        b, _, first, rank = bucket_order(w, bits)
        got = answers.sort_by("bucket").column("payload").to_pylist()
        later = [np.unpackbits(np.frombuffer(p, np.uint8), count=j - i).astype(bool) for p, (_, i, j) in zip(got, P.split_sorted(b), strict=True)]
        seen = np.concatenate(later) if later else np.empty(0, bool)
        lead = np.zeros(len(rank), bool)
        lead[first] = True
        again = seen[rank] | ~lead
        gone = removed_words(len(w["starts"]), w["at"][again], window)
        rows = table.num_rows
        kept = kept_texts(w, gone, rows)
        n = np.bincount(w["doc"], minlength=rows)
        r = np.bincount(w["doc"][gone], minlength=rows)
        out = {"key": table.column("key"), "n_words": pa.array(n, pa.int64()), "n_removed": pa.array(r, pa.int64()), "kept_sha256": pa.array([hashlib.sha256(k).hexdigest() for k in kept], pa.string())}
        if carry:
            out |= {"kept_text": pa.array([k.decode() for k in kept], pa.string()), "text": table.column("text"), "row": table.column("row")}
        return pa.table(out)

    schema = T.StructType.fromDDL("key long, n_words long, n_removed long, kept_sha256 string")
    if carry:
        schema = schema.add("kept_text", "string").add("text", "string").add("row", blocks.schema["row"].dataType)
    sent = blocks.groupBy("block").applyInArrow(send, SENT)
    spread = max(parts, int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    answers = sent.repartition(spread, "bucket").groupBy("bucket").applyInArrow(answer, SENT)
    out = blocks.groupBy("block").cogroup(answers.repartition(parts, "block").groupBy("block")).applyInArrow(apply, schema)
    return out.withColumnRenamed("key", key) if key != "key" else out


def cut_repeats(docs: DataFrame, window: int = WINDOW, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """The documents with their repeated windows cut out, all columns kept.

    Texts that lose nothing stay as they are; others are their kept words joined
    by one space, and n_chars follows; documents that lose every word go.
    """
    cut = remove_repeated_windows(docs, window, block_bytes, carry=True).where("n_removed = 0 or n_removed < n_words")
    text = F.when(F.col("n_removed") == 0, F.col("text")).otherwise(F.col("kept_text"))
    columns = {c: F.col(f"row.`{c}`") for c in docs.columns if c != "text"} | {"text": text}
    if "n_chars" in columns:
        columns["n_chars"] = F.when(F.col("n_removed") == 0, columns["n_chars"]).otherwise(F.length(text)).cast(docs.schema["n_chars"].dataType)
    return cut.select(*[columns[c].alias(c) for c in docs.columns])


def digest(docs: DataFrame) -> DataFrame:
    """The contract's columns of ``remove_repeated_windows``."""
    return remove_repeated_windows(docs).select("doc_id", "n_words", "n_removed", F.col("kept_sha256"))
