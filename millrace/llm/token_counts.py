"""Token counts by dynamic programming over a trie of pre-tokens.

A text falls into pre-tokens: each word with the white space before it, and any
white space at the end.  A tokenizer's vocabulary, ranked by how early a token
was learned, is read as a unigram model (a token's weight is 1 / (rank + 256)).
A pre-token's count is the number of tokens in its likeliest segmentation.

Distinct pre-tokens of a batch stand in a trie, walked in sorted order: the
forward scores of a prefix are computed once and shared by all pre-tokens below
it; the count is read at the terminal node.  Counts of pre-tokens seen before
are kept in a table of bounded size.

Defined results for odd input: a null or empty text has no tokens; rows with an
equal doc_id are counted each for itself; a null doc_id stays null; other
columns are ignored; an empty table gives an empty result.
"""

from __future__ import annotations

import base64
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from millrace.llm import packed as P
from millrace.llm.quality import pieces

VOCABULARY = "/opt/tokenizers/byte_bpe_50k.tiktoken"
#: Pre-tokens whose counts a task keeps from one batch to the next.
KEPT = 200_000


def read_vocabulary(path: str) -> dict[bytes, int]:
    """Tokens and ranks of a file with lines of a base64 token and a rank."""
    with open(path, "rb") as f:
        return {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}


class PrefixTrie:
    """Best segmentations of pre-tokens, with the forward scores of shared prefixes computed once."""

    def __init__(self, ranks: dict[bytes, int]):
        total = sum(1 / (r + 256) for r in ranks.values())
        self.weight = {t: -math.log((r + 256) * total) for t, r in ranks.items()}
        longest = min(self.weight.values()) - 10
        for b in range(256):  # any byte can stand alone
            self.weight.setdefault(bytes([b]), longest)
        self.tails = {t[i:] for t in self.weight for i in range(len(t))}

    def counts(self, tokens: list[bytes]) -> dict[bytes, int]:
        """Tokens in the best segmentation of each distinct pre-token."""
        weight, tails = self.weight, self.tails
        out: dict[bytes, int] = {b"": 0}
        score, number = [0.0], [0]
        before = b""
        for token in sorted(tokens):  # the trie in depth-first order
            shared, most = 0, min(len(before), len(token))
            while shared < most and before[shared] == token[shared]:
                shared += 1
            del score[shared + 1 :], number[shared + 1 :]
            for end in range(shared + 1, len(token) + 1):
                best, n, start = -math.inf, 0, end - 1
                while start >= 0:
                    tail = token[start:end]
                    if tail not in tails:
                        break
                    w = weight.get(tail)
                    if w is not None:
                        value = score[start] + w
                        if value > best or value == best and number[start] + 1 < n:
                            best, n = value, number[start] + 1
                    start -= 1
                score.append(best)
                number.append(n)
            out[token] = number[-1]
            before = token
        return out


def pre_tokens(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start, end and row of every pre-token, in order; they cover all bytes."""
    _, ends, row = P.words_of(data, offsets)
    rows = len(offsets) - 1
    n = np.bincount(row, minlength=rows)
    last = offsets[:-1].copy()
    full = n > 0
    last[full] = ends[np.cumsum(n)[full] - 1]
    tail = np.flatnonzero(offsets[1:] > last)  # white space after the last word
    ends, row = np.r_[ends, offsets[1:][tail]], np.r_[row, tail]
    order = np.argsort(ends, kind="stable")
    ends, row = ends[order], row[order]
    starts = np.r_[0, ends[:-1]][: len(ends)]
    return starts, ends, row


def count_tokens(docs: DataFrame, vocabulary: str = VOCABULARY, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, n_bytes, n_pretokens, n_tokens) of every document, in one pass without a shuffle."""
    shared = docs.sparkSession.sparkContext.broadcast(read_vocabulary(vocabulary))

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        trie = PrefixTrie(shared.value)
        known: dict[bytes, int] = {}
        for batch in batches:
            sums = [np.empty((0, 3), np.int64)]
            for a, b, data, offsets in pieces(batch, 1, 8 << 20):
                starts, ends, row = pre_tokens(data, offsets)
                h = P.slice_hashes(data, starts, ends)
                _, first, inverse = np.unique(h, return_index=True, return_inverse=True)
                raw = data.tobytes()
                tokens = [raw[s:e] for s, e in zip(starts[first].tolist(), ends[first].tolist(), strict=True)]
                fresh = trie.counts([t for t in tokens if t not in known])
                if len(known) + len(fresh) <= KEPT:
                    known.update(fresh)
                else:
                    known = {t: known[t] for t in tokens if t in known}  # those in use stay
                number = np.array([known[t] if t in known else fresh[t] for t in tokens], np.int64)
                sums.append(np.stack([np.diff(offsets), np.bincount(row, minlength=b - a), np.bincount(row, number[inverse] if len(row) else None, minlength=b - a).astype(np.int64)], axis=1))
            every = np.concatenate(sums)
            yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(every[:, i]) for i in range(3))], ["key", "n_bytes", "n_pretokens", "n_tokens"])

    out = docs.select(F.col(key).cast("long").alias("key"), F.col(text).cast("string")).mapInArrow(each, "key long, n_bytes long, n_pretokens long, n_tokens long")
    return out.withColumnRenamed("key", key)
