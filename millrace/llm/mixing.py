"""Mixing sources to target weights by the cube method.

Each source gets a target share of the words.  A document is taken a whole
number of times, plus once more with the fraction that is left: its inclusion
probability.  The cube method moves the probabilities of a few documents at a
time through the null space of the balancing constraints (tokens and documents),
at random but with the right expectation, until one of them is 0 or 1.  It runs
over salted parts of a source at once; the two or so documents that each part
leaves between 0 and 1 meet again in the next round, and the last few land.

Defined results for odd input: a null or empty text has size 0 and is taken as 0
words; null sources are one source, last in order; rows with an equal doc_id, or
without one, are drawn each for itself; other columns are ignored (and kept by
``mixed_documents``); an empty table gives an empty result.  The draw depends on
the rows (doc_id and text) and the seed only.
"""

from __future__ import annotations

import math
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from millrace.llm.components import cut_lineage, fresh

WORD = r"[^\x20\x09-\x0D]+"
WEIGHTS = (5.0, 2.0, 1.0)
SHARE = 1.5
MOST = 2.0
SEED = 42
#: Documents of one part of a source in a round.
PART = 4_000
#: Documents above this share of their part's sizes settle before the others.
LARGE = 0.003
#: Up to so many bytes of sources, their targets are broadcast; beyond it, they are joined by a shuffle.
BROADCAST_BYTES = 8 << 20


def ranked(rows: DataFrame, column: str) -> DataFrame:
    """``rows`` with ``nth`` from 0 by the code points of a column, nulls last; sorted over the cluster, one offset a partition on the driver."""
    order = F.col(column).asc_nulls_last()
    parts = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    dealt = rows.repartitionByRange(parts, order).sortWithinPartitions(order)
    placed = cut_lineage(dealt.withColumn("_id", F.monotonically_increasing_id()))  # partition and place in it
    here = F.shiftright("_id", 33)
    sizes = sorted((r["part"], r["n"]) for r in placed.groupBy(here.alias("part")).agg(F.count(F.lit(1)).alias("n")).collect())
    offsets, total = [], 0
    for part, n in sizes:
        offsets += [F.lit(part).cast("long"), F.lit(total).cast("long")]
        total += n
    before = F.create_map(*offsets)[here] if offsets else F.lit(0).cast("long")
    return placed.withColumn("nth", before + F.col("_id").bitwiseAND((1 << 33) - 1)).drop("_id")


def source_targets(sized: DataFrame, weights: tuple = WEIGHTS, share: float = SHARE, most: float = MOST) -> DataFrame:
    """(source, source_size, docs, target): shares by weight, capped, the excess reshared.

    The loop holds three sums on the driver, however many sources there are.
    """
    totals = sized.groupBy("source").agg(F.sum("size").alias("source_size"), F.count(F.lit(1)).alias("docs"))
    wheel = F.array(*[F.lit(float(w)) for w in weights])
    totals = cut_lineage(ranked(totals, "source").withColumn("weight", F.element_at(wheel, (F.col("nth") % len(weights) + 1).cast("int"))))
    cap = F.col("source_size") * F.lit(float(most))
    whole = float(totals.agg(F.coalesce(F.sum("source_size"), F.lit(0))).first()[0]) * share
    level, capped = 0.0, -1
    while True:
        full = F.col("weight") * F.lit(level) > cap
        row = totals.agg(F.count_if(full).alias("n"), F.coalesce(F.sum(F.when(full, cap)), F.lit(0.0)).alias("fixed"), F.coalesce(F.sum(F.when(~full, F.col("weight"))), F.lit(0.0)).alias("free")).first()
        if row["n"] == capped:
            break
        capped = row["n"]
        if row["free"] <= 0:
            break
        level = max(level, (whole - row["fixed"]) / row["free"])
    return totals.select("source", "source_size", "docs", F.least(F.col("weight") * F.lit(level), cap).alias("target"))


def flight(p: np.ndarray, z: np.ndarray, rng: np.random.Generator) -> np.ndarray:
    """Move probabilities through the null space of the constraints z (units x 2) until too few units are left.

    Sums of p * z do not change.
    """
    p = p.copy()
    tiny = 1e-9
    p[p < tiny], p[p > 1 - tiny] = 0.0, 1.0
    waiting = np.flatnonzero((p > 0) & (p < 1)).tolist()[::-1]
    draws = iter(rng.random(len(waiting) + 3).tolist())
    q, z0, z1 = p.tolist(), z[:, 0].tolist(), z[:, 1].tolist()
    active: list[int] = []
    while True:
        while len(active) < 3 and waiting:
            active.append(waiting.pop())
        if len(active) < 2:
            break
        if len(active) == 3:
            i, j, k = active
            u = [z0[j] * z1[k] - z0[k] * z1[j], z0[k] * z1[i] - z0[i] * z1[k], z0[i] * z1[j] - z0[j] * z1[i]]
            if not any(u):  # alike in both constraints: any of them may swap
                u = [z1[j], -z1[i], 0.0] if z1[i] or z1[j] else [1.0, -1.0, 0.0]
        elif z0[active[0]] * z1[active[1]] == z0[active[1]] * z1[active[0]]:
            i, j = active
            u = [z1[j], -z1[i]] if z1[i] or z1[j] else [1.0, -1.0]
        else:
            break
        up = min((1 - q[a]) / x if x > 0 else q[a] / -x for a, x in zip(active, u, strict=True) if x)
        down = min(q[a] / x if x > 0 else (1 - q[a]) / -x for a, x in zip(active, u, strict=True) if x)
        move = up if next(draws, 0.5) * (up + down) < down else -down
        left = []
        for a, x in zip(active, u, strict=True):
            v = q[a] + move * x
            q[a] = v = 0.0 if v < tiny else 1.0 if v > 1 - tiny else v
            if 0.0 < v < 1.0:
                left.append(a)
        if len(left) == len(active):  # rounding kept all inside: settle the nearest
            a = min(left, key=lambda a: min(q[a], 1 - q[a]))
            q[a] = float(q[a] >= 0.5)
            left.remove(a)
        active = left
    return np.array(q)


def settle_large(p: np.ndarray, size: np.ndarray, rng: np.random.Generator, share: float = LARGE) -> np.ndarray:
    """Settle units above ``share`` of all sizes first: one moves, all others give way along the null space."""
    q = p.copy()
    for i in np.argsort(-size, kind="stable").tolist():
        while 0.0 < q[i] < 1.0:
            rest = np.flatnonzero((q > 0) & (q < 1))
            rest = rest[rest != i]
            s = size[rest]
            if size[i] <= share * (s.sum() + size[i]) or len(rest) < 3 or not s.any():
                return q
            n, s1, s2 = float(len(rest)), s.sum(), (s * s).sum()
            det = n * s2 - s1 * s1
            if det > 1e-9 * n * s2:  # give way by a + b * size: both totals stay
                w = ((s2 - s1 * size[i]) + (n * size[i] - s1) * s) / det
            else:
                w = np.full(len(rest), size[i] / s1)
            r = q[rest]
            with np.errstate(divide="ignore", invalid="ignore"):
                up = min(1 - q[i], np.where(w > 0, r / w, np.where(w < 0, (r - 1) / w, np.inf)).min())
                down = min(q[i], np.where(w > 0, (1 - r) / w, np.where(w < 0, -r / w, np.inf)).min())
            move = up if rng.random() * (up + down) < down else -down
            q[i] += move
            q[rest] = r - move * w
            q[q < 1e-9], q[q > 1 - 1e-9] = 0.0, 1.0
            if max(up, down) < 1e-12:
                q[i] = float(q[i] >= 0.5)
    return q


def landing(p: np.ndarray, size: np.ndarray, rng: np.random.Generator) -> np.ndarray:
    """Settle the last units: give up the document total first, then the tokens, each with the right expectation."""
    z = np.stack([size, size], axis=1).astype(float)
    p = flight(p, z, rng)
    inside = (p > 0) & (p < 1)
    return np.where(inside, (rng.random(len(p)) < p).astype(float), p)


def draw(units: DataFrame, seed: int = SEED, part: int = PART) -> DataFrame:
    """``units`` (source, docs, key, mark, size, p ...) with p settled to 0 or 1; ``mark`` tells rows of one key apart."""
    schema = units.schema
    names = units.columns

    def move(last: bool, salt: int):
        def each(key: tuple, table: pa.Table) -> pa.Table:
            mark, shuffled, size = (table.column(c).to_numpy(zero_copy_only=False) for c in ("mark", "shuffled", "size"))
            order = np.lexsort([mark, shuffled, -size])  # large documents settle first: what is left to land is small
            table = table.take(pa.array(order))
            p, size = table.column("p").to_numpy().copy(), table.column("size").to_numpy().astype(float)
            rng = np.random.default_rng([seed, salt, *(x & 0xFFFFFFFF for x in (hash_of(key[0].as_py()), key[1].as_py()))])
            inside = (p > 0) & (p < 1)
            if inside.any():
                p[inside] = settle_large(p[inside], size[inside], rng)
                inside = (p > 0) & (p < 1)
                p[inside] = flight(p[inside], np.stack([size[inside], np.ones(inside.sum())], axis=1), rng)
                rest = (p > 0) & (p < 1)
                if last and rest.any():
                    p[rest] = landing(p[rest], size[rest], rng)
            return table.set_column(table.column_names.index("p"), "p", pa.array(p)).select(names)

        return each

    done, left = None, units
    most = units.agg(F.max("docs")).first()[0] or 0
    salt = 0
    while True:
        last = most <= part
        parts = F.ceil(F.col("docs") / F.lit(part))
        dealt = left.withColumn("shuffled", F.xxhash64("key", "mark", F.lit(seed), F.lit(salt))).withColumn("_part", F.pmod(F.col("shuffled"), parts).cast("long"))
        moved = cut_lineage(dealt.groupBy("source", "_part").applyInArrow(move(last, salt), schema))
        if last:
            return moved if done is None else done.unionByName(moved)
        settled = moved.where("p = 0 or p = 1")
        done = settled if done is None else done.unionByName(settled)
        left = moved.where("p > 0 and p < 1").withColumn("docs", (3 * parts).cast("long"))
        most = math.ceil(most / part) * 3
        salt += 1


def hash_of(name: str | None) -> int:
    """The same number for a source in every process."""
    return zlib.crc32(name.encode()) if name is not None else 1 << 32


def mix_sources(docs: DataFrame, weights: tuple = WEIGHTS, share: float = SHARE, most: float = MOST, seed: int = SEED, part: int = PART, key: str = "doc_id", text: str = "text", source: str = "source") -> DataFrame:
    """(key, source, size, source_size, target, copies, taken, mark) of every document; ``mark`` is its text's hash."""
    size = F.coalesce(F.regexp_count(F.col(text), F.lit(WORD)), F.lit(0)).cast("long")
    sized = cut_lineage(docs.select(F.col(key).cast("long").alias("key"), F.xxhash64(F.coalesce(F.col(text), F.lit(""))).alias("mark"), F.col(source).alias("source"), size.alias("size")))
    targets = cut_lineage(source_targets(sized, weights, share, most))
    length = targets.agg(F.coalesce(F.sum(F.coalesce(F.octet_length("source"), F.lit(0)) + 64), F.lit(0))).first()[0]
    side = F.broadcast(targets) if length <= BROADCAST_BYTES else targets
    joined = sized.join(side.withColumnRenamed("source", "_source"), sized["source"].eqNullSafe(F.col("_source")), "inner").drop("_source")
    times = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(F.lit(0.0))
    units = joined.withColumn("whole", F.floor(times)).withColumn("p", times - F.floor(times))
    drawn = draw(units.select("source", "docs", "key", "mark", "size", "source_size", "target", "whole", "p"), seed, part)
    copies = (F.col("whole") + F.col("p")).cast("long")
    return drawn.select(F.col("key").alias(key), "source", "size", "source_size", "target", copies.alias("copies"), (copies * F.col("size")).alias("taken"), "mark")


def digest(docs: DataFrame) -> DataFrame:
    """The contract's columns of ``mix_sources``, with the copies that each document gives."""
    return mix_sources(docs).select("doc_id", "size", "source_size", "target", "taken", "copies")


def mixed_documents(docs: DataFrame) -> DataFrame:
    """The documents that the mix takes, with all their columns and the number of ``copies`` of each.

    Rows with an equal doc_id and text are taken alike: by the largest of their
    draws.  Where a column is called copies already, the new one is copies_2.
    """
    copies = mix_sources(docs).groupBy(F.col("doc_id").alias("_key"), F.col("mark").alias("_mark")).agg(F.max("copies").alias("_copies")).where("_copies > 0")
    own = F.struct(*[docs[c] for c in docs.columns]).alias("row")
    rows = docs.select(F.col("doc_id").cast("long").alias("_id"), F.xxhash64(F.coalesce(F.col("text"), F.lit(""))).alias("_text"), own)
    taken = rows.join(copies, F.col("_id").eqNullSafe(F.col("_key")) & (F.col("_text") == F.col("_mark")))
    return taken.select(*[F.col("row")[c].alias(c) for c in docs.columns], F.col("_copies").alias(fresh(docs.columns, "copies")))
