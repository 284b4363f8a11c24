"""Training rows for the classifiers: a bounded sample of labelled documents."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def remainder(key: Column, modulus: int) -> Column:
    """crc32 of the key as text, modulo ``modulus``; null for a null key."""
    return F.crc32(key.cast("string").cast("binary")) % modulus


def training_rows(docs: DataFrame, labels: DataFrame, label: str, modulus: int, held: int, bound: int, key: str | None = None, text: str = "text") -> DataFrame:
    """(key, label, text): some ``bound`` rows with a label, none of them held out.

    Rows are chosen by a hash of the key, so reruns agree.  The labelled side is
    bounded by ``bound`` and joined by broadcast; texts don't move.
    """
    key = key or ("key" if "key" in docs.columns and "doc_id" not in docs.columns else "doc_id")
    free = lambda c: F.coalesce(remainder(c, modulus) != held, F.lit(False))
    known = labels.where(F.col(label).isNotNull() & free(F.col("doc_id"))).groupBy(F.col("doc_id").cast("long").alias("_key")).agg(F.max(label).cast("int").alias("_label"))
    n = max(1, known.count())
    known = known.where(F.pmod(F.xxhash64("_key", F.lit(17)), F.lit(n)) < bound)
    rows = docs.select(F.col(key).cast("long").alias("key"), F.col(text).alias(text)).where(free(F.col("key")))
    return rows.join(F.broadcast(known), F.col("key") == F.col("_key")).select("key", F.col("_label").alias("label"), text)
