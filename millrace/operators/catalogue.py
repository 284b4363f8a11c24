"""Classifying calls by a catalogue of known operations."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from millrace.plans.session import small_side


def classify_calls(calls: DataFrame, catalogue: DataFrame, standard: list[str], frameworks: dict[str, int]) -> DataFrame:
    """Calls (owner, operation, framework) with their ``standing``, by the first test that fails.

    ``catalogue`` has (owner, operation, framework_bits, capability); ``standard`` names the
    owners of standard operations, ``frameworks`` the bit of each framework.
    """
    bit = F.coalesce(F.create_map(*[x for k, v in frameworks.items() for x in (F.lit(k), F.lit(v))])[F.col("framework")], F.lit(0))
    known = small_side(catalogue.select(F.col("owner").alias("_owner"), F.col("operation").alias("_operation"), "framework_bits", "capability"))
    joined = calls.join(known, (F.col("owner") == F.col("_owner")) & (F.col("operation") == F.col("_operation")), "left")
    standing = (
        F.when(F.col("owner").isNull() | F.col("operation").isNull(), "Unresolved")
        .when(~F.col("owner").isin(standard), "NotStandardSymbol")
        .when(bit == 0, "UnsupportedFramework")
        .when(F.col("framework_bits").isNull() | (F.col("framework_bits").bitwiseAND(bit) == 0), "UnsupportedOperation")
        .otherwise("Supported")
    )
    return joined.withColumn("standing", standing).drop("_owner", "_operation", "framework_bits")
