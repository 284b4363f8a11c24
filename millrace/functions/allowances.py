"""Allowance comments: which rules a comment allows, and why."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

ALLOWANCE = r"^\s*//\s*([a-z]+)-allow\b[ \t]*([^:]*)(?::[ \t]*(.*?))?[ \t]*$"


def parse_allowance(comment: Column, word: str = "rule") -> Column:
    """(rules, reason, problems) of a ``// <word>-allow ID[, ID]: reason`` comment; null for any other comment."""
    ours = F.regexp_extract(comment, ALLOWANCE, 1) == word
    rules = F.filter(F.transform(F.split(F.regexp_extract(comment, ALLOWANCE, 2), ","), lambda x: F.trim(x)), lambda x: x != "")
    reason = F.trim(F.regexp_extract(comment, ALLOWANCE, 3))
    problems = F.array_compact(F.array(
        F.when(F.size(rules) == 0, F.lit("no rule is named")),
        F.when(reason == "", F.lit("no reason is given")),
        F.when(F.size(rules) > F.size(F.array_distinct(rules)), F.lit("a rule is named twice")),
    ))
    return F.when(ours, F.struct(rules.alias("rules"), reason.alias("reason"), F.array_join(problems, "; ").alias("problems")))
