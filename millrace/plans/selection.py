"""Lazy selections: a DataFrame whose rows have an identity and a place in their source's order."""

from __future__ import annotations

from collections.abc import Callable, Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from millrace.functions.text import contains_word, matches_glob
from millrace.plans.conditions import Condition
from millrace.plans.session import first_of_each, fresh, holds


@dataclass(frozen=True)
class Selection:
    """Rows named by ``identity`` and ordered by ``order`` (both column names that every step keeps)."""

    rows: DataFrame
    identity: tuple[str, ...]
    order: tuple[str, ...] = ()

    def _with(self, rows: DataFrame) -> Selection:
        return Selection(rows, self.identity, self.order or self.identity)

    def select(self, *columns: Column | str) -> Selection:
        """One row for each row: the identity, the order and the given columns."""
        keep = dict.fromkeys((*self.identity, *self.order))
        named = [F.col(c) if isinstance(c, str) else c for c in columns]
        plain = {c for c in columns if isinstance(c, str)}
        return self._with(self.rows.select(*[c for c in keep if c not in plain], *named))

    def select_many(self, array: Column, name: str, position: str = "position") -> Selection:
        """One row for each element; a row without elements drops out."""
        rows = self.rows.select("*", F.posexplode(array).alias(position, name))
        return Selection(rows, (*self.identity, position), (*(self.order or self.identity), position))

    def where(self, condition: Condition | Column) -> Selection:
        return self._with(self.rows.where(condition.test if isinstance(condition, Condition) else condition))

    def except_when(self, condition: Condition | Column) -> Selection:
        test = condition.test if isinstance(condition, Condition) else condition
        return self._with(self.rows.where(~holds(test)))

    def concat(self, other: Selection) -> Selection:
        """All rows of both."""
        return self._with(self.rows.unionByName(other.rows))

    def union(self, other: Selection) -> Selection:
        """Rows of both, one for each identity: the first in order, this side before the other."""
        side = fresh("_side", self.rows, other.rows)
        both = self.rows.withColumn(side, F.lit(0)).unionByName(other.rows.withColumn(side, F.lit(1)))
        return self._with(first_of_each(both, [*self.identity], [side, *(self.order or self.identity)]).drop(side))

    def join(self, other: DataFrame, left: Column | str, right: str, fold: Callable[[Column], Column] = lambda c: c) -> Selection:
        """Inner equi join; null keys match nothing."""
        own, key = fresh("_own", self.rows, other), fresh("_key", self.rows, other)
        named = fold(F.col(left) if isinstance(left, str) else left)
        side = other.withColumn(key, fold(F.col(right)))
        return self._with(self.rows.withColumn(own, named).join(side, F.col(own) == F.col(key)).drop(own, key))

    def without_matching(self, other: DataFrame, left: str, right: str, fold: Callable[[Column], Column] = lambda c: c) -> Selection:
        """Rows whose key no row of ``other`` has; a null key matches a null key."""
        own, key = fresh("_own", self.rows, other), fresh("_key", self.rows, other)
        side = other.select(fold(F.col(right)).alias(key)).distinct()
        return self._with(self.rows.withColumn(own, fold(F.col(left))).join(side, F.col(own).eqNullSafe(F.col(key)), "left_anti").drop(own))

    def without_certain(self, other: DataFrame, condition: Condition, left: str, right: str) -> Selection:
        """``without_matching`` while evidence is missing: only rows of ``other`` that match whatever it turns out to be take a row away."""
        return self.without_matching(other.where(condition.certain()), left, right)

    def without(self, other: DataFrame, matches: Column, equal: Sequence[tuple[str, str]] = ()) -> Selection:
        """Rows that no row of ``other`` matches; give the equal columns too, so that rows meet by key."""
        test = matches
        for a, b in equal:
            test = test & (F.col(a) == F.col(b))
        return self._with(self.rows.join(other, test, "left_anti"))

    def named(self, column: str, *names: str) -> Selection:
        """Rows of one of the names."""
        return self._with(self.rows.where(F.col(column).isin(*names)))

    def name_matching(self, column: str, glob: str) -> Selection:
        """Rows whose whole name fits a glob."""
        return self._with(self.rows.where(matches_glob(F.col(column), glob)))

    def name_like(self, column: str, pattern: str) -> Selection:
        """Rows in whose name a regular expression is found."""
        return self._with(self.rows.where(F.col(column).rlike(pattern)))

    def name_with_word(self, column: str, *words: str, fold: bool = False) -> Selection:
        """Rows whose name has one of the words as a whole word."""
        test = F.lit(False)
        for word in words:
            test = test | contains_word(F.col(column), word, fold)
        return self._with(self.rows.where(test))

    def ordered(self) -> DataFrame:
        return self.rows.orderBy(*(self.order or self.identity))
