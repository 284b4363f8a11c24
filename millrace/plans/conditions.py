"""Reusable conditions: boolean columns with discovery metadata and a two-flag planning algebra."""

from __future__ import annotations

from dataclasses import dataclass, replace

from pyspark.sql import Column
from pyspark.sql import functions as F

from millrace.plans.session import holds


def _both(a: frozenset | None, b: frozenset | None) -> frozenset | None:
    """Names that both conditions allow; None allows all."""
    return a if b is None else b if a is None else a & b


def _either(a: frozenset | None, b: frozenset | None) -> frozenset | None:
    return None if a is None or b is None else a | b


@dataclass(frozen=True)
class Condition:
    """A predicate over rows.

    ``names`` and ``places`` are what a scan may be restricted to before the
    predicate is tried (None: unknown).  ``can_true`` and ``can_false`` say what
    the predicate may still turn out to be while some evidence is missing; for
    plain predicates they follow the predicate itself.
    """

    test: Column
    names: frozenset | None = None
    places: frozenset | None = None
    can_true: Column | None = None
    can_false: Column | None = None
    outcome: str | None = None

    def possible(self) -> tuple[Column, Column]:
        value = holds(self.test)
        return (value if self.can_true is None else self.can_true, ~value if self.can_false is None else self.can_false)

    def __and__(self, other: Condition) -> Condition:
        (lt, lf), (rt, rf) = self.possible(), other.possible()
        return Condition(holds(self.test) & holds(other.test), _both(self.names, other.names), _both(self.places, other.places), *all_of(lt, lf, rt, rf), self.outcome or other.outcome)

    def __or__(self, other: Condition) -> Condition:
        (lt, lf), (rt, rf) = self.possible(), other.possible()
        return Condition(holds(self.test) | holds(other.test), _either(self.names, other.names), _either(self.places, other.places), *any_of(lt, lf, rt, rf), self.outcome if self.outcome == other.outcome else None)

    def __invert__(self) -> Condition:
        can_true, can_false = self.possible()
        return Condition(~holds(self.test), can_true=can_false, can_false=can_true)

    def except_when(self, other: Condition) -> Condition:
        return self & ~other

    def pending(self, can_true: Column, can_false: Column) -> Condition:
        """The same predicate while its evidence is not known yet."""
        return replace(self, can_true=can_true, can_false=can_false)

    def certain(self) -> Column:
        """Rows that match whatever the missing evidence turns out to be."""
        can_true, can_false = self.possible()
        return can_true & ~can_false

    def feasible(self) -> Column:
        """Rows that may match."""
        return self.possible()[0]


def all_of(lt: Column, lf: Column, rt: Column, rf: Column) -> tuple[Column, Column]:
    """What a conjunction may be; a left side that can't be true settles it."""
    return lt & rt, F.when(~lt, F.lit(True)).otherwise(lf | rf)


def any_of(lt: Column, lf: Column, rt: Column, rf: Column) -> tuple[Column, Column]:
    """What a disjunction may be; a left side that can't be false settles it."""
    return F.when(~lf, F.lit(True)).otherwise(lt | rt), lf & rf


def where(test: Column, names: set | None = None, places: set | None = None) -> Condition:
    return Condition(test, None if names is None else frozenset(names), None if places is None else frozenset(places))
