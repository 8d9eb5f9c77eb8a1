"""What a panel is: its six layouts, its columns and what is known about it."""

from __future__ import annotations

import re
from collections.abc import Callable, Mapping
from dataclasses import dataclass, field, replace
from enum import Enum

from pyspark.sql import DataFrame
from pyspark.sql import types as T

#: Fixed order of the general columns; custom ones follow by name.
GENERAL = ("i", "j", "y", "t", "g", "w", "m")
REQUIRED = ("i", "j", "y")
SPLIT_NAME = re.compile(r"^(\D+)(\d*)$")


class Layout(Enum):
    """Rows of a panel: observations, spells, or runs of either."""

    LONG = "long"
    COLLAPSED = "collapsed long"
    EVENT = "event study"
    COLLAPSED_EVENT = "collapsed event study"
    EXTENDED = "extended event study"
    COLLAPSED_EXTENDED = "collapsed extended event study"

    @property
    def collapsed(self) -> bool:
        return "collapsed" in self.value

    @property
    def wide(self) -> bool:
        return "event" in self.value

    @property
    def extended(self) -> bool:
        return "extended" in self.value

    def as_long(self) -> Layout:
        return Layout.COLLAPSED if self.collapsed else Layout.LONG

    def as_event(self) -> Layout:
        return Layout.COLLAPSED_EVENT if self.collapsed else Layout.EVENT

    def as_extended(self) -> Layout:
        return Layout.COLLAPSED_EXTENDED if self.collapsed else Layout.EXTENDED


@dataclass(frozen=True)
class Column:
    """A general column: dtype (int, float, any, categorical), rule when rows are merged (None: dropped), and
    whether it has one part for each period of a wide row (None: dropped there)."""

    name: str
    dtype: str = "any"
    collapse: str | Callable | None = "first"
    split: bool | None = True

    @property
    def categorical(self) -> bool:
        return self.dtype == "categorical"


STANDARD = {
    "i": Column("i", "categorical", "first", True),
    "j": Column("j", "categorical", "first", True),
    "y": Column("y", "float", "mean", True),
    "t": Column("t", "int", "min", True),
    "g": Column("g", "categorical", "first", True),
    "w": Column("w", "float", "sum", True),
    "m": Column("m", "int", None, False),
}


@dataclass(frozen=True)
class Meta:
    """Layout, columns by name, periods of a wide row, and facts that operators have established."""

    layout: Layout
    columns: Mapping[str, Column]
    periods: int = 1
    connectedness: str | None = None
    no_na: bool = False
    no_duplicates: bool = False
    i_t_unique: bool | None = None
    no_returns: bool | None = None
    dense: Mapping[str, bool] = field(default_factory=dict)
    history: Mapping[str, DataFrame] | None = None

    def names(self) -> list[str]:
        return [c for c in GENERAL if c in self.columns] + sorted(c for c in self.columns if c not in GENERAL)

    def base(self, name: str) -> list[str]:
        """Parts of a column in a long layout."""
        return ["t1", "t2"] if name == "t" and self.layout.collapsed else [name]

    def parts(self, name: str, period: int | None = None) -> list[str]:
        """Physical columns of a general column, of one period or of all."""
        if not self.layout.wide or name == "i" or self.columns[name].split is not True:
            return self.base(name)
        spans = range(1, self.periods + 1) if period is None else [period]
        return [name + str(k) + b[len(name) :] for k in spans for b in self.base(name)]

    def physical(self) -> list[str]:
        return [p for c in self.names() for p in self.parts(c)]

    def has(self, name: str) -> bool:
        return name in self.columns

    def but(self, **changes) -> Meta:
        return replace(self, **changes)

    def unsure(self, **changes) -> Meta:
        """After rows were dropped: order-free facts stay, the rest is unknown."""
        return replace(self, connectedness=None, no_returns=self.no_returns if not self.layout.collapsed else None, dense={}, **changes)


def split_name(physical: str) -> tuple[str, str]:
    """General name and number of a physical column."""
    found = SPLIT_NAME.match(physical)
    if not found:
        raise ValueError(f"column {physical!r} must be a name without digits, with a number behind it at most")
    return found[1], found[2]


def check_name(name: str, taken: Mapping[str, Column]) -> None:
    if any(c.isdigit() for c in name):
        raise ValueError(f"the general column name {name!r} must not hold digits")
    if name in GENERAL or name in taken:
        raise ValueError(f"the column name {name!r} is taken")


def infer_column(name: str, kind: T.DataType, categorical: bool = False) -> Column:
    """Numbers are averaged when merged; others keep their first value."""
    if categorical:
        return Column(name, "categorical", "first", True)
    if isinstance(kind, T.NumericType):
        return Column(name, "float", "mean", True)
    return Column(name, "any", "first", True)
