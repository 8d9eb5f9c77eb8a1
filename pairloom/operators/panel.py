"""The panel: a DataFrame with the meaning of its columns. Every operation returns a new panel."""

from __future__ import annotations

import logging
import warnings
from collections.abc import Callable
from functools import partialmethod
from typing import Any

from pyspark.sql import Column as SparkColumn
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from pairloom.operators import ids, report, reshape
from pairloom.operators import rows as row_ops
from pairloom.operators.model import GENERAL, REQUIRED, STANDARD, Column, Layout, Meta, check_name, infer_column, split_name
from pairloom.operators.params import CleanParams

LOG = logging.getLogger("pairloom")


class Panel:
    """A matched panel in one of six layouts.

    Panel.of(df) finds the layout by the columns' names. Operations are lazy unless they need a
    fact about the data (fixed points, connected sets, dense ids).
    """

    def __init__(self, df: DataFrame, meta: Meta, log: bool = False):
        self.df, self.meta, self.logs = df.select(*(p for p in meta.physical() if p in df.columns)), meta, log

    # Making panels

    @classmethod
    def of(cls, df: DataFrame, *, categorical: dict[str, bool] | None = None, dtype: dict[str, str] | None = None, how_collapse: dict | None = None, long_es_split: dict | None = None, track_id_changes: bool = False, log: bool = False) -> Panel:
        """Panel of a table, whose layout follows from which of i, j, j1, j2, ..., t, t1, t11, ... it has."""
        layout, periods = find_layout(df.columns)
        columns = {c: STANDARD[c] for c in GENERAL if any(split_name(p)[0] == c for p in df.columns)}
        meta = Meta(layout, columns, periods, history={} if track_id_changes else None)
        for name in dict.fromkeys(split_name(p)[0] for p in df.columns):
            if name in columns:
                continue
            kinds = [f.dataType for f in df.schema if split_name(f.name)[0] == name]
            spec = infer_column(name, kinds[0], bool((categorical or {}).get(name)))
            if dtype and name in dtype:
                spec = Column(name, dtype[name], spec.collapse, spec.split)
            collapse = (how_collapse or {}).get(name, spec.collapse)
            split = (long_es_split or {}).get(name, spec.split if len(kinds) > 1 or not layout.wide else False)
            columns[name] = check_column(Column(name, spec.dtype, collapse, split))
        panel = cls(df, meta.but(columns=columns), log)
        panel.check_columns(df.columns)
        return panel

    def on(self, df: DataFrame, meta: Meta | None = None) -> Panel:
        return Panel(df, meta or self.meta, self.logs)

    def rows(self, df: DataFrame, keep_facts: bool = False, **facts: Any) -> Panel:
        """The same kind of panel over fewer rows."""
        meta = self.meta if keep_facts else self.meta.unsure()
        return self.on(df, meta.but(**facts))

    def with_column(self, name: str, value: SparkColumn) -> Panel:
        meta = self.meta if self.meta.has(name) else self.meta.but(columns={**self.meta.columns, name: STANDARD[name]})
        return self.on(self.df.withColumn(name, value), meta)

    def copy(self) -> Panel:
        """A panel is never changed, so this is the panel itself."""
        return self

    def log_on(self, on: bool = True) -> Panel:
        return Panel(self.df, self.meta, on)

    def log(self, message: str, level: str = "info") -> None:
        if self.logs:
            LOG.log(getattr(logging, level.upper()), message)

    # Columns

    def check_columns(self, given: list[str] | None = None) -> None:
        """Required columns are there, all parts are, types fit, and nothing unregistered is."""
        have = set(given or self.df.columns)
        if missing := [c for c in REQUIRED if c not in self.meta.columns]:
            raise ValueError(f"required columns are missing: {missing}")
        parts = set(self.meta.physical())
        if parts - have:
            raise ValueError(f"columns are missing: {sorted(parts - have)}")
        if have - parts:
            raise ValueError(f"columns are not registered: {sorted(have - parts)}")
        for f in self.df.schema:
            kind = self.meta.columns[split_name(f.name)[0]].dtype
            if kind == "float" and not isinstance(f.dataType, T.NumericType) or kind == "int" and not isinstance(f.dataType, T.NumericType):
                raise ValueError(f"column {f.name} must hold numbers")

    def add_column(self, name: str, value: SparkColumn | list[SparkColumn] | None = None, parts: list[str] | None = None, is_categorical: bool = False, dtype: str = "any", how_collapse: Any = "first", long_es_split: bool | None = True) -> Panel:
        """Register a column: an expression for each part, or parts that the table has already."""
        check_name(name, self.meta.columns)
        spec = check_column(Column(name, "categorical" if is_categorical else dtype, how_collapse, long_es_split))
        meta = self.meta.but(columns={**self.meta.columns, name: spec})
        want = meta.parts(name)
        values = value if isinstance(value, list) else [value] if value is not None else [F.col(p) for p in parts or want]
        if len(values) != len(want):
            raise ValueError(f"column {name} has {len(want)} parts in this layout, {len(values)} were given")
        return self.on(self.df.withColumns(dict(zip(want, values, strict=True))), meta)

    def set_column_properties(self, name: str, is_categorical: bool = False, dtype: str = "any", how_collapse: Any = "first", long_es_split: bool | None = True) -> Panel:
        if name in GENERAL or name not in self.meta.columns:
            raise ValueError(f"{name!r} is not a custom column")
        spec = check_column(Column(name, "categorical" if is_categorical else dtype, how_collapse, long_es_split))
        return self.on(self.df, self.meta.but(columns={**self.meta.columns, name: spec}))

    def get_column_properties(self, name: str) -> dict[str, Any]:
        c = self.meta.columns[name]
        return {"general_column": name, "subcolumns": self.meta.parts(name), "dtype": c.dtype, "is_categorical": c.categorical, "how_collapse": c.collapse, "long_es_split": c.split}

    def print_column_properties(self, name: str) -> None:
        print(*(f"{k}: {v!r}" for k, v in self.get_column_properties(name).items()), sep="\n")

    def drop(self, names: str | list[str], allow_optional: bool = False, allow_required: bool = False) -> Panel:
        """Drop general columns; t, g, w and m only if asked, i, j and y only if asked as well."""
        gone = []
        for name in [names] if isinstance(names, str) else names:
            if name not in self.meta.columns:
                warnings.warn(f"{name!r} is not a general column and is kept", stacklevel=2)
            elif name in REQUIRED and not allow_required:
                warnings.warn(f"{name!r} is required and is kept", stacklevel=2)
            elif name in REQUIRED or name not in GENERAL or allow_optional:
                gone.append(name)
        columns = {c: v for c, v in self.meta.columns.items() if c not in gone}
        return self.on(self.df, self.meta.but(columns=columns))

    def rename(self, names: dict[str, str], allow_optional: bool = False, allow_required: bool = False) -> Panel:
        """Rename general columns; parts keep their numbers."""
        if len(set(names.values())) < len(names):
            raise ValueError("new names must differ from each other")
        columns, physical = dict(self.meta.columns), {}
        for old, new in names.items():
            if old not in columns:
                raise ValueError(f"{old!r} is not a general column")
            if old in REQUIRED and not allow_required or old in GENERAL and old not in REQUIRED and not allow_optional:
                warnings.warn(f"{old!r} is a standard column and keeps its name", stacklevel=2)
                continue
            check_name(new, {c: v for c, v in columns.items() if c not in names})
            physical |= {p: new + p[len(old) :] for p in self.meta.parts(old)}
            spec = columns.pop(old)
            columns[new] = Column(new, spec.dtype, spec.collapse, spec.split)
        return self.on(self.df.withColumnsRenamed(physical), self.meta.but(columns=columns))

    def merge(self, other: DataFrame, on: str | list[str], how: str = "left") -> Panel | DataFrame:
        """Equi-join; a left join gives a panel, whose new columns are custom ones, others a table."""
        joined = self.df.join(other, on, how)
        if how != "left":
            return joined
        columns = dict(self.meta.columns)
        for f in other.schema:
            name = split_name(f.name)[0]
            if f.name not in self.df.columns and name not in columns:
                columns[name] = infer_column(name, f.dataType)
        return Panel(joined, self.meta.but(columns=columns), self.logs)

    def sort_cols(self) -> Panel:
        return self.on(self.df)

    def sort_rows(self) -> DataFrame:
        """All rows in order, for output; operators order rows themselves."""
        return self.df.orderBy("i", *row_ops.row_order(self))

    # Conversions

    def as_long(self) -> Panel:
        return self.to_long() if self.meta.layout.wide else self

    def through_long(self, step: Callable[[Panel], Panel]) -> Panel:
        """Do something that is defined for long panels, and come back."""
        if not self.meta.layout.wide:
            return step(self)
        long = step(reshape.to_long(self, drop_no_split_columns=False))
        if not self.meta.layout.extended:
            return long.to_eventstudy()
        return long.to_extendedeventstudy(self.meta.periods, 0)

    def clean(self, params: CleanParams | None = None, **options: Any) -> Panel:
        from pairloom.operators.clean import clean

        return clean(self, params or CleanParams(**options))

    def cluster(self, params: Any = None, **options: Any) -> Any:
        from pairloom.operators.cluster import cluster
        from pairloom.operators.params import ClusterParams

        return cluster(self, params or ClusterParams(**options))

    def connected(self, how: str | None, **options: Any) -> Panel:
        from pairloom.operators.connect import connected

        return connected(self, how, **options)

    def gen_m(self, force: bool = False) -> Panel:
        if self.meta.has("m") and not force:
            return self
        if not self.meta.layout.wide:
            return row_ops.gen_m(self)
        moved = F.lit(False)
        for k in range(2, self.meta.periods + 1):
            moved = moved | (F.col(f"j{k}") != F.col("j1"))
        return self.with_column("m", moved.cast("int"))

    def get_worker_m(self) -> SparkColumn:
        return row_ops.worker_m()

    collapse = reshape.collapse
    recollapse = reshape.recollapse
    uncollapse = reshape.uncollapse
    to_eventstudy = reshape.to_eventstudy
    to_extendedeventstudy = reshape.to_extendedeventstudy
    to_permutedeventstudy = reshape.to_permutedeventstudy
    to_long = reshape.to_long
    get_cs = reshape.get_cs
    construct_artificial_time = reshape.construct_artificial_time

    def fill_missing_periods(self, fill: dict | None = None) -> DataFrame:
        return row_ops.fill_missing_periods(self, fill)

    def drop_na(self) -> Panel:
        return row_ops.drop_na(self)

    def drop_i_t_duplicates(self, how: Any = "max") -> Panel:
        return self.through_long(lambda p: row_ops.drop_i_t_duplicates(p, how))

    def drop_returns(self, how: str | bool = False) -> Panel:
        return self.through_long(lambda p: row_ops.drop_returns(p, how))

    keep_ids = partialmethod(row_ops.keep_ids)
    drop_ids = partialmethod(row_ops.keep_ids, keep=False)
    keep_rows = partialmethod(row_ops.keep_rows)
    drop_rows = partialmethod(row_ops.keep_rows, keep=False)
    min_obs_ids = row_ops.min_obs_ids
    min_obs_frame = row_ops.min_obs_frame
    min_joint_obs_frame = row_ops.min_joint_obs_frame
    min_workers_firms = row_ops.min_workers_firms
    min_workers_frame = row_ops.min_workers_frame
    min_moves_firms = row_ops.min_moves_firms
    min_moves_frame = row_ops.min_moves_frame
    min_movers_firms = row_ops.min_movers_firms
    min_movers_frame = row_ops.min_movers_frame

    # Ids and reports

    unique_ids = ids.unique_ids
    make_dense = ids.make_dense
    original_ids = ids.original_ids
    summary = report.summary
    diagnostic = report.diagnostic

    def n_unique_ids(self, name: str) -> int:
        return self.unique_ids(name).count()

    def n_workers(self) -> int:
        return self.n_unique_ids("i")

    def n_firms(self) -> int:
        return self.n_unique_ids("j")

    def n_clusters(self) -> int | None:
        return self.n_unique_ids("g") if self.meta.has("g") else None


def check_column(c: Column) -> Column:
    if c.dtype not in ("int", "float", "any", "categorical"):
        raise ValueError(f"dtype {c.dtype!r} is unknown")
    if c.categorical and c.collapse not in ("first", "last", None):
        raise ValueError("categorical columns are merged by 'first', 'last' or None")
    if c.split not in (True, False, None):
        raise ValueError("long_es_split must be True, False or None")
    return c


def find_layout(columns: list[str]) -> tuple[Layout, int]:
    """Layout and number of periods by the names of the columns; names that contradict each other are errors."""
    have = set(columns)
    if "i" not in have:
        raise ValueError("the column i is missing")
    wide, long = {"j1", "j2"} <= have, "j" in have
    if long and ({"j1", "j2"} & have or {"y1", "y2"} & have):
        raise ValueError("columns of long and wide layouts are mixed")
    if long:
        if "y" not in have:
            raise ValueError("the column y is missing")
        if {"t", "t1"} <= have or {"t", "t2"} <= have or ("t1" in have) != ("t2" in have):
            raise ValueError("give t, or both t1 and t2")
        if {"t11", "t12", "t21", "t22"} & have:
            raise ValueError("t11 to t22 belong to event studies")
        return (Layout.COLLAPSED if "t1" in have else Layout.LONG), 1
    if not wide:
        raise ValueError("the firm columns j, or j1 and j2, are missing")
    n = 2
    while f"y{n + 1}" in have:
        n += 1
    for c in ("j", "y"):
        if missing := [f"{c}{k}" for k in range(1, n + 1) if f"{c}{k}" not in have]:
            raise ValueError(f"columns are missing: {missing}")
    single, double = [f"t{k}" in have for k in range(1, n + 1)], [f"t{k}{x}" in have for k in range(1, n + 1) for x in (1, 2)]
    if n < 11 and any(single) and any(double):
        raise ValueError("give one time column for each period, or two")
    if any(double) and not any(single):
        if not all(double):
            raise ValueError("time columns are missing")
        return (Layout.COLLAPSED_EXTENDED if n > 2 else Layout.COLLAPSED_EVENT), n
    if any(single) and not all(single):
        raise ValueError("time columns are missing")
    for c in ("g", "w"):
        there = [f"{c}{k}" in have for k in range(1, n + 1)]
        if any(there) and not all(there):
            raise ValueError(f"columns of {c} are missing")
    return (Layout.EXTENDED if n > 2 else Layout.EVENT), n
