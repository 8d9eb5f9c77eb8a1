"""Cleaning: from raw rows to a panel with known properties."""

from __future__ import annotations

from dataclasses import replace
from typing import TYPE_CHECKING

from pairloom.operators import connect, rows
from pairloom.operators.ids import make_dense
from pairloom.operators.model import Layout
from pairloom.operators.params import CleanParams
from pairloom.operators.reshape import collapse, to_long
from pairloom.plans.scratch import materialise

if TYPE_CHECKING:
    from pairloom.operators.panel import Panel


def clean(panel: Panel, params: CleanParams) -> Panel:
    """Drop nulls and duplicates, mark moves, handle returns, make ids dense, keep a connected set.

    Up to the ids all steps are one plan with one exchange by worker. Wide panels are cleaned as
    long ones. With collapse_at_connectedness_measure and a leave-out measure of spells or
    matches, rows are merged to that level first and the measure becomes that of observations.
    """
    layout = panel.meta.layout
    if layout.wide:
        long = to_long(panel, is_clean=False, drop_no_split_columns=False)
        long = clean(long.on(long.df.dropDuplicates()), params)
        return long.to_extendedeventstudy(panel.meta.periods, 0) if layout.extended else long.to_eventstudy()
    how = params.connectedness
    if params.collapse_at_connectedness_measure and layout is Layout.LONG and how:
        level = {"spell": "spell", "match": "match"}.get(how.rpartition("_")[2])
        if level:
            first = clean(panel, replace(params, connectedness=None, collapse_at_connectedness_measure=False))
            measure = how.removesuffix(level) + "observation"
            return clean(collapse(first, level), replace(params, connectedness=measure, collapse_at_connectedness_measure=False))
    panel.check_columns()
    panel.log("cleaning")
    now = panel.on(panel.df.repartition("i"))
    if params.force or not panel.meta.no_na:
        now = rows.drop_na(now)
    now = rows.gen_m(now)
    if params.force or not panel.meta.i_t_unique:
        now = rows.drop_i_t_duplicates(now, params.i_t_how)
        now = rows.tidy(now.on(now.df), params.drop_returns_to_stays) if layout.collapsed else rows.gen_m(now)
    now = now.on(materialise(now.df, "cleaned"))
    if params.force or params.drop_returns or panel.meta.no_returns is None:
        now = rows.drop_returns(now, params.drop_returns)
    now = _dense(now, params.force)
    if how is not None and (params.force or panel.meta.connectedness != how):
        now = connect.connected(now, how, params.component_size_variable, params.drop_single_stayers, params.drop_returns_to_stays)
        facts = now.meta
        now = _dense(now, True)
        now = now.on(now.df, now.meta.but(connectedness=facts.connectedness))
    return now.on(now.df, now.meta.but(no_na=True, no_duplicates=True, i_t_unique=True if panel.meta.has("t") else None))


def _dense(panel: Panel, force: bool) -> Panel:
    for name in panel.meta.names():
        if panel.meta.columns[name].categorical:
            panel = make_dense(panel, name, force)
    return panel
