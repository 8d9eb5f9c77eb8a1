"""Options of cleaning, clustering and simulation, checked when they are made."""

from __future__ import annotations

from dataclasses import dataclass, field, fields
from typing import Any

from pairloom.functions.aggregates import is_custom

#: The names that options take.
CONNECTEDNESS = ("connected", "strongly_connected", "leave_out_observation", "leave_out_spell", "leave_out_match", "leave_out_worker", "leave_out_firm", "strongly_leave_out_observation", "strongly_leave_out_spell", "strongly_leave_out_match", "strongly_leave_out_worker")
SIZES = ("len", "length", "firms", "workers", "stayers", "movers", "firms_plus_workers", "firms_plus_stayers", "firms_plus_movers", "len_stayers", "length_stayers", "len_movers", "length_movers", "stays", "moves")
RETURNS = ("returns", "returners", "keep_first_returns", "keep_last_returns")


def _one_of(name: str, value: Any, allowed: tuple) -> None:
    if value not in allowed:
        raise ValueError(f"{name} must be one of {', '.join(map(repr, allowed))}, not {value!r}")


class Describe:
    def describe(self) -> str:
        """A line for each option with its value."""
        return "\n".join(f"{f.name} = {getattr(self, f.name)!r}: {f.metadata.get('help', '')}" for f in fields(self))


def _option(default: Any, text: str) -> Any:
    return field(default=default, metadata={"help": text})


@dataclass(frozen=True)
class CleanParams(Describe):
    connectedness: str | None = _option(None, "which connected set of firms to keep")
    collapse_at_connectedness_measure: bool = _option(False, "merge rows to the level of a leave-out measure before it is applied")
    component_size_variable: str = _option("firms", "what makes a component the largest")
    drop_single_stayers: bool = _option(False, "drop stayers whose weights add up to 1 at most")
    i_t_how: Any = _option("max", "how rows of one worker, firm and period are merged")
    drop_returns: str | bool = _option(False, "what to drop of workers who come back to a firm")
    drop_returns_to_stays: bool = _option(False, "drop instead of merging rows that become neighbours")
    force: bool = _option(True, "do steps even if their result is known to hold")

    def __post_init__(self) -> None:
        _one_of("connectedness", self.connectedness, (None, *CONNECTEDNESS))
        _one_of("component_size_variable", self.component_size_variable, SIZES)
        _one_of("drop_returns", self.drop_returns, (False, *RETURNS))
        if not is_custom(self.i_t_how) and not isinstance(self.i_t_how, str):
            raise ValueError("i_t_how must be the name of an aggregate or a function")


@dataclass(frozen=True)
class ClusterParams(Describe):
    measures: Any = _option(None, "measures of firms (CDFs by default), one or a list")
    grouping: Any = _option(None, "how firms are grouped by their measures (k-means by default)")
    stayers_movers: str | None = _option(None, "rows that measures see: stayers, movers, stays or moves")
    t: Any = _option(None, "period or periods that measures see")
    weighted: bool = _option(True, "use weights")
    silhouette: bool = _option(False, "give silhouette scores of firms as well")
    dropna: bool = _option(False, "drop rows of firms without a cluster")
    clean_params: CleanParams | None = _option(None, "options of the cleaning after dropna")

    def __post_init__(self) -> None:
        _one_of("stayers_movers", self.stayers_movers, (None, "stayers", "movers", "stays", "moves"))


@dataclass(frozen=True)
class SimParams(Describe):
    nk: int = _option(10, "firm classes")
    nl: int = _option(5, "worker types")
    n_workers: int = _option(10_000, "workers")
    n_time: int = _option(5, "periods")
    firm_size: float = _option(50, "observations of a firm in a period")
    firm_size_distn: str = _option("normal", "distribution of firm sizes: normal, pareto or exponential")
    max_firm_size: float = _option(500, "upper end of the pareto distribution")
    exp_distn_exponent: float = _option(1.5, "exponent of pareto and exponential sizes")
    alpha_sig: float = _option(1, "standard deviation of worker effects")
    psi_sig: float = _option(1, "standard deviation of firm effects")
    w_sig: float = _option(1, "standard deviation of the shock")
    c_sort: float = _option(1, "sorting effect")
    c_netw: float = _option(1, "network effect")
    c_sig: float = _option(1, "standard deviation of sorting and network effects")
    p_move: float = _option(0.5, "probability of moving in a period")

    def __post_init__(self) -> None:
        _one_of("firm_size_distn", self.firm_size_distn, ("normal", "pareto", "exponential"))
        if min(self.nk, self.nl, self.n_workers, self.n_time) < 1 or self.firm_size <= 0 or self.c_sig <= 0:
            raise ValueError("counts must be at least 1, firm_size and c_sig above 0")
        if not 0 <= self.p_move <= 1 or min(self.alpha_sig, self.psi_sig, self.w_sig) < 0:
            raise ValueError("p_move must lie in [0, 1] and standard deviations must not be negative")
