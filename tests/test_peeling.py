"""Frames that peel firms or ids away, by what changes, against going through the whole panel in each round."""

import random

import pytest

from pairloom.operators import rows as ops
from pairloom.operators.rows import keep_ids, min_movers_firms, min_moves_firms, min_obs_ids, until_stable


def random_rows(seed):
    r = random.Random(seed)
    return [(i, r.randrange(25), 1.0, t) for i in range(40) for t in range(r.randint(1, 5))]


@pytest.mark.parametrize("distinct, threshold", [(False, 2), (False, 5), (True, 4), (True, 99)])
def test_firms(panel, rows_of, distinct, threshold):
    p = panel(random_rows(threshold)).gen_m()
    find = min_movers_firms if distinct else min_moves_firms
    want = until_stable(p, lambda x: keep_ids(x, "j", find(x, threshold)))
    got = (p.min_movers_frame if distinct else p.min_moves_frame)(threshold)
    assert rows_of(got, "i", "j", "t", "m") == rows_of(want, "i", "j", "t", "m")


def test_pairs(panel, rows_of):
    p = panel(random_rows(7)).gen_m()
    want = until_stable(p, lambda x: keep_ids(keep_ids(x, "j", min_obs_ids(x, 4)), "i", min_obs_ids(keep_ids(x, "j", min_obs_ids(x, 4)), 2, "i")))
    got = p.min_joint_obs_frame(4, 2)
    assert rows_of(got, "i", "j", "t") == rows_of(want, "i", "j", "t") and got.df.count()


def test_a_round_reads_what_it_changes(panel, monkeypatch):
    """Firms in a row fall one after another, each with one worker; three more firms stay."""
    chain = [(i, i + k, 1.0, k) for i in range(5) for k in range(2)] + [(5, 5, 1.0, 0), (5, 6, 1.0, 1), (5, 5, 1.0, 2), (5, 6, 1.0, 3)]
    crowd = [(100 + i, 100 + (i + k) % 3, 1.0, k) for i in range(60) for k in range(3)]
    sizes = []
    write = ops.materialise

    def watched(df, name, *rest):
        out = write(df, name, *rest)
        if name == "touched":
            sizes.append(out.count())
        return out

    monkeypatch.setattr(ops, "materialise", watched)
    got = panel(chain + crowd).gen_m().min_moves_frame(2)
    assert {x.j for x in got.df.select("j").distinct().collect()} == {5, 6, 100, 101, 102}
    assert len(sizes) == 5 and max(sizes) <= 4
