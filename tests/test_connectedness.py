"""Connected sets of small networks with known sizes, against plain versions, and invariants."""

import random

import pytest

from pairloom.operators.connect import SIZE, firm_parts, part_sizes, worker_links

RING = ["0 1", "1 2", "2 3", "3 4", "4 5", "5 0"]
SECOND = ["6 7", "7 8", "8 9", "9 6"]
C9 = ["0 1 3 3 2", "1 0 2", "3 4 5", "4 7 3 7 5", "6 7 8", "7 6 8 10", "9 10 11", "10 9 11"]
CASES = {
    "C1": (RING + SECOND + ["3 6"], {"connected": 10, "leave_out_firm": 6}),
    "C5": ([*RING[:2], "2 3 6", RING[3], "4 5 6", RING[5], *SECOND], {"connected": 10, "leave_out_observation": 10, "leave_out_firm": 7}),
    "C6": ([*RING[:2], "2 3 6", *RING[3:], *SECOND], {"leave_out_observation": 6}),
    "C7": (RING + [*SECOND[:3], "9 6 3"], {"leave_out_observation": 6}),
}


def walks(sequences):
    return [(w, int(f), 1.0, t) for w, s in enumerate(sequences) for t, f in enumerate(s.split())]


@pytest.mark.parametrize("name", CASES)
def test_sizes(panel, name):
    sequences, want = CASES[name]
    p = panel(walks(sequences)).clean().collapse()
    for how, firms in want.items():
        assert p.clean(connectedness=how).n_firms() == firms, how


@pytest.mark.parametrize("how, size", [("connected", (12, 8)), ("strongly_connected", (4, 5)), ("leave_out_observation", (9, 6)), ("leave_out_spell", (6, 5)), ("leave_out_match", (3, 2)), ("leave_out_worker", (3, 3))])
def test_measures(panel, how, size):
    got = panel(walks(C9)).clean(connectedness=how)
    assert (got.n_firms(), got.n_workers()) == size


def test_spells_are_observations_once_merged(panel):
    p = panel(walks(C9))
    merged = p.clean(connectedness="leave_out_spell", collapse_at_connectedness_measure=True)
    assert (merged.n_firms(), merged.n_workers()) == (6, 5)
    assert p.clean().collapse().clean(connectedness="leave_out_observation").n_firms() == 6


def test_strong_sets_stay(panel):
    got = panel(walks([*C9, "3 0 1", "2 1 3 0"])).clean(connectedness="strongly_leave_out_observation")
    assert got.df.count() > 0
    assert got.clean(connectedness="strongly_connected").df.count() == got.df.count()


def test_stayers_of_other_firms_go(panel):
    p = panel([(0, 0, 1, 1), (0, 1, 1, 2), (1, 1, 1, 1), (1, 0, 1, 2), (2, 2, 1, 1)]).clean(connectedness="connected")
    assert p.n_firms() == 2 and p.n_workers() == 2


def with_m(rows):
    out = []
    for i in sorted({r[0] for r in rows}):
        own = sorted((r for r in rows if r[0] == i), key=lambda r: (r[2], r[1]))
        for k, r in enumerate(own):
            around = own[max(0, k - 1) : k] + own[k + 1 : k + 2]
            out.append((*r[:3], sum(x[1] != r[1] for x in around)))
    return out


def plain_size(rows, name):
    if name.startswith("firms_plus_"):
        return plain_size(rows, "firms") + plain_size(rows, name.removeprefix("firms_plus_"))
    movers = {r[0] for r in rows if r[3] > 0}
    return {
        "len": len(rows),
        "firms": len({r[1] for r in rows}),
        "workers": len({r[0] for r in rows}),
        "stayers": len({r[0] for r in rows if r[3] == 0}),
        "movers": len(movers),
        "stays": sum(r[3] == 0 for r in rows),
        "moves": sum(r[3] > 0 for r in rows),
        "len_stayers": sum(r[0] not in movers for r in rows),
        "len_movers": sum(r[0] in movers for r in rows),
    }[name.replace("length", "len")]


def pieces(pairs, alone=()):
    of = {v: v for p in pairs for v in (("w", p[0]), ("f", p[1]))} | {("f", j): ("f", j) for j in alone}

    def top(v):
        while of[v] != v:
            v = of[v]
        return v

    for i, j in pairs:
        of[top(("w", i))] = top(("f", j))
    found = {}
    for v in of:
        found.setdefault(top(v), set()).add(v)
    return list(found.values())


def plain_parts(rows):
    """(firms, number of vertices) of each component, those of most vertices first."""
    movers = {r[0] for r in rows if r[3] > 0}
    found = pieces({(r[0], r[1]) for r in rows if r[0] in movers}, {r[1] for r in rows})
    return sorted((({j for k, j in vs if k == "f"}, len(vs)) for vs in found), key=lambda x: (-x[1], min(x[0])))


def plain_loose(rows, group):
    """Pairs whose rows hold the graph together, by taking each out."""
    movers = {r[0] for r in rows if r[3] > 0}
    pairs = {(r[0], r[1]) for r in rows if r[0] in movers}
    firms = {j for _, j in pairs}
    before = len(pieces(pairs, firms))
    if group == "worker":
        gone = {i for i in movers if len(pieces({p for p in pairs if p[0] != i}, firms)) > before}
        return {(i, j) for i, j in ((r[0], r[1]) for r in rows) if i in gone}
    out = set()
    for p in pairs:
        left = pairs - {p}
        workers = {i for i, _ in left}
        if len(pieces(left, firms)) + (p[0] not in workers) > before:
            own = sorted(r[2] for r in rows if (r[0], r[1]) == p)
            places = [k for k, r in enumerate(sorted((r for r in rows if r[0] == p[0]), key=lambda r: r[2])) if r[1] == p[1]]
            spells = 1 + sum(b - a > 1 for a, b in zip(places, places[1:], strict=False))
            if group == "match" or (len(own) if group == "observation" else spells) == 1:
                out.add(p)
    return out


def plain_leave_out(rows, group, name):
    best = []

    def explore(own, parts):
        for firms, _ in parts:
            kept = with_m([r for r in own if r[1] in firms])
            if best and plain_size(best[0], name) >= plain_size(kept, name):
                continue
            while True:
                moves = [r[1] for r in kept if r[3] > 0]
                less = with_m([r for r in kept if moves.count(r[1]) >= 2])
                if len(less) == len(kept):
                    break
                kept = less
            if best and plain_size(best[0], name) >= plain_size(kept, name):
                continue
            if loose := plain_loose(kept, group):
                after = plain_parts(with_m([r for r in kept if (r[0], r[1]) not in loose]))
                if len(after) > 1:
                    explore(kept, after)
                    continue
            if not best or plain_size(kept, name) > plain_size(best[0], name):
                best[:] = [kept]

    explore(rows, plain_parts(rows))
    return best[0] if best else []


def random_panel(seed, workers=9, firms=10):
    r = random.Random(seed)
    return with_m([(i, r.randrange(firms), t) for i in range(workers) for t in range(r.randint(1, 4))])


NAMES = [*SIZE, *(f"firms_plus_{x}" for x in ("workers", "stayers", "movers")), "length", "length_stayers", "length_movers"]


def test_sizes_of_parts(panel):
    rows = random_panel(1) + [(50 + r[0], 50 + r[1], *r[2:]) for r in random_panel(2, 5, 6)]
    rows = [r for r in rows if r[1] not in (3, 4)]
    rows = with_m(rows)
    p = panel([(i, j, 1.0, t) for i, j, t, _ in rows]).gen_m()
    parts = firm_parts(p, worker_links(p).where("dst % 2 = 0"))  # workers whose rows lie in several parts
    groups = {}
    for x in parts.collect():
        groups.setdefault(x.component, set()).add(x.j)
    for name in NAMES:
        got = {x.component: x["size"] for x in part_sizes(p, parts, name).collect()}
        assert got == {c: plain_size(with_m([r for r in rows if r[1] in js]), name) for c, js in groups.items()}, name


@pytest.mark.parametrize("group, name, seed", [("observation", "workers", 3), ("spell", "len", 4), ("match", "firms_plus_movers", 5), ("worker", "moves", 6), ("observation", "firms", 7), ("worker", "firms_plus_movers", 8)])
def test_leave_out_against_recursion(panel, rows_of, group, name, seed):
    rows = random_panel(seed)
    want = plain_leave_out(rows, group, name)
    assert want
    got = panel([(i, j, 1.0, t) for i, j, t, _ in rows]).gen_m().connected(f"leave_out_{group}", size=name)
    assert rows_of(got, "i", "j", "t", "m") == sorted(want)


def test_jobs_grow_with_levels_and_not_with_parts(panel):
    """Four copies of a network are looked at by as many tables as one."""
    from pairloom.plans import scratch

    def tables(copies):
        rows = [(100 * c + i, 100 * c + j, 1.0, t) for c in range(copies) for i, j, t, _ in random_panel(5)]
        p = panel(rows).gen_m()
        before = len(scratch._made)
        got = p.connected("leave_out_match", size="len")
        return len(scratch._made) - before, got.df.count()

    one, four = tables(1), tables(4)
    assert one[1] == four[1] and four[0] <= one[0] + 2


@pytest.mark.parametrize("group, name, seed", [("match", "stays", 11), ("observation", "firms_plus_stayers", 12)])
def test_leave_out_by_sizes_that_may_grow(panel, rows_of, group, name, seed):
    rows = random_panel(seed, 14, 12) + [(50 + r[0], 50 + r[1], *r[2:]) for r in random_panel(seed + 50, 7, 6)]
    want = plain_leave_out(rows, group, name)
    got = panel([(i, j, 1.0, t) for i, j, t, _ in rows]).gen_m().connected(f"leave_out_{group}", size=name)
    assert rows_of(got, "i", "j", "t", "m") == sorted(want)
