"""Boolean operations of polygons against points, areas and each other."""

import time

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from maploom.functions import overlay


def ring(*points):
    return np.array(points, float)


def box(x, y, w, h):
    return ring((x, y), (x + w, y), (x + w, y + h), (x, y + h))


def poly(shell, *holes):
    return [(shell, list(holes))]


L = ring((0, 0), (10, 0), (10, 4), (4, 4), (4, 10), (0, 10))
U = ring((0, 0), (12, 0), (12, 10), (8, 10), (8, 3), (4, 3), (4, 10), (0, 10))


@pytest.mark.parametrize(
    "one,two,shared",
    [
        (poly(L), poly(box(2, 2, 20, 20)), 2 * 8 + 2 * 6),
        (poly(U), poly(box(-1, 5, 20, 2)), 2 * 4 * 2),
        (poly(box(0, 0, 10, 10), box(2, 2, 6, 6)), poly(box(0, 0, 5, 10)), 50 - 18),
        (poly(box(0, 0, 10, 10)), poly(box(10, 0, 5, 10)), 0),
        (poly(box(0, 0, 10, 10)), poly(box(0, 0, 10, 10)), 100),
        (poly(box(0, 0, 10, 10)), poly(box(3, 3, 2, 2)), 4),
        (poly(L), poly(ring((5, -1), (11, 5), (5, 11), (-1, 5))), None),
    ],
)
def test_areas_add_up(one, two, shared):
    both, left, right, all_ = overlay.intersection(one, two), overlay.difference(one, two), overlay.difference(two, one), overlay.union(one, two)
    if shared is not None:
        assert overlay.area(both) == pytest.approx(shared)
    assert overlay.area(both) + overlay.area(left) == pytest.approx(overlay.area(one))
    assert overlay.area(both) + overlay.area(left) + overlay.area(right) == pytest.approx(overlay.area(all_))
    assert all(overlay.is_valid(g) for g in (both, left, right, all_))


def test_a_cut_through_a_u_leaves_three_parts_and_a_cut_within_a_hole():
    assert len(overlay.difference(poly(U), poly(box(-1, 5, 20, 1)))) == 3
    holed = overlay.difference(poly(box(0, 0, 10, 10)), poly(box(2, 2, 3, 3)))
    assert len(holed) == 1 and len(holed[0][1]) == 1 and overlay.area(holed) == 91
    assert overlay.difference(poly(box(2, 2, 3, 3)), poly(box(0, 0, 10, 10))) == []
    # a hole that touches its shell at a corner is still a ring of its own
    touch = overlay.difference(poly(box(0, 0, 10, 10)), poly(ring((5, 0), (7, 3), (3, 3))))
    assert overlay.area(touch) == pytest.approx(94) and overlay.is_valid([(touch[0][0], [])])


def test_repair():
    bow = overlay.repaired(poly(ring((0, 0), (10, 10), (10, 0), (0, 10))))
    assert len(bow) == 2 and overlay.area(bow) == pytest.approx(50) and overlay.is_valid(bow[:1]) and overlay.is_valid(bow[1:])
    spike = overlay.repaired(poly(ring((0, 0), (10, 0), (20, 0), (10, 0), (10, 10), (0, 10))))
    assert overlay.area(spike) == 100 and len(spike[0][0]) in (4, 5)
    assert overlay.area(overlay.repaired(poly(ring((0, 0), (0, 0), (4, 0), (4, 4), (4, 4), (0, 4))))) == 16
    assert overlay.repaired(poly(ring((0, 0), (4, 4), (8, 8)))) == [] and overlay.repaired([]) == []
    twice = overlay.repaired(poly(ring((0, 0), (4, 0), (4, 4), (0, 4), (0, 0), (4, 0), (4, 4), (0, 4))))
    assert overlay.area(twice) == 16
    out = overlay.repaired(poly(box(0, 0, 4, 4), box(3, 3, 4, 4)))
    assert overlay.area(out) == 15 and overlay.is_valid(out)
    assert not overlay.is_valid(poly(box(0, 0, 4, 4), box(3, 3, 4, 4))) and not overlay.is_valid(poly(box(0, 0, 4, 4), box(9, 9, 1, 1)))


coordinate = st.integers(0, 12)
points = st.lists(st.tuples(coordinate, coordinate), min_size=3, max_size=9)
fine = st.lists(st.tuples(st.floats(0, 100), st.floats(0, 100)), min_size=3, max_size=12)


def winds(rings, p):
    """The winding number of p, by angles."""
    total = 0.0
    for r in rings:
        d = r - p
        angle = np.arctan2(d[:, 1], d[:, 0])
        step = np.diff(np.append(angle, angle[0]))
        total += ((step + np.pi) % (2 * np.pi) - np.pi).sum()
    return round(total / (2 * np.pi)) != 0


@settings(max_examples=120, deadline=None)
@given(st.one_of(st.tuples(points, points), st.tuples(fine, fine)))
def test_rings_that_cross_themselves_combine_as_points_do(rings):
    one, two = (ring(*r) for r in rings)
    results = {f: f(poly(one), poly(two)) for f in (overlay.intersection, overlay.difference, overlay.union)}
    for g in results.values():
        assert all(overlay.is_valid([(s, [])]) and overlay.signed_area(s) > 0 for s, _ in g)
    rng = np.random.default_rng(1)
    for p in rng.uniform(0, 12 if max(map(max, rings[0])) <= 12 else 100, (25, 2)):
        if min(_away(p, one), _away(p, two)) < 1e-4:
            continue
        a, b = winds([one], p), winds([two], p)
        assert overlay.contains(results[overlay.intersection], p) == (a and b)
        assert overlay.contains(results[overlay.difference], p) == (a and not b)
        assert overlay.contains(results[overlay.union], p) == (a or b)


def _away(p, r):
    a, d = r, np.roll(r, -1, axis=0) - r
    size = (d * d).sum(axis=1)
    t = np.clip(((p - a) * d).sum(axis=1) / np.where(size == 0, 1, size), 0, 1)
    return float(np.hypot(*(a + t[:, None] * d - p).T).min())


def test_many_at_once_are_as_one_by_one():
    """Items share calls, not grids: the results are those of each alone, in bounded time."""
    rng = np.random.default_rng(7)
    ones = [poly(rng.integers(0, 12, (rng.integers(3, 9), 2)).astype(float), *([box(2, 2, 3, 3)] if k % 3 else [])) if k % 7 else [] for k in range(60)]
    twos = [poly(rng.integers(0, 12, (rng.integers(3, 9), 2)) * 10.0 ** (k % 4)) if k % 11 else [] for k in range(60)]
    flat = lambda g: [[r.tolist() for r in (s, *h)] for s, h in g]
    for inside, alone in ((np.logical_and, overlay.intersection), (np.logical_or, overlay.union)):
        found = overlay.combined_each(ones, twos, inside)
        assert [sorted(flat(g)) for g in found] == [sorted(flat(alone(a, b))) for a, b in zip(ones, twos, strict=True)]
        assert overlay.area_each(found) == pytest.approx([overlay.area(g) for g in found])
    assert overlay.is_valid_each(ones).tolist() == [overlay.is_valid(g) for g in ones]
    start = time.monotonic()
    many = overlay.combined_each([poly(L + k) for k in range(20_000)], [poly(box(k + 2, k + 2, 20, 20)) for k in range(20_000)], np.logical_and)
    assert set(overlay.area_each(many).tolist()) == {28.0} and time.monotonic() - start < 15
