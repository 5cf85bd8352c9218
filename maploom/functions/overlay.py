"""Boolean operations on polygons of any form, with holes, and their repair, for Arrow batches.

A geometry is a list of polygons, a polygon a shell and a list of holes, a ring an (n, 2) array without a closing point.

All rings' sides are cut where they meet, on a grid of 2 ** 26 steps along the longer side of what is combined, so
that every test of direction is exact in whole numbers. A piece of a side has the winding numbers of both operands on
either hand, counted along a ray; it bounds the result where one hand is inside and the other is not. Pieces are then
followed with the inside on their left, loops that touch themselves are parted, those thinner than a step dropped, and
holes go to the least shell around them. Many items go through this at once, each on its own grid. Points that were given keep their coordinates to the last bit; those where sides cross are computed from them.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np

Polygon = tuple[np.ndarray, list[np.ndarray]]
STEPS = 1 << 26
PAIRS = 1 << 20
ROUNDS = 30
#: So many items share calls of numpy (their number takes 9 bits of a point's key); rings of so many points meet themselves whole.
ITEMS, SMALL = 512, 64


def signed_area(ring: np.ndarray) -> float:
    d = ring - ring[0]
    x, y = d[:, 0], d[:, 1]
    return float(np.dot(x, np.roll(y, -1)) - np.dot(y, np.roll(x, -1))) / 2


def area(geometry: list[Polygon]) -> float:
    return sum(abs(signed_area(shell)) - sum(abs(signed_area(h)) for h in holes) for shell, holes in geometry)


def _cross(ax, ay, bx, by):
    return ax * by - ay * bx


def _near_pairs(low: np.ndarray, high: np.ndarray):
    """Pairs of boxes that meet, in pieces of bounded size: a sweep along x."""
    order = np.argsort(low[:, 0], kind="stable")
    ends = np.searchsorted(low[order, 0], high[order, 0], side="right")
    sizes = ends - np.arange(len(order)) - 1
    first = 0
    while first < len(order):
        last = max(first + 1, int(np.searchsorted(np.cumsum(sizes[first:]), PAIRS)) + first)
        n = sizes[first:last]
        i = np.repeat(np.arange(first, last), n)
        j = i + 1 + np.arange(int(n.sum())) - np.repeat(np.cumsum(n) - n, n)
        i, j = order[i], order[j]
        keep = (low[i, 1] <= high[j, 1]) & (low[j, 1] <= high[i, 1])
        yield i[keep], j[keep]
        first = last


def _rings_in(geometries: list[list[Polygon]]) -> list[tuple[np.ndarray, bool]]:
    return [(r, outer) for shell, holes in geometries for r, outer in [(shell, True), *((h, False) for h in holes)] if len(r) > 2]


def _sums(values: np.ndarray, first: np.ndarray) -> np.ndarray:
    """Sums of values from each place in first to the next; no part is empty."""
    return np.add.reduceat(values, first) if len(first) else np.zeros(0, values.dtype)


def round_trips(sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For rings of these sizes one behind the other, where each begins, and each point's next."""
    first = np.cumsum(sizes) - sizes
    after = np.arange(1, int(sizes.sum()) + 1)
    after[first + sizes - 1] = first
    return first, after


class _Net:
    """Sides of rings on the grid, of many items at once that do not meet: each has a grid of its own.

    Points are numbered through all items; pieces are rows (from, to, operand, side they are of, item).
    """

    def __init__(self, items: list[tuple[list[Polygon], ...]]):
        rings = [(n, k, r, outer) for n, operands in enumerate(items) for k, geometry in enumerate(operands) for r, outer in _rings_in(geometry)]
        sizes = np.array([len(r) for _, _, r, _ in rings], np.int64)
        first, after = round_trips(sizes)
        flat = np.concatenate([r for _, _, r, _ in rings]) if rings else np.zeros((0, 2))
        of = np.repeat(np.arange(len(rings)), sizes)
        item = np.array([n for n, _, _, _ in rings], np.int64)[of] if rings else np.zeros(0, np.int64)
        operand = np.array([k for _, k, _, _ in rings], np.int64)[of] if rings else np.zeros(0, np.int64)
        self.origin, self.step = np.zeros((len(items), 2)), np.ones(len(items))
        if rings:
            begin = np.flatnonzero(np.diff(item, prepend=-1))
            some, low, high = item[begin], np.minimum.reduceat(flat, begin), np.maximum.reduceat(flat, begin)
            extent = (high - low).max(axis=1)
            self.origin[some] = low
            self.step[some] = np.where(extent > 0, extent / STEPS, 1.0)
        # shells counter-clockwise, holes clockwise
        d = flat - flat[first[of]]
        size = _sums(_cross(d[:, 0], d[:, 1], d[after, 0], d[after, 1]), first)
        turn = (size >= 0) != np.array([outer for _, _, _, outer in rings], bool)
        place = np.arange(len(flat))
        flat = flat[np.where(turn[of], 2 * first[of] + sizes[of] - 1 - place, place)]
        self.keys, self.numbers = np.zeros(0, np.int64), np.zeros(0, np.int64)
        self.grid, self.real, self.item = np.zeros((0, 2), np.int64), np.zeros((0, 2)), np.zeros(0, np.int64)
        at = self.points(flat, item)
        self.given = len(self.grid)
        some = at != at[after]
        self.pieces = np.column_stack([at, at[after], operand, place, item])[some]

    def points(self, real: np.ndarray, item: np.ndarray) -> np.ndarray:
        """The numbers of places, new ones in order; the first place of a step of the grid stands for all."""
        cell = np.rint((real - self.origin[item]) / self.step[item, None]).astype(np.int64)
        keys, first, of = np.unique((item << 54) + (cell[:, 0] << 27) + cell[:, 1], return_index=True, return_inverse=True)
        at = np.searchsorted(self.keys, keys)
        known = at < len(self.keys)
        known[known] = self.keys[at[known]] == keys[known]
        numbers = np.empty(len(keys), np.int64)
        numbers[known] = self.numbers[at[known]]
        fresh = np.flatnonzero(~known)
        fresh = fresh[np.argsort(first[fresh])]
        numbers[fresh] = len(self.grid) + np.arange(len(fresh))
        rows = first[fresh]
        self.grid, self.real, self.item = np.concatenate([self.grid, cell[rows]]), np.concatenate([self.real, real[rows]]), np.concatenate([self.item, item[rows]])
        self.keys, self.numbers = np.concatenate([self.keys, keys[fresh]]), np.concatenate([self.numbers, numbers[fresh]])
        order = np.argsort(self.keys)
        self.keys, self.numbers = self.keys[order], self.numbers[order]
        return numbers[of.ravel()]

    def cut(self) -> None:
        """Cuts pieces until none meets another but at ends. A crossing moves to the grid, which may make others."""
        done = self.pieces[:0]
        for _ in range(ROUNDS):
            grid, real = self.grid, self.real
            a, b, item = self.pieces[:, 0], self.pieces[:, 1], self.pieces[:, 4]
            p, q = grid[a], grid[b]
            apart = np.stack([item << 28, np.zeros_like(item)], axis=1)  # boxes of different items never meet
            splits = []
            for i, j in _near_pairs(np.minimum(p, q) + apart, np.maximum(p, q) + apart):
                r, s = q[i] - p[i], q[j] - p[j]
                # an end of one within the other
                sides = []
                for e, f, d, end in ((i, j, r, a), (i, j, r, b), (j, i, s, a), (j, i, s, b)):
                    w = grid[end[f]] - p[e]
                    side = _cross(d[:, 0], d[:, 1], w[:, 0], w[:, 1])
                    along = (d * w).sum(axis=1)
                    size = (d * d).sum(axis=1)
                    # no further off than a step, which is how far rounding may have moved it
                    on = (np.abs(side) <= np.sqrt(size)) & (along > 0) & (along < size) & (end[f] != a[e]) & (end[f] != b[e])
                    splits.append((e[on], end[f][on]))
                    sides.append(np.where(on, 0, np.sign(side)))
                cross = np.flatnonzero((sides[0] * sides[1] < 0) & (sides[2] * sides[3] < 0))
                if not len(cross):
                    continue
                e, f = i[cross], j[cross]
                u, v, w = real[b[e]] - real[a[e]], real[b[f]] - real[a[f]], real[a[f]] - real[a[e]]
                den = _cross(u[:, 0], u[:, 1], v[:, 0], v[:, 1])
                t = np.where(den != 0, np.clip(_cross(w[:, 0], w[:, 1], v[:, 0], v[:, 1]) / np.where(den != 0, den, 1), 0, 1), 0.5)
                at = self.points(real[a[e]] + t[:, None] * u, item[e])
                splits += [(k[(at != a[k]) & (at != b[k])], at[(at != a[k]) & (at != b[k])]) for k in (e, f)]
            of, at = (np.concatenate([np.zeros(0, np.int64), *(x[n] for x in splits)]) for n in (0, 1))
            if not len(of):
                break
            of, at = np.divmod(np.unique(of * len(self.grid) + at), len(self.grid))
            along = ((self.grid[at] - grid[a[of]]) * (q[of] - p[of])).sum(axis=1)
            order = np.lexsort((along, of))
            of, at = of[order], at[order]
            first = np.concatenate(([True], of[1:] != of[:-1]))
            last = np.concatenate((of[1:] != of[:-1], [True]))
            whole = np.setdiff1d(np.arange(len(self.pieces)), of)
            row = lambda x, y, k: np.column_stack([x, y, self.pieces[k, 2:]])
            begin = np.where(first, a[of], np.roll(at, 1))
            # items without a split are done
            open_ = np.zeros(int(item.max()) + 1, bool)
            open_[item[of]] = True
            pieces = np.concatenate([self.pieces[whole], row(begin, at, of), row(at[last], b[of[last]], of[last])])
            pieces = pieces[pieces[:, 0] != pieces[:, 1]]
            more = open_[pieces[:, 4]]
            done, self.pieces = np.concatenate([done, pieces[~more]]), pieces[more]
        self.pieces = np.concatenate([done, self.pieces])


def _hands(p: np.ndarray, q: np.ndarray, times: np.ndarray, item: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Winding numbers left and right of each piece from p to q, p the lesser point; times: how often each operand goes that
    way. Pieces are in the order of their items, and only those of one item count for each other."""
    left, right = np.zeros_like(times), np.zeros_like(times)
    upright = p[:, 0] == q[:, 0]
    middle = p + q  # doubled
    for flat in (True, False):
        own = np.flatnonzero(upright != flat)
        x, y = (0, 1) if flat else (1, 0)
        # the others in the direction in which x grows: a ray along y meets them
        other = np.flatnonzero(p[:, x] != q[:, x])
        swap = p[other, x] > q[other, x]
        low, high = np.where(swap[:, None], q[other], p[other]), np.where(swap[:, None], p[other], q[other])
        signed = np.where(swap[:, None], -times[other], times[other])
        begin, end = (np.searchsorted(item[other], item[own], side=s) for s in ("left", "right"))
        reach = np.cumsum(end - begin)
        first = 0
        while first < len(own):
            last = max(first + 1, int(np.searchsorted(reach, (reach[first - 1] if first else 0) + PAIRS, side="right")))
            n = (end - begin)[first:last]
            of = np.repeat(np.arange(first, last), n)
            k = np.arange(int(n.sum())) - np.repeat(np.cumsum(n) - n - begin[first:last], n)
            m = middle[own[of]]
            hit = np.flatnonzero((2 * low[k, x] <= m[:, x]) & (m[:, x] < 2 * high[k, x]))
            of, k, m = of[hit], k[hit], m[hit]
            beyond = (high[k, x] - low[k, x]) * (m[:, y] - 2 * low[k, y]) - (high[k, y] - low[k, y]) * (m[:, x] - 2 * low[k, x]) < 0
            of, k = of[beyond] - first, k[beyond]
            total = np.stack([np.bincount(of, signed[k, c], last - first) for c in range(times.shape[1])], axis=1).astype(np.int64)
            at = own[first:last]
            if flat:
                left[at], right[at] = -total, -total - times[at]
            else:
                right[at], left[at] = total, total + times[at]
            first = last
    return left, right


def _followed(a: np.ndarray, b: np.ndarray, points: np.ndarray) -> list[list[int]]:
    """Loops of pieces from a to b with the inside on their left; where several leave a point, the one that bounds the same part."""
    leaving = np.bincount(a, minlength=len(points))
    only = np.full(len(points), -1)
    only[a] = np.arange(len(a))
    only[leaving > 1] = -2
    several = np.flatnonzero(leaving[a] > 1)
    d = points[b[several]] - points[a[several]]
    leaves: dict[int, list[tuple[float, int]]] = {}
    for s, angle, n in zip(a[several].tolist(), np.arctan2(d[:, 1], d[:, 0]).tolist(), several.tolist(), strict=True):
        leaves.setdefault(s, []).append((angle, n))
    for rows in leaves.values():
        rows.sort()
    from_, to, follows = a.tolist(), b.tolist(), only[b].tolist()
    used, loops = [False] * len(from_), []
    for start in range(len(from_)):
        if used[start]:
            continue
        loop, n = [], start
        while not used[n]:
            used[n] = True
            loop.append(from_[n])
            if (after := follows[n]) >= 0:
                if used[after] and after != start:
                    break
                n = after
                continue
            rows = [r for r in leaves.get(to[n], ()) if not used[r[1]] or r[1] == start]
            if not rows:
                break
            back = points[from_[n]] - points[to[n]]
            angle = float(np.arctan2(back[1], back[0]))
            before = [r for r in rows if r[0] < angle]
            n = (before or rows)[-1][1]
        loops.append(loop)
    parted = []
    for loop in loops:
        if len(set(loop)) == len(loop):
            parted.append(loop)
            continue
        place: dict[int, int] = {}
        stack: list[int] = []
        for v in loop:
            if v in place:
                cut = place[v]
                parted.append(stack[cut:])
                for w in stack[cut + 1 :]:
                    del place[w]
                del stack[cut + 1 :]
            else:
                place[v] = len(stack)
                stack.append(v)
        parted.append(stack)
    return [p for p in parted if len(p) > 2]


def _within(at: np.ndarray, ring: np.ndarray) -> bool:
    """Whether a doubled place lies in a ring of the grid, whose sides do not touch it."""
    p, q = 2 * ring, 2 * np.roll(ring, -1, axis=0)
    spans = (p[:, 1] <= at[1]) != (q[:, 1] <= at[1])
    side = _cross(q[:, 0] - p[:, 0], q[:, 1] - p[:, 1], at[0] - p[:, 0], at[1] - p[:, 1])
    return bool((spans & ((side > 0) == (q[:, 1] > p[:, 1]))).sum() % 2)


def combined(one: list[Polygon], two: list[Polygon], inside: Callable) -> list[Polygon]:
    """The polygons where inside(in one, in two) holds; both are given as boolean arrays. A place is in an operand where its
    rings wind around it. Shells come out counter-clockwise, holes clockwise, each ring without crossings."""
    return combined_each([one], [two], inside)[0]


def combined_each(ones: list[list[Polygon]], twos: list[list[Polygon]], inside: Callable) -> list[list[Polygon]]:
    """combined for each two, many at a time."""
    both = list(zip(ones, twos, strict=True))
    return [found for k in range(0, len(both), ITEMS) for found in _combined(both[k : k + ITEMS], inside)]


def _combined(items: list[tuple[list[Polygon], list[Polygon]]], inside: Callable) -> list[list[Polygon]]:
    net = _Net(items)
    net.cut()
    if not len(net.pieces):
        return [[] for _ in items]
    grid = net.grid
    a, b = net.pieces[:, 0], net.pieces[:, 1]
    less = (grid[a, 0] < grid[b, 0]) | ((grid[a, 0] == grid[b, 0]) & (grid[a, 1] < grid[b, 1]))
    ends = np.where(less, a, b) * len(grid) + np.where(less, b, a)
    unique, first, of = np.unique(ends, return_index=True, return_inverse=True)
    times = np.zeros((len(unique), 2), np.int64)
    np.add.at(times, (of.ravel(), net.pieces[:, 2]), np.where(less, 1, -1))
    order = np.argsort(net.pieces[first, 4], kind="stable")
    order = order[times[order].any(axis=1)]
    unique, times, side, item = unique[order], times[order], net.pieces[first[order], 3], net.pieces[first[order], 4]
    low, high = np.divmod(unique, len(grid))
    left, right = _hands(grid[low], grid[high], times, item)
    l_in, r_in = inside(left[:, 0] != 0, left[:, 1] != 0), inside(right[:, 0] != 0, right[:, 1] != 0)
    bound = np.flatnonzero(l_in != r_in)
    forth = l_in[bound]
    start, stop = np.where(forth, low[bound], high[bound]), np.where(forth, high[bound], low[bound])
    loops = _followed(start, stop, grid)
    found: list[list[Polygon]] = [[] for _ in items]
    if not loops:
        return found
    at, sizes = np.concatenate([np.array(loop, np.int64) for loop in loops]), np.array([len(loop) for loop in loops], np.int64)
    begin, after = round_trips(sizes)
    d = (grid[at] - np.repeat(grid[at[begin]], sizes, axis=0)).astype(float)
    turn = _sums(_cross(d[:, 0], d[:, 1], d[after, 0], d[after, 1]), begin)
    # thinner than the grid's step is what rounding left between sides on one line
    wide = np.abs(turn) > _sums(np.hypot(*(d[after] - d).T), begin)
    # cuts that the result does not need
    edges = start * len(grid) + stop
    sort = np.argsort(edges)
    own = side[bound][sort][np.searchsorted(edges[sort], at * len(grid) + at[after])]
    before = np.empty_like(own)
    before[after] = own
    keep = (at < net.given) | (before != own)
    keep |= np.repeat(_sums(keep.astype(np.int64), begin) <= 2, sizes)
    drawn = np.split(net.real[at[keep]], np.cumsum(_sums(keep.astype(np.int64), begin))[:-1])
    shells: dict[int, list] = {}
    holes = []
    for n, (of, size, ok) in enumerate(zip(net.item[at[begin]].tolist(), turn.tolist(), wide.tolist(), strict=True)):
        if ok and size > 0:
            shells.setdefault(of, []).append((size, n, drawn[n], []))
        elif ok:
            holes.append((of, n))
    for own_shells in shells.values():
        own_shells.sort(key=lambda s: s[0])
    for of, n in holes:
        place = grid[loops[n][0]] + grid[loops[n][1]]
        around = next((s for s in shells.get(of, ()) if _within(place, grid[loops[s[1]]])), None)
        if around is not None:
            around[3].append(drawn[n])
    for of, own_shells in shells.items():
        found[of] = [(ring, inner) for _, _, ring, inner in reversed(own_shells)]
    return found


def intersection(one: list[Polygon], two: list[Polygon]) -> list[Polygon]:
    return combined(one, two, np.logical_and)


def difference(one: list[Polygon], two: list[Polygon]) -> list[Polygon]:
    return combined(one, two, _inside_one_alone)


def union(one: list[Polygon], two: list[Polygon]) -> list[Polygon]:
    return combined(one, two, np.logical_or)


def _inside_one_alone(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return a & ~b


def repaired_each(geometries: list[list[Polygon]]) -> list[list[Polygon]]:
    """Valid polygons of the same place: all that a shell winds around, either way, less what its holes do.

    Repeated points, spikes and rings without area go; both lobes of a bow tie stay, as two polygons.
    """
    shells = [[(shell, []) for shell, _ in g] for g in geometries]
    holes = [[(h, []) for _, own in g for h in own] for g in geometries]
    return combined_each(shells, holes, _inside_one_alone)


def repaired(geometry: list[Polygon]) -> list[Polygon]:
    return repaired_each([geometry])[0]


def area_each(geometries: list[list[Polygon]]) -> np.ndarray:
    """Shells less holes, of each."""
    rings = [(n, r, sign) for n, g in enumerate(geometries) for shell, holes in g for r, sign in [(shell, 1), *((h, -1) for h in holes)] if len(r)]
    if not rings:
        return np.zeros(len(geometries))
    sizes = np.array([len(r) for _, r, _ in rings], np.int64)
    first, after = round_trips(sizes)
    flat = np.concatenate([r for _, r, _ in rings])
    d = flat - np.repeat(flat[first], sizes, axis=0)
    own = np.abs(_sums(_cross(d[:, 0], d[:, 1], d[after, 0], d[after, 1]), first)) / 2
    return np.bincount([n for n, _, _ in rings], own * [sign for _, _, sign in rings], len(geometries))


def _simple_each(rings: list[np.ndarray]) -> np.ndarray:
    """kernels.is_simple of each; the sides of small rings meet all at once."""
    from maploom.functions.kernels import is_simple

    out = np.ones(len(rings), bool)
    small = np.array([2 < len(r) <= SMALL for r in rings], bool)
    for n in np.flatnonzero(~small).tolist():
        out[n] = is_simple(rings[n])
    own = np.flatnonzero(small)
    for k in range(0, len(own), ITEMS):
        at = own[k : k + ITEMS]
        sizes = np.array([len(rings[n]) for n in at.tolist()], np.int64)
        first, after = round_trips(sizes)
        a = np.concatenate([rings[n] for n in at.tolist()])
        b = a[after]
        bad = _sums(_cross(a[:, 0], a[:, 1], b[:, 0], b[:, 1]), first) == 0
        of = np.repeat(np.arange(len(at)), sizes)
        more = (first + sizes)[of] - np.arange(len(a)) - 1  # sides of the same ring that follow
        i = np.repeat(np.arange(len(a)), more)
        j = i + 1 + np.arange(len(i)) - np.repeat(np.cumsum(more) - more, more)
        p, q, r, s = a[i], b[i], a[j], b[j]
        turn = lambda p, q, r: np.sign(_cross(q[:, 0] - p[:, 0], q[:, 1] - p[:, 1], r[:, 0] - p[:, 0], r[:, 1] - p[:, 1]))
        within = lambda p, q, r: (np.minimum(p, q) <= r).all(axis=1) & (r <= np.maximum(p, q)).all(axis=1)
        one, two, three, four = turn(p, q, r), turn(p, q, s), turn(r, s, p), turn(r, s, q)
        met = ((one * two < 0) & (three * four < 0)) | (p == r).all(axis=1)
        for side, e, f, g, other in ((one, p, q, r, q), (two, p, q, s, p), (three, r, s, p, s), (four, r, s, q, r)):
            met |= (side == 0) & within(e, f, g) & (g != other).any(axis=1)
        bad[of[i[met]]] = True
        out[at] = ~bad
    return out


def is_valid_each(geometries: list[list[Polygon]]) -> np.ndarray:
    """Whether rings neither cross nor touch themselves nor cross each other, and holes lie in their shells."""
    rings = [(n, r) for n, g in enumerate(geometries) for shell, holes in g for r in (shell, *holes)]
    out, count = np.ones(len(geometries), bool), np.bincount([n for n, _ in rings], minlength=len(geometries))
    simple = _simple_each([r for _, r in rings])
    out[[n for (n, _), ok in zip(rings, simple.tolist(), strict=True) if not ok]] = False
    # a single ring that is simple is valid; of several some may cross
    several = np.flatnonzero(out & (count > 1)).tolist()
    for k in range(0, len(several), ITEMS):
        at = several[k : k + ITEMS]
        net = _Net([(geometries[n],) for n in at])
        pieces, corners = np.bincount(net.pieces[:, 4], minlength=len(at)), np.concatenate([r for n in at for r, _ in _rings_in(geometries[n])])
        number = net.points(corners, np.repeat(np.arange(len(at)), [sum(len(r) for r, _ in _rings_in(geometries[n])) for n in at]))
        grid = net.grid[number]
        net.cut()
        ends = np.sort(net.pieces[:, :2], axis=1)
        distinct = net.pieces[np.unique(ends[:, 0] * len(net.grid) + ends[:, 1], return_index=True)[1], 4]
        whole = (np.bincount(net.pieces[:, 4], minlength=len(at)) == pieces) & (np.bincount(distinct, minlength=len(at)) == pieces)
        place = 0
        for n, ok in zip(at, whole.tolist(), strict=True):
            for shell, holes in geometries[n]:
                outer, place = grid[place : place + len(shell)], place + len(shell)
                for hole in holes:
                    inner, place = grid[place : place + len(hole)], place + len(hole)
                    ok = ok and _within(inner[0] + inner[1], outer)
            out[n] = ok
    return out


def is_valid(geometry: list[Polygon]) -> bool:
    return bool(is_valid_each([geometry])[0])


def contains(geometry: list[Polygon], p) -> bool:
    """Whether a place lies in one of the polygons, not in a hole of it."""

    def within(ring: np.ndarray) -> bool:
        a, b = ring, np.roll(ring, -1, axis=0)
        spans = (a[:, 1] <= p[1]) != (b[:, 1] <= p[1])
        with np.errstate(divide="ignore", invalid="ignore"):
            x = a[:, 0] + (p[1] - a[:, 1]) / (b[:, 1] - a[:, 1]) * (b[:, 0] - a[:, 0])
        return bool((spans & (x > p[0])).sum() % 2)

    return any(within(shell) and not any(within(h) for h in holes) for shell, holes in geometry)
