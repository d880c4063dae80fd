"""NumPy kernels over one set of points, all objectives minimised."""

from __future__ import annotations

import math

import numpy as np


def skyline(x: np.ndarray) -> np.ndarray:
    """Row numbers of the nondominated rows, the first of equal ones, by sort-filter in blocks.

    In order of their sums a row can only be dominated by an earlier one, so each block is filtered
    against the rows kept so far and then against itself.
    """
    n = len(x)
    if not n:
        return np.empty(0, np.int64)
    if x.shape[1] == 3:
        return _skyline3(x)
    if x.shape[1] == 2:
        order = np.lexsort((x[:, 1], x[:, 0]))
        least = np.minimum.accumulate(x[order, 1])
        return np.sort(order[np.append(True, least[1:] < least[:-1])])
    order = np.lexsort((*x.T[::-1], x.sum(1)))
    if n > 512:  # the rows of least sums strike out most others at once
        strong = order[:16]
        order = np.concatenate([strong, order[16:][~covered(x[order[16:]], x[strong])]])
    n, kept = len(order), np.empty(0, np.int64)
    for at in range(0, n, 256):
        block = order[at : at + 256]
        if len(kept):
            block = block[~covered(x[block], x[kept])]
        own = []
        for i in block:
            if not own or not (x[own] <= x[i]).all(1).any():
                own.append(i)
        kept = np.concatenate([kept, np.array(own, np.int64)])
    return np.sort(kept)


def _skyline3(x: np.ndarray) -> np.ndarray:
    """By one sweep over the third objective that keeps the staircase of the first two."""
    from bisect import bisect_left, bisect_right

    order = np.lexsort((x[:, 1], x[:, 0], x[:, 2]))
    if len(x) > 512:  # the rows of least sums strike out most others at once; of equal rows the first stays
        with np.errstate(invalid="ignore"):
            strong = np.argsort(x.sum(1), kind="stable")[:8]
        out = np.zeros(len(x), bool)
        for i in strong:
            out |= (x >= x[i]).all(1) & (x > x[i]).any(1)
        order = order[~out[order]]
    xs, ys, kept = [], [], []
    for i, a, b in zip(order.tolist(), x[order, 0].tolist(), x[order, 1].tolist(), strict=True):
        if (at := bisect_right(xs, a)) and ys[at - 1] <= b:
            continue
        at = to = bisect_left(xs, a)
        while to < len(xs) and ys[to] >= b:
            to += 1
        xs[at:to], ys[at:to] = [a], [b]
        kept.append(i)
    return np.sort(np.array(kept, np.int64))


def nondominated(x: np.ndarray) -> np.ndarray:
    """Whether each row is dominated by none; equal rows don't dominate each other."""
    points, back = np.unique(x, axis=0, return_inverse=True)
    out = np.zeros(len(points), bool)
    out[skyline(points)] = True
    return out[back.reshape(-1)]


def covered(x: np.ndarray, by: np.ndarray) -> np.ndarray:
    """Rows of x weakly dominated by a row of ``by``."""
    out = np.zeros(len(x), bool)
    for at in range(0, len(by), 512):
        left = np.flatnonzero(~out)
        if not len(left):
            break
        out[left] = (by[None, at : at + 512] <= x[left, None]).all(2).any(1)
    return out


def pareto_rank(x: np.ndarray) -> np.ndarray:
    """Index of the front of each row; equal rows share it."""
    points, back = np.unique(x, axis=0, return_inverse=True)
    back = back.reshape(-1)
    if points.shape[1] == 1:
        return back
    if points.shape[1] == 2:
        # by f1 and f2 ascending a row joins the first front whose last f2 is above its own
        rank, tails = np.empty(len(points), np.int64), []
        for i, y in enumerate(points[:, 1]):
            lo, hi = 0, len(tails)
            while lo < hi:
                mid = (lo + hi) // 2
                lo, hi = (mid + 1, hi) if tails[mid] <= y else (lo, mid)
            if lo == len(tails):
                tails.append(y)
            else:
                tails[lo] = y
            rank[i] = lo
        return rank[back]
    rank, left, level = np.full(len(points), -1), np.arange(len(points)), 0
    while len(left):
        front = skyline(points[left])
        rank[left[front]] = level
        left, level = np.delete(left, front), level + 1
    return rank[back]


def rank_after(x: np.ndarray, earlier: np.ndarray, ranks: np.ndarray, base: int = 0) -> np.ndarray:
    """Ranks of distinct rows that come after ``earlier`` ones of known ranks; at least ``base``.

    A row's rank is one above the highest of the rows that dominate it, all of which come before it in lexicographic order.
    """
    if x.shape[1] in (2, 3):
        return _rank_sweep(x, earlier, ranks, base)
    order = np.lexsort(x.T[::-1])
    x, out = x[order], np.full(len(x), base)
    high = np.argsort(-ranks, kind="stable")
    for at in range(0, len(x), 128):
        part, own = x[at : at + 128], out[at : at + 128]
        for lo in range(0, len(high), 1024):  # the highest ranks first
            rows = high[lo : lo + 1024]
            todo = np.flatnonzero(own <= ranks[rows[0]])
            if not len(todo):
                break
            beats = (earlier[rows][None] <= part[todo, None]).all(2)
            own[todo] = np.maximum(own[todo], np.where(beats, ranks[rows][None] + 1, 0).max(1))
    for i in range(1, len(x)):
        beats = (x[:i] <= x[i]).all(1)
        if beats.any():
            out[i] = max(out[i], out[:i][beats].max() + 1)
    back = np.empty(len(x), np.int64)
    back[order] = out
    return back


def _rank_sweep(x: np.ndarray, earlier: np.ndarray, ranks: np.ndarray, base: int) -> np.ndarray:
    """:func:`rank_after` for two and three objectives, by one sweep over the first.

    The highest rank up to a value of the last objective is a staircase.  For three objectives a Fenwick tree over the values of the second one
    (or of the third, whichever has fewer) holds such staircases.
    """
    from bisect import bisect_right

    points = np.concatenate([earlier, x])
    known = np.concatenate([np.asarray(ranks, np.int64), np.full(len(x), -1)])
    order = np.lexsort((known < 0, *points.T[::-1]))
    last, code = points[:, -1], np.ones(len(points), np.int64)
    if x.shape[1] == 3:
        two = [np.unique(points[:, i], return_inverse=True) for i in (1, 2)]
        k = int(len(two[1][0]) < len(two[0][0]))
        code, last = two[k][1].reshape(-1) + 1, points[:, 2 - k]
    size, out = int(code.max(initial=0)), known.copy()
    values, highs = [[] for _ in range(size + 1)], [[] for _ in range(size + 1)]
    for i, c, v, rank in zip(order.tolist(), code[order].tolist(), last[order].tolist(), known[order].tolist(), strict=True):
        if rank < 0:
            rank, at = base, c
            while at:
                if (to := bisect_right(values[at], v)) and highs[at][to - 1] >= rank:
                    rank = highs[at][to - 1] + 1
                at -= at & -at
            out[i] = rank
        while c <= size:
            vs, hs = values[c], highs[c]
            to = bisect_right(vs, v)
            if not to or hs[to - 1] < rank:
                lo = to - 1 if to and vs[to - 1] == v else to
                while to < len(hs) and hs[to] <= rank:
                    to += 1
                vs[lo:to], hs[lo:to] = [v], [rank]
            c += c & -c
    return out[len(earlier) :]


def hypervolume(x: np.ndarray, ref: np.ndarray) -> float:
    """Volume dominated by the rows and bounded by ``ref``: exclusive volumes against shrinking limit sets."""
    x = x[(x < ref).all(1)]
    if not len(x):
        return 0.0
    return _volume(x[skyline(x)], ref)


def _volume(x: np.ndarray, ref: np.ndarray) -> float:
    """``x`` mutually nondominated and below ``ref``."""
    n, d = x.shape
    if n == 1:
        return float(np.prod(ref - x[0]))
    if d == 1:
        return float(ref[0] - x.min())
    if d == 2:
        x = x[np.lexsort((x[:, 1], x[:, 0]))]
        width = np.append(x[1:, 0], ref[0]) - x[:, 0]
        return float(width @ (ref[1] - x[:, 1]))
    if d == 3:
        return _volume3(x, ref)
    if n == 2:
        both = np.maximum(x[0], x[1])
        return float(np.prod(ref - x[0]) + np.prod(ref - x[1]) - np.prod(ref - both))
    # worst last objective first: a limit set then agrees in it, and can be measured without it
    return first_volumes(x[np.argsort(-x[:, -1], kind="stable")], ref, n)


def first_volumes(x: np.ndarray, ref: np.ndarray, count: int) -> float:
    """Of mutually nondominated rows below ``ref``, the worst in the last objective first: what the first ``count`` dominate and no later row does."""
    total = 0.0
    for i in range(min(count, len(x))):
        limit = np.maximum(x[i + 1 :, :-1], x[i, :-1])
        inner = float(np.prod(ref[:-1] - x[i, :-1]))
        total += (inner - (_volume(limit[skyline(limit)], ref[:-1]) if len(limit) else 0.0)) * (ref[-1] - x[i, -1])
    return total


def _volume3(x: np.ndarray, ref: np.ndarray) -> float:
    """Sweep by the third objective over a staircase of the first two."""
    xs, ys = [-math.inf, float(ref[0])], [float(ref[1]), -math.inf]
    area = total = 0.0
    order = np.lexsort((x[:, 1], x[:, 0], x[:, 2]))
    points = x[order].tolist()
    from bisect import bisect_right

    for k, (a, b, z) in enumerate(points):
        i = bisect_right(xs, a) - 1
        if ys[i] > b:
            j, left = i + 1, a
            top = ys[i]
            gain = 0.0
            while ys[j] >= b:
                gain += (xs[j] - left) * (top - b)
                left, top = xs[j], ys[j]
                j += 1
            gain += (xs[j] - left) * (top - b)
            area += gain
            start = i if xs[i] == a else i + 1
            xs[start:j], ys[start:j] = [a], [b]
        nxt = points[k + 1][2] if k + 1 < len(points) else float(ref[2])
        total += area * (nxt - z)
    return total


def contributions(x: np.ndarray, ref: np.ndarray, ignore_dominated: bool = True) -> np.ndarray:
    """Volume that only each row dominates; 0 for equal rows and, among nondominated rows, for dominated ones."""
    out = np.zeros(len(x))
    inside = np.flatnonzero((x < ref).all(1))
    points, back, count = np.unique(x[inside], axis=0, return_inverse=True, return_counts=True)
    back = back.reshape(-1)
    if not len(inside):
        return out
    front = skyline(points)
    own = np.zeros(len(points))
    seen = front if ignore_dominated else np.arange(len(points))
    if x.shape[1] == 3:
        own[seen] = _contributions3(points[seen], ref)
    else:
        for i in front:
            if count[i] == 1:
                own[i] = exclusive(points[i], points[seen[seen != i]], ref)
    own[count > 1] = 0.0
    out[inside] = own[back]
    return out


def _contributions3(x: np.ndarray, ref: np.ndarray) -> np.ndarray:
    """Contributions of distinct rows below ``ref`` by one sweep over the third objective.

    The sweep keeps the staircase of the first two objectives.  What only a step covers of the plane is its rectangle up to its two
    neighbours, less what its ``inner`` points cover: points that no other step covers.  A step's volume grows by that area
    until the area changes, which happens only when a row enters beside it, above it or instead of it, so a row costs a search and what it takes away.
    """
    from bisect import bisect_left, bisect_right

    top, side = float(ref[1]), float(ref[0])
    xs, ys, ids = [-math.inf, side], [top, -math.inf], [-1, -1]
    n = len(x)
    volume, area, since = [0.0] * n, [0.0] * n, [0.0] * n
    inner: list[list[tuple[float, float]]] = [[] for _ in range(n)]  # first objective rising, second falling

    def settle(i: int, z: float) -> None:
        volume[i] += area[i] * (z - since[i])
        since[i] = z

    def covered_alone(a: float, b: float, right: float, up: float, points: list[tuple[float, float]]) -> float:
        total, at, height = 0.0, a, up
        for u, v in points:
            total += (u - at) * (height - b)
            at, height = u, v
        return total + (right - at) * (height - b)

    rows = x.tolist()
    for k in np.lexsort((x[:, 1], x[:, 0], x[:, 2])).tolist():
        a, b, z = rows[k]
        i = bisect_right(xs, a) - 1
        if ys[i] <= b:  # covered: it matters to a step that alone covers it
            if ys[i - 1] > b and ids[i] >= 0:
                p = ids[i]
                settle(p, z)
                points = inner[p]
                lo = hi = bisect_left(points, (a, -math.inf))
                while hi < len(points) and points[hi][1] >= b:
                    hi += 1
                if not (lo and points[lo - 1][1] <= b):
                    points[lo:hi] = [(a, b)]
                    area[p] = covered_alone(xs[i], ys[i], xs[i + 1], ys[i - 1], points)
            continue
        i = j = bisect_left(xs, a)
        while ys[j] >= b:
            settle(ids[j], z)
            j += 1
        gone = [*zip(xs[i:j], ys[i:j], strict=True)]
        for p in ids[i:j]:
            area[p], inner[p] = 0.0, []
        if (p := ids[i - 1]) >= 0:  # the step before loses what lies to the right of the row
            settle(p, z)
            points, edge = inner[p], xs[i]
            while points and points[-1][0] >= a:
                u, v = points.pop()
                area[p] -= (edge - u) * (v - ys[i - 1])
                edge = u
            area[p] -= (edge - a) * ((points[-1][1] if points else ys[i - 2]) - ys[i - 1])
        if (p := ids[j]) >= 0:  # the step after loses what lies above the row
            settle(p, z)
            points, edge, cut = inner[p], ys[j - 1], 0
            while cut < len(points) and points[cut][1] >= b:
                u, v = points[cut]
                area[p] -= (edge - v) * (u - xs[j])
                edge, cut = v, cut + 1
            del points[:cut]
            area[p] -= (edge - b) * ((points[0][0] if points else xs[j + 1]) - xs[j])
        inner[k], since[k] = gone, z
        area[k] = covered_alone(a, b, xs[j], ys[i - 1], gone)
        xs[i:j], ys[i:j], ids[i:j] = [a], [b], [k]
    for p in ids[1:-1]:
        settle(p, float(ref[2]))
    return np.array(volume)


def exclusive(p: np.ndarray, others: np.ndarray, ref: np.ndarray) -> float:
    """Volume dominated by ``p`` and by none of ``others``."""
    whole = float(np.prod(ref - p))
    if not len(others):
        return whole
    limit = np.maximum(others, p)
    limit = limit[(limit < ref).all(1)]
    return max(0.0, whole - (_volume(limit[skyline(limit)], ref) if len(limit) else 0.0))


def eaf3(x: np.ndarray, sets: np.ndarray, levels: list[int], marked: np.ndarray | None = None, below: np.ndarray | None = None) -> list[np.ndarray]:
    """Attainment surfaces of three objectives, one array of points per level, each with the numbers of ``marked`` (default: no) and other sets that attain it.

    For each z in order, the 2-D surface of the points at or below z is swept; a point is kept where
    the surface of the previous z doesn't cover it.  Rows that ``below`` marks are the state to begin with: they stand below all
    others, whatever their z, and make no points.
    """
    n_sets = len(np.unique(sets))
    xs = np.unique(x[:, 0])
    reach = np.full((n_sets, len(xs)), np.inf)  # least y of each set at or left of each x
    number = np.unique(sets, return_inverse=True)[1].reshape(-1)
    own = np.zeros(n_sets, bool)
    if marked is not None:
        own[number] = marked
    surfaces: list[list[np.ndarray]] = [[np.empty((0, 5))] for _ in levels]
    covered = np.full((len(levels), len(xs)), np.inf)

    def enter(rows: np.ndarray) -> None:
        for i in rows:
            j = np.searchsorted(xs, x[i, 0])
            reach[number[i], j:] = np.minimum(reach[number[i], j:], x[i, 1])

    above = np.ones(len(x), bool) if below is None else ~below
    if not above.all():
        enter(np.flatnonzero(~above))
        ordered = np.sort(reach, axis=0)
        covered = np.minimum.accumulate(ordered[[level - 1 for level in levels]], axis=1)
    for z in np.unique(x[above, 2]):
        enter(np.flatnonzero(above & (x[:, 2] == z)))
        ordered = np.sort(reach, axis=0)
        for k, level in enumerate(levels):
            y = ordered[level - 1]
            before = np.concatenate([[np.inf], np.minimum.accumulate(y)[:-1]])
            new = np.flatnonzero((y < before) & (y < covered[k]))
            if len(new):
                hit = reach[:, new] <= y[new]
                surfaces[k].append(np.column_stack([xs[new], y[new], np.full(len(new), z), hit[own].sum(0), hit[~own].sum(0)]))
            covered[k] = np.minimum(covered[k], np.minimum.accumulate(y))
    return [np.concatenate(s) for s in surfaces]


def measure(kind: str, x: np.ndarray, q: np.ndarray, up: list[bool] | None = None) -> np.ndarray:
    """For each row of ``q`` and of ``x`` (costs): the squared distance, the squared excess ("plus"), the largest excess ("additive") or ratio ("ratio") of x over q."""
    out = np.zeros((len(q), len(x))) if kind in ("distance", "plus") else np.full((len(q), len(x)), -np.inf)
    for i in range(x.shape[1]):
        a, b = x[None, :, i], q[:, i, None]
        if kind == "ratio":
            np.maximum(out, b / a if up[i] else a / b, out=out)
        elif kind == "additive":
            np.maximum(out, a - b, out=out)
        else:
            gap = a - b
            out += (np.maximum(gap, 0.0) if kind == "plus" else gap) ** 2
    return out


class Boxes:
    """Rows in leaves with bounding boxes, for the least of a :func:`measure` without looking at every row."""

    def __init__(self, x: np.ndarray, leaf: int = 128) -> None:
        order, self.leaves, stack = np.arange(len(x)), [], [(0, len(x))]
        while stack:
            lo, hi = stack.pop()
            rows = x[order[lo:hi]]
            width = np.ptp(rows, axis=0)
            if hi - lo <= leaf or not width.max() > 0:
                self.leaves.append((lo, hi))
                continue
            mid = (hi - lo) // 2
            order[lo:hi] = order[lo:hi][np.argpartition(rows[:, width.argmax()], mid)]
            stack += [(lo, lo + mid), (lo + mid, hi)]
        self.x = x[order]
        self.low = np.array([self.x[lo:hi].min(0) for lo, hi in self.leaves])
        self.high = np.array([self.x[lo:hi].max(0) for lo, hi in self.leaves])

    def _bounds(self, kind: str, q: np.ndarray, up: list[bool] | None) -> np.ndarray:
        if kind != "distance":  # these rise with every cost
            return measure(kind, self.low, q, up)
        out = np.zeros((len(q), len(self.low)))
        for i in range(q.shape[1]):
            out += np.maximum(np.maximum(self.low[None, :, i] - q[:, i, None], q[:, i, None] - self.high[None, :, i]), 0.0) ** 2
        return out

    def least(self, kind: str, q: np.ndarray, up: list[bool] | None = None) -> np.ndarray:
        """The least measure for each row of ``q``; leaves are taken in the order of their bounds."""
        best = np.full(len(q), np.inf)
        if len(self.leaves) == 1:
            for at in range(0, len(q), 2048):
                best[at : at + 2048] = np.fmin(np.inf, np.fmin.reduce(measure(kind, self.x, q[at : at + 2048], up), axis=1))
            return best
        for at in range(0, len(q), 512):
            part, own = q[at : at + 512], best[at : at + 512]
            bounds = self._bounds(kind, part, up)
            bounds[np.isnan(bounds)] = -np.inf  # differences of infinite values tell nothing
            turn, live = np.argsort(bounds, axis=1, kind="stable"), np.arange(len(part))
            for step in range(len(self.leaves)):
                live = live[bounds[live, turn[live, step]] < own[live]]
                if not len(live):
                    break
                near = turn[live, step]
                for j in np.unique(near):
                    rows = live[near == j]
                    lo, hi = self.leaves[j]
                    own[rows] = np.fmin(own[rows], np.fmin.reduce(measure(kind, self.x[lo:hi], part[rows], up), axis=1))
        return best


def legacy_rng(seed: int) -> np.random.Generator:
    """MT19937 with the classic seeding, for streams that are reproducible across languages."""
    bits = np.random.MT19937()
    bits._legacy_seeding(seed)
    return np.random.Generator(bits)


def sphere_constant(d: int) -> float:
    return 2 * math.pi ** (d / 2) / math.gamma(d / 2) / (d * 2**d)


def rphi_directions(d: int, first: int, count: int) -> np.ndarray:
    """Directions first+1 .. first+count of the additive low-discrepancy sequence, mapped to the sphere's positive part."""
    m = d - 1
    phi = 2.0
    for _ in range(64):  # positive root of x^(m+1) = x + 1
        phi = (1 + phi) ** (1 / (m + 1))
    i = np.arange(first + 1, first + count + 1, dtype=np.float64)
    u = np.stack([np.mod(0.5 + i * math.fmod(phi ** -(j + 1), 1.0), 1.0) for j in range(m)], 1)
    return _to_sphere(u, d)


def _to_sphere(u: np.ndarray, d: int) -> np.ndarray:
    """Uniform values to directions: radii by powers, and two coordinates from the radius between two of them and an angle.

    What is left of the radius once a pair of coordinates is set has, of ``free`` coordinates to come, the law of a uniform
    value's ``free``-th root.  In odd dimension one coordinate is left over, which stands before the last pair.
    """
    free = np.arange(d - 2, -1, -2)
    inner = np.where(free > 0, u[:, free - 1] ** (1 / np.maximum(free, 1)), 0.0)
    left = np.cumprod(np.column_stack([np.ones(len(u)), inner]), axis=1)
    turn = np.pi / 2 * u[:, free]
    ring = left[:, :-1] * np.sqrt(np.maximum(0.0, 1 - inner**2))
    pairs = np.stack([ring * np.sin(turn), ring * np.cos(turn)], axis=2).reshape(len(u), -1)
    return np.insert(pairs, d - 3, left[:, -1], axis=1) if d % 2 else pairs


def _least_prime(at_least: int) -> int:
    p = at_least
    while p < 2 or any(p % q == 0 for q in range(2, math.isqrt(p) + 1)):
        p += 1
    return p


def lattice_directions(d: int, n: int, first: int, count: int) -> np.ndarray:
    """Points of a good lattice in polar angles, the least prime p with (p - 1) / 2 >= d - 1; the last point is 0."""
    m = d - 1
    p = _least_prime(2 * m + 1)
    a = [1.0] + [float(round(n * math.fmod(abs(2 * math.cos(2 * math.pi * k / p)), 1.0))) for k in range(1, m)]
    i = np.arange(first + 1, first + count + 1, dtype=np.float64)
    theta = np.mod(i[:, None] / n * np.array(a)[None], 1.0)
    theta[i == n] = 0.0
    angles = np.stack([_inverse_sine_power(m - 1 - j, theta[:, j]) for j in range(m)], 1)
    w, prod = np.empty((count, d)), np.ones(count)
    for j in range(m):
        w[:, m - j], prod = prod * np.cos(angles[:, j]), prod * np.sin(angles[:, j])
    w[:, 0] = prod
    return w


def _sine_power_integral(m: int, x: np.ndarray) -> np.ndarray:
    s, c = np.sin(x), np.cos(x)
    low = x if m % 2 == 0 else 1 - c
    for k in range(2 if m % 2 == 0 else 3, m + 1, 2):
        low = -(s ** (k - 1)) * c / k + (k - 1) / k * low
    return low


def _inverse_sine_power(m: int, share: np.ndarray) -> np.ndarray:
    """The angle up to which sin^m has this share of its integral over a quarter turn, by bisection."""
    goal = share * _sine_power_integral(m, np.array([math.pi / 2]))[0]
    lo, hi = np.zeros_like(share), np.full_like(share, math.pi / 2)
    for _ in range(54):
        mid = (lo + hi) / 2
        up = _sine_power_integral(m, mid) < goal
        lo, hi = np.where(up, mid, lo), np.where(up, hi, mid)
    return (lo + hi) / 2


def normal_directions(d: int, rng: np.random.Generator, count: int) -> np.ndarray:
    w = np.maximum(np.abs(rng.standard_normal((count, d))), 1e-20)
    return w / np.sqrt((w * w).sum(1, keepdims=True))


def skip_normal(rng: np.random.Generator, rows: int, d: int) -> np.random.Generator:
    """The generator after ``rows`` rows of ``d`` normal values; they are drawn, a bounded block at a time, which costs far less than a direction's use."""
    for at in range(0, rows, 65_536):
        rng.standard_normal((min(65_536, rows - at), d))
    return rng


def mean_power(z: np.ndarray, w: np.ndarray) -> float:
    """Sum over the directions of (max over points of min over objectives of z / w) ^ d; an objective with no share of a direction sets no limit."""
    total = 0.0
    with np.errstate(divide="ignore"):
        for at in range(0, len(w), 4096):
            part = np.maximum(w[at : at + 4096].T, 0.0, order="C")
            best = np.zeros(part.shape[1])
            for p in z:
                reach = p[0] / part[0]
                for v, share in zip(p[1:], part[1:], strict=True):
                    np.minimum(reach, v / share, out=reach)
                np.maximum(best, reach, out=best)
            total += float((best ** z.shape[1]).sum())
    return total
