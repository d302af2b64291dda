"""A cover tree for exact search by inner product, over the rows of one task.

Vectors are whole numbers.  Each gets one more coordinate, the root of what its
squared norm lacks to the largest one, so that all have the same norm R and

    q . x = (|q|^2 + R^2 - |q - x|^2) / 2

for a query whose new coordinate is 0.  A ball of the tree with centre c and radius r
holds no point nearer to q than |q - c| - r nor farther than |q - c| + r, which bounds
the inner products inside from both sides.

Centres are taken farthest first.  Those that were farther than 2^-i of the first
radius from all before form level i: they lie that far apart (separation), every row
lies within it of one of them (covering), and a level holds all centres of the levels
above (nesting).  A centre that is new at its level hangs under the nearest centre of
the level before.  Each node keeps the largest distance to a row below it.
"""

from __future__ import annotations

import heapq

import numpy as np

LEAF_ROWS = 64
#: Doubles hold whole numbers exactly below this.
EXACT = 1 << 53


def _exact(width: int, a: int, b: int) -> bool:
    """Whether doubles hold products of vectors with components up to a and b; an error beyond 64 bits."""
    bound = max(width, 1) * a * b
    if bound >= 1 << 63:
        raise ArithmeticError("inner products beyond 64 bits")
    return bound < EXACT


def inner_products(rows: np.ndarray, queries: np.ndarray) -> np.ndarray:
    """Exact products of whole-number rows with queries, as 64-bit integers."""
    if _exact(rows.shape[1], _largest(rows), _largest(queries)):
        return (rows.astype(np.float64) @ queries.T.astype(np.float64)).astype(np.int64)
    return rows @ queries.T


def _largest(rows: np.ndarray) -> int:
    return int(np.abs(rows).max(initial=0))


class CoverTree:
    """Rows (n x width, 64-bit integers) under their balls; leaves are runs of ``order``, which
    gives the number of the row at each place."""

    def __init__(self, rows: np.ndarray, leaf_rows: int = LEAF_ROWS):
        n = len(rows)
        self.whole, self.largest = rows, _largest(rows)
        exact = rows.astype(np.float64)
        squares = (exact * exact).sum(axis=1)
        self.square = float(squares.max(initial=0.0))
        points = np.c_[exact, np.sqrt(np.maximum(self.square - squares, 0.0))]
        centres, found_at, leaf = _farthest_first(points, max(1, -(-n // leaf_rows)))
        self._grow(points, centres, found_at, leaf)

    def _grow(self, points: np.ndarray, centres: np.ndarray, found_at: np.ndarray, leaf: np.ndarray) -> None:
        """Levels from the centres, nodes with their radii, and the rows in order of their leaves."""
        spread = np.sqrt(((points - points[centres[0]]) ** 2).sum(axis=1)).max()
        with np.errstate(divide="ignore"):
            level = np.floor(np.log2(spread / found_at[1:])).astype(np.int64) + 1 if spread > 0 else np.zeros(0, np.int64)
        level = np.r_[0, np.maximum(level, 1)] if len(centres) > 1 else np.zeros(1, np.int64)
        # Centres come farthest first, so those of the levels up to i are the first ones.
        used = np.unique(level)
        above = np.zeros(len(points), np.int64)  # the ancestor (a centre's number) of each row
        node_centre, node_radius, children = [], [], []
        before: dict[int, int] = {}
        of_row = leaf  # centre of each row at the deepest level
        ancestors = [of_row]
        counts = np.searchsorted(level, used, side="right")
        for count in counts[::-1][1:]:
            # New centres of the level below hang under the nearest centre above.
            near = np.arange(len(centres))
            below = ancestors[-1]
            fresh = np.unique(below[below >= count])
            if len(fresh):
                gaps = _distances(points[centres[fresh]], points[centres[:count]])
                near[fresh] = gaps.argmin(axis=1)
            ancestors.append(near[below])
        for above in ancestors[::-1]:
            gap = np.sqrt(((points - points[centres[above]]) ** 2).sum(axis=1))
            radius = np.zeros(len(centres))
            np.maximum.at(radius, above, gap)
            present = np.unique(above)
            first = np.zeros(len(centres), np.int64)
            first[above[::-1]] = np.arange(len(above))[::-1]
            start = len(node_centre)
            for number in present.tolist():
                node_centre.append(number)
                node_radius.append(radius[number])
                children.append([])
            if before:
                for place, number in enumerate(present.tolist()):
                    children[before[int(parents[first[number]])]].append(start + place)
            before = {number: start + place for place, number in enumerate(present.tolist())}
            parents = above
        self.leaves_from = len(node_centre) - len(before)
        self.children = children
        self.centre = np.array(node_centre, np.int64)
        self.radius = np.array(node_radius)
        self.centres = self.whole[centres]
        self.order = np.argsort(leaf, kind="stable")
        sizes = np.bincount(leaf, minlength=len(centres))[self.centre[self.leaves_from :]]
        self.ends = np.cumsum(sizes)
        self.starts = self.ends - sizes
        self.whole = self.whole[self.order]
        self.doubles = self.whole.astype(np.float64)

    def bounds(self, queries: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Least and largest inner product that any row below a node can have, per query and node."""
        products = inner_products(queries, self.centres)[:, self.centre].astype(np.float64)
        exact = queries.astype(np.float64)
        total = (exact * exact).sum(axis=1)[:, None] + self.square
        gap = np.sqrt(np.maximum(total - 2.0 * products, 0.0))
        slack = 1.0 + total * 1e-9  # rounding of doubles
        least = (total - (gap + self.radius) ** 2) / 2.0 - slack
        most = (total - np.maximum(gap - self.radius, 0.0) ** 2) / 2.0 + slack
        return least, most


def _distances(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    square = (a * a).sum(axis=1)[:, None] + (b * b).sum(axis=1) - 2.0 * (a @ b.T)
    return np.sqrt(np.maximum(square, 0.0))


def _farthest_first(points: np.ndarray, most: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Rows taken as centres, how far each was from those before, and each row's nearest centre.

    Ends when every row lies on a centre.
    """
    centres, found_at = [0], [np.inf]
    gap = ((points - points[0]) ** 2).sum(axis=1)
    leaf = np.zeros(len(points), np.int64)
    while len(centres) < most:
        new = int(gap.argmax())
        if gap[new] <= 0.0:
            break
        found_at.append(float(np.sqrt(gap[new])))
        mine = ((points - points[new]) ** 2).sum(axis=1)
        nearer = mine < gap
        leaf[nearer] = len(centres)
        gap[nearer] = mine[nearer]
        centres.append(new)
    return np.array(centres), np.array(found_at), leaf


class Best:
    """The best (score, earliest row) of one window of scores, at most ``most``."""

    def __init__(self, low: int | None, high: int | None, most: int):
        self.low, self.high, self.most = (-np.inf if low is None else low), (np.inf if high is None else high), most
        self.heap: list[tuple[int, int]] = []  # the worst first: score, minus the row's number
        #: No score below this is of use.
        self.floor = self.low

    def add(self, score: int, row: int) -> None:
        item = (score, -row)
        if len(self.heap) < self.most:
            heapq.heappush(self.heap, item)
        elif item > self.heap[0]:
            heapq.heapreplace(self.heap, item)
        if len(self.heap) == self.most:
            self.floor = max(self.low, self.heap[0][0])

    def found(self) -> list[tuple[int, int]]:
        """(score, row), best first."""
        return [(score, -row) for score, row in sorted(self.heap, reverse=True)]


def best_first(
    tree: CoverTree, query: np.ndarray, least: np.ndarray, most: np.ndarray, usable: np.ndarray, windows: list[Best]
) -> int:
    """Fill the windows with the query's best ``usable`` rows; the number of rows looked at.

    ``usable`` is in the tree's order of rows.  Nodes come in the order of their upper
    bounds.  One is left out if for every window it lies outside, or cannot reach what
    the window already has.  An equal score can still win by its row's number, so only
    smaller bounds are left out.
    """
    if not windows or not len(tree.order):
        return 0
    exact = _exact(len(query), tree.largest, _largest(query))
    whole, query = (tree.doubles, query.astype(np.float64)) if exact else (tree.whole, query)
    least, most = least.tolist(), most.tolist()
    queue, looked = [(-most[0], 0)], 0
    while queue:
        bound, node = heapq.heappop(queue)
        if -bound < min([w.floor for w in windows]):
            break  # so are all that follow
        if not _reaches(windows, -bound, least[node]):
            continue
        if node >= tree.leaves_from:
            leaf = node - tree.leaves_from
            part = slice(tree.starts[leaf], tree.ends[leaf])
            scores = whole[part] @ query
            looked += len(scores)
            some = np.flatnonzero(usable[part] & (scores >= min([w.floor for w in windows])))
            for score, row in zip(scores[some].tolist(), tree.order[part][some].tolist()):
                for window in windows:
                    if window.floor <= score <= window.high:
                        window.add(int(score), row)
            continue
        for child in tree.children[node]:
            if _reaches(windows, most[child], least[child]):
                heapq.heappush(queue, (-most[child], child))
    return looked


def _reaches(windows: list[Best], upper: float, lower: float) -> bool:
    for window in windows:
        if upper >= window.floor and lower <= window.high:
            return True
    return False
