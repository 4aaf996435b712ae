"""An adaptive quadtree over line segments: a bounded set of boxes, small where segments are dense.

The tree only says which boxes a segment crosses and which boxes a point must
look into; segments and points themselves stay in Spark.
"""

from __future__ import annotations

import heapq

import numpy as np

# Segments per leaf aimed at, and bounds of the tree.
CAPACITY, MAX_LEAVES, MAX_DEPTH = 24, 16_384, 24
# Relative widening of every test, far above rounding and far below any distance that matters.
SLACK = 1e-9


def crossing(ends: np.ndarray, box: np.ndarray) -> np.ndarray:
    """Whether segments (rows of ax, ay, bx, by) meet boxes (rows of x0, y0, x1, y1), row by row or one box for all."""
    ax, ay, bx, by = ends.T
    x0, y0, x1, y1 = box.T
    slack = SLACK * (1 + np.abs(x0) + np.abs(x1) + np.abs(y0) + np.abs(y1))
    near = (np.minimum(ax, bx) <= x1 + slack) & (np.maximum(ax, bx) >= x0 - slack)
    near &= (np.minimum(ay, by) <= y1 + slack) & (np.maximum(ay, by) >= y0 - slack)
    # The box lies on one side of the segment's line if its centre is farther off than its corners reach.
    nx, ny = ay - by, bx - ax
    off = np.abs(nx * ((x0 + x1) / 2 - ax) + ny * ((y0 + y1) / 2 - ay))
    return near & (off <= np.abs(nx) * ((x1 - x0) / 2 + slack) + np.abs(ny) * ((y1 - y0) / 2 + slack))


class QuadTree:
    """Boxes, the first of each node's four children (-1 for a leaf), and which nodes hold segments."""

    def __init__(self, extent: tuple[float, float, float, float]):
        self.box = np.array([extent], float)
        self.child = np.array([-1])
        self.filled = np.ones(1, bool)

    @classmethod
    def grown(cls, extent: tuple[float, float, float, float], sample: np.ndarray, weight: float = 1.0) -> QuadTree:
        """Split the leaf that most sampled segments cross, until none has too many or there are enough leaves.

        Each sampled segment stands for ``weight`` segments.
        """
        boxes, children = [np.array(extent, float)], [-1]
        heap = [(-len(sample), 0, 0, np.arange(len(sample)))]
        leaves = 1
        while heap and leaves + 3 <= MAX_LEAVES:
            count, node, depth, members = heapq.heappop(heap)
            if -count * weight <= CAPACITY:
                break
            x0, y0, x1, y1 = boxes[node]
            mx, my = (x0 + x1) / 2, (y0 + y1) / 2
            children[node] = len(boxes)
            leaves += 3
            for quarter in ((x0, y0, mx, my), (mx, y0, x1, my), (x0, my, mx, y1), (mx, my, x1, y1)):
                box = np.array(quarter)
                inside = members[crossing(sample[members], box)]
                if depth + 1 < MAX_DEPTH:
                    heapq.heappush(heap, (-len(inside), len(boxes), depth + 1, inside))
                boxes.append(box)
                children.append(-1)
        tree = cls(extent)
        tree.box, tree.child, tree.filled = np.array(boxes), np.array(children), np.ones(len(boxes), bool)
        return tree

    def fill(self, leaves: np.ndarray) -> None:
        """Only these leaves, and the nodes above them, hold segments."""
        self.filled[:] = False
        self.filled[leaves] = True
        for node in np.flatnonzero(self.child >= 0)[::-1]:
            first = self.child[node]
            self.filled[node] = self.filled[first : first + 4].any()

    def _descend(self, n: int, keep) -> tuple[np.ndarray, np.ndarray]:
        """(row, leaf) reached when ``keep(rows, nodes)`` tells, level by level, where to go on."""
        rows, nodes = np.arange(n), np.zeros(n, np.int64)
        found_rows, found_leaves = [], []
        while len(rows):
            stay = keep(rows, nodes)
            rows, nodes = rows[stay], nodes[stay]
            first = self.child[nodes]
            leaf = first < 0
            found_rows.append(rows[leaf])
            found_leaves.append(nodes[leaf])
            rows = np.repeat(rows[~leaf], 4)
            nodes = (first[~leaf][:, None] + np.arange(4)).ravel()
        return np.concatenate([np.zeros(0, np.int64), *found_rows]), np.concatenate([np.zeros(0, np.int64), *found_leaves])

    def crossed(self, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(segment, leaf) of all leaves that each segment crosses."""
        return self._descend(len(ends), lambda rows, nodes: crossing(ends[rows], self.box[nodes]))

    def _distances(self, points: np.ndarray, nodes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Squared distances from points to the nearest and the farthest place of boxes."""
        low, high = self.box[nodes, :2], self.box[nodes, 2:]
        least = np.maximum(np.maximum(low - points, points - high), 0)
        most = np.maximum(np.abs(points - low), np.abs(points - high))
        return (least**2).sum(axis=1), (most**2).sum(axis=1)

    def home(self, points: np.ndarray) -> np.ndarray:
        """For each point the leaf with segments whose farthest place is nearest: one of them is no farther than that."""
        bound = np.full(len(points), np.inf)

        def keep(rows: np.ndarray, nodes: np.ndarray) -> np.ndarray:
            least, most = self._distances(points[rows], nodes)
            held = self.filled[nodes]
            np.minimum.at(bound, rows[held], most[held])
            return held & (least <= bound[rows])

        rows, leaves = self._descend(len(points), keep)
        most = self._distances(points[rows], leaves)[1]
        order = np.lexsort((leaves, most, rows))
        first = np.flatnonzero(np.concatenate([np.ones(1, bool), rows[order][1:] != rows[order][:-1]])) if len(rows) else order
        home = np.full(len(points), -1)
        home[rows[order][first]] = leaves[order][first]
        return home

    def within(self, points: np.ndarray, radius2: np.ndarray, home: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(point, leaf) of each point's home, and of all leaves with segments that are no farther than its squared radius."""
        reach = radius2 * (1 + SLACK) + SLACK

        def keep(rows: np.ndarray, nodes: np.ndarray) -> np.ndarray:
            return self.filled[nodes] & (self._distances(points[rows], nodes)[0] <= reach[rows])

        rows, leaves = self._descend(len(points), keep)
        # The segment found at home may have its nearest place elsewhere, and the home leaf then lie beyond it.
        other = leaves != home[rows]
        return np.concatenate([np.arange(len(points)), rows[other]]), np.concatenate([home, leaves[other]])
