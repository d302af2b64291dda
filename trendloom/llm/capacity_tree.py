"""Open bins by free capacity, in a segment tree over the capacities."""

from __future__ import annotations


class CapacityTree:
    """Finds the fullest open bin that still takes an item, in steps of the tree's height.

    A leaf stands for one free capacity, 0 to ``most``, and holds the bins that
    have it; an inner node counts the bins below.
    """

    def __init__(self, most: int):
        self.leaves = 1 << most.bit_length()
        self.counts = [0] * (2 * self.leaves)
        self.bins: list[list[int]] = [[] for _ in range(most + 1)]

    def put(self, free: int, bin_number: int) -> None:
        self.bins[free].append(bin_number)
        self._count(free, 1)

    def take(self, size: int) -> tuple[int, int] | None:
        """Remove and return the bin (free capacity, number) that an item of ``size`` fits best."""
        node = self.leaves + size
        while not self.counts[node]:
            # Up until a right neighbour of the path has bins.
            while node > 1 and (node & 1 or not self.counts[node + 1]):
                node >>= 1
            if node <= 1:
                return None
            node += 1
            while node < self.leaves:  # down to its smallest capacity
                node = 2 * node + (not self.counts[2 * node])
        free = node - self.leaves
        self._count(free, -1)
        return free, self.bins[free].pop()

    def _count(self, free: int, change: int) -> None:
        node = self.leaves + free
        while node:
            self.counts[node] += change
            node >>= 1
