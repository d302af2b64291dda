"""Suffix order and common prefixes of a long byte string by external induced sorting.

Only order and common prefixes up to ``depth`` bytes are needed here, so recursion
ends at that depth.  The string lies in a file, and so does whatever grows with it:

* the S* suffixes (smaller than their successor, after a larger one) are sorted by
  recursive distribution: what fits in memory is sorted there, what does not is
  dealt into files by its next two bytes, each of which is sorted in turn;
* they induce the order of the L suffixes, and these the order of the S suffixes.
  The priority queue of the induction orders tuples by first byte and by the rank
  of the suffix that induced them.  Ranks only rise in a pass, so the tuples of one
  byte are queued in the order of their arrival, in a file of their own;
* a tuple carries its position and the common prefix with the tuple before it in
  its queue: one more than the least common prefix between the two that induced
  them.

Tuples are taken from a queue and put into the next ones in batches.
"""

from __future__ import annotations

import tempfile
from collections.abc import Iterator

import numpy as np

#: Tuples handled at once, and bytes that all queues of a task hold before they write them down.
BATCH = 1 << 17
HELD = 96 << 20
#: S* suffixes sorted in memory at once.
IN_MEMORY = 1 << 21

#: A tuple is one number: the position times 64, plus the common prefix.
TUPLE = np.dtype("<i8")


def places(tuples: np.ndarray) -> np.ndarray:
    return tuples >> 6


def prefixes(tuples: np.ndarray) -> np.ndarray:
    return tuples & 63


def tuples_of(at: np.ndarray, lcp: np.ndarray) -> np.ndarray:
    return (at << 6) | lcp


class Held:
    """Bytes in memory of all queues that share it."""

    def __init__(self):
        self.bytes = 0


class Queue:
    """A first-in first-out queue of tuples.

    Once the queues of a task hold more than ``HELD`` bytes, the one that is added to
    writes its own to a file.  The file has no name and goes with the queue, or with
    a task that fails.
    """

    def __init__(self, held: Held, dtype: np.dtype = TUPLE):
        self.dtype, self.file, self.parts, self.of_all = dtype, None, [], held
        self.size = self.written = self.taken = self.held = 0

    def put(self, items: np.ndarray) -> None:
        self.parts.append(items)
        self.size += len(items)
        self.held += items.nbytes
        self.of_all.bytes += items.nbytes
        if self.of_all.bytes > HELD and self.held > HELD >> 10:
            if self.file is None:
                self.file = tempfile.TemporaryFile(buffering=0)
            self.file.seek(self.written * self.dtype.itemsize)
            data = memoryview(np.concatenate(self.parts)).cast("B")
            while len(data):
                data = data[self.file.write(data) :]
            self.written = self.size
            self._release()

    def _release(self) -> None:
        self.of_all.bytes -= self.held
        self.parts, self.held = [], 0

    def __len__(self) -> int:
        return self.size - self.taken

    def _read(self, start: int, stop: int) -> np.ndarray:
        """Items start to stop, counted from the first ever put."""
        found = []
        if start < self.written:
            end = min(stop, self.written)
            self.file.seek(start * self.dtype.itemsize)
            size = (end - start) * self.dtype.itemsize
            data = bytearray()
            while len(data) < size:
                data += self.file.read(size - len(data))
            found.append(np.frombuffer(data, self.dtype))
        if stop > self.written:
            if len(self.parts) > 1:
                self.parts = [np.concatenate(self.parts)]
            found.append(self.parts[0][max(0, start - self.written) : stop - self.written])
        return np.concatenate(found) if len(found) != 1 else found[0]

    def take(self, most: int = BATCH) -> np.ndarray:
        """The next items, at most so many."""
        if not len(self):
            return np.zeros(0, self.dtype)
        found = self._read(self.taken, min(self.taken + most, self.size))
        self.taken += len(found)
        return found

    def batches(self) -> Iterator[np.ndarray]:
        """All items from the first on, without taking them."""
        end = self.taken + len(self)
        for start in range(self.taken, end, BATCH):
            yield self._read(start, min(end, start + BATCH))

    def backwards(self) -> Iterator[np.ndarray]:
        """All items from the last on."""
        stop = self.taken + len(self)
        while stop > self.taken:
            start = max(self.taken, stop - BATCH)
            yield self._read(start, stop)[::-1]
            stop = start

    def clear(self) -> None:
        if self.file is not None:
            self.file.close()
        self._release()
        self.__init__(self.of_all, self.dtype)


class Text:
    """A byte string in a file, with two zero bytes' worth of end beyond it.

    Bytes count from 1; 0 stands for the end and for the gaps between strings.
    """

    def __init__(self, depth: int):
        self.depth, self.size, self.held = depth, 0, Held()
        self.file = tempfile.TemporaryFile()

    def append(self, data: np.ndarray) -> None:
        """Add a string of 16-bit symbols below 257, 0 at its end."""
        self.file.write(np.ascontiguousarray(data, "<u2").data.cast("B"))
        self.size += len(data)

    def close(self) -> None:
        """No more strings; pad the end so that every prefix can be read."""
        self.file.write(bytes(2 * (self.depth + 16)))
        self.file.flush()
        self.symbols = np.asarray(np.memmap(self.file, "<u2", "r"))

    def pair(self, at: np.ndarray) -> np.ndarray:
        """Two symbols at each position as one number."""
        return self.symbols[at].astype(np.int64) * 257 + self.symbols[at + 1]

    def word(self, at: np.ndarray) -> np.ndarray:
        """Six symbols at each position as one number, ordered like them."""
        word = self.symbols[at].astype(np.int64)
        for i in range(1, 6):
            word = word * 257 + self.symbols[at + i]
        return word

    def common(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Common prefix of the suffixes at a and b, at most ``depth``."""
        length = np.zeros(len(a), np.int64)
        going = np.arange(len(a))
        for depth in range(0, self.depth, 6):  # six symbols at a time, then one by one
            same = self.word(a[going] + depth) == self.word(b[going] + depth)
            length[going[same]] += 6
            going = going[same]
            if not len(going):
                break
        for _ in range(5):
            length += (length < self.depth) & (self.symbols[a + length] == self.symbols[b + length])
        return np.minimum(length, self.depth)


def _sorted_in_memory(text: Text, at: np.ndarray, depth: int) -> np.ndarray:
    """Positions in the order of their suffixes, which agree up to ``depth``."""
    at = at.copy()
    group = np.zeros(len(at), np.int64)
    tied = np.arange(len(at))
    while len(tied) and depth < text.depth:
        word = text.word(at[tied] + depth)
        order = np.lexsort((word, group[tied]))
        at[tied], word, groups = at[tied][order], word[order], group[tied]
        new = np.r_[True, (word[1:] != word[:-1]) | (groups[1:] != groups[:-1])]
        group[tied] = tied[np.flatnonzero(new)[np.cumsum(new) - 1]]
        alone = new & np.r_[new[1:], True]
        tied = tied[~alone]
        depth += 6
    return at


def sorted_stars(text: Text, stars: Queue, depth: int = 0) -> Iterator[np.ndarray]:
    """The S* positions of a queue in the order of their suffixes, up to the text's depth."""
    if len(stars) <= IN_MEMORY or depth >= text.depth:
        if depth >= text.depth:  # equal as far as it matters
            yield from stars.batches()
        elif len(stars):
            yield _sorted_in_memory(text, stars.take(len(stars)), depth)
        return
    dealt: dict[int, Queue] = {}
    while len(batch := stars.take()):
        pair = text.pair(batch + depth)
        order = np.argsort(pair, kind="stable")
        batch, pair = batch[order], pair[order]
        starts = np.flatnonzero(np.r_[True, pair[1:] != pair[:-1]])
        for start, stop in zip(starts, np.r_[starts[1:], len(batch)]):
            dealt.setdefault(int(pair[start]), Queue(stars.of_all)).put(batch[start:stop])
    for pair in sorted(dealt):
        yield from sorted_stars(text, dealt[pair], depth + 2)
        dealt.pop(pair).clear()


def find_stars(text: Text) -> Queue:
    """The S* positions, found from the end on."""
    stars = Queue(text.held)
    n = text.size
    after_is_s, after = False, 0  # type and symbol of what follows the part: the end, which is smaller
    found = []
    for stop in range(n, 0, -(BATCH * 4)):
        start = max(0, stop - BATCH * 4)
        part = text.symbols[start:stop].astype(np.int64)
        follow = np.r_[part[1:], after]
        sign = np.sign(follow - part)
        # An equal neighbour takes the type of the next one that differs.
        known = np.where(sign != 0, np.arange(len(part)), len(part))
        known = np.minimum.accumulate(known[::-1])[::-1]
        is_s = np.where(known < len(part), np.r_[sign, 0][known] > 0, after_is_s)
        next_is_s = np.r_[is_s[1:], after_is_s]
        # Position i + 1 is S* if it is S and i is L.
        found.append(start + 1 + np.flatnonzero(~is_s & next_is_s))
        after_is_s, after = bool(is_s[0]), int(part[0])
        if sum(map(len, found)) > IN_MEMORY:
            stars.put(np.concatenate(found))
            found = []
    if found:
        stars.put(np.concatenate(found))
    return stars


def _range_minima(values: np.ndarray, first: np.ndarray, last: np.ndarray) -> np.ndarray:
    """Least of values[first..last], ends included, for first <= last (a sparse table)."""
    table, step = [values], 1
    longest = int((last - first).max(initial=0)) + 1
    while 2 * step <= longest:
        row = table[-1]
        table.append(np.minimum(row[:-step], row[step:]))
        step *= 2
    level = np.frexp((last - first + 1).astype(float))[1] - 1
    result = np.empty(len(first), values.dtype)
    for k in range(len(table)):
        some = level == k
        result[some] = np.minimum(table[k][first[some]], table[k][last[some] - (1 << k) + 1])
    return result


class _Pass:
    """One pass of the induction: queues by symbol, and what lies between two arrivals."""

    def __init__(self, text: Text):
        self.text = text
        self.queues = [Queue(text.held) for _ in range(258)]
        #: Least common prefix since the last arrival at each queue.
        self.least = np.zeros(258, np.int64)

    def induce(self, items: np.ndarray, symbol: int, wanted) -> None:
        """Queue the predecessors that are ``wanted`` (of their symbol) of a batch in order."""
        at, lcp = places(items), prefixes(items).astype(np.uint8)
        before = np.where(at > 0, self.text.symbols[at - 1], 0).astype(np.int64)
        chosen = np.flatnonzero((at > 0) & wanted(before, symbol))
        if not len(chosen):
            self.least = np.minimum(self.least, int(lcp.min()))
            return
        order = chosen[np.argsort(before[chosen].astype(np.uint16), kind="stable")]
        to = before[order]
        starts = np.flatnonzero(np.r_[True, to[1:] != to[:-1]][: len(to)])
        # From the arrival before, in this batch or an earlier one, to this one.
        first = np.r_[0, order[:-1] + 1]
        first[starts] = 0
        common = _range_minima(lcp, first, order).astype(np.int64)
        common[starts] = np.minimum(common[starts], self.least[to[starts]])
        self.least = np.minimum(self.least, int(lcp.min()))
        stops = np.r_[starts[1:], len(to)]
        queued = tuples_of(at[order] - 1, np.minimum(common + 1, self.text.depth))
        # What lies after the last arrival at each queue counts for its next one.
        after = np.r_[np.minimum.accumulate(lcp[::-1])[::-1], self.text.depth]
        self.least[to[starts]] = after[order[stops - 1] + 1]
        for symbol, start, stop in zip(to[starts].tolist(), starts.tolist(), stops.tolist()):
            self.queues[symbol].put(queued[start:stop])


def sorted_suffixes(text: Text) -> Iterator[np.ndarray]:
    """All suffixes from the largest on, as batches of tuples.

    Each has the common prefix with the tuple before, that is, the next larger
    suffix, at most ``text.depth``.
    """
    depth = text.depth
    lower = _Pass(text)
    larger = [Queue(text.held) for _ in range(258)]  # the L suffixes of each symbol, in order
    # The end of the text is the smallest suffix and induces the last one.
    stars = _by_symbol(text, sorted_stars(text, find_stars(text)))
    lower.induce(np.array([text.size << 6]), 0, lambda before, symbol: before >= symbol)
    star = next(stars, None)
    for symbol in range(257):
        fresh, last = True, -1
        queue = lower.queues[symbol]
        while len(items := queue.take()):
            if fresh:
                items = np.r_[items[:1] & ~63, items[1:]]
                fresh = False
            last = int(items[-1]) >> 6
            larger[symbol].put(items)
            lower.induce(items, symbol, lambda before, symbol: before >= symbol)
        queue.clear()
        while star is not None and star[0] == symbol:
            lcp = text.common(np.r_[max(last, 0), star[1][:-1]], star[1])
            if last < 0:
                lcp[0] = 0
            items = tuples_of(star[1], lcp)
            last = int(star[1][-1])
            lower.induce(items, symbol, lambda before, symbol: before > symbol)
            star = next(stars, None)
    upper = _Pass(text)
    for symbol in range(256, -1, -1):
        queue, last, fresh = upper.queues[symbol], -1, True
        while len(items := queue.take()):
            if fresh:
                items = np.r_[items[:1] & ~63, items[1:]]
                fresh = False
            last = int(items[-1]) >> 6
            upper.induce(items, symbol, lambda before, symbol: before <= symbol)
            yield items
        queue.clear()
        carried = -1  # common prefix of the item that comes next with the one just seen
        for items in larger[symbol].backwards():
            # Prefixes with the smaller neighbour become prefixes with the larger one.
            at, own = places(items), prefixes(items)
            if carried < 0:  # the seam to the S suffixes of the symbol, if it has any
                carried = int(text.common(np.array([last]), at[:1])[0]) if last >= 0 else 0
            items = tuples_of(at, np.r_[carried, own[:-1]])
            carried = int(own[-1])
            upper.induce(items, symbol, lambda before, symbol: before < symbol)
            yield items
        larger[symbol].clear()


def _by_symbol(text: Text, stars: Iterator[np.ndarray]) -> Iterator[tuple[int, np.ndarray]]:
    """Sorted S* positions in batches of one first symbol each."""
    for part in stars:
        for start in range(0, len(part), BATCH):
            batch = part[start : start + BATCH]
            first = text.symbols[batch]
            cuts = np.flatnonzero(np.r_[True, first[1:] != first[:-1]])
            for a, b in zip(cuts, np.r_[cuts[1:], len(batch)]):
                yield int(first[a]), batch[a:b]
