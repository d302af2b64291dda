"""Top documents of a query from impact lists, by best positions, over the documents of one task.

A term's impact list holds its documents by falling impact.  Sorted accesses read the
lists of a query's terms side by side; each new document is scored at once by direct
accesses to all the lists, and every place where it is found counts as seen.  The best
position of a list ends the run of seen places from its top: a document that has not
been seen lies behind it in every list, so its score is at most the sum of the impacts
just after the best positions.  Reading stops when that sum is strictly below the k-th
score; a document with an equal score could still win by its id.
"""

from __future__ import annotations

import numpy as np

#: Places read from every list at first; twice as many each time.
FIRST_STEP = 16


class ImpactLists:
    """Postings of documents 0, 1, ..., which are numbered in the order in which ties go.

    ``terms`` are numbers 0, 1, ...; a posting is (term, document, impact).
    """

    def __init__(self, terms: np.ndarray, docs: np.ndarray, impacts: np.ndarray, n_terms: int, n_docs: int):
        self.n_docs = max(n_docs, 1)
        # For direct access: postings by term and document, and the place of each in its list.
        order = np.argsort(terms * self.n_docs + docs)
        terms, docs, impacts = terms[order], docs[order], impacts[order]
        self.keys, self.impacts = terms * self.n_docs + docs, impacts
        # For sorted access: the same postings by term and falling impact.
        by_impact = np.lexsort((docs, -impacts, terms))
        self.docs_in_order, self.impacts_in_order = docs[by_impact], impacts[by_impact]
        bounds = np.searchsorted(terms, np.arange(n_terms + 1))
        self.starts, self.sizes = bounds[:-1], np.diff(bounds)
        self.places = np.empty(len(terms), np.int64)
        self.places[by_impact] = np.arange(len(terms))

    def best(self, terms: np.ndarray, factors: np.ndarray, k: int, step: int = FIRST_STEP) -> tuple[list[tuple[int, int]], int]:
        """[(score, document)] of the ``k`` best with a positive score, and the documents scored.

        ``terms`` are distinct; impacts of a term count ``factors`` times, not below 0.
        """
        some = (self.sizes[terms] > 0) & (factors > 0)
        terms, factors = terms[some], factors[some]
        starts, sizes = self.starts[terms], self.sizes[terms]
        # Places of all lists in one row of flags, list after list.
        begins = np.cumsum(sizes) - sizes
        ends = begins + sizes
        unread = np.ones(int(sizes.sum()), bool)
        known = np.zeros(self.n_docs, bool)
        docs, scores = np.zeros(0, np.int64), np.zeros(0, np.int64)
        read = n_scored = 0
        while read < sizes.max(initial=0):
            at = np.arange(read, read + step)
            wide = at < sizes[:, None]
            new = np.unique(self.docs_in_order[(starts[:, None] + at)[wide]])
            new = new[~known[new]]
            read, step = read + step, step * 2
            if len(new):
                known[new] = True
                n_scored += len(new)
                sums = self._scored(new, terms, factors, starts, begins, unread)
                docs, scores = np.r_[docs, new], np.r_[scores, sums]
                first = np.lexsort((docs, -scores))[:k]
                docs, scores = docs[first], scores[first]
            # The first place of each list that has not been seen.
            open_places = np.flatnonzero(unread)
            next_open = np.r_[open_places, len(unread)][np.searchsorted(open_places, begins)]
            left = next_open < ends
            limit = int((self.impacts_in_order[(starts + next_open - begins)[left]] * factors[left]).sum())
            if not left.any() or (len(scores) == k and limit < scores[-1]):
                break
        good = scores > 0
        return list(zip(scores[good].tolist(), docs[good].tolist())), n_scored

    def _scored(self, new, terms, factors, starts, begins, unread) -> np.ndarray:
        """Scores of documents by direct access to all lists, whose places become seen."""
        keys = terms[:, None] * self.n_docs + new
        at = np.searchsorted(self.keys, keys).clip(max=len(self.keys) - 1)
        found = self.keys[at] == keys
        unread[(self.places[at] - starts[:, None] + begins[:, None])[found]] = False
        return (np.where(found, self.impacts[at], 0) * factors[:, None]).sum(axis=0)
