"""A weighted edit distance with swaps between sequences, nearest neighbours under it, and their votes."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from seqloom.functions.elements import GAP_INSERT, GAP_SUBSTITUTE, SIZE_INSERT, SIZE_SUBSTITUTE_DIVIDER, SWAP
from seqloom.operators.order import group_numbers, running_sums
from seqloom.session import materialize

#: What a pair of sequences of very different lengths gets instead of a distance; it stays a candidate.
FAR = (1 << 63) - 1
QUALITIES = ["NoResult", "Wrong", "Contains", "PluralityThenMinDist", "Plurality", "Majority", "Exact"]
#: Rows of a label in one block, queries and rows of a block at most, rows of one in which the nearest are looked for, and queries of one wanted at least.
LABEL_BLOCK, QUERY_BLOCK, BLOCK, NEAR_BLOCK, LEAST_QUERIES = 16_384, 4096, 65_536, 131_072, 16
_BATCH_CELLS = 4_000_000
#: Distances at once, sequences side by side at most, and wanted at least, first steps that are kept, and bytes of what is kept for elements.
_MATRIX_CELLS, _LANES, _WIDE, _SHARED, _KEPT_BYTES = 4_000_000, 4096, 1024, 8, 96_000_000
#: Sequences of a tree at its greatest depth at least, its elements and its elements with those that fill up at most, the depths where equal beginnings part, and lanes from which on depths are computed one by one.
_LEAST_LANES, _TREE_CELLS, _PADDED_CELLS, _CUTS, _FEW = 48, 2_500_000, 16_000_000, (5, 9), 6000
#: Sizes and gaps that a bound counts one by one, and how many sequences are compared first.
_BOUND_SIZES, _BOUND_GAPS, _FIRST = 12, 24, 256
_LEAST, _ROW_CELLS = 128, 60_000
#: Sizes or gaps of a sequence at most, and sequences at once, that are compared in their order without the others.
_PLACES, _PLACE_LANES = 96, 4096
#: Bytes of back-pointers at once.
_TRACE_CELLS = 32_000_000
CHANGES = ["insert_gap", "insert_size", "delete_gap", "delete_size", "substitute_gap_gap", "substitute_gap_size", "substitute_size_gap", "substitute_size_size", "swap_gap_gap", "swap_gap_size", "swap_size_gap", "swap_size_size"]


def _costs(x: np.ndarray) -> np.ndarray:
    """Insertion costs of signed codes: a size n is n, a gap g is -(g + 1)."""
    return np.where(x >= 0, SIZE_INSERT, (-x - 1) * GAP_INSERT)


def batch_distance(a: np.ndarray, la: np.ndarray, b: np.ndarray, lb: np.ndarray) -> np.ndarray:
    """Distances of many pairs at once: rows of a and b are padded sequences of signed codes of the lengths la and lb.

    The table of the alignment is filled row by row for all pairs together; the result of a pair is read where its own lengths end.
    """
    n, rows, cols = len(a), a.shape[1], b.shape[1]
    ca, cb = _costs(a), _costs(b)
    prior = np.concatenate([np.zeros((n, 1), np.int64), np.cumsum(cb, axis=1)], axis=1)
    older = np.zeros_like(prior)
    at = np.arange(n)
    out = np.where(la == 0, prior[at, lb], 0)
    both = (SIZE_INSERT + SIZE_INSERT) // SIZE_SUBSTITUTE_DIVIDER
    cum = np.concatenate([np.zeros((n, 1), np.int64), np.cumsum(cb, axis=1)], axis=1)
    for i in range(rows):
        x, cx = a[:, i : i + 1], ca[:, i : i + 1]
        change = np.where((x >= 0) & (b >= 0), both, np.where((x < 0) & (b < 0), GAP_SUBSTITUTE * np.abs(x - b), cx + cb))
        step = np.minimum(prior[:, 1:] + cx, prior[:, :-1] + np.where(x == b, 0, change))
        if i:
            swapped = (a[:, i - 1 : i] == b[:, 1:]) & (x == b[:, :-1])
            step[:, 1:] = np.where(swapped, np.minimum(step[:, 1:], older[:, :-2] + np.where(x == b[:, 1:], 0, SWAP)), step[:, 1:])
        # deletions run along the row: a running minimum of what is left after taking off the costs up to there
        row = np.concatenate([prior[:, :1] + cx, step], axis=1) - cum
        row = np.minimum.accumulate(row, axis=1) + cum
        older, prior = prior, row
        done = la == i + 1
        out[done] = row[at[done], lb[done]]
    return out


def _pad(lists: Sequence[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    sizes = np.array([len(x) for x in lists], np.int64)
    out = np.zeros((len(lists), int(sizes.max(initial=0))), np.int64)
    out[np.arange(out.shape[1]) < sizes[:, None]] = np.concatenate([*lists, np.empty(0, np.int64)])
    return out, sizes


def distances(a: Sequence[np.ndarray], b: Sequence[np.ndarray], *, prefilter: bool = False) -> np.ndarray:
    """Distances of pairs given as lists of signed codes; equal pairs are 0, and with prefilter those of very different lengths FAR."""
    out = np.zeros(len(a), np.int64)
    la, lb = (np.array([len(x) for x in s], np.int64) for s in (a, b))
    apart = np.abs(la - lb)
    far = (apart > 40) & (apart > np.maximum(la, lb) // 5) if prefilter else np.zeros(len(a), bool)
    out[far] = FAR
    # the distance is symmetric: the longer one of a pair gives the steps, the shorter one the width of the table
    swap = la < lb
    a, b = ([y if w else x for x, y, w in zip(p, q, swap)] for p, q in ((a, b), (b, a)))
    la, lb = np.maximum(la, lb), np.minimum(la, lb)
    order = np.lexsort((lb, la))  # pairs of like lengths together, so that little is padding
    order = order[~far[order]]
    start = 0
    while start < len(order):
        widest = np.maximum.accumulate(lb[order[start:]]) + 1
        fits = (np.arange(1, len(widest) + 1) * widest <= _BATCH_CELLS) & (la[order[start:]] <= 1.3 * la[order[start]] + 8)
        stop = start + max(1, int(np.argmin(fits)) if not fits.all() else len(fits))
        part = order[start:stop]
        out[part] = batch_distance(*_pad([a[i] for i in part]), *_pad([b[i] for i in part]))
        start = stop
    return out


class _Lanes:
    """Distinct sequences of like lengths side by side, to be compared with one sequence after the other.

    Against deleting one sequence and inserting the other an alignment saves something for each pair of elements that it lines up, and for each swap; the distance is both
    costs less the most that can be saved. So a step of the table takes only additions of what is kept for each element, and maxima, of all pairs at once; savings are at most twice the
    lesser cost, for nearly all pairs 16-bit numbers. What the first steps gave is kept: sequences that come in their order start where they differ from the one before.

    Element j of sequence r lies at [j % run, j // run, r]: a running maximum along the sequences is one within all runs at once, and one over the ends of the runs.
    """

    def __init__(self, lists: list[np.ndarray]) -> None:
        b, self.sizes = _pad(lists)
        self.run = max(2, round(b.shape[1] ** 0.5))
        self.shape = self.run, max(1, -(-b.shape[1] // self.run)), len(lists)
        real = np.arange(b.shape[1]) < self.sizes[:, None]
        self.cost = np.where(real, _costs(b), 0).sum(axis=1)
        self.most = int(self.cost.max(initial=0))
        self.codes, numbers = np.unique(b[real], return_inverse=True)
        self.numbers = {x: i for i, x in enumerate(self.codes.tolist())}
        place = np.full((len(lists), self.shape[0] * self.shape[1]), len(self.codes), np.int32)
        place[:, : b.shape[1]][real] = numbers
        self.place = np.ascontiguousarray(place.reshape(len(lists), self.shape[1], self.run).transpose(2, 1, 0))
        self._start(_SHARED)

    def _start(self, shared: int) -> None:
        self.shared, self.small = shared, self.place.astype(np.min_scalar_type(len(self.codes)))
        self.rows: dict[type, tuple] = {}
        self.last: dict[type, list[int]] = {}
        self.kept: dict[tuple, np.ndarray | None] = {}
        self.kept_bytes = 0

    def _keep(self, key: tuple, table: np.ndarray | None) -> np.ndarray | None:
        size = 0 if table is None else table.nbytes
        if self.kept_bytes + size > _KEPT_BYTES:
            self.kept, self.kept_bytes = {}, 0
        self.kept[key], self.kept_bytes = table, self.kept_bytes + size
        return table

    def _pair(self, x: int | None, kind: type) -> np.ndarray:
        """What lining up x with each element saves; None: a size that occurs nowhere."""
        x = x if x is None or x in self.numbers or x < 0 else None  # sizes that occur nowhere save as much as each other
        key = (kind, x)
        if key in self.kept:
            return self.kept[key]
        if x is not None and x < 0:
            saved = np.where(self.codes < 0, np.maximum(GAP_INSERT * (-x - 1 - self.codes - 1) - GAP_SUBSTITUTE * np.abs(x - self.codes), 0), 0)
            return self._keep(key, np.append(saved, 0).astype(kind).take(self.place, mode="clip"))
        both = (SIZE_INSERT + SIZE_INSERT) // SIZE_SUBSTITUTE_DIVIDER
        if x is None:
            is_size = (self.small >= np.searchsorted(self.codes, 0)) & (self.small < len(self.codes))
            return self._keep(key, np.multiply(is_size, kind(2 * SIZE_INSERT - both), dtype=kind))
        out = np.multiply(self._stands(x), kind(both), dtype=kind)
        out += self._pair(None, kind)
        return self._keep(key, out)

    def _stands(self, x: int) -> np.ndarray:
        """Where x stands."""
        key = ("at", x)
        return self.kept[key] if key in self.kept else self._keep(key, self.small == self.numbers[x])

    def _swap(self, y: int, x: int, kind: type) -> np.ndarray | None:
        """What swapping y, x saves where x, y stands, at the place of that y, or None if that is nowhere."""
        key = (kind, y, x)
        if key in self.kept:
            return self.kept[key]
        saved, out = 2 * int(_costs(np.array([x, y])).sum()) - SWAP, None
        if x in self.numbers and y in self.numbers and saved > 0:
            before, at = self._stands(x), self._stands(y).copy()
            at[1:] &= before[:-1]
            at[0, 1:] &= before[-1, :-1]
            at[0, 0] = False
            out = np.multiply(at, kind(saved), dtype=kind) if at.any() else None
        return self._keep(key, out)

    def _views(self, row: np.ndarray) -> tuple:
        """A table's row with its parts that a step takes: making them anew for each step would take about as long as the step."""
        ends = row[-1]
        scans = [(r, before) for s in (row, ends) for r, before in zip(s[1:], s[:-1])]
        return row, row[:-1], row[-1, :-1], row[:-2], row[-2:, :-1], row[2:], row[:2, 1:], row[:2, 0], scans, row[:-1, 1:], ends[:-1]

    def distances(self, a: np.ndarray) -> np.ndarray:
        cost, codes = int(_costs(a).sum()), a.tolist()
        kind = next(t for t in (np.int16, np.int32, np.int64) if 2 * min(cost, self.most) <= np.iinfo(t).max)
        if kind not in self.rows:
            t = np.empty(self.shape, kind)
            self.rows[kind] = [self._views(np.zeros(self.shape, kind)) for _ in range(self.shared + 4)], (t, t[1:], t[0, 1:], t[0, 0])
        rows, (t, t_rest, t_first, t_corner) = self.rows[kind]
        last = self.last.get(kind, [])
        start = 0
        while start < min(self.shared, len(last), len(codes)) and last[start] == codes[start]:
            start += 1
        at = lambda i: rows[i if i <= self.shared else self.shared + 1 + i % 3]
        add, most = np.add, np.maximum
        older, prior = at(max(start - 1, 0)), at(start)
        for i in range(start, len(codes)):
            x, new = codes[i], at(i + 1)
            pair, (row, _, _, _, _, rest, first, corner, scans, inner, ends) = self._pair(x, kind), new
            add(prior[1], pair[1:], t_rest)
            add(prior[2], pair[0, 1:], t_first)
            t_corner[:] = pair[0, 0]
            if i and codes[i - 1] != x and (swap := self._swap(codes[i - 1], x, kind)) is not None:
                add(older[3], swap[2:], rest)
                add(older[4], swap[:2, 1:], first)
                corner[:] = swap[:2, 0]
                most(t, row, t)
            most(t, prior[0], row)
            for r, before in scans:
                most(r, before, r)
            most(inner, ends, inner)
            older, prior = prior, new
        self.last[kind] = codes
        return self.cost + cost - prior[0][-1, -1]


class _Tree:
    """Distinct sequences of codes whose equal beginnings are computed once, to be compared with one sequence after the other.

    The table is that of _Lanes, but lies by depth: what belongs to the elements at one depth is one run of memory with no places for sequences that have ended, so that a step takes an addition and two
    maxima at each depth, of what the caches still hold. Where few sequences are left, some depths at once are one part, with places for all of its sequences. Up to the depths _CUTS equal
    beginnings are one; there each lane goes on from its beginning's. Swaps are rare among all places, and are added where they stand.
    """

    def __init__(self, lists: list[np.ndarray]) -> None:
        b, sizes = _pad(lists)
        real = np.arange(b.shape[1]) < sizes[:, None]
        self.cost = np.where(real, _costs(b), 0).sum(axis=1)
        self.most = int(self.cost.max(initial=0))
        self.codes, numbers = np.unique(b[real], return_inverse=True)
        self.numbers = {x: i for i, x in enumerate(self.codes.tolist())}
        place = np.zeros(b.shape, ">u2" if len(self.codes) < 1 << 16 else ">u4")
        place[real] = numbers + 1
        turn = np.array(sorted(range(len(lists)), key=[x.tobytes() for x in place].__getitem__), np.int64)
        place, sizes = place[turn], sizes[turn]
        # how many elements at the beginning are those of the sequence before
        same = np.append(0, np.argmax(place[1:] != place[:-1], axis=1))
        deepest = int(sizes.max())
        cuts = [0, *(c for c in _CUTS if c < deepest), deepest]
        self.parts: list[tuple] = []
        self.ends, flat, parents = np.zeros(len(turn), np.int64), [np.zeros(1, np.int64)], [np.zeros(1, np.int64)]
        at, above, group = 1, 0, np.zeros(len(turn), np.int64)
        for first, last in zip(cuts, cuts[1:]):
            new = (sizes > first) & (same < last)
            rank, lane = np.cumsum(new) - 1, np.flatnonzero(new)
            reach = np.minimum(sizes[lane], last)
            longest = np.argsort(-reach, kind="stable")
            lane, reach = lane[longest], reach[longest]
            before = group[lane]
            group = np.argsort(longest)[np.maximum(rank, 0)]
            depth = first
            while depth < last:
                n = int(np.searchsorted(-reach, -depth))
                wide = 1 if n > _FEW else max(1, min(16, int(reach[n * 3 // 5]) - depth))
                cut = before[:n] if first and depth == first else None
                lead = cut is not None or wide > 1
                if lead:
                    flat.append(np.zeros(n, np.int64))
                    parents.append(np.zeros(n, np.int64))
                self.parts.append((at, n, wide, lead, cut))
                at += n * lead
                for d in range(depth, depth + wide):
                    flat.append(place[lane[:n], d].astype(np.int64))
                    parents.append(above + (before[:n] if d == first else np.arange(n)))
                    done = sizes == d + 1
                    self.ends[turn[done]] = at + group[done]
                    above, at = at, at + n
                depth += wide
        place, parents = np.concatenate(flat) - 1, np.concatenate(parents)
        # places by their element and the one before it, to find swaps, with the place before both; at the first elements there are none
        pair = np.where((parents > 0) & (place >= 0), place[parents] * len(self.codes) + place, -1)
        self.by_pair = np.argsort(pair, kind="stable")
        pairs, starts = np.unique(pair[self.by_pair], return_index=True)
        self.pairs = {x: slice(i, j) for x, i, j in zip(pairs.tolist(), starts.tolist(), [*starts[1:].tolist(), len(pair)])}
        self.by_pair_before = parents[parents[self.by_pair]]
        self.place = np.where(place < 0, len(self.codes), place).astype(np.intp)
        self.rows: dict[type, tuple] = {}
        self.last: dict[type, list[int]] = {}
        self.kept: dict[tuple, list[np.ndarray]] = {}

    def _parts(self, row: np.ndarray) -> list[np.ndarray]:
        return [row[at + n * lead : at + n * (lead + wide)] for at, n, wide, lead, _ in self.parts]

    def _views(self, kind: type) -> tuple:
        """A row of the table: all of it, its parts, what is to the left of each part, and how each is scanned: from where what is to its left comes, and its depths."""
        row = np.zeros(len(self.place), kind)
        parts, left, scans, end = self._parts(row), [], [], None
        for (at, n, wide, lead, cut), part in zip(self.parts, parts):
            left.append(row[at : at + n * wide] if lead else np.zeros(n, kind) if end is None else end[:n])
            depths = [left[-1][:n], *(part[i : i + n] for i in range(0, len(part), n))]
            scans.append(((end if cut is not None else end[:n], cut, depths[0]) if lead and end is not None else None, list(zip(depths[1:], depths))))
            end = depths[-1]
        return row, parts, left, scans

    def _pair(self, x: int, kind: type) -> list[np.ndarray]:
        """What lining up x with each element saves."""
        key = kind, x if x in self.numbers or x < 0 else None  # sizes that occur nowhere save as much as each other
        if key not in self.kept:
            if x < 0:
                saved = np.where(self.codes < 0, np.maximum(GAP_INSERT * (-x - 1 - self.codes - 1) - GAP_SUBSTITUTE * np.abs(x - self.codes), 0), 0)
            else:
                saved = np.where(self.codes < 0, 0, 2 * SIZE_INSERT - np.where(self.codes == x, 0, (SIZE_INSERT + SIZE_INSERT) // SIZE_SUBSTITUTE_DIVIDER))
            row = np.append(saved, 0).astype(kind).take(self.place, mode="clip")
            if (len(self.kept) + 1) * row.nbytes > _KEPT_BYTES:
                self.kept = {}
            self.kept[key] = self._parts(row)
        return self.kept[key]

    def _swap(self, y: int, x: int) -> tuple[slice | None, int]:
        """Where x, y stands, in order of such pairs, and what swapping y, x saves there."""
        saved = 2 * int(_costs(np.array([x, y])).sum()) - SWAP
        if x == y or saved <= 0 or x not in self.numbers or y not in self.numbers:
            return None, 0
        return self.pairs.get(self.numbers[x] * len(self.codes) + self.numbers[y]), saved

    def distances(self, a: np.ndarray) -> np.ndarray:
        cost, codes = int(_costs(a).sum()), a.tolist()
        kind = next(t for t in (np.int16, np.int32, np.int64) if 2 * min(cost, self.most) <= np.iinfo(t).max)
        if kind not in self.rows:
            t = np.empty(max(n * wide for _, n, wide, _, _ in self.parts), kind)
            self.rows[kind] = [self._views(kind) for _ in range(_SHARED + 4)], [t[: n * wide] for _, n, wide, _, _ in self.parts]
        rows, t = self.rows[kind]
        last, start = self.last.get(kind, []), 0
        while start < min(_SHARED, len(last), len(codes)) and last[start] == codes[start]:
            start += 1
        at = lambda i: rows[i if i <= _SHARED else _SHARED + 1 + i % 3]
        add, most = np.add, np.maximum
        for i in range(start, len(codes)):
            (_, before, left, _), (row, new, _, scans) = at(i), at(i + 1)
            where, saved = self._swap(codes[i - 1], codes[i]) if i else (None, 0)
            steps = zip(t, left, self._pair(codes[i], kind), before, new, scans)
            if where is not None:
                for u, x, p, y, part, _ in steps:
                    add(x, p, u)
                    most(u, y, part)
                places, swapped = self.by_pair[where], at(i - 1)[0].take(self.by_pair_before[where], mode="clip")
                swapped += kind(saved)
                row[places] = most(swapped, row.take(places, mode="clip"), swapped)
                steps = ((None,) * 5 + (s,) for s in scans)
            for u, x, p, y, part, (lead, depths) in steps:
                if u is not None:
                    add(x, p, u)
                    most(u, y, part)
                if lead:
                    end, cut, begin = lead
                    if cut is None:
                        begin[:] = end
                    else:
                        end.take(cut, out=begin, mode="clip")
                for r, prior in depths:
                    most(r, prior, r)
        self.last[kind] = codes
        return self.cost + cost - at(len(codes))[0].take(self.ends)


class _Near:
    """Some sequences of a corpus, of like lengths, side by side, to be compared with one sequence. The table is that of _Lanes in 16 bits, by place, then sequence.

    Elements are what they are in `corpus.small`: gaps themselves, sizes below 0. What is behind the end of a sequence is a gap of 0, which costs nothing and saves nothing.
    """

    #: What a sequence may cost for all sums to have 16 bits.
    MOST = 8000

    def __init__(self, place: np.ndarray, cost: np.ndarray, numbers: dict[int, int]) -> None:
        self.place, self.cost, self.numbers = place, cost, numbers
        gaps = np.maximum(place, 0)
        self.four, self.two = gaps << 2, gaps << 1
        self.is_size = place >> 15  # all bits, or none
        self.stands: dict[int, np.ndarray] = {}
        self.pairs: dict[int, np.ndarray] = {}
        self.rows = []
        for _ in range(3):
            row = np.zeros((len(place) + 1, place.shape[1]), np.int16)
            self.rows.append((row, row[:-1], row[1:], row[:-2], row[2:], list(zip(row[1:], row))))
        self.t = np.empty(place.shape, np.int16)

    def _stands(self, x: int) -> np.ndarray:
        """All bits where x stands."""
        if x not in self.stands:
            self.stands[x] = np.negative(np.equal(self.place, np.int16(x)), dtype=np.int16)
        return self.stands[x]

    def _pair(self, x: int) -> np.ndarray:
        """What lining up x with each element saves."""
        if x not in self.pairs:
            if x < 0:
                both = (SIZE_INSERT + SIZE_INSERT) // SIZE_SUBSTITUTE_DIVIDER
                out = self.is_size & np.int16(2 * SIZE_INSERT - both)
                out += np.bitwise_and(self._stands(x), np.int16(both), out=self.t)
            else:  # both gaps less thrice what lies between them
                out = self.four - np.int16(2 * x)
                np.minimum(out, np.subtract(np.int16(4 * x), self.two, out=self.t), out=out)
                np.maximum(out, 0, out=out)
            self.pairs[x] = out
        return self.pairs[x]

    def distances(self, a: np.ndarray) -> np.ndarray:
        costs = _costs(a).tolist()
        # sizes that occur nowhere save as much as each other; a swap with a gap of 1 or 0 costs no less than to take it out and put it back
        codes = [self.numbers.get(x, -1 - len(self.numbers)) if x >= 0 else -x - 1 for x in a.tolist()]
        add, most, both, t, t_swap = np.add, np.maximum, np.bitwise_and, self.t, self.t[1:]
        older, prior, new = self.rows
        for i, x in enumerate(codes):
            add(prior[1], self._pair(x), t)
            most(t, prior[2], new[2])
            if i and codes[i - 1] != x and min(costs[i - 1], costs[i]) > 1:
                both(self._stands(x)[:-1], self._stands(codes[i - 1])[1:], t_swap)
                both(t_swap, np.int16(2 * (costs[i - 1] + costs[i]) - SWAP), t_swap)
                add(t_swap, older[3], t_swap)
                most(new[4], t_swap, new[4])
            for r, before in new[5]:
                most(r, before, r)
            older, prior, new = prior, new, older
        return sum(costs) + self.cost - prior[0][-1]


class _Picked(_Lanes):
    """Some sequences of a corpus side by side, to be compared with one sequence."""

    def __init__(self, corpus: Corpus, some: np.ndarray) -> None:
        self.sizes, self.codes, self.numbers = corpus.sizes[some], corpus.codes, corpus.numbers
        longest = int(self.sizes.max(initial=0))
        self.run = max(2, round(longest**0.5))
        self.shape = self.run, max(1, -(-longest // self.run)), len(some)
        costs = corpus.costs[some]
        self.cost, self.most = costs, int(costs.max(initial=0))
        j = (np.arange(self.shape[1]) * self.run + np.arange(self.run)[:, None])[:, :, None]
        self.place = corpus.flat.take(corpus.starts[some] + j, mode="clip")
        np.copyto(self.place, len(self.codes), where=j >= self.sizes)
        self._start(0)


def _distinct(lists: Sequence[np.ndarray]) -> tuple[list[np.ndarray], np.ndarray]:
    """The distinct ones of sequences of int64 codes, and the number of each one's."""
    numbers: dict[bytes, int] = {}
    which = np.array([numbers.setdefault(x.tobytes(), len(numbers)) for x in lists], np.int64)
    return [np.frombuffer(x, np.int64) for x in numbers], which


def _numbered(values: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The distinct values in order, the number of each value's, and how often each occurs."""
    least = int(values.min(initial=0))
    if int(values.max(initial=0)) - least >= 1 << 22:
        return np.unique(values, return_inverse=True, return_counts=True)
    often = np.bincount(values - least)  # values lie close together, so that nothing has to be sorted
    codes = np.flatnonzero(often)
    numbers = np.zeros(len(often), np.int32)
    numbers[codes] = np.arange(len(codes))
    return codes + least, numbers[values - least], often[codes]


def cross_distances(a: Sequence[np.ndarray], b: Sequence[np.ndarray], *, prefilter: bool = False) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Distances of each sequence of a to all of b, as numbers of some of a and one row for each of them; with prefilter FAR for those of very different lengths. Both are signed codes in int64."""
    (a, of_a), (b, of_b) = _distinct(a), _distinct(b)
    sizes = np.array([len(x) for x in b], np.int64)
    order, parts, start = np.argsort(sizes, kind="stable"), [], 0
    # most lie in trees; those of depths that few others reach lie side by side
    many = int(np.searchsorted(sizes[order], sizes[order[-_LEAST_LANES]], "right")) if len(b) >= _LEAST_LANES else 0
    while start < many:
        like = sizes[order[start:many]]
        fits = (np.cumsum(like) <= _TREE_CELLS) & (np.arange(1, len(like) + 1) * like <= _PADDED_CELLS)
        stop = start + max(1, int(np.argmin(fits)) if not fits.all() else len(fits))
        tree = stop - start >= _LEAST_LANES and like[stop - start - 1]
        parts.append(((_Tree if tree else _Lanes)([b[i] for i in order[start:stop]]), order[start:stop]))
        start = stop
    while start < len(order):
        like, most = np.searchsorted(sizes[order], (1.15 * sizes[order[start]] + 2, 2 * sizes[order[start]] + 2), "right").tolist()
        stop = min(max(like, start + _WIDE), most, len(order))  # a few of not so like lengths are better than few columns
        parts += [(_Lanes([b[i] for i in part]), part) for part in np.array_split(order[start:stop], -(-(stop - start) // _LANES))]
        start = stop
    turn = sorted(range(len(a)), key=lambda i: a[i].tolist())
    members = np.argsort(of_a, kind="stable")
    ends = np.cumsum(np.bincount(of_a, minlength=len(a)))
    step = max(1, _MATRIX_CELLS // max(1, len(b)))
    for first in range(0, len(turn), step):
        some = turn[first : first + step]
        out = np.full((len(some), len(b)), FAR, np.int64)
        for lanes, part in parts:
            for row, i in enumerate(some):
                if not prefilter:
                    out[row, part] = lanes.distances(a[i])
                    continue
                apart, longest = np.abs(sizes[part] - len(a[i])), np.maximum(sizes[part], len(a[i]))
                far = (apart > 40) & (apart > longest // 5)
                if not far.all():
                    out[row, part] = np.where(far, FAR, lanes.distances(a[i]))
        for row, i in enumerate(some):
            yield members[(ends[i - 1] if i else 0) : ends[i]], out[row][of_b]


class Corpus:
    """Sequences of signed codes in int64 among which the nearest ones of others are looked for; equal ones are compared once.

    A distance is at least what it costs to make the elements of one those of the other, whatever their order. For sizes that is a substitution for each that both have too few of, and an
    insertion for each more; gaps differ by the least of what lies between them, or half a substitution for each that the other hasn't. Both are sums of differences of counts
    (`bounds`), which tell most pairs apart without their tables. Counts of several values together, for rare ones, only make the bound less.

    Of what is left, the sizes alone and the gaps alone are compared, each in their order: an alignment aligns both, and each of its steps costs no less than what it does to the sizes and to the gaps.
    """

    def __init__(self, lists: Sequence[np.ndarray]) -> None:
        distinct, of = _distinct(lists)
        self.sizes = np.array([len(x) for x in distinct], np.int64)
        values = np.concatenate([*distinct, np.empty(0, np.int64)])
        # in order of how many sizes they have, as rows near to another one have about as many
        many = np.bincount(np.repeat(np.arange(len(distinct)), self.sizes), values >= 0, len(distinct)).astype(np.int64)
        turn = np.argsort(many, kind="stable")
        self.many, self.sizes, self.of = many[turn], self.sizes[turn], np.argsort(turn)[of]
        values = np.concatenate([*(distinct[i] for i in turn), np.empty(0, np.int64)])
        del distinct
        self.members = np.argsort(self.of, kind="stable")
        self.ends = np.cumsum(np.bincount(self.of, minlength=len(self.sizes)))
        self.starts = np.cumsum(self.sizes) - self.sizes
        self.codes, numbers, often = _numbered(values)
        self.numbers = {x: i for i, x in enumerate(self.codes.tolist())}
        self.flat = np.append(numbers, len(self.codes)).astype(np.intp)
        n = len(self.sizes)
        owner = np.repeat(np.arange(n, dtype=np.int32), self.sizes)
        self.costs = np.bincount(owner, _costs(values), n).astype(np.int64)
        # the same for _Near
        given = self.codes[self.codes >= 0]
        self.few = len(given) < 1 << 15  # sizes have numbers of 16 bits
        self.size_numbers = {x: -1 - i for i, x in enumerate(given.tolist())}
        self.small = np.append(np.where(self.codes >= 0, np.searchsorted(given, self.codes) * -1 - 1, np.minimum(-self.codes - 1, _Near.MOST))[numbers], 0).astype(np.int16)
        # the sizes alone and the gaps alone, by place
        self.many_gaps = np.bincount(owner[values < -1], minlength=n)
        self.by_place, self.gaps_by_place = (self._by_place(x, m, owner) for x, m in ((values >= 0, self.many), (values < -1, self.many_gaps)))
        often = np.where(self.codes >= 0, often, -1)
        self.common = np.sort(self.codes[np.argsort(-often, kind="stable")[: min(_BOUND_SIZES, int((self.codes >= 0).sum()))]])
        self.counts = self._counts(values, owner, n)

    def _by_place(self, which: np.ndarray, many: np.ndarray, owner: np.ndarray) -> np.ndarray:
        out = np.zeros((min(_PLACES, int(many.max(initial=0))), len(many)), np.int16)
        place = np.cumsum(which) - 1 - np.repeat(np.cumsum(many) - many, self.sizes)
        which = which & (place < len(out))
        out[place[which], owner[which]] = self.small[:-1][which]
        return out

    def _counts(self, values: np.ndarray, owner: np.ndarray, n: int) -> np.ndarray:
        """Weighted counts, a row each, of n sequences: sizes, gaps by all values up to each, and gaps one by one, these twice."""
        common, gaps = len(self.common), _BOUND_GAPS
        kinds, size, gap = np.zeros((common + 2 * gaps + 4, n), np.int32), values >= 0, -values - 1
        count = lambda kind, owner, kinds: np.bincount(kind * n + owner, minlength=kinds * n).reshape(kinds, n)
        at = np.searchsorted(self.common, values)
        at = np.where(np.append(self.common, -1)[at] == values, at, common)
        kinds[: common + 1] = 3 * count(at[size], owner[size], common + 1)
        kinds[common + 1] = 3 * kinds[: common + 1].sum(axis=0)
        given = ~size & (gap > 0)
        gap, owner, first = gap[given], owner[given], common + 2 + gaps
        by_gap = count(np.minimum(gap, gaps + 1), owner, gaps + 2).astype(np.int32)
        kinds[common + 2 : first] = by_gap[::-1].cumsum(axis=0)[::-1][1 : gaps + 1]
        kinds[first] = np.minimum(np.bincount(owner, np.maximum(gap - gaps, 0), n), 1 << 24)
        kinds[first + 1 : first + 1 + gaps] = 3 * by_gap[2:]
        kinds[-1] = 2 * by_gap[1]
        return np.minimum(kinds, 1 << 24, out=kinds)  # the sum of all differences has 32 bits

    def bounds(self, a: np.ndarray) -> np.ndarray:
        """What the distances of a from the distinct sequences are at least."""
        sizes, gaps = self._bounds(a, slice(None))
        return sizes + gaps

    def _bounds(self, a: np.ndarray, part: slice) -> tuple[np.ndarray, np.ndarray]:
        """What the sizes and what the gaps of a cost at least to be those of some of the distinct sequences, in their order."""
        own = self._counts(a, np.zeros(len(a), np.int64), 1)[:, 0].tolist()
        counts = self.counts[:, part]
        sums, t = np.zeros((3, counts.shape[1]), np.int32), np.empty(counts.shape[1], np.int32)
        ends = len(self.common) + 2, len(self.common) + 3 + _BOUND_GAPS
        for i, (row, x) in enumerate(zip(counts, own)):
            np.abs(np.subtract(row, x, out=t), out=t)
            sums[(i >= ends[0]) + (i >= ends[1])] += t
        return sums[0], np.maximum(sums[1], (sums[2] + 1) // 2)

    def size_distances(self, a: np.ndarray, some: np.ndarray, most: np.ndarray) -> np.ndarray:
        """The distances of the sizes of a from those of some distinct sequences, without the gaps between them, where they aren't above `most`; else what they are at least, or more than `most`.
        some: in order; its sequences have at most _PLACES sizes.

        An alignment that has taken o more elements from one side than from the other has inserted as many, and inserts what is then too few: only places with so few more or less that this isn't
        above `most` have a table. It lies by o, less the costs of o insertions.
        """
        codes = [self.size_numbers.get(x, -1 - len(self.size_numbers)) for x in a.tolist() if x >= 0]
        out, start, half = np.empty(len(some), np.int64), 0, (SIZE_INSERT + SIZE_INSERT) // SIZE_SUBSTITUTE_DIVIDER
        while start < len(some):
            part = some[start : start + _PLACE_LANES]
            more = self.many[part] - len(codes)
            fit = np.minimum(most[start : start + _PLACE_LANES] // SIZE_INSERT, self.many[part] + len(codes))
            least, greatest = min(0, -int(((fit - more) // 2).max()), int(more.min())), max(0, int(((fit + more) // 2).max()), int(more.max()))
            wide = greatest - least + 1
            place = np.zeros((len(codes) + wide, len(part)), np.int16)
            for i in range(max(0, -least), min(len(place), len(self.by_place) - least)):
                self.by_place[i + least].take(part, out=place[i], mode="clip")
            others = {x: np.negative(np.not_equal(place, np.int16(x)), dtype=np.int16) for x in set(codes)}
            change = {x: at & np.int16(half) for x, at in others.items()}
            # far above all that counts, and with what is added to it still in 16 bits
            older, prior, new = (np.full((wide, len(part)), 8000, np.int16) for _ in range(3))
            prior[-least:] = 0
            t = np.empty_like(prior)
            for i, x in enumerate(codes):
                np.add(prior, change[x][i : i + wide], out=new)
                np.add(prior[1:], np.int16(2 * SIZE_INSERT), out=t[1:])
                np.minimum(new[:-1], t[1:], out=new[:-1])
                if i and codes[i - 1] != x:
                    np.bitwise_or(others[codes[i - 1]][i : i + wide], others[x][i - 1 : i - 1 + wide], out=t)
                    np.bitwise_and(t, np.int16(8000), out=t)
                    np.add(t, older, out=t)
                    np.add(t, np.int16(SWAP), out=t)
                    np.minimum(new, t, out=new)
                for r, before in zip(new[1:], new):
                    np.minimum(r, before, out=r)
                older, prior, new = prior, new, older
            out[start : start + _PLACE_LANES] = prior[more - least, np.arange(len(part))] + SIZE_INSERT * more
            start += _PLACE_LANES
        return out

    def gap_distances(self, a: np.ndarray, some: np.ndarray) -> np.ndarray:
        """The distances of the gaps of a from those of some distinct sequences, without the sizes between them; these have at most _PLACES gaps, and no sequence costs more than _Near.MOST."""
        out, order = np.empty(len(some), np.int64), np.argsort(self.many_gaps[some], kind="stable")
        for start in range(0, len(some), _PLACE_LANES):
            at = order[start : start + _PLACE_LANES]
            part = some[at]
            place = np.stack([row.take(part) for row in self.gaps_by_place[: int(self.many_gaps[part].max())]] or [np.zeros(len(part), np.int16)])
            out[at] = _Near(place, self.costs[part] - SIZE_INSERT * self.many[part], {}).distances(a[a < -1])
        return out

    def distances(self, a: np.ndarray, some: np.ndarray) -> np.ndarray:
        """The distances of a from some of the distinct sequences."""
        out = np.empty(len(some), np.int64)
        order = np.argsort(self.sizes[some], kind="stable")
        sizes, start = self.sizes[some][order], 0
        fits = self.few and int(_costs(a).sum()) <= _Near.MOST
        while start < len(order):
            like, most = np.searchsorted(sizes, (1.25 * sizes[start] + 4, 2 * sizes[start] + 8), "right").tolist()
            stop = min(max(like, start + _WIDE), most, start + max(_LEAST, _ROW_CELLS // (int(sizes[start]) + 1)), len(order))
            part = some[order[start:stop]]
            # with few long ones the steps along the sequences would take too long one by one
            near = fits and 2 * len(part) >= sizes[stop - 1] and int(self.costs[part].max()) <= _Near.MOST
            out[order[start:stop]] = (self._near(part) if near else _Picked(self, part)).distances(a)
            start = stop
        return out

    def _near(self, some: np.ndarray) -> _Near:
        j = np.arange(max(1, int(self.sizes[some].max(initial=0))))[:, None]
        place = self.small.take(self.starts[some] + j, mode="clip")
        np.copyto(place, 0, where=j >= self.sizes[some])
        return _Near(place, self.costs[some], self.size_numbers)

    def nearest(self, a: np.ndarray, k: int, fit: np.ndarray | None = None, threshold: float | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Distinct sequences, as numbers, with their distances from a: all that are as near as the k-th nearest of those that fit, or nearer, and perhaps others; and which are too far
        from it in length to have one. threshold: those with a greater norm don't count, and may be left out."""
        apart, longest = np.abs(self.sizes - len(a)), np.maximum(self.sizes, len(a))
        far = (apart > 40) & (apart > longest // 5)
        open_ = ~far if fit is None else fit & ~far
        which, found, counted, most = np.empty(0, np.int64), np.empty(0, np.int64), np.empty(0, np.int64), None
        own, done, fits = np.count_nonzero(a >= 0), None, self.few and int(_costs(a).sum()) <= _Near.MOST
        # first those that have about as many sizes, then those with as many more or less as what was found allows
        for wide in (max(3, own // 6), None):
            if wide is None:
                wide = len(self.sizes) + len(self.flat) if most is None else most // SIZE_INSERT
            if threshold is not None:  # those that aren't too far in length are at most so long
                wide = int(min(wide, max(0, (threshold * max(len(a) + 40, len(a) * 5 // 4 + 1) + 1) // SIZE_INSERT)))
            begin, end = np.searchsorted(self.many, (own - wide, own + wide + 1)).tolist()
            parts = [slice(begin, end)] if done is None else [slice(begin, done[0]), slice(done[1], end)]
            parts = [x for x in parts if x.start < x.stop]
            done = begin, end
            if not parts:
                continue
            left = np.concatenate([np.arange(x.start, x.stop) for x in parts])
            low, gaps = (np.concatenate(x) for x in zip(*(self._bounds(a, x) for x in parts)))
            low += gaps
            # a distance above this doesn't count
            limit = np.full(len(left), FAR if most is None else most)
            if threshold is not None:
                limit = np.minimum(limit, (threshold * np.maximum(longest[left], 1) + 1).astype(np.int64))
            first, closer = max(_FIRST, 2 * k), not fits
            good = open_[left] & (low <= limit)
            while True:
                left, low, gaps, limit = left[good], low[good], gaps[good], limit[good]
                if not closer and (most is not None or threshold is not None) and len(left) > first:
                    closer = True
                    for bound in self._by_sizes, self._by_gaps:
                        low = bound(a, left, low, gaps, limit)
                        good = low <= limit
                        left, low, gaps, limit = left[good], low[good], gaps[good], limit[good]
                if not len(left):
                    break
                # the nearest by their bounds first: what they are at most leaves out most others
                some = np.argpartition(low, first)[:first] if first < len(left) else np.arange(len(left))
                d = self.distances(a, left[some])
                which, found = np.append(which, left[some]), np.append(found, d)
                counted = np.append(counted, d if threshold is None else d[d / np.maximum(longest[left[some]], 1) <= threshold])
                good = np.ones(len(left), bool)
                good[some] = False
                if len(counted) >= k:
                    most = int(np.partition(counted, k - 1)[k - 1])
                    good &= low <= most
                    np.minimum(limit, most, out=limit)
                first *= 8 if len(which) > first else 1
        return which, found, far

    def _by_sizes(self, a: np.ndarray, some: np.ndarray, low: np.ndarray, gaps: np.ndarray, most: np.ndarray) -> np.ndarray:
        """The bounds `low` of some distinct sequences, of which `gaps` is the gaps' part, with the distances of the sizes alone."""
        if np.count_nonzero(a >= 0) <= _PLACES:
            at = np.flatnonzero(self.many[some] <= _PLACES)
            low[at] = np.maximum(low[at], gaps[at] + self.size_distances(a, some[at], (most - gaps)[at]))
        return low

    def _by_gaps(self, a: np.ndarray, some: np.ndarray, low: np.ndarray, gaps: np.ndarray, most: np.ndarray) -> np.ndarray:
        """The bounds `low` with the distances of the gaps alone in place of `gaps`."""
        at = np.flatnonzero((self.many_gaps[some] <= _PLACES) & (self.costs[some] <= _Near.MOST))
        low[at] += np.maximum(self.gap_distances(a, some[at]) - gaps[at], 0).astype(low.dtype)
        return low

    def rows(self, which: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """All rows of some distinct sequences, and for each row at what place of `which` its sequence is."""
        n = np.diff(self.ends, prepend=0)[which]
        place = np.repeat(np.arange(len(which)), n)
        return self.members[np.arange(len(place)) - np.repeat(np.cumsum(n) - n, n) + np.repeat(self.ends[which] - n, n)], place


def signed(elements: Column) -> Column:
    """Elements as signed codes, the form of the distance kernels."""
    return F.transform(elements, lambda e: F.when(e["kind"] == 0, e["val"]).otherwise(-e["val"] - 1))


def seq_distance(a: Column, b: Column, *, prefilter: bool = False) -> Column:
    """The distance of two columns of elements; null if either is null."""

    def run(x: pa.Array, y: pa.Array) -> pa.Array:
        out = [None] * len(x)
        given = [i for i in range(len(x)) if x[i].is_valid and y[i].is_valid]
        found = distances(*([np.array(s[i].as_py(), np.int64) for i in given] for s in (x, y)), prefilter=prefilter)
        for i, d in zip(given, found.tolist()):
            out[i] = d
        return pa.array(out, pa.int64())

    run.__annotations__ = {"x": pa.Array, "y": pa.Array, "return": pa.Array}
    return F.arrow_udf(run, "bigint")(signed(a), signed(b))


def _coded(queries: DataFrame, rows: DataFrame) -> tuple[DataFrame, DataFrame]:
    """id, c, f of the queries and id, label, c, f of the rows that have elements: their signed codes and folds."""
    codes = signed(F.col("elems")).cast("array<int>")
    fold = lambda d: F.col("fold") if "fold" in d.columns else F.lit(None).cast("bigint")
    q = queries.where("elems IS NOT NULL").select(F.col("query_id").alias("id"), codes.alias("c"), fold(queries).alias("f"))
    return q, rows.where("elems IS NOT NULL").select(F.col("row_id").alias("id"), "label", codes.alias("c"), fold(rows).alias("f"))


def _block_pairs(q: DataFrame, r: DataFrame, blocks: int | None, by: Sequence[str] = ("id",), least: int = LEAST_QUERIES, waves: int = 6, block: int = BLOCK) -> DataFrame:
    """Each pair of a block of queries and a block of rows: q ARRAY<STRUCT<id, c, f>>, r ARRAY<STRUCT<id, label, c, f>>. Rows that are equal in `by` are in one block."""
    if blocks is None:
        rows, queries, tasks = r.count(), q.count(), waves * q.sparkSession.sparkContext.defaultParallelism
        nr = max(1, -(-rows // block))
        # the queries are few: their blocks are made smaller where else there would be too few tasks
        nq = max(1, -(-queries // QUERY_BLOCK), min(-(-tasks // nr), queries // least))
    else:
        nq = nr = blocks
    number = lambda n, *by: F.pmod(F.xxhash64(*by), F.lit(n)).cast("int")
    qb = q.groupBy(number(nq, "id").alias("qb")).agg(F.collect_list(F.struct("id", "c", "f")).alias("q"))
    rb = r.groupBy(number(nr, *by).alias("rb")).agg(F.collect_list(F.struct("id", "label", "c", "f")).alias("r"))
    # each block of rows goes to every block of queries, by the block's number
    rb = rb.withColumn("qb", F.explode(F.sequence(F.lit(0), F.lit(nq - 1))))
    # pairs of blocks are few but costly: each has a task of its own as long as they aren't too many
    tasks = max(min(nq * nr, 2000), nq * nr // 8)
    return rb.join(qb, "qb").repartitionById(tasks, (F.col("rb") * nq + F.col("qb")) % tasks).select("q", "r")


def _lists(block: pa.StructArray) -> list[np.ndarray]:
    """The codes of a block."""
    c = block.field("c")
    values, ends = c.values.to_numpy(zero_copy_only=False).astype(np.int64), c.offsets.to_numpy()
    return [values[i:j] for i, j in zip(ends[:-1], ends[1:])]


def neighbours(queries: DataFrame, rows: DataFrame, k: int, *, threshold: float | None = None, blocks: int | None = None) -> DataFrame:
    """For each query sequence its k nearest rows: query_id, rank, row_id, label, distance, norm.

    queries: query_id, elems; rows: row_id, label, elems; a query doesn't meet the row of its own id, nor, where both tables have a column fold, rows of its own
    fold. Order: distance, norm, label, row_id. threshold: pairs with a greater norm are left out before ranking. The norm is the distance by the longer length, 0 for 0, 999 for a pair
    of very different lengths.

    Both sides are packed into blocks; each pair of blocks is one row of an equi-join, and leaves only the k best of its rows for each query, which are ranked again over all blocks.
    Only rows that a bound can't tell from the nearest are compared in full, see Corpus; equal ones are compared once.
    """

    def nearest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for pair in range(batch.num_rows):
                qs, rs = batch.column(0)[pair].values, batch.column(1)[pair].values
                # nulls last, both strings by their bytes
                rs = rs.take(pc.sort_indices(pa.table([rs.field("label"), rs.field("id")], ["label", "id"]), [("label", "ascending"), ("id", "ascending")]))
                searched, names, folds = _lists(qs), qs.field("id").to_pylist(), qs.field("f").to_pylist()
                own: dict[str, list[int]] = {x: [] for x in names}
                for at, x in enumerate(rs.field("id").to_pylist()):
                    if x in own:
                        own[x].append(at)
                table = _lists(rs)
                sizes, fold, corpus = np.array([len(x) for x in table], np.int64), np.array(rs.field("f").fill_null(-1)), Corpus(table)
                fits: dict[int | None, np.ndarray | None] = {None: None}
                which, where, far, norms = [], [], [], []
                for i, a in enumerate(searched):
                    if folds[i] not in fits:
                        fits[folds[i]] = np.logical_or.reduceat(fold[corpus.members] != folds[i], np.append(0, corpus.ends[:-1]))
                    mine = own.get(names[i], [])
                    near, d, apart = corpus.nearest(a, k + len(mine), fits[folds[i]], threshold)
                    good, place = corpus.rows(near)
                    d = d[place]
                    for more in range(2):
                        norm = np.where(d == 0, 0.0, np.where(d == FAR, 999.0, d / np.maximum(np.maximum(sizes[good], len(a)), 1)))
                        keep = np.ones(len(d), bool) if folds[i] is None else fold[good] != folds[i]
                        keep[np.isin(good, mine)] = False
                        if threshold is not None:
                            keep &= norm <= threshold
                        good, d, norm = good[keep], d[keep], norm[keep]
                        if more or len(good) >= k or threshold is not None and threshold < 999 or not apart.any():
                            break
                        # those of very different lengths follow
                        others = corpus.rows(np.flatnonzero(apart))[0]
                        good, d = np.append(good, others), np.append(d, np.full(len(others), FAR))
                    best = np.lexsort((good, norm, d))[:k]
                    which.append(np.full(len(best), i))
                    for out, x in ((where, good), (far, d), (norms, norm)):
                        out.append(x[best])
                which, where, far, norms = (np.concatenate([np.empty(0, t), *x]) for x, t in ((which, np.int64), (where, np.int64), (far, np.int64), (norms, np.float64)))
                found = rs.take(pa.array(where))
                yield pa.RecordBatch.from_arrays([qs.field("id").take(pa.array(which)), found.field("id"), found.field("label"), pa.array(far), pa.array(norms)], names=["query_id", "row_id", "label", "distance", "norm"])

    q, r = _coded(queries, rows)
    # the more rows a task has, the sooner it knows how near the nearest are; it prepares them first, so that it takes many queries
    found = _block_pairs(q, materialize(r), blocks, waves=3, block=NEAR_BLOCK).mapInArrow(nearest, "query_id string, row_id string, label string, distance bigint, norm double")
    w = Window.partitionBy("query_id").orderBy("distance", "norm", F.col("label").asc_nulls_last(), "row_id")
    return found.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k).select("query_id", "rank", "row_id", "label", "distance", "norm")


def votes(found: DataFrame, ks: Sequence[int]) -> DataFrame:
    """For each query and each k the labels among its k nearest rows: query_id, k, label, n, distance_min, distance_max, norm, first_rank.

    norm is that of the label's best row, and stands for both bounds.
    """
    at = found.withColumn("k", F.explode(F.array(*map(F.lit, ks)))).where("rank <= k")
    return at.groupBy("query_id", "k", "label").agg(F.count("*").alias("n"), F.min("distance").alias("distance_min"), F.max("distance").alias("distance_max"), F.min_by("norm", "rank").alias("norm"), F.min("rank").alias("first_rank"))


def quality(options: DataFrame, truth: DataFrame, ks: Sequence[int]) -> DataFrame:
    """How well the votes tell each query's label, 0 NoResult to 6 Exact: query_id, k, quality, quality_name.

    truth: query_id, truth. Exact: the truth alone is voted for; Majority: over half of the votes; Plurality: more than any other;
    PluralityThenMinDist: as many as the most, but nearer; Contains: any vote.
    """
    all_ = truth.withColumn("k", F.explode(F.array(*map(F.lit, ks))))
    j = all_.join(options, ["query_id", "k"], "left")
    mine, other = F.col("label") == F.col("truth"), F.coalesce(F.col("label") != F.col("truth"), F.col("first_rank").isNotNull())
    g = j.groupBy("query_id", "k").agg(
        F.count("first_rank").alias("labels"), F.coalesce(F.sum("n"), F.lit(0)).alias("total"), F.max(F.when(mine, F.col("n"))).alias("own"), F.max(F.when(mine, F.col("distance_min"))).alias("own_min"),
        F.coalesce(F.max(F.when(other & ~F.coalesce(mine, F.lit(False)), F.col("n"))), F.lit(0)).alias("best"),
        F.max(F.when(~F.coalesce(mine, F.lit(False)) & F.col("n").isNotNull(), F.struct(F.col("n"), (-F.col("distance_min")).alias("near")))).alias("rival"),
    )
    nearer = (F.col("rival.n") == F.col("own")) & (-F.col("rival.near") > F.col("own_min"))
    q = F.when(F.col("labels") == 0, 0).when(F.col("own").isNull(), 1).when(F.col("labels") == 1, 6).when(F.col("own") * 2 > F.col("total"), 5).when(F.col("own") > F.col("best"), 4).when(nearer, 3).otherwise(2)
    return g.select("query_id", "k", q.alias("quality"), F.get(F.array(*map(F.lit, QUALITIES)), q).alias("quality_name"))


def assign_folds(df: DataFrame, label: str, order: str, folds: int = 10) -> DataFrame:
    """df with fold, the position of the row within its label modulo folds; a label may have any number of rows, see group_numbers."""
    return group_numbers(df, [label], [F.col(order)], "fold").withColumn("fold", F.col("fold") % folds)


def _trace_batch(a: np.ndarray, la: np.ndarray, b: np.ndarray, lb: np.ndarray) -> tuple[np.ndarray, list[np.ndarray]]:
    """Costs of the cheapest alignments of many pairs by change, one column each of CHANGES, and the gaps that were substituted as rows of pair, lesser and greater gap; arguments as for batch_distance, rows of a not shorter than those of b.

    The table is filled as in batch_distance and keeps one byte a cell, which way led there; then all pairs walk back together. Among equally
    cheap ways a swap goes before a substitution, that before a deletion, that before an insertion.
    """
    n, rows, cols = len(a), a.shape[1], b.shape[1]
    ca, cb = _costs(a), _costs(b)
    cum = np.concatenate([np.zeros((n, 1), np.int64), np.cumsum(cb, axis=1)], axis=1)
    prior, older = cum, np.zeros_like(cum)
    way = np.zeros((rows, n, cols), np.int8)
    both = (SIZE_INSERT + SIZE_INSERT) // SIZE_SUBSTITUTE_DIVIDER
    for i in range(rows):
        x, cx = a[:, i : i + 1], ca[:, i : i + 1]
        change = np.where((x >= 0) & (b >= 0), both, np.where((x < 0) & (b < 0), GAP_SUBSTITUTE * np.abs(x - b), cx + cb))
        substituted = prior[:, :-1] + np.where(x == b, 0, change)
        swapped = np.full_like(substituted, FAR)
        if i:
            fits = (a[:, i - 1 : i] == b[:, 1:]) & (x == b[:, :-1])
            swapped[:, 1:] = np.where(fits, older[:, :-2] + np.where(x == b[:, 1:], 0, SWAP), FAR)
        step = np.minimum(np.minimum(prior[:, 1:] + cx, substituted), swapped)
        row = np.concatenate([prior[:, :1] + cx, step], axis=1) - cum
        row = np.minimum.accumulate(row, axis=1) + cum
        found = row[:, 1:]
        way[i] = np.select([swapped == found, substituted == found, row[:, :-1] + cb == found], [3, 2, 1], 0)
        older, prior = prior, row
    out, gaps = np.zeros((n, len(CHANGES)), np.int64), []
    at, i, j = np.arange(n), la.copy(), lb.copy()
    while len(at):
        more = (i > 0) | (j > 0)
        at, i, j = at[more], i[more], j[more]
        # at the borders of the table only one way is left: the shorter one's elements are inserted, the longer one's deleted, or inserted into an empty one
        x, y = (np.where(k > 0, s[at, np.maximum(k, 1) - 1], 0) if s.shape[1] else np.zeros_like(k) for s, k in ((a, i), (b, j)))
        inside = (i > 0) & (j > 0)
        w = np.zeros(len(at), np.int8)
        w[inside] = way[i[inside] - 1, at[inside], j[inside] - 1]
        top, left = i == 0, (j == 0) & (lb[at] > 0)
        own = np.where(top | ((w == 1) & inside), y, x)
        cost = np.where(x == y, 0, np.where((x >= 0) & (y >= 0), both, np.where((x < 0) & (y < 0), GAP_SUBSTITUTE * np.abs(x - y), _costs(x) + _costs(y))))
        cost = np.where(w == 3, np.where(x == y, 0, SWAP), np.where(w == 2, cost, _costs(own)))
        kinds = 2 * (x >= 0) + (y >= 0)
        what = np.where(w == 3, 8 + kinds, np.where(w == 2, 4 + kinds, 2 * ((w == 1) | left) + (own >= 0)))
        out[at, what] += cost
        g = (w == 2) & (x < 0) & (y < 0) & (x != y)
        gaps.append(np.stack([at[g], -np.maximum(x[g], y[g]) - 1, -np.minimum(x[g], y[g]) - 1], axis=1))
        # an insertion takes an element of the longer one, a deletion one of the shorter one, but for the borders
        i = i - np.where(top, 0, np.array([1, 0, 1, 2])[w])
        j = j - np.where(top, 1, np.array([0, 1, 1, 2])[w])
    return out, gaps


def trace_all(a: Sequence[np.ndarray], b: Sequence[np.ndarray]) -> list[dict[str, int]]:
    """For each pair of lists of signed codes the cost of its cheapest alignment by operation and element kind, as insert_size or swap_gap_size,
    and how often it makes one gap another, as gap(1)_to_gap(3), the lesser first; zeros are left out."""
    out: list[dict[str, int]] = [{} for _ in a]
    # the longer one of a pair gives the steps; equal pairs cost nothing
    longer, shorter = ([y if (len(x) < len(y)) == first else x for x, y in zip(a, b)] for first in (True, False))
    la, lb = (np.array([len(x) for x in s], np.int64) for s in (longer, shorter))
    order = np.lexsort((lb, la))
    order = order[[not np.array_equal(a[i], b[i]) for i in order]]
    start = 0
    while start < len(order):
        rest = order[start:]
        cells = np.arange(1, len(rest) + 1) * la[rest] * (np.maximum.accumulate(lb[rest]) + 1)
        fits = (cells <= _TRACE_CELLS) & (la[rest] <= 1.3 * la[rest[0]] + 8)
        part = rest[: max(1, int(np.argmin(fits)) if not fits.all() else len(fits))]
        found, gaps = _trace_batch(*_pad([longer[i] for i in part]), *_pad([shorter[i] for i in part]))
        for i, costs in zip(part, found.tolist()):
            out[i] = {c: v for c, v in zip(CHANGES, costs) if v}
        for i, least, most in np.concatenate(gaps).tolist():
            key, m = f"gap({least})_to_gap({most})", out[part[i]]
            m[key] = m.get(key, 0) + 1
        start += len(part)
    return out


def trace_costs(a: list[int], b: list[int]) -> dict[str, int]:
    """The costs of one pair as in trace_all, without the counts of gaps; they sum to the distance."""
    return {c: v for c, v in trace_all([np.array(a, np.int64)], [np.array(b, np.int64)])[0].items() if c in CHANGES}


def seq_distance_details(a: Column, b: Column) -> Column:
    """trace_all of two columns of elements, as MAP<STRING, BIGINT>; its values but the counts of gaps sum to the distance."""

    def run(x: pa.Array, y: pa.Array) -> pa.Array:
        out = [None] * len(x)
        given = [i for i in range(len(x)) if x[i].is_valid and y[i].is_valid]
        found = trace_all(*([np.array(s[i].as_py(), np.int64) for i in given] for s in (x, y)))
        for i, m in zip(given, found):
            out[i] = list(m.items())
        return pa.array(out, pa.map_(pa.string(), pa.int64()))

    run.__annotations__ = {"x": pa.Array, "y": pa.Array, "return": pa.Array}
    return F.arrow_udf(run, "map<string,bigint>")(signed(a), signed(b))


def group_distances(queries: DataFrame, rows: DataFrame, *, blocks: int | None = None, most: int = LABEL_BLOCK) -> DataFrame:
    """For each query sequence and each label its distances to the label's rows: query_id, label, n, mean, median.

    queries and rows as for neighbours; a query doesn't meet rows of its own id. mean is rounded down, median is the value at position n div 2. A label whose
    only row is the query itself has no row here. A label of up to `most` rows lies in one block, whose task gives its results; of the greater ones
    each task hands on counts of equal distances, not the pairs.
    """

    def grouped(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[pa.StructArray, pa.StructArray, np.ndarray, np.ndarray, np.ndarray]]:
        """For some queries of a block: the queries, the rows by label, where each label starts, the distances and which of them count."""
        for batch in batches:
            for pair in range(batch.num_rows):
                qs, rs = batch.column(0)[pair].values, batch.column(1)[pair].values
                if not len(qs) or not len(rs):
                    continue
                number = rs.field("label").dictionary_encode(null_encoding="encode").indices.to_numpy()
                order = np.argsort(number, kind="stable")
                rs, starts = rs.take(pa.array(order)), np.flatnonzero(np.diff(number[order], prepend=-1))
                own: dict[str, list[int]] = {}
                for at, i in enumerate(rs.field("id").to_pylist()):
                    own.setdefault(i, []).append(at)
                names, some, found = qs.field("id").to_pylist(), [], []
                step = max(1, _MATRIX_CELLS // 2 // len(rs))
                left = len(qs)
                for members, d in cross_distances(_lists(qs), _lists(rs)):
                    for i in members.tolist():
                        some.append(i)
                        found.append(d)
                        left -= 1
                        if len(some) == step or not left:
                            counted = np.ones((len(some), len(rs)), bool)
                            for row, x in enumerate(some):
                                counted[row, own.get(names[x], [])] = False
                            yield qs.take(pa.array(some)), rs, starts, np.stack(found), counted
                            some, found = [], []

    def summed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for qs, rs, starts, d, counted in grouped(batches):
            n = np.add.reduceat(counted, starts, axis=1, dtype=np.int64)
            total = np.add.reduceat(np.where(counted, d, 0), starts, axis=1)
            # within each label in order, what doesn't count last
            bits = int(d.max()).bit_length() + 1
            ranked = np.where(counted, d, (1 << bits) - 1) + (np.repeat(np.arange(len(starts)), np.diff(starts, append=len(rs))) << bits)
            ranked.sort(axis=1)
            q, g = np.nonzero(n)
            n = n[q, g]
            middle = ranked[q, starts[g] + n // 2] & ((1 << bits) - 1)
            yield pa.RecordBatch.from_arrays([qs.field("id").take(pa.array(q)), rs.field("label").take(pa.array(starts[g])), pa.array(n), pa.array(total[q, g] // n), pa.array(middle)], names=["query_id", "label", "n", "mean", "median"])

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for qs, rs, starts, d, counted in grouped(batches):
            group = np.repeat(starts, np.diff(starts, append=len(rs)))
            for i in range(len(qs)):
                (g, values), c = np.unique(np.stack([group, d[i]])[:, counted[i]], axis=1, return_counts=True)
                yield pa.RecordBatch.from_arrays([qs.field("id").take(pa.array(np.full(len(c), i))), rs.field("label").take(pa.array(g)), pa.array(values), pa.array(c)], names=["query_id", "label", "d", "c"])

    q, r = _coded(queries, rows)
    r = materialize(r)
    big = r.groupBy("label").count().where(F.col("count") > most).select(F.col("label").alias("big"))
    whole = _block_pairs(q, r.join(big, F.col("label").eqNullSafe(F.col("big")), "left_anti"), blocks, ["label"], 3 * LEAST_QUERIES).mapInArrow(summed, "query_id string, label string, n bigint, mean bigint, median bigint")
    if big.isEmpty():
        return whole
    d = _block_pairs(q, r.join(big, F.col("label").eqNullSafe(F.col("big")), "left_semi"), blocks, least=3 * LEAST_QUERIES).mapInArrow(count, "query_id string, label string, d bigint, c bigint")
    d = d.groupBy("query_id", "label", "d").agg(F.sum("c").alias("c"))
    d = running_sums(d, ["query_id", "label"], ["d"], "c", "upto", "n")
    middle = F.when(F.expr("n div 2 < upto AND n div 2 >= upto - c"), F.col("d"))
    return whole.unionByName(d.groupBy("query_id", "label").agg(F.sum("c").alias("n"), F.expr("sum(d * c) div sum(c)").alias("mean"), F.max(middle).alias("median")))
