"""Suffix order and common-prefix values of a byte shard by induced sorting with bulk priority queues.

The suffixes that start a rise after a fall (LMS) are ordered first: their pieces are named in order, and the string of
names is ordered by the same procedure until all names differ.  Two sweeps then induce the rest: each suffix taken from the queue puts the one
before it back, under its first symbol, after all that came earlier.  Queues take and give whole runs of suffixes that
cannot be overtaken; their buffers go to an unnamed scratch file beyond a memory budget, and so do the arrays of a shard
that is larger than it.  Common-prefix values start from compared LMS suffixes and are carried along: that of two
suffixes in one bucket is one more than the least between the suffixes that induced them.
"""

from __future__ import annotations

import tempfile

import numpy as np

BUDGET = 256 << 20


def _array(n: int, kind, budget: int) -> np.ndarray:
    """An array of zeros, in a scratch file if it is a large part of the budget."""
    size = n * np.dtype(kind).itemsize
    if size * 8 <= budget or not n:
        return np.zeros(n, kind)
    return np.memmap(tempfile.TemporaryFile(), kind, "w+", shape=(n,))


class BulkQueue:
    """A queue of (key, position, rank) in order of keys, equal keys in the order that they came; nothing is put in below
    what was taken.  Keys are held by ranges; a range is read as a whole when its turn comes.  Beyond the budget all rows
    in memory go to an unnamed scratch file, a stretch for each range."""

    def __init__(self, edges: np.ndarray, budget: int):
        self.edges, self.budget = edges, budget
        self.parts: list[list[np.ndarray]] = [[] for _ in range(len(edges))]
        self.stored: list[list[tuple[int, int]]] = [[] for _ in range(len(edges))]
        self.held, self.file, self.end, self.alone = 0, None, 0, len(edges) > 1 and bool((np.diff(edges) == 1).all())

    def put(self, rows: np.ndarray) -> None:
        """rows: columns key, position, rank."""
        if not rows.shape[1]:
            return
        at = (np.searchsorted(self.edges, rows[0], "right") - 1).astype(np.uint16)
        if (at[1:] < at[:-1]).any():
            order = np.argsort(at, kind="stable")
            at, rows = at[order], rows[:, order]
        starts = np.flatnonzero(np.concatenate([[True], at[1:] != at[:-1]])).tolist()
        for a, b in zip(starts, [*starts[1:], len(at)]):
            self.parts[at[a]].append(rows[:, a:b])
        self.held += rows.nbytes
        if self.held > self.budget:
            self._spill()

    def _spill(self) -> None:
        if self.file is None:
            self.file = tempfile.TemporaryFile()
        self.file.seek(self.end)
        for r, part in enumerate(self.parts):
            if part:
                rows = np.ascontiguousarray(np.concatenate(part, axis=1))
                self.stored[r].append((self.end, rows.shape[1]))
                self.file.write(rows)
                self.end += rows.nbytes
                self.parts[r] = []
        self.held = 0

    def take(self, r: int) -> np.ndarray:
        """All rows of a range, in order of keys."""
        out = []
        for at, n in self.stored[r]:
            self.file.seek(at)
            out.append(np.frombuffer(self.file.read(n * 24), np.int64).reshape(3, n))
        for x in self.parts[r]:
            self.held -= x.nbytes
            out.append(x)
        self.stored[r], self.parts[r] = [], []
        if not out:
            return np.zeros((3, 0), np.int64)
        rows = np.concatenate(out, axis=1)
        return rows if self.alone else rows[:, np.argsort(rows[0], kind="stable")]


def _types(t: np.ndarray) -> np.ndarray:
    """Whether each suffix is smaller than the next one; the last symbol is the smallest and stands alone."""
    n = len(t)
    out = np.ones(n, bool)
    if n > 1:
        differ = np.flatnonzero(t[1:] != t[:-1])
        rises = t[differ] < t[differ + 1]
        out[:-1] = np.repeat(rises, np.diff(differ, prepend=-1))[: n - 1]
    return out


def _names(t: np.ndarray, small: np.ndarray, lms: np.ndarray) -> np.ndarray:
    """Rank of each LMS piece (to the next LMS symbol, itself included): how many pieces are smaller."""
    m = len(lms)
    ends = np.append(lms[1:], lms[-1])
    bits = int(2 * int(t.max()) + 2).bit_length()
    per = max(1, 63 // bits)
    rank, live, step = np.zeros(m, np.int64), np.arange(m), 0
    while len(live):
        key = np.zeros(len(live), np.int64)
        for k in range(step, step + per):
            at = lms[live] + k
            inside = at <= ends[live]
            at = np.minimum(at, len(t) - 1)
            key = (key << bits) | np.where(inside, 2 * t[at].astype(np.int64) + small[at] + 1, 0)
        order = np.lexsort((key, rank[live]))
        live, key = live[order], key[order]
        r = rank[live]
        new = np.concatenate([[True], r[1:] != r[:-1]])
        part = new | np.concatenate([[True], key[1:] != key[:-1]])
        i = np.arange(len(live))
        rank[live] = r + np.maximum.accumulate(np.where(part, i, 0)) - np.maximum.accumulate(np.where(new, i, 0))
        step += per
        alone = part & np.append(part[1:], True)
        live = live[~alone & (lms[live] + step <= ends[live])]
    return rank


def _edges(keys: np.ndarray, top: int, most: int = 128) -> np.ndarray:
    """First keys of ranges: each key if there are few, or quantiles."""
    if top <= 1024:
        return np.arange(top + 1)
    got = np.unique(np.quantile(keys, np.linspace(0, 1, most + 1)[:-1], method="lower").astype(np.int64))
    got[0] = 0
    return got


def _compare(t: np.ndarray, order: np.ndarray, cap: int) -> np.ndarray:
    """Common-prefix values, up to cap, of each suffix in the order with the one before it."""
    n = len(t)
    word = np.zeros(n, np.int64)
    for k in range(7):
        word <<= 9
        word[: max(0, n - k)] |= t[k:]
    out = np.zeros(len(order), np.int32)
    a, b, live = order[:-1].copy(), order[1:].copy(), np.arange(1, len(order))
    done = 0
    while len(live) and done < cap:
        x = word[np.minimum(a, n - 1)] ^ word[np.minimum(b, n - 1)]
        same = (x == 0) & (a < n) & (b < n)
        stop = ~same
        if stop.any():
            y = x[stop]
            lead = np.full(len(y), 7)
            for k in range(6, -1, -1):
                lead[(y >> (9 * (6 - k))) != 0] = np.minimum(lead[(y >> (9 * (6 - k))) != 0], k)
            out[live[stop]] = np.minimum(cap, done + lead)
        a, b, live = a[same] + 7, b[same] + 7, live[same]
        done += 7
    out[live] = cap
    return out


def _sweep(t, small, seeds, seed_lcp, up: bool, run, cap: int, budget: int):
    """One sweep.  Up: from sorted LMS suffixes, all that are larger than their next; down: from these, all smaller ones.

    Returns the order in which suffixes were taken and their common-prefix values with the one taken before.
    """
    n, top = len(t), int(t.max())
    sign = 1 if up else -1
    flip = 0 if up else top  # keys rise in either sweep
    wanted = ~small if up else small
    seed_key = flip + sign * t[seeds].astype(np.int64)
    count = int(wanted.sum()) + len(seeds)
    edges = _edges(flip + sign * t[np.flatnonzero(wanted)].astype(np.int64), top)
    queue = BulkQueue(edges, budget // 4)
    carry = run is not None
    order = _array(count, np.int64, budget)
    lcp = _array(count, np.int32, budget) if carry else None
    done, last_key, last_rank, last_induced = 0, -1, -1, False
    bounds = np.append(edges, top + 1)
    seed_at = np.searchsorted(seed_key, bounds)

    def give(pos: np.ndarray) -> np.ndarray:
        """Rows for the suffixes before these, if they belong to this sweep."""
        nonlocal done
        rank = np.arange(done, done + len(pos))
        order[done : done + len(pos)] = pos
        done += len(pos)
        ok = pos > 0
        pos, rank = pos[ok] - 1, rank[ok]
        ok = wanted[pos]
        pos, rank = pos[ok], rank[ok]
        return np.stack([flip + sign * t[pos].astype(np.int64), pos, rank])

    for r in range(len(edges)):
        pend = queue.take(r)
        lo, hi = seed_at[r], seed_at[r + 1]
        while pend.shape[1] or lo < hi:
            key = int(pend[0, 0]) if pend.shape[1] else bounds[r + 1]
            first_seed = int(seed_key[lo]) if lo < hi else bounds[r + 1]
            if first_seed < key:  # seeds stand behind the induced suffixes of their symbol
                limit = np.searchsorted(seed_key[lo:hi], key) + lo if pend.shape[1] else hi
                if not _apart(t, wanted, seeds, seed_key, lo, limit, flip, sign):
                    limit = int(np.searchsorted(seed_key[lo:limit], first_seed, "right")) + lo
                pos = seeds[lo:limit]
                if carry:
                    keys = seed_key[lo:limit]
                    v = seed_lcp[lo:limit].copy()
                    v[1:][keys[1:] != keys[:-1]] = 0
                    v[0] = 0 if keys[0] != last_key else (min(run[pos[0]], run[order[done - 1]]) if last_induced else v[0])
                    lcp[done : done + len(pos)] = np.minimum(v, cap)
                last_key, last_induced = int(seed_key[limit - 1]), False
                lo = limit
                new = give(pos)
            else:
                child_pos = pend[1] - 1
                ok = child_pos >= 0
                child = np.full(len(ok), np.iinfo(np.int64).max)
                c = child_pos[ok]
                child[np.flatnonzero(ok)] = np.where(wanted[c], flip + sign * t[c].astype(np.int64), np.iinfo(np.int64).max)
                least = np.minimum.accumulate(child)
                bad = np.flatnonzero((least[:-1] < pend[0, 1:]) | (pend[0, 1:] > first_seed))
                take = int(bad[0]) + 1 if len(bad) else pend.shape[1]
                part, pend = pend[:, :take], pend[:, take:]
                if carry:
                    ranks, keys = part[2], part[0]
                    starts = np.concatenate([[last_rank if last_induced and keys[0] == last_key else ranks[0] - 1], ranks[:-1]]) + 1
                    v = np.minimum.reduceat(lcp[: ranks[-1] + 1], np.minimum(starts, ranks)) + 1
                    v[1:][keys[1:] != keys[:-1]] = 0
                    if keys[0] != last_key:
                        v[0] = 0
                    lcp[done : done + take] = np.minimum(v, cap)
                    last_rank = int(ranks[-1])
                last_key, last_induced = int(part[0, -1]), True
                new = give(part[1])
            if new.shape[1]:
                here = new[0] < bounds[r + 1]
                if here.any():
                    pend = np.concatenate([pend, new[:, here]], axis=1)
                    pend = pend[:, np.argsort(pend[0], kind="stable")]
                queue.put(new[:, ~here])
    return order[:done], (lcp[:done] if carry else None)


def _apart(t, wanted, seeds, seed_key, lo, hi, flip, sign) -> bool:
    """Whether no suffix that these seeds induce stands before a later one of them."""
    if hi - lo < 2 or seed_key[lo] == seed_key[hi - 1]:
        return True
    pos = seeds[lo:hi]
    before = np.maximum(pos - 1, 0)
    child = np.where((pos > 0) & wanted[before], flip + sign * t[before].astype(np.int64), np.iinfo(np.int64).max)
    return bool((np.minimum.accumulate(child)[:-1] > seed_key[lo + 1 : hi]).all())


def _sweep_names(t: np.ndarray, wanted: np.ndarray, seeds: np.ndarray, up: bool, budget: int) -> np.ndarray:
    """The order in which one sweep over a string of names takes suffixes.

    Of the many symbols few recur in a row, so that all of a range, seeds too, go on together up to the first suffix that
    one of them puts back among them.  Rows are (key, position, key of the suffix before it); a seed's key is odd, as it
    stands behind the induced suffixes of its symbol.
    """
    top = int(t.max())
    sign, flip = (1, 0) if up else (-1, top)
    key = lambda pos: 2 * (flip + sign * t[pos])
    never = np.iinfo(np.int64).max

    def rows(keys: np.ndarray, pos: np.ndarray) -> np.ndarray:
        before = np.maximum(pos - 1, 0)
        return np.stack([keys, pos, np.where((pos > 0) & wanted[before], key(before), never)])

    edges = 2 * _edges(key(np.flatnonzero(wanted)) // 2, top, 256)
    queue = BulkQueue(edges, budget // 4)
    first = rows(key(seeds) + 1, seeds)
    bounds = np.append(edges, 2 * top + 2)
    at = np.searchsorted(first[0], bounds)
    order, done = _array(int(wanted.sum()) + len(seeds), np.int64, budget), 0
    for r in range(len(edges)):
        pend = np.concatenate([queue.take(r), first[:, at[r] : at[r + 1]]], axis=1)
        pend = pend[:, np.argsort(pend[0], kind="stable")]
        while pend.shape[1]:
            least = np.minimum.accumulate(pend[2])
            late = np.flatnonzero(least[:-1] < pend[0, 1:])
            n = int(late[0]) + 1 if len(late) else pend.shape[1]
            part, pend = pend[:, :n], pend[:, n:]
            order[done : done + n] = part[1]
            done += n
            part = part[:, part[2] != never]
            new = rows(part[2], part[1] - 1)
            here = new[0] < bounds[r + 1]
            if here.any():
                pend = np.concatenate([pend, new[:, here]], axis=1)
                pend = pend[:, np.argsort(pend[0], kind="stable")]
                new = new[:, ~here]
            queue.put(new)
    return order[:done]


def suffix_order(t: np.ndarray, cap: int = 0, budget: int = BUDGET) -> tuple[np.ndarray, np.ndarray | None]:
    """Suffixes of t in descending order and, if cap is given, common-prefix values up to cap with the one before.

    t: nonnegative integers (below 512 if cap is given); the last is the only 0.  Every level goes through the queues; what
    they and the results hold beyond the budget is in files.  Besides, some ten arrays of a number for each symbol are in
    memory, or mapped files where they are a large part of the budget.
    """
    n = len(t)
    if n == 1:
        return np.zeros(1, np.int64), np.zeros(1, np.int32) if cap else None
    small = _types(t)
    lms = np.flatnonzero(small[1:] & ~small[:-1]) + 1
    rank = _names(t, small, lms)
    if len(np.unique(rank)) == len(rank):
        order = lms[np.argsort(rank, kind="stable")]
    else:
        _, dense = np.unique(rank, return_inverse=True)
        order = lms[suffix_order(dense.astype(np.int64), 0, budget)[0][::-1]]
    run = seed_lcp = None
    if cap:
        differ = np.append(np.flatnonzero(t[1:] != t[:-1]), n - 1)
        run = (np.repeat(differ, np.diff(differ, prepend=-1)) - np.arange(n) + 1).astype(np.int32)
        seed_lcp = _compare(t, order, cap)
    last = np.array([n - 1])
    if not cap:
        falling = _sweep_names(t, ~small, order, True, budget)
        return _sweep_names(t, small, np.append(falling[~small[falling]][::-1], last), False, budget), None
    falling, f_lcp = _sweep(t, small, order, seed_lcp, True, run, cap, budget)
    keep = ~small[falling]
    large = falling[keep][::-1]
    if cap:
        l_lcp = np.append(0, f_lcp[keep][::-1][:-1]).astype(np.int32)
        l_lcp = np.where(np.append(True, t[large[1:]] != t[large[:-1]]), 0, l_lcp)
    order, lcp = _sweep(t, small, np.append(large, last), np.append(l_lcp, 0) if cap else None, False, run, cap, budget)
    return order, lcp
