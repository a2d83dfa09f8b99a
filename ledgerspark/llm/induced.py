"""Suffix and common-prefix arrays of one shard by external induced sorting.

The string is scanned for S* positions; their substrings are sorted and named by induction, the string of names is
solved by recursion down to names that all differ, and the sorted S* suffixes then induce all L suffixes in ascending
and all S suffixes in descending order (Nong et al.; Bingmann, Fischer and Osipov for the external form with common
prefixes). Tuples (position, common prefix with the one before) pass through a priority queue whose keys only grow: one
FIFO for each symbol, laid out by symbol. Symbols are taken in batches between which no suffix induces another one of
its own batch, so that each step is a few numpy operations; strings of names whose batches hold few entries are induced
entry by entry.

The string, types, runs, queues and sorted suffixes lie in scratch files of the task beyond ``MEMORY`` entries and are gone
with it. Memory still grows with the shard: while a level is set up, types, lengths, names and common prefixes take about 42
bytes for each symbol beside these files (measured at one and three million symbols), so shards are cut to what a task can
hold, 8 MB by default, and are not far larger than memory. Queues are arrays with a stretch for each symbol, not sorted runs
that are merged. Positions have eight
bytes where four don't do. Common prefixes are capped, which is all that matching strings of a fixed length needs.
"""

from __future__ import annotations

import tempfile
from bisect import bisect_right

import numpy as np

#: Entries of an array that stay in memory; larger ones lie in a file of the task, which has no name and ends with its map.
MEMORY = 1 << 18
#: Strings with fewer entries than this for each batch of symbols are induced entry by entry.
FINE = 192


def scratch(n: int, dtype: type | str) -> np.ndarray:
    """An array of ``n`` entries, in a file of the task beyond ``MEMORY``."""
    if n <= MEMORY:
        return np.empty(n, dtype=dtype)
    file = tempfile.TemporaryFile()
    file.truncate(n * np.dtype(dtype).itemsize)
    out = np.memmap(file, dtype=dtype, mode="r+", shape=(n,))
    file.close()  # the map keeps it
    return out


def laid(x: np.ndarray) -> np.ndarray:
    """``x``, in a file of the task beyond ``MEMORY``."""
    if len(x) <= MEMORY:
        return x
    out = np.asarray(scratch(len(x), x.dtype))  # a plain array of the map, whose slices are made faster
    out[:] = x
    return out


def starts(x: np.ndarray) -> np.ndarray:
    """First place of each run of equal values."""
    return np.flatnonzero(np.concatenate(([True], x[1:] != x[:-1]))) if len(x) else np.zeros(0, dtype=np.int64)


def places(n: int) -> type:
    """Type of positions in a string of ``n``."""
    return np.int32 if n < 1 << 31 else np.int64


class SymbolQueue:
    """Monotone priority queue of (symbol, position, common prefix) with a FIFO for each symbol.

    ``sizes`` bounds how many entries each symbol gets. ``pop`` takes whole ranges of symbols.
    """

    def __init__(self, sizes: np.ndarray, n: int):
        self.first = np.concatenate(([0], np.cumsum(sizes)))
        self.used = np.zeros(len(sizes), dtype=np.int64)
        total = int(self.first[-1])
        self.pos, self.lcp = np.asarray(scratch(total, places(n))), np.asarray(scratch(total, np.uint8))

    def push(self, symbols: np.ndarray, pos: np.ndarray, lcp: np.ndarray) -> None:
        """Appends entries; ``symbols`` must be in ascending order."""
        start = starts(symbols)
        count = np.diff(np.append(start, len(symbols)))
        kinds = symbols[start]
        at = np.arange(len(symbols)) + np.repeat(self.first[kinds] + self.used[kinds] - start, count)
        self.pos[at], self.lcp[at] = pos, lcp
        self.used[kinds] += count

    def pop(self, a: int, b: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """All entries with symbols in [a, b), by symbol and then by order of arrival."""
        used = self.used[a:b]
        if b - a == 1:
            at = slice(int(self.first[a]), int(self.first[a] + used[0]))
        else:
            at = np.arange(used.sum()) + np.repeat(self.first[a:b] - (np.cumsum(used) - used), used)
        return np.repeat(np.arange(a, b), used), np.asarray(self.pos[at]), np.asarray(self.lcp[at])


def range_min(x: np.ndarray, lo: np.ndarray, hi: np.ndarray) -> np.ndarray:
    """min(x[lo : hi + 1]) for each pair, by a sparse table."""
    n = hi - lo + 1
    k = np.frexp(n.astype(np.float64))[1] - 1
    out, table, width = np.empty(len(lo), dtype=x.dtype), x, 1
    for level in range(int(k.max()) + 1 if len(k) else 0):
        if level:
            table = np.minimum(table[:-width], table[width:])
            width *= 2
        own = k == level
        out[own] = np.minimum(table[lo[own]], table[hi[own] - width + 1])
    return out


class Text:
    """A string of numbers whose last symbol is its only least one, with suffix types and lengths of equal runs."""

    def __init__(self, t: np.ndarray):
        n = len(t)
        self.t, self.n, self.k = laid(t), n, int(t.max()) + 1
        change = np.flatnonzero(t[1:] != t[:-1])  # last place of each run but the final one
        ends = np.append(change, n - 1)
        length = np.diff(ends, prepend=-1)
        up = np.append(t[change] < t[change + 1], True)
        self.s_type = laid(np.repeat(up, length))
        self.run = laid(np.minimum(np.repeat(ends, length) - np.arange(n) + 1, 255).astype(np.uint8))
        self.star = laid(np.flatnonzero(self.s_type[1:] & ~self.s_type[:-1]) + 1)
        self.batches = self._batches(t[change], t[change + 1])

    def _batches(self, a: np.ndarray, b: np.ndarray) -> list[tuple[int, int]]:
        """Ranges of symbols of which no two different ones are neighbours in the text."""
        above = np.full(self.k, self.k, dtype=np.int64)  # least larger neighbour
        pairs = np.sort(np.minimum(a, b).astype(np.int64) * self.k + np.maximum(a, b))
        low, high = np.divmod(pairs, self.k)
        first = starts(low)
        above[low[first]] = high[first]
        out, start, limit = [], 0, self.k
        for c, nxt in enumerate(above.tolist()):
            if c >= limit:
                out.append((start, c))
                start, limit = c, self.k
            if nxt < limit:
                limit = nxt
        out.append((start, self.k))
        return out

    def induce(self, seeds: tuple[np.ndarray, np.ndarray], s_pass: bool, shares: bool = True) -> tuple[np.ndarray, np.ndarray]:
        """Sorted suffixes of one type from sorted ``seeds`` (positions, common prefixes) of the other.

        The L pass goes up from S* suffixes, the S pass goes down from L suffixes; both return their suffixes, and the
        common prefix of each with the one before it in that direction (without ``shares``: of no meaning).
        """
        t, target = self.t, self.s_type if s_pass else ~self.s_type
        if self.n < FINE * len(self.batches):
            return self._one_by_one(seeds, target, s_pass) if shares else self._order_only(seeds[0], target, s_pass)
        sizes = np.bincount(t[target], minlength=self.k)
        queue = SymbolQueue(sizes, self.n)
        seed_pos, seed_lcp = seeds
        seed_sym = t[seed_pos]
        seed_key = -seed_sym if s_pass else seed_sym  # ascending in the order of the pass
        done_pos, done_lcp, done = np.asarray(scratch(int(sizes.sum()), places(self.n))), np.asarray(scratch(int(sizes.sum()), np.uint8)), 0
        if s_pass:  # the last suffix is an S suffix with nothing to its right
            queue.push(t[-1:].astype(np.int64), np.array([self.n - 1]), np.zeros(1, dtype=np.uint8))
        batches = self.batches[::-1] if s_pass else self.batches
        bounds = np.array([(1 - b, 1 - a) if s_pass else (a, b) for a, b in batches], dtype=seed_key.dtype)
        for (a, b), (lo, hi) in zip(batches, np.searchsorted(seed_key, bounds).tolist(), strict=True):
            sym, pos, lcp = queue.pop(a, b)
            if len(sym):
                lcp[starts(sym)] = 0
                sym, pos, lcp = self._runs(sym, pos, lcp, target)
            e_sym, e_pos, e_lcp = seed_sym[lo:hi], seed_pos[lo:hi], seed_lcp[lo:hi].copy()
            if s_pass and len(sym):  # down the symbols, in order within each
                order = np.argsort(-sym, kind="stable")
                sym, pos, lcp = sym[order], pos[order], lcp[order]
            if len(sym):
                done_pos[done : done + len(pos)], done_lcp[done : done + len(pos)] = pos, lcp
                done += len(pos)
            if not len(sym) and not len(e_sym):
                continue
            all_sym, all_pos, all_lcp = self._joined(sym, pos, lcp, e_sym, e_pos, e_lcp, s_pass)
            self._spread(queue, all_sym, all_pos, all_lcp, target, shares)
        return done_pos[:done], done_lcp[:done]

    def _order_only(self, seeds: np.ndarray, target: np.ndarray, s_pass: bool) -> tuple[np.ndarray, np.ndarray]:
        """The result of ``induce`` without common prefixes, entry by entry."""
        # The symbol to queue for the place before each one, or -1.
        to = np.append(-1, np.where(target[:-1], self.t[:-1], -1)).tolist()
        queue: list[list[int]] = [[] for _ in range(self.k)]
        waiting: list[list[int]] = [[] for _ in range(self.k)]
        for c, p in zip(self.t[seeds].tolist(), seeds.tolist(), strict=True):
            waiting[c].append(p)
        if s_pass:
            queue[self.t[-1]].append(self.n - 1)
        out: list[int] = []
        for c in range(self.k - 1, -1, -1) if s_pass else range(self.k):
            own = queue[c]
            for some in (own, waiting[c]):
                for p in some:  # grows by suffixes that start earlier in the same run
                    if (d := to[p]) >= 0:
                        queue[d].append(p - 1)
            out += own
        return np.array(out, dtype=places(self.n)), np.zeros(len(out), dtype=np.uint8)

    def _one_by_one(self, seeds: tuple[np.ndarray, np.ndarray], target: np.ndarray, s_pass: bool) -> tuple[np.ndarray, np.ndarray]:
        """The result of ``induce``, entry by entry. ``low`` holds the minima of common prefixes from the entries ``at`` on."""
        t, run, wanted = self.t.tolist(), self.run.tolist(), target.tolist()
        seed_pos, seed_lcp, s = seeds[0].tolist(), seeds[1].tolist(), 0
        queue: list[list[int]] = [[] for _ in range(self.k)]
        shared: list[list[int]] = [[] for _ in range(self.k)]
        last = [0] * self.k  # entry that last induced one of this symbol
        out_pos: list[int] = []
        out_lcp: list[int] = []
        at, low, now = [], [], 0
        if s_pass:
            queue[t[-1]].append(self.n - 1)
            shared[t[-1]].append(0)
        for c in range(self.k - 1, -1, -1) if s_pass else range(self.k):
            own, own_lcp, i = queue[c], shared[c], 0
            while True:
                if i < len(own):  # grows by suffixes that start earlier in the same run
                    p, v = own[i], own_lcp[i] if i else 0
                    i += 1
                elif s < len(seed_pos) and t[seed_pos[s]] == c:
                    p = seed_pos[s]
                    if i <= len(own):  # the first seed against the last entry: they share the shorter run
                        v = min(run[own[-1]], run[p]) if own else 0
                        i = len(own) + 1
                    else:
                        v = seed_lcp[s]
                    s += 1
                else:
                    break
                now += 1
                while low and low[-1] >= v:
                    low.pop()
                    at.pop()
                low.append(v)
                at.append(now)
                if p and wanted[p - 1]:
                    d = t[p - 1]
                    shared[d].append(min(low[bisect_right(at, last[d])] + 1, 255) if queue[d] else 0)
                    queue[d].append(p - 1)
                    last[d] = now
            if own:
                own_lcp[0] = 0
                out_pos += own
                out_lcp += own_lcp
        return np.array(out_pos, dtype=places(self.n)), np.array(out_lcp, dtype=np.uint8)

    def _runs(self, sym: np.ndarray, pos: np.ndarray, lcp: np.ndarray, target: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Adds the suffixes that start earlier in the same runs of equal symbols, one round for each place."""
        t, parts, turn = self.t, [(sym, pos, lcp)], 1
        while True:
            before = np.maximum(pos - 1, 0)
            own = np.flatnonzero((pos > 0) & (t[before] == sym) & target[before])
            if not len(own):
                break
            # Entries own[k-1]+1 .. own[k] are consecutive ranges, so one pass gives their minima.
            low = np.minimum.reduceat(lcp[: own[-1] + 1], np.append(0, own[:-1] + 1))
            sym, pos = sym[own], before[own]
            lcp = np.minimum(low.astype(np.int64) + 1, 255).astype(np.uint8)
            lcp[starts(sym)] = min(turn, 255)
            parts.append((sym, pos, lcp))
            turn += 1
        if len(parts) == 1:
            return parts[0]
        sym, pos, lcp = (np.concatenate(x) for x in zip(*parts, strict=True))
        order = np.argsort(sym, kind="stable")
        return sym[order], pos[order], lcp[order]

    def _joined(self, sym, pos, lcp, e_sym, e_pos, e_lcp, down: bool):
        """Queue entries and seeds of a batch in order: by symbol, entries first."""
        if not len(sym):
            e_lcp[starts(e_sym)] = 0
            return e_sym, e_pos, e_lcp
        if len(e_sym):
            # The first seed of a symbol against the last entry of it: they share the shorter run.
            first = starts(e_sym)
            key, want = (-sym, -e_sym[first]) if down else (sym, e_sym[first])
            last = np.searchsorted(key, want, side="right") - 1
            met = (last >= 0) & (sym[np.maximum(last, 0)] == e_sym[first])
            e_lcp[first] = np.where(met, np.minimum(self.run[pos[last]], self.run[e_pos[first]]), 0)
        all_sym, all_pos, all_lcp = np.concatenate([sym, e_sym]), np.concatenate([pos, e_pos]), np.concatenate([lcp, e_lcp])
        order = np.argsort(-all_sym if down else all_sym, kind="stable")
        return all_sym[order], all_pos[order], all_lcp[order]

    def _spread(self, queue: SymbolQueue, sym: np.ndarray, pos: np.ndarray, lcp: np.ndarray, target: np.ndarray, shares: bool) -> None:
        """Queues the suffixes of the wanted type that precede those of a batch, with other symbols."""
        before = np.maximum(pos - 1, 0)
        to = self.t[before]
        own = np.flatnonzero((pos > 0) & (to != sym) & target[before])
        if not len(own):
            return
        to = to[own].astype(np.int64)
        order = np.argsort(to, kind="stable")
        own, to = own[order], to[order]
        low = np.ones(len(own), dtype=np.uint8)
        near = np.flatnonzero(to[1:] == to[:-1]) + 1 if shares else ()
        if len(near):
            m = range_min(lcp, own[near - 1] + 1, own[near])
            low[near] = np.minimum(m.astype(np.int64) + 1, 255)
        queue.push(to, before[own], low)

    def rough(self, star: np.ndarray) -> np.ndarray:
        """S* positions in order of their substrings, from S* positions in order of their symbols."""
        none = np.zeros(len(star), dtype=np.uint8)
        l_pos, l_lcp = self.induce((star, none), False, False)
        s_pos, _ = self.induce((l_pos[::-1], l_lcp), True, False)
        is_star = np.zeros(self.n, dtype=bool)
        is_star[star] = True
        s_pos = s_pos[::-1]
        return s_pos[is_star[s_pos]]

    def sort(self, star: np.ndarray, star_lcp: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(suffix array, common prefixes with the one before) from sorted S* suffixes."""
        l_pos, l_lcp = self.induce((star, star_lcp), False)
        s_pos, s_lcp = self.induce((l_pos[::-1], np.append(l_lcp[1:], np.zeros(min(1, len(l_lcp)), dtype=np.uint8))[::-1]), True)
        s_pos, s_lcp = s_pos[::-1], np.append(s_lcp[1:], np.zeros(1, dtype=np.uint8))[::-1]
        # Both are in order of their symbols: L suffixes of a symbol come before its S suffixes.
        l_sizes, s_sizes = (np.bincount(self.t[x], minlength=self.k) for x in (l_pos, s_pos))
        both = np.stack([l_sizes, s_sizes], axis=1).ravel()
        first = np.cumsum(both) - both
        pos, lcp = np.asarray(scratch(self.n, places(self.n))), np.asarray(scratch(self.n, np.uint8))
        for part, part_lcp, start, sizes in ((l_pos, l_lcp, first[::2], l_sizes), (s_pos, s_lcp, first[1::2], s_sizes)):
            at = spans(start, sizes)
            pos[at], lcp[at] = part, part_lcp
        edge = first[1::2][(l_sizes > 0) & (s_sizes > 0)]
        lcp[edge] = np.minimum(self.run[pos[edge]], self.run[pos[edge - 1]])
        lcp[first[::2][l_sizes + s_sizes > 0]] = 0
        return pos, lcp


def prefix(t: np.ndarray, a: np.ndarray, b: np.ndarray, start: np.ndarray, cap: int) -> np.ndarray:
    """Common prefixes, up to ``cap``, of the suffixes at a and b that agree in their first ``start`` symbols."""
    out, live = np.minimum(start, cap), np.arange(len(a))
    while len(live):
        x, y = a[live] + out[live], b[live] + out[live]
        on = (out[live] < cap) & (np.maximum(x, y) < len(t))
        on[on] = t[x[on]] == t[y[on]]
        live = live[on]
        out[live] += 1
    return out


def suffix_array(t: np.ndarray, cap: int = 64) -> tuple[np.ndarray, np.ndarray]:
    """(suffix array, common prefixes capped at ``cap``) of ``t``, whose last symbol must be its only least one."""
    if len(t) == 1:
        return np.zeros(1, dtype=np.int32), np.zeros(1, dtype=np.uint8)
    text = Text(t)
    star = text.star
    # Induction from S* positions in any order within their symbols sorts the S* substrings.
    some = star[np.argsort(t[star], kind="stable")].astype(places(len(t)))
    rough = text.rough(some)
    names, kinds = _names(t, star, rough)
    if kinds == len(star):
        order, shared = np.argsort(names), np.zeros(len(star), dtype=np.int64)
        star_sa = star[order]
    else:
        order, shared = suffix_array(names, 255)
        star_sa, shared = star[order], shared.astype(np.int64)
    # Names that agree cover known lengths; from there on symbols are compared.
    a, b = order[:-1].astype(np.int64), order[1:].astype(np.int64)
    same = shared[1:]
    known = np.minimum(star[np.minimum(a + same, len(star) - 1)] - star[a], cap)
    lcp = np.zeros(len(star), dtype=np.uint8)
    lcp[1:] = prefix(t, star_sa[:-1].astype(np.int64), star_sa[1:].astype(np.int64), known, cap)
    pos, lcp = text.sort(star_sa.astype(places(len(t))), lcp)
    return pos, np.minimum(lcp, cap)


def _names(t: np.ndarray, star: np.ndarray, rough: np.ndarray) -> tuple[np.ndarray, int]:
    """Ranks of the S* substrings in text order, and how many differ. ``rough``: S* positions by substring."""
    end = np.empty(len(star), dtype=np.int64)
    end[:-1], end[-1] = star[1:], len(t) - 1
    which = np.searchsorted(star, rough)
    size = end[which] - rough + 1
    a, b = rough[:-1].astype(np.int64), rough[1:].astype(np.int64)
    new = size[:-1] != size[1:]
    live, k = np.flatnonzero(~new), 0
    while len(live):  # equal lengths: compare symbol by symbol
        differ = t[a[live] + k] != t[b[live] + k]
        new[live[differ]] = True
        k += 1
        live = live[~differ & (size[live] > k)]
    rank = np.concatenate(([0], np.cumsum(new)))
    names = np.empty(len(star), dtype=np.int32)
    names[which] = rank
    return names, int(rank[-1]) + 1


def classes(segments: list[bytes], length: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Strings of ``length`` bytes that occur more than once in ``segments``: (class, segment, offset), class by class."""
    n = len(segments)
    sizes = np.fromiter(map(len, segments), dtype=np.int64, count=n)
    raw = np.frombuffer(b"\0".join([*segments, b""]), dtype=np.uint8)
    t = raw.astype(np.int32) + n
    ends = np.cumsum(sizes + 1) - 1
    t[ends] = np.arange(n - 1, -1, -1)  # each end its own symbol, the last one least
    used = np.zeros(n + 256, dtype=bool)
    used[t] = True
    t = (np.cumsum(used) - 1).astype(np.int32)[t]
    pos, lcp = suffix_array(t, length)
    joined = lcp >= length
    start = np.flatnonzero(~joined)
    count = np.diff(np.append(start, len(pos)))
    many = count > 1
    group = np.repeat(np.arange(int(many.sum())), count[many])
    p = pos[np.repeat(many, count)].astype(np.int64)
    seg = np.repeat(np.arange(n), sizes + 1)[p]
    return group, seg, p - (ends[seg] - sizes[seg])


def spans(start: np.ndarray, length: np.ndarray) -> np.ndarray:
    """start[0], start[0] + 1, ... for length[0] numbers, then the same for the next pair."""
    end = np.cumsum(length)
    return np.arange(end[-1] if len(end) else 0) + np.repeat(start - (end - length), length)
