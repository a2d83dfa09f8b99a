"""Removal of byte strings of a fixed length that occur in an earlier document, by sorting suffixes.

Equal strings of ``length`` bytes must meet in one shard, whatever their documents. Each such window is assigned to an
anchor, the least hashed gram inside it, so equal windows have equal anchors; windows in a row with the same anchor form
a run. The steps, all over whole texts:

1. Anchors of all documents are dealt by hash; those that occur in two documents or more are returned to the group of
   documents (dealt by a hash of id and text, sized by bytes) that asked.
2. Each group sends its runs with such anchors, each different run once, to the anchor's shard.
3. Each shard builds the suffix array of its runs with common prefixes by external induced sorting (``induced``) and
   finds the smallest document of each class of equal windows. A run that is the only one of its anchor, or that shares
   no longer gram around it with another, is not sorted: none of its windows is in another run. The smallest ids return
   to the groups.
4. Each group marks the windows that a smaller document has too, and writes what is left.

A passage that a third of all documents share costs a shard one entry for each group, not for each document. Runs at its
edges differ in every document, so an anchor with many runs is hot: its runs are cut into windows, which are dealt to
shards by a hash of their own bytes. Equal windows still meet, and no anchor fills a shard. Every step streams; groups
and shards are sized by bytes, so none grows with the corpus. The texts are shuffled twice. Between groups and shards a
run goes by a 64-bit hash of its bytes, their number and its anchor, and 32 more bits of the anchor. Two runs of one anchor
are told apart by 64 bits, then; they are only ever compared inside a group or a shard of some megabytes, about 10^5 runs, so
the odds that a shard confuses two are about 3 in 10^10. A group holds the rows of one hash of id and text together.

Null texts are empty; texts shorter than ``length`` stay whole; a null id counts as larger than any other (as does
2^63 - 1, which stands for it); rows of equal id don't remove from each other; a document does not remove from itself;
an empty table gives no rows. Carried columns keep their names, save those that the result has itself: these get
``input_`` before them.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from . import induced
from .common import apart, bounded_batches, named, stored, trim

LENGTH, GRAM = 50, 24
#: Bytes of text that are hashed at once, and in a shard or bucket.
CHUNK, SHARD = 1 << 20, 8 << 20
LAST = (1 << 63) - 1
#: Windows ``a`` to ``b`` of the run (key, mark) have a least document ``low``.
RECORD = np.dtype([("key", "<u8"), ("mark", "<u4"), ("a", "<u2"), ("b", "<u2"), ("low", "<i8")])

_MULT = np.uint64(0xD6E8FEB86659FD93)


def _powers(n: int, base: int) -> np.ndarray:
    out = np.full(n, base, dtype=np.uint64)
    out[0] = 1
    return np.multiply.accumulate(out)


_POW = _powers(2 * CHUNK + 1, int(_MULT))
_INV = _powers(2 * CHUNK + 1, pow(int(_MULT), -1, 1 << 64))


def _mixed(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(31))) * np.uint64(0x9FB21C651E98DF25)
    return h ^ (h >> np.uint64(28))


class Runs:
    """Runs of windows with one anchor each, of documents laid end to end in ``raw``.

    ``first`` and ``last`` window, ``anchor`` hash, ``mark`` (some of its bits) and ``key`` (a hash of the run's anchor,
    bytes and their number). Runs with an anchor of ``hot`` (sorted) are cut into windows and marked in ``split``.
    """

    def __init__(self, raw: np.ndarray, ends: np.ndarray, length: int = LENGTH, hot: np.ndarray | None = None):
        self.raw, self.length, self.split = raw, length, np.zeros(0, dtype=bool)
        gram = min(GRAM, length // 2)
        n, grams = len(raw), length - gram + 1
        z = np.zeros(0, dtype=np.int64)
        self.first, self.last, self.anchor, self.key, self.mark = z, z, z.astype(np.uint64), z.astype(np.uint64), z.astype(np.uint32)
        if n < length:
            return
        total = np.concatenate((np.zeros(1, dtype=np.uint64), np.cumsum((raw + np.uint64(1)) * _POW[:n], dtype=np.uint64)))
        h = _mixed((total[gram:] - total[:-gram]) * _INV[: n - gram + 1])
        # The place breaks ties, so that each window has one anchor, its leftmost.
        place = np.uint64((1 << 22) - 1)
        low, width = (h & ~place) | np.arange(len(h), dtype=np.uint64), 1
        while 2 * width <= grams:
            low = np.minimum(low[:-width], low[width:])
            width *= 2
        m = n - length + 1
        owner = (np.minimum(low[:m], low[grams - width : grams - width + m]) & place).astype(np.int64)
        for e in ends[:-1].tolist():  # windows over the end of a document
            owner[max(0, e - length + 1) : e] = -1
        start = np.flatnonzero(np.concatenate(([True], owner[1:] != owner[:-1])))
        last = np.append(start[1:], m) - 1
        own = owner[start] >= 0
        self.first, self.last = start[own], last[own]
        self.anchor = h[owner[self.first]]
        self.split = np.zeros(len(self.first), dtype=bool)
        if hot is not None and len(hot):
            self.split = _among(self.anchor & _LOW48, hot)
            count = np.where(self.split, self.last - self.first + 1, 1)
            run = np.repeat(np.arange(len(count)), count)
            self.first = induced.spans(self.first, count)
            self.split = self.split[run]
            self.last, self.anchor = np.where(self.split, self.first, self.last[run]), self.anchor[run]
        stop = self.last + length
        body = _mixed((total[stop] - total[self.first]) * _INV[self.first])
        self.key = _mixed(body ^ (self.anchor * _MULT) ^ (stop - self.first).astype(np.uint64))
        self.mark = (self.anchor >> np.uint64(32)).astype(np.uint32)


def pieces(texts: list[bytes], length: int = LENGTH) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """(bytes, end of each piece, its row, its offset in the row): texts laid together, long ones in overlapping pieces."""
    parts: list[bytes] = []
    rows: list[int] = []
    offsets: list[int] = []
    size = 0

    def out():
        return np.frombuffer(b"".join(parts), dtype=np.uint8), np.cumsum(list(map(len, parts))), np.array(rows), np.array(offsets)

    for row, text in enumerate(texts):
        for at in range(0, max(1, len(text) - length + 1), CHUNK - length):
            part = text[at : at + CHUNK - 1]
            if size and size + len(part) > CHUNK:
                yield out()
                parts, rows, offsets, size = [], [], [], 0
            parts.append(part)
            rows.append(row)
            offsets.append(at)
            size += len(part)
    if parts:
        yield out()


def _six(x: np.ndarray) -> bytes:
    """The low 48 bits of each number."""
    return np.ascontiguousarray(x.astype("<u8").view(np.uint8).reshape(-1, 8)[:, :6]).tobytes()


def _wide(b: bytes) -> np.ndarray:
    out = np.zeros((len(b) // 6, 8), dtype=np.uint8)
    out[:, :6] = np.frombuffer(b, dtype=np.uint8).reshape(-1, 6)
    return out.view("<u8").ravel()


_LOW48 = np.uint64((1 << 48) - 1)


def _among(x: np.ndarray, known: np.ndarray) -> np.ndarray:
    """Which of ``x`` are in ``known``, which is sorted and not empty."""
    return known[np.minimum(np.searchsorted(known, x), len(known) - 1)] == x


def _cuts(x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """First and after-last places of the runs of equal values."""
    edge = np.flatnonzero(x[1:] != x[:-1]) + 1
    return (np.concatenate(([0], edge)), np.append(edge, len(x))) if len(x) else (edge, edge)


def _batch(names: list[str], types: list[pa.DataType], cols: list[list]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, type=t) for c, t in zip(cols, types, strict=True)], names=names)


def _gathered(flat: np.ndarray, start: np.ndarray, size: np.ndarray, rows: int = 32_768) -> np.ndarray:
    """flat[start[k] : start[k] + size[k]] one after the other, some rows at a time."""
    out, at = np.empty(int(size.sum()), dtype=flat.dtype), 0
    for k in range(0, len(start), rows):
        part = flat[induced.spans(start[k : k + rows], size[k : k + rows])]
        out[at : at + len(part)] = part
        at += len(part)
    return out


class Held:
    """Different runs of a group, each with the least and the largest document that has it."""

    NAMES = ("key", "mark", "to", "low", "high", "size")

    def __init__(self):
        self.columns: list[tuple[np.ndarray, ...]] = []
        self.bodies: list[np.ndarray] = []
        self.bytes = 0

    def add(self, columns: tuple[np.ndarray, ...], body: np.ndarray) -> None:
        self.columns.append(columns)
        self.bodies.append(body)
        self.bytes += len(body) + 40 * len(columns[0])

    def merge(self) -> None:
        """Equal runs become one."""
        key, mark, to, low, high, size = (np.concatenate(c) for c in zip(*self.columns, strict=True))
        body = np.concatenate(self.bodies)
        order = np.lexsort((mark, key))
        k, m = key[order], mark[order]
        new = np.flatnonzero(np.concatenate(([True], (k[1:] != k[:-1]) | (m[1:] != m[:-1]))))
        pick = order[new]
        at = np.cumsum(size) - size
        low, high = np.minimum.reduceat(low[order], new), np.maximum.reduceat(high[order], new)
        self.columns, self.bodies, self.bytes = [], [], 0
        self.add((key[pick], mark[pick], to[pick], low, high, size[pick]), _gathered(body, at[pick], size[pick]))

    def taken(self, shards: int) -> tuple[np.ndarray, list[list[bytes]]]:
        """Shards, and for each the packed columns and bytes of its runs; nothing is held afterwards."""
        self.merge()
        key, mark, to, low, high, size = self.columns[0]
        shard = (to % np.uint64(shards)).astype(np.int64)
        order = np.argsort(shard, kind="stable")
        at = np.cumsum(size) - size
        body = _gathered(self.bodies[0], at[order], size[order])
        ends = np.concatenate(([0], np.cumsum(size[order])))
        cut, stop = _cuts(shard[order])
        cols = [[x[order[a:b]].astype(t).tobytes() for a, b in zip(cut.tolist(), stop.tolist(), strict=True)] for x, t in ((key, "<u8"), (mark, "<u4"), (to, "<u8"), (low, "<i8"), (high, "<i8"), (size, "<u2"))]
        cols.append([body[ends[a] : ends[b]].tobytes() for a, b in zip(cut.tolist(), stop.tolist(), strict=True)])
        self.columns, self.bodies, self.bytes = [], [], 0
        return shard[order[cut]], cols


def _raw(column: pa.Array) -> list[bytes]:
    return [b or b"" for b in column.cast(pa.binary()).to_pylist()]


def _ask_anchors(docs: DataFrame, buckets: int, length: int, group_type: str = "<u4") -> DataFrame:
    """(bucket, anchors, groups, many, runs): which anchors each group has, whether in two documents at least, and in how
    many runs (65,535 stands for more)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            group = batch.column(0).to_numpy()
            found, owners = [], []
            for raw, ends, rows, _ in pieces(_raw(batch.column(2)), length):
                r = Runs(raw, ends, length)
                row = rows[np.searchsorted(ends, r.first, side="right")]
                found.append(r.anchor & _LOW48)
                owners.append(row)
            if not found:
                continue
            a, row = np.concatenate(found), np.concatenate(owners)
            order = np.lexsort((row, a))
            a, row = a[order], row[order]
            first = np.concatenate((np.ones(min(1, len(a)), dtype=bool), (a[1:] != a[:-1]) | (row[1:] != row[:-1])))
            runs = np.diff(np.append(np.flatnonzero(first), len(a)))
            a, g = a[first], group[row[first]]  # one for each document
            order = np.lexsort((g, a))
            a, g, runs = a[order], g[order], runs[order]
            start = np.flatnonzero(np.concatenate((np.ones(min(1, len(a)), dtype=bool), (a[1:] != a[:-1]) | (g[1:] != g[:-1]))))
            many = np.diff(np.append(start, len(a))) > 1  # in two documents of the group
            runs = np.minimum(np.add.reduceat(runs, start), 65_535) if len(start) else runs
            a, g = a[start], g[start]
            b = (a % np.uint64(buckets)).astype(np.int64)
            order = np.argsort(b, kind="stable")
            a, g, many, runs, b = a[order], g[order], many[order], runs[order], b[order]
            cut, stop = _cuts(b)
            cols = [[], [], [], [], []]
            for x, y in zip(cut.tolist(), stop.tolist(), strict=True):
                for c, v in zip(cols, (int(b[x]), _six(a[x:y]), g[x:y].astype(group_type).tobytes(), np.packbits(many[x:y]).tobytes(), runs[x:y].astype("<u2").tobytes()), strict=True):
                    c.append(v)
            yield _batch(["bucket", "anchors", "groups", "many", "runs"], [pa.int32(), *[pa.binary()] * 4], cols)

    return docs.select("grp", "doc_id", "text").mapInArrow(run, "bucket int, anchors binary, groups binary, many binary, runs binary")


def _shared_anchors(asked: DataFrame, most: int, group_type: str = "<u4") -> DataFrame:
    """(grp, body): for each group, anchors of its documents that two documents at least have. A body begins with 1 if
    its anchors are hot, which have more than ``most`` runs in all groups, else with 0."""

    def run(table: pa.Table) -> pa.Table:
        a, g, many, runs = [], [], [], []
        for x, y, z, r in zip(*(table.column(c).to_pylist() for c in ("anchors", "groups", "many", "runs")), strict=True):
            runs.append(np.frombuffer(r, dtype="<u2"))
            a.append(_wide(x))
            g.append(np.frombuffer(y, dtype=group_type))
            many.append(np.unpackbits(np.frombuffer(z, dtype=np.uint8))[: len(a[-1])])
        a, g, many, runs = np.concatenate(a), np.concatenate(g), np.concatenate(many).astype(bool), np.concatenate(runs).astype(np.int64)
        order = np.argsort(a, kind="stable")
        a, g, many, runs = a[order], g[order], many[order], runs[order]
        start, stop = _cuts(a)
        count = stop - start
        if not len(a):
            return pa.table({"grp": pa.array([], pa.int32()), "body": pa.array([], pa.binary())})
        shared = np.repeat((count > 1) | np.logical_or.reduceat(many, start), count)
        hot = np.repeat(np.add.reduceat(runs, start) > most, count)[shared]
        a, g = a[shared], 2 * g[shared].astype(np.int64) + hot
        order = np.argsort(g, kind="stable")
        a, g = a[order], g[order]
        cut, stop = _cuts(g)
        return pa.table({"grp": pa.array((g[cut] >> 1).astype(np.int32)), "body": pa.array([bytes([g[x] & 1]) + _six(np.unique(a[x:y])) for x, y in zip(cut.tolist(), stop.tolist(), strict=True)], pa.binary())})

    return asked.groupBy("bucket").applyInArrow(run, "grp int, body binary")


def _beside(docs: DataFrame, replies: DataFrame, carry: tuple[str, ...] = ()) -> DataFrame:
    """Per group, first the reply rows (kind 0, ``body``), then its documents: sorted, so that a task can stream both."""
    d = docs.select("grp", F.lit(1).alias("kind"), "doc_id", F.encode("text", "UTF-8").alias("body"), *carry)
    r = replies.select("grp", F.lit(0).alias("kind"), F.lit(None).cast("long").alias("doc_id"), "body", *(F.lit(None).cast(docs.schema[c].dataType).alias(c) for c in carry))
    return r.unionAll(d).repartition("grp").sortWithinPartitions("grp", "kind")


def _by_group(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[int, list[bytes], np.ndarray | None, list[bytes], list[pa.Array]]]:
    """(group, new reply bodies, ids of documents or None, texts, further columns) in order of arrival."""
    for batch in batches:
        grp, kind = batch.column(0).to_numpy(), batch.column(1).to_numpy()
        ids, body = batch.column(2), batch.column(3)
        for x, y in zip(*(c.tolist() for c in _cuts(2 * grp + kind)), strict=True):
            part = [b or b"" for b in body.slice(x, y - x).to_pylist()]
            if kind[x]:
                yield int(grp[x]), [], ids.slice(x, y - x).to_numpy(), part, [c.slice(x, y - x) for c in batch.columns[4:]]
            else:
                yield int(grp[x]), part, None, [], []


def _ask_runs(docs: DataFrame, replies: DataFrame, shards: int, length: int, most: int = 32 << 20) -> DataFrame:
    """(shard, grp, key, mark, anchor, low, high, size, body): the different runs of each group with shared anchors."""
    schema = "shard int, grp int, key binary, mark binary, anchor binary, low binary, high binary, size binary, body binary"
    names = [f.split()[0] for f in schema.split(", ")]
    types = [pa.int32(), pa.int32(), *[pa.binary()] * 7]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        group, bodies, shared, hot = None, [], np.zeros(0, dtype=np.uint64), np.zeros(0, dtype=np.uint64)
        held = Held()

        def flush() -> pa.RecordBatch:
            shard, cols = held.taken(shards)
            return _batch(names, types, [shard.tolist(), [group] * len(shard), *cols])

        for g, new, ids, texts, _ in _by_group(batches):
            if g != group:
                if held.bytes:
                    yield flush()
                group, bodies, shared, hot = g, [], np.zeros(0, dtype=np.uint64), np.zeros(0, dtype=np.uint64)
            bodies += new
            if bodies and ids is not None:
                hot = np.unique(np.concatenate([hot, *(_wide(b[1:]) for b in bodies if b[0])]))
                shared, bodies = np.unique(np.concatenate([shared, *(_wide(b[1:]) for b in bodies)])), []
            if ids is None or not len(shared):
                continue
            for raw, ends, rows, _ in pieces(texts, length):
                r = Runs(raw, ends, length, hot)
                hit = np.flatnonzero(_among(r.anchor & _LOW48, shared))
                if not len(hit):
                    continue
                # Windows of hot anchors are dealt by their own key.
                to = np.where(r.split, r.key, r.anchor)[hit] & _LOW48
                doc = ids[rows[np.searchsorted(ends, r.first[hit], side="right")]]
                size = r.last[hit] - r.first[hit] + length
                held.add((r.key[hit], r.mark[hit], to, doc, doc, size), _gathered(raw, r.first[hit], size))
                if held.bytes > most:
                    held.merge()
                    if held.bytes > most // 2:
                        yield flush()
        if held.bytes:
            yield flush()
        trim()

    return _beside(docs, replies).mapInArrow(run, schema)


def _alike(runs: list[bytes], anchors: np.ndarray, length: int, parts: int = 3) -> np.ndarray:
    """Which runs may share a window with another one. ``anchors``: the low 48 bits of each one's anchor.

    Equal windows hold the anchor at the same place, so they reach equally far to its left, and to its right for the rest
    of ``length``. Of ``parts`` ranges of how far they reach left, one is theirs, and both runs hold all bytes that any
    window in it has. Runs in which the anchor isn't found, as windows dealt by their own key, may share any.
    """
    gram = min(GRAM, length // 2)
    more = length - gram
    cuts = [k * (more + 1) // parts for k in range(parts + 1)]
    sizes = np.fromiter(map(len, runs), dtype=np.int64, count=len(runs))
    out = np.ones(len(runs), dtype=bool)
    if not runs:
        return out
    keys: list[list[np.ndarray]] = [[] for _ in range(parts)]
    owners: list[list[np.ndarray]] = [[] for _ in range(parts)]
    bounds = np.flatnonzero(np.diff(np.cumsum(sizes) // (CHUNK // 4), prepend=-1)).tolist()
    for x, y in zip(bounds, [*bounds[1:], len(runs)], strict=True):
        raw, ends = np.frombuffer(b"".join(runs[x:y]), dtype=np.uint8), np.cumsum(sizes[x:y])
        total = np.concatenate((np.zeros(1, dtype=np.uint64), np.cumsum((raw + np.uint64(1)) * _POW[: len(raw)], dtype=np.uint64)))
        h = _mixed((total[gram:] - total[:-gram]) * _INV[: len(raw) - gram + 1])
        place = np.flatnonzero((h & _LOW48) == np.repeat(anchors[x:y], sizes[x:y])[: len(h)])
        run = np.searchsorted(ends, place, side="right")
        own = place + gram <= ends[run]
        run, first = np.unique(run[own], return_index=True)
        place = place[own][first]
        out[x + run] = False
        for k in range(parts):
            begin, end = place - cuts[k], place + gram + more + 1 - cuts[k + 1]
            held = (begin >= ends[run] - sizes[x + run]) & (end <= ends[run])
            begin, end = begin[held], end[held]
            keys[k].append(_mixed((total[end] - total[begin]) * _INV[begin]))
            owners[k].append(x + run[held])
    for k in range(parts):
        key, owner = np.concatenate(keys[k]), np.concatenate(owners[k])
        order = np.argsort(key)
        equal = np.flatnonzero(key[order[1:]] == key[order[:-1]])
        out[owner[order[equal]]] = out[owner[order[equal + 1]]] = True
    return out


def _first_documents(asked: DataFrame, length: int) -> DataFrame:
    """(grp, body): for each group, records (key, first window, last window, smallest id) of windows that a smaller
    document than one of its own has."""

    def run(table: pa.Table) -> pa.Table:
        cols = {c: table.column(c).to_pylist() for c in ("grp", "key", "mark", "anchor", "low", "high", "size", "body")}
        cat = lambda c, t: np.concatenate([np.frombuffer(x, dtype=t) for x in cols[c]])
        key, mark, anchor, low, high, size = cat("key", "<u8"), cat("mark", "<u4"), cat("anchor", "<u8"), cat("low", "<i8"), cat("high", "<i8"), cat("size", "<u2").astype(np.int64)
        grp = np.repeat(np.array(cols["grp"]), [len(x) // 8 for x in cols["key"]])
        body = b"".join(cols["body"])
        at = np.cumsum(size) - size
        # The same run from several groups counts once, with the least id of all.
        order = np.lexsort((mark, key, anchor))
        k, m, n = key[order], mark[order], anchor[order]
        new = np.concatenate(([True], (k[1:] != k[:-1]) | (m[1:] != m[:-1]) | (n[1:] != n[:-1])))
        run_of = np.empty(len(key), dtype=np.int64)
        run_of[order] = np.cumsum(new) - 1
        pick = order[new]
        least = np.minimum.reduceat(low[order], np.flatnonzero(new))
        # Runs that share no window with another are left alone; the rest are sorted as suffixes.
        kinds = anchor[pick]
        start, stop = _cuts(kinds)
        alone = np.repeat(stop - start == 1, stop - start)
        some = np.flatnonzero(~alone)
        alone[some] = ~_alike([body[at[k] : at[k] + size[k]] for k in pick[some].tolist()], kinds[some], length)
        windows = size[pick] - length + 1
        offset = np.cumsum(windows) - windows
        first = np.repeat(least, windows)
        sorted_ = np.flatnonzero(~alone)
        if len(sorted_):
            trim()
            cls, seg, off = induced.classes([body[at[k] : at[k] + size[k]] for k in pick[sorted_].tolist()], length)
            if len(cls):
                place = offset[sorted_[seg]] + off
                lead = np.flatnonzero(np.concatenate(([True], cls[1:] != cls[:-1])))
                first[place] = np.minimum.reduceat(first[place], lead)[cls]
        # Windows in a row with the same smallest id, as one record.
        edge = np.zeros(len(first), dtype=bool)
        edge[offset] = True
        edge[1:] |= first[1:] != first[:-1]
        begin = np.flatnonzero(edge)
        owner = np.searchsorted(offset, begin, side="right") - 1
        rec = np.zeros(len(begin), dtype=RECORD)
        rec["key"], rec["mark"], rec["low"] = key[pick[owner]], mark[pick[owner]], first[begin]
        rec["a"], rec["b"] = begin - offset[owner], np.append(begin[1:], len(first)) - 1 - offset[owner]
        count = np.bincount(owner, minlength=len(pick))
        rec_at = np.cumsum(count) - count
        # Each asking group gets the records of its runs that matter to it.
        n = count[run_of]
        which = induced.spans(rec_at[run_of], n)
        to, top = np.repeat(grp, n), np.repeat(high, n)
        use = rec["low"][which] < top
        which, to = which[use], to[use]
        order = np.argsort(to, kind="stable")
        which, to = which[order], to[order]
        cut, stop = _cuts(to)
        return pa.table({"grp": pa.array(to[cut].astype(np.int32)), "body": pa.array([b"\0" + rec[which[x:y]].tobytes() for x, y in zip(cut.tolist(), stop.tolist(), strict=True)], pa.binary())})

    return asked.groupBy("shard").applyInArrow(run, "grp int, body binary")


def _removed(docs: DataFrame, replies: DataFrame, length: int, with_kept: bool, carry: tuple[str, ...]) -> DataFrame:
    schema = StructType.fromDDL("doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string" + ", kept_text string" * with_kept)
    names, types = schema.names, [*[pa.int64()] * 4, *[pa.string()] * (1 + with_kept)]
    schema = StructType([*schema.fields, *(docs.schema[c] for c in carry)])

    def marks(texts: list[bytes], ids: np.ndarray, known: np.ndarray, hot: np.ndarray) -> list[np.ndarray | None]:
        """Per text, how many runs of removed windows begin less end at each byte."""
        out: list[np.ndarray | None] = [None] * len(texts)
        for raw, ends, rows, offsets in pieces(texts, length) if len(known) else ():
            r = Runs(raw, ends, length, hot)
            lo, hi = np.searchsorted(known["key"], r.key), np.searchsorted(known["key"], r.key, side="right")
            hit = np.flatnonzero(hi > lo)
            n = (hi - lo)[hit]
            rec = known[induced.spans(lo[hit], n)]
            first, piece = np.repeat(r.first[hit], n), np.repeat(np.searchsorted(ends, r.first[hit], side="right"), n)
            row = rows[piece]
            use = (rec["mark"] == np.repeat(r.mark[hit], n)) & (rec["low"] < ids[row])
            first, piece, row, rec = first[use], piece[use], row[use], rec[use]
            a = first + rec["a"] - (np.concatenate(([0], ends[:-1])) - offsets)[piece]
            b = a + (rec["b"].astype(np.int64) - rec["a"]) + length
            for x, y in zip(*(c.tolist() for c in _cuts(row)), strict=True):  # runs come in order of rows
                k = int(row[x])
                if out[k] is None:
                    out[k] = np.zeros(len(texts[k]) + 1, dtype=np.int32)
                np.add.at(out[k], a[x:y], 1)
                np.add.at(out[k], b[x:y], -1)
        return out

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        group, bodies, known, hot = None, [], np.zeros(0, dtype=RECORD), np.zeros(0, dtype=np.uint64)
        for g, new, ids, texts, more in _by_group(batches):
            if g != group:
                group, bodies, known, hot = g, [], np.zeros(0, dtype=RECORD), np.zeros(0, dtype=np.uint64)
            bodies += new
            if ids is None:
                continue
            if bodies:
                hot = np.unique(np.concatenate([hot, *(_wide(b[1:]) for b in bodies if b[0])]))
                known = np.concatenate([known, *(np.frombuffer(b, dtype=RECORD, offset=1) for b in bodies if not b[0] and len(b) > 1)])
                known, bodies = known[np.argsort(known["key"], kind="stable")], []
            for at in range(0, len(texts), 64):
                part, own = texts[at : at + 64], ids[at : at + 64]
                cols: list[list] = [[] for _ in names]
                for text, doc, m in zip(part, own.tolist(), marks(part, own, known, hot), strict=True):
                    kept, removed, spans = text, 0, 0
                    if m is not None:
                        gone = np.cumsum(m[:-1]) > 0
                        removed = int(gone.sum())
                        spans = int(gone[0]) + int((gone[1:] & ~gone[:-1]).sum())
                        kept = np.frombuffer(text, dtype=np.uint8)[~gone].tobytes()
                    for c, v in zip(cols, (None if doc == LAST else doc, len(text), removed, spans, hashlib.sha256(kept).hexdigest(), *[kept.decode(errors="ignore")] * with_kept), strict=True):
                        c.append(v)
                made = _batch(names, types, cols)
                yield pa.RecordBatch.from_arrays([*made.columns, *(c.slice(at, 64) for c in more)], names=schema.names)
        trim()

    return _beside(docs, replies, carry).mapInArrow(run, schema)


def remove_repeats(docs: DataFrame, length: int = LENGTH, shard_bytes: int = SHARD, group_bytes: int = 32 << 20, with_kept: bool = False, carry: tuple[str, ...] = ()) -> DataFrame:
    """(doc_id, n_bytes, n_removed, n_spans, kept_sha256) for every row of ``docs`` (doc_id, text).

    ``with_kept`` adds ``kept_text``, without the bytes of characters that were cut in two; ``carry`` names further
    columns to keep.
    """
    bounded_batches(docs.sparkSession)
    kept = {c: f"carried_{k}" for k, c in enumerate(carry)}
    base = docs.select(F.coalesce(F.col("doc_id").cast("long"), F.lit(LAST)).alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"), *(named(c).alias(n) for c, n in kept.items()))
    total, n = base.agg(F.coalesce(F.sum(F.octet_length("text")), F.lit(0)), F.count(F.lit(1))).first()
    # Small inputs are dealt over some groups too. Buckets hold about 0.6 bytes for each byte of text.
    groups = max(1, -(-total // group_bytes), min(n // 8192, 16))
    buckets = max(1, -(-total * 6 // (10 * shard_bytes)))
    grouped = base.withColumn("grp", F.pmod(F.xxhash64("doc_id", "text"), F.lit(groups)).cast("int"))
    kind = "<u2" if groups <= 1 << 16 else "<u4"
    asked = _ask_anchors(grouped, buckets, length, kind)
    shared = stored(_shared_anchors(asked, shard_bytes // 256, kind), "suffix-anchors")
    runs = _ask_runs(grouped, shared, max(1, -(-total // shard_bytes)), length)
    firsts = stored(_first_documents(runs, length), "suffix-firsts")
    hot = shared.where(F.hex(F.substring("body", 1, 1)) == "01")
    out = _removed(grouped, firsts.unionAll(hot), length, with_kept, tuple(kept.values()))
    own = [c for c in out.columns if c not in kept.values()]
    return out.select(*own, *(F.col(n).alias(free) for n, free in zip(kept.values(), apart(carry, own), strict=True)))
