"""Repair of a conversation's structure: the cheapest edits that leave turns ``(s?(ua)+)?``, by a persistent audit DP.

After each row the state is what the repaired roles so far end in: nothing yet, system, user or assistant. Keep, rerole,
delete and insert move between states; a state holds its cheapest cost and, of all audits of that cost, the one that comes
first in ASCII. Audits are never copied: an audit is a node that points to the node before it (``Audits``), so prefixes are
shared. Ties are decided by the longest common prefix of two nodes, found by binary lifting over rolling hashes; the prefix
so found is verified letter by letter, and nodes that proved equal are joined, so a stretch is walked once.

States that another one beats whatever follows are dropped. Once all audits left share a prefix, that prefix is settled: its
edits are given out, its rows are hashed and its nodes are freed. So memory follows the undecided stretch: about 100 bytes
for each node of it, two to four a row, and texts beyond ``HELD`` characters in a scratch file of the task. The stretch is
short as a rule, but ties can leave the first edit open until the last row (roles that all need another one: whether an
insertion comes first depends on their number). A conversation's rows pass through one task in order, as a stream, because
the digest of its text is sequential; repeats are found by Spark in windows that spill.

Rows of a conversation go by turn, null turns first, then role and text. Null ids are one conversation; nulls in role and
text are one space. Repeated rows are duplicates. Other columns are left out. Very long texts are hashed piece by piece as
they arrive. Empty tables give no rows.
"""

from __future__ import annotations

import hashlib
import pickle
import tempfile
from array import array
from collections import deque
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import bounded_batches

#: States: what the repaired roles end in.
EMPTY, SYSTEM, USER, ASSISTANT = range(4)
#: The state that a role's initial leads to, from each state, fixed by the pattern ``(s?(ua)+)?``.
STEPS = {"s": {EMPTY: SYSTEM}, "u": {EMPTY: USER, SYSTEM: USER, ASSISTANT: USER}, "a": {USER: ASSISTANT}}
#: The state after a new user or assistant turn, whichever the pattern asks for.
TURN = {EMPTY: USER, SYSTEM: USER, USER: ASSISTANT, ASSISTANT: USER}
#: (better, worse): how much more a state may cost and still win in the end.
SLACK = {
    (ASSISTANT, EMPTY): 3, (USER, EMPTY): 5, (SYSTEM, EMPTY): 4, (EMPTY, SYSTEM): 2, (ASSISTANT, SYSTEM): 0, (USER, SYSTEM): 2,
    (EMPTY, ASSISTANT): 4, (SYSTEM, ASSISTANT): 4, (USER, ASSISTANT): 2, (EMPTY, USER): 2, (SYSTEM, USER): 2, (ASSISTANT, USER): 2,
}
COST = {"K": 0, "R": 2, "D": 3, "I": 2}
#: Kinds of rows: whether a row must go, and what it costs to let it stay.
FINE, TRUNCATED, BAD = range(3)
#: Rows after which settled prefixes are looked for, and conversations of few rows whose audits are remembered.
SETTLE, SHORT = 256, 64
#: Characters of waiting texts that a conversation holds in memory.
HELD = 1 << 22

MOD, BASE = (1 << 61) - 1, 1_000_003
RESULT = "conv_id {}, gaps bigint, blank bigint, duplicate bigint, truncated bigint, illegal bigint, cost bigint, audit string, repaired_sha256 string"


class Audits:
    """Strings over an alphabet of edits as nodes of a tree; node 0 is the empty string. About 100 bytes a node."""

    def __init__(self, fold: Callable[[int, int], int] | None = None) -> None:
        self.fold = fold or (lambda before, letter: (before * BASE + letter) % MOD)
        # ``ups`` has the ancestors 1, 2, 4, ... letters back of each node, from ``first`` on, up to the empty string.
        self.letter, self.depth, self.hash, self.same = bytearray(1), array("i", [0]), array("q", [1]), array("i", [0])
        self.ups, self.first = array("i"), array("q", [0])

    def add(self, node: int, letter: int) -> int:
        """The node of ``node``'s string and one letter more."""
        depth, at, k = self.depth[node] + 1, node, 0
        self.first.append(len(self.ups))
        self.ups.append(node)
        while self.depth[at] >> k:
            at = self.ups[self.first[at] + k]
            self.ups.append(at)
            k += 1
        self.letter.append(letter)
        self.depth.append(depth)
        self.hash.append(self.fold(self.hash[node], letter))
        self.same.append(len(self.same))
        return len(self.letter) - 1

    def before(self, node: int, k: int = 0) -> int:
        """The node 2^k letters back, or of the empty string."""
        return self.ups[self.first[node] + k] if self.depth[node] >> k else 0

    def ancestor(self, node: int, depth: int) -> int:
        """The node of the first ``depth`` letters."""
        gap, k = self.depth[node] - depth, 0
        while gap:
            if gap & 1:
                node = self.before(node, k)
            gap >>= 1
            k += 1
        return node

    def _root(self, node: int) -> int:
        while self.same[node] != node:
            self.same[node] = node = self.same[self.same[node]]
        return node

    def _first_difference(self, a: int, b: int) -> int:
        """Depth of the last letter in which two nodes of one depth differ, -1 if their strings are equal. Nodes that prove
        equal are joined."""
        walked = []
        while (x := self._root(a)) != (y := self._root(b)):
            if self.letter[a] != self.letter[b]:
                return self.depth[a]
            walked.append((x, y))
            a, b = self.before(a), self.before(b)
        for x, y in walked:
            self.same[self._root(x)] = self._root(y)
        return -1

    def common(self, a: int, b: int) -> int:
        """Letters in the longest common prefix."""
        depth = min(self.depth[a], self.depth[b])
        while True:
            x, y = self.ancestor(a, depth), self.ancestor(b, depth)
            if self.hash[x] != self.hash[y]:
                for k in range(depth.bit_length(), -1, -1):
                    if self.hash[self.before(x, k)] != self.hash[self.before(y, k)]:
                        x, y = self.before(x, k), self.before(y, k)
                x, y = self.before(x), self.before(y)  # the last pair of equal hashes
            # Equal hashes may collide: the letters decide, and the search goes on before the one that differs.
            differs = self._first_difference(x, y)
            if differs < 0:
                return self.depth[x]
            depth = differs - 1

    def less(self, a: int, b: int) -> bool:
        """Whether ``a``'s string comes before ``b``'s."""
        n = self.common(a, b)
        if n == self.depth[a] or n == self.depth[b]:
            return self.depth[a] < self.depth[b]
        return self.letter[self.ancestor(a, n + 1)] < self.letter[self.ancestor(b, n + 1)]

    def text(self, node: int, stop: int = 0) -> str:
        """Letters after the first ``stop``."""
        out = bytearray()
        while self.depth[node] > stop:
            out.append(self.letter[node])
            node = self.before(node)
        return out[::-1].decode()


class Repair:
    """The DP over one conversation's rows, given one by one as (initial, kind)."""

    def __init__(self) -> None:
        self.audits, self.best = Audits(), {EMPTY: (0, 0)}
        self._insert(self.best)

    def _better(self, new: tuple[int, int], old: tuple[int, int] | None) -> bool:
        return old is None or new[0] < old[0] or (new[0] == old[0] and self.audits.less(new[1], old[1]))

    def _offer(self, table: dict, state: int, cost: int, node: int, letter: str) -> None:
        """Puts an audit into ``table`` if it beats what is there; a node is only made for one that costs no more."""
        if state not in table or cost <= table[state][0]:
            new = (cost, self.audits.add(node, ord(letter)))
            if self._better(new, table.get(state)):
                table[state] = new

    def _insert(self, table: dict) -> None:
        """New turns, cheapest states first: an insertion only helps a state that costs more."""
        for state in sorted(table, key=lambda s: table[s][0]):
            for _ in range(2):
                cost, node = table[state]
                self._offer(table, TURN[state], cost + COST["I"], node, "I")
                state = TURN[state]

    def row(self, initial: str, kind: int) -> None:
        out: dict[int, tuple[int, int]] = {}
        for state, (cost, node) in self.best.items():
            self._offer(out, state, cost + COST["D"], node, "D")
            if kind != BAD:
                if (to := STEPS.get(initial, {}).get(state)) is not None:
                    self._offer(out, to, cost + kind, node, "K")
                self._offer(out, TURN[state], cost + COST["R"] + kind, node, "R")
        self._insert(out)
        # A state goes if another one can do whatever it may do yet for less.
        self.best = {s: v for s, v in out.items() if not any((t, s) in SLACK and w[0] + SLACK[t, s] < v[0] for t, w in out.items())}

    def settled(self) -> str:
        """Edits that all audits left share and that weren't given before; their nodes are freed."""
        old, nodes = self.audits, [n for _, n in self.best.values()]
        shared = old.depth[nodes[0]]
        for n in nodes[1:]:
            shared = min(shared, old.common(nodes[0], n))
        out = old.text(old.ancestor(nodes[0], shared))
        self.audits, moved = Audits(old.fold), {}
        for state, (cost, node) in self.best.items():
            chain = []
            while old.depth[node] > shared and node not in moved:
                chain.append(node)
                node = old.before(node)
            at = moved.get(node, 0)
            for node in reversed(chain):
                moved[node] = at = self.audits.add(at, old.letter[node])
            self.best[state] = (cost, at)
        return out

    def end(self) -> tuple[int, str]:
        """Cost and the edits not given yet."""
        ends = [self.best[s] for s in (EMPTY, ASSISTANT) if s in self.best]
        best = ends[0]
        for other in ends[1:]:
            if self._better(other, best):
                best = other
        return best[0], self.audits.text(best[1])


class Waiting:
    """Rows whose edit isn't settled, first in, first out. Beyond ``HELD`` characters they wait in a scratch file of the task."""

    def __init__(self) -> None:
        self.rows, self.held, self.file, self.read, self.left = deque(), 0, None, 0, 0

    def __len__(self) -> int:
        return len(self.rows) + self.left

    def append(self, row: tuple[str, str]) -> None:
        if not self.left and self.held + len(row[1]) <= HELD:
            self.rows.append(row)
            self.held += len(row[1])
            return
        self.file = self.file or tempfile.TemporaryFile()  # noqa: SIM115
        self.file.seek(0, 2)
        pickle.dump(row, self.file)
        self.left += 1

    def pop(self) -> tuple[str, str]:
        if self.rows:
            row = self.rows.popleft()
            self.held -= len(row[1])
            return row
        self.file.seek(self.read)
        row, self.left = pickle.load(self.file), self.left - 1
        self.read = self.file.tell()
        if not self.left:
            self.file.close()
            self.file, self.read = None, 0
        return row


class Conversation:
    """Counts, edits and digest of one conversation, whose rows are added in order."""

    def __init__(self, remembered: dict[tuple, tuple[int, str]]) -> None:
        self.remembered, self.codes, self.repair = remembered, [], None
        self.blank = self.duplicate = self.truncated = self.illegal = self.turns = 0
        self.least = self.most = self.before = None
        self.rows, self.state, self.audit = Waiting(), EMPTY, []
        self.digest, self.written = hashlib.sha256(), False
        self.fed, self.next = 0, SETTLE // SHORT

    def add(self, turn: int | None, role: str, text: str, blank: bool, truncated: bool, repeated: bool) -> None:
        initial = role[:1]
        kind = BAD if blank or repeated else TRUNCATED if truncated else FINE
        self.blank += blank
        self.duplicate += repeated and not blank
        self.truncated += kind == TRUNCATED
        if turn is not None and turn != self.most:
            self.least = turn if self.least is None else self.least
            self.most, self.turns = turn, self.turns + 1
        self.illegal += self.before is not None and self.before + initial not in ("su", "ua", "au")
        self.before = initial
        self.rows.append((role, text))
        self.codes.append((initial, kind))
        if len(self.codes) >= SHORT:
            self._feed()

    def _feed(self) -> None:
        """Gives the rows at hand to the DP and writes what is settled."""
        self.repair = self.repair or Repair()
        for initial, kind in self.codes:
            self.repair.row(initial, kind)
        self.codes = []
        self.fed += 1
        if self.fed >= self.next:
            self._write(self.repair.settled())
            # What stays undecided is looked at again once it has grown by half, so each row is moved a few times at most.
            self.next = self.fed + 1 + len(self.rows) // (2 * SHORT)

    def _write(self, edits: str) -> None:
        """Carries out edits on the rows that wait."""
        for edit in edits:
            role, text = ("", "") if edit == "I" else self.rows.pop()
            if edit == "D":
                continue
            self.state = STEPS[role[:1]][self.state] if edit == "K" else TURN[self.state]
            if edit != "K":
                role = "user" if self.state == USER else "assistant"
            if self.written:
                self.digest.update(b"\n")
            self.digest.update(f"{role}:{text}".encode())
            self.written = True
        self.audit.append(edits)

    def result(self) -> tuple:
        if self.repair is None and (key := tuple(self.codes)) in self.remembered:
            cost, edits = self.remembered[key]
        elif self.repair is None:
            self._feed()
            cost, edits = self.repair.end()
            if len(self.remembered) < 1 << 16:
                self.remembered[key] = cost, edits
        else:
            self._feed()
            cost, edits = self.repair.end()
        self._write(edits)
        gaps = 0 if self.least is None else self.most - self.least + 1 - self.turns
        return gaps, self.blank, self.duplicate, self.truncated, self.illegal, cost, "".join(self.audit), self.digest.hexdigest()


def damaged(turns: DataFrame) -> DataFrame:
    """``turns`` (conv_id, turn, role, text) after the damage that crc32 of ``conv_id:turn`` asks for; rows that were dropped
    stay, marked ``gone``, so that no conversation is lost."""
    space = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    key = F.concat(space("conv_id"), F.lit(":"), space("turn"))
    way = (F.crc32(F.encode(key, "UTF-8")) % 20).alias("way")
    rows = turns.select("conv_id", F.col("turn").cast("long").alias("turn"), space("role").alias("role"), space("text").alias("text"), way)
    text = F.when(F.col("way").isin(0, 1), "").when(F.col("way") == 2, F.regexp_replace("text", "[.!?]", "")).otherwise(F.col("text"))
    role = F.when(F.col("way") == 4, "user").otherwise(F.col("role"))
    times = F.when(F.col("way") == 3, F.array(F.lit(1), F.lit(2))).otherwise(F.array(F.lit(1)))
    return rows.select("conv_id", "turn", role.alias("role"), text.alias("text"), (F.col("way") == 0).alias("gone"), F.explode(times).alias("time")).drop("time")


def faulty(rows: DataFrame) -> DataFrame:
    """``rows`` (conv_id, turn, role, text, gone), dealt by conversation, with ``blank``, ``truncated`` and ``repeated``."""
    bare = F.rtrim(F.translate("text", "\t\n\x0b\x0c\r", "     "))
    blank = bare == ""
    # Repeats are met inside the partition of their conversation: no further exchange.
    same = Window.partitionBy("conv_id", "role", "text", "gone").orderBy(F.asc_nulls_first("turn"))
    dealt = rows.repartition("conv_id")
    return dealt.select("*", blank.alias("blank"), (~F.substring(bare, -1, 1).isin(".", "!", "?")).alias("truncated"), (F.row_number().over(same) > 1).alias("repeated"))


def repair(rows: DataFrame) -> DataFrame:
    """Counts of faults, cheapest edits and digest of every conversation of ``rows`` (conv_id, turn, role, text, gone)."""
    bounded_batches(rows.sparkSession)
    kind = rows.schema["conv_id"].dataType.simpleString()
    fields = ["conv_id", "turn", "role", "text", "gone", "blank", "truncated", "repeated"]
    order = [F.asc_nulls_first("conv_id"), F.asc_nulls_first("turn"), "role", "text"]
    ordered = faulty(rows).select(*fields).sortWithinPartitions(*order)
    schema = RESULT.format(kind)
    names = [part.split()[0] for part in RESULT.split(", ")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        remembered: dict[tuple, tuple[int, str]] = {}
        now, current, done = None, None, []

        def given(id_type: pa.DataType) -> pa.RecordBatch:
            types = [id_type, *[pa.int64()] * 6, pa.string(), pa.string()]
            out = pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*done, strict=True), types, strict=True)], names)
            done.clear()
            return out

        for batch in batches:
            for conv, turn, role, text, gone, *faults in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if current is None or conv != now:
                    if current is not None:
                        done.append((now, *current.result()))
                    now, current = conv, Conversation(remembered)
                if not gone:
                    current.add(turn, role, text, *faults)
            if done:
                yield given(batch.schema.field(0).type)
        if current is not None:
            done.append((now, *current.result()))
            yield given(batch.schema.field(0).type)

    return ordered.mapInArrow(run, schema)
