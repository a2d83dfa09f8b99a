"""Chat transcripts: roles by a hidden Markov model, then canonical turns.

A transcript is a sequence of lines. Each line has a code of three features: whether it follows a blank line (or the
start), which role a speaker marker at its start names, and its length class. The hidden states are (role, first line of
a turn or later line). Start, transition and emission counts come from labelled conversations, with a prior that ties
markers to their roles; Viterbi then finds the likeliest states. Recovered turns lose their markers and are rendered in
one canonical form.

Long conversations are decoded in blocks, exactly: each block gives the best score from every entry to every exit state,
these small tables are chained for each conversation, and each block is decoded again between the states so found.
Blocks are runs of ``BLOCK`` parts; runs of more than ``LINES`` lines are cut further, at parts and every ``LINES`` lines.
Only rows for blocks, never lines, are brought together for a conversation, when fitting and when turns are numbered too;
the text of one turn is one value.

Null texts and roles: a null text has no lines, a null or unknown role is not learned from. Blank lines only separate.
Null ids form one conversation; null part numbers come first; equal part numbers are ordered by a hash of their text, and
equal texts of one part follow each other; each is blocks of its own where a run is cut, however many there are. Conversations without lines don't appear; an empty table gives no rows. Other
columns are left out.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import stored

ROLES = ("system", "user", "assistant")
#: Marker words of each role, fixed values.
MARKERS = (("system", "instruction manual"), ("user", "human", "prompter", "question", "q", "customer"), ("assistant", "ai", "bot", "answer", "a", "agent", "response"))
#: Parts in a block, lines in one, length classes, and how many observations a marker's prior counts for.
BLOCK, LINES, SIZES, PRIOR = 64, 4096, 8, 50.0

#: Columns that order the lines of a conversation, and the type of a block's number, which has the same order.
ORDER = ("part", "copy", "repeat", "line")
BLOCK_TYPE = "struct<run:bigint,part:bigint,copy:bigint,repeat:bigint,piece:bigint>"


def _marker(words: tuple[str, ...]) -> str:
    return rf"(?i)^\s*(?:#+\s*|\*\*|<\|)?(?:{'|'.join(words)})(?:\|>|:\*\*|\*\*\s*:|\s*:)"


ANY_MARKER = _marker(tuple(w for ws in MARKERS for w in ws))


def lines_of(parts: DataFrame) -> DataFrame:
    """(conv_id, part, copy, repeat, line, text, code[, role]) of the non-blank lines of ``parts`` (conv_id, part, text[, role]).

    Parts of a conversation follow each other, separated like by a blank line; a whole transcript is one part.
    """
    more = ["role"] if "role" in parts.columns else []
    # A part number alone need not be unique; the text's hash makes lines of equal parts stay together.
    cut = F.split(F.regexp_replace("text", "\r\n?", "\n"), "\n")
    # Rows that are equal in all of this are told apart by any number: they are alike, so their order doesn't matter.
    whole = parts.select(F.col("conv_id").cast("long"), F.col("part").cast("long"), F.xxhash64("text").alias("copy"), F.monotonically_increasing_id().alias("repeat"), *more, cut.alias("text"), F.concat(F.array(F.lit(None).cast("string")), cut).alias("before"))
    # Each line travels with the one before it; the last entry has no line of its own.
    base = whole.select("conv_id", "part", "copy", "repeat", *more, F.posexplode(F.arrays_zip("text", "before")).alias("line", "l"))
    base = base.select("conv_id", "part", "copy", "repeat", *more, "line", "l.text", "l.before").where("text IS NOT NULL")
    blank = F.trim(F.translate("text", "\t\x0b\x0c\r", "    ")) == ""
    after_blank = F.col("before").isNull() | (F.trim(F.translate("before", "\t\x0b\x0c\r", "    ")) == "")
    marker = F.lit(0)
    for k, words in enumerate(MARKERS):
        marker = F.when(F.col("text").rlike(_marker(words)), k + 1).otherwise(marker)
    size = F.least(F.floor(F.log2(F.length("text") / 8 + 1)), F.lit(SIZES - 1)).cast("int")
    code = (after_blank.cast("int") * (len(ROLES) + 1) + marker) * SIZES + size
    return base.where(~blank).select("conv_id", F.coalesce("part", F.lit(-1)).alias("part"), "copy", "repeat", "line", "text", code.alias("code"), *more)


def blocked(lines: DataFrame) -> DataFrame:
    """``lines`` with the number of their ``block``, dealt by conversation and block. Null conversations are one."""
    run = F.floor(F.col("part") / BLOCK).alias("run")
    sizes = lines.groupBy("conv_id", run).agg(F.count(F.lit(1)).alias("n"))
    long = sizes.where(F.col("n") > LINES).select(F.col("conv_id").alias("c"), F.col("run").alias("r"))
    zero = F.lit(0).cast("long")
    cut = F.when(F.col("r").isNull(), F.struct(run, zero.alias("part"), zero.alias("copy"), zero.alias("repeat"), zero.alias("piece"))).otherwise(F.struct(run, "part", "copy", "repeat", F.floor(F.col("line") / LINES).alias("piece")))
    met = lines.join(long, F.col("conv_id").eqNullSafe(F.col("c")) & (F.floor(F.col("part") / BLOCK) == F.col("r")), "left")
    return met.withColumn("block", cut.cast(BLOCK_TYPE)).drop("c", "r")


@dataclass
class Model:
    start: np.ndarray  # log probabilities: state
    step: np.ndarray  # from state, to state
    emit: np.ndarray  # state, code


def _smoothed(counts: np.ndarray, prior: float | np.ndarray = 1.0) -> np.ndarray:
    c = counts + prior
    return np.log(c / c.sum(axis=-1, keepdims=True))


def moves_of(lines: DataFrame) -> DataFrame:
    """(before, state, count): how often a state follows another in a conversation; ``before`` is null where one starts.

    ``lines`` (conv_id, block, part, copy, repeat, line, state): pairs inside a block by a window over it, those between blocks
    from their first and last states.
    """
    inside = lines.select("state", F.lag("state").over(Window.partitionBy("conv_id", "block").orderBy(*ORDER)).alias("before")).where("before IS NOT NULL")
    ends = lines.groupBy("conv_id", "block").agg(F.min_by("state", F.struct(*ORDER)).alias("state"), F.max_by("state", F.struct(*ORDER)).alias("last"))
    between = ends.select("state", F.lag("last").over(Window.partitionBy("conv_id").orderBy("block")).alias("before"))
    return inside.unionByName(between).groupBy("before", "state").count()


def fit(turns: DataFrame) -> Model:
    """Model from labelled ``turns`` (conv_id, part, text, role): counts over all of them, summed by Spark."""
    n = len(ROLES)
    role = sum((F.when(F.col("role") == r, k + 1).otherwise(0) for k, r in enumerate(ROLES)), F.lit(0)) - 1
    lines = lines_of(turns).withColumn("r", role).where("r >= 0")
    first = F.row_number().over(Window.partitionBy("conv_id", "part", "copy", "repeat").orderBy("line")) == 1
    lines = stored(blocked(lines.select("conv_id", *ORDER, "code", (2 * F.col("r") + F.when(first, 0).otherwise(1)).alias("state"))), "chat-lines")
    emit = np.zeros((2 * n, 2, n + 1, SIZES))
    for r in lines.groupBy("state", "code").count().collect():
        a, b = divmod(r["code"], (n + 1) * SIZES)
        emit[r["state"], a, b // SIZES, b % SIZES] += r["count"]
    # Features are taken as independent given the state.
    blank, marker, size = emit.sum(axis=(2, 3)), emit.sum(axis=(1, 3)), emit.sum(axis=(1, 2))
    prior = np.full((2 * n, n + 1), 0.01)
    prior[:, 0] = PRIOR
    for k in range(n):
        prior[2 * k, k + 1] = PRIOR
    e = _smoothed(blank)[:, :, None, None] + _smoothed(marker, prior)[:, None, :, None] + _smoothed(size)[:, None, None, :]
    start, step = np.zeros(2 * n), np.zeros((2 * n, 2 * n))
    for r in moves_of(lines).collect():
        if r["before"] is None:
            start[r["state"]] += r["count"]
        else:
            step[r["before"], r["state"]] += r["count"]
    allowed = np.array([[to % 2 == 0 or to // 2 == at // 2 for to in range(2 * n)] for at in range(2 * n)])
    step = np.where(allowed, _smoothed(step), -1e9)  # a later line stays with its turn's role
    start = np.where(np.arange(2 * n) % 2 == 0, _smoothed(start), -1e9)
    return Model(start, step, e.reshape(2 * n, -1))


def chained(m: Model, codes: np.ndarray, opening: bool) -> np.ndarray:
    """Best score of the states of a block from each state before it (all alike if it opens) to each last state."""
    s = (np.broadcast_to(m.start, m.step.shape) if opening else m.step) + m.emit[:, codes[0]]
    for c in codes[1:]:
        s = (s[:, :, None] + m.step[None]).max(axis=1) + m.emit[:, c]
    return s


def viterbi(m: Model, codes: np.ndarray, entry: int, exit_: int) -> list[int]:
    """Best states of a block after state ``entry`` (-1: it opens) that ends in ``exit_`` (-1: any)."""
    s, back = (m.start if entry < 0 else m.step[entry]) + m.emit[:, codes[0]], []
    for c in codes[1:]:
        t = s[:, None] + m.step
        back.append(t.argmax(axis=0))
        s = t.max(axis=0) + m.emit[:, c]
    states = [int(s.argmax()) if exit_ < 0 else exit_]
    for b in reversed(back):
        states.append(int(b[states[-1]]))
    return states[::-1]


def _blocks(batches: Iterator[pa.RecordBatch], n_keys: int) -> Iterator[pa.Table]:
    """Runs of rows that agree in the first ``n_keys`` columns, whole even across batches."""
    held: pa.Table | None = None
    for batch in batches:
        table = pa.Table.from_batches([batch])
        table = table if held is None else pa.concat_tables([held, table])
        keys = [table.column(k).to_pylist() for k in range(n_keys)]
        rows = list(zip(*keys, strict=True))
        cut = [0, *(k for k in range(1, len(rows)) if rows[k] != rows[k - 1])]
        for a, b in zip(cut, cut[1:], strict=False):
            yield table.slice(a, b - a)
        held = table.slice(cut[-1]) if rows else held
    if held is not None and held.num_rows:
        yield held


def decode(lines: DataFrame, model: Model) -> DataFrame:
    """``lines`` with ``role``, ``begins`` (first line of a turn), ``block`` and ``nth`` (turns begun in the block so far)."""
    n = 2 * len(ROLES)
    rows = stored(blocked(lines.select("conv_id", *ORDER, "code", "text")), "chat-blocks")
    laid = lambda df: df.repartition("conv_id", "block").sortWithinPartitions("conv_id", "block", *ORDER)
    opening = rows.groupBy("conv_id").agg(F.min("block").alias("least"), F.max("block").alias("most"))
    long = opening.where("most > least").withColumnRenamed("conv_id", "c")

    def tables(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t in _blocks(batches, 2):
            s = chained(model, t.column("code").to_numpy(), t.column("block")[0].as_py() == t.column("least")[0].as_py())
            yield pa.RecordBatch.from_arrays([t.column(0).slice(0, 1).combine_chunks(), t.column(1).slice(0, 1).combine_chunks(), pa.array([s.tobytes()])], names=["conv_id", "block", "score"])

    parts = rows.join(long, F.col("conv_id").eqNullSafe(F.col("c"))).select("conv_id", "block", *ORDER, "code", "least")
    scored = laid(parts).mapInArrow(tables, f"conv_id long, block {BLOCK_TYPE}, score binary")

    def chain(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t in _blocks(batches, 1):
            tables_ = [np.frombuffer(x, dtype=float).reshape(n, n) for x in t.column("score").to_pylist()]
            best, back = tables_[0][0], []
            for x in tables_[1:]:
                total = best[:, None] + x
                back.append(total.argmax(axis=0))
                best = total.max(axis=0)
            exits = [int(best.argmax())]
            for b in reversed(back):
                exits.append(int(b[exits[-1]]))
            exits = exits[::-1]
            yield pa.RecordBatch.from_arrays([t.column(0).combine_chunks(), t.column(1).combine_chunks(), pa.array([-1, *exits[:-1]]), pa.array(exits)], names=["conv_id", "block", "entry", "exit"])

    met = scored.repartition("conv_id").sortWithinPartitions("conv_id", "block").mapInArrow(chain, f"conv_id long, block {BLOCK_TYPE}, entry long, exit long")
    met = stored(met, "chat-chain").withColumnsRenamed({"conv_id": "c", "block": "b"})
    full = rows.select("conv_id", "block", *ORDER, "code", "text").join(met, F.col("conv_id").eqNullSafe(F.col("c")) & (F.col("block") == F.col("b")), "left").drop("c", "b")

    def states(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t in _blocks(batches, 2):
            at = [t.column(c)[0].as_py() for c in ("entry", "exit")]
            found = viterbi(model, t.column("code").to_numpy(), *(-1 if x is None else x for x in at))
            begins = np.array([s % 2 == 0 for s in found])
            t = t.select(["conv_id", *ORDER, "text", "block"]).append_column("role", pa.array([ROLES[s // 2] for s in found]))
            t = t.append_column("begins", pa.array(begins)).append_column("nth", pa.array(begins.cumsum(dtype=np.int64)))
            yield from t.combine_chunks().to_batches()

    return laid(full).mapInArrow(states, f"conv_id long, part long, copy long, repeat long, line int, text string, block {BLOCK_TYPE}, role string, begins boolean, nth long")


def render(role: Column, text: Column) -> Column:
    return F.concat(F.lit("<|"), role, F.lit("|>\n"), text, F.lit("\n<|end|>"))


def turns_of(decoded: DataFrame) -> DataFrame:
    """(conv_id, turn, role, first_part, n_lines, text, rendered): recovered turns, numbered from 0."""
    decoded = stored(decoded, "chat-states")
    begun = decoded.groupBy("conv_id", "block").agg(F.max("nth").alias("n"))
    before = F.sum("n").over(Window.partitionBy("conv_id").orderBy("block").rowsBetween(Window.unboundedPreceding, -1))
    starts = begun.select(F.col("conv_id").alias("c"), F.col("block").alias("b"), F.coalesce(before, F.lit(0)).alias("before"))
    lines = decoded.join(starts, F.col("conv_id").eqNullSafe(F.col("c")) & (F.col("block") == F.col("b")))
    bare = F.when(F.col("begins"), F.regexp_replace("text", ANY_MARKER + r"\s*", "")).otherwise(F.col("text"))
    lines = lines.withColumn("turn", F.col("before") + F.col("nth") - 1).withColumn("text", bare)
    turns = lines.groupBy("conv_id", "turn", "role").agg(F.min("part").alias("first_part"), F.count(F.lit(1)).alias("n_lines"), F.sort_array(F.collect_list(F.struct("part", "copy", "repeat", "line", "text"))).alias("l"))
    text = F.array_join(F.transform("l", lambda x: x["text"]), "\n")
    return turns.select("conv_id", "turn", "role", "first_part", "n_lines", text.alias("text"), render(F.col("role"), text).alias("rendered"))


def format_transcripts(parts: DataFrame, model: Model) -> DataFrame:
    """Canonical turns of ``parts`` (conv_id, part, text), whose roles are not looked at."""
    return turns_of(decode(lines_of(parts.select("conv_id", "part", "text")), model))
