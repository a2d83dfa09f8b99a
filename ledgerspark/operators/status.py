"""Status changes of transactions, folded through a rule table, and idempotent processing."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from . import scans

#: (from, to, action) moves, fixed values; the last two statuses are final.
RULES = (("pending", "confirmed", "confirm"), ("pending", "reverted", "revert"), ("confirmed", "finalized", "finalize"), ("confirmed", "reverted", "revert"))


def action_of(status: Column, to: Column, rules: tuple = RULES) -> Column:
    """Name of the move, null if the rules don't have it. A rule may have a fourth part, a condition column."""
    out = F.lit(None).cast("string")
    for a, b, name, *condition in reversed(rules):
        hit = (status == a) & (to == b)
        out = F.when(hit & condition[0] if condition else hit, name).otherwise(out)
    return out


def states_of(rules: tuple = RULES, start: str = "pending") -> list[str]:
    """The statuses that rules name, ``start`` first."""
    return list(dict.fromkeys([start, *(s for a, b, *_ in rules for s in (a, b))]))


def actions(to: Column, rules: tuple = RULES, start: str = "pending") -> Column:
    """What an update does from each of ``states_of``: the action's name, or null where it is rejected. Conditions are
    evaluated here, on the row."""
    return F.array(*(action_of(F.lit(s), to, rules) for s in states_of(rules, start)))


#: Updates in a list; lists are folded, then maps.
LISTED = 1024


def fold(updates: DataFrame, key: str = "tx_key", start: str = "pending", rules: tuple = RULES, parts: int | None = None) -> DataFrame:
    """(key, status, moves, rejected, last_action): updates (key, ts, event_id, new_status) applied in order.

    A move outside the rules is rejected and the status stays. ``LISTED`` updates of a key at most become one map from
    each status to (status, moves, rejected, action); maps of neighbours compose, first those of a range of updates, then
    those of a key. So a key with very many updates is many lists in many tasks, and none of them grows with it.
    """
    states = states_of(rules, start)
    place = F.coalesce(F.array_position(F.array(*map(F.lit, states)), F.col("new_status")).cast("int"), F.lit(0)) - 1
    rows = updates.select(F.col(key).alias("k"), "ts", "event_id", F.struct(place.alias("to"), actions(F.col("new_status"), rules, start).alias("does")).alias("u"))
    order = ["k", "ts", "event_id"]
    cut = (rows.repartitionByRange(parts, *order) if parts else rows.repartitionByRange(*order)).withColumn("part", F.spark_partition_id())
    n = F.row_number().over(Window.partitionBy("k", "part").orderBy("ts", "event_id"))
    cut = cut.withColumn("run", F.floor((n - 1) / LISTED))

    def result(to: Column, moves: Column, rejected: Column, action: Column) -> Column:
        return F.struct(to.cast("int").alias("to"), moves.cast("bigint").alias("moves"), rejected.cast("bigint").alias("rejected"), action.cast("string").alias("action"))

    def step(acc: Column, u: Column) -> Column:
        act = F.get(u["does"], acc["to"])
        ok = act.isNotNull()
        return result(F.when(ok, u["to"]).otherwise(acc["to"]), acc["moves"] + ok.cast("bigint"), acc["rejected"] + (~ok).cast("bigint"), F.coalesce(act, acc["action"]))

    def then(acc: Column, m: Column) -> Column:
        x = F.get(m, acc["to"])
        return result(x["to"], acc["moves"] + x["moves"], acc["rejected"] + x["rejected"], F.coalesce(x["action"], acc["action"]))

    def mapped(values: Column, one) -> Column:
        zero = F.lit(0)
        return F.array(*(F.aggregate(values, result(F.lit(i), zero, zero, F.lit(None)), one) for i in range(len(states))))

    def listed(*fields: str) -> Column:
        return F.sort_array(F.collect_list(F.struct(*fields)))

    lists = cut.groupBy("k", "part", "run").agg(listed("ts", "event_id", "u").alias("l"))
    maps = lists.select("k", "part", "run", mapped(F.transform("l", lambda x: x["u"]), step).alias("m"))
    ranges = maps.groupBy("k", "part").agg(listed("run", "m").alias("l")).select("k", "part", mapped(F.transform("l", lambda x: x["m"]), then).alias("m"))
    keys = ranges.groupBy("k").agg(listed("part", "m").alias("l"))
    zero = F.lit(0)
    s = F.aggregate(F.transform("l", lambda x: x["m"]), result(zero, zero, zero, F.lit(None)), then)
    named = F.element_at(F.array(*map(F.lit, states)), F.col("s.to") + 1)
    return keys.select(F.col("k").alias(key), s.alias("s")).select(key, named.alias("status"), "s.moves", "s.rejected", F.col("s.action").alias("last_action"))


def first_within_ttl(df: DataFrame, key: str, ts: str, ttl_seconds: int, tie: str, parts: int | None = None) -> DataFrame:
    """Rows whose key was not seen in the ``ttl_seconds`` before them; a kept row opens a new period.

    A row farther than that from the one before it opens a period for certain, so a key's rows fall into runs that have
    nothing to do with each other: each is dealt on its own, and a hot key is as many tasks as it has runs. Inside a run
    the next kept row is found by binary search. Gaps are found over blocks of rows (see :mod:`.scans`); a run without
    gaps is walked by one task. Null keys are one key; rows without a time are left out.
    """
    period = ttl_seconds * 1_000_000
    rows = df.where(F.col(ts).isNotNull()).select(F.col(key).alias("k"), F.unix_micros(F.col(ts).cast("timestamp")).alias("t"), F.col(tie).alias("e"))
    by, order = ["k"], ["t", "e"]
    rows = scans.before(scans.blocked(rows, by, order, parts), by, order, "t", "p")
    rows = rows.withColumn("far", F.coalesce(F.col("t") - F.col("p") > period, F.lit(True)))
    rows = scans.running(rows, by, order, run=("sum", F.col("far").cast("bigint"))).select("k", "t", "e", "run", "far")

    def walk(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last = 0  # each run begins with a far row
        for batch in batches:
            t = batch.column(1).to_numpy()
            begins = np.flatnonzero(batch.column(4).to_numpy(zero_copy_only=False))
            kept, at = [], 0
            for end in [*begins[begins > 0].tolist(), len(t)]:
                # [at, end) lies in one run; the first batch of a run begins with its far row.
                at_end = end
                if at in begins:
                    kept.append(at)
                    last = t[at]
                while (at := int(np.searchsorted(t[at:at_end], last + period, side="right")) + at) < at_end:
                    kept.append(at)
                    last = t[at]
                at = end
            yield batch.take(pa.array(kept, pa.int64())).select([0, 1, 2])

    schema = StructType([*rows.schema.fields[:3]])
    out = rows.repartition("k", "run").sortWithinPartitions("k", "run", "t", "e").mapInArrow(walk, schema)
    return out.select(F.col("k").alias(key), F.timestamp_micros("t").alias(ts), F.col("e").alias(tie))


def unexpired(processed: DataFrame, now: Column, ttl_seconds: int) -> DataFrame:
    return processed.where(F.col("created_at") > now - F.make_interval(secs=F.lit(ttl_seconds)))


def cleared(processed: DataFrame, keys: DataFrame) -> DataFrame:
    return processed.join(keys, "key", "left_anti")
