"""Counters, histograms, statistics, health and alerts."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from . import scans

#: Upper bounds of histogram buckets, fixed values.
DEPTHS = (1, 2, 4, 8, 16, 32, 64, 128, 256)
SECONDS = (0.005, 0.01, 0.025, 0.05, 0.1, 0.25, 0.5, 1.0, 2.5, 5.0, 10.0)


def counters(df: DataFrame, labels: list[str]) -> DataFrame:
    return df.groupBy(*labels).agg(F.count(F.lit(1)).alias("n"))


def windowed_counters(df: DataFrame, labels: list[str], width: str, ts: str = "ts") -> DataFrame:
    return df.groupBy(F.window(ts, width).start.alias("window_start"), *labels).agg(F.count(F.lit(1)).alias("n"))


def histogram(df: DataFrame, value: str, bounds: tuple, labels: list[str]) -> DataFrame:
    """Cumulative buckets (labels, le, n), ``+Inf`` last: one aggregate, then one row for each bound."""
    names = [str(b) for b in bounds] + ["+Inf"]
    counts = [F.count_if(F.col(value) <= b) for b in bounds] + [F.count(value)]
    wide = df.groupBy(*labels).agg(*(c.alias(f"b{k}") for k, c in enumerate(counts)))
    rows = F.array(*(F.struct(F.lit(n).alias("le"), F.col(f"b{k}").alias("n")) for k, n in enumerate(names)))
    return wide.select(*labels, F.inline(rows))


def scan_counts(txs: DataFrame, width: int) -> DataFrame:
    """Blocks and transactions for each range of ``width`` heights."""
    no = F.floor((F.col("block_number") - 1) / width).cast("bigint")
    return txs.groupBy("chain_id", no.alias("range_no")).agg(F.countDistinct("block_number").alias("blocks_scanned"), F.count(F.lit(1)).alias("txs_found"))


def reorg_stats(events: DataFrame, latest: int = 100) -> DataFrame:
    """Statistics of the latest events of each chain. Each task keeps its own latest before the shuffle."""
    order = Window.partitionBy("chain_id").orderBy(F.desc("detected_at"), F.desc("event_id"))
    top = events.withColumn("_n", F.row_number().over(order)).where(F.col("_n") <= latest)
    last = F.max(F.struct("detected_at", "event_id", "depth"))
    return top.groupBy("chain_id").agg(F.count(F.lit(1)).alias("events"), F.max("depth").alias("max_depth"), F.avg("depth").alias("mean_depth"), last.alias("l")).select("chain_id", "events", "max_depth", "mean_depth", F.col("l.detected_at").alias("last_time"), F.col("l.depth").alias("last_depth"))


def detector_stats(checks: DataFrame) -> DataFrame:
    """``checks``: chain_id, ts, event_id, ok, depth (null: no reorganisation)."""
    last_ok = F.max(F.when(F.col("ok"), F.struct("ts", "event_id")))
    base = checks.groupBy("chain_id").agg(
        F.count(F.lit(1)).alias("checks"), F.count_if("ok").alias("successes"), F.count_if(~F.col("ok")).alias("failures"), F.count("depth").alias("reorgs"),
        F.coalesce(F.sum("depth"), F.lit(0)).alias("total_depth"), F.max("depth").alias("max_depth"), F.avg("depth").alias("mean_depth"), last_ok.alias("_ok"),
    )
    # Failures after the last success: a second aggregate over a small join, without ordering a chain's checks.
    after = checks.where(~F.col("ok")).join(base.select("chain_id", "_ok"), "chain_id").where(F.col("_ok").isNull() | (F.struct("ts", "event_id") > F.col("_ok")))
    streak = after.groupBy("chain_id").agg(F.count(F.lit(1)).alias("consecutive_failures"))
    return base.drop("_ok").join(streak, "chain_id", "left").withColumn("consecutive_failures", F.coalesce("consecutive_failures", F.lit(0)))


def processor_stats(events: DataFrame, duration: str) -> DataFrame:
    return events.groupBy("chain_id").agg(F.count_if("processed").alias("processed"), F.count_if(~F.col("processed")).alias("failed"), F.avg(F.when(F.col("processed"), F.col(duration))).alias("mean_duration"))


def state_stats(txs: DataFrame) -> DataFrame:
    states = ("pending", "confirmed", "finalized", "reverted")
    return txs.groupBy("chain_id").agg(*(F.count_if(F.col("status") == s).alias(s) for s in states), F.count(F.lit(1)).alias("total"))


def notify_stats(sent: DataFrame) -> DataFrame:
    """``sent``: chain_id, ts, ok, response_ms."""
    ok = F.col("ok")
    return sent.groupBy("chain_id").agg(
        F.count(F.lit(1)).alias("sent"), F.count_if(ok).alias("succeeded"), F.count_if(~ok).alias("failed"), F.max(F.when(ok, F.col("ts"))).alias("last_success"), F.max(F.when(~ok, F.col("ts"))).alias("last_failure"),
        F.avg(F.when(ok, F.col("response_ms"))).alias("mean_ms"),
    )


def node_stats(probes: DataFrame) -> DataFrame:
    ok = F.col("ok")
    return probes.groupBy("chain_id", "node").agg(F.count(F.lit(1)).alias("checks"), F.count_if(ok).alias("successes"), F.count_if(~ok).alias("failures"), F.avg(F.when(ok, F.col("response_ms"))).alias("mean_ms"), F.max("ts").alias("last_check"))


def latest_block(blocks: DataFrame) -> DataFrame:
    return blocks.groupBy("chain_id").agg(F.max(F.struct("block_number", "block_hash")).alias("b")).select("chain_id", "b.*")


def pipeline_status(blocks: DataFrame, heads: DataFrame, marks: DataFrame, errors: DataFrame, reorgs: DataFrame) -> DataFrame:
    """``marks`` has hw_scanned and hw_boundary; ``errors`` and ``reorgs`` are counted by chain."""
    n = lambda df, name: df.groupBy("chain_id").agg(F.count(F.lit(1)).alias(name))
    out = heads.select("chain_id", F.col("tip").alias("current"), "finalized").join(marks.select("chain_id", "hw_scanned", "hw_boundary"), "chain_id", "left")
    out = out.join(latest_block(blocks).select("chain_id", F.col("block_number").alias("stored")), "chain_id", "left").join(n(errors, "errors"), "chain_id", "left").join(n(reorgs, "reorgs"), "chain_id", "left")
    zero = lambda c: F.coalesce(c, F.lit(0))
    return out.select("chain_id", "current", "stored", "hw_scanned", (F.col("current") - zero("hw_scanned")).alias("lag"), "finalized", "hw_boundary", zero("errors").alias("errors"), zero("reorgs").alias("reorgs"))


def alerts(status: DataFrame, probes: DataFrame, queues: DataFrame, lag: int = 100, error_rate: float = 0.05, depth: int = 10_000) -> DataFrame:
    """(chain_id, alert, value) of every limit exceeded. ``queues``: chain_id, depth."""
    rate = probes.groupBy("chain_id").agg(F.avg((~F.col("ok")).cast("double")).alias("value"))
    parts = [
        status.where(F.col("lag") > lag).select("chain_id", F.lit("block_lag").alias("alert"), F.col("lag").cast("double").alias("value")),
        rate.where(F.col("value") > error_rate).select("chain_id", F.lit("error_rate").alias("alert"), "value"),
        queues.where(F.col("depth") > depth).select("chain_id", F.lit("queue_depth").alias("alert"), F.col("depth").cast("double").alias("value")),
    ]
    return parts[0].union(parts[1]).union(parts[2])


def affected_hashes(hits: DataFrame) -> DataFrame:
    """Sorted hashes of the transactions of each event; an event's range bounds their number."""
    return hits.groupBy("event_id").agg(F.array_sort(F.collect_list("tx_hash")).alias("tx_hashes"))


def running_mean(df: DataFrame, value: str, by: list[str], order: list[str], parts: int | None = None) -> DataFrame:
    """Mean of ``value`` up to each row; blocks of rows carry their sums on (see :mod:`.scans`)."""
    out = scans.running(scans.blocked(df, by, order, parts), by, order, _sum=("sum", F.col(value)), _n=("sum", F.col(value).isNotNull().cast("bigint")))
    return out.withColumn("running_mean", F.when(F.col("_n") > 0, F.col("_sum") / F.col("_n"))).drop("_sum", "_n", scans.BLOCK)


def moving_rate(samples: DataFrame, rate: str = "rate", new: float = 0.3, parts: int | None = None) -> DataFrame:
    """Exponential moving rate of the samples (chain_id, at, rate) of each chain, from 0; one row a sample.

    Each value is an affine map of the one before it. Runs of samples, so long that a weight falls to 1e-18 within one, are
    summed in closed form, each window inside one run; a run then takes over the ends of the two runs before it, and what
    lies farther back is below a double's last digit.
    """
    keep = 1 - new
    run = max(1, math.ceil(math.log(1e-18) / math.log(keep))) if 0 < new < 1 else 1
    numbered = scans.running(scans.blocked(samples.select("chain_id", "at", F.col(rate).alias("_x")), ["chain_id"], ["at"], parts), ["chain_id"], ["at"], _n=("sum", F.lit(1).cast("bigint")))
    runs = numbered.select("chain_id", "at", F.coalesce(F.col("_x").cast("double"), F.lit(0.0)).alias("_x"), F.floor((F.col("_n") - 1) / run).alias("_run"), ((F.col("_n") - 1) % run).alias("_i"))
    power = lambda e: F.pow(F.lit(float(keep)), e)
    # Inside a run the weights new * keep^(i - j), as keep^i times a sum of keep^-j, which stay below 1e18.
    upto = Window.partitionBy("chain_id", "_run").orderBy("_i").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    local = F.col("_x") if new >= 1 else F.lit(float(new)) * power(F.col("_i")) * F.sum(F.col("_x") * power(-F.col("_i"))).over(upto)
    runs = runs.withColumn("_local", local)
    ends = runs.groupBy("chain_id", "_run").agg(F.max_by("_local", "_i").alias("_end"))
    back = lambda k, name: ends.select(F.col("chain_id").alias(f"_k{k}"), (F.col("_run") + k).alias(f"_r{k}"), F.col("_end").alias(name))
    for k, name in ((1, "_near"), (2, "_far")):
        e = back(k, name)
        runs = runs.join(e, runs["chain_id"].eqNullSafe(e[f"_k{k}"]) & (runs["_run"] == e[f"_r{k}"]), "left")
    zero = lambda c: F.coalesce(F.col(c), F.lit(0.0))
    ema = F.col("_local") + power(F.col("_i") + 1) * (zero("_near") + power(F.lit(run)) * zero("_far"))
    return runs.select("chain_id", "at", ema.alias("ema"))


def node_health(probes: DataFrame, fail: int = 3, succeed: int = 2, parts: int | None = None) -> DataFrame:
    """Health after each probe of (chain_id, node): unhealthy from a failure streak of ``fail``, healthy again on a
    success once ``succeed`` successes were seen in all. A node begins healthy.

    Blocks of probes carry counts, the place of the last success and the last change of health (see :mod:`.scans`).
    """
    by, order = ["chain_id", "node"], ["ts", "event_id"]
    ok = F.col("ok")
    p = scans.running(scans.blocked(probes, by, order, parts), by, order, _n=("sum", F.lit(1).cast("bigint")), successes=("sum", ok.cast("bigint")))
    p = scans.running(p, by, order, _ok=("max", F.when(ok, F.col("_n"))))
    p = p.withColumn("streak", F.when(ok, F.lit(0).cast("bigint")).otherwise(F.col("_n") - F.coalesce("_ok", F.lit(0))))
    mark = F.when(~ok & (F.col("streak") >= fail), F.lit(False)).when(ok & (F.col("successes") >= succeed), F.lit(True))
    p = scans.running(p, by, order, healthy=("last", mark))
    return p.withColumn("healthy", F.coalesce("healthy", F.lit(True))).drop("_n", "_ok", scans.BLOCK)


def retained_hashes(blocks: DataFrame, depth: int) -> DataFrame:
    """The newest 2 x depth blocks of each chain: a plain height filter, then a rank over what it leaves."""
    tips = blocks.groupBy("chain_id").agg(F.max("block_number").alias("_tip"))
    near = blocks.join(tips, "chain_id").where(F.col("block_number") > F.col("_tip") - 2 * depth).drop("_tip")
    return near.withColumn("_n", F.row_number().over(Window.partitionBy("chain_id").orderBy(F.desc("block_number")))).where(F.col("_n") <= 2 * depth).drop("_n")


def over_boundary(marks: DataFrame) -> DataFrame:
    return marks.where("hw_scanned > hw_boundary")


def error_rate(ok: Column) -> Column:
    return F.avg((~ok).cast("double"))
