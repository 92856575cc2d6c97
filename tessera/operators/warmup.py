"""Warm-up baselines as relations.

While an engine warms up its counters pass as they are. Once it has answered ``skip`` requests more than at the lowest
count since warming began, the counters and histograms of that poll are its baseline, and later polls show what was
added since. A counter below its baseline means a restart, and warming begins anew.

Counters only fall at a restart or where a sample is missing. Between two falls nothing falls below the baseline, and the
request count only grows, so all that can change the state is known from few polls: those where something falls, the one
after, and those where the count first takes one of the next ``skip`` values. Which polls these are comes from ordered
windows over all rows (``windows``); only they are folded in order, one short array per engine. The changes are then
carried forward over all polls. An engine's array grows with its restarts and missing request counts, not with its polls.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .windows import prev_non_null

#: Carried state of an engine: is it active; the lowest request count since warming began; the baseline of each counter.
STATE = {"active": "boolean", "low": "bigint", "base": "array<double>"}


def _any(conditions: list[Column]) -> Column:
    return reduce(lambda a, b: a | b, [F.coalesce(c, F.lit(False)) for c in conditions])


def deciding_polls(polls: DataFrame, counters: list[str], trigger: str, skip: int, key: str, ts: str, tie: str) -> DataFrame:
    """(key, ts, tie, total, vals): the polls that can change the state. A missing request count is 0."""
    total = F.coalesce(F.col(trigger).cast("bigint"), F.lit(0).cast("bigint"))
    d = polls.select(key, ts, tie, total.alias("_total"), *[F.col(c).cast("double").alias(f"_c{k}") for k, c in enumerate(counters)])
    values = [f"_c{k}" for k in range(len(counters))]
    d = prev_non_null(d, key, ts, tie, ["_total", *values], suffix="_p")
    falls = F.col("_total_p").isNull() | _any([F.col(c) < F.col(f"{c}_p") for c in ["_total", *values]])
    d = d.select(key, ts, tie, "_total", "_total_p", F.array(*values).alias("vals"), falls.alias("_falls"), F.when(falls, F.col("_total")).alias("_begin"), falls.cast("int").alias("_fell"))
    d = prev_non_null(d, key, ts, tie, ["_begin", "_fell"], suffix="_p")
    grows = (F.col("_total") > F.col("_total_p")) & (F.col("_total_p") < F.col("_begin_p") + skip)
    return d.where(_any([F.col("_falls"), F.col("_fell_p") == 1, grows])).select(key, ts, tie, F.col("_total").alias("total"), "vals")


def folded(polls: DataFrame, counters: list[str], trigger: str, skip: int = 1, key: str = "engine_key", ts: str = "ts", tie: str = "seq",
           start: DataFrame | None = None) -> DataFrame:
    """(key, active, low, base, changes): each engine's state after its polls, and its changes (ts, tie, active, base) in order.

    ``start`` (key and ``STATE``): the state before the polls; engines without one are seen for the first time.
    """
    rows = deciding_polls(polls, counters, trigger, skip, key, ts, tie)
    tie_type = dict(rows.dtypes)[tie]
    one = rows.groupBy(key).agg(F.array_sort(F.collect_list(F.struct(F.col(ts).alias("ts"), F.col(tie).alias("tie"), "total", "vals"))).alias("_rows"))
    one = one.join(start.select(key, *STATE), key, "left") if start is not None else one.select("*", *[F.lit(None).cast(t).alias(n) for n, t in STATE.items()])
    changes = f"array<struct<ts: bigint, tie: {tie_type}, active: boolean, base: array<double>>>"
    begin = F.struct(F.coalesce("active", F.lit(False)).alias("active"), F.col("low"), F.col("base"), F.array().cast(changes).alias("changes"))

    def then(s: Column, r: Column) -> Column:
        restarted = s["active"] & F.exists(F.zip_with(s["base"], r["vals"], lambda b, v: v < b), lambda x: F.coalesce(x, F.lit(False)))
        lowest = F.least(s["low"], r["total"])
        warm = ~s["active"] & (r["total"] >= F.coalesce(s["low"], r["total"])) & (r["total"] - lowest >= skip)
        active = (s["active"] & ~restarted) | warm
        base = F.when(warm, r["vals"]).when(active, s["base"])
        change = F.struct(r["ts"].alias("ts"), r["tie"].alias("tie"), active.alias("active"), base.alias("base"))
        return F.struct(active.alias("active"), F.when(restarted, r["total"]).when(~active, lowest).alias("low"), base.alias("base"),
                        F.when(active != s["active"], F.concat(s["changes"], F.array(change).cast(changes))).otherwise(s["changes"]).alias("changes"))

    end = F.aggregate("_rows", begin.cast(f"struct<{', '.join(f'{n}: {t}' for n, t in STATE.items())}, changes: {changes}>"), then)
    return one.select(key, end.alias("_end")).select(key, "_end.*")


def epochs(polls: DataFrame, counters: list[str], trigger: str, skip: int = 1, key: str = "engine_key", ts: str = "ts", tie: str = "seq",
           start: DataFrame | None = None) -> DataFrame:
    """The polls with ``warming_up``, ``just_transitioned``, ``epoch`` (time of the last baseline; null before) and ``base`` (null while warming).

    ``tie`` orders polls of one time and must tell them apart. With ``start``, a baseline from before has a null epoch.
    """
    ends = folded(polls, counters, trigger, skip, key, ts, tie, start).checkpoint()  # one row per engine: the plans stay short
    marks = ends.select(key, F.explode("changes").alias("_c")).select(
        F.col(key).alias("_k"), F.col("_c.ts").alias("_t"), F.col("_c.tie").alias("_s"), F.struct("_c.active", "_c.base").alias("_mark"), F.when(F.col("_c.active"), F.col("_c.ts")).alias("_epoch"))
    d = polls.join(marks, (F.col(key) == F.col("_k")) & (F.col(ts) == F.col("_t")) & (F.col(tie) == F.col("_s")), "left").drop("_k", "_t", "_s")
    d = prev_non_null(d, key, ts, tie, ["_mark", "_epoch"], suffix="_p")
    now = F.coalesce("_mark", "_mark_p")
    if start is not None:
        before = start.select(F.col(key).alias("_k"), F.struct("active", "base").alias("_from"))
        d = d.join(before, F.col(key) == F.col("_k"), "left").drop("_k")
        now = F.coalesce(now, F.col("_from"))
    out = d.withColumn("_now", now)
    return out.select(*polls.columns, (~F.coalesce("_now.active", F.lit(False))).alias("warming_up"), F.coalesce("_mark.active", F.lit(False)).alias("just_transitioned"),
                      F.coalesce("_epoch", "_epoch_p").alias("epoch"), F.when(F.col("_now.active"), F.col("_now.base")).alias("base"))


def since(value: Column, base: Column) -> Column:
    """What was added since the baseline, 0 at least; the value itself where there is none."""
    return F.when(base.isNull(), value).otherwise(F.greatest(value - base, F.lit(0.0)))


def baselined(polls: DataFrame, counters: list[str], trigger: str, skip: int = 1, key: str = "engine_key", ts: str = "ts", tie: str = "seq",
              start: DataFrame | None = None) -> DataFrame:
    """(key, ts, tie, warming_up, just_transitioned, epoch, ``adj_<counter>``): polls with their counters since the baseline."""
    d = epochs(polls, counters, trigger, skip, key, ts, tie, start)
    adjusted = [F.when(F.col(c).isNotNull(), since(F.col(c).cast("double"), F.col("base")[k])).alias(f"adj_{c}") for k, c in enumerate(counters)]
    return d.select(key, ts, tie, "warming_up", "just_transitioned", "epoch", *adjusted)


def subtract_baseline(samples: DataFrame, states: DataFrame, key: str, tick: str, name: str = "metric") -> DataFrame:
    """(key, epoch, tick, name, value, hist): samples of every poll since the baseline of their epoch.

    ``samples``: (key, tick, name, value, hist), a counter's value or a histogram as array of (le, cum). ``states``: one row
    per (key, tick) with ``warming_up``, ``just_transitioned`` and ``epoch``. A series carries one value or array per
    epoch, from the poll that set the baseline; without one there it passes unchanged, and so does everything while
    warming. A histogram with other bounds than its baseline's is dropped.
    """
    s = samples.join(states.select(key, tick, "warming_up", "just_transitioned", "epoch"), [key, tick])
    s = s.withColumn("_series", F.concat_ws("\u0001", key, name)).withColumn("_tie", F.lit(0))
    s = s.withColumn("_base", F.when(F.col("just_transitioned"), F.struct("epoch", "value", "hist")))
    s = prev_non_null(s, "_series", tick, "_tie", ["_base"], suffix="_p")
    s = s.withColumn("_b", F.coalesce("_base", "_base_p"))
    s = s.withColumn("_b", F.when(~F.col("warming_up") & (F.col("_b.epoch") == F.col("epoch")), F.col("_b")))
    bounds = lambda h: F.transform(h, lambda x: x["le"])
    hist = F.when(F.col("_b.hist").isNull(), F.col("hist")).when(
        bounds(F.col("hist")) == bounds(F.col("_b.hist")),
        F.zip_with("hist", "_b.hist", lambda x, b: F.struct(x["le"].alias("le"), F.greatest(x["cum"] - b["cum"], F.lit(0.0)).alias("cum"))))
    out = s.select(key, "epoch", tick, name, F.when(F.col("value").isNotNull(), since(F.col("value"), F.col("_b.value"))).alias("value"), hist.alias("hist"), F.col("hist").isNotNull().alias("_h"))
    return out.where(~F.col("_h") | F.col("hist").isNotNull()).drop("_h")
