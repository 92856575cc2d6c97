"""Multi-node polling: per-node poll records and the node roster (latest state per node)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


STALE_AFTER_POLLS = 10  # fixed value: consecutive failures before a node's snapshot is dropped

NODE_PAYLOAD_SCHEMA = "hostname string, snapshot struct<gpu_power double, gpu_util double>"


def node_ingest(polls: DataFrame, payload: str = "payload") -> DataFrame:
    """Decode ``{hostname, snapshot}`` poll payloads; malformed or failed polls become failures."""
    p = F.from_json(F.col(payload), NODE_PAYLOAD_SCHEMA)
    ok = p["hostname"].isNotNull() & p["snapshot"].isNotNull()
    return polls.select(
        *[c for c in polls.columns if c != payload],
        F.coalesce(ok, F.lit(False)).alias("success"),
        F.when(ok, p["hostname"]).alias("hostname"),
        F.when(ok, p["snapshot"]["gpu_power"]).alias("gpu_power"),
        F.when(ok, p["snapshot"]["gpu_util"]).alias("gpu_util"),
    )


def node_roster(roster: DataFrame, polls: DataFrame, url: str = "url") -> DataFrame:
    """Latest state per configured node.

    Online = last poll succeeded; last_seen / hostname / snapshot from the last
    success; the snapshot is dropped after >= 10 consecutive failures; nodes
    never seen are offline with last_seen 0 and hostname = url.
    """
    order = F.struct(F.col("ts"), F.col("seq"))
    g = polls.groupBy(url).agg(
        F.max_by("success", order).alias("_online"), F.max(F.when(F.col("success"), order)).alias("_at"),
        F.max_by(F.struct("ts", "hostname", "gpu_power", "gpu_util"), F.when(F.col("success"), order)).alias("_ok"))
    # rows after the last success, all failures: counted map-side against one row per node
    after = polls.select(url, order.alias("_order")).join(g.select(url, "_at"), url).where(F.col("_at").isNull() | (F.col("_order") > F.col("_at")))
    g = g.join(after.groupBy(url).agg(F.count("*").alias("_streak")), url, "left")
    j = roster.select(url).distinct().join(g, url, "left")
    has_snap = F.col("_ok").isNotNull() & (F.coalesce("_streak", F.lit(0)) < STALE_AFTER_POLLS)
    return j.select(
        url,
        F.coalesce(F.col("_ok.hostname"), F.col(url)).alias("hostname"),
        F.coalesce("_online", F.lit(False)).alias("online"),
        F.coalesce(F.col("_ok.ts"), F.lit(0).cast("bigint")).alias("last_seen_ms"),
        F.when(has_snap, F.col("_ok.gpu_power")).alias("snapshot_gpu_power"),
        F.coalesce("_streak", F.lit(0).cast("bigint")).alias("failures"),
    )


def catalog_merge(responses: DataFrame, body: str = "body") -> DataFrame:
    """Model entries from every upstream that answered 200 with a ``data`` list; others are skipped."""
    ok = responses.where(F.col("status") == 200)
    d = F.from_json(F.col(body), "data array<struct<id string, owned_by string>>")
    return ok.select(*[c for c in responses.columns if c != body], F.posexplode(d["data"]).alias("pos", "m")).select(
        *[c for c in responses.columns if c != body], "pos", F.col("m.id").alias("model_id"), F.col("m.owned_by").alias("owned_by"))
