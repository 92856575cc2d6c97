"""Settings as an append log ``(key, value, updated_at)``: latest write per key wins."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# Defaults of the settings row.
DEFAULTS = {"enabled": "true", "cloud_prompt_rate": "", "cloud_gen_rate": "", "electricity_rate": "",
            "utc_offset": "-4", "tp_gpu_count": "1"}


def settings_upsert(log: DataFrame) -> DataFrame:
    """Current value per key (``max_by`` on the write time; ties by value for determinism)."""
    return log.groupBy("key").agg(F.max_by("value", F.struct("updated_at", "value")).alias("value"))


# Keys that an update may carry; recording is switched by a toggle of its own.
UPDATABLE = ("cloud_prompt_rate", "cloud_gen_rate", "electricity_rate", "utc_offset", "tp_gpu_count")


def settings_updates(bodies: DataFrame, body: str = "body", at: str = "updated_at") -> DataFrame:
    """Update bodies (JSON objects) -> log rows: only the supplied keys with a value are written, unknown ones are not."""
    given = F.from_json(body, "map<string,string>")
    known = F.map_filter(given, lambda k, v: k.isin(*UPDATABLE) & v.isNotNull())
    return bodies.select(F.explode(known).alias("key", "value"), F.col(at).alias("updated_at"))


def settings_view(current: DataFrame) -> DataFrame:
    """One settings row: known keys pivoted, absent keys take their defaults."""
    keys = list(DEFAULTS)
    p = current.groupBy().pivot("key", keys).agg(F.first("value"))
    return p.select(*[F.coalesce(F.col(f"`{k}`"), F.lit(DEFAULTS[k])).alias(k) for k in keys])
