"""tessera: GPU-host and LLM-serving telemetry analytics on PySpark.

Sub-packages:
  sources    -- table readers, telemetry fixture views, text/JSON ingest jobs
  functions  -- Column-expression builders (histogram math, time, bands, text)
  operators  -- DataFrame operators (tiers, history, counters, fleet, hardware, joins, state)
  plans      -- query registry, tier choice, oracle SQL used by the correctness gate
  streaming  -- Structured Streaming jobs (raw append, rollup, upsert, conflation)
"""

__all__ = ["session"]
