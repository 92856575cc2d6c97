"""Catalogue lookups (model pricing), request routing and request-span windows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources import fixtures as fx
from ..sources import tables

# Characters of the gram that candidates for containment must share.
GRAM = 4


def request_union(spans: DataFrame, span_ms: int = 300_000) -> DataFrame:
    """All engines' request spans whose end is within ``span_ms`` of the latest end."""
    latest = spans.agg(F.max("end_ms").alias("_latest"))  # one-row scalar
    return spans.crossJoin(latest).where(F.col("end_ms") >= F.col("_latest") - span_ms).drop("_latest")


def _substrings(text: Column, sizes: range) -> Column:
    """The text's distinct substrings of the sizes."""
    def of(k: int) -> Column:
        found = F.transform(F.sequence(F.lit(1), F.length(text) - k + 1), lambda i: F.substr(text, i, F.lit(k)))
        return F.when(F.length(text) >= k, found).otherwise(F.array().cast("array<string>"))

    return F.array_distinct(F.concat(*[of(k) for k in sizes]))


def _candidates(outer: DataFrame, inner: DataFrame, a: str, b: str) -> DataFrame:
    """Pairs (a, b) that may be contained: ``b`` is looked up by its gram that the fewest of the ``a`` have.

    A part that all texts share, such as a provider's prefix, is never the key of
    a text that has anything else. Texts shorter than a gram are looked up
    whole; an empty one is in every text.
    """
    keys = outer.select(a).distinct().withColumn("_key", F.explode(F.concat(F.array(F.lit("")), _substrings(F.col(a), range(1, GRAM + 1)))))
    counts = keys.where(F.length("_key") == GRAM).groupBy("_key").agg(F.count("*").alias("_n"))
    texts = inner.select(b).distinct()
    grams = texts.where(F.length(b) >= GRAM).select(b, F.explode(_substrings(F.col(b), range(GRAM, GRAM + 1))).alias("_key"))
    # A gram that no outer text has rules its text out: it counts 0 and finds nobody.
    rarest = grams.join(counts, "_key", "left").groupBy(b).agg(F.min(F.struct(F.coalesce("_n", F.lit(0)).alias("n"), F.col("_key").alias("key"))).alias("_r")).select(b, F.col("_r.key").alias("_key"))
    short = texts.where(F.length(b) < GRAM).select(b, F.col(b).alias("_key"))
    return keys.join(rarest.unionByName(short), "_key").select(a, b)


def _containing(outer: DataFrame, inner: DataFrame, a: str, b: str) -> DataFrame:
    """Pairs of distinct texts where ``outer.a`` contains ``inner.b``: the candidates, verified."""
    return _candidates(outer, inner, a, b).where(F.col(a).contains(F.col(b)))


def pricing_lookup(models: DataFrame, catalogue: DataFrame) -> DataFrame:
    """Model -> (prompt, completion) price per million tokens.

    Pass 1: first catalogue row (by ``seq``) whose id equals, is contained
    in, or contains the model id; pass 2: first row containing the short
    name. Rows lacking either price string are skipped; an unparsable
    price is 0. The catalogue is first reduced to the first row of each id;
    containment goes by equality joins on leading keys, so no side is
    broadcast by assumption and no plan compares all with all.
    """
    m = models.select(F.lower("model_id").alias("model_id")).distinct()
    m = m.withColumn("short", F.substring_index("model_id", "/", -1))
    rate = lambda c: (F.coalesce(F.col(c).try_cast("double"), F.lit(0.0)) * 1e6)
    cat = catalogue.where(F.col("prompt").isNotNull() & F.col("completion").isNotNull())
    cat = cat.groupBy(F.lower("id").alias("id")).agg(
        F.min("seq").alias("seq"), F.min_by(F.struct(rate("prompt").alias("prompt_rate"), rate("completion").alias("gen_rate")), "seq").alias("rates"))
    both = _containing(m, cat, "model_id", "id").unionByName(_containing(cat, m, "id", "model_id"))
    p1 = both.join(cat, "id").groupBy("model_id").agg(F.min_by("rates", "seq").alias("p1"))
    p2 = _containing(cat, m, "id", "short").join(cat, "id").groupBy("short").agg(F.min_by("rates", "seq").alias("p2"))
    j = m.join(p1, "model_id", "left").join(p2, "short", "left")
    return j.select(
        "model_id",
        F.coalesce("p1.prompt_rate", "p2.prompt_rate").alias("prompt_rate"),
        F.coalesce("p1.gen_rate", "p2.gen_rate").alias("gen_rate"),
        F.when(F.col("p1").isNotNull(), "match").when(F.col("p2").isNotNull(), "partial").alias("source"),
    )


def _catalogue_sql(d) -> str:
    mc = d.model_case("p_partkey % 8")
    s = f"""SELECT p_partkey AS seq,
  CASE p_partkey % 4 WHEN 0 THEN {mc} WHEN 1 THEN 'router/' || {mc} WHEN 2 THEN 'x-' || lower(replace(p_brand, '#', '')) || '/' || p_name
       ELSE lower(replace(p_brand, '#', '-')) || '/' || replace(p_name, ' ', '-') END AS id,
  CASE WHEN p_partkey % 17 = 0 THEN NULL WHEN p_partkey % 13 = 0 THEN 'n/a' ELSE '0.0000' || CAST(p_size AS STRING) END AS prompt,
  CASE WHEN p_partkey % 19 = 0 THEN NULL ELSE '0.000' || CAST(p_size AS STRING) END AS completion
FROM {d.t('part')}"""
    return s.replace("STRING", "VARCHAR" if d.name == "duckdb" else "STRING")


def pricing_query(spark: SparkSession, sf: str) -> DataFrame:
    cat = spark.sql(_catalogue_sql(fx.SPARK), part=tables.read(spark, sf, "part", "p_partkey", "p_brand", "p_name", "p_size"))
    models = fx.engine_snapshots(spark, sf).where(F.col("model_name").isNotNull()).select(F.col("model_name").alias("model_id"))
    return pricing_lookup(models, cat.where(F.col("id").isNotNull()))


def pricing_oracle_sql() -> str:
    return fx.duck_cte("engine_snapshots").rstrip("\n") + f""",
cat AS (SELECT seq, lower(id) AS id, COALESCE(TRY_CAST(prompt AS DOUBLE), 0) * 1e6 AS prompt_rate,
          COALESCE(TRY_CAST(completion AS DOUBLE), 0) * 1e6 AS gen_rate
        FROM ({_catalogue_sql(fx.DUCK)}) c WHERE prompt IS NOT NULL AND completion IS NOT NULL AND id IS NOT NULL),
m AS (SELECT DISTINCT lower(model_name) AS model_id, split_part(lower(model_name), '/', -1) AS short FROM engine_snapshots WHERE model_name IS NOT NULL),
p1 AS (SELECT m.model_id, arg_min(cat.prompt_rate, cat.seq) AS pr, arg_min(cat.gen_rate, cat.seq) AS gr FROM m JOIN cat
        ON cat.id = m.model_id OR contains(m.model_id, cat.id) OR contains(cat.id, m.model_id) GROUP BY 1),
p2 AS (SELECT m.model_id, arg_min(cat.prompt_rate, cat.seq) AS pr, arg_min(cat.gen_rate, cat.seq) AS gr FROM m JOIN cat
        ON contains(cat.id, m.short) GROUP BY 1)
SELECT m.model_id, COALESCE(p1.pr, p2.pr) AS prompt_rate, COALESCE(p1.gr, p2.gr) AS gen_rate,
  CASE WHEN p1.model_id IS NOT NULL THEN 'match' WHEN p2.model_id IS NOT NULL THEN 'partial' END AS source
FROM m LEFT JOIN p1 USING (model_id) LEFT JOIN p2 USING (model_id)
"""


# ---------------------------------------------------------------- routing

MODEL_RE = r'"model"\s*:\s*"([^"]+)"'


ID_RE = r"^/v1/models/([^/]+)$"


def route_resolve(requests: DataFrame, served: DataFrame) -> DataFrame:
    """Outcome per request: ``missing_model`` 400, ``model_not_found`` 404, else ``upstream`` 200; ``by_id`` tells its kind.

    A request names its model in its path (``/v1/models/{id}``) or in its JSON body, with a
    regex fallback for loose JSON; lookup is case-insensitive against the
    served-model list, whose size Spark's own estimate judges for a broadcast.
    """
    js = F.get_json_object("body", "$.model")
    rx = F.regexp_extract("body", MODEL_RE, 1)
    by_id = F.coalesce(F.col("path").rlike(ID_RE), F.lit(False))
    model = F.when(by_id, F.regexp_extract("path", ID_RE, 1)).otherwise(F.coalesce(js, F.when(rx != "", rx)))
    r = requests.withColumn("by_id", by_id).withColumn("model_lc", F.lower(model))
    s = served.select(F.lower("model").alias("model_lc")).distinct().withColumn("_served", F.lit(True))
    j = r.join(s, "model_lc", "left")
    outcome = (F.when(F.col("model_lc").isNull(), "missing_model")
               .when(F.col("_served").isNull(), "model_not_found").otherwise("upstream"))
    status = F.when(F.col("model_lc").isNull(), 400).when(F.col("_served").isNull(), 404).otherwise(200)
    return j.withColumn("outcome", outcome).withColumn("status", status).drop("_served")


def outcome_counts(routed: DataFrame) -> DataFrame:
    """Requests per kind and outcome."""
    return routed.groupBy("by_id", "outcome", "status").agg(F.count("*").alias("n_requests"))


def _requests_sql(d) -> str:
    mc = d.model_case("conv_id % 8")
    q = '\'"\''
    s = f"""SELECT conv_id, turn, CASE turn % 5
    WHEN 0 THEN chr(123) || '"model": ' || {q} || COALESCE({mc}, '') || {q} || ', "stream": true' || chr(125)
    WHEN 1 THEN chr(123) || '"model" : ' || {q} || COALESCE({mc}, 'x') || {q} || ', ' || chr(125)
    WHEN 2 THEN chr(123) || '"messages": []' || chr(125)
    WHEN 3 THEN chr(123) || '"model": "unknown-' || CAST(conv_id % 3 AS STRING) || '"' || chr(125)
    ELSE chr(123) || '"model":"' || upper(COALESCE({mc}, 'y')) || '"' || chr(125) END AS body,
  CASE WHEN turn % 4 = 3 THEN '/v1/models/' || CASE WHEN conv_id % 2 = 0 THEN upper(replace(COALESCE({mc}, 'z'), '/', '-')) ELSE replace(COALESCE({mc}, 'z'), '/', '-') END
    ELSE '/v1/chat/completions' END AS path
FROM {d.t('conversations')}"""
    return s.replace("STRING", "VARCHAR" if d.name == "duckdb" else "STRING")


def route_query(spark: SparkSession, sf: str) -> DataFrame:
    req = spark.sql(_requests_sql(fx.SPARK), conversations=tables.read(spark, sf, "conversations", "conv_id", "turn"))
    served = fx.engine_snapshots(spark, sf).where(F.col("model_name").isNotNull()).select(F.col("model_name").alias("model"))
    routed = route_resolve(req, served)
    return routed.select("conv_id", "turn", "by_id", "model_lc", "outcome", "status").join(outcome_counts(routed), ["by_id", "outcome", "status"])


def route_oracle_sql() -> str:
    return fx.duck_cte("engine_snapshots").rstrip("\n") + f""",
r AS ({_requests_sql(fx.DUCK)}),
q AS (SELECT *, regexp_matches(path, '{ID_RE}') AS by_id FROM r),
p AS (SELECT conv_id, turn, by_id, lower(CASE WHEN by_id THEN regexp_extract(path, '{ID_RE}', 1) ELSE COALESCE(CASE WHEN json_valid(body) THEN json_extract_string(body, '$.model') END,
        NULLIF(regexp_extract(body, '{MODEL_RE}', 1), '')) END) AS model_lc FROM q),
s AS (SELECT DISTINCT lower(model_name) AS model_lc FROM engine_snapshots WHERE model_name IS NOT NULL),
o AS (SELECT p.conv_id, p.turn, by_id, p.model_lc,
  CASE WHEN p.model_lc IS NULL THEN 'missing_model' WHEN s.model_lc IS NULL THEN 'model_not_found' ELSE 'upstream' END AS outcome,
  CASE WHEN p.model_lc IS NULL THEN 400 WHEN s.model_lc IS NULL THEN 404 ELSE 200 END AS status
FROM p LEFT JOIN s ON p.model_lc = s.model_lc)
SELECT *, count(*) OVER (PARTITION BY by_id, outcome) AS n_requests FROM o
"""
