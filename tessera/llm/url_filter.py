"""URL filters: pattern rules indexed by their rarest literal token (DataFrame operations only).

Host and path of a URL are cut into tokens (letters, digits and other non-separators). A rule's pattern must
contain certain whole tokens; the rule is filed under the one that the fewest of the URLs at hand have. The
tokens of a URL fetch the rules filed under them, and only those rules' regular expressions run.

Work is done on distinct URLs with their numbers of tokens; verdicts go back to the rows by salted joins, so a URL
that a third of the rows have is spread. Rules are a list in the program; their index is broadcast while
it has at most ``BROADCAST_RULES`` rows and joined by shuffle beyond.

Defined results: a URL that is null or has no ``://`` has an empty host and path, and no tokens, so no rule fits it;
of the fitting host rules the one with the longest text wins; else any fitting pattern rule with verdict block
blocks; else the URL is allowed. Repeated rows are judged each; an empty table gives an empty result; extra columns are not read.
"""

from __future__ import annotations

import re
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import ascii_lower

#: Most index rows that are broadcast (a few MB), and copies of a row's side in the salted join.
BROADCAST_RULES, SALTS = 50_000, 8

#: Between tokens. Whatever stands between two separators, or at an end, is a token.
SEPARATORS = r"[./\-_:@=&+%~,;]+"


@dataclass(frozen=True)
class Rule:
    """verdict: allow or block. pattern: a regular expression for host + path. literals: tokens that any URL it
    fits has. text: how a host rule is named in results; null for pattern rules."""

    verdict: str
    pattern: str
    literals: tuple[str, ...]
    text: str | None = None


def host_rule(verdict: str, text: str) -> Rule:
    """Fits the host and its subdomains if the path starts with the rule's, for example ``example.org/es/``."""
    host, slash, path = text.partition("/")
    # The end of the path may be the beginning of a longer token.
    whole = re.split(SEPARATORS, host) + re.split(SEPARATORS, slash + path)[1:-1]
    return Rule(verdict, rf"\A(?:[^/]*\.)?{re.escape(host)}{re.escape(slash + path)}", tuple(t for t in whole if t), text)


def word_rule(verdict: str, *tokens: str) -> Rule:
    """Fits hosts and paths that have the tokens one after the other, with one separator between two."""
    body = r"[.\-_]".join(map(re.escape, tokens))
    return Rule(verdict, rf"(?:\A|[./\-_:@=&+%~,;]){body}(?:\z|[./\-_:@=&+%~,;])", tokens)


#: The host rules of the contract.
HOST_RULES = (host_rule("allow", "org/"), host_rule("block", "example.org/es/"), host_rule("block", "example.org/en/1"),
              host_rule("allow", "com/fr/"), host_rule("block", "com/de/"))
#: Patterns of unwanted sites, judged where no host rule fits.
WORD_RULES = tuple(word_rule("block", *t.split()) for t in (
    "spam farm", "link farm", "cheap pills", "online casino", "free casino", "adult", "xxx", "porn", "payday loans", "replica watches", "warez", "torrent"))


def parts(url: Column) -> tuple[Column, Column]:
    """(host, path): both empty without ``://``."""
    rest = F.regexp_extract(F.coalesce(url, F.lit("")), r"(?s)^.*?://(.*)$", 1)
    host = F.regexp_extract(rest, r"(?s)^[^/?#]*", 0)
    return ascii_lower(host), F.regexp_extract(rest, r"(?s)^[^/?#]*([^?#]*)", 1)


def _tokens(host: Column, path: Column) -> Column:
    return F.filter(F.array_distinct(F.split(F.concat(host, F.lit("/"), path), SEPARATORS)), lambda t: t != "")


def index(spark: SparkSession, rules: tuple[Rule, ...], tokens: DataFrame) -> DataFrame:
    """(number, verdict, pattern, text, token): every rule under the one of its literals that the fewest URLs have.

    tokens: (token) for every distinct token of every URL.
    """
    if any(not r.literals for r in rules):
        raise ValueError("a rule without a literal token can't be indexed")
    rows = [(i, r.verdict, r.pattern, r.text, list(r.literals)) for i, r in enumerate(rules)]
    table = spark.createDataFrame(rows, "number int, verdict string, pattern string, text string, literals array<string>")
    options = table.withColumn("token", F.explode("literals")).drop("literals")
    wanted = F.broadcast(options.select("token").distinct()) if sum(len(r.literals) for r in rules) <= BROADCAST_RULES else options.select("token").distinct()
    counts = tokens.join(wanted, "token").groupBy("token").agg(F.count("*").alias("urls"))
    options = options.join(counts, "token", "left").withColumn("urls", F.coalesce("urls", F.lit(0)))
    rarest = options.groupBy("number").agg(F.min(F.struct("urls", "token")).alias("least"))
    return options.join(rarest, "number").where("token = least.token").drop("urls", "least").dropDuplicates(["number"])


def judged(df: DataFrame, id_col: str = "page_id", url_col: str = "url", host_rules: tuple[Rule, ...] = HOST_RULES, rules: tuple[Rule, ...] = WORD_RULES) -> DataFrame:
    """One row per input row: id, host, path, rule (the host rule that decides) and verdict."""
    spark = df.sparkSession
    all_rules = host_rules + rules
    host, path = parts(F.col(f"`{url_col}`"))
    rows = df.select(F.col(f"`{id_col}`").alias("id"), host.alias("host"), path.alias("path"))
    urls = rows.groupBy("host", "path").agg(F.count("*").alias("n"))
    tokens = urls.select("host", "path", F.explode(_tokens(F.col("host"), F.col("path"))).alias("token"))
    filed = index(spark, all_rules, tokens.select("token"))
    if len(all_rules) <= BROADCAST_RULES:
        filed = F.broadcast(filed)
    fits = tokens.join(filed, "token").where(F.rlike(F.concat("host", "path"), F.col("pattern")))
    best = fits.groupBy("host", "path").agg(
        F.max(F.when(F.col("text").isNotNull(), F.struct(F.length("text").alias("n"), "text", "verdict"))).alias("best"),
        F.coalesce(F.bool_or(F.when(F.col("text").isNull(), F.col("verdict") == "block")), F.lit(False)).alias("blocked"))
    verdict = F.coalesce(F.col("best.verdict"), F.when(F.col("blocked"), "block").otherwise("allow"))
    found = best.select("host", "path", F.col("best.text").alias("rule"), verdict.alias("verdict"))
    # Each verdict goes to a few salts, so that the rows of one URL are spread over as many tasks.
    found = found.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    salted = rows.withColumn("salt", F.pmod(F.xxhash64("id"), F.lit(SALTS)).cast("int"))
    out = salted.join(found, ["host", "path", "salt"], "left")
    return out.select(F.col("id").alias(id_col), "host", "path", "rule", F.coalesce("verdict", F.lit("allow")).alias("verdict"))
