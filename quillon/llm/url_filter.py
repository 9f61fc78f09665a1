"""URL filter: host-suffix and path-prefix expressions against hashed rules.

Each URL is expanded into every (host suffix, path prefix) expression that a rule could
name: suffixes and prefixes as deep as the deepest rule. Expressions and rules meet in an equi-join on the first ``PREFIX`` hex digits of
their SHA-256; full digests confirm. Of the rules that fit, the longest wins (host and
path together; then the longer host; then block over allow).

Where no rule fits, the method judges by listed terms: the host's labels, split at
hyphens, are expanded and hashed in the same way. A listed term or an empty host blocks.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillon.llm.exprs import ascii_lower

PREFIX = 8
#: Up to so many rules (about 200 bytes each) are broadcast; more are joined by shuffle.
BROADCAST_RULES = 50_000
SALTS = 16

# fixed values: the rules of the query
RULES = [
    ("com", "/", "allow"),
    ("example.com", "/en/", "block"),
    ("www.example.com", "/en/", "allow"),
    ("net", "/es/", "block"),
    ("net", "/fr/", "block"),
]
# fixed values: terms of host labels
TERMS = ["adult", "bets", "betting", "casino", "malware", "phishing", "porn", "spam", "warez", "xxx"]


def rule_table(spark: SparkSession, rules: list[tuple[str, str, str]]) -> DataFrame:
    if not rules:
        return spark.range(0).selectExpr("'' AS rule_host", "'' AS rule_path", "'' AS rule_verdict")
    rows = [F.struct(F.lit(h).alias("rule_host"), F.lit(p).alias("rule_path"), F.lit(v).alias("rule_verdict")) for h, p, v in rules]
    return spark.range(1).select(F.inline(F.array(*rows)))


def judge_urls(pages: DataFrame, rules: DataFrame, terms: list[str], id_col: str = "page_id", url_col: str = "url") -> DataFrame:
    """One row (page_id, host, path, rule, verdict) per row of ``pages``.

    A null URL or one without ``://`` has an empty host and path, no rule, and is blocked.
    Repeated rows and null ids are judged row by row. Other columns are not read.
    ``rules`` has rule_host, rule_path, rule_verdict; rows with a null are ignored, and of
    two that differ in the verdict only, block holds. A very long URL makes no more expressions
    than the deepest rule has suffixes and prefixes, and one for each of its host's words.
    Empty tables give no rows.
    """
    spark = pages.sparkSession
    rules = rules.dropna().dropDuplicates()
    listed = rules.select(
        F.concat("rule_host", "rule_path").alias("what"), F.length("rule_host").alias("host_size"), "rule_verdict", F.lit(1).alias("level")
    )
    named = spark.range(1).select(
        F.explode(F.array(*[F.lit(f"term:{t}") for t in terms]) if terms else F.array().cast("array<string>")).alias("what"),
        F.lit(0).alias("host_size"), F.lit("block").alias("rule_verdict"), F.lit(0).alias("level"),
    )
    known = listed.unionByName(named).select(
        F.substring(F.sha2("what", 256), 1, PREFIX).alias("prefix"), F.sha2("what", 256).alias("digest"), "*"
    )
    # prefixes that do not end at a slash, by length: as many as such rules have lengths
    lengths = sorted(
        r[0] for r in rules.where("rule_path != '' and not endswith(rule_path, '/')").select(F.length("rule_path")).distinct().collect()
    )

    # no rule has more labels or steps than these, so a url is expanded no further
    slashes = F.length("rule_path") - F.length(F.replace("rule_path", F.lit("/"), F.lit("")))
    deepest = rules.agg(F.max(F.size(F.split("rule_host", r"\."))).alias("labels"), F.max(slashes).alias("steps")).first()
    most_labels, most_steps = deepest["labels"] or 0, deepest["steps"] or 0

    url = F.coalesce(F.col(url_col), F.lit(""))
    parts = r"(?s)^.*?://([^/?#]*)([^?#]*)"
    split = pages.select(
        F.monotonically_increasing_id().alias("row"),
        F.col(id_col).alias("page_id"),
        ascii_lower(F.regexp_extract(url, parts, 1)).alias("host"),
        F.regexp_extract(url, parts, 2).alias("path"),
    )
    labels = split.withColumn("labels", F.split("host", r"\.", -1)).withColumn("steps", F.split("path", "/", -1))
    hosts = F.transform(
        F.sequence(F.greatest(F.lit(1), F.size("labels") - max(most_labels, 1) + 1), F.size("labels")), lambda i: F.array_join(F.slice("labels", i, F.size("labels")), ".")
    )
    whole_steps = F.when(
        (F.size("steps") > 1) & (F.lit(most_steps) > 0),
        F.transform(F.sequence(F.lit(1), F.least(F.size("steps") - 1, F.lit(max(most_steps, 1)))), lambda i: F.concat(F.array_join(F.slice("steps", F.lit(1), i), "/"), F.lit("/"))),
    ).otherwise(F.array().cast("array<string>"))
    inner = F.array(*[F.substring("path", 1, n) for n in lengths]) if lengths else F.array().cast("array<string>")
    paths = F.array_distinct(F.concat(F.array(F.lit(""), F.col("path")), whole_steps, inner))
    pairs = F.flatten(F.transform(hosts, lambda h: F.transform(paths, lambda p: F.concat(h, p))))
    words = F.transform(F.array_distinct(F.split("host", r"[.-]", -1)), lambda t: F.concat(F.lit("term:"), t))
    what = F.explode(F.concat(pairs, words)).alias("what")
    wide = labels.select("row", "page_id", "host", "path", what).select(
        "*", F.sha2("what", 256).alias("digest")
    ).withColumn("prefix", F.substring("digest", 1, PREFIX)).drop("what")

    if known.limit(BROADCAST_RULES + 1).count() <= BROADCAST_RULES:
        met = wide.join(F.broadcast(known.withColumnRenamed("digest", "full")), "prefix", "left")
    else:
        salted = known.withColumnRenamed("digest", "full").withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
        met = wide.withColumn("salt", F.pmod(F.col("row"), F.lit(SALTS)).cast("int")).join(salted, ["prefix", "salt"], "left")
    fits = F.when(
        F.col("full") == F.col("digest"), F.struct("level", F.length("what").alias("size"), "host_size", "rule_verdict", "what")
    )
    best = met.groupBy("row", "page_id", "host", "path").agg(F.max(fits).alias("best"))
    return best.select(
        "page_id",
        "host",
        "path",
        F.when(F.col("best.level") == 1, F.col("best.what")).alias("rule"),
        F.when(F.col("host") == "", "block").otherwise(F.coalesce("best.rule_verdict", F.lit("allow"))).alias("verdict"),
    )


ORACLE_SQL = r"""
WITH u AS (
  SELECT page_id,
         translate(regexp_extract(coalesce(url, ''), '(?s)^.*?://([^/?#]*)([^?#]*)', 1),
                   'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
         regexp_extract(coalesce(url, ''), '(?s)^.*?://([^/?#]*)([^?#]*)', 2) AS path
  FROM pages),
rules(rh, rp, rv) AS (VALUES ('com', '/', 'allow'), ('example.com', '/en/', 'block'),
  ('www.example.com', '/en/', 'allow'), ('net', '/es/', 'block'), ('net', '/fr/', 'block')),
judged AS (
  SELECT u.*,
    (SELECT max(struct_pack(a := length(rh || rp), b := length(rh), v := rv, r := rh || rp)) FROM rules
      WHERE (host = rh OR ends_with(host, '.' || rh)) AND starts_with(path, rp)) AS best
  FROM u)
SELECT page_id, host, path, best.r AS rule,
  CASE WHEN host = '' THEN 'block' WHEN best IS NOT NULL THEN best.v
       WHEN list_has_any(string_split_regex(host, '[.-]'),
            ['adult', 'bets', 'betting', 'casino', 'malware', 'phishing', 'porn', 'spam', 'warez', 'xxx']) THEN 'block'
       ELSE 'allow' END AS verdict
FROM judged
"""
