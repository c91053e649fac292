"""URL filter: listed rules first, then logistic regression on hashed character n-grams.

All of it is DataFrame and SQL functions: n-grams are substrings by position, hashed into a fixed
number of buckets; the weights are one constant array in the plan, and a url's margin is the sum of
its elements at the url's buckets. Training repeats one small aggregation (the gradient by bucket)
over a labelled table of a few hundred urls; only the gradient, one number a bucket, reaches the driver.

Defined results: a null url, or one without `://`, has an empty host and path, fits no rule and is
judged by the method on its empty features (the bias: allow). A score of exactly 0.5 allows; of rules of
equal length the one listed later counts. Repeated rows are judged alike. Very long urls are judged whole. Other columns are ignored. An empty table gives no rows.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from assurelake.llm.common import cut, table

BUCKETS = 1 << 11
ORDERS = (3, 4, 5)

# Fixed values: (verdict, host, start of path)
RULES = (("allow", "org", "/"), ("block", "example.org", "/es/"), ("block", "example.org", "/en/1"), ("allow", "com", "/fr/"), ("block", "com", "/de/"))

# Names of sites that the labelled urls are made of
BLOCKED = (
    "casino casino-win online-casino free-bets bets betting sports-bet cheap-pills pills diet-pills viagra cialis poker slots jackpot loans payday-loans "
    "porn xxx-videos adult hot-singles escorts lottery lotto-win roulette replica-watches miracle-diet get-rich double-crypto free-iphone win-prizes "
    "warez cracked-games hack-tools pharmacy-discount cheap-meds fast-cash big-bonus free-spins "
    "ads ads-track ad-server click-ads tracker adult-x adult-dating"
)
ALLOWED = (
    "news daily-news blog wiki library university museum weather recipes garden travel science science-daily docs research school city city-guide health history music sport "
    "forum support developer open-data bookshop journal archive kitchen family photo old-town north-river green-energy radio theatre railway mountain "
    "painting language teaching author other-voices northern-lights thesis-archive stone-bridge world-atlas thunder weather-station tradition"
)
HOSTS = ("{0}.example.com", "www.{0}.example.net", "m.{0}.example.org", "blog.{0}.com", "{0}.net", "{0}24.org")
PATHS = ("", "/", "/en/{1}", "/de/{1}.html", "/fr/{1}/", "/es/{1}")


def labelled_urls(spark: SparkSession) -> DataFrame:
    """(url, label): every site name under every host form, the forms of path in turn; 1 is block."""
    names = [(n, 1) for n in BLOCKED.split()] + [(n, 0) for n in ALLOWED.split()]
    rows = [
        ("https://" + (host + PATHS[(i + j) % len(PATHS)]).format(name, 37 * i + 11 * j), y) for i, (name, y) in enumerate(names) for j, host in enumerate(HOSTS)
    ]
    return spark.createDataFrame(rows, "url string, label int")


def host_of(url: Column) -> Column:
    upper = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
    return F.translate(F.regexp_extract(F.coalesce(url, F.lit("")), r"(?s)^.*?://([^/?#]*)", 1), upper, upper.lower())


def path_of(url: Column) -> Column:
    return F.regexp_extract(F.coalesce(url, F.lit("")), r"(?s)^.*?://[^/?#]*([^?#]*)", 1)


def rule_of(host: Column, path: Column, rules=RULES) -> tuple[Column, Column]:
    """(rule, verdict) of the longest rule that fits; null if none does."""
    rule, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for v, h, p in sorted(rules, key=lambda r: len(r[1] + r[2])):  # the longest is asked first
        fits = ((host == h) | host.endswith("." + h)) & path.startswith(p)
        rule, verdict = F.when(fits, h + p).otherwise(rule), F.when(fits, v).otherwise(verdict)
    return rule, verdict


def buckets_of(host: Column, path: Column, buckets: int = BUCKETS) -> Column:
    """The distinct buckets of the n-grams of host and path, each between its own marks."""

    def grams(s: Column, mark: str, n: int) -> Column:
        s = F.concat(F.lit(mark), s, F.lit(mark))
        some = F.transform(F.sequence(F.lit(1), F.greatest(F.length(s) - (n - 1), F.lit(1))), lambda i: F.pmod(F.xxhash64(F.lit(mark), F.substr(s, i, F.lit(n))), F.lit(buckets)).cast("int"))
        return F.when(F.length(s) >= n, some).otherwise(F.array().cast("array<int>"))

    return F.array_distinct(F.concat(*[grams(s, m, n) for s, m in ((host, "^"), (path, "/")) for n in ORDERS]))


def constant(weights: list[float]) -> Column:
    """The weights as one constant of the plan."""
    return F.expr("array(" + ",".join(f"{w:.6f}D" for w in weights) + ")")


def margin(grams: Column, weights: list[float], bias: float) -> Column:
    w = constant(weights)
    return F.aggregate(grams, F.lit(bias), lambda a, g: a + F.get(w, g))


def train(labelled: DataFrame, buckets: int = BUCKETS, rounds: int = 25, rate: float = 0.5, decay: float = 1e-3) -> tuple[list[float], float]:
    """(weights, bias) by gradient steps with per-weight rates, from a small table (url, label)."""
    host, path = host_of(F.col("url")), path_of(F.col("url"))
    rows = cut(labelled.select(buckets_of(host, path, buckets).alias("g"), F.col("label").cast("double").alias("y")), "url-labels").coalesce(1)  # one partition: a round needs no shuffle
    n = max(1, rows.count())
    weights, bias = [0.0] * buckets, 0.0
    seen, seen_bias = [1e-8] * buckets, 1e-8
    for _ in range(rounds):
        error = 1 / (1 + F.exp(-margin(F.col("g"), weights, bias))) - F.col("y")
        step = rows.select(error.alias("e"), "g").select("e", F.explode(F.concat("g", F.array(F.lit(buckets)))).alias("b"))
        for b, g in step.groupBy("b").agg((F.sum("e") / n).alias("d")).collect():  # a number a bucket
            if b == buckets:
                seen_bias += g * g
                bias -= rate * g / math.sqrt(seen_bias)
            else:
                g += decay * weights[b]
                seen[b] += g * g
                weights[b] -= rate * g / math.sqrt(seen[b])
    return weights, bias


def judge(pages: DataFrame, weights: list[float], bias: float, key_col: str = "page_id", url_col: str = "url", rules=RULES) -> DataFrame:
    """key, host, path, rule, verdict and the method's probability of block."""
    rows = pages.select(F.col(key_col), host_of(F.col(url_col)).alias("host"), path_of(F.col(url_col)).alias("path"))
    rule, verdict = rule_of(F.col("host"), F.col("path"), rules)
    score = 1 / (1 + F.exp(-margin(buckets_of(F.col("host"), F.col("path"), len(weights)), weights, bias)))
    rows = rows.select("*", rule.alias("rule"), verdict.alias("_v"), score.alias("block_score"))
    own = F.when(F.col("block_score") > 0.5, "block").otherwise("allow")
    return rows.select(key_col, "host", "path", "rule", F.coalesce("_v", own).alias("verdict"), "block_score")


def op2_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The verdict on every page's url."""
    weights, bias = train(labelled_urls(spark))
    return judge(table(spark, sf_dir, "pages"), weights, bias)


def url_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Host, path and rule of every page, and the verdict where a rule has one: what SQL can say of op2."""
    ruled = judge(table(spark, sf_dir, "pages"), [0.0], 0.0)
    return ruled.select("page_id", "host", "path", "rule", F.when(F.col("rule").isNotNull(), F.col("verdict")).alias("rule_verdict"))


def _fits(host: str, path: str) -> str:
    return f"((host = '{host}' OR ends_with(host, '.{host}')) AND starts_with(path, '{path}'))"


URL_RULES_SQL = f"""
WITH r AS (SELECT page_id, CASE WHEN strpos(url, '://') > 0 THEN substr(url, strpos(url, '://') + 3) ELSE '' END AS rest FROM pages),
h AS (SELECT page_id, regexp_extract(rest, '^[^/?#]*') AS host, rest FROM r),
p AS (SELECT page_id, translate(host, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host, regexp_extract(substr(rest, length(host) + 1), '^[^?#]*') AS path FROM h),
j AS (SELECT *, CASE WHEN {_fits("example.org", "/en/1")} THEN 'example.org/en/1' WHEN {_fits("example.org", "/es/")} THEN 'example.org/es/'
  WHEN {_fits("com", "/fr/")} THEN 'com/fr/' WHEN {_fits("com", "/de/")} THEN 'com/de/' WHEN {_fits("org", "/")} THEN 'org/' END AS rule FROM p)
SELECT *, CASE WHEN rule IN ('org/', 'com/fr/') THEN 'allow' WHEN rule IS NOT NULL THEN 'block' END AS rule_verdict FROM j
"""
