"""URL filter (operator 4), in DataFrame functions only: rules first, boosted trees for the rest.

A rule is a host and the beginning of a path, as in `net/es/`; it fits its host and all subdomains, and
the longest that fits decides. URLs that a rule decides are the labelled ones: on a bounded sample of
them trees are fitted on lexical features, and these judge all other URLs as one SQL expression.

Suffix statistics (how much of a host ending is blocked) are sums over all labelled URLs, combined before
the shuffle, so a hot host costs one row per task. They are joined back; Spark broadcasts that table if
it is small by its written size, and splits hot keys otherwise.

Defined cases: a null URL, or one without `://`, has empty host and path and no rule, and is judged by the
trees on an empty or its whole text; rows without an id and repeated rows are judged one by one; an empty
table gives an empty result; without labelled URLs of both kinds the trees are empty and their verdict
is the base rate's. Only the two columns are read.
"""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
from pyspark.sql import Column, DataFrame, functions as F

from plotweave.llm.boosting import Forest, fit_forest
from plotweave.session import cut

# Rules as (verdict, host and path).
RULES = (
    ("allow", "com/"),
    ("block", "example.com/en/"),
    ("allow", "www.example.com/en/"),
    ("block", "net/es/"),
    ("block", "net/fr/"),
)
# How many labelled URLs the trees are fitted on at most.
MAX_FIT_ROWS = 20_000
# Weight of the overall share in the share of a suffix.
PRIOR_ROWS = 10.0
FEATURES = (
    "length", "depth", "digit_ratio", "entropy", "params", "labels", "host_length", "hyphens", "path_length",
    "last_number", "ending_share", "domain_share",
)
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def host_of(url: Column) -> Column:
    after = F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)", 1)
    return F.coalesce(F.translate(after, _UPPER, _LOWER), F.lit(""))


def path_of(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(url, r"(?s)^.*?://[^/?#]*([^?#]*)", 1), F.lit(""))


def rule_of(host: Column, path: Column, rules: Sequence[tuple[str, str]] = RULES) -> tuple[Column, Column]:
    """The longest fitting rule and its verdict, null where none fits."""
    rule = verdict = None
    for says, text in sorted(rules, key=lambda r: (-len(r[1]), r[1])):
        own, _, rest = text.partition("/")
        fits = ((host == own) | host.endswith("." + own)) & path.startswith("/" + rest)
        rule = F.when(fits, text) if rule is None else rule.when(fits, text)
        verdict = F.when(fits, says) if verdict is None else verdict.when(fits, says)
    return (rule, verdict) if rule is not None else (F.lit(None).cast("string"), F.lit(None).cast("string"))


def _entropy(text: Column) -> Column:
    """Bits per character: lengths of equal runs among the sorted characters."""
    start = F.struct(F.lit("").alias("c"), F.lit(0).cast("long").alias("n"), F.lit(0.0).alias("s"))
    worth = lambda n: F.when(n > 0, n * F.log2(n.cast("double"))).otherwise(F.lit(0.0))
    step = lambda a, x: F.when(a["c"] == x, F.struct(x.alias("c"), (a["n"] + 1).alias("n"), a["s"].alias("s"))).otherwise(
        F.struct(x.alias("c"), F.lit(1).cast("long").alias("n"), (a["s"] + worth(a["n"])).alias("s"))
    )
    whole = F.length(text).cast("double")
    bits = F.aggregate(F.array_sort(F.split(text, "")), start, step, lambda a: a["s"] + worth(a["n"]))
    return F.when(whole > 0, F.log2(whole) - bits / whole).otherwise(F.lit(0.0))


def parsed(pages: DataFrame, rules: Sequence[tuple[str, str]] = RULES) -> DataFrame:
    """`(page_id, url, host, path, rule, ruled, ending, domain)`."""
    rows = pages.select(F.col("page_id"), F.col("url"), host_of(F.col("url")).alias("host"), path_of(F.col("url")).alias("path"))
    rule, ruled = rule_of(F.col("host"), F.col("path"), rules)
    ending = F.regexp_extract("host", r"([^.]*)$", 1)
    domain = F.regexp_extract("host", r"([^.]*\.?[^.]*)$", 1)
    return rows.withColumns({"rule": rule, "ruled": ruled, "ending": ending, "domain": domain})


def suffix_shares(rows: DataFrame) -> tuple[DataFrame, DataFrame, float]:
    """Labelled and blocked URLs per host ending and per domain, and the blocked share of all."""
    counts = F.count("*").alias("n"), F.sum((F.col("ruled") == "block").cast("long")).alias("blocked")
    labelled = rows.filter(F.col("ruled").isNotNull())
    domains = cut(labelled.groupBy("domain", "ending").agg(*counts), "domains")
    endings = cut(domains.groupBy("ending").agg(F.sum("n").alias("n"), F.sum("blocked").alias("blocked")), "endings")
    row = endings.agg(F.sum("n"), F.sum("blocked")).first()
    return endings, domains.drop("ending"), ((row[1] or 0) + 1) / ((row[0] or 0) + 2)


def with_features(rows: DataFrame, endings: DataFrame, domains: DataFrame, overall: float, own_label: bool = False) -> DataFrame:
    """Rows with all features. `own_label` takes a row's own label out of its suffix shares, for fitting."""
    url = F.coalesce(F.col("url"), F.lit(""))
    per = lambda pattern: F.regexp_count(url, F.lit(pattern)).cast("double")
    length = F.length(url).cast("double")
    query = F.regexp_extract(url, r"(?s)\?([^#]*)", 1)
    blocked = (F.col("ruled") == "block").cast("long") if own_label else F.lit(0)
    counted = F.lit(1) if own_label else F.lit(0)

    def share(n: str, b: str) -> Column:
        total, hits = F.coalesce(F.col(n), F.lit(0)), F.coalesce(F.col(b), F.lit(0))
        return (hits - blocked + PRIOR_ROWS * overall) / (total - counted + PRIOR_ROWS)

    joined = rows.join(endings.select("ending", F.col("n").alias("_en"), F.col("blocked").alias("_eb")), "ending", "left")
    joined = joined.join(domains.select("domain", F.col("n").alias("_dn"), F.col("blocked").alias("_db")), "domain", "left")
    return joined.select(
        "page_id", "url", "host", "path", "rule", "ruled",
        length.alias("length"),
        F.regexp_count("path", F.lit("/[^/]+")).cast("double").alias("depth"),
        (per("[0-9]") / F.greatest(length, F.lit(1.0))).alias("digit_ratio"),
        _entropy(url).alias("entropy"),
        F.regexp_count(query, F.lit("[^&]+")).cast("double").alias("params"),
        F.regexp_count("host", F.lit(r"[^.]+")).cast("double").alias("labels"),
        F.length("host").cast("double").alias("host_length"),
        F.regexp_count("host", F.lit("-")).cast("double").alias("hyphens"),
        F.length("path").cast("double").alias("path_length"),
        F.length(F.regexp_extract("path", r"([0-9]*)[^0-9]*$", 1)).cast("double").alias("last_number"),
        share("_en", "_eb").alias("ending_share"),
        share("_dn", "_db").alias("domain_share"),
    )


def fit(rows: DataFrame, endings: DataFrame, domains: DataFrame, overall: float, max_rows: int = MAX_FIT_ROWS) -> Forest:
    """Trees for the chance that a URL is blocked, from at most `max_rows` different labelled ones in hash order."""
    # a URL counts once, however many rows it has; everything else follows from it
    known = rows.filter(F.col("ruled").isNotNull()).groupBy("url").agg(*[F.min(c).alias(c) for c in ("host", "path", "rule", "ruled", "ending", "domain")])
    sample = known.withColumn("page_id", F.lit(None).cast("long")).orderBy(F.xxhash64("url"), "url").limit(max_rows)
    chosen = with_features(sample, endings, domains, overall, own_label=True)
    got = chosen.select("url", (F.col("ruled") == "block").cast("double").alias("y"), *FEATURES).orderBy("url", "y").collect()
    x = np.array([[r[f] for f in FEATURES] for r in got], float).reshape(-1, len(FEATURES))
    return fit_forest(x, np.array([r["y"] for r in got], float), trees=30, depth=3)


def judge_urls(pages: DataFrame, rules: Sequence[tuple[str, str]] = RULES, max_rows: int = MAX_FIT_ROWS) -> DataFrame:
    """`(page_id, host, path, rule, verdict, score)`; the score is the trees' chance of a block."""
    rows = parsed(pages, rules)
    endings, domains, overall = suffix_shares(rows)
    forest = fit(rows, endings, domains, overall, max_rows)
    margin = F.lit(forest.base)
    for tree in forest.sql(FEATURES):
        margin = margin + F.expr(tree)
    scored = with_features(rows, endings, domains, overall).withColumn("score", F.round(1 / (1 + F.exp(-margin)), 9))
    verdict = F.coalesce(F.col("ruled"), F.when(F.col("score") >= 0.5, "block").otherwise("allow"))
    return scored.select("page_id", "host", "path", "rule", verdict.alias("verdict"), "score")


def op4_url_filter(spark, folder: str) -> DataFrame:
    """Verdicts for the URLs of all pages."""
    return judge_urls(spark.read.parquet(f"{folder}/pages.parquet"))
