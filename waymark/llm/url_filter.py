"""Operator 8: URL filters by association rules, in DataFrame functions only.

A list of host/path rules decides first. Its verdicts, and "open" for the URLs that it leaves open, are the labels: Spark's
FP-growth mines which combinations of URL tokens go with block or allow among all URLs, so that a token which open URLs have too
can't carry a verdict by itself. Rules are pruned by support, confidence and redundancy, and an inverted index from token to rule
matches them against the distinct token sets of the open URLs.
"""

from __future__ import annotations

from pyspark.ml.fpm import FPGrowth
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from waymark.llm.common import spread_join, table

RULES = (("allow", "com/"), ("block", "example.com/en/"), ("allow", "www.example.com/en/"), ("block", "net/es/"), ("block", "net/fr/"))
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def parts(url: Column) -> tuple[Column, Column]:
    """Host (A-Z lower-cased) and path; both empty for null or a url without ://."""
    rest = F.when(F.locate("://", url) > 0, F.expr("substring(_url, locate('://', _url) + 3)")).otherwise("")
    host = F.translate(F.regexp_extract(rest, r"^([^/?#]*)", 1), UPPER, LOWER)
    return host, F.regexp_extract(rest, r"^[^/?#]*([^?#]*)", 1)


def split_rule(rule: str) -> tuple[str, str]:
    host, slash, path = rule.partition("/")
    return host.lower(), slash + path


def listed(host: Column, path: Column, rules) -> tuple[Column, Column]:
    """Rule and verdict of the longest rule that fits."""
    rule, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for what, text in sorted(rules, key=lambda r: (len(r[1]), r[1])):  # the last one that fits stands outermost
        h, p = split_rule(text)
        fits = ((host == h) | host.endswith(f".{h}")) & path.startswith(p)
        rule, verdict = F.when(fits, text).otherwise(rule), F.when(fits, what).otherwise(verdict)
    return rule, verdict


OPEN = "open"


def tokens(host: Column, path: Column, url: Column) -> Column:
    """Distinct tokens of a url: labels of the host, words in labels of several, words of the path, names of the query; no bare numbers."""
    words = lambda c, pattern, sign: F.transform(F.filter(F.split(F.lower(c), pattern), lambda t: (F.length(t) > 0) & ~t.rlike("^[0-9]+$")), lambda t: F.concat(F.lit(sign), t))
    several = F.array_join(F.filter(F.split(F.lower(host), r"\."), lambda t: t.contains("-")), "-")
    query = F.regexp_extract(url, r"\?([^#]*)", 1)
    names = F.transform(F.split(query, "&"), lambda t: F.regexp_extract(t, "^([^=]*)", 1))
    return F.array_distinct(F.concat(words(host, r"\.", "h:"), words(several, "-", "w:"), words(path, r"[/.\-_]", "p:"), F.transform(F.filter(names, lambda t: F.length(t) > 0), lambda t: F.concat(F.lit("q:"), t))))


def frequent_items(labelled: DataFrame, min_support: float) -> list[str]:
    """Tokens with the support, one for each group of tokens that occur in just the same rows: the first by text.

    At most tokens-per-url / min_support tokens are frequent, so what comes to the driver is bounded by parameters and not by rows.
    Tokens that always go together would give all their combinations as item sets, and none tells more than one of them.
    """
    rows = labelled.select(F.explode("tokens").alias("token"), "id")
    each = rows.groupBy("token").agg(F.count(F.lit(1)).alias("n"), F.sum(F.xxhash64("id").cast("decimal(38,0)")).alias("where"))
    least = F.lit(min_support) * labelled.count()
    return sorted(r[0] for r in each.where(F.col("n") >= least).groupBy("n", "where").agg(F.min("token").alias("token")).select("token").collect())


def mined(labelled: DataFrame, min_support: float, min_confidence: float, longest: int) -> list[tuple[list[str], str, float, float]]:
    """(antecedent, verdict, confidence, support) of the rules that stay, for labelled rows (id, tokens, verdict).

    A rule's confidence is its verdict's share among all rows with the antecedent, open ones too. Item sets longer than a rule
    are kept from forming: each row gives its combinations only of frequent tokens that stand for their group, and rows with the
    same ones are mined as they are. A rule goes if a part of its antecedent already gives the same verdict with no less confidence.
    """
    chosen = frequent_items(labelled, min_support)
    if not chosen:
        return []
    kept_items = F.array_intersect("tokens", F.array(*map(F.lit, chosen)))
    items = labelled.select(F.array_append(kept_items, F.concat(F.lit("="), F.col("verdict"))).alias("items"))
    model = FPGrowth(itemsCol="items", minSupport=min_support, minConfidence=min_confidence).fit(items)
    rules = model.associationRules.where(
        F.col("consequent")[0].startswith("=") & (F.col("consequent")[0] != f"={OPEN}") & (F.size("antecedent") <= longest) & ~F.exists("antecedent", lambda t: t.startswith("="))
    ).select(F.sort_array("antecedent").alias("antecedent"), F.substring(F.col("consequent")[0], 2, 99).alias("verdict"), "confidence", "support")
    rows = sorted(((list(r.antecedent), r.verdict, float(r.confidence), float(r.support)) for r in rules.collect()), key=lambda r: (len(r[0]), r[0], r[1]))
    kept: list[tuple[list[str], str, float, float]] = []
    by_first: dict[tuple[str, str], list[tuple[frozenset, float]]] = {}
    for antecedent, verdict, confidence, support in rows:
        whole = frozenset(antecedent)
        if any(part <= whole and c >= confidence for t in antecedent for part, c in by_first.get((t, verdict), ())):
            continue
        kept.append((antecedent, verdict, confidence, support))
        by_first.setdefault((antecedent[0], verdict), []).append((whole, confidence))
    return kept


def judge(pages: DataFrame, rules=RULES, min_support: float = 0.005, min_confidence: float = 0.8, longest: int = 3, default: str = "allow") -> DataFrame:
    """page_id, host, path, rule and verdict of each row of pages (page_id, url).

    Null and empty urls and urls without :// have an empty host and path, fit no rule and get the default, as do urls that no mined
    rule matches. The rule with the highest confidence, then support, then the longest, then first by text decides. Rows that
    need no mined rule take part in no join; of the others only distinct sets of tokens that occur in rules are matched, and sets
    that many rows share meet them by broadcast. Urls of any length are read whole, repeated rows stay, no rows give no rows and
    other columns are ignored, whatever their names.
    """
    spark = pages.sparkSession
    base = pages.select(F.col("page_id").cast("long"), F.col("url").cast("string").alias("_url"))
    host, path = parts(F.col("_url"))
    base = base.select("page_id", "_url", host.alias("host"), path.alias("path"))
    rule, verdict = listed(F.col("host"), F.col("path"), rules)
    base = base.select("page_id", "host", "path", rule.alias("rule"), verdict.alias("listed"), tokens(F.col("host"), F.col("path"), F.coalesce("_url", F.lit(""))).alias("tokens"), F.struct("page_id", "_url").alias("id"))
    found = mined(base.select("id", "tokens", F.coalesce("listed", F.lit(OPEN)).alias("verdict")), min_support, min_confidence, longest)
    told = ["page_id", "host", "path", "rule"]
    if not found:
        return base.select(*told, F.coalesce("listed", F.lit(default)).alias("verdict"))

    entries = [F.struct(F.lit(k).alias("rule_id"), F.lit(t).alias("token"), F.lit(len(r[0])).alias("size"), F.lit(r[1]).alias("verdict"), F.lit(r[2]).alias("confidence"), F.lit(r[3]).alias("support")) for k, r in enumerate(found) for t in r[0]]
    index = spark.range(1).select(F.explode(F.array(*entries)).alias("e")).select("e.*")  # some rows a rule
    in_rules = F.array(*[F.lit(t) for t in sorted({t for r in found for t in r[0]})])
    keyed = base.select(*told, "listed", F.when(F.col("listed").isNull(), F.array_join(F.sort_array(F.array_intersect("tokens", in_rules)), "\n")).alias("key"))
    asking = keyed.where(F.length("key") > 0)
    sets = asking.groupBy("key").agg(F.count(F.lit(1)).alias("rows"))
    met = sets.select("key", F.explode(F.split("key", "\n")).alias("token")).join(F.broadcast(index), "token")
    met = met.groupBy("key", "rule_id", "size", "verdict", "confidence", "support").agg(F.count(F.lit(1)).alias("n")).where("n = size")
    best = met.groupBy("key").agg(F.max_by("verdict", F.struct("confidence", "support", "size", (-F.col("rule_id")).alias("first"))).alias("mined"))
    best = sets.join(best, "key", "left")
    answered = spread_join(asking, best, "key", "rows", asking.count()).select(*told, F.coalesce("mined", F.lit(default)).alias("verdict"))
    rest = keyed.where(F.coalesce(F.length("key"), F.lit(0)) == 0).select(*told, F.coalesce("listed", F.lit(default)).alias("verdict"))
    return rest.unionByName(answered)


def op8_url_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    return judge(table(spark, sf_dir, "pages"))
