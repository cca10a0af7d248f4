"""URL filtering by listed rules and by mined association rules.

A listed rule is a host suffix and a path prefix with a verdict; the longest that fits wins. Urls
without one are judged by association rules: FP-growth mines combinations of URL tokens from
labelled urls; rules 'tokens => block' and 'tokens => allow' are pruned by support and confidence,
and where one token less gives the same verdict with as much confidence. Each rule is in an
inverted index under its rarest token; of the rules whose tokens a url all has, the one of most
confidence decides (then of most support, then of fewest tokens). Without one a url is allowed.
Lift is given, but decides nothing: it says whether a rule tells more than the labels' base rate.

Urls are matched once a distinct set of tokens. The index is broadcast while it has at most
INDEX_ROWS rules; a larger one is joined with salted tokens, so that a token that most urls have is
no hot key. Sets of tokens that many urls share come back by a join that broadcasts the few such.

Defined cases: a null url, or one without '://', has an empty host and path, fits no listed rule
and is allowed. Null labels are no labels. Ties between listed rules of one length go to the
first, ties between mined rules to the greater list of tokens, then to block. Repeated rows are
judged alike. Without labels, or without rules that hold, unlisted urls are allowed. An empty table
gives no rows. Extra columns are ignored.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.ml.fpm import FPGrowth
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import cut, skewed_join

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
RULES: tuple[tuple[str, str], ...] = (("org/", "allow"), ("example.org/es/", "block"), ("example.org/en/1", "block"), ("com/fr/", "allow"), ("com/de/", "block"))
CLASSES = {"block": "=block", "allow": "=allow"}
MIN_ROWS = 20  # labelled urls that a rule must hold for, at least
MIN_SUPPORT = 0.002  # and as a share of the labelled urls
MIN_CONFIDENCE = 0.8
INDEX_ROWS = 50_000  # rules that are broadcast, of some 200 bytes each
SALTS = 16


def host_and_path(url: Column) -> tuple[Column, Column]:
    """Lower-cased host and path; both empty where there is no '://'."""
    at = F.coalesce(F.instr(url, "://"), F.lit(0))
    rest = F.when(at > 0, F.substring(url, at + 3, F.length(url))).otherwise(F.lit(""))
    raw = F.regexp_extract(rest, r"^[^/?#]*", 0)
    path = F.regexp_extract(F.substring(rest, F.length(raw) + 1, F.length(rest)), r"^[^?#]*", 0)
    return F.translate(raw, UPPER, LOWER), path


def listed_rule(host: Column, path: Column, rules: Sequence[tuple[str, str]]) -> Column:
    """struct(rule, verdict) of the longest rule that fits; null if none does."""
    found = []
    for rule, verdict in sorted(rules, key=lambda r: -len(r[0])):
        suffix, slash, prefix = rule.partition("/")
        fits = ((host == suffix) | F.endswith(host, F.lit("." + suffix))) & F.startswith(path, F.lit(slash + prefix))
        found.append(F.when(fits, F.struct(F.lit(rule).alias("rule"), F.lit(verdict).alias("verdict"))))
    return F.coalesce(*found) if found else F.lit(None).cast("struct<rule:string,verdict:string>")


def url_tokens(url: Column, host: Column, path: Column) -> Column:
    """Distinct tokens: host labels, the host's last label, path parts (numbers as one token), extension, query keys."""
    parts = F.filter(F.split(path, r"[/._-]"), lambda x: x != "")
    parts = F.transform(parts, lambda x: F.concat(F.lit("path:"), F.when(x.rlike(r"^[0-9]+\z"), F.lit("0")).otherwise(x)))
    labels = F.transform(F.filter(F.split(host, r"[.]"), lambda x: x != ""), lambda x: F.concat(F.lit("host:"), x))
    query = F.regexp_extract(F.coalesce(url, F.lit("")), r"\?([^#]*)", 1)
    keys = F.transform(F.filter(F.split(query, "&"), lambda x: x != ""), lambda x: F.concat(F.lit("query:"), F.regexp_extract(x, "^[^=]*", 0)))
    last = F.array(F.concat(F.lit("top:"), F.regexp_extract(host, r"[^.]*\z", 0)))
    return F.array_distinct(F.concat(labels, last, parts, keys))


def all_rules(labelled: DataFrame, min_support: float = MIN_SUPPORT, min_rows: int = MIN_ROWS, min_confidence: float = MIN_CONFIDENCE) -> DataFrame:
    """tokens, verdict, confidence, support and lift of the rules that hold. labelled: tokens, blocked (boolean)."""
    labelled = cut(labelled.filter("blocked IS NOT NULL").select("tokens", "blocked"))
    total = labelled.count()
    least = max(min_rows, min_support * total)
    if total < least:
        return labelled.sparkSession.createDataFrame([], "tokens array<string>, verdict string, confidence double, support double, lift double")
    mark = F.when(F.col("blocked"), F.lit(CLASSES["block"])).otherwise(F.lit(CLASSES["allow"]))
    items = labelled.select(F.concat("tokens", F.array(mark)).alias("items"))
    model = FPGrowth(itemsCol="items", minSupport=least / total, minConfidence=min_confidence).fit(items)
    verdict = F.col("consequent")[0]
    found = model.associationRules.filter((F.size("consequent") == 1) & verdict.isin(*CLASSES.values()) & ~F.arrays_overlap("antecedent", F.array(*map(F.lit, CLASSES.values()))))
    rules = cut(found.select(F.array_sort("antecedent").alias("tokens"), F.substring(verdict, 2, 9).alias("verdict"), "confidence", "support", "lift"))
    # a rule is redundant if it says no more than without one of its tokens
    part = rules.select(F.col("tokens").alias("part"), "verdict", F.col("confidence").alias("part_confidence"))
    shorter = rules.select("tokens", "verdict", "confidence", F.explode(F.transform("tokens", lambda t: F.array_remove("tokens", t))).alias("part"))
    worse = shorter.join(part, ["part", "verdict"]).filter("part_confidence >= confidence")
    return rules.join(worse.select("tokens", "verdict").distinct(), ["tokens", "verdict"], "left_anti")


def mine_rules(labelled: DataFrame, min_support: float = MIN_SUPPORT, min_rows: int = MIN_ROWS, min_confidence: float = MIN_CONFIDENCE) -> DataFrame:
    """tokens, confidence, support and lift of the rules for blocking. labelled: tokens, blocked (boolean)."""
    return all_rules(labelled, min_support, min_rows, min_confidence).filter("verdict = 'block'").drop("verdict")


def match_rules(sets: DataFrame, rules: DataFrame, index_rows: int = INDEX_ROWS) -> DataFrame:
    """tokens, n_rows and the rule (struct) of each set of tokens (columns tokens, n_rows) that has all tokens of a rule."""
    uses = rules.select(F.explode("tokens").alias("token")).groupBy("token").agg(F.count("*").alias("uses"))
    keyed = rules.select("*", F.explode("tokens").alias("token")).join(uses, "token").groupBy("tokens", "verdict").agg(F.min(F.struct("uses", "token")).alias("key"), *(F.first(c).alias(c) for c in ("confidence", "support")))
    best = F.struct("confidence", "support", (-F.size("tokens")).alias("fewest"), "tokens", "verdict")
    index = cut(keyed.select(F.col("key.token").alias("token"), F.col("tokens").alias("rule_tokens"), best.alias("rule")))
    probes = sets.select("tokens", "n_rows", F.explode("tokens").alias("token"))
    if index.count() <= index_rows:
        met = probes.join(F.broadcast(index), "token")
    else:
        salt = F.pmod(F.xxhash64("tokens"), F.lit(SALTS)).cast("int")
        met = probes.withColumn("salt", salt).join(index.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1)))), ["token", "salt"])
    return met.filter(F.size(F.array_except("rule_tokens", "tokens")) == 0).groupBy("tokens").agg(F.first("n_rows").alias("n_rows"), F.max("rule").alias("mined_rule"))


def judge_urls(pages: DataFrame, labelled: DataFrame | None, rules: Sequence[tuple[str, str]] = RULES, id_col: str = "page_id", url_col: str = "url") -> DataFrame:
    """page_id, host, path, rule, verdict, mined (whether a mined rule decides), its tokens and confidence, of every row.

    labelled: url and blocked (boolean).
    """
    host, path = host_and_path(F.col("url"))
    tokens = url_tokens(F.col("url"), F.col("host"), F.col("path"))
    known = pages.select(F.col(id_col).alias("page_id"), F.col(url_col).alias("url")).withColumn("host", host).withColumn("path", path)
    known = known.withColumn("listed", listed_rule(F.col("host"), F.col("path"), rules)).withColumn("tokens", F.array_sort(tokens))
    has_host = F.coalesce(F.instr("url", "://"), F.lit(0)) > 0
    listed = known.filter(F.col("listed").isNotNull() | ~has_host).drop("tokens")
    open_ = known.filter(F.col("listed").isNull() & has_host)
    none = F.lit(None).cast("struct<confidence:double,support:double,fewest:int,tokens:array<string>,verdict:string>")
    judged = listed.withColumn("mined_rule", none)
    mined = None
    if labelled is not None:
        seen = labelled.select("url", "blocked").filter("url IS NOT NULL").withColumn("host", host).withColumn("path", path).select(tokens.alias("tokens"), "blocked")
        mined = cut(all_rules(seen))
    if mined is None or mined.isEmpty():
        judged = judged.unionByName(open_.drop("tokens").withColumn("mined_rule", none))
    else:
        sets = match_rules(open_.groupBy("tokens").agg(F.count("*").alias("n_rows")), mined)
        judged = judged.unionByName(skewed_join(open_, cut(sets), ["tokens"]).drop("tokens"))
    verdict = F.coalesce("listed.verdict", "mined_rule.verdict", F.lit("allow"))
    return judged.select(
        "page_id", "host", "path", F.col("listed.rule").alias("rule"), verdict.alias("verdict"), F.col("mined_rule").isNotNull().alias("mined"),
        F.array_join("mined_rule.tokens", " ").alias("mined_tokens"), F.col("mined_rule.confidence").alias("mined_confidence"),
    )
