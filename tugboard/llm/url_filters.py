"""Filters urls by given rules on hosts and paths, and by token combinations mined from labels.

The tokens of labelled urls and the mark of bad ones are mined by FP-growth. Combinations that are
frequent enough, and bad often enough, become rules. The rules are laid out as an inverted index (a row
per token and rule); a url meets the rules its tokens point to, and a rule fires where it was met once
for each of its tokens. All of it is DataFrame work; urls that repeat are matched once.
"""

from __future__ import annotations

from dataclasses import dataclass
from string import ascii_lowercase, ascii_uppercase

from pyspark.ml.fpm import FPGrowth
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tugboard.llm.shared import fresh
from tugboard.session import ensure_checkpoint_dir

BAD = "label bad"


@dataclass(frozen=True)
class GivenRule:
    """Holds for a host and all its subdomains, on paths that start with ``path``."""
    verdict: str
    host: str
    path: str


@dataclass(frozen=True)
class MiningRule:
    least_support: float = 0.001    # share of the labelled pages that have the tokens and are bad
    least_pages: int = 20           # and their number
    least_confidence: float = 0.5   # share of the pages with these tokens that are bad


def _lowered(text: Column) -> Column:
    return F.translate(text, ascii_uppercase, ascii_lowercase)


def host_of(url: Column) -> Column:
    """What stands after the first ``://`` up to ``/``, ``?`` or ``#``, with A-Z lowered; else empty."""
    return _lowered(F.coalesce(F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)", 1), F.lit("")))


def path_of(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(url, r"(?s)^.*?://[^/?#]*([^?#]*)", 1), F.lit(""))


def given_rule(host: Column, path: Column, rules: list[GivenRule]) -> tuple[Column, Column]:
    """The longest rule that fits, as ``host/path`` without anything between, and its verdict; else null."""
    longest_first = sorted(rules, key=lambda r: (-len(r.host + r.path), r.host, r.path))
    name, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for r in reversed(longest_first):
        fits = ((host == r.host) | host.endswith("." + r.host)) & path.startswith(r.path)
        name, verdict = F.when(fits, r.host + r.path).otherwise(name), F.when(fits, r.verdict).otherwise(verdict)
    return name, verdict


def url_tokens(url: Column) -> Column:
    """Distinct tokens: words of the host, of the path and of the names in the query; bare numbers are left out."""
    query = F.coalesce(F.regexp_extract(url, r"(?s)^[^?#]*\?([^#]*)", 1), F.lit(""))
    parts = (("host", host_of(url)), ("path", _lowered(path_of(url))), ("query", _lowered(F.regexp_replace(query, r"=[^&]*", ""))))

    def named(kind: str, text: Column) -> Column:
        words = F.regexp_extract_all(text, F.lit(r"[^\x00-\x20!-/:-@\[-`{-\x7F]+"), F.lit(0))
        return F.transform(words, lambda x: F.concat(F.lit(kind + " "), x))

    words = F.filter(F.concat(*[named(*part) for part in parts]), lambda x: ~x.rlike(r" [0-9]+$"))
    return F.coalesce(F.array_distinct(words), F.array().cast("array<string>"))


def mine(labelled: DataFrame, tokens: str, bad: str, rule: MiningRule) -> DataFrame | None:
    """``tokens, confidence, support`` of the rules found in all rows of ``labelled``, or None if there are none."""
    total = labelled.count()
    if not total:
        return None
    items = F.when(F.col(bad), F.array_append(F.col(tokens), F.lit(BAD))).otherwise(F.col(tokens))
    least = min(1.0, max(rule.least_support, rule.least_pages / total))
    model = FPGrowth(itemsCol="items", minSupport=least, minConfidence=rule.least_confidence).fit(labelled.select(items.alias("items")))
    rules = model.associationRules.where(F.col("consequent") == F.array(F.lit(BAD))).select(
        F.array_sort("antecedent").alias("tokens"), "confidence", "support"
    ).checkpoint()
    return rules if rules.head(1) else None


def fired(urls: DataFrame, url: str, rules: DataFrame) -> DataFrame:
    """The distinct urls that have all tokens of a rule at least."""
    index = rules.select(F.xxhash64("tokens").alias("rule"), F.size("tokens").alias("needed"), F.explode("tokens").alias("token"))
    met = urls.select(url, F.explode(url_tokens(F.col(url))).alias("token")).join(index, "token")
    return met.groupBy(url, "rule").agg(F.count(F.lit(1)).alias("met"), F.first("needed").alias("needed")).where("met = needed").select(url).distinct()


def filter_urls(pages: DataFrame, labels: DataFrame, given: list[GivenRule], id: str = "page_id", url: str = "url",
                label_id: str = "doc_id", rule: MiningRule = MiningRule()) -> DataFrame:
    """``id, host, path, rule, verdict`` of every row.

    ``labels`` has ``label_id, quality, toxic``; a page is bad if its quality is 0 or it is toxic, and
    unlabelled where both are null. A null url has no host, path or tokens, and is allowed unless a
    rule says otherwise, which none can. Without labels, or where nothing is frequent enough, nothing is
    mined. A page with several labels counts once for each; repeated rows come back as they came.
    """
    ensure_checkpoint_dir(pages.sparkSession)
    (name,) = fresh(["host", "path", "rule", "verdict", "url"], id)
    rows = pages.select(F.col(id).alias(name), F.col(url).alias("url"))
    marks = labels.select(
        F.col(label_id).alias("of"), F.coalesce(F.col("quality") == 0, F.lit(False)).alias("poor"),
        F.coalesce(F.col("toxic") == 1, F.lit(False)).alias("toxic"),
    ).where(labels["quality"].isNotNull() | labels["toxic"].isNotNull())
    labelled = rows.where("url is not null").join(marks, rows[name] == F.col("of")).select(
        url_tokens(F.col("url")).alias("tokens"), (F.col("poor") | F.col("toxic")).alias("bad")
    ).checkpoint()
    rules = mine(labelled, "tokens", "bad", rule)
    host, path = host_of(F.col("url")), path_of(F.col("url"))
    if rules is None:
        blocked = rows.withColumn("mined", F.lit(False))
    else:
        hit = fired(rows.select("url").where("url is not null").distinct(), "url", rules).withColumn("mined", F.lit(True)).checkpoint()
        blocked = rows.join(hit, "url", "left")
    rule_name, verdict = given_rule(F.col("host"), F.col("path"), given)
    mined = F.when(F.coalesce("mined", F.lit(False)), "block").otherwise("allow")
    return blocked.select(name, host.alias("host"), path.alias("path"), "mined").select(
        name, "host", "path", rule_name.alias("rule"), F.coalesce(verdict, mined).alias("verdict")
    )
