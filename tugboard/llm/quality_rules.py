"""Quality rules of documents and of the hosts they come from, in DataFrame functions alone.

Each document is measured and held against two rules. The failures are then counted per host, the
rate of each host is shrunk towards a beta prior that is fitted to all hosts (method of moments), and
the verdict on the host goes back to its documents: a host of few documents is judged mostly by what
hosts are like in general, one of many by its own rate.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tugboard.llm.shared import SPACES, WORD, fresh, stored
from tugboard.session import ensure_checkpoint_dir

MEASURES = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")


@dataclass(frozen=True)
class HostRule:
    min_words: int = 50
    repeat_percent: int = 50
    reject_above: float = 0.5      # hosts whose shrunk failure rate is higher lose all their documents
    weakest_prior: float = 2.0     # bounds of the prior's weight, in documents
    strongest_prior: float = 1000.0
    fan_out: int = 16              # salts of the join of verdicts, for a host that holds most documents


def _at(array: Column, index: Column) -> Column:
    return F.get(array, index)


def measured(docs: DataFrame, text: str = "text", keep: list[str] | None = None) -> DataFrame:
    """``docs`` with the five measures of ``MEASURES``, which must be free names; null texts have no words.

    Words of 3-word windows that occur twice: the windows' 64-bit hashes are sorted with their places,
    equal neighbours mark repeats, and the places marked are joined to runs. All of it stays within the
    row, so nothing is shuffled and the cost of a text of n words is that of sorting n numbers.
    """
    kept = docs.columns if keep is None else keep
    words, windows, places = fresh(docs.columns, "words", "windows", "places")
    body = F.coalesce(F.col(text), F.lit(""))
    lines = F.filter(F.split(body, "\n", -1), lambda line: line.rlike(r"[^\x20\x09-\x0D]"))
    first = docs.select(
        *[F.col(name) for name in kept],
        F.regexp_extract_all(body, F.lit(WORD), F.lit(0)).alias(words),
        (F.length(body) - F.regexp_count(body, F.lit(SPACES))).cast("long").alias("word_chars"),
        F.regexp_count(body, F.lit(r"[#*$%&|<>]")).cast("long").alias("n_symbols"),
        (F.size(lines) - F.size(F.array_distinct(lines))).cast("long").alias("n_dup_lines"),
    )
    n = F.size(words)
    w = F.col(words)
    hashed = F.when(n > 3, F.transform(
        F.sequence(F.lit(0), n - 3),
        lambda i: F.struct(F.xxhash64(_at(w, i), _at(w, i + 1), _at(w, i + 2)).alias("h"), i.alias("i")),
    ))
    second = first.withColumn(windows, F.sort_array(hashed))
    s = F.col(windows)
    twice = F.filter(s, lambda x, k: F.coalesce(
        (_at(s, k - 1)["h"] == x["h"]) | (_at(s, k + 1)["h"] == x["h"]),
        _at(s, k - 1)["h"] == x["h"], _at(s, k + 1)["h"] == x["h"], F.lit(False),
    ))
    third = second.withColumn(places, F.sort_array(F.transform(twice, lambda x: x["i"])))
    p = F.col(places)
    covered = F.aggregate(
        F.transform(p, lambda at, k: F.least(F.lit(3), F.coalesce(_at(p, k + 1) - at, F.lit(3)))),
        F.lit(0), lambda total, x: total + x,
    )
    return third.select(
        *[F.col(name) for name in kept],
        n.cast("long").alias("n_words"), "word_chars", "n_symbols", "n_dup_lines",
        F.coalesce(covered, F.lit(0)).cast("long").alias("n_repeat_words"),
    )


def base_failed(rule: HostRule = HostRule()) -> Column:
    return (F.col("n_words") < rule.min_words) | (
        F.lit(100) * F.col("n_repeat_words") > F.lit(rule.repeat_percent) * F.col("n_words")
    )


def host_verdicts(judged: DataFrame, host: str, failed: str, rule: HostRule = HostRule()) -> DataFrame:
    """``host, host_docs, host_failed, host_rate, host_rejected``, one row per host; null is a host too.

    Only the moments of the hosts' rates, one row, reach the driver. Hosts that all have one rate, or
    a table without rows, get the strongest prior.
    """
    hosts = judged.groupBy(F.col(host).alias("host")).agg(
        F.count(F.lit(1)).alias("host_docs"), F.sum(F.col(failed).cast("long")).alias("host_failed")
    )
    rate = F.col("host_failed") / F.col("host_docs")
    moments = hosts.agg(
        F.sum("host_failed").alias("failed"), F.sum("host_docs").alias("docs"), F.var_samp(rate).alias("spread")
    ).first()
    mean = (moments.failed or 0) / moments.docs if moments.docs else 0.0
    weight = mean * (1 - mean) / moments.spread - 1 if moments.spread else rule.strongest_prior
    weight = min(max(weight, rule.weakest_prior), rule.strongest_prior)
    shrunk = (F.col("host_failed") + F.lit(mean * weight)) / (F.col("host_docs") + F.lit(weight))
    return hosts.withColumn("host_rate", shrunk).withColumn("host_rejected", F.col("host_rate") > rule.reject_above)


def quality_rules(docs: DataFrame, id: str = "doc_id", text: str = "text", host: str = "source",
                  rule: HostRule = HostRule(), with_documents: bool = False) -> DataFrame:
    """The measures and verdicts of every row: ``id``, ``host``, MEASURES, base_failed, host_rate, kept.

    With ``with_documents`` the rows are the documents that stay, with their own columns only. Null
    texts have no words and fail, rows that repeat are judged one by one, and a table without rows
    gives none. What was measured is written down once: the hosts are counted from it and the verdicts joined to it.
    """
    ensure_checkpoint_dir(docs.sparkSession)
    columns = docs.columns if with_documents else [id, host]
    whole, salt = fresh([*docs.columns, *MEASURES, "host"], "whole", "salt")
    packed = docs.select(F.struct(*columns).alias(whole), F.col(text).alias("text"), F.col(host).alias("host"))
    judged = measured(packed, "text", keep=[whole, "host"]).withColumn("base_failed", base_failed(rule))
    judged = stored(judged.drop(*MEASURES)) if with_documents else judged.checkpoint()
    verdicts = host_verdicts(judged, "host", "base_failed", rule).select("host", "host_rate", "host_rejected")
    salted = verdicts.withColumn(salt, F.explode(F.sequence(F.lit(0), F.lit(rule.fan_out - 1))))
    left = judged.withColumn(salt, F.pmod(F.xxhash64(f"{whole}.{id}"), F.lit(rule.fan_out)).cast("int"))
    same = left["host"].eqNullSafe(salted["host"]) & (left[salt] == salted[salt])
    joined = left.join(salted, same).select(left["*"], "host_rate", "host_rejected")
    kept = ~F.col("base_failed") & ~F.col("host_rejected")
    if with_documents:
        return joined.where(kept).select(f"{whole}.*")
    return joined.select(
        f"{whole}.*", *MEASURES, "base_failed", F.round("host_rate", 6).alias("host_rate"), kept.alias("kept")
    )
