"""How alike two users move a parameter: correlation of their series on the ticks where both have a value.

A series is runs of ticks, so a pair's common ticks fall into stretches in which neither changes. Both users'
changes are put in one order per pair, the last value of each is carried along, and every stretch counts with its
length: no tick is spelled out and no series is joined to another.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tugboard.config import DEFAULTS, PanelSettings
from tugboard.operators.grid import user_runs
from tugboard.operators.roster import change_counts
from tugboard.plans.joins import attach_facts
from tugboard.plans.ordered import order_groups
from tugboard.plans.sizes import session_sizes

PAIR = ["session_id", "param", "user_a", "user_b"]


def pairwise_synchrony(events: DataFrame, settings: PanelSettings = DEFAULTS) -> DataFrame:
    """``session_id, param, user_a, user_b, common_ticks, correlation`` for all pairs of a session's users.

    Pearson's correlation at lag 0. It is NULL where there is no common tick, or where one of the two does not
    vary on the common ones. Sums are taken of distances from the pair's means, so that large values lose no digits.
    """
    counts = change_counts(events, keep=True)
    users = counts.groupBy("session_id").agg(F.collect_set("user").alias("users"))
    runs = user_runs(events, settings).select("session_id", "param", "user", "n_ticks", "lo", "value")
    met = attach_facts(runs, users, ["session_id"], ["param", "user", "lo"], session_sizes(counts).sessions, settings)
    other = F.explode(F.filter("users", lambda u: u != F.col("user")))
    is_a = F.col("user") < F.col("other")
    sided = met.withColumn("other", other).select(
        "session_id", "param", F.least("user", "other").alias("user_a"), F.greatest("user", "other").alias("user_b"),
        "n_ticks", "lo", "user", F.when(is_a, F.col("value")).alias("a"), F.when(~is_a, F.col("value")).alias("b"),
    )
    both = F.col("a").isNotNull() & F.col("b").isNotNull()
    stretches = (
        order_groups(sided, PAIR, ["lo", "user"], settings)
        .following(until="lo").running(a=("last", "a"), b=("last", "b"))
        .derive(ticks=F.when(both, F.coalesce("until", "n_ticks") - F.col("lo")).otherwise(F.lit(0).cast("long")))
        .derive(a_ticks=F.col("a") * F.col("ticks"), b_ticks=F.col("b") * F.col("ticks"))
        .whole(common=("sum", "ticks"), a_sum=("sum", "a_ticks"), b_sum=("sum", "b_ticks"))
    )
    seen = F.col("ticks") > 0
    a_off, b_off = F.col("a") - F.col("a_sum") / F.col("common"), F.col("b") - F.col("b_sum") / F.col("common")
    sums = stretches.derive(
        aa=F.when(seen, F.col("ticks") * a_off * a_off),
        bb=F.when(seen, F.col("ticks") * b_off * b_off),
        ab=F.when(seen, F.col("ticks") * a_off * b_off),
        a_seen=F.when(seen, F.col("a")),
        b_seen=F.when(seen, F.col("b")),
    ).done().groupBy(*PAIR).agg(
        F.sum("ticks").alias("common_ticks"), F.sum("aa").alias("aa"), F.sum("bb").alias("bb"), F.sum("ab").alias("ab"),
        (F.min("a_seen") < F.max("a_seen")).alias("a_varies"), (F.min("b_seen") < F.max("b_seen")).alias("b_varies"),
    )
    varies = F.col("a_varies") & F.col("b_varies")
    correlation = F.when(varies, F.try_divide(F.col("ab"), F.sqrt("aa") * F.sqrt("bb")))
    return sums.select(*PAIR, "common_ticks", correlation.alias("correlation"))
