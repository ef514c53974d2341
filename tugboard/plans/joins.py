"""Joining per-session facts onto many rows without a skewed shuffle."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tugboard.config import PanelSettings


def attach_facts(
    rows: DataFrame,
    facts: DataFrame,
    on: Sequence[str],
    salt_by: Sequence[str],
    n_facts: int,
    settings: PanelSettings,
) -> DataFrame:
    """Inner join of ``rows`` with ``facts``, a table of ``n_facts`` rows, one per key.

    Up to ``broadcast_rows`` facts are broadcast, so the rows never move. Beyond that both sides
    shuffle on the key *and* a salt: a key that holds a third of all rows lands on ``fan_out`` tasks,
    not one, and a later aggregation cannot inherit a partitioning on the bare key.
    """
    if n_facts <= settings.broadcast_rows:
        return rows.join(F.broadcast(facts), list(on))
    salts = F.sequence(F.lit(0), F.lit(settings.fan_out - 1))
    salted_facts = facts.withColumn("_salt", F.explode(salts))
    salt = F.pmod(F.xxhash64(*salt_by), F.lit(settings.fan_out)).cast("int")
    salted_rows = rows.withColumn("_salt", salt)
    return salted_rows.join(salted_facts, [*on, "_salt"]).drop("_salt")
