"""Where several users fight over a shared parameter.

From each change a window looks ahead. It is a conflict if it holds enough changes by enough users
who take turns often enough. Windows are then picked greedily: the first conflict, then the first
one that starts after its window, and so on. Picks a short gap apart are merged into zones.

Only the first change of an instant can start a pick. Within an instant changes are in user order, and
the window of a later one is a suffix of the first's, so it has no more changes, users or turns; and a
pick always ends with a whole instant. In large sessions the changes of an instant are therefore
combined first (before any shuffle) into their number, the first and last user and the turns between
users, which is all a window asks for.
"""

from __future__ import annotations

import math
from dataclasses import replace

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tugboard.config import DEFAULTS, LINE, PanelSettings
from tugboard.functions.cells import fixed
from tugboard.functions.clock import first_tick_beyond, first_tick_from
from tugboard.operators.grid import merged_runs
from tugboard.operators.roster import change_counts
from tugboard.plans.ordered import (
    SLICES_A_CORE,
    OrderedGroups,
    combine_large,
    cores_of,
    hot_by_counts,
    hot_groups,
    order_groups,
    slice_rows,
    slices_of,
)
from tugboard.session import ensure_checkpoint_dir

SERIES = ["session_id", "param"]
PYRAMID = 16         # nodes under one of the next level
PYRAMID_LEVELS = 8   # 16^8 blocks of ticks
_REACHED = [*SERIES, "time_sec", "n_before", "turns_before", "end_time", "n_end", "turns_end"]
WINDOW = ["start_time", "end_time", "num_changes", "user_switches"]


def _shared(events: DataFrame, settings: PanelSettings) -> DataFrame:
    return events.where(F.col("param").isin(*settings.shared_params))


def _steps(events: DataFrame, settings: PanelSettings) -> DataFrame:
    """What windows are made of: single changes, or in large sessions whole instants."""
    user = F.col("user")
    single = _shared(events, settings).select(
        *SERIES, "time_sec", "user", *LINE, F.lit(1).cast("long").alias("n"),
        user.alias("last_user"), F.lit(0).cast("long").alias("inner_turns"),
    )

    def instants(changes: DataFrame) -> DataFrame:
        users = changes.groupBy(*SERIES, "time_sec", "user").agg(F.sum("n").alias("n"))
        return users.groupBy(*SERIES, "time_sec").agg(
            F.min("user").alias("user"),
            *[F.lit(None).cast(changes.schema[c].dataType).alias(c) for c in LINE],
            F.sum("n").alias("n"),
            F.max("user").alias("last_user"),
            (F.count(F.lit(1)) - 1).alias("inner_turns"),
        )

    return combine_large(single, change_counts(events, keep=True), settings, instants)


def _first_of_instant() -> Column:
    return F.col("time_before").isNull() | (F.col("time_before") < F.col("time_sec"))


def _windows(events: DataFrame, settings: PanelSettings) -> DataFrame:
    """The look-ahead window of every instant: running totals at its end less those at its start."""
    order = ["time_sec", "user", *LINE]
    ordered = order_groups(_steps(events, settings), SERIES, order, settings, change_counts(events, keep=True))
    seam = F.coalesce((F.col("user_before") != F.col("user")).cast("long"), F.lit(0))
    totals = (
        ordered.previous(user_before="last_user", time_before="time_sec")
        .derive(turns=F.col("inner_turns") + seam)
        .running(n_sum=("sum", "n"), turn_sum=("sum", "turns"))
    )
    opening = {
        "n_before": F.col("n_sum") - F.col("n"),
        "turns_before": F.col("turn_sum") - F.col("inner_turns"),
        "until": F.col("time_sec") + F.lit(settings.conflict_window),
    }
    ahead = (
        f"over (partition by {', '.join(SERIES)} order by time_sec "
        f"range between unbounded preceding and {settings.conflict_window!r}D following)"
    )
    asked = totals.derive(**opening)
    reached = asked.small().withColumns({
        "end_time": F.expr(f"max(time_sec) {ahead}"),
        "n_end": F.expr(f"max(n_sum) {ahead}"),
        "turns_end": F.expr(f"max(turn_sum) {ahead}"),
    }).where(_first_of_instant()).select(*_REACHED)
    if asked.sliced:
        reached = reached.unionByName(_look_ahead(asked.large(), settings).select(*_REACHED))
    return reached.select(
        *SERIES,
        F.col("time_sec").alias("start_time"),
        "end_time",
        (F.col("n_end") - F.col("n_before")).alias("num_changes"),
        (F.col("turns_end") - F.col("turns_before")).alias("user_switches"),
    )


def _look_ahead(instants: DataFrame, settings: PanelSettings) -> DataFrame:
    """Totals at the last instant up to ``until``, for groups too large for one task.

    A range frame would have to cross slices. Instead each instant also asks a question, placed at
    its ``until`` right after the instants of that time; the running maximum there is the answer.
    """
    def steps(rows: DataFrame, at: str, asks: int, answers: bool) -> DataFrame:
        def only(shown: bool, source: str, kind: str) -> Column:
            return F.col(source) if shown else F.lit(None).cast(kind)

        return rows.select(
            *SERIES,
            F.col(at).alias("at"),
            F.lit(asks).alias("asks"),
            "time_sec",
            only(answers, "time_sec", "double").alias("end_time"),
            only(answers, "n_sum", "long").alias("n_end"),
            only(answers, "turn_sum", "long").alias("turns_end"),
            only(not answers, "n_before", "long").alias("n_before"),
            only(not answers, "turns_before", "long").alias("turns_before"),
        )

    instants = instants.checkpoint()
    order = ["at", "asks", "time_sec"]
    both = steps(instants, "time_sec", 0, True).unionByName(steps(instants.where(_first_of_instant()), "until", 1, False))
    total = 2 * instants.count()
    sliced = slice_rows(both, SERIES, order, total, settings)
    parts = slices_of(total, settings, cores_of(both)) + instants.select(*SERIES).distinct().count()
    small = parts <= settings.broadcast_rows
    return OrderedGroups(sliced, tuple(SERIES), tuple(order), sliced=True, small_carry=small).running(
        end_time=("max", "end_time"), n_end=("max", "n_end"), turns_end=("max", "turns_end")
    ).done().where(F.col("asks") == 1)


def conflict_candidates(events: DataFrame, settings: PanelSettings = DEFAULTS) -> DataFrame:
    """Every instant whose window qualifies: enough changes, users and turns between users."""
    enough = _windows(events, settings).where(
        (F.col("num_changes") >= settings.min_changes) & (F.col("user_switches") >= settings.min_users)
    )
    # Two turns already take two users; only a higher bar has to be counted out.
    return enough if settings.min_users <= 2 else _with_enough_users(enough, events, settings)


def _with_enough_users(windows: DataFrame, events: DataFrame, settings: PanelSettings) -> DataFrame:
    """Windows with at least ``min_users`` different users.

    A user arrives with an act that no own act precedes within a window's length, and leaves with one
    that none follows. The users of a window are those who arrived by its end less those who left
    before its start: two running counts, whatever the number of users.
    """
    acts = _shared(events, settings).select(*SERIES, "user", "time_sec").distinct()
    counts = change_counts(events, keep=True)
    lived = (
        order_groups(acts, [*SERIES, "user"], ["time_sec"], settings, counts)
        .previous(earlier="time_sec").following(later="time_sec").done()
    )
    width = F.lit(settings.conflict_window)
    arrivals = lived.where(F.col("earlier").isNull() | (F.col("earlier") + width < F.col("time_sec")))
    departures = lived.where(F.col("later").isNull() | (F.col("time_sec") + width < F.col("later")))
    open_at = windows.select(*SERIES, "start_time", F.col("start_time").alias("at"))
    until = open_at.withColumn("at", F.col("at") + width)
    arrived = _passed(arrivals, until, True, counts, settings).withColumnRenamed("passed", "arrived")
    gone = _passed(departures, open_at, False, counts, settings).withColumnRenamed("passed", "gone")
    enough = F.col("arrived") - F.col("gone") >= settings.min_users
    window = [*SERIES, "start_time"]
    return windows.join(arrived, window).join(gone, window).where(enough).drop("arrived", "gone")


def _passed(
    marks: DataFrame, questions: DataFrame, inclusive: bool, counts: DataFrame, settings: PanelSettings
) -> DataFrame:
    """Per question the number of marks before its ``at``, or up to and with it."""
    # A series has at most one mark and one question per change.
    halved = replace(settings, hot_rows=settings.hot_rows // 2)
    ranked = marks.select(
        *SERIES, F.col("time_sec").alias("at"), F.lit(0 if inclusive else 2).alias("turn"),
        F.lit(None).cast("double").alias("start_time"), F.lit(1).alias("one"),
    ).unionByName(questions.withColumns({"turn": F.lit(1), "one": F.lit(0)}))
    ordered = order_groups(ranked, SERIES, ["at", "turn", "start_time"], halved, counts)
    counted = ordered.running(passed=("sum", "one")).done()
    return counted.where(F.col("turn") == 1).select(*SERIES, "start_time", "passed")


def _greedy_fold(candidates: Column) -> Column:
    """Over candidates in time order: keep each that starts after the last one kept."""
    kind = "array<struct<start_time:double,end_time:double,num_changes:bigint,user_switches:bigint>>"
    return F.aggregate(
        candidates,
        F.array().cast(kind),
        lambda kept, one: F.when(
            (F.size(kept) == 0) | (one["start_time"] > F.element_at(kept, -1)["end_time"]),
            F.concat(kept, F.array(one)),
        ).otherwise(kept),
    )


def _pick_by_fold(candidates: DataFrame) -> DataFrame:
    """For series of at most ``fold_rows`` candidates: one array per series, folded in place."""
    listed = candidates.groupBy(*SERIES).agg(F.array_sort(F.collect_list(F.struct(*WINDOW))).alias("windows"))
    return listed.select(*SERIES, F.inline(_greedy_fold(F.col("windows"))))


def _by_rank(part: pa.Table, *columns: str) -> list[np.ndarray]:
    """The rows' ranks and other columns, in the order of ranks, and where each row stood."""
    rank = part["rank"].to_numpy()
    order = np.argsort(rank)
    return [rank[order], *[part[c].to_numpy()[order] for c in columns], order]


def _chain_ends(part: pa.Table) -> pa.Table:
    """Per candidate, where the chain that starts there leaves this part (jumps are doubled)."""
    rank, jump, order = _by_rank(part, "next_rank")
    base, size = int(rank[0]), len(rank)
    inside = jump < base + size
    while inside.any():
        jump[inside] = jump[jump[inside] - base]
        inside = jump < base + size
    names = [part[c].slice(0, 1).take(pa.array(np.zeros(size, np.int64))) for c in SERIES]
    return pa.table([*names, pa.array(rank), pa.array(jump)], names=[*SERIES, "rank", "exit_rank"])


def _chain_walk(part: pa.Table) -> pa.Table:
    """The candidates on the chains that enter this part."""
    rank, following, entered, order = _by_rank(part, "next_rank", "entered")
    base, size = int(rank[0]), len(rank)
    following, picked = following.tolist(), np.zeros(size, dtype=bool)
    for at in rank[entered.astype(bool)].tolist():
        while at < base + size and not picked[at - base]:
            picked[at - base] = True
            at = following[at - base]
    return part.select([*SERIES, *WINDOW]).take(pa.array(order[picked]))


def _chain_entries(hops: pa.Table) -> pa.Table:
    """The entries that the chain from the first candidate goes through, from part to part."""
    beyond = dict(zip(hops["rank"].to_pylist(), hops["exit_rank"].to_pylist()))
    found, at = [], 1
    while at in beyond:
        found.append(at)
        at = beyond[at]
    names = [pa.array([hops[c][0].as_py()] * len(found), pa.string()) for c in SERIES]
    return pa.table([*names, pa.array(found, pa.int64())], names=[*SERIES, "rank"])


def _pick_by_chain(ranked: DataFrame, settings: PanelSettings) -> DataFrame:
    """For series with more candidates than one array should hold.

    Candidates are ranked in time order, and each points to the first one after its window. The
    picks are the chain that starts at number 1. The numbers are cut into parts; each part works out
    where a chain entering at any of its candidates leaves it. What remains is the chain from part to
    part, over the few candidates that chains enter at. A task follows it per series; where there are more
    of them than a task should hold it is followed by doubling, so the number of rounds is the
    logarithm of the number of parts. Last, each part walks its own stretch.
    """
    window = "struct<end_time:double,num_changes:bigint,user_switches:bigint,start_time:double>"
    starts = ranked.select(
        *SERIES, F.col("start_time").alias("at"), F.lit(0).alias("asks"), F.col("rank").alias("asked_by"),
        F.col("rank").alias("passed"), F.lit(None).cast(window).alias("window"),
    )
    ends = ranked.select(
        *SERIES, F.col("end_time").alias("at"), F.lit(1).alias("asks"), F.col("rank").alias("asked_by"),
        F.lit(None).cast("long").alias("passed"),
        F.struct("end_time", "num_changes", "user_switches", "start_time").alias("window"),
    )
    linked = (
        order_groups(starts.unionByName(ends), SERIES, ["at", "asks", "asked_by"], settings)
        .running(passed=("max", "passed")).done()
        .where(F.col("asks") == 1)
        .select(*SERIES, F.col("asked_by").alias("rank"), (F.col("passed") + 1).alias("next_rank"), "window.*")
        .withColumn("part", F.floor((F.col("rank") - 1) / settings.chain_rows))
        .checkpoint()
    )
    part = [*SERIES, "part"]
    # Named, as these rows are few bytes but many groups: sized by bytes, one task would be given all groups.
    tasks = SLICES_A_CORE * cores_of(linked)
    names = "session_id string, param string, rank long, exit_rank long"
    ends_of = linked.select(*part, "rank", "next_rank").repartition(tasks, *part).groupBy(*part).applyInArrow(_chain_ends, names).checkpoint()

    # Only candidates where some chain enters a part; the exit of the last part is no candidate.
    entries = ends_of.select(*SERIES, F.col("exit_rank").alias("rank")).distinct()
    hops = ends_of.join(entries, [*SERIES, "rank"], "left_semi").unionByName(
        ends_of.where(F.col("rank") == 1)
    ).distinct().checkpoint()
    if hot_groups(hops, SERIES, settings.chain_rows) is None:
        on_chain = hops.repartition(tasks, *SERIES).groupBy(*SERIES).applyInArrow(_chain_entries, "session_id string, param string, rank long")
    else:
        on_chain = _doubled(linked, ends_of, hops)
    entered = on_chain.withColumn("entered", F.lit(True))
    marked = linked.join(entered, [*SERIES, "rank"], "left").fillna(False, ["entered"])
    kind = "session_id string, param string, start_time double, end_time double, num_changes long, user_switches long"
    return marked.repartition(tasks, *part).groupBy(*part).applyInArrow(_chain_walk, kind)


def _doubled(linked: DataFrame, ends_of: DataFrame, hops: DataFrame) -> DataFrame:
    """The entries on each series' chain, where there are too many hops for one task."""
    on_chain = ends_of.where(F.col("rank") == 1).select(*SERIES, "rank")
    parts = linked.agg(F.max("part")).first()[0] + 1
    for _ in range(max(1, math.ceil(math.log2(parts + 1)))):
        ahead = on_chain.join(hops, [*SERIES, "rank"]).select(*SERIES, F.col("exit_rank").alias("rank"))
        on_chain = on_chain.unionByName(ahead).distinct().checkpoint()
        via = hops.select(*SERIES, F.col("rank").alias("exit_rank"), F.col("exit_rank").alias("beyond"))
        hops = (
            hops.join(via, [*SERIES, "exit_rank"], "left")
            .select(*SERIES, "rank", F.coalesce("beyond", "exit_rank").alias("exit_rank"))
            .checkpoint()
        )
    return on_chain


def picked_windows(events: DataFrame, settings: PanelSettings = DEFAULTS) -> DataFrame:
    """The greedily picked windows: disjoint, in time order."""
    candidates = conflict_candidates(events, settings)
    if hot_by_counts(change_counts(events, keep=True), SERIES, settings.fold_rows) is None:
        return _pick_by_fold(candidates)
    ensure_checkpoint_dir(events.sparkSession)
    candidates = candidates.checkpoint()
    if hot_groups(candidates, SERIES, settings.fold_rows) is None:
        return _pick_by_fold(candidates)
    ranked = (
        order_groups(candidates.withColumn("one", F.lit(1)), SERIES, ["start_time"], settings)
        .running(rank=("sum", "one")).whole(in_series=("sum", "one")).done().drop("one").checkpoint()
    )
    is_long = F.col("in_series") > settings.fold_rows
    return _pick_by_fold(ranked.where(~is_long)).unionByName(
        _pick_by_chain(ranked.where(is_long).drop("in_series"), settings)
    )


def _merge_picks(picks: DataFrame, settings: PanelSettings) -> DataFrame:
    """Numbers the zones: a pick belongs to the zone before if it starts at most ``merge_gap`` later.

    Picks lie more than a window apart, so a series has at most its length over the window of them.
    """
    along = Window.partitionBy(*SERIES).orderBy("start_time")
    apart = F.col("start_time") - F.lag("end_time").over(along)
    opens = (apart.isNull() | (apart > settings.merge_gap)).cast("long")
    upto = along.rowsBetween(Window.unboundedPreceding, 0)
    return picks.withColumn("opens", opens).withColumn("zone_no", F.sum("opens").over(upto)).drop("opens")


def _users_of_zones(picks: DataFrame, events: DataFrame, settings: PanelSettings) -> DataFrame:
    """Per zone the users seen in its picks, sorted.

    Picks and changes meet in time bins of one window's length, so a pick lies in at most two bins
    and a change in one. Up to a checked number picks are broadcast, and no change moves.
    """
    def bin_of(t: str) -> Column:
        return F.floor(F.col(t) / settings.conflict_window)

    spread = picks.select(
        *SERIES, "zone_no", "start_time", "end_time",
        F.explode(F.sequence(bin_of("start_time"), bin_of("end_time"))).alias("bin"),
    )
    if 2 * picks.count() <= settings.broadcast_rows:
        spread = F.broadcast(spread)
    acts = _shared(events, settings).select(*SERIES, "time_sec", "user", bin_of("time_sec").alias("bin"))
    inside = F.col("time_sec").between(F.col("start_time"), F.col("end_time"))
    return (
        acts.join(spread, [*SERIES, "bin"]).where(inside)
        .select(*SERIES, "zone_no", "user").distinct()
        .groupBy(*SERIES, "zone_no").agg(F.array_sort(F.collect_list("user")).alias("users"))
    )


def detect_conflicts(events: DataFrame, settings: PanelSettings = DEFAULTS) -> DataFrame:
    """The conflict zones of the shared parameters, numbered in time order per session and parameter.

    Counts of merged zones are sums over their picks, so a turn between two picks is not counted. The
    picks are written to the checkpoint folder: they are few, used twice, and dear to find.
    """
    ensure_checkpoint_dir(events.sparkSession)
    picks = _merge_picks(picked_windows(events, settings), settings).checkpoint()
    zones = picks.groupBy(*SERIES, "zone_no").agg(
        F.min("start_time").alias("start_time"),
        F.max("end_time").alias("end_time"),
        F.sum("num_changes").alias("num_changes"),
        F.sum("user_switches").alias("user_switches"),
    )
    return zones.join(_users_of_zones(picks, events, settings), [*SERIES, "zone_no"]).select(
        *SERIES, "zone_no", "start_time", "end_time", "users", "num_changes", "user_switches"
    )


def conflict_report(zones: DataFrame) -> DataFrame:
    """The zones as report lines."""
    seconds = [F.concat(fixed(F.col(c), 1), F.lit("s")) for c in ("start_time", "end_time")]
    return zones.select(
        *SERIES,
        "zone_no",
        F.concat_ws(" - ", *seconds).alias("span"),
        F.array_join(F.transform("users", lambda u: u.cast("string")), ", ").alias("users_involved"),
        "num_changes",
        "user_switches",
    )


def _whole_nodes(first: Column, end: Column) -> Column:
    """The fewest nodes of the pyramid that make up the blocks ``[first, end)``, as (level, node)."""
    def nodes(level: Column, lo: Column, hi: Column) -> Column:
        listed = F.when(hi > lo, F.sequence(lo, hi - 1)).otherwise(F.array().cast("array<bigint>"))
        return F.transform(listed, lambda node: F.struct(level.alias("level"), node.alias("node")))

    def step(held: Column, level: Column) -> Column:
        lo, hi = held["lo"], held["hi"]
        up, down = F.ceil(lo / PYRAMID).cast("long"), F.floor(hi / PYRAMID).cast("long")
        goes_on = up < down
        ends = F.concat(nodes(level, lo, up * PYRAMID), nodes(level, down * PYRAMID, hi))
        return F.struct(
            F.when(goes_on, up).otherwise(F.lit(0).cast("long")).alias("lo"),
            F.when(goes_on, down).otherwise(F.lit(0).cast("long")).alias("hi"),
            F.concat(held["nodes"], F.when(goes_on, ends).otherwise(nodes(level, lo, hi))).alias("nodes"),
        )

    none = F.array().cast("array<struct<level:int,node:bigint>>")
    begin = F.struct(first.cast("long").alias("lo"), end.cast("long").alias("hi"), none.alias("nodes"))
    return F.aggregate(F.array(*[F.lit(level) for level in range(PYRAMID_LEVELS)]), begin, step, lambda held: held["nodes"])


def zone_value_stats(zones: DataFrame, events: DataFrame, settings: PanelSettings = DEFAULTS) -> DataFrame:
    """Lowest and highest grid value inside each zone, and over the whole series.

    A zone sees the value it starts with and those of the runs that begin in it. The first is carried to it in
    the order of ticks. Of the others, whole blocks of ticks come from a pyramid of minima and maxima, sixteen nodes
    to one above, so a zone asks for some dozens of nodes at most, however long it is; runs are looked at only in the
    two blocks at its ends. No tick is spelled out, no run is cut. Zones without a value on the grid drop out.
    """
    ensure_checkpoint_dir(events.sparkSession)
    # Once for all uses, and only of series that have a zone.
    runs = merged_runs(events, settings, settings.shared_params).join(
        zones.select(*SERIES).distinct(), SERIES, "left_semi"
    ).checkpoint()
    block = max(1, math.ceil(settings.conflict_window / settings.tick))
    zone = [*SERIES, "zone_no"]

    series = runs.groupBy(*SERIES, "t_min", "step", "n_ticks").agg(
        F.min("value").alias("series_min"), F.max("value").alias("series_max")
    )
    ticks = zones.join(series, SERIES).withColumns({
        "z_lo": first_tick_from(F.col("start_time"), F.col("t_min"), F.col("step")),
        "z_hi": F.least("n_ticks", first_tick_beyond(F.col("end_time"), F.col("t_min"), F.col("step"))),
    }).where(F.col("z_hi") > F.col("z_lo")).select(
        *zone, "start_time", "end_time", "series_min", "series_max", "z_lo", "z_hi"
    ).checkpoint()

    counts = change_counts(events, keep=True)
    questions = ticks.select(*SERIES, F.col("z_lo").alias("at"), "zone_no", F.lit(None).cast("double").alias("value"))
    answers = runs.select(*SERIES, F.col("lo").alias("at"), F.lit(None).cast("long").alias("zone_no"), "value")
    asked = answers.withColumn("asks", F.lit(0)).unionByName(questions.withColumn("asks", F.lit(1)))
    # A series has at most one run and one zone per change.
    halved = replace(settings, hot_rows=settings.hot_rows // 2)
    carried = order_groups(asked, SERIES, ["at", "asks", "zone_no"], halved, counts).running(value=("last", "value")).done()
    at_start = carried.where((F.col("asks") == 1) & F.col("value").isNotNull()).select(
        *zone, F.col("value").alias("low"), F.col("value").alias("high")
    )

    points = runs.select(*SERIES, "lo", "value", "n_ticks", F.floor(F.col("lo") / block).alias("block"))
    ends = ticks.withColumn("block", F.explode(F.array_distinct(F.array(
        F.floor(F.col("z_lo") / block), F.floor((F.col("z_hi") - 1) / block)
    ))))
    at_ends = points.join(ends, [*SERIES, "block"]).where(
        (F.col("lo") > F.col("z_lo")) & (F.col("lo") < F.col("z_hi"))
    ).select(*zone, F.col("value").alias("low"), F.col("value").alias("high"))

    blocks = points.groupBy(*SERIES, "n_ticks", "block").agg(F.min("value").alias("low"), F.max("value").alias("high"))
    levels = F.array(*[F.lit(level) for level in range(PYRAMID_LEVELS)])
    needed = F.filter(levels, lambda level: (level == 0) | (F.pow(F.lit(PYRAMID), level) * block <= F.col("n_ticks")))
    node = F.floor(F.col("block") / F.pow(F.lit(PYRAMID), F.col("level"))).alias("node")
    pyramid = (
        blocks.withColumn("level", F.explode(needed)).select(*SERIES, "level", node, "low", "high")
        .groupBy(*SERIES, "level", "node").agg(F.min("low").alias("low"), F.max("high").alias("high"))
    )
    wanted = ticks.select(*zone, F.explode(_whole_nodes(
        F.floor(F.col("z_lo") / block) + 1, F.floor(F.col("z_hi") / block)
    )).alias("one")).select(*zone, "one.*")
    in_blocks = wanted.join(pyramid, [*SERIES, "level", "node"]).select(*zone, "low", "high")

    seen = at_start.unionByName(at_ends).unionByName(in_blocks).groupBy(*zone).agg(
        F.min("low").alias("value_min"), F.max("high").alias("value_max")
    )
    return ticks.drop("z_lo", "z_hi").join(seen, zone)


def conflict_annotations(stats: DataFrame) -> DataFrame:
    """Centre, size and label height of the highlight drawn around each zone."""
    span = F.greatest(
        F.col("value_max") - F.col("value_min"), (F.col("series_max") - F.col("series_min")) * 0.15
    )
    return stats.select(
        *SERIES,
        "zone_no",
        ((F.col("start_time") + F.col("end_time")) / 2).alias("center_time"),
        ((F.col("value_min") + F.col("value_max")) / 2).alias("center_value"),
        ((F.col("end_time") - F.col("start_time")) * 1.3).alias("width"),
        (span * 1.5).alias("height"),
        (F.col("value_max") + span * 0.3).alias("label_value"),
    )
