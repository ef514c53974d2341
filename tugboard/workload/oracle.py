"""The same answers in plain SQL for an embedded database, said another way where SQL allows.

Ticks are spelled out and met with changes by ASOF joins, windows are range frames, the greedy pick
is a recursive query, records are matched by one expression over a whole file's text.
"""

from __future__ import annotations

from tugboard.sources.event_table import SEATS
from tugboard.sources.imu_logs import IMU_COLUMNS, IMU_NUMERIC
from tugboard.workload.queries import (
    DIGITS,
    LATE_START,
    PAGE_OFFSET,
    REPORT_USER,
    STRETCHED,
    VIEW_PARAMS,
    VIEW_USERS,
)

# The formats of both kinds of lines and of sensor readings, said here a second time.
_LENIENT = r"(\d{2}:\d{2}:\d{2}\.\d+).*?(?:User\s*(\d+))?\s*sets\s+([a-zA-Z ]+?)\s+to\s+([-+]?\d*\.?\d+)"
_STRICT = r"(\d{2}:\d{2}:\d{2}\.\d+).*?(?:User\s*(\d+))?\s*sets\s+([a-zA-Z ]+)\s+to\s+([-\d.]+)"
_TIME = r"\d{2}:\d{2}:\d{2}\.\d+"
_THREE = r" = SensorInfo \{ Timestamp = (\d+), Accuracy = (\d+), Data = <([-\d.]+), ([-\d.]+), ([-\d.]+)> \}"
_FOUR = r"Rotation = SensorInfo \{ Timestamp = (\d+), Accuracy = (\d+), Data = \{X:([-\d.]+) Y:([-\d.]+) Z:([-\d.]+) W:([-\d.]+)\} \}"
_READINGS = [f"{name}{_THREE}" for name in ("Gyroscope", "Accelerometer", "MagneticField", "Gravity")] + [_FOUR]

TICK, WIDTH = STRETCHED.tick, STRETCHED.conflict_window
SHARED = ", ".join(f"'{p}'" for p in STRETCHED.shared_params)


def _r(expression: str, name: str | None = None) -> str:
    return f"round({expression}, {DIGITS}) AS {name or expression.split('.')[-1]}"


_EV = f"""
    SELECT 'panel-' || CAST(user_id // {SEATS} AS VARCHAR) AS session_id,
           'User' || CAST(user_id % {SEATS} AS VARCHAR) || '.log' AS file, event_id AS mid,
           strftime(ts, '%Y-%m-%d %H:%M:%S.%f') AS time, CAST(user_id % {SEATS} AS INTEGER) AS "user",
           event_type AS param, value, CAST(epoch_us(ts) AS DOUBLE) / 1e6 AS time_sec
    FROM events WHERE value IS NOT NULL AND user_id IS NOT NULL AND ts IS NOT NULL"""

_LINES = f"""
    SELECT 'panel-' || CAST(user_id // {SEATS} AS VARCHAR) AS session_id,
           'panel-' || CAST(user_id // {SEATS} AS VARCHAR) || '/User' || CAST(user_id % {SEATS} AS VARCHAR) || '.log' AS file,
           event_id AS mid, CAST(user_id % {SEATS} AS INTEGER) AS file_user,
           CASE event_id % 8
             WHEN 0 THEN t || ' User ' || u || ' sets ' || upper(left(p, 1)) || lower(substr(p, 2)) || ' to ' || v || '.'
             WHEN 1 THEN t || ' sets ' || p || ' level to -' || v
             WHEN 2 THEN t || ' User 9 resets ' || p || ' to +' || v
             WHEN 3 THEN t || ' [panel] user' || u || 'SETS ' || upper(p) || '  to ' || v || ' and User 9 sets gain to 1'
             WHEN 4 THEN 'heartbeat ' || t || ' ' || p
             WHEN 5 THEN left(t, 8) || ' User ' || u || ' sets ' || p || ' to ' || v
             WHEN 6 THEN t || ' User ' || u || ' sets ' || p || ' step to fast to ' || v
             ELSE t || ' User ' || u || ' sets ' || p || ' to ' || v END AS line
    FROM (SELECT *, strftime(ts, '%H:%M:%S.%f') AS t, CAST(user_id % {SEATS} AS VARCHAR) AS u,
                 event_type AS p, CAST(value AS VARCHAR) AS v FROM events)"""


def _matched(bare: str) -> str:
    return f"""
    SELECT *, TRY_CAST(value_text AS DOUBLE) AS value,
           CASE WHEN user_text <> '' THEN TRY_CAST(user_text AS BIGINT) ELSE CAST(file_user AS BIGINT) END AS "user"
    FROM (SELECT *, regexp_extract(line, '{bare}', 1, 'i') AS time, regexp_extract(line, '{bare}', 2, 'i') AS user_text,
                 trim(regexp_extract(line, '{bare}', 3, 'i')) AS param_text,
                 regexp_extract(line, '{bare}', 4, 'i') AS value_text
          FROM lines) WHERE time <> ''"""


def _parsed(table: str, param: str) -> str:
    return f"""
    SELECT session_id, file, mid, time, "user", {param} AS param, round(value, {DIGITS}) AS value,
           round((CAST(split_part(time, ':', 1) AS INTEGER) * 3600 + CAST(split_part(time, ':', 2) AS INTEGER) * 60)
             + CAST(split_part(time, ':', 3) AS DOUBLE), {DIGITS}) AS time_sec
    FROM {table} WHERE value IS NOT NULL AND "user" IS NOT NULL"""


_IMU_PATTERN = ".*?".join([f"({_TIME})", *_READINGS])
_IMU_TOKEN = "|".join([_TIME, *_READINGS, "Gyroscope"])
_IMU_NAMES = ", ".join(f"'{c}'" for c in IMU_COLUMNS)

_IMU_LINES = f"""
    SELECT session_id, session_id || '/imu_log.txt' AS file, event_id AS record, k, line
    FROM (SELECT 'panel-' || CAST(user_id // {SEATS} AS VARCHAR) AS session_id, event_id,
                 strftime(ts, '%H:%M:%S.%f') AS t, CAST(value AS VARCHAR) AS v, event_id * 5 AS n,
                 CASE event_id % 10 WHEN 5 THEN '1E-4' WHEN 9 THEN '1.2.3' ELSE CAST(value AS VARCHAR) END AS gx
          FROM events) e,
         LATERAL (VALUES
           (0, CASE WHEN event_id % 10 = 7 THEN t || ' boot' ELSE '# record' END),
           (1, t || ' Gyroscope = SensorInfo {{ Timestamp = ' || n || ', Accuracy = 3, Data = <' || gx || ', -' || v || ', 0.5> }}'),
           (2, 'Accelerometer = SensorInfo {{ Timestamp = ' || (n + 1) || ', Accuracy = 2, Data = <0.0, ' || v || ', -9.8> }}'),
           (3, 'MagneticField = SensorInfo {{ Timestamp = ' || (n + 2) || ', Accuracy = 1, Data = <' || v || ', 1, 41.0> }}'),
           (4, CASE WHEN event_id % 10 = 3 THEN 'sensor missing' ELSE
               'Gravity = SensorInfo {{ Timestamp = ' || (n + 3) || ', Accuracy = 3, Data = <0.0, 9.8, ' || v || '> }}' END),
           (5, 'Rotation = SensorInfo {{ Timestamp = ' || (n + 4) || ', Accuracy = 2, Data = {{X:0.0 Y:' || v || ' Z:-0.2 W:0.9}} }}')
         ) l(k, line)"""

# Named tables, each with the tables it reads.
TABLES: dict[str, tuple[tuple[str, ...], str]] = {
    "ev": ((), _EV),
    "lines": ((), _LINES),
    "lenient": (("lines",), _matched(_LENIENT)),
    "strict": (("lines",), _matched(_STRICT)),
    "imu_lines": ((), _IMU_LINES),
    "imu_texts": (("imu_lines",), """
    SELECT session_id, file, string_agg(line, chr(10) ORDER BY record, k) AS body FROM imu_lines GROUP BY ALL"""),
    "imu_matches": (("imu_texts",), f"""
    SELECT session_id, file, unnest(found) AS hit, generate_subscripts(found, 1) AS record_no
    FROM (SELECT session_id, file, regexp_extract_all(body, '{_IMU_PATTERN}', 0, 's') AS found FROM imu_texts)"""),
    "imu": (("imu_matches",), f"""
    SELECT session_id, file, CAST(record_no AS BIGINT) AS record_no, unnest(fields)
    FROM (SELECT *, regexp_extract(hit, '{_IMU_PATTERN}', [{_IMU_NAMES}], 's') AS fields FROM imu_matches)"""),
    # Letters: a time stamp, the five readings, a gyroscope without one. A frame begins at the last time stamp before G or x.
    "imu_tokens": (("imu_texts",), f"""
    SELECT *, CASE WHEN token = 'Gyroscope' THEN 'x' WHEN token LIKE 'Gy%' THEN 'G' WHEN token LIKE 'Gr%' THEN 'V'
                   WHEN regexp_matches(token, '^[AMR]') THEN left(token, 1) ELSE 'T' END AS letter
    FROM (SELECT session_id, file, unnest(found) AS token, generate_subscripts(found, 1) AS n
          FROM (SELECT session_id, file, regexp_extract_all(body, '{_IMU_TOKEN}', 0, 's') AS found FROM imu_texts))"""),
    "imu_pieces": (("imu_tokens",), """
    SELECT *, sum(CAST(letter = 'T' AS INTEGER)) OVER (PARTITION BY session_id, file ORDER BY n) AS piece FROM imu_tokens"""),
    "imu_frames": (("imu_pieces",), """
    SELECT session_id, file, frame_no, string_agg(letter, '' ORDER BY n) AS letters, list(token ORDER BY n) AS tokens
    FROM (SELECT *, CAST(coalesce(sum(CAST(letter = 'T' AND named AS INTEGER)) OVER (PARTITION BY session_id, file ORDER BY n), 0) AS BIGINT) AS frame_no
          FROM (SELECT *, bool_or(letter IN ('G', 'x')) OVER (PARTITION BY session_id, file, piece) AS named FROM imu_pieces))
    GROUP BY ALL"""),
    "imu_places": (("imu_frames",), """
    SELECT * EXCLUDE (p), CASE WHEN frame_no > 0 AND list_min(p) > 0 THEN p ELSE [] END AS places FROM (
      SELECT * EXCLUDE (a, b, c, d), [1, a, b, c, d, CASE WHEN d > 0 AND instr(substr(letters, d + 1), 'R') > 0 THEN d + instr(substr(letters, d + 1), 'R') ELSE 0 END] AS p FROM (
        SELECT *, CASE WHEN c > 0 AND instr(substr(letters, c + 1), 'V') > 0 THEN c + instr(substr(letters, c + 1), 'V') ELSE 0 END AS d FROM (
          SELECT *, CASE WHEN b > 0 AND instr(substr(letters, b + 1), 'M') > 0 THEN b + instr(substr(letters, b + 1), 'M') ELSE 0 END AS c FROM (
            SELECT *, CASE WHEN a > 0 AND instr(substr(letters, a + 1), 'A') > 0 THEN a + instr(substr(letters, a + 1), 'A') ELSE 0 END AS b
            FROM (SELECT *, instr(letters, 'G') AS a FROM imu_frames)))))"""),
    "bounds": (("ev",), f"""
    SELECT *, t_max - t_min AS duration, (t_min + {TICK}) - t_min AS step,
           CAST(ceil((t_max - t_min) / {TICK}) AS BIGINT) AS n_ticks
    FROM (SELECT session_id, min(time_sec) AS t_min, max(time_sec) AS t_max FROM ev GROUP BY ALL)"""),
    "ticks": (("bounds",), """
    SELECT session_id, i, t_min + i * step AS t
    FROM (SELECT *, unnest(range(n_ticks)) AS i FROM bounds)"""),
    "people": (("ev",), """SELECT DISTINCT session_id, "user" FROM ev"""),
    "controls": (("ev",), """SELECT DISTINCT session_id, param FROM ev"""),
    "pairs": (("people", "controls"), """SELECT * FROM people JOIN controls USING (session_id)"""),
    "counts": (("pairs", "ev"), """
    SELECT p.session_id, p."user", p.param, count(e.mid) AS changes
    FROM pairs p LEFT JOIN ev e ON (e.session_id = p.session_id AND e."user" = p."user" AND e.param = p.param)
    GROUP BY ALL"""),
    "totals": (("ev", "bounds"), """
    SELECT session_id, "user", n AS total_changes, CASE WHEN duration > 0 THEN n / duration * 60 ELSE 0 END AS changes_per_minute,
           first_action_time, last_action_time, last_action_time - first_action_time AS active_duration,
           CASE WHEN duration > 0 THEN (last_action_time - first_action_time) / duration * 100 ELSE 0 END AS activity_percentage
    FROM (SELECT session_id, "user", count(*) AS n, min(time_sec) AS first_action_time, max(time_sec) AS last_action_time
          FROM ev GROUP BY ALL) JOIN bounds USING (session_id)"""),
    "shares": (("counts", "totals"), """
    SELECT c.*, changes / total_changes * 100 AS share_percent FROM counts c JOIN totals USING (session_id, "user")"""),
    "gaps": (("ev",), f"""
    SELECT session_id, "user", coalesce(max(gap), 0.0) AS max_inactivity_gap, coalesce(avg(gap), 0.0) AS avg_gap_between_changes,
           count(*) FILTER (gap > {STRETCHED.long_gap}) AS long_inactivity_periods
    FROM (SELECT *, time_sec - lag(time_sec) OVER (PARTITION BY session_id, "user" ORDER BY time_sec) AS gap FROM ev)
    GROUP BY ALL"""),
    "merged": (("ticks", "controls", "ev"), """
    SELECT k.session_id, k.param, k.i, k.t, e.value, e."user" AS owner
    FROM (SELECT * FROM ticks JOIN controls USING (session_id)) k
    ASOF LEFT JOIN ev e ON k.session_id = e.session_id AND k.param = e.param AND k.t >= e.time_sec"""),
    "locf": (("ticks", "pairs", "ev"), """
    SELECT k.session_id, k.param, k.i, k.t, k."user", e.value
    FROM (SELECT * FROM ticks JOIN pairs USING (session_id)) k
    ASOF LEFT JOIN ev e ON k.session_id = e.session_id AND k.param = e.param AND k."user" = e."user" AND k.t >= e.time_sec"""),
    "control": (("pairs", "merged", "bounds"), f"""
    SELECT session_id, param, "user", secs AS control_seconds,
           CASE WHEN duration > 0 THEN secs / duration * 100 ELSE 0 END AS control_percent
    FROM (SELECT p.session_id, p.param, p."user", CAST(count(m.i) * {TICK} AS DOUBLE) AS secs
          FROM pairs p LEFT JOIN merged m ON (m.session_id = p.session_id AND m.param = p.param AND m.owner = p."user")
          WHERE p.param IN ({SHARED}) GROUP BY ALL) JOIN bounds USING (session_id)"""),
    "steps": (("ev",), """
    SELECT session_id, "user", param, step, max(value) OVER w - min(value) OVER w AS reach
    FROM (SELECT *, abs(value - lag(value) OVER (PARTITION BY session_id, "user", param ORDER BY time_sec, mid)) AS step FROM ev)
    WINDOW w AS (PARTITION BY session_id, "user", param)"""),
    "care": (("pairs", "steps"), f"""
    SELECT session_id, "user", param, avg_step, max_step,
           CASE WHEN max_step > 0 THEN small / n * 100 WHEN max_step = 0 THEN 0.0 END AS careful_ratio,
           CASE WHEN max_step IS NULL THEN 'Insufficient data' WHEN max_step = 0 THEN 'Careful (no variation)'
                WHEN small / n * 100 > {STRETCHED.careful_percent} THEN 'Careful' ELSE 'Reckless' END AS behavior_type
    FROM (SELECT session_id, "user", param, avg(step) AS avg_step, max(step) AS max_step, count(step) AS n,
                 count(*) FILTER (step <= {STRETCHED.small_step} * reach) AS small
          FROM pairs LEFT JOIN steps USING (session_id, "user", param) GROUP BY ALL)"""),
    "care_users": (("care",), f"""
    SELECT *, CASE WHEN careful_percent IS NULL THEN 'Insufficient data'
                   WHEN careful_percent >= {STRETCHED.careful_percent} THEN 'Careful' ELSE 'Reckless' END AS label
    FROM (SELECT session_id, "user", avg(CASE WHEN behavior_type LIKE 'Careful%' THEN 1.0 ELSE 0.0 END)
                   FILTER (behavior_type <> 'Insufficient data') * 100 AS careful_percent
          FROM care GROUP BY ALL)"""),
    "engaged": (("totals",), """
    SELECT session_id, "user", total_changes, pct AS engagement_percent, repeat('█', CAST(floor(pct / 2) AS INTEGER)) AS bar,
           repeat('█', CAST(floor(pct / 2) AS INTEGER)) || repeat('░', 50 - CAST(floor(pct / 2) AS INTEGER)) AS panel_bar
    FROM (SELECT *, total_changes / sum(total_changes) OVER (PARTITION BY session_id) * 100 AS pct FROM totals)"""),
    "active": (("totals",), """
    SELECT session_id, "user", total_changes FROM totals
    QUALIFY row_number() OVER (PARTITION BY session_id ORDER BY total_changes DESC, "user") = 1"""),
    "responsive": (("totals",), """
    SELECT session_id, "user", changes_per_minute FROM totals
    QUALIFY row_number() OVER (PARTITION BY session_id ORDER BY changes_per_minute DESC, "user") = 1"""),
    "dominant": (("control",), """
    SELECT * FROM control
    QUALIFY row_number() OVER (PARTITION BY session_id, param ORDER BY control_seconds DESC, "user") = 1"""),
    "looks": (("ev",), f"""
    SELECT session_id, param, time_sec AS start_time, max(time_sec) OVER w AS end_time, count(*) OVER w AS num_changes,
           CAST(sum(turn) OVER w - turn AS BIGINT) AS user_switches, count(DISTINCT "user") OVER w AS num_users
    FROM (SELECT *, CASE WHEN "user" <> lag("user") OVER (PARTITION BY session_id, param ORDER BY time_sec) THEN 1 ELSE 0 END AS turn
          FROM ev WHERE param IN ({SHARED}))
    WINDOW w AS (PARTITION BY session_id, param ORDER BY time_sec RANGE BETWEEN CURRENT ROW AND {WIDTH} FOLLOWING)"""),
    "cand": (("looks",), f"""
    SELECT * EXCLUDE num_users, row_number() OVER (PARTITION BY session_id, param ORDER BY start_time) AS rn FROM looks
    WHERE num_changes >= {STRETCHED.min_changes} AND user_switches >= {STRETCHED.min_users}"""),
    "linked": (("cand",), """
    SELECT c.*, d.rn AS next_rn FROM cand c
    ASOF LEFT JOIN cand d ON c.session_id = d.session_id AND c.param = d.param AND c.end_time < d.start_time"""),
    "pick": (("linked",), """
    SELECT * FROM linked WHERE rn = 1
    UNION ALL
    SELECT l.* FROM pick p JOIN linked l ON l.session_id = p.session_id AND l.param = p.param AND l.rn = p.next_rn"""),
    "zoned": (("pick",), f"""
    SELECT *, sum(opens) OVER (PARTITION BY session_id, param ORDER BY start_time) AS zone_no
    FROM (SELECT *, CASE WHEN start_time - lag(end_time) OVER (PARTITION BY session_id, param ORDER BY start_time)
                           <= {STRETCHED.merge_gap} THEN 0 ELSE 1 END AS opens FROM pick)"""),
    "zones": (("zoned", "ev"), """
    SELECT z.session_id, z.param, CAST(z.zone_no AS BIGINT) AS zone_no, z.start_time, z.end_time, z.num_changes, z.user_switches, u.users
    FROM (SELECT session_id, param, zone_no, min(start_time) AS start_time, max(end_time) AS end_time,
                 CAST(sum(num_changes) AS BIGINT) AS num_changes, CAST(sum(user_switches) AS BIGINT) AS user_switches
          FROM zoned GROUP BY ALL) z
    JOIN (SELECT session_id, param, zone_no, string_agg(CAST("user" AS VARCHAR), ',' ORDER BY "user") AS users
          FROM (SELECT DISTINCT z.session_id, z.param, z.zone_no, e."user" FROM zoned z JOIN ev e
                  ON e.session_id = z.session_id AND e.param = z.param AND e.time_sec BETWEEN z.start_time AND z.end_time)
          GROUP BY ALL) u
    ON u.session_id = z.session_id AND u.param = z.param AND u.zone_no = z.zone_no"""),
    "stats": (("zones", "merged"), """
    SELECT z.session_id, z.param, z.zone_no, z.start_time, z.end_time, r.series_min, r.series_max,
           min(m.value) AS value_min, max(m.value) AS value_max
    FROM zones z
    JOIN merged m ON m.session_id = z.session_id AND m.param = z.param AND m.t BETWEEN z.start_time AND z.end_time
    JOIN (SELECT session_id, param, min(value) AS series_min, max(value) AS series_max FROM merged GROUP BY ALL) r
      ON r.session_id = z.session_id AND r.param = z.param
    WHERE m.value IS NOT NULL GROUP BY ALL"""),
}


def _with(final: str, *needed: str) -> str:
    order: list[str] = []

    def visit(name: str) -> None:
        for other in TABLES[name][0]:
            visit(other)
        if name not in order:
            order.append(name)

    for name in needed:
        visit(name)
    parts = [f"{name} AS ({TABLES[name][1]}\n)" for name in order]
    return f"WITH RECURSIVE {', '.join(parts)}\n{final}"


_LOCF = f'session_id, param, i, {_r("t")}, "user", {_r("value")}'
_GAPS = f"{_r('max_inactivity_gap')}, {_r('avg_gap_between_changes')}, long_inactivity_periods"
_SPAN = ", ".join(_r(c) for c in ("first_action_time", "last_action_time", "active_duration", "activity_percentage"))
_CARE = f"{_r('avg_step')}, {_r('max_step')}, {_r('careful_ratio')}, behavior_type"
_LABEL = "upper(left(param, 1)) || lower(substr(param, 2)) AS param_label"
_SEGMENTS = f"""
SELECT session_id, "user", param, start_time, time AS end_time, {_r('from_value')}, {_r('value', 'to_value')}
FROM (SELECT *, lag(time) OVER w AS start_time, lag(value) OVER w AS from_value FROM ev
      WINDOW w AS (PARTITION BY session_id, "user", param ORDER BY time, file, mid)) WHERE value <> from_value"""


# The same answers, read from a store laid out by session and time.
STORED = {"time_viewport_stored": "time_viewport_late", "time_in_control_stored": "time_in_control"}

# Registered a second time by the plans for large data; the answers are the same.
SLICED = (
    "change_segments", "inactivity_gaps", "time_in_control", "carefulness", "conflict_candidates",
    "conflict_candidates_three_users", "detect_conflicts", "zone_value_stats",
)


def oracle_sql() -> dict[str, str]:
    typed = [
        _r(f"TRY_CAST({c} AS DOUBLE)", c) if kind == "double"
        else f"TRY_CAST({c} AS {'BIGINT' if kind == 'long' else 'INTEGER'}) AS {c}"
        for c, kind in IMU_NUMERIC
    ]
    bad = ", ".join(
        f"count(*) FILTER (TRY_CAST({c} AS {dict(double='DOUBLE', long='BIGINT', int='INTEGER')[kind]}) IS NULL) AS {c}"
        for c, kind in IMU_NUMERIC
    )
    wide = ", ".join(f'round(max(value) FILTER ("user" = {u}), {DIGITS}) AS user_{u}' for u in range(SEATS))
    users, params = ", ".join(map(str, VIEW_USERS)), ", ".join(f"'{p}'" for p in VIEW_PARAMS)
    page = f"least({PAGE_OFFSET}, greatest(0, n - {STRETCHED.page_size}))"
    care_report = f"""
        SELECT c.session_id, c."user", c.param, {_CARE}, {_r('careful_percent')}, label, {_LABEL}
        FROM care c JOIN care_users USING (session_id, "user")"""
    plain = {
        "parse_control_events": _with(_parsed("lenient", "lower(param_text)"), "lenient"),
        "parse_control_events_strict": _with(_parsed("strict", "param_text"), "strict"),
        "rejected_lines": _with("""
            SELECT session_id, file, mid, line, user_text, value_text FROM strict
            WHERE value IS NULL OR "user" IS NULL""", "strict"),
        "parse_imu_records": _with("SELECT * FROM imu", "imu"),
        "imu_numeric_cast": _with(f"SELECT session_id, file, record_no, time, {', '.join(typed)} FROM imu", "imu"),
        "imu_bad_cells": _with(f"SELECT {bad} FROM imu", "imu"),
        "imu_numeric_columns": _with(
            f"SELECT session_id, file, record_no, time, gyro_x, {', '.join(c for c in typed if ' AS gyro_x' not in c)} FROM imu",
            "imu"),
        "parse_imu_framed": _with(f"""
            SELECT session_id, file, frame_no, unnest(regexp_extract(hit, '{_IMU_PATTERN}', [{_IMU_NAMES}], 's'))
            FROM (SELECT *, array_to_string(list_transform(places, lambda k: tokens[k]), ' ') AS hit FROM imu_places WHERE len(places) > 0)""",
            "imu_places"),
        "imu_rejects": _with("""
            SELECT session_id, file, frame_no, reading,
                   CASE left(reading, 2) WHEN 'Gy' THEN 'gyro' WHEN 'Ac' THEN 'acc' WHEN 'Ma' THEN 'mag' WHEN 'Gr' THEN 'grav' ELSE 'rot' END AS sensor
            FROM (SELECT session_id, file, frame_no, places, unnest(tokens) AS reading, generate_subscripts(tokens, 1) AS k FROM imu_places)
            WHERE NOT list_contains(places, k) AND NOT regexp_matches(reading, '^[0-9]')""", "imu_places"),
        "parse_control_log_files": _with(f"SELECT * EXCLUDE mid FROM ({_parsed('lenient', 'lower(param_text)')})", "lenient"),
        "rejected_lines_of_files": _with("""
            SELECT session_id, file, line, user_text, value_text FROM strict WHERE value IS NULL OR "user" IS NULL""", "strict"),
        "change_segments_of_files": _with(f"""
            SELECT session_id, "user", param, start_time, time AS end_time, {_r('from_value')}, {_r('value', 'to_value')}
            FROM (SELECT *, lag(time) OVER w AS start_time, lag(value) OVER w AS from_value
                  FROM (SELECT *, param_text AS param FROM strict WHERE value IS NOT NULL AND "user" IS NOT NULL)
                  WINDOW w AS (PARTITION BY session_id, "user", param ORDER BY time, file, mid)) WHERE value <> from_value""", "strict"),
        "parse_summary": _with("""
            SELECT session_id, count(*) AS n_changes, count(DISTINCT "user") AS n_users, count(DISTINCT param) AS n_params
            FROM ev GROUP BY ALL""", "ev"),
        "session_bounds": _with(f"""
            SELECT session_id, {_r('t_min')}, {_r('t_max')}, {_r('duration')}, {_r('step')}, n_ticks FROM bounds""", "bounds"),
        "distinct_users": _with("SELECT * FROM people", "people"),
        "distinct_params": _with(f"""
            SELECT session_id, param, {_r('min(time_sec)', 'first_time')},
                   row_number() OVER (PARTITION BY session_id ORDER BY min(time_sec)) AS position
            FROM ev GROUP BY session_id, param""", "ev"),
        "user_change_counts": _with(f"""
            SELECT session_id, "user", total_changes, {_r('changes_per_minute')} FROM totals""", "totals"),
        "param_change_counts": _with(f"""
            SELECT session_id, "user", param, changes, {_r('share_percent')} FROM shares""", "shares"),
        "change_segments": _with(_SEGMENTS, "ev"),
        "change_segments_preview": _with(
            f'{_SEGMENTS} ORDER BY session_id, "user", param, end_time LIMIT {STRETCHED.preview_rows}', "ev"),
        "locf_series": _with(f"SELECT {_LOCF} FROM locf", "locf"),
        "merged_series": _with(f"SELECT session_id, param, i, {_r('t')}, {_r('value')}, owner FROM merged", "merged"),
        "ownership_segments": _with(f"""
            SELECT session_id, param, owner, {_r('min(t)', 'start_time')}, {_r('max(t)', 'end_time')}, count(*) AS ticks
            FROM (SELECT *, i - row_number() OVER (PARTITION BY session_id, param, owner ORDER BY i) AS stretch
                  FROM merged WHERE owner IS NOT NULL AND param IN ({SHARED}))
            GROUP BY session_id, param, owner, stretch""", "merged"),
        "series_wide": _with(f"SELECT session_id, param, i, {_r('t')}, {wide} FROM locf GROUP BY session_id, param, i, t", "locf"),
        "time_in_control": _with(f"""
            SELECT session_id, param, "user", {_r('control_seconds')}, {_r('control_percent')} FROM control""", "control"),
        "inactivity_gaps": _with(f'SELECT session_id, "user", {_GAPS} FROM gaps', "gaps"),
        "activity_span": _with(f'SELECT session_id, "user", {_SPAN} FROM totals', "totals"),
        "user_activity": _with(f"""
            SELECT t.session_id, t."user", total_changes, {_r('changes_per_minute')}, param_changes,
                   time_in_control, {_GAPS}, {_SPAN}
            FROM totals t JOIN gaps USING (session_id, "user")
            JOIN (SELECT session_id, "user", string_agg(param || '=' || changes, ';' ORDER BY param) AS param_changes
                  FROM counts GROUP BY ALL) USING (session_id, "user")
            JOIN (SELECT session_id, "user", string_agg(param || '=' || CAST(round(control_seconds, 0) AS BIGINT), ';' ORDER BY param) AS time_in_control
                  FROM control GROUP BY ALL) USING (session_id, "user")""", "totals", "gaps", "counts", "control"),
        "engagement_distribution": _with(f"""
            SELECT session_id, "user", total_changes, {_r('engagement_percent')}, bar, panel_bar FROM engaged""", "engaged"),
        "most_active_user": _with("SELECT * FROM active", "active"),
        "most_dominant_user": _with(f"""
            SELECT session_id, param, "user", {_r('control_seconds')}, {_r('control_percent')} FROM dominant""", "dominant"),
        "most_responsive_user": _with(f'SELECT session_id, "user", {_r("changes_per_minute")} FROM responsive', "responsive"),
        "carefulness": _with(f'SELECT session_id, "user", param, {_CARE} FROM care', "care"),
        "carefulness_summary": _with(f'SELECT session_id, "user", {_r("careful_percent")}, label FROM care_users', "care_users"),
        "carefulness_summary_judged": _with(f"""
            SELECT session_id, "user", {_r("careful_percent")}, label FROM care_users
            WHERE careful_percent IS NOT NULL""", "care_users"),
        "carefulness_report": _with(care_report, "care_users"),
        "carefulness_report_one_user": _with(f'{care_report} WHERE c."user" = {REPORT_USER}', "care_users"),
        "conflict_candidates": _with(f"""
            SELECT session_id, param, {_r('start_time')}, {_r('end_time')}, num_changes, user_switches FROM cand""", "cand"),
        "conflict_candidates_three_users": _with(f"""
            SELECT session_id, param, {_r('start_time')}, {_r('end_time')}, num_changes, user_switches FROM looks
            WHERE num_changes >= {STRETCHED.min_changes} AND user_switches >= 3 AND num_users >= 3""", "looks"),
        "detect_conflicts": _with(f"""
            SELECT session_id, param, zone_no, {_r('start_time')}, {_r('end_time')}, users, num_changes, user_switches
            FROM zones""", "zones"),
        "conflict_report": _with("""
            SELECT session_id, param, zone_no, printf('%.1fs - %.1fs', start_time, end_time) AS span,
                   replace(users, ',', ', ') AS users_involved, num_changes, user_switches FROM zones""", "zones"),
        "zone_value_stats": _with(f"""
            SELECT session_id, param, zone_no, {', '.join(_r(c) for c in (
                'start_time', 'end_time', 'series_min', 'series_max', 'value_min', 'value_max'))} FROM stats""", "stats"),
        "conflict_annotations": _with("""
            SELECT session_id, param, zone_no, (start_time + end_time) / 2 AS center_time,
                   (value_min + value_max) / 2 AS center_value, (end_time - start_time) * 1.3 AS width,
                   span * 1.5 AS height, value_max + span * 0.3 AS label_value
            FROM (SELECT *, greatest(value_max - value_min, (series_max - series_min) * 0.15) AS span FROM stats)""", "stats"),
        "select_view": _with(f"""
            SELECT {_LOCF} FROM locf WHERE "user" IN ({users}) AND param IN ({params})""", "locf"),
        "time_viewport": _with(f"""
            SELECT {_LOCF} FROM locf JOIN bounds USING (session_id)
            WHERE t BETWEEN t_min AND t_min + {STRETCHED.viewport}""", "locf", "bounds"),
        "pairwise_synchrony": _with(f"""
            SELECT session_id, param, user_a, user_b, CAST(count(x) AS BIGINT) AS common_ticks,
                   {_r('CASE WHEN min(x) < max(x) AND min(y) < max(y) THEN corr(x, y) END', 'correlation')}
            FROM (SELECT a.session_id, a.param, a."user" AS user_a, b."user" AS user_b,
                         CASE WHEN b.value IS NOT NULL THEN a.value END AS x, CASE WHEN a.value IS NOT NULL THEN b.value END AS y
                  FROM locf a JOIN locf b ON a.session_id = b.session_id AND a.param = b.param AND a.i = b.i AND a."user" < b."user")
            GROUP BY session_id, param, user_a, user_b""", "locf"),
        "time_viewport_late": _with(f"""
            SELECT {_LOCF} FROM locf WHERE t BETWEEN {LATE_START} AND {LATE_START + STRETCHED.viewport}""", "locf"),
        "time_viewport_full": _with(f"SELECT {_LOCF} FROM locf", "locf"),
        "param_page": _with(f"""
            SELECT session_id, place, param
            FROM (SELECT *, row_number() OVER (PARTITION BY session_id ORDER BY param) AS place,
                         count(*) OVER (PARTITION BY session_id) AS n FROM controls)
            WHERE place > {page} AND place <= {page} + {STRETCHED.page_size}""", "controls"),
        "session_overview": _with(f"""
            SELECT session_id, {_r('duration', 'seconds')}, {_r('duration / 60', 'minutes')}, params
            FROM bounds JOIN (SELECT session_id, string_agg(upper(left(param, 1)) || lower(substr(param, 2)), ', ' ORDER BY param) AS params
                              FROM controls GROUP BY ALL) USING (session_id)""", "bounds", "controls"),
        "session_report": _with(f"""
            SELECT t.session_id, t."user", s.param, total_changes, {_r('changes_per_minute')}, {_GAPS}, {_SPAN},
                   {_r('active_duration / 60', 'active_minutes')}, changes, {_r('share_percent')},
                   {_r('control_seconds')}, {_r('control_percent')}, {_CARE}, {_LABEL}
            FROM totals t JOIN gaps USING (session_id, "user") JOIN shares s USING (session_id, "user")
            JOIN care USING (session_id, "user", param) LEFT JOIN control USING (session_id, "user", param)""",
            "totals", "gaps", "shares", "control", "care"),
        "stats_panel": _with("""
            SELECT session_id, "user", concat_ws('  |  ', 'User ' || "user" || ': ' || total_changes || ' changes',
                   printf('%.1f chg/min', changes_per_minute), cells, printf('Max gap: %.1fs', max_inactivity_gap)) AS line
            FROM totals JOIN gaps USING (session_id, "user") LEFT JOIN (
              SELECT session_id, "user", string_agg(printf('%s dominance: %.1f%%', upper(left(param, 1)) || lower(substr(param, 2)),
                     control_percent), '  |  ' ORDER BY param) AS cells
              FROM control GROUP BY ALL) USING (session_id, "user")""", "totals", "gaps", "control"),
        "comparative_report": _with(f"""
            SELECT e.session_id, e."user", e.total_changes, {_r('engagement_percent')}, bar, panel_bar,
                   {_r('careful_percent')}, label, a."user" AS most_active_user, a.total_changes AS most_changes,
                   r."user" AS most_responsive_user, {_r('r.changes_per_minute', 'best_rate')}, d.param AS dominant_param, d."user" AS dominant_user,
                   {_r('d.control_seconds', 'dominant_seconds')}, {_r('d.control_percent', 'dominant_percent')}
            FROM engaged e JOIN care_users c ON c.session_id = e.session_id AND c."user" = e."user"
            JOIN active a ON a.session_id = e.session_id JOIN responsive r ON r.session_id = e.session_id
            LEFT JOIN dominant d ON d.session_id = e.session_id""",
            "engaged", "care_users", "active", "responsive", "dominant"),
    }
    first_page = plain["param_page"].replace(page, "0")
    again = {f"{name}_sliced": plain[name] for name in SLICED} | {name: plain[same] for name, same in STORED.items()}
    return plain | {"param_page_first": first_page} | again
