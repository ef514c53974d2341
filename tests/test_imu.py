from __future__ import annotations

import random
import re

import pytest

from tugboard.sources.imu_logs import (
    IMU_COLUMNS,
    SENSORS,
    TIME_TOKEN,
    imu_bad_cells,
    imu_numeric_cast,
    imu_numeric_columns,
    imu_rejects,
    parse_imu_framed,
    parse_imu_records,
    read_imu_logs,
)


def token(kind, n):
    v = f"{n / 8}"
    return [
        f"10:00:{n % 60:02d}.{n}",
        f"Gyroscope = SensorInfo {{ Timestamp = {n}, Accuracy = 3, Data = <{v}, -0.2, 0.3> }}",
        f"Accelerometer = SensorInfo {{ Timestamp = {n}, Accuracy = 2, Data = <0.0, {v}, 0.1> }}",
        f"MagneticField = SensorInfo {{ Timestamp = {n}, Accuracy = 1, Data = <20.5, -3.0, {v}> }}",
        f"Gravity = SensorInfo {{ Timestamp = {n}, Accuracy = 0, Data = <{v}, 9.8, 0.0> }}",
        f"Rotation = SensorInfo {{ Timestamp = {n}, Accuracy = 3, Data = {{X:0.0 Y:0.1 Z:{v} W:0.9}} }}",
    ][kind]


def record(n):
    return [f"{token(0, n)} {token(1, n)}"] + [token(k, n) for k in range(2, 6)]


def whole_text_match(text):
    """The definition: one lazy expression over the whole text."""
    pattern = re.compile(".*?".join([f"({TIME_TOKEN})", *SENSORS.values()]), re.DOTALL)
    return [m.groups() for m in pattern.finditer(text)]


def parsed(spark, folder):
    rows = parse_imu_records(read_imu_logs(spark, str(folder))).orderBy("file", "record_no").collect()
    return [tuple(r[c] for c in IMU_COLUMNS) for r in rows]


CASES = {
    "one record": record(1),
    "all on one line": [" ".join(record(1) + record(2))],
    "exponent in the gyroscope": [*record(1)[:1], *record(2)],
    "bad reading": [record(1)[0].replace("0.125", "1E-4"), *record(1)[1:], *record(2)],
    "no gravity": record(1)[:3] + record(1)[4:] + record(2),
    "earlier time stamp": ["09:59:59.000 boot", *record(1)],
    "incomplete end": [*record(1), *record(2)[:3]],
    "no time": [r.split(" ", 1)[1] if i == 0 else r for i, r in enumerate(record(1))],
    "empty": [""],
}


@pytest.mark.parametrize("case", CASES)
def test_cases_equal_the_whole_text_match(spark, tmp_path, case):
    text = "\n".join(CASES[case]) + "\n"
    (tmp_path / "imu_log.txt").write_text(text)
    assert parsed(spark, tmp_path) == whole_text_match(text)


def test_known_outcomes(spark, tmp_path):
    (tmp_path / "imu_log.txt").write_text("\n".join(CASES["bad reading"]) + "\n")
    (row,) = parsed(spark, tmp_path)
    assert row[0] == "10:00:01.1" and row[1] == "2"  # first time, second record's sensors


def framed(text):
    """The frames of a text, said plainly: (number, fields) of each record, (number, sensor, reading) of all other readings."""
    found = re.finditer("|".join([TIME_TOKEN, *SENSORS.values(), "Gyroscope"]), text)
    names = ["Gyroscope", "Acc", "Mag", "Grav", "Rot"]
    tokens = [(next((k for k, name in enumerate(names, 1) if m[0].startswith(name)), 0), m[0]) for m in found]
    pieces = [[]]
    for kind, token in tokens:
        if kind == 0:
            pieces.append([])
        pieces[-1].append((kind, token))
    frames = [[]]   # what lies before the first one
    for piece in pieces:
        if piece and piece[0][0] == 0 and any(kind == 1 for kind, _ in piece):
            frames.append([])
        frames[-1] += piece
    records, rejects = [], []
    for number, frame in enumerate(frames):
        taken = []
        for at, (kind, token) in enumerate(frame):
            if kind == len(taken) < 6 and (kind != 1 or token != "Gyroscope") and (taken or number):
                taken.append(at)
        if len(taken) == 6:
            records.append((number, *(x for at in taken for x in whole_text_groups(frame[at][1]))))
        else:
            taken = []
        rejects += [(number, list(SENSORS)[kind - 1], token) for at, (kind, token) in enumerate(frame) if kind and at not in taken]
    return records, sorted(rejects)


def whole_text_groups(token):
    return next(m.groups() or (m[0],) for m in (re.fullmatch(p, token) for p in [TIME_TOKEN, *SENSORS.values()]) if m)


def framed_by_spark(spark, lines):
    records = [tuple(r[c] for c in ["frame_no", *IMU_COLUMNS]) for r in parse_imu_framed(lines).orderBy("file", "frame_no").collect()]
    return records, sorted(tuple(r)[2:] for r in imu_rejects(lines).collect())


@pytest.mark.parametrize("case", CASES)
def test_cases_in_frames(spark, tmp_path, case):
    text = "\n".join(CASES[case]) + "\n"
    (tmp_path / "imu_log.txt").write_text(text)
    assert framed_by_spark(spark, read_imu_logs(spark, str(tmp_path))) == framed(text)


def test_known_frames(spark, tmp_path):
    text = "\n".join([token(2, 9), "09:59:59.000 boot", *CASES["bad reading"], token(5, 8), *CASES["no gravity"]]) + "\n"
    (tmp_path / "imu_log.txt").write_text(text)
    records, rejects = framed_by_spark(spark, read_imu_logs(spark, str(tmp_path)))
    # The malformed gyroscope's frame is the first, and its sensors do not go to the next record.
    assert [(r[0], r[1], r[2]) for r in records] == [(2, "10:00:02.2", "2"), (4, "10:00:02.2", "2")]
    assert [(n, s) for n, s, _ in rejects] == [
        (0, "acc"), (1, "acc"), (1, "grav"), (1, "gyro"), (1, "mag"), (1, "rot"), (2, "rot"), (3, "acc"), (3, "gyro"), (3, "mag"), (3, "rot"),
    ]


def soup(seed, size=250):
    rng = random.Random(seed)
    lines, n = [], 0
    while n < size:
        n += 1
        roll = rng.random()
        if roll < 0.5:
            lines += record(n)
        elif roll < 0.8:
            lines += [token(rng.randrange(6), n)]
        elif roll < 0.9:
            lines += [x for x in record(n) if rng.random() < 0.7]
        elif roll < 0.93:
            lines += [token(1, n).replace("-0.2", "1E-4"), f"{token(0, n)} {token(0, n + 1)}", token(3, n) + token(4, n)]
        else:
            lines += ["noise 12:00 SensorInfo { }", ""]
    return "\n".join(lines) + "\n"


@pytest.mark.parametrize("seed, split, batch", [(1, 10_000, 97), (2, 4_000, 3), (3, 700, 10_000)])
def test_token_soup_over_many_splits(spark, tmp_path, seed, split, batch):
    texts = {name: soup(seed + k) for k, name in enumerate(("imu_log_a.txt", "imu_log_b.txt"))}
    for name, text in texts.items():
        (tmp_path / name).write_text(text)
    spark.conf.set("spark.sql.files.maxPartitionBytes", str(split))
    spark.conf.set("spark.sql.files.openCostInBytes", "100")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(batch))
    try:
        lines = read_imu_logs(spark, str(tmp_path))
        assert lines.select("file", "block_start").distinct().count() > 10
        found = parsed(spark, tmp_path)
        frames, rejects = framed_by_spark(spark, lines)
        # No two lines of a split need to lie together.
        again = parse_imu_records(lines.repartition(5, "mid")).orderBy("file", "record_no").collect() if seed == 1 else None
    finally:
        for name in ("files.maxPartitionBytes", "files.openCostInBytes", "execution.arrow.maxRecordsPerBatch"):
            spark.conf.unset(f"spark.sql.{name}")
    assert found == [hit for name in sorted(texts) for hit in whole_text_match(texts[name])]
    assert again is None or [tuple(r[c] for c in IMU_COLUMNS) for r in again] == found
    plain = [framed(texts[name]) for name in sorted(texts)]
    assert frames == [r for records, _ in plain for r in records] and rejects == sorted(r for _, left in plain for r in left)
    # No reading is in both tables or in none.
    readings = len(re.findall("|".join(SENSORS.values()), "".join(texts.values())))
    assert 5 * len(frames) + sum(token != "Gyroscope" for _, _, token in rejects) == readings


def test_numeric_cast(spark, tmp_path):
    bad = [record(1)[0].replace("0.125", "1.2.3"), *record(1)[1:]]
    (tmp_path / "imu_log.txt").write_text("\n".join(bad + record(2)) + "\n")
    records = parse_imu_records(read_imu_logs(spark, str(tmp_path)))
    first, second = imu_numeric_cast(records).orderBy("record_no").collect()
    assert first.gyro_x is None and second.gyro_x == 0.25 and second.gyro_ts == 2
    assert {c: n for c, n in imu_bad_cells(records).first().asDict().items() if n} == {"gyro_x": 1}
    kinds = dict(imu_numeric_columns(records).dtypes)
    assert kinds["gyro_x"] == "string" and kinds["gyro_y"] == "double" and kinds["acc_ts"] == "bigint"
    kept = imu_numeric_columns(records).orderBy("record_no").first()
    assert kept.gyro_x == "1.2.3"


def test_nothing_found(spark, tmp_path):
    (tmp_path / "imu_log.txt").write_text("no data\n")
    with pytest.raises(ValueError, match="no sensor records"):
        parse_imu_records(read_imu_logs(spark, str(tmp_path)), require_nonempty=True)


def test_tasks_need_no_install(tmp_path):
    """The functions travel by value: a bare interpreter elsewhere can load and run them."""
    import subprocess
    import sys

    from pyspark import cloudpickle

    from tugboard.operators import conflicts
    from tugboard.sources import imu_logs

    functions = [
        imu_logs._machines, imu_logs._framed, imu_logs._entry_states,
        conflicts._chain_ends, conflicts._chain_walk,
    ]
    (tmp_path / "functions").write_bytes(cloudpickle.dumps(functions))
    script = "import pickle; print(len([list(f(iter([]))) for f in pickle.load(open('functions', 'rb'))[:3]]))"
    done = subprocess.run([sys.executable, "-c", script], cwd=tmp_path, capture_output=True, text=True, timeout=120)
    assert done.stdout.strip() == "3", done.stderr


def plan_of(frame):
    return frame._jdf.queryExecution().optimizedPlan().toString()


@pytest.mark.parametrize("parse", [parse_imu_records, parse_imu_framed])
def test_fields_are_cut_out_once(spark, tmp_path, parse):
    """The tasks that find the tokens write the fields; no later step looks at a reading's text again."""
    (tmp_path / "imu_log.txt").write_text("\n".join(record(1) + record(2)) + "\n")
    assert "regexp" not in plan_of(parse(read_imu_logs(spark, str(tmp_path))))


def test_numeric_columns_are_read_by_column(spark, tmp_path):
    (tmp_path / "imu_log.txt").write_text("\n".join(record(1)) + "\n")
    found = imu_numeric_columns(parse_imu_records(read_imu_logs(spark, str(tmp_path))))
    assert "parquet" in plan_of(found) and "ExistingRDD" not in plan_of(found)
