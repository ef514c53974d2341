"""Multi-sensor logs: records of one time stamp and five sensor readings that may span lines.

A record is the first time stamp after the record before it, then the first gyroscope reading after
that, then the first accelerometer reading after that, and so on: a reading that is missing or
malformed is taken from further down, whoever it belongs to. Read as one text that is a lazy match
over the whole file. Here it is a six-state machine over the tokens of the lines, and since a step
of a machine is a function from state to state, the splits of a file can be run side by side, each
once and in the task that scans it:

1. a task follows the machine from every state its stretch of a file may be entered in. Two runs
   that take the same time stamp are one from there on, which is soon. It writes the records down,
   each with its number under every entry state, and per stretch one row: the state it leaves and the
   number of records it opens, for each entry state;
2. per file these rows are composed in order, which gives the state each stretch is really entered in;
3. records that begin under that state stay. The few that cross a border are put together.

So a file is never gathered into one value or one task, tokens are never shuffled, and the result is
that of the whole text. (A file that cannot be split, say a gzip, is one stretch.)

``parse_imu_framed`` reads broken files otherwise: the file is cut at the last time stamp before each
gyroscope, a record must lie within its frame, and every reading that is in no record is a row of
``imu_rejects``.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tugboard.config import DEFAULTS, PanelSettings
from tugboard.plans.tables import written
from tugboard.sources.lines import read_lines, require_rows

# File name, token formats in record order, and the columns they fill.
IMU_GLOB = "imu_log*.txt"
_NUMBER = r"([-\d.]+)"
_HEAD = r" = SensorInfo \{ Timestamp = (\d+), Accuracy = (\d+), Data = "
_VECTOR = rf"<{_NUMBER}, {_NUMBER}, {_NUMBER}> \}}"
_QUATERNION = rf"\{{X:{_NUMBER} Y:{_NUMBER} Z:{_NUMBER} W:{_NUMBER}\}} \}}"
TIME_TOKEN = r"\d{2}:\d{2}:\d{2}\.\d+"
NAMES = {
    "gyro": "Gyroscope",
    "acc": "Accelerometer",
    "mag": "MagneticField",
    "grav": "Gravity",
    "rot": "Rotation",
}
SENSORS = {
    short: f"{name}{_HEAD}{_QUATERNION if short == 'rot' else _VECTOR}" for short, name in NAMES.items()
}


def _columns_of(sensor: str) -> list[tuple[str, str]]:
    axes = ("x", "y", "z", "w") if sensor == "rot" else ("x", "y", "z")
    return [(f"{sensor}_ts", "long"), (f"{sensor}_acc", "int")] + [(f"{sensor}_{a}", "double") for a in axes]


IMU_NUMERIC = [pair for sensor in SENSORS for pair in _columns_of(sensor)]
IMU_COLUMNS = ["time"] + [name for name, _ in IMU_NUMERIC]
STATES = 1 + len(SENSORS)


def read_imu_logs(
    spark: SparkSession, folder: str, glob: str = IMU_GLOB, session: Column | None = None, **options: str
) -> DataFrame:
    return read_lines(spark, folder, glob, session, **options)


STRETCH = ["session_id", "file", "block_start", "first_mid"]
MARKER = NAMES["gyro"]
BROKEN = STATES   # the kind of a gyroscope's name without a well-formed reading

_STRETCH = "session_id string, file string, block_start long, first_mid long"
_TEXTS = ", ".join(f"{name} string" for name in IMU_COLUMNS)
_ALPHABET = np.isin(np.arange(256), list(b"-.0123456789"))   # of _NUMBER


def _token_lines(lines: DataFrame, markers: bool = False) -> DataFrame:
    """Every line with its time stamps and well-formed readings. No token spans a line break."""
    either = "|".join([TIME_TOKEN, *SENSORS.values(), *([MARKER] if markers else [])]).replace("(", "(?:")
    begins = "".join(name[0] for name in NAMES.values())   # most places of a line are left at one look
    return lines.select(
        "session_id", "file", "block_start", "mid", F.xxhash64("session_id", "file", "block_start").alias("place"),
        F.regexp_extract_all("line", F.lit(rf"(?=[\d{begins}])(?:{either})"), F.lit(0)).alias("tokens"),
    )


def _kinds(tokens: pa.Array) -> np.ndarray:
    """0 for a time stamp, 1 to 5 for readings in record order, BROKEN for a bare name."""
    _, offsets, data = tokens.buffers()
    n = len(tokens)
    if not n:
        return np.zeros(0, np.int64)
    at = np.frombuffer(offsets, np.int32)[tokens.offset: tokens.offset + n + 1]
    text = np.frombuffer(data, np.uint8)
    first, second = text[at[:-1]], text[at[:-1] + 1]
    kinds = np.zeros(n, np.int64)
    for kind, name in enumerate(NAMES.values(), start=1):
        kinds[(first == ord(name[0])) & (second == ord(name[1]))] = kind
    kinds[(kinds == 1) & (np.diff(at) == len(MARKER))] = BROKEN
    return kinds


def _numbers(tokens: pa.Array) -> tuple[pa.Array, np.ndarray]:
    """All numbers of the tokens, and for every token, and the end, the place of its first number.

    A reading holds its numbers in column order and nothing else of their alphabet, and no reading ends in one.
    """
    n = len(tokens)
    if not n:
        return pa.array([], pa.string()), np.zeros(1, np.int64)
    _, offsets, data = tokens.buffers()
    at = np.frombuffer(offsets, np.int32)[tokens.offset: tokens.offset + n + 1]
    text = np.frombuffer(data, np.uint8)[at[0]: at[-1]]
    inside = _ALPHABET[text]
    starts, ends = np.flatnonzero(np.diff(inside, prepend=False, append=False)).reshape(-1, 2).T
    borders = np.concatenate([[0], np.cumsum(ends - starts)]).astype(np.int32)
    numbers = pa.StringArray.from_buffers(len(starts), pa.py_buffer(borders), pa.py_buffer(text[inside]))
    return numbers, np.searchsorted(starts, at - at[0])


def _stretches(batch: pa.RecordBatch, last: tuple | None) -> Iterator[tuple[tuple | None, int, int]]:
    """(key, first token, end) of each run of consecutive lines; the key is None where the run of ``last`` goes on.

    ``last`` is the place and number of the line before the batch. Lines count as consecutive only if
    nothing can lie between them, so a table in any order gives right results, if many stretches.
    """
    mid, place = batch["mid"].to_numpy(), batch["place"].to_numpy()
    breaks = np.flatnonzero((np.diff(mid) != 1) | (np.diff(place) != 0)) + 1
    begins = [0, *breaks.tolist()]
    ends = [*begins[1:], batch.num_rows]
    tokens = np.frombuffer(batch["tokens"].buffers()[1], np.int32)[batch["tokens"].offset:]
    base = int(tokens[0])
    for begin, end in zip(begins, ends):
        goes_on = begin == 0 and last is not None and (int(place[0]), int(mid[0]) - 1) == last
        key = None if goes_on else tuple(batch[c][begin].as_py() for c in ("session_id", "file", "block_start", "mid"))
        yield key, int(tokens[begin]) - base, int(tokens[end]) - base


def _next_of(kinds: np.ndarray, kind: int) -> np.ndarray:
    """For every place, and the two behind the end, the first place from there on with a token of ``kind``."""
    n = len(kinds)
    at = np.where(kinds == kind, np.arange(n), n)
    return np.concatenate([np.minimum.accumulate(at[::-1])[::-1], [n, n]])


class _Chain:
    """One run of the machine, shared by all entry states that have come to take the same time stamp."""

    def __init__(self, entry: int):
        self.state = entry
        self.opened = 0
        self.members = [(entry, 0, -1)]   # entry state, what its numbers are ahead by, records opened when it joined
        self.merged: tuple[_Chain, int, int] | None = None

    def join(self, entry: int, ahead: int, opened: int) -> None:
        self.members.append((entry, ahead, opened))
        if self.merged:
            other, mine, theirs = self.merged
            other.join(entry, ahead + mine - theirs, theirs)

    def numbers(self, opened: np.ndarray) -> np.ndarray:
        """Per record, by how many were opened with it, its number under each entry state, or -1."""
        found = np.full((len(opened), STATES), -1)
        for entry, ahead, joined in self.members:
            found[:, entry] = np.where(opened > joined, opened + ahead, found[:, entry])
        return found


class _Machine:
    """The machine run from all states over one stretch, fed piece by piece."""

    def __init__(self, key: tuple):
        self.key = key
        self.chains = [_Chain(entry) for entry in range(STATES)]

    def feed(self, kinds: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """(places of the tokens taken, -1 for none; numbers under each entry state), a row per record or part of one."""
        n = len(kinds)
        following = [_next_of(kinds, kind) for kind in range(STATES)]
        whole = [following[0]]
        for kind in range(1, STATES):
            whole.append(following[kind][whole[-1] + 1])
        times, ends = whole[0].tolist(), whole[-1].tolist()
        begun: dict[int, tuple[_Chain, int]] = {}
        rows = [self._follow(chain, n, following, times, ends, begun) for chain in self.chains]
        for chain, (parts, starts, first) in zip(self.chains, rows):
            if starts:
                places = np.stack([places[starts] for places in whole], axis=1)
                yield np.where(places < n, places, -1), chain.numbers(np.arange(first + 1, first + 1 + len(starts)))
            for places, opened in parts:
                yield np.array([places]), chain.numbers(np.array([opened]))
        self.chains = [chain for chain in self.chains if not chain.merged]
        for chain in self.chains:
            chain.members = [(entry, ahead, -1) for entry, ahead, _ in chain.members]

    @staticmethod
    def _follow(chain, n, following, times, ends, begun):
        at, parts, starts = 0, [], []
        if chain.state:
            places = [-1] * STATES
            while chain.state < STATES and following[chain.state][at] < n:
                places[chain.state] = int(following[chain.state][at])
                at, chain.state = places[chain.state] + 1, chain.state + 1
            if max(places) >= 0:
                parts.append((places, chain.opened))
            if chain.state < STATES:
                return parts, starts, chain.opened
            chain.state = 0
        first = chain.opened
        while times[at] < n:
            if times[at] in begun:
                other, theirs = begun[times[at]]
                mine = chain.opened
                chain.merged = (other, mine, theirs)
                for entry, ahead, _ in chain.members:
                    other.join(entry, ahead + mine - theirs, theirs)
                break
            begun[times[at]] = (chain, chain.opened)
            starts.append(at)
            chain.opened += 1
            if ends[at] >= n:   # the record goes on behind the end
                place = times[at] + 1
                chain.state = 1
                while following[chain.state][place] < n:
                    place, chain.state = int(following[chain.state][place]) + 1, chain.state + 1
                break
            at = ends[at] + 1
        return parts, starts, first

    def summary(self) -> tuple[list[int], list[int]]:
        """Per entry state: the state the stretch is left in and the records opened."""
        leaves, opens = [0] * STATES, [0] * STATES
        for chain in self.chains:
            for entry, ahead, _ in chain.members:
                leaves[entry], opens[entry] = chain.state, chain.opened + ahead
        return leaves, opens


def _taken(values: pa.Array, places: np.ndarray) -> pa.Array:
    return values.take(pa.array(places, pa.int64(), mask=places < 0))


def _texts(tokens: pa.Array, numbers: pa.Array, first: np.ndarray, places: np.ndarray) -> list[pa.Array]:
    """The 27 fields of records, or parts of them, whose tokens are at ``places``, a row per record and -1 for none."""
    texts = [_taken(tokens, places[:, 0])]
    for kind, sensor in enumerate(SENSORS, start=1):
        none, at = places[:, kind] < 0, first[places[:, kind]]
        texts += [_taken(numbers, np.where(none, -1, at + place)) for place in range(len(_columns_of(sensor)))]
    return texts


def _keyed(keys: list[tuple], counts: list[int]) -> list[pa.Array]:
    """The columns of STRETCH, each key as often as counted."""
    repeats = pa.array(np.repeat(np.arange(len(keys)), counts))
    kinds = (pa.string(), pa.string(), pa.int64(), pa.int64())
    return [pa.array(column, kind).take(repeats) for column, kind in zip(zip(*keys), kinds)]


def _parts(names: tuple[str, ...], which: np.ndarray) -> pa.Array:
    return pa.array(names).take(pa.array(which.astype(np.int64)))


_PIECE = [*STRETCH, "part", "leaves", "opens", "numbers", *IMU_COLUMNS]
_PIECES = f"{_STRETCH}, part string, leaves array<int>, opens array<long>, numbers array<long>, {_TEXTS}"


def _summaries(machines: list[_Machine]) -> pa.RecordBatch:
    n = len(machines)
    leaves, opens = zip(*[machine.summary() for machine in machines])
    return pa.RecordBatch.from_arrays([
        *_keyed([machine.key for machine in machines], [1] * n), pa.array(["summary"] * n), pa.array(leaves, pa.list_(pa.int32())),
        pa.array(opens, pa.list_(pa.int64())), pa.nulls(n, pa.list_(pa.int64())), *[pa.nulls(n, pa.string())] * len(IMU_COLUMNS),
    ], _PIECE)


def _machines(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Records and parts of records with their numbers under each entry state, and one summary per stretch."""
    machine, last = None, None
    for batch in batches:
        if not batch.num_rows:
            continue
        tokens = batch["tokens"].flatten()
        kinds, found, ended = _kinds(tokens), [], []
        for key, begin, end in _stretches(batch, last):
            if key is not None:
                ended += [machine] if machine is not None else []
                machine = _Machine(key)
            for places, opened in machine.feed(kinds[begin:end]):
                found.append((machine.key, np.where(places >= 0, places + begin, -1), opened))
        if ended:
            yield _summaries(ended)
        if found:
            keys, places, opened = zip(*found)
            keyed, places, opened = _keyed(keys, [len(rows) for rows in places]), np.concatenate(places), np.concatenate(opened)
            n = len(places)
            lists = pa.ListArray.from_arrays(pa.array(np.arange(0, STATES * n + 1, STATES), pa.int32()), pa.array(opened.reshape(-1), pa.int64()))
            yield pa.RecordBatch.from_arrays([
                *keyed, _parts(("crossing", "whole"), (places >= 0).all(axis=1)), pa.nulls(n, pa.list_(pa.int32())), pa.nulls(n, pa.list_(pa.int64())),
                lists, *_texts(tokens, *_numbers(tokens), places),
            ], _PIECE)
        last = (batch["place"][-1].as_py(), batch["mid"][-1].as_py())
    if machine is not None:
        yield _summaries([machine])


def _entry_states(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Per stretch, in file order: the state it is entered in and the records opened before it."""
    current, state, opened = None, 0, 0
    for batch in batches:
        entered, before = [], []
        for session, file, leaves, opens in zip(*(batch[c].to_pylist() for c in ("session_id", "file", "leaves", "opens"))):
            if (session, file) != current:
                current, state, opened = (session, file), 0, 0
            entered.append(state)
            before.append(opened)
            state, opened = leaves[state], opened + opens[state]
        yield pa.RecordBatch.from_arrays(
            [*[batch[c] for c in STRETCH], pa.array(entered, pa.int32()), pa.array(before, pa.int64())], [*STRETCH, "state", "opened"]
        )


def _by_stretch(rows: DataFrame, facts: DataFrame, settings: PanelSettings) -> DataFrame:
    """``facts``, one row per stretch, joined to ``rows``; broadcast only if there are few stretches."""
    facts = written(facts)
    named = facts.select(*[F.col(c).alias(f"_of_{c}") for c in STRETCH], *[c for c in facts.columns if c not in STRETCH])
    same = F.lit(True)
    for c in STRETCH:
        same = same & F.col(c).eqNullSafe(F.col(f"_of_{c}"))
    small = facts.count() <= settings.broadcast_rows
    return rows.join(F.broadcast(named) if small else named, same).drop(*[f"_of_{c}" for c in STRETCH])


def parse_imu_records(lines: DataFrame, require_nonempty: bool = False, settings: PanelSettings = DEFAULTS) -> DataFrame:
    """``session_id, file, record_no`` and the 27 fields of each complete record, as text."""
    pieces = written(_token_lines(lines).mapInArrow(_machines, _PIECES), "part")
    summaries = pieces.where("part = 'summary'").select(*STRETCH, "leaves", "opens")
    in_order = summaries.repartition("session_id", "file").sortWithinPartitions(*STRETCH)
    entries = in_order.mapInArrow(_entry_states, f"{_STRETCH}, state int, opened long")
    known = _by_stretch(pieces.where("part <> 'summary'"), entries, settings)
    number = F.get("numbers", F.col("state"))
    record = ["session_id", "file", (number + F.col("opened")).alias("record_no"), *IMU_COLUMNS]
    real = known.where(number >= 0)
    crossing = (
        real.where("part = 'crossing'").select(*record)
        .groupBy("session_id", "file", "record_no").agg(*[F.max(name).alias(name) for name in IMU_COLUMNS])
        .where(F.col(IMU_COLUMNS[-1]).isNotNull())
    )
    records = real.where("part = 'whole'").select(*record).unionByName(crossing)
    return require_rows(records, "sensor records") if require_nonempty else records


_FRAME = [*STRETCH, "local", "part", "seq", "kind", "reading", *IMU_COLUMNS]
_FRAME_TYPES = [pa.string(), pa.string(), pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.int32(), *[pa.string()] * (1 + len(IMU_COLUMNS))]
_FRAMES = f"{_STRETCH}, local long, part string, seq long, kind int, reading string, {_TEXTS}"


class _Framer:
    """Frames of one stretch. Tokens since the last cut are held, so memory is that of a frame and a batch.

    Rows are ``(part, numbers of frames, places of tokens, running numbers of border tokens)``.
    """

    def __init__(self, key: tuple):
        self.key = key
        self.held, self.frames, self.sent = None, 0, 0   # held: from where to where in the tokens at hand

    def _border(self, begin: int, end: int) -> tuple:
        """Tokens for ``_border_frames``; a time stamp's ``local`` is the number of the frame it begins, if it does."""
        n = end - begin
        self.sent += n
        local = np.full(n, self.frames + 1)
        local[0] -= self.frames > 0   # what is held begins with the last frame's time stamp
        return "border", local, np.arange(begin, end), np.arange(self.sent - n, self.sent)

    def feed(self, kinds: np.ndarray, begin: int, end: int) -> Iterator[tuple]:
        """``kinds`` are those of all tokens at hand; what is held lies right before ``begin``."""
        if self.held is not None:
            begin = self.held[0]
        kinds = kinds[begin:end]
        n = len(kinds)
        times = np.flatnonzero(kinds == 0)
        names = np.concatenate([[0], np.cumsum((kinds == 1) | (kinds == BROKEN))])
        upto = np.append(times[1:], n)
        starts = times[names[upto] > names[times]]
        # What follows the last time stamp may still turn out to be a frame: it is held.
        loose = int(starts[0]) if len(starts) else int(times[-1]) if len(times) else n
        if self.frames == 0 and loose:
            yield self._border(begin, begin + loose)
        if not len(starts):
            keep = 0 if self.frames else loose
        else:
            keep = int(starts[-1])
            numbers = np.arange(self.frames + 1, self.frames + len(starts)) - (self.frames > 0)
            if len(starts) > 1:
                yield from self._inner(kinds, begin, starts, numbers)
            self.frames = int(self.frames + len(starts) - (self.frames > 0))
        self.held = (begin + keep, end) if keep < n else None

    def _inner(self, kinds: np.ndarray, offset: int, starts: np.ndarray, numbers: np.ndarray) -> Iterator[tuple]:
        """Frames that begin and end here: a row each, and one for every reading that is in no record."""
        begins, ends = starts[:-1], starts[1:]
        places = [begins]
        for kind in range(1, STATES):
            places.append(_next_of(kinds, kind)[places[-1] + 1])
        complete = places[-1] < ends
        taken = np.zeros(len(kinds) + 1, bool)
        for column in places:
            taken[column[complete]] = True
        yield "frame", numbers, np.where(complete[:, None], np.stack(places, axis=1) + offset, -1), None
        left = np.flatnonzero(~taken[begins[0]: ends[-1]] & (kinds[begins[0]: ends[-1]] > 0)) + begins[0]
        if len(left):
            yield "reject", numbers[np.searchsorted(begins, left, side="right") - 1], left + offset, None

    def end(self) -> Iterator[tuple]:
        if self.held is not None:
            yield self._border(*self.held)


def _frame_rows(found: list[tuple], tokens: pa.Array, kinds: np.ndarray) -> Iterator[pa.RecordBatch]:
    """The rows that framers gave, each after its key, as one batch for each part."""
    for part in dict.fromkeys(row[1] for row in found):
        keys, _, local, places, seq = zip(*[row for row in found if row[1] == part])
        n = sum(map(len, local))
        columns = dict(zip(_FRAME, [*_keyed(keys, [len(rows) for rows in local]), pa.array(np.concatenate(local), pa.int64()), pa.array([part] * n)]))
        places = np.concatenate(places)
        if part == "frame":
            columns |= dict(zip(IMU_COLUMNS, _texts(tokens, *_numbers(tokens), places)))
        else:
            columns |= {"kind": pa.array(kinds[places], pa.int32()), "reading": tokens.take(pa.array(places))}
        if part == "border":
            columns["seq"] = pa.array(np.concatenate(seq), pa.int64())
        yield pa.RecordBatch.from_arrays([columns[c] if c in columns else pa.nulls(n, kind) for c, kind in zip(_FRAME, _FRAME_TYPES)], _FRAME)


def _framed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Frames, readings outside records, and the tokens at both ends of each stretch, in order."""
    framer, last, tokens, kinds = None, None, pa.array([], pa.string()), np.zeros(0, np.int64)
    for batch in batches:
        if not batch.num_rows:
            continue
        # The tokens at hand: what is held, then the batch's.
        held = 0
        if framer is not None and framer.held is not None:
            begin, end = framer.held
            held = end - begin
            tokens, kinds, framer.held = tokens.slice(begin, held), kinds[begin:end], (0, held)
        tokens, more = (batch["tokens"].flatten(), None) if not held else (pa.concat_arrays([tokens, batch["tokens"].flatten()]), kinds)
        kinds = _kinds(tokens.slice(held))
        kinds = kinds if more is None else np.concatenate([more, kinds])
        found = []
        for key, begin, end in _stretches(batch, last):
            if key is not None:
                found += [(framer.key, *row) for row in framer.end()] if framer is not None else []
                framer = _Framer(key)
            found += [(framer.key, *row) for row in framer.feed(kinds, begin + held, end + held)]
        yield from _frame_rows(found, tokens, kinds)
        last = (batch["place"][-1].as_py(), batch["mid"][-1].as_py())
    if framer is not None:
        yield from _frame_rows([(framer.key, *row) for row in framer.end()], tokens, kinds)


def _border_frames(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Frames over the ends of stretches, from their tokens in file order."""
    rows: list[list] = []

    def emit(frame: list[tuple]) -> None:
        """``frame``: (stretch, number, kind, token); its first token is its time, or it is none."""
        if not frame:
            return
        stretch, number, kind, _ = frame[0]
        if kind != 0 or number == 0:
            stretch, number, slots = (*stretch[:2], None, None), 0, None
        else:
            slots = [frame[0][3]]
        used = set()
        for at, (_, _, kind, token) in enumerate(frame):
            if slots and kind == len(slots) < STATES:
                slots.append(token)
                used.add(at)
        if slots and len(slots) < STATES:
            used = set()
        if slots:
            texts = [slots[0], *re.findall(_NUMBER, " ".join(slots[1:]), re.ASCII)] if len(slots) == STATES else [None] * len(IMU_COLUMNS)
            rows.append([*stretch, number, "frame", None, None, None, *texts])
        for at, (_, _, kind, token) in enumerate(frame):
            if kind and at not in used:
                rows.append([*stretch, number, "reject", None, kind, token, *[None] * len(IMU_COLUMNS)])

    def batch_of() -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(column, kind) for column, kind in zip(zip(*rows), _FRAME_TYPES)], _FRAME)

    current, frame, piece = None, [], []   # the frame so far, and its tokens since the last time stamp

    def close_piece() -> None:
        nonlocal frame, piece
        starts = piece and piece[0][2] == 0 and any(kind in (1, BROKEN) for _, _, kind, _ in piece)
        if starts:
            emit(frame)
            frame = piece
        elif piece and not frame:
            frame = [(piece[0][0], 0, piece[0][2], piece[0][3]), *piece[1:]]
        else:
            frame += piece
        piece = []

    for batch in batches:
        columns = [batch[c].to_pylist() for c in (*STRETCH, "local", "kind", "reading")]
        for session, file, block, mid, local, kind, token in zip(*columns):
            stretch = (session, file, block, mid)
            if (session, file) != current:
                close_piece()
                emit(frame)
                current, frame = (session, file), []
            if kind == 0:
                close_piece()
            piece.append((stretch, local, kind, token))
        if rows:
            yield batch_of()
            rows.clear()
    close_piece()
    emit(frame)
    if rows:
        yield batch_of()


def _imu_frames(lines: DataFrame, settings: PanelSettings) -> DataFrame:
    """Frames and rejected readings with ``frame_no``, numbered through each file; 0 is what lies before the first."""
    pieces = written(_token_lines(lines, markers=True).mapInArrow(_framed, _FRAMES), "part")
    borders = pieces.where("part = 'border'").repartition("session_id", "file").sortWithinPartitions(*STRETCH, "seq")
    over = written(borders.mapInArrow(_border_frames, _FRAMES), "part")
    found = pieces.where("part <> 'border'").unionByName(over)
    counts = found.where("part = 'frame'").groupBy(*STRETCH).agg(F.count(F.lit(1)).alias("n"))
    along = Window.partitionBy("session_id", "file").orderBy("block_start", "first_mid").rowsBetween(Window.unboundedPreceding, -1)
    before = counts.select(*STRETCH, F.coalesce(F.sum("n").over(along), F.lit(0)).alias("before"))
    numbered = _by_stretch(found.where(F.col("first_mid").isNotNull()), before, settings)
    outside = found.where(F.col("first_mid").isNull()).withColumn("before", F.lit(0).cast("long"))
    return numbered.unionByName(outside).withColumn("frame_no", F.col("before") + F.col("local"))


def parse_imu_framed(lines: DataFrame, require_nonempty: bool = False, settings: PanelSettings = DEFAULTS) -> DataFrame:
    """``session_id, file, frame_no`` and the 27 fields of each frame that holds a whole record, as text.

    A frame runs from the last time stamp before a gyroscope, well-formed or not, to that of the next such
    time stamp. In it the first reading of each kind counts after the one before, as in ``parse_imu_records``.
    """
    frames = _imu_frames(lines, settings).where((F.col("part") == "frame") & F.col(IMU_COLUMNS[-1]).isNotNull())
    records = frames.select("session_id", "file", "frame_no", *IMU_COLUMNS)
    return require_rows(records, "sensor records") if require_nonempty else records


def imu_rejects(lines: DataFrame, settings: PanelSettings = DEFAULTS) -> DataFrame:
    """``session_id, file, frame_no, sensor, reading``: what is in no record of ``parse_imu_framed``.

    Each reading of a frame without a whole record, spare readings of frames with one, readings before the first
    frame (number 0), and the bare name of each gyroscope whose reading is malformed.
    """
    sensor = F.element_at(F.array(*[F.lit(short) for short in [*SENSORS, "gyro"]]), F.col("kind"))
    rejects = _imu_frames(lines, settings).where("part = 'reject'")
    return rejects.select("session_id", "file", "frame_no", sensor.alias("sensor"), "reading")


def imu_numeric_cast(records: DataFrame) -> DataFrame:
    """The fixed types of the 26 numeric columns; a cell that is no number becomes NULL."""
    return records.withColumns({
        name: F.expr(f"try_cast({name} as {kind})") for name, kind in IMU_NUMERIC
    })


def imu_bad_cells(records: DataFrame) -> DataFrame:
    """One row: per numeric column, the number of cells that do not read as its type."""
    return records.agg(*[
        F.count_if(F.expr(f"try_cast({name} as {kind})").isNull()).alias(name) for name, kind in IMU_NUMERIC
    ])


def imu_numeric_columns(records: DataFrame) -> DataFrame:
    """All or nothing: a column with one bad cell stays text, so that no cell is lost.

    The records are looked at twice, so they are written to the checkpoint folder first, column by column.
    """
    records = written(records)
    bad = imu_bad_cells(records).first().asDict()
    return records.withColumns({
        name: F.col(name).cast(kind) for name, kind in IMU_NUMERIC if bad[name] == 0
    })
