"""Sessions over a stream: starts and answers in, turns, rejects and wrap-up records out.

Every session has one small row of state, and what a micro-batch brings for it is walked at once, as
arrays: an answer's level and place follow from its number, the Medium gate from a running sum.
Sessions share the groups of the stateful step: a group costs a pass from Spark to Python and back, so there
are ``Rules.buckets`` of them however many sessions there are, and a bucket is a map of its sessions' rows.
A row of the stateful step costs Python far more than a number in it, so a bucket's events are packed: one row
with arrays for what a task holds of the bucket at a time.

* A session can use as many answers as its phases are long. Rows of a session far behind them in what
  their task holds at a time are certainly refused, so they are grouped apart from the session, block by block
  and bucket by bucket: a session with a large share of the stream does not fill one task.
* Rows without a session, a number or a score are refused as well, with the reason, and end nothing.
* Session keys may be of any type.

Needs the RocksDB state store, see ``run_available``.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator, Sequence
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

from ..functions import labels
from ..functions.fixed_values import LEVELS, MAX_MARKS, PHASE_LIMITS
from ..operators.scoring import ModelFactory, score_answers
from ..operators.sessions import Phases, is_blank, is_quit, medium_full, medium_pass
from ..sources.durable import new_path

_STATE = (
    "started boolean, easy int, medium int, hard int, answered int, medium_sum int, total bigint, last_score int, "
    "ended boolean, domain string, timer bigint"
)
_STATE_FIELDS = [x.split()[0] for x in _STATE.split(", ")]
_NEW = dict(zip(_STATE_FIELDS, (False, 0, 0, 0, 0, 0, 0, None, False, None, 0)))
_LIMITS = ("easy", "medium", "hard")
#: Columns of a turn; ``{key}`` is the type of the session.
_TURN = (
    "session {key}, seq bigint, pos int, level string, q_num int, score int, total bigint, possible bigint, "
    "medium_score int, next_level string, next_q_num int, done boolean, reason string"
)
_ITEM = "pos int, question string, answer string, score int, feedback string, level string"
_MORE = "kind string, domain string, ended boolean, last_score int"
_HISTORY = "history array<struct<" + ",".join(x.replace(" ", ":") for x in _ITEM.split(", ")) + ">>"
_ITEMS = _HISTORY.removeprefix("history ")
_ITEM_FIELDS = [x.split()[0] for x in _ITEM.split(", ")]

NOT_FOUND, COMPLETE, STARTED_BEFORE, SURPLUS = "session not found", "session complete", "session started before", "surplus"
#: Lanes for rows that no state can use.
_LANES = 1024


def turn_schema(key: str = "bigint") -> str:
    """Columns of the rows that ``session_stream`` writes, for sessions of type ``key``."""
    return _TURN.format(key=key)


TURN_SCHEMA = turn_schema()


@dataclass(frozen=True)
class Rules:
    """How sessions run.

    ``needs_start``: answers count only after a start; before it they wait ``patience_ms``, or are refused
    at once. ``history``: used answers are kept and a wrap-up record comes when the session ends. ``quit_ends``:
    the word quit ends it. ``idle_ms``: a session silent for so long ends with what it answered, and its
    state is dropped. ``extra``: text columns of the answers that turns carry along. ``buckets``: sessions share this many
    groups of the stateful step, and keep to them as long as a checkpoint lives.
    """

    phases: Phases = field(default_factory=lambda: dict(PHASE_LIMITS))
    needs_start: bool = False
    patience_ms: int | None = None
    history: bool = False
    quit_ends: bool = False
    idle_ms: int | None = None
    extra: tuple[str, ...] = ()
    buckets: int = 4096

    @property
    def most(self) -> int:
        return sum(self.phases.values())

    @property
    def timed(self) -> bool:
        return bool(self.patience_ms or self.idle_ms)

    @property
    def texts(self) -> list[str]:
        """Text columns that answers bring along."""
        items = ["question", "answer", "feedback"] if self.history else []
        return list(dict.fromkeys([*items, *self.extra]))


def walk(easy: int, medium: int, hard: int, answered: int, medium_sum: int, scores: np.ndarray, least: int) -> dict[str, np.ndarray]:
    """The turns of the next answers with ``scores``, as far as the session goes, after ``answered`` of them.

    ``least`` marks pass Medium. Gives one array per column of a turn, and ``medium`` with the running sum.
    """
    gate = easy + medium
    pos = answered + 1 + np.arange(len(scores))
    sums = medium_sum + np.cumsum(np.where((pos > easy) & (pos <= gate), scores, 0))
    # Marks of the whole Medium phase, once it has been asked.
    whole = medium_sum if answered >= gate else sums[gate - answered - 1] if len(scores) >= gate - answered else -1
    passed = whole >= least
    end = gate + hard if passed else gate
    used = int(np.searchsorted(pos, end, "right"))
    pos, sums = pos[:used], sums[:used]
    level = (pos > easy).astype(int) + (pos > gate)
    begin = np.array([0, easy, gate])[level]
    done = (pos == gate + hard) & passed if passed else pos == gate
    following = np.where((pos == gate) & passed, 2, np.where(pos == easy, np.maximum(level, 1), level))
    return {
        "pos": pos, "level": level, "q_num": pos - begin, "medium": sums, "next": following,
        "next_q_num": np.where(following != level, 1, pos - begin + 1), "done": done,
    }


class SessionMachine(StatefulProcessor):
    """Walks a session's answers in ``seq`` order inside a micro-batch, in arrival order across them.

    Sessions are handed over a bucket at a time: frames are sorted and cut for all of them at once, and each has
    its own small row in the bucket's map, read and written only if the micro-batch brings something for it.
    Of a micro-batch only as many answers as a session can use are held; the others are refused while they
    stream by, so a session with very many rows needs no more memory than any other.
    """

    def __init__(self, rules: Rules, least: int, key: str = "bigint") -> None:
        # The processor is also loaded where the package may not be at hand: it calls nothing outside this module.
        self.rules = rules
        self.least = least  # marks that pass Medium
        self.key = key  # type of the session

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        name = f"session {self.key}"
        self.session = handle.getMapState("session", name, _STATE)
        if self.rules.history:
            self.items = handle.getMapState("history", name, f"items {_ITEMS}")
        if self.rules.patience_ms:
            texts = "".join(f",{c}:string" for c in self.rules.texts)
            self.waiting = handle.getMapState("waiting", name, f"items array<struct<seq:bigint,score:int,quit:boolean{texts}>>")
        if self.rules.timed:
            # The sessions that a timer of the bucket is for; it counts for those whose own clock still says so.
            self.due = handle.getMapState("due", "at bigint", f"sessions array<{self.key}>")

    def close(self) -> None:
        pass

    def handleInitialState(self, key, initialState, timerValues) -> None:
        given = [c for c in _STATE_FIELDS if c in initialState]
        columns = {c: initialState[c].tolist() for c in given}
        for i, session in enumerate(initialState["session"].tolist()):
            state = {**_NEW, **{c: columns[c][i] for c in given}}
            self.session.updateValue((session,), tuple(_plain(state[c]) for c in _STATE_FIELDS))

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        out = _Rows(self.rules, self.key)
        if key[1] != 0:
            for events in map(_unpacked, rows):
                out.refuse(events, SURPLUS if self.rules.needs_start else COMPLETE)
                yield from out.frames(1 << 12)
            yield from out.frames()
            return
        states = _States(self.session)
        clocks: dict[int, list] = {}
        answers = None
        for events in map(_unpacked, rows):
            begins = events["kind"] == 0
            if begins.any():
                self._start(states, _taken(events, begins), out)
                events = _taken(events, ~begins)
            if not self.rules.needs_start:
                self._open(states, events)
            if answers is not None:
                events = {c: np.concatenate([answers[c], x]) for c, x in events.items()}
            answers = self._cut(events, states, out)
            yield from out.frames(1 << 12)
        now = timerValues.getCurrentProcessingTimeInMs() if self.rules.timed else 0
        parts = self._split(answers)
        for session in list(states) if self.rules.timed else parts:
            state = states[session]
            part = parts.get(session) or {c: [] for c in self._columns}
            if self.rules.patience_ms:
                part = self._wait(session, state, part, now, clocks, out)
            if part["seq"]:
                if state["started"]:
                    self._take(session, state, part, out)
                else:
                    out.refuse_items(session, zip(part["seq"], part["score"]), NOT_FOUND)
            if self.rules.idle_ms and state["started"] and not state["ended"]:
                self._clock(session, state, now + self.rules.idle_ms, clocks)
        states.save()
        self._set(clocks)
        yield from out.frames()

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        at = expiredTimerInfo.getExpiryTimeInMs()
        due = self.due.getValue((at,))
        if due is None:
            return
        self.due.removeKey((at,))
        out = _Rows(self.rules, self.key)
        for session in due[0]:
            found = self.session.getValue((session,))
            state = dict(zip(_STATE_FIELDS, found)) if found else dict(_NEW)
            if state["timer"] != at:
                continue  # something came since, and set another clock
            if not state["started"]:
                out.refuse_items(session, ((x[0], x[1]) for x in self._held(session)), NOT_FOUND)
                self.waiting.removeKey((session,))
            elif not state["ended"]:
                self._end(session, state, out, "expired", self._history(session) if self.rules.history else [])
            self.session.removeKey((session,))
        yield from out.frames()

    @property
    def _columns(self) -> list[str]:
        return ["seq", "score", "quit", *self.rules.texts]

    def _start(self, states: _States, begins: dict[str, np.ndarray], out: _Rows) -> None:
        for session, domain, *limits in zip(*(_cells(begins[c]) for c in ("session", "domain", *_LIMITS))):
            state = states[session]
            if state["started"]:
                out.add(session=session, kind="reject", reason=STARTED_BEFORE, domain=domain)
                continue
            state.update(zip(_LIMITS, limits), started=True, domain=domain)
            state["ended"] = state["easy"] + state["medium"] == 0
            out.add(
                session=session, kind="start", level=LEVELS[0], next_level=LEVELS[0], next_q_num=1, done=state["ended"],
                domain=domain,
            )

    def _open(self, states: _States, events: dict[str, np.ndarray]) -> None:
        """Sessions begin with their first answer, which tells the phases."""
        codes, sessions = pd.factorize(events["session"])
        first = np.unique(codes, return_index=True)[1]
        for session, *limits in zip(_cells(sessions), *(_cells(events[c][first]) for c in _LIMITS)):
            state = states[session]
            if not state["started"]:
                state.update(zip(_LIMITS, limits), started=True)

    def _cut(self, answers: dict[str, np.ndarray], states: _States, out: _Rows) -> dict[str, np.ndarray]:
        """The first answers of every session by ``seq``, as many as can be used, in order; the others are refused."""
        if not len(answers["seq"]):
            return answers
        codes, sessions = pd.factorize(answers["session"])
        order = np.lexsort((answers["seq"], codes))
        sizes = np.bincount(codes, minlength=len(sessions))
        place = np.arange(len(order)) - np.repeat(np.cumsum(sizes) - sizes, sizes)
        own = [states[x] for x in _cells(sessions)]
        beyond = place >= np.repeat([self._room(x) for x in own], sizes)
        if beyond.any():
            known = np.array([x["started"] or not self.rules.needs_start for x in own])
            out.refuse(_taken(answers, order[beyond]), np.where(np.repeat(known, sizes)[beyond], COMPLETE, SURPLUS))
            order = order[~beyond]
        return _taken(answers, order)

    def _room(self, state: dict) -> int:
        return 0 if state["ended"] else self.rules.most - state["answered"]

    def _split(self, answers: dict[str, np.ndarray]) -> dict[object, dict[str, list]]:
        """The columns of every session out of answers in its order."""
        names = _cells(answers["session"])
        columns = {c: _cells(answers[c]) for c in self._columns}
        edges = [i for i in range(len(names)) if i == 0 or names[i] != names[i - 1]] + [len(names)]
        return {names[a]: {c: x[a:b] for c, x in columns.items()} for a, b in zip(edges, edges[1:])}

    def _held(self, session) -> list[tuple]:
        found = self.waiting.getValue((session,))
        return [tuple(x) for x in found[0]] if found else []

    def _history(self, session) -> list[tuple]:
        found = self.items.getValue((session,))
        return [tuple(x) for x in found[0]] if found else []

    def _wait(self, session, state: dict, part: dict[str, list], now: int, clocks: dict, out: _Rows) -> dict[str, list]:
        """Answers that may be taken now: those that came before the start wait, and join once it is there."""
        if not state["started"] and not part["seq"]:
            return part
        held = self._held(session)
        came = list(zip(*(part[c] for c in self._columns)))
        if state["started"]:
            if self.rules.idle_ms is None:
                state["timer"] = 0
            if not held:
                return part
            self.waiting.removeKey((session,))
            both, room = sorted([*held, *came], key=lambda x: x[0]), self._room(state)
            out.refuse_items(session, (x[:2] for x in both[room:]), COMPLETE)
            return {c: [x[i] for x in both[:room]] for i, c in enumerate(self._columns)}
        fits = max(0, self.rules.most - len(held))
        out.refuse_items(session, (x[:2] for x in came[fits:]), SURPLUS)
        if came[:fits]:
            self.waiting.updateValue((session,), ([*held, *(tuple(map(_plain, x)) for x in came[:fits])],))
        if not state["timer"]:
            self._clock(session, state, now + self.rules.patience_ms, clocks)
        return {c: [] for c in self._columns}

    def _clock(self, session, state: dict, at: int, clocks: dict[int, list]) -> None:
        state["timer"] = at
        clocks.setdefault(at, []).append(session)

    def _set(self, clocks: dict[int, list]) -> None:
        for at, sessions in clocks.items():
            found = self.due.getValue((at,))
            self.due.updateValue((at,), ([*found[0], *sessions] if found else sessions,))
            self.handle.registerTimer(at)

    def _take(self, session, state: dict, part: dict[str, list], out: _Rows) -> None:
        seqs, n = part["seq"], len(part["seq"])
        stop = part["quit"].index(True) if self.rules.quit_ends and True in part["quit"] else n
        scores = np.array(part["score"][:stop], np.int64)
        turns = walk(*(state[c] for c in _LIMITS), state["answered"], state["medium_sum"], scores, self.least)
        used = 0 if state["ended"] else len(turns["pos"])
        totals = (state["total"] + np.cumsum(scores)).tolist()
        columns = {c: x[:used].tolist() for c, x in turns.items()}
        marks = scores.tolist()
        level = [LEVELS[x] for x in columns["level"]]
        out.extend(
            used, kind="turn", session=session, seq=seqs[:used], score=marks[:used], total=totals[:used], pos=columns["pos"],
            level=level, q_num=columns["q_num"], possible=[x * MAX_MARKS for x in columns["pos"]],
            medium_score=[x if at == LEVELS[1] else None for x, at in zip(columns["medium"], level)],
            next_level=[LEVELS[x] for x in columns["next"]],
            next_q_num=[None if done else x for x, done in zip(columns["next_q_num"], columns["done"])], done=columns["done"],
            **{c: part[c][:used] for c in self.rules.extra},
        )
        items = []
        if self.rules.history:
            items = list(zip(columns["pos"], part["question"], part["answer"], marks, part["feedback"], level))
        before = state["answered"]
        if used:
            state.update(
                answered=columns["pos"][used - 1], medium_sum=columns["medium"][used - 1], total=totals[used - 1],
                last_score=marks[used - 1],
            )
        ending = not state["ended"] and ((used and columns["done"][used - 1]) or (used == stop < n))
        if self.rules.history and (items or ending):
            if before:
                items = [*self._history(session), *items]
            if not ending:
                self.items.updateValue((session,), (items,))
            elif before:
                self.items.removeKey((session,))
        if ending:
            self._end(session, state, out, None if columns["done"][used - 1 : used] == [True] else "quit", items)
        # What comes behind the end is refused; the row that says quit is neither used nor refused.
        late = used + (stop == used and stop < n and ending) if state["ended"] else used
        out.refuse_items(session, zip(seqs[late:], part["score"][late:]), COMPLETE)

    def _end(self, session, state: dict, out: _Rows, reason: str | None, items: list[tuple]) -> None:
        state.update(ended=True, timer=0)
        if not self.rules.history:
            if reason:
                out.add(session=session, kind="end", ended=True, reason=reason, done=False, total=state["total"], pos=state["answered"])
            return
        history = [dict(zip(_ITEM_FIELDS, x)) for x in items]
        easy, medium, hard = (state[c] for c in _LIMITS)
        n = state["answered"]
        passed = n >= easy + medium and state["medium_sum"] >= self.least
        out.add(
            session=session, kind="report", level=LEVELS[0] if n < easy else LEVELS[2] if passed else LEVELS[1], pos=n,
            total=state["total"], possible=n * MAX_MARKS, medium_score=state["medium_sum"], done=reason is None, ended=True,
            reason=reason, domain=state["domain"], last_score=state["last_score"], history=history,
        )


class _States(dict):
    """States of a bucket's sessions, read from the map when first asked for."""

    def __init__(self, stored) -> None:
        super().__init__()
        self.stored, self.before = stored, {}
        self.any = stored.exists()

    def __missing__(self, session) -> dict:
        found = self.stored.getValue((session,)) if self.any else None
        self.before[session] = found and tuple(found)
        self[session] = dict(zip(_STATE_FIELDS, found)) if found else dict(_NEW)
        return self[session]

    def save(self) -> None:
        for session, state in self.items():
            row = tuple(state[c] for c in _STATE_FIELDS)
            if (state["started"] or state["timer"]) and row != self.before[session]:
                self.stored.updateValue((session,), row)


def _plain(x):
    """A state's value out of a pandas cell."""
    if isinstance(x, np.generic):
        x = x.item()
    return None if x is None or x is pd.NaT or (isinstance(x, float) and x != x) else x


class _Rows:
    """Output rows of a bucket's sessions, given out as frames.

    A frame costs pandas and Arrow far more by its columns than by its rows, the more so with objects in them,
    and there is one for every bucket: columns of plain types become Arrow arrays at once.
    """

    def __init__(self, rules: Rules, key: str) -> None:
        self.kinds = {c: _ARROW.get(kind) for c, kind in (x.split(" ", 1) for x in _schema(key, rules).split(", "))}
        self.columns: dict[str, list] = {c: [] for c in self.kinds}

    def add(self, **cells) -> None:
        self.extend(1, **{c: [x] for c, x in cells.items()})

    def extend(self, n: int, **cells) -> None:
        """``n`` rows, by columns; what is no list is the same in all of them, and columns that are not given are null."""
        for c, x in self.columns.items():
            cell = cells.get(c)
            x.extend(cell if isinstance(cell, list) else [cell] * n)

    def refuse(self, events: dict[str, np.ndarray], reason: str | np.ndarray) -> None:
        """Refuse events, with their fault as the reason if they have one."""
        faults, sessions, seqs = (_cells(events[c]) for c in ("fault", "session", "seq"))
        why = np.broadcast_to(reason, len(faults)).tolist()
        if any(faults):
            why = [fault or x for fault, x in zip(faults, why)]
            numberless = (_FAULTS[1], *_START_FAULTS)
            sessions = [None if w == _FAULTS[0] else x for w, x in zip(why, sessions)]
            seqs = [None if w in numberless else x for w, x in zip(why, seqs)]
        score = [x if x >= 0 else None for x in _cells(events["score"])]
        self.extend(len(why), kind="reject", reason=why, session=sessions, seq=seqs, score=score)

    def refuse_items(self, session, items: Iterable[tuple], reason: str) -> None:
        items = list(items)
        self.extend(
            len(items), session=session, kind="reject", reason=reason, seq=[x[0] for x in items],
            score=[x[1] if x[1] >= 0 else None for x in items],
        )

    def frames(self, least: int = 1) -> Iterator[pd.DataFrame]:
        if len(self.columns["session"]) >= least:
            frame = pd.DataFrame({c: _array(x, self.kinds[c]) for c, x in self.columns.items()}, copy=False)
            self.columns = {c: [] for c in self.kinds}
            yield frame


_ARROW = {"bigint": pa.int64(), "int": pa.int32(), "string": pa.string(), "boolean": pa.bool_()}


def _array(cells: list, kind: pa.DataType | None) -> pd.Series | pd.arrays.ArrowExtensionArray:
    """A column of a frame; without ``kind`` the values are left to Spark."""
    if kind is None:
        return pd.Series(cells, dtype=object)
    return pd.arrays.ArrowExtensionArray(pa.array(cells, kind, from_pandas=True))


_FAULTS = ("no session", "no number", "no score")
_START_FAULTS = ("domain not found", "no question")


def _schema(key: str, rules: Rules) -> str:
    more = [turn_schema(key), _MORE, *([_HISTORY] if rules.history else []), *(f"{c} string" for c in rules.extra)]
    return ", ".join(more)


#: Bytes of rows that a task packs at a time; bytes and number of rows that one packed row holds at most.
_BLOCK, _PACKED, _PACKED_ROWS = 8 << 20, 256 << 10, 4096


def _packed(together: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Rows of one bucket and ``lane``, with every other column as an array, in the order they came.

    Lane 0 has starts and the first answers of a session in a block, more than it can use at all; one other
    number per block has the rest, and rows with a fault.
    """

    def lanes(block: pa.RecordBatch, number: int) -> np.ndarray:
        seq = np.asarray(block.column("seq"))
        faulty = np.asarray(pc.is_valid(block.column("fault")))
        start = np.asarray(block.column("kind")) == 0
        codes = block.column("session").dictionary_encode().indices
        session = np.asarray(pc.fill_null(codes, -1))
        order = np.lexsort((seq, faulty, start, session))
        group = np.stack([session, start, faulty])[:, order]
        starts = np.r_[True, (group[:, 1:] != group[:, :-1]).any(0)]
        at = np.arange(len(order))
        place = np.empty(len(order), dtype=np.int64)
        place[order] = at - np.maximum.accumulate(np.where(starts, at, 0))
        beyond = 1 + number % _LANES
        return np.where(faulty, -beyond, np.where(start | (place < together), 0, beyond)).astype(np.int32)

    def pack(batches: list[pa.RecordBatch], number: int) -> pa.RecordBatch:
        block = pa.Table.from_batches(batches).combine_chunks().to_batches()[0]
        bucket, lane = np.asarray(block.column("bucket")), lanes(block, number)
        order = np.lexsort((lane, bucket))  # rows that tie stay in their order
        bucket, lane = bucket[order], lane[order]
        new = np.r_[True, (bucket[1:] != bucket[:-1]) | (lane[1:] != lane[:-1])]
        at = np.arange(len(order))
        place = at - np.maximum.accumulate(np.where(new, at, 0))
        most = max(1, min(_PACKED_ROWS, _PACKED * len(order) // max(1, block.nbytes)))
        begins = np.flatnonzero(place % most == 0)
        offsets = pa.array(np.r_[begins, len(order)].astype(np.int32))
        columns = {"bucket": pa.array(bucket[begins]), "lane": pa.array(lane[begins])}
        for name, column in zip(block.schema.names, block.columns):
            if name == "bucket":
                continue
            if name == "session" and pa.types.is_integer(column.type):
                # Rows without a session have a fault; with nulls beside them, numbers would become floats.
                column = pc.fill_null(column, 0)
            columns[name] = pa.ListArray.from_arrays(offsets, column.take(pa.array(order)))
        return pa.RecordBatch.from_arrays(list(columns.values()), names=list(columns))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size, number = [], 0, 0
        for batch in batches:
            if batch.num_rows:
                held.append(batch)
                size += batch.nbytes
            if size >= _BLOCK:
                yield pack(held, number)
                held, size, number = [], 0, number + 1
        if held:
            yield pack(held, number)

    return run


def _unpacked(packed: pd.DataFrame) -> dict[str, np.ndarray]:
    """The events in packed rows, by columns."""
    return {c: np.concatenate(packed[c].tolist()) for c in packed.columns if c not in ("bucket", "lane")}


def _taken(events: dict[str, np.ndarray], which: np.ndarray) -> dict[str, np.ndarray]:
    return {c: x[which] for c, x in events.items()}


def _cells(x: np.ndarray) -> list:
    """An array's values as Python has them; times as pandas has them."""
    return pd.Series(x).tolist() if x.dtype.kind in "mM" else x.tolist()


def _event(df: DataFrame, rules: Rules, kind: int, fault: Column, **cells: Column) -> DataFrame:
    """Rows as the machine takes them, without nulls in their numbers."""
    number = lambda c, none: F.coalesce(cells[c].cast("bigint"), F.lit(none)) if c in cells else F.lit(none).cast("bigint")
    none = F.lit(None).cast("string")
    return df.select(
        "session", F.lit(kind).alias("kind"), number("seq", 0).alias("seq"), number("score", -1).cast("int").alias("score"),
        *[number(x.lower(), rules.phases[x]).cast("int").alias(x.lower()) for x in LEVELS],
        cells.get("domain", none).alias("domain"), cells.get("quit", F.lit(False)).alias("quit"), fault.alias("fault"),
        *[cells.get(c, none).cast("string").alias(c) for c in rules.texts],
    )


def answer_events(answers: DataFrame, rules: Rules, blank: str = "skip") -> DataFrame:
    """Answers (session, seq, score, and optional answer, easy, medium, hard, texts) as events.

    Blank answers are left out, or count with no marks (``blank="score"``). Phases are as long as the row
    says, at most as ``rules`` says.
    """
    if blank not in ("skip", "score"):
        raise ValueError(f"unknown choice {blank!r} for blank")
    score, quit_ = F.col("score"), F.lit(False)
    if "answer" in answers.columns:
        empty = is_blank(F.col("answer"))
        if blank == "skip":
            answers = answers.where(~empty)
        else:
            score = F.when(empty, F.lit(0)).otherwise(score)
        quit_ = is_quit(F.col("answer"))
    fault = (
        F.when(F.col("session").isNull(), F.lit(_FAULTS[0])).when(F.col("seq").isNull(), F.lit(_FAULTS[1]))
        .when(score.isNull() & ~(quit_ if rules.quit_ends else F.lit(False)), F.lit(_FAULTS[2]))
    )
    limits = {
        x.lower(): F.least(F.col(x.lower()), F.lit(rules.phases[x])) for x in LEVELS if x.lower() in answers.columns
    }
    texts = {c: F.col(c) for c in rules.texts if c in answers.columns}
    return _event(answers, rules, 1, fault, seq=F.col("seq"), score=score, quit=quit_, **limits, **texts)


def start_events(starts: DataFrame, rules: Rules, on_empty_easy: str = "reject") -> DataFrame:
    """Judged starts (session, domain, accepted, reason, and optional easy, medium, hard) as events.

    A start that is not accepted, or has no Easy question with ``on_empty_easy="reject"``, becomes a reject.
    """
    if on_empty_easy not in ("reject", "advance"):
        raise ValueError(f"unknown choice {on_empty_easy!r} for on_empty_easy")
    limits = {
        x.lower(): F.least(F.col(x.lower()), F.lit(rules.phases[x])) for x in LEVELS if x.lower() in starts.columns
    }
    fault = F.when(F.col("session").isNull(), F.lit(_FAULTS[0])).when(~F.col("accepted"), F.lit(_START_FAULTS[0]))
    if on_empty_easy == "reject" and "easy" in limits:
        fault = fault.when(limits["easy"] <= 0, F.lit(_START_FAULTS[1]))
    return _event(starts, rules, 0, fault, domain=F.col("domain"), **limits)


def run_machine(events: DataFrame, rules: Rules, initial: DataFrame | None = None) -> DataFrame:
    """All rows of the machine: kind ``start``, ``turn``, ``reject``, ``report`` and, without history, ``end``.

    ``events`` come from ``answer_events`` and ``start_events``. ``initial`` (session and the columns of
    ``fold_state``) are the states to begin with; they are read in the first micro-batch only.
    """
    key = events.schema["session"].dataType.simpleString()
    bucket = F.pmod(F.xxhash64("session"), F.lit(rules.buckets)).cast("int").alias("bucket")
    arrays = ", ".join(f"{f.name} array<{f.dataType.simpleString()}>" for f in events.schema.fields)
    lanes = events.select(bucket, "*").mapInArrow(_packed(4 * rules.most), f"bucket int, lane int, {arrays}")
    given = None
    if initial is not None:
        given = initial.withColumn("session", F.col("session").cast(key)).select(bucket, F.lit(0).alias("lane"), "*").groupBy("bucket", "lane")
    return lanes.groupBy("bucket", "lane").transformWithStateInPandas(
        statefulProcessor=SessionMachine(rules, medium_pass(rules.phases), key),
        outputStructType=_schema(key, rules),
        outputMode="Append",
        timeMode="ProcessingTime" if rules.timed else "None",
        initialState=given,
    )


def session_stream(
    scored: DataFrame, *, rules: Rules | None = None, blank: str = "skip", initial: DataFrame | None = None
) -> DataFrame:
    """One row per answer of a stream (session, seq, score and optional answer, easy, medium, hard).

    Refused answers carry a ``reason``. Sessions begin with their first answer and live for ever, unless
    ``rules`` (without ``needs_start``) says otherwise.
    """
    rules = rules or Rules()
    rows = run_machine(answer_events(scored, rules, blank), rules, initial)
    return rows.where("kind in ('turn', 'reject')").select(*[x.split()[0] for x in turn_schema().split(", ")], *rules.extra)


def fold_state(used: DataFrame) -> DataFrame:
    """State of every session after a batch's ``used_answers``, to go on from in a stream."""
    order = F.col("pos")
    answered = F.count(F.lit(1))
    state = used.groupBy("session", "_e", "_m", "_h", "_passed").agg(
        answered.cast("int").alias("answered"), F.max("_medium_sum").cast("int").alias("medium_sum"),
        F.sum("score").cast("long").alias("total"), F.max_by("score", order).cast("int").alias("last_score"),
    )
    end = F.col("_e") + F.col("_m") + F.when(F.col("_passed"), F.col("_h")).otherwise(0)
    return state.select(
        "session", F.lit(True).alias("started"), F.col("_e").alias("easy"), F.col("_m").alias("medium"), F.col("_h").alias("hard"),
        "answered", "medium_sum", "total", "last_score", (F.col("answered") >= end).alias("ended"),
    )


def with_message(turns: DataFrame, phases: Phases = PHASE_LIMITS) -> DataFrame:
    """Add the phase message of every turn."""
    changed = (F.col("level") != F.col("next_level")) | F.col("done")
    medium = F.coalesce("medium_score", F.lit(0)) / F.lit(float(medium_full(phases)))
    message = (
        F.when(~changed | F.col("reason").isNotNull(), F.lit(""))
        .when(F.col("done") & (F.col("next_level") == "Hard"), F.lit(labels.HARD_DONE))
        .when(F.col("done"), labels.medium_done(medium, F.lit(False)))
        .when(F.col("next_level") == "Hard", labels.medium_done(medium, F.lit(True)))
        .otherwise(F.lit(labels.EASY_DONE))
    )
    return turns.withColumn("message", message)


def latest_state(turns: DataFrame) -> DataFrame:
    """Last state per session out of the turns written so far, in the columns of ``session_fold``."""
    last = (
        turns.where(F.col("reason").isNull())
        .groupBy("session")
        .agg(F.max_by(F.struct("next_level", "pos", "total", "possible", "done"), "pos").alias("s"))
        .select("session", "s.*")
    )
    return _folded(last.withColumnRenamed("next_level", "difficulty"))


def _folded(last: DataFrame) -> DataFrame:
    pct = labels.percentage(F.col("total"), F.col("possible"))
    return last.select(
        "session",
        "difficulty",
        F.col("pos").cast("long").alias("answered"),
        "total",
        "possible",
        labels.round_half_even(pct, 1).alias("pct"),
        "done",
        F.when(F.col("done"), labels.verdict(pct)).alias("verdict"),
    )


def settled_rejects(rows: DataFrame) -> DataFrame:
    """session, seq, reason of every refused answer out of a machine with starts.

    Rows beyond what a session can use are refused before it is known whether the session has started;
    here they meet the starts written so far.
    """
    started = rows.where("kind = 'start'").select("session", F.lit(True).alias("_known")).distinct()
    rejects = rows.where("kind = 'reject'").join(started, "session", "left")
    late = F.when(F.col("_known"), F.lit(COMPLETE)).otherwise(F.lit(NOT_FOUND))
    reason = F.when(F.col("reason") == SURPLUS, late).otherwise(F.col("reason"))
    return rejects.select("session", "seq", reason.alias("reason"))


def wrap_up(rows: DataFrame, phases: Phases = PHASE_LIMITS) -> DataFrame:
    """Wrap-up records of the sessions that ended, in the columns of the batch ``session_report`` and ``ended``."""
    lost = F.transform(
        F.filter("history", lambda x: x["score"] < MAX_MARKS),
        lambda x: F.struct(x["pos"].alias("pos"), x["question"].alias("question"), x["score"].alias("score"),
                           (F.lit(MAX_MARKS) - x["score"]).alias("lost"), x["level"].alias("level")),
    )
    pct = labels.percentage(F.col("total"), F.col("possible"))
    ratio = F.col("medium_score") / F.lit(float(medium_full(phases)))
    closing = F.when(F.col("level") == "Hard", F.lit(labels.HARD_DONE)).otherwise(labels.medium_done(ratio, F.lit(False)))
    return rows.where("kind = 'report'").select(
        "session", F.col("level").alias("difficulty"), F.col("pos").cast("long").alias("answered"), "total", "possible",
        labels.round_half_even(pct, 1).alias("pct"), "done", "ended",
        F.when(F.col("pos") > 0, labels.verdict(pct)).alias("verdict"), "last_score", "medium_score",
        "history", lost.alias("lost_marks"), F.when(F.col("done"), closing).alias("message"),
    )


def stored_sessions(spark: SparkSession, checkpoint: str, phases: Phases = PHASE_LIMITS) -> DataFrame:
    """Last state per session as the state store under ``checkpoint`` has it, in the columns of ``session_fold``.

    A read of the store's files: the stream need not run, and is not touched.
    """
    rows = spark.read.format("statestore").option("stateVarName", "session").load(checkpoint)
    n, gate = F.col("answered"), F.col("easy") + F.col("medium")
    passed = (n >= gate) & (F.col("medium_sum") >= medium_pass(phases))
    difficulty = F.when(n < F.col("easy"), F.lit("Easy")).when(passed, F.lit("Hard")).otherwise(F.lit("Medium"))
    return _folded(rows.select("user_map_key.session", "user_map_value.*").where("answered > 0").select(
        "session", difficulty.alias("difficulty"), n.alias("pos"), "total", (n * MAX_MARKS).cast("long").alias("possible"),
        (n >= gate + F.when(passed, F.col("hard")).otherwise(0)).alias("done"),
    ))


def score_stream(answers: DataFrame, questions: DataFrame, factory: ModelFactory, **model_options) -> DataFrame:
    """Score a stream of answers (session, seq, answer) where seq numbers a session's answers from 1.

    ``questions`` is a static table (session, seq, question, reference): the plan of every session, one row
    per answer it can give. See ``live.score_live`` for answers with any numbers.
    """
    paired = answers.join(questions, ["session", "seq"])
    return score_answers(paired, factory, **model_options)


def score_stream(answers: DataFrame, questions: DataFrame, factory: ModelFactory, **model_options) -> DataFrame:
    """Score a stream of answers (session, seq, answer) where seq numbers a session's answers from 1.

    ``questions`` is a static table (session, seq, question, reference): the plan of every session, one row
    per answer it can give. See ``live.score_live`` for answers with any numbers.
    """
    paired = answers.join(questions, ["session", "seq"])
    return score_answers(paired, factory, **model_options)


_PROVIDER = "spark.sql.streaming.stateStore.providerClass"
_ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


_SETTINGS = {
    "spark.sql.streaming.stateStore.providerClass": "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider",
    # Timers ask for batches without data for ever; a run over what is available would not end.
    "spark.sql.streaming.noDataMicroBatches.enabled": "false",
    # A step in Python holds a few copies of its batch, whose rows may carry questions, references and prompts.
    "spark.sql.execution.arrow.maxBytesPerBatch": "2097152b",
}


_PARTITIONS = "spark.sql.shuffle.partitions"
#: State stores that a new stream gets per core at most.
_STORES = 2


def _settings(spark: SparkSession) -> dict[str, str]:
    """Settings of a stream.

    A state store costs seconds of a task and a database of its own however little it holds, and shuffle partitions are
    often set to grow with the tables. Sessions of any number need no more stores than keep the cores busy. A stream
    that goes on from a checkpoint keeps the number it began with.
    """
    stores = min(int(spark.conf.get(_PARTITIONS)), _STORES * spark.sparkContext.defaultParallelism)
    return {**_SETTINGS, _PARTITIONS: str(stores)}


def start_query(spark: SparkSession, writer, path: str | None = None):
    """Start a stream writer with the RocksDB state store.

    A query takes the session's settings when it starts, so they are put back at once.
    """
    settings = _settings(spark)
    before = {name: spark.conf.get(name, None) for name in settings}
    for name, value in settings.items():
        spark.conf.set(name, value)
    try:
        return writer.start(path) if path else writer.start()
    finally:
        for name, value in before.items():
            if value is None:
                spark.conf.unset(name)
            else:
                spark.conf.set(name, value)


def run_available(
    rows: DataFrame, label: str = "turns", path: str | None = None, checkpoint: str | None = None,
    partition_by: Sequence[str] = (),
) -> str:
    """Process what the source holds now, append the rows as Parquet, return their folder.

    Call it again with the same ``path`` and ``checkpoint`` to go on with the stored sessions. Timers that are
    due fire with the next rows that come.
    """
    spark: SparkSession = rows.sparkSession
    path = path or new_path(spark, label)
    checkpoint = checkpoint or new_path(spark, f"{label}-state")
    writer = rows.writeStream.format("parquet").option("checkpointLocation", checkpoint).outputMode("append")
    if partition_by:
        writer = writer.partitionBy(*partition_by)
    start_query(spark, writer.trigger(availableNow=True), path).awaitTermination()
    return path
