"""Hysteresis with a cooldown as a scan, so that one rule and target with a third of all samples runs in many tasks.

Samples are put in order by (key, time) and dealt out in ranges. What a range does to the state of a key is a function of
the state that comes in, and that function is small enough to be handed on without the samples:

1. each range tells how it begins and ends in runs of one outcome; over the ranges of a key this gives the streak and the
   revision that come in, and so the samples that may fire or resolve at all;
2. each range tells its transfer function: where the key would stand at the range's end, for each state at its start.
   A fire forgets what was before it, so the function has a step for each sample that could be the range's first fire,
   and only for those within a cooldown of the range's start: an earlier fire can't reach further;
3. over the ranges of a key the functions are applied one after the other, which gives each range's incoming state;
4. each range is replayed from there.

A scan sees a row for each range of a key, never its samples, and many keys in one task. A range has at most 2**ROWS rows, however
many a task has, so no task holds more than that in Python.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, functions as F

from ..sources.adapters import shared_folder

KEY = ("rule_id", "rule_version", "target")
_KEYS = "rule_id string, rule_version int, target string"
EMITTED = f"{_KEYS}, sampled_at timestamp, record_id string, previous_state string, state string, revision bigint"
AT, PART = "_at", "_part"
RUNS = f"part bigint, {_KEYS}, n bigint, first_fails boolean, lead bigint, last_fails boolean, tail bigint"
CARRY = f"{PART} bigint, {_KEYS}, revision bigint, fails boolean, streak bigint"
TURNS = f"{PART} bigint, {_KEYS}, {AT} bigint, us bigint, record_id string, fires boolean, revision bigint, pause bigint"
STEPS = "array<struct<us:bigint,after:boolean,firing:boolean,until:bigint>>"
TRANSFER = f"{PART} bigint, {_KEYS}, resolves boolean, steps {STEPS}"
START = f"{PART} bigint, {_KEYS}, firing boolean, until bigint, seen boolean"
#: bits of the number of rows in a range
ROWS = 17
#: before any fire: a cooldown that is over
NEVER = -(1 << 62)


def _columns(schema: str) -> list[str]:
    return ["steps" if c.startswith("steps") else c.split()[0] for c in schema.replace(STEPS, "s").split(", ")]


def _sorted(pdf: pd.DataFrame) -> tuple[pd.DataFrame, np.ndarray, np.ndarray]:
    """A range's rows in order, the bounds of its keys, and each row's key number."""
    pdf = pdf.sort_values(AT, ignore_index=True)
    number = pdf.groupby(list(KEY), dropna=False, sort=False).ngroup().to_numpy()
    bounds = np.concatenate([np.flatnonzero(np.concatenate([[True], number[1:] != number[:-1]])), [len(pdf)]]) if len(pdf) else np.zeros(1, int)
    return pdf, bounds, number


def _runs(pdf: pd.DataFrame, bounds: np.ndarray, number: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Whether each row fails, the starts of its runs of one outcome, and each row's run."""
    fails = (pdf["outcome"] == "failure").to_numpy(bool)
    new = np.ones(len(pdf), bool)
    new[1:] = (fails[1:] != fails[:-1]) | (number[1:] != number[:-1])
    return fails, np.flatnonzero(new), np.cumsum(new) - 1


def _ends(pdf: pd.DataFrame) -> pd.DataFrame:
    """Step 1 of a range: how each key's samples begin and end."""
    pdf, bounds, number = _sorted(pdf)
    fails, starts, run = _runs(pdf, bounds, number)
    lengths = np.diff(np.concatenate([starts, [len(pdf)]]))
    a, z = bounds[:-1], bounds[1:] - 1
    out = pdf.iloc[a][[PART, *KEY]].reset_index(drop=True).rename(columns={PART: "part"})
    return out.assign(n=bounds[1:] - a, first_fails=fails[a], lead=lengths[run[a]], last_fails=fails[z], tail=lengths[run[z]])


def _plain(key) -> tuple:
    return tuple(None if pd.isna(x) else x for x in key)


def _carried(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """The revision and the streak with which each range of a key begins; the ranges come by key and in order."""
    key, revision, fails, streak = (), 0, None, 0
    for pdf in batches:
        out = []
        for k, r in zip(zip(*[pdf[c] for c in KEY]), pdf.itertuples(index=False)):
            k = _plain(k)
            if k != key:
                key, revision, fails, streak = k, 0, None, 0
            out.append((r.part, *key, revision, fails, streak))
            whole = r.lead == r.n
            revision += r.n
            streak = r.tail + (streak if whole and r.last_fails == fails else 0)
            fails = r.last_fails
        yield pd.DataFrame(out, columns=_columns(CARRY))


def _turns(pdf: pd.DataFrame, carry: pd.DataFrame) -> pd.DataFrame:
    """The samples of a range that may turn the state: failures with their streak, and the first such success of each run."""
    if not len(pdf):
        return pd.DataFrame([], columns=_columns(TURNS))
    pdf, bounds, number = _sorted(pdf)
    fails, starts, run = _runs(pdf, bounds, number)
    known = {tuple(None if pd.isna(x) else x for x in k): v for k, *v in zip(zip(*[carry[c] for c in KEY]), carry["revision"], carry["fails"], carry["streak"])}
    came = [known[tuple(None if pd.isna(x) else x for x in k)] for k in pdf.iloc[bounds[:-1]][list(KEY)].itertuples(index=False, name=None)]
    before = np.array([c[0] for c in came], np.int64)
    more = np.array([c[2] if c[1] is not None and bool(c[1]) == fails[a] else 0 for c, a in zip(came, bounds[:-1])], np.int64)
    key = np.repeat(np.arange(len(came)), np.diff(bounds))
    rows = np.arange(len(pdf))
    streak = rows - starts[run] + 1 + np.where(run == run[bounds[:-1]][key], more[key], 0)
    need = np.where(fails, pdf["consecutive_failures"].to_numpy(), pdf["consecutive_successes"].to_numpy())
    able = (streak >= need) & pdf["record_id"].notna().to_numpy() & pdf["sampled_at"].notna().to_numpy()
    first = np.zeros(len(pdf), bool)
    first[np.flatnonzero(able)[np.unique(run[able], return_index=True)[1]]] = True
    good = np.flatnonzero(able & (fails | first))
    out = pdf.iloc[good][[PART, *KEY, AT]].reset_index(drop=True)
    us = pdf["sampled_at"].iloc[good].astype("datetime64[us]").astype("int64").to_numpy()
    pause = np.round(pdf["cooldown_seconds"].iloc[good].to_numpy(float) * 1e6).astype(np.int64)
    return out.assign(us=us, record_id=pdf["record_id"].iloc[good].to_numpy(), fires=fails[good], revision=(rows - bounds[:-1][key] + 1 + before[key])[good], pause=pause)


class Range:
    """The turning samples of one key in one range: where a fire leads."""

    def __init__(self, us: np.ndarray, fires: np.ndarray, pause: np.ndarray):
        n = len(us)
        self.us, self.fires, self.pause, self.n = us, fires, pause, n
        none = np.append(np.arange(n), n)
        self.next_fire = np.minimum.accumulate(np.where(np.append(fires, True), none, n)[::-1])[::-1]
        self.next_resolve = np.minimum.accumulate(np.where(np.append(~fires, True), none, n)[::-1])[::-1]

    def fire_after(self, i: int, until: int) -> int:
        """The first fire from place i on and not before `until`; n where there is none."""
        return int(self.next_fire[max(i, int(np.searchsorted(self.us, until)))])

    def after_fire(self, i: int) -> tuple[int, int, int]:
        """(place of the resolve, end of the cooldown, place of the next fire) of a fire at i."""
        until = int(self.us[i] + self.pause[i])
        resolve = int(self.next_resolve[i])
        return resolve, until, self.n if resolve == self.n else self.fire_after(resolve + 1, until)

    def ends(self) -> dict[int, tuple[bool, int]]:
        """(firing, until) at the end of the range, after a fire at each place."""
        out: dict[int, tuple[bool, int]] = {}
        for i in np.flatnonzero(self.fires)[::-1].tolist():
            resolve, until, again = self.after_fire(i)
            out[i] = out[again] if again < self.n else (resolve == self.n, until)
        return out

    def transfer(self) -> tuple[bool, list[dict]]:
        """Whether the range has a resolve, and the steps: an incoming cooldown up to `us` leads to (firing, until).

        after: the step lies behind the first resolve, and is the one for a key that comes in firing.
        """
        ends, resolve, steps = self.ends(), int(self.next_resolve[0]), []
        reach = int(self.us[0] + self.pause.max())
        beyond = {self.fire_after(0, reach + 1), self.fire_after(min(resolve + 1, self.n), reach + 1)}
        for i in sorted(ends):
            if self.us[i] <= reach or i in beyond:
                step = {"us": int(self.us[i]), "after": i > resolve, "firing": ends[i][0], "until": ends[i][1]}
                if steps and all(steps[-1][c] == step[c] for c in ("after", "firing", "until")):
                    steps.pop()
                steps.append(step)
        return resolve < self.n, steps


def applied(firing: bool, until: int, seen: bool, resolves: bool, steps) -> tuple[bool, int, bool]:
    """The state at the end of a range, by its transfer function."""
    if firing and not resolves:
        return firing, until, seen
    for s in steps:
        if s["us"] >= until and (s["after"] or not firing):
            return bool(s["firing"]), int(s["until"]), True
    return False, until, seen


def _segments(pdf: pd.DataFrame):
    """(part, key, its rows, their Range) of each key of a sorted range."""
    pdf, bounds, _ = _sorted(pdf)
    us, fires, pause = pdf["us"].to_numpy(np.int64), pdf["fires"].to_numpy(bool), pdf["pause"].to_numpy(np.int64)
    first = pdf.iloc[bounds[:-1]]
    for part, key, a, z in zip(first[PART].tolist(), zip(*[first[c] for c in KEY]), bounds[:-1].tolist(), bounds[1:].tolist()):
        yield part, _plain(key), slice(a, z), Range(us[a:z], fires[a:z], pause[a:z])


def _transfers(pdf: pd.DataFrame) -> pd.DataFrame:
    return pd.DataFrame([(part, *key, *span.transfer()) for part, key, _, span in _segments(pdf)], columns=_columns(TRANSFER))


def _incoming(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """The state with which each range of a key begins; the ranges come by key and in order."""
    key, state = (), (False, NEVER, False)
    for pdf in batches:
        out = []
        for k, part, resolves, steps in zip(zip(*[pdf[c] for c in KEY]), pdf[PART].tolist(), pdf["resolves"].tolist(), pdf["steps"]):
            k = _plain(k)
            if k != key:
                key, state = k, (False, NEVER, False)
            out.append((part, *key, *state))
            state = applied(*state, resolves, steps)
        yield pd.DataFrame(out, columns=_columns(START))


def _replayed(pdf: pd.DataFrame, start: pd.DataFrame) -> pd.DataFrame:
    """The transitions of a range."""
    known = {_plain(k): v for k, *v in zip(zip(*[start[c] for c in KEY]), start["firing"], start["until"], start["seen"])}
    pdf = pdf.sort_values(AT, ignore_index=True)
    every, records, revisions = pdf["us"].to_numpy(), pdf["record_id"].to_numpy(), pdf["revision"].to_numpy()
    out = []
    for _, key, rows, span in _segments(pdf) if len(pdf) else ():
        firing, until, seen = known[key]
        us, record, revision = every[rows], records[rows], revisions[rows]
        at = 0
        while at < span.n:
            if firing:
                at = int(span.next_resolve[at])
            else:
                at = span.fire_after(at, until)
            if at == span.n:
                break
            before = "firing" if firing else "resolved" if seen else "inactive"
            firing = not firing
            if firing:
                until, seen = int(us[at] + span.pause[at]), True
            out.append((*key, pd.Timestamp(int(us[at]), unit="us"), record[at], before, "firing" if firing else "resolved", int(revision[at])))
            at += 1
    return pd.DataFrame(out, columns=_columns(EMITTED)).astype({"sampled_at": "datetime64[us]"})


def transitions(samples: DataFrame) -> DataFrame:
    """State changes of samples(KEY, sampled_at, record_id, outcome, consecutive_failures, consecutive_successes, cooldown_seconds).

    A sample without a record counts for streaks and revisions and turns nothing, and so does one without a time, which comes first.
    """
    shared_folder(samples.sparkSession, "cooldown")  # makes sure that checkpoints have a folder that all executors reach
    order = [*KEY, "sampled_at", "record_id"]
    rows = samples.select(*order, "outcome", "consecutive_failures", "consecutive_successes", "cooldown_seconds")
    rows = rows.repartitionByRange(*order).sortWithinPartitions(*order).withColumn(AT, F.monotonically_increasing_id()).checkpoint()
    rows = rows.withColumn(PART, F.shiftright(AT, ROWS))
    by_key = lambda df, part: df.repartition(*KEY).sortWithinPartitions(*KEY, part)
    carry = by_key(rows.groupBy(PART).applyInPandas(_ends, RUNS), "part").mapInPandas(_carried, CARRY)
    both = lambda left, right: left.groupBy(PART).cogroup(right.withColumnRenamed(PART, "_to").groupBy("_to"))
    turns = both(rows, carry).applyInPandas(_turns, TURNS).checkpoint()
    start = by_key(turns.groupBy(PART).applyInPandas(_transfers, TRANSFER), PART).mapInPandas(_incoming, START)
    return both(turns, start).applyInPandas(_replayed, EMITTED)
