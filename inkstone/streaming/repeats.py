"""Repeats within a horizon: the first row of a key, then the next one a horizon or more after the last kept one.

What is kept at a time depends on what was kept before it, so the rule is a fold in
order of time. In batch the keys are range-partitioned together with their times, so
that a key with very many rows spreads over many tasks. A task's piece of a key is
summed up by how it maps the last kept time at its start to the one at its end (a
step function with few steps), these maps are chained per key, and all pieces are
then folded side by side. Keys that lie in one task as a whole, all but its first and
last, are folded there at once. In a stream the state of a bucket of keys holds their last kept
times and the rows that the watermark has not passed; a timer settles them in order of time.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle
from pyspark.sql.types import BooleanType, LongType, StructField, StructType

from ..session import materialize

NEVER = np.iinfo(np.int64).min // 2


def micros(horizon: str) -> int:
    """A horizon such as "7 days" in microseconds."""
    return int(pd.Timedelta(horizon).value // 1000)


def _next(times: np.ndarray, horizon: int) -> np.ndarray:
    """For sorted times: the place of the first one that is a horizon or more later."""
    return np.searchsorted(times, times + horizon, side="left")


def _step_map(times: np.ndarray, horizon: int) -> tuple[np.ndarray, np.ndarray]:
    """(upto, end): with a last kept time L the fold enters at the first time >= L + horizon and keeps ``end`` last.

    Entries with one result are one step: it holds for L + horizon <= ``upto``.
    """
    nxt = _next(times, horizon)
    end = times.copy()
    for i in range(len(times) - 1, -1, -1):
        if nxt[i] < len(times):
            end[i] = end[nxt[i]]
    # from before the first time only entries less than a horizon after it can be reached, and the one after these
    reach = min(int(np.searchsorted(times, times[0] + horizon, side="left")) + 1, len(times))
    last = np.flatnonzero(np.append(end[1:reach] != end[: reach - 1], True))
    return times[last], end[last]


def _after(uptos: list, ends: list, horizon: int, kept: int) -> int:
    """The last kept time after a piece, given the one before it."""
    k = int(np.searchsorted(np.asarray(uptos), kept + horizon, side="left"))
    return int(ends[k]) if k < len(ends) else kept


def _kept(times: np.ndarray, horizon: int, before: int) -> np.ndarray:
    """Which of the sorted times are kept."""
    nxt, mark = _next(times, horizon), np.zeros(len(times), dtype=bool)
    i = int(np.searchsorted(times, before + horizon, side="left")) if before != NEVER else 0
    while i < len(times):
        mark[i] = True
        i = int(nxt[i])
    return mark


def first_of_horizon(df: DataFrame, ts: str, tag: str, horizon: str) -> DataFrame:
    """The kept rows of a batch. Of rows with one key and time, the least by its other columns stands for all; rows without a time or key go."""
    width, columns = micros(horizon), df.columns
    others = [c for c in columns if c not in (ts, tag)]
    one = df.filter(F.col(ts).isNotNull() & F.col(tag).isNotNull()).groupBy(tag, ts).agg(F.min(F.struct(*others) if others else F.lit(1)).alias("_o"))
    kind = df.schema[tag].dataType.simpleString()
    placed = (
        one.select(F.col(tag).alias("_tag"), F.unix_micros(F.col(ts).cast("timestamp")).alias("_t"), F.col(ts).alias("_ts"), "_o")
        .repartitionByRange("_tag", "_t").sortWithinPartitions("_tag", "_t").withColumn("_part", F.spark_partition_id())
    )
    marked = placed.mapInArrow(_inner_marks(width), StructType([*placed.schema.fields, StructField("_kept", BooleanType())]))
    pieces = materialize(marked, "pieces")
    edges = pieces.filter(F.col("_kept").isNull())
    steps = edges.select("_tag", "_part", "_t").groupBy("_tag", "_part").applyInPandas(
        lambda key, p: _summed(key, p, width), f"_tag {kind}, _part int, uptos array<long>, ends array<long>"
    )
    entries = steps.groupBy("_tag").applyInPandas(lambda key, p: _chained(key, p, width), f"_tag {kind}, _part int, before long")
    marks = edges.select("_tag", "_part", "_t").groupBy("_tag", "_part").cogroup(entries.groupBy("_tag", "_part")).applyInPandas(
        lambda key, p, e: _marked(key, p, e, width), f"_tag {kind}, _part int, _t long"
    )
    kept = pieces.filter("_kept").unionByName(edges.join(marks, ["_tag", "_part", "_t"], "left_semi"))
    return kept.select(*[F.col("_ts").alias(c) if c == ts else F.col("_tag").alias(c) if c == tag else F.col(f"_o.{c}").alias(c) for c in columns])


def _inner_marks(width: int):  # noqa: ANN202
    """Rows of one task, sorted by key and time, with ``_kept``: null for its first and last key, which may go on in other tasks."""

    def run(batches):  # noqa: ANN001, ANN202
        import pyarrow as pa
        import pyarrow.compute as pc

        held = [b for b in batches if b.num_rows]
        if not held:
            return
        table = pa.Table.from_batches(held).select(["_tag", "_t"]).combine_chunks()
        tags = pa.concat_arrays(table["_tag"].chunks)
        cut = pc.not_equal(tags[1:], tags[:-1]).to_numpy(zero_copy_only=False).astype(bool)
        starts = np.r_[0, np.flatnonzero(cut) + 1]
        mark = _marks_of_groups(starts, table["_t"].to_numpy(), width)
        open_ = np.zeros(len(mark), dtype=bool)
        open_[: starts[1] if len(starts) > 1 else None] = True
        open_[starts[-1] :] = True
        a = 0
        for batch in held:
            part = slice(a, a := a + batch.num_rows)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(mark[part], mask=open_[part])], names=[*batch.schema.names, "_kept"])

    return run


def _marks_of_groups(starts: np.ndarray, times: np.ndarray, width: int) -> np.ndarray:
    """Which times are kept, for many keys side by side: ``starts`` of the keys, times sorted within each."""
    mark, at, ends = np.zeros(len(times), dtype=bool), starts.copy(), np.r_[starts[1:], len(times)]
    while len(at) > 8:
        mark[at] = True
        low, high, goal = at + 1, ends.copy(), times[at] + width
        while (looking := low < high).any():
            mid = (low + high) // 2
            early = looking & (times[np.minimum(mid, len(times) - 1)] < goal)
            low, high = np.where(early, mid + 1, low), np.where(looking & ~early, mid, high)
        on = low < ends
        at, ends = low[on], ends[on]
    for a, b in zip(at.tolist(), ends.tolist(), strict=True):
        mark[a:b] |= _kept(times[a:b], width, NEVER)
    return mark


def _summed(key, p: pd.DataFrame, width: int) -> pd.DataFrame:  # noqa: ANN001
    uptos, ends = _step_map(np.sort(p["_t"].to_numpy()), width)
    return pd.DataFrame({"_tag": [key[0]], "_part": [key[1]], "uptos": [uptos], "ends": [ends]})


def _chained(key, p: pd.DataFrame, width: int) -> pd.DataFrame:  # noqa: ANN001
    out, kept = [], NEVER
    for r in p.sort_values("_part").itertuples(index=False):
        out.append((key[0], r[1], kept))
        kept = int(r[3][0]) if kept == NEVER else _after(r[2], r[3], width, kept)
    return pd.DataFrame(out, columns=["_tag", "_part", "before"])


def _marked(key, p: pd.DataFrame, e: pd.DataFrame, width: int) -> pd.DataFrame:  # noqa: ANN001
    times = np.sort(p["_t"].to_numpy())
    kept = times[_kept(times, width, int(e["before"].iloc[0]))]
    # a piece may keep nothing: an empty list would become a column of floats
    return pd.DataFrame({"_tag": pd.Series([key[0]] * len(kept), dtype=object), "_part": np.full(len(kept), key[1], np.int32), "_t": kept})


class FirstOfHorizon(StatefulProcessor):
    """Keeps, for a bucket of keys, their last kept times and the rows that the watermark has not passed.

    State is read and written once for a bucket and batch, and a bucket has one timer
    for the first of its rows, so that the cost of a row does not grow with those that wait.
    """

    def __init__(self, tag: str, columns: list[str], schema: StructType, width: int) -> None:
        self.tag, self.t, self.schema, self.width = columns.index(tag), columns.index(TIME), schema, width
        self.columns, self.settled = columns, {}

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.last = handle.getListState("last", StructType([self.schema.fields[self.tag], StructField("t", LongType())]))
        self.waiting = handle.getListState("waiting", self.schema)

    def _key(self, row: tuple) -> tuple:
        return row[self.tag], row[self.t]

    def _least(self, rows: Iterable[tuple]) -> dict[tuple, tuple]:
        """One row for each key and time: the least by its columns, nulls first."""
        held: dict[tuple, tuple] = {}
        order = lambda row: [(x is not None, x) for x in row]
        for row in rows:
            other = held.setdefault(self._key(row), row)
            if other is not row and order(row) < order(other):
                held[self._key(row)] = row
        return held

    def _rows(self, frame: pd.DataFrame) -> Iterator[tuple]:
        # by place: names that begin with an underscore come changed
        for row in frame.iloc[:, : len(self.columns)].itertuples(index=False, name=None):
            yield tuple(None if x is pd.NaT or x is pd.NA or (isinstance(x, float) and x != x) else x.to_pydatetime() if isinstance(x, pd.Timestamp) else x for x in row)

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:  # noqa: ANN001, N802, N803
        held = self._least(row for frame in rows for row in self._rows(frame))
        if held:
            self.waiting.appendList(list(held.values()))
            self.handle.registerTimer(_millis(min(t for _, t in held)))
        return iter(())

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:  # noqa: ANN001, N802, N803
        passed = timerValues.getCurrentWatermarkInMs()
        if self.settled.get(key) == passed:  # an earlier timer of this batch has settled all
            return
        self.settled[key] = passed
        held = list(self.waiting.get()) if self.waiting.exists() else []
        due = self._least(row for row in held if _millis(row[self.t]) < passed)
        rest = [row for row in held if _millis(row[self.t]) >= passed]
        last = dict(self.last.get()) if self.last.exists() else {}
        out = []
        for tag, t in sorted(due, key=lambda k: k[1]):
            if tag not in last or t >= last[tag] + self.width:
                out.append(due[tag, t])
                last[tag] = t
        # a key is forgotten once no repeat of its last kept row can come any more
        last = {tag: t for tag, t in last.items() if _millis(t + self.width) >= passed}
        if due:
            self.waiting.put(rest) if rest else self.waiting.clear()
        self.last.put(list(last.items())) if last else self.last.clear()
        times = [row[self.t] for row in rest] + [t + self.width for t in last.values()]
        if times:
            self.handle.registerTimer(_millis(min(times)))
        if out:
            yield pd.DataFrame(out, columns=self.columns).drop(columns=TIME)

    def close(self) -> None:
        return


#: Column with the time of a row in microseconds; buckets of keys that share their state.
TIME, BUCKETS = "_t", 1024


def _millis(t: int) -> int:
    return -(-t // 1000)


def first_of_horizon_stream(df: DataFrame, ts: str, tag: str, horizon: str, late: str | None = None) -> DataFrame:
    """The kept rows of a stream, once the watermark (``late`` behind, a horizon by default) has passed them.

    Needs the RocksDB state store. Rows later than the watermark are dropped.
    """
    if dict(df.dtypes)[ts] != "timestamp":
        raise ValueError(f"{ts} must be a timestamp")
    timed = df.filter(F.col(tag).isNotNull() & F.col(ts).isNotNull()).withWatermark(ts, late or horizon).withColumn(TIME, F.unix_micros(ts))
    placed = timed.withColumn("_bucket", F.pmod(F.xxhash64(tag), F.lit(BUCKETS)))
    return placed.groupBy("_bucket").transformWithStateInPandas(
        FirstOfHorizon(tag, timed.columns, timed.schema, micros(horizon)), df.schema, "Append", "EventTime"
    )
