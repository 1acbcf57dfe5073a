"""What a stream keeps for each key, and when it lets go of it.

Processors for ``transformWithStateInPandas``. A key's state lasts until the event that closes it, or until ``idle`` has
passed without an event: a timer in event time removes it once the watermark says so. An event that comes later than that
starts anew even where the timer hasn't fired yet, so results depend on the events' times, not on how batches are cut.

Each call to the state store costs milliseconds, so keys are dealt into buckets by a hash: a bucket's keys are one list in
the store, read and written once a batch, and their rows are worked on together. The number of buckets goes with that of
keys; it can't change while a checkpoint is used.
"""

from __future__ import annotations

import json
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

KEY = "key_as_text"


class Idle(StatefulProcessor):
    """State that goes when its key has been idle. Rows have their key as text, ``ts_ms``, and an id that orders rows of one
    time."""

    more = ""  #: what else is kept of a key, as a schema

    def __init__(self, id_col: str, value: str, idle_ms: int):
        self.id_col, self.value, self.idle_ms = id_col, value, idle_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.keys = handle.getListState("keys", f"key string, last long, {self.more}")
        self.timer = handle.getValueState("timer", "at long")

    def worked(self, frame: pd.DataFrame, new: np.ndarray, keys: list, starts: np.ndarray, known: dict) -> tuple[dict, list]:
        """Columns of the result for rows in order of key and time, ``new`` where a life begins, each key's rows from its
        start on; and what to keep of each key, None for nothing. ``known`` has what was kept."""
        raise NotImplementedError

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        frame = pd.concat(list(rows), ignore_index=True)
        codes, names = pd.factorize(frame[KEY], use_na_sentinel=False)
        frame = frame.assign(code=codes).sort_values(["code", "ts_ms", self.id_col], ignore_index=True)
        codes, times = frame["code"].to_numpy(), frame["ts_ms"].to_numpy(np.int64)
        keys = [None if x is None or x != x else x for x in names]
        starts = np.searchsorted(codes, np.arange(len(keys)))
        ends = np.append(starts[1:], len(codes)) - 1
        kept = {r[0]: tuple(r[1:]) for r in self.keys.get()}
        new = np.diff(times, prepend=times[0]) > self.idle_ms
        for k, i in zip(keys, starts, strict=True):
            new[i] = k not in kept or times[i] - kept[k][0] > self.idle_ms
        out, left = self.worked(frame, new, keys, starts, {k: kept[k][1:] for k in keys if k in kept})
        for k, i, more in zip(keys, ends, left, strict=True):
            last = max(int(times[i]), kept[k][0] if k in kept else int(times[i]))
            if more is None:
                kept.pop(k, None)
            else:
                kept[k] = (last, *more)
        self.put(kept)
        yield pd.DataFrame({KEY: np.array(keys, object)[codes], self.id_col: frame[self.id_col].to_numpy(), **out})

    def put(self, kept: dict) -> None:
        """Keep this of the bucket's keys, with a timer for the one that is to go first."""
        before = self.timer.get()
        at = min(x[0] for x in kept.values()) + self.idle_ms if kept else None
        if before is not None and before[0] != at:
            self.handle.deleteTimer(before[0])
        if at is None:
            self.keys.clear()
            self.timer.clear()
            return
        self.keys.put([(k, *x) for k, x in kept.items()])
        if before is None or before[0] != at:
            self.handle.registerTimer(at)
            self.timer.update((at,))

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        now = max(timerValues.getCurrentWatermarkInMs(), expiredTimerInfo.getExpiryTimeInMs())
        self.timer.clear()  # the one that fired is gone
        self.put({r[0]: tuple(r[1:]) for r in self.keys.get() if r[1] + self.idle_ms > now})
        return iter([])

    def close(self) -> None:
        pass


class RunningStats(Idle):
    """Each row with count, mean and sample deviation of the key's values before it."""

    more = "n long, mean double, m2 double"

    def worked(self, frame, new, keys, starts, known):
        x = frame[self.value].to_numpy(float)
        cuts = new.copy()
        cuts[starts] = True
        life = np.cumsum(cuts) - 1
        heads = np.flatnonzero(cuts)
        moments = np.zeros((len(heads), 3))  # of the life when it goes on from the state
        for k, i in zip(keys, starts, strict=True):
            if not new[i]:
                moments[life[i]] = known[k]
        n0, mean0, m20 = moments.T
        base = np.where(n0 > 0, mean0, x[heads])[life]  # sums of what lies above it; that of the values in the state is 0
        gap = x - base
        after = pd.DataFrame({"first": gap, "second": gap * gap}).groupby(life).cumsum().to_numpy()
        at = np.arange(len(x)) - heads[life]

        def stats(count, first, second):
            mean = np.where(count > 0, base + first / np.maximum(count, 1), 0.0)
            return mean, np.maximum(m20[life] + second - first * first / np.maximum(count, 1), 0.0)

        sums = np.where((at > 0)[:, None], np.vstack([np.zeros((1, 2)), after[:-1]]), 0.0)
        count = n0[life].astype(np.int64) + at
        mean, squares = stats(count, *sums.T)
        last = np.append(starts[1:], len(x)) - 1
        mean_after, squares_after = stats(count + 1, *after.T)
        left = list(zip((count[last] + 1).tolist(), mean_after[last].tolist(), squares_after[last].tolist(), strict=True))
        return {"n_before": count, "mean_before": mean, "std_before": np.where(count > 1, np.sqrt(squares / np.maximum(count - 1, 1)), 0.0)}, left


class LastTokens(Idle):
    """Each row with the key's last tokens, at most ``most``. The token ``closes`` ends the state once it is reported."""

    more = "recent string"

    def __init__(self, id_col: str, value: str, idle_ms: int, most: int, closes: str | None):
        super().__init__(id_col, value, idle_ms)
        self.most, self.closes = most, closes

    def worked(self, frame, new, keys, starts, known):
        tokens, texts, left = frame[self.value].tolist(), [], []
        for k, a, b in zip(keys, starts, [*starts[1:], len(tokens)], strict=True):
            line = json.loads(known[k][0]) if k in known else []
            for i in range(a, b):
                if new[i]:
                    line = []
                line.append(tokens[i])
                if len(line) > self.most:
                    del line[0]
                texts.append(" ".join(line))
                if self.closes is not None and tokens[i] == self.closes:
                    line = []
            left.append((json.dumps(line),) if line else None)
        return {"recent": texts}, left
