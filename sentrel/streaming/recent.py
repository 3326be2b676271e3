"""Recent events of each key as state that expires: moving counts on a stream."""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

from pyspark.sql import DataFrame
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout


def recent_counts(stream: DataFrame, seconds: int, least: int, delay: str = "0 seconds") -> DataFrame:
    """key, ts, callers, n of a stream of (key string, ts timestamp, caller long): at each whole second at which a key has
    events, how many different callers and how many events it has from then to `seconds` later, where there are at least
    `least` callers; the batch operator says the same (moving_counts with nothing back).

    A second is told once the watermark has passed the end of its window; until then its events are the key's state, which
    so holds no more than a window and the delay. A timer at the end of the oldest window expires it, also for keys of which
    nothing more is heard. Null callers count as events only; events behind the watermark are left out by Spark."""

    def step(key: tuple, frames: Iterator, state: GroupState) -> Iterator:
        import pandas as pd

        times, callers = (list(x) for x in state.get) if state.exists else ([], [])
        if not state.hasTimedOut:
            for f in frames:
                times += [t.value // 10**9 for t in f["ts"]]
                callers += [-1 if pd.isna(c) else int(c) for c in f["caller"]]
        order = sorted(range(len(times)), key=lambda i: times[i])
        times, callers = [times[i] for i in order], [callers[i] for i in order]
        now, out, begin, end, inside = state.getCurrentWatermarkMs() / 1000, [], 0, 0, Counter()
        while begin < len(times) and times[begin] + seconds < now:
            at = times[begin]
            while end < len(times) and times[end] <= at + seconds:
                inside[callers[end]] += 1
                end += 1
            different = len(inside) - (-1 in inside)
            if different >= least:
                out.append((key[0], at, different, end - begin))
            while begin < len(times) and times[begin] == at:
                inside[callers[begin]] -= 1
                if not inside[callers[begin]]:
                    del inside[callers[begin]]
                begin += 1
        if begin < len(times):
            state.update((times[begin:], callers[begin:]))
            state.setTimeoutTimestamp(int(max((times[begin] + seconds) * 1000 + 1, state.getCurrentWatermarkMs() + 1)))
        elif state.exists:
            state.remove()
        yield pd.DataFrame(out, columns=["key", "ts", "callers", "n"]).astype({"key": "object", "ts": "int64", "callers": "int64", "n": "int64"})

    timed = stream.withWatermark("ts", delay)
    return timed.groupBy("key").applyInPandasWithState(step, "key string, ts long, callers long, n long", "times array<long>, callers array<long>", "append", GroupStateTimeout.EventTimeTimeout)
