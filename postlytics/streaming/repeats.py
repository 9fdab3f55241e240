"""Incremental repeat counts (F3) with Structured Streaming.

Each event (id, key, time) gets, per horizon h, the number of events of the same
key with time in [t - h, t).  An event is emitted once the watermark has passed
its time: every event that can still count for it (no later than the allowed
lateness) has then arrived, so the count equals the batch operator's; events
behind the watermark are dropped by Spark as late.  Per key the state holds the
pending events and a compact history (time -> multiplicity) of the last H
seconds, H the largest horizon -- bounded by H distinct seconds however hot the
key.  An event-time timeout revisits a key when the watermark moves past its
oldest pending event, and drops the key once its history has expired.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F


def repeat_counts_stream(events: DataFrame, key: str, time: str, id_col: str,
                         horizons: dict[str, int], lateness: str = "1 hour") -> DataFrame:
    """Streaming (id, key, time, one LONG count per horizon) from a streaming
    frame with a LONG ``id_col``, a STRING ``key`` and epoch-second ``time``.
    Rows with a null key or time are left out (their batch count is 0)."""
    import numpy as np
    import pandas as pd
    from pyspark.sql.streaming.state import GroupStateTimeout

    names, hs = list(horizons), [int(h) for h in horizons.values()]
    big = max(hs)
    ev = (events.select(F.col(id_col).cast("long").alias("_id"), F.col(key).cast("string").alias("_k"),
                        F.col(time).cast("long").alias("_t"))
                .where(F.col("_k").isNotNull() & F.col("_t").isNotNull())
                .withColumn("_ts", F.timestamp_seconds("_t"))
                .withWatermark("_ts", lateness))
    out_schema = "_id long, _k string, _t long, " + ", ".join(f"`{n}` long" for n in names)
    state_schema = "hist_t array<long>, hist_n array<long>, pend_t array<long>, pend_id array<long>"

    def step(k, batches, state):
        if state.exists:
            ht, hn, pt, pid = state.get
            hist = dict(zip(ht, hn))
            pending = list(zip(pt, pid))
        else:
            hist, pending = {}, []
        for pdf in batches:
            for t, i in zip(pdf["_t"].tolist(), pdf["_id"].tolist()):
                hist[t] = hist.get(t, 0) + 1
                pending.append((t, i))
        wm = state.getCurrentWatermarkMs() // 1000
        ready = sorted(p for p in pending if p[0] < wm)
        pending = [p for p in pending if p[0] >= wm]
        if ready:
            times = np.array(sorted(hist), dtype=np.int64)
            cum = np.concatenate([[0], np.cumsum([hist[x] for x in times.tolist()])])

            def before(x):  # events of this key with time < x
                return cum[np.searchsorted(times, x, side="left")]
            rows = {"_id": [i for _, i in ready], "_k": [k[0]] * len(ready), "_t": [t for t, _ in ready]}
            for n, h in zip(names, hs):
                rows[n] = [int(before(t) - before(t - h)) for t, _ in ready]
            yield pd.DataFrame(rows)
        # no future event (time >= wm) looks back further than wm - H
        hist = {x: c for x, c in hist.items() if x >= wm - big}
        if not pending and not hist:
            state.remove()
            return
        state.update((list(hist), [hist[x] for x in hist], [t for t, _ in pending], [i for _, i in pending]))
        nxt = min(t for t, _ in pending) + 1 if pending else max(hist) + big + 1
        state.setTimeoutTimestamp(nxt * 1000)

    counted = ev.groupBy("_k").applyInPandasWithState(
        step, out_schema, state_schema, "append", GroupStateTimeout.EventTimeTimeout)
    return counted.select(F.col("_id").alias(id_col), F.col("_k").alias(key), F.col("_t").alias(time), *names)
