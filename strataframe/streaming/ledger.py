"""Streaming variants: chains checked as records arrive, sessions by event time."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout


#: Records of a run that wait for an earlier one; with more of them the missing one is given up.
EARLY = 1000
_STATE = "sequence int, digest string, early_sequence array<int>, early_digest array<string>, early_previous array<string>"


def _checker(most: int):
    def check(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        sequence, digest, *early = state.get if state.exists else (0, None, [], [], [])
        waiting = {int(n): (d, p) for n, d, p in zip(*early, strict=True)}
        out = []

        def take(n: int, code: str | None = None) -> None:
            nonlocal sequence, digest
            own, previous = waiting.pop(n)
            code = code or ("PREVIOUS_DIGEST_MISMATCH" if (previous or None) != digest else None)
            if code:
                out.append((key[0], n, code))
            sequence, digest = n, own

        for b in batches:
            for r in b.sort_values("sequence").itertuples(index=False):
                if int(r.sequence) <= sequence or int(r.sequence) in waiting:
                    out.append((key[0], int(r.sequence), "SEQUENCE_GAP"))  # repeated, or after it was given up
                else:
                    waiting[int(r.sequence)] = (r.digest, r.previous)
        while waiting:
            if sequence + 1 in waiting:
                take(sequence + 1)
            elif len(waiting) > most:
                take(min(waiting), "SEQUENCE_GAP")
            else:
                break
        state.update((sequence, digest, list(waiting), [d for d, _ in waiting.values()], [p for _, p in waiting.values()]))
        yield pd.DataFrame(out, columns=["run_id", "sequence", "code"])

    return check


def checked_chain(records: DataFrame, early: int = EARLY) -> DataFrame:
    """Broken links of growing chains. ``records``: streaming run_id, sequence, digest, previous.

    The state of a run is its last sequence and digest and the records that came early: at most ``early`` of them
    wait for what is missing before them; then the gap is reported and the chain goes on behind it. So the state
    doesn't grow with the ledger, and a record that is a batch late is no gap.
    """
    own = records.select("run_id", "sequence", "digest", "previous")
    return own.groupBy("run_id").applyInPandasWithState(_checker(early), "run_id string, sequence int, code string", _STATE, "append", GroupStateTimeout.NoTimeout)


def sessions(events: DataFrame, key: str, time: str, gap: str = "30 minutes", late: str = "10 minutes") -> DataFrame:
    """Sessions by gap in event time; rows later than the watermark are dropped with their state."""
    return events.withWatermark(time, late).groupBy(key, F.session_window(time, gap)).agg(F.count(F.lit(1)).alias("events"))


def tumbling(events: DataFrame, key: str, time: str, width: str = "5 minutes", slide: str | None = None, late: str = "10 minutes") -> DataFrame:
    """Counts per key and tumbling (or sliding) window of event time."""
    w = F.window(time, width, slide) if slide else F.window(time, width)
    return events.withWatermark(time, late).groupBy(key, w).agg(F.count(F.lit(1)).alias("events"))
