"""Samples of the host: counters before and after an interval, and its processes."""

from __future__ import annotations

import time

from pyspark.sql import DataFrame, SparkSession

try:
    import psutil
except ImportError:  # an optional source
    psutil = None


def counter_delta(before: int | None, after: int | None) -> int | None:
    """Growth of a counter; null if a reading is missing or it was reset in between."""
    return None if before is None or after is None or after < before else after - before


def resource_sample(spark: SparkSession, seconds: float = 0.2) -> tuple[DataFrame, DataFrame]:
    """(counters, processes): name, before, after, delta; and pid, name, cpu_percent, rss_bytes."""
    if psutil is None:
        raise RuntimeError("host samples need psutil")

    def read() -> dict[str, int]:
        d, n, s = psutil.disk_io_counters(), psutil.net_io_counters(), psutil.swap_memory()
        return {"disk_read": getattr(d, "read_bytes", None), "disk_written": getattr(d, "write_bytes", None), "received": getattr(n, "bytes_recv", None), "sent": getattr(n, "bytes_sent", None), "swapped_in": s.sin, "swapped_out": s.sout}

    before = read()
    own = list(psutil.process_iter(["pid", "name"]))
    for p in own:
        try:
            p.cpu_percent(None)
        except psutil.Error:
            pass
    time.sleep(seconds)
    after, rows = read(), []
    for p in own:
        try:
            rows.append((p.pid, p.name(), float(p.cpu_percent(None)), p.memory_info().rss))
        except psutil.Error:
            continue
    counters = [(k, before[k], after[k], counter_delta(before[k], after[k])) for k in before]
    return spark.createDataFrame(counters, "name string, before bigint, after bigint, delta bigint"), spark.createDataFrame(rows, "pid bigint, name string, cpu_percent double, rss_bytes bigint")
