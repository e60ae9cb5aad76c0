"""A file tree as a Spark data source: metadata of every object, never its content."""

from __future__ import annotations

import json
import os
import stat
import time
from collections.abc import Iterator
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

SCHEMA = (
    "snapshot_id string, scope_id string, relative_path string, object_type string, device_id bigint, inode bigint, mode int, uid int, gid int, size_bytes bigint, mtime_ns bigint, ctime_ns bigint, birthtime_ns bigint, "
    "link_count int, symlink_target_raw string, readable boolean, writable boolean, executable boolean, observation_status string, error_code string, error_message string, excluded boolean, partial boolean"
)
_TYPES = ((stat.S_ISREG, "regular_file"), (stat.S_ISDIR, "directory"), (stat.S_ISLNK, "symlink"), (stat.S_ISFIFO, "fifo"), (stat.S_ISSOCK, "socket"), (stat.S_ISCHR, "character_device"), (stat.S_ISBLK, "block_device"))


@dataclass
class Budget:
    """What one scope's scan may use; a scan that meets a limit is partial, not wrong."""

    max_entries: int = 1_000_000
    max_total_stat_bytes: int | None = None
    max_duration_seconds: float = 600.0
    max_depth: int | None = None


@dataclass
class Scope(InputPartition):
    scope_id: str
    root: str


def _row(snapshot: str, scope: str, path: str, full: str, info: os.stat_result | None, error: OSError | None = None, excluded: bool = False) -> list:
    if info is None:
        status = {2: "not_found", 13: "permission_denied"}.get(error.errno if error else 0, "io_error")
        return [snapshot, scope, path, "unknown", *[None] * 11, False, False, False, status, type(error).__name__ if error else None, str(error) if error else None, excluded, True]
    kind = next((n for test, n in _TYPES if test(info.st_mode)), "unknown")
    target = None
    if kind == "symlink":
        try:
            target = os.readlink(full)
        except OSError:
            target = None
    birth = getattr(info, "st_birthtime_ns", None)
    return [
        snapshot, scope, path, kind, info.st_dev, info.st_ino, stat.S_IMODE(info.st_mode), info.st_uid, info.st_gid, info.st_size, info.st_mtime_ns, info.st_ctime_ns, birth, info.st_nlink, target,
        os.access(full, os.R_OK, follow_symlinks=False) if os.access in os.supports_follow_symlinks else os.access(full, os.R_OK), bool(info.st_mode & 0o200), bool(info.st_mode & 0o100), "observed", None, None, excluded, False,
    ]


def walk(snapshot: str, scope: str, root: str, excluded: list[str], budget: Budget) -> Iterator[list]:
    """Rows of one scope, directories before what they hold; links aren't followed, excluded ones aren't entered.

    The last row's ``partial`` is set if a limit or an unreadable directory cut the walk short.
    """
    began, seen, total, cut = time.monotonic(), 0, 0, False
    try:
        yield _row(snapshot, scope, ".", root, os.lstat(root))
    except OSError as e:
        yield _row(snapshot, scope, ".", root, None, e)
        return
    seen = 1
    open_dirs: list[tuple[str, str, int]] = [(root, "", 0)]
    held: list | None = None
    while open_dirs and not cut:
        folder, prefix, depth = open_dirs.pop()
        if budget.max_depth is not None and depth >= budget.max_depth:
            continue
        try:
            with os.scandir(folder) as found:
                children = sorted(found, key=lambda c: os.fsencode(c.name))
        except OSError:
            cut = True
            break
        below = []
        for child in children:
            if seen >= budget.max_entries or time.monotonic() - began >= budget.max_duration_seconds:
                cut = True
                break
            path = prefix + child.name
            skip = any(child.path == x or child.path.startswith(x.rstrip("/") + "/") for x in excluded)
            try:
                info = child.stat(follow_symlinks=False)
            except OSError as e:
                info, row = None, _row(snapshot, scope, path, child.path, None, e, skip)
            else:
                row = _row(snapshot, scope, path, child.path, info, excluded=skip)
            seen += 1
            if held is not None:
                yield held
            held = row
            if info is None or skip:
                continue
            if stat.S_ISREG(info.st_mode):
                total += info.st_size
                if budget.max_total_stat_bytes is not None and total > budget.max_total_stat_bytes:
                    cut = True
                    break
            elif stat.S_ISDIR(info.st_mode):
                below.append((child.path, path + "/", depth + 1))
        open_dirs += reversed(below)
    if held is not None:
        held[-1] = held[-1] or cut
        yield held


class _Reader(DataSourceReader):
    def __init__(self, options: dict) -> None:
        self.scopes = json.loads(options["scopes"])
        self.excluded = json.loads(options.get("excluded", "[]"))
        self.snapshot = options.get("snapshot_id", "")
        limits = {k: options.get(k.lower().replace("_", "")) or options.get(k) for k in ("max_entries", "max_total_stat_bytes", "max_duration_seconds", "max_depth")}
        self.budget = Budget(**{k: (float(v) if "seconds" in k else int(v)) for k, v in limits.items() if v is not None})

    def partitions(self) -> list[InputPartition]:
        return [Scope(k, self.scopes[k]) for k in sorted(self.scopes)]

    def read(self, partition: Scope) -> Iterator[tuple]:
        for row in walk(self.snapshot, partition.scope_id, partition.root, self.excluded, self.budget):
            yield tuple(row)


class FileTree(DataSource):
    """``spark.read.format("file_tree").option("scopes", json).load()``: one partition per scope."""

    @classmethod
    def name(cls) -> str:
        return "file_tree"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> DataSourceReader:
        return _Reader(dict(self.options))


def scan(spark: SparkSession, scopes: dict[str, str], snapshot_id: str = "", excluded: list[str] | None = None, budget: Budget | None = None) -> DataFrame:
    """Entries of the scopes (id to folder). Unknown folders give one row with an error."""
    if not scopes:
        raise ValueError("no scope is selected")
    spark.dataSource.register(FileTree)
    r = spark.read.format("file_tree").option("scopes", json.dumps(scopes)).option("excluded", json.dumps(excluded or [])).option("snapshot_id", snapshot_id)
    for k, v in vars(budget or Budget()).items():
        if v is not None:
            r = r.option(k, str(v))
    return r.load()
