"""Change feeds: a stream of changed paths and sources keeps the stored graph up to date."""

from __future__ import annotations

import contextlib
import os
import time
from collections.abc import Callable, Iterator

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..functions.ids import EXTENSIONS, norm_path
from ..session import RepositorySession, change_keys
from ..sources.repository import SKIPPED, with_language
from .source import repository_changes
from .state import newer


def latest(changes: DataFrame) -> DataFrame:
    """The last change of each path of ``changes`` (path, op, source, seq): by ``seq``, and of equal ones by op
    and source."""
    by = changes.groupBy(norm_path(F.col("path")).alias("key")).agg(F.max_by(F.struct("path", "op", "source"), F.struct("seq", "op", "source", "path")).alias("x"))
    return by.select("key", "x.*")


def apply_batch(session: RepositorySession, batch: DataFrame) -> dict:
    last = latest(batch)
    allowed = change_keys(last.select("path"))
    last = last.join(allowed, "key", "left_semi").persist()
    try:
        changes = last.select("key", F.when(F.col("op") == "delete", "missing").otherwise("file").alias("state"))
        return session.apply_changes(changes, with_language(last.where("op <> 'delete'").select("path", "source")))
    finally:
        last.unpersist()


def watch(session: RepositorySession, changes: DataFrame, checkpoint: str, trigger: dict | None = None, report: Callable[[dict], None] = lambda stats: None) -> StreamingQuery:
    """Apply a streaming frame ``path, op, source, seq`` batch by batch; events that come after a later one of their path
    do nothing, in whatever batch. A batch is applied again after a failure; that changes nothing, since equal content
    keeps the revision. ``report`` gets the session's statistics after each batch."""
    writer = newer(changes).writeStream.foreachBatch(lambda df, _: report(apply_batch(session, df))).option("checkpointLocation", checkpoint)
    return writer.trigger(**(trigger or {"processingTime": "200 milliseconds"})).start()


def watch_folder(session: RepositorySession, log: str, trigger: dict | None = None, report: Callable[[dict], None] = lambda stats: None) -> StreamingQuery:
    """Keep the graph up to date with the repository's folder. ``log`` is a folder that the driver and all executors see,
    for the stream's snapshots and checkpoint: a stream that is started again goes on from there."""
    changes = repository_changes(session.spark, session.repo_path, f"{log}/snapshots")
    return watch(session, changes, f"file://{os.path.realpath(log)}/checkpoint", trigger, report)


def folder_state(root: str) -> dict[str, tuple[int, int]]:
    """Time and size of each file below a folder that an index may hold."""
    found = {}
    for at, folders, names in os.walk(root):
        folders[:] = [x for x in folders if x not in SKIPPED]
        for name in names:
            path = os.path.join(at, name)
            with contextlib.suppress(OSError):  # it may go meanwhile
                s = os.stat(path)
                found[path] = (s.st_mtime_ns, s.st_size)
    return found


def poll(session: RepositorySession, seconds: float = 0.5, stop: Callable[[], bool] = lambda: False, quiet: float = 0.2) -> Iterator[dict]:
    """Watch the repository's folder: the session's statistics after each refresh that changed something.
    Changes are taken once the folder has been still for ``quiet`` seconds."""
    before = folder_state(session.repo_path)
    while not stop():
        time.sleep(seconds)
        now = folder_state(session.repo_path)
        if now == before:
            continue
        while (later := (time.sleep(quiet), folder_state(session.repo_path))[1]) != now:
            now = later
        changed = [p for p in before.keys() | now.keys() if before.get(p) != now.get(p) and p.rpartition(".")[2].lower() in EXTENSIONS]
        before, revision = now, session.stats()["revision"]
        if changed:
            stats = session.refresh_paths(sorted(changed))
            if stats["revision"] != revision:
                yield stats
