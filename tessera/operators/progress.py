"""Evaluation of a lazy result with reports on the way."""

from __future__ import annotations

import threading
import uuid
from collections.abc import Callable

from pyspark import StorageLevel
from pyspark.sql import DataFrame

#: Called with the tasks done and the tasks known so far of the stages that compute a result.
Progress = Callable[[int, int], None]


def evaluated(df: DataFrame, progress: Progress | None = None, every: float = 0.2) -> DataFrame:
    """``df``, computed now and kept on the executors (in memory, else on disk). ``progress`` is called while it runs,
    never with fewer tasks done than before, and once with everything done; an error in it reaches the caller."""
    sc = df.sparkSession.sparkContext
    group, over, seen, failed = f"tessera-{uuid.uuid4().hex}", threading.Event(), {}, []

    def watch() -> None:
        done = 0
        while not over.wait(every):
            for job in sc.statusTracker().getJobIdsForGroup(group):
                for stage in getattr(sc.statusTracker().getJobInfo(job), "stageIds", ()):
                    if x := sc.statusTracker().getStageInfo(stage):
                        seen[stage] = max(seen.get(stage, (0, 0)), (x.numCompletedTasks, x.numTasks))
            now = sum(a for a, _ in seen.values())
            if now > done and not failed:
                done = now
                try:
                    progress(done, max(done, sum(b for _, b in seen.values())))
                except Exception as e:  # raised again below
                    failed.append(e)

    kept = df.persist(StorageLevel.MEMORY_AND_DISK)
    before = sc.getLocalProperty("spark.jobGroup.id")
    watcher = threading.Thread(target=watch, daemon=True) if progress else None
    try:
        if watcher:
            sc.setLocalProperty("spark.jobGroup.id", group)
            watcher.start()
        kept.count()
    except BaseException:
        kept.unpersist()
        raise
    finally:
        over.set()
        if watcher:
            watcher.join()
            sc.setLocalProperty("spark.jobGroup.id", before)
    if failed:
        kept.unpersist()
        raise failed[0]
    if progress:
        total = max(1, sum(b for _, b in seen.values()))
        progress(total, total)
    return kept
