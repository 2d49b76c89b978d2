"""Independent writes, several at a time."""

from __future__ import annotations

from collections.abc import Callable, Iterable
from concurrent.futures import ThreadPoolExecutor
from typing import TypeVar

from pyspark import inheritable_thread_target
from pyspark.sql import SparkSession

Result = TypeVar("Result")

WRITERS = 4


def run_together(
    spark: SparkSession, tasks: Iterable[Callable[[], Result]], writers: int = WRITERS
) -> list[Result]:
    """Results in order; after a failure no further task is started, and it is raised once
    the running ones are done.

    A few writes overlap, so that small tables do not leave the cluster idle. Each
    thread keeps the job properties and tags of the caller.
    """
    with ThreadPoolExecutor(max_workers=writers) as pool:
        futures = [pool.submit(inheritable_thread_target(spark)(task)) for task in tasks]
        try:
            return [future.result() for future in futures]
        except BaseException:
            pool.shutdown(wait=True, cancel_futures=True)
            raise
