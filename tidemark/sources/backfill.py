"""Backfills of the raw zone: what is missing is fetched by tasks side by side, written once, and reported item by item.

What is not there (a holiday) is recorded and no failure; a failure of one item is recorded and stops no other.
"""

from __future__ import annotations

import hashlib
import time
from collections.abc import Callable

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..stages import Stage
from ..workers import ship
from .stores import MAGIC, write_report

OUTCOMES = ["downloaded", "skipped", "not_found", "failed"]
_SCHEMA = "day date, path string, outcome string, sha256 string, size long, error string"


def store_once(root: str, path: str, fetch: Callable[[], bytes | None]) -> tuple[str, str | None, int | None, str | None]:
    """(outcome, sha256, size, error) of one item: an existing file is left alone, None is not found, and bytes that do not begin as the path's extension
    demands, or an exception, are failures. The file takes its name only when it is whole."""
    try:
        system, base = fs.FileSystem.from_uri(root)
        target = f"{base}/{path}"
        if system.get_file_info(target).type != fs.FileType.NotFound:
            return "skipped", None, None, None
        content = fetch()
        if content is None:
            return "not_found", None, None, None
        heads = [bytes.fromhex(h) for h in MAGIC.get(path.rsplit(".", 1)[-1].lower(), [])]
        if not content or (heads and not any(content.startswith(h) for h in heads)):
            return "failed", None, len(content), "content does not begin as its kind of file does"
        system.create_dir(target.rsplit("/", 1)[0], recursive=True)
        digest = hashlib.sha256(content).hexdigest()
        part = f"{target}.{digest[:12]}.part"
        with system.open_output_stream(part) as out:
            out.write(content)
        system.move(part, target)
        return "downloaded", digest, len(content), None
    except Exception as e:  # one item's failure is its own
        return "failed", None, None, f"{type(e).__name__}: {e}"[:500]


def backfill(items: DataFrame, root: str, fetch: Callable[[object, str], bytes | None], *, lanes: int = 4, pause: float = 0.6) -> DataFrame:
    """(day, path, outcome, sha256, size, error) of every item (day, path below root, unique by path), after all were tried.

    fetch(day, path) gives an item's bytes, or None if the remote side has none. `lanes` tasks fetch side by side, each with `pause` seconds after an item
    that it fetched, so the remote side sees lanes / pause requests a second at most, however large the cluster is. A task that is run again finds what it
    had stored and reports it as skipped. The outcomes are written before they are returned, so that reading them fetches nothing again."""
    ship(items.sparkSession)

    def run(batches):
        for b in batches:
            out = []
            for day, path in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                told = store_once(root, path, lambda: fetch(day, path))  # noqa: B023
                out.append((day, path, *told))
                if told[0] != "skipped":
                    time.sleep(pause)
            columns = list(zip(*out, strict=True)) if out else [()] * 6
            kinds = [pa.date32(), pa.string(), pa.string(), pa.string(), pa.int64(), pa.string()]
            yield pa.RecordBatch.from_arrays([pa.array(list(c), k) for c, k in zip(columns, kinds, strict=True)], ["day", "path", "outcome", "sha256", "size", "error"])

    each = items.select(F.col("day").cast("date").alias("day"), "path").dropDuplicates(["path"]).repartition(lanes, "path")
    return Stage(items.sparkSession, "backfill").write(each.mapInArrow(run, _SCHEMA))


def report(outcomes: DataFrame) -> DataFrame:
    """One row: how many items, how many of each outcome, whether none failed, the days not found and the failures (day, path, error) in order. A row an item of
    the last two, which a calendar bounds."""
    counts = [F.count_if(F.col("outcome") == o).alias(o) for o in OUTCOMES]
    listed = lambda o, what: F.array_sort(F.collect_list(F.when(F.col("outcome") == o, what)))
    failure = F.struct(F.col("day").cast("string").alias("day"), "path", "error")
    return outcomes.agg(F.count(F.lit(1)).alias("items"), *counts, (F.count_if(F.col("outcome") == "failed") == 0).alias("ok"), listed("not_found", F.col("day").cast("string")).alias("not_found_days"), listed("failed", failure).alias("failures"))


def write_backfill_report(outcomes: DataFrame, path: str) -> None:
    """The report as JSON; a run has its own path."""
    write_report(report(outcomes).coalesce(1), path, "json")
