"""Stored results of earlier batches, and the pages that failed.

A result row exists for every page key that was worked on, with the reason
where the work failed, so results and reasons come from one run of the work.
Every batch writes folders with names of its own; the ``Manifest`` says which
count. A repeated batch takes the place of its earlier folders in one commit.

Failed pages are kept once, when they come in. What happens to them is a log:
one small event per attempt, with the reason, the number of attempts, the time
the next one is due and the folders that hold the page. The latest event of a
key is its state: ``open``, ``done``, or ``dead`` after the last attempt.

``compact`` rewrites all batches of a run but the last as one. The last stays
as it is, because it is the one that a stream may repeat after a failure.
"""

from __future__ import annotations

import time
import uuid
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from shelfmark.schemas import PAGES, Layout, ddl
from shelfmark.sources.keys import KeyIndex
from shelfmark.sources.manifest import Manifest

#: Events of pages that failed. ``stored`` names the folders that hold the page.
QUEUE: Layout = {
    "key": "string", "page_id": "bigint", "url": "string", "reason": "string", "attempts": "int", "due": "timestamp",
    "state": "string", "stored": "array<string>", "batch_id": "int",
}
STORED: Layout = {"key": "string", **PAGES}
_OWN: Layout = {"_key": "string", "_failed": "string", "run": "string", "batch_id": "int"}


@dataclass(frozen=True)
class Retries:
    """A page is tried ``limit`` times; after the n-th failure it waits ``wait_seconds`` times 2 to the n - 1."""

    limit: int = 5
    wait_seconds: int = 0


class Progress:
    """Results, queue and kept pages under ``path``.

    A run name belongs to one writer at a time. Writers with different names
    may work at once; their commits follow each other.
    """

    def __init__(self, spark: SparkSession, path: str, layout: Layout) -> None:
        self.spark, self.path, self.layout = spark, path.rstrip("/"), layout
        self.manifest = Manifest(spark, f"{self.path}/manifest")

    def batches(self, run: str | None = None, before: int | None = None, state: dict | None = None) -> list[dict]:
        """Finished batches, ``run, first, last`` and their folders; compacted ones span several numbers."""
        state = self.manifest.read()[1] if state is None else state
        return [b for b in state.get("batches", []) if run in (None, b["run"]) and (before is None or b["last"] < before)]

    def _read(self, kind: str, layout: Layout, folders: list[str]) -> DataFrame:
        if not folders:
            # Empty in a way that the optimizer sees, so that joins with it fall away.
            return self.spark.range(1).select(*[F.lit(None).cast(t).alias(c) for c, t in layout.items()]).filter(F.lit(False))
        return self.spark.read.schema(ddl(layout)).parquet(*[f"{self.path}/{kind}/{f}" for f in folders])

    def _outcomes(self, batches: list[dict]) -> DataFrame:
        return self._read("results", {**self.layout, **_OWN}, [b["results"] for b in batches])

    def results(self) -> DataFrame:
        """All stored rows with ``run`` and ``batch_id``; empty before the first batch."""
        return self._outcomes(self.batches()).filter("_failed IS NULL").select(*self.layout, "run", "batch_id")

    def processed(self, key: str = "url") -> DataFrame:
        """Addresses done so far."""
        return self.results().select(key)

    def next_batch(self, run: str) -> int:
        """Number after the last finished batch; an unfinished one is redone."""
        return 1 + max((b["last"] for b in self.batches(run)), default=-1)

    def seen(self, keys: DataFrame, run: str, batch_id: int) -> DataFrame:
        """Those of ``keys`` (column ``key``) that other runs and earlier batches of this run have stored.

        Keys that the index covers are looked up there; only later batches are read.
        """
        state = self.manifest.read()[1]
        index = state.get("index")
        upto = index["upto"] if index else {}
        later = [b for b in self.batches(state=state)
                 if b["last"] > upto.get(b["run"], -1) and (b["run"] != run or b["last"] < batch_id)]
        recent = self._outcomes(later).filter("_failed IS NULL").select(F.col("_key").alias("key"))
        found = keys.select("key").distinct().join(recent, "key", "left_semi")
        if index:
            found = found.unionByName(KeyIndex(self.spark, f"{self.path}/keys/{index['folder']}").seen(keys))
        return found

    def queue(self, run: str, before: int | None = None) -> DataFrame:
        """The latest event of each failed page key of a run."""
        events = self._read("queue", QUEUE, [f for b in self.batches(run, before) for f in b["queue"]])
        latest = F.max_by(F.struct(*QUEUE), F.struct("attempts", "batch_id"))
        return events.groupBy(F.col("key").alias("_of")).agg(latest.alias("e")).select("e.*")

    def rejected(self, run: str, before: int | None = None) -> DataFrame:
        """Pages that failed and will be tried again: ``page_id, url, reason, attempts, due``."""
        return self.queue(run, before).filter("state = 'open'").select("page_id", "url", "reason", "attempts", "due")

    def dead_letters(self, run: str) -> DataFrame:
        """Pages that failed for the last time: ``page_id, url, reason, attempts, html``, a row for each copy."""
        dead = self.queue(run).filter("state = 'dead'")
        return self.kept_pages(dead).select("page_id", "url", "reason", "attempts", "html")

    def kept_pages(self, events: DataFrame) -> DataFrame:
        """The kept copies of the pages of queue events; only the folders they name are read."""
        folders = sorted(r[0] for r in events.select(F.explode("stored")).distinct().collect()) if self._waits(events) else []
        why = events.select("key", "reason", "attempts")
        return self._read("stored", STORED, folders).join(why, "key")

    @staticmethod
    def _waits(events: DataFrame) -> bool:
        """False if there was no failed page at all, told from the plan without a job."""
        return "LocalRelation <empty>" not in events._jdf.queryExecution().optimizedPlan().toString()

    def _write(self, df: DataFrame, kind: str, layout: Layout) -> str:
        folder = uuid.uuid4().hex
        df.select(*[F.col(c).cast(t).alias(c) for c, t in layout.items()]).write.parquet(f"{self.path}/{kind}/{folder}")
        return folder

    def write_outcomes(self, rows: DataFrame, run: str, batch_id: int) -> tuple[str, DataFrame]:
        """Store a batch's rows (with ``_key`` and ``_failed``): (folder, its rows read again)."""
        own = rows.withColumns({"run": F.lit(run), "batch_id": F.lit(int(batch_id))})
        folder = self._write(own, "results", {**self.layout, **_OWN})
        return folder, self._read("results", {**self.layout, **_OWN}, [folder])

    def write_queue(self, events: DataFrame, fresh: DataFrame, batch_id: int) -> tuple[list[str], list[str]]:
        """Store a batch's events and the new copies of its failed pages: (queue folders, page folders).

        ``events`` has all columns of QUEUE but ``batch_id``, and ``fresh``: whether new copies came.
        """
        pages = uuid.uuid4().hex
        named = F.when(F.col("fresh"), F.array_append("stored", F.lit(pages))).otherwise(F.col("stored"))
        folder = self._write(events.withColumns({"stored": named, "batch_id": F.lit(int(batch_id))}), "queue", QUEUE)
        kept = self._read("queue", QUEUE, [folder]).filter(F.array_contains("stored", pages))
        if kept.isEmpty():
            return [folder], []
        fresh.join(kept.select("key"), "key", "left_semi").select(*STORED).write.parquet(f"{self.path}/stored/{pages}")
        return [folder], [pages]

    def finish(self, run: str, batch_id: int, results: str, queue: list[str], stored: list[str]) -> None:
        """The batch counts from here on, in place of an earlier try of it."""
        batch = {"run": run, "first": int(batch_id), "last": int(batch_id), "results": results, "queue": queue, "stored": stored}

        def change(state: dict) -> dict:
            others = [b for b in self.batches(state=state) if (b["run"], b["last"]) != (run, int(batch_id))]
            return {**state, "batches": [*others, batch]}

        self.manifest.commit(change)

    def compact(self, run: str) -> None:
        """Rewrite the batches of a run but the last as one, without finished events and copies no longer needed."""
        mine = sorted(self.batches(run), key=lambda b: b["last"])[:-1]
        if len(mine) < 2:
            return
        rows = self._outcomes(mine).filter("_failed IS NULL")
        results = self._write(rows, "results", {**self.layout, **_OWN})
        events = self.queue(run, mine[-1]["last"] + 1).filter("state <> 'done'")
        queue = pages = []
        if not events.isEmpty():
            copies = self.kept_pages(events)
            pages = [self._write(copies, "stored", STORED)]
            queue = [self._write(events.withColumn("stored", F.array(F.lit(pages[0]))), "queue", QUEUE)]
        whole = {"run": run, "first": mine[0]["first"], "last": mine[-1]["last"], "results": results, "queue": queue, "stored": pages}
        gone = {b["results"] for b in mine}

        def change(state: dict) -> dict:
            if not gone <= {b["results"] for b in self.batches(state=state)}:
                return state  # another compaction was first
            return {**state, "batches": [whole, *(b for b in self.batches(state=state) if b["results"] not in gone)]}

        self.manifest.commit(change)

    def index(self) -> None:
        """Put the keys of all batches but the last of each run into a new key index."""
        state = self.manifest.read()[1]
        last = {}
        for b in self.batches(state=state):
            last[b["run"]] = max(last.get(b["run"], -1), b["last"])
        covered = [b for b in self.batches(state=state) if b["last"] < last[b["run"]]]
        if not covered:
            return
        folder = uuid.uuid4().hex
        keys = self._outcomes(covered).filter("_failed IS NULL").select(F.col("_key").alias("key"))
        KeyIndex(self.spark, f"{self.path}/keys/{folder}").build(keys)
        upto: dict[str, int] = {}
        for b in covered:
            upto[b["run"]] = max(upto.get(b["run"], -1), b["last"])
        self.manifest.commit(lambda now: {**now, "index": {"folder": folder, "upto": upto}})

    def vacuum(self, older_than_hours: float = 24.0) -> int:
        """Delete folders that nothing names any more, left by repeated or compacted batches; gives their number.

        Readers and writers that began before ``older_than_hours`` must have ended.
        """
        state = self.manifest.read()[1]
        batches = self.batches(state=state)
        events = self._read("queue", QUEUE, [f for b in batches for f in b["queue"]])
        named = {
            "results": {b["results"] for b in batches}, "queue": {f for b in batches for f in b["queue"]},
            "stored": {r[0] for r in events.select(F.explode("stored")).distinct().collect()},
            "keys": {state["index"]["folder"]} if state.get("index") else set(),
        }
        files, gone = self.manifest.files, 0
        for kind, kept in named.items():
            root = self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.path}/{kind}")
            for status in files.listStatus(root) if files.exists(root) else []:
                age = time.time() - status.getModificationTime() / 1000
                if status.getPath().getName() not in kept and age > older_than_hours * 3600:
                    files.delete(status.getPath(), True)
                    gone += 1
        return gone
