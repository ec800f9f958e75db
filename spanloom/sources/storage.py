"""Span storage: appended batches, compacted versions, and a manifest of what readers see.

``bronze/`` holds appended batches, ``silver/v=N`` compacted versions, ``manifest/N.json`` which version and which batches make up state N, each with its
rows, bytes and bounds. A reader takes the newest manifest, so a compaction becomes visible at once and a failed one never.

Writers agree through the manifest's number: a file of a number that exists can't be created again, and the writer that comes second reads the state anew and
decides again. That needs a file system on which creating without overwriting is atomic (HDFS, local disks; not every object store).
"""

from __future__ import annotations

import hashlib
import json
import time
import uuid
from collections.abc import Callable

from py4j.protocol import Py4JJavaError
from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from ..operators.lifecycle import compacted, latest, merged
from .schema import SPANS_SCHEMA

#: Bounds that the manifest keeps of each part.
BOUNDS = ("start_time_ms", "trace_id", "commit_id")
#: A compaction takes the oldest batches up to this many bytes or rows, one at least.
TARGET_BYTES, TARGET_ROWS = 1 << 30, 10_000_000
#: Seconds for which a compaction holds its lease.
LEASE = 3600
#: Seconds that a reader waits for a manifest that is being written; one that its writer left unfinished is passed over after that.
PATIENCE = 5.0


class LeaseHeldError(RuntimeError):
    """Another worker is compacting."""


class SpanStore:
    def __init__(self, spark: SparkSession, root: str) -> None:
        self.spark, self.root = spark, root.rstrip("/")
        self._jvm = spark.sparkContext._jvm
        self._fs = self._path("").getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())

    def _path(self, name: str):
        return self._jvm.org.apache.hadoop.fs.Path(f"{self.root}/{name}" if name else self.root)

    def _names(self, folder: str) -> list[str]:
        at = self._path(folder)
        return sorted(s.getPath().getName() for s in self._fs.listStatus(at)) if self._fs.exists(at) else []

    def _text(self, name: str) -> str:
        stream = self._fs.open(self._path(name))
        try:
            return bytes(stream.readAllBytes()).decode()
        finally:
            stream.close()

    def _create(self, name: str, text: str) -> bool:
        """Write a file that isn't there yet; False where it is."""
        try:
            out = self._fs.create(self._path(name), False)
        except Py4JJavaError as e:
            if "AlreadyExists" in str(e.java_exception) or "already exists" in str(e.java_exception):
                return False
            raise
        try:
            out.write(text.encode())
        finally:
            out.close()
        return True

    def state(self) -> dict:
        """The newest manifest. ``n`` is the number of the newest file, finished or not."""
        names = [n for n in self._names("manifest") if n.endswith(".json")]
        for k, name in enumerate(reversed(names)):
            waited = time.monotonic()
            while True:
                try:
                    return json.loads(self._text(f"manifest/{name}")) | {"n": int(names[-1].removesuffix(".json"))}
                except ValueError:
                    # only the newest can still be in the making
                    if k or time.monotonic() - waited > PATIENCE:
                        break
                    time.sleep(0.05)
        return {"n": int(names[-1].removesuffix(".json")) if names else 0, "silver": None, "bronze": [], "streams": {}}

    def _commit(self, change: Callable[[dict], dict | None]) -> bool:
        """Write the next manifest, of what ``change`` makes of the state; where another writer was first, of the state that it left. False where ``change`` gives None."""
        while True:
            state = self.state()
            new = change(state)
            if new is None:
                return False
            if self._create(f"manifest/{state['n'] + 1:020d}.json", json.dumps(new | {"n": state["n"] + 1})):
                return True

    def _write(self, df: DataFrame, name: str, *partitions: str, mode: str = "error") -> dict:
        """Write a part; gives its entry for the manifest. Counts and bounds are taken as the rows are written."""
        seen = Observation()
        ends = [f(c).alias(f"{n}_{c}") for c in BOUNDS for n, f in (("min", F.min), ("max", F.max))]
        writer = df.observe(seen, F.count(F.lit(1)).alias("rows"), *ends).write.mode(mode).option("parquet.bloom.filter.enabled#trace_id", "true")
        (writer.partitionBy(*partitions) if partitions else writer).parquet(f"{self.root}/{name}")
        return {"path": name, "bytes": self._fs.getContentSummary(self._path(name)).getLength()} | seen.get

    def append(self, spans: DataFrame, stream: str | None = None, batch: int | None = None) -> str | None:
        """Add a batch; it is visible to the next read. A ``batch`` of a ``stream`` that is there already, or an earlier one, isn't added again: None."""
        if stream is not None:
            if self.state()["streams"].get(stream, -1) >= batch:
                return None
            # a second try writes over what the first left
            name, mode = f"bronze/{stream}-{batch:012d}-{uuid.uuid4().hex}", "overwrite"
        else:
            name, mode = f"bronze/{uuid.uuid4().hex}", "error"
        entry = self._write(spans.sortWithinPartitions("trace_id", "start_time_ms", "span_id"), name, mode=mode)

        def change(state: dict) -> dict | None:
            if stream is None:
                return state | {"bronze": [*state["bronze"], entry]}
            if state["streams"].get(stream, -1) >= batch:
                return None
            return state | {"bronze": [*state["bronze"], entry], "streams": state["streams"] | {stream: batch}}

        return name if self._commit(change) else None

    def _read(self, entries: list[dict]) -> DataFrame:
        if not entries:
            return self.spark.createDataFrame([], SPANS_SCHEMA)
        reader = self.spark.read.schema(SPANS_SCHEMA)
        # a version has folders for tenant and partition, batches have them as columns
        plain, split = [e for e in entries if e["path"].startswith("bronze")], [e for e in entries if not e["path"].startswith("bronze")]
        frames = [reader.parquet(f"{self.root}/{e['path']}") for e in split]
        if plain:
            frames.append(reader.parquet(*[f"{self.root}/{e['path']}" for e in plain]))
        out = frames[0]
        for f in frames[1:]:
            out = out.unionByName(f)
        return out

    def raw(self, tenant_id: int | None = None, since: int | None = None, until: int | None = None) -> DataFrame:
        """All rows, repeated spans too: the compacted version and the batches after it. ``since`` <= start_time_ms < ``until``; parts outside aren't listed or read."""
        df = self._read(listed(self.state(), since, until))
        if since is not None:
            df = df.filter(F.col("start_time_ms") >= since)
        if until is not None:
            df = df.filter(F.col("start_time_ms") < until)
        return df if tenant_id is None else df.filter(F.col("tenant_id") == tenant_id)

    def spans(self, tenant_id: int | None = None) -> DataFrame:
        """The latest row of each span.

        The compacted version has one row for each span already. Of it only rows that a later batch has too are left out; filters reach its scan, so a
        lookup of a trace reads what holds that trace.
        """
        state = self.state()

        def own(entries: list[dict]) -> DataFrame:
            df = self._read(entries)
            return df if tenant_id is None else df.filter(F.col("tenant_id") == tenant_id)

        silver, bronze = state["silver"], [b for b in state["bronze"] if b["rows"]]
        if not silver or not silver["rows"]:
            return latest(own(bronze))
        if not bronze:
            return own([silver])
        return merged(own([silver]), own(bronze), min(b["min_commit_id"] for b in bronze) > silver["max_commit_id"])

    def acquire(self, worker: str, seconds: float = LEASE) -> None:
        """Take the lease for compaction; one that has run out is taken over."""
        text = json.dumps({"worker": worker, "until": time.time() + seconds})
        if self._create("lease.json", text):
            return
        try:
            held = json.loads(self._text("lease.json"))
        except ValueError:
            held = {"worker": None, "until": time.time() + PATIENCE}
        if held["until"] > time.time() and held["worker"] != worker:
            raise LeaseHeldError(f"held by {held['worker']}")
        self._fs.delete(self._path("lease.json"), False)
        if not self._create("lease.json", text):
            raise LeaseHeldError("taken by another worker")

    def release(self, worker: str) -> None:
        if self._fs.exists(self._path("lease.json")) and json.loads(self._text("lease.json"))["worker"] == worker:
            self._fs.delete(self._path("lease.json"), False)

    def compact(self, batches: int | None = None, worker: str | None = None, target_bytes: int | None = None, target_rows: int | None = None) -> bool:
        """Merge the version and the oldest batches into a new version. False where there is nothing to merge, or where another compaction came first.

        ``batches``: how many; else as many as come to ``target_bytes`` or ``target_rows``, one at least, or all where neither is given. The lease keeps workers from doing the same work; what keeps rows from being
        lost is that the new version is committed only if the version and the batches that it was made of are still those of the state.
        """
        worker = worker or uuid.uuid4().hex
        self.acquire(worker)
        try:
            state = self.state()
            taken = state["bronze"][:batches] if batches is not None else selected(state["bronze"], target_bytes, target_rows)
            if not taken:
                return False
            name = f"silver/v={uuid.uuid4().hex}"
            merged_ = compacted(self._read(([state["silver"]] if state["silver"] else []) + taken))
            entry = self._write(merged_, name, "tenant_id", "partition_id")
            gone = {b["path"] for b in taken}

            def change(now: dict) -> dict | None:
                if now["silver"] != state["silver"] or not gone <= {b["path"] for b in now["bronze"]}:
                    return None
                return now | {"silver": entry, "bronze": [b for b in now["bronze"] if b["path"] not in gone]}

            if self._commit(change):
                return True
            self._fs.delete(self._path(name), True)
            return False
        finally:
            self.release(worker)

    def manifest(self) -> DataFrame:
        """The parts that make up the state, with their rows, bytes and bounds."""
        state = self.state()
        parts = [("silver", state["silver"])] if state["silver"] else []
        rows = [(kind, e["path"], e["rows"], e["bytes"], *[e[f"{f}_{c}"] for c in BOUNDS for f in ("min", "max")]) for kind, e in parts + [("bronze", b) for b in state["bronze"]]]
        kinds = {"start_time_ms": "long", "trace_id": "string", "commit_id": "long"}
        return self.spark.createDataFrame(rows, "kind string, path string, rows long, bytes long, " + ", ".join(f"{f}_{c} {kinds[c]}" for c in BOUNDS for f in ("min", "max")))

    def backup(self, folder: str) -> None:
        """Copy all rows, versions of spans too, and the manifest to a folder."""
        state = self.state()
        self._read(listed(state)).write.parquet(f"{folder}/spans")
        self.spark.createDataFrame([(json.dumps(state),)], "manifest string").coalesce(1).write.parquet(f"{folder}/manifest")

    @classmethod
    def restore(cls, spark: SparkSession, folder: str, root: str) -> SpanStore:
        """A new store with the rows of a backup; streams go on after the batches that it has."""
        store = cls(spark, root)
        store.append(spark.read.schema(SPANS_SCHEMA).parquet(f"{folder}/spans"))
        streams = json.loads(spark.read.parquet(f"{folder}/manifest").first().manifest).get("streams", {})
        store._commit(lambda state: state | {"streams": streams})
        return store


def listed(state: dict, since: int | None = None, until: int | None = None) -> list[dict]:
    """The parts that may hold rows with ``since`` <= start_time_ms < ``until``."""
    parts = ([state["silver"]] if state["silver"] else []) + state["bronze"]
    return [p for p in parts if p["rows"] and (since is None or p["max_start_time_ms"] >= since) and (until is None or p["min_start_time_ms"] < until)]


def selected(batches: list[dict], target_bytes: int | None = None, target_rows: int | None = None) -> list[dict]:
    """The oldest batches, up to the one that reaches a target."""
    if target_bytes is None and target_rows is None:
        return batches
    out, size, rows = [], 0, 0
    for b in batches:
        if out and ((target_bytes is not None and size >= target_bytes) or (target_rows is not None and rows >= target_rows)):
            break
        out.append(b)
        size, rows = size + b["bytes"], rows + b["rows"]
    return out


def stream_name(checkpoint: str) -> str:
    """A stream's name, the same after a restart from its checkpoint."""
    return hashlib.sha256(checkpoint.encode()).hexdigest()[:16]
