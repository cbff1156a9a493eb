"""The ledger's tables as append-only Parquet batches with snapshots.

A batch is written to a folder of its own in every table it has rows for and then committed by one empty file, so that
readers see all of it or nothing, and writing it again replaces it. Reading merges committed batches onto the last
snapshot. compact() writes the merged state as a new snapshot and switches to it by renaming one small file; it keeps
what folds need to go on. What a snapshot replaced is deleted by the compaction after it, so that readers can finish.

Writers may run at once: each claims the number of its batch by a file that only one can create. Batches that overlap do no
harm, since folds take the same line any number of times, and cursors go with the lines they stand behind. A batch may
have steps, which are in the number that its rows have: they fold as if each step were a batch of its own. Compactions take
turns by a lock file. A snapshot's requests lie in folders by day, so a range reads its days only, and they are merged
already: only requests that later batches touched are folded again. All paths go through Spark's file systems.
"""

from __future__ import annotations

import atexit
import json
import os
import shutil
import tempfile
from concurrent.futures import ThreadPoolExecutor

from py4j.protocol import Py4JJavaError
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import schemas
from ..operators import merge

ENVIRONMENT = "TALLIQ_STORE"
_DAY, _DAY_FILES = 86400, 8
#: Bits of a step within a row's batch_id. Rows of older stores have the plain number of their batch, and come first.
_STEP_BITS = 20


def arrival(batch: int, step: Column | int = 0) -> Column:
    """What a row of a batch's step has as its batch_id."""
    return F.lit(batch << _STEP_BITS).cast("long") + step


def batch_of(batch_id: Column) -> Column:
    return F.shiftright(batch_id, _STEP_BITS)


def default_path() -> str:
    """The environment's choice, or a folder below the user's data folder."""
    chosen = os.environ.get(ENVIRONMENT)
    if chosen:
        return chosen
    data = os.environ.get("XDG_DATA_HOME") or os.path.join(os.path.expanduser("~"), ".local", "share")
    return os.path.join(data, "talliq", "ledger")


class Files:
    """A few operations of Spark's file systems."""

    def __init__(self, spark: SparkSession, root: str):
        self.jvm, self.gateway = spark._jvm, spark.sparkContext._gateway
        self.conf = spark._jsc.hadoopConfiguration()
        self.root = root.rstrip("/")
        self.fs = self._path("").getFileSystem(self.conf)

    def _path(self, name: str):
        return self.jvm.org.apache.hadoop.fs.Path(f"{self.root}/{name}" if name else self.root)

    def names(self, folder: str) -> list[str]:
        path = self._path(folder)
        return sorted(s.getPath().getName() for s in self.fs.listStatus(path)) if self.fs.exists(path) else []

    def exists(self, name: str) -> bool:
        return self.fs.exists(self._path(name))

    def delete(self, name: str) -> None:
        self.fs.delete(self._path(name), True)

    def size(self) -> int:
        return self.fs.getContentSummary(self._path("")).getLength() if self.fs.exists(self._path("")) else 0

    def read(self, name: str) -> str | None:
        if not self.exists(name):
            return None
        stream = self.fs.open(self._path(name))
        try:
            return bytes(stream.readAllBytes()).decode()
        finally:
            stream.close()

    def write(self, name: str, text: str) -> None:
        """Replaces a small file at once."""
        temporary = self._path(f"{name}.new")
        stream = self.fs.create(temporary, True)
        try:
            stream.write(bytearray(text.encode()))
        finally:
            stream.close()
        options = self.jvm.org.apache.hadoop.fs.FileContext.getFileContext(temporary.toUri(), self.conf)
        overwrite = self.jvm.org.apache.hadoop.fs.Options.Rename.OVERWRITE
        array = self.gateway.new_array(self.jvm.org.apache.hadoop.fs.Options.Rename, 1)
        array[0] = overwrite
        options.rename(options.makeQualified(temporary), options.makeQualified(self._path(name)), array)


    def create(self, name: str) -> bool:
        """Makes an empty file unless it is there; of several callers only one gets True."""
        path = self._path(name)
        self.fs.mkdirs(path.getParent())
        if path.toUri().getScheme() in (None, "file"):  # a local file system only checks, so the kernel must decide
            try:
                os.close(os.open(path.toUri().getPath(), os.O_CREAT | os.O_EXCL))
            except FileExistsError:
                return False
            return True
        try:
            self.fs.create(path, False).close()
        except Py4JJavaError:
            if self.fs.exists(path):
                return False
            raise
        return True


class Folded:
    """Numbers of batches that a snapshot has, as runs: a few however many there were."""

    def __init__(self, runs: list[list[int]] | None = None):
        self.runs = runs or []

    def __contains__(self, batch: int) -> bool:
        return any(a <= batch <= b for a, b in self.runs)

    def most(self) -> int:
        return self.runs[-1][1] if self.runs else -1

    def also(self, batches: list[int]) -> Folded:
        out: list[list[int]] = []
        for a, b in sorted([*self.runs, *([n, n] for n in batches)]):
            if out and a <= out[-1][1] + 1:
                out[-1][1] = max(out[-1][1], b)
            else:
                out.append([a, b])
        return Folded(out)


class Store:
    def __init__(self, spark: SparkSession, root: str | None = None):
        self.spark, self.root = spark, (root or default_path()).rstrip("/")
        self.files = Files(spark, self.root)

    # --- batches

    def manifest(self) -> dict:
        return json.loads(self.files.read("MANIFEST") or '{"snapshot": null, "folded": null, "garbage": []}')

    def folded(self) -> Folded:
        return Folded(self.manifest()["folded"])

    def committed(self) -> list[int]:
        return sorted(int(n) for n in self.files.names("commits") if n.isdigit())

    def next_batch(self) -> int:
        """Claims a number that no other writer gets."""
        claimed = [int(n) for n in self.files.names("claims") if n.isdigit()]
        batch = max([*claimed, *self.committed(), self.folded().most()]) + 1
        while not self.files.create(f"claims/{batch}"):
            batch += 1
        return batch

    def append(self, batch_id: int, tables: dict[str, DataFrame]) -> None:
        """Writes a batch whole; the same batch again replaces it, and a batch that a snapshot has is left alone."""
        if batch_id in self.folded():
            return
        if "usage" in tables:
            tables = tables | {"paths": merge.paths(tables["usage"])}

        def write(name: str) -> None:
            tables[name].select(*_columns(name)).write.mode("overwrite").parquet(f"{self.root}/{name}/batch={batch_id}")

        # small jobs, whose time is mostly their start: tables are written side by side
        with ThreadPoolExecutor(len(tables) or 1) as pool:
            list(pool.map(write, tables))
        self.files.write(f"commits/{batch_id}", "")

    def _fresh(self, name: str, manifest: dict) -> DataFrame | None:
        """Committed rows of a table that the snapshot doesn't have."""
        folded, there = Folded(manifest["folded"]), set(self.files.names(name))
        paths = [f"{self.root}/{name}/batch={b}" for b in self.committed() if b not in folded and f"batch={b}" in there]
        return self.spark.read.schema(schemas.TABLES[name]).parquet(*paths) if paths else None

    def _snapshot(self, name: str, manifest: dict, since: int | None = None, until: int | None = None) -> DataFrame | None:
        """A snapshot's rows; of requests, those of the days from since on and before until."""
        if manifest["snapshot"] is None:
            return None
        rows = self.spark.read.schema(schemas.TABLES[name] + (", day BIGINT" if name == "usage" else "")).parquet(f"{self.root}/snapshots/{manifest['snapshot']}/{name}")
        if name == "usage":
            if since is not None:
                rows = rows.filter((F.col("day") >= since // _DAY) & (F.col("ts") >= since))
            if until is not None:
                rows = rows.filter((F.col("day") <= until // _DAY) & (F.col("ts") < until))
        return rows.select(*_columns(name))

    def log(self, name: str) -> DataFrame:
        """All committed rows of a table that no snapshot has yet, and the snapshot's."""
        manifest = self.manifest()
        return self._union(name, self._snapshot(name, manifest), self._fresh(name, manifest))

    def _union(self, name: str, *parts: DataFrame | None) -> DataFrame:
        some = [p for p in parts if p is not None]
        if not some:
            return self.spark.createDataFrame([], schemas.TABLES[name])
        return some[0] if len(some) == 1 else some[0].unionByName(some[1])

    # --- merged tables

    def requests(self, since: int | None = None, until: int | None = None) -> DataFrame:
        """Merged requests whose time is in [since, until). A snapshot's requests that no later batch touched are read as
        they are, and only those of the range."""
        manifest = self.manifest()
        fresh = self._fresh("usage", manifest)
        if fresh is None:
            return self._union("usage", self._snapshot("usage", manifest, since, until))
        keys, whole = fresh.select("dedupe_key").distinct(), self._snapshot("usage", manifest)
        touched = fresh if whole is None else fresh.unionByName(whole.join(keys, "dedupe_key", "left_semi"))
        merged = merge.requests(touched).select(*_columns("usage"))
        if since is not None:
            merged = merged.filter(F.col("ts") >= since)
        if until is not None:
            merged = merged.filter(F.col("ts") < until)
        if whole is None:
            return merged
        return self._snapshot("usage", manifest, since, until).join(keys, "dedupe_key", "left_anti").select(*_columns("usage")).unionByName(merged)

    def sessions(self) -> DataFrame:
        """Folded from all lines; lines that a snapshot has merged are in its sessions."""
        fresh = self._fresh("usage", self.manifest())
        return merge.sessions(self.spark.createDataFrame([], schemas.USAGE) if fresh is None else fresh, self.log("sessions"))

    def cost_state(self) -> DataFrame:
        return merge.latest_cost(self.log("cost_state"))

    def limits(self) -> DataFrame:
        return merge.limit_changes(self.log("limits"))

    def cursors(self) -> DataFrame:
        return merge.latest_cursors(self.log("cursors"))

    def paths(self) -> DataFrame:
        """(id, path) of every path that was ever stored, each once."""
        return self.log("paths").distinct()

    def transcripts(self) -> DataFrame:
        """(id, path) of the paths that requests refer to; ids are those stored."""
        return self.paths().join(self.requests().select("path"), "path", "left_semi").select("id", "path")

    # --- other ways in

    @classmethod
    def temporary(cls, spark: SparkSession) -> Store:
        """A store in a folder of its own that goes when the process ends."""
        root = tempfile.mkdtemp(prefix="talliq-store-")
        atexit.register(shutil.rmtree, root, ignore_errors=True)
        return cls(spark, root)

    def add(self, usage: DataFrame, batch_id: int | None = None) -> int:
        """Appends usage rows that were made elsewhere, as one batch; its number."""
        batch = self.next_batch() if batch_id is None else batch_id
        self.append(batch, {"usage": usage.withColumn("batch_id", arrival(batch))})
        return batch

    def convert(self, folder: str) -> int:
        """Takes over the requests of an older store: a Parquet folder that may lack columns, and that may have numbers
        of paths with a table of them beside it, or paths written out. Which it is, its columns tell."""
        frame = self.spark.read.parquet(f"{folder}/requests")
        there = set(frame.columns)
        if "path" not in there and "path_id" in there:
            known = self.spark.read.parquet(f"{folder}/paths").select(F.col("id").alias("path_id"), "path")
            frame = frame.join(known, "path_id", "left").drop("path_id")
        elif "path" not in there and "transcript" in there:
            frame = frame.withColumnRenamed("transcript", "path")
        for name, value in schemas.ADDED.items():
            if name not in frame.columns:
                frame = frame.withColumn(name, F.expr(value))
        if "offset" not in frame.columns:
            frame = frame.withColumn("offset", F.lit(0))
        types = dict(part.strip().split(" ") for part in schemas.USAGE.split(","))
        return self.add(frame.select(*[F.col(c).cast(types[c]).alias(c) for c in types if c != "batch_id"]))

    # --- maintenance

    def compact(self, *, before: int | None = None, drop_cursors: DataFrame | None = None) -> None:
        """Writes a snapshot of the merged state; before: without requests, limits and snapshots of costs older than it.
        Sessions and cursors stay, so that what was pruned doesn't come back. drop_cursors: paths to forget."""
        if not self.files.create("COMPACTING"):
            raise RuntimeError(f"another compaction is running; if none is, delete {self.root}/COMPACTING")
        try:
            self._compact(before, drop_cursors)
        finally:
            self.files.delete("COMPACTING")

    def _compact(self, before: int | None, drop_cursors: DataFrame | None) -> None:
        manifest, batches = self.manifest(), self.committed()
        number = -1 if manifest["snapshot"] is None else manifest["snapshot"]
        target = f"{self.root}/snapshots/{number + 1}"
        keep = lambda df, c: df if before is None else df.filter(F.col(c) >= before)
        cursors = self.cursors()
        if drop_cursors is not None:
            cursors = cursors.join(drop_cursors.select("path"), "path", "left_anti")
        requests = keep(self.requests(), "ts")
        day = F.floor(F.col("ts") / _DAY).alias("day")
        # a day's requests go to as many files as a shuffle has partitions, at most
        by_day = requests.select(*_columns("usage"), day).repartition("day", F.pmod(F.hash("dedupe_key"), F.lit(_DAY_FILES)))
        by_day.write.mode("overwrite").partitionBy("day").parquet(f"{target}/usage")
        for name, df in (
            ("paths", merge.used_paths(self.paths(), requests)), ("sessions", self.sessions()), ("cost_state", keep(self.cost_state(), "captured_at")), ("limits", keep(self.limits(), "ts")), ("cursors", cursors),
        ):
            df.select(*_columns(name)).write.mode("overwrite").parquet(f"{target}/{name}")
        old = [f"{name}/batch={b}" for b in batches for name in schemas.TABLES] + ([f"snapshots/{number}"] if number >= 0 else [])
        folded = Folded(manifest["folded"]).also(batches)
        self.files.write("MANIFEST", json.dumps({"snapshot": number + 1, "folded": folded.runs, "garbage": old}))
        for b in batches:
            self.files.delete(f"commits/{b}")
            self.files.delete(f"claims/{b}")
        for name in manifest["garbage"]:
            self.files.delete(name)

    def delete_cursors(self, paths: list[str]) -> None:
        """Forgets cursors of files that are gone."""
        if paths:
            self.compact(drop_cursors=self.spark.createDataFrame([(p,) for p in paths], "path string"))

    def bytes(self) -> int:
        return self.files.size()


def _columns(name: str) -> list[str]:
    return [part.strip().split(" ")[0] for part in schemas.TABLES[name].split(",")]
