"""Sharding: small immutable shards, size-tiered compaction, and a manifest committed atomically."""

from __future__ import annotations

import json
import uuid
from collections.abc import Iterator
from functools import reduce
from itertools import groupby

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from glotmill.llm.common import shared_dir, take

TARGET = 128 << 20
FAN_IN = 4
#: Sizes up to this are the lowest tier; each further tier is FAN_IN times as large.
SMALLEST = 1 << 20
#: Merges run by so many files at a time, each batch committed on its own.
RUNS_PER_JOB = 64
ENTRY = "shard string, bytes long, rows long, digest decimal(38,0), arrival long"


class Conflict(RuntimeError):
    """Another writer has committed the version first."""


class ShardStore:
    """A folder of immutable Parquet shards and a log of versions.

    `log/<n>.json` is version n: it names the tables of shards that it adds and removes. The file is
    written whole and renamed to where nothing may be, so of two writers of a version one gets Conflict. An
    append then takes the next version; a merge, which counts on the version that it was planned on, is
    planned anew. Shards become visible only by a version, so a job that dies
    leaves unreferenced files and no half state; rerunning it is safe. All data is read and written by
    DataFrame jobs; nothing is shuffled but rows of the manifest.
    """

    def __init__(self, spark: SparkSession, root: str | None = None):
        self.spark, self.root = spark, root or f"{shared_dir(spark)}/shards-{uuid.uuid4().hex}"
        self.jvm, self.vacuumed = spark.sparkContext._jvm, 0
        self.fs = self._path(self.root).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())

    def _path(self, *parts: str):
        return self.jvm.org.apache.hadoop.fs.Path("/".join(parts))

    def versions(self) -> list[dict]:
        """Committed versions in order."""
        out = []
        while True:
            path = self._path(self.root, "log", f"{len(out) + 1:012d}.json")
            if not self.fs.exists(path):
                return out
            stream = self.fs.open(path)
            try:
                text = self.jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")
            finally:
                stream.close()
            if not text.endswith("\n"):
                return out
            out.append(json.loads(text))

    def commit(self, version: int, **what: object) -> None:
        """Make `version` visible, or raise Conflict if it exists.

        The entry is written under another name and renamed where nothing is, so that none is ever seen in part.
        """
        path, new = self._path(self.root, "log", f"{version:012d}.json"), self._path(self.root, "log", f"_{uuid.uuid4().hex}")
        if self.fs.exists(path):
            raise Conflict(f"version {version} exists")
        stream = self.fs.create(new, False)
        try:
            stream.write(bytearray((json.dumps({"version": version} | what) + "\n").encode()))
        finally:
            stream.close()
        sc = self.spark.sparkContext
        files = self.jvm.org.apache.hadoop.fs.FileContext.getFileContext(self.fs.getUri(), sc._jsc.hadoopConfiguration())
        rename = getattr(self.jvm.org.apache.hadoop.fs, "Options$Rename")
        how = sc._gateway.new_array(rename, 1)
        how[0] = rename.NONE
        try:
            files.rename(new, path, how)
        except Exception as e:
            self.fs.delete(new, False)
            if "AlreadyExists" in str(e):
                raise Conflict(f"version {version} exists") from e
            raise

    def _add(self, **what: object) -> int:
        """Commit an entry that stands beside any other as the next free version; returns that."""
        version = len(self.versions()) + 1
        while True:
            try:
                self.commit(version, **what)
                return version
            except Conflict:
                version += 1

    def live(self, version: int | None = None) -> DataFrame:
        """The manifest: one row (ENTRY) for each shard of a version, the latest by default."""
        return self._live(self.versions()[:version])

    def _live(self, log: list[dict]) -> DataFrame:
        removed = [x["removed"] for x in log if x.get("removed")]
        parts: dict[str, list] = {}
        for x in log:
            if x.get("added"):
                parts.setdefault(x["added"], []).append(x.get("arrival"))
        read = self.spark.read.schema(ENTRY)
        whole = [path for path, arrivals in parts.items() if None in arrivals]
        shards = [read.parquet(*whole)] if whole else []
        shards += [read.parquet(path).where(F.col("arrival").isin(arrivals)) for path, arrivals in parts.items() if None not in arrivals]
        if not shards:
            return self.spark.createDataFrame([], ENTRY)
        out = reduce(DataFrame.union, shards)
        return out.join(self.spark.read.parquet(*removed).select("shard"), "shard", "left_anti") if removed else out

    def rows(self, version: int | None = None) -> DataFrame:
        """All rows of a version, with `_shard`."""
        if not self.fs.exists(self._path(self.root, "data")):
            raise ValueError("the store is empty")
        data = self.spark.read.option("recursiveFileLookup", "true").parquet(f"{self.root}/data")
        return data.withColumn("_shard", F.col("_metadata.file_path")).join(self.live(version).select(F.col("shard").alias("_shard")), "_shard")

    def _describe(self, folder: str) -> str:
        """Write the manifest rows of the shards under a folder; returns the table's path."""
        data = self.spark.read.option("recursiveFileLookup", "true").parquet(folder)
        arrival = F.coalesce(F.regexp_extract("_metadata.file_path", r"_arrival=(-?\d+)/", 1).try_cast("long"), F.lit(-1).cast("long"))
        table = data.select(F.col("_metadata.file_path").alias("shard"), F.col("_metadata.file_size").alias("bytes"), arrival.alias("arrival"), F.xxhash64(*data.columns).alias("h"))
        table = table.groupBy("shard", "bytes", "arrival").agg(F.count("*").alias("rows"), F.sum(F.col("h").cast("decimal(38,0)")).alias("digest"))
        out = f"{self.root}/manifests/{uuid.uuid4().hex}"
        table.select(*[f.split()[0] for f in ENTRY.split(", ")]).write.parquet(out)
        return out

    def append(self, df: DataFrame, arrival: str | None = None) -> int:
        """Store df's partitions as new shards; returns the last version.

        With an integer column `arrival` (not stored), each of its values is an arrival of its own: its
        shards are committed as a version of their own, in ascending order. The values should be few.
        Rows go where they are, without a shuffle.
        """
        folder = f"{self.root}/data/{uuid.uuid4().hex}"
        if arrival is None:
            df.write.parquet(folder)
            return self._add(added=self._describe(folder))
        df.withColumnRenamed(arrival, "_arrival").write.partitionBy("_arrival").parquet(folder)
        if not self.spark.read.option("recursiveFileLookup", "true").schema("_x int").parquet(folder).inputFiles():
            return len(self.versions())
        added = self._describe(folder)
        for r in self.spark.read.parquet(added).select("arrival").distinct().orderBy("arrival").collect():
            version = self._add(added=added, arrival=r["arrival"])
        return version

    def plan(self, target: int = TARGET, fan_in: int = FAN_IN, rest: bool = False, version: int | None = None) -> DataFrame:
        """Shards of a version to merge: run (id of the file that they become), shard, rows, digest.

        Shards below the target meet others of their tier, in order of size, and are cut into runs of
        about the target size; a run needs fan_in shards or the full target size, with `rest` two.
        """
        live = self.live(version).where(F.col("bytes") < target)
        tier = F.greatest(F.lit(0), F.ceil(F.log(float(fan_in), F.col("bytes") / float(SMALLEST)))).cast("int")
        slots = max(1, live.count() // 20_000)
        live = live.withColumns({"tier": F.lit(0) if rest else tier, "slot": F.pmod(F.xxhash64("shard"), F.lit(slots))})
        order = Window.partitionBy("tier", "slot").orderBy("bytes", "digest", "shard").rowsBetween(Window.unboundedPreceding, -1)
        before = F.coalesce(F.sum("bytes").over(order), F.lit(0))
        live = live.withColumn("run", F.concat_ws("-", "tier", "slot", F.floor(before / target)))
        runs = live.groupBy("run").agg(F.count("*").alias("n"), F.sum("bytes").alias("b"))
        due = (F.col("n") >= (2 if rest else fan_in)) | ((F.col("b") >= target) & (F.col("n") > 1))
        return live.join(runs.where(due).select("run"), "run").select("run", "shard", "rows", "digest")

    def _merge(self, runs: list[list], columns, base: int) -> None:
        """Write each run as one file, check rows and digests, and commit version base + 1; Conflict if another did."""
        folder = f"{self.root}/data/{uuid.uuid4().hex}"
        out = None
        for run in runs:
            part = self.spark.read.schema(columns).parquet(*[r["shard"] for r in run]).coalesce(1)
            out = part if out is None else out.union(part)
        out.write.parquet(folder)
        added = self._describe(folder)
        got = self.spark.read.parquet(added).agg(F.sum("rows"), F.sum("digest")).first()
        gone = [r for run in runs for r in run]
        if (got[0], int(got[1])) != (sum(r["rows"] for r in gone), sum(int(r["digest"]) for r in gone)):
            raise RuntimeError("a merged shard differs from its parts")
        removed = f"{self.root}/manifests/{uuid.uuid4().hex}"
        self.spark.createDataFrame([(r["shard"],) for r in gone], "shard string").coalesce(1).write.parquet(removed)
        self.commit(base + 1, added=added, removed=removed)

    def compact(self, target: int = TARGET, fan_in: int = FAN_IN, keep: bool = False) -> int:
        """Merge tier by tier until no tier has fan_in small shards, then the small rest; returns the version.

        The plan comes to the driver run by run, at most RUNS_PER_JOB runs (about that many target sizes of
        data) at a time. Each batch is a version of its own, so an interrupted compaction goes on where it
        stopped. Shards that no version from then on needs are deleted unless `keep`.
        """
        columns = None
        for rest in (False, True):
            while True:
                base = len(self.versions())
                plan = self.plan(target, fan_in, rest, base).orderBy("run")
                done, last = 0, base
                try:
                    for runs in _some(plan):
                        columns = columns or self.spark.read.parquet(runs[0][0]["shard"]).schema
                        self._merge(runs, columns, last)
                        last += 1
                        done += len(runs)
                except Conflict:
                    continue
                if not keep:
                    self.vacuum()
                if not done or rest:
                    break
        return len(self.versions())

    def vacuum(self) -> None:
        """Delete files of shards that the latest version doesn't have. Earlier versions can't be read afterwards."""
        removed = [x["removed"] for x in self.versions() if x.get("removed")]
        for path in removed[self.vacuumed :]:
            for r in self.spark.read.parquet(path).toLocalIterator():
                self.fs.delete(self._path(r["shard"]), False)
        self.vacuumed = len(removed)


def _some(plan: DataFrame) -> Iterator[list[list]]:
    """A plan's runs, RUNS_PER_JOB at a time."""
    runs: list[list] = []
    for _, group in groupby(plan.toLocalIterator(), key=lambda r: r["run"]):
        runs.append([*group])
        if len(runs) == RUNS_PER_JOB:
            yield runs
            runs = []
    if runs:
        yield runs


def shard(docs: DataFrame, arrivals: int = 8, key: str = "doc_id", text: str = "text", target: int = TARGET, root: str | None = None) -> ShardStore | None:
    """Append docs' key and text as `arrivals` arrivals, dealt by a hash of both, compact, and return the store.

    None if docs has no rows. Null keys and texts are stored as they are, repeated rows stay repeated, extra
    columns are ignored. No group of rows is gathered: shards are cut by size alone.
    """
    rows = take(docs, key, text)
    store = ShardStore(docs.sparkSession, root)
    if not store.append(rows.withColumn("_arrival", F.pmod(F.xxhash64(key, text), F.lit(arrivals))), "_arrival"):
        return None
    store.compact(target)
    return store
