"""Sharding by size-tiered compaction with versioned manifests.

Arrivals are appended as small immutable shards (Parquet files). Shards whose sizes lie between two powers of the fan-out form a
tier; a tier with `fanout` shards or more is merged into files of about the target size, by tasks that read whole shards one
after another: nothing is shuffled, so a hot key or source has no say in it. Shards of half the target or more are final.

A manifest lists the live shards of one version. It is written under a temporary name and renamed to its version's name, which
fails if that exists: of two writers one commits, the other reads the newer manifest and tries again (an append always can, a
compaction only while its inputs are live). Readers see the files of one manifest, whole or not at all; files of failed jobs are
in none. `vacuum` deletes what the last versions don't need.

Defined cases: nulls, empty and long texts and repeated rows are kept as they are, with all their columns: a manifest's schema
holds every column that ever arrived, and rows of arrivals without a column have null there; an arrival that gives a column
another type is refused before its files are listed. Shards of equal size keep the order in which they came. An empty arrival
adds no shard with rows. A store without versions reads as an empty table of the given schema.
"""

from __future__ import annotations

import json
import math
import uuid
from dataclasses import dataclass, replace

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructField, StructType

from treeloom.llm.common import table, work_path

TARGET_BYTES = 128 << 20
FANOUT = 4
LEAST_TIER_BYTES = 1 << 20
ARRIVAL_ROWS = 5_000
TRIES = 20


@dataclass(frozen=True)
class Shard:
    file: str  # below the store's folder
    bytes: int
    level: int  # merges that made it


@dataclass(frozen=True)
class Manifest:
    version: int
    schema: str  # JSON
    shards: tuple[Shard, ...]

    def text(self) -> str:
        head = {"version": self.version, "schema": json.loads(self.schema)}
        return "\n".join([json.dumps(head), *(json.dumps(vars(s)) for s in self.shards)])

    @classmethod
    def parse(cls, text: str) -> Manifest:
        head, *shards = map(json.loads, text.splitlines())
        return cls(head["version"], json.dumps(head["schema"]), tuple(Shard(**s) for s in shards))


def joint_schema(old: StructType, new: StructType) -> StructType:
    """All columns of both, the old ones first; a column of two types is refused."""
    kinds = {f.name: f.dataType for f in old}
    for f in new:
        if f.name in kinds and kinds[f.name].simpleString() != f.dataType.simpleString():
            raise ValueError(f"column {f.name}: {f.dataType.simpleString()} arrives, the store holds {kinds[f.name].simpleString()}")
    return StructType([StructField(f.name, f.dataType, True) for f in [*old, *(f for f in new if f.name not in kinds)]])


class Conflict(RuntimeError):
    """Another writer has committed this version."""


class ShardStore:
    def __init__(self, spark: SparkSession, path: str, *, target_bytes: int = TARGET_BYTES, fanout: int = FANOUT, least_tier_bytes: int = LEAST_TIER_BYTES):
        self.spark, self.path = spark, path.rstrip("/")
        self.target, self.fanout, self.least = target_bytes, fanout, least_tier_bytes
        self._jvm = spark.sparkContext._jvm
        self._conf = spark.sparkContext._jsc.hadoopConfiguration()
        self._fs = self._path("").getFileSystem(self._conf)

    def _path(self, below: str):
        return self._jvm.org.apache.hadoop.fs.Path(f"{self.path}/{below}" if below else self.path)

    # manifests

    def versions(self) -> list[int]:
        at = self._path("_manifest")
        if not self._fs.exists(at):
            return []
        names = [s.getPath().getName() for s in self._fs.listStatus(at)]
        return sorted(int(n[1:-5]) for n in names if n.startswith("v") and n.endswith(".json"))

    def manifest(self, version: int | None = None) -> Manifest | None:
        """The given version, or the latest; None if there is none."""
        found = self.versions()
        if not found:
            return None
        version = found[-1] if version is None else version
        stream = self._fs.open(self._path(f"_manifest/v{version:08d}.json"))
        try:
            return Manifest.parse(self._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8"))
        finally:
            stream.close()

    def _commit(self, manifest: Manifest) -> None:
        made = self._path(f"_manifest/.{uuid.uuid4().hex}")
        out = self._fs.create(made, False)
        try:
            out.write(bytearray(manifest.text().encode()))
        finally:
            out.close()
        to = self._path(f"_manifest/v{manifest.version:08d}.json")
        context = self._jvm.org.apache.hadoop.fs.FileContext.getFileContext(self._fs.getUri(), self._conf)
        rename = self._jvm.org.apache.hadoop.fs.Options.Rename
        options = self.spark.sparkContext._gateway.new_array(rename, 1)
        options[0] = rename.NONE
        try:
            context.rename(made, to, options)
        except Exception as e:
            self._fs.delete(made, False)
            if self._fs.exists(to):
                raise Conflict(str(to)) from e
            raise

    # data

    def _write(self, df: DataFrame, level: int, **options) -> list[Shard]:
        below = f"data/{uuid.uuid4().hex}"
        df.write.options(**options).parquet(f"{self.path}/{below}")
        return self._shards(below, level)

    def _shards(self, below: str, level: int) -> list[Shard]:
        found = []
        for s in self._fs.listStatus(self._path(below)):
            name = s.getPath().getName()
            if s.isFile() and name.endswith(".parquet"):
                found.append(Shard(f"{below}/{name}", s.getLen(), level))
        return sorted(found, key=lambda s: s.file)

    def append(self, df: DataFrame, rows_per_shard: int = ARRIVAL_ROWS) -> Manifest:
        """Writes df as small shards and commits them."""
        if last := self.manifest():
            joint_schema(StructType.fromJson(json.loads(last.schema)), df.schema)
        return self._add(self._write(df, 0, maxRecordsPerFile=rows_per_shard), df.schema)

    def append_by(self, df: DataFrame, arrival: str, rows_per_shard: int = ARRIVAL_ROWS) -> list[Manifest]:
        """Writes each value of the column `arrival` as an arrival of its own, in one pass, and commits one after another."""
        schema = StructType([f for f in df.schema if f.name != arrival])
        if last := self.manifest():
            joint_schema(StructType.fromJson(json.loads(last.schema)), schema)
        below = f"data/{uuid.uuid4().hex}"
        df.write.partitionBy(arrival).option("maxRecordsPerFile", rows_per_shard).parquet(f"{self.path}/{below}")
        folders = sorted(s.getPath().getName() for s in self._fs.listStatus(self._path(below)) if s.isDirectory())
        if not folders:
            return [self._add([], schema)]
        return [self._add(self._shards(f"{below}/{name}", 0), schema) for name in folders]

    def _add(self, shards: list[Shard], schema: StructType) -> Manifest:
        for _ in range(TRIES):
            last = self.manifest()
            whole = joint_schema(StructType.fromJson(json.loads(last.schema)), schema) if last else schema
            made = Manifest(last.version + 1 if last else 1, whole.json(), (last.shards if last else ()) + tuple(shards))
            try:
                self._commit(made)
                return made
            except Conflict:
                continue
        raise Conflict(f"no commit in {TRIES} tries")

    def tier(self, shard: Shard) -> int:
        return max(0, math.floor(math.log(max(shard.bytes, 1) / self.least, self.fanout))) if shard.bytes > self.least else 0

    def due(self, manifest: Manifest) -> list[list[Shard]]:
        """The tiers that are to be merged."""
        tiers: dict[int, list[Shard]] = {}
        for s in manifest.shards:
            if s.bytes < self.target / 2:
                tiers.setdefault(self.tier(s), []).append(s)
        return [v for _, v in sorted(tiers.items()) if len(v) >= self.fanout]

    def _merge(self, shards: list[Shard], schema: StructType) -> list[Shard]:
        n = max(1, round(sum(s.bytes for s in shards) / self.target))
        rows = self.spark.read.schema(schema).parquet(*(f"{self.path}/{s.file}" for s in shards))
        return self._write(rows.coalesce(n), 1 + max(s.level for s in shards))

    def compact(self) -> Manifest | None:
        """Merges until no tier is due; a version per merged tier."""
        while (last := self.manifest()) and (due := self.due(last)):
            gone = due[0]
            made = self._merge(gone, StructType.fromJson(json.loads(last.schema)))
            for _ in range(TRIES):
                last = self.manifest()
                if not set(gone) <= set(last.shards):
                    break  # another compaction took them: its files stand, ours are in no manifest
                rest = tuple(s for s in last.shards if s not in set(gone))
                try:
                    self._commit(replace(last, version=last.version + 1, shards=rest + tuple(made)))
                    break
                except Conflict:
                    continue
        return self.manifest()

    def read(self, schema: StructType | None = None, version: int | None = None) -> DataFrame:
        found = self.manifest(version)
        if not found or not found.shards:
            kind = StructType.fromJson(json.loads(found.schema)) if found else schema
            return self.spark.createDataFrame([], kind)
        kind = StructType.fromJson(json.loads(found.schema))
        return self.spark.read.schema(kind).parquet(*(f"{self.path}/{s.file}" for s in found.shards))

    def vacuum(self, keep_versions: int = 1) -> int:
        """Deletes older manifests and the shards that only they list; the number of shards deleted."""
        versions = self.versions()
        old, kept = versions[:-keep_versions], versions[-keep_versions:]
        live = {s for v in kept for s in self.manifest(v).shards}
        gone = {s for v in old for s in self.manifest(v).shards} - live
        for v in old:
            self._fs.delete(self._path(f"_manifest/v{v:08d}.json"), False)
        for s in gone:
            self._fs.delete(self._path(s.file), False)
        return len(gone)


N_ARRIVALS = 5


def op3_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The documents after arriving in five parts and being compacted, read through the manifest."""
    docs = table(spark, sf_dir, "documents")
    store = ShardStore(spark, work_path(spark, "shards"))
    arrival = F.pmod(F.xxhash64("doc_id"), F.lit(N_ARRIVALS).cast("long")).cast("int")
    store.append_by(docs.withColumn("_arrival", arrival), "_arrival")
    store.compact()
    store.vacuum()
    kept = store.read(docs.schema)
    return kept.select("doc_id", "lang", "source", F.octet_length("text").cast("long").alias("n_bytes"), F.sha2("text", 256).alias("text_sha256"))


OP3_SQL = "SELECT doc_id, lang, source, strlen(text)::BIGINT AS n_bytes, sha256(text) AS text_sha256 FROM documents"
