"""Keyed tables under generations: bucketed rows, a manifest for each generation, pinned reads and guarded commits.

A generation is a small manifest that names, for each table and bucket, the folder that holds the bucket's rows and
their digest. A commit writes the buckets that its keys fall into anew and takes the others over from the generation
it is based on, then publishes its manifest whole under the next number; of two writers that build on one generation
one is told that it came too late. Readers pin a generation and read what its manifest names, whatever is written
meanwhile. What a writer leaves that dies before it publishes is named by no manifest.
"""

from __future__ import annotations

import hashlib
import json
import os
import uuid
from dataclasses import dataclass, field
from functools import reduce

from py4j.protocol import Py4JJavaError
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from loreweave.sources.tables import stored


def _path(spark: SparkSession, path: str):
    jvm = spark.sparkContext._jvm
    found = jvm.org.apache.hadoop.fs.Path(path)
    return found.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), found


def publish(spark: SparkSession, path: str, text: str) -> bool:
    """Put a file there with its whole text, or return False where there is one. Nobody ever sees a part of it: it is
    written aside and then linked (on mounted folders) or renamed without replacing (elsewhere)."""
    files, final = _path(spark, path)
    aside = f"{path}.{uuid.uuid4().hex}.tmp"
    files.mkdirs(final.getParent())
    _, temporary = _path(spark, aside)
    out = files.create(temporary, False)
    out.write(bytearray(text.encode()))
    out.close()
    try:
        if files.getUri().getScheme() == "file":
            os.link(temporary.toUri().getPath(), final.toUri().getPath())
            return True
        jvm = spark.sparkContext._jvm
        none = spark.sparkContext._gateway.new_array(getattr(jvm.org.apache.hadoop.fs, "Options$Rename"), 0)
        jvm.org.apache.hadoop.fs.FileContext.getFileContext(files.getUri(), spark.sparkContext._jsc.hadoopConfiguration()).rename(temporary, final, none)
        return True
    except FileExistsError:
        return False
    except Py4JJavaError as failure:
        if "FileAlreadyExistsException" in failure.java_exception.getClass().getName():
            return False
        raise
    finally:
        files.delete(temporary, False)


def text_of(spark: SparkSession, path: str) -> str:
    files, found = _path(spark, path)
    stream = files.open(found)
    try:
        return spark.sparkContext._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")
    finally:
        stream.close()


def names_in(spark: SparkSession, folder: str) -> list[str]:
    files, found = _path(spark, folder)
    return sorted(s.getPath().getName() for s in files.listStatus(found)) if files.exists(found) else []


def remove(spark: SparkSession, path: str) -> None:
    files, found = _path(spark, path)
    files.delete(found, True)


class StaleSnapshot(RuntimeError):
    """The generation that was read is no longer the current one."""


@dataclass(frozen=True)
class Keyed:
    """A table of a store: rows lie by the bucket of ``key``; ``identity`` tells a row, and holds the key."""

    key: str
    identity: tuple[str, ...]


@dataclass(frozen=True)
class Change:
    """Rows that are put in, in place of those of the same identity, and what goes: rows that agree with a row of
    ``gone`` on its columns."""

    rows: DataFrame | None = None
    gone: DataFrame | None = None
    #: Identities: rows with none of these go.
    active: DataFrame | None = None


@dataclass(frozen=True)
class Snapshot:
    generation: int
    fingerprint: str
    version: str
    tables: dict = field(compare=False, repr=False)


@dataclass(frozen=True)
class Committed:
    """APPLIED, NO_OP (nothing would change) or SUPERSEDED (another generation came first), and what is current then."""

    status: str
    snapshot: Snapshot | None


class SnapshotStore:
    """Tables of one store change together. ``buckets`` is fixed when the store is made: some hundred thousand rows a
    bucket; a bucket's rows are spread over ``files`` files, so that one key of very many rows is no single task."""

    def __init__(self, spark: SparkSession, path: str, tables: dict[str, Keyed], version: str = "v1", buckets: int = 16, files: int = 4) -> None:
        if any(t.key not in t.identity for t in tables.values()):
            raise ValueError("an identity holds its key")
        self.spark, self.path, self.tables, self.version, self.buckets, self.files = spark, path.rstrip("/"), tables, version, buckets, files

    # -- generations ---------------------------------------------------------------------------------------------

    def generations(self) -> list[int]:
        return [int(n.removesuffix(".json")) for n in names_in(self.spark, f"{self.path}/manifests") if n.endswith(".json")]

    def snapshot(self, generation: int | None = None) -> Snapshot | None:
        """A generation, or the current one; None where there is none yet."""
        known = self.generations()
        if not known and generation is None:
            return None
        number = known[-1] if generation is None else generation
        body = json.loads(text_of(self.spark, f"{self.path}/manifests/{number:012d}.json"))
        if body["version"] != self.version or body["buckets"] != self.buckets:
            raise ValueError(f"the store is of version {body['version']} with {body['buckets']} buckets")
        return Snapshot(number, body["fingerprint"], body["version"], body["tables"])

    def prove(self, snapshot: Snapshot) -> None:
        """Raise StaleSnapshot unless this generation is the current one, with this content."""
        if self.snapshot() != snapshot:
            raise StaleSnapshot(f"generation {snapshot.generation} is no longer current")

    # -- reading -------------------------------------------------------------------------------------------------

    def _bucket(self, key: Column) -> Column:
        return F.pmod(F.xxhash64(key), F.lit(self.buckets)).cast("int")

    def _buckets_of(self, keys: list, schema: T.StructType, key: str) -> set[str]:
        kind = schema[key].dataType
        at = F.array_distinct(F.array(*[self._bucket(F.lit(k).cast(kind)) for k in keys]))
        return set(map(str, self.spark.range(1).select(at.alias("b")).first()["b"])) if keys else set()

    def read(self, snapshot: Snapshot, name: str, keys: list | None = None, buckets: set[str] | None = None) -> DataFrame:
        """The rows of a table in a generation; with ``keys`` (a bounded list) from the buckets of these alone."""
        table = snapshot.tables[name]
        schema = _schema(table)
        buckets = self._buckets_of(keys, schema, self.tables[name].key) if keys is not None else buckets
        folders = [f"{self.path}/data/{part['folder']}/bucket={b}" for b, part in table["buckets"].items() if buckets is None or b in buckets]
        if not folders:
            return self.spark.createDataFrame([], schema)
        rows = self.spark.read.schema(schema).parquet(*folders)
        return rows if keys is None else rows.where(F.col(self.tables[name].key).isin(keys))

    # -- writing -------------------------------------------------------------------------------------------------

    def commit(self, changes: dict[str, Change], base: Snapshot | None = None) -> Committed:
        """Publish the generation that follows ``base`` (the current one unless given)."""
        base = base or self.snapshot()
        tables = {} if base is None else dict(base.tables)
        for name, change in changes.items():
            tables[name] = self._changed(name, change, base)
        for name in self.tables:
            if name not in tables:
                raise ValueError(f"the first generation has no {name}")
        fingerprint = hashlib.sha256(json.dumps({n: {b: p["digest"] for b, p in sorted(t["buckets"].items())} for n, t in sorted(tables.items())}).encode()).hexdigest()
        if base is not None and fingerprint == base.fingerprint:
            return Committed("NO_OP", base) if self.snapshot() == base else Committed("SUPERSEDED", self.snapshot())
        number = 1 if base is None else base.generation + 1
        body = {"version": self.version, "buckets": self.buckets, "base": number - 1, "fingerprint": fingerprint, "tables": tables}
        if not publish(self.spark, f"{self.path}/manifests/{number:012d}.json", json.dumps(body)):
            return Committed("SUPERSEDED", self.snapshot())
        return Committed("APPLIED", Snapshot(number, fingerprint, self.version, tables))

    def retain(self, active: dict[str, DataFrame], base: Snapshot | None = None) -> Committed:
        """Remove what is stale: rows whose identity is none of ``active``. Buckets without such rows stay as they are."""
        return self.commit({name: Change(active=rows.select(*self.tables[name].identity)) for name, rows in active.items()}, base)

    def clear(self, base: Snapshot) -> Committed:
        """A generation without rows."""
        return self.commit({name: Change(gone=self.read(base, name).select(spec.key).distinct()) for name, spec in self.tables.items()}, base)

    def vacuum(self, keep: int = 2) -> None:
        """Drop manifests before the last ``keep`` and folders that none of these names. Nobody may read or write what
        goes: run it when readers of older generations and writers are done."""
        kept = [self.snapshot(g) for g in self.generations()[-keep:]]
        named = {part["folder"] for s in kept for t in s.tables.values() for part in t["buckets"].values()}
        for generation in self.generations()[:-keep]:
            remove(self.spark, f"{self.path}/manifests/{generation:012d}.json")
        for folder in names_in(self.spark, f"{self.path}/data"):
            if folder not in named:
                remove(self.spark, f"{self.path}/data/{folder}")

    def _changed(self, name: str, change: Change, base: Snapshot | None) -> dict:
        spec = self.tables[name]
        identity = list(spec.identity)
        schema = _schema(base.tables[name]) if base is not None and name in base.tables else None
        rows, first = change.rows, schema is None
        if rows is not None:
            rows = rows.where(F.col(spec.key).isNotNull())
        if first:
            if rows is None:
                raise ValueError(f"the first generation has no {name}")
            schema, before = _nullable(rows.schema), {}
        else:
            before = base.tables[name]["buckets"]
            rows = None if rows is None else stored(rows.select(*[F.col(f.name).cast(f.dataType).alias(f.name) for f in schema]), f"{name}-rows")  # read several times below
        gone = None if change.gone is None else stored(change.gone.distinct(), f"{name}-gone")
        active = None if change.active is None else stored(change.active.select(_told(identity).alias("told")), f"{name}-active")
        touched = [d.select(self._bucket(F.col(spec.key)).alias("b")) for d in (rows, gone) if d is not None and spec.key in d.columns]
        if gone is not None and spec.key not in gone.columns:
            touched.append(self.spark.createDataFrame([(int(b),) for b in before], "b int"))
        if active is not None and before:
            whole = self.read(base, name).select(self._bucket(F.col(spec.key)).alias("b"), _told(identity).alias("told"))
            touched.append(whole.join(active, "told", "left_anti").select("b"))
        hit: set[str] = set()
        kept = self.spark.createDataFrame([], schema) if rows is None else rows
        if before:
            hit = {str(r["b"]) for r in reduce(DataFrame.unionByName, touched).where("b is not null").distinct().collect()}  # one row a bucket
            kept = self.read(base, name, buckets=hit & set(before))
            if gone is not None:
                kept = kept.join(gone, gone.columns, "left_anti")
            for told, how in ((active, "left_semi"), (None if rows is None else rows.select(_told(identity).alias("told")), "left_anti")):
                if told is not None:
                    kept = _unpacked(_packed(kept.withColumn("told", _told(identity))).join(told, "told", how), schema)
            if rows is not None:
                kept = kept.unionByName(rows)
        folder = f"{name}-{uuid.uuid4().hex}"
        # one shuffle brings the rows of an identity together: they are told apart, counted and sorted where they arrive
        place = F.pmod(F.xxhash64(*identity), F.lit(self.files))
        dealt = _packed(kept.withColumn("bucket", self._bucket(F.col(spec.key))).withColumn("place", place)).repartition("bucket", "place").distinct()
        dealt = dealt.withColumn("copies", F.count("*").over(Window.partitionBy("bucket", "place", *identity)))
        written = _unpacked(dealt, schema, "bucket", "copies").sortWithinPartitions("bucket", spec.key)
        written.write.option("compression", "zstd").partitionBy("bucket").parquet(f"{self.path}/data/{folder}")
        now = self.spark.read.schema(T.StructType([*schema.fields, T.StructField("copies", T.LongType()), T.StructField("bucket", T.IntegerType())])).parquet(f"{self.path}/data/{folder}")
        found = contents(now, [f.name for f in schema], "bucket", F.max("copies").alias("copies")).collect()  # one row a bucket
        if any(r["copies"] > 1 for r in found):
            remove(self.spark, f"{self.path}/data/{folder}")
            raise ValueError(f"rows of {name} conflict: one identity with two contents")
        parts = {str(r["bucket"]): {"folder": folder, "rows": r["n"], "digest": r["digest"]} for r in found}
        return {"schema": schema.jsonValue(), "buckets": {b: p for b, p in before.items() if b not in hit} | parts}


def _nullable(kind: T.DataType) -> T.DataType:
    """A type with nulls allowed at every depth, as Spark reads files: what the first rows happen not to hold is no rule
    for those that follow, and rows that may hold nulls cannot be cast to a type without."""
    if isinstance(kind, T.StructType):
        return T.StructType([T.StructField(f.name, _nullable(f.dataType), True, f.metadata) for f in kind])
    if isinstance(kind, T.ArrayType):
        return T.ArrayType(_nullable(kind.elementType), True)
    return T.MapType(_nullable(kind.keyType), _nullable(kind.valueType), True) if isinstance(kind, T.MapType) else kind


def _schema(table: dict) -> T.StructType:
    """The columns of a table as its manifest names them; manifests may hold types without nulls."""
    return _nullable(T.StructType.fromJson(table["schema"]))


#: Ids of a prefix of four characters and a SHA-256, which take half their room as bytes.
_ID = r"\A[ -~]{4}[0-9a-f]{64}\z"


def _packed(rows: DataFrame) -> DataFrame:
    """Rows as they are shuffled: texts as bytes, with ids of hexadecimal digits as what these stand for."""
    def pack(c: Column) -> Column:
        short = F.concat(F.lit(b"\x01"), F.substring(c, 1, 4).cast("binary"), F.unhex(F.substring(c, 5, 64)))
        return F.when(c.rlike(_ID), short).otherwise(F.concat(F.lit(b"\x00"), c.cast("binary")))

    return rows.select(*[pack(F.col(f.name)).alias(f.name) if isinstance(f.dataType, T.StringType) else F.col(f.name) for f in rows.schema])


def _unpacked(rows: DataFrame, schema: T.StructType, *more: str) -> DataFrame:
    def unpack(c: Column) -> Column:
        whole = F.concat(F.substring(c, 2, 4).cast("string"), F.lower(F.hex(F.substring(c, 6, 32))))
        return F.when(F.substring(c, 1, 1) == F.lit(b"\x01"), whole).otherwise(F.substring(c, 2, (1 << 31) - 1).cast("string"))

    return rows.select(*[unpack(F.col(f.name)).alias(f.name) if isinstance(f.dataType, T.StringType) else F.col(f.name) for f in schema], *more)


def _told(identity: list[str]) -> Column:
    """128 bits that tell identities apart."""
    one = lambda c: F.md5(F.to_json(F.struct(c.alias("x")), {"ignoreNullFields": "false"}))
    return F.unhex(F.md5(F.concat(*[one(F.col(c)) for c in identity])))


def contents(rows: DataFrame, columns: list[str], group: str, *more: Column) -> DataFrame:
    """``group``, ``n`` and ``digest``, which tells sets of rows apart whatever their order: the sums of two 60-bit
    pieces of the rows' SHA-256, so that partial sums do and no group is gathered."""
    row = F.sha2(F.to_json(F.struct(*columns), {"ignoreNullFields": "false"}), 256)
    pieces = [F.sum(F.conv(F.substring(row, at, 15), 16, 10).cast("decimal(38,0)")) for at in (1, 16)]
    return rows.groupBy(group).agg(F.count("*").alias("n"), F.concat_ws(":", F.count("*").cast("string"), *[p.cast("string") for p in pieces]).alias("digest"), *more)
