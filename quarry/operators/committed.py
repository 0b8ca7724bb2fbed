"""Tables that commit together, in Parquet files of hash buckets.

A row lies in the bucket of its document. A version is a manifest that says for each bucket of each
table which folder holds it; a commit writes the buckets that it touches to a new folder, and then
puts the next manifest in its place by a rename that fails if another was faster. Readers see whole
versions only; a writer that dies leaves nothing but files that no manifest names. What is read
back by document ids comes from their buckets alone, and of these from the row groups whose Bloom
filters know the ids.

Which rows a change takes away is found by keys alone. Whole rows travel once, when they are dealt out to
the files of their buckets, and meet the keys that go there. A hot document makes a large bucket, but no
large task: a bucket has a part for every ``PART`` bytes. Manifests grow with buckets, not with rows.
"""

from __future__ import annotations

import functools
import json
import uuid
from dataclasses import asdict, dataclass, field
from urllib.parse import unquote

from py4j.protocol import Py4JJavaError
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from quarry.operators.store import Identity, IncompatibleStore, checked, latest, once
from quarry.session import stored

#: Attempts of a commit that others overtake, and versions that stay readable.
ATTEMPTS, KEPT = 3, 2
#: Bytes of a part of a bucket, as they lie in files, and the codec of what is kept.
PART, CODEC = 32 << 20, "zstd"


@dataclass(frozen=True)
class Table:
    """``key`` names a row; ``document`` says where it lies, and all rows of one go together. A key
    belongs to one document."""

    schema: str
    key: str
    document: str


@dataclass(frozen=True)
class Change:
    """What a commit does to a table, in this order: rows of ``removed`` documents go, ``upserts``
    come in place of the rows with their keys, and of the documents in ``expected`` (document, key)
    the rows that it does not name go. ``order``: the column that decides between rows of one key."""

    upserts: DataFrame | None = None
    removed: DataFrame | None = None
    expected: DataFrame | None = None
    order: str | None = None


@dataclass(frozen=True)
class Manifest:
    version: int
    buckets: int
    identity: str
    #: The last batch of each stream that has been committed.
    streams: dict[str, int] = field(default_factory=dict)
    #: The folder of each bucket of each table.
    tables: dict[str, dict[str, str]] = field(default_factory=dict)


class Overtaken(Exception):
    """Another writer has committed this version."""


class Folders:
    """The few calls to the file system that a commit needs."""

    def __init__(self, spark: SparkSession, path: str):
        self.jvm, self.conf = spark._jvm, spark._jsc.hadoopConfiguration()
        self.fs = self.path(path).getFileSystem(self.conf)

    def path(self, name: str):
        return self.jvm.org.apache.hadoop.fs.Path(name)

    def names(self, folder: str) -> list[str]:
        at = self.path(folder)
        return [s.getPath().getName() for s in self.fs.listStatus(at)] if self.fs.exists(at) else []

    def modified(self, name: str) -> int:
        return self.fs.getFileStatus(self.path(name)).getModificationTime()

    def read(self, name: str) -> str:
        stream = self.fs.open(self.path(name))
        try:
            return self.jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")
        finally:
            stream.close()

    def put(self, name: str, text: str) -> None:
        """A whole file under a new name, or ``Overtaken``."""
        draft = f"{name}.{uuid.uuid4().hex}.draft"
        out = self.fs.create(self.path(draft), False)
        out.write(bytearray(text.encode()))
        out.close()
        kind = getattr(self.jvm.org.apache.hadoop.fs, "Options$Rename")
        options = self.jvm.java.lang.reflect.Array.newInstance(kind.NONE.getClass(), 1)
        options[0] = kind.NONE
        target = self.path(name)
        try:
            self.jvm.org.apache.hadoop.fs.FileContext.getFileContext(self.fs.getUri(), self.conf).rename(self.path(draft), self.fs.makeQualified(target), options)
        except Py4JJavaError as error:
            self.fs.delete(self.path(draft), False)
            if "FileAlreadyExists" in str(error.java_exception.getClass().getName()):
                raise Overtaken(name) from error
            raise

    def size(self, name: str) -> int:
        at = self.path(name)
        return at.getFileSystem(self.conf).getContentSummary(at).getLength()

    def drop(self, name: str) -> None:
        self.fs.delete(self.path(name), True)


def gone(old: DataFrame, change: Change, table: Table) -> DataFrame:
    """(document, key, new_): the keys of old and of new rows that a change takes away. Rows of one document and key
    share their fate."""
    document, key = table.document, table.key
    both = list(dict.fromkeys([document, key]))
    keys = old.select(*both, F.lit(False).alias("new_"))
    goes = F.lit(False)
    if change.upserts is not None:
        own = change.upserts.select(*both)
        keys = keys.unionByName(own.withColumn("new_", F.lit(True))).join(own.withColumn("given_", F.lit(True)), both, "left")
        goes = goes | (~F.col("new_") & F.col("given_").isNotNull())
    if change.expected is not None:
        named = change.expected.select(*both).filter(F.col(key).isNotNull()).distinct().withColumn("named_", F.lit(True))
        listed = change.expected.select(document).distinct().withColumn("listed_", F.lit(True))
        keys = keys.join(named, both, "left").join(listed, document, "left")
        goes = goes | (F.col("listed_").isNotNull() & F.col("named_").isNull())
    if change.removed is not None:
        keys = keys.join(change.removed.select(document).distinct().withColumn("removed_", F.lit(True)), document, "left")
        goes = goes | (~F.col("new_") & F.col("removed_").isNotNull())
    return keys.filter(goes).select(*both, "new_").distinct()


class Store:
    """Tables below a folder; ``identity`` must be that of the store, ``buckets`` holds when it is made."""

    def __init__(self, spark: SparkSession, path: str, identity: Identity, tables: dict[str, Table], buckets: int = 64):
        self.spark, self.path, self.identity, self.tables, self.buckets = spark, path.rstrip("/"), identity, tables, buckets
        self.folders = Folders(spark, self.path)

    # -- versions
    def versions(self) -> list[int]:
        return sorted(int(n[1:-5]) for n in self.folders.names(f"{self.path}/manifests") if n.startswith("v") and n.endswith(".json"))

    def manifest(self, version: int | None = None) -> Manifest:
        """A version, the last one if none is named; an empty one before the first commit."""
        known = self.versions()
        if not known:
            return Manifest(0, self.buckets, self.identity.descriptor())
        at = known[-1] if version is None else version
        found = Manifest(**json.loads(self.folders.read(f"{self.path}/manifests/v{at:012d}.json")))
        if found.identity != self.identity.descriptor():
            raise IncompatibleStore(f"{found.identity} is not {self.identity.descriptor()}")
        return found

    # -- reading
    def bucket(self, document: Column | str, buckets: int) -> Column:
        return F.pmod(F.xxhash64((F.col(document) if isinstance(document, str) else document).cast("string")), F.lit(buckets)).cast("int")

    def _files(self, table: str, folders: dict[str, str]) -> DataFrame:
        schema = self.tables[table].schema
        paths = [f"{self.path}/{folder}/bucket={b}" for b, folder in sorted(folders.items())]
        return self.spark.read.schema(schema).parquet(*paths) if paths else self.spark.createDataFrame([], schema)

    def read(self, table: str, documents: list | None = None, version: int | None = None) -> DataFrame:
        """The rows of a table, or those of some documents, from their buckets alone."""
        found = self.manifest(version)
        folders, document = found.tables.get(table, {}), self.tables[table].document
        if documents is None:
            return self._files(table, folders)
        rows = self.spark.createDataFrame([(str(d),) for d in documents], "d string").select(self.bucket("d", found.buckets).alias("b")).distinct().collect()
        wanted = {str(r["b"]) for r in rows}
        return self._files(table, {b: f for b, f in folders.items() if b in wanted}).filter(F.col(document).isin(documents))

    # -- writing
    def _prepared(self, table: str, change: Change) -> Change:
        """A change with its upserts checked and stored: they are read more than once, and a commit that
        is tried again works nothing out again."""
        own, upserts = self.tables[table], change.upserts
        if upserts is not None:
            columns = self.spark.createDataFrame([], own.schema).columns
            extra = [change.order] if change.order and change.order not in columns else []
            upserts = upserts.select(*columns, *extra)
            if change.order:
                upserts = latest(upserts, own.key, change.order).select(*columns)
            upserts = stored(checked(upserts, self.identity.dimensions) if "embedding" in columns else upserts, "upserts", CODEC)
            upserts = upserts if change.order else once(upserts, own.key)
        return Change(upserts, change.removed, change.expected)

    def _buckets(self, rows: DataFrame, document: str, buckets: int) -> set[str]:
        """As many numbers as there are buckets, at most."""
        return {str(r["b"]) for r in rows.select(self.bucket(document, buckets).alias("b")).distinct().collect()}

    def _dealt(self, rows: DataFrame, going: DataFrame, own: Table, buckets: int, parts: int) -> DataFrame:
        """``rows`` but those that go, in parts of their buckets: the one shuffle of whole rows. The keys that go are
        dealt out alike and stand before the rows that they take away."""
        columns = [c for c in rows.columns if c != "new_"]
        marked = rows.withColumn("goes_", F.lit(False))
        if any_goes := not going.isEmpty():
            marked = marked.unionByName(going.withColumn("goes_", F.lit(True)), allowMissingColumns=True)
        part = F.pmod(F.xxhash64(own.document, own.key, F.lit(1)), F.lit(parts)).cast("int")
        dealt = marked.withColumn("bucket", self.bucket(own.document, buckets)).withColumn("part_", part).repartition("bucket", "part_")
        order = list(dict.fromkeys(["bucket", "part_", own.document, own.key]))
        if any_goes:
            same = Window.partitionBy(*order, "new_")
            dealt = dealt.withColumn("taken_", F.max("goes_").over(same)).filter("NOT taken_")
        return dealt.sortWithinPartitions(*order).select(*columns, "bucket")

    def _rewritten(self, table: str, change: Change, folders: dict[str, str], buckets: int, folder: str) -> dict[str, str]:
        """The folders of a table's buckets after a change; only the touched ones are read and written."""
        own = self.tables[table]
        given = [x.select(F.col(own.document).alias("d")) for x in (change.upserts, change.removed, change.expected) if x is not None]
        documents = functools.reduce(DataFrame.unionByName, given)
        named = self._buckets(documents, "d", buckets)
        old = self._files(table, {b: f for b, f in folders.items() if b in named})
        going = stored(gone(old, change, own), "gone")
        changing = [going.select(own.document)] + ([change.upserts.select(own.document)] if change.upserts is not None else [])
        touched = self._buckets(functools.reduce(DataFrame.unionByName, changing), own.document, buckets)
        if not touched:
            return folders
        kept = {b: f for b, f in folders.items() if b in touched}
        rows = self._files(table, kept).withColumn("new_", F.lit(False))
        size = sum(self.folders.size(f"{self.path}/{f}/bucket={b}") for b, f in kept.items())
        if change.upserts is not None:
            rows = rows.unionByName(change.upserts.withColumn("new_", F.lit(True)))
            size += sum(self.folders.size(f) for f in {unquote(f).rsplit("/", 1)[0] for f in change.upserts.inputFiles()})
        parts = max(1, -(-size // (PART * len(touched))))
        dealt = self._dealt(rows, going, own, buckets, parts)
        dealt.write.partitionBy("bucket").option("compression", CODEC).option(f"parquet.bloom.filter.enabled#{own.document}", "true").option("parquet.bloom.filter.adaptive.enabled", "true").parquet(f"{self.path}/{folder}/{table}")
        written = [n.removeprefix("bucket=") for n in self.folders.names(f"{self.path}/{folder}/{table}") if n.startswith("bucket=")]
        return {b: f for b, f in folders.items() if b not in touched} | {b: f"{folder}/{table}" for b in written}

    def commit(self, changes: dict[str, Change], stream: str | None = None, batch: int = 0) -> int:
        """Changes of several tables as one version. A batch of a stream that is already in the
        store changes nothing. Returns the version that holds the changes."""
        def done(at: Manifest) -> bool:
            return stream is not None and at.streams.get(stream, -1) >= batch

        if done(base := self.manifest()):
            return base.version
        ready = {t: self._prepared(t, c) for t, c in changes.items()}
        for attempt in range(ATTEMPTS):
            if done(base := self.manifest()):
                return base.version
            folder = f"data/{uuid.uuid4().hex}"
            tables = base.tables | {t: self._rewritten(t, c, base.tables.get(t, {}), base.buckets, folder) for t, c in ready.items()}
            streams = base.streams | ({stream: batch} if stream is not None else {})
            new = Manifest(base.version + 1, base.buckets, self.identity.descriptor(), streams, tables)
            try:
                self.folders.put(f"{self.path}/manifests/v{new.version:012d}.json", json.dumps(asdict(new)))
                return new.version
            except Overtaken:
                self.folders.drop(f"{self.path}/{folder}")
                if attempt == ATTEMPTS - 1:
                    raise
        raise AssertionError("not reached")

    def collect(self, keep: int = KEPT, older_than_ms: int = 24 * 3600 * 1000) -> list[str]:
        """Drops all versions but the last ones, and the folders that none of these names, unless they
        are young: a writer may be at work on them. Returns the folders."""
        known = self.versions()
        for version in known[:-keep]:
            self.folders.drop(f"{self.path}/manifests/v{version:012d}.json")
        used = {f.split("/")[1] for v in known[-keep:] for t in self.manifest(v).tables.values() for f in t.values()}
        now = self.spark._jvm.java.lang.System.currentTimeMillis()
        gone = [n for n in self.folders.names(f"{self.path}/data") if n not in used and now - self.folders.modified(f"{self.path}/data/{n}") >= older_than_ms]
        for name in gone:
            self.folders.drop(f"{self.path}/data/{name}")
        return gone


# -- migration ----------------------------------------------------------------------------
def digests(chunks: DataFrame, document: str = "document_id") -> DataFrame:
    """(document, digest, chunks): the same for the same rows in any order."""
    own = F.xxhash64(*sorted(chunks.columns)).cast("decimal(20,0)")
    return chunks.groupBy(document).agg(F.sum(own).alias("digest"), F.count("*").alias("chunks"))


def migrated(source: Store, target: Store, metadata: Store, provider: str, store_from: str, store_to: str) -> dict[str, int]:
    """Copies the chunks of active, indexed documents of one store to another and repoints their
    records. Documents of another provider, or without chunks, stay where they are; chunks that the
    target already has are not written again, so that a run after one that broke off goes on
    where it ended. Returns the counters."""
    records = metadata.read("documents").filter("is_active AND is_indexed")
    bound = records.filter(F.col("store") == store_from)
    fit = bound.filter(F.col("provider") == provider).select(F.col("id").alias("document_id"))
    chunks = source.read("chunks")
    there = digests(chunks).join(fit, "document_id", "left_semi")
    held = digests(target.read("chunks")).select("document_id", F.col("digest").alias("held_"))
    found = stored(fit.join(there, "document_id", "left").join(held, "document_id", "left"), "migration")
    counts = found.agg(F.count("*").alias("fit"), F.count("chunks").alias("documents"), F.coalesce(F.sum("chunks"), F.lit(0)).alias("chunks"), F.count_if(F.col("digest").eqNullSafe(F.col("held_")) & F.col("digest").isNotNull()).alias("copied_before")).first()
    candidates = bound.count()
    already = records.filter(F.col("store") == store_to).count()
    missing = found.filter("digest IS NOT NULL AND NOT (digest <=> held_)").select("document_id")
    if not missing.isEmpty():
        rows = chunks.join(missing, "document_id", "left_semi")
        target.commit({"chunks": Change(upserts=rows, expected=rows.select("document_id", "id"))})
    if counts["documents"]:
        moved = found.filter("digest IS NOT NULL").select(F.col("document_id").alias("id"))
        metadata.commit({"documents": Change(upserts=bound.join(moved, "id", "left_semi").withColumn("store", F.lit(store_to)))})
    return {
        "candidates": candidates, "already_done": already, "documents": counts["documents"], "chunks": counts["chunks"], "empty": counts["fit"] - counts["documents"],
        "incompatible": candidates - counts["fit"], "copied_before": counts["copied_before"],
    }
