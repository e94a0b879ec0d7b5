"""Idempotent growth of a ledger: files known by content, rows known by key, versions that can be gone back to."""

from __future__ import annotations

import os
import uuid
from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.keys import with_row_keys

VERSIONS_KEPT = 30
#: Folders of a ledger that are put together into one when there are more.
MOST_FOLDERS = 200
#: Keys of a batch that are broadcast, some ten megabytes.
BROADCAST_KEYS = 100_000
BUCKET, ROWS = "__bucket", "__rows"


class MixedAccountsError(ValueError):
    """A ledger of one account would get rows of another."""


def new_files(files: DataFrame, registry: DataFrame) -> DataFrame:
    """Files whose (source_id, content_hash) the registry does not have."""
    return files.join(registry.select("source_id", "content_hash"), ["source_id", "content_hash"], "left_anti")


def mark_processed(registry: DataFrame, files: DataFrame) -> DataFrame:
    """The registry with the files' lines in the place of older ones of the same key."""
    both = registry.withColumn("__n", F.lit(1)).unionByName(files.withColumn("__n", F.lit(0)), allowMissingColumns=True)
    w = Window.partitionBy("source_id", "content_hash").orderBy("__n", F.col("processed_at").desc())
    return both.withColumn("__k", F.row_number().over(w)).where("__k = 1").drop("__n", "__k")


def mixed_accounts(ledger: DataFrame, batch: DataFrame) -> DataFrame:
    """What stands against adding the batch: (account, source_file), accounts that the ledger does not hold, and sources without an account that it does not have."""
    name = lambda df: df.select(F.coalesce("account", F.lit("")).alias("account"), F.coalesce("source_file", F.lit("")).alias("source_file")).distinct()
    have, new = name(ledger), name(batch)
    others = new.where("account <> ''").join(have.select("account").distinct(), "account", "left_anti")
    unknown = new.where("account = ''").join(have.select("source_file").distinct(), "source_file", "left_anti").select("account", "source_file")
    return others.unionByName(unknown)


def append(ledger: DataFrame, batch: DataFrame, order: list[str]) -> DataFrame:
    """The ledger with those rows of the batch that it does not have, by row key; repeats within the batch are numbered."""
    keyed = with_row_keys(batch, order).drop("occurrence")
    fresh = keyed.join(ledger.select("row_key"), "row_key", "left_anti")
    return ledger.unionByName(fresh, allowMissingColumns=True)


def newest(items: DataFrame, n: int = VERSIONS_KEPT, time: str = "modified") -> DataFrame:
    """The n that changed last; of those that changed together the first by their other columns."""
    return items.orderBy(F.col(time).desc(), *[c for c in items.columns if c != time]).limit(n)


class VersionedTable:
    """A table of folders of rows; a version is a small file that lists them, so that adding rows writes these alone.

    Versions are numbered, and each number can be made once: of two writers at the
    same time one is second, reads what the first one made, and tries the next number. A
    version appears whole or not at all. Rows are replaced by marks: a folder of
    keys (`gone-`) hides the rows of these keys in the folders listed before it. With buckets,
    a folder's rows lie apart by the hash of `bucket_by`, and reads of a few accounts open these alone.
    Folders go when the last version that lists them does; a folder that no version
    lists may be another writer's and stays.
    """

    def __init__(self, spark: SparkSession, path: str, partition_by: tuple[str, ...] = (), buckets: int = 0, bucket_by: str = "account"):
        self.spark, self.path, self.partition_by, self.buckets, self.bucket_by = spark, path.rstrip("/"), partition_by, buckets, bucket_by
        self._path = spark._jvm.org.apache.hadoop.fs.Path
        self._fs = self._path(self.path).getFileSystem(spark._jsc.hadoopConfiguration())

    def versions(self) -> list[str]:
        if not self._fs.exists(self._path(self.path)):
            return []
        return sorted(n for s in self._fs.listStatus(self._path(self.path)) if (n := s.getPath().getName()).startswith("v-"))

    def folders(self, version: str | None = None) -> list[str]:
        """The folders of a version, the newest by default, the oldest rows first."""
        source = self._fs.open(self._path(f"{self.path}/{version or self.versions()[-1]}"))
        try:
            return bytes(source.readAllBytes()).decode().split()
        finally:
            source.close()

    def bucket(self, column: Column) -> Column:
        return F.pmod(F.xxhash64(column), F.lit(self.buckets)).cast("int")

    def read(self, version: str | None = None, buckets: list[int] | None = None) -> DataFrame:
        """The rows of a version that no mark hides; buckets: of these alone."""
        names = self.folders(version)
        # A folder's name is a partition column, so that one scan reads all and a row knows where it is from.
        df = self.spark.read.option("basePath", self.path).parquet(*[f"{self.path}/{n}" for n in names if not n.startswith("gone-")])
        if buckets is not None and self.buckets:
            df = df.where(F.col(BUCKET).isin(buckets))
        marks = [(k, n) for k, n in enumerate(names) if n.startswith("gone-")]
        place = F.create_map(*[F.lit(x) for k, n in enumerate(names) if not n.startswith("gone-") for x in (n.partition("=")[2], k)])
        df = df.withColumn("__place", F.element_at(place, F.col(ROWS)))
        for key in sorted({n.split("-")[1] for _, n in marks}):
            gone = reduce(DataFrame.unionByName, [self.spark.read.parquet(f"{self.path}/{n}").select(F.col(key).alias("__gone"), F.lit(k).alias("__until")) for k, n in marks if n.split("-")[1] == key])
            gone = gone.groupBy("__gone").agg(F.max("__until").alias("__until"))
            df = df.join(gone, df[key].eqNullSafe(gone["__gone"]) & (df["__place"] < gone["__until"]), "left_anti")
        return df.drop("__place", ROWS, BUCKET)

    def _write(self, df: DataFrame, name: str | None = None) -> str:
        name = f"{ROWS}=r{name or uuid.uuid4().hex}"
        path = f"{self.path}/{name}"
        if not self.buckets:
            df.write.partitionBy(*self.partition_by).parquet(path)
            return name
        df.withColumn(BUCKET, self.bucket(F.col(self.bucket_by))).repartition(BUCKET).write.partitionBy(BUCKET, *self.partition_by).parquet(path)
        if not any(s.isDirectory() for s in self._fs.listStatus(self._path(path))):  # no rows: the columns stay known
            df.limit(0).coalesce(1).write.partitionBy(*self.partition_by).parquet(f"{path}/{BUCKET}=0")
        return name

    def _only(self, name: str, listed: list[str]) -> bool:
        """Make the version of this name; false if there is one."""
        local = self._fs.getUri().getScheme() == "file"
        new = f"{self.path}/_new-{uuid.uuid4().hex}"
        out = self._fs.create(self._path(new))
        out.write(bytearray("\n".join(listed).encode()))
        out.close()
        at = self._path(new)
        try:
            if local:  # where a rename would take the place of what is there, a link does not
                plain = lambda p: self._path(p).toUri().getPath()
                os.link(plain(new), plain(f"{self.path}/{name}"))
                self._fs.delete(at, False)
            else:
                if self._fs.exists(self._path(f"{self.path}/{name}")):
                    raise FileExistsError(name)
                if not self._fs.rename(at, self._path(f"{self.path}/{name}")):
                    raise FileExistsError(name)
            return True
        except FileExistsError:
            self._fs.delete(at, False)
            return False

    def commit(self, make: Callable[[str | None], tuple[list[str], list[str]]], keep: int = VERSIONS_KEPT, again: bool = False) -> str:
        """A version after the newest one: make(version) gives (folders of it that stay, new folders).

        Where another writer was first, the next number is tried with what make says
        of the version that is newest then; again: the new folders depend on the version and are made anew.
        """
        new: list[str] | None = None
        while True:
            last = v[-1] if (v := self.versions()) else None
            if new is None or again:
                stay, new = make(last)
            else:
                stay = self.folders(last) if last else []
            name = f"v-{(int(last.split('-')[1]) if last else 0) + 1:012d}"
            if self._only(name, [*stay, *new]):
                self._forget(keep)
                return name
            if again:
                for n in new:
                    self._fs.delete(self._path(f"{self.path}/{n}"), True)

    def _forget(self, keep: int) -> None:
        """Old versions go, and the folders that only they listed."""
        every = self.versions()
        old, kept = every[:-keep], every[-keep:]
        if old:
            held = {n for v in kept for n in self.folders(v)}
            for v in old:
                try:
                    listed = self.folders(v)
                except Exception as e:  # another writer has been here
                    if "FileNotFound" not in str(e) and "does not exist" not in str(e):
                        raise
                    continue
                self._fs.delete(self._path(f"{self.path}/{v}"), False)
                for n in set(listed) - held:
                    self._fs.delete(self._path(f"{self.path}/{n}"), True)

    def save(self, df: DataFrame, keep: int = VERSIONS_KEPT) -> str:
        """A version of these rows alone."""
        return self.commit(lambda _: ([], [self._write(df)]), keep, again=True)

    def add(self, df: DataFrame, keep: int = VERSIONS_KEPT) -> str:
        """A version with these rows besides those there are."""
        return self.commit(lambda v: (self.folders(v) if v else [], [self._write(df)]), keep)

    def replace(self, df: DataFrame, key: str, gone: DataFrame | None = None, keep: int = VERSIONS_KEPT) -> str:
        """A version in which these rows stand for all that have a key of theirs (or of `gone`); nothing else is read or written."""
        keys = (df if gone is None else gone).select(key).distinct()

        def make(v: str | None) -> tuple[list[str], list[str]]:
            name = uuid.uuid4().hex
            keys.write.parquet(f"{self.path}/gone-{key}-{name}")
            return self.folders(v) if v else [], [f"gone-{key}-{name}", self._write(df, name)]

        return self.commit(make, keep)

    def compact(self, keep: int = VERSIONS_KEPT) -> str:
        """A version of the same rows in one folder, without marks; made anew if another writer was first."""
        return self.commit(lambda v: ([], [self._write(self.read(v))]), keep, again=True)


def replace_reviews(table: VersionedTable, new: DataFrame) -> str:
    """Review lines with those of the same source file replaced."""
    return table.replace(new, "source_file")


def _fresh(table: VersionedTable, keyed: DataFrame, version: str | None) -> DataFrame:
    """Rows of the batch that the version does not have.

    Equal keys are of one account, so with buckets only those of the batch's accounts are
    read; and the batch's keys go to the ledger, not the other way. While they are
    BROADCAST_KEYS at most they are broadcast, and the ledger has no exchange.
    """
    if version is None:
        return keyed
    touched = None
    if table.buckets:
        touched = [r[0] for r in keyed.select(table.bucket(F.col(table.bucket_by))).distinct().collect()]
    ledger = table.read(version, touched)
    keys = keyed.select("row_key")
    if keys.limit(BROADCAST_KEYS + 1).count() <= BROADCAST_KEYS:
        keys = F.broadcast(keys)
    have = ledger.select("row_key").join(keys, "row_key", "left_semi")
    return keyed.join(have, "row_key", "left_anti").select(*ledger.columns)


def ingest(table: VersionedTable, batch: DataFrame, order: list[str], one_account: bool = False) -> DataFrame:
    """Append a batch and save; the table as it is now. With one_account, rows of another account are refused whole.

    Two batches at once lose nothing and add nothing twice: the second one to commit
    compares its keys with what the first one added.
    """
    keyed = with_row_keys(batch, order).drop("occurrence")

    def make(version: str | None) -> tuple[list[str], list[str]]:
        if one_account and version and (bad := mixed_accounts(table.read(version), batch).limit(5).collect()):
            raise MixedAccountsError(f"refused: {', '.join(f'{r.account or '(unknown)'} in {r.source_file}' for r in bad)}")
        return table.folders(version) if version else [], [table._write(_fresh(table, keyed, version))]

    table.commit(make, again=True)
    if len(table.folders()) > MOST_FOLDERS:
        table.compact()
    return table.read()
