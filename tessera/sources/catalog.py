"""Versioned tables: parquet folders and a manifest that says which of them a table consists of.

A statement writes new folders and then one new manifest; the manifest is created under the next number and
never overwritten, so that a commit is atomic and a second writer fails instead of losing rows. Appends add
a folder; updates and deletes write those folders anew that have a row to change, and only constraints on
changed columns are checked again. Inside a transaction only the staged manifest changes. Folders that no
manifest needs any more are removed by ``vacuum``.
All access goes through Spark's file systems, so that the base path may be in any store that Spark reads.
"""

from __future__ import annotations

import copy
import json
import uuid
from typing import NamedTuple

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType, _parse_datatype_string

from ..functions.tagged import PROPS

#: Tables that every catalog has: two of the graph and one of vectors that no SQL table holds.
BUILTIN = {
    "__nodes": f"id bigint, label string, props {PROPS}",
    "__edges": f"id bigint, type string, src bigint, dst bigint, props {PROPS}",
    "__vectors": f"target string, namespace string, target_id bigint, embedding array<float>, metadata {PROPS}",
}


class Files:
    """The few file operations that the manifest needs, on any of Hadoop's file systems."""

    def __init__(self, spark: SparkSession, base: str):
        self.jvm = spark._jvm
        self.base = self.jvm.org.apache.hadoop.fs.Path(base)
        self.fs = self.base.getFileSystem(spark._jsc.hadoopConfiguration())

    def _path(self, name: str):
        return self.jvm.org.apache.hadoop.fs.Path(self.base, name)

    def names(self, folder: str) -> list[str]:
        path = self._path(folder)
        return sorted(s.getPath().getName() for s in self.fs.listStatus(path)) if self.fs.exists(path) else []

    def read(self, name: str) -> str:
        stream = self.fs.open(self._path(name))
        try:
            return self.jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")
        finally:
            stream.close()

    def delete(self, name: str) -> bool:
        """Remove a file or a folder with all that is in it."""
        return self.fs.delete(self._path(name), True)

    def create(self, name: str, text: str) -> None:
        """Write a new file; fails if there is one."""
        stream = self.fs.create(self._path(name), False)
        try:
            stream.write(bytearray(text.encode()))
        finally:
            stream.close()


class Staged(NamedTuple):
    """Rows that are written but belong to no version yet."""

    path: str
    frame: DataFrame


class Measured(NamedTuple):
    """Of new rows: their number, the largest key, and the nulls of columns that need a value."""

    count: int
    most: object
    nulls: dict[str, int]


class Catalog:
    def __init__(self, spark: SparkSession, base: str):
        self.spark, self.base = spark, base.rstrip("/")
        self.files = Files(spark, self.base)
        self.staged: dict | None = None
        found = [n for n in self.files.names("manifest") if n.endswith(".json")]
        if found:
            self.committed = json.loads(self.files.read("manifest/" + found[-1]))
        else:
            schema = lambda ddl: json.loads(_parse_datatype_string(ddl).json())
            self.committed = {"version": 0, "tables": {k: self._new(schema(ddl)) for k, ddl in BUILTIN.items()}, "sequences": {}, "indexes": {}, "types": {}}

    @staticmethod
    def _new(schema: dict, **more) -> dict:
        return {"schema": schema, "paths": [], "rows": {}, "key": None, "not_null": [], "unique": []} | more

    @property
    def state(self) -> dict:
        return self.staged if self.staged is not None else self.committed

    @property
    def in_transaction(self) -> bool:
        return self.staged is not None

    def begin(self) -> None:
        if self.in_transaction:
            raise RuntimeError("a transaction is already active")
        self.staged = copy.deepcopy(self.committed)

    def commit(self) -> None:
        if not self.in_transaction:
            raise RuntimeError("no transaction is active")
        self.staged["version"] += 1
        self.files.create(f"manifest/{self.staged['version']:012d}.json", json.dumps(self.staged))
        self.committed, self.staged = self.staged, None

    def rollback(self) -> None:
        if not self.in_transaction:
            raise RuntimeError("no transaction is active")
        self.staged = None

    def atomically(self, change):
        """Run ``change()`` in a transaction of its own, or as part of the active one; a failure leaves nothing behind."""
        if self.in_transaction:
            saved = copy.deepcopy(self.staged)
            try:
                return change()
            except BaseException:
                self.staged = saved
                raise
        self.begin()
        try:
            out = change()
        except BaseException:
            self.rollback()
            raise
        self.commit()
        return out

    def names(self) -> list[str]:
        return [n for n in self.state["tables"] if not n.startswith("__")]

    def entry(self, table: str) -> dict:
        for name, found in self.state["tables"].items():
            if name.lower() == table.lower():
                return found
        raise ValueError(f"no table {table!r}")

    def schema(self, table: str) -> StructType:
        return StructType.fromJson(self.entry(table)["schema"])

    def create(self, table: str, schema: StructType, key: str | None = None, not_null: tuple[str, ...] = (), unique: tuple[tuple[str, ...], ...] = ()) -> None:
        if any(n.lower() == table.lower() for n in self.state["tables"]):
            raise ValueError(f"table {table!r} already exists")
        self.state["tables"][table] = self._new(json.loads(schema.json()), key=key, not_null=list(not_null), unique=[list(u) for u in unique])

    def frame(self, table: str, paths: list[str] | None = None) -> DataFrame:
        """The table, or those of its folders."""
        entry = self.entry(table)
        schema = StructType.fromJson(entry["schema"])
        chosen = entry["paths"] if paths is None else paths
        if not chosen:
            return self.spark.createDataFrame([], schema)
        return self.spark.read.schema(schema).parquet(*(f"{self.base}/{p}" for p in chosen))

    def located(self, table: str, paths: list[str] | None = None) -> DataFrame:
        """The table with the folder of each row as ``__folder``."""
        rows = self.frame(table, paths)
        if not (self.entry(table)["paths"] if paths is None else paths):
            return rows.withColumn("__folder", F.lit(""))
        return rows.select("*", F.regexp_extract(F.col("_metadata.file_path"), r"([^/]+)/[^/]+$", 1).alias("__folder"))

    def folders(self, table: str, found: DataFrame) -> dict[str, int]:
        """Paths of the folders of the rows ``found`` (__folder), with the number of these rows. One job."""
        by = {r["__folder"]: r["n"] for r in found.groupBy("__folder").agg(F.count("*").alias("n")).collect()}
        return {p: by[name] for p in self.entry(table)["paths"] if (name := p.rpartition("/")[2]) in by}

    def _write(self, table: str, rows: DataFrame) -> str:
        schema = self.schema(table)
        path = f"data/{table}/{uuid.uuid4().hex}"
        rows.select(*(F.col(f"`{f.name}`").cast(f.dataType).alias(f.name) for f in schema.fields)).write.parquet(f"{self.base}/{path}")
        return path

    def stage(self, table: str, rows: DataFrame) -> Staged:
        """Rows of the table's schema, written once and read again, so that checks and the version see the same rows."""
        path = self._write(table, rows)
        return Staged(path, self.frame(table, [path]))

    def measure(self, table: str, new: DataFrame) -> Measured:
        """Number of rows, nulls of the columns that need a value, and the largest key, in one job."""
        entry = self.entry(table)
        needed = [*entry["not_null"], *([entry["key"]] if entry["key"] else [])]
        most = F.max(f"`{entry['key']}`") if entry["key"] else F.lit(None)
        row = new.agg(F.count("*").alias("n"), most.alias("most"), *(F.count_if(F.col(f"`{c}`").isNull()).alias(f"null_{i}") for i, c in enumerate(needed))).first()
        return Measured(row["n"], row["most"], {c: row[f"null_{i}"] for i, c in enumerate(needed)})

    def append(self, table: str, rows: DataFrame | Staged, measured: Measured | None = None) -> int:
        """Add rows after checking the table's constraints; returns their number. Staged rows aren't written again."""
        path, new = rows if isinstance(rows, Staged) else self.stage(table, rows)
        measured = measured or self.measure(table, new)
        self.check(table, new, measured, self.entry(table)["paths"])
        entry = self.entry(table)
        entry["paths"].append(path)
        entry.setdefault("rows", {})[path] = measured.count
        return measured.count

    def replace(self, table: str, rows: DataFrame, paths: list[str], many: int, columns: set[str] = frozenset()) -> None:
        """Put rows in place of the folders ``paths``; ``columns`` are those whose values changed, ``many`` is by how many rows the folders shrink."""
        entry = self.entry(table)
        path, new = self.stage(table, rows)
        others = [p for p in entry["paths"] if p not in paths]
        self.check(table, new, None, others, columns)
        counts = entry.setdefault("rows", {})
        total = sum(counts.pop(p, 0) for p in paths) - many
        entry["paths"] = [*others, path]
        counts[path] = max(0, total)

    def check(self, table: str, new: DataFrame, measured: Measured | None, others: list[str], columns: set[str] | None = None) -> None:
        """The table's constraints for new rows beside those of the folders ``others``; only those on ``columns``, where given."""
        entry = self.entry(table)
        concerned = lambda cols: columns is None or not columns.isdisjoint(cols)
        needed = [c for c in [*entry["not_null"], *([entry["key"]] if entry["key"] else [])] if concerned([c])]
        if needed and any((measured or self.measure(table, new)).nulls[c] for c in needed):
            raise ValueError(f"{table}: a column that must not be null is null ({', '.join(needed)})")
        for cols in [*([[entry["key"]]] if entry["key"] else []), *entry["unique"]]:
            if not concerned(cols):
                continue
            own = new.select(*cols).dropna()
            if own.groupBy(*cols).count().filter("count > 1").limit(1).count():
                raise ValueError(f"{table}: repeated value of unique {', '.join(cols)}")
            if others and own.join(self.frame(table, others).select(*cols), cols, "left_semi").limit(1).count():
                raise ValueError(f"{table}: a value of unique {', '.join(cols)} exists already")

    def vacuum(self, versions: int = 1) -> int:
        """Remove the folders that none of the last ``versions`` manifests names, and older manifests; returns how many folders went."""
        if self.in_transaction:
            raise RuntimeError("a transaction is active")
        names = [n for n in self.files.names("manifest") if n.endswith(".json")]
        states = [json.loads(self.files.read("manifest/" + n)) for n in names[-max(1, versions) :]] + [self.committed]
        used = {p for s in states for e in s["tables"].values() for p in e["paths"]}
        used |= {i["snapshot"] for s in states for i in s["indexes"].values() if i.get("snapshot")}
        gone = 0
        for top in ("data", "index"):
            for group in self.files.names(top):
                for name in self.files.names(f"{top}/{group}"):
                    if f"{top}/{group}/{name}" not in used:
                        gone += self.files.delete(f"{top}/{group}/{name}")
        for n in names[: -max(1, versions)]:
            self.files.delete("manifest/" + n)
        return gone

    def next_ids(self, sequence: str, many: int, at_least: int = 0) -> int:
        """Reserve ``many`` dense ids, never used before, and return the first."""
        first = max(self.state["sequences"].get(sequence, 1), at_least + 1)
        self.state["sequences"][sequence] = first + many
        return first

    def used_id(self, sequence: str, largest: int | None) -> None:
        if largest is not None:
            self.state["sequences"][sequence] = max(self.state["sequences"].get(sequence, 1), largest + 1)


def with_dense_ids(rows: DataFrame, column: str, first: int) -> DataFrame:
    """Number the rows from ``first`` without gaps, as they stand.

    Rows are counted by partition first (one number for each comes to the driver); a row's id is its
    partition's offset plus its place in it. ``rows`` must read the same each time, as file scans do.
    """
    marked = rows.withColumn("__at", F.monotonically_increasing_id())
    part = F.shiftright("__at", 33)
    counts = {r["p"]: r["n"] for r in marked.groupBy(part.alias("p")).agg(F.count("*").alias("n")).collect()}
    offsets, total = [], first
    for p in sorted(counts):
        offsets += [F.lit(p), F.lit(total)]
        total += counts[p]
    offset = F.element_at(F.create_map(*offsets), part) if offsets else F.lit(first)
    return marked.withColumn(column, (offset + F.col("__at") - F.shiftleft(part, 33)).cast("bigint")).drop("__at")
