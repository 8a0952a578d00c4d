"""The three-level catalog: project, dataset, table. A table is a lazy DataFrame with the dialect's types beside it."""

from __future__ import annotations

import tempfile
import uuid
from dataclasses import dataclass
from typing import TYPE_CHECKING

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.operators.relational import typed_scan
from tessera.plans import nodes as n
from tessera.plans.scope import Bound
from tessera.types import Type, from_spark, to_spark

if TYPE_CHECKING:
    from tessera.operators.relational import Planner


@dataclass
class TableEntry:
    df: DataFrame
    fields: list[tuple[str, Type]]
    #: Rows that stand elsewhere, and the folder of those that were written here.
    base: DataFrame | None = None
    folder: str | None = None

    def __post_init__(self) -> None:
        if len(self.df.columns) != len(self.fields):
            raise ValueError(f"Trying to create a table with mismatching types; columns {self.df.columns!r} types {self.fields!r}")

    @property
    def types(self) -> list[Type]:
        return [t for _, t in self.fields]


@dataclass
class ViewEntry:
    query: n.Node


class Catalog:
    """``storage`` names a folder that all executors reach; written tables are Parquet there.

    Without one they go to the folder in ``spark.checkpoint.dir`` or, where that is unset and Spark runs in one process,
    to a temporary folder, and are deleted when the application ends. A table is data, never the plan of a query.
    """

    def __init__(self, spark: SparkSession, storage: str | None = None) -> None:
        self.spark, self.storage = spark, storage
        self.projects: dict[str, dict[str, dict[str, TableEntry | ViewEntry]]] = {}

    def resolve(self, path: tuple[str, ...]) -> tuple[str, str, str]:
        """The full path of a table that may lack its project, or project and dataset, if there is only one."""
        if not self.projects:
            raise ValueError(f"Attempt to look up path {path} with no projects/datasets/tables given.")
        if len(path) > 3:
            raise ValueError(f"Invalid path has more than three parts: {path}")
        full = tuple(path)
        if len(full) < 3:
            if len(self.projects) != 1:
                raise ValueError(f"Non-fully-qualified table {path} with multiple possible projects {sorted(self.projects)}")
            (project,) = self.projects
            if len(full) == 1:
                if len(self.projects[project]) != 1:
                    raise ValueError(f"Non-fully-qualified table {path} with multiple possible datasets {sorted(self.projects[project])}")
                full = (*self.projects[project], *full)
            full = (project, *full)
        return full  # type: ignore[return-value]

    def lookup(self, path: tuple[str, ...]) -> TableEntry | ViewEntry:
        project, dataset, table = self.resolve(path)
        try:
            return self.projects[project][dataset][table]
        except KeyError:
            raise KeyError(f"Cannot resolve table `{'.'.join(path)}`") from None

    def exists(self, path: tuple[str, ...]) -> bool:
        try:
            self.lookup(path)
        except KeyError:
            return False
        return True

    def scan(self, path: tuple[str, ...], planner: Planner) -> Bound:
        entry = self.lookup(path)
        if isinstance(entry, ViewEntry):
            full = self.resolve(path)
            if full in planner.open_views:
                raise ValueError(f"View {'.'.join(full)} reads itself")
            planner.open_views.append(full)
            try:
                return planner.query(entry.query).renewed()
            finally:
                planner.open_views.pop()
        return typed_scan(entry.df, entry.fields)  # type: ignore[arg-type]

    def put(self, path: tuple[str, ...], entry: TableEntry | ViewEntry) -> None:
        """Sets a table by its full path; its dataset is made if need be, its project is not."""
        if len(path) != 3:
            raise ValueError(f"Tables are created by project.dataset.table, not {path}")
        project, dataset, table = path
        if project not in self.projects:
            raise ValueError(f"Attempting to create {path!r} but project {project!r} not created")
        self.projects[project].setdefault(dataset, {})[table] = entry

    def drop(self, path: tuple[str, ...]) -> None:
        project, dataset, table = self.resolve(path)
        del self.projects[project][dataset][table]

    def register(self, path: tuple[str, str, str], df: DataFrame) -> None:
        """Make a DataFrame, batch or streaming, known under a path; its project and dataset are made too."""
        self.projects.setdefault(path[0], {})
        self.put(path, TableEntry(df, [(f.name, from_spark(f.dataType)) for f in df.schema.fields], base=df))

    def empty(self, fields: list[tuple[str, Type]]) -> TableEntry:
        names = [f"s{i}" for i in range(len(fields))]
        schema = ", ".join(f"{name} {to_spark(t).simpleString()}" for name, (_, t) in zip(names, fields))
        return TableEntry(self.spark.createDataFrame([], schema) if fields else self.spark.range(0).select(), fields)

    def stored(self, df: DataFrame, fields: list[tuple[str, Type]]) -> TableEntry:
        """``df`` as a table of its own."""
        return self.appended(self.empty(fields), df)

    def appended(self, entry: TableEntry, df: DataFrame) -> TableEntry:
        """``entry`` followed by ``df``, column by column in order; only the new rows are written.

        What was read from the table before keeps the rows that it had.
        """
        if not entry.fields:
            return entry
        new = df.toDF(*[f"s{i}" for i in range(len(entry.fields))])
        new = new.select(*[F.col(c).cast(to_spark(t)).alias(c) for c, (_, t) in zip(new.columns, entry.fields)])
        folder = entry.folder or f"{self._folder()}/{uuid.uuid4().hex}"
        new.write.mode("append").parquet(folder)
        rows = self.spark.read.schema(new.schema).parquet(folder)
        return TableEntry(rows if entry.base is None else entry.base.toDF(*new.columns).union(rows), entry.fields, entry.base, folder)

    def _folder(self) -> str:
        if not self.storage:
            context = self.spark.sparkContext
            self.storage = context.getConf().get("spark.checkpoint.dir", None)
            if not self.storage:
                if not context.master.startswith("local") or context.master.startswith("local-cluster"):
                    raise ValueError("give the client a storage folder that all executors reach, or set spark.checkpoint.dir")
                self.storage = "file://" + tempfile.gettempdir()
            self.storage = f"{self.storage}/tables-{uuid.uuid4().hex}"
            where = self.spark._jvm.org.apache.hadoop.fs.Path(self.storage)
            where.getFileSystem(self.spark._jsc.hadoopConfiguration()).deleteOnExit(where)
        return self.storage
