"""Tables: stored snapshots of the warehouse, and DataFrames registered from outside."""

from __future__ import annotations

import json
import uuid
from collections.abc import Callable, Iterable
from dataclasses import dataclass, field, replace

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from corvane.errors import AnalysisError, ConflictError
from corvane.sources.files import Files
from corvane.types import TYPES, kind_of, spark_type

# Fixed value: the longest column name.
NAME_LENGTH = 16
#: So many files of less than so many bytes are rewritten as one run of sorted files.
SMALL_FILES, SMALL_BYTES = 16, 16 << 20


@dataclass
class Table:
    """A table's columns with their types, and its rows.

    ``files`` gives the smallest and the largest key of every file of a stored
    table; ``opened`` makes rows of some of the files.
    """

    name: str
    kinds: dict[str, str]
    df: DataFrame
    indexed: set[str] = field(default_factory=set)
    stored: bool = False
    files: dict[str, tuple] = field(default_factory=dict)
    version: int = 0
    opened: Callable[[list[str]], DataFrame] | None = None

    @property
    def key(self) -> str:
        return next(iter(self.kinds))

    def between(self, low, high) -> Table:
        """The table without files that hold no key from ``low`` to ``high`` (both included, None for open)."""
        order = lambda x: x.encode() if isinstance(x, str) else x
        held = [
            f
            for f, (a, b) in self.files.items()
            if (high is None or order(a) <= order(high)) and (low is None or order(low) <= order(b))
        ]
        if len(held) == len(self.files):
            return self
        return replace(self, df=self.opened(held), files={f: self.files[f] for f in held})


class Catalog:
    """The tables of one warehouse folder.

    A stored table is a list of Parquet files, written sorted by its key (the
    first column); its manifest gives each file's range of keys, so that key
    lookups open only files that can hold the key, and skip row groups in them.
    A statement writes its new files first and then the next version of the
    table's manifest, which is the moment it takes effect; if another session
    was faster, there is such a version already and the statement fails. Files
    that no manifest names any more are deleted one version later, so that
    readers of the version before can finish.
    """

    def __init__(self, spark: SparkSession, warehouse: str):
        self.spark, self.warehouse = spark, warehouse.rstrip("/")
        self._files = Files(spark)
        self._outside: dict[str, Table] = {}
        self._manifests = f"{self.warehouse}/_tables"

    def _version(self, name: str) -> int:
        """The number of the newest version of a table's manifest, 0 if there is none."""
        found = (n.removesuffix(".json") for n in self._files.names(f"{self._manifests}/{name}"))
        return max((int(n) for n in found if n.isdigit()), default=0)

    def _entry(self, name: str, version: int) -> dict:
        return json.loads(self._files.read(f"{self._manifests}/{name}/{version}.json"))

    def register(self, name: str, df: DataFrame) -> None:
        """Makes ``df`` readable as a table; statements cannot change it."""
        if self._version(name):
            raise AnalysisError(f"VALIDATOR ERROR: table {name} already exists")
        self._outside[name] = Table(name, {f.name: kind_of(f.dataType) for f in df.schema}, df)

    def names(self) -> list[str]:
        return [*sorted(self._files.names(self._manifests)), *self._outside]

    def table(self, name: str) -> Table:
        """The table as it is now; its rows stay those of this moment."""
        if name in self._outside:
            return self._outside[name]
        version = self._version(name) if name.isidentifier() else 0
        if not version:
            raise AnalysisError(f"VALIDATOR ERROR: table {name} does not exist")
        entry = self._entry(name, version)
        kinds = dict(entry["columns"])
        files = {f: tuple(keys) for f, keys in entry["files"].items()}
        opened = lambda some: self.read(kinds, some)
        return Table(name, kinds, opened(list(files)), set(entry["indexed"]), True, files, version, opened)

    def stored(self, name: str) -> Table:
        table = self.table(name)
        if not table.stored:
            raise AnalysisError(f"VALIDATOR ERROR: table {name} cannot be changed")
        return table

    def read(self, kinds: dict[str, str], files: list[str]) -> DataFrame:
        schema = T.StructType([T.StructField(c, spark_type(k)) for c, k in kinds.items()])
        return self.spark.read.schema(schema).parquet(*files) if files else self.spark.createDataFrame([], schema)

    def create(self, name: str, columns: Iterable[tuple[str, str]]) -> None:
        columns = list(columns)
        names = [c for c, _ in columns]
        bad = next((c for c in names if not c or len(c) > NAME_LENGTH), None)
        if name in self.names():
            raise AnalysisError(f"VALIDATOR ERROR: table {name} already exists")
        if len(name) < 2:
            raise AnalysisError("VALIDATOR ERROR: a table name has at least two characters")
        if not columns:
            raise AnalysisError("VALIDATOR ERROR: a table has at least one column")
        if bad is not None:
            raise AnalysisError(f"VALIDATOR ERROR: column name {bad!r} is empty or longer than {NAME_LENGTH}")
        if len(set(names)) < len(names):
            raise AnalysisError("VALIDATOR ERROR: duplicate column names")
        unknown = next((k for _, k in columns if k not in TYPES), None)
        if unknown:
            raise AnalysisError(f"VALIDATOR ERROR: unknown type {unknown}")
        if columns[0][1] in ("text", "bool"):
            raise AnalysisError(f"VALIDATOR ERROR: a key cannot be of type {columns[0][1]}")
        entry = {"columns": columns, "indexed": [names[0]], "files": {}, "gone": []}
        if not self._files.create(f"{self._manifests}/{name}/1.json", json.dumps(entry)):
            raise AnalysisError(f"VALIDATOR ERROR: table {name} already exists")

    def set_index(self, name: str, column: str) -> bool:
        """Indexes a column, that of the rows there are too: their files are written again; false if it was indexed already."""
        table = self.stored(name)
        if column not in table.kinds:
            raise AnalysisError(f"VALIDATOR ERROR: column {column} does not exist in table {name}")
        if table.kinds[column] in ("text", "bool"):
            raise AnalysisError(f"VALIDATOR ERROR: a column of type {table.kinds[column]} cannot be indexed")
        if column in table.indexed:
            return False
        indexed = replace(table, indexed=table.indexed | {column})
        self.commit(indexed, self.write(indexed, table.df) if table.files else {})
        return True

    def write(self, table: Table, rows: DataFrame, *, sort: bool = True) -> dict[str, tuple]:
        """Writes ``rows`` as new files of the table, which no version names yet, and gives their ranges of keys.

        Large results are ranged by key and sorted, so point and range lookups
        skip files and row groups. Indexed columns get a Bloom filter in row
        groups whose dictionary does not hold all values; where it does, the
        reader looks there.
        """
        path = f"{self.warehouse}/{table.name}/{uuid.uuid4().hex}"
        rows = rows.select(*(F.col(f"`{c}`").cast(spark_type(k)) for c, k in table.kinds.items()))
        key = f"`{table.key}`"
        if sort:
            rows = rows.repartitionByRange(F.col(key)).sortWithinPartitions(key)
        writer = rows.write.option("compression", "zstd")
        for c in table.indexed - {table.key}:
            writer = writer.option(f"parquet.bloom.filter.enabled#{c}", "true")
        writer.parquet(path)
        written = self.spark.read.schema(rows.schema).parquet(path)
        ranges = written.groupBy(F.col("_metadata.file_path").alias("f")).agg(F.min(key).alias("a"), F.max(key).alias("b"))
        return {r["f"]: (r["a"], r["b"]) for r in ranges.collect()}  # one row for each file; files without rows are left

    def commit(self, table: Table, files: dict[str, tuple]) -> None:
        """Makes ``files`` the table's rows from now on, unless it was changed since ``table`` was read."""
        before = self._entry(table.name, table.version)
        gone = [f for f in table.files if f not in files]
        entry = {"columns": list(table.kinds.items()), "indexed": sorted(table.indexed), "files": files, "gone": gone}
        folder = f"{self._manifests}/{table.name}"
        if not self._files.create(f"{folder}/{table.version + 1}.json", json.dumps(entry)):
            for f in files:
                if f not in table.files:
                    self._files.delete(f)
            raise ConflictError(f"table {table.name} was changed by another session")
        for f in before["gone"]:
            self._files.delete(f)
        if table.version > 1:
            self._files.delete(f"{folder}/{table.version - 1}.json")

    def compact(self, name: str) -> None:
        """Writes a table's small files again as sorted ones, if there are many; their rows stay the same."""
        table = self.stored(name)
        if len(table.files) < SMALL_FILES:
            return
        small = [f for f in table.files if self._files.size(f) < SMALL_BYTES]
        if len(small) >= SMALL_FILES:
            kept = {f: keys for f, keys in table.files.items() if f not in set(small)}
            self.commit(table, kept | self.write(table, table.opened(small)))
