"""Python data sources: the memory database by ranges of row ids, and logs that are appended to, by bytes.

Register them with register(spark); both read files that driver and executors
reach under one path.
"""

from __future__ import annotations

import io
import json
import os
import sqlite3
import uuid
from collections.abc import Iterator
from contextlib import closing
from dataclasses import dataclass

import pyarrow as pa
import pyarrow.fs
from pyspark import TaskContext
from pyspark.sql import SparkSession
from pyspark.sql.datasource import (
    DataSource, DataSourceReader, DataSourceStreamReader, EqualNullSafe, EqualTo, GreaterThan, GreaterThanOrEqual, In, InputPartition, IsNotNull, IsNull, LessThan, LessThanOrEqual, StringStartsWith,
)
from pyspark.sql.types import StructType

_TEXT = "TEXT"
_KINDS = {"INTEGER": "long", "INT": "long", "REAL": "double", "BLOB": "binary"}
_ARROW = {"long": pa.int64(), "double": pa.float64(), "binary": pa.binary(), "string": pa.string()}
_COMPARED = {EqualTo: "= ?", EqualNullSafe: "IS ?", GreaterThan: "> ?", GreaterThanOrEqual: ">= ?", LessThan: "< ?", LessThanOrEqual: "<= ?"}


def _local(path: str) -> str:
    return path.removeprefix("file://")


def _files(path: str) -> list[str]:
    """The database files of a path: itself, or those of a folder."""
    at = _local(path)
    return sorted(os.path.join(at, f) for f in os.listdir(at) if f.endswith(".db")) if os.path.isdir(at) else [at]


def _opened(file: str) -> closing:
    return closing(sqlite3.connect(f"file:{file}?mode=ro", uri=True))


def _quoted(name: str) -> str:
    return '"' + name.replace('"', '""') + '"'


@dataclass
class RowRange(InputPartition):
    file: str
    first: int
    last: int


class DatabaseReader(DataSourceReader):
    """Rows of one table; a task reads a range of row ids, under the filters that the database can apply."""

    def __init__(self, path: str, table: str, rows: int, kinds: dict[str, str]):
        self.path, self.table, self.rows, self.kinds = path, table, rows, kinds
        self.where: list[str] = []
        self.values: list = []

    def _column(self, name: tuple[str, ...]) -> str | None:
        return _quoted(name[0]) if len(name) == 1 and name[0] in self.kinds else None

    def pushFilters(self, filters) -> Iterator:
        for f in filters:
            column = self._column(getattr(f, "attribute", ()))
            if column is None:
                yield f
            elif type(f) in _COMPARED and isinstance(f.value, (int, float, str, bytes, type(None))):
                self.where.append(f"{column} {_COMPARED[type(f)]}")
                self.values.append(f.value)
            elif isinstance(f, In) and all(isinstance(v, (int, float, str)) for v in f.value):
                self.where.append(f"{column} IN ({', '.join('?' * len(f.value))})")
                self.values += f.value
            elif isinstance(f, (IsNull, IsNotNull)):
                self.where.append(f"{column} IS {'NOT ' * isinstance(f, IsNotNull)}NULL")
            elif isinstance(f, StringStartsWith):
                self.where.append(f"substr({column}, 1, ?) = ?")
                self.values += [len(f.value), f.value]
            else:
                yield f

    def partitions(self) -> list[RowRange]:
        out = []
        for file in _files(self.path):
            with _opened(file) as db:
                low, high = db.execute(f"SELECT min(rowid), max(rowid) FROM {_quoted(self.table)}").fetchone()
            if low is not None:
                out += [RowRange(file, at, min(at + self.rows - 1, high)) for at in range(low, high + 1, self.rows)]
        return out or [RowRange(_files(self.path)[0], 0, -1)]

    def read(self, part: RowRange) -> Iterator[pa.RecordBatch]:
        names = list(self.kinds)
        test = " AND ".join(["rowid BETWEEN ? AND ?", *self.where])
        with _opened(part.file) as db:
            found = db.execute(f"SELECT {', '.join(map(_quoted, names))} FROM {_quoted(self.table)} WHERE {test}", [part.first, part.last, *self.values])
            while rows := found.fetchmany(4096):
                yield pa.RecordBatch.from_arrays([pa.array(c, _ARROW[k]) for c, k in zip(zip(*rows), self.kinds.values())], names)


class DatabaseSource(DataSource):
    """Options: path (a file, or a folder of files with the same table), table (observations), rows (row ids a task reads). The schema is the table's."""

    @classmethod
    def name(cls) -> str:
        return "memory_database"

    def _kinds(self) -> dict[str, str]:
        files = _files(self.options["path"])
        if not files:
            raise ValueError(f"no database in {self.options['path']}")
        with _opened(files[0]) as db:
            told = db.execute(f"PRAGMA table_info({_quoted(self.options.get('table', 'observations'))})").fetchall()
        if not told:
            raise ValueError(f"no table {self.options.get('table', 'observations')!r} in {self.options['path']}")
        return {name: _KINDS.get(kind.upper(), "string") for _, name, kind, *_ in told}

    def schema(self) -> str:
        return ", ".join(f"`{n}` {k}" for n, k in self._kinds().items())

    def reader(self, schema: StructType) -> DatabaseReader:
        return DatabaseReader(self.options["path"], self.options.get("table", "observations"), int(self.options.get("rows", "100000")), self._kinds())


@dataclass
class ByteRange(InputPartition):
    path: str
    start: int
    end: int


class LogReader(DataSourceStreamReader):
    """Lines of files that are only appended to. An offset is the bytes read of each file, up to the end of a line: a torn last line is simply not there yet."""

    def __init__(self, path: str, size: int):
        self.path, self.size = path, size

    def _files(self) -> dict[str, int]:
        store, root = pa.fs.FileSystem.from_uri(self.path if "://" in self.path else f"file://{self.path}")
        found = store.get_file_info(pa.fs.FileSelector(root, recursive=True, allow_not_found=True)) if store.get_file_info(root).type == pa.fs.FileType.Directory else [store.get_file_info(root)]
        return {f.path: f.size for f in found if f.type == pa.fs.FileType.File and not f.base_name.startswith((".", "_"))}

    def _open(self, path: str):
        store, _ = pa.fs.FileSystem.from_uri(self.path if "://" in self.path else f"file://{self.path}")
        return io.BufferedReader(store.open_input_file(path))

    def _ended(self, path: str, start: int, end: int) -> int:
        """The end of the last whole line between two places, read from the back in pieces."""
        with self._open(path) as f:
            while end > start:
                at = max(start, end - (1 << 16))
                f.seek(at)
                cut = f.read(end - at).rfind(b"\n")
                if cut >= 0:
                    return at + cut + 1
                end = at
        return start

    def initialOffset(self) -> dict:
        return {"bytes": json.dumps({})}

    def latestOffset(self) -> dict:
        return {"bytes": json.dumps({p: self._ended(p, 0, n) for p, n in sorted(self._files().items())})}

    def partitions(self, start: dict, end: dict) -> list[ByteRange]:
        done, now = json.loads(start["bytes"]), json.loads(end["bytes"])
        return [ByteRange(p, at, min(at + self.size, n)) for p, n in now.items() for at in range(done.get(p, 0), n, self.size)] or [ByteRange("", 0, 0)]

    def read(self, part: ByteRange) -> Iterator[tuple]:
        """The lines that begin in the range; the last of them may end behind it."""
        if not part.path:
            return
        with self._open(part.path) as f:
            at = part.start
            f.seek(max(0, at - 1))
            if at and f.read(1) != b"\n":
                at += len(f.readline())
            while at < part.end:
                line = f.readline()
                if not line.endswith(b"\n"):
                    return
                yield part.path, at, line.rstrip(b"\r\n").decode("utf-8", "replace")
                at += len(line)

    def commit(self, end: dict) -> None:
        pass


class LogSource(DataSource):
    """A stream of (path, at, line). Options: path (a file or folder), bytes (of a file that a task reads)."""

    @classmethod
    def name(cls) -> str:
        return "appended_lines"

    def schema(self) -> str:
        return "path string, at long, line string"

    def streamReader(self, schema: StructType) -> LogReader:
        return LogReader(self.options["path"], int(self.options.get("bytes", str(16 << 20))))


def register(spark: SparkSession) -> None:
    """Make both formats known to a session, with filters pushed into the database."""
    from plumbline.session import ship

    ship(spark)
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    spark.dataSource.register(DatabaseSource)
    spark.dataSource.register(LogSource)


_SQL_KINDS = {"bigint": "INTEGER", "int": "INTEGER", "double": "REAL", "binary": "BLOB"}


def _create(kinds: list[tuple[str, str]], table: str) -> str:
    return f"CREATE TABLE {_quoted(table)} ({', '.join(f'{_quoted(n)} {_SQL_KINDS.get(k, _TEXT)}' for n, k in kinds)})"


def write_database(rows, path: str, table: str = "observations") -> None:
    """A table as a database file, from rows that arrive at the driver a partition at a time; for small exports and tests."""
    with closing(sqlite3.connect(_local(path))) as db, db:
        db.execute(_create(rows.dtypes, table))
        db.executemany(f"INSERT INTO {_quoted(table)} VALUES ({', '.join('?' * len(rows.columns))})", map(tuple, rows.toLocalIterator()))


def write_databases(rows, path: str, table: str = "observations") -> int:
    """A table as a folder of database files, one for each partition, which its task writes; the number of rows. No row goes through the driver.

    The folder must be there already, where driver and executors reach it by one path. A file gets its name
    once it is whole, so an attempt that fails leaves none.
    """
    create, at = _create(rows.dtypes, table), _local(path)
    insert = f"INSERT INTO {_quoted(table)} VALUES ({', '.join('?' * len(rows.columns))})"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part = os.path.join(at, f"part-{TaskContext.get().partitionId():05d}.db")
        made, n = f"{part}.{uuid.uuid4().hex[:8]}", 0
        with closing(sqlite3.connect(made)) as db, db:
            db.execute(create)
            for batch in batches:
                db.executemany(insert, zip(*(c.to_pylist() for c in batch.columns)))
                n += batch.num_rows
        os.replace(made, part)
        yield pa.RecordBatch.from_pydict({"n": pa.array([n], pa.int64())})

    return rows.mapInArrow(run, "n long").groupBy().sum("n").first()[0] or 0
