"""SQLite index files as a data source: tables inspected for their columns, read in ranges of rowid, filters run by the files; and subsets written as new index files.

A folder of index files (one for each archive shard) is one table. Each file's table is cut into ranges of about as many rows that pass the filters, one partition
each, so partitions are balanced however rowids lie. Files are opened read-only and have to be on a path that driver and executors mount.

Defined results: columns are what the first file by name declares (INTEGER long, REAL double, TEXT string, BLOB binary); files that declare others are an
error; files without the table give no rows; values of another type than declared become null, as SQLite doesn't enforce types; an empty folder is an error.
"""

from __future__ import annotations

import os
import sqlite3
import uuid
from collections.abc import Iterable, Iterator
from contextlib import closing
from dataclasses import dataclass
from itertools import chain

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, EqualTo, Filter, GreaterThan, GreaterThanOrEqual, In, InputPartition, IsNotNull, IsNull, LessThan, LessThanOrEqual, StringStartsWith
from pyspark.sql.types import BinaryType, DoubleType, LongType, StringType, StructField, StructType

from . import readers

KINDS = {"INTEGER": LongType(), "INT": LongType(), "BIGINT": LongType(), "REAL": DoubleType(), "DOUBLE": DoubleType(), "TEXT": StringType(), "BLOB": BinaryType()}
_ARROW = {LongType(): (pa.int64(), int), DoubleType(): (pa.float64(), (float, int)), StringType(): (pa.string(), str), BinaryType(): (pa.binary(), bytes)}
_COMPARED = {EqualTo: "=", GreaterThan: ">", GreaterThanOrEqual: ">=", LessThan: "<", LessThanOrEqual: "<="}
BATCH = 2_000


def _local(path: str) -> str:
    return path.removeprefix("file://").removeprefix("file:")


def _files(path: str) -> list[str]:
    path = _local(path)
    return [path] if os.path.isfile(path) else sorted(os.path.join(path, f) for f in os.listdir(path) if f.endswith(".db") and not f.startswith("."))


def _opened(file: str):
    return closing(sqlite3.connect(f"file:{file}?mode=ro&immutable=1", uri=True))


def _quoted(name: str) -> str:
    return '"' + name.replace('"', '""') + '"'


def declared(file: str, table: str) -> list[tuple[str, str]]:
    """Columns of a table and the types that they are declared with; none if the file lacks the table."""
    with _opened(file) as index:
        return [(r[1], r[2].upper().split("(")[0]) for r in index.execute(f"PRAGMA table_info({_quoted(table)})")]


@dataclass
class RowRange(InputPartition):
    """Rows of a file from one rowid up to another, both with it."""

    file: str
    low: int
    high: int


class IndexReader(DataSourceReader):
    def __init__(self, options: dict, schema: StructType) -> None:
        self.path, self.table, self.rows = options["path"], options["table"], int(options.get("rows", "100000"))
        self.schema, self.known = schema, {f.name: f.dataType for f in schema.fields}
        self.where: list[str] = []
        self.values: list = []
        self.looked_up = False  # whether an index of the file may find the rows faster than a walk

    def pushFilters(self, filters: list[Filter]) -> Iterable[Filter]:  # noqa: N802 (Spark's name)
        for f in filters:
            said = self._said(f)
            if said is None:
                yield f
            else:
                self.where.append(said[0])
                self.values += said[1]
                self.looked_up |= isinstance(f, (EqualTo, In))

    def _said(self, f: Filter) -> tuple[str, list] | None:
        """The filter in SQL with its values; None if it is left to Spark."""
        path = getattr(f, "attribute", ())
        if len(path) != 1 or path[0] not in self.known:
            return None
        name, kind = _quoted(path[0]), self.known[path[0]]
        # only values of the declared type count, as only they are read
        typed = f"typeof({name}) IN ({', '.join({LongType(): repr('integer'), StringType(): repr('text'), BinaryType(): repr('blob')}.get(kind, repr('real') + ', ' + repr('integer')).split(', '))})"
        if isinstance(f, IsNotNull):
            return typed, []
        if isinstance(f, IsNull):
            return f"NOT ({typed})", []
        if isinstance(f, In) and len(f.value) <= 500 and None not in f.value:
            return f"{typed} AND {name} IN ({', '.join('?' * len(f.value))})", list(f.value)
        if isinstance(f, StringStartsWith) and "\0" not in f.value:
            return f"{typed} AND substr({name}, 1, {len(f.value)}) = ?", [f.value]
        if type(f) in _COMPARED and isinstance(f.value, _ARROW[kind][1]):
            return f"{typed} AND {name} {_COMPARED[type(f)]} ?", [f.value]
        return None

    def _filter(self) -> str:
        return "".join(f" AND ({w})" for w in self.where)

    def partitions(self) -> list[InputPartition]:
        """Ranges of rowid with about ``rows`` passing rows each."""
        out: list[InputPartition] = []
        for file in _files(self.path):
            own = declared(file, self.table)
            if not own:
                continue
            if [n for n, _ in own] != list(self.known):
                raise ValueError(f"{file} declares other columns of {self.table}: {own}")
            with _opened(file) as index:
                # a walk along the key by SQLite: the last row of a range is so many rows on, or the last that passes
                passing = f"FROM {_quoted(self.table)}{'' if self.looked_up else ' NOT INDEXED'} WHERE rowid >= ?{self._filter()}"
                low = -(1 << 63)
                while low < 1 << 63:
                    (low,) = index.execute(f"SELECT min(rowid) {passing}", [low, *self.values]).fetchone()
                    if low is None:
                        break
                    found = index.execute(f"SELECT rowid {passing} ORDER BY rowid LIMIT 1 OFFSET ?", [low, *self.values, self.rows - 1]).fetchone()
                    (high,) = found or index.execute(f"SELECT max(rowid) {passing}", [low, *self.values]).fetchone()
                    out.append(RowRange(file, low, high))
                    low = high + 1
        return out

    def read(self, partition: RowRange | None) -> Iterator[pa.RecordBatch]:
        if partition is None:
            return
        names = list(self.known)
        with _opened(partition.file) as index:
            found = index.execute(f"SELECT {', '.join(map(_quoted, names))} FROM {_quoted(self.table)} WHERE rowid BETWEEN ? AND ?{self._filter()} ORDER BY rowid", [partition.low, partition.high, *self.values])
            while rows := found.fetchmany(BATCH):
                columns = []
                for column, kind in zip(zip(*rows, strict=True), self.known.values(), strict=True):
                    arrow, types = _ARROW[kind]
                    columns.append(pa.array([v if isinstance(v, types) else None for v in column], arrow))
                yield pa.RecordBatch.from_arrays(columns, names=names)


class IndexSource(DataSource):
    """Format ``sqlite_index``; options: path (a file, or a folder of .db files), table, rows (of one partition)."""

    @classmethod
    def name(cls) -> str:
        return "sqlite_index"

    def schema(self) -> StructType:
        files = _files(self.options["path"])
        found = next((own for f in files if (own := declared(f, self.options["table"]))), None)
        if found is None:
            raise ValueError(f"no index file under {self.options['path']} has a table {self.options['table']}")
        return StructType([StructField(n, KINDS.get(kind, StringType())) for n, kind in found])

    def reader(self, schema: StructType) -> IndexReader:
        return IndexReader(self.options, schema)


def index_table(spark: SparkSession, path: str, table: str, *, rows: int = 100_000) -> DataFrame:
    """A table of one index file or of all in a folder; filters on its columns are run by the files."""
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    spark.dataSource.register(IndexSource)
    return spark.read.format("sqlite_index").option("path", path).option("table", table).option("rows", rows).load()


def index_tables(path: str) -> dict[str, list[tuple[str, str]]]:
    """Tables of the first index file and their columns as declared."""
    with _opened(_files(path)[0]) as index:
        names = [r[0] for r in index.execute("SELECT name FROM sqlite_master WHERE type = 'table' ORDER BY name")]
    return {n: declared(_files(path)[0], n) for n in names}


def index_subset(spark: SparkSession, path: str, chosen: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Roots, games and recordings of the chosen players: all of a kept recording is kept, and nothing that no kept recording needs."""
    roots, games, recordings = (index_table(spark, path, t) for t in ("roots", "games", "ttyrecs"))
    own, kept = readers.player_subset(recordings, games, chosen)
    return roots.distinct().join(F.broadcast(own.limit(1).agg((F.count("*") > 0).alias("_any"))), F.col("_any")).drop("_any"), kept, own.drop("player")


def write_index(roots: DataFrame, games: DataFrame, recordings: DataFrame, folder: str, *, shards: int) -> DataFrame:
    """Index files ``index-<k>.db`` with the games of a hash and their recordings together, and all roots in each; gives (shard, games, recordings).

    A task writes one shard, batch by batch, and SQLite orders its rows by game on disk, so that a shard may be larger than a task's memory. A file is moved to its
    name once it is complete, so a task may run twice. Roots are few (a dataset each).
    """
    held = [tuple(r) for r in roots.select("dataset_name", "root", "ttyrec_version").limit(10_001).collect()]
    if len(held) > 10_000:
        raise ValueError("an index has a root for each dataset, not over 10,000")
    made = {t: [(f.name, {LongType(): "INTEGER", DoubleType(): "REAL", BinaryType(): "BLOB"}.get(f.dataType, "TEXT")) for f in df.schema.fields] for t, df in (("roots", roots.select("dataset_name", "root", "ttyrec_version")), ("games", games), ("ttyrecs", recordings))}
    target = _local(folder)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        batches = (b for b in batches if b.num_rows)
        first = next(batches, None)
        if first is None:
            return
        os.makedirs(target, exist_ok=True)
        shard, part, counts = first.column("_shard")[0], os.path.join(target, f".{uuid.uuid4().hex}"), dict.fromkeys(("games", "ttyrecs"), 0)
        put = {t: f"VALUES ({', '.join('?' * len(columns))})" for t, columns in made.items()}
        with closing(sqlite3.connect(part)) as index, index:
            index.execute("PRAGMA temp_store = FILE")
            for table, columns in made.items():
                for name in (f"main.{table}", f"temp.came_{table}"):
                    index.execute(f"CREATE TABLE {name} ({', '.join(f'{_quoted(n)} {k}' for n, k in columns)})")
            index.executemany(f"INSERT INTO roots {put['roots']}", held)
            for batch in chain([first], batches):
                if not pc.all(pc.equal(batch.column("_shard"), shard)).as_py():
                    raise ValueError("a task got rows of two shards")
                for table in counts:
                    rows = batch.column(table)
                    rows = rows.filter(rows.is_valid())
                    index.executemany(f"INSERT INTO came_{table} {put[table]}", zip(*[c.to_pylist() for c in rows.flatten()], strict=True))
                    counts[table] += len(rows)
            for table in counts:
                index.execute(f"INSERT INTO main.{table} SELECT * FROM came_{table} ORDER BY gameid")
            index.execute("CREATE INDEX ttyrecs_gameid ON ttyrecs (gameid)")
        os.replace(part, os.path.join(target, f"index-{shard}.db"))
        yield pa.RecordBatch.from_pydict({"shard": pa.array([shard.as_py()], pa.int32()), "games": [counts["games"]], "recordings": [counts["ttyrecs"]]})

    shard = F.pmod(F.xxhash64(F.col("gameid").cast("long")), F.lit(shards)).cast("int").alias("_shard")
    own, taken = games.select(shard, F.struct(*games.columns).alias("games")), recordings.select(shard, F.struct(*recordings.columns).alias("ttyrecs"))
    both = own.unionByName(taken, allowMissingColumns=True).repartitionById(shards, "_shard")
    return both.mapInArrow(run, "shard int, games long, recordings long")
