"""Terminal recordings as a data source: one file per game, one partition per recording, each decoded up to a bounded prefix.

A recording is what functions.udfs.terminal_recording packs: frames one after another, each behind <seconds, microseconds, length>. Filters on gameid choose files by
their names, filters on step (and the option ``frames``) bound how far a file is read, so recordings that no filter wants are never opened and the rest of a
long one is never read. Files are read as streams through Arrow's file systems, frame by frame.

Defined results: a recording cut off within a frame ends with the frame before; an empty one has no frames; frames hold no carriage returns, as line ends are
written with one; files whose names aren't a number and ``.rec`` are no recordings.
"""

from __future__ import annotations

import re
import struct
import uuid
from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, EqualTo, Filter, GreaterThan, GreaterThanOrEqual, In, InputPartition, LessThan, LessThanOrEqual

from ..functions.udfs import terminal_recording

SCHEMA = "gameid long, step int, seconds double, frame string"
HEADER, CLEAR, END = struct.Struct("<III"), b"\x1b[2J\x1b[H", b"\r\n"
BATCH = 256


def _store(folder: str) -> tuple[fs.FileSystem, str]:
    return fs.FileSystem.from_uri(folder) if "://" in folder or folder.startswith("file:") else (fs.LocalFileSystem(), folder)


def _name(gameid: int) -> str:
    return f"{gameid}.rec"


def write_recordings(frames: DataFrame, folder: str, *, game: str = "gameid", order: str = "step", text: str = "frame", delay: float = 0.25) -> DataFrame:
    """Write a file per game of frames(game, order, text), and give (gameid, bytes). A file appears whole: it is moved to its name once written, so a task may run twice."""
    ordered = F.transform(F.sort_array(F.collect_list(F.struct(F.col(order).alias("o"), F.coalesce(text, F.lit("")).alias("t")))), lambda x: x["t"])
    packed = frames.groupBy(F.col(game).cast("long").alias("gameid")).agg(ordered.alias("frames")).select("gameid", terminal_recording("frames", F.lit(delay)).alias("recording"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, root = _store(folder)
        store.create_dir(root, recursive=True)
        for batch in batches:
            sizes = []
            for gameid, recording in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                body = recording.as_py()
                part = f"{root}/.{gameid}-{uuid.uuid4().hex}"
                with store.open_output_stream(part) as out:
                    out.write(body)
                store.move(part, f"{root}/{_name(gameid)}")
                sizes.append(len(body))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(sizes, pa.int64())], names=["gameid", "bytes"])

    return packed.mapInArrow(run, "gameid long, bytes long")


def frames_of(stream, most: int | None) -> Iterator[tuple[float, str]]:
    """Seconds and text of the frames of an open recording, up to ``most``; nothing behind them is read."""
    count = 0
    while most is None or count < most:
        head = stream.read(HEADER.size)
        if len(head) < HEADER.size:
            return
        seconds, micros, size = HEADER.unpack(head)
        body = stream.read(size)
        if len(body) < size:
            return
        if not body.startswith(CLEAR) or not body.endswith(END):
            raise ValueError("no recording: a frame doesn't clear the screen first")
        yield seconds + micros / 1_000_000, body[len(CLEAR) : -len(END)].decode().replace("\r\n", "\n")
        count += 1


def _decoded(folder: str, gameids: Iterable[int], most: int | None) -> Iterator[pa.RecordBatch]:
    """Batches of the frames of some games, one file open at a time."""
    store, root = _store(folder)
    kinds = {"gameid": pa.int64(), "step": pa.int32(), "seconds": pa.float64(), "frame": pa.string()}
    held: list[tuple] = []

    def batch() -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*held, strict=True), kinds.values(), strict=True)], names=list(kinds))

    for gameid in gameids:
        with store.open_input_stream(f"{root}/{_name(gameid)}") as stream:
            for step, (seconds, frame) in enumerate(frames_of(stream, most)):
                held.append((gameid, step, seconds, frame))
                if len(held) == BATCH:
                    yield batch()
                    held = []
    if held:
        yield batch()


def decoded_games(games: DataFrame, folder: str, *, frames: int | None = None) -> DataFrame:
    """The same for the games of a table(gameid), however many: each is opened by the task that has its row, and no other is. A game without a file is an error."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield from _decoded(folder, batch.column(0).to_pylist(), frames)

    return games.select(F.col("gameid").cast("long").alias("gameid")).filter("gameid IS NOT NULL").distinct().mapInArrow(run, SCHEMA)


@dataclass
class Recordings(InputPartition):
    """Some recordings of a folder, and how many frames of each."""

    folder: str
    gameids: tuple[int, ...]
    most: int | None


class RecordingReader(DataSourceReader):
    def __init__(self, options: dict) -> None:
        self.folder = options["path"]
        self.most = int(options["frames"]) if "frames" in options else None
        self.together = int(options.get("together", "1"))
        self.wanted: set[int] | None = None
        self.low, self.high = None, None

    def pushFilters(self, filters: list[Filter]) -> Iterable[Filter]:  # noqa: N802 (Spark's name)
        for f in filters:
            if not self._taken(f):
                yield f

    def _taken(self, f: Filter) -> bool:
        """Whether reading keeps to this filter."""
        path, value = getattr(f, "attribute", None), getattr(f, "value", None)
        if path == ("gameid",) and isinstance(f, (EqualTo, In)):
            own = {value} if isinstance(f, EqualTo) else set(value)
            self.wanted = own if self.wanted is None else self.wanted & own
        elif path == ("gameid",) and isinstance(f, (GreaterThan, GreaterThanOrEqual)):
            low = value + isinstance(f, GreaterThan)
            self.low = low if self.low is None else max(self.low, low)
        elif path == ("gameid",) and isinstance(f, (LessThan, LessThanOrEqual)):
            high = value - isinstance(f, LessThan)
            self.high = high if self.high is None else min(self.high, high)
        elif path == ("step",) and isinstance(f, (LessThan, LessThanOrEqual)):
            most = max(0, value + isinstance(f, LessThanOrEqual))
            self.most = most if self.most is None else min(self.most, most)
        elif path == ("step",) and isinstance(f, EqualTo):
            self.most = max(0, value + 1) if self.most is None else min(self.most, max(0, value + 1))
            return False  # rows before it are left to Spark
        else:
            return False
        return True

    def partitions(self) -> list[InputPartition]:
        """One for each recording that the filters want, by name alone (or for ``together`` recordings)."""
        store, root = _store(self.folder)
        found = (re.fullmatch(r"(-?\d+)\.rec", info.base_name) for info in store.get_file_info(fs.FileSelector(root, allow_not_found=True)))
        games = sorted(int(m[1]) for m in found if m)
        games = [g for g in games if (self.wanted is None or g in self.wanted) and (self.low is None or g >= self.low) and (self.high is None or g <= self.high)]
        if self.most == 0:
            games = []
        return [Recordings(self.folder, tuple(games[k : k + self.together]), self.most) for k in range(0, len(games), self.together)]

    def read(self, partition: Recordings | None) -> Iterator[pa.RecordBatch]:
        if partition is not None:  # None: no recordings at all
            yield from _decoded(partition.folder, partition.gameids, partition.most)


class RecordingSource(DataSource):
    """Format ``recordings``; options: path, frames (at most of each game), together (recordings of one partition)."""

    @classmethod
    def name(cls) -> str:
        return "recordings"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> RecordingReader:
        return RecordingReader(self.options)


def recordings(spark: SparkSession, folder: str, *, frames: int | None = None, together: int = 1) -> DataFrame:
    """gameid, step, seconds and frame of the recordings in a folder, at most so many frames of each. Filters on gameid and step reach the files."""
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    spark.dataSource.register(RecordingSource)
    reader = spark.read.format("recordings").option("path", folder).option("together", together)
    return (reader if frames is None else reader.option("frames", frames)).load()
