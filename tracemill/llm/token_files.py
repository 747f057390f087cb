"""Token-ID binary output: flat unsigned integers with 64-bit document offsets, memory-mapped.

Documents are dealt into ranges of doc_id and sorted within each; a task writes one pair of files of its range into a
folder that driver and executors share:

* ``ids-NNNNN.bin``: token ids of all its documents one after another, each document closed by the end id; unsigned
  little-endian integers of 2 bytes where the vocabulary fits, else of 4;
* ``off-NNNNN.bin``: little-endian 64-bit integers; entry 2k is the id of document k, entry 2k+1 the
  position in the range's ids where it starts; one more pair closes the list. Ids are null in the first documents of a
  range, as many as the manifest says, and stored as 0 there.

A task writes under a name of its own and renames at the end, so that a repeated task leaves the same files. The bases
of the ranges are prefix sums over the manifest, which has a row for each range.

Encoding: texts in which all white space is single spaces and line feeds between words are cut before those, where the
byte-level pattern always cuts; each distinct word is encoded once by the tokenizer and then looked up (by a 64-bit hash; a second
one tells words apart that share it). Other texts are encoded whole. Both give the tokenizer's own ids (tested). Special strings
in a text get their special ids, as the tokenizer does when it is loaded, or count as ordinary text with ``plain``.

Defined results: null text is empty and has the end id alone; equal ids follow each other by text; null ids come first
and are counted in the manifest; texts of any length are encoded whole; columns other than doc_id and text are left out, whatever their
names; an empty table leaves an empty folder and no rows.
"""

from __future__ import annotations

import os
import re
import zlib
from collections.abc import Iterator
from functools import lru_cache
from urllib.parse import urlparse

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from . import common, words


class PieceEncoder:
    """Ids of whole texts as bytes of ``dtype``; distinct words are encoded once, until ``limit`` of them are known."""

    limit = 1_000_000

    def __init__(self, tokenizer_path: str, dtype: str, plain: bool = False) -> None:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(tokenizer_path)
        self.tokenizer.encode_special_tokens = plain
        added = [t.content for t in self.tokenizer.get_added_tokens_decoder().values()]
        # a special string may span words or end within one
        self.special = re.compile(b"|".join(re.escape(t.encode()) for t in added)) if added and not plain else None
        self.dtype = np.dtype(dtype)
        self.surface = surfaces(self.tokenizer)
        self.known = words.KnownUnits(dtype, 0, self.limit)
        self.feed = self.tokenizer.encode("\n", add_special_tokens=False).ids
        if len(self.feed) != 1:
            raise ValueError("the vocabulary needs an id for the line feed")

    def whole(self, texts: list[str]) -> list[bytes]:
        return [np.array(e.ids, dtype=self.dtype).tobytes() for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]

    def _found(self, units: words.Units, new: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Ids of units: lines of few texts, cut at the line feeds' ids; a unit after a line feed keeps that feed's id."""
        kind = units.kind[new]
        order = np.argsort(kind, kind="stable")
        flat, size = [], []
        for k in (0, 1, 2):
            own = new[order[kind[order] == k]]
            before = b" " if k == 1 else b""
            for first in range(0, len(own), 4000):
                some = own[first : first + 4000]
                lines = (b"\n" + before).join([units.joined[x:y] for x, y in zip(units.starts[some].tolist(), units.ends[some].tolist(), strict=True)])
                text = (before + lines).decode()
                ids = np.array(self.tokenizer.encode_batch_fast([text], add_special_tokens=False)[0].ids, dtype=np.int64)
                feeds = np.flatnonzero(ids == self.feed[0])
                if len(feeds) != len(some) - 1:
                    raise ValueError("a word holds a line feed's id")
                ends = np.append(feeds, len(ids))
                starts = np.concatenate([[0], feeds + 1])
                if k == 2:
                    ids = np.insert(ids, starts, self.feed[0])
                    flat.append(ids[words.gathered(starts + np.arange(len(starts)), ends - starts + 1)])
                    size.append(ends - starts + 1)
                else:
                    flat.append(ids[words.gathered(starts, ends - starts)])
                    size.append(ends - starts)
        sizes, flat_ids = np.concatenate(size), np.concatenate(flat)
        back = np.empty(len(new), dtype=np.int64)
        back[order] = np.arange(len(new))
        first_of = np.cumsum(sizes) - sizes
        return flat_ids[words.gathered(first_of[back], sizes[back])], sizes[back], np.empty((0, len(new)))

    def encode(self, bodies: list[bytes]) -> list[bytes]:
        """Where all white space of a text is single spaces and line feeds between words, word by word; else as a whole."""
        # white space beyond ASCII at the border of a word would join the space there
        odd = [not b.isascii() and bool(_ODD_SPACE.search(b)) for b in bodies]
        if self.special is not None:
            odd = [o or bool(self.special.search(b)) for o, b in zip(odd, bodies, strict=True)]
        units = words.Units([None if o else b for b, o in zip(bodies, odd, strict=True)])
        size, regular = self.dtype.itemsize, units.regular
        if len(units.keys):
            # irregular texts have units too; they are not used
            places, clashes = self.known.places(units, lambda new: self._found(units, new))
            regular = units.without(clashes)
            raw = self.known.ids(places).tobytes()
            ends = np.concatenate([[0], np.cumsum(self.known.size[places])])[units.bounds] * size
        else:
            raw, ends = b"", np.zeros(len(bodies) + 1, dtype=np.int64)
        whole = iter(self.whole([b.decode() for b, r in zip(bodies, regular, strict=True) if not r]))
        return [raw[x:y] if r else next(whole) for x, y, r in zip(ends.tolist(), ends[1:].tolist(), regular.tolist())]


    def decode(self, ids: list[int]) -> str:
        """The text of ids; bytes that are no UTF-8 become U+FFFD."""
        return b"".join(map(self.surface.__getitem__, ids)).decode(errors="replace")


def surfaces(tokenizer) -> list[bytes]:
    """The bytes of each id of a byte-level vocabulary: printable characters of Latin-1 stand for themselves, the other bytes, in order, for U+0100 and up."""
    plain = [k for k in range(256) if 33 <= k <= 126 or 161 <= k <= 172 or 174 <= k <= 255]
    byte_of = {chr(k): k for k in plain} | {chr(256 + n): k for n, k in enumerate(sorted(set(range(256)) - set(plain)))}
    added = {k: t.content.encode() for k, t in tokenizer.get_added_tokens_decoder().items()}
    out = [b""] * tokenizer.get_vocab_size()
    for piece, k in tokenizer.get_vocab().items():
        out[k] = added[k] if k in added else bytes(byte_of[c] for c in piece)
    return out


#: White space beyond ASCII in UTF-8.
_ODD_SPACE = re.compile(rb"\xc2[\x85\xa0]|\xe1\x9a\x80|\xe2\x80[\x80-\x8a\xa8\xa9\xaf]|\xe2\x81\x9f|\xe3\x80\x80")


@lru_cache(maxsize=2)
def encoder_of(tokenizer_path: str, dtype: str, plain: bool) -> PieceEncoder:
    """One encoder per worker: words stay known from task to task, within its limit."""
    return PieceEncoder(tokenizer_path, dtype, plain)


def _local(path: str) -> str:
    """The folder as executors mount it. The files are memory-mapped, so the shared folder has to be a mounted one."""
    parts = urlparse(path)
    if parts.scheme not in ("", "file"):
        raise ValueError(f"token files need a mounted shared folder, not {parts.scheme}:")
    return parts.path if parts.scheme else path


MANIFEST = "part long, n_docs long, n_ids long, n_null long"


def write(docs: DataFrame, tokenizer_path: str, folder: str, end_id: int = 0, vocabulary: int = 50_257, ranges: int | None = None, plain: bool = False) -> DataFrame:
    """Write the files; the manifest (MANIFEST) is kept as Parquet in ``folder`` and returned."""
    spark = docs.sparkSession
    local = _local(folder)
    dtype = "<u2" if max(vocabulary, end_id + 1) <= 2**16 else "<u4"
    ranges = ranges or max(int(spark.conf.get("spark.sql.shuffle.partitions")), docs.rdd.getNumPartitions())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part = TaskContext.get().partitionId()
        encoder = encoder_of(tokenizer_path, dtype, plain)
        end = np.array([end_id], dtype=dtype).tobytes()
        os.makedirs(local, exist_ok=True)
        own = f"{local}/.{part}-{TaskContext.get().taskAttemptId()}"
        n_docs = n_ids = n_null = 0
        with open(f"{own}.ids", "wb") as ids, open(f"{own}.off", "wb") as offsets:
            for rows in common.slices(batches, 1, 500):
                encoded = encoder.encode(rows.column(1).to_pylist())
                sizes = np.array([len(e) // np.dtype(dtype).itemsize + 1 for e in encoded], dtype=np.int64)
                pairs = np.empty((len(sizes), 2), dtype="<i8")
                pairs[:, 0] = rows.column(0).fill_null(0).to_numpy()
                pairs[:, 1] = n_ids + np.cumsum(sizes) - sizes
                ids.write(end.join([*encoded, b""]))
                offsets.write(pairs.tobytes())
                n_docs, n_ids, n_null = n_docs + len(sizes), n_ids + int(sizes.sum()), n_null + rows.column(0).null_count
            offsets.write(np.array([0, n_ids], dtype="<i8").tobytes())
        os.replace(f"{own}.ids", f"{local}/ids-{part:05d}.bin")
        os.replace(f"{own}.off", f"{local}/off-{part:05d}.bin")
        common.release()
        yield pa.RecordBatch.from_arrays([pa.array([x], pa.int64()) for x in (part, n_docs, n_ids, n_null)], names=["part", "n_docs", "n_ids", "n_null"])

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).cast("binary").alias("text"))
    sorted_rows = rows.repartitionByRange(ranges, "doc_id").sortWithinPartitions("doc_id", "text")
    sorted_rows.mapInArrow(run, MANIFEST).write.parquet(f"{folder}/manifest")
    return spark.read.schema(MANIFEST).parquet(f"{folder}/manifest")


def read(manifest: DataFrame, folder: str, vocabulary: int = 50_257, end_id: int = 0) -> DataFrame:
    """doc_id, start, n_tokens, ids_crc32 of each document, from the files."""
    local = _local(folder)
    dtype = "<u2" if max(vocabulary, end_id + 1) <= 2**16 else "<u4"
    based = manifest.filter("n_docs > 0").withColumn("base", F.sum("n_ids").over(W.orderBy("part")) - F.col("n_ids"))
    n = max(1, int(manifest.sparkSession.conf.get("spark.sql.shuffle.partitions")))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part, base, n_null in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                ids = np.memmap(f"{local}/ids-{part:05d}.bin", dtype=dtype, mode="r")
                pairs = np.memmap(f"{local}/off-{part:05d}.bin", dtype="<i8", mode="r").reshape(-1, 2)
                starts = np.asarray(pairs[:, 1])
                for first in range(0, len(pairs) - 1, 5000):
                    last = min(first + 5000, len(pairs) - 1)
                    sums = [zlib.crc32(ids[starts[k] : starts[k + 1]].astype("<u4").tobytes()) for k in range(first, last)]
                    doc_id = np.asarray(pairs[first:last, 0])
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(doc_id, mask=np.arange(first, last) < n_null), pa.array(base + starts[first:last]), pa.array(np.diff(starts[first : last + 1])), pa.array(sums, pa.int64())],
                        names=["doc_id", "start", "n_tokens", "ids_crc32"],
                    )

    return based.select("part", "base", "n_null").repartition(n, "part").mapInArrow(run, "doc_id long, start long, n_tokens long, ids_crc32 long")


def round_trip(docs: DataFrame, tokenizer_path: str, **options) -> DataFrame:
    """Write docs to a new shared folder and read them back."""
    folder = common.shared_path(docs.sparkSession, "token-files")
    return read(write(docs, tokenizer_path, folder, **options), folder)
