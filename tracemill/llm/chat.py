"""Chat formatting by token-level assembly.

A turn is ``<|turn|> role <|says|> text <|end|>``. Role and text are encoded apart with a lossless byte-level BPE; the three
marks are ids above its vocabulary, spliced in between, so no text can produce them. Control strings that occur in a role or text
(those of this template and of other common ones) are escaped too, as the formatted output also exists as a string: the escape
character U+001B goes in after the first character of each, and is itself doubled; dropping it again is exact.

Output: one row per turn with its token ids, its first position in the conversation (a prefix sum over the turns before)
and the bounds of its loss mask, prefix sums of the segment lengths. A conversation is the turns in order; none is held as
one row, so that a conversation of any length is written and read back as a stream.

Defined results: null role or text is empty; turns are ordered by (turn, role, text), null first; repeated rows are repeated
turns; rows with a null conv_id form one conversation; texts of any length are encoded whole; columns other than conv_id, turn, role and text are left
out, whatever their names; an empty table gives no rows; only the role ``assistant`` is under the loss mask.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from . import common, token_files

TURN, SAYS, END = "<|turn|>", "<|says|>", "<|end|>"
#: Strings that mark turns here or in other templates.
CONTROL = (TURN, SAYS, END, "<|endoftext|>", "<|startoftext|>", "<|im_start|>", "<|im_end|>", "<|system|>", "<|user|>", "<|assistant|>", "<s>", "</s>", "<<SYS>>", "<</SYS>>", "[INST]", "[/INST]", "<unk>", "<pad>")
ESCAPE = "\x1b"
_ESCAPED = re.compile(f"{ESCAPE}|" + "|".join(f"{re.escape(c[0])}(?={re.escape(c[1:])})" for c in sorted(CONTROL, key=len, reverse=True)))
_UNESCAPED = re.compile(f"{ESCAPE}({ESCAPE}?)")


#: First characters of control strings; a text without any and without the escape character stays as it is.
_FIRSTS = tuple(sorted({c[0] for c in CONTROL} | {ESCAPE}))


def escape(text: str) -> str:
    return _ESCAPED.sub(lambda m: m.group() + ESCAPE, text) if any(c in text for c in _FIRSTS) else text


def unescape(text: str) -> str:
    return _UNESCAPED.sub(r"\1", text) if ESCAPE in text else text


def _encoder(path: str) -> token_files.PieceEncoder:
    return token_files.encoder_of(path, "<i4", True)


def _order() -> list[Column]:
    return [F.col("turn").asc_nulls_first(), F.col("role").asc_nulls_first(), F.col("text").asc_nulls_first()]


def formatted(conversations: DataFrame, tokenizer_path: str) -> DataFrame:
    """conv_id, seq, ids, n_ids, start, loss_start, loss_end (positions in ids; equal for no loss); a row per turn."""
    fields = "conv_id long, turn long, role string, text string, ids array<int>, n_ids int, loss_start int, loss_end int"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = _encoder(tokenizer_path)
        turn_id = encoder.tokenizer.get_vocab_size()
        mark = [np.array([turn_id + k], dtype="<i4").tobytes() for k in range(3)]
        for batch in common.slices(batches, 3, 1000):
            roles = batch.column(2).to_pylist()
            role_ids = {r: encoder.encode([escape(r or "").encode()])[0] for r in set(roles)}
            text_ids = encoder.encode([escape(t or "").encode() for t in batch.column(3).to_pylist()])
            # lengths of the five segments of each turn; their prefix sums are the bounds of each
            sizes = np.array([[4, len(role_ids[r]), 4, len(t), 4] for r, t in zip(roles, text_ids, strict=True)], dtype=np.int32).reshape(-1, 5) // 4
            bounds = np.cumsum(sizes, axis=1, dtype=np.int32)
            learned = np.array([r == "assistant" for r in roles], dtype=bool)
            flat = np.frombuffer(b"".join([x for r, t in zip(roles, text_ids, strict=True) for x in (mark[0], role_ids[r], mark[1], t, mark[2])]), dtype="<i4")
            offsets = np.concatenate([[0], np.cumsum(bounds[:, 4])]).astype(np.int32)
            yield pa.RecordBatch.from_arrays(
                [
                    *(batch.column(k) for k in range(4)), pa.ListArray.from_arrays(pa.array(offsets), pa.array(flat)), pa.array(bounds[:, 4]), pa.array(bounds[:, 2]),
                    pa.array(np.where(learned, bounds[:, 3], bounds[:, 2])),
                ],
                names=[f.split()[0] for f in fields.split(", ")],
            )
        common.release()

    rows = conversations.select(F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"), F.col("role").cast("string").alias("role"), F.col("text").cast("string").alias("text"))
    turns = rows.mapInArrow(run, fields)
    within = W.partitionBy("conv_id").orderBy(*_order())
    return turns.withColumns(
        {"seq": F.row_number().over(within), "start": F.sum("n_ids").over(within.rowsBetween(W.unboundedPreceding, 0)) - F.col("n_ids")}
    ).select("conv_id", "seq", "ids", "n_ids", "start", "loss_start", "loss_end")


def digests(turns: DataFrame, tokenizer_path: str) -> DataFrame:
    """Read formatted turns back: per conversation its turns, its text under the loss mask, their digests and the length of it as a string."""
    fields = "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = _encoder(tokenizer_path)
        turn_id = encoder.tokenizer.get_vocab_size()
        says_id, end_id = turn_id + 1, turn_id + 2
        now: list | None = None
        done: list[list] = []

        def closed() -> Iterator[pa.RecordBatch]:
            columns = list(zip(*done, strict=True))
            kinds = [pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64()]
            rows = [columns[0], columns[1], [h.hexdigest() for h in columns[2]], columns[3], [h.hexdigest() for h in columns[4]], columns[5]]
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(rows, kinds, strict=True)], names=[f.split()[0] for f in fields.split(", ")])
            done.clear()

        for batch in batches:
            for conv, ids, a, b in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if ids[0] != turn_id or ids[-1] != end_id:
                    raise ValueError("a turn lacks its marks")
                says = ids.index(says_id)
                role, text = encoder.decode(ids[1:says]), encoder.decode(ids[says + 1 : -1])
                chars = len(TURN) + len(role) + len(SAYS) + len(text) + len(END)
                # what the mask covers: as a rule a whole text or nothing
                loss = "" if a == b else text if (a, b) == (says + 1, len(ids) - 1) else encoder.decode(ids[a:b])
                role, text, loss = unescape(role), unescape(text), unescape(loss)
                if now is None or now[0] != conv:
                    if now is not None:
                        done.append(now)
                    now = [conv, 0, hashlib.sha256(), 0, hashlib.sha256(), 0]
                now[1] += 1
                now[2].update(f"{role}\n{text}\n".encode())
                now[3] += len(loss)
                now[4].update(loss.encode())
                now[5] += chars
            if done:
                yield from closed()
        if now is not None:
            done.append(now)
            yield from closed()
        common.release()

    n = max(1, int(turns.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    dealt = turns.repartition(n, "conv_id").sortWithinPartitions(F.col("conv_id").asc_nulls_first(), "seq")
    return dealt.select("conv_id", "ids", "loss_start", "loss_end").mapInArrow(run, fields)


def round_trip(conversations: DataFrame, tokenizer_path: str) -> DataFrame:
    """Format, write to the shared folder, read back and digest."""
    return digests(common.written(formatted(conversations, tokenizer_path), "chat"), tokenizer_path)


def _added(text: str) -> str:
    """SQL for the escape characters that a text gets; no control string begins another or overlaps itself."""
    return " + ".join(f"(length({text}) - length(replace({text}, {c}, ''))) // {n}" for c, n in [("chr(27)", 1), *((f"'{c}'", len(c)) for c in CONTROL)])


CHAT_SQL = f"""
WITH c AS (
  SELECT conv_id, turn, role, text FROM conversations
  UNION ALL SELECT -7, 0, 'user', '</s>[INST] ok [/INST]' UNION ALL SELECT -7, 1, 'assistant', '</s>[INST] ok [/INST]'
), t AS (
  SELECT conv_id, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role NULLS FIRST, text NULLS FIRST) AS n, coalesce(role, '') AS role, coalesce(text, '') AS text FROM c
), e AS (
  SELECT *, {len(TURN) + len(SAYS) + len(END)} + length(role) + length(text) + {_added("role")} + {_added("text")} AS chars FROM t
)
SELECT conv_id, count(*) AS n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY n)) AS turns_sha256,
       coalesce(sum(length(text)) FILTER (role = 'assistant'), 0)::BIGINT AS loss_chars, sha256(coalesce(string_agg(text, '' ORDER BY n) FILTER (role = 'assistant'), '')) AS loss_sha256,
       sum(chars)::BIGINT AS formatted_chars
FROM e GROUP BY conv_id
"""
