"""What a trainer is given: phases, mixed curricula, rows masked for the assistant's part, step plans from counts."""

from __future__ import annotations

from collections.abc import Callable, Sequence

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, IntegerType, StructField, StructType

from ..functions.scalars import rate
from . import splits

#: Fixed value: labels that carry no loss.
NO_LOSS = -100
COUNTERS = ("input_token_count", "prompt_token_count", "masked_prompt_token_count", "assistant_token_count", "supervised_assistant_token_count", "assistant_tokens_truncated", "truncated_token_count")
Tokenizer = Callable[[Sequence[Sequence[dict]], bool], list[list[int]]]


def minimal_rows(rows: DataFrame, keep: Sequence[str] = ()) -> DataFrame:
    return rows.select("messages", "task", *keep)


def mixed_curriculum(policy: DataFrame, frames: DataFrame, *, key: str, ratio: float, seed: int, keep: Sequence[str] = ()) -> DataFrame:
    """All policy rows and each frame row with probability ``ratio`` by the hash of its key: (messages, task) and what is to be kept."""
    return minimal_rows(policy, keep).unionByName(minimal_rows(splits.bernoulli(frames, key, seed, ratio), keep))


def phases(rows: DataFrame, objective: str, *, key: str, ratio: float, seed: int) -> dict[str, DataFrame]:
    """Phase -> rows: one for a single task; dynamics_warmup, mixed and policy_calibration for both. The mixed phase takes int(n * ratio) frame rows."""
    policy, frames = rows.filter("task = 'policy_action'"), rows.filter("task = 'next_frame'")
    if objective == "policy_only":
        return {"policy_only": policy}
    if objective == "dynamics_only":
        return {"dynamics_only": frames}
    if objective != "multitask":
        raise ValueError(f"unknown training objective: {objective}")
    sampled = splits.share_sample(frames, key, seed, min(1.0, ratio)) if ratio > 0 else frames.limit(0)
    return {"dynamics_warmup": frames, "mixed": policy.unionByName(sampled), "policy_calibration": policy}


def phase_steps(total: int, *, warmup: int, calibration: int) -> tuple[int, int, int]:
    """Steps of warm-up, mixed and calibration phases: at most a fifth and a tenth for the outer ones, at least one for the mixed one."""
    if total <= 0:
        raise ValueError("total steps must be positive")
    first = 0 if total == 1 else min(warmup, max(1, total // 5))
    last = 0 if total == 1 else min(calibration, max(1, total // 10), max(0, total - first - 1))
    return first, total - first - last, last


def automatic_steps(row_count: int, batch_size: int) -> int:
    return -(-row_count // batch_size)


def masked(rows: DataFrame, tokenizer: Tokenizer, max_length: int) -> DataFrame:
    """rows with input_ids, labels and COUNTERS; all before the last message carries no loss.

    ``tokenizer(conversations, add_prompt)`` gives token ids for a batch of message lists and is run in the tasks. A row whose last
    message isn't the assistant's, whose prompt isn't a prefix of the whole, or of which no assistant token is left, fails the job.
    """
    if max_length <= 0:
        raise ValueError("max_length must be positive")
    more = [StructField("input_ids", ArrayType(IntegerType())), StructField("labels", ArrayType(IntegerType())), *(StructField(c, IntegerType()) for c in COUNTERS)]

    def run(batches):
        for batch in batches:
            talks = [[{"role": m["role"], "content": m["content"]} for m in talk] for talk in batch["messages"]]
            if any(len(t) < 2 or t[-1]["role"] != "assistant" for t in talks):
                raise ValueError("rows must end with an assistant message")
            out = []
            for prompt, full in zip(tokenizer([t[:-1] for t in talks], True), tokenizer(talks, False), strict=True):
                ids = full[:max_length]
                hidden = min(len(prompt), len(ids))
                answer, left = len(full) - len(prompt), len(ids) - hidden
                if full[: len(prompt)] != prompt or answer <= 0 or left <= 0:
                    raise ValueError("a row has no assistant tokens after its prompt")
                out.append((ids, [NO_LOSS] * hidden + ids[hidden:], len(ids), hidden, hidden, answer, left, answer - left, len(full) - len(ids)))
            yield pd.concat([batch.reset_index(drop=True), pd.DataFrame(out, columns=[f.name for f in more])], axis=1)

    return rows.mapInPandas(run, StructType([*rows.schema.fields, *more]))


def mask_report(tokenized: DataFrame) -> DataFrame:
    """Counters summed by task and over all (task 'all'), with the share of supervised tokens."""
    out = tokenized.rollup("task").agg(
        F.grouping("task").alias("_all"), F.count("*").alias("row_count"), *[F.sum(c).alias(c) for c in COUNTERS], F.count_if(F.col("assistant_tokens_truncated") > 0).alias("rows_with_truncated_assistant")
    )
    share = rate(F.col("supervised_assistant_token_count"), F.col("input_token_count")).alias("supervised_token_fraction")
    return out.select(F.when(F.col("_all") == 1, "all").otherwise(F.coalesce("task", F.lit("unknown"))).alias("task"), "row_count", *COUNTERS, "rows_with_truncated_assistant", share)
