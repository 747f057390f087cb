"""Phases, step plans and masks."""

from __future__ import annotations

import pytest

from tracemill.operators import training

MESSAGES = "array<struct<role: string, content: string>>"


def rows(spark):
    talk = lambda user, answer: [("system", "s"), ("user", user), ("assistant", answer)]
    return spark.createDataFrame([(k, "policy_action" if k % 2 else "next_frame", talk("u" * k, "a" * (k + 1))) for k in range(8)], f"k int, task string, messages {MESSAGES}")


def tokenizer(talks, add_prompt):
    return [[ord(c) for m in t for c in f"{m['role'][0]}{m['content']}"] + ([ord("a")] if add_prompt else []) for t in talks]


def test_masks(spark):
    out = training.masked(rows(spark), tokenizer, 14).orderBy("k").collect()
    for r in out:
        prompt = 2 + 1 + r.k + 1
        assert r.input_ids[prompt:] == [97] * r.supervised_assistant_token_count and r.labels == [-100] * prompt + r.input_ids[prompt:]
        assert r.assistant_token_count == r.k + 1 and len(r.input_ids) + r.truncated_token_count == prompt + r.k + 1
    report = {r.task: r for r in training.mask_report(training.masked(rows(spark), tokenizer, 14)).collect()}
    assert report["all"].row_count == 8 and report["all"].rows_with_truncated_assistant == sum(4 + r.k + r.k + 1 > 14 for r in out)
    with pytest.raises(Exception, match="no assistant tokens"):
        training.masked(rows(spark), tokenizer, 4).collect()


def test_phases_and_steps(spark):
    p = training.phases(rows(spark), "multitask", key="k", ratio=0.5, seed=1)
    assert {k: v.count() for k, v in p.items()} == {"dynamics_warmup": 4, "mixed": 6, "policy_calibration": 4}
    assert list(training.phases(rows(spark), "policy_only", key="k", ratio=0, seed=1)) == ["policy_only"]
    with pytest.raises(ValueError):
        training.phases(rows(spark), "other", key="k", ratio=0, seed=1)
    assert training.phase_steps(250, warmup=50, calibration=20) == (50, 180, 20)
    assert training.phase_steps(1, warmup=5, calibration=5) == (0, 1, 0) and sum(training.phase_steps(2, warmup=5, calibration=5)) == 2
    assert training.automatic_steps(10, 4) == 3
    both = rows(spark)
    assert training.mixed_curriculum(both.filter("k % 2 = 1"), both.filter("k % 2 = 0"), key="k", ratio=1.0, seed=1).columns == ["messages", "task"]
