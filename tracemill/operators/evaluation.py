"""One evaluation of a model's predicted planes in one pass: counts of cells, of examples, of games and of horizons from one expansion.

Every example is compared once, cell by cell, into additive counts and its own F1. All coarser figures are sums of those counts over grouping sets, so the input is
scanned once however many grains are asked for, and what is shuffled is one row of counts per task and group.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.scalars import f1, rate
from . import metrics, planes

#: Ratios over summed counts: name -> (count, out of).
RATIOS = {
    "char_accuracy": ("char_correct", "cells"),
    "exact_frame_rate": ("exact_frames", "examples"),
    "changed_cell_precision": ("true_positive_changed", "predicted_changed"),
    "changed_cell_recall": ("true_positive_changed", "true_changed"),
    "changed_cell_char_accuracy": ("correct_changed", "true_changed"),
    "map_char_accuracy": ("map_char_correct", "map_cells"),
    "status_char_accuracy": ("status_char_correct", "status_cells"),
}


def evaluated(rows: DataFrame, grains: Sequence[Sequence[str]], *, map_cells: int, digits: int = 6) -> DataFrame:
    """A row for each group of each grain: the columns it groups by (null where it doesn't), examples, counts of cells, ratios over them, and the mean F1 of examples.

    rows(current_, next_ and pred_ chars and colors as arrays, and the grains' columns); ``grains``: lists of columns, [] for all rows. ``grain`` names the columns.
    Empty input gives no rows. A group whose column is null has ``grain`` to tell it from coarser ones.
    """
    keys = list(dict.fromkeys(c for g in grains for c in g))
    sums = metrics.plane_sums(F.col("current_chars"), F.col("next_chars"), F.col("pred_chars"), map_cells)
    examples = rows.select(*keys, *sums, planes.changed_f1().alias("_f1"))
    counts = [c for c in examples.columns if c not in keys and c != "_f1"]
    figures = [F.count("*").alias("examples"), *[F.sum(c).alias(c) for c in counts], F.avg("_f1").alias("_f1")]
    if keys:
        # bit k of the grouping id, from the last key on, tells that a key is rolled up
        names = {sum(1 << (len(keys) - 1 - k) for k, c in enumerate(keys) if c not in g): ",".join(g) or "all" for g in grains}
        told = examples.groupingSets([[F.col(c) for c in g] for g in grains], *keys).agg(F.grouping_id().alias("_g"), *figures)
        grain = F.element_at(F.create_map(*[x for k, v in names.items() for x in (F.lit(k), F.lit(v))]), F.col("_g").cast("int"))
    else:
        told, grain = examples.agg(*figures).filter("examples > 0"), F.lit("all")
    ratios = {n: rate(F.col(a), F.col(b)) for n, (a, b) in RATIOS.items()}
    return told.filter("examples > 0").select(
        grain.alias("grain"),
        *keys,
        "examples",
        *counts,
        *[F.round(r, digits).alias(n) for n, r in ratios.items()],
        F.round(f1(ratios["changed_cell_precision"], ratios["changed_cell_recall"]), digits).alias("changed_cell_f1"),
        F.round("_f1", digits).alias("mean_example_f1"),
    )
