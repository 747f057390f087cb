"""Reports of unknown shape: one VARIANT column for whatever JSON they hold, look-up by path, and a row for each part that is malformed, missing or of another kind.

A report that is no JSON, or no object, doesn't end the job: it has a row that says so, and its look-ups are null. Kinds are object, array, string, number,
boolean and null; a path runs through objects by name ($.a.b) and through arrays by place ($.a[0]).
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

KINDS = ("object", "array", "string", "number", "boolean", "null")


def read_reports(spark: SparkSession, paths: str | list[str]) -> DataFrame:
    """path and report (VARIANT, null where the text is no JSON) of whole files."""
    rows = spark.read.text(paths, wholetext=True).select(F.col("_metadata.file_path").alias("path"), F.col("value").alias("text"))
    return parsed(rows, "text").drop("text")


def parsed(rows: DataFrame, text: str, alias: str = "report") -> DataFrame:
    """rows with their text as VARIANT; blank and malformed ones are null."""
    return rows.withColumn(alias, F.try_parse_json(text))


def kind(report: Column, path: str = "$") -> Column:
    """The kind of the part at a path; null where there is none. A part that is JSON's null is of the kind null."""
    told = F.schema_of_variant(F.try_variant_get(report, path, "variant"))
    return (
        F.when(told.startswith("OBJECT"), "object")
        .when(told.startswith("ARRAY"), "array")
        .when(told == "STRING", "string")
        .when(told == "BOOLEAN", "boolean")
        .when(told == "VOID", F.when(F.is_variant_null(F.try_variant_get(report, path, "variant")), "null"))
        .when(told.isNotNull(), "number")
    )


def nested(report: Column, path: str, want: str, cast: str) -> Column:
    """The part at a path if it is of the wanted kind and fits the type; else null."""
    return F.when(kind(report, path) == want, F.try_variant_get(report, path, cast))


def problems(rows: DataFrame, required: Mapping[str, str], *, key: str, report: str = "report") -> DataFrame:
    """A row (key, path, problem, found) for each report that is malformed or no object, and for each required part that is missing or of another kind."""
    if wrong := set(required.values()) - set(KINDS):
        raise ValueError(f"unknown kinds: {wrong}")
    whole, v = kind(F.col(report)), F.col(report)
    row = lambda path, problem, found: F.struct(F.lit(path).alias("path"), problem.alias("problem"), found.alias("found"))
    none = F.lit(None).cast("string")
    parts = []
    for path, want in required.items():
        own = kind(v, path)
        parts.append(F.when(own.isNull(), row(path, F.lit("missing"), none)).when(own != want, row(path, F.lit("wrong_kind"), own)))
    found = (
        F.when(v.isNull(), F.array(row("$", F.lit("malformed"), none)))
        .when(whole != "object", F.array(row("$", F.lit("not_an_object"), whole)))
        .otherwise(F.array_compact(F.array(*parts)))
    )
    return rows.select(key, F.explode(found).alias("p")).select(key, "p.*")


def first_text(report: Column, paths: Sequence[str], default: str) -> Column:
    """The first part of the paths that is a text and not empty, else the default; what is of another kind is passed over."""
    return F.coalesce(*[F.nullif(nested(report, p, "string", "string"), F.lit("")) for p in paths], F.lit(default))


def objective_version(rollout: Column, default: str) -> Column:
    """By which version of the objective a rollout report was scored: as its current side says, else its baseline, else the default."""
    return first_text(rollout, [f"$.rollout_metrics.{side}.fitness_objective_version" for side in ("current", "baseline")], default)


def context_text(context: Column) -> Column:
    """A policy's context (VARIANT: an array of objects and of pairs of observation and action) as JSON, with pairs as objects.

    Objects stay as they are. No context, or one that is no array, is null; a pair whose action is no number fails the job.
    """
    pair = lambda x: F.struct(F.coalesce(F.variant_get(x, "$[0]", "string"), F.lit("None")).alias("observation_text"), F.variant_get(x, "$[1]", "int").alias("action_id"))
    told = F.transform(F.try_variant_get(context, "$", "array<variant>"), lambda x: F.when(F.schema_of_variant(x).startswith("OBJECT"), F.to_json(x)).otherwise(F.to_json(pair(x))))
    return F.concat(F.lit("["), F.array_join(told, ","), F.lit("]"))
