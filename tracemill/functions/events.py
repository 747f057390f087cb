"""Predicates and map tiles of rollout events, as column expressions over message, hunger, death and frame texts."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

from . import frames
from .scalars import let

#: What marks walls, bad outcomes and prompts in lower-cased status text.
WALL_MARKERS = ("wall", "solid stone")
BAD_MARKERS = (
    "you don't have",
    "you cannot",
    "you can't",
    "can't ",
    "cannot ",
    "never mind",
    "what a strange direction",
    "not possible",
    "nothing happens",
    "there is nothing",
    "don't know how",
    "not enough",
)
PROMPT_MARKERS = (
    "--more--",
    "-- more --",
    "extended commands list",
    "extended commands",
    "voluntary challenges:",
    "(1 of ",
    "(2 of ",
    "(3 of ",
    "(4 of ",
    "(5 of ",
    "what do you want",
    "in what direction",
    "which object",
    "pick up",
    "really ",
    "call ",
    "name ",
    "[yn",
    "[ynq",
)
#: Fixed value: characters that count as map tiles.
MAP_CHARACTERS = '|-+.#@<>$()[]{}%?!/\\"=_*,`^'


def has_any(text: Column, markers: tuple[str, ...]) -> Column:
    """Whether text holds one of the markers: one pattern, as an expression for each makes plans of thousands of nodes."""
    return text.rlike("|".join(map(re.escape, markers)))


def status_text(message: Column, hunger: Column, death: Column, frame: Column) -> Column:
    return F.lower(F.concat_ws(" ", *[F.coalesce(x.cast("string"), F.lit("")) for x in (message, hunger, death, frame)]))


def _names(prefix: str = "") -> tuple[Column, ...]:
    return tuple(F.col(f"{prefix}{c}") for c in ("message", "hunger", "death", "terminal_frame"))


def is_wall(prefix: str = "") -> Column:
    message, _, _, frame = _names(prefix)
    return has_any(F.lower(F.coalesce(message, F.lit(""))), WALL_MARKERS) | has_any(F.lower(F.coalesce(frame, F.lit(""))), WALL_MARKERS)


def is_prompt(prefix: str = "") -> Column:
    return F.coalesce(F.col(f"{prefix}menu_open"), F.lit(False)) | has_any(status_text(*_names(prefix)), PROMPT_MARKERS)


def is_bad(prefix: str = "") -> Column:
    return is_wall(prefix) | is_prompt(prefix) | has_any(status_text(*_names(prefix)), BAD_MARKERS)


def is_hunger_warning(prefix: str = "") -> Column:
    text = status_text(*_names(prefix))
    return ~F.contains(text, F.lit("not hungry")) & has_any(text, ("hungry", "hunger"))


def is_starving(prefix: str = "") -> Column:
    return has_any(status_text(*_names(prefix)), ("starv", "faint"))


def has_died(prefix: str = "") -> Column:
    return F.coalesce(F.col(f"{prefix}death"), F.lit("")) != ""


def stands_still(prefix: str = "") -> Column:
    return F.coalesce(~F.col(f"{prefix}game_time_advanced"), F.lit(False))


def is_dirty(prefix: str = "") -> Column:
    return is_bad(prefix) | stands_still(prefix) | has_died(prefix)


def is_map_row(line: Column) -> Column:
    """A line that looks like map: with '@', or two tiles with walls or stairs, or three tiles that are half of it."""
    own = frames.strip(line)
    tiles = F.length(own) - F.length(F.regexp_replace(own, "[" + re.escape(MAP_CHARACTERS) + "]", ""))
    return F.when(tiles == 0, False).when(F.contains(own, F.lit("@")), True).when(own.rlike(r"[|\-+<>]"), tiles >= 2).otherwise((tiles >= 3) & (tiles / F.length(own) >= 0.5))


def map_tiles(frame: Column) -> Column:
    """array<string> row:col:char of the tiles between the lines MAP: and MESSAGE: of a frame."""
    return let(frames.lines(F.coalesce(frame, F.lit(""))), _tiles)


def _tiles(all_lines: Column) -> Column:
    start = F.array_position(all_lines, "MAP:").cast("int")
    placed = let(F.slice(all_lines, start + 1, F.size(all_lines)), lambda x: F.struct(x.alias("lines"), F.array_position(x, "MESSAGE:").cast("int").alias("k")))
    own = let(placed, lambda s: F.when(s["k"] > 0, F.slice(s["lines"], 1, s["k"] - 1)).otherwise(s["lines"]))
    found = F.transform(
        own,
        lambda line, r: F.when(
            is_map_row(line),
            F.filter(
                F.transform(F.split(line, ""), lambda c, k: F.when(F.contains(F.lit(MAP_CHARACTERS), c) & (c != ""), F.concat_ws(":", r.cast("string"), k.cast("string"), c))),
                lambda x: x.isNotNull(),
            ),
        ).otherwise(F.array().cast("array<string>")),
    )
    return F.when(start > 0, F.array_distinct(F.flatten(found))).otherwise(F.array().cast("array<string>"))
