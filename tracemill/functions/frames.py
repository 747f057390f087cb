"""Rendering observations to text frames and taking frames apart again, as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .scalars import let

#: Fixed values of the frame format.
SECTIONS = ("MAP:", "MESSAGE:", "BLSTATS:", "INVENTORY:")
OBSERVATION_MARKER = "Current observation:\n"
#: What ends a line in a frame: LF, CR LF, CR, VT, FF, FS, GS, RS, NEL, LS, PS.
LINE_END = "\r\n|[\n\r\u000b\u000c\u001c\u001d\u001e\u0085  ]"
BLANKS = r"^\s+|\s+$"


def lines(text: Column) -> Column:
    """Lines without their ends; a final line end opens no further line, an empty text has none."""
    return let(F.split(text, LINE_END), lambda parts: F.when(F.element_at(parts, -1) == "", F.slice(parts, 1, F.size(parts) - 1)).otherwise(parts))


def strip(text: Column) -> Column:
    return F.regexp_replace(text, BLANKS, "")


def rstrip(text: Column) -> Column:
    return F.regexp_replace(text, r"\s+$", "")


def bytes_text(values: Column) -> Column:
    """Characters of the codes that are not 0, stripped."""
    return strip(F.array_join(F.transform(F.filter(values, lambda x: x != 0), lambda x: F.char(x)), ""))


def grid_text(grid: Column, *, compact: bool = False) -> Column:
    """Rows of codes as lines, 0 as space, ends trimmed; compact drops blank lines."""
    rows = F.transform(grid, lambda row: rstrip(F.array_join(F.transform(row, lambda x: F.when(x == 0, F.lit(" ")).otherwise(F.char(x))), "")))
    if compact:
        rows = F.filter(rows, lambda x: strip(x) != "")
    return rstrip(F.array_join(rows, "\n"))


def message_text(observation: Column, limit: int = 240) -> Column:
    return F.coalesce(F.nullif(F.substring(bytes_text(observation["message"]), 1, limit), F.lit("")), F.lit("<missing>"))


def blstat(observation: Column, index: int) -> Column:
    return F.get(observation["blstats"], F.lit(index)).try_cast("int")


def frame_text(observation: Column, *, compact: bool = False, message_limit: int = 240) -> Column:
    """MAP, MESSAGE, BLSTATS and INVENTORY sections; <missing> for what is not there, <empty> for an empty inventory."""

    def listed(x: Column) -> Column:
        return F.concat(F.lit("["), F.array_join(F.transform(x, lambda v: v.cast("string")), ", "), F.lit("]"))

    blstats, inventory = observation["blstats"], observation["inventory"]
    return F.concat_ws(
        "\n",
        F.lit("MAP:"),
        F.coalesce(F.nullif(grid_text(observation["tty_chars"], compact=compact), F.lit("")), F.lit("<missing>")),
        F.lit("MESSAGE:"),
        message_text(observation, message_limit),
        F.lit("BLSTATS:"),
        F.when(F.size(blstats) > 0, listed(blstats)).otherwise("<missing>"),
        F.lit("INVENTORY:"),
        F.when(F.size(inventory) > 0, listed(inventory)).when(F.size(inventory) == 0, "<empty>").otherwise("<missing>"),
    )


def section(text: Column, header: str) -> Column:
    """Lines after the first line equal to header, up to the next line in capitals that ends with a colon; '' if there is none."""
    is_header = lambda x: x.endswith(":") & (F.upper(x) == x) & (F.lower(x) != x)

    placed = let(lines(text), lambda x: F.struct(x.alias("lines"), F.array_position(x, header).cast("int").alias("k")))
    rest = let(placed, lambda s: F.when(s["k"] > 0, F.slice(s["lines"], s["k"] + 1, F.size(s["lines"]))))
    placed = let(rest, lambda x: F.struct(x.alias("lines"), F.array_position(F.transform(x, is_header), True).cast("int").alias("k")))
    own = let(placed, lambda s: F.when(s["k"] > 0, F.slice(s["lines"], 1, s["k"] - 1)).otherwise(s["lines"]))
    return F.coalesce(F.array_join(own, "\n"), F.lit(""))


def tolerant_section(text: Column, name: str) -> Column:
    """Lines under ``name:`` headers, which may be indented; only the four required names open a section. NULL if there is none."""
    tagged = F.aggregate(
        lines(text),
        F.struct(F.lit(None).cast("string").alias("at"), F.lit(False).alias("seen"), F.array().cast("array<string>").alias("out")),
        lambda acc, x: F.struct(
            F.when(strip(x).isin(*SECTIONS), strip(x)).otherwise(acc["at"]).alias("at"),
            (acc["seen"] | (strip(x) == f"{name}:")).alias("seen"),
            F.when(~strip(x).isin(*SECTIONS) & (acc["at"] == f"{name}:"), F.concat(acc["out"], F.array(x))).otherwise(acc["out"]).alias("out"),
        ),
    )
    return let(tagged, lambda t: F.when(t["seen"], F.array_join(t["out"], "\n")))


def map_cells(text: Column) -> Column:
    """array<struct<row, col, char>> of the MAP section."""
    rows = F.transform(
        lines(section(text, "MAP:")),
        lambda line, r: F.transform(F.filter(F.split(line, ""), lambda c: c != ""), lambda c, k: F.struct(r.alias("row"), k.alias("col"), c.alias("char"))),
    )
    return F.flatten(rows)


def map_grid(text: Column) -> Column:
    """array<array<string>> of the characters of the MAP section by line."""
    return F.transform(lines(section(text, "MAP:")), lambda line: F.filter(F.split(line, ""), lambda c: c != ""))


def player_position(cells: Column) -> Column:
    """struct<row, col> of the only '@', NULL if there are none or several."""
    return let(F.filter(cells, lambda c: c["char"] == "@"), lambda found: F.when(F.size(found) == 1, F.struct(found[0]["row"].alias("row"), found[0]["col"].alias("col"))))


def blstats_values(text: Column) -> Column:
    """array<string> of the BLSTATS section: JSON, or a Python literal with single quotes, None, True and False; else NULL."""

    def parsed(own: Column) -> Column:
        literal = F.regexp_replace(F.regexp_replace(F.regexp_replace(F.regexp_replace(own, "'", '"'), r"\bNone\b", "null"), r"\bTrue\b", "true"), r"\bFalse\b", "false")
        return F.when((own != "") & (own != "<missing>") & own.startswith("["), F.coalesce(F.from_json(own, "array<string>"), F.from_json(literal, "array<string>")))

    return let(strip(section(text, "BLSTATS:")), parsed)


def normalized_message(text: Column) -> Column:
    """The MESSAGE section, white space collapsed, lower-cased (casefold differs for a few letters, such as sharp s)."""
    return F.lower(F.trim(F.regexp_replace(section(text, "MESSAGE:"), r"\s+", " ")))


def matching_characters(a: Column, b: Column) -> Column:
    """Places at which both texts have the same character."""
    pairs = F.zip_with(F.filter(F.split(a, ""), lambda c: c != ""), F.filter(F.split(b, ""), lambda c: c != ""), lambda x, y: F.when(x == y, 1).otherwise(0))
    return F.aggregate(pairs, F.lit(0), lambda acc, x: acc + F.coalesce(x, F.lit(0)))


def longest_length(a: Column, b: Column) -> Column:
    return F.greatest(F.length(a), F.length(b))


def char_accuracy(a: Column, b: Column) -> Column:
    """Matching places over the longer length; 1.0 for two empty texts."""
    total = longest_length(a, b)
    return F.when(total == 0, F.lit(1.0)).otherwise(matching_characters(a, b) / total)


def after_last_marker(text: Column, marker: str = OBSERVATION_MARKER) -> Column:
    """What follows the last marker; the whole text where there is none."""
    return F.substring_index(text, marker, -1)


def after_first_marker(text: Column, marker: str = OBSERVATION_MARKER) -> Column:
    """What follows the first marker, NULL where there is none; line feeds at its end are cut."""
    at = F.locate(marker, text)
    return F.when(at > 0, F.regexp_replace(F.substr(text, at + len(marker)), "\n+$", ""))


def last_content(messages: Column, role: str) -> Column:
    """The content of the last message of a role, NULL if there is none."""
    own = F.filter(messages, lambda m: m["role"] == role)
    return F.when(F.size(own) > 0, F.element_at(own, -1)["content"])


def parsed_response(text: Column) -> Column:
    """struct<frame, error> of a model's response: raw frame text, or {"next_frame": text} alone."""
    own = strip(text)
    keys = F.json_object_keys(own)
    kind = F.schema_of_variant(F.try_parse_json(own))
    value = F.get_json_object(own, "$.next_frame")
    is_text = F.schema_of_variant(F.try_variant_get(F.try_parse_json(own), "$.next_frame", "variant")) == "STRING"
    error = (
        F.when(own.startswith("MAP:"), F.lit(None).cast("string"))
        .when(kind.isNull(), "invalid next-frame JSON")
        .when(~F.coalesce(F.array_size(keys) == 1, F.lit(False)) | (F.get(keys, F.lit(0)) != "next_frame"), "expected only next_frame in model output")
        .when(~F.coalesce(is_text, F.lit(False)), "next_frame must be a string")
    )
    return F.struct(F.when(error.isNull(), F.when(own.startswith("MAP:"), own).otherwise(value)).alias("frame"), error.alias("error"))


def parse_failure(text: Column, error: Column) -> Column:
    """truncated_json, invalid_json, wrong_schema or wrong_value_type for a parser error, NULL for none."""
    own = strip(text)
    truncated = own.startswith("{") & F.contains(F.substring(own, 1, 80), F.lit('"next_frame"')) & (~own.endswith("}") | own.endswith("\\"))
    return (
        F.when(error.isNull(), F.lit(None).cast("string"))
        .when(error == "expected only next_frame in model output", "wrong_schema")
        .when(error == "next_frame must be a string", "wrong_value_type")
        .when((error == "invalid next-frame JSON") & truncated, "truncated_json")
        .otherwise("invalid_json")
    )


def sample_text(text: Column, limit: int = 2000) -> Column:
    return F.when(F.length(text) > limit, F.concat(F.substring(text, 1, limit), F.lit("\n<truncated>"))).otherwise(text)


def frame_validation(frame: Column, truth: Column | None = None) -> Column:
    """Struct of checks on a frame: sections, player glyph, 27 numeric BLSTATS; against a true frame, exactness by section."""
    taken = F.struct(*[tolerant_section(frame, n).alias(n) for n in ("MAP", "MESSAGE", "BLSTATS", "INVENTORY")])
    return let(taken, lambda own: _validated(own, frame, truth))


def _validated(own: Column, frame: Column, truth: Column | None) -> Column:
    own = {n: own[n] for n in ("MAP", "MESSAGE", "BLSTATS", "INVENTORY")}
    missing = F.filter(F.array(*[F.when(v.isNull(), F.lit(n)) for n, v in own.items()]), lambda x: x.isNotNull())
    map_lines = F.size(F.filter(F.coalesce(lines(own["MAP"]), F.array().cast("array<string>")), lambda x: strip(x) != ""))
    first = F.get(F.filter(F.transform(lines(own["BLSTATS"]), strip), lambda x: x != ""), F.lit(0))
    values = F.when(first.startswith("["), F.from_json(first, "array<string>"))
    numeric = F.coalesce(F.forall(values, lambda v: v.try_cast("double").isNotNull()), F.lit(False))
    has_player = F.contains(F.coalesce(own["MAP"], F.lit("")), F.lit("@"))
    text = lambda x: F.regexp_replace(F.coalesce(x, F.lit("")), "^\n+|\n+$", "")
    fields = [
        (F.size(missing) == 0).alias("rendered_frame_parse_valid"),
        ((F.size(missing) == 0) & (map_lines > 0) & has_player & numeric & F.coalesce(F.size(values) == 27, F.lit(False))).alias("observation_shape_valid"),
        missing.alias("missing_sections"),
        map_lines.alias("map_nonempty_line_count"),
        has_player.alias("map_has_player_glyph"),
        values.isNotNull().alias("blstats_parse_valid"),
        F.when(values.isNotNull(), F.size(values)).alias("blstats_length"),
    ]
    if truth is not None:
        fields += [(frame == truth).alias("ground_truth_exact_match"), char_accuracy(frame, truth).alias("char_accuracy")]
        fields += [(text(own[n]) == text(tolerant_section(truth, n))).alias(f"{n.lower()}_exact_match") for n in ("MAP", "MESSAGE", "BLSTATS")]
    return F.struct(*fields)
