"""Text expressions: stripping, fences, token estimates and Markdown tables."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: White space as Python's ``str.strip`` sees it: Unicode spaces and the separators U+001C to U+001F.
_SPACE = r"[\s\x1c-\x1f]"
TABLE_LINE = r"^\|.+\|$"


def strip(x: Column) -> Column:
    return F.regexp_replace(x, rf"(?U)^{_SPACE}+|{_SPACE}+$", "")


def casefold(x: Column) -> Column:
    """Lower case with sharp s spelt out; rarer foldings stay as ``lower`` leaves them."""
    return F.replace(F.lower(x), F.lit("ß"), F.lit("ss"))


def is_absent(x: Column) -> Column:
    return x.isNull() | (strip(x) == "")


def estimate_tokens(text: Column) -> Column:
    """Four characters a token, rounded down."""
    return F.floor(F.length(text) / 4).cast("int")


def strip_fences(x: Column) -> Column:
    """The inside of the first code fence, else the text; stripped."""
    inner = F.regexp_extract(x, r"(?s)```(?:json)?\s*\n?(.*?)```", 1)
    return strip(F.when(x.rlike(r"(?s)```(?:json)?\s*\n?.*?```"), inner).otherwise(x))


def is_table_line(line: Column) -> Column:
    return line.rlike(TABLE_LINE)


def is_separator(line: Column, strict: bool = False) -> Column:
    """A table line without an ASCII letter; ``strict`` asks for dashes, colons, bars and spaces only."""
    return is_table_line(line) & (line.rlike(r"^[|\s:-]*-[|\s:-]*$") if strict else ~line.rlike("[a-zA-Z]"))


def is_table_text(text: Column) -> Column:
    """At least ten lines with text, half of them table rows (separators count as lines only)."""
    lines = F.filter(F.transform(F.split(text, "\r?\n"), strip), lambda x: x != "")
    rows = F.filter(lines, lambda x: is_table_line(x) & ~is_separator(x))
    return (F.size(lines) >= 10) & (F.size(rows) * 2 >= F.size(lines))


def markdown_row(cells: Column, width: int | None = None, header: bool = False) -> Column:
    """``| a | b |``: body cells escape bars and flatten newlines, header cells do not; padded or cut to ``width``."""
    cells = F.transform(cells, lambda c: F.coalesce(c, F.lit("")))
    if width is not None:
        cells = F.slice(F.concat(cells, F.array_repeat(F.lit(""), width)), 1, width)
    if not header:
        cells = F.transform(cells, lambda c: F.translate(F.replace(c, F.lit("|"), F.lit("\\|")), "\n", " "))
    return F.concat(F.lit("| "), F.array_join(cells, " | "), F.lit(" |"))


def page_header(page_index: Column, text: Column) -> Column:
    return F.concat(F.lit("# Page "), (page_index + 1).cast("string"), F.lit("\n\n"), text, F.lit("\n"))
