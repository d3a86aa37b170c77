"""Whole-text measures, line and block tables, and file names."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# The characters that count as white space at the ends of a text.
WHITESPACE = (
    "\t\n\x0b\x0c\r\x1c\x1d\x1e\x1f \x85\xa0"
    "\u1680\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007"
    "\u2008\u2009\u200a\u2028\u2029\u202f\u205f\u3000"
)

# Characters that end a line; CR directly before LF belongs to it.
LINE_BREAKS = r"\n\r\x0b\x0c\x1c\x1d\x1e\x{85}\x{2028}\x{2029}"
# Any of them but CR before LF; led by the class, which is tried at every character.
_BREAK = rf"[{LINE_BREAKS}](?<!\r(?=\n))"


def strip(text: Column) -> Column:
    return F.btrim(text, F.lit(WHITESPACE))


def break_count(text: Column) -> Column:
    return F.regexp_count(text, F.lit(_BREAK))


def ends_with_break(text: Column) -> Column:
    return F.right(text, F.lit(1)).rlike(f"[{LINE_BREAKS}]")


def line_count(text: Column) -> Column:
    """Lines of a text; a break at the very end starts no further line."""
    unfinished = (F.length(text) > 0) & ~ends_with_break(text)
    return break_count(text) + unfinished.cast("int")


def latin1(text: Column, first: int | None = None) -> Column:
    """Replace each character above U+00FF by ``?``, after an optional cut."""
    if first is not None:
        text = F.substring(text, 1, first)
    return F.regexp_replace(text, r"[^\x00-\xFF]", "?")


def data_url(content: Column, mime: str) -> Column:
    encoded = F.regexp_replace(F.base64(content), r"\s", "")
    return F.concat(F.lit(f"data:{mime};base64,"), encoded)


def lines(text: Column) -> Column:
    """Array of the parts between newlines."""
    return F.split(text, "\n", -1)


def markdown_blocks(text: Column) -> Column:
    """Array of ``struct(kind, level, text)`` for the non-blank lines of a text."""

    def block(line: Column) -> Column:
        def kind(prefix: str, name: str, level: int | None) -> Column:
            return F.struct(
                F.lit(name).alias("kind"),
                F.lit(level).cast("int").alias("level"),
                F.substring(line, len(prefix) + 1, 2147483647).alias("text"),
            )

        return (
            F.when(line.startswith("### "), kind("### ", "heading", 3))
            .when(line.startswith("## "), kind("## ", "heading", 2))
            .when(line.startswith("# "), kind("# ", "heading", 1))
            .when(line.startswith("- ") | line.startswith("* "), kind("- ", "bullet", None))
            .otherwise(kind("", "paragraph", None))
        )

    stripped = F.transform(lines(text), strip)
    return F.transform(F.filter(stripped, lambda line: line != ""), block)


def plain_path(path: Column) -> Column:
    """A path from file metadata, which is URL-encoded but for plus signs, in plain text.

    Local paths come with one slash or three, depending on how they were given.
    """
    decoded = F.url_decode(F.replace(path, F.lit("+"), F.lit("%2B")))
    plain = F.when(path.contains("%"), decoded).otherwise(path)
    local = F.regexp_replace(plain, r"\Afile:/+", "file:///")
    return F.when(path.startswith("file:"), local).otherwise(plain)


def base_name(path: Column) -> Column:
    return F.substring_index(path, "/", -1)


def folder_name(path: Column) -> Column:
    return F.regexp_replace(path, r"/[^/]*\z", "")


def extension(name: Column) -> Column:
    """Last dot and what follows it; leading dots do not count. Case is kept."""
    return F.regexp_extract(name, r"(?s)\A\.*[^.].*?(\.[^.]*)\z", 1)


def stem(name: Column) -> Column:
    """The name without its :func:`extension`."""
    return F.substring(name, F.lit(1), F.length(name) - F.length(extension(name)))


# File kinds and their extensions.
FILE_KINDS = {
    "Images": [".jpg", ".jpeg", ".png", ".gif", ".bmp", ".tiff"],
    "Videos": [".mp4", ".avi", ".mov", ".wmv", ".mkv"],
    "Audio": [".mp3", ".wav", ".aac", ".ogg"],
    "Documents": [".txt", ".pdf", ".doc", ".docx", ".xls", ".xlsx"],
}
OTHER_FILES = "Others"


def file_kind(name: Column, kinds: dict[str, list[str]] | None = None) -> Column:
    suffix = F.lower(extension(name))
    pairs = [
        F.lit(part)
        for label, suffixes in (kinds or FILE_KINDS).items()
        for one in suffixes
        for part in (one, label)
    ]
    if not pairs:
        return F.lit(OTHER_FILES)
    return F.coalesce(F.try_element_at(F.create_map(*pairs), suffix), F.lit(OTHER_FILES))
