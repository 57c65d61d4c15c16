"""Text functions as column expressions; none of them leaves the JVM."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

# Common English words that searches leave out; a list of this engine's own, and a parameter everywhere.
STOP_WORDS = ["a", "about", "after", "all", "also", "an", "and", "any", "are", "as", "at", "be", "been", "but", "by", "can", "do", "for", "from", "has", "have", "how", "if", "in", "into", "is", "it", "its", "more", "no", "not", "of", "on", "or", "other", "so", "such", "than", "that", "the", "their", "then", "there", "these", "they", "this", "to", "was", "we", "were", "what", "when", "which", "who", "will", "with", "you", "your"]

#: Java's \b knows all Unicode letters; these bounds know ASCII ones only.
LEFT, RIGHT = "(?<![A-Za-z0-9_])", "(?![A-Za-z0-9_])"


def tokens(text: Column, stop: list[str] | None = None, unicode: bool = False) -> Column:
    """Lower-case words of two or more characters without stop words. ASCII letters and digits only, so accented letters separate, unless `unicode`."""
    pattern = r"[^\p{L}\p{N}]+" if unicode else "[^a-z0-9]+"
    words = F.split(F.regexp_replace(F.lower(text), pattern, " "), " ")
    keep = F.filter(words, lambda w: F.length(w) > 1)
    stop = STOP_WORDS if stop is None else stop
    return F.filter(keep, lambda w: ~w.isin(stop)) if stop else keep


def pad_end(text: Column, width: int) -> Column:
    """A text with blanks behind it up to a width; longer texts stay whole."""
    return F.when(F.length(text) < width, F.rpad(text, width, " ")).otherwise(text)


def pad_start(text: Column, width: int) -> Column:
    return F.when(F.length(text) < width, F.lpad(text, width, " ")).otherwise(text)


# The commands that write, print and interpret, by which a command line that changes a folder is told.
WRITERS = ["mv", "cp", "rm", "sed", "tee", "chmod", "mkdir", "touch", "install", "ln"]
INTERPRETERS = ["python", "node", "ruby", "perl"]


def write_pattern(folder: str) -> str:
    """A pattern for lines that write below a folder: a redirection or a writing command before it, a redirection behind it, or an interpreter that is told of it."""
    before = ">|(?:" + "|".join(WRITERS) + ") |" + "|".join(INTERPRETERS)
    name = re.escape(folder)
    return f"(?:{before})[^\n]*{name}|{name}[^\n]*>"


def writes_below(command: Column, folder: str) -> Column:
    return command.rlike(write_pattern(folder))


def slug(text: Column) -> Column:
    return F.regexp_replace(F.regexp_replace(F.lower(text), "[^a-z0-9]+", "-"), "^-|-$", "")


def html_escape(text: Column) -> Column:
    for raw, safe in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;")):
        text = F.replace(text, F.lit(raw), F.lit(safe))
    return text


def inline_markup(text: Column) -> Column:
    """`code` and **bold** spans of escaped text as HTML."""
    return F.regexp_replace(F.regexp_replace(html_escape(text), "`([^`]+)`", "<code>$1</code>"), r"\*\*([^*]+)\*\*", "<strong>$1</strong>")


def html_to_prose(html: Column) -> Column:
    """Markup as blanks: scripts and styles with their content, then all tags. Attributes go, character references stay."""
    text = F.regexp_replace(html, r"(?is)<script[^>]*>.*?</script>", " ")
    text = F.regexp_replace(text, r"(?is)<style[^>]*>.*?</style>", " ")
    return F.regexp_replace(text, r"(?s)<[^>]*>", " ")


def first_sentence(text: Column) -> Column:
    return F.regexp_extract(text, r"^(?s)(.*?[.!?])(?:\s|$)", 1)


def word_count(text: Column) -> Column:
    trimmed = F.trim(F.regexp_replace(text, r"\s+", " "))
    return F.when(trimmed == "", F.lit(0)).otherwise(F.size(F.split(trimmed, " "))).cast("long")


def around(text: Column, hit: Column, before: int = 40, after: int = 60) -> Column:
    """The hit with some characters on both sides."""
    at = F.locate(hit, text) if isinstance(hit, str) else F.call_function("locate", hit, text)
    start = F.greatest(at - before, F.lit(1))
    return F.when(at > 0, F.substr(text, start, at - start + after))


def shortened(text: Column, most: int) -> Column:
    return F.when(F.length(text) > most, F.concat(F.substring(text, 1, most), F.lit("..."))).otherwise(text)


def version_in(text: Column) -> Column:
    """The first a.b.c version in a text, or null."""
    found = F.regexp_extract(text, r"([0-9]+\.[0-9]+\.[0-9]+)", 1)
    return F.when(found != "", found)


def version_parts(version: Column) -> Column:
    """A version as integers, for comparisons by order."""
    return F.transform(F.split(version, r"\."), lambda p: p.cast("int"))


def basename(path: Column) -> Column:
    return F.element_at(F.split(path, "/"), -1)


def age_band(day: Column, today: Column, fresh: int = 45, aging: int = 90) -> Column:
    """fresh, aging or expired by the age in days; never stored, always taken at reading."""
    age = F.datediff(today, day)
    return F.when(age <= fresh, "fresh").when(age <= aging, "aging").otherwise("expired")


def iso_date(text: Column) -> Column:
    """A date of exactly the form YYYY-MM-DD, else null."""
    return F.when(text.rlike("^[0-9]{4}-[0-9]{2}-[0-9]{2}$"), F.try_to_date(text, "yyyy-MM-dd"))


def whole(text: Column) -> Column:
    """Whether a text is a whole number without anything around it, of however many digits."""
    return text.rlike(r"\A-?[0-9]+\z")


def integer(text: Column) -> Column:
    """A whole number without anything around it, else null."""
    return F.when(text.rlike("^-?[0-9]+$"), text.try_cast("bigint"))


def table_rows(markdown: Column) -> Column:
    """Cells of a Markdown table's lines, the separator row left out."""
    lines = F.filter(F.split(markdown, "\n"), lambda x: x.rlike(r"^\s*\|") & ~x.rlike(r"^\s*\|[\s:|-]+\|\s*$"))
    cells = F.transform(lines, lambda x: F.split(F.regexp_replace(F.trim(x), r"^\||\|$", ""), r"\|"))
    return F.transform(cells, lambda row: F.transform(row, lambda c: F.trim(c)))


def row_date(text: Column, capture: Column) -> Column:
    """A row's own date, or where it has none that of the capture."""
    return F.coalesce(iso_date(text), capture)


def bracketed(text: Column) -> Column:
    """The items of the first [a, b] list of a text, trimmed; an empty list where there is none."""
    inside = F.regexp_extract(text, r"\[([^\]]*)\]", 1)
    return F.filter(F.transform(F.split(inside, ","), lambda x: F.trim(x)), lambda x: x != "")
