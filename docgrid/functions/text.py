"""Column functions over text with Unicode rules, all inside code generation.

A null text gives null, or false where the result is boolean and says so.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

#: White space, letters, and characters of words as Unicode has them, for Java's regular expressions.
SPACE, LETTER, WORD = r"[\s\x0B\x1C-\x1F\x85\p{Z}]", r"\p{L}", r"\p{L}\p{N}_"
_END = rf"(?![{WORD}])"

#: The shapes of outline markers, numbering, sections and references to printed pages.
NUMBER = r"\d+(?:[.\-_]\d+)*"
MARKER = rf"^(?:{NUMBER}{_END}|[A-Z](?:\.\d+)+{_END}|[IVXLCDM]+\.(?=\s|$))"
LEVELLED = rf"^({NUMBER}|[A-Z](?:\.\d+)+){_END}"
LEADING = rf"^\s*((?:{NUMBER})|(?:[IVXLCDM]+\.))(?=\s|$)"
NUMBERING = rf"^(?:{NUMBER}|[A-Z](?:\.\d+)*)$"
NUMBERED = rf"^{NUMBER}{_END}"
ROMAN = r"^[IVXLCDM]+\.(?:\s+\S.*)?$"
PAGE_REF = r"(?:[A-Za-z]{1,12}-?)?\d{1,6}"
INDEX_LINE = rf"^(.+?)(?:\.{{2,}}|\s+)({PAGE_REF})$"
TERMINAL_REF = rf"(?:\.{{2,}}|\s+){PAGE_REF}\s*$"


def let(value: Column, use: Callable[[Column], Column]) -> Column:
    """``use`` of a value that is computed once, however often it is named."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def squeeze(text: Column) -> Column:
    """Runs of white space as one space, none at the ends."""
    return F.trim(F.regexp_replace(text, f"{SPACE}+", " "))


def squeeze_ends(text: Column) -> Column:
    """Text without white space at its ends."""
    return F.regexp_replace(text, f"^{SPACE}+|{SPACE}+$", "")


def fold(text: Column) -> Column:
    """Text for comparison without case: upper, then lower; ß agrees with ss and ς with σ."""
    return F.translate(F.replace(F.lower(F.upper(text)), F.lit("ß"), F.lit("ss")), "ς", "σ")


def fold_title(text: Column) -> Column:
    """A title for comparison: folded words with one space between them."""
    return F.trim(F.regexp_replace(fold(text), f"[^{WORD}]+", " "))


def clean_title(text: Column) -> Column:
    """A squeezed title without dots at its end."""
    return F.trim(F.regexp_replace(squeeze(text), r"\.{2,}$", ""))


def looks_like_title(text: Column, most: int) -> Column:
    """3 to ``most`` characters, two letters at least."""
    letters = F.char_length(F.regexp_replace(text, r"\P{L}+", ""))
    return F.coalesce(F.char_length(text).between(3, most) & (letters >= 2), F.lit(False))


def is_marked(text: Column) -> Column:
    return text.rlike(MARKER)


def is_numbering(text: Column) -> Column:
    return text.rlike(NUMBERING)


def is_roman(text: Column) -> Column:
    return text.rlike(ROMAN)


def is_upper(text: Column) -> Column:
    """Whether there are letters with case and all of them are capitals."""
    return text.rlike(r"\p{Lu}") & ~text.rlike(r"[\p{Ll}\p{Lt}]")


def outline_level(title: Column) -> Column:
    """1 for roman sections and unmarked titles, else the number of parts of the marker."""
    marker = F.regexp_extract(title, LEVELLED, 1)
    return F.when(is_roman(title) | (marker == ""), 1).otherwise(F.size(F.split(marker, r"[.\-_]")))


def leading_marker(title: Column) -> Column:
    """The numbering before a title, or an empty text."""
    return F.regexp_extract(title, LEADING, 1)


def numbering_score(left: Column, right: Column) -> Column:
    """1 for equal markers, 0.6 if one begins with the other, else 0."""
    a, b = leading_marker(left), leading_marker(right)
    return F.when((a == "") | (b == ""), 0.0).when(a == b, 1.0).when(a.startswith(b) | b.startswith(a), 0.6).otherwise(0.0)


def page_prefix(ref: Column) -> Column:
    """The namespace of a printed reference: its letters, folded; of the body, an empty text."""
    prefix = F.lower(F.regexp_extract(ref, r"^\s*([A-Za-z]{1,12})-?\d{1,6}\s*$", 1))
    return F.when(prefix == "body", "").otherwise(prefix)


def printed_number(ref: Column) -> Column:
    """The number of a printed reference, null if it is none."""
    return F.nullif(F.regexp_extract(ref, r"^\s*(?:[A-Za-z]{1,12}-?)?(\d{1,6})\s*$", 1), F.lit("")).cast("int")


def truncate(text: Column, most: int) -> Column:
    """Squeezed text, cut to ``most`` characters with an ellipsis as the last of them."""
    t = squeeze(text)
    return F.when(F.char_length(t) <= most, t).otherwise(F.concat(F.substring(t, 1, most - 1), F.lit("…")))


def squeeze_lines(text: Column) -> Column:
    """Each line squeezed, empty lines left out."""
    lines = F.split(text, r"\r\n|[\n\r\x0B\x0C\x1C-\x1E\x85  ]")
    return F.array_join(F.filter(F.transform(lines, squeeze), lambda t: t != ""), "\n")


def provider_name(class_name: Column) -> Column:
    """A class name in snake case, without Provider or CaptionProvider at its end; the two patterns are fixed values."""
    short = F.regexp_replace(class_name, r"(?:Caption)?Provider$", "")
    return F.lower(F.regexp_replace(F.when(short == "", class_name).otherwise(short), r"(?<!^)(?=[A-Z])", "_"))


def safe_component(name: Column) -> Column:
    """Whether a name can stand as one component of a path; false for null."""
    ok = (name != "") & (squeeze(F.substring(name, 1, 1)) != "") & (squeeze(F.substring(name, -1, 1)) != "")
    return F.coalesce(ok & ~name.isin(".", "..") & ~name.rlike(r"[/\\\x00-\x1F\x7F]"), F.lit(False))


def path_parts(path: Column) -> Column:
    """Components of a path of either slash, without empty ones and dots."""
    return F.filter(F.split(F.translate(path, "\\", "/"), "/"), lambda p: ~p.isin("", "."))


def safe_path(path: Column) -> Column:
    """Whether a relative path names something inside its root, links aside; false for null."""
    bad = path.rlike(r"^[/\\]|^[A-Za-z]:|[\x00-\x1F\x7F]") | (squeeze(path) == "")
    return F.coalesce(~bad & ~F.array_contains(path_parts(path), "..") & (F.size(path_parts(path)) > 0), F.lit(False))
