"""Column helpers for text with the semantics the data model asks for, built from JVM expressions only."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from .fixed import PUNCTUATION

#: Unicode classes, unix line ends; with and without case folding.
FOLDED, EXACT = "(?iUd)", "(?Ud)"


def matches(text: Column, pattern: str, folded: bool = True) -> Column:
    return text.rlike((FOLDED if folded else EXACT) + pattern)


def filled(text: Column) -> Column:
    """Missing text as the empty string; null, blank and ``nan`` are missing."""
    return F.coalesce(present(text), F.lit(""))


def strip(text: Column) -> Column:
    """Without white space of any kind at both ends."""
    return F.regexp_replace(text, r"(?U)^\s+|\s+$", "")


def present(text: Column) -> Column:
    """The stripped text, null where it is missing."""
    bare = strip(text)
    return F.when((bare != "") & (F.lower(bare) != "nan"), bare)


def first_present(*columns: Column) -> Column:
    return F.coalesce(*(present(c) for c in columns), F.lit(""))


def capitalised(text: Column) -> Column:
    """First letter in upper case and all others in lower case."""
    return F.concat(F.upper(F.substring(text, 1, 1)), F.lower(F.substr(text, F.lit(2))))


def slug(text: Column) -> Column:
    return F.regexp_replace(F.regexp_replace(F.lower(strip(text)), "[^a-z0-9.-]+", "-"), "^-+|-+$", "")


def title_key(text: Column) -> Column:
    return F.substring(strip(F.translate(F.lower(F.coalesce(text, F.lit(""))), PUNCTUATION, "")), 1, 60)


LINE_END = r"\r\n|[\n\r\u000B\f\u001C-\u001E\u0085  ]"


def lines(text: Column) -> Column:
    """The lines of a text, without an empty piece after the last line end."""
    parts = F.split(text, LINE_END)
    return F.when(F.element_at(parts, -1) == "", F.slice(parts, F.lit(1), F.size(parts) - 1)).otherwise(parts)


def first_match(text: Column, rules: tuple[tuple[str, str], ...], default: str | Column) -> Column:
    """The label of the first rule whose pattern occurs."""
    out = default if isinstance(default, Column) else F.lit(default)
    return reduce(lambda rest, rule: F.when(matches(text, rule[0]), rule[1]).otherwise(rest), reversed(rules), out)


def lookup(key: Column, values: dict[str, str], default: Column | None = None) -> Column:
    """The value of a key in a literal map."""
    pairs = [F.lit(x) for item in values.items() for x in item]
    found = F.try_element_at(F.create_map(*pairs), key)
    return found if default is None else F.coalesce(found, default)


def all_matches(text: Column, pattern: str, folded: bool = True) -> Column:
    return F.regexp_extract_all(text, F.lit((FOLDED if folded else EXACT) + pattern), F.lit(0))


def http_status(text: Column) -> Column:
    """The status code that an error text gives, as ``HTTP 422`` or as a JSON field; null where it gives none."""
    found = F.coalesce(*(F.nullif(F.regexp_extract(text, pattern, 1), F.lit("")) for pattern in (r"HTTP (\d{3})", r'"status":\s*(\d{3})')))
    return found.cast("int")


def first_version(constraint: Column) -> Column:
    """The first version of a constraint such as ``>= 1.16.9``; empty where there is none."""
    parts = F.split(strip(constraint), r"[\s,|&]+")
    bare = F.transform(parts, lambda t: F.regexp_replace(t, "^[><=^~!]+", ""))
    return F.coalesce(F.get(F.filter(bare, lambda t: t.rlike(r"^\d")), F.lit(0)), F.lit(""))


def url_quoted(text: Column) -> Column:
    """Percent-encoded with no character kept but letters, digits and ``_.-~``."""
    return F.replace(F.replace(F.url_encode(text), F.lit("+"), F.lit("%20")), F.lit("*"), F.lit("%2A")) if text is not None else text


def decoded_base64(text: Column) -> Column:
    """UTF-8 text of base64 in one or more lines; null where it is no base64."""
    return F.decode(F.try_to_binary(F.regexp_replace(text, r"\s+", ""), F.lit("base64")), "UTF-8")


def unfenced(answer: Column) -> Column:
    """An answer without the code fence around it."""
    bare = strip(answer)
    return F.when(bare.startswith("```"), strip(F.regexp_replace(F.regexp_replace(bare, r"^```[^\n]*(?:\n|$)", ""), r"(?:^|\n)[ \t]*```[ \t]*$", ""))).otherwise(bare)
