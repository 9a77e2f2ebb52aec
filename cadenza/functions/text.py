"""Text and list expressions. All of them compile to JVM code; none is a Python UDF."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

_BLANKS = " \t\n\r\x0b\x0c"

# Separators between a title and its artist in a search key, by style.
KEY_SEPARATORS = {"by": " by ", "dash": " - "}


def _col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def strip(c: Column | str) -> Column:
    """Drop blanks of every kind from both ends; NULL stays NULL."""
    return F.btrim(_col(c).cast("string"), F.lit(_BLANKS))


def capitalise(c: Column | str) -> Column:
    """First character upper, everything else lower."""
    c = _col(c)
    return F.concat(F.upper(F.substring(c, 1, 1)), F.lower(c.substr(F.lit(2), F.length(c))))


def same_text(a: Column | str, b: Column | str) -> Column:
    """Case-insensitive equality."""
    return F.lower(_col(a)) == F.lower(_col(b))


def has_text(haystack: Column | str, needle: Column | str, regex: bool = False) -> Column:
    """Case-insensitive containment; ``needle`` is literal text unless ``regex`` is set."""
    if regex:
        pattern = F.lit(needle) if isinstance(needle, str) else needle
        return F.regexp_like(_col(haystack), F.concat(F.lit("(?i)"), pattern))
    literal = F.lit(needle) if isinstance(needle, str) else needle
    return F.contains(F.lower(_col(haystack)), F.lower(literal))


def parse_list(c: Column | str) -> Column:
    """Text such as ``['A', "B's"]`` to an array of strings; anything unreadable becomes NULL."""
    return F.from_json(
        _col(c),
        "array<string>",
        {"allowSingleQuotes": "true", "allowBackslashEscapingAnyCharacter": "true"},
    )


def first_of(array: Column | str) -> Column:
    """First element, or NULL for an empty or missing array."""
    return F.get(_col(array), F.lit(0))


def first_artist(c: Column | str) -> Column:
    return first_of(parse_list(c))


def bare_artists(c: Column | str) -> Column:
    """The list text without brackets and single quotes."""
    return F.translate(_col(c), "[]'", "")


def artists_line(c: Column | str, tidy: bool = True) -> Column:
    """Artists joined by a comma and a blank.

    Elements after the first carry the blank that followed their comma in the list text; ``tidy``
    removes it, ``tidy=False`` keeps the doubled blank.
    """
    parts = F.split(bare_artists(c), ",")
    if tidy:
        parts = F.transform(parts, strip)
    return F.array_join(parts, ", ")


def by_line(name: Column | str, artists: Column | str, tidy: bool = True, trimmed: bool = True) -> Column:
    """Tab-led ``title by artists`` line."""
    title, people = _col(name), artists_line(artists, tidy)
    if trimmed:
        title, people = strip(title), strip(people)
    return F.concat(F.lit("\t"), title, F.lit(" by "), people)


def inner_text(c: Column | str) -> Column:
    """The text without its first two and last two characters (one-artist list text)."""
    c = _col(c)
    return c.substr(F.lit(3), F.greatest(F.length(c) - 4, F.lit(0)))


def dash_line(left: Column | str, right: Column | str) -> Column:
    return F.concat(_col(left), F.lit(" - "), _col(right))


def search_key(title: Column | str, artist: Column | str | None, style: str = "by") -> Column:
    """Text a request is matched on: title and artist joined in ``style``, or the title alone."""
    if style == "title":
        return _col(title)
    return F.concat(_col(title), F.lit(KEY_SEPARATORS[style]), _col(artist))


def cleaned(c: Column | str) -> Column:
    """Lower case, keeping only ASCII letters, digits and blanks."""
    return F.regexp_replace(F.lower(_col(c)), "[^a-z0-9 ]", "")


def track_id_from_href(c: Column | str) -> Column:
    """Path part after ``/track/``; NULL when the address has none."""
    found = F.regexp_extract(_col(c), "/track/([^/?]+)", 1)
    return F.when(found != "", found)


def is_missing(c: Column | str) -> Column:
    """NULL or NaN, for numeric columns."""
    c = _col(c)
    return c.isNull() | F.isnan(c)
