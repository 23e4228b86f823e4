"""Text helpers: cleaning, names, ids, ordered first-match rules."""

from __future__ import annotations

import re
from collections.abc import Mapping, Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

from furrow import dims

# Every character Unicode counts as white space besides the plain blank, spelled
# out so that each regex dialect agrees.  Fixed value.
OTHER_BLANKS = (r"\t\n\x0b\f\r\x1c-\x1f\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}"
                r"\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}")
# Runs of white space that are not already one plain blank: those need no rewrite.
BLANK_RUNS = rf" [ {OTHER_BLANKS}]+|[{OTHER_BLANKS}][ {OTHER_BLANKS}]*"


def key(c: Column) -> Column:
    return F.lower(F.trim(c))


def blank_to_null(c: Column) -> Column:
    return F.when(F.trim(c) != "", c)


def first_present(*cols: Column) -> Column:
    """First value that is neither null nor empty text."""
    return F.coalesce(*[F.nullif(c, F.lit("")) for c in cols])


def strip_markup(c: Column) -> Column:
    """Tags become blanks, runs of white space become one blank."""
    plain = F.regexp_replace(F.coalesce(c, F.lit("")), "<[^>]+>", " ")
    return F.trim(F.regexp_replace(plain, BLANK_RUNS, " "))


def content_id(prefix: str, *parts: Column) -> Column:
    joined = F.concat(*[F.coalesce(p, F.lit("")) for p in parts])
    return F.concat(F.lit(prefix), F.substring(F.sha2(joined, 256), 1, 16))


def lookup(c: Column, table: Mapping[str, object]) -> Column:
    """Constant-table lookup; null on a miss."""
    pairs = [F.lit(x) for kv in table.items() for x in kv]
    return F.try_element_at(F.create_map(*pairs), c)


def normalize_state(c: Column, title_on_miss: bool = True) -> Column:
    """Known spelling to canonical name; otherwise title case, or the trimmed text."""
    raw = F.trim(c)
    miss = title_case(raw) if title_on_miss else raw
    return F.when(raw != "", F.coalesce(lookup(F.lower(raw), dims.STATE_SPELLINGS), miss))


def exact_crop(c: Column) -> Column:
    return lookup(key(c), dims.COMMODITY_CROPS)


def contained_crop(c: Column) -> Column:
    text = key(c)
    return F.coalesce(*[F.when(text.contains(part), F.lit(crop)) for part, crop in dims.COMMODITY_FRAGMENTS])


def first_named(text: Column, names: Sequence[str], default: str | None = None, low: Column | None = None) -> Column:
    """First name, in list order, that occurs as a whole word in any case.

    A plain containment test on the lower-case text guards each pattern, so the
    regex engine only sees texts that can match.  Pass ``low`` when the caller
    already has the lower-case text as a column.
    """
    low = F.lower(text) if low is None else low
    rules = [F.when(low.contains(n.lower()) & text.rlike(rf"(?iU)\b{re.escape(n)}\b"), F.lit(n)) for n in names]
    if default is not None:
        rules.append(F.lit(default))
    return F.coalesce(*rules)


def keyword_class(low: Column, table: Mapping[str, Sequence[str]], other: str = "OTHER",
                  word_bounded: bool = False) -> Column:
    """First class, in table order, with a keyword contained in the lower-case text."""
    out = None
    for name, words in table.items():
        hit = None
        for w in words:
            one = low.contains(w)
            if word_bounded:
                one = one & low.rlike(rf"(?U)\b{re.escape(w)}\b")
            hit = one if hit is None else hit | one
        out = F.when(hit, F.lit(name)) if out is None else out.when(hit, F.lit(name))
    return out.otherwise(F.lit(other))


def fold_place(c: Column) -> Column:
    """Place name without accents, with unified direction words, letters and digits only."""
    text = F.translate(F.lower(F.coalesce(c, F.lit(""))), dims.ACCENTED, dims.UNACCENTED)
    text = F.trim(F.regexp_replace(text, r"[^\x00-\x7F]", ""))
    for word, to in dims.PLACE_REWRITES:
        text = F.regexp_replace(text, rf"\b{word}\b", to)
    return F.trim(F.regexp_replace(text, "[^a-z0-9]+", " "))


def title_case(c: Column) -> Column:
    """Every run of letters capitalized, whatever separates the runs."""
    parts = F.split(c, r"(?<=\P{L})(?=\p{L})")
    return F.array_join(F.transform(parts, F.initcap), "")


def clean_place(c: Column) -> Column:
    text = F.translate(F.lower(F.coalesce(c, F.lit(""))), dims.ACCENTED, dims.UNACCENTED)
    return F.trim(F.regexp_replace(text, r"[^\x00-\x7F]", ""))


def without_parentheses(c: Column) -> Column:
    return F.trim(F.regexp_replace(c, r"\(.*?\)", ""))


def normalize_season(c: Column, current: Column | None = None) -> Column:
    """Season alias to canonical name; blank falls back to ``current``."""
    text = F.trim(c)
    named = F.coalesce(lookup(F.lower(text), dims.SEASON_ALIASES),
                       F.concat(F.upper(F.substring(text, 1, 1)), F.lower(F.substring(text, F.lit(2), F.length(text)))))
    fallback = current if current is not None else F.lit(None).cast("string")
    return F.when(F.coalesce(text, F.lit("")) != "", named).otherwise(fallback)


def season_of_month(m: Column) -> Column:
    return (F.when(m.isin(6, 7, 8, 9, 10), F.lit("Kharif"))
            .when(m.isin(11, 12, 1, 2, 3), F.lit("Rabi"))
            .otherwise(F.lit("Zaid")))


def contained_value(text: Column, table: Mapping[str, str], longest: bool = False) -> Column:
    """Value of the first (or longest) key contained in the text, null if none.

    The table is a constant array, so no join is involved.
    """
    rows = list(table.items())
    order = sorted(range(len(rows)), key=lambda i: -len(rows[i][0])) if longest else range(len(rows))
    return F.coalesce(*[F.when(text.contains(rows[i][0]), F.lit(rows[i][1])) for i in order])


def has_forbidden(c: Column) -> Column:
    hit = F.lit(False)
    for pattern in dims.FORBIDDEN_TEXT:
        hit = hit | c.rlike(pattern)
    return hit
