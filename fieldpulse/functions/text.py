"""Text expressions: sentence split, boilerplate removal, failure-report test.

Everything is a Column expression, so no text leaves the JVM.
"""

from __future__ import annotations

import re
from collections.abc import Iterable

from pyspark.sql import Column
from pyspark.sql import functions as F

from fieldpulse import settings

# Unicode word classes, case-insensitive, "\n" as the only line terminator.
_FLAGS = "(?iUd)"
# Unicode white space plus the four ASCII separators U+001C..U+001F.
_WS = r"[\s\x1c-\x1f]"


def strip_ws(col: Column) -> Column:
    """Remove leading and trailing whitespace of any kind, not only U+0020."""
    return F.regexp_replace(col, f"(?U)^{_WS}+|{_WS}+$", "")


def is_blank(col: Column) -> Column:
    return F.coalesce(F.length(strip_ws(col)) == 0, F.lit(True))


def any_of(patterns: Iterable[str]) -> str:
    """One alternation of all patterns.

    Patterns that open with the same anchor share it, so that most positions of a text fail
    on one test instead of one per pattern.
    """
    shared: dict[str, list[str]] = {"^": [], r"\b": [], "": []}
    for p in patterns:
        anchor = next((a for a in ("^", r"\b") if p.startswith(a) and not _splits(p)), "")
        shared[anchor].append(p[len(anchor):])
    groups = [
        f"{anchor}(?:{'|'.join(f'(?:{p})' for p in rest)})" for anchor, rest in shared.items() if rest
    ]
    return _FLAGS + "|".join(groups)


def _splits(pattern: str) -> bool:
    """Does the pattern have an alternation outside all groups?"""
    flat = re.sub(r"\\.|\[[^\]]*\]", "", pattern)
    while re.search(r"\([^()]*\)", flat):
        flat = re.sub(r"\([^()]*\)", "", flat)
    return "|" in flat


def sentences(text: Column) -> Column:
    """Split at whitespace that follows a full stop, exclamation or question mark."""
    return F.split(text, f"(?<=[.!?])(?U){_WS}+")


def kept_sentences(text: Column, patterns: Iterable[str] = settings.BOILERPLATE) -> Column:
    rule = any_of(patterns)
    trimmed = F.transform(sentences(text), strip_ws)
    return F.filter(trimmed, lambda s: (F.length(s) > 0) & ~s.rlike(rule))


def strip_boilerplate(
    text: Column,
    patterns: Iterable[str] = settings.BOILERPLATE,
    min_chars: int = settings.MIN_USEFUL_CHARS,
) -> Column:
    """``struct<text, fell_back>``: the kept sentences, or the trimmed original
    when too little is left to embed."""
    # Kept sentences are trimmed, so only the white space inside them is left to collapse.
    kept = F.regexp_replace(F.array_join(kept_sentences(text, patterns), " "), f"(?U){_WS}+", " ")
    return F.when(
        F.coalesce(F.length(text) == 0, F.lit(True)),
        F.struct(F.lit("").alias("text"), F.lit(False).alias("fell_back")),
    ).otherwise(
        # One evaluation of the expensive expression, read twice by the lambda.
        F.element_at(
            F.transform(
                F.array(kept),
                lambda k: F.struct(
                    F.when(F.length(k) < min_chars, strip_ws(text)).otherwise(k).alias("text"),
                    (F.length(k) < min_chars).alias("fell_back"),
                ),
            ),
            1,
        )
    )


def is_failure_report(
    text: Column, markers: Iterable[str] = settings.NON_FAILURE_MARKERS
) -> Column:
    """False for missing or empty text and for text with a non-failure marker."""
    return F.coalesce((F.length(text) > 0) & ~text.rlike(any_of(markers)), F.lit(False))


def clip(col: Column, chars: int | None) -> Column:
    return col if chars is None else F.substring(col, 1, chars)


def names_variant(model: Column, listed: Column) -> Column:
    """Does a listed name begin with all tokens of a model name? Case and punctuation do not count."""
    gap = F.lit(" ")
    return F.startswith(F.concat(fold_tokens(listed), gap), F.concat(fold_tokens(model), gap))


def fold_tokens(col: Column) -> Column:
    return F.upper(F.trim(F.regexp_replace(col, "[^A-Za-z0-9]+", " ")))


def split_list(col: Column) -> Column:
    """Comma list to sorted distinct non-blank items; NULL gives an empty array."""
    items = F.transform(F.split(F.coalesce(col, F.lit("")), ","), strip_ws)
    return F.array_sort(F.array_distinct(F.filter(items, lambda x: F.length(x) > 0)))


def coarse_components(components: Column) -> Column:
    """The part of each component before its first colon, distinct and sorted."""
    return F.array_sort(
        F.array_distinct(F.transform(components, lambda c: F.trim(F.split(c, ":")[0])))
    )
