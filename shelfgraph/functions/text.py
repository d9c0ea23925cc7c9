"""Literal, ASCII case-insensitive text matching and serving-key text."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

# The shortest searchable term and the rows per kind when no limit is given.
MIN_TERM_LENGTH = 2
DEFAULT_SEARCH_LIMIT = 5

_UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
_FOLD = str.maketrans(_UPPER, _UPPER.lower())
_PUNCTUATION = r"([!-/:-@\[-`{-~ ])"


def ascii_fold(text: Column) -> Column:
    """Lower-case A-Z only: the folding that a case-insensitive Java regex does."""
    return F.translate(text, _UPPER, _UPPER.lower())


def fold_text(text: str) -> str:
    return text.translate(_FOLD)


def escaped(term: Column) -> Column:
    """Term with every ASCII punctuation mark and space made literal."""
    return F.regexp_replace(term, _PUNCTUATION, r"\\$1")


def search_pattern(term: Column) -> Column:
    r"""Whole-name pattern for a literal term.

    Anchored with \A and \z because `.` must not step over a line break: a name
    with one is matched only when the break is inside the term itself.
    """
    return F.concat(F.lit(r"(?i)\A.*"), escaped(term), F.lit(r".*\z"))


def search_pattern_text(term: str) -> str:
    return r"(?i)\A.*" + re.sub(_PUNCTUATION, r"\\\1", term) + r".*\z"


def is_searchable(term: Column) -> Column:
    """False for null, blank or one-character terms; the length is taken untrimmed."""
    blank = term.isNull() | (F.regexp_replace(term, r"(?U)\s", "") == "")
    return ~blank & (F.length(term) >= MIN_TERM_LENGTH)


def is_searchable_text(term: str | None) -> bool:
    return term is not None and term.strip() != "" and len(term) >= MIN_TERM_LENGTH


def effective_limit(limit: int | None) -> int:
    return limit if limit is not None and limit > 0 else DEFAULT_SEARCH_LIMIT


def serving_key(product_id: Column, page: Column, page_size: Column) -> Column:
    return F.concat_ws(":", F.lit("recs"), product_id, page, page_size)


def serving_prefix(product_id: Column) -> Column:
    """Prefix of all pages of one product; the closing colon keeps 12 apart from 123."""
    return F.concat(F.lit("recs:"), product_id.cast("string"), F.lit(":"))


def key_product(key: Column) -> Column:
    """Product id of a serving key; null for any other text."""
    return F.regexp_extract(key, "^recs:([0-9]{1,18}):", 1).try_cast("bigint")


def key_page_size(key: Column) -> Column:
    """Page size of a serving key; null for any other text."""
    return F.regexp_extract(key, "^recs:[0-9]{1,18}:[0-9]{1,9}:([0-9]{1,9})$", 1).try_cast("int")


def joined_errors(messages: Column) -> Column:
    return F.array_join(messages, "; ")


def not_found_text(entity: str, key: object) -> str:
    return f"{entity} with id '{key}' was not found."
