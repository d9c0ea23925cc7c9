"""Page requests and page envelopes, as scalars and as columns."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Fixed values of the catalogue's public contract.
DEFAULT_PAGE = 1
DEFAULT_PAGE_SIZE = 20
MAX_PAGE_SIZE = 100


@dataclass(frozen=True)
class Page:
    """One page: lazy rows plus the envelope numbers."""

    items: DataFrame
    total_count: int
    page: int
    page_size: int

    @property
    def total_pages(self) -> int:
        return -(-self.total_count // self.page_size) if self.page_size else 0

    @property
    def has_more(self) -> bool:
        return self.page < self.total_pages


def normalize(page: int, page_size: int, default_page_size: int | None = None) -> tuple[int, int]:
    """Usable (page, size) for a raw request; the caller's default is not capped."""
    if page <= 0:
        page = DEFAULT_PAGE
    if page_size <= 0:
        return page, DEFAULT_PAGE_SIZE if default_page_size is None else default_page_size
    return page, min(page_size, MAX_PAGE_SIZE)


def normalized_page(page: Column) -> Column:
    return F.when(page > 0, page).otherwise(F.lit(DEFAULT_PAGE)).cast("bigint")


def normalized_page_size(size: Column, default: int = DEFAULT_PAGE_SIZE) -> Column:
    return F.when(size > 0, F.least(size, F.lit(MAX_PAGE_SIZE))).otherwise(F.lit(default)).cast("bigint")


def total_pages(total: Column, page_size: Column | int) -> Column:
    """Number of pages; an empty page size means no pages rather than a division by zero."""
    size = F.lit(page_size) if isinstance(page_size, int) else page_size
    return F.when(size > 0, F.ceil(total / size)).otherwise(F.lit(0)).cast("bigint")


def has_more(page: Column, total: Column, page_size: Column | int) -> Column:
    return page < total_pages(total, page_size)


def page_of_position(position: Column, page_size: int) -> Column:
    """Page number that holds a 1-based position."""
    return F.floor((position - 1) / F.lit(page_size)).cast("bigint") + 1


def one_page(ordered: DataFrame, page: int, page_size: int) -> DataFrame:
    """Rows of one page; planned as a bounded top-k, not as a full sort."""
    skip = (page - 1) * page_size
    return (ordered.offset(skip) if skip else ordered).limit(page_size)
