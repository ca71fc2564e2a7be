"""Extraction rules and page kinds: what to take from a page, and where pages live."""

from __future__ import annotations

import re
from collections.abc import Callable
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from pagefacts import fixed_values as fixed
from pagefacts.functions.text import to_float, to_int


@dataclass(frozen=True)
class ExtractRule:
    """One fact of a page.

    ``convert`` turns the captured text into the value (any Column -> Column,
    a pandas UDF included); ``default`` stands for "no match" and is not converted.
    """

    name: str
    pattern: str
    target_group: int = 0
    convert: Callable[[Column], Column] | None = None
    default: object = None

    def __post_init__(self):
        groups = re.compile(self.pattern).groups
        if not 0 <= self.target_group < groups:
            raise ValueError(f"{self.name}: pattern has {groups} groups, group {self.target_group} wanted")

    def value(self, raw: Column) -> Column:
        converted = raw if self.convert is None else self.convert(raw)
        if self.default is None:
            return converted
        return F.when(raw.isNull(), F.lit(self.default)).otherwise(converted)

    def failed(self, raw: Column) -> Column:
        """True where a text was captured but did not convert."""
        if self.convert is None:
            return F.lit(False)
        return raw.isNotNull() & self.convert(raw).isNull()


@dataclass(frozen=True)
class PageKind:
    """A kind of page: its address and cache file forms, its rules, the table its facts go to."""

    name: str
    url_template: str
    file_template: str
    rules: tuple[ExtractRule, ...]
    table: str

    @property
    def fields(self) -> list[str]:
        return [rule.name for rule in self.rules]


INFO = PageKind(
    name="info",
    url_template=fixed.INFO_URL,
    file_template=fixed.INFO_FILE,
    rules=(
        ExtractRule("product_name", fixed.PRODUCT_NAME, target_group=1),
        ExtractRule("total_ratings", fixed.TOTAL_RATINGS, convert=to_int, default=0),
        ExtractRule("average_rating", fixed.AVERAGE_RATING, convert=to_float),
        ExtractRule("answered_questions", fixed.ANSWERED_QUESTIONS, convert=to_int, default=0),
    ),
    table="product_info",
)

REVIEWS = PageKind(
    name="reviews",
    url_template=fixed.REVIEWS_URL,
    file_template=fixed.REVIEWS_FILE,
    rules=(
        ExtractRule("total_reviews", fixed.TOTAL_REVIEWS, convert=to_int, default=0),
        ExtractRule("positive_reviews", fixed.POSITIVE_REVIEWS, convert=to_int, default=0),
        ExtractRule("critical_reviews", fixed.CRITICAL_REVIEWS, convert=to_int, default=0),
    ),
    table="product_reviews",
)

PAGE_KINDS = (INFO, REVIEWS)


def fill(template: str, value: Column) -> Column:
    """Put a column into the ``{}`` of a template."""
    before, after = template.split("{}")
    return F.concat(F.lit(before), value, F.lit(after))


def _by_kind(kinds, page_kind: Column, choose) -> Column:
    """CASE over page kinds; NULL for a kind that is not listed."""
    first, *rest = kinds
    start = F.when(page_kind == first.name, choose(first))
    return reduce(lambda case, kind: case.when(page_kind == kind.name, choose(kind)), rest, start)


def target_url(asin: Column, page_kind: Column, kinds=PAGE_KINDS) -> Column:
    return _by_kind(kinds, page_kind, lambda kind: fill(kind.url_template, asin))


def cache_file(asin: Column, page_kind: Column, kinds=PAGE_KINDS) -> Column:
    return _by_kind(kinds, page_kind, lambda kind: fill(kind.file_template, asin))


def parse_cache_file(file_name: Column, kinds=PAGE_KINDS) -> Column:
    """Struct (asin, page_kind) of a cache file name, NULL if it is no cache file.

    Several templates may fit one name ("reviews-B1.html" also fits "{}.html");
    the one with the longest fixed part wins.
    """
    case = None
    for kind in sorted(kinds, key=lambda k: len(k.file_template), reverse=True):
        before, after = kind.file_template.split("{}")
        key = F.struct(
            F.substring(
                file_name,
                F.lit(len(before) + 1),
                F.length(file_name) - F.lit(len(before) + len(after)),
            ).alias("asin"),
            F.lit(kind.name).alias("page_kind"),
        )
        fits = (
            F.startswith(file_name, F.lit(before))
            & F.endswith(file_name, F.lit(after))
            & (F.length(file_name) > len(before) + len(after))
        )
        case = F.when(fits, key) if case is None else case.when(fits, key)
    return case
