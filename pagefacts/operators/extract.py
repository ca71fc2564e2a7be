"""Pages to facts."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pagefacts.fixed_values import LISTING_NAME_WIDTH
from pagefacts.functions.rules import ExtractRule, PageKind
from pagefacts.functions.text import capture
from pagefacts.operators.report import cell_text

_ERRORS = "array<struct<field:string,raw:string>>"


def _captured(page: Column, rules: Sequence[ExtractRule], **options) -> Column:
    return capture(page, {rule.name: (rule.pattern, rule.target_group) for rule in rules}, **options)


def _values(raw: Column, rules: Sequence[ExtractRule], on_error: str) -> list[Column]:
    """Value columns of captured texts, and the list of texts that did not convert."""
    if on_error not in ("quarantine", "null", "fail"):
        raise ValueError(f"on_error: {on_error!r}")
    values, failed = [], []
    for rule in rules:
        text = raw.getField(rule.name)
        value = rule.value(text)
        if rule.convert is not None and on_error == "fail":
            message = F.concat(F.lit(f"cannot convert {rule.name}: "), text)
            value = F.when(rule.failed(text), F.raise_error(message)).otherwise(value)
        elif rule.convert is not None:
            error = F.struct(F.lit(rule.name).alias("field"), text.alias("raw"))
            failed.append(F.when(rule.failed(text), error))
        values.append(value.alias(rule.name))
    if on_error == "quarantine":
        errors = F.array_compact(F.array(*failed)) if failed else F.lit(None).cast(_ERRORS)
        values.append(errors.alias("extract_errors"))
    return values


def extract(
    pages: DataFrame,
    rules: Sequence[ExtractRule],
    *,
    page: str = "html",
    decode: bool = True,
    clean: bool = False,
    keep: Sequence[str] = ("asin",),
    drop_missing: bool = True,
    on_error: str = "quarantine",
) -> DataFrame:
    """Apply rules to a page column; returns the kept columns and one column per rule.

    No shuffle, and the page leaves the plan here. A NULL page was never obtained
    and gives no row, or one of defaults with ``drop_missing=False``. ``decode``
    decodes HTML references first; ``clean`` drops a byte order mark and folds line
    ends, for pages that no reader has cleaned yet. ``on_error`` says what happens
    when a captured text does not convert: "quarantine" leaves NULL and lists the
    text in ``extract_errors``, "null" only leaves NULL, "fail" ends the job.
    """
    if drop_missing:
        pages = pages.where(F.col(page).isNotNull())
    captured = pages.select(*keep, _captured(F.col(page), rules, decode=decode, clean=clean).alias("_raw"))
    return captured.select(*keep, *_values(F.col("_raw"), rules, on_error))


def extract_all(pages: DataFrame, kinds: Sequence[PageKind], *, on_error: str = "quarantine") -> DataFrame:
    """Facts of pages of several kinds in one scan: (asin, page_kind, one struct per kind).

    Each page is handed to the rules of its own kind only; ``facts_of`` takes one
    kind's rows out again.
    """
    kind_name = F.col("page_kind")
    own = [F.when(kind_name == kind.name, F.col("html")) for kind in kinds]
    captured = pages.where(F.col("html").isNotNull() & kind_name.isin([kind.name for kind in kinds])).select(
        "asin", "page_kind", *[_captured(page, kind.rules).alias(kind.name) for page, kind in zip(own, kinds)]
    )
    facts = [F.struct(*_values(F.col(kind.name), kind.rules, on_error)).alias(kind.name) for kind in kinds]
    return captured.select("asin", "page_kind", *facts)


def facts_of(facts: DataFrame, kind: PageKind) -> DataFrame:
    return facts.where(F.col("page_kind") == kind.name).select("asin", f"{kind.name}.*")


def extract_facts(pages: DataFrame, kind: PageKind, fields: Sequence[str] | None = None, **options) -> DataFrame:
    """Facts of one page kind, all of them or the named ones only."""
    rules = [rule for rule in kind.rules if fields is None or rule.name in fields]
    return extract(pages, rules, **options)


def extract_errors(facts: DataFrame, kind: PageKind) -> DataFrame:
    """Quarantined texts, one row each."""
    return facts.select("asin", F.explode("extract_errors").alias("e")).select(
        "asin", F.lit(kind.name).alias("page_kind"), "e.field", "e.raw"
    )


def fact_listing(facts: DataFrame, kind: PageKind, *, key: str = "asin") -> DataFrame:
    """One text line per fact: `` * name<padding>value``."""
    texts = facts.select(key, *[cell_text(F.col(f), facts.schema[f].dataType).alias(f) for f in kind.fields])
    long = texts.unpivot([key], kind.fields, "field", "value")
    width = F.greatest(F.lit(LISTING_NAME_WIDTH), F.length("field"))
    line = F.concat(F.lit(" * "), F.rpad("field", width, F.lit(" ")), F.col("value"))
    return long.select(key, "field", line.alias("line"))
