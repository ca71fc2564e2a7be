"""Column functions on page text and on the short texts captured from it."""

from __future__ import annotations

import html
import re
from collections.abc import Callable, Mapping

import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Python's notion of white space, in Java syntax.
_SPACE = r"[\s\x1c-\x1f]"
_EDGES = rf"(?U)\A{_SPACE}+|{_SPACE}+\z"

_INT_TEXT = r"\A[+-]?[0-9]+\z"
_FLOAT_TEXT = r"\A[+-]?([0-9]+\.?[0-9]*|\.[0-9]+)([eE][+-]?[0-9]+)?\z"


def clean_page(page: Column) -> Column:
    """Drop a leading byte order mark and fold ``\\r\\n`` and ``\\r`` to ``\\n``."""
    body = F.when(F.startswith(page, F.lit("\ufeff")), F.substring(page, 2, 2**31 - 1)).otherwise(page)
    return F.replace(F.replace(body, F.lit("\r\n"), F.lit("\n")), F.lit("\r"), F.lit("\n"))


def html_unescape(text: Column) -> Column:
    """Decode HTML5 character references, all names and numeric forms, in one pass.

    Texts without an ampersand have nothing to decode; they travel to Python as
    NULL and the original is kept.
    """

    # Nested, so that it is shipped by value and executors need no copy of this package.
    @F.arrow_udf("string")
    def decode(texts: pa.Array) -> pa.Array:
        unescape = html.unescape
        return pa.array((None if v is None else unescape(v) for v in texts.to_pylist()), pa.string())

    return F.coalesce(decode(F.when(F.contains(text, F.lit("&")), text)), text)


def capture(
    page: Column, patterns: Mapping[str, tuple[str, int]], *, decode: bool = True, clean: bool = False
) -> Column:
    """First match of each pattern in the page, as a struct of raw texts.

    ``patterns`` maps a field name to ``(pattern, target_group)``, groups counted
    from 0. A field is NULL when its pattern does not match, and ``''`` when it
    matches an empty text. ``clean`` does what ``clean_page`` does, on the way.

    Decoding has to happen in Python, so the searches run in the same Arrow batch:
    only the short captured texts come back, never the decoded page.
    """
    names = list(patterns)
    wanted = [(pattern, group + 1) for pattern, group in patterns.values()]

    @F.arrow_udf(T.StructType([T.StructField(name, T.StringType()) for name in names]))
    def search(pages: pa.Array) -> pa.Array:
        searches = [(re.compile(pattern).search, group) for pattern, group in wanted]
        found = [[] for _ in searches]
        for page in pages:
            text = page.as_py()
            if text is not None and clean:
                text = text.removeprefix("\ufeff").replace("\r\n", "\n").replace("\r", "\n")
            if text is not None and decode:
                text = html.unescape(text)
            for values, (first_match, group) in zip(found, searches):
                match = None if text is None else first_match(text)
                values.append(match and match.group(group))
        return pa.StructArray.from_arrays([pa.array(v, pa.string()) for v in found], names=names)

    return search(page)


def strip(text: Column) -> Column:
    """Trim Unicode white space from both ends."""
    return F.regexp_replace(text, _EDGES, "")


def to_int(text: Column) -> Column:
    """``'1,234'`` -> 1234. NULL for anything that is not a plain 32-bit integer."""
    plain = F.replace(text, F.lit(","), F.lit(""))
    digits = F.when(F.rlike(plain, F.lit(_INT_TEXT)), plain).otherwise(strip(plain))
    return F.when(F.rlike(digits, F.lit(_INT_TEXT)), digits.try_cast("int"))


def to_float(text: Column) -> Column:
    """``' 4.5 '`` -> 4.5. Commas are not removed. NULL for anything but a plain decimal number."""
    number = strip(text)
    return F.when(F.rlike(number, F.lit(_FLOAT_TEXT)), number.try_cast("double"))


def _bind(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body(value)`` with ``value`` computed once."""
    return F.transform(F.array(value), body)[0]


def _fewest_digits(number: Column, digits: Column, exponent: Column) -> Column:
    """Older Java versions give a digit or two too many; fewer are taken if they are the same double."""

    def shortened(n: int) -> Column:
        up = F.substring(digits, n + 1, 1) >= "5"
        fewer = (F.left(digits, F.lit(n)).try_cast("bigint") + F.when(up, 1).otherwise(0)).cast("string")
        read_back = F.concat(fewer, F.lit("E"), (exponent - (n - 1)).cast("string")).try_cast("double")
        return F.when((F.length(fewer) == n) & (read_back == F.abs(number)), fewer)

    shorter = F.when(F.length(digits) > 16, F.coalesce(shortened(16), shortened(17)))
    return F.regexp_replace(F.coalesce(shorter, digits), "(?<=.)0+$", "")


def _laid_out(digits: Column, exponent: Column) -> Column:
    decimals = F.substring(digits, exponent + 2, F.length(digits))
    large = F.concat(
        F.rpad(F.left(digits, exponent + 1), exponent + 1, F.lit("0")),
        F.lit("."),
        F.when(decimals == "", "0").otherwise(decimals),
    )
    small = F.concat(F.lit("0."), F.repeat(F.lit("0"), -exponent - 1), digits)
    rest = F.substring(digits, F.lit(2), F.length(digits))
    size = F.abs(exponent).cast("string")
    scientific = F.concat(
        F.left(digits, F.lit(1)),
        F.when(rest == "", "").otherwise(F.concat(F.lit("."), rest)),
        F.when(exponent < 0, "e-").otherwise("e+"),
        F.when(F.length(size) < 2, F.concat(F.lit("0"), size)).otherwise(size),
    )
    is_large, is_small = (exponent >= 0) & (exponent < 16), (exponent < 0) & (exponent >= -4)
    return F.when(is_large, large).when(is_small, small).otherwise(scientific)


def double_text(number: Column) -> Column:
    """A double as text: plain digits from 1e-4 up to 1e16, otherwise mantissa and a signed exponent of two digits.

    Spark's own text changes to an exponent earlier; its digits are taken and laid out anew.
    """

    def with_exponent(text: Column) -> Column:
        sign = F.when(text.startswith("-"), "-").otherwise("")
        digits = F.regexp_replace(F.substring_index(text, "E", 1), "[-.]", "")
        parts = F.struct(digits.alias("digits"), F.substring_index(text, "E", -1).try_cast("int").alias("exponent"))

        def from_parts(p: Column) -> Column:
            fewest = _fewest_digits(number, p["digits"], p["exponent"])
            return _bind(fewest, lambda d: F.concat(sign, _laid_out(d, p["exponent"])))

        return _bind(parts, from_parts)

    def of_text(text: Column) -> Column:
        return (
            F.when(F.isnan(number), "nan")
            .when(F.abs(number) == float("inf"), F.when(number > 0, "inf").otherwise("-inf"))
            .when(F.contains(text, F.lit("E")), with_exponent(text))
            .otherwise(text)
        )

    return _bind(number.cast("string"), of_text)
