import html
import random

from pyspark.sql import functions as F

from pagefacts.functions.text import clean_page, html_unescape, to_float, to_int


def apply(spark, function, values):
    df = spark.createDataFrame([(i, v) for i, v in enumerate(values)], "i int, v string")
    return [r[1] for r in df.select("i", function(F.col("v"))).orderBy("i").collect()]


def test_to_int(spark):
    cases = {
        "1,775": 1775,
        " 12 ": 12,
        " 45\t": 45,
        "\x1f7": 7,
        "+3": 3,
        "-4": -4,
        "1.5": None,
        "1_000": None,
        "１２": None,
        "3000000000": None,
        "2147483647": 2147483647,
        "": None,
        ",": None,
        "12a": None,
        "1 2": None,
    }
    assert apply(spark, to_int, cases) == list(cases.values())


def test_to_float(spark):
    cases = {
        "4.0": 4.0,
        " 4.5\n": 4.5,
        " 3": 3.0,
        "1e3": 1000.0,
        ".5": 0.5,
        "5.": 5.0,
        "4.0d": None,
        "4.0f": None,
        "4,5": None,
        "nan": None,
        "inf": None,
        "": None,
    }
    assert apply(spark, to_float, cases) == list(cases.values())


def test_unescape_is_the_html5_decoding(spark):
    texts = ["no references", "&notit;", "&#128;", "&amp;lt;", "&#0;&#xD800;", "&amp", "&quot;&copy&middot;", "a & b", "&", ""]
    rng = random.Random(7)
    pieces = ["&", "#", "x", "amp", "lt", "41", ";", "not", "in", " ", "é", "&#1", "\n", "nbsp;"]
    texts += ["".join(rng.choices(pieces, k=rng.randint(1, 12))) for _ in range(300)]
    assert apply(spark, html_unescape, texts + [None]) == [html.unescape(t) for t in texts] + [None]


def test_clean_page(spark):
    cases = {"﻿a\r\nb\rc\n": "a\nb\nc\n", "﻿": "", "plain": "plain", "a﻿": "a﻿", "\r\r\n": "\n\n"}
    assert apply(spark, clean_page, cases) == list(cases.values())
