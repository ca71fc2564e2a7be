import datetime

from pyspark.sql import functions as F

from pagefacts.operators.report import cell_text, column_name, report_lines, report_widths


# Given lines: the report of the tables below, character by character.
REPORT = [
    "id │             t              │           some_text           │ number │             other             │   b  ",
    "───┼────────────────────────────┼───────────────────────────────┼────────┼───────────────────────────────┼──────",
    "1  │    2024-01-02 03:04:05     │             short             │  4.0   │             ééééé             │ True ",
    "2  │ 2024-01-02 03:04:05.120000 │  xxxxxxxxxxxxxxxxxxxxxxxxxx   │  None  │  漢漢漢漢漢漢漢漢漢漢漢漢漢漢漢漢漢漢漢漢漢漢漢漢漢漢   │ False",
    "3  │            None            │ yyyyyyyyyyyyyyyyyyyyyyyyyy... │  4.25  │ zzzzzzzzzzzzzzzzzzzzzzzzzz... │ None ",
    "4  │    2024-01-02 03:04:05     │ wwwwwwwwwwwwwwwwwwwwwwwwww... │  0.5   │             None              │ True ",
    "50 │    2024-01-02 03:04:05     │             None              │  10.0  │                               │ False",
]
NARROW = [
    "    text      │ n",
    "──────────────┼──",
    "aaaaaaaaaa... │ 1",
    "      b       │ 2",
]
EMPTY = [
    "asin │ recorded_at",
    "─────┼────────────",
]


def test_report(spark):
    when = datetime.datetime(2024, 1, 2, 3, 4, 5)
    records = [
        (1, when, "short", 4.0, "é" * 5, True),
        (2, when.replace(microsecond=120000), "x" * 26, None, "漢" * 26, False),
        (3, None, "y" * 27, 4.25, "z" * 27, None),
        (4, when, "w" * 60, 0.5, None, True),
        (50, when, None, 10.0, "", False),
    ]
    df = spark.createDataFrame(
        records, "id int, t timestamp_ntz, some_text string, number double, other string, b boolean"
    ).repartition(3)
    lines = report_lines(df, ["id"])
    assert [r.line for r in lines.collect()] == REPORT
    assert tuple(report_widths(df).first()) == (2, 26, 60, 6, 27, 5)


def test_doubles_as_text(spark):
    numbers = [
        0.0, -0.0, 0.001, 1e-4, 0.000123, 9.9e-5, -1e-5, 1.25e-7, 1e7, 12345678.0, -98765432.125, 1e15, 1e16, 1.5e16, 1e22,
        1.5e-300, 1e100, 4.094433021338333e16, 2.59490133044724448e17, float("nan"), float("inf"), float("-inf"), None,
    ]
    df = spark.createDataFrame([(n,) for n in numbers], "n double")
    got = [r[0] for r in df.select(cell_text(F.col("n"), df.schema["n"].dataType)).collect()]
    assert got == [
        "0.0", "-0.0", "0.001", "0.0001", "0.000123", "9.9e-05", "-1e-05", "1.25e-07", "10000000.0", "12345678.0",
        "-98765432.125", "1000000000000000.0", "1e+16", "1.5e+16", "1e+22", "1.5e-300", "1e+100", "4.094433021338333e+16",
        "2.5949013304472445e+17", "nan", "inf", "-inf", "None",
    ]


def test_wider_limit(spark):
    records = [("a" * 12, 1), ("b", 2)]
    df = spark.createDataFrame(records, "text string, n int")
    got = [r.line for r in report_lines(df, ["n"], truncate_after=10).collect()]
    assert got == NARROW


def test_empty_table(spark):
    df = spark.createDataFrame([], "asin string, recorded_at timestamp_ntz")
    assert [r.line for r in report_lines(df, ["asin"]).collect()] == EMPTY


def test_column_name(spark):
    df = spark.createDataFrame([("asins.recorded_at",), ("plain",)], "c string")
    assert [r[0] for r in df.select(column_name(F.col("c"))).collect()] == ["recorded_at", "plain"]
