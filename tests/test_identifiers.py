import csv
import io
import random

import pytest
from pyspark.errors import PySparkException

from pyspark.sql import functions as F

from pagefacts.sources.csv_records import last_fields
from pagefacts.sources.identifiers import checked_path, last_field, read_identifiers


def asins(df):
    return [r.asin for r in df.collect()]


def write(path, text, bom=False):
    path.write_text(text, encoding="utf-8-sig" if bom else "utf-8", newline="")
    return str(path)


def test_last_field_distinct_sorted(spark, tmp_path):
    text = 'B2\nB1\n\nx,B3\n"a,b",B4\nB1\n""\n'
    path = write(tmp_path / "ids.csv", text, bom=True)
    assert asins(read_identifiers(spark, path, on_blank="drop")) == ["", "B1", "B2", "B3", "B4"]
    with pytest.raises(PySparkException, match="blank line"):
        asins(read_identifiers(spark, path))


def test_one_column_sample(spark, tmp_path):
    ids = [f"B{i:09d}" for i in range(72)]
    path = write(tmp_path / "ids.csv", "\n".join(reversed(ids)))
    assert asins(read_identifiers(spark, path)) == ids


def test_fields_as_the_csv_module_reads_them(spark, tmp_path):
    lines = [
        "a,b,c1", "c2,", '"q""uote"', '"x"tail', '"x"ta"il', 'in"side', ' "spaced, kept"', "é,𝔸", ",,", '"a","b,c"', " pad ", '"",z',
    ]
    text = "\r\n".join(lines) + "\r\n"
    expected = sorted({row[-1] for row in csv.reader(lines)})
    assert asins(read_identifiers(spark, write(tmp_path / "ids.csv", text))) == expected


def test_random_lines_as_the_csv_module_reads_them(spark):
    rng = random.Random(4)
    lines = ["".join(rng.choices('"",ab é\t', k=rng.randint(1, 14))) for _ in range(4000)]
    # A record that takes in the next line has an open quote.
    closed = [line for line in lines if len(list(csv.reader([line + "\n", "next"]))) == 2]
    opened = sorted(set(lines) - set(closed))
    assert len(closed) > 1000 and len(opened) > 100
    df = spark.createDataFrame(list(enumerate(closed)), "i int, line string")
    got = [r[1] for r in df.select("i", last_field(F.col("line"))).orderBy("i").collect()]
    assert got == [next(csv.reader([line]))[-1] for line in closed]
    for line in opened[:5]:
        with pytest.raises(PySparkException, match="goes on"):
            spark.createDataFrame([(line,)], "line string").select(last_field(F.col("line"))).collect()


def test_many_fields(spark, tmp_path):
    line = ",".join(['"a,""b"'] * 50_000 + ["last"])
    assert asins(read_identifiers(spark, write(tmp_path / "ids.csv", line))) == ["last"]


def test_sort_is_by_code_point(spark, tmp_path):
    ids = ["b", "B", "a", "Z", "é", "￮", "𝔸", "0"]
    path = write(tmp_path / "ids.csv", "\n".join(ids))
    assert asins(read_identifiers(spark, path)) == sorted(ids)


def test_line_break_in_quotes(spark, tmp_path):
    path = write(tmp_path / "ids.csv", 'x,"B\n3"\nB1,B2\n"B\n1"\nB2\n""\n"q""q"\n')
    assert asins(read_identifiers(spark, path)) == ["", "B\n1", "B\n3", "B2", 'q"q']


def by_csv(text):
    """Last fields as the csv module reads them from a file, None for a blank line."""
    translated = io.TextIOWrapper(io.BytesIO(text), encoding="utf-8-sig")
    return [row[-1] if row else None for row in csv.reader(translated)]


def generated(seed, n):
    rng = random.Random(seed)
    pieces = ['"', '"', '""', ",", "a", "b c", "é", "\n", "\r\n", "\r", '",', ',"', '"\n', "𝔸"]
    # Of one byte each, splits are many; few texts do.
    texts = ["".join(rng.choices(pieces, k=rng.randint(0, 24))).encode() for _ in range(n)]
    tidy = []
    for _ in range(n // 4):
        out = io.StringIO()
        values = ["x", "", 'q"q', "two\nlines", "a,b", "\n\n", '"\r\n"']
        csv.writer(out).writerows([rng.choices(values, k=rng.randint(1, 4)) for _ in range(1 + n // 20)])
        tidy.append(out.getvalue().encode())
    fixed = [b"", b'"', b'"\n', b'"a\n"', b"a\r", b'"a\r', b'\xef\xbb\xbf"a\nb"\n', b'\xef\xbb\xbf"a\nb', b'x,"a\n\nb",c\n"d\n', b'"a\n""\n']
    return texts + tidy + fixed


@pytest.mark.parametrize("cut,n", [(1, 4), (3, 16), (7, 40), (1 << 20, 400)])
def test_records_as_the_csv_module_reads_them(spark, tmp_path, cut, n):
    """Files of quotes, commas and line ends of all kinds, split after every ``cut`` bytes."""
    expected = {}
    for i, text in enumerate(generated(cut, n)):
        (tmp_path / f"{i:03}.csv").write_bytes(text)
        if found := [value for value in by_csv(text) if value is not None]:
            expected[f"{i:03}"] = sorted(found)
    settings = {"spark.sql.files.maxPartitionBytes": str(cut), "spark.sql.files.openCostInBytes": "0"}
    old = {key: spark.conf.get(key) for key in settings}
    for key, value in settings.items():
        spark.conf.set(key, value)
    try:
        found = last_fields(spark, str(tmp_path), on_blank="drop").collect()
    finally:
        for key, value in old.items():
            spark.conf.set(key, value)
    got = {}
    for row in found:
        got.setdefault(row["file"][-7:-4], []).append(row["field"])
    assert {file: sorted(values) for file, values in got.items()} == expected


def test_fields_that_are_too_long(spark, tmp_path):
    limit = csv.field_size_limit()
    path = write(tmp_path / "ids.csv", 'x,"' + "ab\n" * (limit // 3) + '"\n')
    assert [len(value) for value in asins(read_identifiers(spark, path))] == [limit // 3 * 3]
    for text in ('"' + "ab\n" * (limit // 3 + 1) + '"\n', "a" * (limit + 1), '"never closed\n' + "B1\n" * limit):
        with pytest.raises(PySparkException, match="field of over"):
            asins(read_identifiers(spark, write(tmp_path / "long.csv", text)))


def test_a_record_with_many_lines_before_its_last_field(spark, tmp_path):
    """Only the lines of the last field are gathered, however many the record has."""
    path = write(tmp_path / "ids.csv", '"first\n' + "more\n" * 100_000 + '",B1\nB2\n')
    assert asins(read_identifiers(spark, path)) == ["B1", "B2"]


def test_path(spark, tmp_path):
    path = write(tmp_path / "ids.csv", "B1")
    assert checked_path(spark, path) == path
    for read in (checked_path, read_identifiers):
        with pytest.raises(ValueError, match="does not exist"):
            read(spark, str(tmp_path / "missing.csv"))
    with pytest.raises(ValueError):
        read_identifiers(spark, path, on_blank="guess")
