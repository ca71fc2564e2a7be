"""The three target tables: create, load, scan. Versions of parquet folders under one root (``manifest``), or JDBC."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from pagefacts import schema
from pagefacts.functions.rules import PageKind
from pagefacts.operators.integrity import fk_violations, pk_violations
from pagefacts.operators.membership import only_listed
from pagefacts.operators.ordered import with_dense_id
from pagefacts.plans.manifest import Entry, entries, new_data, publish, read_entry
from pagefacts.plans.staging import stage


def create_tables(spark: SparkSession, root: str) -> None:
    """Create or replace the tables, empty, in one step; what was there is readable until then."""
    publish(spark, root, dict.fromkeys(schema.TABLES, Entry()))


def scan_table(spark: SparkSession, root: str, table: str) -> DataFrame:
    """Full scan, ordered by the key."""
    columns = schema.TABLES[table]
    return read_table(spark, root, table).orderBy(columns[0].name)


def read_table(spark: SparkSession, root: str, table: str) -> DataFrame:
    """A table as the current version has it, also for readers that are slower than the next load."""
    return read_entry(spark, root, _entry(entries(spark, root), root, table), schema.TABLES[table])


def _entry(tables: dict[str, Entry], root: str, table: str) -> Entry:
    if table not in tables:
        raise ValueError(f"no table {table} under {root}")
    return tables[table]


def conform(df: DataFrame, table: str) -> DataFrame:
    """Columns of the table, in its order and types."""
    return df.select(*[F.col(c.name).cast(c.dataType).alias(c.name) for c in schema.TABLES[table]])


def _stamp(recorded_at: Column | None) -> Column:
    return F.localtimestamp() if recorded_at is None else recorded_at


def rejected_ids(ids: DataFrame, asins: DataFrame) -> DataFrame:
    """Identifiers that a load would leave in the table more than once, with the number of times."""
    return pk_violations(asins.select("asin").unionByName(ids.select("asin")), "asin")


def write_ids(ids: DataFrame, root: str, before: Entry, recorded_at: Column | None = None) -> Entry:
    """Write identifiers to a folder of their own: the table's entry with them, to be published.

    An identifier that is repeated or already present ends the load before anything is written.
    """
    spark = ids.sparkSession
    ids = stage(ids.select("asin"), "ids")
    double = rejected_ids(ids, read_entry(spark, root, before, schema.ASINS)).first()
    if double is not None:
        raise ValueError(f"asins: asin {double['asin']!r} would occur {double['n_rows']} times")
    folder = new_data("asins")
    conform(ids.select("asin", _stamp(recorded_at).alias("recorded_at")), "asins").write.parquet(f"{root}/{folder}")
    return before.plus(folder, ids.count())


def load_ids(ids: DataFrame, root: str, recorded_at: Column | None = None) -> None:
    """Add identifiers with the load time, one value for the whole load; all of them or, if a key is broken, none."""
    spark = ids.sparkSession
    tables = entries(spark, root)
    publish(spark, root, tables | {"asins": write_ids(ids, root, _entry(tables, root, "asins"), recorded_at)})


def numbered_facts(
    facts: DataFrame,
    kind: PageKind,
    *,
    order: Sequence[str] = ("asin",),
    recorded_at: Column | None = None,
    start: int = 1,
) -> DataFrame:
    """Fact rows as the table wants them: dense ids in load order and the load time."""
    needed = list(dict.fromkeys([*order, "asin", *kind.fields]))
    numbered = with_dense_id(facts.select(*needed), order, start=start)
    return conform(numbered.withColumn("recorded_at", _stamp(recorded_at)), kind.table)


def write_facts(
    facts: DataFrame,
    root: str,
    kind: PageKind,
    before: Entry,
    *,
    order: Sequence[str] = ("asin",),
    recorded_at: Column | None = None,
) -> Entry:
    """Write facts to a folder of their own: the table's entry with them, to be published. Ids go on after the last one."""
    folder = new_data(kind.table)
    path = f"{root}/{folder}"
    numbered_facts(facts, kind, order=order, recorded_at=recorded_at, start=before.last_id + 1).write.parquet(path)
    n_rows = facts.sparkSession.read.schema(schema.TABLES[kind.table]).parquet(path).count()
    return before.plus(folder, n_rows, before.last_id + n_rows)


def load_facts(
    facts: DataFrame,
    root: str,
    kind: PageKind,
    *,
    order: Sequence[str] = ("asin",),
    recorded_at: Column | None = None,
    on_unknown: str = "fail",
    checked: bool = False,
) -> None:
    """Append the facts of one page kind; ids go on after the last one, which the manifest holds.

    Rows of identifiers the parent table does not know end the load before
    anything is written ("fail") or stay out ("drop", see ``fk_violations`` for
    them). ``checked`` says the caller has selected by the parent table already.
    """
    if on_unknown not in ("fail", "drop"):
        raise ValueError(f"on_unknown: {on_unknown!r}")
    spark = facts.sparkSession
    tables = entries(spark, root)
    if not checked:
        asins = read_entry(spark, root, _entry(tables, root, "asins"), schema.ASINS)
        if on_unknown == "drop":
            facts = only_listed(facts, asins, ["asin"])
        else:
            unknown = fk_violations(facts, asins).first()
            if unknown is not None:
                raise ValueError(f"{kind.table}: asin {unknown['asin']!r} is not in asins")
    added = write_facts(facts, root, kind, _entry(tables, root, kind.table), order=order, recorded_at=recorded_at)
    publish(spark, root, tables | {kind.table: added})


def check_primary_keys(spark: SparkSession, root: str) -> None:
    """Raise if a table holds a key twice."""
    for name, columns in schema.TABLES.items():
        key = columns[0].name
        double = pk_violations(read_table(spark, root, name), key).first()
        if double is not None:
            raise ValueError(f"{name}: {key} {double[key]!r} occurs {double['n_rows']} times")


def jdbc_options(
    *, dialect: str, host: str, port: int | str, database: str, user: str, password: str, driver: str | None = None
) -> dict[str, str]:
    """Options of Spark's JDBC source and sink, from the parts of a database address."""
    options = {"url": f"jdbc:{dialect}://{host}:{port}/{database}", "user": user.strip(), "password": password.strip()}
    if driver:
        options["driver"] = driver
    return options


def write_jdbc(df: DataFrame, table: str, options: dict[str, str], *, batch: int = 10_000) -> None:
    """Append rows to a database table, one connection per partition, in batches."""
    (
        conform(df, table)
        .write.format("jdbc")
        .options(**options, dbtable=table, batchsize=str(batch))
        .mode("append")
        .save()
    )


def read_jdbc(
    spark: SparkSession, table: str, options: dict[str, str], *, partitions: int = 1, highest: int = 0
) -> DataFrame:
    """Read a database table, split by id when it has one and ``highest`` is given."""
    reader = spark.read.format("jdbc").options(**options, dbtable=table)
    if partitions > 1 and highest > 0 and schema.TABLES[table][0].name == "id":
        reader = reader.options(
            partitionColumn="id", lowerBound="1", upperBound=str(highest), numPartitions=str(partitions)
        )
    return reader.load()
