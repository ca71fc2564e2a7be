"""Pages to facts as they arrive."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StreamingQuery

from pagefacts import schema
from pagefacts.functions.rules import PAGE_KINDS, PageKind
from pagefacts.operators.cache import PAGE_KEY
from pagefacts.operators.crawl import usable
from pagefacts.operators.extract import extract_all, extract_errors, facts_of
from pagefacts.operators.integrity import fk_violations, pk_violations
from pagefacts.operators.membership import key_filter, may_be_listed, only_listed
from pagefacts.plans.staging import scratch, stage
from pagefacts.sources.pages import scanned_file_name, snapshot
from pagefacts.sources.tables import numbered_facts


def page_table_stream(spark: SparkSession, path: str) -> DataFrame:
    """Arriving rows of a page table."""
    return spark.readStream.schema(schema.PAGE_SNAPSHOT).parquet(path)


def page_file_stream(spark: SparkSession, folder: str) -> DataFrame:
    """Arriving page files, one page each."""
    files = spark.readStream.text(folder, wholetext=True)
    return snapshot(files, scanned_file_name(), F.col("value"))


def stream_facts(
    pages: DataFrame,
    asins: DataFrame,
    root: str,
    checkpoint: str,
    *,
    kinds: tuple[PageKind, ...] = PAGE_KINDS,
    recorded_at: Column | None = None,
    on_unknown: str = "fail",
    validate: bool = False,
    **trigger,
) -> StreamingQuery:
    """Load the facts of arriving pages into the tables under ``root``.

    Pages of identifiers that ``asins`` does not list end the stream ("fail") or stay out
    ("drop"), nearly all of them before they are decoded. ``validate`` leaves out pages that hold one of the service's error texts, as in
    ``build_tables``. Stops when caught up, unless another trigger is given
    (``processingTime="1 minute"``). ``root`` and ``checkpoint`` belong together: start both
    anew, or neither.

    Every micro-batch overwrites its own folder, so a batch that is run again after a
    failure replaces its rows instead of adding them twice. Texts that did not convert
    go to ``extract_errors`` in the same way. Ids go on after those of the batch before,
    which a ledger holds: one row per batch and table, so no batch scans earlier ones for them.

    A page that comes again ends the stream, as it ends ``build_tables``, in one batch or in several. The facts
    of a batch are sorted by identifier, and the ledger knows the first and last one of every batch: only batches whose
    range meets that of the new pages are looked at, and of these only that range. A crawl goes through
    its list in order, so few do.
    """
    if on_unknown not in ("fail", "drop"):
        raise ValueError(f"on_unknown: {on_unknown!r}")

    def load(batch: DataFrame, batch_id: int) -> None:
        spark = batch.sparkSession
        with scratch(spark):
            if validate:
                batch = batch.where(usable(F.coalesce("html", F.lit(""))))
            if on_unknown == "drop":
                batch = may_be_listed(batch, key_filter(asins, ["asin"]), ["asin"])
            # Everything below reads the facts; the pages are read once.
            staged = stage(extract_all(batch, kinds), "facts")
            if on_unknown == "drop":
                staged = only_listed(staged, asins, ["asin"])
            else:
                unknown = fk_violations(staged, asins).first()
                if unknown is not None:
                    raise ValueError(f"asin {unknown['asin']!r} is not in asins")
            double = pk_violations(staged.select(F.concat_ws(" ", *PAGE_KEY).alias("page")), "page").first()
            if double is not None:
                raise ValueError(f"page {double['page']!r} occurs {double['n_rows']} times")
            ledgers = {kind: _ledger_before(spark, root, kind, batch_id) for kind in kinds}
            for kind, ledger in ledgers.items():
                again = _loaded_before(facts_of(staged, kind), root, kind, ledger["ranges"]).first()
                if again is not None:
                    raise ValueError(f"page '{again['asin']} {kind.name}' was loaded before")
            for kind, ledger in ledgers.items():
                facts, last = facts_of(staged, kind), ledger["last_id"]
                path = f"{root}/{kind.table}/batch_id={batch_id}"
                numbered_facts(facts, kind, recorded_at=recorded_at, start=last + 1).write.mode("overwrite").parquet(path)
                loaded = spark.read.schema(schema.TABLES[kind.table]).parquet(path)
                n_rows, first, final = loaded.agg(F.count("*"), F.min("asin"), F.max("asin")).first()
                ranges = [*ledger["ranges"], *([(batch_id, first, final)] if n_rows else [])]
                entry = spark.createDataFrame([(n_rows, last + n_rows, ranges)], _LEDGER)
                entry.coalesce(1).write.mode("overwrite").parquet(f"{_ledger(root, kind)}/batch_id={batch_id}")
                errors = extract_errors(facts, kind).drop("page_kind")
                errors.write.mode("overwrite").parquet(
                    f"{root}/extract_errors/page_kind={kind.name}/batch_id={batch_id}"
                )

    return (
        pages.writeStream.foreachBatch(load)
        .option("checkpointLocation", checkpoint)
        .trigger(**(trigger or {"availableNow": True}))
        .start()
    )


def _ledger(root: str, kind: PageKind) -> str:
    return f"{root}/_ledger/{kind.table}"


# The rows of a batch, the last id so far, and the range of identifiers of every batch that has any.
_LEDGER = "n_rows long, last_id long, ranges array<struct<batch_id:long,first:string,last:string>>"


def _ledger_before(spark: SparkSession, root: str, kind: PageKind, batch_id: int) -> dict:
    """The ledger entry of the batch before this one."""
    if batch_id == 0:
        return {"last_id": 0, "ranges": []}
    entry = spark.read.schema(_LEDGER).parquet(f"{_ledger(root, kind)}/batch_id={batch_id - 1}")
    return entry.first().asDict()


def _loaded_before(facts: DataFrame, root: str, kind: PageKind, ranges: list) -> DataFrame:
    """(asin) of facts that an earlier batch has loaded; reads only batches and ranges of identifiers that overlap."""
    low, high = facts.agg(F.min("asin"), F.max("asin")).first()
    met = [batch_id for batch_id, first, last in ranges if low is not None and first <= high and low <= last]
    if not met:
        return facts.select("asin").where(F.lit(False))
    folders = [f"{root}/{kind.table}/batch_id={batch_id}" for batch_id in met]
    earlier = facts.sparkSession.read.schema(schema.TABLES[kind.table]).parquet(*folders).select("asin")
    return earlier.where(F.col("asin").between(low, high)).join(facts.select("asin"), "asin", "left_semi")


def loaded_facts(spark: SparkSession, root: str, kind: PageKind) -> DataFrame:
    """The table a stream has loaded so far, with the batch each row came in."""
    columns = T.StructType([*schema.TABLES[kind.table], T.StructField("batch_id", T.IntegerType())])
    return spark.read.schema(columns).parquet(f"{root}/{kind.table}")
