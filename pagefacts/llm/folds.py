"""The held-out fold, and bounded samples of labelled documents to train on."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

FOLDS = 5
# Rows that a draw looks at, for each that it takes.
AMPLE = 4


def held_out(doc_id: Column) -> Column:
    """True for a fifth of the documents; one without a doc_id counts as held out."""
    text = F.coalesce(doc_id.cast("string"), F.lit(""))
    return F.pmod(F.crc32(text.cast("binary")), F.lit(FOLDS)) == 0


def labelled_sample(docs: DataFrame, labels: DataFrame, label: str, classes: list, per_class: int) -> DataFrame:
    """text and ``label`` of at most ``per_class`` documents of each class, none of them held out.

    ``labels`` has doc_id and ``label``. The documents are drawn by a hash of doc_id. The drawn
    ids, at most ``per_class`` for each class, are small enough to broadcast.
    """
    known = labels.where(~held_out(F.col("doc_id")) & F.col(label).isin(classes))
    # One pass to count and one to draw, whatever the number of classes. The smallest hashes are drawn, so those
    # far beyond the wanted share are left out before the shuffle: a class sends some ``AMPLE * per_class`` rows, however large.
    named = known.select(F.col("doc_id").alias("labelled_id"), label, F.xxhash64("doc_id").alias("_hash"))
    sizes = named.groupBy(label).agg(F.count("*").alias("_size"))
    share = F.col("_hash").cast("double") * 2.0**-64 + 0.5
    near = named.join(F.broadcast(sizes), label).where(share * F.col("_size") <= AMPLE * per_class)
    drawing = Window.partitionBy(label).orderBy("_hash", "labelled_id")
    drawn = near.withColumn("_nth", F.row_number().over(drawing)).where(F.col("_nth") <= per_class)
    drawn = drawn.select("labelled_id", label)
    texts = docs.select("doc_id", "text").where(F.col("text").isNotNull())
    return texts.join(F.broadcast(drawn), F.col("doc_id") == F.col("labelled_id")).select("doc_id", "text", label)
