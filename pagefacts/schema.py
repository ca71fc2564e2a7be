"""Table schemas. Every source is read with one of these; nothing is inferred."""

from pyspark.sql import types as T

_STR, _INT, _LONG = T.StringType(), T.IntegerType(), T.LongType()


def _schema(*columns):
    return T.StructType([T.StructField(name, kind, nullable) for name, kind, nullable in columns])


ASINS = _schema(
    ("asin", _STR, False),
    ("recorded_at", T.TimestampNTZType(), True),
)

PRODUCT_INFO = _schema(
    ("id", _LONG, False),
    ("recorded_at", T.TimestampNTZType(), True),
    ("asin", _STR, True),
    ("product_name", _STR, True),
    ("total_ratings", _INT, True),
    ("average_rating", T.DoubleType(), True),
    ("answered_questions", _INT, True),
)

PRODUCT_REVIEWS = _schema(
    ("id", _LONG, False),
    ("recorded_at", T.TimestampNTZType(), True),
    ("asin", _STR, True),
    ("total_reviews", _INT, True),
    ("positive_reviews", _INT, True),
    ("critical_reviews", _INT, True),
)

# Parent first: children refer to it.
TABLES = {
    "asins": ASINS,
    "product_info": PRODUCT_INFO,
    "product_reviews": PRODUCT_REVIEWS,
}

PAGE_SNAPSHOT = _schema(
    ("asin", _STR, False),
    ("page_kind", _STR, False),
    ("html", _STR, True),
)

# One row per fetch attempt. A NULL status is a request that raised an exception.
FETCH_LOG = _schema(
    ("run_id", _STR, False),
    ("page_kind", _STR, False),
    ("asin", _STR, False),
    ("seq", _LONG, False),
    ("status", _INT, True),
    ("body", _STR, True),
)

EXTRACT_ERRORS = _schema(
    ("asin", _STR, True),
    ("page_kind", _STR, True),
    ("field", _STR, True),
    ("raw", _STR, True),
)
