"""The expected results as SQL over the given tables, one statement per query.

Facts are written in closed form from the columns the pages were made of, without
extraction; the delay is a recursive walk, not the closed form the library uses.
"""

from __future__ import annotations

from pagefacts import fixed_values as fixed

_ASIN = "'B' || lpad(CAST({} AS VARCHAR), 9, '0')"
PART_ASIN = _ASIN.format("p_partkey")
# The identifiers of the lists that pages are selected by.
LISTED = f"{PART_ASIN} NOT LIKE '%7'"
USER_ASIN = _ASIN.format("user_id")
RECORDED_AT = "TIMESTAMP '2024-01-02 03:04:05'"

IDS = f"ids AS (SELECT DISTINCT {USER_ASIN} AS asin FROM events)"

INFO = f"""info AS (
  SELECT {PART_ASIN} AS asin,
         p_brand || ' & ' || p_name AS product_name,
         CAST(CASE WHEN p_partkey % 7 = 0 THEN 0 ELSE p_partkey * 37 END AS INTEGER) AS total_ratings,
         CASE WHEN p_partkey % 11 = 0 THEN NULL ELSE CAST(10 + p_size % 41 AS DOUBLE) / 10 END AS average_rating,
         CAST(p_size * 25 AS INTEGER) AS answered_questions
  FROM part)"""

REVIEWS = f"""reviews AS (
  SELECT {PART_ASIN} AS asin,
         CAST(CASE WHEN p_partkey % 5 = 0 THEN 0 ELSE p_partkey * 41 END AS INTEGER) AS total_reviews,
         CAST(CASE WHEN p_partkey % 6 = 0 THEN 0 ELSE p_partkey * 29 END AS INTEGER) AS positive_reviews,
         CAST(CASE WHEN p_partkey % 8 = 0 THEN 0 ELSE p_partkey * 12 END AS INTEGER) AS critical_reviews
  FROM part)"""

INFO_HTML = f"""info_html AS (
  SELECT {PART_ASIN} AS asin, 'info' AS page_kind,
         '<html><head><title>Amazon.com : ' || p_brand || ' &amp; ' || p_name
         || ' - - Amazon.com</title></head><body>' || chr(10)
         || CASE WHEN p_partkey % 7 = 0 THEN '' ELSE '<span id="acrCustomerReviewText" class="a-size-base">'
              || format('{{:,}}', p_partkey * 37) || ' ratings</span>' || chr(10) END
         || CASE WHEN p_partkey % 11 = 0 THEN ''
              ELSE '<span id="acrPopover" class="reviewCountTextLinkedHistogram noUnderline" title="'
              || format('{{:.1f}}', CAST(10 + p_size % 41 AS DOUBLE) / 10) || ' out of 5 stars">' || chr(10) END
         || '<span class="a-size-base">' || chr(10) || CAST(p_size * 25 AS VARCHAR)
         || CASE WHEN p_size * 25 >= 1000 THEN '+' ELSE '' END
         || ' answered questions' || chr(10) || '</span></body></html>' AS html
  FROM part)"""

REVIEWS_HTML = f"""reviews_html AS (
  SELECT {PART_ASIN} AS asin, 'reviews' AS page_kind,
         '<html><body>' || chr(10)
         || CASE WHEN p_partkey % 5 = 0 THEN ''
              ELSE '<span>Showing 1-10 of ' || format('{{:,}}', p_partkey * 41) || ' reviews</span>' || chr(10) END
         || CASE WHEN p_partkey % 6 = 0 THEN ''
              ELSE '<a>See all ' || format('{{:,}}', p_partkey * 29) || ' positive reviews</a>' || chr(10) END
         || CASE WHEN p_partkey % 8 = 0 THEN ''
              ELSE '<a>See all ' || format('{{:,}}', p_partkey * 12) || ' critical reviews</a>' || chr(10) END
         || '</body></html>' AS html
  FROM part)"""

LOG = f"""log AS (
  SELECT CASE WHEN event_id % 3 = 0 THEN strftime(ts, '%Y-%m-%d') ELSE 'backfill' END AS run_id,
         CASE WHEN user_id % 4 = 3 THEN 'reviews' ELSE 'info' END AS page_kind, {USER_ASIN} AS asin, event_id AS seq,
         CASE WHEN user_id % 10 = 9 THEN 'retry'
              WHEN event_type IN ('view', 'purchase') THEN 'ok'
              WHEN event_type = 'signup' THEN 'invalid'
              WHEN event_type = 'error' AND CAST(regexp_extract(props, '[0-9]+') AS INTEGER) % 2 = 0 THEN 'lost'
              ELSE 'retry' END AS class
  FROM events)"""

ATTEMPTS = f"""{LOG},
attempts AS (
  SELECT *, CAST(row_number() OVER (PARTITION BY run_id, page_kind, asin ORDER BY seq) AS INTEGER) AS iteration
  FROM log)"""

EFFECTIVE = f"""{ATTEMPTS},
effective AS (
  SELECT run_id, page_kind, asin, seq, class, iteration
  FROM attempts AS a
  WHERE iteration <= {fixed.MAX_ITERATIONS} AND NOT EXISTS (
    SELECT 1 FROM attempts AS b
    WHERE b.run_id = a.run_id AND b.page_kind = a.page_kind AND b.asin = a.asin
      AND b.seq < a.seq AND b.class <> 'retry'))"""

OUTCOME = f"""{EFFECTIVE},
outcome AS (
  SELECT run_id, page_kind, asin,
         coalesce(max(CASE WHEN class <> 'retry' THEN class END), 'unscraped') AS outcome,
         CAST(count(*) AS INTEGER) AS attempts
  FROM effective GROUP BY run_id, page_kind, asin)"""

CACHED = f"""{OUTCOME},
cached AS (SELECT DISTINCT asin, page_kind FROM outcome WHERE outcome = 'ok'),
requested AS (
  SELECT {PART_ASIN} AS asin, k.page_kind
  FROM part CROSS JOIN (VALUES ('info'), ('reviews')) AS k(page_kind))"""

DELAYS = f"""{EFFECTIVE},
ordered AS (
  SELECT *, row_number() OVER (PARTITION BY run_id, page_kind ORDER BY seq) AS n FROM effective),
delays(run_id, page_kind, asin, seq, iteration, class, n, delay) AS (
  SELECT run_id, page_kind, asin, seq, iteration, class, n,
         CAST(CASE WHEN class = 'retry' THEN 10 ELSE 0 END AS BIGINT)
  FROM ordered WHERE n = 1
  UNION ALL
  SELECT o.run_id, o.page_kind, o.asin, o.seq, o.iteration, o.class, o.n,
         CASE WHEN o.class = 'retry' THEN d.delay + 10
              WHEN o.class = 'ok' AND d.delay >= 10 THEN d.delay - 10
              ELSE d.delay END
  FROM delays AS d JOIN ordered AS o
    ON o.run_id = d.run_id AND o.page_kind = d.page_kind AND o.n = d.n + 1)"""

# The four references the pages hold, with or without the semicolon (cut titles lose it), as HTML5
# has it. &amp last: what it uncovers is not decoded again.
_DECODED = "html"
for _name, _text in (("middot", "·"), ("copy", "©"), ("quot", '"'), ("amp", "&")):
    _DECODED = f"regexp_replace({_DECODED}, '&{_name};?', '{_text}', 'g')"
_TITLE = fixed.PRODUCT_NAME
TITLES = f"""titles AS (
  SELECT page_id, url, CASE WHEN regexp_matches(text, '{_TITLE}') THEN regexp_extract(text, '{_TITLE}', 2) END
         AS product_name
  FROM (SELECT page_id, url, {_DECODED} AS text FROM pages))"""


def _cell(column: str, width: str) -> str:
    shown = (
        f"CASE WHEN {width} > {fixed.TRUNCATE_AFTER} AND length({column}) > {fixed.TRUNCATE_AFTER} "
        f"THEN substr({column}, 1, {fixed.TRUNCATE_AFTER}) || '...' ELSE {column} END"
    )
    room = f"(CASE WHEN {width} > {fixed.TRUNCATE_AFTER} THEN {fixed.TRUNCATE_AFTER + 3} ELSE {width} END)"
    left = f"CAST(floor(({room} - length({shown})) / 2.0) AS INTEGER)"
    right = f"({room} - length({shown}) - {left})"
    return f"repeat(' ', {left}) || {shown} || repeat(' ', {right})"


def _widths(columns: list[str], source: str) -> str:
    longest = ", ".join(f"greatest(max(length({c})), {len(c)}) AS w_{c}" for c in columns)
    return f"(SELECT {longest} FROM {source})"


def _report(columns: list[str], source: str, key: str) -> str:
    body = " || ' │ ' || ".join(f"({_cell(c, 'w_' + c)})" for c in columns)
    literal = [f"'{c}'" for c in columns]
    head = " || ' │ ' || ".join(f"({_cell(lit, 'w_' + c)})" for lit, c in zip(literal, columns))
    rule = f"regexp_replace(regexp_replace({head}, '[^│]', '─', 'g'), '│', '┼', 'g')"
    widths = _widths(columns, source)
    return f"""
SELECT 0 AS section, {head} AS line FROM {widths}
UNION ALL SELECT 1, {rule} FROM {widths}
UNION ALL SELECT 2, {body} FROM {source} CROSS JOIN {widths}"""


_PAGE_CELLS = """cells AS (
  SELECT page_id AS key, CAST(page_id AS VARCHAR) AS page_id, url, coalesce(product_name, 'None') AS product_name
  FROM titles)"""

_DOUBLES = [("plain", "1"), ("large", "1e5"), ("huge", "1e14"), ("small", "1e-6"), ("tiny", "1e-9")]

_INFO_COLUMNS = [
    "id", "recorded_at", "asin", "product_name", "total_ratings", "average_rating", "answered_questions",
]
_INFO_CELLS = """cells AS (
  SELECT CAST(row_number() OVER (ORDER BY asin) AS VARCHAR) AS id, '2024-01-02 03:04:05' AS recorded_at, asin,
         product_name, CAST(total_ratings AS VARCHAR) AS total_ratings,
         coalesce(CAST(average_rating AS VARCHAR), 'None') AS average_rating,
         CAST(answered_questions AS VARCHAR) AS answered_questions
  FROM info)"""

_NUMBERED_INFO = f"""
SELECT row_number() OVER (ORDER BY asin) AS id, {RECORDED_AT} AS recorded_at, asin,
       product_name, total_ratings, average_rating, answered_questions FROM info"""
_NUMBERED_REVIEWS = f"""
SELECT row_number() OVER (ORDER BY asin) AS id, {RECORDED_AT} AS recorded_at, asin,
       total_reviews, positive_reviews, critical_reviews FROM reviews"""

_RAW_NUMBERS = """raws AS (
  SELECT p_partkey, 'grouped' AS form, '  ' || format('{:,}', p_partkey * 1000003) || chr(10) AS raw FROM part
  UNION ALL SELECT p_partkey, 'decimal', ' ' || CAST(p_retailprice AS VARCHAR) FROM part
  UNION ALL SELECT p_partkey, 'negative', '-' || CAST(p_size AS VARCHAR) || ' ' FROM part
  UNION ALL SELECT p_partkey, 'suffix', CAST(p_size AS VARCHAR) || 'd' FROM part
  UNION ALL SELECT p_partkey, 'words', p_name FROM part)"""


def oracle_sql() -> dict[str, str]:
    sql = {
        # sources
        "id_ingest": f"WITH {IDS} SELECT asin FROM ids ORDER BY asin",
        "id_records": f"""
SELECT DISTINCT CASE WHEN p_partkey % 3 = 0 THEN {PART_ASIN} || chr(10) || '"' || p_brand || '"' ELSE {PART_ASIN} END AS asin
FROM part ORDER BY asin""",
        "cache_scan": f"WITH {INFO_HTML} SELECT asin, page_kind, html FROM info_html",
        "table_scan": f"WITH {REVIEWS} {_NUMBERED_REVIEWS} ORDER BY id",
        "fetch_log_scan": f"""WITH {LOG}, silent AS (SELECT *, user_id % 10 = 9 AS silent FROM events)
SELECT l.run_id, l.page_kind, l.asin, l.seq,
       CAST(CASE WHEN silent THEN 503 WHEN event_type IN ('view', 'purchase', 'click') THEN 200
                 WHEN event_type = 'signup' THEN 404 WHEN l.class = 'retry' THEN 502 END AS INTEGER) AS status,
       CASE WHEN silent THEN NULL WHEN event_type IN ('view', 'purchase') THEN '<html>event ' || event_id || '</html>'
            WHEN event_type = 'click' THEN '<p>{fixed.ROBOT_CHECK.replace("'", "''")}</p>' END AS body
FROM log AS l JOIN silent ON l.seq = event_id""",
        # sinks
        "schema_tables": f"""WITH listed AS (SELECT {PART_ASIN} AS asin FROM part WHERE {LISTED})
SELECT 'asins' AS table_name, 2 AS n_columns, count(*) AS n_rows FROM listed
UNION ALL SELECT 'product_info', 7, count(*) FROM listed
UNION ALL SELECT 'product_reviews', 6, count(*) FROM listed""",
        "load_ids": f"WITH {IDS} SELECT asin, {RECORDED_AT} AS recorded_at FROM ids",
        "load_ids_rejected": f"""
SELECT asin, count(*) AS n_rows
FROM (SELECT {USER_ASIN} AS asin FROM events UNION ALL SELECT {PART_ASIN} FROM part) GROUP BY 1 HAVING count(*) > 1""",
        "load_product_info": f"WITH {INFO} {_NUMBERED_INFO}",
        "load_product_reviews": f"WITH {REVIEWS} {_NUMBERED_REVIEWS}",
        "cache_new_pages": f"""WITH {INFO_HTML}, {REVIEWS_HTML}
SELECT asin, page_kind, html FROM info_html UNION ALL SELECT asin, page_kind, html FROM reviews_html""",
        "cache_buckets": f"""WITH {INFO_HTML}, {REVIEWS_HTML}
SELECT asin, page_kind, html FROM info_html WHERE asin NOT LIKE '%7'
UNION ALL SELECT asin, page_kind, html FROM reviews_html WHERE asin NOT LIKE '%7'""",
        "job_tables": f"""WITH {INFO}
SELECT row_number() OVER (ORDER BY asin) AS id, *, TRUE AS in_time
FROM info WHERE CAST(substr(asin, 2) AS INTEGER) % 3 <> 0""",
        # projections
        "column_names": """
SELECT p_partkey, qualified, list_extract(string_split(qualified, '.'), -1) AS name
FROM (SELECT p_partkey, 'public.' || replace(p_type, ' ', '_') || '.' || p_name AS qualified FROM part)""",
        "own_page_kind": f"""
SELECT asin, regexp_extract(html, '<html lang="(.*?)">', 1) AS lang,
       CAST(regexp_extract(html, 'track\\((\\d+)\\)', 1) AS INTEGER) AS track, 'crawled' AS kind,
       'https://example.com/crawled/' || asin AS url, 'crawled-' || asin || '.html' AS file_name, 'crawled' AS parsed_kind
FROM (SELECT {_ASIN.format("page_id")} AS asin, html FROM pages)""",
        "target_url": f"""WITH {IDS}
SELECT asin, 'info' AS page_kind, '{fixed.INFO_URL.format('')}' || asin AS url FROM ids
UNION ALL SELECT asin, 'reviews', '{fixed.REVIEWS_URL.format('')}' || asin FROM ids""",
        "cache_key": f"""WITH {IDS}
SELECT asin, 'info' AS page_kind, asin || '.html' AS file_name, asin AS parsed_asin, 'info' AS parsed_kind FROM ids
UNION ALL SELECT asin, 'reviews', 'reviews-' || asin || '.html', asin, 'reviews' FROM ids""",
        "page_quality": f"""WITH {LOG}
SELECT 'page' AS source, page_id AS id, true AS usable FROM pages
UNION ALL SELECT 'reply', event_id, event_type <> 'click' FROM events
WHERE event_type IN ('view', 'purchase', 'click') AND user_id % 10 <> 9""",
        "classify_response": f"WITH {LOG} SELECT run_id, page_kind, asin, seq, class FROM log",
        "ok_pages": f"""WITH {LOG}
SELECT run_id, page_kind, asin, seq, '<html>event ' || CAST(seq AS VARCHAR) || '</html>' AS html
FROM log WHERE class = 'ok'""",
        "html_unescape": f"SELECT page_id, {_DECODED} AS text FROM pages",
        "regex_extract": f"""WITH {TITLES}
SELECT t.page_id, t.product_name,
       regexp_extract(p.html, '<html lang="(.*?)">', 1) AS lang,
       CAST(regexp_extract(p.html, 'track\\((\\d+)\\)', 1) AS INTEGER) AS track,
       -1 AS missing
FROM titles AS t JOIN pages AS p USING (page_id)""",
        "extract_errors": f"""
SELECT {PART_ASIN} AS asin, 'info' AS page_kind, 'total_ratings' AS field, p_brand AS raw
FROM part WHERE p_partkey % 7 <> 0""",
        "to_int": f"""WITH {_RAW_NUMBERS}
SELECT p_partkey, form, raw, CASE form
         WHEN 'grouped' THEN CASE WHEN p_partkey * 1000003 <= 2147483647 THEN CAST(p_partkey * 1000003 AS BIGINT) END
         WHEN 'negative' THEN CAST(regexp_extract(raw, '-[0-9]+') AS BIGINT) END AS value
FROM raws""",
        "to_float": f"""WITH {_RAW_NUMBERS}
SELECT p_partkey, form, raw, CASE
         WHEN form IN ('decimal', 'negative') OR (form = 'grouped' AND p_partkey * 1000003 < 1000)
         THEN CAST(trim(raw, ' ' || chr(10)) AS DOUBLE) END AS value
FROM raws""",
        "product_info_facts": f"WITH {INFO} SELECT * FROM info",
        "product_reviews_facts": f"WITH {REVIEWS} SELECT * FROM reviews",
        "fact_listing": f"""WITH {INFO}
SELECT asin, 'product_name' AS field, ' * ' || rpad('product_name', 25, ' ') || product_name AS line FROM info
UNION ALL SELECT asin, 'total_ratings', ' * ' || rpad('total_ratings', 25, ' ') || CAST(total_ratings AS VARCHAR)
FROM info
UNION ALL SELECT asin, 'average_rating',
       ' * ' || rpad('average_rating', 25, ' ') || coalesce(CAST(average_rating AS VARCHAR), 'None') FROM info
UNION ALL SELECT asin, 'answered_questions',
       ' * ' || rpad('answered_questions', 25, ' ') || CAST(answered_questions AS VARCHAR) FROM info""",
        # joins
        "fk_violations": f"""WITH {IDS}
SELECT {PART_ASIN} AS asin, count(*) AS n_rows FROM part
WHERE {PART_ASIN} NOT IN (SELECT asin FROM ids) GROUP BY 1""",
        "cache_hits": f"WITH {CACHED} SELECT asin, page_kind FROM requested INTERSECT SELECT asin, page_kind FROM cached",
        "cache_misses": f"WITH {CACHED} SELECT asin, page_kind FROM requested EXCEPT SELECT asin, page_kind FROM cached",
        "retry_worklist": f"""WITH {OUTCOME}
SELECT run_id, page_kind, asin FROM outcome WHERE outcome = 'unscraped' AND attempts < {fixed.MAX_ITERATIONS}""",
        "product_360": f"""WITH {OUTCOME}, {INFO}, {REVIEWS},
obtained AS (SELECT DISTINCT asin FROM outcome WHERE outcome = 'ok' AND page_kind = 'info')
SELECT r.asin, i.product_name, i.total_ratings, i.average_rating, i.answered_questions,
       r.total_reviews, r.positive_reviews, r.critical_reviews
FROM reviews AS r
LEFT JOIN (SELECT info.* FROM info JOIN obtained USING (asin)) AS i USING (asin)""",
        # aggregations and windows
        "report_widths": f"""WITH {TITLES}, {_PAGE_CELLS}
SELECT CAST(w_page_id AS INTEGER) AS page_id, CAST(w_url AS INTEGER) AS url,
       CAST(w_product_name AS INTEGER) AS product_name
FROM {_widths(["page_id", "url", "product_name"], "cells")}""",
        "iteration_summary": f"""WITH {EFFECTIVE}
SELECT run_id, page_kind, iteration, count(*) AS n_ids,
       count(*) FILTER (WHERE class = 'ok') AS n_ok, count(*) FILTER (WHERE class = 'retry') AS n_retry,
       count(*) FILTER (WHERE class = 'invalid') AS n_invalid, count(*) FILTER (WHERE class = 'lost') AS n_lost
FROM effective GROUP BY run_id, page_kind, iteration""",
        "fetch_outcome": f"WITH {OUTCOME} SELECT * FROM outcome",
        "unscraped_ids": f"WITH {OUTCOME} SELECT run_id, page_kind, asin FROM outcome WHERE outcome = 'unscraped'",
        "invalid_ids": f"WITH {OUTCOME} SELECT run_id, page_kind, asin FROM outcome WHERE outcome = 'invalid'",
        "failed_ids": f"""WITH {OUTCOME}
SELECT run_id, page_kind, asin, outcome AS reason FROM outcome WHERE outcome IN ('unscraped', 'invalid')""",
        "pk_violations": f"SELECT {USER_ASIN} AS asin, count(*) AS n_rows FROM events GROUP BY 1 HAVING count(*) > 1",
        "effective_attempts": f"WITH {EFFECTIVE} SELECT * FROM effective",
        "attempt_iteration": f"WITH {ATTEMPTS} SELECT run_id, page_kind, asin, seq, CAST(iteration AS BIGINT) AS iteration FROM attempts",
        "attempt_position": f"""WITH {EFFECTIVE}
SELECT run_id, page_kind, asin, seq, iteration,
       row_number() OVER w AS position, count(*) OVER (PARTITION BY run_id, page_kind, iteration) AS n_ids,
       lead(seq) OVER w IS NULL AS is_last
FROM effective WINDOW w AS (PARTITION BY run_id, page_kind, iteration ORDER BY seq)""",
        "adaptive_delay": f"""WITH RECURSIVE {DELAYS}
SELECT run_id, page_kind, asin, seq, iteration, class, delay FROM delays""",
        "planned_wait": f"""WITH RECURSIVE {DELAYS},
flagged AS (
  SELECT *, lead(seq) OVER (PARTITION BY run_id, page_kind, iteration ORDER BY seq) IS NULL AS is_last FROM delays)
SELECT run_id, page_kind, CAST(sum(CASE WHEN is_last THEN 0 ELSE delay END) AS BIGINT) AS wait_seconds
FROM flagged GROUP BY run_id, page_kind""",
        "surrogate_id": f"""WITH {EFFECTIVE}
SELECT row_number() OVER (ORDER BY run_id, iteration, asin) AS id, run_id, iteration, asin
FROM effective WHERE class = 'ok'""",
        # report
        "report_cells": f"""WITH {TITLES}, {_PAGE_CELLS}
SELECT key, {", ".join(f"{_cell(c, 'w_' + c)} AS {c}" for c in ["page_id", "url", "product_name"])}
FROM cells CROSS JOIN {_widths(["page_id", "url", "product_name"], "cells")}""",
        "report_doubles": f"""WITH cells AS (
  SELECT p_partkey AS key, {", ".join(f"CAST(p_retailprice * CAST('{x}' AS DOUBLE) AS VARCHAR) AS {c}" for c, x in _DOUBLES)}
  FROM part)
SELECT key, {", ".join(f"{_cell(c, 'w_' + c)} AS {c}" for c, _ in _DOUBLES)}
FROM cells CROSS JOIN {_widths([c for c, _ in _DOUBLES], "cells")}""",
        "report_lines": f"WITH {INFO}, {_INFO_CELLS} {_report(_INFO_COLUMNS, 'cells', 'id')}",
        # streaming
        "stream_facts": f"""WITH {INFO}, {REVIEWS}
SELECT row_number() OVER (ORDER BY asin) AS id, {RECORDED_AT} AS recorded_at, asin,
       product_name, total_ratings, average_rating, answered_questions,
       CAST(NULL AS INTEGER) AS total_reviews, CAST(NULL AS INTEGER) AS positive_reviews,
       CAST(NULL AS INTEGER) AS critical_reviews
FROM info WHERE asin NOT LIKE '%7'
UNION ALL
SELECT row_number() OVER (ORDER BY asin), {RECORDED_AT}, asin, NULL, NULL, NULL, NULL,
       total_reviews, positive_reviews, critical_reviews
FROM reviews WHERE asin NOT LIKE '%7'""",
        "stream_outcomes": f"WITH {OUTCOME} SELECT * FROM outcome",
    }
    for field in ("product_name", "total_ratings", "average_rating", "answered_questions"):
        sql[f"extract_{field}"] = f"WITH {INFO} SELECT asin, {field} FROM info"
    for field in ("total_reviews", "positive_reviews", "critical_reviews"):
        sql[f"extract_{field}"] = f"WITH {REVIEWS} SELECT asin, {field} FROM reviews"
    return sql
