"""Scalar functions over whole tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from tablewright.functions import text
from tablewright.operators.prepare import calendar_features, coerce_numeric, datetime_share, parse_date
from tablewright.workload import query, table
from tablewright.workload.sqltext import SP

WORDS = f"list_filter(string_split_regex(text, '[{SP}]+'), lambda w: w <> '')"


@query(
    "scalar_string",
    """SELECT p_partkey, replace(lower(trim(concat(' ', p_type, ' ', p_name, ' '))), ' ', '_') AS norm,
    regexp_replace(regexp_replace(lower(concat(p_brand, '--', p_name, '!')), '[^a-z0-9]+', '_', 'g'), '^_+|_+$', '', 'g') AS slug,
    upper(regexp_extract(p_name, '^[^ ]+')) AS token, regexp_matches(lower(p_type), '^(eco|std)|small') AS hit,
    left(concat(p_name, ' / ', p_brand), 12) AS short, concat_ws('|', p_type, p_brand) AS joined,
    list_aggregate(list_transform(string_split(replace(p_name, '_', ' '), ' '), lambda w: concat(upper(w[1]), lower(w[2:]))), 'string_agg', ' ') AS title
    FROM part""",
)
def scalar_string(spark, sf):
    name, brand, kind = F.col("p_name"), F.col("p_brand"), F.col("p_type")
    return table(spark, sf, "part").select(
        "p_partkey",
        text.normalize_name(F.concat(F.lit(" "), kind, F.lit(" "), name, F.lit(" "))).alias("norm"),
        text.slug(F.concat(brand, F.lit("--"), name, F.lit("!"))).alias("slug"),
        text.first_token(name).alias("token"),
        F.lower(kind).rlike("^(eco|std)|small").alias("hit"),
        F.left(F.concat(name, F.lit(" / "), brand), F.lit(12)).alias("short"),
        F.concat_ws("|", kind, brand).alias("joined"),
        text.title_label(name).alias("title"),
    )


@query(
    "scalar_format",
    """SELECT l_returnflag, format('{:,}', count(*)) AS rows_text, printf('%.1f%%', 100.0 * sum(l_discount) / count(*)) AS pct_text
    FROM lineitem GROUP BY 1""",
)
def scalar_format(spark, sf):
    pct = F.sum("l_discount") * 100.0 / F.count(F.lit(1))
    return table(spark, sf, "lineitem").groupBy("l_returnflag").agg(
        F.format_number(F.count(F.lit(1)), 0).alias("rows_text"), F.format_string("%.1f%%", pct).alias("pct_text")
    )


@query(
    "scalar_date",
    """SELECT event_id, year(ts) AS y, month(ts) AS m, isodow(ts) - 1 AS dow, strftime(date_trunc('hour', ts), '%Y-%m-%d %H') AS hour,
    strftime(ts + INTERVAL 36 HOUR, '%Y-%m-%d') AS later, datediff('day', DATE '2024-01-01', CAST(ts AS DATE)) AS day_no FROM events""",
)
def scalar_date(spark, sf):
    ts = F.col("ts")
    return table(spark, sf, "events").select(
        "event_id", F.year(ts).alias("y"), F.month(ts).alias("m"), F.weekday(ts).alias("dow"),
        F.date_format(F.date_trunc("hour", ts), "yyyy-MM-dd HH").alias("hour"),
        F.date_format(ts + F.expr("INTERVAL 36 HOURS"), "yyyy-MM-dd").alias("later"),
        F.date_diff(ts.cast("date"), F.lit("2024-01-01").cast("date")).alias("day_no"),
    )


@query(
    "scalar_math",
    """SELECT l_orderkey, l_partkey, l_suppkey, l_linenumber, round(l_extendedprice / 7, 2) AS r, abs(l_discount - 0.05) AS d,
    greatest(l_quantity, 25) AS hi, least(l_quantity, 25) AS lo, l_extendedprice / nullif(l_tax, 0) AS safe,
    TRY_CAST(concat(l_returnflag, '1') AS INTEGER) IS NULL AS bad FROM lineitem""",
)
def scalar_math(spark, sf):
    return table(spark, sf, "lineitem").select(
        "l_orderkey", "l_partkey", "l_suppkey", "l_linenumber",
        F.round(F.col("l_extendedprice") / 7, 2).alias("r"), F.abs(F.col("l_discount") - 0.05).alias("d"),
        F.greatest("l_quantity", F.lit(25.0)).alias("hi"), F.least("l_quantity", F.lit(25.0)).alias("lo"),
        F.try_divide("l_extendedprice", "l_tax").alias("safe"),
        F.concat("l_returnflag", F.lit("1")).try_cast("int").isNull().alias("bad"),
    )


@query(
    "scalar_array",
    f"""SELECT doc_id, len(w) AS n_words, list_aggregate(w[2:4], 'string_agg', '+') AS part, w[-1] AS last_word,
    len(list_distinct(w)) AS vocabulary FROM (SELECT doc_id, {WORDS} AS w FROM documents)""",
)
def scalar_array(spark, sf):
    w = F.col("w")
    docs = table(spark, sf, "documents", spread=True).select("doc_id", text.words(F.col("text")).alias("w"))
    part = F.slice(w, 2, 3)
    return docs.select(
        "doc_id", F.size(w).alias("n_words"),
        F.when(F.size(part) > 0, F.array_join(part, "+")).alias("part"),
        F.try_element_at(w, F.lit(-1)).alias("last_word"), F.size(F.array_distinct(w)).alias("vocabulary"),
    )


@query(
    "scalar_json",
    """SELECT event_id, CAST(json_extract(props, '$.k') AS INTEGER) AS k, CAST(json_extract(props, '$.k') AS INTEGER) + 1 AS k1,
    concat('{"id":', event_id, ',"kind":"', event_type, '"}') AS doc FROM events""",
)
def scalar_json(spark, sf):
    packed = F.struct(F.col("event_id").alias("id"), F.col("event_type").alias("kind"))
    return table(spark, sf, "events").select(
        "event_id", F.get_json_object("props", "$.k").cast("int").alias("k"),
        (F.from_json("props", "k int")["k"] + 1).alias("k1"), F.to_json(packed).alias("doc"),
    )


EVENT_FILES = """SELECT p_partkey, concat(CASE p_type WHEN 'ECONOMY' THEN 'raw/' WHEN 'SMALL' THEN 'venv/lib/' ELSE '' END,
  CASE p_brand WHEN 'Brand#1' THEN 'Predictions_' WHEN 'Brand#2' THEN 'leaderboard_' WHEN 'Brand#3' THEN '.' ELSE '' END, replace(p_name, ' ', '_'),
  CASE p_size WHEN 1 THEN '.PNG' WHEN 2 THEN '.wav' WHEN 3 THEN '.webm' WHEN 4 THEN '.mp4' WHEN 5 THEN '' WHEN 6 THEN '.tar.gif' WHEN 7 THEN '.' ELSE '.csv' END) AS path,
  CASE p_size WHEN 8 THEN 'image/x' WHEN 9 THEN 'audio/ogg' WHEN 3 THEN 'video/webm' WHEN 10 THEN 'text/plain' WHEN 4 THEN 'text/csv' WHEN 2 THEN 'application/x' END AS mime
  FROM part"""


def part_files(spark, sf):
    """A file name and MIME type per part, from its type, brand, name and size."""
    size = F.col("p_size")

    def choose(c, pairs, other=None):
        out = None
        for k, v in pairs.items():
            out = F.when(c == k, v) if out is None else out.when(c == k, v)
        return out if other is None else out.otherwise(other)

    folder = choose(F.col("p_type"), {"ECONOMY": "raw/", "SMALL": "venv/lib/"}, "")
    prefix = choose(F.col("p_brand"), {"Brand#1": "Predictions_", "Brand#2": "leaderboard_", "Brand#3": "."}, "")
    ending = choose(size, {1: ".PNG", 2: ".wav", 3: ".webm", 4: ".mp4", 5: "", 6: ".tar.gif", 7: "."}, ".csv")
    mime = choose(size, {8: "image/x", 9: "audio/ogg", 3: "video/webm", 10: "text/plain", 4: "text/csv", 2: "application/x"})
    name = F.replace(F.col("p_name"), F.lit(" "), F.lit("_"))
    return table(spark, sf, "part").select(
        "p_partkey", F.concat(folder, prefix, name, ending).alias("path"), mime.alias("mime")
    )


@query(
    "modality",
    f"""WITH f AS ({EVENT_FILES}), e AS (SELECT *, lower(regexp_extract(path, '[^/.][^/]*?(\\.[^./]+)$', 1)) AS ext FROM f)
    SELECT p_partkey, ext, CASE WHEN mime IS NOT NULL THEN CASE WHEN contains(mime, 'csv') THEN 'tabular'
      WHEN contains(mime, 'image') OR ext IN ('.png', '.gif') THEN 'image' WHEN contains(mime, 'audio') OR ext IN ('.wav') THEN 'audio'
      WHEN contains(mime, 'video') OR ext IN ('.mp4') THEN 'video' ELSE 'tabular' END
    ELSE CASE WHEN ext IN ('.png', '.gif') THEN 'image' WHEN ext = '.wav' THEN 'audio' WHEN ext IN ('.mp4', '.webm') THEN 'video' ELSE 'tabular' END END AS modality
    FROM e""",
)
def modality(spark, sf):
    return part_files(spark, sf).select(
        "p_partkey", text.file_extension(F.col("path")).alias("ext"),
        text.modality(F.col("path"), F.col("mime")).alias("modality"),
    )


@query(
    "calendar_features",
    """SELECT o_orderkey, year(o_orderdate) AS o_orderdate_year, month(o_orderdate) AS o_orderdate_month,
    isodow(o_orderdate) - 1 AS o_orderdate_dow FROM orders""",
)
def calendar(spark, sf):
    return calendar_features(table(spark, sf, "orders").select("o_orderkey", "o_orderdate"), ["o_orderdate"])


MIXED = """SELECT o_orderkey, CASE WHEN o_orderstatus = 'P' AND o_orderpriority = '1-URGENT' THEN concat('x', strftime(o_orderdate, '%Y-%m-%d'))
  ELSE strftime(o_orderdate, '%Y-%m-%d') END AS day_text,
  CASE WHEN o_orderpriority = '5-LOW' THEN concat('n', o_totalprice) ELSE CAST(o_totalprice AS VARCHAR) END AS price_text,
  strftime(o_orderdate, '%d/%m/%Y') AS local_text, o_orderstatus FROM orders"""


def mixed_text(spark, sf):
    """Orders as a file would hold them: dates and prices as text, some unreadable."""
    day = F.date_format("o_orderdate", "yyyy-MM-dd")
    odd = (F.col("o_orderstatus") == "P") & (F.col("o_orderpriority") == "1-URGENT")
    price = F.col("o_totalprice").cast("string")
    return table(spark, sf, "orders").select(
        "o_orderkey",
        F.when(odd, F.concat(F.lit("x"), day)).otherwise(day).alias("day_text"),
        F.when(F.col("o_orderpriority") == "5-LOW", F.concat(F.lit("n"), price)).otherwise(price).alias("price_text"),
        F.date_format("o_orderdate", "dd/MM/yyyy").alias("local_text"), "o_orderstatus",
    )


@query(
    "datetime_detect",
    f"""WITH t AS ({MIXED}), s AS (SELECT
    avg(CASE WHEN TRY_CAST(day_text AS TIMESTAMP) IS NOT NULL THEN 1.0 ELSE 0.0 END) AS a,
    avg(CASE WHEN try_strptime(local_text, '%d/%m/%Y') IS NOT NULL THEN 1.0 ELSE 0.0 END) AS b FROM t)
    SELECT 'day_text' AS "column", round(a, 6) AS parsed, a > 0.9 AS is_date FROM s
    UNION ALL SELECT 'local_text', round(b, 6), b > 0.9 FROM s UNION ALL SELECT 'price_text', 0.0, false
    UNION ALL SELECT 'o_orderstatus', 0.0, false""",
)
def datetime_detect(spark, sf):
    return datetime_share(mixed_text(spark, sf))


# one moment per order, written in the shape that the key's remainder names: DuckDB's and Spark's format of each
SHAPES = [
    ("%Y-%m-%dT%H:%M:%S.%fZ", "yyyy-MM-dd'T'HH:mm:ss.SSSSSS'Z'"), ("%-d %b %Y", "d MMM yyyy"), ("%B %-d, %Y", "MMMM d, yyyy"),
    ("%-m/%-d/%Y %I:%M %p", "M/d/yyyy hh:mm a"), ("%Y/%m/%d %H:%M", "yyyy/MM/dd HH:mm"), ("%d-%b-%Y", "dd-MMM-yyyy"),
    ("%d.%m.%Y", "dd.MM.yyyy"), ("%Y%m%d", "yyyyMMdd"), ("about %Y", "'about' yyyy"),
]


@query(
    "datetime_shapes",
    f"""WITH m AS (SELECT o_orderkey, CAST(o_orderdate AS TIMESTAMP) + to_seconds(o_orderkey * 37 % 86400) AS moment FROM orders),
    t AS (SELECT o_orderkey, CASE o_orderkey % {len(SHAPES)} {' '.join(f"WHEN {i} THEN strftime(moment, '{d}')" for i, (d, _) in enumerate(SHAPES))} END AS day_text FROM m)
    SELECT o_orderkey, day_text, strftime(coalesce(try_strptime(day_text, '%m.%d.%Y'), {', '.join(f"try_strptime(day_text, '{d}')" for d, _ in SHAPES[:-1])}),
    '%Y-%m-%d %H:%M:%S') AS parsed FROM t""",
)
def datetime_shapes(spark, sf):
    at = F.col("o_orderdate").cast("timestamp") + F.make_dt_interval(secs=F.col("o_orderkey") * 37 % 86400)
    shape = F.col("o_orderkey") % len(SHAPES)
    text = F.coalesce(*[F.when(shape == i, F.date_format(at, form)) for i, (_, form) in enumerate(SHAPES)])
    frame = table(spark, sf, "orders").select("o_orderkey", text.alias("day_text"))
    return frame.withColumn("parsed", F.date_format(parse_date("day_text"), "yyyy-MM-dd HH:mm:ss"))


@query(
    "coerce_numeric",
    f"""SELECT o_orderkey, TRY_CAST(price_text AS DOUBLE) AS price FROM ({MIXED}) WHERE TRY_CAST(price_text AS DOUBLE) IS NOT NULL""",
)
def numeric_coercion(spark, sf):
    frame = mixed_text(spark, sf).select("o_orderkey", F.col("price_text").alias("price"))
    return coerce_numeric(frame, "price")
