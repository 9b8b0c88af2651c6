"""The driver's tables as corpora, symbols, imports and logs; the same in SQL for the oracle."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from weftline.operators.dealing import dealt, tasks

def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(file_path, text, language): each document a file whose extension is its language."""
    d = read(spark, sf_dir, "documents")
    return d.select(F.concat(F.lit("doc/"), F.col("doc_id"), F.lit("."), F.col("lang")).alias("file_path"), "text", F.col("lang").alias("language"))


DOCUMENTS = "docs AS (SELECT 'doc/' || doc_id || '.' || lang AS file_path, text, lang AS language FROM documents)"
LINES = """raw_lines AS (SELECT file_path, language, regexp_split_to_array(text, '\\r?\\n') AS a FROM docs),
ll AS (SELECT file_path, language, CASE WHEN a[-1] = '' THEN a[:-2] ELSE a END AS a FROM raw_lines)"""

#: Kinds of the symbols that line items stand for, by a number.
KINDS = ("struct", "impl", "method", "function", "field", "Class", "mod", "variable")


def line_symbols(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Line items as symbols of their order: as many lines as the quantity, one after the other, 0-based."""
    w = Window.partitionBy("l_orderkey").orderBy("l_linenumber", "l_partkey", "l_suppkey", "l_quantity")
    q = F.col("l_quantity").cast("int")
    items = read(spark, sf_dir, "lineitem")
    d = dealt(items, tasks(items), "l_orderkey").withColumn("ord", F.row_number().over(w)).withColumn("upto", F.sum(q).over(w.rowsBetween(Window.unboundedPreceding, 0)))
    kinds = F.array(*[F.lit(k) for k in KINDS])
    n = F.col("l_partkey")
    return d.select(
        F.concat(F.lit("order/"), F.col("l_orderkey"), F.lit(".rs")).alias("file_path"), "ord", F.concat(F.lit("o"), F.col("l_orderkey"), F.lit(":"), F.col("ord")).alias("id"),
        F.concat(F.lit("Name"), n % 7).alias("name"), F.element_at(kinds, (n % 8 + 1).cast("int")).alias("kind"),
        F.when(n % 3 == 0, None).when(n % 3 == 1, F.concat(F.lit("a::Name"), n % 5)).otherwise(F.concat(F.lit("Name"), n % 5, F.lit("::"))).alias("scope"),
        (F.col("upto") - q).cast("int").alias("start_line"), (F.col("upto") - 1).cast("int").alias("end_line"), F.concat(F.lit("impl<T> Trait for Name"), n % 5, F.lit("<T> where T: X { }")).alias("signature"),
    )


SYMBOLS = """sym0 AS (SELECT *, row_number() OVER w AS ord, sum(CAST(l_quantity AS INTEGER)) OVER (w ROWS UNBOUNDED PRECEDING) AS upto, CAST(l_quantity AS INTEGER) AS q FROM lineitem
  WINDOW w AS (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_quantity)),
syms AS (SELECT 'order/' || l_orderkey || '.rs' AS file_path, CAST(ord AS INTEGER) AS ord, 'o' || l_orderkey || ':' || ord AS id, 'Name' || (l_partkey % 7) AS name,
  (['struct', 'impl', 'method', 'function', 'field', 'Class', 'mod', 'variable'])[CAST(l_partkey % 8 + 1 AS INTEGER)] AS kind,
  CASE WHEN l_partkey % 3 = 0 THEN NULL WHEN l_partkey % 3 = 1 THEN 'a::Name' || (l_partkey % 5) ELSE 'Name' || (l_partkey % 5) || '::' END AS scope,
  CAST(upto - q AS INTEGER) AS start_line, CAST(upto - 1 AS INTEGER) AS end_line, 'impl<T> Trait for Name' || (l_partkey % 5) || '<T> where T: X { }' AS signature FROM sym0)"""
BOUNDARY = """kept AS (SELECT * FROM syms WHERE lower(kind) IN ('function','struct','enum','trait','impl','class','method','constructor','mod')),
bs AS (SELECT * EXCLUDE (start_line, end_line), start_line + s AS start_line, end_line + s AS end_line FROM (SELECT *, max(CAST(start_line = 0 OR end_line = 0 AS INTEGER)) OVER (PARTITION BY file_path) AS s FROM kept))"""
RANKED = "rk AS (SELECT *, row_number() OVER (PARTITION BY file_path ORDER BY start_line, end_line, id, ord) AS r FROM bs)"


def pack_sql(max_lines: int, source: str = "rk") -> str:
    over = f"x.end_line - x.start_line + 1 <= {max_lines}"
    fits = f"st.open AND greatest(st.e - st.s, 0) + 1 <= {max_lines} AND greatest(greatest(st.e, x.end_line) - st.s, 0) + 1 <= {max_lines}"
    return f"""pk AS (SELECT file_path, r, id, start_line, end_line, 1 AS cid, start_line AS s, end_line AS e, {over.replace('x.', '')} AS open FROM {source} WHERE r = 1
UNION ALL SELECT x.file_path, x.r, x.id, x.start_line, x.end_line, CASE WHEN {fits} THEN st.cid ELSE st.cid + 1 END, CASE WHEN {fits} THEN st.s ELSE x.start_line END,
  CASE WHEN {fits} THEN greatest(st.e, x.end_line) ELSE x.end_line END, CASE WHEN {fits} THEN st.open ELSE {over} END
FROM pk st JOIN {source} x ON x.file_path = st.file_path AND x.r = st.r + 1)"""


_NORM = "lower(regexp_replace(trim({0}), '(::)+$', ''))"
KEYED = f"""ky AS (SELECT *, CASE WHEN k IN ('struct','class','trait','enum','type','mod') THEN nn
    WHEN k = 'impl' THEN lower(trim(split_part(regexp_extract(split_part(split_part(substr(signature, 5), '{{', 1), ' where ', 1), '(?s)^.* for (.*)$', 1), ' ', 1), '<>{{}}(),;'))
    WHEN k = 'function' THEN coalesce(sk, 'fn:' || nn) ELSE sk END AS own, k || ':' || nn AS reopen,
    k IN ('struct','class','trait','enum','type','mod','impl') AS anchor, k IN ('method','constructor','function','field') AS member
  FROM (SELECT *, lower(kind) AS k, {_NORM.format('name')} AS nn, {_NORM.format("string_split(scope, '::')[-1]")} AS sk FROM rk))"""


def semantic_sql(max_lines: int, gap: int = 3) -> str:
    key = "CASE WHEN x.own IS NULL AND x.start_line >= st.s AND x.end_line <= st.e THEN st.key ELSE x.own END"
    joins = (
        f"((coalesce({key} = st.key, false) OR coalesce(x.member AND x.end_line <= st.a, false)) AND x.start_line <= st.e + {gap}"
        f" AND greatest(greatest(st.e, x.end_line) - st.s, 0) + 1 <= {max_lines})"
    )
    pick = lambda a, b: f"CASE WHEN {joins} THEN {a} ELSE {b} END"
    return f"""sm AS (SELECT file_path, r, id, 1 AS cid, start_line AS s, end_line AS e, coalesce(own, reopen) AS key, CASE WHEN anchor THEN end_line END AS a FROM ky WHERE r = 1
UNION ALL SELECT x.file_path, x.r, x.id, {pick('st.cid', 'st.cid + 1')}, {pick('st.s', 'x.start_line')}, {pick('greatest(st.e, x.end_line)', 'x.end_line')},
  {pick('st.key', f'coalesce({key}, x.reopen)')}, {pick('CASE WHEN st.a IS NOT NULL THEN greatest(st.a, x.end_line) END', 'CASE WHEN x.anchor THEN x.end_line END')}
FROM sm st JOIN ky x ON x.file_path = st.file_path AND x.r = st.r + 1)"""


def blocks(spark: SparkSession, sf_dir: str, size: int = 5) -> DataFrame:
    """Symbols of documents: blocks of ``size`` lines, 1-based."""
    from weftline.functions.text import lines

    d = documents(spark, sf_dir).select("file_path", F.size(lines(F.col("text"))).alias("n")).where("n > 0")
    d = d.select("file_path", "n", F.explode(F.sequence(F.lit(0), F.floor((F.col("n") - 1) / size).cast("int"))).alias("b"))
    return d.select(
        "file_path", F.col("b").alias("ord"), F.concat(F.lit("b"), F.lpad(F.col("b").cast("string"), 6, "0")).alias("id"), F.concat(F.lit("block"), F.col("b")).alias("name"), F.lit("function").alias("kind"),
        F.when(F.col("b") % 2 == 0, F.concat(F.lit(" Part"), F.col("b") % 3)).alias("scope"), (F.col("b") * size + 1).alias("start_line"), F.least(F.col("b") * size + size, F.col("n")).alias("end_line"), F.lit(None).cast("string").alias("signature"),
    )


BLOCKS = """bl AS (SELECT file_path, a, len(a) AS n, unnest(range(0, CAST(ceil(len(a) / 5.0) AS BIGINT))) AS b FROM ll WHERE len(a) > 0),
blk AS (SELECT file_path, a, CAST(b AS INTEGER) AS b, 'b' || lpad(CAST(b AS VARCHAR), 6, '0') AS id, CASE WHEN b % 2 = 0 THEN ' Part' || (b % 3) END AS scope,
  CAST(b * 5 + 1 AS INTEGER) AS start_line, CAST(least(b * 5 + 5, n) AS INTEGER) AS end_line FROM bl)"""


def with_header(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents under a generated import header."""
    d = documents(spark, sf_dir)
    n = F.regexp_extract("file_path", r"(\d+)", 1).cast("long")
    head = F.when(n % 4 == 0, F.lit("")).when(n % 4 == 1, F.lit("use std::io;\nuse std::fmt;\nuse std::io;\n\n")).when(n % 4 == 2, F.lit("// note\n\nimport a.b;\n  import c.d;  \n\n\n")).otherwise(F.lit("use x;\nfn main() {}\nuse y;\n"))
    return d.withColumn("text", F.concat(head, "text"))


HEADED = """hd AS (SELECT file_path, language, CASE n % 4 WHEN 0 THEN '' WHEN 1 THEN 'use std::io;' || chr(10) || 'use std::fmt;' || chr(10) || 'use std::io;' || chr(10) || chr(10)
  WHEN 2 THEN '// note' || chr(10) || chr(10) || 'import a.b;' || chr(10) || '  import c.d;  ' || chr(10) || chr(10) || chr(10) ELSE 'use x;' || chr(10) || 'fn main() {}' || chr(10) || 'use y;' || chr(10) END || text AS text
  FROM (SELECT *, CAST(regexp_extract(file_path, '(\\d+)', 1) AS BIGINT) AS n FROM docs)),
hl0 AS (SELECT file_path, regexp_split_to_array(text, '\\r?\\n') AS a FROM hd),
hl AS (SELECT file_path, i, trim(list_extract(a, i), ' ' || chr(9)) AS line FROM (SELECT file_path, a, unnest(range(1, len(a) + 1)) AS i FROM (SELECT file_path, CASE WHEN a[-1] = '' THEN a[:-2] ELSE a END AS a FROM hl0))),
im AS (SELECT *, (starts_with(line, 'use ') OR starts_with(line, 'import ')) AS imp FROM hl),
fi AS (SELECT file_path, min(i) AS first FROM im WHERE imp GROUP BY 1),
sp AS (SELECT im.file_path, min(i) AS stop FROM im JOIN fi USING (file_path) WHERE i > first AND NOT imp AND line <> '' GROUP BY 1),
kp AS (SELECT im.*, row_number() OVER (PARTITION BY im.file_path, line ORDER BY i) AS nth FROM im JOIN fi USING (file_path) LEFT JOIN sp USING (file_path) WHERE i >= first AND i < coalesce(stop, 1000000000)),
imports AS (SELECT file_path, list(line ORDER BY i) AS l FROM kp WHERE line = '' OR nth = 1 GROUP BY 1)"""


def flow_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events of each user as a flow log: purchases acknowledge, errors resume, all others emit."""
    e = read(spark, sf_dir, "events")
    action = F.when(F.col("event_type") == "purchase", "ack").when(F.col("event_type") == "error", "resume").otherwise("emit")
    return e.select(F.col("user_id").alias("job_id"), F.row_number().over(Window.partitionBy("user_id").orderBy("ts", "event_id")).cast("long").alias("seq"), "event_id", action.alias("action"), F.lit(1).cast("long").alias("count"), F.lit(None).cast("double").alias("ts"))
