"""Every query of the library by name, with the SQL it must equal."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from weftline.extract.registry import call_edges_of, extract, import_edges_of, symbols_of
from weftline.functions.globs import glob_regex, scan_filter
from weftline.functions.imports import normalize_import
from weftline.functions.text import chunk_kind, chunk_label, extension, language_of, lines, n_lines, relative_path
from weftline.operators import chunking, events
from weftline.operators.symbols import boundary_symbols, enclosing, normalize_symbols, symbol_error, symbol_index
from weftline.options import ChunkingOptions, FlowOptions, IndexOptions
from weftline.plans import corpora as c
from weftline.streaming.flow import flow_log

QUERIES: dict = {}
ORACLES: dict = {}
#: Of a digest and of counts the queries return these types.
LONG = "long"


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return add


@query(f"WITH {c.DOCUMENTS}, {c.LINES} SELECT file_path, CAST(i AS BIGINT) AS line_no, list_extract(a, i) AS line FROM (SELECT file_path, a, unnest(range(1, len(a) + 1)) AS i FROM ll)")
def numbered_lines(spark, sf_dir):
    d = c.documents(spark, sf_dir).select("file_path", F.posexplode(lines(F.col("text"))).alias("i", "line"))
    return d.select("file_path", (F.col("i") + 1).cast(LONG).alias("line_no"), "line")


_FULL = f"""WITH {c.DOCUMENTS}, {c.LINES} SELECT 'chk-' || md5(text) AS id, file_path, CAST(1 AS BIGINT) AS start_line, CAST(greatest(len(a), 1) AS BIGINT) AS end_line, text AS content, md5(text) AS md5,
 CAST(strlen(text) AS BIGINT) AS size, language, 'FullFile' AS chunk_kind FROM docs JOIN ll USING (file_path, language)"""


@query(_FULL)
def fullfile_chunks(spark, sf_dir):
    f = chunking.full_file_chunks(c.documents(spark, sf_dir))
    return f.select("id", "file_path", F.col("start_line").cast(LONG), F.col("end_line").cast(LONG), "content", "md5", F.col("size").cast(LONG), "language", "chunk_kind")


@query(f"""WITH {c.DOCUMENTS}, {c.LINES} SELECT '{{"protocol_version":"1.0.0","type":"event","event":"chunk_emitted","job_id":"job-1","payload":{{"chunk_id":"chk-' || md5(text) || '","chunk_kind":"FullFile","file":"' || file_path
 || '","language":"' || language || '","symbol_id":null,"start_line":1,"end_line":' || greatest(len(a), 1) || ',"text":' || CAST(to_json(text) AS VARCHAR) || ',"chunk_md5":"' || md5(text) || '","size":' || strlen(text) || '}}}}' AS value
 FROM docs JOIN ll USING (file_path, language)""")
def chunk_emitted_log(spark, sf_dir):
    return events.chunk_emitted(chunking.full_file_chunks(c.documents(spark, sf_dir)), "job-1")


@query(f"WITH {c.SYMBOLS}, {c.BOUNDARY} SELECT file_path, id, kind, CAST(start_line AS BIGINT) AS start_line, CAST(end_line AS BIGINT) AS end_line FROM bs")
def boundary_symbols_repaired(spark, sf_dir):
    return boundary_symbols(c.line_symbols(spark, sf_dir)).select("file_path", "id", "kind", F.col("start_line").cast(LONG), F.col("end_line").cast(LONG))


def _bs(spark, sf_dir) -> DataFrame:
    return boundary_symbols(c.line_symbols(spark, sf_dir))


_R = f"{c.SYMBOLS}, {c.BOUNDARY}, {c.RANKED}"


@query(f"WITH RECURSIVE {_R}, {c.pack_sql(60)} SELECT file_path, id, CAST(cid AS BIGINT) AS cid FROM pk")
def pack_groups(spark, sf_dir):
    return chunking.pack_groups(_bs(spark, sf_dir), 60).select("file_path", "id", "cid")


@query(f"WITH RECURSIVE {_R}, {c.KEYED}, {c.semantic_sql(80)} SELECT file_path, id, CAST(cid AS BIGINT) AS cid, last_value(key) OVER (PARTITION BY file_path, cid ORDER BY r ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING) AS semantic_key FROM sm")
def semantic_groups(spark, sf_dir):
    return chunking.semantic_groups(_bs(spark, sf_dir), 80).select("file_path", "id", "cid", "semantic_key")


_PACKED = f"""WITH RECURSIVE {_R}, {c.pack_sql(60)}, ch AS (SELECT file_path, cid, min(start_line) AS start_line, max(end_line) AS end_line, list(id ORDER BY start_line, end_line, id) AS ids FROM pk GROUP BY 1, 2)"""


def _packed(spark, sf_dir) -> DataFrame:
    g = chunking.pack_groups(_bs(spark, sf_dir), 60)
    return g.groupBy("file_path", "cid").agg(F.min("start_line").alias("start_line"), F.max("end_line").alias("end_line"), F.sort_array(F.collect_list(F.struct("start_line", "end_line", "id"))).alias("x")).withColumn("ids", F.transform("x", lambda v: v["id"]))


@query(_PACKED + """ SELECT file_path, 'chk-line-' || sha256(file_path || ':' || start_line || ':' || end_line || ':' || array_to_string(ids, '|')) AS id, CAST(start_line AS BIGINT) AS start_line, CAST(end_line AS BIGINT) AS end_line, ids[1] AS symbol_id,
 CAST(len(ids) AS BIGINT) AS n_symbols FROM ch""")
def line_limited_chunk_ids(spark, sf_dir):
    files = c.line_symbols(spark, sf_dir).select("file_path").distinct().select("file_path", F.lit("x").alias("text"), F.lit("rust").alias("language"))
    out = chunking.line_limited_chunks(files, _bs(spark, sf_dir), 60, "sha256").where("chunk_kind = 'Symbol'")
    return out.select("file_path", "id", F.col("start_line").cast(LONG), F.col("end_line").cast(LONG), "symbol_id", F.size("symbol_ids").cast(LONG).alias("n_symbols"))


@query(_PACKED + """, o AS (SELECT *, lag(ids[1]) OVER w AS prev, lead(ids[1]) OVER w AS next FROM ch WINDOW w AS (PARTITION BY file_path ORDER BY start_line, end_line, ids[1]))
SELECT file_path, ids[1] AS id, prev AS previous_chunk_id, next AS next_chunk_id, CAST(CASE WHEN prev IS NULL THEN start_line ELSE greatest(start_line - 2, 0) END AS BIGINT) AS start_line, CAST(CASE WHEN next IS NULL THEN end_line ELSE end_line + 2 END AS BIGINT) AS end_line FROM o""")
def overlap_neighbours(spark, sf_dir):
    w = Window.partitionBy("file_path").orderBy("start_line", "end_line", "id")
    p = _packed(spark, sf_dir).select("file_path", F.element_at("ids", 1).alias("id"), "start_line", "end_line").withColumn("previous_chunk_id", F.lag("id").over(w)).withColumn("next_chunk_id", F.lead("id").over(w))
    return p.select(
        "file_path", "id", "previous_chunk_id", "next_chunk_id", F.when(F.col("previous_chunk_id").isNull(), F.col("start_line")).otherwise(F.greatest(F.col("start_line") - 2, F.lit(0))).cast(LONG).alias("start_line"),
        F.when(F.col("next_chunk_id").isNull(), F.col("end_line")).otherwise(F.col("end_line") + 2).cast(LONG).alias("end_line"),
    )


_D = f"WITH {c.DOCUMENTS}, {c.LINES}, {c.BLOCKS}"
_CUT = "array_to_string(a[{0}:{1}], chr(10)) || chr(10)"


#: Every third block is a line longer, where its document has one, and then over the limit.
_MIXED = "mx AS (SELECT * EXCLUDE (end_line), CAST(least(end_line + CASE WHEN b % 3 = 2 THEN 1 ELSE 0 END, len(a)) AS INTEGER) AS end_line FROM blk)"


def _mixed(spark, sf_dir) -> DataFrame:
    n = c.documents(spark, sf_dir).select("file_path", F.size(lines(F.col("text"))).alias("n"))
    b = c.blocks(spark, sf_dir).join(n, "file_path")
    return b.withColumn("end_line", F.least(F.col("end_line") + F.when(F.col("ord") % 3 == 2, 1).otherwise(0), F.col("n"))).drop("n")


@query(_D + f""", {_MIXED}, x AS (SELECT *, {_CUT.format('start_line', 'end_line')} AS content FROM mx WHERE end_line - start_line + 1 <= 5)
SELECT 'chk-' || replace(file_path, '/', '_') || '-' || start_line || '-' || end_line AS id, file_path, CAST(start_line AS BIGINT) AS start_line, CAST(end_line AS BIGINT) AS end_line, content, md5(content) AS md5, CAST(end_line - start_line + 1 AS BIGINT) AS size, id AS symbol_id FROM x""")
def boundary_chunks(spark, sf_dir):
    d = c.documents(spark, sf_dir)
    out = chunking.boundary_chunks(d, _mixed(spark, sf_dir), 5).where("chunk_kind = 'Symbol'")
    return out.select("id", "file_path", F.col("start_line").cast(LONG), F.col("end_line").cast(LONG), "content", "md5", F.col("size").cast(LONG), "symbol_id")


_OV = f""", b AS (SELECT *, 'chk-' || replace(file_path, '/', '_') || '-' || start_line || '-' || end_line AS cid FROM blk),
o AS (SELECT *, lag(cid) OVER w AS prev, lead(cid) OVER w AS next FROM b WINDOW w AS (PARTITION BY file_path ORDER BY start_line, end_line, cid)),
e AS (SELECT file_path, a, prev, next, cid, CASE WHEN prev IS NULL THEN start_line ELSE greatest(start_line - 1, 0) END AS s, CASE WHEN next IS NULL THEN end_line ELSE end_line + 1 END AS e, (prev IS NOT NULL OR next IS NOT NULL) AS moved FROM o),
x AS (SELECT *, {_CUT.format('greatest(s, 1)', 'e')} AS content FROM e)"""


@query(_D + _OV + " SELECT file_path, CASE WHEN moved THEN 'chk-ov-' || sha256(content) ELSE cid END AS id, CAST(s AS BIGINT) AS start_line, CAST(e AS BIGINT) AS end_line, content, prev AS previous_chunk_id, next AS next_chunk_id FROM x")
def overlap_chunks(spark, sf_dir):
    d = c.documents(spark, sf_dir)
    base = chunking.boundary_chunks(d, c.blocks(spark, sf_dir)).where("chunk_kind = 'Symbol'")
    out = chunking.overlap_chunks(d, base, 1, "sha256")
    return out.select("file_path", "id", F.col("start_line").cast(LONG), F.col("end_line").cast(LONG), "content", "metadata.previous_chunk_id", "metadata.next_chunk_id")


@query(f"WITH {c.DOCUMENTS}, {c.HEADED} SELECT file_path, coalesce(array_to_string(l, '|'), '') AS imports, CAST(coalesce(len(l), 0) AS BIGINT) AS n FROM docs LEFT JOIN imports USING (file_path)")
def leading_imports(spark, sf_dir):
    i = chunking.leading_imports(F.col("text"))
    return c.with_header(spark, sf_dir).select("file_path", i.alias("i")).select("file_path", F.array_join("i", "|").alias("imports"), F.size("i").cast(LONG).alias("n"))


@query(f"""WITH {c.DOCUMENTS}, {c.LINES}, {c.BLOCKS}, {c.HEADED}, x AS (SELECT b.file_path, b.id, coalesce(l, []) AS l, CASE WHEN scope IS NULL THEN [] ELSE ['scope: ' || trim(scope)] END AS s, {_CUT.format('start_line', 'end_line')} AS content
 FROM blk b LEFT JOIN imports USING (file_path)), y AS (SELECT *, CASE WHEN len(l) + len(s) > 0 THEN array_to_string(list_concat(l, list_concat(CASE WHEN len(l) > 0 AND len(s) > 0 THEN [''] ELSE [] END, s)), chr(10)) || chr(10) || chr(10) ELSE '' END || content AS text FROM x)
SELECT file_path, id AS symbol_id, text AS content, CAST(strlen(text) AS BIGINT) AS size, sha256(text) AS md5, CAST(len(list_filter(l, lambda v: v <> '')) AS BIGINT) AS context_import_count FROM y WHERE len(l) + len(s) > 0""")
def context_chunks(spark, sf_dir):
    d, headed, s = c.documents(spark, sf_dir), c.with_header(spark, sf_dir), c.blocks(spark, sf_dir)
    base = chunking.boundary_chunks(d, s).where("chunk_kind = 'Symbol'")
    out = chunking.context_chunks(headed, base, s, "sha256").where("metadata.has_context_prefix")
    return out.select("file_path", "symbol_id", "content", F.col("size").cast(LONG), "md5", "metadata.context_import_count")


@query("""WITH s AS (SELECT p_brand AS file_path, p_type AS kind, 'n' || p_size AS name, p_partkey AS ord, p_partkey % 97 AS a, p_partkey % 97 + p_size AS b, CASE WHEN p_partkey % 11 = 0 THEN '' ELSE 'p' || p_partkey END AS id FROM part),
v AS (SELECT * FROM s WHERE id <> '')
SELECT file_path, id, 'q::' || name AS qualified_name, count(*) OVER g > 1 AS is_overloaded, CAST(CASE WHEN count(*) OVER g > 1 THEN row_number() OVER (PARTITION BY file_path, kind, name ORDER BY a, b, ord) - 1 ELSE 0 END AS BIGINT) AS overload_index FROM v WINDOW g AS (PARTITION BY file_path, kind, name)""")
def overloads(spark, sf_dir):
    p, k = c.read(spark, sf_dir, "part"), F.col("p_partkey")
    s = p.select(F.col("p_brand").alias("file_path"), k.alias("ord"), F.when(k % 11 == 0, "").otherwise(F.concat(F.lit("p"), k)).alias("id"), F.concat(F.lit("n"), F.col("p_size")).alias("name"), F.col("p_type").alias("kind"), F.lit("q::").alias("scope"), (k % 97).cast("int").alias("start_line"), (k % 97 + F.col("p_size")).cast("int").alias("end_line"), F.lit("").alias("signature"))
    return normalize_symbols(s).select("file_path", "id", "qualified_name", "is_overloaded", F.col("overload_index").cast(LONG))


@query(f"WITH {c.SYMBOLS} SELECT id, CASE WHEN scope IS NULL OR scope = '' THEN name ELSE regexp_replace(trim(scope), '(::)+$', '') || '::' || name END AS qualified_name, CASE WHEN name = '' THEN 'EmptySymbolName' WHEN id = '' THEN 'EmptySymbolId' END AS error FROM syms")
def qualified_names(spark, sf_dir):
    from weftline.functions.text import qualified_name

    return c.line_symbols(spark, sf_dir).select("id", qualified_name(F.col("name"), F.col("scope")).alias("qualified_name"), symbol_error(F.col("name"), F.col("id")).alias("error"))


#: Import statements of each language; N stands for a nation's name, R for its region's.
STATEMENTS = {
    "rust": ("use std::N;", "pub use crate::N::R;", "use N::R as Alias;", " use self::N::*; ", "use N;", "pub(crate) use N::R;", "use N::{R, A};", "pub use N::*;"),
    "typescript": ('import { N } from "R";', 'import N from "./R";', "import * as N from '../R';", 'import "N/R";', 'import { N as R } from "x";', "import { N } from 'R'", 'import {} from "N";', 'import { a, N as R } from "./y";', "import type from from 'N';"),
    "java": ("import N.R;", "import static N.R.Of;", "import N.*;", "import N;", "import static N;"),
    "go": ('import "N"', 'import "./N/R"', 'import R "N"', "import `../N`", 'import "N";'),
    "python": ("import N", "from N import R"),
}


def _literal(s: str) -> str:
    return "'" + s.replace("'", "''") + "'"


def _statements_sql(language: str) -> str:
    rows = ", ".join(f"({i}, {_literal(s)})" for i, s in enumerate(STATEMENTS[language]))
    return f"raws AS (SELECT n_nationkey * 100 + v.i AS stmt, replace(replace(v.s, 'N', replace(n_name, ' ', '_')), 'R', replace(r_name, ' ', '_')) AS raw FROM nation JOIN region ON n_regionkey = r_regionkey CROSS JOIN (VALUES {rows}) v(i, s)), t AS (SELECT stmt, raw, trim(raw) AS t FROM raws)"


_CUTSEMI = "trim(rtrim(trim({0}), ';'))"
_IMPORT_SQL = {
    "rust": """, b AS (SELECT *, starts_with(t, 'pub') AS p, CASE WHEN starts_with(t, 'pub ') THEN substr(t, 5) ELSE t END AS u FROM t), d AS (SELECT *, trim(rtrim(trim(CASE WHEN starts_with(u, 'use ') THEN substr(u, 5) ELSE u END), ';')) AS body,
 contains(raw, 'crate::') OR contains(raw, 'self::') OR contains(raw, 'super::') OR contains(raw, './') AS resolved FROM b), e AS (SELECT *, trim(regexp_extract(body, '(?s)^(.*) as (.*)$', 1)) AS bf FROM d)
SELECT stmt, CASE WHEN ends_with(body, '::*') THEN trim(left(body, length(body) - 3)) WHEN contains(body, ' as ') THEN bf WHEN contains(body, '::') THEN regexp_extract(body, '(?s)^(.*)::(.*)$', 1) ELSE body END AS to_module,
 CASE WHEN ends_with(body, '::*') THEN NULL WHEN contains(body, ' as ') THEN string_split(bf, '::')[-1] WHEN contains(body, '::') THEN regexp_extract(body, '(?s)^(.*)::(.*)$', 2) END AS imported_symbol,
 CASE WHEN ends_with(body, '::*') THEN NULL WHEN contains(body, ' as ') THEN trim(regexp_extract(body, '(?s)^(.*) as (.*)$', 2)) END AS alias,
 CASE WHEN ends_with(body, '::*') THEN 'namespace' WHEN contains(body, ' as ') THEN 'named' WHEN p THEN 'reexport' ELSE 'named' END AS import_kind, resolved FROM e""",
    "java": """, b AS (SELECT *, trim(rtrim(trim(CASE WHEN starts_with(t, 'import ') THEN substr(t, 8) ELSE t END), ';')) AS x FROM t), d AS (SELECT *, CASE WHEN starts_with(x, 'static ') THEN substr(x, 8) ELSE x END AS body FROM b)
SELECT stmt, CASE WHEN contains(body, '.') THEN regexp_extract(body, '(?s)^(.*)\\.(.*)$', 1) ELSE body END AS to_module, CASE WHEN contains(body, '.') THEN regexp_extract(body, '(?s)^(.*)\\.(.*)$', 2) END AS imported_symbol, CAST(NULL AS VARCHAR) AS alias, 'named' AS import_kind, false AS resolved FROM d""",
    "go": """, b AS (SELECT *, trim(rtrim(trim(CASE WHEN starts_with(t, 'import ') THEN substr(t, 8) ELSE t END), ';')) AS x FROM t), d AS (SELECT *, CASE WHEN (starts_with(x, '"') AND ends_with(x, '"')) OR (starts_with(x, '`') AND ends_with(x, '`')) THEN substr(x, 2, length(x) - 2) ELSE x END AS m FROM b)
SELECT stmt, m AS to_module, CAST(NULL AS VARCHAR) AS imported_symbol, CAST(NULL AS VARCHAR) AS alias, 'named' AS import_kind, starts_with(m, './') OR starts_with(m, '../') AS resolved FROM d""",
    "python": " SELECT stmt, raw AS to_module, CAST(NULL AS VARCHAR) AS imported_symbol, CAST(NULL AS VARCHAR) AS alias, 'named' AS import_kind, false AS resolved FROM t",
    "typescript": """, b AS (SELECT *, starts_with(t, 'import ') AND ends_with(t, ';') AS fits, trim(substr(t, 8, greatest(length(t) - 8, 0))) AS x FROM t),
d AS (SELECT *, (starts_with(x, '"') AND ends_with(x, '"')) OR (starts_with(x, '''') AND ends_with(x, '''')) AS quoted, trim(regexp_extract(x, '(?s)^(.*?) from (.*)$', 1)) AS l, trim(rtrim(trim(regexp_extract(x, '(?s)^(.*?) from (.*)$', 2)), ';')) AS m0, contains(x, ' from ') AS f FROM b),
e AS (SELECT *, CASE WHEN (starts_with(m0, '"') AND ends_with(m0, '"')) OR (starts_with(m0, '''') AND ends_with(m0, '''')) THEN substr(m0, 2, length(m0) - 2) ELSE m0 END AS m, trim(substr(l, 2, greatest(length(l) - 2, 0))) AS inn FROM d),
g AS (SELECT *, CASE WHEN NOT fits THEN 'same' WHEN quoted THEN 'side' WHEN starts_with(x, '* as ') AND f THEN 'star' WHEN f AND NOT starts_with(l, '{') AND NOT starts_with(l, '*') THEN 'default' WHEN f AND starts_with(l, '{') AND ends_with(l, '}') AND contains(inn, ' as ') THEN 'alias' WHEN f AND starts_with(l, '{') AND ends_with(l, '}') THEN 'plain' ELSE 'same' END AS c FROM e)
SELECT stmt, CASE c WHEN 'same' THEN raw WHEN 'side' THEN substr(x, 2, length(x) - 2) ELSE m END AS to_module,
 CASE c WHEN 'default' THEN 'default' WHEN 'alias' THEN trim(regexp_extract(inn, '(?s)^(.*) as (.*)$', 1)) WHEN 'plain' THEN nullif(inn, '') END AS imported_symbol,
 CASE c WHEN 'star' THEN trim(substr(l, 6)) WHEN 'default' THEN l WHEN 'alias' THEN trim(regexp_extract(inn, '(?s)^(.*) as (.*)$', 2)) END AS alias,
 CASE c WHEN 'side' THEN 'side_effect' WHEN 'star' THEN 'namespace' WHEN 'default' THEN 'default' ELSE 'named' END AS import_kind, c NOT IN ('same', 'side') AND (starts_with(m, './') OR starts_with(m, '../')) AS resolved FROM g""",
}


def _imports(language: str):
    def run(spark, sf_dir):
        n, r = c.read(spark, sf_dir, "nation"), c.read(spark, sf_dir, "region")
        v = spark.createDataFrame(list(enumerate(STATEMENTS[language])), "i int, s string")
        name = lambda x: F.replace(x, F.lit(" "), F.lit("_"))
        raw = F.replace(F.replace("s", F.lit("N"), name(F.col("n_name"))), F.lit("R"), name(F.col("r_name")))
        d = n.join(F.broadcast(r), n["n_regionkey"] == r["r_regionkey"]).crossJoin(F.broadcast(v)).select((F.col("n_nationkey") * 100 + F.col("i")).alias("stmt"), raw.alias("raw"))
        return d.select("stmt", normalize_import(F.col("raw"), F.lit(language)).alias("e")).select("stmt", "e.*")

    run.__name__ = f"imports_{language}"
    return query(f"WITH {_statements_sql(language)}{_IMPORT_SQL[language]}")(run)


for _l in STATEMENTS:
    _imports(_l)


@query("""WITH h AS (SELECT page_id, unnest(regexp_extract_all(html, 'href="([^"]*)"', 1)) AS href FROM pages) SELECT page_id, href AS to_module, starts_with(href, './') OR starts_with(href, '../') AS resolved, CAST(count(*) AS BIGINT) AS n FROM h GROUP BY ALL""")
def html_links(spark, sf_dir):
    h = c.read(spark, sf_dir, "pages").select("page_id", F.explode(F.regexp_extract_all("html", F.lit('href="([^"]*)"'), F.lit(1))).alias("to_module"))
    return h.groupBy("page_id", "to_module").agg(F.count(F.lit(1)).alias("n")).withColumn("resolved", F.col("to_module").startswith("./") | F.col("to_module").startswith("../"))


_EXT = "regexp_extract(p, '[^/]\\.([^./]+)$', 1)"
_LANG = "CASE {0} WHEN 'rs' THEN 'rust' WHEN 'go' THEN 'go' WHEN 'py' THEN 'python' WHEN 'ts' THEN 'typescript' WHEN 'tsx' THEN 'typescript' WHEN 'js' THEN 'javascript' WHEN 'jsx' THEN 'javascript' WHEN 'java' THEN 'java' END"
_PATHS = "ps AS (SELECT p_partkey, 'src/' || lower(p_brand) || '/f' || p_partkey || (['.rs', '.RS', '.go', '.py', '.tsx', '.jsx', '.java', '.md', '', '.Js'])[CAST(p_partkey % 10 + 1 AS INTEGER)] AS p FROM part)"


def _paths(spark, sf_dir):
    ends = F.array(*[F.lit(x) for x in (".rs", ".RS", ".go", ".py", ".tsx", ".jsx", ".java", ".md", "", ".Js")])
    return c.read(spark, sf_dir, "part").select("p_partkey", F.concat(F.lit("src/"), F.lower("p_brand"), F.lit("/f"), F.col("p_partkey"), F.element_at(ends, (F.col("p_partkey") % 10 + 1).cast("int"))).alias("p"))


@query(f"WITH {_PATHS} SELECT p_partkey, {_EXT} AS ext, {_LANG.format('lower(' + _EXT + ')')} AS scanner, {_LANG.format(_EXT)} AS indexer, CASE WHEN starts_with(p, 'src/') THEN substr(p, 5) ELSE p END AS relative FROM ps")
def language_detection(spark, sf_dir):
    p = F.col("p")
    return _paths(spark, sf_dir).select("p_partkey", extension(p).alias("ext"), language_of(p, True).alias("scanner"), language_of(p, False).alias("indexer"), relative_path(p, "src").alias("relative"))


@query(f"WITH {_PATHS} SELECT p FROM ps WHERE NOT (regexp_matches(p, '{glob_regex('**/*1.*')}') OR regexp_matches(p, '{glob_regex('src/brand#2?/**')}')) AND (regexp_matches(p, '{glob_regex('**/*.{rs,go,py}')}') OR regexp_matches(p, '{glob_regex('src/**/f[0-4]*')}'))")
def glob_filter(spark, sf_dir):
    return _paths(spark, sf_dir).where(scan_filter(F.col("p"), ["**/*.{rs,go,py}", "src/**/f[0-4]*"], ["**/*1.*", "src/brand#2?/**"])).select("p")


@query(f"""WITH {c.SYMBOLS}, pos AS (SELECT 'order/' || o_orderkey || '.rs' AS file_path, o_orderkey AS pos_id, CAST(o_custkey % 60 AS INTEGER) AS a FROM orders),
j AS (SELECT pos.file_path, pos_id, a, id, row_number() OVER (PARTITION BY pos_id ORDER BY end_line - start_line, start_line DESC, ord DESC) AS n FROM pos LEFT JOIN syms s ON s.file_path = pos.file_path AND start_line <= a AND a + 1 <= end_line)
SELECT file_path, pos_id, id AS caller_symbol_id FROM j WHERE n = 1""")
def caller_lookup(spark, sf_dir):
    o = c.read(spark, sf_dir, "orders")
    pos = o.select(F.concat(F.lit("order/"), F.col("o_orderkey"), F.lit(".rs")).alias("file_path"), F.col("o_orderkey").alias("pos_id"), (F.col("o_custkey") % 60).cast("int").alias("start")).withColumn("end", F.col("start") + 1)
    return enclosing(c.line_symbols(spark, sf_dir), pos).select("file_path", "pos_id", "caller_symbol_id")


@query(f"WITH {c.SYMBOLS}, x AS (SELECT file_path, name AS id, ord, kind, scope FROM syms) SELECT file_path, id, arg_max(kind, ord) AS kind FROM x GROUP BY 1, 2")
def symbol_lookup(spark, sf_dir):
    return symbol_index(c.line_symbols(spark, sf_dir).drop("id").withColumnRenamed("name", "id")).select("file_path", "id", "kind")


@query("WITH f AS (SELECT 'doc/' || doc_id AS path, sha256(text) AS hash, doc_id FROM documents), s AS (SELECT path, CASE WHEN doc_id % 3 = 0 THEN 'changed' ELSE hash END AS hash FROM f WHERE doc_id % 2 = 0) SELECT path, hash FROM f ANTI JOIN s USING (path, hash)")
def snapshot_diff(spark, sf_dir):
    f = c.read(spark, sf_dir, "documents").select(F.concat(F.lit("doc/"), F.col("doc_id")).alias("path"), F.sha2(F.col("text").cast("binary"), 256).alias("hash"), "doc_id")
    s = f.where("doc_id % 2 = 0").select("path", F.when(F.col("doc_id") % 3 == 0, "changed").otherwise(F.col("hash")).alias("hash"))
    return events.unchanged_removed(f.drop("doc_id"), s).select("path", "hash")


@query("SELECT 'chk-' || md5(text) AS chunk_id, CAST(count(*) AS BIGINT) AS n FROM documents GROUP BY 1 HAVING count(*) > 1")
def duplicate_chunk_ids(spark, sf_dir):
    return chunking.full_file_chunks(c.documents(spark, sf_dir)).groupBy(F.col("id").alias("chunk_id")).agg(F.count(F.lit(1)).alias("n")).where("n > 1")


@query(f"WITH {c.DOCUMENTS}, {c.LINES}, {c.BLOCKS}, {_MIXED}, h AS (SELECT file_path FROM mx WHERE end_line - start_line + 1 <= 5), n AS (SELECT DISTINCT file_path FROM mx) SELECT file_path AS path FROM docs WHERE file_path IN (FROM h) OR file_path NOT IN (FROM n)")
def files_with_chunks(spark, sf_dir):
    d = c.documents(spark, sf_dir)
    chunks = chunking.boundary_chunks(d, _mixed(spark, sf_dir), 5)
    return events.files_with_chunks(d.select(F.col("file_path").alias("path")), chunks).select("path")


@query("""SELECT '{"protocol_version":"1.0.0","type":"event","event":"job_completed","job_id":"j","payload":{"processed":' || count(*) || ',"duration_ms":0}}' AS value FROM documents""")
def job_completed(spark, sf_dir):
    return events.job_completed(chunking.full_file_chunks(c.documents(spark, sf_dir)), "j")


@query("""WITH s AS (SELECT l_orderkey, l_linenumber, l_partkey % 4 AS a, l_suppkey % 4 AS b, (['Symbol','FullFile','symbol','CONTEXTUAL','other','fullfile','full_file'])[CAST(l_partkey % 7 + 1 AS INTEGER)] AS k FROM lineitem)
SELECT l_orderkey, l_linenumber, CASE WHEN a < 1 OR b < 1 THEN 'line numbers must be 1-based' WHEN a > b THEN 'start line after end line' END AS error, CASE lower(k) WHEN 'symbol' THEN 'Symbol' WHEN 'fullfile' THEN 'FullFile' ELSE 'Contextual' END AS kind,
 CAST(greatest(b - a, 0) + 1 AS BIGINT) AS n_lines, printf('Chunk %d (%d-%d)', l_orderkey, a, b) AS shown, CAST(count(*) AS BIGINT) AS n FROM s GROUP BY ALL""")
def chunk_validation(spark, sf_dir):
    kinds = F.array(*[F.lit(k) for k in ("Symbol", "FullFile", "symbol", "CONTEXTUAL", "other", "fullfile", "full_file")])
    s = c.read(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", (F.col("l_partkey") % 4).alias("a"), (F.col("l_suppkey") % 4).alias("b"), F.element_at(kinds, (F.col("l_partkey") % 7 + 1).cast("int")).alias("k"))
    s = s.select("l_orderkey", "l_linenumber", chunking.chunk_error(F.col("a"), F.col("b")).alias("error"), chunk_kind(F.col("k")).alias("kind"), n_lines(F.col("a"), F.col("b")).cast(LONG).alias("n_lines"), chunk_label(F.col("a"), F.col("b"), F.col("l_orderkey")).alias("shown"))
    return s.groupBy(*s.columns).agg(F.count(F.lit(1)).alias("n"))


def _flow_sql(top: int, low: int) -> str:
    size = "CASE x.action WHEN 'emit' THEN st.size + 1 WHEN 'ack' THEN greatest(st.size - 1, 0) ELSE 0 END"
    paused = f"CASE x.action WHEN 'emit' THEN st.paused OR st.size + 1 >= {top} WHEN 'ack' THEN st.paused AND NOT greatest(st.size - 1, 0) < {low} ELSE false END"
    sent = f"CASE WHEN x.action = 'emit' AND NOT st.paused AND st.size + 1 >= {top} THEN 'pause' WHEN x.action = 'ack' AND st.paused AND greatest(st.size - 1, 0) < {low} THEN 'resume' END"
    return f"""WITH RECURSIVE l AS (SELECT user_id AS job_id, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS seq, event_id, CASE event_type WHEN 'purchase' THEN 'ack' WHEN 'error' THEN 'resume' ELSE 'emit' END AS action FROM events),
f AS (SELECT DISTINCT job_id, CAST(0 AS BIGINT) AS seq, CAST(NULL AS BIGINT) AS event_id, 0 AS size, false AS paused, CAST(NULL AS VARCHAR) AS emitted FROM l
UNION ALL SELECT x.job_id, x.seq, x.event_id, {size}, {paused}, {sent} FROM f st JOIN l x ON x.job_id = st.job_id AND x.seq = st.seq + 1)
SELECT job_id, seq, event_id, CAST(size AS BIGINT) AS queue_size, paused, emitted, CASE emitted WHEN 'pause' THEN 'output_queue_full' WHEN 'resume' THEN 'queue_below_threshold' END AS reason FROM f WHERE seq > 0"""


@query(_flow_sql(10, 8))
def flow_control_log(spark, sf_dir):
    out = flow_log(c.flow_events(spark, sf_dir), FlowOptions(max_queue_size=10, threshold_percent=80))
    return out.select("job_id", "seq", "event_id", "queue_size", "paused", "emitted", "reason")


@query("""WITH s AS (SELECT event_id, CAST(event_id % 120 AS INTEGER) AS size FROM events) SELECT event_id, size >= 100 AS should_pause, size < 90 AS should_resume, CASE WHEN size >= 100 THEN 'output_queue_full' ELSE 'output_queue_near_capacity' END AS reason FROM s""")
def flow_predicates(spark, sf_dir):
    o, size = FlowOptions(max_queue_size=100), (F.col("event_id") % 120).cast("int")
    return c.read(spark, sf_dir, "events").select("event_id", (size >= o.max_queue_size).alias("should_pause"), (size < o.resume_threshold).alias("should_resume"), F.when(size >= o.max_queue_size, o.reason(o.max_queue_size)).otherwise(o.reason(0)).alias("reason"))


@query("SELECT event_id, CAST(json_extract(props, '$.k') AS BIGINT) AS k, json_valid(props) AS valid FROM events")
def command_fields(spark, sf_dir):
    return c.read(spark, sf_dir, "events").select("event_id", F.get_json_object("props", "$.k").cast(LONG).alias("k"), F.try_parse_json("props").isNotNull().alias("valid"))


@query("""WITH t AS (SELECT conv_id, turn, role, text, row_number() OVER (PARTITION BY conv_id ORDER BY turn, role, text) AS r, CAST(ceil(length(text) / 40.0) AS INTEGER) AS q FROM conversations),
p AS (SELECT 'conv/' || conv_id AS file_path, r, printf('t%06d', r) AS id, CAST(sum(q) OVER (PARTITION BY conv_id ORDER BY r) - q + 1 AS INTEGER) AS start_line, CAST(sum(q) OVER (PARTITION BY conv_id ORDER BY r) AS INTEGER) AS end_line FROM t),
""".replace("WITH t", "WITH RECURSIVE t") + c.pack_sql(30, "p") + " SELECT file_path, id, CAST(cid AS BIGINT) AS cid FROM pk")
def turn_chunks(spark, sf_dir):
    w = Window.partitionBy("conv_id").orderBy("turn", "role", "text")
    t = c.read(spark, sf_dir, "conversations").withColumn("ord", F.row_number().over(w)).withColumn("q", F.ceil(F.length("text") / 40).cast("int"))
    t = t.withColumn("end_line", F.sum("q").over(Window.partitionBy("conv_id").orderBy("ord")).cast("int"))
    s = t.select(F.concat(F.lit("conv/"), F.col("conv_id")).alias("file_path"), "ord", F.format_string("t%06d", "ord").alias("id"), (F.col("end_line") - F.col("q") + 1).alias("start_line"), "end_line")
    return chunking.pack_groups(s, 30).select("file_path", "id", "cid")


@query(f"WITH {c.SYMBOLS} SELECT file_path, id, CAST(row_number() OVER (PARTITION BY file_path ORDER BY start_line, end_line, id) AS BIGINT) AS position FROM syms")
def symbol_order(spark, sf_dir):
    w = Window.partitionBy("file_path").orderBy("start_line", "end_line", "id")
    return c.line_symbols(spark, sf_dir).select("file_path", "id", F.row_number().over(w).cast(LONG).alias("position"))


#: A source file of each language for a part: %1 its number. Symbols and calls are known by construction.
SOURCES = {
    "rust": "use std::io;\n\npub struct S%1 {\n    x: i32,\n}\n\nimpl S%1 {\n    fn get%1(&self) -> i32 {\n        helper(self.x)\n    }\n}\n",
    "typescript": 'import { a } from "./m%1";\n\nclass C%1 {\n  run%1(x) {\n    return work(x);\n  }\n}\n\nfunction f%1() {\n  go();\n}\n',
    "java": "import java.util.List;\n\npublic class C%1 {\n    private int n;\n\n    public int get%1() {\n        return calc(n);\n    }\n}\n",
    "go": 'package main\n\nimport "fmt"\n\nfunc F%1(x int) int {\n\tfmt.Println(x)\n\treturn x\n}\n',
    "python": "import os\n\nclass C%1:\n    def get%1(self):\n        return os.getcwd()\n",
}
#: (kind, name, scope, start, end) of the symbols, (callee, caller) of the calls and (module, symbol, kind, resolved) of the import.
EXPECTED = {
    "rust": ([("use", "unknown", None, 0, 0), ("struct", "S%1", None, 2, 4), ("impl", "unknown", None, 6, 10), ("function", "get%1", None, 7, 9)], [("helper", "get%1")], ("std", "io", "named", False)),
    "typescript": ([("import", '"./m%1"', None, 0, 0), ("class", "C%1", None, 2, 6), ("method", "run%1", "C%1", 3, 5), ("function", "f%1", None, 8, 10)], [("work", "run%1"), ("go", "f%1")], ("./m%1", "a", "named", True)),
    "java": ([("import", "import_declaration", None, 0, 0), ("class", "C%1", None, 2, 8), ("field", "n", "C%1", 3, 3), ("method", "get%1", "C%1", 5, 7)], [("calc", "get%1")], ("java.util", "List", "named", False)),
    "go": ([("import", "import_declaration", None, 2, 2), ("function", "F%1", None, 4, 7)], [("fmt.Println", "F%1")], ("fmt", None, "named", False)),
    "python": ([("import", "os", None, 0, 0), ("class", "C%1", None, 2, 4), ("function", "get%1", "C%1", 3, 4)], [("os.getcwd", "get%1")], ("import os", None, "named", False)),
}


def _sources(spark, sf_dir, language) -> DataFrame:
    n = F.col("p_partkey").cast("string")
    return c.read(spark, sf_dir, "part").select(F.concat(F.lit("gen/"), n).alias("file_path"), F.replace(F.lit(SOURCES[language]), F.lit("%1"), n).alias("text"), F.lit(language).alias("language"))


def _sql_value(v) -> str:
    if v is None:
        return "CAST(NULL AS VARCHAR)"
    return ("true" if v else "false") if isinstance(v, bool) else str(v) if isinstance(v, int) else f"replace({_literal(v)}, '%1', CAST(p_partkey AS VARCHAR))"


def _union(rows: list[tuple], names: tuple[str, ...]) -> str:
    return " UNION ALL ".join("SELECT 'gen/' || p_partkey AS file_path, " + ", ".join(f"{_sql_value(v)} AS {n}" for v, n in zip(r, names, strict=True)) + " FROM part" for r in rows)


def _extraction(language: str) -> None:
    symbols, calls, imported = EXPECTED[language]

    def run_symbols(spark, sf_dir):
        return symbols_of(extract(_sources(spark, sf_dir, language), False, False)).select("file_path", "kind", "name", "scope", "start_line", "end_line")

    def run_calls(spark, sf_dir):
        return call_edges_of(extract(_sources(spark, sf_dir, language), False, True, symbols=False)).select("file_path", "callee_name", F.regexp_replace("caller_symbol_id", "^<source>:", "").alias("caller"))

    def run_imports(spark, sf_dir):
        return import_edges_of(extract(_sources(spark, sf_dir, language), True, False, symbols=False)).select("file_path", "to_module", "imported_symbol", "import_kind", "resolved")

    for f, name, sql in (
        (run_symbols, "symbols", _union(symbols, ("kind", "name", "scope", "start_line", "end_line"))), (run_calls, "calls", _union(calls, ("callee_name", "caller"))),
        (run_imports, "import_edges", _union([imported], ("to_module", "imported_symbol", "import_kind", "resolved"))),
    ):
        f.__name__ = f"extract_{name}_{language}"
        query(sql)(f)


for _l in SOURCES:
    _extraction(_l)


@query("SELECT lang AS language, CAST(count(*) AS BIGINT) AS files, CAST(sum(n_chars) AS BIGINT) AS chars, CAST(max(n_chars) AS BIGINT) AS longest FROM documents GROUP BY 1")
def corpus_totals(spark, sf_dir):
    return c.read(spark, sf_dir, "documents").groupBy(F.col("lang").alias("language")).agg(F.count(F.lit(1)).alias("files"), F.sum("n_chars").alias("chars"), F.max("n_chars").cast(LONG).alias("longest"))


def _indexed(spark, sf_dir) -> DataFrame:
    return reduce(DataFrame.unionByName, [_sources(spark, sf_dir, x).withColumn("file_path", F.concat(F.lit(f"{x}/"), "file_path")) for x in SOURCES])


#: Of a part's five sources: chunks (boundary symbols), imports and calls.
_TOLD = {"file_listed": len(SOURCES), "chunk_emitted": 11, "import_edge": len(SOURCES), "call_edge": sum(len(v[1]) for v in EXPECTED.values())}


@query(" UNION ALL ".join(f"SELECT '{k}' AS event, CAST({v} * count(*) AS BIGINT) AS n FROM part" for k, v in _TOLD.items()) + " UNION ALL SELECT unnest(['job_started', 'job_completed']) AS event, CAST(1 AS BIGINT) AS n")
def index_job(spark, sf_dir):
    """A whole job, from the sources to its log: how many events of each kind."""
    from weftline.engine import Engine

    engine = Engine(spark)
    options = IndexOptions(chunking=ChunkingOptions("SymbolBoundary", max_lines=0), digest="sha256")
    log = engine.event_log(engine.index_corpus(_indexed(spark, sf_dir), options), "j")
    return log.groupBy(F.get_json_object("value", "$.event").alias("event")).agg(F.count(F.lit(1)).alias("n"))


@query(f"""WITH {c.DOCUMENTS}, {c.LINES}, {c.BLOCKS}, {c.HEADED}, ha AS (SELECT file_path, CASE WHEN a[-1] = '' THEN a[:-2] ELSE a END AS ha FROM hl0),
k AS (SELECT blk.*, ha FROM blk JOIN ha USING (file_path) WHERE CAST(regexp_extract(file_path, '(\\d+)', 1) AS BIGINT) % 3 <> 0),
x AS (SELECT k.file_path, k.id, coalesce(l, []) AS l, CASE WHEN scope IS NULL THEN [] ELSE ['scope: ' || trim(scope)] END AS s, array_to_string(ha[start_line:end_line], chr(10)) || chr(10) AS content FROM k LEFT JOIN imports USING (file_path)),
y AS (SELECT *, CASE WHEN len(l) + len(s) > 0 THEN array_to_string(list_concat(l, list_concat(CASE WHEN len(l) > 0 AND len(s) > 0 THEN [''] ELSE [] END, s)), chr(10)) || chr(10) || chr(10) ELSE '' END || content AS text FROM x)
SELECT file_path, id AS symbol_id, 'Symbol' AS chunk_kind, text AS content FROM y UNION ALL SELECT file_path, NULL, 'FullFile', text FROM hd WHERE file_path NOT IN (SELECT file_path FROM k)""")
def composed_chunks(spark, sf_dir):
    """Files with and without symbols: only the former get context."""
    some = c.blocks(spark, sf_dir).where(F.regexp_extract("file_path", r"(\d+)", 1).cast("long") % 3 != 0)
    out = chunking.chunk_pipeline(c.with_header(spark, sf_dir), some, ChunkingOptions("SymbolBoundary", max_lines=0, overlap_lines=0), "sha256")
    return out.select("file_path", "symbol_id", "chunk_kind", "content")


@query(f"""WITH {c.DOCUMENTS}, {c.LINES}, {c.BLOCKS}, t AS (SELECT file_path, start_line, end_line, 'chk-' || replace(file_path, '/', '_') || '-' || start_line || '-' || end_line AS cid, 2 * b + i AS ord, (['z', 'a'])[i + 1] || id AS symbol_id FROM blk, (VALUES (0), (1)) v(i))
SELECT file_path, symbol_id, lag(cid) OVER w AS previous_chunk_id, lead(cid) OVER w AS next_chunk_id FROM t WINDOW w AS (PARTITION BY file_path ORDER BY start_line, end_line, ord)""")
def overlap_ties(spark, sf_dir):
    """Two symbols of the same lines keep the order in which they come, whatever their ids."""
    b = c.blocks(spark, sf_dir).withColumn("i", F.explode(F.array(F.lit(0), F.lit(1))))
    b = b.withColumn("id", F.concat(F.when(F.col("i") == 0, "z").otherwise("a"), "id")).withColumn("ord", F.col("ord") * 2 + F.col("i")).drop("i")
    d = c.documents(spark, sf_dir)
    out = chunking.overlap_chunks(d, chunking.boundary_chunks(d, b).where("chunk_kind = 'Symbol'"), 1, "sha256")
    return out.select("file_path", "symbol_id", "metadata.previous_chunk_id", "metadata.next_chunk_id")


@query("""SELECT '{"protocol_version":"1.0.0","type":"event","event":"file_listed","job_id":"j","payload":{"file":{"path":"doc/' || doc_id || '","size":' || strlen(text) || ',"mtime":7,"hash":"' || sha256(text) || '","language":' || CASE WHEN doc_id % 2 = 0 THEN '"rust"' ELSE 'null' END || '}}}' AS value FROM documents""")
def file_listed_log(spark, sf_dir):
    d = c.read(spark, sf_dir, "documents").select(F.concat(F.lit("doc/"), "doc_id").alias("path"), F.octet_length("text").cast(LONG).alias("size"), F.lit(7).cast(LONG).alias("mtime"), F.sha2(F.col("text").cast("binary"), 256).alias("hash"), F.when(F.col("doc_id") % 2 == 0, "rust").alias("language"))
    return events.file_listed(d, "j")


@query("""SELECT '{"protocol_version":"1.0.0","type":"event","event":"file_invalid","job_id":null,"payload":{"path":"' || p_partkey || '","reason":"io_error"}}' AS value FROM part""")
def file_invalid_log(spark, sf_dir):
    return events.file_invalid(c.read(spark, sf_dir, "part").select(F.col("p_partkey").cast("string").alias("path")))


@query("""SELECT '{"protocol_version":"1.0.0","type":"event","event":"capabilities","job_id":null,"payload":{"version":"0.1.0","languages":["rust","typescript","javascript","java","go","python"],"features":["jsonl","incremental_index","git_diff","pause_resume","mcp_compatible"]}}' AS value""")
def capabilities_log(spark, sf_dir):
    return events.capabilities(spark)


@query("""WITH n AS (SELECT count(*) // 60 AS k FROM events), r AS (SELECT unnest(range(1, k + 1)) AS i FROM n),
v AS (SELECT '{"protocol_version":"1.0.0","type":"event","event":"pause","job_id":"j","payload":{"output_queue_full":null,"threshold":60,"current_size":60,"backpressure_active":true}}' AS value
UNION ALL SELECT '{"protocol_version":"1.0.0","type":"event","event":"resume","job_id":"j","payload":{"pause_timeout":null,"threshold":54,"current_size":0,"backpressure_active":false}}')
SELECT value FROM r CROSS JOIN v""")
def job_flow_log(spark, sf_dir):
    """Pauses and resumes in the log of a job as long as the events, a queue of 60."""
    n = c.read(spark, sf_dir, "events").agg(F.count(F.lit(1)).alias("n"))
    return events.flow_of(n, FlowOptions(max_queue_size=60), "j")
