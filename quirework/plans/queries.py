"""Registered queries of the document engine and their SQL twins for DuckDB. Each runs over its whole tables."""

from __future__ import annotations

from collections.abc import Callable

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import text as tx
from ..operators import audit, fixed, images, layout, lookups, ocr, repair, tables, verify
from ..sources import containers, readers
from . import catalog, convert, stage

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLE_SQL: dict[str, str] = {}


def query(sql: str | None = None) -> Callable[[Query], Query]:
    def add(f: Query) -> Query:
        QUERIES[f.__name__] = f
        if sql:
            ORACLE_SQL[f.__name__] = sql
        return f

    return add


def _t(spark: SparkSession, d: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{d}/{name}.parquet")


# --- text ---------------------------------------------------------------------------------------------------

_PARAGRAPHS = r"""list_filter(list_transform(regexp_split_to_array(replace(coalesce(text, ''), chr(13) || chr(10), chr(10)), '\n{2,}'),
 lambda p: replace(regexp_replace(p, '^\s+|\s+$', '', 'g'), chr(10), ' ')), lambda p: p <> '')"""


@query(f"""WITH p AS (SELECT lang, source, unnest({_PARAGRAPHS}) AS t FROM documents)
SELECT lang, source, count(*) AS n_paragraphs, sum(length(t))::BIGINT AS n_chars FROM p GROUP BY ALL""")
def paragraph_stats_by_lang(spark, d):
    parts = _t(spark, d, "documents").select("lang", "source", F.explode(tx.paragraphs(F.col("text"))).alias("t"))
    return parts.groupBy("lang", "source").agg(F.count("*").alias("n_paragraphs"), F.sum(F.length("t")).alias("n_chars"))


@query(f"""WITH p AS (SELECT doc_id, {_PARAGRAPHS} AS ps FROM documents)
SELECT doc_id, (i - 1)::INTEGER AS block_idx, md5(ps[i]) AS text_md5 FROM p, unnest(range(1, len(ps) + 1)) AS r(i)""")
def read_text_paragraphs(spark, d):
    return readers.read_text(_t(spark, d, "documents"), "text").select("doc_id", "block_idx", F.md5(F.col("text")).alias("text_md5"))


@query(r"""SELECT doc_id, md5(regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(text,
 '!\[([^\]]*)\]\([^)]*\)', '\1', 'g'), '\[([^\]]+)\]\([^)]*\)', '\1', 'g'), '`([^`]+)`', '\1', 'g'), '\*\*(.*?)\*\*', '\1', 'g'), '__(.*?)__', '\1', 'g'),
 '\*(.*?)\*', '\1', 'g'), '_(.*?)_', '\1', 'g'), '~~(.*?)~~', '\1', 'g')) AS stripped FROM documents""")
def strip_markdown(spark, d):
    return _t(spark, d, "documents").select("doc_id", F.md5(tx.strip_markdown(F.col("text"))).alias("stripped"))


@query("""SELECT conv_id, turn, replace(replace(replace(replace(replace(text, '&', '&amp;'), '<', '&lt;'), '>', '&gt;'), '"', '&quot;'), chr(39), '&#39;') AS escaped FROM conversations""")
def escape_html(spark, d):
    return _t(spark, d, "conversations").select("conv_id", "turn", tx.escape_html(F.col("text")).alias("escaped"))


@query(r"""SELECT doc_id, md5(regexp_replace(text, '\r\n?', chr(10), 'g')) AS normal FROM documents""")
def normalize_newlines(spark, d):
    return _t(spark, d, "documents").select("doc_id", F.md5(tx.normalize_newlines(F.col("text"))).alias("normal"))


@query(r"""SELECT doc_id, array_to_string(regexp_split_to_array(regexp_replace(text, '^\s+|\s+$', '', 'g'), '\s+')[1:8], ' ') AS head FROM documents""")
def first_words(spark, d):
    return _t(spark, d, "documents").select("doc_id", tx.first_words(F.col("text"), 8).alias("head"))


@query(r"""SELECT conv_id, turn, CASE WHEN regexp_matches(text, '[",\n\r]') THEN '"' || replace(text, '"', '""') || '"' ELSE text END AS cell FROM conversations""")
def csv_escape_cell(spark, d):
    return _t(spark, d, "conversations").select("conv_id", "turn", tx.csv_cell(F.col("text")).alias("cell"))


@query(r"""SELECT doc_id, md5(lower(regexp_replace(text, '[\s\p{P}]+', '', 'g'))) AS loose FROM documents""")
def loose_text_key(spark, d):
    return _t(spark, d, "documents").select("doc_id", F.md5(tx.loose_key(F.col("text"))).alias("loose"))


@query("""WITH s AS (SELECT l_orderkey, l_linenumber, (l_shipdate::DATE - DATE '1899-12-30')::BIGINT AS serial FROM lineitem)
SELECT l_orderkey, l_linenumber, serial, strftime(DATE '1899-12-30' + serial::INTEGER, '%Y-%m-%d') AS iso FROM s""")
def excel_serial_to_iso(spark, d):
    serial = F.date_diff(F.to_date("l_shipdate"), F.lit("1899-12-30").cast("date")).cast("long")
    return _t(spark, d, "lineitem").withColumn("serial", serial).select("l_orderkey", "l_linenumber", "serial", tx.excel_serial_to_iso(F.col("serial") + 0.25).alias("iso"))


@query("""WITH n AS (SELECT p_partkey, (p_partkey * 7)::INTEGER AS n FROM part)
SELECT p_partkey, CASE WHEN n < 26 THEN chr(65 + n) WHEN n < 702 THEN chr(64 + n // 26) || chr(65 + n % 26) WHEN n < 18278
 THEN chr(65 + (n - 702) // 676) || chr(65 + ((n - 702) // 26) % 26) || chr(65 + (n - 702) % 26)
 ELSE chr(65 + (n - 18278) // 17576) || chr(65 + ((n - 18278) // 676) % 26) || chr(65 + ((n - 18278) // 26) % 26) || chr(65 + (n - 18278) % 26) END AS letters, n::BIGINT AS back FROM n""")
def column_letters(spark, d):
    named = _t(spark, d, "part").select("p_partkey", tx.column_letters(F.col("p_partkey") * 7).alias("letters"))
    return named.withColumn("back", tx.column_index(F.col("letters")))


@query("""SELECT doc_id, list_reduce(list_prepend(2166136261::BIGINT, list_transform(list_filter(string_split(text, ''), lambda c: c <> ''), lambda c: ord(c)::BIGINT)),
 lambda h, u: (xor(h, u) * 16777619) & 4294967295) AS hash FROM documents""")
def fnv1a_hash(spark, d):
    return _t(spark, d, "documents").select("doc_id", F.conv(tx.fnv1a(F.col("text")), 36, 10).cast("long").alias("hash"))


@query(r"""SELECT doc_id, (regexp_extract_all(text, '`+')).len()::INTEGER AS n_runs, greatest(3, coalesce(list_max(list_transform(regexp_extract_all(text, '`+'), lambda x: length(x))), 0) + 1)::INTEGER AS width FROM documents""")
def fence_width(spark, d):
    return _t(spark, d, "documents").select("doc_id", F.size(F.regexp_extract_all("text", F.lit("`+"), F.lit(0))).alias("n_runs"), F.length(tx.fence(F.col("text"))).alias("width"))


@query(r"""WITH c AS (SELECT doc_id, length(text) AS n, length(text) - length(replace(text, chr(65533), '')) AS bad, len(regexp_extract_all(text, '[ÃÂ¤åæçèéï¿½]')) AS hints,
 len(regexp_extract_all(text, '[\x{E000}-\x{F8FF}]')) AS own, len(regexp_extract_all(text, '[\x00-\x08\x0B\x0C\x0E-\x1F]')) AS control, len(regexp_extract_all(text, '[\t\n\r\x20-\x7e]')) AS plain FROM documents)
SELECT doc_id, (100 * bad + 8 * hints + 40 * own + 20 * control - CASE WHEN n > 0 AND plain > 0.75 * n THEN 20 ELSE 0 END - CASE WHEN bad = 0 THEN 5 ELSE 0 END)::BIGINT AS penalty FROM c""")
def decode_penalty(spark, d):
    """What the chooser of encodings holds against each text, if it was read as UTF-8."""

    def run(batches):
        for batch in batches:
            scores = [None if t is None else containers.decode_score(t, "utf-8") for t in batch.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(scores, pa.int64())], names=["doc_id", "penalty"])

    return _t(spark, d, "documents").select("doc_id", "text").mapInArrow(run, "doc_id long, penalty long")


# --- catalog ------------------------------------------------------------------------------------------------

_VALUES = lambda rows: ", ".join("(" + ", ".join(repr(x) if isinstance(x, (str, int)) and not isinstance(x, bool) else str(x).lower() for x in r) + ")" for r in rows)


@query(f"SELECT * FROM (VALUES {_VALUES([(s, t) for s, to in catalog.MATRIX.items() for t in to])}) AS m(source, target)")
def product_matrix(spark, d):
    return catalog.matrix(spark)


@query(f"""WITH RECURSIVE edge(f, t, loss, ex) AS (VALUES {_VALUES([(m.source, m.target, m.loss, m.executable) for m in catalog.MAPPERS])}),
fmt(fmt, model) AS (VALUES {_VALUES([(f.name, f.produces[0]) for f in catalog.FORMATS.values()])}),
acc(fmt, model, rk) AS (VALUES {_VALUES([(f.name, a, k) for f in catalog.FORMATS.values() for k, a in enumerate(f.accepts)])}),
pair(source, target) AS (VALUES {_VALUES([(s, t) for s, to in catalog.MATRIX.items() for t in to])}),
walk(start, node, n, ex, loss) AS (SELECT DISTINCT model, model, 0, true, 'low' FROM fmt UNION
 SELECT start, t, n + 1, walk.ex AND edge.ex, edge.loss FROM walk JOIN edge ON f = node WHERE n < 3),
way AS (SELECT start, node, n, ex, loss, row_number() OVER (PARTITION BY start, node ORDER BY n, ex DESC) AS k FROM walk),
cand AS (SELECT source, target, rk, n, ex, loss, row_number() OVER (PARTITION BY source, target ORDER BY (n = 0 OR ex) DESC, rk) AS k
 FROM pair JOIN fmt ON fmt.fmt = source JOIN acc ON acc.fmt = target JOIN way ON start = fmt.model AND node = acc.model AND way.k = 1),
best AS (SELECT *, CASE WHEN source || target IN ('mdpptx', 'htmlpptx', 'jsonpptx', 'pptxpptx') THEN 'generated' WHEN source = 'ofd' THEN 'restricted' WHEN n > 0 THEN 'degraded' ELSE 'recommended' END AS route_class FROM cand WHERE k = 1)
SELECT source, target, CASE WHEN n = 0 AND route_class = 'generated' THEN 'cold' WHEN n = 0 THEN 'hot' WHEN n = 1 AND loss = 'low' THEN 'warm' ELSE 'cold' END AS temperature, route_class FROM best""")
def route_temperature(spark, d):
    return catalog.routes(spark).select("source", "target", "temperature", "route_class")


@query(f"""SELECT * FROM (VALUES {_VALUES([(f.name, f.writable, f.produces[0], f.max_input_bytes) for f in catalog.FORMATS.values()])}) AS c(format, writable, primary_model, max_input_bytes)""")
def capabilities(spark, d):
    return catalog.capabilities(spark).select("format", "writable", "primary_model", F.col("max_input_bytes").cast("int").alias("max_input_bytes"))


@query(r"""SELECT page_id, CASE lower(regexp_extract(url, '\.([^./]+)$', 1)) WHEN 'htm' THEN 'html' WHEN 'markdown' THEN 'md' WHEN 'text' THEN 'txt' ELSE lower(regexp_extract(url, '\.([^./]+)$', 1)) END AS format FROM pages""")
def detect_format(spark, d):
    return _t(spark, d, "pages").select("page_id", catalog.format_of(F.regexp_extract("url", "([^/]*)$", 1)).alias("format"))


# --- lines, blocks, slides ----------------------------------------------------------------------------------


@query(r"""WITH l AS (SELECT doc_id, string_split(regexp_replace(text, '\r\n?', chr(10), 'g'), chr(10)) AS ls FROM documents)
SELECT doc_id, c::INTEGER AS chunk, (c * 20 + 1)::INTEGER AS start_line, least(c * 20 + 20, len(ls))::INTEGER AS end_line, md5(array_to_string(ls[c * 20 + 1:c * 20 + 20], chr(10))) AS text_md5
FROM l, unnest(range(0, (len(ls) + 19) // 20)) AS r(c)""")
def chunk_text_by_lines(spark, d):
    docs = _t(spark, d, "documents").select("doc_id", F.col("text").alias("content"))
    return tables.chunk_lines(docs, most=20).select("doc_id", "chunk", "start_line", "end_line", F.md5("text").alias("text_md5"))


@query("""WITH s AS (SELECT conv_id, text, greatest(sum((role = 'user')::INT) OVER (PARTITION BY conv_id ORDER BY turn), 1) AS slide FROM conversations)
SELECT conv_id, slide::BIGINT AS slide, count(*) AS n_blocks, sum(length(text))::BIGINT AS n_chars FROM s GROUP BY ALL""")
def conversation_slides(spark, d):
    blocks = _t(spark, d, "conversations").withColumnRenamed("turn", "block_idx")
    return tables.slides(blocks, F.col("role") == "user", "conv_id").groupBy("conv_id", F.col("slide").cast("long").alias("slide")).agg(F.count("*").alias("n_blocks"), F.sum(F.length("text")).alias("n_chars"))


@query("""WITH i AS (SELECT conv_id, turn, (turn % 3)::INTEGER AS depth FROM conversations)
SELECT conv_id, turn, depth, CASE WHEN depth = 0 THEN sum((depth = 0)::INT) OVER (PARTITION BY conv_id ORDER BY turn)::BIGINT END AS number FROM i""")
def ordered_list_counter(spark, d):
    items = _t(spark, d, "conversations").select("conv_id", F.col("turn").alias("item_idx"), (F.col("turn") % 3).cast("int").alias("depth"))
    return tables.list_counter(items, "conv_id").select("conv_id", F.col("item_idx").alias("turn"), "depth", "number")


@query("""WITH b AS (SELECT conv_id, turn, turn % 4 < 2 AS ordered FROM conversations), f AS (SELECT *, CASE WHEN ordered = lag(ordered) OVER w THEN 0 ELSE 1 END AS new FROM b WINDOW w AS (PARTITION BY conv_id ORDER BY turn)),
r AS (SELECT *, sum(new) OVER (PARTITION BY conv_id ORDER BY turn) AS run FROM f)
SELECT conv_id, min(turn) AS block_idx, count(*)::INTEGER AS n_items FROM r GROUP BY conv_id, run""")
def merge_adjacent_lists(spark, d):
    blocks = _t(spark, d, "conversations").select("conv_id", F.col("turn").alias("block_idx"), F.lit("list").alias("type"), (F.col("turn") % 4 < 2).alias("ordered"), F.array("text").alias("items"))
    return tables.merge_lists(blocks, "conv_id").select("conv_id", "block_idx", F.size("items").alias("n_items"))


@query("""SELECT conv_id, turn, round(800 - coalesce(sum(1.6 * CASE WHEN role = 'user' THEN 18 ELSE 12 END) OVER (PARTITION BY conv_id ORDER BY turn ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::DOUBLE, 6) AS y FROM conversations""")
def vertical_cursor(spark, d):
    blocks = _t(spark, d, "conversations").withColumnRenamed("turn", "block_idx")
    placed = layout.vertical_cursor(blocks, F.when(F.col("role") == "user", 18).otherwise(12), "conv_id")
    return placed.select("conv_id", F.col("block_idx").alias("turn"), F.round(F.col("y").cast("double"), 6).alias("y"))


# --- tables -------------------------------------------------------------------------------------------------


@query("""SELECT o_orderkey, concat_ws(',', o_orderkey::VARCHAR, o_custkey::VARCHAR, o_orderstatus, strftime(o_orderdate, '%Y-%m-%d'), o_orderpriority) AS line FROM orders""")
def orders_to_csv_rows(spark, d):
    return _t(spark, d, "orders").select("o_orderkey", tables.csv_line(F.col("o_orderkey"), F.col("o_custkey"), F.col("o_orderstatus"), F.date_format("o_orderdate", "yyyy-MM-dd"), F.col("o_orderpriority")).alias("line"))


@query("""SELECT event_id, k AS key, json_extract_string(props, '$."' || k || '"') AS value FROM (SELECT event_id, props, unnest(json_keys(props)) AS k FROM events)""")
def events_props_json_cells(spark, d):
    docs = _t(spark, d, "events").select("event_id", F.concat(F.lit("["), "props", F.lit("]")).alias("content"))
    tables_ = readers.blocks_of(readers.read(docs, "json", id_col="event_id"))
    cell = F.explode(F.arrays_zip("headers", F.get("rows", F.lit(0)).alias("values"))).alias("c")
    return tables_.select(F.col("doc_id").alias("event_id"), cell).select("event_id", F.col("c.headers").alias("key"), F.col("c.values").alias("value"))


@query("""WITH k AS (SELECT event_id, unnest(json_keys(props)) AS key, generate_subscripts(json_keys(props), 1) AS pos FROM events), f AS (SELECT key, min(event_id * 1000 + pos) AS first FROM k GROUP BY key)
SELECT key, row_number() OVER (ORDER BY first)::INTEGER AS place FROM f""")
def json_key_union(spark, d):
    return tables.key_union(_t(spark, d, "events"), "props", "event_id")


@query("""WITH f AS (SELECT p_name AS value, min(p_partkey) AS first FROM part GROUP BY p_name) SELECT value, (row_number() OVER (ORDER BY first) - 1)::BIGINT AS idx FROM f""")
def shared_string_dictionary(spark, d):
    return tables.dictionary(_t(spark, d, "part").withColumnRenamed("p_name", "value"), "value", "p_partkey").select("value", F.col("idx").cast("long").alias("idx"))


@query(r"""WITH l AS (SELECT c_nationkey, c_custkey, substr(regexp_replace(c_mktsegment || '/' || c_mktsegment || ': a longer name for it', '[\\/?*\[\]:]', ' ', 'g'), 1, 31) AS legal FROM customer),
n AS (SELECT *, row_number() OVER (PARTITION BY c_nationkey, lower(legal) ORDER BY c_custkey) AS nth FROM l)
SELECT c_nationkey, c_custkey, CASE WHEN nth = 1 THEN legal ELSE substr(legal, 1, 31 - length(' ' || nth)) || ' ' || nth END AS sheet_name FROM n""")
def sheet_name_dedupe(spark, d):
    sheets = _t(spark, d, "customer").withColumn("name", F.concat("c_mktsegment", F.lit("/"), "c_mktsegment", F.lit(": a longer name for it")))
    return tables.sheet_names(sheets, "name", "c_custkey", "c_nationkey").select("c_nationkey", "c_custkey", "sheet_name")


@query(r"""WITH r AS (SELECT s_nationkey, s_suppkey, s_name, row_number() OVER (PARTITION BY s_nationkey ORDER BY s_suppkey) AS n FROM supplier),
c AS (SELECT s_nationkey, unnest(['A' || (n + 1), 'B' || (n + 1)]) AS ref, unnest([s_suppkey::VARCHAR, s_name]) AS value FROM r)
SELECT s_nationkey AS sheet, ref, value, regexp_full_match(value, '-?(\d+(\.\d+)?|\.\d+)([eE][+-]?\d+)?') AS is_number FROM c""")
def workbook_cells(spark, d):
    return tables.cells(_t(spark, d, "supplier"), "s_nationkey", "s_suppkey", ["s_suppkey", "s_name"]).select("sheet", "ref", "value", "is_number")


@query("""SELECT s_nationkey AS sheet, count(*)::BIGINT * 2 AS n_cells, count(*)::BIGINT AS n_numbers, (count(*) + 1)::INTEGER AS last_row FROM supplier GROUP BY ALL""")
def workbook_summary(spark, d):
    cells = tables.cells(_t(spark, d, "supplier"), "s_nationkey", "s_suppkey", ["s_suppkey", "s_name"])
    return cells.groupBy("sheet").agg(F.count("*").alias("n_cells"), F.count_if("is_number").alias("n_numbers"), (F.max("row") + 2).alias("last_row"))


@query("""SELECT s_nationkey AS doc_id, (2 * k + h)::INTEGER AS block_idx, CASE WHEN h = 0 THEN 'heading' ELSE 'table' END AS type FROM (SELECT s_nationkey, row_number() OVER (PARTITION BY s_nationkey ORDER BY s_suppkey) - 1 AS k FROM supplier), (VALUES (0), (1)) AS v(h)""")
def workbook_to_blocks(spark, d):
    blocks = _t(spark, d, "supplier").select(F.col("s_nationkey").alias("doc_id"), F.col("s_suppkey").alias("block_idx"), F.lit("table").alias("type"), F.array("s_name").alias("headers"), F.array(F.array("s_name")).alias("rows"))
    return tables.workbook_to_semantic(tables.semantic_to_workbook(blocks)).select("doc_id", "block_idx", "type")


# --- audit --------------------------------------------------------------------------------------------------

_WARN = """w AS (SELECT user_id AS doc_id, event_id AS pos, (['info', 'lossy', 'unsupported', 'security', 'performance'])[(event_id % 5 + 1)::INTEGER] AS severity, event_type AS code,
 CASE WHEN event_id % 3 = 0 THEN 'text was cut' ELSE 'layout was cut' END AS message FROM events)"""


def _warnings(spark, d) -> DataFrame:
    kinds = F.array(*[F.lit(s) for s in ("info", "lossy", "unsupported", "security", "performance")])
    return _t(spark, d, "events").select(F.col("user_id").alias("doc_id"), F.col("event_id").alias("pos"), F.get(kinds, (F.col("event_id") % 5).cast("int")).alias("severity"), F.col("event_type").alias("code"), F.when(F.col("event_id") % 3 == 0, "text was cut").otherwise("layout was cut").alias("message"))


@query(f"WITH {_WARN} SELECT doc_id, severity, count(*) AS n FROM w GROUP BY ALL")
def warnings_by_severity(spark, d):
    return audit.by_severity(_warnings(spark, d), "doc_id")


@query(f"WITH {_WARN} SELECT doc_id, code, message, min(pos) AS pos, min_by(severity, pos) AS severity FROM w GROUP BY ALL")
def distinct_warnings(spark, d):
    return audit.distinct_warnings(_warnings(spark, d), "doc_id").select("doc_id", "code", "message", "pos", "severity")


@query(f"""WITH {_WARN}, first AS (SELECT doc_id, code, message, min_by(severity, pos) AS severity FROM w GROUP BY ALL), q AS (SELECT doc_id, bool_or(severity = 'lossy') AS lossy, bool_or(severity = 'lossy' AND message LIKE '%text%') AS lost, count(*) AS n, count(*) FILTER (severity IN ('lossy', 'unsupported')) AS down FROM first GROUP BY doc_id),
b AS (SELECT doc_id, bool_or(contains(t, '|')) AS has_table, count(*) AS n_blocks FROM (SELECT doc_id, unnest(string_split(text, chr(10))) AS t FROM documents) GROUP BY doc_id)
SELECT d.doc_id, CASE WHEN lossy THEN 'medium' ELSE 'high' END AS structure_fidelity, CASE WHEN lost THEN 'medium' ELSE 'high' END AS text_fidelity, CASE WHEN has_table THEN 'tracked' ELSE 'not-applicable' END AS table_fidelity, 'not-applicable' AS asset_fidelity,
 n_blocks::BIGINT AS n_blocks, coalesce(n, 0)::BIGINT AS n_warnings, coalesce(down, 0)::BIGINT AS downgrades FROM documents d LEFT JOIN b USING (doc_id) LEFT JOIN q USING (doc_id)""")
def quality_report(spark, d):
    docs = _t(spark, d, "documents")
    blocks = docs.select("doc_id", F.posexplode(F.split("text", "\n", -1)).alias("block_idx", "text")).withColumn("type", F.when(F.contains("text", F.lit("|")), "table").otherwise("paragraph"))
    return audit.quality(docs, blocks, audit.distinct_warnings(_warnings(spark, d), "doc_id"))


@query("""SELECT conv_id, turn, list_filter([CASE WHEN turn % 5 = 4 THEN 'type is unknown' END, CASE WHEN turn % 5 = 1 AND turn > 6 THEN 'level is not 1 to 6' END, CASE WHEN turn % 5 IN (0, 1) AND turn % 2 = 0 THEN 'text is missing' END], lambda x: x IS NOT NULL).len()::INTEGER AS n_errors FROM conversations""")
def schema_errors(spark, d):
    k = F.col("turn") % 5
    kinds = F.when(k == 0, "paragraph").when(k == 1, "heading").when(k == 2, "list").when(k == 3, "code").otherwise("stanza")
    rows = _t(spark, d, "conversations").select(
        "conv_id", "turn", kinds.alias("type"), F.when(k == 1, F.col("turn")).alias("level"), F.when(F.col("turn") % 2 == 1, F.col("text")).alias("text"), F.array("text").alias("items"), F.col("text").alias("code"),
        F.array("role").alias("headers"), F.array(F.array("text")).alias("rows"), F.lit("").alias("src"), F.lit("").alias("asset_id"), F.lit("").alias("content"),
    )
    return rows.select("conv_id", "turn", F.size(audit.schema_errors()).alias("n_errors"))


@query(r"""SELECT doc_id, (length(substr(text, 1, length(text) // 2)) - length(replace(substr(text, 1, length(text) // 2), chr(10), '')) + 1)::INTEGER AS line FROM documents""")
def offset_to_line(spark, d):
    docs = _t(spark, d, "documents").select("doc_id", F.col("text").alias("content"), F.floor(F.length("text") / 2).cast("long").alias("off"))
    return docs.select("doc_id", "off").join(audit.line_index(docs), "doc_id").filter("first <= off and off < next").select("doc_id", "line")


@query("""SELECT md5(text) AS hash, min(doc_id) AS asset_id, list_sort(list_distinct(list(source))) AS refs, count(*) AS n FROM documents GROUP BY md5(text)""")
def asset_dedupe(spark, d):
    return audit.assets_once(_t(spark, d, "documents").select(F.md5("text").alias("hash"), F.col("doc_id").alias("asset_id"), F.col("doc_id").alias("pos"), F.col("source").alias("ref")))


# --- verification -------------------------------------------------------------------------------------------


@query(r"""WITH p AS (SELECT doc_id, lower(regexp_replace(d.text, '\s+', '', 'g')) AS l, lower(regexp_replace(b.text, '\s+', '', 'g')) AS r FROM documents d JOIN benchmark b ON b.item_id = d.doc_id % 40),
c AS (SELECT doc_id, unnest(string_split(l, '')) AS ch, 1 AS a, 0 AS b FROM p UNION ALL SELECT doc_id, unnest(string_split(r, '')), 0, 1 FROM p),
h AS (SELECT doc_id, ch, sum(a) AS a, sum(b) AS b FROM c WHERE ch <> '' GROUP BY ALL),
s AS (SELECT doc_id, sum(a)::BIGINT AS left_len, sum(b)::BIGINT AS right_len, sum(least(a, b))::BIGINT AS common FROM h GROUP BY doc_id)
SELECT doc_id, left_len, right_len, common, round(CASE WHEN common = 0 THEN 0 ELSE 2 * (common / left_len) * (common / right_len) / (common / left_len + common / right_len) END, 9) AS f1 FROM s""")
def text_similarity_f1(spark, d):
    # Full-width and compatibility forms of one side count as what they stand for; the SQL has them as such.
    items = _t(spark, d, "benchmark").select("item_id", F.translate("text", "aeiouAEIOU019.", "ａｅｉｏｕＡＥＩＯＵ⁰①⑨．").alias("other"))
    pairs = _t(spark, d, "documents").withColumn("item_id", F.col("doc_id") % 40).join(items, "item_id")
    return verify.overlap(pairs, "text", "other", "doc_id").select("doc_id", "left_len", "right_len", "common", F.round("f1", 9).alias("f1"))


def _versions(spark, d) -> tuple[DataFrame, DataFrame]:
    """Conversations as documents, and the same with turns left out, new, or changed a little or much."""
    base = _t(spark, d, "conversations").select(F.col("conv_id").alias("doc_id"), F.col("turn").alias("block_idx"), F.lit("paragraph").alias("type"), "text")
    none = {"level": "int", "ordered": "boolean", "items": "array<string>", "code": "string", "language": "string", "headers": "array<string>", "rows": "array<array<string>>", "src": "string", "alt": "string", "asset_id": "string", "format": "string", "content": "string"}
    full = base.withColumns({k: F.lit(None).cast(v) for k, v in none.items()})
    changed = F.when(F.col("block_idx") % 5 == 2, F.concat("text", F.lit("!"))).when(F.col("block_idx") % 7 == 4, F.concat("text", F.lit(" and more"))).otherwise(F.col("text"))
    return full, full.filter("block_idx % 6 <> 5").withColumn("text", changed)


_VERSIONS = r"""o AS (SELECT conv_id AS doc_id, turn AS i, text, array_to_string(regexp_split_to_array(regexp_replace(text, '^\s+|\s+$', '', 'g'), '\s+')[1:8], ' ') AS h FROM conversations),
v AS (SELECT conv_id AS doc_id, turn AS i, CASE WHEN turn % 5 = 2 THEN text || '!' WHEN turn % 7 = 4 THEN text || ' and more' ELSE text END AS text FROM conversations WHERE turn % 6 <> 5),
n AS (SELECT *, array_to_string(regexp_split_to_array(regexp_replace(text, '^\s+|\s+$', '', 'g'), '\s+')[1:8], ' ') AS h FROM v),
o1 AS (SELECT *, row_number() OVER (PARTITION BY doc_id, text ORDER BY i) AS k FROM o), n1 AS (SELECT *, row_number() OVER (PARTITION BY doc_id, text ORDER BY i) AS k FROM n),
p1 AS (SELECT o1.doc_id, o1.i AS a, n1.i AS b FROM o1 JOIN n1 USING (doc_id, text, k)),
o2 AS (SELECT *, row_number() OVER (PARTITION BY doc_id, h ORDER BY i) AS k FROM o WHERE (doc_id, i) NOT IN (SELECT (doc_id, a) FROM p1)),
n2 AS (SELECT *, row_number() OVER (PARTITION BY doc_id, h ORDER BY i) AS k FROM n WHERE (doc_id, i) NOT IN (SELECT (doc_id, b) FROM p1)),
p2 AS (SELECT o2.doc_id, o2.i AS a, n2.i AS b, o2.text AS x, n2.text AS y FROM o2 JOIN n2 USING (doc_id, h, k)),
removed AS (SELECT doc_id, i FROM o2 WHERE (doc_id, i) NOT IN (SELECT (doc_id, a) FROM p2)), added AS (SELECT doc_id, i FROM n2 WHERE (doc_id, i) NOT IN (SELECT (doc_id, b) FROM p2))"""


@query(f"""WITH {_VERSIONS}, g AS (SELECT doc_id, count(*) FILTER (lower(regexp_replace(x, '[\\s\\p{{P}}]+', '', 'g')) = lower(regexp_replace(y, '[\\s\\p{{P}}]+', '', 'g'))) AS minor, count(*) AS total FROM p2 GROUP BY doc_id),
s AS (SELECT b.doc_id, n_blocks, coalesce(total - minor, 0) AS major, coalesce(minor, 0) AS minor, coalesce(r, 0) AS removed, coalesce(d, 0) AS added, coalesce(n_after, 0) AS n_after FROM (SELECT doc_id, count(*) AS n_blocks FROM o GROUP BY doc_id) b
 LEFT JOIN (SELECT doc_id, count(*) AS n_after FROM n GROUP BY doc_id) USING (doc_id) LEFT JOIN g USING (doc_id) LEFT JOIN (SELECT doc_id, count(*) AS r FROM removed GROUP BY doc_id) USING (doc_id) LEFT JOIN (SELECT doc_id, count(*) AS d FROM added GROUP BY doc_id) USING (doc_id))
SELECT doc_id, n_blocks, major, minor, removed, added, round(greatest(0, least(1, 1 - (0.4::DOUBLE * major + 0.05::DOUBLE * minor + 0.5::DOUBLE * (removed + added)) / n_blocks)), 9)::DOUBLE AS score,
 CASE WHEN major + minor + removed + added = 0 THEN 'exact' WHEN (removed + added) / n_blocks > 0.3 OR n_after = 0 THEN 'broken' WHEN major > 0 THEN 'major-drift' ELSE 'minor-drift' END AS fidelity FROM s""")
def rule_diff_score(spark, d):
    return verify.diff(*_versions(spark, d))


@query(f"WITH {_VERSIONS} SELECT doc_id, i AS block_idx FROM removed")
def removed_blocks(spark, d):
    return verify.align(*_versions(spark, d))[1].select("doc_id", "block_idx")


@query(f"WITH {_VERSIONS} SELECT doc_id, i AS block_idx FROM added")
def added_blocks(spark, d):
    return verify.align(*_versions(spark, d))[2].select("doc_id", "block_idx")


@query("""WITH m AS (SELECT conv_id AS doc_id, turn, text FROM conversations) SELECT doc_id, bool_and(turn % 6 <> 5 AND turn % 5 <> 2 AND turn % 7 <> 4) AS equal FROM m GROUP BY doc_id""")
def documents_equivalent(spark, d):
    return verify.equivalent(*_versions(spark, d))


@query("""SELECT source, target, (CASE source WHEN 'ofd' THEN 'md' WHEN 'pptx' THEN NULL ELSE 'md' END) AS safer FROM (VALUES ('md', 'pptx'), ('html', 'pptx'), ('json', 'pptx'), ('ofd', 'md'), ('md', 'html')) AS p(source, target) WHERE (source, target) IN (('md', 'pptx'), ('html', 'pptx'), ('json', 'pptx'))""")
def repair_routes(spark, d):
    pairs = spark.createDataFrame([(1, "md", "pptx"), (2, "html", "pptx"), (3, "json", "pptx"), (4, "ofd", "md"), (5, "md", "html")], "doc_id long, source string, target string")
    none = spark.createDataFrame([], "doc_id long, severity string, code string, message string")
    found = repair.propose(pairs, none).filter(repair.accepted())
    return found.select(F.split("evidence", "->")[0].alias("source"), F.split("evidence", "->")[1].alias("target"), F.col("target").alias("safer")).select("source", "target", "safer")


# --- HTML ---------------------------------------------------------------------------------------------------


@query(r"""WITH h AS (SELECT page_id, unnest(regexp_extract_all(html, '(?is)<h([1-6])\b[^>]*>', 1))::INTEGER AS level FROM pages) SELECT page_id, level, count(*) AS n FROM h GROUP BY ALL""")
def html_headings(spark, d):
    blocks = readers.blocks_of(readers.read(_t(spark, d, "pages"), "html", "html", "page_id")).filter("type = 'heading'")
    return blocks.groupBy(F.col("doc_id").alias("page_id"), "level").agg(F.count("*").alias("n"))


@query(r"""WITH l AS (SELECT page_id, regexp_extract_all(html, '(?is)<a\b[^>]*?href="([^"]*)"', 1) AS ls FROM pages) SELECT page_id, (i - 1)::INTEGER AS pos, ls[i] AS href FROM l, unnest(range(1, len(ls) + 1)) AS r(i)""")
def html_links(spark, d):
    return readers.links(readers.read(_t(spark, d, "pages"), "html", "html", "page_id")).withColumnRenamed("doc_id", "page_id")


@query(r"""SELECT page_id, md5(regexp_replace(regexp_replace(replace(replace(replace(replace(replace(replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(html,
 '(?i)<style[\s\S]*?</style>', '', 'g'), '(?i)<script[\s\S]*?</script>', '', 'g'), '(?i)<\s*br\s*/?>', chr(10), 'g'), '(?i)<\s*/p\s*>', chr(10) || chr(10), 'g'), '(?i)<\s*/div\s*>', chr(10), 'g'), '<[^>]+>', '', 'g'),
 '&nbsp;', ' '), '&amp;', '&'), '&lt;', '<'), '&gt;', '>'), '&quot;', '"'), '&#39;', chr(39)), '\n{3,}', chr(10) || chr(10), 'g'), '^\s+|\s+$', '', 'g')) AS text_md5 FROM pages""")
def html_strip_text(spark, d):
    return _t(spark, d, "pages").select("page_id", F.md5(tx.strip_html(F.col("html"))).alias("text_md5"))


# --- layout -------------------------------------------------------------------------------------------------

_LINES = "(SELECT l_orderkey, l_linenumber, l_returnflag || l_linestatus AS text, (l_linenumber * 20 + (l_partkey % 3) * 4)::DOUBLE AS y, (10 + (l_suppkey % 4) * 4)::DOUBLE AS h FROM lineitem)"


def _lines(spark, d) -> DataFrame:
    return _t(spark, d, "lineitem").select("l_orderkey", "l_linenumber", F.concat("l_returnflag", "l_linestatus").alias("text"), (F.col("l_linenumber") * 20 + (F.col("l_partkey") % 3) * 4).cast("double").alias("y"), F.lit(0.0).alias("x"), (10 + (F.col("l_suppkey") % 4) * 4).cast("double").alias("h"))


@query(f"SELECT l_orderkey, l_linenumber, row_number() OVER (PARTITION BY l_orderkey ORDER BY y, text, l_linenumber)::INTEGER AS place FROM {_LINES}")
def reading_order(spark, d):
    return layout.reading_order(_lines(spark, d), "l_orderkey", ties=("text", "l_linenumber")).select("l_orderkey", "l_linenumber", "place")


@query(r"""WITH t AS (SELECT conv_id, trim(w) AS t FROM (SELECT conv_id, unnest(regexp_split_to_array(text, '\s+')) AS w FROM conversations) WHERE w <> ''),
r AS (SELECT conv_id, count(*) AS n, avg((length(t) <= 4)::INT) AS short, avg(regexp_full_match(t, '[\x21-\x7e]+')::INT) AS solid, max(length(t)) AS longest FROM t GROUP BY ALL),
c AS (SELECT conv_id, ch, count(*) AS k FROM (SELECT conv_id, unnest(string_split(t, '')) AS ch FROM t) WHERE ch <> '' GROUP BY ALL), f AS (SELECT conv_id, max(k) / sum(k) AS top FROM c GROUP BY ALL)
SELECT conv_id, n >= 8 AND (short >= 0.6 OR (solid >= 0.85 AND longest <= 6) OR (solid >= 0.9 AND top >= 0.25)) AS noise FROM r JOIN f USING (conv_id)""")
def glyph_noise(spark, d):
    return layout.glyph_noise(_t(spark, d, "conversations").select("conv_id", F.explode(F.split("text", r"\s+")).alias("text")), "conv_id")


@query(r"""WITH t AS (SELECT s.conv_id, s.turn, CASE WHEN s.turn % 3 = 0 THEN '中文' || s.text || '中文' WHEN s.turn % 3 = 1 THEN '한국어' || s.text || '日本語' ELSE s.text END AS line FROM conversations s),
o AS (SELECT conv_id, turn, line, lag(right(line, 1)) OVER (PARTITION BY conv_id ORDER BY turn) AS was FROM t)
SELECT conv_id, md5(string_agg(CASE WHEN was IS NULL THEN '' WHEN regexp_matches(was, '[\x{3400}-\x{9FFF}\x{F900}-\x{FAFF}\x{3040}-\x{30FF}\x{AC00}-\x{D7AF}]') AND regexp_matches(line, '^[\x{3400}-\x{9FFF}\x{F900}-\x{FAFF}\x{3040}-\x{30FF}\x{AC00}-\x{D7AF}]') THEN '' ELSE ' ' END || line, '' ORDER BY turn)) AS text_md5 FROM o GROUP BY conv_id""")
def ocr_joined_lines(spark, d):
    """Turns of a conversation as recognised lines of one paragraph."""
    turn = F.col("turn") % 3
    text = F.when(turn == 0, F.concat(F.lit("中文"), "text", F.lit("中文"))).when(turn == 1, F.concat(F.lit("한국어"), "text", F.lit("日本語"))).otherwise(F.col("text"))
    lines = _t(spark, d, "conversations").select("conv_id", text.alias("text"), F.lit(0.0).alias("x"), (F.col("turn") * 10).cast("double").alias("y"), F.lit(10.0).alias("h"))
    return layout.recognised_blocks(lines, "conv_id").select("conv_id", F.md5("text").alias("text_md5"))


@query(f"""WITH r AS (SELECT l_orderkey, l_linenumber, row_number() OVER (PARTITION BY l_orderkey ORDER BY y DESC, text, l_linenumber, h) AS k, y, h FROM (SELECT * REPLACE (y / 4 AS y) FROM {{_LINES}})),
w AS (SELECT l_orderkey, l_linenumber, k, y AS top, 1 AS pos FROM r WHERE k = 1 UNION ALL
 SELECT r.l_orderkey, r.l_linenumber, r.k, CASE WHEN abs(w.top - r.y) < 0.5 * r.h THEN w.top ELSE r.y END, CASE WHEN abs(w.top - r.y) < 0.5 * r.h THEN w.pos ELSE w.pos + 1 END FROM w JOIN r ON r.l_orderkey = w.l_orderkey AND r.k = w.k + 1)
SELECT l_orderkey, l_linenumber, pos FROM w""".replace("WITH r AS", "WITH RECURSIVE r AS").replace("{_LINES}", _LINES))
def page_line_numbers(spark, d):
    runs = _lines(spark, d).withColumn("y", F.col("y") / 4)
    return layout.line_numbers(runs.select("l_orderkey", "y", "x", "text", "l_linenumber", "h"), "l_orderkey").select("l_orderkey", "l_linenumber", "pos")


@query(f"""WITH w AS (SELECT l_orderkey, floor(h * 2 + 0.5) / 2 AS b, sum(length(text)) AS weight, min(l_linenumber) AS first FROM {_LINES} GROUP BY ALL)
SELECT l_orderkey, b AS body FROM w QUALIFY row_number() OVER (PARTITION BY l_orderkey ORDER BY weight DESC, first, b) = 1""")
def body_font_mode(spark, d):
    return layout.body_size(_lines(spark, d).withColumnRenamed("l_linenumber", "pos"), "l_orderkey")


@query(f"""WITH m AS (SELECT l_orderkey, median(h) AS mid FROM {_LINES} GROUP BY ALL), s AS (SELECT l.*, mid, h / mid >= 1.35 AS head, lag(y + h) OVER w AS bottom, lag(h / mid >= 1.35) OVER w AS after FROM {_LINES} l JOIN m USING (l_orderkey) WINDOW w AS (PARTITION BY l_orderkey ORDER BY y, l.text, h)),
g AS (SELECT *, sum(coalesce(y - bottom > 0.7 * mid OR head OR after, true)::INT) OVER (PARTITION BY l_orderkey ORDER BY y, text, h ROWS UNBOUNDED PRECEDING) AS block FROM s)
SELECT l_orderkey, count(DISTINCT block) AS n_blocks, count(*) FILTER (head) AS n_headings FROM g GROUP BY ALL""")
def ocr_structure(spark, d):
    found = layout.recognised_blocks(_lines(spark, d), "l_orderkey")
    return found.groupBy("l_orderkey").agg(F.count("*").alias("n_blocks"), F.count_if(F.col("type") == "heading").alias("n_headings"))


@query(r"""SELECT source, lang, avg(length(regexp_replace(text, '\s', '', 'g'))) < 300 AS scanned FROM documents GROUP BY ALL""")
def scanned_documents(spark, d):
    return layout.is_scanned(_t(spark, d, "documents"), "source", "lang")


@query(r"""SELECT conv_id, turn, length(text) > 0 AND length(text) <= 2000 AND NOT contains(text, chr(65533)) AND len(regexp_extract_all(text, '[\x00-\x08\x0B\x0C\x0E-\x1F]')) <= 0.02 * length(text)
 AND len(regexp_extract_all(text, '[\PC\t\n\r]')) >= 0.85 * length(text) AND regexp_matches(text, '[\pL\pN]') AS credible FROM conversations""")
def credible_text(spark, d):
    return _t(spark, d, "conversations").select("conv_id", "turn", layout.credible(F.col("text")).alias("credible"))


@query("""SELECT user_id, arg_max(event_id, (value, event_id)) AS best FROM events GROUP BY user_id""")
def best_candidate(spark, d):
    return tables.best(_t(spark, d, "events"), F.col("event_id"), F.struct("value", "event_id"), "user_id")


# --- pixels and tensors -------------------------------------------------------------------------------------

_PIXELS = "(SELECT vec_id, i % 8 AS x, i // 8 AS y, embedding[i + 1]::DOUBLE * 100 AS a, embedding[len(embedding) - i]::DOUBLE * 100 AS b FROM embeddings, unnest(range(0, len(embedding))) AS r(i))"


def _pixels(spark, d) -> DataFrame:
    at = _t(spark, d, "embeddings").select("vec_id", "embedding", F.posexplode("embedding").alias("i", "v"))
    return at.select("vec_id", (F.col("i") % 8).alias("x"), F.floor(F.col("i") / 8).alias("y"), (F.col("v").cast("double") * 100).alias("a"), (F.element_at("embedding", -(F.col("i") + 1)).cast("double") * 100).alias("b"))


@query(f"""WITH w AS (SELECT vec_id, y // 4 AS wy, x // 4 AS wx, avg(a) AS ma, avg(b) AS mb, avg(a * a) AS aa, avg(b * b) AS bb, avg(a * b) AS ab FROM {_PIXELS} GROUP BY ALL)
SELECT vec_id, round(avg((2 * ma * mb + 6.5025) * (2 * (ab - ma * mb) + 58.5225) / ((ma * ma + mb * mb + 6.5025) * (aa - ma * ma + bb - mb * mb + 58.5225))), 6)::DOUBLE AS ssim FROM w GROUP BY vec_id""")
def ssim_windows(spark, d):
    return images.ssim(_pixels(spark, d), "vec_id", size=4).select("vec_id", F.round("ssim", 6).alias("ssim"))


@query(f"SELECT vec_id, (x * 4 // 8)::BIGINT AS x, (y * 2 // 8)::BIGINT AS y, round(avg(a), 6) AS v FROM {_PIXELS} GROUP BY ALL")
def box_resample(spark, d):
    pixels = _pixels(spark, d).select("vec_id", "x", "y", F.col("a").alias("v"), F.lit(8).alias("w"), F.lit(8).alias("h"))
    return images.box_resample(pixels, 4, 2, "vec_id").select("vec_id", "x", "y", F.round("v", 6).alias("v"))


@query("""WITH l AS (SELECT vec_id, i // 4 AS t, i % 4 AS cls, embedding[i + 1] AS v FROM embeddings, unnest(range(0, len(embedding))) AS r(i)),
s AS (SELECT vec_id, t, arg_max(cls, (v, -cls)) AS label FROM l GROUP BY ALL), k AS (SELECT *, lag(label) OVER (PARTITION BY vec_id ORDER BY t) AS was FROM s),
j AS (SELECT vec_id, string_agg(label::VARCHAR, '' ORDER BY t) AS labels FROM k WHERE label <> 0 AND (was IS NULL OR was <> label) GROUP BY vec_id)
SELECT e.vec_id, coalesce(labels, '') AS labels FROM embeddings e LEFT JOIN j USING (vec_id)""")
def ctc_decode(spark, d):
    logits = _t(spark, d, "embeddings").select("vec_id", F.posexplode("embedding").alias("i", "v")).select("vec_id", F.floor(F.col("i") / 4).alias("t"), (F.col("i") % 4).alias("cls"), "v")
    found = images.ctc_decode(images.argmax_labels(logits, "vec_id"), "vec_id")
    return found.select("vec_id", F.array_join(F.col("labels").cast("array<string>"), "").alias("labels"))


@query()
def skew_angle(spark, d):
    return images.skew(_pixels(spark, d).filter("a > 0"), "vec_id")


# --- recognition and lookups --------------------------------------------------------------------------------


@query("""WITH c AS (SELECT l_orderkey, round(l_discount * 1000)::BIGINT AS c, l_tax > 0.05 AS turned FROM lineitem),
s AS (SELECT l_orderkey, count(*) AS n_lines, sum(least(c, 100)) AS total, avg(least(c, 100)) AS average, min(least(c, 100)) AS least, count(*) FILTER (c < 60) AS low, count(*) FILTER (turned) AS turned FROM c GROUP BY ALL)
SELECT l_orderkey, n_lines, round(average / 100, 6)::DOUBLE AS average, (least / 100)::DOUBLE AS least, low, turned, CASE WHEN total >= 90 * n_lines AND low = 0 THEN 'high' WHEN total >= 70 * n_lines THEN 'medium' ELSE 'low' END AS grade FROM s""")
def ocr_summary(spark, d):
    """Confidences are decimals, so that averages at the edge of a grade are exact."""
    lines = _t(spark, d, "lineitem").select("l_orderkey", F.round(F.col("l_discount") * 10, 2).cast("decimal(6,2)").alias("confidence"), F.when(F.col("l_tax") > 0.05, "90").otherwise("0").alias("orientation"))
    return ocr.summary(lines, "l_orderkey").withColumns({"average": F.round(F.col("average").cast("double"), 6), "least": F.col("least").cast("double")})


@query("""SELECT o_custkey, count(*) AS pages, sum(o_orderkey % 9)::BIGINT AS runs, round(avg((o_orderkey % 11) / 10), 6) AS average, sum(o_orderkey)::BIGINT AS runtime_ms FROM orders GROUP BY ALL""")
def ocr_merge_pages(spark, d):
    pages = _t(spark, d, "orders").select("o_custkey", (F.col("o_orderkey") % 9).alias("n_lines"), ((F.col("o_orderkey") % 11) / 10).alias("average"), F.col("o_orderkey").alias("runtime_ms"))
    return ocr.merge_pages(pages, "o_custkey").withColumn("average", F.round("average", 6))


@query("""SELECT doc_id, CASE lang WHEN 'en' THEN 'en' WHEN 'zh' THEN 'zh-CN' ELSE 'auto' END AS language, CASE lang WHEN 'en' THEN 'eng' WHEN 'zh' THEN 'chi_sim' END AS data_code FROM documents""")
def ocr_languages(spark, d):
    return _t(spark, d, "documents").select("doc_id", ocr.language(F.col("lang"), strict=True).alias("language"), ocr.data_code(F.col("lang")).alias("data_code"))


@query()
def ocr_line_blocks(spark, d):
    talk = _t(spark, d, "conversations").select(F.col("conv_id").alias("doc_id"), F.col("turn").alias("block_idx"), F.concat(F.lit("b"), "turn").alias("block_id"), "text")
    lines = talk.select("doc_id", (F.col("block_idx") * 2).alias("line"), F.substring("text", 3, 12).alias("text"))
    return ocr.line_blocks(lines, talk)


@query("""SELECT l_orderkey AS doc_id, l_linenumber, coalesce(p_name, '') AS value FROM lineitem LEFT JOIN part ON p_partkey = l_partkey AND p_size % 2 = 0""")
def shared_string_lookup(spark, d):
    cells = _t(spark, d, "lineitem").select(F.lit(0).alias("doc_id"), "l_orderkey", "l_linenumber", F.col("l_partkey").alias("idx"))
    strings = _t(spark, d, "part").filter("p_size % 2 = 0").select(F.lit(0).alias("doc_id"), F.col("p_partkey").alias("idx"), F.col("p_name").alias("text"))
    return lookups.by_index(cells, strings).select(F.col("l_orderkey").alias("doc_id"), "l_linenumber", "value")


@query("""SELECT c_custkey, c_nationkey IN (SELECT n_nationkey FROM nation WHERE n_regionkey % 2 = 0) AS is_date FROM customer""")
def style_date_lookup(spark, d):
    cells = _t(spark, d, "customer").select(F.lit(0).alias("doc_id"), "c_custkey", F.col("c_nationkey").alias("style"))
    styles = _t(spark, d, "nation").select(F.lit(0).alias("doc_id"), F.col("n_nationkey").alias("style"), F.col("n_regionkey").alias("format_id"))
    formats = _t(spark, d, "region").select(F.lit(0).alias("doc_id"), F.col("r_regionkey").alias("format_id"), F.when(F.col("r_regionkey") % 2 == 0, "yyyy-mm-dd").otherwise('h:mm "day"').alias("code"))
    return lookups.dated(cells, styles, formats).select("c_custkey", "is_date")


@query("""SELECT n_regionkey AS doc_id, row_number() OVER (PARTITION BY n_regionkey ORDER BY c_custkey)::INTEGER AS place, n_name AS href FROM customer JOIN nation ON c_nationkey = n_nationkey""")
def spine_order(spark, d):
    region = _t(spark, d, "nation")
    refs = _t(spark, d, "customer").join(region, F.col("c_nationkey") == F.col("n_nationkey")).select(F.col("n_regionkey").alias("doc_id"), F.col("c_custkey").alias("pos"), F.col("c_nationkey").alias("item_id"))
    return lookups.spine(refs, region.select(F.col("n_regionkey").alias("doc_id"), F.col("n_nationkey").alias("item_id"), F.col("n_name").alias("href")))


@query("""SELECT coalesce(a.k, b.k) AS name, CASE WHEN a.k IS NULL THEN 'entries' ELSE 'directory' END AS missing_in FROM (SELECT DISTINCT o_custkey AS k FROM orders) a FULL JOIN (SELECT c_custkey AS k FROM customer WHERE c_custkey % 5 > 0) b ON a.k = b.k WHERE a.k IS NULL OR b.k IS NULL""")
def archive_directory_errors(spark, d):
    entries = _t(spark, d, "orders").select(F.lit(0).alias("doc_id"), F.col("o_custkey").alias("name"))
    central = _t(spark, d, "customer").filter("c_custkey % 5 > 0").select(F.lit(0).alias("doc_id"), F.col("c_custkey").alias("name"))
    return lookups.directory_errors(entries, central).select("name", "missing_in")


@query(r"""WITH c AS (SELECT lang, unnest(regexp_extract_all(text, '[^\x00-\x7F]')) AS ch FROM documents), n AS (SELECT lang, ch, count(*) AS n FROM c GROUP BY ALL)
SELECT lang, ch, n FROM n QUALIFY row_number() OVER (PARTITION BY lang ORDER BY n DESC, ch) <= 10""")
def dropped_characters(spark, d):
    return lookups.dropped_characters(_t(spark, d, "documents"), r"\x00-\x7F", "lang")


@query()
def fixed_layout_blocks(spark, d):
    talk = _t(spark, d, "conversations").select(F.col("conv_id").alias("doc_id"), F.col("turn").cast("int").alias("block_idx"), F.when(F.col("turn") == 0, "heading").otherwise("paragraph").alias("type"), F.when(F.col("turn") == 0, 1).alias("level"), "text")
    return fixed.to_semantic(fixed.from_semantic(talk))


# --- readers, writers, conversions --------------------------------------------------------------------------


def _digest(df: DataFrame) -> DataFrame:
    return df.select("doc_id", "format", F.md5("data").alias("data_md5"), F.octet_length("data").alias("n_bytes"), F.size("warnings").alias("n_warnings"), F.col("error.code").alias("error_code"))


@query()
def read_markdown_blocks(spark, d):
    docs = readers.read(_t(spark, d, "documents"), "md", "text")
    return readers.blocks_of(docs).groupBy("doc_id", "type").agg(F.count("*").alias("n"))


@query()
def read_html_blocks(spark, d):
    docs = readers.read(_t(spark, d, "pages"), "html", "html", "page_id")
    return readers.blocks_of(docs).groupBy("doc_id", "type").agg(F.count("*").alias("n"))


@query("""SELECT event_id AS doc_id, array_to_string(json_keys(props), '|') AS headers, array_to_string(list_transform(json_keys(props), lambda k: json_extract_string(props, '$."' || k || '"')), '|') AS cells FROM events""")
def read_json_tables(spark, d):
    docs = readers.read(_t(spark, d, "events").select(F.col("event_id").alias("doc_id"), F.concat(F.lit("["), "props", F.lit("]")).alias("content")), "json")
    return readers.blocks_of(docs).select("doc_id", F.array_join("headers", "|").alias("headers"), F.array_join(F.get("rows", F.lit(0)), "|").alias("cells"))


@query()
def source_spans(spark, d):
    docs = _t(spark, d, "documents").select("doc_id", F.col("text").alias("content"))
    return audit.source_spans(readers.blocks_of(readers.read(docs, "md")), docs)


@query()
def document_fingerprints(spark, d):
    return verify.model_fingerprint(readers.blocks_of(readers.read(_t(spark, d, "documents"), "txt", "text")))


@query()
def convert_md_to_html(spark, d):
    return _digest(convert.convert(_t(spark, d, "documents"), "md", "html", "text"))


def _conversion(source: str, target: str) -> Query:
    def run(spark, d):
        if source == "html":
            return _digest(convert.convert(_t(spark, d, "pages"), "html", target, "html", "page_id"))
        if source == "csv":
            lines = _t(spark, d, "orders").withColumn("line", tables.csv_line(F.col("o_orderkey"), F.col("o_orderstatus"), F.col("o_orderpriority")))
            text = F.concat(F.lit("key,status,priority\n"), F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("o_orderkey", "line"))), lambda x: x.line), "\n"))
            return _digest(convert.convert(lines.groupBy(F.col("o_custkey").alias("doc_id")).agg(text.alias("content")), "csv", target))
        if source == "json":
            return _digest(convert.convert(_t(spark, d, "events").withColumnRenamed("event_id", "doc_id"), "json", target, "props"))
        return _digest(convert.convert(_t(spark, d, "documents"), source, target, "text"))

    return run


_ORDER_ROWS = """(SELECT o_custkey AS doc_id, count(*) AS n, string_agg({row}, {between} ORDER BY o_orderkey) AS body FROM orders GROUP BY o_custkey)"""
_DIGEST = "SELECT doc_id, '{fmt}' AS format, md5(data) AS data_md5, strlen(data)::INTEGER AS n_bytes, {notes}::INTEGER AS n_warnings, NULL::VARCHAR AS error_code FROM ({data})"
#: What the writers make of tables of orders and of JSON objects, for the conversions that SQL can follow.
_CONVERTED = {
    "convert_csv_to_md": _DIGEST.format(fmt="md", notes=2, data="SELECT doc_id, '| key | status | priority |' || chr(10) || '| --- | --- | --- |' || chr(10) || body || chr(10) AS data FROM " + _ORDER_ROWS.format(row="'| ' || o_orderkey || ' | ' || o_orderstatus || ' | ' || o_orderpriority || ' |'", between="chr(10)")),
    "convert_csv_to_html": _DIGEST.format(fmt="html", notes=2, data="""SELECT doc_id, array_to_string(['<!doctype html>', '<html>', '<head>', '<meta charset="utf-8" />', '<title>document</title>', '</head>', '<body>', '<table>', '  <thead>',
 '    <tr><th>key</th><th>status</th><th>priority</th></tr>', '  </thead>', '  <tbody>', body, '  </tbody>', '</table>', '</body>', '</html>', ''], chr(10)) AS data FROM """ + _ORDER_ROWS.format(row="'    <tr><td>' || o_orderkey || '</td><td>' || o_orderstatus || '</td><td>' || o_orderpriority || '</td></tr>'", between="chr(10)")),
    "convert_csv_to_json": _DIGEST.format(fmt="json", notes=2, data=r"""SELECT doc_id, array_to_string(['{', '  "schemaVersion": "1.0.0",', '  "title": "document",', '  "sourceFormat": "",', '  "blocks": [', '    {', '      "type": "table",', '      "headers": [', '        "key",', '        "status",', '        "priority"', '      ],', '      "rows": [',
 b, '      ],', '      "alignments": []', '    }', '  ],', '  "plainText": "key\\tstatus\\tpriority\\n' || p || '",', '  "markdown": "| key | status | priority |\\n| --- | --- | --- |\\n' || m || '\\n"', '}', ''], chr(10)) AS data FROM (SELECT o_custkey AS doc_id,
 string_agg('        [' || chr(10) || '          "' || o_orderkey || '",' || chr(10) || '          "' || o_orderstatus || '",' || chr(10) || '          "' || o_orderpriority || '"' || chr(10) || '        ]', ',' || chr(10) ORDER BY o_orderkey) AS b,
 string_agg(o_orderkey || '\\t' || o_orderstatus || '\\t' || o_orderpriority, '\\n' ORDER BY o_orderkey) AS p, string_agg('| ' || o_orderkey || ' | ' || o_orderstatus || ' | ' || o_orderpriority || ' |', '\\n' ORDER BY o_orderkey) AS m FROM orders GROUP BY o_custkey)""".replace("\\\\", "\\")),
}
_PRETTY = """(SELECT event_id AS doc_id, '{' || chr(10) || array_to_string(list_transform(json_keys(props), lambda k: '  "' || k || '": ' || json_extract(props, '$."' || k || '"')::VARCHAR), ',' || chr(10)) || chr(10) || '}' AS body FROM events)"""
_CONVERTED |= {
    "convert_json_to_md": _DIGEST.format(fmt="md", notes=0, data="SELECT doc_id, '# JSON Document' || chr(10) || chr(10) || '```json' || chr(10) || body || chr(10) || '```' || chr(10) AS data FROM " + _PRETTY),
    "convert_json_to_csv": _DIGEST.format(fmt="csv", notes=0, data="SELECT doc_id, 'Text' || chr(10) || 'JSON Document' || chr(10) || '\"' || replace(body, '\"', '\"\"') || '\"' || chr(10) AS data FROM " + _PRETTY),
    "convert_json_to_xml": _DIGEST.format(fmt="xml", notes=0, data="""SELECT doc_id, '<?xml version="1.0" encoding="UTF-8"?>' || chr(10) || '<document title="document">' || chr(10) || '  <heading level="1">JSON Document</heading>' || chr(10) || '  <code language="json"><![CDATA[' || body || ']]></code>' || chr(10) || '</document>' || chr(10) AS data FROM """ + _PRETTY),
}

for _s, _to in {"md": ("txt", "json", "csv", "xml", "docx", "xlsx", "pdf", "epub", "pptx", "webp"), "html": ("md", "txt", "json"), "csv": ("md", "html", "json", "xlsx"), "json": ("md", "csv", "xml"), "txt": ("md", "html")}.items():
    for _x in _to:
        QUERIES[f"convert_{_s}_to_{_x}"] = _conversion(_s, _x)


ORACLE_SQL |= _CONVERTED


def _talks(spark, d) -> DataFrame:
    """Each conversation as one text, a paragraph a turn."""
    turns = F.transform(F.array_sort(F.collect_list(F.struct("turn", "text"))), lambda x: x.text)
    return _t(spark, d, "conversations").groupBy(F.col("conv_id").alias("doc_id")).agg(F.array_join(turns, "\n\n").alias("content"))


_TALKS = f"""SELECT doc_id, {_PARAGRAPHS} AS ps FROM (SELECT conv_id AS doc_id, string_agg(text, chr(10) || chr(10) ORDER BY turn, text) AS text FROM conversations GROUP BY conv_id)"""


def _paragraphs_through(fmt: str) -> Query:
    """Texts written in a format and read back: their paragraphs, or the rows of the table that stands for them."""

    def run(spark, d):
        blocks = readers.blocks_of(convert.read_back(readers.read(_talks(spark, d), "txt"), fmt))
        if fmt in ("csv", "xlsx"):
            rows = blocks.filter("type = 'table'").select("doc_id", F.posexplode("rows").alias("at", "r"))
            rows = rows.select("doc_id", "at", F.get("r", F.lit(0)).alias("text"))
        else:
            rows = blocks.filter("type = 'paragraph'").select("doc_id", F.col("block_idx").alias("at"), "text")
        paged = fmt == "pdf"  # a paragraph that goes on on the next page comes back as two
        text = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("at", "text"))), lambda x: x.text), " " if paged else "\n")
        return rows.groupBy("doc_id").agg(*([] if paged else [F.count("*").alias("n")]), F.md5(text).alias("text_md5"))

    return run


for _x in ("md", "html", "txt", "json", "xml", "csv", "docx", "xlsx", "epub", "pptx", "pdf"):
    QUERIES[f"paragraphs_through_{_x}"] = _paragraphs_through(_x)
    _what = "md5(array_to_string(ps, ' '))" if _x == "pdf" else "len(ps)::BIGINT AS n, md5(array_to_string(ps, chr(10)))"
    ORACLE_SQL[f"paragraphs_through_{_x}"] = f"SELECT doc_id, {_what} AS text_md5 FROM ({_TALKS}) WHERE len(ps) > 0"


def _tables_through(fmt: str) -> Query:
    """Tables written in a format and read back, cell by cell."""

    def run(spark, d):
        lines = _t(spark, d, "orders").withColumn("line", tables.csv_line(F.col("o_orderkey"), F.col("o_orderstatus"), F.col("o_orderpriority")))
        text = F.concat(F.lit("key,status,more\n"), F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("o_orderkey", "line"))), lambda x: x.line), "\n"))
        docs = lines.groupBy(F.col("o_custkey").alias("doc_id")).agg(text.alias("content"))
        blocks = readers.blocks_of(convert.read_back(readers.read(docs, "csv"), fmt)).filter("type = 'table'")
        return blocks.select("doc_id", F.array_join("headers", "|").alias("headers"), F.size("rows").alias("n"), F.md5(F.array_join(F.transform("rows", lambda r: F.array_join(r, "|")), "\n")).alias("rows_md5"))

    return run


for _x in ("md", "html", "json", "csv", "docx", "xlsx", "epub"):
    QUERIES[f"tables_through_{_x}"] = _tables_through(_x)
    ORACLE_SQL[f"tables_through_{_x}"] = "SELECT o_custkey AS doc_id, 'key|status|more' AS headers, count(*)::INTEGER AS n, md5(string_agg(o_orderkey || '|' || o_orderstatus || '|' || o_orderpriority, chr(10) ORDER BY o_orderkey)) AS rows_md5 FROM orders GROUP BY o_custkey"


def _trip(fmt: str) -> Query:
    def run(spark, d):
        return convert.round_trip(readers.read(_t(spark, d, "pages"), "html", "html", "page_id"), fmt)

    return run


for _x in ("md", "html", "json", "docx", "epub", "pdf"):
    QUERIES[f"round_trip_{_x}"] = _trip(_x)


@query()
def conversion_quality(spark, d):
    return convert.report(readers.read(_t(spark, d, "pages"), "html", "html", "page_id"))


@query(f"""SELECT source, target, CASE WHEN source NOT IN ('md', 'html', 'txt', 'json', 'xml', 'csv') OR target NOT IN ('md', 'html', 'txt', 'json', 'xml', 'csv') THEN 'writer-not-text-canonical' END AS rule_diff,
 CASE WHEN source NOT IN ('pdf', 'png', 'html', 'docx', 'pptx') OR target NOT IN ('pdf', 'png', 'html', 'docx', 'pptx') THEN 'format-not-drawn' END AS visual FROM (VALUES {_VALUES([(s, t) for s, to in catalog.MATRIX.items() for t in to])}) AS m(source, target)""")
def verification_gates(spark, d):
    return stage.gates(catalog.matrix(spark))


@query()
def verify_html_to_md(spark, d):
    return stage.rule_diff(readers.read(_t(spark, d, "pages"), "html", "html", "page_id"), "html", "md")


@query(r"""WITH n AS (SELECT doc_id, length(regexp_replace(text, '\s+', '', 'g')) AS l, length(regexp_replace(replace(text, 'e', ''), '\s+', '', 'g')) AS r FROM documents),
f AS (SELECT doc_id, round(CASE WHEN l = 0 THEN 1 WHEN r = 0 THEN 0 ELSE 2 * (r / l) / (r / l + 1) END, 9) AS f1 FROM n)
SELECT doc_id, f1, f1 >= 0.7 AS passed, CASE WHEN f1 < 0.7 THEN 'OCR_READBACK_DRIFT' END AS warning FROM f""")
def ocr_read_back(spark, d):
    pairs = _t(spark, d, "documents").select("doc_id", F.col("text").alias("expected"), F.replace("text", F.lit("e"), F.lit("")).alias("read"))
    return stage.read_text(pairs).withColumn("f1", F.round("f1", 9))
