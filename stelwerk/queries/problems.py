"""Queries p2, p3, p5 and p6 over the whole driver tables, and their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from stelwerk.operators import hotkeys, intervals, nested, orphans

#: A (_to, relation) combination is heavy from this share of all rows, in percent.
HEAVY_PERCENT = 3
NODE_TABLES = ("instrument_articles", "instruments", "procedures", "publications", "topics")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def p2_found(spark: SparkSession, d: str) -> DataFrame:
    return intervals.periods_and_gaps(table(spark, d, "toestanden"))


def p2_coverage(spark: SparkSession, d: str) -> DataFrame:
    """Per law: its periods, its gaps, and the days of both."""
    days = F.datediff(F.col("end_date").cast("date"), F.col("start_date").cast("date")) + 1
    rows = intervals.periods_and_gaps(table(spark, d, "toestanden")).withColumn("days", days)
    sums = [F.sum(F.when(F.col("kind") == k, v).otherwise(0)).cast("bigint").alias(n) for k, v, n in (("period", F.lit(1), "n_periods"), ("gap", F.lit(1), "n_gaps"), ("period", F.col("days"), "covered_days"), ("gap", F.col("days"), "gap_days"))]
    return rows.groupBy("bwb_id").agg(*sums)


def p3_found(spark: SparkSession, d: str) -> DataFrame:
    edges = table(spark, d, "edges_semantic")
    found = hotkeys.heavy_keys(edges, ["_to", "relation"], HEAVY_PERCENT)
    return found.select(F.col("_to").alias("to_id"), "relation")


def p3_key_report(spark: SparkSession, d: str) -> DataFrame:
    """Results per ``_to`` and per relation: rows, mean and maximum confidence, distinct ``_from``, latest edge."""
    got = hotkeys.key_report(table(spark, d, "edges_semantic"), [["_to"], ["relation"]], "confidence", "created_at", "rec_id", "_from")
    kind = F.when(F.col("grouping") == 0, "to").otherwise("relation")
    return got.select(kind.alias("key_kind"), F.coalesce("_to", "relation").alias("key_value"), F.col("n").alias("n_edges"), F.col("mean_value").alias("mean_confidence"), F.col("max_value").alias("max_confidence"), F.col("n_distinct").alias("n_from"), F.date_format("latest_at", "yyyy-MM-dd HH:mm:ss.SSSSSS").alias("latest_at"), F.col("latest_rec").alias("latest_rec_id"))


def _orphans(spark: SparkSession, d: str) -> DataFrame:
    """References to procedures (side p) and to nodes (side n), looked up in one pass."""
    kinds = (("publications", "p", "props.procedure_external_id", "ingested_at"), ("edges_semantic", "n", "_to", "created_at"), ("edges_strict", "n", "_from", "created_at"))
    refs = [table(spark, d, t).select(F.lit(t).alias("src_table"), F.lit(side).alias("side"), "rec_id", F.col(c).alias("key"), F.col(at).alias("t")) for t, side, c, at in kinds]
    parents = [table(spark, d, t).select(F.lit(side).alias("side"), F.col(c).alias("key"), "ingested_at", "deleted_at") for t, side, c in (("procedures", "p", "props.external_id"), *((t, "n", "_id") for t in NODE_TABLES))]
    for rows in (refs, parents):
        for more in rows[1:]:
            rows[0] = rows[0].unionByName(more)
    return orphans.orphans(refs[0], parents[0], side="side")


def p5_found(spark: SparkSession, d: str) -> DataFrame:
    return _orphans(spark, d).select("src_table", "in_month", "rec_id", "reason")


def p5_orphan_report(spark: SparkSession, d: str) -> DataFrame:
    return orphans.orphan_report(_orphans(spark, d))


def _tables(spark: SparkSession, d: str) -> nested.Tables:
    return nested.Tables(nested.flatten(table(spark, d, "raw_sources"), xml_where="not (kind <=> 'eu-celex-html')", values=True))


def p6_found(spark: SparkSession, d: str) -> DataFrame:
    return _tables(spark, d).identified()


def p6_json_objects(spark: SparkSession, d: str) -> DataFrame:
    """Every object of the JSON payloads, with an id or without, by its surrogate key's length: per payload and kind of
    object, how many there are, how many with an id, and how deep they stand."""
    nodes = nested.flatten(table(spark, d, "raw_sources"), xml_col=None, values=False)
    return nodes.groupBy("raw_key", "entity").agg(F.count("*").alias("n_objects"), F.count("id").alias("n_ids"), F.min("depth").alias("min_depth"), F.max("depth").alias("max_depth"))


def p6_json_ids(spark: SparkSession, d: str) -> DataFrame:
    """p6_found of the JSON payloads alone."""
    return nested.Tables(nested.flatten(table(spark, d, "raw_sources"), xml_col=None)).identified()


def p6_merged_schema(spark: SparkSession, d: str) -> DataFrame:
    return _tables(spark, d).schema


def p6_table_links(spark: SparkSession, d: str) -> DataFrame:
    """Which kinds of object hold which: the parent and child tables of the merged schema."""
    return _tables(spark, d).children()


def p6_tables(spark: SparkSession, d: str) -> DataFrame:
    """Every kind of object with all fields of its merged schema, in one table with typed values."""
    return _tables(spark, d).in_one()


def p6_table_documentversie(spark: SparkSession, d: str) -> DataFrame:
    """Document versions as a typed table with all their fields, linked to the documents that hold them."""
    return _tables(spark, d).of_kind("json", "DocumentVersie")


def p6_table_lid(spark: SparkSession, d: str) -> DataFrame:
    """Paragraphs of BWB articles as a table with all their fields, linked to their articles. Their numbers and texts are
    elements inside them, rows of lidnr, al and others in p6_tables with the paragraph's ``node`` as ``parent``."""
    return _tables(spark, d).of_kind("xml", "lid")


QUERIES = {f.__name__: f for f in (p2_found, p2_coverage, p3_found, p3_key_report, p5_found, p5_orphan_report, p6_found, p6_json_ids, p6_json_objects, p6_merged_schema, p6_table_links, p6_tables, p6_table_documentversie, p6_table_lid)}

_DAY = """
  cast(CASE
    WHEN regexp_full_match(x, '\\d{4}-\\d{1,2}-\\d{1,2}([T ].*|Z|[+-]\\d{2}:?\\d{2})?') THEN try_cast(regexp_extract(x, '^\\d{4}-\\d{1,2}-\\d{1,2}') AS DATE)
    WHEN regexp_full_match(x, '\\d{1,2}-\\d{1,2}-\\d{4}([T ].*|Z|[+-]\\d{2}:?\\d{2})?') THEN try_cast(try_strptime(regexp_extract(x, '^\\d{1,2}-\\d{1,2}-\\d{4}'), '%d-%m-%Y') AS DATE)
    WHEN regexp_full_match(x, '\\d{8}([T ].*|Z|[+-]\\d{2}:?\\d{2})?') THEN try_cast(try_strptime(regexp_extract(x, '^\\d{8}'), '%Y%m%d') AS DATE) END AS DATE)"""
_TRIM = "regexp_replace({}, '^\\s+|\\s+$', '', 'g')"
_PERIODS = f"""
WITH raw AS (
  SELECT upper({_TRIM.format('bwb_id')}) AS bwb_id, {_TRIM.format('geldigheidsperiode_startdatum')} AS a, coalesce({_TRIM.format('geldigheidsperiode_einddatum')}, '') AS b FROM toestanden),
dated AS (
  SELECT DISTINCT bwb_id, {_DAY.replace('x,', 'a,')} AS s, CASE WHEN b = '' THEN DATE '9999-12-31' ELSE {_DAY.replace('x,', 'b,')} END AS e FROM raw WHERE bwb_id <> ''),
usable AS (SELECT * FROM dated WHERE s <= e),
marked AS (SELECT *, max(e) OVER (PARTITION BY bwb_id ORDER BY s, e ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS before FROM usable),
numbered AS (SELECT *, sum(CASE WHEN before IS NULL OR s - before > 1 THEN 1 ELSE 0 END) OVER (PARTITION BY bwb_id ORDER BY s, e ROWS UNBOUNDED PRECEDING) AS g FROM marked),
runs AS (SELECT bwb_id, g, min(s) AS s, max(e) AS e FROM numbered GROUP BY bwb_id, g),
ahead AS (SELECT *, lead(s) OVER (PARTITION BY bwb_id ORDER BY s) AS nxt FROM runs),
rows_ AS (
  SELECT bwb_id, 'period' AS kind, s AS a, e AS b FROM ahead
  UNION ALL SELECT bwb_id, 'gap', e + 1, nxt - 1 FROM ahead WHERE nxt IS NOT NULL)
"""
_REFS = """
WITH refs AS (
  SELECT 'publications' AS src_table, 'p' AS side, rec_id, props.procedure_external_id AS k, ingested_at AS t FROM publications
  UNION ALL SELECT 'edges_semantic', 'n', rec_id, _to, created_at FROM edges_semantic
  UNION ALL SELECT 'edges_strict', 'n', rec_id, _from, created_at FROM edges_strict),
parents AS (
  SELECT 'p' AS side, props.external_id AS k, ingested_at, deleted_at FROM procedures
  UNION ALL SELECT 'n', _id, ingested_at, deleted_at FROM instrument_articles
  UNION ALL SELECT 'n', _id, ingested_at, deleted_at FROM instruments
  UNION ALL SELECT 'n', _id, ingested_at, deleted_at FROM procedures
  UNION ALL SELECT 'n', _id, ingested_at, deleted_at FROM publications
  UNION ALL SELECT 'n', _id, ingested_at, deleted_at FROM topics),
met AS (
  SELECT r.src_table, r.rec_id, r.t, count(p.k) AS n, count(*) FILTER (p.ingested_at <= r.t) AS n_by, count(*) FILTER (p.ingested_at <= r.t AND (p.deleted_at IS NULL OR p.deleted_at > r.t)) AS n_there
  FROM refs r LEFT JOIN parents p ON p.side = r.side AND p.k = r.k WHERE trim(r.k) <> '' GROUP BY ALL),
found AS (
  SELECT src_table, strftime(t, '%Y-%m') AS in_month, rec_id, CASE WHEN n = 0 THEN 'missing' WHEN n_by = 0 THEN 'late' WHEN n_there = 0 THEN 'deleted' END AS reason FROM met)
"""

_INNER = "CASE WHEN json_type({0}) = 'VARCHAR' AND CASE WHEN json_valid({0} ->> '$') THEN json_type({0} ->> '$') END IN ('OBJECT', 'ARRAY') THEN ({0} ->> '$')::JSON ELSE {0} END"
_AT = "json_extract({0}, concat('$.\"', k, '\"'))"
_OWN_ID = f"""list_filter(list_transform(list_filter(CASE WHEN json_type({{0}}) = 'OBJECT' THEN json_keys({{0}}) ELSE [] END, lambda k: lower(k) = 'id'),
  lambda k: CASE WHEN json_type({_AT}) IN ('VARCHAR', 'UBIGINT', 'BIGINT', 'DOUBLE') AND regexp_matches({_AT} ->> '$', '\\S')
    AND coalesce(CASE WHEN json_valid({_AT} ->> '$') THEN json_type({_AT} ->> '$') END, '') NOT IN ('OBJECT', 'ARRAY') THEN {_AT} ->> '$' END), lambda x: x IS NOT NULL)[1]"""
_JSON_IDS = f"""
WITH RECURSIVE top AS (SELECT _key AS raw_key, payload_json::JSON AS j FROM raw_sources WHERE json_valid(payload_json)),
node AS (
  SELECT raw_key, 'root' AS entity, j, {_OWN_ID.format('j')} AS own, raw_key AS anchor FROM (SELECT raw_key, {_INNER.format('j')} AS j FROM top)
  UNION ALL
  SELECT raw_key, entity, j, {_OWN_ID.format('j')} AS own, anchor FROM (
    SELECT n.raw_key, CASE WHEN json_type(n.j) = 'OBJECT' THEN c.key ELSE n.entity END AS entity, {_INNER.format('c.value')} AS j, coalesce(n.own, n.anchor) AS anchor FROM node n, json_each(n.j) c
    WHERE json_type(n.j) IN ('OBJECT', 'ARRAY')))
"""
_UNESCAPED = "id"
for _a, _b in {"&lt;": "<", "&gt;": ">", "&quot;": '"', "&apos;": "''", "&amp;": "&"}.items():
    _UNESCAPED = f"replace({_UNESCAPED}, '{_a}', '{_b}')"
_ATTRIBUTE = r"""\s(?:[^\s=:"'']+:)?id\s*=\s*"""
#: Payloads in XML as a table of tags, and from that the identified elements with the nearest one around each.
_XML_IDS = rf"""
  xmls AS (SELECT _key AS raw_key, payload_text AS xml FROM raw_sources WHERE payload_text IS NOT NULL AND kind IS DISTINCT FROM 'eu-celex-html'),
  cut AS (SELECT raw_key, regexp_extract_all(xml, '<!--(?:[^-]|-[^-])*-->|<!\[CDATA\[[^\]]*\]\]>|<[^>]*>|[^<]+') AS parts FROM xmls),
  places AS (SELECT raw_key, unnest(parts) AS t, unnest(generate_series(1, len(parts))) AS i FROM cut),
  tags AS (SELECT *, CASE WHEN t LIKE '</%' THEN -1 WHEN t LIKE '<?%' OR t LIKE '<!%' OR t NOT LIKE '<%' THEN 0 WHEN t LIKE '%/>' THEN 2 ELSE 1 END AS kind, regexp_extract(t, '^</?(?:[^\s:>/]+:)?([^\s>/]+)', 1) AS name FROM places),
  deep AS (SELECT *, sum(CASE WHEN kind IN (1, -1) THEN kind ELSE 0 END) OVER (PARTITION BY raw_key ORDER BY i) AS depth FROM tags),
  ends AS (SELECT *, CASE kind WHEN 1 THEN depth ELSE depth + 1 END AS lvl FROM deep WHERE kind <> 0),
  closed AS (SELECT *, lead(i) OVER w AS til, lead(kind) OVER w AS nxt, lead(name) OVER w AS other FROM ends WHERE kind IN (1, -1) WINDOW w AS (PARTITION BY raw_key, lvl ORDER BY i)),
  broken AS (
    SELECT raw_key FROM deep GROUP BY raw_key HAVING min(depth) < 0 OR arg_max(depth, i) <> 0 OR max(CASE WHEN kind > 0 THEN 1 ELSE 0 END) = 0
    UNION SELECT raw_key FROM closed WHERE kind = 1 AND (nxt IS DISTINCT FROM -1 OR other <> name)
    UNION SELECT raw_key FROM ends WHERE lvl = 1 AND kind > 0 GROUP BY raw_key HAVING count(*) > 1
    UNION SELECT raw_key FROM deep WHERE depth = 0 AND kind = 0 AND t NOT LIKE '<%' AND regexp_matches(t, '[^ \t\r\n]')
    UNION SELECT raw_key FROM xmls WHERE len(regexp_extract_all(xml, '&')) <> len(regexp_extract_all(xml, '&(?:amp|lt|gt|quot|apos|#[0-9]+|#x[0-9a-fA-F]+);'))),
  el AS (SELECT raw_key, i, til, t, name, lvl FROM closed WHERE kind = 1 UNION ALL SELECT raw_key, i, i, t, name, lvl FROM ends WHERE kind = 2),
  own AS MATERIALIZED (
    SELECT raw_key, i, til, name, {_UNESCAPED} AS id FROM (SELECT *, coalesce(nullif(regexp_extract(t, '{_ATTRIBUTE}"([^"]*)"', 1), ''), regexp_extract(t, '{_ATTRIBUTE}''([^'']*)''', 1)) AS id FROM el
    WHERE regexp_matches(t, '{_ATTRIBUTE}["'']') AND raw_key NOT IN (SELECT raw_key FROM broken))),
  xml_ids AS (SELECT c.raw_key, c.name AS entity, any_value(c.id) AS child_id, coalesce(arg_max(p.id, p.i), c.raw_key) AS parent_id FROM own c LEFT JOIN own p ON p.raw_key = c.raw_key AND p.i < c.i AND p.til > c.i GROUP BY c.raw_key, c.name, c.i)
"""
_OBJECTS = f"""
WITH RECURSIVE top AS (SELECT _key AS raw_key, payload_json::JSON AS j FROM raw_sources WHERE json_valid(payload_json)),
node AS (
  SELECT raw_key, 'root' AS entity, {_INNER.format('j')} AS j, 0 AS depth FROM top
  UNION ALL
  SELECT raw_key, entity, {_INNER.format('value')} AS j, depth FROM (
    SELECT n.raw_key, CASE WHEN json_type(n.j) = 'OBJECT' THEN c.key ELSE n.entity END AS entity, c.value AS value, n.depth + (json_type(n.j) = 'OBJECT')::INT AS depth FROM node n, json_each(n.j) c
    WHERE json_type(n.j) IN ('OBJECT', 'ARRAY'))),
objects AS (SELECT row_number() OVER () AS n, * FROM node WHERE json_type(j) = 'OBJECT'),
named AS (
  SELECT DISTINCT n FROM objects, json_each(j) c WHERE lower(c.key) = 'id' AND json_type(c.value) NOT IN ('BOOLEAN', 'NULL') AND json_type({_INNER.format('c.value')}) NOT IN ('OBJECT', 'ARRAY') AND regexp_matches(c.value ->> '$', '\\S'))
"""

_IDS = "SELECT DISTINCT raw_key, entity, own AS child_id, anchor AS parent_id FROM node WHERE own IS NOT NULL"

_KIND = "CASE json_type({0}) WHEN 'BOOLEAN' THEN 'boolean' WHEN 'VARCHAR' THEN 'string' WHEN 'DOUBLE' THEN 'double' WHEN 'NULL' THEN NULL ELSE CASE WHEN length({0} ->> '$') < 19 THEN 'bigint' ELSE 'double' END END"
_SCHEMA = rf"""
  , members AS (
    SELECT n.entity, c.key AS field, {_INNER.format('c.value')} AS v, c.value AS raw FROM node n, json_each(n.j) c WHERE json_type(n.j) = 'OBJECT'
    UNION ALL SELECT n.entity, '#value', {_INNER.format('c.value')}, c.value FROM node n, json_each(n.j) c WHERE json_type(n.j) = 'ARRAY' AND json_type({_INNER.format('c.value')}) NOT IN ('OBJECT', 'ARRAY')),
  json_kinds AS (SELECT 'json' AS form, entity, field, CASE json_type(v) WHEN 'OBJECT' THEN 'object' WHEN 'ARRAY' THEN 'array' ELSE {_KIND.format('raw')} END AS kind FROM members),
  good AS MATERIALIZED (SELECT * FROM el WHERE raw_key NOT IN (SELECT raw_key FROM broken)),
  attrs AS (SELECT DISTINCT raw_key, i, name, regexp_replace(a, '^[^:]*:', '') AS field FROM (SELECT raw_key, i, name, unnest(regexp_extract_all(t, '\s([^\s=<>"''/]+)\s*=\s*(?:"[^"]*"|''[^'']*'')', 1)) AS a FROM good) WHERE a <> 'xmlns' AND a NOT LIKE 'xmlns:%'),
  near AS (SELECT raw_key, t, kind, last_value(CASE WHEN kind <> 0 THEN i END IGNORE NULLS) OVER (PARTITION BY raw_key ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS behind FROM deep),
  told AS (SELECT raw_key, behind FROM near WHERE kind = 0 AND t NOT LIKE '<%' AND behind IS NOT NULL AND regexp_matches(t, '[^\s\x0b\x{{85}}\x{{A0}}]')),
  texts AS (
    SELECT DISTINCT g.raw_key, g.i, g.name, '#text' AS field FROM told n JOIN good g ON g.raw_key = n.raw_key AND g.i = n.behind AND g.til > g.i
    UNION SELECT DISTINCT g.raw_key, g.i, g.name, '#tail' FROM told n JOIN good g ON g.raw_key = n.raw_key AND g.til = n.behind),
  own_fields AS (SELECT * FROM attrs UNION SELECT * FROM texts),
  held AS (SELECT DISTINCT p.raw_key, p.i, p.name, c.name AS field FROM good c JOIN good p ON p.raw_key = c.raw_key AND p.lvl = c.lvl - 1 AND p.i < c.i AND p.til > c.i),
  xml_kinds AS (
    SELECT 'xml' AS form, name AS entity, field, 'string' AS kind FROM own_fields
    UNION ALL SELECT 'xml', name, field, 'array' FROM held h WHERE NOT EXISTS (SELECT 1 FROM own_fields o WHERE o.raw_key = h.raw_key AND o.i = h.i AND o.field = h.field)),
  kinds AS (SELECT *, kind IN ('object', 'array') AS below FROM (SELECT * FROM json_kinds UNION ALL SELECT * FROM xml_kinds) WHERE kind IS NOT NULL)
  SELECT form, entity, field, CASE WHEN below OR min(kind) = max(kind) THEN min(kind) WHEN min(kind) = 'bigint' AND max(kind) = 'double' AND NOT bool_or(kind = 'boolean') THEN 'double' ELSE 'string' END AS kind, count(*) AS n
  FROM kinds GROUP BY form, entity, field, below"""
_LINKS = f"""
  SELECT DISTINCT 'json' AS form, n.entity, c.key AS child FROM node n, json_each(n.j) c WHERE json_type(n.j) = 'OBJECT' AND json_type({_INNER.format('c.value')}) IN ('OBJECT', 'ARRAY')
  UNION SELECT 'xml', p.name, c.name FROM el c JOIN el p ON p.raw_key = c.raw_key AND p.lvl = c.lvl - 1 AND p.i < c.i AND p.til > c.i WHERE c.raw_key NOT IN (SELECT raw_key FROM broken)"""

SQL = {
    "p6_merged_schema": _JSON_IDS.rstrip() + "," + _XML_IDS.rstrip() + _SCHEMA,
    "p6_table_links": _JSON_IDS.rstrip() + "," + _XML_IDS + _LINKS,
    "p6_found": _JSON_IDS.rstrip() + "," + _XML_IDS + _IDS + " UNION SELECT raw_key, entity, child_id, parent_id FROM xml_ids",
    "p6_json_ids": _JSON_IDS + _IDS,
    "p6_json_objects": _OBJECTS + "SELECT raw_key, entity, count(*) AS n_objects, count(named.n) AS n_ids, min(depth) AS min_depth, max(depth) AS max_depth FROM objects LEFT JOIN named USING (n) GROUP BY raw_key, entity",
    "p2_found": _PERIODS + "SELECT bwb_id, kind, strftime(a, '%Y-%m-%d') AS start_date, strftime(b, '%Y-%m-%d') AS end_date FROM rows_",
    "p2_coverage": _PERIODS + """SELECT bwb_id, count(*) FILTER (kind = 'period') AS n_periods, count(*) FILTER (kind = 'gap') AS n_gaps,
      cast(coalesce(sum(b - a + 1) FILTER (kind = 'period'), 0) AS BIGINT) AS covered_days, cast(coalesce(sum(b - a + 1) FILTER (kind = 'gap'), 0) AS BIGINT) AS gap_days FROM rows_ GROUP BY bwb_id""",
    "p3_found": f"SELECT _to AS to_id, relation FROM edges_semantic WHERE _to IS NOT NULL GROUP BY _to, relation HAVING count(*) * 100 >= (SELECT count(*) FROM edges_semantic) * {HEAVY_PERCENT}",
    "p3_key_report": """
      WITH x AS (SELECT 'to' AS key_kind, _to AS key_value, * FROM edges_semantic UNION ALL SELECT 'relation', relation, * FROM edges_semantic)
      SELECT key_kind, key_value, count(*) AS n_edges, round(avg(confidence), 6) AS mean_confidence, max(confidence) AS max_confidence, count(DISTINCT _from) AS n_from,
        strftime(max(created_at), '%Y-%m-%d %H:%M:%S.%f') AS latest_at, arg_max(rec_id, (created_at, rec_id)) AS latest_rec_id
      FROM x GROUP BY key_kind, key_value""",
    "p5_found": _REFS + "SELECT src_table, in_month, rec_id, reason FROM found WHERE reason IS NOT NULL",
    "p5_orphan_report": _REFS + "SELECT src_table, in_month, reason, count(*) AS n_orphans FROM found WHERE reason IS NOT NULL GROUP BY src_table, in_month, reason",
}
