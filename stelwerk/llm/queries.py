"""Queries of the text operators over the whole driver tables, and their SQL where there is any."""

from __future__ import annotations

import unicodedata
from functools import lru_cache

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from stelwerk.llm import boilerplate, canonical, leakage, packing, spam


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _look_alikes(spark: SparkSession, d: str) -> DataFrame:
    number, text, law = "props.article_number", "props.text", "props.bwb_id"
    edges = canonical.digests(table(spark, d, "edges_semantic"), "rec_id", {"raw_match": (["_from"], ["meta.raw_match"], "meta.raw_match")})
    articles = canonical.digests(table(spark, d, "instrument_articles"), "rec_id", {"article_number": ([law], [number], number), "text": ([law], [number, text], text)})
    return canonical.look_alikes(edges.unionByName(articles))


def p1_found(spark: SparkSession, d: str) -> DataFrame:
    return canonical.look_alike_pairs(_look_alikes(spark, d))


def p1_classes(spark: SparkSession, d: str) -> DataFrame:
    """The same rows as classes: the least id that looks the same, the least id that is the same."""
    return canonical.look_alike_classes(_look_alikes(spark, d)).withColumnRenamed("id", "rec_id")


def p1_canonical(spark: SparkSession, d: str) -> DataFrame:
    """Every value of the three fields in its one form, and whether that differs from what is stored."""
    edges, articles = table(spark, d, "edges_semantic"), table(spark, d, "instrument_articles")
    parts = [(edges, "raw_match", "meta.raw_match"), (articles, "article_number", "props.article_number"), (articles, "text", "props.text")]
    rows = [df.select(F.lit(n).alias("field"), "rec_id", canonical.canonical(F.col(c)).alias("value"), F.col(c).alias("stored")).where("stored is not null") for df, n, c in parts]
    all_rows = rows[0].unionByName(rows[1]).unionByName(rows[2])
    return all_rows.select("field", "rec_id", "value", (F.col("value") != F.col("stored")).alias("changed"))


def p4_found(spark: SparkSession, d: str) -> DataFrame:
    return boilerplate.main_text(table(spark, d, "instruments"), "rec_id", "props.raw_html").select("rec_id", "block_id").distinct()


def p4_main_text(spark: SparkSession, d: str) -> DataFrame:
    """The main text of every page that has one, its blocks joined by line feeds."""
    blocks = boilerplate.main_text(table(spark, d, "instruments"), "rec_id", "props.raw_html")
    joined = F.concat_ws("\n", F.transform(F.array_sort(F.collect_list(F.struct("position", "text"))), lambda x: x["text"]))
    return blocks.groupBy("rec_id").agg(F.count("*").alias("n_blocks"), joined.alias("main_text"))


def p7_packing(spark: SparkSession, d: str) -> DataFrame:
    return packing.pack(table(spark, d, "documents"))


def p7_fill(spark: SparkSession, d: str) -> DataFrame:
    """How full the containers are: one row of totals."""
    bins = packing.pack(table(spark, d, "documents")).groupBy("container").agg(F.sum("n_tokens").alias("n"))
    return bins.agg(F.count("*").alias("n_containers"), F.sum("n").alias("n_tokens"), F.max("n").alias("fullest"), F.sum(packing.CAPACITY - F.col("n")).alias("unused_tokens"))


def p8_found(spark: SparkSession, d: str) -> DataFrame:
    return leakage.leaked(table(spark, d, "documents"), table(spark, d, "eval_items"))


def p8_coverage(spark: SparkSession, d: str) -> DataFrame:
    """Items of which a document holds at least half the words in common runs, in any order."""
    return leakage.coverage(table(spark, d, "documents"), table(spark, d, "eval_items"))


def p8_leaked_items(spark: SparkSession, d: str) -> DataFrame:
    """Which test items leaked, into how many documents."""
    return p8_found(spark, d).groupBy("item_id").agg(F.count("*").alias("n_documents"))


def p9_found(spark: SparkSession, d: str) -> DataFrame:
    return spam.pages(table(spark, d, "documents")).where("is_spam").select("doc_id")


def p9_shapes(spark: SparkSession, d: str) -> DataFrame:
    """Pages by their main non-sentence shape: how many, how many of them flagged, how many words."""
    pages = spam.pages(table(spark, d, "documents")).where("top_shape is not null")
    return pages.groupBy("top_shape").agg(F.count("*").alias("n_pages"), F.count_if("is_spam").alias("n_flagged"), F.sum("top_words").alias("n_words"))


QUERIES = {f.__name__: f for f in (p1_found, p1_classes, p1_canonical, p4_found, p4_main_text, p7_packing, p7_fill, p8_found, p8_coverage, p8_leaked_items, p9_found, p9_shapes)}



@lru_cache(maxsize=1)
def _forms() -> dict[str, str]:
    """What each character becomes on its own, where it doesn't stay."""
    codes = (*range(0x9, 0x20), *range(0x80, 0x3400), *range(0xA000, 0xAC00), *range(0xF900, 0xFFF0))
    forms = {chr(x): canonical.canonical_text(f"x{chr(x)}x")[1:-1] for x in codes if not unicodedata.combining(chr(x))}
    return {a: b for a, b in forms.items() if a != b}


def _canonical_sql(c: str) -> str:
    """The canonical form by whole texts: every character on its own by a table, joined letters one by one, then composed."""
    forms = _forms()
    one, none = {a: b for a, b in forms.items() if len(b) == 1}, [a for a, b in forms.items() if not b]
    # Deleted characters stand last: what has no counterpart in the second list goes.
    text = f"translate(replace({c}, chr(13) || chr(10), chr(10)), {_quoted(''.join(one) + ''.join(none))}, {_quoted(''.join(one.values()))})"
    for a, b in forms.items():
        if len(b) > 1 and (a in "Ĳĳ" or "\u2160" <= a <= "\u217f" or "\ufb00" <= a <= "\ufb06"):
            text = f"replace({text}, {_quoted(a)}, {_quoted(b)})"
    return f"trim(nfc_normalize({text}))"


def _quoted(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


_LOOKS = f"""
  WITH rows_ AS (
    SELECT 'raw_match' AS field, rec_id AS id, _from AS g, NULL AS number, meta.raw_match AS x FROM edges_semantic
    UNION ALL SELECT 'article_number', rec_id, props.bwb_id, NULL, props.article_number FROM instrument_articles
    UNION ALL SELECT 'text', rec_id, props.bwb_id, props.article_number, props.text FROM instrument_articles WHERE props.article_number IS NOT NULL),
  looks AS (SELECT field, id, g, {_canonical_sql('number')} AS number, {_canonical_sql('x')} AS look, x FROM rows_ WHERE g IS NOT NULL AND x IS NOT NULL AND id IS NOT NULL)
"""
_SAME = "a.field = b.field AND a.g = b.g AND a.look = b.look AND a.number IS NOT DISTINCT FROM b.number"

SQL: dict[str, str] = {
    "p1_found": _LOOKS + f"SELECT DISTINCT a.field, a.id AS id_a, b.id AS id_b FROM looks a JOIN looks b ON {_SAME} AND a.id < b.id AND a.x <> b.x",
    "p1_classes": _LOOKS
    + """, classed AS (SELECT field, id, min(id) OVER (PARTITION BY field, g, number, look) AS class_id, min(id) OVER (PARTITION BY field, g, number, look, x) AS spelling_id,
        min(x) OVER (PARTITION BY field, g, number, look) AS lo, max(x) OVER (PARTITION BY field, g, number, look) AS hi FROM looks)
      SELECT field, id AS rec_id, class_id, spelling_id FROM classed WHERE lo <> hi""",
    "p1_canonical": f"""
      SELECT field, rec_id, value, value <> stored AS changed FROM (SELECT field, rec_id, {_canonical_sql('stored')} AS value, stored FROM (
        SELECT 'raw_match' AS field, rec_id, meta.raw_match AS stored FROM edges_semantic UNION ALL SELECT 'article_number', rec_id, props.article_number FROM instrument_articles
        UNION ALL SELECT 'text', rec_id, props.text FROM instrument_articles) WHERE stored IS NOT NULL)""",
}


#: The shapes of problem 9 by tokens: links, words and separators in their order, counted per line of LINE words.
_SHAPES = rf"""
  WITH plain AS (
    SELECT doc_id, regexp_replace(regexp_replace(regexp_replace(regexp_replace(replace(text, chr(1), ' '), '<[aA][^<>]*>', ' ' || chr(1) || ' ', 'g'), '</?[a-zA-Z][^<>]*>', ' ', 'g'),
      '(?:https?://|www\.)[^\s<>"'')\]]+|[\pL\pN_-]+(?:\.[\pL\pN_-]+)+/[^\s<>"'')\]]*', ' ' || chr(1) || ' ', 'g'), '(^|[\pZ\n\r\t\x0b\x0c\x85])-', '\1' || chr(2), 'g') AS t FROM documents WHERE text IS NOT NULL),
  cut AS (SELECT doc_id, unnest(regexp_split_to_array(regexp_replace(regexp_replace(t, '[\p{{Cf}}\p{{Mn}}\p{{Me}}]', '', 'g'), '([.!?。！？])\pZ', '\1' || chr(10), 'g'), '[\n\r\t\x0b\x0c\x85\x{{2028}}\x{{2029}}]')) AS line FROM plain),
  numbered AS (SELECT doc_id, row_number() OVER () AS line_id, regexp_extract_all(line, '\x01|[\pL\p{{Mc}}]+|[#|•·»>,;:/–—$€£()\[\]\x02]') AS parts FROM cut),
  tokens AS (SELECT doc_id, line_id, unnest(parts) AS tok, unnest(generate_series(1, len(parts))) AS i FROM numbered WHERE len(parts) > 0),
  told AS (SELECT *, tok = chr(1) AS is_link, regexp_matches(tok, '^[\pL\p{{Mc}}]') AS is_word FROM tokens),
  placed AS (SELECT *, sum(CASE WHEN is_link OR is_word THEN 1 ELSE 0 END) OVER (PARTITION BY line_id ORDER BY i) AS u, lower(tok) AS low FROM told),
  pieces AS (SELECT *, cast(greatest(u - 1, 0) AS BIGINT) // {spam.LINE} AS p FROM placed),
  repeated AS (SELECT line_id, p, sum(n) AS n FROM (SELECT line_id, p, low, count(*) AS n FROM pieces WHERE is_word AND length(tok) > {spam.SHORT} GROUP BY line_id, p, low HAVING count(*) > 1) GROUP BY line_id, p),
  main AS (SELECT line_id, p, arg_max(c, (n, -c)) AS sep, sum(n) AS n FROM (SELECT line_id, p, CASE WHEN tok = chr(2) THEN 45 ELSE unicode(tok) END AS c, count(*) AS n FROM pieces WHERE NOT is_word AND NOT is_link GROUP BY line_id, p, c) GROUP BY line_id, p),
  counted AS (SELECT doc_id, line_id, p, count(*) FILTER (is_word) AS words, count(*) FILTER (is_link) AS links, count(*) FILTER (is_word AND length(tok) <= {spam.SHORT}) AS short,
      count(*) FILTER (is_word AND regexp_matches(tok, '^[\p{{Lu}}\p{{Lt}}]')) AS caps, count(*) FILTER (is_word AND u = 1 AND regexp_matches(tok, '^[\p{{Lu}}\p{{Lt}}]')) AS led FROM pieces GROUP BY doc_id, line_id, p HAVING words + links > 0),
  lines AS (SELECT c.*, coalesce(r.n, 0) AS again, coalesce(m.n, 0) AS seps, m.sep FROM counted c LEFT JOIN repeated r USING (line_id, p) LEFT JOIN main m USING (line_id, p)),
  judged AS (SELECT *, words >= {spam.LEAST} AND short > 0 AND links * {spam.LINKED} <= words AND seps * {spam.SEPARATED} <= words AND again <= {spam.REPEATED} * words AS sentence,
      [CASE WHEN words < 3 THEN words WHEN words < 6 THEN 3 WHEN words < 10 THEN 4 ELSE 5 END, CASE WHEN caps = 0 THEN 0 WHEN caps = 1 AND led = 1 THEN 1 WHEN caps * 2 > words THEN 3 ELSE 2 END, coalesce(sep, 0), (links > 0)::INT, (again > {spam.REPEATED} * words)::INT] AS shape FROM lines),
  grouped AS (SELECT doc_id, shape, sum(words + links) AS n, row_number() OVER (PARTITION BY doc_id ORDER BY sum(words + links) DESC) AS rn FROM judged WHERE NOT sentence GROUP BY doc_id, shape),
  top AS (SELECT doc_id, sum(n) AS n FROM grouped WHERE rn <= {spam.TOP} GROUP BY doc_id),
  totals AS (SELECT doc_id, sum(words + links) AS n FROM judged GROUP BY doc_id)
"""
SQL["p9_found"] = _SHAPES + f"SELECT t.doc_id FROM totals t JOIN top USING (doc_id) WHERE t.n >= {spam.WHOLE} AND top.n >= {spam.DOMINANT} * t.n"
_SIZE, _CAPS = ("CASE shape[1] " + " ".join(f"WHEN {i} THEN '{n}'" for i, n in enumerate(spam._SIZES)) + " END", "CASE shape[2] " + " ".join(f"WHEN {i} THEN '{n}'" for i, n in enumerate(spam._CAPS)) + " END")
SQL["p9_shapes"] = _SHAPES.rstrip() + f""",
  first_ AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY n DESC, shape) AS k FROM grouped) WHERE k = 1),
  flagged AS (SELECT t.doc_id FROM totals t JOIN top USING (doc_id) WHERE t.n >= {spam.WHOLE} AND top.n >= {spam.DOMINANT} * t.n)
  SELECT {_SIZE} || ' words, capitals ' || {_CAPS} || CASE WHEN shape[3] > 0 THEN ', ' || chr(shape[3]::INT) ELSE '' END || CASE WHEN shape[4] = 1 THEN ', link' ELSE '' END || CASE WHEN shape[5] = 1 THEN ', repeated' ELSE '' END AS top_shape,
    count(*) AS n_pages, count(*) FILTER (doc_id IN (SELECT doc_id FROM flagged)) AS n_flagged, cast(sum(n) AS BIGINT) AS n_words FROM first_ GROUP BY top_shape"""
