"""The functions of this package under names for SQL.

``register(spark)`` makes them temporary functions of a session. They are written in SQL themselves, so Catalyst sees through
them: filters on them reach the files as those on the columns would, and nothing runs row by row.
"""

from __future__ import annotations

from pyspark.sql import SparkSession

#: Name: (parameters, type, body).
FUNCTIONS = {
    "sw_strip": ("s STRING", "STRING", r"regexp_replace(s, '(?U)^\\s+|\\s+$', '')"),
    "sw_filled": ("s STRING", "STRING", r"nullif(regexp_replace(s, '(?U)^\\s+|\\s+$', ''), '')"),
    "sw_strip_html": ("s STRING", "STRING", r"trim(regexp_replace(regexp_replace(s, '<[^>]+>', ' '), '\\s+', ' '))"),
    "sw_key": ("s STRING", "STRING", r"coalesce(nullif(trim(BOTH '_' FROM regexp_replace(regexp_replace(lower(s), '[^a-z0-9_]+', '_'), '_{2,}', '_')), ''), 'node')"),
    "sw_collection": ("id STRING", "STRING", "substring_index(id, '/', 1)"),
    "sw_id_key": ("id STRING", "STRING", "CASE WHEN contains(id, '/') THEN substr(id, instr(id, '/') + 1) END"),
    "sw_celex": ("letter STRING, year STRING, number STRING", "STRING", "format_string('3%s%s%04d', year, letter, coalesce(try_cast(number AS BIGINT), 0L))"),
    "sw_snippet": ("s STRING, a INT, b INT", "STRING", r"regexp_replace(substring(s, greatest(a - 40, 0) + 1, least(length(s), b + 40) - greatest(a - 40, 0)), '(?U)^\\s+|\\s+$', '')"),
}


def register(spark: SparkSession) -> list[str]:
    """Makes the functions known to the session and returns their names."""
    for name, (parameters, kind, body) in FUNCTIONS.items():
        spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION {name}({parameters}) RETURNS {kind} RETURN {body}")
    return sorted(FUNCTIONS)
