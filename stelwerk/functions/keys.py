"""Deterministic keys of nodes and edges."""

from __future__ import annotations

import unicodedata

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T


@F.pandas_udf(T.StringType())
def _ascii_fold(values: pd.Series) -> pd.Series:
    return values.map(lambda v: unicodedata.normalize("NFKD", v).encode("ascii", "ignore").decode(), na_action="ignore")


def ascii_fold(c: Column) -> Column:
    """Compatibility decomposition without anything that isn't ASCII. Only values with such characters go to Python."""
    other = c.rlike(r"[^\x00-\x7F]")
    return F.when(other, _ascii_fold(F.when(other, c))).otherwise(c)


def sanitize_key(c: Column, fallback: str = "node", fold: bool = True) -> Column:
    """Lower-case ASCII letters, digits and single underscores, none at the ends; ``fallback`` if nothing is left. Null is
    null. ``fold=False`` for values known to be ASCII: no Python then."""
    s = F.lower(ascii_fold(c) if fold else c)
    s = F.regexp_replace(F.regexp_replace(s, "[^a-z0-9_]+", "_"), "_{2,}", "_")
    s = F.regexp_replace(s, "^_|_$", "")
    return F.when(c.isNotNull(), F.coalesce(F.nullif(s, F.lit("")), F.lit(fallback)))


def _blank(c: Column) -> Column:
    return ~F.coalesce(c, F.lit("")).rlike(r"(?U)\S")


def node_key(*parts: Column, fallback: str = "node", fold: bool = True) -> Column:
    """The key of the parts that are neither null nor blank, joined by underscores."""
    joined = F.concat_ws("_", *[F.when(~_blank(p), p) for p in parts])
    return sanitize_key(joined, fallback, fold)


def node_id(collection: str | Column, key: Column) -> Column:
    """``collection/key``; null if the key is."""
    at = F.lit(collection) if isinstance(collection, str) else collection
    return F.concat(at, F.lit("/"), key)


def id_collection(c: Column) -> Column:
    return F.substring_index(c, "/", 1)


def id_key(c: Column) -> Column:
    """What follows the first slash; null without one."""
    return F.when(F.instr(c, "/") > 0, F.substring(c, F.instr(c, "/") + 1, F.length(c)))


def edge_key(source: Column, target: Column, relation: Column | str, fold: bool = False) -> Column:
    """``key(source)__key(target)__RELATION``, the relation as it is."""
    rel = F.lit(relation) if isinstance(relation, str) else relation
    return F.concat_ws("__", sanitize_key(source, fold=fold), sanitize_key(target, fold=fold), rel)
