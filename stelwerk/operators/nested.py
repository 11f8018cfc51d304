"""Flat tables with parent links from nested records.

All payloads of a batch are exploded level by level: the objects of one level become rows of their kinds' tables, each with
a surrogate key, its parent's surrogate key, the name of the field that holds it, its position in that field and its plain
fields; the objects and list elements in them are the next level, until none is left. Rows are objects of JSON (also those
inside strings), plain values in JSON lists, and elements of XML. Tables writes the rows once, those of a kind together,
and infers the merged schema of every kind over them: its typed columns, and the fields that lead to child tables. All
results are read from there. A payload never leaves its task.
"""

from __future__ import annotations

import json
from collections.abc import Iterator
from decimal import Decimal, InvalidOperation
from itertools import chain, islice
from xml.etree import ElementTree

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from stelwerk.session import written

ROOT = "root"
#: The field of a list element that is no object or list.
VALUE = "#value"
#: Kinds of fields that lead to a child table.
OBJECT, ARRAY = "object", "array"

#: One row per object. ``node`` and ``parent`` are paths of positions in the payload, unique within it; ``depth`` counts
#: objects; ``anchor`` is the id of the nearest identified object around it, null if there is none.
NODE_SCHEMA = "raw_key string, form string, entity string, node string, parent string, ordinal int, depth int, id string, anchor string, fields map<string,string>, kinds map<string,string>"
_ARROW = pa.schema([
    ("raw_key", pa.string()), ("form", pa.string()), ("entity", pa.string()), ("node", pa.string()), ("parent", pa.string()), ("ordinal", pa.int32()),
    ("depth", pa.int32()), ("id", pa.string()), ("anchor", pa.string()), ("fields", pa.map_(pa.string(), pa.string())), ("kinds", pa.map_(pa.string(), pa.string())),
])


class _Number(str):
    """A JSON number as written."""


class _Fields(list):
    """The fields of a JSON object in order, repeated names included."""


def _no_constant(name: str):
    raise ValueError(f"{name} is not JSON")


_DECODER = json.JSONDecoder(object_pairs_hook=_Fields, parse_int=_Number, parse_float=_Number, parse_constant=_no_constant)


def _json(text: str):
    """The value of a complete JSON text; None if it is not well-formed as a whole."""
    try:
        return _DECODER.decode(text)
    except (ValueError, RecursionError):
        return None


def _inner(value):
    """A string that is a complete JSON object or list becomes that; anything else stays."""
    if type(value) is str and value.lstrip(" \t\r\n")[:1] in ("{", "["):
        got = _json(value)
        if isinstance(got, list):
            return got
    return value


def decimal_text(number: str) -> str:
    """A number's decimal text: as written, without an exponent."""
    if "e" not in number.lower():
        return str(number)
    try:
        return format(Decimal(number), "f")
    except InvalidOperation:
        return str(number)


def _text(value) -> tuple[str | None, str]:
    if value is None:
        return None, "null"
    if isinstance(value, bool):
        return str(value).lower(), "boolean"
    if isinstance(value, _Number):
        return decimal_text(value), "bigint" if value.lstrip("-").isdigit() and len(value) < 19 else "double"
    return str(value), "string"


def json_nodes(payloads: list[tuple[str | None, str]], values: bool = True) -> Iterator[tuple]:
    """Rows (NODE_SCHEMA) of all objects in (key, JSON text) pairs, level by level; none of a text that isn't well-formed.
    An element of a list that is no object or list has a row too, with its value as ``#value`` (none if it is null), unless
    ``values`` is false."""
    level = [(key, top, ROOT, None, "0", 0, 0, None) for key, text in payloads if isinstance(top := _inner(_json(text)), list)]
    while level:
        below: list[tuple] = []
        for key, value, entity, parent, path, ordinal, depth, anchor in level:
            if isinstance(value, _Fields):
                own, fields, kinds, nested = None, {}, {}, []
                for name, v in value:
                    v = _inner(v)
                    if isinstance(v, list):
                        nested.append((name, v))
                        kinds[name] = OBJECT if isinstance(v, _Fields) else ARRAY
                        continue
                    shown, kind = _text(v)
                    if kind != "null":
                        fields[name] = shown
                        kinds[name] = kind
                    if own is None and name.lower() == "id" and kind not in ("null", "boolean") and shown.strip():
                        own = shown
                yield key, "json", entity, path, parent, ordinal, depth, own, anchor, list(fields.items()), list(kinds.items())
                near = own if own is not None else anchor
                below += [(key, v, name, path, f"{path}.{i}", 0, depth + 1, near) for i, (name, v) in enumerate(nested)]
            elif isinstance(value, list):  # its elements are named by the field that holds it, and hang on its object
                below += [(key, _inner(v), entity, parent, f"{path}.{i}", i, depth, anchor) for i, v in enumerate(value)]
            elif values:
                shown, kind = _text(value)
                found = kind != "null"
                yield key, "json", entity, path, parent, ordinal, depth, None, anchor, [(VALUE, shown)] * found, [(VALUE, kind)] * found
        level = below


def local_name(tag: str) -> str:
    return tag.rpartition("}")[2]


def _xml(text: str) -> ElementTree.Element | None:
    try:
        return ElementTree.fromstring(text)
    except (ElementTree.ParseError, ValueError, RecursionError):
        return None


def xml_nodes(payloads: list[tuple[str | None, str]]) -> Iterator[tuple]:
    """Rows (NODE_SCHEMA) of all elements in (key, XML text) pairs, level by level; none of a text that isn't well-formed.
    Fields are the attributes by local name and, as ``#text`` and ``#tail``, the stripped text before the element's first
    child and between its end and the next tag. A tail belongs to the text of the element around it: ``#text`` and the
    ``#tail`` of the children by ``ordinal`` are all of that. The id is the attribute ``id``."""
    level = [(key, top, None, "0", 0, 0, None) for key, text in payloads if (top := _xml(text)) is not None]
    while level:
        below: list[tuple] = []
        for key, e, parent, path, ordinal, depth, anchor in level:
            fields = {local_name(k): v for k, v in e.attrib.items()}
            own = fields.get("id")
            if e.text and e.text.strip():
                fields["#text"] = e.text.strip()
            if e.tail and e.tail.strip():
                fields["#tail"] = e.tail.strip()
            kinds = {local_name(c.tag): ARRAY for c in e if isinstance(c.tag, str)} | dict.fromkeys(fields, "string")
            yield key, "xml", local_name(e.tag), path, parent, ordinal, depth, own, anchor, list(fields.items()), list(kinds.items())
            near = own if own is not None else anchor
            below += [(key, c, path, f"{path}.{i}", i, depth + 1, near) for i, c in enumerate(e) if isinstance(c.tag, str)]
        level = below


def flatten(df: DataFrame, key: str = "_key", json_col: str | None = "payload_json", xml_col: str | None = "payload_text", xml_where: str = "true", values: bool = False) -> DataFrame:
    """One row per object of the payloads (NODE_SCHEMA), with ``values`` also one per plain value in a list. A row's XML
    counts only where ``xml_where`` holds; a row may have both payloads. Null, empty and malformed payloads yield no rows,
    each on its own; a null key stays null; repeated payloads yield their rows again; an empty table gives no rows; other
    columns are not read. An object in a list has its position as ``ordinal``. A field without a value and an empty list
    inside a list leave no trace."""
    none = F.lit(None).cast("string")
    rows = df.select(F.col(key).cast("string").alias("k"), (F.col(json_col) if json_col else none).alias("j"), (F.when(F.expr(xml_where), F.col(xml_col)) if xml_col else none).alias("x"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for at in range(0, b.num_rows, 128):
                k, j, x = (c.to_pylist() for c in b.slice(at, 128).columns)
                rows = chain(json_nodes([p for p in zip(k, j) if p[1]], values), xml_nodes([p for p in zip(k, x) if p[1]]))
                while held := list(islice(rows, 4096)):
                    yield _batch(held)

    return rows.where("j is not null or x is not null").mapInArrow(run, NODE_SCHEMA)


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), _ARROW.types)], schema=_ARROW)


def merged_schema(nodes: DataFrame) -> DataFrame:
    """``form, entity, field, kind, n``: every field seen in a kind of object and how many objects have it. For plain
    values ``kind`` is the narrowest type that holds all of them (bigint, double, boolean or string); for objects and lists,
    in a row of their own, it is ``object``, or ``array`` if any is a list, and their rows are in the table of that name."""
    below = F.col("kind").isin(OBJECT, ARRAY)
    sums = [F.count("*").alias("n"), F.min("kind").alias("lo"), F.max("kind").alias("hi"), F.bool_or(F.col("kind") == "boolean").alias("truth")]
    seen = nodes.select("form", "entity", F.explode("kinds").alias("field", "kind")).groupBy("form", "entity", "field", below.alias("below")).agg(*sums)
    plain = F.when(F.col("lo") == F.col("hi"), F.col("lo")).when((F.col("lo") == "bigint") & (F.col("hi") == "double") & ~F.col("truth"), "double").otherwise("string")
    return seen.select("form", "entity", "field", F.when(F.col("below"), F.col("lo")).otherwise(plain).alias("kind"), "n")


_KEYS = ["raw_key", "node", "parent", "ordinal", "depth", "id"]


def entity_table(nodes: DataFrame, entity: str, schema: dict[str, str], form: str | None = None) -> DataFrame:
    """The objects of one kind (and ``form``, if given) as a table: surrogate keys, position and a typed column per field
    of ``schema`` (field to type, as from merged_schema). Values that don't fit are null; columns named like a key or an
    earlier column, but for case, get a ``_``."""
    cols, taken = [], set(_KEYS)
    for f, t in schema.items():
        name = f
        while name.lower() in taken:
            name += "_"
        taken.add(name.lower())
        cols.append(F.col("fields")[f].try_cast(t).alias(name))
    rows = nodes.where(F.col("entity") == entity)
    return (rows if form is None else rows.where(F.col("form") == form)).select(*_KEYS, *cols)


class Tables:
    """The flat tables of all kinds of object. ``nodes``: their rows, written once, those of a kind together in each file, so
    that one kind is read without the others; ``schema``: merged_schema over them."""

    def __init__(self, nodes: DataFrame):
        self.nodes = written(nodes.sortWithinPartitions("form", "entity"), "nodes")
        self.schema = merged_schema(self.nodes)

    def of_kind(self, form: str, entity: str) -> DataFrame:
        """One kind as a table (entity_table) with every plain field of its schema; an XML table's ``id`` is the attribute,
        which has no column of its own. A kind there is none of has the keys only. The driver gets this kind's fields."""
        own = self.schema.where((F.col("form") == form) & (F.col("entity") == entity) & ~F.col("kind").isin(OBJECT, ARRAY))
        return entity_table(self.nodes, entity, {r.field: r.kind for r in sorted(own.collect()) if (form, r.field) != ("xml", "id")}, form)

    def kinds(self) -> list[tuple[str, str]]:
        """(form, entity) of every kind there is."""
        return sorted((r.form, r.entity) for r in self.nodes.select("form", "entity").distinct().collect())

    def children(self) -> DataFrame:
        """``form, entity, child``: the links between the tables, by the schema: fields that hold objects or lists."""
        return self.schema.where(F.col("kind").isin(OBJECT, ARRAY)).select("form", "entity", F.col("field").alias("child"))

    def in_one(self) -> DataFrame:
        """All tables in one: a row per object and field, with the object's keys, the field's type from the schema, the
        value as text and, for other types than string, in a column of its type. An object without fields has one row without
        a field."""
        plain = self.schema.where(~F.col("kind").isin(OBJECT, ARRAY)).drop("n")
        rows = self.nodes.select("form", "entity", *_KEYS, F.explode_outer("fields").alias("field", "value"))
        typed = [F.when(F.col("kind") == t, F.col("value").try_cast(t)).alias(f"{t}_value") for t in ("bigint", "double", "boolean")]
        return rows.join(plain, ["form", "entity", "field"], "left").select("form", "entity", *_KEYS, "field", "kind", "value", *typed)

    def identified(self) -> DataFrame:
        """``raw_key, entity, child_id, parent_id`` of the objects with an id, from the tables that have one by the schema;
        the parent is the nearest identified object around it, else the payload's key. Distinct."""
        having = self.schema.where((F.lower("field") == "id") & ~F.col("kind").isin(OBJECT, ARRAY)).select("form", "entity").distinct()
        rows = self.nodes.where("id is not null").join(having, ["form", "entity"], "left_semi")
        return rows.select("raw_key", "entity", F.col("id").alias("child_id"), F.coalesce("anchor", "raw_key").alias("parent_id")).distinct()
