import json

from hypothesis import given, settings
from hypothesis import strategies as st

from stelwerk.operators import nested as N

SCHEMA = "_key string, kind string, payload_json string, payload_text string, id string, entity string"


def ids(text, f=N.json_nodes):
    return [(r[2], r[7], r[8]) for r in sorted(f([("K", text)]), key=lambda r: r[3])]


def test_json_objects_ids_and_parents():
    text = json.dumps({"ID": 12, "Kenmerken": {"Taal": None}, "Zaak": [{"Id": "a", "Doc": {"id": 3.5}}, {"Id": " "}, {"Id": None, "Doc": [[{"Id": "b"}]]}], "S": json.dumps({"Id": "s", "Zaak": json.dumps([{"Id": "t"}])}), "Id": "x"})
    assert [x for x in ids(text) if x[1]] == [("root", "12", None), ("Zaak", "a", "12"), ("Doc", "3.5", "a"), ("Doc", "b", "12"), ("S", "s", "12"), ("Zaak", "t", "s")]
    assert ids(json.dumps(text)) == ids(text)
    assert ids('[{"Id": 1}, {"Id": true}]') == [("root", "1", None), ("root", None, None)]
    assert [x[1] for x in ids('{"Id": 1e2, "a": {"Id": 12345678901234567890}, "b": {"Id": 1.50}}')] == ["100", "12345678901234567890", "1.50"]


def test_malformed_json_yields_nothing():
    for text in ('{"Id": "a"', '{"Id": NaN}', "", "12", '"plain"', "null", '{"Id": "a"} x', "[" * 5000):
        assert ids(text) == []
    assert ids('{"Id": "a", "t": "{broken"}') == [("root", "a", None)]


def test_positions_link_children_to_parents():
    nodes = {r[3]: r for r in N.json_nodes([("K", '{"L": [{"M": [{"x": 1}, {"x": 2}]}, {"M": {"x": 3}}]}')])}
    assert len(nodes) == 6
    for at, r in nodes.items():
        assert r[4] is None or r[4] in nodes
    assert [(r[2], r[5], r[6]) for _, r in sorted(nodes.items())] == [("root", 0, 0), ("L", 0, 1), ("M", 0, 2), ("M", 1, 2), ("L", 1, 1), ("M", 0, 2)]


def test_plain_values_in_lists_are_rows(spark, rows):
    text = '{"Id": "p", "T": ["a", "b"], "M": [1, {"Id": "c"}, null, [true, 2.5], "[\\"s\\"]"]}'
    got = [(r[2], r[3], r[4], r[5], r[6], r[8], dict(r[9]).get("#value"), dict(r[10]).get("#value")) for r in sorted(N.json_nodes([("K", text)]), key=lambda r: r[3]) if r[7] is None]
    assert got == [
        ("T", "0.0.0", "0", 0, 1, "p", "a", "string"), ("T", "0.0.1", "0", 1, 1, "p", "b", "string"), ("M", "0.1.0", "0", 0, 1, "p", "1", "bigint"), ("M", "0.1.2", "0", 2, 1, "p", None, None),
        ("M", "0.1.3.0", "0", 0, 1, "p", "true", "boolean"), ("M", "0.1.3.1", "0", 1, 1, "p", "2.5", "double"), ("M", "0.1.4.0", "0", 0, 1, "p", "s", "string"),
    ]
    nodes = N.flatten(spark.createDataFrame([("1", "k", text, None, None, None), ("2", "k", '["x"]', None, None, None)], SCHEMA), values=True)
    assert rows(N.merged_schema(nodes).where("field = '#value'").select("entity", "kind", "n")) == [("M", "string", 4), ("T", "string", 2), ("root", "string", 1)]
    assert rows(N.entity_table(nodes, "T", {"#value": "string"}).select("parent", "ordinal", "`#value`")) == [("0", 0, "a"), ("0", 1, "b")]
    assert rows(N.Tables(nodes).identified()) == [("1", "M", "c", "p"), ("1", "root", "p", "1")]


def test_xml_elements():
    text = '<?xml version="1.0" encoding="UTF-8"?><a xmlns:x="u" x:id="1" bwb-id="no"><!-- c --><b>t<c id="2"/></b><x:d id=""/></a>'
    assert ids(text, N.xml_nodes) == [("a", "1", None), ("b", None, "1"), ("c", "2", "1"), ("d", "", "1")]
    for bad in ("<a><b></a>", "", "<a/><b/>", "&x;", "<a>&nbsp;</a>"):
        assert ids(bad, N.xml_nodes) == []


def test_mixed_xml_keeps_all_text():
    text = '<lid id="1"><al>Artikel <nadruk>5</nadruk> geldt <!-- c -->niet <nadruk>a<sup>2</sup>b</nadruk>\n<br/> hier.</al>\n</lid>'
    got = [(r[2], r[4], r[5], {k: v for k, v in r[9] if k[0] == "#"}, {k: v for k, v in r[10] if k[0] == "#"}) for r in sorted(N.xml_nodes([("K", text)]), key=lambda r: r[3])]
    assert [x[:4] for x in got] == [
        ("lid", None, 0, {}), ("al", "0", 0, {"#text": "Artikel"}), ("nadruk", "0.0", 0, {"#text": "5", "#tail": "geldt niet"}), ("nadruk", "0.0", 1, {"#text": "a"}),
        ("sup", "0.0.1", 0, {"#text": "2", "#tail": "b"}), ("br", "0.0", 2, {"#tail": "hier."}),
    ]
    assert all(kinds == dict.fromkeys(fields, "string") for *_, fields, kinds in got)


def test_tables_schema_and_edges_of_input(spark, rows):
    data = [
        ("1", "k", '{"Id": "p", "n": 1, "L": [{"Id": "c", "n": 2.5, "node": "q"}, {"Id": "d", "n": "z"}]}', None),
        ("2", "k", None, '<a id="x"><b id="y"/></a>'), ("3", "eu-celex-html", None, '<a id="x"/>'), (None, "k", '{"Id": "p"}', None), ("4", None, None, '<a id="z"/>'), ("5", "k", "{", "<"), ("1", "k", '{"Id": "p", "n": 1}', ""),
    ]
    df = spark.createDataFrame([(*r, "clash", "clash") for r in data], SCHEMA)
    nodes = N.flatten(df, xml_where="not (kind <=> 'eu-celex-html')")
    assert rows(N.Tables(nodes).identified()) == [("1", "L", "c", "p"), ("1", "L", "d", "p"), ("1", "root", "p", "1"), ("2", "a", "x", "2"), ("2", "b", "y", "x"), ("4", "a", "z", "4"), (None, "root", "p", None)]
    kinds = {(r.form, r.entity, r.field): r.kind for r in N.merged_schema(nodes).collect()}
    assert kinds[("json", "root", "n")] == "bigint" and kinds[("json", "L", "n")] == "string" and kinds[("json", "L", "node")] == "string"
    flat = N.entity_table(nodes, "L", {"n": "double", "node": "string"})
    assert rows(flat.select("id", "n", "node_", "ordinal")) == [("c", 2.5, "q", 0), ("d", None, None, 1)]
    assert N.Tables(N.flatten(df.limit(0))).identified().count() == 0


def test_tables_of_every_kind_have_all_fields(spark, rows, tmp_path):
    data = [
        ("1", "k", '{"Id": "p", "x": 1, "lid": [{"Id": "c", "id": "C", "Onderwerp": "o", "n": 1}, {"n": 2.5, "T": ["t", "u"], "E": {}}], "m": [{"v": 1}, {"v": true}, {"v": 0.5}]}', None, None, None),
        ("2", "k", None, '<a><lid id="y" status="s"><lidnr>1.</lidnr><al>t <b>u</b> v</al></lid></a>', None, None),
    ]
    nodes = N.flatten(spark.createDataFrame(data, SCHEMA), values=True)
    tables = N.Tables(nodes)
    assert set(tables.kinds()) == {("json", e) for e in ("root", "lid", "T", "E", "m")} | {("xml", e) for e in ("a", "lid", "lidnr", "al", "b")}
    got = {k: tables.of_kind(*k) for k in tables.kinds()}
    assert tables.of_kind("json", "none").columns == ["raw_key", "node", "parent", "ordinal", "depth", "id"]
    assert rows(tables.children()) == [("json", "lid", "E"), ("json", "lid", "T"), ("json", "root", "lid"), ("json", "root", "m"), ("xml", "a", "lid"), ("xml", "al", "b"), ("xml", "lid", "al"), ("xml", "lid", "lidnr")]
    for k, df in enumerate(got.values()):
        df.write.parquet(f"{tmp_path}/{k}")
    assert rows(got["json", "lid"].select("id", "Id_", "id__", "Onderwerp", "n", "ordinal")) == [("c", "c", "C", "o", 1.0, 0), (None, None, None, None, 2.5, 1)]
    assert got["xml", "lid"].columns == ["raw_key", "node", "parent", "ordinal", "depth", "id", "status"]
    assert rows(got["json", "m"].select("v")) == [("0.5",), ("1",), ("true",)]
    flat = tables.in_one()
    assert rows(flat.where("entity in ('T', 'E', 'lidnr', 'b')").select("entity", "parent", "ordinal", "field", "kind", "value")) == [
        ("E", "0.0.1", 0, None, None, None), ("T", "0.0.1", 0, "#value", "string", "t"), ("T", "0.0.1", 1, "#value", "string", "u"),
        ("b", "0.0.1", 0, "#tail", "string", "v"), ("b", "0.0.1", 0, "#text", "string", "u"), ("lidnr", "0.0", 0, "#text", "string", "1."),
    ]
    assert rows(flat.where("field in ('x', 'n')").select("field", "value", "bigint_value", "double_value", "boolean_value")) == [("n", "1", None, 1.0, None), ("n", "2.5", None, 2.5, None), ("x", "1", 1, None, None)]


def test_long_and_deep_payloads(spark):
    deep = "x"
    for _ in range(200):
        deep = {"Id": "a", "L": [deep]}
    long = json.dumps({"Id": "r", "L": [{"Id": i} for i in range(20000)]})
    df = spark.createDataFrame([("d", "k", json.dumps(deep), None, None, None), ("l", "k", long, None, None, None)], SCHEMA)
    assert N.flatten(df).groupBy("raw_key").count().orderBy("raw_key").collect() == [("d", 200), ("l", 20001)]


def _rebuilt(nodes):
    """The JSON texts' values from the rows of their objects."""
    below = {}
    for n in nodes:
        below.setdefault((n["raw_key"], n["parent"]), []).append(n)

    def plain(n):
        if n["kinds"].get("#value") is not None:
            return cast(n["fields"]["#value"], n["kinds"]["#value"])
        out = {f: cast(v, n["kinds"][f]) for f, v in n["fields"].items()}
        for f, kind in n["kinds"].items():
            if kind in (N.OBJECT, N.ARRAY):
                own = sorted((c for c in below.get((n["raw_key"], n["node"]), []) if c["entity"] == f), key=lambda c: [int(x) for x in c["node"].split(".")])
                out[f] = plain(own[0]) if kind == N.OBJECT else listed(own, len(n["node"].split(".")) + 1)
        return out

    def listed(own, depth):
        out, groups = [], {}
        for c in own:
            groups.setdefault(c["node"].split(".")[depth], []).append(c)
        for g in groups.values():
            inner = len(g) > 1 or len(g[0]["node"].split(".")) > depth + 1
            out.append(listed(g, depth + 1) if inner else plain(g[0]))
        return out

    def cast(text, kind):
        return {"bigint": int, "double": float, "boolean": lambda t: t == "true", "string": str}[kind](text)

    return {n["raw_key"]: plain(n) for n in nodes if n["parent"] is None}


_VALUES = st.recursive(st.one_of(st.integers(-99, 99), st.booleans(), st.sampled_from(["a", "é x", "", "{no"])), lambda x: st.one_of(st.lists(x, min_size=1, max_size=3), st.dictionaries(st.sampled_from("abcI"), x, max_size=3)), max_leaves=12)


@settings(max_examples=200, deadline=None)
@given(st.lists(st.dictionaries(st.sampled_from(["Id", "L", "M", "x"]), _VALUES, max_size=4), min_size=1, max_size=4))
def test_exact_round_trip(objects):
    names = [f.split()[0] for f in N.NODE_SCHEMA.split(", ")]
    nodes = [dict(zip(names, r)) | {"fields": dict(r[9]), "kinds": dict(r[10])} for r in N.json_nodes([(str(i), json.dumps(x)) for i, x in enumerate(objects)])]
    assert _rebuilt(nodes) == {str(i): x for i, x in enumerate(objects)}
