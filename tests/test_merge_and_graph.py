from pyspark.sql import functions as F

from stelwerk.operators import graph as G
from stelwerk.operators import merge as M

NODE = "_key string, labels array<string>, props struct<a:string,b:string>, seq int"


def test_first_and_last(spark, rows):
    df = spark.createDataFrame([("k", 1, "a"), ("k", 2, "b"), ("k", None, "c"), (None, 1, "d"), ("j", 5, "e"), ("j", 5, "e")], "k string, n int, v string")
    assert rows(M.last_per_key(df, ["k"], ["n"])) == [("j", 5, "e"), ("k", 2, "b"), (None, 1, "d")]
    assert rows(M.first_per_key(df, ["k"], ["n"])) == [("j", 5, "e"), ("k", None, "c"), (None, 1, "d")]
    assert M.last_per_key(df.limit(0), ["k"], ["n"]).count() == 0
    assert rows(M.ordered_distinct(spark.createDataFrame([("b", 1), ("a", 2), ("b", 3)], "v string, p int"), "v", "p")) == [("a", 2), ("b", 1)]


def test_upsert_merges_fields(spark):
    old = spark.createDataFrame([("1", ["x"], ("a", "b"), 0), ("2", ["x"], ("a", None), 0)], NODE)
    new = spark.createDataFrame([("2", ["y"], (None, "n"), 1), ("2", ["z"], (None, "m"), 2), ("3", None, ("c", None), 3), (None, None, None, 4)], NODE)
    got = {r._key: (r.labels, tuple(r.props), r.created) for r in M.upsert(old, new, "_key", ["seq"]).collect()}
    assert got == {"1": (["x"], ("a", "b"), False), "2": (["z"], ("a", "m"), False), "3": (None, ("c", None), True)}


def test_insert_if_absent(spark, rows):
    new = spark.createDataFrame([("a", "b"), ("a", "b"), ("c", "d")], "f string, t string")
    old = spark.createDataFrame([("c", "d"), ("c", "d")], "f string, t string")
    assert rows(M.new_rows(new, old, ["f", "t"])) == [("a", "b")]


def test_updates_meet_only_what_is_there(spark):
    old = spark.createDataFrame([("1", ["x"], ("a", "b"), 0), ("2", ["x"], ("a", None), 0)], NODE)
    new = spark.createDataFrame([("2", ["y"], (None, "n"), 1), ("3", None, ("c", None), 3)], NODE)
    got = {r._key: (r.labels, tuple(r.props), r.updated) for r in M.update(old, new, "_key", ["seq"]).collect()}
    assert got == {"1": (["x"], ("a", "b"), False), "2": (["y"], ("a", "n"), True)}


def test_store_lays_deltas_over_the_base(spark, rows, tmp_path):
    store = M.Store(spark, f"file://{tmp_path}")
    edge = "_key string, _to string, confidence double"
    assert store.upsert("e", spark.createDataFrame([("a", "x", 0.5), ("b", "x", 0.5)], edge)) == 2
    assert store.upsert("e", spark.createDataFrame([("b", "x", 0.9), ("c", "y", None)], edge)) == 1
    assert store.upsert("e", spark.createDataFrame([("a", None)], "_key string, confidence double")) == 0  # null is a value
    want = [("a", "x", None), ("b", "x", 0.9), ("c", "y", None)]
    assert rows(store.read("e")) == want
    store.compact("e")
    assert rows(store.read("e")) == want and len(store._parts("e")) == 1
    assert store.update("e", spark.createDataFrame([("c", "z", 0.1), ("new", "z", 0.1)], edge)) == 1
    assert rows(store.read("e")) == [("a", "x", None), ("b", "x", 0.9), ("c", "z", 0.1)]
    assert store.append_new("e", spark.createDataFrame([("c", "q", 0.3), ("d", "q", 0.3), ("d", "q", 0.3), (None, "q", 1.0)], edge), ["_key"]) == 2
    assert rows(store.read("e").where("_key = 'c'")) == [("c", "z", 0.1)] and store.keys("e").count() == 5
    ties = spark.createDataFrame([("t", str(i), float(i)) for i in range(20)], edge)
    picked = {store.upsert(t, ties.orderBy("_to", ascending=t == "t1")) or store.read(t).first()._to for t in ("t1", "t2")} | {store.read(t).first()._to for t in ("t1", "t2")}
    assert len(picked - {1}) == 1
    assert store.update("none", ties) == 0
    with __import__("pytest").raises(FileNotFoundError):
        store.read("none")
    node = "_key string, props struct<a:string,b:string>"
    store.write("n", spark.createDataFrame([("1", ("a", "b")), ("2", None)], node))
    store.upsert("n", spark.createDataFrame([("1", (None, "n", "c")), ("3", None)], "_key string, props struct<a:string,b:string,c:string>"))
    assert {r._key: r.props and tuple(r.props) for r in store.read("n").collect()} == {"1": ("a", "n", "c"), "2": None, "3": None}


def test_judgments_by_key_then_by_ecli(spark, rows):
    j = spark.createDataFrame([("ecli_nl_1", "judgments/ecli_nl_1", ("ECLI:NL:1",)), ("other", "judgments/other", ("ECLI:NL:2",)), ("p", "judgments/p", ("ECLI:NL:2",))], "_key string, _id string, props struct<ecli:string>")
    asked = spark.createDataFrame([("ECLI:NL:1",), ("ECLI:NL:2",), ("ECLI:NL:3",), (None,), ("ECLI:NL:1",)], "ecli string")
    assert rows(G.find_judgments(j, asked)) == [("ECLI:NL:1", "judgments/ecli_nl_1"), ("ECLI:NL:2", "judgments/other")]
    said = spark.createDataFrame([("judgments/other", "instrument_articles/x_1", "MENTIONS_ARTICLE")], "_from string, _to string, relation string")
    strict = spark.createDataFrame([("instrument_articles/x_1", "instruments/x", "PART_OF_INSTRUMENT")], "_from string, _to string, relation string")
    nodes = spark.createDataFrame([("instrument_articles/x_1", "Art. 1")], "_id string, display_name string")
    assert rows(G.judgment_detail(asked, j, strict, said, nodes)) == [("ECLI:NL:1", "judgments/ecli_nl_1", None, None, None, 0), ("ECLI:NL:2", "judgments/other", "instrument_articles/x_1", "Art. 1", "instruments/x", 1)]


def test_citations_from_edges_and_articles(spark, rows):
    import json

    from stelwerk.plans import serve

    a, b = "instrument_articles/w_1", "instrument_articles/w_2"
    entry = "citations array<struct<start:int,end:int,text:string,target_bwb_id:string,target_article_number:string,confidence:double>>"
    articles = spark.createDataFrame([(a, "Art. 1", [(1, 2, "x", "W", "2", 0.9), (5, 6, " 2 ", "W", "2", 0.9), (7, 8, "9", "W", "9", 0.9), (7, 8, "9", None, "2", 0.9)]), (b, "Art. 2", [])], f"_id string, display_name string, {entry}")
    semantic = spark.createDataFrame([(a, b, "REFERS_TO_ARTICLE", 0.5, (1, 2, " x ")), (a, "gone/1", "REFERS_TO_ARTICLE", 0.5, (1, 2, "x")), (a, b, "OTHER", 0.5, (3, 4, "x")), ("judgments/j", a, "MENTIONS_ARTICLE", None, None)], "_from string, _to string, relation string, confidence double, meta struct<start_pos:bigint,end_pos:bigint,text:string>")
    nodes = spark.createDataFrame([(a, "Art. 1"), (b, "Art. 2"), ("judgments/j", "Zaak"), ("instruments/w", "Wet")], "_id string, display_name string")
    got = G.article_citations(articles, semantic, nodes)
    assert rows(got) == [(a, b, "Art. 2", 1, 2, "x", 0.5), (a, b, "Art. 2", 5, 6, "2", 0.9)]
    strict = spark.createDataFrame([(a, "instruments/w", "PART_OF_INSTRUMENT")], "_from string, _to string, relation string")
    asked = spark.createDataFrame([(a,), (b,), ("instrument_articles/none",)], "_id string")
    docs = {r._id: json.loads(r.payload) for r in serve.article_document(asked, articles, strict, semantic, nodes, got).collect()}
    assert set(docs) == {a, b} and docs[a]["instrument_name"] == "Wet" and docs[a]["judgment_count"] == 1 and docs[a]["mentioned_by"] == [{"id": "judgments/j", "name": "Zaak"}]
    assert [c["start"] for c in docs[a]["citations"]] == [1, 5] and (docs[b]["citation_count"], docs[b]["mention_count"]) == (0, 0)
    assert serve.descriptor()["name"] == "stelwerk" and "seed" in serve.descriptor()["stages"]


def test_lookups(spark, rows):
    topics = spark.createDataFrame([("b", ("topic:x", "y")), ("a", ("topic:z", "x"))], "_key string, props struct<id:string,slug:string>")
    assert rows(G.find_topic(topics, "topic:x", "x").select("_key")) == [("a",)] and G.find_topic(topics, None, None).count() == 0
    acts = spark.createDataFrame([("b", ("c1",)), ("a", ("c1",)), ("d", (None,))], "_key string, props struct<config_id:string>")
    assert rows(G.find_instrument(acts, "c1").select("_key")) == [("a",)]
    assert rows(G.with_key(acts, "instruments", F.when(F.col("_key") == "b", "B")).select("_key", "_id")) == [("B", "instruments/B")]


def test_store_snapshots_are_idempotent(spark, tmp_path):
    store = M.Store(spark, f"file://{tmp_path}")
    new = spark.createDataFrame([("1", ["x"], ("a", "b"), 0), ("1", ["y"], ("c", None), 1), ("2", [], ("d", None), 0)], NODE)
    assert not store.exists("t") and store.upsert("t", new, "_key", ["seq"]) == 2
    first = sorted(map(str, store.read("t").collect()))
    assert store.upsert("t", new, "_key", ["seq"]) == 0
    assert [x.replace("'b'", "None") for x in sorted(map(str, store.read("t").collect()))] == first
    edges = spark.createDataFrame([("k", "a", "b"), ("k", "a", "b")], "_key string, _from string, _to string")
    assert store.append_new("e", edges, ["_key"]) == 1 and store.append_new("e", edges, ["_key"]) == 0


def test_neighbours_name_the_other_end(spark, rows):
    edges = spark.createDataFrame([("a/1", "b/1", "R", True, None), ("b/1", "b/1", "S", False, 0.5), ("a/1", "gone", "R", True, None), (None, "a/1", "R", True, None)], "_from string, _to string, relation string, strict boolean, confidence double")
    nodes = spark.createDataFrame([("a/1", "A"), ("b/1", "B")], "_id string, display_name string")
    assert rows(G.neighbours(edges, nodes)) == [("a/1", "b/1", "B", "R", "outbound", True, None), ("b/1", "a/1", "A", "R", "inbound", True, None), ("b/1", "b/1", "B", "S", "inbound", False, 0.5), ("b/1", "b/1", "B", "S", "outbound", False, 0.5), ("gone", "a/1", "A", "R", "inbound", True, None)]
    assert G.neighbours(edges, nodes, nodes.where("_id = 'a/1'")).count() == 1


def test_served_neighbourhood(spark):
    import json

    from stelwerk.plans import serve

    cols = "_from string, _to string, relation string, strict boolean, confidence double"
    strict, semantic = spark.createDataFrame([("a/1", "b/1", "R", True, None)], cols), spark.createDataFrame([("b/1", "a/1", "S", False, 0.5)], cols)
    view = spark.createDataFrame([("a/1", "A"), ("b/1", "B")], "_id string, display_name string")
    asked = spark.createDataFrame([("a/1",), ("c/1",)], "_id string")
    got = {r._id: (r.n_strict, r.n_semantic, [x["direction"] for x in json.loads(r.neighbours)]) for r in serve.neighbourhood(asked, strict, semantic, view).collect()}
    assert got == {"a/1": (1, 1, ["inbound", "outbound"]), "c/1": (0, 0, [])}


def test_article_detail_in_both_directions(spark, rows):
    articles = spark.createDataFrame([("instrument_articles/x_1", "Art. 1"), ("instrument_articles/x_2", "Art. 2"), ("instrument_articles/x_3", "Art. 3")], "_id string, display_name string")
    strict = spark.createDataFrame([("instrument_articles/x_1", "instruments/x", "PART_OF_INSTRUMENT"), ("instruments/x", "instrument_articles/x_2", "PART_OF_INSTRUMENT")], "_from string, _to string, relation string")
    said = spark.createDataFrame([("judgments/j", "instrument_articles/x_1", "MENTIONS_ARTICLE"), ("judgments/j", "instrument_articles/x_1", "MENTIONS_ARTICLE"), ("publications/p", "instrument_articles/x_1", "MENTIONS_ARTICLE"), ("instrument_articles/x_1", "instrument_articles/x_2", "REFERS_TO_ARTICLE")], "_from string, _to string, relation string")
    nodes = articles.unionByName(spark.createDataFrame([("instruments/x", "X")], "_id string, display_name string"))
    assert rows(G.article_detail(articles, strict, said, nodes)) == [("instrument_articles/x_1", "Art. 1", "instruments/x", "X", 2, 1, 1), ("instrument_articles/x_2", "Art. 2", "instruments/x", "X", 0, 0, 0), ("instrument_articles/x_3", "Art. 3", None, None, 0, 0, 0)]


def test_resolution_order_and_last_hit_wins(spark, rows):
    hits = spark.createDataFrame([("instruments/d", "article", "32010L0013", None, "6", 0, 0, 0.85), ("instruments/d", "instrument", "32010L0013", None, None, 3, 9, 0.7), ("instruments/d", "article", None, "BWBR1", "5", 5, 0, 0.95), ("instruments/d", "instrument", None, "", None, 6, 0, 0.1), ("instruments/d", "instrument", None, "BWBR9", None, 6, 0, 0.1)], "doc string, kind string, celex string, bwb_id string, article_number string, seq int, start int, confidence double")
    nodes = spark.createDataFrame([("instruments/32010l0013",), ("instrument_articles/bwbr1_5",)], "_id string")
    got = G.semantic_edges(G.resolve(hits, nodes).withColumns({"raw_match": F.lit("m"), "snippet": F.lit("s")}), "MENTIONS_ARTICLE", "src")
    assert rows(got.select("_key", "confidence")) == [("d__32010l0013__MENTIONS_ARTICLE", 0.7), ("d__bwbr1_5__MENTIONS_ARTICLE", 0.95)]


def test_citations_of_both_kinds(spark, rows):
    schema = "source_id string, target_id string, start bigint, end bigint, text string, confidence double"
    a = spark.createDataFrame([("s", "t", 1, 2, "x", 0.5)], schema)
    b = spark.createDataFrame([("s", "t", 1, 2, "x", 0.9), ("s", "t", 1, 2, None, 0.9), ("s", "t", 1, 2, None, 0.4)], schema)
    assert rows(G.merged_citations(a, b)) == [("s", "t", 1, 2, "x", 0.5), ("s", "t", 1, 2, None, 0.9)]


def test_collections(spark):
    import pytest

    assert G.checked_collection("topics") == "topics"
    with pytest.raises(ValueError):
        G.checked_collection("raw_sources")
