import json
import threading
from http.server import BaseHTTPRequestHandler, HTTPServer

import pytest

from stelwerk.plans import engine, linkers, normalize
from stelwerk.sources import http, profiles, raw, versions
from stelwerk.streaming import ingest

LAW = """<t:toestand xmlns:t="urn:x"><t:wetgeving>
<t:artikel><t:kop><t:label>Artikel</t:label><t:nr>1</t:nr></t:kop><t:lid><t:lidnr>1</t:lidnr><t:al>Zie <t:nadruk>artikel</t:nadruk> 2 en 3.</t:al><t:al>Slot.</t:al></t:lid>
  <t:artikel label="Artikel: 2"><t:al>Binnen.</t:al></t:artikel></t:artikel>
<t:bijlage label="Artikel 9a"><t:al>Een</t:al><t:al>Twee</t:al></t:bijlage><t:artikel><t:al>geen nummer</t:al></t:artikel><t:artikel label="Artikel 4"/></t:wetgeving></t:toestand>"""
PROFILE = {
    "topic": {"id": "topic:strafrecht", "slug": "strafrecht", "name": "Strafrecht"}, "code_aliases": {"Sr": "BWBR0001854"}, "instrument_aliases": {"Wetboek van Strafrecht": "BWBR0001854", "Akte": {"celex": "32010L0013"}},
    "nl_instruments": [{"id": "nl:Sr", "bwb_id": "BWBR0001854", "title": "Wetboek van Strafrecht"}], "filters": {"tk": {"title_contains": ["straf"]}, "rechtspraak": {"search_terms": ["strafzaak"]}, "eurlex": {"celex_ids": ["32010L0013"]}},
}


def landing(spark):
    data = [
        ("b1", "bwb", "bwb-toestand-xml", None, "2020-01-01 00:00:00", None, LAW, {"bwb_id": "BWBR0001854"}), ("b2", "bwb", "bwb-toestand-xml", "BWBR2", "2020-01-01 00:00:00", None, "<broken", {}), ("b3", "bwb", "bwb-toestand-xml", None, "2020-01-01 00:00:00", None, LAW, {}),
        ("z1", "tk", "tk-zaak", "Z1", "2020-01-01 00:00:00", json.dumps({"Id": " ", "ZaakId": "Z1", "Titel": "", "ZaakTitel": "Strafzaken"}), None, {}), ("z2", "tk", "tk-zaak", None, "2020-01-02 00:00:00", "{", None, {}),
        ("d1", "tk", "tk-documentversie", "D1", "2020-01-01 00:00:00", json.dumps({"Id": "D1", "ZaakId": "Z1", "Titel": "Wijziging van artikel 1 Sr", "Tekst": {"x": ["Wetboek van Strafrecht"]}}), None, {}),
        ("d2", "tk", "tk-documentversie", "D2", "2020-01-01 00:00:00", json.dumps({"Id": "D2", "ZaakId": "weg"}), None, {}), ("r1", "rechtspraak", "rs-content", None, "2020-01-01 00:00:00", None, "<u>strafzaak art. 1 Sr en art. 1 Sr</u>", {"ecli": "ECLI:NL:HR:2019:1"}),
        ("r2", "rechtspraak", "rs-index", None, "2020-01-01 00:00:00", None, "<i/>", {}), ("e1", "eurlex", "eu-celex-html", None, "2020-01-01 00:00:00", None, "<p>Artikel 6 van Richtlijn 2010/13/EU</p>", {"celex": "32010L0013", "lang": "NL"}),
        ("e0", "eurlex", "eu-celex-html", None, "2019-01-01 00:00:00", None, "oud", {"celex": "32010L0013"}),
    ]
    return spark.createDataFrame(data, raw.SCHEMA.replace("fetched_at timestamp", "fetched_at string")).withColumn("fetched_at", __import__("pyspark.sql.functions", fromlist=["x"]).to_timestamp("fetched_at"))


def test_articles_of_a_law():
    assert list(normalize.article_rows(LAW)) == [(0, "1", "1. Zie artikel 2 en 3. Slot."), (1, "2", "Binnen."), (2, "9a", "Een\nTwee")]
    assert list(normalize.article_rows("<a>")) == list(normalize.article_rows(None)) == list(normalize.article_rows("")) == []


def test_normalizers(spark, rows):
    r = landing(spark)
    laws = normalize.laws(r)
    assert rows(laws["instruments"].select("_id")) == [("instruments/bwbr0001854",), ("instruments/bwbr2",)]
    assert rows(laws["instrument_articles"].select("_key", "props.display_name")) == [("bwbr0001854_1", "Art. 1"), ("bwbr0001854_2", "Art. 2"), ("bwbr0001854_9a", "Art. 9a")]
    assert laws["edges_strict"].count() == 3
    tk = normalize.parliament(r, PROFILE)
    assert rows(tk["procedures"].select("_key", "labels", "props.title")) == [("z1", ["TK", "Strafrecht"], "Strafzaken")]
    assert rows(tk["edges_strict"].select("_from", "_to")) == [("publications/d1", "procedures/z1")]
    assert rows(tk["edges_semantic"].select("_key")) == [("z1__strafrecht__RELATED_TOPIC",)]
    eu = normalize.eu_acts(r, PROFILE)["instruments"]
    assert rows(eu.select("_key", "labels", "props.lang")) == [("32010l0013", ["EU", "Strafrecht"], "NL")]
    assert rows(normalize.judgments(r, PROFILE)["judgments"].select("_key", "labels")) == [("ecli_nl_hr_2019_1", ["Rechtspraak", "Strafrecht"])]
    for name in ("parliament", "judgments", "eu_acts"):
        for df in getattr(normalize, name)(r.limit(0), {}).values():
            assert df.count() == 0


def test_engine_twice_and_skips(spark, rows, tmp_path):
    root = f"file://{tmp_path}/store"
    first = engine.run(spark, landing(spark), root, PROFILE)
    assert first["link_parliament"] == {"edges_semantic": 2} and first["link_judgments"] == {"edges_semantic": 1} and first["link_laws"] == {"edges_semantic": 1}
    again = engine.run(spark, landing(spark), root, PROFILE)
    assert all(n == 0 for made in again.values() for n in made.values())
    store = engine.Store(spark, root)
    edges = store.read("edges_semantic")
    assert rows(edges.where("source = 'eu-article-linker'").select("_key", "confidence")) == [("32010l0013__32010l0013__MENTIONS_ARTICLE", 0.7)]
    assert store.read("instruments").where("_key = 'bwbr0001854'").select("props.config_id").first()[0] == "nl:Sr"
    assert "seed" not in engine.run(spark, landing(spark), f"file://{tmp_path}/b", {}, stages=("seed", "judgments"), skip=("seed",))
    with pytest.raises(ValueError):
        engine.run(spark, landing(spark), root, PROFILE, stages=("nope",))
    with pytest.raises(ValueError):
        engine.seed_rows(spark, {"topic": {"id": "x"}})


def test_edges_and_citations_change_with_their_sources(spark, rows, tmp_path):
    root = f"file://{tmp_path}/store"
    engine.run(spark, landing(spark), root, PROFILE)
    engine.run(spark, landing(spark), root, PROFILE | {"bwb": {"confidence_default": "0.5"}}, stages=("link_laws", "store_citations"))
    store = engine.Store(spark, root)
    assert rows(store.read("edges_semantic").where("relation = 'REFERS_TO_ARTICLE'").select("confidence")) == [(0.5,)]
    articles = {r._key: r.props for r in store.read("instrument_articles").collect()}
    assert [c.target_article_number for c in articles["bwbr0001854_1"].citations] == ["2", "3"] and articles["bwbr0001854_9a"].citations == []
    assert articles["bwbr0001854_1"].text.startswith("1. Zie") and articles["bwbr0001854_1"].display_name == "Art. 1"
    moved = {**PROFILE, "nl_instruments": [{"id": "nl:Sr", "bwb_id": "BWBR777", "title": "Ander nummer"}], "topic": {"id": "topic:strafrecht", "slug": "recht"}}
    assert engine.run(spark, landing(spark), root, moved, stages=("seed",))["seed"] == {"topics": 0, "instruments": 0, "edges_semantic": 0}
    assert store.read("instruments").where("props.config_id = 'nl:Sr'").select("_key", "props.bwb_id").collect() == [("bwbr0001854", "BWBR777")]


def test_texts_to_search(spark):
    df = spark.createDataFrame([("a", " een ", None, "tekst", '{"x": ["aa", "bb"], "y": "cc"}'), ("b", None, None, None, "{}")], "k string, title string, summary string, text string, raw string")
    docs = df.select("k", __import__("pyspark.sql.functions", fromlist=["x"]).struct("title", "summary", "text", "raw").alias("props"))
    own = [linkers.prop(docs, n) for n in ("title", "summary", "body", "text")]
    full = docs.select(linkers.capped_text(own, linkers.X.json_strings(linkers.prop(docs, "raw")), 40000).alias("t")).collect()
    assert [r.t for r in full] == ["een\ntekst\naa\nbb\ncc", None]
    assert docs.select(linkers.capped_text(own, linkers.X.json_strings(linkers.prop(docs, "raw")), 11).alias("t")).first().t == "een\ntekst\naa\nbb"
    j = spark.createDataFrame([((" ", "tekst"),), (("<x/>", "tekst"),), ((None, " "),)], "props struct<raw_xml:string,text:string>")
    assert [r.t for r in j.select(linkers.judgment_text(j).alias("t")).collect()] == ["tekst", "<x/>", None]
    assert [r.ecli for r in linkers.recent_eclis(landing(spark), "2019-01-01").collect()] == ["ECLI:NL:HR:2019:1"] and linkers.recent_eclis(landing(spark), "2031-01-01").count() == 0


def test_citations_are_stored_even_if_none(spark):
    df = spark.createDataFrame([("instrument_articles/x_1", ("Zie artikel 15.", "BWBR1")), ("instrument_articles/x_2", (None, "BWBR1"))], "_id string, props struct<text:string,bwb_id:string>")
    got = {r._id: r.citations for r in linkers.stored_citations(df).collect()}
    assert got["instrument_articles/x_1"][0].target_article_number == "15" and got["instrument_articles/x_2"] == []


def test_links_by_names(spark, rows):
    docs = spark.createDataFrame([("publications/p", "Zie artikel 5 van de Wet zware lasten en art. 7a Wzl; artikel 9 Onbekend"), ("publications/q", None)], "_id string, t string")
    docs = docs.unionByName(spark.createDataFrame([("publications/r", "Artikel 5 van de Regeling, houdende (nadere) regels over het lange en brede vervoer te water. Artikel 7 " + "van" + " " * 300 + "de Wzl"), ("publications/s", "art. 5 Wet zware; lasten en art. 5 xWzl")], "_id string, t string"))
    acts = spark.createDataFrame([(("BWBR8", "Regeling houdende nadere regels over het lange en brede vervoer te water", None),), (("BWBR1", "Wet zware", None),), (("BWBR2", "Wet zware lasten", "Wzl"),), (("BWBR3", "Dubbel", None),), (("BWBR4", "Dubbel", None),)], "props struct<bwb_id:string,title:string,short_title:string>")
    nodes = spark.createDataFrame([(f"instrument_articles/{k}",) for k in ("bwbr2_5", "bwbr2_7a", "bwbr8_5", "bwbr2_7", "bwbr1_5")], "_id string")
    got = linkers.link_by_names(docs, "t", linkers.act_names(acts), nodes)
    assert rows(got.select("_from", "_to")) == [(f"publications/{a}", f"instrument_articles/{b}") for a, b in (("p", "bwbr2_5"), ("p", "bwbr2_7a"), ("r", "bwbr2_7"), ("r", "bwbr8_5"), ("s", "bwbr1_5"))]
    assert linkers.link_by_names(docs, "t", linkers.act_names(acts).limit(0), nodes).count() == 0


def test_judgments_of_no_ecli_are_none(spark):
    j = normalize.judgments(landing(spark), PROFILE)["judgments"]
    nodes = spark.createDataFrame([("instrument_articles/bwbr0001854_1",)], "_id string")
    none = spark.createDataFrame([], "ecli string")
    assert linkers.link_judgments(j, nodes, PROFILE).count() == 1 and linkers.link_judgments(j, nodes, PROFILE, none).count() == 0


def test_versions(spark):
    xml = """<r xmlns:x="u"><x:record><identifier>B1</identifier><locatie_toestand>u1</locatie_toestand><geldigheidsperiode_einddatum>2010-01-01</geldigheidsperiode_einddatum></x:record>
    <x:record><identifier>i</identifier><x:bwb-id>B1</x:bwb-id><locatie_toestand>u2</locatie_toestand><geldigheidsperiode_einddatum>9999-12-31</geldigheidsperiode_einddatum></x:record>
    <x:record><x:bwb-id>B1</x:bwb-id><locatie_toestand>u3</locatie_toestand><geldigheidsperiode_einddatum>9999-12-31</geldigheidsperiode_einddatum></x:record><x:record><x:bwb-id>B1</x:bwb-id></x:record>
    <x:record><x:bwb-id>B2</x:bwb-id><locatie_toestand>u4</locatie_toestand><geldigheidsperiode_einddatum>onbekend</geldigheidsperiode_einddatum></x:record>
    <x:record><x:bwb-id>B2</x:bwb-id><locatie_toestand>u5</locatie_toestand><geldigheidsperiode_einddatum>2001-01-01</geldigheidsperiode_einddatum></x:record></r>"""
    df = spark.createDataFrame([(xml,), ("<broken",), (None,)], "payload string")
    got = versions.parse(df)
    assert got.count() == 5
    assert {r.bwb_id: r.locatie_toestand for r in versions.latest(got).collect()} == {"B1": "u2", "B2": "u5"}


def test_profiles(tmp_path, monkeypatch):
    assert "visserij" in profiles.names() and profiles.load("visserij")["topic"]["slug"] == "visserij"
    (tmp_path / "bad.yml").write_text("- 1")
    with pytest.raises(ValueError):
        profiles.load(path=tmp_path / "bad.yml")
    with pytest.raises(FileNotFoundError):
        profiles.load("nope")
    assert profiles.resolve("nope") == profiles.resolve(None) == {} and profiles.resolve({"a": 1}) == {"a": 1}
    assert profiles.act_aliases(PROFILE) == {"Wetboek van Strafrecht": ("BWBR0001854", None), "Akte": (None, "32010L0013")}
    monkeypatch.setenv("X_LIST", " a, ,b ")
    assert profiles.env_list("X_LIST") == ["a", "b"] and profiles.env_list("X_NONE", ("c",)) == ["c"]
    monkeypatch.setenv("X_LIST", "")
    assert profiles.env_list("X_LIST", ("c",)) == ["c"]
    monkeypatch.setenv("X_LIST", " een twee,x")
    assert profiles.env_list("X_LIST", ("c",)) == ["een twee", "x"]
    assert profiles.unique(["b", "a"], ["b", " c ", ""]) == ["b", "a", "c"]


def test_requests():
    import datetime as dt

    at = dt.datetime(2020, 1, 2, 3, 4, 5, 6, tzinfo=dt.timezone(dt.timedelta(hours=2)))
    assert http.modified_since("Zaak", at) == ("Zaak", {"$filter": "ApiGewijzigdOp ge 2020-01-02T01:04:05Z", "$top": "100"})
    assert http.odata_time(dt.datetime(2020, 1, 2)) == "2020-01-02T00:00:00Z" and http.base_url("http://x//") == "http://x/"
    assert http.celex_html("32010L0013")[1] == {"uri": "CELEX:32010L0013"}
    assert http.entries({"value": 1, "a": [{"x": 1}, 2], "b": [{"y": 2}]}) == [{"x": 1}, {"y": 2}] and http.entries([{"z": 1}]) == [{"z": 1}]
    assert http.search_parameters(["a", " b "], ["x", "y"]) == {"rechtsgebieden": "a,b", "zoekterm": "x y", "searchterm": "x y"}


def test_paged_source(spark):
    class Pages(BaseHTTPRequestHandler):
        def do_GET(self):
            bodies = {"/Zaak": {"value": [{"Id": 1}, {"Id": 2}], "@odata.nextLink": "/Zaak2"}, "/Zaak2": {"value": [{"Id": 3}], "@odata.nextLink": " "}}
            body = bodies.get(self.path)
            self.send_response(200 if body else 404)
            self.end_headers()
            self.wfile.write(json.dumps(body or {}).encode())

        def log_message(self, *_):
            pass

    server = HTTPServer(("127.0.0.1", 0), Pages)
    threading.Thread(target=server.serve_forever, daemon=True).start()
    base = f"http://127.0.0.1:{server.server_port}/"
    spark.dataSource.register(http.PagedJson)
    spark.dataSource.register(http.HttpText)
    got = spark.read.format("paged_json").option("url", base).option("path", "Zaak").load().collect()
    assert [json.loads(r.payload)["Id"] for r in got] == [1, 2, 3]
    texts = spark.read.format("http_text").option("urls", json.dumps([base + "Zaak2", base + "weg"])).load().collect()
    assert sum(r.error is not None for r in texts) == 1
    server.shutdown()


def test_retrieval_from_a_local_service(spark, rows, tmp_path):
    import datetime as dt

    from stelwerk.plans import retrieve

    class Service(BaseHTTPRequestHandler):
        def do_GET(self):
            path, base = self.path, f"http://127.0.0.1:{self.server.server_port}"
            listing = f"<r><record><bwb-id>B1</bwb-id><locatie_toestand>{base}/doc</locatie_toestand><geldigheidsperiode_einddatum>9999-12-31</geldigheidsperiode_einddatum></record></r>"
            bodies = {"/Zaak": json.dumps({"value": [{"Id": "Z1", "Titel": "straf"}, {"Id": "Z2"}]}), "/DocumentVersie": json.dumps({"value": [{"Id": "D1"}]}), "/uitspraken/content?id=E1": "<e/>", "/uitspraken/zoeken": "<index/>", "/legal-content/NL/TXT/": "<p/>", "/sru?operation": listing, "/doc": "<wet/>"}
            body = next((b for p, b in bodies.items() if path.startswith(p)), None)
            self.send_response(200 if body else 404)
            self.end_headers()
            self.wfile.write((body or "").encode())

        def log_message(self, *_):
            pass

    server = HTTPServer(("127.0.0.1", 0), Service)
    threading.Thread(target=server.serve_forever, daemon=True).start()
    base = f"http://127.0.0.1:{server.server_port}/"
    cols = ("kind", "external_id", "payload_json", "payload_text")
    since = dt.datetime(2020, 1, 1)
    step = {"step": dt.timedelta(days=4000), "until": dt.datetime(2026, 1, 1)}
    tk = retrieve.parliament(spark, since, cases=retrieve.parliament_filter({"title_contains": ["Straf"]}), base=base, **step)
    assert rows(tk.select(*cols[:2])) == [("tk-documentversie", "D1"), ("tk-zaak", "Z1")] and tk.where("payload_text is not null").count() == 0
    rs = retrieve.judgments(spark, ["E1", "weg", "E1"], since, base=base)
    assert rows(rs.select(*cols[:2], "error")) == [("rs-content", "E1", None), ("rs-content", "weg", "HTTPError: HTTP Error 404: Not Found"), ("rs-index", None, None)] and rs.where("payload_json is not null").count() == 0
    assert rows(retrieve.acts(spark, ["C1"], base=base).select("external_id", "meta")) == [("C1", {"celex": "C1", "lang": "NL"})]
    assert rows(retrieve.laws(spark, ["B1", "B9"], base + "sru").select("external_id", "payload_text", "error")) == [("B1", "<wet/>", None), ("B9", None, "no version")]
    assert retrieve.time_windows(since, dt.datetime(2020, 1, 3, 1)) == [(since, dt.datetime(2020, 1, 2)), (dt.datetime(2020, 1, 2), dt.datetime(2020, 1, 3)), (dt.datetime(2020, 1, 3), None)]
    assert [len(retrieve.time_windows(since, t)) for t in (since, dt.datetime(2019, 1, 1))] == [1, 1]
    bases = {"parliament": base, "judgments": base, "eu_acts": base, "laws": base + "sru"}
    profile = {"filters": {"tk": {"title_contains": ["straf"]}}, "seed_examples": {"rechtspraak_eclis": ["E1", "weg"]}, "bwb": {"ids": ["B1"]}}
    now = dt.datetime.now() - dt.timedelta(hours=1)
    done = retrieve.run(spark, f"{tmp_path}/raw", profile, since=now, bases=bases, skip=["none"])
    assert done == {"parliament": {"stored": 1, "failed": 0}, "judgments": {"stored": 2, "failed": 1}, "laws": {"stored": 1, "failed": 0}}
    again = retrieve.run(spark, f"{tmp_path}/raw", profile, sources=["eu_acts", "laws"], since=now, bases=bases, ids=["C1"], skip=["laws"])
    assert again == {"eu_acts": {"stored": 1, "failed": 0}}
    back = spark.read.parquet(f"{tmp_path}/raw")
    assert back.count() == 5 and rows(spark.read.parquet(f"{tmp_path}/raw_failed").select("external_id")) == [("weg",)]
    assert engine.run(spark, back, f"file://{tmp_path}/store", profile)["parliament"]["procedures"] == 1
    with pytest.raises(Exception, match="HTTP Error 404"):  # a walk that fails is no empty one
        retrieve.run(spark, f"{tmp_path}/raw2", profile, sources=["parliament"], since=now, bases={"parliament": base + "leeg/"})
    assert not (tmp_path / "raw2").exists()
    assert retrieve.laws(spark, []).count() == retrieve.acts(spark, []).count() == retrieve.judgments(spark, []).count() == 0
    server.shutdown()


def test_served_documents(spark):
    from stelwerk.plans import serve

    df = spark.createDataFrame([("judgments/a", "judgment", ["x"], ("E", "<x/>", "profiel", "A")), ("judgments/b", None, None, (None, "<x/>", None, None))], "_id string, type string, labels array<string>, props struct<ecli:string,raw_xml:string,strafrecht_profile:string,display_name:string>")
    got = {r._id: json.loads(r.payload) for r in serve.node_payload(df).collect()}
    assert got["judgments/a"]["key"] == "a" and "raw_xml" not in got["judgments/a"]["props"]
    assert "props" not in got["judgments/b"] and got["judgments/b"]["type"] == ""
    assert [r.summary for r in serve.judgment_summary(df).collect()] == ["profiel", None]
    assert json.loads(serve.schemas({"t": df})["t"])["type"] == "struct"
    edges = spark.createDataFrame([(None, (0.5,)), (0.9, (0.5,))], "confidence double, meta struct<confidence:double>")
    assert [r[0] for r in edges.select(serve.edge_confidence(edges)).collect()] == [0.5, 0.9]


def test_command_line(monkeypatch):
    from stelwerk import __main__ as cli

    got = cli.parser().parse_args(["retrieve", "--raw", "r", "--source", "laws", "--id", "B1", "--id", "B2"])
    assert got.id == ["B1", "B2"] and got.limit == 50 and got.lang == "NL" and not got.store_citations
    for bad in (["retrieve", "--raw", "r", "--id", "B1"], ["run", "--raw", "r"], ["run"], ["seed", "--raw", "r"]):
        with pytest.raises(SystemExit):
            cli.main(bad)
    monkeypatch.setenv("STELWERK_SKIP_EU_ACTS", "1")
    assert cli.skipped_by_environment(("eu_acts", "laws")) == {"eu_acts"}


def test_stages_skipped_by_environment(monkeypatch):
    from stelwerk.__main__ import skipped_by_environment

    monkeypatch.setenv("STELWERK_SKIP_SEED", "true")
    monkeypatch.setenv("STELWERK_SKIP_LAWS", "0")
    assert skipped_by_environment() == {"seed"}


def test_landing_table_and_scan(spark, tmp_path):
    df = spark.createDataFrame([("Z1", "{}")], "i string, j string")
    rows_ = raw.raw_rows(df, "tk", "tk-zaak", df.i, df.j)
    raw.append(rows_, f"{tmp_path}/raw")
    raw.append(rows_, f"{tmp_path}/raw")
    back = spark.read.parquet(f"{tmp_path}/raw")
    assert raw.scan(back, "tk", ["tk-zaak"], "2000-01-01").count() == 2 and back.select("_key").distinct().count() == 2
    assert raw.scan(back, "tk", ["rs-index"]).count() == 0 and back.first().meta == {}


def test_streams(spark, tmp_path):
    landing(spark).write.parquet(f"{tmp_path}/in")
    landing(spark).limit(3).write.mode("append").parquet(f"{tmp_path}/in")
    stream = ingest.landing(spark, f"{tmp_path}/in")
    store = engine.Store(spark, f"file://{tmp_path}/store")
    for _ in range(2):
        ingest.into_store(stream, store, lambda b: normalize.judgments(b, PROFILE), f"{tmp_path}/ck").awaitTermination()
    assert store.read("judgments").count() == 1 and store.read("edges_semantic").count() == 1
    q = ingest.deduplicated(ingest.landing(spark, f"{tmp_path}/in")).writeStream.format("memory").queryName("once").option("checkpointLocation", f"{tmp_path}/ck2").trigger(availableNow=True).start()
    q.awaitTermination()
    assert spark.table("once").count() == 11
