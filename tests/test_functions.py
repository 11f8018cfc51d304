import unicodedata

from stelwerk.functions import keys as K
from stelwerk.functions import text as X
from pyspark.sql import functions as F


def one(spark, value, f, kind="string"):
    return spark.createDataFrame([(v,) for v in value], f"v {kind}").select(f(F.col("v"))).toPandas().iloc[:, 0].tolist()


def test_sanitized_keys(spark):
    cases = {"ECLI:NL:HR:2019:793": "ecli_nl_hr_2019_793", "BWBR0001854": "bwbr0001854", "21970A0718(02)": "21970a0718_02", " Één  wet ": "een_wet", "__a--b__": "a_b", "²": "2", "": "node", "???": "node", "字": "node"}
    assert one(spark, cases, K.sanitize_key) == list(cases.values())
    assert one(spark, [None], K.sanitize_key) == [None]
    for v in cases:
        folded = unicodedata.normalize("NFKD", v).encode("ascii", "ignore").decode()
        assert one(spark, [v], K.ascii_fold) == [folded]


def test_keys_of_parts(spark):
    df = spark.createDataFrame([("BWBR1", "24c"), ("BWBR1", None), (" ", "5"), (None, None)], "a string, b string")
    assert [r[0] for r in df.select(K.node_key(F.col("a"), F.col("b"))).collect()] == ["bwbr1_24c", "bwbr1", "5", "node"]
    assert one(spark, ["x/y/z", "x", None], K.id_key) == ["y/z", None, None]
    got = df.select(K.edge_key(F.col("a"), F.col("b"), "REL")).first()[0]
    assert got == "bwbr1__24c__REL"


def test_text_functions(spark):
    assert one(spark, ["\t a b ", None, ""], X.strip) == ["a b", None, ""]
    assert one(spark, ["<p>a<b>b</b>\n c</p>"], X.strip_html) == ["a b c"]
    assert one(spark, ["24c", "c24", None], X.leading_int)[0] == 24
    df = spark.createDataFrame([("0123456789" * 20, 100, 103)], "t string, s int, e int")
    assert df.select(X.snippet(df.t, df.s, df.e)).first()[0] == ("0123456789" * 20)[60:143]
    years = spark.createDataFrame([("2010", "13"), ("2019", "12345"), ("2019", "x")], "y string, n string")
    assert [r[0] for r in years.select(X.celex("L", years.y, years.n)).collect()] == ["32010L0013", "32019L12345", "32019L0000"]
    assert one(spark, ["9999-12-31", "x", None], lambda c: X.date_or_min(c).cast("string")) == ["9999-12-31", "0001-01-01", "0001-01-01"]
    assert one(spark, [" 12.9 ", "x", None], lambda c: X.as_int(c).cast("string")) == ["12", None, None]
    assert one(spark, ['{"b": "x", "a": ["y", {"c": " z "}, 1, ""]}', "{", None], X.json_strings) == ["x\ny\nz", None, None]


def test_classifiers(spark):
    assert one(spark, ["Het WETBOEK", "niets", None, ""], lambda c: X.has_keyword(c, [" Wetboek", "", None])) == [True, False, False, False]
    assert one(spark, ["wet"], lambda c: X.has_keyword(c, [])) == [False]
    assert one(spark, ["ECLI:NL:HR:1", "x", None], lambda c: X.has_prefix(c, ["ECLI:NL:HR"])) == [True, False, False]
    assert one(spark, ["Civiel, STRAFRECHT", "x", None], lambda c: X.in_list(c, ["strafrecht "])) == [True, False, False]


def test_display_names(spark):
    schema = "kind string, title string, bwb_id string, celex string, article_number string, ecli string, external_id string, name string, slug string"
    data = [
        ("instrument", "Wet", "B1", None, None, None, None, None, None), ("instrument", " ", "B1", None, None, None, None, None, None), ("instrument", None, None, "C", None, None, None, None, None), ("instrument", None, None, None, None, None, None, None, None),
        ("article", None, None, None, "5", None, None, None, None), ("judgment", None, None, None, None, "E", None, None, None), ("judgment", "T", None, None, None, "E", None, None, None), ("procedure", None, None, None, None, None, "P1", None, None),
        ("publication", None, None, None, None, None, None, None, None), ("topic", None, None, None, None, None, None, None, "s"), ("actor", None, None, None, None, None, None, None, None),
    ]
    df = spark.createDataFrame(data, schema)
    got = [r[0] for r in df.select(X.display_name(F.col("kind"), {c: F.col(c) for c in df.columns[1:]})).collect()]
    assert got == ["Wet (B1)", "BWB B1", "EU C", "Instrument", "Art. 5", "E", "T (E)", "Procedure P1", "Publicatie", "s", "Actor"]


def test_functions_for_sql(spark):
    from stelwerk.functions.register import register

    names = register(spark)
    assert register(spark) == names and "sw_key" in names
    row = spark.sql("SELECT sw_strip('\u00a0 a b \t'), sw_filled('  '), sw_strip_html('<p>a<b>b</b>\n c</p>'), sw_key('__a--b__ C'), sw_key('??'), sw_collection('x/y/z'), sw_id_key('x/y/z'), sw_id_key('x'), sw_celex('L', '2010', '13'), sw_snippet('  abc ', 2, 3), sw_key(null)").first()
    assert tuple(row)[:10] == ("a b", None, "a b c", "a_b_c", "node", "x", "y/z", None, "32010L0013", "abc")
    got = spark.createDataFrame([("Richtlijn X",), (None,)], "v string").selectExpr("sw_key(v) as k")
    assert [r.k for r in got.collect()][0] == "richtlijn_x"
