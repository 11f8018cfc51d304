import random
import re

from pyspark.sql import functions as F

from stelwerk.operators import detect as D
from stelwerk.operators.scan import find_all, pattern

CODES = {"Sr": "BWBR0001854", "WVW": "BWBR0006622", " bw ": "BWBR0005290", "": "x", "leeg": None}


def docs(spark, *texts):
    return spark.createDataFrame([(str(i), t, "BWBR0001854") for i, t in enumerate(texts)], "id string, t string, law string")


def test_scan_against_finditer(spark):
    rnd = random.Random(7)
    bits = ["artikel ", "Artikel\n", "art. ", "5", "24c", "é", "²", "٣", " Sr", "Richtlijn 2010/13/EU", "CELEX:32019L1158", "x", " ", "_", "\x01", "ſ"]
    texts = ["".join(rnd.choice(bits) for _ in range(rnd.randint(0, 12))) for _ in range(400)] + ["", "geen"]
    for rx in (r"\bartikel\s+(\d+[a-z]?)\b", r"\bart\.\s*(\d+[a-z]?)", r"\bRichtlijn\s+(\d{4})/(\d+)(?:/EU|/EG)?\b"):
        df = docs(spark, *texts)
        got = {r.id: [tuple(m) for m in r.m] for r in df.select("id", find_all(df.t, pattern(rx)).alias("m")).collect()}
        for i, t in enumerate(texts):
            t = t.replace("\x01", " ")
            assert got[str(i)] == [(m.start(), m.end(), m.group()) for m in re.finditer(rx, t, re.I)], (rx, t)
    assert docs(spark, None).select(find_all(F.col("t"), "a")).first()[0] is None


def test_scan_of_texts_with_very_many_matches(spark):
    import time

    texts = ["x" * (i % 3) + "ab, " * n + "ab"[: i % 3] for i, n in enumerate((254, 255, 256, 257, 511, 512, 513, 1100, 60000))]
    began = time.perf_counter()
    got = {r.id: [tuple(m) for m in r.m] for r in docs(spark, *texts).select("id", find_all(F.col("t"), "ab").alias("m")).collect()}
    assert time.perf_counter() - began < 60
    for i, t in enumerate(texts):
        assert got[str(i)] == [(m.start(), m.end(), m.group()) for m in re.finditer("ab", t)]


def law(spark, *texts):
    return sorted((int(r.doc), r.start, r.end, r.article_number, r.confidence) for r in D.detect_law(docs(spark, *texts), "id", "t", "law").collect())


def test_articles_of_the_own_law(spark):
    assert law(spark, "Onverminderd artikel 7bis geldt een vergunning.") == [(0, 21, 25, "7bis", 0.95)]
    assert [x[3] for x in law(spark, "Op grond van art. 12a en 30 wordt geheven.")] == ["12a", "30"]
    got = law(spark, "De artikelen 8 tot en met 11 gelden niet.")
    assert [(x[3], x[4]) for x in got] == [("8", 0.95), ("10", 0.8), ("9", 0.8), ("11", 0.95)] and {x[1:3] for x in got if x[4] == 0.8} == {(13, 28)}
    assert {(x[3], x[4]) for x in law(spark, "artikel 33 tot 30")} == {("30", 0.95), ("31", 0.8), ("32", 0.8), ("33", 0.95)}
    assert {x[3] for x in law(spark, "artikelen 21-24, 26 & 28")} == {"21", "24", "26", "28"}
    assert [x[1:4] for x in law(spark, "Zie artikel. 5 en art 6.")] == [(13, 14, "5"), (22, 23, "6")]
    assert law(spark, None, "", " niets ", "partikel 5") == []


def test_ranges_of_any_width(spark):
    hits_ = D.detect_law(docs(spark, "artikel 5 tot 250007"), "id", "t", "law")
    assert hits_.count() == 250003 and hits_.where("confidence = 0.8").agg(F.min(F.col("article_number").cast("int")), F.max(F.col("article_number").cast("int"))).first() == (6, 250006)


def test_confidences_of_a_profile(spark):
    assert D.confidence_of({"a": "0.5", "b": None, "c": "x"}, "a", 1.0) == 0.5
    assert [D.confidence_of({"b": None, "c": "x"}, n, 1.0) for n in "bcd"] == [1.0, 1.0, 1.0]


def hits(df):
    return sorted(((r.kind, r.celex, r.bwb_id, r.article_number, r.confidence, r.raw_match) for r in df.collect()), key=str)


def test_judgments(spark):
    run = lambda t: D.detect_judgment(docs(spark, t), "id", "t", CODES).collect()
    r = run("zie art. 287 Sr en artikel 9 en art. 287 Sr")
    assert sorted((x.bwb_id or "", x.article_number, x.confidence) for x in r) == [("", "9", 0.35), ("BWBR0001854", "287", 0.95)]
    assert run("artikel 185 WVW")[0].bwb_id == "BWBR0006622"
    assert [x.confidence for x in run("artikel 5 Sv")] == [0.35]


def test_eu_texts(spark):
    r = hits(D.detect(docs(spark, "Artikel 6 van Richtlijn 2010/13/EU"), "id", "t", D.eu_rules(), CODES))
    assert [(x[0], x[1], x[3], x[4]) for x in r] == [("article", "32010L0013", "6", 0.85), ("instrument", "32010L0013", None, 0.7)]
    r = hits(D.detect(docs(spark, "zoals CELEX:32019l1158, bwbr0001854 en artikel 3 BW"), "id", "t", D.eu_rules(), CODES))
    assert {(x[1], x[2], x[3]) for x in r} == {("32019L1158", None, None), (None, "BWBR0001854", None), (None, "BWBR0005290", "3")}


def test_parliament_texts(spark):
    rules = D.parliament_rules({"Wet (oud) a.b": ("BWBR1", None), "EU-akte": (None, "32000L0001"), "leeg": (None, None)})
    df = docs(spark, "De wet (OUD) a.b en eu-akte; Wijziging van artikel 287 Sr, art. 5 EVRM. Verordening 2016/679", "xWet (oud) a.b")
    r = D.detect(df, "id", "t", rules, CODES)
    assert {(x.doc, x.celex, x.bwb_id, x.article_number, x.confidence) for x in r.collect()} == {("0", None, "BWBR1", None, 0.6), ("0", "32000L0001", None, None, 0.6), ("0", None, "BWBR0001854", "287", 0.95), ("0", "32016R0679", None, None, 0.65)}
    snippet = [x.snippet for x in r.collect() if x.article_number == "287"][0]
    assert "artikel 287 Sr" in snippet and len(snippet) <= 94


def test_empty_table(spark):
    df = docs(spark, "x").limit(0)
    assert D.detect(df, "id", "t", D.eu_rules(), CODES).count() == D.detect_law(df, "id", "t", "law").count() == D.detect_judgment(df, "id", "t", {}).count() == 0
