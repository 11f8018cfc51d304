import unicodedata

from hypothesis import given, settings
from hypothesis import strategies as st

from stelwerk.llm import canonical as C

chars = st.characters(codec="utf-8", exclude_categories=["Cs"])


def whole(text):
    """The same fold over the whole text at once."""
    s = unicodedata.normalize("NFD", text.replace("\r\n", "\n"))
    return unicodedata.normalize("NFC", "".join(c if (f := C._fold(c)) is None else f for c in s)).strip(" ")


@given(st.text(st.one_of(chars, st.sampled_from("eaoÀéïÏ ́̈​­⁠ аеіΙΟϲⅡﬃĳＷ：∶꞉각각\r\n")), max_size=40))
@settings(max_examples=600, deadline=None)
def test_segments_give_the_same_as_the_whole(text):
    assert C.canonical_text(text) == whole(text)


@given(st.text(chars, max_size=30))
@settings(max_examples=200, deadline=None)
def test_idempotent(text):
    once = C.canonical_text(text)
    assert C.canonical_text(once) == once


def test_what_shows_and_what_does_not():
    same = [("é", "é"), ("ＷＶＷ１", "WVW1"), ("artikel 5", "artikel 5"), ("аrtіkеl", "artikel"), ("1∶7", "1:7"), ("Ⅳ", "IV"), ("ﬁets", "fiets"), ("bĳ", "bij"), ("a­​b", "ab"), ("ї", "ï"), ("x﻿", "x"), ("5․", "5."), ("ꓮᎪᴏ", "AAo")]
    for a, b in same:
        assert C.canonical_text(a) == C.canonical_text(b) == b or C.canonical_text(a) == C.canonical_text(b)
    for a, b in [("A", "a"), ("e", "é"), ("5.", "5"), ("5²", "52"), ("1", "l"), ("5 a", "5a")]:
        assert C.canonical_text(a) != C.canonical_text(b)


def test_column_nulls_empty_and_long(spark):
    long = "é" * 30000 + "​x"
    df = spark.createDataFrame([(None,), ("",), (" a ",), (long,), ("а",)], "v string")
    assert [r[0] for r in df.select(C.canonical(df.v)).collect()] == [None, "", "a", "é" * 30000 + "x", "a"]


def test_pairs_against_brute_force(spark):
    import itertools
    import random

    rnd = random.Random(2)
    data = [(i, rnd.choice(["g1", "g1", "g2", None]), rnd.choice(["5", "５", "5​", "6", None, "5 a", "5 a"]), rnd.choice(["tekst", "tеkst", "ander", None]), "clash", 0) for i in range(120)]
    df = spark.createDataFrame(data, "rec_id bigint, g string, num string, txt string, look string, id int")
    form = lambda x: x and C.canonical_text(x)
    want = {(a[0], b[0]) for a, b in itertools.combinations(data, 2) if None not in a[1:4] and None not in b[1:4] and a[1] == b[1] and form(a[2]) == form(b[2]) and form(a[3]) == form(b[3]) and a[3] != b[3]}
    alike = C.look_alikes(C.digests(df, "rec_id", {"both": (["g"], ["num", "txt"], "txt"), "number": (["g"], ["num"], "num")}))
    assert {tuple(r) for r in C.look_alike_pairs(alike).where("field = 'both'").select("id_a", "id_b").collect()} == want
    numbers = {(a[0], b[0]) for a, b in itertools.combinations(data, 2) if None not in a[1:3] and None not in b[1:3] and a[1] == b[1] and form(a[2]) == form(b[2]) and a[2] != b[2]}
    classes = [r for r in C.look_alike_classes(alike).collect() if r.field == "number"]
    assert len({r.id for r in classes}) == len(classes) == len({x for p in numbers for x in p})
    assert {(a.id, b.id) for a in classes for b in classes if a.id < b.id and a.class_id == b.class_id and a.spelling_id != b.spelling_id} == numbers
    assert all(min(c.id for c in classes if c.class_id == r.class_id) == r.class_id <= r.spelling_id <= r.id for r in classes)
    assert C.look_alike_pairs(C.look_alikes(C.digests(df.limit(0), "rec_id", {"f": (["g"], ["num"], "num")}))).count() == 0
    assert C.with_canonical(df, {"look": "num"}).columns == df.columns
