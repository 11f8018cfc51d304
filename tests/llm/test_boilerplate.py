import math
import random
from xml.etree import ElementTree

from hypothesis import given, settings
from hypothesis import strategies as st

from stelwerk.llm import boilerplate as B
from stelwerk.llm import dom

LONG = "De houder verstrekt de gegevens binnen dertig dagen na de aanvraag van de bevoegde instantie, tenzij deze besluit anders bepaalt. " * 2
NAV = "".join(f"<li id=n{i}><a href='x'>Menu {'abc'[i]}</a></li>" for i in range(3))


def page(body, title="Titel van de wet"):
    return f"<!DOCTYPE html><html><head><title>{title}</title><script>document.write('<p id=js>x</p>')</script></head><body>{body}</body></html>"


ACT = f"<h1 id=t>Titel van de wet</h1><p id=d>1.2.2030</p><h3 id=a1>Artikel 1</h3><p id=p1>{LONG}</p><p id=share>Deel dit: <a>Mail</a> <a>Print</a> <a>PDF</a></p><!-- <p id=no>weg</p> --><h3 id=a2>Artikel 2</h3><p id=p2>{LONG}<b>vet</b></p><ul><li id=c1><a>Artikel 5 havenwet</a></li></ul><p id=sig>Jan, Piet</p>"


def ids(html):
    return [i for i, _ in B.main_blocks(html)]


def test_act_without_the_portal():
    box = "<div><p id=b1>Lees ook</p><ul><li id=b2><a>een andere</a></li><li id=b5><a>en nog een</a></li></ul><h4 id=b3>Kop</h4><p id=b4>" + LONG[:130] + "</p></div>"
    html = page(f"<div><ul>{NAV}</ul></div><div id=ck>Deze pagina plaatst cookies.</div><button id=ok>Goed</button><div>{ACT}{box}<div style='display:none'><p id=h>{LONG}</p></div></div><div><p id=f>© portaal</p></div>")
    assert ids(html) == ["t", "d", "a1", "p1", "a2", "p2", "c1", "sig"]


def test_a_box_as_dense_as_the_text_stays():
    """The limit of the measure: prose in a box of its own looks like the text's."""
    assert ids(page(f"<ul>{NAV}</ul><div>{ACT}<div><p id=b1>Lees ook</p><p id=b2>{LONG}</p></div></div>"))[-2:] == ["b1", "b2"]


def test_missing_end_tags_and_flat_pages():
    html = page(f"<ul>{NAV.replace('</li>', '')}</ul><table><tr><td><p id=x>Lees ook<td><h2 id=t>Titel van de wet<p id=p1>{LONG}<p id=p2>{LONG}<ol><li id=l1>a) een;<li id=l2>b) twee;</ol><p id=p3>{LONG}</table>")
    assert ids(html) == ["t", "p1", "p2", "l1", "l2", "p3"]
    assert ids(page(ACT)) == ["t", "d", "a1", "p1", "a2", "p2", "c1", "sig"]


def test_a_sentence_about_cookies_is_text():
    assert "p" in ids(page(f"<h1 id=t>Titel van de wet</h1><p id=p>Deze verordening regelt cookies en menu's. {LONG}</p>"))


def test_odd_pages():
    for html in ("", " ", "<html>", "<p>zonder id</p>", "<<<>>", "<a" * 1000, "<div>" * 3000 + "x", "tekst"):
        assert B.main_blocks(html) == []
    n = len(dom.parse("<p id=a>1<p id='b'>2<br/>3<img src=x>"))
    assert n == 5


def test_operator_nulls_repeats_and_clashes(spark, rows):
    data = [(1, page(ACT)), (2, None), (3, "  "), (4, page(ACT)), (5, page(f"<p id=p>{LONG * 400}</p>"))]
    df = spark.createDataFrame([(*d, "x", 1) for d in data], "rec_id bigint, raw_html string, text string, position int")
    got = B.main_text(df)
    assert rows(got.groupBy("rec_id").count()) == [(1, 8), (4, 8), (5, 1)]
    assert B.main_text(df.limit(0)).count() == 0


def test_any_depth():
    deep = "<section>" * 5000 + ACT + "</section>" * 5000
    assert ids(page(f"<ul>{NAV}</ul>{deep}")) == ["t", "d", "a1", "p1", "a2", "p2", "c1", "sig"]
    assert len(ids(page("".join(f"<ol><li id=l{i}>punt {i} van de opsomming" for i in range(3000))))) > 2900


def test_no_word_decides():
    for word in ("Artikel", "Articolo", "Straipsnis", "第"):
        html = page(f"<ul>{NAV}</ul><div>" + "".join(f"<h3 id=h{i}>{word} {i}</h3><p id=p{i}>{LONG}</p>" for i in range(12)) + "</div>", title="x")
        assert len(ids(html)) == 24
    boxes = page(f"<div><ul>{NAV}</ul></div><div>" + "".join(f"<div><p id=p{i}>{LONG}</p></div>" for i in range(12)) + "</div>")
    assert ids(boxes) == [f"p{i}" for i in range(12)]


def test_links():
    html = page(f"<p id=p>{LONG}</p><p id=way><a>Start</a> &gt; <a>Wetten</a> &gt; Deze wet, met een lange naam en nog meer woorden</p><p id=more>Zie ook: <a>een andere, langere wet</a></p><p id=cites>{LONG} zie <a>deze</a>, <a>die</a></p><p id=entry><a>Wet 5</a></p>")
    assert ids(html) == ["p", "cites", "entry"]


def _brute(html):
    """Best element by the definition alone: every element's counts taken anew from its whole subtree."""
    top = ElementTree.fromstring(html)
    body = top.find("body")
    above = {c: p for p in top.iter() for c in p}

    def size(x):
        return len("".join(x.split()))

    def counts(e):
        chars = size("".join(e.itertext()))
        up, linked = e, False
        while up is not None:
            linked, up = linked or up.tag == "a", above.get(up)
        own = chars if linked else sum(size("".join(a.itertext())) for a in e.iter("a"))
        return chars, own, len(list(e.iter())) - 1, len(list(e.iter("a"))) - (e.tag == "a")

    ratio = counts(body)[1] / max(1, counts(body)[0])

    def dense(e):
        c, lc, t, lt = counts(e)
        if not c:
            return 0.0
        base = math.log(c / max(1, c - lc) * lc + ratio * c + math.e)
        return c / max(1, t) * math.log(max(1 + 1e-9, c / max(1, lc) * max(1, t) / max(1, lt))) / base

    best, most = body, -1.0
    for e in body.iter():
        way, up = [], e
        while up is not body:
            up = above[up]
            way.append(dense(up))
        chars, linked = counts(e)[:2]
        total = sum(map(dense, e)) * (1 - linked / max(1, chars))
        if len(e) and e.tag not in dom.INLINE and (not way or dense(e) >= min(way)) and total >= most:
            best, most = e, total
    return [e.get("id") for e in best.iter() if e is not best and e.get("id")]


@settings(max_examples=60, deadline=None)
@given(st.recursive(st.sampled_from(["kort", LONG, "<a>elders</a>", f"<a>{LONG}</a>"]), lambda x: st.lists(x, min_size=1, max_size=4), max_leaves=14))
def test_main_element_equals_brute_force(tree):
    n = iter(range(1000))

    def draw(x):
        return f"<p id='i{next(n)}'>{x}</p>" if isinstance(x, str) else f"<div id='i{next(n)}'>" + "".join(map(draw, x)) + "</div>"

    body = draw(tree)
    best, _, _ = B.main_element(nodes := dom.parse(f"<html><body>{body}</body></html>"))
    inside = []
    for e in nodes:
        up = e.parent
        while up is not None and up is not best:
            up = up.parent
        if up is best and e.id is not None:
            inside.append(e.id)
    assert inside == _brute(f"<html><body>{body}</body></html>")


def test_planted_recall_and_precision(capsys):
    """Acts between and around page parts drawn at random: the share of blocks found and of found blocks that are right."""
    draw, hit, got, want = random.Random(4), 0, 0, 0
    for k in range(200):
        n = draw.randint(3, 15)
        act = [f"<h2 id=t>Titel</h2><p id=d>1.{k}.2030</p>"] + [f"<h3 id=h{i}>§ {i}</h3><p id=a{i}>{LONG[: draw.randint(60, 250)]}</p>" for i in range(n)] + ["<ol><li id=x>a) een zaak;</li><li id=y>b) een ander;</li></ol>"]
        act.insert(draw.randint(2, len(act)), "<p id=z0>Deel: <a>Mail</a> <a>Print</a></p>")
        act.insert(draw.randint(2, len(act)), f"<div><p id=z1>Lees ook</p><ul>{NAV.replace('id=n', 'id=zn')}</ul></div>")
        html = page(f"<div><ul>{NAV}</ul></div><div id=z2>{LONG[:90]}</div><button id=z3>Goed</button><{(tag := draw.choice(['main', 'div', 'article']))}>{''.join(act)}</{tag}><div><p id=z4>{LONG[:80]}</p><p id=z5>© portaal</p></div>")
        found = set(ids(html))
        right = {"t", "d", "x", "y", *[f"h{i}" for i in range(n)], *[f"a{i}" for i in range(n)]}
        hit, got, want = hit + len(found & right), got + len(found), want + len(right)
    with capsys.disabled():
        print(f"\nplanted acts: recall {hit / want:.4f}, precision {hit / got:.4f}")
    assert hit >= 0.95 * want and hit >= 0.95 * got
