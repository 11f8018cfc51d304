import random
import re

from hypothesis import given, settings
from hypothesis import strategies as st

from stelwerk.llm import spam as S

SENTENCES = [
    "De houder verstrekt de gegevens binnen dertig dagen na de aanvraag aan de instantie.", "Each officer and the holder of a permit may rely on the act where no fund is left.",
    "Soweit eine Behörde fehlt, bestimmt die Stelle das Verfahren nach dem Gesetz.", "Si le titulaire ne fournit pas la liste, le juge examine la demande dans les dix jours.",
]
WORDS = "havenfonds dijkraad pensioenkaart tariefnorm zorgklacht bouwzone".split()


def texts(seed):
    rnd = random.Random(seed)
    pick = lambda n: [rnd.choice(WORDS) for _ in range(n)]
    spam = [
        " ".join("#" + w for w in pick(25)), "\n".join(f"{w} {rnd.randint(1, 999)} € {rnd.randint(1, 99)},95" for w in pick(15)), "\n".join(f"https://x.example/{w}-{rnd.randint(1, 99)}" for w in pick(12)),
        " ".join(pick(120)), " | ".join(f"advocaat {w.title()}" for w in pick(20)), "".join(f"[{w}](https://x.example/{w}) | " for w in pick(20)), rnd.choice(SENTENCES) + "\n" + "\n".join(pick(60)) + "\n" + rnd.choice(SENTENCES),
    ]
    contents = "\n".join(f"Artikel {i}. {w.title()}" for i, w in enumerate(pick(12), 1))
    body = " ".join(rnd.choice(SENTENCES) for _ in range(12))
    wide = "".join(chr(ord(c) + 0xFEE0) if "!" <= c <= "~" else c for c in body)
    good = [body, contents + "\n" + body, body + "\n- " + "\n- ".join(pick(10)), body.replace(".", ""), "\n".join(body[i : i + 40] for i in range(0, len(body), 40)), wide, rnd.choice(SENTENCES), "Artikel 5", "ja", body + "\n" + "\n".join(f"- bron: https://x.example/{w}" for w in pick(6))]
    return spam, good


def flagged(text):
    return S.judge([text])[0][4]


def test_spam_and_acts(capsys):
    hit = got = want = 0
    for seed in range(40):
        spam, good = texts(seed)
        assert [t for t in good if flagged(t)] == []
        found = sum(map(flagged, spam))
        hit, got, want = hit + found, got + found, want + len(spam)
    with capsys.disabled():
        print(f"\nplanted spam pages: recall {hit / want:.4f}, precision {hit / got:.4f}")
    assert hit == want


PROSE = {
    "es": "El titular de la autorización comunicará los datos en un plazo de treinta días. Cuando no se presente la solicitud, la autoridad podrá revocar el permiso. La decisión se publicará en el boletín y surtirá efecto a partir de su notificación. ",
    "it": "Il titolare comunica i dati entro trenta giorni dalla domanda. Se la domanda non viene presentata, l'autorità può revocare il permesso. La decisione è pubblicata nel bollettino e ha effetto dal giorno della notifica alle parti. ",
    "pl": "Posiadacz zezwolenia przekazuje dane w terminie trzydziestu dni od złożenia wniosku. Jeżeli wniosek nie zostanie złożony, organ może cofnąć zezwolenie. Decyzję ogłasza się w dzienniku i staje się ona skuteczna z dniem doręczenia. ",
    "sv": "Innehavaren ska lämna uppgifterna inom trettio dagar från ansökan. Om ingen ansökan görs får myndigheten återkalla tillståndet. Beslutet ska offentliggöras och gälla från den dag då det delgavs parterna. ",
    "zh": "许可证持有人应当在提出申请之日起三十日内提供资料。未提出申请的，主管机关可以撤销许可。决定应当公布，并自送达之日起生效。",
}


def test_prose_of_other_languages():
    assert [k for k, t in PROSE.items() if flagged(t * 4)] == []
    assert flagged(" | ".join(w for w in PROSE["es"].split() if len(w) > 6) + " | " + " | ".join(["permiso autoridad"] * 20))


def test_shapes_tell_kinds_of_lines_apart():
    shape = lambda t: S.judge([t])[0][2]
    assert shape("#haven #dijk #zorg") == shape("#markt #pacht #sluis") != shape("haven dijk zorg")
    assert shape("https://x.example/a") == "0 words, capitals none, link"
    assert shape("fonds haven fonds: fonds") == "3-5 words, capitals none, :, repeated"
    assert shape("Zaak Haven - Dijk") == "3-5 words, capitals most, -"


def _brute(text):
    """The lines of a text by the definition, character by character."""
    text = S._plain(text)
    cut, line = [], ""
    for i, ch in enumerate(text):
        if ch in "\n\t\r" or ch == " " and i and text[i - 1] in ".!?":
            cut.append(line)
            line = ""
        else:
            line += ch
    out = []
    for line in [*cut, line]:
        units = list(re.finditer(r"[^\W\d_]+|\x01", line))
        owner = {}
        for i, ch in enumerate(line):
            if ch in S._SEPARATORS and (ch != "-" or i == 0 or line[i - 1] == " "):
                near = [k for k, u in enumerate(units) if u.start() < i]
                owner.setdefault((near[-1] if near else 0) // S.LINE, []).append(ch)
        for k in range(0, len(units), S.LINE):
            own = [u[0] for u in units[k : k + S.LINE]]
            words = [w for w in own if w != "\x01"]
            low = [w.lower() for w in words]
            links, seps = len(own) - len(words), len(owner.get(k // S.LINE, []))
            repeats = sum(len(w) > S.SHORT and low.count(w) > 1 for w in low)
            fine = len(words) >= S.LEAST and any(len(w) <= S.SHORT for w in words) and links * S.LINKED <= len(words) and seps * S.SEPARATED <= len(words) and repeats <= S.REPEATED * len(words)
            out.append((len(own), fine))
    return out


@settings(max_examples=300, deadline=None)
@given(st.lists(st.sampled_from(["de", "Haven", "haven", "dijkraad", "Één", "en", "x1", ",", " - ", "-", "#", ". ", "!", "\n", " ", "  ", "|", "https://x.example/a ", "<p>", "<a href=1>", "12", "€"]), max_size=60), st.integers(0, 3))
def test_lines_equal_brute_force(tokens, spaced):
    text = (" " if spaced else "").join(tokens)
    own, words, fine, _ = S.lines(["", S._plain(text), "een en twee"])
    assert list(zip(words[own == 1].tolist(), fine[own == 1].tolist())) == _brute(text)
    assert words[own == 2].tolist() == [3]


def test_invisible_characters_and_parts():
    spam, good = texts(3)
    assert [S.judge([t])[0] for t in good] == [S.judge([t.replace("e", "e\u200b")])[0] for t in good]
    long = good[0] * (2 * S.PART // len(good[0]) + 5)
    assert len(list(S._parts(long))) == 3 and "".join(S._parts(long)) == long
    assert not flagged(long) and flagged(spam[3] * 4000) and S.judge([]) == []
    assert [r[0] for r in S.judge([good[0], long, good[0]])][::2] == [S.judge([good[0]])[0][0]] * 2
    assert "".join(S._parts("x" * (S.PART + 9))) == "x" * (S.PART + 9)


def test_operator_nulls_ties_and_long_texts(spark, rows):
    spam, good = texts(1)
    data = [(1, None), (2, ""), (3, " "), (4, spam[0]), (4, spam[0]), (5, good[0]), (6, " ".join(WORDS) * 20000), (7, good[0] * 300)]
    df = spark.createDataFrame([(*d, True, 1) for d in data], "doc_id bigint, text string, is_spam boolean, n_words int")
    got = rows(S.pages(df).select("doc_id", "is_spam"))
    assert got == [(2, False), (3, False), (4, True), (4, True), (5, False), (6, True), (7, False)]
    assert S.pages(df.limit(0)).count() == 0


def test_long_tags_are_no_words():
    text = "De aanvraag wordt door het bestuur behandeld en is niet openbaar."
    assert S.judge([f'<a href="{"x y " * 200}">{text}</a>']) == S.judge([f"<a>{text}</a>"])
