"""Page analysis: encoding repair, main body, residue, languages, quality."""

import random

import numpy as np
import pyarrow as pa
import pytest

from quern.llm import language, linemodel, mojibake, pages, quality, residue

PAGE = """We use cookies to run this site and to measure visits. Accept all Reject Settings
Home
Products
Pricing
Home > Insights > Inside the Wimuzopu pilot
Inside the Wimuzopu pilot
By the Qiposenu newsroom, 1/2/3
The night shift compares planned and real consumption in blood banks and laboratories. The audit trail shows what each site still holds at the main depot.
Related articles
What changed with Hirehosa
How Yagenonu supports the ward
The regional depot moves surplus units to a neighbouring site before the truck leaves, even if a driver changes the route.

Share this page with a colleague
Follow us on social media
© 2020 Qiposenu. All rights reserved."""
CLEAN = {
    "pt": "A câmara fria não depende mais de planilhas em clínicas do interior. A coordenação da enfermaria já economizou no depósito central.",
    "de": "Die Bestandsübersicht führt die Zählung täglich nach in mittelgroßen Häusern. Das Prüfprotokoll erklärt, warum die Lieferung verspätet war.",
    "fr": "L’équipe de la pharmacie affiche la péremption de chaque lot. La chambre froide tient le comptage à jour pendant le transport réfrigéré.",
    "es": "La cámara frigorífica registra quién abrió cada cajón. El almacén regional muestra la caducidad de cada lote al cierre del mes.",
    "it": "La cella frigorifera segnala le casse. Il coordinamento di reparto dà alla direzione una visione unica, perché la rete è lenta.",
}


def table(spark, *values):
    return spark.createDataFrame([(k, v, "e", "x") for k, v in enumerate(values)], "id long, text string, lang string, kind string")


def test_furniture(spark):
    got = pages.furniture_lines(table(spark, PAGE, None, "", " \n", PAGE.replace("\n", "\r\n")), "id", "text").collect()
    want = {1, 2, 3, 4, 5, 9, 10, 11, 15, 16}
    for page in (0, 4):
        assert {r.line_no for r in got if r.id == page} == want
    assert {r.id for r in got} == {0, 4}
    body = pages.main_body(table(spark, PAGE), "id", "text").first().body
    assert "night shift" in body and "regional depot" in body and "cookies" not in body and "Yagenonu" not in body


def test_regions_against_brute_force():
    rng = random.Random(1)
    for _ in range(200):
        s = [rng.choice([-3, -2, -1, 1, 2, 3]) for _ in range(rng.randint(0, 12))]
        got = pages.regions([float(x) for x in s])
        covered = {i for a, b in got for i in range(a, b)}
        assert {i for i, x in enumerate(s) if x > 0} <= covered
        assert sum(b - a for a, b in got) == len(covered)
        if got:
            best = max(sum(s[a:b]) for a in range(len(s)) for b in range(a + 1, len(s) + 1))
            assert max(sum(s[a:b]) for a, b in got) == best


@pytest.mark.parametrize("steps", [[("utf-8", "cp1252")], [("utf-8", "latin-1")], [("utf-8", "mac_roman")], [("utf-8", "cp850")], [("cp1252", "cp1251")], [("utf-8", "latin-1"), ("utf-8", "latin-1")]])
def test_garbled_text_comes_back(steps):
    fix = mojibake.repairer().repair
    for clean in CLEAN.values():
        bad = clean
        for written, read in steps:
            bad = bad.encode(written, "ignore").decode(read, "ignore")
        fixed, changed, _ = fix(bad)
        # bytes that a code page leaves open, and signs outside the one written in, are gone for good
        back = bad
        for written, read in reversed(steps):
            back = back.encode(read, "ignore").decode(written, "ignore")
        assert changed and (fixed == clean or back != clean)


def test_clean_and_quoted_text_stays(spark):
    quoted = "In the old export of Cayudije the word was printed as “cafÃ©”, and the guide tells how to avoid that."
    df = table(spark, *CLEAN.values(), "ATENÇÃO: NÃO ABRA A CAIXA", quoted, None, "", "ascii", "DÉPÔT FERMÉ À NOËL", "📦 ❤️ 20 °C – “x”")
    assert mojibake.garbled(df, "id", "text").count() == 0
    assert [r.text for r in mojibake.repaired(df, "id", "text").orderBy("id").collect()][7:9] == [None, ""]
    lost = mojibake.repaired(table(spark, "d�p�t principal depuis le d�but"), "id", "text").first()
    assert lost.lost == 3 and "dépôt" in lost.text


RESIDUE = ["{{ title }}\nResources: [[body]]", "Qiposenu\n404 – Page not found", "Home\nProducts\nPlease enable JavaScript to continue.\nRelated articles\nWhat changed with Hirehosa", "Lorem ipsum dolor sit amet, consectetur adipiscing elit.", "undefined", "O servidor não respondeu a tempo. Aguarde um momento e recarregue."]
KEPT = [PAGE, "{{ title }} The night shift compares planned and real consumption in blood banks and laboratories.", "", None, "  ", "Qiposenu", "Home\nProducts", "404 – Page not found\nThe audit trail shows what each site still holds at the main depot before the truck leaves."]


def test_residue(spark):
    df = table(spark, *RESIDUE, *KEPT)
    assert {r.id for r in residue.found(df, "id", "text").collect()} == set(range(len(RESIDUE)))
    assert residue.is_residue(pages.Analysis.of(pa.array(RESIDUE))).all()
    left = {r.id: r.text for r in residue.without_residue(df, "id", "text").collect()}
    assert set(left) == set(range(len(RESIDUE), len(RESIDUE) + len(KEPT))) and "404" not in left[len(RESIDUE) + 7]
    assert residue.found(df.limit(0), "id", "text").count() == 0


def test_residue_is_taken_out_of_garbled_and_long_lines(spark):
    message = "O servidor não respondeu a tempo."
    own = "The night shift compares planned and real consumption in blood banks and laboratories. The audit trail shows what each site still holds at the main depot."
    df = table(spark, f"{message.encode().decode('cp1252')}\n{own}", f"{own} Please enable JavaScript to continue. {own}")
    left = {r.id: r.text for r in residue.without_residue(df, "id", "text").collect()}
    assert left == {0: own, 1: f"{own} {own}"}


def test_languages(spark):
    english = "The night shift compares planned and real consumption. The audit trail shows what each site still holds."
    mixed = english + "\n" + CLEAN["pt"]
    quoted = english + " It said “" + CLEAN["fr"] + "”."
    df = spark.createDataFrame([(0, english, "en-US"), (1, english, "fr"), (2, mixed, "en"), (3, quoted, "EN_gb"), (4, None, "en"), (5, "", None), (6, english, None), (7, RESIDUE[0], None), *[(10 + k, t, x) for k, (x, t) in enumerate(CLEAN.items())]], "id long, text string, hint string")
    rows = language.page_languages(df, "id", "text", "hint").collect()
    wrong = {(r.id, r.lang) for r in rows if not r.hint_is_right}
    assert wrong == {(1, "en"), (2, "en"), (2, "pt"), (6, "en")}
    assert all(0 <= r.confidence <= 1 for r in rows)
    parts = language.segments(df, "id", "text").where("id = 2").orderBy("segment_no").collect()
    assert [(p.lang, p.n_told) for p in parts] == [("en", 1), ("pt", 1)]
    assert language.segments(df, "id", "text").where("id = 3").first().text == quoted


def test_segments_cover_the_main_body(spark):
    text = f"Inside the Wimuzopu pilot\n{PAGE_EN}\n{CLEAN['de']} {PAGE_EN}\nQiposenu | 1 | 2"
    rows = language.segments(table(spark, text, "Wort", "| 1 |"), "id", "text").orderBy("id", "segment_no").collect()
    assert [(r.id, r.lang) for r in rows][:3] == [(0, "en"), (0, "de"), (0, "en")] and {r.id for r in rows} <= {0, 1, 2}
    assert "\n".join(r.text for r in rows if r.id == 0).split() == text.split()


PAGE_EN = "The night shift compares planned and real consumption. The audit trail shows what each site still holds."


def test_every_counted_page_is_tested_for_residue(spark, monkeypatch):
    text = "\n".join(["The night shift compares planned and real consumption.", "The audit trail shows what each site still holds."] * 4)
    assert language.Body(pa.array([text])).counted(2)[1].tolist() == [language.LANGUAGES.index("en")]
    residues = f"{RESIDUE[1]}\n" + "\n".join(["Please enable JavaScript to continue."] * 9)
    assert language.page_languages(table(spark, residues, text), "id", "text").collect()[0].id == 1


def test_weak_lines_go_by_their_region():
    """A line that the words leave open is main text inside a region and furniture outside of one."""
    assert pages.main_lines([-3.0, 0.4, -3.0, 4.0, -0.3, 3.0, -4.0, 0.3, -4.0]) == [False, False, False, True, True, True, False, False, False]
    a = pages.Analysis.of(pa.array(["Home\nProducts\nZuvemako\nPricing\nCareers", f"{PAGE_EN}\nZuvemako\n{PAGE_EN}"]))
    assert a.furniture.tolist() == [True] * 5 + [False] * 3


def test_the_arrays_give_the_same_as_the_plain_classifier():
    m = linemodel.model()
    with np.load(linemodel.MODELS / "lines.npz") as data:
        row = {f: w for f, w in zip(data["features"].tolist(), data["weights"].astype(np.float32), strict=True)}
    for line in [*filter(None, PAGE.split("\n")), "> Home » Insights", "404 – Seite nicht gefunden!", "[!] Zuvemako 12 | 3", "***", "-"]:
        z = np.sum([row[f] for f in linemodel.features(linemodel.tokens(line, m.vocabulary)) if f in row], 0)
        p = np.exp(z - z.max())
        assert np.allclose(m.of_line(line), p / p.sum(), atol=1e-4), line


def test_a_template_carries_its_parts(spark):
    """The parts of a leaf are judged together: one that alone reads as main text goes with the others of its template."""
    units = residue.undecided_parts(table(spark, *["Script execution must be allowed for this page to load."] * 3, "Script execution is switched off for this page to load."), "id", "text")
    mined = residue.templates(units).collect()
    assert {r.template for r in mined} == {"script execution * * * for this page to load ."} or len({r.template for r in mined}) == 1
    rows = [(k, 0, 4, "a b", "a b c d", residue.RESIDUE, False, -5.0, -0.1, -3.0) for k in range(3)] + [(9, 0, 4, "a b", "a b c e", residue.CONTENT, False, -5.0, -1.0, -0.5)]
    mined = residue.templates(spark.createDataFrame(rows, "id long, row long, words int, path string, masked string, own int, fixed boolean, neutral double, residue double, content double"))
    assert {r.template for r in mined.collect()} == {"a b c d"}


@pytest.mark.parametrize("broadcast", [200_000, -1])
def test_parts_of_all_pages_are_mined(spark, monkeypatch, broadcast):
    """A part that alone reads as a message goes with its template, whose other parts stand on pages of main text."""
    monkeypatch.setattr(residue, "BROADCAST", broadcast)
    df = table(spark, "The audit trail shows what this page could not find at the main server.", *["The audit trail shows what each page can always find at the main server."] * 20, *RESIDUE)
    on = {p.id for r in residue.undecided_parts(df, "id", "text").collect() for p in r.pages}
    assert on == set(range(21 + len(RESIDUE)))
    alone = {r.id for r in residue.found(df, "id", "text", merge=False).collect()}
    assert alone - {r.id for r in residue.found(df, "id", "text").collect()} == {0}


def test_unseen_phrases():
    """General phrases that no labelled line spells out in these words."""
    p = lambda x: linemodel.model().of_line(x)
    furniture = ["Skip straight to the article", "Book your free demo", "Website by Blue Studio", "Lire plus", "Alle Beiträge anzeigen", "Ver mais posts"]
    messages = ["Service is temporarily unavailable.", "Seite wurde nicht gefunden.", "La page demandée est introuvable.", "Index of /uploads", "Please turn on JavaScript to view this site."]
    assert sum(p(x)[[0, 1]].sum() > 0.5 for x in furniture) >= 4
    assert sum(p(x)[4] > 0.5 for x in messages) >= 4


PROSE = "The night shift compares planned and real consumption in blood banks. The audit trail shows what each site still holds."
KINDS = [
    (PROSE, "prose"), ("\n".join(PROSE[i : i + 40].strip() for i in range(0, len(PROSE), 40)), "prose"), ("- one box\n- two boxes of tea\n- three labels\n- four", "list"),
    ("label printer, small\nspare battery for X\ntransport box Y\nsensor kit\ntraining for staff", "list"), ("a | b | c\n1 | 2 | 3\n4 | 5 | 6\n7 | 8 | 9", "table"), ("Name;Size;Date\nX;12;2020\nY;13;2021\nZ;14;2022", "table"),
    ('{"a":{"id":12,"v":[0.2,null]},"b":{"id":13,"v":[0.3,null]}}', "junk"), ("qwrtp zxcvb nmlkj hgfds " * 12, "junk"), ("#$%^ &*() _+|~ {}<> " * 10, "junk"), ("pump buy pump cheap pump sale " * 12, "junk"), ("QmFzZTY0IGRhdGEgd2l0aG91dCBlbmQ" * 8, "junk"),
    (PROSE + "\n- a\n- b", "prose"),
]


@pytest.mark.parametrize(("text", "kind"), KINDS)
def test_kinds(text, kind):
    assert quality.assess(pa.array([text]))[5].to_pylist() == [kind]


def test_statistics(spark):
    rows = {r.id: r for r in quality.statistics(table(spark, "Two words.", "", " \n", None, "a" * 50_000), "id", "text").collect()}
    assert set(rows) == {0, 1, 2, 4}
    assert (rows[0].word_count, rows[0].mean_word_length, rows[0].symbol_ratio, rows[0].ending_ratio) == (2, 4.0, 1 / 9, 1.0)
    assert rows[1].kind is None and rows[2].kind is None and rows[4].word_count == 1
    assert quality.not_prose(table(spark, PROSE, None), "id", "text").count() == 0


def test_the_line_model_on_marks_and_case():
    m = linemodel.model()
    for line in ("HOME", "Acessibilidade", "Folgen Sie uns", "Política de privacidad · Condiciones de uso · Aviso legal", "Clientes ▾"):
        assert m.of_line(line)[[0, 1]].sum() > 0.5, line


def test_the_profiles_decide(monkeypatch):
    """With the profiles of prose alone, nothing is a list, a table or junk any more."""
    table, kinds = quality.profiles()
    monkeypatch.setattr(quality, "profiles", lambda: (table[kinds == 0], kinds[kinds == 0]))
    assert {quality.assess(pa.array([t]))[5].to_pylist()[0] for t, _ in KINDS} == {"prose"}
