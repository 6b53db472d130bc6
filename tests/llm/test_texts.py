import datetime as dt
import random

import pytest

from graphloom.llm import neardup, repetition, residue, scans

T0 = dt.datetime(2024, 1, 1)
VOCAB = [a + b + c for a in ("ba", "co", "du", "fe", "gi", "ho") for b in ("lan", "mer", "nit", "por") for c in ("do", "ka", "sti", "vu", "ze")]


def words(rng, n):
    return [rng.choice(VOCAB) for _ in range(n)]


def shingles(text, n=3):
    import re

    w = re.findall(r"[^\W_]+", text.lower())
    return {tuple(w[i : i + n]) for i in range(len(w) - n + 1)}


def edited(rng, w, share):
    return [rng.choice(VOCAB) if rng.random() < share else x for x in w]


@pytest.mark.parametrize("hot,sampled,sure", [(256, 64, 16), (3, 64, 16), (256, 1, 4)])
def test_near_duplicates_equal_brute_force(spark, monkeypatch, hot, sampled, sure):
    monkeypatch.setattr(neardup, "HOT", hot)  # 3: most keys are left to the exact join
    monkeypatch.setattr(neardup, "SAMPLED", sampled)  # 1 and 4: common keys are left out before
    monkeypatch.setattr(neardup, "SURE", sure)
    rng = random.Random(11)
    texts = []
    block = words(rng, 60)
    for _ in range(25):
        w = words(rng, rng.randint(40, 160))
        texts += [" ".join(w), " ".join(edited(rng, w, 0.05)), " ".join(w[3:] + w[:3]), " ".join(block + w[:50])]
    texts += [texts[0], texts[0].upper() + "!", None, "", "two words", "  ", "x " * 4000]
    rows = [(f"d{i:03}", t, "k") for i, t in enumerate(texts)]
    docs = spark.createDataFrame([*rows, rows[0], (None, texts[1], "k")], "doc_id string, content string, cls string")
    got = {(r.doc_id_a, r.doc_id_b) for r in neardup.grouped_pairs(docs).collect()}
    sets = {i: shingles(t or "") for i, t, _ in rows}
    want = set()
    for i in sets:
        for j in sets:
            if i < j and sets[i] and sets[j] and len(sets[i] & sets[j]) >= 0.6 * len(sets[i] | sets[j]):
                want.add((i, j))
    assert got == want and len(want) > 40


def test_near_duplicates_of_nothing(spark):
    docs = spark.createDataFrame([("a", None), ("b", "")], "doc_id string, content string")
    assert neardup.grouped_pairs(docs).count() == 0 and neardup.grouped_pairs(docs.limit(0)).count() == 0


def test_groups_follow_links(spark):
    rng = random.Random(21)
    a = words(rng, 90)
    b, c = edited(rng, a, 0.03), words(rng, 80)
    chain = [a, b, edited(rng, b, 0.03), edited(rng, edited(rng, b, 0.03), 0.03)]
    rows = [(f"a{i}", " ".join(w)) for i, w in enumerate(chain)] + [("b0", " ".join(c)), ("b1", " ".join(c)), ("c0", " ".join(words(rng, 70))), ("n", None), ("s", "two words")]
    docs = spark.createDataFrame([(i, t, 7) for i, t in [*rows, rows[0]]], "doc_id string, content string, group_id int")
    got = {r.doc_id: (r.group_id, r.n) for r in neardup.groups(*neardup.near_duplicates(docs)).collect()}
    assert got == {**{f"a{i}": ("a0", 4) for i in range(4)}, "b0": ("b0", 2), "b1": ("b0", 2), "c0": ("c0", 1)}
    assert neardup.groups(*neardup.near_duplicates(docs.limit(0))).count() == 0


def test_golay_patterns_are_complete():
    table, counts = neardup.patterns()
    assert counts.sum() == 1 + 23 + 253 + 1771 + 8855 and counts.min() >= 1
    assert (neardup.syndrome(table[:, 0]) == range(2048)).all()


def share(text, n=4):
    import re

    w = re.findall(r"[^\W_]+", (text or "").lower())
    s = [tuple(w[i : i + n]) for i in range(len(w) - n + 1)]
    return 1 - len(set(s)) / len(s) if s else 0.0


def test_repetition_equals_brute_force(spark):
    rng = random.Random(2)
    texts = [" ".join(words(rng, 80)) for _ in range(40)]
    for k in range(60):
        w = words(rng, 20)
        texts.append(" ".join(w * rng.randint(1, 5) + words(rng, rng.randint(0, 60))))
    texts += [None, "", "one", "a b c d", "go " * 3000, "a b c d e " * 2]
    rows = [(f"s{i}", t, T0, 1.0) for i, t in enumerate(texts)]
    table = spark.createDataFrame([*rows, ("s3", texts[3], T0 + dt.timedelta(1), 2.0), (None, "x", T0, 0.0)], "id string, content string, last_updated timestamp, score double")
    got = {r.id: r for r in repetition.repetition(table).collect()}
    assert len(got) == len(rows)
    for i, t, *_ in rows:
        assert got[i].repeated_share == pytest.approx(share(t)) and got[i].repeated == (share(t) >= 0.3)
    assert repetition.repetition(table.limit(0)).count() == 0


CASES = [
    "Dear {{ name }},\n\nThe file of {{ owner }} was linked.", "PERSON: <OWNER>\nDATE: &lt;date&gt;", "Only 18 of [INSERT TITLE] approved the seminar.", "A - works_for - _____________\n______ - in - B",
    "lorem ipsum dolor sit amet velit turpis nulla", "blah blah blah blah blah blah", "Heading 1\nBody copy here.\n\nHeading 2\nTo be written.", "Dies ist ein Blindtext. Bitte durch den echten Inhalt ersetzen.",
    "Error 404\nNot Found\n\nReference: 01ddb32e", "Traceback (most recent call last):\n  File \"x.py\", line 8, in f\n    raise E('a')\nE: b", "Zugriff verweigert. Bitte melden Sie sich an.", "Erreur 504 : la page demandée est introuvable.",
    "Please enable JavaScript to view this page.", "<noscript>scripting is switched off in your browser.</noscript>", "Veuillez activer JS pour afficher cette page.", "Home | News | About\n\n429 Too Many Requests\nThe requested URL /a was not served.\n\nImprint Privacy Contact",
]
REAL = "The committee met in spring and approved the annual budget for the northern archive after a long debate. " * 4
REPORTS = [
    None, "", " ", "?", "annex", "Only 35 of 402 boards pruned the canal.", REAL + "The viewer needs JavaScript, so a static export is kept as well.", REAL + "In the template the token ${contact} stands for the value of each row.",
    REAL + "Printers fill unfinished pages with dummy text such as lorem ipsum.", REAL + "The gateway answered 56 requests with 403, all from one feed.", "05:24:59 ERROR cache: Only 26 of 379 clusters failed.\n05:25:00 INFO cache: done",
    REAL + "Sets such as {a, b} and shapes [8, 72] were compared.", REAL * 40,
]


def test_residue(spark):
    rows = [(i, t, None if i % 3 else "h", "c") for i, t in enumerate(CASES + REPORTS)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string, _host string")
    got = {r.doc_id for r in residue.residue(docs).filter("excluded").collect()}
    assert got == set(range(len(CASES)))
    assert residue.residue(docs.limit(0)).count() == 0


def test_recurrent_lines_of_a_host_are_taken_off(spark):
    footer = " ".join(f"word{c}" for c in "abcdefghijklmnopqrstuvwxyz") + " and some more words of the long footer of this host"
    texts = [f"Your session has expired.\n{footer} {i}" for i in range(4)]
    docs = spark.createDataFrame([(i, t, "h" if i else "other") for i, t in enumerate(texts)], "doc_id long, text string, source string")
    assert {r.doc_id for r in residue.residue(docs).filter("excluded").collect()} == {1, 2, 3}


def page(*lines):
    return "\n".join(lines)


@pytest.mark.parametrize("one_of", [2000, 1])
def test_scans(spark, monkeypatch, one_of):
    monkeypatch.setattr(scans, "ONE_OF", one_of)  # 1: all words are looked up by the join
    base = "the narrow carriage and the marine glacier annotated every early photograph while the costly ministry financed the quarry of a cross-border archive and compared the hollow furnace with its catalogue"
    clean = [base + f" in year{i} of the seminar." for i in range(30)]
    noisy = {
        "hyphen": (page("The narrow carriage and the marine gla-", "cier annotated every early photograph."), {"hyphenation"}, "The narrow carriage and the marine glacier annotated every early photograph."),
        "own": (page("The costly ministry of a cross-", "border archive compared it."), set(), None),
        "hung": (page("The hollow pre-", "and early furnace compared it."), set(), None),
        "misread": ("The narr0w carriage and thc marine glacier annot@ted every furnace.", {"misread"}, "The narrow carriage and the marine glacier annotated every furnace."),
        "split": ("The mar ine glacier of thehollow archive and thc furnace.", {"misread"}, "The marine glacier of the hollow archive and the furnace."),
        "codes": ("Sample C-78 and lot B734 compared a4f0b1 with Zoquemor.", set(), None),
        "pages": (page("The narrow carriage and the", "marine glacier annotated", "every early", "Page 1", "Marine Notes", "photograph while the costly", "ministry financed the quarry", "of a", "Page 2", "Marine Notes", "hollow archive."), {"page_furniture"}, None),
        "labels": (page("Note", "The narrow carriage.", "", "Note", "The marine glacier.", "", "Note", "The early photograph."), set(), None),
        "table": (page("8", "237", "12", "375", "9"), set(), None),
        "null": (None, set(), None), "empty": ("", set(), None), "blank": (" \n ", set(), None),
    }
    rows = [(f"c{i}", t, T0, "z") for i, t in enumerate(clean)] + [(k, v[0], T0, "z") for k, v in noisy.items()]
    docs = spark.createDataFrame([*rows, ("hyphen", noisy["hyphen"][0], T0 + dt.timedelta(1), "z"), (None, "x", T0, "z")], "doc_id string, content string, ingested_at timestamp, noise string")
    got = {r.doc_id: r for r in scans.repair(docs).collect()}
    assert len(got) == len(rows)
    for k, (text, kinds, repaired) in noisy.items():
        assert set(got[k].noise) == kinds, k
        if one_of == 1 and k == "split":
            continue  # none of its words is common
        assert got[k].repaired == (repaired if repaired else text if not kinds else got[k].repaired)
    assert "Page" not in got["pages"].repaired and all(not got[f"c{i}"].noise for i in range(30))
    assert scans.repair(docs.limit(0)).count() == 0


def test_scans_are_decoded_jointly(spark):
    base = "the narrow carriage and the marine glacier annotated every early photograph while the costly ministry financed the quarry of a border archive and compared the hollow furnace with its catalogue"
    clean = [base + f" in year{i} of the seminar." for i in range(70)]
    noisy = {
        "alone": ("The mar ine glacier of  thehollow archive\nand its furnace.", set(), "The marine glacier of  the hollow archive\nand its furnace."),
        "three": ("The pho togr aph of the archive.", set(), "The photograph of the archive."),
        "split and misread": ("The rnini stry of the archive compared thc furnace.", {"misread"}, "The ministry of the archive compared the furnace."),
        "broken and misread": (page("The narrow carriage and the marine gla-", "c1er annotated every photograph."), {"hyphenation", "misread"}, "The narrow carriage and the marine glacier annotated every photograph."),
        "together and misread": ("The archive of thecatal0gue and the furnace.", {"misread"}, "The archive of the catalogue and the furnace."),
        "name": ("The archive of Zoquemor and Mar Ine compared it.", set(), None),
    }
    docs = spark.createDataFrame([(f"c{i}", t, T0) for i, t in enumerate(clean)] + [(k, v[0], T0) for k, v in noisy.items()], "doc_id string, content string, ingested_at timestamp")
    got = {r.doc_id: r for r in scans.repair(docs).collect()}
    for k, (text, kinds, repaired) in noisy.items():
        assert (set(got[k].noise), got[k].repaired) == (kinds, repaired or text), k
    assert all(not got[f"c{i}"].noise and got[f"c{i}"].repaired == t for i, t in enumerate(clean))


def test_strings_have_a_key_in_common_with_what_they_are_misread_from():
    rng = random.Random(4)
    tables = [(a, b) for table in (scans.SIGNS, scans.LETTERS) for a, bs in table.items() for b in bs]
    for _ in range(3000):
        word = "".join(rng.choice("abcdefghijklmnoprstuvwyz") for _ in range(rng.randint(3, 12)))
        read = word
        for _ in range(rng.randint(1, 2)):
            a, b = rng.choice(tables)
            at = [i for i in range(len(read)) if read.startswith(b, i)]
            if at:
                i = rng.choice(at)
                read = read[:i] + a + read[i + len(b) :]
        assert set(scans.alike(word)) & set(scans.alike(read)), (word, read)


def test_residue_reads_every_text(spark):
    texts = [
        "Duis aute irure dolor in reprehenderit in voluptate velit esse cillum dolore eu fugiat nulla pariatur.",
        "Excepteur sint occaecat cupidatat non proident, sunt in culpa qui officia deserunt mollit anim id est laborum.",
        "Sed do eiusmod tempor incididunt ut labore et dolore magna aliqua.",
        "405 Method Not Allowed",
        "408 Request Timeout",
        "409 Conflict",
        "501 Not Implemented",
        "You do not have permission to view this page.",
        "We couldn't find that p",
        "Quarterly figures rose in the north. " + "wave " * 5,
        "The survey covered nine sites in the north and the south.",
    ]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").selectExpr("*", "'h' AS source")
    rows = {r.doc_id: r for r in residue.residue(docs).collect()}
    assert set(rows) == set(range(10))
    assert {k for k, r in rows.items() if r.excluded} == set(range(9)) and rows[9].filler == 5


def test_copies_of_a_text_are_no_boilerplate(spark):
    real = "\n".join(f"{c} {REAL}" for c in ("North", "South", "East")) + "\nPlease enable JavaScript to view the map."
    docs = spark.createDataFrame([(i, real, "h") for i in range(5)], "doc_id long, text string, source string")
    rows = residue.residue(docs).collect()
    assert len(rows) == 5 and not any(r.excluded for r in rows) and all(r.rest > 200 for r in rows)


def test_lines_recur_as_a_share_of_the_texts_of_a_host(spark):
    letters = [a + b for a in "abcdefghijklmnopqrstuvwxyz" for b in "abcdefghijklmnopqrstuvwxyz"]
    texts = [f"note {x}\nfooter\n" + ("an ordinary line" if i < 3 else "") for i, x in enumerate(letters)]
    docs = spark.createDataFrame([(t, "h") for t in texts] + [("an ordinary line\n" + x, "small") for x in "abc"], "text string, source string")
    names = {r.h: r.line for r in spark.createDataFrame([("footer",), ("an ordinary line",)], "line string").selectExpr("line", "xxhash64(line) AS h").collect()}
    assert {(r["_host"], names[r["_hash"]]) for r in residue.recurrent_lines(docs).collect()} == {("h", "footer"), ("small", "an ordinary line")}


PAGES = ["A blue lamp for the desk.", "The oak chair comes with a cushion.", "Six glasses of green crystal.", "This rug was woven by hand.", "A kettle with a whistle."]


def test_recurrent_lines_are_taken_off_with_their_evidence(spark):
    notice = "Please enable JavaScript for the best experience."
    report = "\n".join(f"{c} {REAL}" for c in ("North", "South")) + "\nError 404 was the most frequent answer of the summer."
    rows = [(p + "\n" + notice, "shop") for p in PAGES] + [(PAGES[0] + "\n" + notice, "other"), (notice, "shop")] + [(f"Error 404\nNot Found\nReference: a{i}", "shop") for i in range(9)] + [(report, "news")] * 3
    docs = spark.createDataFrame([(i, *r) for i, r in enumerate(rows)], "doc_id long, text string, source string")
    got = {r.doc_id: r for r in residue.residue(docs).collect()}
    assert {i for i, r in got.items() if r.excluded} == {5, 6, *range(7, 16)}
    assert set(got) == {5, 6, *range(7, 16), 16, 17, 18} and got[16].rest > 100  # no evidence is left on the pages of the shop


# Written along with the general forms, which were corrected by them; forms that weren't are found far less often (README).
WRITTEN = [
    "This webpage isn't available right now.", "Hmm. We're having trouble finding that site.", "HTTP ERROR 431", "Diese Website ist nicht erreichbar.", "Le serveur ne répond pas.", "No tiene permiso para acceder a este recurso.",
    "Hello :first_name, your order :order_id has shipped.", "Hi %(name)s, welcome back.", "Name: [NAME]", "Bonjour {prenom}, votre rendez-vous est fixé.", "Este sitio requiere JavaScript.", "Pour une meilleure expérience, JavaScript doit être activé.",
    "Bitte erlauben Sie JavaScript in Ihrem Browser.", "Nam libero tempore, cum soluta nobis est eligendi optio cumque nihil impedit.", "Your content goes in this box.", "Hier könnte Ihr Text stehen.", "Ici votre texte.", "Cette page n'existe plus.",
    "La página solicitada no existe.", "Ce service est temporairement indisponible.", "Scheduled downtime.", "Verify you are human by completing the action below.", "Please wait while we verify your browser.",
    "500 - Internal server error. There is a problem with the resource you are looking for, and it cannot be displayed.", "Something broke on our side. Try again later.", "The file you requested has been moved or deleted.", "Too many redirects.",
    "Connection reset by peer", "SQLSTATE[HY000] [2002] Connection refused", "Fatal error: Uncaught TypeError in /var/www/x.php on line 12", "Segmentation fault (core dumped)", "Dear <<First Name>>,", "{% if user %}Hello{% endif %}", "Insert your text here",
    "Text folgt.", "Texto pendiente.", "Page under construction", "Dear %s, thank you", "$name has been invited by $host_name",
]
REAL_SHORT = [
    "The ministry denied access to the archive in 1971.", "Forty requests failed in the pilot and were repeated by hand.", "The page was moved from the second to the third volume.", "A service for the lost fishermen is held in May.", "Error bars show one standard deviation.",
    "The connection between the two valleys was lost in the flood.", "JavaScript is a programming language first released in 1995.", "The script of the play was not found in the estate.", "We could not find any trace of the second bridge.", "The site is under excavation since spring.",
    "Latin: 'dolor' means pain and 'magna' means great.", "See [Figure 3] and [12].", "Set {a, b} was compared.", "The server of the inn dropped the tray.", "Prices rose by 5% and 12%.", "Email ops@example.org for #4521.", "Ratio 3:1 at 10:45.",
    "Die Verbindung zwischen den Orten wurde 1903 eingestellt.", "La conexión entre las dos ciudades se abrió en 1910.", "Le service des archives est ouvert le lundi.", "Loading of the ship took four days.", "The test of the new pump is planned.", "It cost $5 or 10 % more.",
    "The link between diet and sleep was denied by two authors.", "A sample text of each charter is kept in the vault.",
]


def test_residue_of_odd_tables(spark):
    rows = [(1, "x" * 300_000 + " {{ name }}", None), (2, "\ufeff\u200b", "h"), (3, "{{name}}\n" * 5000, "h"), (3, "{{name}}\n" * 5000, "h"), (None, "Error 404", "h"), (4, "<title>", "h"), (5, "<title>A</title> real words follow here", "h")]
    docs = spark.createDataFrame([(*r, 0) for r in rows], "doc_id long, text string, source string, excluded int")
    got = {r.doc_id: (r.unfilled, r.excluded) for r in residue.residue(docs).collect()}
    assert got[1] == (1, True) and got[3] == (5000, True) and got[None][1] and got[4] == (1, True) and 2 not in got and 5 not in got


def test_general_forms(spark):
    docs = spark.createDataFrame([(i, t, f"h{i}") for i, t in enumerate(WRITTEN + REAL_SHORT)], "doc_id long, text string, source string")
    got = {r.doc_id for r in residue.residue(docs).filter("excluded").collect()}
    assert len(got & set(range(len(WRITTEN)))) >= 0.95 * len(WRITTEN) and len(got - set(range(len(WRITTEN)))) <= 1
