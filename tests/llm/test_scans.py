import itertools
import random

import pytest

from clauseworks.llm import scans as S

OPEN = ["The line operator shall verify the pressure of the dosing pump.", "The safety delegate shall record the noise readings in the log.", "Each subcontractor shall sign the permit before the shift.", "The laboratory shall archive the calibration certificate of the balance."]


@pytest.mark.parametrize(
    "seen,meant",
    [("rnaintenance", "maintenance"), ("lirnite", "limite"), ("av@nt", "avant"), ("Druckpriifungen".lower(), "druckprüfungen"), ("dénve", "dérive"), ("condilionnement", "conditionnement"), ("urmötigen", "unnötigen"), ("sha1l", "shall"), ("wasserverbrau(h", "wasserverbrauch"), ("archiyo", "archivo"), ("grünclen", "gründen")],
)
def test_misread_words_share_a_skeleton_and_cost_little(seen, meant):
    assert S.skeleton(seen) == S.skeleton(meant) and S.glyph_cost(seen, meant) <= 2


def test_other_words_cost_more():
    assert S.glyph_cost("pump", "tank") > 6


def test_furniture_and_hyphens():
    text = "The operator shall\n\nIT-545 Records of the silo | Page 23\n\n17/40\nverify the main-\ntenance log."
    clean, furniture, cuts = S.clean_lines(text)
    assert clean == "The operator shall verify the maintenance log." and furniture == 2 and cuts == 1


@pytest.mark.parametrize("text", ["Only wrapped\nbetween its words and\nEN-137 applies here.", "1. one\n2. two\n\na) three\nb) four", "None.", "12", "Line one.\n\nLine two."])
def test_undamaged(text):
    assert S.clean_lines(text)[1:] == (0, 0)


def test_blank():
    assert S.clean_lines("") == ("", 0, 0) and S.clean_lines("\n \n") == ("", 0, 0) and S.clean_lines(None) == ("", 0, 0)


@pytest.fixture(scope="module")
def corpus():
    rng = random.Random(3)
    rows = [(i, " ".join(rng.choices(OPEN, k=6))) for i in range(400)]
    rows[7] = (7, "The line operator sha1l verify the pressurc of the closing pump. The safety de1egate shall rec0rd the noise readings.")
    rows[8] = (8, "The safety delegate shall re-\ncord the noise readings in the log.")
    rows += [(8, rows[8][1]), (500, None), (501, ""), (None, "x"), (502, "sha11" * 2000)]
    return rows


def test_found_and_repaired(spark, sections, corpus):
    clean = S.cleaned(sections(corpus))
    hurt, _ = S.damage(clean)
    assert sorted(r["section_uid"] for r in hurt.collect()) == [7, 8]
    got = {r["section_uid"]: r["text"] for r in S.repair(sections(corpus)).collect()}
    assert "operator shall verify the pressure" in got[7] and "delegate shall record" in got[7]
    assert got[8] == "The safety delegate shall record the noise readings in the log." and got[500] == ""
    assert len(got) == len({u for u, _ in corpus if u is not None})


def test_single_corrections_and_short_words(spark, sections, corpus):
    texts = {10: "The laboratory shall archivc the calibration certificate of the balance.", 11: "Each subcontractor shall sign tbe permit before the shift.", 12: "The line operator shal| verify the pressure of the dosing pump.", 13: "Each subcontractor shall sign the permit !n the shift."}
    rows = [(u, texts.get(u, t + " The record is kept in the log." if u and t and u < 400 and u != 7 else t)) for u, t in corpus]
    hurt, _ = S.damage(S.cleaned(sections(rows)))
    assert sorted(r["section_uid"] for r in hurt.collect()) == [7, 8, 10, 11, 12, 13]
    got = {r["section_uid"]: r["text"] for r in S.repair(sections(rows)).collect()}
    assert [got[u] for u in (10, 11, 12, 13)] == [OPEN[3], OPEN[2], OPEN[0], "Each subcontractor shall sign the permit in the shift."]


@pytest.mark.parametrize("text,words", [("wil| be, !n use", ["wil|", "be", "!n", "use"]), ("Stop! (see note) $40 a 12€ (ontrol", ["stop", "see", "note", "a", "(ontrol"]), ("Stop! Then | next", ["stop", "then", "next"])])
def test_odd_glyphs_at_edges(text, words):
    assert S.tokens(text) == words


def test_empty(spark, sections):
    assert S.repair(sections([])).count() == 0
    assert S.damage(S.cleaned(sections([(1, None)])))[0].count() == 0


def test_vectors_tell_contexts_apart():
    import numpy as np

    pairs = [(a, b, 50.0) for a, b in itertools.permutations((0, 1, 2), 2)] + [(a, b, 50.0) for a, b in itertools.permutations((3, 4, 5), 2)]
    a, b, n = (np.array(x) for x in zip(*pairs))
    rng = np.random.default_rng(0)
    v, u = S.sgns(a, b, n, np.ones(6), ((rng.random((6, 8)) - 0.5) / 8, np.zeros((6, 8))), 1 << 17, 1)
    assert v[0] @ u[1] > v[0] @ u[4] + 1


def test_repaired_text_equals_the_clean_one(spark, sections):
    """Held-out accuracy: known clean texts are damaged by single glyphs, cut words and a page line; the share of words that come back, and none else changed."""
    rng = random.Random(12)
    clean = {i: " ".join(rng.choices(OPEN, k=6)) for i in range(400)}
    swaps = [(key, value) for key, values in S.CONFUSIONS.items() for value in values.split() if len(value) + len(key) >= 2 and S.skeleton(key) == S.skeleton(value)]
    damaged, hurt = dict(clean), 0
    for i in range(0, 400, 16):
        words = clean[i].split(" ")
        for k in rng.sample([k for k, w in enumerate(words) if len(w) >= 6 and w.isalpha()], 2):
            key, value = rng.choice([(a, b) for a, b in swaps if b in words[k][1:]] or [("", "")])
            at = words[k].find(value, 1)
            if key and at > 0:
                words[k] = words[k][:at] + key + words[k][at + len(value) :]
                hurt += 1
        cut = next(k for k, w in enumerate(words) if len(w) >= 8 and w.isalpha())
        words[cut] = words[cut][:4] + "-\n" + words[cut][4:]
        damaged[i] = " ".join(words[:10]) + "\n\n- 12 -\n\n" + " ".join(words[10:])
    got = {r["section_uid"]: r["text"] for r in S.repair(sections(list(damaged.items()))).collect()}
    wrong = sum(a != b for i in clean for a, b in zip(got[i].split(), clean[i].split()))
    print("damaged", hurt, "left", wrong)
    assert hurt >= 30 and wrong <= 0.2 * hurt and all(len(got[i].split()) == len(clean[i].split()) for i in clean)
