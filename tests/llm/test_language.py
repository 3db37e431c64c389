import pandas as pd
import pytest

from clauseworks.llm import language as L

TEXT = {
    "en": "The operator shall verify the pressure of the pump before each shift and record the reading in the log.",
    "fr": "L'opérateur doit vérifier la pression de la pompe avant chaque prise de poste et noter la mesure dans le registre.",
    "de": "Der Bediener muss den Druck der Pumpe vor jeder Schicht prüfen und den Messwert im Protokoll aufzeichnen.",
    "es": "El operario debe verificar la presión de la bomba antes de cada turno y anotar la medida en el registro de la línea.",
    "it": "L'operatore deve verificare la pressione della pompa prima di ogni turno e annotare la misura nel registro della linea.",
}


def data():
    return pd.read_parquet("/root/testdata/sf0.01/iso_clauses.parquet").drop_duplicates("clause_uid")


@pytest.fixture(scope="module")
def model():
    rows = data()
    rows["lang"] = [(L.label_languages(x) or [None])[0] for x in rows["language"]]
    rows = rows[rows["lang"].notna() & (rows["text"].str.len() >= 80) & (rows["clause_uid"] % 2 == 0)]
    return L.fit(rows[["text", "lang"]])


def test_labels():
    assert L.label_languages("FR-fr") == ["fr"] and L.label_languages(" Français ") == ["fr"] and L.label_languages("en_US") == ["en"]
    assert L.label_languages("EN/FR") == ["en", "fr"]
    assert all(L.label_languages(x) == [] for x in (None, "", "-", "XX", "und", "MUL", "unknown"))


def test_held_out_accuracy(model):
    rows = data()
    rows["lang"] = [L.label_languages(x) for x in rows["language"]]
    rows = rows[(rows["clause_uid"] % 2 == 1) & (rows["text"].str.len() >= 80) & rows["lang"].map(len).eq(1)]
    best = L.score_segments(list(rows["text"]), model)[0].argmax(1)
    right = sum(L.LANGS[b] == x[0] for b, x in zip(best, rows["lang"]))
    assert right / len(rows) > 0.9  # some of the labels themselves are wrong


def test_chunks_add_up(model, monkeypatch):
    text = " ".join(TEXT.values()) * 30
    whole = L.score_segments([text], model)[0]
    monkeypatch.setattr(L, "CHUNK", 700)
    assert abs(L.score_segments([text], model)[0] - whole).max() < 0.02 * abs(whole).max()


def test_found_cases(spark, model, clauses, sections):
    rows = L.records(
        clauses([(1, "FR", TEXT["en"]), (2, "en-GB", TEXT["en"]), (3, None, TEXT["de"]), (4, "EN", TEXT["en"] + " " + TEXT["fr"]), (5, "XX", "None."), (6, "EN", None), (7, "", ""), (1, "FR", TEXT["en"]), (None, "FR", TEXT["en"]), (8, "EN", TEXT["en"] + ' They call it "prise de poste".')]),
        sections([(1, TEXT["es"] + "\n\n" + TEXT["it"]), (2, TEXT["es"]), (3, None)]),
    )
    got = sorted(tuple(r) for r in L.found_cases(L.identify(rows, model)).collect())
    assert got == [("label", 1, "en"), ("label", 3, "de"), ("mixed_clause", 4, "en"), ("mixed_clause", 4, "fr"), ("mixed_section", 1, "es"), ("mixed_section", 1, "it")]


def test_empty_tables(spark, model, clauses, sections):
    assert L.found_cases(L.identify(L.records(clauses([]), sections([])), model)).count() == 0
    empty = L.fit(L.labelled_sample(clauses([])))
    assert L.score_segments([TEXT["de"]], empty)[0].argmax() == L.LANGS.index("de")
