import pytest

from clauseworks.llm import residue as R

RESIDUE = [
    "Dear {{name}}, your audit is confirmed.",
    "Approved by ________ on 3.4.2026.",
    "This document is owned by [TBD] and applies from XX/XX/XXXX.",
    "{% include 'header' %}",
    "Lorem ipsum dolor sit amet sed do eiusmod.",
    "Access denied.\nYou do not have permission to view this procedure.",
    "Please enable JavaScript to continue using this application.",
    "Erreur 404 : le document demandé est introuvable sur ce serveur.",
    "The valve is closed.\n\n502 Bad Gateway",
]
CONTENT = [
    'In the letter model, the mark "{{site}}" stands for the site and is replaced before sending.',
    "Dans la lettre type, la marque « {{site}} » désigne le site et est remplacée avant envoi.",
    "The fields [A] to [F] of the plan mark the assembly points.",
    "Workstations of the portal must have JavaScript enabled by the IT team.",
    "If the terminal shows an error such as 404 or 500, the operator calls the help desk.",
    'Forms with filler such as "lorem ipsum" are refused.',
    "An access denied message on the badge reader is recorded in form IT-101.",
    "The value lies between $ 40 and $ 60, see [annex B].",
    "",
    "   ",
    "None.",
]


@pytest.mark.parametrize("text", RESIDUE)
def test_residue_is_found(text):
    assert any(sure for _, _, sure in R.findings(text))


@pytest.mark.parametrize("text", CONTENT)
def test_content_stays(text):
    assert not any(sure for _, _, sure in R.findings(text))


def test_numbers_addresses_and_dates_are_masked():
    assert R.normalise("See http://a.b/c on 3.4.2026, code 17") == R.normalise("see http://x.y on 12.11.2025, code 5")


def test_loose_messages_need_to_recur(documents):
    loose = "Please let the server draw your frame"
    once = R.detect_residue(documents([(1, loose, "a"), (2, "The pump is off.", "b")]))
    assert once.count() == 0
    often = R.detect_residue(documents([(i, loose, "ab"[i % 2]) for i in range(4)]))
    assert sorted(r["doc_id"] for r in often.collect()) == [0, 1, 2, 3]


@pytest.mark.parametrize("text", ["Please let the server draw your frame", "We regret that access denied", "Note for readers: your session has expired and must be renewed", "Bitte den Script Ihrer Seite starten", "Your portal wants " + "more " * 60 + "cookies"])
def test_messages_recur_within_one_source(documents, text):
    assert R.detect_residue(documents([(i, text, "qhse_portal") for i in range(3)])).count() == 3
    assert R.detect_residue(documents([(i, text, None) for i in range(3)])).count() == 3
    assert R.detect_residue(documents([(i, text, "qhse_portal") for i in range(2)] * 2)).count() == 0


def test_frame_of_the_portal_is_found_by_recurrence(documents):
    """A segment in no phrase list, known only by the company it keeps; and what stands beside a message in copies stays genuine."""
    frame, genuine = "Weiter zum Hauptverzeichnis", "The pump of the line is checked."
    rows = [(i, f"Access denied.\nNr {'abcdefghijkl'[i]}\n{frame}", "ab"[i % 2]) for i in range(12)]
    rows += [(50, f"{frame}\nOther words.", "a"), (51, frame.upper(), None)]
    rows += [(60 + i, f"Access denied.\n{genuine}", "ab"[i % 2]) for i in range(20)] + [(90, genuine, "a"), (91, "Nr a", "b")]
    got = {r["doc_id"]: r["kinds"] for r in R.detect_residue(documents(rows)).collect()}
    assert got[50] == got[51] == ["frame"] and got[0] == ["frame", "message"] and got[60] == ["message"]
    assert not {90, 91} & set(got)
    narrow = [(i, t, "a") for i, t, _ in rows]
    assert 50 not in {r["doc_id"] for r in R.detect_residue(documents(narrow)).collect()}


@pytest.mark.parametrize("text", ["test test 123 test test", "bla 1 bla 2 bla", "Text, text. text 4 text"])
def test_filler_with_numbers(text):
    assert R.filler_in(text.lower()) and any(sure for _, _, sure in R.findings(text))


def test_long_segments_are_read():
    text = "Traceback (most recent call last): " + "in handler of request " * 20
    assert any(sure for _, _, sure in R.findings(text))


def test_clean_set_keeps_all_columns(documents):
    docs = documents([(1, RESIDUE[0], "a"), (2, "Real text.", None), (3, None, "b")])
    left = R.without_residue(docs)
    assert left.columns == docs.columns and sorted(r["doc_id"] for r in left.collect()) == [2, 3]
