"""Splitting: an exact round trip over every range size, and the operator on a small session."""

import random
import time

import pandas as pd
import pytest

from clauseworks.llm import splitting as S


def pieces_of(text, size, limit, overlap):
    bodies = [text[i : i + size] for i in range(0, max(len(text), 1), size)]
    parts = [(text[max(0, i * size - S.HALO) : i * size], b, text[(i + 1) * size : (i + 1) * size + S.HALO]) for i, b in enumerate(bodies)]
    rows = pd.DataFrame([(i, *S.boundaries(*p)) for i, p in enumerate(parts)], columns=["range_no", "words", "at", "strength"])
    out = {}
    for r in S._stitch(limit, overlap)(("k", 1), rows).itertuples():
        out[r.piece_no] = out.get(r.piece_no, "") + S.cut_body(parts[r.range_no][0], parts[r.range_no][1], r.first, r.end)
    return [out[k] for k in sorted(out)]


@pytest.mark.parametrize("seed", range(150))
def test_round_trip(seed):
    rng = random.Random(seed)
    words = [rng.choice(["a", "bb.", "ccc,", "dddd", "eeeeeeeee!", "x" * rng.randint(1, 40)]) for _ in range(rng.randint(1, 200))]
    text = "".join(w + rng.choice([" ", "\n\n", "  ", " ", " "]) for w in words)
    pieces = pieces_of(text, rng.choice([3, 7, 16, 50, 1000]), 30, 5)
    assert all(len(p.split()) <= 30 for p in pieces)
    got = pieces[0].split()
    for p in pieces[1:]:
        assert got[-5:] == p.split()[:5]
        got += p.split()[5:]
    assert got == words
    assert all(p in text for p in pieces)


def items(spark, rows):
    return spark.createDataFrame([("section", u, t, 7) for u, t in rows], "record_kind string, record_uid long, text string, words int")


def long_text(n, rng):
    return "".join(rng.choice(["word", "pump,", "end."]) + rng.choice([" ", " ", "\n\n", " "]) for _ in range(n))


def test_operator(spark):
    rng = random.Random(1)
    texts = {1: long_text(600, rng), 2: long_text(601, rng), 3: long_text(5000, rng), 4: "", 5: None, 6: "x" * 5000, 7: "one two"}
    rows = items(spark, [*texts.items(), (2, texts[2]), (None, texts[3])])
    assert sorted(r["record_uid"] for r in S.oversized(rows).collect()) == [2, 3]
    got = {}
    for r in S.split_texts(rows, size=700).collect():
        assert len(r["text"].split()) == r["words"] <= 600
        got.setdefault(r["record_uid"], {})[r["piece_no"]] = r["text"]
    assert sorted(got) == [1, 2, 3, 6, 7] and len(got[1]) == 1
    for uid, pieces in got.items():
        words = pieces[0].split()
        for no in range(1, len(pieces)):
            assert words[-60:] == pieces[no].split()[:60]
            words += pieces[no].split()[60:]
        assert words == texts[uid].split()
    assert S.split_texts(rows.limit(0)).count() == 0


def test_ranges_and_whole_texts_give_the_same_pieces(spark):
    rng = random.Random(9)
    rows = items(spark, [(u, long_text(n, rng)) for u, n in enumerate((700, 1300, 4000, 9000))])
    cut = lambda size: sorted((r["record_uid"], r["piece_no"], r["words"], r["text"]) for r in S.split_texts(rows, size=size).collect())
    assert cut(1 << 16) == cut(512) and max(r[1] for r in cut(512)) > 10


def test_giant_text_in_linear_time():
    """Ranges are cut one at a time; ten times the text takes about ten times as long."""
    spent = []
    for n in (2_000_000, 20_000_000):
        text = "word pump, end. " * (n // 16)
        began = time.process_time()
        assert sum(S._own_words(x, y) for x, y, _ in S.slices(text)) == n // 16 * 3
        spent.append(time.process_time() - began)
    assert spent[1] < 25 * max(spent[0], 0.02)


def test_boundaries_are_preferred():
    text = "a b c d e f g. h i j\n\nk l m n o p q r s t u"
    assert S.place_cuts(*map(lambda x: x, _table(text)), limit=12, overlap=2)[0] == (0, 10)


def _table(text):
    import numpy as np

    n, at, strength = S.boundaries("", text, "")
    return n, np.array(at), np.array(strength)


def test_files_in_byte_ranges(spark, tmp_path):
    rng = random.Random(6)
    text = "".join(rng.choice(["größe", "déjà", "pump.", "日本"]) + rng.choice([" ", "\n\n", " "]) for _ in range(4000))
    path = tmp_path / "long.txt"
    path.write_text(text, encoding="utf-8")
    (tmp_path / "empty.txt").write_text("")
    rows = S.split_files(spark, [str(path), str(tmp_path / "empty.txt")], size=1000).orderBy("piece_no").collect()
    words = rows[0]["text"].split()
    for r in rows[1:]:
        assert words[-60:] == r["text"].split()[:60]
        words += r["text"].split()[60:]
    assert words == text.split() and all(len(r["text"].split()) <= 600 for r in rows)
