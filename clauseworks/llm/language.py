"""Problem 5: language of records and of their segments.

Method: multinomial naive Bayes over hashed character n-grams. The log-probability matrix is fitted on a bounded sample of
labelled rows (SAMPLE rows a language, chosen by a hash of the key; labels that the first fit contradicts are left out of the
second), broadcast (its size is fixed by BITS), and all texts are scored in numpy batches, sentence by sentence.

Null and blank texts get no language (null, confidence 0). The confidence is the mean log-likelihood lead of the best language
over the next, squashed to 0..1. Repeated rows give equal results and count once in the found cases. The whole text is scored.
"""

from __future__ import annotations

import functools
import re

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..runtime import over_batches, widen

LANGS = ("de", "en", "es", "fr", "it")
#: Labelled rows of each language that the model is fitted on, at most.
SAMPLE = 400
#: Size of the hashed tables: 2**BITS[order] cells for n-grams of 2 and of 3 letters.
BITS = {2: 13, 3: 16}
SENTENCE_WORDS = 8
#: Words a text needs at least to be judged as a whole.
TINY_WORDS = 10
#: Least mean lead per n-gram for which a sentence counts as written in a language.
LEAD = 0.9
CHUNK = 1 << 20

# Spellings of the languages' names and codes.
NAMES = {
    "en": "en eng english anglais englisch inglés ingles inglese",
    "fr": "fr fra fre french français francais französisch franzosisch francés frances francese",
    "de": "de deu ger german deutsch allemand alemán aleman tedesco",
    "es": "es esp spa spanish español espanol castellano espagnol spanisch spagnolo",
    "it": "it ita italian italiano italien italienisch",
}
_BY_NAME = {name: lang for lang, names in NAMES.items() for name in names.split()}
# Frequent function words, a prior for languages that the sample lacks.
FUNCTION_WORDS = {
    "en": "the of and to in is that for it with as on be by this are from at or an have not which shall should may can must their its when where before after under each no been will they has was",
    "fr": "le la les de des du et à en un une que qui dans pour sur par avec est sont au aux ce cette ces il elle ne pas plus doit devrait peut avant après sous chaque sans lors dès selon leur son sa ses",
    "de": "der die das und in den von zu mit des dem für auf ist nicht ein eine einer als auch es an werden aus er hat dass sie nach wird bei muss soll kann vor unter jeder jede ohne durch im am zum zur",
    "es": "el la los las de del y a en un una que por con para es se no al lo como más su sus este esta estos debe debería puede antes después bajo cada sin según durante cuando donde entre hasta desde",
    "it": "il lo la i gli le di del della dei delle e a in un una che per con su da non è si al alla come più suo questo questa deve dovrebbe può prima dopo sotto ogni senza secondo durante quando dove tra fino nel nella",
}
_SENTENCES = re.compile(r"(?<=[.!?])[\"'»”’)\]]*\s+|\n[^\S\n]*\n\s*|\s+[/|]\s+|\t+|\n(?=[^\S\n]*(?:[-•*–+]|\w{1,3}[.)])\s)")


def label_languages(label: str | None) -> list[str]:
    """Languages a label names, in any spelling (code, locale, name); none for a blank, unknown or foreign one."""
    found = []
    for part in re.split(r"[/,;+&|]", (label or "").strip().lower()):
        lang = _BY_NAME.get(part.strip()) or _BY_NAME.get(re.split(r"[-_ .(]", part.strip())[0])
        if lang and lang not in found:
            found.append(lang)
    return found


@functools.cache
def _tables() -> tuple[np.ndarray, np.ndarray]:
    """Of each code unit below 2**16: the lower-case letter it counts as (32: none), and whether it is white space."""
    fold = np.full(1 << 16, 32, np.uint32)
    space = np.zeros(1 << 16, bool)
    for i in range(1 << 16):
        c = chr(i)
        if c.isalpha():
            low = c.lower()
            fold[i] = ord(low) if len(low) == 1 else i
        space[i] = c.isspace()
    return fold, space


def _grams(segments: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Hashed 2-grams and 3-grams at each kept position, the position's segment, and each segment's words."""
    fold, space = _tables()
    raw = np.frombuffer(("\n" + "\n\n".join(segments) + "\n").encode("utf-32-le", "surrogatepass"), np.uint32)
    raw = np.where(raw < 1 << 16, raw, 32)
    lengths = np.fromiter(map(len, segments), np.int64, len(segments)) + 2
    owner = np.repeat(np.arange(len(segments), dtype=np.int32), lengths)
    blank = space[raw]
    words = np.bincount(owner[1:][blank[:-1] & ~blank[1:]], minlength=len(segments))
    c = fold[raw]
    gap = c == 32
    keep = ~gap
    keep[1:] |= ~gap[:-1]  # one separator after each word
    c, owner = c[keep], owner[keep]
    before = np.concatenate([np.array([32], np.uint32), c[:-1]])
    first = np.concatenate([np.array([32], np.uint32), before[:-1]])
    with np.errstate(over="ignore"):
        two = ((before * np.uint32(0x9E3779B1) + c) * np.uint32(0x85EBCA6B)) >> np.uint32(32 - BITS[2])
        three = (((first * np.uint32(0x9E3779B1) + before) * np.uint32(0x85EBCA6B) + c) * np.uint32(0xC2B2AE35)) >> np.uint32(32 - BITS[3])
    return two, three, owner, words


def score_segments(segments: list[str], model: tuple[np.ndarray, np.ndarray]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Log-likelihoods by segment and language, n-grams and words of each segment; a segment of any length is taken in chunks."""
    scores, grams, words = np.zeros((len(segments), len(LANGS))), np.zeros(len(segments)), np.zeros(len(segments), np.int64)

    def flush(pieces: list[str], ids: list[int]) -> None:
        two, three, owner, n = _grams(pieces)
        at = np.array(ids)
        count = np.bincount(owner, minlength=len(pieces))
        starts = np.concatenate([[0], np.cumsum(count)[:-1]])
        live = count > 0
        for k in range(len(LANGS)):
            both = model[0][k][two] + model[1][k][three]
            if live.any():
                np.add.at(scores[:, k], at[live], np.add.reduceat(both, starts[live]))
        np.add.at(grams, at, count)
        np.add.at(words, at, n)

    pieces, ids, size = [], [], 0
    for i, s in enumerate(segments):
        for a in range(0, max(len(s), 1), CHUNK):
            pieces.append(s[a : a + CHUNK])
            ids.append(i)
            size += len(pieces[-1])
            if size >= CHUNK:
                flush(pieces, ids)
                pieces, ids, size = [], [], 0
    if pieces:
        flush(pieces, ids)
    return scores, grams, words


def _counts(texts: list[str], labels: np.ndarray) -> list[np.ndarray]:
    out = [np.zeros((len(LANGS), 1 << BITS[n])) for n in (2, 3)]
    for a in range(0, len(texts), 200):
        two, three, owner, _ = _grams(texts[a : a + 200])
        at = labels[a : a + 200][owner]
        for k in range(len(LANGS)):
            for t, h in zip(out, (two, three)):
                t[k] += np.bincount(h[at == k], minlength=t.shape[1])
    return out


def _matrix(counts: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    two, three = ((np.log(c + 0.5) - np.log((c + 0.5).sum(1, keepdims=True))).astype(np.float32) for c in counts)
    return two, three


def fit(rows: pd.DataFrame) -> tuple[np.ndarray, np.ndarray]:
    """The model of rows(text, lang); rows whose label the first fit contradicts don't count in the second."""
    texts = [*rows["text"], *FUNCTION_WORDS.values()]
    labels = np.array([*map(LANGS.index, rows["lang"]), *map(LANGS.index, FUNCTION_WORDS)])
    model = _matrix(_counts(texts, labels))
    best = score_segments(texts, model)[0].argmax(1)
    sure = (best == labels) | (np.arange(len(texts)) >= len(rows))
    return _matrix(_counts([t for t, ok in zip(texts, sure) if ok], labels[sure]))


def labelled_sample(clauses: DataFrame, per_language: int = SAMPLE) -> pd.DataFrame:
    """Rows (text, lang) to fit on: of each language the per_language first by a hash of the key, a bounded number."""
    names = F.create_map(*[x for name, lang in _BY_NAME.items() for x in (F.lit(name), F.lit(lang))])
    rows = clauses.select(F.col("clause_uid").alias("uid"), F.element_at(names, F.lower(F.trim("language"))).alias("lang"), "text")
    by = Window.partitionBy("lang").orderBy(F.xxhash64("uid"), "uid")
    chosen = rows.filter(F.col("lang").isNotNull() & F.length("text").between(80, 20_000)).withColumn("place", F.row_number().over(by)).filter(F.col("place") <= per_language)
    return chosen.select("text", "lang").toPandas()


def sentences(text: str) -> list[str]:
    return [s for s in _SENTENCES.split(text) if s and not s.isspace()]


def _judge(batches, model):
    for b in batches:
        kinds, uids, labels, texts = (b.column(i).to_pylist() for i in range(4))
        segments, counts = [], []
        for t in texts:
            own = sentences(t) if t else []
            segments += own
            counts.append(len(own))
        scores, grams, words = score_segments(segments, model)
        ends = np.cumsum(counts)
        top = np.sort(scores, axis=1)
        lead = (top[:, -1] - top[:, -2]) / np.maximum(grams, 1) if len(segments) else np.zeros(0)
        best = scores.argmax(1) if len(segments) else np.zeros(0, int)
        out = {k: [] for k in ("record_kind", "record_uid", "lang", "confidence", "words", "named", "long_langs", "segment_langs", "segment_confidence")}
        for i, (kind, uid, label) in enumerate(zip(kinds, uids, labels)):
            a, z = ends[i] - counts[i], ends[i]
            total, n = scores[a:z].sum(0), grams[a:z].sum()
            order = np.argsort(total)
            sure = (total[order[-1]] - total[order[-2]]) / n if n else 0.0
            long = sorted({LANGS[k] for k, w, x in zip(best[a:z], words[a:z], lead[a:z]) if w >= SENTENCE_WORDS and x >= LEAD})
            for k, v in zip(
                out,
                (kind, uid, LANGS[order[-1]] if n else None, float(1 - np.exp(-sure)), int(words[a:z].sum()), label_languages(label), long, [LANGS[k] for k in best[a:z]], [float(1 - np.exp(-x)) for x in lead[a:z]]),
            ):
                out[k].append(v)
        texts_ = pa.list_(pa.string())
        kinds_ = (pa.string(), pa.int64(), pa.string(), pa.float64(), pa.int64(), texts_, texts_, texts_, pa.list_(pa.float64()))
        yield pa.RecordBatch.from_arrays([pa.array(v, t) for v, t in zip(out.values(), kinds_)], list(out))


SCHEMA = "record_kind string, record_uid long, lang string, confidence double, words long, named array<string>, long_langs array<string>, segment_langs array<string>, segment_confidence array<double>"


def records(clauses: DataFrame, sections: DataFrame) -> DataFrame:
    """record_kind, record_uid, label, text of both tables."""
    c = clauses.select(F.lit("clause").alias("record_kind"), F.col("clause_uid").alias("record_uid"), F.col("language").alias("label"), "text")
    return c.unionByName(sections.select(F.lit("section").alias("record_kind"), F.col("section_uid").alias("record_uid"), F.lit(None).cast("string").alias("label"), F.col("raw_text").alias("text"))).filter("record_uid is not null")


def identify(rows: DataFrame, model: tuple[np.ndarray, np.ndarray]) -> DataFrame:
    """SCHEMA of rows(record_kind, record_uid, label, text): language and confidence of each record and of each of its sentences."""
    shared = rows.sparkSession.sparkContext.broadcast(model)
    return over_batches(widen(rows), lambda batches: _judge(batches, shared.value), SCHEMA)


def found_cases(judged: DataFrame) -> DataFrame:
    """case_kind, record_uid, lang: clauses labelled wrongly or not, and records with whole sentences in several languages."""
    mixed = F.size("long_langs") >= 2
    cases = F.when(mixed, F.transform("long_langs", lambda x: F.struct(F.concat(F.lit("mixed_"), F.col("record_kind")).alias("case_kind"), x.alias("lang"))))
    wrong = (F.col("record_kind") == "clause") & (F.col("words") >= TINY_WORDS) & F.col("lang").isNotNull() & ~F.array_contains("named", F.col("lang"))
    cases = cases.when(wrong, F.array(F.struct(F.lit("label").alias("case_kind"), F.col("lang").alias("lang"))))
    return judged.select("record_uid", F.explode(cases).alias("c")).select("c.case_kind", "record_uid", "c.lang").distinct()
