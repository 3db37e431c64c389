"""Problem 1: noise in text from scanned pages.

Method: running headers, footers and page numbers are taken out of the lines, words cut at a line end are joined and wrapped lines
flow into paragraphs. Skip-gram vectors are learned from the corpus' own words; each rare word is linked to a far more frequent
neighbour that differs by plausible glyph edits (found by an equi-join on a stroke skeleton, no pairs of all words), and a link
is applied where the vectors of the surrounding words agree.

Counts, links and vectors cover all sections. The vector vocabulary holds the words above a share of all tokens, so its size is
bounded whatever the corpus. Null, blank and tiny texts carry no damage; repeated deliveries of a section count once; the
confidence column isn't needed, as it follows the damage only loosely.
"""

from __future__ import annotations

import functools
import re
import unicodedata
from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..runtime import over_batches, settle

#: A word is in the vector vocabulary from this share of all tokens (at most 1 / SHARE words) and this count.
SHARE, LEAST = 4e-6, 8
#: A neighbour must be so many times as frequent as the word it replaces.
RATIO = 12
DIM, NEGATIVE, WINDOW, ROUNDS = 16, 5, 2, 3
#: Least agreement (mean of vector products, in nats above chance) of the context with the correction.
AGREES = -0.5
#: Evidence (agreement and log of the frequency ratio, less the glyph edits) from which a single correction, or one of a very short word, stands by itself; the word meant must then be 4 * RATIO times as frequent.
SURE = 4.0

# ---------------------------------------------------------------- furniture, hyphens, reflow
_PAGE = r"(?:page|seite|página|pagina|pág|pag|p|s|blatt|folio)\.?"
_PAGE_LINE = re.compile(rf"^(?:[-–—\[(]? ?\d{{1,4}} ?[-–—\])]?|\d{{1,4}} ?/ ?\d{{1,4}}|{_PAGE} ?\d{{1,4}}(?: ?(?:/|of|sur|von|de|di|su) ?\d{{1,4}})?)$", re.I)
_PAGE_TAIL = re.compile(rf"(?:\||  |—|–|\t) ?{_PAGE} ?\d{{1,4}}(?: ?(?:/|of|sur|von|de|di|su) ?\d{{1,4}})?$", re.I)
_PAGE_HEAD = re.compile(r"^\d{1,4} \| \S")
_ISSUE = re.compile(r"(?:—|–|  |\|) ?(?:issue|édition|edition|ausgabe|edición|edizione|version|rev)\.? ?\d{1,3}\b", re.I)
_STAMP = re.compile(r"^[^\d\n]{4,60}?  +\d{1,3}$")
_REF = re.compile(r"^(?:Ref|Réf|Rif|REF|RÉF|RIF)\. ?(?=\S)(?!.*[.!?] )|^[A-Z]{2,4}-\d{2,10} (?=[A-ZÀ-Ý])(?!.*[.!?] )")
# Stamps of controlled documents, as they stand alone in a header or footer.
_STAMP_TEXT = re.compile(
    r"^(?:uncontrolled (?:copy )?(?:when|if) printed|internal use only|for internal use only|document non maîtrisé (?:une fois imprimé|si imprimé)|diffusion interne|usage interne|ausdruck unterliegt nicht der lenkung|nur intern|nur für den internen gebrauch"
    r"|copia no controlada (?:una vez impresa|si se imprime)|uso interno|copia non controllata se stampata|solo uso interno|confidential|confidentiel|vertraulich|confidencial|riservato|controlled copy|copie contrôlée)(?: +\d{1,3})?$",
    re.I,
)
_ENDS = re.compile(r"[.!?:;]['\"»”)\]]*$")
_BULLET = re.compile(r"^[ \t]*(?:[-*•–+]|\(?(?:\d{1,3}|[a-z])[.)])[ \t]")
_HYPHEN = re.compile(r"(?<=[^\W\d_])[-­¬‐][ \t]*\n[ \t]*(?=[^\W\d_])")
_SOFT = re.compile(r"(?<=[^\W\d_])[­¬](?=[^\W\d_])")


def _is_furniture(line: str) -> bool:
    """By its own form: page numbers, stamps with a number set apart, headers with page or issue."""
    s = line.strip()
    if not s or len(s) > 110:
        return False
    if _PAGE_LINE.match(s) or _STAMP.match(s) or _STAMP_TEXT.match(s):
        return True
    return bool(_PAGE_TAIL.search(s) or _PAGE_HEAD.match(s) or (_ISSUE.search(s) and not _ENDS.search(s)))


def _is_header(line: str) -> bool:
    """A short title-like line, furniture only where it interrupts a sentence or stands beside furniture."""
    s = line.strip()
    return 0 < len(s) <= 90 and not _ENDS.search(s) and not s.endswith(",") and not _BULLET.match(line) and (s[0].isupper() or s[0].isdigit())


def clean_lines(text: str) -> tuple[str, int, int]:
    """Text with furniture taken out, cut words joined and wrapped lines reflowed; pieces of furniture; cut words."""
    if not text or text.isspace():
        return "", 0, 0
    if "\n" not in text and "\f" not in text and "\r" not in text:
        return text, 0, 0
    lines = text.replace("\r\n", "\n").replace("\r", "\n").replace("\f", "\n\f").split("\n")
    full = [i for i, x in enumerate(lines) if x.strip()]
    drop = {i for i in full if _is_furniture(lines[i])}
    fed = {i for i in full if lines[i][0] == "\f"} | {i for i, x in enumerate(lines) if x[:1] == "\f"}
    if len(drop) == len(full):
        drop = set()  # a text of numbers only is its own content
    for strong in (True, False, False):  # coded and capital headers first, then those that only their place gives away
        for k, i in enumerate(full):
            if i in drop or not _is_header(lines[i]):
                continue
            line = lines[i].strip()
            coded = bool(_REF.match(line) or (line.isupper() and len(line) >= 6))
            before = next((j for j in reversed(full[:k]) if j not in drop), None)
            if before is None or strong and not coded:
                continue
            after = next((j for j in full[k + 1 :] if j not in drop), None)
            open_before = not _ENDS.search(lines[before].strip()) and not _BULLET.match(lines[before])
            open_after = after is not None and lines[after].strip()[0].islower()
            if open_after and not open_before and not coded:
                continue  # the start of a sentence that goes on after the furniture
            gap_before, gap_after = not lines[i - 1].strip(), i + 1 < len(lines) and not lines[i + 1].strip()
            near = full[k - 1] in drop or (k + 1 < len(full) and full[k + 1] in drop) or any(full[k - 1] < j <= i for j in fed)
            alone = gap_before and gap_after and after is not None and len(line) >= 6
            between = open_before and open_after and (bool(_REF.match(line)) or gap_before or gap_after)
            if alone or between or (near and (open_before or coded or (len(line) < 70 and (gap_before or gap_after)))):
                drop.add(i)
    furniture = len(drop) + sum(1 for j in fed if j not in drop)
    if not drop and not fed:
        joined, cut = _HYPHEN.subn("", text.replace("\r\n", "\n"))
        return _flow(joined), 0, cut
    kept, open_ = [], False
    for i, x in enumerate(lines):
        s = x.replace("\f", "")
        if i in drop:
            open_ = True
            continue
        if not s.strip() and open_:
            continue
        if open_ and kept and s.strip():
            while kept and not kept[-1].strip():
                kept.pop()
            if kept and (_ENDS.search(kept[-1].strip()) and not s.strip()[0].islower()):
                kept.append("")
        open_ = False
        kept.append(s)
    joined, cut = _HYPHEN.subn("", "\n".join(kept))
    return _flow(joined), furniture, cut


def _flow(text: str) -> str:
    if "\n" not in text:
        return text
    out = []
    for paragraph in re.split(r"\n[ \t]*\n+", text):
        lines: list[str] = []
        for line in paragraph.split("\n"):
            if not line.strip():
                continue
            if not lines or _BULLET.match(line):
                lines.append(line.strip())
            else:
                lines[-1] += " " + line.strip()
        if lines:
            out.append("\n".join(lines))
    return "\n\n".join(out)


# ---------------------------------------------------------------- words and glyphs
# Odd glyphs also count at a word's edge where they can't be a mark of the text: a bracket that nothing closes, an exclamation mark before a small letter.
_TOKEN = re.compile(
    r"(?:(?:(?<![^\s'’(])[@¢†|!$£€]+|(?<!\S)\((?![^()\n]{0,300}\)))(?=[^\W\d_]))?[^\W_]+(?:[@¢†|!($£€]+[^\W_]+)*(?:(?<=[^\W\d_])(?:[@¢†|$£€]+(?![^\s.,;:)])|!+(?=[ \n]+[^\W\d_A-ZÀ-Þ])))?"
)
_CODE = re.compile(r"^(?:[A-Z]{0,4}\d[\dA-Z]*|\d+[^\W\d_]{0,2}|[A-Z]\d+)$")

# What a glyph is taken for when characters are misrecognised. Each key may stand in place of any of its values.
CONFUSIONS = {
    "c": "e", "e": "c o", "ê": "é", "è": "é", "é": "è ê e", "@": "a", "¢": "e c é", "†": "t", "|": "l i", "!": "i l", "1": "l i í ì", "0": "o ó ò", "5": "s", "9": "g q", "8": "b", "6": "é b ó", "2": "z", "(": "c", "4": "a", "3": "e", "7": "t", "$": "s", "£": "e", "€": "e",
    "m": "rn", "rn": "m", "n": "ri", "ri": "n", "rm": "nn", "ni": "m", "li": "h", "h": "li b", "cl": "d", "d": "cl", "ii": "u ü", "u": "ii ü", "l": "t i", "t": "l f", "i": "l", "y": "v", "v": "y", "vv": "w", "w": "vv", "f": "t", "a": "o", "o": "a e ó", "ﬁ": "fi", "ﬂ": "fl", "b": "h", "ii1": "m", "in": "m", "iu": "m", "g": "q", "q": "g", "s": "5", "rri": "m", "j": "i", "r": "t",
}
#: Glyphs as strokes, so that words confused with each other share a key: i, l, t and r are one stroke, n, u and h two, m three.
_STROKES = {
    "i": "i", "l": "i", "t": "i", "r": "i", "f": "i", "j": "i", "1": "i", "!": "i", "|": "i", "†": "i", "7": "i", "n": "ii", "u": "ii", "h": "ii", "b": "ii", "m": "iii", "d": "ci", "e": "c", "c": "c", "o": "c", "a": "c", "@": "c", "¢": "c", "(": "c", "0": "c", "6": "c", "4": "c", "3": "c", "8": "ii", "€": "c", "£": "c",
    "v": "v", "y": "v", "w": "vv", "s": "s", "5": "s", "$": "s", "g": "g", "9": "g", "q": "g", "z": "z", "2": "z", "k": "k", "p": "p", "x": "x",
}


@functools.lru_cache(1 << 16)
def skeleton(word: str) -> str:
    plain = unicodedata.normalize("NFKD", word.lower())
    return "".join(_STROKES.get(c, "" if unicodedata.combining(c) else c) for c in plain)


def tokens(text: str) -> list[str]:
    """Words of a text, lower-cased, with the odd glyphs inside them; codes and numbers aren't words."""
    return " ".join([w for w in _TOKEN.findall(text) if w.isalpha() or not _CODE.match(w)]).lower().split()


def glyph_cost(seen: str, meant: str, most: int = 6) -> int:
    """Least number of glyph confusions that turn meant into seen; most + 1 if no such way."""
    best = most + 1
    n, m = len(seen), len(meant)
    table: dict[tuple[int, int], int] = {(0, 0): 0}
    stack = [(0, 0)]
    while stack:
        i, j = stack.pop()
        cost = table[i, j]
        if i == n and j == m:
            best = min(best, cost)
            continue
        steps = []
        if i < n and j < m and seen[i] == meant[j]:
            steps.append((i + 1, j + 1, cost))
        for size in (1, 2, 3):
            for value in CONFUSIONS.get(seen[i : i + size], "").split() if i + size <= n else ():
                if meant.startswith(value, j):
                    steps.append((i + size, j + len(value), cost + 1))
        for a, b, k in steps:
            if k <= most and k < table.get((a, b), most + 1):
                table[a, b] = k
                stack.append((a, b))
    return best


# ---------------------------------------------------------------- skip-gram vectors
def sgns(center: np.ndarray, context: np.ndarray, count: np.ndarray, unigram: np.ndarray, start: tuple[np.ndarray, np.ndarray], samples: int, seed: int, rate: float = 0.3) -> tuple[np.ndarray, np.ndarray]:
    """One round of skip-gram with negative sampling over counted pairs: every pair once, and samples more by their counts, in random order; Adagrad in batches."""
    rng = np.random.default_rng(seed)
    v, u = (x.astype(np.float32).copy() for x in start)
    gv, gu = np.full(len(v), 1e-2, np.float32), np.full(len(u), 1e-2, np.float32)
    chance, noise = np.cumsum(count / count.sum()), np.cumsum(unigram**0.75 / (unigram**0.75).sum())
    turns = rng.permutation(np.concatenate([np.arange(len(count)), np.minimum(np.searchsorted(chance, rng.random(max(samples, 1 << 14))), len(count) - 1)]))
    for first in range(0, len(turns), 1 << 14):
        at = turns[first : first + (1 << 14)]
        size, c, o = len(at), center[at], context[at]
        n = np.minimum(np.searchsorted(noise, rng.random((size, NEGATIVE))), len(unigram) - 1)
        vc = v[c]
        pos = 1 - 1 / (1 + np.exp(-np.einsum("ij,ij->i", vc, u[o])))
        un = u[n]
        neg = -1 / (1 + np.exp(-np.einsum("ij,ikj->ik", vc, un)))
        dv = pos[:, None] * u[o] + np.einsum("ik,ikj->ij", neg, un)
        du = np.concatenate([pos[:, None] * vc, (neg[:, :, None] * vc[:, None, :]).reshape(-1, v.shape[1])])
        for m, g, idx, d in ((v, gv, c, dv), (u, gu, np.concatenate([o, n.ravel()]), du)):
            order = np.argsort(idx, kind="stable")
            ids, begins, times = np.unique(idx[order], return_index=True, return_counts=True)
            step = np.add.reduceat(d[order], begins, axis=0) / np.sqrt(times)[:, None]
            g[ids] += (step * step).mean(1)
            m[ids] += rate * step / np.sqrt(g[ids])[:, None]
    return v, u


# ---------------------------------------------------------------- the distributed stages
def _clean(batches):
    seen: set[int] = set()  # a section's deliveries lie in one partition
    for b in batches:
        uids, texts, words, furniture, cuts = [], [], [], [], []
        for uid, text in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
            if uid is None or uid in seen:
                continue
            seen.add(uid)
            clean, f, c = clean_lines(text or "")
            uids.append(uid)
            texts.append(_SOFT.sub("", clean) if "\u00ad" in clean or "¬" in clean else clean)
            words.append(" ".join(tokens(texts[-1])))
            furniture.append(f)
            cuts.append(c)
        yield pa.RecordBatch.from_arrays([pa.array(uids, pa.int64()), pa.array(texts, pa.string()), pa.array(furniture, pa.int32()), pa.array(cuts, pa.int32()), pa.array(words, pa.string())], ["section_uid", "text", "furniture", "cuts", "words"])


def cleaned(sections: DataFrame) -> DataFrame:
    """section_uid, text, furniture, cuts, words (lower-cased, parted by blanks): each section once, without furniture, hyphens at line ends and hard wraps."""
    rows = sections.select("section_uid", "raw_text")
    n = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return settle(over_batches(rows.repartition(n, "section_uid"), _clean, "section_uid long, text string, furniture int, cuts int, words string"), "cleaned")


def _count(batches):
    counts: Counter = Counter()

    def flush():
        words, n = list(counts), list(counts.values())
        counts.clear()
        return pa.RecordBatch.from_arrays([pa.array(words, pa.string()), pa.array(n, pa.int64()), pa.array(map(skeleton, words), pa.string())], ["word", "n", "skeleton"])

    for b in batches:
        for text in b.column(0).to_pylist():
            counts.update(text.split(" "))
        if len(counts) > 500_000:
            yield flush()
    yield flush()


def word_table(clean: DataFrame) -> DataFrame:
    """word, skeleton, n over all sections."""
    counted = over_batches(clean.filter("words <> ''").select("words"), _count, "word string, n long, skeleton string")
    return settle(counted.groupBy("word", "skeleton").agg(F.sum("n").alias("n")), "words")


def _verify(batches):
    for b in batches:
        seen, meant = b.column(0).to_pylist(), b.column(1).to_pylist()
        cost = [glyph_cost(a, z) for a, z in zip(seen, meant)]
        yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), b.column(2), pa.array(cost, pa.int32())], ["word", "meant", "ratio", "cost"])


def glyph_links(words: DataFrame, frequent: DataFrame) -> DataFrame:
    """word, meant (array of meant, cost, ratio): the far more frequent words that plausible glyph edits turn into the word. The frequent words, at most 1 / SHARE, are broadcast, so that no skeleton is a hot key."""
    odd = F.col("word").rlike("[^\\p{L}]")
    rare = words.filter((F.length("word") >= 3) | ((F.length("word") >= 2) & odd)).filter(~F.col("word").rlike("^(\\p{L}\\d+|\\p{L}{2}\\d)$"))
    known = frequent.filter((F.length("word") >= 2) & ~F.col("word").rlike("[^\\p{L}]")).select(F.col("word").alias("meant"), F.col("n").alias("many"), "skeleton")
    pairs = rare.join(F.broadcast(known), "skeleton").filter((F.col("word") != F.col("meant")) & (F.col("many") >= RATIO * F.col("n"))).select("word", "meant", (F.col("many") / F.col("n")).alias("ratio"))
    checked = over_batches(pairs, _verify, "word string, meant string, ratio double, cost int").filter("cost <= 6")
    return settle(checked.groupBy("word").agg(F.sort_array(F.collect_set(F.struct("meant", "cost", "ratio"))).alias("meant")), "links")


def _context(batches, vocabulary: dict[str, int]):
    """Counted skip-gram pairs of vocabulary words (a, b, n) and every doubtful occurrence (section, word, words around)."""
    size = max(vocabulary.values(), default=0) + 1
    keys, waiting = [], 0
    names = ["a", "b", "n", "section_uid", "word", "around"]
    kinds = (pa.int32(), pa.int32(), pa.int64(), pa.int64(), pa.string(), pa.list_(pa.int32()))

    def flush():
        k, n = np.unique(np.concatenate([x for x, _ in keys]), return_inverse=True)
        total = np.bincount(n, weights=np.concatenate([w for _, w in keys])).astype(np.int64)
        keys[:] = [(k, total)]

    for b in batches:
        uids, words, around, flat, lengths = [], [], [], [], []
        for uid, text in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
            own = text.split(" ")
            ids = [vocabulary.get(w, -1) for w in own]
            flat += ids
            flat += [-1] * WINDOW
            for i, k in enumerate(ids):
                if k < 0:
                    uids.append(uid)
                    words.append(own[i])
                    around.append([x for x in ids[max(0, i - WINDOW) : i + WINDOW + 1] if x >= 0])
        x = np.array(flat, np.int64)
        for d in range(1, WINDOW + 1):
            p, q = x[:-d], x[d:]
            ok = (p >= 0) & (q >= 0)
            k, n = np.unique(np.concatenate([p[ok] * size + q[ok], q[ok] * size + p[ok]]), return_counts=True)
            keys.append((k, n))
            waiting += len(k)
        if waiting > 4_000_000:
            flush()
            waiting = 0
            if len(keys[0][0]) > 2_000_000:
                yield from _pair_batches(keys, size, names, kinds)
        none = pa.nulls(len(uids))
        yield pa.RecordBatch.from_arrays([none.cast(pa.int32()), none.cast(pa.int32()), none.cast(pa.int64()), pa.array(uids, kinds[3]), pa.array(words, kinds[4]), pa.array(around, kinds[5])], names)
    if keys:
        flush()
        yield from _pair_batches(keys, size, names, kinds)


def _pair_batches(keys, size, names, kinds):
    k, n = keys[0]
    keys.clear()
    for a in range(0, len(k), 100_000):
        part = k[a : a + 100_000]
        none = pa.nulls(len(part))
        yield pa.RecordBatch.from_arrays([pa.array(part // size, kinds[0]), pa.array(part % size, kinds[1]), pa.array(n[a : a + 100_000], kinds[2]), none.cast(kinds[3]), none.cast(kinds[4]), none.cast(kinds[5])], names)


#: Distinct pairs that one task trains on; beyond it shards train side by side and their vectors are averaged after each round.
SHARD = 4_000_000
#: Draws by count for each distinct pair and round, besides the one turn that every pair has.
SAMPLES = 2


def learn_vectors(pairs: DataFrame, unigram: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Skip-gram vectors (in, out) of the vocabulary from counted pairs(a, b, n)."""
    size, rng = len(unigram), np.random.default_rng(7)
    state = ((rng.random((size, DIM)) - 0.5) / DIM, np.zeros((size, DIM)))
    pairs = settle(pairs.groupBy("a", "b").agg(F.sum("n").alias("n")), "pairs")
    count = pairs.count()
    if not size or not count:
        return state
    shards = -(-count // SHARD)
    spark = pairs.sparkSession
    spread = pairs.coalesce(1) if shards == 1 else pairs.repartition(shards)
    for _ in range(1 if shards == 1 else ROUNDS):
        shared = spark.sparkContext.broadcast((state, unigram))

        def train(batches, shared=shared, rounds=ROUNDS if shards == 1 else 1):
            table = [[x.to_numpy() for x in b.columns] for b in batches if b.num_rows]
            if not table:
                return
            a, b, n = (np.concatenate(x) for x in zip(*table))
            order = np.lexsort((b, a))
            now, uni = shared.value
            for r in range(rounds):
                now = sgns(a[order], b[order], n[order].astype(float), uni, now, SAMPLES * len(a), r)
            both = np.concatenate(now, axis=1).astype(np.float64)
            yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(uni)), pa.int32()), pa.array(list(both), pa.list_(pa.float64())), pa.array(np.full(len(uni), float(len(a))), pa.float64())], ["id", "both", "weight"])

        trained = over_batches(spread, train, "id int, both array<double>, weight double")
        mean = trained.groupBy("id").agg(F.array(*[F.sum(F.col("both")[i] * F.col("weight")) / F.sum("weight") for i in range(2 * DIM)]).alias("both")) if shards > 1 else trained.select("id", "both")
        got = mean.toPandas().sort_values("id")
        both = np.stack(got["both"].to_numpy())
        state = both[:, :DIM], both[:, DIM:]
    return state


def _agree(batches, state, index: dict[str, int]):
    v, u = (np.asarray(x, np.float32) for x in state)
    for b in batches:
        out = ([], [], [], [], [], [])
        for uid, word, around, meant in zip(*(b.column(i).to_pylist() for i in range(4))):
            ctx = u[around].mean(0) if around else None
            best = max(((float(v[index[m["meant"]]] @ ctx) + np.log(NEGATIVE) if ctx is not None else 0.0, m["meant"], m["cost"], m["ratio"]) for m in meant), key=lambda x: (x[0], x[1]))
            alone = ctx is None and not (best[2] <= 2 and best[3] >= 4 * RATIO and np.log(best[3]) - best[2] >= SURE)
            if best[0] >= AGREES and not alone:  # without any context the word's own evidence must do
                for c, x in zip(out, (uid, word, best[1], best[0], best[2], best[3])):
                    c.append(x)
        kinds = (pa.int64(), pa.string(), pa.string(), pa.float64(), pa.int32(), pa.float64())
        yield pa.RecordBatch.from_arrays(list(map(pa.array, out, kinds)), ["section_uid", "word", "meant", "agreement", "cost", "ratio"])


def sure() -> Column:
    """Whether a correction's own evidence decides it."""
    return (F.col("cost") <= 2) & (F.col("ratio") >= 4 * RATIO) & (F.col("agreement") >= 0) & (F.col("agreement") + F.log("ratio") - F.col("cost") >= SURE)


def corrections(clean: DataFrame) -> DataFrame:
    """section_uid, word, meant, agreement, cost, ratio: each occurrence of a misread word with what it stands for in its context."""
    spark = clean.sparkSession
    words = word_table(clean)
    total = words.agg(F.sum("n")).first()[0] or 0
    frequent = words.filter(F.col("n") >= max(LEAST, SHARE * total))
    links = glyph_links(words, frequent)
    vocabulary = sorted((r["word"], r["n"]) for r in frequent.select("word", "n").toLocalIterator())  # at most 1 / SHARE words
    doubtful = frozenset(r["word"] for r in frequent.join(links, "word", "left_semi").select("word").toLocalIterator())
    index = {w: i for i, (w, _) in enumerate(vocabulary)}
    shared = spark.sparkContext.broadcast({w: i for w, i in index.items() if w not in doubtful})
    found = settle(over_batches(clean.filter("words <> ''").select("section_uid", "words"), lambda batches: _context(batches, shared.value), "a int, b int, n long, section_uid long, word string, around array<int>"), "contexts")
    state = learn_vectors(found.filter("a is not null").select("a", "b", "n"), np.array([float(n) for _, n in vocabulary]))
    model = spark.sparkContext.broadcast((state, index))
    doubts = found.filter("section_uid is not null").select("section_uid", "word", "around").join(links, "word").select("section_uid", "word", "around", "meant")
    agreed = over_batches(doubts, lambda batches: _agree(batches, *model.value), "section_uid long, word string, meant string, agreement double, cost int, ratio double")
    odd = F.col("word").rlike("[^\\p{L}]")
    return agreed.filter((F.length("word") >= 4) | ((F.length("word") >= 3) & odd) | sure())


def damage(clean: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Damaged sections (section_uid, furniture, cuts, misread) and their corrections."""
    fixes = settle(corrections(clean), "corrections")
    odd = F.col("word").rlike("[^\\p{L}]").cast("int")
    misread = fixes.groupBy("section_uid").agg(F.count("*").alias("n"), F.sum(odd).alias("odd"), F.max(sure()).alias("sure")).filter("n >= 2 or odd >= 1 or sure").select("section_uid", F.col("n").alias("misread"))
    broken = clean.filter("furniture > 0 or cuts > 0").select("section_uid", "furniture", "cuts")
    both = broken.join(misread, "section_uid", "full_outer")
    zero = lambda c: F.coalesce(F.col(c), F.lit(0)).alias(c)
    return both.select("section_uid", zero("furniture"), zero("cuts"), zero("misread")), fixes


def _apply(batches):
    for b in batches:
        texts = []
        for text, pairs in zip(b.column(1).to_pylist(), b.column(2).to_pylist()):
            fixes = {p["word"]: p["meant"] for p in pairs or ()}

            def one(m: re.Match, fixes=fixes) -> str:
                w = m.group()
                meant = fixes.get(w.lower()) if not _CODE.match(w) else None
                if meant is None:
                    return w
                return meant.upper() if sum(c.isupper() for c in w) > 1 and not any(c.islower() for c in w) else meant.capitalize() if w[0].isupper() else meant

            texts.append(_TOKEN.sub(one, text) if fixes else text)
        yield pa.RecordBatch.from_arrays([b.column(0), pa.array(texts, pa.string()), b.column(3), b.column(4), b.column(5)], ["section_uid", "text", "furniture", "cuts", "misread"])


def repair(sections: DataFrame) -> DataFrame:
    """section_uid, text, furniture, cuts, misread: every section as continuous paragraphs, with what was mended."""
    clean = cleaned(sections)
    hurt, fixes = damage(clean)
    own = fixes.join(hurt.filter("misread > 0").select("section_uid"), "section_uid", "left_semi").groupBy("section_uid").agg(F.collect_set(F.struct("word", "meant")).alias("fixes"), F.count("*").cast("int").alias("misread"))
    rows = clean.join(own, "section_uid", "left").select("section_uid", "text", "fixes", "furniture", "cuts", F.coalesce("misread", F.lit(0)).alias("misread"))
    return over_batches(rows, _apply, "section_uid long, text string, furniture int, cuts int, misread int")
