"""Problem 6: cutting oversized items into overlapping pieces at natural boundaries.

Method: byte-range processing. An item (a text, or a file too large for one worker) is read in fixed ranges with a halo on each
side, so that no worker holds the whole. Each range reports its words and the boundaries it sees; the boundary tables of an item
are stitched by prefix sums of the words, the cuts are placed on the stitched table, and each range then emits its share of
every piece by offset. A piece has at most LIMIT words, repeats the last OVERLAP words of the one before, and ends at a paragraph
end, else a sentence end, else a clause mark in its second half; where there is none it ends at LIMIT words.

A word is a maximal run of characters other than Unicode white space. Null and blank items and items within the limit stay one
piece (blank: none). Repeated rows of an item count once.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..runtime import over_batches, prepare, settle, widen

LIMIT, OVERLAP = 600, 60
#: Code points (of texts) or bytes (of files) in a range.
RANGE = 1 << 16
HALO = 64
PARAGRAPH, SENTENCE, CLAUSE = 3, 2, 1

# The characters with Unicode's White_Space property.
_SPACE = "\t-\r \u0085\u00a0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000"
_WORD = re.compile(f"[^{_SPACE}]+")
_LEADING = re.compile(f"[{_SPACE}]*")
_ODD = re.compile("[\x1c-\x1f]")
_SENTENCE_END = re.compile("[.!?…][\"'»”’)\\]]*$")
_CLAUSE_END = re.compile("[,;:)\\]–—]$")
_BLANK_LINE = re.compile("\r\n?[^\\S\r\n]*\r\n?|\n[^\\S\n]*\r?\n|\u2029|\f")


def count_words(text: str) -> int:
    return len((_ODD.sub("x", text) if _ODD.search(text) else text).split())


RANGES = "record_kind string, record_uid long, range_no int, before string, body string, after string"


def slices(text: str, size: int = RANGE) -> Iterator[tuple[str, str, str]]:
    """Halo, body and halo of each range of a text, one at a time."""
    for a in range(0, max(len(text), 1), size):
        yield text[max(0, a - HALO) : a], text[a : a + size], text[a + size : a + size + HALO]


def ranges(items: DataFrame, size: int = RANGE) -> DataFrame:
    """record_kind, record_uid, range_no, before, body, after: each text in ranges of size code points with halos, a few of them in memory at a time."""

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def batch(rows: list[tuple]) -> pa.RecordBatch:
            kinds = (pa.string(), pa.int64(), pa.int32(), pa.string(), pa.string(), pa.string())
            return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows), kinds)], [x.split()[0] for x in RANGES.split(", ")])

        rows: list[tuple] = []
        for b in batches:
            for i in range(b.num_rows):
                kind, uid, text = (c[i].as_py() for c in b.columns)
                for no, part in enumerate(slices(text, size)):
                    rows.append((kind, uid, no, *part))
                    if len(rows) == 64:
                        yield batch(rows)
                        rows = []
        if rows:
            yield batch(rows)

    known = items.filter(F.col("text").isNotNull() & F.col("record_uid").isNotNull())
    return over_batches(known.select("record_kind", "record_uid", "text"), cut, RANGES)


def _own_words(before: str, body: str) -> int:
    """Words that start in the body: a word running on from before belongs to the range it starts in."""
    n = count_words(body)
    return n - bool(n and before and _WORD.match(before[-1]) and _WORD.match(body[0]))


def word_counts(items: DataFrame, size: int = RANGE) -> DataFrame:
    """record_kind, record_uid, words: summed over the ranges of each item, repeated rows once."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            n = [sum(_own_words(x, y) for x, y, _ in slices(t, size)) for t in b.column(2).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(n, pa.int64())], ["record_kind", "record_uid", "words"])

    known = widen(items.select("record_kind", "record_uid", "text")).filter(F.col("text").isNotNull() & F.col("record_uid").isNotNull())
    return over_batches(known, count, "record_kind string, record_uid long, words long").groupBy("record_kind", "record_uid").agg(F.max("words").alias("words"))


def oversized(items: DataFrame, limit: int = LIMIT) -> DataFrame:
    return word_counts(items).filter(F.col("words") > limit)


def boundaries(before: str, body: str, after: str) -> tuple[int, list[int], list[int]]:
    """Words starting in the body; after how many of them a boundary stands, and how strong it is."""
    spans = [m.span() for m in _WORD.finditer(body)]
    runs_on = bool(spans and before and spans[0][0] == 0 and _WORD.match(before[-1]))
    at, strength = [], []
    for i, (a, z) in enumerate(spans):
        if z == len(body) and after and _WORD.match(after[0]):
            continue  # the word goes on; the next range sees its end
        word = body[a:z] if a else before[-HALO:] + body[:z] if runs_on else body[:z]
        gap = body[z : spans[i + 1][0]] if i + 1 < len(spans) else body[z:] + _LEADING.match(after)[0]
        s = PARAGRAPH if _BLANK_LINE.search(gap) else SENTENCE if _SENTENCE_END.search(word) else CLAUSE if _CLAUSE_END.search(word) else 0
        if s:
            at.append(i + 1 - runs_on)
            strength.append(s)
    return len(spans) - runs_on, at, strength


def _table(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        found = [boundaries(x or "", y or "", z or "") for x, y, z in zip(*(b.column(i).to_pylist() for i in (3, 4, 5)))]
        n, at, strength = zip(*found) if found else ((), (), ())
        ints = pa.list_(pa.int32())
        yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), b.column(2), pa.array(n, pa.int64()), pa.array(at, ints), pa.array(strength, ints)], ["record_kind", "record_uid", "range_no", "words", "at", "strength"])


def place_cuts(words: int, at: np.ndarray, strength: np.ndarray, limit: int = LIMIT, overlap: int = OVERLAP) -> list[tuple[int, int]]:
    """(first word, end word) of each piece, given the boundaries of the whole item in order."""
    pieces, start = [], 0
    while words - start > limit:
        a, z = np.searchsorted(at, [start + limit // 2, start + limit], side="right")
        end = start + limit
        if z > a:
            window = strength[a:z]
            end = int(at[a + np.flatnonzero(window == window.max())[-1]])
        pieces.append((start, end))
        start = end - overlap
    return [*pieces, (start, words)]


def _stitch(limit: int, overlap: int):
    def one(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.drop_duplicates("range_no").sort_values("range_no")
        offset = np.concatenate([[0], np.cumsum(rows["words"].to_numpy())])
        at = np.concatenate([np.asarray(x, np.int64) + o for x, o in zip(rows["at"], offset)])
        strength = np.concatenate([np.asarray(x, np.int64) for x in rows["strength"]])
        cuts = place_cuts(int(offset[-1]), at, strength, limit, overlap)
        first, end = np.array([c[0] for c in cuts]), np.array([c[1] for c in cuts])
        out = []
        for no, lo, hi in zip(rows["range_no"], offset, offset[1:]):
            # a range without a word start may still hold the rest of one
            for i in range(np.searchsorted(end, lo), np.searchsorted(first, max(hi, lo + 1))):
                out.append((key[0], key[1], int(no), int(i), int(first[i] - lo), int(end[i] - lo), int(end[i] - first[i])))
        return pd.DataFrame(out, columns=["record_kind", "record_uid", "range_no", "piece_no", "first", "end", "words"])

    return one


def cut_body(before: str, body: str, first: int, end: int) -> str:
    """The part of the body that belongs to a piece of the words first..end, counted from the first word that starts in the body."""
    spans = [m.span() for m in _WORD.finditer(body)]
    runs_on = int(bool(spans and before and spans[0][0] == 0 and _WORD.match(before[-1])))
    own = spans[runs_on:]
    a = 0 if first < 0 else own[first][0] if first < len(own) else len(body)
    if end > len(own):
        z = len(body)
    elif end > 0:
        z = own[end - 1][1]
    else:
        z = spans[0][1] if end == 0 and runs_on else 0
    if first < 0 or end > 0:
        return body[a:z]
    return ""


def _emit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        parts = [cut_body(x or "", y or "", f, e) for x, y, f, e in zip(*(b.column(i).to_pylist() for i in (3, 4, 5, 6)))]
        yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), b.column(7), b.column(8), b.column(2), pa.array(parts, pa.string())], ["record_kind", "record_uid", "piece_no", "words", "range_no", "part"])


def _pieces(parts_of: DataFrame, limit: int, overlap: int) -> DataFrame:
    schema = "record_kind string, record_uid long, range_no int, words long, at array<int>, strength array<int>"
    plan = over_batches(parts_of, _table, schema).groupBy("record_kind", "record_uid").applyInPandas(_stitch(limit, overlap), "record_kind string, record_uid long, range_no int, piece_no int, first long, end long, words long")
    joined = parts_of.join(plan, ["record_kind", "record_uid", "range_no"]).select("record_kind", "record_uid", "range_no", "before", "body", "first", "end", "piece_no", "words")
    parts = over_batches(joined, _emit, "record_kind string, record_uid long, piece_no int, words long, range_no int, part string")
    by_range = F.array_sort(F.collect_list(F.struct("range_no", "part")))
    text = F.array_join(F.transform(by_range, lambda x: x["part"]), "")
    return parts.groupBy("record_kind", "record_uid", "piece_no").agg(F.max("words").alias("words"), text.alias("text"))


def cut_text(text: str, limit: int = LIMIT, overlap: int = OVERLAP) -> list[tuple[int, str]]:
    """(words, text) of the pieces of a text that is one range; none for a blank one, and the text as it stands within the limit."""
    n = count_words(text)
    if n <= limit:
        return [(n, text)] if n else []
    _, at, strength = boundaries("", text, "")
    spans = [m.span() for m in _WORD.finditer(text)]
    cuts = place_cuts(n, np.asarray(at, np.int64), np.asarray(strength, np.int64), limit, overlap)
    return [(z - a, text[spans[a][0] : spans[z - 1][1]]) for a, z in cuts]


def split_texts(items: DataFrame, limit: int = LIMIT, overlap: int = OVERLAP, size: int = RANGE) -> DataFrame:
    """record_kind, record_uid, piece_no, words, text: the pieces of every item(record_kind, record_uid, text); small items stay whole.

    A text that is one range is cut where it lies; longer ones in ranges that are spread over the tasks.
    """
    items = items.select("record_kind", "record_uid", "text").filter(F.col("text").isNotNull() & F.col("record_uid").isNotNull()).dropDuplicates(["record_kind", "record_uid"])
    names = ["record_kind", "record_uid", "piece_no", "words", "text"]

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = [(kind, uid, i, n, part) for kind, uid, text in zip(*(c.to_pylist() for c in b.columns)) for i, (n, part) in enumerate(cut_text(text, limit, overlap))]
            kinds = (pa.string(), pa.int64(), pa.int32(), pa.int64(), pa.string())
            yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], k) for i, k in enumerate(kinds)], names)

    short = over_batches(items.filter(F.length("text") <= size), cut, "record_kind string, record_uid long, piece_no int, words long, text string")
    parts = settle(ranges(items.filter(F.length("text") > size), size), "ranges")
    return short.unionByName(_pieces(parts, limit, overlap).filter("words > 0").select(*names))


def split_files(spark: SparkSession, paths: list[str], limit: int = LIMIT, overlap: int = OVERLAP, size: int = RANGE) -> DataFrame:
    """Pieces of UTF-8 text files on any file system that Hadoop and Arrow know (record_uid: the file's place in paths), each read in byte ranges."""
    prepare(spark)
    rows = []
    for i, p in enumerate(paths):
        path = spark._jvm.org.apache.hadoop.fs.Path(p)
        status = path.getFileSystem(spark._jsc.hadoopConfiguration()).getFileStatus(path)
        rows.append((i, status.getPath().toString(), status.getLen()))
    files = spark.createDataFrame(rows, "record_uid long, path string, bytes long")
    chunks = files.select("record_uid", "path", F.explode(F.sequence(F.lit(0), F.greatest(F.lit(0), F.floor((F.col("bytes") - 1) / size)).cast("int"))).alias("range_no"))
    chunks = chunks.repartition(int(spark.conf.get("spark.sql.shuffle.partitions")), "record_uid", "range_no")

    def read(batches):
        for b in batches:
            for a in range(0, b.num_rows, 64):
                part = b.slice(a, 64)
                got = [read_range(p, k * size, size) for p, k in zip(part.column(1).to_pylist(), part.column(2).to_pylist())]
                cols = [pa.array([g[i] for g in got], pa.string()) for i in range(3)]
                yield pa.RecordBatch.from_arrays([pa.array(["file"] * len(got)), part.column(0), part.column(2), *cols], ["record_kind", "record_uid", "range_no", "before", "body", "after"])

    parts = settle(over_batches(chunks, read, RANGES), "file_ranges")
    return _pieces(parts, limit, overlap).filter(F.col("words") > 0)


def _open(uri: str):
    """A file by its address: Hadoop writes file:/a where Arrow wants file:///a."""
    if uri.startswith("file:/") and not uri.startswith("file://"):
        uri = "file://" + uri[5:]
    system, path = pyarrow.fs.FileSystem.from_uri(uri)
    return system.open_input_file(path)


def read_range(path: str, start: int, size: int) -> tuple[str, str, str]:
    """Halo, body and halo of a byte range; a character belongs to the range its first byte lies in."""
    lead = min(start, 4 * HALO)
    with _open(path) as f:
        f.seek(start - lead)
        raw = f.read(lead + size + 4 * HALO)

    def settle_at(i: int) -> int:
        while i < len(raw) and raw[i] & 0xC0 == 0x80:
            i += 1
        return i

    a, z = settle_at(lead), settle_at(min(lead + size, len(raw)))
    text = lambda x: x.decode("utf-8", "ignore")
    return text(raw[settle_at(0) : a]), text(raw[a:z]), text(raw[z:])
