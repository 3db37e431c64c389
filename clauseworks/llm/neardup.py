"""Problem 4: near-duplicate records with small edits.

Method: LSH forest. Every record gets a min-hash signature of its set of three-word sequences; TREES sorted orders of signature
prefixes put similar records next to each other. The rows of all trees are range-sorted by prefix and record, so that a region
(records with one prefix of DEPTH hashes in a tree) may lie in several tasks. The pairs of a region are compared where it lies; a
region that is large or runs over the edge of a task goes in blocks, whose pairs are spread over the tasks. At similarity j a pair
meets in 1 - (1 - j^DEPTH)^TREES of the cases, 99.2 % at 0.5. Candidates pass a bit sketch and a finer one where they meet, a
stricter bit sketch where they met in one tree only, then a bound that no pair of SIMILAR fails, and an exact check of the
sequence sets.

Records with common phrases meet by chance, and the number of such pairs grows as the square of the records. So nothing is written
for a pair before both sketches passed, the orders are sorted PASSES times a part of them, the bounds and sets of many pairs
meet in portions, and each step's files go when it is done.

Records with equal sets form one class before the forest, so that copies never crowd an order; links hold between class
representatives, and copies are joined to them through the membership. Null, blank and short records (under LEAST_WORDS) are in no
pair. Repeated deliveries of a record count once. Whole texts are read.
"""

from __future__ import annotations

import functools
import hashlib
import re
from collections.abc import Callable
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..runtime import over_batches, release, settle, shuffles_freed, widen

WORDS_IN_SEQUENCE, SIMILAR, LEAST_WORDS = 3, 0.5, 40
#: Hashes of a signature; sorted orders and hashes along each; bits of a prefix.
HASHES, TREES, DEPTH, PREFIX = 150, 36, 3, 36
#: Parts of the forest that are sorted one after the other.
PASSES = 6
#: Sketch bits of HASHES that must agree; at a similarity of j the share (1 + j) / 2 of them does (at 0.5: 112.5, deviation 5.3). LOOSE is for pairs that met in several trees, STRICT for the others: at 0.5, 0.1 % of the former and 1.5 % of the latter (4 % of all) fall below.
LOOSE, STRICT = 96, 101
#: Hashes of which four bits each are compared once a pair is a candidate, and how many must agree: at a similarity of j the share j + (1 - j) / 16 does (at 0.5: 53.1, deviation 5.0).
FINE, ALIKE = 100, 37
#: Records of the largest region compared where it lies; a larger one goes in blocks, BLOCKS of them or blocks of BLOCK records if that is fewer.
DIRECT, BLOCK, BLOCKS = 2048, 8192, 16
#: Copies of a class from which it is spread over salted keys, and from which its own copies are linked in a star rather than all with each other.
COPIES = 1000
#: Copies of a class that one task may join; classes above it meet their members by a broadcast of the classes (at most rows / HOT of them).
HOT = 100_000
#: Ids of candidate records that may be broadcast; beyond it their texts are found by a shuffled join.
BROADCAST_IDS = 4_000_000
#: Pairs whose bounds, and a quarter of that whose sets, meet at once: as many as a quarter of the records, but this many at least.
PORTION = 250_000

_WORD = re.compile(r"[^\W_]+")
_ODD = np.uint64(0x9E3779B97F4A7C15)


class _Hashes(dict):
    """64-bit hashes of words, kept while they fit."""

    def __missing__(self, word: str) -> int:
        if len(self) >= 1 << 20:
            self.clear()
        h = self[word] = int.from_bytes(hashlib.blake2b(word.encode("utf-8", "surrogatepass"), digest_size=8).digest(), "little")
        return h


_hashes = _Hashes()


def sequence_sets(texts: list[str | None]) -> list[np.ndarray | None]:
    """Of each text the sorted 64-bit hashes of its three-word sequences; None for a text of too few words."""
    words = [_WORD.findall(t.lower()) if t else () for t in texts]
    words = [w if len(w) >= LEAST_WORDS else () for w in words]
    ends = np.cumsum([len(w) for w in words])
    if not len(ends) or not ends[-1]:
        return [None] * len(texts)
    h = np.fromiter(map(_hashes.__getitem__, chain.from_iterable(words)), np.uint64, int(ends[-1]))
    n = len(h) - WORDS_IN_SEQUENCE + 1
    g = h[:n].copy()
    for i in range(1, WORDS_IN_SEQUENCE):
        g = (g ^ (g >> np.uint64(31))) * _ODD + h[i : n + i]
    g ^= g >> np.uint64(30)
    g *= np.uint64(0xBF58476D1CE4E5B9)
    g ^= g >> np.uint64(31)
    return [np.unique(g[z - len(w) : z - WORDS_IN_SEQUENCE + 1]) if w else None for w, z in zip(words, ends)]


@functools.cache
def _permutations() -> tuple[np.ndarray, np.ndarray]:
    rng = np.random.default_rng(11)
    return rng.integers(1, 1 << 32, HASHES, dtype=np.uint32) | np.uint32(1), rng.integers(0, 1 << 32, HASHES, dtype=np.uint32)


def signatures(sets: list[np.ndarray]) -> np.ndarray:
    """Min-hash signatures, a row for each set."""
    x = (np.concatenate(sets) >> np.uint64(32)).astype(np.uint32)
    starts = np.cumsum([0, *map(len, sets)])[:-1]
    a, b = _permutations()
    out = np.empty((len(sets), HASHES), np.uint32)
    for k in range(HASHES):
        out[:, k] = np.minimum.reduceat(x * a[k] + b[k], starts)
    return out


def sketches(m: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """One bit of each hash: two words of 64 bits and the rest."""
    bits = (((m * np.uint32(0x9E3779B1)) >> np.uint32(17)) & np.uint32(1)).astype(np.uint8)
    packed = np.ascontiguousarray(np.packbits(bits[:, :128], axis=1)).view(np.int64)
    rest = bits[:, 128:].astype(np.int64) @ (1 << np.arange(HASHES - 128, dtype=np.int64))
    return packed[:, 0], packed[:, 1], rest


REST = HASHES - 128


def tree_keys(m: np.ndarray) -> np.ndarray:
    """Of each record and tree the PREFIX bits that DEPTH hashes along the tree's order give."""
    keys = np.empty((len(m), TREES), np.uint64)
    for t in range(TREES):
        k = np.full(len(m), t + 1, np.uint64)
        for d in range(DEPTH):
            k = (k ^ m[:, (t * DEPTH + d) % HASHES].astype(np.uint64)) * _ODD
            k ^= k >> np.uint64(29)
        keys[:, t] = (k * np.uint64(0xBF58476D1CE4E5B9)) >> np.uint64(64 - PREFIX)
    return keys


SIGNED = "kind int, uid long, c1 long, c2 long, s1 long, s2 long, s3 int, " + "".join(f"prefixes{p} binary, " for p in range(PASSES)) + "fine binary, size int, bits binary"
#: Prefixes of clauses and sections differ by it, as the kinds never pair.
_APART = np.uint64(0x5A5A5A5A5)
#: 64-bit words that hold the finer sketch.
WORDS = -(-FINE // 16)


def fine_sketches(m: np.ndarray) -> np.ndarray:
    """Four bits of each of the first FINE hashes, two hashes a byte."""
    four = ((m[:, :FINE] * np.uint32(0xC2B2AE35)) >> np.uint32(28)).astype(np.uint8)
    return four[:, ::2] << 4 | four[:, 1::2]


def bitmaps(sets: list[np.ndarray]) -> list[bytes]:
    """Of each set a bitmap of four to eight bits an element, in which an element sets the bit that its lowest bits name."""
    sizes = np.array(list(map(len, sets)))
    widths = np.maximum(256, 1 << np.ceil(np.log2(4 * sizes)).astype(np.int64))
    out: list[bytes] = [b""] * len(sets)
    portions = ((w, r[k : k + max(1, (1 << 24) // w)]) for w in np.unique(widths) for r in [np.flatnonzero(widths == w)] for k in range(0, len(r), max(1, (1 << 24) // w)))
    for width, rows in portions:
        x = (np.concatenate([sets[i] for i in rows]) & np.uint64(width - 1)).astype(np.int64)
        flags = np.zeros(len(rows) * width, np.uint8)
        flags[np.repeat(np.arange(len(rows)) * width, sizes[rows]) + x] = 1
        for i, bits in zip(rows, np.packbits(flags.reshape(len(rows), width), axis=1, bitorder="little")):
            out[i] = bits.tobytes()
    return out


def most_common(x: bytes, y: bytes, m: int, n: int) -> int:
    """Elements that two sets of m and n elements have in common at most, by their bitmaps: a bit that only one side has stands for an element that the other lacks."""
    p, q, width = int.from_bytes(x, "little"), int.from_bytes(y, "little"), max(len(x), len(y)) * 4
    while len(x) != len(y) and width >= min(len(x), len(y)) * 8:  # the wider is folded
        low = (1 << width) - 1
        p, q = (p & low | p >> width, q) if len(x) > len(y) else (p, q & low | q >> width)
        width //= 2
    both = (p & q).bit_count()
    return min(m - p.bit_count(), n - q.bit_count()) + both


def _sign(batches):
    for b in batches:
        kinds, uids, texts = (b.column(i).to_pylist() for i in range(3))
        found = sequence_sets(texts)
        rows = [i for i, s in enumerate(found) if s is not None and uids[i] is not None]
        sets = [found[i] for i in rows]
        if not sets:
            continue
        m, kind = signatures(sets), np.array([KINDS.index(kinds[i]) for i in rows], np.int32)
        with np.errstate(over="ignore"):
            c1 = np.array([s.sum(dtype=np.uint64) for s in sets]).astype(np.int64)
            c2 = np.array([(s * s).sum(dtype=np.uint64) + np.uint64(len(s)) for s in sets]).astype(np.int64)
        s1, s2, s3 = sketches(m)
        keys = tree_keys(m) ^ (kind[:, None].astype(np.uint64) * _APART)
        raw = keys.view(np.uint8).reshape(len(m), PASSES, TREES // PASSES, 8)[:, :, :, :5]
        prefixes = [_binary(raw[:, p].reshape(len(m), -1)) for p in range(PASSES)]
        fine = _binary(np.pad(fine_sketches(m), ((0, 0), (0, 8 * WORDS - FINE // 2))))
        columns = [pa.array(kind), pa.array([uids[i] for i in rows], pa.int64()), *map(pa.array, (c1, c2, s1, s2)), pa.array(s3, pa.int32()), *prefixes, fine, pa.array(list(map(len, sets)), pa.int32()), pa.array(bitmaps(sets), pa.binary())]
        yield pa.RecordBatch.from_arrays(columns, ["kind", "uid", "c1", "c2", "s1", "s2", "s3", *(f"prefixes{p}" for p in range(PASSES)), "fine", "size", "bits"])


def _binary(rows: np.ndarray) -> pa.Array:
    """Rows of bytes as a binary column."""
    return pa.array([r.tobytes() for r in rows], pa.binary())


def _bytes(column: pa.Array) -> np.ndarray:
    """A binary column of values of one length as rows of bytes."""
    return np.frombuffer(b"".join(column.to_pylist()), np.uint8).reshape(len(column), -1)


ROWS = "key long, packed long, s1 long, s2 long" + "".join(f", f{i} long" for i in range(WORDS))


def _spread(batches, first=0):
    """A row of each record and tree from the first: the key (tree, prefix, rest of the sketch), the record, its sketch and its finer sketch."""
    for b in batches:
        if not b.num_rows:
            continue
        packed, s1, s2, s3 = (b.column(i).to_numpy(zero_copy_only=False) for i in range(4))
        prefixes = _bytes(b.column(4)).reshape(len(packed), -1, 5)
        n = prefixes.shape[1]
        raw = np.zeros((len(packed), n, 8), np.uint8)
        raw[:, :, :5] = prefixes
        trees = np.arange(first, first + n, dtype=np.uint64) << np.uint64(PREFIX + REST)
        keys = (trees[None, :] | (raw.view(np.uint64)[:, :, 0] << np.uint64(REST)) | s3.astype(np.uint64)[:, None]).astype(np.int64)
        fine = list(_bytes(b.column(5)).view(np.int64).T) if b.num_columns > 5 else []
        columns = [pa.array(keys.ravel()), *(pa.array(np.repeat(x, n)) for x in (packed, s1, s2, *fine))]
        yield pa.RecordBatch.from_arrays(columns, ["key", "packed", "s1", "s2", *(f"f{i}" for i in range(len(fine)))])


def _agreement(a, b) -> np.ndarray:
    """Sketch bits that agree, of (key, s1, s2) on both sides."""
    differ = (np.bitwise_count((x ^ y).view(np.uint64)).astype(np.int16) for x, y in zip(((a[0] ^ b[0]) & ((1 << REST) - 1), a[1], a[2]), (np.int64(0), b[1], b[2])))
    return HASHES - sum(differ)


def _pairs_of(starts: np.ndarray, sizes: np.ndarray, most: int = 1 << 20):
    """Index pairs (i < j) within runs, in portions of about most."""
    for size in np.unique(sizes[sizes > 1]):
        at = starts[sizes == size]
        i, j = np.triu_indices(size, 1)
        step = max(1, most // len(i))
        for a in range(0, len(at), step):
            part = at[a : a + step, None]
            yield (part + i).ravel(), (part + j).ravel()


_PAIRS = ["kind", "a", "b", "agree", "region", "block"]
PAIRS = "kind int, a long, b long, agree int, region long, block binary"
#: Rows of an open region that a task holds before it puts them in blocks and reads on.
OPEN = 1_000_000


def _found(a, b, agree) -> pa.RecordBatch:
    none = pa.nulls(len(a))
    return pa.RecordBatch.from_arrays([pa.array((a & 1).astype(np.int32)), pa.array(np.minimum(a, b) >> 1), pa.array(np.maximum(a, b) >> 1), pa.array(agree, pa.int32()), none.cast(pa.int64()), none.cast(pa.binary())], _PAIRS)


def _unlike(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Groups of four bits in which words differ."""
    d = (x ^ y).view(np.uint64)
    d |= d >> np.uint64(1)
    d |= d >> np.uint64(2)
    return np.bitwise_count(d & np.uint64(0x1111111111111111)).astype(np.int16)


def _alike(x, i, y, j, agree):
    """Records of the pairs of rows i of x and j of y that both sketches let pass, and the bits that agree."""
    w = np.flatnonzero(agree >= LOOSE)
    i, j, agree = i[w], j[w], agree[w]
    a, b = x[1][i], y[1][j]
    ok = ((a ^ b) & 1 == 0) & (a != b) & (sum((_unlike(p[i], q[j]) for p, q in zip(x[4:], y[4:])), np.zeros(len(w), np.int16)) <= FINE - ALIKE)
    return a[ok], b[ok], agree[ok].astype(np.int32)


def _sweep(batches):
    """Walk a range of the order; yield pairs that the sketch lets pass, and in blocks the regions that are large or may go on in another task."""

    def work(rows, edges):
        region = rows[0] >> REST
        starts = np.flatnonzero(np.concatenate([[True], region[1:] != region[:-1]]))
        sizes = np.diff(np.append(starts, len(region)))
        apart = (sizes > DIRECT) | np.isin(region[starts], edges)
        for i, j in _pairs_of(starts[~apart], sizes[~apart]):
            pairs = _alike(rows, i, rows, j, _agreement([rows[c][i] for c in (0, 2, 3)], [rows[c][j] for c in (0, 2, 3)]))
            if len(pairs[0]):
                yield _found(*pairs)
        blocks = []
        for s, n in zip(starts[apart], sizes[apart]):
            step = max(BLOCK, -(-n // BLOCKS))
            blocks += [(int(region[s]), np.array([m]).tobytes() + np.stack([c[k : k + m] for c in rows]).tobytes()) for k in range(s, s + n, step) for m in [min(step, s + n - k)]]
        if blocks:
            none = pa.nulls(len(blocks))
            yield pa.RecordBatch.from_arrays([none.cast(pa.int32()), none.cast(pa.int64()), none.cast(pa.int64()), none.cast(pa.int32()), pa.array([r for r, _ in blocks], pa.int64()), pa.array([x for _, x in blocks], pa.binary())], _PAIRS)

    carry, edges = None, []
    for b in batches:
        new = [c.to_numpy(zero_copy_only=False) for c in b.columns]
        if not len(new[0]):
            continue
        if carry is None:
            edges = [int(new[0][0] >> REST)]  # the first region may have begun before
        rows = new if carry is None else [np.concatenate(x) for x in zip(carry, new)]
        last = rows[0][-1] >> REST
        cut = int(np.searchsorted(rows[0] >> REST, last))
        if cut:
            yield from work([c[:cut] for c in rows], edges)
        carry = [c[cut:] for c in rows]
        if len(carry[0]) > OPEN:
            edges.append(int(last))
            yield from work(carry, edges)
            carry = [c[:0] for c in carry]
    if carry is not None and len(carry[0]):
        yield from work(carry, [*edges, int(carry[0][0] >> REST)])  # and the last may go on


def _block(raw: bytes) -> np.ndarray:
    x = np.frombuffer(raw, np.int64)
    return x[1:].reshape(-1, x[0])


def _block_pairs(batches):
    """The pairs of two blocks, or within one where there is no other."""
    for b in batches:
        for one, other in zip(b.column(0), b.column(1)):
            x = _block(one.as_py())
            y = _block(other.as_py()) if other.is_valid else x
            at, out = np.arange(y.shape[1]), []
            for k in range(x.shape[1]):
                after = slice(k + 1 if y is x else 0, None)
                agree = _agreement(x[[0, 2, 3], k], y[[0, 2, 3], after])
                if (agree >= LOOSE).any():
                    out.append(_alike(x, np.full(len(agree), k), y, at[after], agree))
            if out:
                yield _found(*map(np.concatenate, zip(*out)))


KINDS = ("clause", "section")


def _name(c: str):
    return F.when(F.col(c) == 0, KINDS[0]).otherwise(KINDS[1])


def classes(signed: DataFrame) -> DataFrame:
    """kind, uid, rep, copies: of each record with a twin the class' first record and size; records alone in their class are left out."""
    own = signed.select("kind", "c1", "c2", "uid").distinct()
    size = own.groupBy("kind", "c1", "c2").agg(F.min("uid").alias("rep"), F.count("*").alias("copies")).filter("copies > 1")
    hot = F.broadcast(size.filter(F.col("copies") > HOT))
    others = own.join(hot, ["kind", "c1", "c2"], "left_anti").join(size.filter(F.col("copies") <= HOT), ["kind", "c1", "c2"])
    return others.unionByName(own.join(hot, ["kind", "c1", "c2"])).select("kind", "uid", "rep", "copies")


def _code(kind: str = "kind", uid: str = "uid") -> Column:
    return F.col(uid) * 2 + F.col(kind)


def candidates(signed: DataFrame, twins: DataFrame) -> DataFrame:
    """kind, a, b: pairs of class representatives that the forest finds and that their bitmaps allow."""
    spark = signed.sparkSession
    later = twins.filter("uid <> rep").select("kind", "uid")
    few = later.count() <= BROADCAST_IDS
    reps = signed.join(F.broadcast(later) if few else later, ["kind", "uid"], "left_anti")
    reps = reps.select(_code().alias("packed"), "s1", "s2", "s3", *(f"prefixes{p}" for p in range(PASSES)), "fine")
    reps = reps if few else settle(reps, "representatives")
    n = max(spark.sparkContext.defaultParallelism, int(spark.conf.get("spark.sql.shuffle.partitions")) // PASSES)
    tables = []
    for p in range(PASSES):
        spread = functools.partial(_spread, first=p * (TREES // PASSES))
        rows = over_batches(reps.select("packed", "s1", "s2", "s3", f"prefixes{p}", "fine"), spread, ROWS).repartitionByRange(n, "key", "packed").sortWithinPartitions("key")
        found = settle(over_batches(rows, _sweep, PAIRS), "forest")
        if not found.filter("region is not null").isEmpty():
            crowded = crowded_pairs(found)
            with_crowded = settle(found.filter("a is not null").unionByName(crowded), "pairs")
            release(found, crowded)
            found = with_crowded
        tables.append(found)
    pairs = functools.reduce(DataFrame.unionByName, [t.select("kind", "a", "b", "agree") for t in tables])
    met = pairs.groupBy("kind", "a", "b").agg(F.count("*").alias("trees"), F.max("agree").alias("agree"))
    met = settle(met.filter((F.col("trees") > 1) | (F.col("agree") >= STRICT)).select("kind", "a", "b"), "met")
    release(*tables, *([] if few else [reps]))
    out = in_portions(met, max(PORTION, signed.count() // 4), functools.partial(possible, signed), "candidates")
    release(met)
    return out


def in_portions(pairs: DataFrame, most: int, fn: Callable[[DataFrame, int], DataFrame], name: str) -> DataFrame:
    """fn of the pairs and their number, by portions of about most pairs, each written before the next begins."""
    n = pairs.count()
    parts = max(1, -(-n // most))
    chosen = [pairs if parts == 1 else pairs.filter(F.pmod(F.xxhash64("a"), F.lit(parts)) == i) for i in range(parts)]
    return functools.reduce(DataFrame.unionByName, [settle(fn(part, n // parts), name) for part in chosen])


def possible(signed: DataFrame, pairs: DataFrame, n: int) -> DataFrame:
    """The pairs whose bitmaps allow SIMILAR."""
    rows = signed.select("kind", "uid", "size", "bits")
    if n * 2 <= BROADCAST_IDS:
        ids = pairs.select(F.explode(F.array(_code(uid="a"), _code(uid="b"))).alias("packed")).distinct()
        rows = rows.withColumn("packed", _code()).join(F.broadcast(ids), "packed", "left_semi").drop("packed")
    rows = rows.dropDuplicates(["kind", "uid"])
    both = pairs.join(rows.withColumnsRenamed({"uid": "a", "size": "m", "bits": "x"}), ["kind", "a"]).join(rows.withColumnsRenamed({"uid": "b", "size": "n", "bits": "y"}), ["kind", "b"])
    return over_batches(both.select("kind", "a", "b", "m", "n", "x", "y"), _possible, "kind int, a long, b long")


def _possible(batches):
    for b in batches:
        keep = []
        for m, n, x, y in zip(*(c.to_pylist() for c in b.columns[3:])):
            common = most_common(x, y, m, n)
            keep.append(common / (m + n - common) >= SIMILAR)
        yield pa.RecordBatch.from_arrays(b.columns[:3], ["kind", "a", "b"]).filter(pa.array(keep, pa.bool_()))


def crowded_pairs(found: DataFrame) -> DataFrame:
    """Pairs within regions that lie in several blocks: each two blocks meet under a key of their own, spread over all tasks."""
    spark = found.sparkSession
    region = Window.partitionBy("region")
    blocks = found.filter("region is not null").select("region", "block").withColumns({"no": F.row_number().over(region.orderBy(F.xxhash64("block"))) - 1, "n": F.count("*").over(region)})
    blocks = settle(blocks, "crowded")
    others = F.sequence(F.lit(0), F.col("n") - 1)
    one = blocks.select("region", F.col("no").alias("i"), F.explode(F.filter(others, lambda j: j > F.col("no"))).alias("j"), "block")
    two = blocks.select("region", F.explode(F.filter(others, lambda i: i < F.col("no"))).alias("i"), F.col("no").alias("j"), F.col("block").alias("other"))
    both = one.join(two, ["region", "i", "j"]).select("block", "other").unionByName(blocks.select("block", F.lit(None).cast("binary").alias("other")))
    pairs = settle(over_batches(both.repartition(int(spark.conf.get("spark.sql.shuffle.partitions"))), _block_pairs, PAIRS), "crowded_pairs")
    release(blocks)
    return pairs


def _sets(batches, wanted=None):
    for b in batches:
        kinds, uids, texts = (b.column(i).to_pylist() for i in range(3))
        keep = range(len(uids))
        if wanted is not None and len(wanted):
            ids = np.array([-1 if u is None else u * 2 + KINDS.index(k) for u, k in zip(uids, kinds)], np.int64)
            keep = np.flatnonzero(wanted[np.minimum(np.searchsorted(wanted, ids), len(wanted) - 1)] == ids)
        elif wanted is not None:
            continue
        found = sequence_sets([texts[i] for i in keep])
        rows = [i for i, s in zip(keep, found) if s is not None]
        sets = [s for s in found if s is not None]
        if not sets:
            continue
        offsets = pa.array(np.cumsum([0, *map(len, sets)]).astype(np.int32))
        yield pa.RecordBatch.from_arrays(
            [pa.array([KINDS.index(kinds[i]) for i in rows], pa.int32()), pa.array([uids[i] for i in rows], pa.int64()), pa.ListArray.from_arrays(offsets, pa.array(np.concatenate(sets).astype(np.int64)))], ["kind", "uid", "seqs"]
        )


def _share(batches):
    for b in batches:
        kind, one, other, x, y = b.columns
        out = []
        for s, t in zip(x, y):
            s, t = s.values.to_numpy(zero_copy_only=False), t.values.to_numpy(zero_copy_only=False)
            common = len(np.intersect1d(s, t, assume_unique=True))
            out.append(common / (len(s) + len(t) - common))
        yield pa.RecordBatch.from_arrays([kind, one, other, pa.array(out, pa.float64())], ["kind", "a", "b", "similarity"])


def verified(records: DataFrame, pairs: DataFrame, n: int) -> DataFrame:
    """kind, a, b, similarity of the n pairs whose sets really reach SIMILAR."""
    spark = records.sparkSession
    ids = pairs.select(F.explode(F.array(_code(uid="a"), _code(uid="b"))).alias("packed")).distinct()
    schema = "kind int, uid long, seqs array<long>"
    if n * 2 <= BROADCAST_IDS:
        shared = spark.sparkContext.broadcast(np.sort(ids.toPandas()["packed"].to_numpy(np.int64)))
        sets = over_batches(records, lambda batches: _sets(batches, shared.value), schema)
    else:
        code = F.col("record_uid") * 2 + F.when(F.col("record_kind") == KINDS[0], 0).otherwise(1)
        sets = over_batches(records.withColumn("packed", code).join(ids, "packed", "left_semi").select("record_kind", "record_uid", "text"), _sets, schema)
    sets = sets.dropDuplicates(["kind", "uid"])  # repeated deliveries
    left = pairs.join(sets.withColumnsRenamed({"uid": "a", "seqs": "x"}), ["kind", "a"])
    both = left.join(sets.withColumnsRenamed({"uid": "b", "seqs": "y"}), ["kind", "b"]).select("kind", "a", "b", "x", "y")
    return over_batches(both, _share, "kind int, a long, b long, similarity double").filter(F.col("similarity") >= SIMILAR)


def links(records: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Links between class representatives (kind, a, b, similarity), and the classes' members (kind, uid, rep, copies)."""
    records = widen(records.select("record_kind", "record_uid", "text")).filter("record_uid is not null")
    with shuffles_freed(records.sparkSession):
        signed = settle(over_batches(records, _sign, SIGNED), "signed")
        twins = settle(classes(signed), "twins")
        most = max(PORTION, signed.count() // 4) // 4
        pairs = candidates(signed, twins)
        release(signed)
        return in_portions(pairs, most, functools.partial(verified, records), "links"), twins


def _members(rows: DataFrame, side: str, wanted: Column, twins: DataFrame) -> DataFrame:
    """rows(kind, a, b, n_a, n_b) with the side's representative replaced by every member of its class where wanted; large classes meet them on salted keys."""
    salts = lambda n: F.ceil(F.col(n) / COPIES).cast("int")
    own = twins.select("kind", F.col("rep").alias(side), F.pmod(F.xxhash64("uid"), salts("copies")).cast("int").alias("salt"), "uid")
    many = wanted & (F.col(f"n_{side}") > 1)
    spread = rows.filter(many).withColumn("salt", F.explode(F.sequence(F.lit(0), salts(f"n_{side}") - 1)))
    return spread.join(own, ["kind", side, "salt"]).drop(side, "salt").withColumnRenamed("uid", side).unionByName(rows.filter(~many))


def similar_pairs(records: DataFrame) -> DataFrame:
    """record_kind, uid_a, uid_b: the links with the copies joined in.

    Every member of a class is paired with the records outside it that the class is linked with, and with its fellow copies; of a
    class of over COPIES copies each is paired with the first instead of with all, and two such classes that are linked are paired
    member by representative, as all their pairs are implied. No link between different texts is lost.
    """
    found, twins = links(records)
    size = twins.filter("uid = rep")
    for c in ("a", "b"):
        found = found.join(size.select("kind", F.col("rep").alias(c), F.col("copies").alias(f"n_{c}")), ["kind", c], "left").fillna(1, [f"n_{c}"])
    found = found.select("kind", "a", "b", "n_a", "n_b")
    both = (F.col("n_a") > COPIES) & (F.col("n_b") > COPIES)
    across = _members(_members(found, "a", F.lit(True), twins), "b", ~both, twins).unionByName(_members(found.filter(both), "b", F.lit(True), twins)).select("kind", F.col("a").alias("x"), F.col("b").alias("y"))
    some = twins.filter(F.col("copies") <= COPIES)
    within = some.select("kind", "rep", F.col("uid").alias("x")).join(some.select("kind", "rep", F.col("uid").alias("y")), ["kind", "rep"]).filter("x < y").select("kind", "x", "y")
    star = twins.filter((F.col("copies") > COPIES) & (F.col("uid") != F.col("rep"))).select("kind", F.col("rep").alias("x"), F.col("uid").alias("y"))
    pairs = across.unionByName(within).unionByName(star)
    return pairs.select(_name("kind").alias("record_kind"), F.least("x", "y").alias("uid_a"), F.greatest("x", "y").alias("uid_b")).distinct()


def representative_links(records: DataFrame) -> DataFrame:
    """record_kind, uid_a, uid_b, similarity, n_a, n_b: the links between class representatives and how many copies either has; members are in groups()."""
    found, twins = links(records)
    for c in ("a", "b"):
        found = found.join(twins.filter("uid = rep").select("kind", F.col("rep").alias(c), F.col("copies").alias(f"n_{c}")), ["kind", c], "left").fillna(1, [f"n_{c}"])
    return found.select(_name("kind").alias("record_kind"), F.col("a").alias("uid_a"), F.col("b").alias("uid_b"), F.round("similarity", 9).alias("similarity"), "n_a", "n_b")


def components(edges: DataFrame) -> DataFrame:
    """kind, uid, root of the nodes of edges(kind, a, b): the smallest id reachable, by alternating large and small stars."""
    e = edges.select("kind", F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v"))
    while True:
        both = e.unionByName(e.select("kind", F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("kind", "u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        large = both.join(low, ["kind", "u"]).filter("v > u").select("kind", F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        large = settle(large, "large_star")
        low = large.groupBy("kind", "u").agg(F.min("v").alias("m"))
        small = large.join(low, ["kind", "u"])
        small = small.filter("v <> m").select("kind", F.col("v").alias("u"), F.col("m").alias("v")).unionByName(low.select("kind", "u", F.col("m").alias("v"))).distinct()
        new = settle(small, "small_star")
        if new.exceptAll(e).isEmpty() and e.exceptAll(new).isEmpty():
            return new.select("kind", F.col("u").alias("uid"), F.col("v").alias("root")).unionByName(new.select("kind", F.col("v").alias("uid"), F.col("v").alias("root"))).distinct()
        e = new


def groups(records: DataFrame) -> DataFrame:
    """record_kind, record_uid, group_uid, n_links: every record with a near duplicate, its group and the links of its class."""
    found, twins = links(records)
    edges = found.select("kind", "a", "b").unionByName(twins.filter("uid <> rep").select("kind", F.col("rep").alias("a"), F.col("uid").alias("b")))
    degree = found.select("kind", F.explode(F.array("a", "b")).alias("rep")).groupBy("kind", "rep").agg(F.count("*").alias("n"))
    rows = components(edges).join(twins.select("kind", "uid", F.col("rep"), "copies"), ["kind", "uid"], "left").withColumn("rep", F.coalesce("rep", "uid"))
    rows = rows.join(degree, ["kind", "rep"], "left")
    return rows.select(_name("kind").alias("record_kind"), F.col("uid").alias("record_uid"), F.col("root").alias("group_uid"), (F.coalesce("n", F.lit(0)) + F.coalesce(F.col("copies") - 1, F.lit(0))).alias("n_links"))
