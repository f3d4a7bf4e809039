"""Near duplicates by an exact n-gram Jaccard join with adaptive prefixes.

Shingles are ordered rare first by a frequency table. Of a set of ``n``
shingles that must share ``t`` with its partner, the first ``n - t + m`` make a
prefix of which any partner's prefix shares at least ``m``. Each document picks
its ``m`` by estimated cost: a longer prefix brings more postings, but a pair
must meet in more of them before it is verified. A pair must meet in as many as
the smaller of its two ``m``; then it is verified on the texts.

The result is components, so links inside a known component need not be found
again. First, a light pass links documents to a head through their smallest
hashes (every link is verified; what it misses does not matter), so that a
large group of copies becomes one component with few comparisons. Then the
prefix join looks at all pairs of documents in different components.
"""

from __future__ import annotations

import tempfile
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from newsloom.llm import words as wd
from newsloom.llm.components import components
from newsloom.session import cut, release

N = 5
LOWEST = -(1 << 63)
CELL_BITS, BLOCK_BITS = 22, 16       # frequency cells; cells in one row of the table
MATCHES = (1, 2, 4, 8)               # the m to choose from
VERIFY_COST = 20                     # of a candidate, in postings
HEAD_TOKENS, SKETCH, ALIKE = 4, 16, 12    # smallest hashes with heads, in a sketch, and shared sixteenths of it
FEW, MORE_HEADS = 16, 18              # documents of a hash, and heads of one with more
BUCKET_BYTES = 64 << 20              # text whose prefixes make one bucket
PAIRS_AT_ONCE, PLACES_AT_ONCE = 500_000, 100_000
SETS_AT_ONCE = 20_000                 # distinct sets that a task remembers to link copies at once
TEXT_BYTES, BATCH_BYTES = 2 << 20, 8 << 20       # text whose shingles a task holds; of an Arrow batch


def shingles(column: pa.Array, n: int = N) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(owner, hash) of distinct shingles, by owner and hash, and the bounds of each text's."""
    text = wd.Words(column, wd.NOT_SPACE, lower=True)
    words = text.hashes()
    owners, hashes = [], []
    for k in range(1, n + 1):
        at, per_text = text.windows(k)
        if k < n:                     # fewer words: the whole sequence
            keep = text.counts == k
            at, per_text = text.first[:-1][keep], keep.astype(np.int64)
        owners.append(np.repeat(np.arange(len(per_text)), per_text))
        hashes.append(wd.mix(wd.chain(words, k)[at] + np.uint64(k)))
    owner, h = np.concatenate(owners), np.concatenate(hashes)
    order = np.lexsort((h, owner))
    owner, h = owner[order], h[order]
    new = np.ones(len(h), bool)
    new[1:] = (owner[1:] != owner[:-1]) | (h[1:] != h[:-1])
    owner, h = owner[new], h[new]
    return owner, h, np.searchsorted(owner, np.arange(len(text.counts) + 1))


def _planes(values: np.ndarray) -> bytes:
    """Byte planes: the high bytes of small numbers become zeros for Spark's compression."""
    return values.view(np.uint8).reshape(len(values), -1).T.tobytes()


def _values(planes: bytes, kind: type) -> np.ndarray:
    width = np.dtype(kind).itemsize
    return np.frombuffer(planes, np.uint8).reshape(width, -1).T.copy().view(kind).ravel()


# --- frequency table ----------------------------------------------------------

def _cells(n: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(1 << CELL_BITS, np.int32)
        for batch in wd.slices(batches, limit=TEXT_BYTES):
            text = wd.Words(batch.column("text"), wd.NOT_SPACE, lower=True)
            at, _ = text.windows(n)
            h = wd.mix(wd.chain(text.hashes(), n)[at] + np.uint64(n))
            np.add.at(total, (h >> np.uint64(64 - CELL_BITS)).astype(np.int64), 1)
        parts = total.reshape(-1, 1 << BLOCK_BITS)
        used = np.flatnonzero(parts.any(axis=1))
        yield pa.RecordBatch.from_arrays(
            [pa.array(used.astype(np.int32)), pa.array([_planes(parts[b]) for b in used], pa.binary())],
            ["block", "counts"])
    return run


def _add(key: tuple, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    total = np.zeros(1 << BLOCK_BITS, np.int64)
    for batch in batches:
        for counts in batch.column("counts").to_pylist():
            total += _values(counts, np.int32)
    total = np.minimum(total, np.iinfo(np.int32).max).astype(np.int32)
    yield pa.RecordBatch.from_arrays([pa.array([key[0].as_py()], pa.int32()), pa.array([total.tobytes()])], ["block", "counts"])


def frequencies(rows: DataFrame, n: int = N) -> np.ndarray:
    """How often the shingles of each cell of hashes occur in all texts: a table of fixed size.

    It orders shingles and estimates costs; results do not depend on it.
    """
    summed = rows.select("text").mapInArrow(_cells(n), "block int, counts binary").groupBy("block").applyInArrow(
        _add, "block int, counts binary")
    total = np.zeros((1 << (CELL_BITS - BLOCK_BITS), 1 << BLOCK_BITS), np.int32)
    for row in summed.collect():          # a fixed number of rows
        total[row["block"]] = np.frombuffer(row["counts"], np.int32)
    return total.ravel()


# --- one row per document -------------------------------------------------------

UNITS = ("doc long, n long, link long, need int, prefix binary, tokens array<long>, sketch array<int>")


def least_overlap(n: np.ndarray) -> np.ndarray:
    """Shingles that a set of ``n`` shares with any partner at Jaccard 0.8: 0.8 n, rounded up."""
    return (4 * n + 4) // 5


def _units(n_words: int, table: np.ndarray):
    floor = int(table.sum(dtype=np.int64) // len(table))
    cost = np.maximum(table - floor, 0)

    def lists(values: np.ndarray, bounds: np.ndarray, most: np.ndarray, kind) -> pa.Array:
        taken = np.repeat(bounds[:-1] - (np.cumsum(most) - most), most) + np.arange(most.sum())
        offsets = np.concatenate(([0], np.cumsum(most))).astype(np.int32)
        return pa.ListArray.from_arrays(pa.array(offsets), pa.array(values[taken].astype(kind)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen = {}
        for batch in wd.slices(batches, limit=TEXT_BYTES):
            owner, h, bounds = shingles(batch.column("text"), n_words)
            docs, size = batch.column("doc").to_numpy(), np.diff(bounds)
            # Equal sets in this slice, or among the last ones, go on as one; the others are linked to it.
            sums = [np.concatenate(([np.uint64(0)], np.cumsum(wd.mix(h + np.uint64(s))))) for s in (1, 2)]
            marks = [s[bounds[1:]] - s[bounds[:-1]] for s in sums]
            by = np.lexsort((docs, marks[1], marks[0], size))
            new = np.ones(len(by), bool)
            new[1:] = (size[by][1:] != size[by][:-1]) | (marks[0][by][1:] != marks[0][by][:-1]) | (marks[1][by][1:] != marks[1][by][:-1])
            head = np.empty(len(by), np.int64)
            head[by] = docs[by][np.flatnonzero(new)][np.cumsum(new) - 1] if len(by) else []
            first = np.zeros(len(by), bool)
            first[by] = new
            copy = ~first & (size > 0)
            for i in np.flatnonzero(first & (size > 0)).tolist():
                mark = int(marks[0][i]), int(marks[1][i]), int(size[i])
                if (before := seen.setdefault(mark, int(docs[i]))) != docs[i]:
                    head[i], copy[i] = before, True
            if len(seen) > SETS_AT_ONCE:
                seen.clear()
            # Rare first; the prefix and its m by cost.
            each = cost[(h >> np.uint64(64 - CELL_BITS)).astype(np.int64)]
            order = np.lexsort((h, each, owner))
            spent = np.concatenate(([0], np.cumsum(each[order])))
            t = least_overlap(size)
            best, need, length = np.full(len(size), np.inf), np.zeros(len(size), np.int64), np.zeros(len(size), np.int64)
            for m in MATCHES:
                p = np.minimum(size - t + m, size)
                postings = spent[bounds[:-1] + p] - spent[bounds[:-1]]
                price = p + postings * (1 + VERIFY_COST / m)
                better = (m <= t) & (price < best)
                best, need, length = np.where(better, price, best), np.where(better, m, need), np.where(better, p, length)
            length[copy] = 0
            ranked = h[order]
            taken = np.repeat(bounds[:-1] - (np.cumsum(length) - length), length) + np.arange(length.sum())
            offsets = np.concatenate(([0], np.cumsum(length) * 8)).astype(np.int32)
            prefix = pa.Array.from_buffers(pa.binary(), len(size), [None, pa.py_buffer(offsets), pa.py_buffer(ranked[taken].tobytes())])
            live = np.where(copy, 0, size)
            yield pa.RecordBatch.from_arrays(
                [pa.array(docs), pa.array(size.astype(np.int64)), pa.array(head, mask=~copy), pa.array(need.astype(np.int32)), prefix,
                 lists(h.view(np.int64), bounds, np.minimum(live, HEAD_TOKENS), np.int64),
                 lists((h >> np.uint64(32)).astype(np.uint32).view(np.int32), bounds, np.minimum(live, SKETCH), np.int32)],
                ["doc", "n", "link", "need", "prefix", "tokens", "sketch"])
    return run


# --- verification ---------------------------------------------------------------

def _pack_text(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    packer = zstandard.ZstdCompressor(level=1)
    for batch in batches:
        packed = [packer.compress((t or "").encode()) for t in batch.column("text").to_pylist()]
        yield pa.RecordBatch.from_arrays([batch.column("doc"), pa.array(packed, pa.binary())], ["doc", "packed"])


def _verify(n: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        unpack = zstandard.ZstdDecompressor()
        for batch in batches:
            first = 0
            while first < batch.num_rows:  # a few MB at once, or one pair
                last, size, both = first, 0, []
                while last < batch.num_rows and (last == first or size < TEXT_BYTES):
                    pair = [unpack.decompress(batch.column(c)[last].as_py()) for c in ("left", "right")]
                    size += len(pair[0]) + len(pair[1])
                    both.extend(t.decode() for t in pair)
                    last += 1
                owner, h, bounds = shingles(pa.array(both, pa.string()), n)
                sizes = np.diff(bounds)
                pair = owner // 2
                order = np.lexsort((h, pair))
                same = (h[order][1:] == h[order][:-1]) & (pair[order][1:] == pair[order][:-1])
                shared = np.bincount(pair[order][1:][same], minlength=len(both) // 2)
                good = 9 * shared >= 4 * (sizes[::2] + sizes[1::2])
                yield batch.slice(first, last - first).select(["a", "b"]).filter(pa.array(good))
                first = last
    return run


def verify(rows: DataFrame, pairs: DataFrame, n: int = N) -> DataFrame:
    """Those of ``pairs`` (``a, b``, documents of ``rows``) that are similar enough, as a written table.

    Packed texts are dealt by document once, at any size of the input; then
    only those of documents in pairs go on.
    """
    pairs = cut(pairs)
    wanted = pairs.select(F.col("a").alias("doc")).union(pairs.select("b")).distinct()
    packed = cut(rows.mapInArrow(_pack_text, "doc long, packed binary").join(wanted.hint("merge"), "doc", "left_semi").dropDuplicates(["doc"]))
    side = lambda one, name: packed.select(F.col("doc").alias(one), F.col("packed").alias(name))
    links = cut(pairs.join(side("a", "left"), "a").join(side("b", "right"), "b").select("a", "b", "left", "right").mapInArrow(
        _verify(n), "a long, b long"))
    release(pairs, packed)
    return links


# --- candidates -----------------------------------------------------------------

def head_pairs(units: DataFrame) -> DataFrame:
    """Each document with the heads of its smallest hashes, where sketches look alike.

    A hash of a few documents has one head. One of many has ``MORE_HEADS`` of
    them, so that a document of a large group that is too far from one head is near another.
    """
    each = units.select("doc", "n", "sketch", F.explode("tokens").alias("token"))

    def head(seed: int) -> Column:
        return F.min_by(F.struct("doc", "n", "sketch"), F.xxhash64(F.lit(seed), "token", "doc"))

    heads = each.groupBy("token").agg(head(0).alias("head"), F.count("*").alias("c")).filter("c > 1")
    met = cut(each.join(heads, "token"))
    many = met.filter(F.col("c") > FEW).select("token", "doc", "n", "sketch")
    more = many.groupBy("token").agg(F.array_distinct(F.array(*[head(s) for s in range(1, MORE_HEADS)])).alias("heads"))
    small, large = F.least("n", "head.n"), F.greatest("n", "head.n")
    alike = F.size(F.array_intersect("sketch", "head.sketch")) * 16 >= F.least(F.lit(SKETCH), small) * ALIKE
    columns = ("doc", "n", "sketch", "head")
    pairs = met.select(*columns).unionByName(
        many.join(more, "token").withColumn("head", F.explode("heads")).select(*columns))
    return pairs.filter("doc <> head.doc").filter((small * 5 >= large * 4) & alike).select(
        F.least("doc", "head.doc").alias("a"), F.greatest("doc", "head.doc").alias("b")).distinct()


PACKED = "bucket int, keys binary, owners binary, places binary, docs binary, roots binary, sizes binary, needs binary"


def _pack(buckets: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            prefix = batch.column("prefix").to_pylist()
            h = np.frombuffer(b"".join(prefix), np.uint64)
            length = np.array([len(p) // 8 for p in prefix], np.int64)
            owner = np.repeat(np.arange(len(prefix)), length)
            place = (np.arange(len(h)) - np.repeat(np.cumsum(length) - length, length)).astype(np.uint32)
            doc, root, n, need = (batch.column(c).to_numpy() for c in ("doc", "root", "n", "need"))
            bucket = ((h >> np.uint64(32)) % np.uint64(buckets)).astype(np.uint32)
            order = np.argsort(bucket, kind="stable")
            cuts = np.searchsorted(bucket[order], np.arange(buckets + 1))
            keys, rows = h.astype(np.uint32), []
            for b in np.flatnonzero(np.diff(cuts)):
                mine = order[cuts[b]:cuts[b + 1]]
                own, number = np.unique(owner[mine], return_inverse=True)
                # Steps between documents, and how far each is from its root: mostly small numbers.
                rows.append((int(b), keys[mine].tobytes(), _planes(number.astype(np.uint32)), _planes(place[mine]),
                             _planes(np.diff(doc[own], prepend=0)), _planes(doc[own] - root[own]),
                             _planes(n[own].astype(np.uint32)), need[own].astype(np.uint8).tobytes()))
            if rows:
                yield pa.RecordBatch.from_arrays(
                    [pa.array(c, pa.int32() if i == 0 else pa.binary()) for i, c in enumerate(zip(*rows))],
                    ["bucket", "keys", "owners", "places", "docs", "roots", "sizes", "needs"])
    return run


def _summed(codes: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Each code once, in order, with its counts added up."""
    at = np.argsort(codes)
    codes = codes[at]
    first = np.flatnonzero(np.append(True, codes[1:] != codes[:-1])) if len(codes) else at
    return codes[first], np.add.reduceat(counts[at], first) if len(codes) else counts


class _Runs:
    """Sorted runs of codes and counts in a nameless file of the task."""

    def __init__(self):
        self.file, self.runs = None, []

    def add(self, codes: np.ndarray, counts: np.ndarray) -> None:
        self.file = self.file or tempfile.TemporaryFile()
        self.runs.append((self.file.seek(0, 2), len(codes)))
        self.file.write(codes.tobytes() + counts.astype(np.int32).tobytes())

    def _read(self, run: int, first: int, last: int) -> tuple[np.ndarray, np.ndarray]:
        begin, size = self.runs[run]
        out = []
        for at, kind in ((begin, np.int64), (begin + 8 * size, np.int32)):
            width = np.dtype(kind).itemsize
            self.file.seek(at + first * width)
            out.append(np.frombuffer(self.file.read((last - first) * width), kind))
        return tuple(out)

    def merged(self, codes: np.ndarray, counts: np.ndarray, most: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """All runs and one more, each code once, in parts of about ``most`` codes."""
        if not self.runs:
            yield codes, counts
            return
        self.add(codes, counts)
        at, block = [0] * len(self.runs), max(most // len(self.runs), 1)
        while any(a < size for a, (_, size) in zip(at, self.runs)):
            parts = {r: self._read(r, a, min(a + block, size)) for r, (a, (_, size)) in enumerate(zip(at, self.runs)) if a < size}
            # Behind the least of the blocks' last codes, a run may hold more than what is read.
            upto = min(part[0][-1] for part in parts.values())
            for r, (c, n) in parts.items():
                k = int(np.searchsorted(c, upto, side="right"))
                parts[r] = c[:k], n[:k]
                at[r] += k
            yield _summed(*(np.concatenate(x) for x in zip(*parts.values())))
        self.file.close()


def _meet(buckets: int):
    """Pairs of a bucket that share prefix shingles, are in different components and near in size.

    Of a match, its places in the two prefixes say how often the pair can meet
    at most, before, here and behind; where that is too little the match does
    not count, as the pair cannot be similar. A pair that meets often enough
    over all ``buckets`` has its part of that in one of them at least, so a
    bucket with less than that part says nothing. Pairs are held up to a bound:
    beyond it, sorted runs of them wait in a file that ends with the task.
    """
    def run(key: tuple, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        # By posting: key, place and entry. By entry, a document of a row: all else.
        keys, places, entries, docs, roots, sizes, needs = ([] for _ in range(7))
        n_entries = 0
        for batch in batches:
            for row in batch.to_pylist():
                own = np.cumsum(_values(row["docs"], np.int64))
                keys.append(np.frombuffer(row["keys"], np.uint32))
                places.append(_values(row["places"], np.uint32).view(np.int32))
                entries.append(_values(row["owners"], np.uint32).astype(np.int32) + np.int32(n_entries))
                docs.append(own)
                roots.append(own - _values(row["roots"], np.int64))
                sizes.append(_values(row["sizes"], np.uint32).view(np.int32))
                needs.append(np.frombuffer(row["needs"], np.uint8))
                n_entries += len(own)
        batch = row = None
        # Documents and roots as numbers: all that the loop holds are small integers.
        names, number = np.unique(np.concatenate(docs), return_inverse=True)
        del docs
        number = number.astype(np.int32)
        root = np.unique(np.concatenate(roots), return_inverse=True)[1].astype(np.int32)
        del roots
        n = np.concatenate(sizes)
        behind = (least_overlap(n) - np.concatenate(needs)).astype(np.int32)       # shingles behind the prefix
        size_of, behind_of = np.zeros(len(names), np.int32), np.zeros(len(names), np.int32)
        size_of[number], behind_of[number] = n, behind
        del sizes, needs
        keys = np.concatenate(keys)
        order = np.argsort(keys, kind="stable").astype(np.int32)
        keys = keys[order]
        starts = np.flatnonzero(np.append(True, keys[1:] != keys[:-1]))
        length = np.diff(np.append(starts, len(keys))).astype(np.int32)
        del keys
        entry = np.concatenate(entries)[order]
        del entries
        rooted = root[entry]
        several = np.minimum.reduceat(rooted, starts) != np.maximum.reduceat(rooted, starts)
        del rooted
        use = np.repeat(several, length)
        entry, order, length = entry[use], order[use], length[several]
        place = np.concatenate(places)[order]
        ends = np.repeat(np.cumsum(length, dtype=np.int32), length)
        del order, places, starts, several, use
        number, root, n, behind = number[entry], root[entry], n[entry], behind[entry]
        del entry
        found, held = [], 0
        total = np.zeros(0, np.int64), np.zeros(0, np.int32)      # pair, matches
        runs = _Runs()

        def fold():
            codes = np.concatenate([total[0], *found])
            counts = np.concatenate([total[1], np.ones(len(codes) - len(total[0]), np.int32)])
            found.clear()
            return _summed(codes, counts)

        def told(codes, shared):
            x, y = codes // max(len(names), 1), codes % max(len(names), 1)
            need = np.maximum((4 * (size_of[x] + size_of[y]) + 8) // 9 - np.maximum(behind_of[x], behind_of[y]), 1)
            return pa.RecordBatch.from_arrays(
                [pa.array(names[x]), pa.array(names[y]), pa.array(shared.astype(np.int64)), pa.array(need.astype(np.int32))],
                ["a", "b", "shared", "need"]).filter(pa.array(shared * np.int64(buckets) >= need))

        open_, step = np.arange(len(number), dtype=np.int32), 1
        while len(open_ := open_[open_ + step < ends[open_]]):
            for first in range(0, len(open_), PLACES_AT_ONCE):
                at = open_[first:first + PLACES_AT_ONCE]
                to = at + step
                overlap = (4 * (n[at] + n[to]) + 8) // 9
                least = np.maximum(overlap - np.maximum(behind[at], behind[to]), 1)
                most = 1 + np.minimum(place[at], place[to])         # up to this match
                rest = np.minimum(n[at] - place[at], n[to] - place[to]) - 1
                in_prefix = np.minimum(n[at] - behind[at] - place[at], n[to] - behind[to] - place[to]) - 1
                good = (root[at] != root[to]) & (number[at] != number[to]) & (most + rest >= overlap) & (most + in_prefix >= least)
                if good.any():
                    x, y = number[at[good]].astype(np.int64), number[to[good]].astype(np.int64)
                    found.append(np.minimum(x, y) * len(names) + np.maximum(x, y))
                    held += len(x)
                    if held > PAIRS_AT_ONCE:
                        total, held = fold(), 0
                        if len(total[0]) > PAIRS_AT_ONCE:
                            runs.add(*total)
                            total = total[0][:0], total[1][:0]
            step += 1
        if found:
            total = fold()
        for part in runs.merged(*total, PAIRS_AT_ONCE):
            yield told(*part)
    return run


def prefix_pairs(units: DataFrame, buckets: int) -> DataFrame:
    """Pairs of different components that share enough prefix shingles; ``units`` with ``root``."""
    met = units.mapInArrow(_pack(buckets), PACKED).groupBy("bucket").applyInArrow(
        _meet(buckets), "a long, b long, shared long, need int")
    part = F.ceil(F.col("need") / F.lit(buckets))          # buckets that keep silent share less than this
    most = F.col("shared") + (F.lit(buckets) - F.col("told")) * (part - 1)
    return met.groupBy("a", "b").agg(
        F.sum("shared").alias("shared"), F.count("*").alias("told"), F.max("need").alias("need")
    ).filter(most >= F.col("need")).select("a", "b")


def _doc(key: str) -> Column:
    return F.coalesce(F.col(f"`{key}`").cast("long"), F.lit(LOWEST))


def _with_root(rows: DataFrame, roots: DataFrame) -> DataFrame:
    return rows.join(roots, "doc", "left").withColumn("root", F.coalesce("root", "doc"))


def classes(documents: DataFrame, key: str = "doc_id", text: str = "text", n: int = N,
            bucket_bytes: int = BUCKET_BYTES) -> DataFrame:
    """``doc_id, n_shingles, component_id`` for each row.

    A-Z count as lower case; words are runs of non-spaces; a set is the distinct
    shingles of ``n`` words, of fewer words the whole sequence; nulls and texts
    without words have none and link with nothing. Links need a Jaccard
    similarity of 0.8. Rows with one key are one document and must have one
    text; a row with a null key links with nothing and has no component; an
    empty table gives no rows; other columns are ignored.
    """
    wd.small_batches(documents.sparkSession, BATCH_BYTES)
    rows = documents.select(_doc(key).alias("doc"), F.col(f"`{text}`").alias("text"))
    size = rows.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    nameless = rows.filter(F.col("doc") == LOWEST)
    rows = rows.filter(F.col("doc") != LOWEST)
    table = frequencies(rows, n)
    every = cut(rows.mapInArrow(_units(n, table), UNITS))
    units = every.filter("link is null and n > 0")
    near = verify(rows, head_pairs(units), n)
    copies = every.filter("link is not null and link <> doc").select(F.col("doc").alias("a"), F.col("link").alias("b"))
    roots = cut(components(near.unionByName(copies)))
    rooted = _with_root(units.select("doc", "n", "need", "prefix"), roots)
    pairs = prefix_pairs(rooted, int(size // bucket_bytes) + 1)
    links = verify(rows, pairs, n)
    joined = links.join(roots.select(F.col("doc").alias("a"), F.col("root").alias("ra")), "a", "left").join(
        roots.select(F.col("doc").alias("b"), F.col("root").alias("rb")), "b", "left").select(
        F.coalesce("ra", "a").alias("a"), F.coalesce("rb", "b").alias("b"))
    merged = components(joined).select(F.col("doc").alias("root"), F.col("root").alias("last"))
    whole = _with_root(every.select("doc", "n"), roots).join(merged, "root", "left").withColumn(
        "component", F.coalesce("last", "root"))
    none = F.lit(None).cast("long")
    return whole.select(F.col("doc").alias("doc_id"), F.col("n").alias("n_shingles"), F.col("component").alias("component_id")).unionByName(
        nameless.mapInArrow(_units(n, table), UNITS).select(
            none.alias("doc_id"), F.col("n").alias("n_shingles"), none.alias("component_id")))


def keep_one(documents: DataFrame, key: str = "doc_id", text: str = "text", n: int = N) -> DataFrame:
    """One document of each component: the one with the smallest key. All columns stay."""
    found = classes(documents, key, text, n)
    gone = found.filter(~F.col("doc_id").eqNullSafe(F.col("component_id"))).select(F.col("doc_id").alias("__llm_gone")).distinct()
    return documents.join(gone, F.col(f"`{key}`").cast("long") == F.col("__llm_gone"), "left_anti")
