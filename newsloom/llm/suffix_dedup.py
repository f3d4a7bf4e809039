"""Repeated byte strings removed wherever a smaller document holds them, by suffix arrays.

Every string of ``WIDTH`` bytes belongs to the bucket of its minimizer, the
smallest hash of the ``GRAM``-byte strings inside, so equal strings meet in one
bucket whatever surrounds them. Consecutive windows of one minimizer travel as
one segment. First only minimizers travel: those found in one text alone cannot
stand in a repeat, and their windows go no further.

Each bucket sorts the suffixes of its segments, takes the Burrows-Wheeler
transform and expands intervals breadth-first: a backward step takes all
intervals of strings of ``l`` bytes to those of ``l + STEP`` bytes, so the
borders between suffixes come up by increasing common prefix. It stops at
``WIDTH``: suffixes without a border between them share that many bytes at
least, and what lies above never costs anything. The smallest document of each
such interval keeps the string, all others lose it.

Nothing is gathered by value: equal segments of a slice, and then of a bucket,
are combined to the one of the smallest document (the later ones lie in it
whole), and equal texts count as one text with its smallest document. Windows
around a passage that many documents hold share its minimizers but nothing
else; those with bytes that stand nowhere else in the bucket are not sorted.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from newsloom.llm import words as wd

WIDTH = 50
GRAM = 16
LOWEST = -(1 << 63)
BATCH_BYTES = 8 << 20
PIECE_BYTES, SLICE_BYTES = 1 << 20, 2 << 20
KEY_BUCKET_BYTES = 32 << 20      # text whose minimizers make one bucket
TEXT_BUCKET_BYTES = 4 << 20      # text whose segments make one bucket, if all of them went on
STEP = 5                         # bytes of one backward step
PRUNE = 32                       # bytes that a window may not have for itself
CHUNK_BYTES, FOLD_BYTES = 4 << 20, 64 << 20
BORDER = 0xFF                    # between segments; no byte of UTF-8
WHOLE = -1                       # length of a range that means the whole text
SHARED = 0xFFFFFFFF              # owner of a minimizer that several texts of a slice hold

_BASE = 0x9E3779B97F4A7C15
_BYTE = wd.mix(np.arange(1, 257, dtype=np.uint64) * np.uint64(_BASE))
_TOP = np.uint64(1 << 63)


class _Powers:
    """Powers of an odd base modulo 2^64 and of its inverse, kept for the longest slice so far."""

    up = down = np.zeros(0, np.uint64)

    @classmethod
    def of(cls, n: int) -> tuple[np.ndarray, np.ndarray]:
        if len(cls.up) < n:
            size = max(n, SLICE_BYTES + PIECE_BYTES)
            cls.up, cls.down = (np.cumprod(np.full(size, b, np.uint64)) for b in (_BASE, pow(_BASE, -1, 1 << 64)))
        return cls.up[:n], cls.down[:n]


def gram_hashes(data: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Hash of the ``k`` bytes from each place on, by differences of one running sum; which of them repeat after two bytes."""
    up, down = _Powers.of(len(data))
    total = np.zeros(len(data) + 1, np.uint64)
    np.multiply(_BYTE[data], up, out=total[1:])
    np.cumsum(total, out=total)
    h = total[k:] - total[:-k]
    h *= down[:len(h)]
    plain = np.zeros(len(h), bool)
    if k > 2:
        inner = total[k - 2:] - total[:-(k - 2)]
        inner *= down[:len(inner)]
        plain = inner[:-2] == inner[2:]
    h ^= h >> np.uint64(32)
    h *= np.uint64(_BASE)
    h ^= h >> np.uint64(29)
    return h, plain


def _least(values: np.ndarray, w: int) -> np.ndarray:
    """Minimum of ``w`` values from each place on."""
    out, size = values, 1
    while size < w:
        step = min(size, w - size)
        out = np.minimum(out[:-step], out[step:])
        size += step
    return out


def minimizer_runs(data: np.ndarray, bounds: np.ndarray, width: int, gram: int) -> tuple[np.ndarray, ...]:
    """Start, number of windows, key and piece of each run of windows with one minimizer.

    Grams that repeat after one or two bytes (rows of blanks or dashes) come
    last in the order, so that they gather only windows that hold nothing else.
    """
    none = np.zeros(0, np.int64)
    per_piece = np.maximum(np.diff(bounds) - width + 1, 0)
    if not per_piece.any():
        return none, none, none.view(np.uint64), none
    h, plain = gram_hashes(data, gram)
    h >>= np.uint64(1)
    h[plain] |= _TOP
    least = _least(h, width - gram + 1)
    new = np.ones(len(least), bool)
    np.not_equal(least[1:], least[:-1], out=new[1:])
    edge = np.concatenate((bounds[:-1], bounds[:-1] + per_piece))      # where a piece's windows begin and end
    new[edge[edge < len(new)]] = True
    first = np.flatnonzero(new)
    n = np.diff(np.append(first, len(new)))
    piece = np.searchsorted(bounds, first, side="right") - 1
    inside = first - bounds[piece] < per_piece[piece]
    first, n, piece = first[inside], n[inside], piece[inside]
    return first, n, wd.mix(least[first] + np.uint64(gram)), piece


def pieces(batch: pa.RecordBatch, width: int) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """Bytes, bounds, row and place of pieces of texts, a few MB at once however long a text is.

    Pieces of one text overlap so that each window lies in exactly one.
    """
    held, rows, places, size = [], [], [], 0

    def flush():
        bounds = np.concatenate(([0], np.cumsum([len(x) for x in held]))).astype(np.int64)
        return np.frombuffer(b"".join(held), np.uint8), bounds, np.array(rows, np.int64), np.array(places, np.int64)

    for row, text in enumerate(batch.column("text").cast(pa.binary()).to_pylist()):
        for place in range(0, max(len(text or b"") - width + 1, 0), PIECE_BYTES):
            held.append(text[place:place + PIECE_BYTES + width - 1])
            rows.append(row)
            places.append(place)
            size += len(held[-1])
            if size >= SLICE_BYTES:
                yield flush()
                held, rows, places, size = [], [], [], 0
    if held:
        yield flush()


# --- minimizers that several texts hold -------------------------------------------

KEYS = "bucket int, keys binary, owners binary, texts binary"


def _keys(width: int, gram: int, buckets: int):
    """Distinct minimizers of a slice's texts, per bucket.

    A minimizer that several texts of the slice hold goes out once, and their
    own rows, which need no answer, go through one bucket.
    """
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            marks = batch.column("mark").to_numpy()
            for data, bounds, rows, _ in pieces(batch, width):
                _, _, key, piece = minimizer_runs(data, bounds, width, gram)
                texts, number = np.unique(marks[rows[piece]], return_inverse=True)
                order = np.lexsort((number, key))
                key, number = key[order], number[order]
                new = np.ones(len(key), bool)
                new[1:] = (key[1:] != key[:-1]) | (number[1:] != number[:-1])
                key, number = key[new], number[new]
                starts = np.flatnonzero(np.append(True, key[1:] != key[:-1])) if len(key) else np.zeros(0, np.int64)
                several = np.repeat(np.diff(np.append(starts, len(key))) > 1, np.diff(np.append(starts, len(key))))
                sent = ~several
                sent[starts] = True
                owner = np.where(several, SHARED, number)[sent].astype(np.uint32)
                k = key[sent]
                bucket = ((k >> np.uint64(32)) % np.uint64(buckets)).astype(np.int64)
                by = np.argsort(bucket, kind="stable")
                cuts = np.searchsorted(bucket[by], np.arange(buckets + 1))
                out = []
                for b in np.flatnonzero(np.diff(cuts)):
                    mine = by[cuts[b]:cuts[b + 1]]
                    own, short = np.unique(owner[mine], return_inverse=True)
                    known = own[own != SHARED].astype(np.int64)
                    short = np.where(owner[mine] == SHARED, SHARED, short).astype(np.uint32)
                    out.append((int(b), k[mine].astype(np.uint32).tobytes(), short.tobytes(), texts[known].tobytes()))
                if several.any():
                    out.append((int(texts[0] % buckets), key[several].astype(np.uint32).tobytes(), b"",
                                texts[number[several]].tobytes()))
                yield pa.RecordBatch.from_arrays(
                    [pa.array(c, t) for c, t in zip(zip(*out), (pa.int32(), pa.binary(), pa.binary(), pa.binary()))]
                    if out else [pa.array([], t) for t in (pa.int32(), pa.binary(), pa.binary(), pa.binary())],
                    ["bucket", "keys", "owners", "texts"])
    return run


SHARES = "mark long, key int"


def _shared(key: tuple, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Texts of a bucket with those of their minimizers that another text holds too."""
    parts = []

    def answer(mark: np.ndarray, k: np.ndarray) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(mark), pa.array(k.view(np.int32))], ["mark", "key"])

    for batch in batches:
        for k, owner, texts in zip(*(batch.column(c).to_pylist() for c in ("keys", "owners", "texts"))):
            k, texts = np.frombuffer(k, np.uint32), np.frombuffer(texts, np.int64)
            if not owner:
                yield answer(texts, k)
                continue
            owner = np.frombuffer(owner, np.uint32)
            known = owner == SHARED
            mark = np.zeros(len(k), np.int64)
            mark[~known] = texts[owner[~known]]
            parts.append((k, mark, known))
    if not parts:
        return
    k, mark, known = (np.concatenate(x) for x in zip(*parts))
    order = np.argsort(k, kind="stable")
    k, mark, known = k[order], mark[order], known[order]
    starts = np.flatnonzero(np.append(True, k[1:] != k[:-1]))
    least, most = (f.reduceat(np.where(known, g, mark), starts)
                   for f, g in ((np.minimum, np.iinfo(np.int64).max), (np.maximum, np.iinfo(np.int64).min)))
    # Texts of other slices differ from the several ones of a flagged row, or are among them: either way shared.
    shared = np.logical_or.reduceat(known, starts) | (least != most)
    use = np.repeat(shared, np.diff(np.append(starts, len(k)))) & ~known
    yield answer(mark[use], k[use])


# --- segments -----------------------------------------------------------------------

SEGMENTS = "bucket int, data binary, sizes binary, owners binary, docs binary, marks binary, places binary"
GONE = "doc long, mark long, start long, n int"


def _packed(rows: list[tuple]) -> pa.RecordBatch:
    kinds = (pa.int32(), *[pa.binary()] * 6)
    columns = zip(*rows) if rows else [()] * 7
    return pa.RecordBatch.from_arrays([pa.array(list(c), t) for c, t in zip(columns, kinds)],
                                      ["bucket", "data", "sizes", "owners", "docs", "marks", "places"])


def _segments(width: int, gram: int, buckets: int):
    """Segments of shared minimizers, per bucket; ``data`` is empty for those that lie whole in a smaller document."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            docs, marks = batch.column("doc").to_numpy(), batch.column("mark").to_numpy()
            wanted = batch.column("keys")
            owner_of = np.repeat(np.arange(batch.num_rows), np.diff(wanted.offsets.to_numpy()))
            wanted = np.unique((owner_of.astype(np.uint64) << np.uint64(32)) | wanted.flatten().to_numpy().view(np.uint32).astype(np.uint64))
            for data, bounds, rows, places in pieces(batch, width):
                start, n, key, piece = minimizer_runs(data, bounds, width, gram)
                code = (rows[piece].astype(np.uint64) << np.uint64(32)) | key.astype(np.uint32).astype(np.uint64)
                at = np.minimum(np.searchsorted(wanted, code), max(len(wanted) - 1, 0))
                use = np.flatnonzero(wanted[at] == code) if len(wanted) else np.zeros(0, np.int64)
                start, n, key, piece = start[use], n[use], key[use], piece[use]
                row, place = rows[piece], places[piece] + start - bounds[piece]
                raw = data.tobytes()
                texts = [raw[a:b] for a, b in zip(start.tolist(), (start + n + width - 1).tolist())]
                # The smallest document of equal segments holds the others whole.
                least: dict[bytes, int] = {}
                doc = docs[row]
                for t, d in zip(texts, doc.tolist()):
                    if d < least.get(t, d + 1):
                        least[t] = d
                later = doc > np.array([least[t] for t in texts], np.int64) if texts else np.zeros(0, bool)
                bucket = ((key >> np.uint64(32)) % np.uint64(buckets)).astype(np.int64)
                by = np.lexsort((later, bucket))
                cuts = np.flatnonzero(np.append(True, (np.diff(bucket[by]) != 0) | (np.diff(later[by].astype(np.int8)) != 0))) if len(by) else []
                out = []
                for mine in np.split(by, cuts[1:]) if len(by) else ():
                    own, number = np.unique(row[mine], return_inverse=True)
                    gone = bool(later[mine[0]])
                    out.append((int(bucket[mine[0]]), b"" if gone else b"".join([texts[i] for i in mine.tolist()]), n[mine].astype(np.uint32).tobytes(),
                                number.astype(np.uint32).tobytes(), docs[own].tobytes(), marks[own].tobytes(),
                                place[mine].astype(np.int64).tobytes()))
                yield _packed(out)
    return run


def suffix_order(text: np.ndarray, depth: int) -> np.ndarray:
    """Suffixes of ``text`` (read in a circle) sorted by their first ``depth`` bytes at least.

    By doubling: a suffix that is alone with its first bytes has its place, the
    others are sorted by the places of what follows.
    """
    n = len(text)
    circle = np.concatenate((text, np.resize(text, 8)))
    key = np.zeros(n, np.uint64)
    for i in range(8):
        key = (key << np.uint64(8)) | circle[i:i + n]
    order = np.argsort(key)
    key, size = key[order], 8
    new = np.append(True, key[1:] != key[:-1])
    rank = np.empty(n, np.uint64)
    rank[order] = np.maximum.accumulate(np.where(new, np.arange(n), 0))
    slots = np.arange(n)
    while size < depth:
        tied = ~new
        tied[:-1] |= tied[1:]
        slots = slots[tied]                       # places whose suffixes are not told apart yet
        if not len(slots):
            break
        at = order[slots]
        key = (rank[at] << np.uint64(32)) | rank[(at + size) % n]
        by = np.argsort(key)
        at, key = at[by], key[by]
        order[slots] = at
        new = np.append(True, key[1:] != key[:-1])
        rank[at] = np.maximum.accumulate(np.where(new, slots, 0))
        size *= 2
    return order


def expand(text: np.ndarray, order: np.ndarray, width: int, step: int = STEP) -> np.ndarray:
    """Where a suffix (in ``order``) shares less than ``width`` bytes with the one before it.

    Backward extension of all intervals at once, level by level. The transform
    gives for each place the place of the suffix behind its first byte; taken
    ``step`` times, the one behind ``step`` bytes. Two neighbours that begin with
    the same bytes stay in one interval if what follows them was in one. An
    interval is never extended by the border byte, so no common string crosses it.
    """
    n = len(text)
    before = text[order - 1]                                  # the transform; order 0 wraps round
    behind = np.argsort(before, kind="stable").astype(np.int32)
    char = before[behind]
    one = np.ones(n, bool)                                    # borders between strings of one byte
    one[1:] = (char[1:] != char[:-1]) | (char[1:] == BORDER)

    def stride(k: int) -> tuple[np.ndarray, np.ndarray]:
        """The place ``k`` bytes on, and the borders between strings of ``k`` bytes."""
        at, cut, first = np.arange(n, dtype=np.int32), one.copy(), char
        for _ in range(k - 1):
            at = behind[at]
            first = char[at]
            cut[1:] |= (first[1:] != first[:-1]) | (first[1:] == BORDER)
        return behind[at], cut

    cut, done = np.zeros(n, bool), 0
    cut[:1] = True
    jump = None
    while done < width:
        k = min(step, width - done)
        if jump is None or k != step:
            jump, border = stride(k)
        interval = np.cumsum(cut, dtype=np.int32)[jump]
        cut = border.copy()
        cut[1:] |= interval[1:] != interval[:-1]
        done += k
    return cut


class Segments:
    """Distinct segments of a bucket, each of its smallest document; the bytes lie one behind the other."""

    def __init__(self, width: int):
        self.width, self.parts, self.size = width, [], 0

    def add(self, data: bytes, n: np.ndarray, doc: np.ndarray, mark: np.ndarray, place: np.ndarray) -> Iterator[tuple]:
        """Take segments in; yields the ranges of those that lie whole in one of a smaller document."""
        data = np.frombuffer(data, np.uint8)
        up, down = _Powers.of(len(data))
        end = np.cumsum(n + self.width - 1)
        start = end - n - self.width + 1
        names = []
        for seed in (0, 1):
            total = np.zeros(len(data) + 1, np.uint64)
            np.cumsum(wd.mix(_BYTE + np.uint64(seed))[data] * up, out=total[1:])
            names.append(wd.mix((total[end] - total[start]) * down[start] + n.astype(np.uint64)))
        self.parts.append((data, n, doc, mark, place, *names))
        self.size += len(data)
        if self.size > FOLD_BYTES:
            yield self.fold()

    def fold(self) -> tuple:
        """Keep each segment of its smallest document, at all places where that document has it."""
        if len(self.parts) == 0:
            return tuple([np.zeros(0, np.int64)] * 4)
        data, n, doc, mark, place, h1, h2 = (np.concatenate(x) for x in zip(*self.parts))
        end = np.cumsum(n + self.width - 1)
        order = np.lexsort((place, mark, doc, h2, h1))
        new = np.ones(len(order), bool)
        new[1:] = (h1[order][1:] != h1[order][:-1]) | (h2[order][1:] != h2[order][:-1])
        head = doc[order][np.flatnonzero(new)][np.cumsum(new) - 1]
        later = order[doc[order] > head]
        stay = np.sort(order[doc[order] == head])
        keep = np.zeros(len(n), bool)
        keep[stay] = True
        self.parts = [(data[np.repeat(keep, n + self.width - 1)], *(x[keep] for x in (n, doc, mark, place, h1, h2)))]
        self.size = len(self.parts[0][0])
        return doc[later], mark[later], place[later], n[later]

    def _chunks(self, sizes: np.ndarray) -> Iterator[tuple[int, int]]:
        first, total = 0, np.cumsum(sizes)
        while first < len(sizes):
            last = max(first + 1, int(np.searchsorted(total, total[first] - sizes[first] + CHUNK_BYTES)))
            yield first, last
            first = last

    def pruned(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Text of what may repeat, with borders; the segment and the place there of each byte.

        A window goes if it holds ``PRUNE`` bytes that stand in no other place of the bucket.
        """
        data, n = self.parts[0][0], self.parts[0][1]
        sizes = n + self.width - 1
        ends = np.cumsum(sizes)
        k = min(PRUNE, self.width)
        cells = min(24, max(10, int(np.ceil(np.log2(len(data) + 1))) + 1))
        count = np.zeros(1 << cells, np.int64)
        none = np.zeros(0, np.int64)
        parts = []
        for counting in (True, False):
            for first, last in self._chunks(sizes):
                base = ends[first] - sizes[first]
                part, own = data[base:ends[last - 1]], sizes[first:last]
                if len(part) < k:
                    continue
                stop = np.cumsum(own)
                inside = np.ones(len(part) - k + 1, bool)          # not over the end of a segment
                over = (stop[:-1, None] - np.arange(1, k)).ravel() if k > 1 else none
                inside[over[(over >= 0) & (over < len(inside))]] = False
                h, _ = gram_hashes(part, k)
                cell = (h >> np.uint64(64 - cells)).astype(np.int64)
                if counting:
                    count += np.bincount(cell[inside], minlength=len(count))
                    continue
                shared = inside & (count[cell] > 1)
                windows = _least(shared, self.width - k + 1)
                keep = wd.covered(np.flatnonzero(windows), self.width, len(part))
                at = np.flatnonzero(keep)
                number = np.repeat(np.arange(first, last), own)[at]
                place = at - (stop - own)[number - first]
                parts.append((part[at], number, place))
        if not parts:
            return np.zeros(0, np.uint8), none, none
        text, number, place = (np.concatenate(x) for x in zip(*parts))
        # A border in front of each stretch, and one at the end.
        gap = np.ones(len(text), bool)
        gap[1:] = (number[1:] != number[:-1]) | (place[1:] != place[:-1] + 1)
        where = np.append(np.flatnonzero(gap), len(text))
        return (np.insert(text, where, BORDER), np.insert(number, where, -1), np.insert(place, where, -1))

    def repeats(self) -> tuple:
        """Ranges of windows that a segment of a smaller document holds too."""
        _, _, doc, mark, start, h1, h2 = self.parts[0]
        text, number, offset = self.pruned()
        none = tuple([np.zeros(0, np.int64)] * 4)
        if len(text) <= self.width:
            return none
        order = suffix_order(text, self.width)
        first = np.flatnonzero(expand(text, order, self.width))
        size = np.diff(np.append(first, len(order)))
        several = size > 1
        if not several.any():
            return none
        at = order[np.repeat(several, size)]
        size = size[several]
        owner = doc[number[at]]
        least = np.minimum.reduceat(owner, np.cumsum(size) - size)
        gone = np.sort(at[owner > np.repeat(least, size)])
        number, offset = number[gone], offset[gone]
        if not len(gone):
            return none
        new = np.append(True, (np.diff(number) != 0) | (np.diff(offset) != 1))
        n = np.diff(np.append(np.flatnonzero(new), len(number)))
        number, offset = number[new], offset[new]
        return doc[number], mark[number], start[number] + offset, n


def _find(width: int):
    """Ranges of windows that a smaller document holds as well; one bucket."""
    def answer(ranges: tuple) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays(
            [pa.array(np.asarray(x).astype(t)) for x, t in zip(ranges, (np.int64, np.int64, np.int64, np.int32))],
            ["doc", "mark", "start", "n"])

    def run(key: tuple, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = Segments(width)
        for batch in batches:
            for data, n, owner, docs, marks, places in zip(*(batch.column(c).to_pylist() for c in ("data", "sizes", "owners", "docs", "marks", "places"))):
                n, place = np.frombuffer(n, np.uint32).astype(np.int64), np.frombuffer(places, np.int64)
                owner = np.frombuffer(owner, np.uint32)
                doc, mark = (np.frombuffer(x, np.int64)[owner] for x in (docs, marks))
                if not data:
                    yield answer((doc, mark, place, n))
                    continue
                for ranges in held.add(data, n, doc, mark, place):
                    yield answer(ranges)
        if held.parts:
            yield answer(held.fold())
            yield answer(held.repeats())
    return run


# --- whole tables ---------------------------------------------------------------------

def _doc(key: str) -> Column:
    return F.coalesce(F.col(f"`{key}`").cast("long"), F.lit(LOWEST))


def repeats(rows: DataFrame, width: int = WIDTH, gram: int = GRAM, bucket_bytes: int = TEXT_BUCKET_BYTES) -> DataFrame:
    """``doc, mark, start, n``: windows (``n`` from ``start`` on) that start in a smaller document too.

    ``rows`` has ``doc``, ``text`` and ``mark``, a hash of the text. A text that
    a smaller document holds whole has one row with ``n`` = ``WHOLE``.
    """
    size = rows.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    twin = F.xxhash64(F.lit(1), "text")
    classes = rows.select("doc", "mark", twin.alias("twin")).groupBy("mark", "twin").agg(
        F.min("doc").alias("head"), F.max("doc").alias("last"))
    copies = rows.select("doc", "mark", twin.alias("twin")).join(
        classes.filter("head <> last"), ["mark", "twin"]).filter("doc > head").select(
        "doc", "mark", F.lit(0).cast("long").alias("start"), F.lit(WHOLE).alias("n"))
    shared = rows.select("mark", "text").mapInArrow(
        _keys(width, gram, int(size // KEY_BUCKET_BYTES) + 1), KEYS).groupBy("bucket").applyInArrow(_shared, SHARES)
    heads = classes.select("mark", F.col("head").alias("doc"))
    wanted = shared.groupBy("mark").agg(F.collect_list("key").alias("keys")).join(heads, "mark").select("doc", "mark", "keys")
    candidates = rows.join(wanted, ["doc", "mark"])
    segments = candidates.mapInArrow(_segments(width, gram, int(size // bucket_bytes) + 1), SEGMENTS)
    return segments.groupBy("bucket").applyInArrow(_find(width), GONE).unionByName(copies)


class Ranges:
    """The ranges of a column of texts; those of one text as bounds of the maximal removed runs, rows (from, to)."""

    def __init__(self, column: pa.Array, width: int):
        if isinstance(column, pa.ChunkedArray):
            column = column.combine_chunks()
        self.width = width
        size = pc.fill_null(pc.list_value_length(column), 0).to_numpy(zero_copy_only=False)
        self.first = np.concatenate(([0], np.cumsum(size)))
        flat = column.flatten()
        self.start, self.n = (flat.field(i).to_numpy(zero_copy_only=False).astype(np.int64) for i in (0, 1))

    def of(self, row: int, size: int) -> np.ndarray:
        own = slice(self.first[row], self.first[row + 1])
        start, n = self.start[own], self.n[own]
        if not len(start) or size < self.width:
            return np.zeros((0, 2), np.int64)
        if (n == WHOLE).any():
            return np.array([[0, size]])
        order = np.argsort(start, kind="stable")
        start, end = start[order], np.maximum.accumulate((start + n + self.width - 1)[order])
        new = np.append(True, start[1:] > end[:-1])
        last = np.append(np.flatnonzero(new)[1:] - 1, len(end) - 1)
        return np.stack((start[new], end[last]), axis=1)


DIGEST = "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string, spans array<struct<first:long,last:long>>"


def dedupe(documents: DataFrame, key: str = "doc_id", text: str = "text", width: int = WIDTH, gram: int = GRAM,
           bucket_bytes: int = TEXT_BUCKET_BYTES) -> DataFrame:
    """``doc_id, n_bytes, n_removed, n_spans, kept_sha256, spans`` for each row; spans are removed bytes, first to last.

    Texts are UTF-8 bytes, null counts as empty. A byte goes if a string of
    ``width`` bytes over it also starts in a document with a smaller key.
    Texts shorter than that lose nothing. Rows with one key are one document,
    which loses nothing to itself; a null key is below all others; an empty
    table gives no rows; other columns are ignored.
    """
    if not 1 <= gram <= width:
        raise ValueError("gram must lie between 1 and width")
    wd.small_batches(documents.sparkSession, BATCH_BYTES)
    body = F.coalesce(F.col(f"`{text}`"), F.lit(""))
    rows = documents.select(F.col(f"`{key}`").cast("long").alias("doc_id"), _doc(key).alias("doc"),
                            F.xxhash64(body).alias("mark"), body.alias("text"))
    gone = repeats(rows, width, gram, bucket_bytes).groupBy("doc", "mark").agg(
        F.collect_list(F.struct("start", "n")).alias("ranges"))

    def finish(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ranges, n, sha, cuts = Ranges(batch.column("ranges"), width), [], [], []
            for row, text in enumerate(batch.column("text").cast(pa.binary()).to_pylist()):
                cuts.append(ranges.of(row, len(text)))
                digest, at = hashlib.sha256(), 0
                for first, last in cuts[-1].tolist():
                    digest.update(text[at:first])
                    at = last
                digest.update(text[at:])
                n.append(len(text))
                sha.append(digest.hexdigest())
            flat = np.concatenate(cuts) if cuts else np.zeros((0, 2), np.int64)
            bounds = np.concatenate(([0], np.cumsum([len(c) for c in cuts])))
            total = np.concatenate(([0], np.cumsum(flat[:, 1] - flat[:, 0])))
            spans = pa.ListArray.from_arrays(pa.array(bounds.astype(np.int32)), pa.StructArray.from_arrays(
                [pa.array(flat[:, 0].copy()), pa.array(flat[:, 1] - 1)], ["first", "last"]))
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), pa.array(n, pa.int64()), pa.array(total[bounds[1:]] - total[bounds[:-1]]),
                 pa.array(np.diff(bounds).astype(np.int64)), pa.array(sha, pa.string()), spans],
                ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256", "spans"])

    return rows.join(gone, ["doc", "mark"], "left").select("doc_id", "text", "ranges").mapInArrow(finish, DIGEST)


def apply(documents: DataFrame, key: str = "doc_id", text: str = "text", **limits) -> DataFrame:
    """``documents`` without the removed bytes; where a cut splits a character, its rest becomes U+FFFD."""
    wd.small_batches(documents.sparkSession, BATCH_BYTES)
    width = limits.get("width", WIDTH)
    keyed = documents.withColumns({"__llm_doc": _doc(key), "__llm_mark": F.xxhash64(F.coalesce(F.col(f"`{text}`"), F.lit("")))})
    rows = keyed.select(F.col("__llm_doc").alias("doc"), F.col("__llm_mark").alias("mark"), F.coalesce(F.col(f"`{text}`"), F.lit("")).alias("text"))
    gone = repeats(rows, **limits).groupBy("doc", "mark").agg(F.collect_list(F.struct("start", "n")).alias("__llm_ranges"))
    names = documents.columns
    joined = keyed.join(gone.withColumnsRenamed({"doc": "__llm_doc", "mark": "__llm_mark"}), ["__llm_doc", "__llm_mark"], "left")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at, texts, ranges = batch.schema.get_field_index(text), [], Ranges(batch.column("__llm_ranges"), width)
            for row, t in enumerate(batch.column(at).to_pylist()):
                raw = (t or "").encode()
                cuts = ranges.of(row, len(raw)).tolist()
                if cuts:
                    kept, end = [], 0
                    for first, last in cuts:
                        kept.append(raw[end:first])
                        end = last
                    t = b"".join([*kept, raw[end:]]).decode(errors="replace")
                texts.append(t)
            yield batch.set_column(at, text, pa.array(texts, pa.string())).select(names)

    return joined.select(*[F.col(f"`{c}`") for c in names], "__llm_ranges").mapInArrow(run, documents.schema)
