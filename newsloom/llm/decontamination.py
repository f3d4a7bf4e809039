"""Benchmark decontamination with suffix arrays over the training text.

Every task turns its documents, in shards of bounded size, into a suffix array
of words. All suffixes of the benchmark items are looked up in it by binary
search. A suffix array here orders suffixes by the 16-bit codes of their words
to a depth of ``DEPTH`` words (at least a window); every place it yields is
checked on the 64-bit word hashes, and matches that go on are joined along
their diagonal, so lengths of verbatim matches are not limited by the depth.
Equal windows of the benchmark are searched once, and diagonals are followed
place by place, so memory holds the places of one window, however often both
texts repeat it.

Documents are never shuffled. The benchmark goes to the tasks in blocks of
about ``BLOCK_WORDS`` words (an item is never split); a larger benchmark takes
more than one block, each searched against all documents, and the results are
merged by row, whatever ids the rows have.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from newsloom.llm import words as wd
from newsloom.session import cut

WINDOW = 13
DEPTH = 16
SHARD_BYTES = 8 << 20
BLOCK_WORDS = 500_000
TOP = np.uint64(2**64 - 1)

#: per document and benchmark block: places and items of verbatim matches
HITS = "row_id long, n_words long, item_ids array<string>, starts array<long>, ends array<long>, longest long"


class SuffixArray:
    """Suffixes of a shard's words, ordered by ``DEPTH`` word codes.

    A suffix runs over the ends of documents; the check against the texts'
    bounds comes with the look-up.
    """

    def __init__(self, hashes: np.ndarray):
        code = (hashes >> np.uint64(48)) + np.uint64(1)        # 0 stands for "no word"
        code = np.minimum(code, np.uint64(65535))
        code = np.concatenate((code, np.zeros(DEPTH, np.uint64)))
        n = len(hashes)
        four = np.zeros(n + DEPTH, np.uint64)
        for j in range(4):
            part = np.zeros(n + DEPTH, np.uint64)
            part[:n + DEPTH - j] = code[j:]
            four |= part << np.uint64(16 * (3 - j))
        self.four = four
        order = np.argsort(four[:n], kind="stable")
        self.order = self._refine(order, n)

    def _refine(self, order: np.ndarray, n: int) -> np.ndarray:
        """Sort runs of equal leading codes by the codes that follow."""
        lead = self.four[order]
        same = np.zeros(n, bool)
        if n > 1:
            equal = lead[1:] == lead[:-1]
            same[1:] |= equal
            same[:-1] |= equal
        at = np.flatnonzero(same)
        if len(at):
            tied = order[at]
            keys = [self.four[np.minimum(tied + j, len(self.four) - 1)] for j in range(DEPTH - 4, -1, -4)]
            order[at] = tied[np.lexsort(keys)]
        return order

    def find(self, probes: np.ndarray, upper: bool) -> np.ndarray:
        """Binary search of rows of ``DEPTH // 4`` codes: first place not below (or above)."""
        low = np.zeros(len(probes), np.int64)
        high = np.full(len(probes), len(self.order), np.int64)
        while (open_ := low < high).any():
            mid = (low + high) // 2
            at = self.order[np.minimum(mid, len(self.order) - 1)]
            below = np.zeros(len(probes), bool)
            equal = np.ones(len(probes), bool)
            for j in range(probes.shape[1]):
                have = self.four[np.minimum(at + 4 * j, len(self.four) - 1)]
                below |= equal & (have < probes[:, j])
                equal &= have == probes[:, j]
            right = (below | equal) if upper else below
            low = np.where(open_ & right, mid + 1, low)
            high = np.where(open_ & ~right, mid, high)
        return low


class Benchmark:
    """A block of benchmark items: the suffixes that can start a window, ready to be searched."""

    def __init__(self, items: pa.Table, window: int):
        text = wd.Words(items.column("text"), wd.LETTERS, lower=True)
        self.hashes = text.hashes()
        self.ids = [str(x) for x in items.column("item_id").to_pylist()]
        size = np.minimum(text.counts, window)                 # a short item is one window
        per_item = np.where(text.counts > 0, text.counts - size + 1, 0)
        self.item = np.repeat(np.arange(len(per_item)), per_item)
        inside = np.arange(per_item.sum()) - np.repeat(np.cumsum(per_item) - per_item, per_item)
        self.start = text.first[:-1][self.item] + inside
        self.size = size[self.item]
        # Equal windows are one: ``first`` is one place of each, ``places`` lists all.
        marks = np.zeros((2, len(self.start)), np.uint64)
        for k in np.unique(self.size):
            mine = self.size == k
            for row, seed in enumerate((0, 1)):
                marks[row, mine] = wd.chain(wd.mix(self.hashes + np.uint64(seed)), int(k))[self.start[mine]]
        order = np.lexsort((self.start, marks[1], marks[0], self.size))
        new = np.ones(len(order), bool)
        new[1:] = (np.diff(self.size[order]) != 0) | (marks[:, order][:, 1:] != marks[:, order][:, :-1]).any(axis=0)
        self.places = order
        self.bounds = np.append(np.flatnonzero(new), len(order))
        first = order[new]
        self.window_start, self.window_size = self.start[first], self.size[first]
        low = np.minimum((self.hashes >> np.uint64(48)) + np.uint64(1), np.uint64(65535))
        reach = np.arange(DEPTH)
        at = np.minimum(self.window_start[:, None] + reach, max(len(low) - 1, 0))
        codes = low[at] if len(low) else np.zeros((0, DEPTH), np.uint64)
        used = reach < self.window_size[:, None]
        self.low = self._fours(np.where(used, codes, np.uint64(0)))
        self.high = self._fours(np.where(used, codes, np.uint64(65535)))

    @staticmethod
    def _fours(codes: np.ndarray) -> np.ndarray:
        parts = codes.reshape(len(codes), DEPTH // 4, 4)
        return (parts[:, :, 0] << np.uint64(48)) | (parts[:, :, 1] << np.uint64(32)) \
            | (parts[:, :, 2] << np.uint64(16)) | parts[:, :, 3]

    def matches(self, hashes: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(word place in the shard, window) of all windows that stand whole in one document."""
        if not len(hashes) or not len(self.start):
            return np.zeros(0, np.int64), np.zeros(0, np.int64)
        array = SuffixArray(hashes)
        first, last = array.find(self.low, upper=False), array.find(self.high, upper=True)
        n = last - first
        window = np.repeat(np.arange(len(n)), n)
        place = array.order[np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n) + np.repeat(first, n)]
        stop = bounds[np.searchsorted(bounds, place, side="right")]
        good = place + self.window_size[window] <= stop
        for j in range(int(self.window_size.max(initial=0))):         # verify on whole hashes
            check = good & (j < self.window_size[window])
            at = np.flatnonzero(check)
            good[at] &= hashes[place[at] + j] == self.hashes[self.window_start[window[at]] + j]
        return place[good], window[good]


def _runs(place: np.ndarray, window: np.ndarray, bench: Benchmark, owner: np.ndarray):
    """Longest matches: windows that follow each other in both texts, joined.

    A sweep over the places; what is held are the benchmark places that match at the current one.
    """
    order = np.argsort(place, kind="stable")
    place, window, owner = place[order], window[order], owner[order]
    cuts = np.flatnonzero(np.append(True, place[1:] != place[:-1])) if len(place) else np.zeros(0, np.int64)
    out: list[tuple] = []
    none = np.zeros(0, np.int64)
    last, held, items, begins, sizes = (-1, -1), none, none, none, none

    def close(done: np.ndarray) -> None:
        if done.any():
            out.append((np.full(int(done.sum()), last[0]), items[done], begins[done], last[1] + sizes[done]))

    for lo, hi in zip(cuts, np.append(cuts[1:], len(place))):
        here = (int(owner[lo]), int(place[lo]))
        suffix = np.concatenate([bench.places[bench.bounds[w]:bench.bounds[w + 1]] for w in window[lo:hi]])
        suffix = np.sort(suffix)                         # by place in the benchmark
        start, item, size = bench.start[suffix], bench.item[suffix], bench.size[suffix]
        begin = np.full(len(start), here[1])
        open_ = np.ones(len(held), bool)
        if len(held) and last == (here[0], here[1] - 1):
            at = np.minimum(np.searchsorted(held, start - 1), len(held) - 1)
            goes_on = (held[at] == start - 1) & (items[at] == item)
            begin[goes_on] = begins[at[goes_on]]
            open_[at[goes_on]] = False
        close(open_)
        last, held, items, begins, sizes = here, start, item, begin, size
    close(np.ones(len(held), bool))
    if not out:
        return none, none, none, none
    owner, item, begin, end = (np.concatenate(x) for x in zip(*out))
    order = np.lexsort((begin, item, owner))
    return owner[order], item[order], begin[order], end[order]


def _search(bench: Benchmark):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in wd.slices(batches, limit=SHARD_BYTES):
            text = wd.Words(batch.column("text"), wd.LETTERS, lower=True)
            place, window = bench.matches(text.hashes(), text.first)
            owner = np.searchsorted(text.first, place, side="right") - 1
            owner, item, begin, end = _runs(place, window, bench, owner)
            base = text.first[owner]
            begin, end = begin - base, end - base
            cut = np.searchsorted(owner, np.arange(batch.num_rows + 1))
            rows = {"item_ids": [], "starts": [], "ends": [], "longest": []}
            for i in range(batch.num_rows):
                mine = slice(cut[i], cut[i + 1])
                rows["item_ids"].append([bench.ids[x] for x in item[mine]])
                rows["starts"].append(begin[mine])
                rows["ends"].append(end[mine])
                rows["longest"].append(int((end[mine] - begin[mine]).max(initial=0)))
            yield pa.RecordBatch.from_pydict({
                "row_id": batch.column("row_id"), "n_words": pa.array(text.counts.astype(np.int64)),
                "item_ids": pa.array(rows["item_ids"], pa.list_(pa.string())),
                "starts": pa.array(rows["starts"], pa.list_(pa.int64())),
                "ends": pa.array(rows["ends"], pa.list_(pa.int64())),
                "longest": pa.array(rows["longest"], pa.int64()),
            })
    return run


def _block_count(items: DataFrame, limit: int) -> int:
    most = items.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    return int(most // 2 // limit) + 1


def _blocks(items: DataFrame, limit: int) -> Iterator[pa.Table]:
    """The benchmark in blocks of about ``limit`` words, read one after the other."""
    n = _block_count(items, limit)
    named = items.select(F.col("item_id").cast("string").alias("item_id"), "text")
    keyed = named.withColumn("block", F.pmod(F.xxhash64("item_id", "text"), F.lit(n)))
    for block in range(n):
        yield keyed.filter(F.col("block") == block).select("item_id", "text").toArrow()


def find(self, probes: np.ndarray, upper: bool) -> np.ndarray:
        """Binary search of rows of ``DEPTH // 4`` codes: first place not below (or above)."""
        low = np.zeros(len(probes), np.int64)
        high = np.full(len(probes), len(self.order), np.int64)
        while (open_ := low < high).any():
            mid = (low + high) // 2
            at = self.order[np.minimum(mid, len(self.order) - 1)]
            below = np.zeros(len(probes), bool)
            equal = np.ones(len(probes), bool)
            for j in range(probes.shape[1]):
                have = self.four[np.minimum(at + 4 * j, len(self.four) - 1)]
                below |= equal & (have < probes[:, j])
                equal &= have == probes[:, j]
            right = (below | equal) if upper else below
            low = np.where(open_ & right, mid + 1, low)
            high = np.where(open_ & ~right, mid, high)
        return low


class Benchmark:
    """A block of benchmark items: the suffixes that can start a window, ready to be searched."""

    def __init__(self, items: pa.Table, window: int):
        text = wd.Words(items.column("text"), wd.LETTERS, lower=True)
        self.hashes = text.hashes()
        self.ids = [str(x) for x in items.column("item_id").to_pylist()]
        size = np.minimum(text.counts, window)                 # a short item is one window
        per_item = np.where(text.counts > 0, text.counts - size + 1, 0)
        self.item = np.repeat(np.arange(len(per_item)), per_item)
        inside = np.arange(per_item.sum()) - np.repeat(np.cumsum(per_item) - per_item, per_item)
        self.start = text.first[:-1][self.item] + inside
        self.size = size[self.item]
        # Equal windows are one: ``first`` is one place of each, ``places`` lists all.
        marks = np.zeros((2, len(self.start)), np.uint64)
        for k in np.unique(self.size):
            mine = self.size == k
            for row, seed in enumerate((0, 1)):
                marks[row, mine] = wd.chain(wd.mix(self.hashes + np.uint64(seed)), int(k))[self.start[mine]]
        order = np.lexsort((self.start, marks[1], marks[0], self.size))
        new = np.ones(len(order), bool)
        new[1:] = (np.diff(self.size[order]) != 0) | (marks[:, order][:, 1:] != marks[:, order][:, :-1]).any(axis=0)
        self.places = order
        self.bounds = np.append(np.flatnonzero(new), len(order))
        first = order[new]
        self.window_start, self.window_size = self.start[first], self.size[first]
        low = np.minimum((self.hashes >> np.uint64(48)) + np.uint64(1), np.uint64(65535))
        reach = np.arange(DEPTH)
        at = np.minimum(self.window_start[:, None] + reach, max(len(low) - 1, 0))
        codes = low[at] if len(low) else np.zeros((0, DEPTH), np.uint64)
        used = reach < self.window_size[:, None]
        self.low = self._fours(np.where(used, codes, np.uint64(0)))
        self.high = self._fours(np.where(used, codes, np.uint64(65535)))

    @staticmethod
    def _fours(codes: np.ndarray) -> np.ndarray:
        parts = codes.reshape(len(codes), DEPTH // 4, 4)
        return (parts[:, :, 0] << np.uint64(48)) | (parts[:, :, 1] << np.uint64(32)) \
            | (parts[:, :, 2] << np.uint64(16)) | parts[:, :, 3]

    def matches(self, hashes: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(word place in the shard, window) of all windows that stand whole in one document."""
        if not len(hashes) or not len(self.start):
            return np.zeros(0, np.int64), np.zeros(0, np.int64)
        array = SuffixArray(hashes)
        first, last = array.find(self.low, upper=False), array.find(self.high, upper=True)
        n = last - first
        window = np.repeat(np.arange(len(n)), n)
        place = array.order[np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n) + np.repeat(first, n)]
        stop = bounds[np.searchsorted(bounds, place, side="right")]
        good = place + self.window_size[window] <= stop
        for j in range(int(self.window_size.max(initial=0))):         # verify on whole hashes
            check = good & (j < self.window_size[window])
            at = np.flatnonzero(check)
            good[at] &= hashes[place[at] + j] == self.hashes[self.window_start[window[at]] + j]
        return place[good], window[good]


def _runs(place: np.ndarray, window: np.ndarray, bench: Benchmark, owner: np.ndarray):
    """Longest matches: windows that follow each other in both texts, joined.

    A sweep over the places; what is held are the benchmark places that match at the current one.
    """
    order = np.argsort(place, kind="stable")
    place, window, owner = place[order], window[order], owner[order]
    cuts = np.flatnonzero(np.append(True, place[1:] != place[:-1])) if len(place) else np.zeros(0, np.int64)
    out: list[tuple] = []
    none = np.zeros(0, np.int64)
    last, held, items, begins, sizes = (-1, -1), none, none, none, none

    def close(done: np.ndarray) -> None:
        if done.any():
            out.append((np.full(int(done.sum()), last[0]), items[done], begins[done], last[1] + sizes[done]))

    for lo, hi in zip(cuts, np.append(cuts[1:], len(place))):
        here = (int(owner[lo]), int(place[lo]))
        suffix = np.concatenate([bench.places[bench.bounds[w]:bench.bounds[w + 1]] for w in window[lo:hi]])
        suffix = np.sort(suffix)                         # by place in the benchmark
        start, item, size = bench.start[suffix], bench.item[suffix], bench.size[suffix]
        begin = np.full(len(start), here[1])
        open_ = np.ones(len(held), bool)
        if len(held) and last == (here[0], here[1] - 1):
            at = np.minimum(np.searchsorted(held, start - 1), len(held) - 1)
            goes_on = (held[at] == start - 1) & (items[at] == item)
            begin[goes_on] = begins[at[goes_on]]
            open_[at[goes_on]] = False
        close(open_)
        last, held, items, begins, sizes = here, start, item, begin, size
    close(np.ones(len(held), bool))
    if not out:
        return none, none, none, none
    owner, item, begin, end = (np.concatenate(x) for x in zip(*out))
    order = np.lexsort((begin, item, owner))
    return owner[order], item[order], begin[order], end[order]


def _search(bench: Benchmark):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in wd.slices(batches, limit=SHARD_BYTES):
            text = wd.Words(batch.column("text"), wd.LETTERS, lower=True)
            place, window = bench.matches(text.hashes(), text.first)
            owner = np.searchsorted(text.first, place, side="right") - 1
            owner, item, begin, end = _runs(place, window, bench, owner)
            base = text.first[owner]
            begin, end = begin - base, end - base
            cut = np.searchsorted(owner, np.arange(batch.num_rows + 1))
            rows = {"item_ids": [], "starts": [], "ends": [], "longest": []}
            for i in range(batch.num_rows):
                mine = slice(cut[i], cut[i + 1])
                rows["item_ids"].append([bench.ids[x] for x in item[mine]])
                rows["starts"].append(begin[mine])
                rows["ends"].append(end[mine])
                rows["longest"].append(int((end[mine] - begin[mine]).max(initial=0)))
            yield pa.RecordBatch.from_pydict({
                "row_id": batch.column("row_id"), "n_words": pa.array(text.counts.astype(np.int64)),
                "item_ids": pa.array(rows["item_ids"], pa.list_(pa.string())),
                "starts": pa.array(rows["starts"], pa.list_(pa.int64())),
                "ends": pa.array(rows["ends"], pa.list_(pa.int64())),
                "longest": pa.array(rows["longest"], pa.int64()),
            })
    return run


def _blocks(items: DataFrame, limit: int) -> Iterator[pa.Table]:
    """The benchmark in blocks of at most about ``limit`` words, read one after the other."""
    sized = items.select(F.col("item_id").cast("string").alias("item_id"), "text",
                         F.coalesce(F.octet_length("text") / 2, F.lit(0)).cast("long").alias("most"))
    total = sized.agg(F.sum("most")).first()[0] or 0
    n = total // limit + 1
    keyed = sized.withColumn("block", F.pmod(F.xxhash64("item_id", "text"), F.lit(n)))
    for block in range(n):
        yield keyed.filter(F.col("block") == block).select("item_id", "text").toArrow()


def find(documents: DataFrame, items: DataFrame, window: int = WINDOW,
         block_words: int = BLOCK_WORDS) -> DataFrame:
    """Verbatim matches of benchmark items: columns of ``HITS`` for each row.

    ``documents`` has ``row_id`` and ``text``, ``items`` has ``item_id`` and
    ``text``; other columns are ignored. Null and empty texts have no words and
    no matches; an item without words matches nothing; an item of fewer words
    than ``window`` must occur whole; repeated items all count; an empty
    benchmark gives rows without matches. Rows with equal or null ids stay rows
    of their own. ``starts`` and ``ends`` bound the longest matches, in words
    from 0; ``item_ids`` names the item of each (a null id counts as "None").
    """
    if not 1 <= window <= DEPTH:
        raise ValueError(f"window must be from 1 to {DEPTH}")
    wd.small_batches(documents.sparkSession)
    rows = documents.select(F.col("row_id").cast("long").alias("row_id"), "text")
    if _block_count(items, block_words) == 1:
        (block,) = _blocks(items, block_words)
        return rows.mapInArrow(_search(Benchmark(block, window)), HITS)
    # Rows are merged by a number of their own; only those with matches are kept per block.
    numbered = cut(rows.withColumn("number", F.monotonically_increasing_id()))
    keyed = numbered.select(F.col("number").alias("row_id"), "text")
    found = None
    for block in _blocks(items, block_words):
        part = keyed.mapInArrow(_search(Benchmark(block, window)), HITS)
        if found is None:
            found = cut(part)
        else:
            found = found.unionByName(cut(part.filter("longest > 0")))
    merged = found.groupBy("row_id").agg(
        F.max("n_words").alias("n_words"),
        *[F.flatten(F.collect_list(c)).alias(c) for c in ("item_ids", "starts", "ends")],
        F.max("longest").alias("longest"),
    ).withColumnRenamed("row_id", "number")
    return numbered.select("number", "row_id").join(merged, "number").drop("number")


DIGEST = "row_id long, n_words long, n_hit long, n_items long, items_sha256 string, longest long, contaminated boolean"


def _digest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        n_words = batch.column("n_words").to_pylist()
        hit, count, sha = [], [], []
        for n, ids, starts, ends in zip(n_words, *(batch.column(c).to_pylist() for c in ("item_ids", "starts", "ends"))):
            steps = np.zeros(n + 1, np.int64)
            np.add.at(steps, np.array(starts, np.int64), 1)
            np.add.at(steps, np.array(ends, np.int64), -1)
            hit.append(int((np.cumsum(steps)[:n] > 0).sum()))
            ids = sorted(set(ids))
            count.append(len(ids))
            sha.append(hashlib.sha256(",".join(ids).encode()).hexdigest())
        yield pa.RecordBatch.from_pydict({
            "row_id": batch.column("row_id"), "n_words": batch.column("n_words"),
            "n_hit": pa.array(hit, pa.int64()), "n_items": pa.array(count, pa.int64()),
            "items_sha256": pa.array(sha, pa.string()), "longest": batch.column("longest"),
            "contaminated": pa.array([h > 0 and 20 * h >= n for h, n in zip(hit, n_words)], pa.bool_()),
        })


def judge(documents: DataFrame, items: DataFrame, window: int = WINDOW,
          block_words: int = BLOCK_WORDS) -> DataFrame:
    """A verdict per row: contaminated if matches cover a twentieth of its words or more."""
    return find(documents, items, window, block_words).mapInArrow(_digest, DIGEST)


def remove(documents: DataFrame, items: DataFrame, window: int = WINDOW,
           block_words: int = BLOCK_WORDS) -> DataFrame:
    """``documents`` without the contaminated ones; all columns stay. Texts without
    words stay; repeated rows are judged alike; an empty table stays empty.

    With a benchmark of one block the verdict is taken inside a filter pass, so
    no text is shuffled; a larger one is judged first and joined by row.
    """
    wd.small_batches(documents.sparkSession)
    if _block_count(items, block_words) == 1:
        (block,) = _blocks(items, block_words)
        return documents.mapInArrow(_keep(Benchmark(block, window)), documents.schema)
    rows = cut(documents.withColumn("__llm_row", F.monotonically_increasing_id()))
    verdict = judge(rows.select(F.col("__llm_row").alias("row_id"), "text"), items, window, block_words)
    bad = verdict.filter("contaminated").select(F.col("row_id").alias("__llm_row"))
    return rows.join(bad, "__llm_row", "left_anti").select([F.col(f"`{c}`") for c in documents.columns])


def _keep(bench: Benchmark):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in wd.slices(batches, limit=SHARD_BYTES):
            text = wd.Words(batch.column("text"), wd.LETTERS, lower=True)
            place, window = bench.matches(text.hashes(), text.first)
            marks = np.zeros(len(text) + 1, np.int64)
            np.add.at(marks, place, 1)
            np.add.at(marks, place + bench.window_size[window], -1)
            total = np.concatenate(([0], np.cumsum(np.cumsum(marks)[:len(text)] > 0)))
            hit = np.diff(total[text.first])
            yield batch.filter(pa.array(~((hit > 0) & (20 * hit >= text.counts))))
    return run
