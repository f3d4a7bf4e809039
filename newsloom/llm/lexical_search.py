"""Ranked lexical search of all documents for a set of items, without a stored index.

Two passes over the texts. The first counts documents, terms and how many
documents hold each term of the items. The second ranks: of each slice of
documents, every item gets its terms' postings as bits, one mask per document.
Documents are grouped by mask; a mask's highest possible score is the sum of its
terms' best values in the slice. Masks are worked off from the highest on, and
the search of a slice ends safely at the first mask that cannot reach the
item's last place so far. Each task returns at most ``top`` documents an item,
so the shuffle does not grow with the texts.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from newsloom.llm import words as wd
from newsloom.session import cut

TOP = 10
BLOCK_TERMS = 200_000        # terms of the items that are searched in one go (expected; an item is never split)
FIRST_DOCUMENTS = 64         # evaluated before the first look at the bounds
LOWEST = -(1 << 63)

#: Terms are `[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+` with A-Z in lower case; all else becomes a blank.
_TERMS = bytes(b + 32 if 65 <= b <= 90 else b if 48 <= b <= 57 or 97 <= b <= 122 or b >= 128 else 32 for b in range(256))


def terms(text: str | None) -> list[bytes]:
    return (text or "").encode().translate(_TERMS).split()


def _item_terms(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        found = [sorted(set(terms(t))) for t in batch.column("text").to_pylist()]
        yield pa.RecordBatch.from_arrays([batch.column("item"), pa.array(found, pa.list_(pa.binary()))], ["item", "terms"])


COUNTS = "term int, docs long, terms long"


def _count(vocabulary: dict[bytes, int]):
    """Documents with each term; at -1, documents with any term and all their terms."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        docs, n_docs, n_terms = Counter(), 0, 0
        for batch in wd.slices(batches):
            for text in batch.column("text").to_pylist():
                found = terms(text)
                n_docs += bool(found)
                n_terms += len(found)
                docs.update(vocabulary.keys() & set(found))
        numbers = [-1, *[vocabulary[t] for t in docs]]
        yield pa.RecordBatch.from_arrays(
            [pa.array(numbers, pa.int32()), pa.array([n_docs, *docs.values()], pa.int64()),
             pa.array([n_terms] + [0] * len(docs), pa.int64())], ["term", "docs", "terms"])
    return run


class Slice:
    """Postings of a slice of documents: for each term its documents and the terms' values there."""

    def __init__(self, batch: pa.RecordBatch, vocabulary: dict[bytes, int], n_docs: int, n_terms: int):
        term, doc, tf, norm = [], [], [], []
        for i, text in enumerate(batch.column("text").to_pylist()):
            found = terms(text)
            hits = Counter(w for w in found if w in vocabulary)
            m = 10 + 90 * len(found) * n_docs // max(n_terms, 1)
            term.extend([vocabulary[w] for w in hits])
            tf.extend(hits.values())
            doc.extend([i] * len(hits))
            norm.extend([8 * m] * len(hits))
        order = np.argsort(np.array(term, np.int32), kind="stable")
        self.doc = np.array(doc, np.int32)[order]
        tf = np.array(tf, np.int64)[order]
        self.value = 1_000_000_000 * tf // (1000 * tf + np.array(norm, np.int64)[order])
        self.first = np.searchsorted(np.array(term, np.int32)[order], np.arange(len(vocabulary) + 1))
        self.n = batch.num_rows
        self.keys = batch.column("doc").to_numpy()

    def postings(self, term: int) -> tuple[np.ndarray, np.ndarray]:
        own = slice(self.first[term], self.first[term + 1])
        return self.doc[own], self.value[own]


def rank_slice(part: Slice, query: list[tuple[int, int]], best: tuple[np.ndarray, np.ndarray], top: int) -> tuple[np.ndarray, np.ndarray]:
    """The ``top`` (score, key) of ``best`` and the slice's documents, for (term, weight) pairs."""
    lists = [(w, *part.postings(t)) for t, w in query]
    lists = [(w, d, v) for w, d, v in lists if len(d)]
    if not lists:
        return best
    mask = np.zeros((part.n, (len(lists) + 63) // 64), np.uint64)
    for j, (_, docs, _) in enumerate(lists):
        mask[docs, j // 64] |= np.uint64(1 << (j % 64))
    held = np.flatnonzero(mask.any(axis=1))
    if mask.shape[1] == 1:
        kinds, group = np.unique(mask[held, 0], return_inverse=True)
        kinds = kinds[:, None]
    else:
        kinds, group = np.unique(mask[held], axis=0, return_inverse=True)
        group = group.ravel()
    most = np.zeros(len(kinds), np.int64)
    for j, (w, _, values) in enumerate(lists):
        bit = (kinds[:, j // 64] >> np.uint64(j % 64)) & np.uint64(1)
        most += bit.astype(np.int64) * (w * int(values.max()))
    by_mask = np.argsort(-most, kind="stable")
    place = np.empty(len(by_mask), np.int64)
    place[by_mask] = np.arange(len(by_mask))
    order = np.argsort(place[group], kind="stable")
    held, at = held[order], place[group][order]                 # documents by descending bound of their mask
    most = most[by_mask]
    done, step = 0, FIRST_DOCUMENTS
    slot = np.full(part.n, -1, np.int64)
    while done < len(held):
        last = best[0][-1] if len(best[0]) == top else 1         # a score of 0 never counts
        reach = np.searchsorted(-most, -last, side="right")      # masks that may still get a place
        end = min(int(np.searchsorted(at, reach)), done + step)
        if end <= done:
            break
        chosen = held[done:end]
        slot[chosen] = np.arange(len(chosen))
        score = np.zeros(len(chosen), np.int64)
        for w, docs, values in lists:
            own = slot[docs]
            hit = own >= 0
            score[own[hit]] += w * values[hit]
        slot[chosen] = -1
        good = score >= max(last, 1)
        scores, keys = np.concatenate((best[0], score[good])), np.concatenate((best[1], part.keys[chosen[good]]))
        first = np.lexsort((keys, -scores))[:top]
        best = scores[first], keys[first]
        done, step = end, step * 2
    return best


RANKED = "item long, score long, doc long"


def _rank(vocabulary: dict[bytes, int], queries: dict[int, list[tuple[int, int]]], n_docs: int, n_terms: int, top: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        none = np.zeros(0, np.int64)
        best = {item: (none, none) for item in queries}
        for batch in wd.slices(batches):
            part = Slice(batch, vocabulary, n_docs, n_terms)
            for item, query in queries.items():
                best[item] = rank_slice(part, query, best[item], top)
        for item, (scores, keys) in best.items():
            yield pa.RecordBatch.from_arrays(
                [pa.array(np.full(len(scores), item, np.int64)), pa.array(scores), pa.array(keys)], ["item", "score", "doc"])
    return run


def weight(n_docs: int, docs: int) -> int:
    return math.floor(1000 * math.log((2 * n_docs + 2) / (2 * docs + 1)))


def _search_block(rows: DataFrame, items: dict[int, list[bytes]], top: int) -> DataFrame:
    vocabulary = {t: i for i, t in enumerate(sorted({t for ts in items.values() for t in ts}))}
    counted = rows.select("text").mapInArrow(_count(vocabulary), COUNTS).groupBy("term").agg(
        F.sum("docs").alias("docs"), F.sum("terms").alias("terms")).collect()     # one row a term of the block
    found = {r["term"]: (r["docs"], r["terms"]) for r in counted}
    n_docs, n_terms = found.get(-1, (0, 0))
    weights = {t: weight(n_docs, found[t][0]) for t in found if t >= 0}
    queries = {item: [(vocabulary[t], weights[vocabulary[t]]) for t in ts if weights.get(vocabulary[t], 0) > 0]
               for item, ts in items.items()}
    return rows.mapInArrow(_rank(vocabulary, queries, n_docs, n_terms, top), RANKED)


def _doc(key: str) -> Column:
    return F.coalesce(F.col(f"`{key}`").cast("long"), F.lit(LOWEST))


def search(documents: DataFrame, items: DataFrame, key: str = "doc_id", text: str = "text",
           item_key: str = "item_id", item_text: str = "text", top: int = TOP, block_terms: int = BLOCK_TERMS) -> DataFrame:
    """``item_id, rank, doc_id, score``: the ``top`` documents with a score above 0 of each item.

    A term counts once an item, however often it stands there. Equal scores go
    by ascending key. Null texts have no terms; every row of ``documents`` is a
    document and every row of ``items`` an item of its own, also with equal or
    null keys. A null document key comes before all others (the smallest long
    stands for it inside). No documents or no terms give no rows. Other columns
    are ignored. Items are searched in blocks of about ``block_terms`` terms;
    a block's terms are the only thing that goes through the driver.
    """
    spark = wd.small_batches(documents.sparkSession)
    rows = documents.select(_doc(key).alias("doc"), F.col(f"`{text}`").alias("text"))
    named = cut(items.select(F.col(f"`{item_key}`").alias("item_id"), F.col(f"`{item_text}`").alias("text"),
                             F.monotonically_increasing_id().alias("item")))
    wanted = cut(named.select("item", "text").mapInArrow(_item_terms, "item long, terms array<binary>"))
    blocks = int((wanted.agg(F.sum(F.size("terms"))).first()[0] or 0) // block_terms) + 1
    ranked = []
    for b in range(blocks):
        block = wanted.filter(F.pmod(F.xxhash64("item"), F.lit(blocks)) == b).collect()
        ranked.append(_search_block(rows, {r["item"]: [bytes(t) for t in r["terms"]] for r in block}, top))
    ranked = reduce(DataFrame.unionAll, ranked) if ranked else spark.createDataFrame([], RANKED)
    order = Window.partitionBy("item").orderBy(F.desc("score"), "doc")
    best = ranked.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= top)
    return best.join(named.select("item", "item_id"), "item").select(
        "item_id", "rank", F.nullif(F.col("doc"), F.lit(LOWEST)).alias("doc_id"), "score")
