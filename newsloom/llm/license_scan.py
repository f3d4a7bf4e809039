"""License notices found by diagonal voting.

All rolling word k-grams of the documents are hashed and joined by Spark with
the gram positions of the templates. A copy of a template lies on one diagonal
(place in the document minus place in the template), or on a few neighbouring
ones where words were put in or left out. Votes are counted per diagonal,
neighbouring diagonals merged, and the spans verified word by word on the text.

Two kinds of templates: fixed phrases, which must stand word for word, are
joined on pairs of words; whole notices, of which a part may differ, on runs of
``GRAM`` words. The templates are constants of this module (a few hundred
grams), so their side of the join is broadcast.
"""

from __future__ import annotations

from collections.abc import Iterator
from difflib import SequenceMatcher

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from newsloom.llm import words as wd

PAIR, GRAM = 2, 4
BAND = 5                 # diagonals this near belong together
MIN_VOTES = 0.3          # share of a notice's grams that must vote
MIN_SCORE = 0.6          # share of a notice's words that must be found in order

# Phrases and their labels.
PHRASES = {
    "gnu general public license": "gpl",
    "apache license": "apache",
    "cc by": "cc-by",
    "mit license": "mit",
}
# Opening sentences of public license notices.
NOTICES = {
    "mit": "permission is hereby granted free of charge to any person obtaining a copy of this software and "
           "associated documentation files the software to deal in the software without restriction including "
           "without limitation the rights to use copy modify merge publish distribute sublicense and or sell "
           "copies of the software",
    "apache": "licensed under the apache license version 2 0 the license you may not use this file except in "
              "compliance with the license you may obtain a copy of the license at",
    "gpl": "this program is free software you can redistribute it and or modify it under the terms of the gnu "
           "general public license as published by the free software foundation either version 3 of the license "
           "or at your option any later version",
    "bsd": "redistribution and use in source and binary forms with or without modification are permitted "
           "provided that the following conditions are met",
    "isc": "permission to use copy modify and or distribute this software for any purpose with or without fee is "
           "hereby granted provided that the above copyright notice and this permission notice appear in all copies",
    "mpl": "this source code form is subject to the terms of the mozilla public license v 2 0 if a copy of the mpl "
           "was not distributed with this file you can obtain one at",
    "unlicense": "this is free and unencumbered software released into the public domain anyone is free to copy "
                 "modify publish use compile sell or distribute this software",
    "cc-by": "this work is licensed under a creative commons attribution 4 0 international license",
    "cc-by-nc": "licensed under cc by nc 4 0",
}


class Templates:
    """Words of all templates, phrases first."""

    def __init__(self, phrases: dict[str, str] = PHRASES, notices: dict[str, str] = NOTICES):
        texts = [*phrases, *notices.values()]
        text = wd.Words(pa.array(texts, pa.string()), wd.LETTERS, lower=True)
        self.labels = [*phrases.values(), *notices]
        self.n_phrases = len(phrases)
        hashes = text.hashes()
        self.words = [hashes[a:b] for a, b in zip(text.first[:-1], text.first[1:])]
        if any(len(w) < PAIR for w in self.words[:self.n_phrases]):
            raise ValueError("a phrase needs two words")
        if any(len(w) < GRAM for w in self.words[self.n_phrases:]):
            raise ValueError(f"a notice needs {GRAM} words")

    def grams(self) -> list[tuple[int, int, int, int]]:
        """(hash, template, place in it, grams that must vote)."""
        rows = []
        for number, words in enumerate(self.words):
            k = PAIR if number < self.n_phrases else GRAM
            n = len(words) - k + 1
            need = n if number < self.n_phrases else max(1, int(n * MIN_VOTES))
            for place, h in enumerate(gram_hashes(words, k)[:n].view(np.int64)):
                rows.append((int(h), number, place, need))
        return rows


def gram_hashes(hashes: np.ndarray, k: int) -> np.ndarray:
    return wd.mix(wd.chain(hashes, k) + np.uint64(k))


GRAMS = "key long, pos int, gram long"


def _grams(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in wd.slices(batches, limit=wd.SLICE_BYTES // 4):
        text = wd.Words(batch.column("text"), wd.LETTERS, lower=True)
        hashes = text.hashes()
        keys = batch.column("key").to_numpy()
        for k in (PAIR, GRAM):
            at, per_text = text.windows(k)
            place = at - np.repeat(text.first[:-1], per_text)
            yield pa.RecordBatch.from_arrays(
                [pa.array(np.repeat(keys, per_text)), pa.array(place.astype(np.int32)),
                 pa.array(gram_hashes(hashes, k)[at].view(np.int64))], ["key", "pos", "gram"])


def spans(rows: DataFrame, templates: Templates) -> DataFrame:
    """Diagonals with enough votes: ``key, found`` with an array of (template, low, high)."""
    spark = rows.sparkSession
    table = F.broadcast(spark.createDataFrame(templates.grams(), "gram long, template int, place int, need int"))
    votes = (
        rows.mapInArrow(_grams, GRAMS).join(table, "gram")
        .groupBy("key", "template", (F.col("pos") - F.col("place")).alias("diagonal"))
        .agg(F.count("*").alias("votes"), F.max("need").alias("need"))
    )
    along = Window.partitionBy("key", "template").orderBy("diagonal")
    band = F.when(F.col("template") < templates.n_phrases, 0).otherwise(BAND)
    apart = F.coalesce(F.col("diagonal") - F.lag("diagonal").over(along) > band, F.lit(True))
    runs = votes.withColumn("apart", apart.cast("int")).withColumn("run", F.sum("apart").over(along))
    merged = runs.groupBy("key", "template", "run").agg(
        F.min("diagonal").alias("low"), F.max("diagonal").alias("high"),
        F.sum("votes").alias("votes"), F.max("need").alias("need")).filter("votes >= need")
    return merged.groupBy("key").agg(F.collect_list(F.struct("template", "low", "high")).alias("found"))


SPANS = ("doc_id long, n_words long, templates array<int>, starts array<long>, ends array<long>, "
         "scores array<double>")


def _verify(templates: Templates):
    def notice(words: list[int], low: int, high: int, want: np.ndarray):
        begin = max(low, 0)
        part = words[begin:high + len(want)]
        blocks = SequenceMatcher(None, part, want.tolist(), autojunk=False).get_matching_blocks()[:-1]
        if not blocks:
            return None
        share = sum(b.size for b in blocks) / len(want)
        return begin + blocks[0].a, begin + blocks[-1].a + blocks[-1].size, share

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in wd.slices(batches):
            text = wd.Words(batch.column("text"), wd.LETTERS, lower=True)
            hashes = text.hashes()
            out = {"templates": [], "starts": [], "ends": [], "scores": []}
            for i, found in enumerate(batch.column("found").to_pylist()):
                mine = hashes[text.first[i]:text.first[i + 1]]
                good = set()
                for f in found or ():
                    number, want = f["template"], templates.words[f["template"]]
                    if number < templates.n_phrases:
                        low = f["low"]
                        if low >= 0 and np.array_equal(mine[low:low + len(want)], want):
                            good.add((number, low, low + len(want), 1.0))
                    elif span := notice(mine[:f["high"] + len(want)].tolist(), f["low"], f["high"], want):
                        if span[2] >= MIN_SCORE:
                            good.add((number, *span))
                for name, values in zip(out, zip(*sorted(good)) if good else ((), (), (), ())):
                    out[name].append(list(values))
            yield pa.RecordBatch.from_pydict({
                "doc_id": batch.column("doc_id"), "n_words": pa.array(text.counts.astype(np.int64)),
                "templates": pa.array(out["templates"], pa.list_(pa.int32())),
                "starts": pa.array(out["starts"], pa.list_(pa.int64())),
                "ends": pa.array(out["ends"], pa.list_(pa.int64())),
                "scores": pa.array(out["scores"], pa.list_(pa.float64())),
            })
    return run


def scan(documents: DataFrame, templates: Templates | None = None, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Verified spans of each row: columns of ``SPANS``; ``ends`` are exclusive, in words.

    Null and empty texts have no words and no spans. Repeated rows each get
    their spans; null keys are allowed; an empty table gives no rows; columns
    not named are ignored.
    """
    templates = templates or Templates()
    wd.small_batches(documents.sparkSession)
    body = F.coalesce(F.col(f"`{text}`"), F.lit(""))
    # The key may be shared by different rows without harm: spans are verified on the text.
    rows = documents.select(F.col(f"`{key}`").cast("long").alias("doc_id"), body.alias("text"),
                            F.xxhash64(F.col(f"`{key}`"), body).alias("key"))
    found = spans(rows.select("key", "text"), templates)
    return rows.join(found, "key", "left").select("doc_id", "text", "found").mapInArrow(_verify(templates), SPANS)


def summary(found: DataFrame, templates: Templates | None = None) -> DataFrame:
    """Counts and labels of each row's spans."""
    templates = templates or Templates()
    label = F.array(*[F.lit(x) for x in templates.labels])
    each = F.arrays_zip("templates", "starts", "scores")
    base = F.filter(each, lambda x: x["templates"] < templates.n_phrases)
    names = lambda spans: F.array_join(F.array_sort(F.array_distinct(
        F.transform(spans, lambda x: F.get(label, x["templates"])))), ",")
    starts = F.transform(base, lambda x: x["starts"])
    return found.select(
        "doc_id", "n_words", F.size(base).cast("long").alias("n_base"),
        F.array_min(starts).alias("first_word"), F.array_max(starts).alias("last_word"),
        names(base).alias("base_labels"), names(each).alias("labels"),
        F.round(F.coalesce(F.array_max("scores"), F.lit(0.0)), 6).alias("score"))
