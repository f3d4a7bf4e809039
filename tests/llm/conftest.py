"""Small document tables with the cases that every operator must bear."""

from __future__ import annotations

import random

import pytest
from newsloom.llm import queries  # noqa: F401

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def prose(seed: int, n: int, kinds: int = 4000) -> str:
    rng = random.Random(seed)
    return " ".join(f"w{rng.randrange(kinds)}" for _ in range(n))


def corpus(seed: int = 1) -> list[tuple]:
    """Prose, exact and near copies, shared lines and passages, odd spaces, nulls, empty and long texts."""
    rng = random.Random(seed)
    texts = [prose(i, rng.choice([1, 3, 4, 5, 6, 30, 80, 200])) for i in range(60)]
    passage, line = prose(900, 70), "A line that a good many documents share, word for word."
    for i in range(12):
        texts.append(f"{prose(100 + i, 40)}\n{passage}\n{prose(200 + i, 30)}")
        texts.append(f"{prose(300 + i, 20)}\n \t{line.upper() if i % 3 else line}  \n{prose(400 + i, 60)}\n\n{line}")
    base = prose(777, 150).split()
    for i in range(8):
        words = list(base)
        words[i * 15] = f"changed{i}"
        texts.append(" ".join(words))
    texts += [texts[5]] * 4 + [base_copy for base_copy in [" ".join(base)] * 3]
    texts += [None, "", "   ", "\n\n", "　 \x0b\x0c wörter ünd ß x", "one", "a" * 3000,
              prose(5, 9000), "x y " * 400]
    rows = [(i * 3 + 1, t, ("en", "de", None)[i % 3], (f"s{i % 4}" if i % 3 else "hot"), len(t or ""))
            for i, t in enumerate(texts)]
    rng.shuffle(rows)
    return rows + [(None, prose(31, 60), "en", None, 1), (None, None, None, None, None)]


@pytest.fixture
def docs(rows):
    return rows(SCHEMA, corpus()).repartition(3, "doc_id")


@pytest.fixture
def none(rows):
    return rows(SCHEMA, [])


@pytest.fixture
def crowded(docs):
    """The same table with columns named like those the operators use inside or return."""
    from pyspark.sql import functions as F
    names = ("doc", "row", "key", "row_id", "n", "size", "kept", "root", "hits", "label", "rank", "pos", "bucket", "link", "word")
    return docs.withColumns({c: F.lit(c) for c in names})
