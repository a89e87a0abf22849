"""Small tables with the awkward rows that every operator must take."""

from __future__ import annotations

import random

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, score double, fp long, digest string, spans string"


def documents(seed: int = 1, n: int = 60) -> list[tuple]:
    """Nonsense documents with copies, shared passages, nulls, empty, repeated and long rows."""
    rng = random.Random(seed)
    words = [a + b for a in ("ka", "lo", "mi", "tu", "é") for b in ("ra", "ne", "so", "vi")]
    passage = " ".join(rng.choice(words) for _ in range(30))
    texts: list[str | None] = []
    for i in range(n):
        kind = rng.random()
        text = " ".join(rng.choice(words) for _ in range(rng.choice((1, 3, 12, 13, 40, 120))))
        if kind < 0.2 and texts:
            text = rng.choice([t for t in texts if t] or [text])
        elif kind < 0.3 and texts:
            text = (rng.choice([t for t in texts if t] or [text])).upper()
        elif kind < 0.5:
            text = f"{text}\n\t{passage}  {text[:20]}"
        texts.append(text)
    texts[3], texts[7], texts[8], texts[9] = None, "", " \n\t", " ".join(rng.choice(words) for _ in range(6000))
    texts[11] = "one " * 500
    sources = ["b", "a", None, "", "é", "b", "b"]
    rows = [(i * 3 % 101, t, "xx", sources[i % 7], None, 0.5, 1, "d", None) for i, t in enumerate(texts)]
    return [*rows, rows[5], rows[5], (None, "no id here at all", None, "a", 1, None, None, None, None)]


def frame(spark, rows: list[tuple] | None = None):
    return spark.createDataFrame(documents() if rows is None else rows, SCHEMA)


def words(text: str | None) -> list[bytes]:
    return (text or "").encode().split()
