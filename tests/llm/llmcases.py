"""Small tables with awkward rows, and plain versions of the operators' rules."""

from __future__ import annotations

import random

import pyarrow as pa

SMALL = "/root/testdata/sf0.001"
#: Names that operators use inside; tables may have them for other things.
CLASHING = ["rid", "k", "size", "kept", "gone", "lines", "fixes", "n_lines", "n_removed", "score"]


def prose(n: int, seed: int) -> str:
    rng = random.Random(seed)
    return " ".join("".join(rng.choices("aeioustrnl", k=rng.randint(2, 7))) for _ in range(n))


def awkward() -> list[tuple[int | None, str | None]]:
    """Nulls, empty, blank and one-word texts, exact and near copies, repeats, a long text."""
    base, other = prose(120, 1), prose(90, 2)
    words = base.split()
    near = " ".join([*words[:60], "changed", *words[61:]])
    lines = "\n".join([prose(20, 3), other, prose(20, 4)])
    return [
        (1, base),
        (2, base),
        (3, near),
        (4, near.upper()),
        (5, None),
        (6, ""),
        (7, " \n\t "),
        (8, "word"),
        (9, "word"),
        (10, "two words"),
        (11, other),
        (12, lines),
        (12, lines),
        (None, base),
        (None, None),
        (13, "ab" * 400),
        (14, prose(30_000, 5)),
        (15, "Ünïcödé 文字 " * 40),
        (16, "1234 5678 !!"),
    ]


def frame(spark, rows, clashing: bool = True):
    """Documents from (doc_id, text), with further columns that clash with inner names."""
    extra = ", ".join(f"{c} string" for c in CLASHING) if clashing else "lang string"
    schema = f"doc_id long, text string, n_chars long, source string, {extra}"
    if not clashing:
        extra_values = lambda i: ("en",)
    else:
        extra_values = lambda i: tuple(None if i % 3 else c for c in CLASHING)
    full = [
        (d, t, None if t is None else len(t), None if i % 4 == 0 else f"s{i % 3}", *extra_values(i))
        for i, (d, t) in enumerate(rows)
    ]
    return spark.createDataFrame(full, schema)


def documents(spark):
    return spark.read.parquet(f"{SMALL}/documents.parquet")


def texts(spark) -> list[tuple[int, str]]:
    return [(r.doc_id, r.text) for r in documents(spark).select("doc_id", "text").collect()]


def batch(**columns) -> pa.RecordBatch:
    return pa.record_batch(columns)
