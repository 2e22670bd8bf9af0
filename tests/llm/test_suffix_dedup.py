from collections import Counter

import numpy as np
import pytest
from hypothesis import given, settings as limits, strategies as st
from llmcases import awkward, documents, frame, prose, texts

from dealflow.llm import suffix_dedup as sd


def expected(rows, length=200):
    """(bytes, removed, spans, kept) per row, from a count of every string."""
    data = [(t or "").encode() for _, t in rows]
    seen = Counter(t[i : i + length] for t in data for i in range(len(t) - length + 1))
    out = []
    for t in data:
        gone = np.zeros(len(t) + 1, int)
        for i in range(len(t) - length + 1):
            if seen[t[i : i + length]] > 1:
                gone[i] += 1
                gone[i + length] -= 1
        gone = np.cumsum(gone)[:-1] > 0
        kept = np.frombuffer(t, np.uint8)[~gone].tobytes()
        out.append((len(t), int(gone.sum()), int((np.diff(np.r_[0, gone * 1]) == 1).sum()), kept))
    return out


def rows_of(df):
    return sorted(str((r.doc_id, r.n_bytes, r.n_removed, r.n_spans, bytes(r.kept))) for r in df.collect())


def test_like_brute_force(spark):
    docs = texts(spark)
    want = sorted(str((d, *x)) for (d, _), x in zip(docs, expected(docs), strict=True))
    assert rows_of(sd.without_repeats(documents(spark))) == want


def test_edges_of_repeats(spark):
    """Passages in different surroundings, of lengths around the limit, overlapping, periodic."""
    rows, n = awkward(), 100
    for size in (150, 199, 200, 201, 230, 400):
        passage = prose(200, size)[:size]
        for i in range(3):
            rows.append((n, prose(30, n) + passage + prose(30, n + 500)))
            n += 1
    rows += [(n, "z" * 450), (n + 1, prose(40, 9) + "z" * 199), (n + 2, "abcd" * 30), (n + 3, "é" * 150)]
    want = sorted(str((d, *x)) for (d, _), x in zip(rows, expected(rows), strict=True))
    assert rows_of(sd.without_repeats(frame(spark, rows))) == want


def test_empty(spark):
    assert sd.without_repeats(documents(spark).limit(0)).count() == 0


@limits(max_examples=40, deadline=None)
@given(st.binary(min_size=200, max_size=900), st.integers(0, 400))
def test_equal_strings_have_equal_triggers(data, at):
    """A string's trigger stands at the same place wherever the string is."""
    settings = sd.Settings()
    passage = data[at : at + 300]
    if len(passage) < 200:
        passage = data[:200]

    def placed(text, start):
        found = sd.triggers([(0, 0, text)], settings)
        of = {}
        for s, more, core in zip(found.start, found.more, found.core, strict=True):
            of.update({int(x): int(core) for x in range(s, s + more + 1)})
        return [of[start + i] for i in range(len(passage) - 199)]

    assert placed(passage, 0) == placed(b"before " * 40 + passage + b" after" * 40, 280)


@pytest.mark.parametrize("size", [0, 199, 200, 1000])
def test_pieces_cover_long_texts(monkeypatch, size):
    monkeypatch.setattr(sd, "CHUNK", 300)
    text = prose(400, 1).encode()[:size]
    starts = [
        o + i for group in sd.pieces([text], 200) for _, o, p in group for i in range(len(p) - 199)
    ]
    assert starts == list(range(max(0, size - 199)))
