import re
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from llmcases import awkward, documents, frame, texts

from dealflow.llm import spelling
from dealflow.llm.spelling import Settings, near_pairs, variants

RUNS = re.compile("[A-Za-zÀ-ÿ]+")


def words_of(rows, settings):
    counts = Counter()
    for d, t in rows:
        for run in RUNS.findall(t or ""):
            low = "".join(c.lower() if "A" <= c <= "Z" else c for c in run)
            h = zlib.crc32(f"{'' if d is None else d}:{low}".encode())
            if settings.drop and h % settings.drop == 0:
                at = h % len(low)
                low = low[:at] + low[at + 1 :]
            counts[low] += 1
    return {w: n for w, n in counts.items() if len(w) >= settings.length and n >= settings.count}


def edits(word, alphabet):
    """Every text that one edit makes of ``word``."""
    cuts = [(word[:i], word[i:]) for i in range(len(word) + 1)]
    out = {a + b[1:] for a, b in cuts if b}
    out |= {a + c + b[1:] for a, b in cuts if b for c in alphabet}
    out |= {a + c + b for a, b in cuts for c in alphabet}
    return out - {word}


def one_edit(a, b):
    """The same for long texts, from the first difference."""
    a, b = sorted((a, b), key=len)
    at = next((i for i, (x, y) in enumerate(zip(a, b, strict=False)) if x != y), len(a))
    return a != b and (a[at + 1 :] == b[at + 1 :] if len(a) == len(b) else a[at:] == b[at + 1 :])


def expected(words, ratio=2):
    alphabet = sorted(set("".join(words)))
    near = {w: sorted(edits(w, alphabet) & words.keys()) for w in words if len(w) <= 40}
    for w in words.keys() - near:
        near[w] = sorted(o for o in words if one_edit(w, o))
    form = {}
    for w, others in near.items():
        best = min(others, key=lambda o: (-words[o], o), default=None)
        if best is not None and words[best] >= ratio * words[w]:
            form[w] = best
    out = []
    for w, n in words.items():
        root = w
        while root in form:
            root = form[root]
        f = form.get(w)
        out.append((w, n, len(near[w]), f, words.get(f), root))
    return sorted(map(str, out))


def found(df):
    assert df.columns == ["word", "n", "n_near", "form", "form_n", "root"]
    return sorted(map(str, map(tuple, df.collect())))


@pytest.mark.parametrize(
    "settings", [Settings(drop=97), Settings(drop=7, tile_rows=8), Settings(length=3, count=2, ratio=3)]
)
def test_like_brute_force(spark, settings):
    words = words_of(texts(spark), settings)
    want = expected(words, settings.ratio)
    assert sum("None" not in w for w in want) > 3
    assert found(variants(documents(spark), settings=settings)) == want


def test_chains_ties_and_letters(spark):
    """Chains of forms over several words, equal counts, letters beyond ASCII, lengths 1 to 30."""
    rng = np.random.default_rng(4)
    counted = {"aaaaa": 40, "aaaab": 20, "aaabb": 10, "aabbb": 5, "abbbb": 5, "élève": 9, "éleve": 4,
               "ÉLÈVE": 3, "x÷y×z": 8, "x÷y×zz": 4, "tiger": 4, "tigers": 8, "tigres": 8, "tigar": 8}
    for n in range(5, 31):
        base = "".join(rng.choice(list("abcé"), n))
        counted[base] = counted.get(base, 0) + 60
        counted[base[:2] + base[3:] + "q"] = 3
        counted[base[:2] + "z" + base[2:]] = 4
        counted[base[: n // 2] + "z" + base[n // 2 + 1 :]] = 7
    rows = [(i, f" {w}, {w.title()}" * (c // 2) + f" {w}" * (c % 2)) for i, (w, c) in enumerate(counted.items())]
    want = expected(words_of(rows, Settings()))
    assert found(variants(frame(spark, rows))) == want
    roots = {w: r for w, _, _, _, _, r in map(tuple, variants(frame(spark, rows)).collect())}
    assert roots["aabbb"] == "aaaaa" and roots["tiger"] == "tigar"


def test_hot_group_is_compared_in_tiles(spark):
    """All words begin alike: one group for each length, cut into many tiles."""
    rng = np.random.default_rng(6)
    made = {"prefix" + "".join(rng.choice(list("abc"), 5)) + "end" * int(rng.integers(2)) for _ in range(400)}
    rows = [(1, " ".join(w for w in sorted(made) for _ in range(int(rng.integers(3, 30)))))]
    words = words_of(rows, Settings())
    for tile_rows in (7, 50, 5000):
        assert found(variants(frame(spark, rows), settings=Settings(tile_rows=tile_rows))) == expected(words)


def test_awkward_rows(spark):
    rows = [*awkward(), (30, "Word" * 9000 + " " + "ab" * 3), (31, "Ünïcödé") , (32, "İstanbul ſtrasse " * 4)]
    settings = Settings(count=1, drop=5)
    assert found(variants(frame(spark, rows), settings=settings)) == expected(words_of(rows, settings))


def test_long_words_are_compared_whole(spark):
    word = "ab" * 12_000
    rows = [(1, f"{word} {word} {word}c " * 3), (2, f"x{word} " * 3)]
    by_word = {r.word: r for r in variants(frame(spark, rows)).collect()}
    assert by_word[word].n_near == 2 and by_word[f"x{word}"].form == word == by_word[f"{word}c"].root


def test_texts_are_cut_between_runs(monkeypatch):
    monkeypatch.setattr(spelling, "PIECE", 16)
    text = ("abcdefghij " * 30 + "klmnopqrs\xc3\xa9" * 9).encode("latin-1")
    pattern = re.compile(rb"(?:[a-z]|\xc3[\x80-\xbf]){5,}")
    pieces = list(spelling.runs_of(text, pattern))
    assert len(pieces) > 9 and [r for p in pieces for r in p] == pattern.findall(text)


def test_no_words(spark):
    for rows in ([], [(1, None), (2, ""), (None, "12 34 !!"), (3, "文字")]):
        assert variants(frame(spark, rows)).count() == 0


def test_pairs_of_any_block(monkeypatch):
    """Blocks of few rows find the same pairs as one block."""
    rng = np.random.default_rng(8)
    words = sorted({"".join(rng.choice(list("ab"), int(rng.integers(5, 8)))) for _ in range(90)})
    words.sort(key=len)
    m = [7] * len(words)
    table = pa.table({"word": words, "m": m, "last": [False] * len(words), "group": [0] * len(words),
                      "tile_i": [0] * len(words), "tile_j": [0] * len(words), "part": [0] * len(words)})
    monkeypatch.setattr(spelling, "BLOCK", 7)
    small = set(zip(*map(list, near_pairs(table)), strict=True))
    monkeypatch.setattr(spelling, "BLOCK", 256)
    assert small == set(zip(*map(list, near_pairs(table)), strict=True)) and small
