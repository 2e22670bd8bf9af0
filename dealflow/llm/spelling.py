"""Spelling variants: words one edit apart, each led to its most frequent neighbour.

Two words are one edit apart if their common prefix and suffix together reach the length of the
longer one less one. One of the two then covers half of that, so words meet in groups of an equal
first or last half. In a group, words are rows of padded matrices of code points, aligned at
their start and at their end, and blocks of rows are compared position by position.
"""

from __future__ import annotations

import re
import zlib
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from dealflow.llm.common import columns, stored
from dealflow.llm.tiles import TILE, tiled, whole_groups

#: Bytes of a text searched at a time, and different words held before they are passed on.
PIECE, HELD = 4 << 20, 200_000
#: Rows of a block, cells of its matrix at most, rows read before blocks are cut.
BLOCK, CELLS, READ = 256, 16 << 20, 8192


@dataclass(frozen=True)
class Settings:
    """Words have ``length`` code points and ``count`` occurrences at least; a form has at least
    ``ratio`` times the occurrences of its word.

    With ``drop``, a run whose crc32 (of doc_id, a colon and the run) it divides loses a code
    point: misspellings, planted to measure what is found.
    """

    length: int = 5
    count: int = 3
    ratio: int = 2
    drop: int | None = None
    tile_rows: int = 2048


def runs_of(text: bytes, pattern: re.Pattern) -> Iterator[list[bytes]]:
    """Runs of letters in lower-cased UTF-8, by pieces that end outside of runs."""
    start = 0
    while len(text) - start > PIECE:
        end = BREAK.search(text, start + PIECE)
        if not end:
            break
        yield pattern.findall(text, start, end.start())
        start = end.start()
    yield pattern.findall(text, start)


#: A byte that is in no run.
BREAK = re.compile(rb"[\x00-`{-\x7f]")


def without(run: bytes, crc: int) -> bytes:
    """``run`` less its code point at ``crc`` modulo its length."""
    word = run.decode()
    at = crc % len(word)
    return (word[:at] + word[at + 1 :]).encode()


def counted(
    docs: DataFrame, doc_id: str = "doc_id", text: str = "text", settings: Settings = Settings()
) -> DataFrame:
    """word, n: maximal runs of ``[A-Za-z\\u00C0-\\u00FF]`` in all texts, A-Z lower-cased.

    Null and empty texts have none; a null doc_id counts as an empty one.
    """
    pattern = re.compile(rb"(?:[a-z]|\xc3[\x80-\xbf]){%d,}" % max(settings.length, 1))

    def flushed(counts: Counter) -> pa.RecordBatch:
        out = pa.record_batch(
            {
                "word": pa.array([w.decode() for w in counts], pa.string()),
                "n": pa.array(list(counts.values()), pa.int64()),
            }
        )
        counts.clear()
        return out

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts: Counter = Counter()
        drop, crc32 = settings.drop, zlib.crc32
        for batch in batches:
            ids = batch.column("doc_id").cast(pa.binary()).to_pylist()
            for one, value in zip(ids, batch.column("text").cast(pa.binary()), strict=True):
                body = value.as_py()
                if not body:
                    continue
                start = crc32((one or b"") + b":")
                for runs in runs_of(body.lower(), pattern):
                    found = Counter(runs)
                    if drop:
                        hits = [w for w in found if not crc32(w, start) % drop]
                        for w in hits:
                            # A run with another's shortened form as its own text stays apart.
                            counts[without(w, crc32(w, start))] += found.pop(w)
                    counts.update(found)
                    if len(counts) > HELD:
                        yield flushed(counts)
        yield flushed(counts)

    rows = columns(docs, doc_id=doc_id, text=text)
    rows = rows.withColumn("doc_id", F.col("doc_id").cast("string"))
    found = rows.mapInArrow(run, "word string, n long").groupBy("word").agg(F.sum("n").alias("n"))
    return found.filter((F.length("word") >= settings.length) & (F.col("n") >= settings.count))


def in_groups(words: DataFrame) -> DataFrame:
    """Each word among those that may be one edit away: by length, side and half of the text.

    ``m`` is the length of the longer word of a pair. Words of length m - 1 and m meet if their
    first, or last, m // 2 code points are equal.
    """
    length = F.length("word")
    keyed = []
    for more in (0, 1):
        m = length + more
        half = (m / 2).cast("int")
        for last, piece in (
            (False, F.substring("word", F.lit(1), half)),
            (True, F.substring("word", length - half + 1, half)),
        ):
            key = F.md5(F.concat_ws(":", F.lit(last), m, piece).cast("binary"))
            keyed.append(F.struct(m.alias("m"), F.lit(last).alias("last"), key.alias("key")))
    return words.select("word", "n", F.explode(F.array(*keyed)).alias("g")).select(
        "word", "n", "g.*"
    )


def padded(words: list[bytes], width: int, right: bool) -> np.ndarray:
    """Code points of Latin-1 words as rows, filled up with 0 on the right or left."""
    texts = [w.rjust(width, b"\0") for w in words] if right else [w.ljust(width, b"\0") for w in words]
    return np.frombuffer(b"".join(texts), np.uint8).reshape(len(words), width)


def common(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Equal leading columns of every row of ``a`` and every row of ``b``."""
    out = np.zeros((len(a), len(b)), np.int32)
    alive = np.ones(out.shape, bool)
    for k in range(a.shape[1]):
        alive &= a[:, k, None] == b[:, k]
        if not alive.any():
            break
        out += alive
    return out


def near_pairs(table: pa.Table) -> tuple[np.ndarray, np.ndarray]:
    """Rows of a sorted table of whole groups that are one edit apart, each pair once."""
    words = [w.encode("latin-1") for w in table.column("word").to_pylist()]
    group, m, i, j, part = (table.column(c).to_numpy() for c in ("group", "m", *TILE))
    last = table.column("last").to_numpy(zero_copy_only=False)
    length = np.array([len(w) for w in words], np.int32)
    cuts = [0]
    while cuts[-1] < len(words):
        rows = min(BLOCK, len(words) - cuts[-1])
        # Rows come by length, so the last one of a block is about the longest.
        while rows > 1 and rows * int(m[cuts[-1] + rows - 1]) > CELLS:
            rows //= 2
        cuts.append(cuts[-1] + rows)
    spans = list(zip(cuts, cuts[1:], strict=False))
    out = []
    for x, (start, end) in enumerate(spans):
        for later, stop in spans[x:]:
            if group[later] > group[end - 1]:
                break
            a, b = slice(start, end), slice(later, stop)
            la, lb = length[a, None], length[b]
            longer, shorter = np.maximum(la, lb), np.minimum(la, lb)
            ok = (group[a, None] == group[b]) & (longer == m[a, None]) & (longer - shorter <= 1)
            ok &= (i[a, None] == j[a, None]) | (part[a, None] != part[b])
            ok &= np.arange(start, end)[:, None] < np.arange(later, stop)
            if not ok.any():
                continue
            width = int(max(length[a].max(), length[b].max()))
            sides = [[padded(words[s], width, right) for s in (a, b)] for right in (False, True)]
            prefix = np.minimum(common(*sides[0]), shorter)
            suffix = np.minimum(common(*(s[:, ::-1] for s in sides[1])), shorter)
            ok &= prefix + suffix >= longer - 1
            # A pair in groups of both ends counts in that of the first half only.
            ok &= ~last[a, None] | (prefix < m[a, None] // 2)
            left, right = np.nonzero(ok)
            out.append((left + start, right + later))
    if not out:
        return np.zeros(0, int), np.zeros(0, int)
    return np.concatenate([p[0] for p in out]), np.concatenate([p[1] for p in out])


def neighbours(words: DataFrame, settings: Settings) -> DataFrame:
    """word, n_near, top (struct of minus n and word, the least one): words with neighbours."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in whole_groups(batches, ["key", "tile_i", "tile_j"], READ):
            a, b = near_pairs(table)
            a, b = np.r_[a, b], np.r_[b, a]
            texts = table.column("word").to_pylist()
            rank = np.empty(len(texts), int)
            rank[sorted(range(len(texts)), key=texts.__getitem__)] = np.arange(len(texts))
            n = table.column("n").to_numpy()
            order = np.lexsort((rank[b], -n[b], a))
            owner, at, near = np.unique(a[order], return_index=True, return_counts=True)
            best = b[order][at]
            yield pa.record_batch(
                {
                    "word": pa.array([texts[o] for o in owner], pa.string()),
                    "n_near": pa.array(near, pa.int64()),
                    "minus": pa.array(-n[best], pa.int64()),
                    "form": pa.array([texts[o] for o in best], pa.string()),
                }
            )

    rows = tiled(in_groups(words), "key", F.col("word"), settings.tile_rows)
    order = ["m", "key", "tile_i", "tile_j"]
    met = rows.repartition(*order[1:]).sortWithinPartitions(*order)
    found = met.mapInArrow(run, "word string, n_near long, minus long, form string")
    return found.groupBy("word").agg(
        F.sum("n_near").alias("n_near"), F.min(F.struct("minus", "form")).alias("top")
    )


def rooted(forms: DataFrame) -> DataFrame:
    """word, root: the last of the words that ``forms`` (word, form) lead to from ``word``.

    Every step of a chain has ``ratio`` times the occurrences, so chains are short and end;
    each round doubles the steps taken.
    """
    roots = stored(forms.select("word", F.col("form").alias("root")), "roots")
    while True:
        further = roots.select(F.col("word").alias("root"), F.col("root").alias("next"))
        moved = roots.join(further, "root", "left")
        roots = stored(moved.select("word", F.coalesce("next", "root").alias("root"), "next"), "roots")
        if roots.filter("next is not null").isEmpty():
            return roots.select("word", "root")
        roots = roots.select("word", "root")


def variants(
    docs: DataFrame, doc_id: str = "doc_id", text: str = "text", settings: Settings = Settings()
) -> DataFrame:
    """word, n, n_near, form, form_n, root: one row per word of the corpus.

    ``n_near`` counts the words one inserted, deleted or replaced code point away, ``form`` is
    the one with most occurrences (ties: the smallest text) if it has ``ratio`` times the word's,
    else null, ``root`` the end of the chain of forms. Whole texts are read; texts that are null,
    empty or without letters have no words, and a corpus without words gives no rows.
    """
    if settings.ratio < 2:
        raise ValueError("ratio must be 2 or more, so that chains of forms end")
    words = stored(counted(docs, doc_id, text, settings), "words")
    near = words.join(neighbours(words, settings), "word", "left")
    form_n = -F.col("top.minus")
    led = form_n >= settings.ratio * F.col("n")
    near = stored(
        near.select(
            "word",
            "n",
            F.coalesce("n_near", F.lit(0)).alias("n_near"),
            F.when(led, F.col("top.form")).alias("form"),
            F.when(led, form_n).alias("form_n"),
        ),
        "near-words",
    )
    roots = rooted(near.filter("form is not null"))
    return near.join(roots, "word", "left").select(
        "word", "n", "n_near", "form", "form_n", F.coalesce("root", "word").alias("root")
    )
