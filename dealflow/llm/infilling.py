"""Fill-in-the-middle: texts cut twice at token boundaries and put into another order.

Tokens are runs of ASCII letters and single other characters. The code points of many texts go
into one wavelet matrix over four classes: a letter inside a token, one that starts a token, a
blank, any other character. The ranks of the classes that start tokens add up to the number of
tokens begun before a position; bisection on these ranks finds where a token begins.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from dealflow.llm.common import chunks, columns

CHUNK = 4 << 20
PREFIX, SUFFIX, MIDDLE = "<P>", "<S>", "<M>"
INSIDE, FIRST, BLANK, OTHER = range(4)


@dataclass(frozen=True)
class Settings:
    """``plain`` of 100 texts stay as they are, ``spm`` of 100 others have the suffix first."""

    seed: int = 1
    plain: int = 10
    spm: int = 20


class WaveletMatrix:
    """Ranks of values below ``2 ** bits`` in a sequence, from packed bits and their counts."""

    def __init__(self, values: np.ndarray, bits: int):
        self.length, self.bits, self.levels = len(values), bits, []
        for b in reversed(range(bits)):
            bit = (values >> b & 1).astype(bool)
            packed = np.packbits(bit, bitorder="little")
            words = np.zeros(len(values) // 64 + 1, np.uint64)
            words.view(np.uint8)[: len(packed)] = packed
            before = np.r_[0, np.cumsum(np.bitwise_count(words), dtype=np.int64)]
            self.levels.append((words, before, len(values) - int(before[-1])))
            values = np.r_[values[~bit], values[bit]]

    @staticmethod
    def ones(words: np.ndarray, before: np.ndarray, ends: np.ndarray) -> np.ndarray:
        """Set bits before each of ``ends``."""
        at = ends >> 6
        mask = (np.uint64(1) << (ends & 63).astype(np.uint64)) - np.uint64(1)
        return before[at] + np.bitwise_count(words[at] & mask)

    def rank(self, value: int, ends: np.ndarray) -> np.ndarray:
        """How often ``value`` stands before each position of ``ends``."""
        low, high = np.zeros_like(ends), ends
        for b, (words, before, zeros) in zip(reversed(range(self.bits)), self.levels, strict=True):
            low_ones, high_ones = (self.ones(words, before, x) for x in (low, high))
            if value >> b & 1:
                low, high = zeros + low_ones, zeros + high_ones
            else:
                low, high = low - low_ones, high - high_ones
        return high - low


class Boundaries:
    """Token boundaries of texts that stand one after the other."""

    def __init__(self, texts: list[str]):
        points = np.frombuffer("".join(texts).encode("utf-32-le"), np.uint32)
        self.lengths = np.array([len(t) for t in texts], np.int64)
        self.starts = np.cumsum(self.lengths) - self.lengths
        lower = points | 32
        letter = (lower >= ord("a")) & (lower <= ord("z"))
        first = letter.copy()
        first[1:] &= ~letter[:-1]
        begun = self.starts[self.lengths > 0]
        first[begun] = letter[begun]
        blank = np.isin(points, [9, 10, 11, 12, 13, 32])
        classes = np.where(letter, np.where(first, FIRST, INSIDE), np.where(blank, BLANK, OTHER))
        self.matrix = WaveletMatrix(classes.astype(np.uint8), 2)
        self.before = self.begun(self.starts)

    def begun(self, ends: np.ndarray) -> np.ndarray:
        """Tokens that begin before each position of all texts."""
        return sum(self.matrix.rank(c, ends) for c in (FIRST, BLANK, OTHER))

    def tokens(self) -> np.ndarray:
        """Tokens of each text."""
        return self.begun(self.starts + self.lengths) - self.before

    def after(self, count: np.ndarray) -> np.ndarray:
        """Code points in the first ``count`` tokens of each text: the last position before
        which no more tokens begin, by bisection."""
        low, high = np.zeros_like(self.lengths), self.lengths.copy()
        while (low < high).any():
            middle = (low + high + 1) >> 1
            fits = self.begun(self.starts + middle) - self.before <= count
            low, high = np.where(fits, middle, low), np.where(fits, high, middle - 1)
        return low


def draws(doc_id: bytes | None, seed: int) -> list[int]:
    """Four numbers below 2 ** 32 that hang on doc_id and seed alone."""
    digest = hashlib.sha256(b"%d:" % seed + (doc_id or b"")).digest()
    return [int.from_bytes(digest[i : i + 4], "big") for i in range(0, 16, 4)]


def transformed(
    docs: DataFrame, doc_id: str = "doc_id", text: str = "text", settings: Settings = Settings()
) -> DataFrame:
    """doc_id, n (tokens), form, prefix_chars, middle_chars, output: one row per input row.

    Forms: ``plain`` (the text itself), ``psm`` (prefix, suffix, middle) and ``spm`` (suffix,
    prefix, middle), each part after its mark. Cuts and form hang on doc_id alone, so repeated
    rows are cut alike; a null doc_id counts as an empty one. Texts that are null (taken as
    empty), empty or hold a mark are plain, without lengths of parts. No rows in, no rows out.
    """
    kind = docs.schema[doc_id].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in chunks(batch, "text", CHUNK):
                yield cut(part)

    def cut(batch: pa.RecordBatch) -> pa.RecordBatch:
        texts = [t or "" for t in batch.column("text").to_pylist()]
        hs = [draws(i, settings.seed) for i in batch.column("named").cast(pa.binary()).to_pylist()]
        bounds = Boundaries(texts)
        n = bounds.tokens()
        h = np.array(hs, np.int64).reshape(len(texts), 4)
        picks = np.sort(h[:, :2] % (n[:, None] + 1), axis=1)
        first, second = bounds.after(picks[:, 0]), bounds.after(picks[:, 1])
        forms, outputs = [], []
        for t, (_, _, h3, h4), x, y in zip(texts, hs, first, second, strict=True):
            marked = PREFIX in t or SUFFIX in t or MIDDLE in t
            if not t or marked or h3 % 100 >= 100 - settings.plain:
                form, out = "plain", t
            elif h4 % 100 < settings.spm:
                form, out = "spm", f"{SUFFIX}{t[y:]}{PREFIX}{t[:x]}{MIDDLE}{t[x:y]}"
            else:
                form, out = "psm", f"{PREFIX}{t[:x]}{SUFFIX}{t[y:]}{MIDDLE}{t[x:y]}"
            forms.append(form)
            outputs.append(out)
        plain = np.array([f == "plain" for f in forms], bool)
        return pa.record_batch(
            {
                "doc_id": batch.column("doc_id"),
                "n": pa.array(n, pa.int64()),
                "form": pa.array(forms, pa.string()),
                "prefix_chars": pa.array(first, pa.int64(), mask=plain),
                "middle_chars": pa.array(second - first, pa.int64(), mask=plain),
                "output": pa.array(outputs, pa.string()),
            }
        )

    rows = columns(docs, doc_id=doc_id, text=text).withColumn("named", F.col("doc_id").cast("string"))
    schema = f"doc_id {kind}, n long, form string, prefix_chars long, middle_chars long, output string"
    return rows.mapInArrow(run, schema)


def restored(output: Column, form: Column) -> Column:
    """The text that ``transformed`` has put into ``output``, exactly."""
    parts = F.split(output, f"{PREFIX}|{SUFFIX}|{MIDDLE}", -1)
    one, two, middle = (F.element_at(parts, i) for i in (2, 3, 4))
    return (
        F.when(form == "plain", output)
        .when(form == "psm", F.concat(one, middle, two))
        .when(form == "spm", F.concat(two, middle, one))
    )
