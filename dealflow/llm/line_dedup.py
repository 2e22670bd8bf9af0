"""Line deduplication by pairwise alignment.

Documents that share a rare line, one that at most ``rare`` documents have, are linked: each with
the first document that has the line and with the one before it. A frequent line links each
document with the first one only. Runs of lines that are just long enough to be deleted link in the
same way, by one hash per run, so every common block leads to an alignment with a document that has
it, and links stay linear in the lines. Linked pairs are aligned by patience diff: lines that are unique in both
documents, in the longest increasing order, split the texts, and the parts between are aligned
in the same way; parts without such lines are split by the common run with the most characters.
Aligned common blocks are deleted from the later document if long enough.
"""

from __future__ import annotations

from bisect import bisect_left
from collections import Counter
from collections.abc import Iterator, Sequence
from dataclasses import dataclass
from itertools import accumulate

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from dealflow.llm.common import columns, fresh, joined, stored, text_or_empty
from dealflow.llm.shingles import prefix_sums, run_hashes

BREAK = "\n"


@dataclass(frozen=True)
class Settings:
    """A block goes if its lines have at least ``least_chars`` characters without outer blanks."""

    rare: int = 100
    least_chars: int = 100


def rising(pairs: Sequence[tuple[int, int]]) -> list[tuple[int, int]]:
    """The longest run of pairs, sorted by the first number, with rising second numbers."""
    tops: list[int] = []
    at: list[int] = []
    before = [-1] * len(pairs)
    for i, (_, y) in enumerate(pairs):
        k = bisect_left(tops, y)
        before[i] = at[k - 1] if k else -1
        tops[k : k + 1] = [y]
        at[k : k + 1] = [i]
    out, i = [], at[-1] if at else -1
    while i >= 0:
        out.append(pairs[i])
        i = before[i]
    return out[::-1]


def heaviest(a: Sequence[int], b: Sequence[int], sizes: Sequence[int]) -> tuple[int, int, int, int]:
    """Size, places in ``a`` and ``b`` and lines of the common run that is largest by ``sizes``.

    ``a`` is read through the suffix automaton of ``b``, in time linear in both.
    """
    steps: list[dict[int, int]] = [{}]
    link, length, end, last = [-1], [0], [-1], 0
    for j, x in enumerate(b):
        new, p = len(steps), last
        steps.append({})
        length.append(length[last] + 1)
        link.append(0)
        end.append(j)
        while p >= 0 and x not in steps[p]:
            steps[p][x] = new
            p = link[p]
        if p >= 0:
            q = steps[p][x]
            if length[q] > length[p] + 1:
                clone = len(steps)
                steps.append(dict(steps[q]))
                length.append(length[p] + 1)
                link.append(link[q])
                end.append(end[q])
                while p >= 0 and steps[p].get(x) == q:
                    steps[p][x] = clone
                    p = link[p]
                link[q] = q = clone
            link[new] = q
        last = new
    before = [0, *accumulate(sizes)]
    best, state, n = (0, 0, 0, 0), 0, 0
    for i, x in enumerate(a):
        while state and x not in steps[state]:
            state = link[state]
            n = length[state]
        if x in steps[state]:
            state, n = steps[state][x], n + 1
            size = before[i + 1] - before[i + 1 - n]
            if (size, n) > (best[0], best[3]):
                best = (size, i + 1 - n, end[state] + 1 - n, n)
    return best


def patience(
    a: Sequence[int], b: Sequence[int], sizes: Sequence[int] | None = None, least: int = 1
) -> list[tuple[int, int]]:
    """Aligned positions of equal lines in ``a`` and ``b``, rising in both.

    Without a line that is unique in both, common runs below ``least`` by the ``sizes`` of the
    lines of ``a`` (1 each if None) are left out: they touch no other aligned line on both sides.
    """
    sizes = [1] * len(a) if sizes is None else sizes
    out, todo = [], [(0, len(a), 0, len(b))]
    while todo:
        a0, a1, b0, b1 = todo.pop()
        while a0 < a1 and b0 < b1 and a[a0] == b[b0]:
            out.append((a0, b0))
            a0, b0 = a0 + 1, b0 + 1
        while a0 < a1 and b0 < b1 and a[a1 - 1] == b[b1 - 1]:
            a1, b1 = a1 - 1, b1 - 1
            out.append((a1, b1))
        if a0 == a1 or b0 == b1:
            continue
        once = [Counter(x) for x in (a[a0:a1], b[b0:b1])]
        place = {b[j]: j for j in range(b0, b1) if once[1][b[j]] == 1}
        unique = [(i, place[a[i]]) for i in range(a0, a1) if once[0][a[i]] == 1 and a[i] in place]
        anchors = rising(unique)
        if not anchors:
            if sum(sizes[i] for i in range(a0, a1) if a[i] in once[1]) < least:
                continue
            size, i, j, n = heaviest(a[a0:a1], b[b0:b1], sizes[a0:a1])
            if n and size >= least:
                i, j = a0 + i, b0 + j
                out += [(i + k, j + k) for k in range(n)]
                todo += [(a0, i, b0, j), (i + n, a1, j + n, b1)]
            continue
        for (i, j), (k, m) in zip([(a0, b0), *anchors], [*anchors, (a1, b1)], strict=True):
            # The next part starts with its anchor, which is then stripped as common start.
            if (i, j) != (k, m):
                todo.append((i, k, j, m))
    return sorted(out)


def common_lines(
    a: Sequence[int], b: Sequence[int], sizes: Sequence[int], least: int
) -> list[int]:
    """Positions in ``a`` of lines in blocks that are aligned with ``b`` and long enough."""
    out: list[int] = []
    block: list[int] = []
    last = None
    for i, j in [*patience(a, b, sizes, least), (-1, -1)]:
        if last is not None and (i, j) != (last[0] + 1, last[1] + 1):
            if sum(sizes[x] for x in block) >= least:
                out += block
            block = []
        block.append(i)
        last = (i, j)
    return out


def line_table(rows: DataFrame) -> DataFrame:
    """rid, doc_id, lines (hashes) and sizes of each different row."""
    cut = F.split(F.col("text"), BREAK)
    hashed = rows.select(
        "rid",
        "doc_id",
        F.transform(cut, lambda x: F.xxhash64(F.trim(x))).alias("lines"),
        F.transform(cut, lambda x: F.length(F.trim(x))).alias("sizes"),
    )
    return hashed.dropDuplicates(["rid"])


def block_hashes(lines: np.ndarray, sizes: np.ndarray, least: int) -> np.ndarray:
    """Hashes of the shortest runs of two lines or more that have ``least`` characters.

    One run from each line on and one up to each line: every line of a longer common block is in
    one of them that is within the block.
    """
    before = np.r_[0, np.cumsum(sizes, dtype=np.int64)]
    at = np.flatnonzero(sizes)
    end = np.searchsorted(before, before[at] + least)
    first = np.searchsorted(before, before[at + 1] - least, side="right") - 1
    long, late = end <= len(lines), first >= 0
    first, end = np.r_[at[long], first[late]], np.r_[end[long], at[late] + 1]
    some = end - first > 1
    return np.unique(run_hashes(prefix_sums(lines.view(np.uint64)), first[some], end[some])).view(np.int64)


def with_blocks(table: DataFrame, settings: Settings) -> DataFrame:
    """``table`` and, as blocks, the ``block_hashes`` of each row."""

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            blocks = [
                block_hashes(
                    np.array(lines.values, np.int64), np.array(sizes.values, np.int64), settings.least_chars
                )
                for lines, sizes in zip(batch.column("lines"), batch.column("sizes"), strict=True)
            ]
            offsets = np.r_[0, np.cumsum([len(b) for b in blocks])].astype(np.int32)
            values = np.concatenate([np.zeros(0, np.int64), *blocks])
            cells = pa.ListArray.from_arrays(pa.array(offsets), pa.array(values))
            yield pa.RecordBatch.from_arrays([*batch.columns, cells], [*batch.schema.names, "blocks"])

    blocks = T.StructField("blocks", T.ArrayType(T.LongType()))
    return table.mapInArrow(add, T.StructType([*table.schema.fields, blocks]))


def linked(table: DataFrame, settings: Settings) -> DataFrame:
    """rid and first: each document with earlier ones that have a line or a block of it."""
    blank = F.xxhash64(F.lit(""))
    lines = table.select("rid", "doc_id", F.explode(F.array_distinct("lines")).alias("line"))
    lines = lines.filter(F.col("line") != blank)
    lines = lines.unionAll(table.select("rid", "doc_id", F.explode("blocks").alias("line")))
    first = F.min(F.struct("doc_id", "rid"))["rid"]
    shared = lines.groupBy("line").agg(first.alias("first"), F.count("*").alias("n"))
    shared = stored(shared.filter("n > 1"), "shared-lines")
    total = shared.agg(F.sum("n")).first()[0] or 0
    holders = joined(lines, shared, "line", "n", total)
    order = Window.partitionBy("line").orderBy("doc_id", "rid")
    rare = holders.filter(F.col("n") <= settings.rare)
    before = rare.select("rid", F.lag("rid").over(order).alias("first"))
    return holders.select("rid", "first").union(before).filter("rid <> first").distinct()


def masks(docs: DataFrame, settings: Settings = Settings()) -> DataFrame:
    """rid and gone (a flag per line) of the documents (rid, doc_id, text) that lose lines."""
    table = stored(with_blocks(line_table(docs), settings), "lines")
    pairs = stored(linked(table, settings), "pairs")
    own = pairs.join(table.select("rid", "lines", "sizes"), "rid")
    counts = pairs.groupBy("first").agg(F.count("*").alias("n"))
    other = table.select(F.col("rid").alias("first"), F.col("lines").alias("other"))
    firsts = stored(counts.join(other, "first"), "firsts")
    both = joined(own, firsts, "first", "n", pairs.count())

    def align(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rids, gone = [], []
            names = ("rid", "lines", "other", "sizes")
            cells = zip(*(batch.column(c) for c in names), strict=True)
            for rid, a, b, sizes in cells:
                a, b, sizes = a.as_py(), b.as_py(), sizes.as_py()
                found = common_lines(a, b, sizes, settings.least_chars)
                rids += [rid.as_py()] * len(found)
                gone += found
            yield pa.record_batch({"rid": pa.array(rids, pa.int64()), "at": pa.array(gone, pa.int32())})

    def flags(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for n, lost in zip(batch.column("n").to_pylist(), batch.column("lost").to_pylist()):
                flag = [False] * n
                for i in lost:
                    flag[i] = True
                out.append(flag)
            yield pa.record_batch({"rid": batch.column("rid"), "gone": pa.array(out, pa.list_(pa.bool_()))})

    lost = both.select("rid", "lines", "other", "sizes").mapInArrow(align, "rid long, at int")
    lost = lost.distinct().groupBy("rid").agg(F.collect_list("at").alias("lost"))
    sized = lost.join(table.select("rid", F.size("lines").alias("n")), "rid")
    return sized.mapInArrow(flags, "rid long, gone array<boolean>")


def shortened(
    docs: DataFrame, doc_id: str = "doc_id", text: str = "text", settings: Settings = Settings()
) -> DataFrame:
    """``docs`` with shorter texts and, as last columns, n_lines and n_removed.

    Of two documents the one with the larger doc_id is the later one; null ids come first, ties
    go by a hash. Blocks are found on the input, so nothing hangs on what is deleted elsewhere.
    Lines are compared without outer blanks; empty lines link nothing, but may be within a
    block. Rows with equal id and text count as one document and lose the same. Null texts stay
    null with 0 lines. An exact copy that is long enough becomes an empty text.
    """
    rid = fresh(docs, "rid")
    rows = columns(docs, doc_id=doc_id, text=text).withColumn("text", text_or_empty())
    gone = masks(rows.withColumn("rid", F.xxhash64("doc_id", "text")), settings)
    flags = fresh(docs, "gone")
    gone = stored(gone.select(F.col("rid").alias(rid), F.col("gone").alias(flags)), "masks")
    named = docs.withColumn(rid, F.xxhash64(docs[f"`{doc_id}`"], F.coalesce(docs[f"`{text}`"], F.lit(""))))
    cut = F.split(F.col(f"`{text}`"), BREAK)
    left = F.array_join(F.filter(cut, lambda _, i: ~F.get(F.col(flags), i)), BREAK)
    n_lines, n_removed = fresh(docs, "n_lines"), fresh(docs, "n_removed")
    # The flags grow with the documents, so they are not broadcast.
    return named.join(gone.hint("merge"), rid, "left").select(
        *[
            (F.when(F.col(flags).isNull(), F.col(f"`{c}`")).otherwise(left).alias(c) if c == text else docs[f"`{c}`"])
            for c in docs.columns
        ],
        F.when(F.col(f"`{text}`").isNull(), 0).otherwise(F.size(cut)).alias(n_lines),
        F.coalesce(F.size(F.filter(flags, lambda x: x)), F.lit(0)).alias(n_removed),
    )
