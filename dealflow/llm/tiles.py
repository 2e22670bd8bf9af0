"""Groups of any size for comparison: rows of large ones meet in tiles, each pair in one."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from dealflow.llm.common import HOT_SHARE, stored

#: Most large groups (a short key and a number each) that are broadcast.
BROADCAST_GROUPS = 50_000

TILE = ["tile_i", "tile_j", "part"]


def tiled(rows: DataFrame, key: str, spread: Column, block: int) -> DataFrame:
    """``rows`` with tile_i, tile_j and part: any two rows with an equal ``key`` meet in one tile.

    A group of up to ``block`` rows is one tile (0, 0). A larger one is dealt into parts of
    about ``block`` rows by a hash of ``spread``, and each row goes to the tiles of its part
    with every part. In a tile (i, i) all pairs count, in any other only those of unlike parts.
    ``key`` must be short (a digest). No key can put more than two parts into a task.
    """
    sizes = rows.groupBy(key).agg(F.count("*").alias("tile_rows"))
    large = stored(sizes.filter(F.col("tile_rows") > block), "large-groups")
    found = large.count()
    if found == 0:
        return rows.withColumns({name: F.lit(0) for name in TILE})
    if found <= BROADCAST_GROUPS:
        sized = rows.join(F.broadcast(large), key, "left")
    else:
        # Fewer than HOT_SHARE keys are that hot; without them no key is, and rows are merged.
        limit = rows.count() // HOT_SHARE + 1
        hot = F.broadcast(large.filter(F.col("tile_rows") > limit))
        rest = rows.join(hot, key, "left_anti")
        warm = large.filter(F.col("tile_rows") <= limit).hint("merge")
        sized = rows.join(hot, key).unionByName(rest.join(warm, key, "left"))
    parts = F.coalesce(F.ceil(F.col("tile_rows") / block), F.lit(1)).cast("int")
    part = F.pmod(F.xxhash64(spread), parts).cast("int")
    with_part = sized.withColumns({"part": part, "other": F.explode(F.sequence(F.lit(0), parts - 1))})
    return with_part.select(
        *rows.columns,
        F.least("part", "other").alias("tile_i"),
        F.greatest("part", "other").alias("tile_j"),
        "part",
    )


def whole_groups(
    batches: Iterator[pa.RecordBatch], names: Sequence[str], least: int
) -> Iterator[pa.Table]:
    """Sorted batches as tables of about ``least`` rows that hold groups of ``names`` whole.

    Each table has a further column ``group``, numbers that increase from group to group.
    """
    held: list[pa.RecordBatch] = []
    rows = 0
    for batch in batches:
        held.append(batch)
        rows += batch.num_rows
        if rows < least:
            continue
        table = _numbered(pa.Table.from_batches(held), names)
        group = table.column("group").to_numpy()
        end = int(np.searchsorted(group, group[-1]))
        if end:
            yield table.slice(0, end)
        held = table.slice(end).drop_columns(["group"]).combine_chunks().to_batches()
        rows -= end
    if rows:
        yield _numbered(pa.Table.from_batches(held), names)


def _numbered(table: pa.Table, names: Sequence[str]) -> pa.Table:
    table = table.combine_chunks()
    new = np.zeros(table.num_rows, bool)
    for name in names:
        values = table.column(name).combine_chunks()
        codes = values.dictionary_encode().indices.to_numpy()
        new[1:] |= codes[1:] != codes[:-1]
    return table.append_column("group", pa.array(np.cumsum(new)))


def join_up(root: np.ndarray, a: np.ndarray, b: np.ndarray) -> None:
    """Merge the components in ``root`` (each row's least known member) along links a - b."""
    while True:
        x, y = root[a], root[b]
        apart = x != y
        if not apart.any():
            return
        a, b, x, y = a[apart], b[apart], x[apart], y[apart]
        np.minimum.at(root, np.maximum(x, y), np.minimum(x, y))
        while True:
            up = root[root]
            if (up == root).all():
                break
            root[:] = up
