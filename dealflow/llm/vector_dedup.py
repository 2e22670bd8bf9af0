"""Embedding near-duplicates by a subspace pigeonhole join.

Two unit vectors with a cosine of at least t are at most sqrt(2 (1 - t)) apart. Vectors are
rotated (random signs, then a Hadamard matrix) and split into blocks of a few dimensions. If the
squared distance of two vectors is within its bound, that of some block is within the block's
share of it. So each block is joined by itself: vectors go to the cells of a grid over the first
dimensions of the block, and to the neighbouring cells that they are close enough to. Pairs within
a block's budget are candidates; a candidate counts in the first block that finds it, and is
verified by its exact cosine.

Coordinates are rounded to whole numbers before the rotation, which then is exact, as are the
distances in blocks: all tasks agree on which block finds a pair. Rounding widens the budgets.
"""

from __future__ import annotations

import hashlib
import itertools
from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache
from math import ceil, isqrt, log, sqrt

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from dealflow.llm.common import columns, joined, stored
from dealflow.llm.near_dup import connect
from dealflow.llm.tiles import TILE, join_up, tiled

#: Whole numbers per unit of length.
SCALE = 1 << 14
#: Pairs verified at a time, and rows of a tile compared with all its rows at a time.
PAIRS, STRIP = 1 << 15, 256


@dataclass(frozen=True)
class Settings:
    """Links are pairs of equal label with a cosine of at least ``cosine`` (above 0).

    Blocks have ``block_dims`` dimensions. The grid has as many dimensions as leave about
    ``cell_rows`` vectors of the largest label in a cell, up to ``grid_dims``; a cell with more
    than ``tile_rows`` is compared in tiles. None of them changes the result.
    """

    cosine: float = 0.98
    block_dims: int = 16
    cell_rows: int = 1024
    grid_dims: int = 4
    tile_rows: int = 2048
    seed: int = 11


def unit(vectors: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Rows scaled by a power of two each (exact, so that squares stay finite), their lengths."""
    _, exponent = np.frexp(np.abs(vectors).max(1))
    scaled = np.ldexp(vectors.astype(np.float64), -exponent[:, None])
    return scaled, np.sqrt((scaled * scaled).sum(1))


@lru_cache(8)
def rotation(dims: int, seed: int) -> np.ndarray:
    """dims x 2^p: signs times the first rows of a Hadamard matrix, all entries 1 or -1."""
    hadamard = np.ones((1, 1))
    while len(hadamard) < dims:
        hadamard = np.block([[hadamard, hadamard], [hadamard, -hadamard]])
    signs = np.random.default_rng(seed).choice([-1.0, 1.0], dims)
    return signs[:, None] * hadamard[:dims]


def rotated(vectors: np.ndarray, settings: Settings) -> np.ndarray:
    """Unit vectors as whole numbers, rotated; lengths grow by the root of the new dimensions."""
    scaled, lengths = unit(vectors)
    whole = np.rint(scaled / lengths[:, None] * SCALE)
    return whole @ rotation(vectors.shape[1], settings.seed)


def blocks(dims: int, settings: Settings) -> tuple[list[slice], int]:
    """Blocks of the rotated coordinates, and the budget of each in squared whole numbers."""
    padded = 1 << (dims - 1).bit_length()
    width = min(padded, 1 << (settings.block_dims.bit_length() - 1))
    # A coordinate of a difference is off by 1 at most.
    reach = sqrt(2 * max(0.0, 1 - settings.cosine)) * SCALE * (1 + 1e-9) + sqrt(dims)
    return [slice(i, i + width) for i in range(0, padded, width)], ceil(reach * reach * width)


def grid_offsets(dims: int) -> list[tuple[int, ...]]:
    """The own cell, and the half of its neighbours that come after it in order."""
    return [o for o in itertools.product((0, 1, -1), repeat=dims) if o >= (0,) * dims]


def prepared(rows: DataFrame) -> DataFrame:
    """vec_id, lab, k (identity of label and vector) and vec (packed); k is null if unusable."""
    kind = "<f4" if isinstance(rows.schema["vector"].dataType.elementType, T.FloatType) else "<f8"
    vec_id = rows.schema["vec_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            labels = batch.column("lab").to_pylist()
            present = batch.column("vec_id").is_valid().to_pylist()
            ks, vecs = [], []
            for label, there, vector in zip(labels, present, batch.column("vector"), strict=True):
                ks.append(None)
                vecs.append(None)
                values = vector.values
                if label is None or not there or values is None or values.null_count or not len(values):
                    continue
                numbers = values.to_numpy(zero_copy_only=False).astype(kind)
                if np.isfinite(numbers).all() and numbers.any():
                    vecs[-1] = numbers.tobytes()
                    ks[-1] = hashlib.sha256(label.encode() + b"\0" + vecs[-1]).digest()[:16]
            yield pa.record_batch(
                {
                    "vec_id": batch.column("vec_id"),
                    "lab": batch.column("lab"),
                    "k": pa.array(ks, pa.binary()),
                    "vec": pa.array(vecs, pa.binary()),
                }
            )

    return rows.mapInArrow(run, f"vec_id {vec_id}, lab string, k binary, vec binary")


def matrix(vecs: pa.Array, kind: str) -> np.ndarray:
    """Packed vectors of one length as rows."""
    vecs = vecs.to_pylist()
    return np.frombuffer(b"".join(vecs), kind).reshape(len(vecs), -1).astype(np.float64)


def in_cells(classes: DataFrame, kind: str, grid: int, settings: Settings) -> DataFrame:
    """One row per class, block and cell it is in or close to: cell, block, home, k, n, vec."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sizes = pa.compute.binary_length(batch.column("vec")).to_numpy()
            for size in np.unique(sizes):
                part = batch.take(pa.array(np.flatnonzero(sizes == size)))
                for at in range(0, part.num_rows, 4096):
                    yield from placed(part.slice(at, 4096))

    def placed(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        labels = [x.encode() + b"\0" for x in batch.column("lab").to_pylist()]
        whole = rotated(matrix(batch.column("vec"), kind), settings).astype(np.int64)
        size = batch.column("vec")[0].as_buffer().size
        cuts, budget = blocks(size // int(kind[-1]), settings)
        reach = isqrt(budget)
        width = 3 * reach + 1
        for block, cut in enumerate(cuts):
            own, rest = np.divmod(whole[:, cut][:, :grid], width)
            for offset in grid_offsets(own.shape[1]):
                near = np.ones(len(own), bool)
                for d, step in enumerate(offset):
                    if step:
                        near &= rest[:, d] >= width - reach if step > 0 else rest[:, d] <= reach
                rows = np.flatnonzero(near)
                if not len(rows):
                    continue
                cells = own[rows] + np.array(offset)
                head = np.array([size, block], np.int64).tobytes()
                names = [
                    hashlib.md5(labels[r] + head + c.tobytes()).digest()
                    for r, c in zip(rows, cells, strict=True)
                ]
                taken = batch.select(["k", "n", "vec"]).take(pa.array(rows))
                yield pa.record_batch(
                    {
                        "cell": pa.array(names, pa.binary()),
                        "block": pa.array(np.full(len(rows), block, np.int32)),
                        "home": pa.array(np.full(len(rows), not any(offset))),
                        **{c: taken.column(c) for c in ("k", "n", "vec")},
                    }
                )

    schema = "cell binary, block int, home boolean, k binary, n long, vec binary"
    return classes.select("lab", "k", "n", "vec").mapInArrow(run, schema)


def found_in(tiles: DataFrame, kind: str, settings: Settings) -> DataFrame:
    """k, links (rows of other classes linked) and hub (a class of the component in the tile)."""

    def compare(group: pa.Table) -> pa.Table:
        group = group.combine_chunks()
        block, i, j = (group.column(c)[0].as_py() for c in ("block", "tile_i", "tile_j"))
        home, part, n = (group.column(c).to_numpy() for c in ("home", "part", "n"))
        vectors = matrix(group.column("vec").combine_chunks(), kind)
        cuts, budget = blocks(vectors.shape[1], settings)
        whole = rotated(vectors, settings)
        scaled, lengths = unit(vectors)
        own = whole[:, cuts[block]]
        squares = (own * own).sum(1)
        links, root = np.zeros(len(n), np.int64), np.arange(len(n))
        for at in range(0, len(n), STRIP):
            some = slice(at, at + STRIP)
            apart = squares[some, None] + squares - 2 * (own[some] @ own.T)
            # Each pair once, never two visitors of the cell, nor two rows of one part of two.
            ok = (apart <= budget) & (np.arange(len(n)) > np.arange(len(n))[some, None])
            ok &= home[some, None] | home
            if i != j:
                ok &= part[some, None] != part
            left, right = np.nonzero(ok)
            for first in range(0, len(left), PAIRS):
                a, b = left[first : first + PAIRS] + at, right[first : first + PAIRS]
                for cut in cuts[:block]:
                    gap = whole[a, cut] - whole[b, cut]
                    later = (gap * gap).sum(1) > budget
                    a, b = a[later], b[later]
                cosine = (scaled[a] * scaled[b]).sum(1) / (lengths[a] * lengths[b])
                a, b = a[cosine >= settings.cosine], b[cosine >= settings.cosine]
                np.add.at(links, a, n[b])
                np.add.at(links, b, n[a])
                join_up(root, a, b)
        linked = pa.array(np.flatnonzero(links))
        k = group.column("k")
        return pa.table(
            {
                "k": k.take(linked),
                "links": pa.array(links).take(linked),
                "hub": k.take(pa.array(root).take(linked)),
            }
        )

    return tiles.groupBy("cell", *TILE[:2]).applyInArrow(compare, "k binary, links long, hub binary")


def components(
    vectors: DataFrame,
    vec_id: str = "vec_id",
    vector: str = "embedding",
    label: str = "label",
    settings: Settings = Settings(),
) -> DataFrame:
    """vec_id, n_links, component_id, kept: one row per input row.

    ``n_links`` counts the other rows linked directly (rows with an equal vector among them),
    ``component_id`` is the smallest vec_id that links reach, ``kept`` whether it is the row's
    own. Labels are equal if their texts are. Vectors that are null, empty, zero or hold a null
    or non-finite component, and rows without a label, are linked with nothing; vectors of
    unlike lengths never are. Rows without vec_id are not compared: their component is null and
    they are kept. Repeated rows are linked with each other. No rows in, no rows out.
    """
    rows = columns(vectors, vec_id=vec_id, vector=vector, lab=label)
    kind = "<f4" if isinstance(rows.schema["vector"].dataType.elementType, T.FloatType) else "<f8"
    if kind == "<f8":
        rows = rows.withColumn("vector", F.col("vector").cast("array<double>"))
    own = stored(prepared(rows.withColumn("lab", F.col("lab").cast("string"))), "vectors")
    usable = own.filter("k is not null")
    one = [F.first(c).alias(c) for c in ("lab", "vec")]
    classes = usable.groupBy("k").agg(*one, F.min("vec_id").alias("id"), F.count("*").alias("n"))
    classes = stored(classes, "classes")

    most = classes.groupBy("lab", F.length("vec")).count().agg(F.max("count")).first()[0] or 1
    grid = min(settings.grid_dims, max(1, ceil(log(most / settings.cell_rows, 3))))
    cells = in_cells(classes, kind, grid, settings)
    tiles = tiled(cells, "cell", F.col("k"), settings.tile_rows)
    found = stored(found_in(tiles, kind, settings), "found")

    counts = found.groupBy("k").agg(F.sum("links").alias("links"))
    roots = connect(found.select(F.col("k").alias("a"), F.col("hub").alias("b")))
    placed = classes.select("k", "id", "n").join(counts, "k", "left").join(roots, "k", "left")
    placed = stored(
        placed.select(
            "k",
            "id",
            "n",
            (F.coalesce("links", F.lit(0)) + F.col("n") - 1).alias("n_links"),
            F.coalesce("root", "k").alias("root"),
        ),
        "placed",
    )
    total = placed.count()
    least = placed.groupBy("root").agg(F.min("id").alias("component_id"), F.count("*").alias("n_root"))
    placed = joined(placed, stored(least, "components"), "root", "n_root", total)
    placed = stored(placed.select("k", "n", "n_links", "component_id"), "linked")
    linked = joined(usable.select("vec_id", "k"), placed, "k", "n", usable.count())
    alone = own.filter("k is null").select(
        "vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id")
    )
    out = linked.select("vec_id", "n_links", "component_id").unionByName(alone)
    return out.withColumn(
        "kept", F.coalesce(F.col("vec_id") == F.col("component_id"), F.lit(True))
    )
