"""Near-duplicates: banded MinHash candidates, sequential Bayesian verification, exact links.

Texts with equal shingle sets form a class. Classes that share a band of their signatures are
candidates. Within a band's bucket each class is compared with a pivot, its most central class,
so pairs stay linear in the bucket. Signatures are compared batch by batch,
and a pair goes once the posterior probability that it is similar enough falls below a chosen
miss probability. What is left is verified on full shingle sets and linked. A bucket whose
classes are then all connected is done, as further links in it change nothing. In any other one,
the classes outside its largest component are compared with all of the bucket on full sets, in
bounded blocks that give at most one link per class and component. Thus no candidate link is lost.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from math import comb

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from dealflow.llm.common import chunks, columns, joined, stored
from dealflow.llm.shingles import mixed, shingle_sets

CHUNK = 4 << 20
U64 = np.uint64


@dataclass(frozen=True)
class Settings:
    """Links are pairs with ``100 * intersection >= percent * union`` of their shingle sets.

    ``bands`` of ``rows`` hashes miss a pair at 80 % with probability 2e-6; ``batch`` hashes
    are compared at a time; ``miss`` is the chance to lose a pair in that comparison.
    """

    words: int = 5
    percent: int = 80
    bands: int = 25
    rows: int = 4
    batch: int = 20
    miss: float = 1e-6
    block: int = 512

    @property
    def hashes(self) -> int:
        return self.bands * self.rows


def least_matches(settings: Settings) -> list[tuple[int, int]]:
    """After so many hashes, the matches below which a pair goes.

    With a uniform prior, the posterior probability of a similarity of at least t after m
    matches in n hashes is that of at most m successes in n + 1 draws with probability t.
    """
    t = settings.percent / 100
    out = []
    for n in range(settings.batch, settings.hashes + 1, settings.batch):
        chance, m = 0.0, -1
        while chance < settings.miss:
            m += 1
            chance += comb(n + 1, m) * t**m * (1 - t) ** (n + 1 - m)
        out.append((n, m))
    return out


def signature(shingles: np.ndarray, salts: np.ndarray) -> np.ndarray:
    """16 bits of the least hash per salt, spread anew; long sets are handled in parts."""
    least = np.full(len(salts), np.iinfo(U64).max, U64)
    for at in range(0, len(shingles), 1 << 14):
        part = shingles[at : at + (1 << 14), None]
        np.minimum(least, ((part ^ salts) * (salts | U64(1))).min(0), out=least)
    return (mixed(least) >> U64(48)).astype(np.uint16)


def identity(shingles: np.ndarray) -> bytes:
    """128 bits that tell shingle sets apart."""
    return b"".join(int(mixed(shingles + U64(k)).sum(dtype=U64)).to_bytes(8, "little") for k in (1, 2))


def sketches(docs: DataFrame, settings: Settings) -> DataFrame:
    """doc_id, text_hash, n_shingles, k (identity of the set) and sig of each row."""
    salts = mixed(np.arange(1, settings.hashes + 1, dtype=U64) * U64(0x9E3779B97F4A7C15))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in chunks(batch, "text", CHUNK):
                texts = [x or b"" for x in part.column("text").cast(pa.binary()).to_pylist()]
                sets = shingle_sets(texts, settings.words)
                yield pa.record_batch(
                    {
                        "doc_id": part.column("doc_id"),
                        "text_hash": part.column("text_hash"),
                        "n_shingles": pa.array([len(s) for s in sets], pa.int64()),
                        "k": pa.array([identity(s) for s in sets], pa.binary()),
                        "sig": pa.array([signature(s, salts).tobytes() for s in sets], pa.binary()),
                    }
                )

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.mapInArrow(
        run, f"doc_id {kind}, text_hash long, n_shingles long, k binary, sig binary"
    )


def shingled(docs: DataFrame, wanted: DataFrame, settings: Settings) -> DataFrame:
    """k and set (packed hashes) of the classes in ``wanted`` (k, rep), read from their texts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in chunks(batch, "text", CHUNK):
                texts = [x or b"" for x in part.column("text").cast(pa.binary()).to_pylist()]
                sets = [s.tobytes() for s in shingle_sets(texts, settings.words)]
                yield pa.record_batch({"k": part.column("k"), "set": pa.array(sets, pa.binary())})

    by = ["doc_id", "text_hash"]
    # The classes grow with the documents, so they are not broadcast.
    texts = docs.join(wanted.select("k", "rep.*").hint("merge"), by).dropDuplicates(by)
    return texts.select("k", "text").mapInArrow(run, "k binary, set binary")


def promising(pairs: DataFrame, settings: Settings) -> DataFrame:
    """Pairs (a, b, sig_a, sig_b) that the batches of hashes do not rule out, as (a, b)."""
    steps = least_matches(settings)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sigs = [
                np.frombuffer(b"".join(batch.column(c).to_pylist()), np.uint16).reshape(
                    batch.num_rows, settings.hashes
                )
                for c in ("sig_a", "sig_b")
            ]
            alive, matches, done = np.arange(batch.num_rows), np.zeros(batch.num_rows, int), 0
            for n, least in steps:
                matches = matches + (sigs[0][alive, done:n] == sigs[1][alive, done:n]).sum(1)
                alive, matches, done = alive[matches >= least], matches[matches >= least], n
            yield batch.select(["a", "b"]).take(pa.array(alive))

    return pairs.mapInArrow(run, "a binary, b binary")


def similar(shared: np.ndarray | int, a: np.ndarray | int, b: np.ndarray | int, percent: int):
    return 100 * shared >= percent * (a + b - shared)


def verified(pairs: DataFrame, percent: int) -> DataFrame:
    """Pairs (a, b, set_a, set_b) whose full sets are similar enough, as links (a, b)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            good = []
            for x, y in zip(batch.column("set_a"), batch.column("set_b"), strict=True):
                x, y = (np.frombuffer(s.as_buffer(), U64) for s in (x, y))
                both = len(x) + len(y) - len(np.union1d(x, y))
                good.append(bool(similar(both, len(x), len(y), percent)))
            yield batch.select(["a", "b"]).filter(pa.array(good, pa.bool_()))

    return pairs.mapInArrow(run, "a binary, b binary")


def with_both(pairs: DataFrame, table: DataFrame, column: str) -> DataFrame:
    """``pairs`` (a, b) with the ``column`` of both classes from ``table`` (k, column)."""
    for side in ("a", "b"):
        own = table.select(F.col("k").alias(side), F.col(column).alias(f"{column}_{side}"))
        pairs = pairs.join(own, side)
    return pairs


def connect(links: DataFrame) -> DataFrame:
    """k and root: every class in ``links`` (a, b) with one class of its component.

    In each round a class hooks onto its least neighbour, chains of hooks are shortened, and
    links are carried over to the roots, which at least halves the classes that have links.
    """
    edges = stored(links.filter("a <> b").distinct(), "links")
    roots = edges.select(F.col("a").alias("k")).union(edges.select("b")).distinct()
    roots = roots.select("k", F.col("k").alias("root"))
    while not edges.isEmpty():
        both = edges.union(edges.select("b", "a"))
        hooks = both.groupBy(F.col("a").alias("k")).agg(F.min("b").alias("up"))
        hooks = stored(hooks.select("k", F.least("k", "up").alias("up")), "hooks")
        for _ in range(2):
            over = hooks.select(F.col("k").alias("up"), F.col("up").alias("top"))
            hooks = hooks.join(over, "up").select("k", F.col("top").alias("up"))
        hooks = stored(hooks, "hooks")
        to = lambda c: hooks.select(F.col("k").alias(c), F.col("up").alias(f"{c}_up"))
        roots = stored(
            roots.join(to("root"), "root", "left").select(
                "k", F.coalesce("root_up", "root").alias("root")
            ),
            "roots",
        )
        edges = edges.join(to("a"), "a").join(to("b"), "b")
        edges = edges.select(F.col("a_up").alias("a"), F.col("b_up").alias("b"))
        edges = stored(edges.filter("a <> b").distinct(), "links")
    return roots


def rest_links(
    members: DataFrame, roots: DataFrame, sets: DataFrame, settings: Settings
) -> DataFrame | None:
    """Links in buckets that are not connected yet: the classes outside a bucket's largest
    component against all its classes, in blocks; None if every bucket is connected."""
    placed = members.join(roots, "k", "left").select(
        "bucket", "k", F.coalesce("root", "k").alias("root")
    )
    parts = placed.groupBy("bucket", "root").agg(F.count("*").alias("n"))
    main = parts.groupBy("bucket").agg(
        F.max(F.struct("n", "root"))["root"].alias("main"),
        F.sum("n").alias("rows"),
        F.count("*").alias("parts"),
        F.max("n").alias("most"),
    )
    # In a bucket of two classes the one pair has been compared.
    open_ = stored(main.filter("parts > 1 and rows > 2"), "open")
    if open_.isEmpty():
        return None
    block = settings.block
    inside = stored(
        joined(placed, open_.drop("parts"), "bucket", "rows", placed.count())
        .withColumn("ask", F.col("root") != F.col("main"))
        .withColumn("cells", F.ceil(F.col("rows") / block).cast("int"))
        .withColumn("ask_cells", F.ceil((F.col("rows") - F.col("most")) / block).cast("int")),
        "open-members",
    )
    cell = lambda n, salt: F.pmod(F.xxhash64("k", "bucket", F.lit(salt)), F.col(n)).cast("int")
    every = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    asked = inside.filter("ask").select(
        "bucket", "k", "root", F.lit(True).alias("ask"), cell("ask_cells", 1).alias("row"),
        every("cells").alias("cell"),
    )
    there = inside.select(
        "bucket", "k", "root", F.lit(False).alias("ask"), every("ask_cells").alias("row"),
        cell("cells", 2).alias("cell"),
    )
    percent = settings.percent

    def compare(group: pa.Table) -> pa.Table:
        ks, roots_, ask = (group.column(c).to_pylist() for c in ("k", "root", "ask"))
        sets_ = [np.frombuffer(s.as_buffer(), U64) for s in group.column("set")]
        rows = [i for i, q in enumerate(ask) if not q]
        sizes = np.array([len(sets_[i]) for i in rows])
        values = np.concatenate([sets_[i] for i in rows])
        order = np.argsort(values, kind="stable")
        values, owner = values[order], np.repeat(np.arange(len(rows)), sizes)[order]
        links = {}
        for q in (i for i, x in enumerate(ask) if x):
            low, high = (np.searchsorted(values, sets_[q], side) for side in ("left", "right"))
            n = high - low
            at = np.repeat(low - np.r_[0, np.cumsum(n)[:-1]], n) + np.arange(n.sum())
            shared = np.bincount(owner[at], minlength=len(rows))
            for j in np.flatnonzero(similar(shared, sizes, len(sets_[q]), percent)):
                if roots_[rows[j]] != roots_[q]:
                    links.setdefault((ks[q], roots_[rows[j]]), ks[rows[j]])
        out = [(q, b) for (q, _), b in links.items()]
        return pa.table(
            {
                "a": pa.array([x[0] for x in out], pa.binary()),
                "b": pa.array([x[1] for x in out], pa.binary()),
            }
        )

    cells = asked.unionByName(there).join(sets, "k")
    return cells.groupBy("bucket", "row", "cell").applyInArrow(compare, "a binary, b binary")


def components(
    docs: DataFrame, doc_id: str = "doc_id", text: str = "text", settings: Settings = Settings()
) -> DataFrame:
    """doc_id, text_hash, n_shingles, component_id, kept: one row per input row.

    ``component_id`` is the smallest doc_id that can be reached over links, ``kept`` whether it
    is the row's own. Texts without words (null, empty, blank) are linked with nothing. Rows
    without doc_id are not compared: their component is null and they are kept. Ids are of any
    type with an order. An id that
    stands in several rows is not a link by itself. No rows in, no rows out.
    """
    rows = columns(docs, doc_id=doc_id, text=text)
    hashed = rows.withColumn("text_hash", F.xxhash64("text"))
    own = stored(sketches(hashed, settings), "sketches")
    useful = own.filter("n_shingles > 0 and doc_id is not null")
    first = F.min(F.struct("doc_id", "text_hash")).alias("rep")
    classes = stored(useful.groupBy("k").agg(first, F.first("sig").alias("sig")), "classes")
    width = settings.rows * 2
    bands = F.transform(
        F.sequence(F.lit(0), F.lit(settings.bands - 1)),
        lambda b: F.xxhash64(b, F.substring("sig", b * width + 1, F.lit(width))),
    )
    banded = classes.select("k", F.explode(bands).alias("bucket"))
    full = banded.groupBy("bucket").agg(F.count("*").alias("rows")).filter("rows > 1")
    total = classes.count() * settings.bands
    members = stored(joined(banded, stored(full, "buckets"), "bucket", "rows", total), "members")
    ids = classes.select("k", "rep")
    weight = members.groupBy("k").agg(F.sum("rows").alias("weight")).join(ids, "k")

    # The most central class of a bucket is in the largest buckets; ties go to the smallest id.
    weighed = members.join(stored(weight, "weights"), "k")
    center = F.min(F.struct((-F.col("weight")).alias("weight"), F.col("rep.doc_id").alias("id"), "k"))["k"]
    pivots = stored(
        weighed.groupBy("bucket").agg(center.alias("pivot"), F.count("*").alias("rows")), "pivots"
    )
    stars = joined(members.select("bucket", "k"), pivots, "bucket", "rows", members.count())
    pairs = stars.filter("k <> pivot").select(
        F.least("k", "pivot").alias("a"), F.greatest("k", "pivot").alias("b")
    )
    pairs = with_both(pairs.distinct(), classes, "sig")
    survivors = stored(promising(pairs, settings), "survivors")

    sets = stored(shingled(hashed, members.select("k").distinct().join(ids, "k"), settings), "sets")
    links = stored(verified(with_both(survivors, sets, "set"), settings.percent), "links")
    roots = connect(links)
    more = rest_links(members.select("bucket", "k"), roots, sets, settings)
    if more is not None:
        roots = connect(links.union(more))

    placed = classes.select("k", "rep").join(roots, "k", "left")
    placed = stored(
        placed.select("k", F.coalesce("root", "k").alias("root"), F.col("rep.doc_id").alias("id")),
        "placed",
    )
    least = placed.groupBy("root").agg(F.min("id").alias("component_id"), F.count("*").alias("n"))
    placed = joined(placed, stored(least, "components"), "root", "n", placed.count())
    placed = placed.select("k", "component_id")
    blank = (F.col("n_shingles") == 0) | F.col("doc_id").isNull()
    out = own.drop("sig").join(placed, "k", "left")
    component = F.when(blank, F.col("doc_id")).otherwise(F.col("component_id"))
    return out.select(
        "doc_id",
        "text_hash",
        "n_shingles",
        component.alias("component_id"),
        F.coalesce(F.col("doc_id") == component, F.lit(True)).alias("kept"),
    )


def deduplicated(docs: DataFrame, doc_id="doc_id", text="text", settings: Settings = Settings()):
    """The rows of ``docs``, unchanged, of which one document per component stays."""
    found = components(docs, doc_id, text, settings).filter("not kept")
    gone = found.select(F.col("doc_id").alias("gone_id"), F.col("text_hash").alias("gone_hash"))
    gone = stored(gone.distinct(), "gone")
    match = (docs[f"`{doc_id}`"] == gone["gone_id"]) & (
        F.xxhash64(docs[f"`{text}`"]) == gone["gone_hash"]
    )
    # They grow with the documents, so they are not broadcast.
    return docs.join(gone.hint("merge"), match, "left_anti")
