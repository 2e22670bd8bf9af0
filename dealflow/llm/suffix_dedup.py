"""Repeated byte strings: every byte covered by a string of fixed length that starts elsewhere too.

Prefix-free parsing: the least rolling hash among the next positions is a trigger, and triggers
cut a text into phrases. A string's first trigger depends on the string alone, so equal strings
have it at the same place, and a string is told by a suffix of a phrase (up to the trigger) and a
prefix of the parse (from the trigger on). The order of the corpus is only needed down to the
length of the strings, and only to tell equal neighbours from others; so phrases and parses are
grouped by hashes of that depth, and no order of all suffixes is built:

1. Of each trigger, the part of the parse that all its strings share (the core). A core that
   stands once in the corpus rules out all strings of its trigger.
2. Triggers with a repeated core: the phrase and parse that all its strings cover (the context).
   A context that stands twice decides all strings of its trigger.
3. For what is left, at the edges of repeats, each single string, against those of one trigger
   per different context with an equal core.

Hashes have 64 bits: a string is taken for another with a probability of 2 ** -64 per pair.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from dealflow.llm.common import chunks, columns, joined, released, stored, text_or_empty
from dealflow.llm.rolling import U64, inverse_powers, prefix_hash, span_hash
from dealflow.llm.shingles import mixed

CHUNK = 1 << 18
#: A span is one number: start * WIDTH + strings that follow the first one.
WIDTH = 256


@dataclass(frozen=True)
class Settings:
    """Strings of ``length`` bytes; triggers are least hashes of ``gram`` bytes among ``window``
    positions, a power of two below WIDTH with window + gram <= length + 1."""

    length: int = 200
    window: int = 128
    gram: int = 16


@dataclass(frozen=True)
class Triggers:
    """Per trigger: row, first string start, strings that follow it, and hashes."""

    row: np.ndarray
    start: np.ndarray
    more: np.ndarray
    core: np.ndarray
    context: np.ndarray


def pieces(texts: list[bytes], length: int) -> Iterator[list[tuple[int, int, bytes]]]:
    """Groups of (row, offset, bytes) of bounded size; pieces of a text share length - 1 bytes."""
    out, size = [], 0
    for row, text in enumerate(texts):
        for at in range(0, max(0, len(text) - length + 1), CHUNK):
            piece = text[at : at + CHUNK + length - 1]
            out.append((row, at, piece))
            size += len(piece)
            if size >= CHUNK:
                yield out
                out, size = [], 0
    if out:
        yield out


def triggers(group: list[tuple[int, int, bytes]], settings: Settings) -> Triggers:
    """The triggers of all strings in a group of pieces."""
    length, window, gram = settings.length, settings.window, settings.gram
    data = np.frombuffer(b"".join(p for _, _, p in group), np.uint8)
    prefix, inverse = prefix_hash(data), inverse_powers(1 << max(len(data), 1).bit_length())
    n = len(data) - gram + 1
    key = mixed((prefix[gram:] - prefix[:-gram]) * inverse[:n])
    key = (key & U64(0xFFFFFFFF00000000)) | np.arange(n, dtype=U64)
    step = 1
    while step < window:
        key = np.minimum(key[:-step], key[step:])
        step *= 2
    sizes = np.array([len(p) for _, _, p in group])
    begins = np.cumsum(sizes) - sizes
    at = np.concatenate([np.arange(b, b + s - length + 1) for b, s in zip(begins, sizes, strict=True)])
    piece = np.repeat(np.arange(len(group)), sizes - length + 1)
    trigger = (key[at] & U64(0xFFFFFFFF)).astype(np.int64)
    new = np.r_[True, (trigger[1:] != trigger[:-1]) | (piece[1:] != piece[:-1])]
    first = np.flatnonzero(new)
    last = np.r_[first[1:], len(at)] - 1
    begin, end, trigger = at[first], at[last], trigger[first]
    core = span_hash(prefix, inverse, trigger, trigger + length - window + 1)
    context = span_hash(prefix, inverse, begin, end + length)
    context = mixed(context ^ mixed((trigger - begin).astype(U64)))
    own = piece[first]
    offset = np.array([o for _, o, _ in group])[own] - begins[own]
    row = np.array([r for r, _, _ in group])[own]
    return Triggers(row, begin + offset, end - begin, core, context)


def _signed(x: np.ndarray) -> pa.Array:
    return pa.array(x.view(np.int64))


def parsed(docs: DataFrame, settings: Settings, cores_only: bool) -> DataFrame:
    """Triggers of ``docs`` (rid, text): core, or core, context, rid and span."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in chunks(batch, "text", CHUNK):
                rid = part.column("rid").to_numpy()
                texts = part.column("text").cast(pa.binary()).to_pylist()
                for group in pieces(texts, settings.length):
                    found = triggers(group, settings)
                    out = {"core": _signed(found.core)}
                    if not cores_only:
                        out["context"] = _signed(found.context)
                        out["rid"] = pa.array(rid[found.row])
                        out["span"] = pa.array(found.start * WIDTH + found.more)
                    yield pa.record_batch(out)

    more = "" if cores_only else ", context long, rid long, span long"
    return docs.mapInArrow(run, f"core long{more}")


def listed(spans: DataFrame) -> DataFrame:
    """rid with the list of its spans, which is bounded by the length of the text."""
    return spans.groupBy("rid").agg(F.collect_list("span").alias("spans"))


def contexts(docs: DataFrame, open_: DataFrame, settings: Settings) -> DataFrame:
    """rid, span, known and the bytes that the strings of each span in ``open_`` cover."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in chunks(batch, "text", CHUNK):
                rids, spans, known, parts = [], [], [], []
                texts = part.column("text").cast(pa.binary()).to_pylist()
                columns_ = (part.column(c).to_pylist() for c in ("rid", "spans"))
                for rid, own, text in zip(*columns_, texts, strict=True):
                    for span in own:
                        start, more = divmod(span["span"], WIDTH)
                        rids.append(rid)
                        spans.append(span["span"])
                        known.append(span["known"])
                        parts.append(text[start : start + more + settings.length])
                yield pa.record_batch(
                    {
                        "rid": pa.array(rids, pa.int64()),
                        "span": pa.array(spans, pa.int64()),
                        "known": pa.array(known, pa.bool_()),
                        "bytes": pa.array(parts, pa.binary()),
                    }
                )

    lists = open_.groupBy("rid").agg(F.collect_list(F.struct("span", "known")).alias("spans"))
    # Rows that are repeated as a whole have no open span of their own but may be witnesses.
    texts = docs.join(lists.hint("merge"), "rid").dropDuplicates(["rid"]).select("rid", "text", "spans")
    return texts.mapInArrow(run, "rid long, span long, known boolean, bytes binary")


def strings(opened: DataFrame, settings: Settings) -> DataFrame:
    """rid, span (of one string), known and hash of every string in ``opened``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in chunks(batch, "bytes", CHUNK):
                spans = part.column("span").to_numpy()
                start, more = spans // WIDTH, spans % WIDTH
                data = np.frombuffer(b"".join(part.column("bytes").to_pylist()), np.uint8)
                begins = np.r_[0, np.cumsum(more + settings.length)[:-1]]
                own = np.repeat(np.arange(len(spans)), more + 1)
                step = np.arange(len(own)) - np.repeat(np.r_[0, np.cumsum(more + 1)[:-1]], more + 1)
                prefix = prefix_hash(data)
                inverse = inverse_powers(1 << max(len(data), 1).bit_length())
                at = begins[own] + step
                hashes = span_hash(prefix, inverse, at, at + settings.length)
                yield pa.record_batch(
                    {
                        "rid": part.column("rid").take(pa.array(own)),
                        "span": pa.array((start[own] + step) * WIDTH),
                        "known": part.column("known").take(pa.array(own)),
                        "hash": _signed(hashes),
                    }
                )

    return opened.mapInArrow(run, "rid long, span long, known boolean, hash long")


def identified(docs: DataFrame, doc_id: str, text: str) -> DataFrame:
    """doc_id, text and rid, which names a row by its id and text; equal rows share it."""
    rows = columns(docs, doc_id=doc_id, text=text).withColumn("text", text_or_empty())
    return rows.withColumn("rid", F.xxhash64("doc_id", "text"))


def repeated_spans(docs: DataFrame, settings: Settings = Settings()) -> DataFrame:
    """rid and spans: all strings of ``docs`` (rid, text) that stand twice or more.

    A hot core, context or string, one with more than a thousandth of the rows, is joined by a
    broadcast of the fewer than a thousand hot ones.
    """
    texts = docs.select("rid", "text")
    cores = parsed(texts, settings, cores_only=True).groupBy("core").agg(F.count("*").alias("n"))
    cores = stored(cores.filter("n > 1"), "cores")
    total = cores.agg(F.sum("n")).first()[0] or 0
    rows = stored(joined(parsed(texts, settings, cores_only=False), cores, "core", "n", total)
                  .drop("n"), "triggers")
    released(cores)

    # One trigger per context stands for all of it; it is found again by its hash.
    name = F.xxhash64("rid", "span")
    groups = rows.groupBy("core", "context").agg(F.count("*").alias("n"), F.min(name).alias("name"))
    groups = stored(groups, "contexts")
    cores = groups.groupBy("core").agg(F.count("*").alias("contexts")).filter("contexts > 1")
    cores = stored(cores, "mixed")
    mixed_ = joined(groups, cores, "core", "contexts", groups.count())
    marked = stored(
        groups.select("context", "n", "name", F.lit(False).alias("mixed"))
        .union(mixed_.select("context", "n", "name", F.lit(True)))
        .groupBy("context")
        .agg(F.max("n").alias("n"), F.max("name").alias("name"), F.max("mixed").alias("mixed")),
        "marked",
    )
    released(groups, cores)
    placed = stored(
        joined(rows.drop("core"), marked, "context", "n", rows.count()).select(
            "rid", "span", (F.col("n") > 1).alias("known"), ((name == F.col("name")) & F.col("mixed")).alias("open")
        ),
        "placed",
    )
    released(rows, marked)
    opened = placed.filter("open").select("rid", "span", "known").distinct()
    opened = stored(contexts(docs.select("rid", "text"), opened, settings), "open")
    single = strings(opened, settings)
    seen = stored(
        single.groupBy("hash").agg(
            F.count("*").alias("all"), F.count(F.when(~F.col("known"), 1)).alias("n")
        ).filter("all > 1 and n > 0"),
        "strings",
    )
    unknown = strings(opened.filter("not known"), settings).drop("known")
    total = seen.agg(F.sum("n")).first()[0] or 0
    found = joined(unknown, seen.drop("all"), "hash", "n", total)
    spans = placed.filter("known").select("rid", "span").union(found.select("rid", "span"))
    return listed(spans)


def kept(text: bytes, spans: list[int], length: int) -> tuple[bytes, int, int]:
    """What is left of ``text``, the number of bytes removed, and that of maximal runs of them."""
    if not spans:
        return text, 0, 0
    own = np.sort(np.array(spans, np.int64))
    start, end = own // WIDTH, own // WIDTH + own % WIDTH + length
    reach = np.maximum.accumulate(end)
    new = np.r_[True, start[1:] > reach[:-1]]
    begins, ends = start[new], reach[np.r_[np.flatnonzero(new)[1:] - 1, len(own) - 1]]
    edges = [0, *np.stack([begins, ends], 1).ravel().tolist(), len(text)]
    left = b"".join(text[a:b] for a, b in zip(edges[::2], edges[1::2], strict=True))
    return left, int((ends - begins).sum()), len(begins)


def without_repeats(
    docs: DataFrame, doc_id: str = "doc_id", text: str = "text", settings: Settings = Settings()
) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept (binary): one row per input row.

    Texts are UTF-8 bytes, null is empty; ``kept`` may start or end within a character. Strings
    are judged on the input, also within one text; matches never cross texts. Texts shorter than
    the string length stay whole. A row that stands twice repeats itself and loses everything
    but a text below that length. No rows in, no rows out.
    """
    rows = identified(docs, doc_id, text)
    spans = repeated_spans(rows, settings)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in chunks(batch, "text", CHUNK):
                texts = part.column("text").cast(pa.binary()).to_pylist()
                done = [
                    kept(t, s or [], settings.length)
                    for t, s in zip(texts, part.column("spans").to_pylist(), strict=True)
                ]
                yield pa.record_batch(
                    {
                        "doc_id": part.column("doc_id"),
                        "n_bytes": pa.array([len(t) for t in texts], pa.int64()),
                        "n_removed": pa.array([d[1] for d in done], pa.int64()),
                        "n_spans": pa.array([d[2] for d in done], pa.int64()),
                        "kept": pa.array([d[0] for d in done], pa.binary()),
                    }
                )

    kind = rows.schema["doc_id"].dataType.simpleString()
    # Spans grow with the documents, so they are not broadcast.
    return rows.join(spans.hint("merge"), "rid", "left").select("doc_id", "text", "spans").mapInArrow(
        run, f"doc_id {kind}, n_bytes long, n_removed long, n_spans long, kept binary"
    )
