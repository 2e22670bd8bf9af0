"""Language identification: multinomial naive Bayes over hashed character n-grams."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import cache

import numpy as np
import pyarrow as pa
import pyarrow.compute  # noqa: F401  (used as pa.compute)
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from dealflow.llm.common import chunks, columns

UNKNOWN = "und"
#: Text handled at once in a task, in bytes; a single longer text is handled in parts.
CHUNK = 2 << 20


@dataclass(frozen=True)
class Settings:
    """``buckets`` (a power of two) per language; a matrix of all languages with more than
    ``matrix_bytes`` is an error, to be met with fewer buckets. A text is of no learned language
    if the mean log probability of its n-grams is below that of the language by more than
    ``slack`` and ``deviations`` times what chance allows for its length.
    """

    buckets: int = 1 << 16
    orders: tuple[int, ...] = (1, 2, 3)
    smoothing: float = 0.5
    matrix_bytes: int = 256 << 20
    slack: float = 2.0
    deviations: float = 4.0


@dataclass(frozen=True)
class Model:
    languages: tuple[str, ...]
    logs: np.ndarray  # languages x buckets, log probability of a bucket
    prior: np.ndarray
    settings: Settings
    typical: np.ndarray  # languages x 2: mean and variance of a gram's log probability

    @property
    def orders(self) -> tuple[int, ...]:
        return self.settings.orders

    @property
    def buckets(self) -> int:
        return self.logs.shape[1]


@cache
def letters() -> np.ndarray:
    """Whether a code point is a letter."""
    return np.fromiter((chr(i).isalpha() for i in range(0x110000)), bool, 0x110000)


def grams(codes: np.ndarray, owner: np.ndarray, orders: tuple[int, ...], buckets: int):
    """Per order: the buckets of all n-grams and the row that each belongs to.

    Letters are kept, each run of other characters counts as one space. An n-gram holds a
    letter, and a space only at its ends. ``codes`` starts and each row ends with a space.
    """
    is_letter = letters()[codes]
    keep = is_letter.copy()
    keep[1:] |= is_letter[:-1]
    keep[0] = True
    codes = np.where(is_letter, codes, 32)[keep].astype(np.uint64)
    owner, is_letter = owner[keep], is_letter[keep]
    mixed = np.zeros(len(codes), np.uint64)
    for order in range(1, max(orders) + 1):
        n = len(codes) - order + 1
        if n <= 0:
            return
        mixed = mixed[:n] * np.uint64(0x9E3779B97F4A7C15) + codes[order - 1 :] + np.uint64(order)
        if order not in orders:
            continue
        inner = np.ones(n, bool)
        for i in range(1, order - 1):
            inner &= is_letter[i : n + i]
        if order == 1:
            inner = is_letter
        elif order == 2:
            inner = is_letter[:n] | is_letter[1 : n + 1]
        hashed = mixed[inner]
        hashed = (hashed ^ (hashed >> np.uint64(31))) * np.uint64(0xBF58476D1CE4E5B9)
        at = (hashed >> np.uint64(40)).astype(np.int64) & (buckets - 1)
        yield at, owner[min(1, order - 1) : n + min(1, order - 1)][inner]


def coded(texts: list[str | None]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Code points of lower-cased texts with the row of each, in bounded parts."""
    parts, owners, size = [], [], 0

    def packed():
        return (
            np.concatenate([np.array([32], np.uint32), *parts]),
            np.concatenate([np.array([owners[0][0]]), *owners]),
        )

    for row, text in enumerate(texts):
        for at in range(0, len(text or ""), CHUNK):
            part = (text[at : at + CHUNK].lower() + " ").encode("utf-32-le", "surrogatepass")
            codes = np.frombuffer(part, "<u4")
            parts.append(codes)
            owners.append(np.full(len(codes), row))
            size += len(codes)
            if size >= CHUNK:
                yield packed()
                parts, owners, size = [], [], 0
    if parts:
        yield packed()


def fit(docs: DataFrame, text: str = "text", label: str = "lang", settings: Settings = Settings()):
    """A model from all rows of ``docs`` with a label and a letter; None if there are none.

    Counts are summed in each task, then per language and bucket; the driver gets languages x
    buckets numbers, whatever the number of rows. Rows without label are left out.
    """
    rows = columns(docs, text=text, label=label).filter("label is not null")
    sizes = {r["label"]: r["n"] for r in rows.groupBy("label").agg(F.count("*").alias("n")).collect()}
    languages = tuple(sorted(sizes))
    if not languages:
        return None
    buckets = settings.buckets
    if buckets * len(languages) * 4 > settings.matrix_bytes:
        raise ValueError(
            f"{len(languages)} languages with {buckets} buckets each do not fit matrix_bytes of "
            f"{settings.matrix_bytes}; set fewer buckets or more bytes"
        )
    place, orders = {name: i for i, name in enumerate(languages)}, settings.orders

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = {}
        for batch in batches:
            for part in chunks(batch, "text", CHUNK):
                own = np.array([place[x] for x in part.column("label").to_pylist()])
                for codes, owner in coded(part.column("text").to_pylist()):
                    for at, row in grams(codes, owner, orders, buckets):
                        lang = own[row]
                        for k in np.unique(lang):
                            seen = total.setdefault(k, np.zeros(buckets, np.int64))
                            seen += np.bincount(at[lang == k], minlength=buckets)
        for k, seen in total.items():
            at = np.flatnonzero(seen)
            yield pa.record_batch(
                {"k": pa.array(np.full(len(at), k)), "at": pa.array(at), "n": pa.array(seen[at])}
            )

    summed = rows.mapInArrow(count, "k long, at long, n long")
    summed = summed.groupBy("k", "at").agg(F.sum("n").alias("n")).toPandas()
    seen = np.zeros((len(languages), buckets))
    seen[summed["k"].to_numpy(int), summed["at"].to_numpy(int)] = summed["n"].to_numpy(float)
    if not seen.any():
        return None
    logs = np.log(seen + settings.smoothing) - np.log(
        seen.sum(1, keepdims=True) + settings.smoothing * buckets
    )
    prior = np.log([sizes[x] for x in languages]) - np.log(sum(sizes.values()))
    share = seen / np.maximum(seen.sum(1, keepdims=True), 1)
    mean = (share * logs).sum(1)
    typical = np.stack([mean, (share * logs * logs).sum(1) - mean * mean], axis=1)
    return Model(languages, logs.astype(np.float32), prior, settings, typical)


def log_sums(texts: list[str | None], model: Model) -> tuple[np.ndarray, np.ndarray]:
    """Log probability of each text's n-grams in each language, and their number."""
    n = len(texts)
    total, number = np.zeros((n, len(model.languages))), np.zeros(n, np.int64)
    for codes, owner in coded(texts):
        for at, row in grams(codes, owner, model.orders, model.buckets):
            if not len(row):
                continue
            starts = np.flatnonzero(np.r_[True, row[1:] != row[:-1]])
            np.add.at(number, row[starts], np.diff(np.r_[starts, len(row)]))
            for k in range(len(model.languages)):
                sums = np.add.reduceat(model.logs[k][at], starts, dtype=np.float64)
                np.add.at(total[:, k], row[starts], sums)
    return total, number


def scored(texts: list[str | None], model: Model) -> tuple[list[str], np.ndarray]:
    """Language and posterior probability of each text; ``und`` and 0 without a letter."""
    sums, number = log_sums(texts, model)
    total = sums + model.prior
    best = total.argmax(1)
    score = 1 / np.exp(total - total.max(1, keepdims=True)).sum(1)
    names = [model.languages[k] if n else UNKNOWN for k, n in zip(best, number, strict=True)]
    return names, np.where(number > 0, score, 0.0)


def learned(texts: list[str | None], model: Model, least: float) -> np.ndarray:
    """Whether each text is in a learned language, with a posterior of ``least``.

    The posterior alone tells learned languages apart, but not others from them. So the text's
    n-grams must also be as probable, on average, as the language's own are. What chance allows
    is told from the variance of a gram; as n-grams overlap, each character is one draw only.
    """
    sums, number = log_sums(texts, model)
    total = sums + model.prior
    best = total.argmax(1)
    score = 1 / np.exp(total - total.max(1, keepdims=True)).sum(1)
    mean, variance = model.typical[best].T
    drawn = np.maximum(number / len(model.orders) / max(model.orders), 1)
    allowed = model.settings.slack + model.settings.deviations * np.sqrt(variance / drawn)
    own = sums[np.arange(len(texts)), best] / np.maximum(number, 1)
    return (number > 0) & (score >= least) & (own >= mean - allowed)


def _scores(batch: pa.RecordBatch, column: str, model: Model | None):
    texts = batch.column(column).to_pylist()
    return scored(texts, model) if model else ([UNKNOWN] * len(texts), np.zeros(len(texts)))


def predict(docs: DataFrame, model: Model | None, text: str = "text", keep: dict[str, str] = {}):
    """``lang_pred`` and ``score`` (0 to 1) of every whole text, with the columns in ``keep``.

    ``keep`` maps new names to columns. A null text or one without any letter gets ``und`` and
    0, as does every text without a model. Of equally likely languages the first by name wins.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)
    rows = columns(docs, **keep, _text=text)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in chunks(batch, "_text", CHUNK):
                names, score = _scores(part, "_text", shared.value)
                kept = {c: part.column(c) for c in keep}
                yield pa.record_batch(
                    kept | {"lang_pred": pa.array(names, pa.string()), "score": pa.array(score)}
                )

    kept = "".join(f"`{n}` {rows.schema[n].dataType.simpleString()}, " for n in keep)
    return rows.mapInArrow(run, f"{kept}lang_pred string, score double")


def accepted(docs: DataFrame, model: Model | None, least: float, text: str = "text") -> DataFrame:
    """The rows of ``docs``, unchanged, that are in a learned language, told with ``least``
    probability; none without a model."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in chunks(batch, text, CHUNK):
                texts = part.column(text).to_pylist()
                good = learned(texts, shared.value, least) if shared.value else np.zeros(len(texts), bool)
                yield part.filter(pa.array(good))

    return docs.mapInArrow(run, docs.schema)


def training_rows(docs: DataFrame, key: str = "doc_id", folds: int = 4, held: int = 2) -> DataFrame:
    """Rows whose crc32 of the key's text leaves another remainder than ``held``; no null keys."""
    return docs.filter(F.crc32(F.col(key).cast("string").cast("binary")) % folds != held)
