"""Language identification: multinomial naive Bayes over hashed character n-grams.

Counts of hashed 1- to 3-grams by language are gathered from all training documents: each task adds up a table of
BUCKETS counts for each language it meets, and the tables are summed by bucket. The matrix of smoothed log
probabilities of all languages is broadcast (languages x BUCKETS floats). The n-grams of a batch become pairs of text and
bucket, the sparse rows of the batch; their counts, of STRETCHES texts at a time, are multiplied with the matrix.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .store import materialize, small_batches

BUCKETS = 1 << 13
ORDERS = (1, 2, 3)
SMOOTHING = 0.5
#: Characters, and texts or pieces of texts, scored at once; a longer text is cut into pieces, each n-gram being in one.
PIECE, STRETCHES = 1 << 18, 256
#: Languages counted, gathered and scored at once; there is no limit to their number.
LANGS = 256


def pieces(texts: list[str]) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """(code points, bounds, index of the text each stretch belongs to, whether it goes on from the stretch before).

    A stretch that goes on repeats the last max(ORDERS) - 1 characters before it.
    """
    held, of, on, total = [], [], [], 0
    for i, text in enumerate(texts):
        low = text.lower()
        step = max(1, PIECE - max(ORDERS) + 1)
        for at in range(0, max(1, len(low)), step):
            part = low[at : at + step + max(ORDERS) - 1]
            if at and len(part) < max(ORDERS):
                break
            held.append(part)
            of.append(i)
            on.append(at > 0)
            total += len(part)
            if total >= PIECE or len(held) >= STRETCHES:
                yield _points(held, of, on)
                held, of, on, total = [], [], [], 0
    if held:
        yield _points(held, of, on)


def _points(held: list[str], of: list[int], on: list[bool]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    points = np.frombuffer("".join(held).encode("utf-32-le", "surrogatepass"), dtype=np.uint32)
    return points, np.cumsum([0, *map(len, held)]), np.array(of), np.array(on)


def grams(points: np.ndarray, bounds: np.ndarray, on: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(bucket, stretch) of the n-grams of each order that lie inside one stretch and were not in the one before."""
    text = np.repeat(np.arange(len(bounds) - 1), np.diff(bounds))
    place = np.arange(len(points)) - bounds[:-1][text] if on.any() else None
    h = np.zeros(len(points), dtype=np.uint32)
    for n in range(1, max(ORDERS) + 1):
        full = len(points) - n + 1
        if full <= 0:
            return
        h = h[:full] * np.uint32(0x01000193) + points[n - 1 :] * np.uint32(0x9E3779B1) + np.uint32(n)
        if n in ORDERS:
            inside = text[:full] == text[n - 1 :]
            if place is not None:
                inside &= ~on[text[:full]] | (place[:full] >= max(ORDERS) - n)
            x = h ^ (h >> np.uint32(15))
            yield (((x * np.uint32(0x85EBCA6B)) >> np.uint32(32 - BUCKETS.bit_length() + 1))[inside]).astype(np.int64), text[:full][inside]


def is_held_out(mod: int, value: int):
    return F.pmod(F.crc32(F.col("doc_id").cast("string").cast("binary")), F.lit(mod)) == value


def count_grams(docs: DataFrame) -> DataFrame:
    """lang, bucket, n: over all rows of docs (text, lang); a task sends a table for each language, or more if it meets many."""

    def send(tables):
        for lang, own in tables.items():
            at = np.flatnonzero(own)
            yield pa.RecordBatch.from_arrays([pa.array([lang] * len(at), pa.string()), pa.array(at, pa.int32()), pa.array(own[at])], ["lang", "bucket", "n"])

    def run(batches):
        tables: dict[str, np.ndarray] = {}
        for batch in batches:
            langs = batch.column("lang").to_pylist()
            texts = batch.column("text").to_pylist()
            for lang in dict.fromkeys(langs):
                own = tables.setdefault(lang, np.zeros(BUCKETS, dtype=np.int64))
                for points, bounds, _, on in pieces([t for t, x in zip(texts, langs, strict=True) if x == lang]):
                    for bucket, _ in grams(points, bounds, on):
                        own += np.bincount(bucket, minlength=BUCKETS)
            if len(tables) > LANGS:
                yield from send(tables)
                tables = {}
        yield from send(tables)

    return docs.mapInArrow(run, "lang string, bucket int, n long").groupBy("lang", "bucket").agg(F.sum("n").alias("n"))


class Model:
    def __init__(self, langs: list[str], counts: np.ndarray | Iterable[np.ndarray], priors: np.ndarray) -> None:
        """counts: languages x BUCKETS, whole or in blocks of languages."""
        self.langs = langs
        self.logs = np.empty((len(langs), BUCKETS), dtype=np.float32)
        at = 0
        for part in [counts] if isinstance(counts, np.ndarray) else counts:
            smooth = part + SMOOTHING
            self.logs[at : at + len(part)] = np.log(smooth / smooth.sum(axis=1, keepdims=True))
            at += len(part)
        self.priors = np.log(priors / priors.sum())

    def score(self, texts: list[str], first: int = 0, end: int | None = None) -> np.ndarray:
        """Log probabilities up to a constant, texts x languages (from first to end)."""
        logs = self.logs[first:end].T.astype(float)
        out = np.tile(self.priors[first:end], (len(texts), 1))
        for points, bounds, of, on in pieces(texts):
            counts = np.zeros(len(of) * BUCKETS)
            for bucket, stretch in grams(points, bounds, on):
                counts += np.bincount(stretch * BUCKETS + bucket, minlength=len(counts))
            np.add.at(out, of, counts.reshape(len(of), BUCKETS) @ logs)
        return out

    def best(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """(best language, its posterior) of each text, over LANGS languages at a time; the first of equals."""
        lang, top, total = np.zeros(len(texts), dtype=np.int64), np.full(len(texts), -np.inf), np.zeros(len(texts))
        for first in range(0, len(self.langs), LANGS):
            logs = self.score(texts, first, first + LANGS)
            best = logs.max(axis=1)
            lang = np.where(best > top, first + logs.argmax(axis=1), lang)
            new = np.maximum(top, best)
            total = total * np.exp(top - new) + np.exp(logs - new[:, None]).sum(axis=1)
            top = new
        return lang, 1 / total


def fit(docs: DataFrame) -> Model | None:
    """From all documents with text and language that are not held out (crc32 of the doc_id's text mod 4 is 2)."""
    rows = docs.where(F.col("text").isNotNull() & F.col("lang").isNotNull() & F.coalesce(~is_held_out(4, 2), F.lit(True)))
    sizes = {r["lang"]: r["n"] for r in rows.groupBy("lang").agg(F.count(F.lit(1)).alias("n")).collect()}
    if not sizes:
        return None
    langs = sorted(sizes)
    found = count_grams(rows.select("text", "lang"))
    if len(langs) > LANGS:
        found = materialize(found, "grams")

    def blocks() -> Iterator[np.ndarray]:
        for i in range(0, len(langs), LANGS):
            part = langs[i : i + LANGS]
            got = (found.where(F.col("lang").isin(part)) if len(langs) > LANGS else found).toPandas()
            counts = np.zeros((len(part), BUCKETS))
            counts[np.searchsorted(np.array(part, dtype=object), got["lang"].to_numpy(object)), got["bucket"].to_numpy()] = got["n"].to_numpy()
            yield counts

    return Model(langs, blocks(), np.array([sizes[x] for x in langs], dtype=float))


def identify_languages(docs: DataFrame) -> DataFrame:
    """doc_id, held_out, lang_pred, score; one row per row of docs.

    docs needs doc_id, text, lang. score is the posterior of lang_pred. Null text, or text without a letter: und, score
    0. Ties go to the language that sorts first. Without any training document every prediction is und. A null doc_id
    has a null held_out and trains the model.
    """
    small_batches(docs.sparkSession)
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"), F.col("lang").cast("string").alias("lang"))
    shared = docs.sparkSession.sparkContext.broadcast(fit(docs))

    def run(batches):
        model = shared.value
        for batch in batches:
            texts = batch.column("text").to_pylist()
            pred, prob = ["und"] * len(texts), np.zeros(len(texts))
            at = [i for i, t in enumerate(texts) if t and model and any(map(str.isalpha, t))]
            if at:
                best, prob[at] = model.best([texts[i] for i in at])
                for i, k in zip(at, best, strict=True):
                    pred[i] = model.langs[k]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("held_out"), pa.array(pred, pa.string()), pa.array(prob)], ["doc_id", "held_out", "lang_pred", "score"])

    rows = docs.select("doc_id", "text", is_held_out(4, 2).alias("held_out"))
    return rows.mapInArrow(run, "doc_id long, held_out boolean, lang_pred string, score double")
