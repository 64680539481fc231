"""Language-model scoring with an Elias-Fano n-gram trie.

The model interpolates bigrams with the additive unigram model: p(w | h) = L c(hw) / c(h) + (1 - L) p(w), where p(w) is
the base model and an unseen h leaves p(w) alone. Counts come from all training documents and are spread over shards.

The trie's first level is the vocabulary: word hashes in order, cut into ranges, each an Elias-Fano sequence, with their
counts; a word's rank is its id. The second level holds the successors of each context, dealt to shards by a hash of the pair, so a frequent
context is in all of them. A shard keeps three Elias-Fano sequences: its contexts, the pointers to each context's
successors, and the successors as context rank * universe + word, which is monotone; and for each successor the
smoothed weight L c(hw) / c(h), quantised to 8 bits on a log scale. A query finds the context's rank, reads the range of
its successors off the pointers, and looks for the word inside that range only. Levels are files in the shared folder,
mapped into memory by every task that scores; a task keeps MOST_OPEN of them open and visits only those that a slice of
texts asks for, so the model may outgrow a task.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Iterator
from urllib.parse import urlparse

import numpy as np
import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .ngram_join import _planes, _unplanes
from .store import new_path, small_batches
from .tokens import U, buffers, mix, slices, words

#: Weight of the bigram part, additive constant of the unigrams.
WEIGHT, ADD = 0.6, 0.1
#: Tokens that a task gathers before it sends counts, and tokens for each shard.
FLUSH, SHARD = 1 << 19, 1 << 20
END = U(0xE0D0E0D0E0D0E0D1)
#: Bytes of texts that are looked up together.
GATHER = 6 << 20
#: Files of a level that a task keeps open.
MOST_OPEN = 256
#: 8-bit log scale: 256 levels over so many decades.
DECADES = 10.0


def select(words: np.ndarray, rank: np.ndarray) -> np.ndarray:
    """Place of the one bit with this rank in each 64-bit word, by halving."""
    place, rank = np.zeros(len(words), dtype=np.int64), rank.astype(np.int64)
    for width in (32, 16, 8, 4, 2, 1):
        ones = np.bitwise_count((words >> place.astype(np.uint64)) & U((1 << width) - 1)).astype(np.int64)
        right = rank >= ones
        place += width * right
        rank -= ones * right
    return place


class EliasFano:
    """A monotone sequence: low bits packed, high bits in unary. Directories: zeros and ones before each 64-bit word."""

    def __init__(self, n: int, bits: int, low: np.ndarray, high: np.ndarray, zeros: np.ndarray, ones: np.ndarray) -> None:
        self.n, self.bits, self.low, self.high, self.zeros, self.ones = n, bits, low, high, zeros, ones

    @classmethod
    def build(cls, values: np.ndarray, universe: int) -> EliasFano:
        n = len(values)
        bits = max(0, (universe // max(1, n)).bit_length() - 1)
        high = (values >> U(bits)).astype(np.int64)
        length = n + (int(high[-1]) if n else 0) + 2
        unary = np.zeros(-(-length // 64) * 64, dtype=np.uint8)
        unary[high + np.arange(n)] = 1
        word = np.packbits(unary, bitorder="little").view(np.uint64)
        ones = np.concatenate(([0], np.cumsum(np.bitwise_count(word), dtype=np.int64))).astype(np.int64)
        zeros = np.arange(len(word) + 1, dtype=np.int64) * 64 - ones
        low = np.zeros(-(-n * bits // 64) + 2, dtype=np.uint64)
        if bits:
            at = np.arange(n, dtype=np.int64) * bits
            value = values & U((1 << bits) - 1)
            shift = (at & 63).astype(np.uint64)
            np.bitwise_or.at(low, at >> 6, value << shift)
            spill = shift + U(bits) > U(64)
            np.bitwise_or.at(low, (at[spill] >> 6) + 1, value[spill] >> (U(64) - shift[spill]))
        return cls(n, bits, low, word, zeros, ones)

    def lows(self, i: np.ndarray) -> np.ndarray:
        if not self.bits:
            return np.zeros(len(i), dtype=np.uint64)
        at = i * self.bits
        shift = (at & 63).astype(np.uint64)
        left = self.low[at >> 6] >> shift
        right = np.where(shift == 0, U(0), self.low[(at >> 6) + 1] << ((U(64) - shift) & U(63)))
        return (left | right) & U((1 << self.bits) - 1)

    def before(self, high: np.ndarray) -> np.ndarray:
        """How many values have a smaller high part: ones before the zero that ends part high - 1."""
        out = np.zeros(len(high), dtype=np.int64)
        some = np.flatnonzero(high > 0)
        k = high[some] - 1  # rank of the zero
        word = np.searchsorted(self.zeros, k, "right") - 1
        past = word >= len(self.high)
        word = np.minimum(word, len(self.high) - 1)
        place = select(~self.high[word], np.where(past, 0, k - self.zeros[word]))
        out[some] = np.where(past, self.n, np.minimum(self.n, word * 64 + place - k))
        return out

    def find(self, values: np.ndarray, first: np.ndarray | None = None, last: np.ndarray | None = None) -> np.ndarray:
        """Index of each value between the indices first and last (exclusive), -1 if it is not there: the run of its high
        part within these bounds, then a binary search by low bits."""
        high = (values >> U(self.bits)).astype(np.int64)
        lo, hi = self.before(high), self.before(high + 1)
        if first is not None:
            lo, hi = np.maximum(lo, first), np.minimum(hi, last)
        want, end = values & U((1 << self.bits) - 1), hi.copy()
        open_ = np.flatnonzero(lo < hi)
        while len(open_):
            mid = (lo[open_] + hi[open_]) >> 1
            less = self.lows(mid) < want[open_]
            lo[open_[less]], hi[open_[~less]] = mid[less] + 1, mid[~less]
            open_ = open_[lo[open_] < hi[open_]]
        ok = lo < end
        ok[ok] = self.lows(lo[ok]) == want[ok]
        return np.where(ok, lo, -1)

    def get(self, i: np.ndarray) -> np.ndarray:
        """Values by index."""
        word = np.searchsorted(self.ones, i, "right") - 1
        place = select(self.high[word], i - self.ones[word])
        return (word * 64 + place - i).astype(np.uint64) << U(self.bits) | self.lows(i)

    def parts(self) -> dict[str, np.ndarray]:
        return {"low": self.low, "high": self.high, "zeros": self.zeros, "ones": self.ones, "shape": np.array([self.n, self.bits], dtype=np.int64)}

    @classmethod
    def of(cls, arrays: dict[str, np.ndarray], name: str) -> EliasFano:
        n, bits = arrays[f"{name}.shape"].tolist()
        return cls(n, bits, arrays[f"{name}.low"], arrays[f"{name}.high"], arrays[f"{name}.zeros"], arrays[f"{name}.ones"])


def save(folder: str, name: str, arrays: dict[str, np.ndarray]) -> int:
    """One file: a JSON header of 8-byte aligned arrays, then the arrays. A repeated task writes the same bytes."""
    files, root = fs.FileSystem.from_uri(folder)
    files.create_dir(root, recursive=True)
    head, at = {}, 0
    for k, a in arrays.items():
        head[k] = [a.dtype.str, at, len(a)]
        at += -(-a.nbytes // 8) * 8
    text = json.dumps(head).encode()
    text += b" " * (-(len(text) + 8) % 8)
    draft = f"{root}/{name}-{uuid.uuid4().hex}.tmp"  # attempts of one task may overlap
    with files.open_output_stream(draft, compression=None) as f:
        f.write(len(text).to_bytes(8, "little") + text)
        for a in arrays.values():
            f.write(a.tobytes() + b"\0" * (-a.nbytes % 8))
    files.move(draft, f"{root}/{name}")
    return at


def load(folder: str, name: str) -> dict[str, np.ndarray]:
    where = urlparse(folder)
    if where.scheme in ("", "file"):
        data = np.memmap(f"{where.path}/{name}", dtype=np.uint8, mode="r")
    else:
        files, root = fs.FileSystem.from_uri(folder)
        with files.open_input_file(f"{root}/{name}") as f:
            data = np.frombuffer(f.read(), dtype=np.uint8)
    n = int(data[:8].view(np.int64)[0])
    return {k: data[8 + n + at : 8 + n + at + np.dtype(kind).itemsize * size].view(kind) for k, (kind, at, size) in json.loads(bytes(data[8 : 8 + n])).items()}


def shelved(shelf: dict, key: int, make):
    """shelf[key], made if it is not there; the shelf keeps the MOST_OPEN last ones made."""
    if key not in shelf:
        while len(shelf) >= MOST_OPEN:
            del shelf[next(iter(shelf))]
        shelf[key] = make()
    return shelf[key]


def runs(of: np.ndarray) -> Iterator[tuple[int, int, int]]:
    """(value, first, last) of the runs of equal values."""
    starts = np.flatnonzero(np.concatenate(([True], of[1:] != of[:-1]))) if len(of) else np.zeros(0, np.int64)
    yield from zip(of[starts].tolist(), starts.tolist(), [*starts[1:].tolist(), len(of)], strict=True) if len(of) else ()


def larger(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The same rows in batches of about GATHER bytes, so that a visit to a file answers many queries."""
    held, total = [], 0
    for batch in batches:
        held.append(batch)
        total += batch.nbytes
        if total >= GATHER:
            yield pa.concat_batches(held)
            held, total = [], 0
    if held:
        yield pa.concat_batches(held)


def token_hashes(data: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Word hashes with an END after each text, and bounds."""
    hashes, bounds, _, _ = words(data, off)
    n = len(bounds) - 1
    out = np.full(len(hashes) + n, END, dtype=np.uint64)
    out[np.arange(len(hashes)) + np.repeat(np.arange(n), np.diff(bounds))] = hashes
    return out, bounds + np.arange(n + 1)


class Vocabulary:
    """The first level; shards are ranges of the hash. id: rank over all shards."""

    def __init__(self, folder: str, shards: int, sizes: dict[int, int], total: int) -> None:
        self.folder, self.shards, self.total = folder, shards, total
        self.sizes = sizes
        self.first = np.cumsum([0] + [sizes.get(s, 0) for s in range(shards)])
        self.starts = range_starts(shards)
        self.open: dict[int, tuple[EliasFano, np.ndarray]] = {}

    @property
    def size(self) -> int:
        return int(self.first[-1])

    def level(self, s: int) -> tuple[EliasFano, np.ndarray]:
        def make():
            a = load(self.folder, f"words-{s:06d}")
            return EliasFano.of(a, "hash"), a["count"]

        return shelved(self.open, s, make)

    def find(self, hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(id or -1, count) of sorted hashes."""
        ids, counts = np.full(len(hashes), -1, dtype=np.int64), np.zeros(len(hashes), dtype=np.int64)
        for s, a, b in runs(np.searchsorted(self.starts, hashes, "right") - 1):
            if self.sizes.get(s):
                sequence, count = self.level(s)
                at = sequence.find(hashes[a:b] - self.starts[s])
                ids[a:b] = np.where(at >= 0, at + self.first[s], -1)
                counts[a:b] = np.where(at >= 0, count[at], 0)
        return ids, counts

    def counts(self, ids: np.ndarray) -> np.ndarray:
        """Counts of sorted ids."""
        out = np.zeros(len(ids), dtype=np.int64)
        for s, a, b in runs(np.searchsorted(self.first, ids, "right") - 1):
            out[a:b] = self.level(s)[1][ids[a:b] - self.first[s]]
        return out


def range_starts(shards: int) -> np.ndarray:
    return np.array([(s << 64) // shards for s in range(shards)], dtype=np.uint64)


def _blobs(cut: np.ndarray, keys: np.ndarray, counts: np.ndarray) -> pa.RecordBatch:
    rows = [(s, a, b) for s, (a, b) in enumerate(zip(cut[:-1], cut[1:], strict=True)) if b > a]
    return pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows], pa.int32()), pa.array([_planes(np.diff(keys[a:b], prepend=U(0))) for _, a, b in rows], pa.binary()), pa.array([_planes(counts[a:b]) for _, a, b in rows], pa.binary())], ["shard", "keys", "counts"])


def _merged(table: pa.Table) -> tuple[int, np.ndarray, np.ndarray]:
    keys = np.concatenate([np.cumsum(_unplanes(b.as_py()), dtype=np.uint64) for b in table.column("keys")])
    counts = np.concatenate([_unplanes(b.as_py()) for b in table.column("counts")]).astype(np.int64)
    order = np.argsort(keys, kind="stable")
    keys, counts = keys[order], counts[order]
    first = np.flatnonzero(np.concatenate(([True], keys[1:] != keys[:-1])))
    return table.column("shard")[0].as_py(), keys[first], np.add.reduceat(counts, first)


def _gathered(batches, keys_of, cuts) -> Iterator[pa.RecordBatch]:
    """Sends the counts of the keys of each FLUSH tokens."""
    held, total = [], 0
    for batch in larger(batches):
        data, off = buffers(batch.column("text"))
        for i, j in slices(np.diff(off), GATHER):
            part = token_hashes(data, off[i : j + 1])
            held.append(keys_of(*part))
            total += len(held[-1])
            if total >= FLUSH:
                yield _blobs(*cuts(*np.unique(np.concatenate(held), return_counts=True)))
                held, total = [], 0
    if held:
        yield _blobs(*cuts(*np.unique(np.concatenate(held), return_counts=True)))


class Model:
    def __init__(self, words: Vocabulary, shards: int, full: frozenset[int]) -> None:
        self.words, self.shards, self.full = words, shards, full
        self.open: dict[int, tuple] = {}

    def base(self, counts: np.ndarray) -> np.ndarray:
        """Probabilities of the additive unigram model."""
        return (counts + ADD) / (self.words.total + ADD * (self.words.size + 1))

    def shard_of(self, pairs: np.ndarray) -> np.ndarray:
        return (mix(pairs) % U(self.shards)).astype(np.int64)

    def level(self, s: int) -> tuple[EliasFano, EliasFano, EliasFano, np.ndarray]:
        def make():
            a = load(self.words.folder, f"pairs-{s:06d}")
            return *(EliasFano.of(a, k) for k in ("contexts", "pointers", "successors")), a["weight"]

        return shelved(self.open, s, make)

    def weights(self, pairs: np.ndarray) -> np.ndarray:
        """L c(hw) / c(h), dequantised, of distinct pairs (context << 32 | word); 0 where the pair is unseen."""
        out = np.zeros(len(pairs))
        shard = self.shard_of(pairs)
        order = np.argsort(shard, kind="stable")
        for s, a, b in runs(shard[order]):
            if s not in self.full:
                continue
            contexts, pointers, successors, weight = self.level(s)
            at = order[a:b]
            rank = contexts.find(pairs[at] >> U(32))
            at, rank = at[rank >= 0], rank[rank >= 0]
            own = successors.find(rank.astype(np.uint64) * U(self.universe) + (pairs[at] & U(0xFFFFFFFF)), *(pointers.get(r).astype(np.int64) for r in (rank, rank + 1)))
            out[at[own >= 0]] = dequantise(weight[own[own >= 0]])
        return out

    @property
    def universe(self) -> int:
        return self.words.size + 1


def quantise(p: np.ndarray) -> np.ndarray:
    return np.clip(np.rint(-np.log10(p) * 255 / DECADES), 0, 255).astype(np.uint8)


def dequantise(q: np.ndarray) -> np.ndarray:
    return 10.0 ** (-q.astype(float) * DECADES / 255)


def pair_keys(words_: Vocabulary, hashes: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    """context << 32 | word for each token; the context of a text's first token is the vocabulary's size."""
    uniq, back = np.unique(hashes, return_inverse=True)
    ids = words_.find(uniq)[0][back]
    before = np.empty_like(ids)
    before[1:] = ids[:-1]
    before[bounds[:-1]] = words_.size
    ok = (ids >= 0) & (before >= 0)
    return np.where(ok, before << 32 | ids, -1).view(np.uint64)


def fit(docs: DataFrame) -> Model:
    """From all documents of docs (text)."""
    spark = docs.sparkSession
    folder = new_path(spark, "trie")
    if "://" not in folder:
        folder = "file://" + folder.removeprefix("file:")
    size = docs.agg(F.sum(F.length("text")).alias("n")).first()["n"] or 0
    shards = max(12, 1 + size // (6 * SHARD))  # some six characters a token
    starts = range_starts(shards)

    def count(batches):
        yield from _gathered(batches, lambda h, b: h, lambda k, n: (np.append(np.searchsorted(k, starts), len(k)), k, n))

    def write_words(table: pa.Table) -> pa.Table:
        s, keys, counts = _merged(table)
        width = (1 << 64) // shards + 1
        sequence = EliasFano.build(keys - starts[s], width)
        save(folder, f"words-{s:06d}", {f"hash.{k}": a for k, a in sequence.parts().items()} | {"count": counts})
        return pa.table({"shard": [s], "size": [len(keys)], "total": [int(counts.sum())]}, schema=pa.schema([("shard", pa.int32()), ("size", pa.int64()), ("total", pa.int64())]))

    kind = "shard int, keys binary, counts binary"
    manifest = "shard int, size long, total long"
    got = docs.mapInArrow(count, kind).groupBy("shard").applyInArrow(write_words, manifest).collect()
    vocabulary = Vocabulary(folder, shards, {r["shard"]: r["size"] for r in got}, sum(r["total"] for r in got))
    model = Model(vocabulary, shards, frozenset())

    def pairs(batches):
        def cuts(keys, counts):
            shard = model.shard_of(keys)
            order = np.argsort(shard, kind="stable")
            return np.searchsorted(shard[order], np.arange(shards + 1)), keys[order], counts[order]

        yield from _gathered(batches, lambda h, b: pair_keys(vocabulary, h, b), cuts)

    def write_pairs(table: pa.Table) -> pa.Table:
        s, keys, counts = _merged(table)
        context = keys >> U(32)
        own, first = np.unique(context, return_index=True)
        # the start of a text has as many successors as there are texts, which is the count of END
        heads = np.where(own < vocabulary.size, own, 0).astype(np.int64)
        of = vocabulary.counts(heads[: np.searchsorted(own, vocabulary.size)])
        if len(of) < len(own):
            of = np.append(of, vocabulary.find(np.array([END]))[1])
        rank = np.repeat(np.arange(len(own)), np.diff(np.append(first, len(keys))))
        universe = vocabulary.size + 1
        levels = {
            "contexts": EliasFano.build(own, universe + 1),
            "pointers": EliasFano.build(np.append(first, len(keys)).astype(np.uint64), len(keys) + 1),
            "successors": EliasFano.build(rank.astype(np.uint64) * U(universe) + (keys & U(0xFFFFFFFF)), len(own) * universe),
        }
        save(folder, f"pairs-{s:06d}", {f"{k}.{p}": a for k, e in levels.items() for p, a in e.parts().items()} | {"weight": quantise(WEIGHT * counts / of[rank])})
        return pa.table({"shard": [s], "size": [len(keys)], "total": [int(counts.sum())]}, schema=pa.schema([("shard", pa.int32()), ("size", pa.int64()), ("total", pa.int64())]))

    got = docs.mapInArrow(pairs, kind).groupBy("shard").applyInArrow(write_pairs, manifest).collect()
    return Model(vocabulary, shards, frozenset(r["shard"] for r in got))


def score(model: Model, data: np.ndarray, off: np.ndarray) -> list[np.ndarray]:
    """n_tokens, n_known, base_score, score of each text."""
    hashes, bounds = token_hashes(data, off)
    uniq, back = np.unique(hashes, return_inverse=True)
    ids, counts = model.words.find(uniq)
    counts, known = counts[back], (counts > 0)[back]
    base = model.base(counts)
    ids = ids[back]
    before = np.empty_like(ids)
    before[1:] = ids[:-1]
    before[bounds[:-1]] = model.words.size
    seen = before >= 0
    if not model.words.total:
        seen[:] = False
    pair = np.flatnonzero(seen & known)
    weight = np.zeros(len(hashes))
    if len(pair):
        distinct, to = np.unique((before[pair] << 32 | ids[pair]).view(np.uint64), return_inverse=True)
        weight[pair] = model.weights(distinct)[to]
    full = np.where(seen, weight + (1 - WEIGHT) * base, base)
    sums = lambda x: np.add.reduceat(x, bounds[:-1]) if len(bounds) > 1 else np.zeros(0)
    return [np.diff(bounds), sums(known.astype(np.int64)), sums(np.log10(base)), sums(np.log10(full))]


def score_documents(docs: DataFrame) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score; one row per row of docs.

    Learns from the rows whose crc32(doc_id as text) mod 10 is not 0. Null text is empty, and every text has the end
    token. Rows without doc_id have a null held_out and train the model. Without training rows both scores are those
    of the additive model over nothing.
    """
    small_batches(docs.sparkSession)
    held = F.pmod(F.crc32(F.col("doc_id").cast("string").cast("binary")), F.lit(10)) == 0
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"), held.alias("held_out"))
    model = fit(docs.where(F.coalesce(~F.col("held_out"), F.lit(True))).select("text"))
    shared = docs.sparkSession.sparkContext.broadcast((model.words.folder, model.words.shards, model.words.sizes, model.words.total, model.shards, model.full))

    def run(batches):
        folder, shards, sizes, total, more, full = shared.value
        model = Model(Vocabulary(folder, shards, sizes, total), more, full)
        for batch in larger(batches):
            data, off = buffers(batch.column("text"))
            for i, j in slices(np.diff(off), GATHER):
                n, known, base, whole = score(model, data, off[i : j + 1])
                yield pa.RecordBatch.from_arrays([batch.column("doc_id").slice(i, j - i), batch.column("held_out").slice(i, j - i), pa.array(n, pa.int64()), pa.array(known, pa.int64()), pa.array(np.full(j - i, total), pa.int64()), pa.array(base), pa.array(whole)], ["doc_id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score"])

    return docs.mapInArrow(run, "doc_id long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double")
