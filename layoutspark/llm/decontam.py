"""Benchmark decontamination: CGK embedding, bit-sampling LSH over item-sized windows, exact edit verification.

The CGK random walk copies the word it stands on and moves on or stays by a random bit of that word, so a few edits
change the output in few places: edit distance becomes Hamming distance. Walks start at every word of a document; an
item's walk is compared with them by BANDS samples of ROWS steps for each of WALKS random walks. Steps are sampled
below 1.5 times the least item size of a size class, which a walk rarely leaves. At 20 % edits this finds about 95 %
of single windows (see tests), and shifted windows of the same passage give further chances.

A walk sees the first three quarters of the least size of its class only, so an item is embedded in segments: from
2 * SEGMENT words on it is cut into runs of SEGMENT to 1.5 * SEGMENT words, of which one at least has no more than its
share of the edits, wherever they lie; a shorter item is embedded from its start and, if it is well above the least size
of its class, its end is embedded as well.

Positions that cannot start a match are left out first, without loss: m words within k edits of a segment of m words hold
at least m - 2k words of the benchmark's vocabulary. Candidates are verified exactly: the least edit distance (words
inserted, deleted, replaced) of the item to any run of words near the window, by bit-parallel dynamic programming.
"""

from __future__ import annotations

from collections import defaultdict

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .store import documents, small_batches
from .tokens import U, buffers, mix, slices, words

#: Word edits allowed, as a share of the item's words.
EDITS = 0.2
WALKS, BANDS, ROWS = 3, 8, 3
#: Items, and bytes of their texts, in one pass: bounds what is broadcast. More are taken in blocks.
BLOCK, BLOCK_BYTES = 20_000, 16 << 20
#: Least words of a segment of a long item. A segment, and a walk, is shorter than _PAD.
SEGMENT = 32
_PAD = 2 * SEGMENT


def best_run(pattern: list[int], text: list[int]) -> tuple[int, int]:
    """(least edit distance of the pattern to a run of text, end of the leftmost such run), by Myers' bit vectors."""
    m = len(pattern)
    where: dict[int, int] = defaultdict(int)
    for i, w in enumerate(pattern):
        where[w] |= 1 << i
    full, top = (1 << m) - 1, 1 << (m - 1)
    up, down, score, best, end = full, 0, m, m, 0
    for j, w in enumerate(text, 1):
        eq = where.get(w, 0)
        x = (((eq & up) + up) ^ up) | eq | down
        plus, minus = down | (~(x | up) & full), up & x
        if plus & top:
            score += 1
        elif minus & top:
            score -= 1
        plus, minus = plus << 1 & full, minus << 1 & full
        y = eq | down
        up, down = minus | (~(y | plus) & full), plus & y
        if score < best:
            best, end = score, j
    return best, end


def segments(m: int) -> list[tuple[int, int]]:
    """(first word, end) of the parts of an item of m words that are embedded; the parts cover the item from
    2 * SEGMENT words on."""
    if m >= 2 * SEGMENT:
        n = m // SEGMENT
        return [(m * i // n, m * (i + 1) // n) for i in range(n)]
    least = 1 << (m.bit_length() - 1)
    return [(0, m), (m - least, m)] if least >= 8 and m > least + least // 4 else [(0, m)]


class Items:
    """The benchmark's items as word hashes, with the LSH tables."""

    def __init__(self, ids: list, texts: pa.Array) -> None:
        data, off = buffers(texts)
        hashes, bounds, _, _ = words(data, off)
        self.ids, self.words = ids, [hashes[a:b] for a, b in zip(bounds[:-1], bounds[1:], strict=True)]
        self.edits = [int(EDITS * len(w)) for w in self.words]
        vocabulary = np.unique(hashes)
        self.vocabulary = vocabulary
        self.spots = np.zeros(1 << 20, dtype=bool)
        self.spots[(vocabulary >> U(44)).astype(np.int64)] = True
        #: (item, first word, end) of what is embedded.
        self.parts = [(i, a, b) for i, w in enumerate(self.words) if len(w) for a, b in segments(len(w))]
        self.classes: list[tuple[list[int], int, list]] = []
        for level in sorted({(b - a).bit_length() for _, a, b in self.parts}):
            members = [p for p, (_, a, b) in enumerate(self.parts) if (b - a).bit_length() == level]
            least = 1 << (level - 1)
            steps = max(1, least + least // 2)
            rng = np.random.default_rng(level)
            samples = [[np.sort(rng.choice(steps, min(ROWS, steps), replace=False)) for _ in range(BANDS)] for _ in range(WALKS)]
            # a walk may go on into the item's next segment
            runs = [self.words[i][a : a + _PAD] for i, a, _ in (self.parts[p] for p in members)]
            padded = np.concatenate([x for run in runs for x in (run, np.zeros(_PAD, np.uint64))])
            starts = np.cumsum([0] + [len(run) + _PAD for run in runs])[:-1]
            tables = []
            for r in range(WALKS):
                for sig in bands(padded, coins(padded, r), starts, r, steps, samples[r]):
                    order = np.argsort(sig, kind="stable")
                    spot = np.zeros(1 << 16, dtype=bool)
                    spot[(sig >> U(48)).astype(np.int64)] = True
                    tables.append((sig[order], np.array(members)[order], spot))
            self.classes.append((sorted({b - a for _, a, b in (self.parts[p] for p in members)}), steps, [samples, tables]))


def coins(hashes: np.ndarray, walk: int) -> np.ndarray:
    """64 random bits of each word, for each step of a walk; a padding zero never moves on."""
    return np.where(hashes == 0, U(0), mix(hashes ^ U((walk + 1) * 0x9E3779B97F4A7C15 % (1 << 64)))).view(np.int64)


def bands(hashes: np.ndarray, moves: np.ndarray, starts: np.ndarray, walk: int, steps: int, samples: list[np.ndarray]) -> list[np.ndarray]:
    """A signature for each start and band: the walk's words at the sampled steps. hashes: texts, padded with zeros."""
    wanted = {int(j) for s in samples for j in s}
    seen, at = {}, starts.copy()
    bit = np.empty_like(at)
    for j in range(steps):
        if j in wanted:
            seen[j] = hashes[at]
        np.take(moves, at, out=bit)
        bit >>= j
        bit &= 1
        at += bit
    out = []
    for b, s in enumerate(samples):
        sig = np.full(len(starts), walk * BANDS + b + 1, dtype=np.uint64)
        for j in s:
            sig = mix(sig * U(0xD6E8FEB86659FD93) + seen[int(j)])
        out.append(sig)
    return out


def candidates(items: Items, hashes: np.ndarray, bounds: np.ndarray) -> set[tuple[int, int, int]]:
    """(text, part, first word) of windows that share a band with a part of an item."""
    n = np.diff(bounds)
    if not len(hashes) or not items.parts:
        return set()
    doc = np.repeat(np.arange(len(n)), n)
    padded = np.zeros(len(hashes) + _PAD * len(n), dtype=np.uint64)
    to = np.arange(len(hashes)) + _PAD * doc
    padded[to] = hashes
    # words of the vocabulary before each place of the padded texts
    sums = np.zeros(len(padded) + 1, dtype=np.int32)
    np.cumsum(items.spots[(padded >> U(44)).view(np.int64)] & (padded != 0), out=sums[1:])
    moves = [coins(padded, r) for r in range(WALKS)]
    found: set[tuple[int, int, int]] = set()
    for sizes, steps, (samples, tables) in items.classes:
        ok = np.zeros(len(padded), dtype=bool)
        for m in sizes:
            ok[: len(padded) - m + 1] |= sums[m:] - sums[: len(sums) - m] >= max(1, m - 2 * int(EDITS * m))
        ok &= padded != 0
        starts = np.flatnonzero(ok)
        for i in range(0, len(starts), 1 << 15):
            part = starts[i : i + (1 << 15)]
            for r in range(WALKS):
                for b, sig in enumerate(bands(padded, moves[r], part, r, steps, samples[r])):
                    sigs, members, spot = tables[r * BANDS + b]
                    hit = np.flatnonzero(spot[(sig >> U(48)).view(np.int64)])
                    if not len(hit):
                        continue
                    lo, hi = np.searchsorted(sigs, sig[hit], "left"), np.searchsorted(sigs, sig[hit], "right")
                    for h, a, c in zip(part[hit[hi > lo]], lo[hi > lo], hi[hi > lo], strict=True):
                        word = int(np.searchsorted(to, h))
                        found.update((int(doc[word]), int(members[x]), word - int(bounds[doc[word]])) for x in range(a, c))
    return found


def leaks(items: Items, hashes: np.ndarray, bounds: np.ndarray) -> list[tuple[int, int, int, int, int]]:
    """(text, item, distance, first word, last word): the best match of each item within its edits."""
    regions: dict[tuple[int, int], list[list[int]]] = {}
    near = []
    for doc, part, at in candidates(items, hashes, bounds):
        item, first, end = items.parts[part]
        m, k, drift = len(items.words[item]), items.edits[item], (end - first) // 2
        near.append((doc, item, at - first - drift - k, at - first + m + k + (drift if end - first < m else 0)))
    for doc, item, lo, hi in sorted(near):
        own = regions.setdefault((doc, item), [])
        if own and lo <= own[-1][1]:
            own[-1][1] = max(own[-1][1], hi)
        else:
            own.append([lo, hi])
    out = []
    for (doc, item), spans in regions.items():
        pattern = items.words[item].tolist()
        best = None
        for lo, hi in spans:
            lo, hi = max(0, lo), min(int(bounds[doc + 1] - bounds[doc]), hi)
            text = hashes[bounds[doc] + lo : bounds[doc] + hi].tolist()
            # within k edits all but k of the item's words stay, so most candidates need no alignment
            if sum(map(set(text).__contains__, pattern)) < len(pattern) - items.edits[item]:
                continue
            distance, end = best_run(pattern, text)
            if distance <= items.edits[item] and (best is None or distance < best[0]):
                _, length = best_run(pattern[::-1], text[:end][::-1])
                best = distance, lo + end - length, lo + end - 1
        if best:
            out.append((doc, item, *best))
    return out


def _blocks(benchmark: DataFrame) -> list[tuple[list, pa.Array]]:
    """The items in blocks of about BLOCK items or BLOCK_BYTES, whichever is less; one block at a time is on the driver."""
    items = benchmark.where("item_id is not null and text is not null").select(F.col("item_id").cast("long").alias("item_id"), F.col("text").cast("string").alias("text"))
    size = items.agg(F.count(F.lit(1)).alias("n"), F.sum(F.octet_length("text")).alias("bytes")).first()
    blocks = max(-(-size["n"] // BLOCK), -(-(size["bytes"] or 0) // BLOCK_BYTES))
    for k in range(blocks):
        got = items.where(F.pmod(F.xxhash64("item_id", "text"), F.lit(blocks)) == k).orderBy("item_id").toArrow()
        yield got.column("item_id").to_pylist(), got.column("text")


def find_leaks(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """doc_id, item_id, distance, first_word, last_word: every document and item of which some run of words of the
    document is within EDITS of the item; the best run of each pair.

    Words are `[^\\x20\\x09-\\x0D]+` with A-Z lowered, of whole texts. Null, empty or wordless texts and items match
    nothing; repeated rows of either table give repeated results. An item under 5 words has to occur exactly.
    """
    docs = documents(docs)
    out = None
    for ids, texts in _blocks(benchmark):
        shared = docs.sparkSession.sparkContext.broadcast(Items(ids, texts))

        def run(batches, shared=shared):
            items = shared.value
            for batch in batches:
                data, off = buffers(batch.column("text"))
                for i, j in slices(np.diff(off)):
                    hashes, bounds, _, _ = words(data, off[i : j + 1])
                    got = leaks(items, hashes, bounds)
                    if got:
                        doc, item, distance, first, last = zip(*got, strict=True)
                        yield pa.RecordBatch.from_arrays([pc.take(batch.column("doc_id"), pa.array([i + d for d in doc])), pa.array([items.ids[x] for x in item], pa.int64()), pa.array(distance, pa.int32()), pa.array(first, pa.int64()), pa.array(last, pa.int64())], ["doc_id", "item_id", "distance", "first_word", "last_word"])

        part = docs.mapInArrow(run, "doc_id long, item_id long, distance int, first_word long, last_word long")
        out = part if out is None else out.union(part)
    if out is None:
        return docs.sparkSession.createDataFrame([], "doc_id long, item_id long, distance int, first_word long, last_word long")
    return out


def without_leaks(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """The rows of docs (all columns, of any name) in which no item is found; nothing is shuffled.

    Null, empty and wordless texts hold no item and stay; repeated rows are judged alike; an empty table stays empty.
    """
    small_batches(docs.sparkSession)
    for ids, texts in _blocks(benchmark):
        shared = docs.sparkSession.sparkContext.broadcast(Items(ids, texts))

        def run(batches, shared=shared):
            items = shared.value
            for batch in batches:
                data, off = buffers(batch.column(batch.schema.get_field_index("text")))
                keep = np.ones(batch.num_rows, dtype=bool)
                for i, j in slices(np.diff(off)):
                    hashes, bounds, _, _ = words(data, off[i : j + 1])
                    keep[[i + x[0] for x in leaks(items, hashes, bounds)]] = False
                yield batch.filter(pa.array(keep))

        docs = docs.mapInArrow(run, docs.schema)
    return docs
