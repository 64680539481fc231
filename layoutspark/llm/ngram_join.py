"""N-gram Jaccard join by token-combination prefixes.

Two documents link when the Jaccard similarity of their sets of word 5-shingles is at least 0.8. Only connected
components of that relation leave the operator, so exact copies are one node from the start and pairs inside a
component that is already known are never compared.

Index. All shingles have one order: rare ones by hash, then the frequent ones (those in at least FREQUENT documents,
counted over the whole corpus) by frequency. A set of n shingles can miss at most t = n - ceil(0.8 n) shingles of a
partner. Its prefix is extended until  #rare + sum over groups of max(0, m - k + 1)  exceeds t, where a group is one
hash part of one frequency class, m its shingles in the prefix and k = 2 (frequent) or 3 (very frequent). If two sets
share no rare prefix shingle and no k of a group, one of them lacks more than t of the other's shingles; so indexing
rare shingles alone and the k-combinations of frequent ones loses no link. The number of parts follows the set's size
(by powers of two, and a set is indexed under both sizes its partners can have), which keeps combinations linear in
the prefix.

Verification goes in two rounds. First every member of a posting list is compared with the list's hub (the member with
the fewest unshared shingles before the match); links give components. Then only pairs of a list that lie in different
components, and whose positions still allow the overlap, are compared: short lists send their pairs, longer ones their
members, and a pair counts at the first list that it shares and only if the sketches of both leave it open. All final
comparisons are exact on the whole sets.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .components import components
from .store import documents, fresh, materialize
from .tokens import U, buffers, mix, shingles, slices, words

WIDTH = 5
#: Similarity as a ratio of integers.
NUM, DEN = 80, 100
#: Documents that hold a shingle: from here on pairs are indexed, from FREQUENT * 64 triples.
FREQUENT = 16
#: Shingles that a task gathers before it sends their counts: with the runs' copies, some 25 MB of a Python worker.
FLUSH = 1 << 18
#: Bound on the broadcast table of frequent shingles; beyond it FREQUENT doubles until the table fits.
MOST_FREQUENT = 1 << 20
#: Bound on a Bloom filter's bits (32 MB); a semi-join takes its place for more ids.
MOST_BITS = 1 << 28


def _sets(batch: pa.RecordBatch) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """For runs of rows: first row, shingle hashes, bounds."""
    ids, texts = batch.column("doc_id"), batch.column("text")
    data, off = buffers(texts)
    for i, j in slices(np.diff(off)):
        hashes, bounds, _, _ = words(data, off[i : j + 1])
        yield (ids.slice(i, j - i), *shingles(hashes, bounds, WIDTH))


def fingerprints(docs: DataFrame) -> DataFrame:
    """doc_id, n (distinct shingles), f1, f2: equal sets have equal 128-bit sums of mixed hashes."""

    def run(batches):
        for batch in batches:
            for ids, h, bounds in _sets(batch):
                sets = [np.unique(h[a:b]) for a, b in zip(bounds[:-1], bounds[1:], strict=True)]
                f1 = np.array([mix(s ^ U(0x1F83D9ABFB41BD6B)).sum(dtype=np.uint64) for s in sets], dtype=np.uint64)
                f2 = np.array([mix(s + U(0x5BE0CD19137E2179)).sum(dtype=np.uint64) for s in sets], dtype=np.uint64)
                yield pa.RecordBatch.from_arrays([ids, pa.array([len(s) for s in sets], pa.int64()), pa.array(f1.view(np.int64)), pa.array(f2.view(np.int64))], ["doc_id", "n", "f1", "f2"])

    return docs.mapInArrow(run, "doc_id long, n long, f1 long, f2 long")


def _planes(x: np.ndarray) -> bytes:
    """Little-endian 64-bit numbers by byte plane: planes of zeros vanish when the shuffle compresses."""
    return np.ascontiguousarray(x.astype("<u8").view(np.uint8).reshape(-1, 8).T).tobytes()


def _unplanes(b: bytes) -> np.ndarray:
    return np.ascontiguousarray(np.frombuffer(b, np.uint8).reshape(8, -1).T).view("<u8").ravel()


def frequent_shingles(docs: DataFrame, shards: int) -> DataFrame:
    """token (the upper 40 bits of the hash), df: over all documents, where df >= FREQUENT.

    A task sends sorted, delta-coded runs of what it counted to the shards, contiguous ranges of the 40 bits; a shard
    merges its runs. shards follows the corpus, so a shard stays small.
    """

    def count(batches):
        held, total = [], 0

        def flush():
            nonlocal held, total
            if held:
                tokens, n = np.unique(np.concatenate(held), return_counts=True)
                cut = np.searchsorted(tokens, (np.arange(shards + 1, dtype=np.uint64) << U(40)) // U(shards))
                held, total = [], 0
                rows = [(s, a, b) for s, (a, b) in enumerate(zip(cut[:-1], cut[1:], strict=True)) if b > a]
                yield pa.RecordBatch.from_arrays([pa.array([s for s, _, _ in rows], pa.int32()), pa.array([_planes(np.diff(tokens[a:b], prepend=U(0))) for _, a, b in rows], pa.binary()), pa.array([_planes(n[a:b]) for _, a, b in rows], pa.binary())], ["shard", "tokens", "counts"])

        for batch in batches:
            for _, h, bounds in _sets(batch):
                # a document counts once for each of its shingles
                held.extend(np.unique(h[a:b]) >> U(24) for a, b in zip(bounds[:-1], bounds[1:], strict=True))
                total += len(h)
                if total >= FLUSH:
                    yield from flush()
        yield from flush()

    def merge(table: pa.Table) -> pa.Table:
        tokens = np.concatenate([np.cumsum(_unplanes(b.as_py()), dtype=np.uint64) for b in table.column("tokens")])
        counts = np.concatenate([_unplanes(b.as_py()) for b in table.column("counts")])
        order = np.argsort(tokens, kind="stable")
        tokens, counts = tokens[order], counts[order]
        first = np.flatnonzero(np.concatenate(([True], tokens[1:] != tokens[:-1])))
        df = np.add.reduceat(counts, first)
        keep = df >= FREQUENT
        return pa.table({"token": tokens[first][keep].astype(np.int64), "df": df[keep].astype(np.int64)})

    return docs.mapInArrow(count, "shard int, tokens binary, counts binary").groupBy("shard").applyInArrow(merge, "token long, df long")


def _table(frequent: DataFrame) -> tuple[np.ndarray, np.ndarray, int]:
    """The frequent shingles (sorted) and their df, at most MOST_FREQUENT; and the least df among them."""
    least = FREQUENT
    sizes = {int(r["k"]): r["n"] for r in frequent.groupBy(F.floor(F.log2("df")).alias("k")).agg(F.count(F.lit(1)).alias("n")).collect()}
    while sum(n for k, n in sizes.items() if 2**k >= least) > MOST_FREQUENT:
        least *= 2
    got = frequent.where(F.col("df") >= least).toPandas().sort_values("token")
    return got["token"].to_numpy(np.uint64), got["df"].to_numpy(np.int64), least


def _bloom(ids: DataFrame, n: int) -> tuple[int, np.ndarray] | None:
    """A one-hash Bloom filter of the ids (column id), 8 bits an id; None beyond MOST_BITS."""
    bits = 1 << max(18, (8 * n).bit_length())
    if bits > MOST_BITS:
        return None
    spot = F.pmod(F.xxhash64("id"), F.lit(bits)) + 1
    rows = ids.select(spot.alias("spot")).groupBy(F.bitmap_bucket_number("spot").alias("bucket")).agg(F.bitmap_construct_agg(F.bitmap_bit_position("spot")).alias("bits")).toPandas()
    out = np.zeros(bits // 8, dtype=np.uint8)
    for bucket, piece in zip(rows["bucket"], rows["bits"], strict=True):
        at = (int(bucket) - 1) * 4096
        piece = np.frombuffer(piece, np.uint8)[: len(out) - at]
        out[at : at + len(piece)] = piece
    return bits, out


def _some(docs: DataFrame, ids: DataFrame, n: int) -> tuple[DataFrame, Callable[[pa.RecordBatch], pa.RecordBatch]]:
    """The documents whose doc_id is among ids (column id), before any shuffle: rows, and a filter for their batches.

    The filter is a Bloom filter and runs in the task that uses the texts. A few others may stay, which is harmless to
    every caller.
    """
    bloom = _bloom(ids, n)
    if bloom is None:
        return docs.join(ids.withColumnRenamed("id", "doc_id"), "doc_id", "left_semi"), lambda batch: batch
    bits, table = bloom
    shared = docs.sparkSession.sparkContext.broadcast(table)

    def keep(batch: pa.RecordBatch) -> pa.RecordBatch:
        table, spot = shared.value, batch.column("spot").to_numpy(zero_copy_only=False)
        return batch.filter(pa.array((table[spot >> 3] >> (spot & 7).astype(np.uint8)) & 1 == 1))

    return docs.where(F.col("doc_id").isNotNull()).withColumn("spot", F.pmod(F.xxhash64("doc_id"), F.lit(bits))), keep


def signatures(hashes: np.ndarray, is_frequent: np.ndarray, df: np.ndarray, least: int) -> tuple[list[int], list[int]]:
    """Signatures of one set (sorted distinct hashes) and, for each, the largest overlap a match on it allows."""
    n = len(hashes)
    need = n - -(-NUM * n // DEN) + 1
    rare = hashes[~is_frequent][:need]
    sig, eff = (rare).tolist(), [n - i for i in range(len(rare))]
    if len(rare) >= need:
        return sig, eff
    h, f = hashes[is_frequent], df[is_frequent]
    order = np.lexsort((h, f))
    h, f = h[order].tolist(), f[order].tolist()
    top = n - len(rare)
    for level in sorted({n.bit_length(), (n * DEN // NUM).bit_length()}):
        parts = max(1, (1 << level >> 1) // 20)
        groups: dict[tuple[int, int], list[int]] = {}
        have = len(rare)
        for token, freq in zip(h, f, strict=True):
            if have >= need:
                break
            k = 3 if freq >= least * 64 else 2
            group = groups.setdefault((k, (token >> 8) % parts), [])
            group.append(token)
            have += len(group) >= k
        # without a pair in common, no more than one shingle of each part of the pairs' class is shared
        apart = sum(max(0, len(g) - 1) for (k, _), g in groups.items() if k == 2)
        for (k, _), group in groups.items():
            if len(group) >= k:
                combos = np.array(list(combinations(group, k)), dtype=np.uint64)
                key = np.full(len(combos), level * 8 + k, dtype=np.uint64)
                for c in range(k):
                    key = mix(key * U(0x9E3779B97F4A7C15) + combos[:, c])
                sig += key.tolist()
                eff += [top if k == 2 else top - apart] * len(combos)
    return sig, eff


def index(docs: DataFrame, keep: Callable, table: np.ndarray, df: np.ndarray, least: int) -> DataFrame:
    """sig, id, size, eff: the postings of every set with at least 4 shingles (below that only equal sets link)."""
    shared = docs.sparkSession.sparkContext.broadcast((table, df))

    def run(batches):
        table, freq = shared.value
        for batch in batches:
            for ids, h, bounds in _sets(keep(batch)):
                cols: tuple[list, list, list, list] = ([], [], [], [])
                short = h >> U(24)
                at = np.minimum(np.searchsorted(table, short), max(0, len(table) - 1))
                found = table[at] == short if len(table) else np.zeros(len(h), bool)
                dfs = np.where(found, freq[at], 0) if len(table) else np.zeros(len(h), np.int64)
                for doc, a, b in zip(ids.to_pylist(), bounds[:-1], bounds[1:], strict=True):
                    if doc is None or b - a < 4:
                        continue
                    s, where = np.unique(h[a:b], return_index=True)
                    if len(s) < 4:
                        continue
                    sig, eff = signatures(s, found[a:b][where], dfs[a:b][where], least)
                    for col, x in zip(cols, (sig, [doc] * len(sig), [len(s)] * len(sig), eff), strict=True):
                        col += x
                yield pa.RecordBatch.from_arrays([pa.array(np.array(cols[0], np.uint64).view(np.int64)), pa.array(cols[1], pa.int64()), pa.array(cols[2], pa.int32()), pa.array(cols[3], pa.int32())], ["sig", "id", "size", "eff"])

    return docs.mapInArrow(run, "sig long, id long, size int, eff int")


def _fits(size_a, eff_a, size_b, eff_b):
    """Can the overlap reach what the similarity asks for?"""
    return np.minimum(eff_a, eff_b) * np.int64(NUM + DEN) >= NUM * (np.int64(1) * size_a + size_b)


def _columns(batch: pa.RecordBatch | pa.Table) -> list[np.ndarray]:
    return [c.to_numpy() if isinstance(c, pa.ChunkedArray) else c.to_numpy(zero_copy_only=False) for c in batch.columns]


def hub_pairs(postings: DataFrame) -> DataFrame:
    """Postings of lists with more than one member, each with its list's hub and whether the two can link."""
    kind = "sig long, id long, size int, eff int, hub long, fits boolean"

    def run(batches):
        hub = None
        for batch in batches:
            if not batch.num_rows:
                continue
            sig, ids, size, eff = _columns(batch)
            if hub is not None:
                sig, ids, size, eff = (np.concatenate(([x], y)) for x, y in zip(hub[:4], (sig, ids, size, eff), strict=True))
            first = np.concatenate(([True], sig[1:] != sig[:-1]))
            starts = np.flatnonzero(first)
            at = starts[np.cumsum(first) - 1]
            many = ~first
            many[starts] = np.append(~first[1:], False)[starts]  # the hub itself, once a second member is seen
            if hub is not None and hub[4]:
                many[0] = False  # sent before
            fits = _fits(size[at], eff[at], size, eff) & (ids != ids[at])
            last = starts[-1]
            hub = (sig[last], ids[last], size[last], eff[last], bool(len(sig) - last > 1) or (last == 0 and hub is not None and hub[4]))
            yield pa.RecordBatch.from_arrays([pa.array(x[many]) for x in (sig, ids, size, eff, ids[at], fits)], ["sig", "id", "size", "eff", "hub", "fits"])

    return postings.repartition("sig").sortWithinPartitions("sig", F.col("eff").desc(), "size", "id").mapInArrow(run, kind)


#: Members up to which a list sends its pairs; a longer one sends its members.
SHORT = 16
#: Members of a list, or of a block of it, that meet in one task.
BLOCK = 2048
#: Members compared with a whole block at once.
ROWS = 64
#: Pairs of short lists that a task gathers, to send each once.
GATHER = 1 << 16
#: Earlier signatures that a member of a longer list brings along.
EARLIER = 16


def _whole_lists(batches, keys: int = 1):
    """The columns of sorted batches, in runs that end where the first keys columns change; a run's end is a list's end."""
    held: list[pa.RecordBatch] = []
    for batch in batches:
        if not batch.num_rows:
            continue
        key = np.stack([c.to_numpy(zero_copy_only=False) for c in batch.columns[:keys]])
        starts = np.flatnonzero((key[:, 1:] != key[:, :-1]).any(axis=0)) + 1
        if held and any(held[-1].column(k)[-1] != batch.column(k)[0] for k in range(keys)):
            starts = np.insert(starts, 0, 0)
        if len(starts):
            yield pa.Table.from_batches([*held, batch.slice(0, int(starts[-1]))]).combine_chunks()
            held, batch = [], batch.slice(int(starts[-1]))
        held.append(batch)
    if held:
        yield pa.Table.from_batches(held).combine_chunks()


def _distinct(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    order = np.lexsort((b, a))
    a, b = a[order], b[order]
    first = np.ones(len(a), dtype=bool)
    first[1:] = (a[1:] != a[:-1]) | (b[1:] != b[:-1])
    return a[first], b[first]


def _may_meet(sig: np.ndarray, size: np.ndarray, eff: np.ndarray, comp: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Pairs (i, j) of rows of one list (rows are sorted by list) in different components that can still link."""
    i = np.arange(len(sig))
    for step in range(1, len(sig)):
        i = i[: np.searchsorted(i, len(sig) - step)]
        i = i[sig[i] == sig[i + step]]
        if not len(i):
            return
        j = i + step
        ok = (comp[i] != comp[j]) & _fits(size[i], eff[i], size[j], eff[j])
        yield i[ok], j[ok]


def short_lists(lists: DataFrame) -> DataFrame:
    """Of sorted lists: the pairs of the short ones (sig null), and the members that may link of the longer ones (b null).

    Rows are proportional to the members. A list beyond BLOCK is passed on as it comes, so no list is held whole.
    """
    names = ["sig", "a", "b", "size", "eff", "component", "m"]

    def sent(held: list[tuple[np.ndarray, np.ndarray]]) -> pa.RecordBatch:
        a, b = _distinct(*(np.concatenate(x) for x in zip(*held, strict=True)))
        empty = [pa.nulls(len(a), t) for t in (pa.int64(), pa.int32(), pa.int32(), pa.int64(), pa.int64())]
        return pa.RecordBatch.from_arrays([empty[0], pa.array(a), pa.array(b), *empty[1:]], names)

    def run(batches):
        held, total = [], 0
        for table in _whole_lists(batches):
            sig, ids, size, eff, comp, m = _columns(table)
            at = np.flatnonzero(m <= SHORT)
            for i, j in _may_meet(sig[at], size[at], eff[at], comp[at]):
                a, b = ids[at[i]], ids[at[j]]
                held.append((np.minimum(a, b), np.maximum(a, b)))
                total += len(i)
            if total > GATHER:
                yield sent(held)
                held, total = [], 0
            meets = m > BLOCK
            at = np.flatnonzero((m > SHORT) & ~meets)
            for i, j in _may_meet(sig[at], size[at], eff[at], comp[at]):
                meets[at[i]] = meets[at[j]] = True
            if meets.any():
                yield pa.RecordBatch.from_arrays([pa.array(sig[meets]), pa.array(ids[meets]), pa.nulls(int(meets.sum()), pa.int64()), *(pa.array(x[meets]) for x in (size, eff, comp, m))], names)
        if held:
            yield sent(held)

    return lists.mapInArrow(run, "sig long, a long, b long, size int, eff int, component long, m long")


def long_lists(members: DataFrame, sets: DataFrame) -> DataFrame:
    """Pairs (a, b) of members (sig, id, size, eff, component, m) of longer lists that nothing but whole sets can rule out.

    A pair meets at each signature that it shares. Only the first one counts (there its position allows the overlap of
    any pair that links), so each member brings along the EARLIER first of its signatures before this one, and a pair
    with one of them in common is left to that list. Lists beyond BLOCK members are cut into blocks by a hash of the id,
    and blocks meet two by two in a task of their own.
    """
    own = members.groupBy("id").agg(F.first("size").alias("size"), F.first("component").alias("component"), F.sort_array(F.collect_list(F.struct((-F.col("eff")).alias("order"), "sig", "m"))).alias("own"))
    own = own.join(sets.select("id", "sketch").distinct(), "id")
    each = own.select("id", "size", "component", "sketch", "own", F.posexplode("own").alias("place", "x"))
    each = each.select(F.col("x.sig").alias("sig"), "id", "size", (-F.col("x.order")).alias("eff"), "component", "sketch", F.slice(F.col("own.sig"), F.lit(1), F.least("place", F.lit(EARLIER))).alias("before"), F.ceil(F.col("x.m") / BLOCK).cast("int").alias("blocks"))
    block = F.pmod(F.xxhash64("id"), "blocks").cast("int")
    dealt = each.withColumn("block", block).withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    dealt = dealt.select("sig", F.least("block", "other").alias("p"), F.greatest("block", "other").alias("q"), "block", "id", "size", "eff", "component", "sketch", "before")

    def run(batches):
        for table in _whole_lists(batches, 3):
            key = np.stack([table.column(k).to_numpy() for k in range(3)])
            cut = np.flatnonzero((key[:, 1:] != key[:, :-1]).any(axis=0)) + 1
            for a, b in zip([0, *cut], [*cut, table.num_rows], strict=True):
                for i, j in _open_pairs(table.slice(a, b - a)):
                    yield pa.RecordBatch.from_arrays([pa.array(i), pa.array(j)], ["a", "b"])

    return dealt.repartition("sig", "p", "q").sortWithinPartitions("sig", "p", "q", "component", "id").mapInArrow(run, "a long, b long")


def _open_pairs(table: pa.Table) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Of one list, or two blocks of one (p, q): pairs that meet here first and that their sketches leave open."""
    n = table.num_rows
    p, q = table.column("p")[0].as_py(), table.column("q")[0].as_py()
    block, ids, size, eff, comp = (table.column(k).to_numpy() for k in ("block", "id", "size", "eff", "component"))
    sketch = np.frombuffer(b"".join(table.column("sketch").to_pylist()), np.uint8).reshape(n, -1).view(np.uint64)
    before = table.column("before").combine_chunks()
    of, values = np.repeat(np.arange(n), before.value_lengths().to_numpy()), before.flatten().to_numpy()
    names, code, times = np.unique(values, return_inverse=True, return_counts=True)
    # only signatures that two rows have matter
    rank = np.cumsum(times > 1) - 1
    of, code = of[times[code] > 1], rank[code[times[code] > 1]]
    bits = np.zeros((n, -(-int((times > 1).sum()) // 64)), dtype=np.uint64)
    np.bitwise_or.at(bits, (of, code >> 6), U(1) << (code & 63).astype(np.uint64))
    only = lambda x, y: np.bitwise_count(x & ~y).sum(axis=1, dtype=np.int64)
    for first in range(0, n, ROWS):
        last = min(n, first + ROWS)
        ok = np.triu((comp[first:last, None] != comp[None, first:]) & _fits(size[first:last, None], eff[first:last, None], size[None, first:], eff[None, first:]), 1)
        if p != q:
            ok &= block[first:last, None] != block[None, first:]
        i, j = np.nonzero(ok)
        for at in range(0, len(i), ROWS * BLOCK // 8):
            x, y = i[at : at + ROWS * BLOCK // 8] + first, j[at : at + ROWS * BLOCK // 8] + first
            new = ~(bits[x] & bits[y]).any(axis=1)
            x, y = x[new], y[new]
            new = _fits(size[x], size[x] - only(sketch[x], sketch[y]), size[y], size[y] - only(sketch[y], sketch[x]))
            if new.any():
                yield np.minimum(ids[x[new]], ids[y[new]]), np.maximum(ids[x[new]], ids[y[new]])


def cross_pairs(near: DataFrame, sets: DataFrame) -> DataFrame:
    """Pairs (a, b) of postings of one list that lie in different components and can still link."""
    whole = Window.partitionBy("sig").orderBy("component", "id").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    lists = near.select("sig", "id", "size", "eff", "component", F.count(F.lit(1)).over(whole).alias("m"), F.first("component").over(whole).alias("least"), F.last("component").over(whole).alias("most"))
    some = materialize(short_lists(lists.where("least <> most").drop("least", "most")), "across")
    members = some.where("sig is not null").select("sig", F.col("a").alias("id"), "size", "eff", "component", "m")
    return some.where("sig is null").select("a", "b").union(long_lists(members, sets))


#: Bits of a set's sketch.
SKETCH = 1024


def set_table(docs: DataFrame, ids: DataFrame) -> DataFrame:
    """id, size, sketch, set of the documents whose doc_id is among ids, written once.

    A set is its sorted hashes, cut to 48 bits: two sets of a thousand shingles then agree by chance in one of 10**8
    pairs. The sketch has the bits that its hashes name.
    """

    def run(batches):
        for batch in batches:
            for ids, h, bounds in _sets(keep(batch)):
                sets = [np.unique(h[a:b] >> U(16)) for a, b in zip(bounds[:-1], bounds[1:], strict=True)]
                bits = []
                for s in sets:
                    spots = np.zeros(SKETCH, dtype=np.uint8)
                    spots[(s % U(SKETCH)).astype(np.int64)] = 1
                    bits.append(np.packbits(spots).tobytes())
                packed = [s.astype("<u8").view(np.uint8).reshape(-1, 8)[:, :6].tobytes() for s in sets]
                yield pa.RecordBatch.from_arrays([ids, pa.array(list(map(len, sets)), pa.int32()), pa.array(bits, pa.binary()), pa.array(packed, pa.binary())], ["id", "size", "sketch", "set"])

    ids = materialize(ids.distinct(), "ids")
    some, keep = _some(docs, ids, ids.count())
    return materialize(some.mapInArrow(run, "id long, size int, sketch binary, set binary"), "sets")


def _unpacked(b: bytes) -> np.ndarray:
    out = np.zeros((len(b) // 6, 8), dtype=np.uint8)
    out[:, :6] = np.frombuffer(b, np.uint8).reshape(-1, 6)
    return out.view("<u8").ravel()


def verified(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """The pairs (a, b) whose whole shingle sets reach the similarity.

    Bits that only one sketch has are shingles that only one set has, so the sketches alone rule out most pairs that
    are far apart, without loss; only the others bring their sets together.
    """

    def able(batches):
        for batch in batches:
            n = batch.num_rows
            size_a, size_b = (batch.column(k).to_numpy() for k in ("size_a", "size_b"))
            x, y = (np.frombuffer(b"".join(batch.column(k).to_pylist()), np.uint8).reshape(n, -1) for k in ("sketch_a", "sketch_b"))
            only = lambda p, q: np.bitwise_count(p & ~q).sum(axis=1, dtype=np.int64)
            yield batch.select(["a", "b"]).filter(pa.array(_fits(size_a, size_a - only(x, y), size_b, size_b - only(y, x))))

    def check(batches):
        for batch in batches:
            keep = []
            for x, y in zip(batch.column("set_a").to_pylist(), batch.column("set_b").to_pylist(), strict=True):
                x, y = _unpacked(x), _unpacked(y)
                common = len(np.intersect1d(x, y, assume_unique=True))
                keep.append(DEN * common >= NUM * (len(x) + len(y) - common))
            yield batch.select(["a", "b"]).filter(pa.array(keep, pa.bool_()))

    def beside(pairs: DataFrame, columns: list[str]) -> DataFrame:
        for k in ("b", "a"):
            ids = pairs.select(F.col(k).alias("id")).distinct()
            pairs = pairs.join(sets.select("id", *columns).join(ids, "id", "left_semi").select(F.col("id").alias(k), *(F.col(c).alias(f"{c}_{k}") for c in columns)), k)
        return pairs.select("a", "b", *(f"{c}_{k}" for c in columns for k in "ab"))

    pairs = materialize(pairs.distinct(), "pairs")
    near = materialize(beside(pairs, ["size", "sketch"]).mapInArrow(able, "a long, b long").distinct(), "near")
    return materialize(beside(near, ["set"]).mapInArrow(check, "a long, b long").distinct(), "links")


def ngram_jaccard_join(docs: DataFrame) -> DataFrame:
    """doc_id, n_shingles, class_id (smallest doc_id with the same set), component_id (smallest reachable doc_id).

    One row per row of docs; other columns are ignored. Null or wordless text: no shingles, linked with nothing, both
    ids are doc_id. A text under five words is one shingle. Equal rows are one class; a repeated doc_id is one node.
    A null doc_id takes part in nothing and keeps null ids unless another row has the same set.
    """
    docs = documents(docs)
    prints = materialize(fingerprints(docs), "prints")
    classes = materialize(prints.where("n > 0").groupBy("n", "f1", "f2").agg(F.min("doc_id").alias("class_id"), F.count(F.lit(1)).alias("copies")), "classes")
    total = classes.agg(F.count(F.lit(1)).alias("n"), F.sum("n").alias("shingles")).first()
    shards = 1 + int(total["shingles"] or 0) // (1 << 20)
    table, df, least = _table(materialize(frequent_shingles(docs, max(12, shards)), "frequent"))
    firsts, keep = _some(docs, classes.where("n > 3 and class_id is not null").select(F.col("class_id").alias("id")), total["n"])
    postings = materialize(hub_pairs(index(firsts, keep, table, df, least)), "postings")
    sets = set_table(docs, postings.select("id").union(postings.select("hub")))
    links = verified(postings.where("fits").select(F.least("id", "hub").alias("a"), F.greatest("id", "hub").alias("b")), sets)
    label = components(links)
    near = postings.select("sig", "id", "size", "eff").join(label, "id", "left").select("sig", "id", "size", "eff", F.coalesce("component", "id").alias("component"))
    more = verified(cross_pairs(near, sets), sets)
    if more.limit(1).count():
        label = components(links.union(more))
    named = classes.join(label, classes.class_id == label.id, "left").select("n", "f1", "f2", "copies", "class_id", F.coalesce("component", "class_id").alias("component_id"))
    # most classes are one document without links, and name nothing; wordless texts have no class, and a key of their own
    named = named.where("copies > 1 or component_id <> class_id").drop("copies")
    key = F.when(F.col("n") > 0, F.col("f1")).otherwise(F.xxhash64("doc_id"))
    out = prints.withColumn("f1", key).join(named, ["n", "f1", "f2"], "left")
    return out.select("doc_id", F.col("n").alias("n_shingles"), F.coalesce("class_id", "doc_id").alias("class_id"), F.coalesce("component_id", "doc_id").alias("component_id"))


def keep_first(docs: DataFrame) -> DataFrame:
    """The rows of docs (all columns) whose doc_id is the smallest of its component; rows without doc_id stay.

    Null and wordless texts are linked with nothing and stay. Repeated rows of the smallest doc_id all stay, as they are
    one document. docs may have any other columns, of any name. An empty table stays empty.
    Only documents that may be among the removed ones (by a Bloom filter) go through a join; the others stay as they are.
    """
    out = materialize(ngram_jaccard_join(docs), "groups")
    gone = out.where("component_id <> doc_id").select(F.col("doc_id").alias("id")).distinct()
    bloom = _bloom(gone, gone.count())
    extra = fresh(docs, "gone")
    gone = gone.withColumnRenamed("id", extra)
    if bloom is None:
        return docs.join(gone, docs["doc_id"].cast("long") == F.col(extra), "left_anti")
    bits, table = bloom
    shared, names = docs.sparkSession.sparkContext.broadcast(table), docs.columns

    def marked(wanted: bool) -> DataFrame:
        def run(batches):
            table = shared.value
            for batch in batches:
                spot = batch.column(batch.num_columns - 1).fill_null(0).to_numpy(zero_copy_only=False)
                hit = (table[spot >> 3] >> (spot & 7).astype(np.uint8)) & 1 == 1
                yield pa.RecordBatch.from_arrays(batch.filter(pa.array(hit == wanted)).columns[:-1], names)

        return docs.withColumn(fresh(docs, "spot"), F.pmod(F.xxhash64(F.col("doc_id").cast("long")), F.lit(bits))).mapInArrow(run, docs.schema)

    maybe = marked(True)
    return marked(False).union(maybe.join(gone, maybe["doc_id"].cast("long") == F.col(extra), "left_anti"))
