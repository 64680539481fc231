"""Secret scans by a linear-chain conditional random field.

Tokens (runs of letters, digits and +/_.-) of a line form a sequence with the tags outside, begin and inside. Features
are the token's own shape (length, character classes, hex or mixed alphabets, runs), whether it or a neighbour is one
of the words that stand near secrets, and the kind of file (share of tokens with digits, presence of assignments).
The field is trained here on windows around the spans of the base patterns and on other windows, from at most
TRAIN_DOCS documents with and TRAIN_DOCS without such spans. So that it learns what a secret looks like and not what
the patterns match, most windows are used again with their secret redrawn from another alphabet and their keyword
changed or left out, and windows without a secret get one, or a decoy of like shape (dates, versions, paths, names),
at a random place; no feature names a secret's text. So the field carries over to secrets that no pattern knows. Tags are decoded by Viterbi. A line in which no token can outweigh the
all-outside path, transitions included, needs no decoding: its best path is known.
"""

from __future__ import annotations

import ast
import hashlib
import random
import re
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .store import documents, materialize, small_batches

#: Fixed patterns of the base spans, in the order in which equal starts are listed.
BASE = (
    ("assign", re.compile(r"""(?ai:(password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""), 2, 6),
    ("access", re.compile(r"AKIA[A-Z0-9]+"), 0, 20),
    ("hex", re.compile(r"[0-9a-f]{24,}"), 0, 24),
)
KINDS = ("assign", "access", "hex", "crf")
#: Bounds of the training sample: documents of each sort, tokens on each side of a window's centre, windows of a document.
TRAIN_DOCS, AROUND, WINDOWS = 1000, 16, 4
#: Alphabets and lengths of redrawn secrets; what decoys are put together from.
ALPHABETS = ("0123456789abcdef", "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567", "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789", "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/", "abcdefghijklmnopqrstuvwxyz0123456789", "abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789_-")
SHORTEST, LONGEST = 16, 64
DECOYS = ("{n}-{n}-{n}", "{n}.{n}.{n}", "{w}_{w}_{w}", "{w}/{w}/{w}.{w}", "{w}{n}.{w}.{w}", "{n}{n}{n}{n}", "{w}{w}{w}{w}", "v{n}.{n}", "{w}-{w}-{n}", "{W}{W}{W}", "{w}{n}", "{n}{w}")
#: Words that stand near secrets, as a fixed list.
KEYWORDS = frozenset("password passwd pwd secret token key apikey api_key api access auth authorization bearer credential credentials private client id".split())
WEIGHTS = 1 << 12
TOKEN = re.compile(r"\n|[\w+/.\-]*\w")


def base_spans(text: str) -> list[tuple[int, int, str]]:
    """(start, end, kind), by start and then kind as listed; places are code points."""
    out = []
    for order, (kind, pattern, group, least) in enumerate(BASE):
        out += [(m.start(), order, m.end(), kind) for m in pattern.finditer(text) if m.end(group) - m.start(group) >= least]
    return [(s, e, k) for s, _, e, k in sorted(out)]


def shape(token: str) -> tuple:
    """What the field sees of a token; a secret's own letters are not in it."""
    n = len(token)
    size = n if n < 4 else 4 + min(8, (n - 4) // 4)
    low = token.lower()
    if low in KEYWORDS:
        return ("word", low)
    if token.isalpha():
        return ("alpha", size, token.isupper(), token.islower() or token.istitle(), token.isascii())
    digits = sum(c.isdigit() for c in token)
    if digits == n:
        return ("digits", size)
    letters = [c for c in token if c.isalpha()]
    turns = sum(a.isdigit() != b.isdigit() for a, b in zip(token, token[1:], strict=False))
    return (
        "mixed", size, min(9, 10 * digits // n), all(c in "0123456789abcdef" for c in low), token.isascii(),
        any(c.isupper() for c in letters) and any(c.islower() for c in letters), token.isupper(), min(6, turns // 2), sum(c in "+/_.-" for c in token) * 4 // n,
    )


def _hash(*parts) -> int:
    return 1 + zlib.crc32(repr(parts).encode()) % (WEIGHTS - 1)


def features(s: tuple) -> tuple[list[int], list[int], list[int]]:
    """Weights of a token's shape: of its own tag, and of the tags before and after it."""
    pairs = [(k, v) for k, v in enumerate(s[1:])]
    own = [_hash("own", s), _hash("kind", s[0]), *(_hash("part", s[0], *p) for p in pairs), _hash("size and look", s[:4])]
    near = [_hash(s[0], s[1] if s[0] == "word" else "")]
    return own, [_hash("before", x) for x in near], [_hash("after", x) for x in near]


def has_digits(s: tuple) -> bool:
    return s[0] == "digits" or s[0] == "mixed" and s[2] > 0


def file_kind(text: str, share: float) -> tuple:
    """share: of all tokens of the text, those with digits."""
    return (min(4, int(share * 16)), "=" in text or ": " in text, '"' in text or "'" in text)


class Field:
    """Weights by hashed feature and tag, and transitions. Tags: 0 outside, 1 begin, 2 inside."""

    def __init__(self, weights: np.ndarray, moves: np.ndarray) -> None:
        self.weights, self.moves = weights, moves
        self.shapes: dict[tuple, int] = {}
        self.tokens: dict[str, int] = {}
        self.rows: list[np.ndarray] = []
        self.digits: list[bool] = []
        self.table = np.zeros((0, 3, 3))
        self.id_of(("line",))  # id 0: a line's edge
        # the most that leaving the all-outside path can gain by transitions
        free = moves - moves[0, 0]
        self.gain = max(0.0, float(free[0, 1:].max())) + max(0.0, float(free[1:, 0].max())) + max(0.0, float(free[1:, 1:].max()))

    def id_of(self, s: tuple) -> int:
        found = self.shapes.get(s)
        if found is None:
            found = self.shapes[s] = len(self.rows)
            self.digits.append(has_digits(s))
            own, before, after = features(s)
            # emissions that it adds to itself, to the token after it, and to the token before it
            self.rows.append(np.stack([self.weights[x].sum(axis=0) for x in (own, before, after)]))
        return found

    def ids(self, tokens: list[str]) -> np.ndarray:
        get, out = self.tokens.get, []
        for t in tokens:
            i = get(t)
            if i is None:
                i = 0 if t == "\n" else self.id_of(shape(t))
                if len(self.tokens) > 200_000:
                    self.tokens.clear()
                self.tokens[t] = i
            out.append(i)
        if len(self.table) < len(self.rows):
            self.table, self.digit = np.stack(self.rows), np.array(self.digits)
        return np.array([0, *out, 0], dtype=np.int64)

    def emissions(self, ids: np.ndarray, kind: tuple) -> np.ndarray:
        """By token; ids with an edge at either end."""
        t = self.table
        return t[ids[1:-1], 0] + t[ids[:-2], 1] + t[ids[2:], 2] + self.weights[_hash("file", *kind)]

    def viterbi(self, e: np.ndarray) -> list[int]:
        score, back = e[0] + self.moves[0], []
        for row in e[1:]:
            step = score[:, None] + self.moves
            best = step.argmax(axis=0)
            back.append(best)
            score = step[best, (0, 1, 2)] + row
        tag = int(score.argmax())
        tags = [tag]
        for best in reversed(back):
            tag = int(best[tag])
            tags.append(tag)
        return tags[::-1]

    def spans(self, text: str) -> list[tuple[int, int, str]]:
        tokens = TOKEN.findall(text)
        if not tokens:
            return []
        ids = self.ids(tokens)
        e = self.emissions(ids, file_kind(text, self.digit[ids[1:-1]].mean()))
        able = (e[:, 1:].max(axis=1) - e[:, 0] + self.gain > 0) & (ids[1:-1] != 0)
        if not able.any():
            return []
        edges = np.concatenate(([-1], np.flatnonzero(ids[1:-1] == 0), [len(tokens)]))
        lines = np.unique(np.searchsorted(edges, np.flatnonzero(able), "left"))
        places, out = None, []
        for k in lines:
            a, b = int(edges[k - 1]) + 1, int(edges[k])
            tags = self.viterbi(e[a:b])
            if any(tags):
                places = places or [m.span() for m in TOKEN.finditer(text)]
                for i, tag in enumerate(tags):
                    start, end = places[a + i]
                    if tag == 1 or tag == 2 and (i == 0 or tags[i - 1] == 0):
                        out.append([start, end])
                    elif tag == 2:
                        out[-1][1] = end
        return [(s, e, "crf") for s, e in out]


def train(windows: list[tuple[list[str], list[int], tuple]], rounds: int = 6, batch: int = 256, penalty: float = 1e-4) -> Field:
    """Maximum likelihood by Adam over shuffled batches; windows: (tokens, tags, file kind)."""
    weights, moves = np.zeros((WEIGHTS, 3)), np.zeros((3, 3))
    if not windows:
        return Field(weights, moves)
    width = 16
    edge = features(("line",))
    known: dict[str, tuple] = {"\n": edge}

    def look(token: str) -> tuple:
        if token not in known:
            known[token] = features(shape(token))
        return known[token]

    length = max(len(w[0]) for w in windows)
    x = np.zeros((len(windows), length, width), dtype=np.int32)
    y = np.zeros((len(windows), length), dtype=np.int64)
    real = np.zeros((len(windows), length), dtype=bool)
    for i, (tokens, tags, kind) in enumerate(windows):
        each = [edge, *map(look, tokens), edge]
        for j, tag in enumerate(tags):
            row = [*each[j + 1][0], *each[j][1], *each[j + 2][2], _hash("file", *kind)][-width:]
            x[i, j, : len(row)] = row
            y[i, j], real[i, j] = tag, True
    params, first, second, step = np.zeros(WEIGHTS * 3 + 9), 0.0, 0.0, 0
    order = np.random.default_rng(7)
    for _ in range(rounds):
        turn = order.permutation(len(windows))
        for at in range(0, len(turn), batch):
            pick = turn[at : at + batch]
            step += 1
            g = _gradient(params, x[pick], y[pick], real[pick]) / len(pick) + penalty * params
            first, second = 0.9 * first + 0.1 * g, 0.99 * second + 0.01 * g * g
            params = params - 0.1 * (first / (1 - 0.9**step)) / (np.sqrt(second / (1 - 0.99**step)) + 1e-8)
    return Field(params[:-9].reshape(WEIGHTS, 3).copy(), params[-9:].reshape(3, 3).copy())


def _gradient(params: np.ndarray, x: np.ndarray, y: np.ndarray, real: np.ndarray) -> np.ndarray:
    """Of the negative log likelihood of a batch, by forward and backward sums; moves[0] also starts a window."""
    weights, moves = params[:-9].reshape(WEIGHTS, 3), params[-9:].reshape(3, 3)
    n, length, width = x.shape
    e = weights[x].sum(axis=2)
    alpha, beta = np.zeros((length, n, 3)), np.zeros((length, n, 3))
    alpha[0] = e[:, 0] + moves[0]
    for j in range(1, length):
        new = np.logaddexp.reduce(alpha[j - 1][:, :, None] + moves, axis=1) + e[:, j]
        alpha[j] = np.where(real[:, j, None], new, alpha[j - 1])
    total = np.logaddexp.reduce(alpha[-1], axis=1)
    for j in range(length - 2, -1, -1):
        new = np.logaddexp.reduce(moves[None] + (e[:, j + 1] + beta[j + 1])[:, None, :], axis=2)
        beta[j] = np.where(real[:, j + 1, None], new, 0)
    marginal = np.exp(alpha.transpose(1, 0, 2) + beta.transpose(1, 0, 2) - total[:, None, None]) * real[:, :, None]
    marginal[np.arange(n)[:, None], np.arange(length)[None], y] -= real
    grad = np.stack([np.bincount(x.ravel(), np.repeat(marginal[:, :, k].ravel(), width), WEIGHTS) for k in range(3)], axis=1)
    grad[0] = 0
    turns = np.zeros((3, 3))
    turns[0] += marginal[:, 0].sum(axis=0)
    for j in range(1, length):
        live = np.flatnonzero(real[:, j])
        pair = np.exp(alpha[j - 1][live][:, :, None] + moves + (e[live, j] + beta[j][live])[:, None, :] - total[live][:, None, None]).sum(axis=0)
        np.add.at(pair, (y[live, j - 1], y[live, j]), -1)
        turns += pair
    return np.concatenate((grad.ravel(), turns.ravel()))


def _windows(text: str, seed: int) -> list[tuple[list[str], list[int], tuple]]:
    """Around the first base spans, or at hashed places of a text without any."""
    places = [(m.group(), *m.span()) for m in TOKEN.finditer(text)]
    if not places:
        return []
    kind = file_kind(text, sum(p[0] != "\n" and has_digits(shape(p[0])) for p in places) / len(places))
    tags = [0] * len(places)
    starts = np.array([p[1] for p in places])
    for _, pattern, group, least in BASE:
        for m in pattern.finditer(text):
            a, b = m.span(group)
            if b - a >= least:
                i = int(np.searchsorted(starts, a, "right")) - 1
                i = max(0, i if places[i][2] > a else i + 1)
                j = i
                while j < len(places) and places[j][1] < b and places[j][0] != "\n":
                    tags[j] = 1 if j == i else 2
                    j += 1
    centres = [i for i, t in enumerate(tags) if t == 1][:WINDOWS] or [seed * (k + 7) % len(places) for k in range(4)]
    return [([p[0] for p in places[max(0, c - AROUND) : c + AROUND]], tags[max(0, c - AROUND) : c + AROUND], kind) for c in centres]


def redrawn(windows: list[tuple[list[str], list[int], tuple]], seed: int = 5) -> list[tuple[list[str], list[int], tuple]]:
    """One more window for each: with its secrets and keywords changed, or with a secret or a decoy put in."""
    rng = random.Random(seed)
    keywords = sorted(KEYWORDS)
    pick = lambda low, high: "".join(rng.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(rng.randint(low, high)))

    def secret() -> list[str]:
        letters = rng.choice(ALPHABETS)
        body = "".join(rng.choice(letters) for _ in range(rng.randint(SHORTEST, LONGEST)))
        return TOKEN.findall(rng.choice(("", "", "", pick(2, 4) + "_", pick(2, 3) + "-")) + body)

    def decoy() -> list[str]:
        made = rng.choice(DECOYS)
        while "{" in made:
            made = made.replace("{n}", str(rng.randrange(10 ** rng.randint(1, 5))), 1).replace("{w}", pick(2, 9), 1).replace("{W}", pick(2, 9).title(), 1)
        return TOKEN.findall(made)

    out = []
    for tokens, tags, kind in windows:
        new: list[tuple[str, int]] = []
        if any(tags):
            for i, (token, tag) in enumerate(zip(tokens, tags, strict=True)):
                if tag == 1:
                    new += [(t, 1 + (k > 0)) for k, t in enumerate(secret())]
                elif tag == 0 and token.lower() in KEYWORDS and 1 in tags[i : i + 4]:
                    new += [(rng.choice(keywords), 0)] if rng.random() < 0.7 else []
                elif tag == 0:
                    new.append((token, 0))
        else:
            at = rng.randrange(len(tokens) + 1)
            new = [(t, 0) for t in tokens[:at]]
            if rng.random() < 0.4:
                new += [(rng.choice(keywords), 0)] * (rng.random() < 0.7) + [(t, 1 + (k > 0)) for k, t in enumerate(secret())]
            else:
                new += [(rng.choice(keywords), 0)] * (rng.random() < 0.2) + [(t, 0) for t in decoy()]
            new += [(t, 0) for t in tokens[at:]]
        if new:
            out.append(([t for t, _ in new], [tag for _, tag in new], kind))
    return out


def fit(docs: DataFrame) -> Field:
    """Trains on the documents with the smallest hashes of doc_id among those with and those without base spans; a
    repeated doc_id gives no more windows than a single one."""
    docs = documents(docs)

    def hits(batches):
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array([bool(x) and any(p.search(x) for _, p, _, _ in BASE) for x in batch.column("text").to_pylist()])], ["doc_id", "hit"])

    marked = materialize(docs.where("doc_id is not null").mapInArrow(hits, "doc_id long, hit boolean").withColumn("h", F.xxhash64("doc_id")), "hits")
    ids = [r["doc_id"] for hit in (True, False) for r in marked.where(F.col("hit") == hit).orderBy("h", "doc_id").limit(TRAIN_DOCS).collect()]
    if not ids:
        return train([])
    chosen = docs.sparkSession.sparkContext.broadcast(set(ids))

    def cut(batches):
        for batch in batches:
            ids = batch.column("doc_id").to_pylist()
            at = [i for i, d in enumerate(ids) if d in chosen.value]
            got = [(ids[i], k, w) for i, x in zip(at, batch.column("text").take(pa.array(at, pa.int64())).to_pylist(), strict=True) for k, w in enumerate(_windows(x or "", abs(ids[i]) + 1))]
            if got:
                yield pa.RecordBatch.from_arrays([pa.array([d for d, _, _ in got], pa.int64()), pa.array([k for _, k, _ in got], pa.int32()), pa.array([w[0] for _, _, w in got], pa.list_(pa.string())), pa.array([w[1] for _, _, w in got], pa.list_(pa.int32())), pa.array([repr(w[2]) for _, _, w in got])], ["doc_id", "k", "tokens", "tags", "kind"])

    found = docs.mapInArrow(cut, "doc_id long, k int, tokens array<string>, tags array<int>, kind string")
    rows = found.groupBy("doc_id", "k").agg(F.min(F.struct("tokens", "tags", "kind")).alias("w")).select("doc_id", "k", "w.*").collect()
    rows.sort(key=lambda r: (r["doc_id"], r["k"]))
    windows = [(r["tokens"], r["tags"], ast.literal_eval(r["kind"])) for r in rows]
    return train(windows + redrawn(windows))


def all_spans(field: Field, text: str) -> tuple[list[tuple[int, int, str]], list[tuple[int, int, str]]]:
    """(base spans, all spans in order)."""
    base = base_spans(text)
    both = base + field.spans(text)
    return base, sorted(both, key=lambda s: (s[0], KINDS.index(s[2])))


def _joined(spans: list[tuple[int, int, str]]) -> str:
    return ",".join(f"{k}:{s}:{e}" for s, e, k in spans)


def secret_spans(docs: DataFrame, field: Field | None = None) -> DataFrame:
    """doc_id, n_assign, n_access, n_hex, base_sha256, spans; one row per row of docs.

    spans lists the base spans and those of the field (kind crf, which may cover a base span again) as kind:start:end.
    Null text is empty; a text without spans has the digest of an empty string. A null doc_id is scanned like any other.
    """
    field = field or fit(docs)
    docs = documents(docs)
    shared = docs.sparkSession.sparkContext.broadcast((field.weights, field.moves))

    def run(batches):
        field = Field(*shared.value)
        for batch in batches:
            rows = [all_spans(field, x or "") for x in batch.column("text").to_pylist()]
            count = lambda kind: pa.array([sum(k == kind for _, _, k in b) for b, _ in rows], pa.int64())
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), count("assign"), count("access"), count("hex"), pa.array([hashlib.sha256(_joined(b).encode()).hexdigest() for b, _ in rows], pa.string()), pa.array([_joined(s) for _, s in rows], pa.string())],
                ["doc_id", "n_assign", "n_access", "n_hex", "base_sha256", "spans"],
            )

    return docs.mapInArrow(run, "doc_id long, n_assign long, n_access long, n_hex long, base_sha256 string, spans string")


def redact(docs: DataFrame, mark: str = "[secret]", field: Field | None = None) -> DataFrame:
    """The rows of docs (all columns, of any name) with every span of text replaced by mark; n_chars, if there, follows the
    new text. Overlapping spans are one replacement. Null and empty texts stay as they are, repeated rows are treated
    alike, a null doc_id like any other; an empty table stays empty."""
    small_batches(docs.sparkSession)
    field = field or fit(docs)
    shared = docs.sparkSession.sparkContext.broadcast((field.weights, field.moves))
    at = docs.columns.index("text")

    def clean(field: Field, text: str | None) -> str | None:
        if not text:
            return text
        out, last = [], 0
        for s, e, _ in all_spans(field, text)[1]:
            if s >= last:
                out += [text[last:s], mark]
            last = max(last, e)
        return "".join([*out, text[last:]]) if out else text

    def run(batches):
        field = Field(*shared.value)
        for batch in batches:
            texts = [clean(field, x) for x in batch.column(at).to_pylist()]
            yield batch.set_column(at, batch.schema.field(at), pa.array(texts, batch.schema.field(at).type))

    out = docs.mapInArrow(run, docs.schema)
    if "n_chars" in docs.columns:
        out = out.withColumn("n_chars", F.when(F.col("text").isNull(), F.col("n_chars")).otherwise(F.length("text")).cast(docs.schema["n_chars"].dataType))
    return out.select(docs.columns)
