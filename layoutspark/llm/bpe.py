"""BPE encoding and decoding with a tokenization automaton.

The automaton accepts exactly the token sequences that byte-pair merging can produce. It starts as one state with an
arc for each base symbol, and takes the merges in order; the gadget for (a, b) -> ab turns  q -a-> s -b-> t  into an arc
q -ab-> t  and sends the a-arcs to a copy of s without b. All arcs of one label a lead to one state, and each copy lacks
one arc more than the state before, so the states that a-arcs have led to are a sequence by time: a's first state is the
one that its right part led to when a was made. A state is therefore a pair (label, time), and the table of transitions
is CUT[a, b] = the merge that took arc b from a's state. Arc b stands in (a, time) unless CUT[a, b] < time, and else it
stands there if it stands in the state below it (a's right part) or if its own origin (b's left part) does, whichever
of a and b is younger: a few table lookups for an arc, and the automaton takes a few integers for each merge.

A pre-split word is encoded by one pass over its positions: each prefix of a word has one token sequence, so each
position is reached by one state at most, and a trie of the labels gives the arcs to try. Decoding emits arc labels.
"""

from __future__ import annotations

import functools
import hashlib
import json
import unicodedata
from array import array
from collections.abc import Callable, Iterator, Sequence
from dataclasses import dataclass, field

import pyarrow as pa
import regex
from pyspark.sql import DataFrame

from .store import documents

END = "</w>"
#: Words that a task remembers with their encodings (two generations of so many), and the longest of them.
MOST_WORDS, LONGEST_WORD = 200_000, 64
#: Pairs of neighbouring arcs that a task remembers as allowed or not.
MOST_PAIRS = 1 << 18


def byte_symbols() -> list[str]:
    """The printable stand-in of each byte, as byte-level BPE vocabularies use it."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    others = [b for b in range(256) if b not in plain]
    table = {b: chr(b) for b in plain} | {b: chr(256 + k) for k, b in enumerate(others)}
    return [table[b] for b in range(256)]


@dataclass
class Automaton:
    """Tables over tokens: parts and merge number (0: base symbol, -1: its merge never applies), and the arcs cut."""

    labels: dict[int, str]
    base: list[int]  # token of symbol s at s, of its word-final form at 256 + s
    left: list[int]
    right: list[int]
    made: list[int]
    cut: dict[int, int] = field(default_factory=dict)  # a << 20 | b -> merge
    trie: dict = field(default_factory=dict)  # symbol -> [token or None, the same of what follows]
    pairs: dict[int, bool] = field(default_factory=dict)  # a << 20 | b -> allows(a, b), once all merges are in

    def allows(self, a: int, b: int) -> bool:
        """Does the state that a's arcs lead to have an arc b?"""
        made, cut = self.made, self.cut
        if made[b] < 0:
            return False
        time = len(made) + 1
        while True:
            if cut.get(a << 20 | b, time) < time:
                return False
            if made[a] > made[b]:
                time = made[a]
                a = self.right[a]
            elif made[b]:
                time = min(time, made[b] + 1)  # the merge that made b took its right part from what b starts with
                b = self.left[b]
            else:
                return True

    def remember(self, a: int, b: int) -> bool:
        """allows(a, b), kept for the next word; few pairs make up most words."""
        if len(self.pairs) >= MOST_PAIRS:
            self.pairs.clear()
        out = self.pairs[a << 20 | b] = self.allows(a, b)
        return out

    def matches(self, symbols: list[int], i: int) -> list[tuple[int, int]]:
        """(end, token) of the labels that stand at i, shortest first."""
        follow, out, end = self.trie, [], i
        for s in symbols[i:]:
            node = follow.get(s)
            if node is None:
                break
            end += 1
            token, follow = node
            if token is not None:
                out.append((end, token))
        return out

    def encode(self, symbols: list[int]) -> list[int]:
        """The tokens of one word, given as symbols of which the last is word-final.

        Tries the longest arc first. A position from which no arc goes on is off the word's only path and not tried again.
        """
        n, i, last = len(symbols), 0, -1
        pairs, matches = self.pairs, self.matches
        stack: list[tuple[int, int, list[tuple[int, int]]]] = []
        out: list[int] = []
        dead: set[int] = set()
        todo = matches(symbols, 0)
        while True:
            while todo:
                j, token = todo.pop()
                if j in dead:
                    continue
                if last < 0:
                    break
                ok = pairs.get(last << 20 | token)
                if ok is None:
                    ok = self.remember(last, token)
                if ok:
                    break
            else:
                dead.add(i)
                i, last, todo = stack.pop()
                out.pop()
                continue
            out.append(token)
            if j == n:
                return out
            stack.append((i, last, todo))
            i, last = j, token
            todo = matches(symbols, i)


def compile_merges(vocabulary: dict[str, int], merges: list[tuple[str, str]]) -> Automaton:
    symbols, size = byte_symbols(), max(vocabulary.values()) + 1
    base = [vocabulary[s] for s in symbols] + [vocabulary[s + END] for s in symbols]
    a = Automaton({i: s for s, i in vocabulary.items()}, base, [-1] * size, [-1] * size, [0] * size)
    spelled = {t: (k,) for k, t in enumerate(base)}
    for m, (x, y) in enumerate(merges, 1):
        left, right, whole = vocabulary[x], vocabulary[y], vocabulary[x + y]
        if whole in spelled or left not in spelled or right not in spelled:
            raise ValueError(f"merge {m} of {x!r} and {y!r} has no single, earlier origin")
        spelled[whole] = spelled[left] + spelled[right]
        a.left[whole], a.right[whole] = left, right
        if a.made[left] < 0 or not a.allows(left, right):
            a.made[whole] = -1
            continue
        a.made[whole] = m
        a.cut[left << 20 | right] = m
    for token, spelling in spelled.items():
        if a.made[token] >= 0:
            follow = a.trie
            for s in spelling:
                node = follow.setdefault(s, [None, {}])
                follow = node[1]
            node[0] = token
    return a


#: What \\s is to the tokenizer's patterns (Unicode white space, without the separators 1C-1F that Python adds).
_SPACE = r"\t\n\x0b\x0c\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000"


def split_pattern(pattern: str) -> regex.Pattern:
    """The tokenizer's split pattern with its white space."""
    return regex.compile(pattern.replace(r"[^\s", f"[^{_SPACE}"))


#: Letters and numbers that Unicode 16 added, which the tokenizer knows, as first and last code points.
UNICODE_16 = (
    (0x1C89, 0x1C8A), (0xA7CB, 0xA7CD), (0xA7DA, 0xA7DC), (0x105C0, 0x105F3), (0x10D40, 0x10D65), (0x10D6F, 0x10D85), (0x10EC2, 0x10EC4),
    (0x11380, 0x11389), (0x1138B, 0x1138B), (0x1138E, 0x1138E), (0x11390, 0x113B5), (0x113B7, 0x113B7), (0x113D1, 0x113D1), (0x113D3, 0x113D3),
    (0x116D0, 0x116E3), (0x11BC0, 0x11BE0), (0x11BF0, 0x11BF9), (0x13460, 0x143FA), (0x16100, 0x1611D), (0x16130, 0x16139), (0x16D40, 0x16D6C),
    (0x16D70, 0x16D79), (0x18CFF, 0x18CFF), (0x1CCF0, 0x1CCF9), (0x1E5D0, 0x1E5ED), (0x1E5F0, 0x1E5FA),
)
#: Capital letters that Unicode 16 and 17 added, as first and last code points and the first one's small letter.
CAPITALS = ((0x1C89, 0x1C89, 0x1C8A), (0xA7CB, 0xA7CB, 0x264), (0xA7CC, 0xA7CC, 0xA7CD), (0xA7CE, 0xA7CE, 0xA7CF), (0xA7D2, 0xA7D2, 0xA7D3), (0xA7D4, 0xA7D4, 0xA7D5), (0xA7DA, 0xA7DA, 0xA7DB), (0xA7DC, 0xA7DC, 0x19B), (0x10D50, 0x10D65, 0x10D70), (0x16EA0, 0x16EB8, 0x16EBB))
_SMALL = {a + k: small + k for a, b, small in CAPITALS for k in range(b - a + 1)}
_CAPITAL = regex.compile("[" + "".join(map(chr, _SMALL)) + "]")
#: Stands for a character that the regex module takes for a letter of a newer Unicode version than the tokenizer's.
_OTHER = "\ue000"


@functools.lru_cache(1 << 16)
def _unknown(c: str) -> bool:
    return unicodedata.category(c) == "Cn" and not any(a <= ord(c) <= b for a, b in UNICODE_16)


def _unassigned(chunk: str) -> bool:
    return not chunk.isascii() and any(map(_unknown, chunk))


_CONTROL = regex.compile(r"[\x1c-\x1f]")


class Tokenizer:
    """Reads a tokenizer file: word-final BPE over bytes, NFC, lower case, words split by its pattern."""

    def __init__(self, path: str) -> None:
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        model = spec["model"]
        self.automaton = compile_merges(model["vocab"], [tuple(m.split(" ")) if isinstance(m, str) else tuple(m) for m in model["merges"]])
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self.specials = regex.compile("(" + "|".join(regex.escape(s) for s in sorted(self.special, key=len, reverse=True)) + ")") if self.special else None
        pattern = next(p["pattern"]["Regex"] for p in spec["pre_tokenizer"]["pretokenizers"] if p["type"] == "Split")
        self.pattern = split_pattern(pattern)
        self.words: dict[str, bytes] = {}
        self.older: dict[str, bytes] = {}
        known = self.automaton.labels | {i: s for s, i in self.special.items()}
        self.names = [known.get(i) for i in range(max(known) + 1)]

    def normal(self, text: str) -> str:
        text = unicodedata.normalize("NFC", text)
        # lower() knows a word-final sigma; the tokenizer lowers characters one by one
        text = text.replace("Σ", "σ").lower()
        return text.translate(_SMALL) if not text.isascii() and _CAPITAL.search(text) else text

    def word(self, word: str) -> bytes:
        """Ids as little-endian 32-bit integers."""
        symbols = list(word.encode("utf-8"))
        symbols[-1] += 256
        return array("I", self.automaton.encode(symbols)).tobytes()

    def remember(self, word: str, ids: bytes) -> bytes:
        if len(word) <= LONGEST_WORD:
            if len(self.words) >= MOST_WORDS:
                self.older, self.words = self.words, {}
            self.words[word] = ids
        return ids

    def chunk(self, chunk: str) -> bytes:
        """The same for a run without white space, which no word crosses. Chunks and the words in them are remembered."""
        words, older = self.words, self.older
        out = words.get(chunk)
        if out is not None:
            return out
        out = older.get(chunk)
        if out is not None:
            return self.remember(chunk, out)
        if _unassigned(chunk):
            plain = "".join(_OTHER if _unknown(c) else c for c in chunk)
            split = [chunk[m.start() : m.end()] for m in self.pattern.finditer(plain)]
        else:
            split = self.pattern.findall(chunk)
        if len(split) == 1:
            return self.remember(chunk, self.word(split[0]))
        return self.remember(chunk, b"".join([words.get(w) or older.get(w) or self.remember(w, self.word(w)) for w in split]))

    def pieces(self, text: str) -> Iterator[bytes]:
        """The ids of a text, by special token and run between them, as bytes."""
        for part in self.specials.split(text) if self.specials else [text]:
            if part in self.special:
                yield self.special[part].to_bytes(4, "little")
            elif part:
                part = self.normal(part)
                # split() also parts at 1C-1F, which are not white space here
                chunks = part.split() if not _CONTROL.search(part) else [c for c in regex.split(f"[{_SPACE}]+", part) if c]
                found = list(map(self.words.get, chunks))
                yield b"".join([x or self.chunk(c) for x, c in zip(found, chunks, strict=True)])

    def encode(self, text: str) -> list[int]:
        return ids_of(b"".join(self.pieces(text)))

    def decode(self, ids: Sequence[int]) -> str:
        """Arc labels, joined by spaces as a tokenizer without a decoder does; unknown ids are left out."""
        names = self.names
        try:
            return " ".join(map(names.__getitem__, ids))
        except (IndexError, TypeError):
            return " ".join(names[i] for i in ids if 0 <= i < len(names) and names[i] is not None)


    def digests(self, text: str) -> tuple[int, str, str]:
        """Number of ids, and SHA-256 of the ids and of the text they decode to."""
        ids = b"".join(self.pieces(text))
        return len(ids) // 4, hashlib.sha256(ids).hexdigest(), hashlib.sha256(self.decode(array("I", ids)).encode("utf-8")).hexdigest()


def ids_of(data: bytes) -> list[int]:
    return array("I", data).tolist()


def _rows(docs: DataFrame, path: str, schema: str, make: Callable[[Tokenizer, str], tuple]) -> DataFrame:
    def run(batches):
        t = Tokenizer(path)  # for this task: a worker serves other stages as well
        for batch in batches:
            rows = [make(t, x or "") for x in batch.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), *(pa.array(c) for c in (zip(*rows, strict=True) if rows else ([], [], [])))], ["doc_id", *(x.split()[0] for x in schema.split(", ")[1:])])

    return documents(docs).mapInArrow(run, schema)


def encode_documents(docs: DataFrame, path: str) -> DataFrame:
    """doc_id, n_tokens, ids (32-bit integers), decoded; one row per row. Null text: empty."""

    def run(batches):
        t = Tokenizer(path)  # for this task: a worker serves other stages as well
        for batch in batches:
            ids = [t.encode(x or "") for x in batch.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array([len(x) for x in ids], pa.int64()), pa.array(ids, pa.list_(pa.int32())), pa.array([t.decode(x) for x in ids], pa.string())], ["doc_id", "n_tokens", "ids", "decoded"])

    return documents(docs).mapInArrow(run, "doc_id long, n_tokens long, ids array<int>, decoded string")


def encode_digests(docs: DataFrame, path: str) -> DataFrame:
    """doc_id, n_tokens, ids_sha256, decoded_sha256; one row per row of docs, null text counting as empty.

    Empty and white-space texts have no tokens. The digests are of the whole sequences, so nothing of a text's size leaves a task.
    """
    return _rows(docs, path, "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string", Tokenizer.digests)
