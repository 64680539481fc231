"""Parts that need no Spark, against plain versions."""

import hashlib
import itertools
import math
import random
import re

import numpy as np
import pyarrow as pa
import public_tokenizers
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer as Library

from layoutspark.llm import bpe, chat, decontam, langid, licenses, ngram_join, ngram_lm, quality, secrets_crf, tokens, warc

WORD = re.compile(r"[^\x20\x09-\x0D]+")
text = st.text(alphabet=st.sampled_from("aAbB é\n\t.ß日\x0b\x1c"), max_size=40)


def lower(s):
    return re.sub("[A-Z]", lambda m: m.group().lower(), s)


@given(st.lists(text, max_size=6))
@settings(max_examples=200, deadline=None)
def test_words_are_those_of_the_pattern(texts):
    data, off = tokens.buffers(pa.array([*texts, None], pa.string()))
    hashes, bounds, first, size = tokens.words(data, off)
    flat = [w for t in texts for w in WORD.findall(lower(t))]
    assert np.diff(bounds).tolist() == [*(len(WORD.findall(t)) for t in texts), 0]
    assert [bytes(data[a : a + n]).decode() for a, n in zip(first, size, strict=True)] == [w for t in texts for w in WORD.findall(t)]
    assert len(set(zip(flat, hashes.tolist(), strict=True))) == len(set(flat)) == len(set(hashes.tolist()))


def test_words_do_not_depend_on_chunks(monkeypatch):
    rng = random.Random(2)
    texts = ["".join(rng.choice("ab \n") for _ in range(rng.randint(0, 90))) for _ in range(40)] + ["x" * 300, "", "y"]
    data, off = tokens.buffers(pa.array(texts))
    whole = tokens.words(data, off)
    monkeypatch.setattr(tokens, "CHUNK", 16)
    for a, b in zip(whole, tokens.words(data, off), strict=True):
        assert (a == b).all()


@given(st.lists(text, max_size=5), st.integers(1, 5))
@settings(max_examples=150, deadline=None)
def test_shingles(texts, width):
    data, off = tokens.buffers(pa.array(texts, pa.string()))
    hashes, bounds, _, _ = tokens.words(data, off)
    got, at = tokens.shingles(hashes, bounds, width)
    want = []
    for t in texts:
        w = WORD.findall(lower(t))
        want.append([tuple(w[i : i + width]) for i in range(len(w) - width + 1)] if len(w) >= width else [tuple(w)] * bool(w))
    assert np.diff(at).tolist() == list(map(len, want))
    flat = [x for w in want for x in w]
    assert len(set(zip(flat, got.tolist(), strict=True))) == len(set(flat)) == len(set(got.tolist()))


def test_signatures_meet_for_every_similar_pair():
    """Sets at the limit, with all mixtures of rare and frequent shingles, share a signature that allows the overlap."""
    rng = np.random.default_rng(4)
    for _ in range(400):
        n = int(rng.integers(4, 90))
        pool = rng.choice(1 << 40, 2 * n + 8, replace=False).astype(np.uint64) << np.uint64(20)
        df = {int(t): int(rng.choice([0, 20, 40, 3000], p=p)) for p in [rng.dirichlet([1, 1, 1, 1])] for t in pool}
        a = pool[:n]
        lost = int(rng.integers(0, n - math.ceil(0.8 * n) + 1))
        b = np.concatenate((a[lost:], pool[n : n + int(rng.integers(0, n // 4 + 1))]))
        common = n - lost
        if 100 * common < 80 * (n + len(b) - common):
            continue
        sides = []
        for x in (a, b):
            x = np.sort(x)
            f = np.array([df[int(t)] for t in x])
            sides.append(dict(zip(*ngram_join.signatures(x, f > 0, f, 16), strict=True)))
        assert any(ngram_join._fits(n, sides[0][s], len(b), sides[1][s]) for s in sides[0].keys() & sides[1].keys())


@pytest.fixture(scope="module")
def tokenizers():
    path = public_tokenizers.path("word_bpe_49k.json")
    return bpe.Tokenizer(path), Library.from_file(path)


ODD = ["", "   ", "aaaaaaa aaa aa", "ΑΣ ΣΑΣ", "İstanbul", "a<|endoftext|>b <|startoftext|>", "don't I'LL we've", "x\x1cy\x1dz\x85w᠎ ​﻿ q", "日本語テキスト 123४५", "éclair ﬁ", "🙂🙂 👩‍👩‍👧", "a" * 3000, "the" * 2000, "!!!???...", "\x00\x01", "<|ENDOFTEXT|>", "ǅ ß ẞ K Å", "é"]


@pytest.mark.parametrize("x", ODD)
def test_bpe_odd_texts(tokenizers, x):
    mine, library = tokenizers
    ids = library.encode(x, add_special_tokens=False).ids
    assert mine.encode(x) == ids and mine.decode(ids) == library.decode(ids, skip_special_tokens=False)


@given(st.text(alphabet=st.characters(max_codepoint=0x2FF), max_size=60))
@settings(max_examples=300, deadline=None)
def test_bpe_any_text(tokenizers, x):
    mine, library = tokenizers
    ids = library.encode(x, add_special_tokens=False).ids
    assert mine.encode(x) == ids and mine.decode(ids) == library.decode(ids, skip_special_tokens=False)


def test_bpe_encodes_a_word_once(tokenizers, monkeypatch):
    mine, library = bpe.Tokenizer(public_tokenizers.path("word_bpe_49k.json")), tokenizers[1]
    encoded, asked = [], []
    word, allows = mine.word, mine.automaton.allows
    monkeypatch.setattr(mine, "word", lambda w: encoded.append(w) or word(w))
    monkeypatch.setattr(mine.automaton, "allows", lambda a, b: asked.append((a, b)) or allows(a, b))
    text = "keitpfge, keitpfge. (keitpfge) keitpfge"
    ids = library.encode(text, add_special_tokens=False).ids
    assert mine.encode(text) == ids and mine.encode(text) == ids
    assert encoded.count("keitpfge") == 1
    mine.encode("xkeitpfge keitpfgey ykeitpfge")
    assert len(asked) == len(set(asked))


def test_bpe_small_memories(tokenizers, monkeypatch):
    """Words and pairs that are forgotten are encoded anew; digests are those of the library."""
    monkeypatch.setattr(bpe, "MOST_WORDS", 3)
    monkeypatch.setattr(bpe, "MOST_PAIRS", 2)
    mine, library = bpe.Tokenizer(public_tokenizers.path("word_bpe_49k.json")), tokenizers[1]
    for text in [*ODD, " ".join(ODD), "keitpfge, foranblest keitpfge. erininges foranblest! keitpfge erininges?" * 3]:
        ids = library.encode(text, add_special_tokens=False).ids
        hashed = [hashlib.sha256(x).hexdigest() for x in (np.array(ids, "<u4").tobytes(), library.decode(ids, skip_special_tokens=False).encode())]
        assert mine.digests(text) == (len(ids), *hashed)
        assert max(len(mine.words), len(mine.older)) <= 3 and len(mine.automaton.pairs) <= 2


@given(st.lists(st.integers(0, 3), min_size=1, max_size=8), st.lists(st.integers(0, 3), max_size=14))
@settings(max_examples=300, deadline=None)
def test_best_run(pattern, run):
    def distance(a, b):
        row = list(range(len(b) + 1))
        for i, x in enumerate(a, 1):
            row, last = [i], row
            for j, y in enumerate(b, 1):
                row.append(min(last[j] + 1, row[-1] + 1, last[j - 1] + (x != y)))
        return row[-1]

    best, end = decontam.best_run(pattern, run)
    assert best == min(distance(pattern, run[i:j]) for i in range(len(run) + 1) for j in range(i, len(run) + 1))
    assert any(distance(pattern, run[i:end]) == best for i in range(end + 1))


def test_leak_recall_at_the_allowed_edits():
    rng = random.Random(5)
    word = lambda: f"w{rng.randrange(10**6)}"
    benchmark = [[word() for _ in range(rng.randint(12, 70))] for _ in range(60)]
    items = decontam.Items(list(range(60)), pa.array([" ".join(x) for x in benchmark]))
    texts, want = [], []
    for k in range(240):
        x = list(benchmark[k % 60])
        for _ in range(int(0.2 * len(x))):
            kind, p = rng.randrange(3), rng.randrange(len(x))
            x[p : p + (kind != 1)] = [] if kind == 2 else [word()]
        texts.append(" ".join([word() for _ in range(20)] + x + [word() for _ in range(20)]))
        want.append((k, k % 60))
    texts += [" ".join(word() for _ in range(100)), ""]
    hashes, bounds, _, _ = tokens.words(*tokens.buffers(pa.array(texts)))
    got = {(a, b) for a, b, *_ in decontam.leaks(items, hashes, bounds)}
    assert got <= set(want) and len(got) >= 0.9 * len(want)


@pytest.mark.parametrize("m", (5, 12, 31, 63, 100, 200, 500))
@pytest.mark.parametrize("edits", ("start", "middle", "end", "both ends", "spread"))
def test_leak_recall_wherever_the_edits_lie(m, edits):
    """Against an exhaustive search: the least edit distance of each item to any run of each text."""
    rng = random.Random(m)
    word = lambda: f"w{rng.randrange(10**6)}"
    benchmark = [[word() for _ in range(m)] for _ in range(30)]
    items = decontam.Items(list(range(30)), pa.array([" ".join(x) for x in benchmark]))
    k, texts = m // 5, []
    for x in benchmark:
        for replaced in (0, 1):
            a = {"start": 0, "middle": (m - k) // 2, "end": m - k}.get(edits)
            places = range(a, a + k) if a is not None else [*range(k // 2), *range(m - (k - k // 2), m)] if edits == "both ends" else rng.sample(range(m), k)
            y = [w if i not in set(places) else word() for i, w in enumerate(x) if replaced or i not in set(places)]
            texts.append(" ".join([word() for _ in range(20)] + y + [word() for _ in range(20)]))
    hashes, bounds, _, _ = tokens.words(*tokens.buffers(pa.array(texts)))
    got = {(a, b): d for a, b, d, *_ in decontam.leaks(items, hashes, bounds)}
    want = {}
    for t, (a, b) in enumerate(zip(bounds[:-1], bounds[1:], strict=True)):
        text = hashes[a:b].tolist()
        for i in {t // 2, rng.randrange(30)}:
            distance, _ = decontam.best_run(items.words[i].tolist(), text)
            if distance <= k:
                want[t, i] = distance
    assert len(want) == 60
    assert all(want[x] == d for x, d in got.items()) and len(got) >= 0.9 * len(want)


@given(st.lists(st.integers(0, 5000), max_size=60), st.lists(st.integers(0, 5200), max_size=30))
@settings(max_examples=200, deadline=None)
def test_elias_fano(values, asked):
    values = np.array(sorted(set(values)), dtype=np.uint64)
    e = ngram_lm.EliasFano.build(values, 5001)
    asked = np.array([*asked, *values.tolist()], dtype=np.uint64)
    place = {v: i for i, v in enumerate(values.tolist())}
    assert e.find(asked).tolist() == [place.get(v, -1) for v in asked.tolist()]
    assert (e.get(np.arange(len(values))) == values).all()


@given(st.lists(st.lists(st.sampled_from(["a", "b b", "# x", "", " ", "a b c", "x|y"]), max_size=7).map("\n".join), max_size=4))
@settings(max_examples=200, deadline=None)
def test_text_stats(texts):
    data, off = tokens.buffers(pa.array(texts, pa.string()))
    got = list(zip(*(x.tolist() for x in quality.text_stats(data, off)), strict=True)) if texts else []
    assert got == [stats_of(t) for t in texts]


def stats_of(t):
    w = WORD.findall(t)
    lines = [x for x in t.split("\n") if WORD.search(x)]
    windows = list(zip(w, w[1:], w[2:], strict=False))
    again = {i + k for i, x in enumerate(windows) for k in range(3) if windows.count(x) > 1}
    return len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", t)), len(lines) - len(set(lines)), len(again), len(lines)


def test_binomial_tail_and_certified_cutoffs():
    for n, k, p in ((10, 0, 0.1), (30, 3, 0.2), (200, 5, 0.01), (5, 5, 0.5)):
        assert math.isclose(quality.tail(k, n, p), min(1.0, sum(math.comb(n, i) * p**i * (1 - p) ** (n - i) for i in range(k + 1))), rel_tol=1e-9)
    # nothing of n rejected is enough from least_holdout on, and not before
    for strata in (1, 4, 30):
        n = quality.least_holdout(strata)
        assert quality.certified([0], n, strata) == 1 and quality.certified([0], n - 1, strata) == 0
    assert quality.certified([0, 3, 90, 90], 1000, 1) == 2  # the sequence ends at the first that fails
    assert quality.certified([], 1000, 1) == 0 == quality.certified([0], 0, 1)


def test_strata_are_chosen_by_size():
    assert quality.choose_strata({"=a": 5000, "=b": 400, "=c": 20, "null": 10}) == ["=a", "=b"]
    assert quality.choose_strata({}) == [] == quality.choose_strata({"=a": 3})


@given(st.lists(st.tuples(st.lists(st.integers(0, quality.STEPS), min_size=5, max_size=5), st.booleans()), min_size=1, max_size=60))
@settings(max_examples=150, deadline=None)
def test_chains_are_nested(rows):
    got = quality.chain(np.array([r[0] for r in rows]), np.array([r[1] for r in rows]))
    assert all(x >= y for a, b in zip(got, got[1:], strict=False) for x, y in zip(a, b, strict=True))
    assert len(set(got)) == len(got)


def test_chain_lies_between_good_and_bad():
    bins = np.array([[2, 0, 0, 0, 0]] * 100 + [[40, 0, 0, 0, 0]] * 20)
    got = quality.chain(bins, np.arange(120) < 100)
    assert got[0] > got[-1] and 2 < got[-1][0] <= 40 and got[-1][1:] == (quality.STEPS + 1,) * 4


@given(st.lists(st.sampled_from(["system", "user", "assistant", "tool", None]), min_size=1, max_size=5), st.integers(1, 4))
@settings(max_examples=120, deadline=None)
def test_repair_costs_least_and_is_legal(roles, cut):
    states = chat.decode(roles, chat.START, None)
    pieces = [chat.render(r, "t", p, s, i == len(roles) - 1) for i, (r, p, s) in enumerate(zip(roles, [chat.START, *states[:-1]], states, strict=True))]
    cost = sum(p[1] for p in pieces)

    def price(path):
        total = chat.END_COST[path[-1]]
        for r, p, s in zip(roles, (chat.START, *path[:-1]), path, strict=True):
            total += chat.matrix(r)[0][p, s]
        return total

    assert cost == min(map(price, itertools.product((1, 2, 3), repeat=len(roles))))
    said = re.findall(r"<\|(system|user|assistant)\|>", "".join(p[2] for p in pieces))
    assert said[-1] == "assistant" and all(a != b for a, b in zip(said, said[1:], strict=False)) and "system" not in said[1:]
    # segments of any size give the same cost
    product = chat.IDENTITY
    for i in range(0, len(roles), cut):
        part = chat.IDENTITY
        for r in roles[i : i + cut]:
            part = chat.product(part, chat.matrix(r)[0])
        product = chat.product(product, part)
    assert (product[chat.START] + chat.END_COST).min() == cost


def test_archives():
    html = [f"<html><body>{'page text ' * (i % 50)}{i}</body></html>".encode() for i in range(300)]
    records = [warc.record(i, f"http://x/{i}", h, "d", None, len(h)) for i, h in enumerate(html)] + [warc.record(7, None, b"", "d", 3, 0)]
    data, places = warc.archive(records)
    assert list(warc.read_archive(data)) == records == list(warc.read_archive(data, places)) and len(data) < sum(map(len, records)) / 2
    assert data[:4] == (0x184D2A5D).to_bytes(4, "little") and int.from_bytes(data[4:8], "little") > 0
    assert [warc.parse(r)[1] for r in records[:300]] == html
    large = [*records[:2], np.random.default_rng(3).bytes(3 * warc.PIECE)]
    assert list(warc.read_archive(warc.archive(large)[0])) == large  # too few for a dictionary; a frame of several pieces
    assert list(warc.read_archive(*warc.archive([]))) == []
    with pytest.raises(ValueError, match="ends inside"):
        list(warc.read_archive(data[:-5]))


def test_license_cases():
    index = licenses.Index({}, 1000)
    assert index.scan("")[:4] == (0, 0, None, None)
    assert index.scan("Released under the MIT License, twice: under the mit-license") == (10, 2, 1, 6, "mit", "mit", 1.0)
    n, base, _, _, b, labels, score = index.scan("This work is licensed under the GNU General Public License, version 3.")
    assert (base, b, labels) == (0, "", "gpl-3") and 0.6 <= score <= 1
    assert index.scan("the license of the public work is general")[5] == ""
    long = "word " * 5000 + "Licensed under the Apache License, Version 2.0"
    assert index.scan(long)[2] == 5003 and index.scan(long)[5] == "apache-2"


def test_several_licenses_in_a_file():
    index = licenses.Index({w: 500 for w in ("all", "rights", "reserved", "cc", "by", "4", "0", "the", "of", "license")}, 1000)
    parts = [(label, t) for label, t, _ in licenses.TEMPLATES]
    for (a, x), (b, y) in random.Random(2).sample(list(itertools.product(parts, parts)), 250):
        assert {a, b} <= set(index.scan(f"{x}. {'other ' * 30}{y}")[5].split(","))
    assert index.scan(" ".join(t for _, t in parts))[5] == ",".join(sorted({label for label, _ in parts}))


def test_license_shares_are_those_of_all_offsets():
    rng = random.Random(3)
    index = licenses.Index({w: rng.randrange(1000) for _, t, _ in licenses.TEMPLATES for w in t.split()}, 1000)
    for _ in range(25):
        text = []
        for _, t, _ in rng.sample(licenses.TEMPLATES, 3):
            text += [w for w in t.split() for _ in range(rng.choice((0, 1, 1, 1, 1, 2)))] + t.split() * rng.randrange(2) + ["and", "the"] * rng.randrange(3)
        want = {}
        for label, t, must in licenses.TEMPLATES:
            t, whole = t.split(), sum(index.idf[w] for w in t.split())
            share = max(sum(index.idf[w] for i, w in enumerate(t) if w in text[max(0, o + i - 2) : max(0, o + i + 3)]) for o in range(-len(t), len(text) + 1)) / whole
            if share >= licenses.LEAST and all(f" {m} " in f" {' '.join(text)} " for m in must):
                want[label] = max(want.get(label, 0), share)
        got = index.scan(" ".join(text))
        assert got[5] == ",".join(sorted(want)) and (got[1] or math.isclose(got[6], min(1, max(want.values(), default=0))))


def test_viterbi_and_gradient():
    rng = np.random.default_rng(3)
    field = secrets_crf.Field(rng.normal(size=(secrets_crf.WEIGHTS, 3)), rng.normal(size=(3, 3)))
    e = rng.normal(size=(5, 3))
    price = lambda p: e[np.arange(5), p].sum() + field.moves[0, p[0]] + sum(field.moves[a, b] for a, b in zip(p, p[1:], strict=False))
    assert field.viterbi(e) == list(max(itertools.product(range(3), repeat=5), key=price))
    x = rng.integers(1, 40, size=(3, 4, 5))
    y, real = rng.integers(0, 3, size=(3, 4)), np.array([[1, 1, 1, 1], [1, 1, 0, 0], [1, 1, 1, 0]], dtype=bool)
    params = rng.normal(size=secrets_crf.WEIGHTS * 3 + 9) * 0.3

    def loss(v):
        w, m = v[:-9].reshape(-1, 3), v[-9:].reshape(3, 3)
        total = 0.0
        for i in range(3):
            n = int(real[i].sum())
            em = w[x[i, :n]].sum(axis=1)
            score = lambda p: em[np.arange(n), p].sum() + m[0, p[0]] + sum(m[a, b] for a, b in zip(p, p[1:], strict=False))  # noqa: B023, E731
            total += np.log(sum(math.exp(score(p)) for p in itertools.product(range(3), repeat=n))) - score(tuple(y[i, :n]))
        return total

    g = secrets_crf._gradient(params, x, y, real)
    for k in [*rng.integers(3, 120, size=6), *range(len(params) - 9, len(params))]:
        d = np.zeros_like(params)
        d[k] = 1e-5
        assert math.isclose((loss(params + d) - loss(params - d)) / 2e-5, g[k], abs_tol=1e-5)


def test_base_spans():
    s = secrets_crf.base_spans
    assert s('x token = "abcdef" y') == [(2, 17, "assign")]
    assert s("token=abc token=token:abcdefgh") == []
    assert s("API_KEY: A1b2C3d4") == [(0, 17, "assign")] and s("ſecret=abcdefgh") == []
    assert s("AKIA" + "A" * 15) == [] and s("AKIA" + "A" * 16) == [(0, 20, "access")]
    assert s("é" + "0a" * 12) == [(1, 25, "hex")] and s("0a" * 11 + "g") == []
    assert s("secret=" + "0a" * 12) == [(0, 31, "assign"), (7, 31, "hex")]


def gram_counts(text):
    """Buckets of all 1- to 3-grams of the lower-cased text, one by one."""
    low, out, m = text.lower(), np.zeros(langid.BUCKETS), 1 << 32
    for n in (1, 2, 3):
        for i in range(len(low) - n + 1):
            h = 0
            for k, c in enumerate(low[i : i + n], 1):
                h = (h * 0x01000193 + ord(c) * 0x9E3779B1 + k) % m
            out[((h ^ (h >> 15)) * 0x85EBCA6B % m) >> (32 - 13)] += 1
    return out


@pytest.mark.parametrize(("piece", "stretches"), [(1 << 18, 256), (5, 3), (3, 1), (16, 2)])
@given(st.lists(st.text(max_size=60), min_size=1, max_size=5))
@settings(max_examples=40, deadline=None)
def test_language_scores_are_those_of_all_grams(piece, stretches, texts):
    old = langid.PIECE, langid.STRETCHES
    langid.PIECE, langid.STRETCHES = piece, stretches
    try:
        model = langid.Model(["a", "b"], np.random.default_rng(1).random((2, langid.BUCKETS)), np.array([1.0, 2.0]))
        got = model.score(texts)
    finally:
        langid.PIECE, langid.STRETCHES = old
    want = np.array([model.priors + model.logs.astype(float) @ gram_counts(t) for t in texts])
    assert np.allclose(got, want, rtol=1e-9)


def test_hidden_secrets_are_found():
    """Secrets that no base pattern matches, in texts of which the field has seen none: recall and precision."""
    rng = random.Random(7)
    word = lambda: rng.choice(["the", "of", "and", "anblewh", "thonre", "erinst", "12", "3.5", "555-7713", "a@b7.example.com", "10.0.0.7"])
    prose = lambda n: [word() for _ in range(n)]
    draw = lambda letters, n: "".join(rng.choice(letters) for _ in range(n))
    known = ['token = "' + draw("0123456789abcdef", 40) + '"' for _ in range(150)]
    texts = [" ".join([*prose(rng.randint(5, 60)), k, *prose(rng.randint(5, 60))]) for k in known] + [" ".join(prose(rng.randint(20, 120))) for _ in range(400)]
    windows = [w for i, t in enumerate(texts) for w in secrets_crf._windows(t, i + 1)]
    field = secrets_crf.train(windows + secrets_crf.redrawn(windows))
    upper = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
    found = extra = total = 0
    for form in ("bearer {}", "passwd is {}", "private-key {}", "{}", "credential: '{}'") * 40:
        secret = "Q" + draw(upper + upper.lower() + "0123456789+/", rng.randint(22, 46)) + "9z"
        text = " ".join([*prose(rng.randint(3, 60)), form.format(secret), *prose(rng.randint(3, 60))])
        at = text.index(secret)
        base, both = secrets_crf.all_spans(field, text)
        if base:
            continue
        hit = [(s, e) for s, e, _ in both if s <= at and e >= at + len(secret)]
        total, found, extra = total + 1, found + bool(hit), extra + len(both) - len(hit)
    assert total > 150 and found >= 0.95 * total and extra <= 0.05 * total
    assert sum(bool(field.spans(" ".join(prose(80)))) for _ in range(300)) <= 6
    assert secrets_crf.train([]).spans("token abc") == []
