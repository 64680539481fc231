"""Whole operators on small tables, against brute force; nulls, empty and long texts, ties, repeats, empty tables, extra columns."""

import collections
import hashlib
import math
import random
import re
import time
import zlib

import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from layoutspark.llm import bpe, chat, decontam, langid, licenses, ngram_join, ngram_lm, quality, secrets_crf, store, warc
from layoutspark.llm import queries as registered

SF = "/root/testdata/sf0.001"
WORD = re.compile(r"[^\x20\x09-\x0D]+")
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, id string, n long, kept string, component_id string, hash string, spot int"


def lower(s):
    return re.sub("[A-Z]", lambda m: m.group().lower(), s)


def shingles(t):
    w = WORD.findall(lower(t or ""))
    return frozenset(tuple(w[i : i + 5]) for i in range(len(w) - 4)) if len(w) >= 5 else frozenset([tuple(w)] if w else [])


@pytest.fixture(scope="module")
def rows():
    rng = random.Random(9)
    word = lambda: rng.choice(["the", "of"] + [f"w{rng.randrange(4000)}" for _ in range(6)])
    texts = []
    for _ in range(12):
        base = [word() for _ in range(rng.randint(4, 120))]
        texts.append(" ".join(base))
        for _ in range(rng.randint(0, 25)):
            x = list(base)
            for _ in range(rng.randint(0, 4)):
                x[rng.randrange(len(x))] = word()
            texts.append(" ".join(x))
    texts += [" ".join(word() for _ in range(60)) for _ in range(30)]
    texts += [None, "", " \n ", "one", "One", "two words", "x" * 5000, "long " * 4000, 'a token = "0123456789abcdef0123456789abcdef" b', "cc by-nc licensed"]
    out = [(i, t, rng.choice(["en", "de", None]), "s", 0, "x", 7, "y", "z", "h", 3) for i, t in enumerate(texts)]
    return [*out, out[3], (None, texts[0], "en", "s", 0, "x", 7, "y", "z", "h", 3)]


@pytest.fixture(scope="module")
def docs(spark, rows):
    return spark.createDataFrame(rows, SCHEMA).repartition(3).cache()


@pytest.fixture(scope="module")
def labels(spark):
    return spark.createDataFrame([(i, i % 2, 0) for i in range(0, 100, 3)] + [(3, 0, 0), (None, 1, 0), (5, None, 0)], "doc_id long, quality int, toxic int")


def components(rows):
    """By all pairs."""
    ids = {r[0]: shingles(r[1]) for r in rows if r[0] is not None}
    root = {i: i for i in ids}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a in ids:
        for b in ids:
            if a < b and ids[a] and 100 * len(ids[a] & ids[b]) >= 80 * len(ids[a] | ids[b]):
                x, y = find(a), find(b)
                root[max(x, y)] = min(x, y)
    return {i: find(i) for i in ids}, ids


@pytest.mark.parametrize(("frequent", "short", "block"), [(2, 2, 3), (16, 16, 2048)])
def test_ngram_join(monkeypatch, rows, docs, frequent, short, block):
    for name, value in (("FREQUENT", frequent), ("SHORT", short), ("BLOCK", block)):
        monkeypatch.setattr(ngram_join, name, value)
    want, sets = components(rows)
    got = ngram_join.ngram_jaccard_join(docs).collect()
    assert len(got) == len(rows)
    for r in got:
        if r["doc_id"] is not None:
            assert (r["n_shingles"], r["component_id"]) == (len(sets[r["doc_id"]]), want[r["doc_id"]])
    kept = ngram_join.keep_first(docs)
    assert kept.columns == docs.columns
    assert sorted(r["doc_id"] for r in kept.collect() if r["doc_id"] is not None) == sorted([i for i, c in want.items() if i == c] + [3] * (want[3] == 3))


@pytest.mark.parametrize(("short", "block", "most"), [(2, 2048, 1 << 20), (4, 40, 1 << 20), (4, 2048, 50)])
def test_dense_group_below_the_limit(monkeypatch, spark, short, block, most):
    """Near copies of one text, most pairs of which are just below the similarity: none is lost, and few candidates are made twice."""
    for name, value in (("SHORT", short), ("BLOCK", block), ("MOST_FREQUENT", most)):
        monkeypatch.setattr(ngram_join, name, value)
    rng = random.Random(4)
    base = [f"w{rng.randrange(300)}" for _ in range(90)]
    rows = []
    for i in range(160):
        x = list(base)
        for k in rng.sample(range(90), rng.choice([0, 1, 2, 2, 3, 3, 4])):
            x[k] = f"v{rng.randrange(10**6)}"
        rows.append((i, " ".join(x)))
    made = []
    pairs = ngram_join.cross_pairs
    monkeypatch.setattr(ngram_join, "cross_pairs", lambda *a: made.append(pairs(*a)) or made[-1])
    got = {r["doc_id"]: r["component_id"] for r in ngram_join.ngram_jaccard_join(spark.createDataFrame(rows, "doc_id long, text string").repartition(3)).collect()}
    want, sets = components(rows)
    assert got == want
    assert 1 < len(set(want.values())) < 160
    assert made[0].count() < 2 * made[0].distinct().count() + 160


def bins_of(text):
    """The rules' bins of a text, without the library's statistics."""
    w, x = WORD.findall(text or ""), text or ""
    lines = [y for y in x.split("\n") if WORD.search(y)]
    windows = list(zip(w, w[1:], w[2:], strict=False))
    twice = {y for y, n in collections.Counter(windows).items() if n > 1}
    again = len({i + k for i, y in enumerate(windows) if y in twice for k in range(3)})
    ratio = lambda a, b, top: min(quality.STEPS, int(a / b * (quality.STEPS / top))) if b else 0
    n = len(w)
    return n, again, (ratio(len(re.findall(r"[#*$%&|<>]", x)), n, 2.0), ratio(len(lines) - len(set(lines)), len(lines), 1.0), ratio(again, n, 1.0), ratio(sum(map(len, w)), n, 32.0), ratio(len(lines), n, 1.0))


def test_quality(rows, docs, labels):
    got = quality.quality_rules(docs, labels).collect()
    assert len(got) == len(rows)
    assert list(got[0].asDict())[:8] == ["doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept"]
    text = {r[0]: r[1] for r in rows}
    for r in got:
        n, again, _ = bins_of(text[r["doc_id"]])
        assert (r["n_words"], r["n_repeat_words"], r["base_failed"]) == (n, again, n < 50 or 100 * again > 50 * n)
        assert r["kept"] == (not r["base_failed"])  # too few labels for any test
    assert quality.keep_good(docs, labels).columns == docs.columns
    assert quality.quality_rules(docs, labels.limit(0)).where("kept = base_failed").count() == 0
    clash = docs.select("doc_id", "text", "lang", F.col("n").alias("q_lang"), F.col("n").alias("qq_cut_symbols"), F.col("n").alias("n_words"))
    assert quality.keep_good(clash, labels).columns == clash.columns
    assert quality.quality_rules(clash, labels, clash.columns).count() == len(rows)


def test_quality_is_certified_and_kept_follows_the_cutoffs(spark):
    docs, labels = (spark.read.parquet(f"/root/testdata/sf0.01/{x}.parquet") for x in ("documents", "labels"))
    own, cutoffs = quality.fit_cutoffs(docs, labels)
    assert cutoffs
    rows = docs.join(labels, "doc_id", "left").join(quality.quality_rules(docs, labels).select("doc_id", "base_failed", "kept"), "doc_id").collect()
    place = {r["doc_id"]: r["p"] for r in docs.select("doc_id", (F.pmod(F.xxhash64("doc_id", F.lit(7)), F.lit(1 << 20)) / (1 << 20)).alias("p")).collect()}
    tests, wrong = collections.Counter(), collections.Counter()
    for r in rows:
        n, again, bins = bins_of(r["text"])
        failed = n < 50 or 100 * again > 50 * n
        stratum = "null" if r["lang"] is None else "=" + r["lang"]
        stratum = stratum if stratum in own else quality.POOL
        rejected = stratum in cutoffs and any(b >= c for b, c in zip(bins, cutoffs[stratum], strict=True))
        assert (r["base_failed"], r["kept"]) == (failed, not failed and not rejected)
        if r["quality"] == 1 and not failed and place[r["doc_id"]] >= quality.TUNE_SHARE:
            tests[stratum] += 1
            wrong[stratum] += rejected
    for s in cutoffs:  # the exact test, again
        p = sum(math.comb(tests[s], i) * quality.ALPHA**i * (1 - quality.ALPHA) ** (tests[s] - i) for i in range(wrong[s] + 1))
        assert p <= quality.DELTA / (len(own) + 1)
    bad = [r for r in rows if r["quality"] == 0 and not r["base_failed"]]
    assert sum(not r["kept"] for r in bad) > 0.5 * len(bad) > 0


def test_language_model(rows, docs):
    got = [r for r in ngram_lm.score_documents(docs).collect()]
    assert len(got) == len(rows)
    tokens = [(r[0], [*WORD.findall(lower(r[1] or "")), None]) for r in rows]
    train = [t for i, t in tokens if i is None or zlib.crc32(str(i).encode()) % 10]
    c = collections.Counter(w for t in train for w in t)
    pairs = collections.Counter(p for t in train for p in zip(["<s>", *t], t, strict=False))
    n, v = sum(c.values()), len(c)
    want = {i: (t, sum(math.log10((c[w] + 0.1) / (n + 0.1 * (v + 1))) for w in t)) for i, t in tokens}
    for r in got:
        t, base = want[r["doc_id"]]
        assert (r["n_tokens"], r["n_known"], r["train_tokens"]) == (len(t), sum(c[w] > 0 for w in t), n)
        assert math.isclose(r["base_score"], base, rel_tol=1e-9)
        full = 0.0
        for h, w in zip(["<s>", *t], t, strict=False):
            seen, p = len(train) if h == "<s>" else c[h], (c[w] + 0.1) / (n + 0.1 * (v + 1))
            full += math.log10(0.6 * pairs[h, w] / seen + 0.4 * p if seen else p)
        assert abs(r["score"] - full) < 0.025 * len(t)


def test_language_id(rows, docs):
    got = langid.identify_languages(docs).collect()
    assert len(got) == len(rows)
    for r in got:
        assert r["lang_pred"] in ("en", "de", "und") and 0 <= r["score"] <= 1
        if r["doc_id"] is not None:
            assert r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 4 == 2)
    by = {r["doc_id"]: r["lang_pred"] for r in got}
    assert all((by[r[0]] == "und") == (not any(map(str.isalpha, r[1] or ""))) for r in rows)


def test_more_languages_than_a_block(spark):
    rng = random.Random(9)
    alphabets = [[chr(0x4E00 + 24 * k + i) for i in range(24)] for k in range(270)]
    texts = ["".join(rng.choice(a) for _ in range(80)) for a in alphabets for _ in range(2)]
    docs = spark.createDataFrame([(10 * i, t, f"l{i // 2:03}") for i, t in enumerate(texts) if zlib.crc32(str(10 * i).encode()) % 4 != 2], "doc_id long, text string, lang string")
    got = langid.identify_languages(docs).join(docs, "doc_id")
    assert got.where("lang_pred = lang").count() == docs.count() and docs.select("lang").distinct().count() > 256


def test_large_languages_have_cutoffs_of_their_own(spark):
    # good documents of one language have no symbols; those of another have as many as its bad ones; small ones share a stratum
    body = " ".join(f"w{i}" for i in range(60))
    rows, marks = [], []
    for lang, docs in [("clean", 1200), ("noisy", 1200), *((f"l{k:03}", 10) for k in range(60)), (None, 10), ("", 10)]:
        for _ in range(docs):
            n = len(rows)
            good = n % 3 > 0
            rows.append((n, body + (" #" * 50 if lang == "noisy" or not good else ""), lang))
            marks.append((n, int(good)))
    rows += [(0, rows[0][1], "clean")] * 3000  # one document many times is one document
    docs, labels = spark.createDataFrame(rows, "doc_id long, text string, lang string"), spark.createDataFrame(marks, "doc_id long, quality int")
    own, cutoffs = quality.fit_cutoffs(docs, labels)
    assert sorted(own) == ["=clean", "=noisy"] and sorted(cutoffs) == [quality.POOL, "=clean"]
    kept = {r["doc_id"] for r in quality.quality_rules(docs, labels).where("kept").collect()}
    assert kept == {r[0] for r in rows if r[2] == "noisy" or "#" not in r[1]}


def test_held_out_language_accuracy(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    got = langid.identify_languages(docs).join(docs, "doc_id").where("held_out")
    assert got.where("lang_pred = lang").count() >= 0.97 * got.count()


def test_secrets(rows, docs):
    field = secrets_crf.fit(docs)
    got = secrets_crf.secret_spans(docs, field).collect()
    assert len(got) == len(rows)
    text = {r[0]: r[1] for r in rows}
    for r in got:
        base = secrets_crf.base_spans(text[r["doc_id"]] or "")
        line = ",".join(f"{k}:{s}:{e}" for s, e, k in base)
        assert r["base_sha256"] == hashlib.sha256(line.encode()).hexdigest()
        assert set(line.split(",")) <= set(r["spans"].split(","))
    clean = secrets_crf.redact(docs, field=field)
    assert clean.columns == docs.columns and clean.count() == len(rows)
    assert clean.where(F.col("text").contains("0123456789abcdef")).count() == 0


def test_bpe_and_licenses(rows, docs):
    import public_tokenizers
    from tokenizers import Tokenizer

    path = public_tokenizers.path("word_bpe_49k.json")
    library = Tokenizer.from_file(path)
    text = {r[0]: r[1] or "" for r in rows}
    for r in bpe.encode_digests(docs, path).collect():
        ids = library.encode(text[r["doc_id"]], add_special_tokens=False).ids
        assert r["n_tokens"] == len(ids) and r["ids_sha256"] == hashlib.sha256(b"".join(i.to_bytes(4, "little") for i in ids)).hexdigest()
        assert r["decoded_sha256"] == hashlib.sha256(library.decode(ids, skip_special_tokens=False).encode()).hexdigest()
    assert bpe.encode_documents(docs, path).where("size(ids) = n_tokens").count() == len(rows)
    found = {r["doc_id"]: r for r in licenses.scan_licenses(docs).collect()}
    for i, t in text.items():
        w = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", lower(t))
        places = [(k, label) for p, label in licenses.BASE for k in range(len(w)) if w[k : k + len(p.split())] == p.split()]
        assert (found[i]["n_words"], found[i]["n_base"], found[i]["base_labels"]) == (len(w), len(places), ",".join(sorted({x for _, x in places})))
        assert found[i]["first_word"] == min((k for k, _ in places), default=None)


def test_leaks(spark, docs):
    words = lambda a, b: " ".join(f"q{i}" for i in range(a, b))
    benchmark = spark.createDataFrame([(1, words(0, 20)), (2, words(50, 100)), (3, None), (4, ""), (5, "q7 q8"), (None, "q1 q2"), (1, words(0, 20))], "item_id long, text string")
    more = spark.createDataFrame([(1000, "x " * 30 + words(0, 20)), (1001, words(50, 60) + " z " + words(61, 100)), (1002, words(0, 9)), (1003, None)], "doc_id long, text string")
    got = {(r["doc_id"], r["item_id"]): (r["distance"], r["first_word"], r["last_word"]) for r in decontam.find_leaks(more, benchmark).collect()}
    assert got == {(1000, 1): (0, 30, 49), (1000, 5): (0, 37, 38), (1001, 2): (1, 0, 49), (1002, 5): (0, 7, 8)}
    assert [r["doc_id"] for r in decontam.without_leaks(more, benchmark).collect()] == [1003]
    assert decontam.without_leaks(docs, benchmark).count() == docs.count()
    assert decontam.find_leaks(docs, benchmark.limit(0)).count() == 0


def test_warc(spark, monkeypatch):
    big = "<p>" + "x" * 200
    pages = spark.createDataFrame([(3, "u", big, 1), (1, None, big, 1), (2, "u\nv", "small", 1), (4, "u", "small", 1), (5, "u", None, 1), (6, "u", big, 1), (6, "u", big, 1), (None, "u", "é" * 60, 1)], "page_id long, url string, html string, digest int")
    got = sorted(((r["page_id"], r["payload_bytes"], r["payload_digest"], r["record_type"], r["refers_to"]) for r in warc.round_trip(pages).collect()), key=str)
    digest = lambda t: hashlib.sha256((t or "").encode()).hexdigest()
    want = [(1, 203, digest(big), "response", None)] + [(i, 203, digest(big), "revisit", 1) for i in (3, 6, 6)]
    want += [(i, 5, digest("small"), "response", None) for i in (2, 4)] + [(5, 0, digest(""), "response", None), (None, 120, digest("é" * 60), "response", None)]
    assert got == sorted(want, key=str)
    assert warc.round_trip(pages.limit(0)).count() == 0
    # a payload over an archive's size is an archive of its own, and archives are read by as many tasks
    monkeypatch.setattr(warc, "ARCHIVE_BYTES", 150)
    again = warc.round_trip(pages)
    assert sorted(map(tuple, again.collect()), key=str) == got
    assert again.rdd.getNumPartitions() >= 3


def test_chat_segments(spark, monkeypatch):
    rng = random.Random(3)
    turns = [(rng.choice([1, 1, 1, 2, 3, None]), i, rng.choice(["user", "Assistant ", "system", "tool", None]), rng.choice(["a", "", None])) for i in range(120)]
    turns += [(9, 0, "user", "hi"), (9, 0, "user", "hi"), (10, None, "assistant", "yo")]
    df = spark.createDataFrame([(*t, "x") for t in turns], "conv_id long, turn long, role string, text string, place string")
    whole = chat.format_conversations(df).collect()
    monkeypatch.setattr(chat, "SEGMENT", 5)
    monkeypatch.setattr(chat, "SEGMENT_CHARS", 3)
    cut = chat.format_conversations(df).collect()

    def joined(rows):
        out = collections.defaultdict(str)
        for r in sorted(rows, key=lambda r: r["place"]):
            out[r["conv_id"]] += r["rendered"]
        return out, {k: sum(r["cost"] for r in rows if r["conv_id"] == k) for k in out}

    assert len(whole) == len(cut) == len(turns)
    assert joined(whole)[1] == joined(cut)[1]
    for said in joined(cut)[0].values():
        roles = re.findall(r"<\|(system|user|assistant)\|>", said)
        assert roles[-1] == "assistant" and all(a != b for a, b in zip(roles, roles[1:], strict=False))
    assert chat.format_conversations(df.limit(0)).count() == 0


def test_empty_tables(spark, docs, labels):
    import public_tokenizers

    none = docs.limit(0)
    assert ngram_join.ngram_jaccard_join(none).count() == 0
    assert quality.quality_rules(none, labels).count() == 0
    assert ngram_lm.score_documents(none).count() == 0
    assert langid.identify_languages(none).count() == 0
    assert secrets_crf.secret_spans(none).count() == 0
    assert licenses.scan_licenses(none).count() == 0
    assert bpe.encode_digests(none, public_tokenizers.path("word_bpe_49k.json")).count() == 0


def test_pipeline(spark):
    """Stage by stage against plain versions: what stays, what is replaced, and the library's tokens."""
    import public_tokenizers
    from tokenizers import Tokenizer

    docs, labels = (spark.read.parquet(f"{SF}/{x}.parquet") for x in ("documents", "labels"))
    own, cutoffs = quality.fit_cutoffs(docs, labels)
    left = []
    for r in docs.collect():
        n, again, bins = bins_of(r["text"])
        stratum = "=" + r["lang"] if r["lang"] is not None and "=" + r["lang"] in own else quality.POOL
        bad = stratum in cutoffs and any(b >= c for b, c in zip(bins, cutoffs[stratum], strict=True))
        if n >= 50 and 100 * again <= 50 * n and not bad:
            left.append((r["doc_id"], r["text"]))
    comp, _ = components(left)
    left = [x for x in left if comp[x[0]] == x[0]]
    items = [WORD.findall(lower(r["text"])) for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]

    def holds(text):
        """By the least edit distance of each item that has enough words in common with the text."""
        w = WORD.findall(lower(text))
        number = {x: i for i, x in enumerate(dict.fromkeys(w))}
        for item in items:
            k = int(decontam.EDITS * len(item))
            if sum(x in number for x in item) >= len(item) - k and decontam.best_run([number.get(x, -1) for x in item], [number[x] for x in w])[0] <= k:
                return True
        return False

    left = [(i, t) for i, t in left if not holds(t)]
    field = secrets_crf.fit(spark.createDataFrame(left, "doc_id long, text string"))
    library = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    library.no_truncation()
    library.no_padding()
    want = {}
    for i, text in left:
        mask = [False] * len(text)
        for s, e, _ in [*secrets_crf.base_spans(text), *field.spans(text)]:
            mask[s:e] = [True] * (e - s)
        clean = "".join("[secret]" * (k == 0 or not mask[k - 1]) if mask[k] else c for k, c in enumerate(text))
        ids = library.encode(clean, add_special_tokens=False).ids
        digest = lambda x: hashlib.sha256(x).hexdigest()
        want[i] = len(ids), digest(b"".join(x.to_bytes(4, "little") for x in ids)), digest(library.decode(ids, skip_special_tokens=False).encode())
    got = {r["doc_id"]: (r["n_tokens"], r["ids_sha256"], r["decoded_sha256"]) for r in corpus_pipeline.run(spark, SF).collect()}
    assert got == want
    assert set(registered.queries()) >= {f"op{n}_" + x for n, x in ((1, "ngram_jaccard_join"), (9, "secret_scans"))}


def test_stages_on_odd_tables(spark, docs, labels):
    """Nulls, empty texts, repeated rows, extra columns with clashing names; then no rows at all."""
    odd = docs.withColumn("q_lang", F.lit("x")).withColumn("spot", F.lit(2)).withColumn("gone", F.lit(1)).withColumn("sig", F.lit(0))
    for table in (odd, odd.limit(0)):
        for name, stage in corpus_pipeline.STAGES[:-1]:
            out = stage(spark, table, SF)
            assert out.columns == odd.columns, name
            out.count()
        assert corpus_pipeline.STAGES[-1][1](spark, table, SF).count() == table.count()
    assert corpus_pipeline.near_duplicates(spark, odd.where("doc_id is null or text is null or text = ''"), SF).count() == odd.where("doc_id is null or text is null or text = ''").count()


def test_a_written_table_leaves_no_shuffle_files(spark):
    """They would stay until the driver's next garbage collection, on top of all that is written until then."""
    disk = spark._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager()
    left = lambda: {f for f in (disk.getAllFiles().apply(k).getPath() for k in range(disk.getAllFiles().size())) if "/shuffle_" in f}
    before, kept = left(), spark.conf.get(store.CLEANUP)
    counted = spark.range(1000).groupBy((F.col("id") % 7).alias("k")).agg(F.count(F.lit(1)).alias("n"))
    out = store.materialize(counted, "counted")
    for _ in range(50):
        if not left() - before:
            break
        time.sleep(0.1)
    assert not left() - before
    assert sorted(map(tuple, out.collect())) == sorted(map(tuple, counted.collect()))
    assert spark.conf.get(store.CLEANUP) == kept
