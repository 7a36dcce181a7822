"""Token counts, BPE, packing, quality, language, fingerprints and URL filters against brute force."""

import base64
import hashlib
import os
import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from sonorant.llm import bpe, fingerprints, langid, packing, quality, token_counts, url_filter
from sonorant.llm.queries import URL_RULES, pattern, vocabulary

BPE50, MULTI = vocabulary("byte_bpe_50k.tiktoken"), vocabulary("byte_bpe_multi_50k.tiktoken")
ODD = [None, "", " ", "\n\n", "don't we'll 'tis ''s", "a" * 5000, "é😀 ﷽ 12 ½", " 's\n's  'll", "x" * 300 + " " * 300, "<|endoftext|> text"]


def random_texts(n, alphabet="ab'stmdrevl1 \n\t.,!é  ''", seed=3):
    rng = random.Random(seed)
    return ["".join(rng.choice(alphabet) for _ in range(rng.randint(0, 60))) for _ in range(n)]


def test_pre_tokenisation_equals_the_library_on_random_texts_and_all_code_points():
    tiktoken = pytest.importorskip("tiktoken")
    known = tiktoken.Encoding("t", pat_str=pattern(), mergeable_ranks=bpe.load_ranks(MULTI), special_tokens={})
    points = [chr(c) for c in range(0x110000) if not 0xD800 <= c < 0xE000]
    texts = [*random_texts(3000), *[t or "" for t in ODD], *["x" + "".join(points[i : i + 50]) + " y" for i in range(0, len(points), 50)]]
    texts += [f"x{c}y 1{c}2 {c} !{c}" for c in points[:0x3100]]
    for text, ids in zip(texts, bpe.encode_texts(texts, MULTI), strict=True):
        assert np.frombuffer(ids, "<u4").tolist() == known.encode_ordinary(text)


def test_encode_and_decode_round_trip(docs_of):
    df = docs_of(ODD)
    for r in bpe.decode(bpe.encode(df, MULTI), MULTI).collect():
        assert bytes(r["decoded"]).decode() == (ODD[r["id"]] or "")
        assert len(r["ids"]) == len(r["ends"])
    assert bpe.encode(df.limit(0), MULTI).count() == 0


def test_token_counts_equal_greedy_matching(docs_of):
    vocabulary_ = {base64.b64decode(x.split()[0]) for x in open(BPE50, "rb")}
    most = max(map(len, vocabulary_))

    def greedy(word):
        n = i = 0
        while i < len(word):
            i += next(k for k in range(min(most, len(word) - i), 0, -1) if word[i : i + k] in vocabulary_)
            n += 1
        return n

    texts = [*random_texts(50), *ODD]
    for r in token_counts.token_counts(docs_of(texts), BPE50).collect():
        counts = [greedy(b" " + w) for w in (texts[r["id"]] or "").encode().split()]
        assert (r["n_words"], r["n_tokens"], r["longest"]) == (len(counts), sum(counts), max(counts, default=0))


def test_packing_is_whole_gapless_and_tight(docs_of):
    tokenizers = pytest.importorskip("tokenizers")
    rng = random.Random(1)
    texts = [" ".join("word" + str(rng.randrange(99)) for _ in range(rng.choice([3, 40, 200, 900]))) for _ in range(120)] + ODD
    got = packing.pack(packing.tokenised_pieces(docs_of(texts), BPE50, pattern(), 2), fan_in=2).toPandas()
    known = tokenizers.Tokenizer.from_file(vocabulary("byte_bpe_50k.json"))
    for i, t in enumerate(texts):
        ids = [*known.encode(t or "", add_special_tokens=False).ids, 2]
        mine = got[got.doc_id == i].sort_values("piece")
        assert mine.length.sum() == len(ids) and mine.piece.tolist() == list(range(len(mine)))
        assert (mine.length.iloc[1:] == 1024).all()
        for p in mine.itertuples():
            assert zlib.crc32(np.array(ids[p.start : p.start + p.length], "<u4").tobytes()) == p.ids_crc32
    s = got.sort_values(["sequence_id", "offset"])
    assert (s.groupby("sequence_id").length.cumsum() - s.length == s.offset).all()
    loads = s.groupby("sequence_id").length.sum()
    assert loads.max() <= 1024 and len(loads) <= len(packing.best_fit(got.length.to_numpy(), 1024)[2]) + 2


def test_best_fit_takes_the_fullest_bin_that_fits():
    bins, place, loads = packing.best_fit(np.array([600, 500, 400, 400, 100]), 1024)
    assert loads.tolist() == [1000, 1000] and bins.tolist() == [0, 1, 0, 1, 1] and place.tolist() == [0, 0, 600, 500, 900]


def test_quality_counts_trees_and_constraints(docs_of):
    def counts(text):
        words = re.findall(r"[^\x20\x09-\x0D]+", text)
        windows = [tuple(words[i : i + 8]) for i in range(len(words) - 7)]
        n, seen, dup, covered = Counter(windows), set(), 0, set()
        for line in text.split("\n"):
            if re.search(r"[^\x20\x09-\x0D]", line):
                dup += line in seen
                seen.add(line)
        for i, w in enumerate(windows):
            if n[w] > 1:
                covered |= set(range(i, i + 8))
        return [len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text)) if words else 0, dup, len(covered)]

    texts = [*random_texts(40), *ODD, "a b c d e f g h " * 5, "x y\nx y\n\n\nx y", "é #|é " * 30]
    for r in quality.judge(docs_of(texts), quality.grow(np.zeros((0, 14)), np.zeros(0))).collect():
        want = counts(texts[r["id"]] or "")
        if want[0]:
            assert [r[c] for c in quality.BASE] == want, texts[r["id"]]
        assert r["base_failed"] == (want[0] < 20 or 100 * want[4] > 30 * want[0])
    rng = np.random.default_rng(0)
    x = rng.random((800, len(quality.FEATURES)))
    y = (x[:, 2] + 0.3 * rng.random(800) < 0.6).astype(float)
    trees = quality.grow(x, y, rounds=20)
    assert ((trees.score(x) >= 0.5) == y).mean() > 0.9
    for f, sign in enumerate(quality.FEATURES.values()):
        if sign:
            line = np.repeat(x[:40], 30, axis=0)
            line[:, f] = np.tile(np.linspace(0, 1, 30), 40)
            assert (np.diff(trees.score(line).reshape(40, 30), axis=1) <= 1e-12).all()


def test_language_model_on_held_out_texts(docs_of, spark):
    words = {"aa": "the of and with that", "bb": "que los una para esa", "cc": "der und nicht ein mit"}
    rng = random.Random(2)
    rows = [(i, " ".join(rng.choice(words[lang].split()) for _ in range(12)), lang) for i in range(90) for lang in [list(words)[i % 3]]]
    docs = spark.createDataFrame([*rows, (900, None, "aa"), (901, "123 !", "aa"), (902, "the of", None)], "doc_id bigint, text string, lang string")
    model = langid.train(docs.where("doc_id % 3 = 0 OR doc_id < 60"))
    got = {r["id"]: (r["lang_pred"], r["score"]) for r in langid.predict(docs, model).collect()}
    assert all(got[i][0] == lang for i, _, lang in rows) and got[900] == got[901] == ("und", 0.0) and got[902][0] == "aa"
    assert all(0 <= s <= 1 for _, s in got.values())
    empty = langid.train(docs.limit(0))
    assert langid.predict(docs, empty).where("lang_pred <> 'und'").count() == 0


def test_fingerprints_of_edits_and_order(docs_of):
    rng = random.Random(5)
    texts = [" ".join(f"{rng.randrange(10**6):x}" for _ in range(rng.randint(30, 400))) for _ in range(30)] + [None, "", "a", "b" * 70_000]
    texts += [texts[3]]
    texts += [f"null {i} " * i for i in range(20)]
    ids = [*range(len(texts) - 22), 7, *[None] * 21]  # a tie and null ids
    df = docs_of(texts, ids)
    ranks = fingerprints.rarity(df)
    got = fingerprints.edited_likeness(df, ranks, parts=5).collect()
    h = lambda t: 42 if t is None else int(np.uint64(xxhash.xxh64_intdigest(t.encode(), 42)).view(np.int64))
    order = sorted(range(len(texts)), key=lambda i: (ids[i] is None, -(ids[i] or 0), h(texts[i]), texts[i] or ""))
    want = []
    for k, i in enumerate(order):
        a, b = texts[i] or "", texts[order[(k + 1) % len(order)]] or ""
        want.append((ids[i], len(a), hashlib.sha256((a[: len(a) - len(a) // 2] + b[: len(a) // 2]).encode()).hexdigest()))
    assert sorted(map(str, want)) == sorted(str((r["id"], r["n_chars"], r["edited_sha256"])) for r in got)
    long = [r for r in got if r["n_chars"] > 200 and r["id"] != 33]
    assert sum(r["near_edited"] > r["near_next"] for r in long) >= len(long) - 2
    assert all(0 <= r[c] <= 1 for r in got for c in ("near_edited", "near_next"))
    a, b = (fingerprints.parse(fingerprints.digest(t.encode(), ranks)[0]) for t in (texts[0], texts[0]))
    assert fingerprints.likeness(a, b) == 1.0
    assert fingerprints.edited_likeness(df.where("doc_id = 0"), ranks, parts=3).first()["near_next"] == 1.0


def test_url_rules_and_model(spark):
    urls = [
        ("https://A.Example.com/en/7?x", "allow", "example.com/en/7"), ("http://b.com/en/1", "block", "com/en/"), ("http://notcom/en/1", None, None),
        ("ftp://x.net/de/1#a", "allow", "net/de/"), ("http://example.net/de/8", "block", "example.net/de/8"), (None, None, None), ("no scheme", None, None),
        ("http://h.org?a=/es/", None, None), ("http://casino-bonus.io/win/free-spins", "block", None), ("http://library.io/about/history", "allow", None),
    ]
    df = spark.createDataFrame([(i, u, "x") for i, (u, *_) in enumerate(urls)], "page_id bigint, url string, host string")
    got = {r["id"]: r for r in url_filter.judge(df, URL_RULES, url_filter.default_labels(spark)).collect()}
    for i, (u, verdict, rule) in enumerate(urls):
        assert got[i]["rule"] == rule and (verdict is None or got[i]["verdict"] == verdict), u
    assert (got[0]["host"], got[0]["path"]) == ("a.example.com", "/en/7") and (got[5]["host"], got[6]["path"]) == ("", "")
    assert (got[7]["host"], got[7]["path"]) == ("h.org", "")
    none = url_filter.default_labels(spark).limit(0)
    assert url_filter.judge(df, [], none).where("verdict = 'block'").count() == 0


def test_many_rules_equal_a_plain_scan(spark):
    """Thousands of rules of many shapes, a very long url, repeated and null urls."""
    rng = random.Random(3)
    part = lambda: rng.choice(["a", "b", "example", "com", "net", "x-y"])
    rules = [(".".join(part() for _ in range(rng.randint(1, 3))), "/" + "".join(rng.choice("ab/") for _ in range(rng.randint(0, 7))), rng.choice(["allow", "block"])) for _ in range(3000)]
    urls = [f"http://{'.'.join(part() for _ in range(rng.randint(1, 5)))}/{''.join(rng.choice('ab/') for _ in range(rng.randint(0, 9)))}" for _ in range(400)]
    urls += [urls[0]] * 50 + [None, "", "nothing", "http://" + "a." * 3000 + "com/" + "ab/" * 20_000]
    df = spark.createDataFrame(list(enumerate(urls)), "page_id bigint, url string")
    for table in (rules, spark.createDataFrame(rules, "host string, path string, verdict string")):
        got = {r["id"]: r for r in url_filter.judge(df, table, url_filter.default_labels(spark).limit(0)).collect()}
        assert len(got) == len(urls)
    hits = 0
    for i, u in enumerate(urls):
        host, path = got[i]["host"], got[i]["path"]
        assert ((u or "").partition("://")[2] == host + path) and u != "" or (host, path) == ("", "")
        fits = [(-len(h + p), h, p, v) for h, p, v in rules if (host == h or host.endswith("." + h)) and path.startswith(p)]
        want = min(fits, default=None)
        assert (got[i]["rule"], got[i]["verdict"]) == ((want[1] + want[2], want[3]) if want else (None, "allow")), u
        hits += want is not None
    assert hits > 200


def test_hashed_grams_equal_a_plain_count(spark):
    """The model's features: distinct 3- to 5-grams of host and path between end marks, hashed."""
    df = spark.createDataFrame([("https://Ab.com/x1é",), ("http://h",), (None,)], "url string")
    rows = url_filter._featured(url_filter._split(df, "url")).select("_grams", "_features").collect()

    def grams(text, mark):
        text = f"^{text}$" if text else ""
        return [mark + text[i : i + n] for n in (3, 4, 5) for i in range(len(text) - n + 1)]
    for r, (host, path) in zip(rows, [("ab.com", "/x1é"), ("h", ""), ("", "")], strict=True):
        assert sorted(r["_grams"]) == sorted(grams(host, "h") + grams(path, "p"))
        assert set(r["_features"].values) <= {1.0} and len(r["_features"].indices) <= len(set(r["_grams"]))


def test_held_out_words(spark):
    """Words of either kind that stand in no url of the fit: what is left are their companions and paths, which tell little."""
    labels = url_filter.default_labels(spark).cache()
    words = [(w, 1.0) for w in url_filter.BLOCK_WORDS[::4]] + [(w, 0.0) for w in url_filter.ALLOW_WORDS[::4]]
    out = F.lit(False)
    for w, _ in words:
        out = out | F.contains("url", F.lit(w))
    held = labels.where(out).withColumn("page_id", F.monotonically_increasing_id()).cache()
    got = url_filter.judge(held, [], labels.where(~out)).join(held.withColumnRenamed("page_id", "id"), "id").selectExpr("verdict = 'block' AS b", "label = 1 AS t").collect()
    clean = [r["b"] for r in got if not r["t"]]
    assert len(got) > 100 and sum(clean) <= 0.1 * len(clean)  # an unknown word is no reason to block


SMALL = "/root/testdata/sf0.01"


def test_follow_the_regularised_leader_steps_equal_plain_loops(monkeypatch):
    monkeypatch.setattr(langid, "BUCKETS", 12)
    rng = np.random.default_rng(4)
    rows = [(np.sort(rng.choice(12, 4, replace=False)), rng.random(4).astype(np.float32)) for _ in range(25)]
    y = rng.integers(0, 3, 25)
    alpha, beta, l1, l2 = 1.0, 1.0, 0.02, 0.02
    z, n = [[0.0] * 3 for _ in range(12)], [[0.0] * 3 for _ in range(12)]

    def w(i, k):
        return 0.0 if abs(z[i][k]) <= l1 else -(z[i][k] - np.sign(z[i][k]) * l1) / ((beta + n[i][k] ** 0.5) / alpha + l2)

    order = np.random.default_rng(0)
    for _ in range(3):
        for r in order.permutation(25):
            index, x = rows[r]
            now = [[w(i, k) for k in range(3)] for i in index]
            e = [np.exp(sum(float(v) * row[k] for v, row in zip(x, now, strict=True))) for k in range(3)]
            for a, i in enumerate(index):
                for k in range(3):
                    g = float(x[a]) * (e[k] / sum(e) - (y[r] == k))
                    sigma = ((n[i][k] + g * g) ** 0.5 - n[i][k] ** 0.5) / alpha
                    z[i][k] += g - sigma * now[a][k]
                    n[i][k] += g * g
    assert np.allclose(langid.ftrl(rows, y, 3), [[w(i, k) for k in range(3)] for i in range(12)], atol=1e-5)


def test_temperature_lowers_the_loss():
    rng = np.random.default_rng(1)
    logits, y = 8 * rng.normal(size=(300, 4)), rng.integers(0, 4, 300)
    y[:150] = logits[:150].argmax(axis=1)

    def loss(t):
        z = logits / t
        return float((np.log(np.exp(z - z.max(1, keepdims=True)).sum(1)) + z.max(1) - z[np.arange(300), y]).mean())

    best = langid.temperature(logits, y)
    assert all(loss(best) <= loss(t) + 1e-6 for t in (0.05, 0.5, 1.0, 3.0, 10.0, best * 1.1, best / 1.1))


@pytest.mark.skipif(not os.path.isdir(SMALL), reason="no fixtures")
def test_languages_and_quality_of_held_out_documents(spark):
    docs = spark.read.parquet(f"{SMALL}/documents.parquet")
    held = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 3 == 1
    found = langid.predict(docs, langid.train(docs.where(~held))).withColumnRenamed("id", "doc_id").join(docs.where(held & F.col("lang").isNotNull() & F.col("text").rlike("[a-z]{3}")), "doc_id")
    assert found.where("lang_pred = lang").count() >= 0.98 * found.count() > 100
    labels = spark.read.parquet(f"{SMALL}/labels.parquet")
    test = F.pmod(F.xxhash64("doc_id"), F.lit(4)) == 0
    judged = quality.judge(docs, quality.train(docs, labels.where(~test))).withColumnRenamed("id", "doc_id").join(labels.where(test), "doc_id")
    assert judged.where("kept = (quality = 1)").count() >= 0.9 * judged.count() > 50


def test_flattened_trees_equal_a_walk_from_the_root():
    rng = np.random.default_rng(3)
    x = rng.random((300, len(quality.FEATURES)))
    trees = quality.grow(x, (x[:, 0] + x[:, 5] > 1).astype(float), rounds=12)

    def walk(row, t, node=0):
        inner = trees.feature.shape[1]
        if node >= inner:
            return trees.leaf[t, node - inner]
        return walk(row, t, 2 * node + 1 + (row[trees.feature[t, node]] > trees.threshold[t, node]))

    want = [1 / (1 + np.exp(-(trees.start + sum(walk(row, t) for t in range(len(trees.leaf)))))) for row in x]
    assert np.allclose(trees.score(x), want)


def plain_features(text, ranks):
    """The selected windows of a text by definition, each once, in text order."""
    data = text.ljust(16, b"\0") if text else b""
    windows = [data[i : i + 16] for i in range(len(data) - 15)]
    if not windows:
        return []

    def tie(w):
        h = [(b * 0x9E3779B1) % 2**32 for b in w]
        step = 1
        while step < 16:
            h = [((h[i] ^ h[i] >> 15) * 0x85EBCA77 + h[i + step]) % 2**32 for i in range(len(h) - step)]
            step *= 2
        return (h[0] * 0xC2B2AE3D) % 2**32 >> 10

    keys = [(ranks[sum(c * (c - 1) // 2 for c in Counter(w).values())], tie(w), i) for i, w in enumerate(windows)]
    span = max(1, min(64, len(keys) // 8))
    points = Counter(min(keys[i : i + span])[2] for i in range(len(keys) - span + 1))
    least = min(span // 4, max(points.values()))
    return list(dict.fromkeys(windows[i] for i in sorted(points) if points[i] >= least))


def test_fingerprint_features_filters_and_likeness_equal_their_definitions(docs_of):
    rng = random.Random(11)
    words = ["the", "of", "aaaa", "zebra", "\u00e9t\u00e9", "12", "xyzxyz"]
    texts = [" ".join(rng.choice(words) for _ in range(rng.choice([1, 3, 20, 90, 400]))) for _ in range(25)] + ["", "a", "b" * 300, "0123456789abcdef"]
    ranks = fingerprints.rarity(docs_of(texts))
    count = Counter()
    for t in texts:
        data = t.encode().ljust(16, b"\0") if t else b""
        count.update(sum(c * (c - 1) // 2 for c in Counter(data[i : i + 16]).values()) for i in range(len(data) - 15))
    assert [int(x) for x in np.argsort(ranks)] == sorted(range(fingerprints.LEVELS), key=lambda lv: (count[lv], lv))
    chains = []
    for t in texts:
        want = plain_features(t.encode(), ranks)
        hashes = fingerprints.feature_hashes(t.encode(), ranks)
        alone = [int(fingerprints.feature_hashes(w, ranks)[0]) for w in want]
        assert hashes.tolist() == alone
        bits = [set() for _ in range(-(-len(want) // 80))]
        for i, h in enumerate(alone):
            bits[i // 80] |= {(h >> 12 * k) % 1024 for k in range(5)}
        assert [set(np.flatnonzero(row).tolist()) for row in fingerprints.filters(hashes)] == bits
        chains.append((fingerprints.filters(hashes), bits))
    for _ in range(200):
        (fa, a), (fb, b) = rng.choice(chains), rng.choice(chains)
        small, large = (a, b) if len(a) <= len(b) else (b, a)
        best = []
        for x in small:
            scores = [0.0]
            for y in large:
                chance, most = len(x) * len(y) / 1024, min(len(x), len(y))
                floor = chance + 0.3 * (most - chance)
                scores.append(min(1.0, max(0.0, (len(x & y) - floor) / max(most - floor, 1e-9))))
            best.append(max(scores))
        want = 1.0 if a == b else sum(best) / len(best) if best else 0.0
        assert abs(fingerprints.likeness(fa, fb) - want) < 1e-5


def test_both_tokenisers_agree_on_every_code_point():
    tokenizers = pytest.importorskip("tokenizers")
    known = tokenizers.Tokenizer.from_file(vocabulary("byte_bpe_50k.json"))
    mine = packing._encoding(BPE50, pattern(), "<|endoftext|>", 50256)
    points = [chr(c) for c in range(0x110000) if not 0xD800 <= c < 0xE000]
    texts = ["x" + "".join(points[i : i + 40]) + " y" for i in range(0, len(points), 40)] + [f"a{c} {c}1{c}{c}" for c in points[:0x2100]]
    for text, ids in zip(texts, known.encode_batch(texts, add_special_tokens=False), strict=True):
        assert mine.encode_ordinary(text) == ids.ids


def test_another_pattern_is_refused(docs_of):
    assert pattern() == bpe.PATTERN
    with pytest.raises(ValueError, match="pattern"):
        bpe.encode(docs_of(["a"]), MULTI, r"\w+")


def test_long_words_are_not_remembered():
    known = bpe.Memo(bpe.load_ranks(MULTI))
    assert known[b"x" * 65] and b"x" * 65 not in known and known[b"x" * 64] and b"x" * 64 in known
    counts = token_counts.Automaton([bytes([b]) for b in range(256)])
    assert counts[b"y" * 100] == 101 and b"y" * 100 not in counts


def test_empty_tables_repeated_rows_long_texts_and_clashing_names(spark):
    names = ["id", "words", "features", "score", "n_words", "part", "after", "bin", "filled", "piece"]
    schema = "doc_id bigint, text string, lang string, " + ", ".join(f"{c} int" for c in names)
    long = "word of the day, " * 60_000
    docs = spark.createDataFrame([(i, t, "aa", *range(len(names))) for i, t in [(1, long), (1, long), (2, "b " * 30), (None, None), (3, "")]], schema)
    labels = spark.createDataFrame([(1, 1), (2, 0)], "doc_id bigint, quality int")
    none, trees, model = docs.limit(0), quality.train(docs, labels), langid.train(docs)
    ranks = fingerprints.rarity(docs)
    for run in (
        lambda d: token_counts.token_counts(d, BPE50), lambda d: quality.judge(d, trees), lambda d: langid.predict(d, model),
        lambda d: fingerprints.fingerprints(d, ranks), lambda d: fingerprints.edited_likeness(d, ranks, parts=2), lambda d: bpe.decode(bpe.encode(d, MULTI), MULTI),
    ):
        rows = run(docs).collect()
        assert len(rows) == 5 and len({str(r) for r in rows if r["id"] == 1}) <= 2 and run(none).count() == 0
    packed = packing.pack(packing.tokenised_pieces(docs, BPE50, pattern(), 2))
    pieces = packed.groupBy("doc_id").sum("length").collect()
    assert len(pieces) == 4 and packing.pack(packing.tokenised_pieces(none, BPE50, pattern(), 2)).count() == 0
    assert quality.kept(docs, trees).columns == docs.columns and quality.kept(none, trees).count() == 0
    with pytest.raises(TypeError):
        fingerprints.edited_likeness(docs.withColumn("doc_id", F.lit("a")), ranks)


def test_urls_nobody_has_seen(spark):
    """A fifth of the table is left out of the fit and judged; then hosts of neither table."""
    labels = url_filter.default_labels(spark).cache()
    assert 500 < labels.count() < 1000
    part = F.pmod(F.xxhash64("url"), F.lit(5)) == 0
    urls = labels.where(part).withColumn("page_id", F.monotonically_increasing_id()).cache()
    got = url_filter.judge(urls, [], labels.where(~part)).join(urls.withColumnRenamed("page_id", "id"), "id")
    right = got.where((F.col("verdict") == "block") == (F.col("label") == 1)).count()
    assert right >= 0.9 * urls.count()
    fresh = [f"https://{s}.example.com/en/{i}" for i, s in enumerate(["blog.tionsh", "www.ththon", "m.ththha", "tiontion", "quorvex", "lumeris"])]
    bad = ["https://m.casino-win.example.com/en/3", "http://cheap-pills.example.net/de/1", "https://pokerworld.io/", "http://best-torrent.net/x"]
    df = spark.createDataFrame(list(enumerate([*fresh, *bad])), "page_id bigint, url string")
    verdicts = {r["id"]: r["verdict"] for r in url_filter.judge(df, [], labels).collect()}
    assert [verdicts[i] for i in range(len(fresh))] == ["allow"] * len(fresh) and [verdicts[len(fresh) + i] for i in range(len(bad))] == ["block"] * len(bad)
