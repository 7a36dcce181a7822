import random
import re

import numpy as np
import xxhash

from sonorant.llm import simhash as S


def fingerprint(text, width=4):
    low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    words = re.findall(r"[^\x20\x09-\x0D]+", low)
    shingles = [" ".join(words[i : i + width]) for i in range(max(1, len(words) - width + 1))] if words else []
    h = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h)) if h else 0


def components(n, linked):
    root = list(range(n))
    changed = True
    while changed:
        changed = False
        for i in range(n):
            low = min(root[j] for j in range(n) if j == i or linked(i, j))
            if low < root[i]:
                root[i], changed = low, True
    return root


def variants(rng, n):
    base = [" ".join(f"w{rng.randrange(400)}" for _ in range(rng.randint(30, 200))) for _ in range(n)]
    out = []
    for b in base:
        w = b.split()
        for _ in range(3):
            v = list(w)
            v[rng.randrange(len(v))] = "edit"
            out.append(" ".join(v))
    return base + out


def test_near_duplicates_equal_brute_force(docs_of):
    rng = random.Random(7)
    texts = [*variants(rng, 12), None, "", " \t\n", "one", "One", "two words", "É Ü ünder", "x" * 40_000, "long " * 30_000]
    ids = [rng.randrange(10**9) * 2 + 1 for _ in texts]
    rows = {r["id"]: (r["fingerprint"], r["component_id"]) for r in S.near_duplicates(docs_of(texts, ids)).collect()}
    fps = [fingerprint(t) for t in texts]
    order = sorted(range(len(texts)), key=ids.__getitem__)
    root = components(len(order), lambda i, j: bin(fps[order[i]] ^ fps[order[j]]).count("1") <= 4)
    want = {ids[order[i]]: (f"{fps[order[i]]:016x}", ids[order[r]]) for i, r in enumerate(root)}
    assert rows == want


def test_bit_sliced_links_equal_pairwise_distances_for_whole_and_split_groups():
    rng = np.random.default_rng(0)
    base = rng.integers(0, 2**63, 60, dtype=np.uint64)
    flips = np.array([sum(1 << int(b) for b in rng.integers(0, 64, rng.integers(1, 7))) for _ in range(240)], np.uint64)
    fps = np.unique(np.r_[base, base[rng.integers(0, 60, 240)] ^ flips])
    near = np.bitwise_count(fps[:, None] ^ fps[None, :])
    for radius in (0, 1, 4, 8):
        for side in (np.zeros(len(fps), int), np.sort(rng.integers(1, 3, len(fps)))):
            a, b = S._compare(fps, side, np.zeros(len(fps), int), radius, forest=False)
            want = {(i, j) for i, j in zip(*np.nonzero(near <= radius), strict=True) if i < j and (side[i] == 0 or side[i] != side[j])}
            assert {(min(i, j), max(i, j)) for i, j in zip(a.tolist(), b.tolist(), strict=True)} == want


def test_split_keys_find_the_same_links(spark):
    rng = np.random.default_rng(1)
    base = int(rng.integers(0, 2**62))
    fps = sorted({base} | {base ^ (1 << int(a)) ^ (1 << int(b)) for a, b in rng.integers(0, 63, (150, 2))})
    df = spark.createDataFrame([(f,) for f in fps], "fp bigint")
    whole = {frozenset(p) for p in S.connected_components(S.links(df, 4, chunk=10_000)).collect()}
    split = {frozenset(p) for p in S.connected_components(S.links(df, 4, chunk=16)).collect()}
    assert whole == split and len(whole) == len(fps) - 1


def test_every_block_plan_covers_the_radius():
    rng = np.random.default_rng(2)
    for n in (10, 10**6, 10**9, 10**11):
        blocks, match = S.block_plan(n, 4)
        masks = [m % 2**64 for _, m in S._keys(blocks, match)]
        for _ in range(200):
            d = sum({1 << int(b) for b in rng.integers(0, 64, 4)})
            assert any(not d & m for m in masks)


def jaccard(a, b):
    def shingles(t):
        w = t.lower().split()
        return {" ".join(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set()

    x, y = shingles(a), shingles(b)
    return len(x & y) / len(x | y) if x | y else 1.0


def test_one_document_of_each_group_stays(docs_of):
    rng = random.Random(9)
    texts = [*variants(rng, 10), "", "", "same words here twice", "same  words here twice"]
    df = docs_of(texts)
    kept = {r["doc_id"] for r in S.first_of_groups(df).collect()}
    root = components(len(texts), lambda i, j: jaccard(texts[i], texts[j]) >= 0.8)
    assert kept == set(root)
    assert S.first_of_groups(df).columns == df.columns
    assert S.first_of_groups(df.limit(0)).count() == 0
    twice = df.where("doc_id = 0").unionByName(df.where("doc_id = 0"))
    assert S.first_of_groups(twice).count() == 1


def test_components_of_a_long_chain(spark):
    n = 200
    order = random.Random(3).sample(range(n), n)
    edges = spark.createDataFrame(list(zip(order, order[1:], strict=False)) + [(None, 1), (5, 5)], "a bigint, b bigint")
    assert {tuple(r) for r in S.connected_components(edges).collect()} == {(i, 0) for i in range(1, n)}
    assert S.connected_components(edges.limit(0)).count() == 0


def test_lengthened_and_cut_copies_are_found_at_every_length(docs_of):
    rng = random.Random(5)
    texts = []
    for n in (20, 40, 60, 100, 200, 300):
        for share in (0.1, 0.15, 0.2, 0.3):
            for cut in (False, True):
                for _ in range(3):
                    w = [f"w{rng.randrange(10**6)}" for _ in range(n)]
                    more = [f"w{rng.randrange(10**6)}" for _ in range(int(n * share))]
                    texts += [" ".join(w), " ".join(w[: n - len(more)] if cut else w + more)]
    kept = {r["doc_id"] for r in S.first_of_groups(docs_of(texts)).collect()}
    gone = {i + 1 for i in range(0, len(texts), 2) if jaccard(texts[i], texts[i + 1]) >= 0.8}
    assert len(gone) > 40 and kept == set(range(len(texts))) - gone


def test_scattered_edits_null_ids_and_clashing_names(spark):
    rng = random.Random(15)
    texts, ids = [], []
    for k in range(40):
        w = [f"w{rng.randrange(10**6)}" for _ in range(rng.randint(40, 250))]
        b = list(w)
        for at in rng.sample(range(len(w)), len(w) // 60 + 1):
            b[at] = "edited"
        texts += [" ".join(w), " ".join(b)]
        ids += [None, None] if k % 2 else [2 * k, 2 * k + 1]
    names = ["_own", "row", "id", "h", "h2", "node", "component", "first"]
    docs = spark.createDataFrame([(i, t, *range(len(names))) for i, t in zip(ids, texts, strict=True)], "doc_id bigint, text string, " + ", ".join(f"{c} int" for c in names))
    kept = [r["text"] for r in S.first_of_groups(docs).collect()]
    linked = [jaccard(texts[i], texts[i + 1]) >= 0.8 for i in range(0, len(texts), 2)]
    assert sum(linked) > 20 and len(kept) == len(texts) - sum(linked)
    for k, near in enumerate(linked):
        pair = [t in kept for t in texts[2 * k : 2 * k + 2]]
        assert pair.count(True) == 2 - near and (ids[2 * k] is None or pair[0])
    assert S.first_of_groups(docs).columns == docs.columns


def test_texts_of_one_template_stay(docs_of):
    rng = random.Random(16)
    body = [f"t{i}" for i in range(60)]
    texts = [" ".join([*body, *(f"own{rng.randrange(10**6)}" for _ in range(40))]) for _ in range(60)]
    assert S.first_of_groups(docs_of(texts)).count() == 60


def test_repeated_rows_and_empty_tables_of_fingerprints(docs_of):
    df = docs_of(["a b c d e", "a b c d e", None, "", None], ids=[7, 7, None, 3, 2])
    got = sorted((r["id"] or -1, r["component_id"]) for r in S.near_duplicates(df).collect())
    assert got == [(-1, 2), (2, 2), (3, 2), (7, 7), (7, 7)]
    assert S.near_duplicates(df.limit(0)).count() == 0


def test_parity_maps_never_reject_and_units_may_be_small(spark, docs_of, monkeypatch):
    rng = np.random.default_rng(5)
    rows = []
    for n in (1, 30, 300, 2500):
        one = rng.integers(0, 2**63, n).astype(np.uint64)
        two = np.unique(np.concatenate([one[: max(1, int(n * 0.9))], rng.integers(0, 2**63, n // 10).astype(np.uint64)]))
        other = np.unique(rng.integers(0, 2**63, n + 5).astype(np.uint64))
        for a, b in ((one, two), (one, other)):
            x, y = S.parity_map(np.unique(a))[1:], S.parity_map(np.unique(b))[1:]
            while len(x) != len(y):
                x, y = (x, y) if len(x) > len(y) else (y, x)
                x = x[: len(x) // 2] ^ x[len(x) // 2 :]
            rows.append((np.bitwise_count(x ^ y).sum(), len(np.setxor1d(a, b))))
    assert all(bound <= apart for bound, apart in rows) and rows[-1][0] > 0.5 * rows[-1][1]
    words = [f"w{k}" for k in range(4000)]
    texts = []
    for k in range(12):
        base = list(rng.choice(words, 60 + 40 * k))
        texts += [" ".join(base), " ".join([*base[:-2], "other", "end"]), " ".join(base[::-1])]
    docs = docs_of(texts)
    want = sorted(r["doc_id"] for r in S.first_of_groups(docs).collect())
    monkeypatch.setattr(S, "LOT", 3000)
    monkeypatch.setattr(S, "PAIRS", 2)
    assert sorted(r["doc_id"] for r in S.first_of_groups(docs).collect()) == want and len(want) == 24
