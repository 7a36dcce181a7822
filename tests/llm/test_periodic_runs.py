"""Runs against a scan of all periods, ranks and extensions against plain sorting, and the registered query against its contract."""

import hashlib
import random
import zlib

import numpy as np
import pytest

from sonorant.llm import periodic_runs as P
from sonorant.llm import queries as Q


def brute(w, least=6, exponent=4):
    """Maximal stretches of each period, without those of a smaller one."""
    out, n = [], len(w)
    for p in range(1, n // exponent + 1):
        i = 0
        while i + p < n:
            first = i
            while i + p < n and w[i] == w[i + p]:
                i += 1
            length = i + p - first
            if i > first and length >= max(least, exponent * p) and not any(w[first : first + length - q] == w[first + q : first + length] for q in range(1, p)):
                out.append((first, length, p))
            i += i == first
    return sorted(out, key=lambda r: (r[0], r[2]))


def periodic_words(rng, n, kinds):
    w = [rng.randrange(kinds) for _ in range(n)]
    for _ in range(rng.randrange(3)):
        if n > 8:
            a, p = rng.randrange(n), rng.randint(1, 9)
            b = rng.randint(a, n)
            w[a:b] = [w[a + (i - a) % p] if a + (i - a) % p < n else 0 for i in range(a, b)]
    return w


def test_runs_equal_a_scan_of_all_periods():
    rng = random.Random(1)
    for _ in range(150):
        least, exponent = rng.choice([(6, 4), (1, 2), (2, 3), (9, 2)])
        docs = [periodic_words(rng, rng.choice([0, 1, 2, 7, 40, 130]), rng.randint(1, 5)) for _ in range(rng.randint(1, 5))]
        got = P.find([P.numbered([b"%d" % x for x in d]) for d in docs], least, exponent)
        assert [[tuple(r) for r in f.tolist()] for f in got] == [brute(d, least, exponent) for d in docs]


def test_a_long_document_of_few_periods():
    w = [1, 2, 3] * 4000 + [9] + [4] * 5000 + [5, 6] * 3
    assert [tuple(r) for r in P.find([P.numbered([b"%d" % x for x in w])], 6, 4)[0].tolist()] == [(0, 12000, 3), (12001, 5000, 1)]


def test_ranks_next_values_and_extensions():
    rng = np.random.default_rng(2)
    for n in (1, 2, 31, 32, 33, 200):
        w = np.r_[rng.integers(1, 3, n), 0]
        order = sorted(range(n + 1), key=lambda i: w[i:].tolist())
        rank = P.suffix_ranks(w, 4)
        assert [int(rank[i]) for i in order] == list(range(n + 1))
        after = P.next_smaller(rank)
        assert after.tolist() == [next((j for j in range(i + 1, n + 1) if rank[j] < rank[i]), n + 1) for i in range(n + 1)]
        i, j = np.triu_indices(n, 1)
        common = [next((k for k in range(n - b) if w[a + k] != w[b + k]), n - b) for a, b in zip(i.tolist(), j.tolist(), strict=True)]
        assert P.Extensions(w[:n], np.argsort(np.argsort(rank[:n])))(i, j).tolist() == common


def test_operator_takes_nulls_repeats_and_no_rows(spark, docs_of):
    rows = {r["id"]: r for r in P.periodic_runs(docs_of([None, "", " \n\t", "a b " * 9, "a b " * 9, "x", "no  run\there"])).collect()}
    assert [rows[k]["n_words"] for k in range(7)] == [0, 0, 0, 18, 18, 1, 3]
    assert [tuple(x) for x in rows[3]["runs"]] == [(0, 18, 2)] == [tuple(x) for x in rows[4]["runs"]] and rows[3]["collapsed"] == "a b"
    assert rows[6]["collapsed"] == "no run here" and rows[0]["collapsed"] == rows[2]["collapsed"] == "" and not rows[0]["runs"]
    assert P.periodic_runs(docs_of([])).collect() == []
    with pytest.raises(ValueError, match="twice"):
        P.periodic_runs(docs_of([]), exponent=1)


def test_batches_are_cut_at_any_place(spark, docs_of, monkeypatch):
    rng = random.Random(4)
    docs = docs_of([" ".join(f"w{x}" for x in periodic_words(rng, rng.randrange(60), 3)) for _ in range(40)]).coalesce(1)
    want = sorted(P.periodic_runs(docs).collect())
    monkeypatch.setattr(P, "WORDS", 30)
    assert sorted(P.periodic_runs(docs).collect()) == want and sum(len(r["runs"]) for r in want) > 3


def test_the_query_reads_its_contract(spark, tmp_path):
    rng = random.Random(6)
    texts = [" ".join(f"wört{x}" for x in periodic_words(rng, rng.choice([0, 3, 30, 200]), rng.choice([3, 500]))) for _ in range(150)] + [None, "\x0b a\xa0b \n c", ""]
    spark.createDataFrame([*enumerate(texts), (None, "a " * 30)], "doc_id bigint, text string").write.parquet(f"{tmp_path}/documents.parquet")
    got = {r["doc_id"]: r for r in Q.op11_runs(spark, str(tmp_path)).collect()}
    changed = 0
    for k, text in [*enumerate(texts), (None, "a " * 30)]:
        words = [w.decode() for w in (text or "").encode().split()]
        n, h = len(words), 1 if k is None else zlib.crc32(str(k).encode())
        g = h // 10
        if h % 10 == 0 and n:
            a = g % n
            p = 1 + (n - a) // (3 + g % 8)
            words, changed = [w if i < a else words[a + (i - a) % p] for i, w in enumerate(words)], changed + 1
        found = brute(words)
        gone = {i for s, length, p in found for i in range(s + p, s + length)}
        best = min(found, key=lambda r: (-r[1], r[0], r[2]), default=None)
        sha = lambda x: hashlib.sha256(x.encode()).hexdigest()
        want = (len(found), *(best or (None,) * 3), best and 1000 * best[1] // best[2], sha("".join(f"{s},{length},{p}\n" for s, length, p in found)), sha(" ".join(w for i, w in enumerate(words) if i not in gone)))
        assert tuple(got[k])[1:] == want, k
    assert changed > 8 and sum(r["n_runs"] for r in got.values()) > 20
