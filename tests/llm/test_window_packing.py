"""Online packing: every id in one piece, gapless full windows, powers of two at the end."""

import random
import zlib
from collections import defaultdict

import numpy as np
import pytest

from sonorant.llm import queries as Q
from sonorant.llm import window_packing as W


def test_windows_are_full_and_hold_every_id_once():
    rng = random.Random(2)
    for capacity, most in ((8, 1), (16, 3), (64, 8)):
        emitted = []
        windows = W.Windows(capacity, most, emitted.append)
        lengths = [rng.randint(1, 3 * capacity) for _ in range(300)]
        for k, n in enumerate(lengths):
            windows.add(k, 0, np.arange(n, dtype="<u4"), n)
            assert windows.open <= most
        rest = windows.merge()
        assert all(sum(len(p[2]) for p in w) == capacity for w in emitted) and len(rest) <= 1
        tail = [t for w in rest for t in W.powers_of_two(w)]
        assert [sum(len(p[2]) for p in w) for w in tail] == [1 << b for b in range(capacity.bit_length(), -1, -1) if sum(lengths) % capacity >> b & 1]
        pieces = defaultdict(list)
        for w in emitted + tail:
            for doc, start, ids, n in w:
                assert len(ids) and n == lengths[doc]
                pieces[doc].append((start, ids.tolist()))
        assert all(sum((x for _, x in sorted(pieces[k])), []) == list(range(n)) for k, n in enumerate(lengths))
        assert all(start == ids[0] for p in pieces.values() for start, ids in p)


def test_a_document_goes_where_it_fits_best_and_the_fullest_leaves():
    out = []
    windows = W.Windows(10, 2, out.append)
    ids = lambda n: np.zeros(n, "<u4")
    windows.add("a", 0, ids(6), 6)
    windows.add("b", 0, ids(7), 7)
    windows.add("c", 0, ids(3), 3)  # fits both, best beside b
    assert [[p[0] for p in w] for w in out] == [["b", "c"]]
    windows.add("d", 0, ids(8), 8)
    windows.add("e", 0, ids(5), 5)  # fits neither: the fullest is d
    assert [(p[0], p[1], len(p[2])) for p in out[1]] == [("d", 0, 8), ("e", 0, 2)]
    assert sorted((p[0], p[1], len(p[2])) for w in windows.merge() for p in w) == [("a", 0, 6), ("e", 2, 3)]


@pytest.mark.parametrize("parts", [1, 7])
def test_query_rows_against_the_tokeniser(spark, tmp_path, parts):
    tokenizers = pytest.importorskip("tokenizers")
    known = tokenizers.Tokenizer.from_file(Q.vocabulary("byte_bpe_50k.json"))
    rng = random.Random(9)
    word = lambda: rng.choice(["river", "Stone", "12", "été", "don't", "<|endoftext|>", "日本"])
    texts = [" ".join(word() for _ in range(rng.choice([0, 3, 90, 700, 4000]))) for _ in range(40)] + [None, "", "same", "same"]
    docs = spark.createDataFrame([(k, t, 1, 2) for k, t in enumerate(texts)], "doc_id bigint, text string, start int, ids int").repartition(parts, "doc_id")
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    rows = Q.op13_packing(spark, str(tmp_path)).collect()
    loads, by_doc = defaultdict(list), defaultdict(list)
    for r in rows:
        loads[r["sequence_id"]].append((r["offset"], r["length"]))
        by_doc[r["doc_id"]].append(r)
    for k, text in enumerate(texts):
        ids = [*known.encode(text or "", add_special_tokens=False).ids, 0]
        at = 0
        for r in sorted(by_doc.pop(k), key=lambda r: r["start"]):
            assert r["start"] == at and r["length"] > 0 and r["doc_tokens"] == len(ids)
            at += r["length"]
            assert r["ids_crc32"] == zlib.crc32(np.array(ids[r["start"] : at], "<u4").tobytes())
        assert at == len(ids)
    assert not by_doc
    total = 0
    for places in loads.values():
        end = 0
        for offset, length in sorted(places):
            assert offset == end
            end += length
        assert end <= 1024 and end & (end - 1) == 0  # 1024 or a power of two: no padding
        total += end
    assert sum(1 for p in loads.values() if sum(n for _, n in p) < 1024) == (total % 1024).bit_count()


def test_rests_climb_a_tree_and_empty_tables_pass(spark, docs_of):
    docs = docs_of([f"text number {k} " * (k % 9) for k in range(200)]).repartition(30, "doc_id")
    rows = W.pack(docs, Q.vocabulary("byte_bpe_50k.tiktoken"), Q.pattern(), 0, capacity=64, fan_in=3).collect()
    loads = defaultdict(int)
    for r in rows:
        loads[r["sequence_id"]] += r["length"]
    assert sum(x < 64 for x in loads.values()) == (sum(loads.values()) % 64).bit_count()
    assert {r["doc_id"] for r in rows} == set(range(200))
    assert W.pack(docs_of([]), Q.vocabulary("byte_bpe_50k.tiktoken"), Q.pattern(), 0).collect() == []
