"""Turn repair against an exhaustive search, short and long conversations, and the registered query against a plain reading of its contract."""

import hashlib
import random
import re
import zlib

import pytest

from sonorant.llm import queries as Q
from sonorant.llm import turn_repair

BLANK = " \t\n\x0b\x0c\r"
SCHEMA = "conv_id bigint, turn bigint, role string, text string, initial int, at string"


def ordered(rows):
    rows = [(t, " " if r is None else r, " " if x is None else x) for t, r, x in rows]
    return sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, r[1].encode(), r[2].encode()))


def faults(rows):
    out, seen = [], set()
    for _, role, text in rows:
        last = text.rstrip(BLANK)[-1:]
        out.append("blank" if not last else "duplicate" if (role, text) in seen else "" if last in ".!?" else "truncated")
        seen.add((role, text))
    return out


def cheapest(rows, found):
    """All sequences of edits that can be right, without states: prefixes are held against the pattern."""
    best = [None]

    def go(k, initials, cost, audit, out):
        if best[0] and cost > best[0][0]:
            return
        if k == len(rows):
            for more in ("", "a", "ua", "u"):
                if re.fullmatch("(s?(ua)+)?", initials + more):
                    new = (cost + 3 * len(more), audit + "I" * len(more), [*out, *(({"u": "user", "a": "assistant"}[c], "") for c in more)])
                    best[0] = new if best[0] is None or new[:2] < best[0][:2] else best[0]
            return
        _, role, text = rows[k]
        for more in ("", "u", "a", "ua", "au"):
            now, added = initials + more, [*out, *(({"u": "user", "a": "assistant"}[c], "") for c in more)]
            spent, said = cost + 3 * len(more), audit + "I" * len(more)
            if not re.fullmatch("s?(ua)*u?", now):
                continue
            go(k + 1, now, spent + 4, said + "D", added)
            if found[k] not in ("blank", "duplicate"):
                extra = 3 * (found[k] == "truncated")
                for new, price, letter in ((role, 0, "K"), ("user", 3, "R"), ("assistant", 3, "R")):
                    if new and re.fullmatch("s?(ua)*u?", now + new[:1]):
                        go(k + 1, now + new[:1], spent + extra + price, said + letter, [*added, (new, text)])

    go(0, "", 0, "", [])
    return best[0]


def plain(rows):
    rows = ordered(rows)
    if not rows:
        return (0, 0, 0, 0, 0, 0, "", [])
    found, turns = faults(rows), [r[0] for r in rows if r[0] is not None]
    illegal = sum(a[1][:1] + b[1][:1] not in ("su", "ua", "au") for a, b in zip(rows, rows[1:], strict=False))
    gaps = max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0
    return (gaps, *(found.count(f) for f in ("blank", "duplicate", "truncated")), illegal, *cheapest(rows, found))


def conversation(rng, n):
    roles = ["user", "assistant", "system", "tool", "", None, "useful"]
    start = rng.randrange(3)
    rows = []
    for k in range(n):
        role = ["user", "assistant"][k % 2] if rng.random() < 0.6 else rng.choice(roles)
        text = rng.choice(["Yes.", "No!  \n", "well", "", " \t", "ünd so?", None, f"a{k}.", f"b{k}"])
        rows.append((None if rng.random() < 0.1 else start + k + rng.randrange(2), role, text))
    return rows


@pytest.mark.parametrize("most", [1024, 3])
def test_equals_an_exhaustive_search(spark, most):
    rng = random.Random(5)
    convs = {i: conversation(rng, rng.randint(1, 7)) for i in range(60)} | {None: conversation(rng, 5), -7: [(None, "user", "x.")] * 4}
    rows = [(c, *r, 1, "z") for c, rs in convs.items() for r in rs]
    rng.shuffle(rows)
    got = {r["conv_id"]: r for r in turn_repair.repair(spark.createDataFrame(rows, SCHEMA), most=most).collect()}
    assert set(got) == set(convs)
    for c, rs in convs.items():
        r = got[c]
        mine = (r["gaps"], r["blank"], r["duplicate"], r["truncated"], r["illegal"], r["cost"], r["audit"], [tuple(x) for x in r["repaired"]])
        assert mine == plain(rs), (c, rs)


def test_a_long_conversation_is_composed_of_lots(spark):
    rng = random.Random(8)
    rows = [(1, k, rng.choice(["user", "assistant"]), f"text {k}" + rng.choice([".", ""]), 0, "") for k in range(500)]
    df = spark.createDataFrame(rows, SCHEMA)
    assert turn_repair.repair(df, most=37).collect() == turn_repair.repair(df).collect()


def test_no_rows(spark):
    assert turn_repair.repair(spark.createDataFrame([], SCHEMA)).collect() == []


def test_the_query_reads_its_contract(spark, tmp_path):
    rng = random.Random(3)
    convs = {i: conversation(rng, rng.randint(1, 6)) for i in range(80)} | {None: conversation(rng, 4)}
    rows = [(c, *r) for c, rs in convs.items() for r in rs]
    spark.createDataFrame(rows, "conv_id bigint, turn bigint, role string, text string").write.parquet(f"{tmp_path}/conversations.parquet")
    got = {r["conv_id"]: tuple(r)[1:] for r in Q.op12_turns(spark, str(tmp_path)).collect()}
    said = lambda x: " " if x is None else str(x)
    for c, rs in convs.items():
        left = []
        for turn, role, text in rs:
            what = zlib.crc32(f"{said(c)}:{said(turn)}".encode()) % 20
            role, text = said(role), said(text)
            text = "" if what == 1 else re.sub("[.!?]", "", text) if what == 2 else text
            left += [(turn, "user" if what == 4 else role, text)] * {0: 0, 3: 2}.get(what, 1)
        *numbers, repaired = plain(left)
        want = hashlib.sha256("\n".join(f"{r}:{t}" for r, t in repaired).encode()).hexdigest()
        assert got.pop(c) == (*numbers, want)
    assert not got
