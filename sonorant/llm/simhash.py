"""SimHash near-dedup.

A document's words are shingled, the shingles hashed (XXH64) and a 64-bit
majority fingerprint taken. Fingerprints link at ``radius`` or fewer differing
bits. Candidates meet on pigeonhole keys (``match`` equal blocks out of
``radius + match``); within a key the fingerprints are compared bit-sliced: 64
of them stand side by side as 64 bit planes, carry-save counters add up the
differing bits of all 64 at once, and a unit is abandoned once every lane is
beyond the radius. Only a spanning forest of the links of each comparison leaves
its task, never all pairs.

Nulls, empties: a null or word-less text has fingerprint 0 and links like any
other. Repeated rows and ties stay as rows, each with the same component. An
empty table gives no rows. Texts are hashed whole, however long. Extra columns of
the input are ignored, whatever their names (``first_of_groups`` keeps them).
"""

from __future__ import annotations

import struct
from collections.abc import Callable, Iterator
from itertools import combinations
from math import ceil, comb

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ._common import connected_components, drop, linked, maybe_in, meeting, split_by, stage, texts

SEED = 42
#: Fingerprints of one key that are compared with one another in one unit of work.
CHUNK = 2048
_LANES = np.uint64(0x0101010101010101)
_ALL = np.uint64(0xFFFFFFFFFFFFFFFF)


def shingle_hashes(text: bytes, width: int) -> list[int]:
    """XXH64 of every shingle of ``width`` words, repeats included; of all words where there are fewer."""
    words = text.lower().split()  # bytes.lower() changes A-Z only, bytes.split() splits at 0x20 and 0x09-0x0D
    if not words:
        return []
    joined, hashed = b" ".join(words), xxhash.xxh64_intdigest
    if len(words) <= width:
        return [hashed(joined, SEED)]
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1)
    starts = ends - np.fromiter(map(len, words), np.int64, len(words)) - 1
    return [hashed(joined[s:e], SEED) for s, e in zip(starts[: len(words) - width + 1].tolist(), (ends[width - 1 :] - 1).tolist(), strict=True)]


def majority(hashes: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """Majority fingerprint of each run of ``sizes`` hashes; zero for an empty run.

    Eight bit positions at a time are summed as the byte lanes of a word, in runs of at most 255.
    """
    out = np.zeros(len(sizes), np.uint64)
    full = np.flatnonzero(sizes)
    if not len(full):
        return out
    sizes = sizes[full]
    ends = np.cumsum(sizes)
    parts = -(-sizes // 255)
    first = np.cumsum(parts) - parts
    cut = np.repeat(ends - sizes, parts) + 255 * (np.arange(parts.sum()) - np.repeat(first, parts))
    counts = np.empty((len(full), 64), np.int64)
    for k in range(8):
        lanes = np.add.reduceat((hashes >> np.uint64(k)) & _LANES, cut)
        counts[:, k::8] = np.add.reduceat(lanes.astype("<u8").view(np.uint8).reshape(-1, 8).astype(np.int64), first, axis=0)
    bits = (2 * counts > sizes[:, None]).astype(np.uint8)
    out[full] = np.packbits(bits, axis=1, bitorder="little").view("<u8")[:, 0]
    return out


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = 4) -> DataFrame:
    """``(id, fp)`` of every row; ``fp`` is the fingerprint as a signed 64-bit number."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found: list[np.ndarray] = []
            hashes: list[int] = []
            sizes: list[int] = []
            for text in texts(batch.column(1)):
                got = shingle_hashes(text, width)
                hashes += got
                sizes.append(len(got))
                if len(hashes) > 400_000:
                    found.append(majority(np.array(hashes, np.uint64), np.array(sizes)))
                    hashes, sizes = [], []
            if sizes:
                found.append(majority(np.array(hashes, np.uint64), np.array(sizes)))
            fps = np.concatenate(found) if found else np.zeros(0, np.uint64)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(fps.view(np.int64))], ["id", "fp"])

    kind = docs.schema[id_col].dataType.simpleString()
    return docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).mapInArrow(run, f"id {kind}, fp bigint")


def block_plan(n: int, radius: int) -> tuple[int, int]:
    """Blocks and how many of them must agree, for ``n`` fingerprints.

    Every plan finds every link (of ``radius + match`` blocks at least ``match``
    are free of differing bits); they differ in cost: keys made, against
    fingerprints that meet under a key by chance.
    """

    def cost(match: int) -> float:
        keys, bits = comb(radius + match, match), 64 * match / (radius + match)
        return keys * n * (1 + 0.02 * n / 2**bits)

    match = min(range(1, 7), key=cost)
    return radius + match, match


def _keys(blocks: int, match: int) -> list[tuple[int, int]]:
    """(number, mask) of each choice of ``match`` blocks; the masks as signed 64-bit numbers."""
    edges = [round(64 * i / blocks) for i in range(blocks + 1)]
    masks = [((1 << edges[i + 1]) - 1) ^ ((1 << edges[i]) - 1) for i in range(blocks)]
    sums = [sum(masks[i] for i in pick) for pick in combinations(range(blocks), match)]
    return [(k, m - (1 << 64) if m >> 63 else m) for k, m in enumerate(sums)]


def planes(block: np.ndarray) -> np.ndarray:
    """Bit planes of (units, 64) fingerprints: word ``[u, b]`` has bit ``b`` of lane ``l`` at bit ``l``."""
    bits = np.unpackbits(block.astype("<u8").view(np.uint8).reshape(len(block), 64, 8), axis=2, bitorder="little")
    return np.ascontiguousarray(np.packbits(bits.transpose(0, 2, 1), axis=2, bitorder="little")).view("<u8")[:, :, 0]


def sliced_links(queries: np.ndarray, targets: np.ndarray, valid: np.ndarray, radius: int) -> np.ndarray:
    """Which of 64 targets lie within ``radius`` of each unit's query, as a lane mask.

    ``targets``: (units, 64) bit planes; ``valid``: lanes in use. The counters hold
    the distance so far in binary, one word per digit; ``over`` the lanes beyond
    the radius. Units of which all lanes are over are abandoned every 8 planes.
    """
    digits = max(1, radius.bit_length())
    live = np.arange(len(queries))
    q, t, over = queries, targets, ~valid
    counters = [np.zeros(len(q), np.uint64) for _ in range(digits)]
    hits = np.zeros(len(queries), np.uint64)
    for b in range(64):
        carry = t[:, b] ^ (np.uint64(0) - ((q >> np.uint64(b)) & np.uint64(1)))
        carry = carry & ~over
        for d in range(digits):
            counters[d], carry = counters[d] ^ carry, counters[d] & carry
        over = over | carry
        if b % 8 == 7:
            # beyond: the counter is above the radius, compared digit by digit from the top
            above, equal = np.zeros(len(q), np.uint64), np.full(len(q), _ALL)
            for d in reversed(range(digits)):
                if radius >> d & 1:
                    equal = equal & counters[d]
                else:
                    above = above | (equal & counters[d])
                    equal = equal & ~counters[d]
            over = over | above
            stay = over != _ALL
            if not stay.all():
                live, q, t, over = live[stay], q[stay], t[stay], over[stay]
                counters = [c[stay] for c in counters]
            if not len(live):
                return hits
    hits[live] = ~over
    return hits


def _compare(
    fps: np.ndarray, side: np.ndarray, group: np.ndarray, radius: int,
    fits: Callable[[np.ndarray, np.ndarray], np.ndarray] | None = None, forest: bool = True,
) -> tuple[np.ndarray, np.ndarray]:
    """Links within each group of sorted ``group`` ids, between the sides of a two-sided group.

    ``side`` 0: a group compared with itself; 1 and 2: the halves of a split key.
    ``fits`` may reject links (index arrays in, booleans out). Returns a spanning
    forest of the links as index pairs, or every link.
    """
    new = np.r_[True, (group[1:] != group[:-1]) | (side[1:] != side[:-1])]
    first = np.flatnonzero(new)
    size = np.diff(np.r_[first, len(fps)])
    # blocks of 64 lanes, each inside one (group, side)
    n_blocks = -(-size // 64)
    of = np.repeat(np.arange(len(first)), n_blocks)
    start = first[of] + 64 * (np.arange(len(of)) - np.repeat(np.cumsum(n_blocks) - n_blocks, n_blocks))
    width = np.minimum(64, (first + size)[of] - start)
    lane = np.minimum(start[:, None] + np.arange(64), len(fps) - 1)
    vertical = planes(fps[lane])
    valid = np.where(width == 64, _ALL, (np.uint64(1) << width.astype(np.uint64)) - np.uint64(1))
    begin = np.cumsum(n_blocks) - n_blocks  # first block of each run
    # each run is compared with its own blocks from that of the query on, or with all blocks of the other side
    run_of = np.cumsum(new) - 1
    other = np.where((side[first] == 1) & (np.r_[group[first][1:], -1] == group[first]), np.arange(len(first)) + 1, -1)
    alone = side[first] == 0
    place = np.arange(len(fps)) - first[run_of]
    target_run = np.where(alone[run_of], run_of, other[run_of])
    asks = np.flatnonzero((target_run >= 0) & (~alone[run_of] | (size[run_of] > 1)))
    low = np.where(alone[run_of[asks]], place[asks] // 64, 0)
    tries = n_blocks[target_run[asks]] - low
    left, right = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
    total, at = np.cumsum(tries), 0
    while at < len(asks):
        upto = max(at + 1, int(np.searchsorted(total, (total[at - 1] if at else 0) + 200_000, "right")))
        t = tries[at:upto]
        q = np.repeat(asks[at:upto], t)
        blk = np.repeat(begin[target_run[asks[at:upto]]] + low[at:upto], t) + np.arange(t.sum()) - np.repeat(np.cumsum(t) - t, t)
        hits = sliced_links(fps[q], vertical[blk], valid[blk], radius)
        some = np.flatnonzero(hits)
        lanes = np.unpackbits(hits[some].astype("<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        u, l = np.nonzero(lanes)
        a, b = q[some[u]], start[blk[some[u]]] + l
        keep = a != b
        if fits is not None:
            keep &= fits(a, b)
        a, b = a[keep], b[keep]
        if forest:
            a, b = _forest(a, b, len(fps))
        left.append(a)
        right.append(b)
        at = upto
    a, b = np.concatenate(left), np.concatenate(right)
    return _forest(a, b, len(fps)) if forest else (a, b)


def _forest(a: np.ndarray, b: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """A star for each component of the links ``(a, b)`` among ``n`` places (pointer jumping on minima)."""
    if not len(a):
        return a, b
    root = np.arange(n)
    while True:
        low = np.minimum(root[a], root[b])
        np.minimum.at(root, root[a], low)
        np.minimum.at(root, root[b], low)
        while (root != root[root]).any():
            root = root[root]
        if (root[a] == root[b]).all():
            break
    touched = np.unique(np.r_[a, b])
    touched = touched[root[touched] != touched]
    return touched, root[touched]


def _units(fps: DataFrame, radius: int, chunk: int, *carried: str) -> DataFrame:
    """``fps(fp, ...)`` dealt into units of comparison ``(fp, unit, side, carried columns)``, sorted within partitions.

    A key met by more than ``chunk`` fingerprints is dealt into chunks, each pair
    of chunks a unit of its own, so no task holds a whole hot key.
    """
    if not 0 <= radius <= 16:
        raise ValueError("radius must be from 0 to 16")
    blocks, match = block_plan(max(fps.count(), 1), radius)
    keys = F.array(*[F.struct(F.lit(k).alias("k"), F.col("fp").bitwiseAND(F.lit(m)).alias("v")) for k, m in _keys(blocks, match)])
    made = fps.select("fp", *carried, F.inline(keys))
    sizes = made.groupBy("k", "v").count()
    hot = sizes.where(F.col("count") > chunk).select("k", "v", F.ceil(F.col("count") / chunk).cast("int").alias("parts"))
    shared = made.join(hot, ["k", "v"], "left").withColumn("parts", F.coalesce("parts", F.lit(1)))
    own = F.pmod(F.xxhash64(F.col("fp"), *carried, F.lit(7)), F.col("parts")).cast("int")  # equal fingerprints of unlike texts are dealt too
    units = (
        shared.withColumn("own", own)
        .withColumn("mate", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)))
        .select(
            "fp", F.xxhash64("k", "v", F.least("own", "mate"), F.greatest("own", "mate")).alias("unit"),
            F.when(F.col("own") == F.col("mate"), 0).when(F.col("own") < F.col("mate"), 1).otherwise(2).alias("side"), *carried,
        )
    )
    return units.repartition("unit").sortWithinPartitions("unit", "side", "fp").select("fp", "unit", "side", *carried)


def _over_units(batches: Iterator[pa.RecordBatch], work: Callable[..., list[np.ndarray]], names: list[str]) -> Iterator[pa.RecordBatch]:
    """``work(*columns)`` over whole units, some ten thousand rows at a time."""
    held: list[tuple[np.ndarray, ...]] = []

    def flush(last: bool) -> Iterator[pa.RecordBatch]:
        columns = [np.concatenate(x) for x in zip(*held, strict=True)]
        unit = columns[1]
        cut = len(unit) if last else int(np.flatnonzero(unit != unit[-1])[-1]) + 1 if (unit != unit[-1]).any() else 0
        held[:] = [tuple(c[cut:] for c in columns)] if cut < len(unit) else []
        if cut:
            out = work(*[c[:cut] for c in columns])
            if len(out[0]):
                yield pa.RecordBatch.from_arrays([pa.array(x) for x in out], names)

    for batch in batches:
        if batch.num_rows:
            held.append(tuple(c.to_numpy(zero_copy_only=False) for c in batch.columns))
            if sum(len(x[0]) for x in held) > 50_000:
                yield from flush(False)
    if held:
        yield from flush(True)


def links(fps: DataFrame, radius: int, chunk: int = CHUNK) -> DataFrame:
    """Spanning links ``(a, b)`` between distinct fingerprints ``fps(fp)`` at ``radius`` or fewer bits."""

    def work(fp: np.ndarray, unit: np.ndarray, side: np.ndarray) -> list[np.ndarray]:
        a, b = _compare(fp.view(np.uint64), side, unit, radius)
        return [fp[a], fp[b]]

    return _units(fps, radius, chunk).mapInArrow(lambda batches: _over_units(batches, work, ["a", "b"]), "a bigint, b bigint")


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = 4, radius: int = 4) -> DataFrame:
    """``(id, fingerprint, component_id)`` of every row.

    ``fingerprint``: 16 lowercase hex digits. ``component_id``: the smallest id
    that can be reached over links, the row's own included (null only where every
    id of a component is null).
    """
    fps, _ = stage(fingerprints(docs, id_col, text_col, width), "simhash")
    classes, _ = stage(fps.groupBy("fp").agg(F.min("id").alias("first_id")), "simhash-classes")
    comps = connected_components(links(classes.select("fp"), radius))
    named = classes.join(comps.withColumnRenamed("node", "fp"), "fp", "left").withColumn("root", F.coalesce("component", "fp"))
    least = named.groupBy("root").agg(F.min("first_id").alias("component_id"))
    members = named.join(least, "root").select("fp", "component_id")
    return fps.join(members, "fp", "left").select("id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


#: Fingerprints of distinct words within this many bits and of shingles within that many make the first candidates.
WORD_RADIUS, SHINGLE_RADIUS = 8, 20
#: Bytes that one side of a unit of verification holds, and pairs of a unit, about.
LOT, PAIRS = 32 << 20, 500_000
#: Classes of shingles whose parities bound how many two texts do not share.
ODD = 512


def _hashes(text: str = "text") -> list[Column]:
    """128 bits that tell texts apart; null is an empty text."""
    whole = F.coalesce(F.col(text), F.lit(""))
    return [F.xxhash64(whole).alias("h"), F.xxhash64(F.lit(1), whole).alias("h2")]


def _node(words: list[bytes]) -> tuple[int, int]:
    """128 bits of the words in order, as two signed numbers."""
    return struct.unpack("<qq", xxhash.xxh3_128_digest(b" ".join(words), SEED))


def text_fingerprints(docs: DataFrame, id_col: str, text_col: str, width: int, similarity: float) -> DataFrame:
    """``(id, h, h2, node, check, fp, wide, size, odd, low)`` of every row.

    Hashes of the text and of its words in order, the fingerprint of the distinct words and that of the shingles,
    how many distinct shingles there are, which of ``ODD`` classes hold an odd number of them, and the least of their
    hashes, of which texts ``similarity`` alike share one.
    """
    names = ["id", "h", "h2", "node", "check", "fp", "wide", "size", "odd", "low"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            nodes, prints, sizes, odds, lows = [], [], [], [], []
            for text in texts(batch.column(3)):
                words = text.lower().split()
                one = np.fromiter({xxhash.xxh64_intdigest(w, SEED) for w in set(words)}, np.uint64)
                wide = np.array(shingle_hashes(text, width), np.uint64)
                prints.append(majority(np.concatenate([one, wide]), np.array([len(one), len(wide)])))
                own = np.unique(wide)
                sizes.append(len(own))
                odds.append(np.packbits(np.bincount((own % np.uint64(ODD)).astype(np.int64), minlength=ODD) & 1, bitorder="little").view(np.int64))
                lows.append(own[: len(own) - ceil(similarity * len(own) - 1e-9) + 1].view(np.int64))
                nodes.append(_node(words))
            pair = np.array(prints, np.uint64).reshape(-1, 2).view(np.int64)
            key = np.array(nodes, np.int64).reshape(-1, 2)
            columns = [*(np.ascontiguousarray(x[:, i]) for x in (key, pair) for i in (0, 1))]
            yield pa.RecordBatch.from_arrays([*batch.columns[:3], *map(pa.array, columns), pa.array(sizes, pa.int32()), pa.array(odds, pa.list_(pa.int64())), pa.array(lows, pa.list_(pa.int64()))], names)

    kind = docs.schema[id_col].dataType.simpleString()
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).select("id", *_hashes(), "text")
    return rows.mapInArrow(run, f"id {kind}, h bigint, h2 bigint, node bigint, check bigint, fp bigint, wide bigint, size int, odd array<bigint>, low array<bigint>")


def _similar(pairs: DataFrame, docs: DataFrame, prints: DataFrame, text_col: str, width: int, similarity: float) -> DataFrame:
    """Of ``pairs(a, b)`` of nodes those whose shingle sets have a Jaccard similarity of ``similarity`` or more.

    A text is found by its hash, once for each node, whatever ids it stands under. Pairs are first held against maps of
    the parities of as many classes as the set needs, a sixteenth of its size, which reject no similar pair; sets travel
    only for the pairs that are left.
    """
    nodes = pairs.select(F.col("a").alias("node")).unionByName(pairs.select(F.col("b").alias("node"))).distinct()
    owners = maybe_in(prints.select("node", "h"), nodes, "node").join(nodes, "node").groupBy("node").agg(F.min("h").alias("h"))
    owners, path = stage(owners, "owners")
    found = maybe_in(docs.select(F.coalesce(F.col(text_col), F.lit("")).alias("text")).select(_hashes()[0], "text"), owners, "h").dropDuplicates(["h"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sets = [np.unique(np.array(shingle_hashes(text, width), np.uint64)) for text in texts(batch.column(1))]
            columns = [pa.array([x.tobytes() for x in sets], pa.binary()), pa.array([parity_map(x).tobytes() for x in sets], pa.binary())]
            yield pa.RecordBatch.from_arrays([batch.column(0), *columns], ["node", "s", "m"])

    sets, sets_path = stage(found.join(owners, "h").select("node", "text").mapInArrow(run, "node bigint, s binary, m binary"), "shingles")
    drop(docs.sparkSession, path)

    def may_be(x: bytes, y: bytes) -> bool:
        one, two = np.frombuffer(x, np.uint64), np.frombuffer(y, np.uint64)
        total, one, two = int(one[0]) + int(two[0]), one[1:], two[1:]
        while len(one) != len(two):  # classes of the larger map fall together in pairs
            one, two = (one, two) if len(one) > len(two) else (two, one)
            one = one[: len(one) // 2] ^ one[len(one) // 2 :]
        return int(np.bitwise_count(one ^ two).sum()) <= int((1 - similarity) / (1 + similarity) * total + 1e-9)

    def is_one(x: bytes, y: bytes) -> bool:
        one, two = np.frombuffer(x, np.uint64), np.frombuffer(y, np.uint64)
        shared = len(np.intersect1d(one, two, assume_unique=True))
        return shared >= similarity * (len(one) + len(two) - shared)

    likely, likely_path = stage(_checked(pairs, sets.select("node", F.col("m").alias("data")), may_be), "likely")
    ends = likely.select(F.col("a").alias("node")).unionByName(likely.select(F.col("b").alias("node"))).distinct()
    links, _ = stage(_checked(likely, sets.select("node", F.col("s").alias("data")).join(ends, "node", "left_semi"), is_one), "links")
    drop(docs.sparkSession, sets_path, likely_path)
    return links


def parity_map(hashes: np.ndarray) -> np.ndarray:
    """How many hashes there are, then a bit for each class of them (a power of two of classes, four for a hash or more): whether it holds an odd number."""
    classes = max(64, 1 << (4 * len(hashes) - 1).bit_length()) if len(hashes) else 64
    odd = np.bincount((hashes & np.uint64(classes - 1)).astype(np.int64), minlength=classes) & 1
    return np.concatenate([np.array([len(hashes)], np.uint64), np.packbits(odd.astype(np.uint8), bitorder="little").view(np.uint64)])


def _checked(pairs: DataFrame, known: DataFrame, fits: Callable[[bytes, bytes], bool]) -> DataFrame:
    """Of ``pairs(a, b)`` those whose ``known(node, data)`` fit.

    Nodes are dealt into lots of about ``LOT`` bytes; a unit of work holds the data of two lots and at most about
    ``PAIRS`` pairs between them. There are as many units as shuffle partitions at least.
    """
    spark = pairs.sparkSession
    total, count = known.agg(F.sum(F.octet_length("data"))).first()[0] or 0, pairs.count()
    lots = max(-(-total // LOT), ceil((2 * int(spark.conf.get("spark.sql.shuffle.partitions"))) ** 0.5))
    parts = max(1, -(-2 * count // (lots * (lots + 1) * PAIRS)))
    lot = lambda c: F.pmod(F.xxhash64(c), F.lit(lots))
    unit = (F.least(lot("a"), lot("b")) * lots + F.greatest(lot("a"), lot("b"))) * parts + F.pmod(F.xxhash64("a", "b"), F.lit(parts))
    dealt = pairs.select("a", "b", unit.alias("unit"))
    asked = dealt.select(F.col("a").alias("node"), F.col("unit").alias("u")).unionByName(dealt.select(F.col("b").alias("node"), F.col("unit").alias("u"))).distinct()

    def check(left: pa.Table, right: pa.Table) -> pa.Table:
        data = dict(zip(right["node"].to_pylist(), right["data"].combine_chunks(), strict=True))
        keep = []
        for x, y in zip(left["a"].to_pylist(), left["b"].to_pylist(), strict=True):
            one, two = data.get(x), data.get(y)
            keep.append(one is not None and two is not None and fits(one.as_buffer(), two.as_buffer()))
        return left.select(["a", "b"]).filter(pa.array(keep, pa.bool_()))

    return dealt.groupBy("unit").cogroup(known.join(asked, "node").select("node", "data", "u").groupBy("u")).applyInArrow(check, "a bigint, b bigint")


def groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = 5, similarity: float = 0.8) -> DataFrame:
    """``(id, h, h2, node, component, alone)`` of every row: texts whose shingle sets are ``similarity`` alike, linked.

    The first candidates come from SimHash (distinct words within ``WORD_RADIUS`` bits, shingles within
    ``SHINGLE_RADIUS``), of which a spanning forest is verified. Then texts meet on the least of their shingle
    hashes (a prefix filter, complete for ``similarity``); see ``linked``. Every link is verified. Texts of equal
    words are one node; ``alone`` rows have a text that no other row equals or is linked to.
    """
    spark = docs.sparkSession
    prints, _ = stage(text_fingerprints(docs, id_col, text_col, width, similarity), "prints")
    # of texts that share 64 bits only one is known further; the others differ in ``check`` and stay alone
    nodes, nodes_path = stage(prints.groupBy("node").agg(F.count("*").alias("n"), F.min("check").alias("check"), *[F.first(c).alias(c) for c in ("fp", "wide", "size", "odd")]), "nodes")

    def near(wide: np.ndarray) -> Callable[[np.ndarray, np.ndarray], np.ndarray]:
        return lambda a, b: np.bitwise_count((wide[a] ^ wide[b]).view(np.uint64)) <= SHINGLE_RADIUS

    def spanning(fp: np.ndarray, unit: np.ndarray, side: np.ndarray, node: np.ndarray, wide: np.ndarray) -> list[np.ndarray]:
        a, b = _compare(fp.view(np.uint64), side, unit, WORD_RADIUS, near(wide))
        return [node[a], node[b]]

    def verified(pairs: DataFrame) -> DataFrame:
        return _similar(pairs, docs, prints, text_col, width, similarity)

    pair = "a bigint, b bigint"
    first = _units(nodes.select("node", "fp", "wide"), WORD_RADIUS, CHUNK, "node", "wide").mapInArrow(lambda x: _over_units(x, spanning, ["a", "b"]), pair).distinct()
    first, path = stage(first, "candidates")
    comps = connected_components(verified(first))
    blocks = prints.groupBy("node").agg(F.first("size").alias("size"), F.first("low").alias("low"))
    blocks = blocks.select(F.col("node").alias("key"), "size", F.lit(1).alias("need"), F.explode("low").alias("v"))
    met, met_path = stage(meeting(blocks, similarity), "met")

    def fits(a: Callable[[str], Column], b: Callable[[str], Column]) -> Column:
        differing = sum((F.bit_count(F.get(a("odd"), F.lit(i)).bitwiseXOR(F.get(b("odd"), F.lit(i)))) for i in range(1, ODD // 64)), F.bit_count(F.get(a("odd"), F.lit(0)).bitwiseXOR(F.get(b("odd"), F.lit(0)))))
        return differing <= F.floor((1 - similarity) / (1 + similarity) * (a("size") + b("size")) + 1e-9)  # as many shingles at most are in one text only

    facts = nodes.select(F.col("node").alias("key"), "size", "odd")
    final = linked(met, verified, similarity, comps=comps, facts=facts, fits=fits).withColumnRenamed("node", "n_node")
    drop(spark, path, met_path)
    final = final.unionByName(final.select(F.col("component").alias("n_node"), "component").distinct())
    known = nodes.select(F.col("node").alias("k"), F.col("check").alias("c"), "n").join(final, F.col("k") == F.col("n_node"), "left").where("n > 1 OR component IS NOT NULL").select("k", "c", "component")
    named = prints.drop("low", "odd").join(known, (F.col("node") == F.col("k")) & (F.col("check") == F.col("c")), "left")
    return named.select("id", "h", "h2", "node", F.coalesce("component", "node").alias("component"), F.col("k").isNull().alias("alone"))


def first_of_groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = 5, similarity: float = 0.8) -> DataFrame:
    """``docs`` without near copies: of each group the row of the least id stays, rows alike in id and text once.

    Null ids come last. Texts that no other equals or is linked to stay, and mostly pass by the join.
    """
    found, path = stage(groups(docs, id_col, text_col, width, similarity).where("NOT alone").drop("alone"), "groups")
    own = F.struct(F.col("id").isNull().alias("no_id"), "id", "h", "h2")
    firsts = found.groupBy("component").agg(F.min(own).alias("w")).select("w.id", "w.h", "w.h2", F.lit(True).alias("first"))
    same = [F.col(f"a.{c}").eqNullSafe(F.col(f"b.{c}")) for c in ("id", "h", "h2")]
    marked = found.select("id", "h", "h2").distinct().alias("a").join(firsts.alias("b"), same[0] & same[1] & same[2], "left").select("a.*", F.coalesce("first", F.lit(False)).alias("first"))
    marked, _ = stage(marked, "marked")
    drop(docs.sparkSession, path)
    row = F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row")
    rows = docs.select(row, F.col(id_col).alias("id"), F.col(text_col).alias("text")).select("row", "id", *_hashes())
    maybe, surely_not = split_by(rows, marked, "h")
    judged = maybe.alias("a").join(marked.alias("b"), same[0] & same[1] & same[2], "left").where("b.first IS NULL OR b.first").select("a.*")
    return judged.dropDuplicates(["id", "h", "h2"]).select("row").unionByName(surely_not.select("row")).select("row.*")
