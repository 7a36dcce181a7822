"""Interval algebra: coalescing, overlap, band joins and one-to-one event matching."""

from __future__ import annotations

from collections import deque

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def coalesce(df: DataFrame, keys: list[str], gap: float) -> DataFrame:
    """Merge intervals of a key whose onset is at most ``gap`` after the furthest end so far.

    The running maximum of all earlier ends decides, so contained intervals don't split a group.
    """
    w = Window.partitionBy(*keys).orderBy("onset", "offset")
    reach = F.max("offset").over(w.rowsBetween(Window.unboundedPreceding, -1))
    marked = df.withColumn("_new", F.when(reach.isNull() | (F.col("onset") - reach > gap), 1).otherwise(0))
    grouped = marked.withColumn("_g", F.sum("_new").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    return grouped.groupBy(*keys, "_g").agg(F.min("onset").alias("onset"), F.max("offset").alias("offset")).drop("_g")


def frame_overlap(df: DataFrame, width: float, *keep: str) -> DataFrame:
    """A row for every frame of ``width`` seconds that an interval touches: equi-joinable on ``frame``."""
    first, last = F.floor(F.col("onset") / width), F.floor(F.col("offset") / width)
    return df.select(*keep, F.explode(F.sequence(first, last)).alias("frame"))


def band_join(left: DataFrame, right: DataFrame, key: str, at_left: str, at_right: str, width: float) -> DataFrame:
    """Pairs of a key whose times differ by at most ``width``: an equi-join on time buckets, not a theta join."""
    bucket = lambda c: F.floor(c / width)
    wide = right.withColumn("_b", F.explode(F.array(*[bucket(F.col(at_right)) + d for d in (-1, 0, 1)])))
    return (
        left.withColumn("_b", bucket(F.col(at_left))).join(wide, [key, "_b"])
        .where(F.abs(F.col(at_left) - F.col(at_right)) <= width).drop("_b")
    )


def match_events(reference: DataFrame, system: DataFrame, keys: list[str] | str = "filename", collar: float = 0.75, share: float = 0.5) -> DataFrame:
    """One-to-one matches: onset within ``collar``, offset within max(collar, ``share`` of the reference's length); as many as can be.

    ``keys``: the file, and the label if labels must agree. Every row is an event of
    its own, equal rows too. Events of a key are cut into islands wherever two
    onsets in a row are more than ``collar`` apart, as no match crosses such a gap;
    each island is matched by itself (augmenting paths).
    """
    keys = [keys] if isinstance(keys, str) else keys
    side = lambda df, s: df.select(*keys, "onset", "offset", F.lit(s).alias("_side"))
    w = Window.partitionBy(*keys).orderBy("onset")
    gap = F.coalesce(F.col("onset") - F.lag("onset").over(w) > collar, F.lit(True))
    events = side(reference, 0).unionByName(side(system, 1)).withColumn("_new", gap.cast("int"))
    events = events.withColumn("_island", F.sum("_new").over(w.rowsBetween(Window.unboundedPreceding, 0))).drop("_new")
    both = events.groupBy(*keys, "_island").agg(F.min("_side").alias("a"), F.max("_side").alias("b")).where("a <> b").select(*keys, "_island")

    def assign(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["onset", "offset"])
        r, s = pdf[pdf["_side"] == 0], pdf[pdf["_side"] == 1]
        a, b = assignment(r["onset"].to_numpy(), r["offset"].to_numpy(), s["onset"].to_numpy(), s["offset"].to_numpy(), collar, share)
        out = r[keys].iloc[a].copy()
        return out.assign(r_on=r["onset"].to_numpy()[a], r_off=r["offset"].to_numpy()[a], s_on=s["onset"].to_numpy()[b], s_off=s["offset"].to_numpy()[b])

    kinds = ", ".join(f"`{k}` {reference.schema[k].dataType.simpleString()}" for k in keys)
    return events.join(both, [*keys, "_island"], "left_semi").groupBy(*keys, "_island").applyInPandas(assign, f"{kinds}, r_on double, r_off double, s_on double, s_off double")


def assignment(r_on: np.ndarray, r_off: np.ndarray, s_on: np.ndarray, s_off: np.ndarray, collar: float, share: float) -> tuple[list[int], list[int]]:
    """A largest one-to-one matching between reference and system events sorted by onset, as places."""
    slack = np.maximum(collar, share * (r_off - r_on))
    low, high = np.searchsorted(s_on, r_on - collar - 1e-9), np.searchsorted(s_on, r_on + collar + 1e-9, "right")
    fits = [[j for j in range(a, b) if abs(s_on[j] - r_on[i]) <= collar and abs(s_off[j] - r_off[i]) <= slack[i]] for i, (a, b) in enumerate(zip(low, high, strict=True))]
    owner: dict[int, int] = {}
    held: dict[int, int] = {}
    for start in range(len(r_on)):
        came, queue, end = {}, deque([start]), None
        while queue and end is None:  # breadth first to a free system event
            i = queue.popleft()
            for j in fits[i]:
                if j not in came:
                    came[j] = i
                    if j not in owner:
                        end = j
                        break
                    queue.append(owner[j])
        while end is not None:
            i = came[end]
            before = held.get(i)
            owner[end], held[i] = i, end
            end = before
    pairs = sorted((i, j) for j, i in owner.items())
    return [i for i, _ in pairs], [j for _, j in pairs]


def clip_labels(tiers: DataFrame, clips: DataFrame, keys: list[str], frames: int = 201, hop: float = 0.01) -> DataFrame:
    """``clips(keys, start)`` with ``labels``: for each of ``frames`` label frames 1 if an interval of the recording covers its time.

    Frame ``f`` stands for ``start + f * hop`` seconds and is covered by intervals that hold it, ends included.
    A clip without an interval gets zeros. Intervals meet clips in buckets of a clip's length.
    """
    length = frames * hop
    spans = tiers.select(*keys, "onset", "offset").withColumn("_b", F.explode(F.sequence(F.floor(F.col("onset") / length), F.floor(F.col("offset") / length))))
    wide = clips.withColumn("_b", F.explode(F.array_distinct(F.array(F.floor(F.col("start") / length), F.floor((F.col("start") + length) / length)))))
    at = lambda name: (F.col(name) - F.col("start")) / hop
    first, last = F.greatest(F.lit(0), F.ceil(F.round(at("onset"), 6))).cast("int"), F.least(F.lit(frames - 1), F.floor(F.round(at("offset"), 6))).cast("int")
    hit = wide.join(spans, [*keys, "_b"]).withColumn("_f", first).withColumn("_l", last).where("_f <= _l")
    covered = hit.withColumn("_at", F.explode(F.sequence("_f", "_l"))).groupBy(*clips.columns).agg(F.collect_set("_at").alias("_on"))  # at most ``frames`` numbers
    full = clips.join(covered, clips.columns, "left")
    labels = F.transform(F.sequence(F.lit(0), F.lit(frames - 1)), lambda f: F.coalesce(F.array_contains("_on", f), F.lit(False)).cast("int"))
    return full.withColumn("labels", labels).drop("_on")


def event_metrics(reference: DataFrame, system: DataFrame, key: str = "filename", collar: float = 0.75, share: float = 0.5, label: str | None = None) -> DataFrame:
    """tp, fp, fn, precision, recall, F and error rate over files that the reference has; events of a ``label`` column must agree in it."""
    known = system.join(reference.select(key).distinct(), key, "left_semi")
    tp = match_events(reference, known, [key, label] if label else key, collar, share).agg(F.count("*").alias("tp"))
    n = reference.agg(F.count("*").alias("n_ref")).crossJoin(known.agg(F.count("*").alias("n_sys"))).crossJoin(tp)  # one row each
    return n.select(
        "tp", (F.col("n_sys") - F.col("tp")).alias("fp"), (F.col("n_ref") - F.col("tp")).alias("fn"),
        F.try_divide(F.col("tp"), F.col("n_sys")).alias("precision"), F.try_divide(F.col("tp"), F.col("n_ref")).alias("recall"),
        F.try_divide(2 * F.col("tp"), F.col("n_sys") + F.col("n_ref")).alias("f"),
        F.try_divide(F.col("n_sys") + F.col("n_ref") - 2 * F.col("tp"), F.col("n_ref")).alias("error_rate"),
    )


def class_labels(tiers: Column, wanted: str) -> Column:
    """Intervals of the tier named ``wanted`` (any case), of positive length."""
    tier = F.filter(tiers, lambda t: F.lower(t["name"]) == wanted.lower())
    return F.filter(F.flatten(F.transform(tier, lambda t: t["intervals"])), lambda x: x["maxTime"] > x["minTime"])
