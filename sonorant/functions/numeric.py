"""Scalar expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def safe_log(x: Column, eps: float = 1e-12) -> Column:
    return F.log(F.abs(x) + eps)


def signed_power(x: Column, p: float = 0.5, eps: float = 1e-12) -> Column:
    return F.signum(x) * F.pow(F.abs(x) + eps, F.lit(p))


def frame_to_seconds(frame: Column, hop: int = 320, rate: int = 32000) -> Column:
    return frame * hop / rate


def seconds_to_frame(t: Column, rate: int = 32000, hop: int = 320) -> Column:
    return F.floor(t * rate / hop)


def hertz_to_mel(f: Column) -> Column:
    """The HTK scale; 1127 and 700 are its fixed values."""
    return 1127.0 * F.log(1 + f / 700.0)


def to_uint8(x: Column, low: Column, high: Column) -> Column:
    """Min-max scaled to 0..255, truncated; 0 where the range is empty."""
    return F.coalesce(F.floor(F.try_divide(x - low, high - low) * 255), F.lit(0)).cast("short")


def quantised(x: Column, low: float = -2.0, high: float = 2.0) -> Column:
    """Clipped to [low, high] and mapped to 0..255, truncated."""
    return F.floor((F.least(F.greatest(x, F.lit(low)), F.lit(high)) - low) * (255.0 / (high - low))).cast("short")


def sigmoid(x: Column) -> Column:
    return 1 / (1 + F.exp(-x))


def softmax(x: Column) -> Column:
    top = F.array_max(x)
    e = F.transform(x, lambda v: F.exp(v - top))
    total = F.aggregate(e, F.lit(0.0), lambda s, v: s + v)
    return F.transform(e, lambda v: v / total)


def jittered(x: Column, seed: int, scale: float = 1e-6) -> Column:
    return x + scale * F.randn(seed)


def z_constant(x: Column, mean: float = -4.2677393, std: float = 4.5689974) -> Column:
    """Normalised by fixed values, those of the audio encoder's training data."""
    return (x - mean) / std


def or_zeros(x: Column, width: int) -> Column:
    """The array, or ``width`` zeros where it is null or empty."""
    return F.when(F.coalesce(F.size(x), F.lit(0)) > 0, x).otherwise(F.array_repeat(F.lit(0.0), width))


def head_labels(logits: Column, threshold: float = 0.0) -> Column:
    """Which of several yes-no heads fire: logit over ``threshold`` (0 is a probability of one half)."""
    return F.transform(logits, lambda z: z > threshold)


def head_class(logits: Column) -> Column:
    """The class of a counted head, from 1: the first greatest logit."""
    return F.array_position(logits, F.array_max(logits)).cast("int")
