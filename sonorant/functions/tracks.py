"""Noise gate, band-pass sections and pitch tracks with paths, in numpy for use inside vectorised UDFs.

These are this library's own forms of what external libraries do under the same names; they agree with
them in kind, not in every digit.
"""

from __future__ import annotations

import math

import numpy as np

from .dsp import framed, hann


def spectrum(x: np.ndarray, size: int, hop: int) -> np.ndarray:
    """Complex spectra (frames, size // 2 + 1) of Hann-windowed frames, the signal padded by a frame at either end."""
    return np.fft.rfft(framed(np.pad(np.asarray(x, float), (size, size + (-len(x)) % hop)), size, hop) * hann(size))


def from_spectrum(frames: np.ndarray, length: int, size: int, hop: int) -> np.ndarray:
    """The signal of ``length`` samples of such spectra, by weighted overlap-add: exact if they are unchanged."""
    window, n = hann(size), len(frames)
    out, weight = np.zeros((n - 1) * hop + size), np.zeros((n - 1) * hop + size)
    for k, part in enumerate(np.fft.irfft(frames, size) * window):
        out[k * hop : k * hop + size] += part
        weight[k * hop : k * hop + size] += window**2
    return (out / np.maximum(weight, 1e-12))[size : size + length]


def _smoothed(mask: np.ndarray, width: int, axis: int) -> np.ndarray:
    """Triangular average of ``2 * width + 1`` places, the edges held."""
    if width < 1:
        return mask
    weights = np.r_[1 : width + 2, width:0:-1] / (width + 1) ** 2
    padded = np.pad(mask, [(width, width) if a == axis else (0, 0) for a in range(2)], mode="edge")
    return np.apply_along_axis(lambda v: np.convolve(v, weights, "valid"), axis, padded)


def gated(x: np.ndarray, rate: float, size: int = 1024, hop: int = 256, deviations: float = 1.5, soft: float = 3.0, most: float = 1.0, band: float = 100.0, time: float = 0.05, noise: np.ndarray | None = None) -> np.ndarray:
    """``x`` with what is not above the noise of its band turned down.

    A band's noise level is the median of its decibels plus ``deviations`` deviations (1.4826 times the median one), over
    ``noise`` or the signal itself. The mask rises over ``soft`` decibels around it and is smoothed over ``band`` hertz and ``time``
    seconds; ``most`` is the share that is taken away (0: nothing, an open mask).
    """
    if not len(x):
        return np.asarray(x, float)
    frames = spectrum(x, size, hop)
    level = lambda s: 20 * np.log10(np.abs(s) + 1e-10)
    base = level(frames if noise is None else spectrum(noise, size, hop))
    middle = np.median(base, axis=0)  # a call in less than half of the frames does not raise it
    threshold = middle + deviations * 1.4826 * np.median(np.abs(base - middle), axis=0)
    mask = 1 / (1 + np.exp(-np.clip((level(frames) - threshold) / soft * 4, -60, 60)))
    mask = _smoothed(_smoothed(mask, int(band * size / rate / 2), 1), int(time * rate / hop / 2), 0)
    return from_spectrum(frames * (1 - most * (1 - mask)), len(x), size, hop)


def band_pass(low: float, high: float, rate: float, order: int = 4) -> list[tuple[np.ndarray, np.ndarray]]:
    """Sections (b, a) of a Butterworth band-pass of ``order`` (twice as many poles), gain 1 in the middle."""
    if not 0 < low < high < rate / 2:
        raise ValueError("band edges must satisfy 0 < low < high < rate / 2")
    w1, w2 = (2 * rate * math.tan(math.pi * f / rate) for f in (low, high))
    centre, width = math.sqrt(w1 * w2), w2 - w1
    prototype = [np.exp(1j * math.pi * (2 * k + order + 1) / (2 * order)) for k in range(order)]
    poles = [s for p in prototype for s in (p * width / 2 + np.sqrt((p * width / 2) ** 2 - centre**2 + 0j), p * width / 2 - np.sqrt((p * width / 2) ** 2 - centre**2 + 0j))]
    digital = sorted(((2 * rate + s) / (2 * rate - s) for s in poles), key=lambda z: (round(z.real, 12), z.imag))
    upper = [z for z in digital if z.imag > 1e-12]
    real = sorted(z.real for z in digital if abs(z.imag) <= 1e-12)
    pairs = [np.array([1.0, -2 * z.real, abs(z) ** 2]) for z in upper] + [np.array([1.0, -a - b, a * b]) for a, b in zip(real[0::2], real[1::2], strict=True)]
    at = np.exp(2j * math.atan(centre / (2 * rate)))
    out = []
    for a in pairs:  # each section has a zero at either end of the band
        gain = abs((at * at - 1) / (at * at * a[0] + at * a[1] + a[2]))
        out.append((np.array([1.0, 0.0, -1.0]) / gain, a))
    return out


def filtered(x: np.ndarray, sections: list[tuple[np.ndarray, np.ndarray]], block: int = 256) -> np.ndarray:
    """``x`` through second-order sections from rest. A block's answer to its samples is one matrix product; only two numbers pass from block to block."""
    y = np.asarray(x, float)
    for b, a in sections:
        step = np.array([[-a[1], 1.0], [-a[2], 0.0]])
        feed = np.array([b[1] - a[1] * b[0], b[2] - a[2] * b[0]])
        powers = [np.eye(2)]
        for _ in range(block):
            powers.append(step @ powers[-1])
        reach = np.array([p @ feed for p in powers[:block]])  # state that one sample leaves after k steps
        answer = np.r_[b[0], reach[: block - 1, 0]]
        lag = np.arange(block)[:, None] - np.arange(block)[None]
        within = np.where(lag >= 0, answer[np.maximum(lag, 0)], 0.0)
        rows = np.pad(y, (0, (-len(y)) % block)).reshape(-1, block)
        out, left = rows @ within.T, rows[:, ::-1] @ reach
        from_state = np.array([p[0] for p in powers[:block]])
        state = np.zeros(2)
        for k in range(len(rows)):
            out[k] += from_state @ state
            state = powers[block] @ state + left[k]
        y = out.ravel()[: len(y)]
    return y


def _parabola(y: np.ndarray, k: int) -> tuple[float, float]:
    """Place and height of the peak through three points around ``k``."""
    if not 0 < k < len(y) - 1:
        return float(k), float(y[k])
    a, b, c = y[k - 1 : k + 2]
    bend = a - 2 * b + c
    shift = 0.5 * (a - c) / bend if bend < 0 else 0.0
    return k + shift, b - 0.25 * (a - c) * shift


def pitch_path(
    x: np.ndarray, rate: float, low: float = 75.0, high: float = 600.0, step: float | None = None, candidates: int = 15,
    silence: float = 0.03, voicing: float = 0.45, octave: float = 0.01, jump: float = 0.35, change: float = 0.14,
) -> np.ndarray:
    """Pitch of each frame, 0 where unvoiced: the cheapest path through the frames' candidates.

    A frame of three periods of ``low`` has as candidates the highest peaks of its autocorrelation, divided by
    the window's, and silence. Staying with a candidate earns its strength (higher pitches a little more, by
    ``octave``); going an octave costs ``jump``, to or from silence ``change``, for a step of a hundredth of a second.
    """
    size = int(3 * rate / low)
    hop = max(1, int((step or 0.75 / low) * rate))
    frames = framed(np.asarray(x, float) - (np.mean(x) if len(x) else 0), size, hop)
    if not len(frames):
        return np.zeros(0)
    fft = 1 << (2 * size - 1).bit_length()
    window = np.hanning(size + 2)[1:-1]
    own = np.fft.irfft(np.abs(np.fft.rfft(window, fft)) ** 2)[: size // 2]
    loudest = np.abs(frames).max() or 1.0
    first, last = max(2, int(rate / high)), min(int(rate / low) + 1, size // 2 - 1)
    pitches, gains = np.zeros((len(frames), candidates + 1)), np.full((len(frames), candidates + 1), -np.inf)
    for t, f in enumerate(frames):
        f = f - f.mean()
        peak = np.abs(f).max()
        gains[t, 0] = voicing + max(0.0, 2 - (peak / loudest) / (silence / (1 + voicing)))
        r = np.fft.irfft(np.abs(np.fft.rfft(f * window, fft)) ** 2)[: size // 2]
        if r[0] <= 0:
            continue
        r = r / r[0] / (own / own[0])
        inner = r[first - 1 : last + 1]
        tops = np.flatnonzero((inner[1:-1] > inner[:-2]) & (inner[1:-1] >= inner[2:])) + first
        found = [(rate / place, min(height, 1.0)) for place, height in (_parabola(r, k) for k in tops) if low <= rate / place <= high and height > 0.5 * voicing]
        found.sort(key=lambda c: -(c[1] + octave * math.log2(c[0] / low)))
        for k, (pitch, strength) in enumerate(found[:candidates]):
            pitches[t, k + 1], gains[t, k + 1] = pitch, strength - octave * math.log2(low / pitch)
    scale = 0.01 / (hop / rate)
    logs = np.log2(np.maximum(pitches, 1e-9))
    best, back = gains[0], np.zeros(pitches.shape, int)
    for t in range(1, len(frames)):
        voiced, before = pitches[t] > 0, pitches[t - 1] > 0
        cost = jump * np.abs(logs[t - 1][:, None] - logs[t][None])
        cost = np.where(before[:, None] & voiced[None], cost, np.where(before[:, None] != voiced[None], change, 0.0)) * scale
        total = best[:, None] - cost
        back[t] = total.argmax(axis=0)
        best = total.max(axis=0) + gains[t]
    at, out = int(best.argmax()), np.zeros(len(frames))
    for t in range(len(frames) - 1, -1, -1):
        out[t] = pitches[t, at]
        at = back[t, at]
    return out


def _erb(f: np.ndarray | float) -> np.ndarray | float:
    return 21.4 * np.log10(1 + np.asarray(f) / 229)


def _primes(most: int) -> list[int]:
    return [1, *(n for n in range(2, most + 1) if all(n % p for p in range(2, int(n**0.5) + 1)))]


def swipe(x: np.ndarray, rate: float, low: float = 100.0, high: float = 1200.0, hop: int = 256, least: float = 0.3) -> np.ndarray:
    """Pitch of each frame, 0 where unvoiced, by how well a sawtooth's spectrum fits: kernels with lobes at the first and the prime harmonics.

    Candidates stand 48 to the octave. Each is scored on spectra whose windows hold about eight of its periods (between two
    such windows by interpolation), at frequencies even on an ERB scale; the best score of a frame is
    interpolated by a parabola, and counts as voiced if it is ``least`` or more.
    """
    x = np.asarray(x, float)
    n = len(x) // hop + 1 if len(x) else 0
    if not n:
        return np.zeros(0)
    tried = 2 ** np.arange(math.log2(low), math.log2(high) + 1e-9, 1 / 48)
    longest, shortest = (round(math.log2(8 * rate / p)) for p in (low, high))
    sizes = [1 << k for k in range(longest, shortest - 1, -1)]
    octave = np.log2(tried) - math.log2(8 * rate / sizes[0])  # 0 where the first window is right, 1 the second
    grid = np.arange(_erb(low / 4), _erb(min(rate / 2, high * 12)), 0.1)
    at = 229 * (10 ** (grid / 21.4) - 1)
    kernels = np.zeros((len(tried), len(at)))
    for c, f in enumerate(tried):
        q = at / f
        for p in _primes(int(at[-1] / f - 0.75) or 1):
            off = np.abs(q - p)
            kernels[c, off < 0.25] = np.cos(2 * np.pi * q[off < 0.25])
            valley = (off > 0.25) & (off < 0.75)
            kernels[c, valley] += np.cos(2 * np.pi * q[valley]) / 2
        kernels[c] *= np.sqrt(1 / at)
        kernels[c] /= max(np.linalg.norm(kernels[c][kernels[c] > 0]), 1e-12)
    score = np.zeros((n, len(tried)))
    for k, size in enumerate(sizes):
        near = octave - k
        share = np.clip(1 - np.abs(near), 0, 1)
        if k == 0:
            share = np.where(near < 0, 1.0, share)
        if k == len(sizes) - 1:
            share = np.where(near > 0, 1.0, share)
        own = share > 0
        if not own.any():
            continue
        padded = np.pad(x, (size // 2, size // 2 + hop))
        loud = np.abs(np.fft.rfft(framed(padded, size, hop)[:n] * hann(size)))
        loud = np.sqrt(np.array([np.interp(at, np.arange(size // 2 + 1) * rate / size, row, right=0.0) for row in loud]))
        loud = loud / np.maximum(np.linalg.norm(loud, axis=1, keepdims=True), 1e-12)
        score[:, own] += share[own] * (loud @ kernels[own].T)
    out = np.zeros(n)
    for t, row in enumerate(score):
        k = int(row.argmax())
        if row[k] >= least:
            place, _ = _parabola(row, k)
            out[t] = low * 2 ** (place / 48)
    return out
