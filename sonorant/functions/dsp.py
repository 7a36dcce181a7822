"""Signal functions in numpy, for use inside vectorised UDFs; each takes one signal or matrix."""

from __future__ import annotations

import numpy as np


def hann(n: int) -> np.ndarray:
    """Periodic Hann window."""
    return 0.5 - 0.5 * np.cos(2 * np.pi * np.arange(n) / n)


def framed(x: np.ndarray, size: int, hop: int) -> np.ndarray:
    """Overlapping frames, the rest left out; none of a shorter signal."""
    if len(x) < size:
        return np.zeros((0, size), x.dtype)
    return np.lib.stride_tricks.sliding_window_view(x, size)[::hop]


def stft(x: np.ndarray, fft: int, hop: int, size: int) -> np.ndarray:
    """Magnitudes (frames, fft // 2 + 1)."""
    return np.abs(np.fft.rfft(framed(x, size, hop) * hann(size), fft))


def mel(f: np.ndarray | float) -> np.ndarray | float:
    return 1127.0 * np.log1p(np.asarray(f) / 700.0)


def mel_matrix(bands: int, bins: int, rate: float, low: float, high: float) -> np.ndarray:
    """Triangular filters in mel space, (bins, bands); the DC row is zero."""
    if not 0 <= low < high <= rate / 2:
        raise ValueError("band edges must satisfy 0 <= low < high <= rate / 2")
    at = mel(np.linspace(0, rate / 2, bins))
    edges = np.linspace(mel(low), mel(high), bands + 2)
    left, mid, right = edges[:-2], edges[1:-1], edges[2:]
    up, down = (at[:, None] - left) / (mid - left), (right - at[:, None]) / (right - mid)
    out = np.maximum(0, np.minimum(up, down))
    out[0] = 0
    return out


def log_mel(x: np.ndarray, rate: float, bands: int = 64, low: float = 125.0, high: float = 7500.0, window: float = 0.025, hop: float = 0.010, offset: float = 0.01) -> np.ndarray:
    """Log-mel spectrogram (frames, bands); the transform's length is the next power of two."""
    size, step = round(rate * window), round(rate * hop)
    fft = 1 << (size - 1).bit_length()
    return np.log(stft(x, fft, step, size) @ mel_matrix(bands, fft // 2 + 1, rate, low, high) + offset)


def mfcc(x: np.ndarray, rate: float, n: int = 13, **options: float) -> np.ndarray:
    """Cepstral coefficients (frames, n): orthonormal cosine transform of the log-mel bands."""
    m = log_mel(x, rate, **options)
    k = m.shape[1]
    basis = np.cos(np.pi / k * (np.arange(k) + 0.5)[:, None] * np.arange(n)) * np.sqrt(2 / k)
    basis[:, 0] /= np.sqrt(2)
    return m @ basis


def rms(x: np.ndarray, size: int = 2048, hop: int = 512) -> np.ndarray:
    """Root mean square of centred frames, zeros beyond the ends."""
    return np.sqrt(np.mean(framed(np.pad(np.asarray(x, float), size // 2), size, hop) ** 2, axis=1))


def gaussian(x: np.ndarray, sigma: float = 2.0, cut: float = 4.0) -> np.ndarray:
    """Gaussian smoothing, the signal mirrored at its ends."""
    r = int(cut * sigma + 0.5)
    w = np.exp(-0.5 * (np.arange(-r, r + 1) / sigma) ** 2)
    return np.convolve(np.pad(np.asarray(x, float), r, mode="symmetric"), w / w.sum(), "valid") if len(x) else np.zeros(0)


def envelope(x: np.ndarray) -> np.ndarray:
    """Magnitude of the analytic signal."""
    n = len(x)
    if not n:
        return np.zeros(0)
    gain = np.zeros(n)
    gain[0] = 1
    gain[1 : (n + 1) // 2] = 2
    if n % 2 == 0:
        gain[n // 2] = 1
    return np.abs(np.fft.ifft(np.fft.fft(x) * gain))


def wobble(x: np.ndarray) -> int:
    """Number of the strongest frequency of a track, DC left out; 0 if there is none."""
    return int(np.abs(np.fft.rfft(x))[1:].argmax()) + 1 if len(x) > 1 else 0


def moments(x: np.ndarray) -> tuple[float, float, float]:
    """Central moments of order 2, 3 and 4."""
    c = np.asarray(x, float) - np.mean(x)
    return float((c**2).mean()), float((c**3).mean()), float((c**4).mean())


def harmonic_energies(x: np.ndarray, rate: float, f0: float, n: int = 12, size: int = 2048, hop: int = 512, last: bool = False) -> np.ndarray:
    """Spectral magnitude nearest to each of the first ``n`` harmonics, (frames, n); one row of zeros for a signal shorter than a frame.

    ``last`` tells whether a frame that ends exactly with the signal counts. Harmonics beyond half the rate are 0.
    """
    frames = framed(np.asarray(x, float), size, hop)
    if not last and len(x) >= size and (len(x) - size) % hop == 0:
        frames = frames[:-1]
    if not len(frames):
        return np.zeros((1, n))
    spectrum = np.abs(np.fft.rfft(frames * np.hanning(size)))  # the symmetric window
    at = f0 * np.arange(1, n + 1) * size / rate
    bins = np.ceil(at - 0.5).astype(int)  # half way between two bins the lower one is nearest
    return np.where(at > size // 2, 0.0, spectrum[:, np.minimum(bins, size // 2)])


def trends(shares: np.ndarray) -> np.ndarray:
    """Least-squares slope of each column over the rows; 0 for a single row."""
    t = np.arange(len(shares)) - (len(shares) - 1) / 2
    return t @ shares / (t @ t) if len(shares) > 1 else np.zeros(shares.shape[1])


def pitch(x: np.ndarray, rate: float, low: float = 75.0, high: float = 600.0, size: int = 2048, hop: int = 512, least: float = 0.3) -> np.ndarray:
    """Pitch track by autocorrelation (this library's own stand-in for external trackers); NaN where unvoiced."""
    out = []
    first, last = int(rate / high), int(rate / low)
    for f in framed(x, size, hop):
        f = f - f.mean()
        r = np.fft.irfft(np.abs(np.fft.rfft(f, 2 * size)) ** 2)[: last + 1]
        k = first + int(r[first:].argmax()) if len(r) > first else 0
        out.append(rate / k if k and r[0] > 0 and r[k] / r[0] >= least else np.nan)
    return np.array(out)


def resample(x: np.ndarray, rate: float, target: float) -> np.ndarray:
    """Fourier resampling to ``round(len * target / rate)`` samples."""
    n = round(len(x) * target / rate)
    if not len(x) or not n:
        return np.zeros(n)
    spectrum = np.fft.rfft(x)
    return np.fft.irfft(spectrum[: n // 2 + 1], n) * n / len(x)


def attention_pool(x: np.ndarray, w_in: np.ndarray, b_in: np.ndarray, w_out: np.ndarray, b_out: np.ndarray, heads: int = 4) -> np.ndarray:
    """Multi-head self-attention over windows (n, d) with given weights, then the mean window."""
    n, d = x.shape
    q, k, v = np.split(x @ w_in.T + b_in, 3, axis=1)
    split = lambda m: m.reshape(n, heads, d // heads).transpose(1, 0, 2)
    score = split(q) @ split(k).transpose(0, 2, 1) / np.sqrt(d // heads)
    e = np.exp(score - score.max(axis=2, keepdims=True))
    mixed = (e / e.sum(axis=2, keepdims=True)) @ split(v)
    return (mixed.transpose(1, 0, 2).reshape(n, d) @ w_out.T + b_out).mean(axis=0)


def scored_pool(x: np.ndarray, w: np.ndarray, b: float) -> np.ndarray:
    """Mean of windows weighted by a softmax of linear scores."""
    s = x @ w + b
    e = np.exp(s - s.max())
    return (e / e.sum()) @ x


def postprocess(x: np.ndarray, axes: np.ndarray, mean: np.ndarray, low: float = -2.0, high: float = 2.0) -> np.ndarray:
    """PCA with given axes and mean, clipped and quantised to 0..255."""
    y = (x - mean) @ axes.T
    return ((np.clip(y, low, high) - low) * (255.0 / (high - low))).astype(np.uint8)


def masked(x: np.ndarray, rng: np.random.Generator, bands: int = 30, frames: int = 40) -> np.ndarray:
    """A copy with one random band of frequencies and one of frames zeroed."""
    out = x.copy()
    for axis, most in ((1, bands), (0, frames)):
        width = int(rng.integers(0, min(most, x.shape[axis]) + 1))
        at = int(rng.integers(0, x.shape[axis] - width + 1))
        out[(slice(None), slice(at, at + width)) if axis else slice(at, at + width)] = 0
    return out


def delta(x: np.ndarray, width: int = 9, order: int = 1) -> np.ndarray:
    """Local slope (or curvature for ``order`` 2) of each row over ``width`` frames: a least-squares polynomial of that order, ends by edge values."""
    h = width // 2
    t = np.arange(-h, h + 1)
    weights = np.linalg.pinv(np.vander(t, order + 1, increasing=True))[order] * (1 if order == 1 else 2)
    wide = np.pad(np.asarray(x, float), [(0, 0)] * (x.ndim - 1) + [(h, h)], mode="edge")
    return np.lib.stride_tricks.sliding_window_view(wide, width, axis=-1) @ weights


def resized(x: np.ndarray, frames: int) -> np.ndarray:
    """(frames, bands) by cubic convolution (a = -0.5) along time; an own interpolation, not bit-equal to image libraries."""
    n = len(x)
    if not n:
        return np.zeros((frames, x.shape[1]))
    at = (np.arange(frames) + 0.5) * n / frames - 0.5
    base = np.floor(at).astype(int)
    out, total = np.zeros((frames, x.shape[1])), np.zeros(frames)
    for k in range(-1, 3):
        d = np.abs(at - (base + k))
        w = np.where(d <= 1, 1.5 * d**3 - 2.5 * d**2 + 1, np.where(d < 2, -0.5 * d**3 + 2.5 * d**2 - 4 * d + 2, 0.0))
        out += w[:, None] * x[np.clip(base + k, 0, n - 1)]
        total += w
    return out / total[:, None]


def byte_windows(x: np.ndarray, size: int = 224, hop: int = 112) -> np.ndarray:
    """Windows along the last axis, short input padded with its minimum, each scaled to 0..255 by its own range."""
    if x.shape[-1] < size:
        x = np.pad(x, [(0, 0)] * (x.ndim - 1) + [(0, size - x.shape[-1])], constant_values=x.min() if x.size else 0.0)
    w = np.moveaxis(np.lib.stride_tricks.sliding_window_view(x, size, axis=-1)[..., ::hop, :], -2, 0)
    axes = tuple(range(1, w.ndim))
    low, high = w.min(axis=axes, keepdims=True), w.max(axis=axes, keepdims=True)
    return ((w - low) / np.where(high > low, high - low, 1) * 255).astype(np.uint8)


def mel_slaney(f: np.ndarray | float) -> np.ndarray:
    """The auditory-toolbox scale: linear (3 / 200 mel a hertz) below 1000 Hz, logarithmic (27 steps for a factor of 6.4) above."""
    f = np.asarray(f, float)
    return np.where(f < 1000, f * 3 / 200, 15 + np.log(np.maximum(f, 1e-9) / 1000) * 27 / np.log(6.4))


def mel_power(x: np.ndarray, rate: float, bands: int = 128, fft: int = 2048, hop: int = 512) -> np.ndarray:
    """Mel power spectrogram (bands, frames) of centred frames, zeros beyond the ends; triangles of unit area on the auditory-toolbox scale."""
    wide = np.pad(np.asarray(x, float), fft // 2)
    power = np.abs(np.fft.rfft(framed(wide, fft, hop) * hann(fft))) ** 2
    hertz = np.linspace(0, rate / 2, fft // 2 + 1)
    grid = np.linspace(0, rate / 2, 200_001)
    edges = np.interp(np.linspace(0, mel_slaney(rate / 2), bands + 2), mel_slaney(grid), grid)
    left, mid, right = (edges[k : k + bands, None] for k in range(3))
    tents = np.maximum(0, np.minimum((hertz - left) / (mid - left), (right - hertz) / (right - mid))) * 2 / (right - left)
    return tents @ power.T


def decibels(power: np.ndarray, floor: float = 1e-10, top: float = 80.0) -> np.ndarray:
    """Power in dB below its maximum, cut ``top`` dB below it."""
    if not power.size:
        return power
    loud = 10 * np.log10(np.maximum(power, floor))
    out = loud - 10 * np.log10(max(float(power.max()), floor))
    return np.maximum(out, out.max() - top)


def fbank(x: np.ndarray, rate: float, bands: int = 128, window: float = 0.025, hop: float = 0.010, low: float = 20.0, emphasis: float = 0.97) -> np.ndarray:
    """Log filterbank (frames, bands) as speech toolkits make it: whole frames, mean removed, pre-emphasis, symmetric Hann, power, HTK mel triangles.

    25 / 10 ms and 10 / 5 ms are the two settings in use.
    """
    size, step = int(rate * window), int(rate * hop)
    frames = framed(np.asarray(x, float), size, step)
    frames = frames - frames.mean(axis=1, keepdims=True) if len(frames) else frames
    frames = frames - emphasis * np.concatenate([frames[:, :1], frames[:, :-1]], axis=1)
    fft = 1 << (size - 1).bit_length()
    power = np.abs(np.fft.rfft(frames * np.hanning(size), fft))[:, : fft // 2] ** 2
    at, edges = mel(np.arange(fft // 2) * rate / fft), np.linspace(mel(low), mel(rate / 2), bands + 2)
    left, mid, right = (edges[k : k + bands, None] for k in range(3))
    tents = np.maximum(0, np.minimum((at - left) / (mid - left), (right - at) / (right - mid)))
    return np.log(np.maximum(power @ tents.T, np.finfo(np.float32).eps))


def normalised_windows(m: np.ndarray, size: int = 1024, hop: int = 512, mean: float = -4.2677393, std: float = 4.5689974) -> np.ndarray:
    """Windows (n, size, bands) of a filterbank, a shorter one padded with zeros, less the encoder's fixed mean and over its fixed deviation; the rest is left out."""
    if len(m) < size:
        m = np.pad(m, ((0, size - len(m)), (0, 0)))
    w = np.lib.stride_tricks.sliding_window_view(m, size, axis=0)[::hop].transpose(0, 2, 1)
    return (w - mean) / std


def examples(x: np.ndarray, rate: float, target: float = 16000.0, frames: int = 96) -> np.ndarray:
    """Waveform to (n, frames, bands) log-mel patches without overlap: resampled, 0.96 s each, the rest left out."""
    m = log_mel(resample(np.asarray(x, float), rate, target) if rate != target else np.asarray(x, float), target)
    return m[: len(m) // frames * frames].reshape(-1, frames, m.shape[1])


def loud_pieces(x: np.ndarray, rate: float, least: float = 10.0, floor: float = -60.0, keep: float = 0.5, step: float = 0.01) -> list[tuple[int, int]]:
    """Sample ranges between silences: ``least`` seconds or more under ``floor`` dBFS (by steps), ``keep`` seconds of silence left on at either end."""
    size = max(1, int(rate * step))
    n = -(-len(x) // size)
    power = np.add.reduceat(np.asarray(x, float) ** 2, np.arange(n) * size) / np.diff(np.r_[np.arange(n) * size, len(x)]) if n else np.zeros(0)
    quiet = np.r_[False, 10 * np.log10(power + 1e-20) < floor, False]
    edge = np.flatnonzero(quiet[1:] != quiet[:-1])
    silences = [(a, b) for a, b in zip(edge[::2].tolist(), edge[1::2].tolist(), strict=True) if (b - a) * step >= least - 1e-9]
    out, at, pad = [], 0, int(round(keep / step))
    for a, b in [*silences, (n, n)]:
        if a > at:
            out.append((max(at - pad, 0) * size, min(min(a + pad, n) * size, len(x))))
        at = b
    return out
