"""Spectral features of windows: power spectra, filterbanks, cepstra and their slopes.

Spark has no Fourier transform, so the numeric step is NumPy over Arrow batches of windows; every
window is independent and has a fixed size. Kinds share one spectrum, and filterbanks are built once
per task.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Spectrum:
    """Sizes of the analysis."""

    rate: int = 16000
    n_fft: int = 1024
    hop: int = 512
    n_mels: int = 128
    n_ceps: int = 40


def power_spectrum(y: np.ndarray, s: Spectrum) -> np.ndarray:
    """[bins, frames] power of centred, zero-padded Hann frames."""
    half = s.n_fft // 2
    frames = np.lib.stride_tricks.sliding_window_view(np.pad(y, half), s.n_fft)[:: s.hop]
    taper = 0.5 - 0.5 * np.cos(2 * np.pi * np.arange(s.n_fft) / s.n_fft)
    return np.abs(np.fft.rfft(frames * taper, axis=1).T) ** 2


def linear_bank(s: Spectrum, count: int) -> np.ndarray:
    """Triangles whose corners are equally spaced over whole spectrum bins."""
    corners = np.linspace(0, s.n_fft // 2, count + 2).astype(int)
    left, peak, right = (corners[i : i + count, None] for i in range(3))
    f = np.arange(s.n_fft // 2 + 1)
    rise = (f - left) / np.maximum(peak - left, 1)
    fall = (right - f) / np.maximum(right - peak, 1)
    return np.where((f >= left) & (f < peak), rise, np.where((f >= peak) & (f < right), fall, 0.0))


def mel_bank(s: Spectrum, count: int) -> np.ndarray:
    """Area-normalised triangles on the Slaney scale: linear below 1 kHz, logarithmic above."""
    step, knee, log_step = 200.0 / 3.0, 1000.0, math.log(6.4) / 27.0
    top = s.rate / 2
    top_mel = top / step if top < knee else knee / step + math.log(top / knee) / log_step
    mels = np.linspace(0.0, top_mel, count + 2)
    corners = np.where(mels < knee / step, mels * step, knee * np.exp(log_step * (mels - knee / step)))
    f = np.linspace(0.0, top, s.n_fft // 2 + 1)
    left, peak, right = (corners[i : i + count, None] for i in range(3))
    shape = np.maximum(0.0, np.minimum((f - left) / (peak - left), (right - f) / (right - peak)))
    return shape * (2.0 / (right - left))


def cosine_basis(n: int) -> np.ndarray:
    """Orthonormal DCT-II matrix."""
    k, i = np.arange(n)[:, None], np.arange(n)
    basis = math.sqrt(2.0 / n) * np.cos(math.pi * k * (2 * i + 1) / (2 * n))
    basis[0] /= math.sqrt(2.0)
    return basis


def slope(x: np.ndarray, order: int, width: int = 9) -> np.ndarray:
    """Derivative of a least-squares polynomial of that order over `width` frames; the edges repeat the
    fit of the first and last full stretch. Fewer than `width` frames are an error."""
    if x.shape[1] < width:
        raise ValueError(f"a slope over {width} frames needs as many, the window has {x.shape[1]}")
    half = width // 2
    fit = np.linalg.pinv(np.vander(np.arange(-half, half + 1), order + 1, increasing=True))[order]
    inner = np.lib.stride_tricks.sliding_window_view(x, width, axis=1) @ (fit * math.factorial(order))
    return np.pad(inner, ((0, 0), (half, half)), mode="edge")


def stack_slopes(x: np.ndarray) -> np.ndarray:
    """[3, F, T]: the feature, its slope and its curvature."""
    return np.stack([x, slope(x, 1), slope(x, 2)])


def decibel_below_peak(p: np.ndarray, floor: float = 80.0) -> np.ndarray:
    db = 10.0 * np.log10(np.maximum(p, 1e-10))
    db -= 10.0 * np.log10(max(float(p.max()), 1e-10))
    return np.maximum(db, db.max() - floor)


def cepstra(power: np.ndarray, bank: np.ndarray, basis: np.ndarray) -> np.ndarray:
    return basis @ np.log(bank @ power + 1e-9)


WINDOWS = 64  # features of so many windows are held by a task at a time

Extractor = Callable[[np.ndarray], np.ndarray]


def extractors(s: Spectrum) -> dict[str, Extractor]:
    """Feature kinds by name; each maps a power spectrum to [F, T]."""
    wide, mel, lin, basis = mel_bank(s, s.n_mels), mel_bank(s, s.n_ceps), linear_bank(s, s.n_ceps), cosine_basis(s.n_ceps)
    return {
        "mel": lambda p: decibel_below_peak(wide @ p),
        "lfcc": lambda p: cepstra(p, lin, basis),
        "mfcc": lambda p: cepstra(p, mel, basis),
    }


def spectral_features(
    windows: DataFrame, kinds: Sequence[str], spectrum: Spectrum = Spectrum(),
    make: Callable[[Spectrum], dict[str, Extractor]] = extractors, cell: str = "float",
) -> DataFrame:
    """Features of (rec, window, samples): one row per window and kind with `values` [3][F][T] of the type `cell`.

    `make` returns the kinds by name, so other extractors can be supplied.
    """
    dtype = {"float": np.float32, "double": np.float64}[cell]
    kinds = list(kinds)
    unknown = set(kinds) - set(make(spectrum))
    if unknown:
        raise ValueError(f"unknown features: {sorted(unknown)}")

    def kernel(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        by_name = make(spectrum)
        for pdf in batches:
            for lo in range(0, len(pdf), WINDOWS):
                rows, part = [], pdf.iloc[lo : lo + WINDOWS]
                for rec, window, y in zip(part["rec"], part["window"], part["samples"]):
                    power = power_spectrum(np.asarray(y, dtype=float), spectrum)
                    for k in kinds:
                        values = stack_slopes(by_name[k](power)).astype(dtype)
                        rows.append((rec, window, k, [list(channel) for channel in values]))
                yield pd.DataFrame(rows, columns=["rec", "window", "feature", "values"])

    rec = dict(windows.dtypes)["rec"]
    return windows.select("rec", "window", "samples").mapInPandas(
        kernel, f"rec {rec}, window long, feature string, values array<array<array<{cell}>>>"
    )


def frame_vectors(features: DataFrame) -> DataFrame:
    """One row per frame of [C][F][T] features: (rec, window, feature, frame, x) with the C x F numbers of the frame."""
    lines = F.flatten("values")
    steps = F.sequence(F.lit(0), F.size(lines[0]) - 1)
    frames = F.transform(steps, lambda t: F.transform(lines, lambda line: line[t].cast("double")))
    return features.where(F.size(lines[0]) > 0).select("rec", "window", "feature", F.posexplode(frames).alias("frame", "x"))


def spectral_descriptors(windows: DataFrame, spectrum: Spectrum = Spectrum(), low_hz: float = 80.0, high_hz: float = 4000.0) -> DataFrame:
    """Share of power below low_hz and above high_hz, spectral centroid, 95 % and 99 % roll-off and the
    highest band within 60 dB of the peak, per window."""
    names = ["lf_ratio", "hf_ratio", "centroid_hz", "rolloff95_hz", "rolloff99_hz", "band_edge_hz"]

    def kernel(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        f = np.linspace(0.0, spectrum.rate / 2, spectrum.n_fft // 2 + 1)
        for pdf in batches:
            rows = []
            for y in pdf["samples"]:
                p = power_spectrum(np.asarray(y, dtype=float), spectrum).mean(axis=1)
                total = float(p.sum())
                if total <= 0.0:
                    rows.append([None] * len(names))
                    continue
                share = np.cumsum(p) / total
                rows.append(
                    [
                        float(p[f < low_hz].sum() / total),
                        float(p[f > high_hz].sum() / total),
                        float((f * p).sum() / total),
                        float(f[min(int(np.searchsorted(share, 0.95)), len(f) - 1)]),
                        float(f[min(int(np.searchsorted(share, 0.99)), len(f) - 1)]),
                        float(f[np.nonzero(p >= p.max() * 1e-6)[0][-1]]),
                    ]
                )
            out = pd.DataFrame(rows, columns=names, dtype="float64")
            out.insert(0, "window", pdf["window"].to_numpy())
            out.insert(0, "rec", pdf["rec"].to_numpy())
            yield out

    rec = dict(windows.dtypes)["rec"]
    schema = f"rec {rec}, window long, " + ", ".join(f"{n} double" for n in names)
    return windows.select("rec", "window", "samples").mapInPandas(kernel, schema)
