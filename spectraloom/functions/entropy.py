"""Spectral entropy similarity (Li et al., Nature Methods 18, 2021)."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np


def clean(mz: np.ndarray, intensity: np.ndarray, gap: float, weakest: float = 0.01) -> tuple[np.ndarray, np.ndarray]:
    """Peaks that are valid, centroided to a distance of ``gap``, not weak, weighted, with sum 1, by rising m/z.

    Peaks closer than ``gap`` are joined around the most intense one, intensities added
    and m/z weighted by intensity, until none are. Those under ``weakest`` times the
    highest are dropped. Below an entropy of 3, intensities are raised to the power
    0.25 + 0.25 * entropy.
    """
    ok = np.isfinite(mz) & np.isfinite(intensity) & (mz > 0) & (intensity > 0)
    mz, intensity = mz[ok], intensity[ok]
    order = np.argsort(mz, kind="stable")
    mz, intensity = mz[order], intensity[order]
    while len(mz) > 1 and (np.diff(mz) < gap).any():
        left = np.ones(len(mz), bool)
        new_mz, new_int = mz.copy(), intensity.copy()
        for i in np.argsort(-intensity, kind="stable"):
            if not left[i]:
                continue
            lo, hi = np.searchsorted(mz, mz[i] - 2 * gap), np.searchsorted(mz, mz[i] + 2 * gap)
            # the difference itself is tested, as above, so every round joins at least one pair
            own = np.arange(lo, hi)[left[lo:hi] & ((np.abs(mz[lo:hi] - mz[i]) < gap) | (np.arange(lo, hi) == i))]
            new_int[i] = intensity[own].sum()
            new_mz[i] = (mz[own] * intensity[own]).sum() / new_int[i]
            left[own] = False
            left[i] = True
            intensity = intensity.copy()
            intensity[own[own != i]] = 0.0
        keep = intensity > 0
        mz, intensity = new_mz[keep], new_int[keep]
        order = np.argsort(mz, kind="stable")
        mz, intensity = mz[order], intensity[order]
    if not len(mz):
        return mz, intensity
    strong = intensity >= weakest * intensity.max()
    mz, p = mz[strong], intensity[strong] / intensity[strong].sum()
    s = float(-(p * np.log(p)).sum())
    if s < 3:
        p = p ** (0.25 + 0.25 * s)
        p = p / p.sum()
    return mz, p


def _xlog(x: np.ndarray) -> np.ndarray:
    return np.where(x > 0, x * np.log2(np.where(x > 0, x, 1.0)), 0.0)


def matched_sums(left: list[tuple[np.ndarray, np.ndarray]], right: list[tuple[np.ndarray, np.ndarray]], tolerance: float, ppm: bool, gain: Callable[[np.ndarray, np.ndarray], np.ndarray]) -> np.ndarray:
    """Sum of ``gain(p, q)`` over the peaks of two spectra that agree within the tolerance, for all spectra of two lists; m/z must rise."""
    out = np.zeros((len(left), len(right)))
    if not left or not right:
        return out
    owner_r = np.repeat(np.arange(len(right)), [len(m) for m, _ in right])
    mz_r, p_r = np.concatenate([m for m, _ in right]), np.concatenate([p for _, p in right])
    order = np.argsort(mz_r, kind="stable")
    owner_r, mz_r, p_r = owner_r[order], mz_r[order], p_r[order]
    owner = np.repeat(np.arange(len(left)), [len(m) for m, _ in left])
    mz, p = np.concatenate([m for m, _ in left]), np.concatenate([p for _, p in left])
    width = mz * tolerance * 1e-6 if ppm else np.full(len(mz), tolerance)
    low, high = np.searchsorted(mz_r, mz - width, "left"), np.searchsorted(mz_r, mz + width, "right")
    size = high - low
    some = np.searchsorted(np.cumsum(size), np.arange(2_000_000, size.sum(), 2_000_000)) if len(size) else np.zeros(0, np.int64)
    for part in np.split(np.arange(len(mz)), some):  # some million matches at a time
        n = size[part]
        at = np.arange(int(n.sum())) - np.repeat(np.cumsum(n) - n, n) + np.repeat(low[part], n)
        cell = np.repeat(owner[part], n) * len(right) + owner_r[at]
        out += np.bincount(cell, weights=gain(np.repeat(p[part], n), p_r[at]), minlength=out.size).reshape(out.shape)
    return out


def entropy_block(left: list[tuple[np.ndarray, np.ndarray]], right: list[tuple[np.ndarray, np.ndarray]], tolerance: float, ppm: bool = False) -> np.ndarray:
    """Similarities of all cleaned spectra of two lists; a spectrum without peaks has 0 to all."""
    return np.clip(matched_sums(left, right, tolerance, ppm, lambda a, b: _xlog(a + b) - _xlog(a) - _xlog(b)) / 2, 0.0, 1.0)
