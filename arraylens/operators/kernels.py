"""numpy kernels on one waterfall, for what ordered windows can't express.

Arrays are (time, channel). NaN marks missing samples. Filters see edges
mirrored with the edge sample repeated.
"""

from __future__ import annotations

import numpy as np

MAD_SQUARE = 0.456


def clamp(k: int, size: int) -> int:
    if k < 1:
        raise ValueError("filter sizes must be 1 or more")
    return min(k, size)


def rank_filter(x: np.ndarray, kt: int, kf: int) -> np.ndarray:
    """Upper median of the (2kt + 1) x (2kf + 1) box around each sample, the sample left out."""
    kt, kf = clamp(kt, x.shape[0]), clamp(kf, x.shape[1])
    padded = np.pad(x, ((kt, kt), (kf, kf)), mode="symmetric")
    size = (2 * kt + 1) * (2 * kf + 1)
    centre = size // 2
    out = np.empty_like(x, float)
    boxes = np.lib.stride_tricks.sliding_window_view(padded, (2 * kt + 1, 2 * kf + 1))
    for i in range(x.shape[0]):  # one row of boxes at a time bounds memory
        flat = boxes[i].reshape(x.shape[1], size)
        flat = np.delete(flat, centre, axis=1)
        out[i] = np.partition(flat, centre, axis=1)[:, centre]
    return out


def detrend_medfilt(x: np.ndarray, flags: np.ndarray | None = None, kt: int = 8, kf: int = 8) -> np.ndarray:
    if np.iscomplexobj(x):
        d = x - (rank_filter(x.real, kt, kf) + 1j * rank_filter(x.imag, kt, kf))
    else:
        d = x - rank_filter(x, kt, kf)
    scale = np.sqrt(rank_filter(np.abs(d) ** 2, kt, kf) / MAD_SQUARE)
    with np.errstate(all="ignore"):
        return np.where(np.abs(scale) > np.finfo(float).eps, d / scale, np.inf)


def box_mean(x: np.ndarray, weight: np.ndarray, kt: int, kf: int) -> np.ndarray:
    def summed(a: np.ndarray) -> np.ndarray:
        c = np.pad(a, ((1, 0), (1, 0))).cumsum(0).cumsum(1)
        n, m = a.shape
        t0, t1 = np.clip(np.arange(n) - kt, 0, n), np.clip(np.arange(n) + kt + 1, 0, n)
        f0, f1 = np.clip(np.arange(m) - kf, 0, m), np.clip(np.arange(m) + kf + 1, 0, m)
        return c[t1][:, f1] - c[t0][:, f1] - c[t1][:, f0] + c[t0][:, f0]

    total, w = summed(np.where(weight > 0, x, 0.0) * weight), summed(weight)
    with np.errstate(all="ignore"):
        return np.where(w > 0.5, total / w, np.nan)


def detrend_meanfilt(x: np.ndarray, flags: np.ndarray | None = None, kt: int = 8, kf: int = 8) -> np.ndarray:
    kt, kf = clamp(kt, x.shape[0]), clamp(kf, x.shape[1])
    good = np.isfinite(x) if flags is None else np.isfinite(x) & ~flags
    pad = ((kt, kt), (kf, kf))
    w = np.pad(good.astype(float), pad, mode="symmetric")
    p = np.pad(np.where(good, x, 0.0), pad, mode="symmetric")
    d = p - box_mean(p, w, kt, kf)
    s = np.sqrt(box_mean(np.where(np.isfinite(d), d, 0.0) ** 2, w, kt, kf))
    with np.errstate(all="ignore"):
        z = np.where(np.abs(s) > np.finfo(float).eps, d / s, np.inf)[kt:-kt, kf:-kf]
    return np.where(np.isfinite(x), z, np.nan)


def medmin(x: np.ndarray) -> float:
    low = np.min(x, axis=0)
    return 2 * np.median(low) - low.min()


def medmin_filter(x: np.ndarray, kt: int = 8, kf: int = 8) -> np.ndarray:
    out = np.empty(x.shape)
    for i in range(x.shape[0]):
        low = x[max(0, i - kt) : i + kt].min(0)
        for j in range(x.shape[1]):
            part = low[max(0, j - kf) : j + kf]
            out[i, j] = 2 * np.median(part) - part.min()
    return out


def detrend_medminfilt(x: np.ndarray, flags: np.ndarray | None = None, kt: int = 8, kf: int = 8) -> np.ndarray:
    kt, kf = clamp(kt, x.shape[0]), clamp(kf, x.shape[1])
    d = x - medmin_filter(np.abs(x), 2 * kt + 1, 2 * kf + 1)
    s = np.sqrt(medmin_filter(np.abs(d) ** 2, 2 * kt + 1, 2 * kf + 1)) * np.sqrt(kt**2 + kf**2) / 0.64
    with np.errstate(all="ignore"):
        return np.where(s > np.finfo(float).eps, d / s, np.inf)


def detrend_deriv(x: np.ndarray, flags: np.ndarray | None = None, dt: bool = True, df: bool = True) -> np.ndarray:
    d = np.gradient(x, axis=1) if df else x
    d = np.gradient(d, axis=0) if dt else d
    q = np.abs(d) ** 2
    sf, st = np.median(q, axis=0), np.median(q, axis=1)
    with np.errstate(all="ignore"):
        scale = np.sqrt(sf[None, :] * (st / np.median(st))[:, None])
        return np.where(scale > np.finfo(float).eps, d / scale, np.inf)


def zscore_full(x: np.ndarray, flags: np.ndarray | None = None, modified: bool = False) -> np.ndarray:
    y = np.where(flags, np.nan, x) if flags is not None else x
    if modified:
        c = np.nanmedian(y)
        s = np.nanmedian(np.abs(y - c)) * 1.486
    else:
        c, s = np.nanmean(y), np.nanstd(y)
    with np.errstate(all="ignore"):
        z = (y - c) / s
    return np.where(np.isfinite(z), z, np.inf)


def modzscore(x: np.ndarray, k: int = 8, detrend: bool = True) -> np.ndarray:
    """Modified z of a series; about its running upper median where detrend is set."""
    x = np.asarray(x, float)
    with np.errstate(all="ignore"):
        if not detrend:
            d = x - np.nanmedian(x)
            return d / np.sqrt(np.nanmedian(d**2) / MAD_SQUARE)

        def running(y: np.ndarray) -> np.ndarray:
            p = np.pad(y, k, mode="symmetric")
            b = np.delete(np.lib.stride_tricks.sliding_window_view(p, 2 * k + 1), k, axis=1)
            return np.sort(b, axis=1)[:, k]

        k = clamp(k, len(x))
        d = x - running(x)
        s = np.sqrt(running(d**2) / MAD_SQUARE)
        return np.where(s > np.finfo(float).eps, d / s, np.inf)


def watershed(metric: np.ndarray, seed: np.ndarray, nsig: float = 2.0) -> np.ndarray:
    """Grows flags to neighbours along each axis whose metric is nsig or more, until none is left."""
    with np.errstate(all="ignore"):
        ready = metric >= nsig
    flag = seed.copy()
    while True:
        near = np.zeros_like(flag)
        for axis in range(flag.ndim):
            a, b = [slice(None)] * flag.ndim, [slice(None)] * flag.ndim
            a[axis], b[axis] = slice(1, None), slice(None, -1)
            near[tuple(a)] |= flag[tuple(b)]
            near[tuple(b)] |= flag[tuple(a)]
        new = near & ready & ~flag
        if not new.any():
            return flag
        flag |= new


#: Named detrending algorithms.
ALGORITHMS = {
    "medmin": lambda x, flags=None, kt=8, kf=8: np.full(x.shape, medmin(x)),
    "medminfilt": lambda x, flags=None, kt=8, kf=8: medmin_filter(x, kt, kf),
    "detrend_deriv": lambda x, flags=None, kt=8, kf=8: detrend_deriv(x, flags),
    "detrend_medminfilt": detrend_medminfilt,
    "detrend_medfilt": detrend_medfilt,
    "detrend_meanfilt": detrend_meanfilt,
    "zscore_full_array": lambda x, flags=None, kt=8, kf=8: zscore_full(x, flags),
    "modzscore_full_array": lambda x, flags=None, kt=8, kf=8: zscore_full(x, flags, modified=True),
}


def xrfi_waterfall(
    x: np.ndarray, flags: np.ndarray | None = None, kt: int = 8, kf: int = 8, first: float = 6.0, next_to: float = 2.0, algorithm: str = "detrend_medfilt"
) -> np.ndarray:
    """Flags where the metric is `first` or more or a flag stood before, grown at `next_to`."""
    z = ALGORITHMS[algorithm](x, flags, kt, kf)
    with np.errstate(all="ignore"):
        seed = z >= first
    return watershed(z, seed if flags is None else seed | flags, next_to)


def channel_counts(flags: np.ndarray, share: float) -> np.ndarray:
    """Adds whole channels with more than low + share * (times - low) flags, low being the least of any channel."""
    n = flags.sum(0)
    return flags | (n > n.min() + share * (flags.shape[0] - n.min()))[None, :]


def simple_flag_waterfall(
    x: np.ndarray, kt: int = 8, kf: int = 8, first: float = 5.0, next_to: float = 2.0, edge_cut: int = 0, share: float = 1.0, fix_nonfinite_time: bool = False
) -> np.ndarray:
    """Median- and mean-filter flags with growth, then whole integrations and channels, edges and busy channels."""
    with np.errstate(all="ignore"):
        zmed = detrend_medfilt(x, None, kt, kf)
        flags = watershed(zmed, np.abs(zmed) > first, next_to)  # growth is signed, starts are not
        zmean = detrend_meanfilt(x, flags, kt, kf)
        grown = watershed(np.where(np.isfinite(zmean), zmean, -np.inf), (np.abs(zmean) > first) | flags, next_to)
        z = np.where(flags, zmed, zmean)
        z = np.where(np.isfinite(z), z, np.nan)
        freq, time = np.nanmedian(z, axis=0), np.nanmedian(z, axis=1)
        zf, zt = np.abs(modzscore(freq, kf, detrend=False)), np.abs(modzscore(time, kt, detrend=False))
        zf = np.where(np.isfinite(zf), zf, first)
        if fix_nonfinite_time:
            zt = np.where(np.isfinite(zt), zt, first)
        flags = flags | grown | watershed(zf, zf >= first, next_to)[None, :] | watershed(zt, zt >= first, next_to)[:, None]
    if edge_cut:
        flags[:, :edge_cut] = True
        flags[:, -edge_cut:] = True
    return channel_counts(flags, share)


def max_gap(flags: np.ndarray, longest: int = 30) -> np.ndarray:
    """At each run of flags longer than `longest`, the longest first and of equal ones the last, flags the side with fewer unflagged samples."""
    flags = flags.copy()
    edge = np.flatnonzero(np.diff(np.concatenate([[0], flags.astype(int), [0]])))
    runs = sorted(edge.reshape(-1, 2), key=lambda r: (r[1] - r[0], r[0]), reverse=True)
    for a, b in runs:
        if b - a > longest:
            if np.sum(~flags[:a]) > np.sum(~flags[b:]):
                flags[b:] = True
            else:
                flags[:a] = True
    return flags


def gauss_smooth(x: np.ndarray, sigma: float) -> np.ndarray:
    """x weighted by a Gaussian over as many samples as it has, half of them before (rounded down), edges mirrored."""
    n = len(x)
    before, after = n // 2, n - n // 2
    kernel = np.exp(-(np.arange(-before, after + 1) ** 2) / (2 * sigma**2))
    return np.correlate(np.pad(x, (before, after), mode="symmetric"), kernel / kernel.sum(), "valid")


def stretches(on: np.ndarray) -> np.ndarray:
    """(start, stop) of each run of true values."""
    return np.flatnonzero(np.diff(np.concatenate([[0], on.astype(int), [0]]))).reshape(-1, 2)


def convolution_flagging(metric: np.ndarray, start: np.ndarray, ok: tuple[float, float], sigma: float = 30, longest: int = 30) -> np.ndarray:
    """Adds the whole stretches in which the smoothed metric never returns to the ok range, and limits gaps, until nothing changes.

    Stretches are what lies between the flagged ones whose smoothed metric exceeds the range; other flags don't end one.
    """
    smooth = gauss_smooth(metric, sigma)
    fine = (smooth >= ok[0]) & (smooth <= ok[1])
    flags = start.copy()
    while True:
        before = flags.sum()
        rest = np.ones(len(flags), bool)
        for a, b in stretches(flags):
            rest[a:b] = not (smooth[a:b] > ok[1]).any()
        for a, b in stretches(rest):
            if not fine[a:b].any():
                flags[a:b] = True
        flags = max_gap(flags, longest)
        if flags.sum() == before:
            return flags


def dpss_basis(freqs: np.ndarray, centers: list[float], half_widths: list[float], cutoffs: list[float]) -> np.ndarray:
    """Prolate sequences of each delay window whose eigenvalues pass its cutoff."""
    parts = []
    for c, h, e in zip(centers, half_widths, cutoffs, strict=True):
        gap = freqs[:, None] - freqs[None, :]
        step = np.median(np.diff(freqs))
        values, vectors = np.linalg.eigh(np.sinc(2 * h * gap) * 2 * h * step)
        parts.append(vectors[:, values > e] * np.exp(2j * np.pi * c * freqs)[:, None])
    basis = np.concatenate(parts, axis=1)
    return basis.real if not np.any(np.array(centers)) else basis


def dpss_flagger(
    x: np.ndarray, noise: np.ndarray, freqs: np.ndarray, centers: list[float], half_widths: list[float], flags: np.ndarray | None = None, nsig: float = 6.0,
    cutoffs: list[float] | None = None,
) -> np.ndarray:
    """Flags samples more than nsig noises above a smooth model of each integration, fit to its unflagged samples."""
    basis = dpss_basis(freqs, centers, half_widths, cutoffs or [1e-9] * len(centers))
    good = np.isfinite(x) & (x != 0)
    w = good if flags is None else good & ~flags
    out = np.zeros(x.shape, bool)
    for i, row in enumerate(x):
        a = basis * w[i][:, None]
        fit = np.linalg.lstsq(a, np.where(w[i], row, 0), rcond=None)[0]
        model = basis @ fit
        with np.errstate(all="ignore"):
            out[i] = row - model > nsig * np.abs(model) * noise[i] / np.where(good[i], row, np.nan)
    return out


def gp_likelihood(p: np.ndarray, gap: np.ndarray, y: np.ndarray) -> tuple[float, np.ndarray]:
    """Negative log marginal likelihood of y and its gradient by the logarithms p of an RBF kernel's length and a white noise's variance.

    gap has the squared distances of the samples; the kernel's own variance is 1.
    """
    length, noise = np.exp(p)
    smooth = np.exp(-gap / (2 * length**2))
    try:
        low = np.linalg.cholesky(smooth + noise * np.eye(len(y)))
    except np.linalg.LinAlgError:
        return np.inf, np.zeros(2)
    inverse = np.linalg.inv(low)
    inverse = inverse.T @ inverse
    a = inverse @ y
    value = 0.5 * y @ a + np.log(np.diag(low)).sum() + 0.5 * len(y) * np.log(2 * np.pi)
    rest = inverse - np.outer(a, a)
    return float(value), np.array([0.5 * np.sum(rest * (smooth * gap / length**2)), 0.5 * noise * np.trace(rest)])


def gp_fit(
    times: np.ndarray, y: np.ndarray, lengths: tuple[float, float] = (0.01, 1.0), noises: tuple[float, float] = (1e-5, 1e5), starts: tuple = ((0.2, 0.01), (0.03, 0.01), (0.2, 1.0)), rounds: int = 60
) -> tuple[float, float]:
    """(length, noise) of the largest marginal likelihood within the bounds, by quasi-Newton descent from each start."""
    gap = (times[:, None] - times[None, :]) ** 2
    lo, hi = np.log([lengths[0], noises[0]]), np.log([lengths[1], noises[1]])
    best = (np.inf, np.log(starts[0]))
    for start in starts:
        p = np.clip(np.log(start), lo, hi)
        f, g = gp_likelihood(p, gap, y)
        h = np.eye(2)
        for _ in range(rounds):
            free = ~(((p <= lo) & (g > 0)) | ((p >= hi) & (g < 0)))  # parameters that a bound does not hold
            if not np.isfinite(f) or np.abs(g[free]).max(initial=0) < 1e-6:
                break
            step = -(h @ (g * free)) * free
            if step @ g >= 0:
                h, step = np.eye(2), -g * free
            step *= min(1.0, 2.0 / np.abs(step).max())
            t = 1.0
            while t > 1e-8:
                q = np.clip(p + t * step, lo, hi)
                f2, g2 = gp_likelihood(q, gap, y)
                if f2 <= f + 1e-4 * (q - p) @ g:
                    break
                t /= 2
            else:
                break
            s, d = q - p, g2 - g
            if f - f2 < 1e-12 * max(1.0, abs(f)):
                p, f, g = q, f2, g2
                break
            if s @ d > 1e-12:  # update of the inverse curvature
                r = 1 / (s @ d)
                left = np.eye(2) - r * np.outer(s, d)
                h = left @ h @ left.T + r * np.outer(s, s)
            p, f, g = q, f2, g2
        if f < best[0]:
            best = (f, p)
    length, noise = np.exp(best[1])
    return float(length), float(noise)


def biweight_scale(y: np.ndarray) -> float:
    """Square root of the biweight midvariance."""
    d = y - np.median(y)
    mad = np.median(np.abs(d))
    if mad == 0:
        return 0.0
    u = (d / (9 * mad)) ** 2
    d, u = d[u < 1], u[u < 1]
    return float(np.sqrt(len(y) * np.sum(d**2 * (1 - u) ** 4)) / np.abs(np.sum((1 - u) * (1 - 5 * u))))


def gp_smooth(times: np.ndarray, y: np.ndarray, length: float | None = None, noise: float | None = None) -> np.ndarray:
    """What a Gaussian process with an RBF kernel and white noise predicts at the times of its samples; NaNs are skipped.

    Samples are scaled by their biweight scatter; length and noise are fitted
    unless both are given. Without two samples or scatter the prediction is 0.
    """
    ok = np.isfinite(y)
    size = biweight_scale(y[ok]) if ok.sum() > 1 else 0.0
    if size == 0:
        return np.zeros(len(y))
    x, z = times[ok], y[ok] / size
    if length is None or noise is None:
        length, noise = gp_fit(x, z)
    k = np.exp(-((times[:, None] - x[None, :]) ** 2) / (2 * length**2))
    return size * (k @ np.linalg.solve(k[ok] + noise * np.eye(len(x)), z))


def phase_spectrum(gain: np.ndarray) -> np.ndarray:
    """Median over time of the absolute delay transform of (time, channel) gains; the channel axis alone is shifted."""
    f = np.fft.fftshift(np.fft.fft(gain, axis=1), axes=1)
    return np.abs(np.median(f.real, axis=0) + 1j * np.median(f.imag, axis=0))
