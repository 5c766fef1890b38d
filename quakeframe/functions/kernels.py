"""Small numpy kernels for sequential or signal-processing steps that column expressions can't carry."""

from __future__ import annotations

import numpy as np

#: Samples after its start in which a pick ends by the lower threshold.
LOOK = 100


def lower(threshold: float, drop: float) -> float:
    """threshold - drop as the decimals they are given as: 0.4 and 0.05 make 0.35, where floats make 0.35000000000000003."""
    return round(threshold - drop, 12)


def extract(p: np.ndarray, threshold: float, drop: float) -> list[tuple[int, int, float]]:
    """(index, width, probability) of the picks of a series.

    A pick starts at the first sample of at least `threshold`. It ends at the first one
    under threshold - drop if that lies within LOOK samples, else at the first one under
    `threshold`, else with the series; its index is the first maximum in between.
    """
    n, out = len(p), []
    high = np.flatnonzero(p >= threshold)
    under, low = np.flatnonzero(p < threshold), np.flatnonzero(p < lower(threshold, drop))
    k = 0
    while k < len(high):
        start = int(high[k])
        j = np.searchsorted(low, start)
        end = int(low[j]) if j < len(low) and low[j] < start + LOOK else None
        if end is None:
            j = np.searchsorted(under, start)
            end = int(under[j]) if j < len(under) else n
        best = start + int(np.argmax(p[start:end]))
        out.append((best, end - start, float(p[best])))
        k = int(np.searchsorted(high, end))
    return out


def merged_day(starts: np.ndarray, data: list[np.ndarray], rate: float, day: float) -> np.ndarray:
    """Segments as one day of samples: straight lines across gaps, edge values to the day's ends."""
    n = int(86400 * rate)
    at = np.concatenate([np.round((s - day) * rate).astype(np.int64) + np.arange(len(x)) for s, x in zip(starts, data, strict=True)])
    value = np.concatenate(data)
    inside = (at >= 0) & (at < n)
    at, first = np.unique(at[inside], return_index=True)
    return np.interp(np.arange(n), at, value[inside][first]) if len(at) else np.zeros(n)


def resampled(x: np.ndarray, old: float, new: float) -> np.ndarray:
    """x at another rate, by its Fourier coefficients."""
    n = int(round(len(x) * new / old))
    f = np.fft.rfft(x)
    g = np.zeros(n // 2 + 1, complex)
    m = min(len(f), len(g))
    g[:m] = f[:m]
    return np.fft.irfft(g, n) * (n / len(x))


def bandpass_sections(low: float, high: float, rate: float, order: int) -> np.ndarray:
    """Second-order sections (b0 b1 b2 a0 a1 a2) of a digital Butterworth band-pass, by the bilinear transform."""
    warp = lambda f: 2 * rate * np.tan(np.pi * f / rate)
    w1, w2 = warp(low), warp(high)
    band, centre = w2 - w1, w1 * w2
    poles = np.exp(1j * np.pi * (2 * np.arange(1, order + 1) + order - 1) / (2 * order)) * band / 2
    split = np.sqrt(poles**2 - centre)
    s = np.concatenate([poles + split, poles - split])
    z = (2 * rate + s) / (2 * rate - s)
    gain = np.real(band**order * (2 * rate) ** order / np.prod(2 * rate - s))
    upper = sorted((v for v in z if v.imag > 0), key=lambda v: abs(v))
    sections = [[1.0, 0.0, -1.0, 1.0, -2 * v.real, abs(v) ** 2] for v in upper]
    out = np.array(sections)
    out[0, :3] *= gain
    return out


#: Samples that one block of the recursion takes at once.
BLOCK = 256


def _state_space(sections: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, float]:
    """The cascade as z' = a z + b v, y = c z + d v, with two states for each section."""
    a, b, c, d = np.zeros((0, 0)), np.zeros(0), np.zeros(0), 1.0
    for b0, b1, b2, _, a1, a2 in sections:
        own_a, own_b = np.array([[-a1, 1.0], [-a2, 0.0]]), np.array([b1 - a1 * b0, b2 - a2 * b0])
        n = len(a)
        joined = np.zeros((n + 2, n + 2))
        joined[:n, :n], joined[n:, n:], joined[n:, :n] = a, own_a, np.outer(own_b, c)
        a, b = joined, np.concatenate([b, own_b * d])
        c, d = np.concatenate([b0 * c, [1.0, 0.0]]), b0 * d
    return a, b, c, d


def sections_run(sections: np.ndarray, x: np.ndarray, state: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Causal recursion of second-order sections over the last axis of x, and the state after it, which goes on as the `state` of what follows.

    Blocks of samples are answered by matrix products: each by its own samples through the impulse response and by the
    state before it. The states between blocks are a scan with powers of the block's transition, in as many steps as the
    binary logarithm of the number of blocks; so nothing steps from sample to sample.
    """
    a, b, c, d = _state_space(sections)
    rows, n, k = x.shape[:-1], x.shape[-1], len(a)
    flat = np.asarray(x, float).reshape(int(np.prod(rows)), n)
    z = np.zeros((len(flat), k)) if state is None else np.asarray(state, float).reshape(len(flat), k)
    size = min(BLOCK, n) or 1
    powers = [np.eye(k)]
    for _ in range(size):
        powers.append(a @ powers[-1])
    response = np.array([d, *[c @ p @ b for p in powers[: size - 1]]])
    lags = np.arange(size)[:, None] - np.arange(size)[None, :]
    own = np.where(lags >= 0, response[np.maximum(lags, 0)], 0.0)  # samples to samples
    shown = np.array([c @ p for p in powers[:size]])  # state before to samples
    kept = np.array([powers[size - 1 - t] @ b for t in range(size)])  # samples to state after
    whole = n // size
    v = flat[:, : whole * size].reshape(len(flat), whole, size)
    states = np.concatenate([z[:, None], v @ kept], axis=1)  # what each block adds, after the state before all
    step, m = 1, powers[size]
    while step <= whole and np.abs(m).max() > 0:
        states[:, step:] += states[:, :-step] @ m.T
        step, m = 2 * step, m @ m
    y = np.empty_like(flat)
    y[:, : whole * size] = (v @ own.T + states[:, :-1] @ shown.T).reshape(len(flat), -1)
    last, rest = states[:, -1], flat[:, whole * size :]
    r = rest.shape[1]
    if r:
        y[:, whole * size :] = rest @ own[:r, :r].T + last @ shown[:r].T
        last = last @ powers[r].T + rest @ kept[size - r :]
    return y.reshape(x.shape), last.reshape(*rows, k)


def sections_applied(sections: np.ndarray, x: np.ndarray) -> np.ndarray:
    """Causal recursion of second-order sections over the last axis of x, all rows at once."""
    return sections_run(sections, x)[0]


def transition(sections: np.ndarray, n: int) -> np.ndarray:
    """What becomes of a state in n samples of silence."""
    return np.linalg.matrix_power(_state_space(sections)[0], n)


def detrended(x: np.ndarray) -> np.ndarray:
    """x (rows of samples) less its least-squares line."""
    t = np.arange(x.shape[-1]) - (x.shape[-1] - 1) / 2
    slope = (x * t).sum(-1, keepdims=True) / max((t * t).sum(), 1e-300)
    return x - x.mean(-1, keepdims=True) - slope * t


def taper_weights(total: int, first: int, n: int, share: float = 0.01) -> np.ndarray:
    """Weights of n samples from `first` on, of a series of `total` samples with cosine slopes over that share of it at both ends."""
    m = max(1, int(total * share))
    at = np.arange(first, first + n)
    w = np.where(at < m, 0.5 * (1 - np.cos(np.pi * at / m)), 1.0)
    back = total - 1 - at
    return np.where(back < m, 0.5 * (1 - np.cos(np.pi * back / m)), w)


def tapered(x: np.ndarray, share: float = 0.01) -> np.ndarray:
    """x with cosine slopes over that share of its length at both ends."""
    return x * taper_weights(x.shape[-1], 0, x.shape[-1], share)


def parted(p: np.ndarray, low: float) -> tuple[np.ndarray, np.ndarray, bool]:
    """A piece of a series before its first and after its last sample under `low`, and whether it has one. No pick crosses such a sample, so what lies between is independent of what comes before and after the piece."""
    at = np.flatnonzero(p < low)
    return (p[: at[0]], p[at[-1] + 1 :], True) if len(at) else (p, p[:0], False)


def joined_picks(pieces: list[tuple[int, np.ndarray, np.ndarray, bool]], threshold: float, drop: float) -> list[tuple[int, int, float]]:
    """The picks that `parted` left open: in the samples between the last low one of a piece and the first one of a later piece. Pieces (size, head, tail, has a low sample) in order."""
    out: list[tuple[int, int, float]] = []
    held: list[np.ndarray] = []
    start = at = 0
    for n, head, tail, low in pieces:
        if low:
            out += [(start + i, w, q) for i, w, q in extract(np.concatenate([*held, head, [-np.inf]]), threshold, drop)]
            held, start = [tail], at + n - len(tail)
        else:
            held.append(head)
        at += n
    return out + [(start + i, w, q) for i, w, q in extract(np.concatenate([np.zeros(0), *held]), threshold, drop)]


def window_ratio(x: np.ndarray, short: int, long: int) -> np.ndarray:
    """Short over long trailing mean of squares along the last axis; NaN until the long window is full and where it is silent."""
    total = np.cumsum(np.concatenate([np.zeros((*x.shape[:-1], 1)), np.square(np.asarray(x, float))], axis=-1), axis=-1)
    out = np.full(x.shape, np.nan)
    if x.shape[-1] >= long:
        over = lambda n: (total[..., long:] - total[..., long - n : total.shape[-1] - n]) / n
        with np.errstate(invalid="ignore", divide="ignore"):
            out[..., long - 1 :] = np.where(over(long) > 0, over(short) / over(long), np.nan)
    return out


def triggers(ratio: np.ndarray, on: float, off: float) -> list[tuple[int, int]]:
    """(begin, end): from the first ratio of at least `on` to the last one before it falls under `off`."""
    high = np.concatenate([[0], (np.nan_to_num(ratio, nan=-np.inf) >= off).astype(np.int8), [0]])
    begins, ends = np.flatnonzero(np.diff(high) == 1), np.flatnonzero(np.diff(high) == -1)
    firsts = np.flatnonzero(np.nan_to_num(ratio, nan=-np.inf) >= on)
    at = np.searchsorted(firsts, begins)
    return [(int(firsts[k]), int(e) - 1) for k, e in zip(at, ends, strict=True) if k < len(firsts) and firsts[k] < e]


def drawn_partners(group: np.ndarray, magnitude: np.ndarray, md5: np.ndarray, draw: np.ndarray, asks: np.ndarray, offers: np.ndarray, low: float, high: float) -> tuple[np.ndarray, np.ndarray]:
    """Rows that ask and the rows of the partners they draw: of the same group and another event, from magnitude + low to magnitude + high.

    Rows come group by group. `md5` has the two halves of the md5 of a row's event and tells events apart. Partners stand by magnitude and md5,
    those given twice once; a draw picks a place among those of the interval that aren't of the row's own event.
    """
    n = len(group)
    by_event = np.lexsort((md5[:, 1], md5[:, 0], group))
    new = np.ones(n, bool)
    new[1:] = (np.diff(group[by_event]) != 0) | (np.diff(md5[by_event], axis=0) != 0).any(axis=1)
    event = np.empty(n, np.int64)
    event[by_event] = np.cumsum(new) - 1  # by group and md5, so the order of events is that of their md5
    at = np.flatnonzero(offers)
    at = at[np.lexsort((event[at], magnitude[at], group[at]))]
    once = np.ones(len(at), bool)
    once[1:] = (np.diff(event[at]) != 0) | (magnitude[at][1:] != magnitude[at][:-1])
    at = at[once]
    values = np.unique(magnitude[at])
    size = len(values) + 1
    place = group[at] * size + np.searchsorted(values, magnitude[at])
    row = np.flatnonzero(asks)
    first = np.searchsorted(place, group[row] * size + np.searchsorted(values, magnitude[row] + low))
    end = np.searchsorted(place, group[row] * size + np.searchsorted(values, magnitude[row] + high, "right"))
    # The own places of each event, by event and place; `free` of one is the number of other places before it.
    span = len(at) + 1
    own = np.argsort(event[at], kind="stable")
    whose = event[at][own]
    start = np.searchsorted(whose, np.arange(n + 1))
    free = own - (np.arange(len(own)) - start[whose])
    inside = np.searchsorted(whose * span + own, event[row] * span + first)
    mine = np.searchsorted(whose * span + own, event[row] * span + end) - inside
    choice = end - first - mine
    some = choice > 0
    row, first, inside, mine, choice = (v[some] for v in (row, first, inside, mine, choice))
    at_free = first + draw[row] % choice
    earlier = inside - start[event[row]]  # own places before the interval
    step = np.searchsorted(whose * span + free, event[row] * span + at_free - earlier, "right") - inside
    return row, at[at_free + np.minimum(step, mine)]
