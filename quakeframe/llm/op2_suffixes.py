"""Suffix-array deduplication of 100-byte strings by a common-prefix-aware distributed merge sort.

Removed is every byte covered by a string of SPAN bytes that also starts earlier.

The suffix array is sparse: of the SPAN-byte windows of a text, runs of neighbours share
an anchor (the smallest hashed GRAM-byte string in the window, the leftmost of equals), so
equal windows have equal anchors at the same place within. Only the suffixes at anchors
are sorted, one for about 43 bytes. A suffix is kept as far as its windows reach, and
carries what they need on its left.

1. A task cuts its texts into chunks. It sorts a chunk's suffixes; of suffixes that agree
   in everything their windows can see only the first goes on (all windows of the others
   are known to start later), so a passage in a third of all documents leaves one suffix
   for each chunk. The sorted suffixes are front-coded (common prefix, rest), cut at the
   splitters of the range partitioning, and exchanged as compressed runs.
2. A range's runs are merged by a loser tree that keeps, for every loser, its common
   prefix with the winner it met: prefixes that are known are never compared again. The
   merge yields the order and the common prefixes of neighbours.
3. Neighbours with a common prefix of SPAN - x bytes, and equal x bytes to the left of
   their anchors, hold equal windows; all but the first of these start later.
4. Byte ranges go to their documents, which are cut and digested.

Equality to the left is judged by 64-bit hashes within a group of equal right parts.

The ranges are at most MAX_RANGES, so the sample for the splitters, and what each task
carries of them, has a fixed size. Where ranges of PART_BYTES would be more, each has lanes:
suffixes take one by the hash of their first GRAM bytes (windows that are equal agree in
them), and a lane is merged by itself.

An anchor whose first GRAM bytes are in HOT_SHARE of all documents or more (by a sample; a
wrong guess costs time, not results) would bring all these documents into one task where
its surroundings differ, at the edges of a passage. Its suffixes are taken apart by LEVELS,
ranges of window places: all windows of a range have so many bytes to the left and to the
right of the anchor, and the hash of those bytes gives the lane.

Defined results: a null text is empty; a text under SPAN bytes loses nothing; rows that
repeat an id and a text are one document given more than once and get equal results; rows
that share an id but not the text are ordered by the hash of the text; rows without an id
come first; an empty table gives no rows. Other columns of the input are not read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quakeframe.llm import common
from quakeframe.llm.op3_chosenpath import _groups, _powers, mixed

SPAN, GRAM = 100, 16
WIDTH = SPAN - GRAM + 1  # GRAM-byte strings in a window
CHUNK, SEGMENT, BLOCK = 8 << 20, 4 << 20, 1 << 19
PART_BYTES, SAMPLES, MAX_RANGES = 16 << 20, 64, 4096
#: Documents of the sample for hot anchors, in expectation, and the share of them that makes one hot.
HOT_SAMPLE, HOT_SHARE = 5000, 0.02
#: Ranges of window places: they double from both ends, where windows have few bytes on one side of their anchor.
LEVELS = [(0, 0), (1, 1), (2, 3), (4, 7), (8, 15), (16, 31), (32, 52), (53, 68), (69, 76), (77, 80), (81, 82), (83, 83), (84, 84)]
#: Shuffle partitions at most; beyond them a task merges several lanes, one after the other.
MAX_TASKS = 100_000
_BASE = 0xD6E8FEB86659FD93
_UP = _powers(1 << 16, _BASE)


def _hashes(data: np.ndarray) -> np.ndarray:
    """Hash of the GRAM bytes from each place on."""
    h = np.zeros(max(0, len(data) - GRAM + 1), np.uint64)
    n = len(h)
    d = data.astype(np.uint64)
    # GRAM is a power of two: hashes of 1, 2, 4, ... bytes are put together pairwise.
    size, have = 1, d
    while size < GRAM:
        have = have[: len(have) - size] * _UP[size] + have[size:]
        size *= 2
    h[:] = have[:n]
    return mixed(h)


def _block_anchors(data: np.ndarray, segment: np.ndarray) -> tuple[np.ndarray, ...]:
    """The runs of windows of a block: segment[p] is the segment of the window that starts at p, or -1."""
    low = (_hashes(data) & np.uint64(0xFFFFFFFF00000000)) | np.arange(len(data) - GRAM + 1, dtype=np.uint64)
    size = 1
    while 2 * size <= WIDTH:
        low = np.minimum(low[: len(low) - size], low[size:])
        size *= 2
    rest = WIDTH - size
    low = np.minimum(low[: len(low) - rest], low[rest:])
    p = np.flatnonzero(segment >= 0)
    if not len(p):
        return (np.empty(0, np.int64),) * 4
    anchor = (low[p] & np.uint64(0xFFFFFFFF)).astype(np.int64)
    new = np.flatnonzero((np.diff(anchor) != 0) | (np.diff(p) != 1)) + 1
    heads, tails = np.concatenate([[0], new]), np.concatenate([new - 1, [len(p) - 1]])
    return segment[p[heads]].astype(np.int64), anchor[heads], p[heads], p[tails]


def anchors(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, ...]:
    """(segment, anchor, first window start, last window start) of the runs of windows in the segments [start, end) of `data`.

    Blocks of BLOCK window starts are taken one by one, so that 64-bit hashes exist for one block only.
    """
    segment = np.full(max(0, len(data) - SPAN + 1), -1, np.int32)
    for k, (a, b) in enumerate(zip(starts, ends, strict=True)):
        if b - a >= SPAN:
            segment[a : b - SPAN + 1] = k
    out = []
    for at in range(0, len(segment), BLOCK):
        own = segment[at : at + BLOCK]
        found = _block_anchors(data[at : at + len(own) + SPAN - 1], own)
        out.append((found[0], *[x + at for x in found[1:]]))
    return tuple(np.concatenate(x) for x in zip(*out, strict=True)) if out else (np.empty(0, np.int64),) * 4


def _pack(**arrays: np.ndarray) -> bytes:
    parts = [np.int64(len(arrays)).tobytes()]
    for name, a in arrays.items():
        raw = np.frombuffer(np.ascontiguousarray(a).tobytes(), np.uint8)
        if a.dtype.itemsize > 1:  # byte planes compress better
            raw = raw.reshape(-1, a.dtype.itemsize).T.ravel()
        parts += [np.array(f"{name}|{a.dtype.str}".encode(), "S16").tobytes(), np.int64(len(a)).tobytes(), raw.tobytes()]
    return zstandard.ZstdCompressor(level=3).compress(b"".join(parts))


def _unpack(blob: bytes) -> dict[str, np.ndarray]:
    raw = zstandard.ZstdDecompressor().decompress(blob)
    n, at, out = int(np.frombuffer(raw, np.int64, 1)[0]), 8, {}
    for _ in range(n):
        name, kind = raw[at : at + 16].rstrip(b"\0").decode().split("|", 1)
        size = int(np.frombuffer(raw, np.int64, 1, at + 16)[0])
        kind = np.dtype(kind)
        body = np.frombuffer(raw, np.uint8, size * kind.itemsize, at + 24)
        out[name] = np.frombuffer(body.reshape(kind.itemsize, -1).T.tobytes(), kind) if kind.itemsize > 1 else body.view(kind)
        at += 24 + size * kind.itemsize
    return out


def _heads(data: np.ndarray, t: np.ndarray) -> np.ndarray:
    """The first GRAM bytes (+ 1, so none is 0) of the suffixes at t."""
    return np.ascontiguousarray(np.lib.stride_tricks.sliding_window_view(data, GRAM)[t]).view(f"S{GRAM}").ravel()


def _levels(heads: np.ndarray, x0: np.ndarray, x1: np.ndarray, hot: np.ndarray) -> tuple[np.ndarray, ...]:
    """Suffixes with the hot ones once for each of LEVELS that their windows reach: their places among those given, x0, x1 and level (-1: not hot)."""
    is_hot = np.isin(heads, hot)
    rest, own = np.flatnonzero(~is_hot), np.flatnonzero(is_hot)
    out = [(rest, x0[rest], x1[rest], np.full(len(rest), -1))]
    for k, (a, b) in enumerate(LEVELS):
        low, high = np.maximum(x0[own], a), np.minimum(x1[own], b)
        some = low <= high
        out.append((own[some], low[some], high[some], np.full(int(some.sum()), k)))
    return tuple(np.concatenate(x) for x in zip(*out, strict=True))


def _lane_of(level: np.ndarray, right: np.ndarray, left: np.ndarray, parts: int) -> np.ndarray:
    """The lane of hot suffixes among all `parts`: a hash of the level and of what all its windows see."""
    out = np.zeros(len(level), np.int64)
    for k, (a, b) in enumerate(LEVELS):
        own = np.flatnonzero(level == k)
        if len(own):
            seen = np.concatenate([right[own, : SPAN - b], left[own, :a]], axis=1).astype(np.uint64)
            h = (seen * _UP[: seen.shape[1]]).sum(axis=1, dtype=np.uint64) + np.uint64(k + 1)
            out[own] = (mixed(h) % np.uint64(parts)).astype(np.int64)
    return out


def _run(texts: list[tuple[int, int, int, np.ndarray]], splitters: np.ndarray, lanes: int = 1, hot: np.ndarray = np.empty(0, f"S{GRAM}")) -> Iterator[tuple[int, bytes]]:
    """Packed runs, by range and lane (range * lanes + lane), of the suffixes of one chunk: texts (id, hash, offset, bytes + 1) in order."""
    sizes = np.array([len(t[3]) for t in texts])
    ends = np.cumsum(sizes)
    starts = ends - sizes
    data = np.concatenate([t[3] for t in texts])
    segment, t, first, last = anchors(data, starts, ends)
    n = len(t)
    if not n:
        return
    x0, x1 = t - last, t - first
    places, x0, x1, level = _levels(_heads(data, t), x0, x1, hot)
    segment, t = segment[places], t[places]
    n = len(t)
    padded = np.concatenate([np.zeros(WIDTH, np.uint8), data, np.zeros(SPAN, np.uint8)])
    right = np.lib.stride_tricks.sliding_window_view(padded, SPAN)[t + WIDTH].copy()
    left = np.lib.stride_tricks.sliding_window_view(padded, WIDTH)[t][:, ::-1].copy()  # nearest byte first
    right[np.arange(SPAN)[None, :] >= (SPAN - x0)[:, None]] = 0
    left[np.arange(WIDTH)[None, :] >= x1[:, None]] = 0
    whole = np.concatenate([right, left, (x0 + 1).astype(np.uint8)[:, None], (x1 + 1).astype(np.uint8)[:, None]], axis=1)
    del right, left, padded
    order = np.argsort(whole.view(f"S{whole.shape[1]}").ravel(), kind="stable")
    whole = whole[order]
    same = np.concatenate([[False], (whole[1:] == whole[:-1]).all(1)])
    ids, hashes, offsets = (np.array([x[k] for x in texts], np.int64) for k in range(3))
    at = offsets[segment] + t - starts[segment]
    again = order[same]
    if len(again):  # all windows of these start later than those of the suffix before them, unless rows repeat an id and a text
        head = order[np.maximum.accumulate(np.where(same, 0, np.arange(n)))][same]
        own = (ids[segment[again]] != ids[segment[head]]) | (hashes[segment[again]] != hashes[segment[head]]) | (at[again] != at[head])
        again = again[own]
    if len(again):
        yield int(again[0]) % ((len(splitters) + 1) * lanes), _pack(id=ids[segment[again]], hash=hashes[segment[again]], a=at[again] - x1[again], b=at[again] - x0[again] + SPAN)
    order, whole = order[~same], whole[~same]
    right, left = whole[:, :SPAN], whole[:, SPAN : SPAN + WIDTH]
    differs = right[1:] != right[:-1]
    lcp = np.concatenate([[0], np.where(differs.any(1), differs.argmax(1), SPAN)])
    length = SPAN - x0[order]
    lcp = np.minimum(lcp, length)
    lcp[1:] = np.minimum(lcp[1:], length[:-1])
    head = np.ascontiguousarray(right[:, :GRAM])
    part = np.searchsorted(splitters, head.view(f"S{GRAM}").ravel(), side="right") * lanes
    if lanes > 1:
        words = head.view(np.uint64)
        part = part + (mixed(words[:, 0] * np.uint64(_BASE) + mixed(words[:, 1])) % np.uint64(lanes)).astype(np.int64)
    level = level[order]
    if (level >= 0).any():
        part = np.where(level < 0, part, _lane_of(level, right, left, (len(splitters) + 1) * lanes))
    for number, own_rows, shared in _lanes(part, lcp):
        own, size = order[own_rows], length[own_rows]
        columns = np.arange(SPAN)[None, :]
        rest = right[own_rows][(columns >= shared[:, None]) & (columns < size[:, None])]
        lefts = left[own_rows][np.arange(WIDTH)[None, :] < x1[own][:, None]]
        docs, place_of = np.unique(segment[own], return_inverse=True)
        u1 = lambda x: x.astype(np.uint8)
        place = (at[own]).astype(np.uint32 if at[own].max() < 1 << 32 else np.int64)
        yield number, _pack(lcp=u1(shared), size=u1(size), x0=u1(x0[own]), x1=u1(x1[own]), doc=place_of.astype(np.uint32), at=place, rest=rest, left=lefts, ids=ids[docs], hashes=hashes[docs])


def _lanes(part: np.ndarray, lcp: np.ndarray) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """Of sorted rows with the number of their lane and the common prefix with the row before: each lane's rows in order, and the
    common prefix of each with the one before in its lane (the least of those in between)."""
    by = np.argsort(part, kind="stable")
    cuts = np.flatnonzero(np.diff(part[by])) + 1
    for rows in np.split(by, cuts):
        if len(rows):
            starts = np.concatenate([rows[:1], rows[:-1] + 1])
            shared = np.minimum.reduceat(lcp[: rows[-1] + 1], starts)
            shared[0] = 0
            yield int(part[rows[0]]), rows, shared


def even_keys(spark: SparkSession, parts: int) -> list[int]:
    """For each partition number a key that repartition(parts, key) puts there, so that each range gets a task of its own. `parts` numbers, MAX_RANGES at most."""
    key = F.col("id")
    found = spark.range(32 * parts).groupBy(F.pmod(F.hash(key), F.lit(parts)).alias("p")).agg(F.min(key).alias("k")).collect()
    at = {r["p"]: r["k"] for r in found}
    return [at.get(p, p) for p in range(parts)]


def _runs(splitters: np.ndarray, lanes: int, hot: np.ndarray, keys: list[int] | None, schema: pa.Schema):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = [], 0

        def flush(held: list) -> Iterator[pa.RecordBatch]:
            held.sort(key=lambda x: x[:3])
            made = list(_run(held, splitters, lanes, hot))
            if made:
                yield pa.RecordBatch.from_arrays([pa.array([keys[m[0]] if keys else m[0] for m in made], pa.int64()), pa.array([m[1] for m in made], pa.binary())], schema=schema)

        for b in batches:
            ids, hashes = b.column(0).to_numpy(), b.column(1).to_numpy()
            for k in range(b.num_rows):
                text = b.column(2)[k].as_buffer()
                if text is None or text.size < SPAN:
                    continue
                data = np.frombuffer(text, np.uint8) + np.uint8(1)  # UTF-8 has no byte 255, and so 0 is free
                for at in range(0, len(data) - SPAN + 1, SEGMENT):
                    part = data[at : at + SEGMENT + SPAN - 1]
                    held.append((int(ids[k]), int(hashes[k]), at, part))
                    size += len(part)
                    if size >= CHUNK:
                        yield from flush(held)
                        held, size = [], 0
        if held:
            yield from flush(held)

    return run


class LoserTree:
    """Merges sorted runs of (keys, common prefix with the key before) without comparing known prefixes."""

    def __init__(self, runs: list[tuple[list[bytes], list[int]]]):
        self.runs = runs

    def merged(self) -> tuple[list[int], list[int], list[int]]:
        """Run and place of each key in order, and its common prefix with the one before."""
        runs = self.runs
        k = 1
        while k < len(runs):
            k *= 2
        keys: list[bytes | None] = [r[0][0] if r[0] else None for r in runs] + [None] * (k - len(runs))
        known, place = [0] * k, [0] * k

        def wins(a: int, b: int) -> int:
            """The winner of a and b; the loser keeps its common prefix with it."""
            x, y = keys[a], keys[b]
            if y is None:
                return a
            if x is None:
                return b
            if known[a] != known[b]:
                return a if known[a] > known[b] else b
            h, n = known[a], min(len(x), len(y))
            while h < n and x[h] == y[h]:
                h += 1
            if h == n:
                first = len(x) < len(y) or (len(x) == len(y) and a < b)
            else:
                first = x[h] < y[h]
            if first:
                known[b] = h
                return a
            known[a] = h
            return b

        tree = [0] * k
        level = list(range(k))
        base = k
        while base > 1:
            half = base // 2
            up = []
            for i in range(half):
                a, b = level[2 * i], level[2 * i + 1]
                w = wins(a, b)
                tree[half + i] = b if w == a else a
                up.append(w)
            level, base = up, half
        w = level[0]
        out_run, out_place, out_known = [], [], []
        while keys[w] is not None:
            out_run.append(w)
            out_place.append(place[w])
            out_known.append(known[w])
            own, shared = runs[w]
            place[w] += 1
            if place[w] < len(own):
                keys[w], known[w] = own[place[w]], shared[place[w]]
            else:
                keys[w] = None
            node = (w + k) >> 1
            while node:
                o = tree[node]
                x, y = keys[w], keys[o]
                if y is not None:
                    if x is None:
                        tree[node], w = w, o
                    else:
                        a, b = known[w], known[o]
                        if a < b or (a == b and wins(w, o) == o):
                            tree[node], w = w, o
                node >>= 1
        return out_run, out_place, out_known


def _decoded(run: dict[str, np.ndarray]) -> list[bytes]:
    """The keys of a front-coded run."""
    shared, size, rest = run["lcp"].tolist(), run["size"].tolist(), run["rest"].tobytes()
    keys, at, last = [], 0, b""
    for s, n in zip(shared, size, strict=True):
        last = last[:s] + rest[at : at + n - s]
        at += n - s
        keys.append(last)
    return keys


def later_windows(order: dict[str, np.ndarray], known: np.ndarray) -> np.ndarray:
    """For each merged suffix and each x, whether the window x bytes before its anchor starts later than an equal one."""
    n = len(known)
    x0, x1 = order["x0"].astype(np.int64), order["x1"].astype(np.int64)
    out = np.zeros((n, WIDTH), bool)
    h, power = np.zeros(n, np.uint64), 1
    rank = order["rank"]
    for x in range(WIDTH):
        if x:
            h = h + order["left"][:, x - 1].astype(np.uint64) * np.uint64(power)
            power = power * _BASE % (1 << 64)
        group = np.cumsum(known < SPAN - x)
        own = np.flatnonzero((x0 <= x) & (x <= x1))
        own = own[np.bincount(group[own], minlength=n + 1)[group[own]] > 1]
        if len(own):
            code = mixed(h[own] + mixed(group[own].astype(np.uint64)))
            by = np.argsort(code, kind="stable")
            own, code = own[by], code[by]
            first = np.concatenate([[True], code[1:] != code[:-1]])
            starts = np.flatnonzero(first)
            least = np.minimum.reduceat(rank[own], starts)[np.cumsum(first) - 1]
            out[own, x] = rank[own] > least
    return out


_RANGES = pa.schema([("id", pa.int64()), ("hash", pa.int64()), ("a", pa.int64()), ("b", pa.int64())])


def _resolved(runs: list[dict[str, np.ndarray]]) -> tuple[np.ndarray, ...] | None:
    """Byte ranges (id, hash, a, b) of the later windows of a range's runs."""
    keys = [(_decoded(r), r["lcp"].tolist()) for r in runs]
    run, place, known = LoserTree(keys).merged()
    del keys
    base = np.cumsum([0] + [len(r["lcp"]) for r in runs])
    take = base[np.array(run, np.int64)] + np.array(place, np.int64)
    known = np.array(known, np.int64)
    known[:1] = 0
    # Only suffixes that share their anchor's bytes with a neighbour can hold equal windows.
    near = known >= GRAM
    keep = near | np.concatenate([near[1:], [False]])
    if not keep.any():
        return None
    # A dropped suffix has a prefix under GRAM with both neighbours, and so has what follows it.
    take, known = take[keep], known[keep]
    join = lambda name, kind=None: np.concatenate([r[name] if kind is None else r[name].astype(kind) for r in runs])
    x0, x1, at = join("x0"), join("x1"), join("at", np.int64)
    ids, hashes = (np.concatenate([r[name][r["doc"]] for r in runs]) for name in ("ids", "hashes"))
    sizes = x1.astype(np.int64)
    flat, starts = join("left"), np.cumsum(sizes) - sizes
    left = np.zeros((len(take), WIDTH), np.uint8)
    for k in range(WIDTH):
        own = np.flatnonzero(sizes[take] > k)
        left[own, k] = flat[starts[take[own]] + k]
    x0, x1, at, ids, hashes = (v[take] for v in (x0, x1, at, ids, hashes))
    by = np.lexsort((at, hashes, ids))
    new = np.concatenate([[0], ((np.diff(ids[by]) != 0) | (np.diff(hashes[by]) != 0) | (np.diff(at[by]) != 0)).astype(np.int64)])
    rank = np.empty(len(by), np.int64)
    rank[by] = np.cumsum(new)
    late = later_windows({"x0": x0, "x1": x1, "left": left, "rank": rank}, known)
    edge = np.diff(np.pad(late, ((0, 0), (1, 1))).astype(np.int8), axis=1)
    rows, begin = np.nonzero(edge == 1)
    _, end = np.nonzero(edge == -1)
    return ids[rows], hashes[rows], at[rows] - (end - 1), at[rows] - begin + SPAN


def _merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for g in _groups(batches, 1):
        runs = []
        for blob in g.column("blob"):
            r = _unpack(blob.as_py())
            if "rest" in r:
                runs.append(r)
            else:
                yield pa.RecordBatch.from_arrays([pa.array(r[c]) for c in ("id", "hash", "a", "b")], schema=_RANGES)
        found = _resolved(runs) if runs else None
        if found is not None:
            yield pa.RecordBatch.from_arrays([pa.array(np.ascontiguousarray(c)) for c in found], schema=_RANGES)


def spans(ranges: list[tuple[int, int]] | np.ndarray) -> np.ndarray:
    """Maximal runs of a union of byte ranges."""
    r = np.asarray(ranges, np.int64).reshape(-1, 2)
    if not len(r):
        return r
    r = r[np.argsort(r[:, 0], kind="stable")]
    ends = np.maximum.accumulate(r[:, 1])
    first = np.concatenate([[True], r[1:, 0] > ends[:-1]])
    last = np.concatenate([np.flatnonzero(first)[1:] - 1, [len(r) - 1]])
    return np.stack([r[first, 0], ends[last]], axis=1)


def _cut(columns: tuple[str, ...], schema: pa.Schema):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out: list[list] = [[] for _ in columns]
            for k in range(b.num_rows):
                data = b.column("_bytes")[k].as_py() or b""
                got = b.column("_ranges")[k].values
                gone = spans(np.stack([got.field("a").to_numpy(), got.field("b").to_numpy()], axis=1)) if got is not None and len(got) else np.empty((0, 2), np.int64)
                kept, at = [], 0
                for x, y in gone.tolist():
                    kept.append(data[at:x])
                    at = y
                kept = b"".join([*kept, data[at:]])
                values = {"n_bytes": len(data), "n_removed": len(data) - len(kept), "n_spans": len(gone), "kept_sha256": hashlib.sha256(kept).hexdigest(), "kept": kept}
                for c, name in zip(out, columns, strict=True):
                    c.append(values[name])
            yield pa.RecordBatch.from_arrays([b.column(0), *[pa.array(c, schema.field(name).type) for c, name in zip(out, columns, strict=True)]], schema=schema)

    return run


def splitters(docs: DataFrame, n: int, parts: int) -> list[bytes]:
    """parts - 1 quantiles of GRAM-byte strings at one hashed place in each of a sample of about SAMPLES * parts texts."""
    rate = min(1.0, SAMPLES * parts / max(1, n))
    draw = F.pmod(F.xxhash64(F.lit("splitters"), "_id", "_hash"), F.lit(1 << 30)) < F.lit(int(rate * (1 << 30)))
    place = (F.pmod(F.xxhash64("_hash"), F.greatest(F.octet_length("_bytes") - SPAN, F.lit(1))) + 1).cast("int")
    some = docs.filter(draw & (F.octet_length("_bytes") >= SPAN)).select(F.substring("_bytes", place, F.lit(GRAM)).alias("s"))
    got = sorted(bytes(c + 1 for c in r["s"]) for r in some.collect())
    return sorted({got[len(got) * k // parts] for k in range(1, parts)}) if got else []


def _sample_heads(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The different first bytes of each text's anchors."""
    for b in batches:
        out: list[bytes] = []
        for text in b.column(0):
            body = text.as_buffer()
            if body is None or body.size < SPAN:
                continue
            data, own = np.frombuffer(body, np.uint8) + np.uint8(1), set()
            for at in range(0, len(data) - SPAN + 1, SEGMENT):
                part = data[at : at + SEGMENT + SPAN - 1]
                own.update(_heads(part, anchors(part, np.array([0]), np.array([len(part)]))[1]).tolist())
            out += own
        yield pa.RecordBatch.from_arrays([pa.array(out, pa.binary())], ["head"])


def hot_heads(docs: DataFrame, n: int) -> np.ndarray:
    """The first bytes (+ 1) of hot anchors; a text has one for some 43 bytes, so they are (bytes of a text / 43 / HOT_SHARE) at most."""
    rate = min(1.0, HOT_SAMPLE / max(1, n))
    draw = F.pmod(F.xxhash64(F.lit("hot"), "_id", "_hash"), F.lit(1 << 30)) < F.lit(int(rate * (1 << 30)))
    heads = docs.filter(draw).select("_bytes").mapInArrow(_sample_heads, "head binary")
    often = heads.groupBy("head").agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") >= max(2.0, HOT_SHARE * rate * n))
    return np.array(sorted(bytes(r["head"]) for r in often.select("head").collect()), f"S{GRAM}")


def remove_repeats(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", columns: tuple[str, ...] = ("n_bytes", "n_removed", "n_spans", "kept_sha256", "kept")) -> DataFrame:
    """The id of every document with the chosen ones of n_bytes, n_removed, n_spans, kept_sha256 and kept (the bytes that are left)."""
    from pyspark.sql.pandas.types import to_arrow_type

    spark = docs.sparkSession
    common.ship(spark)
    body = common.text_of(docs, text)
    base = docs.select(docs[doc_id].alias("_own"), F.coalesce(docs[doc_id].cast("long"), F.lit(-(1 << 63))).alias("_id"), F.xxhash64(body).alias("_hash"), body.cast("binary").alias("_bytes"))
    total, n = base.agg(F.coalesce(F.sum(F.octet_length("_bytes")), F.lit(0)), F.count(F.lit(1))).first()
    wanted = max(1, int(spark.conf.get("spark.sql.shuffle.partitions")), -(-total // PART_BYTES))
    ranges = min(wanted, MAX_RANGES)
    lanes = -(-wanted // ranges)
    cuts, hot = splitters(base, n, ranges), hot_heads(base, n)
    schema = pa.schema([("part", pa.int64()), ("blob", pa.binary())])
    keys = even_keys(spark, ranges) if lanes == 1 else None
    runs = base.select("_id", "_hash", "_bytes").mapInArrow(_runs(np.array(cuts, f"S{GRAM}"), lanes, hot, keys, schema), "part long, blob binary")
    merged = runs.repartition(min(ranges * lanes, MAX_TASKS), "part").sortWithinPartitions("part").mapInArrow(_merge, "id long, hash long, a long, b long")
    of = merged.groupBy(F.col("id").alias("_i"), F.col("hash").alias("_h")).agg(F.collect_list(F.struct("a", "b")).alias("_ranges"))
    df = base.join(of, (base["_id"] == of["_i"]) & (base["_hash"] == of["_h"]), "left").select("_own", "_bytes", "_ranges")
    kinds = {"n_bytes": pa.int64(), "n_removed": pa.int64(), "n_spans": pa.int64(), "kept_sha256": pa.string(), "kept": pa.binary()}
    ddl = {pa.int64(): "long", pa.string(): "string", pa.binary(): "binary"}
    kind = df.schema[0].dataType
    out = pa.schema([("_own", to_arrow_type(kind)), *[(c, kinds[c]) for c in columns]])
    return df.mapInArrow(_cut(columns, out), f"_own {kind.simpleString()}, " + ", ".join(f"{c} {ddl[kinds[c]]}" for c in columns)).withColumnRenamed("_own", doc_id)


def op2_suffixes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What each of all documents loses to strings of 100 bytes that start earlier."""
    return remove_repeats(common.table(spark, sf_dir, "documents"), columns=("n_bytes", "n_removed", "n_spans", "kept_sha256"))


SQL = None
