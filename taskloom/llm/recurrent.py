"""A bidirectional gated recurrent network with attention pooling over windows of words, in numpy.

A word's input is the vector of the word itself plus the mean of the vectors of its character n-grams plus the mean of
those of its beginnings, all from hashed tables. Everything a task needs is a dictionary of arrays.
"""

from __future__ import annotations

import unicodedata
from functools import cache

import numpy as np

from .words import hash_spans, mix, ragged, runs

#: Words of a window, and words from one window to the next.
WINDOW, STRIDE = 32, 16
#: Rows of the hashed tables; sizes of inputs, of each direction's state and of the attention.
TABLE, INPUT, STATE, LOOK = 1 << 16, 16, 8, 8
#: Spread of untrained n-gram vectors: small, as n-grams that training never saw add up to noise in rare words.
SPREAD = 0.01
#: Sizes in bytes of the n-grams anywhere in a word, and of those with which it begins.
GRAMS, BEGINNINGS = (3, 4, 5), (4, 5, 6, 7, 8, 10)
#: Bytes that are in no word: ASCII but letters and digits; characters beyond it are told by _wide_gaps().
GAP = np.array([i < 128 and not chr(i).isalnum() for i in range(256)])
#: Runs of more than LONG bytes are cut into pieces of REACH bytes from each STEP bytes on (up to three bytes more or
#: less, so that no character is cut): they overlap, so every n-gram of GRAMS is in a piece.
LONG, STEP, REACH = 24, 8, 16


@cache
def _wide_gaps() -> np.ndarray:
    """Which characters beyond ASCII are in no word: white space, punctuation, symbols and controls. Soft hyphens,
    joiners and the like are inside words."""
    out = np.zeros(0x110000, bool)
    out[128:] = [(k := unicodedata.category(chr(i)))[0] in "ZPS" or k == "Cc" or i == 0x200B for i in range(128, 0x110000)]
    return out


def _inside(data: np.ndarray) -> np.ndarray:
    """Which bytes of UTF-8 text are in a word."""
    inside = ~GAP[data]
    block = 1 << 20
    for i in range(0, len(data), block):
        at = i + np.flatnonzero(data[i : i + block] >= 0xC2)
        if not len(at):
            continue
        lead = data[at]
        more = 1 + (lead >= 0xE0) + (lead >= 0xF0)
        code = lead.astype(np.int64) & (0x3F >> more)
        for k in (1, 2, 3):
            tail = data[np.minimum(at + k, len(data) - 1)] & 0x3F
            code = np.where(more >= k, code << 6 | tail, code)
        apart = _wide_gaps()[np.minimum(code, 0x10FFFF)]
        at, more = at[apart], more[apart]
        for k in range(4):
            inside[np.minimum(at + k, len(data) - 1)[more >= k]] = False
    return inside


def _positions(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(first byte, bytes, offsets of the texts among them) of what takes a place in a window: words, and the pieces of
    longer runs."""
    starts, size, rows = runs(_inside(data), offsets)
    count = np.where(size > LONG, -(-(size - REACH) // STEP) + 1, 1)
    if (count == 1).all():
        return starts, size, rows
    whole = np.repeat(starts, count)
    end = whole + np.repeat(size, count)
    begin = whole + STEP * ragged(count)
    until = np.where(np.repeat(count, count) > 1, np.minimum(begin + REACH, end), end)
    for cut in (begin, until):
        for _ in range(3):
            inner = (cut > whole) & (cut < end)
            cut -= inner & ((data[np.minimum(cut, len(data) - 1)] & 0xC0) == 0x80)
    return begin, until - begin, np.append(0, np.cumsum(count))[rows]


def vocabulary(data: np.ndarray, offsets: np.ndarray) -> dict[str, np.ndarray]:
    """The words of texts: `at` (each word's number among the distinct), `rows` (offsets of the texts), and of the
    distinct words the table row of the word, and the table rows of its n-grams with their counts."""
    starts, size, rows = _positions(data, offsets)
    h = hash_spans(data, starts, size, lower=True)
    names, first, at = np.unique(h, return_index=True, return_inverse=True)
    s, n = starts[first], size[first]
    low = data.copy()
    big = (low >= 65) & (low <= 90)
    low[big] += 32
    inner, heads = _grams(low, s, n, GRAMS, False), _grams(low, s, n, BEGINNINGS, True)
    return {"at": at, "rows": rows, "word": (names % np.uint64(TABLE)).astype(np.int64), "grams": inner[0], "n": inner[1], "heads": heads[0], "n_heads": heads[1]}


def _grams(low: np.ndarray, s: np.ndarray, n: np.ndarray, sizes: tuple[int, ...], head: bool) -> tuple[np.ndarray, np.ndarray]:
    """Table rows of the n-grams of words (first byte s, n bytes), word by word, and their counts; head: only those
    with which a word begins."""
    rows, owner = [], []
    for k in sizes:
        count = (n >= k).astype(np.int64) if head else np.maximum(n - k + 1, 0)
        spot = np.repeat(s, count) + (0 if head else ragged(count))
        g = np.full(len(spot), 2 * k + head, np.uint64)
        for j in range(k):
            g = g * np.uint64(0x100000001B3) + low[spot + j]
        rows.append((mix(g) % np.uint64(TABLE)).astype(np.int32))
        owner.append(np.repeat(np.arange(len(s), dtype=np.int32), count))
    rows, owner = np.concatenate(rows), np.concatenate(owner)
    return rows[np.argsort(owner, kind="stable")], np.bincount(owner, minlength=len(s))


def windows(rows: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(first word, words, text) of every window: at each STRIDE words until the text's end is covered."""
    n = np.diff(rows)
    count = np.where(n > 0, 1 + np.maximum(0, -(-(n - WINDOW) // STRIDE)), 0)
    text = np.repeat(np.arange(len(n)), count)
    begin = ragged(count) * STRIDE
    return rows[text] + begin, np.minimum(n[text] - begin, WINDOW), text


def fresh(seed: int) -> dict[str, np.ndarray]:
    r = np.random.default_rng(seed)
    normal = lambda *shape, by=1.0: (r.normal(size=shape) * by).astype(np.float32)
    p = {"words": normal(TABLE, INPUT, by=0.05), "grams": normal(TABLE, INPUT, by=SPREAD), "heads": normal(TABLE, INPUT, by=SPREAD)}
    for d in "fb":
        p |= {f"wx{d}": normal(INPUT, 3 * STATE, by=INPUT**-0.5), f"wh{d}": normal(STATE, 3 * STATE, by=STATE**-0.5), f"b{d}": np.zeros(3 * STATE, np.float32)}
    return p | {"wa": normal(2 * STATE, LOOK, by=0.35), "ba": np.zeros(LOOK, np.float32), "va": normal(LOOK, by=0.35), "wo": normal(2 * STATE, by=0.35), "bo": np.zeros(1, np.float32)}


def word_inputs(p: dict, v: dict) -> np.ndarray:
    """Inputs of the distinct words, and a last row of zeros that stands after a window's end."""
    x = np.zeros((len(v["word"]) + 1, INPUT), np.float32)
    x[:-1] = p["words"][v["word"]]
    for rows, count in (("grams", "n"), ("heads", "n_heads")):
        full = np.flatnonzero(v[count])
        if len(full):
            ends = np.cumsum(v[count])
            x[full] += np.add.reduceat(p[rows][v[rows]], (ends - v[count])[full]) / v[count][full, None]
    return x


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-x))


def _run(px: np.ndarray, wh: np.ndarray, idx: np.ndarray, mask: np.ndarray, keep: list | None) -> np.ndarray:
    """States [time, window, STATE] of one direction; px: the input parts of the gates of each distinct word."""
    h, k, out = np.zeros((idx.shape[1], STATE), np.float32), STATE, np.empty((*idx.shape, STATE), np.float32)
    for t in range(len(idx)):
        g, u = px[idx[t]], h @ wh
        rz = _sigmoid(g[:, : 2 * k] + u[:, : 2 * k])
        n = np.tanh(g[:, 2 * k :] + rz[:, :k] * u[:, 2 * k :])
        new = n + rz[:, k:] * (h - n)
        if keep is not None:
            keep.append((h, rz, n, u[:, 2 * k :]))
        h = np.where(mask[t][:, None], new, h)
        out[t] = h
    return out


def forward(p: dict, x: np.ndarray, idx: np.ndarray, mask: np.ndarray, keep: dict | None = None) -> np.ndarray:
    """Logits of windows: idx and mask are [time, window]."""
    sides = []
    for d, step in (("f", 1), ("b", -1)):
        steps: list | None = None if keep is None else []
        sides.append(_run(x @ p[f"wx{d}"] + p[f"b{d}"], p[f"wh{d}"], idx[::step], mask[::step], steps)[::step])
        if keep is not None:
            keep[d] = steps
    s = np.concatenate(sides, 2)
    look = np.tanh(s @ p["wa"] + p["ba"])
    score = np.where(mask, look @ p["va"], np.float32(-1e9))
    e = np.exp(score - score.max(0))
    a = e / e.sum(0)
    c = (a[:, :, None] * s).sum(0)
    if keep is not None:
        keep |= {"s": s, "look": look, "a": a, "c": c}
    return c @ p["wo"] + p["bo"]


def _back(p: dict, x: np.ndarray, idx: np.ndarray, mask: np.ndarray, keep: dict, dlogit: np.ndarray) -> tuple[dict, np.ndarray]:
    """Gradients of the dense weights, and of x."""
    g = {"wo": keep["c"].T @ dlogit, "bo": dlogit.sum(keepdims=True)}
    dc = dlogit[:, None] * p["wo"]
    s, a, look = keep["s"], keep["a"], keep["look"]
    ds = a[:, :, None] * dc
    da = (s * dc).sum(2)
    dscore = a * (da - (a * da).sum(0))
    g["va"] = np.einsum("tn,tnk->k", dscore, look)
    dl = dscore[:, :, None] * p["va"] * (1 - look**2)
    g["wa"], g["ba"] = np.einsum("tnk,tnl->kl", s, dl), dl.sum((0, 1))
    ds = ds + dl @ p["wa"].T
    dx, k = np.zeros_like(x), STATE
    for q, (d, step) in enumerate((("f", 1), ("b", -1))):
        part, ids, on = ds[::step, :, q * k : (q + 1) * k], idx[::step], mask[::step]
        dh, dwh = np.zeros(part.shape[1:], np.float32), np.zeros_like(p[f"wh{d}"])
        dpx = np.empty((*idx.shape, 3 * k), np.float32)
        for t in range(len(ids) - 1, -1, -1):
            h, rz, n, u = keep[d][t]
            r, z = rz[:, :k], rz[:, k:]
            dh = dh + part[t]
            m = on[t][:, None]
            dn_ = np.where(m, dh, 0)
            dn = dn_ * (1 - z) * (1 - n * n)
            dz = dn_ * (h - n) * z * (1 - z)
            dr = dn * u * r * (1 - r)
            dpx[t] = np.concatenate([dr, dz, dn], 1)
            du = np.concatenate([dr, dz, dn * r], 1)
            dwh += h.T @ du
            dh = np.where(m, dn_ * z, dh) + du @ p[f"wh{d}"].T
        g[f"wh{d}"] = dwh
        flat, where = dpx.reshape(-1, 3 * k), ids.reshape(-1)
        order = np.argsort(where, kind="stable")
        firsts = np.flatnonzero(np.append(True, where[order][1:] != where[order][:-1]))
        sums = np.zeros((len(x), 3 * k), np.float32)
        sums[where[order][firsts]] = np.add.reduceat(flat[order], firsts)
        sums[-1] = 0
        g[f"wx{d}"], g[f"b{d}"] = x.T @ sums, sums.sum(0)
        dx += sums @ p[f"wx{d}"].T
    return g, dx


def _rows_summed(index: np.ndarray, values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    order = np.argsort(index, kind="stable")
    first = np.flatnonzero(np.append(True, index[order][1:] != index[order][:-1]))
    return index[order][first], np.add.reduceat(values[order], first)


def gather(v: dict, first: np.ndarray, size: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """idx and mask, [time, window], of windows of the words v["at"]."""
    t = np.arange(WINDOW)[:, None]
    mask = t < size
    return np.where(mask, v["at"][np.minimum(first + t, len(v["at"]) - 1)], len(v["word"])), mask


def logits(p: dict, v: dict, first: np.ndarray, size: np.ndarray, block: int = 4096) -> np.ndarray:
    x = word_inputs(p, v)
    out = [forward(p, x, *gather(v, first[i : i + block], size[i : i + block])) for i in range(0, len(first), block)]
    return np.concatenate(out) if out else np.zeros(0, np.float32)


def fit(p: dict, v: dict, first: np.ndarray, size: np.ndarray, y: np.ndarray, hard: np.ndarray, steps: int, seed: int, batch: int = 192, rate: float = 0.01) -> None:
    """Adam on windows, as many of either class in a batch and an eighth of those of class 0 among the hard ones (where
    there are any); changes p. Table rows move only when a batch has them."""
    rng = np.random.default_rng(seed)
    mean, var = ({k: np.zeros_like(a) for k, a in p.items()} for _ in range(2))
    sides = [np.flatnonzero(y == c) for c in (0, 1)]
    hard = np.flatnonzero(hard & (y == 0)) if (hard & (y == 0)).any() else sides[0]
    calm = np.zeros(len(v["word"]) + 1, bool)
    for i in range(0, len(sides[0]), 8192):
        some = sides[0][i : i + 8192]
        calm[gather(v, first[some], size[some])[0]] = True
    calm = np.flatnonzero(calm[:-1])
    parts = [(sides[0], batch // 2 - batch // 16), (hard, batch // 16), (sides[1], batch // 2)]
    ends = {c: np.cumsum(v[c]) for c in ("n", "n_heads")}
    for step in range(1, steps + 1):
        pick = np.concatenate([rng.choice(side, n) for side, n in parts])
        idx, mask = gather(v, first[pick], size[pick])
        # Some of class 0 are shown as one to three words said over and over, or as its words drawn alike, rare or not;
        # both stay class 0.
        for k in range(1, 4):
            some = slice((k - 1) * batch // 48, k * batch // 48)
            idx[:, some] = np.where(mask[:, some], idx[np.arange(WINDOW) % k, some], idx[:, some])
        some = slice(batch // 16, batch // 10)
        idx[:, some] = np.where(mask[:, some], rng.choice(calm, idx[:, some].shape), idx[:, some])
        used, at = np.unique(idx, return_inverse=True)
        idx = at.reshape(idx.shape)
        has_pad = used[-1] == len(v["word"])
        used = used[:-1] if has_pad else used
        part = {"word": v["word"][used]}
        for rows, count in (("grams", "n"), ("heads", "n_heads")):
            n = part[count] = v[count][used]
            part[rows] = v[rows][np.repeat(ends[count][used] - n, n) + ragged(n)]
        x, keep = word_inputs(p, part), {}
        out = forward(p, x, idx, mask, keep)
        dlogit = ((_sigmoid(out) - y[pick]) / batch).astype(np.float32)
        g, dx = _back(p, x, idx, mask, keep, dlogit)
        dx = dx[:-1]
        lr = rate * min(1, step / 20) * (1 - 0.7 * step / steps)
        moved = {"words": (part["word"], dx)}
        for rows, count in (("grams", "n"), ("heads", "n_heads")):
            moved[rows] = part[rows], np.repeat(dx / np.maximum(part[count], 1)[:, None], part[count], 0)
        for name, (rows, grad) in moved.items():
            if not len(rows):
                continue
            rows, grad = _rows_summed(rows, grad)
            m, s = mean[name], var[name]
            m[rows] = 0.9 * m[rows] + 0.1 * grad
            s[rows] = 0.99 * s[rows] + 0.01 * grad**2
            p[name][rows] -= lr * m[rows] / (np.sqrt(s[rows]) + 1e-6)
        for name, grad in g.items():
            grad = grad.reshape(p[name].shape)
            mean[name] = 0.9 * mean[name] + 0.1 * grad
            var[name] = 0.99 * var[name] + 0.01 * grad**2
            p[name] -= lr * mean[name] / (1 - 0.9**step) / (np.sqrt(var[name] / (1 - 0.99**step)) + 1e-6)
