"""A gated recurrent network with a class-factored softmax over symbols, in numpy.

Symbols are the ``HEAD`` most frequent words, ``TAILS`` classes of other words
and the end of a text. The softmax first chooses a class (a group of ``GROUP``
head words, a tail class or the end) and, in a group, a word. Weights are
fitted by truncated backpropagation through time: gradients stop at the edges
of a window, the state goes on to the end of the text and starts anew behind it.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np

HEAD, GROUP, HIDDEN, SHAPES, BANDS = 1024, 32, 16, 16, 2
GROUPS, TAILS = HEAD // GROUP, SHAPES * BANDS
END = HEAD + TAILS
CLASSES, SYMBOLS = GROUPS + TAILS + 1, END + 1
#: Steps of a window when scoring and when training; texts side by side; tokens read before they are laid side by side.
WINDOW, STEPS, ROWS, READ = 64, 16, 128, 1 << 20
Model = dict[str, np.ndarray]
SHAPE = {"x": (SYMBOLS, 3 * HIDDEN), "u": (HIDDEN, 3 * HIDDEN), "wc": (HIDDEN, CLASSES), "bc": (CLASSES,), "ww": (GROUPS, HIDDEN, GROUP), "bw": (GROUPS, GROUP)}


def start(head_counts: np.ndarray, tail_counts: np.ndarray, end_count: int, seed: int = 3) -> Model:
    """A network that says what the counts say; classes and words that cannot occur have no mass."""
    rng = np.random.default_rng(seed)
    hc = np.zeros(HEAD)
    hc[: len(head_counts)] = head_counts
    mass = np.concatenate([hc.reshape(GROUPS, GROUP).sum(axis=1), tail_counts, [end_count]])
    empty = np.zeros(CLASSES)
    empty[:GROUPS] = np.where(np.arange(GROUPS) * GROUP < len(head_counts), 0.0, -60.0)
    empty[GROUPS : GROUPS + TAILS] = np.where((tail_counts > 0) | (np.arange(TAILS) >= TAILS - SHAPES), 0.0, -60.0)  # unknown words are in the last band
    dead = np.where(np.arange(HEAD) < max(1, len(head_counts)), 0.0, -60.0)
    m = {
        "x": rng.normal(0, 0.1, SHAPE["x"]), "u": rng.normal(0, 0.2, SHAPE["u"]), "wc": rng.normal(0, 0.05, SHAPE["wc"]), "bc": np.log((mass + 0.5) / (mass + 0.5).sum()) + empty,
        "ww": rng.normal(0, 0.05, SHAPE["ww"]), "bw": (np.log(hc + 0.5) + dead).reshape(GROUPS, GROUP),
    }
    m["bw"] -= np.log(np.exp(m["bw"]).sum(axis=1, keepdims=True))
    return {k: v.astype(np.float32) for k, v in m.items()}


def flat(m: Model) -> np.ndarray:
    return np.concatenate([m[k].ravel() for k in SHAPE])


def unflat(x: np.ndarray) -> Model:
    out, at = {}, 0
    for k, shape in SHAPE.items():
        n = int(np.prod(shape))
        out[k] = x[at : at + n].reshape(shape).astype(np.float32)
        at += n
    return out


def _softmax(z: np.ndarray) -> np.ndarray:
    """In place; sums by a product, which is faster than a reduction along short rows. Logits of bounded states stay far from overflow."""
    np.exp(np.minimum(z, 60, out=z), out=z)
    z /= (z @ np.ones(z.shape[1], z.dtype))[:, None]
    return z


def _classes(sym: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(class, place within a head class or -1) of symbols."""
    head = sym < HEAD
    return np.where(head, sym // GROUP, sym - HEAD + GROUPS), np.where(head, sym % GROUP, -1)


def gradient(m: Model, seq: np.ndarray, h: np.ndarray, before: np.ndarray) -> tuple[Model, np.ndarray, np.ndarray]:
    """Gradients of the mean loss over a window (rows by steps, -1: past the end), state and last symbols after it."""
    n, steps = seq.shape
    H = HIDDEN
    trace = []
    states = np.empty((steps, n, H), h.dtype)
    on = (seq.T != END).astype(h.dtype)[:, :, None]  # the state starts anew behind an end
    prev = before
    uz, uc = m["u"][:, : 2 * H], m["u"][:, 2 * H :]
    for t in range(steps):
        gx = m["x"][prev]
        zr = h @ uz
        zr += gx[:, : 2 * H]
        np.negative(zr, out=zr)
        np.exp(zr, out=zr)
        zr += 1
        np.reciprocal(zr, out=zr)
        z, r = zr[:, :H], zr[:, H:]
        rh = r * h
        c = rh @ uc
        c += gx[:, 2 * H :]
        np.tanh(c, out=c)
        states[t] = h + z * (c - h)
        trace.append((prev, h, z, r, rh, c))
        h = states[t] * on[t]
        prev = np.where(seq[:, t] >= 0, seq[:, t], prev)
    live = seq.T >= 0
    sym = seq.T[live]
    cls, place = _classes(sym)
    by = np.argsort(np.where(place >= 0, cls, GROUPS).astype(np.int16), kind="stable")  # by group, which makes each group's rows a slice
    cls, place = cls[by], place[by]
    s = np.ones((len(sym), H + 1), h.dtype)  # the last column meets the biases
    s[:, :H] = states[live][by]
    scale = np.float32(1 / max(1, len(sym)))
    g = {}
    p = _softmax(s @ np.vstack([m["wc"], m["bc"]]))
    p[np.arange(len(sym)), cls] -= 1
    p *= scale
    gw = s.T @ p
    g["wc"], g["bc"] = gw[:H], gw[H]
    ds = p @ m["wc"].T
    edge = np.searchsorted(np.where(place >= 0, cls, GROUPS), np.arange(GROUPS + 1))
    g["ww"], g["bw"] = np.zeros_like(m["ww"]), np.zeros_like(m["bw"])
    wb = np.concatenate([m["ww"], m["bw"][:, None]], axis=1)
    for k in range(GROUPS):
        i = slice(edge[k], edge[k + 1])
        if edge[k] < edge[k + 1]:
            q = _softmax(s[i] @ wb[k])
            q[np.arange(len(q)), place[i]] -= 1
            q *= scale
            gw = s[i].T @ q
            g["ww"][k], g["bw"][k] = gw[:H], gw[H]
            ds[i] += q @ m["ww"][k].T
    back = np.empty_like(ds)
    back[by] = ds
    dstates = np.zeros_like(states)
    dstates[live] = back
    dh = np.zeros((n, H), h.dtype)
    dx = np.empty((steps, n, 3 * H), h.dtype)
    g["u"], g["x"] = np.zeros_like(m["u"]), np.zeros_like(m["x"])
    for t in range(steps - 1, -1, -1):
        _, h0, z, r, rh, c = trace[t]
        dh = dh * on[t] + dstates[t]
        dc = dh * z * (1 - c * c)
        drh = dc @ uc.T
        dx[t, :, :H] = dh * (c - h0) * z * (1 - z)
        dx[t, :, H : 2 * H] = drh * h0 * r * (1 - r)
        dx[t, :, 2 * H :] = dc
        dh = dh * (1 - z) + drh * r + dx[t, :, : 2 * H] @ uz.T
    wide = dx.reshape(-1, 3 * H)
    g["u"][:, 2 * H :] = np.concatenate([x[4] for x in trace]).T @ wide[:, 2 * H :]
    g["u"][:, : 2 * H] = np.concatenate([x[1] for x in trace]).T @ wide[:, : 2 * H]
    read = np.concatenate([x[0] for x in trace])
    order = np.argsort(read, kind="stable")
    first = np.flatnonzero(np.concatenate([[True], np.diff(read[order]) != 0]))
    g["x"][read[order][first]] = np.add.reduceat(wide[order], first, axis=0)
    return g, h, prev


def side_by_side(texts: list[np.ndarray], rows: int) -> list[np.ndarray]:
    """Whole texts laid end to end in at most ``rows`` rows, the longest first and each where there is most room."""
    order = sorted(range(len(texts)), key=lambda i: (-len(texts[i]), i))
    held: list[list[np.ndarray]] = [[] for _ in range(min(rows, len(texts)))]
    size = np.zeros(len(held), np.int64)
    for i in order:
        k = int(size.argmin())
        held[k].append(texts[i])
        size[k] += len(texts[i])
    return [np.concatenate(held[k]).astype(np.int64) for k in np.argsort(-size, kind="stable").tolist()]


def train(m: Model, texts: Iterable[np.ndarray], rate: float, planned: int, rows: int = ROWS) -> Model:
    """The network after one pass over the texts (each closed by the end symbol), by Adam; the rate falls over ``planned`` tokens."""
    m = {k: v.copy() for k, v in m.items()}
    mean = {k: np.zeros_like(v) for k, v in m.items()}
    var = {k: np.zeros_like(v) for k, v in m.items()}
    step = seen = 0
    for batch in _batches(texts):
        held = side_by_side(batch, rows)
        size = np.array([len(r) for r in held])
        h = np.zeros((len(held), HIDDEN), np.float32)
        before = np.full(len(held), END)
        for at in range(0, int(size[0]), STEPS):
            live = int(np.searchsorted(-size, -at, side="left"))  # sizes fall: the first ones go on
            steps = min(STEPS, int(size[0]) - at)
            seq = np.full((live, steps), -1, np.int64)
            for i in range(live):
                own = held[i][at : at + steps]
                seq[i, : len(own)] = own
            g, h, before = gradient(m, seq, h[:live], before[:live])
            step += 1
            seen += int((seq >= 0).sum())
            now = rate * min(1.0, step / 20) * max(0.1, 1 - seen / max(1, planned))
            norm = np.sqrt(sum(float((v**2).sum()) for v in g.values()))
            cut = np.float32(min(1.0, 1 / max(norm, 1e-9)))
            for k in m:
                gk = g[k] * cut
                mean[k] += 0.1 * (gk - mean[k])
                var[k] += 0.01 * (gk**2 - var[k])
                m[k] -= np.float32(now) * (mean[k] / (1 - 0.9**step)) / (np.sqrt(var[k] / (1 - 0.99**step)) + 1e-6)
    return {k: v.astype(np.float32) for k, v in m.items()}


def _batches(texts: Iterable[np.ndarray]) -> Iterator[list[np.ndarray]]:
    held, size = [], 0
    for t in texts:
        held.append(t)
        size += len(t)
        if size >= READ:
            yield held
            held, size = [], 0
    if held:
        yield held


def log10_probability(m: Model, seqs: np.ndarray, first: np.ndarray) -> np.ndarray:
    """log10 of P(classes and head words) of symbol sequences laid end to end; each ends with the end symbol."""
    sizes = np.diff(first)
    out = np.zeros(len(sizes))
    H = HIDDEN
    uz, uc = np.ascontiguousarray(m["u"][:, : 2 * H]), np.ascontiguousarray(m["u"][:, 2 * H :])
    order = np.argsort(-sizes, kind="stable")
    for lo in range(0, len(order), 1024):
        rows = order[lo : lo + 1024]
        size, at = sizes[rows], first[rows]
        h = np.zeros((len(rows), H), np.float32)
        prev = np.full(len(rows), END)
        for w in range(0, int(size[0]), WINDOW):
            steps = min(WINDOW, int(size[0]) - w)
            live = int(np.searchsorted(-size, -w, side="left"))  # sizes fall: the first ones go on
            h, prev = h[:live], prev[:live]
            ahead = w + np.arange(steps)
            inside = ahead[:, None] < size[None, :live]
            sym = seqs[np.minimum(at[None, :live] + ahead[:, None], len(seqs) - 1)].astype(np.int64)
            states = np.empty((steps, live, H), np.float32)
            for t in range(steps):
                gx = m["x"][prev]
                gh = h @ uz
                gh += gx[:, : 2 * H]
                np.negative(gh, out=gh)
                np.exp(gh, out=gh)
                gh += 1
                np.reciprocal(gh, out=gh)
                c = (gh[:, H:] * h) @ uc
                c += gx[:, 2 * H :]
                np.tanh(c, out=c)
                c -= h
                c *= gh[:, :H]
                h = states[t] = h + c
                prev = sym[t]
            s, y = states[inside], sym[inside]
            row = np.broadcast_to(np.arange(live), inside.shape)[inside]
            cls, place = _classes(y)
            logits = s @ m["wc"]
            logits += m["bc"]
            lp = logits[np.arange(len(y)), cls]
            np.exp(np.minimum(logits, 60, out=logits), out=logits)
            lp = np.minimum(lp, 60) - np.log(logits @ np.ones(CLASSES, logits.dtype))
            by = np.argsort(np.where(place >= 0, cls, 10_000).astype(np.int16), kind="stable")
            edge = np.searchsorted(np.where(place >= 0, cls, 10_000)[by], np.arange(GROUPS + 1))
            for k in range(GROUPS):
                i = by[edge[k] : edge[k + 1]]
                if len(i):
                    q = s[i] @ m["ww"][k]
                    q += m["bw"][k]
                    np.minimum(q, 60, out=q)
                    got = q[np.arange(len(i)), place[i]]
                    lp[i] += got - np.log(np.exp(q, out=q) @ np.ones(GROUP, q.dtype))
            out[rows[:live]] += np.bincount(row, weights=lp, minlength=live)
    return out / np.log(10)
