"""A gated recurrent language model in numpy: truncated backpropagation and a class-factored softmax.

Words are numbers: 0 .. CLASSES * WIDTH - 1 are frequent words, WIDTH to a
class in the order of their counts; higher numbers are whole classes of rarer
words. The probability of a frequent word is that of its class times that of
the word in its class, both from the state; of a rarer one the model gives the
class, and the caller the word's share of it.
"""

from __future__ import annotations

import numpy as np

STATE, EMBED, CLASSES, WIDTH = 16, 16, 32, 32
FREQUENT = CLASSES * WIDTH
STREAMS, LEAST, WINDOW, RATE = 256, 512, 24, 0.004


def start(class_log: np.ndarray, word_log: np.ndarray, seed: int = 3) -> dict[str, np.ndarray]:
    """Weights with which the model gives the unigram probabilities: logs of the classes' shares and of words within them."""
    rng = np.random.default_rng(seed)
    n_in = FREQUENT + len(class_log) - CLASSES
    draw = lambda *s: (rng.normal(0, 0.1, s)).astype(np.float32)
    return {"embed": draw(n_in, EMBED), "wx": draw(EMBED, 3 * STATE), "wh": draw(STATE, 3 * STATE), "b": np.zeros(3 * STATE, np.float32), "classes": np.zeros((STATE, len(class_log)), np.float32), "class_bias": class_log.astype(np.float32), "words": np.zeros((FREQUENT, STATE), np.float32), "word_bias": word_log.astype(np.float32)}


def class_of(ids: np.ndarray) -> np.ndarray:
    return np.where(ids < FREQUENT, ids // WIDTH, ids - FREQUENT + CLASSES)


def _sigmoid(x: np.ndarray) -> np.ndarray:
    """In place."""
    np.negative(x, out=x)
    np.exp(x, out=x)
    x += 1
    return np.divide(1, x, out=x)


def step(p: dict, table: np.ndarray, ids: np.ndarray, h: np.ndarray) -> tuple[np.ndarray, ...]:
    """One gated step; ``table`` is embed @ wx + b."""
    gx, gh = table[ids], h @ p["wh"]
    rz = _sigmoid(gx[:, : 2 * STATE] + gh[:, : 2 * STATE])
    r, z = rz[:, :STATE], rz[:, STATE:]
    own = gh[:, 2 * STATE :]
    n = r * own
    n += gx[:, 2 * STATE :]
    np.tanh(n, out=n)
    h = h - n
    h *= z
    h += n
    return h, r, z, n, own


def log_probabilities(p: dict, h: np.ndarray, ids: np.ndarray) -> np.ndarray:
    """Natural log of the probability of each next word (for rarer ones, of its class) from its state."""
    order = np.argsort(class_of(ids).astype(np.uint16), kind="stable")
    h, ids = h[order], ids[order]
    k, across = class_of(ids), np.ascontiguousarray(h.T)
    out = p["classes"].T @ across  # a column for each state, so that sums run along memory
    out += p["class_bias"][:, None]
    out -= out.max(axis=0)
    sorted_result = out[k, np.arange(len(ids))]
    np.exp(out, out=out)
    sorted_result -= np.log(out.sum(axis=0))
    edges = np.searchsorted(k, np.arange(CLASSES + 1)).tolist()
    for c in range(CLASSES):
        lo, hi = edges[c], edges[c + 1]
        if hi > lo:
            own = slice(c * WIDTH, (c + 1) * WIDTH)
            s = p["words"][own] @ across[:, lo:hi]
            s += p["word_bias"][own, None]
            s -= s.max(axis=0)
            sorted_result[lo:hi] += s[ids[lo:hi] - c * WIDTH, np.arange(hi - lo)]
            np.exp(s, out=s)
            sorted_result[lo:hi] -= np.log(s.sum(axis=0))
    result = np.empty_like(sorted_result)
    result[order] = sorted_result
    return result


def _head_gradients(p: dict, h: np.ndarray, ids: np.ndarray, g: dict) -> np.ndarray:
    """Gradients of the mean negative log-probability; returns that of the states."""
    m = len(ids)
    order = np.argsort(class_of(ids).astype(np.uint16), kind="stable")
    h, ids = h[order], ids[order]
    k, across = class_of(ids), np.ascontiguousarray(h.T)
    e = p["classes"].T @ across  # a column for each state, so that sums run along memory
    e += p["class_bias"][:, None]
    e -= e.max(axis=0)
    np.exp(e, out=e)
    e /= m * e.sum(axis=0)
    e[k, np.arange(m)] -= 1 / m
    g["classes"], g["class_bias"] = across @ e.T, e.sum(axis=1)
    sorted_back = e.T @ p["classes"].T
    g["words"], g["word_bias"] = np.zeros_like(p["words"]), np.zeros_like(p["word_bias"])
    edges = np.searchsorted(k, np.arange(CLASSES + 1)).tolist()
    for c in range(CLASSES):
        lo, hi = edges[c], edges[c + 1]
        if hi > lo:
            own = slice(c * WIDTH, (c + 1) * WIDTH)
            w = p["words"][own]
            s = w @ across[:, lo:hi]
            s += p["word_bias"][own, None]
            s -= s.max(axis=0)
            np.exp(s, out=s)
            s /= m * s.sum(axis=0)
            s[ids[lo:hi] - c * WIDTH, np.arange(hi - lo)] -= 1 / m
            g["words"][own], g["word_bias"][own] = s @ h[lo:hi], s.sum(axis=1)
            sorted_back[lo:hi] += s.T @ w
    back = np.empty_like(sorted_back)
    back[order] = sorted_back
    return back


def window_gradients(p: dict, inputs: np.ndarray, targets: np.ndarray, h: np.ndarray, end: int) -> tuple[dict, np.ndarray]:
    """Gradients of the mean negative log-probability of ``targets`` (steps x streams) through all steps, and the last state.

    The state ``h`` comes from before the window as a constant and is cleared after ``end``.
    """
    table = p["embed"] @ p["wx"] + p["b"]
    kept, states = [], []
    for x in inputs:
        fresh = (x != end)[:, None].astype(h.dtype)
        h0 = h * fresh
        h, r, z, n, own = step(p, table, x, h0)
        kept.append((fresh, h0, r, z, n, own))
        states.append(h)
    g: dict = {}
    head = _head_gradients(p, np.concatenate(states), targets.ravel(), g).reshape(len(inputs), *h.shape)
    fresh, h0, r, z, n, own = (np.stack(x) for x in zip(*kept))
    by_n = (1 - z) * (1 - n * n)  # how a step's gates hang on its state, for all steps at once
    by_rz = np.concatenate([by_n * own * r * (1 - r), (h0 - n) * z * (1 - z)], axis=2)
    states, back = np.empty((2, len(inputs), *h.shape), h.dtype)  # gradients by each state, and by the candidate of each
    inner = np.empty((len(inputs), len(h), 3 * STATE), h.dtype)  # by the state's part of the gates
    dh, turned = np.zeros_like(h), np.ascontiguousarray(p["wh"].T)
    for i in range(len(inputs) - 1, -1, -1):
        d = np.add(head[i], dh, out=states[i])
        dn = np.multiply(d, by_n[i], out=back[i])
        x = inner[i]
        np.multiply(d, by_rz[i, :, :STATE], out=x[:, :STATE])
        np.multiply(d, by_rz[i, :, STATE:], out=x[:, STATE : 2 * STATE])
        np.multiply(dn, r[i], out=x[:, 2 * STATE :])
        dh = x @ turned
        dh += d * z[i]
        dh *= fresh[i]
    g["wh"] = h0.reshape(-1, STATE).T @ inner.reshape(-1, 3 * STATE)
    gates = inner  # by the input's part: the same but for the candidate
    gates[:, :, 2 * STATE :] = back
    words = inputs.ravel()
    order = np.argsort(words.astype(np.uint16), kind="stable")
    first = np.flatnonzero(np.r_[True, words[order][1:] != words[order][:-1]])
    dtable = np.zeros_like(table)
    dtable[words[order][first]] = np.add.reduceat(gates.reshape(-1, 3 * STATE)[order], first, axis=0)
    g["embed"], g["wx"], g["b"] = dtable @ p["wx"].T, p["embed"].T @ dtable, dtable.sum(axis=0)
    return g, h


class Training:
    """A model in training: one pass over streams of words, with Adam."""

    def __init__(self, p: dict) -> None:
        self.names = sorted(p)
        self.flat = np.concatenate([p[k].ravel() for k in self.names])
        self.p, at = {}, 0
        for k in self.names:  # views, so that all weights are moved at once
            self.p[k] = self.flat[at : at + p[k].size].reshape(p[k].shape)
            at += p[k].size
        self.m, self.v, self.t = np.zeros_like(self.flat), np.zeros_like(self.flat), 0

    def feed(self, stream: np.ndarray, end: int) -> None:
        """All of ``stream`` (each text closed by ``end``, and one ``end`` before the first), in windows of WINDOW words.

        The stream is cut into parallel parts, STREAMS of them if each then has
        LEAST words or more, fewer otherwise; every word but the first of a part
        is learned, and that is learned as the last of the part before. The last
        part is filled up with ``end``. The state is carried from window to window
        and cleared after ``end``; gradients stop at the window.
        """
        learned = len(stream) - 1
        if learned < 1:
            return
        streams = max(1, min(STREAMS, learned // LEAST))
        width = -(-learned // streams)
        filled = np.full(streams * width + 1, end, stream.dtype)
        filled[: len(stream)] = stream
        words = np.concatenate([filled[:-1].reshape(streams, width), filled[width::width, None]], axis=1)
        width += 1
        h = np.zeros((streams, STATE), self.flat.dtype)
        for at in range(0, width - 1, WINDOW):
            targets = words[:, at + 1 : at + WINDOW + 1].T
            g, h = window_gradients(self.p, words[:, at : at + len(targets)].T, targets, h, end)
            x = np.concatenate([g[k].ravel() for k in self.names])
            x *= min(1.0, 1.0 / (float(np.sqrt(x @ x)) + 1e-9))
            self.t += 1
            self.m += 0.1 * (x - self.m)
            self.v += 0.01 * (x * x - self.v)
            self.flat -= RATE / (1 - 0.9**self.t) * self.m / (np.sqrt(self.v / (1 - 0.99**self.t)) + 1e-7)


def score_texts(p: dict, texts: list[np.ndarray], end: int, window: int = 20_000) -> np.ndarray:
    """Sum of log-probabilities of each whole text (closed by ``end``); texts advance together.

    Probabilities are taken in windows of about ``window`` states; the state is
    carried from one to the next, to the end of the text.
    """
    total = np.zeros(len(texts))
    if not texts:
        return total
    length = np.array([len(t) for t in texts])
    order = np.argsort(-length, kind="stable")
    length = length[order]
    flat = np.concatenate([texts[i] for i in order])
    begin = np.r_[0, np.cumsum(length)[:-1]]
    table = p["embed"] @ p["wx"] + p["b"]
    h = np.zeros((len(texts), STATE), np.float32)
    sums = np.zeros(len(texts))
    states, owners, targets = [], [], []
    held, x = 0, np.full(len(texts), end)
    for t, live in enumerate(np.searchsorted(-length, -np.arange(length[0])).tolist()):  # texts longer than t
        h = step(p, table, x[:live], h[:live])[0]
        x = flat[begin[:live] + t]
        states.append(h)
        owners.append(live)
        targets.append(x)
        held += live
        if held >= window or t == length[0] - 1:
            value = log_probabilities(p, np.concatenate(states), np.concatenate(targets))
            n = np.array(owners)
            own = np.arange(held) - np.repeat(np.cumsum(n) - n, n)
            sums[: n[0]] += np.bincount(own, value, n[0])
            states, owners, targets, held = [], [], [], 0
    total[order] = sums
    return total
