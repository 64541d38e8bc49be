"""A gated recurrent language model in numpy: class-factored softmax, truncated backpropagation through time.

Tokens 0 .. WORDS-1 are the most frequent words, in classes of ``INNER`` by rank; the next ``SHAPES``
tokens stand for all other words of a shape and are classes of their own; the last is the start of a
document. The input projection is a table, a row for each token. State is carried from window to window
within a document, both in training and in scoring, and is zero at a document's start.

Several learners may each start from the same parameters, learn from their own share of the documents and be
averaged: ``Trainer`` reads a stream of documents of any length in bounded memory.
"""

from __future__ import annotations

from collections.abc import Iterable

import numpy as np

WORDS, INNER, SHAPES, HIDDEN = 1024, 64, 16, 16
GROUPS = WORDS // INNER
CLASSES = GROUPS + SHAPES
START = WORDS + SHAPES
#: Lanes and steps of an update, tokens that a trainer gathers before it deals them into lanes, and updates it wants of them at least.
LANES, WINDOW, GATHERED, LEAST_UPDATES = 256, 32, 1 << 20, 16
#: Scores before the softmax are cut off here, so that their exponentials stay finite.
HIGHEST = np.float32(60)

Params = dict[str, np.ndarray]


def _sigmoid(x: np.ndarray) -> np.ndarray:
    np.multiply(x, 0.5, out=x)
    np.tanh(x, out=x)
    x += 1
    x *= 0.5
    return x


def _softmax(x: np.ndarray, goal: np.ndarray) -> np.ndarray:
    """Turns rows of ``x`` into probabilities, in place, and returns the log probability of each row's goal."""
    np.minimum(x, HIGHEST, out=x)
    at = np.arange(len(x))
    picked = x[at, goal]
    np.exp(x, out=x)
    total = x.sum(axis=1)
    x /= total[:, None]
    return picked - np.log(total)


def class_of(token: np.ndarray) -> np.ndarray:
    return np.where(token < WORDS, token // INNER, token - (WORDS - GROUPS))


def first_params(frequency: np.ndarray, seed: int = 42) -> Params:
    """Small random weights, and output biases that are the logarithms of the tokens' frequencies: training begins where counting ends."""
    rng = np.random.default_rng(seed)

    def normal(*shape: int, by: float) -> np.ndarray:
        return (rng.standard_normal(shape) * by).astype(np.float32)

    n = np.asarray(frequency, np.float64) + 0.5
    words = n[:WORDS].reshape(GROUPS, INNER)
    return {
        "x": normal(START + 1, 3 * HIDDEN, by=0.1),
        "u": normal(HIDDEN, 3 * HIDDEN, by=HIDDEN**-0.5),
        "b": np.zeros(3 * HIDDEN, np.float32),
        "c": normal(HIDDEN, CLASSES, by=0.1),
        "cb": np.log(np.concatenate([words.sum(axis=1), n[WORDS:START]]) / n.sum()).astype(np.float32),
        "w": normal(GROUPS, HIDDEN, INNER, by=0.1),
        "wb": np.log(words / words.sum(axis=1, keepdims=True)).astype(np.float32),
    }


def to_bytes(params: Params) -> bytes:
    return b"".join(params[k].astype("<f4").tobytes() for k in sorted(params))


def from_bytes(raw: bytes) -> Params:
    out, at = {}, 0
    for k, v in sorted(first_params(np.ones(START)).items()):
        out[k] = np.frombuffer(raw, "<f4", v.size, at).reshape(v.shape).astype(np.float32)
        at += 4 * v.size
    return out


def _steps(p: Params, tokens: np.ndarray, h: np.ndarray, keep: np.ndarray | None = None, trace: list | None = None):
    """Hidden states (T, B, H) after reading tokens (T, B) from state h, and the last; ``trace`` takes what backpropagation needs."""
    H = HIDDEN
    gates = p["x"][tokens]
    gates += p["b"]
    out = np.empty((*tokens.shape, H), gates.dtype)
    u = p["u"]
    for t in range(len(tokens)):
        if keep is not None:
            h = h * keep[t]
        a = h @ u
        g = gates[t]
        zr = g[:, : 2 * H]
        zr += a[:, : 2 * H]
        zr = _sigmoid(zr)
        z, r = zr[:, :H], zr[:, H:]
        n = r * a[:, 2 * H :]
        n += g[:, 2 * H :]
        np.tanh(n, out=n)
        new = h - n
        new *= z
        new += n
        if trace is not None:
            trace.append((h, z, r, n, a[:, 2 * H :]))
        out[t] = h = new
    return out, h


def _by_class(token: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Places of the tokens that are words, by class, and where each class begins."""
    cls = np.where(token < WORDS, token // INNER, GROUPS).astype(np.int16)
    order = np.argsort(cls, kind="stable")
    return order, np.searchsorted(cls[order], np.arange(GROUPS + 1))


def log_probs(p: Params, hidden: np.ndarray, target: np.ndarray) -> np.ndarray:
    """Natural log probability of each target token from its state; rows of both belong together."""
    x = hidden @ p["c"]
    x += p["cb"]
    out = _softmax(x, class_of(target))
    order, bounds = _by_class(target)
    words = order[: bounds[-1]]
    states, inner = hidden[words], target[words] % INNER
    got = np.empty(len(words), out.dtype)
    for k in range(GROUPS):
        cut = slice(bounds[k], bounds[k + 1])
        if bounds[k] < bounds[k + 1]:
            x = states[cut] @ p["w"][k]
            x += p["wb"][k]
            got[cut] = _softmax(x, inner[cut])
    out[words] += got
    return out


def score(p: Params, docs: list[np.ndarray], lanes: int = 256, window: int = 32) -> np.ndarray:
    """Natural log probability of each whole document, a sequence of tokens."""
    total = np.zeros(len(docs))
    length = np.array([len(d) for d in docs], np.int64)
    order = np.argsort(-length, kind="stable")
    for lo in range(0, len(order), lanes):
        group = order[lo : lo + lanes]
        size = length[group]
        flat = np.concatenate([docs[i] for i in group]).astype(np.int64)
        first = np.cumsum(size) - size
        h = np.zeros((len(group), HIDDEN), np.float32)
        last = np.full(len(group), START)
        for at in range(0, int(size[0]), window):
            live = int((size > at).sum())  # the longest come first
            T = min(window, int(size[0]) - at)
            place = at + np.arange(T)[:, None]
            real = place < size[None, :live]
            target = flat[np.minimum(first[:live] + place, len(flat) - 1)]
            given = np.concatenate([last[None, :live], target[:-1]])
            states, h = _steps(p, given, h[:live])
            last = target[-1]
            lane = np.broadcast_to(np.arange(live), target.shape)[real]
            total[group[:live]] += np.bincount(lane, log_probs(p, states[real], target[real]).astype(np.float64), minlength=live)
    return total


def average(found: Iterable[tuple[int, bytes]]) -> tuple[int, bytes]:
    """Of (tokens, parameters) of several learners: all tokens, and the mean of the parameters, each counted by its tokens."""
    total, mean = 0, None
    for n, raw in found:
        x = np.frombuffer(raw, "<f4").astype(np.float64) * n
        mean = x if mean is None else mean + x
        total += n
    return total, b"" if mean is None else (mean / max(1, total)).astype("<f4").tobytes()


class Trainer:
    """Adam over a stream of documents, each read once; ``tokens`` is how many it has read."""

    def __init__(self, params: Params, rate: float = 0.01):
        self.params = {k: v.copy() for k, v in params.items()}
        self.m = {k: np.zeros_like(v) for k, v in params.items()}
        self.s = {k: np.zeros_like(v) for k, v in params.items()}
        self.rate, self.updates, self.tokens, self.loss = rate, 0, 0, 0.0

    def learn(self, docs: Iterable[np.ndarray]) -> None:
        """Every token of every document is a target once; a document longer than what is gathered goes on with its state at zero."""
        held, size = [], 0
        for d in docs:
            for at in range(0, len(d), GATHERED):
                piece = d[at : at + GATHERED]
                held.append((piece, START if at == 0 else int(d[at - 1])))
                size += len(piece)
                if size >= GATHERED:
                    self._run(held, size)
                    held, size = [], 0
        if size:
            self._run(held, size)

    def _run(self, held: list[tuple[np.ndarray, int]], size: int) -> None:
        lanes = max(1, min(LANES, size // (LEAST_UPDATES * WINDOW)))
        steps = -(-size // lanes)
        target = np.zeros(lanes * steps, np.int64)
        target[:size] = np.concatenate([d for d, _ in held])
        given = np.empty_like(target)
        given[0], given[1:] = START, target[:-1]
        begins = np.cumsum([0, *(len(d) for d, _ in held[:-1])])
        given[begins] = [b for _, b in held]
        weight = np.zeros(lanes * steps, np.float32)
        weight[:size] = 1
        keep = np.ones(lanes * steps, np.float32)
        keep[begins] = 0
        target, given, weight, keep = (np.ascontiguousarray(v.reshape(lanes, steps).T) for v in (target, given, weight, keep))
        h = np.zeros((lanes, HIDDEN), np.float32)
        for at in range(0, steps, WINDOW):
            cut = slice(at, at + WINDOW)
            grads, h = self._gradients(given[cut], target[cut], weight[cut], keep[cut][:, :, None], h)
            self._step(grads)
        self.tokens += size

    def _step(self, grads: Params) -> None:
        self.updates += 1
        n = self.updates
        norm = float(np.sqrt(sum(float(np.vdot(g, g)) for g in grads.values())))
        shrink = np.float32(min(1.0, 1.0 / (norm + 1e-9)))
        rate = np.float32(self.rate / (1 - 0.9**n))
        fix = np.float32(1 / (1 - 0.99**n))
        for k, g in grads.items():
            m, s = self.m[k], self.s[k]
            g *= shrink
            m *= np.float32(0.9)
            m += np.float32(0.1) * g
            s *= np.float32(0.99)
            g *= g
            g *= np.float32(0.01)
            s += g
            np.multiply(s, fix, out=g)
            np.sqrt(g, out=g)
            g += np.float32(1e-6)
            np.divide(m, g, out=g)
            g *= rate
            self.params[k] -= g

    def _gradients(self, given: np.ndarray, target: np.ndarray, weight: np.ndarray, keep: np.ndarray, h: np.ndarray):
        p, H = self.params, HIDDEN
        held: list = []
        states, last = _steps(p, given, h, keep, held)
        flat, goal, w = states.reshape(-1, H), target.reshape(-1), weight.reshape(-1)
        n = max(1.0, float(w.sum()))
        w = (w / np.float32(n))[:, None]
        grads: Params = {}
        cls = class_of(goal)
        x = flat @ p["c"]
        x += p["cb"]
        self.loss = -float((_softmax(x, cls) * w[:, 0]).sum())
        x[np.arange(len(goal)), cls] -= 1
        x *= w
        grads["c"], grads["cb"] = flat.T @ x, x.sum(axis=0)
        dh = x @ p["c"].T
        order, bounds = _by_class(goal)
        words = order[: bounds[-1]]
        some, inner, weights = flat[words], goal[words] % INNER, w[words]
        back = np.empty_like(some)
        grads["w"], grads["wb"] = np.zeros_like(p["w"]), np.zeros_like(p["wb"])
        for k in range(GROUPS):
            lo, hi = bounds[k], bounds[k + 1]
            if lo < hi:
                x = some[lo:hi] @ p["w"][k]
                x += p["wb"][k]
                self.loss -= float((_softmax(x, inner[lo:hi]) * weights[lo:hi, 0]).sum())
                x[np.arange(hi - lo), inner[lo:hi]] -= 1
                x *= weights[lo:hi]
                grads["w"][k], grads["wb"][k] = some[lo:hi].T @ x, x.sum(axis=0)
                np.matmul(x, p["w"][k].T, out=back[lo:hi])
        dh[words] += back
        dh = dh.reshape(states.shape)
        dg = np.empty((*target.shape, 3 * H), dh.dtype)
        da = np.empty((target.shape[1], 3 * H), dh.dtype)
        after = np.zeros_like(h)
        ut = np.ascontiguousarray(p["u"].T)
        du = np.zeros_like(p["u"])
        for t in range(len(target) - 1, -1, -1):
            before, z, r, cand, an = held[t]
            total = dh[t]
            total += after
            g = dg[t]
            dn = g[:, 2 * H :]
            np.multiply(cand, cand, out=dn)
            np.subtract(1, dn, out=dn)
            dn *= total
            dn *= 1 - z
            dz = g[:, :H]
            np.subtract(before, cand, out=dz)
            dz *= total
            dz *= z
            dz *= 1 - z
            dr = g[:, H : 2 * H]
            np.multiply(dn, an, out=dr)
            dr *= r
            dr *= 1 - r
            da[:, : 2 * H] = g[:, : 2 * H]
            np.multiply(dn, r, out=da[:, 2 * H :])
            du += before.T @ da
            after = total * z
            after += da @ ut
            after *= keep[t]
        grads["u"] = du
        rows = dg.reshape(-1, 3 * H)
        grads["b"] = rows.sum(axis=0)
        token = given.reshape(-1).astype(np.int16)
        order = np.argsort(token, kind="stable")
        token = token[order]
        first = np.flatnonzero(np.concatenate([[True], token[1:] != token[:-1]]))
        grads["x"] = np.zeros_like(p["x"])
        grads["x"][token[first]] = np.add.reduceat(rows[order], first, axis=0)
        return grads, last
