"""A character tagger in numpy: two LSTMs, one in each direction, and a CRF over their scores."""

from __future__ import annotations

import numpy as np

LETTERS = " \n\t.,;:!?-_+@()[]{}<>/\\|'\"#&%*=~$"
#: Tags: outside, then begin and inside of each kind.
KINDS = ("email", "ip", "card", "phone")
TAGS = 1 + 2 * len(KINDS)
FORBIDDEN = -1e4


def letter_ids(text: str) -> np.ndarray:
    """0 pads; all digits are one letter, all upper-case letters their lower case and non-ASCII ones one letter."""
    codes = np.frombuffer(text.encode("utf-32-le"), np.uint32)
    table = np.full(129, 2, np.int64)
    table[128] = 1
    table[48:58] = 3
    table[65:91] = table[97:123] = 4 + np.arange(26)
    for k, c in enumerate(LETTERS):
        table[ord(c)] = 30 + k
    return table[np.minimum(codes, 128)]


LETTER_COUNT = 30 + len(LETTERS)


def allowed() -> np.ndarray:
    """Scores that rule out an inside tag without its kind before it; row: from, column: to."""
    out = np.zeros((TAGS, TAGS))
    for k in range(len(KINDS)):
        out[:, 2 + 2 * k] = FORBIDDEN
        out[1 + 2 * k, 2 + 2 * k] = out[2 + 2 * k, 2 + 2 * k] = 0
    return out


def sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -30, 30)))


def log_sum(x: np.ndarray, axis: int) -> np.ndarray:
    top = x.max(axis=axis, keepdims=True)
    return np.squeeze(top, axis) + np.log(np.exp(x - top).sum(axis=axis))


def lstm(x: np.ndarray, wh: np.ndarray, keep: list | None = None) -> np.ndarray:
    """Hidden states of (batch, time, 4 * hidden) inputs; keep gets what the backward pass needs."""
    n, steps, width = x.shape
    size = width // 4
    h, c = np.zeros((n, size), x.dtype), np.zeros((n, size), x.dtype)
    out = np.empty((n, steps, size), x.dtype)
    for t in range(steps):
        g = x[:, t] + h @ wh
        gates = sigmoid(g[:, : 3 * size])
        i, f, o, u = gates[:, :size], gates[:, size : 2 * size], gates[:, 2 * size :], np.tanh(g[:, 3 * size :])
        before, c = c, f * c + i * u
        tc = np.tanh(c)
        if keep is not None:
            keep.append((i, f, o, u, before, tc, h))
        h = o * tc
        out[:, t] = h
    return out


def lstm_back(dout: np.ndarray, wh: np.ndarray, keep: list) -> tuple[np.ndarray, np.ndarray]:
    """Gradients of the inputs and of wh."""
    n, steps, size = dout.shape
    dx, dwh = np.empty((n, steps, 4 * size), dout.dtype), np.zeros_like(wh)
    dh, dc = np.zeros((n, size), dout.dtype), np.zeros((n, size), dout.dtype)
    for t in range(steps - 1, -1, -1):
        i, f, o, u, before, tc, h = keep[t]
        dh = dh + dout[:, t]
        dc = dc + dh * o * (1 - tc * tc)
        g = np.concatenate([dc * u * i * (1 - i), dc * before * f * (1 - f), dh * tc * o * (1 - o), dc * i * (1 - u * u)], axis=1)
        dx[:, t] = g
        dwh += h.T @ g
        dh, dc = g @ wh.T, dc * f
    return dx, dwh


def crf_marginals(scores: np.ndarray, moves: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Log partition, tag marginals and summed move marginals of (batch, time, tags) scores."""
    n, steps, tags = scores.shape
    fore, back = np.empty_like(scores), np.zeros_like(scores)
    fore[:, 0] = scores[:, 0]
    for t in range(1, steps):
        fore[:, t] = log_sum(fore[:, t - 1, :, None] + moves, 1) + scores[:, t]
    for t in range(steps - 2, -1, -1):
        back[:, t] = log_sum(moves + (scores[:, t + 1] + back[:, t + 1])[:, None], 2)
    whole = log_sum(fore[:, -1], 1)
    tags_ = np.exp(fore + back - whole[:, None, None])
    pair = np.zeros((tags, tags))
    for t in range(1, steps):
        pair += np.exp(fore[:, t - 1, :, None] + moves + (scores[:, t] + back[:, t])[:, None] - whole[:, None, None]).sum(axis=0)
    return whole, tags_, pair


class Tagger:
    def __init__(self, embed: int = 12, hidden: int = 16, seed: int = 1):
        r = np.random.default_rng(seed)
        put = lambda *s: (r.standard_normal(s) / np.sqrt(s[0])).astype(np.float32)
        self.p = {"e": put(LETTER_COUNT, embed) * 3, "moves": np.zeros((TAGS, TAGS), np.float32), "wo": put(2 * hidden, TAGS), "bo": np.zeros(TAGS, np.float32)}
        for side in "lr":
            bias = np.zeros(4 * hidden, np.float32)
            bias[hidden : 2 * hidden] = 1  # remember at first
            self.p |= {f"x{side}": put(embed, 4 * hidden), f"h{side}": put(hidden, 4 * hidden), f"b{side}": bias}

    def moves(self) -> np.ndarray:
        return self.p["moves"] + allowed()

    def scores(self, ids: np.ndarray, keep: dict | None = None) -> np.ndarray:
        p, x = self.p, self.p["e"][ids]
        kept = {"l": [], "r": []} if keep is not None else {"l": None, "r": None}
        left = lstm(x @ p["xl"] + p["bl"], p["hl"], kept["l"])
        right = lstm(x[:, ::-1] @ p["xr"] + p["br"], p["hr"], kept["r"])[:, ::-1]
        both = np.concatenate([left, right], axis=2)
        if keep is not None:
            keep |= kept | {"x": x, "both": both}
        return both @ p["wo"] + p["bo"]

    def gradients(self, ids: np.ndarray, tags: np.ndarray) -> tuple[float, dict[str, np.ndarray]]:
        """Negative log likelihood of the tags, and its gradients."""
        p, keep, n = self.p, {}, len(ids)
        scores = self.scores(ids, keep).astype(np.float64)
        whole, marginal, pair = crf_marginals(scores, self.moves())
        rows = np.arange(n)[:, None]
        gold = np.take_along_axis(scores, tags[:, :, None], 2).sum() + self.moves()[tags[:, :-1], tags[:, 1:]].sum()
        ds = marginal
        ds[rows, np.arange(ids.shape[1])[None], tags] -= 1
        np.subtract.at(pair, (tags[:, :-1], tags[:, 1:]), 1)
        ds = (ds / n).astype(np.float32)
        size = p["hl"].shape[0]
        g = {"moves": (pair / n).astype(np.float32), "wo": np.einsum("btk,bto->ko", keep["both"], ds), "bo": ds.sum(axis=(0, 1))}
        dboth = ds @ p["wo"].T
        dx = np.zeros_like(keep["x"])
        for side, part, x in (("l", dboth[:, :, :size], keep["x"]), ("r", dboth[:, ::-1, size:], keep["x"][:, ::-1])):
            dg, g[f"h{side}"] = lstm_back(part, p[f"h{side}"], keep[side])
            g[f"x{side}"], g[f"b{side}"] = np.einsum("bte,btg->eg", x, dg), dg.sum(axis=(0, 1))
            back = dg @ p[f"x{side}"].T
            dx += back if side == "l" else back[:, ::-1]
        g["e"] = np.zeros_like(p["e"])
        np.add.at(g["e"], ids, dx)
        return float(whole.sum() - gold) / n, g

    def train(self, ids: np.ndarray, tags: np.ndarray, epochs: int = 8, batch: int = 32, rate: float = 0.01, seed: int = 2) -> list[float]:
        """Adam over the windows; returns the mean loss of each epoch."""
        r, step, losses = np.random.default_rng(seed), 0, []
        m = {k: np.zeros_like(v) for k, v in self.p.items()}
        v = {k: np.zeros_like(x) for k, x in self.p.items()}
        for epoch in range(epochs):
            order, total = r.permutation(len(ids)), 0.0
            for lo in range(0, len(ids), batch):
                at = order[lo : lo + batch]
                loss, g = self.gradients(ids[at], tags[at])
                total, step = total + loss * len(at), step + 1
                norm = np.sqrt(sum(float((x * x).sum()) for x in g.values()))
                for k, x in g.items():
                    x = x * min(1.0, 5 / (norm + 1e-9))
                    m[k] = 0.9 * m[k] + 0.1 * x
                    v[k] = 0.99 * v[k] + 0.01 * x * x
                    fade = rate * 0.5 ** (epoch / 3)
                    self.p[k] -= fade * (m[k] / (1 - 0.9**step)) / (np.sqrt(v[k] / (1 - 0.99**step)) + 1e-8)
            losses.append(total / max(1, len(ids)))
        return losses

    def log_marginals(self, ids: np.ndarray) -> np.ndarray:
        """Each window decoded by itself."""
        return np.log(np.maximum(crf_tags(self.scores(ids), self.moves().astype(np.float32)), 1e-12))


def crf_tags(scores: np.ndarray, moves: np.ndarray) -> np.ndarray:
    """Tag marginals by scaled forward and backward sums."""
    e = np.exp(scores - scores.max(axis=2, keepdims=True))
    a = np.exp(np.maximum(moves, -60))
    fore, back = np.empty_like(e), np.ones_like(e)
    fore[:, 0] = e[:, 0]
    for t in range(1, e.shape[1]):
        x = (fore[:, t - 1] @ a) * e[:, t]
        fore[:, t] = x / x.sum(axis=1, keepdims=True)
    for t in range(e.shape[1] - 2, -1, -1):
        x = (e[:, t + 1] * back[:, t + 1]) @ a.T
        back[:, t] = x / x.sum(axis=1, keepdims=True)
    x = fore * back
    return x / x.sum(axis=2, keepdims=True)


def best_path(unary: np.ndarray, moves: np.ndarray, length: np.ndarray) -> np.ndarray:
    """Viterbi over (batch, time, tags), each row up to its length; later places are 0."""
    n, steps, _ = unary.shape
    came = np.zeros(unary.shape, np.int8)
    score, end = unary[:, 0].copy(), np.zeros((n, unary.shape[2]), unary.dtype)
    end[length == 1] = score[length == 1]
    for t in range(1, steps):
        x = score[:, :, None] + moves
        came[:, t] = x.argmax(axis=1)
        score = x.max(axis=1) + unary[:, t]
        over = length == t + 1
        end[over] = score[over]
    out = np.zeros((n, steps), np.int64)
    tag, rows = end.argmax(axis=1), np.arange(n)
    for t in range(steps - 1, -1, -1):
        live = t < length
        out[live, t] = tag[live]
        tag = np.where(live, came[rows, t, tag], tag)
    return out
