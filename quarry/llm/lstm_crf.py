"""Character-level bidirectional LSTM with a CRF over its tags, in numpy: training, decoding, nothing else."""

from __future__ import annotations

import numpy as np

#: Characters: 0 pads, 1..127 are ASCII, 128 is any letter beyond, 129 anything else.
N_CHARS = 130


def char_ids(text: str, length: int) -> np.ndarray:
    """Numbers of a text's characters, padded to a length."""
    codes = np.frombuffer(text.encode("utf-32-le"), np.uint32)
    if len(codes) and codes.max() >= 128:
        beyond = np.array([128 if c.isalpha() else 129 for c in text], np.uint32)
        codes = np.where(codes < 128, np.maximum(codes, 1), beyond)
    ids = np.zeros(length, np.int64)
    ids[: len(codes)] = np.maximum(codes, 1)
    return ids


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 0.5 * np.tanh(0.5 * x) + 0.5


def _logsumexp(x: np.ndarray, axis: int) -> np.ndarray:
    top = x.max(axis=axis, keepdims=True)
    return (top + np.log(np.exp(x - top).sum(axis=axis, keepdims=True))).squeeze(axis)


def _lstm(inputs: np.ndarray, recurrent: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Hidden states, cells and gates (input, forget, output, candidate) over time; inputs are projected already."""
    steps, n, width = inputs.shape
    h = width // 4
    hidden, cells, gates = np.zeros((steps + 1, n, h), np.float32), np.zeros((steps + 1, n, h), np.float32), np.empty_like(inputs)
    for t in range(steps):
        z = inputs[t] + hidden[t] @ recurrent
        g = gates[t]
        g[:, : 3 * h] = _sigmoid(z[:, : 3 * h])
        g[:, 3 * h :] = np.tanh(z[:, 3 * h :])
        cells[t + 1] = g[:, h : 2 * h] * cells[t] + g[:, :h] * g[:, 3 * h :]
        hidden[t + 1] = g[:, 2 * h : 3 * h] * np.tanh(cells[t + 1])
    return hidden, cells, gates


def _lstm_back(d_hidden: np.ndarray, hidden: np.ndarray, cells: np.ndarray, gates: np.ndarray, recurrent: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Gradients by the projected inputs and by the recurrent weights."""
    steps, n, h = d_hidden.shape
    d_inputs, d_recurrent = np.empty((steps, n, 4 * h), np.float32), np.zeros_like(recurrent)
    dh, dc = np.zeros((n, h), np.float32), np.zeros((n, h), np.float32)
    for t in range(steps - 1, -1, -1):
        i, f, o, g = np.split(gates[t], 4, axis=1)
        dh = dh + d_hidden[t]
        tc = np.tanh(cells[t + 1])
        dc = dc + dh * o * (1 - tc * tc)
        dz = np.concatenate([dc * g * i * (1 - i), dc * cells[t] * f * (1 - f), dh * tc * o * (1 - o), dc * i * (1 - g * g)], axis=1)
        d_inputs[t] = dz
        d_recurrent += hidden[t].T @ dz
        dh, dc = dz @ recurrent.T, dc * f
    return d_inputs, d_recurrent


class BiLstmCrf:
    def __init__(self, n_tags: int, embedding: int = 12, hidden: int = 24, seed: int = 0) -> None:
        rng = np.random.default_rng(seed)
        draw = lambda *shape: (rng.standard_normal(shape) / np.sqrt(shape[0])).astype(np.float32)
        self.w = {
            "embed": draw(N_CHARS, embedding) * 3,
            "in_f": draw(embedding, 4 * hidden), "rec_f": draw(hidden, 4 * hidden), "bias_f": np.zeros(4 * hidden, np.float32),
            "in_b": draw(embedding, 4 * hidden), "rec_b": draw(hidden, 4 * hidden), "bias_b": np.zeros(4 * hidden, np.float32),
            "out": draw(2 * hidden, n_tags), "bias": np.zeros(n_tags, np.float32),
            "trans": np.zeros((n_tags, n_tags), np.float32), "first": np.zeros(n_tags, np.float32), "last": np.zeros(n_tags, np.float32),
        }
        for d in "fb":
            self.w[f"bias_{d}"][hidden : 2 * hidden] = 1.0

    def _forward(self, ids: np.ndarray):
        w, chars = self.w, ids.T
        ahead = _lstm((w["embed"] @ w["in_f"] + w["bias_f"])[chars], w["rec_f"])
        back = _lstm((w["embed"] @ w["in_b"] + w["bias_b"])[chars[::-1]], w["rec_b"])
        both = np.concatenate([ahead[0][1:], back[0][1:][::-1]], axis=2)
        return both @ w["out"] + w["bias"], (ahead, back, both)

    def emissions(self, ids: np.ndarray) -> np.ndarray:
        """Tag scores of each character, time first."""
        return self._forward(ids)[0]

    def loss(self, ids: np.ndarray, tags: np.ndarray) -> tuple[float, dict[str, np.ndarray]]:
        """Mean negative log-likelihood of the tags, and its gradients."""
        w = self.w
        scores, (ahead, back, both) = self._forward(ids)
        steps, n, k = scores.shape
        gold = tags.T
        rows = np.arange(n)
        alpha, beta = np.empty_like(scores), np.empty_like(scores)
        alpha[0] = w["first"] + scores[0]
        for t in range(1, steps):
            alpha[t] = scores[t] + _logsumexp(alpha[t - 1][:, :, None] + w["trans"], 1)
        beta[-1] = w["last"]
        for t in range(steps - 2, -1, -1):
            beta[t] = _logsumexp(w["trans"] + (scores[t + 1] + beta[t + 1])[:, None, :], 2)
        norm = _logsumexp(alpha[-1] + w["last"], 1)
        d_scores = np.exp(alpha + beta - norm[:, None])
        d_first, d_last = d_scores[0].sum(0), d_scores[-1].sum(0)
        d_trans = np.zeros_like(w["trans"])
        for t in range(steps - 1):
            d_trans += np.exp(alpha[t][:, :, None] + w["trans"] + (scores[t + 1] + beta[t + 1])[:, None, :] - norm[:, None, None]).sum(0)
        path = w["first"][gold[0]] + w["last"][gold[-1]] + np.take_along_axis(scores, gold[:, :, None], 2).sum((0, 2)) + w["trans"][gold[:-1], gold[1:]].sum(0)
        for t in range(steps):
            d_scores[t, rows, gold[t]] -= 1
        np.add.at(d_first, gold[0], -1)
        np.add.at(d_last, gold[-1], -1)
        np.add.at(d_trans, (gold[:-1].ravel(), gold[1:].ravel()), -1)

        h = w["rec_f"].shape[0]
        flat = d_scores.reshape(-1, k)
        d_both = d_scores @ w["out"].T
        g = {"out": both.reshape(-1, 2 * h).T @ flat, "bias": flat.sum(0), "trans": d_trans, "first": d_first, "last": d_last, "embed": np.zeros_like(w["embed"])}
        chars = ids.T
        for d, run, grad, seen in (("f", ahead, d_both[:, :, :h], chars), ("b", back, d_both[:, :, h:][::-1], chars[::-1])):
            d_in, g[f"rec_{d}"] = _lstm_back(np.ascontiguousarray(grad), *run, w[f"rec_{d}"])
            by_char = np.zeros((N_CHARS, 4 * h), np.float32)
            np.add.at(by_char, seen.ravel(), d_in.reshape(-1, 4 * h))
            g[f"in_{d}"], g[f"bias_{d}"] = w["embed"].T @ by_char, by_char.sum(0)
            g["embed"] += by_char @ w[f"in_{d}"].T
        return float((norm - path).mean()), {name: x / n for name, x in g.items()}

    def fit(self, ids: np.ndarray, tags: np.ndarray, steps: int = 300, batch: int = 64, rate: float = 0.02, seed: int = 0) -> list[float]:
        """Adam with a falling rate; the losses."""
        rng = np.random.default_rng(seed)
        mean = {k: np.zeros_like(v) for k, v in self.w.items()}
        square = {k: np.zeros_like(v) for k, v in self.w.items()}
        losses = []
        for step in range(1, steps + 1):
            pick = rng.integers(0, len(ids), batch)
            loss, grads = self.loss(ids[pick], tags[pick])
            size = float(np.sqrt(sum(float((g * g).sum()) for g in grads.values())))
            now = rate * (1 - (step - 1) / steps) * np.sqrt(1 - 0.99**step) / (1 - 0.9**step)
            for k, g in grads.items():
                g = (g * min(1.0, 5.0 / max(size, 1e-9))).astype(np.float32)
                mean[k] = 0.9 * mean[k] + 0.1 * g
                square[k] = 0.99 * square[k] + 0.01 * g * g
                self.w[k] -= (now * mean[k] / (np.sqrt(square[k]) + 1e-8)).astype(np.float32)
            losses.append(loss)
        return losses

    def decode(self, ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The best tags of each row (Viterbi), and by how much each character's tag beats tag 0."""
        w, scores = self.w, self.emissions(ids)
        steps, n, k = scores.shape
        best, came = w["first"] + scores[0], np.empty((steps, n, k), np.int8)
        for t in range(1, steps):
            options = best[:, :, None] + w["trans"]
            came[t] = options.argmax(1)
            best = options.max(1) + scores[t]
        tag = (best + w["last"]).argmax(1)
        tags, rows = np.empty((steps, n), np.int64), np.arange(n)
        for t in range(steps - 1, -1, -1):
            tags[t] = tag
            tag = came[t, rows, tag] if t else tag
        margin = np.take_along_axis(scores, tags[:, :, None], 2)[:, :, 0] - scores[:, :, 0]
        return tags.T, margin.T
