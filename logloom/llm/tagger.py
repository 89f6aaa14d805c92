"""A character-level bidirectional LSTM with CRF transitions, in numpy.

Rows are windows of character classes. Both directions run as one stack of matrices; a window's padding
neither moves a state nor has a label. Training follows the gradient of the CRF's log likelihood through
time (Adam, fixed seed, so that equal windows give equal weights).
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np

Weights = dict[str, np.ndarray]
NEVER = -1e4  # score of transitions that can't be
HIDDEN = 16
CLIP = 5.0


def initial(classes: int, labels: int, hidden: int = HIDDEN, seed: int = 0) -> Weights:
    rng = np.random.default_rng(seed)
    bias = np.zeros((2, 1, 4 * hidden))
    bias[:, :, hidden : 2 * hidden] = 1.0  # states are kept at first
    return {
        "wx": rng.normal(0, 0.3, (2, classes, 4 * hidden)),
        "wh": rng.normal(0, 1 / hidden**0.5, (2, hidden, 4 * hidden)),
        "b": bias,
        "wo": rng.normal(0, 0.3, (2 * hidden, labels)),
        "bo": np.zeros(labels),
        "steps": np.zeros((labels, labels)),
        "first": np.zeros(labels),
    }


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 0.5 + 0.5 * np.tanh(0.5 * x)


def _both_ways(rows: np.ndarray, lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The windows forwards and backwards, and the places that turn a window around."""
    at = np.arange(rows.shape[1])
    turned = np.where(at < lengths[:, None], lengths[:, None] - 1 - at, at)
    return np.stack([rows, np.take_along_axis(rows, turned, 1)]), turned


def states(weights: Weights, rows: np.ndarray, lengths: np.ndarray, kept: list | None = None) -> np.ndarray:
    """Hidden states of both directions at each place; ``kept`` takes what the gradient needs."""
    both, turned = _both_ways(rows, lengths)
    size = weights["wh"].shape[1]
    n, width = rows.shape
    h, c = np.zeros((2, n, size), weights["wh"].dtype), np.zeros((2, n, size), weights["wh"].dtype)
    out = np.empty((2, n, width, size), weights["wh"].dtype)
    way = np.arange(2)[:, None]
    for t in range(width):
        z = weights["wx"][way, both[:, :, t]] + h @ weights["wh"] + weights["b"]
        gates = _sigmoid(z[..., : 3 * size])
        i, f, o = gates[..., :size], gates[..., size : 2 * size], gates[..., 2 * size :]
        g = np.tanh(z[..., 3 * size :])
        new = f * c + i * g
        tanh = np.tanh(new)
        on = (t < lengths)[None, :, None]
        if kept is not None:
            kept.append((h, c, i, f, o, g, tanh, on))
        c, h = np.where(on, new, c), np.where(on, o * tanh, h)
        out[:, :, t] = h
    back = np.take_along_axis(out[1], turned[:, :, None], 1)
    return np.concatenate([out[0], back], 2)


def emissions(weights: Weights, rows: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    return states(weights, rows, lengths) @ weights["wo"] + weights["bo"]


def _log_sum(x: np.ndarray, axis: int) -> np.ndarray:
    top = x.max(axis, keepdims=True)
    return (top + np.log(np.exp(x - top).sum(axis, keepdims=True))).squeeze(axis)


def crf_gradient(scores: np.ndarray, labels: np.ndarray, lengths: np.ndarray, steps: np.ndarray, first: np.ndarray):
    """Log loss of the gold labels, and its gradient by scores, steps and first labels."""
    n, width, size = scores.shape
    rows = np.arange(n)
    alpha = np.empty_like(scores)
    alpha[:, 0] = first + scores[:, 0]
    for t in range(1, width):
        new = _log_sum(alpha[:, t - 1, :, None] + steps, 1) + scores[:, t]
        alpha[:, t] = np.where((t < lengths)[:, None], new, alpha[:, t - 1])
    total = _log_sum(alpha[:, -1], 1)
    beta = np.zeros_like(scores)
    for t in range(width - 2, -1, -1):
        new = _log_sum(steps + (scores[:, t + 1] + beta[:, t + 1])[:, None, :], 2)
        beta[:, t] = np.where((t + 1 < lengths)[:, None], new, 0.0)
    inside = np.arange(width) < lengths[:, None]
    by_scores = np.exp(alpha + beta - total[:, None, None]) * inside[:, :, None]
    by_steps = np.zeros_like(steps)
    gold = first[labels[:, 0]] + scores[rows, 0, labels[:, 0]]
    for t in range(1, width):
        on = t < lengths
        if not on.any():
            break
        pair = alpha[on, t - 1, :, None] + steps + (scores[on, t] + beta[on, t])[:, None, :] - total[on, None, None]
        by_steps += np.exp(pair).sum(0)
        np.subtract.at(by_steps, (labels[on, t - 1], labels[on, t]), 1.0)
        gold[on] += steps[labels[on, t - 1], labels[on, t]] + scores[on, t, labels[on, t]]
    by_first = by_scores[:, 0].sum(0)
    np.subtract.at(by_first, labels[:, 0], 1.0)
    at_row, at_place = np.nonzero(inside)
    by_scores[at_row, at_place, labels[at_row, at_place]] -= 1.0
    return float((total - gold).sum()), by_scores, by_steps, by_first


def gradient(weights: Weights, rows: np.ndarray, lengths: np.ndarray, labels: np.ndarray, allowed: np.ndarray) -> tuple[float, Weights]:
    """Mean log loss of the windows and its gradient."""
    kept: list = []
    h = states(weights, rows, lengths, kept)
    scores = h @ weights["wo"] + weights["bo"]
    steps = np.where(allowed, weights["steps"], NEVER)
    first = np.where(allowed[0], weights["first"], NEVER)  # a window begins as if after no span
    loss, by_scores, by_steps, by_first = crf_gradient(scores, labels, lengths, steps, first)
    n, width = rows.shape
    size = weights["wh"].shape[1]
    found = {
        "wo": np.einsum("nth,ntl->hl", h, by_scores),
        "bo": by_scores.sum((0, 1)),
        "steps": np.where(allowed, by_steps, 0.0),
        "first": np.where(allowed[0], by_first, 0.0),
        "wx": np.zeros_like(weights["wx"]),
        "wh": np.zeros_like(weights["wh"]),
        "b": np.zeros_like(weights["b"]),
    }
    by_h = by_scores @ weights["wo"].T
    both, turned = _both_ways(rows, lengths)
    outer = np.stack([by_h[:, :, :size], np.take_along_axis(by_h[:, :, size:], turned[:, :, None], 1)])
    dh, dc = np.zeros((2, n, size)), np.zeros((2, n, size))
    ones = np.eye(weights["wx"].shape[1])
    for t in range(width - 1, -1, -1):
        before, cell, i, f, o, g, tanh, on = kept[t]
        total = dh + outer[:, :, t]
        down = np.where(on, total, 0.0)
        through = np.where(on, dc, 0.0) + down * o * (1 - tanh**2)
        dz = np.concatenate([through * g * i * (1 - i), through * cell * f * (1 - f), down * tanh * o * (1 - o), through * i * (1 - g**2)], 2)
        found["wx"] += ones[both[:, :, t]].transpose(0, 2, 1) @ dz
        found["wh"] += before.transpose(0, 2, 1) @ dz
        found["b"] += dz.sum(1, keepdims=True)
        dh = np.where(on, dz @ weights["wh"].transpose(0, 2, 1), total)
        dc = np.where(on, through * f, dc)
    return loss / n, {k: v / n for k, v in found.items()}


def train(
    rows: np.ndarray, lengths: np.ndarray, labels: np.ndarray, classes: int, allowed: np.ndarray, updates: int, rate: float = 0.02, batch: int = 128, seed: int = 0
) -> Weights:
    """Weights fitted to windows and their labels; ``allowed[a, b]`` says whether label b may follow a."""
    weights = initial(classes, len(allowed), seed=seed)
    rng = np.random.default_rng(seed)
    slow, square = ({k: np.zeros_like(v) for k, v in weights.items()} for _ in range(2))
    order = np.zeros(0, np.int64)
    for step in range(1, updates + 1):
        if len(order) < min(batch, len(rows)):
            order = np.concatenate([order, rng.permutation(len(rows))])
        chosen, order = order[:batch], order[batch:]
        _, found = gradient(weights, rows[chosen], lengths[chosen], labels[chosen], allowed)
        norm = sum(float((g**2).sum()) for g in found.values()) ** 0.5
        pace = rate * (1 - 0.9 * step / updates)
        for name, g in found.items():
            g = g * min(1.0, CLIP / (norm + 1e-12))
            slow[name] = 0.9 * slow[name] + 0.1 * g
            square[name] = 0.999 * square[name] + 0.001 * g**2
            weights[name] = weights[name] - pace * (slow[name] / (1 - 0.9**step)) / (np.sqrt(square[name] / (1 - 0.999**step)) + 1e-8)
    weights["steps"] = np.where(allowed, weights["steps"], NEVER)
    weights["first"] = np.where(allowed[0], weights["first"], NEVER)
    return {k: v.astype(np.float32) for k, v in weights.items()}


def decode(weights: Weights, rows: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """The best labels of each window (Viterbi); 0 behind its end."""
    scores = emissions(weights, rows, lengths)
    n, width, size = scores.shape
    best = weights["first"] + scores[:, 0]
    came = np.zeros((n, width, size), np.int8)
    for t in range(1, width):
        options = best[:, :, None] + weights["steps"]
        came[:, t] = options.argmax(1)
        new = np.take_along_axis(options, came[:, t][:, None, :].astype(np.int64), 1)[:, 0] + scores[:, t]
        best = np.where((t < lengths)[:, None], new, best)
    found = np.zeros((n, width), np.int64)
    label = best.argmax(1)
    for t in range(width - 1, -1, -1):
        on = t < lengths
        found[on, t] = label[on]
        if t:
            label = np.where(on, came[np.arange(n), t, label], label)
    return found


def runs(labels: np.ndarray) -> Iterator[tuple[int, int, int, int]]:
    """(row, kind, start, end) of the spans in rows of labels: 0 outside, 2k + 1 the first character of kind k, 2k + 2 the next ones."""
    for row in np.flatnonzero(labels.any(1)):
        own = labels[row]
        first = np.flatnonzero(own % 2 == 1)
        for start in first.tolist():
            inside = own[start + 1 :] == own[start] + 1
            length = len(inside) if inside.all() else int(inside.argmin())
            yield int(row), int(own[start]) // 2, start, start + 1 + length
