"""A linear-chain conditional random field in numpy, trained by gradient ascent and decoded by Viterbi."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np

NEVER = -1e9


@dataclass
class Chain:
    """Weights: a row per feature, a column per label; labels in BIO form, O first."""

    labels: list[str]
    features: dict[str, int]
    emit: np.ndarray
    move: np.ndarray
    begin: np.ndarray

    def scores(self, words: list[list[str]]) -> np.ndarray:
        """Emission scores of words given by their features; unknown features count nothing."""
        found = [[self.features[f] for f in w if f in self.features] for w in words]
        sizes = np.asarray([len(x) for x in found])
        flat = self.emit[np.asarray([i for x in found for i in x], np.int64)] if sizes.sum() else np.zeros((0, len(self.labels)))
        out = np.zeros((len(words), len(self.labels)))
        np.add.at(out, np.repeat(np.arange(len(words)), sizes), flat)
        return out

    def viterbi(self, scores: np.ndarray, lengths: np.ndarray) -> np.ndarray:
        """The best label of each word; sequences stand end to end and are decoded together, step by step."""
        order = np.argsort(-lengths, kind="stable")
        start = (np.cumsum(lengths) - lengths)[order]
        size = lengths[order]
        best = np.zeros(len(scores), np.int64)
        if not len(scores):
            return best
        back = np.zeros(scores.shape, np.int16)
        steps = int(size[0])
        alive = [int(np.searchsorted(-size, -t, "left")) for t in range(steps + 1)]  # sequences longer than t
        v = self.begin + scores[start[: alive[0]]]
        last = np.empty((len(size), len(self.labels)))
        for t in range(1, steps + 1):
            n = alive[t] if t < steps else 0
            last[n : len(v)] = v[n:]
            if not n:
                break
            ways = v[:n, :, None] + self.move
            back[start[:n] + t] = ways.argmax(axis=1)
            v = ways.max(axis=1) + scores[start[:n] + t]
        now = last.argmax(axis=1)
        for t in range(steps - 1, -1, -1):
            n = alive[t]
            best[start[:n] + t] = now[:n]
            now[:n] = back[start[:n] + t, now[:n]]
        return best


def _lse(x: np.ndarray, axis: int) -> np.ndarray:
    m = x.max(axis=axis, keepdims=True)
    return np.squeeze(m, axis) + np.log(np.exp(x - m).sum(axis=axis))


def train(table: list[tuple[list[list[str]], list[str]]], kinds: list[str], rounds: int = 150, rate: float = 0.5, l2: float = 0.01) -> Chain:
    """A chain from (features of each word, label of each word) sequences; full-batch, so the result is fixed.

    No move is barred while it is trained, so that labels inside a span are told
    from O by their words too; the chain it gives bars an I- that no span begins.
    """
    labels = ["O"] + [f"{p}-{k}" for k in kinds for p in "BI"]
    features = {f: i for i, f in enumerate(sorted({f for words, _ in table for w in words for f in w}))}
    n, steps, size = len(table), max(len(y) for _, y in table), len(labels)
    allowed = np.asarray([[not b.startswith("I-") or a[2:] == b[2:] for b in labels] for a in labels])
    wall = np.where(allowed, 0, NEVER)
    first = np.asarray([NEVER if b.startswith("I-") else 0.0 for b in labels])
    y = np.zeros((n, steps), np.int64)
    real = np.zeros((n, steps), bool)
    rows, cols = [], []
    for s, (words, tags) in enumerate(table):
        real[s, : len(tags)] = True
        y[s, : len(tags)] = [labels.index(t) for t in tags]
        for t, w in enumerate(words):
            rows += [s * steps + t] * len(w)
            cols += [features[f] for f in w]
    rows, cols = np.asarray(rows), np.asarray(cols)
    emit, move = np.zeros((len(features), size)), np.zeros((size, size))
    g_emit, g_move = np.zeros_like(emit), np.zeros_like(move)  # Adagrad
    gold = np.zeros((n, steps, size))
    gold[np.arange(n)[:, None], np.arange(steps), y] = real
    gold_move = np.zeros((size, size))
    np.add.at(gold_move, (y[:, :-1][real[:, 1:]], y[:, 1:][real[:, 1:]]), 1)
    for _ in range(rounds):
        sc = np.zeros((n * steps, size))
        np.add.at(sc, rows, emit[cols])
        sc = sc.reshape(n, steps, size)
        m = move
        fwd, bwd = np.zeros_like(sc), np.zeros_like(sc)
        fwd[:, 0] = sc[:, 0]
        for t in range(1, steps):
            fwd[:, t] = np.where(real[:, t, None], _lse(fwd[:, t - 1, :, None] + m, 1) + sc[:, t], fwd[:, t - 1])
        for t in range(steps - 2, -1, -1):
            bwd[:, t] = np.where(real[:, t + 1, None], _lse(m + (sc[:, t + 1] + bwd[:, t + 1])[:, None, :], 2), bwd[:, t + 1])
        z = _lse(fwd[:, -1], 1)
        p = np.exp(fwd + bwd - z[:, None, None]) * real[:, :, None]
        pair = np.exp(fwd[:, :-1, :, None] + m + (sc[:, 1:] + bwd[:, 1:])[:, :, None, :] - z[:, None, None, None]) * real[:, 1:, None, None]
        d = (gold - p).reshape(-1, size)
        ge = np.zeros_like(emit)
        np.add.at(ge, cols, d[rows])
        ge -= l2 * emit
        gm = gold_move - pair.sum(axis=(0, 1)) - l2 * move
        g_emit += ge**2
        g_move += gm**2
        emit += rate * ge / (np.sqrt(g_emit) + 1e-8)
        move += rate * gm / (np.sqrt(g_move) + 1e-8)
    return Chain(labels, features, emit, move + wall, first)
