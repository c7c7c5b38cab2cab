"""The hidden Markov model of operator 3: numpy code that runs inside tasks."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np

#: Padded tokens of a batch, which bounds the memory of forward and backward values.
BATCH_TOKENS, BATCH_ROWS = 250_000, 1024
#: Times between two scalings of forward values: over so few, emissions relative to their symbol's mean stay in the range of single precision.
SCALED = 4


@dataclass
class Model:
    start: np.ndarray  # (states,)
    move: np.ndarray  # (states, states)
    emit: np.ndarray  # (symbols, states)


def random_model(states: int, unigram: np.ndarray, seed: int = 3) -> Model:
    """Sticky transitions and emissions scattered around the unigram distribution."""
    rng = np.random.default_rng(seed)
    emit = unigram[:, None] * rng.gamma(1.0, 1.0, (len(unigram), states))
    move = np.full((states, states), 0.1 / max(1, states - 1))
    np.fill_diagonal(move, 0.9)
    return Model(np.full(states, 1 / states), move / move.sum(1, keepdims=True), emit / emit.sum(0))


def batches(sequences: list[np.ndarray], tokens: int = BATCH_TOKENS) -> Iterator[np.ndarray]:
    """Index arrays of sequences of similar length, longest first, of at most so many padded tokens (or one sequence)."""
    order = np.argsort([-len(s) for s in sequences], kind="stable")
    at = 0
    while at < len(order):
        longest = max(1, len(sequences[order[at]]))
        rows = max(1, min(BATCH_ROWS, tokens // longest))
        yield order[at : at + rows]
        at += rows


def padded(sequences: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """Symbols by time and row, and the number of rows alive at each time; longest first."""
    lengths = np.array([len(s) for s in sequences])
    out = np.zeros((lengths[0], len(sequences)), np.uint16)
    for i, s in enumerate(sequences):
        out[: len(s), i] = s
    return out, np.searchsorted(-lengths, -np.arange(lengths[0]), side="left")


def relative(model: Model) -> tuple[Model, np.ndarray]:
    """The model with emissions divided by their symbol's mean, and the logarithms of these means."""
    mean = model.emit.mean(1, keepdims=True)
    return Model(model.start, model.move, model.emit / mean), np.log(mean[:, 0].astype(np.float64))


def _forward_block(model: Model, symbols: np.ndarray, alive: np.ndarray, prior: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Forward values, emissions over scales, and scales of a run of times; prior: the states expected at the first.

    Values are scaled at every SCALED-th time, at the last of the run, and at a sequence's own last.
    """
    (long, rows), s, kind = symbols.shape, len(model.start), model.emit.dtype
    a, b, scales = np.zeros((long, rows, s), kind), np.zeros((long, rows, s), kind), np.ones((long, rows), kind)
    ones = np.ones(s, kind)
    for t, n in enumerate(alive):
        x, e = a[t, :n], b[t, :n]
        model.emit.take(symbols[t, :n], axis=0, out=e, mode="clip")
        if t == 0:
            x[:] = prior[:n]
        else:
            np.matmul(a[t - 1, :n], model.move, out=x)
        x *= e
        first = 0 if t % SCALED == SCALED - 1 or t == long - 1 else alive[t + 1]
        if first < n:
            np.matmul(x[first:], ones, out=scales[t, first:n])
            over = np.reciprocal(scales[t, first:n])[:, None]
            x[first:] *= over
            e[first:] *= over
    return a, b, scales


def forward(model: Model, sequences: list[np.ndarray], tokens: int = BATCH_TOKENS) -> np.ndarray:
    """Natural logarithm of each sequence's likelihood, by the scaled forward recursion, in blocks of at most ``tokens``."""
    model, means = relative(model)
    out = np.array([means[x].sum() for x in sequences])
    for index in batches(sequences, tokens):
        symbols, alive = padded([sequences[i] for i in index])
        total, prior = np.zeros(len(index)), np.broadcast_to(model.start, (len(index), len(model.start)))
        block = max(1, tokens // len(index))
        for lo in range(0, len(symbols), block):
            a, _, scales = _forward_block(model, symbols[lo : lo + block], alive[lo : lo + block], prior)
            total += np.log(scales).sum(0)  # 1 where a sequence has ended
            prior = a[-1] @ model.move
        out[index] += total
    return out


def expectations(model: Model, sequences: list[np.ndarray], tokens: int = BATCH_TOKENS) -> tuple[np.ndarray, float]:
    """Baum-Welch counts of starts, moves and emissions in one flat array, and the log likelihood.

    Values within a batch have the model's precision; sums over batches are doubles. A sequence
    of more than ``tokens`` is taken in blocks of times: the states expected at each block's
    start are kept from a first pass, and the blocks are run again from the last to the first,
    so memory does not grow with a sequence's length beyond its symbols.
    """
    s, m = len(model.start), len(model.emit)
    kind = model.emit.dtype
    model, means = relative(model)
    starts, moves, emits, total = np.zeros(s), np.zeros((s, s)), np.zeros((m, s)), 0.0
    back = np.ascontiguousarray(model.move.T)
    for index in batches([x for x in sequences if len(x)], tokens):
        symbols, alive = padded([sequences[i] for i in index])
        long, rows = symbols.shape
        block = max(1, tokens // rows)
        priors = [np.broadcast_to(model.start, (rows, s))]
        for lo in range(0, long - block, block):
            a = _forward_block(model, symbols[lo : lo + block], alive[lo : lo + block], priors[-1])[0]
            priors.append(a[-1] @ model.move)
        after, following = np.ones((rows, s), kind), None
        for lo, prior in reversed(list(zip(range(0, long, block), priors, strict=True))):
            seen, there = symbols[lo : lo + block], alive[lo : lo + block]
            a, b, scales = _forward_block(model, seen, there, prior)
            total += float(np.log(scales.astype(np.float64)).sum())
            gamma = np.zeros_like(a)
            for t in range(len(seen) - 1, -1, -1):  # b becomes what both counts need: emission over scale times the backward value
                n = there[t]
                np.multiply(a[t, :n], after[:n], out=gamma[t, :n])
                b[t, :n] *= after[:n]
                np.matmul(b[t, :n], back, out=after[:n])
            moves += a[:-1].reshape(-1, s).T @ b[1:].reshape(-1, s) * model.move
            if following is not None:
                moves += a[-1].T @ following * model.move
            following = b[0].copy()
            if lo == 0:
                starts += gamma[0].sum(0)
            live = np.flatnonzero(np.arange(rows)[None, :] < there[:, None])
            flat = seen.ravel()[live]
            total += float(means[flat].sum())
            order = np.argsort(flat, kind="stable")  # two-byte numbers are sorted by their bytes
            flat, weight = flat[order], gamma.reshape(-1, s).take(live[order], axis=0)
            first = np.flatnonzero(np.append(True, flat[1:] != flat[:-1]))
            emits[flat[first]] += np.add.reduceat(weight, first, axis=0)
    return np.concatenate([starts, moves.ravel(), emits.T.ravel()]), total


def single(model: Model) -> Model:
    """The model in single precision, which suffices for counts."""
    return Model(*(np.ascontiguousarray(x, np.float32) for x in (model.start, model.move, model.emit)))


def maximised(counts: np.ndarray, states: int, unigram: np.ndarray, prior: float) -> Model:
    """The model of these counts, emissions drawn towards the unigram distribution by ``prior`` tokens."""
    start = counts[:states] + 0.1
    move = counts[states : states + states * states].reshape(states, states) + 0.1
    emit = counts[states + states * states :].reshape(states, -1) + prior * unigram
    return Model(start / start.sum(), move / move.sum(1, keepdims=True), np.ascontiguousarray((emit / emit.sum(1, keepdims=True)).T))
