"""Numpy kernels of a hidden Markov model over many symbol sequences at once.

Sequences of a batch are sorted by falling length, so the ones still running at step t are the first rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np

#: Positions that one batch may hold.
BATCH = 1 << 17


def batches(seqs: list[np.ndarray], most: int = BATCH) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """(rows of seqs, symbols by step and row, how many rows run at each step)."""
    order = sorted(range(len(seqs)), key=lambda i: -len(seqs[i]))
    at = 0
    while at < len(order):
        longest = len(seqs[order[at]])
        part = order[at : at + max(1, min(512, most // max(1, longest)))]
        sym = np.zeros((longest, len(part)), np.int32)
        for j, i in enumerate(part):
            sym[: len(seqs[i]), j] = seqs[i]
        lengths = np.array([len(seqs[i]) for i in part])
        running = np.searchsorted(-lengths, -np.arange(longest), side="left")
        yield np.array(part), sym, running
        at += len(part)


def log_likelihood(seqs: list[np.ndarray], start: np.ndarray, move: np.ndarray, emit: np.ndarray) -> np.ndarray:
    """Natural log probability of each sequence, by the scaled forward recursion in double precision. emit: symbols by states."""
    out = np.zeros(len(seqs))
    for rows, sym, running in batches(seqs):
        log, a = np.zeros(len(rows)), None
        for t, n in enumerate(running):
            a = (np.broadcast_to(start, (n, len(start))) if t == 0 else a[:n] @ move) * emit[sym[t, :n]]
            c = a.sum(1)
            a = a / c[:, None]
            log[:n] += np.log(c)
        out[rows] = log
    return out


def expected_counts(seqs: list[np.ndarray], start: np.ndarray, move: np.ndarray, emit: np.ndarray):
    """Baum-Welch: expected starts, moves and emissions summed over the sequences, and their log likelihood."""
    k = len(start)
    start, move, emit = start.astype(np.float32), move.astype(np.float32), emit.astype(np.float32)
    got_start, got_move, got_emit, log = np.zeros(k), np.zeros((k, k)), np.zeros(emit.size), 0.0
    for _, sym, running in batches(seqs):
        steps, width = sym.shape
        alpha, scale = np.zeros((steps, width, k), np.float32), np.ones((steps, width), np.float32)
        a = None
        for t, n in enumerate(running):
            a = (np.broadcast_to(start, (n, k)) if t == 0 else a[:n] @ move) * emit[sym[t, :n]]
            c = a.sum(1)
            a = a / c[:, None]
            alpha[t, :n], scale[t, :n] = a, c
        log += float(np.log(scale.astype(float)).sum())
        beta, back = np.ones((width, k), np.float32), np.ascontiguousarray(move.T)
        xi = np.zeros((k, k), np.float32)
        for t in range(steps - 2, -1, -1):
            n = running[t + 1]
            ahead = emit[sym[t + 1, :n]] * beta[:n] / scale[t + 1, :n, None]
            xi += alpha[t, :n].T @ ahead
            alpha[t + 1, :n] *= beta[:n]  # from here on it holds the state shares
            beta[:n] = ahead @ back
            if t % 512 == 0:
                got_move += xi
                xi[:] = 0
        alpha[0] *= beta
        got_move += xi
        got_start += alpha[0].sum(0)
        on = np.arange(width)[None, :] < running[:, None]
        cell = sym[on][:, None] * k + np.arange(k)
        got_emit += np.bincount(cell.ravel(), alpha[on].ravel().astype(float), emit.size)
    return got_start, got_move * move, got_emit.reshape(emit.shape), log
