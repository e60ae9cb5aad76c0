"""Forced alignment of a token sequence to frames of log probabilities."""

from __future__ import annotations

import numpy as np


def aligned_frames(scores: np.ndarray, tokens: list[int], blank: int = 0) -> list[tuple[int, int]] | None:
    """(first, last) frame of each token on the best path that emits the tokens in order; null if there are too few frames.

    ``scores``: frames by tokens, log probabilities. Viterbi over the tokens with blanks between them: a path
    stays, goes on by one state, or skips a blank between different tokens.
    """
    if not tokens:
        return []
    states = [blank]
    for t in tokens:
        states += [t, blank]
    n, m = len(states), len(scores)
    best = np.full(n, -np.inf)
    back = np.zeros((m, n), dtype=np.int8)
    skip = np.array([i > 1 and states[i] != blank and states[i] != states[i - 2] for i in range(n)])
    for f in range(m):
        if f == 0:
            now = np.full(n, -np.inf)
            now[:2] = 0.0
        else:
            options = np.stack([best, np.concatenate([[-np.inf], best[:-1]]), np.where(skip, np.concatenate([[-np.inf, -np.inf], best[:-2]])[:n], -np.inf)])
            back[f] = options.argmax(0)
            now = options.max(0)
        best = now + scores[f, states]
    at = n - 1 if best[n - 1] >= best[n - 2] else n - 2
    if best[at] == -np.inf:
        return None
    spans: dict[int, list[int]] = {}
    for f in range(m - 1, -1, -1):
        if states[at] != blank:
            spans.setdefault(at, [f, f])[0] = f
        at -= int(back[f, at])
    return [tuple(spans[i]) for i in range(1, n, 2)] if len(spans) == len(tokens) else None
