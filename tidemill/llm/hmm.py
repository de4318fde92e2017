"""A hidden Markov model of the kinds of lines: prose, list, table or junk."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np

STATES = ["prose", "list", "table", "junk"]
#: Hidden states of each kind of line; kinds are far from uniform (junk is redirects, repetition, noise, code).
VARIANTS = [4, 3, 3, 6]
KIND = np.repeat(np.arange(len(STATES)), VARIANTS)


@dataclass
class LineModel:
    """Log probabilities: of the first state, of transitions, and of each statistic's code in each state."""

    first: np.ndarray
    moves: np.ndarray
    emissions: list[np.ndarray]

    def scores(self, codes: np.ndarray) -> np.ndarray:
        """Log likelihood of each line in each state; statistics count as independent given the state."""
        out = np.zeros((len(codes), len(KIND)))
        for k, table in enumerate(self.emissions):
            out += table[:, codes[:, k]].T
        return out


def _steps(doc: np.ndarray) -> tuple[np.ndarray, list[np.ndarray]]:
    """Positions of lines in their texts, and for each position the lines there; ``doc`` rises."""
    begin = np.ones(doc.size, bool)
    begin[1:] = doc[1:] != doc[:-1]
    at = np.flatnonzero(begin)
    place = np.arange(doc.size) - np.repeat(at, np.diff(np.concatenate([at, [doc.size]])))
    order = np.argsort(place, kind="stable")
    cuts = np.flatnonzero(np.diff(place[order])) + 1
    return place, np.split(order, cuts) if doc.size else []


def _log_sum(x: np.ndarray, axis: int) -> np.ndarray:
    top = x.max(axis=axis, keepdims=True)
    return (top + np.log(np.exp(x - top).sum(axis=axis, keepdims=True))).squeeze(axis)


def posteriors(model: LineModel, doc: np.ndarray, scores: np.ndarray, count_moves: bool = True) -> tuple[np.ndarray, np.ndarray]:
    """(probability of each state of each line, expected moves), by forward and backward passes over all texts at once.

    The passes go line by line, all texts that have so many lines together.
    """
    place, steps = _steps(doc)
    ahead, behind = np.zeros_like(scores), np.zeros_like(scores)
    has_next = np.zeros(doc.size, bool)
    has_next[:-1] = doc[1:] == doc[:-1]
    for t, rows in enumerate(steps):
        ahead[rows] = scores[rows] + (model.first if t == 0 else _log_sum(ahead[rows - 1][:, :, None] + model.moves, 1))
    for rows in reversed(steps):
        some = rows[has_next[rows]]
        behind[some] = _log_sum(model.moves + (scores[some + 1] + behind[some + 1])[:, None, :], 2)
    both = ahead + behind
    mass = _log_sum(both, 1)
    moves = np.zeros((len(KIND), len(KIND)))
    some = np.flatnonzero(has_next & count_moves)
    for part in np.array_split(some, max(1, some.size // 100_000)):
        joint = ahead[part][:, :, None] + model.moves + (scores[part + 1] + behind[part + 1])[:, None, :] - mass[part][:, None, None]
        moves += np.exp(joint).sum(axis=0)
    return np.exp(both - mass[:, None]), moves


def fit(doc: np.ndarray, codes: np.ndarray, chars: np.ndarray, labels: np.ndarray, sizes: list[int], rounds: int = 12, trust: tuple[float, ...] = (0.9999, 0.97, 0.97, 0.999), seed: int = 7) -> LineModel:
    """Fit the model to lines of labelled texts (``labels``: the state of each line's text) by expectation maximisation.

    A text's label makes its own kind ``trust`` (one for each label) likely for each of its lines, and prose has the
    rest, so that a list's prose introduction may be learnt as prose; lines of prose texts are all but surely
    prose, so that no other kind learns the look of wrapped or short prose. The variants of a kind start from random shares per
    text and part as they explain the lines. Lines count by the root of their length.
    """
    k = len(STATES)
    prior = np.full((k, k), 1e-4)
    prior[0] = (1 - trust[0]) / (k - 1)
    prior[1:, 0] = 1 - np.array(trust[1:])
    np.fill_diagonal(prior, trust)
    hint = np.log(prior)[labels][:, KIND]
    draw = np.random.default_rng(seed).dirichlet(np.full(len(KIND), 0.3), int(doc.max()) + 1 if doc.size else 0)[doc] + 1e-3
    share = np.exp(hint) * draw
    share /= share.sum(axis=1, keepdims=True)
    moves = np.ones((len(KIND), len(KIND))) + 20 * np.eye(len(KIND))
    first_rows = np.ones(doc.size, bool)
    first_rows[1:] = doc[1:] != doc[:-1]
    model = None
    for _ in range(rounds):
        counts = share * np.sqrt(chars)[:, None]
        tables = []
        for j, size in enumerate(sizes):
            table = np.stack([np.bincount(codes[:, j], counts[:, s], minlength=size) for s in range(len(KIND))]) + 1.0
            tables.append(np.log(table / table.sum(axis=1, keepdims=True)))
        first = share[first_rows].sum(axis=0) + 0.5
        model = LineModel(np.log(first / first.sum()), np.log(moves / moves.sum(axis=1, keepdims=True)), tables)
        share, seen = posteriors(model, doc, model.scores(codes) + hint)
        moves = seen + 0.5
    return model


def shares(model: LineModel, doc: np.ndarray, codes: np.ndarray, chars: np.ndarray, docs: int) -> np.ndarray:
    """The share of each text's characters that stand in lines of each state; zeros for a text without lines."""
    if not doc.size:
        return np.zeros((docs, len(STATES)))
    likely, _ = posteriors(model, doc, model.scores(codes), count_moves=False)
    sums = np.stack([np.bincount(doc, likely[:, s == KIND].sum(axis=1) * chars, minlength=docs) for s in range(len(STATES))], axis=1)
    return sums / np.maximum(sums.sum(axis=1, keepdims=True), 1e-12)
