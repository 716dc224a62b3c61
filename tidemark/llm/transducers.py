"""Weighted acyclic automata over phrases: count transducers of sorted label rows.

A phrase is a row of positive labels, padded with zeros behind. An automaton accepts all prefixes of its
phrases; the weight of an arc is the number of occurrences of the prefix that ends with it. It is built from
sorted rows in one go: a row adds arcs from where it leaves the row before it. States with one arc are shared
from the last level upwards where label, weight and target agree, as ends of rare phrases mostly do.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np

from tidemark.llm.chunks import gather, join_blobs, pack, split_blobs, unpack


def sort_rows(rows: np.ndarray) -> np.ndarray:
    """The order of the rows, first label first."""
    return np.lexsort(rows.T[::-1])


def summed(rows: np.ndarray, weights: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Sorted distinct rows with the sums of their weights."""
    if not len(rows):
        return rows, weights
    order = sort_rows(rows)
    rows, weights = rows[order], weights[order]
    starts = np.flatnonzero(np.concatenate([[True], (rows[1:] != rows[:-1]).any(axis=1)]))
    return rows[starts], np.add.reduceat(weights, starts)


@dataclass
class Level:
    """The states of a depth: how many arcs each has, and the arcs' labels, weights and target states."""

    degrees: np.ndarray
    labels: np.ndarray
    weights: np.ndarray
    targets: np.ndarray  # -1: nothing follows


class Transducer:
    def __init__(self, levels: list[Level]):
        self.levels = levels

    @classmethod
    def build(cls, rows: np.ndarray, counts: np.ndarray) -> Transducer:
        """From sorted distinct rows and the number of occurrences of each row itself."""
        m, width = rows.shape
        found, fresh = [], np.zeros(m, dtype=bool)
        fresh[:1] = True
        nodes_at = np.zeros(m, dtype=np.int64)  # each row's node of the depth at hand
        for d in range(width):
            if d and m:
                fresh[1:] |= rows[1:, d - 1] != rows[:-1, d - 1]
            node = np.cumsum(fresh) - 1 if d else nodes_at
            leaves = fresh.copy()
            leaves[1:] |= rows[1:, d] != rows[:-1, d]
            starts = np.flatnonzero(leaves)
            has = rows[starts, d] > 0
            weights = np.add.reduceat(counts, starts) if m else counts
            found.append((node[starts][has], rows[starts, d][has], weights[has], starts[has], int(node[-1]) + 1 if m else 0))
        levels: list[Level] = []
        below = None  # state of each node of the depth below, by the row where it begins
        for d in range(width - 1, -1, -1):
            source, labels, weights, starts, nodes = found[d]
            target = np.full(len(labels), -1, dtype=np.int64) if below is None else below[starts]
            degree = np.bincount(source, minlength=nodes)
            first = np.cumsum(degree) - degree
            one = np.flatnonzero(degree == 1)
            arcs = np.stack([labels[first[one]], weights[first[one]], target[first[one]]], axis=1) if len(one) else np.zeros((0, 3), dtype=np.int64)
            single, same = np.unique(arcs, axis=0, return_inverse=True) if len(one) else (arcs, np.zeros(0, dtype=np.int64))
            many = np.flatnonzero(degree > 1)
            state = np.full(nodes, -1, dtype=np.int64)
            state[one], state[many] = same.reshape(-1), len(single) + np.arange(len(many))
            pick = gather(np.arange(len(labels)), first[many], degree[many]) if len(many) else np.zeros(0, dtype=np.int64)
            levels.append(
                Level(
                    np.concatenate([np.ones(len(single), dtype=np.int64), degree[many]]), np.concatenate([single[:, 0], labels[pick]]),
                    np.concatenate([single[:, 1], weights[pick]]), np.concatenate([single[:, 2], target[pick]]),
                )
            )
            if d:  # the node of depth d that begins at a row
                lead = np.zeros(m, dtype=bool)
                lead[:1] = True
                lead[1:] = (rows[1:, :d] != rows[:-1, :d]).any(axis=1)
                below = state[np.cumsum(lead) - 1]
        return cls(levels[::-1])

    def prefixes(self) -> tuple[np.ndarray, np.ndarray]:
        """All accepted prefixes as rows, padded with zeros, and their weights."""
        width = len(self.levels)
        states, paths = np.zeros(1 if self.levels and len(self.levels[0].degrees) else 0, dtype=np.int64), np.zeros((1, 0), dtype=np.int64)
        rows, weights = [], []
        for d, level in enumerate(self.levels):
            live = np.flatnonzero(states >= 0)
            first, degree = np.cumsum(level.degrees) - level.degrees, level.degrees
            own = states[live]
            arcs = gather(np.arange(len(level.labels)), first[own], degree[own]) if len(own) else np.zeros(0, dtype=np.int64)
            paths = np.concatenate([np.repeat(paths[live], degree[own], axis=0), level.labels[arcs][:, None]], axis=1)
            states = level.targets[arcs]
            rows.append(np.pad(paths, ((0, 0), (0, width - d - 1))))
            weights.append(level.weights[arcs])
        return (np.concatenate(rows), np.concatenate(weights)) if rows else (np.zeros((0, 0), dtype=np.int64), np.zeros(0, dtype=np.int64))

    def composed(self, asked: np.ndarray) -> np.ndarray:
        """The weights of ``asked`` rows, zero for those that aren't accepted: all rows go down the automaton together."""
        out = np.zeros(len(asked), dtype=np.int64)
        states = np.full(len(asked), 0 if self.levels and len(self.levels[0].degrees) else -1, dtype=np.int64)
        for d in range(asked.shape[1]):
            need = asked[:, d] > 0
            if d >= len(self.levels):
                states[:] = -1
            out[need & (states < 0)] = 0
            on = np.flatnonzero(need & (states >= 0))
            if not len(on):
                continue
            level, label = self.levels[d], asked[on, d]
            known = np.unique(level.labels)
            width = len(known) + 1
            keys = np.repeat(np.arange(len(level.degrees)), level.degrees) * width + np.searchsorted(known, level.labels)
            order = np.argsort(keys, kind="stable")
            keys = keys[order]
            rank = np.minimum(np.searchsorted(known, label), len(known) - 1)
            want = states[on] * width + np.where(known[rank] == label, rank, len(known))
            at = np.minimum(np.searchsorted(keys, want), len(keys) - 1)
            hit, arc = keys[at] == want, order[at]
            out[on], states[on] = np.where(hit, level.weights[arc], 0), np.where(hit, level.targets[arc], -1)
        return out

    def to_bytes(self) -> bytes:
        return join_blobs([join_blobs([pack(x) for x in (v.degrees, v.labels, v.weights, v.targets)]) for v in self.levels])

    @classmethod
    def from_bytes(cls, data: bytes) -> Transducer:
        return cls([Level(*[unpack(x, np.int64) for x in split_blobs(v)]) for v in split_blobs(data)])


def united(parts: list[Transducer], width: int) -> tuple[np.ndarray, np.ndarray]:
    """The union: sorted prefixes of all automata with the sums of their weights."""
    rows, weights = [np.zeros((0, width), dtype=np.int64)], [np.zeros(0, dtype=np.int64)]
    for p in parts:
        r, w = p.prefixes()
        rows.append(np.pad(r, ((0, 0), (0, width - r.shape[1]))))
        weights.append(w)
    return summed(np.concatenate(rows), np.concatenate(weights))
