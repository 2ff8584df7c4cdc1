"""Where the pieces of a vocabulary stand in many words at once."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np


class Pieces:
    """A trie of the pieces as arrays: a step takes many states and bytes at a time."""

    def __init__(self, ids: dict[bytes, int]):
        states: dict[bytes, int] = {b"": 0}
        for piece in ids:
            for k in range(1, len(piece) + 1):
                states.setdefault(piece[:k], len(states))
        self.longest = max(map(len, ids), default=0)
        self.id_of = np.full(len(states), -1, np.int32)
        for piece, number in ids.items():
            self.id_of[states[piece]] = number
        steps = sorted((states[prefix[:-1]] << 8 | prefix[-1], state) for prefix, state in states.items() if prefix)
        self.keys = np.array([k for k, _ in steps], np.int64)
        self.targets = np.array([t for _, t in steps], np.int32)
        #: The first two steps by table, as most positions take no more.
        self.first = np.full(256, -1, np.int32)
        self.second = np.full(1 << 16, -1, np.int32)
        for prefix, state in states.items():
            if len(prefix) == 1:
                self.first[prefix[0]] = state
            elif len(prefix) == 2:
                self.second[prefix[0] << 8 | prefix[1]] = state

    def step(self, states: np.ndarray, codes: np.ndarray) -> np.ndarray:
        """The states after one more byte; -1 where no piece goes on."""
        wanted = states.astype(np.int64) << 8 | codes
        at = np.searchsorted(self.keys, wanted)
        at[at == len(self.keys)] = 0
        return np.where(self.keys[at] == wanted, self.targets[at], -1)


class Layout:
    """Words side by side, the longest first: the bytes at one place of all words stand together.

    ``order`` names the word of each rank; ``width[j]`` is the number of words longer than j, which are
    the first ranks; byte j of rank r is at ``base[j] + r``.
    """

    def __init__(self, words: list[bytes]):
        sizes = np.fromiter(map(len, words), np.int64, len(words))
        self.order = np.argsort(-sizes, kind="stable")
        self.sizes = sizes[self.order]
        longest = int(self.sizes[0]) if len(words) else 0
        self.width = np.searchsorted(-self.sizes, -np.arange(longest), side="left") if longest else np.zeros(0, np.int64)
        self.base = np.concatenate([[0], np.cumsum(self.width)])
        raw = np.frombuffer(b"".join(words), np.uint8)
        start = (np.cumsum(sizes) - sizes)[self.order]
        self.codes = np.concatenate([raw[start[:n] + j] for j, n in enumerate(self.width)]) if longest else raw

    def matches(self, pieces: Pieces) -> Iterator[tuple[int, np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
        """(length, positions, places, ranks, ids) of the pieces of each length, by rising position of their first byte."""
        place = np.repeat(np.arange(len(self.width)), self.width)
        rank = np.arange(len(place)) - self.base[place]
        at = np.arange(len(place))
        state = pieces.first[self.codes]
        codes = self.codes.astype(np.int64)
        for length in range(1, pieces.longest + 1):
            if length > 1:
                end = place[at] + length - 1
                inside = end < len(self.width)
                inside[inside] = rank[at[inside]] < self.width[end[inside]]
                at, state, end = at[inside], state[inside], end[inside]
                code = codes[self.base[end] + rank[at]]
                state = pieces.second[codes[at] << 8 | code] if length == 2 else pieces.step(state, code)
            there = state >= 0
            at, state = at[there], state[there]
            if not len(at):
                return
            found = pieces.id_of[state]
            whole = found >= 0
            yield length, at[whole], place[at[whole]], rank[at[whole]], found[whole]


def greedy(words: list[bytes], pieces: Pieces) -> tuple[np.ndarray, np.ndarray]:
    """(word, piece id) of the longest-first segmentations; a byte that begins no piece is passed over."""
    laid = Layout(words)
    size, best = np.ones(len(laid.codes), np.int64), np.full(len(laid.codes), -1, np.int64)
    for length, at, _, _, ids in laid.matches(pieces):
        size[at], best[at] = length, ids
    ranks, now = np.arange(len(words)), np.zeros(len(words), np.int64)
    owners, found = [], []
    while True:
        going = now[ranks] < laid.sizes[ranks]
        ranks = ranks[going]
        if not len(ranks):
            break
        at = laid.base[now[ranks]] + ranks
        owners.append(ranks)
        found.append(best[at])
        now[ranks] += size[at]
    if not owners:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    owner, ids = laid.order[np.concatenate(owners)], np.concatenate(found)
    return owner[ids >= 0], ids[ids >= 0]


def forward(words: list[bytes], pieces: Pieces, probabilities: np.ndarray) -> np.ndarray:
    """(words x languages): log of the sum over all segmentations of the product of piece probabilities.

    All words advance a byte at a time. The sums are kept as logs, and taken relative to the byte before,
    so that long words stay inside the range of floats.
    """
    laid = Layout(words)
    places = len(laid.width)
    ends = [(length, place + length, rank, ids) for length, _, place, rank, ids in laid.matches(pieces)]
    cuts = [np.searchsorted(end, np.arange(places + 2)) for _, end, _, _ in ends]
    logs = [np.zeros((len(words), probabilities.shape[1]))]
    out = np.zeros((len(words), probabilities.shape[1]))
    for j in range(1, places + 1):
        n = laid.width[j - 1]
        last = logs[j - 1][:n]
        here = np.zeros((n, probabilities.shape[1]))
        for (length, _, rank, ids), cut in zip(ends, cuts, strict=True):
            if length <= j and cut[j] < cut[j + 1]:
                own = rank[cut[j] : cut[j + 1]]
                gained = probabilities[ids[cut[j] : cut[j + 1]]]
                here[own] += gained * np.exp(logs[j - length][own] - last[own]) if length > 1 else gained
        logs.append(last + np.log(np.maximum(here, 1e-300)))
        if j > pieces.longest:
            logs[j - pieces.longest - 1] = None
        done = laid.width[j] if j < places else 0
        out[laid.order[done:n]] = logs[j][done:n]
    return out
