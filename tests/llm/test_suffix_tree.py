"""The suffix tree against plain dictionaries of contexts."""

import math
import random
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest

from evidentia.llm import suffix_tree as S

from .fixtures import ROWS, documents, sorted_rows

LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def tokens_of(text):
    return [w.decode() for w in (text or "").translate(LOWER).encode().split()] + [None]


def chain_text(seed, n):
    """Words that mostly depend on the one or two before."""
    pick, words = random.Random(seed), ["A", "b"]
    for _ in range(n):
        a, b = words[-2].lower(), words[-1].lower()
        words.append(pick.choice(["c", "d", "E"]) if (a, b) == ("a", "b") else {"c": "a", "d": "f", "e": "g"}.get(b) if b in "cde" and pick.random() < 0.9 else pick.choice("abfgh") if pick.random() < 0.95 else f"rare{pick.randrange(40)}")
    return " ".join(words)


class Plain:
    def __init__(self, texts, depth, p_min, least):
        words = Counter(t for x in texts for t in x)
        self.words, self.tokens, self.distinct = words, sum(words.values()), len(words)
        self.total = self.tokens + 0.1 * (self.distinct + 1)
        need = max(least, math.ceil(p_min * self.tokens))
        self.kept = {}
        for length in range(1, depth + 1):
            nexts = defaultdict(Counter)
            for x in texts:
                for i in range(length, len(x)):
                    nexts[tuple(x[i - length : i])][x[i]] += 1
            new = {}
            for s, own in nexts.items():
                n, d = sum(own.values()), len(own)
                if n < need:
                    continue
                seen = {x: c for x, c in own.items() if c > 1}
                if not seen:
                    continue
                left = d / n
                p = {x: (c - 1) / n + left * self.p(s[1:], x) for x, c in seen.items()}
                gain = sum(q * math.log(q / self.p(s[1:], x)) for x, q in p.items()) + left * math.log(left) * max(0, 1 - sum(self.p(s[1:], x) for x in seen))
                if n * gain >= math.log(self.tokens) / 2 * len(seen):
                    new[s] = (left, p)
            self.kept |= new

    def p(self, s, x):
        """Of x after s, by the longest retained suffix of s."""
        while s and s not in self.kept:
            s = s[1:]
        if not s:
            return (self.words[x] + 0.1) / self.total
        left, own = self.kept[s]
        return own[x] if x in own else left * self.p(s[1:], x)

    def score(self, x, depth):
        return sum(math.log10(self.p(tuple(x[max(0, i - depth) : i]), t)) for i, t in enumerate(x)), sum(math.log10((self.words[t] + 0.1) / self.total) for t in x)


@pytest.mark.parametrize("depth,size", [(1, 1 << 20), (2, 400), (3, 1 << 20)])
def test_scores_match_plain_dictionaries(spark, depth, size):
    rows = ROWS + [(100 + i, chain_text(i, 120), "en") for i in range(60)] + [(120, chain_text(20, 120), "en")]
    found = S.suffix_tree_scores(documents(spark, rows).repartition(3), depth=depth, p_min=0.002, least=8, block_bytes=size)
    held = lambda i: zlib.crc32(("" if i is None else str(i)).encode()) % 10 == 0
    plain = Plain([tokens_of(t) for i, t, _ in rows if not held(i)], depth, 0.002, 8)
    assert {len(s) for s in plain.kept} == set(range(1, depth + 1)) if depth < 3 else {1, 2} <= {len(s) for s in plain.kept}
    want = sorted(((i, held(i), len(x), sum(plain.words[t] > 0 for t in x), plain.tokens, *plain.score(x, depth)[::-1]) for i, x in ((i, tokens_of(t)) for i, t, _ in rows)), key=lambda r: (str(r[0]), r[2]))
    got = sorted((tuple(r) for r in found.collect()), key=lambda r: (str(r[0]), r[2]))
    assert [r[:5] for r in got] == [r[:5] for r in want]
    assert np.allclose([r[5:] for r in got], [r[5:] for r in want], rtol=1e-9)
    assert sum(r[6] for r in got if r[1]) > sum(r[5] for r in got if r[1])


def test_distributions_sum_to_one():
    plain = Plain([tokens_of(chain_text(i, 200)) for i in range(30)], 2, 0.002, 8)
    for s in plain.kept:
        assert sum(plain.p(s, x) for x in plain.words) + plain.p(s, "never seen") == pytest.approx(1)


def test_odd_tables(spark):
    assert S.suffix_tree_scores(documents(spark).limit(0)).collect() == []
    found = sorted_rows(S.suffix_tree_scores(documents(spark, [(None, "a b", "x"), (None, None, "x")])))
    assert found == [(None, True, 1, 0, 0, 0.0, 0.0), (None, True, 3, 0, 0, 0.0, 0.0)]
