"""Kernels and the number of links by expected F0.5 against plain reference code on random strings."""

import random
from itertools import product

import numpy as np
import pytest

from weftlink.functions import kernels as K
from weftlink.operators.decide import _best_count


def lcs(a, b):
    row = [0] * (len(b) + 1)
    for x in a:
        last = 0
        for j, y in enumerate(b):
            last, row[j + 1] = row[j + 1], last + 1 if x == y else max(row[j + 1], row[j])
    return row[-1]


def ratio(a, b):
    return 200 * lcs(a, b) / (len(a) + len(b)) if a or b else 100


def partial(a, b):
    if len(a) > len(b):
        a, b = b, a
    if not a:
        return 0 if b else 100

    def best(s, t):
        m, n = len(s), len(t)
        spans = {(max(0, i), min(n, i + m)) for i in range(-m + 1, n)}
        return max(ratio(s, t[x:y]) for x, y in spans)

    return max(best(a, b), best(b, a)) if len(a) == len(b) else best(a, b)


def token_set(a, b):
    x, y = set(a.split()), set(b.split())
    if not x or not y:
        return 0
    j = lambda w: " ".join(sorted(w))
    if x & y and (not x - y or not y - x):
        return 100
    one, two = (j(x & y) + " " + j(x - y)).strip(), (j(x & y) + " " + j(y - x)).strip()
    return max([ratio(one, two)] + ([ratio(j(x & y), one), ratio(j(x & y), two)] if x & y else []))


def jaro_winkler(a, b):
    if not a or not b:
        return float(a == b)
    reach, used, hits = max(0, max(len(a), len(b)) // 2 - 1), set(), []
    for i, c in enumerate(a):
        j = next((j for j in range(len(b)) if abs(i - j) <= reach and j not in used and b[j] == c), None)
        if j is not None:
            used.add(j)
            hits.append(c)
    if not hits:
        return 0.0
    m, turns = len(hits), sum(c != b[j] for c, j in zip(hits, sorted(used))) // 2
    out = (m / len(a) + m / len(b) + (m - turns) / m) / 3
    prefix = next((k for k in range(4) if k >= min(len(a), len(b)) or a[k] != b[k]), 4)
    return out + prefix * 0.1 * (1 - out) if out > 0.7 else out


@pytest.fixture(scope="module")
def pairs():
    r = random.Random(2)
    word = lambda: "".join(r.choice("abcdé中😀") for _ in range(r.randint(0, 6)))
    out = [("", ""), ("", "a"), ("a", ""), ("abc", "abc"), ("kitten", "sitting"), ("martha", "marhta"), ("a b c", "c b a d")]
    for _ in range(500):
        a = " ".join(word() for _ in range(r.randint(0, 5)))
        b = "".join(c for c in a if r.random() < 0.8) if r.random() < 0.5 else " ".join(word() for _ in range(r.randint(0, 5)))
        out.append((a, b))
    long = lambda: "".join(r.choice("abcdefgh ") for _ in range(r.choice([60, 63, 64, 65, 127, 128, 129, 300])))
    return out + [(long(), long()) for _ in range(25)]


@pytest.mark.parametrize("batch, one", [(K.ratios, ratio), (K.partial_ratios, partial), (K.token_set_ratios, token_set), (K.jaro_winklers, jaro_winkler)])
def test_batches_against_reference(pairs, batch, one):
    use = [p for p in pairs if len(p[0]) < 70] if one is partial else pairs
    got = batch([a for a, _ in use], [b for _, b in use])
    assert got.tolist() == pytest.approx([one(a, b) for a, b in use], abs=1e-9)
    assert len(batch([], [])) == 0


def test_token_sort():
    assert K.token_sort_ratios(["b a", "x", ""], ["a b", "y", ""]).tolist() == [100, 0, 100]


def test_expected_f_keeps_nothing_of_an_unlikely_candidate():
    assert _best_count(np.array([0.2]), 0.0) == 0
    assert _best_count(np.array([0.9]), 0.0) == 1
    assert _best_count(np.array([0.9, 0.1]), 0.0) == 1
    assert _best_count(np.array([0.95, 0.9]), 0.1) == 2


def test_expected_f_over_all_worlds():
    """Every world of up to eight candidates and some links elsewhere, by enumeration."""
    r = np.random.default_rng(1)
    for _ in range(60):
        p, lam = np.sort(r.random(r.integers(1, 8)))[::-1], float(r.choice([0.0, 0.1, 0.8]))
        elsewhere = [np.exp(-lam) * lam**k / np.prod(np.arange(1, k + 1)) if lam else float(k == 0) for k in range(14)]
        value = np.zeros(len(p) + 1)
        for world in product((0, 1), repeat=len(p)):
            chance = np.prod([x if w else 1 - x for x, w in zip(p, world)])
            for more, q in enumerate(elsewhere):
                n_true = sum(world) + more
                for k in range(len(p) + 1):
                    tp = sum(world[:k])
                    value[k] += chance * q * (1.0 if n_true == 0 and k == 0 else 1.25 * tp / (1.25 * tp + 0.25 * (n_true - tp) + k - tp) if tp else 0.0)
        assert value[_best_count(p, lam)] == pytest.approx(value.max(), abs=1e-9)
