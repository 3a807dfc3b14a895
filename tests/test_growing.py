import numpy as np

from tidemark.operators import chunking as CK


def plain_shuffled(m, x, y, length):
    """Loss on each re-split, one after the other, with stumps grown on the values themselves."""
    out = []
    for i in range(m.perms):
        u = CK.splitmix_uniform(np.arange(len(y)), m.seed + 1000 + i)
        test = np.zeros(len(y), bool)
        for c in (0, 1):
            mine = np.flatnonzero(y == c)
            size = min(max(round(len(mine) * length / len(y)), 1), len(mine) - 1)
            test[mine[np.argsort(u[mine], kind="stable")[:size]]] = True
        out.append(m.loss((x[~test], y[~test]), (x[test], y[test]), 1 + i))
    return np.array(out)


def test_re_splits_at_once_are_those_one_by_one(monkeypatch):
    rng = np.random.default_rng(6)
    m = CK.PermutationChunks(perms=12, bags=20, block=15)
    for n, length in ((30, 15), (45, 15), (23, 8)):
        x = rng.integers(0, 9, (n, 2)).astype(float)
        y = (x[:, 0] + rng.integers(0, 4, n) > 6).astype(int)
        y[:3], y[-3:] = 0, 1
        got = [m.shuffled(x, y, length, held) for held in (1 << 19, 1)]
        with monkeypatch.context() as mp:
            mp.setattr(CK.Stumps, "_ranked", CK.Stumps._grow)
            want = plain_shuffled(m, x, y, length)
        assert (got[0] == want).all() and (got[1] == want).all() and len(set(want)) > 1


def test_stumps_of_all_re_splits_are_grown_together(monkeypatch):
    grown = []
    plain = CK.Stumps._ranked
    monkeypatch.setattr(CK.Stumps, "_ranked", lambda self, *a: grown.append(1) or plain(self, *a))
    m = CK.PermutationChunks(block=15)
    rng = np.random.default_rng(1)
    pairs = [(np.array([float(i % 5), float(rng.integers(9))]), int(i % 3 == 0)) for i in range(30)]
    m.decide(dict(block=pairs[15:], store=pairs[:15], extra={}))
    assert len(grown) <= 3


def test_draws_of_short_chunks_are_made_once(monkeypatch):
    CK._teams.cache_clear()
    made = []
    plain = CK.splitmix_uniform
    monkeypatch.setattr(CK, "splitmix_uniform", lambda *a: made.append(len(a[0])) or plain(*a))
    m = CK.VarianceChunks(block=15)
    rng = np.random.default_rng(1)
    pairs = [(rng.normal(size=2), int(i % 3 == 0)) for i in range(15)]
    probes = [p for p, _ in pairs[:10]]
    a, b = m.spread(pairs, probes), m.spread(pairs, probes)
    assert (a == b).all() and sum(n == 250 * 1000 for n in made) == 1
