import math

import numpy as np

from tidemark.operators import density as DE
from tidemark.operators import weights as W


def test_equal_points_are_compared_once(spark, monkeypatch):
    """Copies of a point do not multiply the comparisons, and each row has the density over all rows."""
    points = [(b, float(i % 7), float(i % 3)) for b in (0, 1) for i in range(50 + b)]
    rows = [(f"r{n}", b, x, y) for n, (b, x, y) in enumerate(points * 4)] + [("none", None, 1.0, 1.0)]
    seen, plain = [], DE.tile_stream

    def spy(query, ref, *args, **kw):
        seen.append((query.count(), ref.count()))
        return plain(query, ref, *args, **kw)

    monkeypatch.setattr(DE, "tile_stream", spy)
    df = spark.createDataFrame(rows, "id string, b int, x double, y double").repartition(3)
    got = {r["id"]: r["logpdf"] for r in DE.kde_logpdf(df, df, ["b"], ["x", "y"], "id", bandwidth=1.5).collect()}
    assert all(n <= 43 for pair in seen for n in pair)
    assert len(got) == len(rows) - 1
    for name, b, x, y in rows[:-1]:
        own = [(p - x) ** 2 + (q - y) ** 2 for _, c, p, q in rows if c == b]
        want = math.log(np.mean(np.exp(-np.array(own) / 4.5))) - math.log(2 * math.pi * 2.25)
        assert abs(got[name] - want) < 1e-9


def test_equal_points_of_a_fold_are_evaluated_once(spark, monkeypatch):
    rows = [(f"r{n}", n % 4, float(n % 5), float(n % 2)) for n in range(400)]
    df = spark.createDataFrame(rows, "id string, batch int, x double, y double")
    seen, plain = [], W._sum_over_rows

    def spy(rows, *args):
        seen.append(rows.count())
        return plain(rows, *args)

    monkeypatch.setattr(W, "_sum_over_rows", spy)
    out = W.weight_kliep(df, "batch", ["x", "y"], "id", sigmas=(0.5, 1.0), centres=(10,)).collect()
    assert len(seen) > 1 and max(seen) <= 30  # ten points in three folds
    assert len(out) == 400 and abs(np.mean([r["weight"] for r in out if r["batch"] == 3]) - 1) < 1e-6
