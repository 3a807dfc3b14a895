"""Trees grown along a stream, for classes and numbers, with SQL that grows them level by level."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidemark import registry as RG
from tidemark.functions.hashing import poisson_cdf
from tidemark.operators import metrics as M
from tidemark.operators import trees as T
from tidemark.queries import query
from tidemark.queries.base import LI, lines, uniform_sql, with_

FEATURES = ["qty", "disc", "tax"]
BINS, TIE = 10, 0.05


def by_year(spark, sf):
    return lines(spark, sf).withColumn("batch", F.expr("month div 12"))


def _entropy(k: str, classes: int) -> str:
    t = "(" + " + ".join(f"{k}{c}" for c in range(classes)) + ")"
    return "(" + " + ".join(f"CASE WHEN {k}{c} > 0 THEN -{k}{c} / {t} * log2({k}{c} / {t}) ELSE 0 END" for c in range(classes)) + ")"


def _scatter(k: str) -> str:
    return f"CASE WHEN {k}0 > 0 THEN greatest({k}2 - {k}1 * {k}1 / {k}0, 0) ELSE 0 END"


class Goal:
    """SQL of one kind of tree: additive terms, count, gain, bound and answer."""

    def __init__(self, classes: int | None, target: str):
        self.width, self.classes, self.target = classes or 3, classes, target

    def terms(self) -> list[str]:
        if self.classes:
            return [f"sum(CASE WHEN y = {c} THEN w ELSE 0 END)" for c in range(self.classes)]
        return ["sum(w)", "sum(w * y)", "sum(w * y * y)"]

    def n(self, k: str) -> str:
        return "(" + " + ".join(f"{k}{c}" for c in range(self.classes)) + ")" if self.classes else f"{k}0"

    def gain(self) -> str:
        if self.classes:
            h = {k: _entropy(k, self.classes) for k in "abt"}
            return f"{h['t']} - {self.n('a')} / {self.n('t')} * {h['a']} - {self.n('b')} / {self.n('t')} * {h['b']}"
        return f"CASE WHEN {_scatter('t')} > 0 THEN 1 - ({_scatter('a')} + {_scatter('b')}) / ({_scatter('t')}) ELSE 0 END"

    def limit(self) -> str:
        spread = "log2(3)" if self.classes else "1.0"
        return f"{spread} * sqrt(ln(1e3) / (2 * n))"

    def answer(self) -> str:
        if self.classes:
            return "CASE " + " ".join(f"WHEN s{c} = greatest({', '.join(f's{i}' for i in range(self.classes))}) THEN {c}" for c in range(self.classes)) + " END"
        return "CASE WHEN s0 > 0 THEN s1 / s0 ELSE 0 END"


def forest_sql(goal: Goal, depth: int, weight: str, members: int) -> list[str]:
    """Nodes of all rows after ``depth`` levels (table n{depth}) and the splits (sp), one member per value of m."""
    w, features = goal.width, range(len(FEATURES))
    listed = lambda k: ", ".join(f"{k}{i}" for i in range(w))
    cells = "[" + ", ".join("{'j': %d, 'b': b%d}" % (j, j) for j in features) + "]"
    parts = [
        LI, "ed AS (SELECT " + ", ".join(f"min({f}) AS lo{j}, max({f}) AS hi{j}" for j, f in enumerate(FEATURES)) + " FROM li WHERE month // 12 = (SELECT min(month // 12) FROM li))",
        "n0 AS (SELECT rid, month // 12 AS t, m, 1 AS node, " + ", ".join(f"CAST(least(greatest(floor(({f} - lo{j}) / (hi{j} - lo{j}) * {BINS}), 0), {BINS - 1}) AS INT) AS b{j}" for j, f in enumerate(FEATURES))
        + f", CAST({goal.target} AS DOUBLE) AS y, CAST({weight} AS DOUBLE) AS w FROM li, ed, range(0, {members}) r(m))"]
    for level in range(depth):
        parts.append(f"h{level} AS (SELECT m, node, t, f.j AS j, f.b AS b, " + ", ".join(f"{x} AS c{i}" for i, x in enumerate(goal.terms()))
                     + f" FROM (SELECT *, unnest({cells}) AS f FROM n{level} WHERE node >= {2**level} AND w > 0) z GROUP BY ALL)")
        sides = ", ".join(f"sum(CASE WHEN b < cut THEN c{i} ELSE 0 END) AS a{i}, sum(CASE WHEN b >= cut THEN c{i} ELSE 0 END) AS b{i}, sum(c{i}) AS t{i}" for i in range(w))
        parts.append(f"q{level} AS (SELECT s.m, s.node, s.t, h.j, cut, {sides} FROM (SELECT DISTINCT m, node, t FROM h{level}) s"
                     f" JOIN h{level} h ON h.m = s.m AND h.node = s.node AND h.t <= s.t, range(1, {BINS}) r(cut) GROUP BY s.m, s.node, s.t, h.j, cut)")
        parts.append(f"g{level} AS (SELECT *, {goal.n('t')} AS n, round(CASE WHEN {goal.n('a')} > 0 AND {goal.n('b')} > 0 THEN {goal.gain()} ELSE 0 END, 10) AS gain FROM q{level})")
        parts.append(f"f{level} AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY m, node, t, j ORDER BY gain DESC, cut) AS nth FROM g{level}) z WHERE nth = 1)")
        parts.append(f"r{level} AS (SELECT *, coalesce(lead(gain) OVER w, 0) AS second, row_number() OVER w AS q FROM f{level} WINDOW w AS (PARTITION BY m, node, t ORDER BY gain DESC, j))")
        parts.append(f"s{level} AS (SELECT m, node, t, j, cut, {listed('a')}, {listed('b')} FROM (SELECT *, row_number() OVER (PARTITION BY m, node ORDER BY t) AS early FROM r{level}"
                     f" WHERE q = 1 AND gain > 0 AND (gain - second > {goal.limit()} OR {goal.limit()} < {TIE})) z WHERE early = 1)")
        parts.append(f"n{level + 1} AS (SELECT x.* REPLACE (CASE WHEN s.t < x.t THEN x.node * 2 + CAST(CASE s.j " + " ".join(f"WHEN {j} THEN x.b{j}" for j in features)
                     + f" END >= s.cut AS INT) ELSE x.node END AS node) FROM n{level} x LEFT JOIN s{level} s ON s.m = x.m AND s.node = x.node)")
    parts.append("sp AS (" + " UNION ALL ".join(f"SELECT * FROM s{level}" for level in range(depth)) + ")")
    parts.append("bo AS (SELECT m, node * 2 AS node, " + ", ".join(f"a{i} AS s{i}" for i in range(w)) + " FROM sp UNION ALL SELECT m, node * 2 + 1, " + listed("b") + " FROM sp)")
    parts.append("tt AS (SELECT m, node, t, " + ", ".join(f"{x} AS c{i}" for i, x in enumerate(goal.terms())) + f" FROM n{depth} GROUP BY m, node, t)")
    parts.append("le AS (SELECT tt.m, tt.node, tt.t, " + ", ".join(
        f"coalesce(sum(c{i}) OVER (PARTITION BY tt.m, tt.node ORDER BY tt.t ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) + coalesce(s{i}, 0) AS s{i}" for i in range(w))
        + " FROM tt LEFT JOIN bo ON bo.m = tt.m AND bo.node = tt.node)")
    parts.append(f"an AS (SELECT n.rid, n.t, n.m, {goal.answer()} AS answer FROM n{depth} n JOIN le ON le.m = n.m AND le.node = n.node AND le.t = n.t)")
    return parts


CLASSES3, MEAN = Goal(3, "label"), Goal(None, "target")
_CUT = " ".join(f"WHEN {j} THEN lo{j} + cut / {BINS}.0 * (hi{j} - lo{j})" for j in range(3))


@query("hoeffding_tree", "L20", sql=with_(*forest_sql(CLASSES3, 2, "1", 1)) + "SELECT rid, t AS batch, CAST(answer AS INT) AS y_pred FROM an")
def _(spark, sf):
    return T.hoeffding_tree(by_year(spark, sf), [], "batch", FEATURES, "label", [0, 1, 2], depth=2, bins=BINS).select("rid", "batch", "y_pred")


@query("hoeffding_splits", "L20", sql=with_(*forest_sql(CLASSES3, 2, "1", 1)) + f"SELECT node, t AS batch, CASE j WHEN 0 THEN 'qty' WHEN 1 THEN 'disc' ELSE 'tax' END AS feature, round(CASE j {_CUT} END, 6) AS cut FROM sp, ed")
def _(spark, sf):
    _rows, splits = T.stream_forest(by_year(spark, sf), [], "batch", FEATURES, "label", T.Classes([0, 1, 2]), depth=2, bins=BINS)
    return splits.select("node", "batch", "feature", F.round("cut", 6).alias("cut"))


@query("tree_regressor", "L18b", sql=with_(*forest_sql(MEAN, 2, "1", 1)) + "SELECT rid, round(answer, 6) AS y_pred FROM an")
def _(spark, sf):
    out = T.tree_regressor(by_year(spark, sf), [], "batch", FEATURES, "target", depth=2, bins=BINS)
    return out.select("rid", F.round("y_pred", 6).alias("y_pred"))


TABLE = "[" + ", ".join(repr(p) for p in poisson_cdf(6.0, 1e-10)) + "]"
DRAW = f"len(list_filter({TABLE}, lambda p: p <= " + uniform_sql("rid", "'tree' || CAST(m AS VARCHAR)") + "))"


@query("bagged_tree", "L18b", sql=with_(*forest_sql(MEAN, 2, DRAW, 3)) + "SELECT rid, round(avg(answer), 6) AS y_pred FROM an GROUP BY rid")
def _(spark, sf):
    out = T.tree_regressor(by_year(spark, sf), [], "batch", FEATURES, "target", members=3, ident="rid", depth=2, bins=BINS)
    return out.select("rid", F.round("y_pred", 6).alias("y_pred"))


@query("compare_tree_regressors", "R3", "L18b")
def _(spark, sf):
    """Trees of full depth, alone and ten in a bag, beside exact ridge, by year of the line items."""
    li = by_year(spark, sf)
    out = None
    for name in RG.names_of("tree, bagged_tree, ridge", RG.REGRESSORS):
        part = RG.REGRESSORS[name](li, [], "rid", "batch", FEATURES, "target").select(F.lit(name).alias("method"), "y_true", "y_pred")
        out = part if out is None else out.unionByName(part)
    return M.regression_metrics(out, ["method"]).select("method", *[F.round(c, 4).alias(c) for c in ("MSE", "MAE", "R2", "RMSE")])
