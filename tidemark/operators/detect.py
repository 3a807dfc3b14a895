"""Drift detectors over a keyed error or value stream.

Each machine consumes runs of rows of one key as numpy columns and emits alarm rows only.  The same
machines run in batch (``keyed_scan``) and in Structured Streaming (``tidemark.streaming``).
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.functions.numeric import ks_exact_pvalues, ks_statistic, splitmix_uniform
from tidemark.operators.audit import row_window
from tidemark.plans.keyed import Machine, keyed_scan
from tidemark.plans.scan import running

ALARM = (("kind", "string"), ("estimation", "double"))
_PIECE = 4096


def _alarms(rows, kinds, values):
    return {"row": np.asarray(rows, dtype=np.int64), "kind": kinds, "estimation": np.asarray(values, dtype=float)}


class Ddm(Machine):
    """Error-rate detector: warns, then signals change, when p + s leaves its minimum.

    The first verdict falls on element ``min_n - 1``.  ``reset_on='change'`` restarts after a
    change; ``'warning'`` restarts after a warning and lets a change keep signalling.
    """

    inputs = ("x",)
    outputs = ALARM

    def __init__(self, min_n: int = 30, warning: float = 2.0, out: float = 3.0, reset_on: str = "change"):
        if reset_on not in ("change", "warning"):
            raise ValueError("reset_on must be 'change' or 'warning'")
        self.min_n, self.warning, self.out, self.reset_on = min_n, warning, out, reset_on

    def start(self):
        return (0, 0.0, np.inf, np.inf, np.inf)  # n, errors, lowest p + s, its p, its s

    def feed(self, state, cols):
        e = cols["x"].astype(float)
        rows, kinds, values = [], [], []
        at = 0
        while at < len(e):
            n0, err0, low, low_p, low_s = state
            piece = e[at : at + _PIECE]
            n = n0 + np.arange(1, len(piece) + 1)
            p = (err0 + np.cumsum(piece)) / n
            s = np.sqrt(p * (1 - p) / n)
            level = p + s
            ready = n + 1 >= self.min_n
            lowest = np.minimum.accumulate(np.where(ready, level, np.inf))
            lowest = np.minimum(lowest, low)
            new_low = ready & (level <= lowest)
            where = np.maximum.accumulate(np.where(new_low, np.arange(len(piece)), -1))
            best_p = np.where(where >= 0, p[where], low_p)
            best_s = np.where(where >= 0, s[where], low_s)
            with np.errstate(invalid="ignore"):
                change = ready & (level > best_p + self.out * best_s)
                warn = ready & ~change & (level > best_p + self.warning * best_s)
            stops = np.flatnonzero(change if self.reset_on == "change" else warn)
            end = int(stops[0]) + 1 if len(stops) else len(piece)
            for i in np.flatnonzero(change[:end] | warn[:end]):
                rows.append(at + int(i))
                kinds.append("change" if change[i] else "warning")
                values.append(p[i])
            last = end - 1
            state = self.start() if len(stops) else (int(n[last]), float(err0 + piece.sum()), float(lowest[last]), float(best_p[last]), float(best_s[last]))
            at += end
        return state, _alarms(rows, kinds, values)


class Eddm(Machine):
    """Distance-between-errors detector; a warning persists until the next error.

    Needs more than 30 errors, and at least 30 elements, since the last change.
    """

    inputs = ("x",)
    outputs = ALARM
    # fixed values: levels and minimum counts
    CHANGE, WARNING, MIN_ERRORS, MIN_N = 0.9, 0.95, 30, 30

    def start(self):
        return dict(n=0, errors=0, last=0, mean=0.0, spread=0.0, top=0.0, warned=False)

    def feed(self, state, cols):
        s = dict(state)
        x = cols["x"]
        hits = np.flatnonzero(x == 1)
        rows, kinds, values = [], [], []
        seen = 0  # rows of this run already counted in s["n"]

        def quiet(upto):
            if s["warned"] and upto > seen:
                rows.extend(range(seen, upto))
                kinds.extend(["warning"] * (upto - seen))
                values.extend([s["mean"]] * (upto - seen))

        for i in hits.tolist():
            quiet(i)
            s["n"] += i + 1 - seen
            seen = i + 1
            s["warned"] = False
            s["errors"] += 1
            gap = s["n"] - s["last"]
            s["last"] = s["n"]
            before = s["mean"]
            s["mean"] = before + (gap - before) / s["errors"]
            s["spread"] += (gap - s["mean"]) * (gap - before)
            if s["n"] + 1 < self.MIN_N:
                continue
            level = s["mean"] + 2 * np.sqrt(s["spread"] / s["errors"])
            if level > s["top"]:
                s["top"] = level
            elif s["errors"] > self.MIN_ERRORS:
                ratio = level / s["top"]
                if ratio < self.CHANGE:
                    rows.append(i)
                    kinds.append("change")
                    values.append(s["mean"])
                    s = self.start()
                elif ratio < self.WARNING:
                    s["warned"] = True
                    rows.append(i)
                    kinds.append("warning")
                    values.append(s["mean"])
        quiet(len(x))
        s["n"] += len(x) - seen
        return s, _alarms(rows, kinds, values)


class PageHinkley(Machine):
    """Cumulative deviation from the running mean; ``direction`` up (default), down or both."""

    inputs = ("x",)
    outputs = ALARM

    def __init__(self, min_n: int = 30, delta: float = 0.005, threshold: float = 50.0, alpha: float = 0.9999, direction: str = "up"):
        if direction not in ("up", "down", "both"):
            raise ValueError("direction must be 'up', 'down' or 'both'")
        self.min_n, self.delta, self.threshold, self.alpha, self.direction = min_n, delta, threshold, alpha, direction

    def start(self):
        return (0, 0.0, 0.0, 0.0)  # n, sum, upward score, downward score

    def feed(self, state, cols):
        n, total, up, down = state
        alpha, delta, threshold = self.alpha, self.delta, self.threshold
        look_up, look_down = self.direction != "down", self.direction != "up"
        rows, values = [], []
        for i, x in enumerate(cols["x"].astype(float).tolist()):
            n += 1
            total += x
            mean = total / n
            up = max(0.0, alpha * up + (x - mean - delta))
            if look_down:
                down = max(0.0, alpha * down + (mean - x - delta))
            if n + 1 >= self.min_n and ((look_up and up > threshold) or (look_down and down > threshold)):
                rows.append(i)
                values.append(mean)
                n, total, up, down = 0, 0.0, 0.0, 0.0
        return (n, total, up, down), _alarms(rows, ["change"] * len(rows), values)


class Kswin(Machine):
    """Compares the newest ``stat`` values with as many drawn from the older part of a sliding window.

    The test comes before the new value is added and after the oldest is dropped; on a change only
    the newest ``stat`` values stay.  Draws are hashes of the position, so runs repeat exactly.
    """

    inputs = ("x",)
    outputs = ALARM

    def __init__(self, alpha: float = 0.005, window: int = 100, stat: int = 30, seed: int = 42):
        if window <= stat + 1:
            raise ValueError("window must exceed stat + 1")
        self.alpha, self.window, self.stat, self.seed = alpha, window, stat, seed
        self.tail = ks_exact_pvalues(stat, stat)

    def start(self):
        return (0, [])  # rows seen, window values

    def feed(self, state, cols):
        seen, held = state[0], list(state[1])
        draw_ids = np.arange(self.stat, dtype=np.int64)
        rows, values = [], []
        for i, x in enumerate(cols["x"].astype(float).tolist()):
            seen += 1
            if len(held) >= self.window:
                held.pop(0)
                older, newer = np.array(held[: -self.stat]), np.array(held[-self.stat :])
                u = splitmix_uniform(seen * self.stat + draw_ids, self.seed)
                gap = ks_statistic(older[(u * len(older)).astype(int)], newer)
                if gap > 0.1 and self.tail[int(round(gap * self.stat))] <= self.alpha:
                    rows.append(i)
                    values.append(gap)
                    held = held[-self.stat :]
            held.append(x)
        return (seen, held), _alarms(rows, ["change"] * len(rows), values)


class AdaptiveWindow:
    """A window of the newest values that shrinks while two of its parts differ in mean.

    Values are held as buckets of 1, 2, 4, ... elements with their sum and squared deviations, at most
    ``PER_SIZE`` + 1 of a size, so memory grows with the logarithm of the window.
    """

    PER_SIZE = 5

    def __init__(self, delta: float, state: tuple | None = None):
        self.delta = delta
        self.n, self.total, self.dev = (list(x) for x in state) if state else ([], [], [])

    def state(self) -> tuple:
        return tuple(self.n), tuple(self.total), tuple(self.dev)

    def _join(self, i: int) -> None:
        """Merge bucket i with the one after it."""
        a, b = self.n[i], self.n[i + 1]
        gap = self.total[i] / a - self.total[i + 1] / b
        self.dev[i] += self.dev[i + 1] + gap * gap * a * b / (a + b)
        self.n[i] += b
        self.total[i] += self.total[i + 1]
        for part in (self.n, self.total, self.dev):
            del part[i + 1]

    def add(self, x: float) -> None:
        self.n.append(1)
        self.total.append(float(x))
        self.dev.append(0.0)
        size = 1
        while True:
            first = next(i for i, n in enumerate(self.n) if n <= size)
            if self.n[first] != size or sum(n == size for n in self.n) <= self.PER_SIZE:
                return
            self._join(first)
            size *= 2

    def shrink(self) -> bool:
        """Drop oldest buckets while some cut separates two different means; true if any went."""
        cut = False
        while len(self.n) > 1:
            n, total = np.cumsum(self.n), np.cumsum(self.total)
            size, mean = n[-1], total[-1] / n[-1]
            spread = sum(self.dev) + float(((np.array(self.total) / self.n - mean) ** 2 * self.n).sum())
            n0, n1 = n[:-1], size - n[:-1]
            gap = np.abs(total[:-1] / n0 - (total[-1] - total[:-1]) / n1)
            m = 1 / (1 / n0 + 1 / n1)
            level = np.log(2 * np.log(max(size, 3)) / self.delta)
            bound = np.sqrt(2 / m * spread / size * level) + 2 / (3 * m) * level
            if not (gap > bound).any():
                break
            for part in (self.n, self.total, self.dev):
                del part[0]
            cut = True
        return cut

    @property
    def mean(self) -> float:
        return sum(self.total) / sum(self.n) if self.n else 0.0


class Adwin(Machine):
    """Adaptive windowing with one window for warnings and a stricter one for changes.

    The windows are tested every ``clock`` values of a key.  A cut that raises the mean of the strict window signals a
    change and restarts the other; a cut of the other that raises its mean warns.
    """

    inputs = ("x",)
    outputs = ALARM

    def __init__(self, change: float = 0.001, warning: float = 0.01, clock: int = 8):
        self.change, self.warning, self.clock = change, warning, clock

    def start(self):
        return 0, None, None

    def feed(self, state, cols):
        seen, strict, loose = state
        strict, loose = AdaptiveWindow(self.change, strict), AdaptiveWindow(self.warning, loose)
        rows, kinds, values = [], [], []
        for i, x in enumerate(cols["x"].tolist()):
            strict.add(x)
            loose.add(x)
            seen += 1
            if seen % self.clock:
                continue
            before, early = strict.mean, loose.mean
            if strict.shrink() and strict.mean > before:
                kind, loose = "change", AdaptiveWindow(self.warning)
            elif loose.shrink() and loose.mean > early:
                kind = "warning"
            else:
                continue
            rows.append(i)
            kinds.append(kind)
            values.append(strict.mean)
        return (seen, strict.state(), loose.state()), _alarms(rows, kinds, values)


DETECTORS = {"ddm": Ddm, "eddm": Eddm, "page_hinkley": PageHinkley, "kswin": Kswin, "adwin": Adwin}


def detector(name: str, **options) -> Machine:
    """Detector by name."""
    if name not in DETECTORS:
        raise ValueError(f"unknown detector {name!r}; choose from {sorted(DETECTORS)}")
    return DETECTORS[name](**options)


def detect(df: DataFrame, keys: list[str], order: str, value: Column, machine: Machine | str, **scan) -> DataFrame:
    """Alarm rows (keys, order, kind, estimation) of a detector over each key's stream."""
    machine = detector(machine) if isinstance(machine, str) else machine
    return keyed_scan(df.withColumn("x", value.cast("double")), keys, order, machine, **scan)


def detector_suite(df: DataFrame, keys: list[str], order: str, value: Column, machines: dict[str, Machine], **scan) -> DataFrame:
    """Alarms of several detectors over one stream, tagged with the detector's name.

    All machines run in the same pass over the sorted rows, so the shuffle and the sort happen once.
    """
    return keyed_scan(df.withColumn("x", value.cast("double")), keys, order, _Suite(machines), **scan)


class _Suite(Machine):
    inputs = ("x",)
    outputs = (("detector", "string"), *ALARM)

    def __init__(self, machines: dict[str, Machine]):
        self.machines = machines

    def start(self):
        return {n: m.start() for n, m in self.machines.items()}

    def feed(self, state, cols):
        new, rows, names, kinds, values = {}, [], [], [], []
        for n, m in self.machines.items():
            new[n], out = m.feed(state[n], cols)
            rows.append(out["row"])
            names += [n] * len(out["row"])
            kinds += list(out["kind"])
            values.append(out["estimation"])
        return new, {"row": np.concatenate(rows), "detector": names, "kind": kinds, "estimation": np.concatenate(values)}


def ddm_first_alarm(df: DataFrame, keys: list[str], order: str, err: str, *, min_n: int = 30, warning: float = 2.0, out: float = 3.0) -> DataFrame:
    """First warning and first change per key with no reset: prefix scans only, any key size."""
    one = running(df, keys, order, {"__n": ("sum", F.lit(1).cast("bigint")), "__e": ("sum", F.col(err).cast("bigint"))})
    p = F.col("__e") / F.col("__n")
    one = one.withColumn("__p", p).withColumn("__s", F.sqrt(F.col("__p") * (1 - F.col("__p")) / F.col("__n")))
    ready = F.col("__n") + 1 >= min_n
    low = F.when(ready, F.struct((F.col("__p") + F.col("__s")).alias("l"), (-F.col("__n")).alias("n"), F.col("__p").alias("p"), F.col("__s").alias("s")))
    two = running(one, keys, order, {"__low": ("min", low)})
    level = F.col("__p") + F.col("__s")
    over = lambda k: ready & (level > F.col("__low.p") + k * F.col("__low.s"))
    return two.groupBy(*keys).agg(
        F.min(F.when(over(warning), F.col(order))).alias("first_warning"), F.min(F.when(over(out), F.col(order))).alias("first_change"))


def fixed_chunks(df: DataFrame, keys: list[str], label: str, size: int, *, seq: str = "seq") -> DataFrame:
    """Chunks of ``size`` rows that hold both classes; a one-class block merges into the next.

    Adds ``chunk_id``: the number of complete two-class blocks before the row's block.
    """
    block = row_window(size, seq).alias("__block")
    per = df.groupBy(*keys, block).agg(F.count("*").alias("__n"), F.min(label).alias("__lo"), F.max(label).alias("__hi"))
    good = ((F.col("__n") == size) & (F.col("__lo") != F.col("__hi"))).cast("bigint")
    ids = running(per, keys, "__block", {"chunk_id": ("sum", good)}, exclusive=True).select(*keys, "__block", "chunk_id")
    return df.withColumn("__block", row_window(size, seq)).join(ids, [*keys, "__block"]).drop("__block")


class MinorityChunks(Machine):
    """Closes a chunk when the smaller class has ``size`` rows; emits each closing row."""

    inputs = ("label",)
    outputs = (("chunk_id", "bigint"), ("n_rows", "bigint"))

    def __init__(self, size: int):
        self.size = size

    def start(self):
        return (0, 0, 0)  # closed chunks, zeros, ones

    def feed(self, state, cols):
        closed, zeros, ones = state
        y = cols["label"]
        at, rows, ids, lengths = 0, [], [], []
        c0, c1 = np.flatnonzero(y == 0), np.flatnonzero(y == 1)
        while True:
            need = []
            for have, where in ((zeros, c0), (ones, c1)):
                if have >= self.size:
                    continue
                first = np.searchsorted(where, at)
                pos = first + (self.size - have) - 1
                need.append(int(where[pos]) if pos < len(where) else len(y))
            close = max(need)
            if close >= len(y):
                zeros += int((y[at:] == 0).sum())
                ones += int((y[at:] == 1).sum())
                break
            zeros += int((y[at : close + 1] == 0).sum())
            ones += int((y[at : close + 1] == 1).sum())
            rows.append(close)
            ids.append(closed)
            lengths.append(zeros + ones)
            closed, zeros, ones, at = closed + 1, 0, 0, close + 1
        return (closed, zeros, ones), {"row": np.asarray(rows, dtype=np.int64), "chunk_id": ids, "n_rows": lengths}


def minority_chunks(df: DataFrame, keys: list[str], order: str, label: str, size: int, **scan) -> DataFrame:
    """Closing rows of chunks that end when the smaller class reaches ``size`` rows."""
    return keyed_scan(df.withColumn("label", F.col(label)), keys, order, MinorityChunks(size), **scan)
