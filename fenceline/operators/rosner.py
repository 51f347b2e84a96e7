"""Sequential extreme studentised deviates (Rosner) without a row of the table on the driver.

Every step removes the value farthest from the mean of what is left, so what has been
removed is always some lowest and some highest values. The table is folded into bins of
its tails by (count, sum, sum of squares, least, greatest), and the two ends are walked
bin by bin. A state in which whole bins are gone is certain to be passed if no value that
stays could have been taken earlier: the mean of all that may still have been there, at
its worst, is nearer to the values that stay than to those that go. Between two such
states every statistic has bounds from the states' sums. Where the bounds decide, nothing
is read again; where they do not, the stretch is folded into finer bins, or, once it is
short, walked value by value. Where both tails are dense, bins of the two sides overlap
by their distance from the mean and no state is certain, however fine they are: then the
stretch's values, with their copies, are stored in pieces by range, and the driver walks
them with one piece of either end at a time.

Equal values go together: taking one moves the mean away, so that the next is farther
still and its statistic larger. A run of copies, however long, is one step of the walk.

The driver holds bins, states and one short stretch or two pieces. Steps come as a DataFrame: stretches
between states are walked in parallel, each from its state, and the rows of a run are
numbered by exact ranks.
"""

from __future__ import annotations

import math
import uuid
from collections.abc import Iterator
from dataclasses import dataclass, field, replace

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, functions as F

from ..functions import special
from ..functions.columns import number, scalar_function
from ..functions.lineage import broadcast_if_small, cut_lineage, shared_folder
from ..functions.rank import TASK_ROWS, ranked_values

#: Bins per tail, and distinct values of a stretch that the driver walks.
BINS, PAGE = 512, 20_000

#: Pages in a piece of a stored stretch.
PIECE_PAGES = 10


@dataclass(frozen=True)
class State:
    """What is left: rows, mean and squares about it; values up to ``low`` and from ``high`` on are gone."""

    n: int
    mean: float
    squares: float
    low: float = -math.inf
    high: float = math.inf

    def without(self, value: float, count: int) -> State:
        left, gap = self.n - count, value - self.mean
        if not left:
            return replace(self, n=0, squares=0.0)
        return replace(self, n=left, mean=self.mean - gap * count / left, squares=max(0.0, self.squares - count * gap * gap * self.n / left))


@dataclass
class RosnerFit:
    """How far the peeling went.

    Rows up to ``low`` and from ``high`` on, (value, row_id), are outliers; without a
    row_id all copies of the value are. ``removed`` counts them. ``stretches`` are the
    (state, low end, high end) between which the steps lie.
    """

    column: str
    row_id: str
    low: tuple | None = None
    high: tuple | None = None
    removed: int = 0
    total: int = 0
    status: str = "tested"
    stretches: list[tuple[State, float, float]] = field(default_factory=list)

    def flag(self) -> Column:
        x, i = number(self.column), F.col(self.row_id)
        found = F.lit(False)
        for end, beyond in ((self.low, lambda v: x < v), (self.high, lambda v: x > v)):
            if end:
                value, last = end
                found = found | beyond(value) | ((x == value) & (F.lit(True) if last is None else i <= F.lit(last)))
        return F.coalesce(found, F.lit(False))


def significant(statistic: float, m: int, alpha: float) -> bool:
    """Whether the statistic exceeds its critical value, decided on the p scale."""
    if m - 2 < 1:
        return False
    rest = (m - 1) ** 2 - m * statistic * statistic
    if rest <= 0:
        return True
    return special.t_sf(math.sqrt(m * (m - 2) * statistic**2 / rest), m - 2) < alpha / (2.0 * m)


def critical(m: int, alpha: float) -> float:
    """Critical value when m rows remain."""
    if m - 2 < 1:
        return math.inf
    t = special.t_isf(alpha / (2.0 * m), m - 2)
    return (m - 1) * t / math.sqrt((m - 2 + t * t) * m)


def walk(state: State, runs: list[tuple], total: int, last: int, alpha: float | None = None, stop: str = "first", split: int | None = None):
    """Peel runs (value, count, least id) in order of value, until ``last`` rows are gone.

    ``split`` is the number of runs at the low end when rows between the two ends are not
    listed. Yields (side, value, count, state before, is the first copy significant, is
    the last one); ends at the first run that is not significant if stop is 'first'.
    Without alpha nothing is tested.
    """
    a, b = 0, len(runs) - 1
    low_end, high_end = (len(runs), -1) if split is None else (split, split - 1)
    while total - state.n < last and a <= b and state.n >= 3 and state.squares > 0:
        down = state.mean - runs[a][0] if a < low_end else -math.inf
        up = runs[b][0] - state.mean if b > high_end else -math.inf
        if down == up == -math.inf:
            return
        side = "low" if down > up or down == up and runs[a][2] < runs[b][2] else "high"
        value, count, _ = runs[a] if side == "low" else runs[b]
        count = min(count, last - (total - state.n), state.n - 2)
        first = end = True
        if alpha is not None:
            first = significant(abs(value - state.mean) / math.sqrt(state.squares / (state.n - 1)), state.n, alpha)
            if not first and stop == "first":
                yield side, value, 0, state, False, False
                return
            before = state.without(value, count - 1)
            end = first or significant(abs(value - before.mean) / math.sqrt(before.squares / (before.n - 1)), before.n, alpha)
        yield side, value, count, state, first, end
        state = state.without(value, count)
        if side == "low":
            a, state = a + 1, replace(state, low=value)
        else:
            b, state = b - 1, replace(state, high=value)


def _rush(state: State, low: tuple, high: tuple, more_low: bool, more_high: bool, left: int):
    """The runs that go next, as ``walk`` takes them, from arrays (values, counts, ids) of both ends, outermost first.

    Ends before the limit of ``left`` rows and where an end's values are used up though
    it has ``more``. Nothing is tested. Returns side (True: low), value and count of every
    run, and rows, mean and squares before each of them and after the last.
    """
    (lows, low_counts, low_ids), (highs, high_counts, high_ids) = ([v.tolist() for v in end] for end in (low, high))
    lows.append(math.inf)
    highs.append(-math.inf)
    # Where the walk stops at an end that has more values; not reached otherwise.
    low_end, high_end = (len(lows) - 1 if more_low else -1), (len(highs) - 1 if more_high else -1)
    n, mean, squares, a, b = state.n, state.mean, state.squares, 0, 0
    sides, before = [], []
    while a != low_end and b != high_end and squares > 0:
        down, up = mean - lows[a], highs[b] - mean
        if down > up or down == up and (down == -math.inf or low_ids[a] < high_ids[b]):
            if down == -math.inf:
                break
            side, value, count = True, lows[a], low_counts[a]
        else:
            side, value, count = False, highs[b], high_counts[b]
        rest = n - count
        if count > left or rest < 3:
            break
        sides.append(side)
        before.append((n, mean, squares))
        gap = value - mean
        squares = max(0.0, squares - count * gap * gap * n / rest)
        mean -= gap * count / rest
        left -= count
        n = rest
        if side:
            a += 1
        else:
            b += 1
    before.append((n, mean, squares))
    side = np.array(sides, dtype=bool)
    value, count = np.empty(len(side)), np.empty(len(side))
    value[side], value[~side], count[side], count[~side] = low[0][:a], high[0][:b], low[1][:a], high[1][:b]
    return side, value, count, *np.array(before, dtype=np.float64).T


def _all_significant(statistic: np.ndarray, m: np.ndarray, alpha: float) -> np.ndarray:
    """``significant`` of many steps; the critical value grows with m, so most are told by those of the least and the greatest."""
    found = statistic > critical(int(m.max()), alpha) * (1 + 1e-4)
    for k in np.flatnonzero(~found & (statistic >= critical(int(m.min()), alpha) * (1 - 1e-4))):
        found[k] = significant(float(statistic[k]), int(m[k]), alpha)
    return found


def _folded(data: DataFrame, edges: list[float], centre: float) -> pd.DataFrame:
    """Bins between the edges: number, rows, sum and squares about the centre, least and greatest value."""

    def fold(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            x = np.sort(f["x"].to_numpy())
            if not len(x):
                continue
            bins = np.searchsorted(edges, x, side="left")
            starts = np.flatnonzero(np.concatenate(([True], np.diff(bins) > 0)))
            ends = np.append(starts[1:], len(x))
            y = x - centre
            yield pd.DataFrame({"bin": bins[starts], "n": ends - starts, "s": np.add.reduceat(y, starts), "q": np.add.reduceat(y * y, starts), "least": x[starts], "most": x[ends - 1]})

    parts = data.select("x").mapInPandas(fold, "bin long, n long, s double, q double, least double, most double")
    return parts.groupBy("bin").agg(F.sum("n").alias("n"), F.sum("s").alias("s"), F.sum("q").alias("q"), F.min("least").alias("least"), F.max("most").alias("most")).orderBy("bin").toPandas()


def _sure_states(bins: pd.DataFrame, start: State, centre: float, last: int, total: int) -> list[tuple[State, int, int]]:
    """States with whole bins gone that peeling is certain to pass: (state, bins gone below, bins gone above), in order.

    ``bins`` cover all that is left in ``start``.
    """
    n, s, q = (bins[c].to_numpy(np.float64) for c in ("n", "s", "q"))
    least, most = bins["least"].to_numpy(), bins["most"].to_numpy()
    cn, cs, cq = (np.concatenate(([0.0], np.cumsum(v))) for v in (n, s, q))
    i, j, k = 0, 0, len(n)
    found = [(start, 0, 0)]
    slack = 1e-9 * (np.abs(least).max() + np.abs(most).max()) if k else 0.0

    def about(a: int, b: int) -> tuple[int, float, float]:
        rows, sums = cn[b] - cn[a], cs[b] - cs[a]
        return int(rows), sums / rows, max(0.0, cq[b] - cq[a] - sums * sums / rows)

    while i + j < k - 1 and total - (cn[k - j] - cn[i]) < last:
        _, mean, _ = about(i, k - j)
        if mean - (least[i] - centre) > most[k - 1 - j] - centre - mean:
            i += 1
        else:
            j += 1
        rows, mean, squares = about(i, k - j)
        # While values of a higher bin that goes are there, the mean is at most that of the rest with these bins.
        above = np.arange(k - j, k)
        high = (cs[above + 1] - cs[i]) / (cn[above + 1] - cn[i])
        below = np.arange(0, i)
        low = (cs[k - j] - cs[below]) / (cn[k - j] - cn[below])
        if np.all(2 * high + slack < least[above] + least[i] - 2 * centre) and np.all(2 * low - slack > most[below] + most[k - 1 - j] - 2 * centre):
            state = State(rows, centre + mean, squares, most[i - 1] if i else start.low, least[k - j] if j else start.high)
            found.append((state, i, j))
    return found


def _verdict(before: State, after: State, farthest: float, alpha: float) -> bool | None:
    """Whether all steps between two states are significant (True), none is (False), or the bounds do not tell.

    ``farthest`` is the greatest distance from before's mean of a value that goes.
    """
    ends = [abs(b - before.mean) for a, b in ((before.low, after.low), (before.high, after.high)) if a != b]
    if after.n < 4 or after.squares <= 0 or before.n == after.n:
        return None
    # The mean moves at most as far as when only the farther side goes.
    swing = (before.n - after.n) / after.n * farthest
    least = (min(ends) - swing) / math.sqrt(before.squares / (after.n - 1)) * (1 - 1e-9)
    if least > 0 and significant(least, before.n, alpha):
        return True
    most = (farthest + swing) / math.sqrt(after.squares / (before.n - 1)) * (1 + 1e-9)
    return None if significant(most, after.n, alpha) else False


@dataclass(frozen=True)
class Rule:
    alpha: float
    stop: str
    page: int
    bins: int


@dataclass
class Found:
    """Where the outliers end: a state, or none, and copies of a value that go in part (side, value, count)."""

    state: State | None = None
    partial: tuple | None = None
    ended: bool = False
    stretches: list[tuple[State, float, float]] = field(default_factory=list)


class _Pieces:
    """Runs (x, cnt, first) stored in pieces by ranges of x, of about ``size`` runs each."""

    def __init__(self, runs: DataFrame, size: int):
        self.spark, self.path = runs.sparkSession, f"{shared_folder(runs.sparkSession)}/pieces-{uuid.uuid4().hex}"
        runs = cut_lineage(runs)
        parts = max(1, -(-runs.count() // size))
        runs.repartitionByRange(parts, "x").withColumn("piece", F.spark_partition_id()).write.partitionBy("piece").parquet(self.path)
        self.schema = runs.schema
        stored = self.spark.read.parquet(self.path)
        self.bounds = [tuple(r) for r in stored.groupBy("piece").agg(F.min("x"), F.max("x")).orderBy("piece").collect()]

    def read(self, at: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Values of a piece in order, their counts and least ids."""
        found = self.spark.read.schema(self.schema).parquet(f"{self.path}/piece={self.bounds[at][0]}").toArrow()
        x, count, first = (found.column(c).to_numpy() for c in ("x", "cnt", "first"))
        order = np.argsort(x)
        return x[order], count[order], first[order]


def _walk_pieces(pieces: _Pieces, state: State, total: int, until: int, rule: Rule, low: float, high: float, meet: bool) -> Found:
    """As a walk over all runs of the pieces, up to ``low`` and from ``high`` on unless they meet, with a piece of either end at a time.

    A stretch ends with every piece, so that those who list the steps need not hold more either.
    """
    out, passed = Found(), []
    last = len(pieces.bounds) - 1
    ahead = {True: [k for k in range(last + 1) if meet or pieces.bounds[k][1] <= low], False: [k for k in reversed(range(last + 1)) if meet or pieces.bounds[k][2] >= high]}
    open_runs = {side: tuple(np.empty(0) for _ in range(3)) for side in (True, False)}
    at = {True: -1, False: last + 1}

    def cut(runs: tuple, keep: np.ndarray) -> tuple:
        return tuple(v[keep] for v in runs)

    def took(before: State, side, value, count, n, mean, squares) -> bool:
        """Tests the runs that were taken from a state on; whether the walk goes on."""
        nonlocal state
        gap = value - mean[:-1]
        first = _all_significant(np.abs(gap) / np.sqrt(squares[:-1] / (n[:-1] - 1)), n[:-1], rule.alpha)
        if rule.stop == "first":
            good = first
            if not first.all():
                out.ended = True
            k = len(first) if first.all() else int(np.argmin(first))
        else:
            others = count - 1
            m = n[:-1] - others
            rest = np.maximum(0.0, squares[:-1] - others * gap * gap * n[:-1] / m)
            with np.errstate(divide="ignore"):
                good = first | _all_significant(np.abs(gap) * n[:-1] / m / np.sqrt(rest / (m - 1)), m, rule.alpha)
            k = len(good)

        def after(k: int) -> State:
            lows, highs = value[:k][side[:k]], value[:k][~side[:k]]
            return State(int(n[k]), float(mean[k]), float(squares[k]), float(lows[-1]) if len(lows) else before.low, float(highs[-1]) if len(highs) else before.high)

        kept = k if rule.stop == "first" else int(np.flatnonzero(good)[-1]) + 1 if good.any() else 0
        if kept:
            out.state, out.partial = after(kept), None
            out.stretches = [*passed, (before, out.state.low, out.state.high)]
        state = after(k)
        passed.append((before, state.low, state.high))
        return not out.ended

    def finish(runs: list[tuple], split: int | None) -> Found:
        """The walk's last runs, one by one."""
        before, now = state, state
        for side, value, count, was, _, good in walk(state, runs, total, until, rule.alpha, rule.stop, split):
            if not count:
                out.ended = True
                return out
            now = replace(was.without(value, count), **{side: value})
            if good:
                whole = next(c for v, c, _ in runs if v == value)
                out.state, out.partial = now, (side, value, count) if count < whole else None
                out.stretches = [*passed, (before, now.low, now.high)]
        out.ended = total - now.n < until
        return out

    def listed(side: bool, most: int | None = None) -> list[tuple]:
        return sorted(zip(*(v[:most].tolist() for v in open_runs[side])))

    while True:
        for side in (True, False):
            while not len(open_runs[side][0]) and ahead[side] and at[True] < at[False]:
                at[side] = ahead[side].pop(0)
                runs = pieces.read(at[side])
                if not meet:
                    runs = cut(runs, runs[0] <= low if side else runs[0] >= high)
                open_runs[side] = runs if side else tuple(v[::-1] for v in runs)
        if meet and at[True] >= at[False]:  # both ends are in one piece
            both = sorted({*listed(True), *listed(False)})
            return finish([r for r in both if state.low < r[0] < state.high], None)
        before = state
        taken = _rush(state, open_runs[True], open_runs[False], bool(ahead[True]), bool(ahead[False]), until - (total - state.n))
        if not len(taken[0]):
            lows = listed(True, 1)
            return finish(lows + listed(False, 1), len(lows))
        if not took(before, *taken):
            return out
        n_low = int(taken[0].sum())
        for side, k in ((True, n_low), (False, len(taken[0]) - n_low)):
            open_runs[side] = tuple(v[k:] for v in open_runs[side])


def _edges(rest: DataFrame, start: State, need: int, ring: tuple[float, float] | None, bins: int) -> list[float]:
    """Values between bins: quantiles of the tails, or of what lies outside the ring."""
    accuracy = 20 * bins
    if ring is None:
        share = min(0.5, 1.1 * need / start.n + 2.0 / accuracy)
        steps = [share * i / bins for i in range(bins + 1)]
        found = rest.agg(F.percentile_approx("x", steps + [1 - p for p in reversed(steps)], accuracy)).first()[0]
    else:
        steps = [i / bins for i in range(bins + 1)]
        low, high = F.when(F.col("x") <= ring[0], F.col("x")), F.when(F.col("x") >= ring[1], F.col("x"))
        row = rest.agg(F.percentile_approx(low, steps, accuracy), F.percentile_approx(high, steps, accuracy)).first()
        found = (row[0] or []) + (row[1] or [])
    return sorted(set(found))


def _search(data: DataFrame, start: State, total: int, last: int, rule: Rule, ring: tuple[float, float] | None = None, before: float = math.inf) -> Found:
    """How far peeling goes from a state that it passes, until ``last`` rows are gone in all.

    ``ring`` bounds the values that may go; ``before`` is the length of the stretch that is searched.
    """
    rest = data.where((F.col("x") > start.low) & (F.col("x") < start.high))
    folded = _folded(rest, _edges(rest, start, last - (total - start.n), ring, rule.bins), start.mean)
    sure = _sure_states(folded, start, start.mean, last, total)
    n, least, most = (folded[c].to_numpy() for c in ("n", "least", "most"))
    distinct = np.where(least == most, 1, n)
    bins = len(n)

    def resolve(at: int) -> Found:
        """The stretch from sure state ``at`` to the next one, or to the end."""
        state, i, j = sure[at]
        until = last
        if at + 1 < len(sure):
            after, i2, j2 = sure[at + 1]
            until = min(last, total - after.n)
        else:  # nothing ahead is sure: as many rows from either end as may go
            left, i2, j2 = until - (total - state.n), i, j
            while i2 < bins and n[i:i2].sum() < left:
                i2 += 1
            while j2 < bins and n[bins - j2 : bins - j].sum() < left:
                j2 += 1
        meet = i2 + j2 >= bins
        low = most[i2 - 1] if i2 > i else state.low
        high = least[bins - j2] if j2 > j else state.high
        size = float(distinct[i : bins - j].sum() if meet else distinct[i:i2].sum() + distinct[bins - j2 : bins - j].sum())
        if size > rule.page and size < 0.9 * before:
            return _search(data, state, total, until, rule, (low, high), size)
        x = F.col("x")
        inside = rest.where((x > state.low) & (x < state.high) & (F.lit(meet) | (x <= low) | (x >= high)))
        runs = inside.groupBy("x").agg(F.count("*").alias("cnt"), F.min("i").alias("first"))
        if size > rule.page:
            return _walk_pieces(_Pieces(runs, PIECE_PAGES * rule.page), state, total, until, rule, low, high, meet)
        runs = [tuple(r) for r in runs.orderBy("x").collect()]
        out = Found(ended=total - state.n < until)
        for side, value, count, was, _, good in walk(state, runs, total, until, rule.alpha, rule.stop, None if meet else sum(r[0] <= low for r in runs)):
            if not count:
                out.ended = True
                break
            now = replace(was.without(value, count), **{side: value})
            out.ended = total - now.n < until
            if good:
                whole = next(c for v, c, _ in runs if v == value)
                out.state, out.partial = now, (side, value, count) if count < whole else None
        if out.state:
            out.stretches = [(state, out.state.low, out.state.high)]
        return out

    def sure_verdict(at: int) -> bool | None:
        if at + 1 == len(sure) or total - sure[at + 1][0].n > last:
            return None
        (state, i, j), (after, i2, j2) = sure[at : at + 2]
        return _verdict(state, after, max(state.mean - least[i] if i2 > i else 0.0, most[bins - 1 - j] - state.mean if j2 > j else 0.0), rule.alpha)

    def passed(at: int) -> tuple[State, float, float]:
        return sure[at][0], sure[at + 1][0].low, sure[at + 1][0].high

    out = Found()
    if rule.stop == "first":
        for at in range(len(sure)):
            if total - sure[at][0].n >= last or out.ended:
                break
            if sure_verdict(at):
                out.state, out.partial = sure[at + 1][0], None
                out.stretches.append(passed(at))
                continue
            got = resolve(at)
            out.ended = got.ended
            if got.state:
                out.state, out.partial = got.state, got.partial
                out.stretches += got.stretches
        return out
    for at in reversed(range(len(sure))):
        verdict = sure_verdict(at) if total - sure[at][0].n < last else False
        if verdict is False:
            continue
        got = Found(sure[at + 1][0], stretches=[passed(at)]) if verdict else resolve(at)
        if got.state:
            got.stretches = [passed(b) for b in range(at)] + got.stretches
            return got
    return out


def fit_rosner(
    df: DataFrame, column: str, row_id: str, k: int | None = None, alpha: float = 0.05,
    stop: str = "first", page: int = PAGE, share: float = 0.1, least_rows: int = 25, bins: int = BINS, task_rows: int = TASK_ROWS,
) -> RosnerFit:
    """Sequential extreme studentised deviates, at most k (by default the share of the rows).

    A variable under least_rows has status "too few rows" and flags nothing.
    stop='first' ends at the first step that is not significant, 'esd' runs all k steps
    and keeps the last significant one. ``page`` bounds the distinct values that the
    driver walks at a time (where finer bins no longer split a stretch, it holds a piece
    of ten pages from either end), ``bins`` the bins per tail.
    """
    fit = RosnerFit(column, row_id)
    data = df.select(number(column).alias("x"), F.col(row_id).alias("i")).where(F.col("x").isNotNull())
    fit.total, mean, var = data.agg(F.count("*"), F.avg("x"), F.var_pop("x")).first()
    if fit.total < least_rows:
        fit.status = "too few rows"
        return fit
    last = min(k if k is not None else max(1, int(share * fit.total)), fit.total - 1)
    found = _search(data, State(fit.total, mean, var * fit.total), fit.total, last, Rule(alpha, stop, page, bins))
    if found.state is None:
        return fit
    state = found.state
    fit.removed, fit.stretches = fit.total - state.n, found.stretches
    fit.low = (state.low, None) if state.low > -math.inf else None
    fit.high = (state.high, None) if state.high < math.inf else None
    if found.partial:  # the limit falls within copies of a value: the first of them by row_id go
        side, value, count = found.partial
        ranks = ranked_values(data.where(F.col("x") == value), ["x"], "i", task_rows)
        at = ranks.where((F.col("below") < count) & (F.col("below") + F.col("cnt") >= count)).first()["i"]
        setattr(fit, side, (value, at))
    return fit


def rosner_steps(df: DataFrame, fit: RosnerFit, alpha: float = 0.05, task_rows: int = TASK_ROWS) -> DataFrame:
    """Every peeled row of a fit: variable, step, row_id, value, statistic, critical, p_value."""
    spark, row_id, total = df.sparkSession, fit.row_id, fit.total
    shape = f"variable string, step int, `{row_id}` {df.schema[row_id].dataType.simpleString()}, value double, statistic double, critical double, p_value double"
    if not fit.stretches:
        return spark.createDataFrame([], shape)
    data = df.select(number(fit.column).alias("x"), F.col(row_id).alias("i")).where(F.col("x").isNotNull())
    starts = [s for s, _, _ in fit.stretches]
    lows, highs = [low for _, low, _ in fit.stretches], [high for _, _, high in fit.stretches]
    ends = [total - s.n for s in starts[1:]] + [fit.removed]
    gone = data.where((F.col("x") <= lows[-1]) | (F.col("x") >= highs[-1]))

    def place(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        # A value belongs to the first stretch whose end reaches it; ends move inwards.
        for f in frames:
            x = f["x"].to_numpy()
            up = np.searchsorted(-np.array(highs), -x, side="left")
            yield f.assign(stretch=np.where(x <= lows[-1], np.searchsorted(lows, x, side="left"), up))

    def steps(f: pd.DataFrame) -> pd.DataFrame:
        at = int(f["stretch"].iloc[0])
        runs = sorted(zip(f["x"].tolist(), f["cnt"].tolist(), f["first"].tolist()))
        split = sum(r[0] <= lows[at] for r in runs)
        out = [(value, count, was.n, was.mean, was.squares) for _, value, count, was, _, _ in walk(starts[at], runs, total, ends[at], split=split)]
        return pd.DataFrame(out, columns=["x", "taken", "n", "mean", "squares"])

    placed = gone.groupBy("x").agg(F.count("*").alias("cnt"), F.min("i").alias("first")).mapInPandas(
        place, f"x double, cnt long, first {df.schema[row_id].dataType.simpleString()}, stretch long"
    )
    runs = cut_lineage(placed.groupBy("stretch").applyInPandas(steps, "x double, taken long, n long, mean double, squares double"))
    # Copies of a value are numbered by exact ranks of their ids.
    ranks = ranked_values(gone, ["x"], "i", task_rows).select("x", "i", F.col("below").alias("r"))
    rows = ranks.join(broadcast_if_small(runs), "x").where("r < taken")
    gap = F.abs(F.col("x") - F.col("mean"))
    left = F.col("n") - F.col("r")
    squares = F.greatest(F.lit(0.0), F.col("squares") - F.col("r") * gap * gap * F.col("n") / left)
    rows = rows.select(
        F.lit(fit.column).alias("variable"), (F.lit(total) - left + 1).cast("int").alias("step"), F.col("i").alias(row_id), F.col("x").alias("value"),
        (gap * F.col("n") / left / F.sqrt(squares / (left - 1))).alias("statistic"), left.alias("m"),
    )
    t = F.col("statistic") * F.sqrt(F.col("m") / (F.col("m") - 2 + F.col("statistic") * F.col("statistic")))
    tail = scalar_function(lambda x, m: special.t_sf(x, int(m) - 2), t, F.col("m").cast("double"))
    limit = scalar_function(lambda m: critical(int(m), alpha), F.col("m").cast("double"))
    return rows.select("variable", "step", row_id, "value", "statistic", limit.alias("critical"), F.least(F.lit(1.0), 2.0 * tail * F.col("m")).alias("p_value"))


def rosner_report(df: DataFrame, columns, row_id: str, k: int | None = None, alpha: float = 0.05, **settings) -> DataFrame:
    """Every peeled row of every column: variable, step, row_id, value, statistic, critical, p_value."""
    out = None
    for c in columns:
        steps = rosner_steps(df, fit_rosner(df, c, row_id, k, alpha, **settings), alpha)
        out = steps if out is None else out.unionByName(steps)
    return out
