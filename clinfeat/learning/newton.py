"""L2 logistic regression by Newton steps, many fits in one pass over the rows.

A fit is a set of columns, a fold that is left out, an inverse penalty and the coefficients so far. One pass gives every open fit the sums
that its next step needs (gradient and curvature of the loss over its rows, and how many held-out rows it gets right);
they are numbers by columns squared, added up in the tasks and then in two rounds, whatever the number of rows. The steps are solved on the driver.

Two searches are built on it. Elimination follows one path for every fold and one for all rows: from the curvature at one size the next sizes'
columns and coefficients are foretold, all of them are solved together, and a foretold size counts only if the sizes
before it drop the columns that it assumed. The path along penalties starts each strength from the sums of the one before.
"""

from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from clinfeat.operators.ordered import running_totals
from clinfeat.sources.stages import materialize

AHEAD = 8  # sizes that an elimination foretells
MOST_STEPS, SMALLEST_STEP = 60, 1e-8
_FAN = 64


@dataclass
class Fit:
    """``held_out``: fold left out (-1: none). ``beta``: a coefficient for each of ``columns`` and the intercept, which has no penalty.
    ``share``: of the rows of the other folds, those at a position below it."""

    columns: tuple
    held_out: int = -1
    strength: float = 1.0
    beta: np.ndarray | None = None
    loss: float = np.inf
    slope: np.ndarray | None = field(default=None, repr=False)
    curve: np.ndarray | None = field(default=None, repr=False)
    right: float = 0.0
    held: float = 0.0
    share: float = 1.0
    _before: np.ndarray | None = field(default=None, repr=False)

    def __post_init__(self):
        if self.beta is None:
            self.beta = np.zeros(len(self.columns) + 1)

    def penalty(self) -> np.ndarray:
        return np.append(np.full(len(self.columns), 1 / self.strength), 0.0)

    def take(self, sums: np.ndarray) -> bool:
        """Sums at ``beta``; moves ``beta`` by a Newton step. True once the step is small."""
        n = len(self.beta)
        own = 0.5 * float(self.penalty() @ self.beta ** 2)
        loss = sums[0] + own
        if loss > self.loss + 1e-9 * abs(self.loss):  # too far: half the way
            self.beta = (self.beta + self._before) / 2
            return False
        self.loss, self.right, self.held = loss, sums[1], sums[2]
        self.slope = sums[3:3 + n] + self.penalty() * self.beta
        self.curve = sums[3 + n:].reshape(n, n) + np.diag(self.penalty())
        step = _solved(self.curve, -self.slope)
        self._before = self.beta
        self.beta = self.beta + step
        return float(np.abs(step).max(initial=0)) < SMALLEST_STEP * max(1.0, float(np.abs(self.beta).max(initial=0)))

    def without(self, dropped: list) -> "Fit":
        """A fit without some columns, its coefficients foretold from this one's curvature."""
        keep = np.array([c not in dropped for c in self.columns] + [True])
        beta = self.beta.copy()
        change = _solved(self.curve[np.ix_(keep, keep)], -(self.slope[keep] - self.curve[np.ix_(keep, ~keep)] @ self._before[~keep]))
        beta[keep] = self._before[keep] + change
        return Fit(tuple(c for c, k in zip(self.columns, keep) if k), self.held_out, self.strength, beta[keep], share=self.share)

    def at_strength(self, strength: float) -> "Fit":
        """The same rows and columns under another penalty, started by a step from this fit's sums."""
        more = np.append(np.full(len(self.columns), 1 / strength - 1 / self.strength), 0.0)
        step = _solved(self.curve + np.diag(more), -(self.slope + more * self._before))
        return Fit(self.columns, self.held_out, strength, self._before + step, share=self.share)


def _solved(matrix: np.ndarray, right: np.ndarray) -> np.ndarray:
    try:
        return np.linalg.solve(matrix, right)
    except np.linalg.LinAlgError:
        return np.linalg.lstsq(matrix, right, rcond=None)[0]


class Rows:
    """Rows of (fold, label, features) that fits read; each pass is one scan.

    Labels are 0 and 1; rows without a label, a fold or a feature are left out. With ``balanced``, a class weighs n / (2 x its size)
    among the rows of a fit. ``position`` (0 to below 1) is what the share of a fit is cut by; ``shares``: those that fits may have.
    """

    def __init__(self, df: DataFrame, features: list[str], label: str, fold=None, balanced: bool = True, position=None, shares=(1.0,)):
        cells = [F.col(f"`{c}`").cast("double") for c in features]
        fold = F.lit(0) if fold is None else fold
        rows = df.select(fold.cast("int").alias("fold"), F.col(label).cast("int").alias("label"), F.array(*cells).alias("x"), *([] if position is None else [F.coalesce(position.cast("double"), F.lit(float("inf"))).alias("at")]))
        known = F.forall("x", lambda v: v.isNotNull() & ~F.isnan(v))
        self.features = list(features)
        self.rows = materialize(rows.where(F.col("fold").isNotNull() & F.col("label").isin(0, 1) & known), "newton-rows")
        below = [F.count("*") if position is None else F.sum((F.col("at") < s).cast("long")) for s in shares]
        counts = self.rows.groupBy("fold", "label").agg(*[n.alias(f"n{i}") for i, n in enumerate(below)]).collect()
        self.folds = sorted({r["fold"] for r in counts})
        self.weights = {}
        for i, share in enumerate(shares):
            for held in [-1, *self.folds]:
                n = [sum(r[f"n{i}"] for r in counts if r["label"] == y and r["fold"] != held) for y in (0, 1)]
                self.weights[held, share] = tuple(sum(n) / (2 * x) if balanced and x else 1.0 for x in n)

    def sums(self, fits: list[Fit]) -> list[np.ndarray]:
        """For each fit: loss, held-out rows that it gets right, held-out rows, slope, curvature (flat)."""
        asked = [(f.columns, f.held_out, f.beta, self.weights.get((f.held_out, f.share), self.weights[-1, f.share]), f.share) for f in fits]
        width = len(self.features)

        def one(batches):
            totals = [np.zeros(3 + len(b) + len(b) ** 2) for _, _, b, *_ in asked]
            for batch in batches:
                if not batch.num_rows:
                    continue
                x = np.concatenate([batch.column("x").flatten().to_numpy().reshape(-1, width), np.ones((batch.num_rows, 1))], 1)
                y, fold = batch.column("label").to_numpy(), batch.column("fold").to_numpy()
                at = batch.column("at").to_numpy() if "at" in batch.schema.names else np.zeros(batch.num_rows)
                for total, (columns, held, beta, weights, share) in zip(totals, asked):
                    own = x[:, [*columns, width]]
                    z = own @ beta
                    out = fold == held
                    weight = np.where(y == 1, weights[1], weights[0]) * (~out & (at < share))
                    p = 0.5 * (1 + np.tanh(z / 2))
                    n = len(beta)
                    total[0] += (weight * (np.logaddexp(0, z) - y * z)).sum()
                    total[1] += ((z > 0) == (y == 1))[out].sum()
                    total[2] += out.sum()
                    total[3:3 + n] += own.T @ (weight * (p - y))
                    total[3 + n:] += (own.T @ (own * (weight * p * (1 - p))[:, None])).ravel()
            yield pa.RecordBatch.from_arrays(
                [pa.array(np.arange(len(totals), dtype=np.int32)), pa.array([t.tobytes() for t in totals], pa.binary())], ["fit", "sums"]
            )

        def added(group: pa.Table) -> pa.Table:
            total = np.sum([np.frombuffer(s.as_py()) for s in group.column("sums")], axis=0)
            return pa.table({"fit": group.column("fit").slice(0, 1), "sums": pa.array([total.tobytes()], pa.binary())})

        parts = self.rows.mapInArrow(one, "fit int, sums binary")
        if self.rows.rdd.getNumPartitions() > _FAN:
            parts = parts.groupBy("fit", F.pmod(F.spark_partition_id(), F.lit(_FAN))).applyInArrow(added, "fit int, sums binary")
        found = parts.groupBy("fit").applyInArrow(added, "fit int, sums binary").collect()
        return [np.frombuffer(bytes(r["sums"])) for r in sorted(found, key=lambda r: r["fit"])]

    def solve(self, fits: list[Fit]) -> None:
        """Step all fits until their steps are small."""
        open_ = list(fits)
        for _ in range(MOST_STEPS):
            if not open_:
                return
            open_ = [f for f, s in zip(open_, self.sums(open_)) if not f.take(s)]

    def hits(self, fits: list[Fit]) -> DataFrame:
        """(fit, held_out, right, n): of the rows of each fit and of those of the fold it leaves out, how many it gets right; one pass."""
        asked, width = [(f.columns, f.held_out, f.beta, f.share) for f in fits], len(self.features)

        def one(batches):
            for batch in batches:
                x = np.concatenate([batch.column("x").flatten().to_numpy().reshape(-1, width), np.ones((batch.num_rows, 1))], 1)
                y, fold = batch.column("label").to_numpy(), batch.column("fold").to_numpy()
                at = batch.column("at").to_numpy() if "at" in batch.schema.names else np.zeros(batch.num_rows)
                found = []
                for k, (columns, held, beta, share) in enumerate(asked):
                    right = (x[:, [*columns, width]] @ beta > 0) == (y == 1)
                    for out, own in ((True, fold == held), (False, (fold != held) & (at < share))):
                        found.append((k, out, int(right[own].sum()), int(own.sum())))
                yield pa.RecordBatch.from_arrays(
                    [pa.array(c, t) for c, t in zip(zip(*found), (pa.int32(), pa.bool_(), pa.int64(), pa.int64()))], ["fit", "held_out", "right", "n"]
                )

        found = self.rows.mapInArrow(one, "fit int, held_out boolean, right long, n long")
        return found.groupBy("fit", "held_out").agg(F.sum("right").alias("right"), F.sum("n").alias("n"))

    def scored(self, fits: list[Fit]) -> DataFrame:
        """(fit, fold, label, score): the rows that each fit leaves out (all rows where it leaves none), scored by it."""
        asked, width = [(f.columns, f.held_out, f.beta) for f in fits], len(self.features)

        def one(batches):
            for batch in batches:
                x = np.concatenate([batch.column("x").flatten().to_numpy().reshape(-1, width), np.ones((batch.num_rows, 1))], 1)
                fold = batch.column("fold").to_numpy()
                for k, (columns, held, beta) in enumerate(asked):
                    at = np.flatnonzero((fold == held) | (held < 0))
                    score = 0.5 * (1 + np.tanh(x[at][:, [*columns, width]] @ beta / 2))
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(np.full(len(at), k, np.int32)), batch.column("fold").take(pa.array(at)), batch.column("label").take(pa.array(at)), pa.array(score)],
                        ["fit", "fold", "label", "score"],
                    )

        return self.rows.mapInArrow(one, "fit int, fold int, label int, score double")


def fit(df: DataFrame, features: list[str], label: str = "outcome", strength: float = 1.0, balanced: bool = True) -> Fit:
    """One fit on all rows; its ``columns`` are places in ``features``."""
    one = Fit(tuple(range(len(features))), strength=strength)
    Rows(df, features, label, balanced=balanced).solve([one])
    return one


def _weakest(one: Fit, spread: np.ndarray, step: int) -> list:
    """The columns of smallest coefficient times deviation; of equals the first."""
    strength = np.abs(one.beta[:-1]) * spread[list(one.columns)]
    return [one.columns[i] for i in np.lexsort((one.columns, strength))[:step]]


def elimination_path(rows: Rows, spread: np.ndarray, held_out: list[int], step: int = 1, strength: float = 1.0) -> dict[int, list[tuple[Fit, list]]]:
    """For each left-out fold: (solved fit, columns it drops) from all columns down to the last."""
    first = [Fit(tuple(range(len(rows.features))), held, strength) for held in held_out]
    rows.solve(first)
    paths = {f.held_out: [(f, _weakest(f, spread, step))] for f in first}
    while True:
        foretold = {}
        for held, path in paths.items():
            one, gone = path[-1]
            chain, dropped = [], list(gone)
            while len(chain) < AHEAD and len(one.columns) > len(dropped):
                guess = one.without(dropped)
                chain.append(guess)
                dropped += _weakest(guess, spread, step)
            if chain:
                foretold[held] = chain
        if not foretold:
            return paths
        rows.solve([f for chain in foretold.values() for f in chain])
        for held, chain in foretold.items():
            for one in chain:
                last, gone = paths[held][-1]
                if set(one.columns) != set(last.columns) - set(gone):
                    break  # a size before it drops other columns than foretold
                paths[held].append((one, _weakest(one, spread, step)))


def penalty_path(rows: Rows, strengths: list[float], held_out: list[int]) -> list[list[Fit]]:
    """For each inverse penalty, from the smallest: a solved fit for each left-out fold."""
    out, last = [], None
    for strength in sorted(strengths):
        own = [f.at_strength(strength) for f in last] if last else [Fit(tuple(range(len(rows.features))), held, strength) for held in held_out]
        rows.solve(own)
        out.append(own)
        last = own
    return out


def grouped_auc(scored: DataFrame, groups: list[str], label: str = "label", value: str = "score") -> DataFrame:
    """Area under the curve of each group, equal scores counting half; null where a class is missing."""
    counts = scored.groupBy(*groups, (-F.col(value)).alias("_neg")).agg(F.sum(label).alias("pos"), F.sum(1 - F.col(label)).alias("neg"))
    run = running_totals(counts, groups, "_neg", ["pos", "neg"])
    right = F.col("neg") * (F.col("cum_pos") - F.col("pos")) + F.col("neg") * F.col("pos") / 2.0
    return run.groupBy(*groups).agg(F.try_divide(F.sum(right), F.sum("pos").cast("double") * F.sum("neg")).alias("auc"))
