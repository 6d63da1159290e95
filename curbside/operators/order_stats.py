"""Exact order statistics of whole columns, without one task that holds all values.

A mergeable sketch brackets each wanted rank between two values, one exact count
tells how many rows lie below, on and between them, and the search goes on
between them. A rank that falls on a bracket's value is found at once, however
many rows share it; otherwise a round leaves some thousandth of the rows. What
is left at the end, ``FEW`` rows at most, is put in order. Every round is two
passes with map-side combining; through the driver go a few numbers a rank.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, functions as F

#: Rows that are put in order by one task.
FEW = 10_000
#: Accuracy of the sketch: a rank is off by one part in so many, at most.
ACCURACY = 10_000


@dataclass
class _Search:
    """A rank looked for among the values between two bounds (both outside; None: no bound)."""

    column: str
    rank: int  # from 0, among all values of the column
    rows: int  # between the bounds
    before: int = 0  # up to the lower bound
    low: float | None = None
    high: float | None = None
    found: float | None = None
    #: Where the sketch has misjudged, the bracket is as many times wider.
    slack: int = 2

    def inside(self) -> Column:
        v = F.col(self.column)
        within = v.isNotNull()
        if self.low is not None:
            within = within & (v > self.low)
        if self.high is not None:
            within = within & (v < self.high)
        return within

    def narrow(self, low: float, high: float, counts: tuple[int, int, int, int]) -> None:
        """Takes counts of the rows below, on ``low``, between, and on ``high``, all within the bounds."""
        below, on_low, between, on_high = counts
        at = self.rank - self.before
        if at < below or at >= below + on_low + between + on_high:
            self.slack *= 8
            if self.slack * 2 < ACCURACY:
                return
            self.low, self.high = (self.low, low) if at < below else (high, self.high)
            self.before, self.rows = (self.before, below) if at < below else (self.before + below + on_low + between + on_high, self.rows - below - on_low - between - on_high)
        elif at < below + on_low:
            self.found = low
        elif at >= below + on_low + between:
            self.found = high
        else:
            self.low, self.high, self.before, self.rows = low, high, self.before + below + on_low, between


def _values(rows: DataFrame, wanted: list[_Search], few: int) -> None:
    while True:
        wide = [s for s in wanted if s.found is None and s.rows > few]
        if not wide:
            break
        shares = [[min(1.0, max(0.0, (s.rank - s.before) / s.rows + side * s.slack / ACCURACY)) for side in (-1, 1)] for s in wide]
        cuts = rows.agg(*[F.percentile_approx(F.when(s.inside(), F.col(s.column)), p, ACCURACY).alias(f"c{i}") for i, (s, p) in enumerate(zip(wide, shares, strict=True))]).first()
        tests = []
        for i, s in enumerate(wide):
            v, (low, high) = F.col(s.column), cuts[i]
            on_high = F.lit(False) if low == high else v == high
            tests += [F.count_if(s.inside() & t) for t in (v < low, v == low, (v > low) & (v < high), on_high)]
        counts = rows.agg(*[t.alias(f"n{i}") for i, t in enumerate(tests)]).first()
        for i, s in enumerate(wide):
            s.narrow(*cuts[i], tuple(counts[4 * i : 4 * i + 4]))
    left = [s for s in wanted if s.found is None]
    if left:
        got = rows.agg(*[F.get(F.sort_array(F.collect_list(F.when(s.inside(), F.col(s.column)))), F.lit(s.rank - s.before)).alias(f"v{i}") for i, s in enumerate(left)]).first()
        for s, v in zip(left, got, strict=True):
            s.found = v


def percentiles(rows: DataFrame, shares: dict[str, list[float]], few: int = FEW) -> dict[tuple[str, float], float | None]:
    """Percentiles of numeric columns by linear interpolation between neighbouring ranks, nulls left out; None where a column has no value."""
    own = rows.select(*[F.col(c).cast("double").alias(c) for c in shares])
    sizes = own.agg(*[F.count(c).alias(c) for c in shares]).first()
    wanted: dict[tuple[str, int], _Search] = {}
    for c, ps in shares.items():
        for p in ps if sizes[c] else []:
            at = p * (sizes[c] - 1)
            for rank in {int(at), min(int(at) + 1, sizes[c] - 1)}:
                wanted.setdefault((c, rank), _Search(c, rank, sizes[c]))
    _values(own, list(wanted.values()), few)
    out = {}
    for c, ps in shares.items():
        for p in ps:
            out[c, p] = None
            if sizes[c]:
                at = p * (sizes[c] - 1)
                low, high = (wanted[c, r].found for r in (int(at), min(int(at) + 1, sizes[c] - 1)))
                out[c, p] = low + (high - low) * (at - int(at))
    return out
