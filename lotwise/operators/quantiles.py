"""Quantiles of many columns: sketched by default, exact by bracketing the rank.

The exact form never sorts, shuffles or gathers the values, and takes three scans
whatever the values are. The first sketches all columns and gives for each wanted
rank two values that enclose it, for a share of the rows that the sketch's error
sets. The second counts what is below and inside each bracket and sketches the
inside, which gives a bracket within the bracket. The third counts the distinct
values there, and the wanted one is read off. Brackets are narrowed by rank and not
by width, so neither the size of the numbers nor a value that fills a third of the
table adds a scan. Counts tell if a bracket misses its rank; only then is there
another scan, over the part beside it.
"""

from __future__ import annotations

import math
from collections.abc import Mapping, Sequence
from dataclasses import dataclass
from decimal import Decimal
from fractions import Fraction

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: One over the rank error of a sketch, the points taken of the sketch of a bracket, and the
#: rows of a bracket below which its values are counted without a bracket inside.
ACCURACY, POINTS, GATHER = 10_000, 500, 100_000
#: Rank errors between a wanted rank and the ends of its bracket.
MARGIN = 3

_WHOLE = (T.LongType, T.DecimalType)


@dataclass
class _Bracket:
    """A column's values from ``low`` to ``high``, one of which has the rank.

    ``below`` rows are less than ``low``. ``inner`` is the bracket within, once it is
    known; one that has missed is not tried again, so that each bracket comes to an end.
    """

    name: str
    rank: int
    low: object
    high: object
    below: int = 0
    inner: tuple | None = None
    missed: bool = False
    value: object = None


def _kind(df: DataFrame, name: str) -> T.DataType:
    return df.schema[name].dataType


def _number(df: DataFrame, name: str) -> Column:
    """The column with NaN as null; floats as doubles, which hold them exactly."""
    value = F.col(name)
    if isinstance(_kind(df, name), (T.DoubleType, T.FloatType)):
        value = value.cast("double")
        return F.when(~F.isnan(value), value)
    return value


def _compared(kind: T.DataType) -> T.DataType:
    """The type that values of a column are compared in."""
    return T.DoubleType() if isinstance(kind, T.FloatType) else kind


def _literal(value, kind: T.DataType) -> Column:
    return F.lit(value).cast(_compared(kind))


def _ends(low, high, kind: T.DataType) -> tuple:
    """A sketch's values as ends: it keeps doubles, so ends of longer numbers are moved out by its rounding."""
    if not isinstance(kind, _WHOLE):
        return low, high
    reach = lambda v: abs(v) / 2**50 + 1
    if isinstance(kind, T.LongType):
        return max(low - int(reach(low)), -(2**63)), min(high + int(reach(high)), 2**63 - 1)
    digits = Decimal(10) ** -kind.scale
    grid = lambda v: v.quantize(digits)
    return grid(low - abs(low) / 2**50 - digits), grid(high + abs(high) / 2**50 + digits)


def _parsed(text: str, kind: T.DataType):
    if isinstance(kind, T.DecimalType):
        return Decimal(text)
    return float(text) if isinstance(kind, (T.DoubleType, T.FloatType)) else int(text)


def _inside(value: Column, low, high, kind: T.DataType) -> Column:
    return (value >= _literal(low, kind)) & (value <= _literal(high, kind))


def _count_brackets(df: DataFrame, brackets: Sequence[_Bracket], ends: Mapping[str, tuple]) -> list[_Bracket]:
    """Count below and inside every bracket in one scan; those that are still to be counted come back."""
    shares = [i / POINTS for i in range(POINTS + 1)]
    asked = []
    for i, b in enumerate(brackets):
        kind, value = _kind(df, b.name), _number(df, b.name)
        within = _inside(value, b.low, b.high, kind)
        asked += [
            F.count_if(value < _literal(b.low, kind)).alias(f"below_{i}"),
            F.count_if(within).alias(f"inside_{i}"),
            F.percentile_approx(F.when(within, value), shares, ACCURACY).alias(f"points_{i}"),
        ]
    found, again = df.agg(*asked).first(), []
    for i, b in enumerate(brackets):
        below, inside, points = (found[f"{n}_{i}"] for n in ("below", "inside", "points"))
        if not below < b.rank <= below + inside:  # the bracket misses the rank: go on beside it
            first, last = ends[b.name]
            b.low, b.high = (first, b.low) if b.rank <= below else (b.high, last)
            again.append(b)
            continue
        b.below = below
        if b.low == b.high:
            b.value = b.low
        elif inside > GATHER and not b.missed:
            share, off = (b.rank - below) / inside, MARGIN / ACCURACY
            at = max(math.floor((share - off) * POINTS) - 1, 0), min(math.ceil((share + off) * POINTS) + 1, POINTS)
            low, high = _ends(points[at[0]], points[at[1]], _kind(df, b.name))
            low, high = max(low, b.low), min(high, b.high)
            if low > high:
                continue
            if inside * (at[1] - at[0]) / POINTS > 4 * GATHER and (low, high) != (b.low, b.high):
                b.low, b.high = low, high
                again.append(b)
            else:
                b.inner = low, high
    return again


def _gather_brackets(df: DataFrame, brackets: Sequence[_Bracket]) -> list[_Bracket]:
    """Count the distinct values inside each bracket's bracket in one scan; what missed comes back."""
    cells = []
    for i, b in enumerate(brackets):
        kind, value = _kind(df, b.name), _number(df, b.name)
        low, high = b.inner or (b.low, b.high)
        # Rows between the lower ends are counted together, as null.
        text = F.when(value >= _literal(low, kind), (value + F.lit(0).cast(_compared(kind))).cast("string"))
        cells.append(F.when(_inside(value, b.low, high, kind), F.struct(F.lit(i).alias("i"), text.alias("v"))))
    met = df.select(F.explode(F.array_compact(F.array(*cells))).alias("cell")).groupBy("cell").agg(F.count(F.lit(1)).alias("n"))
    counts: list[list[tuple]] = [[] for _ in brackets]
    for (i, text), n in met.collect():
        counts[i].append((text, n))
    again = []
    for b, rows in zip(brackets, counts):
        kind = _kind(df, b.name)
        passed = b.below + sum(n for text, n in rows if text is None)
        if b.rank <= passed:
            b.high, b.inner, b.missed = b.inner[0], None, True
            again.append(b)
            continue
        for value, n in sorted((_parsed(text, kind), n) for text, n in rows if text is not None):
            passed += n
            if b.rank <= passed:
                b.value = value
                break
        else:
            b.low, b.inner, b.missed = b.inner[1], None, True
            again.append(b)
    return again


def exact_quantiles_of(
    df: DataFrame, wanted: Mapping[str, Sequence[float]], interpolate: bool = False
) -> dict[str, list[float | None]]:
    """Exact quantiles of numeric columns, nulls and NaN left out; all columns in the same scans.

    Without ``interpolate``: the smallest value whose share of rows at or below
    reaches the probability. With it: the linear form between the neighbours.
    """
    off, asked = MARGIN / ACCURACY, []
    for i, (name, probs) in enumerate(wanted.items()):
        value = _number(df, name)
        around = [min(max(p + side, 0.0), 1.0) for p in map(float, probs) for side in (-off, off)]
        asked += [
            F.count(value).alias(f"n_{i}"), F.min(value).alias(f"min_{i}"), F.max(value).alias(f"max_{i}"),
            F.percentile_approx(value, around or [0.5], ACCURACY).alias(f"points_{i}"),
        ]
    first = df.agg(*asked).first()
    brackets: dict[tuple[str, int], _Bracket] = {}
    places: dict[str, list[tuple[int, int, Fraction]]] = {}
    ends, counting = {}, []
    for i, (name, probs) in enumerate(wanted.items()):
        n, low, high, points = (first[f"{f}_{i}"] for f in ("n", "min", "max", "points"))
        ends[name], places[name] = (low, high), []
        for k, p in enumerate(Fraction(str(p)) for p in probs):
            if not n:
                continue
            at = p * (n - 1) if interpolate else Fraction(max(math.ceil(p * n), 1) - 1)
            lower, upper = math.floor(at) + 1, math.ceil(at) + 1
            places[name].append((lower, upper, at - math.floor(at)))
            for rank in (lower, upper):
                if (name, rank) in brackets:
                    continue
                bracket = brackets[name, rank] = _Bracket(name, rank, low, high)
                if n > GATHER:
                    bracket.low, bracket.high = _ends(points[2 * k], points[2 * k + 1], _kind(df, name))
                    counting.append(bracket)
    gathering = list(brackets.values())
    while counting or gathering:
        while counting:
            counting = _count_brackets(df, counting, ends)
        gathering = [b for b in gathering if b.value is None]
        counting = _gather_brackets(df, gathering) if gathering else []
        gathering = counting
    found: dict[str, list[float | None]] = {}
    for name, probs in wanted.items():
        if not places[name]:
            found[name] = [None] * len(probs)
            continue
        pairs = [(float(brackets[name, a].value), float(brackets[name, b].value), share) for a, b, share in places[name]]
        found[name] = [a if not share else a + (b - a) * float(share) for a, b, share in pairs]
    return found


def exact_quantiles(
    df: DataFrame, name: str, probs: Sequence[float], interpolate: bool = False
) -> list[float | None]:
    """``exact_quantiles_of`` one column."""
    return exact_quantiles_of(df, {name: probs}, interpolate)[name]


def quantiles_of(
    df: DataFrame, wanted: Mapping[str, Sequence[float]], rel_err: float = 0.01, interpolate: bool = False
) -> dict[str, list[float | None]]:
    """Quantiles of several columns, nulls and NaN left out; ``rel_err`` 0 asks for the exact ones.

    Sketches of all columns are one scan, and one aggregation.
    """
    if rel_err <= 0:
        return exact_quantiles_of(df, wanted, interpolate)
    accuracy = max(math.ceil(1 / rel_err), 1)
    sketches = [F.percentile_approx(_number(df, n), list(p), accuracy).alias(f"_{i}") for i, (n, p) in enumerate(wanted.items())]
    row = df.agg(*sketches).first()
    return {
        name: [None] * len(probs) if found is None else [float(v) for v in found]
        for (name, probs), found in zip(wanted.items(), row)
    }


def quantiles(
    df: DataFrame,
    name: str,
    probs: Sequence[float],
    rel_err: float = 0.01,
    interpolate: bool = False,
) -> list[float | None]:
    """``quantiles_of`` one column."""
    return quantiles_of(df, {name: probs}, rel_err, interpolate)[name]


def approx_quantiles(
    df: DataFrame, names: Sequence[str] | Mapping[str, Sequence[float]], probs: Sequence[float] = (), rel_err: float = 0.01
) -> DataFrame:
    """Quantiles of several columns, one row per column and probability.

    ``names`` may give each column its own probabilities. All columns share the scans.
    """
    wanted = names if isinstance(names, Mapping) else {n: probs for n in names}
    found = quantiles_of(df, wanted, rel_err)
    rows = [(name, float(p), v) for name, ps in wanted.items() for p, v in zip(ps, found[name])]
    return df.sparkSession.createDataFrame(rows, "column_name string, probability double, value double")
