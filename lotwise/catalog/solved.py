"""Least squares on the whole vector, solved in SQL.

Normal equations of all slots, the penalty on their diagonal, and Gauss-Jordan
elimination as a recursive query: one step for each slot, a row of the matrix
as a list. Slot 0 is the intercept, then come the scaled numbers, then the levels
of each category in order, as in the assembled vector.
"""

from __future__ import annotations

from lotwise.catalog.data import KEY
from lotwise.catalog.features import INDEX_SQL, SIZES, SPEC, SPLIT_SQL, _offset

_KEYS = ", ".join(KEY)
_LEVEL_TERMS = " union all ".join(
    f"""select rid, {1 + len(SPEC.numeric)} + {_offset(p)} + ix.i, 1.0::double,
      ix.i = 0 and not exists (select 1 from train where "{c}" is null)
      from numbered t join ix_{c} ix on ix.v = t."{c}", {SIZES}"""
    for p, c in enumerate(SPEC.categorical)
)


def solved_sql(*penalties: float, split: str = SPLIT_SQL) -> str:
    """CTEs for ``with recursive`` over the sides that ``split`` makes: ``beta(reg, k, b)`` and ``fitted(reg, rid, in_train, worth, prediction)``.

    Penalties are as the linear regression takes them, on features of unit
    variance. Without a penalty the first level of a category without nulls is left
    out, as its slots add up to the intercept; that changes no prediction.
    """
    return f"""{split}, {INDEX_SQL},
numbered as (select *, row_number() over (order by {_KEYS}) rid from aged),
moments as (select count(*) n, avg(odometer) m0, stddev_samp(odometer) d0, avg(car_age) m1, stddev_samp(car_age) d1,
  stddev_pop(worth) dy from train),
terms(rid, k, v, is_first) as (select rid, 0, 1.0::double, false from numbered
  union all select rid, 1, (odometer - m0) / d0, false from numbered, moments
  union all select rid, 2, (car_age - m1) / d1, false from numbered, moments
  union all {_LEVEL_TERMS}),
design as (select rid, k, v, in_train, worth from terms join numbered using (rid)),
slots as (select k, bool_or(is_first) is_first, count(*) over () size from terms group by k),
spread as (select k, (sum(v * v) - sum(v) * sum(v) / any_value(n)) / any_value(n) var
  from design, moments where in_train group by k),
pairs as (select a.k i, b.k j, sum(a.v * b.v) v from design a join design b on a.rid = b.rid where a.in_train group by a.k, b.k),
grid as (select * from (values {', '.join(f'({p}::double)' for p in penalties)}) g(reg)),
equations as (
  select reg, s.k i, z.k j, coalesce(p.v, 0) + case when s.k <> z.k or s.k = 0 then 0
    when reg = 0 and s.is_first then 1e18 else n * reg * var / dy end v
  from grid cross join slots s cross join slots z left join pairs p on p.i = s.k and p.j = z.k
    join spread on spread.k = s.k cross join moments
  union all
  select reg, k, (select max(size) from slots), sum(v * worth) from grid, design where in_train group by reg, k),
steps(reg, step, i, r) as (
  select reg, cast(0 as bigint), i, list(v order by j) from equations group by reg, i
  union all
  select e.reg, e.step + 1, e.i, case when e.i = e.step then list_transform(e.r, lambda x: x / e.r[e.step + 1])
    else list_transform(list_zip(e.r, p.r), lambda x: x[1] - x[2] * (e.r[e.step + 1] / p.r[e.step + 1])) end
  from steps e join (select reg, step, i, r from steps) p on p.reg = e.reg and p.step = e.step and p.i = e.step
  where e.step < (select max(size) from slots)),
beta as (select reg, i k, r[(select max(size) from slots) + 1] b from steps where step = (select max(size) from slots)),
fitted as (select reg, rid, any_value(in_train) in_train, any_value(worth) worth, sum(v * b) prediction
  from design join beta using (k) group by reg, rid)"""
