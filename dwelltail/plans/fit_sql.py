"""SQL text of the fitting and scoring expressions, as chained table expressions."""

from __future__ import annotations

from dwelltail.functions import special
from dwelltail.operators import fit, mixture_em
from dwelltail.plans.registry import level_list

K = 3
BULK = 2


def _poly(x: str, num: tuple, den: tuple) -> str:
    top, bottom = f"({num[-1]!r}::double * {x})", x
    for a, b in zip(num[:-2], den[:-1]):
        top, bottom = f"(({top} + {a!r}::double) * {x})", f"(({bottom} + {b!r}::double) * {x})"
    return f"(({top} + {num[-2]!r}::double) / ({bottom} + {den[-1]!r}::double))"


def erfc_sql(x: str) -> str:
    near = f"1.0::double - x * {_poly('(x * x)', special.ERF_NUM, special.ERF_DEN)}"
    mid = f"exp(-abs(x) * abs(x)) * {_poly('abs(x)', special.MID_NUM, special.MID_DEN)}"
    inverse = "(1.0::double / (x * x))"
    far = (
        f"exp(-abs(x) * abs(x)) * ({special.INV_SQRT_PI!r}::double - {inverse} * "
        f"{_poly(inverse, special.FAR_NUM, special.FAR_DEN)}) / abs(x)"
    )
    outer = f"(case when abs(x) <= 4.0 then {mid} when abs(x) < 27.0 then {far} else 0.0::double end)"
    body = (
        f"case when abs(x) <= 0.46875 then {near} when x > 0 then {outer} else 2.0::double - {outer} end"
    )
    return f"list_transform([({x})::double], lambda x: {body})[1]"


def phi(y: str, m: str, s: str) -> str:
    return f"(exp(-0.5 * (({y}) - {m}) * (({y}) - {m}) / ({s} * {s})) / ({s} * {special.SQRT_2PI!r}::double))"


def normal_tail_sql(y: str, m: str, s: str) -> str:
    return f"(0.5::double * {erfc_sql(f'(({y}) - {m}) / ({s} * {special.SQRT2!r}::double)')})"


def normal_cdf_sql(y: str, m: str, s: str) -> str:
    return f"(0.5::double * {erfc_sql(f'({m} - ({y})) / ({s} * {special.SQRT2!r}::double)')})"


def mix(k: int, term) -> str:
    return "(" + " + ".join(f"w{i} * {term(f'm{i}', f's{i}')}" for i in range(k)) + ")"


def gmm_pdf_sql(y: str, k: int) -> str:
    return mix(k, lambda m, s: phi(y, m, s))


def gmm_tail_sql(y: str, k: int) -> str:
    return mix(k, lambda m, s: normal_tail_sql(y, m, s))


def bulk_tail_sql(y: str, k: int = BULK) -> str:
    return f"(1 - ({' + '.join(f'w{i}' for i in range(k))}) + {gmm_tail_sql(y, k)})"


def gpd_tail_sql(z: str) -> str:
    return (
        f"(case when abs(xi) < 1e-8 then exp(-({z}) / beta) when 1 + xi * ({z}) / beta > 0 "
        f"then pow(1 + xi * ({z}) / beta, -1 / xi) else 0.0 end)"
    )


def gpd_pdf_sql(z: str) -> str:
    return (
        f"(case when abs(xi) < 1e-8 then exp(-({z}) / beta) / beta when 1 + xi * ({z}) / beta > 0 "
        f"then pow(1 + xi * ({z}) / beta, -(xi + 1) / xi) / beta else 0.0 end)"
    )


def emm_tail_sql(y: str, k: int = BULK) -> str:
    return f"(case when ({y}) > u then norm * {gpd_tail_sql(f'({y}) - u')} else {bulk_tail_sql(y, k)} end)"


def emm_pdf_sql(y: str, k: int = BULK) -> str:
    return f"(case when ({y}) > u then norm * {gpd_pdf_sql(f'({y}) - u')} else {gmm_pdf_sql(y, k)} end)"


def em_sql(source: str, keys: list[str], k: int, name: str, value: str = "y", tail: str | None = None, starts: str | None = None) -> str:
    """Chain ending in a table ``name``: keys, n, w0.., m0.., s0.. where each state is settled (a recursive chain).

    A row of the recursion holds the point of the next plain step (``cur``: weights, means, deviations) and its phase: a step from the
    cycle's start, a second one with the leap along both, and a step from there. ``tail`` names a table (keys, u, n_tail) for a fit to the rows up to u with the
    others counted only; ``starts`` one with keys, n, v, qs (else taken from the rows).
    """
    by = ", ".join(keys)
    each = range(k)
    extra = ", u, n_tail" if tail else ""
    w, m, s = ([f"cur[{part * k + i + 1}]" for i in each] for part in range(3))
    logs = ", ".join(f"ln(greatest({w[i]}, 1e-300)) - ln({s[i]}) - 0.5 * pow(({value} - {m[i]}) / {s[i]}, 2) as l{i}, {value} - {m[i]} as x{i}" for i in each)
    top = f"greatest({', '.join(f'l{i}' for i in each)})"
    whole = " + ".join(f"exp(l{i} - top)" for i in each)
    sums = ", ".join(f"sum(exp(l{i} - top) / t) as n{i}, sum(exp(l{i} - top) / t * x{i}) as a{i}, sum(exp(l{i} - top) / t * x{i} * x{i}) as b{i}" for i in each)
    carried = "n, v, step, phase, cur, start, other, best" + extra
    parts, likelihood = "", "l"
    n_of, a_of, b_of = ([f"{c}{i}" for i in each] for c in "nab")
    if tail:
        parts = ", " + ", ".join(
            f"{w[i]} * {normal_tail_sql('u', m[i], s[i])} as t{i}, (u - {m[i]}) / {s[i]} as z{i}, "
            f"case when {normal_tail_sql('u', m[i], s[i])} > 1e-290 then {s[i]} * {phi('u', m[i], s[i])} / "
            f"{normal_tail_sql('u', m[i], s[i])} else greatest((u - {m[i]}) / {s[i]}, 0.0) end as h{i}"
            for i in each
        )
        above = "(" + " + ".join(f"t{i}" for i in each) + ")"
        mine = [f"(n_tail * case when {above} > 0 then t{i} / {above} else {1.0 / k!r} end)" for i in each]
        n_of = [f"(n{i} + {mine[i]})" for i in each]
        a_of = [f"(a{i} + {mine[i]} * {s[i]} * h{i})" for i in each]
        b_of = [f"(b{i} + {mine[i]} * {s[i]} * {s[i]} * (1 + z{i} * h{i}))" for i in each]
        likelihood = f"(l + n_tail * case when {above} > 0 then ln({above}) else {mixture_em.LOWEST_LOG} end)"
    floor = f"{mixture_em.VARIANCE_FLOOR!r}::double * v"
    means = [f"case when {n_of[i]} > 1e-12 then {m[i]} + {a_of[i]} / {n_of[i]} else {m[i]} end" for i in each]
    widths = [
        f"case when {n_of[i]} > 1e-12 then sqrt(greatest({b_of[i]} / {n_of[i]} - ({a_of[i]} / {n_of[i]}) * ({a_of[i]} / {n_of[i]}), {floor})) else {s[i]} end" for i in each
    ]
    moved = ", ".join([f"{n_of[i]} / n" for i in each] + means + widths)

    def moves(old: str, new: str) -> str:
        parts = [f"{new}[{i + 1}] - {old}[{i + 1}]" for i in each]
        parts += [f"{new}[{i + 1}] * ({new}[{k + i + 1}] - {old}[{k + i + 1}]) / sqrt(v)" for i in each]
        parts += [f"{new}[{i + 1}] * (ln({new}[{2 * k + i + 1}]) - ln({old}[{2 * k + i + 1}]))" for i in each]
        return f"[{', '.join(parts)}]"

    def along(x: str, y: str, z: str) -> str:
        return f"({x} + 2 * far * ({y} - {x}) + far * far * ({z} - 2 * {y} + {x}))"

    weights = [f"greatest({along(*(f'{t}[{i + 1}]' for t in ('start', 'cur', 'new')))}, {mixture_em.LEAST_WEIGHT!r})" for i in each]
    kept = " + ".join(f"new[{i + 1}]" for i in each)
    spots = [along(*(f"{t}[{k + i + 1}]" for t in ("start", "cur", "new"))) for i in each]
    low, high = f"(0.5 * ln(v) + 0.5 * ln({mixture_em.VARIANCE_FLOOR!r}::double))", f"(0.5 * ln(v) + {mixture_em.WIDEST})"
    spread = [f"exp(least(greatest({along(*(f'ln({t}[{2 * k + i + 1}])' for t in ('start', 'cur', 'new')))}, {low}), {high}))" for i in each]
    inside = f" where {value} <= u" if tail else ""
    joined = f" join {tail} using ({by})" if tail else ""
    own = f"""{name}_q as (select {by}, count(*) as n, var_pop({value}) as v, quantile_disc({value}, {level_list([(i + 0.5) / k for i in each])}) as qs
  from {source} group by {by}),
 """
    begin = ", ".join([f"{1.0 / k!r}::double" for _ in each] + [f"qs[{i + 1}]::double" for i in each] + ["sqrt(v)" for _ in each])
    return f"""{own if starts is None else ""}{name}_e as (select {by}, n, v, 0 as step, 0 as phase, [{begin}] as cur, [{begin}] as start, [{begin}] as other,
  -1e308::double as best, false as done{extra} from {starts or f"{name}_q"}{joined} where n >= {10 * k} and v > 0
 union all
 select {by}, n, v, step, (phase + 1) % 3, case phase when 0 then new when 2 then (case when ll >= best then new else other end)
   else [{", ".join([f"w{i} / ({' + '.join(f'w{j}' for j in each)}) * ({kept})" for i in each] + spots + spread)}] end,
  case phase when 0 then cur else start end, case phase when 1 then new else other end, case phase when 1 then ll else best end,
  phase = 0 and (move <= {fit.TOLERANCE!r} or step >= {fit.ITERATIONS}){extra}
 from (select *, {", ".join(f"{weights[i]} as w{i}" for i in each)} from (select *, list_aggregate(list_transform({moves('cur', 'new')}, lambda x: abs(x)), 'max') as move,
   least({mixture_em.LONGEST}, greatest(1.0, coalesce(sqrt(list_sum(list_transform({moves('start', 'cur')}, lambda x: x * x))) / nullif(sqrt(list_sum(list_transform(
    list_zip({moves('start', 'cur')}, {moves('cur', 'new')}), lambda p: (p[2] - p[1]) * (p[2] - p[1])))), 0), 1.0))) as far
  from (select *, [{moved}] as new, {likelihood} as ll
  from (select *{parts} from (select {by}, any_value(n) as n, any_value(v) as v, any_value(step) + 1 as step, any_value(phase) as phase, any_value(cur) as cur,
   any_value(start) as start, any_value(other) as other, any_value(best) as best{", any_value(u) as u, any_value(n_tail) as n_tail" if tail else ""}, {sums},
   sum(top + ln(t)) - {mixture_em.LOG_SQRT_2PI!r} * count(*) as l
  from (select *, {whole} as t from (select *, {top} as top from (select {by}, {value}, {carried}, {logs} from {source} join {name}_e using ({by}) where not done)))
  {inside} group by {by})))))),
 {name} as (select {by}, n, {", ".join(f"cur[{i + 1}] as w{i}, cur[{k + i + 1}] as m{i}, cur[{2 * k + i + 1}] as s{i}" for i in each)} from {name}_e where done)"""


def emm_sql(source: str, keys: list[str], k: int, name: str, level: float = 0.95, thresholds: str | None = None) -> str:
    """Chain ending in ``name``: the mixture columns and n_tail, u, xi, beta, norm; u from a table (keys, u) if one is named."""
    by = ", ".join(keys)
    return ",\n".join(
        [
            f"{name}_u as (select {by}, u from {thresholds})" if thresholds else
            f"{name}_u as (select {by}, quantile_disc(y, {level}) as u from {source} group by {by})",
            f"{name}_z as (select {by}, u, y - u as z from {source} join {name}_u using ({by}) where y > u)",
            f"{name}_m as (select {by}, any_value(u) as u, count(*) as n_tail, avg(z) as zm, var_samp(z) as zv "
            f"from {name}_z group by {by})",
            f"{name}_c as (select {by}, u, n_tail from {name}_m)",
            em_sql(source, keys, k, f"{name}_b", tail=f"{name}_c"),
            f"{name} as (select * replace ({', '.join(f'w{i} * (1 - n_tail / n) / (1 - {gmm_tail_sql(chr(117), k)}) as w{i}' for i in range(k))}), "
            f"n_tail / n as norm, 0.5 * (1 - zm * zm / zv) as xi, "
            f"0.5 * zm * (zm * zm / zv + 1) as beta from {name}_b join {name}_m using ({by}) where n_tail >= 30)",
        ]
    )


def bisect_sql(source: str, keys: list[str], tail: str, target: str, hi: str, name: str) -> str:
    """Recursive table ``name`` (keys and target columns of ``source`` plus ``root``)."""
    by = ", ".join(keys)
    middle = "((lo + hi) / 2)"
    return f"""{name}_r as (select {by}, 0 as step, 0.0::double as lo, ({hi})::double as hi from {source}
 union all
 select {by}, step + 1, case when above then middle else lo end, case when above then hi else middle end
 from (select {", ".join("r." + c for c in keys)}, step, lo, hi, {middle} as middle,
  {tail.replace('@Y@', middle)} > {target} as above
  from {name}_r r join {source} using ({by}) where step < 60)),
 {name} as (select {by}, (lo + hi) / 2 as root from {name}_r where step = 60)"""
