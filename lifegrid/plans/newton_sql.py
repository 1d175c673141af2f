"""SQL of a whole Cox fit, for holding the Spark fit against: Newton steps over Efron's sums, written out one after the other."""

from __future__ import annotations


def two_sided(z: str) -> str:
    """The two-sided normal p-value: 1 - erf(|z| / sqrt 2) by the series of positive terms."""
    x = f"(abs({z}) / sqrt(2))"
    return f"greatest(0, 1 - 2 / sqrt(pi()) * exp(-{x} * {x}) * list_sum(list_transform(range(400), lambda n: exp(ln({x}) + n * ln(4 * {x} * {x}) + lgamma(n + 1) - lgamma(2 * n + 2)))))"


def cox_sql(cte: str, table: str, columns: dict[str, str], steps: int = 6, quantile: str = "1.959963984540054") -> str:
    """term, beta, hazard_ratio, ci_lower, ci_upper, std_error, z, p_value of an Efron fit of the columns (name: SQL) of a
    table with time and event."""
    names, exprs = list(columns), list(columns.values())
    p = len(names)
    r, pairs = range(p), [(i, j) for i in range(p) for j in range(i + 1)]
    out = [
        cte,
        f"raw AS MATERIALIZED (SELECT time, event, {', '.join(f'CAST({e} AS DOUBLE) AS c{i}' for i, e in enumerate(exprs))} FROM {table})",
        f"m AS MATERIALIZED (SELECT {', '.join(f'avg(c{i}) AS m{i}, stddev_pop(c{i}) AS s{i}' for i in r)} FROM raw)",
        f"x AS MATERIALIZED (SELECT time, event, {', '.join(f'(c{i} - m{i}) / s{i} AS x{i}' for i in r)} FROM raw, m)",
        f"b0 AS (SELECT {', '.join(f'0.0::DOUBLE AS b{i}' for i in r)})",
    ]
    terms = ["w", *[f"w * x{i}" for i in r], *[f"w * x{i} * x{j}" for i, j in pairs]]
    at = {pair: 1 + p + k for k, pair in enumerate(pairs)}
    info = lambda i, j: f"i{max(i, j)}_{min(i, j)}"
    for k in range(steps + 1):
        last = k == steps
        eta = " + ".join(f"x{i} * b{i}" for i in r)
        sums = ", ".join(f"sum({t}) AS a{n}, sum(event * {t}) AS e{n}" for n, t in enumerate(terms))
        out.append(f"g{k} AS MATERIALIZED (SELECT time, CAST(sum(event) AS BIGINT) AS d, {', '.join(f'sum(event * x{i}) AS u{i}' for i in r)}, {sums} FROM (SELECT *, exp({eta}) AS w FROM x, b{k}) GROUP BY time)")
        out.append(f"r{k} AS (SELECT d, {', '.join(f'sum(a{n}) OVER w AS a{n}, e{n}' for n in range(len(terms)))} FROM g{k} WINDOW w AS (ORDER BY time DESC ROWS UNBOUNDED PRECEDING))")
        out.append(f"f{k} AS (SELECT {', '.join(f'a{n} - l / d * e{n} AS p{n}' for n in range(len(terms)))} FROM (SELECT *, unnest(range(d))::DOUBLE AS l FROM r{k} WHERE d > 0))")
        means = ", ".join([*[f"(SELECT sum(u{i}) FROM g{k}) - sum(p{i + 1} / p0) AS v{i}" for i in r], *[f"sum(p{at[i, j]} / p0 - p{i + 1} * p{j + 1} / (p0 * p0)) AS {info(i, j)}" for i, j in pairs]])
        out.append(f"s{k} AS MATERIALIZED (SELECT {means} FROM f{k})")
        # Gauss-Jordan on [information | score], at the end on [information | unit matrix]
        width = 2 * p if last else p + 1
        right = lambda i, j: f"{1.0 if i == j - p else 0.0}" if last else f"v{i}"  # noqa: B023, E731
        out.append(f"z{k}_0 AS MATERIALIZED (SELECT {', '.join(f'{info(i, j) if j < p else right(i, j)} AS q{i}_{j}' for i in r for j in range(width))} FROM s{k})")
        for c in r:
            cells = [f"q{i}_{j} / q{c}_{c} AS q{i}_{j}" if i == c else f"q{i}_{j} - q{i}_{c} * q{c}_{j} / q{c}_{c} AS q{i}_{j}" for i in r for j in range(width)]
            out.append(f"z{k}_{c + 1} AS MATERIALIZED (SELECT {', '.join(cells)} FROM z{k}_{c})")
        if not last:
            out.append(f"b{k + 1} AS MATERIALIZED (SELECT {', '.join(f'b{i} + q{i}_{p} AS b{i}' for i in r)} FROM b{k}, z{k}_{p})")
    rows = " UNION ALL ".join(f"SELECT '{n}' AS term, b{i} / s{i} AS beta, sqrt(q{i}_{p + i}) / s{i} AS se FROM b{steps}, z{steps}_{p}, m" for i, n in enumerate(names))
    out.append(f"t AS (SELECT term, beta, se, beta / se AS z FROM ({rows}))")
    return "WITH " + ",\n".join(out) + f"""
SELECT term, round(beta, 9) + 0.0 AS beta, round(exp(beta), 9) AS hazard_ratio, round(exp(beta - {quantile} * se), 9) AS ci_lower, round(exp(beta + {quantile} * se), 9) AS ci_upper,
  round(se, 9) AS std_error, round(z, 9) + 0.0 AS z, round({two_sided('z')}, 9) + 0.0 AS p_value FROM t"""
