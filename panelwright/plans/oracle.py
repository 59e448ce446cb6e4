"""The same relations in SQL, for the side-by-side check.

``RELATIONS`` are named sub-queries with their inputs; ``with_relations`` puts
the needed ones in front of a body. Nothing here is used by the Spark plans.
"""

from __future__ import annotations

from panelwright.functions.labels import ACCENTED, MONTH_NAMES, PLAIN
from panelwright.functions.reference_data import ENTITIES, ENTITY_CODES, PRODUCT_PREFIX, PRODUCTS
from panelwright.plans import standins as st
from panelwright.plans.pipeline import SCOPE_END, SCOPE_START, SPLIT

RELATIONS: dict[str, tuple[list[str], str]] = {
    name: (st.STANDIN_NEEDS.get(name, []), body) for name, body in st.STANDIN_SQL.items()
}


def relation(name: str, needs: list[str], body: str) -> None:
    RELATIONS[name] = (needs, body)


def with_relations(needs: list[str], body: str) -> str:
    order: list[str] = []

    def visit(name: str) -> None:
        for inner in RELATIONS[name][0]:
            visit(inner)
        if name not in order:
            order.append(name)

    for need in needs:
        visit(need)
    heads = ",\n".join(f"{name} AS ({RELATIONS[name][1]})" for name in order)
    return f"WITH {heads}\n{body}" if heads else body


_DOMAIN = ", ".join(f"'{c}'" for c in ENTITY_CODES)
_NUM = r"'^\s*[+-]?(\d+\.?\d*|\.\d+)([eE][+-]?\d+)?\s*$'"
_INT = r"'^\s*[+-]?\d+\s*$'"


def number(text: str) -> str:
    return f"(CASE WHEN regexp_matches({text}, {_NUM}) THEN TRY_CAST(trim({text}) AS DOUBLE) END)"


def day(text: str) -> str:
    return f"CAST(try_strptime({text}, ['%Y-%m-%d', '%Y-%m']) AS DATE)"


def lagged(value: str, k: int, by: str = "entity, product", month: str = "month") -> str:
    side = "PRECEDING" if k >= 0 else "FOLLOWING"
    n = abs(k)
    return (
        f"max({value}) OVER (PARTITION BY {by} ORDER BY year({month}) * 12 + month({month}) "
        f"RANGE BETWEEN {n} {side} AND {n} {side})"
    )


def pct(now: str, before: str) -> str:
    return f"((({now}) / nullif({before}, 0) - 1) * 100)"


def p_value(r: str, n: str) -> str:
    """Two-sided Student p by the finite sine/cosine series."""
    c = f"sqrt((1 - abs({r})) * (1 + abs({r})))"
    odd = (
        f"2 / pi() * (asin(abs({r})) + CASE WHEN {n} = 3 THEN 0 ELSE abs({r}) * list_sum(list_transform("
        f"range(0, ({n} - 5) // 2 + 1), lambda j: exp(2 * j * ln(2) + 2 * lgamma(j + 1) - lgamma(2 * j + 2)) "
        f"* pow({c}, 2 * j + 1))) END)"
    )
    even = (
        f"abs({r}) * list_sum(list_transform(range(0, ({n} - 4) // 2 + 1), "
        f"lambda j: exp(lgamma(2 * j + 1) - 2 * j * ln(2) - 2 * lgamma(j + 1)) * pow({c}, 2 * j)))"
    )
    return (
        f"CASE WHEN {r} IS NULL OR {n} < 3 THEN NULL WHEN abs({r}) >= 1 THEN 0.0 "
        f"ELSE greatest(0.0, 1 - (CASE WHEN {n} % 2 = 1 THEN {odd} ELSE {even} END)) END"
    )


relation(
    "dirty_checked",
    ["dirty"],
    f"""SELECT *, {day('date_text')} AS d, {number("replace(value_text, ',', '.')")} AS v,
               {number('quantity_text')} AS q,
               NOT regexp_matches(quantity_text, {_INT}) AS bad_int,
               abs({number("replace(value_text, ',', '.')")}) >= 1e18 OR
               regexp_matches(quantity_text, {_INT}) AND TRY_CAST(quantity_text AS BIGINT) IS NULL AS too_large,
               coalesce(entity NOT IN ({_DOMAIN}), true) AS bad_entity
        FROM dirty""",
)
relation(
    "dirty_classified",
    ["dirty_checked"],
    f"""SELECT *, CASE WHEN bad_entity THEN 'bad_entity'
                    WHEN d IS NULL OR v IS NULL OR bad_int THEN 'bad_type'
                    WHEN too_large THEN 'number_too_large'
                    WHEN d > DATE '{st.AS_OF}' THEN 'date_out_of_range'
                    WHEN v < 0 OR (q < 0 AND q <> -1) THEN 'negative_value' END AS reason
        FROM dirty_checked""",
)
relation(
    "dirty_staged",
    ["dirty_classified"],
    f"""SELECT *, CASE
                 WHEN _source_object <> max(_source_object) OVER (PARTITION BY split_part(_source_object, '@', 1))
                 THEN 'superseded_version'
                 WHEN NOT starts_with(product, '{PRODUCT_PREFIX}') THEN 'product_out_of_scope'
                 WHEN date_trunc('month', d) NOT BETWEEN DATE '{SCOPE_START}' AND DATE '{SCOPE_END}'
                 THEN 'month_out_of_scope'
                 WHEN reason IS NOT NULL THEN 'quarantined' ELSE 'aggregated' END AS stage
        FROM dirty_classified""",
)
relation(
    "day_state",
    ["readings"],
    f"""SELECT day, read_at, CASE WHEN low = high THEN low END AS value_text,
               coalesce(low <> high, false) AS ambiguous, n AS tied_readings, readings - n AS older_readings
        FROM (
            SELECT day, read_at, min(value_text) AS low, max(value_text) AS high, count(*) AS n,
                   any_value(readings) AS readings
            FROM (
                SELECT substr(coalesce(date_text, ''), 1, 10) AS day, value_text, read_at,
                       max(read_at) OVER (PARTITION BY substr(coalesce(date_text, ''), 1, 10)) AS last_at,
                       count(*) OVER (PARTITION BY substr(coalesce(date_text, ''), 1, 10)) AS readings
                FROM readings WHERE _source_object = '{st.SERIES}'
            ) WHERE read_at = last_at GROUP BY day, read_at
        )""",
)
relation(
    "day_classified",
    ["day_state"],
    f"""SELECT *, {day('day')} AS date, {number('value_text')} AS number,
               CASE WHEN ambiguous THEN 'duplicate_key'
                    WHEN {day('day')} IS NULL OR {number('value_text')} IS NULL THEN 'bad_type'
                    WHEN {number('value_text')} < 0 THEN 'negative_value' END AS reason
        FROM day_state""",
)
relation(
    "month_ends",
    ["day_classified"],
    """SELECT CAST(date_trunc('month', date) AS DATE) AS month, arg_max(number, date) AS rate
       FROM day_classified WHERE reason IS NULL GROUP BY ALL""",
)
relation(
    "series",
    ["month_ends"],
    f"""SELECT month, rate FROM month_ends
        WHERE month BETWEEN DATE '{SCOPE_START}' AND DATE '{SCOPE_END}'
          AND month < date_trunc('month', DATE '{st.AS_OF}')""",
)
relation(
    "market_series",
    ["panel_a"],
    """SELECT month, CAST(sum(CAST(value AS DECIMAL(30,2))) AS DOUBLE) / 1000000 AS rate
       FROM panel_a GROUP BY month""",
)


def _lags(source: str) -> str:
    dense = (
        f"SELECT CAST(m AS DATE) AS month, s.rate FROM "
        f"(SELECT unnest(generate_series((SELECT min(month) FROM {source})::TIMESTAMP, "
        f"(SELECT max(month) FROM {source})::TIMESTAMP, INTERVAL 1 MONTH)) AS m) "
        f"LEFT JOIN {source} s ON s.month = CAST(m AS DATE)"
    )
    lags = ", ".join(f"lag(rate, {k}) OVER (ORDER BY month) AS rate_lag_{k}" for k in range(1, 7))
    return (
        f"SELECT * FROM (SELECT month, rate, rate - lag(rate, 1) OVER (ORDER BY month) AS rate_change, {lags} "
        f"FROM ({dense})) WHERE rate IS NOT NULL"
    )


relation("series_lagged", ["series"], _lags("series"))
relation("market_lagged", ["market_series"], _lags("market_series"))


def changes(source: str) -> str:
    before = "lag({c}) OVER (PARTITION BY entity, product ORDER BY month)"
    pm, pv, pq = (before.format(c=c) for c in ("month", "value", "qty_disclosed"))
    return f"""SELECT month, entity, product, qty_disclosed, masked_rows, value, has_prev,
               CASE WHEN has_prev AND pq > 0 THEN {pct('CAST(qty_disclosed AS DOUBLE)', 'CAST(pq AS DOUBLE)')} END AS qty_change_pct,
               CASE WHEN has_prev THEN {pct('value', 'pv')} END AS value_change_pct
        FROM (SELECT *, coalesce({pm} = CAST(month - INTERVAL 1 MONTH AS DATE), false) AS has_prev,
                     {pv} AS pv, {pq} AS pq FROM {source})"""


def _gold(panel: str, lags: str) -> str:
    cols = ", ".join(f"rate_lag_{k}" for k in range(1, 7))
    return f"SELECT c.*, s.rate, s.rate_change, {cols} FROM ({changes(panel)}) c JOIN {lags} s ON c.month = s.month"


relation("gold", ["panel_a", "series_lagged"], _gold("panel_a", "series_lagged"))
relation("market_gold", ["panel_a", "market_lagged"], _gold("panel_a", "market_lagged"))

for prefix, source in (("", "gold"), ("market_", "market_gold")):
    relation(
        f"{prefix}national",
        [source],
        f"""SELECT product, month, value, has_prev, CASE WHEN has_prev THEN {pct('value', 'pv')} END AS value_change_pct
            FROM (SELECT *, coalesce(lag(month) OVER w = CAST(month - INTERVAL 1 MONTH AS DATE), false) AS has_prev,
                         lag(value) OVER w AS pv
                  FROM (SELECT product, month, CAST(sum(CAST(value AS DECIMAL(30,2))) AS DOUBLE) AS value
                        FROM {source} GROUP BY ALL)
                  WINDOW w AS (PARTITION BY product ORDER BY month))""",
    )
    relation(
        f"{prefix}rate_change",
        [source],
        f"SELECT month, max(rate_change) AS rate_change FROM {source} GROUP BY month",
    )
    relation(
        f"{prefix}pairs",
        [f"{prefix}national", f"{prefix}rate_change"],
        f"""SELECT n.product, n.month, k.lag, n.value_change_pct AS y, s.rate_change AS x
            FROM {prefix}national n CROSS JOIN (SELECT unnest(range(0, 7)) AS lag) k
            LEFT JOIN {prefix}rate_change s ON s.month = CAST(n.month - to_months(CAST(k.lag AS INTEGER)) AS DATE)""",
    )


def correlated(pairs: str, by: str) -> str:
    """Pair count, Spearman and Pearson per group, constants and short groups as NULL."""
    ok = "x IS NOT NULL AND y IS NOT NULL"
    ranked = f"""SELECT *, rank() OVER (PARTITION BY {by} ORDER BY x) + (count(*) OVER (PARTITION BY {by}, x) - 1) / 2.0 AS rx,
                        rank() OVER (PARTITION BY {by} ORDER BY y) + (count(*) OVER (PARTITION BY {by}, y) - 1) / 2.0 AS ry
                 FROM {pairs} WHERE {ok}"""
    fields = [f.strip() for f in by.split(",")]
    same = " AND ".join(f"g.{f} IS NOT DISTINCT FROM c.{f}" for f in fields)
    keys = ", ".join(f"g.{f}" for f in fields)
    varies = "count(*) >= 3 AND min(x) < max(x) AND min(y) < max(y)"
    return f"""SELECT {keys}, CAST(coalesce(c.n, 0) AS BIGINT) AS n_months, c.spearman, c.pearson
        FROM (SELECT DISTINCT {by} FROM {pairs}) g LEFT JOIN (
            SELECT {by}, count(*) AS n,
                   CASE WHEN {varies} THEN corr(rx, ry) END AS spearman,
                   CASE WHEN {varies} THEN corr(x, y) END AS pearson
            FROM ({ranked}) GROUP BY {by}) c ON {same}"""


def adjusted(table: str) -> str:
    """Benjamini–Hochberg over the non-null p-values of a table."""
    return f"""SELECT *, coalesce(p_adjusted < 0.05, false) AS significant FROM (
            SELECT *, CASE WHEN p_value IS NOT NULL THEN least(1.0, min(p_value * m / rn) OVER (
                       PARTITION BY p_value IS NULL ORDER BY rn ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING)) END AS p_adjusted
            FROM (SELECT *, count(p_value) OVER () AS m,
                         row_number() OVER (PARTITION BY p_value IS NULL ORDER BY p_value) AS rn FROM {table}))"""


for prefix in ("", "market_"):
    relation(f"{prefix}corr", [f"{prefix}pairs"], correlated(f"{prefix}pairs", "product, lag"))
    relation(
        f"{prefix}corr_p",
        [f"{prefix}corr"],
        f"SELECT *, {p_value('spearman', 'n_months')} AS p_value FROM {prefix}corr",
    )
    relation(f"{prefix}level1", [f"{prefix}corr_p"], adjusted(f"{prefix}corr_p"))
    relation(
        f"{prefix}best_lag",
        [f"{prefix}level1"],
        f"""SELECT product, lag AS best_lag FROM (
                SELECT product, lag, row_number() OVER (PARTITION BY product ORDER BY round(abs(spearman), 12) DESC, lag) AS rn
                FROM {prefix}level1 WHERE spearman IS NOT NULL) WHERE rn = 1""",
    )
    source = f"{prefix}gold" if prefix else "gold"
    relation(
        f"{prefix}key_pairs",
        [source, f"{prefix}best_lag", f"{prefix}rate_change"],
        f"""SELECT g.entity, g.product, b.best_lag AS lag,
                   CASE WHEN g.has_prev THEN g.value_change_pct END AS y, s.rate_change AS x
            FROM {source} g LEFT JOIN {prefix}best_lag b ON g.product = b.product
            LEFT JOIN {prefix}rate_change s
              ON s.month = CAST(g.month - to_months(CAST(b.best_lag AS INTEGER)) AS DATE)""",
    )
    relation(f"{prefix}key_corr", [f"{prefix}key_pairs"], correlated(f"{prefix}key_pairs", "entity, product, lag"))
    relation(
        f"{prefix}key_corr_p",
        [f"{prefix}key_corr"],
        f"""SELECT *, {p_value('spearman', 'n_months')} AS p_value FROM (
                SELECT entity, product, lag, n_months, n_months < 24 AS insufficient,
                       CASE WHEN n_months >= 24 THEN spearman END AS spearman,
                       CASE WHEN n_months >= 24 THEN pearson END AS pearson FROM {prefix}key_corr)""",
    )
    relation(f"{prefix}level2", [f"{prefix}key_corr_p"], adjusted(f"{prefix}key_corr_p"))

relation(
    "market",
    ["gold"],
    f"""SELECT *, {pct('mv', lagged('mv', 3, 'product'))} AS mg3, {pct('mv', lagged('mv', 12, 'product'))} AS mg12
        FROM (SELECT product, month, CAST(sum(CAST(value AS DECIMAL(30,2))) AS DOUBLE) AS mv FROM gold GROUP BY ALL)""",
)
relation(
    "rate_features",
    ["gold"],
    f"""SELECT month, rate, rate - {lagged('rate', 3, '1')} AS rate_change_3m, rate - {lagged('rate', 6, '1')} AS rate_change_6m
        FROM (SELECT month, max(rate) AS rate FROM gold GROUP BY month)""",
)
relation(
    "feature_rows",
    ["gold", "market", "rate_features"],
    f"""SELECT entity, product, f.month AS origin, growth_1m, growth_3m, growth_6m, growth_12m, acceleration_3m,
               growth_3m - mg3 AS relative_3m, growth_12m - mg12 AS relative_12m, share, share_change_12m,
               r.rate, rate_change_3m, rate_change_6m, value AS value_origin,
               CASE WHEN ahead IS NOT NULL AND growth_3m IS NOT NULL THEN CAST(ahead > growth_3m AS INTEGER) END AS gains
        FROM (
            SELECT *, {pct('value', lagged('value', 1))} AS growth_1m, {pct('value', lagged('value', 3))} AS growth_3m,
                   {pct('value', lagged('value', 6))} AS growth_6m, {pct('value', lagged('value', 12))} AS growth_12m,
                   {pct('value', lagged('value', 3))} - {pct(lagged('value', 3), lagged('value', 6))} AS acceleration_3m,
                   share - {lagged('share', 12)} AS share_change_12m,
                   {pct(lagged('value', -5), lagged('value', -2))} AS ahead,
                   count(*) OVER (PARTITION BY entity, product) AS months
            FROM (SELECT g.entity, g.product, g.month, g.value, m.mg3, m.mg12, g.value / nullif(m.mv, 0) AS share
                  FROM gold g JOIN market m ON g.product = m.product AND g.month = m.month)
        ) f JOIN rate_features r ON f.month = r.month
        WHERE months = {SPLIT.n_months} AND growth_1m IS NOT NULL AND growth_3m IS NOT NULL AND growth_6m IS NOT NULL
          AND growth_12m IS NOT NULL AND acceleration_3m IS NOT NULL AND growth_3m - mg3 IS NOT NULL
          AND growth_12m - mg12 IS NOT NULL AND share IS NOT NULL AND share_change_12m IS NOT NULL
          AND r.rate IS NOT NULL AND rate_change_3m IS NOT NULL AND rate_change_6m IS NOT NULL""",
)
relation(
    "dataset",
    ["feature_rows", "gold"],
    f"""SELECT * FROM (SELECT *, CASE WHEN origin = (SELECT max(month) FROM gold) THEN 'production'
                   WHEN gains IS NULL THEN NULL
                   WHEN origin <= DATE '{SPLIT.train_end}' THEN 'development'
                   WHEN origin < DATE '{SPLIT.test_start}' THEN 'embargo' ELSE 'test' END AS split
            FROM feature_rows) WHERE split IS NOT NULL""",
)


def auc_sql(source: str, by: str, weight: str = "1.0") -> str:
    keys = f"{by}, " if by else ""
    group = f"PARTITION BY {by} " if by else ""
    return f"""SELECT {keys}CASE WHEN sum(p) > 0 AND sum(n) > 0 THEN sum(p * (below + n / 2)) / (sum(p) * sum(n)) END AS auc
        FROM (SELECT {keys}score, p, n, coalesce(sum(n) OVER ({group}ORDER BY score ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS below
              FROM (SELECT {keys}score, sum(CASE WHEN gains = 1 THEN {weight} ELSE 0.0 END) AS p,
                           sum(CASE WHEN gains = 0 THEN {weight} ELSE 0.0 END) AS n
                    FROM {source} GROUP BY {keys}score)) {f'GROUP BY {by}' if by else ''}"""


def precision_sql(source: str, score: str, sizes: tuple[int, ...]) -> str:
    return f"""SELECT CAST(size AS INTEGER) AS list_size, avg(hit) AS precision FROM (
            SELECT size, origin, avg(CAST(gains AS DOUBLE)) AS hit FROM (
                SELECT origin, gains, row_number() OVER (PARTITION BY origin ORDER BY {score} DESC, entity, product) AS pos
                FROM {source}) CROSS JOIN (SELECT unnest({list(sizes)}) AS size)
            WHERE pos <= size GROUP BY ALL) GROUP BY size"""


def recommendation_sql(source: str, top: int) -> str:
    arms = []
    for group, order in (("expand", "DESC"), ("alert", "ASC")):
        arms.append(
            f"""SELECT '{group}' AS "group", CAST(pos AS INTEGER) AS position, entity, product, score, weight AS value FROM (
                SELECT *, row_number() OVER (ORDER BY score {order}, entity, product) AS pos FROM {source}) WHERE pos <= {top}"""
        )
    return " UNION ALL ".join(arms)


relation("recommended", ["scores"], recommendation_sql("scores", 20))
relation(
    "sensitivity",
    ["scores"],
    f"""SELECT 'minimum score' AS rule, CAST(t AS DOUBLE) AS parameter,
               count(*) FILTER (WHERE score >= t) / CAST(count(DISTINCT origin) AS DOUBLE) AS per_month,
               CASE WHEN count(*) FILTER (WHERE score >= t) > 0 THEN
                    sum(CASE WHEN score >= t THEN CAST(gains AS DOUBLE) END) / count(*) FILTER (WHERE score >= t) END AS precision_model,
               coalesce(sum(CASE WHEN score >= t THEN CAST(gains AS DOUBLE) END), 0) / nullif(sum(CAST(gains AS DOUBLE)), 0) AS recall_model,
               CAST(NULL AS DOUBLE) AS precision_simple
        FROM scores CROSS JOIN (SELECT unnest([0.5, 0.6, 0.7, 0.8, 0.9]) AS t) GROUP BY t
        UNION ALL
        SELECT 'top of the month', CAST(m.list_size AS DOUBLE), CAST(m.list_size AS DOUBLE), m.precision, NULL, s.precision
        FROM ({precision_sql('scores', 'score', (10, 20, 40))}) m
        JOIN ({precision_sql('scores', 'simple_score', (10, 20, 40))}) s ON m.list_size = s.list_size""",
)

_DIM = ", ".join(f"({p}, '{k}', '{f}', '{n}', '{s}')" for p, k, f, n, s in PRODUCTS)
relation(
    "product_dim",
    [],
    f"SELECT * FROM (VALUES {_DIM}) t(position, product_key, fragment, name, short_name)",
)


def product_names_sql(source: str) -> str:
    plain = f"lower(translate(product, '{ACCENTED}', '{PLAIN}'))"
    rest = f"trim(split_part(regexp_replace(product, '^{PRODUCT_PREFIX}\\s*', '', 'i'), '(', 1))"
    rest = f"coalesce(nullif({rest}, ''), product)"
    return f"""SELECT product, coalesce(product_key, {plain}) AS product_key, coalesce(name, {rest}) AS name,
               coalesce(short_name, substr({rest}, 1, 8)) AS short_name, CAST(coalesce(position, {len(PRODUCTS) + 1}) AS INTEGER) AS position
        FROM (SELECT n.product, d.*, row_number() OVER (PARTITION BY n.product ORDER BY d.position) AS rn
              FROM (SELECT DISTINCT product FROM {source}) n LEFT JOIN product_dim d
                ON CASE WHEN trim({plain}) = '{PRODUCT_PREFIX.lower()}' THEN d.fragment = ''
                        ELSE d.fragment <> '' AND contains({plain}, d.fragment) END) WHERE rn = 1"""


_ENTITY_ROWS = ", ".join(f"('{c}', '{n}', {x}, {y})" for c, n, x, y in ENTITIES)
relation(
    "entity_dim",
    [],
    f"SELECT * FROM (VALUES {_ENTITY_ROWS}) t(code, entity_name, grid_column, grid_row)",
)
_MONTHS = "[" + ", ".join(f"'{m}'" for m in MONTH_NAMES) + "]"


def month_label_sql(month: str) -> str:
    return f"{_MONTHS}[month({month})] || '/' || CAST(year({month}) AS VARCHAR)"


def number_text_sql(value: str, places: int) -> str:
    return f"translate(format('{{:,.{places}f}}', {value}), ',.', '.,')"
