"""Event analyses over the ``events`` table and the SQL that states them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidewater.events import analysis, spec
from tidewater.session import prepare


def events_of(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The table in the columns of an event dataset, with ``value`` and ``k`` as properties."""
    return spark.read.parquet(f"{sf_dir}/events.parquet").select(
        F.col("user_id").alias("actor"), "ts", F.col("event_id").alias("tb"), F.col("event_type").alias("name"), "value",
        F.get_json_object("props", "$.k").cast("bigint").alias("k"), (F.col("value") > 50).cast("string").alias("high"),
    )


#: The same columns for the SQL statements.
EV = """ev AS (SELECT user_id AS actor, ts, event_id AS tb, event_type AS name, value,
  CAST(json_extract(props, '$.k') AS BIGINT) AS k, CAST(value > 50 AS VARCHAR) AS high FROM events{where})"""


def run_statement(spark: SparkSession, sf_dir: str, text: str) -> DataFrame:
    prepare(spark)
    events = events_of(spark, sf_dir)
    s = spec.parse(text)
    if isinstance(s, spec.Funnel):
        return analysis.funnel(events, s)
    if isinstance(s, spec.Segment):
        return analysis.segment(events, s)
    if isinstance(s, spec.Paths):
        return analysis.paths(events, s)
    bounds = events.agg(F.min("ts"), F.max("ts")).first()
    return analysis.retention(events, s, None, tuple(bounds))


def _rounded(df: DataFrame) -> DataFrame:
    return df.select(*[F.round(c, 6 if c.endswith("_from_previous") and "seconds" in c else 9).alias(c) if t == "double" else F.col(c) for c, t in df.dtypes])


def _funnel_sql(steps: list[str], seconds: int, where: str = "", by: str | None = None) -> str:
    """Every anchor's greedy chain by correlated minima, the earliest of the deepest, then counts per step."""
    parts = [EV.format(where=where), f"c1 AS (SELECT actor, ts AS t1, tb AS b1, ts AS l1, tb AS m1, {by or 'NULL'} AS bd FROM ev WHERE name = '{steps[0]}')"]
    for j, step in enumerate(steps[1:], 2):
        parts.append(
            f"c{j} AS (SELECT c.* EXCLUDE (l{j - 1}, m{j - 1}), c.l{j - 1} AS p{j}, n.x.ts AS t{j}, n.x.ts AS l{j}, n.x.tb AS m{j} FROM c{j - 1} c, LATERAL "
            f"(SELECT min({{'ts': e.ts, 'tb': e.tb}}) AS x FROM ev e WHERE e.actor = c.actor AND e.name = '{step}' "
            f"AND (e.ts > c.l{j - 1} OR (e.ts = c.l{j - 1} AND e.tb > c.m{j - 1})) AND e.ts <= c.t1 + INTERVAL {seconds} SECOND) n)"
        )
    k = len(steps)
    depth = " + ".join(["1"] + [f"(t{j} IS NOT NULL)::INT" for j in range(2, k + 1)])
    parts.append(f"w AS (SELECT *, {depth} AS depth FROM c{k} QUALIFY row_number() OVER (PARTITION BY actor ORDER BY depth DESC, t1, b1) = 1)")
    rows = []
    for j in range(1, k + 1):
        share = lambda a, b: f"CASE WHEN count(*) FILTER (depth >= {b}) = 0 THEN 0.0 ELSE count(*) FILTER (depth >= {a}) / count(*) FILTER (depth >= {b}) END"
        quantile = lambda q: f"quantile_cont((epoch_us(t{j}) - epoch_us(p{j})) / 1e6, {q}) FILTER (depth >= {j})" if j > 1 else "NULL::DOUBLE"  # noqa: E731, B023
        rows.append(
            f"SELECT {'bd AS breakdown, ' if by else ''}{j}::INT AS step_index, '{steps[j - 1]}' AS step_name, count(*) FILTER (depth >= {j}) AS entered, "
            f"round({share(j, max(j - 1, 1))}, 9) AS conversion_from_previous, round({share(j, 1)}, 9) AS conversion_from_start, "
            f"round({quantile(0.5)}, 6) AS median_seconds_from_previous, round({quantile(0.9)}, 6) AS p90_seconds_from_previous FROM w{' GROUP BY bd' if by else ''}"
        )
    return "WITH " + ", ".join(parts) + " " + " UNION ALL ".join(rows)


def _retention_sql(birth: str, back: str, period: str, bounded: bool, periods: int | None = None, at: int | None = None) -> str:
    unit = period.lower()
    top = str(periods) if periods is not None else f"date_diff('{unit}', g.cohort, (SELECT date_trunc('{unit}', max(ts)) FROM ev))"
    match = "r.off = x.off" if bounded else "least(r.longest, x.top) >= x.off"
    return f"""WITH {EV.format(where="")},
b AS (SELECT actor, min({{'ts': ts, 'tb': tb}}) AS f FROM ev WHERE {birth} GROUP BY actor),
o AS (SELECT b.actor, date_trunc('{unit}', b.f.ts) AS cohort, date_diff('{unit}', date_trunc('{unit}', b.f.ts), date_trunc('{unit}', e.ts)) AS off
      FROM b JOIN ev e ON e.actor = b.actor AND ({back}) AND (e.ts > b.f.ts OR (e.ts = b.f.ts AND e.tb > b.f.tb))),
r AS ({'SELECT DISTINCT actor, cohort, off FROM o' if bounded else 'SELECT actor, cohort, max(off) AS longest FROM o GROUP BY ALL'}),
g AS (SELECT unnest(generate_series(date_trunc('{unit}', min(ts)), date_trunc('{unit}', max(ts)), INTERVAL 1 {unit})) AS cohort FROM ev),
x AS (SELECT cohort, top, unnest(generate_series(0, top)) AS off FROM (SELECT cohort, {top} AS top FROM g)),
s AS (SELECT date_trunc('{unit}', f.ts) AS cohort, count(*) AS n FROM b GROUP BY 1),
h AS (SELECT x.cohort, x.off, count(r.actor) AS n FROM x LEFT JOIN r ON r.cohort = x.cohort AND {match} GROUP BY ALL)
SELECT CAST(x.cohort AS TIMESTAMP) AS cohort_start, coalesce(s.n, 0) AS cohort_size, x.off::INT AS period_offset, h.n AS retained,
       CASE WHEN s.n > 0 THEN round(h.n / s.n, 9) END AS retention_rate
FROM x JOIN h ON h.cohort = x.cohort AND h.off = x.off LEFT JOIN s ON s.cohort = x.cohort{f' WHERE x.off = {at}' if at is not None else ''}"""


def _segment_sql(value: str, unit: str, where: str = "", by: str | None = None) -> str:
    return f"""WITH {EV.format(where="")} SELECT CAST(date_trunc('{unit}', ts) AS TIMESTAMP) AS bucket, {f'{by} AS breakdown, ' if by else ''}
{value} AS value FROM ev{where} GROUP BY ALL"""


def _paths_sql(depth: int, top: int, gap: int | None = None, start: str | None = None, end: str | None = None, where: str = "true") -> str:
    torn = f"p IS NULL OR ts > p + INTERVAL {gap} SECOND" if gap else "p IS NULL"
    frame = f"ROWS BETWEEN {depth - 1} PRECEDING AND CURRENT ROW" if end else f"ROWS BETWEEN CURRENT ROW AND {depth - 1} FOLLOWING"
    anchor = f"name = '{start or end}' AND len(path) >= 2" if start or end else f"len(path) = {depth}"
    return f"""WITH {EV.format(where="")},
l AS (SELECT *, lag(ts) OVER o AS p, lag(name) OVER o AS q FROM ev WINDOW o AS (PARTITION BY actor ORDER BY ts, tb)),
f AS (SELECT *, sum((CASE WHEN {torn} THEN 1 ELSE 0 END)) OVER (PARTITION BY actor ORDER BY ts, tb ROWS UNBOUNDED PRECEDING) AS frag, ({torn}) AS torn FROM l),
k AS (SELECT * FROM f WHERE torn OR q <> name),
n AS (SELECT *, array_agg(name) OVER (PARTITION BY actor, frag ORDER BY ts, tb {frame}) AS path FROM k),
c AS (SELECT path, count(*) AS occurrences FROM n WHERE {anchor} AND ({where}) GROUP BY path),
r AS (SELECT *, occurrences / sum(occurrences) OVER () AS share, row_number() OVER (ORDER BY occurrences DESC, path) AS path_id FROM c)
SELECT path_id::INT AS path_id, i::INT AS seq, path[i] AS event, occurrences, round(share, 9) AS share
FROM (SELECT *, unnest(range(1, len(path) + 1)) AS i FROM r WHERE path_id <= {top})"""


_DAY = 86400
STATEMENTS = {
    "funnel": ("FUNNEL ('signup', 'view', 'purchase') ON ev WINDOW 7 DAYS", _funnel_sql(["signup", "view", "purchase"], 7 * _DAY)),
    "funnel_repeat": ("FUNNEL ('view', 'click', 'view', 'purchase') ON ev WINDOW 36 HOURS MODE STRICT_ORDER", _funnel_sql(["view", "click", "view", "purchase"], 36 * 3600)),
    "funnel_breakdown": ("FUNNEL ('view', 'click', 'purchase') ON ev WINDOW 1 DAY BREAKDOWN BY high", _funnel_sql(["view", "click", "purchase"], _DAY, by="high")),
    "funnel_filter_range": (
        "FUNNEL ('signup', 'click', 'purchase') ON ev WINDOW 3 DAYS FROM '2024-01-05' TO '2024-01-20' WHERE value > 20 AND NOT k IN (1, 2, 3)",
        _funnel_sql(["signup", "click", "purchase"], 3 * _DAY, " WHERE ts >= TIMESTAMP '2024-01-05' AND ts < TIMESTAMP '2024-01-20' AND value > 20 AND CAST(json_extract(props, '$.k') AS BIGINT) NOT IN (1, 2, 3)"),
    ),
    "retention_bounded": ("RETENTION ON ev BIRTH 'signup' RETURN 'purchase' PERIOD DAY PERIODS 7", _retention_sql("name = 'signup'", "name = 'purchase'", "DAY", True, 7)),
    "retention_unbounded": ("RETENTION ON ev BIRTH 'signup' RETURN ANY EVENT PERIOD WEEK MODE UNBOUNDED", _retention_sql("name = 'signup'", "true", "WEEK", False)),
    "retention_at": ("RETENTION ON ev BIRTH ANY EVENT RETURN 'click' PERIOD DAY PERIODS 14 AT 3", _retention_sql("true", "name = 'click'", "DAY", True, 14, 3)),
    "segment_count": ("SEGMENT COUNT ON ev EVENT 'purchase' BUCKET DAY", _segment_sql("count(*)", "day", " WHERE name = 'purchase'")),
    "segment_uniques": ("SEGMENT UNIQUES ON ev BUCKET WEEK", _segment_sql("count(DISTINCT actor)", "week")),
    "segment_cpu": ("SEGMENT COUNT_PER_UNIQUE ON ev BUCKET DAY WHERE value >= 10", _segment_sql("round(count(*) / count(DISTINCT actor), 9)", "day", " WHERE value >= 10")),
    "segment_breakdown": ("SEGMENT COUNT ON ev BUCKET MONTH BREAKDOWN BY k", _segment_sql("count(*)", "month", by="CAST(k AS VARCHAR)")),
    "paths_unanchored": ("PATHS ON ev DEPTH 4 TOP 25", _paths_sql(4, 25)),
    "paths_forward": ("PATHS ON ev STARTING AT 'signup' DEPTH 3 TOP 12 WHERE value > 30", _paths_sql(3, 12, start="signup", where="value > 30")),
    "paths_backward_gap": ("PATHS ON ev ENDING AT 'purchase' DEPTH 4 TOP 30 MAXGAP 12 HOURS", _paths_sql(4, 30, gap=12 * 3600, end="purchase")),
}


def _statement(text: str):
    return lambda spark, sf_dir: _rounded(run_statement(spark, sf_dir, text))


QUERIES = {key: _statement(text) for key, (text, _) in STATEMENTS.items()}
ORACLES = {key: sql for key, (_, sql) in STATEMENTS.items()}
