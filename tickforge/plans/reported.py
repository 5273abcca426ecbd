"""Filings' facts, made from rows of the tables in varying elements, contexts, units and scopes, read as financial records."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tickforge.functions.columns import rounded
from tickforge.operators import reported
from tickforge.plans.registry import query
from tickforge.sources.tables import table

ELEMENTS = ["jppfs_cor:NetSales", "NetSales", "jppfs_cor:OperatingIncome", "tse-ed-t:OrdinaryProfit", "ProfitLoss", "tse-ed-t:NetIncomePerShare", "jpcrp:NetAssetsPerShare", "CapitalAdequacyRatio", "tse-ed-t:DividendPerShare", "CurrentFiscalYearEndDateDEI", "TypeOfCurrentPeriodDEI", "AccountingStandardsDEI", "ProfitAttributableToOwnersOfParent", "Other", "Revenue"]
CONTEXTS = [
    "CurrentYearDuration", "CurrentYearDuration_ConsolidatedMember", "CurrentAccumulatedQ2Duration", "CurrentYearInstant", "CurrentYearDuration_ResultMember", "NextYearDuration_ForecastMember", "CurrentYearDuration_ForecastMember", "Prior1YearDuration", "CurrentYearDuration_SegmentMember", "InterimInstant",
    "CurrentAccumulatedQ1Duration_ConsolidatedMember_ResultMember", "CurrentYearDuration_AnnualMember_ForecastMember", "CurrentYearDuration_NonConsolidatedMember_UpperMember", "CurrentYearDuration_AnnualMember", "InterimDuration", "FilingDateInstant_CurrentYear",
]
DIMENSIONS = ["", '[["jp:ConsolidatedNonconsolidatedAxis","jp:ConsolidatedMember"]]', "", '[["SegmentAxis","FoodMember"]]', "", '[["AnnualDividendPaymentScheduleAxis","AnnualMember"],["ResultForecastAxis","x:ForecastMember"]]', "", "broken", ""]
NUMBERS = ["1,200", "△350", "(45)", "－", "", "12.5", "nil", "▲7", "1,200", " 1200 ", "(注1)", "3.5e2"]


def _made(pick) -> dict[str, str]:
    """The columns of facts as expressions over lineitem; pick(values, index) is the engine's way to take one of a list."""
    a, b, q = "l_orderkey", "l_suppkey", "CAST(l_quantity AS INT)"
    which = f"({a} % {len(ELEMENTS)})"
    return {
        "doc": "l_partkey", "row": f"{a} * 10 + l_linenumber",
        "element": pick(ELEMENTS, which), "context_ref": pick(CONTEXTS, f"({a} + {b} * 5 + {q}) % {len(CONTEXTS)}"), "dimensions": pick(DIMENSIONS, f"({b} + {q}) % {len(DIMENSIONS)}"),
        "unit": f"CASE WHEN {which} IN (5, 6, 8) THEN {pick(['JPY/shares', 'JPYPerShares', 'JPY/shares', 'JPY'], f'{b} % 4')} WHEN {which} = 7 THEN {pick(['pure', 'pure', 'JPY'], f'{b} % 3')} ELSE {pick(['JPY', '円', 'JPY', 'USD', 'JPY', 'shares'], f'{b} % 6')} END",
        "value": f"CASE WHEN {which} = 9 THEN {pick(['2024-03-31', ' 2024-06-30T00', '2023-12-31', 'n/a', ' ', '2024-6-3'], f'{q} % 6')} WHEN {which} = 10 THEN {pick(['FY', 'HY', 'Q1', '2', ' 3Q ', '??'], f'{q} % 6')} WHEN {which} = 11 THEN {pick(['Japan GAAP', 'IFRS', ' US GAAP', 'Local', ''], f'{q} % 5')} ELSE {pick(NUMBERS, f'{q} % {len(NUMBERS)}')} END",
        "period_start": pick(["2023-04-01", "2023-04-01", "2024-01-01", ""], f"{q} % 4"), "period_end": pick(["2024-03-31", "2024-03-31", "2024-06-30", "2023-12-31", ""], f"({a} + {q}) % 5"),
        "instant_date": pick(["", "", "2024-03-31", ""], f"({b} + {a}) % 4"), "consolidated": pick(["連結", "連結", "単体", ""], "l_partkey % 2 + l_suppkey % 3"),
    }


def _quoted(values: list[str]) -> str:
    return ", ".join("'" + v.replace("'", "''") + "'" for v in values)


def facts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Facts of filings: a line item each, a part a filing."""
    made = _made(lambda values, i: f"element_at(array({_quoted(values)}), CAST({i} AS INT) + 1)")
    return table(spark, sf_dir, "lineitem").select(*(F.expr(x).alias(c) for c, x in made.items()))


FACTS_SQL = "facts AS (SELECT " + ", ".join(f"{x} AS {c}" for c, x in _made(lambda values, i: f"([{_quoted(values)}])[CAST({i} AS INT) + 1]").items()) + " FROM lineitem)"
_MEMBERS = "['ConsolidatedMember', 'NonConsolidatedMember', 'ResultMember', 'ForecastMember']"


def _wide_sql(dividend: str) -> str:
    axis = lambda i: f"regexp_extract(m[{i}], '[^:]*$')"
    fits = f"({axis(1)} IN ('ConsolidatedNonconsolidatedAxis', 'ConsolidatedOrNonConsolidatedAxis') AND {axis(2)} IN ('ConsolidatedMember', 'NonConsolidatedMember')) OR ({axis(1)} = 'ResultForecastAxis' AND {axis(2)} IN ('ResultMember', 'ForecastMember')) OR ({dividend} AND {axis(1)} = 'AnnualDividendPaymentScheduleAxis' AND {axis(2)} = 'AnnualMember')"
    named = f"CASE WHEN dimensions = '' THEN true WHEN json_valid(dimensions) THEN len(list_filter(from_json(CASE WHEN json_valid(dimensions) THEN dimensions ELSE '[]' END, '[[\"VARCHAR\"]]'), lambda m: NOT ({fits}))) = 0 ELSE false END"
    return f"(len(list_filter(string_split(context_ref, '_')[2:], lambda p: NOT (list_contains({_MEMBERS}, p) OR ({dividend} AND p = 'AnnualMember')))) = 0 AND {named})"


_CURRENT_SQL = "((regexp_matches(context_ref, '^(Current|Interim)') OR contains(context_ref, 'CurrentYear')) AND NOT regexp_matches(context_ref, 'Forecast|UpperMember|LowerMember'))"
_NUMBER_SQL = "(SELECT CASE WHEN regexp_matches(n, '^[0-9]+([.][0-9]+)?(e[0-9]+)?$') THEN CAST(n AS DOUBLE) * CASE WHEN regexp_matches(t, '^[△▲(]') AND t[1:2] <> '(注' THEN -1 ELSE 1 END END FROM (SELECT t, regexp_replace(regexp_replace(t, '^[△▲()]+', ''), '[△▲()]+$', '') AS n FROM (SELECT replace(trim(value), ',', '') AS t)))"
_UNIT_SQL = "CASE WHEN field IN ('equity_ratio_pct', 'roe_pct') THEN unit = 'pure' WHEN field IN ('eps', 'bps', 'dps') THEN unit IN ('JPY/shares', 'JPYPerShares') ELSE unit IN ('JPY', '円') END"
_FLOW_NAMES = _quoted([e for f in reported.FLOWS for e in reported.CANDIDATES[f]])
_DAY_SQL = lambda c: f"TRY_CAST(CASE WHEN regexp_matches({c}[1:10], '^[0-9]{{4}}-[0-9]{{1,2}}-[0-9]{{1,2}}$') THEN {c}[1:10] END AS DATE)"


def _stated_sql(names: list[str]) -> str:
    return "coalesce(" + ", ".join(f"arg_min(trim(value), row) FILTER (name = '{n}' AND trim(value) <> '')" for n in names) + ")"


HEADERS_SQL = f"""{FACTS_SQL}, named AS (SELECT *, regexp_extract(element, '[^:]*$') AS name, {_CURRENT_SQL} AS current, {_NUMBER_SQL} AS number, {_DAY_SQL('period_end')} AS ended FROM facts),
flows AS (SELECT * FROM named WHERE name IN ({_FLOW_NAMES}) AND current AND number IS NOT NULL AND (unit = '円' OR regexp_matches(unit, '^[A-Z]{{3}}$')) AND {_wide_sql('false')}),
fl AS (SELECT doc, count(*) AS flows, max(ended) FILTER (contains(context_ref, '_ResultMember')) AS result_end, max(ended) AS flow_end, bool_or(contains(context_ref, '_ResultMember')) AS results,
  list_sort(list(DISTINCT regexp_extract(context_ref, '^CurrentAccumulatedQ([123])Duration', 1)) FILTER (regexp_matches(context_ref, '^CurrentAccumulatedQ[123]Duration'))) AS quarters FROM flows GROUP BY doc),
st AS (SELECT doc, {_stated_sql(reported.END_TEXTS)} AS end_text, {_stated_sql(reported.KIND_TEXTS)} AS kind_text, {_stated_sql(reported.STANDARD_TEXTS)} AS standard_text, max(ended) FILTER (current) AS any_end FROM named GROUP BY doc),
h0 AS (SELECT st.doc, coalesce(flows, 0) AS flows, coalesce(CASE WHEN results THEN result_end ELSE flow_end END, {_DAY_SQL('end_text')}, any_end) AS period_end, CASE WHEN len(quarters) = 1 THEN quarters[1] || 'Q' ELSE coalesce(CASE kind_text {' '.join(f"WHEN '{a}' THEN '{b}'" for a, b in reported.KINDS.items())} END, '本決算') END AS kind,
  CASE standard_text {' '.join(f"WHEN '{a}' THEN '{b}'" for a, b in reported.STANDARDS.items())} ELSE standard_text END AS standard FROM st LEFT JOIN fl USING (doc)),
sc AS (SELECT h0.doc, CASE WHEN bool_or(consolidated = '連結') THEN '連結' WHEN bool_and(consolidated = '単体') THEN '単体' END AS scope FROM h0 JOIN flows ON flows.doc = h0.doc AND (flows.period_end = '' OR flows.period_end = CAST(h0.period_end AS VARCHAR)) GROUP BY h0.doc),
headers AS (SELECT h0.doc, flows, period_end, CASE WHEN kind = '2Q' AND period_end >= DATE '2024-06-30' THEN '中間' ELSE kind END AS kind, standard, scope FROM h0 LEFT JOIN sc USING (doc))"""

_CANDIDATES_SQL = "cand AS (SELECT * FROM (VALUES " + ", ".join(f"('{e}', '{f}', {i})" for f, es in reported.CANDIDATES.items() for i, e in enumerate(es)) + ") AS t(name, field, prio))"
_AHEAD_SQL = f"(field = 'dps' OR field IN ({_quoted(reported.FORECAST)}))"
PICKS_SQL = f"""{HEADERS_SQL}, {_CANDIDATES_SQL}, j AS (SELECT named.*, field, prio, h.period_end AS here, h.kind, h.scope AS own, bool_or(starts_with(context_ref, 'NextYearDuration') AND {_AHEAD_SQL}) OVER (PARTITION BY named.doc, field = 'dps') AS next_year FROM named JOIN headers h ON h.doc = named.doc JOIN cand USING (name) WHERE h.period_end IS NOT NULL),
u AS (SELECT *, false AS forecast FROM j WHERE (field = 'dps' OR own IS NULL OR consolidated = own) AND period_end IN ('', CAST(here AS VARCHAR)) AND instant_date IN ('', CAST(here AS VARCHAR)) UNION ALL SELECT *, true FROM j WHERE (field = 'dps' OR own IS NULL OR consolidated = own) AND {_AHEAD_SQL}),
t AS (SELECT *, {_wide_sql("field = 'dps'")} AND {_UNIT_SQL} AS fits, list_position(['連結', '', '単体'], consolidated) AS place, bool_or(starts_with(context_ref, 'InterimInstant')) OVER (PARTITION BY doc, forecast, field) AND NOT forecast AND kind = '中間' AND field IN ('bps', 'equity_ratio_pct') AS instants,
  CASE WHEN forecast THEN contains(context_ref, 'Forecast') AND regexp_matches(context_ref, '^(Current|Next)YearDuration') AND regexp_matches(context_ref, 'NextYear|NextAccumulated') = next_year ELSE current END AS timed FROM u),
t1 AS (SELECT * FROM t WHERE fits AND timed AND place > 0 AND (NOT instants OR starts_with(context_ref, 'InterimInstant'))),
t2 AS (SELECT *, regexp_matches(context_ref, '^(CurrentYTD|CurrentAccumulated|InterimDuration)') AS added FROM t1),
t3 AS (SELECT * FROM t2 WHERE forecast OR added OR NOT EXISTS (SELECT 1 FROM t2 x WHERE x.doc = t2.doc AND x.forecast = t2.forecast AND x.field = t2.field AND x.prio = t2.prio AND x.place = t2.place AND x.added) OR (period_start <> '' AND EXISTS (SELECT 1 FROM t2 x WHERE x.doc = t2.doc AND x.forecast = t2.forecast AND x.field = t2.field AND x.prio = t2.prio AND x.place = t2.place AND x.added AND x.period_start = t2.period_start))),
t4 AS (SELECT * FROM t3 WHERE forecast OR NOT contains(context_ref, '_ResultMember') OR NOT EXISTS (SELECT 1 FROM t3 x WHERE x.doc = t3.doc AND x.forecast = t3.forecast AND x.field = t3.field AND x.prio = t3.prio AND x.place = t3.place AND NOT contains(x.context_ref, '_ResultMember'))),
g AS (SELECT doc, forecast, field, prio, place, count(DISTINCT number) AS n, min(number) AS v, any_value(name) AS element, list_sort(list(DISTINCT context_ref)) AS refs, list_sort(list(DISTINCT period_end) FILTER (period_end <> '')) AS ends FROM t4 GROUP BY ALL),
b AS (SELECT * FROM g WHERE n > 0 QUALIFY row_number() OVER (PARTITION BY doc, forecast, field ORDER BY prio, place) = 1),
s AS (SELECT doc, forecast, field, bool_or(fits) AS fits, bool_or(fits AND timed) AS timed, any_value(next_year) AS next_year FROM t GROUP BY ALL),
picks AS (SELECT s.doc, s.field, s.forecast, CASE WHEN n = 1 THEN 'value' WHEN n > 1 OR NOT fits OR (timed AND NOT EXISTS (SELECT 1 FROM t1 WHERE t1.doc = s.doc AND t1.forecast = s.forecast AND t1.field = s.field)) THEN 'hold' ELSE 'null' END AS status,
  CASE WHEN n = 1 THEN CASE WHEN s.field IN ('equity_ratio_pct', 'roe_pct') AND NOT s.forecast THEN v * 100 ELSE v END END AS value, element, CASE place WHEN 1 THEN '連結' WHEN 2 THEN '' WHEN 3 THEN '単体' END AS scope, array_to_string(refs, '|') AS refs, ends, next_year FROM s LEFT JOIN b ON b.doc = s.doc AND b.forecast = s.forecast AND b.field = s.field)"""


@query(f"WITH {FACTS_SQL}, n AS (SELECT *, {_NUMBER_SQL} AS v FROM facts) SELECT doc, row, {_wide_sql('false')} AS whole, {_wide_sql('true')} AS whole_dividend, unit IN ('JPY', '円') AS yen, unit IN ('JPY/shares', 'JPYPerShares') AS per_share, unit = 'pure' AS ratio, round(v, 4) AS number FROM n")
def fact_scope(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whether a fact is the whole company's (for dividends too), which fields its unit fits, and its number."""
    wide = lambda dividend: reported.company_wide(F.col("context_ref"), F.col("dimensions"), F.lit(dividend))
    fits = lambda field: reported.unit_fits(F.col("unit"), F.lit(field))
    return facts(spark, sf_dir).select("doc", "row", wide(False).alias("whole"), wide(True).alias("whole_dividend"), fits("net_sales").alias("yen"), fits("eps").alias("per_share"), fits("roe_pct").alias("ratio"), rounded(reported.numeric(F.col("value"))).alias("number"))


@query(f"WITH {HEADERS_SQL} SELECT * FROM headers")
def filing_headers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What each filing is about: income facts, end of the period, kind, accounting standard, scope."""
    return reported.headers(facts(spark, sf_dir))


@query(f"WITH {PICKS_SQL} SELECT doc, field, forecast, status, round(value, 4) AS value, element, scope, refs FROM picks")
def financial_record(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The value of every field of a filing, actual and forecast, with the element, scope and contexts it was taken from."""
    return reported.picked(facts(spark, sf_dir)).select("doc", "field", "forecast", "status", rounded("value").alias("value"), "element", "scope", "refs")


@query(f"""WITH {PICKS_SQL} SELECT p.doc, CASE WHEN field <> 'dps' THEN field WHEN forecast THEN 'dps_forecast' ELSE 'dps_actual' END AS metric, round(value, 4) AS value, element, CASE WHEN p.scope IN ('連結', '単体') THEN p.scope ELSE '不明' END AS element_scope, nullif(refs, '') AS context_refs, status, period_end, kind, coalesce(h.scope, '不明') AS consolidated
FROM picks p JOIN headers h USING (doc) WHERE field IN ('eps', 'bps', 'dps') AND element IS NOT NULL AND NOT (forecast AND field <> 'dps')""")
def per_share_facts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per-share figures in long form: a row only where there is a value or an element was chosen."""
    return reported.per_share_rows(reported.picked(facts(spark, sf_dir), reported.PER_SHARE)).withColumn("value", rounded("value"))


@query(f"""WITH {PICKS_SQL}, e AS (SELECT doc, list(DISTINCT e) AS es FROM (SELECT doc, unnest(ends) AS e FROM picks WHERE forecast AND field IN ({_quoted(reported.FLOWS)})) GROUP BY doc)
SELECT p.doc, CASE WHEN len(any_value(es)) = 1 THEN any_value(es)[1] END AS target_period_end, CASE WHEN count(*) FILTER (status = 'value') = 0 THEN 'unknown' WHEN bool_and(next_year) FILTER (status = 'value') THEN 'next_year' WHEN NOT bool_or(next_year) FILTER (status = 'value') THEN 'current_year' ELSE 'unknown' END AS forecast_scope, coalesce(any_value(h.scope), '不明') AS consolidated,
  {', '.join(f"round(max(value) FILTER (field = '{f}'), 4) AS forecast_{f}" for f in reported.FORECAST)}, round(max(value) FILTER (field = 'dps'), 4) AS dps_forecast FROM picks p JOIN headers h USING (doc) LEFT JOIN e ON e.doc = p.doc WHERE forecast GROUP BY p.doc""")
def forecast_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A filing's forecasts as one row, with the year that they are of."""
    made = reported.forecast_rows(reported.picked(facts(spark, sf_dir)))
    return made.withColumns({c: rounded(c) for c in made.columns if c.startswith("forecast_") and c != "forecast_scope" or c == "dps_forecast"})
