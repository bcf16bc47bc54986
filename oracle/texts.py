"""SQL for the insight texts and the report lines."""

from __future__ import annotations

from oracle.ctes import div
from oracle.summary import REVPAR_GAP
from oracle.summary import SQL as NUMBERS

# Wording is read from the library; only the numbers are checked here.
from nightledger.plans.insights import ADVICE, THEMES


def q(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


def whole(expr: str) -> str:
    return f"format('{{:,.0f}}', CAST({expr} AS DOUBLE))"


def pct(expr: str) -> str:
    return f"(format('{{:.1f}}', CAST({expr} AS DOUBLE) * 100) || '%')"


OCC = div("sum(booked_nights)", "sum(total_nights_tracked)")
REVPAR = div("sum(revenue_estimate)", "sum(total_nights_tracked)")
FINDINGS = {
    "EXEC-01": f"(SELECT 'The market has ' || {whole('count(*)')} || ' priced listings earning an "
    f"estimated $' || {whole('sum(revenue_estimate)')} || ' at ' || {pct(OCC)} || "
    "' weighted occupancy.' FROM master)",
    "EXEC-02": f"(SELECT 'Three neighbourhoods earn ' || {pct('top_share')} || ' of estimated "
    f"revenue; the largest is ' || leader || '.' FROM ({NUMBERS['i03_concentration']}))",
    "SEAS-01": "(SELECT 'Estimated revenue is highest in ' || peak_month || ' and lowest in ' || "
    f"low_month || '.' FROM ({NUMBERS['i04_peak_month']}))",
    "HOST-01": f"(SELECT 'RevPAR of superhosts is ' || {pct(REVPAR_GAP)} || "
    "' above that of other hosts.' FROM master)",
    "QUALITY-01": f"(SELECT {whole('count(*)')} || ' listings are stale under the 365-day review "
    "rule.' FROM master WHERE coalesce(is_stale_listing, true))",
    "PRICING-01": f"(SELECT {whole('count(*)')} || ' listings are flagged by the pricing-gap "
    "rule.' FROM master WHERE pricing_signal <> 'Well-Priced')",
    "INVEST-01": "(SELECT best_roi_area || ' ranks highest on estimated ROI.' "
    f"FROM ({NUMBERS['i08_best_roi']}))",
}
PACK = " UNION ALL ".join(
    f"SELECT CAST({i} AS BIGINT) AS position, {q(k)} AS InsightID, {q(THEMES[k])} AS Theme, "
    f"{finding} AS Finding, {q(ADVICE[k][0])} AS Recommendation, {q(ADVICE[k][1])} AS Caveat"
    for i, (k, finding) in enumerate(FINDINGS.items())
)


def line(section: str, n: int, value: str) -> str:
    return (
        f"SELECT CAST({section} AS BIGINT) AS section, CAST({n} AS BIGINT) AS line, "
        f"{value} AS value"
    )


_SECTION = [
    "'## ' || InsightID || ' - ' || Theme",
    "'**Finding:** ' || Finding",
    "''",
    "'**Recommendation:** ' || Recommendation",
    "''",
    "'**Caveat:** ' || Caveat",
    "''",
]
_SNAPSHOT = [
    "'## Dashboard KPI snapshot'",
    "''",
    f"(SELECT '- Listings analyzed: ' || {whole('count(*)')} FROM master)",
    f"(SELECT '- Estimated revenue: $' || {whole('sum(revenue_estimate)')} FROM master)",
    f"(SELECT '- Weighted occupancy: ' || {pct(OCC)} FROM master)",
    f"(SELECT '- RevPAR: $' || {whole(REVPAR)} FROM master)",
    "''",
]
REPORT = " UNION ALL ".join(
    [line("0", 0, "'# Business Insights from Current Data'"), line("0", 1, "''")]
    + [line("position + 1", i, v) + f" FROM ({PACK})" for i, v in enumerate(_SECTION)]
    + [line("8", i, v) for i, v in enumerate(_SNAPSHOT)]
)

SQL = {
    "i09_insight_pack": PACK,
    "w10_headline_insight": f"SELECT * EXCLUDE (position) FROM ({PACK}) WHERE InsightID = 'EXEC-02'",
    "s09_report": REPORT,
}
