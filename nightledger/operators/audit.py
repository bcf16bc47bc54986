"""Data-quality audits over the eight tables."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from nightledger.schemas import TABLES

Tables = dict[str, DataFrame]

# Allowed ranges. A missing value satisfies a rule.
RANGE_RULES = {
    "hosts": {
        "response_rate_pct between 0 and 100": "response_rate_pct BETWEEN 0 AND 100",
        "total_listings_count >= 0": "total_listings_count >= 0",
        "experience_years >= 0": "experience_years >= 0",
    },
    "listings": {
        "accommodates > 0": "accommodates > 0",
        "bedrooms >= 0": "bedrooms >= 0",
        "beds >= 0": "beds >= 0",
        "bathrooms >= 0": "bathrooms >= 0",
        "amenity_count >= 0": "amenity_count >= 0",
        "base_price >= 0": "base_price >= 0",
        "minimum_nights >= 1": "minimum_nights >= 1",
    },
    "listing_performance": {
        "total_nights_tracked > 0": "total_nights_tracked > 0",
        "booked_nights >= 0": "booked_nights >= 0",
        "occupancy_rate between 0 and 1": "occupancy_rate BETWEEN 0 AND 1",
        "revenue_estimate >= 0": "revenue_estimate >= 0",
    },
    "listing_valuation": {"estimated_property_value >= 0": "estimated_property_value >= 0"},
    "review_scores": {
        f"{c} between 0 and 5": f"{c} BETWEEN 0 AND 5"
        for c in (
            "rating",
            "cleanliness",
            "checkin",
            "communication",
            "location_score",
            "value_score",
        )
    },
}

# Keys that must be unique.
UNIQUE_KEYS = {
    "neighbourhoods": [["neighbourhood_id"], ["neighbourhood_name"]],
    "hosts": [["host_id"]],
    "listings": [["listing_id"]],
    "listing_performance": [["listing_id"]],
    "listing_valuation": [["listing_id"]],
    "calendar_daily": [["listing_id", "calendar_date"]],
    "reviews": [["review_id"]],
    "review_scores": [["listing_id"]],
}

# Fixed values: (child, parent, shared key).
REFERENCES = [
    ("listings", "hosts", "host_id"),
    ("listings", "neighbourhoods", "neighbourhood_id"),
    ("listing_performance", "listings", "listing_id"),
    ("listing_valuation", "listings", "listing_id"),
    ("calendar_daily", "listings", "listing_id"),
    ("reviews", "listings", "listing_id"),
    ("review_scores", "listings", "listing_id"),
]

# Columns that must be filled.
REQUIRED = {
    "neighbourhoods": ["neighbourhood_name"],
    "listings": ["host_id", "neighbourhood_id", "room_type", "base_price"],
    "listing_performance": ["total_nights_tracked", "booked_nights"],
    "listing_valuation": ["is_synthetic_valuation"],
    "calendar_daily": ["listing_id", "calendar_date", "is_available"],
    "reviews": ["listing_id", "review_date"],
}


#: Stages whose write also counts the rows of a table that is a projection of them.
PROJECTED = {
    "calendar_clean": ("calendar_daily", {"calendar_date": "date", "is_available": "available"}),
    "reviews_kept": ("reviews", {"review_date": "date"}),
}
BOOKED = {"booked_nights <= total_nights_tracked": "booked_nights > total_nights_tracked"}
#: What the writes counted: by table the number of rows ("rows") and of violations by rule.
Counts = dict[str, dict[str, int]]


def _stack(frames: list[DataFrame]) -> DataFrame:
    return reduce(DataFrame.unionByName, frames)


def _range_rules(table: str) -> dict[str, Column]:
    return {rule: ~F.expr(sql) for rule, sql in RANGE_RULES.get(table, {}).items()}


def _required_rules(table: str, names: dict[str, str] | None = None) -> dict[str, Column]:
    names = names or {}
    return {f"{c} filled": F.col(names.get(c, c)).isNull() for c in REQUIRED.get(table, [])}


def _booked_rules(table: str) -> dict[str, Column]:
    return {r: F.expr(sql) for r, sql in BOOKED.items()} if table == "listing_performance" else {}


def watched(stage: str) -> tuple[str, dict[str, Column]]:
    """The table a stage holds, and what to count while it is written."""
    table, names = PROJECTED.get(stage, (stage, {}))
    if table not in TABLES:
        return table, {}
    rules = _range_rules(table) | _booked_rules(table) | _required_rules(table, names)
    return table, {"rows": F.count(F.lit(1)), **{r: F.count_if(c) for r, c in rules.items()}}


def _counts_by_rule(df: DataFrame, table: str, broken: dict) -> DataFrame:
    """One pass over the table, one output row per rule."""
    totals = df.agg(*[F.count_if(c).alias(f"r{i}") for i, c in enumerate(broken.values())])
    cells = [
        F.struct(F.lit(rule).alias("rule"), F.col(f"r{i}").alias("violations"))
        for i, rule in enumerate(broken)
    ]
    return totals.select(
        F.lit(table).alias("table_name"), F.explode(F.array(*cells)).alias("c")
    ).select("table_name", "c.rule", "c.violations")


def _report(tables: Tables, rules: dict[str, dict[str, Column]], counts: Counts | None) -> DataFrame:
    """A row per rule: from the counts where the write took them, else from a pass over the table."""
    known = [(t, r, counts[t][r]) for t, by in rules.items() if counts and t in counts for r in by]
    frames = [
        _counts_by_rule(tables[t], t, by) for t, by in rules.items() if not (counts and t in counts)
    ]
    if known:
        spark = next(iter(tables.values())).sparkSession
        schema = "table_name string, rule string, violations bigint"
        frames.append(spark.createDataFrame(known, schema))
    return _stack(frames)


def range_audit(tables: Tables, counts: Counts | None = None) -> DataFrame:
    """Violations of every value-range rule."""
    return _report(tables, {t: _range_rules(t) for t in RANGE_RULES}, counts)


def booked_within_tracked(performance: DataFrame, counts: Counts | None = None) -> DataFrame:
    """K02."""
    name = "listing_performance"
    return _report({name: performance}, {name: _booked_rules(name)}, counts)


def not_null_audit(tables: Tables, counts: Counts | None = None) -> DataFrame:
    """K05."""
    return _report(tables, {t: _required_rules(t) for t in REQUIRED}, counts)


def _key(df: DataFrame, column: str) -> list[Column]:
    """A key of any type as (number, text)."""
    text = dict(df.dtypes)[column] == "string"
    number = F.lit(None).cast("bigint") if text else F.col(column).cast("bigint")
    return [number.alias("number"), (F.col(column) if text else F.lit(None).cast("string")).alias("text")]


def _key_counts(df: DataFrame, columns: dict[int, str]) -> DataFrame:
    """(rule, number, text, n) for several key columns of a table, in one pass."""
    cells = [F.struct(F.lit(i).alias("rule"), *_key(df, c)) for i, c in columns.items()]
    keys = df.select(F.explode(F.array(*cells)).alias("k")).select("k.*")
    return keys.groupBy("rule", "number", "text").agg(F.count(F.lit(1)).alias("n"))


def _rules_frame(df: DataFrame, names: list[tuple[str, str]]) -> DataFrame:
    rows = [(i, table, rule) for i, (table, rule) in enumerate(names)]
    return df.sparkSession.createDataFrame(rows, "rule int, table_name string, name string")


def _by_rule(found: DataFrame, names: list[tuple[str, str]]) -> DataFrame:
    """Sums of (rule, violations) with a row for every rule."""
    sums = found.groupBy("rule").agg(F.sum("violations").alias("violations"))
    return _rules_frame(found, names).join(sums, "rule", "left").select(
        "table_name", F.col("name").alias("rule"), F.coalesce("violations", F.lit(0)).alias("violations")
    )


#: Days of a year that one number holds as bits.
DAY_BITS = 62


def _repeated_days(df: DataFrame, by: list[str], day: str) -> DataFrame:
    """Rows beyond the first of each (by, day): a year's days are the bits of six numbers, so a
    row per year is shuffled instead of one per day."""
    place = F.dayofyear(day) - 1
    bit = F.expr(f"shiftleft(1L, (dayofyear({day}) - 1) % {DAY_BITS})")
    words = [F.bit_or(F.when(F.floor(place / DAY_BITS) == i, bit)).alias(f"w{i}") for i in range(-(-366 // DAY_BITS))]
    groups = df.groupBy(*by, F.year(day).alias("_year")).agg(F.count(F.lit(1)).alias("n"), *words)
    found = [F.coalesce(F.bit_count(f"w{i}"), F.lit(0)) for i in range(len(words))]
    # days that are missing are alike
    days = F.when(F.col("_year").isNull(), 1).otherwise(reduce(Column.__add__, found))
    return groups.select((F.col("n") - days).alias("violations"))


def uniqueness_audit(tables: Tables) -> DataFrame:
    """Rows beyond the first of each key (K03): one pass over each table, one shuffle for all single keys."""
    names, frames = [], []
    for table, keys in UNIQUE_KEYS.items():
        single = {}
        for key in keys:
            rule = len(names)
            names.append((table, "unique " + ", ".join(key)))
            if len(key) == 1:
                single[rule] = key[0]
            else:
                days = _repeated_days(tables[table], key[:-1], key[-1])
                frames.append(days.select(F.lit(rule).alias("rule"), "violations"))
        if single:
            frames.append(
                _key_counts(tables[table], single).select("rule", (F.col("n") - 1).alias("violations"))
            )
    return _by_rule(_stack(frames), names)


#: (table, rule, child, key in the child, name of the parent's keys, parent, key in the parent)
Link = tuple[str, str, DataFrame, str, str, DataFrame, str]


def orphans(links: list[Link]) -> DataFrame:
    """Child rows whose key is filled and has no parent row, per link.

    Each child is read once for all its links, each parent once for all children. Children are
    reduced to their distinct keys with counts before one shuffle joins them with all parents.
    """
    names = [(table, rule) for table, rule, *_ in links]
    parents = sorted({link[4] for link in links})
    of_rule = F.array(*[F.lit(parents.index(link[4])) for link in links])
    by_child: dict[str, dict[int, str]] = {}
    child_of = {}
    for i, (table, _, child, key, *_) in enumerate(links):
        by_child.setdefault(table, {})[i] = key
        child_of[table] = child
    keys = _stack([_key_counts(child_of[t], columns) for t, columns in by_child.items()])
    keys = keys.where("number IS NOT NULL OR text IS NOT NULL").withColumn(
        "parent", F.element_at(of_rule, F.col("rule") + 1)
    )
    known = {link[4]: (link[5], link[6]) for link in links}
    held = _stack(
        [
            known[p][0].select(F.lit(i).alias("parent"), *_key(known[p][0], known[p][1]))
            for i, p in enumerate(parents)
        ]
    )
    equal = [keys["parent"] == held["parent"]]
    equal += [keys[c].eqNullSafe(held[c]) for c in ("number", "text")]
    lost = keys.join(held, equal, "left_anti")
    return _by_rule(lost.select("rule", F.col("n").alias("violations")), names)


def reference_audit(tables: Tables) -> DataFrame:
    """K04."""
    return orphans(
        [
            (child, f"{key} in {parent}", tables[child], key, parent, tables[parent], key)
            for child, parent, key in REFERENCES
        ]
    )


def row_counts(tables: Tables, counts: Counts | None = None) -> DataFrame:
    """One row with the size of each of the eight tables."""
    sizes = {t: counts[t]["rows"] for t in TABLES if counts and t in counts}
    if len(sizes) == len(TABLES):
        spark = next(iter(tables.values())).sparkSession
        schema = ", ".join(f"{t} bigint" for t in TABLES)
        return spark.createDataFrame([tuple(sizes[t] for t in TABLES)], schema)
    long = _stack(
        [
            tables[t].agg(F.lit(t).alias("table_name"), F.count(F.lit(1)).alias("n"))
            for t in TABLES
        ]
    )
    return long.agg(
        *[F.max(F.when(F.col("table_name") == t, F.col("n"))).alias(t) for t in TABLES]
    )


def gate_report(tables: Tables, missing_months: DataFrame, counts: Counts | None = None) -> DataFrame:
    """All audits in one frame, one row per rule."""
    gaps = missing_months.agg(
        F.lit("calendar_daily").alias("table_name"),
        F.lit("every month covered").alias("rule"),
        F.count_if(F.col("coverage_status") == "MISSING").alias("violations"),
    )
    return _stack(
        [
            range_audit(tables, counts),
            booked_within_tracked(tables["listing_performance"], counts),
            uniqueness_audit(tables),
            reference_audit(tables),
            not_null_audit(tables, counts),
            gaps,
        ]
    )


def enforce(report: DataFrame, allowed: set[tuple[str, str]] = frozenset()) -> None:
    """Raise when a rule is broken that is not in ``allowed``; the report has a fixed size."""
    broken = [
        f"{r.table_name}: {r.rule} ({r.violations})"
        for r in report.where("violations > 0").collect()
        if (r.table_name, r.rule) not in allowed
    ]
    if broken:
        raise ValueError("quality gate failed: " + "; ".join(broken))
