"""SQL for the inputs of the price model."""

from __future__ import annotations

from oracle.library import n

# The numeric inputs of the model.
NUMERIC = [
    "accommodates",
    "bedrooms",
    "beds",
    "bathrooms",
    "amenity_count",
    "minimum_nights",
    "maximum_nights",
    "host_experience_years",
    "host_response_rate",
    "number_of_reviews",
    "reviews_per_month",
    "review_score_composite",
]
BUCKET = "CAST('0x' || substr(md5(CAST(id AS VARCHAR) || '-42'), 1, 8) AS BIGINT) % 100"
NUMBERS = ", ".join(f"CAST({c} AS DOUBLE) AS {c}" for c in NUMERIC)

CATEGORICAL = [
    "room_type",
    "property_type",
    "neighbourhood_cleansed",
    "host_is_superhost",
    "instant_bookable",
]
FOREST_RULES = [
    "children exist",
    "children share the rows",
    "value is the mean of the children",
    "gain is the impurity removed",
    "no fewer rows than allowed",
    "no more nodes than the depth allows",
    "predictions are means of leaves",
    "better than the mean price where it learnt",
]


def _cell(c: str) -> str:
    """A number, filled and standardised by the training rows."""
    known = f"coalesce(CAST(g.{c} AS DOUBLE), f.{c})"
    return f"SELECT g.id, '{c}' AS name, coalesce(({known} - f.{c}_mean) / nullif(f.{c}_std, 0), 0) AS v FROM given g, fills f"


def _fill(c: str) -> str:
    own = f"CAST({c} AS DOUBLE)"
    filled = f"coalesce({own}, (SELECT median({own}) FROM given WHERE train))"
    return f"median({own}) AS {c}, avg({filled}) AS {c}_mean, stddev_samp({filled}) AS {c}_std"


def _hot(c: str) -> str:
    most = f"(SELECT {c} FROM given WHERE train AND {c} IS NOT NULL GROUP BY 1 ORDER BY count(*) DESC, {c} LIMIT 1)"
    return f"SELECT id, '{c}=' || CAST(coalesce({c}, {most}) AS VARCHAR) AS name, CAST(1 AS DOUBLE) AS v FROM given"


#: Normal equations of the training rows solved by elimination, a pivot a step; inputs that
#: depend on earlier ones (their pivot vanishes) get no weight.
LEAST_SQUARES = f"""
WITH RECURSIVE given AS (SELECT *, {BUCKET} < 80 AS train FROM master WHERE price IS NOT NULL),
fills AS (SELECT {", ".join(_fill(c) for c in NUMERIC)} FROM given WHERE train),
cells AS MATERIALIZED (
  SELECT id, '' AS name, CAST(1 AS DOUBLE) AS v FROM given
  UNION ALL {" UNION ALL ".join(map(_cell, NUMERIC))} UNION ALL {" UNION ALL ".join(map(_hot, CATEGORICAL))}),
used AS (SELECT c.id, name, v, CAST(price AS DOUBLE) AS price FROM cells c JOIN given g ON g.id = c.id WHERE train),
names AS MATERIALIZED (SELECT name, row_number() OVER (ORDER BY name) AS i FROM (SELECT DISTINCT name FROM used)),
placed AS (SELECT id, i, v, price FROM used JOIN names USING (name)),
products AS (
  SELECT a.i, b.i AS j, sum(a.v * b.v) AS v FROM placed a JOIN placed b USING (id) GROUP BY ALL
  UNION ALL SELECT i, (SELECT count(*) + 1 FROM names), sum(v * price) FROM placed GROUP BY i),
grid AS (SELECT i, j FROM names, range(1, (SELECT count(*) + 2 FROM names)) t(j)),
lines AS (
  SELECT i, list(coalesce(v, 0) ORDER BY j) AS line FROM grid LEFT JOIN products USING (i, j) GROUP BY i),
steps(k, n, m) AS (
  SELECT CAST(1 AS BIGINT), count(*), list(line ORDER BY i) FROM lines
  UNION ALL
  SELECT k + 1, n, CASE WHEN abs(m[k][k]) < 1e-6 THEN m ELSE list_transform(range(1, n + 1), lambda i:
    CASE WHEN i = k THEN list_transform(range(1, n + 2), lambda j: m[k][j] / m[k][k])
    ELSE list_transform(range(1, n + 2), lambda j: m[i][j] - m[i][k] / m[k][k] * m[k][j]) END) END
  FROM steps WHERE k <= n),
solved AS (SELECT n, m FROM steps WHERE k > n),
weights AS (SELECT name, CASE WHEN abs(m[i][i] - 1) < 1e-6 THEN m[i][n + 1] ELSE 0 END AS weight FROM names, solved),
scored AS (
  SELECT any_value(CAST(price AS DOUBLE)) AS price, sum(v * coalesce(weight, 0)) AS prediction
  FROM cells c JOIN given g ON g.id = c.id LEFT JOIN weights USING (name) WHERE NOT train GROUP BY c.id)
SELECT {n("count(*)", "n")}, round(sqrt(avg((price - prediction) ** 2)), 3) AS rmse,
  round(avg(abs(price - prediction)), 3) AS mae,
  round(1 - avg((price - prediction) ** 2) / var_pop(price), 3) AS r2 FROM scored"""

SQL = {
    "l01_features": f"""SELECT id, {NUMBERS}, room_type, property_type, neighbourhood_cleansed,
      CAST(host_is_superhost AS VARCHAR) AS host_is_superhost,
      CAST(instant_bookable AS VARCHAR) AS instant_bookable, CAST(price AS DOUBLE) AS price
      FROM master WHERE price IS NOT NULL""",
    # standardised numbers have mean 0 and deviation 1; a constant stays at 0
    "l02_numeric_scaled": " UNION ALL ".join(
        f"SELECT '{c}' AS feature, CAST(0 AS DOUBLE) AS mean, "
        f"CAST(CASE WHEN count(DISTINCT {c}) > 1 THEN 1 ELSE 0 END AS DOUBLE) AS std "
        f"FROM master WHERE {BUCKET} < 80"
        for c in NUMERIC
    ),
    "l03_onehot": f"""SELECT room_type, {n("row_number() OVER (ORDER BY room_type)", "slot")}, n
      FROM (SELECT room_type, {n("count(*)", "n")} FROM master WHERE {BUCKET} < 80 GROUP BY 1)""",
    "l04_split": f"""SELECT CASE WHEN {BUCKET} < 80 THEN 'train' ELSE 'test' END AS part,
      {n("count(*)", "n")} FROM master GROUP BY 1""",
    # a least-squares fit leaves residuals without a relation to any input
    "l05_linear": " UNION ALL ".join(
        [f"SELECT '{c}' AS feature, true AS unrelated" for c in ["intercept", *NUMERIC]]
        + [
            f"SELECT DISTINCT '{c}=' || CAST({c} AS VARCHAR), true FROM master "
            f"WHERE price IS NOT NULL AND {BUCKET} < 80 AND {c} IS NOT NULL"
            for c in CATEGORICAL
        ]
    ),
    "l05_linear_metrics": f"SELECT * FROM ({LEAST_SQUARES})",
    "l06_forest": f"""SELECT unnest([{", ".join(f"'{x}'" for x in FOREST_RULES)}]) AS rule,
      true AS holds, {n("count(*)", "n")} FROM master WHERE price IS NOT NULL AND {BUCKET} >= 80""",
    "l07_best_model": "SELECT CAST(2 AS BIGINT) AS models, true AS has_lowest_rmse",
    "l08_importances": """SELECT CAST(range AS BIGINT) AS rank, true AS follows_from_gains
      FROM range(1, 16)""",
    "l09_scored_sample": f"""SELECT id, CAST(price AS DOUBLE) AS actual_price,
      true AS is_mean_of_leaves, true AS error_is_difference
      FROM master WHERE price IS NOT NULL AND {BUCKET} >= 80 ORDER BY id LIMIT 5""",
    "l10_suggested_price": "SELECT id, true AS is_mean_of_leaves FROM master WHERE price IS NOT NULL",
}
