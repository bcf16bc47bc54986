"""Mixing sources to target weights, by a budget handed down a domain-language-source tree.

The root's budget is a share of all tokens. A node's budget is divided among its children in
proportion to their weights; a child that can't use its part (it holds fewer tokens, times
``epochs``) gets what it can use and the rest goes to its siblings by weight, before it is
missing anywhere else. So a shortage leaves a language only when all its sources are used
up, and a domain only when all its languages are. The water level of siblings is the largest
of (budget - what the smaller ones can use) / (weight of the others), found by a window.

A leaf orders its documents anew in each epoch by a seeded digest. It takes whole epochs
while its budget lasts, then the longest prefix of the next one that fits. The prefix ends
at a key; it is found by sums over 4096 ranges of keys, then 4096 ranges of the range where
it ends, then the few rows in there, so that no task orders a whole leaf. Documents are then
chosen by comparing their key with their leaf's, without a shuffle of texts.

Only DataFrame functions are used. Tokens are runs of characters other than blanks, tabs and
line breaks.

Defined cases: null languages, sources and domains are a node named ``unknown``; null and
empty texts have no tokens and cost nothing; rows equal in doc_id and text are taken or left
together; nodes without a positive weight get nothing; an empty table gives no rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .storage import cut

SEED = 3
#: Share of all tokens to be selected, and how often a document may be taken at most.
SHARE = 0.6
EPOCHS = 2
#: Weights of the nodes; ``None``: any other node. Sources of one language weigh the same.
DOMAINS = {"web": 0.5, "books": 0.3, "forums": 0.2, None: 0.1}
LANGUAGES = {"en": 0.4, "de": 0.2, "fr": 0.2, "es": 0.2, None: 0.05}
SOURCES = {None: 1.0}
UNKNOWN = "unknown"
LEVELS = ("domain", "lang", "source")
BROADCAST_ROWS = 500_000


def domain(source: Column) -> Column:
    """The given tables have no domain: numbered sources stand for three in turn."""
    number = F.regexp_extract(source, "([0-9]{1,9})$", 1).try_cast("int") % 3
    name = F.when(number == 0, "web").when(number == 1, "books").when(number == 2, "forums")
    return F.coalesce(name, F.lit(UNKNOWN))


def tokens(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit("[^ \\t\\r\\n]+")), F.lit(0)).cast("long")


def unit(doc_id: Column, text: Column) -> Column:
    return F.concat(F.coalesce(doc_id.cast("string"), F.lit("")), F.lit(":"), F.md5(F.coalesce(text, F.lit(""))))


def key(epoch: Column, of: Column, seed: int) -> Column:
    return F.md5(F.concat(F.lit(f"{seed}:"), epoch.cast("string"), F.lit(":"), of))


def _weight(name: Column, weights: dict) -> Column:
    out = F.lit(float(weights.get(None, 0.0)))
    for node, w in weights.items():
        if node is not None:
            out = F.when(name == node, F.lit(float(w))).otherwise(out)
    return out


def fill(nodes: DataFrame, parents: list[str], name: str) -> DataFrame:
    """nodes with (weight, room, given): given, the parent's budget, becomes the node's own."""
    siblings = Window.partitionBy(*[F.col(p) for p in parents]) if parents else Window.partitionBy(F.lit(1))
    ordered = siblings.orderBy(F.col("room") / F.col("weight"), name)
    before = F.coalesce(F.sum("room").over(ordered.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    others = F.sum("weight").over(ordered.rowsBetween(Window.currentRow, Window.unboundedFollowing))
    nodes = nodes.where("weight > 0").withColumn("level", (F.col("given") - before) / others)
    level = F.greatest(F.max("level").over(siblings), F.lit(0.0))
    return nodes.withColumn("given", F.least(F.col("room").cast("double"), F.col("weight") * level)).drop("level")


def budgets(leaves: DataFrame, share: float, epochs: int, weights: dict[str, dict]) -> DataFrame:
    """(domain, lang, source, tokens) to the same with ``budget``, in whole tokens."""
    room = leaves.withColumn("room", F.col("tokens") * epochs)
    total = F.coalesce(F.sum("tokens"), F.lit(0)).alias("total")
    given = leaves.agg((F.floor(total * F.lit(share))).cast("double").alias("given"))
    held: list[str] = []
    for name in LEVELS:
        nodes = room.groupBy(*held, name).agg(F.sum("room").alias("room"), F.sum("tokens").alias("tokens"))
        nodes = nodes.withColumn("weight", _weight(F.col(name), weights[name]))
        nodes = nodes.join(given, held) if held else nodes.withColumn("given", given.scalar())
        nodes = fill(nodes, held, name)
        held = [*held, name]
        given = nodes.select(*held, "given")
    return nodes.select(*held, "tokens", F.floor(F.col("given") + 1e-6).cast("long").alias("budget"))


def _ends(rows: DataFrame, digits: int) -> DataFrame:
    """Rows (leaf, key, tokens, rest, done) of ranges: the first that doesn't fit, by leaf."""
    sums = rows.withColumn("part", F.substring("key", 1, digits)).groupBy(*LEVELS, "rest", "done", "part")
    sums = sums.agg(F.sum("tokens").alias("n"))
    ordered = Window.partitionBy(*LEVELS).orderBy("part")
    sums = sums.withColumn("upto", F.col("done") + F.sum("n").over(ordered))
    over = sums.where("upto > rest").groupBy(*LEVELS).agg(F.min(F.struct("part", "upto", "n")).alias("end"))
    return over.select(*LEVELS, F.col("end.part").alias("part"), (F.col("end.upto") - F.col("end.n")).alias("before"))


def plan(rows: DataFrame, share: float, epochs: int, weights: dict[str, dict], seed: int) -> DataFrame:
    """(domain, lang, source, full, last): whole epochs of a leaf, and the last key of the next.

    rows: (domain, lang, source, unit, tokens), written before.
    """
    leaves = rows.groupBy(*LEVELS).agg(F.sum("tokens").alias("tokens"))
    whole = F.when(F.col("tokens") > 0, F.floor(F.col("budget") / F.col("tokens"))).otherwise(0).cast("int")
    leaves = budgets(leaves, share, epochs, weights).withColumn("full", whole)
    leaves = cut(leaves.withColumn("rest", F.col("budget") - F.col("full") * F.col("tokens")))
    ending = leaves.where(f"full < {int(epochs)} and (rest > 0 or full = 0)")
    inside = rows.join(F.broadcast(ending.select(*LEVELS, "full", "rest")) if leaves.count() <= BROADCAST_ROWS else ending.select(*LEVELS, "full", "rest"), list(LEVELS))
    inside = inside.select(*LEVELS, key(F.col("full"), F.col("unit"), seed).alias("key"), "tokens", "rest", F.lit(0).cast("long").alias("done"))
    for digits in (3, 6):
        ends = cut(_ends(inside, digits))
        inside = inside.drop("done", "part").join(ends, list(LEVELS)).where(F.substring("key", 1, digits) == F.col("part"))
        inside = cut(inside.select(*LEVELS, "key", "tokens", "rest", F.col("before").alias("done"), "part"))
    units = inside.groupBy(*LEVELS, "key", "rest", "done", "part").agg(F.sum("tokens").alias("n"))
    upto = F.col("done") + F.sum("n").over(Window.partitionBy(*LEVELS).orderBy("key"))
    fits = units.withColumn("upto", upto).groupBy(*LEVELS).agg(
        F.coalesce(F.max(F.when(F.col("upto") <= F.col("rest"), F.col("key"))), F.first("part")).alias("last")
    )
    # a leaf without a range that ends its budget is taken whole
    every = ending.join(fits, list(LEVELS), "left").select(*LEVELS, F.coalesce("last", F.lit("g")).alias("last"))
    return cut(leaves.select(*LEVELS, "full").join(every, list(LEVELS), "left"))


def select(
    docs: DataFrame,
    share: float = SHARE,
    epochs: int = EPOCHS,
    weights: dict[str, dict] | None = None,
    seed: int = SEED,
    of_domain: Column | None = None,
) -> DataFrame:
    """The columns of docs (doc_id, text, lang, source among them), __domain, __tokens and __epoch.

    One row for each time that a document is taken.
    """
    weights = {"domain": DOMAINS, "lang": LANGUAGES, "source": SOURCES} | (weights or {})
    node = F.coalesce(domain(F.col("source")) if of_domain is None else of_domain, F.lit(UNKNOWN))
    named = {"domain": node} | {c: F.coalesce(F.col(c).cast("string"), F.lit(UNKNOWN)) for c in ("lang", "source")}
    parts = [x.alias(c) for c, x in named.items()]
    one = unit(F.col("doc_id"), F.col("text"))
    rows = cut(docs.select(*parts, one.alias("unit"), tokens(F.col("text")).alias("tokens")))
    leaves = plan(rows, share, epochs, weights, seed).select(
        F.struct(*LEVELS).alias("__leaf"), F.col("full").alias("__full"), F.col("last").alias("__last")
    )
    if leaves.count() <= BROADCAST_ROWS:
        leaves = F.broadcast(leaves)
    wide = docs.withColumn("__leaf", F.struct(*parts)).withColumn("__unit", one)
    wide = wide.join(leaves, "__leaf")
    taken = F.when(F.col("__full") > 0, F.sequence(F.lit(0), F.col("__full") - 1)).otherwise(F.array().cast("array<int>"))
    next_ = F.when(key(F.col("__full"), F.col("__unit"), seed) <= F.col("__last"), F.array("__full"))
    taken = F.concat(taken, F.coalesce(next_, F.array().cast("array<int>")))
    wide = wide.withColumn("__epoch", F.explode(taken))
    return wide.select(*[F.col(f"`{c}`") for c in docs.columns], F.col("__leaf.domain").alias("__domain"), "__epoch")


def op3_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text", "lang", "source")
    return select(docs).select(
        "doc_id",
        F.col("__domain").alias("domain"),
        "lang",
        "source",
        tokens(F.col("text")).alias("tokens"),
        F.col("__epoch").cast("long").alias("epoch"),
    )


def keep_mixture(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pipeline stage: the selected documents, each at most once."""
    return select(docs, epochs=1).select(*[F.col(f"`{c}`") for c in docs.columns])


def _cases(name: str, weights: dict) -> str:
    whens = " ".join(f"WHEN {name} = '{k}' THEN {float(v)!r}::DOUBLE" for k, v in weights.items() if k is not None)
    other = f"{float(weights.get(None, 0.0))!r}::DOUBLE"
    return f"CASE {whens} ELSE {other} END" if whens else other


def _fill_sql(source: str, parents: list[str], name: str, given: str, weights: dict) -> str:
    held = ", ".join([*parents, name])
    part = f"PARTITION BY {', '.join(parents)}" if parents else ""
    joined = f"JOIN {given} USING ({', '.join(parents)})" if parents else f"CROSS JOIN {given}"
    return f"""
    SELECT {held}, tokens, least(room::DOUBLE, weight * greatest(max(level) OVER ({part}), 0)) AS given
    FROM (SELECT *, (given - coalesce(sum(room) OVER (o ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))
                 / sum(weight) OVER (o ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS level
          FROM (SELECT {held}, sum(tokens) AS tokens, sum(tokens) * {EPOCHS} AS room, {_cases(name, weights)} AS weight
                FROM {source} GROUP BY {held}) {joined}
          WHERE weight > 0 WINDOW o AS ({part} ORDER BY room / weight, {name}))"""


ORACLE_SQL = f"""
WITH parts AS (
    SELECT doc_id, lang, source, coalesce(lang, '{UNKNOWN}') AS l, coalesce(source, '{UNKNOWN}') AS s,
           coalesce(try_cast(regexp_extract(source, '([0-9]{{1,9}})$', 1) AS INTEGER) % 3, -1) AS third,
           coalesce(len(regexp_extract_all(text, '[^ \\t\\r\\n]+')), 0) AS tokens,
           coalesce(doc_id::VARCHAR, '') || ':' || md5(coalesce(text, '')) AS unit
    FROM documents),
docs AS (SELECT *, CASE third WHEN 0 THEN 'web' WHEN 1 THEN 'books' WHEN 2 THEN 'forums' ELSE '{UNKNOWN}' END AS d FROM parts),
whole AS (SELECT floor(coalesce(sum(tokens), 0) * {SHARE}::DOUBLE)::DOUBLE AS given FROM docs),
by_domain AS ({_fill_sql("docs", [], "d", "whole", DOMAINS)}),
by_language AS ({_fill_sql("docs", ["d"], "l", "(SELECT d, given FROM by_domain)", LANGUAGES)}),
by_source AS ({_fill_sql("docs", ["d", "l"], "s", "(SELECT d, l, given FROM by_language)", SOURCES)}),
leaves AS (SELECT d, l, s, tokens, floor(given + 1e-6)::BIGINT AS budget FROM by_source),
counts AS (SELECT *, (CASE WHEN tokens > 0 THEN budget // tokens ELSE 0 END)::BIGINT AS whole_epochs FROM leaves),
keyed AS (
    SELECT docs.*, whole_epochs, budget - whole_epochs * counts.tokens AS rest,
           md5('{SEED}:' || whole_epochs || ':' || unit) AS k
    FROM docs JOIN counts USING (d, l, s)),
ordered AS (SELECT *, sum(tokens) OVER (PARTITION BY d, l, s ORDER BY k) AS upto FROM keyed),
taken AS (
    SELECT *, unnest(range(whole_epochs)) AS epoch FROM ordered
    UNION ALL
    SELECT *, whole_epochs AS epoch FROM ordered
    WHERE whole_epochs < {EPOCHS} AND (rest > 0 OR whole_epochs = 0) AND upto <= rest)
SELECT doc_id, d AS domain, lang, source, tokens::BIGINT AS tokens, epoch::BIGINT AS epoch FROM taken
"""
