"""Itemsets, rules and sequences."""

from __future__ import annotations

from pyspark.sql import functions as P

from foldlight.operators import patterns, sequences
from foldlight.plans.catalog.registry import query, rounded
from foldlight.sources.readers import table

SUPPORT, CONFIDENCE = 0.02, 0.15

SQL_SETS = f"""
b AS (SELECT DISTINCT l_orderkey AS o, 'p' || CAST(l_partkey % 20 AS VARCHAR) AS i FROM lineitem),
total AS (SELECT count(DISTINCT o) AS n FROM b),
sets AS (
  SELECT [i] AS items, count(*) AS freq FROM b GROUP BY i
  UNION ALL SELECT [x.i, y.i], count(*) FROM b x JOIN b y ON x.o = y.o AND x.i < y.i GROUP BY x.i, y.i
  UNION ALL SELECT [x.i, y.i, z.i], count(*) FROM b x JOIN b y ON x.o = y.o AND x.i < y.i
    JOIN b z ON z.o = y.o AND y.i < z.i GROUP BY x.i, y.i, z.i),
frequent AS (SELECT items, freq FROM sets, total WHERE freq >= ceil({SUPPORT} * n)),
rules AS (
  SELECT a.items AS antecedent, w.consequent, w.freq / a.freq AS confidence
  FROM (SELECT items, freq, unnest(items) AS consequent FROM frequent WHERE len(items) > 1) w
  JOIN frequent a ON a.items = list_filter(w.items, lambda t: t <> w.consequent)
  WHERE w.freq / a.freq >= {CONFIDENCE})"""


def baskets(spark, folder):
    lines = table(spark, folder, "lineitem").select(
        "l_orderkey", P.concat(P.lit("p"), P.col("l_partkey") % 20).alias("part")
    )
    return patterns.baskets_from_rows(lines, ["l_orderkey"], "part").select("items")


@query(
    "g1_frequent_itemsets",
    f"WITH {SQL_SETS} SELECT list_aggregate(items, 'string_agg', ' ') AS items, freq FROM frequent",
)
def g1_frequent_itemsets(spark, folder):
    sets = patterns.frequent_itemsets(baskets(spark, folder), SUPPORT)
    return sets.select(P.array_join("items", " ").alias("items"), "freq")


SQL_RULES = f"""WITH {SQL_SETS}
SELECT list_aggregate(antecedent, 'string_agg', ' ') AS antecedent, consequent,
  round(confidence, 8) AS confidence FROM rules"""


def rule_columns(df):
    return df.select(
        P.array_join("antecedent", " ").alias("antecedent"),
        P.col("consequent")[0].alias("consequent"),
        *rounded(8, "confidence"),
    )


@query("g2_basket_rules", SQL_RULES)
def g2_basket_rules(spark, folder):
    return rule_columns(patterns.basket_rules(baskets(spark, folder), SUPPORT, CONFIDENCE))


@query("g3_association_rules", SQL_RULES)
def g3_association_rules(spark, folder):
    sets = patterns.frequent_itemsets(baskets(spark, folder), SUPPORT)
    return rule_columns(patterns.association_rules(sets, CONFIDENCE))


@query(
    "g4_frequent_sequences",
    """WITH e AS (SELECT DISTINCT user_id AS u, CAST(ts AS DATE) AS d, event_type AS t FROM events),
    total AS (SELECT count(DISTINCT u) AS n FROM e),
    ends AS (SELECT u, t, min(d) AS first, max(d) AS last FROM e GROUP BY ALL),
    sets AS (
      SELECT t AS pattern, count(*) AS freq FROM ends GROUP BY t
      UNION ALL SELECT a.t || ' > ' || b.t, count(*) FROM ends a JOIN ends b ON a.u = b.u AND a.first < b.last
        GROUP BY a.t, b.t
      UNION ALL SELECT x || '+' || y, count(DISTINCT u) FROM (
        SELECT a.u, a.t AS x, b.t AS y FROM e a JOIN e b ON a.u = b.u AND a.d = b.d AND a.t < b.t) GROUP BY x, y)
    SELECT pattern, freq FROM sets, total WHERE freq >= ceil(0.5 * n)""",
)
def g4_frequent_sequences(spark, folder):
    return sequence_patterns(spark, folder, 2)


def sequence_patterns(spark, folder, length):
    events = table(spark, folder, "events").select(
        "user_id", P.to_date("ts").alias("day"), "event_type"
    )
    rows = patterns.sequences_from_rows(events, ["user_id"], "day", "event_type")
    found = patterns.frequent_sequences(rows.select("sequence"), 0.5, length)
    steps = P.transform("sequence", lambda s: P.array_join(P.sort_array(s), "+"))
    return found.select(P.array_join(steps, " > ").alias("pattern"), "freq")


def sql_longer(k: int) -> str:
    """Patterns of k + 1 items from the frequent ones of k: a later step, or one more item in the last step.

    ``last`` is the first day a pattern can end on, ``before`` that of its steps but the last one.
    """
    return f"""
    p{k + 1} AS (
      SELECT p.u, p.pattern || ' > ' || e.t AS pattern, p.last AS before, [e.t] AS step, min(e.d) AS last
      FROM p{k} p JOIN f{k} USING (pattern) JOIN e ON e.u = p.u AND e.d > p.last GROUP BY ALL
      UNION ALL SELECT p.u, p.pattern || '+' || e.t, p.before, list_append(p.step, e.t), min(e.d)
      FROM p{k} p JOIN f{k} USING (pattern) JOIN e ON e.u = p.u AND e.d > p.before AND e.t > p.step[-1]
        JOIN days ON days.u = e.u AND days.d = e.d AND list_has_all(days.items, p.step) GROUP BY ALL),
    f{k + 1} AS (SELECT pattern, count(*) AS freq FROM p{k + 1} GROUP BY pattern
      HAVING count(*) >= (SELECT ceil(0.5 * n) FROM total))"""


SEQUENCE_LENGTH = 5
SQL_SEQUENCES = f"""WITH e AS (SELECT DISTINCT user_id AS u, CAST(ts AS DATE) AS d, event_type AS t FROM events),
    total AS (SELECT count(DISTINCT u) AS n FROM e),
    days AS (SELECT u, d, list(t) AS items FROM e GROUP BY u, d),
    p1 AS (SELECT u, t AS pattern, DATE '0001-01-01' AS before, [t] AS step, min(d) AS last FROM e GROUP BY u, t),
    f1 AS (SELECT pattern, count(*) AS freq FROM p1 GROUP BY pattern
      HAVING count(*) >= (SELECT ceil(0.5 * n) FROM total)),
    {",".join(sql_longer(k) for k in range(1, SEQUENCE_LENGTH))}
    {" UNION ALL ".join(f"SELECT pattern, freq FROM f{k}" for k in range(1, SEQUENCE_LENGTH + 1))}"""


@query("g4_frequent_sequences_of_five", SQL_SEQUENCES)
def g4_frequent_sequences_of_five(spark, folder):
    return sequence_patterns(spark, folder, SEQUENCE_LENGTH)


@query("g4_sequences_by_id_lists", SQL_SEQUENCES)
def g4_sequences_by_id_lists(spark, folder):
    events = table(spark, folder, "events").select("user_id", P.to_date("ts").alias("day"), "event_type")
    found = sequences.frequent_sequences_by_lists(events, ["user_id"], "day", "event_type", 0.5, SEQUENCE_LENGTH)
    steps = P.transform("sequence", lambda s: P.array_join(s, "+"))
    return found.select(P.array_join(steps, " > ").alias("pattern"), "freq")
