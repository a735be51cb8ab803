"""Automata as relations, and the algorithms on them as joins and aggregates.

These answer the same questions as operators.lexer does on the driver, over any number of grammars at once: `grammar` is a column of every
relation.  Fixpoints are loops of frontier joins; each round's lineage is cut.
"""

from __future__ import annotations

import tempfile
from collections.abc import Iterable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .automaton import Nfa
from .lexer import Lexer


def cut(df: DataFrame) -> DataFrame:
    """Ends the lineage in the session's checkpoint folder; only a session without one (tests) gets a folder of its own."""
    spark = df.sparkSession
    if not spark.sparkContext._jsc.sc().getCheckpointDir().isDefined():
        spark.sparkContext.setCheckpointDir(spark.conf.get("spark.checkpoint.dir", None) or tempfile.mkdtemp(prefix="tokenlake-"))
    return df.checkpoint()


def delta(spark: SparkSession, lexers: dict[str, Lexer]) -> DataFrame:
    """(grammar, state, byte, next)"""
    rows = [(g, *r) for g, x in lexers.items() for r in x.dfa.rows()]
    return spark.createDataFrame(rows, "grammar string, state int, byte int, next int")


def accept(spark: SparkSession, lexers: dict[str, Lexer]) -> DataFrame:
    """(grammar, state, token_id, payload, ignored)"""
    rows = [(g, s, int(t), x.payloads.get(int(t), 0), int(t) in x.ignored) for g, x in lexers.items() for s, t in enumerate(x.dfa.accept) if t >= 0]
    return spark.createDataFrame(rows, "grammar string, state int, token_id long, payload long, ignored boolean")


def nfa_edges(spark: SparkSession, nfas: dict[str, Nfa]) -> DataFrame:
    """(grammar, src, sym, dst), sym null for an epsilon edge."""
    return spark.createDataFrame([(g, *r) for g, n in nfas.items() for r in n.rows()], "grammar string, src int, sym int, dst int")


def starts(spark: SparkSession, grammars: Iterable[str]) -> DataFrame:
    return spark.createDataFrame([(g, 0) for g in grammars], "grammar string, state int")


def reach(seed: DataFrame, edges: DataFrame, keys: list[str], source: str, target: str) -> DataFrame:
    """Rows (keys, node) that the seed rows (keys, node) lead to over edges, themselves included; `keys` travel along."""
    node = [c for c in seed.columns if c not in keys][0]
    have = cut(seed.distinct())
    frontier = have
    shared = [k for k in keys if k in edges.columns]
    while frontier.take(1):
        step = frontier.withColumnRenamed(node, source).join(edges, [*shared, source]).select(*keys, F.col(target).alias(node)).distinct()
        frontier = cut(step.join(have, [*keys, node], "left_anti"))
        have = cut(have.unionByName(frontier))
    return have


def epsilon_closure(edges: DataFrame) -> DataFrame:
    """(grammar, state, member): every state that epsilon edges lead to from each state."""
    states = edges.select("grammar", F.col("src").alias("s")).unionByName(edges.select("grammar", F.col("dst").alias("s"))).distinct()
    pairs = reach(states.select("grammar", F.col("s").alias("state"), F.col("s").alias("member")), edges.where("sym IS NULL"), ["grammar", "state"], "src", "dst")
    return pairs.select("grammar", "state", "member")


def reachable(d: DataFrame, start: DataFrame) -> DataFrame:
    return reach(start, d.select("grammar", "state", "next").distinct(), ["grammar"], "state", "next")


def leading_to(d: DataFrame, goals: DataFrame) -> DataFrame:
    """(grammar, state) from which a goal is within reach."""
    back = d.select("grammar", F.col("next").alias("from"), F.col("state").alias("to")).distinct()
    return reach(goals.select("grammar", "state"), back, ["grammar"], "from", "to")


def live(d: DataFrame, a: DataFrame, start: DataFrame) -> DataFrame:
    return reachable(d, start).intersect(leading_to(d, a))


def symbol_classes(d: DataFrame) -> DataFrame:
    """(grammar, byte, class): bytes with the same transitions share a class, numbered by their smallest byte."""
    rows = d.groupBy("grammar", "byte").agg(F.to_json(F.array_sort(F.collect_list(F.struct("state", "next")))).alias("signature"))
    least = rows.groupBy("grammar", "signature").agg(F.min("byte").alias("least"))
    order = least.alias("x").join(least.alias("y"), F.expr("x.grammar = y.grammar AND y.least <= x.least")).groupBy("x.grammar", "x.signature").agg((F.count("*") - 1).alias("class"))
    return rows.join(order, ["grammar", "signature"]).select("grammar", "byte", "class")


def split_points(d: DataFrame, a: DataFrame, start: DataFrame, relaxed: bool = False) -> DataFrame:
    """(grammar, byte): certified bytes, as an anti-join of what the start consumes with what other states consume."""
    reached = cut(reachable(d, start))
    able = cut(leading_to(d, a))
    useful = d.join(able.withColumnRenamed("state", "next"), ["grammar", "next"], "left_semi").join(reached, ["grammar", "state"], "left_semi")
    again = d.join(reached, ["grammar", "state"], "left_semi").where("next = 0").select("grammar").distinct().withColumn("again", F.lit(True))
    begins = useful.where("state = 0").select("grammar", "byte", F.col("next").alias("to"))
    offends = useful.join(again, "grammar", "left").where("state <> 0 OR again").select("grammar", "state", "byte", "next")
    if relaxed:
        kept = leading_to(d, a.where("NOT ignored"))
        forgiven = a.where("ignored").select("grammar", "state").join(kept, ["grammar", "state"], "left_anti").withColumn("forgiven", F.lit(True))
        offends = offends.join(forgiven, ["grammar", "state"], "left").join(begins, ["grammar", "byte"], "left").where("NOT (coalesce(forgiven, false) AND coalesce(next = to, false))")
    return begins.select("grammar", "byte").join(offends.select("grammar", "byte").distinct(), ["grammar", "byte"], "left_anti")


def windows_of_two(d: DataFrame, a: DataFrame, start: DataFrame) -> DataFrame:
    """(grammar, first, second, origin): certified two-byte windows, by joining the histories' cloud with the transitions twice.

    The bytes of one class behave alike, so clouds follow classes and are expanded at the end.
    """
    alive = cut(live(d, a, start))
    classes = symbol_classes(d)
    moves = d.join(alive.withColumnRenamed("state", "next"), ["grammar", "next"], "left_semi").join(classes, ["grammar", "byte"]).select("grammar", "state", "class", "next").distinct()
    moves = cut(moves)
    again = d.join(reachable(d, start), ["grammar", "state"], "left_semi").where("next = 0").select("grammar").distinct().withColumn("again", F.lit(True))
    nullable = a.where("state = 0").select("grammar").distinct()
    goals = a.select("grammar", "state").withColumn("goal", F.lit(True))
    every = moves.select("grammar", "class").distinct()

    def step(cloud: DataFrame, keys: list[str], at: int, new: str) -> DataFrame:
        """cloud: keys, state, origin.  Adds the class read as a column."""
        moved = cloud.join(moves, ["grammar", "state"]).join(again, "grammar", "left")
        moved = moved.select(*keys, F.col("class").alias(new), F.col("next").alias("state"), F.expr(f"CASE WHEN state = 0 AND again IS NULL THEN {at} ELSE origin END").alias("origin"))
        able = cloud.join(goals, ["grammar", "state"], "left_semi").select(*keys).distinct()
        seeds = able.join(moves.where("state = 0"), "grammar").select(*keys, F.col("class").alias(new), F.col("next").alias("state"), F.lit(at).alias("origin"))
        return moved.unionByName(seeds).distinct()

    one = cut(step(alive.select("grammar", "state", F.lit(-1).alias("origin")), ["grammar"], 0, "c1"))
    two = step(one, ["grammar", "c1"], 1, "c2")
    sure = two.groupBy("grammar", "c1", "c2").agg(F.min("origin").alias("origin"), F.max("origin").alias("other")).where("origin = other AND origin >= 0")
    sure = sure.join(nullable, "grammar", "left_anti").join(every.select("grammar").distinct(), "grammar", "left_semi")
    members = lambda c, b: classes.select("grammar", F.col("class").alias(c), F.col("byte").alias(b))
    return sure.join(members("c1", "first"), ["grammar", "c1"]).join(members("c2", "second"), ["grammar", "c2"]).select("grammar", "first", "second", "origin")


def dead_tokens(rules: DataFrame, candidates: DataFrame) -> DataFrame:
    """rules (grammar, token_id); candidates (grammar, subset, priority, token_id).  (grammar, token_id) that win nowhere."""
    winners = candidates.groupBy("grammar", "subset").agg(F.min(F.struct("priority", "token_id")).alias("w")).select("grammar", F.col("w.token_id").alias("token_id"))
    return rules.select("grammar", "token_id").distinct().join(winners, ["grammar", "token_id"], "left_anti")


def priority_ties(candidates: DataFrame) -> DataFrame:
    """(grammar, low, high): ids that meet in one subset at its winner's priority."""
    best = candidates.groupBy("grammar", "subset").agg(F.min("priority").alias("priority"))
    top = candidates.join(best, ["grammar", "subset", "priority"])
    pairs = top.alias("a").join(top.alias("b"), F.expr("a.grammar = b.grammar AND a.subset = b.subset AND a.token_id < b.token_id"))
    return pairs.select("a.grammar", F.col("a.token_id").alias("low"), F.col("b.token_id").alias("high")).distinct()
