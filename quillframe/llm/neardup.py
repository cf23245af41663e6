"""Problem 5: near-duplicate records with small edits.

Method: exact set-similarity join with set-relation skipping, see :mod:`quillframe.llm.setjoin`.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillframe.llm import graph, setjoin
from quillframe.llm.common import cut, name_free, salted_join, words

LEAST_WORDS = 12
SIMILARITY = 0.75


def query_sets(tasks: DataFrame, least: int = LEAST_WORDS) -> DataFrame:
    """(id, set_id, words) of every task whose query has at least ``least`` distinct words."""
    rows = name_free(tasks, "instance_id", "user_query").where("instance_id IS NOT NULL AND user_query IS NOT NULL").distinct()
    return setjoin.distinct_sets(rows.select("instance_id", words(F.col("user_query")).alias("w")), "instance_id", "w", least)


def members_to_pairs(links: DataFrame, members: DataFrame) -> DataFrame:
    """Expand links between sets, and the copies within each set, to pairs of different instances; the members of a set
    with very many copies are dealt into cells."""
    a = members.select(F.col("id").alias("x"), F.col("set_id").alias("a"))
    b = members.select(F.col("id").alias("y"), F.col("set_id").alias("b"))
    between = salted_join(salted_join(links.select("a", "b"), a, "a"), b, "b").select("x", "y")
    within = salted_join(a.withColumnRenamed("a", "b"), b, "b").where("x < y").select("x", "y")
    pair = between.unionByName(within).where("x != y")
    return pair.select(F.least("x", "y").alias("instance_id_a"), F.greatest("x", "y").alias("instance_id_b")).distinct()


def similar_pairs(tasks: DataFrame, similarity: float = SIMILARITY, least: int = LEAST_WORDS) -> DataFrame:
    """Pairs (instance_id_a, instance_id_b) of different tasks whose queries share at least ``similarity`` of their words.

    Null ids and queries, empty queries and queries of fewer than ``least`` distinct words have no pairs; repeated rows
    count once; a task with two different queries pairs if either does; extra columns are ignored; an empty table
    gives an empty result.
    """
    sets = cut(query_sets(tasks, least))
    links = cut(setjoin.similar_sets(sets, similarity).select("a", "b"))
    return members_to_pairs(links, sets.select("id", "set_id").distinct())


def similar_groups(tasks: DataFrame, similarity: float = SIMILARITY, least: int = LEAST_WORDS) -> DataFrame:
    """One row per task with a query: (instance_id, group_id, n_links, group_size).

    ``group_id`` is the smallest set id of the connected class; ``n_links`` counts the different query texts linked to
    the task's own; a task without partners is its own class. Copies share a class without being expanded to pairs.
    """
    sets = cut(query_sets(tasks, least))
    links = cut(setjoin.similar_sets(sets, similarity).select("a", "b"))
    label = graph.components(links)
    degree = links.select(F.col("a").alias("v")).unionAll(links.select(F.col("b").alias("v"))).groupBy("v").agg(F.count("*").alias("n_links"))
    members = sets.select("id", "set_id").distinct()
    out = members.join(label.withColumnRenamed("v", "set_id"), "set_id", "left").join(degree.withColumnRenamed("v", "set_id"), "set_id", "left")
    out = out.select(
        F.col("id").alias("instance_id"),
        F.coalesce("label", "set_id").alias("group_id"),
        F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"),
    )
    sizes = out.groupBy("group_id").agg(F.count("*").alias("group_size"))
    return out.join(sizes, "group_id").select("instance_id", "group_id", "n_links", "group_size")
