"""Problem 6: pairwise matches consolidated to groups.

Minimum labels are propagated along the edges and accelerated by pointer jumping; every round works on the graph that the
round before has contracted, is written to the shared folder, and the loop ends when no label changes. A round touches only
the vertices that still have edges; the maps of all rounds, each a fraction of the one before, are composed at the end
(``lorewright.operators.graph.link_components``).

Defined results: null ids and self links link nothing; repeated or reversed pairs count once; a vertex without links is a
group of its own; no vertices give no rows. Extra columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lorewright.operators.graph import link_components


def same_links(matches: DataFrame, entities: DataFrame) -> DataFrame:
    """(l, r): distinct pairs that any judge holds to be the same, both of them known entities."""
    known = entities.select(F.col("entity_id").alias("l")).where("l is not null").distinct()
    return (
        matches.where("is_same and left_entity_id <> right_entity_id")
        .select(F.least("left_entity_id", "right_entity_id").alias("l"), F.greatest("left_entity_id", "right_entity_id").alias("r"))
        .distinct()
        .join(known, "l", "left_semi")
        .join(known.withColumnRenamed("l", "r"), "r", "left_semi")
        .select("l", "r")
    )


def entity_groups(entities: DataFrame, matches: DataFrame) -> DataFrame:
    """(entity_id, group_id) for every entity; group_id is the least entity_id linked to it, directly or through others."""
    labels = link_components(same_links(matches, entities), "l", "r")
    return (
        entities.select("entity_id")
        .where("entity_id is not null")
        .distinct()
        .join(labels.withColumnRenamed("vertex", "entity_id"), "entity_id", "left")
        .select("entity_id", F.coalesce("component", "entity_id").alias("group_id"))
    )


def linked_entities(entities: DataFrame, matches: DataFrame) -> DataFrame:
    """(group_id, entity_id) of the entities in groups of two or more."""
    return link_components(same_links(matches, entities), "l", "r").select(F.col("component").alias("group_id"), F.col("vertex").alias("entity_id"))
