"""Relational projections of a graph: equipment, points and locations with foreign keys."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.terms import local_name
from ..namespaces import BLD, EQUIPMENT, HAS_LOCATION, HAS_POINT, IS_LOCATION_OF, IS_POINT_OF, LOCATION, POINT, SUBCLASS, TYPE, iri
from .closure import transitive

HAS_PART = iri(BLD + "hasPart")


def instances(triples: DataFrame, root: str) -> DataFrame:
    """(name, type): of a class and its subclasses; the greatest type of several is kept."""
    pairs = transitive(triples.where(F.col("p") == SUBCLASS).select("s", "o"))
    classes = pairs.where(F.col("o") == root).select(F.col("s").alias("o")).union(triples.sparkSession.createDataFrame([(root,)], "o string")).distinct()
    return triples.where(F.col("p") == TYPE).join(classes, "o", "left_semi").groupBy(F.col("s").alias("name")).agg(F.max("o").alias("type"))


def _owner(triples: DataFrame, forward: str, backward: str) -> DataFrame:
    """(owned, owner) from either direction of a relation."""
    a = triples.where(F.col("p") == forward).select(F.col("o").alias("owned"), F.col("s").alias("owner"))
    return a.union(triples.where(F.col("p") == backward).select(F.col("s").alias("owned"), F.col("o").alias("owner"))).distinct()


def tables(triples: DataFrame, strict: bool = False) -> dict[str, DataFrame]:
    """equipment (name, type, location), point (name, type, equipment), location (name, type).

    An equipment's location must be exactly one: others are null, or an error if ``strict``.
    """
    equipment, points, locations = (instances(triples, c) for c in (EQUIPMENT, POINT, LOCATION))
    of = _owner(triples, HAS_POINT, IS_POINT_OF)
    owner = of.join(equipment.select(F.col("name").alias("owner")), "owner", "left_semi").groupBy(F.col("owned").alias("name")).agg(F.max("owner").alias("equipment"))
    places = _owner(triples, IS_LOCATION_OF, HAS_LOCATION).join(locations.select(F.col("name").alias("owner")), "owner", "left_semi")
    place = places.groupBy(F.col("owned").alias("name")).agg(F.count("*").alias("n"), F.max("owner").alias("location"))
    if strict and not place.join(equipment, "name", "left_semi").where("n > 1").isEmpty():
        raise ValueError("an equipment has several locations")
    return {
        "equipment": equipment.join(place.where("n = 1").select("name", "location"), "name", "left"),
        "point": points.join(owner, "name", "left"),
        "location": locations,
    }


def upsert(old: DataFrame, new: DataFrame, key: str = "name") -> DataFrame:
    """Rows of ``new``, and those of ``old`` whose key it lacks."""
    return old.join(new.select(key), key, "left_anti").unionByName(new)


def class_tree(triples: DataFrame, root: str) -> DataFrame:
    """(parent, child, n_instances): subclass edges below a class, with the child's direct instances."""
    edges = triples.where(F.col("p") == SUBCLASS).select(F.col("s").alias("child"), F.col("o").alias("parent")).distinct()
    pairs = transitive(edges.select(F.col("child").alias("s"), F.col("parent").alias("o")))
    inside = pairs.where(F.col("o") == root).select(F.col("s").alias("child")).distinct()
    counts = triples.where(F.col("p") == TYPE).groupBy(F.col("o").alias("child")).agg(F.count("*").alias("n"))
    return edges.join(inside, "child", "left_semi").join(counts, "child", "left").select("parent", "child", F.coalesce("n", F.lit(0)).alias("n_instances"))


def objects_of(triples: DataFrame, root: str) -> DataFrame:
    """(name, type, points): instances below a class with the sorted local names of their points."""
    own = _owner(triples, HAS_POINT, IS_POINT_OF).groupBy(F.col("owner").alias("name")).agg(F.array_sort(F.collect_set(local_name(F.col("owned")))).alias("points"))
    return instances(triples, root).join(own, "name", "left")
