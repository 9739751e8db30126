"""Tagged device models: entities with marker tags become typed equipment, points and sites."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.terms import local_name, to_literal
from ..namespaces import BLD, EQUIPMENT, HAS_POINT, LABEL, POINT, SUBCLASS, TYPE, iri
from .closure import checkpoint, distinct
from .tags import _small, below, most_likely, tag_case, translated

POINT_TAGS = ["point", "sensor", "command", "cmd", "setpoint", "sp", "alarm", "status"]
DROPPED = "^(?:his.*|.*Ref|cur.*|disMacro|navName|tz|mod|id)$"


def entities(spark: SparkSession, model: dict) -> DataFrame:
    """(id, equip_ref, tags) of a model document: ``rows`` of cells whose values carry type prefixes.

    Markers are cells ``m:`` or ``M``; ids lose their prefix and quotes; a repeated id keeps its last row.
    """
    rows = [(k, {str(a): str(b) for a, b in r.items() if b is not None}) for k, r in enumerate(model.get("rows", []))]
    raw = spark.createDataFrame(rows, T.StructType([T.StructField("n", T.LongType()), T.StructField("cells", T.MapType(T.StringType(), T.StringType()))]))
    return entities_of(raw)


def entities_of(raw: DataFrame) -> DataFrame:
    """The same from rows (n, cells map) at any size."""
    name = lambda c: F.regexp_replace(F.regexp_replace(F.regexp_extract(c, "^(?:r:)?([^ ]*|\".*\")", 1), '"', ""), "^@", "")
    cells = F.col("cells")
    got = raw.select(
        "n",
        name(F.try_element_at(cells, F.lit("id"))).alias("id"),
        name(F.try_element_at(cells, F.lit("equipRef"))).alias("equip_ref"),
        F.array_sort(F.filter(F.map_keys(F.map_filter(cells, lambda k, v: v.isin("m:", "M"))), lambda k: ~F.rlike(k, F.lit(DROPPED)))).alias("tags"),
    ).where("id is not null")
    return got.withColumn("place", F.row_number().over(Window.partitionBy("id").orderBy(F.desc("n")))).where("place = 1").drop("place", "n")


def _likely(sets: DataFrame, lookup: DataFrame, allowed: DataFrame) -> DataFrame:
    """(id, class): the least allowed class among the most likely ones."""
    got = most_likely(sets.withColumn("tags", tag_case(F.col("tags"))), lookup)
    each = got.select("id", F.explode("classes").alias("class"))
    return each.join(allowed, "class", "left_semi").groupBy("id").agg(F.min("class").alias("class"))


def infer_entities(found: DataFrame, lookup: DataFrame, ontology: DataFrame, namespace: str, class_namespace: str = BLD) -> DataFrame:
    """Triples of entities (id, equip_ref, tags).

    A site without equip or point is a Site.  Otherwise tags but point tags, with equip, give an equipment
    (unless the entity refers to one); an entity with a point tag gives a point from its tags but equip.
    Both are linked and labelled; a referred-to entity gets the point if it is a node of the result.
    """
    markers = F.array(*map(F.lit, POINT_TAGS))
    site = F.array_contains("tags", "site") & ~F.array_contains("tags", "equip") & ~F.array_contains("tags", "point")
    has_ref = F.coalesce(F.col("equip_ref") != "", F.lit(False))
    found = checkpoint(found)
    kinds = checkpoint(found.select("tags").distinct())  # entities with equal tags are looked up once
    equips = checkpoint(kinds.select(F.col("tags").alias("id"), translated(F.array_union(F.array_except("tags", markers), F.array(F.lit("equip")))).alias("tags")))
    points = checkpoint(kinds.where(F.arrays_overlap("tags", markers)).select(F.col("tags").alias("id"), translated(F.array_except("tags", F.array(F.lit("equip")))).alias("tags")))
    e = _likely(equips, lookup, below(ontology, EQUIPMENT)).select(F.col("id").alias("tags"), F.col("class").alias("equip"))
    p = _likely(points, lookup, below(ontology, POINT)).select(F.col("id").alias("tags"), F.col("class").alias("point"))
    classes = _small(kinds.join(e, "tags", "left").join(p, "tags", "left"))
    known = checkpoint(found.join(classes, "tags").select("id", "equip_ref", site.alias("site"), F.when(~site & ~has_ref, F.col("equip")).alias("equip"), F.when(~site, F.col("point")).alias("point")))
    safe = F.replace(F.col("id"), F.lit(" "), F.lit("_"))
    node = lambda end: F.concat(F.lit(f"<{namespace}"), safe, F.lit(f"{end}>"))
    kind = lambda c: F.concat(F.lit(f"<{class_namespace}"), c, F.lit(">"))
    label = to_literal(F.col("id"))
    is_equip, is_point = F.col("equip").isNotNull(), F.col("point").isNotNull()
    items = [
        (F.col("site"), node(""), TYPE, F.lit(iri(class_namespace + "Site"))),
        (is_equip, node("_equip"), TYPE, kind(F.col("equip"))), (is_equip, node("_equip"), LABEL, label),
        (is_point, node("_point"), TYPE, kind(F.col("point"))), (is_point, node("_point"), LABEL, label),
        (is_equip & is_point, node("_equip"), HAS_POINT, node("_point")),
    ]
    structs = F.array(*[F.when(test, F.struct(s.alias("s"), F.lit(q).alias("p"), o.alias("o"))) for test, s, q, o in items])
    out = known.select(F.explode(F.filter(structs, lambda x: x.isNotNull())).alias("t")).select("t.*")
    refs = known.where(has_ref & is_point).join(known.where(is_equip).select(F.col("id").alias("equip_ref")), "equip_ref", "left_semi")
    ref = F.concat(F.lit(f"<{namespace}"), F.replace(F.col("equip_ref"), F.lit(" "), F.lit("_")), F.lit("_equip>"))
    return distinct(out.union(refs.select(ref, F.lit(HAS_POINT), node("_point"))))


def infer_model(spark: SparkSession, model: dict, ontology, namespace: str) -> DataFrame:
    """Triples of a model document; ``ontology``: triples with class tags and the class tree."""
    from .tags import lookup_table

    df = ontology if isinstance(ontology, DataFrame) else ontology.df
    return infer_entities(entities(spark, model), lookup_table(df), df, namespace)


def rdf_entities(triples: DataFrame, marker_class: str, is_property: str, tag_property: str) -> DataFrame:
    """(id, equip_ref, tags) of instances in an RDF device model.

    Instances are subjects whose types reach ``marker_class`` through type, ``is_property`` and subclass edges;
    their tags are the objects of ``tag_property``.
    """
    from .closure import transitive

    up = transitive(triples.where(F.col("p").isin(TYPE, is_property, SUBCLASS)).select("s", "o"))
    inst = up.where(F.col("o") == marker_class).select("s").distinct()
    tags = triples.where(F.col("p") == tag_property).select("s", local_name(F.col("o")).alias("tag")).where(~F.rlike("tag", F.lit(DROPPED)))
    return inst.join(tags, "s", "left").groupBy(F.col("s").alias("id")).agg(F.array_sort(F.collect_set("tag")).alias("tags")).select("id", F.lit("").alias("equip_ref"), "tags")


