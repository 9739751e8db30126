"""Pattern alignments: classes annotated with tags through regular expressions."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import terms
from ..namespaces import BLD, EQUIPMENT, FIRST, REST, SH, SUBCLASS, TYPE, iri
from .closure import transitive

TAG_PROPERTY = iri(BLD + "hasAlignmentTag")


def class_patterns(triples: DataFrame) -> DataFrame:
    """(class, pattern): of ``targetClass`` shapes, on a property of the shape or inside its ``or`` list."""
    edge = lambda name: triples.where(F.col("p") == iri(SH + name)).select("s", "o")
    shapes = edge("targetClass").select(F.col("s").alias("shape"), F.col("o").alias("class"))
    steps = triples.where(F.col("p") == REST).select("s", "o")
    heads = edge("or").select(F.col("s").alias("shape"), F.col("o").alias("cell"))
    cells = heads.union(heads.join(transitive(steps).withColumnRenamed("s", "cell"), "cell").select("shape", F.col("o").alias("cell")))
    members = cells.join(triples.where(F.col("p") == FIRST).select(F.col("s").alias("cell"), F.col("o").alias("member")), "cell").select("shape", "member")
    carriers = shapes.select("shape", F.col("shape").alias("member")).union(members)
    props = edge("property").select(F.col("s").alias("member"), F.col("o").alias("prop"))
    carriers = carriers.union(carriers.join(props, "member").select("shape", F.col("prop").alias("member")))
    patterns = edge("pattern").select(F.col("s").alias("member"), terms.lex(F.col("o")).alias("pattern"))
    return carriers.join(patterns, "member").join(shapes, "shape").select("class", "pattern").distinct()


def tags_of_patterns(patterns: DataFrame, tags: DataFrame) -> DataFrame:
    """(pattern, tag): tags that a pattern matches from their start.

    A regular expression can't be hashed: the smaller side, distinct patterns of an alignment, is what each
    tag is compared with.
    """
    distinct = patterns.select("pattern").distinct()
    return distinct.join(tags.select("tag").distinct(), F.rlike(F.col("tag"), F.concat(F.lit("^(?:"), F.col("pattern"), F.lit(")"))))


def common_prefix(values) -> F.Column:
    """Longest common prefix of an array of strings, hyphens trimmed off both ends."""
    low, high = F.array_min(values), F.array_max(values)
    shared = F.filter(F.sequence(F.lit(0), F.least(F.length(low), F.length(high))), lambda n: F.substr(low, F.lit(1), n) == F.substr(high, F.lit(1), n))
    return F.btrim(F.substr(low, F.lit(1), F.array_max(shared)), F.lit("-"))


def specific_class(triples: DataFrame, classes: DataFrame) -> DataFrame:
    """(s, class): of each subject's types that have a pattern, the one with the fewest subclasses among them."""
    types = triples.where(F.col("p") == TYPE).select("s", F.col("o").alias("class")).distinct().join(classes.select("class").distinct(), "class", "left_semi")
    pairs = transitive(triples.where(F.col("p") == SUBCLASS).select("s", "o")).where("s <> o")
    lower = types.join(pairs.select(F.col("s").alias("low"), F.col("o").alias("class")), "class").join(types.select("s", F.col("class").alias("low")), ["s", "low"]).groupBy("s", "class").agg(F.count("*").alias("n"))
    scored = types.join(lower, ["s", "class"], "left").withColumn("n", F.coalesce("n", F.lit(0)))
    return scored.withColumn("place", F.row_number().over(Window.partitionBy("s").orderBy("n", "class"))).where("place = 1").select("s", "class")


def annotate(triples: DataFrame, alignment: DataFrame, tags: DataFrame | None = None, tag_property: str = TAG_PROPERTY) -> DataFrame:
    """Tag triples for equipment: the tag its class's pattern matches, or the common prefix of several.

    ``tags`` (tag): the master list; without it the alignment's own literals of ``tag_property`` serve.
    """
    from ..operators.tags import below

    if tags is None:
        tags = alignment.where(F.col("p") == tag_property).select(terms.lex(F.col("o")).alias("tag"))
    patterns = class_patterns(alignment)
    equipment = below(triples.union(alignment), EQUIPMENT)
    own = specific_class(triples.union(alignment.where(F.col("p") == SUBCLASS)).distinct(), patterns)
    own = own.withColumn("local", terms.local_name(F.col("class"))).join(equipment.withColumnRenamed("class", "local"), "local", "left_semi")
    first = patterns.groupBy("class").agg(F.min("pattern").alias("pattern"))
    hits = own.join(first, "class").join(tags_of_patterns(patterns, tags), "pattern").groupBy("s").agg(F.array_sort(F.collect_set("tag")).alias("tags"))
    tag = F.when(F.size("tags") == 1, F.col("tags")[0]).otherwise(common_prefix(F.col("tags")))
    return hits.select("s", F.lit(tag_property).alias("p"), terms.to_literal(tag).alias("o")).where(F.length("o") > 2)


def classes_of_tag(alignment: DataFrame, tag: str) -> DataFrame:
    """Classes whose pattern matches a tag; a tag with a wildcard is an error."""
    if "*" in tag:
        raise ValueError("wildcards are not allowed")
    return class_patterns(alignment).where(F.rlike(F.lit(tag), F.concat(F.lit("^(?:"), F.col("pattern"), F.lit(")")))).select("class").distinct()
