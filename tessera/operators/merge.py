"""Merging graphs: entity features, linkage one to one within types, and unification."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.terms import lex
from ..graph import Graph
from ..namespaces import LABEL, TYPE
from .closure import checkpoint, components


def unify(triples: DataFrame, mapping: DataFrame) -> DataFrame:
    """Subjects and objects ``old`` replaced by ``new``; predicates stay."""
    a, b = mapping.select(F.col("old").alias("s"), F.col("new").alias("s2")), mapping.select(F.col("old").alias("o"), F.col("new").alias("o2"))
    return triples.join(a, "s", "left").join(b, "o", "left").select(F.coalesce("s2", "s").alias("s"), "p", F.coalesce("o2", "o").alias("o")).distinct()


def unify_entities(graph: Graph, keep: str, drop: str) -> Graph:
    return Graph(unify(graph.df, graph.spark.createDataFrame([(drop, keep)], "old string, new string")), graph.prefixes)


def features(triples: DataFrame, namespace: str) -> DataFrame:
    """(entity, types, labels): of typed entities in a namespace; a missing label is the text None."""
    own = triples.where(F.startswith(F.col("s"), F.lit("<" + namespace)))
    types = own.where(F.col("p") == TYPE).select(F.col("s").alias("entity"), F.col("o").alias("type"))
    labels = own.where(F.col("p") == LABEL).select(F.col("s").alias("entity"), lex(F.col("o")).alias("label"))
    both = types.join(labels, "entity", "left").withColumn("label", F.coalesce("label", F.lit("None")))
    return both.groupBy("entity").agg(F.array_sort(F.collect_set("type")).alias("types"), F.array_sort(F.collect_set("label")).alias("labels"))


def flat_features(found: DataFrame) -> DataFrame:
    """One value a feature: the least."""
    return found.select("entity", F.array_min("types").alias("type"), F.array_min("labels").alias("label"))


def clusters(a: DataFrame, b: DataFrame) -> DataFrame:
    """(type, left, right): entities of each type on either side."""
    side = lambda df, name: df.select("entity", F.explode("types").alias("type")).groupBy("type").agg(F.array_sort(F.collect_set("entity")).alias(name))
    none = F.array().cast("array<string>")
    return side(a, "left").join(side(b, "right"), "type", "full").select("type", F.coalesce("left", none).alias("left"), F.coalesce("right", none).alias("right"))


def common_types(a: DataFrame, b: DataFrame, namespace: str) -> DataFrame:
    """(type): types with entities of the namespace in both graphs."""
    kinds = lambda df: df.where((F.col("p") == TYPE) & F.startswith(F.col("s"), F.lit("<" + namespace))).select(F.col("o").alias("type"))
    return kinds(a).intersect(kinds(b))


def similarity(a, b):
    """1 less the edit distance over the longer length."""
    longest = F.greatest(F.length(a), F.length(b))
    return F.when(longest == 0, 1.0).otherwise(1 - F.levenshtein(a, b) / longest)


def link(a: DataFrame, b: DataFrame, threshold: float = 0.9, most_rounds: int = 20) -> DataFrame:
    """(left, right, score): one-to-one links of entities that share a type.

    A type with one entity on each side links at 1.0.  Other pairs score by
    name and label; best pairs link first (ties to the lesser left, then right name), until no pair is left at the threshold.

    Pairs of score 1 are found by equality and linked first.  Entities that are still free are compared inside their types where
    names or labels are near enough for the threshold (see ``_keys``), lengths that rule a pair out before its edit distance is taken.
    """
    name = lambda c: F.regexp_extract(c, "([^#/:]*)>$", 1)
    left, right = (df.select("entity", F.explode("types").alias("type"), F.array_min("labels").alias("label")).withColumn("name", name(F.col("entity"))) for df in (a, b))
    alone = left.groupBy("type").agg(F.count("*").alias("n"), F.min("entity").alias("left")).where("n = 1").join(right.groupBy("type").agg(F.count("*").alias("m"), F.min("entity").alias("right")).where("m = 1"), "type")
    l, r = left.alias("l"), right.alias("r")
    nameless = (F.col("l.label") == "None") | (F.col("r.label") == "None")
    equal = l.join(r, (F.col("l.type") == F.col("r.type")) & (F.col("l.name") == F.col("r.name")) & (nameless | (F.col("l.label") == F.col("r.label"))))
    sure = alone.select("left", "right").union(equal.select("l.entity", "r.entity")).distinct().withColumn("score", F.lit(1.0))
    first = _rounds(checkpoint(sure), most_rounds)
    if threshold >= 1:
        return first
    free = lambda df, side: df.join(first.select(F.col(side).alias("entity")), "entity", "left_anti")
    lengths = lambda x, y: F.when(F.greatest(F.length(x), F.length(y)) == 0, 1.0).otherwise(F.least(F.length(x), F.length(y)) / F.greatest(F.length(x), F.length(y)))
    both = lambda how: F.when(nameless, how(F.col("l.name"), F.col("r.name"))).otherwise((how(F.col("l.name"), F.col("r.name")) + how(F.col("l.label"), F.col("r.label"))) / 2)
    free_l, free_r = checkpoint(free(left, "left")), checkpoint(free(right, "right"))
    l, r = free_l.alias("l"), free_r.alias("r")
    alike = (F.col("l.type") == F.col("r.type")) & (both(lengths) >= threshold - 1e-6)
    near, loose = [], []
    for c in ("name", "label"):  # the mean is at the threshold only if one of them is
        named = [x if c == "name" else x.where("label <> 'None'") for x in (free_l, free_r)]
        a, b = (_keys(x, named[0].union(named[1]), c, 1 - threshold) for x in named)
        if c == "label":  # near labels are many where labels repeat: then the names are within twice the share
            a, b = (x.withColumn("also", F.explode(_near_name(2 - 2 * threshold))) for x in (a, b))
        near.append(a.alias("a").join(b.alias("b"), ["type", "key", *(["also"] if c == "label" else [])]).select("type", F.col("a.entity").alias("e"), F.col("b.entity").alias("f")))
        loose.append(_loose(c, 1 - threshold))
    near = near[0].union(near[1]).distinct()
    odd = loose[0] | loose[1]
    pairs = near.join(l, (F.col("l.type") == near["type"]) & (F.col("l.entity") == F.col("e"))).join(r, (F.col("r.type") == near["type"]) & (F.col("r.entity") == F.col("f"))).where(alike).select("l.*", F.struct("r.*").alias("r"))
    rest = free_l.where(odd).alias("l").join(r, alike).select("l.*", F.struct("r.*").alias("r")).union(l.join(free_r.where(odd).alias("r"), alike).select("l.*", F.struct("r.*").alias("r")))
    pairs = pairs.union(rest).select(F.struct("entity", "type", "label", "name").alias("l"), "r")
    scored = pairs.select(F.col("l.entity").alias("left"), F.col("r.entity").alias("right"), F.round(both(similarity), 6).alias("score")).where(F.col("score") >= threshold).distinct()
    return first.union(_rounds(checkpoint(scored), most_rounds))


def _edits(c: str, share: float):
    """Edits allowed to a pair whose longer text is this one, and to one whose shorter text it is."""
    return F.floor(F.length(c) * share + 1e-9), F.floor(F.length(c) * share / max(1 - share, 1e-9) + 1e-9)


def _grams(c: str):
    return F.array_distinct(F.transform(F.sequence(F.lit(1), F.greatest(F.length(c) - 2, F.lit(1))), lambda i: F.substr(c, i, F.lit(3))))


def _loose(c: str, share: float):
    """Texts too short for their edits to leave three letters whole: nothing shorter than a comparison finds their pairs."""
    most = _edits(c, share)[1]
    return (most >= 2) & (F.size(_grams(c)) < 3 * most + 1)


def _keys(df: DataFrame, everyone: DataFrame, c: str, share: float) -> DataFrame:
    """(type, entity, key): two texts within ``share`` of the longer one's length in edits have a key in common, unless one is loose.

    One edit: both without one letter, or as they are.  More: k edits change 3k runs of three letters at most, so
    the 3k + 1 rarest of each have one in common.
    """
    least, most = _edits(c, share)
    one = df.where(least <= 1).select("type", "entity", "name", F.explode(_without(c, share)).alias("key"))
    runs = df.where((most >= 2) & ~_loose(c, share)).select("type", "entity", "name", (3 * most + 1).alias("n"), F.explode(_grams(c)).alias("gram"))
    often = everyone.where(most >= 2).select("type", F.explode(_grams(c)).alias("gram")).groupBy("type", "gram").agg(F.count("*").alias("k"))
    place = F.row_number().over(Window.partitionBy("type", "entity", "n").orderBy("k", "gram"))
    rare = runs.join(often, ["type", "gram"]).withColumn("place", place).where("place <= n").select("type", "entity", "name", F.concat(F.lit("3:"), "gram"))
    return one.select("type", "entity", "name", F.concat(F.lit("1:"), "key").alias("key")).union(rare)


def _without(c: str, share: float):
    """The text, and where an edit is allowed the text without one letter."""
    text, none = F.col(c), F.array().cast("array<string>")
    each = F.transform(F.sequence(F.lit(1), F.greatest(F.length(c), F.lit(1))), lambda i: F.concat(F.substr(text, F.lit(1), i - 1), F.substr(text, i + 1, F.length(text))))
    return F.array_distinct(F.concat(F.array(text), F.when(_edits(c, share)[1] >= 1, each).otherwise(none)))


def _near_name(share: float):
    """Keys of which two names within ``share`` have one in common; names that may differ by more edits have all the same one."""
    least, most = _edits("name", share)
    none = F.array().cast("array<string>")
    return F.concat(F.when(least <= 1, F.transform(_without("name", share), lambda x: F.concat(F.lit("1:"), x))).otherwise(none), F.when(most >= 2, F.array(F.lit("*"))).otherwise(none))


def _rounds(open_pairs: DataFrame, most_rounds: int) -> DataFrame:
    """One-to-one links of scored pairs.

    Mutual best pairs link, round by round; pairs still
    open after ``most_rounds`` are linked in one pass, which gives the same links: best pairs first, each if both sides are free, one task a connected component.
    """
    done = open_pairs.limit(0)
    for _ in range(most_rounds):
        by_left = F.row_number().over(Window.partitionBy("left").orderBy(F.desc("score"), "right", "left"))
        by_right = F.row_number().over(Window.partitionBy("right").orderBy(F.desc("score"), "left", "right"))
        best = checkpoint(open_pairs.withColumn("a", by_left).withColumn("b", by_right).where("a = 1 and b = 1").select("left", "right", "score"))
        if best.isEmpty():
            return done
        done = done.union(best)
        open_pairs = checkpoint(open_pairs.join(best.select("left"), "left", "left_anti").join(best.select("right"), "right", "left_anti"))
    return done if open_pairs.isEmpty() else done.union(checkpoint(_greedy(open_pairs)))


def _greedy(pairs: DataFrame) -> DataFrame:
    """Links of (left, right, score) by falling score, where both sides are free."""
    edges = pairs.select(F.concat(F.lit("l"), "left").alias("s"), F.concat(F.lit("r"), "right").alias("o"))
    roots = components(edges).select("node", "root")
    rows = pairs.withColumn("node", F.concat(F.lit("l"), "left")).join(roots, "node").select("root", "left", "right", "score")

    def run(batches):
        left, right = set(), set()  # components share no entity, so the order within each is all that counts
        for pdf in batches:
            keep = []
            for a, b in zip(pdf["left"], pdf["right"]):
                free = a not in left and b not in right
                keep.append(free)
                if free:
                    left.add(a)
                    right.add(b)
            yield pdf.loc[keep, ["left", "right", "score"]]

    return rows.repartition("root").sortWithinPartitions(F.desc("score"), "left", "right").mapInPandas(run, "left string, right string, score double")


def merge_graphs(a: Graph, b: Graph, namespace: str, threshold: float = 0.9, types: list[str] | None = None, links: DataFrame | None = None) -> Graph:
    """Both graphs in one, with linked entities of the second renamed to those of the first.

    ``links`` (left, right): matches known beforehand, which replace the scored ones of their entities.
    """
    fa, fb = features(a.df, namespace), features(b.df, namespace)
    # entities that both graphs name alike need no link
    only_a, only_b = fa.join(fb.select("entity"), "entity", "left_anti"), fb.join(fa.select("entity"), "entity", "left_anti")
    if types is not None:
        wanted = F.array(*[F.lit(t) for t in types])
        only_a, only_b = only_a.where(F.arrays_overlap("types", wanted)), only_b.where(F.arrays_overlap("types", wanted))
    given = None
    if links is not None:
        given = links.select("left", "right")
        only_a = only_a.join(given.select(F.col("left").alias("entity")), "entity", "left_anti")
        only_b = only_b.join(given.select(F.col("right").alias("entity")), "entity", "left_anti")
    found = link(only_a, only_b, threshold).select("left", "right")
    if given is not None:
        found = found.union(given)
    union = (a + b).df
    return Graph(unify(union, found.select(F.col("right").alias("old"), F.col("left").alias("new"))), a.prefixes | b.prefixes)
