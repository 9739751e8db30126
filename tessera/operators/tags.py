"""Tag sets to classes: exact, approximate and most likely matches."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.terms import local_name
from ..namespaces import EQUIPMENT, HAS_ASSOCIATED_TAG, HAS_TAG, POINT, SUBCLASS, TYPE
from .closure import checkpoint, transitive

#: Tables of so many rows and characters at most are broadcast.
SMALL_ROWS, SMALL_TEXT = 100_000, 16 << 20
GENERIC = ["Point", "Equipment", "Location"]
#: Tags of the vocabulary and the device-model markers (in lower case) that stand for them.
_MARKERS = {
    "AHU": "ahu airhandlingequip", "Air": "air", "Average": "avg", "CO": "co", "CO2": "co2", "Chiller": "chillermechanismtype", "Command": "cmd", "Compressor": "rotaryscrew",
    "Condenser": "condenserlooptype", "Cool": "cool cooling coolingonly", "Cool Coil Equipment": "coolingcoil", "Cool Tower Equipment": "coolingtower", "Damper": "damper",
    "Differential": "delta", "Discharge Supply": "discharge", "Economizer": "economizing", "Electrical": "elec", "Equipment": "device equip", "Evaporative": "evaporator",
    "Exhaust": "exhaust", "FCU": "fcu", "Fan": "fan", "Flow": "flow", "Frequency": "freq", "Fuel Oil": "fueloil", "Fume Hood": "fumehood", "HVAC": "hvac",
    "Heat": "elecheat fueloilheating heat heating steamheating", "Heat Coil Equipment": "heatingcoil", "Heat Exchanger Equipment": "heatexchanger heatpump", "Heat Wheel": "heatwheel",
    "Humidity": "humidity", "Lighting": "lights lightsgroup", "Lighting Equipment": "lighting", "Luminance": "luminous", "Meter Equipment": "meterscopetype sitemeter submeter",
    "Mixed": "mixing", "Natural Gas": "naturalgas", "Occupied": "occ", "Outside": "outside", "Point": "point", "Power": "apparent", "Pressure": "atmospheric barometric pressure",
    "RTU": "rtu", "Rain": "precipitation", "Real": "active", "Return": "return", "Rooftop": "roof rooftop", "Sensor": "sensor", "Setpoint": "sp", "Status": "state",
    "Temperature": "temp", "Terminal Unit": "airterminalunit", "Unoccupied": "unocc", "VAV": "variableairvolume vav", "Valve": "valve", "Voltage": "volt", "Water": "water", "Zone": "zone",
}
TAG_MAP = {marker: tags.split() for tags, markers in _MARKERS.items() for marker in markers.split()}
#: Abbreviations in point names and the words they stand for.
ABBREVIATIONS = {
    k: v.split()
    for k, v in {
        "ahu": "AHU", "chw": "Chilled Water", "chwst": "Chilled Water Supply Temperature", "cmd": "Command", "co2": "CO2", "da": "Discharge Air", "dpr": "Damper", "ea": "Exhaust Air",
        "hum": "Humidity", "hw": "Hot Water", "ma": "Mixed Air", "oa": "Outside Air", "occ": "Occupied", "pres": "Pressure", "ra": "Return Air", "sa": "Supply Air", "sp": "Setpoint", "sts": "Status",
        "tmp": "Temperature", "vav": "VAV", "vfd": "VFD", "vlv": "Valve", "zn": "Zone", "znt": "Zone Temperature",
    }.items()
}


def abbreviated(names: DataFrame, id_col: str = "id", name_col: str = "name") -> DataFrame:
    """(id, tags): words of point names, split at anything but letters and digits and spelled out where they are abbreviations."""
    words = F.filter(F.split(F.col(name_col), "[^A-Za-z0-9]+"), lambda x: x != "")
    return translate(names.select(id_col, words.alias("tags")), ABBREVIATIONS, id_col)


def tag_case(tags):
    """Each tag with its first letter in upper case."""
    return F.transform(tags, lambda x: F.concat(F.upper(F.substr(x, F.lit(1), F.lit(1))), F.substr(x, F.lit(2), F.length(x))))


def lookup_table(triples: DataFrame) -> DataFrame:
    """(tags, classes): sorted local tag names and the sorted local names of the classes that have them."""
    tags = triples.where(F.col("p") == HAS_ASSOCIATED_TAG).select("s", "o").distinct()
    pairs = tags.select(local_name(F.col("s")).alias("class"), local_name(F.col("o")).alias("tag"))
    sets = pairs.groupBy("class").agg(F.array_sort(F.collect_set("tag")).alias("tags"))
    return sets.groupBy("tags").agg(F.array_sort(F.collect_set("class")).alias("classes"))


def exact(sets: DataFrame, lookup: DataFrame, id_col: str = "id") -> DataFrame:
    """(id, tags, class): classes with exactly these tags; ``sets`` has the columns id and tags."""
    keyed = sets.select(id_col, F.array_sort(F.array_distinct("tags")).alias("tags"))
    return keyed.join(lookup, "tags").select(id_col, "tags", F.explode("classes").alias("class"))


def approximate(sets: DataFrame, lookup: DataFrame, id_col: str = "id") -> DataFrame:
    """(id, class_tags, classes, generic): candidates that contain or are contained in the tags with one generic tag added.

    Equal tag sets are looked up once.  A candidate that is contained has its rarest tag among the tags, one that
    contains them has the rarest of them, so the joins go over one tag of either.
    """
    base = sets.select(id_col, F.array_sort(F.array_distinct("tags")).alias("own"))
    held = checkpoint(lookup.select(F.array_distinct("tags").alias("class_tags"), "classes").where(~F.exists("class_tags", lambda x: x.isNull())))
    tried = base.select("own").distinct().select("own", F.explode(F.array(*map(F.lit, GENERIC))).alias("generic")).withColumn("q", F.array_distinct(F.concat("own", F.array("generic"))))
    seen = held.select("class_tags", "classes", F.explode("class_tags").alias("tag"))
    often = checkpoint(seen.groupBy("tag").agg(F.count("*").alias("k")))
    rarest = seen.join(often, "tag").groupBy("class_tags").agg(F.min_by("tag", F.struct("k", "tag")).alias("tag"))
    inside = tried.select("own", "generic", "q", F.explode("q").alias("tag")).join(held.join(rarest, "class_tags"), "tag").where(F.size(F.array_except("class_tags", "q")) == 0)
    known = tried.select("own", "generic", "q", F.explode("q").alias("tag")).join(often, "tag").groupBy("own", "generic", "q").agg(F.count("*").alias("n"), F.min_by("tag", F.struct("k", "tag")).alias("tag")).where(F.col("n") == F.size("q"))
    around = known.join(seen, "tag").where((F.size("class_tags") > F.size("q")) & (F.size(F.array_except("q", "class_tags")) == 0))
    columns = ["own", "class_tags", "classes", "generic"]
    return base.join(_small(inside.select(columns).union(around.select(columns))), "own").select(id_col, "class_tags", "classes", "generic")


def _small(df: DataFrame) -> DataFrame:
    """Evaluated once, and broadcast where its rows and text are few."""
    df = checkpoint(df)
    rows, text = df.agg(F.count("*"), F.sum(F.length(F.to_json(F.struct(*df.columns))))).first()
    return F.broadcast(df) if rows <= SMALL_ROWS and (text or 0) <= SMALL_TEXT else df


def _best(sets: DataFrame, lookup: DataFrame) -> DataFrame:
    """(tags, all, first) of distinct tag sets that share a tag with a class."""
    held = checkpoint(lookup.select(F.col("tags").alias("class_tags"), F.array_min("classes").alias("class")))
    shared = sets.select("tags", F.explode("tags").alias("tag")).join(held.select("class_tags", "class", F.explode("class_tags").alias("tag")), "tag").groupBy("tags", "class_tags", "class").agg(F.count("*").alias("n"))
    rank = F.rank().over(Window.partitionBy("tags").orderBy(F.desc("n"), F.size("class_tags") - F.col("n")))
    best = shared.withColumn("place", rank).where("place = 1")
    return best.groupBy("tags").agg(F.array_sort(F.collect_set("class")).alias("all"), F.min_by("class_tags", "class").alias("first"))


def most_likely(sets: DataFrame, lookup: DataFrame, most: int | None = None, id_col: str = "id") -> DataFrame:
    """(id, classes, leftover): one class (the least) of each best tag set and the tags the first leaves over.

    Best: most tags in common, then fewest tags besides.  No match: no classes and all tags left over.
    """
    base = sets.select(id_col, F.array_sort(F.array_distinct("tags")).alias("tags"))
    out = base.join(_small(_best(base.select("tags").distinct(), lookup)), "tags", "left")
    classes = F.coalesce("all", F.array().cast("array<string>"))
    if most is not None and most > 0:
        classes = F.slice(classes, 1, most)
    return out.select(id_col, classes.alias("classes"), F.array_sort(F.array_except("tags", F.coalesce("first", F.array().cast("array<string>")))).alias("leftover"))


def tag_sets(triples: DataFrame) -> DataFrame:
    """(id, tags): local names of each entity's tags."""
    own = triples.where(F.col("p") == HAS_TAG).select(F.col("s").alias("id"), local_name(F.col("o")).alias("tag"))
    return own.groupBy("id").agg(F.array_sort(F.collect_set("tag")).alias("tags"))


def expand_tags(triples: DataFrame, lookup: DataFrame, namespace: str | None = None) -> DataFrame:
    """Type triples for entities whose tags are exactly those of a class; one class each."""
    from ..namespaces import BLD

    got = exact(tag_sets(triples), lookup).groupBy("id").agg(F.min("class").alias("class"))
    return got.select(F.col("id").alias("s"), F.lit(TYPE).alias("p"), F.concat(F.lit(f"<{namespace or BLD}"), F.col("class"), F.lit(">")).alias("o"))


def below(triples: DataFrame, root: str) -> DataFrame:
    """(class): the root's local name and those of its subclasses."""
    pairs = transitive(triples.where(F.col("p") == SUBCLASS).select("s", "o"))
    got = pairs.where(F.col("o") == root).select("s").union(triples.sparkSession.createDataFrame([(root,)], "s string"))
    return got.select(local_name(F.col("s")).alias("class")).distinct()


def is_point(classes: DataFrame, triples: DataFrame) -> DataFrame:
    return classes.join(below(triples, POINT), "class", "left_semi")


def is_equipment(classes: DataFrame, triples: DataFrame) -> DataFrame:
    return classes.join(below(triples, EQUIPMENT), "class", "left_semi")


def translate(sets: DataFrame, mapping: dict[str, list[str]] | None = None, id_col: str = "id") -> DataFrame:
    """Tags replaced by those they stand for (keys in lower case); unknown tags stay."""
    each = sets.select(id_col, F.explode_outer(translated("tags", mapping)).alias("tag"))
    return each.groupBy(id_col).agg(F.array_sort(F.collect_set("tag")).alias("tags"))


def translated(tags, mapping: dict[str, list[str]] | None = None):
    """The same of one column of tags: sorted, each tag once."""
    table = F.create_map(*[x for k, v in (mapping or TAG_MAP).items() for x in (F.lit(k), F.array(*map(F.lit, v)))])
    each = F.transform(tags, lambda x: F.coalesce(F.try_element_at(table, F.lower(x)), F.array(x)))
    return F.array_sort(F.array_distinct(F.filter(F.flatten(each), lambda x: x.isNotNull())))


def class_tags(triples: DataFrame) -> DataFrame:
    """Tag triples for instances of classes with tags: every type's tags become the instance's."""
    types = triples.where(F.col("p") == TYPE).select("s", F.col("o").alias("c"))
    own = triples.where(F.col("p") == HAS_ASSOCIATED_TAG).select(F.col("s").alias("c"), "o")
    return types.join(own, "c").select("s", F.lit(HAS_TAG).alias("p"), "o").distinct()


