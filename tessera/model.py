"""The relational test tables as graphs: one branch per property, so patterns read only what they name."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .functions.terms import to_literal, typed
from .namespaces import CLASS, DATA, SUBCLASS, TYPE
from .sources.tables import Fixed, Key, Mapping, Node, Text, entity, mapped, prop, triples_of


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def cls(name: str):
    return F.lit(f"<{DATA}{name}>")


def cents(c: str):
    return typed(F.round(F.col(c) * 100).cast("bigint"), "integer")


def item():
    """Items have no key of their own: order, line, part, supplier, price and date tell them apart."""
    return F.concat(F.lit(f"<{DATA}item/"), F.concat_ws("-", "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", F.round(F.col("l_extendedprice") * 100).cast("bigint"), F.date_format("l_shipdate", "yyyyMMdd")), F.lit(">"))


def part_class(*columns: str):
    return F.concat(F.lit(f"<{DATA}class/"), F.concat_ws("/", *columns), F.lit(">"))


def _kind(name: str) -> Fixed:
    return Fixed(f"<{DATA}{name}>")


def _properties() -> dict:
    """Table -> (kind of its subjects, subject, properties, whether subjects are unique)."""
    return {
        "region": ("region", Key("region", "r_regionkey"), {"a": _kind("Region"), "name": Text("r_name")}, True),
        "nation": ("nation", Key("nation", "n_nationkey"), {"a": _kind("Nation"), "name": Text("n_name"), "partOf": Key("region", "n_regionkey")}, True),
        "customer": ("customer", Key("customer", "c_custkey"), {"a": _kind("Customer"), "name": Text("c_name"), "inNation": Key("nation", "c_nationkey"), "segment": Text("c_mktsegment"), "balance": Node(cents("c_acctbal"))}, True),
        "supplier": ("supplier", Key("supplier", "s_suppkey"), {"a": _kind("Supplier"), "name": Text("s_name"), "inNation": Key("nation", "s_nationkey"), "balance": Node(cents("s_acctbal"))}, True),
        "part": ("part", Key("part", "p_partkey"), {"a": Node(part_class("p_type", "p_brand")), "name": Text("p_name"), "brand": Text("p_brand"), "size": Node(typed(F.col("p_size"), "integer"))}, True),
        "orders": ("order", Key("order", "o_orderkey"), {"a": _kind("Order"), "placedBy": Key("customer", "o_custkey"), "status": Text("o_orderstatus"), "priority": Text("o_orderpriority"), "total": Node(cents("o_totalprice")), "date": Node(typed(F.date_format("o_orderdate", "yyyy-MM-dd"), "date"))}, True),
        "lineitem": ("item", Node(item()), {"a": _kind("Item"), "ofOrder": Key("order", "l_orderkey"), "ofPart": Key("part", "l_partkey"), "suppliedBy": Key("supplier", "l_suppkey"), "quantity": Node(typed(F.col("l_quantity").cast("bigint"), "integer")), "returned": Text("l_returnflag")}, True),
        "events": ("event", Key("event", "event_id"), {"a": _kind("Event"), "by": Key("user", "user_id"), "did": Text("event_type")}, True),
        "documents": ("document", Key("document", "doc_id"), {"a": _kind("Document"), "lang": Text("lang"), "source": Text("source"), "chars": Node(typed(F.col("n_chars"), "integer"))}, False),
        "pages": ("page", Key("page", "page_id"), {"a": _kind("Page"), "url": Text("url")}, False),
    }


def triples(spark: SparkSession, sf_dir: str, *names: str, only: tuple[str, ...] | None = None) -> DataFrame:
    """Triples of the named tables; ``only``: these properties."""
    parts = []
    for n in names:
        kind, subject, props, unique = _properties()[n]
        parts.append(Mapping(table(spark, sf_dir, n), kind, subject, {prop(p): o for p, o in props.items() if only is None or p in only}, unique))
    return mapped(*parts)


def part_classes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Subclass triples: type/brand below type below Part."""
    kinds = table(spark, sf_dir, "part").select("p_type", "p_brand").distinct()
    leaf, top = part_class("p_type", "p_brand"), part_class("p_type")
    return kinds.select(leaf.alias("s"), F.lit(SUBCLASS).alias("p"), top.alias("o")).union(kinds.select(top, F.lit(SUBCLASS), cls("Part"))).union(kinds.select(leaf, F.lit(TYPE), F.lit(CLASS))).distinct()


def order_chain(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``:next`` from each order to the same customer's next one by date and key."""
    from pyspark.sql import Window

    w = Window.partitionBy("o_custkey").orderBy("o_orderdate", "o_orderkey")
    rows = table(spark, sf_dir, "orders").select("o_orderkey", F.lead("o_orderkey").over(w).alias("n")).where("n is not null")
    return rows.select(entity("order", F.col("o_orderkey")).alias("s"), F.lit(prop("next")).alias("p"), entity("order", F.col("n")).alias("o"))


def event_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as a change log: each adds (user did kind of value bucket), errors take the user's clicks away."""
    e = table(spark, sf_dir, "events")
    s, o = entity("user", F.col("user_id")), F.when(F.col("event_type") == "error", F.lit('"click"')).otherwise(to_literal(F.col("event_type")))
    stamp = F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss.SSSSSS")
    graph = F.concat(F.lit(f"<{DATA}graph/"), F.pmod(F.col("user_id"), F.lit(4)).cast("string"), F.lit(">"))
    return e.select(F.col("event_id").cast("string").alias("id"), stamp.alias("timestamp"), graph.alias("g"), (F.col("event_type") != "error").alias("is_insertion"), s.alias("s"), F.lit(prop("did")).alias("p"), o.alias("o"))
