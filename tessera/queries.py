"""Registered queries of the graph operators over the relational tables, each with independent DuckDB SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import model as m
from .functions import terms
from .graph import Graph, GraphCollection
from .namespaces import BLD, DATA, DOMAIN, EQUIPMENT, HAS_ASSOCIATED_TAG, HAS_LOCATION, HAS_POINT, HAS_TAG, IS_POINT_OF, LABEL, LOCATION, OWL, POINT, RANGE, SUBCLASS, SUBPROPERTY, TYPE, XSD, iri
from .operators import etl, haystack, merge, reason, relational, shacl, tags, vbis, versioned
from .operators.closure import components, transitive
from .plans.compile import run_query
from .sources.tables import entity, prop, rows_after_header

QUERIES: dict = {}
SQL: dict[str, str] = {}


def register(name: str, sql: str | None = None):
    def keep(f):
        QUERIES[name] = f
        if sql:
            SQL[name] = sql
        return f

    return keep


# SQL of terms


def e(kind: str, key: str) -> str:
    return f"('<{DATA}{kind}/' || {key} || '>')"


def n(x: str) -> str:
    return f"""('"' || ({x}) || '"^^<{XSD}integer>')"""


def s(x: str) -> str:
    return f"""('"' || {x} || '"')"""


def c(name: str) -> str:
    return f"'<{DATA}{name}>'"


CENTS = "round({} * 100)::BIGINT"
SUB, ITEM = f"'{SUBCLASS}'", f"('<{DATA}item/' || concat_ws('-', l_orderkey, l_linenumber, l_partkey, l_suppkey, round(l_extendedprice * 100)::BIGINT, strftime(l_shipdate, '%Y%m%d')) || '>')"


def ask(spark, triples: DataFrame, text: str, quads: DataFrame | None = None) -> DataFrame:
    return run_query(spark, text, triples, quads)


def sparql(name: str, tables: tuple[str, ...], text: str, sql: str, extra=None):
    """A query given by SPARQL text over the graph of some tables."""

    @register(name, sql)
    def run(spark, sf_dir):
        df = m.triples(spark, sf_dir, *tables)
        return ask(spark, extra(spark, sf_dir, df) if extra else df, text)

    return run


# sources and set algebra


@register("triples_from_customer", " UNION ALL ".join(f"SELECT {e('customer', 'c_custkey')} AS s, '{prop(p)}' AS p, {o} AS o FROM customer" for p, o in (("a", c("Customer")), ("name", s("c_name")), ("inNation", e("nation", "c_nationkey")), ("segment", s("c_mktsegment")), ("balance", n(CENTS.format("c_acctbal"))))))
def triples_from_customer(spark, sf_dir):
    return m.triples(spark, sf_dir, "customer")


def _halves(spark, sf_dir):
    low = m.triples(spark, sf_dir, "customer", only=("inNation", "segment"))
    return Graph(low.where(F.col("p") == prop("inNation"))), Graph(low)


_IN = f"SELECT {e('customer', 'c_custkey')} AS s, '{prop('inNation')}' AS p, {e('nation', 'c_nationkey')} AS o FROM customer"
_SEG = f"SELECT {e('customer', 'c_custkey')} AS s, '{prop('segment')}' AS p, {s('c_mktsegment')} AS o FROM customer"


@register("graph_union", f"{_IN} UNION {_SEG}")
def graph_union(spark, sf_dir):
    a, b = _halves(spark, sf_dir)
    return (a + b).df


@register("graph_difference", _SEG)
def graph_difference(spark, sf_dir):
    a, b = _halves(spark, sf_dir)
    return (b - a).df


@register("graph_intersection", _IN)
def graph_intersection(spark, sf_dir):
    a, b = _halves(spark, sf_dir)
    return (a * b).df


@register("pattern_remove", f"{_IN} UNION ALL SELECT * FROM ({_SEG}) WHERE o <> '\"BUILDING\"'")
def pattern_remove(spark, sf_dir):
    return _halves(spark, sf_dir)[1].remove(None, prop("segment"), '"BUILDING"').df


@register("graph_nodes", f"SELECT s AS node FROM ({_IN}) UNION SELECT o FROM ({_IN}) UNION SELECT o FROM ({_SEG})")
def graph_nodes(spark, sf_dir):
    return _halves(spark, sf_dir)[1].nodes()


@register("graph_accessors", f"SELECT DISTINCT s FROM ({_SEG}) WHERE o = '\"MACHINERY\"'")
def graph_accessors(spark, sf_dir):
    return _halves(spark, sf_dir)[1].subjects(prop("segment"), '"MACHINERY"')


@register("edge_export", f"SELECT s AS src, o AS dst, max(p) AS name FROM ({_IN} UNION ALL {_SEG}) GROUP BY s, o")
def edge_export(spark, sf_dir):
    return _halves(spark, sf_dir)[1].edges()


@register("skolemize", "SELECT '<urn:tessera:skolem/e' || event_id || '>' AS s, '" + prop("by") + "' AS p, '<urn:tessera:skolem/u' || user_id || '>' AS o FROM events")
def skolemize(spark, sf_dir):
    rows = m.table(spark, sf_dir, "events")
    return Graph(rows.select(F.concat(F.lit("_:e"), "event_id").alias("s"), F.lit(prop("by")).alias("p"), F.concat(F.lit("_:u"), "user_id").alias("o"))).skolemize().df


def _quads(spark, sf_dir):
    orders = m.table(spark, sf_dir, "orders")
    graph = F.concat(F.lit(f"<{DATA}graph/"), "o_orderstatus", F.lit(">"))
    return GraphCollection(orders.select(graph.alias("g"), entity("order", F.col("o_orderkey")).alias("s"), F.lit(prop("placedBy")).alias("p"), entity("customer", F.col("o_custkey")).alias("o")))


@register("graph_names", f"SELECT DISTINCT {e('graph', 'o_orderstatus')} AS g FROM orders")
def graph_names(spark, sf_dir):
    return _quads(spark, sf_dir).names()


@register("graph_contexts", f"SELECT DISTINCT {e('graph', 'o_orderstatus')} AS g FROM orders WHERE o_custkey = 7")
def graph_contexts(spark, sf_dir):
    return _quads(spark, sf_dir).contexts(None, None, f"<{DATA}customer/7>")


@register("graph_removed", f"SELECT {e('graph', 'o_orderstatus')} AS g, {e('order', 'o_orderkey')} AS s, '{prop('placedBy')}' AS p, {e('customer', 'o_custkey')} AS o FROM orders WHERE o_orderstatus <> 'F'")
def graph_removed(spark, sf_dir):
    return _quads(spark, sf_dir).remove_graph(f"<{DATA}graph/F>").df


@register("named_graph_count", f"SELECT {e('graph', 'o_orderstatus')} AS g, {n('count(*)')} AS n FROM orders GROUP BY o_orderstatus")
def named_graph_count(spark, sf_dir):
    return _quads(spark, sf_dir).query("SELECT ?g (COUNT(?o) AS ?n) WHERE { GRAPH ?g { ?o :placedBy ?c } } GROUP BY ?g")


@register("default_union", f"SELECT {e('customer', 'o_custkey')} AS c, {n('count(*)')} AS n FROM orders GROUP BY o_custkey")
def default_union(spark, sf_dir):
    return _quads(spark, sf_dir).query("SELECT ?c (COUNT(?o) AS ?n) WHERE { ?o :placedBy ?c } GROUP BY ?c")


# basic patterns, filters and joins

_GEO = "JOIN nation ON c_nationkey = n_nationkey"
O_, C_ = e("order", "o_orderkey"), e("customer", "c_custkey")

sparql("bgp_chain", ("orders", "customer", "nation"), f"SELECT ?o ?c WHERE {{ ?o :placedBy ?c . ?c :inNation ?n . ?n :partOf <{DATA}region/1> }}", f"SELECT {O_} AS o, {C_} AS c FROM orders JOIN customer ON o_custkey = c_custkey {_GEO} WHERE n_regionkey = 1")
sparql("bgp_star", ("orders",), 'SELECT ?o ?p WHERE { ?o a :Order ; :status "F" ; :priority ?p }', f"SELECT {O_} AS o, {s('o_orderpriority')} AS p FROM orders WHERE o_orderstatus = 'F'")
sparql("bgp_all_vars", ("region",), "SELECT * WHERE { ?s ?p ?o }", f"SELECT {e('region', 'r_regionkey')} AS s, '{TYPE}' AS p, {c('Region')} AS o FROM region UNION ALL SELECT {e('region', 'r_regionkey')}, '{prop('name')}', {s('r_name')} FROM region")
sparql("bgp_items", ("lineitem", "part", "supplier"), 'SELECT ?i ?p ?s WHERE { ?i :ofPart ?p ; :suppliedBy ?s ; :returned "R" . ?p :brand "Brand#3" }', f"SELECT {ITEM} AS i, {e('part', 'l_partkey')} AS p, {e('supplier', 'l_suppkey')} AS s FROM lineitem JOIN part ON l_partkey = p_partkey WHERE l_returnflag = 'R' AND p_brand = 'Brand#3'")
sparql("same_variable_twice", ("nation", "region"), "SELECT ?x ?y WHERE { ?x :name ?y . ?z :name ?y FILTER(?x = ?z) }", f"SELECT {e('nation', 'n_nationkey')} AS x, {s('n_name')} AS y FROM nation UNION ALL SELECT {e('region', 'r_regionkey')}, {s('r_name')} FROM region")
sparql("filter_strstarts", ("customer",), f'SELECT ?c WHERE {{ ?c a :Customer FILTER(STRSTARTS(STR(?c), "{DATA}customer/1")) }}', f"SELECT {C_} AS c FROM customer WHERE c_custkey::VARCHAR LIKE '1%'")
sparql("filter_compare", ("orders",), "SELECT ?o ?t WHERE { ?o :total ?t FILTER(?t > 20000000 || ?t <= 500000) }", f"SELECT {O_} AS o, {n(CENTS.format('o_totalprice'))} AS t FROM orders WHERE round(o_totalprice * 100) > 20000000 OR round(o_totalprice * 100) <= 500000")
sparql("filter_regex", ("part",), 'SELECT ?p ?n WHERE { ?p :name ?n FILTER(REGEX(?n, "^[A-M].*E$", "i") && !CONTAINS(?n, "x")) }', f"SELECT {e('part', 'p_partkey')} AS p, {s('p_name')} AS n FROM part WHERE regexp_matches(p_name, '^[A-M].*E$', 'i') AND NOT contains(p_name, 'x')")
sparql("filter_in", ("customer",), 'SELECT ?c WHERE { ?c :segment ?s FILTER(?s IN ("BUILDING", "MACHINERY") && ?s NOT IN ("MACHINERY")) }', f"SELECT {C_} AS c FROM customer WHERE c_mktsegment = 'BUILDING'")
sparql("filter_not_bound", ("customer", "orders"), "SELECT ?c WHERE { ?c a :Customer OPTIONAL { ?o :placedBy ?c ; :status \"P\" } FILTER(!BOUND(?o)) }", f"SELECT {C_} AS c FROM customer WHERE c_custkey NOT IN (SELECT o_custkey FROM orders WHERE o_orderstatus = 'P')")
_SHORT = s("regexp_replace(n_name, '^NATION_([0-9]+)$', 'N\\1')")
sparql("bind_replace", ("nation",), 'SELECT ?n ?short WHERE { ?n :name ?x BIND(REPLACE(STR(?x), "^NATION_([0-9]+)$", "N$1") AS ?short) }', f"SELECT {e('nation', 'n_nationkey')} AS n, {_SHORT} AS short FROM nation")
sparql("bind_arithmetic", ("orders",), "SELECT ?o ?k WHERE { ?o :total ?t BIND(?t * 2 + 1 AS ?k) FILTER(?k > 30000000) }", f"SELECT {O_} AS o, {n(CENTS.format('o_totalprice') + ' * 2 + 1')} AS k FROM orders WHERE round(o_totalprice * 100) * 2 + 1 > 30000000")
_AFTER = s("CASE WHEN contains(s_name, '_') THEN substr(s_name, strpos(s_name, '_') + 1) ELSE '' END")
_HASH = s("md5(substr(s_name, 1, 3) || '-' || s_name)")
sparql("string_functions", ("supplier",), 'SELECT ?x ?u ?l ?a ?h WHERE { ?x a :Supplier ; :name ?y BIND(LCASE(?y) AS ?u) BIND(STRLEN(?y) AS ?l) BIND(STRAFTER(?y, "_") AS ?a) BIND(MD5(CONCAT(SUBSTR(?y, 1, 3), "-", ?y)) AS ?h) }', f"SELECT {e('supplier', 's_suppkey')} AS x, {s('lower(s_name)')} AS u, {n('length(s_name)')} AS l, {_AFTER} AS a, {_HASH} AS h FROM supplier")
sparql("date_functions", ("orders",), "SELECT ?y ?q (COUNT(*) AS ?n) WHERE { ?o :date ?d BIND(YEAR(?d) AS ?y) BIND(CEIL(MONTH(?d) / 3) AS ?q0) BIND(IF(?q0 > 2, \"H2\", \"H1\") AS ?q) } GROUP BY ?y ?q", f"SELECT {n('year(o_orderdate)')} AS y, CASE WHEN month(o_orderdate) > 6 THEN '\"H2\"' ELSE '\"H1\"' END AS q, {n('count(*)')} AS n FROM orders GROUP BY year(o_orderdate), month(o_orderdate) > 6")
sparql("optional_left", ("nation", "supplier"), "SELECT ?n ?s WHERE { ?n a :Nation OPTIONAL { ?s :inNation ?n ; :balance ?b FILTER(?b > 500000) } }", f"SELECT {e('nation', 'n_nationkey')} AS n, {e('supplier', 's_suppkey')} AS s FROM nation LEFT JOIN supplier ON s_nationkey = n_nationkey AND round(s_acctbal * 100) > 500000")
sparql("optional_then_join", ("customer", "supplier"), "SELECT ?c ?s WHERE { ?c :segment \"BUILDING\" ; :inNation ?n OPTIONAL { ?s a :Supplier ; :balance ?b ; :inNation ?n FILTER(?b < 0) } }", f"SELECT {C_} AS c, {e('supplier', 's_suppkey')} AS s FROM customer LEFT JOIN supplier ON s_nationkey = c_nationkey AND round(s_acctbal * 100) < 0 WHERE c_mktsegment = 'BUILDING'")
sparql("not_exists", ("customer", "orders"), "SELECT ?c WHERE { ?c a :Customer FILTER NOT EXISTS { ?o :placedBy ?c } }", f"SELECT {C_} AS c FROM customer WHERE NOT EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey)")
sparql("not_exists_correlated", ("orders",), "SELECT ?o WHERE { ?o :placedBy ?c ; :total ?t FILTER NOT EXISTS { ?o2 :placedBy ?c ; :total ?t2 FILTER(?t2 > ?t) } }", f"SELECT {O_} AS o FROM orders o WHERE NOT EXISTS (SELECT 1 FROM orders p WHERE p.o_custkey = o.o_custkey AND round(p.o_totalprice * 100) > round(o.o_totalprice * 100))")
sparql("exists_semi", ("customer", "orders"), 'SELECT ?c WHERE { ?c a :Customer FILTER EXISTS { ?o :placedBy ?c ; :priority "1-URGENT" } }', f"SELECT {C_} AS c FROM customer WHERE c_custkey IN (SELECT o_custkey FROM orders WHERE o_orderpriority = '1-URGENT')")
sparql("exists_in_or", ("customer", "orders"), 'SELECT ?c WHERE { ?c :segment ?s FILTER(?s = "BUILDING" || EXISTS { ?o :placedBy ?c ; :status "P" }) }', f"SELECT {C_} AS c FROM customer WHERE c_mktsegment = 'BUILDING' OR c_custkey IN (SELECT o_custkey FROM orders WHERE o_orderstatus = 'P')")
sparql("minus", ("customer", "orders"), 'SELECT ?c WHERE { ?c a :Customer MINUS { ?o :placedBy ?c ; :status "O" } }', f"SELECT {C_} AS c FROM customer WHERE c_custkey NOT IN (SELECT o_custkey FROM orders WHERE o_orderstatus = 'O')")
sparql("union_bag", ("customer", "supplier"), "SELECT ?n WHERE { { ?x a :Customer ; :inNation ?n } UNION { ?y a :Supplier ; :inNation ?n } }", f"SELECT {e('nation', 'c_nationkey')} AS n FROM customer UNION ALL SELECT {e('nation', 's_nationkey')} FROM supplier")
sparql("union_unbound_join", ("customer", "supplier", "nation"), "SELECT ?c ?s ?r WHERE { { ?c :segment \"BUILDING\" ; :inNation ?n } UNION { ?s a :Supplier ; :inNation ?n } ?n :partOf ?r }", f"SELECT {C_} AS c, NULL AS s, {e('region', 'n_regionkey')} AS r FROM customer {_GEO} WHERE c_mktsegment = 'BUILDING' UNION ALL SELECT NULL, {e('supplier', 's_suppkey')}, {e('region', 'n_regionkey')} FROM supplier JOIN nation ON s_nationkey = n_nationkey")
sparql("values_join", ("customer",), f'SELECT ?c ?k WHERE {{ ?c :segment ?s VALUES (?s ?k) {{ ("BUILDING" 1) ("MACHINERY" 2) (UNDEF 3) }} }}', f"""SELECT {C_} AS c, {n('k')} AS k FROM customer JOIN (VALUES ('BUILDING', 1), ('MACHINERY', 2), (NULL, 3)) v(g, k) ON g IS NULL OR g = c_mktsegment""")
sparql("theta_join", ("nation",), "SELECT ?a ?b WHERE { ?a :partOf ?r . ?b :partOf ?r FILTER(?a != ?b) }", f"SELECT {e('nation', 'a.n_nationkey')} AS a, {e('nation', 'b.n_nationkey')} AS b FROM nation a JOIN nation b ON a.n_regionkey = b.n_regionkey AND a.n_nationkey <> b.n_nationkey")
sparql("cross_product", ("region", "nation"), "SELECT ?r ?n WHERE { ?r a :Region . ?n a :Nation }", f"SELECT {e('region', 'r_regionkey')} AS r, {e('nation', 'n_nationkey')} AS n FROM region, nation")
sparql("ask_pattern", ("orders",), 'ASK { ?o :status "P" ; :priority "5-LOW" }', "SELECT count(*) > 0 AS answer FROM orders WHERE o_orderstatus = 'P' AND o_orderpriority = '5-LOW'")
sparql("describe", ("nation", "customer"), f"DESCRIBE ?n WHERE {{ ?n :partOf <{DATA}region/2> }}", f"SELECT {e('nation', 'n_nationkey')} AS s, '{TYPE}' AS p, {c('Nation')} AS o FROM nation WHERE n_regionkey = 2 UNION ALL SELECT {e('nation', 'n_nationkey')}, '{prop('name')}', {s('n_name')} FROM nation WHERE n_regionkey = 2 UNION ALL SELECT {e('nation', 'n_nationkey')}, '{prop('partOf')}', {e('region', 'n_regionkey')} FROM nation WHERE n_regionkey = 2")

# aggregation and order

sparql("select_distinct", ("customer",), "SELECT DISTINCT ?s ?n WHERE { ?c :segment ?s ; :inNation ?n }", f"SELECT DISTINCT {s('c_mktsegment')} AS s, {e('nation', 'c_nationkey')} AS n FROM customer")
sparql("group_count", ("orders",), "SELECT ?c (COUNT(?o) AS ?n) WHERE { ?o :placedBy ?c } GROUP BY ?c", f"SELECT {e('customer', 'o_custkey')} AS c, {n('count(*)')} AS n FROM orders GROUP BY o_custkey")
sparql("count_distinct", ("lineitem",), "SELECT ?s (COUNT(DISTINCT ?p) AS ?n) WHERE { ?i :suppliedBy ?s ; :ofPart ?p } GROUP BY ?s", f"SELECT {e('supplier', 'l_suppkey')} AS s, {n('count(DISTINCT l_partkey)')} AS n FROM lineitem GROUP BY l_suppkey")
sparql("sum_min_max", ("lineitem",), "SELECT ?r (SUM(?q) AS ?t) (MIN(?q) AS ?lo) (MAX(?q) AS ?hi) (COUNT(*) AS ?n) WHERE { ?i :returned ?r ; :quantity ?q } GROUP BY ?r", f"SELECT {s('l_returnflag')} AS r, {n('sum(l_quantity)::BIGINT')} AS t, {n('min(l_quantity)::BIGINT')} AS lo, {n('max(l_quantity)::BIGINT')} AS hi, {n('count(*)')} AS n FROM lineitem GROUP BY l_returnflag")
sparql("average", ("lineitem",), "SELECT ?r (FLOOR(AVG(?q) * 1000) AS ?a0) WHERE { ?i :returned ?r ; :quantity ?q } GROUP BY ?r", f"""SELECT {s('l_returnflag')} AS r, '"' || floor(avg(l_quantity::BIGINT) * 1000)::BIGINT || '.0"^^<{XSD}decimal>' AS a0 FROM lineitem GROUP BY l_returnflag""")
_NAMES = s("string_agg(n_name, ' ' ORDER BY n_name)")
sparql("group_concat", ("nation",), 'SELECT ?r (GROUP_CONCAT(?x; SEPARATOR=" ") AS ?names) WHERE { ?n :partOf ?r ; :name ?x } GROUP BY ?r', f"SELECT {e('region', 'n_regionkey')} AS r, {_NAMES} AS names FROM nation GROUP BY n_regionkey")
sparql("having", ("orders",), "SELECT ?c (SUM(?t) AS ?sum) WHERE { ?o :placedBy ?c ; :total ?t } GROUP BY ?c HAVING(COUNT(?o) > 12)", f"SELECT {e('customer', 'o_custkey')} AS c, {n('sum(' + CENTS.format('o_totalprice') + ')::BIGINT')} AS sum FROM orders GROUP BY o_custkey HAVING count(*) > 12")
sparql("subselect_filter", ("orders", "customer"), "SELECT ?c ?g WHERE { ?c :segment ?g { SELECT ?c (COUNT(DISTINCT ?s) AS ?k) WHERE { ?o :placedBy ?c ; :status ?s } GROUP BY ?c } FILTER(?k = 1) }", f"SELECT {C_} AS c, {s('c_mktsegment')} AS g FROM customer WHERE c_custkey IN (SELECT o_custkey FROM orders GROUP BY o_custkey HAVING count(DISTINCT o_orderstatus) = 1)")
sparql("two_aggregates", ("customer", "supplier"), "SELECT ?n ?a ?b WHERE { { SELECT ?n (COUNT(?c) AS ?a) WHERE { ?c a :Customer ; :inNation ?n } GROUP BY ?n } { SELECT ?n (COUNT(?s) AS ?b) WHERE { ?s a :Supplier ; :inNation ?n } GROUP BY ?n } }", f"SELECT {e('nation', 'k')} AS n, {n('a')} AS a, {n('b')} AS b FROM (SELECT c_nationkey AS k, count(*) AS a FROM customer GROUP BY 1) JOIN (SELECT s_nationkey AS k, count(*) AS b FROM supplier GROUP BY 1) USING (k)")
sparql("order_limit", ("orders",), "SELECT ?o ?t WHERE { ?o :total ?t } ORDER BY DESC(?t) ?o LIMIT 25", f"SELECT {O_} AS o, {n(CENTS.format('o_totalprice'))} AS t FROM orders ORDER BY round(o_totalprice * 100) DESC, {O_} LIMIT 25")
sparql("order_offset", ("customer",), "SELECT ?x WHERE { ?c :name ?x } ORDER BY ?x OFFSET 100 LIMIT 50", f"SELECT {s('c_name')} AS x FROM customer ORDER BY c_name LIMIT 50 OFFSET 100")

# exact numbers and points in time


def _literals(spark, sf_dir, kind: str) -> DataFrame:
    """(order, :is, literal) with numbers beyond double precision, decimals or zoned dateTimes made of each order."""
    o = m.table(spark, sf_dir, "orders")
    value = {
        "big": terms.typed(F.lit(9007199254740992) + F.col("o_orderkey"), "integer"),
        "tenths": terms.typed(F.concat(F.lit("0."), (F.col("o_orderkey") % 9 + 1).cast("string")), "decimal"),
        "zoned": terms.typed(F.concat(F.date_format(F.date_add("o_orderdate", F.when(F.col("o_orderkey") % 2 == 1, 1).otherwise(0)), "yyyy-MM-dd"), F.when(F.col("o_orderkey") % 2 == 1, "T01:30:00+02:00").otherwise("T23:00:00Z")), "dateTime"),
    }[kind]
    return o.select(entity("order", F.col("o_orderkey")).alias("s"), F.lit(prop("is")).alias("p"), value.alias("o")).union(o.select(entity("order", F.col("o_orderkey")), F.lit(prop("status")), terms.to_literal(F.col("o_orderstatus"))))


def _of_literals(name: str, kind: str, text: str, sql: str):
    @register(name, sql)
    def run(spark, sf_dir):
        return ask(spark, _literals(spark, sf_dir, kind), text)


_of_literals("big_integers", "big", "SELECT ?o ?x WHERE { ?o :is ?n FILTER(?n > 9007199254740993 && ?n != 9007199254740997) BIND(?n * 3 - 1 AS ?x) }", f"SELECT {O_} AS o, {n('(9007199254740992::HUGEINT + o_orderkey) * 3 - 1')} AS x FROM orders WHERE o_orderkey > 1 AND o_orderkey <> 5")
_of_literals("big_integer_sum", "big", "SELECT ?s (SUM(?n) AS ?t) (MAX(?n) AS ?hi) WHERE { ?o :is ?n ; :status ?s } GROUP BY ?s", f"SELECT {s('o_orderstatus')} AS s, {n('sum(9007199254740992::HUGEINT + o_orderkey)')} AS t, {n('max(9007199254740992::HUGEINT + o_orderkey)')} AS hi FROM orders GROUP BY o_orderstatus")
_of_literals("decimal_sum", "tenths", "SELECT ?s (SUM(?n) AS ?t) WHERE { ?o :is ?n ; :status ?s } GROUP BY ?s", f"""SELECT {s('o_orderstatus')} AS s, '"' || (sum(o_orderkey % 9 + 1) // 10)::BIGINT || '.' || (sum(o_orderkey % 9 + 1) % 10)::BIGINT || '"^^<{XSD}decimal>' AS t FROM orders GROUP BY o_orderstatus""")
_DAY = "CASE WHEN o_orderkey % 2 = 1 THEN o_orderdate + INTERVAL 1 DAY ELSE o_orderdate END"
_ZONED = f"""('"' || strftime({_DAY}, '%Y-%m-%d') || CASE WHEN o_orderkey % 2 = 1 THEN 'T01:30:00+02:00' ELSE 'T23:00:00Z' END || '"^^<{XSD}dateTime>')"""
_of_literals("zoned_datetimes", "zoned", f'SELECT ?o ?z ?t WHERE {{ ?o :is ?n FILTER(?n > "1995-06-15T23:15:00Z"^^<{XSD}dateTime> && ?n <= "1996-06-15T23:15:00Z"^^<{XSD}dateTime>) BIND(TZ(?n) AS ?z) BIND(TIMEZONE(?n) AS ?t) }}', f"""SELECT {O_} AS o, CASE WHEN o_orderkey % 2 = 1 THEN '"+02:00"' ELSE '"Z"' END AS z, CASE WHEN o_orderkey % 2 = 1 THEN '"PT2H"' ELSE '"PT0S"' END || '^^<{XSD}dayTimeDuration>' AS t FROM orders, (SELECT o_orderkey AS k, o_orderdate::TIMESTAMP + CASE WHEN o_orderkey % 2 = 1 THEN INTERVAL '23 hours 30 minutes' ELSE INTERVAL '23 hours' END AS moment FROM orders) WHERE k = o_orderkey AND moment > TIMESTAMP '1995-06-15 23:15:00' AND moment <= TIMESTAMP '1996-06-15 23:15:00'""")
_of_literals("zoned_order", "zoned", "SELECT ?o ?n WHERE { ?o :is ?n } ORDER BY DESC(?n) ?o LIMIT 40", f"SELECT {O_} AS o, {_ZONED} AS n FROM orders ORDER BY o_orderdate + CASE WHEN o_orderkey % 2 = 1 THEN INTERVAL '23 hours 30 minutes' ELSE INTERVAL '23 hours' END DESC, {O_} LIMIT 40")

# paths

sparql("path_sequence", ("orders", "customer", "nation"), "SELECT ?o ?r WHERE { ?o :placedBy/:inNation/:partOf ?r }", f"SELECT {O_} AS o, {e('region', 'n_regionkey')} AS r FROM orders JOIN customer ON o_custkey = c_custkey {_GEO}")
sparql("path_alternative", ("customer", "nation"), "SELECT ?x ?y WHERE { ?x (:inNation|:partOf) ?y }", f"SELECT {C_} AS x, {e('nation', 'c_nationkey')} AS y FROM customer UNION ALL SELECT {e('nation', 'n_nationkey')}, {e('region', 'n_regionkey')} FROM nation")
sparql("path_inverse", ("customer", "orders"), f"SELECT ?o WHERE {{ <{DATA}nation/3> ^:inNation/^:placedBy ?o }}", f"SELECT {O_} AS o FROM orders JOIN customer ON o_custkey = c_custkey WHERE c_nationkey = 3")
_CHAIN = "WITH RECURSIVE nx AS (SELECT o_orderkey AS a, lead(o_orderkey) OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey) AS b FROM orders), r(a, b) AS (SELECT a, b FROM nx WHERE b IS NOT NULL UNION SELECT r.a, nx.b FROM r JOIN nx ON r.b = nx.a WHERE nx.b IS NOT NULL)"


@register("path_plus", f"{_CHAIN} SELECT {e('order', 'a')} AS x, {e('order', 'b')} AS y FROM r")
def path_plus(spark, sf_dir):
    return ask(spark, m.order_chain(spark, sf_dir), "SELECT ?x ?y WHERE { ?x :next+ ?y }")


@register("path_star", f"{_CHAIN} SELECT {e('order', 'a')} AS x, {e('order', 'b')} AS y FROM r UNION SELECT {e('order', 'a')}, {e('order', 'a')} FROM r UNION SELECT {e('order', 'b')}, {e('order', 'b')} FROM r")
def path_star(spark, sf_dir):
    return ask(spark, m.order_chain(spark, sf_dir), "SELECT ?x ?y WHERE { ?x :next* ?y }")


@register("path_from_constant", f"{_CHAIN} SELECT {e('order', 'b')} AS y FROM r WHERE a = (SELECT min(a) FROM nx WHERE b IS NOT NULL) UNION SELECT {e('order', '(SELECT min(a) FROM nx WHERE b IS NOT NULL)')}")
def path_from_constant(spark, sf_dir):
    chain = m.order_chain(spark, sf_dir)
    first = chain.agg(F.min(terms.local_name(F.col("s")).cast("bigint"))).first()[0]
    return ask(spark, chain, f"SELECT ?y WHERE {{ <{DATA}order/{first}> :next* ?y }}")


sparql("path_optional", ("customer", "nation"), "SELECT DISTINCT ?x ?y WHERE { ?x a :Nation ; :partOf? ?y }", f"SELECT {e('nation', 'n_nationkey')} AS x, {e('region', 'n_regionkey')} AS y FROM nation UNION SELECT {e('nation', 'n_nationkey')}, {e('nation', 'n_nationkey')} FROM nation")
sparql("path_negated", ("nation",), "SELECT ?x ?y WHERE { ?x !(a|:name) ?y }", f"SELECT {e('nation', 'n_nationkey')} AS x, {e('region', 'n_regionkey')} AS y FROM nation")
sparql("path_mixed_closure", ("customer", "nation", "region"), "SELECT ?x ?y WHERE { ?x a :Customer ; (:inNation|:partOf)+ ?y }", f"SELECT {C_} AS x, {e('nation', 'c_nationkey')} AS y FROM customer UNION SELECT {C_}, {e('region', 'n_regionkey')} FROM customer {_GEO}")
_SAME = "WITH RECURSIVE e(a, b) AS (SELECT 's' || s_suppkey, 'n' || s_nationkey FROM supplier UNION SELECT 'n' || s_nationkey, 's' || s_suppkey FROM supplier), r(a, b) AS (SELECT a, b FROM e UNION SELECT r.a, e.b FROM r JOIN e ON r.b = e.a)"


@register("closure_cyclic", f"{_SAME} SELECT a AS s, b AS o FROM r")
def closure_cyclic(spark, sf_dir):
    rows = m.table(spark, sf_dir, "supplier")
    x, y = F.concat(F.lit("s"), "s_suppkey"), F.concat(F.lit("n"), "s_nationkey")
    return transitive(rows.select(x.alias("s"), y.alias("o")).union(rows.select(y, x)), driver_edges=0)


@register("components", "SELECT e AS node, min(e) OVER (PARTITION BY k) AS root FROM (SELECT 'c' || o_custkey AS e, o_custkey AS k FROM orders UNION SELECT 'o' || o_orderkey, o_custkey FROM orders)")
def connected(spark, sf_dir):
    rows = m.table(spark, sf_dir, "orders")
    return components(rows.select(F.concat(F.lit("c"), "o_custkey").alias("s"), F.concat(F.lit("o"), "o_orderkey").alias("o")))


@register("list_traversal", f"SELECT {e('order', 'o_orderkey')} AS o, {n('l_linenumber')} AS v FROM orders JOIN lineitem ON l_orderkey = o_orderkey")
def list_traversal(spark, sf_dir):
    return _lists(spark, sf_dir, m.table(spark, sf_dir, "orders"))


def _lists(spark, sf_dir, orders: DataFrame) -> DataFrame:
    """Line numbers of each order's list, read along its cells."""
    rows = orders.join(m.table(spark, sf_dir, "lineitem"), F.col("l_orderkey") == F.col("o_orderkey"))
    lists = rows.groupBy("o_orderkey").agg(F.array_sort(F.collect_list("l_linenumber")).alias("xs"))
    cell = lambda k: F.concat(F.lit("_:l"), "o_orderkey", F.lit("_"), k)
    from .namespaces import FIRST, NIL, REST

    cells = lists.select("o_orderkey", F.size("xs").alias("n"), F.posexplode("xs").alias("k", "x"))
    rest = F.when(F.col("k") + 1 < F.col("n"), cell(F.col("k") + 1)).otherwise(F.lit(NIL))
    df = lists.select(entity("order", F.col("o_orderkey")).alias("s"), F.lit(prop("lines")).alias("p"), cell(F.lit(0)).alias("o"))
    df = df.union(cells.select(cell(F.col("k")), F.lit(FIRST), terms.typed(F.col("x"), "integer"))).union(cells.select(cell(F.col("k")), F.lit(REST), rest))
    return ask(spark, df, "SELECT ?o ?v WHERE { ?o :lines/rdf:rest*/rdf:first ?v }")


# updates and construction


def _updated(name: str, tables: tuple[str, ...], text: str, sql: str, only=None):
    @register(name, sql)
    def run(spark, sf_dir):
        return Graph(m.triples(spark, sf_dir, *tables, only=only)).update(text).df


_NAT = f"SELECT {e('nation', 'n_nationkey')} AS s, '{prop('partOf')}' AS p, {e('region', 'n_regionkey')} AS o FROM nation"
_updated("insert_where", ("nation",), "INSERT { ?r :contains ?n } WHERE { ?n :partOf ?r }", f"{_NAT} UNION ALL SELECT {e('region', 'n_regionkey')}, '{prop('contains')}', {e('nation', 'n_nationkey')} FROM nation", ("partOf",))
_updated("delete_where", ("customer",), 'DELETE { ?c ?p ?o } WHERE { ?c :segment "BUILDING" ; ?p ?o }', f"SELECT * FROM ({_IN} UNION ALL {_SEG}) WHERE s NOT IN (SELECT s FROM ({_SEG}) WHERE o = '\"BUILDING\"')", ("inNation", "segment"))
_updated("delete_insert", ("customer",), "DELETE { ?c :inNation ?n } INSERT { ?n :hasCustomer ?c } WHERE { ?c :inNation ?n }", f"SELECT {e('nation', 'c_nationkey')} AS s, '{prop('hasCustomer')}' AS p, {C_} AS o FROM customer", ("inNation",))
_updated("update_sequence", ("nation",), "INSERT { ?r :size1 ?n } WHERE { ?n :partOf ?r } ; DELETE WHERE { ?n :partOf ?r } ; INSERT DATA { :a :b 5 } ; DELETE DATA { :a :b 5 }", f"SELECT {e('region', 'n_regionkey')} AS s, '{prop('size1')}' AS p, {e('nation', 'n_nationkey')} AS o FROM nation", ("partOf",))
sparql("construct", ("orders", "customer"), "CONSTRUCT { ?n :received ?o . ?o :boughtIn ?n } WHERE { ?o :placedBy/:inNation ?n }", f"SELECT DISTINCT {e('nation', 'c_nationkey')} AS s, '{prop('received')}' AS p, {O_} AS o FROM orders JOIN customer ON o_custkey = c_custkey UNION ALL SELECT DISTINCT {O_}, '{prop('boughtIn')}', {e('nation', 'c_nationkey')} FROM orders JOIN customer ON o_custkey = c_custkey")

# table conversion

_B = BLD


def _conversion(name: str, table: str, config: dict, sql: str):
    @register(name, sql)
    def run(spark, sf_dir):
        return etl.convert_table(m.table(spark, sf_dir, table), config)


_conversion("convert_data", "supplier", {"namespace_prefixes": {"b": _B}, "operations": [{"data": "bldg:{s_name} a b:Supplier ; b:inNation bldg:N{s_nationkey} ."}]}, f"SELECT '<urn:tessera:site/' || s_name || '>' AS s, '{TYPE}' AS p, '<{_B}Supplier>' AS o FROM supplier UNION SELECT '<urn:tessera:site/' || s_name || '>', '<{_B}inNation>', '<urn:tessera:site/N' || s_nationkey || '>' FROM supplier")
_conversion("convert_conditions", "part", {"namespace_prefixes": {"b": _B}, "operations": [{"conditions": ["{p_size} > 25", "'{p_type}'.lower()[:3] in ('eco', 'pro')", "'1' not in '{p_brand}' or {p_size} == 30"], "data": "bldg:P{p_partkey} a b:Wanted ."}]}, f"SELECT '<urn:tessera:site/P' || p_partkey || '>' AS s, '{TYPE}' AS p, '<{_B}Wanted>' AS o FROM part WHERE p_size > 25 AND lower(p_type)[1:3] IN ('eco', 'pro') AND (NOT contains(p_brand, '1') OR p_size = 30)")
_conversion("convert_loop", "customer", {"namespace_prefixes": {"b": _B}, "macros": ["{% macro many(who, num, type) %}{% for i in range(num) %} bldg:C{{ who }}_{{ i }} a {{ type }} . {% endfor %}{% endmacro %}"], "operations": [{"template": "{{ many(value['c_custkey'], value['c_nationkey'], \"b:Copy\") }}"}]}, f"SELECT '<urn:tessera:site/C' || c_custkey || '_' || i || '>' AS s, '{TYPE}' AS p, '<{_B}Copy>' AS o FROM (SELECT c_custkey, unnest(range(c_nationkey)) AS i FROM customer)")
_conversion("convert_query", "nation", {"operations": [{"data": ":N{n_nationkey} :of :R{n_regionkey} ."}, {"query": "INSERT {{ ?r :has :X{n_nationkey} }} WHERE {{ :N{n_nationkey} :of ?r }}"}]}, f"SELECT '<{DATA}N' || n_nationkey || '>' AS s, '{prop('of')}' AS p, '<{DATA}R' || n_regionkey || '>' AS o FROM nation UNION SELECT '<{DATA}R' || n_regionkey || '>', '{prop('has')}', '<{DATA}X' || n_nationkey || '>' FROM nation")


@register("clean_values", "SELECT event_id, CASE event_type WHEN 'click' THEN 'True' WHEN 'view' THEN 'False' ELSE replace(event_type, 'r', '_') END AS word, (value::BIGINT)::VARCHAR AS number FROM events")
def clean_values(spark, sf_dir):
    ev = m.table(spark, sf_dir, "events")
    word = F.when(F.col("event_type") == "click", "on").when(F.col("event_type") == "view", "FALSE").otherwise(F.concat(F.lit("  "), "event_type"))
    number = F.concat(F.rint("value").cast("bigint").cast("string"), F.lit(".0"))
    return ev.select("event_id", etl.clean(word, {"r": "_"}).alias("word"), etl.clean(number).alias("number"))


@register("header_search", "SELECT n_name AS name, split_part(n_name, '_', 1) AS part, n_regionkey::VARCHAR AS region FROM nation")
def header_search(spark, sf_dir):
    rows = m.table(spark, sf_dir, "nation").select((F.col("n_nationkey") + 3).cast("bigint").alias("line"), F.col("n_name").alias("c0"), F.concat(F.split("n_name", "_")[0], F.lit("/"), F.col("n_regionkey").cast("string")).alias("c1"))
    head = spark.createDataFrame([(0, "Title", None), (1, "", ""), (2, "name", "part/region")], "line bigint, c0 string, c1 string")
    return rows_after_header(head.union(rows), "name")


@register("device_rows", None)
def device_rows(spark, sf_dir):
    ev = m.table(spark, sf_dir, "events")
    rows = ev.select(F.concat(F.lit("dev "), "user_id").alias("device"), F.col("user_id").alias("device_id"), F.concat_ws("-", "event_type", "event_id").alias("point"), F.lit("analogInput").alias("object_type"), F.col("event_id").alias("object_id"), F.lit("degC").alias("units"))
    return etl.device_triples(rows, "urn:tessera:site/")


SQL["device_rows"] = (
    "WITH d AS (SELECT *, '<urn:tessera:site/dev_' || user_id || '>' AS dev, '<urn:tessera:site/dev_' || user_id || '_' || event_type || '_' || event_id || '>' AS pt FROM events) "
    + " UNION ".join(
        f"SELECT {a} AS s, '{p}' AS p, {o} AS o FROM d"
        for a, p, o in (
            ("dev", TYPE, f"'<{BLD}NetworkDevice>'"),
            ("dev", LABEL, "'\"dev ' || user_id || '\"'"),
            ("dev", iri(BLD + "deviceInstance"), n("user_id")),
            ("pt", iri(BLD + "objectOf"), "dev"),
            ("pt", LABEL, "'\"' || event_type || '-' || event_id || '\"'"),
            ("pt", iri(BLD + "objectType"), "'\"analogInput\"'"),
            ("pt", iri(BLD + "objectIdentifier"), n("event_id")),
            ("pt", iri(BLD + "hasUnit"), "'\"degC\"'"),
        )
    )
)

LEAF, TOP = f"('<{DATA}class/' || p_type || '/' || p_brand || '>')", f"('<{DATA}class/' || p_type || '>')"


@register("minify", f"SELECT {e('part', 'p_partkey')} AS s, '{TYPE}' AS p, {LEAF} AS o FROM part")
def minify(spark, sf_dir):
    own = m.triples(spark, sf_dir, "part", only=("a",))
    part = m.table(spark, sf_dir, "part")
    more = part.select(entity("part", F.col("p_partkey")).alias("s"), F.lit(TYPE).alias("p"), m.part_class("p_type").alias("o"))
    return etl.minify(own.union(more), m.part_classes(spark, sf_dir))


# inference


def _types_only(df: DataFrame, prefix: str) -> DataFrame:
    return df.where((F.col("p") == TYPE) & F.startswith("s", F.lit(f"<{DATA}{prefix}/"))).select("s", "o")


@register("rdfs_types", f"SELECT {e('part', 'p_partkey')} AS s, {LEAF} AS o FROM part UNION SELECT {e('part', 'p_partkey')}, {TOP} FROM part UNION SELECT {e('part', 'p_partkey')}, {c('Part')} FROM part UNION SELECT {e('part', 'p_partkey')}, '<http://www.w3.org/2000/01/rdf-schema#Resource>' FROM part")
def rdfs_types(spark, sf_dir):
    return _types_only(reason.closure(m.triples(spark, sf_dir, "part", only=("a",)).union(m.part_classes(spark, sf_dir))), "part")


def _closed(spark, data: DataFrame, axioms: list[tuple], owl: bool = True) -> DataFrame:
    return reason.closure(data.union(Graph.from_triples(spark, axioms).df), owl=owl)


@register("rdfs_domain_range", f"SELECT DISTINCT {e('order', 'o_orderkey')} AS s, {c('Purchase')} AS o FROM orders UNION SELECT DISTINCT {e('customer', 'o_custkey')}, {c('Buyer')} FROM orders UNION SELECT DISTINCT {e('customer', 'o_custkey')}, {c('Party')} FROM orders")
def rdfs_domain_range(spark, sf_dir):
    data = m.triples(spark, sf_dir, "orders", only=("placedBy",))
    out = _closed(spark, data, [(prop("placedBy"), DOMAIN, f"<{DATA}Purchase>"), (prop("placedBy"), RANGE, f"<{DATA}Buyer>"), (f"<{DATA}Buyer>", SUBCLASS, f"<{DATA}Party>")], owl=False)
    return out.where((F.col("p") == TYPE) & F.col("o").isin(*[f"<{DATA}{x}>" for x in ("Purchase", "Buyer", "Party")])).select("s", "o")


@register("rdfs_subproperty", f"SELECT {C_} AS s, '{prop('locatedIn')}' AS p, {e('nation', 'c_nationkey')} AS o FROM customer UNION ALL SELECT {e('nation', 'n_nationkey')}, '{prop('locatedIn')}', {e('region', 'n_regionkey')} FROM nation")
def rdfs_subproperty(spark, sf_dir):
    data = m.triples(spark, sf_dir, "customer", "nation", only=("inNation", "partOf"))
    out = _closed(spark, data, [(prop("inNation"), SUBPROPERTY, prop("locatedIn")), (prop("partOf"), SUBPROPERTY, prop("locatedIn"))], owl=False)
    return out.where(F.col("p") == prop("locatedIn"))


@register("owl_inverse_symmetric", f"SELECT {e('customer', 'o_custkey')} AS s, '{prop('placed')}' AS p, {O_} AS o FROM orders UNION ALL SELECT {O_}, '{prop('linked')}', {e('customer', 'o_custkey')} FROM orders UNION ALL SELECT {e('customer', 'o_custkey')}, '{prop('linked')}', {O_} FROM orders")
def owl_inverse_symmetric(spark, sf_dir):
    data = m.triples(spark, sf_dir, "orders", only=("placedBy",))
    out = _closed(spark, data, [(prop("placed"), iri(OWL + "inverseOf"), prop("placedBy")), (prop("placedBy"), SUBPROPERTY, prop("linked")), (prop("linked"), TYPE, iri(OWL + "SymmetricProperty"))])
    return out.where(F.col("p").isin(prop("placed"), prop("linked")))


@register("owl_transitive", f"{_CHAIN} SELECT {e('order', 'a')} AS s, '{prop('next')}' AS p, {e('order', 'b')} AS o FROM r")
def owl_transitive(spark, sf_dir):
    return _closed(spark, m.order_chain(spark, sf_dir), [(prop("next"), TYPE, iri(OWL + "TransitiveProperty"))]).where(F.col("p") == prop("next")).where(F.startswith("o", F.lit(f"<{DATA}order/")))


@register("owl_has_value", f"SELECT {C_} AS s, {c('Builder')} AS o FROM customer WHERE c_mktsegment = 'BUILDING' UNION ALL SELECT {C_}, {c('VipBuilder')} FROM customer JOIN nation ON n_nationkey = c_nationkey WHERE c_mktsegment = 'BUILDING' AND c_nationkey = 2")
def owl_has_value(spark, sf_dir):
    data = m.triples(spark, sf_dir, "customer", only=("segment", "inNation"))
    r = lambda k: f"_:r{k}"
    axioms = [
        (f"<{DATA}Builder>", iri(OWL + "equivalentClass"), r(1)), (r(1), iri(OWL + "onProperty"), prop("segment")), (r(1), iri(OWL + "hasValue"), '"BUILDING"'),
        (r(2), iri(OWL + "onProperty"), prop("inNation")), (r(2), iri(OWL + "hasValue"), f"<{DATA}nation/2>"),
        (f"<{DATA}VipBuilder>", iri(OWL + "intersectionOf"), "_:l1"), ("_:l1", iri("http://www.w3.org/1999/02/22-rdf-syntax-ns#first"), f"<{DATA}Builder>"), ("_:l1", iri("http://www.w3.org/1999/02/22-rdf-syntax-ns#rest"), "_:l2"),
        ("_:l2", iri("http://www.w3.org/1999/02/22-rdf-syntax-ns#first"), r(2)), ("_:l2", iri("http://www.w3.org/1999/02/22-rdf-syntax-ns#rest"), iri("http://www.w3.org/1999/02/22-rdf-syntax-ns#nil")),
    ]
    out = _closed(spark, data, axioms)
    return out.where((F.col("p") == TYPE) & F.col("o").isin(f"<{DATA}Builder>", f"<{DATA}VipBuilder>")).select("s", "o")


@register("owl_some_values", f"SELECT DISTINCT {O_} AS s, {c('BuilderOrder')} AS o FROM orders JOIN customer ON o_custkey = c_custkey WHERE c_mktsegment = 'BUILDING'")
def owl_some_values(spark, sf_dir):
    data = m.triples(spark, sf_dir, "orders", only=("placedBy",)).union(m.table(spark, sf_dir, "customer").where("c_mktsegment = 'BUILDING'").select(entity("customer", F.col("c_custkey")), F.lit(TYPE), F.lit(f"<{DATA}Builder>")))
    axioms = [("_:r", iri(OWL + "onProperty"), prop("placedBy")), ("_:r", iri(OWL + "someValuesFrom"), f"<{DATA}Builder>"), ("_:r", SUBCLASS, f"<{DATA}BuilderOrder>")]
    return _closed(spark, data, axioms).where((F.col("p") == TYPE) & (F.col("o") == f"<{DATA}BuilderOrder>")).select("s", "o")


@register("owl_chain", f"SELECT DISTINCT {O_} AS s, {e('region', 'n_regionkey')} AS o FROM orders JOIN customer ON o_custkey = c_custkey {_GEO}")
def owl_chain(spark, sf_dir):
    data = m.triples(spark, sf_dir, "orders", "customer", "nation", only=("placedBy", "inNation", "partOf"))
    first, rest, nil = (iri("http://www.w3.org/1999/02/22-rdf-syntax-ns#" + x) for x in ("first", "rest", "nil"))
    axioms = [(prop("soldIn"), iri(OWL + "propertyChainAxiom"), "_:a"), ("_:a", first, prop("placedBy")), ("_:a", rest, "_:b"), ("_:b", first, prop("inNation")), ("_:b", rest, "_:c"), ("_:c", first, prop("partOf")), ("_:c", rest, nil)]
    return _closed(spark, data, axioms).where(F.col("p") == prop("soldIn")).select("s", "o")


@register("owl_same_as", "WITH k AS (SELECT s_suppkey, s_nationkey FROM supplier) SELECT " + e("supplier", "a.s_suppkey") + " AS s, " + e("supplier", "b.s_suppkey") + " AS o FROM k a JOIN k b ON a.s_nationkey = b.s_nationkey WHERE a.s_suppkey <> b.s_suppkey")
def owl_same_as(spark, sf_dir):
    data = m.triples(spark, sf_dir, "supplier", only=("inNation",))
    out = _closed(spark, data, [(prop("inNation"), TYPE, iri(OWL + "InverseFunctionalProperty"))])
    return reason.simplify(out).where(F.col("p") == iri(OWL + "sameAs")).select("s", "o")


@register("owl_inconsistency", f"SELECT 'cax-dw' AS rule, {C_} AS s, '{TYPE}' AS p, {c('Debtor')} AS o FROM customer WHERE c_mktsegment = 'BUILDING' AND c_acctbal < 0")
def owl_inconsistency(spark, sf_dir):
    t = m.table(spark, sf_dir, "customer")
    who = entity("customer", F.col("c_custkey"))
    data = t.where("c_acctbal < 0").select(who.alias("s"), F.lit(TYPE).alias("p"), F.lit(f"<{DATA}Debtor>").alias("o")).union(t.where("c_mktsegment = 'BUILDING'").select(who, F.lit(TYPE), F.lit(f"<{DATA}Builder>")))
    return reason.inconsistencies(data.union(Graph.from_triples(spark, [(f"<{DATA}Builder>", iri(OWL + "disjointWith"), f"<{DATA}Debtor>")]).df))


@register("simplify", f"SELECT {C_} AS s, '{TYPE}' AS p, {c('Customer')} AS o FROM customer")
def simplify(spark, sf_dir):
    t = m.triples(spark, sf_dir, "customer", only=("a",))
    vague = t.select("s", "p", F.lit(iri(OWL + "Thing")).alias("o")).union(t.select("s", "p", F.lit("_:x"))).union(t.select("s", F.lit(iri(OWL + "sameAs")), F.col("s")))
    return reason.simplify(t.union(vague))


@register("most_specific_types", f"SELECT {e('part', 'p_partkey')} AS s, {LEAF} AS o FROM part")
def most_specific_types(spark, sf_dir):
    classes = m.part_classes(spark, sf_dir)
    closed = reason.closure(m.triples(spark, sf_dir, "part", only=("a",)).union(classes))
    return reason.most_specific_types(closed.where(F.startswith("s", F.lit(f"<{DATA}part/")) & (F.col("o") != "<http://www.w3.org/2000/01/rdf-schema#Resource>")), transitive(classes.where(F.col("p") == SUBCLASS).select("s", "o")))


# shapes


def _shapes(text: str) -> Graph:
    from pyspark.sql import SparkSession

    return Graph.parse(SparkSession.active(), "@prefix d: <urn:tessera:data/> .\n" + text)


def _shape(name: str, tables: tuple[str, ...], text: str, sql: str, only=None, extra=None):
    """A query for the violations of one shapes document."""

    @register(name, sql)
    def run(spark, sf_dir):
        data = m.triples(spark, sf_dir, *tables, only=only)
        if extra:
            data = data.union(extra(spark, sf_dir))
        return shacl.violations(data, _shapes(text).df).select("focus_node", "value", "component")


_NV = "NULL::VARCHAR AS value"
_shape("shape_class", ("customer", "supplier", "nation"), "d:S a sh:NodeShape ; sh:targetSubjectsOf d:inNation ; sh:class d:Customer .", f"SELECT {e('supplier', 's_suppkey')} AS focus_node, {e('supplier', 's_suppkey')} AS value, 'class' AS component FROM supplier", ("a", "inNation"))
_shape("shape_range", ("customer", "nation", "supplier"), "d:S a sh:NodeShape ; sh:targetClass d:Nation ; sh:property [ sh:path [ sh:inversePath d:inNation ] ; sh:class d:Customer ] .", f"SELECT {e('nation', 's_nationkey')} AS focus_node, {e('supplier', 's_suppkey')} AS value, 'class' AS component FROM supplier", ("a", "inNation"))
_shape("shape_counts", ("customer", "orders"), "d:S a sh:NodeShape ; sh:targetClass d:Customer ; sh:property [ sh:path [ sh:inversePath d:placedBy ] ; sh:minCount 5 ; sh:maxCount 15 ] .", f"WITH k AS (SELECT c_custkey, count(o_orderkey) AS n FROM customer LEFT JOIN orders ON o_custkey = c_custkey GROUP BY c_custkey) SELECT {C_} AS focus_node, {_NV}, CASE WHEN n < 5 THEN 'minCount' ELSE 'maxCount' END AS component FROM k WHERE n < 5 OR n > 15", ("a", "placedBy"))
_shape("shape_pattern_in", ("part",), 'd:S a sh:NodeShape ; sh:targetSubjectsOf d:brand ; sh:property [ sh:path d:brand ; sh:pattern "#[0-9]+$" ; sh:in ( "Brand#1" "Brand#2" "Brand#3" ) ] , [ sh:path d:name ; sh:pattern "^[A-P]" ; sh:flags "i" ; sh:maxLength 12 ] .', f"""SELECT {e('part', 'p_partkey')} AS focus_node, {s('p_brand')} AS value, 'in' AS component FROM part WHERE p_brand NOT IN ('Brand#1', 'Brand#2', 'Brand#3') UNION ALL SELECT {e('part', 'p_partkey')}, {s('p_name')}, 'pattern' FROM part WHERE NOT regexp_matches(p_name, '^[A-P]', 'i') UNION ALL SELECT {e('part', 'p_partkey')}, {s('p_name')}, 'maxLength' FROM part WHERE length(p_name) > 12""", ("brand", "name"))
_shape("shape_values", ("orders",), 'd:S a sh:NodeShape ; sh:targetClass d:Order ; sh:property [ sh:path d:total ; sh:datatype xsd:integer ; sh:minInclusive 500000 ; sh:maxExclusive 40000000 ] , [ sh:path d:status ; sh:datatype xsd:integer ] .', f"""SELECT {O_} AS focus_node, {n(CENTS.format('o_totalprice'))} AS value, 'minInclusive' AS component FROM orders WHERE round(o_totalprice * 100) < 500000 UNION ALL SELECT {O_}, {n(CENTS.format('o_totalprice'))}, 'maxExclusive' FROM orders WHERE round(o_totalprice * 100) >= 40000000 UNION ALL SELECT {O_}, {s('o_orderstatus')}, 'datatype' FROM orders""", ("a", "total", "status"))
_shape("shape_has_value", ("customer",), 'd:S a sh:NodeShape ; sh:targetClass d:Customer ; sh:property [ sh:path d:segment ; sh:hasValue "BUILDING" ] .', f"SELECT {C_} AS focus_node, {_NV}, 'hasValue' AS component FROM customer WHERE c_mktsegment <> 'BUILDING'", ("a", "segment"))
_shape("shape_qualified", ("customer", "orders"), 'd:S a sh:NodeShape ; sh:targetClass d:Customer ; sh:property [ sh:path [ sh:inversePath d:placedBy ] ; sh:qualifiedValueShape [ sh:property [ sh:path d:status ; sh:hasValue "F" ] ] ; sh:qualifiedMinCount 2 ] .', f"SELECT {C_} AS focus_node, {_NV}, 'qualifiedMinCount' AS component FROM customer LEFT JOIN orders ON o_custkey = c_custkey AND o_orderstatus = 'F' GROUP BY c_custkey HAVING count(o_orderkey) < 2", ("a", "placedBy", "status"))
_A, _BH = '[ sh:property [ sh:path d:segment ; sh:hasValue "BUILDING" ] ]', "[ sh:property [ sh:path d:inNation ; sh:in ( <urn:tessera:data/nation/1> <urn:tessera:data/nation/2> <urn:tessera:data/nation/3> ) ] ]"
for _name, _test in (("or", "NOT (a OR b)"), ("and", "NOT (a AND b)"), ("xone", "a = b")):
    _shape(f"shape_{_name}", ("customer",), f"d:S a sh:NodeShape ; sh:targetClass d:Customer ; sh:{_name} ( {_A} {_BH} ) .", f"SELECT {C_} AS focus_node, {C_} AS value, '{_name}' AS component FROM (SELECT *, c_mktsegment = 'BUILDING' AS a, c_nationkey IN (1, 2, 3) AS b FROM customer) WHERE {_test}", ("a", "segment", "inNation"))
_shape("shape_not_node", ("orders", "customer"), f"d:S a sh:NodeShape ; sh:targetClass d:Order ; sh:property [ sh:path d:placedBy ; sh:not {_A} ] , [ sh:path d:placedBy ; sh:node d:N ] . d:N a sh:NodeShape ; sh:property [ sh:path d:inNation ; sh:minCount 1 ] .", f"SELECT {O_} AS focus_node, {e('customer', 'o_custkey')} AS value, 'not' AS component FROM orders JOIN customer ON o_custkey = c_custkey WHERE c_mktsegment = 'BUILDING'", ("a", "placedBy", "segment", "inNation"))
_shape("shape_closed", ("region",), "d:S a sh:NodeShape ; sh:targetClass d:Region ; sh:closed true ; sh:ignoredProperties ( rdf:type ) .", f"SELECT {e('region', 'r_regionkey')} AS focus_node, {s('r_name')} AS value, 'closed' AS component FROM region", ("a", "name"))


@register("shape_sparql", f"SELECT {C_} AS focus_node, {e('nation', 'c_nationkey')} AS value, 'Customer in ' || n_name || ' is in debt' AS message FROM customer {_GEO} WHERE round(c_acctbal * 100) < 0")
def shape_sparql(spark, sf_dir):
    shapes = _shapes('d:S a sh:NodeShape ; sh:targetClass d:Customer ; sh:sparql [ sh:message "Customer in {?x} is in debt" ; sh:prefixes d:P ; sh:select """SELECT $this ?value ?x WHERE { $this q:inNation ?value ; q:balance ?b . ?value q:name ?x FILTER(?b < 0) }""" ] . d:P sh:declare [ sh:prefix "q" ; sh:namespace "urn:tessera:data/" ] .')
    return shacl.violations(m.triples(spark, sf_dir, "customer", "nation"), shapes.df).select("focus_node", "value", "message")


@register("validate_summary", f"WITH k AS (SELECT c_custkey, count(o_orderkey) AS n FROM customer LEFT JOIN orders ON o_custkey = c_custkey GROUP BY c_custkey) SELECT CASE WHEN n < 5 THEN 'minCount' ELSE 'maxCount' END AS component, CASE WHEN n < 5 THEN 'Warning' ELSE 'Violation' END AS severity, count(*) AS n FROM k WHERE n < 5 OR n > 15 GROUP BY ALL")
def validate_summary(spark, sf_dir):
    shapes = _shapes("d:S a sh:NodeShape ; sh:targetClass d:Customer ; sh:property [ sh:path [ sh:inversePath d:placedBy ] ; sh:minCount 5 ; sh:severity sh:Warning ] , [ sh:path [ sh:inversePath d:placedBy ] ; sh:maxCount 15 ] , [ sh:path d:segment ; sh:maxCount 0 ; sh:deactivated true ] .")
    return shacl.violations(m.triples(spark, sf_dir, "customer", "orders", only=("a", "placedBy", "segment")), shapes.df).groupBy("component", "severity").agg(F.count("*").alias("n"))


@register("triple_rule", f"SELECT {C_} AS s, '{prop('locatedIn')}' AS p, {e('region', 'n_regionkey')} AS o FROM customer {_GEO} WHERE c_mktsegment = 'BUILDING'")
def triple_rule(spark, sf_dir):
    shapes = _shapes(f"d:S a sh:NodeShape ; sh:targetClass d:Customer ; sh:rule [ a sh:TripleRule ; sh:subject sh:this ; sh:predicate d:locatedIn ; sh:object [ sh:path ( d:inNation d:partOf ) ] ; sh:condition {_A} ] .")
    data = Graph(m.triples(spark, sf_dir, "customer", "nation", only=("a", "segment", "inNation", "partOf")))
    return shacl.infer(data, shapes).df.where(F.col("p") == prop("locatedIn"))


@register("sparql_rule", f"SELECT {e('nation', 'n_nationkey')} AS s, '{prop('near')}' AS p, {e('nation', 'k')} AS o FROM (SELECT a.n_nationkey, b.n_nationkey AS k FROM nation a JOIN nation b ON a.n_regionkey = b.n_regionkey AND a.n_nationkey <> b.n_nationkey)")
def sparql_rule(spark, sf_dir):
    shapes = _shapes('d:S a sh:NodeShape ; sh:targetClass d:Nation ; sh:rule [ a sh:SPARQLRule ; sh:construct """CONSTRUCT { $this <urn:tessera:data/near> ?x } WHERE { $this <urn:tessera:data/partOf> ?r . ?x <urn:tessera:data/partOf> ?r FILTER($this != ?x) }""" ] .')
    return shacl.infer(Graph(m.triples(spark, sf_dir, "nation", only=("a", "partOf"))), shapes).df.where(F.col("p") == prop("near"))


# tags, device models, alignments


def _tagged(spark, sf_dir) -> tuple[DataFrame, DataFrame]:
    """(sets, lookup): parts with the words of name, type and brand as tags; names' words as classes' tags."""
    part = m.table(spark, sf_dir, "part")
    words = F.array_distinct(F.split(F.lower("p_name"), "[ _#]+"))
    sets = part.select(F.col("p_partkey").alias("id"), F.array_distinct(F.concat(words, F.array(F.lower("p_type")))).alias("tags"))
    names = part.select("p_name").distinct().withColumn("tags", F.array_sort(F.array_distinct(F.split(F.lower("p_name"), "[ _#]+"))))
    return sets, names.groupBy("tags").agg(F.array_sort(F.collect_set("p_name")).alias("classes"))


_WORDS = "list_sort(list_distinct(string_split_regex(lower(p_name), '[ _#]+')))"
_TAGS = f"WITH t AS (SELECT p_partkey AS id, list_sort(list_distinct(list_concat(string_split_regex(lower(p_name), '[ _#]+'), [lower(p_type)]))) AS tags, {_WORDS} AS own FROM part), k AS (SELECT words, list_sort(list(DISTINCT p_name)) AS classes FROM (SELECT p_name, {_WORDS} AS words FROM part) GROUP BY words)"


@register("tag_exact", f"{_TAGS} SELECT id, unnest(classes) AS class FROM t JOIN k ON own = words")
def tag_exact(spark, sf_dir):
    _, lookup = _tagged(spark, sf_dir)
    part = m.table(spark, sf_dir, "part").select(F.col("p_partkey").alias("id"), F.split(F.lower("p_name"), "[ _#]+").alias("tags"))
    return tags.exact(part, lookup).select("id", "class")


@register("tag_approximate", f"{_TAGS}, g AS (SELECT id, generic, list_distinct(list_append(tags, generic)) AS q FROM t, (VALUES ('Point'), ('Equipment'), ('Location')) v(generic)) SELECT id, generic, array_to_string(words, ' ') AS words, array_to_string(classes, '|') AS classes FROM g JOIN k ON list_has_all(q, words) OR list_has_all(words, q)")
def tag_approximate(spark, sf_dir):
    sets, lookup = _tagged(spark, sf_dir)
    return tags.approximate(sets, lookup).select("id", "generic", F.array_join("class_tags", " ").alias("words"), F.array_join("classes", "|").alias("classes"))


@register("tag_most_likely", f"{_TAGS}, j AS (SELECT id, tags, words, classes[1] AS class, len(list_intersect(tags, words)) AS n FROM t, k), w AS (SELECT *, rank() OVER (PARTITION BY id ORDER BY n DESC, len(words) - n) AS place FROM j WHERE n > 0), b AS (SELECT id, list_sort(list(DISTINCT class)) AS classes, min_by(words, class) AS first FROM w WHERE place = 1 GROUP BY id) SELECT t.id, coalesce(array_to_string(b.classes, '|'), '') AS classes, array_to_string(list_sort(list_filter(t.tags, lambda x: NOT list_contains(coalesce(b.first, []), x))), ' ') AS leftover FROM t LEFT JOIN b USING (id)")
def tag_most_likely(spark, sf_dir):
    sets, lookup = _tagged(spark, sf_dir)
    return tags.most_likely(sets, lookup).select("id", F.array_join("classes", "|").alias("classes"), F.array_join("leftover", " ").alias("leftover"))


@register("tag_translate", "SELECT event_id AS id, CASE event_type WHEN 'click' THEN 'Command Discharge Supply' WHEN 'view' THEN 'Zone other' ELSE event_type END AS tags FROM events")
def tag_translate(spark, sf_dir):
    ev = m.table(spark, sf_dir, "events")
    sets = F.when(F.col("event_type") == "click", F.array(F.lit("Cmd"), F.lit("discharge"))).when(F.col("event_type") == "view", F.array(F.lit("zone"), F.lit("other"))).otherwise(F.array("event_type"))
    return tags.translate(ev.select(F.col("event_id").alias("id"), sets.alias("tags"))).select("id", F.array_join("tags", " ").alias("tags"))


@register("tag_expand", f"SELECT {e('user', 'user_id')} AS s, '{TYPE}' AS p, '<{BLD}' || CASE WHEN list_contains(k, 'purchase') AND len(k) = 5 THEN 'Full' ELSE 'NoErrors' END || '>' AS o FROM (SELECT user_id, list(DISTINCT event_type) AS k FROM events GROUP BY user_id) WHERE len(k) = 5 OR (len(k) = 4 AND NOT list_contains(k, 'error'))")
def tag_expand(spark, sf_dir):
    ev = m.table(spark, sf_dir, "events")
    data = ev.select(entity("user", F.col("user_id")).alias("s"), F.lit(HAS_TAG).alias("p"), F.concat(F.lit("<urn:tessera:tag#"), "event_type", F.lit(">")).alias("o")).distinct()
    kinds = ["click", "error", "purchase", "signup", "view"]
    rows = [(iri(BLD + "Full"), HAS_ASSOCIATED_TAG, f"<urn:tessera:tag#{k}>") for k in kinds] + [(iri(BLD + "NoErrors"), HAS_ASSOCIATED_TAG, f"<urn:tessera:tag#{k}>") for k in kinds if k != "error"]
    return tags.expand_tags(data, tags.lookup_table(Graph.from_triples(spark, rows).df))


@register("class_tags", f"SELECT {e('part', 'p_partkey')} AS s, '{HAS_TAG}' AS p, '<urn:tessera:tag#' || p_type || '>' AS o FROM part UNION SELECT {e('part', 'p_partkey')}, '{HAS_TAG}', '<urn:tessera:tag#' || p_brand || '>' FROM part")
def class_tags(spark, sf_dir):
    part = m.table(spark, sf_dir, "part")
    own = part.select(m.part_class("p_type", "p_brand").alias("s"), F.lit(HAS_ASSOCIATED_TAG).alias("p"), F.explode(F.array("p_type", "p_brand")).alias("t")).distinct()
    return tags.class_tags(m.triples(spark, sf_dir, "part", only=("a",)).union(own.select("s", "p", F.concat(F.lit("<urn:tessera:tag#"), "t", F.lit(">")))))


@register("device_model", f"""WITH p AS (SELECT user_id, event_id, '<{DATA}' || event_id || '_point>' AS pt, '<{DATA}u' || user_id || '_equip>' AS eq FROM events WHERE event_type IN ('click', 'view')), u AS (SELECT DISTINCT user_id, '<{DATA}u' || user_id || '_equip>' AS eq FROM events)
SELECT pt AS s, '{TYPE}' AS p, '<{BLD}Sensor>' AS o FROM p UNION SELECT pt, '{LABEL}', '"' || event_id || '"' FROM p UNION SELECT eq, '{HAS_POINT}', pt FROM p UNION SELECT eq, '{TYPE}', '<{BLD}Fan>' FROM u UNION SELECT eq, '{LABEL}', '"u' || user_id || '"' FROM u""")
def device_model(spark, sf_dir):
    ev = m.table(spark, sf_dir, "events")
    mark = F.lit("m:")
    rows = ev.where(F.col("event_type").isin("click", "view")).select(F.col("event_id").alias("n"), F.create_map(F.lit("id"), F.concat(F.lit("r:"), "event_id", F.lit(' "shown"')), F.lit("equipRef"), F.concat(F.lit("r:u"), "user_id"), F.lit("point"), mark, F.lit("sensor"), mark, F.lit("hisFoo"), mark, F.lit("tz"), F.lit("x")).alias("cells"))
    equips = ev.select("user_id").distinct().select(F.lit(0).cast("bigint").alias("n"), F.create_map(F.lit("id"), F.concat(F.lit("r:u"), "user_id"), F.lit("fan"), mark, F.lit("equip"), mark).alias("cells"))
    ontology = Graph.from_triples(spark, [(iri(BLD + "Sensor"), SUBCLASS, POINT), (iri(BLD + "Fan"), SUBCLASS, EQUIPMENT)] + [(iri(BLD + a), HAS_ASSOCIATED_TAG, f"<urn:tessera:tag#{b}>") for a, b in (("Sensor", "Sensor"), ("Sensor", "Point"), ("Fan", "Fan"), ("Fan", "Equipment"))]).df
    return haystack.infer_entities(haystack.entities_of(rows.union(equips)), tags.lookup_table(ontology), ontology, DATA)


@register("regex_join", "SELECT DISTINCT pattern, p_name AS tag FROM part JOIN (VALUES ('[A-M].*e'), ('.*(o|u)'), ('[^ ]+ [a-f]')) v(pattern) ON regexp_matches(p_name, '^(?:' || pattern || ')')")
def regex_join(spark, sf_dir):
    patterns = spark.createDataFrame([("[A-M].*e",), (".*(o|u)",), ("[^ ]+ [a-f]",)], "pattern string")
    return vbis.tags_of_patterns(patterns, m.table(spark, sf_dir, "part").select(F.col("p_name").alias("tag")))


@register("common_prefix", """WITH g AS (SELECT p_type, min(t) AS lo, max(t) AS hi FROM (SELECT p_type, '-' || p_type || '-' || p_brand AS t FROM part) GROUP BY p_type) SELECT p_type, trim(substr(lo, 1, list_max(list_filter(range(0, length(lo) + 1), lambda k: substr(lo, 1, k::BIGINT) = substr(hi, 1, k::BIGINT)))::BIGINT), '-') AS prefix FROM g""")
def common_prefix(spark, sf_dir):
    part = m.table(spark, sf_dir, "part")
    return part.groupBy("p_type").agg(F.collect_set(F.concat_ws("-", F.lit(""), "p_type", "p_brand")).alias("x")).select("p_type", vbis.common_prefix(F.col("x")).alias("prefix"))


@register("align_tags", f"""SELECT {e('part', 'p_partkey')} AS s, '{vbis.TAG_PROPERTY}' AS p, CASE p_type WHEN 'ECONOMY' THEN '"ME-Ec"' ELSE '"EL"' END AS o FROM part WHERE p_type IN ('ECONOMY', 'PROMO')""")
def align_tags(spark, sf_dir):
    part = m.table(spark, sf_dir, "part")
    data = part.select(entity("part", F.col("p_partkey")).alias("s"), F.lit(TYPE).alias("p"), m.part_class("p_type").alias("o"))
    k = f"<{DATA}class/"
    alignment = Graph.parse(spark, f"""@prefix d: <{DATA}> .
{k}ECONOMY> rdfs:subClassOf bld:Equipment . {k}PROMO> rdfs:subClassOf bld:Equipment . {k}SMALL> rdfs:subClassOf bld:Equipment .
d:s1 a sh:NodeShape ; sh:targetClass {k}ECONOMY> ; sh:property [ sh:path bld:hasAlignmentTag ; sh:pattern "ME-Ec.*" ] .
d:s2 a sh:NodeShape ; sh:targetClass {k}PROMO> ; sh:or ( [ sh:property [ sh:path bld:hasAlignmentTag ; sh:pattern "EL-.*" ] ] [ sh:class d:X ] ) .""")
    master = spark.createDataFrame([("ME-Ec",), ("EL-Fa-1",), ("EL-Pu",), ("ZZ-1",)], "tag string")
    return vbis.annotate(data, alignment.df, master)


# versions

_LOG = f"WITH log AS (SELECT event_id::VARCHAR AS id, strftime(ts, '%Y-%m-%dT%H:%M:%S.%f') AS t, {e('graph', '(user_id % 4)')} AS g, event_type <> 'error' AS there, {e('user', 'user_id')} AS s, '{prop('did')}' AS p, CASE event_type WHEN 'error' THEN '\"click\"' ELSE {s('event_type')} END AS o FROM events)"


@register("graph_at", f"{_LOG} SELECT g, s, p, o FROM (SELECT *, row_number() OVER (PARTITION BY g, s, p, o ORDER BY t DESC, there DESC) AS k FROM log WHERE t <= (SELECT quantile_disc(t, 0.5) FROM log)) WHERE k = 1 AND there")
def graph_at(spark, sf_dir):
    log = m.event_log(spark, sf_dir)
    half = m.table(spark, sf_dir, "events").agg(F.date_format(F.expr("timestamp_micros(cast(percentile_disc(0.5) within group (order by unix_micros(cast(ts as timestamp))) as bigint))"), "yyyy-MM-dd'T'HH:mm:ss.SSSSSS")).first()[0]
    return versioned.state_at(log, half)


@register("graph_latest", f"{_LOG} SELECT g, s, p, o FROM (SELECT *, row_number() OVER (PARTITION BY g, s, p, o ORDER BY t DESC, there DESC) AS k FROM log) WHERE k = 1 AND there")
def graph_latest(spark, sf_dir):
    return versioned.state_at(m.event_log(spark, sf_dir))


@register("version_list", f"{_LOG} SELECT DISTINCT id, g, t AS timestamp FROM log WHERE g = '<{DATA}graph/1>'")
def version_list(spark, sf_dir):
    return versioned.versions(m.event_log(spark, sf_dir), f"<{DATA}graph/1>")


@register("version_latest", f"{_LOG} SELECT id, g, t AS timestamp FROM log ORDER BY t DESC, id LIMIT 1")
def version_latest(spark, sf_dir):
    return versioned.latest_version(m.event_log(spark, sf_dir))


@register("version_before", f"{_LOG} SELECT id, g, t AS timestamp FROM log WHERE t < (SELECT max(t) FROM log) ORDER BY t DESC, id LIMIT 1")
def version_before(spark, sf_dir):
    log = m.event_log(spark, sf_dir)
    return versioned.version_before(log, log.agg(F.max("timestamp")).first()[0])


@register("versions_as_of", f"{_LOG} SELECT s AS key, t AS ts, max(t) OVER (PARTITION BY s ORDER BY t RANGE BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW EXCLUDE GROUP) AS before FROM log")
def versions_as_of(spark, sf_dir):
    log = m.event_log(spark, sf_dir).withColumn("key", F.col("s"))
    return versioned.versions_before(log, log.select("key", F.col("timestamp").alias("ts")))


# merging and projections


def _two(spark, sf_dir) -> tuple[Graph, Graph]:
    """All customers in two namespaces, their segments as types; in the second a tenth carry one more letter in their label."""
    t = m.table(spark, sf_dir, "customer")
    label = {"c": F.col("c_name"), "d": F.when(F.col("c_custkey") % 10 == 3, F.concat("c_name", F.lit("x"))).otherwise(F.col("c_name"))}
    side = lambda at: Graph(m.triples_of(t, F.concat(F.lit(f"<{DATA}{at}/"), "c_custkey", F.lit(">")), [(TYPE, F.concat(F.lit(f"<{DATA}seg/"), "c_mktsegment", F.lit(">"))), (LABEL, terms.to_literal(label[at]))]))
    return side("c"), side("d")


_SIDES = f"WITH a AS (SELECT c_custkey AS k, '<{DATA}c/' || c_custkey || '>' AS entity, '<{DATA}d/' || c_custkey || '>' AS other, '<{DATA}seg/' || c_mktsegment || '>' AS type, c_name AS label FROM customer)"


@register("features", f"{_SIDES} SELECT entity, type AS types, label AS labels FROM a")
def features(spark, sf_dir):
    return merge.features(_two(spark, sf_dir)[0].df, DATA).select("entity", F.array_join("types", "|").alias("types"), F.array_join("labels", "|").alias("labels"))


@register("flat_features", f"{_SIDES} SELECT entity, type, label FROM a")
def flat_features(spark, sf_dir):
    return merge.flat_features(merge.features(_two(spark, sf_dir)[0].df, DATA))


@register("common_types", f"{_SIDES} SELECT DISTINCT type FROM a")
def common_types(spark, sf_dir):
    a, b = _two(spark, sf_dir)
    return merge.common_types(a.df, b.df, DATA)


@register("type_clusters", f"{_SIDES} SELECT type, string_agg(entity, ' ' ORDER BY entity) AS left_side, string_agg(other, ' ' ORDER BY other) AS right_side FROM a GROUP BY type")
def type_clusters(spark, sf_dir):
    a, b = _two(spark, sf_dir)
    return merge.clusters(merge.features(a.df, DATA), merge.features(b.df, DATA)).select("type", F.array_join("left", " ").alias("left_side"), F.array_join("right", " ").alias("right_side"))


@register("unify", f"SELECT {e('customer', 'CASE WHEN c_custkey % 2 = 1 THEN c_custkey - 1 ELSE c_custkey END')} AS s, '{prop('inNation')}' AS p, {e('nation', 'c_nationkey')} AS o FROM customer GROUP BY ALL")
def unify(spark, sf_dir):
    t = m.table(spark, sf_dir, "customer").where("c_custkey % 2 = 1")
    mapping = t.select(entity("customer", F.col("c_custkey")).alias("old"), entity("customer", F.col("c_custkey") - 1).alias("new"))
    return merge.unify(m.triples(spark, sf_dir, "customer", only=("inNation",)), mapping)


#: Labels that differ link at the mean of an equal name and of a label with one letter more.
_LINKS = f"{_SIDES} SELECT entity, other, CASE WHEN k % 10 = 3 THEN round((1 + length(label) / (length(label) + 1)) / 2, 6) ELSE 1.0 END::DOUBLE AS score FROM a"


@register("link_alone", f'{_SIDES} SELECT entity AS "left", other AS "right", 1.0::DOUBLE AS score FROM a')
def link_alone(spark, sf_dir):
    """Types with one entity on either side link whatever their names: each customer is a type of its own."""
    t = m.table(spark, sf_dir, "customer")
    side = lambda at: t.select(F.concat(F.lit(f"<{DATA}{at}/"), "c_custkey", F.lit(">")).alias("entity"), F.array(F.col("c_custkey").cast("string")).alias("types"), F.array(F.lit(at)).alias("labels"))
    return merge.link(side("c"), side("d"), threshold=1.0)


@register("link_scored", f'WITH l AS ({_LINKS}) SELECT entity AS "left", other AS "right", score FROM l')
def link_scored(spark, sf_dir):
    a, b = _two(spark, sf_dir)
    return merge.link(merge.features(a.df, DATA), merge.features(b.df, DATA))


@register("merge_graphs", f"""{_SIDES} SELECT entity AS s, '{TYPE}' AS p, type AS o FROM a UNION SELECT entity, '{LABEL}', '"' || label || '"' FROM a UNION SELECT entity, '{LABEL}', '"' || label || 'x"' FROM a WHERE k % 10 = 3""")
def merged(spark, sf_dir):
    a, b = _two(spark, sf_dir)
    return merge.merge_graphs(a, b, DATA).df


@register("merge_known_links", f"""{_SIDES} SELECT entity AS s, '{TYPE}' AS p, type AS o FROM a UNION SELECT entity, '{LABEL}', '"' || label || '"' FROM a UNION SELECT entity, '{LABEL}', '"' || label || 'x"' FROM a WHERE k % 10 = 3""")
def merged_by_links(spark, sf_dir):
    a, b = _two(spark, sf_dir)
    links = m.table(spark, sf_dir, "customer").select(F.concat(F.lit(f"<{DATA}c/"), "c_custkey", F.lit(">")).alias("left"), F.concat(F.lit(f"<{DATA}d/"), "c_custkey", F.lit(">")).alias("right"))
    return merge.merge_graphs(a, b, DATA, links=links).df


@register("unify_entities", f"SELECT {e('customer', 'c_custkey')} AS s, '{prop('inNation')}' AS p, CASE WHEN c_nationkey = 3 THEN {e('nation', '4')} ELSE {e('nation', 'c_nationkey')} END AS o FROM customer")
def unify_entities(spark, sf_dir):
    return merge.unify_entities(Graph(m.triples(spark, sf_dir, "customer", only=("inNation",))), f"<{DATA}nation/4>", f"<{DATA}nation/3>").df


def _site(spark, sf_dir) -> DataFrame:
    """Customers as equipment, their orders as points, nations as locations."""
    cust, orders, nation = (m.table(spark, sf_dir, t) for t in ("customer", "orders", "nation"))
    who, what, where = entity("customer", F.col("c_custkey")), entity("order", F.col("o_orderkey")), entity("nation", F.col("n_nationkey"))
    kind = lambda c: F.concat(F.lit(f"<{DATA}kind/"), c, F.lit(">"))
    df = cust.select(who.alias("s"), F.lit(TYPE).alias("p"), kind("c_mktsegment").alias("o"))
    df = df.union(cust.select(kind("c_mktsegment"), F.lit(SUBCLASS), F.lit(EQUIPMENT)).distinct()).union(cust.select(who, F.lit(HAS_LOCATION), entity("nation", F.col("c_nationkey"))))
    df = df.union(orders.select(what, F.lit(TYPE), kind("o_orderstatus"))).union(orders.select(kind("o_orderstatus"), F.lit(SUBCLASS), F.lit(POINT)).distinct())
    own = entity("customer", F.col("o_custkey"))
    df = df.union(orders.where("o_orderkey % 2 = 0").select(own, F.lit(HAS_POINT), what)).union(orders.where("o_orderkey % 2 = 1").select(what, F.lit(IS_POINT_OF), own))
    return df.union(nation.select(where, F.lit(TYPE), F.lit(LOCATION)))


@register("project_equipment", f"SELECT {C_} AS name, '<{DATA}kind/' || c_mktsegment || '>' AS type, {e('nation', 'c_nationkey')} AS location FROM customer")
def project_equipment(spark, sf_dir):
    return relational.tables(_site(spark, sf_dir))["equipment"]


@register("project_points", f"SELECT {O_} AS name, '<{DATA}kind/' || o_orderstatus || '>' AS type, {e('customer', 'o_custkey')} AS equipment FROM orders")
def project_points(spark, sf_dir):
    return relational.tables(_site(spark, sf_dir))["point"]


@register("project_locations", f"SELECT {e('nation', 'n_nationkey')} AS name, '{LOCATION}' AS type FROM nation")
def project_locations(spark, sf_dir):
    return relational.tables(_site(spark, sf_dir))["location"]


@register("class_tree", f"SELECT '{EQUIPMENT}' AS parent, '<{DATA}kind/' || c_mktsegment || '>' AS child, count(*) AS n_instances FROM customer GROUP BY c_mktsegment")
def class_tree(spark, sf_dir):
    return relational.class_tree(_site(spark, sf_dir), EQUIPMENT)


# sinks


@register("lines_round_trip", f"SELECT s, p, o FROM ({_IN}) UNION SELECT s, p, o FROM ({_SEG})")
def lines_round_trip(spark, sf_dir):
    """N-Triples text made of every triple and read again."""
    from .sources.rdf import LINE

    g = _halves(spark, sf_dir)[1].df
    line = g.select(F.concat(F.concat_ws(" ", "s", "p", "o"), F.lit(" .")).alias("value"))
    return line.select(*[F.regexp_extract("value", LINE, k).alias(x) for k, x in ((1, "s"), (2, "p"), (3, "o"))])


@register("json_results", f"""SELECT '{{"n":{{"type":"uri","value":"{DATA}nation/' || n_nationkey || '"}},"x":{{"type":"literal","value":"' || n_name || '"}}}}' AS binding FROM nation""")
def json_results(spark, sf_dir):
    from .results import bindings

    return bindings(ask(spark, m.triples(spark, sf_dir, "nation"), "SELECT ?n ?x WHERE { ?n :name ?x }"))


FLAGSHIP = "bgp_chain"

from . import more_queries  # noqa: E402, F401  registers its queries too
