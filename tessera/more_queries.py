"""Further registered queries: sources and sinks, versions, device models, packs, rules and accessors, each with its SQL."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from . import model as m
from .functions import terms
from .graph import VOCABULARY, Graph, GraphCollection
from .namespaces import BLD, DATA, DOMAIN, EQUIPMENT, HAS_ASSOCIATED_TAG, HAS_LOCATION, HAS_POINT, OWL, POINT, RANGE, RDF, SUBCLASS, SUBPROPERTY, TAG, TYPE, XSD, iri
from .operators import device_rdf, etl, haystack, reason, relational, shacl, tags, vbis, versioned
from .operators.closure import shared
from .queries import _NAT, _SEG, C_, O_, _closed, _halves, _quads, _shapes, ask, c, e, n, register, s, sparql
from .sources.tables import entity, prop, read_table


def _place(spark, stem: str) -> str:
    return f"{shared(spark)}/{stem}-{uuid.uuid4().hex}"


def _rows(*rows: tuple[str, str, str]) -> str:
    """SQL of constant triples."""
    return "SELECT * FROM (VALUES " + ", ".join("(" + ", ".join("'" + x.replace("'", "''") + "'" for x in r) + ")" for r in rows) + ") v(s, p, o)"


# sources and sinks


def _round_trip(name: str, format: str):
    @register(name, f"{_NAT} UNION ALL SELECT {e('nation', 'n_nationkey')}, '{prop('name')}', {s('n_name')} FROM nation")
    def run(spark, sf_dir):
        g = Graph(m.triples(spark, sf_dir, "nation", only=("partOf", "name")))
        return Graph.parse(spark, g.serialize(format), format).df


_round_trip("turtle_round_trip", "turtle")
_round_trip("xml_round_trip", "xml")


def _delimited(name: str, sep: str):
    @register(name, "SELECT c_custkey::VARCHAR AS id, c_name AS name, c_mktsegment AS segment FROM customer")
    def run(spark, sf_dir):
        place = _place(spark, "table")
        m.table(spark, sf_dir, "customer").select(F.col("c_custkey").alias(" id "), F.col("c_name").alias("name "), F.col("c_mktsegment").alias("segment")).write.option("header", True).option("sep", sep).csv(place)
        return read_table(spark, place, sep)


_delimited("read_csv", ",")
_delimited("read_tsv", "\t")


@register("saved_graph", f"SELECT {C_} AS c FROM customer WHERE c_mktsegment = 'BUILDING'")
def saved_graph(spark, sf_dir):
    place = _place(spark, "graph")
    _halves(spark, sf_dir)[1].save(place)
    return Graph.open(spark, place).query('SELECT ?c WHERE { ?c :segment "BUILDING" }')


@register("saved_collection", f"SELECT {e('graph', 'o_orderstatus')} AS g, {n('count(*)')} AS n FROM orders GROUP BY o_orderstatus")
def saved_collection(spark, sf_dir):
    place = _place(spark, "graphs")
    _quads(spark, sf_dir).save(place)
    return GraphCollection.open(spark, place).query("SELECT ?g (COUNT(?o) AS ?n) WHERE { GRAPH ?g { ?o :placedBy ?c } } GROUP BY ?g")


@register("upsert", f"SELECT {C_} AS name, CASE WHEN c_acctbal < 0 THEN 'debtor' ELSE c_mktsegment END AS kind FROM customer")
def upsert(spark, sf_dir):
    t = m.table(spark, sf_dir, "customer")
    who = entity("customer", F.col("c_custkey")).alias("name")
    old, new = t.select(who, F.col("c_mktsegment").alias("kind")), t.where("c_acctbal < 0").select(who, F.lit("debtor").alias("kind"))
    place = _place(spark, "table")
    relational.upsert(old, new).write.parquet(place)
    return spark.read.parquet(place)


@register("nested_add", "SELECT p, count(*) AS n FROM (VALUES ('part'), ('part'), ('size'), ('size'), ('of')) v(p) GROUP BY p")
def nested_add(spark, sf_dir):
    g = Graph.empty(spark).add((":a", prop("part"), [(prop("size"), 1), (prop("of"), [(prop("part"), ":b"), (prop("size"), 2)])]))
    return g.df.groupBy(terms.local_name(F.col("p")).alias("p")).agg(F.count("*").alias("n"))


_PLACE = "urn:tessera:place#"
_EQUAL = iri(OWL + "equivalentClass")


@register("alignment", _rows((f"<{BLD}Room>", SUBCLASS, f"<{_PLACE}Space>"), (f"<{BLD}Zone>", SUBCLASS, f"<{_PLACE}Area>"), (f"<{BLD}Location>", _EQUAL, f"<{_PLACE}Place>"), (f"<{BLD}hasLocation>", SUBPROPERTY, f"<{_PLACE}within>")))
def alignment(spark, sf_dir):
    return Graph.empty(spark).load_alignment(Graph.alignments()[0]).df


@register("vocabulary_graphs", f"SELECT * FROM (VALUES ('{VOCABULARY}', '1.0', true), ('{VOCABULARY}', '0.9', false)) v(g, version, reheat)")
def vocabulary_graphs(spark, sf_dir):
    out = None
    for version in reversed(Graph.versions()):
        g = GraphCollection.building(spark, version)
        one = g.df.groupBy("g").agg(F.lit(version).alias("version"), F.max(F.col("s") == f"<{BLD}RVAV>").alias("reheat"))
        out = one if out is None else out.union(one)
    return out


# patterns

sparql("path_in_not_exists", ("customer", "nation", "orders"), f"SELECT ?c WHERE {{ ?c a :Customer FILTER NOT EXISTS {{ ?c :inNation/:partOf+ <{DATA}region/1> }} }}", f"SELECT {C_} AS c FROM customer JOIN nation ON c_nationkey = n_nationkey WHERE n_regionkey <> 1")


@register("own_node", f"SELECT {C_} AS x FROM customer WHERE c_custkey % 3 = 0")
def own_node(spark, sf_dir):
    t = m.table(spark, sf_dir, "customer")
    likes = entity("customer", F.when(F.col("c_custkey") % 3 == 0, F.col("c_custkey")).otherwise(F.col("c_custkey") + 1))
    return ask(spark, t.select(entity("customer", F.col("c_custkey")).alias("s"), F.lit(prop("likes")).alias("p"), likes.alias("o")), "SELECT ?x WHERE { ?x :likes ?x }")


@register("path_in_graph", f"SELECT DISTINCT {e('graph', 'o_orderstatus')} AS g, {O_} AS o, {e('nation', 'c_nationkey')} AS n FROM orders JOIN customer ON o_custkey = c_custkey")
def path_in_graph(spark, sf_dir):
    q = _quads(spark, sf_dir).df
    where = m.table(spark, sf_dir, "orders").join(m.table(spark, sf_dir, "customer"), F.col("o_custkey") == F.col("c_custkey"))
    inside = where.select(F.concat(F.lit(f"<{DATA}graph/"), "o_orderstatus", F.lit(">")), entity("customer", F.col("c_custkey")), F.lit(prop("inNation")), entity("nation", F.col("c_nationkey"))).distinct()
    return GraphCollection(q.union(inside)).query("SELECT DISTINCT ?g ?o ?n WHERE { GRAPH ?g { ?o a? ?x . ?o (:placedBy|:inNation)+ ?n . ?o :placedBy ?c . ?c :inNation ?n } }")


def _accessor(name: str, sql: str, get):
    @register(name, sql)
    def run(spark, sf_dir):
        return get(_halves(spark, sf_dir)[1])


_BOTH = f"SELECT {C_} AS s, '{prop('inNation')}' AS p, {e('nation', 'c_nationkey')} AS o FROM customer UNION ALL {_SEG}"
_accessor("objects_of", f"SELECT DISTINCT o FROM ({_SEG})", lambda g: g.objects(None, prop("segment")))
_accessor("subject_objects", f"SELECT DISTINCT s, o FROM ({_SEG})", lambda g: g.subject_objects(prop("segment")))
_accessor("predicate_objects", f"SELECT DISTINCT p, o FROM ({_BOTH}) WHERE s = {e('customer', '7')}", lambda g: g.predicate_objects(f"<{DATA}customer/7>"))
_accessor("subject_predicates", f"SELECT DISTINCT s, p FROM ({_BOTH}) WHERE o = {e('nation', '3')}", lambda g: g.subject_predicates(f"<{DATA}nation/3>"))
_accessor("deskolemized", _BOTH.replace(f"'<{DATA}customer/' || c_custkey || '>'", "'_:c' || c_custkey"), lambda g: Graph(g.df.withColumn("s", F.regexp_replace("s", f"^<{DATA}customer/([0-9]+)>$", "_:c$1"))).skolemize().deskolemize().df)

# versions


def _versions(spark, sf_dir) -> versioned.VersionedGraphs:
    """Three changes of the nations' graph: all regions, those of region 1 removed, all names."""
    v = versioned.VersionedGraphs(spark, _place(spark, "versions"))
    rows = lambda p: [tuple(r) for r in m.triples(spark, sf_dir, "nation", only=(p,)).collect()]
    with v.new_changeset("urn:g:n", "2024-01-01T12:00:00+02:00") as changes:
        changes.add(*rows("partOf"))
    with v.new_changeset("urn:g:n", "2024-01-01T11:00:00Z") as changes:
        changes.remove(*[r for r in rows("partOf") if r[2] == f"<{DATA}region/1>"])
    with v.new_changeset("urn:g:n", "2024-01-01T11:30:00+00:00") as changes:
        changes.add(*rows("name"))
    return v


_NAMED = f"SELECT {e('nation', 'n_nationkey')} AS s, '{prop('name')}' AS p, {s('n_name')} AS o FROM nation"
_LESS = f"SELECT * FROM ({_NAT}) WHERE o <> '<{DATA}region/1>'"


def _history(name: str, sql: str, steps):
    @register(name, sql)
    def run(spark, sf_dir):
        v = _versions(spark, sf_dir)
        return steps(v)


def _after(*moves: str):
    def run(v):
        for x in moves:
            getattr(v, x)()
        return v.latest("urn:g:n").df

    return run


_history("changes_latest", f"{_LESS} UNION ALL {_NAMED}", _after())
_history("undo_changes", _NAT, _after("undo", "undo"))
_history("redo_change", _LESS, _after("undo", "undo", "redo"))
_history("changes_at", _NAT, lambda v: v.graph_at("2024-01-01T12:30:00+02:00", "urn:g:n").df)
_history("change_times", "SELECT * FROM (VALUES ('2024-01-01T10:00:00'), ('2024-01-01T11:00:00'), ('2024-01-01T11:30:00')) v(timestamp)", lambda v: v.versions().select("timestamp"))

# shapes and rules


def _violations(name: str, tables: tuple[str, ...], text: str, sql: str, only=None):
    @register(name, sql)
    def run(spark, sf_dir):
        return shacl.violations(m.triples(spark, sf_dir, *tables, only=only), _shapes(text).df).select("focus_node", "value", "component")


_TOP = f"SELECT {C_} AS focus_node, {{}} AS value, '{{}}' AS component FROM customer JOIN nation ON c_nationkey = n_nationkey"
_violations("shape_deactivated", ("customer",), 'd:S a sh:NodeShape ; sh:targetClass d:Customer ; sh:deactivated true ; sh:property [ sh:path d:segment ; sh:maxCount 0 ] . d:T a sh:NodeShape ; sh:targetClass d:Customer ; sh:property [ sh:path d:segment ; sh:hasValue "BUILDING" ] .', f"SELECT {C_} AS focus_node, NULL::VARCHAR AS value, 'hasValue' AS component FROM customer WHERE c_mktsegment <> 'BUILDING'", ("a", "segment"))
_violations("shape_path_sequence", ("customer", "nation"), f"d:S a sh:NodeShape ; sh:targetClass d:Customer ; sh:property [ sh:path ( d:inNation d:partOf ) ; sh:in ( <{DATA}region/0> <{DATA}region/2> <{DATA}region/3> <{DATA}region/4> ) ] .", _TOP.format(e("region", "n_regionkey"), "in") + " WHERE n_regionkey = 1", ("a", "inNation", "partOf"))
_violations("shape_path_closure", ("customer", "nation"), f"d:S a sh:NodeShape ; sh:targetClass d:Customer ; sh:property [ sh:path ( d:inNation [ sh:zeroOrMorePath d:partOf ] ) ; sh:hasValue <{DATA}region/1> ] .", _TOP.format("NULL::VARCHAR", "hasValue") + " WHERE n_regionkey <> 1", ("a", "inNation", "partOf"))
_violations("shape_path_alternative", ("customer",), "d:S a sh:NodeShape ; sh:targetClass d:Customer ; sh:property [ sh:path [ sh:alternativePath ( d:inNation d:segment ) ] ; sh:nodeKind sh:IRI ] .", f"SELECT {C_} AS focus_node, {s('c_mktsegment')} AS value, 'nodeKind' AS component FROM customer", ("a", "inNation", "segment"))


@register("shape_first_failure", "SELECT count(*) FILTER (WHERE n > 15) = 0 AS conforms, 1::BIGINT AS results, CASE WHEN count(*) FILTER (WHERE n > 15) > 0 THEN 'Violation' ELSE 'Warning' END AS severity FROM (SELECT c_custkey, count(o_orderkey) AS n FROM customer LEFT JOIN orders ON o_custkey = c_custkey GROUP BY c_custkey)")
def shape_first_failure(spark, sf_dir):
    shapes = _shapes("d:S a sh:NodeShape ; sh:targetClass d:Customer ; sh:property [ sh:path [ sh:inversePath d:placedBy ] ; sh:minCount 20000 ; sh:severity sh:Warning ] , [ sh:path [ sh:inversePath d:placedBy ] ; sh:maxCount 15 ] .")
    ok, report, _ = Graph(m.triples(spark, sf_dir, "customer", "orders", only=("a", "placedBy"))).validate(shapes, abort_on_first=True)
    return report.groupBy("severity").agg(F.count("*").alias("results")).select(F.lit(ok).alias("conforms"), "results", "severity")


@register("rules_without_blanks", f"SELECT {C_} AS s, '{prop('rich')}' AS p, '\"true\"^^<{XSD}boolean>' AS o FROM customer WHERE c_mktsegment = 'BUILDING'")
def rules_without_blanks(spark, sf_dir):
    shapes = _shapes('d:S a sh:NodeShape ; sh:targetClass d:Customer ; sh:rule [ a sh:TripleRule ; sh:condition [ sh:property [ sh:path d:segment ; sh:hasValue "BUILDING" ] ] ; sh:subject sh:this ; sh:predicate d:rich ; sh:object true ] , [ a sh:SPARQLRule ; sh:construct "CONSTRUCT { $this <urn:tessera:data/owns> [] } WHERE { $this <urn:tessera:data/segment> ?x }" ] .')
    data = Graph(m.triples(spark, sf_dir, "customer", only=("a", "segment")))
    return shacl.infer(data, shapes, keep_blank=False).df.where(F.col("p").isin(prop("rich"), prop("owns")))


# inference


@register("profile_schedule", f"SELECT DISTINCT {e('user', 'user_id')} AS s, CASE WHEN k THEN '<{BLD}Seen>' ELSE '<{DATA}Guest>' END AS o FROM (SELECT user_id, unnest([true, false]) AS k FROM events WHERE event_type = 'view') UNION SELECT DISTINCT {e('user', 'user_id')}, '<{DATA}Guest>' FROM events")
def profile_schedule(spark, sf_dir):
    """rdfs, then tags: a domain axiom types all users, a tag those who viewed."""
    ev = m.table(spark, sf_dir, "events")
    who = entity("user", F.col("user_id"))
    data = ev.where("event_type = 'view'").select(who.alias("s"), F.lit(tags.HAS_TAG).alias("p"), F.lit(f"<{TAG}Viewed>").alias("o")).union(ev.select(who, F.lit(prop("did")), terms.to_literal(F.col("event_type")))).distinct()
    axioms = Graph.from_triples(spark, [(prop("did"), DOMAIN, f"<{DATA}Guest>"), (iri(BLD + "Seen"), HAS_ASSOCIATED_TAG, f"<{TAG}Viewed>")])
    out = Graph(data).expand("rdfs+tags", ontology=axioms).df
    return out.where((F.col("p") == TYPE) & F.col("o").isin(f"<{DATA}Guest>", f"<{BLD}Seen>") & F.startswith("s", F.lit(f"<{DATA}user/"))).select("s", "o")


def _list(name: str, *members: str) -> list[tuple[str, str, str]]:
    cells = [f"_:{name}{k}" for k in range(len(members))] + [iri(RDF + "nil")]
    return [t for k, x in enumerate(members) for t in ((cells[k], iri(RDF + "first"), x), (cells[k], iri(RDF + "rest"), cells[k + 1]))]


O = lambda name: iri(OWL + name)  # noqa: E731, E741
D = lambda name: f"<{DATA}{name}>"


@register("owl_properties", f"SELECT {C_} AS s, '{prop('placeOf')}' AS p, {e('nation', 'c_nationkey')} AS o FROM customer UNION ALL SELECT {C_}, '{prop('whereabouts')}', {e('nation', 'c_nationkey')} FROM customer UNION ALL SELECT {C_}, '{TYPE}', {c('Settler')} FROM customer UNION ALL SELECT DISTINCT {e('nation', 'c_nationkey')}, '{TYPE}', {c('Country')} FROM customer")
def owl_properties(spark, sf_dir):
    data = m.triples(spark, sf_dir, "customer", only=("inNation",))
    out = _closed(spark, data, [(prop("inNation"), SUBPROPERTY, prop("placeOf")), (prop("placeOf"), O("equivalentProperty"), prop("whereabouts")), (prop("whereabouts"), DOMAIN, D("Settler")), (prop("inNation"), RANGE, D("Country"))])
    return out.where(F.col("p").isin(prop("placeOf"), prop("whereabouts")) | ((F.col("p") == TYPE) & F.col("o").isin(D("Settler"), D("Country"))))


@register("owl_class_lists", f"SELECT {C_} AS s, {c('Trade')} AS o FROM customer WHERE c_mktsegment IN ('BUILDING', 'MACHINERY') UNION ALL SELECT {C_}, {c('Favoured')} FROM customer WHERE c_custkey IN (1, 2) UNION ALL SELECT {C_}, {c('FavouredTrade')} FROM customer WHERE c_custkey IN (1, 2) AND c_mktsegment IN ('BUILDING', 'MACHINERY')")
def owl_class_lists(spark, sf_dir):
    kinds = m.table(spark, sf_dir, "customer").select(entity("customer", F.col("c_custkey")).alias("s"), F.lit(TYPE).alias("p"), F.concat(F.lit(f"<{DATA}seg/"), "c_mktsegment", F.lit(">")).alias("o"))
    axioms = [(D("Trade"), O("unionOf"), "_:u0"), *_list("u", D("seg/BUILDING"), D("seg/MACHINERY")), (D("Favoured"), O("oneOf"), "_:o0"), *_list("o", D("customer/1"), D("customer/2")), (D("FavouredTrade"), O("intersectionOf"), "_:i0"), *_list("i", D("Trade"), D("Favoured"))]
    return _closed(spark, kinds, axioms).where((F.col("p") == TYPE) & F.col("o").isin(D("Trade"), D("Favoured"), D("FavouredTrade"))).select("s", "o")


@register("owl_all_values", f"SELECT DISTINCT {e('nation', 'c_nationkey')} AS s, {c('Market')} AS o FROM customer WHERE c_mktsegment = 'BUILDING'")
def owl_all_values(spark, sf_dir):
    data = m.triples(spark, sf_dir, "customer", only=("inNation",)).union(m.table(spark, sf_dir, "customer").where("c_mktsegment = 'BUILDING'").select(entity("customer", F.col("c_custkey")), F.lit(TYPE), F.lit(D("Builder"))))
    axioms = [(D("Builder"), SUBCLASS, "_:r"), ("_:r", O("onProperty"), prop("inNation")), ("_:r", O("allValuesFrom"), D("Market"))]
    return _closed(spark, data, axioms).where((F.col("p") == TYPE) & (F.col("o") == D("Market"))).select("s", "o")


@register("owl_restriction_order", f"SELECT {C_} AS s FROM customer JOIN nation ON c_nationkey = n_nationkey WHERE n_regionkey = 1")
def owl_restriction_order(spark, sf_dir):
    """someValuesFrom a subclass by a subproperty is below someValuesFrom the class by the property."""
    n_, cu = m.table(spark, sf_dir, "nation"), m.triples(spark, sf_dir, "customer", only=("inNation",))
    data = cu.union(n_.where("n_regionkey = 1").select(entity("nation", F.col("n_nationkey")), F.lit(TYPE), F.lit(D("Near"))))
    axioms = [(D("Near"), SUBCLASS, D("Known")), ("_:a", O("onProperty"), prop("inNation")), ("_:a", O("someValuesFrom"), D("Near")), ("_:b", O("onProperty"), prop("inNation")), ("_:b", O("someValuesFrom"), D("Known")), ("_:a", TYPE, O("Restriction")), (D("Familiar"), O("equivalentClass"), "_:b")]
    out = _closed(spark, data, axioms)
    ordered = out.where((F.col("s") == "_:a") & (F.col("p") == SUBCLASS) & (F.col("o") == "_:b"))
    return out.where((F.col("p") == TYPE) & (F.col("o") == D("Familiar"))).select("s").join(ordered.select(F.lit(1).alias("one")).distinct()).select("s")


@register("owl_max_cardinality", f"SELECT {O_} AS s, {e('order', 'b.o_orderkey')} AS o FROM (SELECT min(o_orderkey) AS o_orderkey, o_custkey FROM orders GROUP BY o_custkey) f JOIN orders b USING (o_custkey) WHERE f.o_orderkey <> b.o_orderkey".replace(O_, e("order", "f.o_orderkey")))
def owl_max_cardinality(spark, sf_dir):
    """Customers with at most one :first order: a customer's orders are all one; shown against the least."""
    o = m.table(spark, sf_dir, "orders")
    who = entity("customer", F.col("o_custkey"))
    data = o.select(who.alias("s"), F.lit(prop("first")).alias("p"), entity("order", F.col("o_orderkey")).alias("o")).union(o.select(who, F.lit(TYPE), F.lit(D("Single"))).distinct())
    axioms = [(D("Single"), O("onProperty"), prop("first")), (D("Single"), O("maxCardinality"), f'"1"^^<{XSD}nonNegativeInteger>')]
    same = _closed(spark, data, axioms).where((F.col("p") == O("sameAs")) & (F.col("s") != F.col("o"))).select("s", "o")
    least = same.groupBy("s").agg(F.min(terms.local_name(F.col("o")).cast("bigint")).alias("k")).where(terms.local_name(F.col("s")).cast("bigint") < F.col("k")).select("s")
    return same.join(least, "s", "left_semi")


_TWO = f"SELECT '{{}}' AS rule, {C_} AS s, {{}} AS p, {{}} AS o FROM customer WHERE {{}}"
_BORN, _LIVES, _FRIEND = prop("born"), prop("lives"), prop("friend")


@register(
    "owl_contradictions",
    " UNION ".join(
        [
            _TWO.format("prp-irp", f"'{_FRIEND}'", C_, "c_custkey % 10 = 1"),
            _TWO.format("prp-asyp", f"'{_FRIEND}'", C_, "c_custkey % 10 = 1"),
            _TWO.format("prp-pdw", f"'{_BORN}'", e("nation", "c_nationkey"), "c_custkey % 10 = 2"),
            _TWO.format("prp-adp", f"'{_BORN}'", e("nation", "c_nationkey"), "c_custkey % 10 = 3"),
            _TWO.format("prp-npa", f"'{_LIVES}'", e("nation", "c_nationkey"), "c_custkey = 2"),
            _TWO.format("cls-nothing", f"'{TYPE}'", f"'{O('Nothing')}'", "c_custkey % 10 = 4"),
            _TWO.format("cls-com", f"'{TYPE}'", c("Absent"), "c_custkey % 10 = 5"),
            _TWO.format("cls-maxc1", f"'{_LIVES}'", e("nation", "c_nationkey"), "c_custkey % 10 = 6"),
            _TWO.format("cls-maxqc1", f"'{_LIVES}'", e("nation", "c_nationkey"), "c_custkey % 10 = 7 AND c_nationkey < 5"),
            _TWO.format("eq-diff1", f"'{O('sameAs')}'", e("nation", "c_nationkey"), "c_custkey % 10 = 8"),
            _TWO.format("dt-not-type", f"'{prop('age')}'", f"""'"' || c_custkey || '.5"^^<{XSD}integer>'""", "c_custkey % 10 = 9"),
            _TWO.format("eq-diff2", f"'{O('sameAs')}'", e("customer", "2"), "c_custkey = 1"),
        ]
    ),
)
def owl_contradictions(spark, sf_dir):
    """Every customer contradicts the axioms in one way, by the last digit of its key."""
    t = m.table(spark, sf_dir, "customer").withColumn("k", F.pmod("c_custkey", F.lit(10)))
    who, nation = entity("customer", F.col("c_custkey")), entity("nation", F.col("c_nationkey"))
    part = lambda k, p, o: t.where(F.col("k") == k).select(who.alias("s"), F.lit(p).alias("p"), (F.lit(o) if isinstance(o, str) else o).alias("o"))
    parts = [part(1, _FRIEND, who), part(2, _BORN, nation), part(2, _LIVES, nation), part(3, _BORN, nation), part(3, prop("fled"), nation), part(4, TYPE, O("Nothing")), part(5, TYPE, D("Absent")), part(5, TYPE, D("Present"))]
    parts += [part(6, TYPE, D("Homeless")), part(6, _LIVES, nation), part(7, TYPE, D("Foreign")), part(7, _LIVES, nation), part(8, O("sameAs"), nation), part(8, O("differentFrom"), nation), part(9, prop("age"), terms.typed(F.concat(F.col("c_custkey").cast("string"), F.lit(".5")), "integer"))]
    near = m.table(spark, sf_dir, "nation").where("n_nationkey < 5").select(entity("nation", F.col("n_nationkey")).alias("s"), F.lit(TYPE).alias("p"), F.lit(D("Near")).alias("o"))
    here = m.table(spark, sf_dir, "customer").where("c_custkey = 2").select(F.max("c_nationkey")).first()[0]
    none = f'"0"^^<{XSD}nonNegativeInteger>'
    axioms = [
        (_FRIEND, TYPE, O("IrreflexiveProperty")), (_FRIEND, TYPE, O("AsymmetricProperty")), (_BORN, O("propertyDisjointWith"), _LIVES), ("_:adp", TYPE, O("AllDisjointProperties")), ("_:adp", O("members"), "_:m0"), *_list("m", _BORN, prop("fled")),
        ("_:npa", O("sourceIndividual"), D("customer/2")), ("_:npa", O("assertionProperty"), _LIVES), ("_:npa", O("targetIndividual"), D(f"nation/{here}")), (D("Present"), O("complementOf"), D("Absent")),
        (D("Homeless"), O("onProperty"), _LIVES), (D("Homeless"), O("maxCardinality"), none), (D("Foreign"), O("onProperty"), _LIVES), (D("Foreign"), O("maxQualifiedCardinality"), none), (D("Foreign"), O("onClass"), D("Near")),
        ("_:ad", TYPE, O("AllDifferent")), ("_:ad", O("distinctMembers"), "_:d0"), *_list("d", D("customer/1"), D("customer/2")), (D("customer/1"), O("sameAs"), D("customer/2")),
    ]
    data = near
    for x in parts:
        data = data.union(x)
    return reason.inconsistencies(data.union(Graph.from_triples(spark, axioms).df))


# tags, devices, alignments, conversions


@register("point_classes", f"SELECT 'kind' || o_orderstatus AS class FROM orders GROUP BY o_orderstatus")
def point_classes(spark, sf_dir):
    kinds = m.table(spark, sf_dir, "orders").select("o_orderstatus").distinct()
    classes = kinds.select(F.concat(F.lit("kind"), "o_orderstatus").alias("class")).union(m.table(spark, sf_dir, "customer").select("c_mktsegment").distinct())
    tree = kinds.select(F.concat(F.lit(f"<{BLD}kind"), "o_orderstatus", F.lit(">")).alias("s"), F.lit(SUBCLASS).alias("p"), F.lit(POINT).alias("o"))
    return tags.is_point(classes, tree)


@register("equipment_classes", "SELECT DISTINCT c_mktsegment AS class FROM customer")
def equipment_classes(spark, sf_dir):
    kinds = m.table(spark, sf_dir, "customer").select("c_mktsegment").distinct()
    tree = kinds.select(F.concat(F.lit(f"<{BLD}"), "c_mktsegment", F.lit(">")).alias("s"), F.lit(SUBCLASS).alias("p"), F.lit(EQUIPMENT).alias("o"))
    return tags.is_equipment(kinds.select(F.col("c_mktsegment").alias("class")).union(m.table(spark, sf_dir, "orders").select("o_orderstatus").distinct()), tree)


@register("abbreviations", "SELECT event_id AS id, array_to_string(list_sort([event_id::VARCHAR, CASE event_type WHEN 'click' THEN 'Zone Temperature' WHEN 'view' THEN 'Air Supply' ELSE event_type END]), ' ') AS words FROM events WHERE event_type NOT IN ('click', 'view') UNION ALL SELECT event_id, array_to_string(list_sort(list_append(CASE event_type WHEN 'click' THEN ['Zone', 'Temperature'] ELSE ['Air', 'Supply'] END, event_id::VARCHAR)), ' ') FROM events WHERE event_type IN ('click', 'view')")
def abbreviations(spark, sf_dir):
    short = F.when(F.col("event_type") == "click", "ZN-T".replace("-T", "T")).when(F.col("event_type") == "view", "SA").otherwise(F.col("event_type"))
    names = m.table(spark, sf_dir, "events").select(F.col("event_id").alias("id"), F.concat_ws("-", short, F.col("event_id").cast("string")).alias("name"))
    return tags.abbreviated(names).select("id", F.array_join("tags", " ").alias("words"))


@register("device_sites", f"SELECT '<{DATA}' || event_id || '>' AS s, '{TYPE}' AS p, '<{BLD}Site>' AS o FROM events WHERE event_type = 'signup'")
def device_sites(spark, sf_dir):
    ev = m.table(spark, sf_dir, "events")
    mark = F.lit("m:")
    only = F.create_map(F.lit("id"), F.concat(F.lit("r:"), "event_id"), F.lit("site"), mark)
    both = F.create_map(F.lit("id"), F.concat(F.lit("r:"), "event_id"), F.lit("site"), mark, F.lit("equip"), mark)
    rows = ev.select(F.col("event_id").alias("n"), F.when(F.col("event_type") == "signup", only).otherwise(both).alias("cells"))
    lookup = spark.createDataFrame([(["none"], ["None"])], "tags array<string>, classes array<string>")
    return haystack.infer_entities(haystack.entities_of(rows), lookup, Graph.empty(spark).df, DATA)


_DEV = device_rdf.DEV


@register("model_clean_up", f"SELECT {e('nation', 'n_nationkey')} AS s, '{HAS_LOCATION}' AS p, {e('region', 'n_regionkey')} AS o FROM nation UNION ALL SELECT {C_}, '{iri(BLD + 'isPartOf')}', {e('nation', 'c_nationkey')} FROM customer UNION ALL SELECT {e('nation', 's_nationkey')}, '{HAS_POINT}', {e('supplier', 's_suppkey')} FROM supplier")
def model_clean_up(spark, sf_dir):
    """Customers are parts of nations (their region goes), suppliers points of nations (the part edges go)."""
    cu, na, su = (m.table(spark, sf_dir, x) for x in ("customer", "nation", "supplier"))
    who, nation, point = entity("customer", F.col("c_custkey")), entity("nation", F.col("n_nationkey")), entity("supplier", F.col("s_suppkey"))
    region, own = entity("region", F.col("n_regionkey")), entity("nation", F.col("s_nationkey"))
    data = na.select(nation.alias("s"), F.lit(HAS_LOCATION).alias("p"), region.alias("o")).union(cu.select(who, F.lit(device_rdf.IS_PART_OF), entity("nation", F.col("c_nationkey"))))
    data = data.union(cu.join(na, F.col("c_nationkey") == F.col("n_nationkey")).select(who, F.lit(HAS_LOCATION), region))
    data = data.union(su.select(own, F.lit(HAS_POINT), point)).union(su.select(own, F.lit(device_rdf.HAS_PART), point)).union(su.select(point, F.lit(device_rdf.IS_PART_OF), own))
    return device_rdf.clean_model(data.union(na.select(nation, F.lit(f"<{_DEV}siteRef>"), region)))


_SITE = "urn:tessera:site/"


@register(
    "schedule_pack",
    f"""WITH r AS (SELECT '<{_SITE}VAV_' || c_custkey || '>' AS unit, '<{_SITE}AHU_' || c_nationkey || '>' AS source, '<{_SITE}room_' || c_custkey || '>' AS space, '<{_SITE}room_' || c_custkey || '_zone>' AS area, '<{_SITE}floor_' || c_nationkey || '>' AS floor, '<{_SITE}VAV_' || c_custkey || '-CO2>' AS point, c_mktsegment = 'BUILDING' AS co2 FROM customer)
SELECT unit AS s, '{TYPE}' AS p, '<{BLD}' || k || '>' AS o FROM r, (VALUES ('VAV'), ('Equipment')) v(k) UNION SELECT source, '{TYPE}', '<{BLD}' || k || '>' FROM r, (VALUES ('AHU'), ('Equipment')) v(k) UNION SELECT space, '{TYPE}', '<{BLD}' || k || '>' FROM r, (VALUES ('Space'), ('Room')) v(k)
UNION SELECT area, '{TYPE}', '<{BLD}HVAC_Zone>' FROM r UNION SELECT area, '{HAS_LOCATION}', floor FROM r UNION SELECT area, '<{BLD}hasPart>', space FROM r UNION SELECT floor, '<{BLD}hasPart>', space FROM r UNION SELECT unit, '<{BLD}feeds>', area FROM r UNION SELECT source, '<{BLD}feeds>', unit FROM r
UNION SELECT floor, '{TYPE}', '<{BLD}Floor>' FROM r UNION SELECT '<{_SITE}main>', '<{BLD}hasPart>', floor FROM r UNION SELECT * FROM (VALUES ('<{_SITE}main>', '{TYPE}', '<{BLD}Building>'), ('<{_SITE}here>', '{TYPE}', '<{BLD}Site>'), ('<{_SITE}here>', '{iri(BLD + "isLocationOf")}', '<{_SITE}main>')) v(a, b, c)
UNION SELECT unit, '{HAS_POINT}', point FROM r WHERE co2 UNION SELECT point, '{TYPE}', '<{BLD}CO2_Sensor>' FROM r WHERE co2""",
)
def schedule_pack(spark, sf_dir):
    """Customers as terminal units in rooms, nations as air handlers and floors, through the schedule's rule pack."""
    t = m.table(spark, sf_dir, "customer")
    text = lambda x, k: F.concat(F.lit(x), F.col(k).cast("string"))
    rows = t.select(F.lit("here").alias("site"), F.lit("main").alias("building"), text("floor ", "c_nationkey").alias("floor"), text("room ", "c_custkey").alias("space"), text("VAV ", "c_custkey").alias("device"), text("AHU ", "c_nationkey").alias("served by"), F.when(F.col("c_mktsegment") == "BUILDING", "CO2 box").otherwise("plain box").alias("controller"))
    return etl.Conversion(spark, device_rdf.SCHEDULE_PACK).run(rows, site=("site", _SITE))


@register("conversion_prefixes", f"SELECT '<urn:own/' || s_name || '>' AS s, '{TYPE}' AS p, '<{BLD}Supplier>' AS o FROM supplier")
def conversion_prefixes(spark, sf_dir):
    config = {"namespace_prefixes": {"b": BLD}, "operations": [{"data": "bldg:{s_name} a b:Supplier ."}]}
    return etl.Conversion(spark, config).run(m.table(spark, sf_dir, "supplier"), building=("own", "urn:own/"))


@register("without_namespaces", f"SELECT * FROM ({_BOTH}) WHERE p <> '{prop('inNation')}'")
def without_namespaces(spark, sf_dir):
    return etl.without_namespaces(_halves(spark, sf_dir)[1].df, [DATA + "nation/"])


@register("classes_of_tag", "SELECT DISTINCT '<' || '" + DATA + "class/' || p_type || '>' AS class FROM part WHERE starts_with('ME-SMALL-1', 'ME-' || p_type)")
def classes_of_tag(spark, sf_dir):
    kinds = m.table(spark, sf_dir, "part").select("p_type").distinct()
    node, klass = F.concat(F.lit("_:s"), "p_type"), m.part_class("p_type")
    edge = lambda s_, p, o: kinds.select(s_.alias("s"), F.lit(p).alias("p"), (F.lit(o) if isinstance(o, str) else o).alias("o"))
    inner = F.concat(F.lit("_:p"), "p_type")
    shapes = edge(node, TYPE, shacl.sh("NodeShape")).union(edge(node, shacl.sh("targetClass"), klass)).union(edge(node, shacl.sh("property"), inner)).union(edge(inner, shacl.sh("path"), vbis.TAG_PROPERTY)).union(edge(inner, shacl.sh("pattern"), terms.to_literal(F.concat(F.lit("ME-"), "p_type", F.lit(".*")))))
    return vbis.classes_of_tag(shapes, "ME-SMALL-1")


@register("class_objects", f"SELECT {C_} AS name, '<{DATA}kind/' || c_mktsegment || '>' AS type, string_agg(o_orderkey::VARCHAR, ' ' ORDER BY o_orderkey::VARCHAR) AS points FROM customer LEFT JOIN orders ON o_custkey = c_custkey GROUP BY c_custkey, c_mktsegment")
def class_objects(spark, sf_dir):
    from .queries import _site

    return relational.objects_of(_site(spark, sf_dir), EQUIPMENT).select("name", "type", F.array_join("points", " ").alias("points"))


