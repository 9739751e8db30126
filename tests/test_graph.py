"""Graphs, SPARQL, readers and writers."""

import io
import json
import random
import urllib.request

import pytest

from tessera import cli, web
from tessera.functions import terms
from tessera.graph import Graph, GraphCollection
from tessera.namespaces import BLD, TYPE
from tessera.operators.closure import reach, reachable, transitive
from tessera.plans.parser import Parser
from tessera.results import to_json
from tessera.sources import rdf

DOC = """@prefix : <urn:x/> .
:a a :T ; :n 3 , 4.5 , -2 ; :l (1 2 3) ; :label "Hut"@en , 'it\\'s' , \"\"\"two
lines "quoted" \\\\ back\"\"\" .
:b :knows :a , [ :knows :c ] . :c :knows :d ; :flag true . :d :knows :b .
"""
P = "PREFIX : <urn:x/> "


@pytest.fixture(scope="module")
def g(spark):
    return Graph.parse(spark, DOC).cut()


def x(name):
    return f"<urn:x/{name}>"


def solve(g, text):
    return sorted((tuple(r) for r in g.query(P + text).collect()), key=repr)


@pytest.mark.parametrize("format", ["turtle", "nt", "nquads", "xml", "trig", "trix"])
def test_round_trips(spark, g, format):
    rows = [("", *r) for r in g.rows()]
    again, _ = rdf.parse(rdf.serialize(rows, format), format)
    assert len(set(again)) == len(rows)
    ground = lambda xs: sorted(r[1:] for r in xs if not any(t.startswith("_:") for t in r))
    assert ground(again) == ground(rows)


def test_distributed_lines(spark, g, tmp_path):
    g.serialize("nt", str(tmp_path / "x.nt"))
    assert sorted(Graph(rdf.read_lines(spark, str(tmp_path / "x.nt"))).rows()) == sorted(g.rows())
    g.save(str(tmp_path / "p"))
    assert sorted(Graph.open(spark, str(tmp_path / "p")).rows()) == sorted(g.rows())


def test_formats_are_tried_in_turn(spark, g):
    xml = g.serialize("xml")
    assert len(Graph.empty(spark).load_file(source=io.StringIO(xml))) == len(g)
    with pytest.raises(ValueError):
        rdf.parse_any("this is { not RDF")


def test_nested_add(spark):
    g = Graph.empty(spark).add((x("A"), x("area"), [(x("value"), 100), (x("unit"), x("M3"))]))
    assert len(g) == 3
    assert solve(g, "SELECT ?v ?u WHERE { :A :area/:value ?v ; :area/:unit ?u }") == [(terms.literal(100), x("M3"))]


def test_algebra(spark, g):
    other = Graph.from_triples(spark, [(x("a"), TYPE, x("T")), (x("z"), TYPE, x("T"))])
    assert len(g + other) == len(g) + 1 and len(g - other) == len(g) - 1 and len(g * other) == 1
    assert (x("a"), TYPE, x("T")) in g and (x("z"), None, None) not in g
    assert g.remove(None, x("knows")).match(None, x("knows")).count() == 0
    assert len(g.skolemize().deskolemize() - g) == 0


def test_collections(spark, g):
    c = GraphCollection.empty(spark).load_graph(graph=g, name=x("g1")).load_graph(graph=Graph.building(spark))
    assert {r[0] for r in c.names().collect()} == {x("g1"), "<urn:tessera:building>"}
    assert c.subset([x("g1")]).names().count() == 1 and c.remove_graph(x("g1")).names().count() == 1
    assert len(c.graph(x("g1"))) == len(g) and len(c.union()) == len(g) + len(Graph.building(spark))
    got = c.query(P + "SELECT ?g WHERE { GRAPH ?g { :c :knows ?o } }").collect()
    assert [r["g"] for r in got] == [x("g1")]
    c = c.update(P + "INSERT DATA { GRAPH :g2 { :p :q :r } } ; DELETE WHERE { GRAPH :g1 { ?s :knows ?o } } ; CLEAR GRAPH <urn:tessera:building>")
    assert {r[0] for r in c.names().collect()} == {x("g1"), x("g2")}
    assert c.graph(x("g1")).match(None, x("knows")).count() == 0


def test_queries(g):
    assert solve(g, "SELECT ?x WHERE { ?x :knows/:knows :d }") == [("_:" + r[0][2:],) for r in solve(g, "SELECT ?x WHERE { ?x :knows :c }")]
    assert solve(g, "SELECT ?v WHERE { :a :l/rdf:rest*/rdf:first ?v } ORDER BY ?v") == [(terms.literal(k),) for k in (1, 2, 3)]
    assert solve(g, "SELECT (SUM(?v) AS ?t) (COUNT(*) AS ?c) WHERE { :a :n ?v }") == [('"5.5"^^<http://www.w3.org/2001/XMLSchema#decimal>', terms.literal(3))]
    assert solve(g, "SELECT ?t WHERE { :a :label ?t FILTER(LANGMATCHES(LANG(?t), 'EN')) }") == [('"Hut"@en',)]
    assert solve(g, 'SELECT ?s WHERE { :a :label ?t BIND(STRLEN(?t) AS ?n) FILTER(CONTAINS(?t, "quoted")) BIND(STR(?n) AS ?s) }') == [('"25"',)]
    assert solve(g, "SELECT ?x WHERE { ?x :flag ?f FILTER(?f) }") == [(x("c"),)]
    assert solve(g, "SELECT ?X ?x WHERE { ?X :knows ?x . ?x a :T }") == [(x("b"), x("a"))]
    assert solve(g, "SELECT ?x WHERE { { SELECT DISTINCT ?x WHERE { ?x :knows ?y } } FILTER NOT EXISTS { ?x (:knows|^:knows)/a :T } FILTER(ISIRI(?x)) }") == [(x("c"),), (x("d"),)]
    assert solve(g, "SELECT ?s ?o WHERE { ?s !(:knows|:n|:l|:label|a|rdf:first|rdf:rest) ?o }") == [(x("c"), terms.literal(True))]


def test_unbound_and_errors(g):
    got = solve(g, "SELECT ?a ?b WHERE { VALUES (?a ?b) { (:a UNDEF) (UNDEF :b) } OPTIONAL { ?a :none ?b } }")
    assert got == sorted([(x("a"), None), (None, x("b"))], key=repr)
    assert solve(g, "SELECT ?v WHERE { :a :label ?v FILTER(?v + 1 > 0) }") == []
    assert len(solve(g, "SELECT ?v WHERE { :a :label ?v FILTER(?v + 1 > 0 || true) }")) == 3
    for bad in ("SELECT ?x { ?x :p", "SELECT ?x WHERE { ?x nope:y ?z }", "SELECT ?x WHERE { ?x :p ?y } EXTRA", "SELECT ?x WHERE { ?x :p ?y BIND(1 AS ?x) }"):
        with pytest.raises(ValueError):
            g.query(bad)


def test_construct_and_update(g):
    made = g.construct(P + "CONSTRUCT { ?a :friend [ :of ?b ] } WHERE { ?a :knows ?b FILTER(ISIRI(?b) && ISIRI(?a)) }")
    assert len(made) == 6  # three pairs, a blank node each
    swapped = g.update(P + "DELETE { ?s :knows ?o } INSERT { ?o :knownBy ?s } WHERE { ?s :knows ?o }")
    assert len(swapped) == len(g) and swapped.match(None, x("knows")).count() == 0


def test_terms():
    assert terms.lexical(terms.literal('a"b\\c\nd')) == 'a"b\\c\nd'
    assert terms.literal(True) == '"true"^^<http://www.w3.org/2001/XMLSchema#boolean>'
    assert Parser("SELECT ?x WHERE { ?x a 'v'@EN }").query().where[0][1][0][2] == ("term", '"v"@en')


@pytest.mark.parametrize("seed", range(3))
def test_closure_equals_search(spark, seed):
    r = random.Random(seed)
    edges = list({(f"n{r.randrange(25)}", f"n{r.randrange(25)}") for _ in range(40)})
    df = spark.createDataFrame(edges, "s string, o string")
    want = sorted(reach(edges))
    assert sorted(tuple(x) for x in transitive(df, driver_edges=0).collect()) == want == sorted(tuple(x) for x in transitive(df).collect())
    seeds = spark.createDataFrame([("n1",)], "s string")
    for limit in (0, 100):
        assert sorted(tuple(x) for x in reachable(df, seeds, driver_edges=limit).collect()) == [p for p in want if p[0] == "n1"]


def test_json_results(g):
    doc = json.loads(to_json(g.query(P + "SELECT ?v ?w WHERE { :a :label ?v FILTER(LANG(?v) = 'en') OPTIONAL { :a :none ?w } }")))
    assert doc["results"]["bindings"] == [{"v": {"type": "literal", "value": "Hut", "xml:lang": "en"}}]
    assert json.loads(to_json(g.query(P + "ASK { :a :none ?x }"))) == {"head": {}, "boolean": False}


def test_web(spark, g):
    import threading

    server = web.server(g, "127.0.0.1:0", ignore=("sh",))
    threading.Thread(target=server.serve_forever, daemon=True).start()
    base = f"http://127.0.0.1:{server.server_address[1]}"
    get = lambda path, **k: urllib.request.urlopen(urllib.request.Request(base + path, **k)).read().decode()
    assert "<form" in get("/") and "sh" not in json.loads(get("/bindings"))
    assert json.loads(get("/query", data=(P + "ASK { :a a :T }").encode(), headers={"Content-Type": "application/sparql-query"}))["boolean"]
    assert json.loads(get("/query?query=" + urllib.parse.quote(P + "ASK { :a a :U }")))["boolean"] is False
    assert json.loads(get("/reason/rdfs"))["triples"] > len(g)
    server.shutdown()


def test_extensions(spark):
    assert Graph.extensions() == ["shapes"]
    assert len(Graph.empty(spark).load_extension("shapes")) > 5


def test_cli(spark, tmp_path, capsys):
    data, sheet, config = tmp_path / "d.ttl", tmp_path / "s.csv", tmp_path / "c.yml"
    data.write_text(f"@prefix b: <{BLD}> . b:x b:hasPoint b:y . b:y a b:Point .")
    shapes = tmp_path / "shapes.ttl"
    shapes.write_text(f"@prefix b: <{BLD}> . b:S a <http://www.w3.org/ns/shacl#NodeShape> ; <http://www.w3.org/ns/shacl#targetSubjectsOf> b:hasPoint ; <http://www.w3.org/ns/shacl#class> b:Equipment .")
    assert cli.main(["validate", str(data), "-s", str(shapes), "-i", "none", "-m"]) == 255 and "Conforms: False" in capsys.readouterr().out
    assert cli.main(["validate", str(data), "-s", str(shapes)]) == 0  # the vocabulary's domain makes b:x equipment
    sheet.write_text("name , kind\nA , VAV\nB , Fan\n")
    config.write_text("operations:\n  - data: 'bldg:{name} a bld:{kind} .'\n")
    assert cli.main(["convert", str(sheet), "--input-type", "csv", "--config", str(config), "--output", str(tmp_path / "o.ttl"), "--building-prefix", "h", "--building-namespace", "urn:h/"]) == 0
    assert "h:A a bld:VAV" in (tmp_path / "o.ttl").read_text()
