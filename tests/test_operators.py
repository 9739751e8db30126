"""Inference, shapes, tags, device models, conversion, versions and merging on small models."""

import pytest
from pyspark.sql import functions as F

from tessera.functions.terms import literal
from tessera.graph import Graph
from tessera.namespaces import BLD, EQUIPMENT, OWL, RDFS, SUBCLASS, TYPE, iri
from tessera.operators import closure, etl, haystack, merge, reason, relational, shacl, tags, versioned
from tessera.sources.tables import read_table
from tessera.streaming import changes

B = f"@prefix b: <{BLD}> . @prefix tag: <urn:tessera:tag#> . @prefix : <urn:x/> .\n"


@pytest.fixture(scope="module")
def onto(spark):
    return Graph.building(spark).cut()


def b(name):
    return f"<{BLD}{name}>"


def x(name):
    return f"<urn:x/{name}>"


def types(g, s):
    return {r["o"] for r in g.match(s, TYPE).collect()}


# inference


def test_most_specific(onto):
    assert onto.most_specific([b("Sensor"), b("Temperature_Sensor"), b("Air_Temperature_Sensor")]) == [b("Air_Temperature_Sensor")]
    assert onto.most_specific([b("AHU"), b("Equipment")]) == [b("AHU")]
    assert onto.most_specific([b("AHU"), b("Air_Handler_Unit")]) == [b("AHU"), b("Air_Handler_Unit")]
    assert onto.most_specific([b("Fan"), b("Air_Flow_Sensor")]) == [b("Fan"), b("Air_Flow_Sensor")]


def test_rdfs_types(spark, onto):
    out = (Graph.parse(spark, B + ":s a b:Air_Temperature_Sensor .") + onto).expand("rdfs")
    assert types(out, x("s")) == {b("Air_Temperature_Sensor"), b("Temperature_Sensor"), b("Sensor"), b("Point"), iri(RDFS + "Resource")}


def test_owl_inverse_and_domain(spark, onto):
    out = (Graph.parse(spark, B + ":p b:isPointOf :e . :a b:feeds :c .") + onto).expand("owlrl")
    assert (x("e"), b("hasPoint"), x("p")) in out and (x("c"), b("isFedBy"), x("a")) in out
    assert {b("Equipment")} <= types(out, x("e")) and {b("Point")} <= types(out, x("p"))
    assert not any(t.startswith("_:") or t == iri(OWL + "Thing") for t in types(out, x("e")))


def test_owl_features(spark):
    doc = B + """@prefix owl: <http://www.w3.org/2002/07/owl#> .
:near a owl:SymmetricProperty , owl:TransitiveProperty . :a :near :b . :b :near :c .
:id a owl:InverseFunctionalProperty . :u :id "7" . :v :id "7" . :u :says :w . :boss a owl:FunctionalProperty . :k :boss :m , :n . :m :age 3 .
:Both owl:intersectionOf (:P :Q) . :i a :P , :Q . :j a :P .
:Any owl:unionOf (:P :R) . :r a :R .
:Red owl:equivalentClass [ owl:onProperty :color ; owl:hasValue :red ] . :t :color :red . :w2 a :Red .
:Parent owl:equivalentClass [ owl:onProperty :child ; owl:someValuesFrom :P ] . :par :child :i .
[] owl:onProperty :only ; owl:allValuesFrom :Z ; <http://www.w3.org/2000/01/rdf-schema#subClassOf> :Y . :Box <http://www.w3.org/2000/01/rdf-schema#subClassOf> [ owl:onProperty :only ; owl:allValuesFrom :Z ] . :box a :Box ; :only :thing .
:uncle owl:propertyChainAxiom (:parent :brother) . :q1 :parent :q2 . :q2 :brother :q3 .
:P owl:disjointWith :Bad . :i a :Bad . :One owl:oneOf (:o1 :o2) .
:Car owl:hasKey (:plate) . :c1 a :Car ; :plate "X" . :c2 a :Car ; :plate "X" ."""
    out = Graph.parse(spark, doc).expand("owlrl")
    rows = set(out.rows())
    same = iri(OWL + "sameAs")
    for t in [("a", "near", "c"), ("c", "near", "a"), ("v", "says", "w"), ("t", "color", "red"), ("w2", "color", "red"), ("q1", "uncle", "q3")]:
        assert tuple(map(x, t)) in rows
    for s, c in [("i", "Both"), ("i", "Any"), ("r", "Any"), ("t", "Red"), ("par", "Parent"), ("thing", "Z"), ("o1", "One")]:
        assert (x(s), TYPE, x(c)) in rows
    assert (x("j"), TYPE, x("Both")) not in rows
    assert {(x("u"), same, x("v")), (x("m"), same, x("n")), (x("c1"), same, x("c2"))} <= rows
    assert (x("n"), x("age"), literal(3)) in rows and not [r for r in rows if r[1] == same and r[0] == r[2]]
    assert ("cax-dw", x("i")) in {(r["rule"], r["s"]) for r in reason.inconsistencies(out.df).collect()}


def test_profiles(spark, onto):
    g = Graph.parse(spark, B + ":s b:hasTag tag:Air , tag:Flow , tag:Sensor , tag:Point . :m b:hasTag tag:Max , tag:Air , tag:Flow , tag:Setpoint , tag:Limit , tag:Parameter , tag:Point .") + onto
    out = g.expand("tags+rdfs")
    assert b("Air_Flow_Sensor") in types(out, x("s")) and b("Max_Air_Flow_Setpoint_Limit") in types(out, x("m"))
    with pytest.raises(ValueError):
        g.expand("nonsense")


# shapes

GOOD = ":ahu a b:AHU ; b:hasPoint :t ; b:hasPart :vav ; b:hasLocation :r . :t a b:Temperature_Sensor . :vav a b:VAV . :r a b:Room ."


def test_good_and_bad_building(spark, onto):
    shapes = Graph.empty(spark).load_extension("shapes") + onto
    ok, report, _ = Graph.parse(spark, B + GOOD).validate(shapes)
    assert ok and report.count() == 0
    ok, report, text = Graph.parse(spark, B + GOOD + " :t b:hasPoint :vav . :ahu b:hasLocation :vav .").validate(shapes)
    got = {(r["focus_node"], r["component"], r["value"]) for r in report.collect()}
    assert not ok and got == {(x("t"), "class", x("t")), (x("t"), "class", x("vav")), (x("ahu"), "class", x("vav"))} and "only equipment has points" in text
    assert shacl.report_graph(report, ok).where(F.col("p").contains("focusNode")).count() == 3


def check(spark, shape, data):
    report = shacl.violations(Graph.parse(spark, B + data).df, Graph.parse(spark, B + shape).df)
    return sorted((r["focus_node"], r["component"], r["value"]) for r in report.collect())


def test_constraints(spark):
    head = "@prefix sh: <http://www.w3.org/ns/shacl#> . :S a sh:NodeShape ; sh:targetNode :a ; sh:property [ sh:path :p ; %s ] ."
    for constraint, data, bad in [
        ("sh:nodeKind sh:IRI", ":a :p 1 , :b .", [(x("a"), "nodeKind", literal(1))]),
        ("sh:uniqueLang true", ':a :p "x"@en , "y"@en .', [(x("a"), "uniqueLang", None)]),
        ('sh:languageIn ("en" "de")', ':a :p "x"@en-gb , "y"@fr .', [(x("a"), "languageIn", '"y"@fr')]),
        ("sh:equals :q", ":a :p :b ; :q :c .", [(x("a"), "equals", x("b")), (x("a"), "equals", x("c"))]),
        ("sh:disjoint :q", ":a :p :b ; :q :b .", [(x("a"), "disjoint", x("b"))]),
        ("sh:lessThan :q", ":a :p 5 ; :q 4 , 9 .", [(x("a"), "lessThan", literal(5))]),
        ("sh:datatype xsd:integer", ":a :p 5 , 'x' .", [(x("a"), "datatype", '"x"')]),
        ("sh:minLength 2", ":a :p 'x' , 'xx' .", [(x("a"), "minLength", '"x"')]),
        ("sh:minCount 1", ":a :q 1 .", [(x("a"), "minCount", None)]),
        ("sh:node [ sh:property [ sh:path :k ; sh:minCount 1 ] ]", ":a :p :b , :c . :b :k 1 .", [(x("a"), "node", x("c"))]),
    ]:
        assert check(spark, head % constraint, data) == sorted(bad, key=str), constraint


def test_paths_deactivated_and_disjoint_siblings(spark):
    shape = """@prefix sh: <http://www.w3.org/ns/shacl#> .
:S a sh:NodeShape ; sh:targetClass :T ; sh:property [ sh:path [ sh:zeroOrMorePath :up ] ; sh:maxCount 2 ] , [ sh:path ( :up [ sh:inversePath :down ] ) ; sh:minCount 1 ; sh:deactivated true ] .
:H a sh:NodeShape ; sh:targetClass :Hand ; sh:property [ sh:path :digit ; sh:qualifiedValueShape [ sh:class :Thumb ] ; sh:qualifiedMinCount 1 ; sh:qualifiedValueShapesDisjoint true ] , [ sh:path :digit ; sh:qualifiedValueShape [ sh:class :Finger ] ; sh:qualifiedMinCount 2 ; sh:qualifiedValueShapesDisjoint true ] ."""
    data = ":a a :T ; :up :b . :b :up :c . :d a :T ; :up :c . :h a :Hand ; :digit :t , :f , :both . :t a :Thumb . :f a :Finger . :both a :Thumb , :Finger ."
    assert check(spark, shape, data) == [(x("a"), "maxCount", None), (x("h"), "qualifiedMinCount", None)]


def test_rules_to_fixpoint(spark):
    shapes = Graph.parse(spark, B + """@prefix sh: <http://www.w3.org/ns/shacl#> .
:S a sh:NodeShape ; sh:targetSubjectsOf :next ; sh:rule [ a sh:TripleRule ; sh:subject sh:this ; sh:predicate :later ; sh:object [ sh:path :next ] ] , [ a sh:TripleRule ; sh:subject sh:this ; sh:predicate :later ; sh:object [ sh:path ( :later :later ) ] ; sh:order 1 ] , [ a sh:TripleRule ; sh:subject sh:this ; sh:predicate :no ; sh:object sh:this ; sh:deactivated true ] .""")
    out = shacl.infer(Graph.parse(spark, B + ":a :next :b . :b :next :c . :c :next :d ."), shapes)
    assert out.match(None, x("later")).count() == 6 and out.match(None, x("no")).count() == 0


# tags and device models


def test_tag_lookup(spark, onto):
    lookup = tags.lookup_table(onto.df)
    sets = spark.createDataFrame([(1, ["Air", "Flow", "Sensor", "Point"]), (2, ["Air", "Flow", "Sensor", "Equip"]), (3, ["Air", "Flow", "Sensor"]), (4, ["Zzz"])], "id bigint, tags array<string>")
    assert [tuple(r) for r in tags.exact(sets, lookup).select("id", "class").collect()] == [(1, "Air_Flow_Sensor")]
    likely = {r["id"]: (r["classes"], r["leftover"]) for r in tags.most_likely(sets, lookup).collect()}
    assert likely == {1: (["Air_Flow_Sensor"], []), 2: (["Air_Flow_Sensor"], ["Equip"]), 3: (["Air_Flow_Sensor"], []), 4: ([], ["Zzz"])}
    near = {(r["id"], c) for r in tags.approximate(sets, lookup).collect() for c in r["classes"]}
    assert (3, "Air_Flow_Sensor") in near and (4, "Sensor") not in near


def test_device_model(spark, onto):
    model = {"rows": [
        {"id": "r:site1 \"Site\"", "site": "m:"},
        {"id": "r:ahu1", "equip": "m:", "ahu": "m:", "hisMode": "m:"},
        {"id": "r:p1 \"Flow\"", "point": "m:", "sensor": "m:", "air": "m:", "flow": "m:", "equipRef": "r:ahu1"},
        {"id": "r:p2", "point": "m:", "sensor": "m:", "air": "m:", "temp": "m:", "tz": "New York"},
    ]}
    out = Graph(haystack.infer_model(spark, model, onto, "urn:x/"))
    assert types(out, x("site1")) == {b("Site")} and types(out, x("ahu1_equip")) == {b("AHU")}
    assert types(out, x("p1_point")) == {b("Air_Flow_Sensor")} and types(out, x("p2_point")) == {b("Air_Temperature_Sensor")}
    assert (x("ahu1_equip"), b("hasPoint"), x("p1_point")) in out


# conversion

TSV = "unit\tprobe\tgoal\treheat\tn_probes\tn_goals\n U1 \t U1_probe \t U1_goal\tfalse\t4\t3\nU2\tU2_probe\tU2_goal \ttrue\t5\t3\n"
CONFIG = {"operations": [
    {"data": "bldg:{unit} a bld:VAV ; bld:hasPoint bldg:{probe} , bldg:{goal} .\nbldg:{probe} a bld:Temperature_Sensor . bldg:{goal} a bld:Setpoint ."},
    {"conditions": ["'{reheat}'"], "data": "bldg:{unit} a bld:RVAV ."},
]}


@pytest.fixture()
def sheet(spark, tmp_path):
    (tmp_path / "s.tsv").write_text(TSV)
    return read_table(spark, str(tmp_path / "s.tsv"), "\t")


def test_convert_rows(spark, sheet):
    assert etl.convert_table(sheet, CONFIG).count() == 11
    macro = "{% macro many(s, n, num, t) %}{% for i in range(num) %} bldg:{{ n }}_{{ i }} a {{ t }} . bldg:{{ s }} bld:hasPoint bldg:{{ n }}_{{ i }} . {% endfor %}{% endmacro %}"
    calls = [{"template": "{{ many(value['unit'], value['%s'], value['n_%ss'], \"bld:Point\") }}" % (k, k)} for k in ("probe", "goal")]
    loop = {"macros": [macro], "operations": [{"data": "bldg:{unit}_first a bld:VAV ."}, CONFIG["operations"][1], *calls]}
    assert etl.convert_table(sheet, loop).count() == 33


def test_conditions(spark, sheet):
    def hits(text):
        return etl.convert_table(sheet, {"operations": [{"conditions": [text], "data": "bldg:{unit} a bld:X ."}]}).count()

    tries = {"{n_probes} > 4": 1, "{n_probes} + {n_goals} == 7": 1, "'{unit}' in ('U1', 'C')": 1, "not '{unit}'.lower().startswith('u1')": 1, "'{probe}'[-2:] == 'be' and {n_probes} < 5": 1, "'{missing}' == ''": 0, "len('{unit}') == 2": 2, "{reheat}": 1}
    assert {t: hits(t) for t in tries} == tries
    with pytest.raises(ValueError):
        hits("__import__('os').getcwd()")


def test_convert_graph(spark):
    config = {"operations": [{"query": "DELETE {{ ?v a <urn:old> }} INSERT {{ ?v a bld:VAV }} WHERE {{ ?v a <urn:old> }}"}, {"query": "nonsense"}]}
    job = etl.Conversion(spark, config)
    out = job.run(Graph.parse(spark, B + ":v a <urn:old> .").df)
    assert [tuple(r) for r in out.collect()] == [(x("v"), TYPE, b("VAV"))] and len(job.failed) == 1


def test_minify_then_expand(spark, onto):
    full = (Graph.parse(spark, B + ":s a b:Air_Temperature_Sensor . :a a b:AHU , b:Air_Handler_Unit .") + onto).expand("rdfs")
    small = Graph(etl.minify(full.df, onto.df))
    assert types(small, x("s")) & {b("Sensor"), b("Point")} == set()
    assert {b("AHU"), b("Air_Handler_Unit")} <= types(small, x("a"))
    assert types((small + onto).expand("rdfs"), x("s")) == types(full, x("s"))


# versions


def test_versions(spark, tmp_path):
    v = versioned.VersionedGraphs(spark, str(tmp_path / "v"))
    seen = []
    v.add_postcommit_hook(lambda c: seen.append(c.df.count()))
    with pytest.raises(ValueError):
        v.undo()
    with v.new_changeset("urn:x/g", ts="2020-01-01T00:00:00") as cs:
        cs.add((x("a"), TYPE, x("T")))
    with v.new_changeset("urn:x/g", ts="2020-01-02T00:00:00") as cs:
        cs.add((x("b"), TYPE, x("T")), (x("a"), TYPE, x("T")))
    assert len(v) == 2 and seen == [1, 2]
    assert len(v.graph_at("2020-01-01T12:00:00")) == 1 and len(v.graph_at("2019-01-01")) == 0 and len(v.graph_at()) == 2
    assert v.versions().count() == 2 and v.version_before("2020-01-02T00:00:00").first()["timestamp"] == "2020-01-01T00:00:00"
    v.undo()
    assert len(v) == 1
    v.redo()
    assert len(v) == 2 and len(v.graph_at("2020-01-01T12:00:00")) == 1
    with pytest.raises(ValueError):
        v.redo()
    with v.new_changeset("urn:x/g", ts="2020-01-03T00:00:00") as cs:
        cs.remove((x("a"), TYPE, x("T")))
    assert len(v) == 1 and len(v.graph_at("2020-01-02T00:00:00")) == 2
    with pytest.raises(RuntimeError):
        with v.new_changeset("urn:x/g") as cs:
            cs.add((x("z"), TYPE, x("T")))
            raise RuntimeError
    assert len(v) == 1


def test_stream_of_changes(spark, tmp_path):
    v = versioned.VersionedGraphs(spark, str(tmp_path / "v"))
    with v.new_changeset("urn:x/g", ts="2020-01-01T00:00:00") as cs:
        cs.add((x("a"), x("in"), x("b")))
    rules = spark.createDataFrame([(x("in"), "swap", x("has"))], "p string, what string, q string")
    run = lambda: changes.each_commit(changes.changes(spark, str(tmp_path / "v/log")), changes.derive(rules, str(tmp_path / "out")), str(tmp_path / "cp")).awaitTermination()
    run()
    with v.new_changeset("urn:x/g", ts="2020-01-01T00:20:00") as cs:
        cs.add((x("c"), x("in"), x("b")))
    run()
    assert {(r["s"], r["o"]) for r in spark.read.parquet(str(tmp_path / "out")).collect()} == {(x("b"), x("a")), (x("b"), x("c"))}
    q = changes.activity(changes.changes(spark, str(tmp_path / "v/log"))).writeStream.format("memory").queryName("activity").outputMode("complete").trigger(availableNow=True).start()
    q.awaitTermination()
    assert spark.table("activity").agg(F.sum("insertions")).first()[0] == 2 and spark.table("activity").count() == 2


# merging


def test_link_goes_on_until_no_pair_is_left(spark):
    side = lambda names: spark.createDataFrame([(f"<urn:x/{c}>", ["t"], ["same"]) for c in names], "entity string, types array<string>, labels array<string>")
    got = sorted((r["left"], r["right"]) for r in merge.link(side("abcdefgh"), side("mnopqrst"), threshold=0.3, most_rounds=2).collect())
    assert got == [(f"<urn:x/{a}>", f"<urn:x/{b}>") for a, b in zip("abcdefgh", "mnopqrst")]  # all tie: in order of names


def test_merge(spark):
    one = Graph.parse(spark, B + '@prefix rdfs: <http://www.w3.org/2000/01/rdf-schema#> . :vav_1 a b:VAV ; rdfs:label "VAV 1" . :vav_2 a b:VAV ; rdfs:label "VAV 2" . :fan a b:Fan .')
    two = Graph.parse(spark, B + '@prefix rdfs: <http://www.w3.org/2000/01/rdf-schema#> . :vav_1x a b:VAV ; rdfs:label "VAV 1x" ; b:feeds :q . :zzzzzz a b:VAV ; rdfs:label "other" . :blower a b:Fan .')
    out = merge.merge_graphs(one, two, "urn:x/", threshold=0.8)
    assert (x("vav_1"), b("feeds"), x("q")) in out and (x("zzzzzz"), TYPE, b("VAV")) in out and (x("blower"), None, None) not in out
    assert (x("b2"), None, None) in merge.unify_entities(one, x("b2"), x("fan"))


def test_projection(spark, onto):
    g = (Graph.parse(spark, B + GOOD) + onto).df
    t = relational.tables(g)
    assert [tuple(r) for r in t["point"].collect()] == [(x("t"), b("Temperature_Sensor"), x("ahu"))]
    assert {(r["name"], r["location"]) for r in t["equipment"].collect()} == {(x("ahu"), x("r")), (x("vav"), None)}
    with pytest.raises(ValueError):
        relational.tables(g.union(Graph.parse(spark, B + ":r2 a b:Room ; b:isLocationOf :ahu .").df), strict=True)
    assert {r["child"] for r in relational.class_tree(onto.df, EQUIPMENT).collect()} >= {b("VAV"), b("RVAV")}
    assert onto.match(None, SUBCLASS).count() > 5


def test_alignment_reverse_lookup(spark):
    from tessera.operators import vbis

    alignment = Graph.parse(spark, B + """@prefix sh: <http://www.w3.org/ns/shacl#> .
:s1 a sh:NodeShape ; sh:targetClass b:Fan ; sh:property [ sh:path b:hasAlignmentTag ; sh:pattern "ME-Fa.*" ] .
:s2 a sh:NodeShape ; sh:targetClass b:VAV ; sh:or ( [ sh:class b:X ] [ sh:property [ sh:path b:hasAlignmentTag ; sh:pattern "ME-V.*|ME-Fa-T" ] ] ) .""").df
    find = lambda tag: {r[0] for r in vbis.classes_of_tag(alignment, tag).collect()}
    assert find("ME-Fa-1") == {b("Fan")} and find("ME-Fa-T") == {b("Fan"), b("VAV")} and find("EL") == set()
    with pytest.raises(ValueError):
        vbis.classes_of_tag(alignment, "ME-*")


def test_device_model_in_rdf(spark, onto):
    data = Graph.parse(spark, B + ":p1 a :sensorPoint ; :tagged :sensor , :point , :air , :flow , :hisRef . :sensorPoint :is :marked . :other a :else .").df
    found = haystack.rdf_entities(data, x("marked"), x("is"), x("tagged")).where(F.col("id") == x("p1"))
    assert found.first()["tags"] == ["air", "flow", "point", "sensor"]
    named = found.withColumn("id", F.lit("p1"))
    out = Graph(haystack.infer_entities(named, tags.lookup_table(onto.df), onto.df, "urn:x/"))
    assert types(out, x("p1_point")) == {b("Air_Flow_Sensor")}


def test_clean_up_and_headers(spark):
    from tessera.sources.tables import rows_after_header

    g = Graph.parse(spark, B + ":a <urn:ph/x> :b . :a b:p :c .").df
    assert etl.without_namespaces(g, ["urn:ph/"]).count() == 1
    rows = spark.createDataFrame([(0, "Name", "A/B"), (1, "title", None), (2, "Name", "A/B"), (3, "x", "1/2"), (4, "y", "3"), (5, "note", None)], "line bigint, c0 string, c1 string")
    assert [tuple(r) for r in rows_after_header(rows, "Name").collect()] == [("x", "1", "2"), ("y", "3", None)]


# closures and memory


@pytest.mark.parametrize(
    "edges",
    [
        [(f"n{k}", f"n{k + 1}") for k in range(20)],
        [(f"n{k}", f"n{(k + 1) % 13}") for k in range(13)] + [("x", "n3"), ("y", "x"), ("y", "y")],
        [(f"n{k}", "nil") for k in range(20)] + [(f"n{k}", f"n{k - 1}") for k in range(1, 20) if k % 5],
        [("a", "a"), ("a", "b"), ("b", "c"), ("c", "b"), ("c", "d"), ("a", "d")],
        [(f"n{k}", f"n{2 * k + j}") for k in range(8) for j in (1, 2)],
    ],
    ids=["chain", "ring", "shared end", "loops", "tree"],
)
def test_closures_of_every_kind(spark, monkeypatch, edges):
    monkeypatch.setattr(closure, "HOT", 10)
    got = [tuple(r) for r in closure.transitive(spark.createDataFrame(edges, "s string, o string"), driver_edges=0).collect()]
    assert sorted(got) == sorted(closure.reach(edges))


def test_circles_are_closed_as_one_node(spark, monkeypatch):
    """Pairs in a circle are not joined with each other again, which is cubic."""
    seen = []
    monkeypatch.setattr(closure, "_paths", lambda edges, starts, f=closure._paths: seen.append(edges.count()) or f(edges, starts))
    edges = [(a, b) for k in range(60) for a, b in ((f"s{k}", "n"), ("n", f"s{k}"))]
    assert closure.transitive(spark.createDataFrame(edges, "s string, o string"), driver_edges=0).count() == 61 * 61
    assert seen == [0]


def test_approximate_looks_equal_sets_up_once(spark):
    """Candidates inside the tags, around them with the generic tag, and equal ones; rows with the same tags get the same."""
    lookup = spark.createDataFrame([(["a"], ["A"]), (["a", "b", "Point"], ["B"]), (["a", "b", "c", "Point"], ["C"]), (["z"], ["Z"])], "tags array<string>, classes array<string>")
    sets = spark.createDataFrame([(k, t) for k in range(0, 40, 2) for t in [["a", "b"], ["b", "a", "a"]]] + [(101, ["q"])], "id int, tags array<string>").withColumn("id", F.monotonically_increasing_id())
    got = tags.approximate(sets, lookup)
    assert {(r["generic"], *r["classes"]) for r in got.collect()} == {("Point", "A"), ("Equipment", "A"), ("Location", "A"), ("Point", "B"), ("Point", "C")}
    assert got.count() == 40 * 5
    plan = got._jdf.queryExecution().executedPlan().toString()
    assert "Aggregate" not in plan, "nothing is gathered by row"


def test_most_likely_gathers_by_tag_set(spark):
    lookup = spark.createDataFrame([(["a", "b"], ["AB"]), (["b"], ["B"])], "tags array<string>, classes array<string>")
    got = tags.most_likely(spark.range(50).select("id", F.array(F.lit("b"), F.lit("x"), F.lit("b")).alias("tags")), lookup)
    assert {(tuple(r["classes"]), tuple(r["leftover"])) for r in got.collect()} == {(("B",), ("x",))} and got.count() == 50
    assert "Aggregate" not in got._jdf.queryExecution().executedPlan().toString()


def test_loops_are_spread_before_they_unfold(spark, monkeypatch):
    monkeypatch.setattr(closure, "TASK_ROWS", 100)
    table = spark.range(40).repartition(1).select(F.col("id").alias("n"), F.lit(50).alias("m"))
    config = {"operations": [{"template": "{% for i in range(value['m']) %} :N{{ value['n'] }}_{{ i }} a :T . {% endfor %}"}]}
    df = etl.convert_table(table, config)
    assert df.count() == 2000
    assert "REPARTITION_BY_NUM" in df._jdf.queryExecution().executedPlan().toString()


def test_link_compares_only_near_texts(spark, monkeypatch):
    """Pairs of one type that have no key in common are never scored; near ones are, by edits in short and long texts."""
    scored = []
    monkeypatch.setattr(merge, "_rounds", lambda pairs, most, f=merge._rounds: scored.append(pairs.count()) or f(pairs, most))
    keys = []
    monkeypatch.setattr(merge, "_keys", lambda *a, f=merge._keys: keys.append(f(*a)) or keys[-1])
    side = lambda at, end: spark.createDataFrame([(f"<urn:{at}/{k:05d}>", ["T"], [f"Customer#{k:09d}{end}"]) for k in range(0, 60)] + [(f"<urn:{at}/long>", ["T"], ["a rather long label of thirty and more letters" + end])], "entity string, types array<string>, labels array<string>")
    got = {(r["left"], r["right"]) for r in merge.link(side("c", ""), side("d", "x")).collect()}
    assert got == {(f"<urn:c/{k:05d}>", f"<urn:d/{k:05d}>") for k in range(60)} | {("<urn:c/long>", "<urn:d/long>")}
    name_l, name_r = keys[:2]
    pairs = name_l.alias("a").join(name_r.alias("b"), ["type", "key"]).select("a.entity", F.col("b.entity").alias("other")).distinct()
    assert pairs.count() < 61 * 61 / 2
