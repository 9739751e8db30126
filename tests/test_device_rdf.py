"""A device model in RDF, converted by the rule pack: definitions, analogies, tags, clean-up."""

from tessera.graph import Graph
from tessera.namespaces import BLD, HAS_ASSOCIATED_TAG, HAS_POINT, LABEL, POINT, SUBCLASS, TAG, TYPE, iri
from tessera.operators import device_rdf


def d(name):
    return f"<{device_rdf.DEV}{name}>"


def test_device_conversion(spark):
    definitions = Graph.from_triples(spark, [(d("vav"), device_rdf.IS, d("equip")), (d("equip"), device_rdf.IS, device_rdf.MARKER), (d("point"), device_rdf.IS, device_rdf.MARKER)]).df
    ontology = Graph.from_triples(spark, [(iri(BLD + "Sensor"), SUBCLASS, POINT), (iri(BLD + "Sensor"), HAS_ASSOCIATED_TAG, f"<{TAG}Sensor>"), (iri(BLD + "Sensor"), HAS_ASSOCIATED_TAG, f"<{TAG}Point>")]).df
    data = Graph.from_triples(spark, [("<urn:p1>", TYPE, d("point")), ("<urn:p1>", device_rdf.HAS_TAG, d("sensor")), ("<urn:p1>", device_rdf.HAS_TAG, d("point")), ("<urn:p1>", LABEL, '"one"'), ("<urn:p1>", d("equipRef"), "<urn:v1>"), ("<urn:v1>", TYPE, d("vav"))]).df
    wanted = {"points of terminal units", "points that are sensors", "instances of similar classes", "similar relations"}
    config = device_rdf.DEVICE_PACK | {"operations": [x for x in device_rdf.DEVICE_PACK["operations"] if x["description"] in wanted]}
    job = device_rdf.DeviceConversion(spark, ontology, definitions, config)
    got = {tuple(r) for r in job.run(data).collect()}
    assert not job.failed and not [t for t in got if any(device_rdf.DEV in x for x in t)]
    assert {("<urn:v1>", HAS_POINT, "<urn:p1>"), ("<urn:v1>", TYPE, iri(BLD + "VAV")), ("<urn:v1>", TYPE, iri(BLD + "Equipment")), ("<urn:p1>", TYPE, iri(BLD + "Point")), ("<urn:p1>", TYPE, iri(BLD + "Sensor")), ("<urn:p1>", iri(BLD + "label"), '"one"')} <= got
    assert ("<urn:p1>", device_rdf.IS_PART_OF, "<urn:v1>") not in got  # it is a point of it


def test_rules_parse():
    from tessera.namespaces import PREFIXES
    from tessera.plans.parser import Parser

    for op in device_rdf.DEVICE_PACK["operations"]:
        assert Parser(op["query"].replace("{{", "{").replace("}}", "}"), PREFIXES | device_rdf.DEVICE_PACK["namespace_prefixes"]).update()
