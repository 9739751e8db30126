"""Namespaces and the prefixes that queries know without declaring them."""

RDF = "http://www.w3.org/1999/02/22-rdf-syntax-ns#"
RDFS = "http://www.w3.org/2000/01/rdf-schema#"
OWL = "http://www.w3.org/2002/07/owl#"
XSD = "http://www.w3.org/2001/XMLSchema#"
SH = "http://www.w3.org/ns/shacl#"
SKOS = "http://www.w3.org/2004/02/skos/core#"
BLD = "urn:tessera:building#"  # vocabulary of the bundled example model
TAG = "urn:tessera:tag#"
DATA = "urn:tessera:data/"  # entities made from tables

PREFIXES = {"rdf": RDF, "rdfs": RDFS, "owl": OWL, "xsd": XSD, "sh": SH, "skos": SKOS, "bld": BLD, "tag": TAG, "": DATA}


def iri(text: str) -> str:
    """Canonical term of an IRI."""
    return f"<{text}>"


def expand(name: str, prefixes: dict[str, str] | None = None) -> str:
    """Term of a prefixed name such as ``rdf:type``; terms and IRIs in brackets pass."""
    if name[:1] in "<_\"":
        return name
    head, _, tail = name.partition(":")
    known = PREFIXES | (prefixes or {})
    if head not in known:
        raise ValueError(f"unknown prefix: {head}")
    return iri(known[head] + tail)


TYPE = iri(RDF + "type")
FIRST, REST, NIL = iri(RDF + "first"), iri(RDF + "rest"), iri(RDF + "nil")
SUBCLASS, SUBPROPERTY = iri(RDFS + "subClassOf"), iri(RDFS + "subPropertyOf")
DOMAIN, RANGE, LABEL, RESOURCE = iri(RDFS + "domain"), iri(RDFS + "range"), iri(RDFS + "label"), iri(RDFS + "Resource")
SAME, CLASS, THING, NOTHING = iri(OWL + "sameAs"), iri(OWL + "Class"), iri(OWL + "Thing"), iri(OWL + "Nothing")
EQUIVALENT, INVERSE = iri(OWL + "equivalentClass"), iri(OWL + "inverseOf")
ONTOLOGY = iri(OWL + "Ontology")
HAS_TAG, HAS_ASSOCIATED_TAG, TAG_CLASS = iri(BLD + "hasTag"), iri(BLD + "hasAssociatedTag"), iri(BLD + "Tag")
POINT, EQUIPMENT, LOCATION = iri(BLD + "Point"), iri(BLD + "Equipment"), iri(BLD + "Location")
HAS_POINT, IS_POINT_OF = iri(BLD + "hasPoint"), iri(BLD + "isPointOf")
HAS_LOCATION, IS_LOCATION_OF = iri(BLD + "hasLocation"), iri(BLD + "isLocationOf")
