"""Device models in RDF and equipment schedules: conversion steps, rule packs and the table of analogies.

A device model states types of its own vocabulary (``dev:``), whose definitions form a tree by ``dev:is`` and subclass
edges.  ``DeviceConversion`` joins the data with definitions and analogies, runs the rule pack, types instances by their
tags and clears away everything that isn't of the building vocabulary.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.terms import TRIPLE, to_literal
from ..namespaces import BLD, HAS_LOCATION, HAS_POINT, IS_POINT_OF, LABEL, TYPE, iri
from .etl import Conversion, without_namespaces
from .haystack import infer_entities, rdf_entities
from .tags import lookup_table

DEV = "urn:tessera:device#"
LIKE = "urn:tessera:analogy#"
IS, HAS_TAG, MARKER = iri(DEV + "is"), iri(DEV + "hasTag"), iri(DEV + "marker")
SIMILAR = iri(LIKE + "similarTo")
HAS_PART, IS_PART_OF = iri(BLD + "hasPart"), iri(BLD + "isPartOf")

#: Device class or relation -> what it is like in the building vocabulary.
ANALOGIES = {
    "AHU": "ahu", "Boiler": "boiler", "Chiller": "chiller", "Damper": "damperActuator", "Equipment": "equip", "FCU": "fcu", "Fluid": "fluid",
    "Heat_Exchanger": "heatExchanger", "Meter": "meter", "Electrical_Meter": "elecMeter acElecMeter", "Point": "point hisPoint curPoint",
    "RTU": "rtu", "Site": "site", "Space": "space", "Substance": "substance", "Terminal_Unit": "terminalUnit", "Thermostat": "thermostat",
    "VAV": "vav fanVav", "Air": "air", "Steam": "steam", "Chilled_Water": "chilledWater", "Hot_Water": "hotWater", "Condenser_Water": "condenserWater",
    "hasLocation": "siteRef spaceRef", "isPartOf": "equipRef airRef submeterOf hotWaterRef chilledWaterRef",
    "regulates": "cools heats produces ventilates dries humidifies moves regulates stores conveys reheats",
}


def analogies(spark) -> DataFrame:
    """Triples ``dev:x similarTo bld:Y``."""
    return spark.createDataFrame([(iri(DEV + x), SIMILAR, iri(BLD + y)) for y, names in ANALOGIES.items() for x in names.split()], TRIPLE)


def _kind(var: str, name: str) -> str:
    return f"?{var} a/(dev:is|rdfs:subClassOf)* dev:{name} ."


def _pair(description: str, made: str, *where: str) -> dict:
    return {"description": description, "query": "INSERT {{ " + made + " }} WHERE {{ " + " ".join(where) + " }}"}


#: Rules over a device model with definitions and analogies.
DEVICE_PACK = {
    "namespace_prefixes": {"dev": DEV, "like": LIKE},
    "operations": [
        _pair("terminal units fed by air handlers", "?a bld:feeds ?v . ?a a bld:AHU . ?v a bld:VAV .", _kind("v", "vav"), _kind("a", "ahu"), "?v dev:equipRef ?a ."),
        _pair("points of terminal units", "?v bld:hasPoint ?p . ?p a bld:Point . ?v a bld:VAV .", _kind("v", "vav"), _kind("p", "point"), "?p dev:equipRef ?v ."),
        _pair("air from outlets to inlets", "?x bld:feeds ?y ; bld:regulates bld:Air . ?y bld:regulates bld:Air .", _kind("x", "airOutput"), _kind("y", "airInput"), "?y dev:airRef ?x ."),
        _pair("meters below meters", "?x bld:hasPart ?y .", _kind("x", "elecOutput"), _kind("y", "elecInput"), "?y dev:submeterOf ?x ."),
        _pair("enabling commands", "?e bld:hasPoint ?p ; a bld:Equipment . ?p a bld:Enable_Command .", "?p dev:hasTag dev:enable ; dev:equipRef ?e ."),
        *[_pair(f"points that are {name}s", f"?p a bld:{kind} .", f"?p dev:hasTag dev:{tag} .", _kind("p", "point")) for name, kind, tag in (("sensor", "Sensor", "sensor"), ("setpoint", "Setpoint", "sp"), ("command", "Command", "cmd"))],
        _pair("fans of equipment", "?f a bld:Fan . ?e a bld:Equipment ; bld:hasPart ?f .", "?f dev:hasTag dev:fan , dev:hvac ; dev:equipRef ?e ."),
        _pair("instances of similar classes", "?x a ?to .", "?x a/dev:is* ?from . ?from like:similarTo ?to ."),
        _pair("statements about similar classes", "?x ?p ?to .", "?x ?p ?from . ?from like:similarTo ?to ."),
        _pair("similar relations", "?x ?to ?y .", "?x ?from ?y . ?from like:similarTo ?to ."),
        *[_pair(f"{name} meters", f"?x a bld:{name}_Meter .", f"?x dev:hasTag dev:{tag} , dev:equip , dev:meter .") for name, tag in (("Gas", "gas"), ("Water", "water"), ("Electrical", "elec"))],
        _pair("water valves", "?x a bld:Water_Valve .", "?x dev:hasTag dev:water , dev:valve ."),
    ],
}


def _named(column: str, words: str, kind: str, other: str = "", without: str = "") -> dict:
    """An operation for cells that hold a word: the entity is of a class."""
    tests = [f"'{w}' in '{{{column}}}'" for w in words.split()] + [f"'{w}' not in '{{{column}}}'" for w in without.split()]
    return {"description": f"{kind} by {column}", "conditions": [" and ".join(tests)], "data": f"bldg:{{{column}}} a bld:{kind} ." + other}


_UNIT, _SOURCE, _CONTROL = "device", "served by", "controller"
_DRIVE = f" bldg:{{{_UNIT}}} bld:isControlledBy bldg:{{{_UNIT}}}-VFD . bldg:{{{_UNIT}}}-VFD a bld:Variable_Frequency_Drive ; bld:hasPoint bldg:{{{_UNIT}}}-VFD-EC . bldg:{{{_UNIT}}}-VFD-EC a bld:VFD_Enable_Command ."
_CLASSES = [("AHU", "AHU", "SF RF"), ("SF", "Supply_Fan", ""), ("RF", "Return_Fan", ""), ("EF", "Exhaust_Fan", ""), ("VAV", "VAV", ""), ("FCU", "Fan_Coil_Unit", ""), ("CHWP", "Chilled_Water_Pump", ""), ("HWP", "Hot_Water_Pump", ""), ("BLR", "Boiler", ""), ("CT", "Cooling_Tower", "")]
_POINTS = [("RH", "Relative_Humidity_Sensor"), ("CO2", "CO2_Sensor"), ("ZT", "Zone_Air_Temperature_Sensor"), ("DP", "Differential_Pressure_Sensor")]

#: Rules over an equipment schedule with the columns site, building, floor, space, device, served by, controller.
SCHEDULE_PACK = {
    "namespace_prefixes": {"bld": BLD},
    "operations": [
        {"description": "sites, buildings, floors", "data": "site:{site} a bld:Site ; bld:isLocationOf bldg:{building} . bldg:{building} a bld:Building ; bld:hasPart bldg:{floor} . bldg:{floor} a bld:Floor ."},
        {"description": "spaces", "data": "bldg:{space} a bld:Space . bldg:{floor} bld:hasPart bldg:{space} ."},
        {"description": "rooms", "conditions": ["'room' in '{space}'.lower()"], "data": "bldg:{space} a bld:Room ."},
        {"description": "air zones", "data": "bldg:{space}_zone a bld:HVAC_Zone ; bld:hasLocation bldg:{floor} ; bld:hasPart bldg:{space} ."},
        {"description": "equipment of zones", "data": "bldg:{device} a bld:Equipment ; bld:feeds bldg:{space}_zone ."},
        {"description": "equipment of equipment", "data": "bldg:{served by} a bld:Equipment ; bld:feeds bldg:{device} . bldg:{device} a bld:Equipment ."},
        *[_named(column, words, kind, "", no) for words, kind, no in _CLASSES for column in (_UNIT, _SOURCE)],
        {"description": "drives", "conditions": [f"'VFD' in '{{{_CONTROL}}}'"], "data": _DRIVE.strip()},
        *[{"description": kind, "conditions": [f"'{word}' in '{{{_CONTROL}}}'"], "data": f"bldg:{{{_UNIT}}} bld:hasPoint bldg:{{{_UNIT}}}-{word} . bldg:{{{_UNIT}}}-{word} a bld:{kind} ."} for word, kind in _POINTS],
    ],
}


def clean_model(triples: DataFrame, definitions: DataFrame | None = None, namespaces: tuple[str, ...] = (DEV, LIKE)) -> DataFrame:
    """Without definitions, without IRIs of the device vocabulary, and without edges that others imply.

    A part has no location that its whole has; a point of something is not its part besides.
    """
    if definitions is not None:
        triples = triples.join(definitions, ["s", "p", "o"], "left_anti")
    triples = without_namespaces(triples, list(namespaces))
    edge = lambda p, a, b: triples.where(F.col("p") == p).select(F.col(a).alias("part"), F.col(b).alias("whole"))
    parts = edge(IS_PART_OF, "s", "o").union(edge(HAS_PART, "o", "s")).distinct()
    points = edge(IS_POINT_OF, "s", "o").union(edge(HAS_POINT, "o", "s")).distinct()
    places = triples.where(F.col("p") == HAS_LOCATION).select(F.col("s").alias("whole"), "o")
    twice = parts.join(places, "whole").select(F.col("part").alias("s"), F.lit(HAS_LOCATION).alias("p"), "o")
    both = parts.join(points, ["part", "whole"])
    twice = twice.union(both.select("whole", F.lit(HAS_PART), "part")).union(both.select("part", F.lit(IS_PART_OF), "whole"))
    return triples.join(twice.distinct(), ["s", "p", "o"], "left_anti")


def typed_instances(triples: DataFrame, ontology: DataFrame) -> DataFrame:
    """Type triples of instances by their tags, with the instance's label: nothing else of the inferred entities is kept."""
    found = rdf_entities(triples, MARKER, IS, HAS_TAG)
    # ids are the instances' IRIs, so inferred nodes are read back to them
    got = infer_entities(found.withColumn("id", F.expr("substring(id, 2, length(id) - 2)")), lookup_table(ontology), ontology, "")
    kinds = got.where(F.col("p") == TYPE).select(F.regexp_replace("s", "_(equip|point)>$", ">").alias("s"), "p", "o").distinct()
    labels = triples.where(F.col("p") == LABEL).select("s", "o").groupBy("s").agg(F.min("o").alias("o"))
    named = kinds.select("s").distinct().join(labels, "s", "left").select("s", F.lit(iri(BLD + "label")).alias("p"), F.coalesce("o", to_literal(F.lit(""))).alias("o"))
    return kinds.union(named)


class DeviceConversion(Conversion):
    """A device model in RDF to the building vocabulary."""

    def __init__(self, spark, ontology: DataFrame, definitions: DataFrame, config: dict | None = None):
        super().__init__(spark, config or DEVICE_PACK)
        self.ontology, self.definitions = ontology, definitions

    def ingest(self, source) -> DataFrame:
        return source.union(self.definitions).union(analogies(self.spark)).distinct()

    def infer(self, triples: DataFrame) -> DataFrame:
        return triples.union(typed_instances(triples, self.ontology)).distinct()

    def clean_up(self, triples: DataFrame) -> DataFrame:
        return clean_model(triples, self.definitions)
