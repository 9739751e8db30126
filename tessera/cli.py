"""Command line: ``validate`` a graph against shapes, or ``convert`` a table or graph.

    python -m tessera.cli validate building.ttl -s shapes.ttl -e ontology.ttl -i rdfs
    python -m tessera.cli convert sheet.csv --input-type csv --config template.yml
"""

from __future__ import annotations

import argparse
import os
import sys

from .graph import HERE, Graph
from .operators import etl
from .sources.tables import read_table


def session():
    from pyspark.sql import SparkSession

    return SparkSession.builder.config("spark.sql.session.timeZone", "UTC").getOrCreate()


def validate_command(a) -> int:
    """Exit status 0 if the data conforms, else 255 (-1)."""
    spark = session()
    graph = Graph.load(spark, a.data)
    shapes = [Graph.load(spark, p) for p in a.shapes or []]
    if not a.no_default_shapes:
        shapes.append(Graph.empty(spark).load_extension("shapes"))
    for path in a.extra or []:
        graph = graph + Graph.load(spark, path)
    if not a.no_vocabulary:
        graph = graph + Graph.building(spark)
    if a.meta:
        for k, g in enumerate(shapes):
            ok, _, text = g.validate([Graph.load(spark, os.path.join(HERE, "data", "shape_rules.ttl"))])
            if not ok:
                print(f"shapes graph {k + 1} is malformed\n{text}")
                return 255
    if a.advanced:  # rules of the shapes first
        from .operators.shacl import infer

        for g in shapes:
            graph = infer(graph, g)
    profile = {"none": None, "rdfs": "rdfs", "owlrl": "owlrl", "both": "rdfs+owlrl"}[a.inference]
    if a.debug:
        print(f"data: {len(graph)} triples; shapes: {sum(map(len, shapes))}; inference: {profile}", file=sys.stderr)
    ok, _, text = graph.validate(shapes or None, abort_on_first=a.abort, allow_warnings=not a.strict, inference=profile)
    print(text)
    return 0 if ok else 255


def convert_command(a) -> int:
    spark = session()
    config = etl.load_config(a.config) if a.config else {}
    if a.input_type == "device":
        from .operators.device_rdf import DeviceConversion

        definitions = Graph.load(spark, a.definitions).df if a.definitions else Graph.empty(spark).df
        job = DeviceConversion(spark, Graph.building(spark).df, definitions, config or None)
    elif a.input_type == "schedule":
        from .operators.device_rdf import SCHEDULE_PACK

        job = etl.Conversion(spark, config or SCHEDULE_PACK)
    else:
        job = etl.Conversion(spark, config)
    pair = lambda prefix, namespace: (prefix, namespace) if prefix and namespace else None
    if a.input_type in ("csv", "tsv", "table", "schedule"):
        sep = "\t" if a.input_type == "tsv" or a.source.endswith(".tsv") else ","
        source = read_table(spark, a.source, sep)
    else:
        source = Graph.load(spark, a.source, a.input_format).df
    df = job.run(source, pair(a.building_prefix, a.building_namespace), pair(a.site_prefix, a.site_namespace))
    for text in job.failed:
        print(text, file=sys.stderr)
    if a.minify:
        df = etl.minify(df, Graph.load(spark, a.ontology).df if a.ontology else df.limit(0))
    out = a.output or a.source + ".out.ttl"
    graph = Graph(df, job.config.get("namespace_prefixes"))
    graph.serialize(a.format, out)
    print(out)
    return 0


def main(argv: list[str] | None = None) -> int:
    parser = argparse.ArgumentParser(prog="tessera")
    commands = parser.add_subparsers(required=True)
    v = commands.add_parser("validate", help="exit status 255 if the data does not conform")
    v.add_argument("data")
    v.add_argument("-s", "--shapes", action="append")
    v.add_argument("-e", "--extra", action="append", help="graphs added to the data")
    v.add_argument("-i", "--inference", choices=["none", "rdfs", "owlrl", "both"], default="rdfs")
    v.add_argument("--no-vocabulary", action="store_true", help="without the bundled vocabulary")
    v.add_argument("--no-default-shapes", action="store_true", help="without the bundled shapes")
    v.add_argument("-m", "--meta", action="store_true", help="validate the shapes graphs themselves first")
    v.add_argument("-a", "--advanced", action="store_true", help="run the shapes' rules first")
    v.add_argument("-d", "--debug", action="store_true", help="sizes and settings to the error output")
    v.add_argument("--abort", action="store_true", help="stop at the first result")
    v.add_argument("--strict", action="store_true", help="warnings fail too")
    v.set_defaults(run=validate_command)
    c = commands.add_parser("convert")
    c.add_argument("source")
    c.add_argument("--input-type", choices=["csv", "tsv", "table", "schedule", "rdf", "graph", "device"], default="rdf", help="schedule and device bring their own rule packs")
    c.add_argument("--definitions", help="definitions of a device model's vocabulary")
    c.add_argument("--input-format")
    c.add_argument("--config")
    c.add_argument("--output")
    c.add_argument("--format", default="turtle")
    c.add_argument("--minify", action="store_true")
    c.add_argument("--ontology")
    for name in ("building", "site"):
        c.add_argument(f"--{name}-prefix")
        c.add_argument(f"--{name}-namespace")
    c.set_defaults(run=convert_command)
    a = parser.parse_args(argv)
    return a.run(a)


if __name__ == "__main__":
    sys.exit(main())
