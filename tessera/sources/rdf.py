"""Readers and writers of RDF text.

N-Triples and N-Quads are read and written by Spark line by line, at any size.  Turtle, TriG, RDF/XML and
TriX are document formats: ontologies, shapes and small models go through the driver.
"""

from __future__ import annotations

import hashlib
import os
import xml.etree.ElementTree as ET
from xml.sax.saxutils import escape as xml_escape
from xml.sax.saxutils import quoteattr

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.terms import QUAD, TRIPLE, literal
from ..namespaces import FIRST, NIL, PREFIXES, RDF, REST, TYPE
from ..plans.parser import Parser

FORMATS = {".ttl": "turtle", ".turtle": "turtle", ".n3": "turtle", ".nt": "nt", ".nq": "nquads", ".trig": "trig", ".rdf": "xml", ".owl": "xml", ".xml": "xml", ".trix": "trix"}
LINE = r'^\s*(<[^>]*>|_:\S+)\s+(<[^>]*>)\s+(<[^>]*>|_:[^\s]+|"(?:[^"\\]|\\.)*"(?:@[A-Za-z0-9-]+|\^\^<[^>]*>)?)\s*(<[^>]*>|_:\S+)?\s*\.'


class Document(Parser):
    """Turtle and TriG share the query language's tokens and triple syntax."""

    def __init__(self, text: str, scope: str = ""):
        super().__init__(text)
        self.prefixes = dict(PREFIXES)
        self.declared: dict[str, str] = {}
        self.scope = scope or hashlib.md5(text.encode()).hexdigest()[:8]

    def ground(self, x: tuple) -> str:
        if x[0] == "var":
            if not x[1].startswith("."):
                raise ValueError(f"variables are not allowed in data: ?{x[1]}")
            return f"_:{self.scope}{x[1][1:]}"
        return x[1]

    def directive(self) -> bool:
        kind, text = self.tokens[self.at]
        word = text.lstrip("@").upper()
        if kind not in ("lang", "word") or word not in ("PREFIX", "BASE"):
            return False
        self.at += 1
        if word == "BASE":
            self.base = self.next()[1:-1]
        else:
            name = self.next()[:-1]
            self.declared[name] = self.prefixes[name] = self.resolve("iri", self.next())[1:-1]
        if text.startswith("@"):
            self.need(".")
        return True

    def quads_of(self) -> list[tuple]:
        out, graph = [], ""
        while self.kind() != "end":
            if self.directive():
                continue
            if self.peek("{") or self.take("GRAPH") or self.kind() in ("iri", "pname", "blank") and self.tokens[self.at + 1][1] == "{":
                graph = "" if self.peek("{") else self.ground(self.term([]))
                self.need("{")
                found = self.triples()
                self.need("}")
            else:
                found, graph = [], ""
                subject = self.term(found)
                if not self.peek("."):
                    self.properties(subject, found)
                self.need(".")
            out += [(graph, self.ground(s), self.ground(p) if p[0] == "var" else p[1], self.ground(o)) for s, p, o in found]
        return out


def parse_xml(text: str) -> list[tuple]:
    """RDF/XML to triples."""
    out, count = [], [0]
    scope = hashlib.md5(text.encode()).hexdigest()[:8]
    rdf, lang_key = "{%s}" % RDF, "{http://www.w3.org/XML/1998/namespace}lang"
    base = ET.fromstring(text).get("{http://www.w3.org/XML/1998/namespace}base", "")

    def full(x: str) -> str:
        return f"<{x}>" if ":" in x.split("/")[0] else f"<{base}{x}>"

    def tag(name: str) -> str:
        return "<" + name[1:].replace("}", "", 1) + ">"

    def blank(name: str | None = None) -> str:
        count[0] += 1
        return f"_:{scope}n{name}" if name else f"_:{scope}x{count[0]}"

    def node(el, lang) -> str:
        lang = el.get(lang_key, lang)
        if el.get(rdf + "about") is not None:
            s = full(el.get(rdf + "about"))
        elif el.get(rdf + "ID") is not None:
            s = full("#" + el.get(rdf + "ID"))
        else:
            s = blank(el.get(rdf + "nodeID"))
        if el.tag != rdf + "Description":
            out.append((s, TYPE, tag(el.tag)))
        for k, v in el.attrib.items():
            if not k.startswith(rdf) and k.startswith("{") and "XML/1998" not in k:
                out.append((s, tag(k), literal(v, lang)))
            elif k == rdf + "type":
                out.append((s, TYPE, full(v)))
        properties(s, el, lang)
        return s

    def properties(s: str, el, lang) -> None:
        for k, child in enumerate(el):
            p, inner = tag(child.tag), child.get(lang_key, lang)
            if child.tag == rdf + "li":
                p = f"<{RDF}_{k + 1}>"
            kind = child.get(rdf + "parseType")
            if child.get(rdf + "resource") is not None:
                out.append((s, p, full(child.get(rdf + "resource"))))
            elif child.get(rdf + "nodeID") is not None:
                out.append((s, p, blank(child.get(rdf + "nodeID"))))
            elif kind == "Collection":
                head = NIL
                for item in reversed([node(x, inner) for x in child]):
                    cell = blank()
                    out.extend([(cell, FIRST, item), (cell, REST, head)])
                    head = cell
                out.append((s, p, head))
            elif kind == "Resource":
                o = blank()
                out.append((s, p, o))
                properties(o, child, inner)
            elif len(child):
                out.append((s, p, node(child[0], inner)))
            else:
                given = child.get(rdf + "datatype")
                out.append((s, p, literal(child.text or "", None if given else inner, given)))

    root = ET.fromstring(text)
    for el in root if root.tag == rdf + "RDF" else [root]:
        node(el, root.get(lang_key))
    return out


def parse_trix(text: str) -> list[tuple]:
    """TriX to quads."""
    ns = "{http://www.w3.org/2004/03/trix/trix-1/}"

    def term(el) -> str:
        kind = el.tag.replace(ns, "")
        if kind == "uri":
            return f"<{el.text.strip()}>"
        if kind == "id":
            return f"_:{el.text.strip()}"
        return literal(el.text or "", el.get("{http://www.w3.org/XML/1998/namespace}lang"), el.get("datatype"))

    out = []
    for graph in ET.fromstring(text).iter(ns + "graph"):
        parts = list(graph)
        name = term(parts[0]) if parts and parts[0].tag != ns + "triple" else ""
        out += [(name, *map(term, t)) for t in parts if t.tag == ns + "triple"]
    return out


def parse(text: str, format: str = "turtle") -> tuple[list[tuple], dict[str, str]]:
    """(quads, declared prefixes) of a document; the default graph's name is empty."""
    if format in ("turtle", "ttl", "n3", "trig", "nt", "ntriples", "nquads"):
        if format == "nquads":
            import re

            return [(m[4] or "", m[1], m[2], m[3]) for line in text.splitlines() if (m := re.match(LINE, line))], {}
        doc = Document(text)
        return doc.quads_of(), doc.declared
    if format in ("xml", "rdfxml", "pretty-xml"):
        return [("", *t) for t in parse_xml(text)], {}
    if format == "trix":
        return parse_trix(text), {}
    raise ValueError(f"unknown format: {format}")


def parse_any(text: str, format: str | None = None) -> tuple[list[tuple], dict[str, str]]:
    """Tries the given format, then Turtle and RDF/XML; raises if none fits."""
    errors = []
    for one in [format] * (format is not None) + ["turtle", "xml", "trix"]:
        try:
            return parse(text, one)
        except (ValueError, ET.ParseError, IndexError) as e:
            errors.append(f"{one}: {e}")
    raise ValueError("no format fits: " + "; ".join(errors))


def read_lines(spark: SparkSession, path: str, quads: bool = False) -> DataFrame:
    """N-Triples or N-Quads as s, p, o (and g), distributed; comments and blank lines are skipped."""
    line = F.col("value")
    df = spark.read.text(path).where(F.rlike(line, F.lit(LINE)))
    parts = [F.regexp_extract(line, LINE, k).alias(c) for k, c in ((4, "g"), (1, "s"), (2, "p"), (3, "o"))]
    return df.select(*(parts if quads else parts[1:])).distinct()


def read(spark: SparkSession, path: str, format: str | None = None) -> tuple[DataFrame, dict[str, str]]:
    """(quads, prefixes) of a file, its format guessed from the extension."""
    format = format or FORMATS.get(os.path.splitext(path)[1].lower())
    if format in ("nt", "nquads"):
        df = read_lines(spark, path, format == "nquads")
        return df if format == "nquads" else df.select(F.lit("").alias("g"), "s", "p", "o"), {}
    with open(path, encoding="utf-8") as f:
        rows, prefixes = parse_any(f.read(), format)
    return spark.createDataFrame(rows, QUAD).distinct(), prefixes


def ontology_name(quads: DataFrame) -> str | None:
    """The least subject that is declared an ontology."""
    from ..namespaces import ONTOLOGY

    return quads.where((F.col("p") == TYPE) & (F.col("o") == ONTOLOGY)).agg(F.min("s")).first()[0]


def write_lines(df: DataFrame, path: str) -> None:
    """N-Triples (s, p, o) or N-Quads (with g) as a folder of text files."""
    parts = [F.col(c) for c in ("s", "p", "o")] + ([F.when(F.col("g") != "", F.col("g"))] if "g" in df.columns else [])
    df.select(F.concat(F.concat_ws(" ", *parts), F.lit(" ."))).write.mode("overwrite").text(path)


def shorten(term: str, prefixes: dict[str, str]) -> str:
    if term == TYPE:
        return "a"
    if term.startswith("<"):
        import re

        for name, ns in sorted(prefixes.items(), key=lambda x: -len(x[1])):
            tail = term[1 + len(ns) : -1]
            if term[1:].startswith(ns) and re.fullmatch(r"[A-Za-z_][\w-]*", tail):
                return f"{name}:{tail}"
    return term


def to_turtle(rows: list[tuple], prefixes: dict[str, str] | None = None) -> str:
    """Turtle of (s, p, o) terms, subjects and predicates grouped and sorted."""
    prefixes = PREFIXES if prefixes is None else prefixes
    by: dict[str, dict[str, list[str]]] = {}
    for s, p, o in sorted(set(rows)):
        by.setdefault(s, {}).setdefault(p, []).append(o)
    body = []
    for s, props in by.items():
        ordered = sorted(props, key=lambda p: (p != TYPE, p))
        lines = [f"{shorten(p, prefixes)} " + ", ".join(shorten(o, prefixes) if o != TYPE else o for o in props[p]) for p in ordered]
        body.append((shorten(s, prefixes) if s != TYPE else s) + " " + " ;\n    ".join(lines) + " .\n")
    text = "\n".join(body)
    used = {n: ns for n, ns in prefixes.items() if f"{n}:" in text}
    return "".join(f"@prefix {n}: <{ns}> .\n" for n, ns in sorted(used.items())) + "\n" + text


def to_trig(rows: list[tuple], prefixes: dict[str, str] | None = None) -> str:
    names = sorted({r[0] for r in rows})
    out, heads = [], []
    for g in names:
        text = to_turtle([r[1:] for r in rows if r[0] == g], prefixes)
        head, _, body = text.partition("\n\n")
        heads += head.splitlines()
        out.append((f"{g} " if g else "") + "{\n" + body + "}\n")
    return "\n".join(sorted(set(heads))) + "\n\n" + "\n".join(out)


def _value(o: str) -> tuple[str, str]:
    """(attributes, text) of a literal in XML."""
    from ..functions.terms import unescape

    end = o.rindex('"')
    tail, text = o[end + 1 :], xml_escape(unescape(o[1:end]))
    if tail.startswith("@"):
        return f" xml:lang={quoteattr(tail[1:])}", text
    return (f" rdf:datatype={quoteattr(tail[3:-1])}" if tail else ""), text


def to_xml(rows: list[tuple]) -> str:
    """RDF/XML of (s, p, o) terms."""
    import re

    spaces, out = {RDF: "rdf"}, []
    for s, p, o in sorted(set(rows)):
        ns, name = re.match(r"<(.*?)([A-Za-z_][\w.-]*)>$", p).groups()
        short = spaces.setdefault(ns, f"ns{len(spaces)}")
        about = f"rdf:about={quoteattr(s[1:-1])}" if s[0] == "<" else f"rdf:nodeID={quoteattr(s[2:])}"
        if o[0] == '"':
            attributes, text = _value(o)
            inner = f"<{short}:{name}{attributes}>{text}</{short}:{name}>"
        else:
            inner = f"<{short}:{name} " + (f"rdf:resource={quoteattr(o[1:-1])}" if o[0] == "<" else f"rdf:nodeID={quoteattr(o[2:])}") + "/>"
        out.append(f"  <rdf:Description {about}>{inner}</rdf:Description>")
    head = " ".join(f"xmlns:{short}={quoteattr(ns)}" for ns, short in spaces.items())
    return f'<?xml version="1.0" encoding="UTF-8"?>\n<rdf:RDF {head}>\n' + "\n".join(out) + "\n</rdf:RDF>\n"


def to_trix(rows: list[tuple]) -> str:
    """TriX of (g, s, p, o) terms."""

    def term(x: str) -> str:
        if x[0] == "<":
            return f"<uri>{xml_escape(x[1:-1])}</uri>"
        if x[0] == "_":
            return f"<id>{xml_escape(x[2:])}</id>"
        attributes, text = _value(x)
        return f"<typedLiteral{attributes.replace('rdf:', '')}>{text}</typedLiteral>" if "datatype" in attributes else f"<plainLiteral{attributes}>{text}</plainLiteral>"

    out = []
    for g in sorted({r[0] for r in rows}):
        triples = "\n".join("<triple>" + "".join(map(term, r[1:])) + "</triple>" for r in sorted(set(rows)) if r[0] == g)
        out.append("<graph>" + (term(g) if g else "") + "\n" + triples + "\n</graph>")
    return '<?xml version="1.0" encoding="UTF-8"?>\n<TriX xmlns="http://www.w3.org/2004/03/trix/trix-1/">\n' + "\n".join(out) + "\n</TriX>\n"


def serialize(rows: list[tuple], format: str = "turtle", prefixes: dict[str, str] | None = None) -> str:
    """Text of (g, s, p, o) terms in a format."""
    triples = [r[1:] for r in rows]
    if format in ("turtle", "ttl", "n3"):
        return to_turtle(triples, prefixes)
    if format in ("nt", "ntriples"):
        return "".join(" ".join(t) + " .\n" for t in sorted(set(triples)))
    if format == "nquads":
        return "".join(" ".join([*t[1:], *([t[0]] if t[0] else [])]) + " .\n" for t in sorted(set(rows)))
    if format in ("xml", "rdfxml", "pretty-xml"):
        return to_xml(triples)
    if format == "trig":
        return to_trig(rows, prefixes)
    if format == "trix":
        return to_trix(rows)
    raise ValueError(f"unknown format: {format}")


def empty(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([], TRIPLE)


