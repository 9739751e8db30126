"""RDFS and OWL 2 RL closures, simplification and most-specific classes.

The schema (class and property axioms) is gathered to the driver behind a check of its size, closed there,
and turned into small rule tables.  Each round then applies all rules of one predicate or one class in a
single join of the instance data with a table: ``p -> what to emit``.  Only new triples enter the next
round.  Equality is kept as representatives: same-as components map every member to its least name, and the
pairs are written out once at the end.
"""

from __future__ import annotations

from collections import defaultdict
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import terms
from ..functions.terms import TRIPLE
from ..namespaces import CLASS, DOMAIN, EQUIVALENT, FIRST, INVERSE, NIL, NOTHING, OWL, RANGE, RDF, RDFS, RESOURCE, REST, SAME, SUBCLASS, SUBPROPERTY, THING, TYPE, XSD, iri
from .closure import Grown, checkpoint, components, distinct, products, reach, regrouped, transitive

#: Largest schema that the driver closes.
SCHEMA_TRIPLES = 500_000
OWL_ = {n: iri(OWL + n) for n in "equivalentProperty SymmetricProperty TransitiveProperty FunctionalProperty InverseFunctionalProperty propertyChainAxiom hasKey intersectionOf unionOf oneOf onProperty hasValue someValuesFrom allValuesFrom maxCardinality maxQualifiedCardinality onClass complementOf disjointWith AllDisjointClasses AllDisjointProperties AllDifferent distinctMembers members propertyDisjointWith IrreflexiveProperty AsymmetricProperty Restriction differentFrom NegativePropertyAssertion sourceIndividual assertionProperty targetIndividual targetValue ObjectProperty DatatypeProperty Thing Class".split()}
PROPERTY = iri(RDF + "Property")
SCHEMA_PREDICATES = [SUBCLASS, SUBPROPERTY, DOMAIN, RANGE, EQUIVALENT, INVERSE, FIRST, REST] + [OWL_[n] for n in "equivalentProperty propertyChainAxiom hasKey intersectionOf unionOf oneOf onProperty hasValue someValuesFrom allValuesFrom maxCardinality maxQualifiedCardinality onClass complementOf disjointWith members distinctMembers propertyDisjointWith sourceIndividual assertionProperty targetIndividual targetValue".split()]
SCHEMA_TYPES = [CLASS, iri(RDFS + "Class"), PROPERTY, iri(RDFS + "Datatype"), iri(RDFS + "ContainerMembershipProperty")] + [OWL_[n] for n in "SymmetricProperty TransitiveProperty FunctionalProperty InverseFunctionalProperty IrreflexiveProperty AsymmetricProperty AllDisjointClasses AllDisjointProperties AllDifferent Restriction NegativePropertyAssertion ObjectProperty DatatypeProperty".split()]


#: Largest closure of class or property pairs that the driver holds.
SCHEMA_PAIRS = 20_000_000
#: Rule tables of so many characters at most are broadcast.
RULE_TEXT = 16 << 20


def _reach(pairs) -> set[tuple[str, str]]:
    got = reach(sorted(pairs), SCHEMA_PAIRS)
    if got is None:
        raise ValueError(f"the schema's hierarchy has more than {SCHEMA_PAIRS} pairs")
    return set(got)


def _few(df: DataFrame) -> list:
    """Schema rows on the driver, behind a check of their number."""
    rows = df.limit(SCHEMA_TRIPLES + 1).collect()
    if len(rows) > SCHEMA_TRIPLES:
        raise ValueError(f"the schema has more than {SCHEMA_TRIPLES} triples")
    return rows


class Schema:
    """Axioms of a graph on the driver, closed under the schema rules."""

    def __init__(self, rows: list[tuple[str, str, str]], owl: bool):
        self.by: dict[str, list[tuple[str, str]]] = defaultdict(list)
        for s, p, o in rows:
            self.by[p].append((s, o))
        get, types = self.by, defaultdict(set)
        for s, o in get[TYPE]:
            types[o].add(s)
        self.types = types
        first, rest = dict(get[FIRST]), dict(get[REST])

        def members(head: str) -> list[str]:
            out, seen = [], set()
            while head in first:
                if head in seen:
                    raise ValueError(f"a list runs in a circle: {head}")
                seen.add(head)
                out.append(first[head])
                head = rest.get(head, NIL)
            return out

        self.lists = members
        self.apart: set = set()
        sub, subp = set(get[SUBCLASS]), set(get[SUBPROPERTY])
        domain, range_ = set(get[DOMAIN]), set(get[RANGE])
        self.inverse: set = set()
        self.chains, self.keys, self.intersections, self.restrictions = [], [], [], defaultdict(dict)
        self.one_of: list = []
        self.unions: list = []
        self.disjoint: set = set()
        if owl:
            for a, b in get[EQUIVALENT]:
                sub |= {(a, b), (b, a)}
            for a, b in get[OWL_["equivalentProperty"]]:
                subp |= {(a, b), (b, a)}
            for a, b in get[INVERSE]:
                self.inverse |= {(a, b), (b, a)}
            self.inverse |= {(p, p) for p in types[OWL_["SymmetricProperty"]]}
            self.chains = [(p, members(x)) for p, x in get[OWL_["propertyChainAxiom"]]]
            self.keys = [(c, members(x)) for c, x in get[OWL_["hasKey"]]]
            for c, x in get[OWL_["intersectionOf"]]:
                parts = members(x)
                self.intersections.append((c, parts))
                sub |= {(c, d) for d in parts}
            for c, x in get[OWL_["unionOf"]]:
                sub |= {(d, c) for d in members(x)}
                self.unions.append((c, members(x)))
            self.one_of = [(c, i) for c, x in get[OWL_["oneOf"]] for i in members(x)]
            for n in "onProperty hasValue someValuesFrom allValuesFrom maxCardinality maxQualifiedCardinality onClass".split():
                for c, v in get[OWL_[n]]:
                    self.restrictions[c][n] = v
            self.disjoint = set(get[OWL_["disjointWith"]])
            self.apart = set(get[OWL_["propertyDisjointWith"]])
            for x in types[OWL_["AllDisjointProperties"]]:
                for s, o in get[OWL_["members"]]:
                    if s == x:
                        m = members(o)
                        self.apart |= {(a, b) for i, a in enumerate(m) for b in m[i + 1 :]}
            for x in types[OWL_["AllDisjointClasses"]]:
                for s, o in get[OWL_["members"]]:
                    if s == x:
                        m = members(o)
                        self.disjoint |= {(a, b) for i, a in enumerate(m) for b in m[i + 1 :]}
        self.sub, self.subp = _reach(sub), _reach(subp)
        # domains and ranges of superproperties and their superclasses hold too
        up, upc = defaultdict(set), defaultdict(set)
        for a, b in self.subp:
            up[a].add(b)
        for a, b in self.sub:
            upc[a].add(b)

        def inherited(pairs: set) -> set:
            own = defaultdict(set)
            for p, c in pairs:
                own[p].add(c)
            out = set()
            for p in set(own) | set(up):
                for q in {p} | up[p]:
                    for c in own.get(q, ()):
                        out |= {(p, c)} | {(p, d) for d in upc[c]}
            return out

        if owl:  # restrictions by property, value and class
            sub |= self._restriction_order(_reach(sub), _reach(subp))
            self.sub = _reach(sub)
            upc.clear()
            for a, b in self.sub:
                upc[a].add(b)
        self.domain, self.range = inherited(domain), inherited(range_)
        self.transitive = types[OWL_["TransitiveProperty"]] if owl else set()
        self.functional = types[OWL_["FunctionalProperty"]] if owl else set()
        self.inverse_functional = types[OWL_["InverseFunctionalProperty"]] if owl else set()
        self.owl = owl

    def _restriction_order(self, sub: set, subp: set) -> set[tuple[str, str]]:
        """Subclass pairs between restrictions (scm-hv, scm-svf1/2, scm-avf1/2)."""
        under = lambda a, b, known: a == b or (a, b) in known
        out = set()
        for kind, up in (("hasValue", True), ("someValuesFrom", True), ("allValuesFrom", False)):
            same_p, same_v = defaultdict(list), defaultdict(list)
            for c, x in self.restrictions.items():
                if kind in x and "onProperty" in x:
                    same_p[x["onProperty"]].append((c, x[kind]))
                    same_v[x[kind]].append((c, x["onProperty"]))
            for group in same_v.values():  # one value: the property decides, the other way round for allValuesFrom
                out |= {(a, b) if up else (b, a) for a, p in group for b, q in group if a != b and under(p, q, subp)}
            if kind != "hasValue":
                for group in same_p.values():  # one property: the class decides
                    out |= {(a, b) for a, c in group for b, d in group if a != b and under(c, d, sub)}
        return out

    def entailed(self) -> list[tuple[str, str, str]]:
        """Schema triples that follow from the schema alone."""
        out = {(a, SUBCLASS, b) for a, b in self.sub} | {(a, SUBPROPERTY, b) for a, b in self.subp}
        out |= {(p, DOMAIN, c) for p, c in self.domain} | {(p, RANGE, c) for p, c in self.range}
        if self.owl:
            out |= {(a, EQUIVALENT, b) for a, b in self.sub if (b, a) in self.sub}
            out |= {(a, OWL_["equivalentProperty"], b) for a, b in self.subp if (b, a) in self.subp}
            for c in self.types[CLASS]:
                out |= {(c, SUBCLASS, c), (c, EQUIVALENT, c), (c, SUBCLASS, THING), (NOTHING, SUBCLASS, c)}
            for p in self.types[OWL_["ObjectProperty"]] | self.types[OWL_["DatatypeProperty"]]:
                out |= {(p, SUBPROPERTY, p), (p, OWL_["equivalentProperty"], p)}
        else:
            for c in self.types[iri(RDFS + "Class")] | self.types[CLASS]:
                out |= {(c, SUBCLASS, c), (c, SUBCLASS, RESOURCE)}
            for p in self.types[PROPERTY]:
                out.add((p, SUBPROPERTY, p))
            for p in self.types[iri(RDFS + "ContainerMembershipProperty")]:
                out.add((p, SUBPROPERTY, iri(RDFS + "member")))
            for d in self.types[iri(RDFS + "Datatype")]:
                out.add((d, SUBCLASS, iri(RDFS + "Literal")))
        return sorted(out)

    def property_rules(self) -> list[tuple[str, str, str]]:
        """(p, what, term): forward and backward copies and the types of either end."""
        out = {(p, "same", q) for p, q in self.subp if p != q} | {(p, "swap", q) for p, q in self.inverse}
        return sorted(out | {(p, "subject", c) for p, c in self.domain} | {(p, "object", c) for p, c in self.range})

    def class_rules(self) -> list[tuple[str, str, str]]:
        """(class, predicate, object) to state of its instances."""
        out = {(c, TYPE, d) for c, d in self.sub if c != d}
        for c, r in self.restrictions.items():
            if "hasValue" in r and "onProperty" in r:
                out.add((c, r["onProperty"], r["hasValue"]))
        return sorted(out)


def schema_of(triples: DataFrame, owl: bool) -> Schema:
    df = triples.where(F.col("p").isin(SCHEMA_PREDICATES) | ((F.col("p") == TYPE) & F.col("o").isin(SCHEMA_TYPES))).select("s", "p", "o")
    return Schema([tuple(r) for r in _few(df)], owl)


def _table(spark: SparkSession, rows, names: str) -> DataFrame | None:
    """Rule rows as a table.  It comes from the driver, so its size is known: small ones are broadcast, which keeps the
    data where it is instead of shuffling it by a few predicates."""
    rows = list(rows)
    if not rows:
        return None
    df = spark.createDataFrame(rows, ", ".join(f"{n} {'int' if isinstance(x, int) else 'string'}" for n, x in zip(names.split(), rows[0])))
    return F.broadcast(df) if sum(len(str(x)) for r in rows for x in r) <= RULE_TEXT else df


def _emit(delta: DataFrame, everything: DataFrame, schema: Schema, spark: SparkSession, tables: dict) -> list[DataFrame]:
    """What one round of rules derives with at least one triple of ``delta``."""
    out: list[DataFrame] = []
    if tables["p"] is not None:
        hit = delta.join(tables["p"], "p")
        what, q = F.col("what"), F.col("q")
        ends = hit.select(
            F.when(what.isin("swap", "object"), F.col("o")).otherwise(F.col("s")).alias("s"),
            F.when(what.isin("same", "swap"), q).otherwise(F.lit(TYPE)).alias("p"),
            F.when(what == "same", F.col("o")).when(what == "swap", F.col("s")).otherwise(q).alias("o"),
        )
        out.append(ends.where(~terms.is_literal(F.col("s"))))
    types = delta.where(F.col("p") == TYPE).select("s", F.col("o").alias("c"))
    if tables["c"] is not None:
        out.append(types.join(tables["c"], "c").select("s", F.col("q").alias("p"), F.col("v").alias("o")))
    if not schema.owl:
        return out
    all_types = everything.where(F.col("p") == TYPE).select("s", F.col("o").alias("c"))
    if tables["hv"] is not None:  # value -> restriction
        out.append(delta.join(tables["hv"], ["p", "o"]).select("s", F.lit(TYPE).alias("p"), F.col("c").alias("o")))
    if tables["int"] is not None:  # member of every part
        touched = types.join(tables["int"], "c").select("s", "whole").distinct()
        have = touched.join(tables["int"], "whole").join(all_types.distinct(), ["s", "c"]).groupBy("s", "whole", "n").agg(F.count("*").alias("k"))
        out.append(have.where("k = n").select("s", F.lit(TYPE).alias("p"), F.col("whole").alias("o")))
    if tables["svf"] is not None:  # u p v, v a d => u a c
        for edges, kinds in ((delta, all_types), (everything, types)):
            hit = edges.join(tables["svf"], "p").alias("e")
            typed = hit.where(F.col("d") != THING).join(kinds.select(F.col("s").alias("o"), F.col("c").alias("d")), ["o", "d"]).select("s", F.lit(TYPE).alias("p"), F.col("r").alias("o"))
            out.append(typed)
        out.append(delta.join(tables["svf"].where(F.col("d") == THING), "p").select("s", F.lit(TYPE).alias("p"), F.col("r").alias("o")))
    if tables["avf"] is not None:  # u a c, u p v => v a d
        for edges, kinds in ((delta, all_types), (everything, types)):
            hit = edges.join(tables["avf"], "p").join(kinds.select("s", F.col("c").alias("r")), ["s", "r"])
            out.append(hit.where(~terms.is_literal(F.col("o"))).select(F.col("o").alias("s"), F.lit(TYPE).alias("p"), F.col("d").alias("o")))
    for p, parts in schema.chains:  # any step may be new
        for k in range(len(parts)):
            step = (delta if k == 0 else everything).where(F.col("p") == parts[0]).select("s", "o")
            for j, part in enumerate(parts[1:], 1):
                nxt = (delta if k == j else everything).where(F.col("p") == part).select(F.col("s").alias("m"), F.col("o").alias("o2"))
                step = step.join(nxt, step["o"] == nxt["m"]).select("s", F.col("o2").alias("o"))
            out.append(step.select("s", F.lit(p).alias("p"), "o"))
    return out


def _same(triples: DataFrame, schema: Schema, spark: SparkSession) -> DataFrame:
    """Stated and derived equalities (s, o) between non-literals."""
    out = [triples.where(F.col("p") == SAME).select("s", "o")]
    star = lambda df, key, member: df.groupBy(*key).agg(F.collect_set(member).alias("m")).where(F.size("m") > 1).select(F.array_min("m").alias("s"), F.explode("m").alias("o")).where("s <> o")
    if schema.functional:
        own = triples.where(F.col("p").isin(sorted(schema.functional)) & ~terms.is_literal(F.col("o")))
        out.append(star(own, ["p", "s"], "o"))
    if schema.inverse_functional:
        out.append(star(triples.where(F.col("p").isin(sorted(schema.inverse_functional))), ["p", "o"], "s"))
    for c, r in schema.restrictions.items():
        if terms.lexical(r.get("maxCardinality", r.get("maxQualifiedCardinality", ""))) == "1" and "onProperty" in r:
            own = triples.where((F.col("p") == r["onProperty"]) & ~terms.is_literal(F.col("o"))).join(triples.where((F.col("p") == TYPE) & (F.col("o") == c)).select("s"), "s", "left_semi")
            if "onClass" in r and r["onClass"] != THING:
                own = own.join(triples.where((F.col("p") == TYPE) & (F.col("o") == r["onClass"])).select(F.col("s").alias("o")), "o", "left_semi")
            out.append(star(own, ["p", "s"], "o"))
    for c, key in schema.keys:
        own = triples.where((F.col("p") == TYPE) & (F.col("o") == c)).select("s")
        for k, p in enumerate(key):
            own = own.join(triples.where(F.col("p") == p).select("s", F.col("o").alias(f"k{k}")), "s")
        out.append(star(own, [f"k{k}" for k in range(len(key))], "s"))
    return reduce(DataFrame.union, out).where("s <> o").distinct()


def closure(triples: DataFrame, owl: bool = False) -> DataFrame:
    """The triples and what RDFS or OWL 2 RL entails."""
    spark = triples.sparkSession
    triples = triples.select("s", "p", "o")
    schema = schema_of(triples, owl)
    r = schema.restrictions
    tables = {
        "p": _table(spark, schema.property_rules(), "p what q"),
        "c": _table(spark, schema.class_rules(), "c q v"),
        "hv": _table(spark, [(x["onProperty"], x["hasValue"], c) for c, x in r.items() if "hasValue" in x and "onProperty" in x], "p o c"),
        "svf": _table(spark, [(x["onProperty"], x["someValuesFrom"], c) for c, x in r.items() if "someValuesFrom" in x and "onProperty" in x], "p d r"),
        "avf": _table(spark, [(x["onProperty"], x["allValuesFrom"], c) for c, x in r.items() if "allValuesFrom" in x and "onProperty" in x], "p d r"),
        "int": _table(spark, [(c, w, len(set(parts))) for w, parts in schema.intersections for c in sorted(set(parts))], "c whole n"),
    }
    base = triples
    extra = schema.entailed() + [(i, TYPE, c) for c, i in schema.one_of]
    if extra:
        base = base.union(spark.createDataFrame(extra, TRIPLE))
    delta = checkpoint(distinct(base))
    known = Grown(delta)
    #: Properties that rules derive pairs of.
    made = {q for _, what, q in schema.property_rules() if what in ("same", "swap")} | {x["onProperty"] for x in r.values() if "onProperty" in x} | {p for p, _ in schema.chains}
    equal = bool(owl) and (bool(schema.functional or schema.inverse_functional or schema.keys or any("maxCardinality" in x or "maxQualifiedCardinality" in x for x in r.values())) or not triples.where(F.col("p") == SAME).isEmpty())
    reps: DataFrame | None = None
    begun = True
    while True:
        everything = known.all()
        found = _emit(delta, everything, schema, spark, tables)
        step = reduce(DataFrame.union, found) if found else delta.limit(0)
        apart: list[DataFrame] = []
        for p in sorted(schema.transitive):
            if begun:  # closed whole
                closed = transitive(everything.where(F.col("p") == p))
                if p in made:
                    step = step.union(closed.select("s", F.lit(p).alias("p"), "o"))
                else:  # distinct, and nothing else gives such pairs: only what is stated is taken out
                    apart.append(closed.join(everything.where(F.col("p") == p).select("s", "o"), ["s", "o"], "left_anti").select("s", F.lit(p).alias("p"), "o"))
            elif p in made:  # what is known is closed but for the last round's pairs, which extend it at either end
                new, old = (df.where(F.col("p") == p).select("s", "o") for df in (delta, everything))
                for a, b in ((new, old), (old, new)):
                    step = step.union(a.alias("a").join(b.alias("b"), F.col("a.o") == F.col("b.s")).select(F.col("a.s").alias("s"), F.lit(p).alias("p"), F.col("b.o").alias("o")))
        begun = False
        grew = bool(found or apart or schema.transitive & made)
        if grew:
            delta = checkpoint(reduce(DataFrame.union, [distinct(step).join(everything, ["s", "p", "o"], "left_anti"), *apart]))
            grew = not delta.isEmpty()
        if grew:
            known.add(delta)
        if equal and not grew:
            pairs = _same(everything, schema, spark)
            if not pairs.isEmpty():
                new = checkpoint(components(pairs))
                reps = new if reps is None else checkpoint(regrouped(reps, new))
                delta = checkpoint(_renamed(everything.where(F.col("p") != SAME), new))
                known, begun, grew = Grown(delta), True, True
        if not grew:
            break
    everything = known.all()
    if reps is not None:
        everything = _members(everything, reps)
    if owl:  # rounds add only what is new, and members are of one group each; a rule's value may be no representative
        return everything.distinct() if reps is not None and any("hasValue" in x for x in r.values()) else everything
    # every term that is used is a resource, every predicate a property
    nodes = everything.select("s").union(everything.where(~terms.is_literal(F.col("o"))).select("o"))
    predicates = everything.select("p").distinct()
    facts = nodes.union(predicates).distinct().select("s", F.lit(TYPE).alias("p"), F.lit(RESOURCE).alias("o"))
    return everything.union(facts).union(predicates.select(F.col("p").alias("s"), F.lit(TYPE).alias("p"), F.lit(PROPERTY).alias("o"))).distinct()


def _renamed(triples: DataFrame, reps: DataFrame) -> DataFrame:
    """Subjects and objects replaced by their representatives."""
    a, b = reps.select(F.col("node").alias("s"), F.col("root").alias("s2")), reps.select(F.col("node").alias("o"), F.col("root").alias("o2"))
    return triples.join(a, "s", "left").join(b, "o", "left").select(F.coalesce("s2", "s").alias("s"), "p", F.coalesce("o2", "o").alias("o")).distinct()


def _members(triples: DataFrame, reps: DataFrame) -> DataFrame:
    """Triples of representatives spelled out for all members, with the equalities."""
    a, b = reps.select(F.col("root").alias("s"), F.col("node").alias("s2")), reps.select(F.col("root").alias("o"), F.col("node").alias("o2"))
    spread = triples.where(F.col("p") != SAME).join(a, "s", "left").join(b, "o", "left").select(F.coalesce("s2", "s").alias("s"), "p", F.coalesce("o2", "o").alias("o"))
    own = triples.where(F.col("p") == SAME).join(reps.select(F.col("node").alias("s")), "s", "left_anti").select("s", "p", "o")  # of nodes that equal only themselves
    return spread.union(own).union(products(reps).select("s", F.lit(SAME).alias("p"), "o"))


def inconsistencies(triples: DataFrame) -> DataFrame:
    """(rule, s, p, o): contradictions in a closed graph."""
    spark = triples.sparkSession
    schema = schema_of(triples, True)
    kinds = triples.where(F.col("p") == TYPE).select("s", F.col("o").alias("c"))
    out = [triples.where((F.col("p") == TYPE) & (F.col("o") == NOTHING)).select(F.lit("cls-nothing").alias("rule"), "s", "p", "o")]
    pairs = _table(spark, [(a, b) for a, b in schema.disjoint], "a b")
    if pairs is not None:
        out.append(kinds.join(pairs, F.col("c") == F.col("a")).select("s", "b").join(kinds.select("s", F.col("c").alias("b")), ["s", "b"]).select(F.lit("cax-dw"), "s", F.lit(TYPE), F.col("b")))
    pairs = _table(spark, schema.by[OWL_["complementOf"]], "a b")
    if pairs is not None:
        out.append(kinds.join(pairs, F.col("c") == F.col("a")).select("s", "b").join(kinds.select("s", F.col("c").alias("b")), ["s", "b"]).select(F.lit("cls-com"), "s", F.lit(TYPE), F.col("b")))
    for p in sorted(schema.types[OWL_["IrreflexiveProperty"]]):
        out.append(triples.where((F.col("p") == p) & (F.col("s") == F.col("o"))).select(F.lit("prp-irp"), "s", "p", "o"))
    for p in sorted(schema.types[OWL_["AsymmetricProperty"]]):
        own = triples.where(F.col("p") == p)
        out.append(own.join(own.select(F.col("o").alias("s"), F.col("s").alias("o")), ["s", "o"]).select(F.lit("prp-asyp"), "s", "p", "o"))
    stated = set(schema.by[OWL_["propertyDisjointWith"]])
    for p, q in sorted(schema.apart):
        rule = "prp-pdw" if (p, q) in stated else "prp-adp"
        out.append(triples.where(F.col("p") == p).join(triples.where(F.col("p") == q).select("s", "o"), ["s", "o"]).select(F.lit(rule), "s", "p", "o"))
    for c, x in schema.restrictions.items():
        if terms.lexical(x.get("maxCardinality", "")) == "0" and "onProperty" in x:
            out.append(triples.where(F.col("p") == x["onProperty"]).join(kinds.where(F.col("c") == c).select("s"), "s", "left_semi").select(F.lit("cls-maxc1"), "s", "p", "o"))
        if terms.lexical(x.get("maxQualifiedCardinality", "")) == "0" and "onProperty" in x:
            own = triples.where(F.col("p") == x["onProperty"]).join(kinds.where(F.col("c") == c).select("s"), "s", "left_semi")
            if x.get("onClass", THING) != THING:
                own = own.join(kinds.where(F.col("c") == x["onClass"]).select(F.col("s").alias("o")), "o", "left_semi")
            out.append(own.select(F.lit("cls-maxqc1" if x.get("onClass", THING) != THING else "cls-maxqc2"), "s", "p", "o"))
    parts = {n: dict(schema.by[OWL_[n]]) for n in ("sourceIndividual", "assertionProperty", "targetIndividual", "targetValue")}
    denied = [(s, parts["assertionProperty"].get(x), parts["targetIndividual"].get(x, parts["targetValue"].get(x))) for x, s in parts["sourceIndividual"].items()]
    denied_df = _table(spark, [d for d in denied if d[1] and d[2]], "s p o")
    if denied_df is not None:
        out.append(triples.join(denied_df, ["s", "p", "o"]).select(F.lit("prp-npa"), "s", "p", "o"))
    differ = triples.where(F.col("p") == OWL_["differentFrom"]).select("s", "o")
    out.append(triples.where(F.col("p") == SAME).join(differ, ["s", "o"]).select(F.lit("eq-diff1"), "s", "p", "o"))
    out.append(triples.where(~terms.well_formed(F.col("o"))).select(F.lit("dt-not-type"), "s", "p", "o"))
    literals = triples.where(F.col("p") == SAME).where(terms.is_literal(F.col("s")) & terms.is_literal(F.col("o")) & ~terms.same_value(F.col("s"), F.col("o")))
    out.append(literals.select(F.lit("dt-diff"), "s", "p", "o"))
    groups = [(x, i) for x in schema.types[OWL_["AllDifferent"]] for s, o in schema.by[OWL_["members"]] + schema.by[OWL_["distinctMembers"]] if s == x for i in schema.lists(o)]
    apart = _table(spark, groups, "x i")
    if apart is not None:
        same = triples.where((F.col("p") == SAME) & (F.col("s") != F.col("o")))
        both = same.join(apart.select(F.col("i").alias("s"), "x"), "s").join(apart.select(F.col("i").alias("o"), "x"), ["o", "x"])
        out.append(both.select(F.lit("eq-diff2"), "s", "p", "o"))
    return reduce(DataFrame.union, out).distinct()


def simplify(triples: DataFrame) -> DataFrame:
    """Without types that are owl:Thing, owl:Nothing or blank, and without reflexive equalities."""
    vague = (F.col("p") == TYPE) & (F.col("o").isin(THING, NOTHING) | terms.is_blank(F.col("o")))
    return triples.where(~vague & ~((F.col("p") == SAME) & (F.col("s") == F.col("o"))))


def most_specific(graph, classes: list[str]) -> list[str]:
    """Classes of the list that have no strict subclass in it, in order; equivalents don't count as below."""
    from ..graph import as_term

    wanted = [as_term(c) for c in classes]
    rows = _few(graph.df.where(F.col("p").isin(SUBCLASS, EQUIVALENT)).select("s", "p", "o"))
    pairs = {(s, o) for s, _, o in rows} | {(o, s) for s, p, o in rows if p == EQUIVALENT}
    below = _reach(pairs)
    return [c for c in wanted if not any((d, c) in below and (c, d) not in below for d in wanted if d != c)]


def most_specific_types(triples: DataFrame, subclass: DataFrame) -> DataFrame:
    """(s, o): types of each subject less those with a strict subclass among its types.

    ``subclass``: closed (s, o) pairs.  Classes that reach each other don't remove each other.
    """
    types = triples.where(F.col("p") == TYPE).select("s", F.col("o").alias("c")).distinct()
    strict = subclass.join(subclass.select(F.col("o").alias("s"), F.col("s").alias("o")), ["s", "o"], "left_anti").where("s <> o")
    lower = types.join(strict.select(F.col("s").alias("c"), F.col("o").alias("up")), "c").select("s", F.col("up").alias("c")).distinct()
    return types.join(lower, ["s", "c"], "left_anti").select("s", F.col("c").alias("o"))


def expand(graph, profile: str, ontology=None, simple: bool = True, iterative: bool = True, shapes=None, vbis=None, backend: str | None = None):
    """Runs profiles joined by ``+`` in order: rdfs, owlrl, shacl, vbis, tags; ``all`` is owlrl+shacl+owlrl.

    ``backend`` is accepted for every name: there is one engine.  An ontology is skolemised and added first.
    """
    from ..graph import Graph

    if ontology is not None:
        graph = graph + ontology.skolemize()
    if profile == "all":
        profile = "owlrl+shacl+owlrl"
    for name in profile.split("+"):
        if name == "rdfs":
            df = closure(graph.df)
        elif name == "owlrl":
            df = closure(graph.df, owl=True)
        elif name == "shacl":
            from .shacl import infer

            df = infer(graph, shapes or graph, iterative=iterative).df
        elif name == "vbis":
            from .vbis import annotate

            df = graph.df.union(annotate(graph.df, vbis if vbis is not None else graph.df)).distinct()
        elif name == "tags":
            from .tags import expand_tags, lookup_table

            df = graph.df.union(expand_tags(graph.df, lookup_table(graph.df))).distinct()
        else:
            raise ValueError(f"unknown profile: {name}")
        graph = Graph(simplify(df) if simple else df, graph.prefixes)
    return graph
