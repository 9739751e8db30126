"""Tables as graphs: declarative mappings of DataFrames to triples, and delimited files."""

from __future__ import annotations

import re
from collections.abc import Iterable
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.terms import lexical, to_literal, typed
from ..namespaces import DATA, TYPE


def entity(kind: str, key: Column) -> Column:
    """IRI ``<urn:tessera:data/kind/key>`` of a row."""
    return F.concat(F.lit(f"<{DATA}{kind}/"), key.cast("string"), F.lit(">"))


def value(c: Column, kind: str = "string") -> Column:
    return to_literal(c) if kind == "string" else typed(c, kind)


class Node:
    """Where a term of a mapped row comes from: any column expression that is a term."""

    before: str | None = None  # text before the bare key of an IRI that is nothing but a key in brackets

    def __init__(self, column: Column, nullable: bool = True):
        self.column, self.nullable = column, nullable

    def term(self) -> Column:
        return self.column

    def present(self) -> Column:
        return self.column.isNotNull()

    def equals(self, term: str) -> Column | None:
        """Rows whose term is a constant; None if no row's can be."""
        return self.term() == F.lit(term)


class Fixed(Node):
    """The same term in every row."""

    def __init__(self, text: str):
        super().__init__(F.lit(text), False)
        self.text = text

    def equals(self, term: str) -> Column | None:
        return F.lit(True) if term == self.text else None


class Key(Node):
    """IRI of an entity by an integer column: joins and filters work on the bare integer, the scan prunes by it."""

    def __init__(self, kind: str, name: str):
        super().__init__(entity(kind, F.col(name)))
        self.name, self.before = name, f"<{DATA}{kind}/"

    def bare(self) -> Column:
        return F.col(self.name).cast("bigint")

    def present(self) -> Column:
        return F.col(self.name).isNotNull()

    def equals(self, term: str) -> Column | None:
        key = term.removeprefix(self.before).removesuffix(">")
        if not (term.startswith(self.before) and re.fullmatch("0|-?[1-9][0-9]{0,17}", key)):
            return None
        return F.col(self.name) == F.lit(int(key))


class Text(Node):
    """Plain literal of a string column: constants are compared with the bare text, so filters reach the scan."""

    def __init__(self, name: str):
        super().__init__(to_literal(F.col(name)))
        self.name = name

    def present(self) -> Column:
        return F.col(self.name).isNotNull()

    def equals(self, term: str) -> Column | None:
        return F.col(self.name) == F.lit(lexical(term)) if re.fullmatch('"[^"\\\\]*"', term) else self.term() == F.lit(term)


@dataclass
class Mapping:
    """A table as triples: its rows' subject and properties.  ``unique``: no two rows have one subject."""

    df: DataFrame
    kind: str
    subject: Node
    properties: dict[str, Node]
    unique: bool = False


def mapped(*mappings: Mapping) -> DataFrame:
    """Triples of mapped tables; queries over the very DataFrame fold the patterns of one subject into one scan."""
    out = reduce(DataFrame.union, [triples_of(m.df, m.subject.term(), [(p, o.term()) for p, o in m.properties.items()]) for m in mappings])
    out.mapping = list(mappings)
    return out


def triples_of(df: DataFrame, subject: Column, properties: Iterable[tuple[str, Column]]) -> DataFrame:
    """(s, p, o) of each row and property; null subjects and objects give no triple.

    One branch a property: a pattern with a constant predicate then keeps only its own branch, so the scan
    reads just that property's columns.
    """
    parts = [df.select(subject.alias("s"), F.lit(p).alias("p"), o.alias("o")).where(F.col("s").isNotNull() & F.col("o").isNotNull()) for p, o in properties]
    return reduce(DataFrame.union, parts)


def prop(name: str) -> str:
    return TYPE if name == "a" else f"<{DATA}{name}>"


def read_table(spark: SparkSession, path: str, sep: str = ",") -> DataFrame:
    """CSV or TSV with a header; all columns are strings, header names and nothing else are trimmed."""
    df = spark.read.option("header", True).option("inferSchema", False).option("sep", sep).csv(path)
    return df.toDF(*[c.strip() for c in df.columns])


def rows_after_header(df: DataFrame, header_start: str) -> DataFrame:
    """Rows below the first row (not the very first) whose first cell contains ``header_start``, named by it.

    ``df`` has the columns c0, c1, ... and ``line``, its position.  Composite headers ``A/B`` become columns
    A and B with the value's parts; rows that are titles (only a first cell) or empty are left out.
    """
    cells = [c for c in df.columns if c != "line"]
    header = df.where((F.col("line") > 0) & F.contains(cells[0], F.lit(header_start))).orderBy("line").limit(1).collect()
    if not header:
        return df.limit(0).drop("line")
    head = header[0]
    out = []
    for c in cells:
        name = (head[c] or "").strip()
        names = [x.strip() for x in name.split("/")] if name else []
        for k, n in enumerate(names):
            out.append((F.try_element_at(F.split(F.col(c), "/"), F.lit(k + 1)) if len(names) > 1 else F.col(c)).alias(n))
    filled = reduce(lambda a, b: a + b, [F.when(F.length(F.trim(F.coalesce(F.col(c), F.lit("")))) > 0, 1).otherwise(0) for c in cells])
    return df.where((F.col("line") > head["line"]) & (filled > 1)).select(*out)
