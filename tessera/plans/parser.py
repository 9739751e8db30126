"""SPARQL 1.1 parser: text to plain tuples.

Terms are ``("var", name)`` or ``("term", canonical string)``.  Group elements:
``("bgp", triples)``, ``("optional", group)``, ``("union", groups)``, ``("minus", group)``, ``("filter", expr)``,
``("bind", expr, var)``, ``("values", vars, rows)``, ``("graph", term, group)``, ``("select", query)``, ``("group", group)``.
Paths: ``("iri", t)``, ``("inv", p)``, ``("seq", ps)``, ``("alt", ps)``, ``("star" | "plus" | "opt", p)``, ``("neg", forward, backward)``.
"""

from __future__ import annotations

import re
from dataclasses import dataclass, field

from ..functions.terms import escape, unescape
from ..namespaces import FIRST, NIL, PREFIXES, REST, TYPE, XSD

TOKEN = re.compile(
    r"""(?P<skip>\s+|\#[^\n]*)
   |(?P<iri><[^<>"{}|^`\\\s]*>)
   |(?P<var>[?$]\w+)
   |(?P<string>\"\"\"(?:[^"\\]|\\.|"(?!""))*\"\"\"|'''(?:[^'\\]|\\.|'(?!''))*'''|"(?:[^"\\\n]|\\.)*"|'(?:[^'\\\n]|\\.)*')
   |(?P<lang>@[A-Za-z]+(?:-[A-Za-z0-9]+)*)
   |(?P<number>(?:\d+\.\d*|\.\d+|\d+)[eE][+-]?\d+|\d*\.\d+|\d+)
   |(?P<blank>_:[\w.-]*\w)
   |(?P<pname>(?:[A-Za-z][\w-]*(?:\.[\w-]+)*)?:(?:(?:[\w:%-]|\\.)(?:(?:[\w:%.-]|\\.)*(?:[\w:%-]|\\.))?)?)
   |(?P<word>[A-Za-z_]\w*)
   |(?P<op>\^\^|&&|\|\||!=|<=|>=|[{}()\[\].;,|/^*+?!=<>-])""",
    re.X | re.S,
)
AGGREGATES = {"COUNT", "SUM", "MIN", "MAX", "AVG", "SAMPLE", "GROUP_CONCAT"}


@dataclass
class Query:
    form: str  # SELECT, CONSTRUCT, ASK, DESCRIBE
    select: list = field(default_factory=list)  # (name, expr or None); empty: all
    distinct: bool = False
    where: list = field(default_factory=list)
    template: list = field(default_factory=list)
    group: list | None = None  # (name, expr)
    having: list = field(default_factory=list)
    order: list = field(default_factory=list)  # (expr, descending)
    limit: int | None = None
    offset: int = 0
    named: list = field(default_factory=list)
    default: list = field(default_factory=list)


@dataclass
class Update:
    kind: str  # INSERT DATA, DELETE DATA, MODIFY, CLEAR
    delete: list = field(default_factory=list)  # (graph or None, s, p, o)
    insert: list = field(default_factory=list)
    where: list = field(default_factory=list)
    graph: tuple | None = None
    target: str = ""


class Parser:
    def __init__(self, text: str, prefixes: dict[str, str] | None = None):
        self.prefixes = PREFIXES | (prefixes or {})
        self.base, self.blanks, self.at = "", 0, 0
        self.tokens: list[tuple[str, str]] = []
        pos = 0
        while pos < len(text):
            m = TOKEN.match(text, pos)
            if not m:
                raise ValueError(f"cannot read query at: {text[pos : pos + 40]!r}")
            if m.lastgroup != "skip":
                self.tokens.append((m.lastgroup, m[0]))
            pos = m.end()
        self.tokens.append(("end", ""))

    # tokens

    def peek(self, *words: str) -> bool:
        kind, text = self.tokens[self.at]
        return (text.upper() if kind == "word" else text) in words and kind in ("word", "op")

    def take(self, *words: str) -> str | None:
        if self.peek(*words):
            self.at += 1
            return self.tokens[self.at - 1][1].upper()
        return None

    def need(self, *words: str) -> str:
        got = self.take(*words)
        if got is None:
            raise ValueError(f"expected {' or '.join(words)}, found {self.tokens[self.at][1]!r}")
        return got

    def kind(self) -> str:
        return self.tokens[self.at][0]

    def next(self) -> str:
        self.at += 1
        return self.tokens[self.at - 1][1]

    def fresh(self) -> tuple:
        self.blanks += 1
        return ("var", f".b{self.blanks}")

    # terms

    def resolve(self, kind: str, text: str) -> str:
        if kind == "iri":
            return text if ":" in text or not self.base else f"<{self.base}{text[1:-1]}>"
        head, _, tail = text.partition(":")
        if head not in self.prefixes:
            raise ValueError(f"unknown prefix: {head}")
        return f"<{self.prefixes[head]}{re.sub(r'[\\](.)', r'\1', tail)}>"

    def iri(self) -> str:
        kind = self.kind()
        if kind not in ("iri", "pname"):
            raise ValueError(f"expected an IRI, found {self.tokens[self.at][1]!r}")
        return self.resolve(kind, self.next())

    def literal(self) -> str | None:
        kind, text = self.tokens[self.at]
        if kind == "string":
            self.at += 1
            inner = text[3:-3] if text[:3] in ('"""', "'''") else text[1:-1]
            body = f'"{escape(unescape(inner))}"'
            if self.kind() == "lang":
                return body + self.next().lower()
            if self.take("^^"):
                given = self.iri()
                return body if given == f"<{XSD}string>" else f"{body}^^{given}"
            return body
        sign = ""
        if kind == "op" and text in "+-" and self.tokens[self.at + 1][0] == "number":
            sign, self.at = text.strip("+"), self.at + 1
            kind, text = self.tokens[self.at]
        if kind == "number":
            self.at += 1
            name = "double" if "e" in text.lower() else "decimal" if "." in text else "integer"
            return f'"{sign}{text}"^^<{XSD}{name}>'
        if kind == "word" and text.lower() in ("true", "false"):
            self.at += 1
            return f'"{text.lower()}"^^<{XSD}boolean>'
        return None

    def term(self, triples: list) -> tuple:
        """A term; nested blank nodes and lists add to ``triples``."""
        kind = self.kind()
        if kind == "var":
            return ("var", self.next()[1:])
        if kind in ("iri", "pname"):
            return ("term", self.iri())
        if kind == "blank":
            return ("var", ".l" + self.next()[2:])
        if self.take("["):
            node = self.fresh()
            if not self.peek("]"):
                self.properties(node, triples)
            self.need("]")
            return node
        if self.take("("):
            items = []
            while not self.take(")"):
                items.append(self.term(triples))
            head: tuple = ("term", NIL)
            for item in reversed(items):
                node = self.fresh()
                triples += [(node, ("iri", FIRST), item), (node, ("iri", REST), head)]
                head = node
            return head
        got = self.literal()
        if got is None:
            raise ValueError(f"expected a term, found {self.tokens[self.at][1]!r}")
        return ("term", got)

    def properties(self, subject: tuple, triples: list) -> None:
        while True:
            if self.kind() == "var":
                path: tuple = ("var", self.next()[1:])
            else:
                path = self.path()
            while True:
                triples.append((subject, path, self.term(triples)))
                if not self.take(","):
                    break
            while self.take(";"):
                pass
            if self.tokens[self.at - 1][1] != ";" or self.peek(".", "}", "]"):
                return

    def path(self) -> tuple:
        parts = [self.sequence()]
        while self.take("|"):
            parts.append(self.sequence())
        return parts[0] if len(parts) == 1 else ("alt", parts)

    def sequence(self) -> tuple:
        parts = [self.step()]
        while self.take("/"):
            parts.append(self.step())
        return parts[0] if len(parts) == 1 else ("seq", parts)

    def step(self) -> tuple:
        back = self.take("^")
        if self.take("!"):
            ahead, behind = [], []
            closing = self.take("(")
            while True:
                (behind if self.take("^") else ahead).append(TYPE if self.tokens[self.at] == ("word", "a") and self.next() else self.iri())
                if not closing or not self.take("|"):
                    break
            if closing:
                self.need(")")
            out: tuple = ("neg", ahead, behind)
        elif self.take("("):
            out = self.path()
            self.need(")")
        elif self.tokens[self.at] == ("word", "a"):
            self.next()
            out = ("iri", TYPE)
        else:
            out = ("iri", self.iri())
        more = self.take("*", "+", "?")
        if more:
            out = ({"*": "star", "+": "plus", "?": "opt"}[more], out)
        return ("inv", out) if back else out

    # patterns

    def triples(self, stop: tuple[str, ...] = ("}",)) -> list:
        out: list = []
        while not self.peek("{", *stop) and self.kind() not in ("word", "end") or self.tokens[self.at][1].lower() in ("true", "false"):
            subject = self.term(out)
            if not self.peek(".", "}"):
                self.properties(subject, out)
            if not self.take("."):
                break
        return out

    def group(self) -> list:
        self.need("{")
        if self.peek("SELECT"):
            out = [("select", self.select())]
            self.need("}")
            return out
        out = []
        while not self.take("}"):
            if self.take("."):
                continue
            if self.take("OPTIONAL"):
                out.append(("optional", self.group()))
            elif self.take("MINUS"):
                out.append(("minus", self.group()))
            elif self.take("FILTER"):
                out.append(("filter", self.constraint()))
            elif self.take("BIND"):
                self.need("(")
                e = self.expr()
                self.need("AS")
                out.append(("bind", e, self.next()[1:]))
                self.need(")")
            elif self.take("VALUES"):
                out.append(self.values())
            elif self.take("GRAPH"):
                out.append(("graph", self.term([]), self.group()))
            elif self.peek("{"):
                parts = [self.group()]
                while self.take("UNION"):
                    parts.append(self.group())
                out.append(("union", parts) if len(parts) > 1 else ("group", parts[0]))
            else:
                before = self.at
                out.append(("bgp", self.triples()))
                if self.at == before:
                    raise ValueError(f"cannot read pattern at {self.tokens[self.at][1]!r}")
        return out

    def values(self) -> tuple:
        names, rows = [], []
        many = self.take("(")
        while self.kind() == "var":
            names.append(self.next()[1:])
            if not many:
                break
        if many:
            self.need(")")
        self.need("{")
        while not self.take("}"):
            if many:
                self.need("(")
            row = [None if self.take("UNDEF") else self.term([])[1] for _ in names]
            if many:
                self.need(")")
            rows.append(tuple(row))
        return ("values", names, rows)

    # expressions

    def constraint(self) -> tuple:
        if self.take("("):
            e = self.expr()
            self.need(")")
            return e
        return self.primary()

    def expr(self) -> tuple:
        out = self.conjunction()
        while self.take("||"):
            out = ("or", out, self.conjunction())
        return out

    def conjunction(self) -> tuple:
        out = self.relation()
        while self.take("&&"):
            out = ("and", out, self.relation())
        return out

    def relation(self) -> tuple:
        left = self.sum()
        op = self.take("=", "!=", "<", ">", "<=", ">=")
        if op:
            return ("cmp", op, left, self.sum())
        negated = self.take("NOT")
        if negated or self.peek("IN"):
            self.need("IN")
            e = ("in", left, self.arguments())
            return ("not", e) if negated else e
        return left

    def sum(self) -> tuple:
        out = self.product()
        while op := self.take("+", "-"):
            out = ("math", op, out, self.product())
        return out

    def product(self) -> tuple:
        out = self.unary()
        while op := self.take("*", "/"):
            out = ("math", op, out, self.unary())
        return out

    def unary(self) -> tuple:
        if self.take("!"):
            return ("not", self.unary())
        if self.peek("-", "+") and self.tokens[self.at + 1][0] != "number":
            return ("math", self.take("-", "+"), ("term", f'"0"^^<{XSD}integer>'), self.unary())
        return self.primary()

    def arguments(self) -> list:
        self.need("(")
        out = []
        while not self.take(")"):
            out.append(self.expr())
            self.take(",")
        return out

    def primary(self) -> tuple:
        if self.take("("):
            e = self.expr()
            self.need(")")
            return e
        if self.kind() == "var":
            return ("var", self.next()[1:])
        if self.take("EXISTS"):
            return ("exists", self.group())
        if self.peek("NOT"):
            self.next()
            self.need("EXISTS")
            return ("not", ("exists", self.group()))
        got = self.literal()
        if got is not None:
            return ("term", got)
        if self.kind() == "word":
            name = self.next().upper()
            if name in AGGREGATES:
                self.need("(")
                distinct, separator = bool(self.take("DISTINCT")), " "
                inner = None if self.take("*") else self.expr()
                if self.take(";"):
                    self.need("SEPARATOR")
                    self.need("=")
                    separator = unescape(self.next()[1:-1])
                self.need(")")
                return ("agg", name, distinct, inner, separator)
            return ("call", name, self.arguments())
        name = self.iri()
        return ("call", name, self.arguments()) if self.peek("(") else ("term", name)

    # queries

    def prologue(self) -> None:
        while self.take("PREFIX") or self.peek("BASE"):
            if self.take("BASE"):
                self.base = self.next()[1:-1]
                continue
            name = self.next()[:-1]
            self.prefixes = self.prefixes | {name: self.next()[1:-1]}

    def select(self) -> Query:
        self.need("SELECT")
        q = Query("SELECT", distinct=bool(self.take("DISTINCT", "REDUCED")))
        if not self.take("*"):
            while self.kind() == "var" or self.peek("("):
                if self.take("("):
                    e = self.expr()
                    self.need("AS")
                    q.select.append((self.next()[1:], e))
                    self.need(")")
                else:
                    q.select.append((self.next()[1:], None))
        return self.rest(q)

    def rest(self, q: Query) -> Query:
        while self.take("FROM"):
            (q.named if self.take("NAMED") else q.default).append(self.iri())
        self.take("WHERE")
        if self.peek("{"):
            q.where = self.group()
        if self.take("GROUP"):
            self.need("BY")
            q.group = []
            while self.kind() in ("var", "iri", "pname") or self.peek("(") or self.kind() == "word" and not self.peek("HAVING", "ORDER", "LIMIT", "OFFSET", "VALUES"):
                if self.take("("):
                    e = self.expr()
                    q.group.append((self.next()[1:] if self.take("AS") else f".g{len(q.group)}", e))
                    self.need(")")
                else:
                    e = self.primary()
                    q.group.append((e[1] if e[0] == "var" else f".g{len(q.group)}", e))
        if self.take("HAVING"):
            while self.peek("(") or self.kind() == "word" and not self.peek("ORDER", "LIMIT", "OFFSET", "VALUES"):
                q.having.append(self.constraint())
        if self.take("ORDER"):
            self.need("BY")
            while self.kind() == "var" or self.peek("(", "ASC", "DESC") or self.kind() == "word" and not self.peek("LIMIT", "OFFSET", "VALUES"):
                down = self.take("ASC", "DESC") == "DESC"
                q.order.append((self.constraint() if self.peek("(") else self.primary(), down))
        while word := self.take("LIMIT", "OFFSET"):
            setattr(q, word.lower(), int(self.next()))
        if self.take("VALUES"):
            q.where = q.where + [self.values()]
        return q

    def query(self) -> Query:
        self.prologue()
        if self.peek("SELECT"):
            q = self.select()
        elif self.take("CONSTRUCT"):
            q = Query("CONSTRUCT")
            short = not self.peek("{")
            if not short:
                self.need("{")
                q.template = self.triples()
                self.need("}")
            q = self.rest(q)
            if short:
                q.template = [t for e in q.where for t in e[1]]
        elif self.take("ASK"):
            q = self.rest(Query("ASK"))
        else:
            self.need("DESCRIBE")
            q = Query("DESCRIBE")
            while self.kind() in ("var", "iri", "pname"):
                q.template.append(self.term([]))
            self.take("*")
            q = self.rest(q)
        if self.kind() != "end":
            raise ValueError(f"unexpected {self.tokens[self.at][1]!r}")
        return q

    def quads(self) -> list:
        self.need("{")
        out = []
        while not self.take("}"):
            if self.take("."):
                continue
            if self.take("GRAPH"):
                name = self.term([])
                self.need("{")
                out += [(name, *t) for t in self.triples()]
                self.need("}")
            else:
                before = self.at
                out += [(None, *t) for t in self.triples(("}", "GRAPH"))]
                if self.at == before:
                    raise ValueError(f"cannot read template at {self.tokens[self.at][1]!r}")
        return out

    def update(self) -> list[Update]:
        out = []
        while True:
            self.prologue()
            if self.kind() == "end":
                return out
            if self.take("CLEAR", "DROP"):
                self.take("SILENT")
                word = self.take("DEFAULT", "NAMED", "ALL")
                out.append(Update("CLEAR", target=word or (self.take("GRAPH") and "") or self.iri()))
            else:
                u = Update("MODIFY")
                if self.take("WITH"):
                    u.graph = ("term", self.iri())
                if self.take("DELETE"):
                    if self.take("DATA"):
                        u.kind, u.delete = "DELETE DATA", self.quads()
                    elif self.take("WHERE"):
                        u.delete = self.quads()
                        u.where = [("graph", g, [("bgp", [(s, p, o)])]) if g else ("bgp", [(s, p, o)]) for g, s, p, o in u.delete]
                        out.append(u)
                        self.take(";")
                        continue
                    else:
                        u.delete = self.quads()
                if u.kind == "MODIFY" and self.take("INSERT"):
                    if self.take("DATA"):
                        u.kind, u.insert = "INSERT DATA", self.quads()
                    else:
                        u.insert = self.quads()
                if u.kind == "MODIFY":
                    while self.take("USING"):
                        self.take("NAMED")
                        self.iri()
                    self.need("WHERE")
                    u.where = self.group()
                out.append(u)
            if not self.take(";") and self.kind() != "end":
                raise ValueError(f"unexpected {self.tokens[self.at][1]!r}")
