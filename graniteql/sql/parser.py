"""Text of the dialect -> syntax tree.

A recursive-descent parser of the supported subset. What is left out on purpose raises ``SqlError`` here, with
the words that were read.
"""

from __future__ import annotations

import re
from dataclasses import dataclass, field
from typing import Any


class SqlError(ValueError):
    """The text isn't in the dialect."""


_TOKEN = re.compile(
    r"""(?P<space>\s+|--[^\n]*|/\*.*?\*/)
  | (?P<hex>[xX]'[0-9A-Fa-f]*')
  | (?P<string>'(?:[^']|'')*')
  | (?P<quoted>"(?:[^"]|"")*")
  | (?P<number>\d+(?:\.\d*)?(?:[eE][+-]?\d+)?|\.\d+(?:[eE][+-]?\d+)?)
  | (?P<param>\?|\$\d+)
  | (?P<name>[A-Za-z_\u0080-￿][A-Za-z0-9_$\u0080-￿]*)
  | (?P<op>::|<>|!=|<=|>=|\|\||=>|:=|[-+*/%(),.;<>=\[\]:])""",
    re.X | re.S,
)

RESERVED = set(
    "SELECT FROM WHERE GROUP HAVING QUALIFY WINDOW ORDER LIMIT OFFSET FETCH UNION INTERSECT EXCEPT ON USING JOIN INNER LEFT RIGHT FULL OUTER CROSS NATURAL SEMI ANTI AND OR NOT CASE WHEN THEN ELSE END AS WITH DISTINCT ALL IN IS LIKE BETWEEN EXISTS CAST RETURNING SET VALUES BY INTO WHEN".split()
)


@dataclass
class Token:
    kind: str
    text: str
    at: int

    @property
    def upper(self) -> str:
        return self.text.upper() if self.kind == "name" else self.text


@dataclass
class Node:
    """A piece of syntax: its kind and parts; src is the text it was read from."""

    kind: str
    parts: dict[str, Any] = field(default_factory=dict)
    src: str = ""

    def __getattr__(self, name: str) -> Any:
        try:
            return self.__dict__["parts"][name]
        except KeyError:
            raise AttributeError(name) from None


def N(kind: str, **parts: Any) -> Node:
    return Node(kind, parts)


def tokens(text: str) -> list[Token]:
    out, at = [], 0
    while at < len(text):
        m = _TOKEN.match(text, at)
        if not m:
            raise SqlError(f"unexpected character {text[at]!r} at {at}")
        if m.lastgroup != "space":
            out.append(Token(m.lastgroup or "", m[0], at))
        at = m.end()
    return out


class Parser:
    def __init__(self, text: str):
        self.text, self.toks, self.i = text, tokens(text), 0
        self.params = 0

    # --- tokens

    def peek(self, k: int = 0) -> Token:
        return self.toks[self.i + k] if self.i + k < len(self.toks) else Token("end", "", len(self.text))

    def at(self, *words: str) -> bool:
        return all(self.peek(k).upper == w and self.peek(k).kind != "quoted" for k, w in enumerate(words))

    def take(self, *words: str) -> bool:
        if self.at(*words):
            self.i += len(words)
            return True
        return False

    def need(self, *words: str) -> None:
        if not self.take(*words):
            self.fail(f"expected {' '.join(words)}")

    def fail(self, why: str) -> None:
        t = self.peek()
        raise SqlError(f"{why}, found {t.text or 'the end'!r} at {t.at}")

    def next(self) -> Token:
        self.i += 1
        return self.toks[self.i - 1] if self.i <= len(self.toks) else self.peek()

    def source(self, start: int) -> str:
        low = self.toks[start].at
        last = self.toks[self.i - 1]
        return self.text[low : last.at + len(last.text)]

    def name(self, what: str = "a name") -> str:
        t = self.peek()
        if t.kind == "quoted":
            self.i += 1
            return t.text[1:-1].replace('""', '"')
        if t.kind == "name" and t.upper not in RESERVED:
            self.i += 1
            return t.text
        self.fail(f"expected {what}")
        raise AssertionError

    def names(self) -> list[str]:
        """( name, ... )"""
        self.need("(")
        out = [self.name()]
        while self.take(","):
            out.append(self.name())
        self.need(")")
        return out

    def dotted(self) -> list[str]:
        out = [self.name()]
        while self.take("."):
            out.append(self.name())
        return out

    def string(self) -> str:
        t = self.next()
        if t.kind != "string":
            self.i -= 1
            self.fail("expected a string")
        return t.text[1:-1].replace("''", "'")

    def number(self) -> int:
        t = self.next()
        if t.kind != "number" or not t.text.isdigit():
            self.i -= 1
            self.fail("expected a whole number")
        return int(t.text)

    # --- queries

    def whole_query(self) -> Node:
        q = self.query()
        self.take(";")
        if self.peek().kind != "end":
            self.fail("expected the end of the statement")
        return q

    def query(self) -> Node:
        ctes: list[tuple[str, list[str] | None, Node]] = []
        if self.take("WITH"):
            if self.at("RECURSIVE"):
                self.fail("recursive queries aren't supported")
            while True:
                name = self.name()
                columns = self.names() if self.at("(") else None
                self.need("AS")
                self.need("(")
                if name.lower() in [c[0].lower() for c in ctes]:
                    raise SqlError(f"duplicate name {name} in WITH")
                ctes.append((name, columns, self.query()))
                self.need(")")
                if not self.take(","):
                    break
        body = self.set_term()
        order = self.order_by() if self.take("ORDER", "BY") else []
        limit, offset = self.limits()
        return N("query", ctes=ctes, body=body, order=order, limit=limit, offset=offset)

    def limits(self) -> tuple[int | None, int | None]:
        limit = offset = None
        while True:
            if self.take("LIMIT"):
                if self.take("ALL"):
                    continue
                limit = self.number()
                if self.take(","):
                    offset, limit = limit, self.number()
                if self.at("PERCENT") or self.at("%"):
                    self.fail("LIMIT takes a number of rows")
            elif self.take("OFFSET"):
                offset = self.number()
                self.take("ROWS") or self.take("ROW")
            elif self.take("FETCH"):
                if not (self.take("FIRST") or self.take("NEXT")):
                    self.fail("expected FIRST or NEXT")
                limit = 1 if self.at("ROW") or self.at("ROWS") else self.number()
                if not (self.take("ROWS") or self.take("ROW")):
                    self.fail("expected ROWS")
                self.need("ONLY")
            else:
                return limit, offset

    def order_by(self) -> list[Node]:
        out = []
        while True:
            if self.at("ALL"):
                self.fail("ORDER BY ALL isn't supported")
            e = self.expr()
            down = self.take("DESC")
            if not down:
                self.take("ASC")
            first = None
            if self.take("NULLS"):
                first = self.take("FIRST")
                if not first:
                    self.need("LAST")
            out.append(N("key", e=e, desc=down, nulls_first=bool(first)))
            if not self.take(","):
                return out

    def set_term(self) -> Node:
        left = self.set_factor()
        while self.at("UNION") or self.at("EXCEPT"):
            left = self.set_op(left, self.set_factor)
        return left

    def set_factor(self) -> Node:
        left = self.set_primary()
        while self.at("INTERSECT"):
            left = self.set_op(left, self.set_primary)
        return left

    def set_op(self, left: Node, right) -> Node:
        op = self.next().upper
        every = self.take("ALL")
        if not every:
            self.take("DISTINCT")
        if self.at("BY"):
            self.fail("set operations BY NAME aren't supported")
        return N("set", op=op, all=every, left=left, right=right())

    def set_primary(self) -> Node:
        if self.take("("):
            q = self.query()
            self.need(")")
            return N("paren", q=q)
        if self.take("VALUES"):
            rows = []
            while True:
                self.need("(")
                rows.append(self.exprs())
                self.need(")")
                if not self.take(","):
                    break
            if len({len(r) for r in rows}) != 1:
                raise SqlError("VALUES rows differ in length")
            return N("values", rows=rows)
        self.need("SELECT")
        return self.select()

    def select(self) -> Node:
        distinct = False
        if self.take("DISTINCT"):
            if self.at("ON"):
                self.fail("DISTINCT ON isn't supported")
            distinct = True
        else:
            self.take("ALL")
        if self.at("TOP") and self.peek(1).kind == "number":
            self.fail("TOP isn't supported")
        items = [self.item()]
        while self.take(","):
            items.append(self.item())
        source = where = having = qualify = None
        group: list[Node] | None = None
        windows: list[tuple[str, Node]] = []
        if self.take("FROM"):
            source = [self.table_ref()]
            while self.take(","):
                source.append(self.table_ref())
        if self.take("WHERE"):
            where = self.expr()
        if self.take("GROUP", "BY"):
            if self.at("ALL"):
                self.fail("GROUP BY ALL isn't supported")
            group = [self.group_item()]
            while self.take(","):
                group.append(self.group_item())
        if self.take("HAVING"):
            having = self.expr()
        if self.take("WINDOW"):
            while True:
                name = self.name()
                self.need("AS")
                windows.append((name, self.window_spec()))
                if not self.take(","):
                    break
        if self.take("QUALIFY"):
            qualify = self.expr()
        return N("select", distinct=distinct, items=items, source=source, where=where, group=group, having=having, windows=windows, qualify=qualify)

    def item(self) -> Node:
        if self.take("*"):
            return N("item", e=N("star", table=None), alias=None)
        if self.peek().kind in ("name", "quoted") and self.peek(1).text == "." and self.peek(2).text == "*":
            table = self.name()
            self.i += 2
            return N("item", e=N("star", table=table), alias=None)
        e = self.expr()
        alias = self.name() if self.take("AS") or self.peek().kind == "quoted" or (self.peek().kind == "name" and self.peek().upper not in RESERVED) else None
        return N("item", e=e, alias=alias)

    def group_item(self) -> Node:
        for word in ("ROLLUP", "CUBE"):
            if self.at(word) and self.peek(1).text == "(":
                self.i += 2
                items = [self.grouping_set()]
                while self.take(","):
                    items.append(self.grouping_set())
                self.need(")")
                return N("grouping", how=word, sets=items)
        if self.take("GROUPING", "SETS"):
            self.need("(")
            items = [self.group_item() if self.at("ROLLUP") or self.at("CUBE") or self.at("GROUPING", "SETS") else self.grouping_set()]
            while self.take(","):
                items.append(self.group_item() if self.at("ROLLUP") or self.at("CUBE") or self.at("GROUPING", "SETS") else self.grouping_set())
            self.need(")")
            return N("grouping", how="GROUPING SETS", sets=items)
        return self.expr()

    def grouping_set(self) -> Any:
        if self.take("("):
            out = [] if self.at(")") else self.exprs()
            self.need(")")
            return out
        return [self.expr()]

    # --- FROM

    def table_ref(self) -> Node:
        left = self.table_primary()
        while True:
            if self.at("NATURAL") or self.at("CROSS"):
                self.fail("NATURAL and CROSS joins aren't supported; use a comma and WHERE")
            how = None
            if self.take("INNER"):
                how = "INNER"
            elif self.take("SEMI") or self.take("LEFT", "SEMI"):
                how = "LEFT SEMI"
            elif self.take("ANTI") or self.take("LEFT", "ANTI"):
                how = "LEFT ANTI"
            elif self.at("LEFT") or self.at("RIGHT") or self.at("FULL"):
                how = self.next().upper
                self.take("OUTER")
            elif self.at("JOIN"):
                how = "INNER"
            else:
                return left
            self.need("JOIN")
            if self.at("LATERAL"):
                self.fail("LATERAL isn't supported")
            right = self.table_primary()
            if self.take("USING"):
                left = N("join", how=how, left=left, right=right, on=None, using=self.names())
            else:
                self.need("ON")
                left = N("join", how=how, left=left, right=right, on=self.expr(), using=None)

    def table_primary(self) -> Node:
        if self.at("LATERAL") or self.at("UNNEST"):
            self.fail("LATERAL and UNNEST aren't supported")
        if self.take("("):
            save = self.i
            try:
                q = self.query()
                self.need(")")
                return self.aliased(N("derived", q=q))
            except SqlError:
                self.i = save
                inner = self.table_ref()
                self.need(")")
                return N("nested", t=inner)
        path = self.dotted()
        if self.at("("):
            return self.aliased(N("function", name=path[-1].lower(), args=self.arguments()))
        return self.aliased(N("table", path=path))

    def arguments(self) -> list[tuple[str | None, Node]]:
        self.need("(")
        out: list[tuple[str | None, Node]] = []
        while not self.take(")"):
            name = None
            if self.peek().kind == "name" and self.peek(1).text in ("=", ":=", "=>"):
                name = self.name().lower()
                self.i += 1
            out.append((name, self.expr()))
            if not self.take(",") and not self.at(")"):
                self.fail("expected , or )")
        return out

    def aliased(self, t: Node) -> Node:
        alias = columns = None
        if self.take("AS") or self.peek().kind == "quoted" or (self.peek().kind == "name" and self.peek().upper not in RESERVED):
            alias = self.name()
            if self.at("("):
                columns = self.names()
        t.parts.update(alias=alias, columns=columns)
        return t

    # --- expressions

    def exprs(self) -> list[Node]:
        out = [self.expr()]
        while self.take(","):
            out.append(self.expr())
        return out

    def expr(self) -> Node:
        start = self.i
        e = self.disjunction()
        e.src = self.source(start)
        return e

    def disjunction(self) -> Node:
        e = self.conjunction()
        while self.take("OR"):
            e = N("binary", op="OR", a=e, b=self.conjunction())
        return e

    def conjunction(self) -> Node:
        e = self.negation()
        while self.take("AND"):
            e = N("binary", op="AND", a=e, b=self.negation())
        return e

    def negation(self) -> Node:
        if self.at("NOT") and not self.at("NOT", "EXISTS"):
            self.i += 1
            return N("not", e=self.negation())
        return self.predicate()

    def predicate(self) -> Node:
        e = self.additive()
        while True:
            if self.take("IS"):
                negated = self.take("NOT")
                for word in ("NULL", "TRUE", "FALSE", "UNKNOWN"):
                    if self.take(word):
                        e = N("is", e=e, what=word, negated=negated)
                        break
                else:
                    if self.take("DISTINCT", "FROM"):
                        e = N("distinct", a=e, b=self.additive(), negated=negated)
                    else:
                        self.fail("expected NULL, TRUE, FALSE, UNKNOWN or DISTINCT FROM")
                continue
            negated = self.at("NOT") and self.peek(1).upper in ("IN", "BETWEEN", "LIKE")
            if negated:
                self.i += 1
            if self.take("IN"):
                self.need("(")
                if self.at("SELECT") or self.at("WITH") or self.at("VALUES"):
                    e = N("in_query", e=e, q=self.query(), negated=negated)
                else:
                    e = N("in", e=e, items=[] if self.at(")") else self.exprs(), negated=negated)
                self.need(")")
            elif self.take("BETWEEN"):
                low = self.additive()
                self.need("AND")
                e = N("between", e=e, low=low, high=self.additive(), negated=negated)
            elif self.take("LIKE"):
                if self.at("ANY") or self.at("ALL"):
                    self.fail("LIKE ANY and LIKE ALL aren't supported")
                pattern = self.additive()
                e = N("like", e=e, pattern=pattern, escape=self.additive() if self.take("ESCAPE") else None, negated=negated)
            elif self.at("ILIKE"):
                self.fail("ILIKE isn't supported")
            elif self.peek().text in ("=", "<>", "!=", "<", "<=", ">", ">="):
                op = self.next().text
                if self.at("ANY") or self.at("ALL") or self.at("SOME"):
                    self.fail("ANY and ALL comparisons aren't supported")
                e = N("binary", op="<>" if op == "!=" else op, a=e, b=self.additive())
            else:
                return e

    def additive(self) -> Node:
        e = self.multiplicative()
        while self.peek().text in ("+", "-", "||") and self.peek().kind == "op":
            e = N("binary", op=self.next().text, a=e, b=self.multiplicative())
        return e

    def multiplicative(self) -> Node:
        e = self.unary()
        while self.peek().text in ("*", "/", "%") and self.peek().kind == "op":
            e = N("binary", op=self.next().text, a=e, b=self.unary())
        return e

    def unary(self) -> Node:
        if self.peek().text in ("+", "-") and self.peek().kind == "op":
            return N("unary", op=self.next().text, e=self.unary())
        return self.postfix()

    def postfix(self) -> Node:
        e = self.primary()
        while True:
            if self.take("::"):
                e = N("cast", e=e, type=self.type_name())
            elif self.take("AT", "TIME", "ZONE"):
                e = N("at_zone", e=e, zone=self.primary())
            else:
                return e

    def type_name(self) -> tuple[str, list[int]]:
        words = [self.name("a type").upper()]
        for tail in (("PRECISION",), ("VARYING",), ("UNSIGNED",)):
            if self.at(*tail):
                words.append(self.next().upper)
        args: list[int] = []
        if self.take("("):
            args.append(self.number())
            while self.take(","):
                args.append(self.number())
            self.need(")")
        if self.take("WITH", "TIME", "ZONE"):
            words.append("WITH TIME ZONE")
        else:
            self.take("WITHOUT", "TIME", "ZONE")
        if words[0] == "INTERVAL" and self.peek().upper in ("YEAR", "MONTH", "DAY", "HOUR", "MINUTE", "SECOND"):
            words.append(self.next().upper)
            if self.take("TO"):
                words += ["TO", self.next().upper]
        return " ".join(words), args

    def primary(self) -> Node:
        t = self.peek()
        if t.kind == "number":
            self.i += 1
            return N("number", text=t.text)
        if t.kind == "string":
            return N("string", value=self.string())
        if t.kind == "hex":
            self.i += 1
            return N("hex", value=t.text[2:-1])
        if t.kind == "param":
            self.i += 1
            if t.text == "?":
                self.params += 1
                return N("param", index=self.params)
            return N("param", index=int(t.text[1:]))
        if self.take("("):
            if self.at("SELECT") or self.at("WITH") or self.at("VALUES"):
                e = N("scalar", q=self.query())
            else:
                e = N("group", e=self.expr())
            self.need(")")
            return e
        if t.kind == "quoted":
            return self.column()
        word = t.upper
        if word in ("NULL", "TRUE", "FALSE"):
            self.i += 1
            return N("literal", word=word)
        if self.at("NOT", "EXISTS") or word == "EXISTS":
            negated = self.take("NOT")
            self.need("EXISTS", "(")
            e = N("exists", q=self.query(), negated=negated)
            self.need(")")
            return e
        if word == "CASE":
            return self.case()
        if word in ("TRY_CAST", "SAFE_CAST") and self.peek(1).text == "(":
            self.fail("only strict casts are supported")
        if self.take("CAST", "("):
            e = self.expr()
            self.need("AS")
            kind = self.type_name()
            if self.at("FORMAT"):
                self.fail("CAST FORMAT isn't supported")
            self.need(")")
            return N("cast", e=e, type=kind)
        if word == "INTERVAL" and (self.peek(1).kind in ("string", "number") or self.peek(1).text == "-"):
            return self.interval()
        if word in ("DATE", "TIMESTAMP", "TIME", "TIMESTAMPTZ") and self.peek(1).kind == "string":
            self.i += 1
            return N("cast", e=N("string", value=self.string()), type=(word, []))
        if self.take("EXTRACT", "("):
            part = self.string() if self.peek().kind == "string" else self.name()
            self.need("FROM")
            e = N("call", name="date_part", args=[N("string", value=part.lower()), self.expr()], distinct=False, filter=None, over=None, star=False)
            self.need(")")
            return e
        if self.take("TRIM", "("):
            side = next((w for w in ("BOTH", "LEADING", "TRAILING") if self.take(w)), None)
            if side and self.take("FROM"):
                args = [self.expr()]
            else:
                args = [self.expr()]
                if self.take("FROM"):
                    args = [self.expr(), args[0]]
                elif self.take(","):
                    args.append(self.expr())
            self.need(")")
            name = {"LEADING": "ltrim", "TRAILING": "rtrim"}.get(side or "", "trim")
            return N("call", name=name, args=args, distinct=False, filter=None, over=None, star=False)
        if word in ("SUBSTRING", "SUBSTR") and self.peek(1).text == "(":
            self.i += 2
            args = [self.expr()]
            if self.take("FROM"):
                args.append(self.expr())
                if self.take("FOR"):
                    args.append(self.expr())
            else:
                while self.take(","):
                    args.append(self.expr())
            self.need(")")
            return N("call", name="substring", args=args, distinct=False, filter=None, over=None, star=False)
        if self.peek(1).text == "(" and t.kind == "name" and word not in RESERVED:
            return self.call()
        return self.column()

    def column(self) -> Node:
        return N("column", path=self.dotted())

    def case(self) -> Node:
        self.need("CASE")
        operand = None if self.at("WHEN") else self.expr()
        arms = []
        while self.take("WHEN"):
            w = self.expr()
            self.need("THEN")
            arms.append((w, self.expr()))
        other = self.expr() if self.take("ELSE") else None
        self.need("END")
        if not arms:
            raise SqlError("CASE without WHEN")
        return N("case", operand=operand, arms=arms, other=other)

    def interval(self) -> Node:
        self.need("INTERVAL")
        sign = "-" if self.take("-") else ""
        value = sign + (self.string() if self.peek().kind == "string" else self.next().text)
        low = high = None
        word = self.peek().upper.rstrip("S")
        if word in ("YEAR", "MONTH", "WEEK", "DAY", "HOUR", "MINUTE", "SECOND"):
            self.i += 1
            low = word
            if self.take("TO"):
                high = self.next().upper
        return N("interval", value=value, low=low, high=high)

    def call(self) -> Node:
        name = self.name().lower()
        self.need("(")
        distinct, star, args, order = False, False, [], False
        if self.take("*"):
            star = True
        elif not self.at(")"):
            distinct = self.take("DISTINCT")
            if not distinct:
                self.take("ALL")
            args = self.exprs()
            if name in ("ceil", "ceiling", "floor") and self.take("TO"):
                self.name()
            if self.take("ORDER", "BY"):
                self.order_by()
                order = True
        self.need(")")
        if self.at("IGNORE", "NULLS") or self.at("RESPECT", "NULLS"):
            self.fail("IGNORE NULLS and RESPECT NULLS aren't supported")
        within = False
        if self.take("WITHIN", "GROUP"):
            self.need("(", "ORDER", "BY")
            self.order_by()
            self.need(")")
            within = True
        condition = over = None
        if self.take("FILTER"):
            self.need("(", "WHERE")
            condition = self.expr()
            self.need(")")
        if self.take("OVER"):
            over = self.window_spec() if self.at("(") else N("window_name", name=self.name())
            if condition is not None or within:
                raise SqlError("FILTER and WITHIN GROUP don't go with OVER")
        return N("call", name=name, args=args, distinct=distinct, star=star, filter=condition, over=over, ordered=order or within)

    def window_spec(self) -> Node:
        self.need("(")
        partition: list[Node] = []
        order: list[Node] = []
        frame = None
        if self.take("PARTITION", "BY"):
            partition = self.exprs()
        if self.take("ORDER", "BY"):
            order = self.order_by()
        for unit in ("ROWS", "RANGE", "GROUPS"):
            if self.take(unit):
                if self.take("BETWEEN"):
                    low = self.bound()
                    self.need("AND")
                    frame = (unit, low, self.bound())
                else:
                    frame = (unit, self.bound(), ("CURRENT ROW", None))
                if self.at("EXCLUDE"):
                    self.fail("EXCLUDE isn't supported")
        self.need(")")
        return N("window", partition=partition, order=order, frame=frame)

    def bound(self) -> tuple[str, Node | None]:
        if self.take("UNBOUNDED"):
            return f"UNBOUNDED {self.next().upper}", None
        if self.take("CURRENT", "ROW"):
            return "CURRENT ROW", None
        e = self.additive()
        word = self.next().upper
        if word not in ("PRECEDING", "FOLLOWING"):
            self.fail("expected PRECEDING or FOLLOWING")
        return word, e


def parse_query(text: str) -> Node:
    return Parser(text).whole_query()
