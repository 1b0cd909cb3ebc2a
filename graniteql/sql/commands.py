"""Statements other than queries: text -> Command.

The parser of queries reads the parts that are queries and expressions; their source text is kept, as they are
translated when the command runs.
"""

from __future__ import annotations

from dataclasses import dataclass, field
from typing import Any

from .parser import Node, Parser, SqlError

QUERY_WORDS = ("SELECT", "WITH", "VALUES", "(")


@dataclass
class Command:
    name: str
    args: dict[str, Any] = field(default_factory=dict)

    def __getattr__(self, key: str) -> Any:
        try:
            return self.__dict__["args"][key]
        except KeyError:
            raise AttributeError(key) from None


def parse(text: str) -> Command:
    p = Parser(text)
    c = _statement(p)
    p.take(";")
    if p.peek().kind != "end":
        p.fail("expected the end of the statement")
    return c


def split(text: str) -> list[str]:
    """Statements of a script."""
    out, start = [], 0
    for t in Parser(text).toks:
        if t.text == ";":
            out.append(text[start : t.at])
            start = t.at + 1
    out.append(text[start:])
    return [s.strip() for s in out if s.strip()]


def _query(p: Parser) -> Node:
    return p.query()


def _exists(p: Parser, *words: str) -> bool:
    return p.take("IF", *words)


def _returning(p: Parser) -> list[Node] | None:
    if not p.take("RETURNING"):
        return None
    items = [p.item()]
    while p.take(","):
        items.append(p.item())
    return items


def _statement(p: Parser) -> Command:
    if any(p.at(w) for w in QUERY_WORDS):
        return Command("query", {"q": _query(p)})
    if p.take("EXPLAIN"):
        return Command("explain", {"analyze": p.take("ANALYZE"), "q": _query(p)})
    if p.take("BEGIN") or p.take("START"):
        p.take("TRANSACTION")
        read_only = False
        while p.peek().kind == "name":
            if p.take("READ", "ONLY"):
                read_only = True
            elif not (p.take("READ", "WRITE") or p.take("ISOLATION", "LEVEL", "SNAPSHOT")):
                p.fail("expected READ ONLY, READ WRITE or ISOLATION LEVEL SNAPSHOT")
            p.take(",")
        return Command("begin", {"read_only": read_only})
    for word in ("COMMIT", "ROLLBACK"):
        if p.take(word):
            p.take("TRANSACTION")
            return Command(word.lower())
    if p.take("SHOW"):
        for word in ("TABLES", "SCHEMAS"):
            if p.take(word):
                return Command(f"show_{word.lower()}")
        p.fail("expected TABLES or SCHEMAS")
    if p.take("DESCRIBE") or p.take("DESC"):
        p.take("TABLE")
        return Command("describe", {"path": p.dotted()})
    if p.take("REFRESH"):
        p.need("TABLE")
        return Command("refresh", {"path": p.dotted()})
    if p.take("CREATE"):
        return _create(p)
    if p.take("DROP"):
        for word in ("TABLE", "VIEW", "SCHEMA"):
            if p.take(word):
                missing = _exists(p, "EXISTS")
                return Command(f"drop_{word.lower()}", {"path": p.dotted(), "if_exists": missing})
        p.fail("expected TABLE, VIEW or SCHEMA")
    if p.take("INSERT"):
        p.need("INTO")
        path = p.dotted()
        if p.at("(") and not any(p.peek(1).upper == w for w in QUERY_WORDS):
            p.fail("INSERT takes no column list")
        return Command("insert", {"path": path, "q": _query(p), "returning": _returning(p)})
    if p.take("UPDATE"):
        return _update(p)
    if p.take("DELETE"):
        p.need("FROM")
        t = p.aliased(Node("table", {"path": p.dotted()}))
        source = p.table_primary() if p.take("USING") else None
        where = p.expr() if p.take("WHERE") else None
        return Command("delete", {"target": t, "source": source, "where": where, "returning": _returning(p)})
    if p.take("TRUNCATE"):
        p.take("TABLE")
        return Command("truncate", {"path": p.dotted()})
    if p.take("ALTER", "TABLE"):
        return _alter(p)
    if p.take("COPY"):
        return _copy(p)
    for word in ("COMPACT", "ANALYZE", "VACUUM", "CHECKPOINT"):
        if p.take(word):
            p.take("TABLE")
            path = p.dotted() if p.peek().kind in ("name", "quoted") else None
            return Command(word.lower(), {"path": path})
    p.fail("unknown statement")
    raise AssertionError


def _create(p: Parser) -> Command:
    replace = p.take("OR", "REPLACE")
    temporary = p.take("TEMP") or p.take("TEMPORARY")
    if p.take("SCHEMA"):
        return Command("create_schema", {"path": p.dotted()})
    if p.take("VIEW"):
        path = p.dotted()
        columns = p.names() if p.at("(") else None
        p.need("AS")
        start = p.i
        _query(p)
        return Command("create_view", {"path": path, "columns": columns, "text": p.source(start), "replace": replace, "temporary": temporary})
    p.need("TABLE")
    if temporary:
        p.fail("temporary tables aren't supported")
    path = p.dotted()
    if p.take("AS"):
        return Command("create_table_as", {"path": path, "q": _query(p), "replace": replace})
    p.need("(")
    columns = []
    while True:
        columns.append((p.name(), p.type_name()))
        p.take("NULL")
        if not p.take(","):
            break
    p.need(")")
    return Command("create_table", {"path": path, "columns": columns, "replace": replace})


def _update(p: Parser) -> Command:
    t = Node("table", {"path": p.dotted(), "alias": None, "columns": None})
    if not p.at("SET"):
        p.take("AS")
        t.parts["alias"] = p.name()
    p.need("SET")
    sets: list[tuple[str, Node]] = []
    while True:
        name = p.name()
        if name.lower() in [n.lower() for n, _ in sets]:
            raise SqlError(f"column {name} is set twice")
        p.need("=")
        sets.append((name, p.expr()))
        if not p.take(","):
            break
    source = p.table_primary() if p.take("FROM") else None
    where = p.expr() if p.take("WHERE") else None
    return Command("update", {"target": t, "sets": sets, "source": source, "where": where, "returning": _returning(p)})


def _alter(p: Parser) -> Command:
    path = p.dotted()
    if p.take("ADD"):
        p.take("COLUMN")
        name, kind = p.name(), p.type_name()
        return Command("add_column", {"path": path, "column": name, "type": kind, "default": p.expr() if p.take("DEFAULT") else None})
    if p.take("DROP"):
        p.take("COLUMN")
        return Command("drop_column", {"path": path, "column": p.name()})
    p.need("RENAME")
    if p.take("TO"):
        return Command("rename_table", {"path": path, "to": p.name()})
    p.take("COLUMN")
    name = p.name()
    p.need("TO")
    return Command("rename_column", {"path": path, "column": name, "to": p.name()})


def _copy(p: Parser) -> Command:
    q = path = None
    if p.take("("):
        q = _query(p)
        p.need(")")
    else:
        path = p.dotted()
        if p.at("("):
            p.fail("COPY takes no column list")
    to = p.take("TO")
    if not to:
        p.need("FROM")
        if path is None:
            p.fail("COPY FROM needs a table")
    location = p.string()
    options: dict[str, Any] = {}
    p.take("WITH")
    if p.take("("):
        while not p.take(")"):
            name = p.next().text.lower()
            if name in options:
                raise SqlError(f"option {name} is given twice")
            t = p.peek()
            if t.text in (",", ")"):
                options[name] = True
            else:
                p.i += 1
                options[name] = t.text[1:-1].replace("''", "'") if t.kind == "string" else t.text.lower() == "true" if t.upper in ("TRUE", "FALSE") else t.text
            if not p.take(",") and not p.at(")"):
                p.fail("expected , or )")
    return Command("copy_to" if to else "copy_from", {"path": path, "q": q, "location": location, "options": options})
