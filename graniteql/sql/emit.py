"""Syntax tree -> Spark SQL text with the dialect's semantics.

What Spark's parser or analyzer lacks is rewritten: QUALIFY, GROUPS frames, three-valued IN as a value, aggregate
arguments with ORDER BY, GROUPING of several columns, FETCH, AT TIME ZONE, result types, NULLS LAST. Where a rewrite
depends on a type, Spark's analyzer is asked for it; nothing runs while a statement is translated.
"""

from __future__ import annotations

from collections.abc import Callable

from ..functions.aggregate import AGGREGATES, RANKS, WINDOW_ONLY, aggregate
from ..functions.scalar import SCALAR, at_zone, cast, interval, length_of, quote, unsigned
from ..types import is_unsigned, spark_type
from .parser import Node, SqlError


_COMPARED = ("=", "<>", "!=", "<", "<=", ">", ">=")

#: So many keys of an aggregate over whole partitions are broadcast; each of the others has fewer rows than a part of as many.
HOT_KEYS = 1000


def ident(name: str) -> str:
    return "`" + name.replace("`", "``") + "`"


class Scope:
    """What the names of a SELECT refer to, for the analyzer: WITH clauses, FROM, and the scopes around."""

    def __init__(self, ctes: list[str], source: str | None, outer: "Scope | None"):
        self.ctes, self.source, self.outer = ctes, source, outer
        self.windows: dict[str, Node] = {}
        self.aliases: dict[str, Node] = {}

    def relations(self) -> list[str]:
        out, s = [], self
        while s is not None:
            if s.source:
                out.append(s.source)
            s = s.outer
        return out


class Emitter:
    """analyze(sql) -> schema as [(name, type)]; function(name, args) -> text of a view for read_csv and the like;
    table(path) -> text for a table name, or None to leave it; steady(sql) -> whether a query read twice has the same rows."""

    def __init__(self, analyze: Callable[[str], list[tuple[str, str]]], function: Callable[[str, list], str], table: Callable[[list[str]], str | None] = lambda path: None, params: list | None = None, steady: Callable[[str], bool] = lambda sql: False):
        self.analyze, self.function, self.table, self.steady = analyze, function, table, steady
        self.params = params or []
        self.kinds: dict[tuple, str] = {}
        self.fresh = 0
        self.mixed = False  # whether the statement has intervals of months and shorter units

    def unique(self, stem: str) -> str:
        self.fresh += 1
        return f"__{stem}{self.fresh}"

    # --- queries

    def query(self, q: Node, ctes: list[str] | None = None, outer: Scope | None = None) -> str:
        known = list(ctes or [])
        own = []
        for name, columns, body in q.ctes:
            text = f"{ident(name)}{'(' + ', '.join(map(ident, columns)) + ')' if columns else ''} AS ({self.query(body, known, outer)})"
            own.append(text)
            known.append(text)
        body, tail = q.body, ""
        select = body if body.kind == "select" else None
        if select is not None:
            text, order = self.select(select, known, outer, q.order)
        else:
            text = self.body(body, known, outer)
            for k in q.order:
                if k.e.kind not in ("number", "column"):
                    raise SqlError("ORDER BY of a set operation takes output names and positions")
            order = [self.key(k, Scope(known, f"({text})", outer)) for k in q.order]
        if order:
            tail += " ORDER BY " + ", ".join(order)
        if q.limit is not None:
            tail += f" LIMIT {q.limit}"
        if q.offset is not None:
            tail += f" OFFSET {q.offset}"
        with_ = f"WITH {', '.join(own)} " if own else ""
        return f"{with_}{text}{tail}"

    def body(self, b: Node, ctes: list[str], outer: Scope | None) -> str:
        if b.kind == "select":
            return self.select(b, ctes, outer, [])[0]
        if b.kind == "paren":
            return f"({self.query(b.q, ctes, outer)})"
        if b.kind == "values":
            scope = Scope(ctes, None, outer)
            rows = ", ".join("(" + ", ".join(self.e(x, scope) for x in row) + ")" for row in b.rows)
            names = ", ".join(f"column{i + 1}" for i in range(len(b.rows[0])))
            return f"SELECT * FROM VALUES {rows} AS {self.unique('v')}({names})"
        left, right = (self.body(x, ctes, outer) for x in (b.left, b.right))
        return f"({left}) {b.op}{' ALL' if b.all else ''} ({right})"

    def select(self, s: Node, ctes: list[str], outer: Scope | None, order: list[Node]) -> tuple[str, list[str]]:
        """The text without ORDER BY, and the keys of ORDER BY over it."""
        if (parted := self.by_leaves(s, ctes, outer, order)) is not None:
            s, source, order = parted
        else:
            source = ", ".join(self.ref(t, ctes, outer) for t in s.source) if s.source else None
        scope = Scope(ctes, source, outer)
        scope.windows = {n.lower(): w for n, w in s.windows}
        scope.aliases = {i.alias.lower(): i.e for i in s.items if i.alias}
        framed, whole = self.has_group_frames(s, scope), self.whole_windows(s, scope, order)
        split = self.split_windows(s, scope, order, whole) if whole else None
        if split is None and framed:
            split = self.split_windows(s, scope, order, set())
        if split is not None:
            return split
        items = [self.item(i, scope) for i in s.items]
        text, tail = f"SELECT {'DISTINCT ' if s.distinct and s.qualify is None else ''}{', '.join(items)}", self.rest(s, scope)
        if s.qualify is None:
            return text + tail, [self.key(k, scope) for k in order]
        hidden = [f"({self.e(self.qualified(s, scope), scope)}) AS __qualify"]
        keys = []
        for k in order:  # what isn't among the items is computed beside them
            if s.distinct or k.e.kind == "number" or self.is_output(k.e, s):
                keys.append(self.key(k, Scope(ctes, None, outer)))
                continue
            name = self.unique("order")
            hidden.append(f"{self.e(self.unalias(k.e, scope), scope)} AS {name}")
            keys.append(self.key(Node("key", {"e": Node("column", {"path": [name]}), "desc": k.desc, "nulls_first": k.nulls_first}), scope))
        names = ", ".join(h.rsplit(" AS ", 1)[1] for h in hidden)
        inner = f"SELECT {', '.join([*items, *hidden])}{tail}"
        return f"SELECT {'DISTINCT ' if s.distinct else ''}* EXCEPT ({names}) FROM ({inner}) WHERE __qualify", keys

    def rest(self, s: Node, scope: Scope) -> str:
        """FROM, WHERE, GROUP BY and HAVING."""
        text = f" FROM {scope.source}" if scope.source else ""
        if s.where is not None:
            text += f" WHERE {self.conjuncts(s.where, scope)}"
        if s.group is not None:
            text += " GROUP BY " + ", ".join(self.group_item(g, scope) for g in s.group)
        if s.having is not None:
            text += f" HAVING {self.conjuncts(s.having, scope)}"
        return text

    def qualified(self, s: Node, scope: Scope) -> Node:
        if not _has_window(s.qualify) and not any(_has_window(scope.aliases[a]) for a in scope.aliases if _names(s.qualify, a)):
            raise SqlError("QUALIFY needs a window function")
        return self.unalias(s.qualify, scope)

    @staticmethod
    def is_output(e: Node, s: Node) -> bool:
        """Whether an ORDER BY key is the name of an item."""
        if e.kind != "column" or len(e.path) != 1:
            return False
        return any((i.alias or (i.e.path[-1] if i.e.kind == "column" else "")).lower() == e.path[0].lower() for i in s.items)

    def has_group_frames(self, s: Node, scope: Scope) -> bool:
        found: list[Node] = []
        for node in [*(i.e for i in s.items), *([s.qualify] if s.qualify is not None else []), *scope.windows.values()]:
            _walk(node, lambda n: found.append(n) if n.kind == "window" and n.frame and n.frame[0] == "GROUPS" else None)
        if any(not w.order for w in found):
            raise SqlError("GROUPS frames need ORDER BY")
        return bool(found)

    def named(self, w: Node, scope: Scope) -> Node:
        if w.kind != "window_name":
            return w
        if w.name.lower() not in scope.windows:
            raise SqlError(f"unknown window {w.name}")
        return scope.windows[w.name.lower()]

    def windowed(self, s: Node, scope: Scope, order: list[Node]) -> list[tuple[Node, Node, frozenset[str]]]:
        """The calls with OVER, each with its window and the texts of its keys."""
        calls: list[Node] = []
        for e in [*(i.e for i in s.items), *([s.qualify] if s.qualify is not None else []), *(k.e for k in order)]:
            _walk(e, lambda n: calls.append(n) if n.kind == "call" and n.parts.get("over") is not None else None)
        windows = [(c, self.named(c.over, scope)) for c in calls]
        return [(c, w, frozenset(self.e(x, scope) for x in w.partition)) for c, w in windows]

    def whole_windows(self, s: Node, scope: Scope, order: list[Node]) -> set[frozenset[str]]:
        """The sets of keys by which aggregates are asked for over whole partitions, and no other window is: these are
        aggregated and joined, as a window would hold all rows of a key, or of the table, in one task."""
        whole, other = set(), set()
        for call, w, keys in self.windowed(s, scope, order):
            (whole if _is_whole(call, w) else other).add(keys)
        if not whole - other or any(g.kind in ("number", "param") for g in s.group or ()):  # positions among the items
            return set()
        if any(i.e.kind == "star" for i in s.items):
            names = [n.lower() for i in s.items if i.e.kind == "star" for _, n in self.starred(i.e, s, scope)] if self.plain_star(scope) else []
            if len(set(names)) < max(len(names), 1):
                return set()
        return whole - other

    def plain_star(self, scope: Scope) -> bool:
        """Whether the columns of FROM are known and have different names."""
        try:
            names = [n.lower() for n, _ in self.analyze(f"{f'WITH {', '.join(scope.ctes)} ' if scope.ctes else ''}SELECT * FROM {scope.source}")]
        except Exception:  # noqa: BLE001 - what is wrong is said where the SELECT stands as it is
            return False
        return len(set(names)) == len(names)

    def split_windows(self, s: Node, scope: Scope, order: list[Node], whole: set[frozenset[str]]) -> tuple[str, list[str]] | None:
        """Queries in one another: all expressions without windows, over FROM, WHERE and GROUP BY; to it are joined the
        aggregates over whole partitions by the given keys; a dense rank for each GROUPS frame over its order; the windows,
        whose frames are RANGE over that rank. None if the first can't be read twice, as the aggregates need."""
        inner: dict[str, str] = {}  # text -> name
        ranks: dict[str, str] = {}
        joins: dict[tuple[str, ...], list[Node]] = {}  # names of keys -> aggregates
        sorted_by = {keys: w for _, w, keys in reversed(self.windowed(s, scope, order)) if w.order} if whole else {}

        def column(e: Node) -> Node:
            """An expression without windows as a column of the innermost query."""
            if e.kind in ("number", "string", "literal", "param", "interval", "hex"):
                return e
            name = inner.setdefault(self.e(e, scope), f"__g{len(inner)}")
            return Node("column", {"path": [name]}, e.src)

        def window(w: Node) -> Node:
            w = self.named(w, scope)
            keys = [Node("key", {**k.parts, "e": column(k.e)}) for k in w.order or ()]
            new = Node("window", {"partition": [column(x) for x in w.partition or ()], "order": keys, "frame": w.frame})
            if w.frame and w.frame[0] == "GROUPS":
                over = self.spec(Node("window", {**new.parts, "frame": None}), Scope(scope.ctes, None, scope.outer))
                rank = ranks.setdefault(f"dense_rank() OVER {over}", f"__rank{len(ranks)}")
                by = Node("key", {"e": Node("column", {"path": [rank]}), "desc": False, "nulls_first": False})
                new.parts.update(frame=("RANGE", *w.frame[1:]), order=[by])
            return new

        def lifted(e: Node) -> Node:
            if not _has_window(e):
                return column(e)
            if e.kind == "call" and e.parts.get("over") is not None:
                w = self.named(e.over, scope)
                keys = frozenset(self.e(x, scope) for x in w.partition) if whole and _is_whole(e, w) else None
                if keys in whole:
                    by = tuple(dict.fromkeys(x.path[0] for x in map(column, w.partition) if x.kind == "column"))
                    joins.setdefault(by, []).append(Node("call", {**e.parts, "args": [column(a) for a in e.args], "over": None}, e.src))
                    return Node("column", {"path": [f"__whole{list(joins).index(by)}_{len(joins[by])}"]}, e.src)
                if keys in sorted_by:  # one sort will do for both
                    w = Node("window", {**sorted_by[keys].parts, "frame": ("ROWS", ("UNBOUNDED PRECEDING", None), ("UNBOUNDED FOLLOWING", None))})
                parts = {**e.parts, "args": [column(a) for a in e.args], "over": window(w)}
                if e.parts.get("filter") is not None:
                    parts["filter"] = column(e.filter)
                return Node("call", parts, e.src)
            inside = lambda v: lifted(v) if isinstance(v, Node) and v.kind != "query" else [inside(x) for x in v] if isinstance(v, list) else tuple(inside(x) for x in v) if isinstance(v, tuple) else v
            return Node(e.kind, {k: inside(v) for k, v in e.parts.items()}, e.src)

        outer, hidden, keys = [], [], []
        for i in s.items:
            if i.e.kind == "star":
                for table, name in self.starred(i.e, s, scope):
                    outer.append((lifted(Node("column", {"path": [*table, name]})), name))
            else:
                outer.append((lifted(i.e), i.alias or (i.e.path[-1] if i.e.kind == "column" else i.e.src)))
        if s.qualify is not None:
            hidden.append((lifted(self.qualified(s, scope)), "__qualify"))
        for k in order:
            if s.distinct or k.e.kind == "number" or self.is_output(k.e, s):
                keys.append(self.key(k, Scope(scope.ctes, None, scope.outer)))
            else:
                hidden.append((lifted(self.unalias(k.e, scope)), name := self.unique("order")))
                keys.append(f"{name} {'DESC' if k.desc else 'ASC'} NULLS {'FIRST' if k.nulls_first else 'LAST'}")
        flat = f"SELECT {', '.join(f'{text} AS {name}' for text, name in inner.items()) or '1 AS __none'}{self.rest(s, scope)}"
        ranked = f"({flat})"
        if joins:
            with_ = f"WITH {', '.join(scope.ctes)} " if scope.ctes else ""
            if not self.steady(f"{with_}{flat}"):
                return None
            ranked = self.with_aggregates(flat, joins, scope)
        if ranks:
            ranked = f"(SELECT *, {', '.join(f'{text} AS {name}' for text, name in ranks.items())} FROM {ranked})"
        top = Scope(scope.ctes, ranked, scope.outer)
        shown = [f"{self.e(e, top)} AS {ident(name)}" for e, name in [*outer, *hidden]]
        text = f"SELECT {'DISTINCT ' if s.distinct and not hidden else ''}{', '.join(shown)} FROM {ranked}"
        if hidden:
            text = f"SELECT {'DISTINCT ' if s.distinct else ''}* EXCEPT ({', '.join(name for _, name in hidden)}) FROM ({text}){' WHERE __qualify' if s.qualify is not None else ''}"
        return text, keys

    def with_aggregates(self, flat: str, joins: dict[tuple[str, ...], list[Node]], scope: Scope) -> str:
        """A query's rows, each with the aggregates over all rows that have the same keys. The aggregates of the most frequent
        keys go to where the rows are; only rows of other keys move to windows, of which none has many."""
        text, names, here = f"({flat})", "__flat.*", Scope(scope.ctes, f"({flat})", scope.outer)
        for n, (by, calls) in enumerate(joins.items()):
            name = f"__whole{n}"
            keys = [f"{k} AS {name}_key{i}" for i, k in enumerate(by)]
            values = [f"{self.e(call, here)} AS {name}_{i}" for i, call in enumerate(calls, 1)]
            added = ", ".join([names, *(f"{name}.{name}_{i}" for i in range(1, len(calls) + 1))])
            if not by:
                text = f"(SELECT /*+ BROADCAST({name}) */ {added} FROM {text} AS __flat CROSS JOIN (SELECT {', '.join(values)} FROM ({flat})) AS {name})"
                continue
            most = ", ".join([f"{name}_rows DESC", *(f"{name}_key{i}" for i in range(len(by)))])
            hot = f"(SELECT {', '.join([*keys, *values, f'count(*) AS {name}_rows'])} FROM ({flat}) GROUP BY {', '.join(by)} ORDER BY {most} LIMIT {HOT_KEYS}) AS {name}"
            on = " AND ".join(f"__flat.{k} <=> {name}.{name}_key{i}" for i, k in enumerate(by))
            over = Node("window", {"partition": [Node("column", {"path": [k]}) for k in by], "order": [], "frame": None})
            windows = [f"{self.e(Node('call', {**call.parts, 'over': over}, call.src), here)} AS {name}_{i}" for i, call in enumerate(calls, 1)]
            near = f"SELECT /*+ BROADCAST({name}) */ {added} FROM {text} AS __flat JOIN {hot} ON {on}"
            rest = f"SELECT /*+ BROADCAST({name}) */ {', '.join([names, *windows])} FROM {text} AS __flat LEFT ANTI JOIN {hot} ON {on}"
            text = f"({near} UNION ALL {rest})"
        return text

    def starred(self, star: Node, s: Node, scope: Scope) -> list[tuple[list[str], str]]:
        """The columns of a star, each with its table's name if it is needed."""
        with_ = f"WITH {', '.join(scope.ctes)} " if scope.ctes else ""
        columns = lambda x: [n for n, _ in self.analyze(f"{with_}SELECT {x} FROM {scope.source}")]
        if star.table:
            return [([star.table], n) for n in columns(f"{ident(star.table)}.*")]
        names = columns("*")
        if len({n.lower() for n in names}) == len(names):
            return [([], n) for n in names]
        tables: list[str] = []

        def visit(t: Node) -> None:
            if t.kind == "join":
                if t.using:
                    raise SqlError("* over USING with GROUPS frames: name the columns")
                visit(t.left)
                visit(t.right)
            elif t.kind == "nested":
                visit(t.t)
            else:
                tables.append(t.alias or t.path[-1])

        for t in s.source:
            visit(t)
        return [([t], n) for t in tables for n in columns(f"{ident(t)}.*")]

    def unalias(self, e: Node, scope: Scope) -> Node:
        def swap(n: Node) -> Node:
            if n.kind == "column" and len(n.path) == 1 and n.path[0].lower() in scope.aliases:
                return Node("group", {"e": scope.aliases[n.path[0].lower()]})
            return n

        return _map(e, swap)

    def item(self, i: Node, scope: Scope) -> str:
        if i.e.kind == "star":
            return f"{ident(i.e.table)}.*" if i.e.table else "*"
        text = self.e(i.e, scope)
        if i.alias:
            return f"{text} AS {ident(i.alias)}"
        if i.e.kind == "column":
            return text
        return f"{text} AS {ident(i.e.src)}"

    def group_item(self, g: Node, scope: Scope) -> str:
        if g.kind != "grouping":
            return self.e(g, scope)
        sets = []
        for x in g.sets:
            if isinstance(x, Node):
                sets.append(self.group_item(x, scope))
            else:
                inner = ", ".join(self.e(e, scope) for e in x)
                sets.append(f"({inner})" if g.how == "GROUPING SETS" or len(x) != 1 else inner)
        return f"{g.how} ({', '.join(sets)})"

    def key(self, k: Node, scope: Scope) -> str:
        return f"{self.comparable(self.e(k.e, scope), scope)} {'DESC' if k.desc else 'ASC'} NULLS {'FIRST' if k.nulls_first else 'LAST'}"

    # --- FROM

    def ref(self, t: Node, ctes: list[str], outer: Scope | None) -> str:
        if t.kind == "join":
            left, right = self.ref(t.left, ctes, outer), self.ref(t.right, ctes, outer)
            how = "JOIN" if t.how == "INNER" else f"{t.how} JOIN"
            if t.using:
                return f"{left} {how} {right} USING ({', '.join(map(ident, t.using))})"
            if not _equates(t.on):
                raise SqlError("a join needs an equality between its sides")
            return f"{left} {how} {right} ON {self.conjuncts(t.on, Scope(ctes, f'{left}, {right}', outer))}"
        if t.kind == "nested":
            return f"({self.ref(t.t, ctes, outer)})"
        if t.kind == "derived":
            text = f"({self.query(t.q, ctes, outer)})"
        elif t.kind == "function":
            text = self.function(t.name, t.args)
        else:
            text = self.table(t.path) or ".".join(map(ident, t.path[-1:] if len(t.path) == 2 and t.path[0].lower() == "main" else t.path))
        alias = t.alias or (t.path[-1] if t.kind == "table" else None)
        if alias:
            text += f" AS {ident(alias)}"
            if t.columns:
                text += f"({', '.join(map(ident, t.columns))})"
        return text

    # --- joins of several tables with the same rows

    def by_leaves(self, s: Node, ctes: list[str], outer: Scope | None, order: list[Node]) -> tuple[Node, str, list[Node]] | None:
        """Tables that are joined to the same rows and seen only by aggregates that repeated rows don't change (leaves)
        needn't meet: a UNION ALL has each leaf joined by itself, with nulls for the others, so that rows grow with the sum
        of the matches, not with their product. Returns the SELECT, its FROM and its ORDER BY, or None if it isn't of this kind."""
        shown = [*(i.e for i in s.items), *(s.group or []), *([s.having] if s.having is not None else []), *(k.e for k in order)]
        chain = _chain(s.source[0]) if s.source and len(s.source) == 1 else None
        calls = _aggregates(shown)
        if not chain or len(chain) < 3 or len(calls) < 2 or s.qualify is not None or s.windows or not all(map(_repeats_alike, calls)):
            return None
        if _kinds([*shown, *(j.on for j, _ in chain if j is not None), *([s.where] if s.where is not None else [])]) & _UNPARTED:
            return None
        with_ = f"WITH {', '.join(ctes)} " if ctes else ""
        refs = [self.ref(t, ctes, outer) for _, t in chain]
        try:
            names = [[n.lower() for n, _ in self.analyze(f"{with_}SELECT * FROM {r}")] for r in refs]
        except Exception:  # noqa: BLE001 - what is wrong is said where the SELECT stands as it is
            return None
        aliases = [(t.alias or (t.path[-1] if t.kind == "table" else "")).lower() for _, t in chain]
        hidden = {n for n, (j, _) in enumerate(chain) if j is not None and j.how in ("LEFT SEMI", "LEFT ANTI")}

        def home(c: Node, seen: range | list[int]) -> int | None:
            """The table of a column."""
            path = [p.lower() for p in (c.path[1:] if len(c.path) == 3 and c.path[0].lower() == "main" else c.path)]
            found = [n for n in seen if path[-1] in names[n] and (len(path) == 1 or len(path) == 2 and path[0] == aliases[n])]
            return found[0] if len(found) == 1 and names[found[0]].count(path[-1]) == 1 else None

        def homes(e: Node, seen: range | list[int]) -> set[int | None]:
            return {home(c, seen) for c in _columns(e)}

        visible = [n for n in range(len(chain)) if n not in hidden]
        conditions = {n: homes(j.on, [*(v for v in visible if v < n), n]) for n, (j, _) in enumerate(chain) if j is not None}
        filtered = homes(s.where, visible) if s.where is not None else set()
        if None in filtered.union(*conditions.values()):
            return None
        outputs = {i.alias.lower() for i in s.items if i.alias}
        inside = [homes(c, visible) for c in calls]
        plain = set(filtered)
        for e in shown:
            for c in _columns(e, aggregates=False):
                at = home(c, visible)
                if at is None and not (len(c.path) == 1 and c.path[0].lower() in outputs):
                    return None
                plain.add(at)
        if any(None in x for x in inside):
            return None
        for n, used in conditions.items():
            plain |= used - {n}
        leaves = {n for n, (j, _) in enumerate(chain) if j is not None and n not in hidden} - plain
        for used in inside:
            if len(used & leaves) > 1:  # these have to meet
                leaves -= used
        asked = sorted({n for used in inside for n in used & leaves})
        if len(asked) < 2:
            return None

        # Where aggregates skip the nulls of a leaf's unmatched rows, matches are enough: an inner join may spread the leaf over
        # all tasks. The rows to which leaves are joined then come once more by themselves, for groups without any match.
        skipped = {n for n in asked if chain[n][0].how == "LEFT" and all(any(a.kind == "column" and home(a, visible) == n for a in c.args) for c, used in zip(calls, inside, strict=True) if n in used)}
        parts = [*asked, len(chain)] if skipped.issuperset(asked) else asked
        columns: dict[tuple[int, str], str] = {}
        part = self.unique("part")

        def column(c: Node) -> Node:
            at = home(c, visible)
            if at is None:
                return c
            return Node("column", {"path": [columns.setdefault((at, c.path[-1].lower()), f"{part}_{len(columns)}")]}, c.src)

        def moved(e: Node) -> Node:
            return _map(e, lambda n: column(n) if n.kind == "column" else guarded(n) if n.kind == "call" and n.name in AGGREGATES else n)

        def guarded(call: Node) -> Node:
            """Its argument is null where its leaf isn't joined."""
            own = {name: at for (at, _), name in columns.items() if at in leaves}
            used = [own[c.path[0]] for c in _columns(call) if c.path[0] in own]
            if not used or any(a.kind == "column" and a.path[0] in own for a in call.args):
                return call
            here = Node("binary", {"op": "=", "a": Node("column", {"path": [part]}), "b": Node("number", {"text": str(used[0])})})
            return Node("call", {**call.parts, "args": [Node("case", {"operand": None, "arms": [(here, a)], "other": None}) for a in call.args]}, call.src)

        items = [Node("item", {"e": moved(i.e), "alias": i.alias or (i.e.path[-1] if i.e.kind == "column" else i.e.src)}) for i in s.items]
        keys = [k if k.e.kind == "number" or self.is_output(k.e, s) else Node("key", {**k.parts, "e": moved(k.e)}) for k in order]
        group = [moved(g) for g in s.group] if s.group is not None else None
        having = moved(s.having) if s.having is not None else None

        def joined(leaf: int) -> str:
            text = refs[0]
            for n, (j, _) in enumerate(chain):
                if j is None or n in leaves and n != leaf and j.how == "LEFT":
                    continue
                how = "LEFT SEMI" if n in leaves and n != leaf else "INNER" if n == leaf and n in skipped else j.how
                text += f" {'JOIN' if how == 'INNER' else how + ' JOIN'} {refs[n]} ON {self.conjuncts(j.on, Scope(ctes, f'{text}, {refs[n]}', outer))}"
            return text

        def rows(leaf: int) -> str:
            own = [f"{'NULL' if at in leaves and at != leaf else '.'.join(map(ident, [aliases[at], name] if aliases[at] else [name]))} AS {c}" for (at, name), c in columns.items()]
            where = f" WHERE {self.conjuncts(s.where, Scope(ctes, joined(leaf), outer))}" if s.where is not None else ""
            return f"SELECT {', '.join([f'{leaf} AS {part}', *own])} FROM {joined(leaf)}{where}"

        text = " UNION ALL ".join(map(rows, parts))
        if not self.steady(f"{with_}{text}"):
            return None
        source = f"({text})"
        return Node("select", {**s.parts, "items": items, "source": None, "where": None, "group": group, "having": having}, s.src), source, keys

    # --- expressions

    def kind(self, text: str, scope: Scope) -> str:
        """The Spark type of an expression's text."""
        with_ = f"WITH {', '.join(scope.ctes)} " if scope.ctes else ""
        relations = scope.relations()
        for n in range(1, len(relations) + 1) if relations else (0,):
            key = (text, with_, tuple(relations[:n]))
            if key in self.kinds:
                return self.kinds[key]
            source = f" FROM {', '.join(relations[:n])}" if n else ""
            try:
                self.kinds[key] = self.analyze(f"{with_}SELECT {text} AS x{source}")[0][1]
                return self.kinds[key]
            except Exception:  # noqa: BLE001 - the name may come from a scope further out
                if n == len(relations):
                    raise
        raise AssertionError

    def comparable(self, text: str, scope: Scope) -> str:
        """Intervals of months and shorter units stand in order of their length, a month being 30 days."""
        if not self.mixed or not self.is_interval(text, scope):
            return text
        return length_of(text, "interval")

    def is_interval(self, text: str, scope: Scope) -> bool:
        try:
            return self.kind(text, scope) == "interval"
        except Exception:  # noqa: BLE001 - ORDER BY names an output column, or a position
            return False

    def conjuncts(self, e: Node, scope: Scope) -> str:
        """A condition: IN over a subquery may stay as it is where it stands alone under AND."""
        if e.kind == "binary" and e.op == "AND":
            return f"({self.conjuncts(e.a, scope)} AND {self.conjuncts(e.b, scope)})"
        if e.kind == "group":
            return self.conjuncts(e.e, scope)
        if e.kind == "in_query":
            q = self.query(e.q, scope.ctes, scope)
            return f"({self.e(e.e, scope)} {'NOT ' if e.negated else ''}IN ({q}))"
        if e.kind == "not" and e.e.kind in ("in_query", "group"):
            inner = e.e.e if e.e.kind == "group" else e.e
            if inner.kind == "in_query":
                return self.conjuncts(Node("in_query", {"e": inner.e, "q": inner.q, "negated": not inner.negated}), scope)
        return self.e(e, scope)

    def e(self, e: Node, scope: Scope) -> str:
        return getattr(self, "e_" + e.kind)(e, scope)

    def e_column(self, e: Node, scope: Scope) -> str:
        path = e.path[1:] if len(e.path) == 3 and e.path[0].lower() == "main" else e.path
        return ".".join(map(ident, path))

    def e_number(self, e: Node, scope: Scope) -> str:
        t = e.text
        if "e" in t.lower():
            return f"{t}D"
        if "." in t:
            return f"{'0' if t[0] == '.' else ''}{t}{'0' if t[-1] == '.' else ''}BD"
        n = int(t)
        return t if n < 1 << 31 else f"{t}L" if n < 1 << 63 else f"CAST({t}BD AS DECIMAL(20,0))"

    def e_string(self, e: Node, scope: Scope) -> str:
        return quote(e.value)

    def e_hex(self, e: Node, scope: Scope) -> str:
        return f"X'{e.value}'"

    def e_literal(self, e: Node, scope: Scope) -> str:
        return e.word

    def e_param(self, e: Node, scope: Scope) -> str:
        if not 1 <= e.index <= len(self.params):
            raise SqlError(f"no value for parameter {e.index}")
        return self.params[e.index - 1]

    def e_group(self, e: Node, scope: Scope) -> str:
        return f"({self.e(e.e, scope)})"

    def e_unary(self, e: Node, scope: Scope) -> str:
        return f"({e.op}{self.e(e.e, scope)})" if e.e.kind != "number" or e.op == "+" else f"(-{self.e(e.e, scope)})"

    def e_not(self, e: Node, scope: Scope) -> str:
        return f"(NOT {self.e(e.e, scope)})"

    def e_binary(self, e: Node, scope: Scope) -> str:
        a, b = self.e(e.a, scope), self.e(e.b, scope)
        if e.op in _COMPARED and self.mixed and (self.is_interval(a, scope) or self.is_interval(b, scope)):
            a, b = (length_of(x, k) if (k := self.kind(x, scope)).startswith("interval") else x for x in (a, b))
        if e.op == "/":
            return f"(CAST({a} AS DOUBLE) / CAST({b} AS DOUBLE))"
        if e.op in "+-":
            for x, y, text in ((e.a, e.b, a), (e.b, e.a, b)):
                if y.kind == "interval":
                    other, size = interval(y.value, y.low, y.high)
                    if x.kind == "interval":
                        months, days, micros = (p + (q if e.op == "+" else -q) for p, q in zip(_amounts(e.a), _amounts(e.b), strict=True))
                        return f"make_interval(0, {months}, 0, {days}, 0, 0, CAST({micros} / 1000000.0D AS DECIMAL(18,6)))" if months and (days or micros) else f"({a} {e.op} {b})"
                    if self.kind(text, scope) == "date" and (size == "mixed" or "SECOND" in other):
                        return f"(CAST({text} AS TIMESTAMP_NTZ) {e.op} {other})"
        return f"({a} {e.op} {b})"

    def e_is(self, e: Node, scope: Scope) -> str:
        return f"({self.e(e.e, scope)} IS {'NOT ' if e.negated else ''}{e.what})"

    def e_distinct(self, e: Node, scope: Scope) -> str:
        return f"({self.e(e.a, scope)} IS {'NOT ' if e.negated else ''}DISTINCT FROM {self.e(e.b, scope)})"

    def e_in(self, e: Node, scope: Scope) -> str:
        if not e.items:
            return "true" if e.negated else "false"
        return f"({self.e(e.e, scope)} {'NOT ' if e.negated else ''}IN ({', '.join(self.e(x, scope) for x in e.items)}))"

    def e_in_query(self, e: Node, scope: Scope) -> str:
        """Three-valued: true on a match, else null if the needle or any value is null and there are values. That takes
        one semi join and, where the subquery stands for itself, one aggregate that says which values there are."""
        x, q, name = self.e(e.e, scope), self.query(e.q, scope.ctes, scope), self.unique("in")
        rows = f"FROM ({q}) AS {name}(y)"
        if self.stands_alone(f"SELECT 1 {rows}", scope):
            kinds = f"(SELECT CASE WHEN count(*) = 0 THEN 0 WHEN count(*) > count(y) THEN 2 ELSE 1 END {rows})"
            other = f"CASE {kinds} WHEN 0 THEN false WHEN 2 THEN NULL ELSE CASE WHEN {x} IS NULL THEN NULL ELSE false END END"
        else:
            other = f"CASE WHEN NOT EXISTS (SELECT 1 {rows}) THEN false WHEN {x} IS NULL OR EXISTS (SELECT 1 {rows} WHERE y IS NULL) THEN NULL ELSE false END"
        found = f"CASE WHEN EXISTS (SELECT 1 {rows} WHERE y = {x}) THEN true ELSE {other} END"
        return f"(NOT {found})" if e.negated else f"({found})"

    def stands_alone(self, text: str, scope: Scope) -> bool:
        try:
            self.analyze(f"WITH {', '.join(scope.ctes)} {text}" if scope.ctes else text)
        except Exception:  # noqa: BLE001 - it refers to what is around it
            return False
        return True

    def e_between(self, e: Node, scope: Scope) -> str:
        return f"({self.e(e.e, scope)} {'NOT ' if e.negated else ''}BETWEEN {self.e(e.low, scope)} AND {self.e(e.high, scope)})"

    def e_like(self, e: Node, scope: Scope) -> str:
        if e.escape is not None:
            if e.escape.kind != "string" or len(e.escape.value) != 1:
                raise SqlError("ESCAPE takes one character")
            mark = e.escape.value
        else:
            taken = e.pattern.value if e.pattern.kind == "string" else ""
            mark = next(c for c in "\x01\x02\x03" if c not in taken)  # a backslash is an ordinary character
        return f"({self.e(e.e, scope)} {'NOT ' if e.negated else ''}LIKE {self.e(e.pattern, scope)} ESCAPE {quote(mark)})"

    def e_case(self, e: Node, scope: Scope) -> str:
        operand = f" {self.e(e.operand, scope)}" if e.operand is not None else ""
        arms = " ".join(f"WHEN {self.e(w, scope)} THEN {self.e(t, scope)}" for w, t in e.arms)
        return f"CASE{operand} {arms}{' ELSE ' + self.e(e.other, scope) if e.other is not None else ''} END"

    def e_cast(self, e: Node, scope: Scope) -> str:
        target = spark_type(*e.type)
        text = cast(self.e(e.e, scope), target, lambda t: self.kind(t, scope))
        return unsigned(text) if is_unsigned(e.type[0]) else text

    def e_at_zone(self, e: Node, scope: Scope) -> str:
        return at_zone(self.e(e.e, scope), self.e(e.zone, scope), lambda t: self.kind(t, scope))

    def e_interval(self, e: Node, scope: Scope) -> str:
        text, size = interval(e.value, e.low, e.high)
        self.mixed |= size == "mixed"
        return text

    def e_scalar(self, e: Node, scope: Scope) -> str:
        return f"({self.query(e.q, scope.ctes, scope)})"

    def e_exists(self, e: Node, scope: Scope) -> str:
        return f"({'NOT ' if e.negated else ''}EXISTS ({self.query(e.q, scope.ctes, scope)}))"

    def e_call(self, e: Node, scope: Scope) -> str:
        kind = lambda t: self.kind(t, scope)
        if e.name in ("grouping", "grouping_id"):
            n = len(e.args)
            return "CAST(" + " + ".join(f"{1 << (n - 1 - i)} * grouping({self.e(a, scope)})" for i, a in enumerate(e.args)) + " AS BIGINT)"
        args = [self.e(a, scope) for a in e.args]
        if e.name in AGGREGATES or e.over is not None:
            tail = ""
            if e.filter is not None:
                tail = f" FILTER (WHERE {self.e(e.filter, scope)})"
            if e.over is not None:
                tail = f" OVER {self.spec(e.over, scope, e.name in WINDOW_ONLY - {'first_value', 'last_value'})}"
                if e.distinct:
                    raise SqlError("DISTINCT doesn't go with OVER")
            if e.name in ("min", "max") and len(args) == 1 and self.mixed and self.is_interval(args[0], scope):
                return f"{e.name}_by({args[0]}, {length_of(args[0], 'interval')}){tail}"
            if e.name in AGGREGATES:
                return aggregate(e.name, args, e.star, e.distinct, tail, kind)
            if e.name not in WINDOW_ONLY:
                raise SqlError(f"unknown window function {e.name}")
            if e.name == "ntile" and not (len(e.args) == 1 and e.args[0].kind == "number" and int(e.args[0].text) > 0):
                raise SqlError("NTILE takes a positive constant")
            text = f"{e.name}({', '.join(args)}){tail}"
            return f"CAST({text} AS BIGINT)" if e.name in RANKS else text
        if e.name in WINDOW_ONLY:
            raise SqlError(f"{e.name} needs OVER")
        if e.name not in SCALAR:
            raise SqlError(f"unknown function {e.name}")
        return SCALAR[e.name](args, kind)

    def spec(self, w: Node, scope: Scope, ordered: bool = False) -> str:
        """ordered: Spark wants some order for the function, and any will do if none is given."""
        if w.kind == "window_name":
            if w.name.lower() not in scope.windows:
                raise SqlError(f"unknown window {w.name}")
            w = scope.windows[w.name.lower()]
        parts = []
        if w.partition:
            parts.append("PARTITION BY " + ", ".join(self.e(x, scope) for x in w.partition))
        if w.order:
            parts.append("ORDER BY " + ", ".join(self.key(k, scope) for k in w.order))
        elif ordered and not w.frame:
            parts.append("ORDER BY true")
        if w.frame:
            unit, low, high = w.frame
            bound = lambda b: b[0] if b[1] is None else f"{self.e(b[1], scope)} {b[0]}"
            parts.append(f"{unit} BETWEEN {bound(low)} AND {bound(high)}")
        return f"({' '.join(parts)})"


def _amounts(e: Node) -> tuple[int, int, int]:
    from ..functions.scalar import interval_parts

    return interval_parts(e.value, e.low, e.high)


def _children(e: Node):
    for v in e.parts.values():
        stack = [v]
        while stack:
            x = stack.pop()
            if isinstance(x, Node):
                yield x
            elif isinstance(x, (list, tuple)):
                stack.extend(reversed(x))


def _walk(e: Node, f: Callable[[Node], object]) -> None:
    """All nodes outside subqueries."""
    f(e)
    for x in _children(e):
        if x.kind != "query":
            _walk(x, f)


def _map(e: Node, f: Callable[[Node], Node]) -> Node:
    def inside(v):
        if isinstance(v, Node):
            return v if v.kind == "query" else _map(v, f)
        if isinstance(v, list):
            return [inside(x) for x in v]
        if isinstance(v, tuple):
            return tuple(inside(x) for x in v)
        return v

    return f(Node(e.kind, {k: inside(v) for k, v in e.parts.items()}, e.src))


#: What by_leaves leaves alone: names that may come from elsewhere, and what is compared by other means than its value.
_UNPARTED = {"star", "query", "scalar", "exists", "in_query", "interval", "window", "window_name"}


def _chain(t: Node) -> list[tuple[Node | None, Node]] | None:
    """The tables of a chain of joins in order, each with its join; None if one side of a join may be filled with nulls on the left."""
    if t.kind == "join":
        left = _chain(t.left)
        if left is None or t.using or t.right.kind in ("join", "nested") or t.how in ("RIGHT", "FULL") or not _equates(t.on):
            return None
        return [*left, (t, t.right)]
    return None if t.kind == "nested" else [(None, t)]


def _aggregates(found: list[Node]) -> list[Node]:
    out: list[Node] = []
    for e in found:
        _walk(e, lambda n: out.append(n) if n.kind == "call" and n.name in AGGREGATES else None)
    return out


def _repeats_alike(call: Node) -> bool:
    """Whether an aggregate stays the same if rows are repeated."""
    return call.parts.get("over") is None and not call.star and (call.name in ("min", "max") or bool(call.distinct)) and bool(call.args)


def _columns(e: Node, aggregates: bool = True) -> list[Node]:
    """The column names in an expression; aggregates: also those in aggregates."""
    if e.kind == "column":
        return [e]
    if not aggregates and e.kind == "call" and e.name in AGGREGATES:
        return []
    return [c for x in _children(e) if x.kind != "query" for c in _columns(x, aggregates)]


def _kinds(found: list[Node]) -> set[str]:
    out: set[str] = set()

    def visit(e: Node) -> None:
        out.add(e.kind)
        for x in _children(e):
            visit(x)

    for e in found:
        visit(e)
    return out


def _is_whole(call: Node, w: Node) -> bool:
    """Whether a window function is an aggregate that is the same for all rows of a partition."""
    if call.name not in AGGREGATES or call.distinct:
        return False
    if w.frame and w.frame[1] == ("UNBOUNDED PRECEDING", None):
        return w.frame[2] == ("UNBOUNDED FOLLOWING", None) or not w.order and w.frame[0] == "RANGE" and w.frame[2] == ("CURRENT ROW", None)
    return not w.frame and not w.order


def _has_window(e: Node) -> bool:
    found = []
    _walk(e, lambda n: found.append(n) if n.kind == "call" and n.parts.get("over") is not None else None)
    return bool(found)


def _names(e: Node, alias: str) -> bool:
    found = []
    _walk(e, lambda n: found.append(n) if n.kind == "column" and len(n.path) == 1 and n.path[0].lower() == alias else None)
    return bool(found)


def _equates(e: Node) -> bool:
    """Whether a join condition has an equality among its conjuncts."""
    if e.kind == "group":
        return _equates(e.e)
    if e.kind == "binary" and e.op == "AND":
        return _equates(e.a) or _equates(e.b)
    return e.kind == "binary" and e.op == "=" and all(_refers(x) for x in (e.a, e.b))


def _refers(e: Node) -> bool:
    found = []
    _walk(e, lambda n: found.append(n) if n.kind == "column" else None)
    return bool(found)
