"""Command line: queries, a shell, backup and restore, serving, external sources.

    python -m graniteql.cli [--store DIR] [--format table|csv|jsonl] [--csv-null TEXT] -c "SELECT 1"
    python -m graniteql.cli --store DIR shell | profile SQL | backup DIR | restore DIR | serve [--port N] | migrate
    python -m graniteql.cli --store DIR datasource add NAME csv|parquet LOCATION | list | remove NAME | refresh NAME
"""

from __future__ import annotations

import argparse
import sys
import time
from collections.abc import Callable, Iterable

from .session import Engine, Session
from .sql import commands

HELP = ".tables: list tables   .help: this text   .quit: leave   statements end with ;"


def show(session: Session, text: str, how: str, null: str, out: Callable[[str], object]) -> None:
    for result in session.script(text):
        for line in result.render(how, null):
            out(line)


def shell(session: Session, how: str, null: str, lines: Iterable[str], out: Callable[[str], object]) -> None:
    """Reads statements, which may span lines; an error is told and the shell goes on."""
    held = ""
    for line in lines:
        word = line.strip()
        if not held and word.startswith("."):
            if word == ".quit":
                return
            if word == ".tables":
                show(session, "SHOW TABLES", how, null, out)
            else:
                out(HELP if word == ".help" else f"unknown command {word}; .help lists them")
            continue
        held += line if line.endswith("\n") else line + "\n"
        if held.rstrip().endswith(";"):
            try:
                show(session, held, how, null, out)
            except Exception as e:  # noqa: BLE001 - an error ends the statement, not the shell
                out(f"error: {str(e).splitlines()[0]}")
            held = ""


def main(argv: list[str] | None = None, engine: Engine | None = None, out: Callable[[str], object] = print, lines: Iterable[str] | None = None) -> int:
    p = argparse.ArgumentParser(prog="graniteql")
    p.add_argument("--store")
    p.add_argument("--format", choices=("table", "csv", "jsonl"), default="table")
    p.add_argument("--csv-null", default="")
    p.add_argument("-c", "--command")
    p.add_argument("action", nargs="?", choices=("shell", "profile", "backup", "restore", "serve", "migrate", "datasource"))
    p.add_argument("args", nargs="*")
    p.add_argument("--port", type=int, default=8443)
    p.add_argument("--token")
    p.add_argument("--tls", nargs=2)
    a = p.parse_args(argv)
    if a.action == "restore":
        from .store.database import Store

        target = engine or Engine()
        Store.restore(target.spark, a.args[0], a.store)
        out("restored")
        return 0
    engine = engine or Engine(store=a.store)
    session = engine.session()
    if a.command:
        try:
            show(session, a.command, a.format, a.csv_null, out)
        except Exception as e:  # noqa: BLE001
            print(f"error: {str(e).splitlines()[0]}", file=sys.stderr)
            return 1
    elif a.action == "profile":
        commands.parse(a.args[0])
        started = time.time()
        result = session.execute(a.args[0])
        rows = len(result.fetchall())
        out(f"{rows} rows in {time.time() - started:.3f} s")
        for line in session.execute(f"EXPLAIN {a.args[0]}").render("csv"):
            out(line)
    elif a.action == "backup":
        engine.backup(a.args[0])
        out("backed up")
    elif a.action == "migrate":
        engine._store().checkpoint()
        out("the store is of the current format")
    elif a.action == "datasource":
        what, *rest = a.args
        if what == "add":
            engine.add_external(*rest)
        elif what == "remove":
            engine.remove_external(rest[0])
        elif what == "refresh":
            engine.refresh_table(rest[0])
        for name in engine.list_externals():
            out(name)
    elif a.action == "serve":
        from .http.server import serve

        server = serve(engine, "127.0.0.1" if not a.tls else "0.0.0.0", a.port, a.token, tuple(a.tls) if a.tls else None)
        out(f"serving on port {server.server_address[1]}")
        server.serve_forever()
    else:
        shell(session, a.format, a.csv_null, lines if lines is not None else sys.stdin, out)
    return 0


if __name__ == "__main__":
    sys.exit(main())
