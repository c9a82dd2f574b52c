"""A small SQL shell: ``python -m millrace [-d DIR] [-q SQL] [-i FILE] [-v]``."""

from __future__ import annotations

import argparse
import csv
import io
import json
import sys
import time

from millrace import __version__
from millrace.engine import Engine

HELP = """.tables .schema [NAME] .databases .mode table|csv|json|list .headers on|off
.timer on|off .show .dump [NAME] .version .help .exit"""


class Shell:
    def __init__(self, engine: Engine, out=sys.stdout) -> None:
        self.engine, self.out = engine, out
        self.mode, self.headers, self.timer, self.limit = "table", True, False, 1000

    def show(self, df) -> None:
        """Prints at most ``limit`` rows; a shell isn't an export."""
        rows = df.limit(self.limit).collect()
        names = df.columns
        if self.mode == "json":
            for r in rows:
                print(json.dumps(r.asDict(recursive=True), default=str), file=self.out)
            return
        cells = [["NULL" if v is None else str(v) for v in r] for r in rows]
        if self.mode == "csv":
            held = io.StringIO()
            csv.writer(held, lineterminator="\n").writerows(([names] if self.headers else []) + cells)
            print(held.getvalue(), end="", file=self.out)
            return
        if self.mode == "list":
            for row in ([names] if self.headers else []) + cells:
                print("|".join(row), file=self.out)
            return
        widths = [max([len(n) if self.headers else 0, *(len(r[i]) for r in cells)]) for i, n in enumerate(names)]
        for row in ([names, ["-" * w for w in widths]] if self.headers else []) + cells:
            print("  ".join(c.ljust(w) for c, w in zip(row, widths)).rstrip(), file=self.out)

    def command(self, line: str) -> bool:
        """Runs a dot command; True to leave."""
        name, *rest = line[1:].split()
        say = lambda *x: print(*x, file=self.out)
        if name in ("exit", "quit"):
            return True
        if name == "help":
            say(HELP)
        elif name == "version":
            say(__version__)
        elif name == "tables":
            self.show(self.engine.sql("SHOW TABLES"))
        elif name == "databases":
            self.show(self.engine.sql("SHOW DATABASES"))
        elif name == "schema":
            for t in rest or self.engine.store.names():
                say(self._ddl(t))
        elif name == "dump":
            for t in rest or self.engine.store.names():
                say(self._ddl(t))
                for row in self.engine.store.read(t).toLocalIterator():
                    say(f"INSERT INTO {t} VALUES ({', '.join(_literal(v) for v in row)});")
        elif name == "show":
            say(f"mode={self.mode} headers={self.headers} timer={self.timer}")
        elif name == "mode" and rest and rest[0] in ("table", "csv", "json", "list"):
            self.mode = rest[0]
        elif name in ("headers", "timer") and rest and rest[0] in ("on", "off"):
            setattr(self, name, rest[0] == "on")
        else:
            say(f"unknown command {line}")
        return False

    def _ddl(self, table: str) -> str:
        fields = ", ".join(f"{f.name} {f.dataType.simpleString().upper()}" for f in self.engine.store.schema(table).fields)
        return f"CREATE TABLE {table} ({fields});"

    def run(self, sql: str) -> None:
        began = time.time()
        self.show(self.engine.sql(sql))
        if self.timer:
            print(f"{time.time() - began:.3f} s", file=self.out)

    def loop(self, lines) -> None:
        held = ""
        for line in lines:
            if not held and line.strip().startswith("."):
                if self.command(line.strip()):
                    return
                continue
            held += line
            if held.strip().endswith(";"):
                try:
                    self.run(held)
                except Exception as error:  # a shell goes on after a failed statement
                    print(f"Error: {error}", file=self.out)
                held = ""
        if held.strip():
            self.run(held)


def _literal(v) -> str:
    if v is None:
        return "NULL"
    if isinstance(v, (bool, int, float)):
        return str(v)
    return "'" + str(v).replace("'", "''") + "'"


def main(args: list[str] | None = None) -> int:
    parser = argparse.ArgumentParser(prog="millrace")
    parser.add_argument("-d", "--database", help="folder of managed tables")
    parser.add_argument("-q", "--query", help="run this and leave")
    parser.add_argument("-i", "--input", help="run the statements of this file and leave")
    parser.add_argument("-t", "--tables", help="folder of Parquet tables to register as views")
    parser.add_argument("-v", "--version", action="store_true")
    given = parser.parse_args(args)
    if given.version:
        print(__version__)
        return 0
    from millrace.session import session

    spark = session(extra={"spark.ui.enabled": "false", "spark.ui.showConsoleProgress": "false"})
    spark.sparkContext.setLogLevel("ERROR")
    engine = Engine(spark, given.database)
    if given.tables:
        engine.register(given.tables)
    shell = Shell(engine)
    if given.query:
        shell.run(given.query)
    elif given.input:
        with open(given.input) as lines:
            shell.loop(lines)
    else:
        shell.loop(sys.stdin)
    return 0


if __name__ == "__main__":
    sys.exit(main())
