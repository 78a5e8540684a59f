"""A prompt and a script runner: python -m tessera.repl -db FOLDER [-c SQL] [-echo] [-explain] [-quiet] [-timer]."""

from __future__ import annotations

import argparse
import sys
import time
from collections.abc import Iterable
from typing import TextIO

from .errors import TesseraError
from .formatting import format_table
from .plans import nodes as n
from .plans.grammar import parse_many
from .plans.lexer import tokens
from .session import Conn, Database, Result

HELP = """.tables          list tables
.schema [TABLE]  show the statements that make tables
.explain on|off  show the plan of each statement
.timer on|off    show how long each statement took
.help            show this
.quit, .exit     leave
"""


def complete(text: str) -> bool:
    """Whether the text ends a statement: its last token is a semicolon outside strings and comments."""
    found = tokens(text)
    if found[-1].kind == "error":
        return "unterminated" not in found[-1].text
    return len(found) == 1 or found[-2].is_(";")


class Shell:
    def __init__(self, conn: Conn, out: TextIO = sys.stdout, *, echo: bool = False, explain: bool = False, quiet: bool = False, timer: bool = False) -> None:
        self.conn, self.out = conn, out
        self.echo, self.explain, self.quiet, self.timer = echo, explain, quiet, timer

    def say(self, text: str) -> None:
        self.out.write(text)

    def command(self, line: str) -> bool:
        """Runs a dot command; False to leave."""
        word, *rest = line.split()
        catalog = self.conn.db.catalog
        if word in (".quit", ".exit"):
            return False
        if word == ".tables":
            self.say("".join(f"{x}\n" for x in catalog.names()))
        elif word == ".schema":
            try:
                self.say("".join(f"{t.sql()}\n" for t in ([catalog.get(rest[0])] if rest else catalog.all())))
            except TesseraError as e:
                self.say(f"error: {e}\n")
        elif word in (".explain", ".timer") and rest in (["on"], ["off"]):
            setattr(self, word[1:], rest == ["on"])
        elif word == ".help":
            self.say(HELP)
        else:
            self.say(f"unknown command {line.strip()}; try .help\n")
        return True

    def run(self, text: str) -> bool:
        """Runs statements up to the first error; False if there was one."""
        try:
            for s in parse_many(text):
                if self.explain and isinstance(s, (n.Select, n.Insert, n.Update, n.Delete)):
                    self.say(self.conn.explained(s).rstrip() + "\n")
                start = time.perf_counter()
                self.report(self.conn.run_statement(s), time.perf_counter() - start)
        except TesseraError as e:
            self.say(f"error: {e}\n")
            return False
        return True

    def report(self, r: Result, seconds: float) -> None:
        took = f" ({seconds * 1000:.3f}ms)" if self.timer else ""
        if r.tag in ("SELECT", "EXPLAIN"):
            self.say(r.plan.rstrip() + "\n" if r.tag == "EXPLAIN" else format_table(r.columns, r.rows))
            if r.tag == "SELECT" and not self.quiet:
                self.say(f"-- {r.affected} row{'' if r.affected == 1 else 's'}{took}\n")
        elif not self.quiet:
            self.say(f"-- {r.tag}{f' {r.affected}' if r.tag in ('INSERT', 'UPDATE', 'DELETE') else ''}{took}\n")

    def loop(self, lines: Iterable[str], prompt: bool = False) -> bool:
        held, good = "", True
        if prompt:
            self.say("tessera> ")
        for line in lines:
            if not held and line.lstrip().startswith("."):
                if self.echo:
                    self.say(line)
                if not self.command(line.strip()):
                    return good
            else:
                held += line
                if held.strip() and complete(held):
                    if self.echo:
                        self.say(held)
                    good &= self.run(held)
                    held = ""
            if prompt:
                self.say("   ...> " if held.strip() else "tessera> ")
        return self.run(held) and good if held.strip() else good


def main(args: list[str] | None = None) -> int:
    p = argparse.ArgumentParser(prog="tessera", description=__doc__)
    p.add_argument("-db", default="tessera-db", help="folder of the database")
    p.add_argument("-c", help="statements to run")
    for flag, what in (("echo", "print statements"), ("explain", "print plans"), ("quiet", "print results only"), ("timer", "print times")):
        p.add_argument(f"-{flag}", action="store_true", help=what)
    a = p.parse_args(args)
    from pyspark.sql import SparkSession

    spark = SparkSession.builder.appName("tessera").getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    shell = Shell(Database.open(spark, a.db).conn(), echo=a.echo, explain=a.explain, quiet=a.quiet, timer=a.timer)
    if a.c is not None:
        return 0 if shell.run(a.c) else 1
    shell.loop(sys.stdin, prompt=sys.stdin.isatty())
    return 0


if __name__ == "__main__":
    sys.exit(main())
