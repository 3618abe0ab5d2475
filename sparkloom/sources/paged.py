"""An outside code indexer as a Spark data source: pages of symbols and links, read by tasks that share out the pages."""

from __future__ import annotations

import json
import shlex
import shutil
import subprocess
import time
from collections.abc import Iterator
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, EqualTo, Filter, In, InputPartition

from sparkloom.operators.code import distinct_nodes, edge_rows, known_only, node_rows

# Kinds that an indexer is asked for.
SYMBOLS, LINKS = ("Function", "Method", "Class"), ("CALLS", "USAGE")
#: Rows a page, tasks that share out the pages of a kind, and calls of one page before it fails.
PAGE, LANES, TRIES = 200, 4, 3
#: Spark's switch for filters that reach Python sources; sources that take filters need it on.
PUSHDOWN = "spark.sql.python.filterPushdown.enabled"


@dataclass
class Lane(InputPartition):
    """Pages first, first + lanes, first + 2 lanes, ... of one kind."""

    kind: str
    first: int


class PageReader(DataSourceReader):
    def __init__(self, options: dict[str, str]) -> None:
        self.command = shlex.split(options["command"])
        self.kinds = [k for k in options.get("kinds", ",".join(SYMBOLS + LINKS)).split(",") if k]
        self.page, self.lanes, self.tries = (int(options.get(name, default)) for name, default in (("page", PAGE), ("lanes", LANES), ("tries", TRIES)))
        self.pause = float(options.get("pause", 0.5))
        if min(self.page, self.lanes, self.tries) < 1:
            raise ValueError("page, lanes and tries must be at least 1")

    def pushFilters(self, filters: list[Filter]) -> Iterator[Filter]:
        """Kinds that a query doesn't want are never asked for; all other filters are left to Spark."""
        for f in filters:
            if isinstance(f, EqualTo) and f.attribute == ("kind",):
                self.kinds = [k for k in self.kinds if k == f.value]
            elif isinstance(f, In) and f.attribute == ("kind",):
                self.kinds = [k for k in self.kinds if k in f.value]
            else:
                yield f

    def partitions(self) -> list[InputPartition]:
        # a query for no kind still needs a task
        return [Lane(kind, first) for kind in self.kinds for first in range(self.lanes)] or [Lane("", 0)]

    def _rows(self, kind: str, skip: int) -> list[list]:
        """One page; a call that fails or gives no list of rows is made again, `tries` times in all."""
        said = ""
        for attempt in range(self.tries):
            if attempt:
                time.sleep(self.pause * attempt)
            done = subprocess.run([*self.command, kind, str(skip), str(self.page)], capture_output=True, text=True, encoding="utf-8", check=False)
            said = done.stderr.strip() or done.stdout.strip()[:500] or f"exit code {done.returncode}"
            if done.returncode == 0:
                try:
                    rows = json.loads(done.stdout)
                    if isinstance(rows, list) and all(isinstance(r, list) for r in rows) and len(rows) <= self.page:
                        return rows
                except ValueError:
                    pass
        raise RuntimeError(f"page {skip // self.page} of {kind}: {said}")

    def read(self, partition: Lane) -> Iterator[tuple]:
        """Rows of a lane's pages up to the first that isn't full."""
        if not partition.kind:
            return
        if shutil.which(self.command[0]) is None:
            raise FileNotFoundError(self.command[0])
        page = partition.first
        while True:
            rows = self._rows(partition.kind, page * self.page)
            yield from ((partition.kind, page, [None if c is None else str(c) for c in r]) for r in rows)
            if len(rows) < self.page:
                return
            page += self.lanes


class CodePages(DataSource):
    """Format `code_pages`: kind, page, cells of an indexer's answers.

    Options: command (called with a kind, how many rows to skip and how many to give; prints a
    JSON list of rows), kinds, page, lanes, tries and pause. The pages of a kind are shared out
    among `lanes` tasks without knowing how many there are: a task ends at its first page that
    isn't full, so a kind costs at most one page a task too many. An indexer must give its
    rows in one order; a task that is run again asks for its pages again.
    """

    @classmethod
    def name(cls) -> str:
        return "code_pages"

    def schema(self) -> str:
        return "kind string, page int, cells array<string>"

    def reader(self, schema) -> DataSourceReader:
        return PageReader(self.options)


def register(spark: SparkSession) -> None:
    """Make the format `code_pages` known to a session."""
    spark.conf.set(PUSHDOWN, "true")
    spark.dataSource.register(CodePages)


def code_graph(spark: SparkSession, command: str, project: str, **options: str) -> tuple[DataFrame, DataFrame]:
    """(nodes, edges) of a project: symbols below it, one row a full name, and links both ends of which are among them."""
    register(spark)
    # two relations, as scans of one would share what is pushed down to either
    load = lambda kinds: spark.read.format("code_pages").options(command=command, kinds=",".join(kinds), **options).load()
    prefix = project + "."
    nodes = distinct_nodes(node_rows(load(SYMBOLS).select(F.col("kind").alias("label"), "cells"), prefix))
    edges = edge_rows(load(LINKS).select("kind", "cells"), prefix)
    return nodes, known_only(edges, nodes)
