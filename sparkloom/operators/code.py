"""Code and text as one graph: folder trees, sources, and links of texts to the files and symbols that they name.

A symbol node has qn, name, label, file, start, end; an atom id, file, text, session, order.
Files are 'file:<path>', folders 'dir:<path>', text sources 'src:<file>'.
"""

from __future__ import annotations

import re

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, StringType

from sparkloom.functions import marks
from sparkloom.operators.lineage import cut_lineage
from sparkloom.operators.selection import first_per

SEAMS = ("edits", "reads", "mentions")
_CHAIN, _QUOTED, _CALLED = re.compile(r"(?<!\w)\w+(?:\.\w+)+"), re.compile(r"`(\w+)`"), re.compile(r"(?<!\w)(\w+)\(")


def mentioned(text: str | None) -> list[str]:
    """Names in a text by first appearance: dotted chains, words in backticks, words before a parenthesis."""
    t = text or ""
    found = [(m.start(), m.group()) for m in _CHAIN.finditer(t)] + [(m.start(1), m.group(1)) for p in (_QUOTED, _CALLED) for m in p.finditer(t)]
    return list(dict.fromkeys(name for _, name in sorted(found, key=lambda x: x[0])))


@F.pandas_udf(ArrayType(StringType()))
def names(texts: pd.Series) -> pd.Series:
    return texts.map(mentioned)


# ---------------------------------------------------------------- trees


def tree_edges(nodes: DataFrame) -> DataFrame:
    """src, dst, kind: 'contains' from the root folder down to every file and its symbols, each pair once."""
    parts = F.split("file", "/")
    folders = F.transform(F.sequence(F.lit(0), F.size(parts) - 1), lambda i: F.concat(F.lit("dir:"), F.array_join(F.slice(parts, F.lit(1), i), "/")))
    steps = F.concat(folders, F.array(F.concat(F.lit("file:"), F.col("file")), F.col("qn")))
    pairs = F.transform(F.sequence(F.lit(1), F.size("s") - 1), lambda i: F.struct(F.element_at("s", i).alias("src"), F.element_at("s", i + 1).alias("dst")))
    return nodes.select(steps.alias("s")).select(F.inline(pairs)).distinct().select("src", "dst", F.lit("contains").alias("kind"))


def source_edges(atoms: DataFrame) -> DataFrame:
    """src, dst, kind: each source contains its atoms, and each atom of a file goes to the next by order.

    Of rows that repeat an id the first by seq counts; equal orders go by seq.
    """
    once = first_per(atoms, ["id"], [F.col("seq")])
    nxt = F.lead("id").over(Window.partitionBy("file").orderBy("order", "seq"))
    chained = once.select("id", "file", nxt.alias("next"))
    contains = chained.select(F.concat(F.lit("src:"), "file").alias("src"), F.col("id").alias("dst"), F.lit("contains").alias("kind"))
    return contains.unionByName(chained.where("next IS NOT NULL").select(F.col("id").alias("src"), F.col("next").alias("dst"), F.lit("next").alias("kind")))


# ---------------------------------------------------------------- links of texts to code


def resolve(paths: DataFrame, files: DataFrame) -> DataFrame:
    """paths plus file: the longest known file that a path (column path) ends in; paths without one go.

    Every end of a path is looked up by an equi-join, so no path meets every file.
    """
    keyed = cut_lineage(paths.withColumn("_row", F.monotonically_increasing_id()))
    ends = keyed.select("_row", F.explode(marks.path_suffixes(F.col("path"))).alias("file"))
    known = files.select("file").where("file <> ''").distinct()
    best = ends.join(known, "file").groupBy("_row").agg(F.max_by("file", F.length("file")).alias("file"))
    return keyed.join(best, "_row").drop("_row")


def file_edges(paths: DataFrame, files: DataFrame, kind: str) -> DataFrame:
    """src, dst, kind, place from paths (src, place, path): one edge a source and file, at its first place."""
    found = resolve(paths, files).groupBy("src", "file").agg(F.min("place").alias("place"))
    return found.select("src", F.concat(F.lit("file:"), "file").alias("dst"), F.lit(kind).alias("kind"), "place")


def lookup(wanted: DataFrame, nodes: DataFrame) -> DataFrame:
    """name, qn of names that mean one symbol: a full name; else the one symbol that a dotted name ends; else the one of a short name.

    Symbols are exploded into the ends of their full names, so both sides meet by equi-joins.
    """
    dotted = F.col("name").contains(".")
    once = wanted.select("name").distinct()
    symbols = nodes.select("qn", "name").distinct()
    parts = F.split("qn", r"\.")
    tails = symbols.select("qn", F.explode(F.transform(F.sequence(F.lit(1), F.size(parts)), lambda i: F.array_join(F.slice(parts, i, F.size(parts)), "."))).alias("name")).where(F.col("name").contains(".")).distinct()
    of_dotted = once.where(dotted).join(tails, "name").groupBy("name").agg(F.max((F.col("qn") == F.col("name"))).alias("exact"), F.count_distinct("qn").alias("n"), F.min("qn").alias("qn"))
    of_dotted = of_dotted.select("name", F.when(F.col("exact"), F.col("name")).when(F.col("n") == 1, F.col("qn")).alias("qn"))
    of_short = once.where(~dotted).join(symbols, "name").groupBy("name").agg(F.count_distinct("qn").alias("n"), F.min("qn").alias("qn")).where("n = 1").select("name", "qn")
    return of_dotted.where("qn IS NOT NULL").unionByName(of_short)


def symbol_edges(texts: DataFrame, nodes: DataFrame) -> DataFrame:
    """src, dst, kind, place from texts (src, text): 'mentions' of symbols, one a source and symbol, at its first place."""
    said = texts.select("src", F.posexplode(names("text")).alias("place", "name"))
    return said.join(lookup(said, nodes), "name").groupBy("src", F.col("qn").alias("dst")).agg(F.min("place").alias("place")).select("src", "dst", F.lit("mentions").alias("kind"), "place")


def stitch(atoms: DataFrame, nodes: DataFrame) -> DataFrame:
    """src, dst, kind, rank, place: atoms to the code that they edit, read or mention; one edge a pair, the strongest kind.

    Order within an atom is rank (edits, reads, files mentioned, symbols mentioned), then place.
    """
    files = nodes.select("file").distinct()
    said = lambda paths: atoms.select(F.col("id").alias("src"), F.posexplode(paths).alias("place", "path"))
    edges = file_edges(said(marks.tool_paths(F.col("text"), marks.EDITS)), files, "edits").withColumn("rank", F.lit(0))
    edges = edges.unionByName(file_edges(said(marks.tool_paths(F.col("text"), ("Read",))), files, "reads").withColumn("rank", F.lit(1)))
    edges = edges.unionByName(file_edges(said(marks.word_paths(F.col("text"))), files, "mentions").withColumn("rank", F.lit(2)))
    edges = edges.unionByName(symbol_edges(atoms.select(F.col("id").alias("src"), "text"), nodes).withColumn("rank", F.lit(3)))
    return first_per(edges, ["src", "dst"], [F.col("rank"), F.col("place")]).select("src", "dst", "kind", "rank", "place")


def atoms_of(entries: DataFrame) -> DataFrame:
    """Atoms of live entries, with tool lines as marks."""
    live = entries.where("status = 'active'")
    return live.select("id", "file", marks.mark_text(F.col("text")).alias("text"), "session", F.col("position").alias("order"), F.col("position").alias("seq"))


def whole_tree(atoms: DataFrame, nodes: DataFrame, links: DataFrame) -> DataFrame:
    """src, dst, kind of everything: the code's tree, text sources, stitched links, the code's own links (src, dst, kind)."""
    own = tree_edges(nodes).unionByName(source_edges(atoms)).unionByName(stitch(atoms, nodes).select("src", "dst", "kind"))
    return own.unionByName(links.select("src", "dst", "kind"))


def known_only(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """Edges of which both ends are known symbols."""
    known = nodes.select("qn").distinct()
    return edges.join(known.withColumnRenamed("qn", "src"), "src", "left_semi").join(known.withColumnRenamed("qn", "dst"), "dst", "left_semi").select(edges.columns)


def distinct_nodes(nodes: DataFrame) -> DataFrame:
    """One row a qn: the least by file, start, end, name and label."""
    order = [F.col(c) for c in ("file", "start", "end", "name", "label")]
    return first_per(nodes, ["qn"], order)


def prefixed(nodes: DataFrame, repository: str) -> DataFrame:
    return nodes.withColumn("file", F.concat_ws("/", F.lit(repository), "file"))


def collect_repositories(parts: dict[str, tuple[DataFrame, DataFrame]]) -> tuple[DataFrame, DataFrame]:
    """(nodes, edges) of several repositories as one, each file behind its repository's name."""
    nodes = edges = None
    for name, (n, e) in parts.items():
        nodes = prefixed(n, name) if nodes is None else nodes.unionByName(prefixed(n, name))
        edges = e if edges is None else edges.unionByName(e)
    return nodes, edges


def seam_lines(ids: DataFrame, edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """id, place, line: what atoms (id) edit, read or mention; symbols that aren't known have no line.

    edges: src, dst, kind, seq (their order).
    """
    seams = edges.where(F.col("kind").isin(*SEAMS)).join(ids.select(F.col("id").alias("src")).distinct(), "src", "left_semi")
    labels = first_per(nodes, ["qn"], [F.col("file"), F.col("start")]).select(F.col("qn").alias("dst"), F.concat(F.col("label"), F.lit(" "), F.col("qn"), F.lit(" — "), F.col("file"), F.lit(":"), F.col("start"), F.lit("-"), F.col("end")).alias("_label"))
    goal = F.when(F.startswith("dst", F.lit("file:")), F.col("dst")).otherwise(F.col("_label"))
    lines = seams.join(labels, "dst", "left").select(F.col("src").alias("id"), "seq", F.concat(F.col("kind"), F.lit(" "), goal).alias("line")).where("line IS NOT NULL")
    return lines.withColumn("place", F.row_number().over(Window.partitionBy("id").orderBy("seq"))).select("id", "place", "line")


def around(edges: DataFrame, atom: str, limit: int) -> DataFrame:
    """The first edges (by seq) at an atom."""
    return edges.where((F.col("src") == atom) | (F.col("dst") == atom)).orderBy("seq").limit(limit).select("src", "dst", "kind")


# ---------------------------------------------------------------- tables of a code indexer


def block_lines(text: str, head: str) -> list[str]:
    """The indented lines, without their indent, below the first line that starts with head."""
    lines = text.splitlines()
    at = next((i for i, line in enumerate(lines) if line.startswith(head)), len(lines))
    out = []
    for line in lines[at + 1 :]:
        if not line.startswith("  "):
            break
        out.append(line[2:])
    return out


_WORD = re.compile(r"""(?:[^\s"'\\]|\\.|"(?:[^"\\]|\\.)*"|'[^']*')+""", re.DOTALL)
_PART = re.compile(r"""\\(.)|"((?:[^"\\]|\\.)*)"|'([^']*)'|([^\s"'\\]+)""", re.DOTALL)


def cells(line: str) -> list[str]:
    """Words of a line as a shell splits them; a line with an open quote or a last backslash has none."""
    if _WORD.sub("", line).strip():
        return []

    def value(m: re.Match) -> str:
        escaped, double, single, bare = m.groups()
        if double is not None:
            return re.sub(r'\\(["\\])', r"\1", double)
        return next(x for x in (escaped, single, bare) if x is not None)

    return ["".join(value(p) for p in _PART.finditer(w.group())) for w in _WORD.finditer(line)]


def table_rows(text: str, head: str = "rows", refs_head: str = "rows_refs") -> list[list[str]]:
    """Rows of a text table, with @N+tail spelled out by the table of references."""
    refs: dict[str, str] = {}
    for row in map(cells, block_lines(text, refs_head)):
        if len(row) == 2:
            refs.setdefault(*row)

    def whole(cell: str) -> str:
        number, plus, tail = cell[1:].partition("+")
        return refs[number] + tail if cell.startswith("@") and plus and number in refs else cell

    return [[whole(c) for c in row] for line in block_lines(text, head + ":") or block_lines(text, head) if (row := cells(line))]


def node_rows(rows: DataFrame, prefix: str) -> DataFrame:
    """Symbols of rows (label, cells): five cells, a full name below prefix, a real file, decimal lines."""
    c = lambda i: F.get("cells", i)
    good = (F.size("cells") == 5) & F.startswith(c(0), F.lit(prefix)) & (c(0) != prefix) & (c(2) != "") & ~F.startswith(c(2), F.lit("<")) & c(3).rlike(r"^\d+$") & c(4).rlike(r"^\d+$")
    return rows.where(F.coalesce(good, F.lit(False))).select(F.substring(c(0), len(prefix) + 1, 1 << 30).alias("qn"), c(1).alias("name"), "label", c(2).alias("file"), c(3).cast("int").alias("start"), c(4).cast("int").alias("end"))


def edge_rows(rows: DataFrame, prefix: str) -> DataFrame:
    """Edges of rows (kind, cells): two cells, both full names below prefix."""
    c = lambda i: F.get("cells", i)
    below = lambda x: F.startswith(x, F.lit(prefix)) & (x != prefix)
    bare = lambda x: F.substring(x, len(prefix) + 1, 1 << 30)
    return rows.where(F.coalesce((F.size("cells") == 2) & below(c(0)) & below(c(1)), F.lit(False))).select(bare(c(0)).alias("src"), bare(c(1)).alias("dst"), "kind")


# ---------------------------------------------------------------- versions of code cards


def card_versions(stored: DataFrame, fresh: DataFrame) -> DataFrame:
    """qn, change of a file's symbols (qn, signature, body: hashes): supersedes, continues, none, added or removed."""
    s, f = stored.alias("s"), fresh.alias("f")
    both = s.join(f, "qn", "full_outer")
    change = F.when(F.col("s.body").isNull(), "added").when(F.col("f.body").isNull(), "removed").when(F.col("s.signature") != F.col("f.signature"), "supersedes").when(F.col("s.body") != F.col("f.body"), "continues").otherwise("none")
    return both.select("qn", change.alias("change"))


def resolve_references(refs: DataFrame, cards: DataFrame, common: list[str]) -> DataFrame:
    """refs plus target: the active card that a name means, null if none does.

    refs: ref, src_file, lang, name; cards: id, qn, file, lang. Cards meet by a name's last
    part: one of the same file first, then, unless the name is a common one, a full name,
    one of the same folder, any; ties go to the smaller id.
    """
    last = lambda c: F.element_at(F.split(c, r"[.:]+"), -1)
    folder = lambda c: F.regexp_replace(c, r"[^/]*$", "")
    known = cards.select(F.col("id").alias("target"), F.col("qn"), F.col("file"), F.col("lang"), last(F.col("qn")).alias("_last"))
    met = refs.withColumn("_last", last(F.col("name"))).join(known, ["_last", "lang"])
    rank = F.when(F.col("file") == F.col("src_file"), 0).when(F.col("_last").isin(common) if common else F.lit(False), None).when(F.col("qn") == F.col("name"), 1).when(folder(F.col("file")) == folder(F.col("src_file")), 2).otherwise(3)
    best = first_per(met.withColumn("_rank", rank).where("_rank IS NOT NULL"), ["ref"], [F.col("_rank"), F.col("target")]).select("ref", "target")
    return refs.join(best, "ref", "left")


# ---------------------------------------------------------------- cards


def card_text(cards: DataFrame) -> DataFrame:
    """id, text that stands for a card (id, kind, subkind, qn, docstring, known): what it is, its docstring, and what is known of its meaning.

    known maps names to values; of purpose, architectural_role and side_effects_summary those
    that are known appear, in this order.
    """
    facts = [F.when(F.col("known")[n].isNotNull() & (F.col("known")[n] != "Unknown"), F.concat(F.lit(f"{n}: "), F.col("known")[n])) for n in ("purpose", "architectural_role", "side_effects_summary")]
    head = F.concat("kind", F.lit(":"), "subkind", F.lit(" "), "qn")
    return cards.select("id", F.concat_ws("\n", head, F.nullif("docstring", F.lit("")), *facts).alias("text"))


def card_faults(fields: DataFrame) -> DataFrame:
    """The fields (value, confidence, evidence, ...) that claim something without evidence, or a value without confidence, with the fault."""
    none = F.col("confidence") == "none"
    empty = F.coalesce(F.size("evidence"), F.lit(0)) <= 0
    fault = F.when(empty & ~none, "confidence without evidence").when(none & F.col("value").isNotNull() & (F.col("value") != "Unknown"), "value without confidence")
    return fields.withColumn("fault", fault).where("fault IS NOT NULL")
