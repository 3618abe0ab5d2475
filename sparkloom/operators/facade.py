"""The memory's surface: spaces, atoms, vectors, code and edges in stored tables, and what is asked of them together."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from sparkloom.functions.text import day, relative, space_parts
from sparkloom.operators import code, context, fulltext, graph, ledger, relations, retrieval, search, segmentation, spaces
from sparkloom.operators.lineage import cut_lineage
from sparkloom.operators.ordering import numbered
from sparkloom.operators.proximity import threshold
from sparkloom.sources.store import Store

SPACE = "name string, provider string, model string, dim int"
VECTOR = "space string, id string, v array<double>"
NODE = "qn string, name string, label string, file string, start int, end int"
EDGE = "src string, dst string, kind string, seq bigint"
ADAPTER = "source string, target string, matrix array<array<double>>"

# ---------------------------------------------------------------- writing


def open_home(store: Store, spec: str) -> dict[str, int]:
    """Register a space given as name=provider:model@dim; the counts of the store."""
    row = store.spark.range(1).select(space_parts(F.lit(spec)).alias("s")).first().s
    if row is None:
        raise ValueError(f"{spec} is no name=provider:model@dim")
    write_space(store, *row)
    return ledger.stats(store)


def write_space(store: Store, name: str, provider: str, model: str, dim: int) -> int:
    """Upsert a space; a known name with another model or width is an error, as its vectors are not comparable."""
    known = store.rows("spaces", empty=SPACE).where(F.col("name") == name).first()
    if known is not None and (known.provider, known.model, known.dim) != (provider, model, dim):
        raise ValueError(f"{name} holds vectors of {known.provider}:{known.model}@{known.dim}, not comparable")
    return store.put("spaces", ["name"], store.spark.createDataFrame([(name, provider, model, dim)], SPACE))


def write_entries(store: Store, entries: DataFrame, seq: str | None = None) -> int:
    """Upsert entries, of one id the last by seq, and index their words anew; the number of entries."""
    n = store.put("entries", ["id"], entries, seq)
    reindex(store)
    return n


def reindex(store: Store) -> int:
    return fulltext.index_words(store, "entries", store.rows("entries", empty=ledger.ENTRY).where("status = 'active'").select("id", "text"))


def write_vectors(store: Store, space: str, vectors: DataFrame, seq: str | None = None) -> int:
    """Upsert vectors (id, v) of a space; a vector of another width than the space's is an error."""
    known = store.rows("spaces", empty=SPACE).where(F.col("name") == space).first()
    if known is not None and not vectors.where(F.size("v") != known.dim).isEmpty():
        raise ValueError(f"{space} has {known.dim} numbers a vector")
    columns = ["id", F.col("v").cast("array<double>").alias("v"), *([seq] if seq else [])]
    return store.put("vectors", ["space", "id"], vectors.select(F.lit(space).alias("space"), *columns), seq)


def write_code(store: Store, nodes: DataFrame, edges: DataFrame) -> int:
    """Replace the code's symbols, one row a full name, and its edges (src, dst, kind, seq) between them."""
    kept = code.distinct_nodes(nodes)
    store.replace("code_edges", code.known_only(edges, kept), ["src"])
    return store.replace("code_nodes", kept, ["qn"])


def write_adapter(store: Store, source: str, target: str, matrix: list[list[float]]) -> int:
    return store.put("adapters", ["source", "target"], store.spark.createDataFrame([(source, target, matrix)], ADAPTER))


def bridge(store: Store, source: str, target: str) -> int:
    """Fit and store an adapter from the ids that both spaces have; how many they are."""
    own = store.rows("vectors", empty=VECTOR)
    side = lambda name, column: own.where(F.col("space") == name).select("id", F.col("v").alias(column))
    pairs = cut_lineage(side(source, "src").join(side(target, "dst"), "id"))
    n = pairs.count()
    if n:
        write_adapter(store, source, target, spaces.fit_adapter(pairs))
    return n


def relink(store: Store) -> int:
    """Rebuild the tree's edges from live entries and the code; their number."""
    atoms, nodes = code.atoms_of(store.rows("entries", empty=ledger.ENTRY)), store.rows("code_nodes", empty=NODE)
    edges = code.whole_tree(atoms, nodes, store.rows("code_edges", empty=EDGE))
    return store.replace("edges", edges.dropDuplicates(["src", "dst", "kind"]).withColumn("seq", F.monotonically_increasing_id()), ["src"])


def save(store: Store, keep_seconds: float = 600) -> dict[str, int]:
    """Relink, compact, count."""
    relink(store)
    store.compact(keep_seconds)
    return ledger.stats(store)


def index(store: Store, texts: DataFrame, limit: int, nodes: DataFrame, links: DataFrame, dim: int = 256) -> dict[str, int]:
    """Files to everything: texts (file, text, at) become entries, words and hashed vectors, the code and the tree follow."""
    entries = ledger.entries_of(ledger.drafts({"text": texts}, limit).drop("found"))
    ledger.commit(store, entries, texts.groupBy(F.col("file").alias("path")).agg(F.max("at").alias("mtime")), float(texts.agg(F.max("at")).first()[0] or 0.0))
    reindex(store)
    open_home(store, f"hash=hash:words@{dim}")
    write_vectors(store, "hash", hashed(store.rows("entries", empty=ledger.ENTRY).select("id", "text"), dim))
    write_code(store, nodes, links)
    return save(store)


def hashed(texts: DataFrame, dim: int) -> DataFrame:
    """id, v: dense unit vectors of hashed word counts; a text without words has the zero vector."""
    sparse = search.hash_vectors(texts, dim).groupBy("id").agg(F.map_from_entries(F.collect_list(F.struct("place", "value"))).alias("m"))
    place = F.sequence(F.lit(0).cast("long"), F.lit(dim - 1).cast("long"))
    return texts.select("id").distinct().join(sparse, "id", "left").select("id", F.transform(place, lambda i: F.coalesce(F.try_element_at("m", i), F.lit(0.0))).alias("v"))


# ---------------------------------------------------------------- asking


def query_routes(store: Store, ready: DataFrame) -> DataFrame:
    """How a query reaches each stored space, given the spaces (space) whose models are ready."""
    number = F.row_number().over(Window.orderBy("name")) - 1  # a handful of spaces
    stored = store.rows("spaces", empty=SPACE).select(number.alias("position"), F.col("name").alias("space"))
    pairs = store.rows("adapters", empty=ADAPTER).select((F.row_number().over(Window.orderBy("source", "target")) - 1).alias("position"), "source", "target")
    return spaces.plan_routes(stored, ready, pairs)


def read_adapter(store: Store, source: str, target: str) -> list[list[float]]:
    row = store.rows("adapters", empty=ADAPTER).where((F.col("source") == source) & (F.col("target") == target)).first()
    return row.matrix if row is not None else []


def node(store: Store, ident: str, root: str = "", reach: int = 4) -> DataFrame:
    """One row: an entry's card with up to 20 000 characters, its answer and its neighbours in the file (id, text, status, day)."""
    entries, links = store.rows("entries", empty=ledger.ENTRY), store.rows("relations", empty=ledger.RELATION)
    one = entries.where(F.col("id") == ident)
    card = retrieval.cards(one.select(F.lit(0).alias("query_id"), F.lit(1).alias("place"), "id", F.lit(None).cast("double").alias("score"), F.lit("").alias("via")), entries, links, root, 20_000)
    siblings = entries.join(one.select("file"), "file", "left_semi")
    lined = segmentation.lineage(siblings, "file", "position", "id", reach).where(F.col("id") == ident)
    ids = lined.select(F.posexplode(F.concat("before", F.array("id"), "after")).alias("pos", "id"))
    facts = siblings.join(relations.statuses(siblings, links), "id").select("id", F.left("text", F.lit(160)).alias("text"), F.col("state").alias("status"), day(F.col("at")).alias("day"), relative(F.col("file"), root).alias("file"))
    sides = ids.join(facts, "id").agg(F.array_sort(F.collect_list(F.struct("pos", "id", "text", "status", "day", "file"))).alias("lineage"))
    return card.join(one.select("id", "answer"), "id").crossJoin(sides)  # one row by one row



def ego_graph(store: Store, ident: str, depth: int = 1, limit: int = 60, root: str = "") -> tuple[DataFrame, DataFrame]:
    """(nodes, edges) around an entry: relations in any direction, closed ones too, and the tree's edges at it."""
    links = cut_lineage(numbered(store.rows("relations", empty=ledger.RELATION), "valid_at", "src", "dst", "kind"))
    entries = store.rows("entries", empty=ledger.ENTRY)
    reached = relations.neighbourhood(links, store.spark.createDataFrame([(0, ident)], "query int, id string"), depth, limit)
    nodes = relations.graph_nodes(reached, entries, links, root).drop("query")
    known = cut_lineage(nodes)
    room = max(0, limit - known.count())
    extra = code.around(store.rows("edges", empty=EDGE), ident, limit)
    ends = extra.select(F.when(F.col("src") == ident, F.col("dst")).otherwise(F.col("src")).alias("id")).distinct().join(known.select("id"), "id", "left_anti").orderBy("id").limit(room)
    more = ends.select("id", F.col("id").alias("label"), F.lit("code").alias("status"), F.lit("").alias("day"), F.lit("").alias("file"), F.lit(False).alias("center"))
    every = known.unionByName(more)
    inner = extra.join(every.select(F.col("id").alias("src")), "src", "left_semi").join(every.select(F.col("id").alias("dst")), "dst", "left_semi")
    return every, relations.ego(links, known).unionByName(inner.select("src", "dst", "kind")).distinct()


def ask(store: Store, queries: DataFrame, vectors: DataFrame, budget: int, limit: int = 20, rounds: int = 30) -> str:
    """The block for one question (query_id, text): its best hits, then what personalised PageRank over the stored
    edges puts next to them, as '[kind ref] text' lines within the budget."""
    hits = cut_lineage(threshold(retrieval.fuse_lists(retrieval.ranked_lists(store, queries, vectors, 60), 60, limit).withColumnRenamed("score", "similarity"), 0.0))
    top = hits.agg(F.max("similarity")).first()[0]
    if top is None:
        return ""
    ranks = graph.pagerank(store.rows("edges", empty=EDGE), hits.select(F.col("id").alias("node"), (F.col("similarity") / top).alias("weight")), rounds=rounds).withColumn("rank", F.round("rank", 9))
    near = ranks.join(hits.select(F.col("id").alias("node")), "node", "left_anti").where(~F.startswith("node", F.lit("dir:")) & ~F.startswith("node", F.lit("src:")))
    near = near.orderBy(F.desc("rank"), "node").limit(limit).select(F.col("node").alias("id"), (1000 + F.row_number().over(Window.orderBy(F.desc("rank"), "node"))).alias("place"))
    texts = store.rows("entries", empty=ledger.ENTRY).select("id", F.lit("atom").alias("kind"), F.col("file").alias("ref"), "text")
    symbols = store.rows("code_nodes", empty=NODE).select(F.col("qn").alias("id"), F.lower("label").alias("kind"), "file", F.col("qn").alias("text")).withColumnRenamed("file", "ref")
    pieces = hits.select("id", "place").unionByName(near).join(texts.unionByName(symbols.select("id", "kind", "ref", "text")), "id").withColumn("g", F.lit(0))
    block = context.assemble(pieces, "g", ["place"], budget).first()
    return block.block if block is not None else ""
