"""N-gram Jaccard join: count-vector R-trees over hashed shingle groups, exact by construction.

A document is its set of hashed 5-word shingles; documents with equal sets are one set.
Sets A and B link when 100 |A & B| >= percent * |A | B|.

1. Screening (exact). In hash order, linked sets share l shingles of their first
   floor((1 - t) n) + l each, so a set too few of whose first shingles occur in another set
   has no link and goes no further. Shingles travel as packed arrays; those that repeat in
   one map task travel once, so a passage that very many documents share stays small.
2. Linking. Sets that share a least hash under one of two orders meet in a block of bounded
   size. A block's R-tree holds each set's point, its shingle counts by hash group; the
   overlap of a set and a node is at most the sum over groups of the smaller of the set's
   count and the node's largest. Survivors are verified on the full sets, unless links
   already join them. Connected components follow.
3. Completion (exact). Linked sets share first shingles as in the screening. Where
   such a shingle still meets two components, its sets meet in R-trees again, once for all
   shingles of the same sets and larger ones split into a grid of bounded sub-blocks, and
   pairs across components that share enough first shingles are verified.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sparkloom.llm.common import mix64, parts_for, set_id, shingle_sets
from sparkloom.operators.graph import components
from sparkloom.operators.lineage import cut_lineage, release

#: Hash groups, the coordinates of a point.
GROUPS = 256
LEAF = 16
#: Sets that one block of the linking holds at most, on average; a shingle of more is hot in the completion.
BLOCK = 512
#: Sets of one side of the completion's grid.
SIDE = 4096
FLUSH = 1 << 20
#: Frequent shingles that are broadcast at most (8 bytes each).
HOT = 1 << 20
#: A screened entry carries this many bytes of its shingle's hash and of its set's id; chance agreement only lets sets pass.
HASH_BYTES, TAG_BYTES = 6, 5
TAG_MASK = (1 << 8 * TAG_BYTES) - 1
SECOND_ORDER = np.uint64(0xA24BAED4963EE407)


# ---------------------------------------------------------------- R-tree


def group_counts(hashes: np.ndarray) -> np.ndarray:
    """A set's point: how many of its shingles fall in each hash group, as bytes; 255 stands for 255 or more."""
    counts = np.bincount((hashes & np.uint64(GROUPS - 1)).astype(np.int64), minlength=GROUPS)
    return np.minimum(counts, 255).astype(np.uint8)


def _points(blobs: list[bytes]) -> np.ndarray:
    """Points as rows; 255 becomes a count that no other limits, so that bounds stay upper bounds."""
    points = np.frombuffer(b"".join(blobs), np.uint8).reshape(len(blobs), GROUPS).astype(np.int32)
    points[points == 255] = 1 << 22
    return points


class CountTree:
    """Static R-tree over points in order of size: leaves of LEAF points, nodes of LEAF nodes.

    A node keeps its largest count in each group and its least size.
    """

    def __init__(self, points: np.ndarray, sizes: np.ndarray):
        self.levels = [(points, sizes)]
        while len(self.levels[-1][0]) > LEAF:
            top, size = self.levels[-1]
            starts = np.arange(0, len(top), LEAF)
            self.levels.append((np.maximum.reduceat(top, starts, axis=0), np.minimum.reduceat(size, starts)))

    def search(self, point: np.ndarray, size: int, percent: int, before: int | None = None, comps: np.ndarray | None = None, own: int = 0) -> np.ndarray:
        """Positions below before whose bound on the overlap admits a link to a set of this point and size.

        Points are in order of size, so too small sets are a prefix; with comps, sets of
        component own are left out before their bounds are taken.
        """
        before = len(self.levels[0][0]) if before is None else before
        start = int(np.searchsorted(self.levels[0][1], -(-percent * size // 100)))
        at = np.arange(len(self.levels[-1][0]))
        for depth in range(len(self.levels) - 1, -1, -1):
            top, least = self.levels[depth]
            span = LEAF**depth
            at = at[(at * span < before) & ((at + 1) * span > start)]
            if not depth and comps is not None:
                at = at[comps[at] != own]
            bound = np.minimum(top[at], point).sum(axis=1, dtype=np.int64)
            at = at[(100 + percent) * bound >= percent * (least[at] + size)]
            if depth:
                at = (at[:, None] * LEAF + np.arange(LEAF)).ravel()
                at = at[at < len(self.levels[depth - 1][0])]
        return at


def linked(a: np.ndarray, b: np.ndarray, percent: int) -> bool:
    """Exact: 100 |a & b| >= percent |a | b| for sorted distinct hashes."""
    both = np.concatenate((a, b))
    both.sort(kind="stable")
    shared = int(np.count_nonzero(both[1:] == both[:-1]))
    return (100 + percent) * shared >= percent * (len(a) + len(b))


def spanning_links(sets: list[np.ndarray], points: np.ndarray, percent: int) -> list[tuple[int, int]]:
    """Verified links that join the same sets as all links among them do."""
    sizes = np.array([len(s) for s in sets], np.int64)
    order = np.argsort(sizes, kind="stable")
    tree = CountTree(points[order], sizes[order])
    root = np.arange(len(sets))
    out = []
    for p, i in enumerate(order):
        near = order[tree.search(points[i], int(sizes[i]), percent, p, root[order], root[i])]
        while len(near := near[root[near] != root[i]]):
            j, near = near[0], near[1:]
            if linked(sets[i], sets[j], percent):
                out.append((int(i), int(j)))
                root[root == root[j]] = root[i]
    return out


def possible_pairs(points: np.ndarray, sizes: np.ndarray, comps: np.ndarray, percent: int, sides: np.ndarray | None = None) -> Iterator[tuple[int, int]]:
    """Pairs of different components whose bound admits a link; with sides, only pairs of unlike sides."""
    if len(points) == 2:
        if comps[0] != comps[1] and (100 + percent) * int(np.minimum(points[0], points[1]).sum()) >= percent * int(sizes.sum()):
            yield 0, 1
        return
    order = np.argsort(sizes, kind="stable")
    tree = CountTree(points[order], sizes[order])
    placed = comps[order]
    for p, i in enumerate(order):
        near = order[tree.search(points[i], int(sizes[i]), percent, p, placed, comps[i])]
        if sides is not None:
            near = near[sides[near] != sides[i]]
        for j in near:
            yield int(i), int(j)


# ---------------------------------------------------------------- screening


def _key() -> Column:
    """Tells rows apart that differ in id or text."""
    return F.xxhash64("doc_id", "text").alias("key")


def _firsts(n: int, percent: int) -> int:
    """How many first shingles of a set of n are screened."""
    return n * (100 - percent) // 100 + n // 8 + 1


def _pack(values: np.ndarray, tags: np.ndarray) -> bytes:
    low = lambda x, n: np.ascontiguousarray(x.astype("<u8").view(np.uint8).reshape(-1, 8)[:, :n]).tobytes()
    return low(values, HASH_BYTES) + low(tags, TAG_BYTES)


def _unpack(blobs: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    sizes = [len(b) // (HASH_BYTES + TAG_BYTES) for b in blobs]
    values, tags = np.zeros((sum(sizes), 8), np.uint8), np.zeros((sum(sizes), 8), np.uint8)
    at = 0
    for b, n in zip(blobs, sizes, strict=True):
        values[at : at + n, :HASH_BYTES] = np.frombuffer(b, np.uint8, n * HASH_BYTES).reshape(n, -1)
        tags[at : at + n, :TAG_BYTES] = np.frombuffer(b, np.uint8, n * TAG_BYTES, n * HASH_BYTES).reshape(n, -1)
        at += n
    return values.view("<u8").ravel().astype(np.uint64), tags.view("<i8").ravel().astype(np.int64)


_SCREEN = pa.schema([("bucket", pa.int32()), ("doc_id", pa.int64()), ("key", pa.int64()), ("sid", pa.int64()), ("n", pa.int64()), ("blob", pa.binary())])
_SCREEN_DDL = "bucket int, doc_id long, key long, sid long, n long, blob binary"


def _batch(bucket=(), doc_id=None, key=None, sid=None, n=None, blob=None) -> pa.RecordBatch:
    size = len(bucket)
    columns = [bucket, doc_id, key, sid, n, blob]
    return pa.RecordBatch.from_arrays([pa.nulls(size, f.type) if c is None else c if isinstance(c, pa.Array) else pa.array(c, f.type) for c, f in zip(columns, _SCREEN, strict=True)], schema=_SCREEN)


def _dealt(values: np.ndarray, tags: np.ndarray, by: np.ndarray, buckets: int) -> pa.RecordBatch:
    """The entries packed by bucket."""
    bucket = ((by >> np.uint64(3)) % np.uint64(buckets)).astype(np.int64)
    order = np.argsort(bucket, kind="stable")
    cuts = np.searchsorted(bucket[order], np.arange(buckets + 1))
    values, tags = values[order], tags[order]
    full = [b for b in range(buckets) if cuts[b] < cuts[b + 1]]
    return _batch(full, blob=[_pack(values[cuts[b] : cuts[b + 1]], tags[cuts[b] : cuts[b + 1]]) for b in full])


def _credit(values: np.ndarray, tags: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(first of each run in a sorted order, lengths, credited tags): a tag is credited for each
    value that it has in common with another entry; tag 0 stands for several entries elsewhere."""
    order = np.argsort(values, kind="stable")
    v, t = values[order], tags[order]
    first = np.flatnonzero(np.concatenate(([True], v[1:] != v[:-1]))) if len(v) else np.zeros(0, np.int64)
    length = np.diff(np.append(first, len(v)))
    many = (length > 1) | (np.logical_or.reduceat(t == 0, first) if len(v) else np.zeros(0, bool))
    hot = np.repeat(many, length) & (t != 0)
    return order, np.where(many, -first - 1, first), t[hot]


def _emit(k: int, percent: int, buckets: int):
    def run(tables: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        values: list[np.ndarray] = []
        tags: list[np.ndarray] = []
        held = 0

        def flush() -> Iterator[pa.RecordBatch]:
            v, t = np.concatenate(values), np.concatenate(tags)
            order, first, credited = _credit(v, t)
            one = order[first[first >= 0]]
            many = order[-first[first < 0] - 1]
            yield _dealt(np.concatenate((v[one], v[many])), np.concatenate((t[one], np.zeros(len(many), np.int64))), np.concatenate((v[one], v[many])), buckets)
            sids, n = np.unique(credited, return_counts=True)
            if len(sids):
                credit = _dealt(n.astype(np.uint64), sids, mix64(sids.astype(np.uint64)), buckets)
                yield _batch((-1 - np.asarray(credit.column("bucket"))).tolist(), blob=credit.column("blob"))
            values.clear()
            tags.clear()

        for table in tables:
            sets = shingle_sets(table.column("text").cast(pa.binary()).to_pylist(), k)
            sids = [(set_id(s) or 1) if len(s) else None for s in sets]
            keys = table.column("key")
            yield _batch([x % buckets for x in keys.to_pylist()], table.column("doc_id"), keys, sids, [len(s) for s in sets])
            for s, sid in zip(sets, sids, strict=True):
                if sid is not None:
                    first = s[: _firsts(len(s), percent)]
                    values.append(first)
                    tags.append(np.full(len(first), max(1, sid & TAG_MASK), np.int64))
                    held += len(first)
                if held >= FLUSH:
                    yield from flush()
                    held = 0
        if values:
            yield from flush()

    return run


def _meet(buckets: int):
    def run(table: pa.Table) -> pa.Table:
        """Entries of one bucket meet; documents and credits pass on."""
        packed = np.asarray(table.column("blob").is_valid()) & (np.asarray(table.column("bucket")) >= 0)
        rest = table.filter(pa.array(~packed))
        blobs = table.column("blob").filter(pa.array(packed)).to_pylist()
        if not blobs:
            return rest
        *_, credited = _credit(*_unpack(blobs))
        sids, n = np.unique(credited, return_counts=True)
        if not len(sids):
            return rest
        credit = _dealt(n.astype(np.uint64), sids, mix64(sids.astype(np.uint64)), buckets)
        credit = _batch((-1 - np.asarray(credit.column("bucket"))).tolist(), blob=credit.column("blob"))
        return pa.concat_tables([rest.cast(_SCREEN), pa.Table.from_batches([credit])])

    return run


def _add_up(table: pa.Table) -> pa.Table:
    n, sids = _unpack(table.column("blob").to_pylist())
    ids, at = np.unique(sids, return_inverse=True)
    return pa.table({"sid": ids, "credit": np.bincount(at, weights=n.astype(np.float64)).astype(np.int64)})


def _screened(docs: DataFrame, k: int, percent: int) -> tuple[DataFrame, DataFrame]:
    """(doc_id, key, sid, n of every document; sid, key, n of the sets that may have links)."""
    buckets = parts_for(docs, 4 << 20, 64)
    keyed = docs.select("doc_id", "text", _key())
    emitted = keyed.mapInArrow(_emit(k, percent, buckets), _SCREEN_DDL)
    met = cut_lineage(emitted.groupBy("bucket").applyInArrow(_meet(buckets), _SCREEN_DDL))
    rows = met.where("key IS NOT NULL").select("doc_id", "key", "sid", "n")
    credits = met.where("blob IS NOT NULL").select("bucket", "blob").groupBy("bucket").applyInArrow(_add_up, "sid long, credit long").withColumnRenamed("sid", "tag")
    distinct = rows.where("sid IS NOT NULL").groupBy("sid").agg(F.min("key").alias("key"), F.max("n").alias("n"), F.min("doc_id").alias("least"))
    need = F.expr(f"(n * {percent} + 99) div 100 div 8 + 1")
    return rows, cut_lineage(distinct.withColumn("tag", F.greatest(F.lit(1).cast("long"), F.col("sid").bitwiseAND(F.lit(TAG_MASK)))).join(credits, "tag").where(F.col("credit") >= need).select("sid", "key", "n", "least"))


# ---------------------------------------------------------------- linking and completion


def _sets(docs: DataFrame, alive: DataFrame, k: int) -> DataFrame:
    """sid, n, hashes, first, second, point of each set that passed, from its document's text."""
    keyed = docs.select("text", _key()).join(alive.select("key", "sid"), "key").select("sid", "text")
    fields = [("sid", pa.int64()), ("n", pa.int64()), ("hashes", pa.binary()), ("first", pa.int64()), ("second", pa.int64()), ("point", pa.binary())]

    def run(tables: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t in tables:
            sets = shingle_sets(t.column("text").cast(pa.binary()).to_pylist(), k)
            rows = [(sid, s) for sid, s in zip(t.column("sid").to_pylist(), sets, strict=True) if len(s) and (set_id(s) or 1) == sid]
            signed = lambda x: int(x.astype(np.int64))
            columns = [[sid for sid, _ in rows], [len(s) for _, s in rows], [s.tobytes() for _, s in rows], [signed(s[0]) for _, s in rows], [signed(mix64(s ^ SECOND_ORDER).min()) for _, s in rows], [group_counts(s).tobytes() for _, s in rows]]
            yield pa.RecordBatch.from_arrays([pa.array(c, f[1]) for c, f in zip(columns, fields, strict=True)], names=[f[0] for f in fields])

    sets = cut_lineage(keyed.mapInArrow(run, "sid long, n long, hashes binary, first long, second long, point binary"))
    rows, distinct = sets.select(F.count("sid"), F.count_distinct("sid")).first()
    return sets if rows == distinct else cut_lineage(sets.dropDuplicates(["sid"]), sets)


def _runs(*columns: np.ndarray) -> Iterator[np.ndarray]:
    """Positions of each group of rows alike in columns."""
    order = np.lexsort(columns)
    if not len(order):
        return
    new = np.zeros(len(order), bool)
    for c in columns:
        new[1:] |= c[order][1:] != c[order][:-1]
    yield from np.split(order, np.flatnonzero(new))


def _linked_in_blocks(sets: DataFrame, percent: int) -> DataFrame:
    """a, b: verified links among the sets of each block."""
    keys = sets.select("sid", F.explode(F.array("first", "second")).alias("k"))
    full = keys.groupBy("k").agg(F.count("*").alias("c")).where("c > 1")
    blocks = keys.join(full, "k").select("sid", "k", F.pmod(F.xxhash64("sid", "k"), F.expr(f"(c + {BLOCK - 1}) div {BLOCK}")).alias("salt"))
    tasks = parts_for(sets, 4 << 20, 64)
    dealt = blocks.join(sets.select("sid", "hashes"), "sid").withColumn("task", F.pmod(F.xxhash64("k", "salt"), F.lit(tasks)).cast("int"))

    def run(t: pa.Table) -> pa.Table:
        sids, blobs = t.column("sid").to_numpy(), t.column("hashes").to_pylist()
        out = []
        for at in _runs(t.column("salt").to_numpy(), t.column("k").to_numpy()):
            if len(at) > 1:
                found = [np.frombuffer(blobs[i], np.uint64) for i in at]
                out += [(sids[at[i]], sids[at[j]]) for i, j in spanning_links(found, _points([group_counts(s).tobytes() for s in found]), percent)]
        return pa.table({"a": pa.array([a for a, _ in out], pa.int64()), "b": pa.array([b for _, b in out], pa.int64())})

    return dealt.groupBy("task").applyInArrow(run, "a long, b long")


def _entries(sets: DataFrame, comp: DataFrame, percent: int, hot: np.ndarray) -> DataFrame:
    """h, sid, comp, n: the first shingles of each set in one order for all: by hash, hot ones last."""
    shared = sets.sparkSession.sparkContext.broadcast(hot)

    def firsts(tables: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        late = shared.value
        for t in tables:
            arrays = []
            for b, n in zip(t.column("hashes").to_pylist(), t.column("n").to_pylist(), strict=True):
                h = np.frombuffer(b, np.int64)
                if len(late):
                    is_hot = late[np.minimum(np.searchsorted(late, h), len(late) - 1)] == h
                    h = np.concatenate((h[~is_hot], h[is_hot]))
                arrays.append(h[: _firsts(n, percent)])
            yield pa.RecordBatch.from_arrays([t.column("sid"), t.column("n"), pa.array(arrays, pa.list_(pa.int64()))], names=["sid", "n", "firsts"])

    labelled = sets.select("sid", "n", "hashes").mapInArrow(firsts, "sid long, n long, firsts array<long>").join(comp, F.col("sid") == F.col("node"), "left")
    return labelled.select("sid", "n", F.coalesce("root", "sid").alias("comp"), F.explode("firsts").alias("h"))


def _open_shingles(entries: DataFrame) -> DataFrame:
    """What each first shingle that meets two components gathers: counts and extremes, no lists."""
    every = [F.min("comp").alias("lo"), F.max("comp").alias("hi"), F.count("*").alias("c"), F.bit_xor(F.xxhash64("sid")).alias("who"), F.min("sid").alias("a"), F.max("sid").alias("b"), F.min("n").alias("n")]
    return cut_lineage(entries.groupBy("h").agg(*every).where("lo <> hi"))


def _across_components(sets: DataFrame, comp: DataFrame, percent: int) -> tuple[DataFrame, list[DataFrame]]:
    """(a, b: distinct pairs of sets of different components that may have a link; the tables behind them).

    Shingles that gather more than a block go last in the order of first shingles (the
    HOT most frequent of them: which ones changes the cost, not the result). Of first
    shingles that the same sets share, one stands for all, with their number as its
    weight; a pair with a link has at least the weight that the screening asks for.
    """
    entries = _entries(sets, comp, percent, np.zeros(0, np.int64))
    open_ = _open_shingles(entries)
    hot = open_.where(f"c > {BLOCK}").orderBy(F.desc("c"), "h").limit(HOT).select("h").toPandas()["h"].to_numpy(np.int64)
    if len(hot):
        entries = _entries(sets, comp, percent, np.sort(hot))
        release(open_)
        open_ = _open_shingles(entries)
    once = cut_lineage(open_.groupBy("lo", "hi", "c", "who", "a", "b", "n").agg(F.min("h").alias("h"), F.count("*").alias("w")), open_)
    two = once.where("c = 2").select("a", "b", "n", "w")
    split = F.expr(f"(c + {SIDE - 1}) div {SIDE}")
    members = entries.join(once.where("c > 2").select("h", "c", "w"), "h").select("h", "w", "sid", "comp", split.alias("s"), F.pmod(F.xxhash64("sid", "h"), split).alias("own"))
    members = members.withColumn("other", F.explode(F.sequence(F.lit(0).cast("long"), F.col("s") - 1)))
    members = members.select("h", "w", "sid", "comp", F.least("own", "other").alias("x"), F.greatest("own", "other").alias("y"), "own")
    tasks = parts_for(sets, 2 << 20, 64)
    dealt = members.join(sets.select("sid", "n", "point"), "sid").withColumn("task", F.pmod(F.xxhash64("h", "x", "y"), F.lit(tasks)).cast("int"))

    def run(t: pa.Table) -> pa.Table:
        sid, n, comps, own, x, y, w = (t.column(c).to_numpy() for c in ("sid", "n", "comp", "own", "x", "y", "w"))
        points = _points(t.column("point").to_pylist())
        found: dict[tuple[int, int], list] = {}
        for at in _runs(y, x, t.column("h").to_numpy()):
            if len(at) > 1:
                sides = own[at] if x[at[0]] != y[at[0]] else None
                for i, j in possible_pairs(points[at], n[at], comps[at], percent, sides):
                    a, b = (at[i], at[j]) if sid[at[i]] < sid[at[j]] else (at[j], at[i])
                    found.setdefault((sid[a], sid[b]), [min(n[a], n[b]), 0])[1] += w[a]
        rows = [(*k, *v) for k, v in found.items()]
        return pa.table({c: pa.array([r[i] for r in rows], pa.int64()) for i, c in enumerate(("a", "b", "n", "w"))})

    pairs = two.unionByName(dealt.groupBy("task").applyInArrow(run, "a long, b long, n long, w long"))
    return pairs.groupBy("a", "b").agg(F.sum("w").alias("w"), F.min("n").alias("n")).where("w >= n div 8 + 1").select("a", "b"), [once]


def _verified(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """The pairs whose points admit a link and whose full sets have it."""

    def bounded(tables: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t in tables:
            shared = np.minimum(_points(t.column("pa").to_pylist()), _points(t.column("pb").to_pylist())).sum(axis=1, dtype=np.int64)
            ok = (100 + percent) * shared >= percent * (t.column("na").to_numpy() + t.column("nb").to_numpy())
            yield t.select(["a", "b"]).filter(pa.array(ok))

    def run(tables: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t in tables:
            ok = [linked(np.frombuffer(a, np.uint64), np.frombuffer(b, np.uint64), percent) for a, b in zip(t.column("ha").to_pylist(), t.column("hb").to_pylist(), strict=True)]
            yield t.select(["a", "b"]).filter(pa.array(ok, pa.bool_()))

    side = lambda x, column, short: sets.select(F.col("sid").alias(x), F.col(column).alias(short + x), F.col("n").alias("n" + x))
    near = pairs.join(side("a", "point", "p"), "a").join(side("b", "point", "p"), "b").mapInArrow(bounded, "a long, b long")
    both = near.join(side("a", "hashes", "h").drop("na"), "a").join(side("b", "hashes", "h").drop("nb"), "b")
    return both.mapInArrow(run, "a long, b long")


def labelled_documents(docs: DataFrame, k: int = 5, percent: int = 75) -> DataFrame:
    """doc_id, key, n, grp, component_id of every row of docs; rows that links join share grp."""
    rows, alive = _screened(docs, k, percent)
    sets = _sets(docs, alive, k)
    first = components(_linked_in_blocks(sets, percent).toDF("src", "dst"))
    pairs, spent = _across_components(sets, first, percent)
    more = _verified(pairs, sets, percent)
    root = lambda x: first.select(F.col("node").alias(x), F.col("root").alias("r" + x))
    more = more.join(root("a"), "a", "left").join(root("b"), "b", "left").select(F.coalesce("ra", "a").alias("src"), F.coalesce("rb", "b").alias("dst"))
    second = components(more)
    for table in (sets, *spent):
        release(table)
    label = alive.select("sid", "least").join(first, F.col("sid") == F.col("node"), "left").select("sid", "least", F.coalesce("root", "sid").alias("c"))
    label = cut_lineage(label.join(second, F.col("c") == F.col("node"), "left").select("sid", "least", F.coalesce("root", "c").alias("c")))
    named = label.join(label.groupBy("c").agg(F.min("least").alias("component_id")), "c").select("sid", "c", "component_id")
    return rows.join(named, "sid", "left").select("doc_id", "key", "n", F.coalesce("c", "sid", "key").alias("grp"), F.coalesce("component_id", "doc_id").alias("component_id"))


def ngram_components(docs: DataFrame, k: int = 5, percent: int = 75) -> DataFrame:
    """doc_id, n_shingles, component_id of every row of docs (doc_id, text; more columns are ignored).

    component_id is the least doc_id that links reach, its own included. Rows of null,
    empty or blank text have no shingle, link with nothing and keep their own id. Rows
    that repeat an id are judged each by its own text; a null id never becomes a
    component's id unless all of the component's are null. An empty table gives no rows.
    """
    return labelled_documents(docs, k, percent).select("doc_id", F.col("n").alias("n_shingles"), "component_id")


def one_of_each_group(docs: DataFrame, k: int = 5, percent: int = 75) -> DataFrame:
    """The row of least doc_id of each group of linked rows, with all columns of docs, whatever their names.

    Rows of equal id and text leave one, and so do rows of null id and text. Null, empty and
    blank texts link with nothing and stay. An empty table stays empty.
    """
    labels = labelled_documents(docs, k, percent)
    kept = labels.groupBy("grp").agg(F.min_by("key", F.struct(F.col("doc_id").isNull(), "doc_id", "key")).alias("key")).select("key")
    return docs.select(_key(), F.struct("*").alias("row")).join(kept, "key", "left_semi").dropDuplicates(["key"]).select("row.*")
