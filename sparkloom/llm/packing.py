"""Conflict-constrained best-fit packing of documents into fixed-length sequences."""

from __future__ import annotations

from bisect import bisect_left, insort

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sparkloom.operators.lineage import cut_lineage

CAPACITY = 2048
#: Documents that one packing task gets on average; tasks are hash buckets, so they are even whatever the sources.
GROUP = 1024


def best_fit(items: list[tuple[int, int, int]], capacity: int) -> list[tuple[int, int]]:
    """(bin, offset) of each (size, source bit, cluster bit), in order.

    Open bins are kept in order of (residual, bin). A successor search from the item's size
    goes up until the first bin that holds neither the item's source nor its cluster, which
    is the tightest compatible one; with none, a bin is opened. Full bins leave the list.
    Where an item like the one before it, that had to open a bin, comes next, no search is
    needed: only a bin of its own source has been added.
    """
    order: list[tuple[int, int]] = []
    sources: list[int] = []
    clusters: list[int] = []
    out = []
    refused = None
    for item in items:
        size, source, cluster = item
        s, c = 1 << source, 1 << cluster
        i = bisect_left(order, (size, -1)) if item != refused else len(order)
        while i < len(order) and (sources[order[i][1]] & s or clusters[order[i][1]] & c):
            i += 1
        refused = item if i == len(order) else None
        if i < len(order):
            residual, at = order.pop(i)
        else:
            residual, at = capacity, len(sources)
            sources.append(0)
            clusters.append(0)
        out.append((at, capacity - residual))
        sources[at] |= s
        clusters[at] |= c
        if residual > size:
            insort(order, (residual - size, at))
    return out


def pack(docs: DataFrame, capacity: int = CAPACITY, group: int = GROUP) -> DataFrame:
    """doc_id, piece, start, length, bin_id, offset for docs with doc_id, size, source and cluster.

    A document longer than the capacity is cut: its full pieces fill bins of their own and
    only the rest is packed, so no word is lost. No bin holds two documents of one source or
    of one duplicate cluster; a null source is a source, a null cluster conflicts with
    nothing. Documents are dealt by a hash of their row, rows that repeat each for itself,
    into groups of about `group`, packed by decreasing length, ties by id, each group for
    itself; bin_id is unique over all. Documents of size 0 or null give no row; repeated
    rows and null ids are packed each; an empty table gives none. Extra columns are ignored.
    """
    fields = ["doc_id", F.col("size").cast("long").alias("size"), "source", "cluster"]
    sized = docs.where(F.col("size") > 0).select(*fields).groupBy("doc_id", "size", "source", "cluster").agg(F.count("*").alias("n"))
    sized = cut_lineage(sized.withColumn("copy", F.explode(F.sequence(F.lit(1).cast("long"), "n"))).drop("n"))
    groups = max(1, sized.count() // group)
    sized = sized.withColumn("g", F.pmod(F.xxhash64("doc_id", "size", "source", "cluster", "copy"), F.lit(groups)).cast("int"))

    def one(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.assign(rest=rows["size"] % capacity, full=rows["size"] // capacity)
        source = pd.factorize(rows["source"], use_na_sentinel=False, sort=True)[0]
        cluster = pd.factorize(rows["cluster"], sort=True)[0]
        rows = rows.assign(s=source, c=np.where(cluster < 0, cluster.max(initial=-1) + 1 + np.arange(len(rows)), cluster))
        rows = rows.sort_values(["rest", "doc_id", "size", "s", "c", "copy"], ascending=[False, True, True, True, True, True], kind="stable")
        tail = rows[rows["rest"] > 0]
        base = int(rows["g"].iloc[0]) << 40
        placed = best_fit(list(tail[["rest", "s", "c"]].itertuples(index=False, name=None)), capacity)
        used = max((b for b, _ in placed), default=-1) + 1
        out = [(d, int(f), int(f) * capacity, int(n), base + b, o) for (d, f, n), (b, o) in zip(tail[["doc_id", "full", "rest"]].itertuples(index=False, name=None), placed, strict=True)]
        for d, f in rows.loc[rows["full"] > 0, ["doc_id", "full"]].itertuples(index=False, name=None):
            out += [(d, p, p * capacity, capacity, base + used + p, 0) for p in range(int(f))]
            used += int(f)
        frame = pd.DataFrame(out, columns=["doc_id", "piece", "start", "length", "bin_id", "offset"])
        return frame.astype({"doc_id": "Int64"})

    return sized.groupBy("g").applyInPandas(one, "doc_id long, piece long, start long, length long, bin_id long, offset long")
