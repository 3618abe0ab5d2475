"""A curved map between embedding spaces: a two-layer correction of a linear map, trained by sums of gradients."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sparkloom.operators.lineage import cut_lineage, release
from sparkloom.operators.proximity import ridge

#: Rows of a block, the unit over which gradients are summed, and blocks that are summed in one step.
ROWS, FAN_IN = 4096, 16
#: Of a hundred rows, how many only say when to stop.
HELD_OUT = 15
_RATE, _DECAY, _BEND = 1e-3, 1e-4, np.sqrt(2 / np.pi)


@dataclass
class CurvedMap:
    """x @ linear + gelu(x @ inner + shift) @ outer + base, and the mean cosine on held-out pairs that it reached."""

    linear: np.ndarray
    inner: np.ndarray
    shift: np.ndarray
    outer: np.ndarray
    base: np.ndarray
    held_out: float = 0.0

    def parameters(self) -> list[np.ndarray]:
        return [self.linear, self.inner, self.shift, self.outer, self.base]

    def __call__(self, x: np.ndarray) -> np.ndarray:
        return x @ self.linear + _gelu(x @ self.inner + self.shift)[0] @ self.outer + self.base

    def gradients(self, x: np.ndarray, y: np.ndarray) -> tuple[float, list[np.ndarray]]:
        """(sum of cosines, gradients of the sum of 1 - cosine) over rows of x and unit rows of y."""
        h = x @ self.inner + self.shift
        g, slope = _gelu(h)
        p = x @ self.linear + g @ self.outer + self.base
        length = np.maximum(np.linalg.norm(p, axis=1, keepdims=True), 1e-12)
        cos = (p * y).sum(1, keepdims=True) / length
        dp = (cos * p / length - y) / length
        dh = dp @ self.outer.T * slope
        return float(cos.sum()), [x.T @ dp, x.T @ dh, dh.sum(0), g.T @ dp, dp.sum(0)]


def _gelu(h: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(values, slopes) of the smooth ramp h times the chance that a normal draw is below h, in its tanh form."""
    t = np.tanh(_BEND * (h + 0.044715 * h**3))
    return 0.5 * h * (1 + t), 0.5 * (1 + t) + 0.5 * h * (1 - t * t) * _BEND * (1 + 3 * 0.044715 * h * h)


def _blocks(pairs: DataFrame, seed: int, rows: int) -> DataFrame:
    """block, x, y, held of rows with finite vectors, as matrices in the order of ids: the same whatever the partitioning."""
    good = lambda c: F.size(c).cast("int") > 0
    finite = lambda c: F.forall(c, lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < float("inf")))
    known = pairs.where(F.col("id").isNotNull() & good("src") & good("dst") & finite("src") & finite("dst")).select(F.col("id").cast("string").alias("id"), F.col("src").cast("array<double>").alias("src"), F.col("dst").cast("array<double>").alias("dst"))
    known = cut_lineage(known)
    n = max(1, -(-known.count() // rows))
    held = F.pmod(F.xxhash64(F.lit(seed), "id"), F.lit(100)) < HELD_OUT
    dealt = known.select(F.pmod(F.xxhash64("id"), F.lit(n)).alias("block"), "id", "src", "dst", held.alias("held"))

    def packed(frame: pd.DataFrame) -> pd.DataFrame:
        frame = frame.sort_values(["id"], kind="stable")
        x, y = (np.array(frame[c].tolist(), float) for c in ("src", "dst"))
        length = np.linalg.norm(y, axis=1, keepdims=True)
        kept = length[:, 0] > 0
        return pd.DataFrame({"block": frame["block"].iloc[:1], "n": int(kept.sum()), "x": [x[kept].tobytes()], "y": [(y / np.maximum(length, 1e-300))[kept].tobytes()], "held": [frame["held"].to_numpy()[kept].tobytes()]})

    return cut_lineage(dealt.groupBy("block").applyInPandas(packed, "block long, n long, x binary, y binary, held binary"), known)


def _summed(blocks: DataFrame, model: CurvedMap, widths: tuple[int, int]) -> tuple[np.ndarray, np.ndarray]:
    """(cosines and rows, trained on and held out; gradients in one row) over all blocks, always added in the same order."""
    sent = blocks.sparkSession.sparkContext.broadcast(model)

    def each(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        m = sent.value
        for f in frames:
            for r in f.itertuples():
                x, y, held = np.frombuffer(r.x).reshape(-1, widths[0]), np.frombuffer(r.y).reshape(-1, widths[1]), np.frombuffer(r.held, bool)
                cos, grads = m.gradients(x[~held], y[~held])
                other = m.gradients(x[held], y[held])[0] if held.any() else 0.0
                row = np.concatenate([[cos, (~held).sum(), other, held.sum()], *(g.ravel() for g in grads)])
                yield pd.DataFrame({"block": [r.block], "sums": [row.tobytes()]})

    def added(frame: pd.DataFrame) -> pd.DataFrame:
        frame = frame.sort_values("block")
        total = np.sum([np.frombuffer(b) for b in frame["sums"]], axis=0)
        return pd.DataFrame({"block": [int(frame["block"].iloc[0]) // FAN_IN], "sums": [total.tobytes()]})

    sums = blocks.mapInPandas(each, "block long, sums binary")
    n = blocks.count()
    while n > FAN_IN:
        sums = sums.groupBy(F.expr(f"block div {FAN_IN}")).applyInPandas(added, "block long, sums binary")
        n = -(-n // FAN_IN)
    rows = sorted(sums.collect(), key=lambda r: r.block)  # FAN_IN rows of the model's size at most
    sent.unpersist()
    total = np.sum([np.frombuffer(r.sums) for r in rows], axis=0)
    return total[:4], total[4:]


def fit_curved(pairs: DataFrame, hidden: int = 64, rounds: int = 100, seed: int = 0, penalty: float = 1e-3, patience: int = 20, rows: int = ROWS) -> CurvedMap:
    """The map of least mean 1 - cosine found in `rounds` rounds from pairs (id, src, dst); the round best on held-out pairs counts.

    Starts from the ridge map with a correction near none. A round is one pass over the
    pairs, which stay on the executors as matrices; only the model goes out, and sums of
    gradients, combined FAN_IN at a time, come back. Rows are dealt to blocks by a hash of
    id and added in a fixed order, so the map doesn't depend on partitions. Pairs with a
    null, empty, zero or non-finite vector teach nothing; ids should be unique; all vectors
    of a side need one width. Without pairs there is an error. Ends early after `patience`
    rounds without a better one.
    """
    first = pairs.where("size(src) > 0 AND size(dst) > 0").select(F.size("src").alias("a"), F.size("dst").alias("b")).first()
    if first is None:
        raise ValueError("no pairs to learn from")
    widths, rng = (first.a, first.b), np.random.default_rng(seed)
    blocks = _blocks(pairs, seed, rows)
    held = F.pmod(F.xxhash64(F.lit(seed), F.col("id").cast("string")), F.lit(100)) < HELD_OUT
    linear = np.array(ridge(pairs.where(~held), penalty))
    model = CurvedMap(linear, rng.normal(0, 1 / np.sqrt(widths[0]), (widths[0], hidden)), np.zeros(hidden), rng.normal(0, 0.01 / np.sqrt(hidden), (hidden, widths[1])), np.zeros(widths[1]))
    moments = [(np.zeros_like(p), np.zeros_like(p)) for p in model.parameters()]
    best, best_round = None, 0
    for step in range(1, rounds + 2):
        (cos, n, other, m), flat = _summed(blocks, model, widths)
        now = other / m if m else cos / max(n, 1)
        if best is None or now > best.held_out:
            best, best_round = CurvedMap(*(p.copy() for p in model.parameters()), held_out=float(now)), step
        if step - best_round >= patience or step > rounds:
            break
        at = 0
        for p, (mean, square) in zip(model.parameters(), moments):
            g = flat[at : at + p.size].reshape(p.shape) / max(n, 1)
            at += p.size
            mean += 0.1 * (g - mean)
            square += 0.001 * (g * g - square)
            p -= _RATE * 10 * (mean / (1 - 0.9**step) / (np.sqrt(square / (1 - 0.999**step)) + 1e-8) + _DECAY * p)
    release(blocks)
    return best


def carry_curved(vectors: DataFrame, model: CurvedMap, vector: str = "v", out: str = "carried") -> DataFrame:
    """vectors with column out: the mapped vector at length 1, or an empty array where it doesn't fit the map."""
    width = len(model.linear)
    names = [c for c in vectors.columns if c != out]
    at = names.index(vector)

    def run(tables: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t in tables:
            rows = t.column(at).to_pylist()
            fits = [i for i, v in enumerate(rows) if v is not None and len(v) == width and None not in v and np.isfinite(v).all()]
            mapped: list[list[float]] = [[] for _ in rows]
            if fits:
                y = model(np.array([rows[i] for i in fits], float))
                y /= np.maximum(np.linalg.norm(y, axis=1, keepdims=True), 1e-300)
                for i, v in zip(fits, y.tolist()):
                    mapped[i] = v
            yield pa.RecordBatch.from_arrays([*t.columns, pa.array(mapped, pa.list_(pa.float64()))], names=[*names, out])

    from pyspark.sql.types import ArrayType, DoubleType, StructField, StructType

    base = vectors.select(*(F.col(f"`{c}`") for c in names))
    return base.mapInArrow(run, StructType([*base.schema.fields, StructField(out, ArrayType(DoubleType()))]))
