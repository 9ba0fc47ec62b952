"""Bootstrap draws as vectors: a component's multiplicities over all replicates are one row of a matrix.

Component totals then become replicate sums by matrix products.  Draw i of replicate r is
SHA-256(context|[within|]r|i) mod k as in `resample.component_draws`, which any engine can replay.

`replicate_sums` keeps draws on the executors: tasks draw one replicate of one set at a time and send its counts on in packed pieces
of neighbouring components, each piece meets the totals of its components, and only sums travel further.  `sorted_curve` needs whole
rows of the matrix in sorted order; it holds and sends a block of at most BLOCK_CELLS cells at a time.
"""

from __future__ import annotations

import zlib
from collections.abc import Callable, Iterator
from dataclasses import dataclass, replace

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from labeltrail.functions.digests import numbered
from labeltrail.functions.hashing import key_text
from labeltrail.operators.ranking import Order, dense_index, null_safe_join
from labeltrail.session import cut_lineage

#: Cells of a block of multiplicities (two bytes each).
BLOCK_CELLS = 1 << 25
#: Rows of a task that are multiplied by a block at once.
ROWS = 1024
#: Cells of the matrix that a piece holds (components x replicates), and components of a piece at most.
PIECE_CELLS, PIECE = 1 << 24, 8192
#: Distinct places up to which a curve is built from sums per place.
PLACES = 256


@dataclass(frozen=True)
class Draws:
    """`index`: (within..., key, _c) numbers components; `sets`: (text of the within values, first number, components).

    A set's first number is a multiple of `piece`, so that no piece holds components of two sets.
    """

    index: DataFrame
    key: str
    within: list[str]
    sets: list[tuple[str, int, int]]
    replicates: int
    context: str
    piece: int

    @property
    def numbers(self) -> int:
        return max((first + k for _, first, k in self.sets), default=0)


def vector_draws(components: DataFrame, key: str, replicates: int, context: str, within: list[str] | None = None) -> Draws | None:
    """Draws of `components`, or None where one replicate alone exceeds a block (use the joined draws of `resample` then).

    The driver sees a row per value of `within`, such as a role or a method.
    """
    within = within or []
    idx = cut_lineage(dense_index(components, key, within))
    sizes = idx.groupBy(*within).agg(F.max("n_keys").alias("k")).withColumn("text", key_text(*[F.col(w) for w in within])).collect()
    sets, first, rows, piece = [], 0, [], max(1, min(PIECE, PIECE_CELLS // max(replicates, 1)))
    for r in sizes:
        if r.k is not None:
            sets.append((r.text, first, int(r.k)))
            rows.append((*[r[w] for w in within], first))
            first += -(-int(r.k) // piece) * piece
    if any(k > BLOCK_CELLS for _, _, k in sets):
        return None
    if within:
        kinds = ", ".join(f"`{w}` {idx.schema[w].dataType.simpleString()}" for w in within)
        starts = components.sparkSession.createDataFrame(rows, f"{kinds}, _first bigint")
        idx = null_safe_join(idx, F.broadcast(starts), within)
    else:
        idx = idx.withColumn("_first", F.lit(0).cast("bigint"))
    return Draws(idx.select(*within, key, (F.col("key_index") + F.col("_first")).alias("_c")), key, within, sets, replicates, context, piece)


def _drawn(prefix: bytes, k: int) -> np.ndarray:
    """Multiplicities of a set's k components in one replicate."""
    return np.bincount(numbered(prefix, 0, k) % k, minlength=k).astype(np.uint16)


def _prefix(draws: Draws, text: str, replicate: int) -> bytes:
    return "|".join([draws.context, *([text] if draws.within else []), str(replicate), ""]).encode()


def blocks(draws: Draws) -> Iterator[tuple[int, int, np.ndarray]]:
    """(first, last, numbers x replicates) of each block; tasks make one replicate each."""
    spark, n = draws.index.sparkSession, draws.numbers
    step, plan = max(1, BLOCK_CELLS // max(n, 1)), _without_index(draws)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for r in batch.column(0).to_pylist():
                counts = np.zeros(n, np.uint16)
                for text, first, k in plan.sets:
                    counts[first:first + k] = _drawn(_prefix(plan, text, r), k)
                yield pa.record_batch([pa.array([r], pa.int64()), pa.array([counts.tobytes()], pa.binary())], ["r", "counts"])

    tasks = spark.sparkContext.defaultParallelism * 4
    for first in range(0, draws.replicates, step):
        last = min(first + step, draws.replicates)
        out = np.empty((last - first, n), np.uint16)
        for r in spark.range(first, last, numPartitions=min(tasks, last - first)).mapInArrow(run, "r bigint, counts binary").collect():  # one block
            out[r.r - first] = np.frombuffer(r.counts, np.uint16)
        yield first, last, np.ascontiguousarray(out.T)


def _without_index(draws: Draws) -> Draws:
    """What a task needs of the draws."""
    return replace(draws, index=None)


def _packed(counts: np.ndarray) -> bytes:
    """Counts as a byte each, or two where one exceeds 255, entropy-coded."""
    c = zlib.compressobj(1, zlib.DEFLATED, strategy=zlib.Z_HUFFMAN_ONLY)
    return c.compress(counts.astype(np.uint8 if counts.max() < 256 else np.uint16).tobytes()) + c.flush()


def _unpacked(packed: bytes, n: int) -> np.ndarray:
    raw = zlib.decompress(packed)
    return np.frombuffer(raw, np.uint8 if len(raw) == n else np.uint16)


def draw_pieces(draws: Draws) -> DataFrame:
    """(_p, replicate, counts): multiplicities of the components of each piece; a task draws one replicate of one set at a time."""
    spark, plan = draws.index.sparkSession, _without_index(draws)
    n, size = len(draws.sets), draws.piece

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for unit in batch.column(0).to_pylist():
                r, (text, first, k) = unit // n, plan.sets[unit % n]
                counts = _drawn(_prefix(plan, text, r), k)
                at = range(0, k, size)
                yield pa.record_batch([pa.array([(first + i) // size for i in at], pa.int64()), pa.array([r] * len(at), pa.int32()),
                                       pa.array([_packed(counts[i:i + size]) for i in at], pa.binary()),
                                       pa.array([min(size, k - i) for i in at], pa.int32())], ["_p", "replicate", "counts", "_n"])

    units = draws.replicates * n
    tasks = max(1, min(units, spark.sparkContext.defaultParallelism * 8))
    return spark.range(0, units, numPartitions=tasks).mapInArrow(run, "_p bigint, replicate int, counts binary, _n int")


def replicate_sums(totals: DataFrame, draws: Draws, by: list[str], columns: list[str]) -> DataFrame:
    """(by..., within..., replicate, columns): sums of component totals under every replicate's multiplicities.

    A replicate that drew no component of a group has no row for it, as with joined draws.  A column without any value sums to null.
    """
    groups = list(dict.fromkeys([*by, *draws.within]))
    work = null_safe_join(totals, draws.index, [*draws.within, draws.key])
    work = cut_lineage(work.select(*groups, F.to_json(F.struct(F.lit(0).alias("_0"), *groups)).alias("_g"), "_c", *[F.col(c).cast("double").alias(f"_v{i}") for i, c in enumerate(columns)]))
    values, size = [f"_v{i}" for i in range(len(columns))], draws.piece
    schema = ", ".join(["_g string, replicate int", *(f"{v} double" for v in values)])

    def sums(pieces: pd.DataFrame, rows: pd.DataFrame) -> pd.DataFrame:
        """One piece: a row for each group and replicate that drew one of its components here."""
        out = [pd.DataFrame({"_g": pd.Series([], dtype=object), "replicate": np.empty(0, np.int32), **{v: np.empty(0) for v in values}})]
        if len(pieces) and len(rows):
            n, replicates = int(pieces["_n"].iloc[0]), pieces["replicate"].to_numpy(np.int32)
            matrix = np.stack([_unpacked(c, n) for c in pieces["counts"]])
            for name, part in rows.groupby("_g", sort=False):
                c, x = part["_c"].to_numpy() % size, part[values].to_numpy(np.float64)
                x = np.c_[np.nan_to_num(x), ~np.isnan(x), np.ones(len(x))]
                total = np.zeros((len(replicates), x.shape[1]))
                for at in range(0, len(c), ROWS):
                    total += matrix[:, c[at:at + ROWS]].astype(np.float64) @ x[at:at + ROWS]
                drawn, w = total[:, -1] > 0, len(values)
                held = {v: np.where(total[drawn, w + i] > 0, total[drawn, i], np.nan) for i, v in enumerate(values)}
                out.append(pd.DataFrame({"_g": name, "replicate": replicates[drawn], **held}))
        return pd.concat(out[1:] or out, ignore_index=True)

    pieces = draw_pieces(draws).groupBy("_p")
    rows = work.select(F.floor(F.col("_c") / size).cast("bigint").alias("_p"), "_g", "_c", *values).groupBy("_p")
    parts = pieces.cogroup(rows).applyInPandas(lambda a, b: sums(a, b), schema)
    # Null, not NaN, is a piece without values, so that it does not spoil the sum.
    done = parts.groupBy("_g", "replicate").agg(*[F.sum(F.when(~F.isnan(v), F.col(v))).alias(v) for v in values])
    whole = ("long", "integer", "short", "byte")
    value = lambda v, c: (F.round(v).cast("bigint") if totals.schema[c].dataType.typeName() in whole else F.col(v)).alias(c)
    done = done.join(work.select(*groups, "_g").distinct(), "_g")
    return done.select(*groups, "replicate", *[value(v, c) for v, c in zip(values, columns)])


def few_values(rows: DataFrame, by: list[str], place: str) -> bool:
    """Whether no group has more than PLACES distinct values."""
    most = rows.select(*by, place).distinct().groupBy(*by).agg(F.count("*").alias("n")).agg(F.max("n")).first()[0]
    return (most or 0) <= PLACES


def place_sums(cells: DataFrame, place: str, columns: list[str], draws: Draws) -> DataFrame | None:
    """(replicate, place, columns) where an order has at most PLACES places, else None."""
    if cells.select(place).distinct().limit(PLACES + 1).count() > PLACES:
        return None
    totals = cells.groupBy(*draws.within, draws.key, place).agg(*[F.sum(c).alias(c) for c in columns])
    sums = replicate_sums(totals, draws, [place], columns)
    return sums.groupBy("replicate", place).agg(*[F.sum(c).alias(c) for c in columns])


Step = Callable[[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray], np.ndarray]


def sorted_curve(cells: DataFrame, order: Order, a: str, b: str, draws: Draws, step: Step) -> np.ndarray:
    """A value per replicate from one sorted pass: the sum of `step` over the distinct places of an order.

    cells: draws' key and within, the order's columns and two amounts a and b, which count once for each copy of their
    component.  `step` gets, for places x replicates, a and b of the place, their running totals with it, and the whole totals.
    Rows with equal order columns are one place.  Rows are range-partitioned by the order, so only totals of parts, one vector each,
    meet on the driver: parts x replicates numbers of one block.
    """
    from labeltrail.operators.ranking import _parts, _sort_cols

    spark = cells.sparkSession
    names = [c for c, _ in order]
    work = null_safe_join(cells, draws.index, [*draws.within, draws.key]).select(*names, F.col(a).cast("double").alias("_a"), F.col(b).cast("double").alias("_b"), "_c")
    work = work.groupBy(*names, "_c").agg(F.sum("_a").alias("_a"), F.sum("_b").alias("_b"))
    work = _parts(work, [], order)
    change = F.struct(*names)
    found = []
    for _, _, matrix in blocks(draws):
        shared, n = spark.sparkContext.broadcast(matrix), matrix.shape[1]

        def totals(batches: Iterator[pa.RecordBatch], shared=shared, n=n) -> Iterator[pa.RecordBatch]:
            total, part = np.zeros((2, n)), None
            for batch in batches:
                if batch.num_rows:
                    part = batch.column("_part")[0].as_py()
                    c, x, y = (batch.column(k).to_numpy() for k in ("_c", "_a", "_b"))
                    for at in range(0, len(c), ROWS):
                        m = shared.value[c[at:at + ROWS]].astype(np.float64)
                        total += np.stack([x[at:at + ROWS] @ m, y[at:at + ROWS] @ m])
            if part is not None:
                yield pa.record_batch([pa.array([part], pa.int64()), pa.array([total.tobytes()], pa.binary())], ["part", "sums"])

        sums = {r.part: np.frombuffer(r.sums).reshape(2, n) for r in work.select("_part", "_c", "_a", "_b").mapInArrow(totals, "part bigint, sums binary").collect()}
        before, running = {}, np.zeros((2, n))
        for part in sorted(sums):
            before[part] = running
            running = running + sums[part]
        whole = running
        offsets = spark.sparkContext.broadcast(before)

        def curve(batches: Iterator[pa.RecordBatch], shared=shared, offsets=offsets, n=n, whole=whole) -> Iterator[pa.RecordBatch]:
            out, cum, last, open_step = np.zeros(n), None, None, np.zeros((2, n))

            def close(x: np.ndarray, y: np.ndarray) -> None:
                """Add places x replicates that are complete."""
                nonlocal out, cum
                cx, cy = cum[0] + np.cumsum(x, axis=0), cum[1] + np.cumsum(y, axis=0)
                out = out + step(x, y, cx, cy, whole[0], whole[1]).sum(0)
                cum = np.stack([cx[-1], cy[-1]])

            for batch in batches:
                if not batch.num_rows:
                    continue
                if cum is None:
                    cum = offsets.value[batch.column("_part")[0].as_py()]
                c, x, y, place = (batch.column(k).to_numpy() for k in ("_c", "_a", "_b", "_place"))
                for at in range(0, len(c), ROWS):
                    m = shared.value[c[at:at + ROWS]].astype(np.float64)
                    p = place[at:at + ROWS]
                    starts = np.flatnonzero(np.r_[True, p[1:] != p[:-1]])
                    px, py = (np.add.reduceat(v[at:at + ROWS, None] * m, starts, axis=0) for v in (x, y))
                    if last is not None and p[0] != last:
                        close(open_step[:1], open_step[1:])
                    elif last is not None:
                        px[0], py[0] = px[0] + open_step[0], py[0] + open_step[1]
                    if len(starts) > 1:
                        close(px[:-1], py[:-1])
                    last, open_step = p[-1], np.stack([px[-1], py[-1]])
            if last is not None:
                close(open_step[:1], open_step[1:])
                yield pa.record_batch([pa.array([out.tobytes()], pa.binary())], ["sums"])

        ready = work.sortWithinPartitions(*_sort_cols(order)).select("_part", "_c", "_a", "_b", F.xxhash64(change).alias("_place"))
        total = np.zeros(n)
        for r in ready.mapInArrow(curve, "sums binary").toLocalIterator():  # a vector for each part
            total = total + np.frombuffer(r.sums)
        found.append((total, whole))
    if not found:
        return np.zeros((3, 0))
    return np.stack([np.concatenate([t for t, _ in found]), np.concatenate([w[0] for _, w in found]), np.concatenate([w[1] for _, w in found])])


#: Cells (replicates x rows near the cut) that a task holds for `share_cuts`.
CUT_CELLS = 1 << 21


def share_cuts(rows: DataFrame, share: float, draws: Draws, low: int, high: int) -> DataFrame:
    """(replicate, k, used): k = floor(share * copies), and the copies of good rows among the first k; null if the cut is not in low..high.

    rows: draws' key (no `within`), `_pos` from 1 in order, `_y`.  A piece adds up its rows before `low` and sends on the copies of those
    in low..high alone; they meet by chunks of replicates, whose cells fit CUT_CELLS or are one replicate's.
    """
    size, y = draws.piece, F.coalesce(F.col("_y").cast("int"), F.lit(0))
    chunk = max(1, min(draws.replicates, CUT_CELLS // max(high - low + 1, 1)))
    work = null_safe_join(rows, draws.index, [draws.key]).select("_c", F.col("_pos").cast("bigint").alias("_pos"), (y > 0).cast("int").alias("_y"))
    before = (F.col("_pos") < low).cast("int")
    sums = work.groupBy("_c").agg(F.count("*").alias("_t"), F.sum(before).alias("_b"), F.sum(before * F.col("_y")).alias("_g"))
    none, zero = F.lit(None).cast("bigint"), F.lit(0).cast("bigint")
    near = work.where(F.col("_pos").between(low, high)).select("_c", zero.alias("_t"), zero.alias("_b"), zero.alias("_g"), "_pos", "_y")
    table = sums.select("*", none.alias("_pos"), F.lit(0).alias("_y")).unionByName(near)
    columns = ["_chunk", "replicates", "sums", "pos", "good", "counts"]

    def listed(pieces: pd.DataFrame, rows: pd.DataFrame) -> pd.DataFrame:
        """One piece: for each chunk of replicates the sums of its components, and the copies of its rows near the cut."""
        out = []
        if len(pieces) and len(rows):
            pieces = pieces.sort_values("replicate")
            n, replicates = int(pieces["_n"].iloc[0]), pieces["replicate"].to_numpy(np.int64)
            matrix = np.stack([_unpacked(c, n) for c in pieces["counts"]])
            c, whole = rows["_c"].to_numpy(np.int64) % size, rows["_pos"].isna().to_numpy()
            x, total = rows[["_t", "_b", "_g"]].to_numpy(np.float64)[whole], np.zeros((len(replicates), 3))
            for at in range(0, len(x), ROWS):
                total += matrix[:, c[whole][at:at + ROWS]].astype(np.float64) @ x[at:at + ROWS]
            pos, good = rows["_pos"].to_numpy(np.float64)[~whole].astype(np.int64), rows["_y"].to_numpy(np.int8)[~whole]
            for i in np.unique(replicates // chunk):
                own = replicates // chunk == i
                copies = np.ascontiguousarray(matrix[own][:, c[~whole]]).astype(np.uint16)
                out.append((int(i), replicates[own].tobytes(), total[own].tobytes(), pos.tobytes(), good.tobytes(), zlib.compress(copies.tobytes(), 1)))
        return pd.DataFrame(out, columns=columns)

    def cut(part: pd.DataFrame) -> pd.DataFrame:
        """One chunk of replicates."""
        replicates = np.frombuffer(part["replicates"].iloc[0], np.int64)
        total = sum(np.frombuffer(s).reshape(-1, 3) for s in part["sums"])
        pos, good = (np.concatenate([np.frombuffer(b, kind) for b in part[name]]) for name, kind in (("pos", np.int64), ("good", np.int8)))
        m = np.concatenate([np.frombuffer(zlib.decompress(c), np.uint16).reshape(len(replicates), -1) if p else np.zeros((len(replicates), 0), np.uint16)
                            for c, p in zip(part["counts"], part["pos"])], axis=1)
        order = np.argsort(pos)
        m, good, k = m[:, order].astype(np.int64), good[order], np.floor(share * total[:, 0])
        upto = np.cumsum(m, axis=1)
        used = np.clip(k[:, None].astype(np.int64) - (total[:, 1:2].astype(np.int64) + upto - m), 0, m) @ good.astype(np.int64)
        last = total[:, 1] + (upto[:, -1] if upto.shape[1] else 0)
        inside = (total[:, 1] <= k) & (k <= last)
        return pd.DataFrame({"replicate": replicates.astype(np.int32), "k": k, "used": np.where(inside, total[:, 2] + used, np.nan)})

    pieces = draw_pieces(draws).groupBy("_p")
    rows_of = table.withColumn("_p", F.floor(F.col("_c") / size).cast("bigint")).groupBy("_p")
    parts = pieces.cogroup(rows_of).applyInPandas(lambda a, b: listed(a, b), "_chunk long, replicates binary, sums binary, pos binary, good binary, counts binary")
    cuts = parts.groupBy("_chunk").applyInPandas(cut, "replicate int, k double, used double")
    return cuts.withColumn("used", F.when(~F.isnan("used"), F.col("used")))


def average_precision_step(a, b, ca, cb, whole_a, whole_b) -> np.ndarray:
    """Positives of a place times the precision up to it; over all positives it is the average precision."""
    n = ca + cb
    return np.where(a > 0, a * ca / np.where(n > 0, n, 1), 0.0)


def auc_step(a, b, ca, cb, whole_a, whole_b) -> np.ndarray:
    """Negatives of a place times the positives above it, equal ones half; over all pairs it is the AUC."""
    return b * (ca - a / 2)


def as_rows(draws: Draws, spark, values: dict[str, np.ndarray]) -> DataFrame:
    """(replicate, values): one row for each replicate; not-a-number becomes null."""
    names = list(values)
    rows = [(i, *[None if np.isnan(values[k][i]) else float(values[k][i]) for k in names]) for i in range(draws.replicates)]
    return spark.createDataFrame(rows, "replicate int, " + ", ".join(f"`{k}` double" for k in names))
