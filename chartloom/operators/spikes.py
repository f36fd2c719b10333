"""Implausible readings per source: impossible values, frozen runs and isolated spikes.

Spikes come out of robust principal components: every source gets a matrix whose rows are
stay-days and whose columns are (item, four-hour slot) cells of standardised readings. The
matrix is split into a low-rank part - what the source normally reports over such a day -
and a sparse part. A reading is far if it leaves the low-rank part by more than ``FAR``
spreads of its source; an exact check then keeps far readings that stand alone or in a
pair, with readings on both sides. Constant runs and ranges are tested apart from that.

The readings are shuffled once, by stay and source: neighbours in the sequence of an item,
runs and stay-days all lie within that key, and readings without stay or time are spread by
a hash of their id. Passes over the matrices run where the rows are; Gram matrices are added
up per task, then per group of tasks, then per source, and only bases and levels (about
3 KB a source) reach the driver, sources being taken in blocks of ``SOURCES``.

Defined results for odd input: a reading without a number is no case; without stay or time it
can only be impossible; a repeated delivery shares the fault of the first and doesn't
lengthen a run; a source with a spread of zero has no spikes; ties in time are put in order
by number; an empty table gives an empty table; extra columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from chartloom.operators.units import normalise_quantities, reference_rows
from chartloom.session import materialise, release

FAR = 9.0  # spreads a spike lies away from what its source normally reports
SPARSE = 3.0  # spreads from the low-rank part beyond which an entry is sparse while that is fitted
STUCK = 8  # equal readings in a frozen run
SLOTS = 6  # slots of a day
RANK = 3
ROUNDS = 2  # re-estimations of the basis after the first
GROUPS = 64  # groups of tasks whose Gram matrices are added up first
SOURCES = 10_000  # sources whose bases are held at once
LOOSE = 2**30  # keys that readings without stay or time are spread over

IMPOSSIBLE_FAULT, STUCK_FAULT = 1, 2
_GRAM = pa.schema([("source", pa.string()), ("part", pa.int32()), ("gram", pa.list_(pa.float64()))])
_BASIS = pa.schema([("source", pa.string()), ("basis", pa.list_(pa.float64()))])
_FOUND = pa.schema([("event_id", pa.int64()), ("defect", pa.string()), ("rank", pa.int32())])


def standardised_readings(events: DataFrame, reference: DataFrame, items: list[str]) -> DataFrame:
    """Readings with a number: ids, item, cell of the day, time, common value, impossible, and a hash of the delivery.

    ``cell`` is -1 for a label that isn't among ``items``.
    """
    same = [c for c in events.columns if c not in ("event_id", "loaded_at")]
    readings = events.where(F.col("event_type").isin("lab", "vital")).withColumn("_same", F.xxhash64(*[F.col(c) for c in same]))
    rows = normalise_quantities(readings, reference).where("q_value IS NOT NULL")
    index = F.try_element_at(F.create_map(*[F.lit(x) for i, name in enumerate(items) for x in (name, i)]), F.col("q_item")) if items else F.lit(None).cast("int")
    ts = F.col("timestamp").try_cast("timestamp_ntz")
    slot = F.coalesce(F.floor(F.hour(ts) / (24 // SLOTS)), F.lit(0))
    return rows.select(
        F.col("event_id").cast("bigint").alias("event_id"),
        F.col("hadm_id").cast("bigint").alias("hadm_id"),
        F.coalesce("source", F.lit("")).alias("source"),
        F.col("q_item").alias("item"),
        F.coalesce(index * SLOTS + slot, F.lit(-1)).cast("int").alias("cell"),
        ts.alias("ts"),
        F.round("q_value", 6).alias("v"),
        F.coalesce((F.col("q_value") < F.col("q_low") - F.col("q_slack") - 1e-9) | (F.col("q_value") > F.col("q_high") + F.col("q_slack") + 1e-9), F.lit(False)).alias("impossible"),
        F.col("_same").alias("same"),
    )


def sequenced(readings: DataFrame) -> DataFrame:
    """``readings`` with the two neighbours on each side in the sequence of stay, source and item, and stuck.

    Repeated deliveries stand next to each other; they take part in nothing and show what the
    first of them shows. Every window runs over one sort. An impossible neighbour is NaN.
    """
    tied = F.col("hadm_id").isNotNull() & F.col("ts").isNotNull()
    rows = readings.withColumn("seq", tied).withColumn("key", F.when(tied, F.col("hadm_id")).otherwise(F.pmod(F.xxhash64("event_id"), F.lit(LOOSE))))
    over = "OVER (PARTITION BY key, source, item, seq ORDER BY ts, v, same, event_id)"
    upto = over[:-1] + " ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)"
    rows = rows.repartition("key", "source").withColumn("again", F.expr(f"coalesce(lag(same) {over} = same, false)"))
    rows = rows.withColumn("shown", F.expr("CASE WHEN again THEN NULL WHEN impossible THEN double('NaN') ELSE v END")).withColumn("v3", F.expr("IF(again, NULL, round(v, 3))"))
    beside = {
        "p1": f"IF(again, lag(shown, 2) IGNORE NULLS {over}, lag(shown, 1) IGNORE NULLS {over})",
        "p2": f"IF(again, lag(shown, 3) IGNORE NULLS {over}, lag(shown, 2) IGNORE NULLS {over})",
        "n1": f"lead(shown, 1) IGNORE NULLS {over}",
        "n2": f"lead(shown, 2) IGNORE NULLS {over}",
        "nth": f"sum(IF(again, 0, 1)) {upto}",
        "before": f"lag(v3, 1) IGNORE NULLS {over}",
    }
    rows = rows.withColumns({c: F.expr(e) for c, e in beside.items()})
    # Runs: the number of the reading a run begins with, and whether the run reaches far enough ahead.
    rows = rows.withColumn("begun", F.expr(f"max(IF(again OR before = v3, NULL, nth)) {upto}")).withColumn("own", F.expr("IF(again, NULL, begun)"))
    place = F.col("nth") - F.col("begun") + 1
    stuck = place >= STUCK
    for k in range(1, STUCK):
        stuck = stuck | ((place + k >= STUCK) & F.expr(f"coalesce(lead(own, {k}) IGNORE NULLS {over} = begun, false)"))
    return rows.withColumn("stuck", F.col("seq") & stuck & (F.col("item") != "pain score")).drop("again", "shown", "v3", "nth", "before", "begun", "own", "same")


def daily_profiles(rows: DataFrame) -> DataFrame:
    """Rows of the matrices: (source, seq) with parallel arrays of the readings of one stay-day.

    The grouping lies within the partitioning of ``sequenced`` and needs no further shuffle.
    An impossible value is NaN and stands in no matrix; a neighbour that isn't there is infinite.
    """
    fault = F.when(F.col("impossible"), IMPOSSIBLE_FAULT).when(F.col("stuck"), STUCK_FAULT).otherwise(0).cast("tinyint")
    value = F.when(F.col("impossible"), float("nan")).otherwise(F.col("v"))
    beside = [F.coalesce(F.col(c), F.lit(float("inf"))).alias(c) for c in ("p2", "p1", "n1", "n2")]
    one = F.struct("event_id", "cell", value.alias("v"), *beside, fault.alias("fault"))
    days = rows.groupBy("key", "source", "seq", F.when(F.col("seq"), F.to_date("ts")).alias("day")).agg(F.collect_list(one).alias("c"))
    return days.select("source", "seq", *[F.expr(f"transform(c, x -> x.{f})").alias(f) for f in ("event_id", "cell", "v", "p2", "p1", "n1", "n2", "fault")])


def source_levels(profiles: DataFrame) -> DataFrame:
    """(source, idx, level, spread) of each source and item from quartile digests that combine before the shuffle."""
    values = profiles.select("source", F.explode(F.arrays_zip("cell", "v")).alias("x")).select("source", F.floor(F.col("x.cell") / SLOTS).cast("int").alias("idx"), F.col("x.v").alias("v"))
    q = values.where("idx >= 0 AND NOT isnan(v)").groupBy("source", "idx").agg(F.percentile_approx("v", [0.1, 0.25, 0.5, 0.75, 0.9], 2000).alias("q"))
    spread = F.greatest(F.expr("q[3] - q[2]"), F.expr("q[2] - q[1]"), F.expr("(q[3] - q[1]) / 2")) / 0.67449
    wide = F.expr("(q[4] - q[0]) / 2") / 1.28155
    return q.select("source", "idx", F.expr("q[2]").alias("level"), F.when(spread > 0, spread).otherwise(wide).alias("spread"))


class Source:
    """Level and spread by item, and the basis of the low-rank part, of one source."""

    def __init__(self, n_items: int) -> None:
        self.level = np.zeros(n_items)
        self.spread = np.zeros(n_items)
        self.basis: np.ndarray | None = None

    def z(self, cell: np.ndarray, v: np.ndarray) -> np.ndarray:
        """Deviations in spreads; NaN for impossible values, unlisted items and spreads of zero."""
        idx = np.maximum(cell, 0) // SLOTS
        spread = self.spread[idx]
        return np.where((cell >= 0) & (spread > 0), (v - self.level[idx]) / np.where(spread > 0, spread, 1.0), np.nan)


def _lists(batch: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray, list[np.ndarray]]:
    """Source of each row; row of each entry; the flattened list columns."""
    columns = [batch.column(i) for i in range(1, batch.num_columns)]
    counts = np.diff(columns[0].offsets.to_numpy())
    return np.asarray(batch.column(0).to_pylist(), dtype=object), np.repeat(np.arange(len(counts)), counts), [x.flatten().to_numpy(zero_copy_only=False) for x in columns]


def _by_source(batch: pa.RecordBatch) -> Iterator[tuple[str, np.ndarray, int, list[np.ndarray]]]:
    """(source, row of each entry, rows, flattened columns) of every source in a batch."""
    sources, row, columns = _lists(batch)
    for s in sorted(set(sources.tolist())):
        pick = sources == s
        keep = pick[row]
        yield s, (np.cumsum(pick) - 1)[row[keep]], int(pick.sum()), [c[keep] for c in columns]


def _low_rank(row: np.ndarray, cell: np.ndarray, z: np.ndarray, n_rows: int, width: int, basis: np.ndarray | None) -> tuple[np.ndarray, np.ndarray]:
    """Low-rank rows on every cell, and the completed matrix without its sparse part.

    Entries further than ``SPARSE`` from the low-rank part are sparse and leave their cell's
    mean; a cell without other entries is completed from the low-rank part.
    """
    at = row * width + cell
    low = np.zeros(n_rows * width)
    full = low.reshape(n_rows, width)
    for _ in range(1 if basis is None else 3):
        dense = np.abs(z - low[at]) <= SPARSE
        seen = np.bincount(at[dense], minlength=n_rows * width)
        total = np.bincount(at[dense], weights=z[dense], minlength=n_rows * width)
        full = np.where(seen > 0, total / np.maximum(seen, 1), low).reshape(n_rows, width)
        if basis is not None:
            low = ((full @ basis) @ basis.T).ravel()
    return low.reshape(n_rows, width), full


def fitted_bases(rows: DataFrame, width: int, known: dict[str, Source]) -> dict[str, np.ndarray]:
    """Leading right singular vectors of the cleaned matrix of every source."""
    shared = rows.sparkSession.sparkContext.broadcast(known)

    def partial(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[str, np.ndarray] = {}
        for batch in batches:
            if batch.num_rows == 0:
                continue
            for s, row, n, (cell, v) in _by_source(batch):
                own = shared.value.get(s)
                if own is None:
                    continue
                z = own.z(cell, v)
                ok = np.isfinite(z)
                _, full = _low_rank(row[ok], cell[ok], z[ok], n, width, own.basis)
                sums[s] = sums.get(s, 0.0) + full.T @ full
        part = TaskContext.get().partitionId() % GROUPS
        for s, g in sums.items():
            yield pa.RecordBatch.from_pydict({"source": [s], "part": [part], "gram": [g.ravel()]}, schema=_GRAM)

    def total(grams: pa.Table) -> np.ndarray:
        out = np.zeros(width * width)
        for chunk in grams.column("gram").chunks:
            out += chunk.flatten().to_numpy().reshape(-1, width * width).sum(axis=0)
        return out

    def add(key: tuple, grams: pa.Table) -> pa.Table:
        return pa.Table.from_pydict({"source": [key[0].as_py()], "part": [0], "gram": [total(grams)]}, schema=_GRAM)

    def leading(key: tuple, grams: pa.Table) -> pa.Table:
        values, vectors = np.linalg.eigh(total(grams).reshape(width, width))
        basis = np.where(values[-RANK:] > 1e-9, vectors[:, -RANK:], 0.0)
        return pa.Table.from_pydict({"source": [key[0].as_py()], "basis": [basis.ravel()]}, schema=_BASIS)

    kind = "source string, part int, gram array<double>"
    summed = rows.where("seq").select("source", "cell", "v").mapInArrow(partial, kind).groupBy("source", "part").applyInArrow(add, kind)
    out = {r.source: np.asarray(r.basis).reshape(width, -1) for r in summed.groupBy("source").applyInArrow(leading, "source string, basis array<double>").toLocalIterator()}
    shared.unpersist()
    return out


def robust_sources(rows: DataFrame, levels: DataFrame, n_items: int) -> dict[str, Source]:
    """What each source normally reports: levels, spreads, and a basis re-estimated with the sparse part taken out."""
    known: dict[str, Source] = {}
    for r in levels.toLocalIterator():
        own = known.setdefault(r.source, Source(n_items))
        own.level[r.idx], own.spread[r.idx] = r.level, r.spread or 0.0
    for _ in range(1 + ROUNDS):
        for s, basis in fitted_bases(rows, n_items * SLOTS, known).items():
            known[s].basis = basis
    return known


def faulty_entries(rows: DataFrame, width: int, known: dict[str, Source]) -> DataFrame:
    """(event_id, defect, rank) of impossible and stuck readings, and of isolated entries of the sparse part."""
    shared = rows.sparkSession.sparkContext.broadcast(known)

    def split(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows == 0:
                continue
            for s, row, n, (event, cell, v, p2, p1, n1, n2, fault) in _by_source(batch):
                spike = np.zeros(len(event), dtype=bool)
                own = shared.value.get(s)
                if own is not None and own.basis is not None:
                    z = own.z(cell, v)
                    ok = np.isfinite(z)
                    low, _ = _low_rank(row[ok], cell[ok], z[ok], n, width, own.basis)
                    usual = np.zeros(len(z))
                    usual[ok] = low[row[ok], cell[ok]]
                    far = lambda x: np.abs(own.z(cell, x) - usual) > FAR  # noqa: B023, E731  (NaN is not far)
                    # A neighbour that isn't there is infinite, so far: no reading at an end is isolated.
                    f_2, f_1, f1, f2 = far(p2), far(p1), far(n1), far(n2)
                    single, first, second = ~f_1 & ~f1, ~f_1 & f1 & ~f2, f_1 & ~f_2 & ~f1
                    spike = far(v) & (single | first | second)
                defect = np.where(fault == IMPOSSIBLE_FAULT, "impossible", np.where(fault == STUCK_FAULT, "stuck", "spike"))
                out = (fault > 0) | spike
                rank = np.where(fault > 0, fault - 1, 2).astype(np.int32)
                yield pa.RecordBatch.from_pydict({"event_id": event[out], "defect": defect[out], "rank": rank[out]}, schema=_FOUND)

    return rows.select("source", "event_id", "cell", "v", "p2", "p1", "n1", "n2", "fault").mapInArrow(split, "event_id bigint, defect string, rank int")


def implausible_readings(events: DataFrame, reference: DataFrame) -> DataFrame:
    """(event_id, defect): impossible, stuck or spike, in that priority, repeated deliveries included."""
    items = sorted(r.label.lower() for r in reference_rows(reference) if r.kind != "drug")
    rows = materialise(daily_profiles(sequenced(standardised_readings(events, reference, items))), "profiles")
    levels = materialise(source_levels(rows), "levels")
    n_blocks = -(-max(1, levels.select("source").distinct().count()) // SOURCES)
    found = None
    for b in range(n_blocks):
        mine = lambda df: df if n_blocks == 1 else df.where(F.pmod(F.xxhash64("source"), F.lit(n_blocks)) == b)  # noqa: B023, E731
        known = robust_sources(mine(rows), mine(levels), max(1, len(items)))
        part = faulty_entries(mine(rows), max(1, len(items)) * SLOTS, known)
        found = part if found is None else found.unionByName(part)
    release(levels)
    return found.groupBy("event_id").agg(F.min_by("defect", "rank").alias("defect"))
