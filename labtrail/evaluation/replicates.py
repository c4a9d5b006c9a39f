"""Metrics of all replicates from rows that carry their weights as vectors.

A row stands for itself and for all replicates: weight r is how often replicate r draws it. Rows, not rows x
replicates, are shuffled, once into ranges of the score:

1. `packed` sums rows that agree in group, score and class within a batch, if they are many, so that a score that a
   third of all rows share does not fill one range.
2. `summed` adds up the weight vectors of each range's part of a group (a segment), and the segments' sums before it
   are running sums over a table of segments.
3. `scanned` walks through a segment by score with these sums as a start and gives its share of each
   replicate's AUC and average precision; shares are added up.

Weights are made where they are needed: with the method "poisson" from the row's number and the replicate, with
"exact" from a table of drawn places that is dealt out by blocks of places, four bytes a draw.
"""

from __future__ import annotations

from collections.abc import Iterator, Mapping, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from labtrail.functions.uniform import LOW_BITS, MIX_PRIME, MIX_ROUNDS, poisson_limits, row_number_of
from labtrail.operators.ranking import random_position
from labtrail.session import stage

METHODS = ("exact", "poisson")
#: Slots that a task draws at once, and places that a block has: a block's counts are 8 bytes a place and replicate.
BLOCK_BITS = 14
BLOCK = 1 << BLOCK_BITS
#: Rows of a batch that agree in group, score and class are summed from this number on.
MANY = 64
#: Rows whose weights are made at once.
CHUNK = 4096


# ------------------------------------------------------------------- weights


def draws(first: np.ndarray, replicates: np.ndarray) -> np.ndarray:
    """Numbers below 2**62 for each integer (rows) and replicate (columns), as `uniform.mixed_draw` makes them."""
    low, high = (first & ((1 << LOW_BITS) - 1))[:, None], (first >> LOW_BITS)[:, None]
    streams = []
    for rounds in MIX_ROUNDS.values():
        h = np.broadcast_to(low % MIX_PRIME, (len(first), len(replicates)))
        for k, (factor, by_factor, by_sum, by_high) in enumerate(rounds):
            keyed = (factor + replicates * by_factor) % MIX_PRIME
            h = ((h ^ (h >> 15)) * keyed % MIX_PRIME + replicates * by_sum + high * by_high + 11 * (k + 1)) % MIX_PRIME
        streams.append(h)
    return streams[0] * (1 << 31) + streams[1]


def poisson_weights(numbers: np.ndarray, replicates: int) -> np.ndarray:
    """Weights of replicates 0 (one each) to `replicates`."""
    limits = np.array(poisson_limits(), dtype=np.int64)
    out = np.ones((len(numbers), replicates + 1), dtype=np.uint8)
    for k in range(0, len(numbers), CHUNK):
        drawn = draws(numbers[k : k + CHUNK], np.arange(1, replicates + 1))
        out[k : k + CHUNK, 1:] = np.searchsorted(limits, drawn, side="right")
    return out


def numbered(df: DataFrame, ids: Sequence[str]) -> DataFrame:
    """Rows with the number that their weights are made from."""
    return df.withColumns({"_number": row_number_of(*ids, salt="weight"), "_drawn": F.lit(None).cast("binary")})


def drawn(df: DataFrame, groups: Sequence[str], ids: Sequence[str], replicates: int) -> DataFrame:
    """Rows with their weights: replicate r draws as many rows of a group as it has, with replacement.

    Slot j takes the row at place draw(j, r) modulo n of a fixed random order. Tasks draw blocks of slots and send each
    block of places the draws that fall into it, as place and replicate in two bytes each.
    """
    if replicates >= 1 << 16:
        raise ValueError("at most 65,535 replicates")
    groups, columns = list(groups), df.columns
    placed = random_position(df, groups, ids, "row", "_pos", "_size").withColumn("_block", F.shiftright("_pos", BLOCK_BITS))
    sizes = placed.select(*groups, "_pos", "_size").where("_pos % " + str(BLOCK) + " = 0").select(
        *groups, F.shiftright("_pos", BLOCK_BITS).alias("_slots"), "_size"
    )
    # a block of slots becomes draws for many places, which size estimates do not see
    sizes = sizes.repartition(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), *groups, "_slots")

    def draw(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(batch.num_rows):
                row = batch.slice(k, 1)
                start, size = row["_slots"][0].as_py() * BLOCK, row["_size"][0].as_py()
                slots = np.arange(start, min(start + BLOCK, size), dtype=np.int64)
                found: dict[int, list[np.ndarray]] = {}
                # so many replicates at once that a step's arrays stay small
                for r in range(1, replicates + 1, 16):
                    some = np.arange(r, min(r + 16, replicates + 1))
                    places = (draws(slots, some) % size).ravel()
                    codes = ((places & (BLOCK - 1)) << 16 | np.tile(some, len(slots))).astype(np.uint32)
                    blocks = places >> BLOCK_BITS
                    order = np.argsort(blocks, kind="stable")
                    codes, blocks = codes[order], blocks[order]
                    firsts = np.flatnonzero(np.append(True, blocks[1:] != blocks[:-1]))
                    for b, part in zip(blocks[firsts], np.split(codes, firsts[1:]), strict=True):
                        found.setdefault(int(b), []).append(part)
                n = len(found)
                same = [pa.array([row[g][0].as_py()] * n, row.schema.field(g).type) for g in groups]
                yield pa.RecordBatch.from_arrays(
                    [*same, pa.array(list(found), pa.int64()), pa.array([np.concatenate(x).tobytes() for x in found.values()], pa.binary())],
                    [*groups, "_block", "codes"],
                )

    fields = [df.schema[g] for g in groups]
    codes = sizes.mapInArrow(draw, T.StructType([*fields, T.StructField("_block", T.LongType()), T.StructField("codes", T.BinaryType())]))

    def meet(rows: pa.Table, found: pa.Table) -> pa.Table:
        places = np.asarray(rows["_pos"]) & (BLOCK - 1)
        shape = int(places.max(initial=0)) + 1, replicates + 1
        code = np.frombuffer(b"".join(found["codes"].to_pylist()), dtype=np.uint32)
        counts = np.bincount((code >> 16).astype(np.int64) * shape[1] + (code & 0xFFFF), minlength=shape[0] * shape[1]).reshape(shape)
        counts[:, 0] = 1
        if counts.max(initial=0) > 255:
            raise ValueError("a row was drawn more than 255 times by one replicate")
        weights = counts.astype(np.uint8)[places]
        return rows.select(columns).append_column("_drawn", pa.array([x.tobytes() for x in weights], pa.binary()))

    schema = T.StructType([*df.schema.fields, T.StructField("_drawn", T.BinaryType())])
    keys = [*groups, "_block"]
    met = placed.groupBy(*keys).cogroup(codes.groupBy(*keys)).applyInArrow(meet, schema)
    return met.withColumn("_number", F.lit(None).cast("long"))


def weighed(df: DataFrame, groups: Sequence[str], ids: Sequence[str], replicates: int, method: str) -> DataFrame:
    """Rows with what their weights are made from: `_number`, or the weights themselves, `_drawn`."""
    if method not in METHODS:
        raise ValueError(f"method is one of {METHODS}")
    return numbered(df, ids) if method == "poisson" else drawn(df, groups, ids, replicates)


def _weights(table: pa.Table | pa.RecordBatch, replicates: int) -> np.ndarray:
    """Weights (rows, replicates + 1) of rows that are not packed."""
    if table["_drawn"].null_count < table.num_rows:
        return np.frombuffer(b"".join(table["_drawn"].to_pylist()), dtype=np.uint8).reshape(-1, replicates + 1)
    return poisson_weights(np.asarray(table["_number"], dtype=np.int64), replicates)


def exploded(rows: DataFrame, replicates: int) -> DataFrame:
    """Rows of `weighed` with `replicate` and `weight`, one for each replicate that draws a row."""
    columns = [c for c in rows.columns if c not in ("_number", "_drawn")]

    def explode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(0, batch.num_rows, CHUNK):
                some = pa.Table.from_batches([batch.slice(k, CHUNK)])
                weights = _weights(some, replicates)
                row, replicate = np.nonzero(weights)
                out = some.select(columns).take(pa.array(row))
                out = out.append_column("replicate", pa.array(replicate.astype(np.int32)))
                yield from out.append_column("weight", pa.array(weights[row, replicate].astype(np.int64))).combine_chunks().to_batches()

    fields = [*[rows.schema[c] for c in columns], T.StructField("replicate", T.IntegerType()), T.StructField("weight", T.LongType())]
    return rows.mapInArrow(explode, T.StructType(fields))


# ------------------------------------------------------- scans over segments


def _sums(table: pa.Table, replicates: int, names: Sequence[str], weights_only: bool = False) -> np.ndarray:
    """(rows, 1 + names, replicates + 1): weights, and weights times values, of rows, packed or not."""
    shown = 1 if weights_only else 1 + len(names)
    out = np.empty((table.num_rows, shown, replicates + 1))
    whole = np.asarray(table["_packed"].is_valid())
    if whole.any():
        blobs = table["_packed"].filter(pa.array(whole)).to_pylist()
        out[whole] = np.frombuffer(b"".join(blobs)).reshape(len(blobs), 1 + len(names), -1)[:, :shown]
    if not whole.all():
        plain = table.filter(pa.array(~whole))
        weights = _weights(plain, replicates)
        out[~whole, 0] = weights
        for k, name in enumerate(names[: shown - 1]):
            out[~whole, k + 1] = weights * np.asarray(plain[name])[:, None]
    return out


def replicate_metrics(
    rows: DataFrame,
    groups: Sequence[str],
    scores: Mapping[str, Column],
    label: str,
    replicates: int,
    values: Mapping[str, Column] | None = None,
) -> DataFrame:
    """Per group, score (`which`) and `replicate`: `n`, `n_case`, `auc`, `avg_prec` and weighted sums of `values`.

    `rows` come from `weighed`. A value's sums over cases and controls are `<name>_case` and `<name>_control`. Rows with a
    null score or group are left out, a null label is a control. A replicate without rows of one class has no AUC.
    """
    groups, values = list(groups), dict(values or {})
    names = [f"_v{k}" for k in range(len(values))]
    spark = rows.sparkSession
    known = F.lit(True)
    for g in groups:
        known = known & F.col(g).isNotNull()
    lines = F.inline(F.array(*[F.struct(F.lit(w).alias("which"), s.cast("double").alias("_score")) for w, s in scores.items()]))
    base = rows.where(known).select(
        *groups, F.coalesce(F.col(label) == 1, F.lit(False)).alias("_case"), "_number", "_drawn",
        *[v.cast("double").alias(n) for n, v in zip(names, values.values(), strict=True)], lines,
    )
    base = base.where("_score is not null")
    keys = [*groups, "which"]
    fields = [base.schema[k] for k in keys]
    wide = replicates + 1

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            table = pa.Table.from_batches([batch])
            table = table.append_column("_packed", pa.nulls(table.num_rows, pa.binary()))
            at = pa.array(np.arange(table.num_rows))
            same = table.select([*keys, "_score", "_case"]).append_column("_at", at).group_by([*keys, "_score", "_case"])
            same = same.aggregate([("_at", "list")])
            many = [x.as_py() for x in same["_at_list"] if len(x) >= MANY]
            if many:
                sums = [sum(_sums(table.take(pa.array(x[k : k + CHUNK])), replicates, names).sum(0) for k in range(0, len(x), CHUNK)) for x in many]
                first = table.take(pa.array([x[0] for x in many]))
                first = first.set_column(first.schema.get_field_index("_packed"), "_packed", pa.array([x.tobytes() for x in sums], pa.binary()))
                alone = np.ones(table.num_rows, dtype=bool)
                alone[np.concatenate(many)] = False
                table = pa.concat_tables([table.filter(pa.array(alone)), first.cast(table.schema)])
            yield from table.combine_chunks().to_batches()

    packed = base.mapInArrow(pack, T.StructType([*base.schema.fields, T.StructField("_packed", T.BinaryType())]))
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    ranged = stage(packed.repartitionByRange(parts, *keys, "_score").withColumn("_range", F.spark_partition_id()))
    segment = [*keys, "_range"]

    def summed(table: pa.Table) -> pa.Table:
        case = np.asarray(table["_case"])
        sums = np.zeros((2, 1 + len(names), wide))
        for k in range(0, table.num_rows, CHUNK):
            part = table.slice(k, CHUNK)
            each = _sums(part, replicates, names)
            for c in (0, 1):
                sums[c] += each[case[k : k + CHUNK] == bool(c)].sum(0)
        same = [table[x].slice(0, 1) for x in segment]
        return pa.table([*same, pa.array([sums.tobytes()], pa.binary())], names=[*segment, "sums"])

    def running(table: pa.Table) -> pa.Table:
        """The sums before each segment, and those of the whole group."""
        table = table.sort_by("_range")
        sums = np.frombuffer(b"".join(table["sums"].to_pylist())).reshape(table.num_rows, 2, 1 + len(names), wide)
        weights = sums[:, :, 0]
        before = np.cumsum(weights, axis=0) - weights
        whole = weights.sum(0)
        starts = [np.stack([b, whole]).tobytes() for b in before]
        return table.append_column("start", pa.array(starts, pa.binary()))

    segments = ranged.groupBy(*segment).applyInArrow(
        summed, T.StructType([*fields, T.StructField("_range", T.IntegerType()), T.StructField("sums", T.BinaryType())])
    )
    started = segments.groupBy(*keys).applyInArrow(
        running, T.StructType([*segments.schema.fields, T.StructField("start", T.BinaryType())])
    )
    doubles = ["n_case", "n_control", "auc_part", "prec_part", *[f"{n}_{c}" for n in names for c in ("control", "case")]]
    result = T.StructType([*fields, T.StructField("replicate", T.IntegerType()), *[T.StructField(d, T.DoubleType()) for d in doubles]])

    def scanned(table: pa.Table, start: pa.Table) -> pa.Table:
        before, whole = np.frombuffer(start["start"][0].as_py()).reshape(2, 2, wide)
        own = np.frombuffer(start["sums"][0].as_py()).reshape(2, 1 + len(names), wide)
        table = table.select(["_case", "_number", "_drawn", "_packed", "_score", *names])
        order = np.argsort(np.asarray(table["_score"]), kind="stable")
        table = table.take(pa.array(order))
        score, case = np.asarray(table["_score"]), np.asarray(table["_case"])
        below = before.copy()
        auc, prec = np.zeros(wide), np.zeros(wide)
        # sums of a score that goes on in the next chunk: however many rows share a score, a step holds CHUNK of them
        held = np.zeros((2, 0, wide))
        for first in range(0, len(score), CHUNK):
            last = min(first + CHUNK, len(score))
            part = _sums(table.slice(first, last - first), replicates, names, weights_only=True)[:, 0]
            runs = np.flatnonzero(np.append(True, score[first + 1 : last] != score[first : last - 1]))
            both = np.stack([np.add.reduceat(part * mask[first:last, None], runs) for mask in (~case, case)])
            if held.shape[1] and score[first] == score[first - 1]:
                both[:, 0] += held[:, 0]
            else:
                both = np.concatenate([held, both], axis=1)
            whole_scores = both.shape[1] - (last < len(score))
            (controls, cases), held = both[:, :whole_scores], both[:, whole_scores:]
            cases_below, controls_below = np.cumsum(cases, axis=0) - cases + below[1], np.cumsum(controls, axis=0) - controls + below[0]
            auc += (cases * (controls_below + controls / 2)).sum(0)
            hits, false = whole[1] - cases_below, whole[0] - controls_below
            prec += (cases * np.divide(hits, hits + false, out=np.zeros_like(hits), where=hits + false > 0)).sum(0)
            below[1] += cases.sum(0)
            below[0] += controls.sum(0)
        columns = [own[1, 0], own[0, 0], auc, prec, *[own[c, k + 1] for k in range(len(names)) for c in (0, 1)]]
        same = [pa.array([start[k][0].as_py()] * wide, start.schema.field(k).type) for k in keys]
        return pa.table([*same, pa.array(np.arange(wide, dtype=np.int32)), *[pa.array(x) for x in columns]], names=[x.name for x in result])

    shares = ranged.groupBy(*segment).cogroup(started.groupBy(*segment)).applyInArrow(scanned, result)
    total = shares.groupBy(*keys, "replicate").agg(*[F.sum(d).alias(d) for d in doubles])
    m, n = F.col("n_case"), F.col("n_control")
    return total.select(
        *keys,
        "replicate",
        (m + n).cast("long").alias("n"),
        m.cast("long").alias("n_case"),
        F.try_divide("auc_part", m * n).alias("auc"),
        F.try_divide("prec_part", m).alias("avg_prec"),
        *[F.col(f"{k}_{c}").alias(f"{v}_{c}") for k, v in zip(names, values, strict=True) for c in ("case", "control")],
    )
