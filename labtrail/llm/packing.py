"""Best-fit packing of tokenized documents, certified by lower bounds.

Texts become ids of a public byte-level BPE vocabulary, closed by id 0; only documents longer than a
sequence are cut. Full pieces fill sequences of their own. The others are dealt to groups of a bounded
size, each packed by best-fit decreasing. Dual feasible functions give each group a number of
sequences that no packing can undercut; a group that meets it is certified. Groups with a gap put the
pieces of their unfilled sequences into a common pool, every group adds its emptiest sequence, and
the pool is dealt anew and packed again, as long as that saves sequences.

The ids come from the ranks of the same vocabulary file through `tiktoken`, several times faster than
`tokenizers`; texts with characters beyond those on which both are known to agree, and texts that hold the
content of an added token (`<|endoftext|>` is one id there, not split), go to `tokenizers`.

Defined cases: a null text is an empty one, a piece of the closing id alone; repeated rows are packed
each on its own; null keys are kept; an empty table gives an empty result.
"""

from __future__ import annotations

import json
import re
import zlib
from collections.abc import Iterator
from functools import cached_property, lru_cache

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from labtrail.llm.common import cut

CAPACITY = 2048
#: Pieces of a group, about: what one task packs.
GROUP_PIECES = 50_000
#: Times that a pool is packed anew at most; each time it only stays if it saves sequences.
ROUNDS = 4

#: Characters beyond those on which both tokenizer libraries are tested to agree.
OTHER = re.compile("[^\x00-ɏ‐-‧€]")


def byte_letters() -> dict[str, int]:
    """Letters that stand for bytes in a byte-level vocabulary: printable bytes stand for
    themselves, the others for the code points from 256 on."""
    shown = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or 174 <= b <= 255]
    hidden = [b for b in range(256) if b not in set(shown)]
    return {chr(b): b for b in shown} | {chr(256 + i): b for i, b in enumerate(hidden)}


class Encoder:
    """Ids of a text by a byte-level BPE file of `tokenizers`."""

    def __init__(self, path: str) -> None:
        import public_tokenizers
        import tiktoken

        with open(path, encoding="utf-8") as file:
            spec = json.load(file)
        self.added = [x["content"] for x in spec.get("added_tokens", [])]
        letters = byte_letters()
        vocabulary = spec["model"]["vocab"]
        ranks = {bytes(letters[c] for c in x): i for x, i in vocabulary.items() if x not in self.added}
        self.fast = tiktoken.Encoding("ranks", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
        self.path = path

    @cached_property
    def exact(self):
        """The vocabulary in `tokenizers`, loaded for the first text that needs it: few do, and it stays in memory."""
        from tokenizers import Tokenizer

        return Tokenizer.from_file(self.path)

    def __call__(self, text: str) -> np.ndarray:
        if OTHER.search(text) or any(x in text for x in self.added):
            return np.array(self.exact.encode(text, add_special_tokens=False).ids, np.uint32)
        return self.fast.encode_to_numpy(text, disallowed_special=())


@lru_cache(maxsize=2)
def encoder(path: str) -> Encoder:
    return Encoder(path)


def cuts(total: int, capacity: int) -> list[tuple[int, int]]:
    """(start, length) of the pieces of a document with `total` ids; a shorter one comes first."""
    first = total % capacity or capacity
    return [(0, first)] + [(at, capacity) for at in range(first, total, capacity)]


def pieces(
    docs: DataFrame, tokenizer: str, capacity: int = CAPACITY, key: str = "doc_id", text: str = "text", with_ids: bool = False
) -> DataFrame:
    """One row per piece: key, piece, start, length, ids_crc32, and the ids themselves if asked for."""
    fields = [
        T.StructField(key, docs.schema[key].dataType),
        T.StructField("piece", T.IntegerType()),
        T.StructField("start", T.LongType()),
        T.StructField("length", T.LongType()),
        T.StructField("ids_crc32", T.LongType()),
    ]
    if with_ids:
        fields.append(T.StructField("ids", T.ArrayType(T.IntegerType())))

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode_text = encoder(tokenizer)
        for batch in batches:
            index, piece, start, length, crc, values = [], [], [], [], [], []
            for row, value in enumerate(batch.column(1)):
                ids = np.append(encode_text(value.as_py() or ""), np.uint32(0)).astype("<u4")
                for number, (at, size) in enumerate(cuts(len(ids), capacity)):
                    part = ids[at : at + size]
                    index.append(row)
                    piece.append(number)
                    start.append(at)
                    length.append(size)
                    crc.append(zlib.crc32(part.tobytes()))
                    if with_ids:
                        values.append(part.astype(np.int32))
            columns = [batch.column(0).take(pa.array(index, pa.int64())), pa.array(piece, pa.int32())]
            columns += [pa.array(x, pa.int64()) for x in (start, length, crc)]
            names = [f.name for f in fields]
            if with_ids:
                columns.append(pa.array(values, pa.list_(pa.int32())))
            yield pa.RecordBatch.from_arrays(columns, names=names)

    return docs.select(key, text).mapInArrow(encode, T.StructType(fields))


def best_fit(lengths: np.ndarray, capacity: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Best-fit decreasing: bin and offset of each item, and the fill of each bin.

    Open bins are kept by their free space; one integer has a bit for each space that occurs, so the
    tightest bin that fits is the lowest bit from the item's length on.
    """
    bins = np.zeros(len(lengths), np.int64)
    offsets = np.zeros(len(lengths), np.int64)
    open_bins: list[list[int]] = [[] for _ in range(capacity + 1)]
    spaces, count, fills = 0, 0, []
    for item in np.argsort(-lengths, kind="stable"):
        size = int(lengths[item])
        fitting = spaces >> size
        if fitting:
            space = size + (fitting & -fitting).bit_length() - 1
            to = open_bins[space].pop()
            if not open_bins[space]:
                spaces ^= 1 << space
        else:
            space, to, count = capacity, count, count + 1
            fills.append(0)
        bins[item], offsets[item] = to, capacity - space
        fills[to] = capacity - space + size
        if left := space - size:
            open_bins[left].append(to)
            spaces |= 1 << left
    return bins, offsets, np.array(fills, np.int64)


def lower_bound(lengths: np.ndarray, capacity: int) -> int:
    """No packing has fewer bins: the best of two families of dual feasible functions.

    First family, for each t up to half a bin: items above capacity - t count as a bin, items below t
    as nothing, the rest by length. Second, for small k: the length as a k-th of a bin, rounded down
    from (k + 1) parts, exact multiples as they are.
    """
    if not len(lengths):
        return 0
    number = np.bincount(lengths, minlength=capacity + 1).astype(np.int64)
    mass = np.cumsum(number * np.arange(capacity + 1))
    upto = np.cumsum(number)
    t = np.arange(1, capacity // 2 + 1)
    large = upto[-1] - upto[capacity - t]
    first = large * capacity + mass[capacity - t] - mass[t - 1]
    best = max(-(-int(mass[-1]) // capacity), -(-int(first.max()) // capacity))
    sizes = np.arange(capacity + 1, dtype=np.int64)
    for k in range(1, 21):
        scaled = sizes * (k + 1)
        # in units of 1 / (k * capacity) of a bin
        value = np.where(scaled % capacity == 0, sizes * k, scaled // capacity * capacity)
        best = max(best, -(-int((value * number).sum()) // (k * capacity)))
    return best


def _packed(df: DataFrame, round_number: int, capacity: int, group_pieces: int) -> DataFrame:
    """Pack `df` in groups; adds sequence_id, offset, `_again` and `_opens` (1 on a bin's first row)."""
    groups = max(1, -(-df.count() // group_pieces))
    out = T.StructType(
        [*df.schema.fields]
        + [T.StructField("sequence_id", T.LongType()), T.StructField("offset", T.LongType())]
        + [T.StructField("_again", T.BooleanType()), T.StructField("_opens", T.IntegerType())]
    )

    def pack(rows: pd.DataFrame) -> pd.DataFrame:
        lengths = rows["length"].to_numpy(np.int64)
        bins, offsets, fills = best_fit(lengths, capacity)
        group = int(rows["_group"].iloc[0])
        again = fills < capacity if len(fills) > lower_bound(lengths, capacity) else np.zeros(len(fills), bool)
        if fills.min() < capacity:
            again[np.argmin(fills)] = True
        rows = rows.drop(columns="_group")
        rows["sequence_id"] = (round_number << 56) + (group << 32) + bins
        rows["offset"] = offsets
        rows["_again"] = again[bins]
        rows["_opens"] = (offsets == 0).astype(np.int32)
        return rows

    dealt = df.withColumn("_group", F.pmod(F.xxhash64("_uid", F.lit(round_number)), F.lit(groups)).cast("int"))
    return dealt.groupBy("_group").applyInPandas(pack, out)


def pack(rows: DataFrame, capacity: int = CAPACITY, group_pieces: int = GROUP_PIECES, rounds: int = ROUNDS) -> DataFrame:
    """Add `sequence_id` and `offset` to rows with a `length` between 1 and the capacity.

    A round reads its input from a written table, so a lost executor cannot change what is packed.
    """
    base = cut(rows.withColumn("_uid", F.monotonically_increasing_id()))
    full = base.where(F.col("length") == capacity).withColumns({"sequence_id": F.col("_uid"), "offset": F.lit(0).cast("long")})
    done = [full.drop("_uid")]
    current = cut(_packed(base.where(F.col("length") < capacity), 1, capacity, group_pieces))
    for number in range(2, rounds + 1):
        pool = current.where("_again")
        before = pool.agg(F.sum("_opens")).first()[0] or 0
        if before < 2:
            break
        plain = pool.drop("sequence_id", "offset", "_again", "_opens")
        fresh = cut(_packed(plain, number, capacity, group_pieces))
        if fresh.agg(F.sum("_opens")).first()[0] >= before:
            break
        done.append(current.where(~F.col("_again")).drop("_uid", "_again", "_opens"))
        current = fresh
    out = current.drop("_uid", "_again", "_opens")
    for part in done:
        out = out.unionByName(part)
    return out


def pack_documents(docs: DataFrame, tokenizer: str, capacity: int = CAPACITY, key: str = "doc_id", text: str = "text", with_ids: bool = False) -> DataFrame:
    """Pieces of all documents with their sequences and places."""
    return pack(pieces(docs, tokenizer, capacity, key, text, with_ids), capacity)


def sequences(packed: DataFrame) -> DataFrame:
    """The packed sequences themselves: `sequence_id` and its `ids`; needs pieces with ids."""
    parts = F.sort_array(F.collect_list(F.struct("offset", "ids")))
    return packed.groupBy("sequence_id").agg(F.flatten(F.transform(parts, lambda x: x["ids"])).alias("ids"))
