"""Packing documents into sequences by minimum bin slack over the histogram of lengths.

A document is cut into whole windows and a rest. Which lengths share a window depends on the histogram
of the rests alone (at most one count for each length below the capacity), so the plan is made on the
driver from a table of bounded size and then applied to the pieces where they are.
"""

from __future__ import annotations

import zlib

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import cut, maybe_broadcast, table
from .tokens import tokenizer

CAPACITY, END = 2048, 1


def fill(counts: dict[int, int], room: int) -> tuple[int, dict[int, int]]:
    """The multiset out of counts (length -> number) whose sum is closest to room from below.

    Subset sums are the bits of one integer; every (length, power of two) is one shift. The sums known
    before each shift are kept, and walking back over them gives the numbers used.
    """
    sums, mask, steps = 1, (1 << (room + 1)) - 1, []
    for length in sorted((x for x in counts if x <= room and counts[x]), reverse=True):
        left, many = min(counts[length], room // length), 1
        while left:
            take = min(many, left)
            left -= take
            many *= 2
            steps.append((sums, length, take))
            sums |= (sums << (length * take)) & mask
        if sums >> room & 1:
            break
    best = sums.bit_length() - 1
    used: dict[int, int] = {}
    at = best
    for before, length, take in reversed(steps):
        if not before >> at & 1:
            at -= length * take
            used[length] = used.get(length, 0) + take
    return best, used


class Plan:
    """Places of all pieces: rows (length, first rank, sequence, offset) in order of (length, rank);
    from then on each rank has the next sequence, or, in the tail, the next place of the stream."""

    def __init__(self, histogram: dict[int, int], capacity: int = CAPACITY):
        counts = {k: v for k, v in histogram.items() if v}
        self.capacity, self.sequences = capacity, 0
        used_rank = dict.fromkeys(counts, 0)
        rows, tail = [], []

        def put(length, n, offset):
            rows.append((length, used_rank[length], self.sequences, offset, 0))
            used_rank[length] += n
            counts[length] -= n

        while counts:
            seed = max(counts)
            counts[seed] -= 1
            best, used = fill(counts, capacity - seed)
            counts[seed] += 1
            if seed + best == capacity:
                used[seed] = used.get(seed, 0) + 1
                times = min(counts[x] // n for x, n in used.items())
                offset = 0
                for x in sorted(used, reverse=True):
                    for _ in range(used[x]):
                        put(x, times, offset)
                        offset += x
                self.sequences += times
            else:  # even the closest multiset leaves slack: these pieces go to the tail, which is cut to fit
                tail.append((seed, counts[seed]))
                counts[seed] = 0
            for x in [x for x in counts if not counts[x]]:
                del counts[x]
        stream = 0
        for length, n in tail:
            rows.append((length, used_rank[length], stream, 0, 1))
            stream += length * n
        self.tail_first, self.tail_tokens = self.sequences, stream
        # the last part of the stream becomes sequences whose lengths are powers of two: no padding
        ends, at = [], stream // capacity * capacity
        rest, bit = stream - at, 1 << capacity.bit_length()
        while bit:
            if rest & bit:
                ends.append(at := at + bit)
            bit >>= 1
        self.last = np.array([stream // capacity * capacity, *ends], np.int64)
        self.sequences += stream // capacity + len(ends)
        rows.sort()
        self.rows = np.array(rows, np.int64).reshape(-1, 5)
        self.key = (self.rows[:, 0] << 44) + self.rows[:, 1]

    def place(self, length: np.ndarray, rank: np.ndarray):
        """(piece row, first token in the piece, tokens, sequence, offset) of every piece or part."""
        row = np.searchsorted(self.key, (length << 44) + rank, side="right") - 1
        r = self.rows[row]
        ahead = rank - r[:, 1]
        inside = np.flatnonzero(r[:, 4] == 0)
        out = [np.stack([inside, np.zeros_like(inside), length[inside], r[inside, 2] + ahead[inside], r[inside, 3]])]
        at = np.flatnonzero(r[:, 4] == 1)
        begin = r[at, 2] + ahead[at] * length[at]
        stop, done = begin + length[at], np.zeros(len(at), np.int64)
        while len(at):
            pos = begin + done
            whole = pos < self.last[0]
            small = np.clip(np.searchsorted(self.last, pos, side="right"), 1, max(1, len(self.last) - 1))
            first = np.where(whole, pos // self.capacity * self.capacity, self.last[small - 1])
            last = np.where(whole, first + self.capacity, self.last[np.minimum(small, len(self.last) - 1)])
            seq = self.tail_first + np.where(whole, pos // self.capacity, self.last[0] // self.capacity + small - 1)
            n = np.minimum(stop, last) - pos
            out.append(np.stack([at, done, n, seq, pos - first]))
            done = done + n
            more = begin + done < stop
            at, begin, stop, done = at[more], begin[more], stop[more], done[more]
        return np.concatenate(out, axis=1)


def _crc(ids: np.ndarray) -> int:
    return zlib.crc32(ids.astype("<u4").tobytes())


def pieces(docs: DataFrame, path: str, id_col: str, text_col: str, capacity: int, end: int) -> DataFrame:
    """One row per window or rest of a document: pid, idx, doc_id, start, length, ids_crc32, doc_tokens,
    lrank (number among the pieces of that length in its partition), ids (of a rest)."""
    kind = docs.schema[id_col].dataType.simpleString()

    def run(batches):
        pid, idx, seen = TaskContext.get().partitionId(), 0, np.zeros(capacity + 1, np.int64)
        tok = tokenizer(path)
        for b in batches:
            texts = b.column(1).cast(pa.binary())
            for at in range(0, len(texts), 256):
                rows, raw = [], []
                for k, ids in enumerate(tok.ids(texts.slice(at, 256).to_pylist())):
                    ids = np.append(ids, np.array([end], ids.dtype))
                    for s in range(0, len(ids), capacity):
                        part = ids[s:s + capacity]
                        n = len(part)
                        rows.append((at + k, idx, s, n, _crc(part), len(ids), seen[n]))
                        raw.append(part.tobytes() if n < capacity else None)
                        seen[n] += 1
                        idx += 1
                c = np.array(rows, np.int64).T
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.full(len(raw), pid, np.int64)), pa.array(c[1]), b.column(0).take(pa.array(c[0])),
                     *(pa.array(c[j]) for j in range(2, 7)), pa.array(raw, pa.binary())],
                    names=["pid", "idx", "doc_id", "start", "length", "ids_crc32", "doc_tokens", "lrank", "ids"])

    return docs.select(id_col, F.col(text_col).cast("string")).mapInArrow(
        run, f"pid long, idx long, doc_id {kind}, start long, length long, ids_crc32 long, doc_tokens long, lrank long, ids binary")


def pack(docs: DataFrame, *, path: str, id_col: str = "doc_id", text_col: str = "text", capacity: int = CAPACITY, end: int = END) -> DataFrame:
    """One row per piece: doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset.

    Every id of every document (its token ids, then `end`) lies in one piece. Sequences are full, but
    for the last few, whose lengths are powers of two. A null text counts as empty and gives the single
    id `end`; null, equal or repeated ids of documents are packed as rows of their own; a very long text
    gives as many windows as it fills; an empty table gives no rows; other columns are not read.
    """
    made = cut(pieces(docs, path, id_col, text_col, capacity, end), "pieces")
    local = cut(made.groupBy("pid", "length").agg(F.count("*").alias("n")), "lengths")
    histogram = {r.length: r.n for r in local.groupBy("length").agg(F.sum("n").alias("n")).collect()}  # at most `capacity` rows
    plan = Plan(histogram, capacity)
    before = Window.partitionBy("length").orderBy("pid").rowsBetween(Window.unboundedPreceding, -1)
    base = local.select("pid", "length", F.coalesce(F.sum("n").over(before), F.lit(0)).cast("long").alias("base"))
    slim = made.select("pid", "idx", "doc_id", "start", "length", "ids_crc32", "doc_tokens", "lrank").join(
        base, ["pid", "length"]).withColumn("rank", F.col("base") + F.col("lrank"))
    kind = made.schema["doc_id"].dataType.simpleString()
    names = ["pid", "idx", "doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset", "skip", "whole"]

    def place(batches):
        for b in batches:
            t = pa.Table.from_batches([b])
            length, rank = t["length"].to_numpy(), t["rank"].to_numpy()
            row, skip, n, seq, offset = plan.place(length, rank)
            take = t.take(pa.array(row))
            yield from pa.Table.from_arrays(
                [take["pid"], take["idx"], take["doc_id"], pa.array(take["start"].to_numpy() + skip), pa.array(n), take["ids_crc32"],
                 take["doc_tokens"], pa.array(seq), pa.array(offset), pa.array(skip), pa.array(n == length[row])], names=names).to_batches()

    placed = cut(slim.select("pid", "idx", "doc_id", "start", "length", "ids_crc32", "doc_tokens", "rank").mapInArrow(
        place, f"pid long, idx long, doc_id {kind}, start long, length long, ids_crc32 long, doc_tokens long, "
        "sequence_id long, offset long, skip long, whole boolean"), "placed")
    out = ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"]
    width = tokenizer(path).kind.itemsize

    def again(batches):
        for b in batches:
            t = pa.Table.from_batches([b])
            crc = [zlib.crc32(np.frombuffer(x, f"<u{width}")[s:s + n].astype("<u4").tobytes()) for x, s, n in zip(
                t["ids"].to_pylist(), t["skip"].to_pylist(), t["length"].to_pylist(), strict=True)]
            yield from t.drop_columns(["ids", "skip"]).set_column(3, "ids_crc32", pa.array(crc, pa.int64())).to_batches()

    # as a rule a handful of pieces is cut, and then the ids of the others stay where they are
    parts = made.select("pid", "idx", "ids").join(maybe_broadcast(placed.where(~F.col("whole"))), ["pid", "idx"])
    schema = f"doc_id {kind}, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long"
    parts = parts.select(*out, "ids", "skip").mapInArrow(again, schema)
    return placed.where("whole").select(out).union(parts.select(out))


def op2_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset of every piece."""
    import public_tokenizers

    return pack(table(spark, sf_dir, "documents").select("doc_id", "text"), path=public_tokenizers.path("word_bpe_49k.json"))


QUERIES = {"op2_packing": op2_packing}
ORACLE: dict[str, str] = {}
