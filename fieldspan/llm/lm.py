"""N-gram language model in Elias-Fano tries, built and queried shard by shard.

A word's context is the word before it, or, where that word makes up a large part of the corpus, the
last two or three words: so no context is a bottleneck. All words of a context live in one shard, where a
trie is built from the training texts: contexts, monotone pointers to their successors, successors
and quantised probabilities, each level compact and in one memory-mapped file. The shard also answers
for all texts, and sends back one partial sum for each text. Nothing is gathered on the driver but the
words that are hot (at most 4000, by their share) and single numbers.

Probability: absolute discounting with backing off to the unigram of the contract,
p(w | h) = (c(h, w) - D) / c(h) if the pair was seen, else (mass kept back by the D) / c(h) * p(w);
p(w) if h was not seen and at the start of a text. Sums over w are at most 1.
"""

from __future__ import annotations

import mmap
import struct
import tempfile

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import crc_mod, cut, table
from .hashing import mix, words

_SPACE = np.zeros(256, np.uint8)
_SPACE[[32, 9, 10, 11, 12, 13]] = 1
END = np.uint64(0x0E4D0E4D0E4D0E4D)
START = np.uint64(0x57A4757A4757A475)
#: Discounts of pairs seen once, twice, more often.
DISCOUNTS = (0.9, 1.3, 1.6)
#: Bytes of text that one batch of the scatter holds, and bytes that are hashed at once.
BATCH, CHUNK = 8 << 20, 1 << 18
#: A word whose share of a batch's tokens is at least 1 / LOCAL is counted as a candidate there; hot are
#: candidates whose counted tokens make up 1 / HOT of all. Every word with a share of 3 / LOCAL is hot.
LOCAL, HOT = 4000, 2000
#: Rows that a shard holds, about.
SHARD_ROWS = 3_000_000
#: Bits of a successor's hash, and steps of the quantised log10 probabilities to the unit.
WORD_BITS, STEPS = 40, 512
WORD_MASK = np.uint64((1 << WORD_BITS) - 1)


def token_hashes(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all words of the lower-cased texts in a row, and the number of each text's words."""
    parts, counts, at = [], np.zeros(len(texts), np.int64), 0
    while at < len(texts):
        group, size = [], 0
        while at + len(group) < len(texts) and (not group or size + len(texts[at + len(group)]) <= CHUNK):
            group.append(texts[at + len(group)])
            size += len(group[-1]) + 1
        if len(group) == 1 and size > CHUNK:  # one long text, cut at white space
            text, s = group[0], 0
            while s < len(text):
                e = min(len(text), s + CHUNK)
                while e < len(text) and not _SPACE[text[e]]:
                    e += 1
                h = words(text[s:e].lower(), _SPACE)[1]
                parts.append(h)
                counts[at] += len(h)
                s = e
        else:
            start, h, _ = words(b" ".join(group).lower(), _SPACE)
            ends = np.cumsum([len(t) + 1 for t in group])
            counts[at:at + len(group)] = np.bincount(np.searchsorted(ends, start, side="right"), minlength=len(group))
            parts.append(h)
        at += len(group)
    return np.concatenate(parts) if parts else np.zeros(0, np.uint64), counts


def _batches(batches):
    """Rows (ids, training flags, texts) in groups of about BATCH bytes of text."""
    ids, train, texts, size = [], [], [], 0
    for b in batches:
        col = b.column(2).cast(pa.binary())
        for i in range(len(col)):
            t = col[i].as_py() or b""
            ids.append((b.column(0), i))
            train.append(b.column(1)[i].as_py())
            texts.append(t)
            size += len(t)
            if size >= BATCH:
                yield ids, np.array(train, bool), texts
                ids, train, texts, size = [], [], [], 0
    if texts:
        yield ids, np.array(train, bool), texts


class EliasFano:
    """A monotone sequence of n numbers below a bound in about 2 + log2(bound / n) bits each.

    The low bits are packed, the high ones are in unary; a count of ones for each 512 bits finds the
    place of a zero. The arrays are views of one buffer, so the whole may lie in a mapped file.
    """

    BLOCK = 512

    def __init__(self, n: int, low_bits: int, low: np.ndarray, high: np.ndarray, zeros: np.ndarray):
        self.n, self.low_bits, self.low, self.high, self.zeros = n, low_bits, low, high, zeros

    @classmethod
    def build(cls, values: np.ndarray, bound: int) -> EliasFano:
        n = len(values)
        low_bits = min(63, max(0, (max(1, bound) // max(1, n)).bit_length() - 1))
        values = values.astype(np.uint64)
        low = np.zeros((n * low_bits + 127) // 64, np.uint64)
        if low_bits and n:
            bits = values & np.uint64((1 << low_bits) - 1)
            at = np.arange(n, dtype=np.uint64) * np.uint64(low_bits)
            word, shift = (at >> np.uint64(6)).astype(np.int64), at & np.uint64(63)
            first = np.flatnonzero(np.concatenate([[True], word[1:] != word[:-1]]))
            low[word[first]] |= np.bitwise_or.reduceat(bits << shift, first)
            over = np.flatnonzero(shift + np.uint64(low_bits) > 64)  # at most one value spills into each next word
            low[word[over] + 1] |= bits[over] >> (np.uint64(64) - shift[over])
        high = (values >> np.uint64(low_bits)).astype(np.int64)
        size = n + int(bound >> low_bits) + 2
        bit = np.zeros((size + cls.BLOCK - 1) // cls.BLOCK * cls.BLOCK, np.uint8)
        bit[high + np.arange(n)] = 1
        packed = np.packbits(bit, bitorder="little").view(np.uint64)
        ones = np.bitwise_count(packed).reshape(-1, cls.BLOCK // 64).sum(1, dtype=np.int64)
        zeros = np.concatenate([[0], np.cumsum(cls.BLOCK - ones)])
        return cls(n, low_bits, low, packed, zeros)

    def _zero(self, k: np.ndarray) -> np.ndarray:
        """Place of the zero number k (from 0)."""
        block = np.searchsorted(self.zeros, k, side="right") - 1
        left = k - self.zeros[block]
        word = block * (self.BLOCK // 64)
        for _ in range(self.BLOCK // 64 - 1):
            here = 64 - np.bitwise_count(self.high[word]).astype(np.int64)
            go = left >= here
            left = left - np.where(go, here, 0)
            word = word + go
        w, place = ~self.high[word], word * 64
        for width in (32, 16, 8, 4, 2, 1):  # halves of the word: is the zero in the lower one?
            here = np.bitwise_count(w & np.uint64((1 << width) - 1)).astype(np.int64)
            go = left >= here
            left = left - np.where(go, here, 0)
            w = np.where(go, w >> np.uint64(width), w)
            place = place + np.where(go, width, 0)
        return place

    def _low(self, i: np.ndarray) -> np.ndarray:
        if not self.low_bits:
            return np.zeros(len(i), np.uint64)
        at = i.astype(np.uint64) * np.uint64(self.low_bits)
        word, shift = (at >> np.uint64(6)).astype(np.int64), at & np.uint64(63)
        v = self.low[word] >> shift
        over = shift + np.uint64(self.low_bits) > 64
        v = np.where(over, v | (self.low[word + 1] << ((np.uint64(64) - shift) & np.uint64(63))), v)
        return v & np.uint64((1 << self.low_bits) - 1)

    def find(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Number of the first value >= x (the successor), and whether it equals x."""
        x = x.astype(np.uint64)
        high = (x >> np.uint64(self.low_bits)).astype(np.int64)
        stop = self._zero(high) - high
        start = np.zeros_like(stop)
        some = high > 0
        start[some] = self._zero(high[some] - 1) - (high[some] - 1)
        want = x & np.uint64((1 << self.low_bits) - 1)
        end = stop.copy()
        live = np.flatnonzero(start < end)
        while len(live):  # binary search inside the run of equal high bits
            mid = (start[live] + end[live]) >> 1
            less = self._low(mid) < want[live]
            start[live] = np.where(less, mid + 1, start[live])
            end[live] = np.where(less, end[live], mid)
            live = live[start[live] < end[live]]
        hit = start < stop
        hit[hit] = self._low(start[hit]) == want[hit]
        return start, hit

    def get(self, i: np.ndarray) -> np.ndarray:
        """Values by number, from the places of the ones."""
        ones = np.arange(len(self.zeros)) * self.BLOCK - self.zeros
        block = np.searchsorted(ones, i, side="right") - 1
        left, word = i - ones[block], block * (self.BLOCK // 64)
        for _ in range(self.BLOCK // 64 - 1):
            here = np.bitwise_count(self.high[word]).astype(np.int64)
            go = left >= here
            left, word = left - np.where(go, here, 0), word + go
        w, place = self.high[word], word * 64
        for width in (32, 16, 8, 4, 2, 1):
            here = np.bitwise_count(w & np.uint64((1 << width) - 1)).astype(np.int64)
            go = left >= here
            left = left - np.where(go, here, 0)
            w = np.where(go, w >> np.uint64(width), w)
            place = place + np.where(go, width, 0)
        return ((place - i).astype(np.uint64) << np.uint64(self.low_bits)) | self._low(i)


class Trie:
    """Contexts, pointers, successors and probabilities of one shard in a mapped file.

    context[i] has the successors pointer[i] .. pointer[i + 1]; a successor is stored relative to its
    context as i * 2^WORD_BITS + word, which makes the level one monotone sequence; prob and keep are
    log10 probabilities in steps of 1 / STEPS, rounded down.
    """

    def __init__(self, contexts: np.ndarray, start: np.ndarray, successors: np.ndarray, prob: np.ndarray, keep: np.ndarray):
        n, m = len(contexts), len(successors)
        levels = [EliasFano.build(contexts, 1 << 64), EliasFano.build(start, m + 1),
                  EliasFano.build((np.repeat(np.arange(n, dtype=np.uint64), np.diff(start)) << np.uint64(WORD_BITS)) | successors, max(1, n) << WORD_BITS)]
        arrays = [a for e in levels for a in (e.low, e.high, e.zeros)] + [prob, keep]
        size = sum(a.nbytes + 8 for a in arrays) + 8
        self.file = tempfile.TemporaryFile()
        self.file.truncate(size)
        self.map = mmap.mmap(self.file.fileno(), size)
        views, at = [], 0
        for a in arrays:
            self.map[at:at + a.nbytes] = a.tobytes()
            views.append(np.frombuffer(self.map, a.dtype, len(a), at))
            at += (a.nbytes + 7) // 8 * 8
        self.context, self.pointer, self.successor = (EliasFano(e.n, e.low_bits, *views[3 * i:3 * i + 3]) for i, e in enumerate(levels))
        self.prob, self.keep = views[9:]

    def find_context(self, h: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        return self.context.find(h)

    def find(self, context: np.ndarray, word: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Successor search among the successors of context numbers: place in the level, seen or not."""
        place, hit = self.successor.find((context.astype(np.uint64) << np.uint64(WORD_BITS)) | word)
        return place, hit & (place < self.pointer.get(context + 1).astype(np.int64))

    def log_prob(self, place: np.ndarray) -> np.ndarray:
        return -self.prob[place].astype(np.float64) / STEPS

    def log_keep(self, context: np.ndarray) -> np.ndarray:
        return -self.keep[context].astype(np.float64) / STEPS

    def close(self):
        for e in (self.context, self.pointer, self.successor):
            e.low = e.high = e.zeros = None
        self.prob = self.keep = None
        try:
            self.map.close()
        except BufferError:  # a view is still alive; the file has no name and goes with it
            pass
        self.file.close()


def quantised(p: np.ndarray) -> np.ndarray:
    """-log10 p in steps, rounded up, so that the probability is rounded down."""
    return np.clip(np.ceil(-np.log10(p) * STEPS - 1e-9), 0, 65535).astype(np.uint16)


def build(context: np.ndarray, word: np.ndarray, times: np.ndarray, discounts=DISCOUNTS) -> tuple[Trie, np.ndarray]:
    """Trie of training pairs (sorted by context, word; repeats allowed) and the count of each context."""
    new = np.concatenate([[True], (context[1:] != context[:-1]) | (word[1:] != word[:-1])]) if len(context) else np.zeros(0, bool)
    at = np.flatnonzero(new)
    pair = np.add.reduceat(times, at) if len(at) else np.zeros(0, np.int64)
    c, w = context[at], word[at]
    first = np.flatnonzero(np.concatenate([[True], c[1:] != c[:-1]])) if len(c) else np.zeros(0, np.int64)
    total = np.add.reduceat(pair, first) if len(first) else np.zeros(0, np.int64)
    d = np.array((0.0, *discounts))[np.minimum(pair, 3)]
    kept = np.add.reduceat(d, first) if len(first) else np.zeros(0)
    start = np.append(first, len(c))
    prob = quantised((pair - d) / np.repeat(total, np.diff(start)))
    return Trie(c[first], start, w, prob, quantised(np.minimum(1.0, kept / np.maximum(total, 1)))), total


def _pack(**arrays: np.ndarray) -> bytes:
    """Arrays as one blob: shapes first, then the bytes."""
    head = ",".join(f"{k}:{a.dtype.str}:{len(a)}" for k, a in arrays.items()).encode()
    return b"".join([struct.pack("<I", len(head)), head, *(a.tobytes() for a in arrays.values())])


def _unpack(blob: bytes) -> dict[str, np.ndarray]:
    n = struct.unpack_from("<I", blob)[0]
    at, out = 4 + n, {}
    for part in blob[4:4 + n].decode().split(","):
        k, kind, size = part.split(":")
        out[k] = np.frombuffer(blob, np.dtype(kind), int(size), at)
        at += out[k].nbytes
    return out


def _sums(count, base, score, known, uni) -> bytes:
    """Partial sums of a batch's documents, only of those that have any."""
    some = np.flatnonzero(count)
    return _pack(doc=some.astype(np.uint32), base=base[some], score=score[some],
                 known=known[some].astype(np.uint32), uni=uni[some].astype(np.uint32))


def _contexts(h: np.ndarray, counts: np.ndarray, hot: np.ndarray):
    """Of each token but the first of its text, the text's end included: text, context, word; and of each
    text its first token. h: word hashes of the texts in a row."""
    n = len(counts)
    total = counts + 1
    ends = np.cumsum(total)
    seq = np.empty(int(ends[-1]) if n else 0, np.uint64)
    real = np.ones(len(seq), bool)
    real[ends - 1] = False
    seq[real] = h
    seq[ends - 1] = END
    doc = np.repeat(np.arange(n), total)
    place = np.arange(len(seq)) - np.repeat(ends - total, total)
    back = lambda k: np.where(place >= k, np.concatenate([np.full(min(k, len(seq)), START), seq[:-k]]) if len(seq) else seq, START)
    is_hot = lambda x: hot[np.minimum(np.searchsorted(hot, x), len(hot) - 1)] == x if len(hot) else np.zeros(len(x), bool)
    one = back(1)
    context = one & ~np.uint64(1)
    far = np.flatnonzero(is_hot(one))
    if len(far):
        two, three = back(2)[far], back(3)[far]
        longer = mix(one[far] + two * np.uint64(0x9FB21C651E98DF25))
        longer = np.where(is_hot(two), mix(longer + three * np.uint64(0xD6E8FEB86659FD93)), longer)
        context[far] = longer | np.uint64(1)
    inner = place > 0
    return doc[inner], context[inner], seq[inner], seq[ends - total] if n else seq


def score_texts(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", folds: int = 10) -> DataFrame:
    """One row per document: id_col, held_out, n_tokens, n_known, train_tokens, base_score, score.

    Training texts are those whose crc32(id) mod `folds` is not 0 (a null id counts as the empty text).
    Tokens are words of the lower-cased (A-Z) text and one end. Null and empty texts have the end alone.
    Repeated rows count and are scored as rows of their own; texts of any length are read whole, part by
    part; without training texts every token is unknown; an empty table gives no rows; other columns are
    not read. Words are told apart by 64-bit hashes, successors of a context by WORD_BITS bits.
    """
    spark = docs.sparkSession
    base = docs.select(F.col(id_col).alias("id"), (crc_mod(id_col, folds) != 0).alias("train"), F.col(text_col).cast("string").alias("text"))
    kind = base.schema["id"].dataType

    def survey(batches):
        for _, train, texts in _batches(batches):
            h, counts = token_hashes(texts)
            bucket = (h & np.uint64((1 << 18) - 1)).astype(np.int64)
            least = max(2, (len(h) + len(texts)) // LOCAL)
            u, n = np.unique(h[np.bincount(bucket, minlength=1 << 18)[bucket] >= least], return_counts=True)
            u, n = u[n >= least], n[n >= least]
            rows = [np.append(u.view(np.int64), [0, 0, 0]), np.append(np.zeros(len(u), np.int64), [1, 2, 3]),
                    np.append(n, [int((counts + 1)[train].sum()), int(train.sum()), int((counts + 1).sum())])]
            yield pa.RecordBatch.from_arrays([pa.array(r) for r in rows], names=["h", "kind", "n"])

    seen = cut(base.mapInArrow(survey, "h long, kind long, n long").groupBy("kind", "h").agg(F.sum("n").alias("n")), "survey")
    numbers = {r.kind: r.n for r in seen.where("kind > 0").collect()}
    train_tokens, train_docs, all_tokens = (numbers.get(k, 0) for k in (1, 2, 3))
    # by their share there are at most HOT of them
    hot_rows = seen.where((F.col("kind") == 0) & (F.col("n") * HOT >= max(1, all_tokens))).select("h").collect()
    hot = np.sort(np.array([r.h for r in hot_rows], np.int64).view(np.uint64))

    def count_hot(batches):
        total = np.zeros(len(hot) + 1, np.int64)
        for _, train, texts in _batches(batches):
            h, _ = token_hashes([t for t, k in zip(texts, train, strict=True) if k])
            at = np.minimum(np.searchsorted(hot, h), len(hot) - 1)
            total[:-1] += np.bincount(at[hot[at] == h], minlength=len(hot))
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(hot))), pa.array(total[:-1])], names=["i", "n"])

    hot_count = np.zeros(len(hot), np.int64)
    if len(hot):
        for r in base.mapInArrow(count_hot, "i long, n long").groupBy("i").agg(F.sum("n").alias("n")).collect():
            hot_count[r.i] = r.n
    hot_log = np.log10(hot_count + 0.1)
    end_log = float(np.log10(train_docs + 0.1))

    parts = max(1, int(spark.conf.get("spark.sql.shuffle.partitions")))
    shards = parts * max(1, -(-all_tokens // (SHARD_ROWS * parts)))
    labels = _labels(spark, parts, shards)

    def scatter(batches):
        from pyspark import TaskContext

        pid, number = TaskContext.get().partitionId(), 0
        for ids, train, texts in _batches(batches):
            key = (pid << 32) + number
            number += 1
            h, counts = token_hashes(texts)
            doc, context, word, first = _contexts(h, counts, hot)
            n = len(texts)
            # what the mapper knows itself: ends, hot words, hot first words
            at = np.minimum(np.searchsorted(hot, h), len(hot) - 1) if len(hot) else np.zeros(len(h), np.int64)
            is_hot = hot[at] == h if len(hot) else np.zeros(len(h), bool)
            of = np.repeat(np.arange(n), counts)[is_hot]
            own_base = np.bincount(of, hot_log[at[is_hot]], minlength=n) + end_log
            own_known = np.bincount(of, hot_count[at[is_hot]] > 0, minlength=n) + (train_docs > 0)
            f_at = np.minimum(np.searchsorted(hot, first), len(hot) - 1) if len(hot) else np.zeros(n, np.int64)
            f_hot = hot[f_at] == first if len(hot) else np.zeros(n, bool)
            empty = counts == 0
            own_score = np.where(empty, end_log, np.where(f_hot & ~empty, hot_log[f_at] if len(hot) else 0.0, 0.0))
            own = _pack(doc=np.arange(n, dtype=np.uint32), base=own_base, score=own_score, known=own_known.astype(np.uint32),
                        uni=(empty | f_hot).astype(np.uint32), tokens=counts + 1, train=train.astype(np.uint8))
            id_list = [c[i].as_py() for c, i in ids]
            # a text's first word, if not hot, is the context of its second token
            begin = np.concatenate([[True], doc[1:] != doc[:-1]])[:len(doc)] & ((context & np.uint64(1)) == 0)
            order = np.lexsort((word & WORD_MASK, context))
            doc, context, word, begin = doc[order], context[order], word[order] & WORD_MASK, begin[order]
            same = np.concatenate([[False], (context[1:] == context[:-1]) & (word[1:] == word[:-1]) & (doc[1:] == doc[:-1])]) if len(doc) else np.zeros(0, bool)
            lead = np.flatnonzero(~same)
            times = np.diff(np.append(lead, len(doc)))
            opens = np.logical_or.reduceat(begin, lead) if len(lead) else begin
            doc, context, word = doc[lead], context[lead], word[lead]
            # shards are ranges of contexts, so rows of a shard are in a row
            cutoff = np.searchsorted(context, np.array([-(-(s << 64) // shards) for s in range(1, shards)], np.uint64))
            edges = np.concatenate([[0], cutoff, [len(doc)]])
            home = key % shards
            for s in range(shards):
                a, b = int(edges[s]), int(edges[s + 1])
                if a == b and s != home:
                    continue
                c, m = np.unique(context[a:b], return_counts=True)
                w = word[a:b]
                blob = _pack(c=c, m=m.astype(np.uint32), lo=(w & np.uint64(0xFFFFFFFF)).astype(np.uint32), hi=(w >> np.uint64(32)).astype(np.uint8),
                             doc=doc[a:b].astype(np.uint16 if n < 1 << 16 else np.uint32), times=times[a:b].astype(np.uint32),
                             opens=np.flatnonzero(opens[a:b]).astype(np.uint32), held=np.flatnonzero(~train).astype(np.uint32), docs=np.array([n], np.uint32))
                yield pa.RecordBatch.from_arrays(
                    [pa.array([labels[s]], pa.int64()), pa.array([key], pa.int64()), pa.array([blob], pa.binary()),
                     pa.array([own if s == home else None], pa.binary()), pa.array([id_list if s == home else None], pa.list_(b_kind))],
                    names=["shard", "batch", "blob", "own", "ids"])

    from pyspark.sql.pandas.types import to_arrow_type

    b_kind = to_arrow_type(kind)
    scattered = base.mapInArrow(scatter, f"shard long, batch long, blob binary, own binary, ids array<{kind.simpleString()}>")
    out_schema = pa.schema([("kind", pa.int32()), ("key", pa.int64()), ("n", pa.int64()), ("blob", pa.binary()), ("ids", pa.list_(b_kind))])

    def answer(g: pa.Table) -> pa.Table:
        rows: list[tuple] = []
        keys, blobs = g["batch"].to_pylist(), g["blob"]
        parts_ = [_unpack(blobs[i].as_py()) for i in range(g.num_rows)]
        for i, own in enumerate(g["own"].to_pylist()):
            if own is not None:
                rows.append((0, keys[i], 0, own, g["ids"][i].as_py()))
        size = np.array([len(p["lo"]) for p in parts_])
        docs_n = np.array([int(p["docs"][0]) for p in parts_])
        slot0 = np.cumsum(docs_n) - docs_n  # documents of all batches in a row
        context = np.concatenate([np.repeat(p["c"], p["m"]) for p in parts_])
        word = np.concatenate([p["lo"].astype(np.uint64) | (p["hi"].astype(np.uint64) << np.uint64(32)) for p in parts_])
        slot = np.concatenate([p["doc"].astype(np.int64) + s for p, s in zip(parts_, slot0, strict=True)])
        times = np.concatenate([p["times"] for p in parts_]).astype(np.int64)
        opens = np.zeros(len(word), bool)
        opens[np.concatenate([p["opens"].astype(np.int64) + s for p, s in zip(parts_, np.cumsum(size) - size, strict=True)])] = True
        held = np.zeros(int(docs_n.sum()), bool)
        held[np.concatenate([p["held"].astype(np.int64) + s for p, s in zip(parts_, slot0, strict=True)])] = True
        del parts_, blobs, g
        order = np.lexsort((word, context))
        context, word, slot, times, opens = context[order], word[order], slot[order], times[order], opens[order]
        learn = ~held[slot]
        trie, total = build(context[learn], word[learn], times[learn])
        # distinct pairs are looked up once
        lead = np.flatnonzero(np.concatenate([[True], (context[1:] != context[:-1]) | (word[1:] != word[:-1])])) if len(context) else np.zeros(0, np.int64)
        back = np.repeat(np.arange(len(lead)), np.diff(np.append(lead, len(context))))
        of_context = np.flatnonzero(np.concatenate([[True], context[lead][1:] != context[lead][:-1]])) if len(lead) else lead
        which = np.repeat(np.arange(len(of_context)), np.diff(np.append(of_context, len(lead))))
        at, known = trie.find_context(context[lead][of_context])
        count = np.zeros(len(of_context), np.int64)
        count[known] = total[at[known]]
        keep = np.zeros(len(of_context))
        keep[known] = trie.log_keep(at[known])
        place, there = np.zeros(len(lead), np.int64), known[which]
        place[there], there[there] = trie.find(at[which[there]], word[lead][there])
        log_p = np.where(there, 0.0, keep[which])
        log_p[there] = trie.log_prob(place[there])
        trie.close()
        there, log_p, count = there[back], log_p[back], count[which][back]
        single = (context & np.uint64(1)) == 0
        log_c = np.log10(count + 0.1)
        base_ = np.where(single, times * log_c, 0.0)
        score_ = times * log_p + np.where(opens, log_c, 0.0)
        known_ = np.where(single & (count > 0), times, 0)
        uni_ = opens.astype(np.int64) + np.where(there, 0, times)
        # pairs not seen need the unigram of the word: hot words and the end are known here
        ask = np.flatnonzero(~there)
        w40 = word[ask]
        own40 = np.append(hot & WORD_MASK, END & WORD_MASK)
        by = np.argsort(own40)
        logs = np.append(hot_log, end_log)[by]
        own40 = own40[by]
        pos = np.minimum(np.searchsorted(own40, w40), len(own40) - 1)
        mine = own40[pos] == w40
        score_[ask[mine]] += times[ask[mine]] * logs[pos[mine]]
        ask, w40 = ask[~mine], w40[~mine]
        batch_of = np.searchsorted(np.cumsum(docs_n), slot[ask], side="right")
        by_doc = [np.bincount(slot, v, minlength=len(held)) for v in (None, base_, score_, known_, uni_)]
        for i, (a, n) in enumerate(zip(slot0.tolist(), docs_n.tolist(), strict=True)):
            rows.append((1, keys[i], 0, _sums(*(v[a:a + n] for v in by_doc)), None))
        vocabulary = np.flatnonzero(known & ((context[lead][of_context] & np.uint64(1)) == 0))
        rows.append((4, 0, len(vocabulary), b"", None))
        v40, vc = context[lead][of_context][vocabulary] & WORD_MASK, total[at[vocabulary]]
        # the unigram of a word is kept without bit 0, as its context is
        for kind_, values, extra in ((2, v40, (vc,)), (3, w40 & ~np.uint64(1), (np.array(keys, np.int64)[batch_of], (slot[ask] - slot0[batch_of]).astype(np.uint32), times[ask].astype(np.uint32)))):
            target = (mix(values) % np.uint64(shards)).astype(np.int64)
            order = np.argsort(target, kind="stable")
            edges = np.searchsorted(target[order], np.arange(shards + 1))
            for s in range(shards):
                sel = order[edges[s]:edges[s + 1]]
                if len(sel):
                    rows.append((kind_, labels[s], 0, _pack(w=values[sel], **{f"x{j}": e[sel] for j, e in enumerate(extra)}), None))
        return pa.Table.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), out_schema, strict=True)], schema=out_schema)

    sql_out = f"kind int, key long, n long, blob binary, ids array<{kind.simpleString()}>"
    answered = cut(scattered.repartition(parts, "shard").groupBy("shard").applyInArrow(answer, sql_out), "answers")
    distinct = (answered.where("kind = 4").agg(F.sum("n")).first()[0] or 0) + int((hot_count > 0).sum()) + (train_docs > 0)

    def unigrams(g: pa.Table) -> pa.Table:
        """Words that texts back off to, answered where the vocabulary of their hashes is."""
        kinds, blobs = g["kind"].to_pylist(), [_unpack(b.as_py()) for b in g["blob"]]
        asks = [b for k, b in zip(kinds, blobs, strict=True) if k == 3]
        if not asks:
            return pa.schema([("key", pa.int64()), ("blob", pa.binary()), ("ids", pa.list_(b_kind))]).empty_table()
        vocab = [b for k, b in zip(kinds, blobs, strict=True) if k == 2]
        v = np.concatenate([b["w"] for b in vocab]) if vocab else np.zeros(0, np.uint64)
        c = np.concatenate([b["x0"] for b in vocab]) if vocab else np.zeros(0, np.int64)
        order = np.argsort(v, kind="stable")
        v, c = v[order], c[order]
        level = EliasFano.build(v, 1 << WORD_BITS)
        w, key, doc, times = (np.concatenate([b[k] for b in asks]) for k in ("w", "x0", "x1", "x2"))
        at, hit = level.find(w) if len(v) else (np.zeros(len(w), np.int64), np.zeros(len(w), bool))
        score = np.full(len(w), -1.0)
        score[hit] = np.log10(c[at[hit]] + 0.1)
        rows, order = [], np.argsort(key, kind="stable")
        each, first = np.unique(key[order], return_index=True)
        for k, sel in zip(each.tolist(), np.split(order, first[1:]), strict=True):
            total = np.bincount(doc[sel], times[sel] * score[sel])
            zero = np.zeros(len(total))
            rows.append((k, _sums(np.bincount(doc[sel]), zero, total, zero, zero), None))
        return pa.Table.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), (pa.int64(), pa.binary(), pa.list_(b_kind)), strict=True)],
                                    names=["key", "blob", "ids"])

    partial = f"key long, blob binary, ids array<{kind.simpleString()}>"
    backed = answered.where("kind in (2, 3)").select("kind", "key", "blob").groupBy("key").applyInArrow(unigrams, partial)
    norm = float(np.log10(train_tokens + 0.1 * (distinct + 1)))

    def gather(g: pa.Table) -> pa.Table:
        ids = next(x for x in g["ids"].to_pylist() if x is not None)
        n = len(ids)
        total = {k: np.zeros(n) for k in ("base", "score", "known", "uni")}
        for b in g["blob"]:
            p = _unpack(b.as_py())
            for k, t in total.items():
                t[p["doc"]] += p[k]
            if "tokens" in p:
                tokens, train = p["tokens"], p["train"].astype(bool)
        return pa.Table.from_arrays(
            [pa.array(ids, b_kind), pa.array(~train), pa.array(tokens.astype(np.int64)), pa.array(total["known"].astype(np.int64)),
             pa.array(np.full(n, train_tokens, np.int64)), pa.array(total["base"] - tokens * norm), pa.array(total["score"] - total["uni"] * norm)],
            names=["id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score"])

    out = answered.where("kind in (0, 1)").select("key", "blob", "ids").union(backed)
    return out.groupBy("key").applyInArrow(
        gather, f"id {kind.simpleString()}, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double").withColumnRenamed("id", id_col)


def _labels(spark: SparkSession, parts: int, shards: int) -> list[int]:
    """Numbers for the shards that the shuffle's hash deals evenly to the partitions."""
    want, found = shards // parts, {p: [] for p in range(parts)}
    at = 0
    while any(len(v) < want for v in found.values()):
        for r in spark.range(at, at + 8 * parts * want).select("id", F.pmod(F.hash("id"), F.lit(parts)).alias("p")).collect():
            if len(found[r.p]) < want:
                found[r.p].append(r.id)
        at += 8 * parts * want
    return [x for p in range(parts) for x in found[p]]


def op5_lm(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score of every document."""
    return score_texts(table(spark, sf_dir, "documents").select("doc_id", "text"))


QUERIES = {"op5_lm": op5_lm}
ORACLE: dict[str, str] = {}
