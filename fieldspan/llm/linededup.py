"""Fuzzy line deduplication: SimHash of normalised lines, blocks of words, edit similarity, groups.

Equal normalised lines meet in one row first. At an edit similarity of 0.8 the SimHashes of two lines
differ in up to 20 of 64 bits, so blocks of their bits miss most such pairs (they found 0.40 of them).
The pigeonhole is therefore one of words: each table samples ROWS words of the line by least hash, and
a pair meets in a table whose sample holds no changed word. Lines that meet and whose SimHashes, lengths
and pairs of characters allow it are compared by edit similarity; of each connected group one occurrence stays.
"""

from __future__ import annotations

import ctypes
import gc
from functools import reduce, wraps
from operator import add

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import cut, drop, maybe_broadcast, stored, table
from .graph import components
from .hashing import Ranges, mix, runs

SIMILARITY, MIN_WORDS = 0.8, 1
#: Tables, and words that each samples: two lines that share the part j of their words meet in a table
#: with chance 1 - (1 - j^ROWS)^TABLES, 0.985 at j = 0.8, 0.95 at j = 0.75.
TABLES, ROWS = 8, 4
#: Candidates of more than FEW characters whose SimHashes differ in more than BITS bits are not compared:
#: other lines of one language differ in 24 or more on average, pairs with the similarity in up to 19, and
#: half of them in at most 7. The SimHash of a shorter line has too few words to tell.
BITS, FEW = 20, 120
#: Bits that say which pairs of neighbouring characters a line has. An edit takes up to two pairs away and
#: brings up to two, so it turns four bits at most: lines that differ in more bits cannot be similar.
GRAM_BITS = 512
#: Words of so many bytes are long; a line with at least ROWS long words is sampled from these alone.
LONG_BYTES = 5
#: Members of a block that are compared with each other in one tile.
TILE = 1024
#: Bytes of text that are worked on at once (a longer line counts whole).
CHUNK = 1 << 17
#: Documents that are put together again at once.
AT_ONCE = 500
#: Characters from which narrow bands are tried before the one of the bound.
SHORT = 1000
#: Bands, in words of 64 diagonals, in which many pairs are measured at once, the fewest pairs (weighed by length) that is done
#: for, and the characters of a group of them; in the bands TRIED pairs with wider bounds are measured too.
#: All ways give the same answers.
WIDTHS, MANY, GROUP = (1, 2, 3, 4, 6, 8, 12, 16, 24, 32), 40, 1 << 20
TRIED = (1, 4)
#: Leaders of a block, about, that all its members are compared with before its tiles.
LEADERS = 8
#: Words that a rough alignment skips in two lines where they differ, the fewest first.
SKIPS = sorted(((i, j) for i in range(5) for j in range(5) if i + j), key=lambda t: (sum(t), abs(t[0] - t[1])))
_BLANK = bytes(i if 48 <= i <= 57 or 97 <= i <= 122 or 65 <= i <= 90 or i >= 128 or i == 10 else 32 for i in range(256))
_CLASS = np.array([2 if i == 10 else 1 if _BLANK[i] == 32 else 0 for i in range(256)], np.uint8)
_ONES = np.uint64(0x0101010101010101)
_odd = np.random.default_rng(9).integers(0, 1 << 63, (TABLES, ROWS), np.uint64) * np.uint64(2) + np.uint64(1)

_word1, _word2 = Ranges(0xD6E8FEB86659FD93), Ranges(0xA0761D6478BD642F)


def simhash(word: np.ndarray, n: np.ndarray) -> np.ndarray:
    """Majority of each bit over the n[i] words (n[i] > 0) of line i.

    The 64 counters of a line are bytes of eight numbers, so 255 words are summed at once."""
    pieces = -(-n // 255)
    first = np.repeat(np.cumsum(n) - n, pieces) + 255 * (np.arange(int(pieces.sum())) - np.repeat(np.cumsum(pieces) - pieces, pieces))
    whole = np.cumsum(pieces) - pieces
    out = np.zeros(len(n), np.uint64)
    for j in range(8):
        count = np.add.reduceat((word >> np.uint64(j)) & _ONES, first).view(np.uint8).reshape(-1, 8)
        if len(first) > len(n):
            count = np.add.reduceat(count, whole, axis=0, dtype=np.int64)
        out |= (2 * count.astype(np.int64) > n[:, None]).astype(np.uint8).view(np.uint64)[:, 0] << np.uint64(j)
    return out


def blocks(word: np.ndarray, n: np.ndarray) -> list[np.ndarray]:
    """Key of each line in each table: its number and the words with the least hashes of ROWS orders."""
    first, keys = np.cumsum(n) - n, []
    for t in range(TABLES):
        key = np.full(len(n), t + 1, np.uint64)
        for k in range(ROWS):
            key = mix(key * np.uint64(0x9E3779B97F4A7C15) + np.minimum.reduceat(word * _odd[t, k], first))
        keys.append(key)
    return keys


def grams(lines: list[str]) -> np.ndarray:
    """GRAM_BITS bits a line, as a row of 64-bit numbers: the hashes of its pairs of neighbouring characters."""
    c = np.frombuffer("\n".join(lines).encode("utf-32-le", "replace"), np.uint32)
    line = np.cumsum(c == 10)
    at = np.flatnonzero((c[:-1] != 10) & (c[1:] != 10))
    pair = mix(c[at].astype(np.uint64) << np.uint64(32) | c[at + 1])
    bits = np.zeros((len(lines), GRAM_BITS), np.uint8)
    bits[line[at], pair & np.uint64(GRAM_BITS - 1)] = 1
    return np.packbits(bits, axis=1, bitorder="little").view(np.uint64)


def line_hashes(buf: bytes, only_keys: bool = False):
    """Of all lines of lower-cased text: number of words, characters of the normalised line, two 64-bit
    keys of all words in order, the SimHash (zero with only_keys) and the block keys, as arrays.

    Words are runs of letters a-z, digits and bytes from 128 up; everything else only parts them. Each
    character from U+0800 up begins a word, so scripts without blanks have words too."""
    a = np.frombuffer(buf, np.uint8)
    start, word, size = runs(buf, _CLASS, a >= 0xE0)
    breaks = np.flatnonzero(a == 10)
    lines = len(breaks) + 1
    line = np.searchsorted(breaks, start)
    n = np.bincount(line, minlength=lines)
    last = np.cumsum(n)
    k1, k2 = _word1(word, last - n, last), _word2(word, last - n, last)
    letters = np.concatenate([[0], np.cumsum((_CLASS[a] == 0) & ((a & 0xC0) != 0x80))])
    gaps = np.bincount(line[1:], (line[1:] == line[:-1]) & (start[1:] > start[:-1] + size[:-1]), minlength=lines) if len(line) else np.zeros(lines)
    chars = letters[np.append(breaks, len(a))] - letters[np.concatenate([[0], breaks + 1])] + gaps.astype(np.int64)
    sim, keys = np.zeros(lines, np.uint64), [np.zeros(lines, np.uint64) for _ in range(TABLES)]
    some = n > 0
    if some.any():
        if not only_keys:
            sim[some] = simhash(word, n[some])
        is_long = size >= LONG_BYTES
        use = is_long | (np.bincount(line, is_long, minlength=lines)[line] < ROWS)
        for out, key in zip(keys, blocks(word[use], np.bincount(line[use], minlength=lines)[some]), strict=True):
            out[some] = key
    return n, chars, k1, k2, sim, keys


def _parts(text: str):
    """Lower-cased bytes of a text in parts of whole lines."""
    low = text.lower().encode("utf-8", "replace")
    at = 0
    while len(low) - at > CHUNK:
        end = low.find(b"\n", at + CHUNK)
        if end < 0:
            break
        yield low[at:end]
        at = end + 1
    yield low[at:] if at else low


def give_back() -> None:
    """Memory that this process has freed goes back to the system."""
    gc.collect()
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (AttributeError, OSError):  # not the C library of GNU
        return


def trimmed(run):
    """run(batches) in a worker that keeps neither what the stages before nor what this one has freed:
    workers are used again, and their memory counts as the executor's."""
    @wraps(run)
    def out(batches):
        give_back()
        yield from run(batches)
        give_back()

    return out


KEYS = tuple(f"b{t}" for t in range(TABLES))


def lines_of(docs: DataFrame, min_words: int) -> DataFrame:
    """id, rid, line_no, k1, k2 and block keys of every line with at least min_words words; docs has rid,
    text, id."""
    names = ["id", "rid", "line_no", "k1", "k2", *KEYS]

    def run(batches):
        for b in batches:
            rids, texts = b.column(0).to_numpy(zero_copy_only=False), b.column(1)
            jobs: list[tuple[int, int, bytes]] = []  # row, number of its first line, bytes
            size = 0

            def flush(jobs, b=b, rids=rids):
                n, _, k1, k2, _, keys = line_hashes(b"\n".join(j[2] for j in jobs), only_keys=True)
                count = np.array([j[2].count(b"\n") + 1 for j in jobs])
                row = np.repeat(np.array([j[0] for j in jobs]), count)
                no = np.arange(len(n)) - np.repeat(np.cumsum(count) - count, count) + np.repeat([j[1] for j in jobs], count)
                ok = n >= min_words
                return pa.RecordBatch.from_arrays(
                    [b.column(2).take(pa.array(row[ok])), pa.array(rids[row[ok]]), pa.array(no[ok].astype(np.int32)),
                     *(pa.array(v[ok].view(np.int64)) for v in (k1, k2, *keys))], names=names)

            for i in range(len(texts)):
                t = texts[i].as_py()
                if not t:
                    continue
                line = 0
                for part in _parts(t):
                    jobs.append((i, line, part))
                    line += part.count(b"\n") + 1
                    size += len(part)
                    if size >= CHUNK:
                        yield flush(jobs)
                        jobs, size = [], 0
            if jobs:
                yield flush(jobs)

    kinds = [docs.schema["id"].dataType.simpleString(), "long", "int", *["long"] * (2 + TABLES)]
    return docs.select("rid", "text", "id").mapInArrow(trimmed(run), ", ".join(f"{n} {k}" for n, k in zip(names, kinds, strict=True)))


def normalised(line: str) -> str:
    """The line in lower case with every run of other characters as one blank."""
    return b" ".join(line.lower().encode("utf-8", "replace").translate(_BLANK).split()).decode("utf-8", "replace")


class _Is(dict):
    """Translation table: one character to 1, all others to 0."""

    def __init__(self, c: str):
        super().__init__({ord(c): "1"})

    def __missing__(self, _):
        return "0"


def banded(a: str, b: str, k: int) -> int:
    """Edit distance of a and b where it is at most k, else some number above k.

    Bit-parallel columns of the distance table, cut to the diagonals -k to k: rows below the band count
    as insertions, the row above it as growing, both of which only raise the result."""
    m, n = len(a), len(b)
    if abs(m - n) > k:
        return k + 1
    if not m:
        return n
    step = max(512, 2 * k)
    lo, hi = 0, min(m, step + k)
    grow, fall, score = (1 << hi) - 1, 0, hi
    for j in range(0, n, step):
        new_lo, new_hi = max(0, j - k), min(m, j + step + k)
        grow = (grow >> (new_lo - lo)) | (((1 << (new_hi - hi)) - 1) << (hi - new_lo))
        fall >>= new_lo - lo
        score += new_hi - hi
        lo, hi = new_lo, new_hi
        full, top = (1 << (hi - lo)) - 1, (1 << (hi - lo)) >> 1
        places: dict[str, int] = {}
        window = a[lo:hi]
        for c in set(window):  # the places of a character as the bits of one number
            places[c] = int(window[::-1].translate(_Is(c)), 2)
        for c in b[j:j + step]:
            eq = places.get(c, 0)
            zero = ((((eq | fall) & grow) + grow) ^ grow) | eq | fall
            up = fall | (~(zero | grow) & full)
            down = grow & zero
            score += bool(up & top) - bool(down & top)
            up = (up << 1 | 1) & full
            down = (down << 1) & full
            grow = down | (~(zero | up) & full)
            fall = up & zero
    return score


def _shared(a: str, b: str) -> int:
    """Length of the common beginning, by halving."""
    lo, hi = 0, min(len(a), len(b))
    while lo < hi:
        mid = (lo + hi + 1) >> 1
        if a[lo:mid] == b[lo:mid]:
            lo = mid
        else:
            hi = mid - 1
    return lo


def within(a: str, b: str, most: int) -> bool:
    """Whether the edit distance is at most `most`. Common ends cost nothing; bands widen, so few edits in
    long lines cost little."""
    if abs(len(a) - len(b)) > most:
        return False
    s = _shared(a, b)
    a, b = a[s:], b[s:]
    s = _shared(a[::-1], b[::-1])
    a, b = a[:len(a) - s], b[:len(b) - s]
    if not a or not b or max(len(a), len(b)) <= most:
        return max(len(a), len(b)) <= most
    k = most if len(a) <= SHORT else min(64, most)
    while True:
        if banded(a, b, k) <= k:
            return True
        if k >= most:
            return False
        k = min(4 * k, most)


def roughly(a: str, b: str, most: int) -> bool:
    """Whether an alignment of equal words, found from left to right, has at most `most` edits. The distance is
    never more than those, so True is certain; False says nothing."""
    x, y = a.split(" "), b.split(" ")
    i, j, m, n = 0, 0, len(x), len(y)
    while i < m or j < n:
        if i < m and j < n and x[i] == y[j]:
            i, j = i + 1, j + 1
            continue
        for p, q in SKIPS:
            if i + p <= m and j + q <= n and x[i + p:i + p + 2] == y[j + q:j + q + 2]:
                break
        else:
            return False
        # a word counts with the blank behind it: one more blank at both ends changes no distance
        most -= max(sum(map(len, x[i:i + p])) + p, sum(map(len, y[j:j + q])) + q)
        if most < 0:
            return False
        i, j = i + p, j + q
    return True


def _codes(texts: list[str], before: int, width: int, kind) -> np.ndarray:
    """The characters as numbers, one row of the width a text, zeros before and after them."""
    at = np.arange(width) - before
    out = np.zeros((len(texts), width), kind)
    out[(at >= 0) & (at < np.array([[len(t)] for t in texts]))] = np.frombuffer("".join(texts).encode("utf-32-le"), np.uint32)
    return out


def together(a: list[str], b: list[str], words: int) -> np.ndarray:
    """Edit distances of a[i] and b[i] where they are below 32 * words, else some number that is not.

    No text is empty or holds U+0000; lengths of a pair differ by less than 32 * words. The bit-parallel
    columns of all pairs at once, in a band of 64 * words diagonals that moves down a row with each column;
    the score follows the lowest diagonal to the end of a[i], then that row."""
    width, k = 64 * words, 32 * words - 1
    order = sorted(range(len(b)), key=lambda i: -len(b[i]))
    a, b = [a[i] for i in order], [b[i] for i in order]
    top = ord(max(map(max, a + b)))
    kind = np.uint8 if top < 1 << 8 else np.uint16 if top < 1 << 16 else np.uint32
    m, n = np.array([len(t) for t in a]), np.array([len(t) for t in b])
    before = width - 1 - k
    x = _codes(a, before, max(before + int(m.max()), int(n[0]) + width), kind)
    y = _codes(b, 0, int(n[0]), kind)
    grow = np.zeros((words, len(a)), np.uint64)
    for w in range(words):  # the first column grows from row 0 to row k
        grow[w] = sum(1 << i for i in range(64) if 64 * w + i >= width - 1 - k)
    fall, score = np.zeros_like(grow), np.minimum(m, k)
    one, last = np.uint64(1), np.uint64(63)
    for j in range(int(n[0])):
        p = int(np.searchsorted(-n, -j, "left"))  # texts of more than j characters come first
        up, down = grow[:, :p], fall[:, :p]
        same = np.packbits(x[:p, j:j + width] == y[:p, j, None], axis=1, bitorder="little").view(np.uint64).T | down
        zero, carry = np.empty_like(same), np.zeros(p, np.uint64)
        for w in range(words):
            part = same[w] & up[w]
            total = part + up[w]
            over = total < part
            total = total + carry
            carry = (over | (total < carry)).astype(np.uint64)
            zero[w] = (total ^ up[w]) | same[w]
        plus, minus = down | ~(zero | up), zero & up
        below = j + k + 1 - m[:p]  # rows of the band that lie below a[i]
        row = width - 1 - np.maximum(below, 0)
        w, bit, i = row >> 6, (row & 63).astype(np.uint64), np.arange(p)
        along = ((plus[w, i] >> bit) & one).astype(np.int64) - ((minus[w, i] >> bit) & one).astype(np.int64)
        score[:p] += np.where(below > 0, along, 1 - (zero[-1] >> last).astype(np.int64))
        moved = zero >> one
        moved[:-1] |= zero[1:] << last
        grow[:, :p], fall[:, :p] = minus | ~(moved | plus), moved & plus
    out = np.empty(len(a), np.int64)
    out[order] = score
    return out


def alike(a: list[str], b: list[str], most: list[int]) -> np.ndarray:
    """within() of each pair: narrow bands of all pairs together, then those of each pair's own bound."""
    out, open_ = np.zeros(len(a), bool), []
    for i, (x, y, k) in enumerate(zip(a, b, most, strict=True)):
        if abs(len(x) - len(y)) > k:
            continue
        s = _shared(x, y)
        x, y = x[s:], y[s:]
        s = _shared(x[::-1], y[::-1])
        x, y = x[:len(x) - s], y[:len(y) - s]
        if not x or not y or max(len(x), len(y)) <= k:
            out[i] = max(len(x), len(y)) <= k
        elif roughly(x, y, k):
            out[i] = True
        else:
            open_.append((len(y), i, x, y, k))
    open_.sort(key=lambda t: t[:2])
    for words in WIDTHS:
        left, now = [], []
        for t in open_:
            fits = abs(len(t[2]) - len(t[3])) < 32 * words and "\0" not in t[2] and "\0" not in t[3]
            (now if fits and (words in TRIED or t[4] < 32 * words) else left).append(t)
        at = 0
        while len(now) - at >= MANY:
            end, size = at, 0
            while end < len(now) and (end - at < MANY or size < GROUP):
                size += now[end][0] + 64 * words
                end += 1
            some = now[at:end]
            while some and size < MANY * (some[-1][0] + 64 * words):  # few much longer ones are left to their own
                left.append(some.pop())
                size -= left[-1][0] + 64 * words
            for t, d in zip(some, together([t[2] for t in some], [t[3] for t in some], words), strict=True) if some else ():
                if d <= t[4] and d < 32 * words:
                    out[t[1]] = True
                elif t[4] >= 32 * words:
                    left.append(t)
            at = end
        open_ = sorted(left + now[at:], key=lambda t: t[:2])
    for _, i, x, y, k in open_:
        out[i] = within(x, y, k)
    return out


#: What is known of a line before its text is read.
FACTS = ("sim", "chars", *(f"g{i}" for i in range(GRAM_BITS // 64)))


def facts(lines: list[str]) -> list[np.ndarray]:
    """FACTS of normalised lines."""
    _, chars, _, _, sim, _ = line_hashes("\n".join(lines).encode("utf-8", "replace"))
    return [sim.view(np.int64), chars.astype(np.int32), *grams(lines).view(np.int64).T]


def _texts(docs: DataFrame, wanted: DataFrame) -> DataFrame:
    """gid, normalised form and FACTS of the first occurrence of each wanted line (gid, rid, line_no)."""
    by_doc = wanted.groupBy("rid").agg(F.collect_list(F.struct("line_no", "gid")).alias("want"))
    names = ["gid", "line", *FACTS]

    def run(batches):
        gids, found, size = [], [], 0

        def flush():
            return pa.RecordBatch.from_arrays([pa.array(gids, pa.int64()), pa.array(found, pa.string()), *(pa.array(np.ascontiguousarray(v)) for v in facts(found))], names=names)

        for b in batches:
            for text, want in zip(b.column(0), b.column(1), strict=True):
                lines = text.as_py().split("\n")
                for w in want.as_py():
                    gids.append(w["gid"])
                    found.append(normalised(lines[w["line_no"]]))
                    size += len(found[-1]) + 50
                    if size >= CHUNK:
                        yield flush()
                        gids, found, size = [], [], 0
        if gids:
            yield flush()

    kinds = ", ".join(f"{n} {k}" for n, k in zip(names, ("long", "string", "long", "int", *["long"] * (len(FACTS) - 2)), strict=True))
    return docs.select("rid", "text").join(by_doc.hint("shuffle_hash"), "rid").select("text", "want").mapInArrow(trimmed(run), kinds)


def _similar(pairs: DataFrame, texts: DataFrame, similarity: float) -> DataFrame:
    """The pairs (a, b) of gids whose lines have the edit similarity, in characters at any length."""
    one = lambda x, y: texts.select(F.col("gid").alias(x), F.col("line").alias(y))
    most = F.floor(F.greatest(F.length("x"), F.length("y")) * F.lit(1 - similarity) + F.lit(1e-9)).cast("int")
    both = pairs.select("a", "b").join(one("a", "x"), "a").join(one("b", "y"), "b").withColumn("most", most)

    def run(batches):
        for b in batches:
            ok = pa.array(alike(*(b.column(i).to_pylist() for i in (2, 3, 4))))
            yield pa.RecordBatch.from_arrays([c.filter(ok) for c in b.columns[:2]], names=["a", "b"])

    return both.select("a", "b", "x", "y", "most").mapInArrow(trimmed(run), "a long, b long")


MET = "key long, gid long, leader long"


def _meet(batches):
    """Sorted rows (key, gid) in, every row that has the key of the one before it out, with the
    first row of its key. The first and the last key of the partition may go on in other partitions:
    their first rows come out too, as their own leaders."""
    lead, opening = None, True  # first row of the key that the last batch ended with
    for b in batches:
        if not b.num_rows:
            continue
        rows = [c.to_numpy() for c in b.columns]
        key = rows[0]
        new = np.concatenate([[lead is None or key[0] != lead[0]], key[1:] != key[:-1]])
        begin = np.maximum.accumulate(np.where(new, np.arange(len(key)), -1))
        own = begin >= 0  # the leader is in this batch
        heads = [np.where(own, r[begin], lead[i] if lead is not None else 0) for i, r in enumerate(rows)]
        out = ~new
        out[0] |= opening
        opening = False
        yield pa.RecordBatch.from_arrays([pa.array(r[out]) for r in (*rows, *heads[1:])], names=[f.split()[0] for f in MET.split(", ")])
        lead = [h[-1] for h in heads]
    if lead is not None:
        yield pa.RecordBatch.from_arrays([pa.array(np.array([v])) for v in (*lead, *lead[1:])], names=[f.split()[0] for f in MET.split(", ")])


def _turned(one: str, other: str, names=FACTS[2:]):
    """Number of bits in which two lines differ."""
    return reduce(add, (F.bit_count(F.col(f"{one}.{c}").bitwiseXOR(F.col(f"{other}.{c}"))) for c in names))


def _alike(one: str, other: str, similarity: float):
    """FACTS of two lines allow the similarity; those of character pairs and lengths are bounds, never wrong."""
    short, long_ = F.least(f"{one}.chars", f"{other}.chars"), F.greatest(f"{one}.chars", f"{other}.chars")
    return ((short >= long_ * F.lit(similarity) - F.lit(1e-9)) & ((_turned(one, other, ["sim"]) <= BITS) | (long_ <= FEW))
            & (_turned(one, other) <= 4 * F.floor(long_ * F.lit(1 - similarity) + F.lit(1e-9))))


def _release(spark: SparkSession) -> None:
    """Shuffle files of finished jobs go now; else they stay until the driver happens to collect its garbage."""
    gc.collect()
    spark.sparkContext._jvm.System.gc()


def _merged(comp: DataFrame, links: DataFrame) -> DataFrame:
    """Components after more links: only the groups that these join are gone through again."""
    c = lambda x: comp.select(F.col("node").alias(x), F.col("component").alias("c" + x))
    between = links.join(c("a"), "a", "left").join(c("b"), "b", "left").select(F.coalesce("ca", "a").alias("a"), F.coalesce("cb", "b").alias("b"))
    joined = components(between)
    alone = between.select(F.col("a").alias("node")).union(between.select("b")).distinct().join(comp, "node", "left_anti").select("node", F.col("node").alias("component"))
    new = comp.union(alone).join(joined.select(F.col("node").alias("component"), F.col("component").alias("now")), "component", "left")
    return cut(new.select("node", F.coalesce("now", "component").alias("component")), "line_groups")


def _across(comp: DataFrame, pairs: DataFrame, verified) -> DataFrame:
    """Components after the links among pairs (a, b) of lines of the groups g and h, by verified(pairs, label).

    Of each two groups the pair that differs in the fewest bits goes first, then all others whose groups are
    still apart: two lines of one group need no link."""
    if not pairs.limit(1).count():
        return comp
    first = cut(pairs.groupBy("g", "h").agg(F.min(F.struct("turned", "a", "b")).alias("p")).select("p.a", "p.b", "g", "h"), "first_pairs")
    links = verified(first, "first_links").join(first, ["a", "b"])
    joined = maybe_broadcast(components(links, "g", "h"))
    now = lambda x: joined.select(F.col("node").alias(x), F.col("component").alias("now_" + x))
    rest = pairs.join(first, ["a", "b", "g", "h"], "left_anti").join(now("g"), "g", "left").join(now("h"), "h", "left")
    rest = cut(rest.where(F.coalesce("now_g", "g") != F.coalesce("now_h", "h")).select("a", "b"), "rest_pairs")
    links = links.select("a", "b")
    return _merged(comp, links.union(verified(rest, "rest_links")) if rest.limit(1).count() else links)


def groups(docs: DataFrame, lines: DataFrame, similarity: float) -> tuple[DataFrame, DataFrame]:
    """Distinct lines (k1, k2, gid, first, n) and links (node, component) of those that have any."""
    spark = docs.sparkSession
    uniq = cut(lines.groupBy("k1", "k2").agg(F.min(F.struct("id", "rid", "line_no")).alias("first"), F.count("*").alias("n"), *[F.first(c).alias(c) for c in KEYS])
               .withColumn("gid", F.monotonically_increasing_id()), "uniq_lines")
    _release(spark)
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    # sorted by key and gid over ranges of both, so that a block of any size is spread over partitions
    dealt = uniq.select(F.explode(F.array(*KEYS)).alias("key"), "gid").repartitionByRange(parts, "key", "gid").sortWithinPartitions("key", "gid")
    met = cut(dealt.mapInArrow(trimmed(_meet), MET), "met_lines")
    _release(spark)
    # texts and facts of the lines that meet any other
    ids = met.select("gid").union(met.select("leader")).distinct()
    texts = cut(_texts(docs, uniq.select("gid", "first").join(ids, "gid").select("gid", "first.rid", "first.line_no")), "line_texts")
    _release(spark)
    known = lambda x: texts.select("gid", *FACTS).alias(x)

    def verified(pairs, label):
        ids = cut(pairs.select(F.col("a").alias("gid")).union(pairs.select("b")).distinct(), "wanted_lines")
        few = maybe_broadcast(ids)
        wanted = texts.select("gid", "line")
        if few is not ids:
            wanted = cut(wanted.join(few, "gid", "left_semi"), "wanted_texts")
        out = cut(_similar(pairs, wanted, similarity), label)
        for t in (ids, wanted) if few is not ids else (ids,):
            drop(t)
        _release(spark)
        return out

    # first round: every member of a block with the leader of its partition, these leaders with the first of them
    heads = met.where("gid = leader").groupBy("key").agg(F.min("gid").alias("a"), F.collect_set("gid").alias("h")).where("size(h) > 1")
    across = heads.select("a", F.explode("h").alias("b")).where("a <> b")
    near = met.where("gid <> leader").select(F.col("leader").alias("a"), F.col("gid").alias("b")).union(across).distinct()
    pairs = cut(near.join(known("l"), F.col("a") == F.col("l.gid")).join(known("r"), F.col("b") == F.col("r.gid")).where(_alike("l", "r", similarity)).select("a", "b"), "line_pairs")
    links = verified(pairs, "line_links")
    comp = components(links)
    # second round: blocks of several groups, every member with about LEADERS of them, drawn by hash
    open_ = met.select("key", "gid").join(comp.withColumnRenamed("node", "gid"), "gid", "left").withColumn("c", F.coalesce("component", "gid")).drop("component")
    mixed = open_.groupBy("key").agg(F.min("c").alias("lo"), F.max("c").alias("hi"), F.count("*").alias("m")).where("lo <> hi").select("key", "m")
    open_ = cut(open_.join(mixed, "key").join(known("r"), "gid"), "open_lines")
    drop(met)
    leads = open_.where(F.pmod(F.xxhash64("gid", "key"), F.col("m")) < LEADERS)
    both = leads.alias("l").join(open_.alias("r"), "key").where((F.col("l.c") != F.col("r.c")) & _alike("l", "r", similarity))
    ordered = lambda both: both.select(F.least("l.gid", "r.gid").alias("a"), F.greatest("l.gid", "r.gid").alias("b")).distinct()
    more = cut(ordered(both).join(pairs, ["a", "b"], "left_anti"), "late_pairs")
    comp = _merged(comp, verified(more, "late_links")) if more.limit(1).count() else comp
    # third round: blocks with more members than leaders that still hold several groups, in tiles; pairs of two groups one first
    open_ = open_.where(F.col("m") > LEADERS).drop("c").join(comp.withColumnRenamed("node", "gid"), "gid", "left").withColumn("c", F.coalesce("component", "gid"))
    mixed = open_.groupBy("key").agg(F.min("c").alias("lo"), F.max("c").alias("hi"), F.ceil(F.count("*") / F.lit(TILE)).cast("int").alias("tiles")).where("lo <> hi").select("key", "tiles")
    open_ = cut(open_.join(mixed, "key").withColumn("tile", F.pmod(F.xxhash64("gid"), F.col("tiles")).cast("int")).select("key", "gid", *FACTS, "c", "tiles", "tile"), "tiled_lines")
    left = open_.withColumn("j", F.explode(F.sequence("tile", F.col("tiles") - 1))).withColumnRenamed("tile", "i").alias("l")
    right = open_.withColumn("i", F.explode(F.sequence(F.lit(0), "tile"))).withColumnRenamed("tile", "j").alias("r")
    both = left.join(right, ["key", "i", "j"]).where((F.col("l.c") < F.col("r.c")) | ((F.col("i") < F.col("j")) & (F.col("l.c") != F.col("r.c"))))
    both = both.where(_alike("l", "r", similarity)).select(
        F.least("l.gid", "r.gid").alias("a"), F.greatest("l.gid", "r.gid").alias("b"),
        F.least("l.c", "r.c").alias("g"), F.greatest("l.c", "r.c").alias("h"), _turned("l", "r").alias("turned")).distinct()
    last = cut(both.join(pairs.union(more), ["a", "b"], "left_anti"), "last_pairs")
    comp = _across(comp, last, verified)
    drop(texts)
    return uniq, comp


def dedup_lines(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", similarity: float = SIMILARITY, min_words: int = MIN_WORDS) -> DataFrame:
    """All columns of docs with the text without its dropped lines, and n_lines, n_dropped, emptied.

    Lines are parted by newlines. Lines with fewer than min_words words are left alone (those without any
    always are). Of each group of equal or similar lines the occurrence with the least (id, row, line number)
    stays, null ids first. emptied: lines were dropped and no word is left. Null texts stay null, empty ones
    empty, each without dropped lines; repeated rows are rows of their own, so the second one loses its
    lines; an empty table gives no rows. Columns of docs may have any name: those called n_lines, n_dropped
    and emptied give way to the results, all others come out as they are.
    """
    own = ("n_lines", "n_dropped", "emptied", text_col)
    names = [c for c in docs.columns if c not in own]
    kept = F.struct(*[F.col(f"`{c}`") for c in names]) if names else F.struct(F.lit(None).cast("string").alias("none"))
    rows = stored(docs.select(kept.alias("kept"), F.col(f"`{text_col}`").cast("string").alias("text"), F.col(f"`{id_col}`").alias("id")))
    _release(docs.sparkSession)
    lines = cut(lines_of(rows, max(1, min_words)), "lines")
    uniq, comp = groups(rows, lines, similarity)
    named = uniq.select("k1", "k2", "gid", "first", "n").join(comp.withColumnRenamed("node", "gid"), "gid", "left").withColumn("component", F.coalesce("component", "gid"))
    stays = named.groupBy("component").agg(F.min("first").alias("stay"))
    # only groups of several occurrences lose any
    fate = cut(named.join(stays, "component").where((F.col("n") > 1) | (F.col("first") != F.col("stay")))
               .select("k1", "k2", "stay.rid", "stay.line_no").withColumnsRenamed({"rid": "stay_rid", "line_no": "stay_line"}), "fates")
    gone = (lines.select("rid", "line_no", "k1", "k2").join(fate, ["k1", "k2"])
            .where((F.col("rid") != F.col("stay_rid")) | (F.col("line_no") != F.col("stay_line")))
            .groupBy("rid").agg(F.collect_list("line_no").alias("gone")))

    def rebuild(batches):
        for b in (b.slice(at, AT_ONCE) for b in batches for at in range(0, b.num_rows, AT_ONCE)):
            texts, drops = b.column(0).to_pylist(), b.column(1).to_pylist()
            out, n_lines, n_dropped, emptied = [], [], [], []
            for t, d in zip(texts, drops, strict=True):
                n_lines.append(t.count("\n") + 1 if t is not None else 0)
                if d:
                    dead = set(d)
                    t = "\n".join([x for i, x in enumerate(t.split("\n")) if i not in dead])
                out.append(t)
                n_dropped.append(len(d) if d else 0)
                emptied.append(bool(d) and not t.lower().encode("utf-8", "replace").translate(_BLANK).strip())
            yield pa.RecordBatch.from_arrays([b.column(2), pa.array(out, pa.string()), pa.array(n_lines, pa.int32()), pa.array(n_dropped, pa.int32()),
                                              pa.array(emptied, pa.bool_())], names=["kept", "text", "n_lines", "n_dropped", "emptied"])

    schema = T.StructType([rows.schema["kept"], T.StructField("text", T.StringType()), T.StructField("n_lines", T.IntegerType()),
                           T.StructField("n_dropped", T.IntegerType()), T.StructField("emptied", T.BooleanType())])
    done = rows.join(gone.hint("shuffle_hash"), "rid", "left").select("text", "gone", "kept").mapInArrow(trimmed(rebuild), schema)
    return done.select(*[F.col("kept").getField(c).alias(c) for c in names], F.col("text").alias(text_col), "n_lines", "n_dropped", "emptied")


def op3_linededup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, text (without dropped lines), n_lines, n_dropped of every document."""
    return dedup_lines(table(spark, sf_dir, "documents").select("doc_id", "text")).select("doc_id", "text", "n_lines", "n_dropped")


QUERIES = {"op3_linededup": op3_linededup}
ORACLE: dict[str, str] = {}
