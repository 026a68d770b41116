"""Near-duplicate records with small edits: exact set-similarity join by universe partition.

A record is the set of its runs of three words. Records fall into bands of sizes; the scheme of a band hashes the
universe of runs into M segments. Two sets of Jaccard J >= 7/10 differ in at most H runs, H following from their sizes,
so if a probe allots levels to segments that add up to H + c, the levels less the differences of their segments add up
to c or more: an equal segment of level 1 gives 1, one of level 2 gives 2 if equal and 1 if it differs by one run. The
index holds every segment that is not empty and, in every DELETE-th segment, its one-deletion neighbours; a probe takes
the H + c cheapest units, where the cost of a unit is the estimated number of records it meets. Pairs that gather c are
verified on their whole sets.

c is 1 and more where a probe has more cheap units. Units dearer than a limit are neither indexed nor probed. The sketch
that tells costs grows with the data up to MOST_CELLS; where even that leaves its noise above the limit, the limit grows
and keys may be hot: those that a bounded sample of records shows to be so are split, their index rows by a salt and
their probe rows copied to every part. Records that can't reach H + 1 without dear units (few; all their runs are
frequent) go an exact way of their own: by prefixes of their rarest runs and bands of sizes, hot keys split likewise.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, Window, functions as F

from quillstone.session import materialize

#: Similarity NUM / DEN; words of a run; every how many segments have deletion neighbours.
NUM, DEN, RUN, DELETE = 7, 10, 3, 8
#: For every so many runs of H a probe may take one more unit, if it is cheap, for which a pair must gather one more.
#: Cheap is up to CHEAP and twice the noise of the sketch.
SPARE, CHEAP = 6, 1_000
#: Cells of the frequency sketch: one for FILL runs, a power of two between these; and the dearest unit, at least.
LEAST_CELLS, MOST_CELLS, FILL, DEAREST = 1 << 18, 1 << 26, 32, 20_000
#: Records whose keys are counted to find hot ones, in how many of them a key must be to be hot, and rows of a part of it.
SAMPLE, SEEN, SPLIT = 5_000, 50, 20_000
#: Bound on ids or runs that are sent to every task.
MAX_IDS = 500_000
#: Records of a class that meet those of another (or of the same) in one key of the join; larger classes are cut by hash.
PART = 1_000
#: Records whose segments are worked out at a time, which bounds a worker's memory.
BLOCK = 2_000
#: Bits of a key, at least, and bits beyond those of the number of runs; equal keys of different segments only add candidates.
KEY_BITS, KEY_ROOM = 40, 12
KEEP = 300_000

_WORD = re.compile(r"\w+")
_U = np.uint64
_P1, _P2, _P3 = _U(0x9E3779B97F4A7C15), _U(0xBF58476D1CE4E5B9), _U(0x94D049BB133111EB)


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64 bits that scatters them."""
    x = (x ^ (x >> _U(30))) * _P2
    x = (x ^ (x >> _U(27))) * _P3
    return x ^ (x >> _U(31))


def bands(largest: int) -> tuple[np.ndarray, np.ndarray]:
    """First and last size of each band up to one that holds `largest`."""
    lo, hi = [1], [1]
    while hi[-1] < largest:
        lo.append(hi[-1] + 1)
        hi.append(max(lo[-1], lo[-1] * DEN // NUM))
    return np.array(lo, np.int64), np.array(hi, np.int64)


def most_different(total: np.ndarray) -> np.ndarray:
    """The most runs in which two similar sets differ whose sizes add up to `total`."""
    need = -(-NUM * total // (NUM + DEN))
    return total - 2 * need


class Runs:
    """Sets of runs of many texts as one flat array."""

    def __init__(self) -> None:
        self.codes: dict[str, int] = {}

    def code(self, w: str) -> int:
        got = self.codes.get(w)
        if got is None:
            if len(self.codes) >= KEEP:
                self.codes.clear()
            got = self.codes[w] = xxhash.xxh3_64_intdigest(w)
        return got

    def sets(self, texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
        """(number of the text, run) of every different run, sorted."""
        code = self.code
        words = [_WORD.findall(t.lower()) if t else [] for t in texts]
        sizes = np.array([len(w) for w in words], np.int64)
        flat = np.array([code(x) for w in words for x in w], _U)
        m = len(flat) - RUN + 1
        if m <= 0:
            return np.zeros(0, np.int64), np.zeros(0, _U)
        h = np.zeros(m, _U)
        for k in range(RUN):
            h = mix(h * _P1 + flat[k : k + m])
        text = np.repeat(np.arange(len(texts)), sizes)
        last = np.repeat(np.cumsum(sizes), sizes)
        ok = np.arange(m) + RUN <= last[:m]
        text, h = text[:m][ok], h[ok]
        o = np.lexsort((h, text))
        text, h = text[o], h[o]
        new = np.ones(len(h), bool)
        new[1:] = (text[1:] != text[:-1]) | (h[1:] != h[:-1])
        return text[new], h[new]


SETS = "tbl string, row_id long, h1 long, h2 long, parity array<long>, runs array<long>"
#: Words of 64 bits of the parity sketch of a set: bits that its runs flip. Two sets differ in at least as many runs as
#: their sketches in bits.
PARITY = 4


def run_sets(df: DataFrame, tbl: str, id_col: str, text_col: str) -> DataFrame:
    """The set of runs of each text (SETS) with two hashes and the parity sketch of it; texts of fewer than three words have none."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        r = Runs()
        for b in batches:
            ids = np.array([-1 if x is None else x for x in b.column(0).to_pylist()], np.int64)
            null = np.array([x is None for x in b.column(0).to_pylist()], bool)
            text, h = r.sets(b.column(1).to_pylist())
            keep = ~null[text] if len(text) else np.zeros(0, bool)
            text, h = text[keep], h[keep]
            at, start, size = np.unique(text, return_index=True, return_counts=True)
            h1 = mix(np.add.reduceat(h, start) + size.astype(_U)) if len(at) else h
            h2 = mix(np.add.reduceat(mix(h ^ _P1), start)) if len(at) else h
            bits = np.zeros((len(at), PARITY), _U)
            bit = _U(1) << (h >> _U(8) & _U(63))
            for k in range(PARITY if len(at) else 0):
                bits[:, k] = np.bitwise_xor.reduceat(np.where(h % _U(PARITY) == k, bit, _U(0)), start)
            parity = pa.ListArray.from_arrays(pa.array(np.arange(0, bits.size + 1, PARITY, dtype=np.int32)), pa.array(bits.ravel().view(np.int64)))
            lists = pa.ListArray.from_arrays(pa.array(np.append(start, len(h)), pa.int32()), pa.array(h.view(np.int64)))
            yield pa.record_batch([pa.array([tbl] * len(at), pa.string()), pa.array(ids[at]), pa.array(h1.view(np.int64)), pa.array(h2.view(np.int64)), parity, lists], names=["tbl", "row_id", "h1", "h2", "parity", "runs"])

    return df.select(F.col(id_col).cast("long").alias("i"), F.col(text_col).alias("t")).mapInArrow(run, SETS)


def units(rec: np.ndarray, size: np.ndarray, run: np.ndarray, freq: np.ndarray, salt: np.ndarray, dearest: int, spare: float, bits: int = KEY_BITS) -> tuple[dict, dict, np.ndarray]:
    """Index rows, probe rows (key, record; weight, need) and the records that can't be probed, of records given as flat runs.

    rec: record number of each run (sorted); size: sizes by record; salt: 64 bits by record that keep tables apart.
    """
    lo, hi = bands(int(size.max(initial=1)))
    band = np.searchsorted(hi, size)
    least = -(-NUM * size // DEN)
    low = np.searchsorted(hi, least)  # the band of the smallest partner: the own or the one below
    # one instance per record and band to probe
    inst_rec = np.concatenate([np.arange(len(size)), np.nonzero(low < band)[0]])
    inst_band = np.concatenate([band, low[low < band]])
    starts = np.concatenate([[0], np.cumsum(size)])
    n = size[inst_rec]
    inst = np.repeat(np.arange(len(inst_rec)), n)
    place = np.arange(len(inst)) - np.repeat(np.cumsum(n) - n, n) + starts[inst_rec][inst]
    h = run[place]
    cost = estimate(freq, h)
    segments = hi // 2 + 4
    b = inst_band[inst]
    seg = (mix(h + b.astype(_U) * _P2 + _P3) % segments[b].astype(_U)).astype(np.int64)

    o = np.lexsort((cost, seg, inst))
    inst, h, cost, seg = inst[o], h[o], cost[o], seg[o]
    new = np.ones(len(inst), bool)
    new[1:] = (inst[1:] != inst[:-1]) | (seg[1:] != seg[:-1])
    start = np.nonzero(new)[0]
    group = np.cumsum(new) - 1  # the segment of each run
    count = np.diff(np.append(start, len(inst)))
    total = np.add.reduceat(h, start) if len(start) else h
    cheapest = cost[start]
    second = np.where(count > 1, cost[np.minimum(start + 1, len(cost) - 1)] if len(cost) else 0, 0)
    g_inst, g_seg = inst[start], seg[start]
    place_salt = mix(salt[inst_rec[g_inst]] + inst_band[g_inst].astype(_U) * _P1 + g_seg.astype(_U) * _P3)
    deletes = (g_seg % DELETE == 0) & (count > 1)

    def key(content: np.ndarray, where: np.ndarray, neighbour: bool) -> np.ndarray:
        return (mix(content ^ place_salt[where] ^ _U(neighbour)) >> _U(64 - bits)).view(np.int64)

    # deletion neighbours: content without one run; its estimate is that of the cheapest run left
    d_run = np.nonzero(deletes[group])[0]
    d_group = group[d_run]
    d_content = total[d_group] - h[d_run]
    d_cost = np.where(d_run == start[d_group], second[d_group], cheapest[d_group])

    own = g_inst < len(size)  # instances in the own band are indexed
    all_groups = np.arange(len(start))
    i1 = all_groups[own & (cheapest <= dearest)]
    i2 = own[d_group] & (d_cost <= dearest)
    index = {
        "key": np.concatenate([key(total[i1], i1, False), key(d_content[i2], d_group[i2], True)]),
        "rec": np.concatenate([inst_rec[g_inst[i1]], inst_rec[g_inst[d_group[i2]]]]),
    }

    # the cheapest H + c units of each instance
    biggest = np.minimum(hi[inst_band], n)
    smallest = np.maximum(lo[inst_band], least[inst_rec])
    differ = most_different(n + biggest)
    differ = np.where(biggest > smallest, np.maximum(differ, most_different(n + biggest - 1)), differ)
    # a level-2 unit reads the neighbours of partners and probes with its own; all must be affordable
    dear = np.maximum(second, cheapest) > dearest
    two = np.nonzero(deletes & ~dear)[0]
    u_group = np.concatenate([all_groups[cheapest <= dearest], two])
    u_level = np.concatenate([np.ones(int((cheapest <= dearest).sum()), np.int64), np.full(len(two), 2)])
    u_cost = np.concatenate([cheapest[cheapest <= dearest], (count[two] - 1) * cheapest[two] + second[two] + cheapest[two]])
    o = np.lexsort((u_group, u_level, u_cost, g_inst[u_group]))
    u_group, u_level, u_cost = u_group[o], u_level[o], u_cost[o]
    u_inst = g_inst[u_group]
    rank = np.arange(len(u_inst)) - np.searchsorted(u_inst, u_inst)
    have = np.bincount(u_inst, minlength=len(inst_rec))
    hard = np.unique(inst_rec[have < differ + 1])
    cheap = np.bincount(u_inst, weights=u_cost <= spare, minlength=len(inst_rec)).astype(np.int64)
    need = np.clip(np.minimum(1 + differ // SPARE, cheap - differ), 1, 100)  # one is always taken
    take = rank < (differ + need)[u_inst]
    p1 = u_group[take & (u_level == 1)]
    p2 = np.zeros(len(start), bool)
    p2[u_group[take & (u_level == 2)]] = True
    p2_groups, p2_runs = np.nonzero(p2)[0], np.nonzero(p2[d_group])[0]
    groups = np.concatenate([p1, p2_groups, d_group[p2_runs]])
    probe = {
        "key": np.concatenate([key(total[p1], p1, False), key(total[p2_groups], p2_groups, True), key(d_content[p2_runs], d_group[p2_runs], False)]),
        "rec": inst_rec[g_inst[groups]],
        "weight": np.concatenate([1 + p2[p1], np.ones(len(groups) - len(p1), np.int64)]),  # an equal segment of level 2 gives 2
        "need": need[g_inst[groups]],
    }
    return index, probe, hard


def _salts(tables: list[str]) -> np.ndarray:
    return np.array([xxhash.xxh3_64_intdigest(t) for t in tables], _U)


def estimate(freq: np.ndarray, runs: np.ndarray) -> np.ndarray:
    """Upper estimates of in how many sets each run occurs, from the sketch."""
    return _SCALE[freq[(runs & _U(len(freq) - 1)).astype(np.int64)]]


#: Counts of the sketch by their codes of one byte: exact up to 32, then in steps of about 10 %, always rounded up.
_SCALE = np.unique(np.concatenate([np.arange(33), np.ceil(32 * 1.1025 ** np.arange(1, 400))]))[:256].astype(np.int64)
SIGNATURES = "key long, cls long, meta long"
INDEX, PROBE, HARD = 0, 1, 2


def signatures(classes: DataFrame, freq: np.ndarray, dearest: int, spare: float, bits: int = KEY_BITS) -> DataFrame:
    """SIGNATURES: meta packs size, need (7 bits), weight (2 bits) and kind (2 bits).

    The kind is INDEX, PROBE or HARD (a record to go the exact way).
    """
    sent = classes.sparkSession.sparkContext.broadcast(freq)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        freq = sent.value
        for b in batches:
            for at in range(0, b.num_rows, BLOCK):
                part = b.slice(at, BLOCK)
                ids = np.array(part.column("cls").to_numpy(zero_copy_only=False), np.int64)
                ids, once = np.unique(ids, return_index=True)
                part = part.take(pa.array(once))
                lists = part.column("runs")
                flat = np.array(lists.flatten().to_numpy(zero_copy_only=False), np.int64).view(_U)
                size = np.array(lists.value_lengths().to_numpy(zero_copy_only=False), np.int64)
                if not len(ids):
                    continue
                index, probe, hard = units(np.repeat(np.arange(len(ids)), size), size, flat, freq, _salts(part.column("tbl").to_pylist()), dearest, spare, bits)
                own = -1 - (mix(ids[hard].view(_U)) >> _U(64 - bits)).view(np.int64)  # a key of its own keeps hard records spread
                for key, rec, low in ((index["key"], index["rec"], np.full(len(index["rec"]), INDEX)), (probe["key"], probe["rec"], probe["need"] << 4 | probe["weight"] << 2 | PROBE), (own, hard, np.full(len(hard), HARD))):
                    meta = size[rec] << 11 | low
                    for i in range(0, len(rec), 200_000):
                        yield pa.record_batch([pa.array(x[i : i + 200_000]) for x in (key, ids[rec], meta)], names=["key", "cls", "meta"])

    return classes.select("tbl", "cls", "runs").mapInArrow(run, SIGNATURES)


def _gather(a: np.ndarray, b: np.ndarray, weight: np.ndarray, need: np.ndarray) -> list[np.ndarray]:
    """Weights summed by pair."""
    if not len(a):
        return [a, b, weight, need]
    o = np.lexsort((b, a))
    a, b, weight, need = a[o], b[o], weight[o], need[o]
    new = np.ones(len(a), bool)
    new[1:] = (a[1:] != a[:-1]) | (b[1:] != b[:-1])
    at = np.nonzero(new)[0]
    return [a[at], b[at], np.add.reduceat(weight, at), need[at]]


def _meet(key: np.ndarray, cls: np.ndarray, meta: np.ndarray) -> list[np.ndarray]:
    """(a, b, weight, need): records whose rows share a key, one of them probing a smaller or equal one; hard ones as (cls, cls)."""
    o = np.lexsort((meta, cls, key))
    key, cls, meta = key[o], cls[o], meta[o]
    new = np.ones(len(key), bool)  # rows of a record that was delivered again
    new[1:] = (key[1:] != key[:-1]) | (cls[1:] != cls[:-1]) | (meta[1:] != meta[:-1])
    key, cls, meta = key[new], cls[new], meta[new]
    kind, size = meta & 3, meta >> 11
    hard = cls[kind == HARD]
    one = np.ones(len(hard), np.int64)
    parts = [[hard, hard, one, one]]
    p, i = np.nonzero(kind == PROBE)[0], np.nonzero(kind == INDEX)[0]
    keys = key[i]  # sorted, as all are
    first, last = np.searchsorted(keys, key[p], "left"), np.searchsorted(keys, key[p], "right")
    n = last - first
    edge = np.concatenate([[0], np.cumsum(n)])
    at = 0
    while at < len(p):  # in steps of a few million pairs
        to = max(at + 1, int(np.searchsorted(edge, edge[at] + 2_000_000, "right")) - 1)
        m = n[at:to]
        r = np.repeat(p[at:to], m)
        s = i[np.repeat(first[at:to], m) + np.arange(int(m.sum())) - np.repeat(edge[at:to] - edge[at], m)]
        ok = (size[s] * DEN >= size[r] * NUM) & ((size[s] < size[r]) | (size[s] == size[r]) & (cls[s] < cls[r]))
        r, s = r[ok], s[ok]
        parts.append(_gather(np.minimum(cls[r], cls[s]), np.maximum(cls[r], cls[s]), meta[r] >> 2 & 3, meta[r] >> 4 & 127))
        at = to
    return [np.concatenate(x) for x in zip(*parts)]


def meetings(sig: DataFrame) -> DataFrame:
    """(a, b, weight, need): what meets in some key, summed per batch; (a, a) for a hard record.

    One shuffle by key: what shares one lies in one task, in rows that the limit of cost or the split of hot keys bounds.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rest: list[list[np.ndarray]] = []  # pieces that end in one key

        def out(pieces):
            cols = [np.concatenate(x) for x in zip(*pieces)]
            return pa.record_batch([pa.array(x) for x in _meet(*cols)], names=["a", "b", "weight", "need"])

        for b in batches:
            cols = [b.column(k).to_numpy(zero_copy_only=False) for k in range(3)]
            if not len(cols[0]):
                continue
            cut = int(np.searchsorted(cols[0], cols[0][-1], "left"))  # the last key may go on
            if cut or rest and rest[-1][0][-1] != cols[0][0]:
                yield out([*rest, [x[:cut] for x in cols]])
                rest = []
            rest.append([x[cut:] for x in cols])
        if rest:
            yield out(rest)

    return sig.repartition("key").sortWithinPartitions("key").mapInArrow(run, "a long, b long, weight long, need long")


def hot_keys(classes: DataFrame, n: int, sign) -> DataFrame | None:
    """(key, parts) of the keys that too many records share, by a sample of the `n` records; none if null.

    Which keys are found decides how the work is cut, not what meets. At most SAMPLE * (rows a record) / SEEN keys.
    """
    if n * SEEN <= SAMPLE * SPLIT:
        return None  # a key in a SEEN-th of so few records holds no more than a part may
    share = min(1.0, SAMPLE / n)
    some = classes.filter(F.pmod(F.xxhash64("cls"), F.lit(1_000_000)) < F.lit(max(1, round(1_000_000 * share))))
    seen = sign(some).filter("key >= 0").groupBy("key").agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") >= SEEN)
    parts = F.ceil(F.col("n") / F.lit(share * SPLIT)).cast("int")
    return materialize(seen.select("key", parts.alias("parts")).filter("parts > 1"), "p6k")


def split_keys(sig: DataFrame, hot: DataFrame | None, bits: int = KEY_BITS) -> DataFrame:
    """`sig` with hot keys split into keys of their parts: index rows go to one part by hash, probe rows to every part."""
    if hot is None:
        return sig
    kind = F.col("meta").bitwiseAND(F.lit(3))
    x = sig.join(_small(hot, MAX_IDS), "key", "left").withColumn("parts", F.coalesce("parts", F.lit(1)))
    mine = F.pmod(F.xxhash64("cls"), F.col("parts")).cast("int")
    where = F.when(kind == PROBE, F.sequence(F.lit(0), F.col("parts") - 1)).otherwise(F.array(mine))
    x = x.select("key", "cls", "meta", F.explode(where).alias("part"))
    return x.select(F.when(F.col("part") > 0, F.shiftrightunsigned(F.xxhash64("key", "part"), 64 - bits)).otherwise(F.col("key")).alias("key"), "cls", "meta")


def candidates(sig: DataFrame) -> DataFrame:
    """(a, b): pairs that gather what they need over all keys; (a, a) for a hard record."""
    return meetings(sig).groupBy("a", "b").agg(F.sum("weight").alias("weight"), F.max("need").alias("need")).filter("weight >= need").select("a", "b")


def frequencies(classes: DataFrame, cells: int = LEAST_CELLS) -> np.ndarray:
    """A sketch of in how many sets a run occurs: counts by cell of all runs of all sets, in codes of one byte (_SCALE).

    The driver gets one byte a cell, in blocks of 65,536.
    """

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            blocks = []
            for cell, n in zip(b.column(1), b.column(2)):
                block = np.zeros(1 << 16, np.uint8)
                block[np.asarray(cell.values)] = np.minimum(np.searchsorted(_SCALE, np.asarray(n.values)), 255)
                blocks.append(block.tobytes())
            yield pa.record_batch([b.column(0), pa.array(blocks, pa.binary())], names=["block", "codes"])

    cell = F.col("run").bitwiseAND(F.lit(cells - 1)).cast("int")
    counted = classes.select(F.explode("runs").alias("run")).groupBy(cell.alias("c")).agg(F.count(F.lit(1)).alias("n"))
    place = F.struct(F.col("c").bitwiseAND(F.lit(0xFFFF)).alias("c"), F.col("n"))
    blocks = counted.groupBy(F.shiftright("c", 16).alias("block")).agg(F.collect_list(place).alias("x")).select("block", F.col("x.c").alias("cell"), F.col("x.n").alias("n"))
    out = np.zeros(cells, np.uint8)
    for r in blocks.mapInArrow(pack, "block int, codes binary").collect():
        out[r.block << 16 : (r.block + 1) << 16] = np.frombuffer(r.codes, np.uint8)
    return out


def classes_of(sets: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(classes: tbl, cls, h1, h2, parity, runs) of different sets, cls being the smallest row_id, and (members: tbl, cls, row_id).

    Only hashes are shuffled to find the classes. Records that are not the first of theirs are then left out of a second
    pass, which writes the sets; they are sent to every task while they are few, and else joined. A record that was
    delivered again comes twice in classes; what follows takes it as one.
    """
    w = Window.partitionBy("tbl", "h1", "h2")
    ids = sets.select("tbl", "row_id", "h1", "h2").repartition("tbl", "h1", "h2").dropDuplicates(["tbl", "h1", "h2", "row_id"])
    members = materialize(ids.select("tbl", F.min("row_id").over(w).alias("cls"), "row_id"), "p6m")
    later = members.filter("cls < row_id").select("tbl", "row_id")
    firsts = sets.join(_small(later, MAX_IDS), ["tbl", "row_id"], "left_anti").withColumnRenamed("row_id", "cls")
    return firsts, members


def similar_classes(classes: DataFrame, dearest: int | None = None) -> DataFrame:
    """(tbl, a, b): classes a < b with similar sets; classes: tbl, cls (unique over all tables), parity, runs."""
    n, runs = classes.agg(F.count(F.lit(1)), F.coalesce(F.sum(F.size("runs")), F.lit(0))).first()
    cells = min(MOST_CELLS, max(LEAST_CELLS, 1 << (int(runs) // FILL).bit_length()))
    freq = frequencies(classes, cells)
    mean = runs / cells
    limit = dearest if dearest is not None else int(max(DEAREST, 8 * mean))
    bits = min(62, max(KEY_BITS, int(runs).bit_length() + KEY_ROOM))
    sign = lambda c: signatures(c, freq, limit, CHEAP + 2 * mean, bits)
    met = materialize(candidates(split_keys(sign(classes), hot_keys(classes, n, sign), bits)), "p6")
    pairs = met.filter("a < b")
    hard = met.filter("a = b").select(F.col("a").alias("cls"))
    if not hard.isEmpty():
        pairs = pairs.unionByName(_hard_pairs(classes, _small(hard, MAX_IDS), freq)).distinct()
    # first by size and parity sketch, which move in little space, then exactly
    side = lambda c: classes.select(F.col("cls").alias(c), F.col("tbl").alias(f"t{c}"), F.size("runs").alias(f"n{c}"), F.col("parity").alias(f"p{c}")).dropDuplicates([c]).hint("shuffle_hash")
    total = F.col("na") + F.col("nb")
    differ = total - 2 * F.ceil(total * NUM / F.lit(NUM + DEN))
    bits = sum((F.bit_count(F.col("pa")[k].bitwiseXOR(F.col("pb")[k])) for k in range(PARITY)), F.lit(0))
    close = pairs.join(side("a"), "a").join(side("b"), "b").filter((F.col("ta") == F.col("tb")) & (bits <= differ)).select("a", "b")
    close = materialize(close, "p6c")
    wanted = _small(close.select(F.col("a").alias("cls")).union(close.select("b")).distinct(), MAX_IDS)
    whole = lambda c, x: classes.join(wanted, "cls", "left_semi").select("tbl", F.col("cls").alias(c), F.col("runs").alias(x)).dropDuplicates([c]).hint("shuffle_hash")
    both = F.size(F.array_intersect("x", "y"))
    found = close.join(whole("a", "x"), "a").join(whole("b", "y").drop("tbl"), "b").filter(both * (NUM + DEN) >= (F.size("x") + F.size("y")) * NUM)
    return found.select("tbl", "a", "b")


def _small(df: DataFrame, most: int) -> DataFrame:
    """`df`, broadcast if it has at most `most` rows."""
    return F.broadcast(df) if df.limit(most + 1).count() <= most else df



def _hard_pairs(classes: DataFrame, hard: DataFrame, freq: np.ndarray) -> DataFrame:
    """Candidates of hard records: partners of a size within reach whose rarest runs have one in common with theirs.

    Runs are in one order, rare ones first; two similar sets share a run among the first |x| - 0.7 |x| + 1 of either.
    The join is by run and band of sizes; a key with more than SPLIT rows is cut into parts, to each of which the rows of
    the hard records are copied.
    """
    sent = classes.sparkSession.sparkContext.broadcast(freq)

    def rare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            keep, who, tbl, sizes = [], [], [], []
            for t, c, x in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), b.column(2).to_pylist()):
                h = np.array(x, np.int64)
                first = h[np.lexsort((h, estimate(sent.value, h.view(_U))))][: len(h) - -(-NUM * len(h) // DEN) + 1]
                keep.append(first)
                who += [c] * len(first)
                tbl += [t] * len(first)
                sizes += [len(h)] * len(first)
            runs = np.concatenate(keep) if keep else np.zeros(0, np.int64)
            yield pa.record_batch([pa.array(tbl, pa.string()), pa.array(who, pa.int64()), pa.array(sizes, pa.int64()), pa.array(runs)], names=["tbl", "c", "size", "run"])

    def prefixes(df: DataFrame) -> DataFrame:
        return df.select("tbl", "cls", "runs").mapInArrow(rare, "tbl string, c long, size long, run long")

    band = F.floor(F.log("size") / F.lit(np.log(DEN / NUM)))  # sizes within reach lie in the same band or the next
    mine = prefixes(classes.join(hard, "cls", "left_semi")).withColumn("band", F.explode(F.array(band - 1, band, band + 1)))
    mine = materialize(mine, "p6h")
    few = mine.select("tbl", "run", "band").distinct()
    theirs = materialize(prefixes(classes).withColumn("band", band).join(_small(few, MAX_IDS), ["tbl", "run", "band"], "left_semi"), "p6i")
    parts = theirs.groupBy("tbl", "run", "band").agg(F.ceil(F.count(F.lit(1)) / F.lit(SPLIT)).cast("int").alias("parts")).filter("parts > 1")
    parts = _small(materialize(parts, "p6j"), MAX_IDS)
    n = F.coalesce("parts", F.lit(1))
    key = ["tbl", "run", "band"]
    left = mine.join(parts, key, "left").select(*key, F.col("c").alias("r"), F.col("size").alias("m"), F.explode(F.sequence(F.lit(0), n - 1)).alias("part"))
    right = theirs.join(parts, key, "left").select(*key, F.col("c").alias("s"), "size", F.pmod(F.xxhash64("c"), n).cast("int").alias("part"))
    reach = (F.least("m", "size") * DEN >= F.greatest("m", "size") * NUM) & (F.col("r") != F.col("s"))
    return left.join(right, [*key, "part"]).filter(reach).select(F.least("r", "s").alias("a"), F.greatest("r", "s").alias("b")).distinct()


def near_duplicates(parts: list[DataFrame], dearest: int | None = None) -> tuple[DataFrame, DataFrame]:
    """(links: tbl, a, b between classes of equal sets) and (members: tbl, cls, row_id) over the run_sets in `parts`.

    Rows with a null id take no part; null, blank and short texts have no runs and are no case. Re-delivered rows count
    once. Empty input: empty results.
    """
    sets = parts[0]
    for p in parts[1:]:
        sets = sets.unionByName(p)
    firsts, members = classes_of(sets)
    firsts = materialize(firsts, "p6")
    # one id over all tables: small numbers where they fit, else numbers given in order of (tbl, cls)
    tables = [r.tbl for r in firsts.select("tbl").distinct().orderBy("tbl").collect()]  # as many as there are parts
    least, most = firsts.agg(F.min("cls"), F.max("cls")).first()
    if -(1 << 62) // max(1, len(tables)) < (least or 0) and (most or 0) < (1 << 62) // max(1, len(tables)):
        number = F.coalesce(*[F.when(F.col("tbl") == t, F.lit(k)) for k, t in enumerate(tables)], F.lit(0))
        links = similar_classes(firsts.select("tbl", (F.col("cls") * len(tables) + number).cast("long").alias("cls"), "parity", "runs"), dearest)
        back = lambda c: F.expr(f"({c} - pmod({c}, {len(tables)})) div {len(tables)}")
        links = links.select("tbl", back("a").alias("ca"), back("b").alias("cb"))
    else:
        names = materialize(firsts.select("tbl", "cls").distinct().withColumn("x", F.monotonically_increasing_id()), "p6x")
        links = similar_classes(firsts.join(names, ["tbl", "cls"]).select("tbl", F.col("x").alias("cls"), "parity", "runs"), dearest)
        side = lambda c, to: names.select("tbl", F.col("x").alias(c), F.col("cls").alias(to))
        links = links.join(side("a", "ca"), ["tbl", "a"]).join(side("b", "cb"), ["tbl", "b"])
    return links.select("tbl", F.least("ca", "cb").alias("a"), F.greatest("ca", "cb").alias("b")), members


def pairs_of(links: DataFrame, members: DataFrame) -> DataFrame:
    """(tbl, row_a, row_b), row_a < row_b: links between records, all of them.

    A class is linked to itself. Classes of more than PART records are cut into parts by hash, so that no key of the
    join holds more than about PART of them; each pair of parts is a key. The result grows with the pairs that there are.
    """
    sizes = members.groupBy("tbl", "cls").agg(F.count(F.lit(1)).alias("n"))
    big = _small(materialize(sizes.filter(F.col("n") > PART).select("tbl", "cls", F.ceil(F.col("n") / PART).cast("int").alias("parts")), "p6n"), MAX_IDS)
    cut = members.join(big, ["tbl", "cls"], "left").select("tbl", "cls", "row_id", F.coalesce(F.pmod(F.xxhash64("row_id"), "parts"), F.lit(0)).cast("int").alias("part"))
    parts_of = lambda c: F.explode(F.sequence(F.lit(0), F.coalesce(F.col(f"parts_{c}"), F.lit(1)) - 1)).alias(f"part_{c}")
    side = lambda c: big.select("tbl", F.col("cls").alias(c), F.col("parts").alias(f"parts_{c}"))
    all_ = links.select("tbl", "a", "b").unionByName(sizes.filter("n > 1").select("tbl", F.col("cls").alias("a"), F.col("cls").alias("b")))
    keys = all_.join(side("a"), ["tbl", "a"], "left").join(side("b"), ["tbl", "b"], "left").select("tbl", "a", "b", "parts_b", parts_of("a")).select("tbl", "a", "b", "part_a", parts_of("b"))
    x = lambda c: cut.select("tbl", F.col("cls").alias(c), F.col("part").alias(f"part_{c}"), F.col("row_id").alias(f"r{c}"))
    met = keys.join(x("a"), ["tbl", "a", "part_a"]).join(x("b"), ["tbl", "b", "part_b"]).filter((F.col("a") != F.col("b")) | (F.col("ra") < F.col("rb")))
    return met.select("tbl", F.least("ra", "rb").alias("row_a"), F.greatest("ra", "rb").alias("row_b"))


def groups_of(links: DataFrame, members: DataFrame) -> DataFrame:
    """(tbl, row_id, cls, group_id, n_links) of every record that has a copy or a link.

    group_id is the smallest record of the connected component, n_links the number of classes that the record's class
    is linked to. Labels spread by rounds of minimum and pointer jumping; each round is written to the shared folder.
    """
    both = materialize(links.select("tbl", F.col("a").alias("x"), F.col("b").alias("y")).unionByName(links.select("tbl", F.col("b").alias("x"), F.col("a").alias("y"))), "p6e")
    label = both.groupBy("tbl", "x").agg(F.min("y").alias("m"), F.count(F.lit(1)).alias("n_links")).select("tbl", "x", F.least("x", "m").alias("g"), "n_links")
    while True:
        label = materialize(label, "p6g")
        near = both.join(label.select("tbl", F.col("x").alias("y"), "g"), ["tbl", "y"]).groupBy("tbl", "x").agg(F.min("g").alias("near"))
        far = label.select("tbl", F.col("x").alias("g"), F.col("g").alias("far"))
        now = label.join(near, ["tbl", "x"]).join(far, ["tbl", "g"]).select("tbl", "x", F.least("g", "near", "far").alias("now"), "g", "n_links")
        now = materialize(now, "p6g")
        if now.filter("now < g").isEmpty():
            break
        label = now.select("tbl", "x", F.col("now").alias("g"), "n_links")
    n = Window.partitionBy("tbl", "cls")
    all_ = members.withColumn("n", F.count(F.lit(1)).over(n)).join(label.select("tbl", F.col("x").alias("cls"), "g", "n_links"), ["tbl", "cls"], "left")
    return all_.filter((F.col("n") > 1) | F.col("g").isNotNull()).select("tbl", "row_id", "cls", F.coalesce("g", "cls").alias("group_id"), F.coalesce("n_links", F.lit(0)).alias("n_links"))
