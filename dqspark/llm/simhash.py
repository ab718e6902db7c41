"""SimHash fingerprints and their near links through a Gray-order hierarchical index.

Two fingerprints that differ in at most d bits agree on one of d + 1 bit segments. The values of
the segments are the top nodes of the index: shared masked bit patterns, each with the
fingerprints below it. Inside a node, fingerprints are sorted by Gray rank, so that neighbours
share most bits; runs of 64 form leaves and runs of 64 leaves inner nodes, each with the mask and
value of the bits that all its members share. Differences of two nodes on the bits that both have
decided add up on the way down, and a pair of nodes is dropped as soon as they exceed d.

Only distinct fingerprints are indexed, and a node of more than ``SMALL`` reports a spanning forest of its
links, at most one edge for each of its fingerprints, so a large group of copies makes no pairs. A node
with more than ``NODE_ROWS`` fingerprints is cut into runs by Gray rank; its work is one unit per
pair of runs whose shared bits allow a link. Nothing is dropped at any size.

Copies at a Jaccard similarity of 0.8 differ in about ten of 64 bits, a radius at which segments of a
print select nothing and no print is exact. ``similar_groups`` therefore compares the sets of shingles
themselves, where their first shingles in a common order meet (prefix filtering with positions, sizes and
parity bitmaps).
"""

from __future__ import annotations

from fractions import Fraction
from itertools import accumulate

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, functions as F

from dqspark.llm.common import longs, map_batches, small_batches, texts
from dqspark.llm.components import components
from dqspark.session import materialize

SHINGLE = 4
BITS = 4
SEED = 42
NODE_ROWS = 65_536
LEAF = 64
#: Members of a node up to which all its links are reported; rows after which whole nodes are solved.
SMALL = 32
_HELD = 16_384
_CHUNK = 1 << 15
#: Words of 64 bits of a wide print, and what near copies share: shingles of five words.
WORDS = 8
WIDE_SHINGLE = 5
SIMILARITY = 0.8
#: Words of the parity bitmap, which tells sets of up to some 4,600 shingles apart.
ODD_WORDS = 32
#: Bands of each of two rounds, which choose the sets a set is compared with first; shingles that are put last
#: in the order, as the commonest; shingles counted at once.
FEW = 8
COMMON = 1 << 18
_BLOCK = 1 << 21
_BANDS, _ODD = [f"band{i}" for i in range(2 * FEW)], [f"odd{i}" for i in range(ODD_WORDS)]
_MIX = np.arange(1, 2 * FEW + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C16) + np.uint64(1)
_TOP = np.uint64(2**64 - 1)
_BYTES = np.arange(8 * WORDS, dtype=np.intp) * 256
_BITS_OF = np.unpackbits(np.arange(256, dtype=np.uint8)[:, None], axis=1, bitorder="little").astype(np.int64)


def shingle_hashes(text: str, words: int = SHINGLE) -> np.ndarray:
    """XXH64 of every word shingle of a text, repeats included."""
    found = text.encode().lower().split()  # bytes: A-Z and ASCII white space only
    if not found:
        return np.empty(0, np.uint64)
    line, digest = b" ".join(found), xxhash.xxh64_intdigest
    if len(found) <= words:
        return np.array([digest(line, SEED)], np.uint64)
    ends = list(accumulate(len(w) + 1 for w in found))
    starts = [0, *ends]
    return np.array([digest(line[a:b - 1], SEED) for a, b in zip(starts, ends[words - 1:])],
                    np.uint64)


def fingerprint(hashes: np.ndarray) -> int:
    """Bit i is set where over half of the hashes have it; zero for no hash."""
    ones = np.zeros(64, np.int64)
    for i in range(0, len(hashes), _CHUNK):
        bits = np.unpackbits(hashes[i:i + _CHUNK].view(np.uint8)).reshape(-1, 64)
        ones += bits.sum(0, dtype=np.int64)
    return int(np.packbits(2 * ones > len(hashes)).view(np.uint64)[0])


def wide_print(hashes: np.ndarray) -> np.ndarray:
    """Fingerprint of ``WORDS`` times 64 bits of the distinct hashes, each widened by a mixing function."""
    x = np.unique(hashes)
    ones = np.zeros((64 * WORDS,), np.int64)
    for i in range(0, len(x), _CHUNK):
        # every word of the print has its own mix of the hash
        z = x[i:i + _CHUNK, None] + np.arange(WORDS, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)
        z = (z ^ (z >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        z = (z ^ (z >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
        z ^= z >> np.uint64(31)
        at = z.view(np.uint8).astype(np.intp) + _BYTES
        ones += (np.bincount(at.ravel(), minlength=256 * 8 * WORDS).reshape(-1, 256) @ _BITS_OF).ravel()
    return np.packbits(2 * ones > len(x), bitorder="little").view(np.uint64)


def signatures(docs: DataFrame, words: int = SHINGLE) -> DataFrame:
    """``(doc_id, fp, other)`` of every row, fp as a signed long; null and empty texts have zero.
    ``other`` tells texts without doc_id apart and is 0 for all others."""
    def make():
        def work(batch):
            fps = np.array([fingerprint(shingle_hashes(t, words)) for t in texts(batch)], np.uint64)
            return {"doc_id": batch.column("doc_id"), "fp": longs(fps.view(np.int64)),
                    "other": batch.column("other")}
        return work
    return map_batches(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text",
                                   _other().alias("other")), make, "doc_id long, fp long, other long")


def _other():
    return F.when(F.col("doc_id").isNull(), F.xxhash64("text")).otherwise(0).cast("long")


def gray_rank(x: np.ndarray) -> np.ndarray:
    """Place of each code word in the reflected Gray sequence."""
    x = x.copy()
    for shift in (1, 2, 4, 8, 16, 32):
        x ^= x >> np.uint64(shift)
    return x


def _nodes(value_and: np.ndarray, value_or: np.ndarray, size: int):
    """And / or of every run of ``size`` entries."""
    at = np.arange(0, len(value_and), size)
    return np.bitwise_and.reduceat(value_and, at), np.bitwise_or.reduceat(value_or, at)


def forest(fps: np.ndarray, bits: int = BITS) -> tuple[np.ndarray, np.ndarray]:
    """Edges of a spanning forest of all links among the fingerprints of one index node."""
    x = np.unique(fps)
    x = x[np.argsort(gray_rank(x), kind="stable")]
    n, out_a, out_b = len(x), [], []
    comp = np.arange(n)
    starts = np.arange(0, n, LEAF)
    low, high = _nodes(x, x, LEAF)
    mask = ~(low ^ high)
    up_low, up_high = _nodes(low, high, LEAF)
    up_mask = ~(up_low ^ up_high)
    least, most = np.minimum.reduceat(comp, starts), np.maximum.reduceat(comp, starts)
    for a, lo in enumerate(starts):
        hi = min(n, lo + LEAF)
        up = np.nonzero(np.bitwise_count((up_low ^ low[a]) & up_mask & mask[a]) <= bits)[0]
        leaf = (up[:, None] * LEAF + np.arange(LEAF)).ravel()
        leaf = leaf[(leaf >= a) & (leaf < len(starts))]
        leaf = leaf[np.bitwise_count((low[leaf] ^ low[a]) & mask[leaf] & mask[a]) <= bits]
        if least[a] == most[a]:
            leaf = leaf[(least[leaf] != least[a]) | (most[leaf] != least[a])]
        changed = False
        for part in range(0, len(leaf), 256):
            some = leaf[part:part + 256]
            j = (starts[some][:, None] + np.arange(LEAF)).ravel()
            j = j[j < n]
            near = np.bitwise_count(x[lo:hi, None] ^ x[None, j]) <= bits
            near &= comp[lo:hi, None] != comp[None, j]
            for r in np.nonzero(near.any(1))[0]:
                own, others = comp[lo + r], j[near[r]]
                others = others[comp[others] != own]
                if not len(others):
                    continue
                joined, pick = np.unique(comp[others], return_index=True)
                out_a.append(np.full(len(pick), x[lo + r]))
                out_b.append(x[others[pick]])
                comp[np.isin(comp, np.append(joined, own))] = min(own, joined[0])
                changed = True
        if changed:
            least, most = np.minimum.reduceat(comp, starts), np.maximum.reduceat(comp, starts)
    none = np.empty(0, np.uint64)
    return (np.concatenate(out_a), np.concatenate(out_b)) if out_a else (none, none)


def _segments(bits: int) -> list[tuple[int, int]]:
    """(shift, width) of bits + 1 segments of 64 bits."""
    cuts = [64 * i // (bits + 1) for i in range(bits + 2)]
    return [(a, b - a) for a, b in zip(cuts, cuts[1:])]


def _runs(keyed: DataFrame, full: DataFrame, bits: int, node_rows: int) -> DataFrame:
    """Units of the nodes that are too large: one for each pair of runs that may hold a link."""
    hot = keyed.join(full.select("seg", "val"), ["seg", "val"])
    x = F.col("fp")
    for shift in (1, 2, 4, 8, 16, 32):
        x = x.bitwiseXOR(F.shiftrightunsigned(x, shift))
    runs = -(-full.agg(F.sum("n")).first()[0] // node_rows)
    # signed order of the rank with its top bit turned is unsigned order
    hot = hot.withColumn("rank", x.bitwiseXOR(F.lit(-(1 << 63))))
    hot = hot.repartitionByRange(int(runs), "seg", "val", "rank").withColumn(
        "run", F.spark_partition_id())
    hot = materialize(hot.drop("rank"), "runs")
    nodes = hot.groupBy("seg", "val", "run").agg(
        F.bit_and("fp").alias("low"), F.bit_or("fp").alias("high"))
    a, b = nodes.alias("a"), nodes.alias("b")
    apart = F.expr("bit_count((a.low ^ b.low) & ~(a.low ^ a.high) & ~(b.low ^ b.high))")
    pairs = a.join(b, [F.col("a.seg") == F.col("b.seg"), F.col("a.val") == F.col("b.val"),
                       F.col("a.run") <= F.col("b.run"), apart <= bits])
    pairs = pairs.select("a.seg", "a.val", F.col("a.run").alias("run_a"), F.col("b.run").alias("run_b"))
    each = pairs.withColumn("run", F.explode(F.array_distinct(F.array("run_a", "run_b"))))
    return hot.join(each, ["seg", "val", "run"]).select(
        "seg", "val", "run_a", "run_b", "fp")


def _segment_values(bits: int) -> list[Column]:
    return [F.shiftrightunsigned("fp", s).bitwiseAND(F.lit((1 << w) - 1)) for s, w in _segments(bits)]


def near_links(fps: DataFrame, bits: int = BITS, node_rows: int = NODE_ROWS) -> DataFrame:
    """Edges ``(a, b)`` that connect what links of at most ``bits`` differing bits connect.

    ``fps`` holds distinct fingerprints in column ``fp``. The top nodes are those of bits + 1 segments.
    """
    small_batches(fps.sparkSession)
    tops = [F.struct(F.lit(i).alias("seg"), v.alias("val")) for i, v in enumerate(_segment_values(bits))]
    keyed = fps.select("fp", F.explode(F.array(*tops)).alias("k")).select("k.seg", "k.val", "fp")
    counts = keyed.groupBy("seg", "val").agg(F.count("*").alias("n"))
    full = materialize(counts.filter(F.col("n") > node_rows), "full")
    units = keyed.select("seg", "val", F.lit(0).alias("run_a"), F.lit(0).alias("run_b"), "fp")
    if not full.isEmpty():
        units = units.join(full, ["seg", "val"], "left_anti").unionByName(
            _runs(keyed, full, bits, node_rows))
    key = ["seg", "val", "run_a", "run_b"]
    units = units.repartition(*key).sortWithinPartitions(*key)

    def settle(keys: np.ndarray, fps: np.ndarray) -> pa.RecordBatch:
        """Edges of whole units that follow one another; all links of a small one, a forest of others."""
        cuts = np.append(np.nonzero((keys[:, 1:] != keys[:, :-1]).any(0))[0] + 1, len(fps))
        starts = np.concatenate([[0], cuts[:-1]])
        sizes = cuts - starts
        unit = np.repeat(np.arange(len(sizes)), sizes)
        small = (sizes <= SMALL)[unit]
        out_a, out_b = [], []
        for d in range(1, int(sizes[sizes <= SMALL].max(initial=1))):
            at = np.nonzero(small[:-d] & (unit[:-d] == unit[d:]))[0]
            at = at[np.bitwise_count(fps[at] ^ fps[at + d]) <= bits]
            out_a.append(fps[at])
            out_b.append(fps[at + d])
        for i in np.nonzero(sizes > SMALL)[0]:
            a, b = forest(fps[starts[i]:cuts[i]], bits)
            out_a.append(a)
            out_b.append(b)
        a, b = (np.concatenate(x or [np.empty(0, np.uint64)]).view(np.int64) for x in (out_a, out_b))
        return pa.RecordBatch.from_pydict({"a": longs(a), "b": longs(b)})

    def solve(batches):
        """The last unit of what is held may go on in the next batch."""
        held_keys, held, rows, last = [], [], 0, None
        for batch in batches:
            if not batch.num_rows:
                continue
            keys = np.stack([batch.column(c).to_numpy() for c in key])
            held_keys.append(keys)
            held.append(batch.column("fp").to_numpy().view(np.uint64))
            rows += batch.num_rows
            if rows < _HELD or last is not None and (keys[:, -1] == last).all() and (keys[:, 0] == last).all():
                continue        # too few, or still inside one unit
            keys, fps = np.concatenate(held_keys, axis=1), np.concatenate(held)
            last = keys[:, -1]
            done = int(np.argmax((keys == last[:, None]).all(0)))
            if done:
                yield settle(keys[:, :done], fps[:done])
            held_keys, held, rows = [keys[:, done:]], [fps[done:]], len(fps) - done
        if held:
            yield settle(np.concatenate(held_keys, axis=1), np.concatenate(held))

    return units.mapInArrow(solve, "a long, b long").distinct()


def near_groups(signed: DataFrame, bits: int = BITS, node_rows: int = NODE_ROWS) -> DataFrame:
    """``(fp, root, component_id)`` for every distinct fingerprint of stored ``(doc_id, fp)`` rows.

    The component is named by its least doc_id; it is null if no row of it has one.
    """
    distinct = materialize(signed.groupBy("fp").agg(F.min("doc_id").alias("least")), "fps")
    roots = components(near_links(distinct.select("fp"), bits, node_rows))
    placed = distinct.join(roots.withColumnRenamed("node", "fp"), "fp", "left").select(
        "fp", "least", F.coalesce("root", "fp").alias("root"))
    named = placed.groupBy("root").agg(F.min("least").alias("component_id"))
    return placed.join(named, "root").select("fp", "root", "component_id")


def near_duplicates(docs: DataFrame, words: int = SHINGLE, bits: int = BITS,
                    node_rows: int = NODE_ROWS) -> DataFrame:
    """``(doc_id, fingerprint, component_id)`` for every row of ``docs(doc_id, text)``.

    Null and empty texts and texts of white space have fingerprint zero and link like others.
    Repeated rows are all returned, with the same component. A row without doc_id belongs to a
    component but never names one. An empty table gives an empty result; other columns are not
    read.
    """
    signed = materialize(signatures(docs, words), "signed")
    groups = near_groups(signed, bits, node_rows)
    return signed.join(groups, "fp").select(
        "doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def wide_signatures(docs: DataFrame, words: int = WIDE_SHINGLE) -> DataFrame:
    """``(doc_id, other, fp, n, band0, ..., odd0, ...)`` of every row: ``fp`` names its set of shingles and ``n`` is
    the size of the set; bands are minima of the set in several orders; a bit of ``odd`` tells whether an odd number of hashes
    falls on it, so two sets differ in no fewer hashes than bits."""
    names = [*_BANDS, *_ODD]

    def longs_of(x):
        mins = (x[:, None] * _MIX).min(0, initial=_TOP)
        odd = np.bincount((x % np.uint64(64 * ODD_WORDS)).astype(np.intp), minlength=64 * ODD_WORDS).astype(np.uint8) & 1
        return np.concatenate([mins, np.packbits(odd, bitorder="little").view(np.uint64)])

    def make():
        def work(batch):
            sets = [_set(t, words) for t in texts(batch)]
            found = np.array([longs_of(x) for x in sets], np.uint64)
            return {"doc_id": batch.column("doc_id"), "other": batch.column("other"),
                    "fp": longs([_name(x) for x in sets]), "n": longs([len(x) for x in sets]),
                    **{c: longs(found[:, i].view(np.int64)) for i, c in enumerate(names)}}
        return work

    return map_batches(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", _other().alias("other")),
                       make, "doc_id long, other long, fp long, n long, " + ", ".join(f"{c} long" for c in names))


def _set(text: str, words: int) -> np.ndarray:
    return np.unique(shingle_hashes(text, words))


def _name(x: np.ndarray) -> int:
    """Hash of a set of shingles, as a signed long."""
    return int(np.uint64(xxhash.xxh64_intdigest(x.tobytes(), SEED)).view(np.int64))


def shingle_sets(docs: DataFrame, fps: DataFrame, signed: DataFrame, words: int) -> DataFrame:
    """``(fp, set)``: the distinct shingle hashes that every name in ``fps`` stands for."""
    key = [F.col("doc_id").isNull().alias("_none"), F.coalesce(F.col("doc_id").cast("long"), F.lit(0)).alias("_id")]
    own = signed.join(fps, "fp", "left_semi").groupBy("fp").agg(
        F.min(F.struct(*key, F.col("other").alias("_other"))).alias("k")).select("fp", "k.*")
    rows = docs.select(*key, _other().alias("_other"), "text").join(own, ["_none", "_id", "_other"])

    def make():
        def work(batch):
            # rows that repeat an id may hold other texts
            found = [_set(t, words) for t in texts(batch)]
            sets = [x.view(np.int64) if _name(x) == fp else None
                    for x, fp in zip(found, batch.column("fp").to_pylist())]
            return {"fp": batch.column("fp"), "set": pa.array(sets, pa.list_(pa.int64()))}
        return work

    made = map_batches(rows.select("fp", "text"), make, "fp long, set array<long>")
    return made.filter("set is not null").dropDuplicates(["fp"])


def common_shingles(docs: DataFrame, words: int, most: int = COMMON) -> tuple[np.ndarray, np.ndarray]:
    """Shingles of many texts, ascending, and their places by rising number of texts.

    Texts are counted in blocks, and a shingle that a block holds once is not passed on. At most ``most`` are
    returned, the commonest. They only decide the order in which shingles are compared.
    """
    small_batches(docs.sparkSession)

    def count(held):
        x, n = np.unique(np.concatenate(held), return_counts=True)
        return pa.RecordBatch.from_pydict({"shingle": longs(x[n > 1].view(np.int64)), "n": longs(n[n > 1])})

    def run(batches):
        held, rows = [], 0
        for batch in batches:
            for t in texts(batch):
                held.append(_set(t, words))
                rows += len(held[-1])
                if rows >= _BLOCK:
                    yield count(held)
                    held, rows = [], 0
        if held:
            yield count(held)

    found = docs.select("text").mapInArrow(run, "shingle long, n long").groupBy("shingle").agg(F.sum("n").alias("n"))
    found = materialize(found.filter("n >= 8"), "common")
    least, total = 64, 0
    for r in sorted(found.groupBy(F.floor(F.log2("n")).alias("power")).count().collect(), reverse=True):
        total += r["count"]
        if total > most:
            break
        least = r["power"]
    kept = found.filter(F.floor(F.log2("n")) >= least).toPandas()
    x, n = kept["shingle"].to_numpy().view(np.uint64), kept["n"].to_numpy()
    places = np.empty(len(x), np.int64)
    places[np.lexsort((x, n))] = np.arange(1, len(x) + 1)
    order = np.argsort(x)
    return x[order], places[order]


def _probe(n, share: Fraction):
    """Shingles, in a common order, among which a set of ``n`` meets every smaller one of that similarity."""
    return n + 1 - (n * share.numerator + share.denominator - 1) // share.denominator


def prefixes(docs: DataFrame, words: int, share: Fraction) -> DataFrame:
    """``(fp, n, head)`` of every set of shingles: its first ones, rare before common, by which similar sets meet."""
    common, places = common_shingles(docs, words)

    def make():
        def head(x):
            k = _probe(len(x), share) if len(x) else 0
            if len(common):
                at = np.minimum(np.searchsorted(common, x), len(common) - 1)
                x = x[np.argsort(np.where(common[at] == x, places[at], 0), kind="stable")]
            return x[:k].view(np.int64)

        def work(batch):
            sets = [_set(t, words) for t in texts(batch)]
            return {"fp": longs([_name(x) for x in sets]), "n": longs([len(x) for x in sets]),
                    "head": pa.array([head(x) for x in sets], pa.list_(pa.int64()))}
        return work

    return map_batches(docs.select("text"), make, "fp long, n long, head array<long>").dropDuplicates(["fp"])


def star_pairs(prints: DataFrame, bands: list[str]) -> DataFrame:
    """``(a, b)``: every set with one set of another ``group`` for each of its bands. The one chosen differs from
    band to band; the pairs are at most as many as the bands for each set."""
    rows = prints.select("fp", "group", F.posexplode(F.array(*bands)).alias("band", "value"))
    first = rows.groupBy("band", "value").agg(F.min(F.struct(F.xxhash64("fp", "value"), "fp", "group")).alias("k"),
                                              F.count("*").alias("rows")).filter("rows > 1")
    first = materialize(first.select("band", "value", F.col("k.fp").alias("first"), F.col("k.group").alias("of")), "first")
    met = rows.join(first, ["band", "value"]).filter("group <> of")
    return met.select(F.greatest("fp", "first").alias("a"), F.least("fp", "first").alias("b")).distinct()


def prefix_pairs(heads: DataFrame, share: Fraction) -> DataFrame:
    """``(a, b)``: all pairs of sets of different ``group`` that may be similar, of ``(fp, n, head, group)``.

    Of two similar sets, the first common shingle lies in the head of the larger one and, as the common part
    is a still larger share of the smaller, nearer to the start of that one; what follows it must suffice.
    """
    p, q = share.numerator, share.denominator
    rows = heads.select("fp", "n", "group", F.posexplode("head").alias("pos", "shingle"))
    several = rows.groupBy("shingle").agg(F.min("group").alias("x"), F.max("group").alias("y")).filter("x < y")
    rows = materialize(rows.join(materialize(several.select("shingle"), "several"), "shingle"), "met")
    a, b = rows.alias("a"), rows.filter(f"pos <= n - (2 * {p} * n + {p + q - 1}) div {p + q}").alias("b")
    return a.join(b, F.expr(f"""a.shingle = b.shingle and a.group <> b.group and (a.n > b.n or a.n = b.n and a.fp > b.fp)
        and a.n * {p} <= b.n * {q} and least(a.n - a.pos, b.n - b.pos) * {p + q} >= {p} * (a.n + b.n)""")).select(
        F.col("a.fp").alias("a"), F.col("b.fp").alias("b")).distinct()


def possible_pairs(pairs: DataFrame, prints: DataFrame, share: Fraction) -> DataFrame:
    """The ``pairs(a, b)`` without those whose sets differ in too many hashes, as their ``odd`` bits tell."""
    for end in ("a", "b"):
        pairs = pairs.join(prints.select("fp", "n", *_ODD).toDF(end, f"{end}_n", *[f"{end}_{c}" for c in _ODD]), end)
    apart = " + ".join(f"bit_count(a_{c} ^ b_{c})" for c in _ODD)
    p, q = share.numerator, share.denominator
    return pairs.filter(f"({apart}) * {p + q} <= (a_n + b_n) * {q - p}").select("a", "b")


def similar_links(pairs: DataFrame, docs: DataFrame, signed: DataFrame, words: int, share: Fraction) -> DataFrame:
    """The stored ``pairs(a, b)`` whose sets of shingles have a Jaccard similarity of ``share`` at least."""
    ends = pairs.select(F.explode(F.array("a", "b")).alias("fp")).distinct()
    sets = materialize(shingle_sets(docs, ends, signed, words), "sets")
    met = pairs.join(sets.toDF("a", "set_a"), "a").join(sets.toDF("b", "set_b"), "b")
    met = met.select("a", "b", F.size(F.array_intersect("set_a", "set_b")).alias("both"),
                     (F.size("set_a") + F.size("set_b")).alias("all"))
    p, q = share.numerator, share.denominator
    return met.filter(F.col("both") * (p + q) >= F.col("all") * p).select("a", "b")


def similar_groups(docs: DataFrame, signed: DataFrame, words: int = WIDE_SHINGLE, similarity: float = SIMILARITY,
                   node_rows: int = NODE_ROWS) -> DataFrame:
    """``(fp, root)`` for every ``fp`` of the stored wide signatures of ``docs`` that is similar to another and not
    the root itself.

    Exact, up to equal 64-bit hashes: all pairs of sets that a similarity allows by their first shingles are
    compared, but for those that are one group already. So that a large group of near copies makes few pairs,
    every set is compared with a few others first, twice. No unit of work is a group, so ``node_rows`` has no effect.
    """
    share = Fraction(str(similarity))
    prints = materialize(signed.drop("doc_id", "other").dropDuplicates(["fp"]), "prints")
    links, joined = None, prints.select("fp", F.col("fp").alias("group"))
    for bands in (_BANDS[:FEW], _BANDS[FEW:]):
        links, joined = _linked(star_pairs(prints.join(joined, "fp"), bands), links, prints, docs, signed, words, share)
    heads = materialize(prefixes(docs, words, share), "heads")
    pairs = prefix_pairs(heads.join(joined, "fp"), share)
    links, joined = _linked(pairs, links, prints, docs, signed, words, share)
    return joined.filter("fp <> group").select("fp", F.col("group").alias("root"))


def _linked(pairs: DataFrame, links: DataFrame | None, prints: DataFrame, docs: DataFrame, signed: DataFrame, words: int,
            share: Fraction) -> tuple[DataFrame, DataFrame]:
    """``links`` with those of the pairs that are similar, and the ``group`` of every print."""
    pairs = materialize(possible_pairs(pairs, prints, share), "pairs")
    more = materialize(similar_links(pairs, docs, signed, words, share), "similar")
    links = links.unionByName(more) if links else more
    joined = prints.select("fp").join(components(links).toDF("fp", "group"), "fp", "left")
    return links, materialize(joined.select("fp", F.coalesce("group", "fp").alias("group")), "groups")


def keep_one_similar(docs: DataFrame, words: int = WIDE_SHINGLE, similarity: float = SIMILARITY) -> DataFrame:
    """The rows of ``docs`` without near copies: of texts that links of the given Jaccard similarity of
    word shingles connect, the row of least doc_id stays. All else is as for ``keep_one``."""
    signed = materialize(wide_signatures(docs, words), "signed")
    groups = similar_groups(docs, signed, words, similarity)
    placed = signed.select("fp", "doc_id", "other").join(groups, "fp", "left")
    return _keep(docs, placed.withColumn("root", F.coalesce("root", "fp")))


def keep_one(docs: DataFrame, words: int = SHINGLE, bits: int = BITS,
             node_rows: int = NODE_ROWS) -> DataFrame:
    """The rows of ``docs`` without near duplicates: the least doc_id of each group stays.

    Columns stay as they are. Rows that repeat a doc_id are one document, of which one row stays.
    Where no row of a group has a doc_id, one of its rows stays.
    """
    signed = materialize(signatures(docs, words), "signed")
    distinct = materialize(signed.select("fp").distinct(), "fps")
    roots = components(near_links(distinct, bits, node_rows)).withColumnRenamed("node", "fp")
    placed = signed.join(roots, "fp", "left").withColumn("root", F.coalesce("root", "fp"))
    return _keep(docs, placed)


def _keep(docs: DataFrame, placed: DataFrame) -> DataFrame:
    """The rows of ``docs`` whose ``(doc_id, other)`` is the first of its ``root``. A root's first is a
    minimum with map-side combine, so no root meets in one task."""
    key = [F.col("doc_id").isNull().alias("_none"), F.coalesce("doc_id", F.lit(0)).alias("_id")]
    rows = placed.groupBy("root", *key, F.col("other").alias("_other")).agg(F.count("*").alias("_rows"))
    chosen = rows.groupBy("root").agg(F.min(F.struct("_none", "_id", "_other", "_rows")).alias("k"))
    chosen = chosen.select("k.*")
    row = docs.select(*key, _other().alias("_other"),
                      F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("_row"))
    kept = row.join(chosen, ["_none", "_id", "_other"])
    once = kept.filter("_rows = 1").select("_row.*")
    again = kept.filter("_rows > 1").groupBy("_none", "_id", "_other").agg(F.first("_row").alias("_row"))
    return once.unionByName(again.select("_row.*"))
