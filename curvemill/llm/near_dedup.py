"""MinHash near-duplicates with odd sketches.

1. Every text becomes the set of its distinct shingles, SAMPLES MinHash samples of it, a key for each band of ROWS
   samples, and an odd sketch: a bitmap in which every (sample number, sample) flips one bit, so that the population
   count of two sketches' XOR tells how many samples differ.
2. Equal sets (by 128 bits from two independent hashes of their words, and their size) are one class from here on; its
   least doc_id stands for it.
3. Classes that share a band are candidates. A small bucket is left out if a larger one has all its members. The full
   sets of the candidates are computed again from their texts; a bitmap of bounded size tells where, so the texts are
   not dealt out.
4. Candidates whose XOR count is beyond what SIMILARITY can give are dropped, the rest are compared by their full sets,
   nearest first; a pair that links already connect needs no comparison. Only links that join two groups come out,
   pointing at the least member. A bucket of up to BLOCK members is one group of a task; in a larger one each block of
   members is compared with itself and with the first block. That connects most of what belongs together; the members
   outside of the bucket's greatest component are then compared with all blocks. No task holds more than two blocks, no
   pairs are listed, and a bucket of N copies costs about three sets each, not N / BLOCK.
5. Components of the links are found by star steps on written tables.

Two sets at the limit of 0.85 share no band with probability (1 - 0.85^4)^24 < 2e-8, and fail the sketch with less.
Nulls and texts without words have empty sets and are linked with nothing; rows without doc_id are returned with a null
component and kept; repeated rows share their class; different texts with one doc_id are documents of their own, but
count as linked where their classes have the same least doc_id. Extra columns are ignored.
"""

from __future__ import annotations

import random
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from curvemill.llm._common import STEP_BYTES, grams, mix, rested, staged, steps, utf8, words_of
from curvemill.llm.components import components

SAMPLES, ROWS, BANDS, SKETCH_BITS, BLOCK = 128, 4, 24, 512, 512
#: Members of a bucket that is small; places of the bitmap of wanted documents for each of them and at most (16 MB; where it fills up, more sets than needed are sent).
SMALL, PLACES_EACH, PLACES = 32, 64, 1 << 27
_RANDOM = random.Random(20)
_FACTORS = np.array([_RANDOM.getrandbits(64) | 1 for _ in range(SAMPLES)], np.uint64)
_FLIPS = np.array([_RANDOM.getrandbits(64) for _ in range(SAMPLES)], np.uint64)
_SIGNED = pa.schema([("doc_id", pa.int64()), ("n", pa.int64()), ("h1", pa.int64()), ("h2", pa.int64()), ("bands", pa.list_(pa.int64())), ("sketch", pa.binary())])


def xor_limit(similarity: float) -> int:
    """XOR count of two odd sketches that a pair of at least this similarity stays within, but for 1 in 10^9: six deviations of the samples, five of the bits."""
    differ = SAMPLES * (1 - similarity) + 6 * (SAMPLES * similarity * (1 - similarity)) ** 0.5
    flips = 2 * min(differ, SAMPLES)
    mean = SKETCH_BITS / 2 * (1 - (1 - 2 / SKETCH_BITS) ** flips)
    return round(mean + 5 * mean**0.5)


def shingle_sets(data: np.ndarray, offsets: np.ndarray, words: int, streams: int = 1) -> tuple[list[np.ndarray], np.ndarray | None]:
    """Sorted distinct shingle hashes of each document of a step and, with two streams, the sum over each set of its shingles' other hashes."""
    h, _, _, first = words_of(data, offsets, lower=True, streams=streams)
    h, other = (h[0], h[1]) if streams == 2 else (h, None)
    g, out, sums = grams(h, words), [], np.zeros(len(offsets) - 1, np.uint64)
    g2 = grams(other, words) if other is not None else None
    for k, (a, b) in enumerate(zip(first[:-1].tolist(), first[1:].tolist(), strict=True)):
        if b - a >= words and g2 is None:
            out.append(np.unique(g[a : b - words + 1]))
        elif b - a >= words:
            some, at = np.unique(g[a : b - words + 1], return_index=True)
            out.append(some)
            sums[k] = mix(g2[a + at]).sum(dtype=np.uint64)
        elif b > a:  # a tag of the length keeps short sequences apart from shingles
            out.append(mix(grams(h[a:b], b - a) + np.uint64(b - a)))
            if other is not None:
                sums[k] = mix(grams(other[a:b], b - a) + np.uint64(b - a))[0]
        else:
            out.append(np.zeros(0, np.uint64))
    return out, sums if streams == 2 else None


def set_hash(shingles: np.ndarray) -> int:
    return int(shingles.sum(dtype=np.uint64).view(np.int64))


def _signatures(words: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, offsets = utf8(batch["text"])
            ids = batch["doc_id"]
            for i, j in steps(offsets, STEP_BYTES // 4):
                sets, h2 = shingle_sets(data, offsets[i : j + 1], words, streams=2)
                n = np.array([len(s) for s in sets])
                some = np.flatnonzero(n)
                flat = np.concatenate([*sets, np.zeros(0, np.uint64)])
                at = (np.cumsum(n) - n)[some]
                samples = np.empty((SAMPLES, len(some)), np.uint64)
                h1 = np.array([set_hash(x) for x in sets], np.int64)
                if len(some):
                    for k in range(SAMPLES):
                        samples[k] = np.minimum.reduceat((flat ^ _FLIPS[k]) * _FACTORS[k], at)
                bands = np.zeros((BANDS, len(some)), np.uint64)
                for b in range(BANDS):
                    bands[b] = mix(grams(samples[b * ROWS : b * ROWS + ROWS].T.ravel(), ROWS)[::ROWS] + np.uint64(b + 1)) if len(some) else 0
                bits = np.zeros((len(some), SKETCH_BITS), np.uint8)
                row = np.arange(len(some))
                for k in range(SAMPLES):
                    bits[row, (mix(samples[k] + _FLIPS[k]) % np.uint64(SKETCH_BITS)).astype(np.int64)] ^= 1
                packed = np.packbits(bits, axis=1)
                of = dict(zip(some.tolist(), range(len(some)), strict=True))
                per = bands.T.view(np.int64).tolist() if len(some) else []
                yield pa.RecordBatch.from_arrays(
                    [ids.slice(i, j - i), pa.array(n, pa.int64()), pa.array(h1), pa.array(h2.view(np.int64)), pa.array([per[of[k]] if k in of else [] for k in range(j - i)], pa.list_(pa.int64())), pa.array([packed[of[k]].tobytes() if k in of else None for k in range(j - i)], pa.binary())],
                    schema=_SIGNED,
                )

    return run


def _sets(words: int, bitmap):
    """Sets of the documents whose place the bitmap has."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        wanted = np.frombuffer(bitmap.value, np.uint8)
        for batch in batches:
            place = batch["place"].to_numpy()
            batch = batch.filter(pa.array((wanted[place >> 3] >> (place & 7).astype(np.uint8)) & 1 == 1))
            data, offsets = utf8(batch["text"])
            for i, j in steps(offsets, STEP_BYTES // 4):
                sets, _ = shingle_sets(data, offsets[i : j + 1], words)
                yield pa.RecordBatch.from_arrays([batch["doc_id"].slice(i, j - i), pa.array([set_hash(x) for x in sets], pa.int64()), pa.array([x.tobytes() for x in sets], pa.binary())], names=["id", "h1", "shingles"])

    return run


def _link(percent: int):
    """Links between the components of a block pair's members (component, side, shingles, bands, sketch; side: 0 and 1 are the blocks, 2 both): enough of them to connect what is connected."""
    limit = xor_limit(percent / 100)

    def run(table: pa.Table) -> pa.Table:
        side = table["side"].to_numpy()
        known, group = np.unique(table["component"].to_numpy(), return_inverse=True)
        start = group.copy()
        band = table["band_no"][0].as_py() if table["members"][0].as_py() > SMALL else 0
        m = len(side)
        sets = [np.frombuffer(x, np.uint64) for x in table["shingles"].to_pylist()]
        size = np.array([len(s) for s in sets])
        sketch = np.frombuffer(b"".join(table["sketch"].to_pylist()), np.uint64).reshape(m, -1)
        bands = np.array(table["bands"].to_pylist())
        flat, ends = np.concatenate(sets), np.cumsum(size)
        pairs = []
        for a in range(m - 1):
            rest = slice(a + 1, m)
            near = np.bitwise_count(sketch[rest] ^ sketch[a]).sum(axis=1, dtype=np.int64)
            ok = (near <= limit) & (100 * np.minimum(size[rest], size[a]) >= percent * np.maximum(size[rest], size[a]))
            ok &= ((side[rest] != side[a]) | (side[a] == 2)) & (group[rest] != group[a])
            if band:
                ok &= ~(bands[rest, :band] == bands[a, :band]).any(axis=1)
            b = np.flatnonzero(ok) + a + 1
            if len(b):
                pairs.append((near[b - a - 1], np.full(len(b), a), b))
        if pairs:
            near, left, right = (np.concatenate(x) for x in zip(*pairs, strict=True))
            for tier in range(0, limit + 1, 16):  # the nearest first; what they connect needs no comparison
                now = (near >= tier) & (near < tier + 16)
                now &= group[left] != group[right]
                tl, tr = left[now], right[now]
                for a in np.unique(tl).tolist():
                    b = tr[tl == a]
                    b = b[group[b] != group[a]]
                    if not len(b):
                        continue
                    at = np.concatenate([np.arange(ends[x] - size[x], ends[x]) for x in b])
                    place = np.minimum(np.searchsorted(sets[a], flat[at]), size[a] - 1)
                    same = np.add.reduceat((sets[a][place] == flat[at]).astype(np.int64), np.cumsum(size[b]) - size[b])
                    for x in b[100 * same >= percent * (size[a] + size[b] - same)].tolist():
                        if group[x] != group[a]:
                            group[group == group[x]] = group[a]
        least = np.full(len(known), len(known))
        of = np.zeros(len(known), np.int64)  # a component's group now
        of[start] = group
        np.minimum.at(least, of, np.arange(len(known)))
        moved = np.flatnonzero(least[of] != np.arange(len(known)))
        return pa.table({"a": pa.array(known[moved]), "b": pa.array(known[least[of[moved]]])})

    return run


def _wanted(spark, ids: DataFrame) -> tuple:
    """A broadcast bitmap with the places of ids, and how many places it has: in proportion to ids, but at most PLACES."""
    places = min(PLACES, 1 << max(15, (PLACES_EACH * ids.count() - 1).bit_length()))
    bits = ids.select((_place("id", places) + 1).alias("v")).groupBy(F.bitmap_bucket_number("v").alias("bucket")).agg(F.bitmap_construct_agg(F.bitmap_bit_position("v")).alias("bits"))
    wanted = bytearray(places // 8)
    for row in bits.collect():  # a row for 4096 bytes
        wanted[(row.bucket - 1) * 4096 : row.bucket * 4096] = row.bits
    return spark.sparkContext.broadcast(bytes(wanted)), places


def _place(column: str, places: int):
    return F.pmod(F.xxhash64(column), F.lit(places))


def near_duplicates(documents: DataFrame, words: int = 5, percent: int = 80) -> DataFrame:
    """Per document: doc_id, n_shingles, component_id (the least doc_id that links of Jaccard similarity >= percent / 100 reach)."""
    spark = documents.sparkSession
    texts = documents.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    signed = staged(texts.mapInArrow(rested(_signatures(words)), "doc_id long, n long, h1 long, h2 long, bands array<long>, sketch binary"), "signatures")
    known = signed.where("doc_id is not null and n > 0")
    classes = known.groupBy("h1", "h2", "n").agg(F.min("doc_id").alias("id"), F.count("*").alias("copies"))
    leads = known.join(classes.select(F.col("id").alias("doc_id"), "h1", "h2"), ["doc_id", "h1", "h2"])
    leads = leads.select(F.col("doc_id").alias("id"), "h1", "bands", "sketch").dropDuplicates(["id", "h1"])

    banded = leads.select("id", "h1", F.posexplode("bands").alias("band_no", "band"))
    buckets = banded.groupBy("band").agg(F.count("*").alias("members")).where("members > 1")
    members = banded.join(buckets, "band").withColumn("member", F.struct("id", "h1"))
    small = members.where(F.col("members") <= SMALL).groupBy("band").agg(F.min("band_no").alias("band_no"), F.sort_array(F.collect_list("member")).alias("ids"))
    # a document is in at most BANDS buckets, so as many at most have it as their least member
    small = small.groupBy(F.col("ids")[0].alias("least")).agg(F.collect_list(F.struct(F.size("ids").alias("n"), (-F.col("band_no")).alias("early"), "band", "ids")).alias("all"))
    inside = lambda b, c: ((c["n"] > b["n"]) | ((c["n"] == b["n"]) & (c["early"] > b["early"]))) & (F.size(F.array_except(b["ids"], c["ids"])) == 0)
    needed = small.select(F.explode(F.filter("all", lambda b: ~F.exists("all", lambda c: inside(b, c)))).alias("b"))
    needed = needed.select("b.band", (-F.col("b.early")).alias("band_no"), F.explode("b.ids").alias("member"), F.col("b.n").cast("long").alias("members"))
    open_ = needed.unionByName(members.where(F.col("members") > SMALL).select("band", "band_no", "member", "members"))
    open_ = open_.select("band", "band_no", "members", "member.*")
    n_blocks = F.ceil(F.col("members") / BLOCK).cast("int")
    open_ = open_.withColumns({"n_blocks": n_blocks, "own": F.pmod(F.xxhash64("id", "h1"), n_blocks).cast("int")})
    pair = lambda i, j, side: F.struct(i.alias("i"), j.alias("j"), side.alias("side"))
    own, last, zero = F.col("own"), F.col("n_blocks") - 1, F.lit(0)
    others = F.when((own == 0) & (last > 0), F.transform(F.sequence(F.lit(1), F.greatest(last, F.lit(1))), lambda o: pair(zero, o, zero))).when(own > 0, F.array(pair(zero, own, F.lit(1))))
    first = F.concat(F.array(pair(own, own, F.lit(2))), F.coalesce(others, F.expr("cast(array() as array<struct<i:int,j:int,side:int>>)")))
    dealt = staged(open_.withColumns({"component": F.col("id"), "p": F.explode(first)}).select("band", "band_no", "members", "n_blocks", "own", "component", "id", "h1", "p.*"), "buckets")

    def links(pairs: DataFrame) -> DataFrame:
        bitmap, places = _wanted(spark, pairs)
        sets = texts.where("doc_id is not null").withColumn("place", _place("doc_id", places)).mapInArrow(rested(_sets(words, bitmap)), "id long, h1 long, shingles binary")
        full = leads.join(sets.dropDuplicates(["id", "h1"]), ["id", "h1"])
        return pairs.join(full, ["id", "h1"]).groupBy("band", "i", "j").applyInArrow(_link(percent), "a long, b long")

    roots = components(links(dealt))
    large = dealt.where((F.col("members") > BLOCK) & (F.col("side") == 2))
    if not large.isEmpty():
        more = staged(links(staged(_outside(large, roots), "outside")), "links")
        roots = components(more.unionByName(roots.toDF("a", "b")))

    # a class of one text without links needs no answer; the written table lets Spark split a class with very many copies
    rooted = classes.join(roots, "id", "left").where("copies > 1 or root is not null")
    rooted = staged(rooted.select("h1", "h2", F.col("n").alias("n_"), F.coalesce("root", "id").alias("root")), "classes")
    out = signed.join(rooted, (signed.h1 == rooted.h1) & (signed.h2 == rooted.h2) & (signed.n == rooted.n_) & signed.doc_id.isNotNull(), "left")
    return out.select("doc_id", F.col("n").alias("n_shingles"), F.coalesce("root", "doc_id").alias("component_id"))


def _outside(large: DataFrame, roots: DataFrame) -> DataFrame:
    """Members of large buckets dealt anew: those outside of their bucket's greatest component (side 0) with all members (side 1), as pairs of blocks."""
    rows = large.drop("component", "i", "j", "side").join(roots, "id", "left").withColumn("component", F.coalesce("root", "id")).drop("root")
    sizes = rows.groupBy("band", "component").agg(F.count("*").alias("size"))
    greatest = sizes.groupBy("band").agg(F.max_by("component", F.struct("size", "component")).alias("greatest"), F.sum("size").alias("all"), F.max("size").alias("most"))
    greatest = greatest.where(F.col("all") > F.col("most")).select("band", "greatest", F.ceil((F.col("all") - F.col("most")) / BLOCK).cast("int").alias("blocks"))
    rows = rows.join(greatest, "band")
    every = rows.withColumns({"i": F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)), "j": F.col("own"), "side": F.lit(1)})
    rest = rows.where("component <> greatest").withColumns({"i": F.pmod(F.xxhash64("id", "h1", F.lit(1)), F.col("blocks")).cast("int"), "j": F.explode(F.sequence(F.lit(0), F.col("n_blocks") - 1)), "side": F.lit(0)})
    return every.unionByName(rest).drop("greatest", "blocks")
