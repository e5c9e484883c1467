"""Near-duplicate documents by b-bit MinHash.

Each text becomes the set of its distinct five-word shingles; two texts are linked when
100 * |A & B| >= 75 * |A | B|. Every class of equal sets sends one representative on.

1. A pass over the texts gives each set 160 minima. Bands of four minima become bucket keys, and
   of each minimum two low bits (of its mixed value) stay, packed 32 to a BIGINT.
2. A pair in one bucket is a candidate. Its similarity is estimated from the packed signatures by
   ``bit_count``, corrected for the quarter of unequal minima whose bits agree by chance; pairs
   estimated more than six standard errors below the threshold are let go.
3. Candidates are confirmed on full sets, which only the texts in candidates ship.

A linked pair misses all 40 bands with probability (1 - 0.75**4)**40 < 3e-7.

A bucket's members meet the bucket's smallest member first; after these links' components are
known, only members of *different* components still meet. So a bucket of thousands of copies
costs as many rows as it has members, and no link between components is lost. Texts that still
meet get a second signature of 2,048 minima: five standard errors are then 0.06, which lets go of
texts that are merely similar; and a pair is taken up in the first band that it shares only.
"""

from __future__ import annotations

from collections.abc import Iterator
from hashlib import blake2b

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cairn.llm.words import mix, portions, shingle_sets, tidy
from cairn.operators.components import connected_components
from cairn.session import bounded_batches, join_counted, materialize, small_side, without

N, LONG_N, BANDS, ROWS, PER_LONG = 160, 2048, 40, 4, 32
#: Pairs that get a text's set from one key.
PAIRS_A_KEY = 100
#: Percent, as the link rule has it; and the lowest estimates that are still verified, by signature.
THRESHOLD, LEAST_ESTIMATE, LEAST_LONG_ESTIMATE = 75, 0.5, 0.69
_U = np.uint64
_FACTORS = np.random.default_rng(7).integers(0, 1 << 31, LONG_N, dtype=np.int64).astype(np.uint32) * np.uint32(2) + np.uint32(1)
_BAND_SALT = mix(np.arange(1, BANDS + 1, dtype=_U))
FEATURES = "doc_id long, n_shingles long, class binary, signature array<long>, bands array<long>"


def minima(shingles: np.ndarray, n: int = N, block: int = 512) -> np.ndarray:
    """The first ``n`` minima of a set of 64-bit hashes under multiply-permuted upper halves."""
    upper = (shingles >> _U(32)).astype(np.uint32)
    low = np.full(n, 0xFFFFFFFF, np.uint32)
    for i in range(0, len(upper), block):
        np.minimum(low, (_FACTORS[:n, None] * upper[None, i : i + block]).min(axis=1), out=low)
    return low


def pack(low: np.ndarray) -> np.ndarray:
    """Two bits of each mixed minimum, 32 to a word; rows of ``low`` are sets."""
    bits = ((low * np.uint32(0x9E3779B1)) >> np.uint32(30)).astype(_U).reshape(len(low), -1, PER_LONG)
    return (bits << (_U(2) * np.arange(PER_LONG, dtype=_U))).sum(axis=2, dtype=_U).view(np.int64)


def band_keys(low: np.ndarray) -> np.ndarray:
    quads = low.astype(_U).reshape(len(low), BANDS, ROWS)
    key = np.tile(_BAND_SALT, (len(low), 1))
    for k in range(ROWS):
        key = mix(key ^ quads[:, :, k])
    return key.view(np.int64)


def _lists(values: np.ndarray, keep: np.ndarray) -> pa.ListArray:
    """Rows of ``values`` where ``keep``; elsewhere null."""
    ends = np.concatenate([[0], np.cumsum(keep * values.shape[1])]).astype(np.int32)
    return pa.ListArray.from_arrays(pa.array(ends), pa.array(values[keep].ravel()), mask=pa.array(~keep))


def _features(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for i, j, words in portions(batch.column(1)):
            low, sizes, classes = np.zeros((j - i, N), np.uint32), np.zeros(j - i, np.int64), []
            for k, s in enumerate(shingle_sets(words)):
                sizes[k] = len(s)
                classes.append(blake2b(s.tobytes(), digest_size=16).digest() if len(s) else None)
                if len(s):
                    low[k] = minima(s)
            some = sizes > 0
            columns = [batch.column(0).slice(i, j - i), pa.array(sizes), pa.array(classes, pa.binary()), _lists(pack(low), some), _lists(band_keys(low), some)]
            yield pa.RecordBatch.from_arrays(columns, ["doc_id", "n_shingles", "class", "signature", "bands"])


def _sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for i, j, words in portions(batch.column(1)):
            sets = [s.view(np.int64) for s in shingle_sets(words)]
            ends = np.concatenate([[0], np.cumsum([len(s) for s in sets])]).astype(np.int32)
            column = pa.ListArray.from_arrays(pa.array(ends), pa.array(np.concatenate(sets)))
            yield pa.RecordBatch.from_arrays([batch.column(0).slice(i, j - i), column], ["id", "shingles"])


def _long_signatures(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for i, j, words in portions(batch.column(1)):
            low = np.array([minima(s, LONG_N) for s in shingle_sets(words)])
            yield pa.RecordBatch.from_arrays([batch.column(0).slice(i, j - i), _lists(pack(low), np.ones(j - i, bool))], ["id", "long_signature"])


def estimate(x: Column | str, y: Column | str) -> Column:
    """Collision-corrected similarity of two packed signatures."""
    return _corrected(sum((_unequal(F.get(x, F.lit(k)), F.get(y, F.lit(k))) for k in range(N // PER_LONG)), F.lit(0)), N)


def long_estimate(x: Column | str, y: Column | str) -> Column:
    """The same of two long signatures."""
    return _corrected(F.aggregate(F.zip_with(x, y, _unequal), F.lit(0), lambda total, n: total + n), LONG_N)


def _unequal(x: Column, y: Column) -> Column:
    """How many of the 32 two-bit values in two BIGINTs differ."""
    d = x.bitwiseXOR(y)
    return F.bit_count(d.bitwiseOR(F.shiftrightunsigned(d, 1)).bitwiseAND(F.lit(0x5555555555555555)))


def _corrected(unequal: Column, n: int) -> Column:
    chance = 0.25
    return (1 - unequal / F.lit(float(n)) - chance) / (1 - chance)


def _plausible(p: str, q: str) -> Column:
    """Sizes that allow the threshold, and a high enough estimate."""
    small, large = F.least(f"{p}.n", f"{q}.n"), F.greatest(f"{p}.n", f"{q}.n")
    return (small * 100 >= large * THRESHOLD) & (estimate(F.col(f"{p}.signature"), F.col(f"{q}.signature")) >= LEAST_ESTIMATE)


def _verified(pairs: DataFrame, texts: DataFrame) -> DataFrame:
    """The candidates ``(a, b)`` whose full sets meet the threshold. Sets travel to b's key along with a's."""
    ids = pairs.select(F.explode(F.array("a", "b")).alias("id")).distinct()
    sets = texts.join(small_side(ids, 16), "id", "left_semi").mapInArrow(tidy(_sets), "id long, shingles array<long>")
    # a text in very many pairs is dealt out: its set goes to a key for some hundred of them
    parts = pairs.groupBy("a").agg(F.ceil(F.count(F.lit(1)) / PAIRS_A_KEY).cast("int").alias("parts")).where("parts > 1")
    parts = small_side(materialize(parts, "dedup-hubs"), 16)
    part = F.pmod(F.xxhash64("b"), F.coalesce("parts", F.lit(1))).cast("int")
    dealt = pairs.join(parts, "a", "left").select("a", "b", part.alias("part"))
    lots = sets.select(F.col("id").alias("a"), F.col("shingles").alias("x")).join(parts, "a", "left")
    lots = lots.select("a", "x", F.explode(F.sequence(F.lit(0), F.coalesce("parts", F.lit(1)) - 1)).alias("part"))
    both = dealt.join(lots, ["a", "part"]).join(sets.select(F.col("id").alias("b"), F.col("shingles").alias("y")), "b")
    shared = F.size(F.array_intersect("x", "y")).cast("long")
    return both.select("a", "b", shared.alias("shared"), (F.size("x") + F.size("y")).alias("total")).where(F.col("shared") * 100 >= (F.col("total") - F.col("shared")) * THRESHOLD).select("a", "b").distinct()


def near_duplicates(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """``(doc_id, n_shingles, component_id, kept)`` per row of ``docs``.

    component_id is the smallest doc_id reachable over links, itself included; kept is
    doc_id = component_id. Null, empty and blank texts have n_shingles 0 and are linked with
    nothing. Rows that repeat a doc_id count as one document with several texts: they share a
    component and the flag. A row without doc_id has a null component and is kept. Other columns
    of ``docs`` are ignored, whatever their names. Texts are read whole.
    """
    bounded_batches(docs.sparkSession)
    texts = docs.select(F.col(doc_id).cast("long").alias("id"), F.col(text).alias("body"))
    rows = materialize(texts.mapInArrow(tidy(_features), FEATURES), "dedup-features")
    known = rows.where("class is not null and doc_id is not null")

    total = rows.count()
    first = materialize(known.groupBy("class").agg(F.min("doc_id").alias("rep"), F.count(F.lit(1)).alias("n")), "dedup-first")
    classed = join_counted(known.select("doc_id", "class"), first, "class", "n", total)
    member = materialize(classed.select("doc_id", "rep").distinct(), "dedup-members")
    reps = known.join(member.where("doc_id = rep").select("doc_id"), "doc_id", "left_semi").select(F.col("doc_id").alias("id"), F.col("n_shingles").alias("n"), "signature", "bands").dropDuplicates(["id", "n", "signature", "bands"])
    reps = materialize(reps, "dedup-classes")
    signs = reps.select("id", "n", "signature")

    banded = reps.select("id", F.explode("bands").alias("bucket"))
    hubs = banded.groupBy("bucket").agg(F.min("id").alias("hub"), F.max("id").alias("top")).where("hub < top").select("bucket", "hub")
    shared = materialize(banded.join(hubs, "bucket").distinct(), "dedup-buckets")

    starred = shared.where("id <> hub").select(F.col("hub").alias("a"), F.col("id").alias("b")).distinct()
    stars = starred.join(signs.alias("p"), F.col("a") == F.col("p.id")).join(signs.alias("q"), F.col("b") == F.col("q.id")).where(_plausible("p", "q")).select("a", "b").distinct()
    links = materialize(_verified(materialize(stars, "dedup-stars"), texts), "dedup-links")
    #: A doc_id with several texts joins their classes.
    several = member.groupBy("doc_id").agg(F.min("rep").alias("a"), F.max("rep").alias("b")).where("a < b").select("doc_id")
    same = member.join(several, "doc_id", "left_semi").select(F.col("doc_id").alias("a"), F.col("rep").alias("b"))
    links = links.unionByName(same)
    labels = materialize(connected_components(links), "dedup-labels")

    placed = shared.join(labels.withColumnRenamed("node", "id"), "id", "left").select("bucket", "id", F.coalesce("component", "id").alias("c"))
    mixed = placed.groupBy("bucket").agg(F.min("c").alias("lo"), F.max("c").alias("hi")).where("lo < hi").select("bucket")
    still = materialize(placed.join(mixed, "bucket", "left_semi"), "dedup-open")
    ids = small_side(still.select("id").distinct(), 16)
    longer = texts.join(ids, "id", "left_semi").mapInArrow(tidy(_long_signatures), "id long, long_signature array<long>")
    left = materialize(still.join(reps, "id").join(longer, "id"), "dedup-open-signed")
    p, q = left.alias("p"), left.alias("q")
    first_band = F.get(F.array_intersect("p.bands", "q.bands"), F.lit(0)) == F.col("p.bucket")
    close = first_band & (long_estimate("p.long_signature", "q.long_signature") >= LEAST_LONG_ESTIMATE)
    crossed = p.join(q, (F.col("p.bucket") == F.col("q.bucket")) & (F.col("p.c") < F.col("q.c")) & _plausible("p", "q") & close).select(F.col("p.id").alias("a"), F.col("q.id").alias("b")).distinct()
    crossed = materialize(crossed.join(stars, ["a", "b"], "left_anti").join(stars.select(F.col("a").alias("b"), F.col("b").alias("a")), ["a", "b"], "left_anti"), "dedup-crossed")
    more = materialize(_verified(crossed, texts), "dedup-more")
    #: Classes are nodes of the second graph by what they reached in the first.
    known_as = labels.select("node", "component")
    joined = more.join(known_as.select(F.col("node").alias("a"), F.col("component").alias("ca")), "a", "left").join(known_as.select(F.col("node").alias("b"), F.col("component").alias("cb")), "b", "left")
    second = connected_components(joined.select(F.coalesce("ca", "a").alias("a"), F.coalesce("cb", "b").alias("b")))
    final = labels.join(second.select(F.col("node").alias("component"), F.col("component").alias("last")), "component", "left").select("node", F.coalesce("last", "component").alias("component"))
    final = final.union(second.join(labels, "node", "left_anti").select("node", "component"))

    sizes = first.groupBy("rep").agg(F.sum("n").alias("n")).join(final.withColumnRenamed("node", "rep"), "rep")
    of_class = join_counted(member, sizes, "rep", "n", total).groupBy("doc_id").agg(F.min(F.coalesce("component", "rep")).alias("component_id"))
    out = rows.select("doc_id", "n_shingles").join(of_class, "doc_id", "left")
    component = F.coalesce("component_id", "doc_id")
    return out.select("doc_id", "n_shingles", component.alias("component_id"), F.coalesce(component == F.col("doc_id"), F.lit(True)).alias("kept"))


def drop_near_duplicates(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """``docs`` without the documents that another one of their component stands for."""
    return without(docs, near_duplicates(docs, doc_id, text).where("not kept").withColumnRenamed("doc_id", doc_id), doc_id)
