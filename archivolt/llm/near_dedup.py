"""Near-duplicate documents by SetSketch.

A document's set are its distinct shingles (hashed to 64 bits).  Its sketch has REGISTERS registers: the
least of exponentially distributed hashes of the set, truncated to powers of BASE, so the
union's sketch is the registers' maximum, and equal registers are as likely as sets are similar.  Bands of ROWS
registers give candidates; their similarity is estimated jointly, by the likelihood of how many registers are
larger, smaller and equal given both sizes; pairs for which the threshold is all but impossible go, and
the rest is verified on the full sets.

With 40 bands of 5 a pair at similarity 0.8 is missed with probability 1.3e-7, more similar ones less still.

Groups never expand to all pairs.  Documents with equal sets are one from the start.  In each band's bucket
every document is first compared with the smallest, then (where documents of the bucket are still apart) with the largest;
only documents of a bucket that are in different components after that meet each other, in the first band that they share.  That join lets a pair
pass if its sizes fit, if as many registers are equal as make the threshold likely enough, and if the full sets then say so: links come out of it, not
pairs.  Links within a component can't change it, so the components are exactly those of all the links.

Defined cases: null and empty texts have no shingles, are in a component of their own and link with
nothing; texts of fewer than k words have one shingle, all their words; a null doc_id counts as the smallest and comes out
as null; rows that repeat an id come out repeated, each judged by its own text: kept says that a row has its component's smallest id, chosen
that it also has, of several texts under that id, the one of smallest MD5; other columns are ignored; an empty table gives an empty table.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import NULL_ID, chunks, cut, forget, id_out, joined_back, mix, plain
from .components import components
from .substring_dedup import Hashes

ROWS, BANDS, BASE, RATE, LIMIT = 5, 40, 1.001, 20.0, 65534
REGISTERS, TEXT_BYTES, CACHE = ROWS * BANDS, 1 << 20, 150_000
#: A pair goes if the threshold is exp(-DOUBT) times as likely as the best similarity, or less.
DOUBT = 20.0
_R = np.random.default_rng(20_260_101)
MULTIPLIERS = _R.integers(0, 2**63, REGISTERS, np.int64).astype(np.uint64) * np.uint64(2) + np.uint64(1)
OFFSETS = _R.integers(0, 2**63, REGISTERS, np.int64).astype(np.uint64)
WORDS = Hashes()


def shingle_sets(texts: list[bytes], k: int) -> list[np.ndarray]:
    """Each text's distinct shingles as ordered 64-bit hashes."""
    if len(WORDS) > CACHE:
        WORDS.clear()
    out = []
    for t in texts:
        w = t.lower().split()
        v = np.fromiter(map(WORDS.__getitem__, w), np.uint64, len(w))
        if not len(w):
            out.append(v)
            continue
        size = min(k, len(w))
        h = np.full(len(w) - size + 1, size, np.uint64)
        for i in range(size):
            h = mix(h * np.uint64(0x9E3779B97F4A7C15) + v[i : i + len(h)])
        out.append(np.unique(h))
    return out


def registers(sets: list[np.ndarray]) -> np.ndarray:
    """A row of registers for each set; sets aren't empty."""
    lens = np.array([len(s) for s in sets])
    start, every = np.cumsum(lens) - lens, np.concatenate(sets)
    least = np.empty((REGISTERS, len(sets)), np.uint64)
    shift = np.uint64(32)
    for i in range(REGISTERS):
        h = every ^ OFFSETS[i]
        h *= MULTIPLIERS[i]
        h >>= shift
        least[i] = np.minimum.reduceat(h, start)
    x = -np.log1p(-(least.T.astype(float) + 0.5) / 2**32) / RATE
    return np.clip(np.floor(1 - np.log(x) / np.log(BASE)), 0, LIMIT + 1).astype("<u2")


def band_keys(regs: np.ndarray) -> np.ndarray:
    out = np.tile(np.arange(1, BANDS + 1, dtype=np.uint64), (len(regs), 1))
    parts = regs.reshape(len(regs), BANDS, ROWS).astype(np.uint64)
    for j in range(ROWS):
        out = mix(out * np.uint64(0x9E3779B97F4A7C15) + parts[:, :, j])
    return out.view(np.int64)


GRID = np.linspace(0, 1, 201)


def likelihoods(larger: np.ndarray, smaller: np.ndarray, equal: np.ndarray, na: np.ndarray, nb: np.ndarray) -> np.ndarray:
    """Log-likelihood of each similarity of GRID, a row a pair; minus infinity where the sizes rule it out."""
    u, v = (na / (na + nb))[:, None], (nb / (na + nb))[:, None]
    share = lambda x: -np.log1p(-np.clip(x, 0, 1) * (BASE - 1) / BASE) / np.log(BASE)
    top = np.minimum(u / v, v / u)
    up, down = share(u - v * GRID), share(v - u * GRID)
    log = lambda x: np.log(np.maximum(x, 1e-12))
    out = larger[:, None] * log(up) + smaller[:, None] * log(down) + equal[:, None] * log(1 - up - down)
    return np.where(top + 1e-9 >= GRID, out, -np.inf)


def possible(ra: np.ndarray, rb: np.ndarray, na: np.ndarray, nb: np.ndarray, threshold: float) -> np.ndarray:
    ll = likelihoods((ra > rb).sum(1), (ra < rb).sum(1), (ra == rb).sum(1), na.astype(float), nb.astype(float))
    return ll[:, GRID >= threshold - 1e-9].max(1) >= ll.max(1) - DOUBT


def least_equal(threshold: float) -> int:
    """The fewest equal registers at which the threshold isn't exp(-DOUBT) times as likely as the share found, or less."""
    q = np.clip(np.arange(REGISTERS + 1) / REGISTERS, 1e-12, 1 - 1e-12)
    behind = REGISTERS * (q * np.log(q / threshold) + (1 - q) * np.log((1 - q) / max(1 - threshold, 1e-12)))
    return int(np.flatnonzero((behind <= DOUBT) | (q >= threshold))[0])


def sketched(docs: DataFrame, k: int) -> DataFrame:
    """doc_id, digest (of the set), n, regs, text_md5."""

    def run(batches):
        for ids, texts in chunks(batches, TEXT_BYTES):
            sets = shingle_sets(texts, k)
            some = [s for s in sets if len(s)]
            regs = iter(registers(some) if some else [])
            yield pa.RecordBatch.from_arrays(
                [pa.array(ids), pa.array([hashlib.blake2b(s.tobytes(), digest_size=16).digest() for s in sets], pa.binary()), pa.array([len(s) for s in sets], pa.int32()), pa.array([next(regs).tobytes() if len(s) else None for s in sets], pa.binary()), pa.array([hashlib.md5(t).digest() for t in texts], pa.binary())],
                names=["doc_id", "digest", "n", "regs", "text_md5"],
            )
        WORDS.clear()

    return docs.mapInArrow(run, "doc_id long, digest binary, n int, regs binary, text_md5 binary")


def _valued(one: DataFrame) -> DataFrame:
    """rep, values: the registers as an array."""

    def run(batches):
        for b in batches:
            regs = np.frombuffer(b"".join(b.column(1).to_pylist()), "<i2")
            yield pa.RecordBatch.from_arrays([b.column(0), pa.ListArray.from_arrays(pa.array(np.arange(b.num_rows + 1, dtype=np.int32) * REGISTERS), pa.array(regs))], names=["rep", "values"])

    return one.select("rep", "regs").mapInArrow(run, "rep long, values array<short>")


def _keyed(one: DataFrame) -> DataFrame:
    """rep, n, keys: a key for each band."""

    def run(batches):
        for b in batches:
            regs = np.frombuffer(b"".join(b.column(2).to_pylist()), "<u2").reshape(-1, REGISTERS)
            keys = pa.ListArray.from_arrays(pa.array(np.arange(len(regs) + 1, dtype=np.int32) * BANDS), pa.array(band_keys(regs).ravel()))
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), keys], names=["rep", "n", "keys"])

    return one.select("rep", "n", "regs").mapInArrow(run, "rep long, n int, keys array<long>")


def _sizes_fit(a: str, b: str, percent: int):
    """A necessary condition for a link: the smaller set is large enough."""
    return F.lit(100) * F.least(a, b).cast("long") >= F.lit(percent) * F.greatest(a, b).cast("long")


def _links(pairs: DataFrame, one: DataFrame, sets: DataFrame, percent: int, label: str) -> DataFrame:
    """Of pairs (a, b) those that are linked."""

    def likely(batches):
        for batch in batches:
            ra, rb = (np.frombuffer(b"".join(batch.column(i).to_pylist()), "<u2").reshape(-1, REGISTERS) for i in (4, 5))
            na, nb = (batch.column(i).to_numpy(zero_copy_only=False) for i in (2, 3))
            keep = [possible(ra[i : i + 2000], rb[i : i + 2000], na[i : i + 2000], nb[i : i + 2000], percent / 100) for i in range(0, len(na), 2000)]
            yield batch.select([0, 1]).filter(pa.array(np.concatenate(keep) if keep else np.zeros(0, bool)))

    def verified(batches):
        for batch in batches:
            keep = []
            for x, y in zip(batch.column(2), batch.column(3), strict=True):
                x, y = x.values.to_numpy(), y.values.to_numpy()
                both = len(x) + len(y) - len(np.union1d(x, y))
                keep.append(100 * both >= percent * (len(x) + len(y) - both))
            yield batch.select([0, 1]).filter(pa.array(keep, pa.bool_()))

    side = lambda t, s, *c: t.select(F.col("rep").alias(s), *[F.col(x).alias(x + s) for x in c])
    near = pairs.join(side(one, "a", "n", "regs"), "a").join(side(one, "b", "n", "regs"), "b").select("a", "b", "na", "nb", "regsa", "regsb").mapInArrow(likely, "a long, b long")
    near = cut(near, f"{label}-near")
    full = near.join(side(sets, "b", "set"), "b").join(side(sets, "a", "set"), "a").select("a", "b", "seta", "setb").mapInArrow(verified, "a long, b long")
    return cut(full, f"{label}-links")


def near_dedup(docs: DataFrame, k: int = 5, percent: int = 80, label: str = "op8") -> DataFrame:
    """doc_id, n_shingles, component_id, kept, chosen: a link is 100 * intersection >= percent * union of two sets of k-word shingles."""
    return near_judged(docs, k, percent, label).drop("text_md5")


def near_judged(docs: DataFrame, k: int = 5, percent: int = 80, label: str = "op8") -> DataFrame:
    """near_dedup's columns, and the text's MD5, which tells rows that share an id apart."""
    docs = plain(docs)
    every = cut(sketched(docs, k), f"{label}-sketches")
    # a set is a node, whatever ids its rows have; nodes are numbered as they are written
    same = every.filter("n > 0").groupBy("digest", "n").agg(F.min(F.struct("doc_id", "text_md5")).alias("first"), F.count(F.lit(1)).alias("size"))
    same = cut(same.withColumn("rep", F.monotonically_increasing_id()), f"{label}-same")
    one = every.join(same.select("digest", "first.doc_id", "first.text_md5", "rep"), ["digest", "doc_id", "text_md5"]).dropDuplicates(["rep"]).select("rep", "n", "regs")
    one = cut(one, f"{label}-one")
    keyed = cut(_keyed(one), f"{label}-keys")
    bands = keyed.select("rep", "n", F.posexplode("keys").alias("band", "key"))
    ends = bands.groupBy("key").agg(F.min(F.struct("rep", "n")).alias("low"), F.max(F.struct("rep", "n")).alias("high")).filter("low.rep <> high.rep")
    met = cut(bands.join(ends, "key"), f"{label}-met")
    # the texts of those that met anyone are read once more, for their full sets
    able = met.select("rep").distinct().join(same.select("rep", "first.doc_id", "first.text_md5"), "rep")

    def set_of(batches):
        for ids, texts in chunks(batches, TEXT_BYTES):
            own = shingle_sets(texts, k)
            ends = np.cumsum([0, *map(len, own)]).astype(np.int32)
            yield pa.RecordBatch.from_arrays([pa.array(ids), pa.ListArray.from_arrays(pa.array(ends), pa.array(np.concatenate(own).view(np.int64)))], names=["rep", "set"])
        WORDS.clear()

    sets = cut(docs.withColumn("text_md5", F.unhex(F.md5("text"))).join(able, ["doc_id", "text_md5"]).select("rep", "text").mapInArrow(set_of, "rep long, set array<long>").dropDuplicates(["rep"]), f"{label}-sets")

    def merged(links: DataFrame) -> DataFrame:
        return cut(components(links, f"{label}-stars"), f"{label}-components")

    def placed(to: DataFrame) -> DataFrame:
        """met with each set's component."""
        return met.join(to.withColumnRenamed("node", "rep"), "rep", "left").withColumn("component", F.coalesce("component", "rep"))

    def apart(rows: DataFrame) -> DataFrame:
        """Of placed() rows those whose bucket holds several components."""
        several = rows.groupBy("key").agg(F.min("component").alias("x"), F.max("component").alias("y")).filter("x <> y").select("key")
        return rows.join(several, "key", "left_semi")

    star = lambda rows, end: rows.filter((F.col("rep") != F.col(f"{end}.rep")) & _sizes_fit("n", f"{end}.n", percent))
    # each document with the smallest it met
    pairs = star(met, "low").groupBy(F.col("rep").alias("b")).agg(F.min("low.rep").alias("a"))
    links = _links(pairs, one, sets, percent, label)
    found = merged(links)
    # then with all that are smallest or largest in its buckets
    left = apart(placed(found))
    pairs = star(left, "low").select(F.col("low.rep").alias("a"), F.col("rep").alias("b")).unionByName(star(left, "high").select(F.col("rep").alias("a"), F.col("high.rep").alias("b"))).distinct()
    at = found.select(F.col("node").alias("a"), F.col("component").alias("ca")), found.select(F.col("node").alias("b"), F.col("component").alias("cb"))
    pairs = pairs.join(at[0], "a", "left").join(at[1], "b", "left").filter(F.coalesce("ca", "a") != F.coalesce("cb", "b")).select("a", "b")
    links = cut(links.unionByName(_links(pairs, one, sets, percent, label)), f"{label}-links")
    found = merged(links)
    # then those still apart, bucket by bucket, in the first band that two share; what comes out are links alone, however many pairs a bucket has
    left = apart(placed(found)).select("key", "band", "rep", "n", "component")
    left = left.join(keyed.select("rep", "keys"), "rep").join(sets, "rep").withColumn("lower", F.slice("keys", F.lit(1), F.col("band"))).drop("keys")
    left = left.join(_valued(one.join(left.select("rep").distinct(), "rep", "left_semi")), "rep")
    left = cut(left.select("key", "rep", "n", "component", "lower", "values", "set"), f"{label}-apart")
    x, y = left.alias("x"), left.alias("y")
    meet = (F.col("x.key") == F.col("y.key")) & (F.col("x.rep") < F.col("y.rep")) & (F.col("x.component") != F.col("y.component")) & _sizes_fit("x.n", "y.n", percent)
    equal = F.aggregate(F.zip_with("x.values", "y.values", lambda a, b: (a == b).cast("int")), F.lit(0), lambda s, e: s + e)
    both = F.size(F.array_intersect("x.set", "y.set")).cast("long")
    linked = F.lit(100 + percent) * both >= F.lit(percent) * (F.col("x.n") + F.col("y.n")).cast("long")
    late = x.join(y, meet & ~F.arrays_overlap("x.lower", "y.lower") & (equal >= least_equal(percent / 100)) & linked).select(F.col("x.rep").alias("a"), F.col("y.rep").alias("b"))
    found = merged(cut(links.unionByName(late), f"{label}-links"))
    for table in (one, keyed, met, sets, left):
        forget(table)
    place = same.join(found.withColumnRenamed("node", "rep"), "rep", "left").select("digest", "first", "size", F.coalesce("component", "rep").alias("component"))
    least = place.groupBy("component").agg(F.min("first").alias("least"))
    groups = cut(place.join(least, "component").select("digest", "size", "least"), f"{label}-groups", (same,))
    alone = every.filter("n = 0")
    alone = alone.withColumn("least", F.lit(None).cast(groups.schema["least"].dataType)).withColumn("size", F.lit(1).cast("long"))
    out = joined_back(every.filter("n > 0"), groups, "digest").unionByName(alone.select("digest", *every.drop("digest").columns, "size", "least"))
    component = F.coalesce("least.doc_id", "doc_id")
    chosen = F.coalesce((F.col("doc_id") == F.col("least.doc_id")) & (F.col("text_md5") == F.col("least.text_md5")), F.lit(True))
    return out.select(id_out(), F.col("n").cast("long").alias("n_shingles"), F.nullif(component, F.lit(NULL_ID)).alias("component_id"), (F.col("doc_id") == component).alias("kept"), chosen.alias("chosen"), "text_md5")
