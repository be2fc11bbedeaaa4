"""MinHash near-dedup (operator 10): one-permutation hashing, densified bins, banded buckets, star-shaped candidates.

Every text becomes its set of distinct word shingles. Texts whose whole sets have the same 128-bit BLAKE2 digest form one
class; one representative goes on.
One hash a shingle fills ``BINS`` bins with their least values; an empty bin takes the value of the non-empty bin that
comes first in the bin's own random order (optimal densification). ``BANDS`` bands of ``ROWS`` bins name the buckets: a
pair of similarity 0.8 shares none with probability (1 - 0.8**6)**42 = 3e-6.

A bucket of n members gives the n - 1 pairs of a star around its smallest id, never all pairs. Pairs are confirmed
on full shingle sets, and links are joined to components. Whatever a star could hide, a link between two members
other than its centre, is looked for in a second star around the member with the most links and, in buckets that still
hold several components, block by block inside tasks that hold two blocks of sets and skip pairs already connected.

Nulls: a null text has no words; such documents have an empty set, are linked with nothing and stay. A null ``doc_id``
gets a null component and stays. Repeated rows have equal sets and ids and are one document, of which ``drop_near_copies``
keeps one row if it keeps the document. Rows of one id with different texts are different documents: they are linked, kept
and dropped each by its own set. An empty table gives an empty result. Further columns do not matter to ``near_classes`` and
are kept by ``drop_near_copies``.
"""

from __future__ import annotations

import hashlib
import itertools
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm.common import connected_components, spill
from tidemark.llm.workers import lean
from tidemark.llm.words import bytes_of, mix, shingle_hashes, slices, word_hashes

BINS, ROWS, BANDS = 256, 6, 42
#: Pairs of a hot centre are dealt to so many tasks.
SALTS = 32
#: Members of a block, when a bucket is worked on block by block: of short signatures, and of sets.
WIDE, BLOCK = 1024, 256
#: Equal places of the ``BINS`` in two short signatures that a pair needs to be looked at on full sets. A pair of
#: similarity 0.8 has 205, with a deviation of 6.4.
AGREE = 150

_order = mix(np.arange(1, BINS * BINS + 1, dtype=np.uint64)).reshape(BINS, BINS)
_band_base = mix(np.arange(1, BANDS + 1, dtype=np.uint64) << np.uint64(20))


def signature(values: np.ndarray) -> np.ndarray:
    """The densified bins of a sorted, non-empty set of 64-bit hashes."""
    bins = (values >> np.uint64(56)).astype(np.int64)
    first = np.flatnonzero(np.r_[True, bins[1:] != bins[:-1]])
    full = bins[first]
    out = np.zeros(BINS, np.uint64)
    out[full] = values[first]
    if len(full) < BINS:
        empty = np.ones(BINS, bool)
        empty[full] = False
        gaps = np.flatnonzero(empty)
        out[gaps] = out[full[_order[np.ix_(gaps, full)].argmin(1)]]
    return out


def buckets(sig: np.ndarray) -> np.ndarray:
    out, sig = _band_base.copy(), sig[: BANDS * ROWS].reshape(BANDS, ROWS)
    for i in range(ROWS):
        out = mix(out + sig[:, i])
    return out.view(np.int64)


def shingle_sets(column: pa.Array, k: int) -> Iterator[np.ndarray]:
    """The sorted distinct shingle hashes of each text."""
    data, at = bytes_of(column)
    for i, j in slices(at):
        hashes, firsts, _, _ = word_hashes(data, at[i : j + 1])
        for a, b in zip(firsts[:-1], firsts[1:], strict=True):
            yield np.unique(shingle_hashes(hashes[a:b], k))


def _lists(rows: list[np.ndarray]) -> pa.Array:
    at = np.cumsum([0, *map(len, rows)])
    return pa.ListArray.from_arrays(pa.array(at, pa.int32()), pa.array(np.concatenate(rows) if rows else np.zeros(0, np.int64)))


def features(docs: DataFrame, k: int) -> DataFrame:
    def each(batches):
        for batch in batches:
            n, keys, bands, short = [], [], [], []
            for s in shingle_sets(batch.column(1), k):
                n.append(len(s))
                keys.append(key_of(s))
                sig = signature(s) if len(s) else s
                bands.append(buckets(sig) if len(s) else np.zeros(0, np.int64))
                short.append(mix(sig).astype(np.uint8).tobytes())
            columns = [batch.column(0), pa.array(n, pa.int64()), pa.array(keys, pa.binary()), _lists(bands), pa.array(short, pa.binary())]
            yield pa.RecordBatch.from_arrays(columns, names=["doc_id", "n", "key", "bands", "short"])

    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(lean(each), "doc_id long, n long, key binary, bands array<long>, short binary")


def key_of(values: np.ndarray) -> bytes:
    """A digest of a sorted set; equal for equal sets only."""
    return hashlib.blake2b(values.tobytes(), digest_size=16).digest()


def sets_of(docs: DataFrame, wanted: DataFrame, k: int) -> DataFrame:
    """``(id, shingles)`` of the classes in ``wanted(node, rep, key)``; only the texts of their representatives are worked on."""

    def each(batches):
        for batch in batches:
            ids, sets = [], []
            for node, key, s in zip(batch.column(0).to_pylist(), batch.column(2).to_pylist(), shingle_sets(batch.column(1), k), strict=True):
                if key == key_of(s):  # else another text of the same id
                    ids.append(node)
                    sets.append(s.view(np.int64))
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), _lists(sets)], names=["id", "shingles"])

    texts = docs.select(F.col("doc_id").cast("long").alias("rep"), "text").join(wanted.select("node", "rep", "key").hint("merge"), "rep")
    return texts.select("node", "text", "key").mapInArrow(lean(each), "id long, shingles array<long>")


def confirm(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """``pairs(u, v)`` to the links among them, on full sets.

    The set of a hot u is copied to as many tasks as its pairs are dealt to; of a pair, each set moves once.
    """
    salted = pairs.withColumn("salt", F.pmod(F.xxhash64("v"), F.lit(SALTS)))
    left = salted.select("u", "salt").distinct().join(sets.toDF("u", "su"), "u")
    right = salted.join(sets.toDF("v", "sv"), "v")
    both = F.size(F.array_intersect("su", "sv"))
    every = F.size("su") + F.size("sv") - F.col("both")
    return right.join(left, ["u", "salt"]).select("u", "v", both.alias("both"), "su", "sv").where(F.col("both") * 100 >= every * percent).select("u", "v")


def stars(members: DataFrame, centers: DataFrame, percent: int) -> DataFrame:
    """Distinct pairs of a bucket's centre and its members whose set sizes allow a link. ``centers(bucket, center, center_n)``."""
    pairs = members.join(centers, "bucket").where("id <> center")
    fits = F.least("n", "center_n") * 100 >= F.greatest("n", "center_n") * percent
    return pairs.where(fits).select(F.col("center").alias("u"), F.col("id").alias("v")).distinct()


def dealt_in_blocks(rest: DataFrame, values: DataFrame, size: int) -> DataFrame:
    """``rest(bucket, id, component)`` with ``values(id, ...)``, each bucket cut into blocks and each pair of blocks (i, j) put together."""
    sizes = spill(rest.groupBy("bucket").agg(F.count(F.lit(1)).alias("size"), F.sum(F.xxhash64("id").cast("decimal(38,0)")).alias("content")), "sizes")
    once = sizes.groupBy("content", "size").agg(F.min("bucket").alias("bucket"))
    blocked = rest.join(once, "bucket").join(values, "id").withColumn("blocks", F.ceil(F.col("size") / size).cast("int"))
    blocked = blocked.withColumn("own", F.pmod(F.xxhash64("id"), F.col("blocks")).cast("int")).withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    return blocked.select("bucket", F.least("own", "other").alias("i"), F.greatest("own", "other").alias("j"), "own", "id", "component", *[c for c in values.columns if c != "id"])


def _sorted(group: pa.Table) -> pa.Table:
    return group.sort_by("id").combine_chunks()


def likely(rest: DataFrame, shorts: DataFrame) -> DataFrame:
    """The rows of ``rest`` that by their short signatures may have a link to a member of another component; no pair is emitted."""

    def each(group: pa.Table) -> pa.Table:
        group = _sorted(group)
        sig = np.frombuffer(b"".join(group["short"].to_pylist()), np.uint8).reshape(len(group), BINS)
        comp, own = group["component"].to_numpy(), group["own"].to_numpy()
        across, hit = group["i"][0] != group["j"][0], np.zeros(len(group), bool)
        for x in range(1, len(group)):
            near = ((sig[:x] == sig[x]).sum(1) >= AGREE) & (comp[:x] != comp[x])
            if across:
                near &= own[:x] != own[x]
            hit[:x] |= near
            hit[x] |= near.any()
        return group.select(["bucket", "id", "component"]).filter(pa.array(hit))

    return dealt_in_blocks(rest, shorts, WIDE).groupBy("bucket", "i", "j").applyInArrow(each, "bucket long, id long, component long").distinct()


def block_links(rest: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """Links between members of different components in the buckets ``rest(bucket, id, component)``; only links are emitted."""

    def each(group: pa.Table) -> pa.Table:
        group = _sorted(group)
        own, ids, comps = (group[c].to_numpy() for c in ("own", "id", "component"))
        lists = group["shingles"].combine_chunks()
        values, at = lists.values.to_numpy(), lists.offsets.to_numpy()
        top, found = dict(zip(c := comps.tolist(), c, strict=True)), []

        def root(x):
            while top[x] != x:
                x = top[x]
            return x

        across, sizes = group["i"][0] != group["j"][0], np.diff(at)
        for x in range(len(ids)):
            for y in range(x):
                if (across and own[x] == own[y]) or (a := root(c[x])) == (b := root(c[y])):
                    continue
                m, n = sorted((int(sizes[x]), int(sizes[y])))
                if 100 * m < percent * n:
                    continue
                both = len(np.intersect1d(values[at[x] : at[x + 1]], values[at[y] : at[y + 1]], assume_unique=True))
                if 100 * both >= percent * (m + n - both):
                    found.append((int(ids[y]), int(ids[x])))
                    top[a] = b
        return pa.table({"u": pa.array([f[0] for f in found], pa.int64()), "v": pa.array([f[1] for f in found], pa.int64())})

    return dealt_in_blocks(rest, sets, BLOCK).groupBy("bucket", "i", "j").applyInArrow(each, "u long, v long")


def numbered(classes: DataFrame) -> DataFrame:
    """``classes(key, rep)`` with a number of its own, ``node``, for each: its ``rep``, unless that id has several texts; then a hash that no other has."""
    several = spill(classes.groupBy("rep").agg(F.count(F.lit(1)).alias("texts")).where("texts > 1"), "several")
    if several.isEmpty():
        return classes.withColumn("node", F.col("rep"))
    marked = classes.join(several, "rep", "left")
    for seed in itertools.count():
        out = spill(marked.select("key", "rep", F.when(F.col("texts").isNull(), F.col("rep")).otherwise(F.xxhash64("rep", "key", F.lit(seed))).alias("node")), "numbered")
        if out.groupBy("node").agg(F.count(F.lit(1)).alias("n")).where("n > 1").isEmpty():
            return out


def _with_missing(sets: DataFrame, docs: DataFrame, classes: DataFrame, ids: DataFrame, k: int) -> DataFrame:
    """``sets`` and those of further ids; a pair that sizes excluded with every centre has none yet."""
    missing = spill(ids.distinct().join(sets.select("id"), "id", "left_anti"), "missing")
    return sets if missing.isEmpty() else sets.union(spill(sets_of(docs, _named(classes, missing), k), "sets"))


def _named(classes: DataFrame, ids: DataFrame) -> DataFrame:
    return classes.join(ids.withColumnRenamed("id", "node"), "node", "left_semi")


def _apart(members: DataFrame, components: DataFrame) -> DataFrame:
    """The members of buckets that hold several components: ``(bucket, id, n, component)``."""
    named = members.join(components.toDF("id", "component"), "id", "left").withColumn("component", F.coalesce("component", "id"))
    split = named.groupBy("bucket").agg(F.min("component").alias("a"), F.max("component").alias("b")).where("a <> b").select("bucket")
    return named.join(split, "bucket", "left_semi")


def near_classes(docs: DataFrame, k: int = 5, percent: int = 80) -> DataFrame:
    """``docs(doc_id, text, ...)`` to ``(doc_id, n_shingles, component_id, kept, set_key)``, one row per row of ``docs``.

    Documents are linked if 100 * |A & B| >= ``percent`` * |A | B| for their sets of ``k``-word shingles. ``set_key`` is the
    digest of a row's set; ``kept`` is true for the rows of the id that names their component.
    """
    feats = spill(features(docs, k), "features")
    known = feats.where("n > 0 AND doc_id IS NOT NULL")
    classes = spill(numbered(spill(known.groupBy("key").agg(F.min("doc_id").alias("rep")), "classes")), "classes")
    reps = known.join(classes.toDF(*("rep_key" if c == "key" else c for c in classes.columns)), (F.col("doc_id") == F.col("rep")) & (F.col("key") == F.col("rep_key")))
    reps = reps.select(F.col("node").alias("id"), "n", "bands", "short").dropDuplicates(["id"])
    rows = reps.select(F.explode("bands").alias("bucket"), "id", "n")
    centers = rows.groupBy("bucket").agg(F.min(F.struct("id", "n")).alias("c"), F.count(F.lit(1)).alias("size")).where("size > 1")
    centers = spill(centers.select("bucket", F.col("c.id").alias("center"), F.col("c.n").alias("center_n"), "size"), "centers")
    members = spill(rows.join(centers, "bucket"), "members")
    pairs = spill(stars(members.select("bucket", "id", "n"), centers.drop("size"), percent), "pairs")
    sets = spill(sets_of(docs, _named(classes, pairs.select(F.col("u").alias("id")).union(pairs.select("v")).distinct()), k), "sets")
    links = spill(confirm(pairs, sets, percent), "links")
    components = connected_components(links)

    # Buckets of two are decided. In larger ones a link may be hidden behind the centre.
    larger = members.where("size > 2").select("bucket", "id", "n")
    rest = spill(_apart(larger, components), "rest")
    if not rest.isEmpty():
        degree = links.select("u").union(links.select("v")).groupBy(F.col("u").alias("id")).agg(F.count(F.lit(1)).alias("degree"))
        ranked = rest.join(degree, "id", "left").withColumn("degree", F.coalesce("degree", F.lit(0)))
        best = spill(ranked.groupBy("bucket").agg(F.max(F.struct("degree", "id", "n")).alias("c")).select("bucket", F.col("c.id").alias("center"), F.col("c.n").alias("center_n")), "centers")
        more = stars(rest.select("bucket", "id", "n"), best, percent).select(F.least("u", "v").alias("u"), F.greatest("u", "v").alias("v")).distinct()
        more = spill(more.join(pairs, ["u", "v"], "left_anti"), "pairs")
        sets = _with_missing(sets, docs, classes, more.select(F.col("u").alias("id")).union(more.select("v")), k)
        links = links.union(spill(confirm(more, sets, percent), "links"))
        components = connected_components(links)
        rest = _apart(larger, components).select("bucket", "id", "component")
        rest = spill(likely(spill(rest, "rest"), reps.select("id", "short")), "rest")
        if not rest.isEmpty():
            sets = _with_missing(sets, docs, classes, rest.select("id"), k)
            found = spill(block_links(rest, sets, percent), "links")
            if not found.isEmpty():
                components = connected_components(links.union(found))

    # A component bears the smallest id in it, which is its number unless an id has several texts.
    linked = spill(components.toDF("node", "component").join(classes, "node"), "linked")
    least = linked.groupBy("component").agg(F.min("rep").alias("component_id"))
    named = spill(classes.select("key", "node", "rep").join(linked.join(least, "component").select("node", "component_id"), "node", "left").select("key", F.coalesce("component_id", "rep").alias("component_id")), "named")
    # A large class is a hot key here; both sides are spilled, so AQE can split it.
    out = feats.select("doc_id", "n", "key").join(named, "key", "left")
    component = F.when(F.col("n") > 0, F.col("component_id")).otherwise(F.col("doc_id"))
    component = F.when(F.col("doc_id").isNotNull(), component)
    return out.select("doc_id", F.col("n").alias("n_shingles"), component.alias("component_id"), F.col("key").alias("set_key")).withColumn("kept", F.col("doc_id").eqNullSafe(F.col("component_id")))


def drop_near_copies(docs: DataFrame, k: int = 5, percent: int = 80) -> DataFrame:
    """``docs`` with one document, the one with the smallest id, of each component; rows without an id or words stay as they are."""
    mine = f"__key_{'_'.join(docs.columns)}"  # no column of ``docs``

    @F.arrow_udf("binary")
    def key(text: pa.Array) -> pa.Array:
        return pa.array([key_of(s) for s in shingle_sets(text, k)], pa.binary())

    found = spill(near_classes(docs, k, percent), "near")
    gone = found.where("not kept").select(F.col("doc_id").alias("gone_id"), F.col("set_key").alias("gone_key")).distinct()
    # What is left twice: rows of one id and set, of which the component needs one.
    again = found.where("kept AND n_shingles > 0 AND doc_id IS NOT NULL").groupBy(F.col("doc_id").alias("gone_id"), F.col("set_key").alias("gone_key")).agg(F.count(F.lit(1)).alias("rows")).where("rows > 1").drop("rows")
    gone, again = spill(gone, "gone"), spill(again, "again")
    touched = gone.select("gone_id").union(again.select("gone_id")).distinct()
    one = docs.join(touched, docs["doc_id"] == touched["gone_id"], "left_anti")
    rest = docs.join(touched, docs["doc_id"] == touched["gone_id"], "left_semi").withColumn(mine, key("text"))
    same = lambda t: (rest["doc_id"] == t["gone_id"]) & (rest[mine] == t["gone_key"])
    rest = rest.join(gone, same(gone), "left_anti")
    if again.isEmpty():
        return one.unionByName(rest.drop(mine))
    return one.unionByName(rest.join(again, same(again), "left_anti").drop(mine)).unionByName(rest.join(again, same(again), "left_semi").dropDuplicates(["doc_id", mine]).drop(mine))


def op10_minhash_near_dedup(spark, sf_dir: str) -> DataFrame:
    """Two-word shingles, as its contract says."""
    return near_classes(spark.read.parquet(f"{sf_dir}/documents.parquet"), k=2)
