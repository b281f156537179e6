"""Near-duplicate documents: b-bit MinHash signatures in a multi-index Hamming join, links confirmed on full shingle sets.

A signature has SYMBOLS minima of 16 bits each. Two documents of similarity 0.8
differ in 9.6 +- 2.8 of 48 symbols; T = 22 is 4.5 deviations out (a miss has a
chance of about 1e-5 at exactly 0.8). By the pigeonhole principle a pair within T
agrees on one of 16 chunks of 3 symbols up to the errors allowed there: one error
in ONE_ERROR chunks (all keys with one symbol blanked), none in the others, for
7 * 2 + 9 * 1 = T + 1. So all pairs within T share a key.

Documents of one shingle set are one class before anything is paired. Classes that
share a key are joined to groups such that all pairs within T lie in one group: the
members of a key by their distance to its least class, then members of several
groups in one key by one pair for any two groups. A group's links are confirmed
against a pivot, the member that shares keys with most others, which settles most of its members;
the strays among them are compared with the whole group in blocks (dense product
of common shingles, inverted lists of rare ones), of which only links between
different components come out. So n near copies cost n confirmations and a little
more for each stray, and no link between components is lost.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import Prefix, buffer_of, chunks, discard, map_batches, mix, row_keys, signed, stored, table, text_or_empty, words_of

SYMBOLS, CHUNK_SYMBOLS, ONE_ERROR, T = 48, 3, 7, 22
#: Members of a block in which signatures are compared, bytes of a block of sets.
BLOCK, BLOCK_BYTES = 1000, 4 << 20
PARTS = tuple(np.uint64(x) for x in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93, 0xA0761D6478BD642F, 0xE7037ED1A0B428DB, 0x8EBC6AF09C88C6E3, 0x589965CC75374CC3))


def shingles_of(data: np.ndarray, offsets: np.ndarray, words: int) -> tuple[np.ndarray, np.ndarray]:
    """Shingle hashes of the texts of a chunk, and the texts' offsets in them: repeats included, A-Z lower-cased."""
    upper = (data >= 65) & (data <= 90)
    data = np.where(upper, data + np.uint8(32), data)
    starts, ends = words_of(data, offsets)
    prefix = Prefix(data)
    h = mix(prefix.of(starts, ends) + (ends - starts).astype(np.uint64))
    upto = np.searchsorted(starts, offsets)  # words before each text
    n = np.diff(upto)
    full = np.maximum(n - words + 1, 0)
    count = np.where((n > 0) & (full == 0), 1, full)
    to = np.concatenate([[0], np.cumsum(count)])
    at = np.arange(to[-1]) - np.repeat(to[:-1] - upto[:-1], count)
    left = np.repeat(np.minimum(n, words), count)
    out = left.astype(np.uint64) * PARTS[7]
    for k in range(words):
        use = left > k
        out[use] += mix(h[at[use] + k] + PARTS[k % 8]) * (PARTS[(k + 3) % 8] + np.uint64(2 * k))
    return mix(out), to


def signatures(h: np.ndarray, to: np.ndarray) -> np.ndarray:
    """Rows of SYMBOLS 16-bit minima for the texts that have shingles."""
    rng = np.random.default_rng(5)
    factor, add = rng.integers(1, 2**63, SYMBOLS, dtype=np.uint64) * np.uint64(2) + np.uint64(1), rng.integers(0, 2**63, SYMBOLS, dtype=np.uint64)
    some = np.flatnonzero(np.diff(to) > 0)
    out = np.zeros((len(to) - 1, SYMBOLS), np.uint16)
    if len(some):
        for k in range(SYMBOLS):
            out[some, k] = (mix(np.minimum.reduceat(h * factor[k] + add[k], to[some])) >> np.uint64(48)).astype(np.uint16)
    return out


def keys_of(sig: np.ndarray) -> np.ndarray:
    """The keys of each signature under which it meets all others within T."""
    out = []
    wide = sig.astype(np.uint64)
    for c in range(SYMBOLS // CHUNK_SYMBOLS):
        own = [wide[:, c * CHUNK_SYMBOLS + i] for i in range(CHUNK_SYMBOLS)]
        for blank in range(CHUNK_SYMBOLS) if c < ONE_ERROR else (None,):
            value = np.full(len(sig), c * 8 + (7 if blank is None else blank), np.uint64)
            for i in range(CHUNK_SYMBOLS):
                value = value << np.uint64(16) | (own[i] if i != blank else np.uint64(0))
            out.append(mix(value))
    return np.stack(out, axis=1)


def _features(words: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            _, all_offsets = buffer_of(batch.column(3))
            for i, j in chunks(all_offsets):
                part = batch.slice(i, j - i)
                data, offsets = buffer_of(part.column(3))
                h, to = shingles_of(data, offsets, words)
                sig = signatures(h, to)
                n, s1, s2 = np.zeros(len(part), np.int64), np.zeros(len(part), np.uint64), np.zeros(len(part), np.uint64)
                for r in np.flatnonzero(np.diff(to)):
                    u = np.unique(h[to[r] : to[r + 1]])
                    n[r], s1[r], s2[r] = len(u), mix(u).sum(), mix(u ^ PARTS[2]).sum()
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), part.column(2), pa.array(n), pa.array(signed(s1)), pa.array(signed(s2)), pa.array([x.tobytes() for x in sig], pa.binary())], names=["doc_id", "k1", "k2", "n_shingles", "s1", "s2", "sig"])

    return run


def _keys(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for i in range(0, len(batch), 2000):
            part = batch.slice(i, 2000)
            data, _ = buffer_of(part.column(1))
            keys = keys_of(data.view(np.uint16).reshape(-1, SYMBOLS))
            c = np.repeat(part.column(0).to_numpy(), keys.shape[1])
            yield pa.RecordBatch.from_arrays([pa.array(signed(np.ascontiguousarray(keys).ravel())), pa.array(c)], names=["key", "c"])


def _sets(words: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            _, all_offsets = buffer_of(batch.column(1))
            for i, j in chunks(all_offsets):
                part = batch.slice(i, j - i)
                data, offsets = buffer_of(part.column(1))
                h, to = shingles_of(data, offsets, words)
                sets = [np.unique(h[a:b]).tobytes() for a, b in zip(to[:-1], to[1:], strict=True)]
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(sets, pa.binary())], names=["c", "own"])

    return run


def _confirm(percent: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            xs, ys = batch.column(0).to_numpy(), batch.column(1).to_numpy()
            ok = np.zeros(len(batch), bool)
            for i in range(len(batch)):
                a, b = (np.frombuffer(batch.column(c)[i].as_buffer(), np.uint64) for c in (2, 3))
                both = np.concatenate([a, b])
                both.sort()
                shared = int((both[1:] == both[:-1]).sum())
                ok[i] = 100 * shared >= percent * (len(both) - shared)
            yield pa.RecordBatch.from_arrays([pa.array(xs[ok]), pa.array(ys[ok])], names=["x", "y"])

    return run


def _near(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Pairs of two blocks within T and of different components. Columns: a, b (blocks of c, l, sig)."""
    for batch in batches:
        for one, two in zip(batch.column(0), batch.column(1), strict=True):
            side = []
            for block in (one, two):
                v = block.values
                sig = np.frombuffer(b"".join(v.field("sig").to_pylist()), np.uint16).reshape(-1, SYMBOLS)
                side.append((v.field("c").to_numpy(), v.field("l").to_numpy(), sig))
            (c1, l1, s1), (c2, l2, s2) = side
            xs, ys, ds, lx, ly = [], [], [], [], []
            for i in range(len(c1)):
                j = np.flatnonzero((l2 != l1[i]) & (c2 != c1[i]))
                d = (s2[j] != s1[i]).sum(axis=1)
                j, d = j[d <= T], d[d <= T]
                xs.append(np.full(len(j), c1[i]))
                lx.append(np.full(len(j), l1[i]))
                ys.append(c2[j])
                ly.append(l2[j])
                ds.append(d)
            x, y, d, p, q = (np.concatenate(v).astype(np.int64) for v in (xs, ys, ds, lx, ly))
            o = np.lexsort((d, q, p))  # one pair for two groups is enough
            head = o[np.concatenate([[True], (p[o][1:] != p[o][:-1]) | (q[o][1:] != q[o][:-1])])] if len(o) else o
            yield pa.RecordBatch.from_arrays([pa.array(x[head]), pa.array(y[head])], names=["x", "y"])


def shared_counts(a: list[np.ndarray], b: list[np.ndarray]) -> np.ndarray:
    """Sizes of all intersections of the sorted sets a[i], b[j]: values in most of b by a dense product, the others by inverted lists."""
    values = np.concatenate(b)
    owner = np.repeat(np.arange(len(b)), [len(x) for x in b])
    o = np.argsort(values, kind="stable")
    values, owner = values[o], owner[o]
    head = np.flatnonzero(np.concatenate([[True], values[1:] != values[:-1]]))
    distinct, n = values[head], np.diff(np.concatenate([head, [len(values)]]))
    dense = np.flatnonzero(n > len(b) / 2)
    column = np.full(len(distinct), -1)
    column[dense] = np.arange(len(dense))
    which = np.repeat(column, n)
    has = np.zeros((len(b), len(dense)), np.float32)
    has[owner[which >= 0], which[which >= 0]] = 1
    wants = np.zeros((len(a), len(dense)), np.float32)
    out = np.zeros((len(a), len(b)), np.int64)
    for i, x in enumerate(a):
        at = np.searchsorted(distinct, x)
        there = at < len(distinct)
        there[there] = distinct[at[there]] == x[there]
        at = at[there]
        c = column[at]
        wants[i, c[c >= 0]] = 1
        rare = at[c < 0]
        span = n[rare]
        index = np.repeat(head[rare] - (np.cumsum(span) - span), span) + np.arange(span.sum())
        out[i] = np.bincount(owner[index], minlength=len(b))
    return out + np.rint(wants @ has.T).astype(np.int64)


def _across(percent: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Links between two blocks of (c, l, own), one for any two components l."""
        for batch in batches:
            for one, two in zip(batch.column(0), batch.column(1), strict=True):
                (c1, l1, s1), (c2, l2, s2) = ((v.field("c").to_numpy(), v.field("l").to_numpy(), [np.frombuffer(x, np.uint64) for x in v.field("own").to_pylist()]) for v in (one.values, two.values))
                both = shared_counts(s1, s2)
                union = np.array([len(x) for x in s1])[:, None] + np.array([len(x) for x in s2])[None, :] - both
                i, j = np.nonzero((100 * both >= percent * union) & (l1[:, None] != l2[None, :]))
                _, first = np.unique(np.stack([l1[i], l2[j]], axis=1), axis=0, return_index=True)
                yield pa.RecordBatch.from_arrays([pa.array(c1[i[first]]), pa.array(c2[j[first]])], names=["x", "y"])

    return run


def components(edges: DataFrame) -> DataFrame:
    """(c, l): a name l for the component of each node of (x, y) edges; every name is one of its nodes.

    Nodes are merged into their least neighbour, twice by number (which settles stars),
    then by hashes that change each time (which halves chains), until no edge is left.
    """
    pair = lambda a, b: edges.select(F.col(a).alias("c"), F.col(b).alias("o"))
    rest = stored(pair("x", "y").unionByName(pair("y", "x")).distinct())
    label, level = None, 0
    while True:
        if level < 2:
            merged = rest.groupBy("c").agg(F.least("c", F.min("o")).alias("l"))
        else:
            rank = lambda c: F.xxhash64(F.col(c), F.lit(level))  # noqa: B023, E731
            least = rest.groupBy("c").agg(F.min(F.struct(rank("o").alias("r"), F.col("o"))).alias("m"))
            merged = least.select("c", F.when(F.col("m.r") < rank("c"), F.col("m.o")).otherwise(F.col("c")).alias("l"))
        merged = stored(merged)
        if label is None:
            label = merged
        else:
            above = merged.select(F.col("c").alias("l"), F.col("l").alias("m"))
            label = label.join(above, "l", "left").select("c", F.coalesce("m", "l").alias("l"))
        met = rest.join(merged, "c").select(F.col("l").alias("a"), F.col("o").alias("c")).join(merged, "c").select(F.col("a").alias("c"), F.col("l").alias("o"))
        left = stored(met.where("c <> o").distinct())
        discard(rest)
        rest = left
        level += 1
        if rest.isEmpty():
            return stored(label) if level > 1 else label


def near_duplicates(docs: DataFrame, words: int = 5, percent: int = 80, id_col: str = "doc_id", text_col: str = "text", by_row: bool = False) -> DataFrame:
    """Component of every document under links of similarity ``percent`` / 100 or more on sets of ``words``-word shingles.

    Returns doc_id, n_shingles, component_id (least doc_id reachable) and kept (doc_id =
    component_id), and if asked for ``by_row`` k1, k2 (row_keys of doc_id and text) and ``group``, the
    component whatever its doc_ids are, null without shingles. Texts with fewer words are one shingle; null, empty and blank texts
    have none and link with nothing; null doc_ids are passed over in the least one;
    repeated rows are all returned, and rows that tie for the least doc_id are all kept;
    other columns, whatever their names, aren't read; texts of any length are read whole;
    an empty table gives no rows.
    """
    spark = docs.sparkSession
    texts = docs.select(F.col(id_col).cast("long").alias("doc_id"), text_or_empty(text_col).alias("text")).select("doc_id", *row_keys("doc_id", "text"), "text")
    rows = stored(map_batches(texts, _features(words), "doc_id long, k1 long, k2 long, n_shingles long, s1 long, s2 long, sig binary"))
    classes = rows.where("n_shingles > 0").groupBy("s1", "s2").agg(F.min("doc_id").alias("least"), F.min(F.struct("k1", "k2")).alias("k"), F.min("sig").alias("sig"))
    classes = stored(classes.select("s1", "s2", "least", "k.*", "sig").withColumn("c", F.monotonically_increasing_id()))

    keys = stored(map_batches(classes.select("c", "sig"), _keys, "key long, c long"))
    heads = keys.groupBy("key").agg(F.min("c").alias("p"), F.count("*").alias("n")).where("n > 1")
    crowd = stored(keys.join(heads, "key"))
    discard(keys)
    sig = classes.select("c", "sig")

    def apart(s: str, t: str) -> Column:
        return F.expr(f"aggregate(sequence(0, {SYMBOLS - 1}), 0, (a, i) -> a + int(substring({s}, 2 * i + 1, 2) <> substring({t}, 2 * i + 1, 2)))")

    stars = crowd.where("c <> p").select("p", "c").distinct()
    stars = stars.join(sig.withColumnRenamed("sig", "t"), "c").join(sig.select(F.col("c").alias("p"), F.col("sig").alias("s")), "p").where(apart("s", "t") <= T)
    group = components(stored(stars.select(F.col("p").alias("x"), F.col("c").alias("y"))))

    def labelled(df: DataFrame, label: DataFrame, name: str = "c", to: str = "l") -> DataFrame:
        return df.join(label.select(F.col("c").alias(name), F.col("l").alias(to)), name, "left").withColumn(to, F.coalesce(to, name))

    # Groups: keys whose members are in several groups still may join these.
    told = labelled(crowd.select("key", "c"), group)
    by_label = told.groupBy("key", "l").agg(F.count("*").alias("n"))
    mixed = stored(by_label.groupBy("key").agg(F.count("*").alias("labels"), F.sum("n").alias("n"), F.max(F.struct("n", "l")).alias("top")).where("labels > 1").select("key", "n", F.col("top.l").alias("major")))
    members = told.join(mixed, "key").join(sig, "c").withColumn("minor", F.col("l") != F.col("major"))
    members = members.withColumn("salt", F.pmod(F.xxhash64("c"), F.ceil(F.col("n") / BLOCK)))
    blocks = stored(members.groupBy("key", "minor", "salt").agg(F.collect_list(F.struct("c", "l", "sig")).alias("m")))
    left = blocks.where("minor").select("key", F.col("salt").alias("sa"), F.col("m").alias("a"))
    met_blocks = left.join(blocks.select("key", "minor", "salt", F.col("m").alias("b")), "key").where("not minor or sa <= salt").select("a", "b")
    joined = stored(map_batches(met_blocks, _near, "x long, y long"))
    discard(blocks, mixed)
    if not joined.isEmpty():
        alone = joined.select(F.col("x").alias("c")).unionByName(joined.select(F.col("y").alias("c"))).distinct().join(group, "c", "left_anti")
        between = labelled(labelled(joined, group, "x", "lx"), group, "y", "ly").select(F.col("lx").alias("x"), F.col("ly").alias("y")).distinct()
        group = labelled(group.unionByName(alone.withColumn("l", F.col("c"))), components(between), "l", "g")
    else:
        group = group.withColumn("g", F.col("l"))
    # The pivot of a group: the member that meets most others under its keys.
    known = crowd.groupBy("c").agg(F.sum("n").alias("meets"))
    group = stored(group.select("c", "g").join(known, "c"))
    pivots = stored(group.groupBy("g").agg(F.max(F.struct("meets", "c")).alias("m")).select("g", F.col("m.c").alias("p")))
    discard(crowd)

    # Whole sets of the classes in groups, from one of their texts. Repeated rows are one before they are shuffled.
    chosen = group.select("c").join(classes.select("c", "k1", "k2"), "c")
    owners = texts.select("k1", "k2", "text").dropDuplicates(["k1", "k2"]).join(chosen, ["k1", "k2"]).select("c", "text")
    sets = stored(map_batches(owners, _sets(words), "c long, own binary"))

    # Links to the pivot: they are stars, so a pivot is its component's name.
    spokes = group.join(pivots, "g").where("c <> p").select(F.col("p").alias("x"), F.col("c").alias("y"))
    a, b = sets.select(F.col("c").alias("x"), F.col("own").alias("a")), sets.select(F.col("c").alias("y"), F.col("own").alias("b"))
    links = stored(map_batches(spokes.join(a, "x").join(b, "y").select("x", "y", "a", "b"), _confirm(percent), "x long, y long"))
    label = links.select(F.col("y").alias("c"), F.col("x").alias("l"))

    # Members outside their pivot's component against the whole group.
    placed = labelled(group.select("c", "g").join(pivots, "g"), label).select("c", "g", "l", (F.col("l") != F.col("p")).alias("stray"))
    open_ = stored(placed.groupBy("g").agg(F.sum(F.col("stray").cast("long")).alias("strays"), F.count("*").alias("n")).where("strays > 0 and n > 2").select("g"))
    full = stored(placed.join(open_, "g").join(sets, "c").withColumn("size", F.length("own").cast("long")))
    sizes = stored(full.groupBy("g").agg(F.ceil(F.sum("size") / BLOCK_BYTES).alias("salts")))
    salted = full.join(sizes, "g").withColumn("salt", F.pmod(F.xxhash64("c"), F.col("salts"))).drop("size", "salts")
    packed = stored(salted.repartition("g", "stray", "salt").groupBy("g", "stray", "salt").agg(F.collect_list(F.struct("c", "l", "own")).alias("m")))
    discard(full, sets)
    left = packed.where("stray").select("g", F.col("salt").alias("sa"), F.col("m").alias("a"))
    pairs = left.join(packed.select("g", "stray", "salt", F.col("m").alias("b")), "g").where("not stray or sa <= salt").select("a", "b")
    more = stored(map_batches(pairs.repartition(max(8, spark.sparkContext.defaultParallelism)), _across(percent), "x long, y long"))
    discard(packed)
    named = labelled(classes.select("c", "s1", "s2", "least"), label)
    if not more.isEmpty():
        between = labelled(labelled(more, label, "x", "lx"), label, "y", "ly").select(F.col("lx").alias("x"), F.col("ly").alias("y")).distinct()
        named = labelled(named.withColumnRenamed("l", "l1"), components(between), "l1", "l")
    named = stored(named.select("s1", "s2", "least", "l"))
    of_class = named.join(named.groupBy("l").agg(F.min("least").alias("component_id")), "l").select("s1", "s2", "component_id", F.col("l").alias("group"))
    more = ["k1", "k2", "group"] if by_row else []
    out = rows.select("doc_id", "n_shingles", "s1", "s2", *more[:2]).withColumn("some", F.col("n_shingles") > 0).join(of_class.withColumn("some", F.lit(True)), ["s1", "s2", "some"], "left")
    out = out.withColumn("component_id", F.coalesce("component_id", "doc_id"))
    return out.select("doc_id", "n_shingles", "component_id", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(False)).alias("kept"), *more)


def op2_minhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """:func:`near_duplicates` with four-word shingles over all of documents, one row a row: doc_id, n_shingles, component_id, kept."""
    return near_duplicates(table(spark, sf_dir, "documents"), words=4)
