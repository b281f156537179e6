"""Removal of repeated byte strings, by a hash-compared suffix sort.

Every string of LENGTH bytes has an anchor: the start of its K-gram of least
hash (leftmost of equals). Equal strings have equal anchors at equal distance,
so strings are compared only where their anchors' K-grams agree. Per anchor:

1. A K-gram seen once can't repeat: its strings are done. One aggregate with
   map-side combining settles these.
2. Anchors of the others are grouped by context (a hash of the bytes of all of
   their strings). Of each context the first occurrence has its bytes fetched if the
   K-gram has several contexts, and its suffixes are sorted per K-gram: a merge sort
   that ranks by binary search and compares two suffixes in O(log n) by searching
   the longest common extension with prefix polynomial hashes; the extensions of
   neighbours in sorted order are then verified byte by byte.
3. Every further occurrence of a context claims to equal the first one, its witness.
   Claims are joined to runs, the witness's bytes are sent to the claimant and
   compared there: what differs is not removed. So no byte goes on a hash alone.
4. K-grams with over MOST contexts have their strings grouped one by one instead of
   sorted in one task, and claim against witnesses as in 3: the same strings are found.

No task gathers an unbounded group: groups are aggregates with map-side combining,
sorted groups are bounded by MOST, and claims are gathered by claimant.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import Prefix, buffer_of, chunks, discard, map_batches, mix, row_keys, signed, stored, table, text_or_empty

LENGTH, K = 200, 64
#: Contexts of one K-gram that are sorted in one task; bytes sorted at once.
MOST, SORTED = 20_000, 4 << 20
#: Last start of a run that covers any text.
WHOLE = 1 << 40
#: ``place`` packs the anchor's byte and the distances of its first and last string: a << 16 | dlo << 8 | dhi.
ANCHOR = "key long, ctx long, k1 long, k2 long, place long"


def sliding_min(x: np.ndarray, width: int) -> np.ndarray:
    """Minimum of each ``width`` neighbours, by doubling."""
    have, step = x, 1
    while step * 2 <= width:
        have = np.minimum(have[:-step], have[step:])
        step *= 2
    if step < width:
        have = np.minimum(have[: len(have) - (width - step)], have[width - step :])
    return have


def anchors_of(data: np.ndarray, offsets: np.ndarray, length: int = LENGTH, k: int = K) -> tuple[np.ndarray, ...]:
    """(row, anchor, first and last string start, K-gram hash, context hash) of each anchor; positions in ``data``."""
    none = tuple(np.zeros(0, np.int64) for _ in range(4)) + tuple(np.zeros(0, np.uint64) for _ in range(2))
    if len(data) < length:
        return none
    first, second = Prefix(data), Prefix(data, 1)
    n = len(data)
    at = np.arange(n - k + 1)
    grams = mix((first.sums[k:] - first.sums[:-k]) * first.down[: n - k + 1])
    bits = np.uint64(max(1, int(n).bit_length()))
    least = sliding_min((grams >> bits << bits) | at.astype(np.uint64), length - k + 1)
    chosen = (least & ((np.uint64(1) << bits) - np.uint64(1))).astype(np.int64)
    sizes = np.diff(offsets)
    inside = np.zeros(n + 1, np.int64)
    long = sizes >= length
    np.add.at(inside, offsets[:-1][long], 1)
    np.add.at(inside, offsets[1:][long] - length + 1, -1)
    starts = np.flatnonzero(np.cumsum(inside[: len(chosen)]) > 0)
    if not len(starts):
        return none
    own = chosen[starts]
    cut = np.flatnonzero(np.concatenate([[True], (own[1:] != own[:-1]) | (starts[1:] != starts[:-1] + 1)]))
    lo, hi, a = starts[cut], starts[np.concatenate([cut[1:] - 1, [len(starts) - 1]])], own[cut]
    ctx = mix(second.of(lo, hi + length) + (a - lo).astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93) + (hi - lo).astype(np.uint64) * np.uint64(0xA0761D6478BD642F))
    return np.searchsorted(offsets, a, "right") - 1, a, lo, hi, grams[a], ctx


def _anchors(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        _, all_offsets = buffer_of(batch.column(2))
        for i, j in chunks(all_offsets):
            part = batch.slice(i, j - i)
            data, offsets = buffer_of(part.column(2))
            row, a, lo, hi, key, ctx = anchors_of(data, offsets)
            k1, k2 = (part.column(c).to_numpy()[row] for c in (0, 1))
            place = (a - offsets[row]) << 16 | (a - lo) << 8 | (a - hi)
            yield pa.RecordBatch.from_arrays([pa.array(signed(key)), pa.array(signed(ctx)), pa.array(k1), pa.array(k2), pa.array(place)], names=["key", "ctx", "k1", "k2", "place"])


def unpacked(place: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Anchor byte and the distances to it of the first and last string."""
    return place >> 16, place >> 8 & 255, place & 255


def common_extension(prefix: Prefix, x: np.ndarray, y: np.ndarray, most: np.ndarray) -> np.ndarray:
    """Bytes that the suffixes at x and y share, ``most`` at the most: binary search over prefix hashes."""
    lo, hi = np.zeros(len(x), np.int64), most.astype(np.int64).copy()
    while True:
        open_ = lo < hi
        if not open_.any():
            return lo
        mid = (lo + hi + 1) >> 1
        same = prefix.of(x, x + mid) == prefix.of(y, y + mid)
        lo = np.where(open_ & same, mid, lo)
        hi = np.where(open_ & ~same, mid - 1, hi)


def suffix_sort(data: np.ndarray, prefix: Prefix, group: np.ndarray, start: np.ndarray, size: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Order of the items by group and suffix data[start : start + size], and the bytes each shares with its successor (-1 where that is of another group).

    A bottom-up merge sort: each item finds its rank in the sibling run by binary search.
    """
    n = len(group)
    order = np.argsort(group, kind="stable")
    g = group[order]
    head = np.flatnonzero(np.concatenate([[True], g[1:] != g[:-1]])) if n else np.zeros(0, np.int64)
    count = np.diff(np.concatenate([head, [n]]))
    base, many = np.repeat(head, count), np.repeat(count, count)
    within = np.arange(n) - base

    def less(x: np.ndarray, y: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        most = np.minimum(size[x], size[y])
        same = common_extension(prefix, start[x], start[y], most)
        ended = same >= most
        at = np.minimum(same, np.maximum(most - 1, 0))
        end = len(data) - 1  # an empty suffix may start at the very end
        byte = data[np.minimum(start[x] + at, end)].astype(np.int64) - data[np.minimum(start[y] + at, end)]
        return np.where(ended, size[x] < size[y], byte < 0), ended & (size[x] == size[y])

    width, widest = 1, int(count.max()) if n else 0
    while width < widest:
        run = within // width
        sib = (run ^ 1) * width
        lo = np.minimum(sib, many)
        end = np.minimum(sib + width, many)
        from_, hi = lo.copy(), end.copy()
        right = (run & 1) == 1
        live = np.flatnonzero(lo < hi)
        while len(live):
            mid = (lo[live] + hi[live]) >> 1
            other = order[base[live] + mid]
            before, equal = less(other, order[live])
            goes = before | (equal & right[live])
            lo[live] = np.where(goes, mid + 1, lo[live])
            hi[live] = np.where(goes, hi[live], mid)
            live = live[lo[live] < hi[live]]
        to = base + np.minimum(run, run ^ 1) * width + within % width + (lo - from_)
        moved = np.empty(n, order.dtype)
        moved[to] = order
        order = moved
        width *= 2
    shared = np.full(n, -1, np.int64)
    pair = np.flatnonzero(group[order[1:]] == group[order[:-1]]) if n > 1 else np.zeros(0, np.int64)
    x, y = order[pair], order[pair + 1]
    shared[pair] = verified(data, start[x], start[y], common_extension(prefix, start[x], start[y], np.minimum(size[x], size[y])))
    return order, shared


def verified(data: np.ndarray, x: np.ndarray, y: np.ndarray, said: np.ndarray) -> np.ndarray:
    """The extensions after a comparison of the bytes themselves: a hash collision shortens one."""
    out = said.copy()
    step = 1 << 14
    for i in range(0, len(x), step):
        width = int(said[i : i + step].max(initial=0))
        if not width:
            continue
        col = np.arange(width)
        ok = data[np.minimum(x[i : i + step, None] + col, len(data) - 1)] == data[np.minimum(y[i : i + step, None] + col, len(data) - 1)]
        ok |= col >= said[i : i + step, None]
        bad = ~ok.all(axis=1)
        out[i : i + step][bad] = np.argmin(ok[bad], axis=1)
    return out


def repeated(keys: np.ndarray, data: np.ndarray, offsets: np.ndarray, dlo: np.ndarray, dhi: np.ndarray, length: int = LENGTH) -> tuple[np.ndarray, np.ndarray]:
    """(item, d) of each string that starts d bytes before an item's anchor and also occurs at another item of its key.

    Item i holds the bytes of all its strings; its anchor is dlo[i] bytes in.
    """
    prefix = Prefix(data)
    _, group = np.unique(keys, return_inverse=True)
    anchor, end = offsets[:-1] + dlo, offsets[1:]
    order, right = suffix_sort(data, prefix, group, anchor, end - anchor)
    back = np.ascontiguousarray(data[::-1])
    n = len(data)
    rorder, left = suffix_sort(back, back_prefix := Prefix(back), group, n - anchor, dlo.astype(np.int64))
    far_r, far_l, by_r, by_l = (np.full(len(keys), v, np.int64) for v in (-1, -1, 0, 0))
    for o, s, far, by in ((order, right, far_r, by_r), (rorder, left, far_l, by_l)):
        for a, b in ((o[:-1], o[1:]), (o[1:], o[:-1])):
            better = s[:-1] > far[a]
            far[a[better]], by[a[better]] = s[:-1][better], b[better]
    lo, hi = np.maximum(length - far_r, dhi), np.minimum(far_l, dlo)  # strings that some other item may have
    maybe = (far_r >= 0) & (lo <= hi)
    # The strings shared with the best neighbour to the right are certain.
    l_by = common_extension(back_prefix, n - anchor, n - anchor[by_r], np.minimum(dlo, dlo[by_r]))
    l_by = verified(back, n - anchor, n - anchor[by_r], l_by)
    sure_hi = np.where(maybe, np.minimum(l_by, hi), -1)
    unsure = maybe & (sure_hi < hi)
    x = np.flatnonzero(maybe)
    many = hi[x] - lo[x] + 1
    item = np.repeat(x, many)
    d = np.arange(len(item)) - np.repeat(np.cumsum(many) - many, many) + np.repeat(lo[x], many)
    sure = d <= sure_hi[item]
    cell = group[item] * (length + 1) + d
    opened = np.isin(group[item], group[unsure]) & np.isin(cell, np.unique(cell[~sure]))
    w = np.flatnonzero(opened)
    worder, wshared = suffix_sort(data, prefix, cell[w], anchor[item[w]] - d[w], np.full(len(w), length, np.int64))
    hit = np.zeros(len(w), bool)
    full = np.flatnonzero(wshared[:-1] >= length) if len(w) else np.zeros(0, np.int64)
    hit[worder[full]] = hit[worder[full + 1]] = True
    sure[w[hit]] = True
    return item[sure], d[sure]


def _slices(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The bytes of wanted anchors, from whole texts. Columns: text, k1, k2, keys, places."""
    for batch in batches:
        data, offsets = buffer_of(batch.column(0))
        n = pc.list_value_length(batch.column(3)).to_numpy()
        keys, places = (np.asarray(batch.column(c).flatten()) for c in (3, 4))
        row = np.repeat(np.arange(len(batch)), n)
        a, dlo, dhi = unpacked(places)
        first, many = offsets[row] + a - dlo, dlo - dhi + LENGTH
        k1, k2 = (batch.column(c).to_numpy()[row] for c in (1, 2))
        for i, j in chunks(np.concatenate([[0], np.cumsum(many)]), 1 << 20):
            upto = np.concatenate([[0], np.cumsum(many[i:j])])
            at = np.repeat(first[i:j] - upto[:-1], many[i:j]) + np.arange(upto[-1])
            own = pa.Array.from_buffers(pa.binary(), j - i, [None, pa.py_buffer(upto.astype(np.int32)), pa.py_buffer(np.ascontiguousarray(data[at]))])
            yield pa.RecordBatch.from_arrays([pa.array(keys[i:j]), pa.array(k1[i:j]), pa.array(k2[i:j]), pa.array(places[i:j]), own], names=["key", "k1", "k2", "place", "bytes"])


def _strings(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """128 bits of hash for every string of the anchors."""
    for batch in batches:
        _, all_offsets = buffer_of(batch.column(4))
        for i, j in chunks(all_offsets, 1 << 18):
            part = batch.slice(i, j - i)
            data, offsets = buffer_of(part.column(4))
            a, dlo, dhi = unpacked(part.column(3).to_numpy())
            many = dlo - dhi + 1
            item = np.repeat(np.arange(len(many)), many)
            skip = np.arange(len(item)) - np.repeat(np.cumsum(many) - many, many)
            s = offsets[item] + skip
            h1, h2 = (signed(mix(Prefix(data, b).of(s, s + LENGTH))) for b in (0, 1))
            k1, k2 = (part.column(c).to_numpy()[item] for c in (1, 2))
            start = (a - dlo)[item] + skip
            yield pa.RecordBatch.from_arrays([pa.array(h1), pa.array(h2), pa.array(k1), pa.array(k2), pa.array(start)], names=["h1", "h2", "k1", "k2", "start"])


def _sorted_repeats(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Runs of repeated string starts (k1, k2, lo, hi) from rows that come sorted by key, a few whole keys at a time."""
    names = ["k1", "k2", "lo", "hi"]

    def solve(rows: pa.Table) -> pa.RecordBatch:
        keys = rows["key"].to_numpy()
        data, offsets = buffer_of(rows["bytes"])
        a, dlo, dhi = unpacked(rows["place"].to_numpy())
        item, d = repeated(keys, data, offsets, dlo, dhi)
        o = np.lexsort((-d, item))
        item, d = item[o], d[o]
        head = np.flatnonzero(np.concatenate([[True], (item[1:] != item[:-1]) | (d[1:] != d[:-1] - 1)])) if len(item) else np.zeros(0, np.int64)
        last = np.concatenate([head[1:] - 1, [len(item) - 1]]) if len(item) else head
        who = item[head]
        return pa.RecordBatch.from_arrays([pa.array(rows["k1"].to_numpy()[who]), pa.array(rows["k2"].to_numpy()[who]), pa.array(a[who] - d[head]), pa.array(a[who] - d[last])], names=names)

    kept: list[pa.RecordBatch] = []
    have = 0
    for batch in batches:
        if not len(batch):
            continue
        kept.append(batch)
        have += batch.nbytes
        if have >= SORTED:
            rows = pa.Table.from_batches(kept)
            keys = rows["key"].to_numpy()
            cut = int(np.searchsorted(keys, keys[-1], "left"))  # the last key may go on
            if cut:
                yield solve(rows.slice(0, cut))
                rows = rows.slice(cut).combine_chunks()
            kept, have = rows.to_batches(), rows.nbytes
    if kept:
        yield solve(pa.Table.from_batches(kept))


def _claims(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Claims of a document (k1, k2, list of (w1, w2, shift, lo, hi)) joined to runs of one witness and shift."""
    names = ["k1", "k2", "w1", "w2", "wlo", "lo", "hi"]
    for batch in batches:
        lists = batch.column(2)
        row = np.repeat(np.arange(len(batch)), pc.list_value_length(lists).to_numpy())
        flat = lists.flatten()
        w1, w2, shift, lo, hi = (np.asarray(flat.field(i)) for i in range(5))
        o = np.lexsort((hi, lo, shift, w2, w1, row))
        row, w1, w2, shift, lo, hi = (x[o] for x in (row, w1, w2, shift, lo, hi))
        if not len(o):
            continue
        same = np.concatenate([[False], (row[1:] == row[:-1]) & (w1[1:] == w1[:-1]) & (w2[1:] == w2[:-1]) & (shift[1:] == shift[:-1])])
        begin = ~same
        begin[1:] |= lo[1:] > hi[:-1] + LENGTH  # bytes that touch are sent together; ends of one witness and shift rise with their starts
        head = np.flatnonzero(begin)
        far = np.maximum.reduceat(hi, head)
        k1, k2 = (batch.column(c).to_numpy()[row[head]] for c in (0, 1))
        yield pa.RecordBatch.from_arrays([pa.array(x) for x in (k1, k2, w1[head], w2[head], lo[head] + shift[head], lo[head], far)], names=names)


def agreed(raw: bytes, lo: int, said: bytes) -> list[tuple[int, int]]:
    """Spans of raw, LENGTH bytes long or more, that equal ``said`` put at lo."""
    if raw[lo : lo + len(said)] == said:
        return [(lo, lo + len(said))]
    n = min(len(said), len(raw) - lo)
    bad = np.flatnonzero(np.frombuffer(raw, np.uint8, n, lo) != np.frombuffer(said, np.uint8, n))
    edge = np.concatenate([[-1], bad, [n]])
    return [(lo + int(a) + 1, lo + int(b)) for a, b in zip(edge[:-1], edge[1:], strict=True) if b - a - 1 >= LENGTH]


def _cut(batches: Iterator[pa.RecordBatch], with_text: bool) -> Iterator[pa.RecordBatch]:
    """Apply the runs to the texts. Columns: doc_id, text, runs (lo, hi, bytes of the witness or null), others."""
    for batch in batches:
        out = []
        texts = []
        for doc, text, runs in zip(*(c.to_pylist() for c in batch.columns[:3]), strict=True):
            raw = (text or "").encode()
            spans: list[list[int]] = []
            found = [s for x in runs or () for s in ([(x["lo"], x["hi"] + LENGTH)] if x["said"] is None else agreed(raw, x["lo"], x["said"]))]
            for r in sorted(found):
                if spans and r[0] <= spans[-1][1]:
                    spans[-1][1] = max(spans[-1][1], r[1])
                else:
                    spans.append(list(r))
            kept, at = [], 0
            for lo, hi in spans:
                kept.append(raw[at:lo])
                at = hi
            rest = b"".join([*kept, raw[at:]]) if spans else raw
            if with_text:
                texts.append(rest)
            out.append((doc, len(raw), len(raw) - len(rest), len(spans), hashlib.sha256(rest).hexdigest()))
        if out:
            cols = list(zip(*out, strict=True))
            kept_ = [pa.array([t.decode("utf-8", "ignore") for t in texts], pa.string())] * with_text
            yield pa.RecordBatch.from_arrays([*batch.columns[3:], *(pa.array(c, pa.int64()) for c in cols[:4]), pa.array(cols[4], pa.string()), *kept_], names=[*batch.schema.names[3:], "doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256", *["kept"] * with_text])


def repeated_runs(texts: DataFrame) -> DataFrame:
    """(k1, k2, runs): by document the runs (lo, hi, said) of starts of strings that occur elsewhere, of texts (k1, k2, text) without repeated rows.

    ``said`` is null where the bytes were compared in the sort, else the witness's bytes, to be compared with those at lo.
    """
    texts = texts.select("k1", "k2", "text").where(F.octet_length("text") >= LENGTH)
    anchors = map_batches(texts, _anchors, ANCHOR)
    # Stored, the K-grams have an exchange of their own in the join, which splits hot ones.
    grams = stored(anchors.groupBy("key").agg(F.count("*").alias("seen"), F.min("ctx").alias("c0"), F.max("ctx").alias("c1")).where("seen > 1").select("key", (F.col("c0") == F.col("c1")).alias("whole")))
    again = stored(anchors.join(grams, "key").select(*[c.split()[0] for c in ANCHOR.split(", ")], "whole"))
    discard(grams)

    who = F.struct("k1", "k2", "place")
    contexts = stored(again.groupBy("key", "ctx", "whole").agg(F.count("*").alias("n"), F.min(who).alias("w"), F.max(who).alias("v")).where("n > 1 or not whole"))
    joined = stored(again.join(contexts.drop("whole"), ["key", "ctx"]).select("key", "k1", "k2", "place", "whole", "n", (F.col("w") == who).alias("rep"), F.when(F.col("w") == who, F.col("v")).otherwise(F.col("w")).alias("w")))
    a, dlo, dhi = (F.expr(e) for e in ("shiftright(place, 16)", "shiftright(place, 8) & 255", "place & 255"))
    claimed = joined.where("n > 1").select("k1", "k2", F.col("w.k1").alias("w1"), F.col("w.k2").alias("w2"), (F.expr("shiftright(w.place, 16)") - a).alias("shift"), (a - dlo).alias("lo"), (a - dhi).alias("hi"))

    hot = contexts.where("not whole").groupBy("key").agg(F.count("*").alias("m")).where(F.col("m") > MOST).select("key")
    items = joined.where("rep and not whole").select("key", "k1", "k2", "place")
    crowded = stored(hot)
    wide = not crowded.isEmpty()

    def bytes_of(which: DataFrame) -> DataFrame:
        wanted = which.groupBy("k1", "k2").agg(F.collect_list("key").alias("keys"), F.collect_list("place").alias("places"))
        return map_batches(texts.join(wanted, ["k1", "k2"]).select("text", "k1", "k2", "keys", "places"), _slices, "key long, k1 long, k2 long, place long, bytes binary")

    parts = max(8, texts.sparkSession.sparkContext.defaultParallelism, int(texts.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    narrow = bytes_of(items.join(crowded, "key", "left_anti") if wide else items)
    found = stored(map_batches(narrow.repartition(parts, "key").sortWithinPartitions("key"), _sorted_repeats, "k1 long, k2 long, lo long, hi long"))
    strings = None
    if wide:
        strings = stored(map_batches(bytes_of(items.join(crowded, "key")), _strings, "h1 long, h2 long, k1 long, k2 long, start long"))
        where = F.struct("k1", "k2", "start")
        twice = strings.groupBy("h1", "h2").agg(F.min(where).alias("w"), F.max(where).alias("v")).where("w <> v")
        more = strings.join(twice, ["h1", "h2"]).withColumn("w", F.when(F.col("w") == where, F.col("v")).otherwise(F.col("w")))
        claimed = claimed.unionByName(more.select("k1", "k2", F.col("w.k1").alias("w1"), F.col("w.k2").alias("w2"), (F.col("w.start") - F.col("start")).alias("shift"), F.col("start").alias("lo"), F.col("start").alias("hi")))

    gathered = claimed.groupBy("k1", "k2").agg(F.collect_list(F.struct("w1", "w2", "shift", "lo", "hi")).alias("claims"))
    runs = stored(map_batches(gathered, _claims, "k1 long, k2 long, w1 long, w2 long, wlo long, lo long, hi long"))
    discard(again, contexts, joined, *filter(None, [strings]))
    told = runs.join(texts.select(F.col("k1").alias("w1"), F.col("k2").alias("w2"), "text"), ["w1", "w2"])
    told = told.select("k1", "k2", "lo", "hi", F.substring(F.col("text").cast("binary"), F.col("wlo") + 1, F.col("hi") - F.col("lo") + LENGTH).alias("said"))
    every = stored(told.unionByName(found.withColumn("said", F.lit(None).cast("binary"))))
    discard(runs, found)
    return every.groupBy("k1", "k2").agg(F.collect_list(F.struct("lo", "hi", "said")).alias("runs"))


def remove_repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", with_text: bool = True, extra: tuple[str, ...] = ()) -> DataFrame:
    """Each document without the bytes covered by a LENGTH-byte string that also starts elsewhere in the table.

    Returns doc_id, n_bytes, n_removed, n_spans, kept_sha256 and, if asked for, kept (the
    remaining bytes as text; bytes of a split character are left out), and columns
    ``extra`` of docs; other columns, whatever their names, aren't read. Null texts count as
    empty; repeated rows are documents of their own, so copies of LENGTH bytes or
    more go whole, ties included: no copy stays for being the first; texts of any length are
    read whole; an empty table gives no rows.
    """
    texts = docs.select(F.col(id_col).cast("long").alias("doc_id"), text_or_empty(text_col).alias("text"), *extra)
    texts = texts.select("doc_id", "text", *extra, *row_keys("doc_id", "text"))
    # Rows that are repeated, id and all, go whole; one of each stays for the others to be compared with.
    same = stored(texts.where(F.octet_length("text") >= LENGTH).groupBy("k1", "k2").agg(F.count("*").alias("n")).where("n > 1").select("k1", "k2"))
    once = texts
    if not same.isEmpty():
        single = texts.select("k1", "k2", "text").join(same, ["k1", "k2"], "left_anti")
        once = single.unionByName(texts.select("k1", "k2", "text").join(same, ["k1", "k2"], "left_semi").dropDuplicates(["k1", "k2"]))
    runs = repeated_runs(once)
    if once is not texts:
        whole = F.array(F.struct(F.lit(0).cast("long").alias("lo"), F.lit(WHOLE).cast("long").alias("hi"), F.lit(None).cast("binary").alias("said")))
        runs = runs.join(same, ["k1", "k2"], "left_anti").unionByName(same.withColumn("runs", whole))
    full = texts.join(stored(runs), ["k1", "k2"], "left").select("doc_id", "text", "runs", *extra)
    types = dict(full.dtypes)
    return map_batches(full, lambda it: _cut(it, with_text), "".join(f"`{c}` {types[c]}, " for c in extra) + "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string" + ", kept string" * with_text)


def op1_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """:func:`remove_repeats` over all of documents, one row a row: doc_id, n_bytes, n_removed, n_spans, kept_sha256."""
    return remove_repeats(table(spark, sf_dir, "documents"), with_text=False)
