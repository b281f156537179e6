"""Operators on documents against brute force, with edge cases from the fixture."""

import hashlib
import re
import textwrap
import zlib
from collections import Counter
from pathlib import Path

import numpy as np
import pytest
from pyspark.sql import functions as F

from weftline.llm import licenses, media, mixing, neardup, packing, suffixes

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def rows_of(df):
    return [r.asDict() for r in df.collect()]


def input_rows(docs):
    return [(r["doc_id"], r["text"]) for r in docs.collect()]


def brute_repeats(rows):
    raw = [(i, (t or "").encode()) for i, t in rows]
    seen = Counter(b[k : k + 200] for _, b in raw for k in range(len(b) - 199))
    out = []
    for i, b in raw:
        cover = bytearray(len(b))
        for k in range(len(b) - 199):
            if seen[b[k : k + 200]] > 1:
                cover[k : k + 200] = b"\1" * 200
        kept = bytes(x for x, c in zip(b, cover, strict=True) if not c)
        out.append((i, len(b), sum(cover), len([x for x in bytes(cover).split(b"\0") if x]), hashlib.sha256(kept).hexdigest()))
    return Counter(out)


@pytest.mark.parametrize("most", [suffixes.MOST, 2])
def test_repeats(docs, monkeypatch, most):
    monkeypatch.setattr(suffixes, "MOST", most)  # 2: string by string for K-grams of many contexts
    got = suffixes.remove_repeats(docs)
    assert Counter((r["doc_id"], r["n_bytes"], r["n_removed"], r["n_spans"], r["kept_sha256"]) for r in rows_of(got)) == brute_repeats(input_rows(docs))


def test_suffix_sort_orders_suffixes():
    rng = np.random.default_rng(1)
    data = rng.integers(97, 99, 3000).astype(np.uint8)
    start = rng.integers(0, 2900, 200)
    size = np.minimum(rng.integers(0, 150, 200), 3000 - start)
    group = rng.integers(0, 5, 200)
    order, shared = suffixes.suffix_sort(data, suffixes.Prefix(data), group, start, size)
    text = [(int(group[i]), data[start[i] : start[i] + size[i]].tobytes()) for i in order]
    assert text == sorted(text)
    for i in range(199):
        (g, a), (h, b) = text[i], text[i + 1]
        n = next((k for k, (x, y) in enumerate(zip(a, b, strict=False)) if x != y), min(len(a), len(b)))
        assert shared[i] == (n if g == h else -1)


def shingle_set(text, k):
    w = WORD.findall((text or "").translate({c: c + 32 for c in range(65, 91)}))
    return {tuple(w[i : i + k]) for i in range(len(w) - k + 1)} if len(w) >= k else ({tuple(w)} if w else set())


def brute_components(rows, k):
    sets, root = [shingle_set(t, k) for _, t in rows], list(range(len(rows)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i, a in enumerate(sets):
        for j in range(i):
            n = len(a & sets[j])
            if a and 100 * n >= 80 * (len(a) + len(sets[j]) - n):
                root[find(i)] = find(j)
    least = {}
    for i, (doc, _) in enumerate(rows):
        if doc is not None:
            least[find(i)] = min(doc, least.get(find(i), doc))
    return Counter((doc, len(sets[i]), least.get(find(i)), doc is not None and doc == least.get(find(i))) for i, (doc, _) in enumerate(rows))


@pytest.mark.parametrize("words", [4, 5])
def test_near_duplicates(docs, words):
    got = neardup.near_duplicates(docs, words=words)
    assert Counter((r["doc_id"], r["n_shingles"], r["component_id"], r["kept"]) for r in rows_of(got)) == brute_components(input_rows(docs), words)


def test_near_duplicates_links_through_strays(spark):
    """Members that miss the pivot but link to another member must be found."""
    w = [f"w{i}" for i in range(200)]
    rows = []
    for i in range(8):  # each a step further from the first: neighbours link, ends don't
        own = [*w]
        own[: 14 * i] = [f"x{k}" for k in range(14 * i)]
        rows.append((i, " ".join(own)))
    got = neardup.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string"), words=4)
    assert Counter((r["doc_id"], r["n_shingles"], r["component_id"], r["kept"]) for r in rows_of(got)) == brute_components(rows, 4)


def test_keys_meet_all_pairs_within_threshold():
    rng = np.random.default_rng(2)
    for _ in range(300):
        a = rng.integers(0, 1 << 16, (1, neardup.SYMBOLS)).astype(np.uint16)
        b = a.copy()
        b[0, rng.choice(neardup.SYMBOLS, neardup.T, replace=False)] ^= 1
        assert set(neardup.keys_of(a)[0]) & set(neardup.keys_of(b)[0])


def test_components_of_chains_and_stars(spark):
    edges = [(i, i + 1) for i in range(100, 140)] + [(500, i) for i in range(501, 520)] + [(7, 9)]
    got = {r["c"]: r["l"] for r in neardup.components(spark.createDataFrame(edges, "x long, y long")).collect()}
    groups = {}
    for c, l in got.items():
        groups.setdefault(l, set()).add(c)
    assert sorted(map(sorted, groups.values())) == [[7, 9], list(range(100, 141)), list(range(500, 520))]


def test_packing(docs):
    from public_tokenizers import path
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(path(packing.VOCABULARY))
    t.encode_special_tokens = True
    want = Counter()
    for i, text in input_rows(docs):
        ids = np.array([*t.encode(text or "", add_special_tokens=False).ids, 1], "<u4")
        for k in range(0, len(ids), 4096):
            want[i, k // 4096, k, len(ids[k : k + 4096]), zlib.crc32(ids[k : k + 4096].tobytes())] += 1
    got = rows_of(packing.pack(packing.pieces(docs), per_partition=20))
    assert Counter((r["doc_id"], r["piece"], r["start"], r["length"], r["ids_crc32"]) for r in got) == want
    bins = {}
    for r in got:
        bins.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    for places in bins.values():
        at = 0
        for offset, length in sorted(places):
            assert offset == at
            at += length
        assert at <= 4096
    assert len(bins) <= packing.lower_bound(np.array([r["length"] for r in got])) + 1


def test_lower_bound_holds():
    rng = np.random.default_rng(3)
    for _ in range(50):
        sizes = np.sort(rng.integers(1, 4097, 60))[::-1]
        assert packing.lower_bound(sizes) <= len(packing.best_fit(sizes)[2])
    assert packing.lower_bound(np.full(10, 2049)) == 10


def test_mixing_meets_targets(docs):
    got = rows_of(mixing.mix(docs, block=50))
    sizes = {}
    for i, t in input_rows(docs):
        sizes.setdefault(i, len(WORD.findall(t or "")))
    taken, targets = Counter(), {}
    for r in got:
        assert r["size"] == sizes[r["doc_id"]] and 0 <= r["taken"] <= 2 * r["size"]
        assert (r["first_slot"] is None) == (r["taken"] == 0)
        key = (r["source_size"], r["target"])
        taken[key] += r["taken"]
        targets[key] = r["target"]
    assert all(abs(taken[k] - t) <= 3 * 50 for k, t in targets.items()), "a source is off by a few blocks"
    assert sum(targets.values()) == pytest.approx(1.5 * sum(k[0] for k in targets))
    again = rows_of(mixing.mix(docs.repartition(7), block=50))
    assert Counter(map(str, got)) == Counter(map(str, again))


def test_mix_is_what_the_slots_deal(docs):
    """Replay the schedule by hand: slot by slot, the next block of the source under the point."""
    block = 20
    rows = [(i, t, s) for i, t, s in ((r["doc_id"], r["text"], r["source"]) for r in docs.collect())]
    md5 = lambda x: hashlib.md5(x).hexdigest()
    streams = {}
    for i, t, s in rows:
        key = md5(("" if i is None else str(i)).encode() + b":" + md5((t or "").encode()).encode())
        streams.setdefault(s, []).append((key, i, t, len(WORD.findall(t or ""))))
    names = sorted(streams, key=lambda s: (s is None, s or ""))
    for s in names:
        streams[s].sort(key=lambda x: x[0])
    target = {r["source"]: r["target"] for r in rows_of(mixing.mix(docs, block=block, extra=("lang",)))}
    goal = {s: int(target[s]) for s in names}
    total = sum(goal.values())
    edges, at = [], 0
    for s in names:
        edges.append((at / total * 2**31 // 1, (at + goal[s]) / total * 2**31 // 1, s))
        at += goal[s]
    word_of = {s: [k for k, x in enumerate(streams[s]) for _ in range(x[3])] * 2 for s in names}
    taken, first, rank = Counter(), {}, Counter()
    for slot in range(-(-total // block)):
        x = (slot + 1) * mixing.GOLDEN % 2**31
        s = next(s for lo, hi, s in edges if lo <= x < hi)
        for k in word_of[s][rank[s] * block : (rank[s] + 1) * block]:
            taken[s, k] += 1
            first.setdefault((s, k), slot)
        rank[s] += 1
    want = Counter((x[1], x[3], taken[s, k], first.get((s, k))) for s in names for k, x in enumerate(streams[s]))
    assert Counter((r["doc_id"], r["size"], r["taken"], r["first_slot"]) for r in rows_of(mixing.mix(docs, block=block))) == want


def test_every_prefix_of_the_schedule_has_the_weights(spark):
    arcs = spark.createDataFrame([(0, 500, 0), (1, 250, 500), (2, 1, 750), (3, 0, 751)], "src_id long, goal long, goal_before long")
    rows = mixing.schedule(arcs, 751, 751).orderBy("slot").collect()
    assert [r["slot"] for r in rows] == list(range(751))
    seen = Counter()
    for n, r in enumerate(rows, 1):
        assert r["rank"] == seen[r["src_id"]]
        seen[r["src_id"]] += 1
        assert all(abs(seen[s] - n * g / 751) < 3 for s, g in ((0, 500), (1, 250), (2, 1)))


def test_running_sums_over_many_ranges(spark):
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        got = rows_of(mixing.running(spark.range(1000).withColumn("x", F.col("id") % 7), [F.col("id")], ["x"]))
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    assert all(r["x_before"] == sum(i % 7 for i in range(r["id"])) for r in got) and len(got) == 1000


def test_media_round_trip(docs):
    got = rows_of(media.tiff_pages(media.store_texts(docs), "media", ("doc_id", "n_bytes")))
    want = Counter()
    for i, t in input_rows(docs):
        raw = (t or "").encode()
        want[i, len(raw), raw.ljust(max(1, -(-len(raw) // 192)) * 192, b" ")] += 1
    assert Counter((r["doc_id"], r["n_bytes"], bytes(r["pixels"])) for r in got) == want
    assert all(r["error"] is None and r["width"] == 192 for r in got)


@pytest.mark.parametrize("compression", [media.NONE, media.LZW, media.DEFLATE, media.PACKBITS])
@pytest.mark.parametrize("predictor", [1, 2])
def test_tiff_codecs(compression, predictor):
    rng = np.random.default_rng(4)
    pages = [rng.integers(0, m, (n, w)).astype(np.uint8) for m, n, w in ((2, 1, 192), (256, 130, 192), (9, 70, 33))]
    data = media.encode(pages, compression, predictor, 64)
    got = [media.decode_page(data, f)[:, :, 0] for f in media.directories(data)]
    assert all((a == b).all() for a, b in zip(pages, got, strict=True))


def test_tiff_tiles_and_big_endian():
    import struct

    x = np.arange(40 * 20, dtype=np.uint16).reshape(20, 40)
    tiles = [np.pad(x[y : y + 16, c : c + 16], ((0, max(0, 16 - x[y : y + 16].shape[0])), (0, max(0, 16 - x[:, c : c + 16].shape[1])))) for y in (0, 16) for c in (0, 16, 32)]
    raw, offsets = b"", []
    for t in tiles:
        offsets.append(8 + len(raw))
        raw += media.pack_bits(t.astype(">u2").tobytes())
    counts = [b - a for a, b in zip(offsets, [*offsets[1:], 8 + len(raw)], strict=True)]
    lists = 8 + len(raw)
    body = raw + struct.pack(">6I", *offsets) + struct.pack(">6I", *counts)
    at = 8 + len(body)
    fields = [(256, 4, 1, 40), (257, 4, 1, 20), (258, 3, 1, 16 << 16), (259, 3, 1, 32773 << 16), (322, 4, 1, 16), (323, 4, 1, 16), (324, 4, 6, lists), (325, 4, 6, lists + 24)]
    data = struct.pack(">2sHI", b"MM", 42, at) + body + struct.pack(">H", len(fields)) + b"".join(struct.pack(">HHII", *f) for f in fields) + struct.pack(">I", 0)
    (f,) = media.directories(data)
    assert (media.decode_page(data, f)[:, :, 0] == x).all()


@pytest.mark.parametrize("codec", media.CODECS[:5])
def test_stored_codecs(codec):
    compression, predictor, tile = codec
    page = np.frombuffer("Schöne neue Texte. ".encode() * 900, np.uint8)[: 192 * 80].reshape(-1, 192)
    data = media.encode([page], compression, predictor, tile=tile)
    ((_, x, error),) = media.pages_of(data)
    assert error is None and (x[:, :, 0] == page).all()


def test_pages_after_a_broken_one_are_read(spark):
    pages = [np.full((4, 192), v, np.uint8) for v in (1, 2, 3)]
    data = bytearray(media.encode(pages, media.NONE, 1))
    second = list(media.directories(bytes(data)))[1]
    at = data.index(bytes([3, 1, 3, 0, 1, 0, 0, 0, 1, 0, 0, 0]), second[media.OFFSETS][0])
    data[at + 8] = 99  # an unknown compression
    got = rows_of(media.tiff_pages(spark.createDataFrame([(1, data, 5)], "id long, media binary, page int"), "media", ("id",)))
    assert [(r["page"], r["error"] is None, r["pixels"] and bytes(r["pixels"])[:1]) for r in got] == [(0, True, b"\1"), (1, False, None), (2, True, b"\3")]


@pytest.mark.parametrize("compression", [media.NONE, media.LZW, media.PACKBITS, media.DEFLATE])
def test_sizes_beyond_the_strips_are_refused(compression):
    import struct

    data = bytearray(media.encode([np.zeros((4, 192), np.uint8)], compression, 1))
    at = data.index(struct.pack("<HHII", media.HEIGHT, 4, 1, 4))
    struct.pack_into("<I", data, at + 8, 1 << 30)
    ((_, x, error),) = media.pages_of(bytes(data))
    assert x is None and error


def test_broken_media(spark):
    rows = spark.createDataFrame([(1, None), (2, bytearray()), (3, bytearray(b"II*\0\xff\xff\xff\xff")), (4, bytearray(b"junk"))], "id long, media binary")
    got = rows_of(media.tiff_pages(rows, "media", ("id",)))
    assert len(got) == 4 and all(r["pixels"] is None and r["error"] for r in got)


def scanned(spark, rows):
    return {r["doc_id"]: (r["license"], r["notices"]) for r in rows_of(licenses.scan(spark.createDataFrame([(i, t, "x", "y") for i, t in rows], "doc_id long, text string, digest string, k1 string")))}


def test_licenses(spark):
    mit = licenses.MIT.upper().replace("COPYRIGHT NOTICE", "copyright   notice")
    wrap = lambda text, mark, n: "\n".join(f"{mark}{x}" for p in text.split("\n\n") for x in [*textwrap.wrap(p, n), ""])
    wrapped = wrap(licenses.UNLICENSE + licenses.UNLICENSE_END, "", 60)
    header = "# Copyright 2019 A. Person\n#\n" + wrap(licenses.APACHE_NOTICE, "# ", 70)
    got = scanned(spark, [
        (1, "Copyright (c) 2020 A. Person\n" + mit), (2, "text\nReleased under the MIT Licence\nmore\nLicensed under CC BY-NC 4.0"), (3, None), (4, "no licence here"), (5, licenses.APACHE_NOTICE.replace("http://", "https://")),
        (6, wrapped), (7, header + "\n\nimport os\n"), (8, "Copyright 2020 X Inc. Licensed under the MIT License."), (9, ""), (10, "Copyright (C) 1999 Y\n© 2001 Z"), (11, "word " * 300_000 + "\nSPDX-License-Identifier: ISC"),
    ])
    assert got == {1: ("MIT", ""), 2: (None, "CC-BY-NC-4.0,MIT"), 3: (None, ""), 4: (None, ""), 5: ("Apache-2.0", "Apache-2.0"), 6: ("Unlicense", ""), 7: (None, "Apache-2.0"), 8: ("MIT", "MIT"), 9: (None, ""), 10: (None, ""), 11: (None, "ISC")}


def test_repeated_spellings_are_all_replaced(spark):
    texts = [(1, "licence licence licence"), (2, "license license license"), (3, "licence\nlicence, per cent"), (4, "license\nlicense percent")]
    got = {r["doc_id"]: r["digest"] for r in rows_of(licenses.scan(spark.createDataFrame(texts, "doc_id long, text string")))}
    assert got[1] == got[2] and got[3] == got[4] != got[1]


def test_rows_of_equal_text_are_all_returned(spark):
    same = spark.createDataFrame([(4, "x")] * 3 + [(5, "x")], "doc_id long, text string")
    assert Counter(r["doc_id"] for r in rows_of(licenses.scan(same))) == {4: 3, 5: 1}


def test_whole_licences_as_published(spark):
    folder = Path("/usr/share/common-licenses")  # where Debian keeps them
    files = {"Apache-2.0": "Apache-2.0", "GPL-2.0": "GPL-2", "GPL-3.0": "GPL-3", "LGPL-2.1": "LGPL-2.1", "MPL-2.0": "MPL-2.0", "CC0-1.0": "CC0-1.0"}
    texts = {n: (folder / f).read_text() for n, f in files.items() if (folder / f).exists()}
    if not texts:
        pytest.skip("no licence texts here")
    rows = [(i, " ".join(t.split()) if i % 2 else t) for i, t in enumerate(texts.values())]
    rows = [(i, t) for i, t in rows if i % 2 == 0 or "Copyright" not in t]  # a statement ends with its line
    assert {i: v[0] for i, v in scanned(spark, rows).items()} == {i: n for i, n in enumerate(texts) if i in dict(rows)}


def test_empty_tables(empty):
    for df in (suffixes.remove_repeats(empty), neardup.near_duplicates(empty), mixing.mix(empty), packing.pack(packing.pieces(empty)), media.tiff_pages(media.store_texts(empty)), licenses.scan(empty)):
        assert df.count() == 0
