"""TIFF columns: decode binary media to one row a page, and store bytes as 8-bit grey TIFF.

The reader walks the chain of image directories in either byte order and decodes
uncompressed, PackBits, LZW and deflate strips and tiles of 8- and 16-bit integer
samples, chunky or planar, undoing horizontal prediction. A broken page gives a row with
its error and no samples, and the pages after it are read all the same; so does a broken
file. No page is given more memory than its strips or tiles can fill.
"""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import map_batches, table, text_or_empty

# Fixed values of TIFF 6.0: tags, field sizes by type, compression codes.
WIDTH, HEIGHT, BITS, COMPRESSION, OFFSETS, SAMPLES, ROWS, COUNTS, PLANAR, PREDICTOR = 256, 257, 258, 259, 273, 277, 278, 279, 284, 317
TILE_WIDTH, TILE_HEIGHT, TILE_OFFSETS, TILE_COUNTS = 322, 323, 324, 325
TYPE_SIZES = {1: 1, 2: 1, 3: 2, 4: 4, 5: 8, 6: 1, 7: 1, 8: 2, 9: 4, 10: 8, 11: 4, 12: 8}
TYPE_CODES = {1: "B", 3: "H", 4: "I", 6: "b", 8: "h", 9: "i"}
NONE, LZW, DEFLATE, PACKBITS, OLD_DEFLATE = 1, 5, 8, 32773, 32946

ROW, STRIP, TILE = 192, 128, 64
#: Bytes that one stored byte can give at most, by compression.
GROWTH = {NONE: 1, PACKBITS: 64, LZW: 2731, DEFLATE: 1032, OLD_DEFLATE: 1032}
#: (compression, predictor, tile) in which texts are stored, by crc32 of the payload.
CODECS = ((LZW, 2, None), (PACKBITS, 1, None), (DEFLATE, 2, TILE), (NONE, 1, TILE), *[(DEFLATE, 2, None)] * 12)


def unpack_bits(raw: bytes, most: int = 1 << 62) -> bytes:
    """At least ``most`` bytes, or all."""
    out, i = bytearray(), 0
    while i < len(raw) and len(out) < most:
        n = raw[i]
        i += 1
        if n < 128:
            out += raw[i : i + n + 1]
            i += n + 1
        elif n > 128:
            out += raw[i : i + 1] * (257 - n)
            i += 1
    return bytes(out)


def pack_bits(raw: bytes) -> bytes:
    out, i, n = bytearray(), 0, len(raw)
    while i < n:
        j = i + 1
        while j < n and j - i < 128 and raw[j] == raw[i]:
            j += 1
        if j - i > 1:
            out += bytes([257 - (j - i), raw[i]])
        else:
            while j < n and j - i < 128 and not (j + 1 < n and raw[j] == raw[j + 1]):
                j += 1
            out.append(j - i - 1)
            out += raw[i:j]
        i = j
    return bytes(out)


def lzw_decode(raw: bytes, most: int = 1 << 62) -> bytes:
    """At least ``most`` bytes, or all. Most significant bit first, 9 to 12 bits, widths rising one code early; 256 clears, 257 ends."""
    out, words, width, last = bytearray(), [], 9, b""
    bits = have = 0
    for byte in raw:
        bits, have = bits << 8 | byte, have + 8
        if have < width:
            continue
        have -= width
        code = bits >> have
        bits &= (1 << have) - 1
        if code == 256:
            words, width, last = [], 9, b""
            continue
        if code == 257:
            break
        if code < 256:
            word = bytes([code])
        elif code - 258 < len(words):
            word = words[code - 258]
        elif last and code - 258 == len(words):
            word = last + last[:1]
        else:
            raise ValueError("bad LZW code")
        out += word
        if len(out) >= most:
            break
        if last:
            words.append(last + word[:1])
        last = word
        if len(words) + 258 + 1 >= 1 << width and width < 12:
            width += 1
    return bytes(out)


def lzw_encode(raw: bytes) -> bytes:
    out, bits, have, width = bytearray(), 0, 0, 9
    known: dict[bytes, int] = {}

    def put(code: int) -> None:
        nonlocal bits, have
        bits, have = bits << width | code, have + width
        while have >= 8:
            have -= 8
            out.append(bits >> have)
            bits &= (1 << have) - 1

    put(256)
    word = b""
    code_of = lambda w: w[0] if len(w) == 1 else known[w]
    for i in range(len(raw)):
        longer = word + raw[i : i + 1]
        if len(longer) == 1 or longer in known:
            word = longer
            continue
        put(code_of(word))
        known[longer] = 258 + len(known)
        if 258 + len(known) >= 1 << width:
            if width < 12:
                width += 1
        if 258 + len(known) >= 4094:
            put(256)
            known, width = {}, 9
        word = raw[i : i + 1]
    if word:
        put(code_of(word))
        known[word + b"?"] = 0
        if 258 + len(known) >= 1 << width and width < 12:
            width += 1
    put(257)
    if have:
        out.append(bits << (8 - have) & 255)
    return bytes(out)


def inflate(raw: bytes, most: int) -> bytes:
    return zlib.decompressobj().decompress(raw, most)


def directories(data: bytes) -> Iterator[dict[int, list[int]]]:
    """The fields of each image directory; a directory met again ends the walk."""
    order = {b"II": "<", b"MM": ">"}.get(data[:2])
    if order is None or struct.unpack_from(order + "H", data, 2)[0] != 42:
        raise ValueError("not a TIFF file")
    at, met = struct.unpack_from(order + "I", data, 4)[0], set()
    while at and at not in met:
        met.add(at)
        fields: dict[int, list[int]] = {0: [0 if order == "<" else 1]}
        (n,) = struct.unpack_from(order + "H", data, at)
        for k in range(n):
            tag, kind, count = struct.unpack_from(order + "HHI", data, at + 2 + 12 * k)
            if kind not in TYPE_CODES:
                continue
            size = TYPE_SIZES[kind] * count
            where = at + 2 + 12 * k + 8
            if size > 4:
                (where,) = struct.unpack_from(order + "I", data, where)
            fields[tag] = list(struct.unpack_from(f"{order}{count}{TYPE_CODES[kind]}", data, where))
        yield fields
        (at,) = struct.unpack_from(order + "I", data, at + 2 + 12 * n)


def decode_page(data: bytes, f: dict[int, list[int]]) -> np.ndarray:
    """Samples of a page: (height, width, samples)."""
    one = lambda tag, default=None: f[tag][0] if f.get(tag) else default
    width, height, samples = one(WIDTH), one(HEIGHT), one(SAMPLES, 1)
    if not width or not height:
        raise ValueError("no size")
    bits = f.get(BITS, [1])
    if any(b != bits[0] for b in bits) or bits[0] not in (8, 16):
        raise ValueError(f"{bits[0]}-bit samples aren't read")
    kind = np.dtype((">" if f[0][0] else "<") + ("u1" if bits[0] == 8 else "u2"))
    compression, predictor, planar = one(COMPRESSION, NONE), one(PREDICTOR, 1), one(PLANAR, 1)
    if predictor not in (1, 2):
        raise ValueError(f"predictor {predictor} isn't read")
    tiled = TILE_WIDTH in f
    cell_w, cell_h = (one(TILE_WIDTH), one(TILE_HEIGHT)) if tiled else (width, min(one(ROWS, height), height))
    offsets, counts = (f.get(TILE_OFFSETS), f.get(TILE_COUNTS)) if tiled else (f.get(OFFSETS), f.get(COUNTS))
    if not offsets or not counts or not cell_w or not cell_h:
        raise ValueError("no strips or tiles")
    across, down = -(-width // cell_w), -(-height // cell_h)
    planes, depth = (samples, 1) if planar == 2 else (1, samples)
    if len(offsets) < across * down * planes or len(counts) < across * down * planes:
        raise ValueError("strips or tiles are missing")
    if compression not in GROWTH:
        raise ValueError(f"compression {compression} isn't read")
    stored = sum(max(0, min(n, len(data) - at)) for at, n in zip(offsets, counts, strict=False))
    if (samples > 1 << 15) or height * width * samples * kind.itemsize > GROWTH[compression] * stored or cell_w * cell_h > 4 * max(width * height, 1 << 20):
        raise ValueError("larger than its strips or tiles can fill")
    out = np.zeros((height, width, samples), kind.newbyteorder("="))
    for k in range(across * down * planes):
        plane, cell = divmod(k, across * down)
        y, x = cell // across * cell_h, cell % across * cell_w
        rows = cell_h if tiled else min(cell_h, height - y)
        need = rows * cell_w * depth * kind.itemsize
        raw = data[offsets[k] : offsets[k] + counts[k]]
        if compression == NONE:
            plain = raw
        elif compression == PACKBITS:
            plain = unpack_bits(raw, need)
        elif compression == LZW:
            plain = lzw_decode(raw, need)
        else:
            plain = inflate(raw, need)
        if len(plain) < need:
            raise ValueError("a strip or tile is short")
        block = np.frombuffer(plain, kind, rows * cell_w * depth).reshape(rows, cell_w, depth).astype(kind.newbyteorder("="))
        if predictor == 2:
            block = np.cumsum(block, axis=1, dtype=block.dtype)
        h, w = min(rows, height - y), min(cell_w, width - x)
        if planar == 2:
            out[y : y + h, x : x + w, plane] = block[:h, :w, 0]
        else:
            out[y : y + h, x : x + w] = block[:h, :w]
    return out


def encode(pages: list[np.ndarray], compression: int = DEFLATE, predictor: int = 2, strip: int = STRIP, tile: int | None = None) -> bytes:
    """A little-endian file of 8-bit grey pages (height, width) in strips, or in square tiles filled up with zeros."""
    out = bytearray(struct.pack("<2sHI", b"II", 42, 0))
    link = 4
    for page in pages:
        height, width = page.shape
        if tile:
            full = np.pad(page, ((0, -height % tile), (0, -width % tile)))
            cells = [full[y : y + tile, x : x + tile] for y in range(0, height, tile) for x in range(0, width, tile)]
        else:
            cells = [page[y : y + strip] for y in range(0, height, strip)]
        offsets, counts = [], []
        for block in cells:
            if predictor == 2:
                block = np.diff(block, axis=1, prepend=np.uint8(0))
            raw = np.ascontiguousarray(block).tobytes()
            raw = {NONE: lambda b: b, PACKBITS: pack_bits, LZW: lzw_encode, DEFLATE: lambda b: zlib.compress(b, 1)}[compression](raw)
            offsets.append(len(out))
            counts.append(len(raw))
            out += raw
        lists = []
        for values in (offsets, counts):
            lists.append(values[0] if len(values) == 1 else len(out))
            if len(values) > 1:
                out += struct.pack(f"<{len(values)}I", *values)
        out += b"\0" * (len(out) % 2)
        fields = [(WIDTH, 4, 1, width), (HEIGHT, 4, 1, height), (BITS, 3, 1, 8), (COMPRESSION, 3, 1, compression), (262, 3, 1, 1), (SAMPLES, 3, 1, 1), (PREDICTOR, 3, 1, predictor)]
        if tile:
            fields += [(TILE_WIDTH, 3, 1, tile), (TILE_HEIGHT, 3, 1, tile), (TILE_OFFSETS, 4, len(offsets), lists[0]), (TILE_COUNTS, 4, len(counts), lists[1])]
        else:
            fields += [(OFFSETS, 4, len(offsets), lists[0]), (ROWS, 4, 1, strip), (COUNTS, 4, len(counts), lists[1])]
        fields.sort()
        struct.pack_into("<I", out, link, len(out))
        out += struct.pack("<H", len(fields)) + b"".join(struct.pack("<HHII", *x) for x in fields)
        link = len(out)
        out += struct.pack("<I", 0)
    return bytes(out)


def feature_of(page: np.ndarray) -> str:
    """Mean, deviation and a 64-bit mean hash of an 8 x 8 reduction of the first sample."""
    v = page[:, :, 0]
    rows, cols = (np.linspace(0, n, 9).astype(int) for n in v.shape)
    total = np.zeros((v.shape[0] + 1, v.shape[1] + 1), np.int64)
    total[1:, 1:] = v.astype(np.int64).cumsum(0).cumsum(1)
    r0, r1, c0, c1 = rows[:-1], np.maximum(rows[1:], rows[:-1] + 1), cols[:-1], np.maximum(cols[1:], cols[:-1] + 1)
    r1, c1 = np.minimum(r1, v.shape[0]), np.minimum(c1, v.shape[1])
    r0, c0 = np.minimum(r0, r1 - 1), np.minimum(c0, c1 - 1)
    cell = (total[np.ix_(r1, c1)] - total[np.ix_(r0, c1)] - total[np.ix_(r1, c0)] + total[np.ix_(r0, c0)]) / ((r1 - r0)[:, None] * (c1 - c0)[None, :])
    bits = (cell > cell.mean()).ravel()
    return f"mean={v.mean():.4f};dev={v.std():.4f};hash={int(''.join('1' if b else '0' for b in bits), 2):016x}"


BROKEN = (ValueError, struct.error, zlib.error, IndexError, MemoryError, OverflowError)


def pages_of(data: bytes) -> Iterator[tuple[int, np.ndarray | None, str | None]]:
    """(page, samples or None, error or None) of a file; a broken directory ends it."""
    walk, page = directories(data), 0
    while True:
        try:
            fields = next(walk)
        except StopIteration:
            return
        except BROKEN as e:
            yield page, None, str(e) or type(e).__name__
            return
        try:
            yield page, decode_page(data, fields), None
        except BROKEN as e:
            yield page, None, str(e) or type(e).__name__
        page += 1


def tiff_pages(df: DataFrame, content: str = "media", keep: tuple[str, ...] = ()) -> DataFrame:
    """One row a page: columns ``keep``, page (from 0), width, height, samples, bits, pixels (bytes, row by row, little-endian), feature, error.

    Null, empty and broken files, and broken pages, give one row with null pixels and an error;
    the pages after a broken one are read. Repeated rows are all returned; files of any length are
    read whole; columns other than ``content`` and ``keep`` aren't read, whatever their
    names; an empty table gives no rows.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at, rows = [], []
            for i, value in enumerate(batch.column(0)):
                for page, x, error in pages_of(value.as_py() or b""):
                    at.append(i)
                    rows.append((page, None, None, None, None, None, None, error) if x is None else (page, x.shape[1], x.shape[0], x.shape[2], 8 * x.itemsize, x.astype(x.dtype.newbyteorder("<")).tobytes(), feature_of(x), None))
            cols = list(zip(*rows, strict=True)) if rows else [()] * 8
            kept = batch.take(pa.array(at, pa.int64())).columns[1:]
            types = [pa.int32()] * 5 + [pa.binary(), pa.string(), pa.string()]
            yield pa.RecordBatch.from_arrays([*kept, *(pa.array(c, t) for c, t in zip(cols, types, strict=True))], names=[*keep, "page", "width", "height", "samples", "bits", "pixels", "feature", "error"])

    types = dict(df.dtypes)
    return map_batches(df.select(content, *keep), run, "".join(f"`{c}` {types[c]}, " for c in keep) + "page int, width int, height int, samples int, bits int, pixels binary, feature string, error string")


def store_texts(docs: DataFrame, row: int = ROW, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, n_bytes, media): each text's UTF-8 bytes, filled up with blanks to whole rows of ``row`` samples, as a one-page TIFF.

    The payload's crc32 picks one of CODECS, so equal texts are stored alike. Null texts count as
    empty; repeated rows are all returned; other columns aren't read; an empty table gives no rows.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sizes, media = [], []
            for text in batch.column(1).to_pylist():
                raw = text.encode()
                sizes.append(len(raw))
                page = np.frombuffer(raw.ljust(max(1, -(-len(raw) // row)) * row, b" "), np.uint8).reshape(-1, row)
                compression, predictor, tile = CODECS[zlib.crc32(page) % len(CODECS)]
                media.append(encode([page], compression, predictor, tile=tile))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(sizes, pa.int64()), pa.array(media, pa.binary())], names=["doc_id", "n_bytes", "media"])

    slim = docs.select(F.col(id_col).cast("long").alias("doc_id"), text_or_empty(text_col).alias("text"))
    return map_batches(slim, run, "doc_id long, n_bytes long, media binary")


def op6_tiff_media(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every text of documents stored by :func:`store_texts` and read back by :func:`tiff_pages`, one row a row: doc_id, n_bytes, payload_bytes, payload_sha256, tail_crc32, media_bytes, media_sha256, feature."""
    stored = store_texts(table(spark, sf_dir, "documents")).withColumns({"media_bytes": F.octet_length("media").cast("long"), "media_sha256": F.sha2("media", 256)})
    pages = tiff_pages(stored, "media", ("doc_id", "n_bytes", "media_bytes", "media_sha256"))
    return pages.select("doc_id", "n_bytes", F.octet_length("pixels").cast("long").alias("payload_bytes"), F.sha2("pixels", 256).alias("payload_sha256"), F.crc32(F.substring("pixels", -16, 16)).alias("tail_crc32"), "media_bytes", "media_sha256", "feature")
