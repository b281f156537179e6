"""Best-fit packing of tokenised documents into fixed-length sequences, certified by dual-feasible-function bounds.

Pieces are dealt to partitions; each packs its own by best-fit decreasing and
compares its bin count with a dual-feasible-function lower bound. Bins of a
partition that has a gap, unless they are full, are opened again, and so is the emptiest
bin of a certified one while the bins of all exceed the bound of all pieces: their pieces
are exchanged among fewer partitions and packed anew, until the bins meet the
bound of all pieces, no partition has a gap or one partition has held the rest.
The bound of all pieces comes with the result.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import buffer_of, chunks, map_batches, of_worker, stored, table, text_or_empty

LENGTH = 4096
VOCABULARY = "word_bpe_49k.json"
END = 1
#: Pieces a packing partition holds at the least, and at the most when open bins are exchanged; entries of a worker's word cache.
PER_PARTITION, MOST, CACHE = 50_000, 2_000_000, 350_000


def spread(first: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Indices first[i] .. first[i] + n[i] - 1 of all i in turn, and where each i begins among them (one more at the end)."""
    upto = np.concatenate([[0], np.cumsum(n)]).astype(np.int64)
    return np.repeat(first - upto[:-1], n) + np.arange(upto[-1]), upto


class WordIds:
    """Token ids by white-space word: the tokenizer drops white space and never joins across it, so a text's ids are those of its words.

    Words of Latin-1 letters, with one full stop or comma at most, are known by their
    lower-case letters; many of them go to the tokenizer as one text, which the ids that
    end words take apart again. Any other word is encoded by itself.
    """

    SIMPLE = "^[A-Za-zÀ-ÖØ-öø-ÿ]+[.,]?$"

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.encode_special_tokens = True
        self.ends = np.zeros(self.tokenizer.get_vocab_size() + 1, bool)
        for token, i in self.tokenizer.get_vocab().items():
            self.ends[i] = token.endswith("</w>")
        self.marks = {m: self.tokenizer.encode(m, add_special_tokens=False).ids for m in ".,"}
        self.forget()

    def forget(self) -> None:
        self.known: dict[str, int] = {}
        self.flat, self.first = np.zeros(0, np.uint32), np.zeros(1, np.int64)

    def learn(self, words: list[str]) -> None:
        ids, lengths = [], []
        for i in range(0, len(words), 2000):
            part = words[i : i + 2000]
            own = np.array(self.tokenizer.encode(" ".join(part), add_special_tokens=False).ids, np.uint32)
            last = np.flatnonzero(self.ends[own])
            if len(last) != len(part):
                each = [np.array(e.ids, np.uint32) for e in self.tokenizer.encode_batch(part, add_special_tokens=False)]
                own, last = np.concatenate(each), np.cumsum([len(x) for x in each]) - 1
            ids.append(own)
            lengths.append(np.diff(np.concatenate([[-1], last])))
        for w in words:
            self.known[w] = len(self.known)
        self.flat = np.concatenate([self.flat, *ids])
        self.first = np.concatenate([self.first, self.first[-1] + np.cumsum(np.concatenate(lengths))])

    def stems(self, words: list[str]) -> np.ndarray:
        if len(self.known) > CACHE:
            self.forget()
        if new := [w for w in words if w not in self.known]:
            self.learn(new)
        return np.array([self.known[w] for w in words], np.int64)

    def texts(self, col: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """All ids of a string column, and the offsets of its texts in them."""
        import pyarrow.compute as pc

        split = pc.ascii_split_whitespace(col)
        coded = pc.dictionary_encode(split.flatten())
        texts = split.offsets.to_numpy().astype(np.int64)
        words = coded.dictionary
        if not len(words):
            return np.zeros(0, np.uint32), np.zeros(len(texts), np.int64)
        simple = pc.match_substring_regex(words, pattern=self.SIMPLE).to_numpy(zero_copy_only=False)
        at, other = np.flatnonzero(simple), np.flatnonzero(~simple)
        low = pc.utf8_lower(words.take(pa.array(at)))
        stems = pc.dictionary_encode(pc.utf8_rtrim(low, characters=".,"))
        which = self.stems(stems.dictionary.to_pylist())[stems.indices.to_numpy(zero_copy_only=False)] if len(at) else np.zeros(0, np.int64)
        each = [np.array(e.ids, np.uint32) for e in self.tokenizer.encode_batch(words.take(pa.array(other)).to_pylist(), add_special_tokens=False)]
        # One store: known words, the marks, the other words; an entry is a range of it and perhaps a mark.
        store = [self.flat, *(np.array(self.marks[m], np.uint32) for m in ".,"), *each]
        begin = np.concatenate([[0], np.cumsum([len(x) for x in store])]).astype(np.int64)
        first, n = np.zeros(len(words), np.int64), np.zeros(len(words), np.int64)
        first[at], n[at] = self.first[which], self.first[which + 1] - self.first[which]
        first[other], n[other] = begin[3:-1], np.diff(begin)[3:]
        mark = np.zeros(len(words), np.int64)
        for k, m in enumerate(".,", 1):
            mark[at[pc.ends_with(low, m).to_numpy(zero_copy_only=False)]] = k
        codes = coded.indices.to_numpy(zero_copy_only=False)
        pair_first, pair_n = np.zeros((len(codes), 2), np.int64), np.zeros((len(codes), 2), np.int64)
        pair_first[:, 0], pair_n[:, 0] = first[codes], n[codes]
        m = mark[codes]
        pair_first[:, 1], pair_n[:, 1] = begin[m], np.where(m > 0, np.diff(begin)[m], 0)
        index, upto = spread(pair_first.ravel(), pair_n.ravel())
        return np.concatenate(store)[index], upto[2 * (texts - texts[0])]


def pieces(docs: DataFrame, vocabulary: str | None = None, length: int = LENGTH, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, piece, start, length, ids_crc32): token ids and an end id, cut every ``length`` ids.

    A null or empty text has the end id alone; texts of any length are read whole; repeated rows
    are all cut; other columns, whatever their names, aren't read; an empty table gives no rows.
    """

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        path = vocabulary
        if path is None:
            import public_tokenizers

            path = public_tokenizers.path(VOCABULARY)
        coder = of_worker(f"words {path}", lambda: WordIds(path))
        for batch in batches:
            _, offsets = buffer_of(batch.column(1))
            for i, j in chunks(offsets, 4 << 20):
                part = batch.slice(i, j - i)
                ids, upto = coder.texts(part.column(1))
                docs_, nos, starts, sizes, sums = [], [], [], [], []
                for doc, a, b in zip(part.column(0).to_pylist(), upto[:-1], upto[1:], strict=True):
                    own = np.append(ids[a:b], np.uint32(END)).astype("<u4")
                    for k in range(0, len(own), length):
                        x = own[k : k + length]
                        docs_.append(doc)
                        nos.append(k // length)
                        starts.append(k)
                        sizes.append(len(x))
                        sums.append(zlib.crc32(x.tobytes()))
                yield pa.RecordBatch.from_arrays([pa.array(docs_, pa.int64()), pa.array(nos, pa.int32()), pa.array(starts, pa.int64()), pa.array(sizes, pa.int64()), pa.array(sums, pa.int64())], names=["doc_id", "piece", "start", "length", "ids_crc32"])

    slim = docs.select(F.col(id_col).cast("long").alias("doc_id"), text_or_empty(text_col).alias("text"))
    return map_batches(slim, cut, "doc_id long, piece int, start long, length long, ids_crc32 long")


def lower_bound(sizes: np.ndarray, capacity: int = LENGTH, times: np.ndarray | None = None) -> int:
    """``times``: how often each size stands (once). Bins that any packing needs: the best of the volume bound and Fekete-Schepers' functions u(k) and U(e)."""
    if not len(sizes):
        return 0
    count = np.zeros(capacity + 1, np.int64)
    np.add.at(count, sizes, 1 if times is None else times)
    x = np.arange(capacity + 1, dtype=np.int64)
    best = -(-int((count * x).sum()) // capacity)
    number, volume = np.cumsum(count), np.cumsum(count * x)
    for e in range(capacity // 2 + 1):  # x > C - e counts whole, x < e not at all
        whole = number[-1] - number[capacity - e]
        middle = volume[capacity - e] - (volume[e - 1] if e else 0)
        best = max(best, int(whole + -(-middle // capacity)))
    for k in range(1, 25):  # steps of (k + 1)ths; exact multiples keep their size
        exact = (k + 1) * x % capacity == 0
        scaled = np.where(exact, k * x, (k + 1) * x // capacity * capacity)
        best = max(best, -(-int((count * scaled).sum()) // (k * capacity)))
    return best


def best_fit(sizes: np.ndarray, capacity: int = LENGTH) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Bin and offset of each item, and the fill of each bin; ``sizes`` must fall. A bit mask of the rooms in use finds the tightest in one step."""
    bins, offsets, fill = np.zeros(len(sizes), np.int64), np.zeros(len(sizes), np.int64), []
    rooms: dict[int, list[int]] = {}
    mask = 0
    for i, s in enumerate(sizes.tolist()):
        if fits := mask >> s:
            room = s + (fits & -fits).bit_length() - 1
            stack = rooms[room]
            b = stack.pop()
            if not stack:
                mask &= ~(1 << room)
        else:
            b, room = len(fill), capacity
            fill.append(0)
        bins[i], offsets[i] = b, fill[b]
        fill[b] += s
        if room > s:
            rooms.setdefault(room - s, []).append(b)
            mask |= 1 << (room - s)
    return bins, offsets, np.array(fill, np.int64)


def bound_of(cut: DataFrame, capacity: int = LENGTH) -> int:
    """Sequences that any packing of all pieces needs, from their histogram (``capacity`` rows at most)."""
    rows = cut.groupBy("length").agg(F.count("*").alias("n")).collect()
    return lower_bound(np.array([r["length"] for r in rows], np.int64), capacity, np.array([r["n"] for r in rows], np.int64))


def pack(cut: DataFrame, capacity: int = LENGTH, per_partition: int = PER_PARTITION) -> DataFrame:
    """Adds sequence_id, offset and bound to pieces (columns of :func:`pieces`).

    Every piece is packed, repeated rows too; sequences are gapless from 0 and hold
    ``capacity`` ids at most. ``bound``, the same on every row, is the number of sequences that no
    packing of all pieces goes below: rounds end when it is met, when
    one partition has held all that was open, or when fewer partitions would hold over MOST pieces each
    and a round gains nothing. An empty table gives no rows.
    """
    columns = ["doc_id", "piece", "start", "length", "ids_crc32"]
    schema = "doc_id long, piece int, start long, length long, ids_crc32 long, sequence_id long, offset long, again boolean"

    def packer(turn: int):
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            from pyspark import TaskContext

            rows = pa.Table.from_batches(list(batches), schema=pa.schema([("doc_id", pa.int64()), ("piece", pa.int32()), ("start", pa.int64()), ("length", pa.int64()), ("ids_crc32", pa.int64())]))
            if not len(rows):
                return
            rows = rows.sort_by([("length", "descending"), ("doc_id", "ascending"), ("piece", "ascending"), ("ids_crc32", "ascending")])
            sizes = rows["length"].to_numpy()
            bins, offsets, fill = best_fit(sizes, capacity)
            gap = len(fill) > lower_bound(sizes, capacity)
            open_ = fill < (capacity if gap else min(capacity, fill.min() + 1))  # a certified partition gives its emptiest bins only
            again = open_[bins]
            ids = bins + ((turn * 1_000_000 + TaskContext.get().partitionId()) << 24)
            out = rows.append_column("sequence_id", pa.array(ids)).append_column("offset", pa.array(offsets)).append_column("again", pa.array(again))
            yield from out.to_batches(max_chunksize=10_000)

        return run

    def sequences(packed: DataFrame) -> int:
        return packed.where("offset = 0 and length > 0").count()

    rest, done, full, before, turn = stored(cut.select(columns)), None, 0, None, 0
    total, bound = rest.count(), bound_of(rest, capacity)
    parts = max(1, -(-total // per_partition))
    while True:
        # A number a row, not its content: repeated rows are dealt apart.
        dealt = rest.repartition(parts, F.xxhash64(F.monotonically_increasing_id(), F.lit(turn)))
        packed = stored(map_batches(dealt, packer(turn), schema))
        bins = sequences(packed)
        keep, again = packed.where("not again"), packed.where("again")
        left = again.count() if parts > 1 and full + bins > bound else 0
        least = -(-left // MOST)
        if not left or (parts <= least and before is not None and bins >= before):
            done = packed if done is None else done.unionByName(packed)
            break
        done = keep if done is None else done.unionByName(keep)
        full += sequences(keep)
        rest, parts, before, turn = again.select(columns), max(1, least, min(parts // 2, left // per_partition)), sequences(again), turn + 1
    return done.drop("again").withColumn("bound", F.lit(bound).cast("long"))


def op5_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """:func:`pack` of the :func:`pieces` of all of documents, one row a piece: doc_id, piece, start, length, ids_crc32, sequence_id, offset, bound."""
    return pack(pieces(table(spark, sf_dir, "documents")))
