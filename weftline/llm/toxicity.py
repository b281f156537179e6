"""Toxicity of documents: a learned lexicon, misspellings by Levenshtein automata on its trie, and the context of each hit.

Fitting (labelled rows only, FIT of them at most, the first by hash, one of each group
of near copies, lest the words of a copied text pass for signs of its label): words
and word stems whose documents are toxic beyond chance form the lexicon; words near a
lexicon term whose rate in toxic rows is below RATIO times that in clean rows are cleared.
Hits are weighed by a logistic model of four counts: exact, misspelled, quoted and aimed hits.
What reaches the driver are counts of words and of hits of the labelled rows, of which
FIT is the only bound; no list of them is cut.

An automaton for "at most k edits" is run as k + 1 bit masks of positions in the
term (insertions, deletions, substitutions in one step a character), along all
terms at once by walking the trie of the lexicon.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import buffer_of, chunks, map_batches, stored, table, text_or_empty
from .neardup import shingles_of, signatures

#: Labelled rows of a fit, words known to a worker.
FIT, CACHE = 30_000, 150_000
#: Likelihood ratio of toxic to clean rows below which a near word is cleared, or the near words of a term are; share of a term's rows that is taken to be misspelled before any are seen.
RATIO, MISSPELLED = 4, 0.01
#: Pairs of minima by which copies among the labelled rows are told.
COPY_KEYS = 8
THRESHOLD = 0.7
#: Words on each side of a hit that tell abuse from quotation.
WINDOW = 6
STEMS = range(4, 9)
ADDRESSED = frozenset("you your you're youre u ur yourself du dein deine dich dir tu te toi vous tú ti usted".split())
REPORTED = frozenset("said says wrote writes called quote quoted quoting sagte schrieb zitat dit écrit dijo escribió".split())
QUOTES = '"“”„«»‹›'
TRIM = re.compile(r"^[\W_]+|[\W_]+$")
LETTERS = re.compile(r"[^\W\d_]+")
BLANKS = re.compile(r"[ \t-\r]+")


def edits(term_length: int) -> int:
    return 0 if term_length < 4 else 1 if term_length < 8 else 2


def swaps(term: str) -> set[str]:
    """The term with two neighbouring letters in each other's place."""
    return {term[:i] + term[i + 1] + term[i] + term[i + 2 :] for i in range(len(term) - 1)} - {term}


@dataclass
class Trie:
    """Terms by character, one trie for each length; ``near`` finds those within their edits of a word.

    Stems, given with a star, are within their edits of a word if they are of the beginning
    of it. ``find`` also knows neighbouring letters swapped, which are two edits, in terms of one.

    Of a term cut into k + 1 pieces one stands unchanged in any word within k edits, at
    most k places off; only the tries that have such a piece of a word are walked for it.
    """

    roots: dict[tuple[int, bool], dict] = field(default_factory=dict)
    swapped: dict[str, str] = field(default_factory=dict)
    heads: dict[str, str] = field(default_factory=dict)
    head_sizes: set[int] = field(default_factory=set)
    pieces: dict[str, dict[int, set[tuple[int, bool]]]] = field(default_factory=dict)
    sizes: set[int] = field(default_factory=set)
    longest: int = 0

    def add(self, name: str) -> None:
        stem = name.endswith("*")
        term = name[:-1] if stem else name
        k = edits(len(term))
        if not k:
            return
        key = (len(term), stem)
        node = self.roots.setdefault(key, {})
        for ch in term:
            node = node.setdefault(ch, {})
        node[""] = name
        self.longest = max(self.longest, 1 << 30 if stem else len(term))
        if k == 1:
            for w in sorted(swaps(term)):
                (self.heads if stem else self.swapped).setdefault(w, name)
            if stem:
                self.head_sizes.add(len(term))
        cut = [len(term) * i // (k + 1) for i in range(k + 2)]
        for i, j in zip(cut[:-1], cut[1:], strict=True):
            places = self.pieces.setdefault(term[i:j], {})
            for at in range(i - k, i + k + 1):
                places.setdefault(at, set()).add(key)
            self.sizes.add(j - i)

    def find(self, word: str) -> str | None:
        """The term that a word misspells, or None."""
        got = self.near(word) or self.swapped.get(word)
        if got is None and self.heads:
            got = next((self.heads[h] for k in sorted(self.head_sizes) if (h := word[:k]) in self.heads), None)
        return got

    def near(self, word: str) -> str | None:
        """The first closest term within its edits of ``word``, or None."""
        n = len(word)
        if n > self.longest + 2 or n < 4:
            return None
        keys: set[tuple[int, bool]] = set()
        for z in self.sizes:
            for i in range(n - z + 1):
                if (places := self.pieces.get(word[i : i + z])) and i in places:
                    keys |= places[i]
        keys = {(size, stem) for size, stem in keys if (n >= size if stem else abs(n - size) <= edits(size))}
        if not keys:
            return None
        where: dict[str, int] = {}
        for i, ch in enumerate(word):
            where[ch] = where.get(ch, 0) | 1 << i
        last = 1 << n
        best: tuple[int, str] | None = None
        for size, stem in keys:
            k, root = edits(size), self.roots[size, stem]
            # states[e]: positions of the word that are reached with e edits
            stack = [(root, [(1 << e + 1) - 1 for e in range(k + 1)])]
            while stack:
                node, states = stack.pop()
                for ch, child in node.items():
                    if ch == "":
                        for e in range(k + 1):
                            if states[e] & last or (stem and states[e]):
                                if best is None or (e, child) < best:
                                    best = (e, child)
                                break
                        continue
                    hit = where.get(ch, 0)
                    new, before = [], 0
                    for e, s in enumerate(states):
                        t = (s & hit) << 1
                        if e:
                            t |= states[e - 1] | states[e - 1] << 1 | before << 1
                        before = t
                        new.append(t)
                    if new[k]:
                        stack.append((child, new))
        return best[1] if best else None


@dataclass
class Model:
    terms: frozenset[str] = frozenset()
    stems: frozenset[str] = frozenset()
    family: frozenset[str] = frozenset()
    cleared: frozenset[str] = frozenset()
    crowded: frozenset[str] = frozenset()
    weights: tuple[float, ...] = (-3.0, 0.0, 0.0, 0.0, 0.0)


def words_in(chunk: str) -> list[str]:
    """Letter runs of a white-space word, and the whole of it where digits or signs stand within."""
    if chunk.isalpha():
        return [chunk.lower()]
    low = TRIM.sub("", chunk.lower())
    runs = LETTERS.findall(low)
    return runs if runs == [low] or not low else [*runs, low]


def targets_of(model: Model) -> list[str]:
    """What misspellings are looked for of: terms, words of the stems, and the stems, starred; without those barred from it."""
    return sorted((model.terms | model.family | {s + "*" for s in model.stems}) - model.crowded)


START, END = r"(?:^|[^\p{L}])", r"(?:$|[^\p{L}])"


def candidates(model: Model, terms_each: int = 40) -> list[str]:
    """Patterns, one of which every lower-case white-space word with a mark matches: pieces of terms at their places, swapped terms, short terms, quotation marks, addresses and reports."""
    fixed = "|".join(map(re.escape, sorted(ADDRESSED | REPORTED)))
    out = [f"[{QUOTES}]|^[>']|{START}(?:{fixed}){END}"]
    parts: list[list[str]] = []
    for name in sorted(model.terms | model.family | {s + "*" for s in model.stems}):
        term = name.removesuffix("*")
        k = edits(len(term))
        cut = [len(term) * i // (k + 1) for i in range(k + 2)]
        own = [f".{{{max(0, i - k)},{i + k}}}{re.escape(term[i:j])}" for i, j in zip(cut[:-1], cut[1:], strict=True)]
        parts.append(own + [re.escape(w) for w in sorted(swaps(term))] * (k == 1))
    for i in range(0, len(parts), terms_each):
        out.append(f"{START}(?:{'|'.join(x for own in parts[i : i + terms_each] for x in own)})")
    return out


class Matcher:
    """Marks of white-space words: 1 exact hit, 2 misspelled hit, 4 quotation mark, 8 address, 16 report; cached.

    Most words match none of the :func:`candidates` and are never looked at one by one.
    """

    def __init__(self, model: Model):
        self.model, self.trie, self.known = model, Trie(), {}
        for t in targets_of(model):
            self.trie.add(t)
        self.lengths = sorted({len(s) for s in model.stems})
        self.patterns = candidates(model)

    def mark(self, chunk: str) -> int:
        got = self.known.get(chunk)
        if got is None:
            if len(self.known) > CACHE:
                self.known.clear()
            got = self.known[chunk] = self._mark(chunk)
        return got

    def _mark(self, chunk: str) -> int:
        out = 4 if any(q in chunk for q in QUOTES) or chunk[:1] in ">'" else 0
        m = self.model
        for w in words_in(chunk):
            if w in ADDRESSED:
                out |= 8
            if w in REPORTED:
                out |= 16
            if w in m.terms or any(w[:k] in m.stems for k in self.lengths):
                out |= 1
            elif w not in m.cleared and self.trie.find(w):
                out |= 2
        return out

    def counts(self, col: pa.Array) -> np.ndarray:
        """Exact, misspelled, quoted and aimed hits of each text."""
        import pyarrow.compute as pc

        split = pc.ascii_split_whitespace(col)
        coded = pc.dictionary_encode(split.flatten())
        low = pc.utf8_lower(coded.dictionary)
        some = np.zeros(len(low), bool)
        for pattern in self.patterns:
            some |= pc.match_substring_regex(low, pattern=pattern).to_numpy(zero_copy_only=False)
        at = np.flatnonzero(some)
        marks = np.zeros(max(1, len(low)), np.uint8)
        marks[at] = [self.mark(w) for w in coded.dictionary.take(pa.array(at)).to_pylist()]
        m = marks[coded.indices.to_numpy(zero_copy_only=False)] if len(coded) else np.zeros(0, np.uint8)
        to = split.offsets.to_numpy().astype(np.int64)
        to -= to[0]
        out = np.zeros((len(col), 4), np.int64)
        for at in np.flatnonzero(m & 3):
            row = int(np.searchsorted(to, at, "right")) - 1
            near = m[max(to[row], at - WINDOW) : min(to[row + 1], at + WINDOW + 1)]
            quoted = (near & 4 > 0).sum() >= 2 or ((near & 4).any() and (near & 16).any())
            aimed = (near & 8).any() or ((near & 3) > 0).sum() > 1
            out[row] += (bool(m[at] & 1) and not quoted, bool(m[at] & 2) and not quoted, bool(quoted), bool(aimed and not quoted))
        return out


def _sized(batch: pa.RecordBatch, column: int) -> Iterator[pa.RecordBatch]:
    _, offsets = buffer_of(batch.column(column))
    for i, j in chunks(offsets, 1 << 20):
        yield batch.slice(i, j - i)


def _document_counts(of_chunk):
    """(term, n): documents by term, where a white-space word has the terms ``of_chunk(word)`` (known words aren't asked again)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known: dict[str, tuple[str, ...]] = {}
        df: Counter[str] = Counter()

        def out() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(list(df), pa.string()), pa.array(list(df.values()), pa.int64())], names=["term", "n"])

        for batch in batches:
            for text in batch.column(0).to_pylist():
                own: set[str] = set()
                for chunk in set(BLANKS.split(text)):
                    terms = known.get(chunk)
                    if terms is None:
                        if len(known) > CACHE:
                            known.clear()
                        terms = known[chunk] = tuple(of_chunk(chunk))
                    if terms:
                        own.update(terms)
                df.update(own)
                if len(df) > 200_000:
                    yield out()
                    df.clear()
        yield out()

    return run


def terms_of(chunk: str) -> set[str]:
    """Words and, marked by a star, word stems of a white-space word."""
    words = set(words_in(chunk))
    return words | {w[:k] + "*" for w in words for k in STEMS if len(w) > k}


def least_of(na: int) -> int:
    """Toxic rows that a lexicon term stands in at the least."""
    return max(3, na // 100)


def lexicon(a: dict[str, int], b: dict[str, int], na: int, nb: int) -> tuple[frozenset[str], frozenset[str], frozenset[str]]:
    """Words, stems that cover more than any of their words, and the words of these stems, in 1 % of the toxic rows at least, with a likelihood ratio over 20 and 20 times the rate of clean rows."""

    def strength(t: str) -> float:
        x, y = a[t], b.get(t, 0)
        p = (x + y) / max(1, na + nb)
        if not na or not nb or x / na < 20 * (y + 0.1) / nb:
            return 0.0
        return 2 * (x * math.log(x / (na * p)) + (y * math.log(y / (nb * p)) if y else 0))

    least = least_of(na)
    strong = {t: s for t in a if a[t] >= least and (s := strength(t)) > 20}
    words = {t for t in strong if t[-1] != "*"}
    most: Counter[str] = Counter()
    for w in (t for t in a if t[-1] != "*"):
        for k in STEMS:
            if len(w) > k:
                most[w[:k]] = max(most[w[:k]], a[w])
    stems = {t[:-1] for t in strong if t[-1] == "*" and a[t] > 1.3 * most[t[:-1]]}
    # Of nested stems with about the same documents the longest, which is the most specific.
    stems = {s for s in stems if not any(o != s and o.startswith(s) and a[o + "*"] >= 0.9 * a[s + "*"] for o in stems)}
    stems = {s for s in stems if not any(o != s and s.startswith(o) for o in stems)}
    family = frozenset(w for w in words if any(w.startswith(s) for s in stems))
    return frozenset(words) - family, frozenset(stems), family


def judged(clean: dict[str, int], toxic: dict[str, int], find, a: dict[str, int], na: int, nb: int) -> tuple[frozenset[str], frozenset[str]]:
    """Cleared near words and barred terms, by rows of near words; ``find`` gives the term of a word.

    A near word of clean rows is cleared if its likelihood ratio is below RATIO. What stands in
    one row foretells the words not seen yet: a term is barred if the ratio of these is below RATIO.
    """
    cleared = frozenset(w for w, y in clean.items() if toxic.get(w, 0) * nb < RATIO * y * na)
    ordinary = Counter(find(w) for w in cleared if clean[w] == 1)
    meant = Counter(find(w) for w, x in toxic.items() if x == 1 and w not in cleared)
    return cleared, frozenset(t for t, y in ordinary.items() if (meant[t] + MISSPELLED * a.get(t, 0)) * nb < RATIO * (y + 0.5) * na)


def signals(counts: np.ndarray) -> np.ndarray:
    """One hit says most; more of them add a little."""
    return (counts > 0) + 0.1 * np.log1p(counts)


def fit_weights(cells: list[tuple[tuple[int, ...], int, int]]) -> tuple[float, ...]:
    """Logistic weights (bias first, others not below 0) of the counts by ridge-penalised Newton steps.

    Kinds of hits that no labelled row has get a share of the weight of exact ones:
    0.8 for misspelled, 0.2 for quoted, 0.1 for aimed hits.
    """
    if not cells:
        return Model.weights
    counts = np.array([c for c, _, _ in cells])
    x = np.concatenate([np.ones((len(cells), 1)), signals(counts)], axis=1)
    pos, all_ = np.array([p for _, p, _ in cells], float), np.array([n for _, _, n in cells], float)
    w = np.zeros(x.shape[1])
    ridge = np.array([1e-6, *[0.05] * (x.shape[1] - 1)])
    for _ in range(60):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        grad = x.T @ (pos - all_ * p) - ridge * w
        hess = (x * (all_ * p * (1 - p))[:, None]).T @ x + np.diag(ridge + 1e-9)
        step = np.linalg.solve(hess, grad)
        w = w + step / max(1.0, np.abs(step).max())
        if np.abs(step).max() < 1e-7:
            break
    w[1:] = np.maximum(w[1:], 0)
    for kind, share in ((1, 0.8), (2, 0.2), (3, 0.1)):
        if not counts[:, kind].any():
            w[1 + kind] = share * w[1]
    return tuple(float(v) for v in w)


def _pairs_of_minima(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for part in _sized(batch, 1):
            data, offsets = buffer_of(part.column(1))
            pairs = signatures(*shingles_of(data, offsets, 3)).view(np.uint32)[:, :COPY_KEYS]
            yield pa.RecordBatch.from_arrays([part.column(0), pa.array([x.tolist() for x in pairs], pa.list_(pa.int64()))], names=["id", "keys"])


def without_copies(rows: DataFrame) -> DataFrame:
    """Ids of rows that share no pair of minima with an earlier row; texts without words stay."""
    keys = stored(map_batches(rows.select("id", "text"), _pairs_of_minima, "id long, keys array<long>"))
    each = keys.where(F.exists("keys", lambda k: k != 0)).select("id", F.posexplode("keys").alias("slot", "key"))
    later = each.join(each.groupBy("slot", "key").agg(F.min("id").alias("first")), ["slot", "key"]).where("first < id").select("id").distinct()
    return keys.select("id").join(later, "id", "left_anti")


def fit(labelled: DataFrame) -> Model:
    """A model from (text, toxic) rows, as many as the caller has chosen (FIT at most in :func:`model_of`).

    Null labels are left out; with no rows every score is the same low one.
    """
    rows = labelled.where(F.col("toxic").isNotNull()).select(text_or_empty().alias("text"), F.col("toxic").cast("int").alias("toxic"))
    rows = stored(rows.repartition(max(8, rows.sparkSession.sparkContext.defaultParallelism)).withColumn("id", F.monotonically_increasing_id()))
    rows = stored(rows.join(without_copies(rows), "id").select("text", "toxic"))
    counts = {r["toxic"]: r["n"] for r in rows.groupBy("toxic").agg(F.count("*").alias("n")).collect()}
    na, nb = counts.get(1, 0), counts.get(0, 0)
    toxic, clean = (rows.where(F.col("toxic") == v).select("text") for v in (1, 0))

    def tally(df: DataFrame, fn) -> DataFrame:
        return map_batches(df, fn, "term string, n long").groupBy("term").agg(F.sum("n").alias("n"))

    # A word in too few rows for this is neither a term nor the word that a stem must surpass by 1.3.
    a = {r["term"]: r["n"] for r in tally(toxic, _document_counts(terms_of)).where(F.col("n") * 1.3 >= least_of(na)).collect()}
    wanted = frozenset(a)
    b = {r["term"]: r["n"] for r in tally(clean, _document_counts(lambda chunk: terms_of(chunk) & wanted)).collect()}
    model = Model(*lexicon(a, b, na, nb))
    trie = Trie()
    for t in targets_of(model):
        trie.add(t)
    sizes = sorted({len(s) for s in model.stems})

    def misspelled(chunk: str) -> list[str]:
        return [w for w in words_in(chunk) if w not in model.terms and not any(w[:k] in model.stems for k in sizes) and trie.find(w)]

    near = [{r["term"]: r["n"] for r in tally(df, _document_counts(misspelled)).collect()} for df in (clean, toxic)]
    model.cleared, model.crowded = judged(*near, trie.find, a, na, nb)

    def cells(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        matcher = Matcher(model)
        for batch in batches:
            for part in _sized(batch, 0):
                c = matcher.counts(part.column(0))
                yield pa.RecordBatch.from_arrays([*(pa.array(c[:, i]) for i in range(4)), part.column(1)], names=["c0", "c1", "c2", "c3", "toxic"])

    got = map_batches(rows, cells, "c0 long, c1 long, c2 long, c3 long, toxic int").groupBy("c0", "c1", "c2", "c3").agg(F.sum("toxic").alias("p"), F.count("*").alias("n")).collect()
    model.weights = fit_weights([((r.c0, r.c1, r.c2, r.c3), r.p, r.n) for r in got])
    return model


def score(docs: DataFrame, model: Model, keep: list[str]) -> DataFrame:
    """Columns ``keep`` of docs and a score of the whole ``text``. Null and empty texts score the model's bias."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        matcher = Matcher(model)
        w = np.array(model.weights)
        for batch in batches:
            for part in _sized(batch, 0):
                x = signals(matcher.counts(part.column(0)))
                s = 1 / (1 + np.exp(-np.clip(w[0] + x @ w[1:], -30, 30)))
                yield pa.RecordBatch.from_arrays([*part.columns[1:], pa.array(s)], names=[*keep, "score"])

    types = dict(docs.dtypes)
    return map_batches(docs.select(text_or_empty().alias("_t"), *keep), run, ", ".join(f"`{c}` {types[c]}" for c in keep) + ", score double")


def held_out(doc_id="doc_id"):
    return F.crc32(F.coalesce(F.col(doc_id).cast("string"), F.lit("")).cast("binary")) % 3 == 1


def model_of(docs: DataFrame, labels: DataFrame, most: int = FIT) -> Model:
    """Fit on labelled documents outside the held-out third. Of repeated labels of a doc_id the largest counts, of repeated documents the least text; ids are never features.

    At most ``most`` labelled ids are broadcast (8 bytes each).
    """
    ids = labels.where("doc_id is not null and toxic is not null").where(~held_out()).groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    ids = stored(ids.withColumn("order", F.xxhash64("doc_id")).orderBy("order", "doc_id").limit(most))
    chosen = docs.select("doc_id", text_or_empty().alias("text")).join(F.broadcast(ids), "doc_id")
    return fit(chosen.groupBy("doc_id").agg(F.min("text").alias("text"), F.max("toxic").alias("toxic")))


def toxicity(docs: DataFrame, labels: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """doc_id, held_out, score and predicted for every document, repeated rows each.

    Null and empty texts and those without a hit share one score, that of the bias; null doc_ids
    are scored too; texts of any length are read whole; equal texts have equal scores; without
    labels, and for labels of other documents, all scores are low; other columns, whatever
    their names, aren't read; an empty table gives no rows.
    """
    slim = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    out = score(slim, model_of(slim, labels), ["doc_id"])
    return out.select("doc_id", held_out().alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"))


def op7_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """:func:`toxicity` of all of documents, one row a row: doc_id, held_out, score, predicted."""
    return toxicity(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
