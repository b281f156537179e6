"""Stages of the pipeline against brute force, one by one on the rows that the one before kept, and the whole run."""

import hashlib
import re
from collections import Counter

import pytest
from test_documents import WORD, brute_components, brute_repeats
from test_others import toxic_tables

import corpus_pipeline as p
from weftline.llm import mixing, packing, toxicity


@pytest.fixture(scope="module")
def input_(spark, docs):
    """The fixture's documents, two texts of one id, rows that are the same, and a group of null ids."""
    rows = [tuple(r) for r in docs.select(*p.COLUMNS).collect()]
    same = "one text that two rows of one id do not share " * 6
    rows += [(7, same, "en", "s1", 1), (8_000, None, "en", "s1", 1), (None, same + "x", "de", "s2", 2), (None, same + "y", "de", "s2", 2), (9_000, "  ", "en", None, 2), (9_000, "  ", "en", None, 2)]
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").repartition(3)


def tuples(df):
    return [tuple(r) for r in df.select(*p.COLUMNS).collect()]


def test_near_duplicates_stage(spark, input_):
    rows = tuples(input_)
    sets = [tuple(WORD.findall((t or "").lower())) for _, t, *_ in rows]
    got = tuples(p.drop_near_duplicates(spark, input_, ""))
    blank = Counter(r for r, s in zip(rows, sets, strict=True) if not s)
    assert Counter(r for r in got if not WORD.search(r[1] or "")) == blank
    kept = [r for r in got if WORD.search(r[1] or "")]
    # Every component keeps one row, of its least id: the number of rows and their ids follow from brute force.
    numbered = [(i, t) for i, (_, t, *_) in enumerate(rows)]
    group = {i: c for i, _, c, _ in brute_components(numbered, 5)}
    members = {}
    for i, s in enumerate(sets):
        if s:
            members.setdefault(group[i], []).append(rows[i])
    least = Counter(min(((r[0] is None, r[0] or 0) for r in m)) for m in members.values())
    assert Counter((r[0] is None, r[0] or 0) for r in kept) == least
    assert set(kept) <= set(rows)


def test_repeated_passages_stage(spark, input_):
    before = p.drop_near_duplicates(spark, input_, "")
    rows = tuples(before)
    want = brute_repeats([(i, t) for i, t, *_ in rows])
    got = tuples(p.drop_repeats(spark, before, ""))
    digest = Counter((r[0], hashlib.sha256((r[1] or "").encode()).hexdigest()) for r in got)
    assert digest == Counter({(i, h): n for (i, _, removed, _, h), n in want.items() if not removed or h != hashlib.sha256(b"").hexdigest()})
    assert all(r[4] == len(r[1]) for r in got)


def test_source_mix_stage(spark, input_):
    want = Counter()
    for r in mixing.mix(input_, extra=("lang", "n_chars")).collect():
        passes = 1 if r["size"] == 0 else sum(r[f"epoch_{e}"] > 0 for e in range(mixing.MOST))
        want[r["doc_id"], r["source"], r["lang"], r["n_chars"]] += passes
    got = tuples(p.mix_sources(spark, input_, ""))
    assert Counter((i, s, lang, n) for i, _, lang, s, n in got) == +want
    assert {(i, t) for i, t, *_ in got} <= {(i, t) for i, t, *_ in tuples(input_)}


def test_toxicity_and_the_whole_run(spark, tmp_path):
    docs, labels = toxic_tables(spark)
    docs.withColumn("n_chars", p.F.length("text").cast("long")).withColumn("text2", p.F.lit(1)).write.parquet(str(tmp_path / "documents.parquet"))
    labels.write.parquet(str(tmp_path / "labels.parquet"))
    table = spark.read.parquet(str(tmp_path / "documents.parquet"))
    scored = toxicity.score(table.select(*p.COLUMNS), toxicity.model_of(table, spark.read.parquet(str(tmp_path / "labels.parquet"))), p.COLUMNS).collect()
    clean = p.drop_toxic(spark, table, str(tmp_path))
    assert clean.columns == p.COLUMNS and Counter(tuples(clean)) == Counter(tuple(r)[:5] for r in scored if r["score"] < 0.7)
    assert 700 < clean.count() < 800
    found = p.run(spark, str(tmp_path)).collect()
    bins = {}
    for r in found:
        bins.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    assert all(sum(n for _, n in b) <= packing.LENGTH and sorted(b)[0][0] == 0 for b in bins.values())
    assert {r["doc_id"] for r in found} <= {r["doc_id"] for r in clean.collect()}


def test_empty_tables_pass_all_stages(spark, empty):
    rows = empty.select(*p.COLUMNS)
    assert p.drop_near_duplicates(spark, rows, "").count() == p.drop_repeats(spark, rows, "").count() == p.mix_sources(spark, rows, "").count() == p.pack_sequences(spark, rows, "").count() == 0


def test_stages_are_named():
    assert [n for n, _ in p.STAGES] == ["toxicity", "near_duplicates", "repeated_passages", "source_mix", "packing"]
    assert p.ORACLE_SQL is None and re.match("Training corpus", p.__doc__)
