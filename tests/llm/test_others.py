"""Toxicity, pages, vectors, transcripts and the pipeline."""

import random
from collections import Counter

import numpy as np

from weftline.llm import ann, chat, sitetree, toxicity


def levenshtein(a, b):
    p = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        q = [i]
        for j, y in enumerate(b, 1):
            q.append(min(q[-1] + 1, p[j] + 1, p[j - 1] + (x != y)))
        p = q
    return p[-1]


def test_automata_find_what_distance_says():
    r, terms = random.Random(1), ["idiot", "moron", "worthless", "disgusting", "scum", "abcabcab"]
    trie = toxicity.Trie()
    for t in terms:
        trie.add(t)
    for _ in range(4000):
        w = list(r.choice(terms))
        for _ in range(r.randint(0, 3)):
            k = r.randrange(len(w) + 1)
            if r.random() < 0.4:
                w.insert(k, r.choice("abcdeiot"))
            elif w:
                w.pop(min(k, len(w) - 1))
        w = "".join(w)
        near = sorted((levenshtein(w, t), t) for t in terms if toxicity.edits(len(t)) and levenshtein(w, t) <= toxicity.edits(len(t)))
        assert trie.near(w) == (near[0][1] if near and len(w) >= 4 else None)


def toxic_tables(spark):
    r = random.Random(5)
    words = ["".join(r.choice("abcdefgh") for _ in range(r.randint(3, 8))) for _ in range(300)]
    rows, labels = [], []
    for i in range(900):
        w = [r.choice(words) for _ in range(r.randint(5, 60))]
        bad = i % 6 == 0
        if bad:
            for _ in range(r.randint(1, 3)):
                w.insert(r.randrange(len(w)), r.choice(["grumblefish", "snotwick", "dungbeak"]))
        rows.append((i, " ".join(w), "en", "s"))
        labels.append((i, 1, int(bad)))
    rows += [(1000, "you are a grumb1efish truly", "en", "s"), (1001, 'she said "snotwick" is what he called "dungbeak" once', "en", "s"), (1002, None, None, None), (1003, "", "en", "s"), (None, "plain words", "en", "s")]
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, source string"), spark.createDataFrame([*labels, (3, 1, None), (0, 1, 1)], "doc_id long, quality int, toxic int")


def test_toxicity_held_out(spark):
    docs, labels = toxic_tables(spark)
    got = {r["doc_id"]: r for r in toxicity.toxicity(docs, labels).collect()}
    assert len(got) == 905
    held = [r for i, r in got.items() if i is not None and i < 900 and r["held_out"]]
    assert len(held) > 200 and all(r["predicted"] == (r["doc_id"] % 6 == 0) for r in held)
    assert got[1000]["predicted"] == 1, "misspelled"
    assert got[1001]["predicted"] == 0, "quoted"
    assert got[1002]["predicted"] == got[1003]["predicted"] == got[None]["predicted"] == 0


def test_toxicity_without_labels(spark):
    docs, labels = toxic_tables(spark)
    assert toxicity.toxicity(docs, labels.limit(0)).where("predicted = 1").count() == 0
    assert toxicity.toxicity(docs.limit(0), labels).count() == 0


def test_misspellings_of_short_terms_and_of_stems():
    m = toxicity.Matcher(toxicity.Model(frozenset({"scum", "idiot"}), frozenset({"grumbl"}), frozenset({"grumblefish"})))
    for w in ("scuum", "sc0m", "csum", "idoit", "gruumblings", "gr0mblers", "grubmled", "grumpblefish"):
        assert m.mark(w) == 2, w
    for w in ("scum", "grumbles"):
        assert m.mark(w) == 1, w
    for w in ("scamx", "scu", "gamble", "humbled", "plain"):
        assert m.mark(w) == 0, w


def test_words_that_match_no_pattern_have_no_mark():
    import pyarrow as pa
    import pyarrow.compute as pc

    r = random.Random(2)
    terms = ["idiot", "scum", "disgusting", "xyz"]
    m = toxicity.Matcher(toxicity.Model(frozenset(terms), frozenset({"grumbl"}), frozenset({"grumblefish"})))
    words = ["you're", "“said", ">x", "'quoted'"]
    for _ in range(4000):
        w = list(r.choice([*terms, "grumblefish", "your", "wrote"]))
        for _ in range(r.randint(0, 2)):
            k = r.randrange(len(w))
            w[k : k + 1] = r.choice([[], [w[k], r.choice("abe01'-_")], [w[k].upper()], w[k : k + 2][::-1]]) or ["q"]
        words.append(r.choice(["", "(", "5", '"']) + "".join(w) + r.choice(["", ".", "s", "!)"]))
    low = pc.utf8_lower(pa.array(words))
    some = [any(x) for x in zip(*(pc.match_substring_regex(low, pattern=p).to_pylist() for p in m.patterns), strict=True)]
    assert [w for w, s in zip(words, some, strict=True) if m.mark(w) and not s] == [] and not all(some)


def test_near_words_are_judged_by_rates():
    find = {"crown": "clown", "cloun": "clown", "moran": "moron", "noron": "moron", **{f"m{i}ron": "moron" for i in range(4)}}.get
    cleared, barred = toxicity.judged({"crown": 40, "cloun": 1}, {"crown": 4, "cloun": 5}, find, {"clown": 100}, 400, 3200)
    assert cleared == {"crown"} and not barred, "a misspelling quoted once stays one"
    clean = {f"m{i}ron": 1 for i in range(4)}
    assert toxicity.judged(clean, {}, find, {"moron": 100}, 400, 3200) == (frozenset(clean), frozenset({"moron"}))
    assert toxicity.judged(clean, {"moran": 1, "noron": 1}, find, {"moron": 200}, 400, 32_000)[1] == frozenset(), "few for so many clean rows"


PAGE = """<!DOCTYPE html><html><head><title>t</title><style>p{{}}</style><script>var a="</p>";</script></head><body><header><a href=/>Site</a></header><nav><ul><li><a href="/a">Menu</a></ul></nav>
<div class="box"><p>Follow our news each day</p></div><div class="ad">Buy now</div><div class="cookie-notice">We use cookies</div>
<{tag}><h1>Title {n} &amp; more</h1><p><b>First {n}.<br><p>Second  line &copy; {n}<form><input></form><p>Third<ul><li>one {n}</li><li>two</li></ul></{close}>
<section class="comments"><article class="comment"><p>Reader says {n}</p></article></section><aside>Side</aside><footer>&copy; example</footer></body></html>"""


def test_main_text(spark):
    rows = [(i, f"https://h{i % 2}.example/p{i}", PAGE.format(tag="article", close="article", n=i)) for i in range(12)]
    rows += [(100 + i, f"https://plain.example/p{i}", PAGE.format(tag='div class="x"', close="div", n=i)) for i in range(8)]
    rows += [(200, None, None), (201, "x", ""), (202, "https://h0.example/q", "<p>only a <b>paragraph"), (1, rows[1][1], rows[1][2])]
    got = Counter((r["page_id"], r["text"], r["n_chars"]) for r in sitetree.extract(spark.createDataFrame(rows, "page_id long, url string, html string")).collect())
    want = Counter()
    for i, _, html in rows:
        n = i % 100 if 100 <= i < 200 else i
        text = "" if not html else "only a paragraph" if i == 202 else f"Title {n} & more\nFirst {n}.\nSecond line © {n}\nThird\none {n}\ntwo"
        want[i, text, len(text)] += 1
    assert got == want
    assert sitetree.extract(spark.createDataFrame([], "page_id long, url string, html string")).count() == 0


def test_importance_separates_repeated_boxes(spark):
    rows = [(i, f"https://one.example/{i}", PAGE.format(tag="div", close="div", n=i)) for i in range(10)]
    low = [r for r in sitetree.importance(spark.createDataFrame(rows, "page_id long, url string, html string")).collect() if r["importance"] < 0.01]
    assert low and all(r["n"] == 10 for r in low)


BOXED = """<html><body><nav><a href=/>Home</a></nav><{tag}><h1>Title {n}</h1><p>Text {n} is long enough to be the larger part of all this.</p><div class="k3"><p>Read more of our best texts</p></div><p>End {n}</p></{tag}></body></html>"""


def test_repeated_box_inside_an_article_goes(spark):
    schema = "page_id long, url string, html string"
    for tag in ("article", "main"):
        rows = [(n, f"https://box.example/{n}", BOXED.format(tag=tag, n=n)) for n in range(12)]
        rows += [(100 + n, f"https://copy.example/{n}", BOXED.format(tag=tag, n=7)) for n in range(12)]  # copies of one article: nothing of it is told apart
        got = {r["page_id"]: r["text"] for r in sitetree.extract(spark.createDataFrame(rows, schema)).collect()}
        text = "Title {n}\nText {n} is long enough to be the larger part of all this.\n{box}End {n}"
        assert all(got[n] == text.format(n=n, box="") for n in range(12))
        assert all(got[100 + n] == text.format(n=7, box="Read more of our best texts\n") for n in range(12))


def test_box_of_some_pages_is_measured_by_its_parent(spark):
    box = '<div class="s1"><div class="k4">Only in this part of the site</div><p>News {n}</p></div>'
    rows = [(n, f"https://part.example/{n}", f"<html><body>{box.format(n=n) if n < 6 else ''}<p>Text {n}</p></body></html>") for n in range(30)]
    got = {r["page_id"]: r["text"] for r in sitetree.extract(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    assert all(got[n] == (f"News {n}\nText {n}" if n < 6 else f"Text {n}") for n in range(30))


PAGES = "page_id long, url string, html string, host string, low string"
NEUTRAL = """<html><body><div class="r1"><a href=/>Start</a> <a href=/b>More {n}</a></div><div class="r2"><div class="c1"><h1>Title {n}</h1><div class="c7"><p>{text}</p>
<div class="b5">Stay with us for further texts</div><p>{end}</p></div></div><div class="c2"><p>Another text of ours: {other}</p></div></div><div class="r3">Made in {n}</div></body></html>"""  # fmt: skip


def neutral_pages():
    r = random.Random(11)
    say = lambda n: " ".join(r.choice(["sal", "mire", "tokan", "ves", "ulo"]) + str(r.randrange(90)) for _ in range(n))
    made = [(n, say(60), say(20), say(8)) for n in range(12)]
    return [(n, f"https://neutral.example/{n}", NEUTRAL.format(n=n, text=t, end=e, other=o), "h", "l") for n, t, e, o in made], {n: f"Title {n}\n{t}\n{e}" for n, t, e, _ in made}


def test_the_tree_decides_without_telling_names(spark):
    """Ablation: nothing in these pages is named; without the tree's evidence all its branches stay."""
    rows, want = neutral_pages()
    table = spark.createDataFrame(rows, PAGES)
    assert {r["page_id"]: r["text"] for r in sitetree.extract(table).collect()} == want
    for rules, left in (({"share": 2.0, "low": 0.0}, ("Stay with us", "Another text", "Made in")), ({"low": 0.0}, ("Stay with us",)), ({"share": 2.0}, ("Another text", "Made in"))):
        for r in sitetree.extract(table, **rules).collect():
            assert all(x in r["text"] for x in left), rules


def test_importance_by_brute_force(spark):
    """Entropy and shares of every path, counted by hand from the trees of the pages."""
    import math

    rows, _ = neutral_pages()
    rows += rows[:2] + [(90, "https://other.example/", "<body><p>a b<p>c", "h", "l"), (91, None, None, "h", "l"), (92, "::", "", "h", "l")]
    host = lambda u: u.split("/")[2] if u and "//" in u else ""
    nodes, chains = {}, {}
    for page, (_, url, html, _, _) in enumerate(rows):
        found, data = sitetree.places(sitetree.parse(html))
        for p in found:
            nodes.setdefault((host(url), p.path), []).append((page, data[p.first : p.last].tobytes(), p.own))
            chains[host(url), p.path] = p.chain
    weigh, known = {}, {}
    for key, own in nodes.items():
        contents = Counter({c: len({g for g, x, _ in own if x == c}) for _, c, _ in own})
        n = sum(contents.values())
        entropy = sum(-v / n * math.log(v / n) for v in contents.values())
        known[key] = (len({g for g, _, _ in own}), len(own), entropy / math.log(n) if n > 1 else 1.0)
        weigh[key] = known[key][2] * sum(x for _, _, x in own)
    want = {}
    for (h, path), (on, times, imp) in known.items():
        below = sum(w for k, w in weigh.items() if k[0] == h and path in (*chains[k], k[1]))
        rest = (sum(w for k, w in weigh.items() if k[0] == h) - below) * on / max(v[0] for k, v in known.items() if k[0] == h)
        want[h, path] = (on, times, round(imp, 9), round(below / (below + rest) if below > 0 else 0.0, 9))
    got = {(r["host"], r["path"]): (r["on"], r["times"], round(r["importance"], 9), round(r["share"], 9)) for r in sitetree.importance(spark.createDataFrame(rows, PAGES)).collect()}
    assert got == want


def test_forms_around_articles_and_boxes_inside(spark):
    rows = [
        (1, "https://a.example/1", "<form><article><p>Whole page in a form</p><input></article></form>"),
        (2, "https://a.example/2", '<article><p>Mind this</p><div class="alert">An alert of the text</div><div class="widget">Part of it</div><div class="ad">Buy</div></article>'),
        (3, "https://a.example/3", "<div>" * 3000 + "deep" + "</div>" * 3000),
        (4, "https://a.example/4", "<p>" + "long text " * 200_000),
    ]
    got = {r["page_id"]: (r["text"], r["n_chars"]) for r in sitetree.extract(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    assert got[1][0] == "Whole page in a form" and got[2][0] == "Mind this\nAn alert of the text\nPart of it"
    assert got[3][0] == "deep" and got[4][1] == 200_000 * 10 - 1


def nearest(x, ids, q, own, k=10):
    d = np.sqrt(((x - q) ** 2).sum(1))
    best = {}
    for i, s in zip(ids, d.tolist(), strict=True):
        if i != own:
            best[i] = min(s, best.get(i, np.inf))
    return sorted((s, i) for i, s in best.items())[:k]


def found_by(search):
    got = {}
    for r in search.orderBy("query_id", "rank").collect():
        got.setdefault(r["query_id"], []).append((r["score"], r["vec_id"]))
        assert r["rank"] == len(got[r["query_id"]])
    return got


def ask(table):
    return ann.valid(table, "vec_id", "embedding").where("vec_id % 100 = 0").selectExpr("vec_id as query_id", "vector")


def test_neighbours(spark):
    rng = np.random.default_rng(6)
    x = rng.normal(size=(1500, 16)).astype(np.float32)
    x[300:420] = x[300]  # many copies of one vector
    rows = [(i, v.tolist(), "c", 1) for i, v in enumerate(x)] + [(i, v, "c", 1) for i, v in ((2000, None), (2001, [0.0] * 16), (2002, [float("nan")] * 16), (2003, [None, *[1.0] * 15]), (None, x[0].tolist()), (2100, [1.0, 2.0]))]
    table = spark.createDataFrame(rows, "vec_id long, embedding array<float>, cell string, node int")
    got = found_by(ann.search(*ann.index(table, shard=400), ask(table)))
    exact, hits = x.astype(np.float64), 0
    for q in range(0, 1500, 100):
        want = nearest(exact, range(1500), exact[q], q)
        hits += len({i for _, i in want} & {i for _, i in got[q]})
        assert got[q] == sorted(got[q]) and all(abs(s - np.sqrt(((exact[i] - exact[q]) ** 2).sum())) < 1e-9 for s, i in got[q])
    assert hits >= 0.95 * 150
    assert 2100 not in got and [v for _, v in got[300]] == list(range(301, 311))


def test_neighbours_of_repeated_rows_and_large_doubles(spark):
    rng = np.random.default_rng(2)
    x = rng.normal(size=(40, 8))
    rows = [(i, v.tolist()) for i, v in enumerate(x)] + [(0, x[0].tolist())] * 15 + [(900, x[0].tolist())]
    got = found_by(ann.search(*ann.index(t := spark.createDataFrame(rows, "vec_id long, embedding array<double>")), ask(t)))
    assert got[0] == nearest(np.vstack([x, x[0]]), [*range(40), 900], x[0], 0) and got[0][0] == (0.0, 900)
    assert got[900][0] == (0.0, 0)
    far = [(i, (v * 1e150).tolist()) for i, v in enumerate(x)] + [(100, [1.0 + 1e-12] * 8), (101, [1.0] * 8), (102, [1.0 + 3e-12] * 8)]
    got = found_by(ann.search(*ann.index(t := spark.createDataFrame(far, "vec_id long, embedding array<double>")), ask(t)))
    every = np.vstack([x * 1e150, *[np.array(v) for _, v in far[40:]]])
    assert [i for _, i in got[0]] == [i for _, i in nearest(every, [*range(40), 100, 101, 102], x[0] * 1e150, 0)]
    assert [i for _, i in got[100]][:2] == [101, 102], "doubles are told apart"


def test_few_candidates_are_all_found(spark):
    rows = [(i, [float(i % 2 or -1), 1.0 + i * 1e-3]) for i in range(12)]
    t = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    got = found_by(ann.search(*ann.index(t, shard=2), ask(t)))
    assert len(got[0]) == 10
    few = t.where("vec_id < 5")
    assert [i for _, i in found_by(ann.search(*ann.index(few, shard=2), ask(few)))[0]] == [2, 4, 1, 3]


def test_recall_over_shards_of_the_production_size(spark):
    """20,000 unit vectors without any clusters, the hardest case for routing, in four shards."""
    rng = np.random.default_rng(4)
    x = rng.normal(size=(20_000, 32))
    x = (x / np.linalg.norm(x, axis=1)[:, None]).astype(np.float32)
    t = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id long, embedding array<float>").repartition(4)
    graph, router = ann.index(t)
    assert len(router.centroids[32]) == 4 and graph.count() == 20_000
    got, exact = found_by(ann.search(graph, router, ask(t))), x.astype(np.float64)
    want = {q: {i for _, i in nearest(exact, range(20_000), exact[q], q)} for q in range(0, 20_000, 100)}
    assert sum(len(want[q] & {i for _, i in got[q]}) for q in want) >= 0.9 * 10 * len(want)


def test_neighbours_of_empty(spark):
    none = spark.createDataFrame([], "vec_id long, embedding array<float>")
    assert ann.search(*ann.index(none), ask(none)).count() == 0


TALK = [
    (1, 0, None, "You are a helpful tutor."), (1, 1, None, "User: What is 2 + 2?\nAssistant: Sure, it is 4.\nAnything else?"), (1, 2, "user", "Thanks, and 3 + 3?"), (1, 3, "", "It is 6."),
    (2, 0, "human", "### Human: hi\nthere"), (2, 1, "bot", "<|im_start|>assistant\nhello<|im_end|>"), (3, None, None, None), (None, 0, "user", "lost"), (4, 0, "user", ""), (4, 0, "user", ""),
]


def test_transcripts(spark):
    got = [tuple(r) for r in chat.parse_transcripts(spark.createDataFrame(TALK, "conv_id long, turn long, role string, text string")).select("conv_id", "turn", "part", "role", "content").collect()]
    assert {r[3] for r in got if r[0] == 1 and r[1] == 0} == {"system"}
    assert [r[3:] for r in sorted(r for r in got if r[0] == 1 and r[1] == 1)] == [("user", "What is 2 + 2?"), ("assistant", "Sure, it is 4.\nAnything else?")]
    assert (1, 3, 0, "assistant", "It is 6.") in got, "a line without a marker follows its neighbours"
    assert (2, 0, 0, "user", "hi\nthere") in got and any(r[:2] == (2, 1) and r[3:] == ("assistant", "hello") for r in got)
    assert sum(r[0] == 4 for r in got) == 2 and (None, 0, 0, "user", "lost") in got and any(r[0] == 3 for r in got)


def test_whole_lines_are_observed():
    question, statement = "plain words " * 25 + "so?", "y" * 199 + "?" + "y" * 150
    prior = chat.model_of({})
    asked, plain = chat.emission(None, "so?", prior), chat.emission(None, "plain", prior)
    assert len(question) > 300 and (chat.emission(None, question, prior) == asked).all()
    assert statement[:200].endswith("?") and (chat.emission(None, statement, prior) == plain).all()


def test_long_turns_keep_their_role(spark):
    for n in (25, 200, 5_000):
        plain = "\n".join(f"plain line {i}" for i in range(n))
        rows = [(1, 0, "user", "one"), (1, 1, "assistant", plain), (1, 2, "user", plain), (2, 0, None, f"User: one\nAssistant: {plain}")]
        got = sorted((r["conv_id"], r["turn"], r["part"], r["role"], r["content"]) for r in chat.parse_transcripts(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")).collect())
        assert got == [(1, 0, 0, "user", "one"), (1, 1, 0, "assistant", plain), (1, 2, 0, "user", plain), (2, 0, 0, "user", "one"), (2, 0, 1, "assistant", plain)]


def test_blocks_decode_as_the_whole(spark, monkeypatch):
    r = random.Random(8)
    rows = [(c, t, r.choice([None, "user", "assistant"]), r.choice(["Sure, fine.", "What now?", "plain", "User: x\nAI: y"])) for c in range(6) for t in range(40)]
    table = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    want = sorted(map(tuple, chat.parse_transcripts(table).collect()))
    monkeypatch.setattr(chat, "LONG", 9)
    monkeypatch.setattr(chat, "BLOCK_BITS", 3)
    assert sorted(map(tuple, chat.parse_transcripts(table).collect())) == want


def test_viterbi_beats_every_other_path():
    import itertools

    rng, m = np.random.default_rng(9), chat.model_of({})
    for _ in range(20):
        e, change = rng.normal(size=(5, 3)), rng.random(5) < 0.5

        def score(path, e=e, change=change):
            return m.starts[path[0]] + e[0][path[0]] + sum((m.change if change[i] else m.stay)[path[i - 1]][path[i]] + e[i][path[i]] for i in range(1, 5))

        assert abs(score(chat.viterbi(e, change, m)) - max(map(score, itertools.product(range(3), repeat=5)))) < 1e-9


def test_roles_are_recovered_without_the_role_column(spark, tmp_path):
    """Shapes tell roles: long answers, short questions, an instruction ahead of some conversations. Held-out conversations count."""
    r, rows = random.Random(3), []
    say = lambda n: " ".join(r.choice(["la", "morin", "teska", "oli", "venu"]) for _ in range(n))
    for c in range(300):
        roles = ["system"] * (c % 3 == 0) + ["user", "assistant"] * r.randint(1, 4)
        for t, role in enumerate(roles):
            text = say(r.randint(30, 40)) if role == "system" else say(r.randint(3, 25)) if role == "user" else "\n".join(say(r.randint(10, 30)) for _ in range(r.randint(2, 8)))
            rows.append((c, t, role, text, "x"))
    rows += [(1 << 60, (1 << 61) + t, None, say(5), "x") for t in range(3)]
    spark.createDataFrame(rows, "conv_id long, turn long, role string, text string, part string").write.parquet(str(tmp_path / "conversations.parquet"))
    got = {(x["conv_id"], x["turn"]): (x["role"], x["held_out"]) for x in chat.op9_chat_formatting(spark, str(tmp_path)).collect()}
    held = [(got[c, t][0], role) for c, t, role, _, _ in rows if role and got[c, t][1]]
    assert len(got) == len(rows) and len(held) > 200
    assert sum(a == b for a, b in held) > 0.95 * len(held)


def test_no_conversations(spark):
    none = spark.createDataFrame([], "conv_id long, turn long, role string, text string")
    assert chat.parse_transcripts(none, False, chat.fit(none)).count() == 0
