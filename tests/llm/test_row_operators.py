"""Sharding, packing, mixing, extraction, rules, classifier and URL rules on small inputs."""

import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from siftwork.llm import hilbert_shards, html_extract, mixing, packing, quality_classifier, quality_rules, queries, url_filter
from siftwork.llm.oracles import ORACLES
from siftwork.llm.queries import QUERIES

FOLDER = "/root/testdata/sf0.001"


# --- sharding


@pytest.mark.parametrize("dimensions, bits", [(1, 4), (2, 4), (3, 3)])
def test_neighbours_on_the_curve_are_neighbours(dimensions, bits):
    grid = np.stack(np.meshgrid(*[np.arange(1 << bits)] * dimensions, indexing="ij")).reshape(dimensions, -1)
    place = hilbert_shards.curve_place(list(grid), bits)
    assert sorted(place) == list(range(1 << (bits * dimensions)))
    assert (np.abs(np.diff(grid[:, np.argsort(place)], axis=1)).sum(0) == 1).all()


def test_shards_are_even_and_slots_gapless(spark, documents):
    rows = [(k % 40, "t" * (k % 7) if k % 11 else None, f"s{k % 5}" if k % 13 else None) for k in range(101)]
    found = hilbert_shards.shard_rows(documents(*rows), ["lang", "source", "n_chars"], 24, ties=["doc_id"]).collect()
    by_shard = defaultdict(list)
    for r in found:
        by_shard[r["shard"]].append(r["slot"])
    assert len(found) == 101 and set(by_shard) == set(range(24))
    assert all(sorted(s) == list(range(len(s))) and len(s) in (4, 5) for s in by_shard.values())
    assert hilbert_shards.shard_rows(documents(), ["source"], 24).count() == 0


def test_columns_of_clashing_names_stay(documents):
    names = ["_curve", "_row", "_d0", "place"]
    df = documents(*[(k, "t" * k, f"s{k % 3}") for k in range(50)])
    df = df.withColumnsRenamed(dict(zip(["doc_id", "text", "lang", "source"], names))).selectExpr("*", "n_chars AS shard", "'x' AS row")
    found = hilbert_shards.shard_rows(df, ["place", "shard", "_d0"], 4, ties=["_curve"])
    assert found.columns == [*names, "n_chars", "row", "shard", "slot"]
    rows = found.collect()
    assert sorted((r["_curve"], r["_row"], r["place"], r["row"]) for r in rows) == [(k, "t" * k, f"s{k % 3}", "x") for k in range(50)]
    assert sorted((r["shard"], r["slot"]) for r in rows) == [(s, k) for s in range(4) for k in range(13 if s in (0, 2) else 12)]


def test_strings_count_whole_and_cells_are_even(spark):
    names = [f"common-crawl-{chr(97 + k)}é" for k in range(8)] + [None, ""]
    rows = [(k, names[k * 7 % 10]) for k in range(1000)]
    df = spark.createDataFrame(rows, "id long, source string")
    places = defaultdict(set)
    for r in hilbert_shards.with_curve(df, ["source"], bits=4).collect():
        places[r["source"] or ""].add(r["_curve"])
    assert all(len(p) == 1 for p in places.values())  # one place for a string, another for every other
    in_order = [min(places[name]) for name in sorted(places)]
    assert len(in_order) == 9 and in_order == sorted(set(in_order))
    many = spark.createDataFrame([(k, f"the-same-long-beginning-{k:05}") for k in range(3200)], "id long, source string")
    sizes = [r["count"] for r in hilbert_shards.with_curve(many, ["source"], bits=4).groupBy("_curve").count().collect()]
    assert sizes == [200] * 16


# --- packing


def naive_bins(lengths, capacity):
    bins = []
    for n in sorted(lengths, reverse=True):
        open_bins = [(room, k) for k, room in enumerate(bins) if room >= n]
        if open_bins:
            bins[min(open_bins)[1]] -= n
        else:
            bins.append(capacity - n)
    return len(bins)


def test_runs_pack_like_piece_by_piece():
    rng = np.random.default_rng(0)
    for _ in range(100):
        capacity = int(rng.integers(1, 30))
        lengths = rng.integers(1, capacity + 1, rng.integers(1, 60)).tolist()
        runs, used = packing.best_fit_decreasing(Counter(lengths), capacity), defaultdict(int)
        for length, n in Counter(lengths).items():
            own = sorted(r for r in runs if r[0] == length)
            for k in range(n):
                _, first, each, start, _ = [r for r in own if r[1] <= k][-1]
                used[start + (k - first) // each] += length
        assert max(used.values()) <= capacity and len(used) == naive_bins(lengths, capacity)


def test_pieces_hold_the_tokenizers_ids(documents):
    from tokenizers import Tokenizer

    slow = Tokenizer.from_file(queries.tokenizer_path())
    texts = ["", None, "Hello  world\n", "a<|endoftext|>b", "naïve 東京 🙂", "word " * 5000, "x" * 3000, " " * 1_000_000 + "end"]
    rows = packing.pack_documents(documents(*enumerate(texts)), queries.tokenizer_path(), with_ids=True).collect()
    pieces = defaultdict(list)
    for r in rows:
        assert r["ids_crc32"] == zlib.crc32(np.array(r["ids"], "<u4").tobytes()) and r["length"] == len(r["ids"])
        pieces[r["doc_id"]].append(r)
    for k, text in enumerate(texts):
        own = sorted(pieces[k], key=lambda r: r["piece"])
        assert [i for r in own for i in r["ids"]] == [*slow.encode(text or "", add_special_tokens=False).ids, 0]
        assert [r["start"] for r in own] == np.cumsum([0, *[r["length"] for r in own]])[:-1].tolist() and all(r["length"] == 2048 for r in own[1:])
    sequences = defaultdict(list)
    for r in rows:
        sequences[r["sequence_id"]].append((r["offset"], r["length"]))
    for places in sequences.values():
        places.sort()
        assert [p[0] for p in places] == np.cumsum([0, *[p[1] for p in places]])[:-1].tolist() and sum(p[1] for p in places) <= 2048
    assert packing.pack_documents(documents(), queries.tokenizer_path()).count() == 0


# --- mixing


def test_targets_stop_at_twice_the_source(spark):
    sizes = spark.createDataFrame([("a", 10), ("b", 1000), ("c", 100), (None, 50)], "source string, size long")
    found = {r["source"]: r["target"] for r in mixing.source_targets(sizes).collect()}
    assert sum(found.values()) == pytest.approx(1.5 * 1160) and found["a"] == 20 and found["c"] == 200 and found[None] == 100 and found["b"] == pytest.approx(1420)


def test_mixture_comes_near_targets(spark, documents):
    rows = [(k, "w " * (k % 9), f"s{k % 3}" if k % 4 else None) for k in range(400)] + [(400, None, "empty"), (7, "w w", "s1")]
    sized = documents(*rows).select("doc_id", "source", mixing.n_words(F.col("text")).alias("size"), F.lit(1).alias("target_note"))
    found = mixing.mix(sized).collect()
    assert len(found) == len(rows) and all(0 <= r["taken"] <= 2 * r["size"] for r in found)
    taken = Counter()
    for r in found:
        taken[r["source"]] += r["taken"]
    assert all(abs(taken[r["source"]] - r["target"]) <= 9 for r in found)
    assert mixing.mix(sized.limit(0)).count() == 0
    assert [r["taken"] for r in mixing.mix(documents((1, None), (2, "")).select("doc_id", "source", F.lit(0).cast("long").alias("size"))).collect()] == [0, 0]


# --- extraction


@pytest.mark.parametrize(
    "page, text",
    [
        (None, ""), ("", ""), ("no tags. At all", "no tags. At all"),
        ("<html><body><nav>Home</nav><article><h1>T &amp; U</h1><p>One,\n two.<br>three</p><p>Short</p><div class='comments'>Nice!</div></article><footer>f</footer>", "T & U\n\nOne, two. three\n\nShort"),
        ("<body><div class=menu><a href=x>Home</a></div><div id=content><h2>Head</h2><p>A sentence, with text. And one more, longer.</p><ul><li>item</li></ul></div><div class='ad'>Buy now, cheap!</div>", "Head\n\nA sentence, with text. And one more, longer.\n\nitem"),
        ("<main><header><h1>In</h1></header><p>Text.<script>var a='</p>'</script> More</p><form>no</form><aside>no</aside></main>", "In\n\nText. More"),
        ("<article><p>cut of</p><p>a &lt; b &am</p><p unfin", "cut of\n\na < b &am"),
    ],
)
def test_main_text(page, text):
    assert html_extract.main_text(page) == text


LEAD, STORY = "A lead, short.", [f"Sentence {k} of the story, with commas, and more words to be long." for k in range(6)]
TOLD = "".join(f"<p>{s}</p>" for s in STORY)


@pytest.mark.parametrize(
    "page, text",
    [
        (f"<body><div class=lead><p>{LEAD}</p></div><div class=story>{TOLD}</div></body>", [LEAD, *STORY]),
        (f"<body><div><h2>One</h2>{TOLD}<ul><li>item</li></ul></div><div><h2>Two</h2><table><tr><td>cell</td></tr></table>{TOLD}</div></body>", ["One", *STORY, "item", "Two", "cell", *STORY]),
        (f"<body><ul><li><a href=x>Home page</a></li></ul><div>{TOLD}</div><h2>Mid</h2><ul><li><a href=y>See</a></li></ul><div>{TOLD}</div><ol><li>note</li></ol></body>", [*STORY, "Mid", "See", *STORY, "note"]),
        (f"<body><form id=aspnetForm><div class=menu>Menu</div><div><h1>Top</h1>{TOLD}</div><div><h3>Sub</h3>{TOLD}</div></form><form>Your mail</form></body>", ["Top", *STORY, "Sub", *STORY]),
        (f"<form id=f><article><h1>Top</h1>{TOLD}</article></form>", ["Top", *STORY]),
    ],
)
def test_main_text_without_an_element_of_its_own(page, text):
    assert html_extract.main_text(page) == "\n\n".join(text)


def test_extraction_of_a_table(spark):
    pages = spark.createDataFrame([(1, "u", None, "x"), (1, "u", "<article><p>é</p></article>", "x"), (None, None, "", "x")], "page_id long, url string, html string, text string")
    assert sorted((r["text"], r["n_chars"]) for r in html_extract.extract(pages).collect()) == [("", 0), ("", 0), ("é", 1)]
    assert html_extract.extract(pages.limit(0)).count() == 0


# --- rules


def test_ledger_and_policies(documents):
    clean = " ".join(f"word{k}" for k in range(30))
    rows = [(1, clean), (2, None), (3, "a b"), (4, "same words again and again " * 8), (5, clean.upper()), (6, "\n".join([clean] * 3)), (7, clean.replace(" ", " %%% "))]
    ledger = quality_rules.ledger(documents(*rows))
    names = list(quality_rules.RULES)
    failed = {r["doc_id"]: {n for k, n in enumerate(names) if r["failed"] >> k & 1} for r in ledger.collect()}
    assert failed == {1: set(), 2: {"short"}, 3: {"short", "word_length"}, 4: {"repeats"}, 5: {"upper_case"}, 6: {"repeats", "dup_lines"}, 7: {"symbols"}}
    alone = {r["rule"]: (r["fails"], r["alone"]) for r in quality_rules.ablations(ledger, quality_rules.POLICIES["v1"]).collect()}
    assert alone["short"] == (2, 1) and alone["repeats"] == (2, 1) and alone["dup_lines"] == (1, 0) and alone["symbols"] == (1, 1)
    assert quality_rules.ledger(documents()).count() == 0


# --- classifier


def test_classifier_on_held_out_documents(spark):
    docs, labels = (queries.table(spark, "/root/testdata/sf0.01", n) for n in ("documents", "labels"))
    rows = QUERIES["op9_quality_classifier"](spark, "/root/testdata/sf0.01").join(labels, "doc_id").filter("held_out").collect()
    assert len(rows) > 50 and sum(r["predicted"] == r["quality"] for r in rows) >= 0.95 * len(rows)
    assert docs.count() == QUERIES["op9_quality_classifier"](spark, "/root/testdata/sf0.01").filter("score between 0 and 1").count()


def test_classifier_without_labels_or_texts(spark, documents):
    none = spark.createDataFrame([(1, None), (None, 1)], "doc_id long, quality int")
    model = quality_classifier.train(documents((1, "a")), none)
    scored = quality_classifier.score(documents((1, None), (2, ""), (2, "")), model)
    assert [r["score"] for r in scored.collect()] == [0.5] * 3 and quality_classifier.score(documents(), model).count() == 0
    one = quality_classifier.fit(np.ones((3, len(quality_classifier.FEATURES))), np.ones(3))
    assert one.bias > 0 and not one.rules


def test_rules_and_scores_beside_any_column_names(documents):
    names = ["_stat_n_words", "SCORE", "n_words", "failed", "a.b", "w`x"]
    docs = documents((1, "one two " * 20), (2, None), (2, None)).select("doc_id", "text", *[F.concat(F.lit(f"own {k} "), "doc_id").alias(n) for k, n in enumerate(names)])
    model = quality_classifier.RuleModel(-1.0, [(("n_words", True, 5.0),)], [2.0])
    scored = quality_classifier.score(docs, model)
    assert scored.columns == [c for c in docs.columns if c != "SCORE"] + ["score"]
    assert sorted((r["doc_id"], r["_stat_n_words"], r["a.b"], round(r["score"], 3)) for r in scored.collect()) == [
        (1, "own 0 1", "own 4 1", 0.731), (2, "own 0 2", "own 4 2", 0.269), (2, "own 0 2", "own 4 2", 0.269),
    ]
    kept = quality_classifier.accepted(docs, model, 0.5)
    assert kept.columns == docs.columns and kept.collect() == docs.filter("doc_id = 1").collect()
    assert quality_classifier.accepted(docs.limit(0), model, 0.5).count() == 0
    ledger = quality_rules.ledger(docs, docs.columns)
    assert ledger.columns == ["doc_id", "text", "_stat_n_words", "SCORE", "a.b", "w`x", *quality_rules.MEASURES, "failed"]
    assert sorted((r["doc_id"], r["n_words"], r["w`x"]) for r in ledger.collect()) == [(1, 40, "own 5 1"), (2, 0, "own 5 2"), (2, 0, "own 5 2")]


def test_pack_keeps_columns_of_any_names(spark):
    rows = [(k, f"p{k}", k * 2, -k, 7) for k in range(1, 60)]
    pieces = spark.createDataFrame(rows, "length long, _place string, _at long, `a.b` int, sequence_id int")
    found = packing.pack(pieces, 60).collect()
    assert sorted(tuple(r)[:4] for r in found) == [r[:4] for r in rows]
    by_bin = defaultdict(list)
    for r in found:
        by_bin[r["sequence_id"]].append((r["offset"], r["length"]))
    for places in by_bin.values():
        ends = [0, *[a + n for a, n in sorted(places)]]
        assert [a for a, _ in sorted(places)] == ends[:-1] and ends[-1] <= 60
    assert packing.pack(pieces.limit(0), 60).count() == 0


# --- URLs


def test_url_parts_rules_and_links(spark):
    urls = [
        "https://A.Example.ORG/es/1?q", "http://example.org/en/12", "http://example.org/en/2", "http://x.com/de/1", "http://x.com/de/2", "http://x.com/de/3", "http://x.com/fr/", "http://x.com/en/",
        "http://bad.net", "http://good.net/#f", "nohost", None, "http://notexample.org",
    ]
    html = {8: "<a href='http://x.com/de/1'>l</a>", 6: '<a href="http://good.net/">g</a>', 9: None}
    pages = spark.createDataFrame([(k, u, html.get(k, "")) for k, u in enumerate(urls)], "page_id long, url string, html string")
    rows = {r["page_id"]: (r["host"], r["path"], r["rule"], r["verdict"]) for r in url_filter.judge(pages).collect()}
    assert rows[0] == ("a.example.org", "/es/1", "example.org/es/", "block") and rows[1] == ("example.org", "/en/12", "example.org/en/1", "block")
    assert rows[2] == ("example.org", "/en/2", "org/", "allow") and rows[7] == ("x.com", "/en/", None, "block")
    assert rows[8] == ("bad.net", "", None, "block") and rows[9] == ("good.net", "/", None, "allow")
    assert rows[10] == rows[11] == ("", "", None, "allow") and rows[12] == ("notexample.org", "", None, "allow")
    assert url_filter.judge(pages.limit(0)).count() == 0


def test_trust_settles_on_chains_rings_and_links_without_a_scheme(spark):
    chain = [(f"c{k}.net", f"c{k + 1}.net") for k in range(14)]  # the last one is blocked by rule
    graph = [*chain, ("c14.net", "example.org"), ("r0.net", "r1.net"), ("r1.net", "r2.net"), ("r2.net", "r0.net"), ("r1.net", "x.com"), ("far.net", "c0.net"), ("good.org", "r0.net")]
    paths = {"example.org": "/es/", "x.com": "/de/", "good.org": "/"}
    rows, hosts = [], sorted({h for e in graph for h in e})
    for k, h in enumerate(hosts):
        links = "".join(f'<a href="//{b}/p">' if b in ("c0.net", "c5.net") else f"<a href=http://{b}/>" for a, b in graph if a == h)
        rows.append((k, f"https://{h}{paths.get(h, '/')}", links))
    pages = spark.createDataFrame(rows, "page_id long, url string, html string")
    found = {r["host"]: r["verdict"] for r in url_filter.judge(pages).collect()}
    assert all(found[f"c{k}.net"] == "block" for k in range(15)) and found["far.net"] == "block"

    at = {h: k for k, h in enumerate(hosts)}
    links = np.zeros((len(hosts),) * 2)
    for a, b in graph:
        links[at[a], at[b]] += 1
    exact = []
    for moves, seeds in ((links, ["good.org"]), (links.T, ["example.org", "x.com"])):
        share = moves / np.maximum(moves.sum(1, keepdims=True), 1)
        start = np.array([0.15 * (h in seeds) for h in hosts])
        exact.append(np.linalg.solve(np.eye(len(hosts)) - 0.85 * share.T, start))
    edges = url_filter.host_edges(pages.select(url_filter.host_of(F.col("url")).alias("host"), "html"))
    seeds = spark.createDataFrame([("good.org", 1, 0), ("example.org", 0, 1), ("x.com", 0, 1)], "host string, trust long, distrust long")
    for r in url_filter.propagate(edges, seeds).collect():
        assert (r["trust"], r["distrust"]) == pytest.approx((exact[0][at[r["host"]]], exact[1][at[r["host"]]]), rel=1e-6, abs=0)


# --- registered queries


@pytest.fixture(scope="module")
def db():
    from oracle_compare import connect

    return connect(FOLDER)


@pytest.mark.parametrize("name", list(ORACLES))
def test_query_matches_its_sql(spark, db, name, monkeypatch):
    import oracle_compare

    monkeypatch.setattr(oracle_compare, "QUERIES", QUERIES)
    monkeypatch.setattr(oracle_compare, "ORACLES", ORACLES)
    assert oracle_compare.differences(spark, db, FOLDER, name) is None


def test_mixture_stage_takes_rows_without_id_and_repeated_ids(spark, documents):
    rows = [(None, "a b c", "x"), (7, "d e", "x"), (7, "f g h i", "y"), (8, "", "y"), (9, "j", None), (9, "j", None)] + [(100 + k, "k l m n o", "z") for k in range(40)]
    docs = documents(*rows).withColumn("size", F.lit("own")).withColumn("taken", F.lit("own"))
    stage = dict(corpus_pipeline.STAGES)["source_mixing"](spark, docs, "")
    assert stage.columns == docs.columns
    got = Counter((r["doc_id"], r["text"], r["source"]) for r in stage.collect())
    sized = docs.select("doc_id", "text", "source", mixing.n_words(F.col("text")).alias("size"))
    expected = Counter()
    for r in mixing.mix(sized).collect():
        expected[r["doc_id"], r["text"], r["source"]] += r["taken"] // r["size"] if r["size"] else 0
    assert got == +expected and {r["size"] for r in stage.collect()} == {"own"}


def test_pipeline_stages(spark):
    docs = queries.table(spark, FOLDER, "documents")
    sizes = [docs.count()]
    for name, stage in corpus_pipeline.STAGES[:-1]:
        docs = corpus_pipeline.materialize(stage(spark, docs, FOLDER), name)
        assert docs.columns == ["doc_id", "text", "lang", "source", "n_chars"]
        sizes.append(docs.count())
    assert sizes[0] > sizes[1] > sizes[2] == sizes[3]
    packed = corpus_pipeline.run(spark, FOLDER)
    assert packed.select("doc_id").distinct().count() == docs.select("doc_id").distinct().count()
    assert packed.groupBy("sequence_id").agg(F.sum("length").alias("n")).filter("n > 2048").count() == 0
