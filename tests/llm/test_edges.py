"""Nulls, empty and long texts, ties, repeated rows, empty tables and clashing columns, in every operator and stage."""

import random

import pytest

import corpus_pipeline
from graphloom.llm import bestfit_packing, decontaminate, hilbert_shards, html_extract, language_ppm, ngram_join, quality_forest, toxic_segments, url_filter, warc_zstd

DOCS = "doc_id long, text string, lang string, source string, n_chars long, keep int, curve string, shard string, c0 string, `a.b` int, first int"
LONG = "lorem ipsum dolor " * 30000
PROSE = "the quick brown fox jumps over the lazy dog while seven wizards brew a potion near the old stone bridge at night"


def rows():
    plain = [(k, f"{PROSE} number {k} and then {k * 7} more words follow it here.", "en", "s", 120) for k in range(10, 40)]
    odd = [(None, None, None, None, None), (1, None, "en", "s", 0), (2, "", "en", "s", 0), (3, LONG, "en", "s", len(LONG)), (4, PROSE, "en", "s", 100), (4, PROSE, "en", "s", 100), (5, PROSE, None, None, None), (None, PROSE, "de", "t", 100), (6, " \n\t", "xx", "s", 3), (7, "\x00�🙂", "en", "s", 3)]
    return [(*r, 1, "x", "y", "z", 2, 3) for r in plain + odd]


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame(rows(), DOCS).repartition(3)


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], DOCS)


@pytest.fixture(scope="module")
def labels(spark):
    return spark.createDataFrame([(k, int(k % 7 != 0), int(k % 5 == 0)) for k in range(10, 40)] + [(None, 1, 0), (11, None, None), (12, 0, 1), (999, 1, 1)], "doc_id long, quality int, toxic int")


@pytest.fixture(scope="module")
def bench(spark):
    return spark.createDataFrame([(1, PROSE), (2, None), (3, ""), (None, "number words follow it here and nothing else at all"), (4, "short")], "item_id long, text string")


def test_language(docs, empty):
    out = language_ppm.identify(docs).collect()
    assert len(out) == len(rows())
    assert [(r.accepted, r.lang_id, r.bits_per_byte) for r in out if r.doc_id in (1, 2)] == [(False, None, None)] * 2
    assert [(r.accepted, r.lang_id) for r in out if r.doc_id in (4, 10, 39)] == [(True, "en")] * 4
    assert language_ppm.identify(empty).count() == 0
    clash = docs.withColumnsRenamed({"keep": "__accepted", "curve": "accepted", "shard": "lang_id", "c0": "c1"})
    kept = language_ppm.keep_known(clash)
    assert kept.columns == clash.columns and {r.doc_id for r in kept.collect()} >= {4, 5, 10, 39, None}


def test_toxicity(docs, labels, empty):
    out = toxic_segments.toxic_passages(docs, labels).collect()
    assert not out  # no word is significantly toxic here
    r = random.Random(1)
    bad = docs.selectExpr("doc_id", "CASE WHEN doc_id % 5 = 0 THEN concat(text, repeat(' vile rotten', 9)) ELSE text END AS text", "lang", "keep AS toxic")
    more = bad.sparkSession.createDataFrame([(100 + k, " ".join(f"w{r.randrange(400)}" for _ in range(60)) + " vile rotten" * 3 * (k % 2), "en", 1) for k in range(300)], bad.schema)
    many = labels.unionByName(labels.sparkSession.createDataFrame([(100 + k, 1, k % 2) for k in range(300)], labels.schema))
    every = bad.unionByName(more).unionByName(bad.where("doc_id = 5")).unionByName(bad.where("doc_id = 20").selectExpr("CAST(NULL AS long) AS doc_id", "text", "lang", "toxic"))
    out = [r.doc_id for r in toxic_segments.toxic_passages(every, many).collect()]
    assert out.count(5) == 2 and out.count(None) == 1 and {10, 15, 20, 25, 30, 35} <= set(out) and not {1, 2, 3, 4, 6, 7, 11, 12} & set(out)
    assert toxic_segments.toxic_passages(docs, labels.limit(0)).count() == 0
    assert toxic_segments.toxic_passages(empty, labels).count() == 0


def test_join(docs, empty):
    out = {r.doc_id: r for r in ngram_join.near_duplicates(docs).collect()}
    assert (out[4].class_id, out[4].links) == (out[5].class_id, out[5].links) and out[4].links >= 1 and not {1, 2, 3, 6, None} & set(out)
    assert ngram_join.near_duplicates(empty).count() == 0
    kept = ngram_join.keep_one(docs)
    assert kept.columns == docs.columns
    ids = [r.doc_id for r in kept.collect()]
    assert ids.count(4) == 1 and 5 not in ids and 1 in ids and 2 in ids and ids.count(None) == 2
    assert ngram_join.keep_one(empty).count() == 0


def test_join_where_ids_repeat(spark):
    """Rows of one id with two texts, one of them a copy of another document: the other one stays."""
    other = "an entirely different story about seven ships that crossed the cold sea in winter without a map"
    rows = [(1, PROSE, 1, "a"), (2, PROSE, 1, "b"), (2, other, 1, "c"), (3, None, 1, "d"), (None, PROSE, 1, "e"), (4, other + " twice", 1, "f"), (5, PROSE, 1, "g"), (5, PROSE, 1, "g")]
    d = spark.createDataFrame(rows, "doc_id int, text string, key int, `key.1` string")
    kept = ngram_join.keep_one(d)
    assert kept.columns == d.columns
    got = sorted(((r["doc_id"], r["text"]) for r in kept.collect()), key=repr)
    assert len(got) == 4 and (3, None) in got and (None, PROSE) in got and sum(t == PROSE for i, t in got if i) == 1 and sum((t or "").startswith(other) for _, t in got) == 1
    out = sorted(map(tuple, ngram_join.near_duplicates(d).collect()))
    assert out == [(1, 1, 2), (2, 1, 2), (2, 2, 1), (4, 2, 1), (5, 1, 2)]


def test_packing(docs, empty):
    out = bestfit_packing.pack(docs, 2048, 4).collect()
    packed = sum(p.words for r in out for p in r.pieces if p.doc_id == 3)
    assert packed == 90000 and all(r.used + r.free == 2048 for r in out)
    assert sum(p.doc_id == 4 for r in out for p in r.pieces) == 2
    assert not any(p.doc_id in (1, 2, 6) for r in out for p in r.pieces)
    assert sum(p.doc_id is None for r in out for p in r.pieces) == 1 and sum(i is None for r in out for i in r.doc_ids) == 1
    # two bins of the same free space: a piece that fits both goes to the one that came to that first, and makes it full
    tie = bestfit_packing.Packer(10, 4)
    full = [x for k, n in enumerate((7, 7, 3)) for x in tie.add((k, 0, n, 0, 0))]
    assert [[p[0] for p in pieces] for _, pieces in full] == [[0, 2]] and [[p[0] for p in pieces] for _, pieces in tie.close()] == [[1]]
    assert bestfit_packing.pack(empty).count() == 0


def test_labelled_rows_are_bounded(spark):
    from graphloom.llm.labelled import labelled_texts

    d = spark.createDataFrame([(1, f"text {k}") for k in range(500)] + [(2, "x"), (3, None), (None, "y")], "doc_id long, text string")
    l = spark.createDataFrame([(1, 1), (1, 0), (2, 0), (3, 1), (4, 1)], "doc_id long, quality int")
    assert sorted(map(tuple, labelled_texts(d, l, ["quality"], 10, 1).collect())) == [(1, "text 0", 0), (2, "x", 0)]


def test_sharding(docs, empty):
    out = hilbert_shards.shard(docs, run=2000)
    assert out.columns == [c for c in docs.columns if c not in ("curve", "shard")] + ["curve", "shard"]
    assert out.count() == len(rows()) and hilbert_shards.shard(empty).count() == 0
    clash = docs.withColumnsRenamed({"keep": "__v_lang", "c0": "__first", "first": "_value", "shard": "__pieces"})
    out = hilbert_shards.shard(clash, run=2000).drop("curve", "shard")
    same = lambda d: sorted(map(repr, d.select(*[f"`{c}`" for c in clash.columns if c not in ("curve", "shard")]).collect()))
    assert same(out) == same(clash)
    lost = docs.unionByName(docs).unionByName(docs).selectExpr("CAST(NULL AS long) AS doc_id", "text", "'en' AS lang", "'s' AS source", "CAST(rand(1) * 20 + 100 AS long) AS n_chars")
    sizes = [r["count"] for r in hilbert_shards.shard(lost, run=2000).groupBy("shard").count().collect()]
    assert sum(sizes) == 3 * len(rows()) and len(sizes) > 6 and max(sizes) < 40
    one = lost.selectExpr("CAST(monotonically_increasing_id() * 64 AS long) AS doc_id", "text", "lang", "source", "100L AS n_chars")
    sizes = [r["count"] for r in hilbert_shards.shard(one, run=2000).groupBy("shard").count().collect()]
    assert len(sizes) > 6 and max(sizes) < 40


def test_decontamination(docs, bench, empty):
    out = decontaminate.leaks(docs, bench).collect()
    assert {r.doc_id for r in out if r.item_id == 1} >= {4, 5, None, 10, 39}
    assert len([r for r in out if r.doc_id == 4 and r.item_id == 1]) == 1
    assert not any(r.item_id in (2, 3, 4) for r in out)
    twice = docs.sparkSession.createDataFrame([(1, f"{PROSE} then {PROSE}"), (1, PROSE)], "doc_id long, text string")
    (best,) = [r for r in decontaminate.leaks(twice, bench).collect() if r.item_id == 1]
    assert (best.doc_id, best.first_word, best.similarity) == (1, 0, 1.0)  # of equal windows the first, of repeated ids one row
    kept = decontaminate.keep_clean(docs, bench)
    assert kept.columns == docs.columns and {r.doc_id for r in kept.collect()} == {None, 1, 2, 3, 6, 7}
    assert decontaminate.leaks(empty, bench).count() == 0
    assert decontaminate.keep_clean(docs, bench.limit(0)).count() == len(rows())


def test_quality(docs, labels, empty):
    out = quality_forest.quality(docs, labels).collect()
    assert len(out) == len(rows()) and not any(r.keep for r in out if r.doc_id in (1, 2, 6))
    clash = docs.withColumnsRenamed({"keep": "__keep", "curve": "anomaly", "shard": "__anomaly"})
    assert quality_forest.keep_good(clash, labels).columns == clash.columns
    kept = quality_forest.keep_good(docs, labels.limit(0))
    assert kept.columns == docs.columns and kept.count() == len(rows()) - 4
    assert quality_forest.quality(empty, labels).count() == 0


@pytest.fixture(scope="module")
def pages(spark):
    odd = [(None, None, None), (1, "", ""), (2, "http://a.b/c d%20", "<p>x</p>"), (2, "http://a.b/c d%20", "<p>x</p>"), (3, "no\r\nhost", None), (4, None, "<div>" * 5000 + "deep" + "</div>"), (5, "HTTP://WWW.Casino-Win.COM:80/x?y#z", LONG)]
    return spark.createDataFrame([(*r, "k", 1) for r in odd], "page_id long, url string, html string, keep string, score int")


def test_warc(pages):
    frames = warc_zstd.archive(pages)
    same = lambda d: sorted(map(tuple, d.select("page_id", "url", "html").collect()), key=repr)
    assert same(warc_zstd.read(frames)) == same(pages)
    assert warc_zstd.archive(pages.limit(0)).count() == 0


def test_urls(pages):
    out = url_filter.filter_urls(pages).collect()
    assert [r.keep for r in out if r.page_id in (1, 4, None)] == [False] * 3
    assert [(r.host, r.keep) for r in out if r.page_id == 5] == [("casino-win.com", False)]
    assert url_filter.filter_urls(pages.limit(0)).count() == 0


def test_html(pages):
    model = html_extract.fit(60)
    out = {r.page_id: r for r in html_extract.extract(pages, model).collect()}
    assert out[1].text == "" and out[3].text is None and out[4].blocks == 5001 and out[None].text is None
    assert html_extract.extract(pages.limit(0), model).count() == 0


def test_pipeline_stages(spark, docs, empty, labels, bench, tmp_path):
    base = DOCS.split(", ")[:5]
    names = [x.split()[0] for x in base]
    for d in (docs, empty):
        labels.write.mode("overwrite").parquet(f"{tmp_path}/labels.parquet")
        bench.write.mode("overwrite").parquet(f"{tmp_path}/benchmark.parquet")
        d = d.select(*names)
        for k, (_, stage) in enumerate(corpus_pipeline.STAGES):
            out = stage(spark, d, str(tmp_path))
            assert k == 4 or out.columns == names
            out.count()
        d.write.mode("overwrite").parquet(f"{tmp_path}/documents.parquet")
        corpus_pipeline.run(spark, str(tmp_path)).count()


def test_languages_of_few_texts(spark):
    from graphloom.llm import language_ppm

    words = {"aa": "alpha river stone garden window", "bb": "zuko mypra tolwe xindi vebro"}
    few = [(f"{words['aa']} number {k} " * 5) for k in range(5)]
    rows = [("aa", few[k % 5]) for k in range(3000)] + [("bb", f"{words['bb']} item {k} " * 5) for k in range(300)]
    rows += [(f"l{k:03d}", f"{chr(97 + k % 26) * 3}{k} text {j} of this one") for k in range(520) for j in range(3)]
    docs = spark.createDataFrame(rows, "lang string, text string")
    got = language_ppm.chosen(docs, 12).groupBy("lang").count().collect()
    assert {r["lang"]: r["count"] for r in got} == {"aa": 5, "bb": 12} | {f"l{k:03d}": 3 for k in range(520)}
    two = docs.where("lang IN ('aa', 'bb')").selectExpr("monotonically_increasing_id() AS doc_id", "*")
    assert language_ppm.identify(two, 8).where("lang <> lang_id OR lang_id IS NULL").count() == 0


def test_html_without_end_tags():
    from graphloom.llm.html_extract import parse

    body = "<p>The whole article, with a few words.</p><p>And more.</p>"
    text = lambda page: " ".join(t for t in parse(page)[1] if t)
    want = "The whole article, with a few words. And more."
    for head in ("<head><title>a <div> b</title><meta charset=x><script>'<div>'</script></head><body>", "<head><title>t</title><body>", "<head><title>t</title><link rel=x>", "<head><!-- <body> --><style>p{}</style><noscript><p>no</p></noscript>"):
        assert text("<html>" + head + body) == want, head
    assert text("<head><title>t</title>Only text") == "Only text"
    for tag in ("noscript", "iframe src=x", "svg", "template"):
        assert text(f"<html><head><title>t</title></head><body><{tag}>{body}") == want, tag
    assert text(f"<p>a</p><script>{body}") == "a"
