"""Nulls, empty and long texts, ties, repeated rows, empty tables and clashing columns, for each operator and stage."""

from __future__ import annotations

import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from lumenframe.llm import ctw, decontam, html, licenses, lines, mixing, neardup, quality, secrets, topk

WORDS = "stone river cloud maple engine harbor violet window thunder copper meadow falcon lantern".split()
LONG = " ".join(f"{WORDS[i % 13]}{i * 7919 % 1009} {WORDS[i * i % 13]}" for i in range(60_000))
LINE = "a line that is long enough to be judged by everyone"
TAIL, REST = " ".join(WORDS[:9] * 3), " ".join(reversed(WORDS[2:11] * 3))
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, id long, part int, `key` string, `a.b` string, tid long, lf_class string, lf_gone int, words string"
TEXTS = [
    (1, LINE + "\n" + REST), (1, LINE + "\n" + REST), (2, None), (3, ""), (4, " \n\n "), (5, LONG), (None, LINE + "\n" + TAIL),
    (None, None), (6, LINE.replace("everyone", "everyonf")), (6, "short"), (7, "token = \"a1b2c3d4e5f6a7b8c9d0\" é\U0001f600"), (8, LONG), (9, "x"), (9, "x"),
]


@pytest.fixture(scope="module")
def docs(spark):
    rows = [(i, t, "en", None if i == 3 else "s", len(t or ""), 7, 1, "k", "d", 5, "c", 1, "w") for i, t in TEXTS]
    return spark.createDataFrame(rows, SCHEMA)


@pytest.fixture(scope="module")
def labels(spark):
    return spark.createDataFrame([(1, 1, 0), (1, 0, 0), (5, 1, 0), (7, 0, 1), (None, 1, 0), (9, None, 1), (6, 0, 0)], "doc_id long, quality int, toxic int")


@pytest.fixture(scope="module")
def benchmark(spark):
    return spark.createDataFrame([(1, " ".join(LONG.split()[500:530])), (2, None), (3, ""), (None, "no such words in any place at all, and never were there any here"), (4, "x")], "item_id long, text string")


def key(df, *cols):
    return sorted((tuple(r) for r in df.select(*cols).collect()), key=repr)


def test_quality(docs, labels):
    made = quality.classify(docs, labels)
    assert made.columns == [c for c in docs.columns if c != "lf_class"] + ["lf_good", "lf_low", "lf_toxic", "lf_class"]
    got = made.select("doc_id", "text", "lf_class", "lf_good").collect()
    assert len(got) == len(TEXTS)
    for r in got:
        assert (r.lf_class == "unjudged") == (not (r.text or "").strip()) == (r.lf_good is None)
    assert len({(r.lf_class, r.lf_good) for r in got if r.text == LONG}) == 1


def test_quality_without_labels(docs, labels):
    assert {r.lf_class for r in quality.classify(docs, labels.limit(0)).collect()} == {"unjudged"}
    assert quality.classify(docs.limit(0), labels).count() == 0


def test_lines(docs):
    got = {(r.doc_id, r.text): (r.lf_judged, r.lf_gone) for r in lines.dedup(docs).select("doc_id", "text", "lf_judged", "lf_gone").collect()}
    assert got[(1, TEXTS[0][1])] == (2, 0)  # repeated rows are one document
    assert got[(2, None)] == (0, 0) and got[(3, "")] == (0, 0) and got[(4, " \n")] == (2, 1)
    assert got[(None, TAIL)] == (2, 1)  # null ids come last
    assert got[(6, "")] == (1, 1) and got[(6, "short")] == (1, 0)  # a near copy of an earlier line
    assert got[(5, LONG)] == (1, 0) and got[(8, "")] == (1, 1)
    assert lines.dedup(docs).columns == [c for c in docs.columns if c != "lf_gone"] + ["lf_judged", "lf_gone"]
    assert lines.dedup(docs.limit(0)).count() == 0


def test_neardup(docs):
    got = neardup.groups(docs).collect()
    groups = {}
    for r in got:
        groups.setdefault(r.group_id, []).append((r.doc_id, r.kept))
    assert sorted(map(sorted, groups.values()), key=repr) == sorted([[(1, False), (1, True)], [(5, True), (8, False)], [(9, False), (9, True)]], key=repr)
    kept = key(neardup.dedup(docs), "doc_id", "text")
    assert len(kept) == len(TEXTS) - 3 and len(set(kept)) == len(kept)
    assert neardup.dedup(docs).columns == docs.columns
    assert neardup.groups(docs.limit(0)).count() == 0 == neardup.dedup(docs.limit(0)).count()


def test_decontamination(docs, benchmark):
    got = key(decontam.matches(docs, benchmark), "doc_id", "item_id", "words", "item_word")
    assert got == sorted([(5, 1, 30, 0), (8, 1, 30, 0), (9, 4, 1, 0), (9, 4, 1, 0)], key=repr)
    assert decontam.clean(docs, benchmark).count() == len(TEXTS) - 4
    assert decontam.clean(docs, benchmark).columns == docs.columns
    assert decontam.matches(docs, benchmark.limit(0)).count() == 0 == decontam.matches(docs.limit(0), benchmark).count()
    assert decontam.clean(docs, benchmark.limit(0)).count() == len(TEXTS)


def test_mixing(docs):
    made = mixing.mix(docs)
    assert made.columns == docs.columns and made.count() > 0
    assert {r.doc_id for r in made.where("source is null").collect()} <= {3}
    assert {r.source for r in mixing.mix(docs, {"s": 1.0}).collect()} == {"s"}
    assert mixing.mix(docs, {"other": 1.0}).count() == 0 == mixing.mix(docs, {}).count()
    for bad in (-1.0, float("nan"), float("inf")):
        with pytest.raises(ValueError, match="weights"):
            mixing.mix(docs, {"s": bad})
    assert mixing.mix(docs.limit(0)).count() == 0
    flat = docs.where("text is null or text = ''")
    assert mixing.mix(flat).count() == flat.count()  # no characters: as it is


@pytest.fixture(scope="module")
def clashing(spark):
    """Rows that repeat a doc_id and a text but differ in a url, with columns of names that operators might use themselves."""
    rows = [(1, LINE, "s", f"u{i}") for i in (1, 2)] + [(2, REST, "s", "u3"), (3, TAIL, "t", "u4")]
    names = "lf_id lf_tid lf_doc_id lf_stay lf_hash lf_copies lf_source lf_gone_lines row tid gone lines marked_id marked_tid same copies hash row_hash own_hash own_source own_doc_id own_row_hash kept_one lost".split()
    return spark.createDataFrame(rows, "doc_id long, text string, source string, url string").withColumns({**{n: F.lit(n) for n in names}, "a map": F.create_map(F.lit("k"), F.col("url"))})


def test_clashing_names(spark, clashing):
    for make in (mixing.mix, neardup.dedup, lines.dedup, lambda d: lines.stage(spark, d, ""), lambda d: mixing.stage(spark, d, "")):
        made = make(clashing)
        assert made.columns[: len(clashing.columns)] == clashing.columns
        assert all(r.url == r["a map"]["k"] and r.lf_tid == "lf_tid" for r in made.collect())
    one = {s: 1.0 for s in "st"}
    urls = sorted(r.url for r in mixing.mix(clashing.withColumn("text", F.lit("ab")), one).where("source = 's'").collect())
    assert len(set(urls)) == len(urls) == 2  # each row is its own: u1 and u2 aren't swapped for each other
    assert sorted(r.url for r in neardup.dedup(clashing).collect()) in (["u1", "u3", "u4"], ["u2", "u3", "u4"])


def test_ctw(docs):
    got = {(r.doc_id, r.n_bytes): (r.bits, r.bits_per_byte) for r in ctw.score(docs).collect()}
    assert got[(2, None)] == (None, None) and got[(3, 0)] == (0.0, None)
    assert got[(5, len(LONG))] == pytest.approx(got[(8, len(LONG))])
    assert ctw.score(docs).count() == len(TEXTS) and ctw.score(docs.limit(0)).count() == 0


def test_licenses(spark, docs):
    assert licenses.scan(docs).count() == 0 == licenses.scan(docs.limit(0)).count()
    more = spark.createDataFrame([(1, "x " + LONG + " Released undr the MIT License"), (1, None), (2, "")], "doc_id long, text string").withColumn("edits", F.lit("c"))
    (r,) = licenses.scan(more).collect()
    assert (r.license, r.edits, r.stop - r.start) == ("MIT", 1, 29)


def test_secrets(docs):
    (r,) = secrets.scan(docs).collect()
    assert (r.doc_id, r.name, r.literal, r.start) == (7, "token", "a1b2c3d4e5f6a7b8c9d0", 8)
    assert secrets.scan(docs.limit(0)).count() == 0


def test_html(spark):
    page = "<html><body><nav><a href=/>home</a></nav><article><p>%s</p><p>more words here</p></article></body></html>" % ("word " * 40_000)
    rows = [(1, page), (1, page), (2, None), (3, ""), (4, "bare text"), (None, "<p>a<p>b</i></div>"), (5, "<" * 3000), (6, "<div>" * 3000 + "deep")]
    df = spark.createDataFrame(rows, "page_id long, html string").withColumns({"content": F.lit("c"), "path": F.lit("p"), "a.b": F.lit(1)})
    got = html.extract(df).collect()
    assert len(got) == len(rows)
    by = {r.page_id: r for r in got}
    assert by[2].content is None and by[3].content == "" and by[4].content == "bare text" and by[None].content == "a\nb" and by[6].content == "deep"
    assert "more words here" in by[1].content and len({r.content for r in got if r.page_id == 1}) == 1
    assert html.extract(df.limit(0)).count() == 0


def test_topk(spark):
    rows = [(1, [1.0, 0.0]), (1, [1.0, 0.0]), (2, [1.0, 0.0]), (3, [0.5, 0.5]), (4, None), (None, [1.0, 1.0]), (5, []), (6, [float("nan"), 1.0]), (7, [1.0, 2.0, 3.0]), (8, [None, 1.0]), (9, [0.0, 0.0]), (10, [3.0, 2.0, 1.0])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>").withColumns({"id": F.lit("c"), "v": F.lit(0), "rank": F.lit(1), "a.b": F.lit(1)})
    got = key(topk.neighbours(df, 2), "vec_id", "rank", "neighbour", "score")
    assert got == sorted([(1, 1, 2, 1.0), (1, 2, 3, 0.5), (2, 1, 1, 1.0), (2, 2, 3, 0.5), (3, 1, 1, 0.5), (3, 2, 2, 0.5), (9, 1, 1, 0.0), (9, 2, 2, 0.0), (7, 1, 10, 10.0), (10, 1, 7, 10.0)], key=repr)
    assert topk.neighbours(df.limit(0)).count() == 0


def test_stages(spark, docs, labels, benchmark, tmp_path):
    labels.write.parquet(f"{tmp_path}/labels.parquet")
    benchmark.write.parquet(f"{tmp_path}/benchmark.parquet")
    for _, stage in corpus_pipeline.STAGES:
        made = stage(spark, docs, str(tmp_path))
        assert made.columns == docs.columns and made.schema["text"].dataType == docs.schema["text"].dataType
        made.collect()
        assert stage(spark, docs.limit(0), str(tmp_path)).count() == 0
