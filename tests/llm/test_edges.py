"""Nulls, empty and long texts, ties, repeated rows, empty tables and clashing columns, for every operator."""

import hashlib

import public_tokenizers
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from busnet.llm import bpe, decontam, langid, lines, minhash, secrets, sharding, suffix, topk, toxicity

LONG = "many words of one long text " * 4000
ROWS = [
    (1, "the first text of some words here"), (2, None), (3, ""), (4, " \n\t "), (5, "the first text of some words here"),
    (5, "the first text of some words here"), (6, LONG), (None, "a text without an id, of some words"), (7, "12 34 !!"),
]
# names that the operators use themselves
CLASH = {"score": 1, "shard": "x", "n": 2, "batch": 3, "key": "k", "band": 4, "lang_pred": "xx", "n_lines": 9, "_spans": 1, "rank": 1, "row": 1, "size": 5, "id": 8, "grp": 1}


@pytest.fixture(scope="module")
def docs(spark):
    df = spark.createDataFrame(ROWS, "doc_id long, text string").repartition(3)
    for name, value in CLASH.items():
        df = df.withColumn(name, F.lit(value))
    return df.withColumn("lang", F.lit("en")).withColumn("source", F.lit(None).cast("string")).withColumn("n_chars", F.length("text"))


def by_id(df, *columns):
    out = {}
    for row in df.collect():
        out.setdefault(row["doc_id"], []).append(tuple(row[c] for c in columns))
    return out


def both(docs):
    return docs, docs.limit(0)


def test_minhash(docs):
    full, empty = both(docs)
    found = by_id(minhash.near_duplicates(full, minhash.Similarity(shingle=4)), "n_shingles", "component_id", "kept")
    assert sum(map(len, found.values())) == len(ROWS)
    assert found[1] == [(4, 1, True)] and found[5] == [(4, 1, False)] * 2
    assert found[2] == [(0, 2, True)] and found[3] == [(0, 3, True)] and found[4] == [(0, 4, True)]
    assert found[6] == [(6, 6, True)] and found[7] == [(1, 7, True)]
    assert found[None] == [(5, None, True)]
    assert minhash.near_duplicates(empty).count() == 0


def test_lines(spark, docs):
    full, empty = both(docs)
    found = lines.without_repeats(full)
    assert found.count() == len(ROWS) and found.filter("n_removed > 0").count() == 0
    assert {r.text for r in found.filter("doc_id = 2").collect()} == {None}
    assert lines.without_repeats(empty).count() == 0
    text = "one\ntwo\nthree"
    rows = [(1, text), (1, text), (2, "zero\n\none\n \ntwo\nfour"), (3, text), (4, "one"), (5, "x\nx\nx\nx")]
    cut = by_id(lines.without_repeats(spark.createDataFrame(rows, "doc_id long, text string")), "text", "n_removed", "emptied")
    assert cut[1] == [(text, 0, False)] * 2  # equal rows are one place
    assert cut[2] == [("zero\n\n \nfour", 2, False)] and cut[3] == [("", 3, True)]
    assert cut[4] == [("one", 0, False)] and cut[5] == [("x", 3, False)]


def test_lone_lines(spark):
    """A long line repeated between other lines, and a copy of a text of one line."""
    long, short = " ".join(f"w{i}" for i in range(55)), "a short line"
    exact = " ".join(f"v{i}" for i in range(13))
    below = exact.rsplit(" ", 1)[0]
    rows = [
        (1, f"one\n{long}\ntwo"), (2, f"three\n\n{long}\nfour"), (3, long), (4, f"{short}\nfive"), (5, f"{short}\nsix"), (6, short),
        (7, exact), (8, f"seven\n{exact}"), (9, below), (10, f"eight\n{below}"), (11, f"{exact} end\nnine\n{exact} end"), (12, f"one\n{long}\ntwo"),
    ]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    cut = by_id(lines.without_repeats(docs, lone=13), "text", "n_removed", "n_runs", "emptied")
    wanted = {d: (t, 0, 0, False) for d, t in rows} | {
        2: ("three\n\nfour", 1, 1, False), 3: ("", 1, 1, True), 8: ("seven", 1, 1, False), 11: (f"{exact} end\nnine", 1, 1, False), 12: ("", 3, 1, True),
    }
    assert cut == {d: [x] for d, x in wanted.items()}
    # lines at the ends of texts that follow each other without a break
    ends = spark.createDataFrame([(i, exact if i % 2 else f"{exact}\n") for i in range(6)], "doc_id long, text string").coalesce(1)
    assert {r.doc_id: r.n_removed for r in lines.without_repeats(ends, lone=13).collect()} == {0: 0} | dict.fromkeys(range(1, 6), 1)
    # without the option only runs of two lines go
    kept = by_id(lines.without_repeats(docs), "n_removed")
    assert {d for d, [(n,)] in kept.items() if n} == {12}


def test_decontamination(spark, docs):
    full, empty = both(docs)
    item = "a b c d e f g h i j k l m n o p q r s t"
    benchmark = spark.createDataFrame([(1, item), (2, None), (3, ""), (4, "too short"), (1, item)], "item_id long, text string")
    extra = spark.createDataFrame([(8, f"before it {item} and after"), (9, item.upper()), (10, item[:20])], "doc_id long, text string")
    found = decontam.matches(full.unionByName(extra, allowMissingColumns=True), benchmark)
    assert {(r.doc_id, r.item_id, r.at, r.similarity) for r in found.collect()} >= {(8, 1, 2, 1.0), (9, 1, 0, 1.0)}
    assert {r.doc_id for r in found.collect()} == {8, 9}
    assert decontam.matches(empty, benchmark).count() == 0 and decontam.matches(full, benchmark.limit(0)).count() == 0
    assert decontam.clean(full, benchmark).count() == len(ROWS)


def test_stages_without_ids(spark):
    """Rows without a doc_id, or with one that other rows have, in the stages that remove documents."""
    text = lambda k: " ".join(f"t{k}w{i}" for i in range(60))
    rows = [
        (1, text(1)), (None, text(1)), (None, text(1) + " more"), (2, text(2)), (2, text(2)), (None, text(3)), (None, text(3)),
        (4, text(4)), (4, text(1)), (-5, text(5)), (None, None), (None, None), (7, text(7)), (2**63 - 40, text(8)),
    ]
    columns = [F.lit(None).cast(k).alias(c) for c, k in (("lang", "string"), ("source", "string"), ("n_chars", "long"))]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3).select("*", *columns)
    pairs = lambda df: sorted(((r.doc_id, r.text) for r in df.collect()), key=str)
    # which of the two rows of doc_id 4 keeps that id is open; the text of row 1 stays once in either case
    wanted = [(1, text(1)), (2, text(2)), (None, text(3)), (4, text(4)), (-5, text(5)), (None, None), (None, None), (7, text(7)), (2**63 - 40, text(8))]
    assert pairs(corpus_pipeline.near_dedup(spark, docs, "")) == sorted(wanted, key=str)

    benchmark = spark.createDataFrame([(None, text(3)), (1, text(2)), (1, text(7))], "item_id long, text string")
    left = [(d, t) for d, t in rows if t not in (text(2), text(3), text(7))]
    assert pairs(decontam.clean(docs, benchmark)) == sorted(left, key=str)
    found = {(r.doc_id, r.item_id) for r in decontam.matches(docs, benchmark).collect()}
    assert found == {(None, None), (2, 1), (7, 1)}


def test_greatest_id(spark):
    """The greatest id beside rows without one."""
    text = lambda k: " ".join(f"t{k}w{i}" for i in range(40))
    rows = [(2**63 - 1, text(1)), (None, text(1)), (None, text(2)), (None, text(2)), (-(2**63), text(3)), (2**63 - 1, text(3))]
    columns = [F.lit(None).cast(k).alias(c) for c, k in (("lang", "string"), ("source", "string"), ("n_chars", "long"))]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3).select("*", *columns)
    found = corpus_pipeline.near_dedup(spark, docs, "").collect()
    assert sorted(((r.doc_id, r.text) for r in found), key=str) == sorted([(2**63 - 1, text(1)), (None, text(2)), (-(2**63), text(3))], key=str)


def test_lines_without_ids(spark):
    """Rows without an id are later than all others, and each a document of its own."""
    text = "first line\nsecond line\nthird line"
    rows = [(None, text), (None, text), (0, text), (None, "alpha\nbeta"), (None, "alpha\nbeta"), (None, "alpha\nbeta\nfirst line"), (None, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3).withColumn("row", F.lit(7)).withColumn("_of", F.lit(7))
    found = lines.without_repeats(docs)
    assert set(docs.columns) < set(found.columns) and {r.row for r in found.collect()} == {7}
    cut = by_id(found, "text", "emptied")
    assert cut[0] == [(text, False)]
    assert sorted(cut[None], key=str) in (
        sorted([("", True)] * 3 + [("alpha\nbeta", False), ("first line", False), (None, False)], key=str),
        sorted([("", True)] * 4 + [("alpha\nbeta\nfirst line", False), (None, False)], key=str),
    )


def test_language_stage(spark, docs):
    """Without any label the documents with letters stay; with many, the cutoff rejects few of the right ones."""
    nothing = docs.withColumn("lang", F.lit(None).cast("string"))
    kept = corpus_pipeline.language(spark, nothing, "")
    assert sorted(r.doc_id or 0 for r in kept.collect()) == sorted(d or 0 for d, t in ROWS if t and any(c.isalpha() for c in t))
    assert corpus_pipeline.language(spark, nothing.limit(0), "").count() == 0
    words = {"en": "the house stands near river bank where water flows", "fr": "la maison est pres de la riviere ou coule eau"}
    rows = [(i, " ".join(words[k].split()[j:] + words[k].split()[:j]) + f" {i}", k) for i in range(9000) for j in [i % 7] for k in [("en", "fr")[i % 2]]]
    rows.append((10**6, "zq xv kj qx wz jq", None))
    some = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    model = langid.fit(some.filter(~langid.held_out()))
    least = langid.least_score(some.filter(langid.held_out()), model, risk=0.01)
    scores = [r.score for r in langid.predict(some, model).collect() if r.lang == r.lang_pred]
    assert 0.5 < least and sum(s < least for s in scores) <= 0.01 * len(scores)
    assert langid.least_score(some.limit(20), model) == 0.0 and langid.least_score(some.limit(0), model) == 0.0


def test_secrets(spark, docs):
    full, empty = both(docs)
    assert secrets.scan(full, F.col("source"), F.col("lang")).filter("spans <> ''").count() == 0
    assert secrets.scan(full, F.col("source"), F.col("lang")).count() == len(ROWS)
    assert secrets.scan(empty, F.col("source"), F.col("lang")).count() == 0
    own, shared = "aB3" * 8, "xY9" * 9
    rows = [
        (1, f"é{own} and {shared} token: abcdefgh", "p"), (2, shared, "q"), (3, "TOKEN=short7 secret=secret=12345678", "q"),
        (4, "AKIA" + "A1" * 6 + " " + "0f" * 16, None), (4, "AKIA" + "A1" * 6 + " " + "0f" * 16, None),
    ]
    found = by_id(secrets.scan(spark.createDataFrame(rows, "doc_id long, text string, o string"), F.col("o"), F.col("o")), "spans", "n_live", "n_owned", "base_sha256")
    assert found[1][0][:3] == ("owned:1:25,assign:58:73", 1, 1)
    assert found[2][0][:3] == ("", 0, 0)
    assert found[3][0][0] == "assign:13:35"
    assert [x[0] for x in found[4]] == ["access:0:16,hex:17:49"] * 2
    assert found[2][0][3] == hashlib.sha256(b"").hexdigest()
    # one owner's value in three repositories is no longer taken for a live one
    spread = spark.createDataFrame([(i, f"{own} token: {shared}", "p", f"r{i}") for i in range(3)], "doc_id long, text string, o string, r string")
    three = by_id(secrets.scan(spread, F.col("o"), F.col("r")), "spans", "n_live", "n_copied", "n_owned", "owners", "repositories")
    assert three == {i: [("assign:25:59", 0, 1, 0, 1, 3)] for i in range(3)}
    two = by_id(secrets.scan(spread.limit(2), F.col("o"), F.col("r")), "spans", "n_live", "n_owned", "repositories")
    assert [x for v in two.values() for x in v] == [("owned:0:24,assign:25:59", 1, 1, 2)] * 2
    # a secret far inside a long text
    far = spark.createDataFrame([(1, "x " * 1500000 + "password=abcdefghij " + "y " * 10)], "doc_id long, text string")
    assert by_id(secrets.scan(far, F.lit("o"), F.lit("r")), "spans")[1] == [("assign:3000000:3000019",)]


def test_suffix(spark, docs):
    full, empty = both(docs)
    found = by_id(suffix.without_repeats(full), "n_bytes", "n_removed", "n_spans")
    assert found[2] == found[3] == [(0, 0, 0)] and found[6] == [(len(LONG), 0, 0)]
    assert sum(map(len, found.values())) == len(ROWS)
    assert suffix.without_repeats(empty).count() == 0
    same = "0123456789" * 6
    rows = [(1, same[:50]), (2, "é" + same), (None, same), (2, "é" + same)]
    found = by_id(suffix.without_repeats(spark.createDataFrame(rows, "doc_id long, text string")), "n_removed", "n_spans")
    assert found == {1: [(0, 0)], 2: [(60, 1)] * 2, None: [(60, 1)]}


def test_toxicity(spark, docs):
    full, empty = both(docs)
    rows = [("nasty words in a text", 1), ("kind words in a text", 0), (None, 0), ("", 1), ("x", None)] * 30
    model = toxicity.fit(spark.createDataFrame(rows, "text string, toxic int"))
    found = toxicity.score(full, model)
    assert found.count() == len(ROWS) and found.filter("score BETWEEN 0 AND 1").count() == len(ROWS)
    assert toxicity.score(empty, model).count() == 0 and toxicity.passages(empty, model).count() == 0
    two = {r.doc_id: r.score for r in toxicity.score(spark.createDataFrame([(1, "so nasty"), (2, "so kind")], "doc_id long, text string"), model).collect()}
    assert two[1] > two[2]
    none = toxicity.fit(spark.createDataFrame([], "text string, toxic int"))
    assert toxicity.score(full, none).count() == len(ROWS)


def test_language(spark, docs):
    full, empty = both(docs)
    model = langid.fit(full)
    found = by_id(langid.predict(full, model), "lang_pred", "score")
    assert found[2] == found[3] == found[4] == found[7] == [("und", 0.0)]
    assert found[1][0][0] == "en" and sum(map(len, found.values())) == len(ROWS)
    assert langid.fit(empty) is None and langid.predict(empty, None).count() == 0
    assert {r.lang_pred for r in langid.predict(full, None).collect()} == {"und"}


def test_bpe(docs):
    full, empty = both(docs)
    path = public_tokenizers.path("byte_bpe_50k.tiktoken")
    found = by_id(bpe.digests(full, path, public_tokenizers.PATTERN), "n_tokens", "decoded_sha256")
    for doc, text in ROWS:
        assert found[doc][0][1] == hashlib.sha256((text or "").encode()).hexdigest()
    assert found[2][0][0] == found[3][0][0] == 0
    assert bpe.digests(empty, path, public_tokenizers.PATTERN).count() == 0


def test_sharding(docs):
    full, empty = both(docs)
    found = sharding.documents_to_shards(full, 4)
    assert found.count() == len(ROWS) and sharding.documents_to_shards(empty, 4).count() == 0
    shard = by_id(found, "shard", "size")
    assert len({s for d in (1, 5) for s in shard[d]}) == 1 and shard[2] == shard[3]


def test_topk(spark):
    nan = float("nan")
    rows = [(0, [1.0, 0.0]), (1, [1.0]), (2, [1.0, 5.0]), (3, None), (4, [nan, 1.0]), (5, [None, 1.0]), (6, []), (20, [1e30, 2.0]), (20, [1e30, 2.0]), (7, [0.5, 0.0])]
    df = spark.createDataFrame(rows, "id long, embedding array<double>")
    found = [tuple(r) for r in topk.search(df, F.col("id") % 20 == 0, topk.Settings(k=3)).orderBy("query_id", "rank").collect()]
    assert found[:3] == [(0, 1, 20, 2**63 - 1), (0, 2, 1, 4096), (0, 3, 2, 4096)]
    assert [r[2] for r in found[3:]] == [0, 1, 2]
    assert topk.search(df.limit(0), F.col("id") % 20 == 0).count() == 0
