"""Line dedup: blocks of lines, long and short lines, groups in a leaf, variable words, texts of templates alone."""

import random
import re

import corpus_pipeline as cp
import pytest

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.fixture
def words():
    rng = random.Random(7)
    return lambda n: " ".join("".join(rng.choice("abcdefghijklmnop") for _ in range(6)) for _ in range(n))


def left(spark, texts):
    docs = spark.createDataFrame([(i, t, "en", "s", len(t)) for i, t in enumerate(texts)], SCHEMA)
    return {r["doc_id"]: r["text"] for r in cp.lines(spark, docs, "").collect()}


def test_blocks_of_lines_go_as_one(spark, words):
    block = [words(6) for _ in range(3)]
    own = [[words(15) for _ in range(4)] for _ in range(20)]
    out = left(spark, ["\n".join([*a[:2], *block, *a[2:]]) for a in own])
    assert out == {i: "\n".join(a) for i, a in enumerate(own)}


def test_near_copies_stay(spark, words):
    copy = [words(12) for _ in range(12)]
    texts = ["\n".join([*copy[:k % 12], words(12), *copy[k % 12 + 1 :]]) for k in range(24)]
    assert left(spark, texts) == dict(enumerate(texts))


def test_lines_of_any_length_go(spark, words):
    notice, own = words(60), [[words(30) for _ in range(3)] for _ in range(36)]
    texts = ["\n".join([a[0], *([notice] if i < 10 else []), a[1], "Read more", a[2], *(["Rare"] if i < 10 else [])]) for i, a in enumerate(own)]
    want = {i: "\n".join([*a, *(["Rare"] if i < 10 else [])]) for i, a in enumerate(own)}
    assert left(spark, texts) == want


def test_texts_of_separate_templates_lose_them(spark, words):
    rng, common = random.Random(3), [words(8) for _ in range(12)]
    own = [words(5) for _ in range(60)]
    texts = ["\n".join([*rng.sample(common, 3), a, *rng.sample(common, 3)]) for a in own]
    assert left(spark, texts) == dict(enumerate(own))


def dropped(spark, texts, line):
    """How often the line, with its place for a word filled in, is gone."""
    out = left(spark, texts)
    return sum(len(line.findall(texts[i])) - len(line.findall(t)) for i, t in out.items())


def with_line(words, line, n=40):
    return ["\n".join([words(15), words(14), line(i), words(13), words(15)]) for i in range(n)]


def test_lines_of_over_fifty_words_go(spark, words):
    notice = words(51)
    assert dropped(spark, with_line(words, lambda i: notice), re.compile(notice)) == 40


def test_a_leaf_holds_many_templates(spark, words):
    """Two templates of one length with the same four first words, each with a variable word, in 30 texts each."""
    head, tails = words(4), [words(5), words(5)]
    texts = with_line(words, lambda i: f"{head} {words(1)} {tails[i % 2]}", 60)
    assert [dropped(spark, texts, re.compile(t)) for t in tails] == [30, 30]


def test_leading_words_may_vary(spark, words):
    tail = words(6)
    assert dropped(spark, with_line(words, lambda i: f"{words(1)} {words(1)} {tail}"), re.compile(tail)) == 40


def test_fields_of_few_values(spark, words):
    """Ten values in each of two places: every value is frequent and no pair of them is."""
    rng, a, b = random.Random(1), [words(1) for _ in range(10)], [words(1) for _ in range(10)]
    parts = [words(3), words(3), words(2)]
    texts = with_line(words, lambda i: f"{parts[0]} {a[i % 10]} {parts[1]} {b[rng.randrange(10)]} {parts[2]}", 200)
    assert dropped(spark, texts, re.compile(parts[2])) >= 190


def test_most_lines_of_many_classes_go(spark):
    """Of the lines of two words or more that stand in 32 classes of near-duplicates or more, nine in ten occurrences go."""
    from pyspark.sql import functions as F

    from meshwalk.llm import log_templates as lt
    from meshwalk.llm import simhash_tiles as sh

    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    of = sh.near_duplicates(docs, ["doc_id"]).select("doc.doc_id", "component_id")
    each = lambda d: d.select("doc_id", F.explode(F.split("text", "\n")).alias("line")).where("trim(line) <> ''").withColumn("m", F.array_join(lt.masked(F.col("line")), " "))
    before = each(docs).join(of, "doc_id").groupBy("m").agg(F.count("*").alias("n"), F.count_distinct("component_id").alias("k")).where("k >= 32 AND m LIKE '% %'")
    after = each(lt.drop_templates(docs)).groupBy("m").agg(F.count("*").alias("still"))
    n, still = before.join(after, "m", "left").agg(F.sum("n"), F.sum(F.coalesce("still", F.lit(0)))).first()
    assert n > 100 and still <= 0.1 * n
