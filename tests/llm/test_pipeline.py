"""The pipeline on planted documents, and the registered queries."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from patternloom.llm import queries, similar

SF = "/root/testdata/sf0.001"


def test_stages_take_effect(spark, tmp_path):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    item = spark.read.parquet(f"{SF}/benchmark.parquet").first().text
    clean = docs.where("source = 'src1' and lang = 'en'").orderBy("doc_id").first().text
    rows = [(100001, f"Lead in. {item} More of it."), (100002, clean + " Planted."), (100003, clean + " Planted."), (100004, clean[::-1] + "\ntoken = 0123456789abcdef0123")]
    planted = docs.unionByName(spark.createDataFrame(rows, "doc_id long, text string").selectExpr("doc_id", "text", "'en' as lang", "'p' as source", "length(text) as n_chars"), allowMissingColumns=True)
    planted = planted.withColumn("n_chars", F.col("n_chars").cast("long")).select(docs.columns)
    now, at = planted, {}
    for k, (name, stage) in enumerate(corpus_pipeline.STAGES):
        stage(spark, now, SF).write.parquet(f"{tmp_path}/{k}")
        now = spark.read.parquet(f"{tmp_path}/{k}")
        at[k] = {r.doc_id for r in now.select("doc_id").collect()}
        if k < len(corpus_pipeline.STAGES) - 1:
            assert now.columns == docs.columns
    assert 100003 not in at[1] or 100002 not in at[0]
    assert 100001 not in at[2]
    assert spark.read.parquet(f"{tmp_path}/3").where("text rlike '0123456789abcdef0123'").count() == 0
    assert at[2] == at[3] == at[4] and len(at[4]) > 100


def test_bitmaps_bound_the_similarity_from_above():
    r = np.random.default_rng(5)
    for _ in range(300):
        x, y = (np.unique(r.integers(0, 2000, r.integers(1, 400)).astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) for _ in range(2))
        y = np.unique(np.concatenate([y, x[: r.integers(0, len(x) + 1)]]))
        both = len(np.intersect1d(x, y))
        assert similar.bound(similar.bitmap(x), similar.bitmap(y), len(x), len(y)) >= both / (len(x) + len(y) - both)
    assert similar.bound(similar.bitmap(x), similar.bitmap(x), len(x), len(x)) == 1


@pytest.mark.parametrize(("open_pairs", "most_bytes"), [(1024, similar.BITMAP_BYTES), (-1, similar.BITMAP_BYTES), (1024, 0)])
def test_near_dedup_keeps_one_row_of_every_group_of_similar_texts(spark, monkeypatch, open_pairs, most_bytes):
    monkeypatch.setattr(similar, "OPEN_PAIRS", open_pairs)
    monkeypatch.setattr(similar, "BITMAP_BYTES", most_bytes)
    r = random.Random(7)
    base = [[r.choice("abcdefghijklmnop") + str(r.randint(0, 40)) for _ in range(r.randint(8, 120))] for _ in range(40)]
    texts = [" ".join(w) for w in base]
    for w in base * 3:
        w = list(w)
        for _ in range(r.randint(1, 3)):
            w[r.randrange(len(w))] = "changed"
        texts.append(" ".join(w))
    common = " ".join(f"c{i}" for i in range(60))
    texts += [f"{common} {' '.join(f'x{k}y{i}' for i in range(40))}" for k in range(8)] + ["", None, "  "]
    rows = list(enumerate(texts)) + [(0, texts[0]), (None, texts[1]), (2, "one id with another text of its own"), (1, texts[45])]
    sets = [{tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} for w in ((t or "").lower().split() for _, t in rows)]
    group = list(range(len(rows)))
    for i in range(len(rows)):
        for j in range(i):
            if len(sets[i] & sets[j]) >= 0.8 * len(sets[i] | sets[j]):
                old, new = group[i], group[j]
                group = [new if g == old else g for g in group]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = [(x.doc_id, x.text) for x in corpus_pipeline.keep_one_of_each(spark, docs, SF).collect()]
    where = {}
    for (i, t), g in zip(rows, group, strict=True):
        where.setdefault((i, t), g)
    assert sorted(where[x] for x in got) == sorted(set(group))
    least = {g: min((i is None, i or 0) for (i, _), h in zip(rows, group, strict=True) if h == g) for g in set(group)}
    assert all((i is None, i or 0) == least[where[i, t]] for i, t in got)


def test_pairs_of_near_copies_are_met_few_times(spark, monkeypatch):
    r = random.Random(3)
    base = [[f"w{r.randint(0, 10**6)}" for _ in range(100)] for _ in range(12)]
    texts = [(i * 5 + k, " ".join([*w[: 20 * k], f"changed{k}", *w[20 * k + 1 :]])) for i, w in enumerate(base) for k in range(5)]
    rows = spark.createDataFrame(texts, "v long, text string")
    held = {}
    for c in similar.cells(rows, 5, 0.8)[1].collect():
        held.setdefault(c.t, set()).add(c.v)
    assert len({frozenset(m) for m in held.values()}) == len(held) and min(map(len, held.values())) > 1
    for members, least in ((1, 1), (1, 100), (64, 2)):
        monkeypatch.setattr(similar, "MEMBERS", members)
        monkeypatch.setattr(similar, "LEAST", least)
        got = similar.one_of_each(rows.withColumnRenamed("v", "doc_id"))
        assert sorted(x.doc_id for x in got.collect()) == [i * 5 for i in range(12)]


def test_texts_of_one_key_get_others(spark, monkeypatch):
    hashed = similar.key
    monkeypatch.setattr(similar, "key", lambda text, salt: hashed(text, salt) if salt > 1 else F.ascii(text).cast("long"))
    docs = spark.createDataFrame([(1, "one text"), (2, "other text"), (3, "one text"), (4, None)], "doc_id long, text string")
    assert sorted(x.doc_id for x in similar.one_of_each(docs).collect()) == [1, 2, 4]


def test_stages_on_odd_rows_and_empty_tables(spark, tmp_path):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    item = spark.read.parquet(f"{SF}/benchmark.parquet").first().text
    key = "ghp_0123456789abcdef01AbCdEfGhIjKl"
    sound = docs.where("source = 'src1' and lang = 'en'").orderBy("doc_id").limit(1).first().text
    rows = [(None, sound + " of its own"), (1_000_001, None), (1_000_001, ""), (1_000_002, f"{sound} {key}"), (1_000_002, "Another text of one id. " * 9), (1_000_003, item), (1_000_003, item), (1_000_004, (sound[:1000] + " ") * 300)]
    odd = spark.createDataFrame(rows, "doc_id long, text string")
    clash = {c: F.lit(c) for c in ("tail", "grade", "set", "component", "_v", "_id", "code", "hits", "spans", "v", "n", "family")}
    wide = docs.select("doc_id", "text").union(odd).union(odd.where("doc_id = 1000002")).withColumns(clash)
    now = wide
    for name, stage in corpus_pipeline.STAGES:
        empty = stage(spark, wide.limit(0), SF)
        assert empty.count() == 0
        out = stage(spark, now, SF)
        if name != "byte-level bpe":
            assert out.columns == wide.columns
        out.write.parquet(f"{tmp_path}/{name}")
        out = spark.read.parquet(f"{tmp_path}/{name}")
        if name == "quality classifier":
            out = wide  # the odd rows go on, whatever the classifier makes of them
        if name == "simhash near-dedup":
            got = sorted((str(r.doc_id), (r.text or "")[:7]) for r in out.where("doc_id is null or doc_id > 1000000").collect())
            assert ("1000002", "Another") in got and sum(i == "1000003" for i, _ in got) <= 1 and out.count() == out.dropDuplicates(["doc_id", "text"]).count()
            out = wide
        if name == "benchmark decontamination":
            assert out.where("doc_id = 1000003").count() == 0 and out.where("doc_id = 1000001").count() == 2
        if name == "secret scans":
            assert out.where(F.col("text").contains("0123456789abcdef01")).count() == 0 and out.where("text is null").count() == 1 and out.where("tail = 'tail'").count() == out.count()
        now = out
    assert now.where("doc_id = 1000002").count() == 4 and now.where("doc_id is null").count() == 1


@pytest.mark.parametrize("name", sorted(queries.queries()))
def test_query_runs_on_the_smallest_tables(spark, name):
    assert queries.queries()[name](spark, SF).count() > 0
