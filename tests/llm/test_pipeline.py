"""The pipeline over small tables, stage by stage against brute force."""

from __future__ import annotations

import os
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from platen.llm import quality, simhash, toxicity
from platen.llm.common import remainder, spanning, stored, table

from .test_llm import brute_lines

SF = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="needs the driver's tables")


def components_by_jaccard(texts):
    """The smallest number that each text reaches over all pairs at 0.8; texts without words are one."""
    words = [re.findall(r"[^\x20\x09-\x0d]+", "".join(c.lower() if c.isascii() else c for c in t or "")) for t in texts]
    sets = [{tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set() for w in words]
    near = [[x == y or len(x & y) / max(1, len(x | y)) >= 0.8 for y in sets] for x in sets]
    return spanning(len(texts), *np.nonzero(near))


def kept(df):
    return {r.doc_id: r.text for r in df.collect()}


def test_stages(spark):
    docs = table(spark, SF, "documents")
    stages = dict(corpus_pipeline.STAGES)
    assert list(stages) == ["quality", "toxicity", "lines", "near_duplicates", "packing"]
    labels = table(spark, SF, "labels")

    good = stored(stages["quality"](spark, docs, SF), "t1")
    model = quality.train(docs, labels.where(remainder("doc_id", 4) != 2))
    assert good.columns == docs.columns and kept(good) == kept(docs.join(quality.score(docs, model).where("score >= 0.5"), "doc_id", "left_semi"))

    clean = stored(stages["toxicity"](spark, good, SF), "t2")
    model = toxicity.train(good, labels.where(remainder("doc_id", 3) != 1))
    assert clean.columns == docs.columns and kept(clean) == kept(good.join(toxicity.score(good, model).where("score < 0.5"), "doc_id", "left_semi"))

    short = stored(stages["lines"](spark, clean, SF), "t3")
    wanted = {k: v[0] for (k, _), v in brute_lines(set(kept(clean).items())).items()}
    assert short.columns == docs.columns and kept(short) == wanted
    assert short.where(F.length("text") != F.col("n_chars")).isEmpty()

    single = stored(stages["near_duplicates"](spark, short, SF), "t4")
    rows = sorted(kept(short).items())
    root = components_by_jaccard([t for _, t in rows])
    assert single.columns == docs.columns and kept(single) == {k: t for n, (k, t) in enumerate(rows) if root[n] == n}

    packed = stages["packing"](spark, single, SF)
    whole = packed.groupBy("doc_id").agg((F.sum("length") == F.first("doc_tokens")).alias("whole")).collect()
    assert {r.doc_id for r in whole} == set(kept(single)) and all(r.whole for r in whole)
    key = lambda df: sorted((r.doc_id, r.start, r.length, r.ids_crc32) for r in df.collect())
    assert sum(r[2] for r in key(packed)) == sum(r[2] for r in key(corpus_pipeline.run(spark, SF)))


def test_near_duplicates_reach_jaccard(spark):
    rng = np.random.default_rng(23)
    body = [f"w{n}" for n in rng.integers(0, 5000, 240)]
    texts = [" ".join(f"v{n}" for n in rng.integers(0, 5000, 90)) for _ in range(20)] + [" ".join(body), " ".join(body).upper(), "", " ", "one two"]
    for n in range(30):
        own = list(body)
        for at in rng.integers(0, 240, n % 9):
            own[at] = f"x{n}"
        texts.append(" ".join(own))
    root = components_by_jaccard(texts)
    docs = spark.createDataFrame([(i, t) for i, t in enumerate(texts)] + [(20, texts[20]), (None, "one two")], "doc_id long, text string")
    made = sorted((r.doc_id is None, r.doc_id) for r in corpus_pipeline.drop_near_duplicates(spark, docs, SF).collect())
    assert made == [*((False, k) for k in sorted(set(root.tolist()))), (True, None)]


def test_near_copies_in_chunks(spark, monkeypatch):
    """Chains and groups whose middle is missing, in chunks of few texts."""
    rng = np.random.default_rng(29)
    texts = []
    for _ in range(6):
        body = [f"w{n}" for n in rng.integers(0, 900, 150)]
        for _ in range(25):
            own = list(body)
            for at in rng.integers(0, 150, rng.integers(1, 9)):
                own[at] = f"x{rng.integers(0, 90)}"
            texts.append(" ".join(own))
    root = components_by_jaccard(texts)
    monkeypatch.setattr(simhash, "CHUNK", 7)
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").withColumn("node", F.lit(1)).withColumn("band", F.lit(1))
    made = {r.doc_id: r.component_id for r in simhash.near_copies(docs).collect()}
    assert made == dict(enumerate(root.tolist())) and len(set(made.values())) > 6
    assert simhash.near_copies(docs.limit(0)).collect() == []


def test_stages_on_odd_rows(spark, tmp_path):
    """Nulls in any column, empty texts, repeated rows, extra columns with clashing names, and no rows at all."""
    rng = np.random.default_rng(43)
    texts = [None, "", " ", "a\nb\nc", "x\na\nb\nc", *[" ".join(f"w{n}" for n in rng.integers(0, 300, 60)) for _ in range(20)]]
    rows = [(i, t, None if i == 2 else "en", "s", None if i == 3 else len(t or ""), "r", 1, "n", 0.5) for i, t in enumerate(texts)]
    rows += [rows[3], rows[7], (None, texts[8], None, None, None, None, None, None, None)]
    kind = "doc_id long, text string, lang string, source string, n_chars long, removed string, band int, node string, score double"
    labels = [(i, i % 2, int(i % 5 == 0)) for i in range(25)] + [(None, 1, 0), (3, None, None)]
    for at, some, known in (("some", rows, labels), ("none", [], []), ("unknown", rows, [])):
        sf = f"{tmp_path}/{at}"
        spark.createDataFrame(known, "doc_id long, quality int, toxic int").write.parquet(f"{sf}/labels.parquet")
        spark.createDataFrame(some, kind).write.parquet(f"{sf}/documents.parquet")
        docs = table(spark, sf, "documents")
        for name, stage in corpus_pipeline.STAGES[:-1]:
            made = stage(spark, docs, sf)
            assert made.dtypes == docs.dtypes, name
            if at == "unknown" and name in ("quality", "toxicity"):
                assert made.count() == len(rows)
            if name == "lines" and at != "some":
                assert {r.text for r in made.where("doc_id = 4").collect()} <= {"x"}
            docs = stored(made, "odd")
        packed = corpus_pipeline.STAGES[-1][1](spark, docs, sf)
        assert packed.select("doc_id").distinct().count() == docs.select("doc_id").distinct().count()
        assert corpus_pipeline.run(spark, sf).count() == packed.count()


def test_near_duplicates_move_few_texts(spark):
    """Texts that are like no other stay where they are: only those that may go, and those that are compared, are moved."""
    rng = np.random.default_rng(31)
    texts = [" ".join(f"w{n}" for n in rng.integers(0, 10**6, 5000)) for _ in range(80)]
    docs = stored(spark.createDataFrame([*enumerate(texts), (200, texts[7]), (3, texts[3])], "doc_id long, text string"), "unlike")

    def moved():
        sc = spark.sparkContext._jsc.sc()
        sc.listenerBus().waitUntilEmpty(30_000)
        found = sc.statusStore().executorList(False)
        return sum(found.apply(k).totalShuffleWrite() for k in range(found.size()))

    name = "spark.sql.autoBroadcastJoinThreshold"
    old, before = spark.conf.get(name), moved()
    spark.conf.set(name, "-1")
    try:
        made = corpus_pipeline.drop_near_duplicates(spark, docs.where("doc_id <> 3"), SF)
        assert kept(made) == {k: t for k, t in enumerate(texts) if k != 3}
        assert moved() - before < 0.3 * sum(map(len, texts))
    finally:
        spark.conf.set(name, old)
    assert sorted(r.doc_id for r in corpus_pipeline.drop_near_duplicates(spark, docs, SF).collect()) == list(range(80))
