"""The operators of platen.llm on small rows: brute force, nulls, empty and long texts, ties, repeats, empty tables, clashing columns."""

from __future__ import annotations

import hashlib
import math
import random
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from platen.llm import boosting, bpe, common, hmm, lines, packing, quality, quantise, queries, simhash, toxicity, voronoi, warc
from platen.llm.common import components, sifted, spanning

P = pytest.importorskip("public_tokenizers")
LONG = "".join(random.Random(3).choice("ab c\nd") for _ in range(60_000))
TEXTS = [None, "", " \n\t ", "One two three four.", "One two three four.", "ünï çödé 日本 <|endoftext|> it's", LONG, "a  b   c \n\n d  "]


def frame(spark, texts, first=0):
    """With columns whose names clash with those that operators use inside."""
    rows = [(i + first, t, "x", 1, 2, 3) for i, t in enumerate(texts)]
    return spark.createDataFrame(rows, "doc_id long, text string, key string, fp int, id int, g int")


@pytest.fixture(scope="module")
def docs(spark):
    rows = frame(spark, TEXTS)
    return rows.union(rows.where("doc_id = 3")).union(rows.where("doc_id = 5").withColumn("doc_id", F.lit(None).cast("long")))


def test_packing_in_blocks(spark, docs, monkeypatch):
    """Texts are encoded in blocks of packing.BLOCK bytes; the pieces don't depend on it."""
    rows = docs.coalesce(1).sortWithinPartitions("doc_id")
    made = []
    for size in (1, packing.BLOCK):
        monkeypatch.setattr(packing, "BLOCK", size)
        made.append([tuple(r) for r in packing.pack(rows, P.path("word_bpe_49k.json"), end=2).collect()])
    assert made[0] == made[1] and len(made[0]) >= docs.count()


@pytest.mark.parametrize("bits", [64, 1 << 24])
def test_sifted(spark, monkeypatch, bits):
    """The rest has none of the keys, rows and columns stay as they are, whatever is null, repeated or named like what is used inside."""
    monkeypatch.setattr(common, "SIFTED", bits)
    rows = [(k, n, None, n % 3) for n, k in enumerate([*range(-20, 300), 5, 5, None, None])]
    rows = spark.createDataFrame(rows, "doc_id long, word long, bits string, own int")
    for wanted in ([5, 7, -3, 900, None], [], list(range(-20, 300))):
        keys = spark.createDataFrame([(k,) for k in wanted], "doc_id long")
        may, rest = sifted(rows, keys, "doc_id")
        assert may.dtypes == rest.dtypes == rows.dtypes
        assert sorted(map(str, [*may.collect(), *rest.collect()])) == sorted(map(str, rows.collect()))
        assert not {r.doc_id for r in rest.collect()} & {k for k in wanted if k is not None}
        if bits > 64:
            assert {r.doc_id for r in may.collect()} - {None} == set(wanted) & {*range(-20, 300)}


def test_spanning_and_components(spark):
    assert spanning(6, np.array([0, 4, 2]), np.array([2, 5, 1])).tolist() == [0, 0, 0, 3, 4, 4]
    chain = [(i, i + 1) for i in range(40)] + [(100, 101), (101, 102), (7, 7)]
    found = dict(map(tuple, components(spark.createDataFrame(chain, "a long, b long")).collect()))
    assert all(found[i] == 0 for i in range(41)) and found[102] == 100
    assert components(spark.createDataFrame([], "a long, b long")).collect() == []


@pytest.mark.parametrize("blocks", [1, 7])
def test_hmm_base_and_probability(spark, docs, monkeypatch, blocks):
    monkeypatch.setattr(hmm, "SPAN", 2)
    docs = docs.repartition(blocks)
    made = hmm.scores(docs, F.coalesce(F.col("doc_id") % 2 == 1, F.lit(False)), states=3, iterations=2).collect()
    tokens = lambda t: (t or "").encode().lower().split() + [None]
    rows = [(r.doc_id, r.text) for r in docs.collect()]
    counts = Counter(w for k, t in rows if k is not None and k % 2 for w in tokens(t))
    total, kinds = sum(counts.values()), len(counts)
    wanted = sorted((k is None, k or 0, len(tokens(t)), sum(counts[w] > 0 for w in tokens(t)), total, sum(math.log10((counts[w] + 0.5) / (total + 0.5 * (kinds + 1))) for w in tokens(t))) for k, t in rows)
    found = sorted((r.doc_id is None, r.doc_id or 0, r.n_tokens, r.n_known, r.train_tokens, r.base_score) for r in made)
    assert len(found) == len(wanted)
    for a, b in zip(found, wanted, strict=True):
        assert a[:5] == b[:5] and math.isclose(a[5], b[5], rel_tol=1e-9)
    assert all(r.score < 0 for r in made)
    assert hmm.scores(docs.limit(0), F.lit(True)).collect() == []
    assert all(r.train_tokens == 0 and r.n_known == 0 for r in hmm.scores(docs, F.lit(False)).collect())


def test_hmm_reads_and_writes_in_small_pieces(spark, monkeypatch):
    """A task writes one file and sorts no block, gets its rows in batches of about a block, and packs the block's word numbers."""
    kept = {}

    def spied(df, name, **how):
        kept[name] = (spark.conf.get("spark.sql.execution.arrow.maxBytesPerBatch"), how, common.stored(df, name, **how))
        return kept[name][-1]

    monkeypatch.setattr(hmm, "stored", spied)
    before = spark.conf.get("spark.sql.execution.arrow.maxBytesPerBatch")
    draw = random.Random(5)
    texts = [" ".join(draw.choice("abcdefgh") for _ in range(400)) for _ in range(40)]
    assert hmm.scores(frame(spark, texts).repartition(3), F.lit(True), states=2, iterations=1).count() == 40
    size, how, read = kept["words"]
    assert size.rstrip("b") == str(hmm.BLOCK) and spark.conf.get("spark.sql.execution.arrow.maxBytesPerBatch") == before
    assert not how and len(read.inputFiles()) == 3
    found = Counter()
    for r in read.where("kind = 0").collect():
        word = hmm._unpacked(bytes(r.word), sum(r.sizes))
        assert len(r.word) < 2 * len(word)
        found.update(np.bincount(word).tolist())
    assert sum(n * k for n, k in found.items()) == 40 * 400


def test_batches_of(spark):
    rows = spark.range(3000, numPartitions=1).select(F.repeat(F.lit("x"), 1000).alias("text"))

    def run(batches):
        for batch in batches:
            yield pa.RecordBatch.from_arrays([pa.array([batch.num_rows])], names=["n"])

    counted = lambda: [r.n for r in rows.mapInArrow(run, "n long").collect()]
    assert counted() == [3000]
    with pytest.raises(KeyError), common.batches_of(spark, 100_000):
        some = counted()
        raise KeyError
    assert sum(some) == 3000 and max(some) < 200
    assert counted() == [3000]


def test_hmm_training_does_not_depend_on_blocks_at_once(spark, docs, monkeypatch):
    monkeypatch.setattr(hmm, "BLOCK", 1)
    made = []
    for n in (1, 2, 50):
        monkeypatch.setattr(hmm, "TOGETHER", n)
        made.append(sorted(r.score for r in hmm.scores(docs.coalesce(1), F.coalesce(F.col("doc_id") % 2 == 1, F.lit(False)), states=3, iterations=2).collect()))
    for scores in made[1:]:
        assert all(math.isclose(a, b, rel_tol=1e-4) for a, b in zip(scores, made[0], strict=True))


def test_forward_is_the_sum_over_paths():
    rng = np.random.default_rng(1)
    unit = lambda x, axis: x / x.sum(axis=axis, keepdims=True)
    model = hmm.Model(unit(rng.random(2), 0), unit(rng.random((2, 2)), 1), unit(rng.random((hmm.CLASSES + 1, 2)), 0))
    texts = [[3, 5, 7], [9], [1, 1, 2, 4]]
    layout = hmm.Layout(np.array([len(x) for x in texts]))
    flat = np.empty(8, np.int64)
    flat[layout.place] = np.concatenate(texts)
    logs = hmm.forward(model, flat, layout, False)[0]
    for rank, k in enumerate(layout.order):
        total = 0.0
        for path in np.ndindex(*[2] * len(texts[k])):
            p = model.start[path[0]]
            for t, c in enumerate(texts[k]):
                p *= model.emit[c, path[t]] * (model.step[path[t - 1], path[t]] if t else 1)
            total += p
        assert math.isclose(logs[rank], math.log(total), rel_tol=1e-9)
    before = model
    for _ in range(4):
        start, moves, counts, log = hmm.expected(before, flat, layout)
        assert math.isclose(start.sum(), 3, rel_tol=1e-4) and math.isclose(moves.sum(), 5, rel_tol=1e-4) and math.isclose(counts.sum(), 8, rel_tol=1e-4)
        after = hmm.Model(unit(start + 1e-9, 0), unit(moves + 1e-9, 1), unit(counts + 1e-9, 0))
        assert hmm.expected(after, flat, layout)[3] >= log - 1e-4
        before = after


def brute_lines(rows):
    seen, out = {}, {}
    for k, t in sorted(rows):
        part = t.split("\n")
        for p in range(len(part) - 2):
            window = tuple(part[p : p + 3])
            if seen.setdefault(window, (k, t, p)) != (k, t, p):
                out.setdefault((k, t), set()).update(range(p, p + 3))
    return {(k, t): ("\n".join(x for i, x in enumerate(t.split("\n")) if i not in out.get((k, t), ())), sorted(out.get((k, t), ()))) for k, t in rows}


def test_lines(spark, docs):
    texts = ["a\nb\nc\nd", "x\na\nb\nc\ny", "a\na\na\na", "a\nb", "q\na\nb\nc", "\n\n\n", "\n\n\nz", "b\nc\nd\na\nb\nc"]
    rows = frame(spark, texts)
    rows = rows.union(rows.where("doc_id = 1"))
    made = lines.dedup_lines(rows).collect()
    wanted = brute_lines({(i, t) for i, t in enumerate(texts)})
    assert len(made) == 9 and made[0].asDict().keys() == {*rows.columns, "removed"}
    by_id = {i: v for (i, _), v in wanted.items()}
    assert all((r.text, r.removed) == by_id[r.doc_id] for r in made)
    assert lines.dedup_lines(docs).count() == docs.count()
    assert {r.doc_id for r in lines.dedup_lines(docs).where("text IS NULL").collect()} == {0}
    assert lines.dedup_lines(docs.limit(0)).collect() == []


def test_differencing():
    rng = random.Random(5)
    for n in (0, 1, 5, 60):
        sizes = [rng.randint(1, 900) for _ in range(n)]
        windows = packing.pack_group(sizes, 1000)
        assert sorted(x for w in windows for x in w) == list(range(n))
        assert all(sum(sizes[x] for x in w) <= 1000 for w in windows)
    sums = [sum([8, 7, 6, 5, 4][x] for x in w) for w in packing.difference([8, 7, 6, 5, 4], 2)]
    assert max(sums) - min(sums) <= 2


def test_packing(spark, docs):
    tokenizers = pytest.importorskip("tokenizers")
    library = tokenizers.Tokenizer.from_file(P.path("word_bpe_49k.json"))
    made = packing.pack(docs, P.path("word_bpe_49k.json"), 2).collect()
    ids = {r.doc_id: library.encode(r.text or "", add_special_tokens=False).ids + [2] for r in docs.collect()}
    sequences = {}
    for r in made:
        assert np.frombuffer(r.ids, "<u4").tolist() == ids[r.doc_id][r.start : r.start + r.length] and r.doc_tokens == len(ids[r.doc_id])
        sequences.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for parts in sequences.values():
        parts.sort()
        assert [a for a, _ in parts] == np.cumsum([0, *[n for _, n in parts]])[:-1].tolist() and sum(n for _, n in parts) <= 4096
    copies = Counter(r.doc_id for r in docs.collect())
    total = Counter()
    for r in made:
        total[r.doc_id] += r.length
    assert total == Counter({k: len(v) * copies[k] for k, v in ids.items()})
    assert packing.pack(docs.limit(0), P.path("word_bpe_49k.json"), 2).collect() == []


def test_boosting_learns_an_interaction():
    x = np.random.default_rng(2).random((2000, 3))
    y = ((x[:, 0] > 0.5) ^ (x[:, 1] > 0.5)).astype(float)
    model = boosting.fit(x, y, pairs=2)
    assert ((model.score(x) > 0.5) == y).mean() > 0.95
    assert boosting.fit(np.zeros((0, 3)), np.zeros(0)).score(x[:2]).tolist() == [0.5, 0.5]


def test_quality(spark, docs):
    rng = random.Random(8)
    word = lambda: "".join(rng.choice("etaoin") for _ in range(4))
    texts = [" ".join(word() for _ in range(60)) + "." if i % 2 else " ".join([word() + "$$$"] * 50) for i in range(120)]
    rows = frame(spark, texts)
    labels = spark.createDataFrame([(i, i % 2) for i in range(100)] + [(3, None), (None, 1), (5, 1)], "doc_id long, quality int")
    model = quality.train(rows, labels)
    made = {r.doc_id: r.score for r in quality.score(rows, model).collect()}
    assert all((made[i] > 0.5) == bool(i % 2) for i in range(120))
    assert {r.doc_id for r in quality.keep_good(rows, model, 0.5).collect()} == set(range(1, 120, 2))
    assert quality.keep_good(docs, model, 0.0).columns == docs.columns
    assert quality.score(docs, model).count() == docs.count()
    none = quality.train(rows, labels.limit(0))
    assert {round(r.score, 9) for r in quality.score(docs, none).collect()} == {0.5}
    assert quality.score(docs.limit(0), model).collect() == []


def test_bpe(spark, docs):
    tiktoken = pytest.importorskip("tiktoken")
    ranks = P.path("byte_bpe_multi_50k.tiktoken")
    with open(ranks, "rb") as file:
        own = bpe.ByteRanks(file.read(), P.PATTERN)
    library = tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=own.ids, special_tokens={})
    made = bpe.encode_decode(docs, ranks, P.PATTERN).collect()
    text = {r.doc_id: r.text or "" for r in docs.collect()}
    assert len(made) == docs.count()
    assert all(r.ids == library.encode_ordinary(text[r.doc_id]) and bytes(r.decoded) == text[r.doc_id].encode() for r in made)
    odd = ["　\xa0 a\x85b \x1c c", "   x", "a" * 900 + "b" * 500, " ".join(["\n", "", "", "k"]), "x \n y", "'s 'll I'D", "😀‍👩 é́"]
    ids, sizes = own.texts(pa.array(odd))
    ends = np.cumsum([0, *sizes])
    assert [ids[a:z].tolist() for a, z in zip(ends, ends[1:], strict=False)] == [library.encode_ordinary(t) for t in odd]
    assert bpe.encode_decode(docs.limit(0), ranks, P.PATTERN).collect() == []


def test_fold_in_spark_equals_the_arrays(spark):
    with open(P.path("byte_bpe_multi_50k.tiktoken"), "rb") as file:
        own = bpe.ByteRanks(file.read(), P.PATTERN)
    words = [" the", " thethethe", "aaaa", " ñandú", "x", "", None, "ingening", "unrepresentativenesses", "😀‍👩", "qzxj" * 9, "の国", " Internationalisierungsmaßnahme"]
    made = bpe.fold_in_spark(spark.createDataFrame([(w,) for w in words], "word string"), own)
    rows = {r.word: (r.ids, bytes(r.raw)) for r in made.withColumn("raw", bpe.decode_in_spark(F.col("ids"), own.tokens)).collect()}
    for w in words:
        ids = own.fold([w])[0].tolist() if w else []
        assert rows[w] == (ids, (w or "").encode())


def test_quantised_links(spark):
    rng = np.random.default_rng(4)
    base = rng.standard_normal((40, 12))
    x = np.concatenate([base, base[:25] + 0.08 * rng.standard_normal((25, 12)), base[:8], 3 * base[8:10]])
    rows = [(i, v.tolist()) for i, v in enumerate(x)]
    bad = [(200, None), (201, []), (202, [0.0] * 12), (203, [float("nan")] + [1.0] * 11), (204, [None] + [1.0] * 11), (None, base[0].tolist())]
    df = spark.createDataFrame(rows + bad, "vec_id long, embedding array<double>").withColumn("id", F.lit(1)).withColumn("copies", F.lit(1))
    u = x / np.linalg.norm(x, axis=1, keepdims=True)
    near = (u @ u.T >= 0.95) & ~np.eye(len(x), dtype=bool)
    root = spanning(len(x), *np.nonzero(near))
    wanted = {i: (int(near[i].sum()), int(root[i]), bool(root[i] == i)) for i in range(len(x))} | {k: (0, k, True) for k in range(200, 205)} | {None: (0, None, False)}
    made = {r.vec_id: (r.n_links, r.component_id, r.kept) for r in quantise.near_duplicates(df).collect()}
    assert made == wanted
    assert {r.kept for r in quantise.near_duplicates(df.where("vec_id BETWEEN 200 AND 202")).collect()} == {True}
    assert quantise.near_duplicates(df.limit(0)).collect() == []


@pytest.mark.parametrize("width", [64, 160])
def test_quantised_links_of_low_rank(spark, width):
    rng = np.random.default_rng(14)
    base = rng.standard_normal((1600, 4))
    x = np.concatenate([base, base[:500] + 0.15 * rng.standard_normal((500, 4)), base[:40]]) @ rng.standard_normal((4, width))
    u = x / np.linalg.norm(x, axis=1, keepdims=True)
    near = (u @ u.T >= 0.99) & ~np.eye(len(x), dtype=bool)
    root = spanning(len(x), *np.nonzero(near))
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id long, embedding array<double>")
    made = {r.vec_id: (r.n_links, r.component_id) for r in quantise.near_duplicates(df, cosine=0.99).collect()}
    assert made == {i: (int(near[i].sum()), int(root[i])) for i in range(len(x))}


def test_voronoi_join(spark):
    rng = np.random.default_rng(6)
    x = np.concatenate([np.floor(256 * rng.uniform(-1, 1, (300, 5))), np.zeros((4, 5))])
    x[50:60] = x[40]
    rows = [(i, v.tolist()) for i, v in enumerate(x)] + [(900, None), (950, [float("inf")] * 5), (None, [1.0] * 5)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>").withColumn("g", F.lit(1))
    made = sorted(map(tuple, voronoi.top_k(df, F.col("vec_id") % 50 == 0).collect()))
    scores = (x @ x.T).astype(int)
    wanted = []
    for q in range(0, len(x), 50):
        best = sorted((-scores[q, j], j) for j in range(len(x)) if j != q)[:5]
        wanted += [(q, n + 1, j, -s) for n, (s, j) in enumerate(best)]
    assert made == sorted(wanted)
    assert len(voronoi.top_k(df.where("vec_id <= 2"), F.col("vec_id") == 0).collect()) == 2
    assert voronoi.top_k(df.limit(0), F.lit(True)).collect() == []


def test_voronoi_query_leaves_out_invalid_vectors(spark, tmp_path):
    rng = np.random.default_rng(16)
    x = rng.uniform(-1, 1, (120, 4))
    odd = [float("nan"), float("inf"), float("-inf"), None]
    bad = {3 + 50 * n: [v, 0.5, 0.5, 0.5] for n, v in enumerate(odd)} | {200 + 50 * n: [0.5, v, 0.5, 0.5] for n, v in enumerate(odd)}
    rows = [(i, v.tolist()) for i, v in enumerate(x) if i not in bad] + list(bad.items())
    spark.createDataFrame(rows, "vec_id long, embedding array<float>").write.parquet(f"{tmp_path}/embeddings.parquet")
    made = sorted(map(tuple, queries.op8_voronoi(spark, str(tmp_path)).collect()))
    whole = np.floor(256 * x.astype(np.float32).astype(float))
    scores = (whole @ whole.T).astype(int)
    wanted = []
    for q in range(0, len(x), 50):
        best = sorted((-scores[q, j], j) for j in range(len(x)) if j != q and j not in bad)[:5]
        wanted += [(q, n + 1, j, -s) for n, (s, j) in enumerate(best)]
    assert made == wanted


def test_warc(spark):
    long = "<p>" + "x" * 200 + "\r\n\r\nWARC/1.1\r\n\r\n" + "é" * 50
    rows = [(3, "http://a/\r\nb", long), (1, None, "tiny"), (2, "u", "tiny"), (5, "u", long), (9, "u", None), (8, "u", ""), (4, "u", long), (4, "u", long), (7, "u", long + "!"), (None, "u", long)]
    df = spark.createDataFrame(rows, "page_id long, url string, html string").withColumn("key", F.lit(1)).withColumn("digest", F.lit(2))
    made = sorted((r.page_id is None, r.page_id or 0, r.payload_bytes, r.payload_digest, r.record_type, r.refers_to) for r in warc.round_trip(df).collect())
    wanted = []
    for k, _, t in rows:
        raw = (t or "").encode()
        again = t == long and k != 3
        wanted.append((k is None, k or 0, len(raw), hashlib.sha256(raw).hexdigest(), "revisit" if again else "response", 3 if again else None))
    assert made == sorted(wanted, key=str) or made == sorted(wanted, key=lambda x: x[:2])
    headers, payloads = warc.store(df)
    assert payloads.count() == 4 and headers.count() == len(rows)
    assert warc.round_trip(df.limit(0)).collect() == []



def test_deobfuscation():
    words = {w: 5.0 for w in ("idiot", "stupid", "moron")}
    plain = toxicity.word_counts({w: 1.0 for w in ("the", "that", "on", "and", "then", "hello", "world")}, 2000.0)
    model = toxicity.CharModel(plain, toxicity.word_counts(words, 2000.0))
    for token, meant in (("1d10t", "idiot"), ("st*pid", "stupid"), ("m0r0n", "moron"), ("i.d.i.o.t", "idiot"), ("stuuuupid", "stupid")):
        assert toxicity.best(token, token, model) == meant
    assert toxicity.restored_text("an i d i o t here", model).split()[-1] == "idiot"
    assert toxicity.restored_text("hello the world", model) == "hello the world"
    assert toxicity.restored_text(None, model) == ""


def test_toxicity(spark, docs):
    rng = random.Random(9)
    word = lambda: "".join(rng.choice("etaoinsh") for _ in range(rng.randint(2, 6)))
    texts = []
    for i in range(400):
        body = [word() for _ in range(30)]
        if i % 4 == 0:
            body[3], body[11] = rng.choice(("cretin", "dimwit")), rng.choice(("cretin", "dimwit"))
        texts.append(" ".join(body))
    texts += ["some d1mw1t and cr3t1n here", "c r e t i n and d.i.m.w.i.t", "plain words only"]
    rows = frame(spark, texts)
    labels = spark.createDataFrame([(i, int(i % 4 == 0)) for i in range(300)], "doc_id long, toxic int")
    model = toxicity.train(rows, labels)
    made = {r.doc_id: r.score for r in toxicity.score(rows, model).collect()}
    assert sum((made[i] > 0.5) == (i % 4 == 0) for i in range(400)) >= 396
    assert made[400] > 0.5 and made[401] > 0.5 and made[402] < 0.5
    assert toxicity.score(docs, model).count() == docs.count()
    assert toxicity.keep_clean(docs, model, 2.0).count() == docs.count()
    assert {round(r.score, 6) for r in toxicity.score(docs, toxicity.train(docs, labels.limit(0))).collect()} == {0.5}
    assert toxicity.score(docs.limit(0), model).collect() == []


@pytest.mark.parametrize(("clean", "odd", "toxic", "strong", "weak"), [(1000, 3, 30, 5.1, 3.6), (300, 1400, 30, 4.5, 2.0), (1000, 1400, 150, 4.5, 4.0), (11000, 1400, 1500, 5.6, 3.6)])
def test_toxicity_weights_where_evidence_divides_labels(clean, odd, toxic, strong, weak):
    """Whole Newton steps ran away on the first three of these, to a base under -30,000, and every text scored 0."""
    row = lambda first, second, n: [first, second, max(first - 3, 0), max(second - 3, 0), math.log1p(n)]
    x = np.array([row(0, 0, 0)] * clean + [row(weak, 0, 1)] * odd + [row(strong, strong, 2)] * toxic)
    y = np.repeat([0.0, 1.0], [clean + odd, toxic])
    weights, base = toxicity.logistic(x, y)
    p = 1 / (1 + np.exp(-(x @ weights + base)))
    assert p[y == 1].min() > 0.7 and p[y == 0].max() < 0.3 and (weights >= 0).all()
    # The least loss: no slope but at weights of zero, where it may rise.
    slope = x.T @ (p - y) + 0.1 * weights
    assert abs((p - y).sum()) < 1e-3 and (abs(slope[weights > 0]) < 1e-3).all() and (slope[weights == 0] > -1e-3).all()


def test_simhash(spark, docs):
    rng = random.Random(12)
    word = lambda: "".join(rng.choice("abcdefgh") for _ in range(5))
    body = [word() for _ in range(300)]
    near = [" ".join(body[:i] + [word()] + body[i + 1 :]) for i in range(0, 300, 7)]
    texts = [" ".join(body), *near, " ".join(body), *[" ".join(word() for _ in range(40)) for _ in range(20)], None, "", "one", "one two", "ONE two"]
    rows = frame(spark, texts)
    prints = [int.from_bytes(simhash.fingerprint(t), "big") for t in texts]
    import xxhash

    words = texts[0].split()
    hashes = [xxhash.xxh64_intdigest(" ".join(words[i : i + 3]).encode(), 42) for i in range(len(words) - 2)]
    assert prints[0] == sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))
    a, b = np.nonzero([[(x ^ y).bit_count() <= 3 for y in prints] for x in prints])
    root = spanning(len(prints), a, b)
    made = {r.doc_id: (int(r.fingerprint, 16), r.component_id) for r in simhash.near_duplicates(rows).collect()}
    assert made == {i: (prints[i], int(root[i])) for i in range(len(texts))}
    kept = {r.doc_id for r in simhash.keep_one(rows.union(rows.where("doc_id < 3"))).collect()}
    assert kept == set(root.tolist())
    nodes = spark.createDataFrame([(int(np.array(x, np.uint64).astype(np.int64)),) for x in set(prints)], "fp long")
    whole = components(simhash.fingerprint_links(nodes)).count()
    assert components(simhash.fingerprint_links(nodes, chunk=4)).count() == whole
    assert simhash.near_duplicates(docs).count() == docs.count()
    assert simhash.near_duplicates(docs.limit(0)).collect() == []


def test_crc_remainders(spark):
    from platen.llm.common import remainder

    rows = spark.createDataFrame([(0,), (17,), (123456,)], "doc_id long").select("doc_id", remainder("doc_id", 5).alias("m")).collect()
    assert all(r.m == zlib.crc32(str(r.doc_id).encode()) % 5 for r in rows)


def test_warc_streams_blocks_with_separators(spark, tmp_path):
    end = "\r\n\r\n"
    rows = [(1, "u", end + "a" * 120 + end), (2, "u", end), (3, "u", "x" + end + end + "y" * 200), (4, "u", ""), (5, "u", "\r\n"), (6, "u", "b" * 150 + "\r\n")]
    df = spark.createDataFrame(rows, "page_id long, url string, html string").coalesce(1)
    made = warc.records(*warc.store(df))
    for kind in ("gzip", "none"):
        warc.export(made, f"{tmp_path}/{kind}", kind, most=2)
        back = {r.key: (bytes(r.block).decode(), r.size) for r in warc.read_records(spark, f"{tmp_path}/{kind}").collect()}
        assert back == {k: (t, len(t)) for k, _, t in rows}
    assert len(list(tmp_path.glob("gzip/*.gz"))) >= 3
    with pytest.raises(ValueError, match="Content-Length"):
        list(warc._parse(iter([b"WARC/1.1\r\nWARC-Record-ID: <urn:x-page:1>\r\nContent-Length: 3", b"abcd"])))
    with pytest.raises(ValueError, match="digest"):
        list(warc._parse(iter([b"WARC/1.1\r\nWARC-Type: response\r\nWARC-Record-ID: <urn:x-page:1>\r\nWARC-Payload-Digest: sha256:00\r\nContent-Length: 3", b"abc"])))


def test_voronoi_of_huge_components(spark):
    rows = [(0, [2.0**52, 3.0]), (1, [2.0**10, 1.0]), (2, [2.0**10, 0.0]), (3, [-(2.0**8), 5.0]), (50, [1.0, 1.0])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    made = {(r.query_id, r.vec_id): r.score for r in voronoi.top_k(df, F.col("vec_id") % 50 == 0).collect()}
    whole = {k: [int(v) for v in x] for k, x in rows}
    assert made == {(q, k): sum(a * b for a, b in zip(whole[q], whole[k], strict=True)) for q in (0, 50) for k in whole if k != q}
    high = spark.createDataFrame([(0, [2.0**40]), (1, [2.0**30])], "vec_id long, embedding array<double>")
    with pytest.raises(Exception, match="64 bits"):
        voronoi.top_k(high, F.col("vec_id") == 0).collect()


def test_lines_with_clashing_names(spark):
    rows = spark.createDataFrame([(0, "a\nb\nc", "x", 1), (1, "z\na\nb\nc", "y", 2)], "doc_id long, text string, removed string, later int")
    made = lines.dedup_lines(rows).orderBy("doc_id").collect()
    assert [(r.text, r.later, r.removed) for r in made] == [("a\nb\nc", 1, []), ("z", 2, [1, 2, 3])]
    kept = lines.dedup_lines(rows, removed="gone").orderBy("doc_id").collect()
    assert [(r.removed, r.gone) for r in kept] == [("x", []), ("y", [1, 2, 3])]


def test_viterbi_takes_the_best_of_all_paths():
    model = toxicity.CharModel(toxicity.word_counts({w: 1.0 for w in ("that", "idiot", "stupid", "tail", "gist")}, 500.0))
    for token in ("1d10t", "st*p", "t@@1l", "g!!5t", "(a+", "7h-a+", "aaa", "x", "0", ".a.", "%%%"):
        steps = toxicity.lattice(token)
        paths = [("", 0.0)]
        for arcs in steps:
            paths = [(word + letters, cost + own) for word, cost in paths for letters, own in arcs]
        best = max(cost + model.word(word) for word, cost in paths)
        made = toxicity.restore(token, model)
        assert math.isclose(max(cost for word, cost in paths if word == made) + model.word(made), best, abs_tol=1e-9)


def test_character_model_forgets(monkeypatch):
    model = toxicity.CharModel(toxicity.word_counts({"idiot": 1.0}, 10.0))
    wanted = {w: model.word(w) for w in ("idiot", "toad", "diode")}
    monkeypatch.setattr(toxicity, "REMEMBERED", 3)
    model.logs.clear()
    assert {w: model.word(w) for w in wanted} == wanted and len(model.logs) <= 3


def test_disguises_without_letters_or_with_signs_between():
    words = {w: 5.0 for w in ("kill", "bitch")}
    model = toxicity.CharModel(toxicity.word_counts({"the": 1.0, "bill": 1.0}, 100.0), toxicity.word_counts(words, 2000.0))
    assert "kill" in toxicity.restored_text("k . i . l . l", model).split()
    assert toxicity.restored_text("it cost $100 or 5% of 3,000", model).split() == ["it", "cost", "100", "or", "5", "of", "3,000"]
    assert toxicity.restored_text("a - b", model).split() == ["a", "b"] or toxicity.restored_text("a - b", model).split() == ["a", "", "b"]


def test_score_is_the_sum_of_table_entries():
    rng = np.random.default_rng(31)
    x = np.column_stack([rng.random(500), rng.integers(0, 3, 500), rng.standard_normal(500)])
    y = ((x[:, 0] > 0.4) & (x[:, 1] > 0) | (x[:, 2] > 1)).astype(float)
    model = boosting.fit(x, y, rounds=20, pairs=2)
    for row, score in zip(x[:60], model.score(x[:60]), strict=True):
        bins = [sum(c <= v for c in cuts) for v, cuts in zip(row, model.cuts, strict=True)]
        total = model.base + sum(t[b] for t, b in zip(model.tables, bins, strict=True))
        total += sum(t[model.coarse[i][bins[i]], model.coarse[j][bins[j]]] for i, j, t in model.pairs)
        assert math.isclose(score, 1 / (1 + math.exp(-total)), rel_tol=1e-12)


def test_a_tree_takes_the_best_cut():
    rng = np.random.default_rng(37)
    for _ in range(30):
        g, h, n = rng.standard_normal(9), rng.random(9) + 0.1, rng.integers(0, 9, 9)
        gain, at = boosting._cut(g, h, n, 1.0, 5)
        worth = {k: g[:k].sum() ** 2 / (h[:k].sum() + 1) + g[k:].sum() ** 2 / (h[k:].sum() + 1) - g.sum() ** 2 / (h.sum() + 1) for k in range(1, 9) if n[:k].sum() >= 5 and n[k:].sum() >= 5}
        if worth and max(worth.values()) > 1e-9:
            assert math.isclose(gain, max(worth.values()), rel_tol=1e-9) and math.isclose(worth[at], gain, rel_tol=1e-9)


def test_hmm_score_is_the_models_probability(spark):
    """score against a sum over all state paths of the model that was trained, words by their share of their class."""
    texts = ["a b a", "b c", "", "c a longest", "b", "unseen a"]
    docs = frame(spark, texts)
    held = {4, 5}
    kept = {}
    train = hmm.baum_welch

    def spied(*args):
        kept["model"] = train(*args)
        return kept["model"]

    hmm.baum_welch = spied
    try:
        made = {r.doc_id: r.score for r in hmm.scores(docs, ~F.col("doc_id").isin(*held), states=2, iterations=2).collect()}
    finally:
        hmm.baum_welch = train
    model = kept["model"]
    counts = Counter(w for i, t in enumerate(texts) if i not in held for w in t.encode().split())
    tokens, kinds = Counter(), Counter()
    for w, n in counts.items():
        tokens[hmm.word_class(w)] += n
        kinds[hmm.word_class(w)] += 1
    for i, t in enumerate(texts):
        words = t.encode().split()
        symbols = [hmm.word_class(w) for w in words] + [hmm.CLASSES]
        total = 0.0
        for path in np.ndindex(*[2] * len(symbols)):
            p = model.start[path[0]]
            for k, c in enumerate(symbols):
                p *= model.emit[c, path[k]] * (model.step[path[k - 1], path[k]] if k else 1)
            total += p
        own = sum(math.log10((counts[w] + 0.5) / (tokens[hmm.word_class(w)] + 0.5 * (kinds[hmm.word_class(w)] + 1))) for w in words)
        assert math.isclose(made[i], math.log10(total) + own, rel_tol=1e-6)


CONTRACTS = {
    "op1_hmm": "doc_id bigint, held_out boolean, n_tokens bigint, n_known bigint, train_tokens bigint, base_score double, score double",
    "op3_packing": "doc_id bigint, start bigint, length bigint, ids_crc32 bigint, doc_tokens bigint, sequence_id bigint, offset bigint",
    "op4_quality": "doc_id bigint, held_out boolean, score double, predicted int",
    "op5_bpe": "doc_id bigint, n_tokens bigint, ids_sha256 string, decoded_sha256 string",
    "op6_quantised": "vec_id bigint, n_links bigint, component_id bigint, kept boolean",
    "op7_warc": "page_id bigint, payload_bytes bigint, payload_digest string, record_type string, refers_to bigint",
    "op8_voronoi": "query_id bigint, rank int, vec_id bigint, score bigint",
    "op9_toxicity": "doc_id bigint, held_out boolean, score double, predicted int",
    "op10_simhash": "doc_id bigint, fingerprint string, component_id bigint",
}


@pytest.fixture(scope="module")
def tables(spark, tmp_path_factory):
    """Odd rows in each table: nulls, empty texts, repeats, clashing columns."""
    at = tmp_path_factory.mktemp("sf")
    rng = random.Random(41)
    word = lambda: "".join(rng.choice("etaoin") for _ in range(4))
    texts = [*TEXTS, *[" ".join(word() for _ in range(40)) for _ in range(40)]]
    docs = frame(spark, texts)
    docs = docs.union(docs.where("doc_id = 3")).withColumn("score", F.lit("s")).withColumn("train", F.lit(1)).withColumn("removed", F.lit("r"))
    docs.write.parquet(f"{at}/documents.parquet")
    spark.createDataFrame([(i, i % 2, int(i % 7 == 0)) for i in range(4, 40)] + [(None, 1, 1), (5, None, None)], "doc_id long, quality int, toxic int").write.parquet(f"{at}/labels.parquet")
    spark.createDataFrame([(i, f"u{i}", t) for i, t in enumerate(texts)], "page_id long, url string, html string").write.parquet(f"{at}/pages.parquet")
    spark.createDataFrame([(i, [float(rng.gauss(0, 1)) for _ in range(6)]) for i in range(60)] + [(60, None)], "vec_id long, embedding array<float>").write.parquet(f"{at}/embeddings.parquet")
    return str(at), texts


@pytest.mark.parametrize("name", sorted(CONTRACTS))
def test_query_keeps_its_contract(spark, tables, name):
    at, texts = tables
    made = queries.queries()[name](spark, at)
    wanted = CONTRACTS[name].split(", ")
    assert [f"{a} {b}" for a, b in made.dtypes][: len(wanted)] == wanted
    rows = made.collect()
    if "held_out" in made.columns:
        mod, left = {"op1_hmm": (5, 1), "op4_quality": (4, 2), "op9_toxicity": (3, 1)}[name]
        assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % mod == left) for r in rows)
        assert len(rows) == len(texts) + 1
    if "predicted" in made.columns:
        assert all(0 <= r.score <= 1 and r.predicted == int(r.score >= 0.7) for r in rows)
    if name == "op5_bpe":
        for r in rows:
            raw = (texts[r.doc_id] or "").encode()
            assert r.decoded_sha256 == hashlib.sha256(raw).hexdigest()
    if name == "op3_packing":
        library = pytest.importorskip("tokenizers").Tokenizer.from_file(P.path("word_bpe_49k.json"))
        for r in rows:
            ids = library.encode(texts[r.doc_id] or "", add_special_tokens=False).ids + [2]
            assert r.ids_crc32 == zlib.crc32(np.array(ids[r.start : r.start + r.length], "<u4").tobytes()) and r.doc_tokens == len(ids)
