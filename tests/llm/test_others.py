"""URL filters, neighbours, media and the pipeline."""

import re

import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from gridlume.llm import ann, media, queries, urls

SMALL = "/root/testdata/sf0.001"
URLS = [
    None,
    "",
    "no-scheme.com/x",
    "http://A.Example.COM/en/x",
    "https://www.example.com/en/",
    "https://www.example.com/EN/",
    "http://example.com",
    "http://example.com/",
    "http://notexample.com/en/",
    "http://x.net/es/a?b=/fr/#c",
    "http://x.net?/es/",
    "http://net/fr/",
    "http://a.b://c.com/",
    "http://www.casino-win.example.org/de/1",
    "http://my-casino-win.example.org/de/1",
    "http://h.org/wiki/ads/",
    "http://h.org/ads/x",
    "http://h.org/ads/x",
    "http://h.org/p/login",
    "http://h.org/p/loginx",
    "http://h.org/line\n/cart?x",
    "http://user@casino-x.org/",
    "http://h.org/?utm_source=spam",
]


def by_hand(url):
    host = path = ""
    if url and "://" in url:
        rest = url.split("://", 1)[1]
        host = re.match(r"[^/?#]*", rest)[0]
        path = re.match(r"[^?#]*", rest[len(host) :])[0]
        host = host.translate(str.maketrans(urls.UPPER, urls.LOWER))
    fits = [(len(r), r, a) for r, a in urls.HOST_RULES if (h := r.split("/")[0], p := r[len(r.split("/")[0]) :]) and (host == h or host.endswith("." + h)) and path.startswith(p)]
    rule = max(fits)[1:] if fits else (None, None)
    verdict = rule[1]
    if verdict is None:
        lower = (url or "").lower()
        hits = set()
        for pattern, action in urls.PATTERNS:
            body = pattern.removeprefix("||")
            regex = "".join({"*": ".*", "^": r"(?:[^a-z0-9_.%-]|\Z)"}.get(c, re.escape(c)) for c in body)
            if re.search((r"://(?:[^/?#]*[.@])?" if body != pattern else "") + regex, lower, re.S) and "://" in lower:
                hits.add(action)
        verdict = "block" if hits == {"block"} else "allow"
    return url, host, path, rule[0], verdict


@pytest.mark.parametrize("held", [10_000, 0])
def test_urls(spark, monkeypatch, held):
    monkeypatch.setattr(urls, "MAX_HELD_RULES", held)
    rows = spark.createDataFrame([(k if k % 7 else None, u, 1, "r", "h") for k, u in enumerate(URLS)], "page_id long, url string, rank int, rule string, host string")
    found = urls.judge(rows).collect()
    key = lambda r: tuple((v is None, v) for v in r)
    assert sorted(((r.page_id, r.url, r.host, r.path, r.rule, r.verdict) for r in found), key=key) == sorted(((k if k % 7 else None, *by_hand(u)) for k, u in enumerate(URLS)), key=key)
    assert urls.judge(rows.limit(0)).count() == 0
    assert {r.verdict for r in urls.judge(rows, (), ()).collect()} == {"allow"}
    bare = urls.judge(rows, (), (("*zz*", "block"), ("/p/l*n", "block")))
    assert bare.count() == len(URLS) and {r.url for r in bare.where("verdict = 'block'").collect()} == {"http://h.org/p/login", "http://h.org/p/loginx"}


def test_urls_are_judged_where_they_are(spark):
    rows = spark.createDataFrame([(k, f"http://h{k}.example.com/{k}/x{k % 50}y/page?q=r{k % 97}z") for k in range(2000)], "page_id long, url string")
    rules = tuple((f"/x{k}y/", "block") for k in range(0, 3000, 7)) + (("r5z^", "allow"),)
    plan = urls.judge(rows, (("example.com/3", "allow"),), rules)
    assert "Exchange" not in plan._jdf.queryExecution().executedPlan().toString()
    expected = {k: "allow" if str(k).startswith("3") or k % 97 == 5 or (k % 50) % 7 else "block" for k in range(2000)}
    assert {r.page_id: r.verdict for r in plan.collect()} == expected


def test_rules_are_indexed_by_whole_tokens_only():
    assert urls.pattern_rule("/ads*", "block").tokens == ()
    assert urls.pattern_rule("||casino-", "block").tokens == ("casino",)
    assert urls.host_rule("example.com/en", "block").tokens == ("example", "com")


def nearest_by_hand(ids, vectors, queries_, k):
    norms = np.linalg.norm(vectors, axis=1)
    out = {}
    for q in queries_:
        i = ids.index(q)
        scores = vectors @ vectors[i] / (norms * norms[i])
        order = sorted((j for j in range(len(ids)) if ids[j] != q), key=lambda j: (-round(scores[j], 12), ids[j]))[:k]
        out[q] = [(ids[j], scores[j]) for j in order]
    return out


@pytest.mark.parametrize("kind", ["normal", "clusters", "copies"])
def test_neighbours(spark, kind):
    r = np.random.default_rng(8)
    x = r.normal(size=(1500, 24))
    if kind == "clusters":
        x = r.normal(size=(12, 24))[r.integers(0, 12, 1500)] * 3 + x
    if kind == "copies":
        x[:600] = x[0]
    x = x.astype(np.float32)
    rows = spark.createDataFrame([(int(k), [float(v) for v in row]) for k, row in enumerate(x)], "vec_id long, embedding array<float>").withColumn("score", F.lit("clash"))
    found = ann.search(rows, F.col("vec_id") % 50 == 0).toPandas()
    truth = nearest_by_hand(list(range(1500)), x.astype(float), range(0, 1500, 50), 5)
    assert len(found) == 150 and sorted(found["rank"].unique()) == [1, 2, 3, 4, 5]
    hits = 0
    for q, part in found.groupby("query_id"):
        part = part.sort_values("rank")
        hits += len(set(part.vec_id) & {v for v, _ in truth[q]})
        norm = np.linalg.norm(x.astype(float), axis=1)
        for v, s in zip(part.vec_id, part.score):
            assert s == pytest.approx(float(x[v].astype(float) @ x[q].astype(float) / norm[v] / norm[q]), abs=1e-12)
        assert list(part.score) == sorted(part.score, reverse=True)
    assert hits >= 0.9 * 150
    if kind == "copies":
        assert list(found[found.query_id == 0].sort_values("rank").vec_id) == [1, 2, 3, 4, 5]


def test_neighbours_of_odd_vectors(spark):
    nan, inf = float("nan"), float("inf")
    rows = [(0, [1.0, 0.0]), (1, [1.0, 0.1]), (2, None), (3, [0.0, 0.0]), (4, [nan, 1.0]), (5, [inf, 1.0]), (6, [None, 1.0]), (7, [1.0]), (None, [1.0, 0.0]), (1, [1.0, 0.1]), (8, [-1.0, 0.0])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    found = ann.search(df, F.col("vec_id").isin(0, 3, 50)).orderBy("rank").collect()
    assert [(r.query_id, r["rank"], r.vec_id) for r in found] == [(0, 1, 1), (0, 2, 8)]
    assert ann.search(df.limit(0), F.lit(True)).count() == 0
    assert ann.search(df.where("vec_id = 0"), F.lit(True)).count() == 0


def test_early_abandoning_keeps_the_nearest(monkeypatch):
    r = np.random.default_rng(0)
    x, ids = ann._units(r.normal(size=(3000, 64))), np.arange(3000)
    blocks = [np.ascontiguousarray(b) for b in np.split(x, range(16, 64, 16), axis=1)]
    asked = ann._units(r.normal(size=(40, 64)))
    whole = ((x[None] - asked[:, None]) ** 2).sum(2)
    truth = np.argsort(whole, axis=1)[:, :5]
    monkeypatch.setattr(ann, "DENSE", 1.0)  # every pair by itself
    for limits in (np.full(40, np.inf), np.sort(whole, axis=1)[:, 4]):
        q, row, read = ann.scan(asked, blocks, limits, 5, np.full(40, -1), ids)
        hits = sum(len(set(row[q == k]) & set(truth[k])) for k in range(40))
        assert hits >= 0.97 * 200 and np.bincount(q).max() <= 5 and read < 40 * 3000 * 64
    q, row, _ = ann.scan(x[:4], blocks, np.full(4, np.inf), 5, ids[:4], ids)
    assert not (q == row).any()


def test_lists_with_finer_parts(spark, monkeypatch):
    r = np.random.default_rng(5)
    x = r.normal(size=(4000, 16)).astype(np.float32)
    monkeypatch.setattr(ann, "MAX_CENTROIDS", 12)
    monkeypatch.setattr(ann, "SEGMENT", 40)
    monkeypatch.setattr(ann, "TURN", 30)
    index = ann.fit_index(x[:2000].astype(float), 4000, 5)
    assert len(index.fine) == 6 and index.cells == 72 and index.probes < 72
    rows = spark.createDataFrame([(int(k), [float(v) for v in row]) for k, row in enumerate(x)], "vec_id long, embedding array<float>")
    found = ann.search(rows, F.col("vec_id") % 50 == 0).collect()
    truth = nearest_by_hand(list(range(4000)), x.astype(float), range(0, 4000, 50), 5)
    assert len(found) == 400 and sum(f.vec_id in {v for v, _ in truth[f.query_id]} for f in found) >= 0.9 * 400


def test_copies_are_needed_only_up_to_k():
    x = np.array([[1.0, 0.0]] * 9 + [[0.0, 1.0]])
    ids = ann.pa.array([9, 3, 3, 8, 1, 7, 2, 6, 5, 4])
    assert sorted(ids.to_pylist()[i] for i in ann._needed(x, ids, 3)) == [1, 2, 3, 4, 5]


def picture(seed, side=80):
    r = np.random.default_rng(seed)
    out = np.zeros((side, side))
    for _ in range(60):
        y, x, h, w = r.integers(0, side - 8), r.integers(0, side - 8), r.integers(4, 20), r.integers(4, 20)
        out[y : y + h, x : x + w] += r.normal()
    return out


def test_media(spark):
    rows = []
    add = lambda k, image: rows.append((k, image.shape[1], [float(v) for v in image.ravel()]))
    for s in range(4):
        image = picture(s)
        add(10 * s, image)
        add(10 * s + 1, image[6:, 8:])
        add(10 * s + 2, np.rot90(image) * 0.5 + 0.2)
    rows += [(90, 4, [1.0] * 16), (91, 10, None), (92, 7, [1.0] * 20), (93, 0, []), (94, 30, [0.5] * 900), (None, 30, [0.5] * 900), (0, *rows[0][1:])]
    df = spark.createDataFrame(rows, "image_id long, width int, pixels array<float>").withColumn("n_features", F.lit(-1))
    found = {r.image_id: r for r in media.find_copies(df).collect()}
    assert len(found) == 17
    assert all(found[10 * s + v].class_id == 10 * s for s in range(4) for v in range(3))
    assert all(found[k].class_id == k and found[k].n_features == 0 for k in range(90, 95))
    assert media.find_copies(df.limit(0)).count() == 0


def test_media_of_many_copies(spark):
    image = picture(1, 64)
    rows = [(k, 64, [float(v) for v in (image * (1 + k / 100)).ravel()]) for k in range(45)]
    found = media.find_copies(spark.createDataFrame(rows, "image_id long, width int, pixels array<float>"))
    assert {r.class_id for r in found.collect()} == {0}


def test_media_query_finds_the_crops(spark):
    found = {r.image_id: r for r in queries.op10_media_copies(spark, SMALL).collect()}
    whole = [k for k in found if k >= 0 and found[k].n_features and found[-1 - k].n_features]
    assert whole and all(found[k].class_id == found[-1 - k].class_id for k in whole)


def test_pipeline(spark, tmp_path):
    docs = spark.read.parquet(f"{SMALL}/documents.parquet")
    counts, columns = [docs.count()], docs.columns
    for name, stage in corpus_pipeline.STAGES:
        stage(spark, docs, SMALL).write.parquet(str(tmp_path / name))
        docs = spark.read.parquet(str(tmp_path / name))
        counts.append(docs.count())
        if name == "n-gram Jaccard join":
            ids = [r.doc_id for r in docs.collect()]
            assert len(ids) == len(set(ids))
        if name != corpus_pipeline.STAGES[-1][0]:
            assert docs.columns == columns
    assert counts[0] >= counts[1] >= counts[2] == counts[3] and counts[5] == counts[4] > 0
    assert {"doc_id", "n_tokens", "ids", "decoded_sha256"} == set(docs.columns)
    assert corpus_pipeline.run(spark, SMALL).count() == counts[5]


def test_empty_pipeline_stages(spark):
    empty = spark.read.parquet(f"{SMALL}/documents.parquet").limit(0)
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, empty, SMALL).count() == 0


def test_stages_take_nulls_repeats_and_long_texts(spark):
    ddl = "doc_id long, text string, lang string, source string, n_chars long, copies int, spans string"
    rows = [(1, "a b c d e f", "en", "s", 1), (1, "a b c d e f", "en", "s", 1), (2, None, None, None, None), (None, "x y", None, "s", 2), (None, None, None, None, None), (3, "", "en", None, 0), (4, "long " * 40_000, "en", "s", 5), (5, "token = abcdefgh12", "en", "t", 6)]
    docs = spark.createDataFrame([(*r, 9, "clash") for r in rows], ddl)
    kept = {name: stage(spark, docs, SMALL) for name, stage in corpus_pipeline.STAGES}
    counts = {name: df.count() for name, df in kept.items()}
    assert counts["toxicity"] == counts["secret scans"] == counts["byte-level BPE encoding and decoding"] == len(rows)
    assert counts["n-gram Jaccard join"] == len(rows) - 1
    assert {r.text for r in kept["secret scans"].where("doc_id = 5").collect()} == {"[REDACTED]"}
    mixed = kept["mixing sources to target weights"]
    assert mixed.columns == list(corpus_pipeline.COLUMNS) and mixed.groupBy("doc_id", "text").count().where("count > 4").count() == 0
