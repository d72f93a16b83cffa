import base64
import hashlib
import math
import random
import re
from collections import Counter

import numpy as np
import public_tokenizers
import pyarrow as pa
import tiktoken

import corpus_pipeline
from gridlume.llm import media, secrets
from gridlume.llm.textbatch import slices


def test_secrets_of_bare_keys_in_a_row():
    r = random.Random(1)
    keys = ["".join(r.choices("0123456789abcdef", k=32)) for _ in range(50)] + ["", *("".join(r.choices("abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789+/", k=44)) for _ in range(50)), "x" * 12, "y" * 12]
    rule = re.compile("|".join(f"(?:{a})" for a in secrets.ALLOWED))
    expected = {k for k, key in enumerate(keys) if secrets.spans_of(key, rule)}
    found = {row + k for row, data, offsets in slices(pa.array(keys)) for k in secrets.suspects(data, offsets).tolist()}
    assert len(expected) == 100 and found == expected


def test_secrets_of_bare_keys_are_scanned(spark):
    keys = [f"{k:032x}"[::-1] for k in range(10**30, 10**30 + 20)]
    df = spark.createDataFrame(list(enumerate(keys)), "doc_id long, text string").coalesce(1)
    assert {r.doc_id for r in secrets.scan(df).where("size(spans) > 0").collect()} == set(range(20))
    assert {r.text for r in secrets.redact(df).collect()} == {"[REDACTED]"}


def test_media_of_families_in_one_bucket(spark, monkeypatch):
    """The features of two interleaved families share one bit table's bits and, within a family, hardly any other."""
    r = np.random.default_rng(3)
    rows, shared = [], r.integers(0, 2, media.TABLE_BITS)
    own = r.integers(0, 2, (2, 5, media.BITS))
    own[:, :, : media.TABLE_BITS] = shared
    for k in range(80):
        for f in range(5):
            bits = own[k % 2, f].copy()
            for t in range(1, media.TABLES):
                bits[t * media.TABLE_BITS + r.choice(media.TABLE_BITS, 2, replace=False)] ^= 1
            words = np.packbits(bits, bitorder="little").view("<i8").tolist()
            rows.append((k, 30.0 * f + 10, 20.0 * f + 10, 1.0, 0.0, *words))
    crafted = spark.createDataFrame(rows, "id long, x double, y double, scale double, angle double, d0 long, d1 long, d2 long, d3 long")
    monkeypatch.setattr(media, "features", lambda *_: crafted)
    found = media.find_copies(spark.range(80).withColumnRenamed("id", "image_id")).collect()
    assert all(r.class_id == r.image_id % 2 for r in found) and len(found) == 80


def classes_by_all_pairs(rows):
    """Every two images, every two of their features: the definition, without tables of buckets but for which features may meet."""
    parent = {r[0]: r[0] for r in rows}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    described = {k: media.describe(np.array(pixels, np.float32).astype(float).reshape(-1, width)) for k, width, pixels in rows}
    unpacked = {k: np.unpackbits(np.ascontiguousarray(d[4]).view(np.uint8).reshape(-1, 32), axis=1, bitorder="little") for k, d in described.items()}
    keys = {k: np.stack([u[:, t * media.TABLE_BITS : (t + 1) * media.TABLE_BITS] @ (1 << np.arange(media.TABLE_BITS)) for t in range(media.TABLES)], 1) for k, u in unpacked.items()}
    for a in described:
        for b in described:
            if a >= b or not len(described[a][0]) or not len(described[b][0]):
                continue
            far = (unpacked[a][:, None] != unpacked[b][None]).sum(2)
            meets = (keys[a][:, None] == keys[b][None]).any(2)
            cells = {}
            for i, j in zip(*np.nonzero((far <= media.MAX_DISTANCE) & meets)):
                (xa, ya, sa, ta), (xb, yb, sb, tb) = ([c[n] for c in d[:4]] for d, n in ((described[a], i), (described[b], j)))
                turn, ratio = math.floor((tb - ta) % 1 * media.ANGLES + 0.5) % media.ANGLES, sb / sa
                t = turn / media.ANGLES * 2 * math.pi
                dx, dy = xb - ratio * (xa * math.cos(t) - ya * math.sin(t)), yb - ratio * (xa * math.sin(t) + ya * math.cos(t))
                for p in (0, 1):
                    for q in (0, 1):
                        cells.setdefault((turn, ratio, p, q, math.floor(dx / media.PLACE + p / 2), math.floor(dy / media.PLACE + q / 2)), set()).add((xa, ya, sa))
            if any(len(c) >= media.CONSENSUS for c in cells.values()):
                parent[max(find(a), find(b))] = min(find(a), find(b))
    return {k: find(k) for k in described}


def _scene(seed, side=64):
    r = np.random.default_rng(seed)
    out = np.zeros((side, side))
    for _ in range(50):
        y, x, h, w = r.integers(0, side - 8), r.integers(0, side - 8), r.integers(4, 18), r.integers(4, 18)
        out[y : y + h, x : x + w] += r.normal()
    return out


def test_media_equals_all_pairs(spark, monkeypatch):
    """Crops, turns, edits and one pattern pasted into unlike scenes; buckets are large against the limits set here."""
    logo, rows, ids = _scene(99, 34), [], iter(range(1000))
    add = lambda image: rows.append((next(ids), image.shape[1], [float(v) for v in image.ravel()]))
    for s in range(6):
        scene = _scene(s)
        for variant in (scene, scene[4:, 6:], scene * 0.6 + 0.1, np.rot90(scene), scene + np.random.default_rng(s).normal(0, 0.03, scene.shape)):
            add(variant)
    for s in range(20, 32):
        scene = _scene(s)
        scene[15:49, 15:49] = logo
        add(scene)
    rows = [(k, w, np.array(v, np.float32).tolist()) for k, w, v in rows]
    expected = classes_by_all_pairs(rows)
    df = spark.createDataFrame(rows, "image_id long, width int, pixels array<float>")
    for hot, block in ((64, 32), (3, 4)):
        monkeypatch.setattr(media, "HOT", hot)
        monkeypatch.setattr(media, "BLOCK", block)
        assert {r.image_id: r.class_id for r in media.find_copies(df).collect()} == expected
    truth = {(5 * s + i, 5 * s + j) for s in range(6) for i in range(5) for j in range(i)}
    linked = {(a, b) for a in range(30) for b in range(a) if expected[a] == expected[b]}
    assert len(truth & linked) >= 0.9 * len(truth) and len(truth & linked) >= 0.9 * len(linked)


def test_media_of_exact_copies_meet_once(spark):
    r = np.random.default_rng(2)
    image = r.normal(size=(8, 8)).repeat(8, 0).repeat(8, 1)
    rows = [(k, 64, [float(v) for v in image.ravel()]) for k in range(300)] + [(300, 56, [float(v) for v in image[:, 8:].ravel()])]
    found = media.find_copies(spark.createDataFrame(rows, "image_id long, width int, pixels array<float>").repartition(8)).collect()
    assert len(found) == 301 and {r.class_id for r in found} == {0}


def test_one_row_of_each_group_stays(spark):
    near = " ".join(f"w{k}" for k in range(60))
    rows = [
        (1, "one two three four five six", "en", "s", 1),
        (1, "another text that shares only its id with the first", "en", "s", 1),
        (1, "another text that shares only its id with the first", "en", "s", 1),
        (None, near + " a", "en", "s", 1),
        (None, near + " b", "en", "s", 1),
        (None, near + " b", "en", "t", 1),
        (7, "alpha " + near + " z", "en", "s", 1),
        (None, "quite another text without any id at all", "en", "s", 1),
        (None, " ".join(f"v{k}" for k in range(60)) + " a", "en", "s", 1),
        (None, " ".join(f"v{k}" for k in range(60)) + " b", "en", "s", 1),
        (8, None, "en", "s", 1),
        (8, "", "en", "s", 1),
    ]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    kept = [sorted(map(tuple, corpus_pipeline.keep_one_of_each_group(spark, df, "").collect()), key=str) for df in (docs, docs.repartition(5).orderBy("text"))]
    assert kept[0] == kept[1]
    assert [r[1] for r in kept[0] if r[0] == 1] == ["another text that shares only its id with the first", "one two three four five six"]
    assert len([r for r in kept[0] if r[1] and "w5" in r[1]]) == 1 and any(r[0] == 7 for r in kept[0])
    assert len([r for r in kept[0] if r[1] and "v5" in r[1]]) == 1
    assert len(kept[0]) == 7


def test_pipeline_equals_its_steps_by_hand(spark, tmp_path):
    """Each stage's rows against plain Python over the same rows, in the order of the stages."""
    texts = [t for k in range(40) for t in (f"plain text number {k} about a river and its {k % 7} bridges and towns", f"you {'idiot' if k % 4 == 0 else 'friend'} number {k} of all that we have known")]
    texts += ["one of the copies of a text that two rows have", "one of the copies of a text that two rows have", "my password = hunter2222 is here", None, ""]
    rows = [(k, t, "en", "abc"[k % 3], len(t or "")) for k, t in enumerate(texts)]
    folder = str(tmp_path / "in")
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    docs.write.parquet(f"{folder}/documents.parquet")
    spark.createDataFrame([(k, int("idiot" in (t or ""))) for k, t in enumerate(texts[:80])], "doc_id long, toxic int").write.parquet(f"{folder}/labels.parquet")
    kept = [r for r in rows if "idiot" not in (r[1] or "")]
    stage = dict(corpus_pipeline.STAGES)
    found = spark.read.parquet(f"{folder}/documents.parquet")
    found = stage["toxicity"](spark, found, folder)
    assert sorted(r.doc_id for r in found.collect()) == [r[0] for r in kept]
    sets = {}
    for r in kept:
        words = (r[1] or "").split()
        sets[r[0]] = {tuple(words[k : k + 5]) for k in range(max(1, len(words) - 4))} if words else set()
    keep = [a for a in sets if not any(b < a and sets[a] and 5 * len(sets[a] & sets[b]) >= 4 * len(sets[a] | sets[b]) for b in sets)]
    found = stage["n-gram Jaccard join"](spark, found, folder)
    assert sorted(r.doc_id for r in found.collect()) == keep and len(keep) == len(kept) - 1
    found = stage["secret scans"](spark, found, folder)
    clean = {k: t if t is None or "password" not in t else "my [REDACTED] is here" for k, t, *_ in rows}
    assert {r.doc_id: r.text for r in found.collect()} == {k: clean[k] for k in keep}
    mixed = stage["mixing sources to target weights"](spark, found, folder).collect()
    counts = Counter(r.doc_id for r in mixed)
    assert set(counts) <= set(keep) and max(counts.values()) <= 2
    words = {k: len((clean[k] or "").split()) for k in keep}
    total = {s: sum(words[k] for k in keep if rows[k][3] == s) for s in "abc"}
    budget, weight, target, open_ = 1.5 * sum(total.values()), {"a": 3, "b": 1, "c": 2}, {}, set("abc")
    while open_:
        level = budget / sum(weight[s] for s in open_)
        full = [s for s in open_ if level * weight[s] > 2 * total[s]]
        for s in full or sorted(open_):
            target[s] = 2.0 * total[s] if full else level * weight[s]
        budget -= sum(target[s] for s in full)
        open_ = open_ - set(full) if full else set()
    for s in "abc":
        assert abs(sum(words[k] * n for k, n in counts.items() if rows[k][3] == s) - target[s]) <= 7
    ids = corpus_pipeline.run(spark, folder).collect()
    assert Counter(r.doc_id for r in ids) == counts
    with open(public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), "rb") as file:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, file)}
    encoding = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    for r in ids:
        text = clean[r.doc_id] or ""
        expected = encoding.encode_ordinary(text)
        assert r.n_tokens == len(expected) and bytes(r.ids) == np.array(expected, "<u4").tobytes()
        assert r.decoded_sha256 == hashlib.sha256(text.encode()).hexdigest()
