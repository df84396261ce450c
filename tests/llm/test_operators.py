"""The operators beside brute force, on a table of odd rows and on an empty one."""

import hashlib
import math
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from tests.llm.conftest import rows as odd_rows
from varloom.llm import lm_scoring, media, mixing, near_dedup, packing, pii, quality, quality_rules, registry, subwords, token_files, url_filters

WORD = re.compile("[^\x20\x09-\x0d]+")
ROWS = [(r[0], r[1]) for r in odd_rows()]


def words(text):
    return WORD.findall(text or "")


def lower(text):
    return (text or "").encode().lower().decode()


def held(key, mod, value):
    return zlib.crc32(b"" if key is None else str(key).encode()) % mod == value


def ordered(df):
    return sorted(df.collect(), key=lambda r: tuple((x is not None, str(x)) for x in r))


# 1


def brute_scores(texts, order, strength):
    """(doc_id, held out, tokens, known, training tokens, base, score) by the formula, n-gram by n-gram."""
    tokens = [[w for w in words(lower(t))] + [None] for _, t in texts]
    train = [not held(k, 10, 0) for k, _ in texts]
    c = Counter()
    for t, ok in zip(tokens, train):
        if ok:
            c[("<s>",)] += 1
            row = ["<s>", *t]
            for k in range(1, order + 1):
                c.update(tuple(row[i : i + k]) for i in range(1 if k == 1 else 0, len(row) - k + 1))
    seen = {w: n for w, n in c.items() if len(w) == 1 and w != ("<s>",)}
    n, v = sum(seen.values()), len(seen)

    def p(history, w):
        if not history:
            return (seen.get((w,), 0) + 0.1) / (n + 0.1 * (v + 1))
        return (c[(*history, w)] + strength * p(history[1:], w)) / (c[history] + strength)

    out = []
    for (k, _), t, ok in zip(texts, tokens, train):
        row = ["<s>", *t]
        score = sum(math.log10(p(tuple(row[max(0, i - order + 1) : i]), row[i])) for i in range(1, len(row)))
        out.append((k, not ok, len(t), sum((w,) in seen for w in t), n, sum(math.log10(p((), w)) for w in t), score))
    return out


@pytest.mark.parametrize("order,fan", [(1, 256), (2, 256), (3, 256), (3, 2), (4, 3)])
def test_lm_scores(odd, nothing, order, fan):
    """Every order, through one level of the tree and through several."""
    got = defaultdict(list)
    for r in lm_scoring.lm_scores(odd, order=order, strength=16.0, block_bytes=20_000, fan=fan).collect():
        got[r.doc_id].append((r.held_out, r.n_tokens, r.n_known, r.train_tokens, r.base_score, r.score))
    for k, *want in brute_scores(ROWS, order, 16.0):
        there = [x for x in got[k] if x[:4] == tuple(want[:4]) and x[4:] == pytest.approx(tuple(want[4:]))]
        assert there, (k, want, got[k])
        got[k].remove(there[0])
    assert not any(got.values())
    assert fan != 256 or lm_scoring.lm_scores(nothing, order=order).count() == 0


def test_lm_probabilities_sum_to_one(spark):
    """Over all known words, the end and one unknown word, in every kind of state, from the operator's scores."""
    docs = [(k, t) for k, t in enumerate(["a b a c", "b a b", "c c a b", "a", "b c", "a b b"]) if not held(k, 10, 0)]
    free = [k for k in range(100, 900) if held(k, 10, 0)]
    vocabulary = sorted({w for _, t in docs for w in t.split()})
    for before in ("", "a", "zzz", "a b", "b zzz"):
        # P(text) less the part of its end: the last word's step; what is left of 1 is the end's.
        follow = [f"{before} {w}".strip() for w in (*vocabulary, "unseen")]
        rows = docs + list(zip(free, [before, *follow]))
        score = {r.doc_id: r.score for r in lm_scoring.lm_scores(spark.createDataFrame(rows, "doc_id long, text string"), strength=4.0).collect()}
        ends = [end_step(docs, t, 4.0) for t in (before, *follow)]
        whole = [score[k] for k in free[: 1 + len(follow)]]
        start = whole[0] - ends[0]
        assert sum(10 ** (w - e - start) for w, e in zip(whole[1:], ends[1:])) + 10 ** ends[0] == pytest.approx(1)


def end_step(docs, text, strength):
    """log10 of the end's probability after ``text``, with trigrams."""
    rows = [["<s>", *words(t), None] for _, t in docs]
    count = Counter(tuple(r[i : i + n]) for r in rows for n in (1, 2, 3) for i in range(len(r) - n + 1))
    n, v = sum(len(r) - 1 for r in rows), len({w for r in rows for w in r[1:]})
    p, history = (count[(None,)] + 0.1) / (n + 0.1 * (v + 1)), ["<s>", *words(text)]
    for size in range(1, min(2, len(history)) + 1):
        h = tuple(history[-size:])
        p = (count[(*h, None)] + strength * p) / (count[h] + strength)
    return math.log10(p)


def test_scoring_query_equals_sql(spark, tmp_path):
    import duckdb

    d = "/root/testdata/sf0.001"
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM '{d}/documents.parquet'")
    cursor = con.execute(registry.oracle_sql()["op1_lm_scoring"])
    names = [c[0] for c in cursor.description]
    want = {r[names.index("doc_id")]: dict(zip(names, r)) for r in cursor.fetchall()}
    got = {r.doc_id: r.asDict() for r in lm_scoring.op1_lm_scoring(spark, d).collect()}
    assert got == want


# 2


def test_media_round_trip(spark, odd, nothing, tmp_path):
    stored = media.store_texts(odd)
    refs = media.references(media.interleave(stored, "doc_id", "html"), "doc_id")
    got = media.resolve(refs, media.measure_store(stored)).collect()
    assert len(got) == len(ROWS)
    want = Counter()
    for k, t in ROWS:
        data = (t or "").encode()
        size = max(192, -(-len(data) // 192) * 192)
        payload = data.ljust(size, b" ")
        want[(k, len(data), size, hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-16:]))] += 1
    assert Counter((r.doc_id, int(r.caption.split()[0]), r.payload_bytes, r.payload_sha256, r.tail_crc32) for r in got) == want
    assert media.store_texts(nothing).count() == 0


def test_png_detects_damage():
    data = media.to_png(media.pad(b"hello"))
    assert media.from_png(data).tobytes() == media.pad(b"hello")
    with pytest.raises(ValueError):
        media.from_png(data[:60] + bytes([data[60] ^ 1]) + data[61:])


def test_interleaving_keeps_positions_and_captions(spark):
    page = '<h1>Title</h1><p>one <b>two</b><img src="media:d1" alt="first">three</p><script>no</script><figure><img src="d2"><figcaption>second &amp; last</figcaption></figure><p>end'
    df = spark.createDataFrame([(1, page), (2, None)], "page_id long, html string")
    r = {x.page_id: x.segments for x in media.interleave(df, "page_id", "html").collect()}
    assert [(s.position, s.kind, s.text or s.digest, s.caption) for s in r[1]] == [(0, "text", "Title", None), (1, "text", "one two", None), (2, "media", "d1", "first"), (3, "text", "three", None), (4, "media", "d2", "second & last"), (5, "text", "end", None)]
    assert r[2] == []
    store = media.measure_store(spark.createDataFrame([("d2", bytearray(media.to_png(media.pad(b"x"))))], "digest string, media binary"))
    got = {x.digest: x.payload_bytes for x in media.resolve(media.references(media.interleave(df, "page_id", "html"), "page_id"), store).collect()}
    assert got == {"d1": None, "d2": 192}


@pytest.mark.parametrize(
    "page,want",
    [
        ("<figure><figcaption>first</figcaption><img src=a><img src=b alt=x></figure><p>t", [("a", "first"), ("b", "first"), "t"]),
        ("<figure><img src=a><figcaption>open<p>rest</figure>tail", [("a", None), "open", "rest", "tail"]),
        ("<figure><img src=a><figcaption>open <b>end", [("a", None), "open end"]),
        ("a<template>b<img src=c></template>d<template>e", ["ade"]),
        ("a<noscript>b<img src=c></noscript><img src=d>", ["a", ("d", None)]),
        ("a<script>if (x < 1) { '<img src=q>' }</script><style>p {}</style>b", ["ab"]),
        ("<figure><figure><img src=a><figcaption>in</figcaption></figure><img src=b><figcaption>out <i>er</i><br>two</figcaption></figure>", [("a", "out er two"), ("b", "out er two")]),
        ("<figcaption>no figure</figcaption><img src=a>", ["no figure", ("a", None)]),
        ("</figure></figcaption></p><img><img src alt>", [("", None), ("", None)]),
        ("<figure/><p/>x<img src=a/><template/>y", ["x", ("a/", None), "y"]),
        ("a &amp; b &lt;img src=q&gt; <!-- <img src=z> --> c", ["a & b <img src=q> c"]),
        ("", []),
        ("<", ["<"]),
    ],
)
def test_ordinary_pages(page, want):
    """Captions before their media, unclosed and nested elements, hidden parts."""
    got = [s["text"] if s["kind"] == "text" else (s["digest"], s["caption"]) for s in media.segments(page)]
    assert got == want and [s["position"] for s in media.segments(page)] == list(range(len(got)))


def test_features_by_hand(spark):
    """The feature of stored payloads, pixel by pixel."""
    for text in ("", "x", "café " * 300, "".join(chr(33 + k % 90) for k in range(5_000))):
        payload = media.pad(text.encode())
        pixels = [payload[i : i + 3] for i in range(0, len(payload), 3)]
        n = len(pixels)
        means = [sum(p[c] for p in pixels) * 100 // n for c in range(3)]
        spread = [round(math.sqrt(n * sum(p[c] ** 2 for p in pixels) - sum(p[c] for p in pixels) ** 2) * 100 / n) for c in range(3)]
        size = len(payload) // 64
        cells = [sum(payload[i * size : (i + 1) * size if i < 63 else len(payload)]) for i in range(64)]
        bits = "".join("1" if c * 64 > sum(payload) else "0" for c in cells)
        assert media.feature(media.from_png(media.to_png(payload))) == f"64x{len(payload) // 192};mean={','.join(map(str, means))};dev={','.join(map(str, spread))};ahash={int(bits, 2):016x}"


# 3


def targets(sizes):
    names = sorted((s for s in sizes if s is not None), key=lambda s: s.encode()) + [s for s in sizes if s is None]
    weight = {s: k % 3 + 1 for k, s in enumerate(names)}
    fixed, total = {}, sum(sizes.values())
    while True:
        free = [s for s in names if s not in fixed]
        share = {s: (total - sum(fixed.values())) * weight[s] / sum(weight[x] for x in free) for s in free}
        over = [s for s in free if share[s] > 3 * sizes[s]]
        if not over:
            return share | fixed
        fixed |= {s: 3 * sizes[s] for s in over}


def test_mixing(odd, nothing):
    got = mixing.plan_mix(odd, shard_words=800).collect()
    assert len(got) == len(ROWS)
    sizes, taken = Counter(), Counter()
    for r in got:
        sizes[r.source] += r.size
        taken[r.source] += r.taken
        assert 0 <= r.taken <= 3 * r.size and len(r.shards) * r.size >= r.taken
    want = targets(dict(sizes))
    for r in got:
        assert r.source_size == sizes[r.source] and r.target == pytest.approx(want[r.source])
    assert all(abs(taken[s] - want[s]) <= 1 for s in sizes)
    assert ordered(mixing.plan_mix(odd, shard_words=800)) == sorted(got, key=lambda r: tuple((x is not None, str(x)) for x in r))
    assert mixing.plan_mix(nothing).count() == 0


def test_capped_sources(spark):
    docs = spark.createDataFrame([(k, "w " * n, s) for k, (n, s) in enumerate([(100, "a"), (2, "b"), (2, "c"), (50, "d")])], "doc_id long, text string, source string")
    got = {r.source: r.target for r in mixing.plan_mix(docs).collect()}
    assert got == pytest.approx(targets({"a": 100, "b": 2, "c": 2, "d": 50}))


def test_split_tree_keeps_quotas(spark):
    quotas = {0: 37, 1: 5, 2: 58}
    copies = spark.createDataFrame(list(quotas.items()), "sid int, copies long")
    for shards in (1, 7, 300):
        rows = mixing.split_tree(copies, shards, 3).collect()
        assert len(rows) == 3 * shards and {s: sum(r.quota for r in rows if r.sid == s) for s in quotas} == quotas
        assert max(sum(r.quota for r in rows if r.shard == k) for k in range(shards)) <= -(-100 // shards) + (shards - 1).bit_length()
        for s in quotas:
            run = sorted((r.first, r.until, r.shard) for r in rows if r.sid == s and r.quota)
            assert run[0][0] == 0 and run[-1][1] == quotas[s] and all(x[1] == y[0] and x[2] < y[2] for x, y in zip(run, run[1:]))


def test_draws_are_hypergeometric(spark):
    """Mean and variance of the left half's count over many trees."""
    copies = spark.createDataFrame([(0, 30), (1, 70)], "sid int, copies long")
    got = [r.quota for seed in range(10) for r in mixing.split_tree(copies, 2, seed).filter("sid = 0 and shard = 0").collect()]
    assert abs(np.mean(got) - 15) < 2.5 and 0.8 < np.var(got) < 18  # 15 and 5.3


def test_mixed_rows_follow_the_plan(odd):
    docs = odd.filter("doc_id is not null").dropDuplicates(["doc_id"])
    plan = {r.doc_id: r.taken for r in mixing.plan_mix(docs).collect()}
    out = mixing.mix(docs)
    assert out.columns == docs.columns and out.dtypes == docs.dtypes
    found = Counter()
    for r in out.collect():
        found[r.doc_id] += len(words(r.text))
    assert {k: v for k, v in plan.items() if v} == dict(found)


def test_repeated_ids_are_mixed_row_by_row(spark):
    """Rows of one id, null included, in different sources and with different texts."""
    rows = [(1, "w " * 100, "a"), (1, "x " * 10, "b"), (2, "y " * 50, "c"), (None, "z " * 30, "a"), (None, "z " * 30, "a"), (None, "v " * 20, None), (3, None, "b")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string").cache()
    plan, found = Counter(), Counter()
    for r in mixing.plan_mix(docs, shard_words=40).collect():
        plan[(r.doc_id, r.source, r.size)] += r.taken
    for r in mixing.mix(docs, shard_words=40).collect():
        w = words(r.text)
        found[(r.doc_id, r.source, {"w": 100, "x": 10, "y": 50, "z": 30, "v": 20}[w[0]])] += len(w)
    assert +plan == found
    want = targets({"a": 160, "b": 10, "c": 50, None: 20})
    assert {s: sum(n for k, n in plan.items() if k[1] == s) for s in want} == pytest.approx(want, abs=1)


def test_copies_lie_in_the_shards_that_drew_them(odd):
    """Each copy has a shard, no shard is far from its share of the words, reruns agree on both."""
    docs = odd.filter("size(split(text, ' ')) < 1000")
    got, again = (sorted((str(r.doc_id), r.size, r.taken, r.shards) for r in mixing.plan_mix(docs, shard_words=600).collect()) for _ in range(2))
    assert got == again
    assert all(len(s) == -(-t // n) if n else not s or t == 0 for _, n, t, s in got)


# 4


def measures(text):
    w = words(text)
    places = defaultdict(list)
    for i in range(len(w) - 2):
        places[tuple(w[i : i + 3])].append(i)
    covered = {i + d for p in places.values() if len(p) > 1 for i in p for d in range(3)}
    lines = [x for x in (text or "").split("\n") if words(x)]
    failed = len(w) < 50 or 100 * len(covered) > 50 * len(w)
    return len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", text or "")), len(lines) - len(set(lines)), len(covered), failed


def test_quality_rules(odd, nothing, labels):
    weights = quality_rules.place_weights(quality_rules.place_counts(odd, labels))
    got = Counter((r.doc_id, r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words, r.base_failed) for r in quality_rules.judge(odd, weights).collect())
    assert got == Counter((k, *measures(t)) for k, t in ROWS)
    assert quality_rules.judge(nothing, weights).count() == 0
    none = quality_rules.place_weights(quality_rules.place_counts(nothing, labels)).first()
    assert set(none.first) == set(none.second) == {0.0} and len(none.first) == 2 * quality_rules.BUCKETS


def test_scores_and_verdicts_by_hand(spark, odd, labels):
    """Weights, scores, the cut and the verdict beside plain Python, with Spark's hashes as given."""
    buckets, sample = 64, 9
    rows = [(r.doc_id, r.text or "") for r in odd.select("doc_id", "text").collect()]
    distinct = sorted({w for _, t in rows for w in words(t)})
    h = {r.w: r.h for r in spark.createDataFrame([(w,) for w in distinct], "w string").selectExpr("w", "xxhash64(w) as h").collect()}
    pairs = sorted({(h[a], h[b]) for _, t in rows for a, b in zip(words(t), words(t)[1:])})
    g = {(r.a, r.b): r.h for r in spark.createDataFrame(pairs, "a long, b long").selectExpr("a", "b", "xxhash64(a, b) as h").collect()}
    fold = {r.t: r.f for r in spark.createDataFrame([(t,) for t in {t for _, t in rows}], "t string").selectExpr("t", "pmod(hash(t), 2) as f").collect()}
    order = {r.k: r.h for r in spark.createDataFrame([(k,) for k in range(30)], "k long").selectExpr("k", "xxhash64(k) as h").collect()}
    grams = lambda t: [h[w] % buckets for w in words(t)] + [buckets + g[h[a], h[b]] % buckets for a, b in zip(words(t), words(t)[1:])]
    good = sorted((k for k in range(30) if k % 2 == 1 and not held(k, 3, 1)), key=lambda k: (order[k], k))[:sample]
    raw, target = Counter(), (Counter(), Counter())
    for k, t in rows:
        raw.update(grams(t))
        if k in good:
            target[fold[t]].update(grams(t))

    def weight(place, which):
        kind = place >= buckets
        of = lambda c: sum(n for p, n in c.items() if (p >= buckets) == kind)
        t = target[which]
        return math.log((t[place] + 1) / (raw[place] * of(t) / of(raw) + 1)) if of(t) and place in raw else 0.0

    assert all(sum(t.values()) for t in target)
    want = {}
    for k, t in rows:
        w = grams(t)
        want[k, t] = sum(weight(p, 1 - fold[t]) for p in w) / len(w) if w else 0.0
    weights = quality_rules.place_weights(quality_rules.place_counts(odd, labels, buckets, sample), buckets)
    got = quality_rules.scored(odd, weights, buckets).collect()
    for r in got:
        assert any(k == r.doc_id and r.score == pytest.approx(s, abs=1e-9) for (k, _), s in want.items())
    scores = quality_rules.scored(odd, weights, buckets)
    cut = quality_rules.separating(scores, labels)
    teach = {k: k % 2 for k in range(30) if not held(k, 3, 1)}
    seen = [(r.score, teach[r.doc_id]) for r in got if not r.base_failed and r.doc_id in teach]
    n = Counter(q for _, q in seen)
    rate = lambda c: sum((s >= c) == bool(q) and 1 / n[q] for s, q in seen)
    assert rate(cut) >= max(rate(s) for s, _ in seen) - 1e-9 or cut == quality_rules.THRESHOLD
    kept = {r.doc_id for r in quality_rules.decide(scores, cut).collect() if r.kept}
    assert kept == {r.doc_id for r in got if not r.base_failed and r.score >= cut}


def test_ratio_rejects_what_the_target_lacks(spark):
    good, bad = "the river and the stone house of light " * 10, "zz | yy | xx | zz | ww | yy | " * 12
    docs = spark.createDataFrame([(k, (good if k % 2 else bad) + f" w{k} v{k}") for k in range(40)], "doc_id long, text string")
    labels = spark.createDataFrame([(k, k % 2) for k in range(40)], "doc_id long, quality int")
    scores = {r.doc_id: r.score for r in quality_rules.judge(docs, quality_rules.place_weights(quality_rules.place_counts(docs, labels))).collect()}
    assert min(scores[k] for k in scores if k % 2) > 0 > max(scores[k] for k in scores if not k % 2)


def test_ratio_holds_for_a_large_vocabulary(spark, tmp_path):
    r = random.Random(4)
    texts = [" ".join(f"{'junk' if k % 60 == 0 else 'word'}{r.randrange(800 if k % 60 == 0 else 20_000)}" for _ in range(150)) for k in range(1260)]
    spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    # Labels for about half of each kind: the verdict must hold for the others too.
    spark.createDataFrame([(k, int(k % 60 > 0), 0) for k in range(1260) if k % 120 < 60], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    kept = {x.doc_id for x in quality_rules.op4_quality_rules(spark, str(tmp_path)).filter("kept").collect()}
    assert kept == {k for k in range(1260) if k % 60}


# 5


def test_url_filters(spark):
    rules = (("block", "com", "/en/"), ("allow", "a.com", "/en/7"), ("block", "a.com", "/en/77"), ("allow", "b", ""), ("block", "x.b", "/"))
    urls = [None, "", "nothing", "http://com/en/\U0010ffffx", "http://com/en/\U0010ffff", "http://com/en", "http://a.com/en/7\U0010ffff\U0010ffff", "http://com/en0", "http://", "http://com/en/", "HTTPS://W.A.COM/en/771?x#y", "http://a.com/en/7", "http://aa.com/en/7", "http://a.com#/en/7", "ftp://b", "ftp://x.b", "ftp://x.b/", "ftp://q.x.b/z?/", "http://com/en/" * 3, "http://a.com/EN/7"] + ["http://b/x"] * 3
    got = Counter((r.page_id, r.host, r.path, r.rule, r.verdict) for r in url_filters.judge_urls(spark.createDataFrame(list(enumerate(urls)), "page_id long, url string"), rules, partition_rows=3).collect())
    want = Counter()
    for k, u in enumerate(urls):
        rest = u.split("://", 1)[1] if u and "://" in u else ""
        host, path = lower(re.match("[^/?#]*", rest)[0]), re.match("[^/?#]*([^?#]*)", rest)[1]
        fits = [(len(h + p), len(h), h + p, v) for v, h, p in rules if host and (host == h or host.endswith("." + h)) and path.startswith(p)]
        best = max(fits, default=(0, 0, None, "allow"))
        want[(k, host, path, best[2], best[3])] += 1
    assert got == want
    assert url_filters.judge_urls(spark.createDataFrame([], "page_id long, url string, host string, path string")).count() == 0


# 6

PLAIN = {"email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", "card": r"[0-9]([\x20-]?[0-9])+", "phone": r"\+[0-9][\x20().0-9-]+[0-9]"}


def base_spans(text):
    out = []
    for rank, (kind, p) in enumerate(PLAIN.items()):
        for m in re.finditer(p, text or ""):
            digits = re.sub("[^0-9]", "", m[0])
            luhn = sum(sum(divmod(int(d) * (1 + i % 2), 10)) for i, d in enumerate(reversed(digits))) % 10 == 0
            if kind == "email" or kind == "ip" and all(int(x) < 256 for x in m[0].split(".")) or kind == "card" and 12 <= len(digits) <= 19 and luhn or kind == "phone" and 9 <= len(digits) <= 15:
                out.append((m.start(), rank, kind, m.end()))
    return ",".join(f"{k}:{s}:{e}" for s, _, k, e in sorted(out))


def test_personal_data(spark, odd, nothing):
    hard = ["a@b.com_foo@x.org", "1.2.3.4.5.6.7.8 256.1.1.1", "4111-1111-1111-1111-4 4111 1111 1111 1111", "+1+12 345 67 89 ) .", "a@b.c" + ".c" * 9000, "1 " * 9000, "9" * 9000, "é4111111111111111é 語 a@b.cd"]
    for docs, texts in ((odd, ROWS), (spark.createDataFrame(list(enumerate(hard)), "doc_id long, text string"), list(enumerate(hard)))):
        got = Counter((r.doc_id, ",".join(f"{x.kind}:{x.start}:{x.end}" for x in r.base)) for r in pii.find(docs).collect())
        assert got == Counter((k, base_spans(t)) for k, t in texts)
    assert pii.find(nothing).count() == 0


def test_contexts_discover_and_mask(spark):
    texts = [f"please contact my friend mail user{i}@mail.example.com now" for i in range(9)] + ["you contact my friend mail bob@localhost, ok", "the bob@localhost again", "friend mail none here 55"]
    docs = spark.createDataFrame([(k, t, len(t)) for k, t in enumerate(texts)], "doc_id long, text string, n_chars int")
    spans = {r.doc_id: [(x.kind, r.doc_id) for x in r.all_spans] for r in pii.find(docs).collect()}
    assert [len(spans[k]) for k in (9, 10, 11)] == [1, 1, 0]
    masked = {r.doc_id: (r.text, r.n_chars) for r in pii.mask(docs).collect()}
    assert masked[9][0] == "you contact my friend mail <email>, ok" and masked[11] == (texts[11], len(texts[11])) and masked[9][1] == len(masked[9][0])


def test_discovered_instances_everywhere(spark):
    """Where no word stands before them, found by a third round, and behind long words."""
    texts = [f"{a} beta s{i}@mail.example.com" for a in ("first", "second", "third") for i in range(20)]
    for k, a in enumerate(("first", "second", "third")):
        texts += [f"{a} beta r{r}n{i}@local" for r in (k, k + 1) if r for i in range(5)]
    long = "x" * 70
    texts += [f"{long} {long} u{i}@mail.example.com" for i in range(5)] + [f"{'y' * 70} {long} v{i} end" for i in range(20)]
    ends = [f"{long} {long} w@local", "r1n0@local wrote", "id 12 r2n0@local", "r3n0@local", "see r3n4@local"]
    docs = spark.createDataFrame([(k, t) for k, t in enumerate(texts + ends)], "doc_id long, text string")
    masked = {r.doc_id: r.text for r in pii.mask(docs).collect()}
    assert [masked[len(texts) + k] for k in range(len(ends))] == [f"{long} {long} <email>", "<email> wrote", "id 12 <email>", "<email>", "see <email>"]
    assert all(masked[k] == t for k, t in enumerate(texts) if " v" in t)


def plain_occurrences(text):
    """(start, end, patterns, instance, kind, fits) of the tokens that look like identifiers, one by one."""
    spans = []
    for x in filter(None, base_spans(text).split(",")):
        kind, a, b = x.split(":")
        spans.append((int(a), pii.KINDS.index(kind), int(b), kind))
    pieces, seeds, upto = [], [], 0
    for a, rank, b, kind in sorted(spans):
        if a >= upto:
            pieces.append((upto, a))
            seeds.append([a, None, kind, rank])
        upto = max(upto, b)
        seeds[-1][1] = upto
    out, clean, places = [], "", []  # places: of each character of the clean text
    at = 0
    for a, b, kind, rank in seeds:
        clean += text[at:a] + pii._MARKS[rank]
        places += [*range(at, a), a]
        at = b
    clean, places = clean + text[at:], places + [*range(at, len(text))]
    tokens = [(m[0], places[m.start()]) for m in WORD.finditer(clean)]
    name = lambda w: "<id>" if re.search(f"[{pii._MARKS}]", w) else "<number>" if re.search("[0-9@]", w) else lower(w)
    starts = {a: (a, b, kind) for a, b, kind, _ in seeds}
    first = {places[i]: starts[places[i]] for i, c in enumerate(clean) if c in pii._MARKS}
    for i, (word, start) in enumerate(tokens):
        if not re.search(f"[0-9@{pii._MARKS}]", word):
            continue
        mark = re.search(f"[{pii._MARKS}]", word)
        lead = word[: mark.start()] if mark else re.match(pii._LEAD, word)[0]
        own = first.get(start + len(lead)) if mark else None
        # A base value as it was matched, not as it was merged.
        bare = next(text[a:b] for a, _, b, _ in sorted(spans) if a == own[0]) if mark else re.sub(pii._TAIL, "", word[len(lead) :])
        if not bare:
            continue
        context = [w for w in (name(re.sub("[\"'(\\[<{`]", "", lead)), *(name(tokens[k][0]) if k >= 0 else "" for k in (i - 1, i - 2))) if w][:2]
        patterns = ["2 " + context[1] + " " + context[0]] if len(context) > 1 else []
        patterns += ["1 " + context[0]] if context else []
        patterns += ["0 " + context[0][-1]] if context and context[0][-1] in "=:" else []
        digits = re.sub("[^0-9]", "", bare)
        luhn = 12 <= len(digits) <= 19 and sum(sum(divmod(int(d) * (1 + k % 2), 10)) for k, d in enumerate(reversed(digits))) % 10 == 0
        secret = bool(re.search("[0-9]", bare) and re.search("[A-Za-z]", bare)) and not re.search(pii.NOT_SECRET, " ".join(context))
        fit = {"email": True, "ip": True, "card": luhn, "phone": 7 <= len(digits) <= 15, "secret": secret}
        fits = {k for k in pii.EVERY_KIND if re.search(pii.SHAPES[k], bare) and fit[k]}
        kind = own[2] if mark else "secret" if secret and re.search(pii._SECRET_SEED, bare) else None
        begin = own[0] if mark else start + len(lead)
        out.append((begin, begin + len(bare), patterns, bare, kind, fits))
    return out


def plain_discovery(found):
    """Kinds of unseen instances, with scores by the formula and rounds to a fixpoint."""
    edges = {(p, x[3]) for x in found for p in x[2]}
    fits = defaultdict(set)
    for x in found:
        fits[x[3]] |= x[5]
    known = {}
    for x in found:
        if x[4]:
            known[x[3]] = max(known.get(x[3], ""), x[4])
    seeds = {i for i, k in known.items() if k != "secret"}
    sure = set(seeds)
    while True:
        members = defaultdict(list)
        for p, i in edges:
            members[p].append(i)
        offers = {}
        for p, items in members.items():
            n = len(items)
            of = Counter(known[i] for i in items if i in known)
            best = max(pii.EVERY_KIND, key=lambda k: (of[k], -pii.EVERY_KIND.index(k)))
            share, z = of[best] / n, pii.Z
            score = (share + z * z / (2 * n) - z * math.sqrt((share * (1 - share) + z * z / (4 * n)) / n)) / (1 + z * z / n)
            if score >= pii.MIN_SCORE:
                for i in items:
                    if i not in sure and best in fits[i] and known.get(i) in (None, best):
                        offers[i] = max(offers.get(i, (0, "")), (score, best))
        if not offers:
            return {i: known[i] for i in sure - seeds}
        known |= {i: k for i, (_, k) in offers.items()}
        sure |= set(offers)


@pytest.mark.parametrize("table", ["odd", "contexts", "/root/testdata/sf0.01"])
def test_discovery_by_hand(spark, odd, table):
    """Occurrences, pattern scores and added spans beside plain Python."""
    if table == "odd":
        docs, texts = odd, ROWS
    elif table == "contexts":
        r = random.Random(8)
        texts = [f"ip={r.randrange(256)}.{r.randrange(256)}.0.1 x" for _ in range(12)] + ["ip=10.0.0.300, y", "see ip=fe80::1:2", "10.0.0.300"]
        texts += [f'set key: "{r.getrandbits(160):040x}"' for _ in range(9)] + ['KEY: "ABCDEF0123456789XYZ"!', f"commit {r.getrandbits(160):040x}", "é key: abc0def1ghi2jkl3mno4 end"]
        texts += [f"call me +1 (555) 010-{k:04}" for k in range(20)] + ["call me 555-0199.", "call me later 7", "mailto:ann@x.org,bob@y.org mailto:cid@host"] + [f"<mailto:u{k}@x.org>" for k in range(9)]
        texts = list(enumerate(texts))
        docs = spark.createDataFrame(texts, "doc_id long, text string")
    else:
        docs = spark.read.parquet(f"{table}/documents.parquet")
        texts = [(r.doc_id, r.text) for r in docs.collect()]
    found = {k: plain_occurrences(t or "") for k, t in texts}
    kinds = plain_discovery([x for rows in found.values() for x in rows] if table != "odd" else [x for k, t in texts for x in plain_occurrences(t or "")])
    want = {k: {(kinds[x[3]], x[0], x[1]) for x in rows if x[4] in (None, "secret") and x[3] in kinds} for k, rows in found.items()}
    got = {r.doc_id: {(x.kind, x.start, x.end) for x in r.all_spans} - {(x.kind, x.start, x.end) for x in r.base} for r in pii.find(docs).collect()}
    assert got == want
    assert table == "odd" or any(want.values())


def test_long_texts_take_linear_time(spark):
    """40,000 tokens of figures in one text, and 20,000 identifiers."""
    import time

    figures, mails = " ".join(map(str, range(40_000))), " ".join(f"a{k}@b.example.com" for k in range(20_000))
    docs = spark.createDataFrame([(1, figures), (2, mails)], "doc_id long, text string")
    began = time.time()
    got = {r.doc_id: r.n for r in pii.find(docs).selectExpr("doc_id", "size(base) as n").collect()}
    masked = {r.doc_id: r.text for r in pii.mask(docs).collect()}
    assert got == {1: 0, 2: 20_000} and masked == {1: figures, 2: " ".join(["<email>"] * 20_000)}
    assert time.time() - began < 60


# 7 and 8


@pytest.fixture(scope="module")
def library():
    from tokenizers import Tokenizer

    def ids(name, end):
        t = Tokenizer.from_file(subwords.vocabulary_path(name))
        return lambda text: np.array([*t.encode(text or "", add_special_tokens=False).ids, end], "<u4")

    return ids


def test_encoder_equals_library(library):
    r = random.Random(5)
    pool = [*"abcZ.,.,  \n'!019-İıßéσςΣЖё", "\u0307", "\u0301", "\u093c", "\u0958", "\ufb1d", "\u2126", "\u3000", "\u00a0", "\u1e9e", "\ufb01", "\u1f80", "\U00010400", ". ", "'s "]
    fuzz = ["".join(r.choice(pool) if r.random() < 0.9 else chr(r.choice([r.randrange(32, 0x2FF), r.randrange(0x300, 0xD7FF), r.randrange(0xE000, 0x10FFFF)])) for _ in range(r.randint(0, 25))) for _ in range(3_000)]
    hard = [*fuzz, "KARAR VERİLDİ. Sonra", "TARİHİ, yeni", "", " a", "a ", "a  b", "\n\nfoo bar. \n x", "don't go.", "İΣ Σas. ος", "é ́x", "foo,bar. baz.", "<|endoftext|> hi", "12.5, zz.", "a  b c\u0085 d", "x.\nY, z.\n", "a\x01b c", "café Ÿ ª µm", None]
    for name, keeps, end in (("byte_bpe_50k.json", True, 1), ("word_bpe_49k.json", False, 2)):
        coder, want = subwords.Encoder(subwords.vocabulary_path(name), keeps, end, cache_units=8), library(name, end)
        want = {t: want(t).tolist() for t in hard}.__getitem__
        for _ in range(2):
            ids, bounds = coder.encode(pa.array(hard))
            for k, t in enumerate(hard):
                assert ids[bounds[k] : bounds[k + 1]].tolist() == want(t), (name, t)


def test_packing(odd, nothing, library):
    got = packing.pack_documents(odd, subwords.vocabulary_path("byte_bpe_50k.json"), round_bytes=20_000).collect()
    want, pieces = library("byte_bpe_50k.json", 1), defaultdict(list)
    for r in got:
        pieces[r.doc_id].append(r)
    for k, t in ROWS:
        ids = want(t)
        copies = sum(x == k for x, _ in ROWS)
        mine = [p for p in pieces[k] if p.doc_tokens == len(ids)]
        assert Counter(p.length for p in mine) and sum(p.length for p in mine) == copies * len(ids)
        assert all(zlib.crc32(ids[p.start : p.start + p.length].tobytes()) == p.ids_crc32 for p in mine)
    windows = defaultdict(list)
    for r in got:
        windows[r.sequence_id].append((r.offset, r.length, r.tier))
    for w in windows.values():
        w.sort()
        assert w[0][0] == 0 and all(x[0] + x[1] == y[0] for x, y in zip(w, w[1:]))
        total = sum(x[1] for x in w)
        assert total <= 2048 and total & (total - 1) == 0
    assert packing.pack_documents(nothing, subwords.vocabulary_path("byte_bpe_50k.json")).count() == 0


def test_token_files(odd, nothing, library):
    shards = token_files.write_shards(odd, subwords.vocabulary_path("word_bpe_49k.json"), partition_bytes=2_000, shard_bytes=4_000)
    assert shards.count() > 1
    got = sorted(token_files.read_back(shards).collect(), key=lambda r: r.start)
    want, at = library("word_bpe_49k.json", 2), 0
    rows = sorted(ROWS, key=lambda r: (r[0] is not None, r[0] or 0))  # texts of one id are equal here
    assert [r.doc_id for r in got] == [k for k, _ in rows]
    for r, (_, t) in zip(got, rows):
        ids = want(t)
        assert (r.start, r.n_tokens, r.ids_crc32) == (at, len(ids), zlib.crc32(ids.tobytes()))
        at += len(ids)
    by_key = {k: t for k, t in ROWS}
    for key, found in token_files.lookup(shards, [*by_key, 10**15]).items():
        assert [x.tolist() for x in found] == [want(by_key.get(key)).tolist()] * sum(x == key for x, _ in ROWS)
    assert token_files.read_back(token_files.write_shards(nothing, subwords.vocabulary_path("word_bpe_49k.json"))).count() == 0


def test_a_key_in_many_shards(spark, library, tmp_path):
    """One id for most rows, null for others, written to a folder of the caller's."""
    r = random.Random(2)
    rows = [(7, " ".join(r.choice("abcdef") for _ in range(r.randint(0, 60)))) for _ in range(400)] + [(None, "x y")] * 90 + [(3, "z"), (9, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    shards = token_files.write_shards(docs, subwords.vocabulary_path("word_bpe_49k.json"), partition_bytes=400, shard_bytes=300, out=f"{tmp_path}/ids")
    want = library("word_bpe_49k.json", 2)
    assert token_files.directory(shards).filter("first_key <= 7 and last_key >= 7").count() > 3
    got = sorted(token_files.read_back(shards).collect(), key=lambda x: x.start)
    assert [x.doc_id for x in got] == sorted((k for k, _ in rows), key=lambda k: (k is not None, k or 0))
    assert all(x.start + x.n_tokens == y.start for x, y in zip(got, got[1:])) and got[0].start == 0
    assert Counter((x.doc_id, x.n_tokens, x.ids_crc32) for x in got) == Counter((k, len(want(t)), zlib.crc32(want(t).tobytes())) for k, t in rows)
    found = token_files.lookup(shards, [7, None, 4])
    assert Counter(tuple(x.tolist()) for x in found[7]) == Counter(tuple(want(t).tolist()) for k, t in rows if k == 7)
    assert len(found[None]) == 90 and found[4] == []


def test_perfect_hash():
    keys = np.unique(np.random.default_rng(1).integers(-(1 << 62), 1 << 62, 3_000))
    index, slots = token_files.PerfectHash.build(keys)
    assert sorted(slots.tolist()) == list(range(len(keys))) and (index.slot(keys) == slots).all()
    assert (index.slot(keys + 1) >= 0).mean() < 0.01


# 9


def test_classifier(spark, odd, nothing, labels):
    machine = quality.train(odd, labels)
    got = quality.score_documents(odd, machine).collect()
    assert len(got) == len(ROWS) and all(0 <= r.score <= 1 and r.predicted == int(r.score >= 0.5) and r.held_out == held(r.doc_id, 3, 1) for r in got)
    kept = quality.keep_good(odd, machine)
    assert kept.dtypes == odd.dtypes and kept.count() == sum(r.predicted for r in got)
    assert quality.score_documents(nothing, machine).count() == 0
    untaught = quality.train(odd, labels.filter("quality = 7"))
    assert {r.score for r in quality.score_documents(odd, untaught).collect()} == {0.5}


def test_classifier_on_held_out_rows(spark):
    d = "/root/testdata/sf0.01"
    docs, labels = spark.read.parquet(f"{d}/documents.parquet"), spark.read.parquet(f"{d}/labels.parquet")
    scored = quality.score_documents(docs, quality.train(docs, labels)).join(labels, "doc_id").filter("held_out").collect()
    assert np.mean([r.predicted == r.quality for r in scored]) > 0.97


def test_machine_equals_explicit_pairs():
    m = quality.FactorisationMachine(factors=3, seed=1)
    m.w[:20] = np.linspace(-1, 1, 20)
    i, x = np.array([2, 5, 11]), np.array([0.5, -1.0, 2.0])
    y, _ = m.raw(1, np.zeros(3, int), i, x)
    want = m.w0 + (m.w[i] * x).sum() + sum((m.v[i[a]] @ m.v[i[b]]) * x[a] * x[b] for a in range(3) for b in range(a + 1, 3))
    assert y[0] == pytest.approx(want, rel=1e-5)


# 10


def brute_components(texts):
    sets = []
    for _, t in texts:
        w = words(lower(t))
        sets.append({tuple(w[i : i + 5]) for i in range(len(w) - 4)} if len(w) >= 5 else {tuple(w)} if w else set())
    parent = list(range(len(texts)))

    def find(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for i, (k, _) in enumerate(texts):
        for j in range(i):
            if k is None or texts[j][0] is None:
                continue
            both = len(sets[i] & sets[j])
            if texts[j][0] == k or 100 * both >= 75 * len(sets[i] | sets[j]) > 0:
                a, b = find(i), find(j)
                parent[a] = b
    groups = defaultdict(list)
    for i, (k, _) in enumerate(texts):
        groups[find(i)].append(k)
    return [(k, len(sets[i]), k if k is None else min(groups[find(i)])) for i, (k, _) in enumerate(texts)]


def test_near_duplicates(odd, nothing):
    got = Counter((r.doc_id, r.n_shingles, r.component_id, r.kept) for r in near_dedup.near_duplicates(odd).collect())
    assert got == Counter((k, n, c, k is None or k == c) for k, n, c in brute_components(ROWS))
    assert near_dedup.near_duplicates(nothing).count() == 0


@pytest.mark.parametrize("chunk", [256, 8])
def test_groups_of_near_copies(spark, monkeypatch, chunk):
    """Chains and clouds of copies around the threshold, in one chunk and in several."""
    monkeypatch.setattr(near_dedup, "CHUNK", chunk)
    monkeypatch.setattr(near_dedup, "CHUNK_SHINGLES", 100 * chunk)
    r = random.Random(7)
    texts = []
    for g in range(3):
        base = [f"w{r.randint(0, 5000)}" for _ in range(150)]
        for _ in range(40):
            w = list(base)
            for _ in range(r.randint(0, 9)):
                w[r.randrange(len(w))] = f"v{r.randint(0, 10**6)}"
            texts.append(" ".join(w))
    rows = [(1000 - k, t) for k, t in enumerate(texts)]
    got = sorted((x.doc_id, x.component_id) for x in near_dedup.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect())
    assert got == sorted((k, c) for k, _, c in brute_components(rows))


def test_rows_of_one_id_are_one_document(spark):
    """An id with several texts links what each of them links with; equal rows stay equal."""
    r = random.Random(3)
    a, b, c = (" ".join(f"w{r.randint(0, 9000)}" for _ in range(60)) for _ in range(3))
    rows = [(9, a), (9, b), (9, b), (4, a + " x"), (5, b + " y"), (6, c), (None, a), (7, None), (7, "")]
    got = Counter((x.doc_id, x.n_shingles, x.component_id) for x in near_dedup.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect())
    assert got == Counter(brute_components(rows)) and got[(5, 57, 4)] == 1


def test_estimates_are_corrected():
    rng = np.random.default_rng(4)
    for share in (0.3, 0.6, 0.9):
        errors = []
        for _ in range(12):
            both, a, b = (rng.integers(0, 1 << 63, n, np.uint64) for n in (int(600 * share), int(300 * (1 - share)), int(300 * (1 - share))))
            x, y = np.concatenate([both, a]), np.concatenate([both, b])
            p, q = ((near_dedup.registers(z) ^ near_dedup._NAME).view(np.uint16)[None] for z in (x, y))
            errors.append(near_dedup.estimate(p, q, np.array([len(x)]), np.array([len(y)]))[0] - len(both) / (len(both) + len(a) + len(b)))
        assert abs(np.mean(errors)) < 0.04


def test_registry_names():
    assert sorted(int(re.match(r"op(\d+)_", k)[1]) for k in registry.queries()) == list(range(1, 11))
    assert set(registry.oracle_sql()) <= set(registry.queries())


def test_rows_keep_their_columns(odd, nothing):
    """Stages that return documents: clashing names, null rows and empty tables."""
    for stage in (pii.mask, mixing.mix):
        assert stage(odd).dtypes == odd.dtypes and stage(nothing).dtypes == odd.dtypes and stage(nothing).count() == 0
    assert pii.mask(odd).count() == len(ROWS)
    masked = [r.text for r in pii.mask(odd).collect() if r.text and "<email>" in r.text]
    assert masked and all(x in masked[0] for x in ("<phone>", "<card>", "<ip>")) and "ann.lee" not in masked[0]
