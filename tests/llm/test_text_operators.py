"""Tokenizers, rules, licenses and classifiers on small tables: nulls, empties, ties, repeated rows, clashing names, empty tables."""
import random
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from graftline.llm import bpe, licenses, quality_classifier, quality_rules, token_counts, toxicity, url_filter

LONG = "Wörter und words, 12½ " * 3000
TEXTS = [None, "", " \n\t", "Hello wörld's ÉTÉ <|endoftext|> it'll 12½", "Hello wörld's ÉTÉ <|endoftext|> it'll 12½", "ΟΔΟΣ İ x\x1cy ​", LONG, "aaaaaaaaaaaaaaaa " * 5, "Á Å ﬁ 中文字 अनु 😀"]


@pytest.fixture(scope="module")
def library():
    from tokenizers import Tokenizer

    return Tokenizer.from_file(bpe.default_tokenizer())


def table(spark, texts=TEXTS):
    return spark.createDataFrame([(i if i % 4 else None, t, "x", 1) for i, t in enumerate(texts)], "doc_id long, text string, IDS string, n_tokens int")


def test_bpe_equals_library(library):
    random.seed(3)
    alphabet = "abcXYZ 's'll\t\n\r\x0b\x1c\x85\xa0 ​²½ªßÀéİΣσςÅ12<|>|.!?中文अनु😀ǅ've<|endoftext|>ſK"
    texts = ["".join(random.choice(alphabet) for _ in range(random.randint(0, 60))) for _ in range(2000)]
    texts += ["".join(chr(random.choice([random.randint(0, 0x24F), random.randint(0, 0x2FFF)])) for _ in range(20)) for _ in range(2000)]
    with open(bpe.default_tokenizer(), encoding="utf-8") as f:
        encoder = bpe.Encoder(f.read())
    ids, count = encoder.encode([t.encode() for t in texts])
    for t, got in zip(texts, np.split(ids, np.cumsum(count)[:-1]), strict=True):
        assert got.tolist() == library.encode(t, add_special_tokens=False).ids


def test_bpe_forgets_without_change(monkeypatch):
    with open(bpe.default_tokenizer(), encoding="utf-8") as f:
        content = f.read()
    monkeypatch.setattr(bpe, "REMEMBERED", 3)
    few, data = bpe.Encoder(content), [b"one two three four five", b"six one <|endoftext|>", b""]
    got = [few.encode([d])[0].tolist() for d in data for _ in range(2)]
    assert got == [bpe.Encoder(content).encode([d])[0].tolist() for d in data for _ in range(2)]


def test_bpe_table(spark, library):
    rows = bpe.decode(bpe.encode(table(spark))).collect()
    assert len(rows) == len(TEXTS) and "IDS" not in rows[0].asDict()
    for r in rows:
        want = library.encode(r["text"] or "", add_special_tokens=False).ids
        assert r["ids"] == want and r["decoded"] == library.decode(want, skip_special_tokens=False)
    assert bpe.decode(bpe.encode(table(spark, []))).count() == 0
    both = bpe.encode_and_decode(table(spark))
    assert both.columns == bpe.decode(bpe.encode(table(spark))).columns and sorted(map(str, both.collect())) == sorted(map(str, rows))
    odd = spark.createDataFrame([(None,), ([],), ([320, 49407, 99999999, -1],)], "ids array<int>")
    assert [r["decoded"] for r in bpe.decode(odd).collect()] == [None, "", "a</w> <|endoftext|>"]


def test_token_counts(spark, library):
    rows = token_counts.count_tokens(table(spark), frequent=5).collect()
    assert sorted(r["n_tokens"] for r in rows) == sorted(len(library.encode(t or "", add_special_tokens=False).ids) for t in TEXTS)
    assert token_counts.count_tokens(table(spark, [])).count() == 0


def plain_stats(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    seen, dup = set(), 0
    for line in text.split("\n"):
        if re.search(r"[^\x20\x09-\x0D]", line):
            dup += line in seen
            seen.add(line)
    windows = [tuple(words[i:i + 3]) for i in range(len(words) - 2)]
    inside = {i + k for i, w in enumerate(windows) if windows.count(w) > 1 for k in range(3)}
    return len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text)), dup, len(inside)


def test_base_counts():
    random.seed(1)
    for _ in range(300):
        t = "".join(random.choice("ab é\n#|\x0b\x1c ") for _ in range(random.randint(0, 60)))
        assert quality_rules.text_stats(t.encode())[:5] == plain_stats(t), repr(t)


def brute_mcd(x, share, steps):
    """The same concentration steps on one group, written directly."""
    floor = np.outer(quality_rules.FLOOR, quality_rules.FLOOR)

    def shape(cov):
        values, vectors = np.linalg.eigh(cov / floor)
        values = np.maximum(values, 1)
        return vectors @ np.diag(1 / values) @ vectors.T / floor, np.log(values).sum()

    def moments(rows):
        return rows.mean(0), np.cov(rows.T, bias=True)

    def distance(m, p):
        return np.einsum("ni,ij,nj->n", x - m, p, x - m)

    best = None
    quart = np.quantile(x, [0.25, 0.5, 0.75], axis=0, method="inverted_cdf")
    for m, cov in ((quart[1], np.diag(((quart[2] - quart[0]) / 1.349) ** 2)), moments(x)):
        reach = 0.0
        p, det = shape(cov)
        for _ in range(steps):
            bucket = np.floor(16 * np.log2(np.maximum(distance(m, p), 1e-9)))
            last = np.sort(bucket)[int(np.ceil(share * len(x))) - 1]
            m, cov = moments(x[bucket <= last])
            reach = 2.0 ** ((last + 1) / 16)
            p, det = shape(cov)
        if best is None or det < best[0]:
            best = det, m, p, reach
    _, m, p, reach = best
    q = quality_rules.chi2_quantile(share)
    m, cov = moments(x[distance(m, p * q / max(reach, q)) <= quality_rules.chi2_quantile(0.975)])
    return distance(m, shape(cov)[0])


def test_quality_rules(spark):
    rng = np.random.default_rng(2)
    words = ["".join(rng.choice(list("abcdefgh"), rng.integers(2, 9))) for _ in range(400)]
    rows = [(i, " ".join(rng.choice(words, rng.integers(60, 120))), "en", "s") for i in range(150)]
    rows += [(200 + i, " ".join(w + "%%%" for w in rng.choice(words, 80)), "en", "s") for i in range(12)]
    rows += [(300, None, None, None), (301, "few words", "en", "rare"), (302, "one two three " * 40, "en", "s"), (rows[0][0], rows[0][1], "en", "s")]
    df = spark.createDataFrame([(*r, "k") for r in rows], "doc_id long, text string, lang string, source string, kept string")
    got = quality_rules.quality_rules(df).collect()
    assert len(got) == len(rows)
    assert all(r["kept"] for r in got if r["doc_id"] < 150) and not any(r["kept"] for r in got if r["doc_id"] >= 200)
    x = np.array([[np.log(s[1] / s[0]), np.log(0.01 + s[2] / s[0]), np.log(0.05 + s[3] / s[5]), np.log(0.05 + s[4] / s[0])] for r in rows if r[1]
                  for s in [quality_rules.text_stats(r[1].encode())] if s[0] >= 50 and 100 * s[4] <= 50 * s[0]])
    want = brute_mcd(x, quality_rules.SHARE, quality_rules.STEPS)
    have = [r["distance"] for r in got if not r["base_failed"]]
    assert np.allclose(np.sort(want), np.sort(have), rtol=0.02)
    assert quality_rules.quality_rules(df.limit(0)).count() == 0
    assert all(r["distance"] is None for r in quality_rules.quality_rules(df.limit(20)).collect())


def test_each_statistic_rejects(spark):
    """A text that is odd in one statistic only is rejected, in a group whose centre has no repeats."""
    rng = np.random.default_rng(3)
    some = lambda n, size=5: ["".join(rng.choice(list("abcdefghijklm"), rng.integers(size - 2, size + 3))) for _ in range(n)]
    lines = lambda n: [" ".join(some(9)) for _ in range(n)]
    rows = [(i, "\n".join(lines(12))) for i in range(150)]
    rows += [(200, "\n".join(" ".join(some(9, 15)) for _ in range(12))), (201, "\n".join(line.replace(" ", " # ") for line in lines(12))), (202, "\n".join(x for line in lines(12) for x in (line, "read more"))),
             (203, "\n".join("kab ded fif gog " + " ".join(some(5)) for _ in range(12)))]
    got = {r["doc_id"]: r for r in quality_rules.quality_rules(spark.createDataFrame([(*r, "en", "s") for r in rows], "doc_id long, text string, lang string, source string")).collect()}
    assert not any(r["base_failed"] for r in got.values()) and (got[202]["n_repeat_words"], got[203]["n_dup_lines"]) == (0, 0)
    assert {i for i, r in got.items() if not r["kept"]} == {200, 201, 202, 203}


def test_licenses(spark):
    mit = licenses.TEMPLATES[2][1]
    edited = mit.replace("free of charge", "at no charge").replace("including without limitation", "including")
    texts = [None, "", "x " * 40 + "All rights reserved. cc-by CC by! General  Public\nLicense all rights, reserved", "filler words " + mit + " more", "a b " + edited, "Released under the MIT License.", "cc", "all rights",
             "Released under the MIT License.", "word " * 30_000 + "General public license"]
    df = spark.createDataFrame([(i % 8, t, "z") for i, t in enumerate(texts)], "doc_id long, text string, labels string")
    got = sorted(licenses.scan_licenses(df).collect(), key=lambda r: (r["doc_id"], r["n_words"]))
    assert len(got) == len(texts)

    def base(text):
        words = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
        at = [(i, label) for label, p in licenses.PHRASES for i in range(len(words)) if words[i:i + len(p.split())] == p.split()]
        return len(words), len(at), min([i for i, _ in at], default=None), max([i for i, _ in at], default=None), ",".join(sorted({x for _, x in at}))

    want = sorted([(i % 8, *base(t)) for i, t in enumerate(texts)], key=lambda r: (r[0], r[1]))
    assert [(r["doc_id"], r["n_words"], r["n_base"], r["first_word"], r["last_word"], r["base_labels"]) for r in got] == want
    by_text = {r["doc_id"]: r for r in got}
    assert by_text[3]["labels"] == "mit" and by_text[3]["score"] == 1.0 and by_text[3]["spans"][-1]["first_word"] == 2
    assert by_text[4]["labels"] == "mit" and 0.75 <= by_text[4]["score"] < 1.0
    assert by_text[5]["labels"] == "mit" and by_text[6]["labels"] == "" and by_text[6]["score"] == 0.0
    assert licenses.scan_licenses(df.limit(0)).count() == 0


def plain_rule(url):
    if url is None or "://" not in url:
        return "", "", None
    rest = url.split("://", 1)[1]
    host = re.split(r"[/?#]", rest)[0]
    path = re.split(r"[?#]", rest[len(host):])[0]
    host = re.sub("[A-Z]", lambda m: m[0].lower(), host)
    fits = [r for _, r in url_filter.RULES if (host == r.partition("/")[0] or host.endswith("." + r.partition("/")[0])) and path.startswith("/" + r.partition("/")[2])]
    return host, path, max(fits, key=len, default=None)


def test_url_filter(spark):
    urls = [None, "", "no scheme", "http://", "HTTP://A.Example.ORG/es/1?x=://y", "https://example.org/en/12#f", "https://example.org/en/2", "http://org/", "http://xorg/", "http://b.org?x=1", "http://Ä.com/de/1", "http://a.com/fr/a b\nc",
            "http://x.net/" + "a/9" * 5000, "http://x.net/q?" + "&".join("a=1" for _ in range(50))] + [f"http://h{i}.com/{'de' if i % 2 else 'fr'}/{i}" for i in range(60)]
    df = spark.createDataFrame([(i, u, "r") for i, u in enumerate(urls + urls[:5])], "page_id long, url string, rule string")
    got = url_filter.url_filter(df).collect()
    assert len(got) == len(urls) + 5
    verdicts = dict((r, v) for v, r in url_filter.RULES)
    for r in got:
        assert (r["host"], r["path"], r["rule"]) == plain_rule(r["url"]), r["url"]
        assert r["verdict"] == (verdicts[r["rule"]] if r["rule"] else "block" if r["score"] >= 0.5 else "allow")
    from pyspark.sql import functions as F

    value = df.filter("page_id = 4").select(*[c.alias(n) for n, c in url_filter.lexical_features(F.col("url"), F.lit("a.example.org"), F.lit("/es/1")).items()]).first()
    chars = urls[4]
    share = np.array([chars.count(c) / len(chars) for c in set(chars)])
    assert value["f_length"] == len(chars) and value["f_depth"] == 2 and value["f_params"] == 1 and abs(value["f_entropy"] + (share * np.log2(share)).sum()) < 1e-9
    assert url_filter.url_filter(df.limit(0)).count() == 0
    assert {r["verdict"] for r in url_filter.url_filter(df.filter("page_id in (0, 2)")).collect()} == {"allow"}


def test_url_filter_keeps_columns_of_any_name(spark):
    names = ["__rule", "__f", "row", "by", "f_length", "suffix", "label", "rows", "x", "y", "probability", "rawPrediction", "URL2", "a.b"]
    df = spark.createDataFrame([(f"http://h{i}.com/{'de' if i % 2 else 'fr'}/{i}", *[f"{n}{i}" for n in names]) for i in range(40)], ["url", *names])
    got = url_filter.url_filter(df)
    assert got.columns == ["url", *names, *url_filter.ADDED]
    rows = got.collect()
    assert len(rows) == 40 and all(r[n] == f"{n}{r['url'].rpartition('/')[2]}" for r in rows for n in names)
    only = url_filter.url_filter(df.select(df["url"].alias("host")), "host")
    assert only.columns == url_filter.ADDED and only.filter("rule IS NOT NULL").count() == 40


def test_url_filter_samples_urls(spark):
    """A url on many rows is one of the sample, not all of it."""
    from pyspark.sql import functions as F

    urls = [f"http://h{i}.com/{'de' if i % 2 else 'fr'}/{'x' * (i % 2 * 20)}{i}" for i in range(40)] + [f"http://k{i}.com/zz/{'x' * (i % 2 * 20)}{i}" for i in range(10)]
    first = spark.createDataFrame([(u,) for u in urls[:40]], "url string").orderBy(F.xxhash64("url")).first()["url"]
    df = spark.createDataFrame([(u,) for u in urls + [first] * 60], "url string")
    got = url_filter.url_filter(df, sample=40).filter("rule is null").collect()
    assert len(got) == 10 and len({r["score"] for r in got}) > 1


def labelled(spark, n=120):
    rng = np.random.default_rng(4)
    words = ["".join(rng.choice(list("abcdefghij"), rng.integers(3, 8))) for _ in range(300)]
    rows = []
    for i in range(n):
        w = rng.choice(words, 40).tolist()
        if i % 3 == 0:
            w[5:5] = ["zorkel" + "".join(rng.choice(list("abc"), 3)), "quibblenut"]
        rows.append((i, " ".join(w), int(i % 3 == 0)))
    docs = spark.createDataFrame([(i, t, "s") for i, t, _ in rows] + [(900, None, "s"), (901, "", "s"), (0, rows[0][1], "s"), (None, rows[3][1], "s"), (902, "zorkelabc " * 20_000, "s")], "doc_id long, text string, score string")
    labels = spark.createDataFrame([(i, y, 1 - y) for i, _, y in rows if i < 90] + [(None, 1, 0), (5, None, None)], "doc_id long, toxic int, quality int")
    return docs, labels, {i: y for i, _, y in rows}


def test_toxicity(spark):
    docs, labels, truth = labelled(spark)
    got = toxicity.score(docs, labels).collect()
    assert len(got) == 125 and all(0 <= r["score"] <= 1 for r in got)
    assert all(r["predicted"] == truth[r["doc_id"]] for r in got if r["doc_id"] in truth)
    by_id = {r["doc_id"]: r for r in got}
    assert by_id[None]["predicted"] == by_id[902]["predicted"] == 1 and by_id[900]["predicted"] == 0 and by_id[900]["score"] == by_id[901]["score"]
    assert by_id[93]["evidence"][0]["label"] == 1
    assert {r["score"] for r in toxicity.score(docs, labels.limit(0)).collect()} == {0.0}
    assert toxicity.score(docs.limit(0), labels).count() == 0
    assert {r["predicted"] for r in toxicity.score(docs, labels.filter("toxic = 1")).collect()} == {1}


def test_toxicity_by_any_layout(spark):
    """Terms come from the counts of the whole sample, however few examples a task has."""
    docs, labels, _ = labelled(spark)
    one, many = ({(r["doc_id"], r["score"]) for r in toxicity.score(docs.repartition(n), labels).collect()} for n in (1, 200))
    assert one == many and len({s for _, s in many}) > 2


def test_toxicity_has_all_terms(spark):
    """Every run with the chi-square counts, so words beyond the first few still find their neighbours."""
    rng = np.random.default_rng(6)
    words = ["".join(rng.choice(list("klmnopqrstuvw"), 10)) for _ in range(80)]
    rows = [(i, " ".join(rng.choice(words, 60)) if i % 2 else "plain text here", i % 2) for i in range(100)]
    docs = spark.createDataFrame([r[:2] for r in rows], "doc_id long, text string")
    keys, index = toxicity.build_index(docs, spark.createDataFrame([(i, y) for i, _, y in rows], "doc_id long, toxic int"))
    runs = lambda t: {key for _, key, inside, _ in toxicity.grams([t.encode()]) for key in key[inside].tolist()}
    held = [runs(t) for _, t, y in rows if y]
    want = {k for k in set().union(*held) if (a := sum(k in h for h in held)) and 100 * a * a * 2500 / (a * (100 - a) * 2500) >= 25}
    assert len(want) > 1500 and len(set(keys.tolist()) & want) >= 0.99 * len(want) and set(keys.tolist()) <= want and index.size == 50


def test_blocks_are_skipped(spark):
    """Labelled texts of many kinds: equal to exhaustive cosines, while most postings are never read."""
    rng = np.random.default_rng(11)
    rows, width = [], 400
    for i in range(3_000):
        kind = i % 40
        terms = np.unique(np.r_[kind * 10 + rng.choice(10, 6), rng.choice(width, 2)])
        rows.append((i, i % 2, 1.0, terms, rng.integers(1, 4, len(terms)).astype(float)))
    index = toxicity.Index(width, rows, rng.uniform(1, 3, width))
    asked = [np.unique(np.r_[(i % 40) * 10 + rng.choice(10, 5), rng.choice(width, 1)]) for i in range(60)]
    read, plain = [], index._keys

    def counted(cuts, live, block, term, q):
        read.append(len(live))
        return plain(cuts, live, block, term, q)

    index._keys = counted
    text, term = np.repeat(np.arange(60), [len(t) for t in asked]), np.concatenate(asked)
    count = rng.integers(1, 4, len(term)).astype(float)
    who, cosine = index.nearest_of(text, term, count, 60)
    dense = np.zeros((index.size, width))
    by_id = {r[0]: r for r in rows}
    for n, i in enumerate(index.ids):
        dense[n, by_id[i][3]] = index.unit(by_id[i][3], by_id[i][4])
    for t in range(60):
        mine = text == t
        every = dense[:, term[mine]] @ index.unit(term[mine], count[mine])
        want = np.sort(every)[::-1][:index.k]
        assert np.allclose(cosine[t], np.where(want > 5e-7, want, 0), atol=2e-6)
        assert np.allclose(every[who[t][who[t] >= 0]], cosine[t][who[t] >= 0], atol=2e-6)
    assert sum(read) < 0.4 * 60 * index.blocks and index.blocks > 40


def test_scores_are_calibrated(spark):
    """Held-out documents: of those scored about s, about s are toxic."""
    from graftline.llm.queries import remainder

    docs, labels = (spark.read.parquet(f"/root/testdata/sf0.01/{t}.parquet") for t in ("documents", "labels"))
    scored = toxicity.score(docs, labels, train=remainder(5) != 0).join(labels.withColumnRenamed("toxic", "truth"), "doc_id").filter((remainder(5) == 0) & F.col("truth").isNotNull()).select("score", "truth").collect()
    s, y = np.array([r["score"] for r in scored]), np.array([r["truth"] for r in scored])
    assert np.mean((s - y) ** 2) < 0.5 * np.mean((y.mean() - y) ** 2) + 0.02
    for low, high in ((0, 0.2), (0.2, 0.8), (0.8, 1.01)):
        mine = (s >= low) & (s < high)
        if mine.sum() >= 5:
            assert abs(s[mine].mean() - y[mine].mean()) < 0.2 + 1 / np.sqrt(mine.sum())


def test_example_texts_are_bounded_by_bytes(spark):
    docs = spark.createDataFrame([(i, "toxic words here " * 50) for i in range(20)], "doc_id long, text string")
    labels = spark.createDataFrame([(i, i % 2) for i in range(20)], "doc_id long, toxic int")
    sample, stands = toxicity.examples(docs, labels, "doc_id", "text", "toxic", 100, F.lit(True), 2_000)
    assert sample.groupBy("label").count().collect() and {r["label"]: r["count"] for r in sample.groupBy("label").count().collect()} == {0: 3, 1: 3} and stands == {0: 10 / 3, 1: 10 / 3}


def test_nearest_is_exact():
    rng = np.random.default_rng(5)
    rows = []
    for i in range(500):
        terms = np.sort(rng.choice(60, rng.integers(0, 8), replace=False))
        rows.append((i, int(rng.integers(0, 2)), 1.0, terms, rng.integers(1, 5, len(terms)).astype(float)))
    index = toxicity.Index(60, rows, rng.uniform(1, 3, 60))
    for _ in range(50):
        terms = np.sort(rng.choice(60, rng.integers(1, 8), replace=False))
        counts = rng.integers(1, 5, len(terms)).astype(float)
        q = index.unit(terms, counts)
        every = np.array([q @ np.bincount(r[3], weights=index.unit(r[3], r[4]), minlength=60)[terms] for r in rows if len(r[3])])
        _, cosine = index.nearest(terms, counts)
        want = np.sort(every[every > 5e-7])[::-1][:index.k]
        assert np.allclose(cosine, want, atol=2e-6)


def test_quality_classifier(spark):
    docs, labels, truth = labelled(spark)
    got = quality_classifier.score(docs, labels).collect()
    assert len(got) == 125 and all(0 <= r["score"] <= 1 for r in got)
    own = [r["predicted"] == 1 - truth[r["doc_id"]] for r in got if r["doc_id"] is not None and r["doc_id"] < 90]
    assert np.mean(own) > 0.9
    assert {r["score"] for r in quality_classifier.score(docs, labels.limit(0)).collect()} == {0.5}
    assert quality_classifier.score(docs.limit(0), labels).count() == 0
    assert len({r["score"] for r in quality_classifier.score(docs, labels.filter("quality = 1")).collect()}) == 1


def test_one_text_of_an_id(spark):
    """However many rows an id has, the fits see one of them."""
    docs = spark.createDataFrame([(1, f"text {i % 5}") for i in range(500)] + [(2, "other"), (3, None)], "doc_id long, text string")
    labels = spark.createDataFrame([(1, 1, 1), (2, 0, 0), (3, 0, 0)], "doc_id long, toxic int, quality int")
    sample, stands = toxicity.examples(docs, labels, "doc_id", "text", "toxic", 10, F.lit(True))
    assert sorted((r["id"], r["label"]) for r in sample.collect()) == [(1, 1), (2, 0), (3, 0)] and stands == {0: 1.0, 1: 1.0}
    one = docs.filter("doc_id > 1").unionByName(sample.filter("id = 1").select(F.col("id").alias("doc_id"), "text"))
    assert quality_classifier.train_machine(docs, labels).bias == quality_classifier.train_machine(one, labels).bias


def test_pairwise_sum():
    """The linear-time score equals the sum over all pairs of features."""
    data = [b"one two two three | !!", b"", b"four " * 50]
    m = quality_classifier.fit([b"good words here now", b"BAD!!! BAD!!! BAD!!!", b"other good text", b"BAD BAD !!!"] * 5, np.array([1.0, 0, 1, 0] * 5))
    text, f, x = m.inputs(data)
    for i, s in enumerate(m.score(data)):
        own = np.flatnonzero(text == i)
        pairs = sum(float(m.factors[f[a]].astype(float) @ m.factors[f[b]].astype(float)) * x[a] * x[b] for a in own for b in own if a < b)
        raw = m.bias + (m.linear[f[own]] * x[own]).sum() + pairs
        assert abs(1 / (1 + np.exp(-raw)) - s) < 1e-4
