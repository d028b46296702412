"""Operators without SQL against plain versions of their results."""

import hashlib
import math
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from loomspace.llm import html_extract, langid, license_scan, lm, mixing, simhash, toxicity
from loomspace.llm.license_texts import whole


def words(t):
    return re.findall(r"[^\x20\x09-\x0D]+", t or "")


def test_mix_is_the_same_under_any_partitioning(spark):
    rng = np.random.default_rng(1)
    rows = [(i if i % 7 else None, " ".join(f"w{x}" for x in rng.integers(0, 50, rng.integers(0, 30))), "ab"[i % 3 > 0]) for i in range(14_000)]
    rows += [(5, "the very same row", "a")] * 3000 + [(6, None, None), (7, "tiny one", "c"), (8, "x " * 50, "d")]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string")
    one, two = (sorted(map(str, mixing.taken(*mixing.mix(df.repartition(n))).collect())) for n in (2, 9))
    assert one == two
    got = mixing.taken(*mixing.mix(df.repartition(5, "text"))).collect()
    assert sorted((str(r.doc_id), r.source or "", r["size"]) for r in got) == sorted((str(i), s or "", len(words(t))) for i, t, s in rows)
    sizes = {s: sum(len(words(t)) for _, t, x in rows if x == s) for s in ("a", "b", "c", "d", None)}
    want = dict(zip(sizes, mixing.targets(list(sizes.values()), [5, 2, 1, 5, 2], 1.5, 2.0)))
    took = defaultdict(int)
    for r in got:
        assert r.taken <= 2 * r["size"] and r.source_size == sizes[r.source] and r.target == pytest.approx(want[r.source])
        took[r.source] += r.taken
    assert all(abs(took[s] - want[s]) <= mixing.BLOCK_WORDS for s in sizes) and took["c"] == round(want["c"]) and took["d"] == round(want["d"])


def test_names_of_other_columns_never_clash(spark):
    names = ["y", "id", "row", "sha", "keep_id", "n", "h", "size", "copy", "salt", "hot", "bucket", "text_sha256", "o", "__sha", "__id", "epoch", "parts", "body"]
    rows = [(i, f"some words of text {i % 5} " * 5, "en", "a", 7, *range(len(names))) for i in range(20)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long, " + ", ".join(f"{n} long" for n in names))
    labels = spark.createDataFrame([(i, i % 2, 3) for i in range(20)], "doc_id long, toxic int, y int")
    from loomspace.llm import exact_dedup, media

    assert toxicity.classify(df, labels).count() == 20
    assert exact_dedup.keep_one(df).columns == df.columns and exact_dedup.keep_one(df).count() == 5 and exact_dedup.classify(df).count() == 20
    assert simhash.keep_one(df).columns == df.columns and simhash.classify(df).count() == 20
    mixed = mixing.mixed_documents(df)
    assert mixed.columns == df.columns and mixed.count() > 0
    assert media.documents_as_media(df).count() == 20 and langid.identify(df).count() == 20 and lm.score(df).count() == 20


def test_whole_licenses_are_found_in_altered_copies(spark):
    """Recall against the exact share of a template's shingles in the best of all windows."""
    rng = np.random.default_rng(2)
    flat = lambda t: [w for w in re.sub(r"[\W_]+", " ", t.lower()).split()]
    texts = {k: flat(t) for k, t in whole().items() if k.split("/")[0] in ("MIT", "BSD-3-Clause", "ISC", "Zlib", "Apache-2.0", "GPL-2")}
    docs, exact = [], {}
    for k, own in texts.items():
        grams = {tuple(own[i : i + 5]) for i in range(len(own) - 4)}
        step = -(-len(grams) // 4)
        for rate in (0, 0.01, 0.02, 0.035, 0.06, 0.2):
            copy = [w if rng.random() >= rate else f"x{rng.integers(99)}" for w in own]
            text = [f"p{x}" for x in rng.integers(0, 900, rng.integers(0, 200))] + copy + [f"q{x}" for x in rng.integers(0, 900, 80)]
            every = [tuple(text[i : i + 5]) for i in range(len(text) - 4)]
            best = max(len(grams & set(every[i : i + len(grams) + step])) for i in range(0, max(1, len(every)), step)) / len(grams)
            exact[len(docs), k] = best
            docs.append((len(docs), " ".join(text)))
    got = {(r.doc_id, r.template_id): r.containment for r in license_scan.scan(spark.createDataFrame(docs, "doc_id long, text string"), license_scan.notices(spark)).collect()}
    want = {x for x, c in exact.items() if c >= license_scan.SHARE}
    found = {x for x in exact if x in got}
    assert len(want) >= 15 and found <= want and len(found) / len(want) >= 0.9
    assert all(got[x] == pytest.approx(exact[x]) for x in found)


def test_fit_is_plain_ftrl_proximal():
    rng = np.random.default_rng(3)
    rows = [(np.unique(rng.integers(0, 40, 6)).astype(np.int32), int(rng.random() < 0.4)) for _ in range(120)]
    alpha, beta, l1, l2 = 1.0, 1.0, 0.4, 0.5
    bias, at, w = toxicity.fit(rows, bits=6, epochs=3, alpha=alpha, beta=beta, l1=l1, l2=l2, seed=3)
    z, n, order = Counter(), Counter(), np.random.default_rng(3)

    def weight(i):
        if i != "bias" and abs(z[i]) <= l1:
            return 0.0
        shrunk = z[i] if i == "bias" else z[i] - math.copysign(l1, z[i])
        return -shrunk / ((beta + math.sqrt(n[i])) / alpha + l2)

    for _ in range(3):
        for k in order.permutation(len(rows)):
            places = [*rows[k][0].tolist(), "bias"]
            now = {i: weight(i) for i in places}
            g = 1 / (1 + math.exp(-sum(now.values()))) - rows[k][1]
            for i in places:
                z[i] += g - (math.sqrt(n[i] + g * g) - math.sqrt(n[i])) / alpha * now[i]
                n[i] += g * g
    assert bias == pytest.approx(weight("bias"), rel=1e-3)
    plain = {i: weight(i) for i in range(64) if weight(i)}
    assert dict(zip(at.tolist(), w.tolist())) == pytest.approx(plain, rel=1e-2, abs=1e-4)


def test_toxicity_result_is_that_of_its_model(spark):
    rng = np.random.default_rng(4)
    text = lambda i: " ".join(rng.choice("a few plain words that come in any order at all".split(), 9)) + (" vile" if i % 4 == 0 else "")
    rows = [(i, text(i)) for i in range(300)] + [(None, None), (4, text(1)), (4, text(1))]
    docs, labels = spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame([(i, int(i % 4 == 0)) for i in range(0, 300, 2)], "doc_id long, toxic int")
    fold = lambda i: zlib.crc32(str(i).encode()) % 5 if i is not None else 0
    model = {r.place: r.weight for r in toxicity.train(docs, labels, learn=lambda c: F.crc32(F.col(c).cast("string").cast("binary")) % 5 != 0).collect()}
    plain = Counter()
    for i, t in rows:
        f = set(toxicity.features(t or "", toxicity.Places(), toxicity.Stems()).tolist())
        plain[i, round(1 / (1 + math.exp(-(model[-1] + sum(model.get(x, 0.0) for x in f)))), 5), fold(i) == 0] += 1
    assert Counter((r.doc_id, round(r.score, 5), r.held_out) for r in toxicity.classify(docs, labels).collect()) == plain
    assert all(r.predicted == (r.score >= 0.5) for r in toxicity.classify(docs, labels).collect())


def test_fit_reads_rows_up_to_its_bound(spark):
    docs = spark.range(3000).select(F.lit(1).cast("long").alias("doc_id"), F.concat(F.lit("word "), (F.col("id") % 1500).cast("string")).alias("text"))
    labels = spark.createDataFrame([(1, 1)], "doc_id long, toxic int")
    assert [toxicity.training_rows(docs, labels, max_train_rows=n).count() for n in (100, 100_000)] == [100, 1500]


def test_scores_are_plain_deleted_interpolation(spark):
    rng = np.random.default_rng(5)
    vocabulary = [f"w{i}" for i in range(30)]
    rows = [(i, " ".join(vocabulary[min(29, int(x))] for x in rng.exponential(6, rng.integers(0, 25)))) for i in range(120)]
    rows += [(3, rows[3][1]), (None, "w1 W2 strange"), (200, None), (201, "")]
    got = Counter((str(r.doc_id), r.n_tokens, round(r.score, 5)) for r in lm.score(spark.createDataFrame(rows, "doc_id long, text string").repartition(3), bucket_tokens=200).collect())
    kind = lambda i: zlib.crc32(b"" if i is None else str(i).encode()) % 5
    texts = [(i, [*words((t or "").lower()), None], kind(i)) for i, t in rows]  # None: the end

    def counts(kinds):
        one, two = Counter(), Counter()
        for _, t, k in texts:
            if k in kinds:
                one.update(t)
                two.update(zip(["begin", *t[:-1]], t))
        return one, two

    def estimates(a, b, one, two):
        context = one[None] if a == "begin" else one[a]
        return (two[a, b] / context if context else 0.0), one[b] / sum(one.values()), (1 + int(math.log2(context)) if context else 0)

    seen, every = counts({0, 3, 4}), counts({0, 2, 3, 4})
    v = len(every[0])
    half = lambda x: 2.0 ** (round(2 * math.log2(x * (v + 1))) / 2) if x > 0 else 0.0
    events = defaultdict(list)
    for _, t, k in texts:
        if k == 2:
            for a, b in zip(["begin", *t[:-1]], t):
                two, one, bucket = estimates(a, b, *seen)
                events[bucket].append((half(two), half(one), 1.0))

    def learned(some):
        w = [1 / 3] * 3
        for _ in range(60):
            sums = [1e-3] * 3
            for e in some:
                total = sum(x * y for x, y in zip(w, e))
                sums = [s + x * y / total for s, x, y in zip(sums, w, e)]
            w = [s / sum(sums) for s in sums]
        return w

    weights = {k: learned(e) for k, e in events.items()}
    others = learned([e for some in events.values() for e in some])

    def score(t):
        total = 0.0
        for a, b in zip(["begin", *t[:-1]], t):
            two, one, bucket = estimates(a, b, *every)
            w = weights.get(bucket, others)
            total += math.log10(w[0] * two + w[1] * one + w[2] / (v + 1))
        return total

    plain = Counter((str(i), len(t), round(score(t), 5)) for i, t, _ in texts)
    near = lambda c: sorted((i, n, s) for (i, n, s), k in c.items() for _ in range(k))
    for x, y in zip(near(got), near(plain)):
        assert x[:2] == y[:2] and x[2] == pytest.approx(y[2], abs=2e-4)


BEFORE = [
    "<header class='site-header'><a href='/'>Home</a> <a href='/a'>About us</a></header>", "<nav><ul><li><a href='/1'>One</a></li><li><a href='/2'>Two</a></li></ul></nav>", "<div class='cookie-notice'>We use cookies to improve this site. <button>Accept</button></div>",
    "<aside class='sidebar'><h3>Related</h3><ul><li><a href='/x'>Another story here</a></li></ul></aside>", "<div class='ad-banner'>Buy now and save a lot of money today!</div>", "<form action='/s'><label>Search</label><input name=q><button>Go</button></form>", "<script>var x = '<p>not text</p>';</script><style>p { color: red }</style>",
]
AFTER = [
    "<section id='comments'><h3>Comments</h3><div class='comment'><p>I read this twice and liked it very much.</p></div></section>", "<footer><p>&copy; 2024 Some Company. All rights reserved.</p><a href='/t'>Terms</a></footer>", "<div class='newsletter'><form><p>Sign up for our newsletter</p><input></form></div>", "<!-- <p>hidden</p> --><noscript>Turn on scripts</noscript>",
]


def test_articles_among_what_surrounds_them(spark):
    rng = np.random.default_rng(6)
    pages, want = [], {}
    for k in range(40):
        blocks = [f"Title number {k}", *(" ".join(rng.choice("the river runs past the old mill and on to the sea where boats wait for the tide".split(), rng.integers(8, 40))) for _ in range(rng.integers(2, 6)))]
        blocks[1] += " a &amp; b"
        body = f"<article><h1>{blocks[0]}</h1>" + "".join(f"<p>{b[: len(b) // 2]}<em>{b[len(b) // 2 :]}</em></p>" if i % 2 else f"<p>\n  {b.replace(' ', '   ', 1)}\n</p>" for i, b in enumerate(blocks[1:], 1)) + "</article>"
        pick = lambda x: "".join(x[i] for i in sorted(rng.permutation(len(x))[: rng.integers(1, len(x) + 1)]))
        pages.append((k, f"<!doctype html><html><head><title>T</title></head><body>{pick(BEFORE)}<main>{body}</main>{pick(AFTER)}</body></html>"))
        want[k] = "\n".join(b.replace("&amp;", "&") for b in blocks)
    pages += [(0, pages[0][1]), (100, None)]
    df = spark.createDataFrame(pages, "page_id long, html string")
    got = [(r.page_id, r.text) for r in html_extract.extract(df).collect()]
    assert sorted(got) == sorted([(k, want[k]) for k in want] + [(0, want[0]), (100, "")])
    assert html_extract.extract(df.where("false")).count() == 0


def test_predictions_are_those_of_the_network(spark):
    rng = np.random.default_rng(7)
    words_of = {"aa": ["bab", "baba", "abba"], "zz": ["zoz", "zozo", "ozzo"]}
    rows = [(i, " ".join(rng.choice(words_of[k], rng.integers(1, 300))), k) for i in range(80) for k in [("aa", "zz")[i % 2]]] + [(90, "\u00df", "aa"), (91, None, "aa"), (90, "7 7", None)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    model = langid.train(df)
    import pickle

    tables = pickle.loads(model)
    plain = []
    for i, t, _ in rows:
        if not t or not re.search(r"[^\W\d_]", t):
            plain.append((i, "und", 0.0))
            continue
        b = t.encode()
        p = np.mean([langid.probabilities(np.frombuffer(b[a : a + langid.WINDOW].ljust(langid.WINDOW, b"\0"), np.uint8)[None], tables)[0] for a in range(0, len(b), langid.WINDOW)], axis=0)
        plain.append((i, tables[3][int(p.argmax())], round(float(p.max()), 4)))
    got = [(r.doc_id, r.lang_pred, round(r.score, 4)) for r in langid.predict(df, model).collect()]
    for x, y in zip(sorted(got, key=str), sorted(plain, key=str)):
        assert x[:2] == y[:2] and x[2] == pytest.approx(y[2], abs=2e-4)


def test_pipeline_of_empty_tables(spark, tmp_path):
    spark.createDataFrame([], "doc_id long, text string, lang string, source string, n_chars long").write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame([], "doc_id long, quality int, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0
