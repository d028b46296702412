"""Each operator against a plain version on a small table with every odd case."""

import hashlib
import math
import re
import zlib
from collections import Counter

import numpy as np
import pytest
import tiktoken
import xxhash
from pyspark.sql import functions as F

import corpus_pipeline
import public_tokenizers as P
from loomspace.llm import bpe, common, components, exact_dedup, html_extract, langid, license_scan, lm, media, mixing, simhash, toxicity

LOREM = "the quick brown fox jumps over the lazy dog and then some more words come to make this a longer text of its own"
ROWS = [
    (1, LOREM, "en", "a"), (2, LOREM.upper(), "en", "b"), (3, LOREM + " end", "en", "a"), (4, None, None, None), (5, "", "en", "a"), (6, " \t\n", "de", "b"), (7, "word", "de", "c"), (8, "two words", None, None),
    (9, "É ß straße naïve 日本語 😀", "de", "a"), (10, "aaaa" * 3000 + " tail", "fr", "a"), (11, "x y z " * 4000, "fr", "b"), (12, LOREM, "en", "a"), (12, LOREM, "en", "a"), (13, "idiot " + LOREM, "en", "c"), (None, LOREM, "en", "c"),
    (14, "Released under the MIT License. " + LOREM, "en", "a"), (15, "<|endoftext|> it's 123\r\n\r\n  x", "en", "b"), (16, "null\x00byte", "es", "b"),
]
SCHEMA = "doc_id long, text string, lang string, source string, size long, h string, bucket long, n_chars long"


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame([(*r, 5, "h", 7, len(r[1] or "")) for r in ROWS], SCHEMA).repartition(3).cache()


@pytest.fixture(scope="module")
def empty(docs):
    return docs.where("doc_id = -5")


def words(t):
    return re.findall(r"[^\x20\x09-\x0D]+", t or "")


def fold_az(t):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in t or "")


def test_exact(docs, empty):
    got = exact_dedup.classify(docs, bucket_bytes=4000).collect()
    by = {}
    for r in ROWS:
        by.setdefault(fold_az(r[1]), []).append(r[0])
    want = sorted((str(i), max(x for x in ids if x is not None), len(ids), hashlib.sha256(t.encode()).hexdigest()) for t, ids in by.items() for i in ids)
    assert sorted((str(r.doc_id), r.keep_id, r.group_size, r.text_sha256) for r in got) == want
    assert all(r.kept == (r.doc_id == r.keep_id) for r in got)
    kept = exact_dedup.keep_one(docs)
    assert kept.columns == docs.columns and sorted(r.doc_id for r in kept.collect()) == sorted(max(x for x in ids if x is not None) for ids in by.values())
    assert exact_dedup.classify(empty).count() == 0 and exact_dedup.keep_one(empty).count() == 0


def test_content_table_compares_contents():
    t = exact_dedup.ContentTable()
    for i in range(3000):
        t.add(0, 7, "", f"t{i % 1500}", i, 1, 1)  # one hash for all
    assert len(t.entries) == 1500 and all(e[5] == 2 and e[4] >= 1500 for e in t.entries)


def plain_fingerprint(t):
    w = words(fold_az(t))
    sh = [" ".join(w[i : i + 3]) for i in range(len(w) - 2)] if len(w) >= 3 else [" ".join(w)] if w else []
    h = [xxhash.xxh64_intdigest(s.encode(), 42) for s in sh]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def roots(fps):
    root = {f: f for f in fps}

    def find(f):
        while root[f] != f:
            f = root[f]
        return f

    for a in fps:
        for b in fps:
            if (a ^ b).bit_count() <= 2:
                x, y = find(a), find(b)
                root[max(x, y)] = min(x, y)
    return {f: find(f) for f in fps}


@pytest.mark.parametrize("crowd", [64, 2])
def test_simhash(docs, empty, crowd):
    got = simhash.classify(docs, crowd=crowd).collect()
    fps = [plain_fingerprint(r[1]) for r in ROWS]
    of, least = roots(sorted(set(fps))), {}
    for r, f in zip(ROWS, fps):
        if r[0] is not None:
            least[of[f]] = min(r[0], least.get(of[f], 10**9))
    assert sorted((str(r.doc_id), r.fingerprint, r.component_id) for r in got) == sorted((str(r[0]), f"{f:016x}", least[of[f]]) for r, f in zip(ROWS, fps))
    assert simhash.classify(empty).count() == 0


@pytest.mark.parametrize("crowd", [64, 3])
def test_links_are_those_of_all_pairs(spark, crowd):
    rng = np.random.default_rng(1)
    centres = rng.integers(0, 1 << 63, 20, dtype=np.uint64)
    fps = {int(c) ^ (1 << int(i)) ^ (1 << int(j)) for c in centres for i, j in rng.integers(0, 64, (15, 2))} | {int(c) for c in centres}
    df = spark.createDataFrame([(simhash._signed(f),) for f in fps], "fp long")
    got = {r.node: r.root for r in components.components(simhash.links(df, crowd=crowd)).collect()}
    want = roots(sorted(fps, key=simhash._signed))
    groups = lambda m: sorted(sorted(k for k in m if m[k] == v) for v in set(m.values()))
    assert groups({simhash._signed(f): got.get(simhash._signed(f), simhash._signed(f)) for f in fps}) == groups({simhash._signed(f): simhash._signed(r) for f, r in want.items()})


def test_long_chain_is_one_component(spark):
    edges = spark.createDataFrame([(i, i + 1) for i in range(300)] + [(500, 501), (7, 7), (None, 3)], "u long, v long")
    got = {r.node: r.root for r in components.components(edges).collect()}
    assert len(got) == 303 and set(got.values()) == {0, 500}


def test_hubs_are_nodes_as_any_other(spark):
    """Two hubs with 40 leaves each, one of them above its leaves, both joined by a chain, and a small group apart."""
    pairs = [(100, 200 + i) for i in range(40)] + [(1000, 300 + i) for i in range(40)] + [(239, 300), (7, 8)]
    got = {r.node: r.root for r in components.components(spark.createDataFrame(pairs, "u long, v long")).collect()}
    nodes = {x for p in pairs for x in p}
    assert got == {x: 7 if x < 100 else 100 for x in nodes}


def test_a_hot_key_joins_as_any_other(spark):
    rows = spark.range(2500).selectExpr("id", "if(id < 2000, 1, id) as key")
    sizes = rows.groupBy("key").count()
    hot = common.hot_keys(sizes, "key", "count")
    assert [r.hot for r in hot.collect()] == [1]
    got = common.salted_join(rows, sizes, "key", hot).collect()
    assert sorted((r.id, r["count"]) for r in got) == [(i, 2000 if i < 2000 else 1) for i in range(2500)]


def test_mixing(docs, empty, spark):
    cat, got = {}, mixing.taken(*mixing.mix(docs, block_words=4, shard_blocks=8)).collect()
    assert len(got) == len(ROWS) and all(r.taken <= 2 * r["size"] for r in got)
    for r in got:
        cat.setdefault(r.source, [0, r.target, r.source_size])[0] += r.taken
    for name, (taken, target, size) in cat.items():
        assert size == sum(len(words(r[1])) for r in ROWS if r[3] == name) and abs(taken - target) <= 8 and target <= 2 * size
    assert sum(c[1] for c in cat.values()) == pytest.approx(1.5 * sum(c[2] for c in cat.values()))
    assert sorted(map(str, mixing.taken(*mixing.mix(docs, block_words=4, shard_blocks=8)).collect())) == sorted(map(str, got))
    assert mixing.taken(*mixing.mix(empty)).count() == 0
    mixed = mixing.mixed_documents(docs, block_words=4)
    assert mixed.columns == docs.columns and abs(sum(len(words(r.text)) for r in mixed.collect()) - sum(c[1] for c in cat.values())) <= 40


def test_targets_and_permutation():
    assert mixing.targets([10, 100, 100], [5, 2, 1]) == pytest.approx([20, 590 / 3, 295 / 3])
    for n in (1, 2, 7, 1000):
        assert sorted(mixing.permuted(np.arange(n), n, 3)) == list(range(n))


def test_bpe(docs, empty):
    ranks = bpe.parse_ranks(open(P.path("byte_bpe_50k.tiktoken")).read())
    enc = tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=ranks, special_tokens={})
    got = bpe.digests(docs, P.path("byte_bpe_50k.tiktoken"), P.PATTERN).collect()
    plain = lambda t: np.array(enc.encode_ordinary(t), dtype="<u4")
    want = sorted((str(i), len(x := plain(t or "")), hashlib.sha256(x.tobytes()).hexdigest(), hashlib.sha256((t or "").encode()).hexdigest()) for i, t, *_ in ROWS)
    assert sorted((str(r[0]), *r[1:]) for r in got) == want
    encoded = bpe.encode(docs, P.path("byte_bpe_50k.tiktoken"), P.PATTERN)
    assert sorted(bytes(r.bytes) for r in bpe.decode(encoded, P.path("byte_bpe_50k.tiktoken")).collect()) == sorted((r[1] or "").encode() for r in ROWS)
    assert bpe.digests(empty, P.path("byte_bpe_50k.tiktoken"), P.PATTERN).count() == 0


def test_replay_is_the_greedy_rule_for_any_ranks():
    rng = np.random.default_rng(2)
    ranks = {bytes([i]): i for i in range(256)}
    letters = b"abc"
    for r in range(256, 300):  # ranks in an order in which parts may come after the whole
        w = bytes(rng.choice(list(letters), rng.integers(2, 6)))
        ranks.setdefault(w, r)
    model = bpe.Ranks(ranks)
    some = [bytes(rng.choice(list(letters), rng.integers(1, 12))) for _ in range(500)]
    assert [np.frombuffer(x, "<u4").tolist() for x in bpe.replay(some, model)] == [model.greedy(w) for w in some]


def test_licenses(spark, docs, empty):
    t = license_scan.notices(spark)
    assert [(r.doc_id, r.template_id, r.containment) for r in license_scan.scan(docs, t).collect()] == [(14, "MIT", 1.0)]
    long = " ".join(f"w{i}" for i in range(60))
    templates = spark.createDataFrame([("long", long), ("short", "two words")], "template_id string, text string")
    texts = [(1, "a " * 33 + long + " b" * 9), (2, " ".join(long.split()[:56])), (3, " ".join(long.split()[:40])), (4, None)]
    got = license_scan.scan(spark.createDataFrame(texts, "doc_id long, text string"), templates).collect()
    assert {(r.doc_id, round(r.containment, 3)) for r in got} == {(1, 1.0), (2, round(52 / 56, 3))}
    assert license_scan.scan(empty, t).count() == 0


def test_license_wordings_and_short_templates(spark):
    texts = [
        "Some prose.\nAll rights reserved.\nMore of it.", "all RIGHTS reserved", "All of the rights were reserved.", "Licensed under the MIT License", "This project is licensed under MIT.", "SPDX-License-Identifier: Apache-2.0",
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.",
        "rights reserved", None, "All", "Available under CC BY-NC 4.0", "He works at MIT under license.",
    ]
    found = {}
    for r in license_scan.scan(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"), license_scan.notices(spark)).collect():
        found.setdefault(r.doc_id, {})[r.template_id.split("/")[0]] = r
    assert {i: set(x) for i, x in found.items() if i != 6} == {0: {"All-rights-reserved"}, 1: {"All-rights-reserved"}, 3: {"MIT"}, 4: {"MIT"}, 5: {"Apache-2.0"}, 10: {"CC-BY-NC-4.0"}}
    assert {"GPL-3.0", "GPL"} <= set(found[6])
    r = found[0]["All-rights-reserved"]
    assert (r.containment, r.first_word, r.n_words) == (1.0, 1, 4)  # the first window of two shingles that has it
    own = spark.createDataFrame([("one", "stop"), ("two", "two words"), ("four", "a b c d"), ("none", "?!")], "template_id string, text string")
    docs = spark.createDataFrame([(1, "please STOP, a b c d e"), (2, "stop"), (3, "words two"), (4, "some two\nwords")], "doc_id long, text string")
    assert sorted((r.doc_id, r.template_id) for r in license_scan.scan(docs, own).collect()) == [(1, "four"), (1, "one"), (2, "one"), (4, "two")]


def test_word_beginnings():
    of = lambda t: set(toxicity.features(t, toxicity.Places(), toxicity.Stems()).tolist())
    # Inflected forms share the places of their beginnings, and two of them in one text one more; order changes none of these.
    assert len(of("grumbling") & of("grumbled")) == 2  # grumb, grumbl
    assert of("") == set() and of("1 2 3") == set() and len(of("abc")) == 1
    both, other = of("grumbling grumbled"), of("grumbled grumbling")
    assert len(both & other) == len(both) - 1
    assert len(both - of("grumbling") - of("grumbled")) == 1 + 2  # the pair of neighbours, and two shared beginnings


def test_toxicity(spark, docs, empty):
    rng = np.random.default_rng(3)
    text = lambda i: " ".join(rng.choice(LOREM.split(), 12)) + (" nasty" if i % 3 == 0 else "")
    many = spark.createDataFrame([(i, text(i)) for i in range(600)], "doc_id long, text string")
    labels = spark.createDataFrame([(i, int(i % 3 == 0)) for i in range(600)] + [(5, None)], "doc_id long, toxic int")
    got = toxicity.classify(many, labels).collect()
    assert all(r.predicted == (r.doc_id % 3 == 0) and r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 5 == 0) for r in got)
    assert {r.score for r in toxicity.classify(docs, labels.limit(0)).collect()} == {0.5}
    assert toxicity.classify(empty, labels).count() == 0
    assert toxicity.classify(docs, labels).count() == len(ROWS)


def test_language(spark, docs, empty):
    rng = np.random.default_rng(4)
    words_of = {"aa": ["bab", "baba", "abba"], "zz": ["zoz", "zozo", "ozzo"]}
    rows = [(i, " ".join(rng.choice(words_of[k], 30)), k) for i in range(200) for k in [("aa", "zz")[i % 2]]]
    got = langid.identify(spark.createDataFrame([*rows, (900, "123 !", "aa"), (901, None, "zz")], "doc_id long, text string, lang string")).collect()
    assert all(r.lang_pred == ("aa", "zz")[r.doc_id % 2] for r in got if r.doc_id < 900) and {r.lang_pred for r in got if r.doc_id >= 900} == {"und"}
    assert langid.identify(empty).count() == 0 and langid.identify(docs).count() == len(ROWS)


def test_network_tables_are_the_network():
    n = langid.Network(["a", "b"])
    x = np.random.default_rng(5).integers(0, 256, (6, langid.WINDOW)).astype(np.uint8)
    e, pooled = n.p["e"][x], []
    for w in langid.WIDTHS:
        m = np.concatenate([e[:, i : langid.WINDOW - w + 1 + i] for i in range(w)], axis=2)
        pooled.append((m @ n.p[f"k{w}"] + n.p[f"b{w}"]).max(axis=1))
    s = np.exp(np.maximum(np.concatenate(pooled, axis=1), 0) @ n.p["u"] + n.p["v"])
    assert np.allclose(langid.probabilities(x, n.tables()), s / s.sum(axis=1, keepdims=True), atol=1e-4)


def test_lm(docs, empty):
    got = {str(r.doc_id): r for r in lm.score(docs, bucket_tokens=300).collect()}
    of = [(str(r[0]), fold_az(r[1]), zlib.crc32(b"" if r[0] is None else str(r[0]).encode()) % 5) for r in ROWS]
    toks = [(i, [*words(t), "\n"], k) for i, t, k in of]
    c = Counter(w for _, t, k in toks if k != 1 for w in t)
    n, v = sum(c.values()), len(c)
    for i, t, k in toks:
        r = got[i]
        base = sum(math.log10((c[w] + 0.5) / (n + 0.5 * (v + 1))) for w in t)
        assert (r.held_out, r.n_tokens, r.n_known, r.train_tokens) == (k == 1, len(t), sum(c[w] > 0 for w in t), n) and r.base_score == pytest.approx(base) and r.score < 0
    assert lm.score(empty).count() == 0


def test_weights_by_expectation_maximisation():
    w = lm.learn_weights(np.array([], dtype=np.int64), np.array([], dtype=np.int64))
    assert np.allclose(w, [0, 0, 1])
    code = (3 * lm.BINS + int(lm._bin(np.array([8.0]))[0])) * lm.BINS  # only the bigram knows these
    assert lm.learn_weights(np.array([code]), np.array([1000]))[3][0] > 0.99


def test_media(docs, empty, spark):
    got = media.documents_as_media(docs).collect()
    assert len(got) == len(ROWS)
    of = {str(r[0]): r[1] or "" for r in ROWS}
    for r in got:
        text = of[str(r.doc_id)]
        b = text.encode()
        p = b.ljust(max(1, -(-len(b) // 64)) * 64, b"\0")
        assert (r.n_bytes, r.payload_bytes, r.payload_sha256, r.tail_crc32) == (len(b), len(p), hashlib.sha256(p).hexdigest(), zlib.crc32(p[-64:]))
        lines = text.split("\n")
        lead, rest = bool(lines[0].split()), sum(bool(x.split()) for x in lines[1:])
        assert (r.pos, r.n_pieces, r.end_pos, r.caption, r.end_caption) == (int(lead), lead + rest + 2, lead + rest + 1, f"{len(b)} bytes", "the end")
        rows = b"".join(b"\0" + p[i : i + 64] for i in range(0, len(p), 64))
        part = lambda kind, data: len(data).to_bytes(4, "big") + kind + data + zlib.crc32(kind + data).to_bytes(4, "big")
        png = b"\x89PNG\r\n\x1a\n" + part(b"IHDR", (64).to_bytes(4, "big") + (len(p) // 64).to_bytes(4, "big") + bytes([8, 0, 0, 0, 0])) + part(b"IDAT", zlib.compress(rows, 1)) + part(b"IEND", b"")
        assert (r.media_bytes, r.media_sha256) == (len(png), hashlib.sha256(png).hexdigest())
        assert r.feature.startswith(f"rows={len(p) // 64};mean={np.frombuffer(p, np.uint8).mean():.4f};std={np.frombuffer(p, np.uint8).std():.4f};")
    assert media.documents_as_media(empty).count() == 0


def test_interleaved_pages_resolve_in_their_order(spark):
    texts = ["one", "two & <more>", ""]
    stored = media.store(spark.createDataFrame([(t,) for t in texts], "text string"))
    digest = [hashlib.sha256(media.payload(t)).hexdigest() for t in texts]
    image = lambda d, caption: f"<figure><img src='sha256:{d}'><figcaption>{caption}</figcaption></figure>"
    pages = [(1, f"<p>A{image(digest[1], 'second')}B</p>{image(digest[0], 'first')}<p>C"), (2, image("f" * 64, "lost")), (3, None), *((10 + i, f"<p>{i}</p>{image(digest[0], 'hot')}") for i in range(200))]
    pieces = media.interleaved(spark.createDataFrame(pages, "page_id long, html string"), "page_id", "html").repartition(3)
    for hot in ([], [(bytearray.fromhex(digest[0]),)]):
        got = media.resolve(pieces, media.read_back(stored), spark.createDataFrame(hot, "hot binary")).collect()
        assert len(got) == 5 + 1 + 400
        first = sorted((r.pos, r.kind, r.text, r.caption, r.payload_sha256) for r in got if r.id == 1)
        assert first == [(0, "text", "A", None, None), (1, "media", None, "second", digest[1]), (2, "text", "B", None, None), (3, "media", None, "first", digest[0]), (4, "text", "C", None, None)]
        assert [(r.pos, r.caption, r.payload_bytes) for r in got if r.id == 2] == [(0, "lost", None)]
        assert all((r.pos, r.payload_bytes) == (1, 64) for r in got if r.id >= 10 and r.kind == "media")


def test_sequences():
    d = "0" * 64
    got = media.sequence(f"<p>One <b>two</b></p><figure><img src='sha256:{d}'><figcaption>A &amp; b</figcaption></figure><script>x</script><img src=y>tail")
    assert [(x["pos"], x["kind"], x["text"], x["digest"], x["caption"]) for x in got] == [(0, "text", "One two", None, None), (1, "media", None, d, "A & b"), (2, "media", None, None, None), (3, "text", "tail", None, None)]
    assert media.sequence("") == []


def test_main_text(spark):
    page = "<body><nav><a href=/>Home</a></nav><div class='cookie-notice'>We use cookies on this site.</div><article><h1>T</h1><p>One  &lt;x&gt;<p>Two<br>three</article><div id=comments><p>Nice one, thanks a lot for it.</p></div><footer>&copy; us</footer>"
    rows = spark.createDataFrame([(1, page), (2, None), (3, ""), (4, "<nav>x</nav>")], "page_id long, html string")
    got = {r.page_id: r.text for r in html_extract.extract(rows).collect()}
    assert got == {1: "T\nOne <x>\nTwo\nthree", 2: "", 3: "", 4: ""}


def test_minimum_cut_is_the_cheapest_labelling():
    rng = np.random.default_rng(6)
    for _ in range(60):
        n = int(rng.integers(1, 8))
        terminal = [tuple(map(int, rng.integers(0, 9, 2))) for _ in range(n)]
        smooth = [(i, j, int(rng.integers(0, 6))) for i in range(n) for j in range(i + 1, n) if rng.random() < 0.5]
        cost = lambda lab: sum(c if x else b for x, (c, b) in zip(lab, terminal)) + sum(w for i, j, w in smooth if lab[i] != lab[j])  # noqa: B023, E731
        best = min(cost([bool(k >> i & 1) for i in range(n)]) for k in range(1 << n))
        assert cost(html_extract.minimum_cut(terminal, smooth)) == best


def test_pipeline(spark, docs, tmp_path):
    rows = docs.where("doc_id is not null")
    rows.write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame([(i, 0, int(i == 13)) for i in range(1, 17)], "doc_id long, quality int, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
    got = corpus_pipeline.run(spark, str(tmp_path))
    assert got.columns == ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"] and got.count() > 0
    assert [k for k, _ in corpus_pipeline.STAGES] == ["toxicity", "exact dedup", "simhash near-dedup", "mixing", "byte bpe"]


def least_of_components(rows):
    """(id, text) of each component's row with the least id, null last; all candidates, as equal ids leave a choice."""
    fps = [plain_fingerprint(t) for _, t in rows]
    of, groups = roots(sorted(set(fps))), {}
    for r, f in zip(rows, fps):
        groups.setdefault(of[f], []).append(r)
    least = lambda g: min((i is None, i or 0) for i, _ in g)
    return [[r for r in g if (r[0] is None, r[0] or 0) == least(g)] for g in groups.values()]


def of_each_one(got, groups):
    left = list(got)
    for g in groups:
        hit = [r for r in left if r in g]
        assert len(hit) == 1, (hit, g)
        left.remove(hit[0])
    assert not left


def odd_ids():
    rng = np.random.default_rng(7)
    own = lambda k: " ".join(f"{k}{w}" for w in rng.permutation(LOREM.split()))
    rows = [(None if k % 3 == 0 else 40 + k % 4, own(f"v{k}x")) for k in range(24)]  # null and shared ids, texts of their own
    copy = " ".join(f"c{i}" for i in range(400))
    rows += [(44, copy), (44, copy), (None, copy), (45, copy + " end"), (None, copy + " end")]  # copies and near copies of one id, and without one
    null = " ".join(f"n{i}" for i in range(400))
    return rows + [(None, null), (None, null + " end"), (None, null.upper())]


def test_keep_one_of_null_and_repeated_ids(spark):
    rows = odd_ids()
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    assert plain_fingerprint(rows[24][1]) != plain_fingerprint(rows[27][1])
    got = simhash.keep_one(df)
    groups = least_of_components(rows)
    assert len(groups) == 26 and got.columns == df.columns
    of_each_one(sorted(map(tuple, got.collect()), key=str), groups)
    assert simhash.keep_one(df.where("false")).count() == 0


def test_pipeline_by_brute_force_with_null_and_repeated_ids(spark, tmp_path, monkeypatch):
    rows = [(i, t, "en", "ab"[k % 2] if k % 5 else None) for k, (i, t) in enumerate(odd_ids())]
    rows += [(100 + k, f"{LOREM} t{k} " + ("nasty " * 3 if k % 2 else ""), "en", "a") for k in range(60)] + [(None, LOREM + " nasty nasty nasty", "en", "b"), (40, "nasty nasty nasty " + LOREM, "en", "b")]
    spark.createDataFrame([(*r, 5, "h", 7, len(r[1])) for r in rows], SCHEMA).repartition(3).write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame([(100 + k, 0, k % 2) for k in range(60)], "doc_id long, quality int, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
    monkeypatch.setattr(corpus_pipeline, "shared_folder", lambda _: str(tmp_path / "stages"))
    result = corpus_pipeline.run(spark, str(tmp_path)).collect()
    (folder,) = (tmp_path / "stages").iterdir()
    stage = lambda k: [tuple(r) for r in spark.read.parquet(str(folder / str(k))).select("doc_id", "text", "source", "n_chars").collect()]
    clean, unique, apart, mixed = map(stage, range(4))
    assert sorted(map(str, clean)) == sorted(str((i, t, s, len(t))) for i, t, _, s in rows if "nasty" not in t)
    groups = {}
    for r in clean:
        groups.setdefault(fold_az(r[1]), []).append(r)
    greatest = lambda g: max((r[0] is not None, r[0] or 0) for r in g)
    of_each_one(unique, [[r for r in g if (r[0] is not None, r[0] or 0) == greatest(g)] for g in groups.values()])
    of_each_one([r[:2] for r in apart], least_of_components([r[:2] for r in unique]))
    texts = {}
    for _, t, s, _ in apart:
        texts.setdefault(s, []).extend(words(t))
    had = sorted(texts, key=lambda s: (s is None, s or ""))
    want = dict(zip(had, mixing.targets([len(texts[s]) for s in had], [mixing.WEIGHTS[k % len(mixing.WEIGHTS)] for k in range(len(had))], mixing.SHARE, mixing.CAP)))
    took = {s: [w for _, t, x, _ in mixed if x == s for w in words(t)] for s in had}
    assert {s for _, _, s, _ in mixed} <= set(had) and all(n == len(t) for _, t, _, n in mixed)
    for s in had:
        assert abs(len(took[s]) - want[s]) <= mixing.BLOCK_WORDS and set(took[s]) <= set(texts[s])
        assert max(Counter(took[s]).values()) <= 2 * max(Counter(texts[s]).values())
    enc = tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=bpe.parse_ranks(open(P.path("byte_bpe_50k.tiktoken")).read()), special_tokens={})
    plain = lambda t: np.array(enc.encode_ordinary(t), dtype="<u4")
    assert sorted((str(r.doc_id), r.n_tokens, r.ids_sha256, r.decoded_sha256) for r in result) == sorted((str(i), len(x := plain(t)), hashlib.sha256(x.tobytes()).hexdigest(), hashlib.sha256(t.encode()).hexdigest()) for i, t, _, _ in mixed)
