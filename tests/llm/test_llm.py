"""Operators against SQL, brute force and held-out labels; nulls, ties, repeated rows, clashing names, empty tables."""

import hashlib
import random
import re
import zlib

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from hyperweave.llm import common, components, jaccard_join, language_id, license_scan, mixing, multi_index, packing, pii, quality_gam, quality_rules, queries, textkernel, url_filter

SF = "/root/testdata/sf0.001"
DOCS = "doc_id long, text string, lang string, source string, n_chars long, token string, score int, `__score` int, copy int, shingle long"
LONG = " ".join(f"w{i}" for i in range(60_000))
BASE = "one two three four five six seven eight nine ten eleven twelve thirteen fourteen fifteen sixteen seventeen eighteen nineteen twenty"


def vocabulary():
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


@pytest.fixture(scope="module")
def odd(spark):
    """Nulls in every column, empty, blank and very long texts, repeated rows, columns whose names operators use."""
    texts = [None, "", " \n\t ", "a", "Une É_x 9²! áb it's", BASE, BASE.upper(), BASE, LONG, "one two three", "mail a@b.co +12 345 678 901", "end<|endoftext|> of<|startoftext|>it <|ENDOFTEXT|>"]
    rows = [(i, t, "en" if i % 2 else None, "src0" if i % 3 else None, None, "x", 1, 2, 3, 4) for i, t in enumerate(texts)]
    return spark.createDataFrame([*rows, rows[5], rows[5], (None, BASE, None, None, None, None, None, None, None, None)], DOCS)


@pytest.fixture(scope="module")
def labels(spark):
    return spark.createDataFrame([(5, 1, None), (None, 1, 0), (7, None, 0)], "doc_id long, quality int, toxic int")


@pytest.mark.parametrize("name", list(queries.SQL))
def test_query_equals_sql(name, same):
    same(queries.QUERIES[name], queries.SQL[name])


def test_text_stats_by_brute_force():
    rng = random.Random(2)
    texts = [None, "", "\n\n", BASE + "\n" + BASE] + ["".join(rng.choice("ab é\n#*!A1.") for _ in range(rng.randint(0, 120))) for _ in range(200)] + ["x y " * 40]
    got = textkernel.text_stats(pa.array(texts, pa.string()))
    for i, t in enumerate(texts):
        t = t or ""
        w = re.findall(r"[^\x20\x09-\x0D]+", t)
        grams = [tuple(w[j : j + 8]) for j in range(len(w) - 7)]
        repeated = {k for j, g in enumerate(grams) if grams.count(g) > 1 for k in range(j, j + 8)}
        lines = [x for x in t.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
        assert [int(got[k][i]) for k in ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")] == [len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", t)), len(lines) - len(set(lines)), len(repeated)]


def check_packing(pieces, docs):
    from tokenizers import Tokenizer

    tok = Tokenizer.from_file(vocabulary())
    want = [(r.doc_id, [*tok.encode(r.text or "", add_special_tokens=False).ids, 1]) for r in docs.select("doc_id", "text").collect()]
    for doc_id in {i for i, _ in want}:
        all_ids = [ids for i, ids in want if i == doc_id]
        own = [p for p in pieces if p.doc_id == doc_id]
        assert sum(p.length for p in own) == sum(map(len, all_ids))
        for p in own:
            assert any(len(ids) == p.doc_tokens and zlib.crc32(np.array(ids[p.start : p.start + p.length], "<u4").tobytes()) == p.ids_crc32 for ids in all_ids)
    for s in {p.sequence_id for p in pieces}:
        at = 0
        for p in sorted((p for p in pieces if p.sequence_id == s), key=lambda p: p.offset):
            assert p.offset == at
            at += p.length
        assert at <= 2048 and at & (at - 1) == 0  # 2048 or a power of two: no padding


def test_packing_round_trip(spark, odd):
    for docs in (odd, common.table(spark, SF, "documents")):
        check_packing(packing.pack_documents(docs, vocabulary()).collect(), docs)
    assert packing.pack_documents(odd.limit(0), vocabulary()).count() == 0


def test_packing_whole_examples(spark):
    rng = random.Random(1)
    rows = [(i, rng.randint(0, 900), rng.randint(0, 500), rng.randint(1, 4)) for i in range(300)] + [(999, 5000, 10, 1), (None, None, None, None)]
    df = spark.createDataFrame(rows, "key long, tokens long, offset long, segs long")
    got = packing.pack_examples(df, "key", "tokens", "offset", "segs", max_tokens=1000, max_segments=6, max_loss_tokens=400).collect()
    assert len(got) == len(rows)
    by = {}
    for r in got:
        by.setdefault(r.sequence_id, []).append(r)
    for rs in by.values():
        assert len(rs) == 1 or (sum(r.tokens for r in rs) <= 1000 and sum(r.segments for r in rs) <= 6 and sum(r.loss_tokens for r in rs) <= 400)
    assert {r.key for r in got if r.oversized} == {k for k, t, lo, s in rows if k is not None and (t > 1000 or lo > 400)}


def test_poisson_inverse():
    for rate in (0.0, 0.2, 1.0, 37.5, 2000.0):
        k0, steps = mixing.poisson_steps(rate)
        u = np.random.default_rng(0).random(20_000)
        n = k0 + np.searchsorted(steps, u, "right") if steps else np.zeros(len(u))
        assert abs(n.mean() - rate) <= 5 * (rate / len(u)) ** 0.5 and abs(n.var() - rate) <= 0.1 * rate + 1e-9


def test_mixing_edges(spark, odd):
    got = mixing.mix_sources(odd, {"src0": 0.5}, 0.5, target_rows=400)
    assert "_copy" in got.columns and got.count() > 200
    per = got.where("doc_id = 5").groupBy("_copy").count().collect()
    assert {r["count"] for r in per} in ({3}, set())  # repeated rows get equal numbers of copies
    assert mixing.mix_sources(odd.limit(0), {"src0": 1.0}, 1.0).count() == 0


# small units: large families go by blocks; few shingles: so do long texts; hot: frequent shingles are joined back
@pytest.mark.parametrize("unit_docs, pivots, shingles, hot", [(2048, 16, 1 << 20, 4096), (32, 2, 1 << 20, 20), (32, 0, 1 << 20, 4096), (2048, 16, 2000, 20)])
def test_jaccard_by_brute_force(spark, odd, monkeypatch, unit_docs, pivots, shingles, hot):
    for name, value in (("UNIT_DOCS", unit_docs), ("PIVOTS", pivots), ("UNIT_SHINGLES", shingles), ("HOT", hot), ("BLOCK_FLOOR", 2)):
        monkeypatch.setattr(jaccard_join, name, value)
    rng = random.Random(5)
    words = [f"t{i}" for i in range(400)]
    texts = []
    for _ in range(40):
        base = [rng.choice(words) for _ in range(rng.randint(1, 80))]
        for _ in range(rng.randint(1, 6)):
            copy = list(base)
            for _ in range(rng.randint(0, 3)):
                copy[rng.randrange(len(copy))] = rng.choice(words)
            texts.append(" ".join(copy))
    family = [rng.choice(words) for _ in range(120)]
    for i in range(150):  # a large family, linked to its source and not always to one another
        copy = list(family)
        for _ in range(i % 4):
            copy[rng.randrange(len(copy))] = f"u{i}{rng.random()}"
        texts.append(" ".join(copy))
    docs = odd.select("doc_id", "text").unionAll(spark.createDataFrame([(100 + i, t) for i, t in enumerate(texts)], "doc_id long, text string"))
    rows = [(r.doc_id, r.text) for r in docs.collect()]
    got = sorted((repr((r.doc_id, r.n_shingles, r.component_id)) for r in jaccard_join.near_duplicates(docs).collect()))

    def grams(t):
        w = (t or "").encode().lower().split()
        return {tuple(w[j : j + 5]) for j in range(len(w) - 4)} if len(w) >= 5 else {tuple(w)} if w else set()

    sets = {i: grams(t) for i, t in rows if i is not None}
    up = {i: i for i in sets}

    def find(i):
        while up[i] != i:
            i = up[i]
        return i

    for a in sets:
        for b in sets:
            if a < b and sets[a] and 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b]):
                x, y = find(a), find(b)
                up[max(x, y)] = min(x, y)
    assert got == sorted(repr((i, len(grams(t)), None if i is None else find(i))) for i, t in rows)
    assert jaccard_join.near_duplicates(odd.limit(0)).count() == 0
    assert jaccard_join.near_duplicates(odd).count() == odd.count()  # with columns whose names clash


def test_components_of_a_chain(spark):
    chain = spark.createDataFrame([(i, i + 1) for i in range(60)] + [(70, 71), (71, 70), (5, 5), (None, 3)], "a long, b long")
    assert {(r.node, r.component) for r in components.components(chain).collect()} == {(i, 0) for i in range(61)} | {(70, 70), (71, 70)}


def test_url_edges(spark):
    urls = [None, "", "no scheme", "http://ORG", "http://a.ORG/x?y#z", "http://organic.com/fr/", "ftp://x.example.org/es/a?b", "http://com/de/", "http:///fr/", "http://a..org/q", "http://a.net/" + "x" * 100_000, "http://example.org/es/"]
    pages = spark.createDataFrame([*((i, u, "h") for i, u in enumerate(urls)), (11, urls[11], "h"), (None, urls[11], None)], "page_id long, url string, key string")
    rules = spark.createDataFrame([*url_filter.RULES, ("net", "", "block"), ("net", None, "block"), ("", "/", "block"), ("org", "/", "allow")], "host string, path string, verdict string")
    got = url_filter.filter_urls(pages, rules, buckets=3).collect()
    assert len(got) == len(urls) + 2
    want = {0: None, 1: None, 2: None, 3: None, 4: "org/", 5: "com/fr/", 6: "example.org/es/", 7: "com/de/", 8: None, 9: "org/", 10: "net", 11: "example.org/es/", None: "example.org/es/"}
    assert {r.page_id: r.rule for r in got} == want
    assert url_filter.filter_urls(pages.limit(0), rules).count() == 0
    assert {r.verdict for r in url_filter.filter_urls(pages, rules.limit(0)).collect()} == {"allow"}


def test_language_held_out_and_edges(spark, odd):
    got = language_id.op5_language_id(spark, "/root/testdata/sf0.01").join(common.table(spark, "/root/testdata/sf0.01", "documents").select("doc_id", "lang"), "doc_id").where("held_out").toPandas()
    assert (got.lang == got.lang_pred).mean() > 0.97
    model = language_id.fit({"aa": ["abab abab"], "bb": ["cdcd cdcd"]})
    rows = language_id.identify(odd, model).collect()
    assert len(rows) == odd.count() and all(0 <= r.score <= 1 for r in rows)
    assert {r.lang_pred for r in rows if r.doc_id in (0, 1, 2)} == {"und"}
    assert {r.lang_pred for r in language_id.identify(odd, language_id.fit({})).collect()} == {"und"}
    text = "abab xé cdc"
    numbers, offsets = language_id.letters_of(pa.array([text, None, "..cd."]), model.codes)
    # phrases by hand: in aa "abab ", x, é, " ", c, d, c; in bb a, b, a, b, " ", x, é, " cdc" after one for the unseen pair
    number = lambda c: chr(65 + (model.codes[ord(c)] if ord(c) < len(model.codes) else 1))
    sample = {k: "".join(map(number, t)) for k, t in (("aa", "abab abab"), ("bb", "cdcd cdcd"))}
    coded = "".join(map(number, text))
    for k, lang in enumerate(model.languages):
        i = n = 0
        while i < len(coded):
            j = i + 1
            while j <= len(coded) and coded[i:j] in sample[lang]:
                j += 1
            i, n = max(i + 1, j - 1), n + 1
        assert language_id.count_phrases(model, numbers, offsets)[0, k] == n


def test_license_edges(spark, odd):
    assert license_scan.scan_licenses(odd, list(license_scan.TEMPLATES)).count() == 0  # with columns whose names clash
    docs = odd.select("doc_id", "text").unionAll(spark.createDataFrame([(50, "x " * 99 + "released UNDER the mit license!"), (51, "Released under the MIT"), (None, "Released under the MIT License.")], "doc_id long, text string"))
    assert {(r.doc_id, r.license) for r in license_scan.scan_licenses(docs, list(license_scan.TEMPLATES)).collect()} == {(50, "MIT"), (None, "MIT")}
    assert license_scan.scan_licenses(docs.limit(0), list(license_scan.TEMPLATES)).count() == 0
    with pytest.raises(ValueError):
        license_scan.scan_licenses(docs, [("short", "only four words here")]).count()


def test_quality_operators(spark, odd, labels):
    d = "/root/testdata/sf0.01"
    truth = common.table(spark, d, "labels")
    rules = quality_rules.op7_quality_rules(spark, d).join(truth, "doc_id").toPandas()
    open_ = rules[~rules.base_failed]
    assert (open_.kept == (open_.quality == 1)).mean() > 0.95
    gam = quality_gam.op9_quality_gam(spark, d).join(truth, "doc_id").where("held_out").toPandas()
    assert (gam.predicted == gam.quality).mean() > 0.95 and gam.score.between(0, 1).all()
    assert quality_rules.quality_rules(odd, labels).count() == odd.count()
    assert quality_gam.quality_filter(odd, labels).columns == odd.columns
    assert quality_gam.quality_filter(odd.limit(0), labels.limit(0)).count() == 0
    assert quality_rules.quality_rules(odd.limit(0), labels.limit(0)).count() == 0


def brute_spans(t):
    out = [("email", m.start(), m.end()) for m in re.finditer(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", t)]
    out += [("ip", m.start(), m.end()) for m in re.finditer(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", t) if all(int(x) <= 255 for x in m[0].split("."))]
    for m in re.finditer(r"[0-9]([\x20-]?[0-9])+", t):
        digits = re.sub("[^0-9]", "", m[0])
        if 13 <= len(digits) <= 19 and pii.luhn(digits):
            out.append(("card", m.start(), m.end()))
    return out + [("phone", m.start(), m.end()) for m in re.finditer(r"\+[0-9][\x20().0-9-]+[0-9]", t) if 9 <= len(re.sub("[^0-9]", "", m[0])) <= 15]


def test_pii_base_by_brute_force(spark, odd):
    rng = random.Random(3)
    for _ in range(5000):
        t = "".join(rng.choice(["a", "é", "@", ".", "-", "+", " ", "0", "12", "(", "4111 1111 1111 1111", "a@b.c", "1.2.3.4", "+12 345 678 901"]) for _ in range(rng.randint(0, 14)))
        assert pii.base_spans(t) == brute_spans(t), t
    got = pii.detect_pii(odd).collect()
    assert len(got) == odd.count()
    (r,) = [r for r in got if r.doc_id == 10]
    assert (r.n_email, r.n_phone) == (1, 1) and r.base_sha256 == hashlib.sha256(b"email:5:11,phone:12:27").hexdigest()
    clean = {r.doc_id: r.text for r in pii.redact_documents(odd).collect()}
    assert clean[10] == "mail [email] [phone]" and clean[0] is None and clean[8] == LONG
    assert pii.detect_pii(odd.limit(0)).count() == 0


def test_neighbours_recall_and_edges(spark):
    rng = np.random.default_rng(0)
    x = rng.normal(size=(3000, 16)).astype(np.float32)
    x[100:400] = x[100]  # a common vector: ties
    rows = [(i, v.tolist()) for i, v in enumerate(x)]
    bad = [(5000, None), (5001, [0.0] * 16), (5002, [float("nan")] * 16), (5003, [None] * 16), (None, x[0].tolist()), (5050, [1.0]), (0, x[0].tolist())]
    df = spark.createDataFrame(rows + bad, "vec_id long, embedding array<float>")
    got = multi_index.nearest(df, F.col("vec_id") % 50 == 0, shelf_vectors=500).toPandas()
    u = x.astype(float) / np.linalg.norm(x.astype(float), axis=1, keepdims=True)
    hits = 0
    for q, g in got.groupby("query_id"):
        g = g.sort_values("rank")
        assert g["rank"].tolist() == [1, 2, 3, 4, 5] and q not in set(g.vec_id) and not (set(g.vec_id) - set(range(3000)))
        s = u @ u[q]
        s[q] = -9
        assert np.allclose(g.score, s[g.vec_id], atol=1e-9)
        hits += (g.score >= np.sort(s)[-5] - 1e-9).sum()
    assert got.query_id.nunique() == 60 and hits >= 0.9 * 300
    assert multi_index.nearest(df.limit(0), F.col("vec_id") % 50 == 0).count() == 0
    assert multi_index.nearest(df.where("vec_id IN (0, 1)"), F.col("vec_id") == 0).count() == 1


def test_pipeline_stages_by_their_own_input(spark):
    d = "/root/testdata/sf0.001"
    docs = common.table(spark, d, "documents")
    kept = common.materialise(corpus_pipeline.quality(spark, docs, d), "t")
    assert 0 < kept.count() < docs.count() and kept.columns == docs.columns
    one = common.materialise(corpus_pipeline.near_duplicates(spark, kept, d), "t")
    groups = jaccard_join.near_duplicates(kept)
    assert {r.doc_id for r in one.select("doc_id").collect()} == {r.component_id for r in groups.collect()}
    clean = common.materialise(corpus_pipeline.personal_data(spark, one, d), "t")
    assert clean.count() == one.count() and not any(s[0] == "email" for r in clean.collect() for s in brute_spans(r.text))
    mixed = common.materialise(corpus_pipeline.mixing_weights(spark, clean, d), "t")
    assert mixed.columns == docs.columns and {r.doc_id for r in mixed.collect()} <= {r.doc_id for r in clean.collect()}
    check_packing(corpus_pipeline.pack(spark, mixed, d).collect(), mixed)


def test_pii_adds_what_base_patterns_miss(spark):
    rng = random.Random(5)
    n = lambda k: "".join(rng.choice("0123456789") for _ in range(k))
    kinds = [lambda i: f"+{n(2)} {n(3)} {n(3)} {n(3)}", lambda i: f"ann{i}.x@mail{i}.org", lambda i: "4111 1111 1111 1111", lambda i: "4465758382889437", lambda i: f"10.{i % 200}.7.12"]
    docs = spark.createDataFrame([(i, f"words before {kinds[i % 5](i)} and words after") for i in range(600)], "doc_id long, text string")
    model = pii.learn(docs)
    assert model.trees and model.threshold <= 1
    private = ["call (415) 555-1234 today", "phone (415) 555-1234 20240101", "write jane at example dot com now", "my ssn 123-45-6789 here", "account: 12345 is open", "a 4465758382889437 4465758382889437 b"]
    other = ["on 2024-01-15 10:30 we", "pi is 3.14159265 ok", "look at the dot here", "run 12345678 done"]
    wanted = [["(415) 555-1234"], ["(415) 555-1234"], ["jane at example dot com"], ["123-45-6789"], ["12345"], ["4465758382889437"] * 2]
    found = [[t[a:b] for _, a, b in spans] for t, (_, spans) in zip(private + other, pii.find_spans(private + other, model))]
    assert found == [*wanted, [], [], [], []]
    again = pii.learn(docs.repartition(3))
    assert again == model
    redacted = pii.redact_documents(docs.limit(1).selectExpr("doc_id", "'call (415) 555-1234' AS text"), model).first()
    assert redacted.text == "call [other]"
