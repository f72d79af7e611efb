"""Kernels, models and stages against brute force; scale of work; odd rows through the pipeline's stages."""

import random
import re
import time

import duckdb
import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from hyperweave.llm import common, jaccard_join, language_id, labelled, license_scan, multi_index, packing, pii, quality_gam, quality_rules, textkernel, url_filter

SF = "/root/testdata/sf0.001"


@pytest.mark.parametrize("chunk", [1 << 17, 7, 1])  # words, lines and texts go over chunks
def test_all_statistics_by_brute_force(monkeypatch, chunk):
    monkeypatch.setattr(textkernel, "CHUNK_BYTES", chunk)
    rng = random.Random(2)
    texts = [None, "", "\n\n", "", "a\n", "\na", "é" * 50, "x y " * 40, "a\n" * 20] + ["".join(rng.choice("ab é\n#*!A1.-") for _ in range(rng.randint(0, 120))) for _ in range(100)]
    got = textkernel.text_stats(pa.array(texts, pa.string()))
    sets = list(textkernel.shingle_sets(pa.array(texts, pa.string())))
    for i, t in enumerate(texts):
        t = t or ""
        w = re.findall(r"[^\x20\x09-\x0D]+", t)
        grams = [tuple(w[j : j + 8]) for j in range(len(w) - 7)]
        lines = [x for x in t.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
        n = lambda some: sum(c in some for c in t)
        letters, known = sum(c.isascii() and c.isalnum() for c in t), "\x20\x09\x0a\x0b\x0c\x0d#*$%&|<>.!?"
        want = {
            "n_words": len(w), "word_chars": sum(map(len, w)), "n_symbols": n("#*$%&|<>"), "n_dup_lines": len(lines) - len(set(lines)), "n_lines": len(lines),
            "n_repeat_words": len({k for j, g in enumerate(grams) if grams.count(g) > 1 for k in range(j, j + 8)}), "n_distinct_words": len(set(w)), "n_bangs": n("!"), "n_sentence_end": n(".!?"),
            "n_upper": sum("A" <= c <= "Z" for c in t), "n_lower": sum("a" <= c <= "z" for c in t), "n_digit": n("0123456789"), "n_lead": sum(not c.isascii() for c in t), "n_other_ascii": sum(c.isascii() for c in t) - letters - n(known),
        }
        assert {k: int(got[k][i]) for k in textkernel.STATS} == want, t
        low = [x.encode().lower() for x in w]
        assert len(sets[i]) == len({tuple(low[j : j + 5]) for j in range(max(1, len(low) - 4))} if low else ())


def test_cover_by_brute_force():
    rng = random.Random(1)
    for _ in range(500):
        spans = [("x", a, a + rng.randint(1, 6)) for a in (rng.randint(0, 40) for _ in range(rng.randint(0, 6)))]
        cover = pii.Cover(spans)
        for _ in range(5):
            a = rng.randint(0, 45)
            b = a + rng.randint(1, 5)
            hit = any(a < e and s < b for _, s, e in spans)
            assert cover.touches(a, b) == hit
            if not hit:
                cover.add(a, b)
                spans.append(("x", a, b))


@pytest.fixture(scope="module")
def spans_model():
    rng = random.Random(5)
    n = lambda k: "".join(rng.choice("0123456789") for _ in range(k))
    kinds = [lambda i: f"+{n(2)} {n(3)} {n(3)} {n(3)}", lambda i: f"ann{i}.x@mail{i}.org", lambda i: "4111 1111 1111 1111", lambda i: f"10.{i % 200}.7.12"]
    pairs = [e for i in range(400) for e in pii.examples(f"words before {kinds[i % 4](i)} and words after")]
    return pii.fit(np.array([x for x, _ in pairs], float), np.array([y for _, y in pairs], bool))


def test_secrets_and_account_numbers(spans_model):
    digest = "3fdf5a35c7b8d733c0b5c7d364eda8ac88d929d1"
    texts = [f'la token = "{digest}"### el', f"commit {digest} was", "api_key=Zk3jd9sK2lPq8vXw1mNb", "pay DE89370400440532013000 now", "see https://example.org/es/some-long-page-title-2024/index.html", "phone 5551234567 ok"]
    found = [[t[a:b] for _, a, b in spans] for t, (_, spans) in zip(texts, pii.find_spans(texts, spans_model))]
    assert found == [[digest], [], ["Zk3jd9sK2lPq8vXw1mNb"], ["DE89370400440532013000"], [], ["5551234567"]]


def test_added_spans_are_the_best_that_touch_nothing(spans_model):
    text = "phone (415) 555-1234 20240101, mail a@b.co 10.1.2.3 account 123 4567 8901 and 4465758382889437 4465758382889437"
    ((base, spans),) = pii.find_spans([text], spans_model)
    left = {c: spans_model.score(np.array([pii.features(text, *c)], float))[0] for c in pii.candidates(text) if not any(c[0] < e and s < c[1] for _, s, e in base)}
    want = []
    for a, b in sorted((c for c in left if left[c] >= spans_model.threshold), key=lambda c: (-left[c], c[0], -c[1])):
        if not any(a < e and s < b for s, e in want):
            want.append((a, b))
    assert [(a, b) for k, a, b in spans if k == "other"] == sorted(want)
    never = pii.Boosted(0.0, [], 2.0)
    assert pii.find_spans([text], never) == [(base, base)]


@pytest.mark.parametrize("unit", ["12 34-", "1(", " a@b.co 1.2.3.4 +12 345 678 901", "a at b dot co ", "id 5551234567 "])
def test_spans_take_time_in_proportion(spans_model, unit):
    def seconds(size):
        text, best = (unit * (size // len(unit) + 1))[:size], 1e9
        for _ in range(2):
            began = time.process_time()
            pii.find_spans([text], spans_model)
            best = min(best, time.process_time() - began)
        return best

    assert seconds(80_000) < 3 * seconds(40_000) + 0.1


def test_repeated_ids_are_one_vector(spark):
    x = np.random.default_rng(0).normal(size=(300, 8))
    rows = [(i, v.tolist()) for i, v in enumerate(x)]
    copies = [r for r in rows for _ in range(40 if r[0] == 1 else 1 + r[0] % 3)]
    of = lambda some: [tuple(r) for r in multi_index.nearest(spark.createDataFrame(some, "vec_id long, embedding array<double>"), F.col("vec_id") % 50 == 0).orderBy("query_id", "rank").collect()]
    assert of(copies) == of(rows)


def test_traversal_reaches_the_wanted_entries():
    rng = np.random.default_rng(3)
    first, second, counts = rng.random(7), rng.random(5), rng.integers(0, 4, (7, 5))
    sums = first[:, None] + second
    for wanted in (1, 10, counts.sum(), 10**6):
        radius = multi_index.traverse(first, second, counts, wanted)
        order = np.sort(np.unique(sums))
        want = next((r for r in order if counts[sums <= r].sum() >= wanted), order[-1])
        assert np.isclose(radius, want)


def test_many_languages_and_scripts(spark):
    rng = random.Random(4)
    scripts = {"ru": "а-я", "el": "α-ω", "zh": "一-乿", "ja": "ぁ-ん", "ko": "가-갿", "en": "a-z", "de": "a-z"}
    letters = {k: [chr(c) for c in range(ord(v[0]), ord(v[2]) + 1)] for k, v in scripts.items()}
    letters |= {f"x{i:03}": rng.sample(letters["en"], 6) for i in range(300)}
    words = {k: ["".join(rng.choice(v) for _ in range(rng.randint(3, 7))) for _ in range(12)] for k, v in letters.items()}
    rows = [(1000 * i + j, " ".join(rng.choice(words[k]) for _ in range(60)), k) for i, k in enumerate(words) for j in range(6)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    model = language_id.fit(language_id.labelled_texts(docs, F.col("doc_id") % 1000 < 5, "doc_id", "text", "lang"))
    assert len(model.languages) == 307
    got = {r.doc_id: r.lang_pred for r in language_id.identify(docs.where("doc_id % 1000 = 5"), model).collect()}
    assert np.mean([got[i] == k for i, _, k in rows if i in got]) > 0.98


def test_long_texts_are_parsed_as_one(monkeypatch):
    rng = random.Random(6)
    word = ["".join(rng.choice("abcde") for _ in range(rng.randint(2, 6))) for _ in range(40)]
    text = lambda n: " ".join(rng.choice(word) for _ in range(n))
    sample = text(2000), text(2000)[::-1]
    model = language_id.fit({"aa": [sample[0]], "bb": [sample[1]]})
    numbers, offsets = language_id.letters_of(pa.array([text(8000), text(3)]), model.codes)
    got = language_id.count_phrases(model, numbers, offsets)
    with monkeypatch.context() as m:  # the hash table gives the same
        m.setattr(language_id, "PLAIN_CELLS", 0)
        hashed = language_id.fit({"aa": [sample[0]], "bb": [sample[1]]})
    assert isinstance(model.steps, language_id.PlainSteps) and isinstance(hashed.steps, language_id.Steps)
    assert (language_id.count_phrases(hashed, numbers, offsets) == got).all()
    monkeypatch.setattr(language_id, "PIECE", 1 << 30)
    whole = language_id.count_phrases(model, numbers, offsets)
    assert (abs(got - whole) <= whole / 1000).all() and (got[1] == whole[1]).all()


def test_many_ranges_of_urls(spark):
    rng = random.Random(7)
    hosts = [f"{rng.choice('abc')}{i}.{rng.choice(['org', 'com', 'net'])}" for i in range(200)]
    urls = [f"http://{rng.choice(['', 'www.'])}{rng.choice(hosts)}/{rng.choice('xyz')}/{i % 5}" for i in range(1500)] + ["http://hot.org/x/1"] * 700
    rules = [(rng.choice(hosts), rng.choice(["/", "/x", "/x/1", "/y/"]), rng.choice(["allow", "block"])) for _ in range(80)] + [("hot.org", "/x", "block"), ("org", "/", "block")]
    rules = list({r[:2]: r for r in rules}.values())
    got = url_filter.filter_urls(spark.createDataFrame(list(enumerate(urls)), "page_id long, url string"), spark.createDataFrame(rules, "host string, path string, verdict string"), buckets=1000).collect()
    assert len(got) == len(urls)
    for r in got:
        fits = [x for x in rules if (r.host == x[0] or r.host.endswith("." + x[0])) and r.path.startswith(x[1])]
        best = max(fits, key=lambda x: len(x[0] + x[1]), default=None)
        assert urls[r.page_id].endswith(r.host + r.path) and (r.rule, r.verdict) == ((best[0] + best[1], best[2]) if best else (None, "allow"))


def test_choice_by_brute_force():
    rng = np.random.default_rng(8)
    for _ in range(200):
        capacity, n = np.array([100, 6, 40]), rng.integers(1, 12)
        demand = np.column_stack([rng.integers(0, 120, n), rng.integers(1, 4, n), rng.integers(0, 60, n)])
        left = np.array([rng.integers(1, 101), rng.integers(1, 7), rng.integers(1, 41)])
        fits = [i for i in range(n) if (demand[i] <= left).all()]
        value = lambda i: sum(demand[i] / capacity * left / capacity)
        got = packing.choose(demand, demand / capacity, left, capacity)
        assert got == -1 if not fits else np.isclose(value(got), max(map(value, fits))) and got in fits


def test_scores_and_verdicts_by_brute_force(spark):
    docs, labels = common.table(spark, SF, "documents"), common.table(spark, SF, "labels")
    x, y = labelled.labelled_sample(docs, labels, "quality")
    model = quality_gam.fit(x, y)
    for row, score in zip(x[:60], model.score(x[:60])):
        z = model.intercept + sum(t[sum(v >= c for c in cuts)] for v, cuts, t in zip(row, model.cuts, model.tables))
        z += sum(t[sum(row[i] >= c for c in model.coarse[i]), sum(row[j] >= c for c in model.coarse[j])] for (i, j), t in zip(model.pairs, model.pair_tables))
        assert np.isclose(score, 1 / (1 + np.exp(-z)))
    rules = quality_rules.learn_decision_list(x, y)
    assert rules
    for r in quality_rules.quality_rules(docs, labels).collect():
        value = {k: r[a] / (1 if b == "1" else max(r[b], 1)) for k, (a, b) in labelled.FEATURES.items()}
        hit = any(all((value[c.feature] >= c.threshold) == c.above for c in rule) for rule in rules)
        assert r.kept == (not r.base_failed and not hit)


ODD = "doc_id long, text string, lang string, source string, n_chars long, token string, score int, component_id long, copy int, h long"


def test_stages_with_odd_rows(spark, tmp_path):
    long = " ".join(f"w{i}" for i in range(40_000))
    good = " ".join(f"Word{i} and some more of it." for i in range(12))
    texts = [None, "", " \n", "a", good, good, good + " mail a@b.co", long, "x é <|endoftext|>"]
    rows = [(i, t, None, "src0" if i % 2 else None, None, "x", 1, 2, 3, 4) for i, t in enumerate(texts)]
    docs = spark.createDataFrame([*rows, rows[4], rows[4], (None, good, *[None] * 8), (None, None, *[None] * 8)], ODD)
    d = str(tmp_path)
    common.table(spark, SF, "labels").where("doc_id < 0").write.parquet(f"{d}/labels.parquet")
    assert corpus_pipeline.quality(spark, docs, d).count() == docs.count()  # without labels nothing is rejected
    one = common.materialise(corpus_pipeline.near_duplicates(spark, docs, d), "t")
    assert one.columns == docs.columns and sorted(r.doc_id for r in one.where("doc_id IS NOT NULL").collect()) == [0, 1, 2, 3, 4, 7, 8] and one.where("doc_id IS NULL").count() == 2
    clean = common.materialise(corpus_pipeline.personal_data(spark, docs, d), "t")
    assert clean.columns == docs.columns and clean.count() == docs.count() and clean.where("text LIKE '%[email]'").count() == 1 and clean.where("text IS NULL").count() == 2
    mixed = corpus_pipeline.mixing_weights(spark, docs, d)
    assert mixed.columns == docs.columns and {r.doc_id for r in mixed.collect()} <= {r.doc_id for r in docs.collect()}
    pieces = corpus_pipeline.pack(spark, docs, d).collect()
    assert {r.doc_id for r in pieces} == {r.doc_id for r in docs.collect()}
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, docs.limit(0), d).count() == 0


def test_scratch_tables_go(spark):
    path = spark._jvm.org.apache.hadoop.fs.Path
    with common.Scratch(spark) as scratch:
        scratch.write(spark.range(3), "gone")
        kept = scratch.write(spark.range(4), "kept", keep=True)
        (gone,) = scratch.paths
    at = path(gone)
    assert not at.getFileSystem(spark._jsc.hadoopConfiguration()).exists(at) and kept.count() == 4


def test_a_cluster_must_name_its_shared_folder():
    class Conf:
        def get(self, *_):
            return None

    class Session:
        conf = Conf()

        class sparkContext:  # noqa: N801
            master = "spark://host:7077"

    with pytest.raises(ValueError):
        common.scratch_dir(Session())


def test_license_templates(spark, tmp_path):
    """Bodies and headers, whole, shortened, in long texts, twice, against SQL over the same documents."""
    known = license_scan.TEMPLATES
    texts = [notice for _, notice in known] + [" ".join(n.split()[: len(n.split()) * 9 // 10]) for _, n in known] + [" ".join(n.split()[: len(n.split()) // 2]) for _, n in known]
    texts += ["word " * 3000 + n.upper() + " tail " * 700 + n for _, n in known] + [None, "", "Released under"]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    got = license_scan.op6_license_scan(spark, str(tmp_path)).collect()
    con = duckdb.connect()
    con.sql(f"CREATE VIEW documents AS SELECT * FROM '{tmp_path}/documents.parquet/*.parquet'")
    want = con.sql(license_scan.OP6_SQL).fetchall()
    assert sorted(map(tuple, got)) == sorted(want)
    assert {(i, license) for i, (license, _) in enumerate(known)} <= {(r[0], r[1]) for r in got}


def test_license_many_templates(spark, monkeypatch):
    """Hundreds of templates, broadcast and joined by shuffle, find the same; bits set by chance change nothing."""
    templates = [(f"L{i}", " ".join(f"w{i}x{j % 90}" for j in range(20 + i))) for i in range(300)]
    docs = spark.createDataFrame([(i, "some words before it " + n) for i, (_, n) in enumerate(templates)], "doc_id long, text string")
    want = {(i, f"L{i}") for i in range(300)}
    assert {(r.doc_id, r.license) for r in license_scan.scan_licenses(docs, templates).collect()} == want
    monkeypatch.setattr(license_scan, "BROADCAST_SHINGLES", 0)
    monkeypatch.setattr(license_scan, "bitmap", lambda _: [-1] * 16)
    assert {(r.doc_id, r.license) for r in license_scan.scan_licenses(docs.where("doc_id < 40"), templates[:40]).collect()} == {x for x in want if x[0] < 40}


@pytest.mark.parametrize("few", [0, 8, 10**6])
def test_links_within_by_brute_force(monkeypatch, few):
    """One at a time or many at once, the trees are those of all pairs."""
    monkeypatch.setattr(jaccard_join, "FEW", few)
    rng = np.random.default_rng(few)
    for _ in range(60):
        n, base, sets = int(rng.integers(1, 60)), rng.integers(0, 2**63, (3, 40), dtype=np.uint64), []
        for _ in range(n):
            s = base[rng.integers(0, 3)][: rng.integers(0, 41)].copy()
            changed = rng.random(len(s)) < rng.choice([0, 0.05, 0.12])
            s[changed] = rng.integers(0, 2**63, changed.sum(), dtype=np.uint64)
            sets.append(np.unique(s))
        ids = rng.permutation(n)
        up = {x: x for x in ids.tolist()}

        def root(x):
            while up[x] != x:  # noqa: B023
                x = up[x]  # noqa: B023
            return x

        for i in range(n):
            for j in range(i):
                both = len(np.intersect1d(sets[i], sets[j]))
                if both and 100 * both >= 80 * (len(sets[i]) + len(sets[j]) - both):
                    a, b = root(int(ids[i])), root(int(ids[j]))
                    up[max(a, b)] = min(a, b)
        assert jaccard_join.links_within(ids, ids.copy(), sets) == sorted((root(x), x) for x in up if root(x) != x)


def test_join_leaves_no_shuffle_files_and_shuffles_no_prefix_of_what_has_no_copy(spark):
    rows = [(i, " ".join(f"w{i}x{j}" for j in range(30))) for i in range(40)] + [(100, " ".join(f"w3x{j}" for j in range(30)))]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    with common.Scratch(spark) as scratch:
        full = scratch.write(jaccard_join._prefixes(docs, *jaccard_join.frequent_shingles(docs)), "prefixes")
        classes = scratch.write(full.groupBy("d1", "d2", "n_shingles").agg(F.min("doc_id").alias("rep")), "classes")
        held = len(spark.sparkContext._jsc.sc().env().blockManager().diskBlockManager().getAllFiles().mkString("\n").split("shuffle_"))
        scratch.write(classes.repartition(3, "rep"), "again")
        assert len(spark.sparkContext._jsc.sc().env().blockManager().diskBlockManager().getAllFiles().mkString("\n").split("shuffle_")) <= held
        kept = jaccard_join._without_copies(full, classes, scratch)
        assert sorted(r.doc_id for r in kept.select("doc_id").collect()) == list(range(40))
        assert full.where("doc_id = 100").count() == 1 and scratch.paths
        # the exact join stands above the bitmap, so what it shuffles is what the bitmap marks
        plan = kept._jdf.queryExecution().optimizedPlan().toString()
        assert "LeftAnti" not in plan
        scratch.drop("copies")
        assert not any("/copies-" in p for p in scratch.paths)
