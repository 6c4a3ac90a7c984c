"""The training-data operators over a small table of odd rows, against brute force."""

import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from sheafspark.llm import arc, fmindex, langid, lengths, mincut, mixing, quality, records, rules, simhash

WORDS = str(public_tokenizers.path("word_bpe_49k.json"))
PIECES = str(public_tokenizers.path("piece_bpe_32k.model"))
LONG = " ".join(f"word{i % 977}" for i in range(40_000))
EN, FR = "the cat and the dog with this hat are there", "le chat et la souris dans une maison avec des amis"
# Columns beyond those of documents, with names that operators use themselves.
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, size long, fp long, row string, shard int, key int"


def rows_of(texts):
    return [(i, t, lang, source, None if t is None else len(t), 1, 2, "r", 3, 4) for i, t, lang, source in texts]


ODD = [
    (1, EN + " one", "en", "a"), (2, FR + " deux", "fr", "b"), (3, None, None, None), (4, "", "en", "a"),
    (5, LONG, "en", "a"), (5, LONG, "en", "a"), (None, "no id at all here", "en", None), (6, "12 34 !!", None, "b"),
    (7, EN + " one", "en", "a"), (8, " \n\t", "fr", "c"), (9, "x", "en", "\U0001f600"), (10, "X", "en", "￿"),
    (11, "a b c d e f g h i j k l m n o p", "en", "b"), (12, "z A b c d e f g h i j k l m", "en", "b"), (13, "Short Item!", "en", "c"),
]


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame(rows_of(ODD), SCHEMA).repartition(3).cache()


@pytest.fixture(scope="module")
def nothing(spark):
    return spark.createDataFrame([], SCHEMA)


@pytest.fixture(scope="module")
def items(spark):
    schema = "item_id long, text string, n_words long"
    texts = [(1, "A b c d e f g h i j k l m n"), (2, "short item"), (10, "short, item"), (3, ""), (4, None), (2, "short item")]
    return spark.createDataFrame([(i, t, 0) for i, t in texts], schema)


def plain_words(text, pattern=r"[^\x20\x09-\x0D]+"):
    return re.findall(pattern, text or "")


def test_archives(spark):
    big = "<p>" + "é" * 1000
    data = [(1, "http://a b", big), (9, "http://c", big), (4, None, big), (2, "u", None), (3, "u", ""), (None, "n", big), (9, "http://c", big), (5, "u", "x" * 999), (6, "u", "x" * 999)]
    pages = spark.createDataFrame([(*r, "h", 1) for r in data], "page_id long, url string, html string, record string, digest int")
    found = arc.archive_round_trip(pages.repartition(3)).collect()
    assert Counter((r.page_id, r.payload_bytes) for r in found) == Counter((i, len((h or "").encode())) for i, _, h in data)
    long = [r for r in found if r.payload_bytes >= 1000]
    assert sorted(((r.page_id, r.record_type, r.refers_to) for r in long), key=repr) == sorted(
        [(9, "response", None), (9, "revisit", 9), (1, "revisit", 9), (4, "revisit", 9), (None, "revisit", 9)], key=repr
    )
    assert all(r.record_type == "response" and r.refers_to is None for r in found if r.payload_bytes < 1000)
    assert arc.archive_round_trip(pages.limit(0)).count() == 0


def test_archives_roll_over(spark):
    from sheafspark.llm import storage

    pages = spark.range(25).select(F.col("id").alias("page_id"), F.lit("u").alias("url"), F.lit("text").alias("html")).coalesce(1)
    folder = storage.make_folder(spark)
    manifest = arc.write_arcs(pages, folder, file_records=5)
    assert manifest.count() > 4 and arc.scan_arcs(manifest, folder).count() == 25


def test_main_text(spark):
    pages = spark.createDataFrame([(1, None, None, "t"), (None, "u", "<article><p>Hello &lt;you&gt;.</p></article>", "t"), (2, "u", "", "t")], "page_id long, url string, html string, text string")
    assert {(r.page_id, r.text, r.n_chars) for r in mincut.extract(pages).collect()} == {(1, "", 0), (None, "Hello <you>.", 12), (2, "", 0)}
    assert mincut.extract(pages.limit(0)).count() == 0


def test_decontamination(docs, nothing, items):
    def words(text):
        return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))

    windows = defaultdict(set)
    for r in items.collect():
        w = words(r.text)
        k = min(13, len(w))
        for i in range(len(w) - k + 1 if w else 0):
            windows[tuple(w[i : i + k])].add(str(r.item_id))
    expected = Counter()
    for i, text, *_ in ODD:
        w, hit, names = words(text), set(), set()
        for at in range(len(w)):
            for window, owners in windows.items():
                if tuple(w[at : at + len(window)]) == window:
                    hit.update(range(at, at + len(window)))
                    names |= owners
        expected[i, len(w), len(hit), len(names), bool(hit) and 20 * len(hit) >= len(w)] += 1
    for block_words in (1000, 3):
        found = fmindex.report(fmindex.contamination(docs, items, block_words)).collect()
        assert Counter((r.doc_id, r.n_words, r.n_hit, r.n_items, r.contaminated) for r in found) == expected
    assert {r.doc_id for r in found if r.contaminated} == {11, 12, 13}
    kept = fmindex.remove_contaminated(docs, items)
    assert kept.columns == docs.columns and kept.count() == len(ODD) - 3
    assert fmindex.contamination(nothing, items).count() == 0
    assert fmindex.report(fmindex.contamination(docs, items.limit(0))).where("contaminated").count() == 0


def test_blocks_of_items_and_small_shards(spark, docs, items):
    whole = Counter(map(tuple, fmindex.report(fmindex.contamination(docs, items)).collect()))
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(name)
    spark.conf.set(name, "1")
    try:
        parts = Counter(map(tuple, fmindex.report(fmindex.contamination(docs, items, 3, 1)).collect()))
    finally:
        spark.conf.set(name, before)
    assert parts == whole and sum(parts.values()) == len(ODD)


def test_mix(spark, docs, nothing):
    many = [(i, " ".join(["w"] * (i % 37 + 1)), None, f"s{i % 4}" if i % 3 else "hot") for i in range(3000)]
    table = spark.createDataFrame(rows_of(many + [(None, "a b", None, None), (1, None, None, "s1")]), SCHEMA)
    for frame in (table, docs):
        rows = frame.collect()
        sizes, names = defaultdict(int), {r.source for r in rows}
        for r in rows:
            sizes[r.source] += len(plain_words(r.text))
        order = sorted(names, key=lambda s: (s is None, s or ""))
        weight = {s: (5, 2, 1)[k % 3] for k, s in enumerate(order)}
        target, left, open_ = {}, 1.5 * sum(sizes.values()), set(order)
        while open_:
            share = {s: left * weight[s] / sum(weight[x] for x in open_) for s in open_}
            over = {s for s in open_ if share[s] > 2 * sizes[s]}
            if not over:
                target |= share
                break
            for s in over:
                target[s] = 2.0 * sizes[s]
                left -= target[s]
            open_ -= over
        found = mixing.mix(frame, shard_words=2000).collect()
        assert len(found) == len(rows)
        taken, largest = defaultdict(int), defaultdict(int)
        for r in found:
            assert abs(r.target - target[r.source]) < 1e-6 and r.source_size == sizes[r.source]
            assert 0 <= r.taken <= 2 * r["size"] and r.taken == r.copies * r["size"] and len(r.shards) == r.copies
            taken[r.source] += r.taken
            largest[r.source] = max(largest[r.source], r["size"])
        assert all(abs(taken[s] - target[s]) <= largest[s] / 2 + 1 for s in names)
        again = mixing.mix(frame.repartition(5), shard_words=2000).select("doc_id", "taken").collect()
        assert Counter(map(tuple, again)) == Counter((r.doc_id, r.taken) for r in found)
    out = mixing.mixed_rows(docs)
    assert out.columns == docs.columns and out.count() == sum(r.copies for r in found)
    assert mixing.mix(nothing).count() == 0


def test_mix_of_few_skewed_documents(spark):
    rows, sizes = [], (3000, 900, 500, *range(1, 30))
    for k in range(12):
        rows += [(100 * k + i, " ".join(["w"] * n), None, f"s{k:02}") for i, n in enumerate(sizes)]
    found = mixing.mix(spark.createDataFrame(rows_of(rows), SCHEMA)).collect()
    taken, target = defaultdict(int), {}
    for r in found:
        taken[r.source] += r.taken
        target[r.source] = r.target
    assert len(found) == len(rows) and all(abs(taken[s] - target[s]) <= 30 for s in target)


def test_splitting_tree_keeps_quotas(spark):
    quotas = {"a": 500, "b": 300, None: 200, "c": 1, "d": 0}
    frame = spark.createDataFrame(list(quotas.items()), "source string, quota long")
    rows = mixing.splitting_tree(frame, 7).collect()
    by_source, by_shard = Counter(), Counter()
    for r in rows:
        by_source[r.source] += r.quota
        by_shard[r.shard] += r.quota
    assert by_source == Counter({k: v for k, v in quotas.items() if v}) and set(by_shard.values()) <= {142, 143, 144}
    chances = spark.range(4000).select((F.col("id") / 4000).alias("u"))
    drawn = chances.select(mixing.hypergeometric(F.lit(60), F.lit(20), F.lit(30), F.col("u")).alias("k"))
    mean, var = drawn.agg(F.mean("k"), F.variance("k")).first()
    assert abs(mean - 10) < 0.05 and abs(var - 30 * (1 / 3) * (2 / 3) * (30 / 59)) < 0.1


def test_splitting_tree_of_many_sources(spark):
    quotas = {f"s{i:03}": i % 5 for i in range(300)} | {None: 40, "big": 900}
    frame = spark.createDataFrame(list(quotas.items()), "source string, quota long")
    rows = mixing.splitting_tree(frame, 13, group=20).collect()
    by_source, by_shard = Counter(), Counter()
    for r in rows:
        assert r.quota > 0
        by_source[r.source] += r.quota
        by_shard[r.shard] += r.quota
    assert by_source == Counter({k: v for k, v in quotas.items() if v})
    fair = sum(quotas.values()) / 13
    assert len(by_shard) == 13 and all(abs(n - fair) <= 4 for n in by_shard.values())
    big = [r.quota for r in rows if r.source == "big"]
    assert len(big) == 13 and all(40 < n < 100 for n in big)


def test_blocks_stay_small_and_running_sums_agree(spark, monkeypatch):
    monkeypatch.setattr(mixing, "CHUNK", 3)
    monkeypatch.setattr(mixing, "BLOCK_DOCS", 4)
    frame = spark.range(900).selectExpr("id AS doc_id", "concat('s', id % 3 * id % 2) AS source", "repeat('w ', CAST(id % 7 AS int)) AS text")
    narrow = mixing.sizes(frame)
    sources = mixing.targets(narrow)
    plan = mixing.block_plan(mixing.blocks_of(narrow, sources)).collect()
    by_source = defaultdict(list)
    for r in sorted(plan, key=lambda r: r.place):
        by_source[r.source].append(r)
    for rows in by_source.values():
        assert [r.rank for r in rows] == list(range(len(rows))) and {r.n_present for r in rows} == {len(rows)}
        assert len({r.place for r in rows}) == len(rows)
        assert [r.whole for r in rows] == sorted((r.whole for r in rows), reverse=True) and sum(r.cut > 0 for r in rows) <= 1
    for t in sources.collect():
        got = sum(r.whole * r.words + r.cut for r in by_source[t.source])
        assert abs(got - t.target) <= 1
    found = mixing.mix(frame, shard_words=100).collect()
    shards = Counter(s for r in found for s in r.shards)
    assert sum(shards.values()) == sum(r.copies for r in found) and len(shards) > 3


def test_records(docs, nothing):
    tool = Tokenizer.from_file(WORDS)
    found = records.encode_and_read_back(docs, WORDS, 1).orderBy("start").collect()
    expected = Counter()
    for i, text, *_ in ODD:
        ids = [*tool.encode(text or "", add_special_tokens=False).ids, 1]
        expected[i, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())] += 1
    assert Counter((r.doc_id, r.n_tokens, r.ids_crc32) for r in found) == expected
    assert [r.doc_id if r.doc_id is not None else -1 for r in found] == sorted(r.doc_id or -1 for r in found)
    assert [r.start for r in found] == np.cumsum([0, *[r.n_tokens for r in found]])[:-1].tolist()
    assert records.encode_and_read_back(nothing, WORDS, 1).count() == 0


def test_shuffled_reads_by_the_index(spark, docs):
    from sheafspark.llm import storage

    folder = storage.make_folder(spark)
    index = records.write_records(docs, folder, WORDS, 1)
    some = index.where("doc_id % 2 = 1").orderBy(F.desc("doc_id"))
    assert records.read_records(some, folder).where("length(ids) = 4 * n_tokens").count() == index.where("doc_id % 2 = 1").count()


def test_quality(spark, docs, nothing):
    good = [(i, " ".join(f"word{(i * 7 + k * k) % 91}" for k in range(40)) + ".", 1) for i in range(400)]
    bad = [(i, " ".join(f"WORD{(i * 7 + k * k) % 91}!!" for k in range(40)), 0) for i in range(400, 600)]
    table = spark.createDataFrame([(i, t) for i, t, _ in good + bad] + [(None, None), (1000, "")], "doc_id long, text string")
    labels = spark.createDataFrame([(i, q, 0) for i, _, q in good + bad] + [(1000, None, 0), (None, 1, 0)], "doc_id long, quality int, toxic int")
    rows = quality.quality_scores(table, labels).collect()
    truth = {i: q for i, _, q in good + bad}
    held = [r for r in rows if r.held_out and r.doc_id in truth]
    assert {r.doc_id for r in held} == {i for i in truth if zlib.crc32(str(i).encode()) % 4 == 2}
    assert sum(r.predicted == truth[r.doc_id] for r in held) >= 0.97 * len(held)
    assert len(rows) == 602 and all(0 <= r.score <= 1 for r in rows)
    assert quality.quality_scores(docs, labels.limit(0)).where("score = 0.5").count() == len(ODD)
    assert quality.quality_scores(nothing, labels).count() == 0


def components(prints):
    values = sorted({int(p, 16) for _, p in prints})
    parent = {v: v for v in values}

    def root(v):
        while parent[v] != v:
            v = parent[v]
        return v

    for i, a in enumerate(values):
        for b in values[:i]:
            if (a ^ b).bit_count() <= 2:
                parent[root(a)] = root(b)
    least = {}
    for i, p in prints:
        r = root(int(p, 16))
        if i is not None:
            least[r] = min(least.get(r, i), i)
    return Counter((i, p, least.get(root(int(p, 16)))) for i, p in prints)


def test_near_duplicates(docs, nothing):
    found = [tuple(r) for r in simhash.near_duplicates(docs).collect()]
    assert Counter(found) == components([(i, p) for i, p, _ in found]) and len(found) == len(ODD)
    kept = simhash.keep_one(docs)
    assert kept.columns == docs.columns
    groups = {(i, c) for i, _, c in found}
    assert sorted((r.doc_id for r in kept.collect()), key=repr) == sorted({c for _, c in groups}, key=repr)
    assert simhash.near_duplicates(nothing).count() == 0 and simhash.keep_one(nothing).count() == 0


def test_clashing_names_and_repeated_rows(spark, docs, items, monkeypatch):
    """Columns with the names that operators use themselves, and repeated rows that differ elsewhere."""
    odd = "_id _key kept kept_id kept_key copies whole_row bad_id text_key order root salt fp of_root is_large rank first n".split()
    named = docs.select("doc_id", "text", "lang", "source", "size", *[F.lit(k).alias(name) for k, name in enumerate(odd)])
    for found in (simhash.keep_one(named), fmindex.remove_contaminated(named, items)):
        assert found.columns == named.columns and 0 < found.count() < len(ODD)
    monkeypatch.setattr(simhash, "LARGE", 0)
    twice = [(1, EN, "en", "b"), (1, EN, "en", "a"), (1, EN, "en", "a"), (2, EN, "en", "c"), (None, EN, "fr", "x"), (None, FR, "fr", "x"), (None, FR, "fr", "y")]
    first = None
    for parts in (1, 3, 5):
        kept = simhash.keep_one(spark.createDataFrame(rows_of(twice), SCHEMA).repartition(parts))
        got = sorted((r.doc_id or 0, r.text, r.source) for r in kept.collect())
        assert [r[:2] for r in got] == [(0, FR), (1, EN)]
        first = first or got
        assert got == first


def test_large_clusters_of_fingerprints(spark):
    rng = np.random.default_rng(5)
    base = rng.integers(0, 1 << 63)
    values = {int(base)}
    while len(values) < 1500:
        bits = rng.choice(64, rng.integers(0, 6), replace=False)
        values.add(int(base) ^ sum(1 << int(b) for b in bits))
    values |= {int(v) for v in rng.integers(0, 1 << 63, 300)}
    prints = [(k, f"{v:016x}") for k, v in enumerate(sorted(values))]
    signed = [(k, v - (1 << 64) if v >> 63 else v) for k, v in enumerate(sorted(values))]
    frame = spark.createDataFrame(signed, "doc_id long, fp long")
    groups = {r.fp: r.component_id for r in simhash.fingerprint_groups(frame).collect()}
    expected = {(k, c) for k, _, c in components(prints)}
    assert {(k, groups[v]) for k, v in signed} == expected


def test_ledger(docs, nothing):
    rows = rules.verdicts(rules.ledger(docs)).collect()
    assert len(rows) == len(ODD)
    for r in rows:
        assert r.base_failed == (r.n_words < 20 or 100 * r.n_repeat_words > 30 * r.n_words)
        assert not (r.base_failed and r.kept)
    assert Counter(r.n_words for r in rows) == Counter(len(plain_words(t)) for _, t, *_ in ODD)
    ledger = rules.ledger(docs)
    found = {r.rule: r for r in rules.ablations(ledger, "v1").collect()}
    assert found["few_words"].n_failed == sum(r.n_words < 20 for r in rows)
    assert found["few_words"].n_only == sum(r.failed == 1 for r in rows)
    assert found["few_words"].kept == sum(r.failed == 0 for r in rows)
    assert rules.ledger(nothing).count() == 0
    assert [r.kept for r in rules.ablations(rules.ledger(nothing), "base").collect()] == [0, 0]


def test_language(spark, docs, nothing):
    texts = [(i, (EN if i % 2 else FR) + f" {i}", "en" if i % 2 else "fr", "s") for i in range(100, 160)]
    table = spark.createDataFrame(rows_of(texts + ODD), SCHEMA)
    rows = {r.doc_id: r for r in langid.languages_of(table, PIECES).collect()}
    assert all(rows[i].lang_pred == lang and rows[i].held_out == (zlib.crc32(str(i).encode()) % 4 == 2) for i, _, lang, _ in texts)
    assert {i for i, r in rows.items() if r.lang_pred == "und"} == {3, 4, 6, 8} and rows[3].score == 0
    kept = langid.keep_identified(table, PIECES)
    assert kept.columns == table.columns
    assert {r.doc_id for r in kept.collect()} >= {i for i, *_ in texts} | {1, 2}
    assert langid.languages_of(nothing, PIECES).count() == 0
    assert langid.languages_of(docs.withColumn("lang", F.lit(None).cast("string")), PIECES).where("lang_pred <> 'und'").count() == 0


def test_thousands_of_languages(spark):
    rows = [(i, f"{EN if i % 2 else FR} {chr(97 + i % 26) * 3}{chr(97 + i // 26 % 26)}{chr(97 + i // 676)}", f"l{i:04}") for i in range(5000)]
    table = spark.createDataFrame(rows, "doc_id long, text string, lang string").repartition(4)
    found = langid.languages_of(table, PIECES)
    got = {r.doc_id: r for r in found.collect()}
    learnt = {f"l{i:04}" for i in range(5000) if zlib.crc32(str(i).encode()) % 4 != 2}
    assert {r.lang_pred for r in got.values()} <= learnt and len(got) == 5000
    right = [r.lang_pred == f"l{i:04}" for i, r in got.items() if not r.held_out]
    assert sum(right) > 0.9 * len(right)


def test_language_beside_unseen_pieces(spark):
    model = langid.pieces(PIECES)
    probability = np.full((model.count, 2), 0.05 / 1.2e6)
    frame = spark.createDataFrame([(0, "\U0001d41a" * 12), (1, EN), (2, FR)], "doc_id long, text string").coalesce(1)
    flat, begin, sizes = (np.frombuffer("▁the▁le".encode(), np.uint8), np.array([0, 6]), np.array([6, 5]))
    edges = {(int(w), end, length): int(p) for end, length, ws, ps in model.lattice(flat, begin, sizes) for w, p in zip(ws, ps)}
    probability[edges[0, 6, 6], 0] = probability[edges[1, 5, 5], 1] = 0.1
    even = langid.Model(["en", "fr"], np.arange(model.count), probability)
    found = langid.predict(frame, even, PIECES, ("lang_pred", "score")).collect()
    rows = {r.doc_id: r for r in found}
    assert (rows[1].lang_pred, rows[2].lang_pred) == ("en", "fr") and all(0 < r.score <= 1 for r in found)


def test_lengths(docs, nothing):
    tool = Tokenizer.from_file(WORDS)
    sizes = [len(tool.encode(t or "", add_special_tokens=False).ids) for _, t, *_ in ODD]
    histogram = lengths.length_histogram(lengths.token_counts(docs, WORDS))
    for r in histogram.collect():
        at_least = [s for s in sizes if s >= r.n_tokens]
        assert (r.n_docs, r.docs_at_least, r.tokens_at_least) == (sizes.count(r.n_tokens), len(at_least), sum(at_least))
        assert r.truncated_total == sum(min(s, r.n_tokens) for s in sizes) and r.total_tokens == sum(sizes)
    limits = [0, 1, 7, 500, 10**9]
    cut = {r.limit: (r.docs_cut, r.tokens_kept) for r in lengths.truncated_totals(histogram, limits).collect()}
    assert cut == {x: (sum(s > x for s in sizes), sum(min(s, x) for s in sizes)) for x in limits}
    assert lengths.length_quantiles(histogram, [1.0]).first().n_tokens == max(sizes)
    empty = lengths.length_histogram(lengths.token_counts(nothing, WORDS))
    assert empty.count() == 0 and lengths.truncated_totals(empty, [5]).first().tokens_kept == 0


def test_pipeline_over_odd_rows(spark, docs, tmp_path):
    import corpus_pipeline

    base = docs.select(corpus_pipeline.COLUMNS)
    base.write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(1, "a b c d e f g h i j k l m n")], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    out = corpus_pipeline.run(spark, str(tmp_path))
    assert out.columns == ["doc_id", "start", "n_tokens", "ids_crc32"]
    ids = {r.doc_id for r in out.collect()}
    assert ids <= {1, 2, 5, None, 9, 13} and {2, 5} <= ids
