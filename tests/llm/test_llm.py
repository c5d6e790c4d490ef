"""Brute-force versions and edge cases of the training-data operators."""

from __future__ import annotations

import hashlib
import random
import zlib
from itertools import combinations

import numpy as np
import pytest
import xxhash
from conftest import assert_same, oracle

from mnemospark.llm import chat, decontam, gam, packing, queries, rules, sharding, simhash, tokenbin, toxicity, urls
from mnemospark.llm.tokens import ChunkEncoder

DOC = "doc_id bigint, text string, lang string, source string, n_chars bigint"
ODD = ["", None, " \n\t ", "one", "one two", "a " * 5000, "Ünï çødé \x01 <|endoftext|> 中文字", "x" * 30_000, "line\nline\nline\nline\n"]


def words(n: int, seed: int) -> str:
    rng = random.Random(seed)
    return " ".join("".join(rng.choice("abcdefghij") for _ in range(rng.randint(2, 7))) for _ in range(n))


@pytest.fixture(scope="module")
def odd(spark):
    """Nulls in every column, empty and very long texts, ties, repeated rows and clashing names."""
    rows = [(i, t, "en", "s", 1) for i, t in enumerate(ODD)] + [(100 + i, words(60, i % 4), None, None, None) for i in range(8)]
    rows += [(None, "no id here at all", "en", "s", 1), (None, None, None, None, None), rows[9], rows[9]]
    names = "doc_id bigint, text string, shard int, Slot int, score double, failed string, component bigint, fp string, own_0 string, _s string, _start int, _c int, N_Words int, cell int, text_key int, node int, made string"
    return spark.createDataFrame([(a, b, 1, 2, 0.5, c, 7, d, "z", "u", 4, 5, 6, 7, 8, 9, "m") for a, b, c, d, _ in rows], names)


@pytest.fixture(scope="module")
def none(spark):
    return spark.createDataFrame([], DOC)


def tokenizer():
    from tokenizers import Tokenizer

    return Tokenizer.from_file(queries.tokenizer_path())


def plain_ids(text):
    return tokenizer().encode(text or "", add_special_tokens=False).ids


def crc(ids):
    return zlib.crc32(np.array(ids, dtype="<u4").tobytes())


# 1


def tiling(a, b, least):
    free_a, free_b, total = [1] * len(a), [1] * len(b), 0
    while True:
        best = (least - 1, 0, 0)
        for i in range(len(a)):
            for j in range(len(b)):
                k = 0
                while i + k < len(a) and j + k < len(b) and free_a[i + k] and free_b[j + k] and a[i + k] == b[j + k]:
                    k += 1
                best = max(best, (k, -i, -j))
        k, i, j = best[0], -best[1], -best[2]
        if k < least:
            return total
        free_a[i : i + k] = free_b[j : j + k] = [0] * k
        total += k


@pytest.mark.parametrize("seed", range(40))
def test_tiles_equal_brute_force(seed):
    rng = random.Random(seed)
    a = [rng.randint(0, 3 if seed % 3 else 30) for _ in range(rng.randint(1, 40))]
    b = a[len(a) // 2 :] + a[: len(a) // 2] if seed % 2 else [rng.randint(0, 3) for _ in range(60)]
    made = decontam.tiles(a, [b], 5)
    assert sum(t[0] for t in made) == tiling(a, b, 5)
    assert all(a[i : i + n] == b[j : j + n] for n, i, _, j in made)


def test_leaks_find_reordered_passages(spark, odd, none):
    passage = words(40, 77).split()
    turned = passage[25:] + ["other"] + passage[:25]
    docs = spark.createDataFrame([(1, " ".join(passage).upper()), (2, words(50, 1) + " " + " ".join(turned)), (3, words(200, 5)), (4, " ".join(passage[:12])), (None, " ".join(passage)), (6, None)], "doc_id bigint, text string")
    bench = spark.createDataFrame([(9, " ".join(passage)), (9, " ".join(passage)), (8, "not here"), (7, None), (None, words(30, 4))], "item_id bigint, text string")
    got = {(r.doc_id, r.item_id): r for r in decontam.leaks(docs, bench).collect()}
    assert set(got) == {(1, 9), (2, 9), (None, 9)}
    assert got[2, 9].n_tiles == 2 and got[2, 9].coverage == 1.0
    assert sorted(r.doc_id for r in decontam.clean(docs, bench).collect()) == [3, 4, 6]
    assert decontam.clean(odd, bench).count() == odd.count() and decontam.clean(odd, bench).columns == odd.columns
    assert decontam.leaks(none, bench).isEmpty() and decontam.leaks(docs, spark.createDataFrame([], "item_id bigint, text string")).isEmpty()


def test_short_items_must_match_whole(spark):
    bench = spark.createDataFrame([(1, "zorg"), (2, "alpha beta gamma"), (3, ""), (4, "...")], "item_id bigint, text string")
    docs = spark.createDataFrame([(1, "a Zorg here"), (2, "beta gamma alpha"), (3, "x alpha, beta gamma"), (4, "zor g")], "doc_id bigint, text string")
    assert {(r.doc_id, r.item_id, r.coverage) for r in decontam.leaks(docs, bench).collect()} == {(1, 1, 1.0), (3, 2, 1.0)}


def test_repetition_does_not_cost_the_square():
    import time

    began = time.perf_counter()
    made = decontam.tiles([1] * 1200, [[1] * 20_000], 5)
    assert made == [(1200, 0, 0, 0)] and time.perf_counter() - began < 3
    period = [1, 2, 3] * 500
    assert sum(t[0] for t in decontam.tiles(period, [[2, 3, 1] * 3000 + [9]], 5)) == 1500
    assert time.perf_counter() - began < 6


def test_benchmark_blocks_cover_all_items(spark):
    bench = spark.createDataFrame([(i, words(20, i)) for i in range(50)], "item_id bigint, text string")
    made = list(decontam.blocks(bench, "item_id", "text", 5, block_chars=1000))
    assert len(made) > 3 and sorted(i for b in made for i in b.ids) == list(range(50))


# 2


def test_communication_matrix_has_exact_sums_and_means():
    counts, sizes = np.array([7, 0, 12, 5]), sharding.even_sizes(24, 5)
    rows = [np.stack([sharding.matrix_row(counts, sizes, p, seed) for p in range(4)]) for seed in range(400)]
    assert all((m.sum(axis=0) == sizes).all() and (m.sum(axis=1) == counts).all() for m in rows)
    assert np.allclose(np.mean(rows, axis=0), counts[:, None] * sizes[None, :] / 24, atol=0.25)


def test_shards_are_exact_gapless_and_keep_rows(spark, odd, none):
    out = sharding.shard(odd.repartition(3), 4).toPandas()
    assert sorted(out.columns) == sorted(["doc_id", "text", "_shard", "_Slot", "score", "failed", "component", "fp", "own_0", "_s", "_start", "_c", "N_Words", "cell", "text_key", "node", "made", "shard", "slot"])
    n = out.groupby("shard").slot.apply(sorted)
    assert all(list(s) == list(range(len(s))) for s in n) and max(map(len, n)) - min(map(len, n)) <= 1
    assert sorted(map(str, out.text)) == sorted(str(r.text) for r in odd.collect())
    assert sharding.shard(none, 3).isEmpty()
    again = sharding.shard(spark.range(1000).repartition(7), 5, seed=3).groupBy("shard").count().collect()
    assert [r["count"] for r in again] == [200] * 5


def test_large_tables_are_drawn_by_the_same_law():
    """Above the bound of numpy's sampler the matrix stays exact, and its entries have the law's mean and variance."""
    counts, sizes = np.array([800_000_000, 900_000_000, 300_000_000]), sharding.even_sizes(2_000_000_000, 3)
    rows = np.array([[sharding.matrix_row(counts, sizes, p, seed) for p in range(3)] for seed in range(300)])
    assert (rows.sum(axis=1) == sizes).all() and (rows.sum(axis=2) == counts).all()
    n, share = counts.sum(), sizes[0] / counts.sum()
    sd = np.sqrt(counts * share * (1 - share) * (n - counts) / (n - 1))
    assert (abs(rows[:, :, 0].mean(axis=0) - counts * share) < 4 * sd / np.sqrt(300)).all()
    assert (abs(rows[:, :, 0].std(axis=0) / sd - 1) < 0.15).all()


def test_own_hypergeometric_sampler_has_the_exact_law():
    from math import comb

    for good, bad, take in ((30, 50, 20), (5, 400, 60), (300, 200, 450)):
        low, high = max(0, take - bad), min(good, take)
        exact = np.array([comb(good, k) * comb(bad, take - k) / comb(good + bad, take) for k in range(low, high + 1)])
        assert np.allclose([np.exp(sharding.log_pmf(k, good, bad, take)) for k in range(low, high + 1)], exact, rtol=1e-9)
        rng, seen = np.random.default_rng(1), np.zeros(len(exact))
        for _ in range(4000):
            seen[sharding.large_draw(rng, good, bad, take) - low] += 1
        usual = exact * 4000 >= 5
        assert (((seen - exact * 4000) ** 2 / (exact * 4000))[usual]).sum() < 2.5 * usual.sum() + 10


# 3


def measured(text):
    w = [x for x in (text or "").replace("\n", " ").replace("\t", " ").split(" ") if x]
    grams = [tuple(w[i : i + 5]) for i in range(len(w) - 4)]
    hit = {i + k for i, g in enumerate(grams) if grams.count(g) > 1 for k in range(5)}
    lines = [x for x in (text or "").split("\n") if x.strip()]
    return len(w), sum(map(len, w)), sum((text or "").count(c) for c in "#*$%&|<>"), len(lines) - len(set(lines)), len(hit)


def test_rules_equal_brute_force_and_ablation_adds_up(spark, odd, none, small):
    texts = [t for t in ODD if t is None or len(t) < 20_000 and t.count(" ") < 1000] + ["a b c d e f a b c d e\na b", words(30, 2) + "\n" + words(30, 2), "# * $"]
    for t in texts:
        assert rules.measures(t)[:5] == measured(t), t
    docs = spark.read.parquet(f"{small}/documents.parquet")
    rows = rules.ledger(docs, keep=["doc_id"]).toPandas()
    for r in rules.ablation(rules.ledger(docs, keep=["doc_id"]), rules.STRICT).collect():
        bit = rules.BIT[r.rule]
        assert r.fails == (rows.failed & bit != 0).sum() and r.fails_only == (rows.failed == bit).sum() and r.kept_without == (rows.failed & ~bit == 0).sum()
    whole = rules.ledger(odd)
    assert whole.count() == odd.count() and {"_failed", "_N_Words", "failed", "n_words"} <= set(whole.columns)
    assert rules.kept(odd, rules.BASE).columns == odd.columns and rules.kept(none, rules.BASE).isEmpty()
    assert {r.doc_id for r in rules.kept(odd, rules.BASE).collect()} == {100, 101, 102, 103, 104, 105, 106, 107}


# 4


def judged(url, listed, default="allow"):
    host, path = "", ""
    if url and "://" in url:
        rest = url.split("://", 1)[1]
        cut = min((rest.find(c) for c in "/?#" if c in rest), default=len(rest))
        host, path = rest[:cut].lower(), rest[cut:].split("?")[0].split("#")[0]
    fits = [(len(h + p), len(h), h + p, v) for h, p, v in listed if (host == h or host.endswith("." + h)) and path.startswith(p)]
    best = max(fits, default=None)
    return (host, path, best[2], best[3]) if best else (host, path, None, default)


def test_urls_equal_brute_force(spark):
    rng = random.Random(1)
    hosts = ["a.com", "b.a.com", "c.net", "x.c.net", "com", "A.Com", "evilcom", ""]
    listed = [("com", "/en/", "block"), ("a.com", "/en/7", "allow"), ("c.net", "/", "block"), ("x.c.net", "/q", "allow"), ("net", "/zz", "block")]
    made = [f"http{'s' * rng.randint(0, 1)}://{rng.choice(hosts)}{rng.choice(['', '/', '/en/', '/en/77', '/q?x=/en/', '#/en/', '/zz/#a?b'])}" for _ in range(300)] + [None, "", "no scheme", "://", "x://y://z"]
    pages = spark.createDataFrame([(i, u, "clash") for i, u in enumerate(made)], "page_id bigint, url string, host string")
    for rules_ in (listed, []):
        got = {r.page_id: (r.host, r.path, r.rule, r.verdict) for r in urls.judge(pages, urls.entries(spark, rules_)).collect()}
        assert got == {i: judged(u, rules_) for i, u in enumerate(made)}


def test_urls_with_many_lengths_odd_rows_and_a_listed_set(spark):
    long = "/" + "p/" * 20_000
    listed = [("a.com", "/" + "x" * n, "block") for n in range(300)] + [("b.org", long, "block"), ("c.d", "/", "allow"), ("c.d", "/", "block")]
    made = ["http://a.com/" + "x" * 299, "http://s.a.com/x", "http://b.org" + long + "q", "http://" + "h." * 2000 + "c.d/", "http://e.f/n", "HTTPS://User@WWW.e.f:443//k/?#z", "http://a.com/y", None, ""]
    pages = spark.createDataFrame([(i, u, "v") for i, u in enumerate([*made, *made])], "page_id bigint, url string, verdict string")
    blocked = spark.createDataFrame([("http://e.f/k", 1), ("http://a.com/y", 1), (None, 1), ("http://zz/", 1)], "url string, key int")
    got = {r.page_id: (r.host, r.path, r.rule, r.verdict) for r in urls.judge(pages, urls.entries(spark, listed), blocked=blocked).collect()}
    plain = {i: judged(u, [x for x in listed if x != ("c.d", "/", "block")]) for i, u in enumerate([*made, *made])}
    hit = {i for i, u in enumerate([*made, *made]) if u and u.startswith("HTTPS")}
    assert got == {i: (*r[:3], "block") if i in hit else r for i, r in plain.items()}
    assert urls.judge(pages.limit(0), urls.entries(spark, listed)).isEmpty()


def test_bloom_passes_every_key_and_few_others(spark):
    keys = spark.range(2000).selectExpr("concat('k', id) as key")
    blocks = 2000 // urls.KEYS_PER_BLOCK
    filt = urls.bloom(keys, blocks)
    from pyspark.sql import functions as F

    for rows, low, high in ((keys, 2000, 2000), (spark.range(4000).selectExpr("concat('other', id) as key"), 0, 200)):
        hit = rows.withColumn("block", urls._block(F.col("key"), blocks)).join(filt, "block").where(urls.passes(F.col("key"), F.col("lanes"))).count()
        assert low <= hit <= high


# 5 and 9


def test_gam_learns_an_interaction_and_scores_by_tables():
    rng = np.random.default_rng(0)
    x = rng.standard_normal((1500, 4))
    y = ((x[:, 0] > 0) ^ (x[:, 1] > 0)).astype(float)
    model = gam.fit(x, y)
    assert ((model.score(x) > 0.5) == y).mean() > 0.9 and {0, 1} in [{i, j} for i, j, _ in model.pairs]
    flat = gam.fit(np.empty((0, 4)), np.empty(0))
    assert np.allclose(flat.score(x[:3]), 0.5)


def test_top_word_counts_all_words():
    top = gam.FEATURES.index("top_word")
    for text, share in ((" ".join(f"the x{i}" for i in range(800)), 0.5), (" ".join(f"x{i} the" for i in range(800)), 0.5), ("a " * 300 + " ".join(f"y{i}" for i in range(9700)), 0.03)):
        assert gam.features(text)[top] == share


def test_training_reads_whole_texts(spark):
    """Label 1 shows only past 60,000 characters."""
    calm = ["river stone", "green field", "paper cloud"]
    rows = [(i, f"{calm[i % 3]} {words(20, i)} " + "calm " * 12_500 + ("zorgblat ! ! ! !" * 500 if i % 2 else "calm"), i % 2) for i in range(120)]
    docs = spark.createDataFrame([r[:2] for r in rows], "doc_id bigint, text string")
    labels = spark.createDataFrame([(r[0], r[2], r[2]) for r in rows], "doc_id bigint, quality int, toxic int")
    machine, y = toxicity.train(docs, labels), np.array([r[2] for r in rows])
    assert ((machine.score(toxicity.Scorer(machine).worst([r[1] for r in rows])) > 0.5) == y).all()
    model = gam.train(docs, labels)
    assert ((model.score(gam.matrix([r[1] for r in rows])) > 0.5) == y).all()


def test_held_out_quality(spark, odd, none):
    sf = "/root/testdata/sf0.1"
    docs, labels = spark.read.parquet(f"{sf}/documents.parquet"), spark.read.parquet(f"{sf}/labels.parquet")
    model = gam.train(docs, labels, rows=2500)
    got = gam.score(docs, model, keep=["doc_id"]).join(labels, "doc_id").toPandas()
    rest = got[[zlib.crc32(str(i).encode()) % 5 == 0 for i in got.doc_id]]
    assert ((rest.score >= 0.3) == rest.quality).mean() > 0.97
    out = gam.score(odd, model).toPandas()
    assert len(out) == odd.count() and out.score.between(0, 1).all() and "_score" in out
    assert gam.good(odd, labels.limit(0)).columns == odd.columns and gam.score(none, model).isEmpty()


def test_folded_machine_equals_landmark_kernel():
    rng = np.random.default_rng(0)
    ws = ["moron", "mo-ron", "idiot", "table", "chair", "windowpane", "é", "a"]
    rows = toxicity.coded(ws)
    k = toxicity.kernel(rows, rows)
    assert np.allclose(k, k.T) and np.linalg.eigvalsh(k).min() > -1e-9
    assert k[0, 1] > 3 * k[0, 3]
    alpha, table = rng.standard_normal(len(ws)), np.zeros(toxicity.CODES**3)
    for weight, one in zip(alpha, toxicity.maps(rows), strict=True):
        for key, value in one.items():
            table[key] += weight * value
    machine = toxicity.Machine(table.astype(np.float32), 0.25, 1.0, 0.0)
    assert np.allclose(machine.words(ws), k @ alpha + 0.25, atol=1e-4)


def test_held_out_toxicity_and_inserted_characters(spark, odd, none):
    rng = random.Random(4)
    bad = ["moron", "idiot", "pathetic", "worthless"]
    rows = []
    for i in range(900):
        text = words(60, i).split()
        if i % 3 == 0:
            text.insert(rng.randrange(60), rng.choice(bad))
        rows.append((i, " ".join(text), int(i % 3 == 0)))
    texts, y = [r[1] for r in rows], np.array([r[2] for r in rows], dtype=float)
    machine = toxicity.fit(texts[:600], y[:600])
    scorer = toxicity.Scorer(machine)
    got = machine.score(scorer.worst(texts[600:])) >= 0.7
    assert (got == y[600:].astype(bool)).mean() > 0.98
    odd_forms = [words(40, 5) + " " + w for w in ("mor-on", "idi.ot", "pathe*tic", "worth-less", "m o r o n")]
    assert (machine.score(scorer.worst(odd_forms)) > machine.score(scorer.worst([words(40, 5)]))).all()
    out = toxicity.score(odd, machine).toPandas()
    assert len(out) == odd.count() and out.score.between(0, 1).all() and "_score" in out and toxicity.score(none, machine).isEmpty()


# 6 and 7


def test_chunks_give_the_tokenizer_s_ids():
    rng, e, t = random.Random(2), ChunkEncoder(queries.tokenizer_path(), 500), tokenizer()
    letters = "aAéÉßjJ \n\t'`ś \x01\x02<|endoftext|>中文1２İΣς\x1c\x85 'll 're☃ﬁ.,!?*$%&#̌क़क़éE"
    for k in range(600):
        text = "".join(rng.choice(letters) for _ in range(rng.randint(0, 60))) + (" <|endoftext|>. <|ENDOFTEXT|>" if k % 7 == 0 else "")
        assert e.encode([text])[0] == np.array(t.encode(text, add_special_tokens=False).ids, dtype="<u4").tobytes()


@pytest.mark.parametrize("shape", ["wide", "narrow", "tiny"])
def test_plan_covers_all_pieces_and_is_nearly_full(shape):
    rng = np.random.default_rng(1)
    lengths = {"wide": rng.integers(1, 257, 3000), "narrow": rng.integers(100, 140, 900), "tiny": np.array([256, 255, 1, 128, 64, 64])}[shape]
    counts = np.bincount(lengths, minlength=257)
    plan = packing.plan(counts, 256)
    used = np.zeros(257, dtype=int)
    for pattern, times in plan:
        assert sum(pattern) <= 256 and times > 0
        for x in pattern:
            used[x] += times
    assert (used == counts).all()
    if shape != "narrow":
        assert sum(t for _, t in plan) <= 1.02 * lengths.sum() / 256 + 2


def test_sums_find_every_combination_and_drop_spent_ones():
    rng = random.Random(6)
    for _ in range(60):
        free = [0] + [rng.choice([0, 0, 0, 1, 2]) for _ in range(30)]
        sums = packing.Sums(free)
        for _ in range(40):
            gap = rng.randint(1, 30)
            stock = [x for x in range(1, 31) for _ in range(free[x])]
            made = sums.exact(gap)
            assert (made is not None) == any(sum(c) == gap for k in (1, 2, 3) for c in combinations(stock, k))
            if made is not None:
                assert sum(made) == gap
                for x in made:
                    free[x] -= 1
            assert min(free) >= 0


def best_fit(lengths, size):
    gaps = []
    for x in sorted(lengths, reverse=True):
        fits = [g for g in gaps if g >= x]
        if fits:
            gaps.remove(min(fits))
        gaps.append((min(fits) if fits else size) - x)
    return len(gaps)


def first_fit(lengths, size):
    gaps = []
    for x in sorted(lengths, reverse=True):
        at = next((i for i, g in enumerate(gaps) if g >= x), None)
        if at is None:
            gaps.append(size - x)
        else:
            gaps[at] -= x
    return sorted(gaps)


def test_residual_is_best_fit_and_not_first_fit():
    rng, other = np.random.default_rng(4), 0
    for _ in range(150):
        lengths = rng.integers(1, 41, rng.integers(1, 60)).tolist()
        made = packing.plan(np.bincount(lengths, minlength=61), 60, combine=False)
        assert sum(n for _, n in made) == best_fit(lengths, 60)
        other += sorted(60 - sum(p) for p, n in made for _ in range(n)) != first_fit(lengths, 60)
    assert other > 20


def test_residual_gaps_are_filled_exactly():
    """No three pieces fill the gap beside 61; 18 leaves 21 of it, which 9, 7 and 5 fill."""
    plan = packing.plan(np.bincount([61, 18, 9, 7, 5], minlength=101), 100)
    assert sorted((sorted(p), n) for p, n in plan) == [([5, 7, 9, 18, 61], 1)]


def test_plan_of_real_lengths_is_close_to_the_bound(spark):
    docs = spark.read.parquet("/root/testdata/sf0.1/documents.parquet")
    encode = ChunkEncoder(queries.tokenizer_path()).encode
    sizes = [len(x) // 4 + 1 for x in encode([r.text for r in docs.select("text").collect()])]
    lengths = [x for n in sizes for x in [2048] * (n // 2048) + [n % 2048] if x]
    plan = packing.plan(np.bincount(lengths, minlength=2049), 2048)
    assert sum(n for _, n in plan) <= 1.001 * -(-sum(lengths) // 2048) + 1


def test_packing_renames_a_clashing_id(spark):
    rows = spark.createDataFrame([(1, "a b"), (None, None)], "Piece bigint, text string")
    out = packing.pack(rows, queries.tokenizer_path(), "Piece", size=8)
    assert out.columns[:2] == ["doc_id", "piece"] and {r.doc_id for r in out.collect()} == {1, None}


def test_packing_equals_plain_tokens(spark, odd, none):
    got = packing.pack(odd, queries.tokenizer_path(), size=64, end_id=0).toPandas()
    want = sorted((str(r.doc_id), plain_ids(r.text) + [0]) for r in odd.collect())
    assert got.length.sum() == sum(len(x) for _, x in want)
    pieces = sorted((str(None if d != d else int(d)), bytes(i)) for d, i in zip(got.doc_id, got.ids, strict=True))
    assert pieces == sorted((d, np.array(x[a : a + 64], dtype="<u4").tobytes()) for d, x in want for a in range(0, len(x), 64))
    for _, s in got.groupby("sequence_id"):
        s = s.sort_values("offset")
        assert (s.offset.to_numpy() == np.concatenate([[0], np.cumsum(s.length)[:-1]])).all() and s.length.sum() <= 64
    assert packing.pack(none, queries.tokenizer_path()).isEmpty()


def test_token_files_read_back(spark, odd, none, tmp_path):
    got = tokenbin.round_trip(odd, queries.tokenizer_path()).toPandas().sort_values("start")
    ids = [None if d != d else int(d) for d in got.doc_id]
    assert ids == sorted(ids, key=lambda d: (d is not None, d))
    assert (got.start.to_numpy() == np.concatenate([[0], np.cumsum(got.n_tokens)[:-1]])).all()
    want = sorted((str(r.doc_id), crc(plain_ids(r.text) + [2])) for r in odd.collect())
    assert sorted(zip(map(str, ids), got.ids_crc32, strict=True)) == want
    assert tokenbin.round_trip(none, queries.tokenizer_path()).isEmpty()


def test_container_gives_single_documents_and_checks_its_dictionary(spark, tmp_path):
    rng = np.random.default_rng(0)
    docs = [rng.integers(0, 500, rng.integers(1, 90)).astype("<u4").tobytes() for _ in range(300)]
    shared = tokenbin.train(docs)
    assert shared.data
    frames = [shared.compressor().compress(d) for d in docs]
    data = tokenbin.container(shared.digest, 17, list(range(300)), [len(d) // 4 for d in docs], frames)
    reader = tokenbin.Reader(data, shared)
    assert [reader.raw(i) for i in (0, 299, 150)] == [docs[0], docs[299], docs[150]] and reader.find(42) == [42] and reader.before == 17
    with pytest.raises(ValueError):
        tokenbin.Reader(data, tokenbin.Dictionary(b"x"))
    table = spark.createDataFrame([(i, words(30, i)) for i in range(60)], "doc_id bigint, text string")
    tokenbin.write(table, queries.tokenizer_path(), f"file://{tmp_path}/t")
    names = tokenbin.export(spark, f"file://{tmp_path}/t", f"{tmp_path}/out").collect()
    files = sorted(p for p in (tmp_path / "out").iterdir())
    assert len(files) == len(names) and sum(len(tokenbin.Reader(p.read_bytes(), tokenbin.load_dictionary(spark, f"file://{tmp_path}/t"))) for p in files) == 60


# 8


def fingerprint(text, width=3):
    w = [x for x in "".join(c.lower() if "A" <= c <= "Z" else c for c in (text or "")).replace("\n", " ").replace("\t", " ").split(" ") if x]
    if not w:
        return 0
    grams = [" ".join(w[i : i + width]) for i in range(len(w) - width + 1)] or [" ".join(w)]
    h = [xxhash.xxh64_intdigest(g.encode(), 42) for g in grams]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def groups_of(items, linked):
    root = {i: i for i in items}

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for a, b in combinations(items, 2):
        if linked(a, b):
            x, y = sorted((find(a), find(b)))
            root[y] = x
    return {i: find(i) for i in items}


def test_linked_pairs_equal_brute_force():
    rng = np.random.default_rng(3)
    base = rng.integers(0, 2**63, 120, dtype=np.uint64)
    near = base.copy()
    for _ in range(3):
        near ^= np.uint64(1) << rng.integers(0, 64, 120).astype(np.uint64)
    w = np.unique(np.concatenate([base, near, near ^ np.uint64(5), np.arange(200, dtype=np.uint64)]))
    left, right = simhash.linked_pairs(np.zeros(len(w), dtype=np.int64), w, (3,))
    assert (np.bitwise_count(w[left] ^ w[right]) <= 3).all()
    want = groups_of(range(len(w)), lambda a, b: int(np.bitwise_count(w[a] ^ w[b])) <= 3)
    assert len(w) - len(left) == len(set(want.values()))


@pytest.mark.parametrize("split", [4, 32_768])
def test_buckets_split_without_losing_links(spark, split):
    rng = np.random.default_rng(5)
    w = np.unique(np.concatenate([np.arange(300, dtype=np.uint64), rng.integers(0, 2**63, 60, dtype=np.uint64), (np.uint64(1) << np.arange(60, dtype=np.uint64))]))
    rows = spark.createDataFrame([(int(x), 0, int(x)) for x in w.view(np.int64)], "node bigint, salt int, word bigint")
    got = {r.node: r.root for r in simhash.components(simhash.near_pairs(rows, (3,), split)).collect()}
    want = groups_of([int(x) for x in w.view(np.int64)], lambda a, b: bin((a ^ b) & (2**64 - 1)).count("1") <= 3)
    sizes = {r: sum(v == r for v in want.values()) for r in set(want.values())}
    assert got == {i: r for i, r in want.items() if sizes[r] > 1 and i != r}


def test_near_duplicates_equal_brute_force(spark, odd, none):
    got = simhash.near_duplicates(odd).toPandas()
    texts = odd.select("doc_id", "text").collect()
    prints = [fingerprint(r.text) for r in texts]
    want = groups_of(range(len(texts)), lambda a, b: bin(prints[a] ^ prints[b]).count("1") <= 3)
    first = {}
    for i, r in enumerate(texts):
        if r.doc_id is not None:
            first[want[i]] = min(first.get(want[i], r.doc_id), r.doc_id)
    expect = sorted(str((r.doc_id, prints[i], first.get(want[i]))) for i, r in enumerate(texts))
    show = lambda v: None if v != v else int(v)
    assert sorted(str((show(a), int(b) & (2**64 - 1), show(c))) for a, b, c in got.itertuples(index=False)) == expect
    assert simhash.near_duplicates(none).isEmpty()


def test_similar_groups_keep_one_of_each(spark, odd, none):
    rows, rng = [], random.Random(1)
    for g in range(12):
        base = words(150, 1000 + g).split()
        for c in range(4):
            copy = list(base)
            for _ in range(c):
                copy[rng.randrange(150)] = "changed"
            rows.append((g * 10 + c, " ".join(copy), "keep"))
    docs = spark.createDataFrame([*rows, (None, rows[0][1], "x"), (500, rows[5][1], "x"), (500, rows[5][1], "x")], "doc_id bigint, text string, component string")
    kept = simhash.one_of_each(docs)
    found = kept.collect()
    sims = {(a, b): simhash.jaccard(rows[a][1], rows[b][1], 5) for a, b in combinations(range(len(rows)), 2)}
    want = groups_of(range(len(rows)), lambda a, b: sims[min(a, b), max(a, b)] >= 0.8)
    assert sorted(r.doc_id for r in found if r.doc_id is not None) == sorted({rows[v][0] for v in want.values()})
    assert kept.columns == docs.columns and simhash.one_of_each(none).isEmpty()
    assert simhash.one_of_each(odd).columns == odd.columns


def similar_brute(rows, least=0.8):
    sets = [set(simhash.shingle_hashes(t, 5).tolist()) for _, t in rows]
    return groups_of(range(len(rows)), lambda a, b: len(sets[a] & sets[b]) >= least * len(sets[a] | sets[b]))


def test_template_family_keeps_its_true_pairs(spark):
    """All texts share a passage (about 0.76 to each other); twins (above 0.8) must be found among them."""
    passage, rows = words(130, 77), []
    for i in range(150):
        tail = words(20, 5000 + i).split()
        rows += [(2 * i, f"{passage} {' '.join(tail)}"), (2 * i + 1, f"{passage} {' '.join(tail[:7])} {words(13, 9000 + i)}")]
    want = similar_brute(rows)
    assert len(set(want.values())) == 150
    got = {r.doc_id: r.component for r in simhash.similar_groups(spark.createDataFrame(rows, "doc_id bigint, text string")).collect()}
    lost = [i for i in want if got[i] != want[i]]
    assert len(lost) <= 3, lost


def test_large_buckets_lose_no_candidates_at_wide_radius(spark):
    """Words of one bucket, 14 bits apart by pairs and spread over all blocks but the first, are found with and without blocks of rows."""
    rng, rows, want = np.random.default_rng(8), [], {}
    for i in range(60):
        word = (int(rng.integers(0, 2**48)) << 16) | 7
        twin = word ^ sum(1 << int(b) for b in rng.choice(np.arange(16, 64), 14, replace=False))
        rows += [(2 * i, 0, simhash._signed(word)), (2 * i + 1, 0, simhash._signed(twin))]
        want[2 * i + 1] = 2 * i
    nodes = spark.createDataFrame(rows, "node bigint, salt int, word bigint")
    for split in (10, 32_768):
        roots = simhash.verified_roots(nodes, lambda pairs: pairs.where("floor(a / 2) = floor(b / 2)"), (2, 5, 9, 14), split)
        assert {r.node: r.root for r in roots.collect()} == want


@pytest.mark.parametrize("size", [3, 40, 700])
def test_bitmaps_refuse_no_similar_pair_and_most_others(size):
    rng, refused, far, sets, said = np.random.default_rng(size), 0, 0, [], []
    for _ in range(400):
        a = np.unique(rng.integers(0, 2**63, size, dtype=np.uint64))
        keep = a[rng.random(len(a)) < rng.uniform(0.5, 1)]
        b = np.unique(np.concatenate([keep, rng.integers(0, 2**63, rng.integers(0, size), dtype=np.uint64)]))
        may, sim = simhash.may_reach(len(a), simhash.bitmap(a), len(b), simhash.bitmap(b), 0.8), simhash.alike(a, b)
        assert may or sim < 0.8
        sets, said = [*sets, a, b], [*said, may]
        refused, far = refused + (not may), far + (sim < 0.7)
    assert refused >= 0.9 * far
    maps = simhash.Bitmaps(np.array(list(map(len, sets))), np.array([simhash.bitmap(x) for x in sets], dtype=object))
    assert maps.may_reach(np.arange(0, 800, 2), np.arange(1, 800, 2), 0.8).tolist() == said


def test_large_family_of_graded_variants_is_grouped_exactly(spark):
    """400 variants of one text, three to nine words replaced in each: groups by links that pruning must not lose."""
    rng, base, rows = random.Random(11), words(300, 4242).split(), []
    for i in range(400):
        copy = list(base)
        for at in rng.sample(range(300), rng.randint(3, 9)):
            copy[at] = f"w{i}x{at}"
        rows.append((i, " ".join(copy)))
    want = similar_brute(rows)
    got = {r.doc_id: r.component for r in simhash.similar_groups(spark.createDataFrame(rows, "doc_id bigint, text string")).collect()}
    assert sum(got[i] != want[i] for i in want) <= 4 and len(set(got.values())) <= len(set(want.values())) + 4


def test_recall_of_all_pairs_of_documents(spark):
    """Against all pairs of sf0.01 that reach 0.8: at least 0.99 of them end in one group, and no group is too large."""
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "text")
    rows = [(r.doc_id, r.text) for r in docs.collect()]
    want = similar_brute(rows)
    got = {r.doc_id: r.component for r in simhash.similar_groups(docs).collect()}
    together = [(a, b) for a, b in combinations(sorted(want), 2) if want[a] == want[b]]
    joined = sum(got[rows[a][0]] == got[rows[b][0]] for a, b in together)
    assert len(together) > 20 and joined >= 0.99 * len(together)
    assert len(set(got.values())) >= len(set(want.values()))


def test_forest_pairs_join_words_only_across_roots():
    """Whatever pair of different roots within the radius is no pair of the forest has both words among the crowded."""
    rng = np.random.default_rng(21)
    centres = rng.integers(0, 2**63, 12, dtype=np.uint64)
    flips = np.array([sum(1 << int(b) for b in rng.choice(64, 3, replace=False)) for _ in range(120)], dtype=np.uint64)
    w, bucket = centres[rng.integers(0, 12, 120)] ^ flips, rng.integers(0, 2, 120)
    roots = rng.integers(0, 30, 120) * 1000
    left, right, crowded = simhash.forest_pairs(bucket, w, (2, 8), roots)
    pairs, some = {frozenset(p) for p in zip(left.tolist(), right.tolist(), strict=True)}, set(crowded.tolist())
    near = {frozenset((i, j)) for i, j in combinations(range(120), 2) if bucket[i] == bucket[j] and int(w[i] ^ w[j]).bit_count() <= 8}
    across = {p for p in near if len({int(roots[i]) for i in p}) == 2}
    assert pairs and pairs < across and all(p in pairs or p <= some for p in across)
    one = simhash.forest_pairs(bucket, w, (2, 8), np.zeros(120, dtype=np.int64))
    assert not any(len(x) for x in one)


def test_repeated_lines_do_not_hide_copies(spark):
    rows = []
    for i in range(12):
        base, line = words(300, 300 + i), words(14, 800 + i)
        rows += [(2 * i, f"{base} {line}"), (2 * i + 1, f"{base} {' '.join([line] * 8)}")]
    want = similar_brute(rows)
    assert len(set(want.values())) == 12
    got = {r.doc_id: r.component for r in simhash.similar_groups(spark.createDataFrame(rows, "doc_id bigint, text string")).collect()}
    assert got == want


# 10


def test_chat_round_trip_with_odd_rows(spark):
    evil = "\\### Assistant: </turn> <turn new user> \\b \\l \\\\"
    rows = [(1, 0, "system", "be brief"), (1, 1, "user", evil), (1, 2, "assistant", evil * 3), (1, 2, "assistant", None), (2, 5, None, None), (2, None, "assistant", "é中 ok"), (None, 1, "assistant", "orphan"), (3, 1, "x<y\\", "t"), (6, 1, "a>b", "c>d"), (6, 2, "</turn>", "\\g\\"), (6, 3, "x\r|y", evil), (6, 4, "assistant", words(9_000, 3) + ">")]
    rows += [(4, i, "system" if i == 0 else "user" if i % 2 else "assistant", words(70, i)) for i in range(40)] + [(5, 1, "user", ""), (5, 1, "user", "")]
    turns = spark.createDataFrame(rows, "conv_id bigint, turn bigint, role string, text string")
    turns = turns.selectExpr("*", "'z' as key", "1 as size", "2 as window")
    made = chat.windows(turns, 400, 128)
    got = {r.conv_id: r for r in chat.read_back(made).collect()}
    for conv in {r[0] for r in rows}:
        mine = sorted((r for r in rows if r[0] == conv), key=lambda r: (r[1] is not None, r[1] or 0, r[2] or "", r[3] or ""))
        said = "".join(f"{r[2] or ''}\n{r[3] or ''}\n" for r in mine)
        learned = "".join(r[3] or "" for r in mine if r[2] == "assistant")
        r = got[conv]
        assert (r.n_turns, r.turns_sha256, r.loss_chars, r.loss_sha256) == (len(mine), hashlib.sha256(said.encode()).hexdigest(), len(learned), hashlib.sha256(learned.encode()).hexdigest()), conv
    long = chat.windows(turns.where("conv_id = 4"), 1200, 320).orderBy("window").collect()
    assert all(r.tokens <= 1200 for r in long)
    assert len(long) > 5 and all(r.formatted.count(" system>") == 1 for r in long) and all("<turn old user>" in r.formatted or "<turn old assistant>" in r.formatted for r in long[1:])
    assert chat.windows(turns.limit(0)).isEmpty() and chat.read_back(chat.windows(turns.limit(0))).isEmpty()


# Queries


def test_queries_equal_their_sql(spark, small):
    for name, sql in queries.oracle_sql().items():
        assert_same(queries.queries()[name](spark, small).toPandas(), oracle(sql, small))


def test_pipeline_stages(spark, small):
    import corpus_pipeline as p

    docs = spark.read.parquet(f"{small}/documents.parquet")
    labels = spark.read.parquet(f"{small}/labels.parquet")
    bench = [r.text for r in spark.read.parquet(f"{small}/benchmark.parquet").collect()]
    model = gam.train(docs, labels)
    rows = [(r.doc_id, r.text) for r in docs.orderBy("doc_id").collect()]
    rows = [r for r in rows if model.score(gam.matrix([r[1]]))[0] >= 0.3]
    names = dict(zip(rules.MEASURES, range(len(rules.MEASURES)), strict=True))

    def fails(text):
        m = rules.measures(text)
        return any(eval(rule, {}, {n: m[i] for n, i in names.items()}) for rule in rules.RULES.values())  # noqa: S307

    rows = [r for r in rows if not fails(r[1])]
    same = groups_of(range(len(rows)), lambda a, b: simhash.jaccard(rows[a][1], rows[b][1], 5) >= 0.8)
    rows = [rows[i] for i in sorted(set(same.values()))]
    held = [decontam.words(b) for b in bench]

    def leaks(text):
        w = decontam.words(text)
        grams = {tuple(w[i : i + 5]) for i in range(len(w) - 4)}
        return any(len(b) >= 5 and any(tuple(b[i : i + 5]) in grams for i in range(len(b) - 4)) and tiling(b, w, 5) / len(b) >= 0.5 for b in held)

    rows = [r for r in rows if not leaks(r[1])]
    got = p.run(spark, small).toPandas()
    want = {(d, k): crc((plain_ids(t) + [0])[k * 2048 : (k + 1) * 2048]) for d, t in rows for k in range(-(-(len(plain_ids(t)) + 1) // 2048))}
    assert {(r.doc_id, r.piece): r.ids_crc32 for r in got.itertuples()} == want
    assert (got.groupby("sequence_id").length.sum() <= 2048).all()


def test_packing_cuts_text_in_small_slices_and_frees_the_encoder():
    """Memory of a worker in the packing stages: text by megabyte, and no encoder once all pieces are made."""
    import pyarrow as pa

    from mnemospark.llm import common, packing, tokens

    texts = ["a" * 300] * 10 + [None, "b" * 5000]
    runs = list(common.slices(pa.array(texts), 1000))
    assert [t for _, _, part in runs for t in part] == texts and max(hi - lo for lo, hi, _ in runs) == 4
    assert packing.ENCODE_BYTES < common.SLICE_BYTES and packing.BATCH_ROWS < 10_000
    tokens._READY[("x", 1)] = None
    tokens.forget()
    assert not tokens._READY
