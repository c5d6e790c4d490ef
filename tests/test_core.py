"""Operators against numpy, and the fixed behaviour of learning and consolidation."""

from __future__ import annotations

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from mnemospark.config import Limits, MemoryConfig
from mnemospark.functions import spectral, vec
from mnemospark.functions.permutation import Permutation
from mnemospark.operators import activation, algebra, attention, audit, consolidation, documents, reads, stats, writes
from mnemospark.operators.writes import Codebook, Gate
from mnemospark.sources import catalog, tables

D = 16


def unit(v):
    return v / np.linalg.norm(v, axis=-1, keepdims=True)


def one(spark, column, **values):
    """The value of a column expression over one row of vectors."""
    row = spark.createDataFrame([tuple(values.values())], ", ".join(f"{k} array<double>" for k in values))
    return row.select(column.alias("x")).first().x


def book_of(spark, address, counter=None, count=None):
    counter = address if counter is None else counter
    count = np.ones(len(address)) if count is None else count
    return spark.createDataFrame([(i, list(map(float, a)), list(map(float, c)), float(n)) for i, (a, c, n) in enumerate(zip(address, counter, count, strict=True))], activation.LOCATION)


def asks_of(spark, vectors):
    return spark.createDataFrame([(i, list(map(float, v))) for i, v in enumerate(vectors)], "qid bigint, query array<double>")


@pytest.fixture(scope="module")
def cloud():
    rng = np.random.default_rng(7)
    address = unit(rng.standard_normal((60, D)))
    address[10] = address[3]
    return address, rng.standard_normal((60, D)), rng.integers(1, 9, 60).astype(float), rng.standard_normal((5, D))


def test_scalar_functions(spark):
    a, b = [3.0, 4.0, 0.0], [1.0, 0.0, 2.0]
    assert one(spark, vec.dot("a", "b"), a=a, b=b) == 3.0 and one(spark, vec.norm("a"), a=a) == 5.0
    assert np.allclose(one(spark, vec.normalize("a"), a=a), [0.6, 0.8, 0]) and one(spark, vec.normalize("a"), a=[0.0, 0.0]) == [0.0, 0.0]
    assert one(spark, vec.cosine("a", "b"), a=[0.0, 0.0], b=[1.0, 1.0]) == 0.0
    assert one(spark, vec.softmax("a"), a=[]) == [] and one(spark, vec.softmax("a"), a=[float("inf"), 1.0]) == [0.5, 0.5]
    assert np.allclose(one(spark, vec.softmax("a", 2.0), a=[0.0, 1.0]), np.exp([0, 2]) / np.exp([0, 2]).sum())
    assert np.allclose(one(spark, vec.logsumexp("a", 5.0), a=[0.1, 0.2]), np.log(np.exp(5 * np.array([0.1, 0.2])).sum()))
    assert one(spark, vec.involve("a"), a=[1.0, 2.0, 3.0, 4.0]) == [1.0, 4.0, 3.0, 2.0] and one(spark, vec.involve("a"), a=[1.0]) == [1.0]
    assert one(spark, vec.pattern("a", F.lit(3.0)), a=[3.0, 6.0]) == [1.0, 2.0] and one(spark, vec.pattern("a", F.lit(0.0)), a=[3.0, 6.0]) == [0.0, 0.0]
    assert one(spark, vec.finite("a"), a=[1.0, float("nan")]) is False
    assert one(spark, vec.entropy("a"), a=[0.5, 0.5]) == pytest.approx(1.0) and one(spark, vec.entropy("a"), a=[1.0]) == 0.0
    with pytest.raises(Exception, match="NaN"):
        one(spark, vec.checked("a", 2), a=[1.0, float("nan")])


def test_convolution_laws(spark):
    rng = np.random.default_rng(1)
    a, b = (unit(rng.standard_normal(D)).tolist() for _ in range(2))
    slow = np.array([sum(a[i] * b[(k - i) % D] for i in range(D)) for k in range(D)])
    assert np.allclose(one(spark, vec.convolve("a", "b"), a=a, b=b), slow) and np.allclose(one(spark, spectral.bind(F.col("a"), F.col("b"), False), a=a, b=b), slow)
    assert np.allclose(one(spark, vec.correlate("a", "b"), a=a, b=b), one(spark, spectral.unbind(F.col("a"), F.col("b")), a=a, b=b))
    assert np.allclose(one(spark, spectral.unbind_exact(spectral.bind(F.col("a"), F.col("b"), False), F.col("b")), a=a, b=b), a)
    assert np.allclose(spectral.power_rows(np.array(a), 1.5 + 0.5), spectral.power_rows(spectral.power_rows(np.array(a), 1.0), 2.0))
    fa, fb = np.fft.rfft(a), np.fft.rfft(b)
    assert spectral.hermitian_inner(fa, fb, D) == pytest.approx(float(np.dot(a, b)))


def test_permutations():
    p = Permutation.from_name(D, "next")
    v = np.random.default_rng(2).standard_normal(D)
    assert p.power(3).power(-1).indices == p.power(-3).indices and p.power(0).indices == tuple(range(D))
    assert np.allclose(p.rotation(0) @ v, v) and np.allclose(p.rotation(1.0) @ v, v[list(p.indices)])
    odd = Permutation((1, 2, 0, 4, 5, 3, 6))
    assert np.allclose(odd.rotation(0.3) @ odd.rotation(0.7), odd.rotation(1.0)) and sorted(map(len, odd.cycles())) == [1, 3, 3]
    with pytest.raises(ValueError):
        Permutation((0, 0))


def test_query_hash_is_fnv1a(spark):
    assert spectral.query_hash_of(np.array([])) == "cbf29ce484222325"
    assert one(spark, spectral.query_hash(F.col("a")), a=[1.0, 2.0]) == spectral.query_hash_of(np.array([1.0, 2.0]))


@pytest.mark.parametrize("strategy", ["matmul", "sql"])
def test_activation_is_exact_with_ties(spark, cloud, strategy):
    address, counter, count, q = cloud
    got = activation.activate(asks_of(spark, q), book_of(spark, address, counter, count).repartition(5), 7, strategy).orderBy("qid", "rk").collect()
    sims = unit(q) @ address.T
    for i in range(len(q)):
        assert [r.loc_id for r in got if r.qid == i] == np.lexsort((np.arange(60), -np.round(sims[i], 12)))[:7].tolist()


def test_activation_blocks_subsets_and_bars(spark, cloud):
    address, _, _, q = cloud
    book, asks = book_of(spark, address), asks_of(spark, q)
    whole = [(r.qid, r.loc_id) for r in activation.activate(asks, book, 5).orderBy("qid", "rk").collect()]
    assert whole == [(r.qid, r.loc_id) for r in activation.activate(asks, book, 5, block=2).orderBy("qid", "rk").collect()]
    barred = spark.createDataFrame(whole, "qid bigint, loc_id bigint")
    assert not {(r.qid, r.loc_id) for r in activation.activate_without(asks, book, barred, 5).collect()} & set(whole)
    near = {r.loc_id: r.nn_id for r in activation.nearest_neighbors(book).collect()}
    assert near[3] == 10 and near[10] == 3
    assert [r.idx for r in activation.id_lookup(book).orderBy("loc_id").collect()] == list(range(60))


@pytest.mark.parametrize("strategy", ["matmul", "sql"])
def test_barred_locations_do_not_widen_the_search(spark, cloud, monkeypatch, strategy):
    """Almost all locations are barred; every query still gets its best k of the rest, by a search for k."""
    address, _, _, q = cloud
    wide, plain = [], activation.activate
    monkeypatch.setattr(activation, "activate", lambda a, b, k=20, *x, **y: wide.append(k) or plain(a, b, k, *x, **y))
    barred = [(i, j) for i in range(5) for j in range(60) if (i + j) % 7] + [(99, 0), (0, 999)]
    got = activation.activate_without(asks_of(spark, q), book_of(spark, address).repartition(3), spark.createDataFrame(barred, "qid bigint, loc_id bigint"), 4, strategy=strategy, block=2).orderBy("qid", "rk").collect()
    sims = unit(q) @ address.T
    for i in range(5):
        left = [j for j in range(60) if (i + j) % 7 == 0]
        assert [r.loc_id for r in got if r.qid == i] == sorted(left, key=lambda j: (-round(sims[i, j], 12), j))[:4]
    assert wide == [4]


def test_sql_strategy_takes_a_codebook_of_any_size(spark):
    n = 60_000
    book = spark.range(n).selectExpr("id as loc_id", "array(cos(id % 40000), sin(id % 40000)) as address", "array(1d, 2d) as counter", "1d as write_count")
    asks = asks_of(spark, [[1.0, 0.0], [-0.3, 2.0]])
    got = activation.activate(asks, book, 6, "sql").orderBy("qid", "rk").collect()
    at = np.arange(n) % 40000
    sims = unit(np.array([[1.0, 0.0], [-0.3, 2.0]])) @ np.stack([np.cos(at), np.sin(at)])
    for i in range(2):
        assert [r.loc_id for r in got if r.qid == i] == np.lexsort((np.arange(n), -np.round(sims[i], 13)))[:6].tolist()


def hopfield(q, address, pattern, k, beta, t_max, epsilon=1e-6):
    xi = unit(q)
    at = np.argsort(-(address @ xi), kind="stable")[:k]
    for step in range(1, t_max + 1):
        s = np.array([xi @ a / np.linalg.norm(a) / np.linalg.norm(xi) for a in address[at]])
        w = np.exp(beta * (s - s.max()))
        new = unit((w / w.sum()) @ pattern[at])
        done = xi @ new > 1 - epsilon
        xi = new
        if done:
            break
    return xi, step


def test_reads_equal_numpy(spark, cloud):
    address, counter, count, q = cloud
    book, asks, raw = book_of(spark, address, counter, count), asks_of(spark, q), counter / count[:, None]
    fast = {r.qid: r.result for r in reads.read_fast(asks, book, 8, 5.0).collect()}
    slow = {r.qid: r for r in reads.read_iterative(asks, book, 8, 5.0).collect()}
    for i in range(len(q)):
        assert np.allclose(fast[i], hopfield(q[i], address, raw, 8, 5.0, 1)[0])
        want, steps = hopfield(q[i], address, unit(raw), 8, 5.0, 10)
        assert np.allclose(slow[i].result, want) and slow[i].iterations == steps
    parts = reads.analyze(asks, book, "iterative", 8, 5.0).groupBy("qid").agg(F.sum("weight").alias("w")).collect()
    assert all(p.w == pytest.approx(1) for p in parts)
    blend = reads.compose_read(asks, {"a": book.where("loc_id < 30"), "b": book.where("loc_id >= 30")}, k=8).first()
    assert sum(blend.weights.values()) == pytest.approx(1) and np.linalg.norm(blend.result) == pytest.approx(1)
    with pytest.raises(ValueError):
        reads.compose_read(asks, {"a": book})


def test_fingerprint_by_key_equals_one_by_one(spark, cloud):
    address, counter, count, _ = cloud
    book = book_of(spark, address, counter, count).withColumn("g", F.col("loc_id") % 2)
    both = {r.g: r.fingerprint for r in reads.fingerprint(book, 8, key="g").collect()}
    for g in (0, 1):
        assert np.allclose(both[g], reads.fingerprint(book.where(F.col("g") == g), 8).first().fingerprint)


def test_attention_equals_numpy(spark, cloud):
    address, counter, count, q = cloud
    count = count.copy()
    count[5] = 0
    book, asks = book_of(spark, address, counter, count), asks_of(spark, q)
    got = {r.qid: r for r in attention.read_attention(asks, book, 60, 3.0).collect()}
    for i in range(len(q)):
        with np.errstate(divide="ignore"):
            logit = 3.0 * address @ q[i] + np.log(count)
        w = np.exp(logit - logit.max())
        w /= w.sum()
        assert np.allclose(got[i].result, w @ np.where(count[:, None] > 0, counter / np.maximum(count, 1)[:, None], 0))
        assert got[i].contributors[0].loc_id == int(np.argmax(w))
    loo = {r.qid: r.result for r in attention.read_attention_loo(asks, book, 4, 3.0).collect()}
    first = {r.qid: r.loc_id for r in activation.top_location(asks, book).collect()}
    bar = asks.join(spark.createDataFrame(list(first.items()), "qid bigint, exclude bigint"), "qid")
    again = {r.qid: r.result for r in attention.read_attention(bar, book, 4, 3.0).collect()}
    assert all(np.allclose(loo[i], again[i]) for i in loo)


def test_bandwidth_follows_the_spread_of_keys(spark):
    eye = np.eye(D)
    close = unit(np.stack([eye[0] + 0.05 * eye[i + 1] for i in range(5)]))
    rows = spark.createDataFrame([(0, [eye[0].tolist(), eye[1].tolist()]), (1, close.tolist()), (2, [eye[0].tolist()])], "qid int, keys array<array<double>>")
    beta = {r.qid: r.beta for r in attention.select_beta(rows, "keys", D).collect()}
    assert beta[1] > beta[0] and beta[2] == 5.0
    assert documents._beta(close, 5.0) == pytest.approx(beta[1])
    assert attention.calibrate_beta(book_of(spark, eye[:1])).first() == (5.0, 0.0)
    assert attention.calibrate_beta(book_of(spark, eye[:3]), betas=[]).first().description_length == float("inf")


def test_learning_fixed_behaviour():
    config, eye = MemoryConfig(D, k=4), np.eye(D)
    book = Codebook(config)
    assert book.write(3 * eye[0]) == [0] and np.allclose(book.address[0], eye[0]) and np.allclose(book.counter[0], 3 * eye[0])
    before = book.address[:1].copy(), book.counter[:1].copy(), book.count[:1].copy()
    assert book.write(eye[1]) == [0, 1]
    assert all(np.array_equal(x, y) for x, y in zip(before, (book.address[:1], book.counter[:1], book.count[:1]), strict=True))
    book.write(unit(eye[0] + 0.2 * eye[2]))
    assert book.size == 2 and book.count[0] > 1 and book.eta == pytest.approx(0.01 * 0.9999**2)
    for _ in range(12):
        book.write(eye[0])
    assert book.size >= 3 and book.next_id == book.size
    plain = Codebook(config.but(competitive=False))
    assert [plain.write(2 * eye[0]), plain.write(2 * eye[0])] == [[0], [1]] and np.allclose(plain.address[1], 2 * eye[0])


def test_gate_joins_by_counter_only():
    eye, book, gate = np.eye(D), Codebook(MemoryConfig(D)), Gate(0.3, 0.2)
    for i in (1, 1, 2):
        book.write(eye[0], eye[i], gate)
    assert book.size == 2 and book.count[0] == 2 and np.allclose(book.counter[0], 2 * eye[1])


def test_learn_by_collection_resumes_from_state(spark):
    rng = np.random.default_rng(3)
    rows = [(c, i, unit(rng.standard_normal(D)).tolist()) for c in "ab" for i in range(40)]
    table = spark.createDataFrame(rows, "collection string, seq bigint, vector array<double>")
    config = MemoryConfig(D, k=5)
    learned = writes.learn(table.repartition(4), config)
    for c in "ab":
        book = Codebook(config, c)
        for name, _, v in rows:
            if name == c:
                book.write(np.array(v))
        got = writes.locations_of(learned).where(F.col("collection") == c).orderBy("loc_id").toPandas()
        assert np.allclose(np.stack(got.address.to_numpy()), book.address[: book.size]) and np.allclose(got.write_count, book.count[: book.size])
    docs, posted = writes.documents_of(learned)
    assert docs.count() == 80 and posted.select("collection", "doc_id").distinct().count() == 80
    more = writes.learn(table.where("seq < 5"), config, start=writes.locations_of(learned))
    assert writes.locations_of(more).count() >= writes.locations_of(learned).count()


def test_merging_fixtures(spark):
    address = np.array([[1.0, 0, 0], unit(np.array([1.0, 0.01, 0])), [0, 1.0, 0]])
    kept, gone = consolidation.knn_merge(book_of(spark, address, count=[5, 3, 0]), MemoryConfig(3, tau_merge=0.9))
    assert sorted(r.write_count for r in kept.collect()) == [0.0, 8.0] and gone.count() == 1
    assert consolidation.knn_merge(book_of(spark, np.eye(3)), MemoryConfig(3, tau_merge=0.99))[0].count() == 3
    posted = spark.createDataFrame([(0, 7), (1, 7), (1, 8), (2, 9)], "loc_id bigint, doc_id bigint")
    moved = consolidation.merge_postings(posted, gone)
    assert moved.select("loc_id").distinct().count() == 2 and moved.count() == 3
    assert consolidation.resolved({1: 2, 2: 5, 9: 1}) == {1: 5, 2: 5, 9: 5}


def test_neighbor_cap_counts_the_whole_codebook():
    """1,000 locations, one edge: the cap is (k - 1) * ceil(ln 1000) = 28, not that of the two that merge."""
    rows = pd.DataFrame([(i, [1.0, 0.0], [1.0, 0.0], 1.0, list(range(10 + i, 70 + i)), 0.0) for i in (1, 2)], columns=["loc_id", "address", "counter", "write_count", "neighbors", "surprise_mass"])
    config = MemoryConfig(2, k=5)
    assert config.neighbor_cap
    left, gone = consolidation._fold(rows, [(1, 2, 0.99)], config, 1000)
    assert gone == {2: 1} and len(left.neighbors[0]) == 28


def test_connected_labels_each_component_by_its_least(spark):
    edges = [(i, i + 1) for i in range(1, 40)] + [(100, 103), (103, 101), (7, 7), (200, 200)]
    got = {r.loc_id: r.g for r in consolidation.connected(spark.createDataFrame(edges, "a bigint, b bigint")).collect()}
    assert got == {**{i: 1 for i in range(1, 41)}, 100: 100, 101: 100, 103: 100, 200: 200}
    assert consolidation.connected(spark.createDataFrame([], "a bigint, b bigint")).isEmpty()


def test_graph_search_follows_a_long_chain_to_its_end(spark):
    """Each location knows only the next one, 30 steps along a quarter circle; a search from the far end must walk all."""
    at = np.linspace(0, np.pi / 2, 31)
    book = book_of(spark, np.stack([np.cos(at), np.sin(at)], axis=1), count=[100] + [1] * 30).withColumn("neighbors", F.array(F.col("loc_id") + 1))
    found = activation.graph_activate(asks_of(spark, [[0.0, 1.0]]), book, 1, landmarks=1).collect()
    assert [r.loc_id for r in found] == [30]


def test_graph_search_makes_the_neighbour_lists_once(spark, cloud):
    made = spark.sparkContext.accumulator(0)

    def count(batches):
        for b in batches:
            made.add(len(b))
            yield b

    graph = activation.with_neighbors(book_of(spark, cloud[0]), 5)
    graph = graph.mapInPandas(count, graph.schema)
    assert activation.graph_activate(asks_of(spark, cloud[3]), graph, 5, landmarks=3).count() == 25
    assert made.value == 60


def test_compression_finds_three_clusters(spark):
    rows = []
    for axis in (0, 4, 8):
        for push in (0.0, 0.01):
            v = np.eye(D)[axis].copy()
            v[1] += push
            rows.append(unit(v))
    kept, gone = consolidation.compress(book_of(spark, np.array(rows)), float(D), 30.0)
    assert kept.count() == 3 and gone.count() == 3
    before, after = (consolidation.description_length(x, float(D)).first().dl for x in (book_of(spark, np.array(rows)), kept))
    assert after < before


def test_dream_keeps_groups_and_ladder_separates_families(spark):
    eye = np.eye(D)
    near = unit(eye[0] + 0.05 * eye[5])
    book = book_of(spark, np.stack([eye[0], near, eye[1], eye[2]])).withColumn("collection", F.lit("x"))
    out = consolidation.dream(book, MemoryConfig(D)).toPandas()
    assert 3 <= len(out) <= 4 and all((np.stack(out.address.to_numpy()) @ e).max() > 0.9 for e in eye[:3])
    rng = np.random.default_rng(1)
    context, keys = unit(rng.standard_normal(256)), unit(rng.standard_normal((2, 256)))
    rows = []
    for i in range(10):
        law = unit(keys[i % 2] + 0.15 * unit(rng.standard_normal(256)))
        rows.append((i, context, spectral.bind_rows(context, law), 1.0))
    made = consolidation.ladder(pd.DataFrame(rows, columns=["loc_id", "address", "counter", "write_count"]), MemoryConfig(256), 1, 0.5, 0.2, "base")
    assert made[0]["after"] == 2 and made[0]["name"] == "base__L1"
    v = np.array([0.9, 0.88, 0.2, 0.1])
    frame = spark.createDataFrame([(float(x),) for x in v], "value double")
    assert consolidation.top_gap_threshold(frame).first().tau == pytest.approx(consolidation.gap_of(v))
    assert consolidation.otsu_threshold(frame).first().tau == pytest.approx(consolidation.otsu_of(v)) == pytest.approx(0.54)


def test_algebra(spark):
    rng = np.random.default_rng(4)
    config = MemoryConfig(D)
    a, b = (algebra.full_state(book_of(spark, unit(rng.standard_normal((4, D))))) for _ in range(2))
    none = a.limit(0)
    assert algebra.add(a, none, config).count() == 4 and algebra.subtract(none, b, config).first().counter == algebra.negate(b).first().counter
    total = algebra.add(a, b, config, merge=False)
    assert total.count() == 16 and sorted(r.loc_id for r in total.collect()) == list(range(16))
    assert algebra.add(a, b, config, cross_k=2, merge=False).count() == 8
    with pytest.raises(ValueError):
        algebra.add(a, b, config, most=10)
    with pytest.raises(ValueError):
        algebra.scale(a, 0.0)
    both = algebra.Snapshot(a, config)
    assert np.allclose((-both).locations.first().counter, -np.array(a.first().counter)) and np.allclose((2 * both).locations.first().counter, 2 * np.array(a.first().counter))
    assert algebra.intersect(a, a).count() == 4 and algebra.intersect(a, b, 0.999).count() == 0
    p = Permutation.from_seed(D, 1)
    back = algebra.permute(algebra.permute(a, p, 3), p, -3)
    assert np.allclose(back.orderBy("loc_id").first().counter, a.orderBy("loc_id").first().counter)


@pytest.mark.parametrize("block", [50_000, 7])
def test_products_number_all_pairs_in_order_without_the_short_ones(spark, monkeypatch, block):
    """More pairs than the default limit allows, in one block of b and in several; a copy of b's rows in a leaves gaps."""
    monkeypatch.setattr(algebra, "RIGHT_BLOCK", block)
    rng = np.random.default_rng(11)
    x, y = (unit(rng.standard_normal((n, D))) for n in ((600, 500) if block > 10 else (30, 20)))
    x[3], x[7] = y[2], y[9]
    x[11] = y[5] = 0
    a, b = book_of(spark, x), book_of(spark, y)
    with pytest.raises(ValueError):
        algebra.subtract(a, b, MemoryConfig(D), most=10, merge=False)
    want = {"subtract": x[:, None] - y[None], "add": x[:, None] + y[None], "bind": np.fft.irfft(np.fft.rfft(x)[:, None] * np.fft.rfft(y)[None], n=D)}
    for name, values in want.items():
        values = values.reshape(-1, D)
        values = values[np.linalg.norm(values, axis=1) >= 1e-10]
        assert len(values) < len(x) * len(y)
        got = getattr(algebra, name)(a, b, MemoryConfig(D), most=0, merge=False).select("loc_id", F.slice("counter", 1, 3).alias("c")).orderBy("loc_id").toPandas()
        assert got["loc_id"].tolist() == list(range(len(values)))
        assert np.allclose(np.stack(got["c"].to_numpy()), (unit(values) if name == "bind" else values)[:, :3])


@pytest.mark.parametrize("name", ["add", "subtract"])
def test_sizes_are_the_lengths_of_the_counters(spark, monkeypatch, name):
    """In one block and in several, with short sums, an empty side, nearest rows only and merging."""
    rng, config, work = np.random.default_rng(13), MemoryConfig(D), getattr(algebra, name)
    x, y = unit(rng.standard_normal((9, D))), unit(rng.standard_normal((25, D)))
    x[2], x[5] = y[4], -y[8]
    a, b = book_of(spark, x), book_of(spark, y)

    def same(left, right, **how):
        whole = {r.loc_id: float(np.linalg.norm(r.counter)) for r in work(left, right, config, **how).collect()}
        got = work(left, right, config, sizes=True, **how)
        assert got.columns == ["loc_id", "size"] and dict(got.collect()) == pytest.approx(whole)
        return whole

    assert sorted(same(a, b, merge=False)) == list(range(224))
    same(a, b, merge=False, cross_k=2), same(a, b)
    assert len(same(a, b.limit(0), merge=False)) == 9 and len(same(a.limit(0), b, merge=False)) == 25
    monkeypatch.setattr(algebra, "RIGHT_BLOCK", 10)
    monkeypatch.setattr(algebra, "OUT_ROWS", 4)
    assert sorted(same(a, b, merge=False)) == list(range(224))


def test_compose_adds_hybrids(spark):
    rng = np.random.default_rng(5)
    x, y = (unit(c + 0.05 * rng.standard_normal((6, D))) for c in np.eye(D)[:2])
    out, facts = algebra.compose(book_of(spark, x), book_of(spark, y), MemoryConfig(D, k=5), algebra.ComposeParams(rounds=1, random_probes=4))
    assert facts["pool"] == 12 and out.count() == facts["locations"] > 12
    assert [r.loc_id for r in out.orderBy("loc_id").collect()] == list(range(facts["locations"]))


def test_compose_reads_in_the_executors_and_keeps_attractors_in_order(spark):
    rng = np.random.default_rng(8)
    address, patterns = unit(rng.standard_normal((40, D))), unit(rng.standard_normal((40, D)))
    address[9] = address[2]
    probes = np.vstack([unit(rng.standard_normal((1500, D))), address[2:3]])
    read = algebra._reader(address, patterns, 5, 4.0)
    made, sure = algebra._mapped(spark, probes, read)
    at = np.argsort(-np.round(probes @ address.T, 12), axis=1, kind="stable")[:, :5]
    w = np.exp(4.0 * np.take_along_axis(probes @ address.T, at, 1))
    assert np.allclose(made, unit((w[:, :, None] * patterns[at]).sum(axis=1))) and np.allclose(sure, (probes @ address.T).max(axis=1))
    kept = []
    for x in probes:
        if not kept or max(float(x @ y) for y in kept) <= 0.6:
            kept.append(x)
    assert np.allclose(algebra.distinct_attractors(probes, 0.6), kept)


def test_compose_dreams_each_probe_once_and_as_the_operators(spark, monkeypatch):
    rng = np.random.default_rng(11)
    x, y = (unit(c + 0.4 * rng.standard_normal((20, D))) for c in np.eye(D)[:2])
    a, b, config = book_of(spark, x), book_of(spark, y), MemoryConfig(D, k=5, tau_merge=0.9)
    for name, size in (("SHARED_BLOCK", 7), ("LOCATION_BLOCK", 6), ("SEARCH_BLOCK", 5), ("OUT_ROWS", 3), ("PAIR_BLOCK", 80)):
        monkeypatch.setattr(algebra, name, size)
    hybrids = consolidation.full_state(book_of(spark, unit(np.eye(D)[0] + 0.3 * rng.standard_normal((30, D))), rng.standard_normal((30, D)), 1 + rng.random(30))).withColumn("loc_id", F.col("loc_id") * 3).checkpoint()
    asks = algebra._shaken(hybrids, 0.1, np.random.default_rng(2)).checkpoint()
    held = np.stack([r.address for r in hybrids.orderBy("loc_id").collect()])
    assert np.allclose(np.stack([r.query for r in asks.orderBy("qid").collect()]), unit(held + 0.1 * np.random.default_rng(2).standard_normal(held.shape)))

    books = spark.sparkContext.broadcast((algebra._book(a), algebra._book(b)))
    frozen = algebra._shared(hybrids, "address", vec.unit_pattern("counter", "write_count"))
    heard = algebra._heard(asks, books, frozen, 6, 5.0, 10, 1e-6).orderBy("qid").toPandas()
    whole = consolidation.full_state(a).unionByName(consolidation.full_state(b).withColumn("loc_id", F.col("loc_id") + 100)).unionByName(hybrids.withColumn("loc_id", F.col("loc_id") + 200))
    want = reads.read_iterative(asks, whole, 6, 5.0, 10, 1e-6).orderBy("qid").toPandas()
    assert list(heard.qid) == list(want.qid) and np.allclose(np.stack(heard["query"]), np.stack(want.result))

    given = spark.createDataFrame(heard).checkpoint()
    got = algebra._reinforced(given, hybrids, 4, 5.0, 0.7).orderBy("loc_id").toPandas()
    want = writes.soft_write(given, hybrids, 4, 5.0, 0.7).orderBy("loc_id").toPandas()
    assert list(got.loc_id) == list(want.loc_id) and np.allclose(np.stack(got.counter), np.stack(want.counter)) and np.allclose(got.write_count, want.write_count)

    close = {r.loc_id: (r.nn_id, r.sim) for r in algebra._close(hybrids, 0.3).collect()}
    near = {r.loc_id: (r.nn_id, r.sim) for r in activation.nearest_neighbors(hybrids).where("sim > 0.3").collect()}
    assert len(near) > 10 and {k: v[0] for k, v in close.items()} == {k: v[0] for k, v in near.items()} and all(close[k][1] == pytest.approx(v[1]) for k, v in near.items())

    assert all(close[near_id][1] == sim for i, (near_id, sim) in close.items() if near_id in close and close[near_id][0] == i)

    seen = spark.sparkContext.accumulator(0)
    real = algebra._settled
    monkeypatch.setattr(algebra, "_settled", lambda xi, *rest: (seen.add(len(xi)), real(xi, *rest))[1])
    _, facts = algebra.compose(a, b, config, algebra.ComposeParams(rounds=1, random_probes=4, per_attractor=30))
    assert seen.value == facts["built"] >= 30


def test_top_places_in_chunks_equal_a_whole_sort(monkeypatch):
    monkeypatch.setattr(algebra, "LOCATION_BLOCK", 16)
    rng = np.random.default_rng(12)
    books = [np.round(rng.standard_normal((n, D)), 1) for n in (50, 3, 90)]
    books[2][7] = books[0][4]
    probes = np.vstack([np.round(rng.standard_normal((40, D)), 1), books[0][4:5]])
    sims = np.round(probes @ np.vstack(books).T, 9)
    for k in (1, 5, 20, 200):
        places, best = algebra._top_places(probes, books, k)
        at = np.argsort(-sims, axis=1, kind="stable")[:, :k]
        assert np.allclose(best, np.take_along_axis(sims, at, 1)) and np.allclose(algebra._rows_at(places, books), np.vstack(books)[places])
        assert (np.sort(places, axis=1)[:, 1:] > np.sort(places, axis=1)[:, :-1]).all()


def test_followed_probes_read_as_from_a_whole_search():
    rng = np.random.default_rng(13)
    address, patterns = unit(rng.standard_normal((900, D))), unit(rng.standard_normal((900, D)))
    address[400:500] = address[:100]
    address[700:] *= 3 * rng.random((200, 1))
    probes = unit(rng.standard_normal((30, D)))
    read, searched = algebra._reader(address, patterns, 5, 4.0), []
    follow = algebra._Follower(address, patterns, 5, 4.0, len(probes))
    search = follow._search
    follow._search = lambda who, at: (searched.append(len(who)), search(who, at))
    for step in range(12):
        who = np.arange(step % 3, 30)
        made, sure = follow(who, probes[who])
        want, best = read(probes[who])
        assert np.allclose(made, want) and np.allclose(sure, best)
        probes = unit(probes + 0.3 / 2**step * rng.standard_normal(probes.shape))
    assert searched[0] == 30 and sum(searched) < 12 * 25
    few = algebra._Follower(address[:3], patterns[:3], 5, 4.0, 30)
    assert np.allclose(few(np.arange(30), probes)[0], algebra._reader(address[:3], patterns[:3], 5, 4.0)(probes)[0])


def test_soft_write_equals_numpy(spark, cloud):
    address, counter, count, q = cloud
    got = writes.soft_write(asks_of(spark, q), book_of(spark, address, counter, count), 6, 5.0).orderBy("loc_id").toPandas()
    want, n = counter.copy(), count.copy()
    for v in q:
        s = address @ unit(v)
        at = np.argsort(-s, kind="stable")[:6]
        w = np.exp(5 * (s[at] - s[at].max()))
        w /= w.sum()
        want[at] += w[:, None] * v
        n[at] += w
    assert np.allclose(np.stack(got.counter.to_numpy()), want) and np.allclose(got.write_count, n)


def test_documents_recall_and_roles(spark):
    rng = np.random.default_rng(6)
    role, fillers = spectral.unit(rng.standard_normal((3, 64))), spectral.unit(rng.standard_normal((4, 64)))
    docs = spectral.unit(np.stack([sum(spectral.bind_rows(role[i], fillers[(i + j) % 4]) for i in range(3)) for j in range(4)]))
    table = spark.createDataFrame([(j, d.tolist(), '{"j":%d}' % j if j else "broken") for j, d in enumerate(docs)], "doc_id bigint, vector array<double>, metadata string")
    posted = spark.createDataFrame([(j, j) for j in range(4)], "loc_id bigint, doc_id bigint")
    got = documents.query_documents(asks_of(spark, docs), book_of(spark, docs), table, posted, 2).where("rk = 1").orderBy("qid").collect()
    assert [r.doc_id for r in got] == [0, 1, 2, 3] and got[0].metadata is None and got[1].metadata == '{"j":1}'
    exact = documents.query_documents(asks_of(spark, docs), book_of(spark, docs), table, posted, 2, exact=True).where("rk = 1").orderBy("qid").collect()
    assert [r.doc_id for r in exact] == [0, 1, 2, 3]
    multi = documents.query_documents_multi_role(asks_of(spark, docs[:1]), [(role[i].tolist(), fillers[i].tolist()) for i in range(3)], book_of(spark, docs), table, posted, 4).orderBy("rk").collect()
    for r in multi:
        want = [float(spectral.unit(spectral.unbind_rows(docs[r.doc_id], role[i])) @ fillers[i]) for i in range(3)]
        assert np.allclose(r.role_scores, want)
    left, lines, gone = documents.delete(table, posted, spark.createDataFrame([(1,), (77,)], "doc_id bigint"))
    assert (left.count(), lines.count(), gone.count()) == (3, 3, 1)


def test_catalog_versions_and_checks(spark):
    db = catalog.Database(spark, "mem-test", D)
    rows = algebra.full_state(book_of(spark, np.eye(D)[:3]))
    assert db.load_snapshot("Übung 1", rows, expected=0) == 1
    got, version = db.snapshot("Übung 1")
    assert got.count() == 3 and version == 1
    with pytest.raises(catalog.VersionConflict):
        db.load_snapshot("Übung 1", rows, expected=0)
    assert db.load_snapshot("Übung 1", rows.limit(2), expected=1) == 2 and db.stats().first().n_locations == 2
    assert db.collections() == ["Übung 1"] and db.drop_collection("Übung 1") and not db.drop_collection("Übung 1")
    with pytest.raises(KeyError):
        db.snapshot("Übung 1")
    db.drop()
    assert catalog.valid_name("a-b_1") and not catalog.valid_name("1a") and not catalog.valid_name("A")
    with pytest.raises(ValueError):
        Limits.check(11, 10, "rows")
    with pytest.raises(ValueError):
        MemoryConfig(D, tau_split=2.0)


def test_files_and_retention(spark, tmp_path, small):
    rows = book_of(spark, np.eye(D)[:4]).withColumn("collection", F.when(F.col("loc_id") < 2, "a").otherwise("b"))
    path = f"file://{tmp_path}/loc"
    tables.flush(rows, path)
    tables.flush(rows.where("collection = 'a'").limit(1), path)
    assert tables.location_scan(spark, path, "a").count() == 1 and tables.location_scan(spark, path).count() == 3
    spark.createDataFrame([(1, "[1.0, 2.5]")], "id int, v string").write.csv(f"file://{tmp_path}/csv", header=True)
    assert tables.read_vectors(spark, f"file://{tmp_path}/csv", "id", "v", "csv", header="true").first().query == [1.0, 2.5]
    log = spark.createDataFrame([(i, i // 3) for i in range(50)], "seq bigint, s bigint").withColumn("ts", F.timestamp_seconds(F.lit(1_700_000_000) + F.col("s")))
    kept = audit.retained(log, F.timestamp_seconds(F.lit(1_700_000_100)), 11)
    assert sorted(r.seq for r in kept.collect()) == list(range(39, 50))
    assert [r.seq for r in audit.query(log, limit=0).collect()] == [49]
    assert stats.column_mean(spark.createDataFrame([([1.0, 3.0],), ([3.0, 5.0],)], "v array<double>"), "v").first()["mean"] == [2.0, 4.0]
