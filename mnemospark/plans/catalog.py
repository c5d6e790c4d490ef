"""All registered queries of the associative-memory operators, with DuckDB SQL where SQL can say the same."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from mnemospark.config import MemoryConfig
from mnemospark.functions import spectral, vec
from mnemospark.functions.permutation import Permutation
from mnemospark.operators import activation, algebra, attention, audit, consolidation, documents, reads, stats, writes
from mnemospark.plans import recipes
from mnemospark.sources import tables
from mnemospark.sources.tables import table

Query = Callable[[SparkSession, str], DataFrame]
_QUERIES: dict[str, Query] = {}
_SQL: dict[str, str] = {}
D, K, BETA = 64, 20, 5.0


def query(sql: str | None = None) -> Callable[[Query], Query]:
    def add(f: Query) -> Query:
        _QUERIES[f.__name__] = f
        if sql is not None:
            _SQL[f.__name__] = sql
        return f

    return add


def r6(c: Column | str) -> Column:
    return F.round(F.col(c) if isinstance(c, str) else c, 6) + 0.0


def book(spark: SparkSession, sf: str) -> DataFrame:
    return activation.codebook(table(spark, sf, "embeddings"))


def asks(spark: SparkSession, sf: str) -> DataFrame:
    """The stated query set of searches: every id divisible by 100."""
    return activation.queries_of(table(spark, sf, "embeddings").where("vec_id % 100 = 0"))


def spread(df: DataFrame, ident: str, value: str) -> DataFrame:
    """(ident, pos, val): a vector column by position."""
    return df.select(ident, F.posexplode(value).alias("pos", "val")).select(ident, F.col("pos").cast("long").alias("pos"), r6("val").alias("val"))


E = "e as (select vec_id, label, embedding::double[] as v from embeddings)"
Q = "q as (select vec_id as qid, v as query, list_transform(v, lambda x: x / sqrt(list_dot_product(v, v))) as u from e where vec_id % 100 = 0)"


def _top(k: int, source: str = "q", extra: str = "true") -> str:
    return f"t as (select * from (select qid, query, vec_id as loc_id, label, v, list_dot_product(u, v) as sim, row_number() over (partition by qid order by list_dot_product(u, v) desc, vec_id) as rk from {source}, e where {extra}) where rk <= {k})"


_COS = "list_dot_product({0}, {1}) / sqrt(list_dot_product({0}, {0}) * list_dot_product({1}, {1}))"


def cos(a: str, b: str) -> str:
    return _COS.format(a, b)


def _weighted(weight: str) -> str:
    """CTEs: w (weights by softmax of the logit l in rows t) and s (weighted sums by position)."""
    return f"""l as (select *, {weight} as l from t), w as (select *, exp(l - max(l) over (partition by qid)) / sum(exp(l)) over (partition by qid) * exp(max(l) over (partition by qid)) as w from l),
    p as (select qid, unnest(range(0, {D})) as pos, w, v from w), s as (select qid, pos, sum(w * v[pos + 1]) as x from p group by qid, pos)"""


_UNIT = "n as (select qid, pos, x / sqrt(sum(x * x) over (partition by qid)) as x from s)"

# Sources, paging and upkeep


@query("select vec_id as loc_id, 1.0::double as write_count, round(list_sum(list_transform(embedding::double[], lambda x: abs(x))) / 64, 6) + 0.0 as mean_abs_counter from embeddings")
def src8_summary(spark: SparkSession, sf: str) -> DataFrame:
    return stats.summary(book(spark, sf)).withColumn("mean_abs_counter", r6("mean_abs_counter"))


@query("select doc_id, lang from documents order by doc_id limit 50 offset 100")
def src3_page(spark: SparkSession, sf: str) -> DataFrame:
    return documents.page(table(spark, sf, "documents"), 100, 50).select("doc_id", "lang")


@query("select doc_id, lang, source, n_chars from documents where doc_id = 77")
def src4_get(spark: SparkSession, sf: str) -> DataFrame:
    return documents.get(table(spark, sf, "documents"), 77).select("doc_id", "lang", "source", "n_chars")


@query("select d.doc_id, round(sqrt(list_dot_product(embedding::double[], embedding::double[])), 6) as norm from documents d join embeddings on d.doc_id = vec_id")
def src5_resolve(spark: SparkSession, sf: str) -> DataFrame:
    refs = table(spark, sf, "documents").select("doc_id", F.lit(None).cast(vec.V).alias("vector"), F.col("lang").alias("metadata"), F.col("doc_id").alias("ref"))
    return documents.resolve(refs, book(spark, sf)).select("doc_id", r6(vec.norm("vector")).alias("norm"))


@query("select doc_id, lang from documents d where not exists (select 1 from labels l where l.doc_id = d.doc_id and toxic = 1)")
def src15_delete(spark: SparkSession, sf: str) -> DataFrame:
    docs = table(spark, sf, "documents")
    gone = table(spark, sf, "labels").where("toxic = 1")
    kept, _, _ = documents.delete(docs, docs.select(F.col("doc_id").alias("loc_id"), "doc_id"), gone)
    return kept.select("doc_id", "lang")


@query("select count(*) as n_locations, 0::bigint as bad_locations, (select count(*) from documents join embeddings on doc_id = vec_id) as n_documents, 0::bigint as bad_documents, (select count(*) from documents where doc_id not in (select vec_id from embeddings)) as postings_without_location, (select count(*) from documents where doc_id not in (select vec_id from embeddings)) as postings_without_document from embeddings")
def src16_verify(spark: SparkSession, sf: str) -> DataFrame:
    docs, locations = table(spark, sf, "documents"), book(spark, sf)
    held = docs.join(locations, docs.doc_id == locations.loc_id).select("doc_id", F.col("address").alias("vector"))
    return tables.verify(locations, held, docs.select(F.col("doc_id").alias("loc_id"), "doc_id"), D)


@query(f"with {E} select vec_id as loc_id, pos, round(v[pos + 1], 6) + 0.0 as val from (select vec_id, v, unnest(range(0, 64)) as pos from e)")
def src11_bulk_load(spark: SparkSession, sf: str) -> DataFrame:
    rows = table(spark, sf, "embeddings").select(F.col("vec_id").alias("pos"), F.col("embedding").alias("address"))
    return spread(tables.bulk_load(rows, D, most=0), "loc_id", "address")


@query(f"with {E} select vec_id as qid, round(sqrt(list_dot_product(v, v)), 6) as norm from e")
def src12_base64(spark: SparkSession, sf: str) -> DataFrame:
    rows = table(spark, sf, "embeddings").select("vec_id", spectral.to_base64(vec.cast("embedding")).alias("b64"))
    return tables.read_base64(rows, "vec_id", "b64").select("qid", r6(vec.norm("query")).alias("norm"))


@query("select vec_id as loc_id, row_number() over (order by vec_id) - 1 as idx from embeddings")
def k10_id_lookup(spark: SparkSession, sf: str) -> DataFrame:
    return activation.id_lookup(book(spark, sf)).select("loc_id", F.col("idx").cast("long").alias("idx"))


# Vector functions


def _pairs(spark: SparkSession, sf: str) -> DataFrame:
    e = table(spark, sf, "embeddings").select("vec_id", vec.cast("embedding").alias("a"))
    return e.join(e.select((F.col("vec_id") - 1).alias("vec_id"), F.col("a").alias("b")), "vec_id")


PAIRS = f"{E}, ab as (select x.vec_id, x.v as a, y.v as b from e x join e y on y.vec_id = x.vec_id + 1)"


@query(f"with {PAIRS} select vec_id, round(list_dot_product(a, b), 6) + 0.0 as dot, round(sqrt(list_dot_product(a, a)), 6) as norm, round({cos('a', 'b')}, 6) + 0.0 as cosine, round(-log2(greatest(pow(2.0, -12), least({cos('a', 'b')}, 1.0))), 6) + 0.0 as surprise from ab")
def v_scalars(spark: SparkSession, sf: str) -> DataFrame:
    c = vec.cosine("a", "b")
    return _pairs(spark, sf).select("vec_id", r6(vec.dot("a", "b")).alias("dot"), r6(vec.norm("a")).alias("norm"), r6(c).alias("cosine"), r6(vec.surprise_bits(c)).alias("surprise"))


@query(f"with {PAIRS}, c as (select vec_id, unnest(range(0, 64)) as pos, a, b from ab), m as (select vec_id, pos, a[pos + 1] - 3 * b[pos + 1] as x from c) select vec_id, pos, round(x / sqrt(sum(x * x) over (partition by vec_id)), 6) + 0.0 as val from m")
def v_normalize(spark: SparkSession, sf: str) -> DataFrame:
    return spread(_pairs(spark, sf).select("vec_id", vec.normalize(vec.add_scaled("a", "b", -3.0)).alias("v")), "vec_id", "v")


@query(f"with {E}, c as (select vec_id, unnest(range(0, 64)) as pos, v from e) select vec_id, pos, round(exp(5 * v[pos + 1]) / sum(exp(5 * v[pos + 1])) over (partition by vec_id), 6) + 0.0 as val from c")
def v_softmax(spark: SparkSession, sf: str) -> DataFrame:
    e = table(spark, sf, "embeddings").select("vec_id", vec.softmax(vec.cast("embedding"), 5.0).alias("v"))
    return spread(e, "vec_id", "v")


_CONV = "list_sum(list_transform(range(0, 64), lambda i: a[i + 1] * b[(pos - i + 64) % 64 + 1]))"
_CORR = "list_sum(list_transform(range(0, 64), lambda i: a[i + 1] * b[(i - pos + 64) % 64 + 1]))"


@query(f"with {PAIRS}, c as (select vec_id, unnest(range(0, 64)) as pos, a, b from ab), m as (select vec_id, pos, {_CONV} as x from c) select vec_id, pos, round(x / sqrt(sum(x * x) over (partition by vec_id)), 6) + 0.0 as val from m")
def v_bind(spark: SparkSession, sf: str) -> DataFrame:
    return spread(_pairs(spark, sf).select("vec_id", spectral.bind(F.col("a"), F.col("b")).alias("v")), "vec_id", "v")


@query(f"with {PAIRS}, c as (select vec_id, unnest(range(0, 64)) as pos, a, b from ab) select vec_id, pos, round({_CORR}, 6) + 0.0 as val from c")
def v_unbind(spark: SparkSession, sf: str) -> DataFrame:
    return spread(_pairs(spark, sf).select("vec_id", spectral.unbind(F.col("a"), F.col("b")).alias("v")), "vec_id", "v")


@query(f"with {PAIRS}, c as (select vec_id, unnest(range(0, 64)) as pos, a, b from ab) select vec_id, pos, round({_CONV}, 6) + 0.0 as val from c")
def v_convolve_native(spark: SparkSession, sf: str) -> DataFrame:
    return spread(_pairs(spark, sf).select("vec_id", vec.convolve("a", "b").alias("v")), "vec_id", "v")


@query(f"with {E}, c as (select vec_id, unnest(range(0, 64)) as pos, v from e) select vec_id, pos, round(v[(64 - pos) % 64 + 1], 6) + 0.0 as val from c")
def v_involve(spark: SparkSession, sf: str) -> DataFrame:
    return spread(table(spark, sf, "embeddings").select("vec_id", vec.involve(vec.cast("embedding")).alias("v")), "vec_id", "v")


@query(f"with {E}, c as (select vec_id, unnest(range(0, 64)) as pos, v from e) select vec_id, pos, round(v[(pos + 21) % 64 + 1], 6) + 0.0 as val from c")
def v_permute(spark: SparkSession, sf: str) -> DataFrame:
    shift = Permutation(tuple((i + 7) % D for i in range(D))).power(3)
    return spread(table(spark, sf, "embeddings").select("vec_id", vec.permute(vec.cast("embedding"), list(shift.indices)).alias("v")), "vec_id", "v")


@query(f"with {E}, c as (select vec_id, unnest(range(0, 64)) as pos, v from e) select vec_id, pos, round(v[(pos + 14) % 64 + 1], 6) + 0.0 as val from c")
def v_rotate(spark: SparkSession, sf: str) -> DataFrame:
    """A whole number of real turns equals the permutation's power."""
    shift = Permutation(tuple((i + 7) % D for i in range(D)))
    return spread(table(spark, sf, "embeddings").select("vec_id", spectral.rotate(vec.cast("embedding"), shift, 2.0).alias("v")), "vec_id", "v")


@query(f"with {E}, c as (select vec_id, unnest(range(0, 64)) as pos, v from e), ab as (select vec_id, pos, v as a, v as b from c) select vec_id, pos, round({_CONV}, 6) + 0.0 as val from ab")
def v_power(spark: SparkSession, sf: str) -> DataFrame:
    """The second power is the vector convolved with itself."""
    return spread(table(spark, sf, "embeddings").select("vec_id", spectral.power(vec.cast("embedding"), 2.0).alias("v")), "vec_id", "v")


@query(f"with {PAIRS}, c as (select vec_id, unnest(range(0, 64)) as pos, a, b from ab) select vec_id, pos, round(a[pos + 1], 4) + 0.0 as val from c")
def v_unbind_exact(spark: SparkSession, sf: str) -> DataFrame:
    """Exact unbinding takes a binding back."""
    rows = _pairs(spark, sf).select("vec_id", spectral.unbind_exact(spectral.bind(F.col("a"), F.col("b"), normal=False), F.col("b")).alias("v"))
    return rows.select("vec_id", F.posexplode("v").alias("pos", "val")).select("vec_id", F.col("pos").cast("long").alias("pos"), (F.round("val", 4) + 0.0).alias("val"))


@query(f"with {PAIRS}, o as (select vec_id, a, b, acos(list_dot_product(a, b)) as w from ab), c as (select vec_id, unnest(range(0, 64)) as pos, a, b, w from o), m as (select vec_id, pos, (sin(0.75 * w) * a[pos + 1] + sin(0.25 * w) * b[pos + 1]) / sin(w) as x from c) select vec_id, pos, round(x / sqrt(sum(x * x) over (partition by vec_id)), 6) + 0.0 as val from m")
def v_slerp(spark: SparkSession, sf: str) -> DataFrame:
    return spread(_pairs(spark, sf).select("vec_id", vec.slerp("a", "b", 0.25).alias("v")), "vec_id", "v")


@query(f"with {E}, c as (select label, unnest(range(0, 64)) as pos, vec_id, v from e), s as (select label, pos, sum((1 + vec_id % 3) * v[pos + 1]) as x from c group by label, pos) select label, pos, round(x / sqrt(sum(x * x) over (partition by label)), 6) + 0.0 as val from s")
def g3_bundle(spark: SparkSession, sf: str) -> DataFrame:
    e = table(spark, sf, "embeddings").select("label", "vec_id", vec.cast("embedding").alias("v"))
    return spread(vec.bundle(e, ["label"], "v", (1 + F.col("vec_id") % 3).cast("double")), "label", "bundle")


@query("select label, count(*) as n_locations, sum(1 + vec_id % 7)::double as total_writes, round(avg(1 + vec_id % 7), 6) as avg_writes, max(1 + vec_id % 7)::double as max_writes from embeddings group by label")
def g1_collection_stats(spark: SparkSession, sf: str) -> DataFrame:
    e = table(spark, sf, "embeddings").select("label", (1 + F.col("vec_id") % 7).cast("double").alias("write_count"))
    return stats.collection_stats(e, "label").withColumn("avg_writes", r6("avg_writes"))


# Activation


@query(f"with {E}, {Q}, {_top(10)} select qid, loc_id, rk, round(sim, 6) + 0.0 as sim from t")
def k1_activate(spark: SparkSession, sf: str) -> DataFrame:
    return activation.activate(asks(spark, sf), book(spark, sf), 10).select("qid", "loc_id", F.col("rk").cast("long").alias("rk"), r6("sim").alias("sim"))


@query(f"with {E}, {Q}, {_top(10)} select qid, loc_id, rk, round(sim, 6) + 0.0 as sim from t")
def k1_activate_sql(spark: SparkSession, sf: str) -> DataFrame:
    return activation.activate(asks(spark, sf), book(spark, sf), 10, "sql").select("qid", "loc_id", F.col("rk").cast("long").alias("rk"), r6("sim").alias("sim"))


@query(f"with {E}, {Q}, {_top(10, extra='label < 5')} select qid, loc_id, rk, round(sim, 6) + 0.0 as sim from t")
def k3_activate_subset(spark: SparkSession, sf: str) -> DataFrame:
    allowed = table(spark, sf, "embeddings").where("label < 5").select(F.col("vec_id").alias("loc_id"))
    return activation.activate_subset(asks(spark, sf), book(spark, sf), allowed, 10).select("qid", "loc_id", F.col("rk").cast("long").alias("rk"), r6("sim").alias("sim"))


@query("select vec_id as loc_id, 1.0 + vec_id % 11 as write_count from embeddings order by 2 desc, 1 limit 32")
def k6_landmarks(spark: SparkSession, sf: str) -> DataFrame:
    locations = book(spark, sf).withColumn("write_count", (1 + F.col("loc_id") % 11).cast("double"))
    return activation.select_landmarks(locations, 32).select("loc_id", "write_count")


@query(f"with {E} select loc_id, nn_id, round(c, 6) + 0.0 as sim from (select a.vec_id as loc_id, b.vec_id as nn_id, {cos('a.v', 'b.v')} as c, row_number() over (partition by a.vec_id order by list_dot_product(a.v, b.v) / sqrt(list_dot_product(b.v, b.v)) desc, b.vec_id) as rk from e a join e b on a.vec_id <> b.vec_id) where rk = 1")
def k12_nearest_neighbors(spark: SparkSession, sf: str) -> DataFrame:
    return activation.nearest_neighbors(book(spark, sf)).withColumn("sim", r6("sim"))


@query()
def k7_graph_activate(spark: SparkSession, sf: str) -> DataFrame:
    graph = activation.with_neighbors(book(spark, sf), 10)
    return activation.graph_activate(asks(spark, sf), graph, 10).select("qid", "loc_id", "rk", r6("sim").alias("sim"))


@query("select count(*) as n_locations, 10.0::double as mean_degree, true as ready from embeddings")
def k8_graph_ready(spark: SparkSession, sf: str) -> DataFrame:
    return activation.graph_ready(activation.with_neighbors(book(spark, sf), 10))


# Reads and attention


@query(f"with {E}, {Q}, {_top(K)}, {_weighted(f'{BETA} * {cos("query", "v")}')}, {_UNIT} select qid, pos, round(x, 6) + 0.0 as val from n")
def r1_read_fast(spark: SparkSession, sf: str) -> DataFrame:
    return spread(reads.read_fast(asks(spark, sf), book(spark, sf), K, BETA), "qid", "result")


@query()
def r2_read_iterative(spark: SparkSession, sf: str) -> DataFrame:
    return spread(reads.read_iterative(asks(spark, sf), book(spark, sf), K, BETA), "qid", "result")


@query(f"with {E}, {Q}, {_top(K)}, {_weighted(f'{BETA} * sim')} select qid, loc_id, round(sim, 6) + 0.0 as similarity, round(w, 6) + 0.0 as weight from w")
def r3_analyze(spark: SparkSession, sf: str) -> DataFrame:
    rows = reads.analyze(asks(spark, sf), book(spark, sf), "fast", K, BETA)
    return rows.select("qid", "loc_id", r6("similarity").alias("similarity"), r6("weight").alias("weight"))


@query()
def r4_analyze_iterative(spark: SparkSession, sf: str) -> DataFrame:
    rows = reads.analyze(asks(spark, sf), book(spark, sf), "iterative", K, BETA)
    return rows.select("qid", "iterations", "converged", "loc_id", r6("similarity").alias("similarity"), r6("weight").alias("weight"))


@query()
def r5_fingerprint(spark: SparkSession, sf: str) -> DataFrame:
    rows = activation.codebook(table(spark, sf, "embeddings")).join(table(spark, sf, "embeddings").select(F.col("vec_id").alias("loc_id"), "label"), "loc_id")
    return spread(reads.fingerprint(rows, K, BETA, key="label"), "label", "fingerprint")


@query(f"with {E}, {Q}, {_top(K)} select qid, round(ln(sum(exp({BETA} * sim))) / {BETA}, 6) + 0.0 as confidence from t group by qid")
def r6_confidence(spark: SparkSession, sf: str) -> DataFrame:
    return reads.confidence(asks(spark, sf), book(spark, sf), K, BETA).select("qid", r6("confidence").alias("confidence"))


@query()
def r8_compose_read(spark: SparkSession, sf: str) -> DataFrame:
    e = table(spark, sf, "embeddings")
    halves = {"low": activation.codebook(e.where("label < 5")), "high": activation.codebook(e.where("label >= 5"))}
    return spread(reads.compose_read(asks(spark, sf), halves, k=K, beta=BETA), "qid", "result")


@query(f"with {E}, {Q}, {_top(K)}, {_weighted(f'{BETA} * sim')}, {_UNIT} select qid, pos, round(x, 6) + 0.0 as val from n")
def r9_read_with_confidence(spark: SparkSession, sf: str) -> DataFrame:
    """Plain unit addresses: unit patterns are the vectors themselves."""
    return spread(reads.read_with_confidence(asks(spark, sf), book(spark, sf), K, BETA), "qid", "result")


_WC = "(1 + loc_id % 4)"


def _counted(spark: SparkSession, sf: str) -> DataFrame:
    n = (1 + F.col("loc_id") % 4).cast("double")
    return book(spark, sf).withColumn("write_count", n).withColumn("counter", vec.scale("counter", n))


@query(f"with {E}, {Q}, {_top(K)}, {_weighted(f'{BETA} * list_dot_product(query, v) + ln{_WC}')} select qid, pos, round(x, 6) + 0.0 as val from s")
def a1_read_attention(spark: SparkSession, sf: str) -> DataFrame:
    return spread(attention.read_attention(asks(spark, sf), _counted(spark, sf), K, BETA), "qid", "result")


@query(f"with {E}, {Q}, {_top(K, extra='vec_id % 3 <> 0')}, {_weighted(f'{BETA} * list_dot_product(query, v) + ln{_WC}')} select qid, pos, round(x, 6) + 0.0 as val from s")
def a2_attention_without(spark: SparkSession, sf: str) -> DataFrame:
    barred = asks(spark, sf).select("qid").join(book(spark, sf).select("loc_id").where("loc_id % 3 = 0"))
    return spread(attention.read_attention_without(asks(spark, sf), _counted(spark, sf), barred, K, BETA), "qid", "result")


@query(f"with {E}, {Q}, {_top(K, extra='vec_id <> qid')}, {_weighted(f'{BETA} * list_dot_product(query, v) + ln{_WC}')} select qid, pos, round(x, 6) + 0.0 as val from s")
def a4_attention_loo(spark: SparkSession, sf: str) -> DataFrame:
    return spread(attention.read_attention_loo(asks(spark, sf), _counted(spark, sf), K, BETA), "qid", "result")


_GRID = ", ".join(f"{b!r}::double" for b in attention.log_grid(*attention.SWEEP))


@query(
    f"with {E}, q as (select vec_id as qid, v as query, list_transform(v, lambda x: x / sqrt(list_dot_product(v, v))) as u from e), {_top(K, extra='vec_id <> qid')}, g as (select unnest([{_GRID}]) as beta),"
    " x as (select beta, qid, sum(exp(beta * (sim0 - top)) * sim0) / sum(exp(beta * (sim0 - top))) as got from (select qid, list_dot_product(query, v) as sim0, max(list_dot_product(query, v)) over (partition by qid) as top from t), g group by beta, qid),"
    " y as (select beta, sum(-ln(greatest(got, 1e-12))) as dl from x group by beta) select round(beta, 6) as beta, round(dl, 4) as description_length from y order by dl, beta limit 1"
)
def a5_calibrate_beta(spark: SparkSession, sf: str) -> DataFrame:
    out = attention.calibrate_beta(book(spark, sf), K)
    return out.select(r6("beta").alias("beta"), F.round("description_length", 4).alias("description_length"))


@query()
def a7_attention_mdl(spark: SparkSession, sf: str) -> DataFrame:
    out = attention.read_attention_mdl(asks(spark, sf), book(spark, sf), D, K)
    return out.select("qid", r6("beta").alias("beta"), r6("entropy").alias("entropy"))


# Documents


def _posted(spark: SparkSession, sf: str) -> tuple[DataFrame, DataFrame]:
    """Every embedding as a document, posted under its three nearest locations."""
    e = table(spark, sf, "embeddings")
    near = activation.activate(activation.queries_of(e), book(spark, sf), 3)
    docs = e.select(F.col("vec_id").alias("doc_id"), vec.cast("embedding").alias("vector"), F.to_json(F.struct("label")).alias("metadata"))
    return docs, documents.postings_of(near)


_POSTED = f"all_q as (select vec_id as doc_id, list_transform(v, lambda x: x / sqrt(list_dot_product(v, v))) as u from e), posted as (select doc_id, loc_id from (select doc_id, vec_id as loc_id, row_number() over (partition by doc_id order by list_dot_product(u, v) desc, vec_id) as rk from all_q, e) where rk <= 3), {_top(4 * K)}"


@query(f"with {E}, {Q}, {_POSTED}, c as (select distinct t.qid, t.query, p.doc_id from t join posted p on t.loc_id = p.loc_id), s as (select qid, doc_id, label, {cos('query', 'v')} as score from c join e on e.vec_id = c.doc_id) select qid, doc_id, label, round(score, 6) + 0.0 as score, rk from (select *, row_number() over (partition by qid order by score desc, doc_id) as rk from s) where rk <= 10")
def q1_query_documents(spark: SparkSession, sf: str) -> DataFrame:
    docs, posted = _posted(spark, sf)
    out = documents.query_documents(asks(spark, sf), book(spark, sf), docs, posted, 10, K)
    return out.select("qid", "doc_id", F.get_json_object("metadata", "$.label").cast("int").alias("label"), r6("score").alias("score"), F.col("rk").cast("long").alias("rk"))


@query()
def q2_query_scoped(spark: SparkSession, sf: str) -> DataFrame:
    docs, posted = _posted(spark, sf)
    role = spectral.symbol("role", D).tolist()
    return documents.query_documents_scoped(asks(spark, sf), role, book(spark, sf), docs, posted, 10, K).select("qid", "doc_id", r6("score").alias("score"), "rk")


@query()
def q3_query_multi_role(spark: SparkSession, sf: str) -> DataFrame:
    docs, posted = _posted(spark, sf)
    pairs = [(spectral.symbol(f"role{i}", D).tolist(), spectral.symbol(f"filler{i}", D).tolist()) for i in range(3)]
    out = documents.query_documents_multi_role(asks(spark, sf), pairs, book(spark, sf), docs, posted, 10, K, cleanup="mdl")
    return out.select("qid", "doc_id", r6("score").alias("score"), "rk", F.posexplode("role_scores").alias("pair", "role_score")).withColumn("role_score", r6("role_score"))


# Writes


def _writes(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "embeddings").select(F.col("label").cast("string").alias("collection"), F.col("vec_id").alias("seq"), vec.cast("embedding").alias("vector"))


@query("select label::varchar as collection, vec_id as loc_id, 1.0::double as write_count from embeddings")
def w2a_plain_write(spark: SparkSession, sf: str) -> DataFrame:
    return writes.plain(_writes(spark, sf)).select("collection", "loc_id", "write_count")


@query()
def w4_learn(spark: SparkSession, sf: str) -> DataFrame:
    learned = writes.learn(_writes(spark, sf), MemoryConfig(D))
    return writes.locations_of(learned).select("collection", "loc_id", r6("write_count").alias("write_count"), r6(vec.norm("counter")).alias("counter_norm"))


@query()
def w5_learn_documents(spark: SparkSession, sf: str) -> DataFrame:
    _, posted = writes.documents_of(writes.learn(_writes(spark, sf), MemoryConfig(D, mdl_gate=True)))
    return posted.select("collection", "loc_id", "doc_id")


@query(f"with {E}, q as (select vec_id as qid, v as query, list_transform(v, lambda x: x / sqrt(list_dot_product(v, v))) as u from e), {_top(K)}, {_weighted(f'{BETA} * sim')} select loc_id, round(1 + sum(w), 6) + 0.0 as write_count from w group by loc_id union all select vec_id, 1.0 from e where vec_id not in (select loc_id from t)")
def w10_soft_write(spark: SparkSession, sf: str) -> DataFrame:
    patterns = activation.queries_of(table(spark, sf, "embeddings"))
    return writes.soft_write(patterns, book(spark, sf), K, BETA).select("loc_id", r6("write_count").alias("write_count"))


# Consolidation


@query()
def c1_knn_merge(spark: SparkSession, sf: str) -> DataFrame:
    kept, _ = consolidation.knn_merge(book(spark, sf), MemoryConfig(D, tau_merge=0.4))
    return kept.select("loc_id", "write_count", r6(vec.norm("counter")).alias("counter_norm"))


@query("select count(*) as n_locations, sum(1 + vec_id % 7)::double as writes, round(count(*) * 64 + sum(1 + vec_id % 7) * log2(count(*)), 6) as dl from embeddings")
def c3_description_length(spark: SparkSession, sf: str) -> DataFrame:
    locations = book(spark, sf).withColumn("write_count", (1 + F.col("loc_id") % 7).cast("double"))
    return consolidation.description_length(locations, 64.0).withColumn("dl", r6("dl"))


@query()
def c4_compress(spark: SparkSession, sf: str) -> DataFrame:
    e = table(spark, sf, "embeddings").select(F.col("label").alias("collection"), F.col("vec_id").alias("loc_id"), vec.cast("embedding").alias("address"), vec.cast("embedding").alias("counter"), F.lit(1.0).alias("write_count"))
    kept, _ = consolidation.compress(e, float(D), 100.0, key="collection")
    return kept.select("collection", "loc_id", "write_count")


@query()
def c6_dream(spark: SparkSession, sf: str) -> DataFrame:
    e = table(spark, sf, "embeddings").select(F.col("label").alias("collection"), F.col("vec_id").alias("loc_id"), vec.cast("embedding").alias("address"), vec.cast("embedding").alias("counter"), F.lit(1.0).alias("write_count"))
    return consolidation.dream(e, MemoryConfig(D), 2).select("collection", "loc_id", r6("write_count").alias("write_count"))


@query("with d as (select o_totalprice as v, avg(o_totalprice) over () as mean, lead(o_totalprice) over (order by o_totalprice desc) as nx from orders) select round(coalesce(max(struct_pack(gap := v - nx, v := v, mid := (v + nx) / 2)).mid, 0), 6) as tau from d where nx is not null and v >= mean and v > nx")
def c9_top_gap(spark: SparkSession, sf: str) -> DataFrame:
    return consolidation.top_gap_threshold(table(spark, sf, "orders"), "o_totalprice").select(r6("tau").alias("tau"))


@query("with d as (select p_retailprice as v, count(*) over () as n, sum(p_retailprice) over () as total, row_number() over (order by p_retailprice) as k, sum(p_retailprice) over (order by p_retailprice rows unbounded preceding) as low, lead(p_retailprice) over (order by p_retailprice) as nx from part) select round(max(struct_pack(b := (k / n) * (1 - k / n) * (low / k - (total - low) / (n - k)) * (low / k - (total - low) / (n - k)), f := -k, mid := (v + nx) / 2)).mid, 6) as tau from d where nx is not null")
def c10_otsu(spark: SparkSession, sf: str) -> DataFrame:
    return consolidation.otsu_threshold(table(spark, sf, "part"), "p_retailprice").select(r6("tau").alias("tau"))


@query(f"with {E} select a.vec_id as a, b.vec_id as b, round({cos('a.v', 'b.v')}, 6) + 0.0 as cosine from e a join e b on a.vec_id < b.vec_id where a.label = 0 and b.label = 0")
def c11_pairwise_cosines(spark: SparkSession, sf: str) -> DataFrame:
    one = table(spark, sf, "embeddings").where("label = 0").select("vec_id", vec.cast("embedding").alias("v"))
    return consolidation.pairwise_cosines(one, "vec_id", "v").withColumn("cosine", r6("cosine"))


# Algebra


def _class(spark: SparkSession, sf: str, label: int) -> DataFrame:
    return activation.codebook(table(spark, sf, "embeddings").where(f"label = {label}"))


def _numbered(sign: str) -> str:
    return f"with {E}, ab as (select a.vec_id as i, b.vec_id as j, a.v as a, b.v as b from e a, e b where a.label = 0 and b.label = 1), m as (select i, j, list_transform(range(1, 65), lambda k: a[k] {sign} b[k]) as x from ab) select row_number() over (order by i, j) - 1 as loc_id, round(sqrt(list_dot_product(x, x)), 6) as size from m"


@query(_numbered("+"))
def l1_add(spark: SparkSession, sf: str) -> DataFrame:
    out = algebra.add(_class(spark, sf, 0), _class(spark, sf, 1), MemoryConfig(D), most=0, merge=False, sizes=True)
    return out.select("loc_id", r6("size").alias("size"))


@query(_numbered("-"))
def l2_subtract(spark: SparkSession, sf: str) -> DataFrame:
    out = algebra.subtract(_class(spark, sf, 0), _class(spark, sf, 1), MemoryConfig(D), most=0, merge=False, sizes=True)
    return out.select("loc_id", r6("size").alias("size"))


@query()
def l1_add_cross_k(spark: SparkSession, sf: str) -> DataFrame:
    out = algebra.add(_class(spark, sf, 0), _class(spark, sf, 1), MemoryConfig(D), cross_k=4)
    return out.select("loc_id", "write_count", r6(vec.norm("counter")).alias("size"))


@query(f"with {E}, c as (select vec_id, unnest(range(0, 64)) as pos, v from e) select vec_id as loc_id, pos, round(-2.5 * v[pos + 1], 6) + 0.0 as val from c")
def l3_scale(spark: SparkSession, sf: str) -> DataFrame:
    return spread(algebra.scale(book(spark, sf), -2.5), "loc_id", "counter")


@query(f"with {E}, k as (select a.vec_id from e a where a.label < 5 and exists (select 1 from e b where b.label >= 5 and {cos('a.v', 'b.v')} > 0.3)) select row_number() over (order by vec_id) - 1 as loc_id from k")
def l4_intersect(spark: SparkSession, sf: str) -> DataFrame:
    e = table(spark, sf, "embeddings")
    return algebra.intersect(activation.codebook(e.where("label < 5")), activation.codebook(e.where("label >= 5")), 0.3).select("loc_id")


@query(f"with {E}, ab as (select a.vec_id as i, b.vec_id as j, a.v as a, b.v as b from e a, e b where a.label = 0 and b.label = 1), c as (select i, j, unnest(range(0, 64)) as pos, a, b from ab), m as (select i, j, pos, {_CONV} as x from c), n as (select i, j, pos, x / sqrt(sum(x * x) over (partition by i, j)) as x from m) select dense_rank() over (order by i, j) - 1 as loc_id, round(x, 6) + 0.0 as first from n where pos = 0")
def l5_bind(spark: SparkSession, sf: str) -> DataFrame:
    out = algebra.bind(_class(spark, sf, 0), _class(spark, sf, 1), MemoryConfig(D), most=0, merge=False)
    return out.select("loc_id", r6(F.element_at("counter", 1)).alias("first"))


@query()
def l6_unbind(spark: SparkSession, sf: str) -> DataFrame:
    return spread(algebra.unbind(book(spark, sf), spectral.symbol("key", D).tolist()), "loc_id", "address")


@query(f"with {E}, c as (select vec_id, unnest(range(0, 64)) as pos, v from e) select vec_id as loc_id, pos, round(v[(pos + 10) % 64 + 1], 6) + 0.0 as val from c")
def l7_permute(spark: SparkSession, sf: str) -> DataFrame:
    shift = Permutation(tuple((i + 5) % D for i in range(D)))
    return spread(algebra.permute(book(spark, sf), shift, 2), "loc_id", "address")


@query()
def l9_compose(spark: SparkSession, sf: str) -> DataFrame:
    out, _ = algebra.compose(_class(spark, sf, 0), _class(spark, sf, 1), MemoryConfig(D), algebra.ComposeParams(rounds=1))
    return out.select("loc_id", r6("write_count").alias("write_count"))


# Audit and scalars


@query("select event_id, user_id, event_type from events where event_type = 'click' and ts >= (select min(ts) from events) order by ts desc, event_id desc limit 100")
def u3_audit_query(spark: SparkSession, sf: str) -> DataFrame:
    log = table(spark, sf, "events").withColumnRenamed("event_type", "route").withColumnRenamed("event_id", "seq")
    out = audit.query(log, route="click")
    return out.select(F.col("seq").alias("event_id"), "user_id", F.col("route").alias("event_type"))


@query("select event_id from events order by ts desc, event_id desc limit 777")
def u4_retention(spark: SparkSession, sf: str) -> DataFrame:
    log = table(spark, sf, "events").withColumnRenamed("event_id", "seq")
    return audit.retained(log, F.lit("2100-01-01").cast("timestamp"), 777, "50000 days").select(F.col("seq").alias("event_id"))


@query("with g as (select user_id, ts, case when ts >= lag(ts) over (partition by user_id order by ts) + interval 1 hour then 1 else 0 end as cut from events), s as (select user_id, ts, sum(cut) over (partition by user_id order by ts rows unbounded preceding) as s from g) select user_id, floor(epoch(min(ts)))::bigint as started, count(*) as n from s group by user_id, s")
def u7_activity(spark: SparkSession, sf: str) -> DataFrame:
    out = audit.activity(table(spark, sf, "events"), "1 hour", "user_id")
    return out.select("user_id", F.floor(F.unix_micros("started") / 1_000_000).cast("long").alias("started"), "n")


@query("select event_id, round(greatest(0.01 * pow(0.9999, event_id), 0.001), 9) as eta from events")
def u6_learning_rate(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "events").select("event_id", F.round(vec.learning_rate(F.col("event_id"), 0.01, 0.9999, 0.001), 9).alias("eta"))


@query("select c_custkey, ('0x' || substr(sha256(c_name), 1, 16))::ubigint::varchar as seed, regexp_full_match(c_mktsegment, '[a-z][a-z0-9_-]{0,62}') as valid_name from customer")
def f1_scalars(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "customer").select("c_custkey", vec.seed_of(F.col("c_name")).cast("string").alias("seed"), F.col("c_mktsegment").rlike("^[a-z][a-z0-9_-]{0,62}$").alias("valid_name"))


@query("select event_id, json_extract(props, '$.k')::bigint as k, strftime(ts, '%Y-%m-%dT%H:%M:%SZ') as iso from events")
def f2_json_time(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "events").select("event_id", F.get_json_object("props", "$.k").cast("bigint").alias("k"), F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss'Z'").alias("iso"))


@query()
def v31_query_hash(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "embeddings").select("vec_id", spectral.query_hash(vec.cast("embedding")).alias("query_hash"))


# Recipes

_FIDELITY = f"{_top(K)}, {_weighted(f'{BETA} * {cos("query", "v")}')}, {_UNIT}, f as (select n.qid, sum(n.x * q.u[n.pos + 1]) as f from n join q on n.qid = q.qid group by n.qid)"
_ALL_Q = "q as (select vec_id as qid, v as query, list_transform(v, lambda x: x / sqrt(list_dot_product(v, v))) as u from e)"


def every(spark: SparkSession, sf: str) -> DataFrame:
    return activation.queries_of(table(spark, sf, "embeddings"))


@query(f"with {E}, {_ALL_Q}, {_FIDELITY} select qid, round(f, 6) + 0.0 as fidelity, case when f >= 0.95 then 'DUPLICATE' when f >= 0.85 then 'NEAR' else 'UNIQUE' end as verdict from f")
def x2_dedup_verdict(spark: SparkSession, sf: str) -> DataFrame:
    rows = reads.fidelity(every(spark, sf), book(spark, sf), "fast", k=K, beta=BETA)
    return rows.select("qid", r6("fidelity").alias("fidelity"), recipes.verdict(F.col("fidelity")).alias("verdict"))


@query(f"with {E}, {_ALL_Q}, {_FIDELITY}, c as (select quantile_cont(1 - f, 0.95) as cut from f) select qid, round(1 - f, 6) + 0.0 as score, (1 - f > cut) as anomalous from f, c")
def x3_anomalies(spark: SparkSession, sf: str) -> DataFrame:
    rows = recipes.anomalies(every(spark, sf), book(spark, sf), 0.95, K, BETA)
    return rows.select("qid", r6("score").alias("score"), "anomalous")


_CLASSES = f"t as (select * from (select qid, label, vec_id, v, list_dot_product(u, v) as sim, {cos('query', 'v')} as c, row_number() over (partition by qid, label order by list_dot_product(u, v) desc, vec_id) as rk from q, e) where rk <= {K})"


@query(
    f"with {E}, {Q}, {_CLASSES}, p as (select qid, label, unnest(range(0, 64)) as pos, exp({BETA} * c) as w, v from t), s as (select qid, label, pos, sum(w * v[pos + 1]) as x from p group by all),"
    " f as (select s.qid, label, sum(x * u[pos + 1]) / sqrt(sum(x * x)) as f from s join q on q.qid = s.qid group by s.qid, label), r as (select *, row_number() over (partition by qid order by f desc, label) as rk, lead(f) over (partition by qid order by f desc, label) as nx from f)"
    ' select qid, label as "class", round(f, 6) as fidelity, round(f - nx, 6) + 0.0 as margin from r where rk = 1'
)
def x4_classify(spark: SparkSession, sf: str) -> DataFrame:
    e = table(spark, sf, "embeddings")
    rows = activation.codebook(e).join(e.select(F.col("vec_id").alias("loc_id"), "label"), "loc_id")
    out = recipes.classify(asks(spark, sf), rows, list(range(10)), "label", K, BETA)
    return out.select("qid", "class", r6("fidelity").alias("fidelity"), r6("margin").alias("margin"))


_WEIGHT = "case event_type when 'purchase' then 3 when 'click' then 2 else 1 end"


@query(
    f"with {E}, h as (select user_id, event_id % 500 as item_id, sum({_WEIGHT})::double as weight from events group by 1, 2), p as (select user_id, unnest(range(0, 64)) as pos, weight, v from h join e on vec_id = item_id), s as (select user_id, pos, sum(weight * v[pos + 1]) as x from p group by 1, 2),"
    " c as (select user_id, list(x order by pos) as c from s group by 1), m as (select c.user_id, vec_id as item_id, list_dot_product(c, v) / sqrt(list_dot_product(c, c)) as score from c, e where not exists (select 1 from h where h.user_id = c.user_id and h.item_id = e.vec_id))"
    " select user_id, item_id, round(score, 6) + 0.0 as score, rk from (select *, row_number() over (partition by user_id order by score desc, item_id) as rk from m) where rk <= 5"
)
def x5_recommend(spark: SparkSession, sf: str) -> DataFrame:
    weight = F.expr(_WEIGHT).cast("double")
    history = table(spark, sf, "events").select("user_id", (F.col("event_id") % 500).alias("item_id"), weight.alias("weight"))
    items = table(spark, sf, "embeddings").select(F.col("vec_id").alias("item_id"), vec.cast("embedding").alias("vector"))
    return recipes.recommend(history, items).select("user_id", "item_id", r6("score").alias("score"), F.col("rk").cast("long").alias("rk"))


@query("with x as (select doc_id, n_chars::double as score, quality = 1 as good from labels join documents using (doc_id)), g as (select min(score) filter (good) as a, max(score) filter (not good) as r from x) select round((a + r) / 2, 6) as tau, a as min_accept, r as max_refuse, round((select count(*) from x where score >= (a + r) / 2) / (select count(*) from x), 6) as coverage, (select count(*) from x where not good and score >= (a + r) / 2) as errors from g")
def x9_calibrate_gate(spark: SparkSession, sf: str) -> DataFrame:
    rows = table(spark, sf, "labels").join(table(spark, sf, "documents"), "doc_id").select(F.col("n_chars").cast("double").alias("score"), (F.col("quality") == 1).alias("good"))
    return recipes.calibrate_gate(rows).select(r6("tau").alias("tau"), "min_accept", "max_refuse", r6("coverage").alias("coverage"), "errors")


@query(f"with {E}, c as (select vec_id, unnest(range(0, 64)) as pos, v from e), m as (select vec_id, pos, v[pos + 1] - avg(v[pos + 1]) over (partition by pos) as x from c) select vec_id as qid, pos, round(x / sqrt(sum(x * x) over (partition by vec_id)), 6) + 0.0 as val from m")
def x10_centre(spark: SparkSession, sf: str) -> DataFrame:
    return spread(recipes.centred(every(spark, sf)), "qid", "query")


@query(f"with {E}, {Q}, {_FIDELITY.split(', f as')[0]}, d as (select n.qid, pos, q.u[pos + 1] - x as delta from n join q on n.qid = q.qid) select qid, pos, round(delta, 6) + 0.0 as delta, rk from (select *, row_number() over (partition by qid order by abs(delta) desc, pos) as rk from d) where rk <= 5")
def x12_explain(spark: SparkSession, sf: str) -> DataFrame:
    rows = recipes.explain(asks(spark, sf), book(spark, sf), 5, K, BETA)
    return rows.select("qid", F.col("pos").cast("long").alias("pos"), r6("delta").alias("delta"), F.col("rk").cast("long").alias("rk"))


@query()
def x13_route(spark: SparkSession, sf: str) -> DataFrame:
    e = table(spark, sf, "embeddings")
    rows = activation.codebook(e).join(e.select(F.col("vec_id").alias("loc_id"), "label"), "loc_id")
    prints = reads.fingerprint(rows, K, BETA, key="label").select(F.col("label").alias("shard"), "fingerprint")
    return recipes.route(asks(spark, sf), prints).select("qid", "shard", r6("score").alias("score"), "rk")


@query()
def x8_two_pass(spark: SparkSession, sf: str) -> DataFrame:
    return recipes.two_pass(asks(spark, sf), book(spark, sf), 10, K, BETA).select("qid", "loc_id", r6("score").alias("score"), "rk")


@query()
def x6_forecast(spark: SparkSession, sf: str) -> DataFrame:
    days = table(spark, sf, "orders").groupBy(F.unix_date(F.to_date("o_orderdate")).alias("day")).agg(F.sum("o_totalprice").alias("v"))
    days = days.withColumn("g", F.floor(F.col("day") / 365))
    pairs = recipes.forecast_pairs(days, 6, ["g"], "day", "v")
    cues = pairs.select(F.col("loc_id").alias("qid"), F.concat(F.slice("address", 1, 6), F.array(F.lit(0.0))).alias("query"))
    return recipes.forecast(cues, pairs.drop("g"), 6).select("qid", F.round("forecast", 4).alias("forecast"))


@query()
def x11_null_floor(spark: SparkSession, sf: str) -> DataFrame:
    return recipes.null_floor(asks(spark, sf), book(spark, sf)).select("seed", r6("best").alias("best"))


@query("with p as (select l_returnflag as a, l_linestatus as b, count(*) as n from lineitem group by 1, 2), t as (select sum(n) as total from p) select a as l_returnflag, b as l_linestatus, round(greatest(0, ln(n * total / ((select sum(n) from p x where x.a = p.a) * (select sum(n) from p y where y.b = p.b)))), 6) + 0.0 as ppmi from p, t")
def x15_ppmi(spark: SparkSession, sf: str) -> DataFrame:
    return recipes.ppmi(table(spark, sf, "lineitem"), "l_returnflag", "l_linestatus").withColumn("ppmi", r6("ppmi"))


@query()
def x16_world_model(spark: SparkSession, sf: str) -> DataFrame:
    e = table(spark, sf, "events")
    step = Window.partitionBy("user_id").orderBy("ts", "event_id")
    moves = e.select(F.col("event_type").alias("state"), F.col("event_type").alias("action"), F.lead("event_type").over(step).alias("next")).where("next is not null")
    return spread(recipes.world_step(moves, D), "state", "counter")


@query(
    f"with {E}, q as (select vec_id as qid, v as whole, list_transform(range(1, 65), lambda i: case when (i - 1) % 4 = 0 then 0.0 else v[i] end) as query, list_transform(range(1, 65), lambda i: case when (i - 1) % 4 = 0 then 0.0 else v[i] end) as u from e where vec_id % 100 = 0), {_top(K)}, {_weighted('50.0 * list_dot_product(query, v)')}"
    " select s.qid, round(sum(x * whole[pos + 1]) / sqrt(sum(x * x) * sum(whole[pos + 1] * whole[pos + 1])), 6) as recall from s join q on q.qid = s.qid group by s.qid"
)
def x22_partial_cue(spark: SparkSession, sf: str) -> DataFrame:
    cues = recipes.partial_cue(asks(spark, sf))
    rows = attention.read_attention(cues.select("qid", "query"), book(spark, sf), K, 50.0).select("qid", "result").join(cues.select("qid", "whole"), "qid")
    return rows.select("qid", r6(vec.cosine("result", "whole")).alias("recall"))


@query(f"with {E}, {Q}, {_FIDELITY} select qid, round(f, 6) + 0.0 as fidelity, round(1 - f, 6) + 0.0 as novelty from f")
def x19_familiarity(spark: SparkSession, sf: str) -> DataFrame:
    return recipes.familiarity(asks(spark, sf), book(spark, sf), K, BETA).select("qid", r6("fidelity").alias("fidelity"), r6("novelty").alias("novelty"))


def flagship(spark: SparkSession, sf: str) -> DataFrame:
    """Exact top-k activation with one-step reconstruction."""
    return r1_read_fast(spark, sf)


def queries() -> dict[str, Query]:
    return dict(_QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(_SQL)
