"""Registered queries of the training-data operators and their DuckDB SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from mnemospark.llm import chat, decontam, gam, packing, rules, sharding, simhash, tokenbin, toxicity, urls

Query = Callable[[SparkSession, str], DataFrame]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents that hold at least half of a benchmark item in tiles of five words or more."""
    return decontam.leaks(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op2_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents in 24 shards whose row counts are at most one apart."""
    out = sharding.shard(table(spark, sf_dir, "documents"), shards=24)
    text = F.coalesce("text", F.lit(""))
    return out.select("doc_id", (F.octet_length(text) + 8).cast("long").alias("size"), F.crc32(text).alias("text_crc32"), F.lit("rows").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))


def op3_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The rule ledger of all documents under the base and the prose policy."""
    out = rules.ledger(table(spark, sf_dir, "documents"), keep=["doc_id"])
    return out.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", (~rules.passes(rules.BASE)).alias("base_failed"), (rules.passes(rules.BASE) & rules.passes(rules.STRICT)).alias("kept"), F.col("failed").alias("failed_rules"))


_PASS = " and ".join(f"not ({rule})" for rule in rules.RULES.values())
_BITS = " + ".join(f"case when {rule} then {rules.BIT[name]} else 0 end" for name, rule in rules.RULES.items())
OP3_SQL = f"""
with d as (select row_number() over () as r, doc_id, coalesce(text, '') as text from documents),
w as (select r, doc_id, text, regexp_extract_all(text, '[^\\x20\\x09-\\x0D]+') as w, list_filter(string_split(text, chr(10)), lambda l: regexp_matches(l, '[^\\x20\\x09-\\x0D]')) as lines from d),
g as (select r, i, array_to_string(w[i:i+4], ' ') as gram from (select r, w, unnest(range(1, len(w) - 3)) as i from w where len(w) >= 5)),
t as (select r, i from (select r, i, count(*) over (partition by r, gram) as n from g) where n > 1),
p as (select r, count(distinct i + k) as n from t, (select unnest(range(0, 5)) as k) group by r),
m as (select w.r, doc_id, len(w) as n_words, coalesce(list_sum(list_transform(w, lambda x: length(x))), 0) as word_chars,
  len(regexp_extract_all(text, '[#*$%&|<>]')) as n_symbols, len(lines) - len(list_distinct(lines)) as n_dup_lines, coalesce(p.n, 0) as n_repeat_words, len(lines) as n_lines,
  coalesce(len(list_filter(range(1, len(w)), lambda i: w[i] = w[i + 1])), 0) as n_same_next,
  len(list_filter(w, lambda x: regexp_matches(x, '[A-Z]') and not regexp_matches(x, '[a-z]') and strlen(x) > 1)) as n_upper
  from w left join p on w.r = p.r)
select doc_id, n_words::bigint as n_words, word_chars::bigint as word_chars, n_symbols::bigint as n_symbols, n_dup_lines::bigint as n_dup_lines, n_repeat_words::bigint as n_repeat_words,
  ({rules.RULES["few_words"]} or {rules.RULES["repeated_windows"]}) as base_failed, ({_PASS}) as kept, ({_BITS})::bigint as failed_rules from m
"""  # noqa: S608

#: The listed rules: host, path prefix, verdict.
URL_RULES = [
    ("com", "/en/", "block"),
    ("example.com", "/en/7", "allow"),
    ("net", "/de/", "allow"),
    ("example.net", "/de/8", "block"),
    ("org", "/es/", "block"),
]


def op4_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every page's url under the listed rules."""
    return urls.judge(table(spark, sf_dir, "pages"), urls.entries(spark, URL_RULES))


OP4_SQL = f"""
with rules(rule_host, rule_path, verdict) as (values {", ".join(str(r) for r in URL_RULES)}),
u as (select row_number() over () as r, page_id, case when contains(url, '://') then substr(url, instr(url, '://') + 3) else '' end as rest from pages),
h as (select r, page_id, rest, regexp_extract(rest, '^[^/?#]*') as raw_host from u),
p as (select r, page_id, translate(raw_host, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') as host, regexp_extract(substr(rest, length(raw_host) + 1), '^[^?#]*') as path from h),
j as (select p.*, rule_host || rule_path as rule, verdict, row_number() over (partition by r order by length(rule_host || rule_path) desc nulls last, length(rule_host) desc) as best
  from p left join rules on (host = rule_host or ends_with(host, '.' || rule_host)) and starts_with(path, rule_path))
select page_id, host, path, rule, coalesce(verdict, 'allow') as verdict from j where best = 1
"""  # noqa: S608


def op5_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The quality score of all documents; labels of fold 0 of 5 are held out."""
    docs = table(spark, sf_dir, "documents")
    out = gam.score(docs, gam.train(docs, table(spark, sf_dir, "labels")), keep=["doc_id"])
    return out.select("doc_id", gam.held_out(F.col("doc_id"), 5, 0).alias("held_out"), "score", (F.col("score") >= 0.3).cast("int").alias("predicted"))


def tokenizer_path() -> str:
    """The public word-level vocabulary file; it is read where it is and never copied."""
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def op6_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents packed into sequences of at most 2048 ids."""
    out = packing.pack(table(spark, sf_dir, "documents"), tokenizer_path(), size=2048, end_id=0)
    return out.select("doc_id", "piece", "start", "length", F.crc32("ids").alias("ids_crc32"), "sequence_id", "offset")


def op7_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents' ids, written in containers and read back."""
    return tokenbin.round_trip(table(spark, sf_dir, "documents"), tokenizer_path(), end_id=2)


def op8_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fingerprints of three-word shingles, linked at three bits or fewer."""
    out = simhash.near_duplicates(table(spark, sf_dir, "documents"), width=3, radius=3)
    return out.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def op9_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The toxicity score of all documents; labels of fold 1 of 3 are held out."""
    docs = table(spark, sf_dir, "documents")
    out = toxicity.score(docs, toxicity.train(docs, table(spark, sf_dir, "labels")), keep=["doc_id"])
    return out.select("doc_id", gam.held_out(F.col("doc_id"), 3, 1).alias("held_out"), "score", (F.col("score") >= 0.7).cast("int").alias("predicted"))


SAID = "\\### Assistant: </turn> ok"


def op10_chat(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All conversations and conversation -7 in budgeted windows, read back from the formatted text."""
    extra = spark.range(2).select(F.lit(-7).cast("long").alias("conv_id"), F.col("id").alias("turn"), F.when(F.col("id") == 0, "user").otherwise("assistant").alias("role"), F.lit(SAID).alias("text"))
    turns = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text").unionByName(extra)
    return chat.read_back(chat.windows(turns))


def _count(column: str, pattern: str) -> str:
    return f"len(regexp_extract_all({column}, '{pattern}'))"


_ROOM = f"greatest(1, ({chat.BUDGET - chat.HISTORY} - coalesce(max(size) filter (is_system) over (partition by conv_id), 0)) // 2)"
OP10_SQL = f"""
with c as (select conv_id, turn, coalesce(role, '') as role, coalesce(text, '') as text from conversations union all values (-7, 0, 'user', '{SAID}'), (-7, 1, 'assistant', '{SAID}')),
p as (select *, {_count("text", chat.TOKEN)} + {_count("role", chat.TOKEN)} + {chat.TURN_TOKENS} as size, row_number() over (partition by conv_id order by turn nulls first, role, text) as place,
  {len(chat.OPEN) + len("new ") + len(">") + len(chat.SHUT)} + length(role) + length(text) + {_count("role || text", "[<>" + chr(92) * 2 + "]")} as chars from c),
s as (select *, coalesce(place = min(place) filter (role = 'system') over (partition by conv_id), false) as is_system from p),
b as (select *, {_ROOM} as half, coalesce(sum(size) filter (not is_system) over (partition by conv_id order by place rows between unbounded preceding and 1 preceding), 0) as before from s),
w as (select *, before // half as win from b),
n as (select conv_id, win, lead(min(before)) over (partition by conv_id order by win) as next_before, max(win) over (partition by conv_id) as last from w group by conv_id, win),
k as (select w.*, (case when is_system then (select count(*) from n m where m.conv_id is not distinct from w.conv_id and m.win > w.win)
  when next_before - before <= least({chat.HISTORY}, half) then 1 else 0 end) as copies from w join n on n.conv_id is not distinct from w.conv_id and n.win = w.win)
select conv_id, count(*) as n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' order by place)) as turns_sha256,
  coalesce(sum(length(text)) filter (role = 'assistant'), 0)::bigint as loss_chars, sha256(coalesce(string_agg(text, '' order by place) filter (role = 'assistant'), '')) as loss_sha256,
  sum(chars * (1 + copies))::bigint as formatted_chars from k group by conv_id
"""  # noqa: S608


def pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The five stages of corpus_pipeline over all documents."""
    import corpus_pipeline

    return corpus_pipeline.run(spark, sf_dir)


def queries() -> dict[str, Query]:
    return {f.__name__: f for f in (op1_decontaminate, op2_sharding, op3_rules, op4_url_filter, op5_quality, op6_packing, op7_tokens, op8_simhash, op9_toxicity, op10_chat, pipeline)}


def oracle_sql() -> dict[str, str]:
    return {"op3_rules": OP3_SQL, "op4_url_filter": OP4_SQL, "op10_chat": OP10_SQL}
