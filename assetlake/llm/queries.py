"""One registered query for each operator, over its whole table, and SQL where it can say the same."""

from __future__ import annotations

import functools
import string
from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from assetlake.llm import ann, bpe, conversations, itq, licences, mixing, packing, quality, secrets, sharding, simhash, spelling, warc
from assetlake.llm.common import table
from assetlake.operators.skew import null_safe_join
from assetlake.session import scratch_path

_QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
_SQL: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def add(fn):
        _QUERIES[name] = fn
        if sql is not None:
            _SQL[name] = sql
        return fn

    return add


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return dict(_QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(_SQL)


@query("op1_quality_grades")
def op1(spark: SparkSession, folder: str) -> DataFrame:
    docs = table(spark, folder, "documents").select("doc_id", "text")
    model = quality.fit(quality.graded_labels(docs, table(spark, folder, "labels")), 3)
    out = quality.grade_texts(docs, model)
    return out.select(
        "doc_id", "expected_grade", F.element_at("tails", 1).alias("p_grade_1_or_more"), F.element_at("tails", 2).alias("p_grade_2"),
        quality.accepted().alias("kept"))


@query("op2_adaptive_scan")
def op2(spark: SparkSession, folder: str) -> DataFrame:
    return ann.search(table(spark, folder, "embeddings"), lambda i: i % 20 == 0)


_LINKS_SQL = """
with recursive v as (select vec_id, embedding::double[] as e from embeddings),
p as (select a.vec_id as a, b.vec_id as b from v a join v b on a.vec_id <> b.vec_id
  where list_dot_product(a.e, b.e) / sqrt(list_dot_product(a.e, a.e)) / sqrt(list_dot_product(b.e, b.e)) >= 0.95),
r as (select a as node, b as reach from p union select r.node, p.b from r join p on r.reach = p.a),
c as (select node, min(reach) as low from r group by node), d as (select a, count(*) as n from p group by a)
select vec_id, coalesce(n, 0)::bigint as n_links, least(vec_id, coalesce(low, vec_id)) as component_id,
  vec_id <= coalesce(low, vec_id) as kept
from v left join c on node = vec_id left join d on a = vec_id"""


@query("op3_itq_duplicates", _LINKS_SQL)
def op3(spark: SparkSession, folder: str) -> DataFrame:
    return itq.near_duplicates(table(spark, folder, "embeddings"))


@query("op5_licences")
def op5(spark: SparkSession, folder: str) -> DataFrame:
    return licences.licences(table(spark, folder, "documents"))


# Fixed values of the result's form: the parts between the matches give the positions.
def _spans_sql(kind: str, rank: int, pattern: str, least: int, group: int) -> str:
    p = pattern.replace("'", "''")
    return f"""
    select doc_id, {rank} as rank, '{kind}' as kind, s as start_at, s + w as end_at from (
      select doc_id, w, g, sum(gap + w) over (partition by doc_id order by i) - w as s from (
        select doc_id, unnest(range(1, n + 1)) as i, unnest(list_transform(gaps[1:n], lambda x: length(x))) as gap,
          unnest(list_transform(whole, lambda x: length(x))) as w, unnest(list_transform(part, lambda x: length(x))) as g
        from (select doc_id, string_split_regex(text, '{p}') as gaps, regexp_extract_all(text, '{p}', 0) as whole,
            regexp_extract_all(text, '{p}', {group}) as part, length(regexp_extract_all(text, '{p}', 0)) as n
          from documents where regexp_matches(text, '{p}'))))
    where g >= {least}"""


_SECRETS_SQL = f"""
with spans as ({" union all ".join(_spans_sql(r.kind, i, r.pattern, r.least, r.group) for i, r in enumerate(secrets.RULES))}),
per as (select doc_id, count(*) filter (kind = 'assign') as a, count(*) filter (kind = 'access') as k, count(*) filter (kind = 'hex') as h,
    string_agg(kind || ':' || start_at::bigint || ':' || end_at::bigint, ',' order by start_at, rank) as spans from spans group by doc_id)
select d.doc_id, coalesce(a, 0)::bigint as n_assign, coalesce(k, 0)::bigint as n_access, coalesce(h, 0)::bigint as n_hex,
  sha256(coalesce(spans, '')) as base_sha256, coalesce(spans, '') as spans
from documents d left join per using (doc_id)"""


@query("op6_secret_scan", _SECRETS_SQL)
def op6(spark: SparkSession, folder: str) -> DataFrame:
    docs = table(spark, folder, "documents").select("doc_id", "text")
    ledger = secrets.update_ledger(docs)
    out = secrets.findings(docs, ledger).select("doc_id", "found")
    count = lambda kind: F.size(F.filter("found", lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")
    spans = secrets.joined_spans("found")
    return out.select("doc_id", count("assign"), count("access"), count("hex"), F.sha2(spans, 256).alias("base_sha256"), spans.alias("spans"))


@query("op8_pack_windows")
def op8(spark: SparkSession, folder: str) -> DataFrame:
    return packing.pack(table(spark, folder, "documents"), functools.partial(packing.word_tokens_of, public_tokenizers.path("word_bpe_49k.json")))


@query("op7_simhash_duplicates")
def op7(spark: SparkSession, folder: str) -> DataFrame:
    out = simhash.near_duplicates(table(spark, folder, "documents"))
    return out.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


@query("op9_byte_shards")
def op9(spark: SparkSession, folder: str) -> DataFrame:
    out = sharding.shard_by_bytes(table(spark, folder, "documents"), 8)
    return out.select(
        "doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))


@query("op10_mix_sources")
def op10(spark: SparkSession, folder: str) -> DataFrame:
    _, _, pieces = mixing.mix(table(spark, folder, "documents"))
    return mixing.taken_words(pieces)


_WARC_SQL = """
with p as (select page_id, coalesce(html, '') as body from pages),
d as (select page_id, strlen(body)::bigint as payload_bytes, sha256(body) as payload_digest,
    min(page_id) over (partition by sha256(body)) as first from p)
select page_id, payload_bytes, payload_digest,
  case when payload_bytes >= 100 and first < page_id then 'revisit' else 'response' end as record_type,
  case when payload_bytes >= 100 and first < page_id then first end as refers_to
from d"""


@query("op4_warc_archives", _WARC_SQL)
def op4(spark: SparkSession, folder: str) -> DataFrame:
    path = scratch_path(spark, "warc")
    warc.write_archives(table(spark, folder, "pages"), path)
    return warc.read_archives(spark, path, payloads=False).select(
        "page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


@query("op13_bpe_round_trip")
def op13(spark: SparkSession, folder: str) -> DataFrame:
    path = public_tokenizers.path("byte_bpe_50k.json")
    ids = bpe.encode(table(spark, folder, "documents"), path)
    told = ids.select(
        "doc_id", "ids", F.size("ids").cast("long").alias("n_tokens"), F.sha2(F.array_join(F.col("ids").cast("array<string>"), ","), 256).alias("ids_sha256"))
    texts = bpe.decode(told, path, keep=["doc_id", "n_tokens", "ids_sha256"])
    return texts.select("doc_id", "n_tokens", "ids_sha256", F.sha2("text", 256).alias("decoded_sha256"))


def _damaged(rows: DataFrame) -> DataFrame:
    """Conversations with a fault of a known kind in every fourth turn or so."""
    kept = rows.select("conv_id", "turn", *[F.coalesce(c, F.lit(" ")).alias(c) for c in ("role", "text")])
    name = F.concat_ws(":", *[F.coalesce(F.col(c).cast("string"), F.lit(" ")) for c in ("conv_id", "turn")])
    fate = kept.withColumn("fate", F.crc32(name.cast("binary")) % 20).filter("fate <> 0")
    text = F.when(F.col("fate") == 1, "").when(F.col("fate") == 2, F.regexp_replace("text", "[.!?]", "")).otherwise(F.col("text"))
    role = F.when(F.col("fate") == 4, "user").otherwise(F.col("role"))
    times = F.array_repeat(F.lit(1), F.when(F.col("fate") == 3, 2).otherwise(1))
    return fate.select("conv_id", "turn", role.alias("role"), text.alias("text"), F.explode(times)).drop("col")


@query("op12_conversation_repair")
def op12(spark: SparkSession, folder: str) -> DataFrame:
    rows = table(spark, folder, "conversations")
    found = conversations.audits(_damaged(rows))
    all_ = null_safe_join(rows.select("conv_id").distinct(), found, ["conv_id"], "left")
    return all_.select(
        "conv_id", *[F.coalesce(c, F.lit(0)).cast("long").alias(c) for c in ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")],
        F.coalesce("audit", F.lit("")).alias("audit"), F.coalesce("repaired_sha256", F.sha2(F.lit(""), 256)).alias("repaired_sha256"))


# A word that a cut of one letter in 97 spoils, with the letters as code points; the check sum by its table of bytes.
_SPELLING_SQL = """
with recursive bits as (select i, i::ubigint as c, 0 as k from range(256) t(i)
  union all select i, case when c & 1 = 1 then xor(c >> 1, 3988292384::ubigint) else c >> 1 end, k + 1 from bits where k < 8),
crc as (select list(c order by i) as t from bits where k = 8),
runs as (select doc_id, translate(r, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') as r, count(*) as n
  from (select doc_id, unnest(regexp_extract_all(text, '[A-Za-z\u00C0-\u00FF]{5,}')) as r from documents) group by all),
summed as (select r, n, xor(4294967295::ubigint, list_reduce(
    list_prepend(4294967295::ubigint, list_transform(range(1, 2 * strlen(k) + 1, 2), lambda p: ('0x' || substr(hex(encode(k)), p, 2))::ubigint)),
    lambda c, b: xor(c >> 8, t[(xor(c & 255, b) + 1)::bigint]))) as h
  from (select r, n, doc_id || ':' || r as k from runs), crc),
v as (select word, sum(n)::bigint as n from (
    select case when h % 97 = 0 then substr(r, 1, (h % length(r))::int) || substr(r, (h % length(r))::int + 2) else r end as word, n from summed)
  where length(word) >= 5 group by word having sum(n) >= 3),
cut as (select word, n, length(word) as m, p, substr(word, 1, p - 1) || substr(word, p + 1) as part from v, lateral (select unnest(range(1, length(word) + 1))) t(p)),
pairs as (select a.word as a, b.word as b, b.n as bn from cut a join cut b on a.part = b.part and a.p = b.p and a.m = b.m and a.word <> b.word
  union select c.word, v.word, v.n from cut c join v on c.part = v.word
  union select v.word, c.word, c.n from cut c join v on c.part = v.word),
near as (select a, count(*) as n_near, max(bn) as bn, min(struct_pack(k := -bn, w := b)).w as b from pairs group by a),
told as (select word, n, coalesce(n_near, 0)::bigint as n_near, case when bn >= 2 * n then b end as form, case when bn >= 2 * n then bn end as form_n
  from v left join near on a = word),
led as (select word, form, 1 as k from told where form is not null
  union all select led.word, told.form, k + 1 from led join told on told.word = led.form where told.form is not null)
select t.word, t.form, coalesce(l.form, t.word) as root, t.n, t.n_near, t.form_n
from told t left join (select word, arg_max(form, k) as form from led group by word) l on l.word = t.word"""


@query("op11_spelling_variants", _SPELLING_SQL)
def op11(spark: SparkSession, folder: str) -> DataFrame:
    docs = table(spark, folder, "documents")
    # A shorter run makes no word of five letters.
    runs = docs.select("doc_id", F.explode(F.regexp_extract_all("text", F.lit("[A-Za-z\u00C0-\u00FF]{5,}"), F.lit(0))).alias("run"))
    low = runs.select("doc_id", F.translate("run", string.ascii_uppercase, string.ascii_lowercase).alias("run"))
    sum_ = F.crc32(F.concat(F.coalesce(F.col("doc_id").cast("string"), F.lit("")), F.lit(":"), "run").cast("binary"))
    at = low.withColumn("sum", sum_).withColumn("at", (F.col("sum") % F.length("run")).cast("int"))
    cut = F.concat(F.substring("run", F.lit(1), F.col("at")), F.substring("run", F.col("at") + 2, F.length("run")))
    words = at.select(F.when(F.col("sum") % 97 == 0, cut).otherwise(F.col("run")).alias("word")).filter(F.length("word") >= 5)
    often = words.groupBy("word").agg(F.count("*").alias("n")).filter("n >= 3")
    return spelling.variants(often).select("word", "form", "root", "n", "n_near", "form_n")
