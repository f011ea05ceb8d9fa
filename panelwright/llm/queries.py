"""The registered query of each training-data operator, with production parameters over whole tables."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import audio_features, decontaminate, html_extract, language_id, license_scan, mixing, passages, prefix_trie, quality, secret_scan, simhash, token_counts, vector_codes
from .common import table

TOKENIZER = public_tokenizers.path("byte_bpe_50k.json")


def op1_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = secret_scan.secret_scan(table(spark, sf_dir, "documents"))
    base = F.filter("spans", lambda s: s["kind"].isin(*secret_scan.BASE_KINDS))
    return found.select(
        "doc_id",
        *[secret_scan.count_kind(k).alias(f"n_{k}") for k in secret_scan.BASE_KINDS],
        F.sha2(secret_scan.joined(base), 256).alias("base_sha256"),
        secret_scan.joined(F.col("spans")).alias("spans"),
        secret_scan.count_kind("guess").alias("n_guess"),
    )


def op3_passages(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = passages.with_classes(passages.repeated_passages(table(spark, sf_dir, "documents")))
    return found.select(
        F.col("a").alias("doc_id"), F.col("b").alias("other_doc_id"), "a_start", "a_end", "b_start", "b_end", "n_equal", F.round("identity", 4).alias("identity"), F.col("class").alias("class_id")
    )


def op4_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    classes = simhash.near_duplicate_classes(table(spark, sf_dir, "documents"))
    digits = F.lower(F.lpad(F.hex("fp"), 16, "0"))
    return classes.select("doc_id", digits.alias("fingerprint"), F.col("component").alias("component_id"))


def op7_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    hits = decontaminate.find_hits(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    counted = hits.select(
        "doc_id",
        F.col("n_words").cast("long").alias("n_words"),
        F.expr(decontaminate.N_HIT).alias("n_hit"),
        F.size("items").cast("long").alias("n_items"),
        F.sha2(F.array_join("items", ","), 256).alias("items_sha256"),
    )
    return counted.withColumn("contaminated", decontaminate.contaminated())


OP7_SQL = r"""
with w as (
  select doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') as w
  from documents
), b as (
  select coalesce(cast(item_id as varchar), 'null') as item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') as w
  from benchmark
), grams as (
  select distinct item_id, list_slice(w, i, i + 12) as g
  from (select item_id, w, unnest(generate_series(1, greatest(1, len(w) - 12))) as i from b where len(w) > 0)
), lengths as (select distinct len(g) as n from grams),
spots as (
  select doc_id, i, n, list_slice(w, i, i + n - 1) as g
  from (select doc_id, w, n, unnest(generate_series(1, len(w) - n + 1)) as i from w cross join lengths where len(w) >= n)
), met as (select doc_id, i, n, item_id from spots join grams using (g)),
hit as (
  select doc_id, count(distinct p) as n_hit
  from (select doc_id, unnest(generate_series(i, i + n - 1)) as p from met) group by doc_id
), items as (
  select doc_id, count(distinct item_id) as n_items, string_agg(distinct item_id, ',' order by item_id) as ids from met group by doc_id
)
select w.doc_id, cast(len(w.w) as bigint) as n_words, cast(coalesce(n_hit, 0) as bigint) as n_hit,
  cast(coalesce(n_items, 0) as bigint) as n_items, sha256(coalesce(ids, '')) as items_sha256,
  coalesce(n_hit, 0) > 0 and 20 * coalesce(n_hit, 0) >= len(w.w) as contaminated
from w left join hit using (doc_id) left join items using (doc_id)
"""


def op8_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = license_scan.license_scan(table(spark, sf_dir, "documents"))
    names = F.transform("found", lambda x: x["license"])
    return found.select(
        "doc_id",
        F.size("found").cast("long").alias("n_blocks"),
        F.array_join(F.array_sort(F.array_distinct(names)), ",").alias("licenses"),
        F.array_join(F.transform("found", lambda x: F.concat_ws(":", x["license"], x["start"], x["end"])), ",").alias("spans"),
        F.coalesce(F.array_max(F.transform("found", lambda x: x["saving"])), F.lit(0.0)).alias("best_saving"),
        F.array_join(F.flatten(F.transform("found", lambda x: x["differences"])), "; ").alias("differences"),
    )


def op9_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    counts = token_counts.prefix_token_counts(table(spark, sf_dir, "documents"), TOKENIZER, keep_steps=False)
    return counts.withColumn("over_limit", token_counts.over_limit("n_tokens", 512))


def op2_audio_features(spark: SparkSession, sf_dir: str) -> DataFrame:
    stored = audio_features.audio_features(table(spark, sf_dir, "documents"))
    payload = audio_features.wav_payload("media")
    return stored.select(
        "doc_id",
        "n_bytes",
        F.octet_length(payload).cast("long").alias("payload_bytes"),
        F.sha2(payload, 256).alias("payload_sha256"),
        F.crc32(F.substring(payload, -audio_features.PAD, audio_features.PAD)).alias("tail_crc32"),
        F.octet_length("media").cast("long").alias("media_bytes"),
        F.sha2("media", 256).alias("media_sha256"),
        F.concat_ws(
            ":",
            F.size("segments"),
            F.round(F.expr("aggregate(segments, 0D, (t, s) -> t + s.end_s - s.start_s)"), 2),
            F.sha2("tensors", 256),
        ).alias("feature"),
        F.array_join(F.transform("segments", lambda s: F.concat_ws("-", s["start_s"], s["end_s"])), ",").alias("segments"),
    )


def op5_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    model = language_id.fit(docs.where(~language_id.held_out()))
    return language_id.predict(docs.select("doc_id", "text"), model).select("doc_id", language_id.held_out().alias("held_out"), "lang_pred", "score")


def op6_temperature_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(table(spark, sf_dir, "documents"), mixing.word_tokens(), repetition=4.0, block_tokens=1_000_000)


OP6_SQL = r"""
with recursive d as (
  select doc_id as id, source, cast(len(regexp_extract_all(coalesce(text, ''), '[^ \t\n\x0B\f\r]+')) as bigint) as n from documents
), s as (select source, cast(sum(n) as bigint) as tokens from d group by source having sum(n) > 0),
p as (select source, tokens, tokens / cast((select sum(tokens) from s) as double) as p from s),
bis as (
  select 0 as k, 0.0::double as lo, 1.0::double as hi
  union all
  select k + 1, case when rep <= 4.0 then lo else mid end, case when rep <= 4.0 then mid else hi end
  from (select k, lo, hi, (lo + hi) / 2 as mid, (select max(pow(p, (lo + hi) / 2) / tokens) / sum(pow(p, (lo + hi) / 2)) * sum(tokens) from p) as rep from bis where k < 48)
), e as (
  select case when (select max(1.0::double / tokens) / count(*) * sum(tokens) from p) <= 4.0 then 0.0::double else (select hi from bis where k = 48) end as x
), quotas as (
  select source, tokens, cast(round(pow(p, x) / (select sum(pow(p, x)) from p cross join e) * cast((select sum(tokens) from s) as double)) as bigint) as quota from p cross join e
), copies as (
  select d.id, d.source, d.n, q.tokens, q.quota, unnest(generate_series(0, (q.quota - 1) // q.tokens)) as epoch from d join quotas q on d.source is not distinct from q.source where q.quota > 0
), placed as (
  select *, epoch * tokens + coalesce(sum(n) over (partition by source, epoch order by cast('0x' || substr(md5(concat_ws('-', cast(id as varchar), cast(epoch as varchar), '0')), 1, 13) as bigint), id rows between unbounded preceding and 1 preceding), 0) as at_token from copies
), blocks as (
  select *, cast(floor(at_token / cast(quota as double) * greatest(1, ceil((select sum(tokens) from s) / 1000000.0::double))) as bigint) as block from placed where at_token < quota
)
select id as doc_id, source, cast(epoch as bigint) as epoch, block, cast(row_number() over (partition by block order by cast('0x' || substr(md5(concat_ws('-', 'block', cast(block as varchar), cast(epoch as varchar), cast(id as varchar), '0')), 1, 13) as bigint), id, epoch) - 1 as bigint) as position, n as n_tokens
from blocks
"""


def op10_html_extract(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "pages").select(F.struct("page_id", "url").alias("page"), "html")
    text = html_extract.extract_main_text(pages, "page")
    return text.select("page.page_id", "page.url", "text", F.char_length("text").cast("long").alias("n_chars"))


def op11_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    scored = quality.quality(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"), ~quality.held_out("id"))
    return scored.select(F.col("id").alias("doc_id"), quality.held_out("id").alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


def op12_conversation_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    return prefix_trie.prefix_trie(table(spark, sf_dir, "conversations"))


OP12_SQL = r"""
with turns as (
  select cast(conv_id as bigint) as c, turn, coalesce(role, '') as role, coalesce(text, '') as text from conversations where conv_id is not null
), convs as (
  select c, list({'role': role, 'text': text} order by turn nulls first, sha256(length(role) || ':' || role || text)) as own from turns group by c
), sums as (
  -- CRC-32 bit by bit: each byte comes with seven zeros, and every entry shifts once
  select c, own, c - c % 100 as base,
    xor(list_reduce(list_prepend(4294967295::bigint, flatten(list_transform(string_split(cast(c as varchar), ''), lambda x: [cast(ascii(x) as bigint), 0, 0, 0, 0, 0, 0, 0]))),
      lambda a, x: xor(xor(a, x) >> 1, 3988292384::bigint * (xor(a, x) & 1))), 4294967295::bigint) % 6 as h
  from convs
), paths as (
  select s.c, list_concat(coalesce(list_slice(b.own, 1, s.h), []), list_slice(s.own, s.h + 1, len(s.own))) as path
  from sums s left join convs b on b.c = s.base
), prefixes as (
  select c, unnest(generate_series(0, len(path))) as depth, path, len(path) as n from paths
), visits as (
  select c, depth, n, list_slice(path, 1, depth) as prefix, list_slice(path, 1, depth - 1) as above, case when depth > 0 then length(path[depth].text) else 0 end as chars from prefixes
), nodes as (
  select depth, prefix, min(c) as conv_id, count(distinct c) as n_convs, any_value(above) as above, any_value(chars) as chars, max(n) > depth as has_child,
    sha256(coalesce(string_agg(cast(c as varchar), ',' order by c) filter (n = depth), '')) as ends_sha256
  from visits group by depth, prefix
), numbered as (select *, row_number() over () as node from nodes),
up as (
  -- each node with every node of its path
  select v.node as top, b.node as below from (select n.node, v.c, n.depth from numbered n join visits v using (depth, prefix)) v
  join (select n.node, v.c, n.depth from numbered n join visits v using (depth, prefix)) b on v.c = b.c and b.depth >= v.depth group by 1, 2
), totals as (
  select top as node, count(*) filter (not b.has_child) as n_leaves, cast(sum((b.n_convs - 1) * b.chars) as bigint) as saved_tokens from up join numbered b on b.node = up.below group by 1
), children as (select p.node, count(*) as n_children from numbered k join numbered p on k.depth = p.depth + 1 and k.above = p.prefix group by 1)
select n.conv_id, cast(n.depth as bigint) as depth, p.conv_id as parent_conv_id, n.n_convs, coalesce(k.n_children, 0) as n_children, t.n_leaves, t.saved_tokens, n.ends_sha256
from numbered n left join numbered p on n.depth = p.depth + 1 and n.above = p.prefix left join children k on k.node = n.node join totals t on t.node = n.node
"""


def op13_vector_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    coded, books = vector_codes.vector_codes(table(spark, sf_dir, "embeddings"))
    return coded.select(
        F.col("id").alias("vec_id"), F.lower(F.hex("code")).alias("code"), "error", "label_error", F.lit(books.sha256() if books else None).cast("string").alias("codebooks_sha256"), "label"
    )


def _op13_sql(rounds: int = 2) -> str:
    """Each round as two named queries: the nearest entries, then the floors of their parts' means."""
    far = "list_sum(list_transform(generate_series(1, len(x)), lambda i: (x[i] - b.entry[i]) * (x[i] - b.entry[i])))"
    near = "select row, p, arg_min(e, {{'d': d, 'e': e}}) as e, min(d) as d from (select row, parts.p, b.e, " + f"coalesce({far}, 0)" + " as d from parts join books{k} b on b.p = parts.p) group by row, p"
    steps = []
    for k in range(rounds):
        steps.append(f"near{k} as ({near.format(k=k)})")
        steps.append(
            f"""books{k + 1} as (
  select p, e, coalesce(m.entry, b.entry) as entry from books{k} b left join (
    select p, e, list(cast(floor(s / n) as bigint) order by i) as entry from (
      select p, e, i, sum(x[i]) as s, count(*) as n from (select p, e, x, unnest(generate_series(1, len(x))) as i from near{k} join parts using (row, p)) group by p, e, i
    ) group by p, e
  ) m using (p, e)
)"""
        )
    steps.append(f"near{rounds} as ({near.format(k=rounds)})")
    return f"""
with kept as (
  select vec_id, label, row_number() over (order by vec_id nulls last, embedding) - 1 as row, list_transform(embedding, lambda x: cast(floor(256 * cast(x as double)) as bigint)) as v
  from embeddings where embedding is not null and len(list_filter(embedding, lambda x: x is null or not isfinite(x))) = 0
), parts as (
  select row, p, list_slice(v, p * (len(v) // 16) + 1, (p + 1) * (len(v) // 16)) as x from (select row, v, unnest(generate_series(0, 15)) as p from kept)
), books0 as (select p, row as e, x as entry from parts where row < 64),
{", ".join(steps)},
coded as (
  select row, string_agg(printf('%02x', e), '' order by p) as code, cast(sum(d) as bigint) as error from near{rounds} group by row
), named as (select vec_id, label, code, error from coded join kept using (row)),
sums as (select label, cast(sum(error) as bigint) as label_error from named group by label)
select vec_id, code, error, label_error, (select sha256(string_agg(array_to_string(entry, ','), ',' order by p, e)) from books{rounds}) as codebooks_sha256, named.label
from named join sums on named.label is not distinct from sums.label
"""


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f
    for f in (
        op1_secret_scan, op2_audio_features, op3_passages, op4_simhash, op5_language_id, op6_temperature_mix, op7_decontaminate, op8_license_scan, op9_token_counts, op10_html_extract,
        op11_quality, op12_conversation_trie, op13_vector_codes,
    )
}
ORACLES: dict[str, str] = {"op6_temperature_mix": OP6_SQL, "op7_decontaminate": OP7_SQL, "op12_conversation_trie": OP12_SQL, "op13_vector_codes": _op13_sql()}
