"""The contract's queries, opN_<name>, over whole tables, and their DuckDB oracles."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from strandline.llm import bpe, embedding_dedup, exact_dedup, fill_in_middle, hard_negatives, html_text, mixing, ngram_join, pii, quality, sharding, toxicity, url_filter
from strandline.llm.common import WORD, sql_lower_ascii, table

Query = Callable[[SparkSession, str], DataFrame]


def source_weights(sources: list) -> dict:
    """1, 2, 3, repeating, over the sources by code point, null last."""
    return {s: i % 3 + 1 for i, s in enumerate(sorted(sources, key=lambda s: (s is None, s or "")))}


def contract_targets(sizes: dict) -> dict:
    return mixing.capped_shares(sizes, source_weights(list(sizes)))


def words(text: str) -> F.Column:
    return F.regexp_count(F.coalesce(F.col(text), F.lit("")), F.lit(WORD)).cast("long")


def op1_mix_to_target_weights(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", words("text").alias("size"), F.array("source").alias("sources"))
    chosen, sizes, targets = mixing.mix(docs, contract_targets)
    totals = F.broadcast(spark.createDataFrame([(s, n, targets[s]) for s, n in sizes.items()], "source string, source_size long, target double"))
    rows = chosen.select(F.col("id").alias("doc_id"), "size", F.col("sources")[0].alias("s"), (F.col("size") * F.col("repeats")).alias("taken"))
    return rows.join(totals, F.col("s").eqNullSafe(F.col("source"))).select("doc_id", "size", "source_size", "target", "taken")


OP1_SQL = r"""
with d as (
  select doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+'))::bigint as size from documents
), s as (
  select source, sum(size)::bigint as n, ((row_number() over (order by source nulls last) - 1) % 3 + 1)::double as w from d group by source
), o as (
  select *, (select sum(n)::double from s) - coalesce(sum(3.0::double * n) over before, 0.0) as lft, sum(w) over (order by 3 * n / w, source nulls last rows between current row and unbounded following) as wl
  from s window before as (order by 3 * n / w, source nulls last rows between unbounded preceding and 1 preceding)
), f as (
  select min(row(k, lft, wl)) as open from (select *, row_number() over (order by 3 * n / w, source nulls last) as k from o) where 3.0 * n > lft * w / wl
), t as (
  select source, n, case when open is null or k < open[1] then (3 * n)::double else open[2] * w / open[3] end as target
  from (select *, row_number() over (order by 3 * n / w, source nulls last) as k from o), f
), p as (
  select *, case when n = 0 then 0 else want // n end as passes, case when n = 0 then 0 else want % n end as rest
  from (select *, floor(target + 0.5)::bigint as want from t)
), h as (
  select d.*, p.n, p.target, p.passes, p.rest, md5(concat_ws('|', 'mix', d.doc_id::varchar, d.size::varchar)) as h
  from d join p on d.source is not distinct from p.source
), c as (
  select *, sum(size) over (partition by source order by h, doc_id rows unbounded preceding) <= rest as picked from h
), g as (
  select source, any_value(rest) - sum(case when picked then size else 0 end) as gap from c group by source
), x as (
  select c.source, min(row(abs(size - gap), h)) as best from c join g on c.source is not distinct from g.source
  where not picked and size > 0 and abs(size - gap) < gap group by c.source
)
select doc_id, size, n as source_size, target,
  (size * (passes + case when picked or (best is not null and c.h = best[2]) then 1 else 0 end))::bigint as taken
from c left join x on c.source is not distinct from x.source
"""


def op2_embedding_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = embedding_dedup.near_vectors(table(spark, sf_dir, "embeddings"))
    return found.withColumnRenamed("id", "vec_id").withColumn("kept", F.coalesce(F.col("vec_id") == F.col("component_id"), F.lit(False)))


def op3_ngram_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    classes = ngram_join.near_classes(table(spark, sf_dir, "documents"))
    return classes.select(F.col("id").alias("doc_id"), F.col("n").alias("n_shingles"), F.col("rep.id").alias("component_id"))


def held_out(doc_id: str = "doc_id") -> F.Column:
    """Rows whose labels are never learnt from."""
    return F.crc32(F.col(doc_id).cast("string")) % 3 == 1


def toxicity_model(docs: DataFrame, labels: DataFrame) -> toxicity.Model:
    return toxicity.train(docs, labels.where(~held_out()))


def op4_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    model = toxicity_model(docs, table(spark, sf_dir, "labels"))
    scored = toxicity.score(docs, model).withColumnRenamed("id", "doc_id")
    return scored.select("doc_id", F.coalesce(held_out(), F.lit(False)).alias("held_out"), "score", "predicted")


def op5_html_main_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_text.extract(table(spark, sf_dir, "pages")).withColumnRenamed("id", "page_id")


def vocabulary_path() -> str:
    """The public byte-level BPE vocabulary; executors have the same package at the same place."""
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def op6_bpe_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    encoded = bpe.encode(table(spark, sf_dir, "documents"), vocabulary_path(), with_ids=False)
    return encoded.withColumnRenamed("id", "doc_id")


def op7_shard_minimax(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = sharding.shard(table(spark, sf_dir, "documents"), n_shards=40)
    return rows.select(
        F.col("id").alias("doc_id"),
        "size",
        "text_crc32",
        F.lit("bytes").alias("law"),
        "shard",
        "slot",
        F.lit(None).cast("int").alias("grown_shard"),
    )


def op8_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return url_filter.url_verdicts(table(spark, sf_dir, "pages")).select(F.col("id").alias("page_id"), "host", "path", "rule", "verdict")


def _op8_sql() -> str:
    def hits(terms: tuple[str, ...]) -> str:
        return " + ".join(rf"regexp_matches(u, '(^|[^a-z0-9]){t}([^a-z0-9]|$)')::int" for t in terms)

    rule = verdict = "null"
    for kind, host, path in sorted(url_filter.RULES, key=lambda r: len(r[1] + r[2])):
        fits = f"(host = '{host}' or ends_with(host, '.{host}')) and starts_with(path, '{path}')"
        rule, verdict = f"case when {fits} then '{host}{path}' else {rule} end", f"case when {fits} then '{kind}' else {verdict} end"
    return rf"""
with p as (
  select page_id, {sql_lower_ascii("regexp_extract(coalesce(url, ''), '(?s)^.*?://([^/?#]*)', 1)")} as host,
    regexp_extract(coalesce(url, ''), '(?s)^.*?://[^/?#]*([^?#]*)', 1) as path, lower(coalesce(url, '')) as u from pages
)
select page_id, host, path, {rule} as rule,
  coalesce({verdict}, case when {hits(url_filter.STRICT)} >= 1 or {hits(url_filter.SOFT)} >= 2 then 'block' else 'allow' end) as verdict
from p
"""


def op9_sanitise_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = pii.find_personal_data(table(spark, sf_dir, "documents"))
    counts = [F.expr(f"cast(size(filter(base, s -> s.kind = '{k}')) as bigint)").alias(f"n_{k}") for k in pii.KINDS]
    return found.select(
        F.col("id").alias("doc_id"), *counts, F.sha2(pii.joined("base"), 256).alias("base_sha256"), pii.joined("spans").alias("spans")
    )


def op10_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    groups = exact_dedup.exact_groups(table(spark, sf_dir, "documents"))
    return groups.select(
        F.col("id").alias("doc_id"), "keep_id", "group_size", "kept", F.lower(F.hex("digest")).alias("text_sha256")
    )


OP10_SQL = f"""
with d as (select doc_id, sha256({sql_lower_ascii("coalesce(text, '')")}) as text_sha256 from documents)
select doc_id, max(doc_id) over w as keep_id, count(*) over w as group_size, doc_id = max(doc_id) over w as kept, text_sha256
from d window w as (partition by text_sha256)
"""


def op11_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "embeddings")
    finite = F.forall("embedding", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    label = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    v = F.transform("embedding", lambda x: F.floor(256 * x.cast("double")))
    rows = e.where(F.col("label").isNotNull() & F.col("embedding").isNotNull() & finite).select(F.col("vec_id").alias("id"), label.cast("long").alias("label"), v.alias("v"))
    return hard_negatives.mine(rows, F.col("id") % 50 == 0)


OP11_SQL = """
with e as (
  select vec_id, case when vec_id % 7 = 0 then (label + 1) % 10 else label end as label, list_transform(embedding, lambda x: floor(256 * x::double)) as v
  from embeddings where label is not null and embedding is not null and len(list_filter(embedding, lambda x: x is null or not isfinite(x))) = 0
), s as (
  select a.vec_id as anchor_id, o.vec_id, o.label = a.label as same, list_inner_product(a.v, o.v)::bigint as score
  from e a join e o on a.vec_id % 50 = 0 and o.vec_id <> a.vec_id and len(o.v) = len(a.v)
), p as (
  select anchor_id, vec_id as positive_id, score as positive_score from s where same qualify row_number() over (partition by anchor_id order by score desc, vec_id) <= 5
)
select anchor_id, positive_id, (row_number() over w)::int as rank, vec_id as negative_id, positive_score, score as negative_score
from p join s using (anchor_id) where not same and 50 * positive_score <= 100 * score and 100 * score <= 95 * positive_score
window w as (partition by anchor_id, positive_id order by score desc, vec_id) qualify rank <= 3
"""


def op12_fill_in_middle(spark: SparkSession, sf_dir: str) -> DataFrame:
    cut = fill_in_middle.fill_in_middle(table(spark, sf_dir, "documents"))
    sha = lambda c: F.sha2(c, 256)
    return cut.select(
        F.col("id").alias("doc_id"), "n", "form", "prefix_chars", "middle_chars", sha(F.col("output")).alias("output_sha256"),
        sha(fill_in_middle.restore(F.col("output"), F.col("form"))).alias("restored_sha256"),
    )


OP12_SQL = """
with d as (
  select doc_id, coalesce(text, '') as text, regexp_extract_all(coalesce(text, ''), '[A-Za-z]+|[^A-Za-z]') as u, sha256('1:' || coalesce(doc_id::varchar, '')) as h from documents
), r as (
  select *, len(u)::bigint as n, ('0x' || h[1:8])::bigint % (len(u) + 1) as c1, ('0x' || h[9:16])::bigint % (len(u) + 1) as c2,
    case when text = '' or contains(text, '<P>') or contains(text, '<S>') or contains(text, '<M>') or ('0x' || h[17:24])::bigint % 100 >= 90 then 'plain'
      when ('0x' || h[25:32])::bigint % 100 < 20 then 'spm' else 'psm' end as form from d
), c as (
  select *, array_to_string(u[:least(c1, c2)], '') as p, array_to_string(u[least(c1, c2) + 1:greatest(c1, c2)], '') as m, array_to_string(u[greatest(c1, c2) + 1:], '') as s from r
)
select doc_id, n, form, case when form <> 'plain' then length(p) end as prefix_chars, case when form <> 'plain' then length(m) end as middle_chars,
  sha256(case form when 'plain' then text when 'psm' then '<P>' || p || '<S>' || s || '<M>' || m else '<S>' || s || '<P>' || p || '<M>' || m end) as output_sha256,
  sha256(text) as restored_sha256
from c
"""


def op13_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    judged = quality.clean_lines(table(spark, sf_dir, "documents"))
    counts = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")
    return judged.select(F.col("id").alias("doc_id"), *counts, "base_failed", "kept", "n_failed", "lost_chars", F.sha2("cleaned", 256).alias("cleaned_sha256"))


def _op13_sql() -> str:
    """The rules are the same patterns, the counting and the windows are joins and windows of DuckDB's own."""

    def has(c: str, pattern: str) -> str:
        return f"regexp_matches({c}, '{pattern.replace(chr(39), chr(39) * 2)}')"

    def count(c: str, pattern: str) -> str:
        return f"len(regexp_extract_all({c}, '{pattern}'))"

    return rf"""
with d as (
  select row_number() over () as r, doc_id, coalesce(text, '') as text, regexp_extract_all(coalesce(text, ''), '{WORD}') as w from documents
), l as (
  select r, i, x, {has("x", WORD)} as worded, {has("x", WORD)} and (not {has("x", quality.END)} or 4 * {count("x", quality.DECORATED)} > {count("x", WORD)}
      or 4 * {count("x", quality.SEPARATOR)} > {count("x", WORD)} or {has("lower(x)", quality.MENU)} and length(x) <= {quality.NOTICE_CHARS} or {has("lower(x)", quality.BOILERPLATE)} and length(x) <= {quality.NOTICE_CHARS}) as bad
  from (select r, unnest(string_split(text, chr(10))) as x, generate_subscripts(string_split(text, chr(10)), 1) as i from d)
), s as (
  select r, string_agg(x, chr(10) order by i) filter (not bad) as cleaned, count(*) filter (bad) as n_failed,
    coalesce(sum(length(regexp_replace(x, '{quality.BLANK}', '', 'g'))) filter (bad), 0)::bigint as lost_chars, count(*) filter (worded) - count(distinct x) filter (worded) as n_dup_lines
  from l group by r
), w as (
  select r, unnest(range(1, len(w) - 6)) as i, unnest(list_transform(range(1, len(w) - 6), lambda k: array_to_string(w[k:k + 7], ' '))) as t from d where len(w) >= 8
), t as (
  select r, i, lag(i, 1, -8) over (partition by r order by i) as p from (select r, i, count(*) over (partition by r, t) as n from w) where n > 1
), c as (
  select r, sum(least(8, i - p))::bigint as n_repeat_words from t group by r
), j as (
  select doc_id, len(w)::bigint as n_words, length(regexp_replace(text, '{quality.BLANK}', '', 'g')) as word_chars, {count("text", quality.SYMBOL)}::bigint as n_symbols,
    n_dup_lines, coalesce(n_repeat_words, 0) as n_repeat_words, n_failed, lost_chars, sha256(coalesce(cleaned, '')) as cleaned_sha256
  from d join s using (r) left join c using (r)
)
select *, n_words < {quality.MIN_WORDS} or 100 * n_repeat_words > {quality.MAX_REPEATED} * n_words as base_failed,
  not (n_words < {quality.MIN_WORDS} or 100 * n_repeat_words > {quality.MAX_REPEATED} * n_words) and 100 * lost_chars <= {quality.MAX_LOST} * word_chars as kept
from j
"""


QUERIES: dict[str, Query] = {
    "op1_mix_to_target_weights": op1_mix_to_target_weights,
    "op2_embedding_near_dedup": op2_embedding_near_dedup,
    "op3_ngram_jaccard_join": op3_ngram_jaccard_join,
    "op4_toxicity": op4_toxicity,
    "op5_html_main_text": op5_html_main_text,
    "op6_bpe_round_trip": op6_bpe_round_trip,
    "op7_shard_minimax": op7_shard_minimax,
    "op8_url_filter": op8_url_filter,
    "op9_sanitise_pii": op9_sanitise_pii,
    "op10_exact_dedup": op10_exact_dedup,
    "op11_hard_negatives": op11_hard_negatives,
    "op12_fill_in_middle": op12_fill_in_middle,
    "op13_quality_rules": op13_quality_rules,
}
ORACLES: dict[str, str] = {
    "op1_mix_to_target_weights": OP1_SQL,
    "op8_url_filter": _op8_sql(),
    "op10_exact_dedup": OP10_SQL,
    "op11_hard_negatives": OP11_SQL,
    "op12_fill_in_middle": OP12_SQL,
    "op13_quality_rules": _op13_sql(),
}
