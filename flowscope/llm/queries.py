"""The queries of this folder, each over the whole of its table, and their SQL."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from flowscope.llm import language_id, line_quality, toxicity
from flowscope.llm.chat_format import reply_order
from flowscope.llm.decontamination import contaminations
from flowscope.llm.license_scan import license_matches, license_templates
from flowscope.llm.packing import packed_documents
from flowscope.llm.parity_join import near_duplicates
from flowscope.llm.quality_rules import MEASURES, quality_verdicts
from flowscope.llm.resampling import resampled
from flowscope.llm.tables import learn_share, small_batches, table
from flowscope.llm.token_counts import token_counts
from flowscope.llm.url_filter import judge_urls
from flowscope.llm.whitening import whitened


# The rules of the query: host, path, verdict.
URL_RULES = [
    ("com", "/", "allow"),
    ("example.com", "/en/", "block"),
    ("www.example.com", "/en/", "allow"),
    ("net", "/es/", "block"),
    ("net", "/fr/", "block"),
]


def op1_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    rules = spark.createDataFrame(URL_RULES, "host string, path string, verdict string")
    return judge_urls(table(spark, sf_dir, "pages"), rules)


def op2_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    counts = token_counts(documents(spark, sf_dir), public_tokenizers.path("byte_bpe_50k.json"))
    return counts.withColumn("over_limit", F.col("n_tokens") > 512)


TOXIC_FROM = 0.7


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    small_batches(spark)
    return table(spark, sf_dir, "documents")


def op3_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    model = toxicity.learn(docs, table(spark, sf_dir, "labels"), lambda i: learn_share(i, parts=3, held=1))
    return toxicity.toxicity(docs, model).select(
        "doc_id",
        (~learn_share(F.col("doc_id"), parts=3, held=1)).alias("held_out"),
        "score",
        (F.col("score") >= TOXIC_FROM).cast("int").alias("predicted"),
        "hits",
    )


def op4_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(documents(spark, sf_dir))


def op5_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    return reply_order(table(spark, sf_dir, "conversations"))


def op6_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return license_matches(documents(spark, sf_dir), license_templates(spark))


def op7_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packed_documents(documents(spark, sf_dir), public_tokenizers.path("word_bpe_49k.json"))


def op8_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    learned = learn_share(F.col("doc_id"), parts=4, held=2)
    dictionaries = language_id.learn(docs, learned, order="doc_id")
    # The id rides along as the key of the share; it is no input of a prediction.
    judged = language_id.classify(docs, dictionaries)
    return judged.select(
        "doc_id", (~learned).alias("held_out"), "lang_pred", "score", "margin", "accepted"
    )


def op9_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    verdicts = quality_verdicts(documents(spark, sf_dir))
    return verdicts.select("doc_id", *MEASURES, "base_failed", "kept")


def op10_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    hits = contaminations(documents(spark, sf_dir), table(spark, sf_dir, "benchmark"))
    return hits.select("doc_id", "item_id", "n_tiles", "covered_words", "item_words", "coverage")


QUALITY_FROM = 0.3


def op11_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    model = line_quality.learn(docs, table(spark, sf_dir, "labels"), lambda i: learn_share(i, parts=5, held=0))
    return line_quality.line_quality(docs, model).select(
        "doc_id",
        (~learn_share(F.col("doc_id"), parts=5, held=0)).alias("held_out"),
        "score",
        (F.col("score") >= QUALITY_FROM).cast("int").alias("predicted"),
    )


def op12_importance_resampling(spark: SparkSession, sf_dir: str) -> DataFrame:
    drawn = resampled(documents(spark, sf_dir), table(spark, sf_dir, "benchmark"))
    return drawn.select("doc_id", "n_features", "weight", "score", "rank")


def op13_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    result = whitened(table(spark, sf_dir, "embeddings"))
    return result.withColumn("deviation", F.col("deviation").try_cast("long"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_url_filter": op1_url_filter,
    "op2_token_counts": op2_token_counts,
    "op3_toxicity": op3_toxicity,
    "op4_ngram_join": op4_ngram_join,
    "op5_chat_format": op5_chat_format,
    "op6_license_scan": op6_license_scan,
    "op7_packing": op7_packing,
    "op8_language_id": op8_language_id,
    "op9_quality_rules": op9_quality_rules,
    "op10_decontamination": op10_decontamination,
    "op11_quality_classifier": op11_quality_classifier,
    "op12_importance_resampling": op12_importance_resampling,
    "op13_whitening": op13_whitening,
}

URL_SQL = """
with rules(host, path, verdict) as (values %s),
cut as (
    select page_id, case when instr(url, '://') > 0 then substr(url, instr(url, '://') + 3) end as rest from pages
),
parts as (
    select row_number() over () as row_id, page_id,
        coalesce(translate(regexp_extract(rest, '^[^/?#]*'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '') as host,
        coalesce(regexp_extract(rest, '^[^/?#]*([^?#]*)', 1), '') as path
    from cut
)
select p.page_id, p.host, p.path, r.host || r.path as rule, coalesce(r.verdict, 'allow') as verdict
from parts p
left join rules r on (p.host = r.host or ends_with(p.host, '.' || r.host)) and starts_with(p.path, r.path)
qualify row_number() over (partition by row_id order by length(r.host || r.path) desc, length(r.host) desc) = 1
""" % ", ".join(map(str, URL_RULES))

_RULES = {
    "too_short": "n_words < 10",
    "repetitive": "100 * n_repeat_words > 20 * n_words",
    "symbols": "100 * n_symbols > 50 * n_words",
    "dup_lines": "100 * n_dup_lines > 50 * n_lines",
}


def _quality_sql() -> str:
    """The host-level quality rules in SQL."""
    rules = list(_RULES)
    flags = ", ".join(f"{test} as {r}" for r, test in _RULES.items())
    counts = ", ".join(f"count(*) filter ({r}) as k_{r}" for r in rules)
    rates = ", ".join(f"k_{r} / n as r_{r}" for r in rules)
    sums = ", ".join(
        f"""coalesce(avg(r_{r}), 0) as p_{r},
        avg(r_{r} * r_{r}) - avg(r_{r}) * avg(r_{r}) - avg(r_{r} * (1 - r_{r}) / (n - 1)) as v_{r}"""
        for r in rules
    )
    strength = ", ".join(
        f"case when p_{r} > 0 and p_{r} < 1 and v_{r} > 0 then least(greatest(p_{r} * (1 - p_{r}) / v_{r} - 1, 1), 1e6) else 1e6 end as m_{r}"
        for r in rules
    )
    bad = " or ".join(f"(k_{r} + p_{r} * m_{r}) / (n + m_{r}) > 0.8" for r in rules)
    return f"""
with d as (
    select row_number() over () as row_id, doc_id, coalesce(text, '') as t, coalesce(source, '') as host from documents
),
w as (select *, regexp_extract_all(t, '[^\\x20\\x09-\\x0D]+') as ws from d),
grams as (
    select row_id, i, array_to_string(ws[i:i + 4], ' ') as gram
    from (select row_id, ws, unnest(range(1, len(ws) - 3)) as i from w where len(ws) >= 5)
),
twice as (select row_id, i from grams qualify count(*) over (partition by row_id, gram) > 1),
repeated as (
    select row_id, count(distinct word) as n from (select row_id, unnest(range(i, i + 5)) as word from twice) group by row_id
),
lines as (
    select row_id, line, row_number() over (partition by row_id, line) as k
    from (select row_id, unnest(string_split(t, chr(10))) as line from d)
),
dup as (
    select row_id, count(*) as n from lines where k > 1 and regexp_matches(line, '[^\\x20\\x09-\\x0D]') group by row_id
),
m as (
    select w.row_id, doc_id, host, cast(len(ws) as bigint) as n_words,
        cast(coalesce(list_sum(list_transform(ws, lambda x: length(x))), 0) as bigint) as word_chars,
        cast(len(regexp_extract_all(t, '[#*$%&|<>]')) as bigint) as n_symbols,
        cast(coalesce(dup.n, 0) as bigint) as n_dup_lines, cast(coalesce(repeated.n, 0) as bigint) as n_repeat_words,
        len(string_split(t, chr(10))) as n_lines
    from w left join repeated using (row_id) left join dup using (row_id)
),
judged as (select *, {flags} from m),
hosts as (select host, count(*) as n, {counts} from judged group by host),
rates as (select n, {rates} from hosts where n > 1),
totals as (select {sums} from rates),
prior as (select *, {strength} from totals),
rejected as (select host from hosts, prior where host <> '' and ({bad}))
select doc_id, {", ".join(MEASURES)}, too_short or repetitive as base_failed,
    not (too_short or repetitive) and host not in (select host from rejected) as kept
from judged
"""


# The CRC-32 of a text in SQL: its bytes folded over the table that the polynomial gives.
RESAMPLING_SQL = r"""
with recursive bits(b, k, v) as (
    select b, 0, b::bigint from range(256) r(b)
    union all
    select b, k + 1, case when v % 2 = 1 then xor(v // 2, 3988292384) else v // 2 end from bits where k < 8
),
steps as (select list(v order by b) as step from bits where k = 8),
d as (select row_number() over () as row_id, doc_id, text, 0 as wanted from documents
    union all select row_number() over (), null, text, 1 from benchmark),
w as (
    select wanted, row_id, regexp_extract_all(
        translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
        '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') as ws
    from d
),
grams as (
    select wanted, row_id, unnest(flatten([
        list_transform(range(1, len(ws) + 2 - k), lambda i: array_to_string(ws[i:i + k - 1], ' ')) for k in [1, 2, 3]
    ])) as gram from w
),
counted as (select wanted, row_id, gram, count(*) as n from grams group by all),
codes as (
    select gram, hex(encode(gram)) as code, step from (select distinct gram from counted), steps
),
hashed as (
    select gram, xor(list_reduce(
        list_transform(range(0, length(code) // 2), lambda i: ('0x' || code[2 * i + 1:2 * i + 2])::bigint),
        lambda v, b: xor(v // 256, step[xor(v, b) % 256 + 1]), 4294967295::bigint), 4294967295) % 10000 as bucket
    from codes
),
placed as (select wanted, row_id, bucket, n from counted join hashed using (gram)),
buckets as (
    select b as bucket, coalesce(sum(n) filter (wanted = 0), 0) as s, coalesce(sum(n) filter (wanted = 1), 0) as t
    from range(10000) r(b) left join placed on bucket = b group by b
),
whole as (select sum(s) as all_s, sum(t) as all_t from buckets),
gains as (
    select bucket, floor(1000 * ln(((t + 1)::double * (all_s + 10000)::double)
        / ((s + 1)::double * (all_t + 10000)::double)))::bigint as gain from buckets, whole
),
weighed as (
    select row_id, sum(n)::bigint as n_features, sum(n * gain)::bigint as weight
    from placed join gains using (bucket) where wanted = 0 group by row_id
),
scored as (
    select d.row_id, d.doc_id, coalesce(n_features, 0) as n_features, coalesce(weight, 0) as weight,
        coalesce(weight, 0) + floor(-1000 * ln(-ln(
            (('0x' || sha256('42:' || coalesce(d.doc_id::varchar, ''))[1:8])::bigint + 0.5::double) / 4294967296.0::double
        )))::bigint as score, len(ws) >= 20 as long_enough
    from d join w using (row_id, wanted) left join weighed using (row_id) where wanted = 0
),
places as (
    select *, row_number() over (partition by long_enough order by score desc, doc_id nulls first) as place,
        count(*) filter (long_enough) over () as n
    from scored
)
select doc_id, n_features, weight, score, case when long_enough and place <= 5 * n // 100 then place end as rank from places
"""


ORACLE: dict[str, str] = {
    "op1_url_filter": URL_SQL,
    "op9_quality_rules": _quality_sql(),
    "op12_importance_resampling": RESAMPLING_SQL,
}
