"""Registered queries of the training-data operators, over whole tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from stocktide.llm.common import table

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def add(fn):
        QUERIES[name] = fn
        if sql is not None:
            ORACLE[name] = sql
        return fn

    return add


@query("op1_simhash_near_dedup")
def op1(spark: SparkSession, d: str) -> DataFrame:
    from stocktide.llm.simhash import near_duplicates

    return near_duplicates(table(spark, d, "documents"))


@query("op7_toxicity")
def op7(spark: SparkSession, d: str) -> DataFrame:
    from stocktide.llm import toxicity

    docs = table(spark, d, "documents")
    return toxicity.score(docs, toxicity.fit(docs, table(spark, d, "labels")))


# The base rules in RE2's words: pattern, group that is measured, fewest characters of it.
_SECRETS = {
    "assign": (r"""((?i:password|passwd|secret|token|api_?key))["'']?\x20*[:=]\x20*["'']?([A-Za-z0-9+/_.=-]+)""", 2, 8),
    "access": (r"AKIA[A-Z0-9]+", 0, 16),
    "hex": (r"[0-9a-f]{32,}", 0, 32),  # a run counts whole or not at all
}


def _spans_sql(rank: int, kind: str) -> str:
    pattern, group, least = _SECRETS[kind]
    return f"""list_filter(list_transform(range(1, len(m_{kind}) + 1), lambda i: {{
  's': (coalesce(list_sum(list_transform(g_{kind}[1:i], lambda x: length(x))), 0) + coalesce(list_sum(list_transform(m_{kind}[1:i - 1], lambda x: length(x))), 0))::BIGINT,
  'r': {rank}, 'k': '{kind}', 'n': length(m_{kind}[i])::BIGINT, 'c': length(c_{kind}[i])}}), lambda x: x.c >= {least})"""


_LISTS = ", ".join(
    f"regexp_extract_all(t, '{p}', 0) AS m_{k}, regexp_extract_all(t, '{p}', {g}) AS c_{k}, regexp_split_to_array(t, '{p}') AS g_{k}" for k, (p, g, _) in _SECRETS.items()
)
_OP9 = f"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS t FROM documents), f AS (SELECT doc_id, {_LISTS} FROM d),
 l AS (SELECT doc_id, list_sort(list_concat(list_concat({_spans_sql(0, 'assign')}, {_spans_sql(1, 'access')}), {_spans_sql(2, 'hex')})) AS sp FROM f),
 o AS (SELECT doc_id, sp, coalesce(array_to_string(list_transform(sp, lambda x: x.k || ':' || x.s || ':' || (x.s + x.n)), ','), '') AS spans FROM l)
SELECT doc_id, len(list_filter(sp, lambda x: x.k = 'assign'))::BIGINT AS n_assign, len(list_filter(sp, lambda x: x.k = 'access'))::BIGINT AS n_access,
 len(list_filter(sp, lambda x: x.k = 'hex'))::BIGINT AS n_hex, spans, sha256(spans) AS base_sha256 FROM o"""


@query("op9_secret_scan", _OP9)
def op9(spark: SparkSession, d: str) -> DataFrame:
    from stocktide.llm import secret_scan

    return secret_scan.digests(secret_scan.scan(table(spark, d, "documents").select("doc_id", "text")))


@query("op8_language_id")
def op8(spark: SparkSession, d: str) -> DataFrame:
    from stocktide.llm import language_id

    docs = table(spark, d, "documents")
    return language_id.predict(docs, language_id.fit(docs))


@query("op6_best_fit_packing")
def op6(spark: SparkSession, d: str) -> DataFrame:
    from stocktide.llm.packing import pack

    return pack(table(spark, d, "documents"))


@query("op3_token_counts")
def op3(spark: SparkSession, d: str) -> DataFrame:
    """Tokens of every document before and after long digit runs are masked."""
    from pyspark.sql import functions as F

    from stocktide.llm.secret_scan import Rule, scan
    from stocktide.llm.token_count import count_tokens

    docs = scan(table(spark, d, "documents").select("doc_id", "text"), (Rule("digits", "[0-9]+", 0, 6),))
    edits = F.transform("secret_spans", lambda s: F.struct(s["start"].alias("start"), s["end"].alias("end"), F.lit("[NUMBER]").alias("replacement")))
    return count_tokens(docs, edits)


@query("op4_html_extraction")
def op4(spark: SparkSession, d: str) -> DataFrame:
    from stocktide.llm.html_text import main_text

    return main_text(table(spark, d, "pages"))


@query("op5_embedding_near_dedup")
def op5(spark: SparkSession, d: str) -> DataFrame:
    from stocktide.llm.embedding_dedup import near_duplicates

    return near_duplicates(table(spark, d, "embeddings"))


@query("op2_benchmark_decontamination")
def op2(spark: SparkSession, d: str) -> DataFrame:
    from stocktide.llm.decontamination import find_leaks

    return find_leaks(table(spark, d, "documents"), table(spark, d, "benchmark"))


@query("op10_suffix_dedup")
def op10(spark: SparkSession, d: str) -> DataFrame:
    from stocktide.llm.repeats import remove_repeats

    return remove_repeats(table(spark, d, "documents")).drop("kept")


@query("op11_periodic_runs")
def op11(spark: SparkSession, d: str) -> DataFrame:
    """Runs of the documents, one in ten of which is given a periodic end."""
    from stocktide.llm import periodic_runs

    docs = periodic_runs.with_periodic_tails(table(spark, d, "documents"))
    return periodic_runs.digests(periodic_runs.find_runs(docs))


_OP12 = r"""
WITH d AS (SELECT doc_id, length(coalesce(text, '')) AS n, sha256(regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]', '', 'g')) AS text_sha256 FROM documents),
 g AS (SELECT text_sha256, count(*) AS group_size, arg_min(doc_id, (-n, doc_id)) AS keep_id FROM d GROUP BY text_sha256)
SELECT doc_id, keep_id, group_size, doc_id = keep_id AS kept, text_sha256 FROM d JOIN g USING (text_sha256)"""


@query("op12_exact_dedup", _OP12)
def op12(spark: SparkSession, d: str) -> DataFrame:
    from stocktide.llm.exact_dedup import exact_duplicates

    return exact_duplicates(table(spark, d, "documents"))


@query("op13_importance_resampling")
def op13(spark: SparkSession, d: str) -> DataFrame:
    from stocktide.llm.resampling import resample

    return resample(table(spark, d, "documents"), table(spark, d, "benchmark"))
