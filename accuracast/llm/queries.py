"""The registered queries of this folder: thin steps between the given tables and the operators."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from accuracast.llm.collocations import collocations
from accuracast.llm.filter_audit import filter_audit, repeats_smaller
from accuracast.llm.html_text import extract_main_text
from accuracast.llm.langid import fit_language_model, held_out, predict_language
from accuracast.llm.minmax import near_duplicates
from accuracast.llm.packing import retrieval_pack
from accuracast.llm.pii import BASE_KINDS, private_spans, span_list
from accuracast.llm.quality import RULES, STOP_WORDS, apply_quality_rules
from accuracast.llm.sharding import ring_shards
from accuracast.llm.shared_spans import remove_shared_spans
from accuracast.llm.token_matrix import packed_matrices
from accuracast.llm.warc import derivative_records, response_records
from accuracast.llm.winnow import benchmark_spans
from accuracast.session import prepare

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def register(fn):
        QUERIES[name] = lambda spark, sf_dir: fn(prepare(spark), sf_dir)
        if sql:
            ORACLES[name] = sql
        return fn

    return register


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _failed_rules_sql() -> str:
    names = []
    for r in RULES:
        tests = ([f"{r.metric} < {r.low}"] if r.low is not None else []) + ([f"{r.metric} > {r.high}"] if r.high is not None else [])
        names.append(f"case when ({' or '.join(tests)}) and n_words >= {r.from_words} then '{r.metric}' end")
    return f"concat_ws(',', {', '.join(names)})"


_STOP = ", ".join(f"'{w}'" for w in sorted({w for ws in STOP_WORDS.values() for w in ws}))


@query(
    "op5_quality_rules",
    f"""
with w as (
    select doc_id, coalesce(text, '') as t, list_filter(string_split_regex(coalesce(text, ''), '[\\x20\\x09-\\x0D]+'), lambda x: x <> '') as ws,
           list_filter(string_split(coalesce(text, ''), chr(10)), lambda x: regexp_matches(x, '[^\\x20\\x09-\\x0D]')) as ls from documents),
win as (select doc_id, i, count(*) over (partition by doc_id, array_to_string(ws[i:i + 4], ' ')) as c from w, unnest(generate_series(1, len(ws) - 4)) t(i) where len(ws) >= 5),
rep as (select doc_id, count(distinct p) as n_repeat_words from win, unnest(generate_series(i, i + 4)) t(p) where c > 1 group by 1),
m as (
    select doc_id, cast(len(ws) as bigint) as n_words, cast(coalesce(list_sum(list_transform(ws, lambda x: length(x))), 0) as bigint) as word_chars,
           cast(length(regexp_replace(t, '[^#*$%&|<>]', '', 'g')) as bigint) as n_symbols, cast(len(ls) - len(list_distinct(ls)) as bigint) as n_dup_lines,
           cast(coalesce(n_repeat_words, 0) as bigint) as n_repeat_words, nullif(len(ws), 0) * 1e0 as nw, nullif(len(ls), 0) * 1e0 as nl, ws, ls
    from w left join rep using (doc_id)),
r as (
    select *, word_chars / nw as mean_word_chars, n_symbols / (nullif(word_chars, 0) * 1e0) as symbol_ratio, len(list_filter(ws, lambda x: x = '|')) / nw as bar_word_ratio,
           len(list_filter(ws, lambda x: x like '%!!')) / nw as shout_word_ratio, len(list_filter(ws, lambda x: lower(x) in ({_STOP}))) / nw as stop_word_ratio,
           n_repeat_words / nw as repeat_word_ratio, n_dup_lines / nl as dup_line_ratio,
           len(list_filter(ls, lambda x: left(ltrim(x), 1) in ('-', '*', '•', '·'))) / nl as bullet_line_ratio,
           len(list_filter(ls, lambda x: rtrim(x) like '%...' or rtrim(x) like '%…')) / nl as ellipsis_line_ratio
    from m),
f as (select *, n_words < 10 or 100 * n_repeat_words > 20 * n_words as base_failed, {_failed_rules_sql()} as failed_rules from r)
select doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, not base_failed and failed_rules = '' as kept, failed_rules from f""",
)
def quality_rules(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return apply_quality_rules(docs).select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept",
        F.array_join("failed_rules", ",").alias("failed_rules"),
    )


@query("op7_ring_shards")
def sharding(spark, sf_dir):
    text = F.coalesce("text", F.lit(""))
    rows = table(spark, sf_dir, "documents").select("doc_id", (F.octet_length(text) + 1).cast("bigint").alias("size"), F.crc32(text.cast("binary")).alias("text_crc32"))
    return ring_shards(rows, key="doc_id", shards=8, tie=("text_crc32", "size")).select(
        "doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard")
    )


@query(
    "op6_minmax_dedup",
    """
with recursive w as (
    select doc_id, list_filter(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\\x20\\x09-\\x0D]+'), lambda x: x <> '') as ws from documents),
sh as (
    select distinct doc_id, array_to_string(ws[i:i + 4], ' ') as g from w, unnest(generate_series(1, len(ws) - 4)) t(i) where len(ws) >= 5
    union all select doc_id, array_to_string(ws, ' ') from w where len(ws) between 1 and 4),
n as (select doc_id, count(*) as n from sh group by 1),
pairs as (select a.doc_id as x, b.doc_id as y, count(*) as c from sh a join sh b on a.g = b.g and a.doc_id < b.doc_id group by 1, 2),
links as (select x, y from pairs join n p on p.doc_id = x join n q on q.doc_id = y where 100 * c >= 85 * (p.n + q.n - c)),
both_ways as (select x, y from links union all select y, x from links),
reach as (select x, y from both_ways union select r.x, b.y from reach r join both_ways b on b.x = r.y),
low as (select x as doc_id, min(y) as m from reach group by 1)
select doc_id, coalesce(n.n, 0) as n_shingles, least(doc_id, coalesce(m, doc_id)) as component_id, doc_id = least(doc_id, coalesce(m, doc_id)) as kept
from w left join n using (doc_id) left join low using (doc_id)""",
)
def minmax_dedup(spark, sf_dir):
    return near_duplicates(table(spark, sf_dir, "documents"), key="doc_id", text="text")


_WORDS = "regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+')"


@query(
    "op9_winnow_decontamination",
    f"""
with d as (select doc_id, {_WORDS} as w from documents),
b as (select item_id, {_WORDS} as w from benchmark),
bw as (
    select distinct item_id, array_to_string(w[i:i + 9], ' ') as g, 10 as n from b, unnest(generate_series(1, len(w) - 9)) t(i) where len(w) >= 10
    union all select item_id, array_to_string(w, ' '), len(w) from b where len(w) between 1 and 9),
sizes as (select distinct n from bw),
dw as (select doc_id, i, n, array_to_string(w[i:i + n - 1], ' ') as g from d, sizes, unnest(generate_series(1, len(w) - n + 1)) t(i) where len(w) >= n),
hit as (select doc_id, i, n, item_id from dw join bw using (n, g)),
covered as (select doc_id, count(distinct p) as n_hit from hit, unnest(generate_series(i, i + n - 1)) t(p) group by 1),
named as (select doc_id, count(*) as n_items, sha256(string_agg(id, ',' order by id)) as s from (select distinct doc_id, cast(item_id as varchar) as id from hit) group by 1)
select doc_id, cast(len(w) as bigint) as n_words, coalesce(n_hit, 0) as n_hit, coalesce(n_items, 0) as n_items,
       coalesce(s, sha256('')) as items_sha256, coalesce(n_hit, 0) > 0 as contaminated
from d left join covered using (doc_id) left join named using (doc_id)""",
)
def winnow_decontamination(spark, sf_dir):
    found = benchmark_spans(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"), key="doc_id")
    return found.select(
        "doc_id", "n_words", "n_hit", F.size("items").cast("bigint").alias("n_items"),
        F.sha2(F.array_join("items", ",").cast("binary"), 256).alias("items_sha256"), (F.col("n_hit") > 0).alias("contaminated"),
    )


@query("op3_retrieval_packing")
def retrieval_packing(spark, sf_dir):
    pieces = retrieval_pack(table(spark, sf_dir, "documents"), key="doc_id")
    return pieces.select("doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset")


@query("op10_token_matrices")
def token_matrices(spark, sf_dir):
    return packed_matrices(table(spark, sf_dir, "documents"), key="doc_id")


@query("op1_pii")
def pii(spark, sf_dir):
    found = private_spans(table(spark, sf_dir, "documents").select("doc_id", "text"))
    base = F.filter("private_spans", lambda x: x["base"])
    count = lambda k: F.size(F.filter("private_spans", lambda x: x["base"] & (x["kind"] == k))).cast("bigint").alias(f"n_{k}")
    return found.select("doc_id", *[count(k) for k in BASE_KINDS], F.sha2(span_list(base).cast("binary"), 256).alias("base_sha256"), span_list(F.col("private_spans")).alias("spans"))


@query("op2_language_id")
def language_id(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").withColumn("held_out", held_out(F.col("doc_id")))
    model = fit_language_model(docs.where("not held_out"), key="doc_id")
    return predict_language(docs.select("doc_id", "text", "held_out"), model).drop("text")


@query("op4_warc_derivatives")
def warc_derivatives(spark, sf_dir):
    return derivative_records(response_records(table(spark, sf_dir, "pages")))


@query("op8_html_text")
def html_text(spark, sf_dir):
    return extract_main_text(table(spark, sf_dir, "pages"))


_PLAIN_WORDS = "list_filter(string_split_regex(coalesce(text, ''), '[\\x20\\x09-\\x0D]+'), lambda x: x <> '')"


@query(
    "op11_filter_potential",
    f"""
with recursive d as (select doc_id, coalesce(source, '') as part, coalesce(text, '') as t, {_PLAIN_WORDS} as w from documents),
l as (select doc_id, max(case when quality = 1 then 1 else 0 end) as good, max(case when toxic = 1 then 1 else 0 end) as toxic from labels group by 1),
f as (
    select part, len(w) < 200 as a, 100 * len(list_distinct(w)) < 50 * len(w) as b, 100 * (length(t) - length(regexp_replace(t, '[A-Z]', '', 'g'))) > 2 * length(t) as c,
           regexp_matches(t, '[#$%&*|]') as d, exists (select 1 from d e where e.t = d.t and e.doc_id < d.doc_id) as e, coalesce(good, 0) as good, coalesce(toxic, 0) as toxic
    from d left join l using (doc_id)),
s as (
    select part, case when a then 'A' else '' end || case when b then 'B' else '' end || case when c then 'C' else '' end || case when d then 'D' else '' end || case when e then 'E' else '' end as failed,
           count(*) as n, sum(good) as good, sum(toxic) as toxic from f group by all),
orders as (
    select x as o from unnest(['A', 'B', 'C', 'D', 'E']) t(x)
    union all select o || x from orders, unnest(['A', 'B', 'C', 'D', 'E']) t(x) where length(o) < 5 and not contains(o, x)),
steps as (select o as filter_order, i as step, o[i] as x, o[:i - 1] as earlier from orders, range(1, 6) r(i) where length(o) = 5),
parts as (select part, sum(n) as total from s group by 1),
r as (
    select p.part, filter_order, step, x, sum(case when contains(failed, x) and translate(failed, earlier, '') = failed then n else 0 end) as removed,
           sum(case when contains(failed, x) and translate(failed, earlier, '') <> failed then n else 0 end) as redundant, sum(case when failed = x then n else 0 end) as unique_fails,
           sum(case when contains(failed, x) and translate(failed, earlier, '') = failed then good else 0 end) as good_lost,
           sum(case when contains(failed, x) and translate(failed, earlier, '') = failed then toxic else 0 end) as toxic_lost, any_value(total) as total
    from parts p join s on s.part = p.part, steps group by 1, 2, 3, 4)
select part, filter_order, cast(step as int) as step, cast(total - sum(removed) over (partition by part, filter_order order by step) as bigint) as kept, cast(removed as bigint) as removed,
       cast(redundant as bigint) as redundant, cast(unique_fails as bigint) as unique_fails, cast(good_lost as bigint) as good_lost, cast(toxic_lost as bigint) as toxic_lost,
       cast(sum(removed) over (partition by part, x) as bigint) as shapley
from r""",
)
def filter_potential(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select("doc_id", F.coalesce("text", F.lit("")).alias("text"), "source")
    spaced = F.array_remove(F.split(F.translate("text", "\t\n\x0b\f\r", " " * 5), " "), "")
    n = F.char_length("text")
    capitals = n - F.char_length(F.translate("text", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", ""))
    docs = docs.select(
        "doc_id", "text", "source", F.size(spaced).alias("w"), F.size(F.array_distinct(spaced)).alias("u"), (100 * capitals > 2 * n).alias("c"), F.col("text").rlike("[#$%&*|]").alias("d")
    )
    judged = repeats_smaller(docs, "doc_id", "text", "e").drop("text")
    marks = table(spark, sf_dir, "labels").groupBy("doc_id").agg(F.max(F.col("quality") == 1).alias("good"), F.max(F.col("toxic") == 1).alias("toxic"))
    filters = {"A": "w < 200", "B": "100 * u < 50 * w", "C": "c", "D": "d", "E": "e"}
    audit = filter_audit(judged.join(marks, "doc_id", "left"), filters, part="source", flags={"good": "good", "toxic": "toxic"}, separator="")
    return audit.withColumnRenamed("source", "part").drop("filter")


@query(
    "op12_anchor_spans",
    f"""
with w as (select doc_id, {_PLAIN_WORDS} as w from documents),
win as (select doc_id, i, array_to_string(w[i:i + 12], ' ') as g from w, unnest(generate_series(1, len(w) - 12)) t(i) where len(w) >= 13),
low as (select g, min(doc_id) as lo from win group by 1),
gone as (select distinct doc_id, p from win join low using (g), unnest(generate_series(i, i + 12)) t(p) where lo < doc_id),
left_over as (
    select doc_id, count(*) as n, string_agg(x, ' ' order by p) as t from (select doc_id, unnest(w) as x, generate_subscripts(w, 1) as p from w) anti join gone using (doc_id, p) group by 1)
select doc_id, cast(len(w) as bigint) as n_words, cast(len(w) - coalesce(n, 0) as bigint) as n_removed, sha256(coalesce(t, '')) as kept_sha256 from w left join left_over using (doc_id)""",
)
def anchor_spans(spark, sf_dir):
    found = remove_shared_spans(table(spark, sf_dir, "documents"), key="doc_id", values="text")
    return found.select("doc_id", F.col("n_values").alias("n_words"), "n_removed", F.sha2(F.col("kept_values").cast("binary"), 256).alias("kept_sha256"))


@query(
    "op13_prefix_free_collocations",
    """
with p as (
    select coalesce(lang, 'und') as lang, unnest(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\x0A-\x0D]')) as piece from documents),
w as (select lang, list_filter(string_split_regex(piece, '[\x20\x09]+'), lambda x: x <> '') as w from p),
g as (
    select lang, m, array_to_string(w[i:i + m - 1], ' ') as phrase, count(*) as f
    from w, (select unnest([1, 2, 3, 4]) as m), unnest(generate_series(1, len(w) - m + 1)) t(i) where len(w) >= m group by all),
t as (select lang, sum(f) as n from g where m = 1 group by 1),
c as (select lang, phrase, m, f, string_split(phrase, ' ') as w from g where m > 1 and f >= 30),
cuts as (
    select c.lang, c.phrase, c.f as a, k, x.f as l, y.f as r, cast(c.f as hugeint) * 2000000 // (x.f + y.f) as score
    from c, unnest(generate_series(1, c.m - 1)) t(k)
    join g x on x.lang = c.lang and x.phrase = array_to_string(c.w[1:k], ' ') join g y on y.lang = c.lang and y.phrase = array_to_string(c.w[k + 1:c.m], ' ')),
best as (select * from cuts qualify row_number() over (partition by lang, phrase order by score, k) = 1),
inner_ as (
    select lang, array_to_string(w[i:i + s - 1], ' ') as phrase, max(f) as longer from c, (select unnest([2, 3]) as s), unnest(generate_series(1, m - s + 1)) t(i) where s < m group by 1, 2),
ranked as (
    select best.*, row_number() over (partition by lang order by score desc, a desc, phrase) as rank from best left join inner_ using (lang, phrase) where longer is null or 100 * longer < 80 * a)
select lang, rank, phrase, a, l, r, cast(n as bigint) as n, cast(score as bigint) as score from ranked join t using (lang) where rank <= 2000""",
)
def prefix_free_collocations(spark, sf_dir):
    return collocations(table(spark, sf_dir, "documents"), values="text", part="lang")
