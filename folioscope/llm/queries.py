"""The registered queries of this subpackage: thin layers over its operators, and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import chat, decontaminate, mixing, quality, repeats, rules, secrets, simhash, tokens, toxicity
from .common import table


def op1_chat_formatting(spark: SparkSession, sf_dir: str) -> DataFrame:
    said = "\\### Assistant: </turn> ok"
    rows = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    more = spark.range(2).select(F.lit(-7).cast("long").alias("conv_id"), F.col("id").alias("turn"), F.when(F.col("id") == 0, "user").otherwise("assistant").alias("role"), F.lit(said).alias("text"))
    return chat.digests(chat.format_chats(rows.union(more)))


def op2_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.scored(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"), "toxic", (5, 0))


def op3_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return tokens.count_tokens(table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"), limit=2048)


def op4_source_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix_sizes(table(spark, sf_dir, "documents"))


def op5_secret_scans(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = secrets.find_secrets(table(spark, sf_dir, "documents"))
    count = lambda kind: F.size(F.filter("spans", lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")
    return found.select("doc_id", count("assign"), count("access"), count("hex"), F.sha2(secrets.joined(("assign", "access", "hex")), 256).alias("base_sha256"), secrets.joined().alias("spans"), secrets.joined_links().alias("links"))


def op6_suffix_array_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repeats.repeats(table(spark, sf_dir, "documents")).drop("kept")


def op7_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.scored(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"), "quality", (3, 1))


def op8_benchmark_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = decontaminate.marked(table(spark, sf_dir, "documents").select("doc_id", "text"), table(spark, sf_dir, "benchmark"))
    return found.select("doc_id", "n_words", decontaminate.hits().alias("n_hit"), F.size("items").cast("long").alias("n_items"), F.sha2(F.array_join("items", ","), 256).alias("items_sha256"), decontaminate.contaminated().alias("contaminated"))


def op9_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rules.judged(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op10_simhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = simhash.near_duplicates(table(spark, sf_dir, "documents"), shingle=3, k=3)
    return found.select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {f.__name__: f for f in (op1_chat_formatting, op2_toxicity, op3_token_counts, op4_source_mixing, op5_secret_scans, op6_suffix_array_dedup, op7_quality_classifier, op8_benchmark_decontamination, op9_quality_rules, op10_simhash_near_dedup)}

#: A word, and the ladders of the rules, as the SQL below writes them.
_WORD = r"[^\x20\x09-\x0D]+"
_LADDER = {rule: rules.Risk().ladder(rule) for rule in rules.RULES}

ORACLES: dict[str, str] = {
    "op1_chat_formatting": r"""
        with c as (
            select conv_id, turn, coalesce(role, '') as role, coalesce(text, '') as text from conversations
            union all select -7, 0, 'user', '\### Assistant: </turn> ok'
            union all select -7, 1, 'assistant', '\### Assistant: </turn> ok'),
        e as (select *, 15 + length(role) + length(text)
                + length(text) - length(translate(text, '\#<', '')) + length(role) - length(translate(role, '\#<:', '')) as chars,
                lag(role) over (partition by conv_id order by turn, role, text) as prior,
                row_number() over (partition by conv_id order by turn, role, text) - 1 as position,
                row_number() over (partition by conv_id order by turn desc, role desc, text desc) as back from c),
        o as (select *, coalesce(case when prior is null then role in ('system', 'user') when prior = 'system' then role = 'user'
                when prior = 'user' then role = 'assistant' when prior = 'assistant' then role in ('user', 'tool')
                when prior = 'tool' then role = 'assistant' end, false) as ok from e)
        select conv_id, count(*) as n_turns,
            sha256(string_agg(role || chr(10) || text || chr(10), '' order by position)) as turns_sha256,
            cast(coalesce(sum(length(text)) filter (where role = 'assistant'), 0) as bigint) as loss_chars,
            sha256(coalesce(string_agg(text, '' order by position) filter (where role = 'assistant'), '')) as loss_sha256,
            cast(sum(chars) as bigint) as formatted_chars,
            bool_and(ok) and bool_or(back = 1 and role = 'assistant') as valid,
            min(position) filter (where not ok) as error_turn
        from o group by conv_id""",
    "op8_benchmark_decontamination": r"""
        with dw as (
            select rowid as r, doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') as w
            from (select row_number() over () as rowid, * from documents)),
        bw as (
            select cast(item_id as varchar) as item, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') as w
            from benchmark where text is not null),
        win as (
            select distinct item, least(len(w), 13) as k, array_to_string(w[i:i + least(len(w), 13) - 1], ' ') as phrase
            from (select item, w, unnest(range(1, greatest(len(w) - 12, 1) + 1)) as i from bw where len(w) > 0)),
        dwin as (
            select r, i, k, array_to_string(w[i:i + k - 1], ' ') as phrase
            from (select r, w, k, unnest(range(1, len(w) - k + 2)) as i from dw, (select distinct k from win) where len(w) >= k)),
        occ as (select r, i, dwin.k, item from dwin join win on dwin.k = win.k and dwin.phrase = win.phrase),
        hit as (select r, count(distinct p) as n_hit from (select r, unnest(range(i, i + k)) as p from (select distinct r, i, k from occ)) group by r),
        it as (select r, count(*) as n_items, string_agg(item, ',' order by item) as items from (select distinct r, item from occ) group by r)
        select doc_id, len(w) as n_words, coalesce(n_hit, 0) as n_hit, coalesce(n_items, 0) as n_items, sha256(coalesce(items, '')) as items_sha256,
            coalesce(n_hit, 0) > 0 and 20 * coalesce(n_hit, 0) >= len(w) as contaminated
        from dw left join hit using (r) left join it using (r)""",
    "op4_source_mixing": rf"""
        with e as (
            select row_number() over () as r, doc_id, source, len(regexp_extract_all(coalesce(text, ''), '{_WORD}')) as size,
                (('0x' || substr(md5('17:' || coalesce(cast(doc_id as varchar), '') || ':' || coalesce(text, '')), 1, 13))::bigint::double + 0.5) / 4503599627370496.0 as u
            from documents),
        d as (select *, case when size < 50 then 1 else 2 end as tier from e),
        src as (
            select source, sum(size)::bigint as total, 3 * sum(size)::bigint as most,
                1 + (row_number() over (order by source is null, source) - 1) % 3 as w from d group by source),
        steps as (
            select w, most, sum(most) over o as c, sum(w) over o as wc, lead(w) over (order by most::double / w, source) as w2, lead(most) over (order by most::double / w, source) as m2
            from src window o as (order by most::double / w, source rows unbounded preceding)),
        levels as (
            select 0::hugeint as c, 0::hugeint as wc, (select w from src order by most::double / w, source limit 1) as w2, (select most from src order by most::double / w, source limit 1) as m2
            union all select c, wc, w2, m2 from steps),
        fit as (
            select ((select sum(total) from src) - c)::double as rest, (select sum(w) from src) - wc as room from levels
            where w2 is null or w2 * ((select sum(total) from src) - c)::double < m2 * ((select sum(w) from src) - wc)::double
            order by wc limit 1),
        goal as (
            select source, total, case when room = 0 or w * rest >= most * room::double then most::double else w * (rest / room) end as target from src, fit),
        strata as (
            select d.source, tier, total, target, sum(size) as words from d join goal on d.source is not distinct from goal.source group by all),
        mus as (
            select *, (target - coalesce(sum(words) over (partition by source order by tier desc rows between unbounded preceding and 1 preceding), 0) * 3)
                / nullif(sum(words * tier) over (partition by source order by tier desc rows between current row and unbounded following), 0) as mu from strata),
        means as (
            select *, least(3.0::double, coalesce(max_by(case when mu * tier <= 3 then mu end, case when mu * tier <= 3 then tier end) over (partition by source) * tier, 3.0::double)) as m from mus),
        plans as (
            select *, greatest(0.0::double, case when abs(m - round(m)) < 1e-9 then round(m) else m end) as mean from means),
        pis as (select *, floor(mean) as whole, mean - floor(mean) as pi from plans),
        rests as (select *, sum(words * pi) over (partition by source) as rest from pis),
        ranks as (
            select d.*, total, target, whole, rest, case when pi > 0 then (u / (1 - u)) * ((1 - pi) / pi) end as q
            from d join rests on d.source is not distinct from rests.source and d.tier = rests.tier),
        sums as (
            select *, sum(size) over (partition by source order by q / (1 + q) range unbounded preceding) as upto, sum(size) over (partition by source, q / (1 + q)) as same
            from ranks where q is not null),
        taken as (select r, upto - same / 2 <= rest as extra from sums)
        select doc_id, size, total as source_size, target,
            case when size > 0 then size * (whole::bigint + case when coalesce(extra, false) then 1 else 0 end) else 0 end::bigint as taken
        from ranks left join taken using (r)""",
    "op9_quality_rules": rf"""
        with w as (
            select row_number() over () as r, doc_id, coalesce(lang, '') as s, regexp_extract_all(coalesce(text, ''), '{_WORD}') as w,
                list_filter(string_split(coalesce(text, ''), chr(10)), lambda x: regexp_matches(x, '{_WORD}')) as lines,
                len(regexp_extract_all(coalesce(text, ''), '[#*$%&|<>]')) as n_symbols, len(regexp_extract_all(coalesce(text, ''), '[|]')) as pipes
            from documents),
        grams as (select r, i, w[i] || ' ' || w[i + 1] || ' ' || w[i + 2] as g from (select r, w, unnest(range(1, len(w) - 1)) as i from w where len(w) >= 3)),
        twice as (select r, i from grams qualify count(*) over (partition by r, g) > 1),
        rep as (select r, count(distinct p) as n from (select r, unnest(range(i, i + 3)) as p from twice) group by r),
        f as (
            select r, doc_id, s, len(w) as n_words, length(array_to_string(w, '')) as word_chars, n_symbols, len(lines) - len(list_distinct(lines)) as n_dup_lines,
                coalesce(n, 0) as n_repeat_words, len(lines) as n_lines, pipes from w left join rep using (r)),
        g as (
            select *, n_words < 50 or 100 * n_repeat_words > 50 * n_words as base_failed, least(
                len(list_filter({_LADDER["symbols"]}, lambda c: coalesce(n_symbols / nullif(word_chars, 0)::double, 0) <= c)),
                len(list_filter({_LADDER["dup_lines"]}, lambda c: coalesce(n_dup_lines / nullif(n_lines, 0)::double, 0) <= c)),
                len(list_filter({_LADDER["repeats"]}, lambda c: coalesce(n_repeat_words / nullif(n_words, 0)::double, 0) <= c)),
                len(list_filter({_LADDER["long_words"]}, lambda c: coalesce(word_chars / nullif(n_words, 0)::double, 0) <= c)),
                len(list_filter({_LADDER["pipes"]}, lambda c: coalesce(pipes / nullif(n_words, 0)::double, 0) <= c))) as step from f),
        good as (select s, step from g where not base_failed and doc_id in (select doc_id from labels where quality = 1)),
        counts as (
            select s, false as pooled, j, count(*) as n, count(*) filter (step <= j) as k from good, (select unnest(range(20)) as j) group by s, j
            union all select '', true, j, count(*), count(*) filter (step <= j) from good, (select unnest(range(20)) as j) group by j),
        m as (select greatest(1, count(*)) as m from counts where j = 0 and n >= ln(1 / 0.05) / -ln(1 - 0.02)),
        tests as (
            select s, pooled, j, k <= n * 0.02::double and list_sum(list_transform(range(0, k + 1), lambda i: exp(lgamma(n + 1) - lgamma(i + 1) - lgamma(n - i + 1) + i * ln(0.02) + (n - i) * ln(0.98)))) <= 0.05 / m as passed
            from counts, m where n >= ln(m / 0.05) / -ln(1 - 0.02)),
        levels as (select s, pooled, nullif(coalesce(min(j) filter (not passed), 20) - 1, -1) as level from tests group by s, pooled),
        h as (
            select g.*, case when l.s is not null then l.level else (select level from levels where pooled) end as level
            from g left join levels l on g.s = l.s and not l.pooled)
        select doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, not base_failed and not coalesce(step <= level, false) as kept, cast(level as integer) as level
        from h""",
}
