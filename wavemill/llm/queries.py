"""The registered query of each operator, with production parameters, over whole tables."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import bpe, chat, collocations, html, licences, lines, minhash, mixing, rules, runs, simhash, urls, word_bpe
from .common import cut_lineage, table, words


#: host, path, verdict (fixed values)
URL_RULES = (("com", "/en/", "block"), ("example.com", "/en/7", "allow"), ("net", "/de/", "allow"), ("example.net", "/de/8", "block"), ("org", "/es/", "block"))


def op1_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return minhash.with_next(table(spark, sf_dir, "documents").select("doc_id", "text"), ["doc_id"])


def op6_url_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    rules = spark.createDataFrame(URL_RULES, "host string, path string, verdict string")
    return urls.judge(table(spark, sf_dir, "pages").select("page_id", "url"), rules).drop("url")


OP6_SQL = """
with rules(host, path, verdict) as (values ('com', '/en/', 'block'), ('example.com', '/en/7', 'allow'), ('net', '/de/', 'allow'), ('example.net', '/de/8', 'block'), ('org', '/es/', 'block')),
parts as (select page_id, url, coalesce(regexp_extract(url, '(?s)^.*?://([^/?#]*)([^?#]*)', 1), '') as raw, coalesce(regexp_extract(url, '(?s)^.*?://([^/?#]*)([^?#]*)', 2), '') as path from pages),
split as (select page_id, url, translate(raw, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') as host, path from parts),
urls as (select distinct host, path from split),
fits as (select u.host, u.path, r.host || r.path as rule, r.verdict, row_number() over (partition by u.host, u.path order by length(r.host || r.path) desc, length(r.host) desc) as k
  from urls u join rules r on (u.host = r.host or ends_with(u.host, '.' || r.host)) and starts_with(u.path, r.path))
select s.page_id, s.host, s.path, f.rule, coalesce(f.verdict, 'allow') as verdict
from split s left join (select * from fits where k = 1) f on f.host = s.host and f.path = s.path
"""


def op10_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = lines.dedup(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return out.select("doc_id", "n_lines", "n_removed", F.length("text").cast("long").alias("n_chars"), F.sha2(F.encode("text", "UTF-8"), 256).alias("text_sha256"))


def op2_licence_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents as files of a tree: sources, languages and 256 ids each; those that speak of a licence
    are the licence files of one of the three levels, by their id."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "source", "lang")
    name = lambda c: F.coalesce(c, F.lit("none"))
    levels = [name("source"), F.concat_ws("/", name("source"), name("lang"))]
    levels.append(F.concat_ws("/", levels[1], F.floor(F.col("doc_id") / 256).cast("string")))
    spoken = licences.speaks(F.col("text"))
    level = F.when(~spoken, levels[2]).otherwise(F.element_at(F.array(*levels), (F.pmod("doc_id", F.lit(3)) + 1).cast("int")))
    path = F.concat(level, F.lit("/"), F.when(spoken, "LICENSE-").otherwise("text-"), F.col("doc_id").cast("string"))
    return licences.scan(docs.select("doc_id", "text", path.alias("path"))).select("doc_id", "path", "licence", "score", "origin", "licence_from")


OP2_SQL = r"""
with templates(no, licence, template) as (values %s),
spoken as (select doc_id, text, coalesce(source, 'none') as l0, coalesce(source, 'none') || '/' || coalesce(lang, 'none') as l1,
    coalesce(regexp_matches(text, '(?i)(licen[sc]e|copyright|spdx)'), false) as s from documents),
files as (select doc_id, text, case when not s or doc_id %% 3 = 2 then l1 || '/' || (doc_id // 256) when doc_id %% 3 = 1 then l1 else l0 end || '/' || case when s then 'LICENSE-' else 'text-' end || doc_id as path from spoken),
lines as (select path, unnest(string_split(text, chr(10))) as statement from files),
headers as (select path, regexp_extract(text, '%s') as statement from files),
found as (select * from lines where regexp_matches(statement, '(?i)(licen[sc]e|copyright|spdx)')
    union all select * from headers where regexp_matches(statement, '[A-Za-z0-9]')
    union all select path, text from files where path like '%%/LICENSE-%%' and text is not null),
stated as (select statement, count(*) as n from found group by 1),
words as (select statement, unnest(regexp_extract_all(lower(statement), '[a-z0-9]+(?:[.-][a-z0-9]+)*')) as term from stated),
terms as (select statement, term, count(*) as tf from words group by 1, 2),
rarity as (select term, sum(n) as df from terms join stated using (statement) group by 1),
total as (select sum(n) as n from stated),
ours as (select statement, term, tf * (ln((1.0 + (select n from total)) / (1.0 + df)) + 1.0) as w from terms join rarity using (term)),
template_words as (select no, unnest(regexp_extract_all(lower(template), '[a-z0-9]+(?:[.-][a-z0-9]+)*')) as term from templates),
template_terms as (select no, term, count(*) as tf from template_words group by 1, 2),
theirs as (select no, term, tf * (ln((1.0 + (select n from total)) / (1.0 + coalesce(df, 0))) + 1.0) as v from template_terms left join rarity using (term)),
scored as (select o.statement, t.no, round(sum(w * v) / (any_value(a) * any_value(b)), 6) as score from ours o join theirs t using (term)
    join (select statement, sqrt(sum(w * w)) as a from ours group by 1) x on x.statement = o.statement join (select no, sqrt(sum(v * v)) as b from theirs group by 1) y on y.no = t.no group by 1, 2),
matched as (select statement, licence, score from scored join templates using (no) where score >= 0.6 qualify row_number() over (partition by statement order by score desc, licence desc) = 1),
own as (select path, licence, score from found join matched using (statement) qualify row_number() over (partition by path order by score desc, licence desc) = 1),
folders as (select regexp_replace(path, '/[^/]*$', '') as above, licence, score from own where path like '%%/LICENSE-%%' qualify row_number() over (partition by above order by score desc, licence desc) = 1)
select f.doc_id, f.path, coalesce(o.licence, d.licence) as licence, coalesce(o.score, d.score) as score,
  case when o.path is not null then 'own' when d.above is not null then 'directory' end as origin, case when o.path is null then d.above end as licence_from
from files f left join own o using (path) left join folders d on o.path is null and starts_with(f.path, d.above || '/')
qualify row_number() over (partition by f.path order by length(d.above) desc nulls last) = 1
""" % (", ".join("(%d, '%s', '%s')" % (i, name, text.replace("'", "''")) for i, (name, text) in enumerate(licences.TEMPLATES)), licences.COMMENT)


def op3_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    learned = rules.fit(docs, table(spark, sf_dir, "labels"))
    return rules.judge(docs, learned).drop("text")


def op4_main_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "pages").select("page_id", "url", "html")
    out = html.extract(pages, html.fit(pages)).drop("html")
    return out.withColumn("n_chars", F.length("text").cast("long"))


def op5_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    marked = cut_lineage(simhash.fingerprints(docs).drop("text"))
    return simhash.groups(marked).select("doc_id", simhash.hexadecimal().alias("fingerprint"), "component_id")


def op7_chat(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Writes each conversation as a transcript, its speakers marked in one of several ways or, now
    and then, not at all; parses it; tells whether roles and texts come back."""
    style = F.pmod(F.xxhash64("conv_id"), F.lit(1000))
    given = chat.gather(table(spark, sf_dir, "conversations"))
    model = chat.fit(given.withColumn("style", style), F.col("style"))
    written = chat.transcripts(given.withColumn("style", style), F.col("style"))
    parsed = chat.parse_parts(written, model)
    roles = lambda c: F.concat_ws("", F.transform(c, lambda t: F.coalesce(F.left(t["role"], F.lit(1)), F.lit("?"))))
    return parsed.select(
        "conv_id",
        "part_no",
        F.size("parsed").cast("long").alias("n_turns"),
        roles("parsed").alias("roles"),
        roles("turns").alias("given_roles"),
        F.sha2(F.encode(chat.render(F.col("parsed")), "UTF-8"), 256).alias("rendered_sha256"),
    )


def op8_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "source", "text")
    measured = cut_lineage(mixing.measure(docs).drop("text"))
    return mixing.mix(measured, mixing.plan(measured)).select("doc_id", "size", "source_size", "target", "taken", "times", "source")


def op9_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    vocabulary = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")
    texts = table(spark, sf_dir, "documents").select("doc_id", "text")
    return bpe.round_trip(texts, vocabulary, public_tokenizers.PATTERN).select(
        "doc_id",
        F.size("ids").cast("long").alias("n_tokens"),
        F.sha2(F.concat_ws(",", F.col("ids").cast("array<string>")), 256).alias("ids_sha256"),
        F.sha2(F.encode("text", "UTF-8"), 256).alias("decoded_sha256"),
    )


def op11_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return collocations.mine(table(spark, sf_dir, "documents").select("lang", "text"))


OP11_SQL = r"""
with pieces as (select coalesce(lang, 'und') as lang, unnest(string_split_regex(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\n-\r]')) as piece from documents),
worded as (select lang, list_filter(string_split_regex(piece, '[ \t]+'), lambda w: w <> '') as w from pieces),
grams as (select lang, size, unnest(list_transform(range(1, len(w) - size + 2), lambda i: array_to_string(w[i:i + size - 1], ' '))) as phrase from worded, (values (1), (2), (3)) as sizes(size)),
found as (select lang, size, phrase, count(*) as f from grams group by all),
totals as (select lang, sum(f)::bigint as n from found where size = 1 group by lang),
candidates as (select lang, size, phrase, f as a, string_split(phrase, ' ') as w from found where size >= 2 and f >= 10),
cuts as (select lang, phrase, a, k, array_to_string(w[1:k], ' ') as head, array_to_string(w[k + 1:], ' ') as rest from candidates, (values (1), (2)) as places(k) where k < size),
scored as (select c.lang, c.phrase, c.a, h.f as l, r.f as r, (1000000::hugeint * c.a * c.a) // (h.f::hugeint * r.f) as score, k
  from cuts c join found h on h.lang = c.lang and h.phrase = c.head join found r on r.lang = c.lang and r.phrase = c.rest),
best as (select * from scored qualify row_number() over (partition by lang, phrase order by score, k) = 1),
inside as (select lang, array_to_string(w[i:i + 1], ' ') as phrase, a as longer from candidates, (values (1), (2)) as places(i) where size = 3),
kept as (select * from best b where not exists (select 1 from inside i where i.lang = b.lang and i.phrase = b.phrase and 100 * i.longer >= 50 * b.a))
select lang, row_number() over (partition by lang order by score desc, a desc, phrase) as rank, phrase, a, l, r, n, score::bigint as score
from kept join totals using (lang) qualify rank <= 2000
"""


def op12_word_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    texts = table(spark, sf_dir, "documents").select("doc_id", "text")
    return word_bpe.encode(texts, public_tokenizers.path("word_bpe_49k.json"), listed="decoded").select(
        "doc_id",
        F.size("ids").cast("long").alias("n_tokens"),
        F.sha2(F.concat_ws(" ", F.col("ids").cast("array<string>")), 256).alias("ids_sha256"),
        F.sha2(F.encode("decoded", "UTF-8"), 256).alias("decoded_sha256"),
    )


def op13_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents of every tenth hash are made periodic from one of their words on; runs are found in all."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    h, n, every = F.crc32(F.col("doc_id").cast("string")), F.size("words"), F.col("words")
    g = F.floor(h / 10)
    start = (g % n).cast("int")
    period = (1 + F.floor((n - start) / (3 + g % 8))).cast("int")
    repeated = F.flatten(F.array_repeat(F.slice(every, start + 1, period), F.ceil((n - start) / period).cast("int")))
    planted = F.array_join(F.slice(F.concat(F.slice(every, F.lit(1), start), repeated), F.lit(1), n), " ")
    chosen = (h % 10 == 0) & F.rlike("text", F.lit(r"[^\x20\x09-\x0D]"))
    texts = docs.withColumn("words", F.when(chosen, words(F.col("text")))).withColumn("text", F.when(chosen, planted).otherwise(F.col("text")))
    marked = runs.mark(texts.drop("words")).withColumn("best", runs.strongest())
    listed = F.concat_ws("", F.transform("runs", lambda r: F.concat(F.concat_ws(",", r["start"], r["length"], r["period"]), F.lit("\n"))))
    return marked.select(
        "doc_id",
        F.size("runs").cast("long").alias("n_runs"),
        *[F.col(f"best.{c}").alias(c) for c in ("start", "length", "period")],
        F.floor(1000 * F.col("best.length") / F.col("best.period")).alias("exponent_milli"),
        F.sha2(F.encode(listed, "UTF-8"), 256).alias("runs_sha256"),
        F.sha2(F.encode("collapsed", "UTF-8"), 256).alias("collapsed_sha256"),
    )


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_minhash": op1_minhash,
    "op2_licence_scan": op2_licence_scan,
    "op3_quality_rules": op3_quality_rules,
    "op4_main_text": op4_main_text,
    "op5_simhash": op5_simhash,
    "op6_url_rules": op6_url_rules,
    "op7_chat": op7_chat,
    "op8_mixing": op8_mixing,
    "op9_byte_bpe": op9_byte_bpe,
    "op10_line_dedup": op10_line_dedup,
    "op11_collocations": op11_collocations,
    "op12_word_bpe": op12_word_bpe,
    "op13_periodic_runs": op13_periodic_runs,
}

ORACLES: dict[str, str] = {
    "op2_licence_scan": OP2_SQL,
    "op6_url_rules": OP6_SQL,
    "op11_collocations": OP11_SQL,
}
