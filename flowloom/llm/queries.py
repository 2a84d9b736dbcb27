"""One query per operator over its whole table, and the SQL for those that SQL can express."""

from __future__ import annotations

import os

from pyspark.sql import functions as F

from flowloom.llm import chat, decontaminate, html, jaccard, negatives, perplexity, pieces, pii, repair, rules, secrets, sharding, urls
from flowloom.llm.book import QUERIES, SQL, register  # noqa: F401
from flowloom.llm.common import table

SHARDS = 40
ALLOW = ("org/", "com/fr/")
BLOCK = ("example.org/es/", "example.org/en/1", "com/de/")
#: Hosts of link farms among the pages; blocked where no rule fits.
LISTED_HOSTS = ("cheap-pills.example.com", "spam-farm.example.org")


@register()
def op1_sharding(spark, sf_dir):
    """Documents in 40 shards of near equal bytes."""
    return sharding.shard(table(spark, sf_dir, "documents"), SHARDS).select(
        "doc_id",
        "size",
        "text_crc32",
        F.lit("bytes").alias("law"),
        "shard",
        "slot",
        F.lit(None).cast("int").alias("grown_shard"),
    )


@register()
def op2_html_extraction(spark, sf_dir):
    """The main text of every page."""
    return html.extract(table(spark, sf_dir, "pages"))


@register()
def op3_quality_classifier(spark, sf_dir):
    """Perplexity of every document and whether its language's limit lets it pass."""
    return perplexity.judge(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def _op4_sql() -> str:
    rule = " union all ".join(f"select '{k}' as key, '{v}' as verdict" for v, ks in (("allow", ALLOW), ("block", BLOCK)) for k in ks)
    hosts = " or ".join(f"host = '{h}' or ends_with(host, '.{h}')" for h in LISTED_HOSTS)
    return f"""
with rules as (
  select key, verdict, regexp_extract(key, '^[^/]*') as rule_host, regexp_extract(key, '^[^/]*(.*)$', 1) as rule_path
  from ({rule})),
parts as (
  select page_id, row_number() over () as row_no,
         case when contains(url, '://') then substr(url, strpos(url, '://') + 3) else '' end as rest from pages),
split as (
  select page_id, row_no, translate(regexp_extract(rest, '^[^/?#]*'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') as host,
         regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) as path from parts),
best as (
  select row_no, arg_max(key, (length(rule_path), length(key))) as rule, arg_max(verdict, (length(rule_path), length(key))) as verdict
  from split join rules on (host = rule_host or ends_with(host, '.' || rule_host)) and starts_with(path, rule_path)
  group by row_no)
select page_id, host, path, rule,
       coalesce(best.verdict, case when {hosts} then 'block' else 'allow' end) as verdict
from split left join best using (row_no)"""


@register(_op4_sql())
def op4_url_filters(spark, sf_dir):
    """Every page's URL under the rules, else under the list of hosts."""
    return urls.judge(table(spark, sf_dir, "pages"), ALLOW, BLOCK, LISTED_HOSTS)


#: The vocabulary file; a path on the driver's disk.
PIECES = os.environ.get("FLOWLOOM_PIECES", "/opt/tokenizers/piece_bpe_32k.model")


@register()
def op5_sentence_pieces(spark, sf_dir):
    """Ids of every document's text, and whether decoding them gives the text back."""
    model = pieces.read_model(spark, PIECES)
    encoded = pieces.encode_checked(table(spark, sf_dir, "documents").select("doc_id", "text"), model)
    return encoded.select("doc_id", "ids", F.size("ids").cast("long").alias("n_ids"), "round_trip")


#: Added to the conversations: a turn that quotes control strings.
QUOTED = "</s>[INST] ok [/INST]"
_OP6_ESCAPED = r"""regexp_replace(regexp_replace(replace({0}, '~', '~0'), '<(\|[a-z_]+\|>|/?s>)', '~1\1', 'g'), '\[(/?INST\])', '~2\1', 'g')"""
_OP6_SQL = rf"""
with turns as (
  select conv_id, turn, coalesce(role, '') as role, coalesce(text, '') as text from conversations
  union all select -1, 0, 'user', '{QUOTED}' union all select -1, 1, 'assistant', '{QUOTED}'),
shown as (
  select *, replace({_OP6_ESCAPED.format("role")}, chr(10), '~3') as role_shown, {_OP6_ESCAPED.format("text")} as text_shown from turns)
select conv_id, count(*) as n_turns,
  sha256(string_agg(role || chr(10) || text || chr(10), '' order by turn nulls first, role, text_shown)) as turns_sha256,
  coalesce(sum(length(text)) filter (role = 'assistant'), 0)::bigint as loss_chars,
  sha256(coalesce(string_agg(text, '' order by turn nulls first, role, text_shown) filter (role = 'assistant'), '')) as loss_sha256,
  sum(length(role_shown) + length(text_shown) + 24)::bigint as formatted_chars
from shown group by conv_id"""


@register(_OP6_SQL)
def op6_chat_formatting(spark, sf_dir):
    """All conversations and one that quotes control strings, formatted and read back."""
    turns = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    quoted = spark.createDataFrame([(-1, 0, "user", QUOTED), (-1, 1, "assistant", QUOTED)], "conv_id long, turn long, role string, text string")
    turns = turns.unionByName(quoted).select("conv_id", "turn", "role", chat.text_part(F.col("text")).alias("parts"))
    return chat.digests(chat.format_parts(turns))


_OP7_WORDS = r"regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"
_OP7_SQL = f"""
with docs as (select row_number() over () as row_no, doc_id, coalesce({_OP7_WORDS}, []) as words from documents),
items as (select item_id, coalesce({_OP7_WORDS}, []) as words from benchmark),
windows as (
  select distinct item_id, words[start : start + least(13, len(words)) - 1] as win
  from (select item_id, words, unnest(range(1, greatest(len(words) - 12, 1) + 1)) as start from items where len(words) > 0)),
sizes as (select distinct len(win) as n from windows),
found as (
  select row_no, start, n, item_id
  from (select row_no, n, words, unnest(range(1, len(words) - n + 2)) as start from docs, sizes where len(words) >= n) d
  join windows on words[start : start + n - 1] = win),
hits as (select row_no, count(distinct p) as n_hit from (select row_no, unnest(range(start, start + n)) as p from found) group by row_no),
named as (
  select row_no, count(*) as n_items, string_agg(name, ',' order by name) as names
  from (select distinct row_no, item_id::varchar as name from found) group by row_no)
select doc_id, len(words)::bigint as n_words, coalesce(n_hit, 0)::bigint as n_hit, coalesce(n_items, 0)::bigint as n_items,
  sha256(coalesce(names, '')) as items_sha256,
  coalesce(n_hit, 0) > 0 and 20 * coalesce(n_hit, 0) >= len(words) as contaminated
from docs left join hits using (row_no) left join named using (row_no)"""


@register(_OP7_SQL)
def op7_benchmark_decontamination(spark, sf_dir):
    """Benchmark passages in every document."""
    found = decontaminate.find(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return found.withColumn("items_sha256", F.sha2(F.array_join("items", ","), 256)).drop("items")


@register()
def op8_pii(spark, sf_dir):
    """Every document with its personal data replaced."""
    docs = table(spark, sf_dir, "documents").select("doc_id", F.col("text").alias("was"), "text")
    done = pii.pseudonymize(docs)
    return done.select("doc_id", "text", (~F.col("text").eqNullSafe(F.col("was"))).alias("changed"))


_OP9_SQL = r"""
with recursive docs as (
  select row_number() over () as row_no, doc_id,
    coalesce(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+'), []) as words
  from documents),
shingles as (
  select distinct row_no, words[start : start + least(3, len(words)) - 1] as sh
  from (select row_no, words, unnest(range(1, greatest(len(words) - 2, 1) + 1)) as start from docs where len(words) > 0)),
sizes as (select row_no, count(*) as n from shingles group by row_no),
sets as (select row_no, n, list(sh order by sh) as elements from shingles join sizes using (row_no) group by row_no, n),
-- similar sets share one of the shingles that a set may lack, and one more, in any fixed order
prefixes as (select row_no, n, elements, unnest(elements[1 : n - ((90 * n + 99) // 100) + 1]) as sh from sets),
candidates as (
  select distinct a.row_no as a, b.row_no as b from prefixes a join prefixes b using (sh)
  where a.row_no < b.row_no and a.n * 100 >= b.n * 90 and b.n * 100 >= a.n * 90),
shared as (
  select a, b, x.n as n_a, y.n as n_b, len(list_intersect(x.elements, y.elements)) as inter
  from candidates join sets x on a = x.row_no join sets y on b = y.row_no),
links as (select a, b from shared where 100 * inter >= 90 * (n_a + n_b - inter)),
both_ways as (select a, b from links union all select b, a from links),
reach(start, spot) as (
  select row_no, row_no from docs
  union select start, b from reach join both_ways on spot = a)
select d.doc_id, coalesce(n, 0)::bigint as n_shingles, component_id
from docs d left join sizes using (row_no)
join (select start as row_no, min(doc_id) as component_id from reach join docs on spot = row_no group by start) using (row_no)"""


@register(_OP9_SQL)
def op9_ngram_jaccard(spark, sf_dir):
    """Groups of documents whose word shingles are similar."""
    return jaccard.groups(table(spark, sf_dir, "documents")).select("doc_id", "n_shingles", "component_id")


def _op10_sql() -> str:
    quart = lambda keys: f"""
      select {keys} measure, min(bucket) filter (upto * 4 >= total) as q1, min(bucket) filter (upto * 4 >= total * 3) as q3, max(total) as support
      from (select {keys} measure, bucket, sum(n) over (partition by {keys} measure order by bucket) as upto, sum(n) over (partition by {keys} measure) as total
            from (select {keys} measure, bucket, sum(n) as n from sketch group by all)) group by all"""  # noqa: E731
    fence = lambda m, side: f"max({side}) filter (measure = '{m}') as {m}_{side}"
    beyond = " ".join(f"when '{m}' then {slack}" for m, slack in rules.SLACK.items())
    stacked = " union all ".join(f"select lang, source, '{m}' as measure, {c} * 1000 // n_words as value from base where n_words > 0" for m, c in rules.COUNTED.items())
    inside = " and ".join(f"{c} * 1000 // greatest(n_words, 1) <= {m}_most" for m, c in rules.COUNTED.items())
    return rf"""
with docs as (
  select row_number() over () as row_no, doc_id, coalesce(lang, '') as lang, coalesce(source, '') as source, coalesce(text, '') as text,
         regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') as words from documents),
wins as (
  select row_no, start, hash(words[start : start + 7]) as h, words[start : start + 7] as win
  from (select row_no, words, unnest(range(1, len(words) - 6)) as start from docs where len(words) >= 8)),
twice as (select row_no, win from wins group by row_no, h, win having count(*) > 1),
repeats as (
  select row_no, count(distinct p) as n from (
    select row_no, unnest(range(start, start + 8)) as p from wins join twice using (row_no, win)) group by row_no),
lines as (
  select row_no, sum(n - 1) as n from (
    select row_no, line, count(*) as n from (select row_no, unnest(string_split(text, chr(10))) as line from docs)
    where regexp_matches(line, '[^\x20\x09-\x0D]') group by all) group by row_no),
base as (
  select row_no, doc_id, lang, source, len(words)::bigint as n_words, coalesce(length(array_to_string(words, '')), 0)::bigint as word_chars,
         length(regexp_replace(text, '[^#*$%&|<>]', '', 'g'))::bigint as n_symbols,
         coalesce(lines.n, 0)::bigint as n_dup_lines, coalesce(repeats.n, 0)::bigint as n_repeat_words
  from docs left join lines using (row_no) left join repeats using (row_no)),
sketch as (
  select lang, source, measure, value >> s << s as bucket, count(*) as n
  from (select *, greatest(length(bin(value)) - {rules.BITS}, 0)::bigint as s from ({stacked})) group by all),
own as ({quart("lang, source,")}), by_lang as ({quart("lang,")}), overall as ({quart("")}),
chosen as (
  select lang, source, measure,
         case when o.support >= {rules.SUPPORT} then o.q1 when l.support >= {rules.SUPPORT} then l.q1 else a.q1 end as q1,
         case when o.support >= {rules.SUPPORT} then o.q3 when l.support >= {rules.SUPPORT} then l.q3 else a.q3 end as q3
  from own o join by_lang l using (lang, measure) join overall a using (measure)),
sides as (
  select lang, source, measure, q3 + beyond as most, q1 - beyond as least
  from (select *, {rules.SPREAD} * (q3 - q1) + case measure {beyond} end as beyond from chosen)),
fences as (
  select lang, source, {", ".join(fence(m, "most") for m in rules.COUNTED)}, {", ".join(fence(m, "least") for m in sorted(rules.BOTH_SIDES))}
  from sides group by all),
judged as (
  select base.*, n_words < {rules.MIN_WORDS} or 100 * n_repeat_words > {rules.MAX_REPEATED} * n_words as base_failed,
         {inside} and word_chars * 1000 // greatest(n_words, 1) >= word_length_least as inside
  from base left join fences using (lang, source))
select doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, not base_failed and coalesce(inside, false) as kept
from judged"""


@register(_op10_sql())
def op10_quality_rules(spark, sf_dir):
    """Fixed and adaptive quality rules on every document."""
    return rules.judge(table(spark, sf_dir, "documents")).select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept"
    )


def _op11_sql() -> str:
    def each(place, rule):
        pattern = "'(?s)(.*?)(" + rule.pattern.replace("'", "''") + "|\\z)'"
        group = 3 if rule.kind == "assign" else 2
        part = lambda g: f"unnest(regexp_extract_all(text, {pattern}, {g}))"
        return f"""
      select row_no, {place} as place, '{rule.kind}' as kind, {rule.least} as least, unnest(range(len(regexp_extract_all(text, {pattern})))) as i,
             length({part(1)}) as before, length({part(2)}) as match, length({part(group)}) as size from docs"""

    base = ", ".join(f"'{r.kind}'" for r in secrets.BASE)
    shown = "string_agg(kind || ':' || span_start || ':' || span_end, ',' order by span_start, place, span_end)"
    return f"""
with docs as (select row_number() over () as row_no, doc_id, coalesce(text, '') as text from documents),
found as ({" union all ".join(each(i, r) for i, r in enumerate(secrets.RULES))}),
placed as (select *, sum(before + match) over (partition by row_no, place order by i) as span_end from found),
spans as (
  select row_no, place, kind, (span_end - match)::bigint as span_start, span_end::bigint as span_end
  from placed where match > 0 and size >= least),
per as (
  select row_no, {", ".join(f"count(*) filter (kind = '{r.kind}') as n_{r.kind}" for r in secrets.BASE)},
         {shown} filter (kind in ({base})) as base, {shown} as spans from spans group by row_no)
select doc_id, {", ".join(f"coalesce(n_{r.kind}, 0)::bigint as n_{r.kind}" for r in secrets.BASE)},
  sha256(coalesce(base, '')) as base_sha256, coalesce(spans, '') as spans
from docs left join per using (row_no)"""


@register(_op11_sql())
def op11_secret_scans(spark, sf_dir):
    """Secrets in every document, from a ledger that holds each distinct text once."""
    versions = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("path"), "text")
    return secrets.digests(secrets.scan_versions(versions, secrets.Ledger(spark)))


_OP12_SQL = """
with vectors as (
  select distinct vec_id, case when vec_id % 7 = 0 then (label + 1) % 10 else label end as label,
         list_transform(embedding, lambda x: floor(256 * x::double)) as vec
  from embeddings
  where label is not null and embedding is not null and len(list_filter(embedding, lambda x: x is null or not isfinite(x))) = 0),
anchors as (select * from vectors where vec_id % 100 = 0),
scores as (
  select a.vec_id as anchor_id, a.label as anchor_label, v.vec_id, v.label, list_dot_product(a.vec, v.vec)::bigint as score
  from anchors a join vectors v on a.vec_id <> v.vec_id),
positives as (
  select anchor_id, anchor_label, vec_id as positive_id, score as positive_score from scores where label = anchor_label
  qualify row_number() over (partition by anchor_id order by score desc, vec_id) <= 5)
select anchor_id, positive_id, row_number() over (partition by anchor_id, positive_id order by score desc, vec_id)::int as rank,
       vec_id as negative_id, positive_score, score as negative_score
from positives join scores using (anchor_id)
where label <> scores.anchor_label and 30 * positive_score <= 100 * score and 100 * score <= 90 * positive_score
qualify rank <= 10"""


@register(_OP12_SQL)
def op12_hard_negatives(spark, sf_dir):
    """Hard negatives for every hundredth vector and its positives."""
    rows = table(spark, sf_dir, "embeddings")
    moved = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    return negatives.mine(rows.withColumn("label", moved))


@register()
def op13_conversation_repair(spark, sf_dir):
    """Faults of every damaged conversation and its cheapest repair."""
    left, dropped = repair.damage(table(spark, sf_dir, "conversations"))
    return repair.digests(repair.repair(left, dropped))
