"""The registered queries of this subpackage: each applies one operator, with production parameters, to its whole table."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import chat_format, decontaminate, katz, language_id, license_scan, line_dedup, minhash_dedup, packing, prefix_trie, quality_classifier, quality_rules, suffix_dedup, whitening
from .tables import held_out


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def op1_katz_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    return katz.katz_scores(read(spark, sf_dir, "documents"), ~held_out(10, 0), katz.Katz(order=3))


def op2_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = read(spark, sf_dir, "documents"), read(spark, sf_dir, "labels")
    scored = quality_classifier.classify(docs, labels, ~held_out(4, 2))
    return scored.select("doc_id", held_out(4, 2).alias("held_out"), "score", (F.col("score") >= 0.7).cast("int").alias("predicted"))


def op3_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return license_scan.scan(read(spark, sf_dir, "documents"))


def op4_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return line_dedup.remove_units(read(spark, sf_dir, "documents")).drop("kept_text")


def op5_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_rules.quality_rules(read(spark, sf_dir, "documents"))


def op6_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.decontaminate(read(spark, sf_dir, "documents"), read(spark, sf_dir, "benchmark")).drop("row")


def op7_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(read(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"))


def op8_minhash_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = minhash_dedup.near_duplicates(read(spark, sf_dir, "documents"))
    return found.select("doc_id", "n_shingles", "component_id", "kept")


def op9_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = suffix_dedup.remove_repeats(read(spark, sf_dir, "documents"), report=256)
    return found.select("doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256", "n_repeated")


def op10_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents")
    prototypes = language_id.learn(docs.where(~held_out(3, 1)))
    found = language_id.identify(docs, prototypes)
    return found.select("doc_id", held_out(3, 1).alias("held_out"), "lang_pred", "score")


def op11_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    return prefix_trie.trie(read(spark, sf_dir, "conversations"))


def op12_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    return whitening.whiten(read(spark, sf_dir, "embeddings"))


#: A conversation that is formatted beside those of the table.
TRYING = [(-7, 0, "user", r"\### Assistant: </turn> ok"), (-7, 1, "assistant", r"\### Assistant: </turn> ok")]


def op13_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    columns = ["conv_id", "turn", "role", "text"]
    trying = F.inline(F.array(*(F.struct(*(F.lit(v).alias(c) for v, c in zip(row, columns))) for row in TRYING)))
    chats = read(spark, sf_dir, "conversations").select(*columns).unionByName(spark.range(1).select(trying))
    return chat_format.digests(chat_format.format_chats(chats))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {f.__name__: f for f in (op1_katz_scores, op2_quality_classifier, op3_license_scan, op4_line_dedup, op5_quality_rules, op6_decontaminate, op7_packing, op8_minhash_dedup, op9_suffix_dedup, op10_language_id, op11_prefix_trie, op12_whitening, op13_chat_format)}


LOWER = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
ALNUM = rf"regexp_extract_all({LOWER}, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"
SPACED = rf"regexp_extract_all({LOWER}, '[^\x20\x09-\x0D]+')"

DECONTAMINATE = f"""
with items as (select item_id, w, least(10, len(w)) as k from (select item_id, {ALNUM} as w from benchmark) where len(w) > 0),
tests as (select distinct item_id, k, unnest(list_transform(range(1, len(w) - k + 2), lambda i: array_to_string(w[i:i + k - 1], ' '))) as s from items),
docs as (select doc_id, {ALNUM} as w from documents),
places as (select doc_id, w, k, unnest(range(1, len(w) - k + 2)) as i from docs, (select distinct k from tests)),
found as (select doc_id, places.k, i, item_id from places join tests on places.k = tests.k and array_to_string(w[i:i + places.k - 1], ' ') = s),
hit as (select doc_id, count(distinct place) as n_hit from (select doc_id, unnest(range(i, i + k)) as place from found) group by 1),
named as (select doc_id, count(*) as n_items, string_agg(item, ',' order by item) as items from (select distinct doc_id, cast(item_id as varchar) as item from found) group by 1)
select doc_id, len(w) as n_words, coalesce(n_hit, 0) as n_hit, coalesce(n_items, 0) as n_items, sha256(coalesce(items, '')) as items_sha256, coalesce(n_hit, 0) > 0 as contaminated
from docs left join hit using (doc_id) left join named using (doc_id)
"""

NEAR_DUPLICATES = f"""
with recursive docs as (select doc_id, {SPACED} as w from documents),
sets as (select distinct doc_id, unnest(case when len(w) = 0 then [] when len(w) < 5 then [array_to_string(w, ' ')] else list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i + 4], ' ')) end) as s from docs),
sizes as (select doc_id, count(*) as n from sets group by 1),
shared as (select a.doc_id as a, b.doc_id as b, count(*) as n from sets a join sets b on a.s = b.s and a.doc_id <> b.doc_id group by 1, 2),
links as (select a, b from shared join sizes x on x.doc_id = a join sizes y on y.doc_id = b where 100 * shared.n >= 85 * (x.n + y.n - shared.n)),
reached(a, b) as (select doc_id, doc_id from docs union select reached.a, links.b from reached join links on reached.b = links.a),
least as (select a as doc_id, min(b) as component_id from reached group by 1)
select doc_id, coalesce(n, 0) as n_shingles, component_id, doc_id = component_id as kept from docs left join sizes using (doc_id) join least using (doc_id)
"""

SUFFIXES = """
with docs as (select doc_id, hex(encode(coalesce(text, ''))) as h from documents),
places as (select doc_id, i, hash(substr(h, 2 * i + 1, 800)) as x from (select doc_id, h, unnest(range(0, length(h) // 2 - 399)) as i from docs where length(h) >= 800)),
again as (select x from places group by x having count(*) > 1),
starts as (select doc_id, i, coalesce(i > lag(i) over (partition by doc_id order by i) + 400, true) as apart from places semi join again using (x)),
spans as (select doc_id, run, min(i) as a, max(i) + 400 as b from (select doc_id, i, sum(apart::int) over (partition by doc_id order by i) as run from starts) group by 1, 2),
pieces as (select doc_id, lag(b, 1, 0) over (partition by doc_id order by a) as a, a as b from spans union all select doc_id, max(b), null from spans group by 1),
kept as (select doc_id, string_agg(substr(h, 2 * a + 1, 2 * (coalesce(b, length(h) // 2) - a)), '' order by a) as k from pieces join docs using (doc_id) group by 1),
removed as (select doc_id, sum(b - a)::bigint as n, count(*) as spans from spans group by 1),
short as (select doc_id, i, hash(substr(h, 2 * i + 1, 512)) as x from (select doc_id, h, unnest(range(0, length(h) // 2 - 255)) as i from docs where length(h) >= 512)),
short_again as (select x from short group by x having count(*) > 1),
covered as (select doc_id, least(256, coalesce(lead(i) over (partition by doc_id order by i) - i, 256)) as c from short semi join short_again using (x)),
repeated as (select doc_id, sum(c)::bigint as r from covered group by 1)
select doc_id, length(h) // 2 as n_bytes, coalesce(n, 0) as n_removed, coalesce(spans, 0) as n_spans, sha256(unhex(coalesce(k, h))) as kept_sha256, coalesce(r, 0) as n_repeated
from docs left join kept using (doc_id) left join removed using (doc_id) left join repeated using (doc_id)
"""

#: The register of CRC-32 after the bytes of a short text of ASCII characters.
CRC32 = """xor(list_reduce(list_prepend(4294967295, list_transform(range(1, length({0}) + 1), lambda i: ord({0}[i]))),
lambda c, b: list_reduce(list_prepend(xor(c, b), range(8)), lambda x, k: case when x & 1 = 1 then xor(x >> 1, 3988292384) else x >> 1 end)), 4294967295)"""

PREFIX_TRIE = f"""
with placed as (select conv_id, row_number() over (partition by conv_id order by turn nulls first, role, text) as place, coalesce(role, '') as role, coalesce(text, '') as text from conversations where conv_id is not null),
lists as (select conv_id, conv_id - conv_id % 20 as base, {CRC32.format("cast(conv_id as varchar)")} % 4 as h from (select distinct conv_id from placed)),
turns as (select lists.conv_id, 0 as part, place, role, text from lists join placed on placed.conv_id = base and place <= h union all select conv_id, 1, place, role, text from placed join lists using (conv_id) where place > h),
every as (select conv_id, row_number() over w as depth, text, sha256(string_agg(length(role) || ':' || length(text) || ':' || role || text, ',') over w) as prefix from turns window w as (partition by conv_id order by part, place)),
sized as (select lists.conv_id, count(depth) as size from lists left join every using (conv_id) group by 1),
members as (select conv_id, depth, prefix, len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')) as words from every union all select conv_id, 0, '', 0 from lists),
nodes as (select depth, prefix, min(conv_id) as owner, count(*) as n_convs, (count(*) - 1) * max(words) as saved from members group by 1, 2),
owned as (select conv_id, depth, prefix, owner, n_convs, saved from members join nodes using (depth, prefix)),
children as (select above.prefix, above.depth, count(*) as n_children from nodes join owned on owned.conv_id = nodes.owner and owned.depth = nodes.depth join owned above on above.conv_id = nodes.owner and above.depth = nodes.depth - 1 group by 1, 2),
own as (select owned.conv_id, owned.depth, sum(case when owner = owned.conv_id then saved else 0 end) over below as saved, sum(case when owner = owned.conv_id and n_children is null then 1 else 0 end) over below as leaves
  from owned left join children using (depth, prefix) window below as (partition by owned.conv_id order by owned.depth desc)),
sums as (select depth, prefix, sum(own.saved) as saved, sum(leaves) as leaves from own join members using (conv_id, depth) group by 1, 2),
ends as (select depth, prefix, string_agg(conv_id::varchar, ',' order by conv_id) as ids from members join sized using (conv_id) where depth = size group by 1, 2)
select owner as conv_id, nodes.depth::bigint as depth, (select above.owner from owned above where above.conv_id = nodes.owner and above.depth = nodes.depth - 1) as parent_conv_id, n_convs, coalesce(n_children, 0) as n_children,
  sums.leaves::bigint as n_leaves, sums.saved::bigint as saved_tokens, sha256(coalesce(ids, '')) as ends_sha256
from nodes join sums using (depth, prefix) left join children using (depth, prefix) left join ends using (depth, prefix)
"""

CHAT_FORMAT = r"""
with turns as (select conv_id, turn, coalesce(role, '') as role, coalesce(text, '') as text from conversations
  union all select -7, 0, 'user', '\### Assistant: </turn> ok' union all select -7, 1, 'assistant', '\### Assistant: </turn> ok'),
sized as (select *, 4 + length(role) + 2 * len(regexp_extract_all(role, '[%:\n#<\\]')) + 2 + length(text) + len(regexp_extract_all(text, '###|</turn>')) + 9 as chars from turns),
whole as (select conv_id, count(*) as n_turns, string_agg(role || chr(10) || text || chr(10), '' order by turn nulls first, role, text) as every,
  coalesce(string_agg(text, '' order by turn nulls first, text) filter (role = 'assistant'), '') as loss, sum(chars)::bigint as formatted_chars from sized group by 1)
select conv_id, n_turns, sha256(every) as turns_sha256, length(loss) as loss_chars, sha256(loss) as loss_sha256, formatted_chars from whole
"""


def oracle_sql() -> dict[str, str]:
    return {"op6_decontaminate": DECONTAMINATE, "op8_minhash_dedup": NEAR_DUPLICATES, "op9_suffix_dedup": SUFFIXES, "op11_prefix_trie": PREFIX_TRIE, "op13_chat_format": CHAT_FORMAT}
