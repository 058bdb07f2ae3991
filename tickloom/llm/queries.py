"""The registered queries of this subpackage, over whole tables, and their SQL where SQL can say it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tickloom.llm.common import table


def op1_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tickloom.llm.ngram_join import ngram_join

    return ngram_join(table(spark, sf_dir, "documents"), size=3, num=90, den=100)


def op2_topk_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tickloom.llm.topk_search import top_k

    return top_k(table(spark, sf_dir, "embeddings"))


def op3_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tickloom.llm.secret_scan import scan_secrets

    return scan_secrets(table(spark, sf_dir, "documents"))


def op4_token_count(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    from tickloom.llm.token_count import count_tokens

    return count_tokens(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"))


def op5_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tickloom.llm.url_filter import judge_urls

    return judge_urls(table(spark, sf_dir, "pages"))


def op6_lm_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tickloom.llm.lm_score import score_texts

    return score_texts(table(spark, sf_dir, "documents"))


def op7_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tickloom.llm.quality_rules import quality_verdicts

    good = table(spark, sf_dir, "labels").where("quality = 1").select("doc_id")
    return quality_verdicts(table(spark, sf_dir, "documents"), good)


def op8_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tickloom.llm.sharding import shard_by_splitters

    out = shard_by_splitters(table(spark, sf_dir, "documents"), 40)
    return out.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))


def op9_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    from tickloom.llm.packing import pack_documents

    return pack_documents(table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"))


def op10_mix_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tickloom.llm.mixing import mix_sources

    return mix_sources(table(spark, sf_dir, "documents"), [3, 1, 2]).drop("source", "text_hash", "key", "epochs")


def op11_ranked_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tickloom.llm.ranked_search import ranked_search

    return ranked_search(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op12_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tickloom.llm.fingerprints import fingerprint_edits

    return fingerprint_edits(table(spark, sf_dir, "documents"))


def op13_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tickloom.llm.prefix_trie import prefix_trie

    return prefix_trie(table(spark, sf_dir, "conversations"))


OP1_SQL = r"""
with recursive docs as (
  select doc_id, list_filter(regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+'), lambda x: x != '') as w
  from documents),
tokens as (
  select distinct doc_id, unnest(case when len(w) = 0 then [] when len(w) < 3 then [array_to_string(w, ' ')]
    else list_transform(range(1, len(w) - 1), lambda i: w[i] || ' ' || w[i + 1] || ' ' || w[i + 2]) end) as token from docs),
sizes as (select doc_id, count(*) as n from tokens group by doc_id),
shared as (
  select a.doc_id as a, b.doc_id as b, count(*) as c from tokens a join tokens b on a.token = b.token and a.doc_id != b.doc_id group by a.doc_id, b.doc_id),
links as (
  select a, b from shared join sizes x on x.doc_id = a join sizes y on y.doc_id = b where 100 * c >= 90 * (x.n + y.n - c)),
reach(doc_id, other) as (
  select doc_id, doc_id from docs union select r.doc_id, l.b from reach r join links l on l.a = r.other)
select d.doc_id, cast(coalesce(s.n, 0) as bigint) as n_shingles, r.component_id
from docs d left join sizes s using (doc_id) join (select doc_id, min(other) as component_id from reach group by doc_id) r using (doc_id)
"""

OP2_SQL = """
with rows_ as (
  select vec_id, list_transform(embedding, lambda x: cast(floor(256 * x::double) as bigint)) as v from embeddings
  where embedding is not null and len(list_filter(embedding, lambda x: x is null or not isfinite(x))) = 0),
scores as (
  select q.vec_id as query_id, r.vec_id, cast(list_sum(list_transform(list_zip(q.v, r.v), lambda p: p[1] * p[2])) as bigint) as score
  from rows_ q join rows_ r on q.vec_id != r.vec_id where q.vec_id % 50 = 0),
ranked as (select *, cast(row_number() over (partition by query_id order by score desc, vec_id) as int) as rank from scores)
select query_id, rank, vec_id, score from ranked where rank <= 5
"""

OP5_SQL = r"""
with parts as (
  select page_id, case when url is null or position('://' in url) = 0 then '' else substr(url, position('://' in url) + 3) end as rest from pages),
urls as (
  select page_id, translate(regexp_extract(rest, '^[^/?#]*', 0), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') as host,
    regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) as path from parts),
rules(h, p, v) as (values ('com', '/en/', 'block'), ('example.com', '/en/7', 'allow'), ('net', '/de/', 'block'), ('example.net', '/de/8', 'block'), ('org', '/es/', 'block')),
best as (
  select page_id, host, path, max(case when host = h or ends_with(host, '.' || h) then case when starts_with(path, p) then row(length(h || p), h || p, v) end end) as b
  from (select distinct page_id, host, path from urls) cross join rules group by all)
select u.page_id, u.host, u.path, b[2] as rule,
  coalesce(b[3], case when regexp_matches(u.host || u.path, '^([^/]*[.-])?(adult|ads|adserver|bet|bets|betting|casino|gambling|lottery|pills|poker|porn|slots|spam|viagra|xxx)([.-]|/|$)')
    then 'block' else 'allow' end) as verdict
from urls u join best on u.page_id is not distinct from best.page_id and u.host = best.host and u.path = best.path
"""

OP10_SQL = r"""
with rows_ as (
  select doc_id, source, cast(len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) as bigint) as size,
    md5(coalesce(cast(doc_id as varchar), '')) as key from documents),
sources as (
  select source, cast(sum(size) as bigint) as source_size,
    ([3.0, 1.0, 2.0]::double[])[(row_number() over (order by source nulls last) - 1) % 3 + 1] as w from rows_ group by source),
caps as (select *, 2.0::double * source_size as cap, 2.0::double * source_size / w as ratio from sources),
levels as (
  select *, (1.5::double * sum(source_size) over () - coalesce(sum(cap) over (order by ratio, source nulls last rows between unbounded preceding and 1 preceding), 0))
    / (sum(w) over () - coalesce(sum(w) over (order by ratio, source nulls last rows between unbounded preceding and 1 preceding), 0)) as level from caps),
targets as (
  select source, source_size, least(cap, coalesce(max(case when level <= ratio then level end) over () * w, cap)) as target from levels),
placed as (
  select r.doc_id, r.size, t.source_size, t.target, cast(floor(t.target) as bigint) as budget,
    cast(sum(r.size) over (partition by r.source order by r.key, r.doc_id, r.size rows unbounded preceding) as bigint) - r.size as b
  from rows_ r join targets t on r.source is not distinct from t.source),
cut as (select *, case when source_size > 0 then budget // source_size else 0 end as epochs from placed)
select doc_id, size, source_size, target,
  cast(epochs * size + least(size, greatest(0, budget - epochs * source_size - b)) as bigint) as taken from cut
"""


OP11_SQL = r"""
with docs as (
  select row_number() over () as r, doc_id, list_filter(regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
    '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+'), lambda x: x != '') as w from documents),
corpus as (select count(*) as n_docs, cast(sum(len(w)) as bigint) as n_terms from docs where len(w) > 0),
asked as (
  select distinct item_id, unnest(regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
    '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) as term from benchmark where item_id is not null),
tfs as (
  select r, doc_id, n, term, count(*) as tf from (select r, doc_id, len(w) as n, unnest(w) as term from docs) where term in (select term from asked) group by all),
weights as (
  select term, cast(floor(1000 * ln((2 * any_value(n_docs) + 2) / (2 * count(*) + 1))) as bigint) as w from tfs cross join corpus group by term),
scores as (
  select item_id, r, doc_id, cast(sum(w * ((1000000000 * tf) // (1000 * tf + 20 * (50 + (50 * n * n_docs) // n_terms)))) as bigint) as score
  from asked join tfs using (term) join weights using (term) cross join corpus group by item_id, r, doc_id),
ranked as (select *, cast(row_number() over (partition by item_id order by score desc, doc_id nulls last) as int) as rank from scores where score > 0)
select item_id, rank, doc_id, score from ranked where rank <= 50
"""

OP13_SQL = r"""
with rows_ as (
  select conv_id, turn, coalesce(role, '') as role, coalesce(text, '') as text from conversations where conv_id is not null),
turns as (
  select conv_id, row_number() over (partition by conv_id order by turn nulls first, role || ' ' || md5(text)) as pos, sha256(length(role) || ':' || role || text) as key,
    len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')) as words from rows_),
ids as (
  select conv_id, n, conv_id - conv_id % 20 as base, xor(crc, 4294967295) % 4 as h from (
    select conv_id, count(*) as n, list_reduce(list_prepend(4294967295::bigint, list_transform(string_split(conv_id::varchar, ''), lambda d: ascii(d)::bigint)),
      lambda c, b: list_reduce(list_prepend(xor(c, b), [0, 0, 0, 0, 0, 0, 0, 0]::bigint[]), lambda x, y: xor(x >> 1, 3988292384 * (x & 1)))) as crc
    from turns group by conv_id)),
rebuilt as (
  select i.conv_id, t.pos, t.key, t.words from ids i join turns t on t.conv_id = i.base and t.pos <= i.h
  union all
  select i.conv_id, t.pos - i.h + least(i.h, coalesce(b.n, 0)), t.key, t.words from ids i join turns t on t.conv_id = i.conv_id and t.pos > i.h left join ids b on b.conv_id = i.base),
paths as (
  select conv_id, 0 as depth, '' as node, null as above, 0 as words from ids
  union all
  select conv_id, depth, node, coalesce(lag(node) over (partition by conv_id order by depth), ''), words
  from (select conv_id, pos as depth, md5(string_agg(key, ',') over (partition by conv_id order by pos)) as node, words from rebuilt)),
children as (select above as node, count(distinct node) as n_children from paths where depth > 0 group by above),
nodes as (
  select depth, node, any_value(above) as above, min(conv_id) as conv_id, count(*) as n_convs, any_value(words) as words, coalesce(any_value(n_children), 0) as n_children
  from paths left join children using (node) group by depth, node),
below as (
  select p.node, sum((u.n_convs - 1) * u.words) as saved, count_if(u.n_children = 0) as leaves
  from nodes u join paths p on p.conv_id = u.conv_id and p.depth <= u.depth group by p.node),
ends as (
  select node, sha256(string_agg(conv_id::varchar, ',' order by conv_id)) as ends
  from (select *, max(depth) over (partition by conv_id) as last from paths) where depth = last group by node)
select n.conv_id, cast(n.depth as bigint) as depth, a.conv_id as parent_conv_id, n.n_convs, n.n_children, cast(b.leaves as bigint) as n_leaves,
  cast(b.saved as bigint) as saved_tokens, coalesce(e.ends, sha256('')) as ends_sha256
from nodes n join below b using (node) left join ends e using (node) left join nodes a on a.node = n.above
"""


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        "op1_ngram_join": op1_ngram_join,
        "op2_topk_search": op2_topk_search,
        "op3_secret_scan": op3_secret_scan,
        "op4_token_count": op4_token_count,
        "op5_url_filter": op5_url_filter,
        "op6_lm_score": op6_lm_score,
        "op7_quality_rules": op7_quality_rules,
        "op8_sharding": op8_sharding,
        "op9_packing": op9_packing,
        "op10_mix_sources": op10_mix_sources,
        "op11_ranked_search": op11_ranked_search,
        "op12_fingerprints": op12_fingerprints,
        "op13_prefix_trie": op13_prefix_trie,
    }


def oracle_sql() -> dict[str, str]:
    return {"op1_ngram_join": OP1_SQL, "op2_topk_search": OP2_SQL, "op5_url_filter": OP5_SQL, "op10_mix_sources": OP10_SQL, "op11_ranked_search": OP11_SQL, "op13_prefix_trie": OP13_SQL}
