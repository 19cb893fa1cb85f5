"""The queries of this subpackage and, where SQL can express them, the same in DuckDB's SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from rollbook.llm import bpe, chat, decontam, htmltext, langid, ledger, media, merkle, ppm, sharding, simhash, substring, whitening


def op1_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chat.report(spark.read.parquet(f"{sf_dir}/conversations.parquet"))


def op2_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return langid.report(spark.read.parquet(f"{sf_dir}/documents.parquet"))


def op3_html_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return htmltext.extract(spark.read.parquet(f"{sf_dir}/pages.parquet"))


def op4_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontam.report(spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def op5_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.report(spark.read.parquet(f"{sf_dir}/documents.parquet"))


def op6_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.digests(spark.read.parquet(f"{sf_dir}/documents.parquet"))


def op7_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = simhash.near_duplicates(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    return found.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def op8_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substring.report(spark.read.parquet(f"{sf_dir}/documents.parquet"))


def op9_ppm_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ppm.scores(spark.read.parquet(f"{sf_dir}/documents.parquet"))


def op10_media_columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    return media.report(spark.read.parquet(f"{sf_dir}/documents.parquet"))


def op11_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    return whitening.report(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))


def op12_secret_ledger(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ledger.report(spark.read.parquet(f"{sf_dir}/documents.parquet"))


def op13_merkle_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return merkle.report(spark.read.parquet(f"{sf_dir}/documents.parquet"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {f.__name__: f for f in (op1_chat_format, op2_language_id, op3_html_text, op4_decontamination, op5_sharding, op6_byte_bpe, op7_simhash, op8_substring_dedup, op9_ppm_scores, op10_media_columns, op11_whitening, op12_secret_ledger, op13_merkle_manifest)}

_OP4_WORDS = "regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+')"

_ASSIGN = "([pP][aA][sS][sS][wW][oO][rR][dD]|[pP][aA][sS][sS][wW][dD]|[sS][eE][cC][rR][eE][tT]|[tT][oO][kK][eE][nN]|[aA][pP][iI]_?[kK][eE][yY])[\"'']?\\x20*[:=]\\x20*[\"'']?([A-Za-z0-9+/_.=-]+)"
_PLAIN = (
    (1, "access", "AKIA[A-Z0-9]+"),
    (2, "hex", "[0-9a-f]+"),
    (3, "pem", "-----BEGIN [A-Z ]{0,40}PRIVATE KEY-----"),
    (4, "hub", "gh[opsu]_[A-Za-z0-9]{36,}"),
    (5, "login", "://[A-Za-z0-9._~-]+:[A-Za-z0-9._~-]+@"),
)

SQL: dict[str, str] = {
    "op4_decontamination": f"""
with d as (select doc_id, {_OP4_WORDS} w from documents),
b as (select item_id, {_OP4_WORDS} w from benchmark),
win as (select item_id, least(len(w), 10) k, list_aggregate(w[i:i + least(len(w), 10) - 1], 'string_agg', ' ') g
        from (select item_id, w, unnest(range(1, len(w) - least(len(w), 10) + 2)) i from b where len(w) > 0)),
sizes as (select distinct k from win),
pos as (select doc_id, i, k, list_aggregate(w[i:i + k - 1], 'string_agg', ' ') g
       from (select doc_id, w, k, unnest(range(1, len(w) - k + 2)) i from d, sizes where len(w) >= k)),
hit as (select distinct doc_id, i, pos.k, item_id from pos join win on pos.k = win.k and pos.g = win.g),
words as (select doc_id, count(distinct p) n_hit from (select doc_id, unnest(range(i, i + k)) p from hit) group by doc_id),
items as (select doc_id, count(*) n_items, string_agg(s, ',' order by s) list
          from (select distinct doc_id, cast(item_id as varchar) s from hit) group by doc_id)
select d.doc_id, cast(len(w) as bigint) n_words, coalesce(n_hit, 0) n_hit, coalesce(n_items, 0) n_items,
       sha256(coalesce(list, '')) items_sha256, coalesce(n_hit, 0) > 0 contaminated
from d left join words using (doc_id) left join items using (doc_id)""",
    "op8_substring_dedup": """
with d as (select doc_id, list_filter(regexp_split_to_array(coalesce(text, ''), '[\\x20\\x09-\\x0D]+'), lambda x: x <> '') w from documents),
win as (select doc_id, i, list_aggregate(w[i:i + 49], 'string_agg', ' ') g from (select doc_id, w, unnest(range(1, len(w) - 48)) i from d where len(w) >= 50)),
least_of as (select g, min(doc_id) a from win group by g),
cut as (select distinct doc_id, unnest(range(i, i + 50)) p from win join least_of using (g) where doc_id > a),
word as (select doc_id, unnest(w) x, unnest(range(1, len(w) + 1)) p from d),
kept as (select doc_id, count(*) n, string_agg(x, ' ' order by p) t from word anti join cut using (doc_id, p) group by doc_id)
select d.doc_id, cast(len(w) as bigint) n_words, len(w) - coalesce(n, 0) n_removed, sha256(coalesce(t, '')) kept_sha256
from d left join kept using (doc_id)""",
    # the shards hang on the key order and the sizes alone; the checksum's table is made by its rule
    "op5_sharding": """
with tab as (select list_transform(range(256), lambda n: list_reduce(list_prepend(n, range(8)),
  lambda c, k: case when c & 1 = 1 then xor(3988292384, c >> 1) else c >> 1 end)) as t),
d as (select doc_id, coalesce(text, '') as text, hex(encode(coalesce(text, ''))) as x from documents),
b as (select doc_id, text, list_transform(regexp_extract_all(x, '..'), lambda x: cast('0x' || x as bigint)) as bytes from d),
k as (select doc_id, cast(len(bytes) + 1 as bigint) as size, cast('0x' || substr(md5(text), 1, 15) as bigint) as h,
  cast(xor(4294967295, list_reduce(list_prepend(4294967295, bytes), lambda c, x: xor(t[(xor(c, x) & 255) + 1], c >> 8))) as bigint) as text_crc32 from b, tab),
o as (select *, sum(size) over (order by h, doc_id nulls first rows unbounded preceding) - size + size // 2 as middle, sum(size) over () as total from k),
s as (select *, cast(middle * 8 // total as int) as shard from o)
select doc_id, size, text_crc32, 'bytes' as law, shard, row_number() over (partition by shard order by h, doc_id nulls first) - 1 as slot,
  cast(null as int) as grown_shard from s""",
    # a match begins where the pieces between matches and the matches before it end
    "op12_secret_ledger": f"""
with rule as (select * from (values
  (0, 'assign', '{_ASSIGN}', 6), (1, 'access', 'AKIA[A-Z0-9]+', 20), (2, 'hex', '[0-9a-f]+', 24),
  (3, 'pem', '-----BEGIN [A-Z ]{{0,40}}PRIVATE KEY-----', 0), (4, 'hub', 'gh[opsu]_[A-Za-z0-9]{{36,}}', 0), (5, 'login', '://[A-Za-z0-9._~-]+:[A-Za-z0-9._~-]+@', 0)) r(rank, kind, pattern, least)),
t as (select doc_id, row_number() over (order by doc_id, text) as row, coalesce(text, '') as text from documents),
m as (
  select row, 0 as rank, 'assign' as kind, regexp_extract_all(text, '{_ASSIGN}') as hits, regexp_extract_all(text, '{_ASSIGN}', 2) as inner_hits, regexp_split_to_array(text, '{_ASSIGN}') as pieces from t
  {"".join(f"union all select row, {k}, '{kind}', regexp_extract_all(text, '{pattern}'), regexp_extract_all(text, '{pattern}'), regexp_split_to_array(text, '{pattern}') from t " for k, kind, pattern in _PLAIN)}),
found_at as (select row, rank, kind, unnest(hits) as hit, unnest(inner_hits) as part, unnest(pieces[:len(hits)]) as piece, unnest(range(1, len(hits) + 1)) as i from m where len(hits) > 0),
span as (select *, sum(length(piece) + length(hit)) over (partition by row, rank order by i) as fin from found_at),
good as (select row, rank, kind, fin - length(hit) as begin_at, kind || ':' || (fin - length(hit)) || ':' || fin as item from span join rule using (rank, kind) where length(part) >= least),
found as (select row, count(*) filter (where rank = 0) as a, count(*) filter (where rank = 1) as k, count(*) filter (where rank = 2) as h,
  string_agg(item, ',' order by begin_at, rank) filter (where rank < 3) as base, string_agg(item, ',' order by begin_at, rank) as whole from good group by row)
select doc_id, coalesce(a, 0) as n_assign, coalesce(k, 0) as n_access, coalesce(h, 0) as n_hex, sha256(coalesce(base, '')) as base_sha256, coalesce(whole, '') as spans
from t left join found using (row)""",
    # levels of each language's tree, then of the tree of subroots, which is language number -1; a proof is climbed level by level
    "op13_merkle_manifest": """
with recursive tab as (select list_transform(range(256), lambda n: list_reduce(list_prepend(n, range(8)),
  lambda c, k: case when c & 1 = 1 then xor(3988292384, c >> 1) else c >> 1 end)) as t),
part as (select doc_id, lang, text, translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') as low,
  coalesce(strlen(cast(doc_id as varchar)) || ':' || doc_id, '-') || coalesce(strlen(source) || ':' || source, '-')
  || coalesce(strlen(lang) || ':' || lang, '-') || coalesce(strlen(cast(n_chars as varchar)) || ':' || n_chars, '-') as before from documents),
crc as (select *, xor(4294967295, list_reduce(list_prepend(4294967295, list_transform(string_split(cast(doc_id as varchar), ''), lambda c: cast(ascii(c) as bigint))),
  lambda c, x: xor(t[(xor(c, x) & 255) + 1], c >> 8))) as crc from part, tab),
hashed as (select doc_id, lang, sha256(before || coalesce(strlen(text) || ':' || text, '-')) as leaf,
  case when crc % 3 = 0 then sha256(before || coalesce(strlen(low) || ':' || low, '-')) end as other from crc),
leaf as (select *, row_number() over (order by lang, doc_id, leaf) as id, dense_rank() over (order by lang nulls first) - 1 as g, row_number() over (partition by lang order by doc_id nulls first, leaf) - 1 as i, count(*) over (partition by lang) as n from hashed),
node as (
  select g, 0 as level, i, leaf as h, n from leaf
  union all
  select g, level + 1, i // 8, sha256(string_agg(h, '' order by i)), max((n + 7) // 8) from node where n > 1 group by g, level, i // 8),
sub as (select g, h from node where n = 1),
crown as (
  select 0 as level, g as i, h, (select count(*) from sub) as n from sub
  union all
  select level + 1, i // 8, sha256(string_agg(h, '' order by i)), max((n + 7) // 8) from crown where n > 1 group by level, i // 8),
run as (
  select g, level, i // 8 as r, list(h order by i) as hs from node where n > 1 group by g, level, i // 8
  union all
  select -1, level, i // 8, list(h order by i) from crown where n > 1 group by level, i // 8),
steps as (select g, max(level) as depth from node group by g),
climb as (
  select id, g, depth, case when depth = 0 then -1 else g end as tree, 0 as level, case when depth = 0 then g else i end as i, coalesce(other, leaf) as h, '' as proof
  from leaf join steps using (g)
  union all
  select id, c.g, depth, case when level_up then -1 else tree end, case when level_up then 0 else level + 1 end, case when level_up then c.g else i // 8 end,
    sha256(array_to_string(hs[:i % 8], '') || h || array_to_string(hs[i % 8 + 2:], '')), proof || array_to_string(hs[:i % 8], '') || array_to_string(hs[i % 8 + 2:], '')
  from (select *, tree >= 0 and level + 1 = depth as level_up from climb) c join (select g as tree, level, r, hs from run) using (tree, level) where r = i // 8),
done as (select * from climb where tree = -1 and level = (select max(level) from crown))
select doc_id, leaf, sub.h as subroot, top.h as root, sha256(proof) as proof_sha256, done.h as folded_root, done.h = top.h as verified
from leaf l join done using (id) join sub on sub.g = l.g, (select h from crown where n = 1) top""",
}
