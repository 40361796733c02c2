"""The operators of this subpackage as queries over the standard tables, and their SQL where SQL can express them."""

from __future__ import annotations

import corpus_pipeline
import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from rowscrub.llm.chat import conversations, parroted, preference_pairs
from rowscrub.llm.fmindex import decontaminated
from rowscrub.llm.langid import language_id
from rowscrub.llm.licenses import license_scan
from rowscrub.llm.neardup import near_duplicates
from rowscrub.llm.packing import pack_documents
from rowscrub.llm.parsing import removed_strings
from rowscrub.llm.pieces import encoded_pieces
from rowscrub.llm.quality import quality_outliers
from rowscrub.llm.substrings import removed_words
from rowscrub.llm.tokens import prefix_token_counts
from rowscrub.llm.turntrie import conversation_trie
from rowscrub.llm.whitening import whitened_embeddings

TOKENIZER = "byte_bpe_50k.json"
PIECES = "piece_bpe_32k.model"


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack_documents(_table(spark, sf_dir, "documents"), public_tokenizers.path(TOKENIZER))


def op2_preference_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every conversation against a version of it whose last reply repeats the turn before; the table has no preferences."""
    chosen = conversations(_table(spark, sf_dir, "conversations"))
    return preference_pairs(chosen.withColumn("rejected", parroted(F.col("chosen"))))


def op3_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return license_scan(_table(spark, sf_dir, "documents")).drop("spans")


def op4_quality_outliers(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_outliers(_table(spark, sf_dir, "documents"))


def op5_prefix_free_parsing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return removed_strings(_table(spark, sf_dir, "documents"), keep_bytes=False).drop("kept")


def op6_fm_index_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = decontaminated(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"), keep_text=False)
    return found.drop("spans", "kept")


def op7_difference_cover_substrings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return removed_words(_table(spark, sf_dir, "documents"), keep_text=False).drop("kept")


def op8_weighted_near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(_table(spark, sf_dir, "documents"))


def op9_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return language_id(_table(spark, sf_dir, "documents"))


def op10_prefix_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return prefix_token_counts(_table(spark, sf_dir, "documents"), public_tokenizers.path(TOKENIZER), keep_prefixes=False)


def op11_offset_pieces(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = encoded_pieces(_table(spark, sf_dir, "documents"), public_tokenizers.path(PIECES), keep_pieces=False)
    return found.drop("ids", "starts", "ends", "decoded")


def op12_jacobi_davidson_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    return whitened_embeddings(_table(spark, sf_dir, "embeddings"))


def op13_conversation_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    return conversation_trie(_table(spark, sf_dir, "conversations"))


OPERATORS = (
    op1_best_fit_packing,
    op2_preference_pairs,
    op3_license_scan,
    op4_quality_outliers,
    op5_prefix_free_parsing,
    op6_fm_index_decontamination,
    op7_difference_cover_substrings,
    op8_weighted_near_duplicates,
    op9_language_id,
    op10_prefix_token_counts,
    op11_offset_pieces,
    op12_jacobi_davidson_whitening,
    op13_conversation_trie,
)

QUERIES = {f.__name__: f for f in OPERATORS} | {"pipeline": corpus_pipeline.run}

PREFERENCE_SQL = """
with placed as (
    select conv_id, coalesce(role, '') as role, coalesce(text, '') as text,
           row_number() over (partition by conv_id order by turn nulls first, coalesce(role, ''), coalesce(text, '')) as place
    from conversations
), ends as (
    select conv_id, max(place) filter (role = 'assistant') as last from placed group by conv_id
), sides as (
    select p.conv_id, p.role, p.text, p.place,
           case when p.place = e.last then coalesce(lag(p.text) over (partition by p.conv_id order by p.place), '') else p.text end as worse
    from placed p left join ends e on p.conv_id is not distinct from e.conv_id
), cuts as (
    select conv_id, coalesce(min(place) filter (text <> worse), max(place) + 1) as cut from sides group by conv_id
), shown as (
    select s.conv_id, s.place, c.cut,
           '<|' || s.role || '|>' || chr(10) || s.text || '<|end|>' || chr(10) as good,
           '<|' || s.role || '|>' || chr(10) || s.worse || '<|end|>' || chr(10) as bad,
           (length(s.role) + 5)::varchar || ':0,' || length(s.text)::varchar
               || case when s.role = 'assistant' then ':1,' else ':0,' end || '8:0' as good_mask,
           (length(s.role) + 5)::varchar || ':0,' || length(s.worse)::varchar
               || case when s.role = 'assistant' then ':1,' else ':0,' end || '8:0' as bad_mask
    from sides s join cuts c on s.conv_id is not distinct from c.conv_id
)
select conv_id, max(cut) - 1 as n_common,
       coalesce(string_agg(good, '' order by place) filter (place < cut), '') as prompt,
       coalesce(string_agg(good, '' order by place) filter (place >= cut), '') as chosen,
       coalesce(string_agg(good_mask, ',' order by place) filter (place >= cut), '') as chosen_mask,
       coalesce(string_agg(bad, '' order by place) filter (place >= cut), '') as rejected,
       coalesce(string_agg(bad_mask, ',' order by place) filter (place >= cut), '') as rejected_mask
from shown group by conv_id
"""

DECONTAMINATION_SQL = r"""
with lowered as (
    select doc_id, coalesce(regexp_extract_all(
        translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+'), []) as ws
    from documents
), item as (
    select coalesce(item_id::varchar, 'null') as item, regexp_extract_all(
        translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') as ws
    from benchmark
), phrase as (
    select distinct item, least(len(ws), 10) as n, array_to_string(list_slice(ws, i, i + 9), ' ') as k
    from (select item, ws, unnest(range(1, greatest(len(ws) - 9, 1) + 1)) as i from item where len(ws) > 0)
), size as (
    select distinct n from phrase
), place as (
    select doc_id, i, n, array_to_string(list_slice(ws, i, i + n - 1), ' ') as k
    from (select doc_id, ws, n, unnest(range(1, len(ws) - n + 2)) as i from lowered, size where len(ws) >= n)
), hit as (
    select p.doc_id, p.i, p.n, q.item from place p join phrase q on p.n = q.n and p.k = q.k
), word as (
    select doc_id, count(distinct i + o) as n_hit from (select doc_id, i, unnest(range(0, n)) as o from hit) group by doc_id
), found as (
    select doc_id, count(*) as n_items, string_agg(item, ',' order by item) as items
    from (select distinct doc_id, item from hit) group by doc_id
)
select l.doc_id, len(l.ws)::bigint as n_words, coalesce(w.n_hit, 0)::bigint as n_hit, coalesce(f.n_items, 0)::bigint as n_items,
       sha256(coalesce(f.items, '')) as items_sha256, w.n_hit is not null as contaminated
from lowered l left join word w using (doc_id) left join found f using (doc_id)
"""

STRINGS_SQL = """
with whole as (
    select doc_id, hex(encode(coalesce(text, ''))) as h from documents
), block as (
    select doc_id, base, substr(h, 2 * base + 1, 2198) as part
    from (select doc_id, h, unnest(range(0, length(h) // 2 - 99, 1000)) as base from whole where length(h) >= 200)
), piece as (
    select doc_id, base + i as i, substr(part, 2 * i + 1, 200) as k
    from (select doc_id, base, part, unnest(range(0, least(length(part) // 2 - 99, 1000))) as i from block)
), first as (
    select k, min(doc_id::hugeint * 4294967296 + i) as place from piece group by k having count(*) > 1
), again as (
    select p.doc_id, p.i from piece p join first f on p.k = f.k where p.doc_id::hugeint * 4294967296 + p.i > f.place
), marked as (
    select doc_id, i, case when i - lag(i) over (partition by doc_id order by i) <= 100 then 0 else 1 end as opens from again
), span as (
    select doc_id, run, min(i) as a, max(i) + 100 as b
    from (select doc_id, i, sum(opens) over (partition by doc_id order by i) as run from marked) group by doc_id, run
), gap as (
    select doc_id, a, b, coalesce(lag(b) over (partition by doc_id order by a), 0) as before from span
), kept as (
    select g.doc_id, count(*) as n_spans, sum(b - a) as n_removed,
           string_agg(substr(h, (2 * before + 1)::bigint, (2 * (a - before))::bigint), '' order by a) || substr(any_value(h), (2 * max(b) + 1)::bigint) as rest
    from gap g join whole w using (doc_id) group by g.doc_id
)
select w.doc_id, length(h)::bigint // 2 as n_bytes, coalesce(n_removed, 0)::bigint as n_removed, coalesce(n_spans, 0)::bigint as n_spans,
       sha256(unhex(coalesce(rest, h))) as kept_sha256
from whole w left join kept k using (doc_id)
"""

SUBSTRING_SQL = r"""
with split as (
    select doc_id, coalesce(regexp_extract_all(text, '[^\x20\x09-\x0D]+'), []) as ws from documents
), piece as (
    select doc_id, i, array_to_string(list_slice(ws, i, i + 12), ' ') as k
    from (select doc_id, ws, unnest(range(1, len(ws) - 11)) as i from split where len(ws) >= 13)
), first as (
    select k, min(doc_id) as least from piece group by k
), gone as (
    select distinct doc_id, i + o as place
    from (select p.doc_id, p.i, unnest(range(0, 13)) as o from piece p join first f on p.k = f.k and f.least < p.doc_id)
), word as (
    select doc_id, unnest(ws) as w, generate_subscripts(ws, 1) as place from split
), kept as (
    select w.doc_id, count(g.place) as n_removed, string_agg(w.w, ' ' order by w.place) filter (g.place is null) as text
    from word w left join gone g on w.doc_id = g.doc_id and w.place = g.place group by w.doc_id
)
select s.doc_id, len(s.ws)::bigint as n_words, coalesce(k.n_removed, 0)::bigint as n_removed, sha256(coalesce(k.text, '')) as kept_sha256
from split s left join kept k using (doc_id)
"""

TRIE_SQL = r"""
with source as (
    select conv_id, turn, coalesce(role, '') as role, coalesce(text, '') as text, md5(strlen(coalesce(role, ''))::varchar || ':' || coalesce(role, '') || coalesce(text, '')) as code
    from conversations where conv_id is not null
), placed as (
    select conv_id, row_number() over (partition by conv_id order by turn nulls first, code) as place, code,
           len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')) as words
    from source
), conv as (
    select conv_id, conv_id - conv_id % 20 as block,
           xor(list_reduce(list_prepend(4294967295, list_transform(string_split(conv_id::varchar, ''), lambda c: ascii(c)::bigint)),
               lambda crc, byte: list_reduce([xor(crc, byte), 0, 0, 0, 0, 0, 0, 0, 0],
                   lambda x, z: xor(x >> 1, 3988292384 * (x & 1)))), 4294967295) % 4 as h
    from (select distinct conv_id from source)
), turns as (
    select c.conv_id, p.place, p.code, p.words from conv c join placed p on p.conv_id = c.block and p.place <= c.h
    union all
    select c.conv_id, p.place, p.code, p.words from conv c join placed p on p.conv_id = c.conv_id and p.place > c.h
), paths as (
    select c.conv_id, coalesce(list(t.code order by t.place) filter (t.code is not null), []) as path,
           coalesce(list(t.words order by t.place) filter (t.code is not null), []) as words
    from conv c left join turns t using (conv_id) group by c.conv_id
), member as (
    select conv_id, d, list_slice(path, 1, d) as prefix, case when d = 0 then 0 else words[d] end as words, d = len(path) as ends
    from (select *, unnest(range(0, len(path) + 1)) as d from paths)
), node as (
    select prefix, d, min(conv_id) as conv_id, count(*) as n_convs, max(words) as words,
           coalesce(string_agg(conv_id::varchar, ',' order by conv_id) filter (ends), '') as ids
    from member group by prefix, d
), child as (
    select list_slice(prefix, 1, d - 1) as prefix, count(*) as n_children from node where d > 0 group by 1
), weighed as (
    select n.*, coalesce(c.n_children, 0) as n_children, case when c.n_children is null then 1 else 0 end as leaf, (n_convs - 1) * words as saved
    from node n left join child c using (prefix)
), subtree as (
    select list_slice(prefix, 1, a) as prefix, sum(leaf) as n_leaves, sum(saved) as saved_tokens
    from (select prefix, leaf, saved, unnest(range(0, d + 1)) as a from weighed) group by 1
)
select w.conv_id, w.d::bigint as depth, p.conv_id as parent_conv_id, w.n_convs::bigint as n_convs, w.n_children::bigint as n_children,
       s.n_leaves::bigint as n_leaves, s.saved_tokens::bigint as saved_tokens, sha256(w.ids) as ends_sha256
from weighed w join subtree s using (prefix) left join node p on w.d > 0 and p.prefix = list_slice(w.prefix, 1, w.d - 1)
"""

ORACLES: dict[str, str] = {
    "op2_preference_pairs": PREFERENCE_SQL,
    "op5_prefix_free_parsing": STRINGS_SQL,
    "op6_fm_index_decontamination": DECONTAMINATION_SQL,
    "op7_difference_cover_substrings": SUBSTRING_SQL,
    "op13_conversation_trie": TRIE_SQL,
}
