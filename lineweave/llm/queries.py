"""The operators over their whole tables, with production parameters, and SQL where SQL can say the same."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from lineweave.llm import chat_template, decontamination, html_text, languages, merkle, packing, quality, ranked_search, sharding, simhash, token_counts, top_k, toxicity
from lineweave.llm.common import read

#: Where the public vocabulary files lie.
TOKENIZER, RANKS = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("byte_bpe_50k.tiktoken")


def op1_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_duplicates(read(spark, sf_dir, "documents"))


def op2_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.shards(read(spark, sf_dir, "documents"))


def op3_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    return languages.identify(read(spark, sf_dir, "documents"))


def op4_top_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    return top_k.nearest(read(spark, sf_dir, "embeddings"))


def op5_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.rate(read(spark, sf_dir, "documents"), read(spark, sf_dir, "labels"))


def op6_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.rate(read(spark, sf_dir, "documents"), read(spark, sf_dir, "labels"))


def op7_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts.count_tokens(read(spark, sf_dir, "documents"), RANKS)


def op8_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(read(spark, sf_dir, "documents"), TOKENIZER, RANKS)


def op9_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontamination.report(read(spark, sf_dir, "documents"), read(spark, sf_dir, "benchmark"))


def op10_html_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_text.extract(read(spark, sf_dir, "pages"))


def op11_merkle(spark: SparkSession, sf_dir: str) -> DataFrame:
    return merkle.audited(read(spark, sf_dir, "documents"))


def op12_ranked_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ranked_search.top_documents(read(spark, sf_dir, "documents"), read(spark, sf_dir, "benchmark"))


def op13_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chat_template.digests(read(spark, sf_dir, "conversations"))


def pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    import corpus_pipeline

    return corpus_pipeline.run(spark, sf_dir)


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f
    for f in (
        op1_simhash, op2_sharding, op3_language, op4_top_k, op5_toxicity, op6_quality, op7_token_counts, op8_packing, op9_decontamination, op10_html_text,
        op11_merkle, op12_ranked_search, op13_chat_format, pipeline,
    )
}

SQL: dict[str, str] = {
    "op4_top_k": """
with v as (
    select vec_id, list_transform(embedding, lambda x: cast(floor(64 * cast(x as double)) as bigint)) as y from embeddings
    where vec_id is not null and embedding is not null and len(list_filter(embedding, lambda x: x is null or not isfinite(x))) = 0
), s as (
    select q.vec_id as query_id, c.vec_id as vec_id, cast(list_dot_product(cast(q.y as double[]), cast(c.y as double[])) as bigint) as score
    from v q join v c on q.vec_id % 20 = 0 and c.vec_id <> q.vec_id and len(q.y) = len(c.y)
)
select query_id, cast(row_number() over (partition by query_id order by score desc, vec_id) as integer) as rank, vec_id, score
from s qualify rank <= 20
""",
    "op9_decontamination": r"""
with low as (
    select doc_id, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') as t from documents
), d as (
    select row_number() over () as row, doc_id, list_filter(regexp_split_to_array(t, '[\x00-\x2F\x3A-\x60\x7B-\x7F]+'), lambda w: w <> '') as words from low
), b as (
    select item_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x00-\x2F\x3A-\x60\x7B-\x7F]+'), lambda w: w <> '') as words from benchmark
), bw as (
    select item_id, least(len(words), 10) as size, unnest(range(1, len(words) - least(len(words), 10) + 2)) as p, words from b where len(words) > 0
), g as (
    select size, list_aggregate(list_slice(words, p, p + size - 1), 'string_agg', ' ') as gram, item_id from bw
), dw as (
    select row, z.size, unnest(range(1, len(words) - z.size + 2)) as p, words from d, (select distinct size from g) z where len(words) >= z.size
), w as (
    select row, size, p, list_aggregate(list_slice(words, p, p + size - 1), 'string_agg', ' ') as gram from dw
), m as (
    select w.row, w.p, w.size, g.item_id from w join g on w.gram = g.gram
), hit as (
    select row, count(distinct pos) as n_hit from (select row, unnest(range(p, p + size)) as pos from m) group by row
), it as (
    select row, count(*) as n_items, string_agg(i, ',' order by i) as ids from (select distinct row, cast(item_id as varchar) as i from m where item_id is not null) group by row
)
select d.doc_id, cast(len(d.words) as bigint) as n_words, coalesce(n_hit, 0) as n_hit, coalesce(n_items, 0) as n_items,
    sha256(coalesce(ids, '')) as items_sha256, coalesce(n_hit, 0) > 0 as contaminated
from d left join hit using (row) left join it using (row)
""",
    "op11_merkle": r"""
with recursive table_ as (
    select list(list_reduce([c, 0, 0, 0, 0, 0, 0, 0, 0], lambda a, x: case when a & 1 = 1 then xor(a >> 1, 3988292384) else a >> 1 end) order by c) as t from range(256) r(c)
), d as (
    select row_number() over () as row, doc_id, lang,
        coalesce(strlen(cast(doc_id as varchar)) || ':' || cast(doc_id as varchar), '-') || coalesce(strlen(source) || ':' || source, '-')
            || coalesce(strlen(lang) || ':' || lang, '-') || coalesce(strlen(cast(n_chars as varchar)) || ':' || cast(n_chars as varchar), '-') as head,
        text, translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') as low,
        coalesce(xor(list_reduce(list_concat([4294967295], list_transform(string_split(cast(doc_id as varchar), ''), lambda c: cast(ascii(c) as bigint))),
            lambda a, x: xor(t[(xor(a, x) & 255) + 1], a >> 8)), 4294967295) % 3 = 0, false) as tampered
    from documents, table_
), leaf as (
    select *, sha256(head || coalesce(strlen(text) || ':' || text, '-')) as hash, sha256(head || coalesce(strlen(low) || ':' || low, '-')) as low_hash from d
), placed as (
    select row, doc_id, hash, case when tampered then low_hash else hash end as given, dense_rank() over (order by lang nulls first) - 1 as tree,
        row_number() over (partition by lang order by doc_id nulls first, hash) - 1 as pos, count(*) over (partition by lang) as n
    from leaf
), nodes as (
    select tree, 0 as level, pos, hash, n from placed
    union all
    select tree, level + 1, pos // 8, sha256(string_agg(hash, '' order by pos)), (n + 7) // 8 from nodes where n > 1 group by tree, level, pos // 8, n
), subroots as (
    select tree, hash from nodes where n = 1
), tops as (
    select 0 as level, tree as pos, hash, (select count(*) from subroots) as n from subroots
    union all
    select level + 1, pos // 8, sha256(string_agg(hash, '' order by pos)), (n + 7) // 8 from tops where n > 1 group by level, pos // 8, n
), runs as (
    select tree, level, pos // 8 as up, list(hash order by pos) as children from nodes where n > 1 group by tree, level, pos // 8
), top_runs as (
    select level, pos // 8 as up, list(hash order by pos) as children from tops where n > 1 group by level, pos // 8
), climb as (
    select row, tree, 0 as level, pos, given as hash, '' as proof, n from placed
    union all
    select c.row, c.tree, c.level + 1, c.pos // 8,
        sha256(list_aggregate(list_transform(children, lambda h, i: case when i = c.pos % 8 + 1 then c.hash else h end), 'string_agg', '')),
        c.proof || coalesce(list_aggregate(list_concat(children[1:c.pos % 8], children[c.pos % 8 + 2:]), 'string_agg', ''), ''), (c.n + 7) // 8
    from climb c join runs r on r.tree = c.tree and r.level = c.level and r.up = c.pos // 8
), ascent as (
    select row, 0 as level, tree as pos, hash, proof, (select count(*) from subroots) as n from climb where n = 1
    union all
    select c.row, c.level + 1, c.pos // 8,
        sha256(list_aggregate(list_transform(children, lambda h, i: case when i = c.pos % 8 + 1 then c.hash else h end), 'string_agg', '')),
        c.proof || coalesce(list_aggregate(list_concat(children[1:c.pos % 8], children[c.pos % 8 + 2:]), 'string_agg', ''), ''), (c.n + 7) // 8
    from ascent c join top_runs r on r.level = c.level and r.up = c.pos // 8
)
select p.doc_id, p.hash as leaf, s.hash as subroot, o.hash as root, sha256(a.proof) as proof_sha256, a.hash as folded_root, a.hash = o.hash as verified
from placed p join ascent a on a.row = p.row and a.n = 1 join subroots s on s.tree = p.tree join tops o on o.n = 1
""",
    "op12_ranked_search": r"""
with d as (
    select row_number() over () as row, doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
        '[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+'), lambda w: w <> '') as words from documents
), total as (
    select count(*) as docs, cast(sum(len(words)) as bigint) as terms from d where len(words) > 0
), tf as (
    select row, term, count(*) as tf from (select row, unnest(words) as term from d) group by row, term
), w as (
    select term, cast(floor(1000 * ln((2 * docs + 2) / (2 * count(*) + 1))) as bigint) as w from tf, total group by term, docs
), item as (
    select distinct item, item_id, term from (
        select row_number() over () as item, item_id, unnest(list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ',
            'abcdefghijklmnopqrstuvwxyz'), '[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+'), lambda w: w <> '')) as term from benchmark)
), s as (
    select item, item_id, d.row, doc_id, cast(sum(w * ((1000000000 * tf) // (1000 * tf + 8 * (100 - 90 + ((90 * len(words) * docs) // total.terms))))) as bigint) as score
    from item join tf using (term) join w using (term) join d on d.row = tf.row, total group by item, item_id, d.row, doc_id
)
select item_id, cast(row_number() over (partition by item order by score desc, doc_id nulls last) as integer) as rank, doc_id, score from s where score > 0 qualify rank <= 10
""",
    "op13_chat_format": r"""
with c as (
    select false as made, conv_id, turn, coalesce(role, '') as role, coalesce(text, '') as text from conversations
    union all select true, -7, 0, 'user', '\### Assistant: </turn> ok' union all select true, -7, 1, 'assistant', '\### Assistant: </turn> ok'
), marked as (
    select *, length(text) - length(replace(text, '\', '')) + length(text) - length(replace(text, '#', '')) - len(regexp_extract_all(text, '#+')) + (length(text) - length(replace(text, '</', ''))) // 2
        + length(role) - length(replace(role, '\', '')) + length(role) - length(replace(role, '#', '')) - len(regexp_extract_all(role, '#+')) + (length(role) - length(replace(role, '</', ''))) // 2
        + length(role) - length(replace(role, ':', '')) as marks from c
)
select conv_id, count(*) as n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' order by turn nulls first, role, text)) as turns_sha256,
    cast(coalesce(sum(length(text)) filter (role = 'assistant'), 0) as bigint) as loss_chars,
    sha256(coalesce(string_agg(text, '' order by turn nulls first, role, text) filter (role = 'assistant'), '')) as loss_sha256,
    cast(sum(length(text) + length(role) + marks + 4 + 2 + 8) as bigint) as formatted_chars
from marked group by made, conv_id
""",
}
