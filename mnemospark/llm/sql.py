"""SQL that gives the same rows as some of the queries, for DuckDB."""

_TOKENS = r"len(regexp_extract_all({0}, '[\p{{L}}\p{{N}}_]+|[^\p{{L}}\p{{N}}_\p{{Z}}\t-\r\x1c-\x1f\x85]+'))"
_TOTAL = _TOKENS.format("text")
_LONGEST = r"list_max(list_transform(regexp_split_to_array({0}, '[\p{{Z}}\t-\r\x1c-\x1f\x85.!?。！？]'), lambda x: length(x)))"

_VECTORS = """{0} as (select key, v from (select {2} key, embedding::double[] v from {1}) where len(v) = 64 and list_sum(list_transform(v, lambda x: abs(x))) > 0 group by all)"""
_PAIRS = """select '{1}' collection, a.key key_a, b.key key_b from {0} a join {0} b on a.key < b.key where list_cosine_similarity(a.v, b.v) >= 0.9"""

ORACLES = {
    "p3_found": "with "
    + ", ".join([_VECTORS.format("q", "fake_queries", "query_id"), _VECTORS.format("c", "content_chunks", "memory_id || '#' || chunk_index"), _VECTORS.format("p", "paragraphs", "memory_id || '#' || paragraph_index")])
    + " union all ".join(["", _PAIRS.format("q", "fake_queries"), _PAIRS.format("c", "content_chunks"), _PAIRS.format("p", "paragraphs")]).replace(" union all ", " ", 1),
    "p4_found": f"""
select distinct 'session_text' field_name, memory_id record_key, case when {_LONGEST.format("session_text")} > 4000 then 'forced' else 'natural' end cut
from memories where length(session_text) > 4000
union all
select distinct 'paragraph', memory_id || '#' || paragraph_index, case when {_LONGEST.format("text")} > 500 then 'forced' else 'natural' end
from paragraphs where length(text) > 500""",
    "p4_rebuilt": """
select distinct 'session_text' field_name, memory_id record_key, md5(session_text) text_md5, true within_limits from memories where length(session_text) > 4000
union all select distinct 'paragraph', memory_id || '#' || paragraph_index, md5(text), true from paragraphs where length(text) > 500""",
    "p6_found": f"select distinct doc_id from documents where {_TOTAL} > 2048",
    "p6_documents": f"select doc_id, max(n) n_tokens, greatest(1, cast(ceil(max(n) / 2048.0) as bigint)) n_containers from (select doc_id, {_TOTAL} n from documents) group by 1",
    "p7_reached": f"""
with sizes as (select lower(trim(source)) source, {_TOTAL} n from documents),
have as (select source, sum(n) n from sizes group by source)
select t.source, cast(coalesce(have.n, 0) as bigint) available_tokens, true met, t.max_repeats * coalesce(have.n, 0) >= t.target_share * (select sum(n) from sizes) reachable, true within_repeats
from mix_targets t left join have using (source)""",
    "p7_found": f"""
with sizes as (select lower(trim(source)) source, {_TOTAL} n from documents),
have as (select source, sum(n) n from sizes group by source)
select t.source from mix_targets t left join have using (source)
where t.max_repeats * coalesce(have.n, 0) < t.target_share * (select sum(n) from sizes)""",
}
