"""SQL that gives the rows of the core queries, for DuckDB."""

_SUBS = "subs as (select vec_id sub_id, cast(vec_id // 40 as int) request, cast((vec_id // 20) % 2 as int) sq_index, embedding::double[] e from embeddings where vec_id % 20 = 0)"
_FAKE = "fake as (select distinct on (query_id) query_id, memory_id, pos, text, parent_ids, depth, embedding::double[] v from fake_queries)"
_CHUNK = "chunk as (select distinct on (memory_id, chunk_index) memory_id, chunk_index, memory_id || '#' || chunk_index key, embedding::double[] v from content_chunks)"
_PARA = "para as (select distinct on (memory_id, paragraph_index) memory_id, paragraph_index, memory_id || '#' || paragraph_index key, text, embedding::double[] v from paragraphs)"
_SIM = "coalesce(round(list_dot_product({0}, {1}) / nullif(sqrt(list_dot_product({0}, {0})) * sqrt(list_dot_product({1}, {1})), 0), 9), 0.0)"
_S = _SIM.format("s.e", "f.v")
_HITS = f"hits as (select * from (select s.sub_id, s.request, s.sq_index, f.query_id, f.memory_id, f.text, {_S} sim, row_number() over (partition by s.sub_id order by {_S} desc, f.query_id) rk from subs s, fake f where len(f.v) = 64) where rk <= 20)"
_MATCHED = """once as (select * from (select *, row_number() over (partition by request, memory_id, text order by sq_index, rk) o from hits) where o = 1),
subq as (select request, memory_id, string_agg(sq_index::varchar, ',' order by nth) sub_queries from (select request, memory_id, sq_index, min(nth) nth from
  (select *, row_number() over (partition by request, memory_id order by greatest(sim, 0.0) desc, sq_index, rk) nth from once) group by all) group by all)"""
_CAND_INDEX = f"""{_MATCHED}, cand as (select h.*, sub_queries from (select request, memory_id, max(greatest(sim, 0.0)) score_q2q, min(sq_index::bigint * 4294967296 + rk) first_seen, count(distinct text) n_matched
  from hits group by 1, 2) h join subq using (request, memory_id))"""
_Q2C_INDEX = f"q2c as (select c.request, c.memory_id, max(greatest({_SIM.format('s.e', 'k.v')}, 0.0)) q2c from cand c join subs s using (request) join chunk k using (memory_id) where len(k.v) = 64 group by 1, 2)"
_FUSED = """counted as (select *, count(*) over (partition by request) n from cand),
fused as (select request, memory_id, score_q2q, first_seen, n_matched, sub_queries, case when n <= {0} then 0.0 else coalesce(q2c, 0.0) end score_q2c,
  round(case when n <= {0} then score_q2q else 0.7 * score_q2q + 0.3 * coalesce(q2c, 0.0) end, 9) final_score from counted left join q2c using (request, memory_id)),
ranked as (select *, row_number() over (partition by request order by final_score desc, score_q2q desc, first_seen, memory_id) rank from fused),
res as (select * from ranked where rank <= {0})"""
_INDEX = ", ".join([_SUBS, _FAKE, _CHUNK, _HITS, _CAND_INDEX, _Q2C_INDEX])
_OUT = "select request, cast(rank as int) rank, memory_id, round(score_q2q, 6) score_q2q, round(score_q2c, 6) score_q2c, round(final_score, 6) final_score, cast(n_matched as int) n_matched, sub_queries from res"
_MEM = "mem as (select * from (select *, row_number() over (partition by memory_id order by ingested_at desc nulls last) n from memories where memory_id is not null) where n = 1)"

_NODES = """edges as (select distinct query_id child, p parent from (select query_id, unnest(parent_ids) p from fake) where p in (select query_id from fake)),
l0 as (select query_id start_id, query_id node_id, 0 level from fake where len(parent_ids) > 0),
l1 as (select l.start_id, e.parent node_id, 1 level from l0 l join edges e on e.child = l.node_id), l2 as (select l.start_id, e.parent node_id, 2 level from l1 l join edges e on e.child = l.node_id),
nodes as (select start_id, node_id, min(level) level from (select * from l0 union all select * from l1 union all select * from l2) group by all)"""
_CHAINS = f"""{_NODES}, lists as (select n.start_id, string_agg(n.node_id, ',' order by coalesce(f.depth, 0), n.level, n.node_id) nodes from nodes n join fake f on f.query_id = n.node_id group by 1 having count(*) > 1),
chains as (select r.request, r.rank, r.memory_id, l.nodes, row_number() over (partition by r.request, r.memory_id order by greatest(o.sim, 0.0) desc, o.sq_index, o.rk) nth from res r join once o on o.request = r.request and o.memory_id = r.memory_id join lists l on l.start_id = o.query_id)"""

_METHOD = "['q2q','q2p','q2n','q2r','q2c'][vec_id % 5 + 1]"
_BASE = f"""qs as (select vec_id query, embedding::double[] e, label from embeddings where vec_id % 20 = 0),
vec as (select vec_id pos, label session, {_METHOD} method, embedding::double[] v from embeddings),
evidence as (select query, 0 ev_pos, label session from qs union all select query, 1, (label + 3) % 10 from qs),
sims as (select query, pos, session, method, {_SIM.format("e", "v")} sim from qs, vec where query <> pos),
best as (select query, session, method, max(sim) best from sims group by all),
wide as (select query, session, ev_pos, max(best) filter (method = 'q2q') q2q, max(best) filter (method = 'q2p') q2p, max(best) filter (method = 'q2n') q2n, max(best) filter (method = 'q2r') q2r, max(best) filter (method = 'q2c') q2c
  from best join evidence using (query, session) group by all),
aligned as (select query, session, q2q, coalesce(q2p, 0.0) q2p, coalesce(q2n, 0.0) q2n, coalesce(q2r, 0.0) q2r, q2c, q2q - q2c gap
  from (select *, row_number() over (partition by query order by q2q desc, ev_pos) n from wide where q2q is not null and q2c is not null) where n = 1),
long as (select query, session, unnest(['q2q','q2p','q2n','q2r','q2c']) method, unnest([q2q, q2p, q2n, q2r, q2c]) sim from aligned)"""
# the two-sided t test by its finite series in the angle atan(t / sqrt(degrees of freedom)), for even and odd degrees
_T = "(avg(a - b) / (stddev_samp(a - b) / sqrt(count(*))))"
_COS = f"(1 / (1 + {_T} * {_T} / (count(*) - 1)))"
_SERIES = "coalesce(list_sum(list_transform(range(0, cast(floor({0}) as bigint)), lambda j: exp({1}) * pow({2}, {3}))), 0)"
_EVEN = f"abs({_T}) / sqrt(count(*) - 1 + {_T} * {_T}) * " + _SERIES.format("(count(*) - 1) / 2", "lgamma(j + 0.5) - lgamma(j + 1) - lgamma(0.5)", _COS, "j")
_ODD = f"2 / pi() * (atan(abs({_T}) / sqrt(count(*) - 1)) + abs({_T}) / sqrt(count(*) - 1 + {_T} * {_T}) * " + _SERIES.format("(count(*) - 2) / 2", "lgamma(j + 1) - lgamma(j + 1.5) + lgamma(1.5)", _COS, "j + 0.5") + ")"
_P = f"case when count(*) > 1 and stddev_samp(a - b) > 0 then 1 - case when count(*) % 2 = 1 then {_EVEN} else {_ODD} end end"
_PAIRED = f"""count(*) n, round(avg(a), 6) mean_a, round(avg(b), 6) mean_b, round(stddev_pop(a), 6) std_a, round(stddev_pop(b), 6) std_b, round(avg(a - b), 6) gap_mean, round(stddev_pop(a - b), 6) gap_std,
round(median(a - b), 6) gap_median, round(case when stddev_samp(a - b) > 0 then avg(a - b) / (stddev_samp(a - b) / sqrt(count(*))) end, 6) t, round(case when count(*) > 1 then avg(a - b) / (stddev_samp(a - b) + 1e-10) end, 6) cohens_d,
round({_P}, 6) p, cast(sum(case when a - b > 0 then 1 else 0 end) as bigint) wins, cast(sum(case when a - b < 0 then 1 else 0 end) as bigint) losses, cast(sum(case when a - b = 0 then 1 else 0 end) as bigint) ties"""
_UNIT = "list_transform({0}, lambda x: x / (sqrt(list_dot_product({0}, {0})) + 1e-10))"
_MEAN3 = "round(avg({0}), 6) mean, round(stddev_pop({0}), 6) std, round(median({0}), 6) median"
_STYLED = f"""paras as (select vec_id - vec_id % 20 query, cast(vec_id % 20 - 1 as int) style, embedding::double[] e from embeddings where vec_id % 20 between 1 and 5),
styled as (select p.query, v.method, p.style, max({_SIM.format("p.e", "v.v")}) sim from paras p join aligned a using (query) join vec v on v.session = a.session and v.pos <> p.query + p.style + 1 group by all)"""

_SESS = "sess as (select distinct on (session_id) * from sessions where session_id is not null)"
_LINES = "lines as (select session_id, i, coalesce(turns[i].speaker, '') || ': ' || turns[i].text line from (select session_id, turns, unnest(range(1, len(turns) + 1)) i from sess) where trim(turns[i].text) <> '')"

ORACLES = {
    "cosine_pairs": f"select q.vec_id query, p.vec_id, round({_SIM.format('q.embedding::double[]', 'p.embedding::double[]')}, 6) sim from embeddings q, embeddings p where q.vec_id % 20 = 0",
    "cosine_variants": """select q.vec_id query, round(d / (na * nb), 6) guard, round(d / (na * nb + 1e-10), 6) prod, round(d / ((na + 1e-10) * (nb + 1e-10)), 6) "each" from (
select a.vec_id, list_dot_product(a.embedding::double[], b.embedding::double[]) d, sqrt(list_dot_product(a.embedding::double[], a.embedding::double[])) na, sqrt(list_dot_product(b.embedding::double[], b.embedding::double[])) nb
from embeddings a join embeddings b on b.vec_id = a.vec_id + 1 where a.vec_id % 20 = 0) q""",
    "knn_top20": f"with {_SUBS}, {_FAKE}, {_HITS} select sub_id, query_id, round(greatest(sim, 0.0), 6) score, cast(rk as int) rank from hits",
    "content_topk": f"with {_SUBS}, {_CHUNK} select sub_id, key, round(sim, 6) sim, cast(rk as int) rank from (select s.sub_id, f.key, {_S} sim, row_number() over (partition by s.sub_id order by {_S} desc, f.key) rk from subs s, chunk f where len(f.v) = 64) where rk <= 10",
    "best_chunk_per_memory": f"with {_SUBS}, {_CHUNK} select s.request, f.memory_id, round(max(greatest({_S}, 0.0)), 6) score from subs s, chunk f where len(f.v) = 64 group by all",
    "paragraph_topk": f"with {_SUBS}, {_PARA} select sub_id, key, round(sim, 6) sim, cast(rk as int) rank from (select s.sub_id, f.key, {_S} sim, row_number() over (partition by s.sub_id, f.memory_id order by {_S} desc, f.paragraph_index) rk from subs s, para f where len(f.v) = 64) where rk <= 3",
    "threshold_search": f"with {_SUBS}, {_FAKE} select sub_id, query_id, round(sim, 6) sim, cast(rk as int) rank from (select s.sub_id, f.query_id, {_S} sim, row_number() over (partition by s.sub_id order by {_S} desc, f.query_id) rk from subs s, fake f where len(f.v) = 64 and {_S} >= 0.35) where rk <= 50",
    "multiget": f"with {_FAKE} select query_id, memory_id, md5(text) text_md5, coalesce(depth, -1) depth from fake where query_id in (select unnest(parent_ids) from fake)",
    "retrieve_index": f"with {_INDEX}, {_FUSED.format(5)} {_OUT}",
    "rerank_shortcircuit": f"with {_INDEX}, {_FUSED.format(100)} {_OUT}",
    "retrieve_exact": f"""with {_SUBS}, {_FAKE}, {_CHUNK},
per as (select * from (select s.sub_id, s.request, s.sq_index, f.query_id, f.memory_id, f.text, {_S} sim, row_number() over (partition by s.sub_id, f.memory_id order by {_S} desc, f.pos, f.query_id) n from subs s, fake f where len(f.v) = 64) where n = 1),
hits as (select *, 0 rk from per where sim > 0), {_CAND_INDEX},
per_chunk as (select c.request, c.memory_id, s.sub_id, {_SIM.format("s.e", "k.v")} sim, row_number() over (partition by c.request, c.memory_id, s.sub_id order by {_SIM.format("s.e", "k.v")} desc, k.chunk_index) n from cand c join subs s using (request) join chunk k using (memory_id) where len(k.v) = 64),
q2c as (select request, memory_id, max(m) q2c from (select request, memory_id, sub_id, greatest(avg(sim), 0.0) m from per_chunk where n <= 3 group by all) group by all),
{_FUSED.format(5)} {_OUT}""",
    "dag_chains": f"""with {_FAKE}, edges as (select distinct query_id child, p parent from (select query_id, unnest(parent_ids) p from fake) where p in (select query_id from fake)),
l0 as (select query_id start_id, query_id node_id, 0 level from fake where len(parent_ids) > 0),
l1 as (select l.start_id, e.parent node_id, 1 level from l0 l join edges e on e.child = l.node_id), l2 as (select l.start_id, e.parent node_id, 2 level from l1 l join edges e on e.child = l.node_id),
nodes as (select start_id, node_id, min(level) level from (select * from l0 union all select * from l1 union all select * from l2) group by all)
select start_id, node_id, level from nodes where start_id in (select start_id from nodes group by 1 having count(*) > 1)""",
    "low_conf_enrich": f"""with {_INDEX}, {_FUSED.format(5)}, {_PARA}, weak as (select request, rank, memory_id from (select *, max(final_score) over (partition by request) m from res) where m < 0.8),
per as (select w.request, w.rank, w.memory_id, f.text, greatest({_S}, 0.0) sim, row_number() over (partition by w.request, w.memory_id, s.sub_id order by round(greatest({_S}, 0.0), 9) desc, f.paragraph_index) n from weak w join para f using (memory_id) join subs s using (request) where len(f.v) = 64),
best as (select request, rank, memory_id, text, max(sim) score from per where n <= 3 group by all)
select request, cast(rank as int) rank, memory_id, md5(text) text_md5, round(score, 6) score, cast(k as int) paragraph_rank from (select *, row_number() over (partition by request, memory_id order by score desc, md5(text)) k from best) where k <= 3""",
    "version_chains": f"with {_INDEX}, {_FUSED.format(5)}, {_CHAINS} select request, cast(rank as int) rank, cast(row_number() over (partition by request, memory_id order by nth) - 1 as int) chain, nodes from chains",
    "matched_texts": f"with {_INDEX}, {_FUSED.format(5)} select r.request, cast(r.rank as int) rank, cast(row_number() over (partition by r.request, r.memory_id order by greatest(o.sim, 0.0) desc, o.sq_index, o.rk) - 1 as int) position, md5(o.text) text_md5 from res r join once o on o.request = r.request and o.memory_id = r.memory_id",
    "responses": f"""with {_INDEX}, {_FUSED.format(5)}, {_MEM}, {_CHAINS} select request, cast(rank as int) rank, memory_id, round(score_q2q, 4) score_q2q, round(score_q2c, 4) score_q2c, round(final_score, 4) final_score, substring(session_text, 1, 200) preview, cast(n_matched as int) n_matched, cast(coalesce(n_chains, 0) as int) n_chains from res join mem using (memory_id)
left join (select request, memory_id, count(*) n_chains from chains group by all) c using (request, memory_id) where session_text is not null""",
    "context_budget": f"""with {_INDEX}, {_FUSED.format(5)}, {_MEM}, t as (select request, rank, memory_id, cast(floor(length(session_text) / 3.0) as bigint) tokens, greatest(2000 // count(*) over (partition by request), 300) share from res join mem using (memory_id) where session_text is not null),
a as (select *, least(tokens, share) asked, 2000 - coalesce(sum(least(tokens, share)) over (partition by request order by rank rows between unbounded preceding and 1 preceding), 0) rest from t),
g as (select *, case when asked <= rest then asked when rest > 200 then rest else 0 end given from a)
select request, cast(rank as int) rank, memory_id, tokens, cast(given as bigint) given from g where given > 0""",
    "version_parents": f"""with {_SUBS}, {_FAKE}, hits as (select * from (select s.sub_id new_id, f.query_id, f.parent_ids, coalesce(f.depth, 0) depth, {_S} sim, row_number() over (partition by s.sub_id order by {_S} desc, f.query_id) rk from subs s, fake f where len(f.v) = 64 and {_S} >= 0.35) where rk <= 50),
covered as (select distinct new_id, unnest(parent_ids) query_id from hits),
leaves as (select *, row_number() over (partition by new_id order by sim desc, query_id) n from hits h where not exists (select 1 from covered c where c.new_id = h.new_id and c.query_id = h.query_id)),
chosen as (select new_id, string_agg(query_id, ',' order by n) parent_ids, max(depth) + 1 depth from leaves where n <= 3 group by 1)
select s.sub_id new_id, coalesce(c.parent_ids, '') parent_ids, cast(coalesce(c.depth, 0) as int) depth, cast((select count(*) from hits h where h.new_id = s.sub_id) as int) n_hits from subs s left join chosen c on c.new_id = s.sub_id""",
    "linked_kps": f"""with {_SUBS}, {_FAKE}, hits as (select * from (select s.sub_id new_id, f.memory_id, row_number() over (partition by s.sub_id order by {_S} desc, f.query_id) rk from subs s, fake f where len(f.v) = 64 and {_S} >= 0.35) where rk <= 50),
seen as (select new_id, memory_id, min(rk) seen from hits group by all), kp as (select distinct on (memory_id, kp_index) * from knowledge_points)
select new_id, cast(n as int) rank, memory_id, kp_index, md5('[' || coalesce(time, '') || '] ' || coalesce(subject, '') || ': ' || coalesce(fact, '') || ' (' || coalesce(entities_or_values, '') || ')') line_md5
from (select *, row_number() over (partition by new_id order by seen, memory_id, kp_index) n from seen join kp using (memory_id)) where n <= 10""",
    "sliding_chunks": "select doc_id, cast(i as int) chunk_index, cast(length(c) as int) n_chars, md5(c) chunk_md5 from (select doc_id, i, substring(text, i * 500 + 1, 1000) c from (select doc_id, text, unnest(range(0, case when length(text) <= 1000 then 1 else 1 + cast(ceil((length(text) - 1000) / 500.0) as bigint) end)) i from documents where text is not null))",
    "session_text": f"with {_SESS}, {_LINES} select s.session_id, cast(len(s.turns) as int) n_turns, md5(coalesce((select string_agg(line, chr(10) order by i) from lines l where l.session_id = s.session_id), '')) text_md5 from sess s where len(s.turns) >= 3",
    "turn_chunks": f"""with recursive {_SESS}, {_LINES}, numbered as (select session_id, row_number() over (partition by session_id order by i) - 1 k, i - 1 turn, line, cast(floor(length(line) / 3.0) as bigint) cost from lines),
walk as (select session_id, k, 0 chunk, cost used from numbered where k = 0
  union all select n.session_id, n.k, case when w.used + n.cost <= 120 then w.chunk else w.chunk + 1 end, case when w.used + n.cost <= 120 then w.used + n.cost else n.cost end from walk w join numbered n on n.session_id = w.session_id and n.k = w.k + 1)
select session_id, chunk chunk_index, cast(min(turn) as int) turn_start, cast(max(turn) as int) turn_end, md5(string_agg(line, chr(10) order by k)) text_md5 from walk join numbered using (session_id, k) group by session_id, chunk
union all select session_id, 0, 0, 0, md5('') from sess where session_id not in (select session_id from numbered)""",
    "token_counts": "select doc_id, cast(floor(length(text) / 3.0) as bigint) tokens, md5(case when floor(length(text) / 3.0) > 500 then substring(text, 1, 1500) || '...' else text end) cut_md5 from documents",
    "session_order": f"with {_SESS}, d as (select sample_id, session_id, coalesce(try_strptime(case when not regexp_matches(date, '^\\s|\\s$') then date end, '%I:%M %p on %d %B, %Y'), try_strptime(case when regexp_full_match(date, '\\d{{4}}-\\d+-\\d+') then date end, '%Y-%m-%d'), try_strptime(case when regexp_full_match(date, '\\d{{4}}-\\d+-\\d+T\\d+:\\d+:\\d+') then date end, '%Y-%m-%dT%H:%M:%S'), try_strptime(case when regexp_full_match(date, '\\d+/\\d+/\\d{{4}}') then date end, '%m/%d/%Y')) date_ts from sess) select sample_id, session_id, coalesce(strftime(date_ts, '%Y-%m-%d %H:%M:%S'), 'undated') date_ts, cast(row_number() over (partition by sample_id order by date_ts asc nulls last, session_id) as int) seq from d",
    "json_repair_strings": f"with {_SESS} select session_id, cast(i - 1 as int) pos, md5(coalesce(turns[i].text, '')) text_md5 from (select session_id, turns, unnest(range(1, len(turns) + 1)) i from sess)",
    "json_repair_points": "with kp as (select distinct on (memory_id, kp_index) * from knowledge_points) select memory_id, cast(row_number() over (partition by memory_id order by kp_index) - 1 as int) pos, md5(coalesce(time, '') || '|' || coalesce(subject, '') || '|' || coalesce(fact, '') || '|' || coalesce(entities_or_values, '')) line_md5 from kp",
    "json_repair_subqueries": f"with {_FAKE} select memory_id, cast(row_number() over (partition by memory_id order by pos nulls first, query_id) - 1 as int) pos, md5(text) query_md5, query_id keywords from fake where text is not null and trim(text) <> ''",
    "json_repair_notes": f"with {_FAKE} select memory_id, cast(row_number() over (partition by memory_id order by pos nulls first, query_id) - 1 as int) pos, query_id title, md5(text) content_md5, query_id || ',x' tags from fake where text is not null and text <> ''",
    "hash_embedding": r"""with kp as (select distinct on (memory_id, kp_index) * from knowledge_points), w as (select memory_id, kp_index, unnest(regexp_extract_all(lower(fact), '[\p{L}\p{N}_]+')) w from kp),
c as (select memory_id, kp_index, cast(('0x' || substr(md5(w), 1, 8))::bigint % 64 as int) bucket, count(*) n from w group by all)
select memory_id, kp_index, bucket, round(n / sqrt(sum(n * n) over (partition by memory_id, kp_index)), 6) weight from c""",
    "max_sim_by_method": f"with {_BASE} select query, method, round(max(sim), 6) best, arg_min(pos, struct_pack(a := -sim, b := pos)) best_pos from sims group by all",
    "alignment_best_session": f"with {_BASE} select query, session, round(q2q, 6) q2q, round(q2p, 6) q2p, round(q2n, 6) q2n, round(q2r, 6) q2r, round(q2c, 6) q2c, round(gap, 6) gap from aligned",
    "paired_stats": f"with {_BASE} select {_PAIRED} from (select q2q a, q2c b from aligned)",
    "category_breakdown": f"with {_BASE} select coalesce(category, 'unknown') category, {_PAIRED} from (select q2q a, q2c b, case qs.label % 3 when 0 then 'even' when 1 then 'odd' end category from aligned join qs using (query)) group by 1",
    "pairwise_method_stats": f"with {_BASE}, o as (select *, list_position(['q2q','q2p','q2n','q2r','q2c'], method) k from long) select method_a, method_b, {_PAIRED} from (select x.method method_a, y.method method_b, x.sim a, y.sim b from o x join o y using (query) where x.k < y.k) group by 1, 2",
    "method_summary": f"with {_BASE} select method, {_MEAN3.format('sim')} from long group by 1",
    "distance_matrix": f"""with {_BASE}, dims as (select session, method, i, avg(u[i]) x from (select session, method, {_UNIT.format("v")} u, unnest(range(1, 65)) i from vec) group by all),
means as (select session, method, list(x order by i) m from dims group by all), both_ as (select session from means where method in ('q2q', 'q2c') group by 1 having count(*) = 2), ok as (select * from means where session in (select session from both_)),
d as (select 'tq_' || method pair, 1 - list_dot_product({_UNIT.format("e")}, m) d from evidence join qs using (query) join ok using (session)
 union all select a.method || '_' || b.method, 1 - list_dot_product({_UNIT.format("a.m")}, {_UNIT.format("b.m")}) from evidence v join ok a on a.session = v.session join ok b on b.session = v.session where a.method < b.method)
select pair, {_MEAN3.format("d")}, count(*) n_pairs from d group by 1""",
    "directional_alignment": f"""with {_BASE}, dims as (select session, i, avg(u[i]) x from (select session, {_UNIT.format("v")} u, unnest(range(1, 65)) i from vec where method = 'q2c') group by all),
means as (select session, list(x order by i) m from dims group by all), cent as (select session, {_UNIT.format("m")} c from means),
top as (select query, session, method, arg_min(pos, struct_pack(a := -sim, b := pos)) pos from sims group by all),
base as (select v.query, v.session, m.method, {_UNIT.format("qs.e")} q, c.c, {_UNIT.format("b.v")} b from evidence v join cent c using (session) join qs using (query) cross join (select unnest(['q2q','q2p','q2n','q2r','q2c']) method) m left join top t on t.query = v.query and t.session = v.session and t.method = m.method left join vec b on b.pos = t.pos),
d as (select method, b, list_transform(list_zip(q, c), lambda z: z[1] - z[2]) i, list_transform(list_zip(b, c), lambda z: z[1] - z[2]) m from base),
x as (select method, case when b is null then 0.0 when sqrt(list_dot_product(i, i)) < 1e-8 then 1.0 when sqrt(list_dot_product(m, m)) < 1e-8 then 0.0 else list_dot_product(i, m) / (sqrt(list_dot_product(i, i)) * sqrt(list_dot_product(m, m))) end v from d)
select method, {_MEAN3.format("v")}, count(*) n from x group by 1""",
    "discriminability": f"""with {_BASE}, other as (select query, arg_min(session, md5(query || '|' || session)) session from qs, (select distinct session from vec) s where not exists (select 1 from evidence e where e.query = qs.query and e.session = s.session) group by 1),
p as (select e.query, b.method, b.best p from evidence e join best b using (query, session) where ev_pos = 0), n as (select o.query, b.method, b.best n from other o join best b using (query, session)),
d as (select method, coalesce(p, 0.0) - coalesce(n, 0.0) d from p full join n using (query, method))
select method, {_MEAN3.format("d")}, round(avg(case when d > 0 then 1.0 else 0.0 end), 6) positive_rate, count(*) n from d group by 1""",
    "hit_at_k": f"""with {_BASE}, r as (select query, method, session, row_number() over (partition by query, method order by best desc, session) rk from best where session in (select session from evidence)),
f as (select r.query, r.method, coalesce(min(rk) filter (e.session is not null), 1000000) first from r left join evidence e on e.query = r.query and e.session = r.session group by all)
select method, round(avg((first <= 1)::int), 6) hit_1, round(avg((first <= 5)::int), 6) hit_5, round(avg((first <= 10)::int), 6) hit_10, count(*) n from f group by 1""",
    "robustness": f"with {_BASE}, {_STYLED} select query, method, round(l.sim, 6) orig, round(var_pop(s.sim), 6) var, round(1 - greatest(0.0, l.sim - min(s.sim)) / (l.sim + 1e-10), 6) robustness from long l join styled s using (query, method) group by query, method, l.sim",
    "robustness_overall": f"with {_BASE}, {_STYLED}, r as (select query, method, var_pop(s.sim) var, 1 - greatest(0.0, l.sim - min(s.sim)) / (l.sim + 1e-10) robustness from long l join styled s using (query, method) group by query, method, l.sim) select method, round(avg(var), 6) mean_var, round(avg(robustness), 6) mean_robustness, round(stddev_pop(robustness), 6) std_robustness, round((select avg(var) from r where method = 'q2c') / ((select avg(var) from r where method = 'q2q') + 1e-10), 6) q2c_over_q2q from r group by 1",
    "style_drop": f"with {_BASE}, {_STYLED}, g as (select l.query, l.method, t.style, l.sim orig, coalesce(s.sim, 0.0) sim from long l cross join (select distinct style from styled) t left join styled s on s.query = l.query and s.method = l.method and s.style = t.style) select method, coalesce(style, -1) style, round(avg(sim), 6) mean_sim, round(avg(orig - sim), 6) mean_drop, round(avg((sim < 0.9 * orig)::int), 6) drop_rate, count(*) n from g group by grouping sets ((method, g.style), (method))",
    "friedman_chi2": f"""with {_BASE}, {_STYLED}, r as (select method, query, style, count(*) over (partition by method, query) k, count(*) over (partition by method, query, sim) t, rank() over (partition by method, query order by sim) + (count(*) over (partition by method, query, sim) - 1) / 2.0 r from styled),
s as (select method, sum(rs * rs) ss from (select method, style, sum(r) rs from r group by all) group by 1), h as (select method, count(distinct query) n, max(k) k, sum((t * t - 1)::double) tied from r group by 1)
select *, round(case when k % 2 = 1 then exp(-chi2 / 2) * list_sum(list_transform(range(0, cast((k - 1) // 2 as bigint)), lambda i: pow(chi2 / 2, i) / gamma(i + 1))) end, 6) p from (select method, n, k, round(case when n >= 10 and 1 - tied / (n * k * (k * k - 1)) > 0 then (12.0 / (n * k * (k + 1)) * ss - 3.0 * n * (k + 1)) / (1 - tied / (n * k * (k * k - 1))) end, 6) chi2 from s join h using (method))""",
    "drift_checkpoints": f"""with {_BASE}, cps as (select unnest(range(1, 11)) cp), frame as (select cp, m.method, (select count(*) from vec v where v.method = m.method and v.session + 1 <= cp) n_vectors from cps cross join (select unnest(['q2q','q2p','q2n','q2r','q2c']) method) m),
ok as (select cp from frame where method in ('q2q', 'q2c') and n_vectors > 0 group by 1 having count(*) = 2),
el as (select query, cp from (select query, max(session) + 1 seq from evidence group by 1), cps where seq <= cp and cp in (select cp from ok)),
pool as (select e.cp, e.query, s.method, s.sim, v.session is not null hit from el e join sims s on s.query = e.query and s.session + 1 <= e.cp left join evidence v on v.query = s.query and v.session = s.session),
tgt as (select *, max(sim) filter (hit) over (partition by cp, query, method) target from pool),
rk as (select cp, query, method, case when max(target) is null then count(*) else 1 + count(*) filter (sim > target) end::double rank from tgt group by all),
f as (select e.cp, m.method, coalesce(r.rank, e.cp) rank from el e cross join (select unnest(['q2q','q2p','q2n','q2r','q2c']) method) m left join rk r on r.cp = e.cp and r.query = e.query and r.method = m.method),
o as (select cp, method, count(*) n_queries, avg(rank) mean_rank, median(rank) median_rank, avg(1 / rank) mrr, avg((rank <= 1)::int) r1, avg((rank <= 5)::int) r5, avg((rank <= 10)::int) r10 from f group by all)
select cast(cp as int) cp, method, n_vectors, coalesce(n_queries, 0) n_queries, round(mean_rank, 6) mean_rank, round(median_rank, 6) median_rank, round(mrr, 6) mrr, round(r1, 6) recall_1, round(r5, 6) recall_5, round(r10, 6) recall_10, round(mean_rank - first_value(mean_rank ignore nulls) over (partition by method order by cp), 6) rank_drift from frame left join o using (cp, method)""",
    "usage_stats": "select case event_type when 'signup' then 'memorize' else 'query' end phase, count(*) calls, cast(sum(cast(floor(value) as bigint)) as bigint) input_tokens, cast(sum(cast(floor(value / 2) as bigint)) as bigint) output_tokens, round(sum(value) / count(*), 6) mean_latency from events group by 1",
    "ari_nmi": """with d as (select lower(trim(lang)) a, lower(trim(source)) b from documents where lang is not null and source is not null), c as (select a, b, count(*)::double n from d group by all), r as (select sum(n) n from c group by a), k as (select sum(n) n from c group by b), t as (select sum(n) t from c),
x as (select (select sum(n * (n - 1) / 2) from c) cab, (select sum(n * (n - 1) / 2) from r) ca, (select sum(n * (n - 1) / 2) from k) cb, (select -sum(n / t * ln(n / t)) from c, t) hab, (select -sum(n / t * ln(n / t)) from r, t) ha, (select -sum(n / t * ln(n / t)) from k, t) hb, t from t)
select round((cab - ca * cb / (t * (t - 1) / 2)) / ((ca + cb) / 2 - ca * cb / (t * (t - 1) / 2)), 6) ari, round(2 * (ha + hb - hab) / (ha + hb), 6) nmi from x""",
    "upsert_delete": f"with {_MEM} select memory_id, session_id, epoch_us(ingested_at) ingested_us from mem where session_text is not null and session_text <> ''",
    "incremental_missing": "select distinct memory_id from memories where memory_id is not null and memory_id not in (select memory_id from content_chunks where memory_id is not null and chunk_index > 0 and embedding is not null)",
    "memory_chunks": f"with {_MEM} select memory_id, cast(i as int) chunk_index, md5(substring(session_text, i * 500 + 1, 1000)) chunk_md5 from (select memory_id, session_text, unnest(range(0, case when length(session_text) <= 1000 then 1 else 1 + cast(ceil((length(session_text) - 1000) / 500.0) as bigint) end)) i from mem where session_text is not null)",
    "stored_documents": f"""with {_MEM}, {_FAKE}, {_CHUNK}, {_PARA}, kp as (select distinct memory_id, kp_index from knowledge_points)
select memory_id, md5(session_text) text_md5, cast((select count(*) from chunk c where c.memory_id = mem.memory_id) as int) n_content_embeddings, cast((select count(*) from fake f where f.memory_id = mem.memory_id) as int) n_fake_queries,
cast((select count(*) from kp k where k.memory_id = mem.memory_id) as int) n_knowledge_points, cast((select count(*) from para p where p.memory_id = mem.memory_id) as int) n_paragraphs from mem""",
    "store_search": f"with {_SUBS}, {_FAKE}, {_HITS} select sub_id, query_id, round(greatest(sim, 0.0), 6) score, cast(rk as int) rank from hits",
    "vector_tables": f"with {_FAKE}, {_PARA} select 'q2q' as method, memory_id session_id, count(*) n from fake where text is not null group by memory_id union all select 'q2c', memory_id, count(*) from para where text is not null group by memory_id",
    "stored_sessions": "select memory_id, count(distinct query_id) n_queries from fake_queries where embedding is not null group by 1",
}
