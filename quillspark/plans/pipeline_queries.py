"""Queries of composed operators: chunking, metadata, analysis, answers with evidence, golden measures, stored results."""

from __future__ import annotations

from hashlib import blake2b
from math import sqrt
from re import findall

from pyspark.sql import functions as F

from ..functions import text as tx
from ..functions import vectors as vec
from ..functions import vocabulary as V
from ..operators import analysis, chunking, metrics, rank, relational, retrieval
from ..session import load, shared_dir, spread
from ..sources import readers
from ..streaming import ingest
from .reference_queries import _COUNTS, _CLASSIFY, _LABEL, _Q_SQL, _SIGNALS_SQL, ORACLES, QUESTIONS, _kinds, _sql_list, _words, query

_WS = r"[\s\x0b\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]"
_collapse = lambda e: f"trim(regexp_replace({e}, '{_WS}+', ' ', 'g'))"
_sentences = lambda e, n: rf"[trim(x) for x in string_split(regexp_replace({e}, '([.!?])\s+([A-Z0-9])', '\1' || chr(1) || '\2', 'g'), chr(1)) if length(trim(x)) > {n}]"


# ---- chunks and lines of documents ----
def _chunks_sql(source: str) -> str:
    """CTEs up to ``chunks`` (id, section, chunk_index, text) of ``source`` (id, content)."""
    return rf"""l as (select id, string_split(trim(regexp_replace(coalesce(content, ''), '\r\n?', chr(10), 'g')), chr(10)) as ls from {source}),
 u as (select id, i, ls[i] as line, i > 1 and regexp_matches(ls[i] || case when i < len(ls) then chr(10) || ls[i + 1] else '' end, '(?im)\A\s*(?:{V.HEADINGS})\s*(?:\n|$)') as head from (select id, ls, unnest(range(1, len(ls) + 1)) as i from l)),
 pt as (select id, i, sum(cast(head as integer)) over (partition by id order by i) as part, trim(regexp_replace(regexp_replace(line, '\A{_WS}+', ''), '{_WS}+\z', '')) as tl from u),
 ps as (select id, part, list(tl order by i) as p from pt where tl <> '' group by id, part),
 rw as (select id, part, p, case when len([w for w in regexp_split_to_array(p[1], '{_WS}+') if w <> '']) <= 12 then trim(substr(p[1], 1, 100)) else 'Body' end as raw from ps),
 tc as (select id, part, p, array_to_string([case when k = 1 or not regexp_matches(raw[k - 1], '\p{{L}}') then upper(raw[k]) else lower(raw[k]) end for k in range(1, length(raw) + 1)], '') as s from rw),
 se as (select id, part, p, case when regexp_matches(s, '(?i)^P\s*A\s*G\s*E\s*\|?\s*\d+$') then 'Body' else s end as section from tc),
 wd as (select id, part, section, [w for w in regexp_split_to_array(array_to_string(case when section <> 'Body' then p[2:] else p end, ' '), '{_WS}+') if w <> ''] as w from se),
 wn as (select id, part, section, w, unnest(range(0, cast(ceil(len(w) / 220.0) as bigint))) as n from wd where len(w) > 0),
 chunks as (select id, section, cast(row_number() over (partition by id order by part, n) - 1 as integer) as chunk_index, array_to_string(w[n * 220 + 1 : n * 220 + 220], ' ') as text from wn)"""


_STORED = "(select distinct id, content from paper_documents)"


@query("section_chunks", f"with {_chunks_sql(_STORED)} select id, section, chunk_index, text from chunks")
def section_chunks(spark, d):
    return chunking.section_chunks(load(spark, d, "paper_documents").select("id", "content").distinct(), ["id"], "content").select("id", "section", "chunk_index", "text")


def _labelled_sql(labels: str, most: int) -> str:
    rx = rf"(?i)^(?:{labels})\s*[:\-–]\s*(.+)$"
    return f"coalesce([trim(regexp_extract(x, '{rx}', 1)) for x in ls[1:35] if regexp_matches(x, '{rx}') and length(trim(regexp_extract(x, '{rx}', 1))) between 3 and {most}][1], '')"


@query("metadata_lines", rf"""with l as (select distinct id, filename, [{_collapse('x')} for x in regexp_split_to_array(coalesce(content, ''), '\r\n|[\n\r\x0b\x0c\x1c-\x1e\x{{85}}\x{{2028}}\x{{2029}}]')] as ls from paper_documents)
select id, coalesce([x for x in ls if length(x) between 8 and 180 and not list_contains({_sql_list(V.BARE_HEADINGS)}, lower(x))][1], nullif(regexp_replace(regexp_extract(coalesce(filename, ''), '([^/]*)$', 1), '(.)\.[^.]*$', '\1'), ''), 'Uploaded paper') as title,
 {_labelled_sql(V.AUTHOR_LABELS, 300)} as authors, {_labelled_sql(V.VENUE_LABELS, 200)} as venue from l""")
def metadata_lines(spark, d):
    docs = load(spark, d, "paper_documents").select("id", F.coalesce("content", F.lit("")).alias("content"), F.coalesce("filename", F.lit("")).alias("filename")).distinct()
    return docs.select("id", tx.first_title(F.col("content"), F.col("filename")).alias("title"), tx.first_authors(F.col("content")).alias("authors"), tx.first_venue(F.col("content")).alias("venue"))


# ---- analysis ----
_firsts = lambda e, lead: f"list_filter({e}, lambda x, i : list_position({e}, x) = i)".replace("{e}", e) if lead is None else f"[{_collapse(f'''regexp_replace(x, '(?i)^({lead})' || chr(92) || 's*', '')''')} for x in {e}]"
_HEURISTIC_SQL = rf"""b as (select id, {_collapse("coalesce(abstract, '')")} as t, coalesce(title, '') as title from papers),
 c as (select id, title, case when t = '' then 'Academic publication titled: ' || title || '.' else t end as t from b),
 s as (select id, title, t, {_sentences('t', 18)} as s, lower(concat_ws(' ', title, t)) as low from c),
 k as (select *, [x for x in {_firsts(f"[x for x in s if regexp_matches(x, '(?i)' || chr(92) || 'b({V.STRENGTH_WORDS})' || chr(92) || 'b') and not regexp_matches(x, '(?i)' || chr(92) || 'b(however|limitation|bottleneck)' || chr(92) || 'b')]", 'furthermore|moreover|in addition|additionally|also|here,')} if length(x) > 25] as st,
  [x for x in {_firsts(f"[x for x in s if regexp_matches(x, '(?i)' || chr(92) || 'b({V.LIMIT_WORDS})' || chr(92) || 'b')]", 'however' + chr(92) + 's*,|nonetheless' + chr(92) + 's*,|nevertheless' + chr(92) + 's*,|yet' + chr(92) + 's*,')} if length(x) > 25] as wk from s),
 heuristic as (select id, case when length(t) > 40 then case when len(s) > 0 then array_to_string(s[1:5], ' ') else substr(t, 1, 500) end else 'Academic study addressing ' || title || '.' end as analysis_summary,
  array_to_string([x for x in s if regexp_matches(x, '(?i)\b({V.METHOD_WORDS})\b')][1:2], ' ') as method_sentences,
  array_to_string(list_filter(st, lambda x, i : list_position(st, x) = i)[1:3], chr(10)) as strengths, array_to_string(list_filter(wk, lambda x, i : list_position(wk, x) = i)[1:3], chr(10)) as weaknesses,
  case {' '.join(f"when {' or '.join(f'''contains(low, '{p}')''' for p in parts)} then '{k}'" for k, parts in V.DOMAINS.items())} else 'general' end as domain,
  cast(case when length(t) > 300 then 0.85 else 0.70 end as double) as confidence from k)"""


@query("heuristic_analysis", f"with {_HEURISTIC_SQL} select * from heuristic")
def heuristic_analysis(spark, d):
    a = analysis.heuristic_analysis(load(spark, d, "papers"), "title", "abstract")
    return a.select("id", "analysis_summary", "method_sentences", F.array_join("strengths", "\n").alias("strengths"), F.array_join("weaknesses", "\n").alias("weaknesses"), "domain", "confidence")


@query("repaired_analyses", f"""with {_HEURISTIC_SQL} select p.id, case when p.source in ('upload', 'arxiv') then h.strengths else 'It is fast.' end as strengths, cast(case when p.source in ('upload', 'arxiv') then h.confidence else 0.6 end as double) as confidence,
 p.source in ('upload', 'arxiv') as repaired from papers p join heuristic h on h.id = p.id""")
def repaired_analyses(spark, d):
    """Stored analyses: of uploads there are placeholders, of one source none; both are computed anew."""
    p = load(spark, d, "papers")
    kept = p.where("source not in ('upload', 'arxiv')").select("id", F.array(F.lit("It is fast.")).alias("strengths"), F.lit(0.6).alias("confidence"))
    stale = p.where("source = 'upload'").select("id", F.array(F.lit("Not verified yet")).alias("strengths"), F.lit(0.5).alias("confidence"))
    return analysis.repair_analyses(kept.unionByName(stale), p, "id", "title", "abstract").select("id", F.array_join("strengths", "\n").alias("strengths"), "confidence", "repaired")


# ---- retrieval and answers ----
def _hashed(text: str) -> dict[int, float]:
    """The hash embedding of a question as place -> value, computed apart from the operator."""
    v: dict[int, float] = {}
    for t in findall("[a-z0-9]+", text.lower()):
        i = int.from_bytes(blake2b(t.encode(), digest_size=8).digest(), "big") % vec.DIMENSION
        v[i] = v.get(i, 0.0) + 1.0
    n = sqrt(sum(x * x for x in v.values()))
    return {i: x / n for i, x in sorted(v.items())}


_QV_SQL = "qv as (select * from (values " + ", ".join(f"({i}, [" + ", ".join(f"{{'i': {k + 1}, 'v': cast({x!r} as double)}}" for k, x in _hashed(q).items()) + "])" for i, q in QUESTIONS) + ") as t(question_id, qv))"
_CHUNK_COLUMNS = "id, document_id, text, section, chunk_index, page"


def _kept_sql(keys: str, rows: int, ties: str) -> str:
    """CTEs up to ``kept``: the first ``rows`` chunks of each key by hybrid score."""
    return f"""{_QV_SQL}, q as {_kinds(_Q_SQL, 'question_id, question')},
 hc as (select distinct {_CHUNK_COLUMNS}, embedding from document_chunks where len(embedding) = {vec.DIMENSION}),
 hs as (select question_id, question, kind, {_CHUNK_COLUMNS}, q_words, lower(coalesce(section, '')) as sec, {_words('text', V.STOP_WORDS)} as cw, coalesce(list_sum([x.v * cast(embedding[x.i] as double) for x in qv]), 0.0) as dense from q join qv using (question_id), hc),
 ht as (select *, len(list_intersect(q_words, cw)) as shared from hs),
 hu as (select *, round(0.55 * dense + 0.45 * (shared / greatest(len(q_words), 1)) + case when {_LABEL(V.PRIMARY_SECTIONS)} then 0.65 when {_LABEL(V.SECONDARY_SECTIONS)} then 0.65 * 0.4 else 0.0 end
   - case when kind not in ('general', 'metadata') and ({' or '.join(f"contains(sec, '{b}')" for b in V.BACKGROUND_SECTIONS)}) then 0.65 else 0.0 end + 0.12 * shared, 9) as score from ht),
 kept as (select * from (select *, row_number() over (partition by {keys} order by score desc, {ties}) as rank from hu) where rank <= {rows})"""


def _answers_sql(keys: str) -> str:
    """CTEs up to ``extract`` (keys, extract, verified) of ``kept``."""
    generic = _sql_list(V.ANSWER_GENERIC)
    return f"""ea as (select *, {_words('question')} as asked from kept),
 eb as (select *, case when len([t for t in asked if not list_contains({generic}, t)]) > 0 then [t for t in asked if not list_contains({generic}, t)] else asked end as substance from ea),
 ec as (select {keys}, asked, substance, rank, sl, unnest(range(1, len(sl) + 1)) as place from (select *, {_sentences('text', 20)} as sl from eb)),
 ed as (select {keys}, asked, rank, place, sl[place] as sentence, len(list_intersect(substance, {_words('sl[place]')})) as shared from ec where not regexp_matches(lower(sl[place]), '{"|".join(V.BOILERPLATE)}')),
 ee as (select * from (select *, row_number() over (partition by {keys} order by shared desc, rank, place) as n from ed) where n <= 3),
 ef as (select *, max(shared) over (partition by {keys}) as most from ee),
 eg as (select {keys}, any_value(asked) as asked, substr(string_agg(sentence, ' ' order by n), 1, 900) as evidence from ef where case when most > 0 then shared > 0 else n <= 2 end group by {keys}),
 ei as (select {keys}, coalesce(string_agg(case when coalesce(page, 0) <> 0 then 'Page ' || page || ', ' || section else section end, ', ' order by rank) filter (where rank <= 3), '') as cites from kept group by {keys}),
 ej as (select ei.*, evidence, coalesce(length(evidence) > 0 and len(list_intersect(asked, {_words('evidence')})) > 0, false) as verified from ei left join eg using ({keys})),
 extract as (select {keys}, verified, case when verified then 'Based only on the retrieved paper evidence: ' || evidence || chr(10) || chr(10) || 'Evidence: ' || cites else '{V.CANNOT_VERIFY}' end as extract from ej)"""


def _supports_sql(keys: str) -> str:
    """CTEs up to ``backed`` (keys, supported): whether ``kept`` supports its question."""
    return f"""sq as (select *, {_SIGNALS_SQL} as signals from (select question_id, question, q_words, {_CLASSIFY} as kind from (select *, {_COUNTS} from (select question_id, question, {_words('question', V.STOP_WORDS)} as q_words from {_Q_SQL})))),
 sr as (select *, [t for t in q_words if not list_contains({_sql_list(V.GENERIC_TERMS)}, t) and not list_contains(signals, t)] as topic, regexp_extract_all(question, '\\b[A-Za-z0-9]+-[A-Za-z0-9]+\\b') as compounds from sq),
 ss as (select *, {_words("array_to_string(compounds, ' ')", V.STOP_WORDS)} as roots from sr),
 st2 as (select *, [t for t in topic if not list_contains(roots, t)] as beyond from ss),
 sv as (select {', '.join('kept.' + k.strip() for k in keys.split(','))}, st2.kind, len(st2.q_words) as n_q, len(topic) as n_topic, len(compounds) as n_c, len(roots) as n_r, len(beyond) as n_b,
   len(list_intersect(topic, cw)) >= case when len(topic) <= 2 then 1 else ceil(len(topic) * 0.35) end as topic_ok, len(list_intersect(roots, cw)) > 0 as root_ok, len(list_intersect(beyond, cw)) > 0 as beyond_ok,
   (len(list_intersect(signals, cw)) > 0 or {_LABEL(V.PRIMARY_SECTIONS).replace('case kind', 'case st2.kind')}) as signal_ok, len(list_intersect(st2.q_words, cw)) > 0 as any_ok from kept join st2 on st2.question_id = kept.question_id),
 sw as (select {keys}, any_value(kind) as kind, any_value(n_q) as n_q, any_value(n_topic) as n_topic, any_value(n_c) as n_c, any_value(n_r) as n_r, any_value(n_b) as n_b, bool_or(topic_ok) as topic_ok, bool_or(root_ok) as root_ok,
   bool_or(root_ok and beyond_ok) as together_ok, bool_or(signal_ok) as signal_ok, bool_or(any_ok) as any_ok from sv group by {keys}),
 backed as (select {keys}, n_q > 0 and (n_topic = 0 or topic_ok) and (n_c = 0 or ((n_r = 0 or root_ok) and (n_b = 0 or together_ok))) and case when kind in ('general', 'metadata') then any_ok else signal_ok end as supported from sw)"""


def _usable_chunks(spark, d):
    return load(spark, d, "document_chunks").where(F.size("embedding") == vec.DIMENSION).select("id", "document_id", "text", "section", "chunk_index", "page", "embedding").distinct()


def _asked(spark):
    return spark.createDataFrame(QUESTIONS, "question_id int, question string").withColumn("question_vector", vec.hash_embedding("question"))


def _best_chunks(spark, d):
    """The six chunks of the whole store for each question."""
    q = _asked(spark).withColumn("q_words", tx.content_words(F.col("question"))).withColumn("kind", retrieval.classify(F.col("question")))
    c = spread(_usable_chunks(spark, d)).withColumn("t_words", tx.content_words(F.col("text")))
    s = rank.hybrid_score(c.crossJoin(F.broadcast(q))).withColumn("hybrid_score", F.round("hybrid_score", 9))  # ten questions
    return rank.topk_per(s, ["question_id"], 6, F.col("hybrid_score").desc(), F.col("id"))


@query("hybrid_topk", f"with {_kept_sql('question_id', 6, 'id')} select question_id, id, round(score, 6) as score from kept")
def hybrid_topk(spark, d):
    return _best_chunks(spark, d).select("question_id", "id", F.round("hybrid_score", 6).alias("score"))


@query("extractive_answers", f"with {_kept_sql('question_id', 6, 'id')}, {_answers_sql('question_id')} select question_id, extract as answer, verified from extract")
def extractive_answers(spark, d):
    return retrieval.extractive_answer(rank.rerank(_best_chunks(spark, d)), ["question_id"])


_PIPELINE_SQL = f"""with {_kept_sql('document_id, question_id', 6, 'chunk_index, id')}, {_answers_sql('document_id, question_id')}, {_supports_sql('document_id, question_id')},
 it as (select question_id, question, {ORACLES['metadata_intents'].partition('select question_id, ')[2].partition(' as intent from')[0]} as intent from (select question_id, question, lower(trim(question)) as q from {_Q_SQL})),
 pd as (select distinct d.id as document_id, p.title, p.authors, p.venue, p.year, p.doi, coalesce(p.evidence_state = 'full-text', false) as full_text from paper_documents d join papers p on p.id = d.paper_id),
 ow as (select pd.document_id, it.question_id, it.question, full_text, {ORACLES['metadata_answers'].partition('select id, intent, ')[2].partition(' as answer from')[0]} as own from pd, it),
 cd as (select document_id, count(*) as n from hc group by 1),
 ci as (select document_id, question_id, count(*) as n, string_agg(concat_ws(':', coalesce(cast(page as varchar), ''), coalesce(section, ''), cast(chunk_index as varchar)), ', ' order by rank) as c from kept group by 1, 2),
 pj as (select ow.*, q.kind, extract, coalesce(cd.n, 0) as retrieved, ci.n as shown, ci.c, own is not null as meta, own is not null or (coalesce(supported, false) and full_text) as ok from ow join q using (question_id) left join backed using (document_id, question_id) left join extract using (document_id, question_id) left join cd using (document_id) left join ci using (document_id, question_id)),
 answers as (select document_id, question_id, question, case when meta then 'metadata' else kind end as question_type, case when ok then 'evidence-backed' else 'insufficient-evidence' end as status, case when meta then 'metadata-grounded' else 'hybrid-fallback' end as reranker,
  cast(retrieved as bigint) as retrieved, cast(case when ok and not meta then shown else 0 end as bigint) as evidence_count, case when meta then own when ok then extract else '{V.CANNOT_VERIFY}' end as answer, case when ok and not meta then c else '' end as citations from pj)
"""


def _pipeline(spark, d):
    papers = load(spark, d, "papers").select(F.col("id").alias("paper_id"), "title", "authors", "venue", "year", "doi", F.coalesce(F.col("evidence_state") == "full-text", F.lit(False)).alias("full_text"))
    docs = load(spark, d, "paper_documents").select(F.col("id").alias("document_id"), "paper_id").distinct().join(papers, "paper_id").drop("paper_id").distinct()
    return retrieval.evidence_pipeline(_asked(spark), docs, spread(_usable_chunks(spark, d)), "document_id")


@query("evidence_pipeline", _PIPELINE_SQL + "select * from answers")
def evidence_pipeline(spark, d):
    return _pipeline(spark, d)


@query("chat_messages", _PIPELINE_SQL + """select document_id as session_id, cast(question_id * 2 as bigint) as turn, 'user' as role, question as content, '' as citations from answers
union all select document_id, question_id * 2 + 1, 'assistant', answer, citations from answers""")
def chat_messages(spark, d):
    return retrieval.chat_rows(_pipeline(spark, d), "document_id")


# ---- a golden set drawn from the store: each document is asked for its second chunk, and for what it does not hold ----
_NOTHING = QUESTIONS[9][1]
_GOLDEN_SQL = rf"""with c as (select distinct {_CHUNK_COLUMNS} from document_chunks where length(trim(text)) > 0),
 w as (select document_id, id as expected, [x for x in string_split({_collapse('text')}, ' ') if x <> ''] as w from c qualify row_number() over (partition by document_id order by case when chunk_index = 1 then 0 else 1 end, chunk_index, id) = 1),
 g as (select document_id, expected, true as answerable, array_to_string(w[1:10], ' ') as question, lower(array_to_string(w[3:5], ' ')) as fact from w union all select document_id, null, false, '{_NOTHING}', null from w),
 k as (select document_id, expected, answerable, question, fact, q_words, {_CLASSIFY} as kind from (select *, {_COUNTS} from (select *, {_words('question', V.STOP_WORDS)} as q_words from g))),
 s as (select k.*, c.id, c.text, c.chunk_index, lower(coalesce(section, '')) as sec, {_words('text', V.STOP_WORDS)} as cw from k join c using (document_id)),
 t as (select *, len(list_intersect(q_words, cw)) as shared from s),
 u as (select *, round(0.45 * (shared / greatest(len(q_words), 1)) + case when {_LABEL(V.PRIMARY_SECTIONS)} then 0.65 when {_LABEL(V.SECONDARY_SECTIONS)} then 0.65 * 0.4 else 0.0 end
   - case when kind not in ('general', 'metadata') and ({' or '.join(f"contains(sec, '{b}')" for b in V.BACKGROUND_SECTIONS)}) then 0.65 else 0.0 end + 0.12 * shared, 9) as score from t),
 r as (select * from (select *, row_number() over (partition by document_id, answerable order by score desc, chunk_index, id) as rank, coalesce(cast(id = expected as integer), 0) as rel from u) where rank <= 10),
 v as (select *, {_SIGNALS_SQL} as signals from r where rank <= 5),
 x as (select *, [t for t in q_words if not list_contains({_sql_list(V.GENERIC_TERMS)}, t) and not list_contains(signals, t)] as topic, regexp_extract_all(question, '\b[A-Za-z0-9]+-[A-Za-z0-9]+\b') as compounds from v),
 y as (select *, {_words("array_to_string(compounds, ' ')", V.STOP_WORDS)} as roots from x),
 z as (select *, [t for t in topic if not list_contains(roots, t)] as beyond from y),
 h as (select document_id, answerable, any_value(kind) as kind, max(len(q_words)) as n_q, max(len(topic)) as n_topic, max(len(compounds)) as n_c, max(len(roots)) as n_r, max(len(beyond)) as n_b, bool_or(len(list_intersect(topic, cw)) >= case when len(topic) <= 2 then 1 else ceil(len(topic) * 0.35) end) as topic_ok,
   bool_or(len(list_intersect(roots, cw)) > 0) as root_ok, bool_or(len(list_intersect(roots, cw)) > 0 and len(list_intersect(beyond, cw)) > 0) as together_ok, bool_or(len(list_intersect(signals, cw)) > 0 or {_LABEL(V.PRIMARY_SECTIONS)}) as signal_ok, bool_or(shared > 0) as any_ok,
   coalesce(bool_or(contains(lower(text), fact)), false) as found from z group by 1, 2),
 j as (select document_id, answerable, found, n_q > 0 and (n_topic = 0 or topic_ok) and (n_c = 0 or ((n_r = 0 or root_ok) and (n_b = 0 or together_ok))) and case when kind in ('general', 'metadata') then any_ok else signal_ok end as supported from h),
 m as (select document_id, answerable, max(case when rank <= 1 then rel else 0 end) as h1, max(case when rank <= 3 then rel else 0 end) as h3, max(case when rank <= 5 then rel else 0 end) as h5, max(rel) as h10, coalesce(1.0 / min(case when rel = 1 then rank end), 0) as rr,
   sum(case when rank <= 5 then rel / log2(rank + 1) else 0 end) as d5, sum(rel / log2(rank + 1)) as d10, sum(case when rank <= 5 then rel else 0 end) / count(*) filter (where rank <= 5) as p5, sum(case when rank <= 5 then rel else 0 end) as r5 from r group by 1, 2)
select count(*) as queries, {', '.join(f'round(avg({c}) filter (where answerable), 6) as {n}' for c, n in (('h1', 'hit_1'), ('h3', 'hit_3'), ('h5', 'hit_5'), ('h10', 'hit_10'), ('rr', 'rr'), ('d5', 'ndcg_5'), ('d10', 'ndcg_10'), ('p5', 'precision_5'), ('r5', 'recall_5')))},
 round(count(*) filter (where answerable and supported) / count(*) filter (where answerable), 6) as answerable_support, round(avg(case when supported and found then 1.0 else 0.0 end) filter (where answerable), 6) as fact_coverage,
 round(count(*) filter (where not answerable and supported) / count(*) filter (where not answerable), 6) as unanswerable_support,
 coalesce(round(count(*) filter (where not answerable and not supported) / nullif(count(*) filter (where not supported), 0), 6), 1.0) as abstention_precision, round(count(*) filter (where not answerable and not supported) / count(*) filter (where not answerable), 6) as abstention_recall
from m join j using (document_id, answerable)"""


@query("golden_metrics", _GOLDEN_SQL)
def golden_metrics(spark, d):
    c = load(spark, d, "document_chunks").where("length(trim(text)) > 0").select("id", "document_id", "text", "section", "chunk_index", "page").distinct()
    second = rank.topk_per(c, ["document_id"], 1, F.when(F.col("chunk_index") == 1, 0).otherwise(1), F.col("chunk_index"), F.col("id"))
    w = F.filter(F.split(tx.collapse(F.col("text")), " "), lambda x: x != "")
    own = second.select("document_id", F.col("id").alias("expected"), F.lit(True).alias("answerable"), F.array_join(F.slice(w, 1, 10), " ").alias("question"), F.lower(F.array_join(F.slice(w, 3, 3), " ")).alias("fact"))
    none = second.select("document_id", F.lit(None).cast("string").alias("expected"), F.lit(False).alias("answerable"), F.lit(_NOTHING).alias("question"), F.lit(None).cast("string").alias("fact"))
    keys = ["document_id", "answerable"]
    q = own.unionByName(none)
    pairs = q.join(c, "document_id").withColumn("question_vector", F.array().cast("array<double>")).withColumn("embedding", F.array().cast("array<double>"))
    ranked = rank.topk_per(rank.hybrid_score(pairs).withColumn("hybrid_score", F.round("hybrid_score", 9)), keys, 10, F.col("hybrid_score").desc(), F.col("chunk_index"), F.col("id"))
    ranked = ranked.withColumn("relevant", F.coalesce((F.col("id") == F.col("expected")).cast("int"), F.lit(0))).withColumn("expected_n", F.col("answerable").cast("int"))
    shown = ranked.where("rank <= 5")
    backed = retrieval.evidence_supports(q.select(*keys, "question"), shown.select(*keys, "text", "section"), keys).drop("kind")
    facts = shown.groupBy(*keys).agg(F.coalesce(F.max(F.contains(F.lower("text"), F.col("fact")).cast("double")), F.lit(0.0)).alias("coverage"))
    per = metrics.per_query_metrics(ranked.withColumn("key", F.struct(*keys)), "key", "relevant", "expected_n").select("key.*", "*").drop("key")
    return metrics.golden_metrics(per.join(backed, keys).join(facts, keys))


# ---- search results that stay in the store ----
@query("persist_results", """with r as (select 'a' || input_id as seq, id, null as doi, title, null as pdf_url, citation_count from (select distinct input_id, id, title, citation_count from paper_inputs)
  union all select 'b' || id, id, doi, title, pdf_url, citation_count from (select distinct id, doi, title, pdf_url, citation_count from provider_records)),
 e as (select *, coalesce(nullif(doi, ''), nullif(id, ''), nullif(title, '')) as external_id from r),
 n as (select external_id, id, evidence_state from papers where external_id is not null qualify row_number() over (partition by external_id order by created_at desc, id desc) = 1),
 j as (select e.*, coalesce(p.id, n.id) as paper_id, case when p.id is not null then p.evidence_state when n.id is not null then n.evidence_state when length(coalesce(e.pdf_url, '')) > 0 then 'processing' else 'metadata-only' end as state
  from e left join papers p on p.id = e.id left join n on n.external_id = e.external_id),
 t as (select *, coalesce(paper_id, 'new:' || external_id) as target from j)
select arg_max(external_id, seq) as external_id, any_value(paper_id) as paper_id, any_value(paper_id) is null as inserted, first(state order by seq) as evidence_state, arg_max(coalesce(citation_count, 0), seq) as citation_count from t where target is not null group by target""")
def persist_results(spark, d):
    i = load(spark, d, "paper_inputs").select("input_id", "id", "title", "citation_count").distinct()
    i = i.select(F.concat(F.lit("a"), "input_id").alias("seq"), "id", F.lit(None).cast("string").alias("doi"), "title", F.lit(None).cast("string").alias("pdf_url"), "citation_count")
    r = load(spark, d, "provider_records").select("id", "doi", "title", "pdf_url", "citation_count").distinct().select(F.concat(F.lit("b"), "id").alias("seq"), "id", "doi", "title", "pdf_url", "citation_count")
    return relational.persist_results(i.unionByName(r), load(spark, d, "papers").select("id", "external_id", "evidence_state", "created_at"))


# ---- sources, sinks, streams ----
_PUBLIC = "length(trim(title)) > 0 and length(trim(abstract)) > 0 and length(trim(authors)) > 0"


@query("csv_jsonl_etl", f"""select trim(id) as id, {_collapse('title')} as title, strftime(created_at, '%Y-%m-%d') as published_date, len([x for x in string_split({_collapse('abstract')}, ' ') if x <> '']) as summary_word_count, sha256({_collapse('abstract')}) as content_hash from papers where {_PUBLIC}""")
def csv_jsonl_etl(spark, d):
    """Papers written as the raw CSV, read strictly, normalised, de-duplicated into JSONL and read back."""
    base = shared_dir(spark)
    p = load(spark, d, "papers").where(_PUBLIC)
    raw = p.select("id", "title", F.col("source").alias("category"), F.lit("x.Y").alias("category_code"), F.date_format("created_at", "M/d/yy").alias("published_date"), F.date_format("created_at", "M/d/yy").alias("updated_date"), "authors", F.lit("first").alias("first_author"), F.col("abstract").alias("summary"), F.lit("0").alias("summary_word_count"))
    raw.write.option("header", True).option("escape", '"').option("quoteAll", True).csv(f"{base}/csv")
    readers.write_jsonl(readers.normalize_corpus(readers.read_corpus_csv(spark, f"{base}/csv")), f"{base}/jsonl", order="id")
    return readers.read_corpus_jsonl(spark, f"{base}/jsonl").select("id", "title", "published_date", "summary_word_count", "content_hash")


_SENT = "(select distinct id, replace(coalesce(content, ''), chr(0), '') as content from paper_documents)"


@query("stream_ingest", f"""with {_chunks_sql(_SENT)} select s.id as document_id, case when length(trim(s.content)) > 0 then 'COMPLETED' else 'FAILED' end as status, case when length(trim(s.content)) > 0 then null else 'no text' end as error, count(c.id) as chunks
 from {_SENT} s left join chunks c on c.id = s.id group by 1, 2, 3""")
def stream_ingest(spark, d):
    """Documents sent as messages, processed by a stream into tables; returns the job states with the chunk counts."""
    base = shared_dir(spark)
    docs = load(spark, d, "paper_documents").select("id", "paper_id", "filename", "content").distinct()
    msgs = docs.select(F.to_json(F.struct(F.concat(F.lit("job-"), "id").alias("job_id"), F.lit("PAPER_PROCESSING").alias("job_type"), "paper_id", F.col("id").alias("document_id"), "filename", "content")).alias("value"))
    msgs.write.text(f"{base}/inbox")
    ingest.ingest(spark, f"{base}/inbox", f"{base}/tables", f"{base}/checkpoint", per_trigger=1000).awaitTermination()
    jobs = spark.read.parquet(f"{base}/tables/background_jobs")
    chunks = spark.read.parquet(f"{base}/tables/document_chunks").groupBy("document_id").agg(F.count("*").alias("chunks"))
    return jobs.select(F.expr("substring(id, 5)").alias("document_id"), "status", "error").join(chunks, "document_id", "left").select("document_id", "status", "error", F.coalesce("chunks", F.lit(0)).alias("chunks"))


@query("semantic_scholar_projection", """select distinct coalesce(nullif(id, ''), nullif(doi, ''), nullif(title, '')) as id, coalesce(nullif(title, ''), 'Untitled paper') as title, coalesce(summary, '') as summary, coalesce(authors_raw, '') as authors_raw,
 case when try_cast(substr(published_date, 1, 4) as integer) <> 0 then cast(try_cast(substr(published_date, 1, 4) as integer) as varchar) end as published_date, coalesce(citation_count, 0) as citation_count, length(coalesce(pdf_url, '')) > 0 as open_access from provider_records""")
def semantic_scholar_projection(spark, d):
    """Records recorded as response pages of the provider, read back through the page source and projected."""
    p = load(spark, d, "provider_records").distinct()
    item = F.struct(F.col("id").alias("paperId"), "title", F.col("summary").alias("abstract"), F.array(F.struct(F.coalesce("authors_raw", F.lit("")).alias("name"))).alias("authors"), F.substring("published_date", 1, 4).try_cast("int").alias("year"), "venue", F.struct(F.col("doi").alias("DOI")).alias("externalIds"), F.col("citation_count").alias("citationCount"), "url", F.struct(F.col("pdf_url").alias("url")).alias("openAccessPdf"))
    path = f"{shared_dir(spark)}/pages"
    pages = p.groupBy(F.pmod(F.xxhash64("id"), F.lit(max(1, p.count() // 10))).alias("page")).agg(F.collect_list(item).alias("data"))  # about ten records a page
    pages.select("data").write.json(path)
    items = readers.read_recorded(spark, path, "data").select(F.from_json("item", readers.SEMANTIC_SCHEMA).alias("i")).select("i.*")
    return readers.from_semantic_scholar(items).select("id", "title", "summary", "authors_raw", "published_date", "citation_count", "open_access").distinct()
