"""Queries of the core over the test tables, each with its oracle in SQL where SQL can express it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import text as tx
from ..functions import vectors as vec
from ..functions import vocabulary as V
from ..operators import analysis, chunking, metrics, rank, relational, retrieval
from ..session import load, spread
from ..sources import readers

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}
TOPIC = "adaptive river delta sensor array ecology"
TOPIC_WORDS = ["adaptive", "river", "delta", "sensor", "array", "ecology"]
QUESTIONS = [
    (1, "Which dataset and samples does the study use for the river delta?"),
    (2, "What method or approach is proposed for the cache policy?"),
    (3, "What are the limitations of the sensor array?"),
    (4, "Which future work is planned for the language model?"),
    (5, "How does Halmar-Shelf data improve the protein fold?"),
    (6, "Who is the author and in which journal did it appear?"),
    (7, "What results and performance were reported for crop yield?"),
    (8, "Is it so?"),
    (9, "How was the model trained and evaluated on glacier flow?"),
    (10, "Which zeppelin telescopes were assembled?"),
]


def query(name: str, oracle: str | None = None):
    def add(f):
        QUERIES[name] = f
        if oracle:
            ORACLES[name] = oracle
        return f

    return add


def _sql_list(words: list[str]) -> str:
    return "[" + ", ".join("'" + w.replace("'", "''") + "'" for w in words) + "]"


def _tokens(e: str) -> str:
    return f"regexp_extract_all(lower(coalesce({e}, '')), '[a-z0-9]+')"


def _words(e: str, stop: list[str] = ()) -> str:
    without = f" and not list_contains({_sql_list(list(stop))}, t)" if stop else ""
    return f"list_distinct([t for t in {_tokens(e)} if length(t) > 2{without}])"


def _score(title: str, hay: str, a: int, b: int) -> str:
    return " + ".join(f"(case when contains(lower({hay}), '{w}') then case when contains(lower({title}), '{w}') then {a} else {b} end else 0 end)" for w in TOPIC_WORDS)


# ---- scans, scores and rankings ----
@query("keyword_topk", f"""
select doc_id, cast(score as integer) as score from (
  select doc_id, ingested_at, {_score("coalesce(title, '')", "concat_ws(' ', coalesce(title, ''), coalesce(text, ''), coalesce(source, ''))", 3, 1)} as score from documents)
where score > 0 order by score desc, coalesce(cast(ingested_at as varchar), '') desc, doc_id limit 10""")
def keyword_topk(spark, d):
    return rank.corpus_topk(load(spark, d, "documents"), TOPIC, "title", ["text", "source"], "ingested_at", "doc_id").select("doc_id", "score")


@query("full_text_scored", f"""
select id, cast(s + 100 as integer) as score from (
  select id, {_score("coalesce(title, '')", "concat_ws(' ', coalesce(title, ''), coalesce(abstract, ''))", 5, 2)} as s from papers where evidence_state = 'full-text' and owner_id is null) where s > 0""")
def full_text_scored(spark, d):
    return rank.full_text_scored(load(spark, d, "papers"), TOPIC).select("id", "score")


def _lists(spark, d):
    papers = load(spark, d, "papers")
    db = rank.full_text_scored(papers, TOPIC).select("id", "title", F.col("abstract").alias("summary"), "doi", "evidence_state", F.coalesce("citation_count", F.lit(0)).alias("citation_count"), "score", F.lit("db").alias("origin"), F.lit(1).alias("o"))
    corpus = papers.where("owner_id is null and (evidence_state <> 'full-text' or evidence_state is null)").select("id", "title", F.col("abstract").alias("summary"), "doi", F.lit(None).cast("string").alias("evidence_state"), "citation_count", F.lit(0).alias("score"), F.lit("corpus").alias("origin"), F.lit(2).alias("o"))
    prov = load(spark, d, "provider_records").distinct().select("id", "title", "summary", "doi", F.lit(None).cast("string").alias("evidence_state"), "citation_count", F.lit(0).alias("score"), F.lit("provider").alias("origin"), F.lit(3).alias("o"))
    # The place in the concatenation: the list, then a hash-free total order within it that fits one long.
    rows = db.unionByName(corpus).unionByName(prov)
    return rows.withColumn("seq", F.col("o").cast("long") * F.lit(1 << 60) + F.conv(F.substring(F.md5(F.concat_ws("|", "id", "title", F.coalesce("doi", F.lit("")))), 1, 14), 16, 10).cast("long"))


_LISTS_SQL = f"""
with db as (select id, title, abstract as summary, doi, evidence_state, coalesce(citation_count, 0) as citation_count, s + 100 as score, 'db' as origin, 1 as o from (
    select *, {_score("coalesce(title, '')", "concat_ws(' ', coalesce(title, ''), coalesce(abstract, ''))", 5, 2)} as s from papers where evidence_state = 'full-text' and owner_id is null) where s > 0),
 lists as (select * from db
  union all select id, title, abstract, doi, null, citation_count, 0, 'corpus', 2 from papers where owner_id is null and (evidence_state <> 'full-text' or evidence_state is null)
  union all select id, title, summary, doi, null, citation_count, 0, 'provider', 3 from (select distinct * from provider_records)),
 keyed as (select *, lower(trim(coalesce(nullif(doi, ''), nullif(title, '')))) as key, coalesce(evidence_state = 'full-text', false) as is_full,
   cast(o as bigint) * 1152921504606846976 + cast('0x' || substr(md5(concat_ws('|', id, title, coalesce(doi, ''))), 1, 14) as bigint) as seq,
   greatest(score, {_score("coalesce(title, '')", "concat_ws(' ', coalesce(title, ''), coalesce(summary, ''))", 3, 1)} + case when coalesce(evidence_state = 'full-text', false) then 100 else 0 end) as total,
   coalesce(citation_count, 0) as cites from lists),
 won as (select *, min(seq) over (partition by key) as first_seq,
   row_number() over (partition by key order by is_full desc, case when is_full then 0 else cites end desc, seq) as n from keyed where key <> '')
"""


@query("federated_merge", _LISTS_SQL + "select key, id, cast(is_full as integer) as is_full, cast(total as integer) as total, cites, origin from won where n = 1")
def federated_merge(spark, d):
    return rank.merge_ranked(_lists(spark, d), TOPIC).select("key", "id", "is_full", "total", "cites", "origin")


@query("federated_topk", _LISTS_SQL + "select key, id, cast(total as integer) as total, origin from won where n = 1 order by is_full desc, total desc, cites desc, first_seq limit 10")
def federated_topk(spark, d):
    return rank.federated_topk(_lists(spark, d), TOPIC).select("key", "id", "total", "origin")


@query("full_text_only_topk", _LISTS_SQL + "select key, id, cast(total as integer) as total from won where n = 1 and is_full order by total desc, cites desc, first_seq limit 10")
def full_text_only_topk(spark, d):
    return rank.federated_topk(_lists(spark, d), TOPIC, full_text_only=True).select("key", "id", "total")


# ---- relational ----
@query("dedupe_keep_first", "select external_id, id from (select *, row_number() over (partition by external_id order by created_at, id) as n from papers where external_id is not null) where n = 1")
def dedupe_keep_first(spark, d):
    return relational.keep_first(load(spark, d, "papers").where("external_id is not null"), "external_id", "created_at", "id").select("external_id", "id")


@query("dedupe_keep_max", "select key, id, citation_count from (select *, row_number() over (partition by key order by coalesce(citation_count, 0) desc, created_at, id) as n from (select *, lower(trim(coalesce(nullif(doi, ''), nullif(title, '')))) as key from papers) where key <> '') where n = 1")
def dedupe_keep_max(spark, d):
    return relational.keep_most_cited(load(spark, d, "papers"), "created_at", "id").select("key", "id", "citation_count")


@query("duplicate_hash_audit", "select sha256(text) as content_hash, count(*) as n from documents where text is not null group by 1 having count(*) > 1")
def duplicate_hash_audit(spark, d):
    return load(spark, d, "documents").where("text is not null").groupBy(F.sha2(F.col("text").cast("binary"), 256).alias("content_hash")).agg(F.count("*").alias("n")).where("n > 1")


@query("visibility_or_filter", "select id, owner_id, evidence_state from papers where owner_id is null or owner_id = (select min(owner_id) from papers)")
def visibility_or_filter(spark, d):
    p = load(spark, d, "papers")
    user = p.agg(F.min("owner_id").alias("user"))
    return relational.visible_to(p.crossJoin(F.broadcast(user)), F.col("user")).select("id", "owner_id", "evidence_state")  # one row


@query("access_violations", "select distinct i.request_id, i.user_id, i.id from paper_inputs i where exists (select 1 from papers p where p.id = i.id and p.owner_id is not null and p.owner_id <> i.user_id)")
def access_violations(spark, d):
    i, p = load(spark, d, "paper_inputs").select("request_id", "user_id", "id").alias("i"), load(spark, d, "papers").where("owner_id is not null").select("id", "owner_id").alias("p")
    return i.join(p, (F.col("i.id") == F.col("p.id")) & (F.col("i.user_id") != F.col("p.owner_id")), "left_semi").distinct()


@query("collection_documents", "select c.id as collection_id, c.name, c.user_id, count(d.doc_id) as n_docs from research_collections c join documents d on d.collection_id = c.id group by 1, 2, 3")
def collection_documents(spark, d):
    docs = load(spark, d, "documents").where("collection_id is not null").groupBy("collection_id").agg(F.count("*").alias("n_docs"))
    return docs.join(load(spark, d, "research_collections").select(F.col("id").alias("collection_id"), "name", "user_id"), "collection_id").select("collection_id", "name", "user_id", "n_docs")


@query("owned_documents", "select distinct d.id, p.id as paper_id, p.owner_id from paper_documents d join papers p on p.id = d.paper_id where p.owner_id is not null")
def owned_documents(spark, d):
    p = load(spark, d, "papers").where("owner_id is not null").select(F.col("id").alias("paper_id"), "owner_id")
    return load(spark, d, "paper_documents").select("id", "paper_id").distinct().join(p, "paper_id").select("id", "paper_id", "owner_id")


@query("first_document_left_join", "select p.id, min(d.id) as document_id from papers p left join paper_documents d on d.paper_id = p.id group by p.id")
def first_document_left_join(spark, d):
    first = load(spark, d, "paper_documents").groupBy("paper_id").agg(F.min("id").alias("document_id"))
    return load(spark, d, "papers").select("id").join(first, F.col("id") == F.col("paper_id"), "left").select("id", "document_id")


@query("ordered_chunks_limit", """select paper_id, chunk_index, id from (
 select d.paper_id, c.chunk_index, c.id, row_number() over (partition by d.paper_id order by c.chunk_index, c.id) as n
 from (select distinct id, document_id, chunk_index from document_chunks) c join (select distinct id, paper_id from paper_documents) d on d.id = c.document_id) where n <= 200""")
def ordered_chunks_limit(spark, d):
    docs = load(spark, d, "paper_documents").select(F.col("id").alias("document_id"), "paper_id").distinct()
    c = load(spark, d, "document_chunks").select("id", "document_id", "chunk_index").distinct().join(docs, "document_id")
    return rank.topk_per(c, ["paper_id"], 200, F.col("chunk_index"), F.col("id")).select("paper_id", "chunk_index", "id")


@query("papers_without_documents", "select id from papers where id not in (select paper_id from paper_documents where paper_id is not null)")
def papers_without_documents(spark, d):
    return load(spark, d, "papers").select("id").join(load(spark, d, "paper_documents").select(F.col("paper_id").alias("id")), "id", "left_anti")


@query("selected_papers", "select id, coalesce(title, '') as title, coalesce(citation_count, 0) as citations from papers where id in (select id from paper_inputs)")
def selected_papers(spark, d):
    p = load(spark, d, "papers").join(load(spark, d, "paper_inputs").select("id").distinct(), "id", "left_semi")
    return p.select("id", F.coalesce("title", F.lit("")).alias("title"), F.coalesce("citation_count", F.lit(0)).alias("citations"))


@query("latest_per_key", "select external_id, id, created_at from (select *, row_number() over (partition by external_id order by created_at desc, id) as n from papers where external_id is not null) where n = 1")
def latest_per_key(spark, d):
    p = load(spark, d, "papers").where("external_id is not null")
    return rank.topk_per(p, ["external_id"], 1, F.col("created_at").desc(), F.col("id")).select("external_id", "id", "created_at")


@query("latest_job_state", "select user_id, event_id, event_type from (select *, row_number() over (partition by user_id order by ts desc, event_id desc) as n from events) where n = 1")
def latest_job_state(spark, d):
    return rank.topk_per(load(spark, d, "events"), ["user_id"], 1, F.col("ts").desc(), F.col("event_id").desc()).select("user_id", "event_id", "event_type")


@query("json_path_filter", "select event_id, cast(json_extract_string(props, '$.k') as integer) as k from events where cast(json_extract_string(props, '$.k') as integer) > 90")
def json_path_filter(spark, d):
    k = F.get_json_object("props", "$.k").try_cast("int") if hasattr(F.col("x"), "try_cast") else F.get_json_object("props", "$.k").cast("int")
    return load(spark, d, "events").select("event_id", k.alias("k")).where("k > 90")


@query("conditional_insert", "select c_custkey as user_id from customer c where not exists (select 1 from events e where e.user_id = c.c_custkey and e.event_type = 'error')")
def conditional_insert(spark, d):
    """A job for every customer who has none in the state of an error yet."""
    jobs = load(spark, d, "events").where("event_type = 'error'").select("user_id")
    return relational.insert_unless(jobs, load(spark, d, "customer").select(F.col("c_custkey").alias("user_id")), ["user_id"])


@query("upsert_merge", """with u as (select id, max(citation_count) as c from paper_inputs where citation_count > 0 and id is not null group by id)
select coalesce(p.id, u.id) as id, p.source, coalesce(u.c, p.citation_count) as citation_count, p.id is null as inserted from papers p full outer join u on u.id = p.id""")
def upsert_merge(spark, d):
    u = load(spark, d, "paper_inputs").where("citation_count > 0 and id is not null").groupBy("id").agg(F.max("citation_count").alias("citation_count"))
    return relational.upsert(load(spark, d, "papers").select("id", "source", "citation_count"), u, "id", ["citation_count"]).select("id", "source", "citation_count", "inserted")


@query("replace_chunks", """select document_id, count(*) as n, count(*) filter (where section = 'Replaced') as replaced from (
 select document_id, section from (select distinct id, document_id, section, chunk_index from document_chunks) where document_id not in (select id from paper_documents where content is null)
 union all select distinct id, 'Replaced' from paper_documents where content is null) group by document_id""")
def replace_chunks(spark, d):
    base = load(spark, d, "document_chunks").select("id", "document_id", "section", "chunk_index").distinct().drop("id", "chunk_index")
    new = load(spark, d, "paper_documents").where("content is null").select(F.col("id").alias("document_id"), F.lit("Replaced").alias("section")).distinct()
    return relational.replace_by(base, new, "document_id").groupBy("document_id").agg(F.count("*").alias("n"), F.count_if(F.col("section") == "Replaced").alias("replaced"))


@query("cascade_delete_counts", """with doomed as (select id from papers where source = 'upload'), dd as (select distinct id from paper_documents where paper_id in (select id from doomed))
select 'papers' as tbl, count(*) as n from papers where id not in (select id from doomed)
union all select 'paper_documents', count(*) from paper_documents where paper_id is null or paper_id not in (select id from doomed)
union all select 'document_chunks', count(*) from document_chunks where document_id is null or document_id not in (select id from dd)""")
def cascade_delete_counts(spark, d):
    tables = {t: load(spark, d, t) for t in ("papers", "paper_documents", "document_chunks")}
    left = relational.cascade_delete(tables, "papers", tables["papers"].where("source = 'upload'").select("id"), [("paper_documents", "paper_id", "papers", "id"), ("document_chunks", "document_id", "paper_documents", "id")])
    parts = [df.agg(F.count("*").alias("n")).select(F.lit(t).alias("tbl"), "n") for t, df in left.items()]
    return parts[0].unionByName(parts[1]).unionByName(parts[2])


@query("upload_registration", """select distinct substr(sha256(d.content), 1, 16) as external_id, p.owner_id from paper_documents d join papers p on p.id = d.paper_id
where d.content is not null and p.owner_id is not null and not exists (select 1 from papers q where q.external_id = substr(sha256(d.content), 1, 16) and q.owner_id = p.owner_id)""")
def upload_registration(spark, d):
    p = load(spark, d, "papers")
    files = load(spark, d, "paper_documents").where("content is not null").join(p.where("owner_id is not null").select(F.col("id").alias("paper_id"), "owner_id"), "paper_id").select("owner_id", "content")
    return relational.uploads_to_register(files, p).select("external_id", "owner_id").distinct()


@query("recency_lists", "select user_id, id, cast(n as integer) as place from (select *, row_number() over (partition by user_id order by created_at desc, id) as n from research_collections)")
def recency_lists(spark, d):
    return rank.topk_per(load(spark, d, "research_collections"), ["user_id"], 1 << 30, F.col("created_at").desc(), F.col("id")).select("user_id", "id", F.col("rank").alias("place"))


@query("collection_crud", """with c as (select id, case when user_id = (select min(user_id) from research_collections) then 'Renamed' else name end as name, user_id from research_collections where user_id <> (select max(user_id) from research_collections)) select id, name, user_id from c""")
def collection_crud(spark, d):
    c = load(spark, d, "research_collections")
    ends = c.agg(F.min("user_id").alias("first_user"), F.max("user_id").alias("last_user"))
    return c.crossJoin(F.broadcast(ends)).where("user_id <> last_user").select("id", F.when(F.col("user_id") == F.col("first_user"), "Renamed").otherwise(F.col("name")).alias("name"), "user_id")  # one row


@query("point_lookup", "select id, title from papers where id = (select min(id) from papers)")
def point_lookup(spark, d):
    p = load(spark, d, "papers")
    return p.join(F.broadcast(p.agg(F.min("id").alias("id"))), "id").select("id", "title")  # one row


@query("library_search", "select id, title from papers where (contains(lower(coalesce(title, '')), 'ecology') or contains(lower(coalesce(authors, '')), 'ecology') or contains(lower(coalesce(venue, '')), 'ecology')) and evidence_state = 'full-text'")
def library_search(spark, d):
    low = lambda c: F.contains(F.lower(F.coalesce(c, F.lit(""))), F.lit("ecology"))
    return load(spark, d, "papers").where((low("title") | low("authors") | low("venue")) & (F.col("evidence_state") == "full-text")).select("id", "title")


@query("library_metrics", "select count(*) as total, count(*) filter (where evidence_state = 'full-text') as full_text, cast(coalesce(sum(citation_count), 0) as bigint) as citations, cast(round(count(*) filter (where evidence_state = 'full-text') * 100.0 / count(*)) as integer) as percent from papers")
def library_metrics(spark, d):
    return metrics.library_metrics(load(spark, d, "papers"))


_AFTER_TITLE = "substr(text, length(coalesce(title, '')) + 1)"


@query("term_set_difference", f"select doc_id, array_to_string(list_sort([t for t in {_words('title', V.STOP_WORDS)} if not list_contains({_tokens(_AFTER_TITLE)}, t)]), ' ') as terms from documents where title is not null")
def term_set_difference(spark, d):
    rest = F.expr("substring(text, length(coalesce(title, '')) + 1)")
    return load(spark, d, "documents").where("title is not null").select("doc_id", F.array_join(F.array_sort(F.array_except(tx.content_words(F.col("title")), tx.tokens(rest))), " ").alias("terms"))


@query("capped_union", "select distinct id from (select id from papers where evidence_state = 'full-text' union select id from paper_inputs) where id is not null order by id limit 15")
def capped_union(spark, d):
    u = load(spark, d, "papers").where("evidence_state = 'full-text'").select("id").unionByName(load(spark, d, "paper_inputs").select("id")).where("id is not null").distinct()
    return rank.topk(u, 15, F.col("id"))


# ---- text ----
_PLAIN_BOILERPLATE = [p for p in V.BOILERPLATE if "\\" not in p]


@query("boilerplate_filter", "select doc_id, regexp_matches(lower(t), '" + "|".join(V.BOILERPLATE) + f"') as is_boilerplate from (select doc_id, coalesce(text, '') || case when doc_id % 3 = 0 then ' ' || upper({_sql_list(_PLAIN_BOILERPLATE)}[cast(doc_id % {len(_PLAIN_BOILERPLATE)} as integer) + 1]) else '' end as t from documents)")
def boilerplate_filter(spark, d):
    """Every third document gets one of the phrases."""
    phrase = F.element_at(tx.strings(_PLAIN_BOILERPLATE), (F.col("doc_id") % len(_PLAIN_BOILERPLATE)).cast("int") + 1)
    t = F.concat(F.coalesce("text", F.lit("")), F.when(F.col("doc_id") % 3 == 0, F.concat(F.lit(" "), F.upper(phrase))).otherwise(""))
    return load(spark, d, "documents").select("doc_id", tx.is_boilerplate(t).alias("is_boilerplate"))


@query("nul_audit", "select doc_id, length(text) - length(replace(text, chr(0), '')) as nuls, case when contains(text, chr(0)) then 'nul' end as reason from documents where text is not null")
def nul_audit(spark, d):
    return load(spark, d, "documents").where("text is not null").select("doc_id", tx.nul_count(F.col("text")).cast("long").alias("nuls"), tx.text_invalid_reason(F.col("text")).alias("reason"))


@query("normalized_text", "select doc_id, sha256(replace(coalesce(text, ''), chr(0), '')) as digest, sha256(replace(coalesce(text, ''), chr(0), '')) as repaired from documents")
def normalized_text(spark, d):
    """Digests of the normalised text, and of what the repair makes of the same text read with the wrong encoding."""
    digest = lambda c: F.sha2(tx.normalize_text(c).cast("binary"), 256)
    broken = F.decode(F.encode("text", "UTF-8"), "ISO-8859-1")
    return load(spark, d, "documents").select("doc_id", digest(F.col("text")).alias("digest"), digest(broken).alias("repaired"))


@query("domain_flags", "select id, " + ", ".join(f"({' or '.join(f'''contains(t, '{p}')''' for p in parts)}) as is_{k}" for k, parts in V.DOMAINS.items()) + " from (select id, lower(concat_ws(' ', coalesce(title, ''), coalesce(abstract, ''))) as t from papers)")
def domain_flags(spark, d):
    t = F.concat_ws(" ", F.coalesce("title", F.lit("")), F.coalesce("abstract", F.lit("")))
    return load(spark, d, "papers").select("id", *[c.alias(k) for k, c in tx.domain_flags(t).items()])


@query("word_windows", """with w as (select doc_id, [x for x in regexp_split_to_array(regexp_replace(coalesce(text, ''), '[\\s\\x0b\\x1c-\\x1f\\x85\\x{a0}\\x{1680}\\x{2000}-\\x{200a}\\x{2028}\\x{2029}\\x{202f}\\x{205f}\\x{3000}]+', ' ', 'g'), ' ') if x <> ''] as w from documents)
select doc_id, cast(i as integer) as chunk_index, array_to_string(w[i * 220 + 1 : i * 220 + 220], ' ') as text from (select doc_id, w, unnest(range(0, cast(ceil(len(w) / 220.0) as bigint))) as i from w where len(w) > 0)""")
def word_windows(spark, d):
    return chunking.word_windows(load(spark, d, "documents"), ["doc_id"], "text")


@query("inverted_index_roundtrip", "select doc_id, array_to_string(regexp_extract_all(lower(text), '[a-z0-9]+'), ' ') as rebuilt from documents where len(regexp_extract_all(lower(text), '[a-z0-9]+')) > 0")
def inverted_index_roundtrip(spark, d):
    docs = load(spark, d, "documents").select("doc_id", F.posexplode(tx.tokens(F.col("text"))).alias("p", "w"))
    index = docs.groupBy("doc_id", "w").agg(F.collect_list("p").alias("ps")).groupBy("doc_id").agg(F.map_from_entries(F.collect_list(F.struct("w", "ps"))).alias("index"))
    return index.select("doc_id", readers.inverted_index_text(F.col("index")).alias("rebuilt"))


# ---- collections ----
_PAPER_TERMS = _words("concat_ws(' ', coalesce(title, ''), coalesce(abstract, ''))", V.COLLECTION_STOP_WORDS)


@query("term_document_frequency", f"select term, count(*) as df from (select unnest({_PAPER_TERMS}) as term from papers) group by term")
def term_document_frequency(spark, d):
    return analysis.term_document_frequency(load(spark, d, "papers"), "title", "abstract")


@query("top_terms", f"select term, count(*) as df from (select unnest({_PAPER_TERMS}) as term from papers) group by term order by df desc, term limit 18")
def top_terms(spark, d):
    return rank.topk(analysis.term_document_frequency(load(spark, d, "papers"), "title", "abstract"), 18, F.col("df").desc(), F.col("term"))


@query("publication_years", "with y as (select cast(year as varchar) as year, count(*) as n from papers where year <> 0 group by 1) select year, n, cast(round(n * 100.0 / greatest(max(n) over (), 1)) as integer) as percent from y")
def publication_years(spark, d):
    return analysis.publication_years(load(spark, d, "papers"), "year")


@query("year_span", "select min(cast(year as varchar)) as first_year, max(cast(year as varchar)) as last_year, count(*) as papers from papers where year <> 0")
def year_span(spark, d):
    return load(spark, d, "papers").where("year <> 0").agg(F.min(F.col("year").cast("string")).alias("first_year"), F.max(F.col("year").cast("string")).alias("last_year"), F.count("*").alias("papers"))


@query("shared_terms", f"""with i as (select distinct request_id, pos, title, summary as abstract from paper_inputs), t as (select request_id, pos, unnest({_PAPER_TERMS}) as term from i),
 n as (select request_id, count(distinct pos) as papers from t group by 1), c as (select t.request_id, term from t join n on n.request_id = t.request_id group by t.request_id, term, papers having count(distinct pos) = papers),
 r as (select *, row_number() over (partition by request_id order by length(term) desc, term) as n from c)
select request_id, string_agg(term, ' ' order by n) as terms from r where n <= 10 group by 1""")
def shared_terms(spark, d):
    i = load(spark, d, "paper_inputs").select("request_id", "pos", "title", "summary").distinct()
    return analysis.shared_terms(i, "request_id", "pos", "title", "summary").select("request_id", F.array_join("terms", " ").alias("terms"))


@query("comparison_rows", "select distinct request_id, pos, coalesce(title, 'Untitled') as paper, year, venue, coalesce(citation_count, 0) as citations, coalesce(authors, '') as authors, substr(coalesce(summary, ''), 1, 600) as evidence from paper_inputs")
def comparison_rows(spark, d):
    return load(spark, d, "paper_inputs").select("request_id", "pos", F.coalesce("title", F.lit("Untitled")).alias("paper"), "year", "venue", F.coalesce("citation_count", F.lit(0)).alias("citations"), F.coalesce("authors", F.lit("")).alias("authors"), F.substring(F.coalesce("summary", F.lit("")), 1, 600).alias("evidence")).distinct()


@query("similarity_edges", """with v as (select distinct i.request_id, i.id, c.embedding from paper_inputs i join (select distinct id, paper_id from paper_documents) d on d.paper_id = i.id
  join (select document_id, embedding, row_number() over (partition by document_id order by chunk_index, id) as n from document_chunks where len(embedding) = 384) c on c.document_id = d.id and c.n = 1),
 one as (select request_id, id, any_value(embedding) as e from (select request_id, id, embedding, row_number() over (partition by request_id, id order by cast(embedding as varchar)) as n from v) where n = 1 group by 1, 2),
 p as (select x.request_id, x.id as a, y.id as b, list_dot_product(cast(x.e as double[]), cast(y.e as double[])) as w from one x join one y on x.request_id = y.request_id and x.id < y.id)
select request_id, a, b, round(w, 4) as weight from p where w >= 0.25""")
def similarity_edges(spark, d):
    first = rank.topk_per(load(spark, d, "document_chunks").where("size(embedding) = 384"), ["document_id"], 1, F.col("chunk_index"), F.col("id")).select("document_id", "embedding")
    docs = load(spark, d, "paper_documents").select(F.col("id").alias("document_id"), F.col("paper_id").alias("id")).distinct()
    v = load(spark, d, "paper_inputs").select("request_id", "id").distinct().join(docs, "id").join(first, "document_id")
    one = v.groupBy("request_id", "id").agg(F.min_by("embedding", F.concat(F.lit("["), F.array_join("embedding", ", "), F.lit("]"))).alias("e"))
    return analysis.similarity_edges(one, "request_id", "id", "e")


@query("titled_similarity_edges", ORACLES["similarity_edges"].replace("select request_id, a, b, round(w, 4) as weight from p where w >= 0.25", "select request_id, a, b, round(w, 4) as weight, x.title as a_title, y.title as b_title from p left join papers x on x.id = a left join papers y on y.id = b where w >= 0.25"))
def titled_similarity_edges(spark, d):
    return analysis.titled_edges(similarity_edges(spark, d), load(spark, d, "papers"), "id", "title").select("request_id", "a", "b", "weight", "a_title", "b_title")


@query("object_keys", "select distinct id, 'papers/' || 'public' || '/' || coalesce(paper_id, '') || '/' || case when f = '' then 'document.pdf' else f end as object_key from (select id, paper_id, substr(regexp_replace(regexp_extract(coalesce(filename, ''), '([^/]*)/*$', 1), '[^a-zA-Z0-9_.-]', '_', 'g'), 1, 200) as f from paper_documents)")
def object_keys(spark, d):
    return load(spark, d, "paper_documents").select("id", tx.object_key(F.lit(None).cast("string"), F.coalesce("paper_id", F.lit("")), F.col("filename")).alias("object_key")).distinct()


@query("analysis_summary", r"""with b as (select id, trim(regexp_replace(coalesce(abstract, ''), '[\s\x{a0}]+', ' ', 'g')) as t, coalesce(title, '') as title from papers),
 c as (select id, title, case when t = '' then 'Academic publication titled: ' || title || '.' else t end as t from b),
 s as (select id, title, t, [trim(x) for x in string_split(regexp_replace(t, '([.!?])\s+([A-Z0-9])', '\1' || chr(1) || '\2', 'g'), chr(1)) if length(trim(x)) > 18] as s from c)
select id, case when length(t) > 40 then case when len(s) > 0 then array_to_string(s[1:5], ' ') else substr(t, 1, 500) end else 'Academic study addressing ' || title || '.' end as analysis_summary,
 array_to_string([x for x in s if regexp_matches(x, '(?i)\b(""" + V.METHOD_WORDS + r""")\b')][1:2], ' ') as method_sentences,
 cast(case when length(t) > 300 then 0.85 else 0.70 end as double) as confidence from s""")
def analysis_summary(spark, d):
    return analysis.heuristic_analysis(load(spark, d, "papers"), "title", "abstract").select("id", "analysis_summary", "method_sentences", "confidence")


# ---- retrieval ----
def _questions(spark):
    return spark.createDataFrame(QUESTIONS, "question_id int, question string")


_Q_SQL = "(values " + ", ".join(f"({i}, '{q}')" for i, q in QUESTIONS) + ") as q(question_id, question)"
_CLASSIFY = "case when contains(lower(question), 'future work') then 'future_work' when greatest({n}) = 0 then 'general' {w} end".format(
    n=", ".join(f"n_{k}" for k in V.QUESTION_SIGNALS), w=" ".join(f"when n_{k} = greatest({', '.join(f'n_{x}' for x in V.QUESTION_SIGNALS)}) then '{k}'" for k in V.TYPE_PRIORITY)
)
_COUNTS = ", ".join(f"len(list_intersect(q_words, {_sql_list(w)})) as n_{k}" for k, w in V.QUESTION_SIGNALS.items())


def _kinds(source: str, cols: str) -> str:
    return f"(select {cols}, q_words, {_CLASSIFY} as kind from (select *, {_COUNTS} from (select {cols}, {_words('question', V.STOP_WORDS)} as q_words from {source})))"


@query("question_types", f"select question_id, kind from {_kinds(_Q_SQL, 'question_id, question')} union all select cast(item_id + 1000 as integer), kind from {_kinds('(select item_id, text as question from benchmark)', 'item_id, question')}")
def question_types(spark, d):
    q = _questions(spark).unionByName(load(spark, d, "benchmark").select((F.col("item_id") + 1000).cast("int").alias("question_id"), F.col("text").alias("question")))
    return q.select("question_id", retrieval.classify(F.col("question")).alias("kind"))


def _question_chunks(spark, d):
    c = load(spark, d, "document_chunks").select("id", "document_id", "text", "section", "chunk_index", "page").where("length(trim(text)) > 0").distinct()
    return _questions(spark), c


_SIGNALS_SQL = "case kind " + " ".join(f"when '{k}' then {_sql_list(w)}" for k, w in V.QUESTION_SIGNALS.items()) + " else [] end"
_LABEL = lambda m: "case kind " + " ".join(f"when '{k}' then ({' or '.join(f'''contains(sec, '{p}')''' for p in parts)})" for k, parts in m.items()) + " else false end"


@query("evidence_supports", f"""with q as (select *, {_SIGNALS_SQL} as signals from {_kinds(_Q_SQL, 'question_id, question')}),
 q2 as (select *, [t for t in q_words if not list_contains({_sql_list(V.GENERIC_TERMS)}, t) and not list_contains(signals, t)] as topic,
   regexp_extract_all(question, '\\b[A-Za-z0-9]+-[A-Za-z0-9]+\\b') as compounds from q),
 q3 as (select *, {_words("array_to_string(compounds, ' ')", V.STOP_WORDS)} as roots from q2),
 q4 as (select *, [t for t in topic if not list_contains(roots, t)] as beyond from q3),
 c as (select document_id, lower(coalesce(section, '')) as sec, {_words('text', V.STOP_WORDS)} as cw from (select distinct id, document_id, text, section, chunk_index, page from document_chunks where length(trim(text)) > 0)),
 h as (select question_id, document_id, kind, len(q_words) as n_q, len(topic) as n_topic, len(compounds) as n_c, len(roots) as n_r, len(beyond) as n_b,
   len(list_intersect(topic, cw)) >= case when len(topic) <= 2 then 1 else ceil(len(topic) * 0.35) end as topic_ok, len(list_intersect(roots, cw)) > 0 as root_ok, len(list_intersect(beyond, cw)) > 0 as beyond_ok,
   (len(list_intersect(signals, cw)) > 0 or {_LABEL(V.PRIMARY_SECTIONS)}) as signal_ok, len(list_intersect(q_words, cw)) > 0 as any_ok from q4, c),
 g as (select question_id, document_id, kind, any_value(n_q) as n_q, any_value(n_topic) as n_topic, any_value(n_c) as n_c, any_value(n_r) as n_r, any_value(n_b) as n_b, bool_or(topic_ok) as topic_ok, bool_or(root_ok) as root_ok,
   bool_or(root_ok and beyond_ok) as together_ok, bool_or(signal_ok) as signal_ok, bool_or(any_ok) as any_ok from h group by 1, 2, 3)
select question_id, kind, count(*) as documents, count(*) filter (where n_q > 0 and (n_topic = 0 or topic_ok) and (n_c = 0 or ((n_r = 0 or root_ok) and (n_b = 0 or together_ok))) and case when kind in ('general', 'metadata') then any_ok else signal_ok end) as supported from g group by 1, 2""")
def evidence_supports(spark, d):
    q, c = _question_chunks(spark, d)
    per = retrieval.evidence_supports(q, spread(c), ["document_id", "question_id"], on=[])
    return per.groupBy("question_id", "kind").agg(F.count("*").alias("documents"), F.count_if("supported").alias("supported"))


@query("metadata_intents", "select question_id, case " + " ".join(f"when {' or '.join([f'''contains(q, '{p}')''' for p in V.METADATA_PHRASES[k]] + [f'''regexp_matches(q, '{p}')''' for p in V.METADATA_PATTERNS[k]])} then '{k}'" for k in V.METADATA_PHRASES) + f" when list_contains(regexp_extract_all(q, '[a-z0-9]+'), 'doi') then 'doi' end as intent from (select question_id, lower(trim(question)) as q from {_Q_SQL})")
def metadata_intents(spark, d):
    return _questions(spark).select("question_id", retrieval.metadata_intent(F.col("question")).alias("intent"))


@query("metadata_answers", """select id, intent, case intent when 'authors' then case when length(trim(authors)) > 0 then 'The authors of this paper are ' || trim(authors) || '.' end
 when 'title' then case when length(trim(title)) > 0 then 'The title of this paper is: "' || trim(title) || '".' end
 when 'venue' then case when length(trim(venue)) > 0 then 'This paper was published in ' || trim(venue) || case when coalesce(year, 0) <> 0 then ' (' || year || ')' else '' end || '.' end
 when 'year' then case when coalesce(year, 0) <> 0 then 'This paper was published in ' || year || '.' end
 when 'doi' then case when length(trim(doi)) > 0 then 'The DOI of this paper is ' || trim(doi) || '.' end end as answer from papers, (values ('authors'), ('title'), ('venue'), ('year'), ('doi')) as i(intent)""")
def metadata_answers(spark, d):
    p = load(spark, d, "papers").withColumn("intent", F.explode(tx.strings(["authors", "title", "venue", "year", "doi"])))
    return p.select("id", "intent", retrieval.metadata_answer(F.col("intent"), F.col("title"), F.col("authors"), F.col("venue"), F.col("year"), F.col("doi")).alias("answer"))


# ---- vectors and measures ----
_RANKED_SQL = """with r as (select q.vec_id as query_id, e.vec_id, cast(e.label = q.label as integer) as relevant, q.label,
   row_number() over (partition by q.vec_id order by round(list_dot_product(cast(q.embedding as double[]), cast(e.embedding as double[])), 6) desc, e.vec_id) as rank
 from embeddings q, embeddings e where q.vec_id % 100 = 0 and e.vec_id <> q.vec_id)"""


def _ranked_vectors(spark, d, k):
    """A stated query set (ids divisible by 100) against all vectors."""
    e = load(spark, d, "embeddings").select("vec_id", F.col("embedding").alias("v"))
    ranked = vec.blocked_topk(e.where("vec_id % 100 = 0").select(F.col("vec_id").alias("query_id"), F.col("v").alias("q")), e, k)
    labels = load(spark, d, "embeddings").select("vec_id", "label")
    own = labels.select(F.col("vec_id").alias("query_id"), F.col("label").alias("q_label"))
    return ranked.join(labels, "vec_id").join(own, "query_id").select("query_id", "vec_id", "rank", (F.col("label") == F.col("q_label")).cast("int").alias("relevant"))


@query("vector_topk", _RANKED_SQL + " select query_id, vec_id, cast(rank as integer) as rank from r where rank <= 5")
def vector_topk(spark, d):
    return _ranked_vectors(spark, d, 5).select("query_id", "vec_id", "rank")


_IR_SQL = _RANKED_SQL + """, t as (select r.*, (select count(*) - 1 from embeddings x where x.label = r.label) as n from r where rank <= 10),
 i as (select k, (select sum(1 / log2(j + 1)) from range(1, k + 1) as g(j)) as ideal from range(1, 11) as h(k)),
 m as (select query_id, max(n) as n, max(case when rank <= 1 then relevant else 0 end) as h1, max(case when rank <= 3 then relevant else 0 end) as h3, max(case when rank <= 5 then relevant else 0 end) as h5, max(relevant) as h10,
   coalesce(1.0 / min(case when relevant = 1 then rank end), 0) as rr, sum(case when rank <= 5 then relevant / log2(rank + 1) else 0 end) as d5, sum(relevant / log2(rank + 1)) as d10,
   sum(case when rank <= 5 then relevant else 0 end) as r5, count(*) filter (where rank <= 5) as c5 from t group by 1)
select count(*) as queries, round(avg(h1), 6) as hit_1, round(avg(h3), 6) as hit_3, round(avg(h5), 6) as hit_5, round(avg(h10), 6) as hit_10, round(avg(rr), 6) as rr,
 round(avg(case when n = 0 then 1 else d5 / (select ideal from i where k = greatest(least(n, 5), 1)) end), 6) as ndcg_5, round(avg(case when n = 0 then 1 else d10 / (select ideal from i where k = greatest(least(n, 10), 1)) end), 6) as ndcg_10,
 round(avg(r5 / c5), 6) as precision_5, round(avg(case when n = 0 then 0 else r5 / n end), 6) as recall_5 from m"""


@query("ir_metrics", _IR_SQL)
def ir_metrics(spark, d):
    e = load(spark, d, "embeddings")
    expected = e.groupBy("label").agg((F.count("*") - 1).alias("expected"))
    mine = e.where("vec_id % 100 = 0").select(F.col("vec_id").alias("query_id"), "label").join(expected, "label").select("query_id", "expected")
    ranked = _ranked_vectors(spark, d, 10).join(mine, "query_id")
    return metrics.mean_metrics(metrics.per_query_metrics(ranked, "query_id", "relevant", "expected"))


@query("latency_summary", """with s as (select event_type, value, row_number() over (partition by event_type order by value) - 1 as i, count(*) over (partition by event_type) as n from events where value is not null)
select event_type, max(n) as n, min(value) as least, max(value) as most, max(case when i = floor(0.5 * (n - 1)) then value end) as p50, max(case when i = floor(0.95 * (n - 1)) then value end) as p95, max(case when i = floor(0.99 * (n - 1)) then value end) as p99 from s group by event_type""")
def latency_summary(spark, d):
    return metrics.latency_summary(load(spark, d, "events"), "event_type", "value")


@query("hash_embeddings")
def hash_embeddings(spark, d):
    return load(spark, d, "documents").select("doc_id", vec.hash_embedding("text").alias("embedding"))


@query("hybrid_topk_hashed")
def hybrid_topk_hashed(spark, d):
    """The full pipeline: section chunks, hashed embeddings, hybrid score, rerank fallback."""
    c = chunking.section_chunks(load(spark, d, "paper_documents").dropDuplicates(["id"]), ["id"], "content").withColumn("embedding", vec.hash_embedding("text"))
    q = _questions(spark).withColumn("question_vector", vec.hash_embedding("question"))
    pairs = c.crossJoin(F.broadcast(q))  # ten questions
    top = rank.hybrid_retrieve(pairs, ["question_id"], 30, ties=["id", "chunk_index"])
    return rank.rerank(top).select("question_id", "rank", "id", "chunk_index", "kind", "reranker")


# ---- sources, sinks, streams ----
@query("provider_union", "select source, count(*) as n, count(doi) as with_doi from (select distinct * from provider_records) group by source")
def provider_union(spark, d):
    p = load(spark, d, "provider_records").distinct()
    return readers.provider_union(p.where("source = 'OpenAlex'"), p.where("source <> 'OpenAlex'")).groupBy("source").agg(F.count("*").alias("n"), F.count("doi").alias("with_doi"))


@query("openalex_projection", "select distinct doi, coalesce(nullif(title, ''), 'Untitled paper') as title, coalesce(authors_raw, '') as authors_raw, venue, coalesce(citation_count, 0) as citation_count, coalesce(nullif(doi, ''), url) as url, pdf_url, coalesce(open_access, false) as open_access from provider_records")
def openalex_projection(spark, d):
    """Records written in the provider's own nested form and projected back."""
    p = load(spark, d, "provider_records").distinct()
    nested = p.select(
        F.concat(F.lit("https://provider.invalid/"), "id").alias("id"), "title", F.create_map().cast("map<string,array<int>>").alias("abstract_inverted_index"),
        F.array(F.struct(F.struct(F.coalesce("authors_raw", F.lit("")).alias("display_name")).alias("author"))).alias("authorships"), F.col("published_date").alias("publication_date"), "doi", F.col("citation_count").alias("cited_by_count"),
        F.struct(F.struct(F.col("venue").alias("display_name")).alias("source")).alias("primary_location"),
        F.array(F.struct(F.lit(False).alias("is_oa"), F.lit("https://closed.invalid").alias("landing_page_url"), F.lit(None).cast("string").alias("pdf_url")), F.struct(F.lit(True).alias("is_oa"), F.col("url").alias("landing_page_url"), "pdf_url")).alias("locations"),
        F.struct(F.col("open_access").alias("is_oa")).alias("open_access"),
    )
    return readers.from_openalex(nested).select("doi", "title", "authors_raw", "venue", "citation_count", "url", "pdf_url", "open_access").distinct()
