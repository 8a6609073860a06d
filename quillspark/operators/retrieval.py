"""Questions: their type, whether evidence supports them, questions about a paper's own data, extractive answers."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as tx
from ..functions import vocabulary as V


def classify(question: Column) -> Column:
    """One of eleven types by the most signal words, ties by priority; 'general' without any."""
    terms = tx.content_words(question)
    n = {k: F.size(F.array_intersect(terms, tx.strings(w))) for k, w in V.QUESTION_SIGNALS.items()}
    most = F.greatest(*n.values())
    out = F.when(F.contains(F.lower(question), F.lit("future work")), "future_work").when(most == 0, "general")
    for k in V.TYPE_PRIORITY:
        out = out.when(n[k] == most, k)
    return out


def signals_of(kind: Column) -> Column:
    out = F.array().cast("array<string>")
    for k, w in V.QUESTION_SIGNALS.items():
        out = F.when(kind == k, tx.strings(w)).otherwise(out)
    return out


def evidence_supports(questions: DataFrame, chunks: DataFrame, query_keys: list[str], on: list[str] | None = None) -> DataFrame:
    """questions (keys, question), chunks (on, text, section) -> keys, kind, supported.

    ``on``: the keys both sides have (all of them). With fewer, a fixed set of questions meets the chunks by these keys, or
    every chunk with none, and the other keys lie on either side; the questions are then broadcast and nothing is
    shuffled before the aggregate.

    Per chunk booleans, then bool_or per query; a query without chunks is not supported.
    """
    q = questions.withColumn("kind", classify(F.col("question")))
    q = q.withColumn("q_words", tx.content_words(F.col("question"))).withColumn("signals", signals_of(F.col("kind")))
    q = q.withColumn("topic", F.array_except(F.array_except("q_words", tx.strings(V.GENERIC_TERMS)), F.col("signals")))
    compound = F.regexp_extract_all("question", F.lit(r"\b[A-Za-z0-9]+-[A-Za-z0-9]+\b"), F.lit(0))
    q = q.withColumn("compounds", compound).withColumn("roots", tx.content_words(F.array_join("compounds", " ")))
    q = q.withColumn("beyond", F.array_except("topic", "roots"))
    on = query_keys if on is None else on
    own = list(dict.fromkeys([*on, *[k for k in query_keys if k in chunks.columns]]))
    c = chunks.select(*own, F.col("section"), tx.content_words(F.col("text")).alias("c_words"))
    if set(on) == set(query_keys):
        j = q.join(c, on, "left")
    else:  # a fixed set of questions
        j = c.join(F.broadcast(q), on) if on else c.crossJoin(F.broadcast(q))
    hit = lambda col: F.size(F.array_intersect(F.col(col), F.coalesce("c_words", F.array().cast("array<string>"))))
    need = F.when(F.size("topic") <= 2, 1).otherwise(F.ceil(F.size("topic") * 0.35))
    some = lambda cond: F.coalesce(F.bool_or(cond), F.lit(False))
    per = j.groupBy(*query_keys, "kind").agg(
        F.count("c_words").alias("chunks"),
        F.first(F.size("q_words")).alias("n_q"),
        F.first(F.size("topic")).alias("n_topic"),
        F.first(F.size("compounds")).alias("n_compounds"),
        F.first(F.size("roots")).alias("n_roots"),
        F.first(F.size("beyond")).alias("n_beyond"),
        some(hit("topic") >= need).alias("topic_ok"),
        some(hit("roots") > 0).alias("root_ok"),
        some((hit("roots") > 0) & (hit("beyond") > 0)).alias("together_ok"),
        some((hit("signals") > 0) | tx.label_hit(F.col("section"), F.col("kind"), V.PRIMARY_SECTIONS)).alias("signal_ok"),
        some(hit("q_words") > 0).alias("any_ok"),
    )
    col = F.col
    supported = (
        (col("chunks") > 0) & (col("n_q") > 0)
        & ((col("n_topic") == 0) | col("topic_ok"))
        & ((col("n_compounds") == 0) | (((col("n_roots") == 0) | col("root_ok")) & ((col("n_beyond") == 0) | col("together_ok"))))
        & F.when(col("kind").isin("general", "metadata"), col("any_ok")).otherwise(col("signal_ok"))
    )
    return per.select(*query_keys, "kind", supported.alias("supported"))


def metadata_intent(question: Column) -> Column:
    """authors, title, venue, year or doi if the question asks for the paper's own data, else null."""
    q = F.lower(F.trim(question))
    out = None
    for intent in V.METADATA_PHRASES:
        cond = tx.any_contains(q, V.METADATA_PHRASES[intent])
        for p in V.METADATA_PATTERNS[intent]:
            cond = cond | q.rlike(p)
        out = F.when(cond, intent) if out is None else out.when(cond, intent)
    return out.when(F.array_contains(tx.tokens(question), "doi"), "doi")


def metadata_answer(intent: Column, title: Column, authors: Column, venue: Column, year: Column, doi: Column) -> Column:
    """The answer from the paper's own data, null where the field is empty (year 0 counts as empty)."""
    filled = lambda c: F.length(F.trim(c)) > 0
    in_year = F.when(F.coalesce(year, F.lit(0)) != 0, F.concat(F.lit(" ("), year.cast("string"), F.lit(")"))).otherwise("")
    return (
        F.when((intent == "authors") & filled(authors), F.concat(F.lit("The authors of this paper are "), F.trim(authors), F.lit(".")))
        .when((intent == "title") & filled(title), F.concat(F.lit('The title of this paper is: "'), F.trim(title), F.lit('".')))
        .when((intent == "venue") & filled(venue), F.concat(F.lit("This paper was published in "), F.trim(venue), in_year, F.lit(".")))
        .when((intent == "year") & (F.coalesce(year, F.lit(0)) != 0), F.concat(F.lit("This paper was published in "), year.cast("string"), F.lit(".")))
        .when((intent == "doi") & filled(doi), F.concat(F.lit("The DOI of this paper is "), F.trim(doi), F.lit(".")))
    )


def extractive_answer(retrieved: DataFrame, query_keys: list[str]) -> DataFrame:
    """retrieved (keys, question, rank, text, page, section) -> keys, answer.

    Sentences of the retrieved chunks that share most words with the question: three that match, else two;
    900 characters at most; a fixed sentence where nothing can be verified.
    """
    r = retrieved.withColumn("asked", tx.words(F.col("question")))
    r = r.withColumn("substance", F.array_except("asked", tx.strings(V.ANSWER_GENERIC))).withColumn("substance", F.when(F.size("substance") > 0, F.col("substance")).otherwise(F.col("asked")))
    s = r.select(*query_keys, "asked", "substance", "rank", F.posexplode(tx.sentences(F.col("text"), 20)).alias("place", "sentence")).where(~tx.is_boilerplate(F.col("sentence")))
    s = s.withColumn("shared", F.size(F.array_intersect("substance", tx.words(F.col("sentence")))))
    w = Window.partitionBy(*query_keys).orderBy(F.col("shared").desc(), "rank", "place")
    top = s.withColumn("n", F.row_number().over(w)).where("n <= 3")
    most = F.max("shared")
    picked = top.groupBy(*query_keys).agg(F.first("asked").alias("asked"), most.alias("most"), F.sort_array(F.collect_list(F.struct("n", "shared", "sentence"))).alias("s"))
    chosen = F.when(F.col("most") > 0, F.filter("s", lambda x: x["shared"] > 0)).otherwise(F.slice("s", 1, 2))
    picked = picked.withColumn("evidence", F.substring(F.array_join(F.transform(chosen, lambda x: x["sentence"]), " "), 1, 900))
    place = F.when(F.coalesce("page", F.lit(0)) != 0, F.concat(F.lit("Page "), F.col("page").cast("string"), F.lit(", "), F.col("section"))).otherwise(F.col("section"))
    cites = retrieved.where("rank <= 3").groupBy(*query_keys).agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("rank", place.alias("p")))), lambda x: x["p"]), ", ").alias("cites"))
    everyone = retrieved.select(*query_keys).distinct()
    out = everyone.join(picked, query_keys, "left").join(cites, query_keys, "left")
    verified = F.coalesce((F.length("evidence") > 0) & (F.size(F.array_intersect("asked", tx.words(F.col("evidence")))) > 0), F.lit(False))
    answer = F.when(verified, F.concat(F.lit("Based only on the retrieved paper evidence: "), F.col("evidence"), F.lit("\n\nEvidence: "), F.col("cites"))).otherwise(V.CANNOT_VERIFY)
    return out.select(*query_keys, answer.alias("answer"), verified.alias("verified"))


def evidence_pipeline(questions: DataFrame, papers: DataFrame, chunks: DataFrame, paper: str = "paper_id", k: int = 30, shown: int = 6) -> DataFrame:
    """Each question put to each paper: an answer with citations, or an abstention.

    questions: question_id, question, question_vector (a fixed set; it is broadcast). papers: paper, title, authors,
    venue, year, doi, full_text. chunks: paper, id, text, section, page, chunk_index, embedding.
    -> paper, question_id, question, question_type, status, reranker, retrieved, evidence_count, answer, citations.

    Questions about the paper's own data are answered from it where the field is filled. All others take the ``k`` chunks of
    highest hybrid score, of which ``shown`` are kept; without support from these, or without the full text, the answer
    is an abstention and nothing is cited.
    """
    from . import rank

    q = questions.withColumn("intent", metadata_intent(F.col("question"))).withColumn("kind", classify(F.col("question"))).withColumn("q_words", tx.content_words(F.col("question")))
    asked = papers.crossJoin(F.broadcast(q.drop("question_vector", "q_words")))  # a fixed set of questions
    own = metadata_answer(F.col("intent"), F.col("title"), F.col("authors"), F.col("venue"), F.col("year"), F.col("doi"))
    asked = asked.withColumn("own", own).select(paper, "question_id", "question", "kind", "own", "full_text")
    keys = [paper, "question_id"]
    pairs = chunks.withColumn("t_words", tx.content_words(F.col("text"))).crossJoin(F.broadcast(q.drop("intent")))
    scored = rank.hybrid_score(pairs).withColumn("hybrid_score", F.round("hybrid_score", 9))
    kept = rank.topk_per(scored, keys, shown, F.col("hybrid_score").desc(), F.col("chunk_index"), F.col("id")).select(*keys, "question", "rank", "text", "section", "page", "chunk_index")
    backed = evidence_supports(q.select("question_id", "question"), kept.drop("question"), keys, on=["question_id"]).select(*keys, "supported")
    texts = extractive_answer(kept, keys).select(*keys, F.col("answer").alias("extract"))
    cited = kept.groupBy(*keys).agg(F.sort_array(F.collect_list(F.struct("rank", F.concat_ws(":", F.coalesce(F.col("page").cast("string"), F.lit("")), F.coalesce("section", F.lit("")), F.col("chunk_index").cast("string")).alias("c")))).alias("c"))  # ``shown`` at most
    retrieved = chunks.groupBy(paper).agg(F.count("*").alias("candidates"))
    j = asked.join(backed, keys, "left").join(texts, keys, "left").join(cited, keys, "left").join(retrieved, paper, "left")
    meta = F.col("own").isNotNull()
    ok = meta | (F.coalesce("supported", F.lit(False)) & F.col("full_text"))
    grounded = ok & ~meta
    return j.select(
        *keys, "question", F.when(meta, "metadata").otherwise(F.col("kind")).alias("question_type"), F.when(ok, "evidence-backed").otherwise("insufficient-evidence").alias("status"),
        F.when(meta, "metadata-grounded").otherwise("hybrid-fallback").alias("reranker"), F.coalesce("candidates", F.lit(0)).cast("long").alias("retrieved"),
        F.when(grounded, F.size("c")).otherwise(0).cast("long").alias("evidence_count"), F.when(meta, F.col("own")).when(ok, F.col("extract")).otherwise(V.CANNOT_VERIFY).alias("answer"),
        F.when(grounded, F.array_join(F.transform("c", lambda x: x["c"]), ", ")).otherwise("").alias("citations"),
    )


def chat_rows(answers: DataFrame, session: str) -> DataFrame:
    """Two messages an answer, in order: the question without citations and the answer with its own."""
    turns = F.array(F.struct(F.lit("user").alias("role"), F.col("question").alias("content"), F.lit("").alias("citations")), F.struct(F.lit("assistant").alias("role"), F.col("answer").alias("content"), F.col("citations")))
    return answers.select(F.col(session).alias("session_id"), "question_id", F.posexplode(turns).alias("place", "m")).select("session_id", (F.col("question_id") * 2 + F.col("place")).cast("long").alias("turn"), "m.role", "m.content", "m.citations")
