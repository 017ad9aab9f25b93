"""Registered queries over the test tables, each over its whole tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..config import EngineConfig
from ..functions import text as T
from ..operators import activation, audit, delivery, dense, evaluation, filters, grades, keyedit, lexical, lineage, matching, ranking, relevance, scenes, studies, suggest
from ..sources import bundles, index
from ..session import stored, table
from ..streaming import latches
from . import smartkeys as S

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
CFG = EngineConfig()


def query(f: Callable[[SparkSession, str], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
    QUERIES[f.__name__] = f
    return f


def _entries(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "book_entries")


def _messages(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "chat_messages")


def _live(spark: SparkSession, d: str) -> DataFrame:
    return _messages(spark, d).filter("NOT coalesce(is_system, false) AND coalesce(mes, '') <> ''")


def _signals(spark: SparkSession, d: str) -> DataFrame:
    """Graded rows with their grade in force and two plain signals."""
    items, raters = table(spark, d, "graded_entries"), table(spark, d, "scene_raters")
    force = grades.in_force(grades.verdicts(items, raters), ["item_id"])
    rows = items.join(force, "item_id").select("item_id", "scene_id", "capture_id", "book", "grade", F.coalesce(F.length("title"), F.lit(0)).alias("text"), F.pmod(F.col("uid"), F.lit(17)).cast("int").alias("keys"))
    return rows.withColumn("score", F.col("text") * 1.0 + F.col("keys") / 100.0).withColumn("label", (F.col("grade") >= 3).cast("int"))


# --- text --------------------------------------------------------------------------------------------------------------------


@query
def fold_text(spark, d):
    return _entries(spark, d).select("entry_id", T.fold("content").alias("folded"))


@query
def doc_len_stats(spark, d):
    rows = table(spark, d, "documents").select(F.size(T.tokens("text")).alias("n"))
    return rows.agg(F.count(F.lit(1)).alias("n_docs"), F.sum("n").alias("n_tokens"), F.round(F.avg("n"), 6).alias("avg_len"))


@query
def token_df(spark, d):
    post = lexical.postings(table(spark, d, "documents"), ["doc_id"])
    return post.groupBy("term").agg(F.count(F.lit(1)).alias("df"), F.sum("tf").alias("tf"))


@query
def paragraph_count(spark, d):
    return _messages(spark, d).select("msg_id", F.size(T.paragraphs("mes")).alias("n"))


@query
def masked_length(spark, d):
    return _messages(spark, d).select("msg_id", F.length(T.masked("mes")).alias("n"))


@query
def date_like(spark, d):
    c = F.col("send_date")
    return _messages(spark, d).filter(c.isNotNull()).groupBy(T.is_date_like(c).alias("dated")).agg(F.count(F.lit(1)).alias("n"))


@query
def normal_names(spark, d):
    return table(spark, d, "books").select("world", T.normal_name("world").alias("name"))


@query
def token_estimates(spark, d):
    return table(spark, d, "documents").select("doc_id", T.token_estimate("text").alias("tokens"))


# --- keys and expressions ----------------------------------------------------------------------------------------------------


@query
def key_kinds(spark, d):
    return matching.key_table(_entries(spark, d)).groupBy("kind").agg(F.count(F.lit(1)).alias("n"))


@query
def key_alerts(spark, d):
    keys = matching.key_table(_entries(spark, d))
    return keys.select("kind", "usable", F.explode_outer("alerts").alias("alert")).groupBy("kind", "usable", "alert").agg(F.count(F.lit(1)).alias("n"))


def _matching(spark, d, key: str) -> DataFrame:
    hay = T.masked(F.coalesce("mes", F.lit("")))
    tree = S.build(key)
    return _messages(spark, d).filter(S.compile_match(tree, T.fold(hay), T.ortho(hay), F.col("mes"))).select("msg_id")


@query
def bool_and_or_not(spark, d):
    return _matching(spark, d, "? the (lantern OR bridge) -harbor")


@query
def xor_terms(spark, d):
    return _matching(spark, d, "? lantern XOR bridge")


@query
def whole_word_case(spark, d):
    return _matching(spark, d, '? =gate OR ="anvil"')


@query
def regex_term(spark, d):
    return _matching(spark, d, "? /l[ao]ntern[s]?/i AND the")


@query
def weighted_or_score(spark, d):
    texts = _messages(spark, d).select(F.col("msg_id").alias("row_id"), F.col("mes").alias("text"))
    return matching.score_texts(texts, "? lantern::2 OR bridge::0.5").withColumnRenamed("row_id", "msg_id")


@query
def proximity(spark, d):
    texts = _messages(spark, d).select(F.col("msg_id").alias("row_id"), F.col("mes").alias("text"))
    return matching.score_texts(texts, "? (lantern tonight)~4").withColumnRenamed("row_id", "msg_id")


@query
def key_excerpts(spark, d):
    texts = _messages(spark, d).select(F.col("msg_id").alias("row_id"), F.col("mes").alias("text"))
    return matching.excerpts(texts, "? =lantern OR bridge")


@query
def entry_search(spark, d):
    return filters.search(_entries(spark, d), "? lantern -harbor").select("entry_id", "found_in")


@query
def facet_filter(spark, d):
    return filters.faceted(_entries(spark, d), {"vector", "constant", "enabled"}).select("entry_id")


# --- windows and activation --------------------------------------------------------------------------------------------------


@query
def count_window(spark, d):
    last = scenes.last_messages(_messages(spark, d), 10)
    return last.groupBy("chat_id").agg(F.count(F.lit(1)).alias("n"), F.min("msg_id").alias("first_msg"), F.sum("msg_id").alias("sum_msg"))


@query
def block_windows(spark, d):
    return scenes.block_windows(_messages(spark, d), 10)


def _scenes(spark, d) -> tuple[DataFrame, DataFrame]:
    """(seg_id, chat_id, world, text) and (seg_id, chat_id) of the chats' windows, each scanned for the chat's book."""
    segs = scenes.window_segments(_messages(spark, d), CFG.message_depth, CFG.match_window)
    segs = segs.withColumn("seg_id", F.concat_ws("/", F.col("msg_id").cast("string"), F.col("seg").cast("string")))
    chats = table(spark, d, "chats").filter("world_info IS NOT NULL").select("chat_id", F.col("world_info").alias("world"))
    bound = stored(segs.join(chats, "chat_id").select("seg_id", "chat_id", "world", "text"), "segments")  # read several times below
    return bound, bound.select("seg_id", "chat_id")


@query
def keyword_activation(spark, d):
    segs, scene_of = _scenes(spark, d)
    entries = scenes.current_entries(_entries(spark, d))
    return activation.activated(entries, segs, scene_of).select("chat_id", "entry_id", F.round("score", 6).alias("score"), "hits", F.round("log_weight", 6).alias("log_weight"))


@query
def recursion_closure(spark, d):
    """All that the entries a chat's window activates reach, to the fixpoint."""
    segs, scene_of = _scenes(spark, d)
    entries = scenes.current_entries(_entries(spark, d))
    return activation.recursion(entries, activation.activated(entries, segs, scene_of).select("chat_id", "entry_id"))


@query
def activate_rank_deliver(spark, d):
    """Keys of a chat's book that fire in its last ten messages, ranked by similarity, BM25 and key scores, cut, budgeted, in prompt order."""
    segs, _ = _scenes(spark, d)
    entries = scenes.current_entries(_entries(spark, d))
    chats = table(spark, d, "chats").filter("world_info IS NOT NULL").select("chat_id", F.col("world_info").alias("world"))
    queries = scenes.query_text(_messages(spark, d), CFG.message_depth).join(chats, "chat_id")
    out = ranking.delivered(
        entries, activation.asked(entries), segs, stored(queries, "queries"), index.hash_embedding, [-1.0, 0.5, 0.9, 0.4], [-2.0, 0.5, 0.8, 0.3], CFG.relevance_cutoff,
        delivery.Caps(tokens=2000, vector=CFG.max_vector), CFG.stopword_df,
    )
    return out.withColumn("e_credit", F.round("e_credit", 6))


# --- lexical and dense -------------------------------------------------------------------------------------------------------


@query
def term_idf(spark, d):
    docs = scenes.eligible(_entries(spark, d))
    df = lexical.postings(docs, ["entry_id"], "content").groupBy("term").agg(F.count(F.lit(1)).alias("df"))
    n = docs.agg(F.count(F.lit(1)).alias("ndoc"))
    return df.join(F.broadcast(n)).select("term", "df", F.round(lexical.idf(F.col("df"), F.col("ndoc")), 6).alias("idf"))


@query
def bm25_topk(spark, d):
    asked = table(spark, d, "eval_items").select("item_id", F.explode(F.array_distinct(T.tokens("text"))).alias("term"))
    docs = table(spark, d, "documents").select("doc_id", "text")
    return lexical.bm25_top(asked, docs, "doc_id", "item_id", 10, stopword_df=CFG.stopword_df)


@query
def bm25_maxpool(spark, d):
    asked = table(spark, d, "eval_items").select("item_id", F.explode(F.array_distinct(T.tokens("text"))).alias("term"))
    scores = lexical.bm25_entries(asked, scenes.eligible(_entries(spark, d)), "item_id", stopword_df=CFG.stopword_df)
    return scores.groupBy("item_id").agg(F.count(F.lit(1)).alias("n"), F.round(F.max("score"), 5).alias("best"))


@query
def name_terms(spark, d):
    queries = scenes.query_text(_messages(spark, d), CFG.message_depth)
    weighed = lexical.weighted_terms(queries, lexical.gazetteer(_entries(spark, d)), CFG.name_boost)
    return weighed.groupBy("chat_id", "weight").agg(F.count(F.lit(1)).alias("n"))


@query
def name_idf(spark, d):
    return lexical.name_idf(_entries(spark, d))


@query
def corpus_mean(spark, d):
    return dense.corpus_mean(table(spark, d, "embeddings")).select(F.posexplode("mean").alias("i", "x")).select("i", F.round("x", 6).alias("x"))


def _asked(spark, d) -> DataFrame:
    return table(spark, d, "embeddings").filter("vec_id % 100 = 0")


@query
def cosine_topk(spark, d):
    hits = dense.search(_asked(spark, d), table(spark, d, "embeddings"), 10)
    return hits.select("query_id", "vec_id", F.round("score", 6).alias("score"), "rank")


@query
def centered_cosine_topk(spark, d):
    hits = dense.search(_asked(spark, d), table(spark, d, "embeddings"), 10, centre=True)
    return hits.select("query_id", "vec_id", F.round("score", 6).alias("score"), "rank")


@query
def pooled_cosine(spark, d):
    base = table(spark, d, "embeddings")
    mean = dense.corpus_mean(base)
    centre = base.filter("vec_id = 0").select(F.col("embedding").alias("q"))
    scored = base.join(F.broadcast(mean)).join(F.broadcast(centre)).select("label", "vec_id", dense.cosine(dense.centred(F.col("embedding"), F.col("mean")), dense.centred(F.col("q"), F.col("mean"))).alias("score"))
    return lexical.best_chunk(scored, ["label"]).select("label", F.round("score", 6).alias("score"), "vec_id")


@query
def pooled_cosine_all(spark, d):
    """``pooled_cosine`` for all searches, not only for the row its SQL names."""
    hits = dense.pooled_search(_asked(spark, d), table(spark, d, "embeddings"), "label")
    return hits.select("query_id", "label", F.round("score", 6).alias("score"), "vec_id")


@query
def label_centroids(spark, d):
    means = dense.corpus_mean(table(spark, d, "embeddings"), by=["label"])
    return means.select("label", F.posexplode("mean").alias("i", "x")).select("label", "i", F.round("x", 6).alias("x"))


@query
def principal_components(spark, d):
    base = table(spark, d, "embeddings")
    mean, comps, scales = dense.components(base, 3)
    out = base.select("vec_id", dense.project_out(F.col("embedding"), mean, comps).alias("v"))
    return out.select("vec_id", F.round(F.sqrt(dense.dot(F.col("v"), F.col("v"))), 4).alias("left_norm"))


# --- relevance and evaluation ------------------------------------------------------------------------------------------------


@query
def zscore_by_group(spark, d):
    rows = _entries(spark, d).select("entry_id", "world", F.length("content").alias("chars"), F.size("key").alias("n_keys"))
    z = relevance.z_scores(rows, ["chars", "n_keys"], ["world"])
    return z.select("entry_id", F.round("z_chars", 6).alias("z_chars"), F.round("z_n_keys", 6).alias("z_n_keys"))


@query
def ecredit(spark, d):
    rows = relevance.score(_signals(spark, d), ["text", "keys"], [-0.4, 0.8, 0.3], [-1.1, 0.6, 0.5], ["scene_id"])
    return rows.select("item_id", F.round("e_credit", 6).alias("e_credit"))


@query
def grade_in_force(spark, d):
    v = grades.verdicts(table(spark, d, "graded_entries"), table(spark, d, "scene_raters"))
    return grades.in_force(v, ["item_id"])


@query
def auc_midrank(spark, d):
    return evaluation.auc(_signals(spark, d), ["book"]).select("book", F.round("auc", 6).alias("auc"), "pos", "neg")


@query
def average_precision(spark, d):
    return evaluation.average_precision(_signals(spark, d), ["book"], "item_id").select("book", F.round("ap", 6).alias("ap"), "pos")


@query
def ndcg_at_k(spark, d):
    return evaluation.ndcg(_signals(spark, d), ["scene_id"], "item_id", 10).select("scene_id", F.round("ndcg", 6).alias("ndcg"))


@query
def f2_cutoff_sweep(spark, d):
    out = evaluation.cutoff_sweep(_signals(spark, d), "scene_id", [5.0, 10.0, 15.0, 20.0, 25.0])
    return out.select("cutoff", "scenes", *[F.round(c, 6).alias(c) for c in ("delivered", "precision", "recall", "f2")])


@query
def qwk(spark, d):
    v = grades.verdicts(table(spark, d, "graded_entries"), table(spark, d, "scene_raters"))
    return evaluation.kappa(grades.rater_pairs(v, ["item_id"]), ["rater_a", "rater_b"]).select("rater_a", "rater_b", F.round("qwk", 6).alias("qwk"), "n")


@query
def spearman(spark, d):
    return evaluation.spearman(_signals(spark, d), "score", "grade", ["book"]).select("book", F.round("rho", 6).alias("rho"), "n")


@query
def sign_test(spark, d):
    v = grades.verdicts(table(spark, d, "graded_entries"), table(spark, d, "scene_raters"))
    pairs = grades.rater_pairs(v, ["item_id"]).withColumn("delta", (F.col("b") - F.col("a")).cast("double"))
    return evaluation.sign_test(pairs, ["rater_a", "rater_b"]).select("rater_a", "rater_b", "plus", "minus", "ties", F.round("mean", 6).alias("mean"))


@query
def eta_squared(spark, d):
    return evaluation.eta_squared(_signals(spark, d), "book", "grade").select(F.round("eta2", 6).alias("eta2"))


@query
def calibration_bins(spark, d):
    rows = relevance.score(_signals(spark, d), ["text", "keys"], [-0.4, 0.8, 0.3], [-1.1, 0.6, 0.5], ["scene_id"]).select(F.round("e_credit", 6).alias("p"), "label")
    out = evaluation.reliability(rows)
    return out.select(F.col("bin").cast("int").alias("bin"), "n", "lo", "hi", F.round("mean_p", 6).alias("mean_p"), F.round("observed", 6).alias("observed"))


@query
def logistic_coefficients(spark, d):
    fit = evaluation.logistic_fit(_signals(spark, d), ["text", "keys"])
    return spark.createDataFrame([(n, round(b, 4)) for n, b in zip(["intercept", "text", "keys"], fit["beta"])], "feature string, beta double")


@query
def leave_one_out(spark, d):
    out = relevance.leave_one_out_mean(_signals(spark, d).withColumn("g", F.col("grade").cast("double")), "g", ["scene_id"], "rest")
    return out.select("item_id", F.round("rest", 6).alias("rest"))


@query
def rank_gaps(spark, d):
    return relevance.rank_gaps(_signals(spark, d).select("scene_id", "item_id", "score"), ["scene_id"], "item_id").select("scene_id", "item_id", "rank", F.round("gap", 6).alias("gap"))


@query
def judge_agreement(spark, d):
    v = grades.verdicts(table(spark, d, "graded_entries"), table(spark, d, "scene_raters"))
    out = studies.judge_agreement(grades.rater_pairs(v, ["item_id"]), ["rater_a", "rater_b"])
    return out.select("rater_a", "rater_b", "n", *[F.round(c, 6).alias(c) for c in ("exact", "within_one", "precision", "recall")])


@query
def tier_recall(spark, d):
    tiers = table(spark, d, "books").select(F.col("world").alias("book"), "tier")
    rows = _signals(spark, d).join(tiers, "book").withColumn("delivered", F.col("score") >= 15)
    return studies.tier_recall(rows, ["tier", "book"]).select("tier", "book", "relevant", "found", F.round("recall", 6).alias("recall"))


@query
def delivered_f2(spark, d):
    rows = _signals(spark, d).withColumn("delivered", F.col("score") >= 15)
    return studies.delivered_f2(rows, ["scene_id"]).select("scene_id", F.round("f2", 6).alias("f2"))


@query
def match_rate_bands(spark, d):
    counts = audit.chat_counts(_entries(spark, d), _live(spark, d))
    return studies.rate_bands(counts, F.col("messages_with"))


@query
def scan_scenes(spark, d):
    return studies.synthetic_scenes(_messages(spark, d), 10).select("chat_id", "msg_id", F.length("scan").alias("chars"))


@query
def unreached_spellings(spark, d):
    return audit.unreached_spellings(_entries(spark, d))


@query
def substring_shares(spark, d):
    texts = _live(spark, d).select(F.col("msg_id").cast("string").alias("seg_id"), F.col("mes").alias("text"))
    return audit.substring_shares(matching.key_table(_entries(spark, d)), texts)


# --- layout, budget ----------------------------------------------------------------------------------------------------------


def _items(spark, d) -> DataFrame:
    e = _entries(spark, d)
    books = table(spark, d, "books").select("world", (F.col("tier") == "reference").cast("int").alias("tier"), F.when(F.col("tier") == "reference", 0.8).otherwise(1.0).alias("weight"))
    return e.join(books, "world").select(
        F.col("world").alias("scene"), "entry_id", F.when(F.coalesce("constant", F.lit(False)), "constant").when(F.coalesce("vectorized", F.lit(False)), "promoted").otherwise("dynamic").alias("block"),
        F.when(F.col("entry_id") % 5 != 0, (F.col("uid") % 97) / 97.0).alias("e_credit"), F.lit(0.0).alias("log_weight"), F.col("uid").alias("authored"), "tier", "weight", F.lit(0).alias("offset"),
        T.token_estimate("content").alias("tokens"), F.coalesce("vectorized", F.lit(False)).alias("vector"), F.coalesce("disable", F.lit(False)).alias("exempt"), F.col("world").alias("book"), F.lit(0).alias("book_cap"),
    )


@query
def layout_interleaved(spark, d):
    return delivery.layout(_items(spark, d)).select("entry_id", "walk")


@query
def layout_sequential(spark, d):
    return delivery.layout(_items(spark, d), "sequential").select("entry_id", "walk")


@query
def budget_walk(spark, d):
    out = delivery.budget(delivery.layout(_items(spark, d)), delivery.Caps(tokens=1500, total=12))
    return out.select("entry_id", "admitted", "spent", "tail")


@query
def budget_walk_slack(spark, d):
    out = delivery.budget(delivery.layout(_items(spark, d)), delivery.Caps(tokens=1500, dynamic=6, vector=3, slack=0.1))
    return out.select("entry_id", "admitted", "reasons", "spent", "in_prompt", "tail")


@query
def budget_prefix(spark, d):
    return delivery.stop_budget(delivery.layout(_items(spark, d)), 1500).select("entry_id", F.col("upto").cast("long").alias("upto"))


@query
def order_priority(spark, d):
    e = delivery.with_missing(_entries(spark, d)).withColumn("scene", F.col("world"))
    return delivery.prompt_order(e, [*delivery.entry_order("priority"), F.col("entry_id")]).select("entry_id", "prompt_order")


@query
def order_tiered_tokens(spark, d):
    e = delivery.with_missing(_entries(spark, d)).withColumn("scene", F.col("world"))
    return delivery.prompt_order(e, [*delivery.entry_order("tokens-desc", ["vector", "constant"]), F.col("entry_id")]).select("entry_id", "prompt_order")


# --- audit, suggestion -------------------------------------------------------------------------------------------------------


@query
def key_listed_by(spark, d):
    return audit.listed_by(_entries(spark, d))


@query
def key_book_counts(spark, d):
    """The literal keys, as its SQL has no evaluator; key_book_counts_all has every key."""
    return audit.book_counts(_entries(spark, d)).filter("kind = 'literal'").select("world", "key", "df", F.col("total").cast("long").alias("total"), "typed")


@query
def key_book_counts_all(spark, d):
    return audit.book_counts(_entries(spark, d))


@query
def key_chat_counts(spark, d):
    """The literal keys, as its SQL has no evaluator; key_chat_counts_all has every key."""
    return audit.chat_counts(_entries(spark, d), _live(spark, d)).filter("kind = 'literal'").select("key", "messages_with")


@query
def key_chat_counts_all(spark, d):
    return audit.chat_counts(_entries(spark, d), _live(spark, d))


@query
def audit_flags(spark, d):
    return audit.flags(_entries(spark, d), _live(spark, d), function_words=["the", "of", "a", "and", "to", "in"])


@query
def audit_severities(spark, d):
    return audit.flags(_entries(spark, d), _live(spark, d), function_words=["the", "of", "a", "and", "to", "in"]).groupBy("flag", "severity").agg(F.count(F.lit(1)).alias("n"))


@query
def unusable_secondary(spark, d):
    return audit.unusable_secondary(_entries(spark, d))


@query
def near_duplicates(spark, d):
    return audit.near_duplicates(_entries(spark, d))


@query
def cap_ratio(spark, d):
    return suggest.word_evidence(_entries(spark, d))


#: function words of the tests' books; a language pack brings its own
PACK = suggest.LanguagePack(function_words=frozenset("the a an and or of to in on at for from with by is are was were be it its that this as but not no so than then if he she they i we you his her their my your".split()))


@query
def ngram_tfidf(spark, d):
    scores = suggest.ngram_scores(_entries(spark, d), PACK)
    return scores.groupBy("world", "words").agg(F.count(F.lit(1)).alias("n"), F.round(F.max("score"), 5).alias("best"))


@query
def cohesion_bigram(spark, d):
    return suggest.cohesion(suggest.ngram_scores(_entries(spark, d), PACK))


@query
def key_suggestions(spark, d):
    return suggest.suggestions(_entries(spark, d), PACK, cap=10).withColumn("score", F.round("score", 6))


# --- catalogue, grades, edits ------------------------------------------------------------------------------------------------


@query
def orphan_grades(spark, d):
    have = _entries(spark, d).select(F.col("world").alias("book"), "uid").distinct()
    return table(spark, d, "graded_entries").join(have, ["book", "uid"], "left_anti").groupBy("book").agg(F.count(F.lit(1)).alias("n"))


@query
def orphan_bindings(spark, d):
    chats = table(spark, d, "chats").select(F.col("character_name").alias("world_info"))
    return lineage.orphan_bindings(chats, table(spark, d, "books"))


@query
def nearest_name(spark, d):
    books = table(spark, d, "books").select(F.col("world").alias("name"))
    return lineage.nearest_name(books, books)


@query
def lineage_components(spark, d):
    return lineage.lineages(_entries(spark, d))


@query
def attached_books(spark, d):
    chats = table(spark, d, "chats").select("chat_id", F.col("world_info").alias("world"))
    return lineage.attached_books([chats], table(spark, d, "books"))


@query
def book_chat_bindings(spark, d):
    chats = table(spark, d, "chats")
    book = _entries(spark, d).groupBy("world").agg(F.count(F.lit(1)).alias("n")).orderBy(F.col("n").desc(), "world").first()
    rows = lineage.book_chats(chats, book.world if book else "", global_books=["none"])
    return rows.groupBy("why").agg(F.count(F.lit(1)).alias("n"))


@query
def book_fingerprints(spark, d):
    """Without the hash, which its SQL doesn't have; book_fingerprints_all has it."""
    return lineage.book_fingerprints(_entries(spark, d)).select("world", "entries", "chars")


@query
def book_fingerprints_all(spark, d):
    return lineage.book_fingerprints(_entries(spark, d))


@query
def union_arms(spark, d):
    v = grades.verdicts(table(spark, d, "graded_entries"), table(spark, d, "scene_raters")).filter("kind IS NOT NULL")
    rows = v.select("item_id", F.col("kind").alias("arm"), F.col("pos").alias("rank"), F.when(F.col("valid"), F.col("grade")).alias("grade"))
    return grades.union_arms(rows, ["grade"], ["item_id"]).select("item_id", F.array_join("arms", ",").alias("arms"), "best_rank", "grade")


@query
def delivered_difference(spark, d):
    v = grades.verdicts(table(spark, d, "graded_entries"), table(spark, d, "scene_raters")).filter("valid")
    return grades.difference(v.filter("kind = 'human'"), v.filter("kind = 'llm'"), ["item_id"])


@query
def verdict_rollup(spark, d):
    items = table(spark, d, "graded_entries")
    v = grades.verdicts(items, table(spark, d, "scene_raters")).filter("valid").join(items.select("item_id", "book"), "item_id")
    tiers = table(spark, d, "books").select(F.col("world").alias("book"), "tier")
    return v.join(tiers, "book").rollup("tier", "book").agg(F.count(F.lit(1)).alias("n"), F.round(F.avg("grade"), 6).alias("mean_grade"))


@query
def job_batches(spark, d):
    return grades.jobs(table(spark, d, "graded_entries").select("item_id"), 16, "item_id").groupBy("job").agg(F.count(F.lit(1)).alias("n"), F.min("item_id").alias("first_item"))


@query
def bundle_candidates(spark, d):
    b = bundles.build_bundles(table(spark, d, "graded_entries"), table(spark, d, "scene_raters"))
    return bundles.candidates(b).groupBy("capture_id").agg(F.count(F.lit(1)).alias("n"), F.sum("uid").alias("uids"))


@query
def key_delete(spark, d):
    return keyedit.delete_key(_entries(spark, d), "Night").select("entry_id", F.array_join("key", "|").alias("keys"), "edited")


@query
def key_add_variant(spark, d):
    return keyedit.add_variant(_entries(spark, d), "gate", "the gate").select("entry_id", F.array_join("key", "|").alias("keys"), "edited")


@query
def key_rename(spark, d):
    return keyedit.rename_key(_entries(spark, d), "night", "midnight").select("entry_id", F.array_join("key", "|").alias("keys"), "edited")


@query
def chunk_plan(spark, d):
    return index.wanted(_entries(spark, d)).groupBy("entry_id").agg(F.count(F.lit(1)).alias("n"), F.sum(F.length("text")).alias("chars"))


# --- state and time ----------------------------------------------------------------------------------------------------------


@query
def latch_first_fire(spark, d):
    ev = table(spark, d, "events").select(F.col("user_id").cast("string").alias("chat_id"), F.hash("event_type").cast("long").alias("entry_id"), "event_type", F.unix_seconds(F.col("ts").cast("timestamp")).alias("at"))
    first = latches.first_firings(ev)
    return first.join(ev.select("entry_id", "event_type").distinct(), "entry_id").select("chat_id", "event_type", "at")


@query
def user_sessions(spark, d):
    s = latches.sessions(table(spark, d, "events"), "30 minutes")
    return s.groupBy("user_id").agg(F.count(F.lit(1)).alias("sessions"), F.sum("n").alias("n"))


@query
def merged_spans(spark, d):
    ev = table(spark, d, "events").select("user_id", F.unix_seconds(F.col("ts").cast("timestamp")).alias("at"), (F.unix_seconds(F.col("ts").cast("timestamp")) + 600).alias("until"))
    return matching.merge_spans(ev, ["user_id"])


from . import operator_queries  # noqa: E402,F401  registers further queries
