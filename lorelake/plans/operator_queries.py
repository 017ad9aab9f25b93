"""Further registered queries: one for each operator that the headline queries don't show by itself."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import hashing
from ..functions import text as T
from ..operators import activation, audit, delivery, evaluation, filters, grades, keyedit, lexical, lineage, matching, relevance, scenes, studies, suggest
from ..session import shared_dir, stored, table
from ..sources import books as book_files
from ..sources import bundles, index, lexicon
from ..streaming import latches
from .queries import CFG, _entries, _items, _messages, _signals, query


def _verdicts(spark, d) -> DataFrame:
    return grades.verdicts(table(spark, d, "graded_entries"), table(spark, d, "scene_raters"))


def _delivered(spark, d) -> DataFrame:
    return _signals(spark, d).withColumn("delivered", F.col("score") >= 15)


# --- sources -----------------------------------------------------------------------------------------------------------------


@query
def bundle_files(spark, d):
    """Bundles written as documents and read back: candidates and raters of each capture."""
    path = f"{shared_dir(spark)}/bundles-{uuid.uuid4().hex}"
    bundles.build_bundles(table(spark, d, "graded_entries"), table(spark, d, "scene_raters")).write.json(path)
    read = bundles.read_bundles(spark, path, lines=True)
    rows = bundles.candidates(read).groupBy("capture_id").agg(F.count(F.lit(1)).alias("n"), F.sum(F.coalesce(F.size("grades"), F.lit(0))).alias("verdicts"))
    who = bundles.bundle_raters(read).groupBy("capture_id").agg(F.count(F.lit(1)).alias("raters"))
    return rows.join(who, "capture_id", "left").select("capture_id", "n", "verdicts", F.coalesce("raters", F.lit(0)).alias("raters"))


@query
def book_files_read(spark, d):
    """Books written as documents and read back: entries, their characters and keys."""
    path = f"{shared_dir(spark)}/books-{uuid.uuid4().hex}"
    rows = scenes.current_entries(_entries(spark, d)).select("world", "uid", "key", "keysecondary", "comment", "content", "constant", "vectorized", "disable")
    book_files.write_books(rows, path)
    read = book_files.read_books(spark, path, lines=True)
    return read.groupBy("world").agg(F.count(F.lit(1)).alias("n"), F.sum(F.length("content")).alias("chars"), F.sum(F.greatest(F.coalesce(F.size("key"), F.lit(0)), F.lit(0))).alias("keys"), F.min("uid").alias("first_uid"))


def _chat_files(spark, d) -> str:
    """The chats as logs: a line of metadata, then a line a message in the order of msg_id."""
    path = f"{shared_dir(spark)}/chats-{uuid.uuid4().hex}"
    head = table(spark, d, "chats").select("chat_id", F.lit(-1).cast("long").alias("at"), F.to_json(F.struct("user_name", "character_name", "create_date", F.struct("world_info").alias("chat_metadata"))).alias("value"))
    lines = _messages(spark, d).join(head.select("chat_id"), "chat_id", "left_semi").select("chat_id", F.col("msg_id").alias("at"), F.to_json(F.struct("name", "is_user", "is_system", "send_date", "mes", "swipe_id")).alias("value"))
    rows = head.unionByName(lines)
    rows.repartition("chat_id").sortWithinPartitions("chat_id", "at").select("value", F.col("chat_id").alias("chat")).write.partitionBy("chat").text(path)
    return path


@query
def chat_files_scanned(spark, d):
    """Chat logs written and scanned: lines by fate."""
    return book_files.scan_counts(spark, _chat_files(spark, d))


@query
def chat_heads(spark, d):
    """The books that chat logs are bound to, from the first line of each log alone."""
    heads = book_files.read_heads(spark, f"{_chat_files(spark, d)}/*")
    return heads.select(F.col("chat_metadata.world_info").alias("world")).groupBy("world").agg(F.count(F.lit(1)).alias("chats"))


@query
def collections_listed(spark, d):
    """Folders of a store by what they hold, without reading contents."""
    path = f"{shared_dir(spark)}/store-{uuid.uuid4().hex}"
    _entries(spark, d).select("entry_id", F.substring("world", 1, 1).alias("c")).repartition(1).write.partitionBy("c").parquet(path)
    return book_files.listing(spark, path).select(F.regexp_replace(F.url_decode("collection"), "^c=", "").alias("collection"), "files")


@query
def lexicon_packed(spark, d):
    """Word frequencies of the corpus packed into bands and unpacked again."""
    toks = table(spark, d, "documents").select(F.coalesce("lang", F.lit("-")).alias("lang"), F.explode(T.tokens("text")).alias("word"))
    counts = toks.groupBy("lang", "word").agg(F.count(F.lit(1)).alias("n"))
    zipf = counts.select("lang", "word", F.round(F.log10(F.col("n") * 10.0), 1).alias("zipf")).filter(~F.col("word").rlike("[;: ]"))
    return lexicon.unpack(lexicon.pack(zipf)).groupBy("lang", "zipf").agg(F.count(F.lit(1)).alias("n"))


@query
def stale_packs(spark, d):
    b = table(spark, d, "books").select(F.col("world").alias("lang"), F.md5("world").alias("hash"), "tier")
    return lexicon.stale_packs(b.filter("tier = 'memory'"), b.select("lang", "hash")).select("lang")


@query
def index_sync(spark, d):
    """Chunks to add and to drop where the index holds the entries of even ids and, for ids that 3 divides, an older text."""
    want = _entries(spark, d).select("entry_id", F.coalesce("content", F.lit("")).alias("text")).withColumn("hash", F.md5(F.concat_ws("/", "text", "entry_id")))
    held = want.filter("entry_id % 2 = 0").withColumn("hash", F.when(F.col("entry_id") % 3 == 0, F.md5(F.concat("hash", F.lit("old")))).otherwise(F.col("hash")))
    add, drop = index.sync_plan(want, held)
    return add.select(F.lit("add").alias("what"), "hash").unionByName(drop.select(F.lit("drop").alias("what"), "hash")).groupBy("what").agg(F.count(F.lit(1)).alias("n"), F.min("hash").alias("first"))


@query
def adopted_vectors(spark, d):
    v = table(spark, d, "embeddings").select(F.col("vec_id").cast("string").alias("hash"), "label", F.col("embedding").alias("vector"), F.col("vec_id").alias("mtime"), F.col("label").cast("string").alias("collection"))
    missing = v.filter("label % 2 = 0").select("hash")
    return index.adopt(missing, v.filter("vec_id % 3 <> 0"), 64).select("hash", F.round(F.aggregate("vector", F.lit(0.0), lambda a, x: a + x), 4).alias("total"))


@query
def orphan_collections(spark, d):
    books = _entries(spark, d).groupBy(F.col("world").alias("collection")).agg(F.sum(F.length("content")).alias("bytes"))
    live = table(spark, d, "books").filter("tier = 'reference'").select(F.col("world").alias("collection"))
    return index.orphan_collections(books, live)


@query
def adopted_hashes(spark, d):
    rows = _entries(spark, d).groupBy("world", "uid").agg(F.min("entry_id").alias("hash"))
    host = table(spark, d, "graded_entries").groupBy(F.col("book").alias("world"), "uid").agg(F.min("item_id").alias("hash"))
    return index.adopt_hashes(rows, host)


@query
def sliced_rows(spark, d):
    short = table(spark, d, "scene_raters").filter("lower(kind) = 'human'").select("capture_id")
    return bundles.slice_rows(table(spark, d, "graded_entries").select("item_id", "capture_id"), short, ["capture_id"]).select("item_id")


@query
def index_fingerprints(spark, d):
    return lineage.index_fingerprints(_entries(spark, d))


@query
def string_hashes(spark, d):
    return table(spark, d, "books").select("world", hashing.fnv1a(F.col("world")).alias("fnv"), hashing.hex32(hashing.djb2(F.col("world"))).alias("djb"))


@query
def canonical_hashes(spark, d):
    rows = table(spark, d, "books").select("world", F.struct("world", "tier", "lang").alias("s"))
    return rows.select("world", hashing.canonical_sha256(F.col("s"), rows.schema["s"].dataType).alias("sha"))


# --- text, keys --------------------------------------------------------------------------------------------------------------


@query
def query_texts(spark, d):
    q = scenes.query_text(_messages(spark, d), 10)
    return q.select("chat_id", F.length("query").alias("chars"), F.md5("query").alias("hash"))


@query
def expanded_macros(spark, d):
    """Messages with the macros of both speakers' names filled in."""
    names = table(spark, d, "chats").select("chat_id", "user_name", "character_name")
    rows = _messages(spark, d).filter(F.col("mes").contains("{{")).join(names, "chat_id")
    filled = F.replace(F.replace(F.col("mes"), F.lit("{{user}}"), F.coalesce("user_name", F.lit("{{user}}"))), F.lit("{{char}}"), F.coalesce("character_name", F.lit("{{char}}")))
    return rows.select("msg_id", filled.alias("text"))


@query
def canonical_keys(spark, d):
    return _entries(spark, d).select("entry_id", F.explode("key").alias("k")).filter("k IS NOT NULL").select("entry_id", suggest.canon(F.col("k")).alias("canon"))


@query
def titled_keys(spark, d):
    keys = _entries(spark, d).select(F.explode("key").alias("key")).filter("trim(key) <> '' AND NOT key LIKE '?%' AND NOT key LIKE '/%'").distinct()
    return keys.select("key", audit.titled(F.col("key")).alias("titled")).filter("titled IS NOT NULL")


@query
def keys_by_length(spark, d):
    return _entries(spark, d).select("entry_id", F.array_join(filters.packed_by_length("key"), "|").alias("keys"))


@query
def gated_keys(spark, d):
    """Whether an entry's gate lets its key fire on its own text: one primary key and its secondary keys, by the entry's logic."""
    e = _entries(spark, d).filter("size(keysecondary) > 0 AND content IS NOT NULL").select("entry_id", F.coalesce("selective_logic", F.lit(0)).alias("logic"), "keysecondary", T.fold(T.masked("content")).alias("hay"))
    plain = F.filter("keysecondary", lambda k: F.coalesce(F.trim(k), F.lit("")) != "")
    e = e.withColumn("sec", plain).filter(~F.exists("sec", lambda k: F.trim(k).rlike(r"^[?/]") | k.contains("-"))).filter("size(sec) > 0")
    found = F.transform("sec", lambda k: F.contains("hay", T.fold(F.trim(k))))
    some, every = F.exists(found, lambda x: x), F.forall(found, lambda x: x)
    ok = F.when(F.col("logic") == 0, some).when(F.col("logic") == 1, ~every).when(F.col("logic") == 2, ~some).otherwise(every)
    return e.select("entry_id", "logic", ok.alias("open"))


@query
def audit_scope(spark, d):
    return audit.in_scope(_entries(spark, d)).select("entry_id")


@query
def state_parts(spark, d):
    return _entries(spark, d).select("entry_id", F.array_join(filters.state_parts(), ",").alias("parts"))


@query
def ranked_search(spark, d):
    return filters.ranked_search(_entries(spark, d), "? lantern").select("entry_id", "found_in", "place")


@query
def successor_variety(spark, d):
    return suggest.successor_variety(_entries(spark, d))


@query
def word_contexts(spark, d):
    return suggest.word_contexts(_entries(spark, d))


@query
def form_votes(spark, d):
    return suggest.form_votes(_entries(spark, d))


@query
def uid_reindex(spark, d):
    w = Window.partitionBy("world").orderBy("uid")
    chosen = _entries(spark, d).filter("coalesce(constant, false)").select("world", "uid").distinct().withColumn("place", F.row_number().over(w) - 1)
    moves, clash = keyedit.reindex_plan(_entries(spark, d).select("world", "uid").distinct(), chosen, 10)
    return moves.select("world", "uid", "target", F.lit("move").alias("what")).unionByName(clash.select("world", "uid", F.lit(None).cast("long").alias("target"), F.lit("conflict").alias("what")))


@query
def state_rekeyed(spark, d):
    record = _entries(spark, d).filter("world IS NOT NULL").groupBy(F.col("entry_id").alias("key")).agg(F.min("uid").alias("at"))
    moves = record.filter("key % 5 = 0").select("key", F.when(F.col("key") % 2 == 0, F.col("key") + 1).alias("target"))
    kept, lost = keyedit.rekeyed(record, moves)
    return kept.select("key", "at", F.lit("kept").alias("fate")).unionByName(lost.select("key", "at", F.lit("lost").alias("fate")))


# --- activation, delivery ----------------------------------------------------------------------------------------------------


@query
def gate_verdicts(spark, d):
    """Gates that the entries' uids stand for, on chats of their uid's length."""
    dec = lambda n, a: F.struct(F.lit(n).alias("name"), a.cast("string").alias("arg"))
    e = _entries(spark, d).select("entry_id", (F.col("uid") % 40).alias("n"))
    kind = F.col("n") % 4
    decs = F.when(kind == 0, F.array(dec("@@activate_only_after", F.lit(5)))).when(kind == 1, F.array(dec("@@activate_only_every", F.lit(3)))).when(kind == 2, F.array(dec("@@is_greeting", F.lit(0)))).otherwise(F.array(dec("@@dont_activate_after_match", F.lit(6))))
    e = e.withColumn("decorators", decs).withColumn("delay", F.when(F.col("n") % 7 == 0, 10))
    v = activation.gate_verdict(F.col("n"), F.floor(F.col("n") / 2), F.lit(1), F.lit("A"), F.when(F.col("n") % 8 == 3, F.col("n") - 2))
    return e.select("entry_id", v.alias("verdict"))


@query
def timed_states(spark, d):
    e = _entries(spark, d).select("entry_id", (F.col("uid") % 12).alias("at"))
    state = activation.timed_state(F.when(F.col("at") > 0, F.col("at")), F.col("at") % 4, F.col("at") % 3, F.col("at") % 10, F.lit(8))
    return e.select("entry_id", state.alias("state"))


@query
def inclusion_groups(spark, d):
    """One entry of each group of a book: a sticky one, else the best override, else the best score, else the first by weight (here alike, so by score and id)."""
    e = _entries(spark, d).select(F.col("world").alias("chat_id"), "entry_id", "entry_group", F.coalesce("constant", F.lit(False)).alias("sticky"), F.coalesce("vectorized", F.lit(False)).alias("group_override"), F.col("uid").alias("order"), F.lit(True).alias("group_scoring"), (F.col("entry_id") * 1.0).alias("score"), F.lit(100.0).alias("group_weight"))
    return activation.group_winners(e).filter("coalesce(entry_group, '') <> ''").select("chat_id", "entry_group", "entry_id")


@query
def ungrouped_probable(spark, d):
    """Entries whose probability is 0 or 100, so that the roll decides nothing."""
    e = _entries(spark, d).select(F.col("world").alias("chat_id"), "entry_id", F.when(F.col("uid") % 3 == 0, 0.0).when(F.col("uid") % 3 == 1, 100.0).alias("probability"), F.coalesce("constant", F.lit(False)).alias("sticky"))
    return activation.probable(e).select("entry_id")


@query
def sources_used(spark, d):
    e = _entries(spark, d).select("world", (F.col("uid") % 50 == 0).alias("match_scenario"), F.coalesce("constant", F.lit(False)).alias("match_creator_notes"))
    src = table(spark, d, "chats").filter("world_info IS NOT NULL").select("chat_id", F.col("world_info").alias("world"), F.explode(F.array(F.lit("scenario"), F.lit("creator_notes"), F.lit("persona"))).alias("source"), F.coalesce("character_name", F.lit("")).alias("text"))
    return scenes.used_sources(src, e).select("chat_id", "source")


@query
def undecided_shipped(spark, d):
    return delivery.undecided_dropped(_items(spark, d)).select("entry_id")


@query
def grade_ordered(spark, d):
    return delivery.grade_order(_items(spark, d), "authored").select("entry_id", "place")


@query
def host_ordered(spark, d):
    e = _entries(spark, d).select(F.col("world").alias("scene"), "entry_id", "constant", (F.col("uid") % 3).alias("source"), F.col("uid").alias("order"), F.col("vectorized").alias("external"))
    return delivery.host_order(e.withColumnRenamed("constant", "sticky")).select("entry_id", "place")


@query
def depth_discount(spark, d):
    return _signals(spark, d).select("item_id", F.round(activation.discounted(F.col("score"), F.col("keys") % 4), 6).alias("score"))


@query
def repeat_curves(spark, d):
    n = F.col("uid").cast("int") % 9
    rows = _entries(spark, d).select("entry_id", n.alias("n"))
    return rows.select("entry_id", *[F.round(matching.repeat_curve(F.col("n"), curve=c), 6).alias(a) for a, c in (("a", "presence"), ("b", "presence-log"), ("c", "bm25"))])


@query
def relevance_cut(spark, d):
    rows = relevance.score(_signals(spark, d), ["text", "keys"], [-0.4, 0.8, 0.3], [-1.1, 0.6, 0.5], ["scene_id"]).withColumn("e_credit", F.round("e_credit", 6))
    return relevance.cut(rows, 0.4).select("item_id")


@query
def weighted_credit(spark, d):
    rows = _items(spark, d).select("entry_id", F.round(relevance.weighted_credit(F.col("e_credit"), F.log((F.col("authored") % 5) + 1.0)), 6).alias("credit"))
    return rows


@query
def available_entries(spark, d):
    e = _entries(spark, d).select("entry_id", F.when(F.col("uid") % 3 == 0, F.col("uid")).alias("end_at"), F.when(F.col("uid") % 2 == 0, F.col("uid")).alias("start_at"), F.lit(20).alias("now"))
    return relevance.available(e, "now").select("entry_id")


@query
def shared_names(spark, d):
    """Names that an entry's own title shares with the contents of its book, weighed by how few entries hold them."""
    e = scenes.current_entries(_entries(spark, d))
    own = e.select("world", "entry_id", F.explode(F.array_distinct(T.tokens("content"))).alias("term"))
    win = e.groupBy("world").agg(F.min("entry_id").alias("first")).join(own.withColumnRenamed("entry_id", "first"), ["world", "first"]).select(F.col("world").alias("chat_id"), "world", "term")
    df = own.groupBy("world", "term").agg(F.count(F.lit(1)).alias("df")).join(e.groupBy("world").agg(F.count(F.lit(1)).alias("ndoc")), "world")
    return relevance.shared_names(own, win, df).select("chat_id", "entry_id", F.round("proper_nouns", 5).alias("mass"))


# --- grades and studies ------------------------------------------------------------------------------------------------------


@query
def graded_split(spark, d):
    items = table(spark, d, "graded_entries").select("item_id")
    without, having = grades.split_graded(items, _verdicts(spark, d).filter("valid").select("item_id"), ["item_id"])
    return without.select("item_id", F.lit(False).alias("graded")).unionByName(having.select("item_id", F.lit(True).alias("graded")))


@query
def merged_passes(spark, d):
    v = _verdicts(spark, d).filter("valid AND rater_id IS NOT NULL AND graded_at IS NOT NULL").select("item_id", "rater_id", "grade", "graded_at", "pos")
    one = v.groupBy("item_id", "rater_id", "graded_at").agg(F.min(F.struct("pos", "grade")).alias("m")).select("item_id", "rater_id", "graded_at", "m.pos", "m.grade")
    merged = grades.merge_passes(one.filter("item_id % 2 = 0"), one, ["item_id"], F.substring("graded_at", 1, 10))
    return merged.groupBy("item_id").agg(F.count(F.lit(1)).alias("n"), F.sum("grade").alias("total"))


@query
def searched_books(spark, d):
    rows = table(spark, d, "graded_entries").select("capture_id", "book", F.when(F.col("uid") % 3 != 0, F.col("uid") * 1.0).alias("cosine"))
    return grades.searched_book(rows, ["capture_id"])


@query
def grafted_grades(spark, d):
    g = table(spark, d, "graded_entries").select("item_id", F.col("book").alias("world"), "uid")
    old = scenes.current_entries(_entries(spark, d))
    new = old.filter("uid % 7 <> 0").withColumn("comment", F.when(F.col("uid") % 5 == 0, F.lit("changed")).otherwise(F.col("comment"))).withColumn("content", F.when(F.col("uid") % 3 == 0, F.lit("changed")).otherwise(F.col("content")))
    return grades.graft(g, old, new, ["world", "uid"]).groupBy("fate").agg(F.count(F.lit(1)).alias("n"))


@query
def pool_extension(spark, d):
    g = table(spark, d, "graded_entries")
    runs = g.select("item_id", F.explode(F.array(F.struct(F.lit("a").alias("arm"), (F.col("uid") % 20).alias("rank")), F.struct(F.lit("b").alias("arm"), (F.col("uid") % 15).alias("rank")))).alias("x")).select("item_id", "x.*")
    judged = _verdicts(spark, d).filter("valid").select("item_id").distinct()
    return studies.pool_extension(runs, judged, 10, ["item_id"]).select("item_id", F.array_join("arms", ",").alias("arms"), "best_rank")


@query
def divergences(spark, d):
    rows = _delivered(spark, d)
    return studies.divergences(rows, rows.filter("keys > 8"), ["item_id"])


@query
def paired_arms(spark, d):
    rows = _signals(spark, d)
    runs = None
    for arm, cutoff in (("base", 15.0), ("low", 8.0), ("high", 22.0)):
        one = studies.delivered_f2(rows.withColumn("delivered", F.col("score") >= cutoff), ["scene_id"]).withColumn("arm", F.lit(arm))
        runs = one if runs is None else runs.unionByName(one)
    return studies.paired(runs, "scene_id", "arm", "base").select("arm", "plus", "minus", "ties", F.round("mean", 6).alias("mean"))


@query
def parameter_screen(spark, d):
    arms = {"base": F.col("score") >= 15, "low": F.col("score") >= 8, "keys": F.col("keys") >= 8, "text": F.col("text") >= 12}
    out = studies.parameter_screen(_signals(spark, d), arms, "base", "scene_id")
    return out.select("arm", "plus", "minus", "ties", F.round("mean", 6).alias("mean"))


@query
def holm_adjusted(spark, d):
    rows = table(spark, d, "nation").select("n_nationkey", "n_regionkey", ((F.col("n_nationkey") * 7 % 25 + 1) / 250.0).alias("p"))
    return evaluation.holm(rows, by=["n_regionkey"], tie=["n_nationkey"]).select("n_nationkey", F.round("p_holm", 6).alias("p_holm"))


@query
def parameter_grid(spark, d):
    arms = {f"w{w}": F.col("text") + F.col("keys") * w for w in (0, 1, 10)}
    out = studies.parameter_grid(_signals(spark, d), arms, "scene_id", "item_id")
    return out.select("arm", "scenes", F.round("ndcg", 6).alias("ndcg"))


@query
def token_offsets(spark, d):
    rows = table(spark, d, "documents").select("lang", "n_chars", F.length(F.coalesce("text", F.lit(""))).cast("long").alias("counted"))
    return studies.token_offsets(rows, "n_chars", "counted", ["lang"])


@query
def route_union(spark, d):
    it = _items(spark, d).select("scene", "entry_id", "authored", "tokens", "block", F.coalesce("e_credit", F.lit(0.0)).alias("score"))
    out = studies.route_union(it.filter("block = 'constant'"), it.filter("block <> 'constant'"), 5, 2000)
    return out.select("entry_id", F.col("upto").cast("long").alias("upto"))


@query
def cost_curve(spark, d):
    rows = _signals(spark, d).select("scene_id", "grade", "score", (F.col("text") + 10).alias("tokens"))
    out = None
    for cutoff in (5.0, 15.0, 25.0):
        on = F.col("score") >= cutoff
        s = rows.groupBy("scene_id").agg(F.sum(F.when(on, F.col("tokens")).otherwise(0)).alias("tokens"))
        f2 = studies.delivered_f2(rows.withColumn("delivered", on), ["scene_id"])
        one = s.join(f2, "scene_id").agg(F.lit(cutoff).alias("cutoff"), F.avg("tokens").alias("tokens"), F.avg("f2").alias("f2"))
        out = one if out is None else out.unionByName(one)
    return out.select("cutoff", F.round("tokens", 4).alias("tokens"), F.round("f2", 6).alias("f2"))


@query
def repaired_tiers(spark, d):
    return studies.repaired_tiers(_entries(spark, d).select("entry_id", "comment"), r"(?i)^\s*(the|a) ").select("entry_id", "tier")


@query
def ungated_keys(spark, d):
    e = _entries(spark, d).select("entry_id", F.explode("key").alias("key"), F.coalesce("constant", F.lit(False)).alias("c")).filter("key IS NOT NULL")
    hits = e.groupBy("key").agg((F.count(F.lit(1)) * 3).alias("messages_with"))
    return studies.ungated(e.filter("c").select("key"), e.select("key"), hits).select("band", "rows", "keys")


@query
def rated_confusion(spark, d):
    pairs = grades.rater_pairs(_verdicts(spark, d), ["item_id"])
    c = studies.confusion(pairs, [])
    return c.select("a", *[F.col(str(g)).alias(f"b{g}") for g in range(5)])


@query
def events_windowed(spark, d):
    """Tumbling hours of the events, as the stream's windows count them."""
    ev = table(spark, d, "events").withColumn("ts", F.col("ts").cast("timestamp"))
    out = latches.timed_windows(ev, "1 hour", "10 minutes")
    return out.select(F.unix_seconds("window.start").alias("hour"), "event_type", "n", F.round("total", 4).alias("total"))


@query
def turn_windows(spark, d):
    m = scenes.usable_messages(_messages(spark, d)).select("chat_id", "msg_id", "t", "mes")
    out = latches.turn_windows(m, 3)
    return out.select("msg_id", F.size("said").alias("n"), F.length(F.array_join("said", "")).alias("chars"))
