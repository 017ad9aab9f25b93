"""SQL for the queries of ``operator_queries``, and for some of ``queries``, for a single-node engine."""

from __future__ import annotations

from ..functions.text import NAME_PARTICLES
from ..operators.suggest import DETERMINERS, LINKERS, PARTICLES, PRONOUNS
from .oracle import CLASS, ECREDIT, FORMS, ITEMS, ORACLE, PAIRS, RANKED, SIGNALS, USABLE, VERDICTS, WALK, _q, fold, masked, ortho, tokens

CURRENT = "SELECT * FROM book_entries QUALIFY row_number() OVER (PARTITION BY world, uid ORDER BY saved_at DESC NULLS LAST, entry_id DESC) = 1"
UNITS = lambda c: f"flatten(list_transform(string_split({c}, ''), lambda x: CASE WHEN ord(x) < 65536 THEN [ord(x)::BIGINT] ELSE [(55296 + ((ord(x) - 65536) >> 10))::BIGINT, (56320 + ((ord(x) - 65536) & 1023))::BIGINT] END))"
FNV = lambda c: f"list_reduce(list_prepend(2166136261::BIGINT, {UNITS(c)}), lambda h, u: (xor(h, u) * 16777619) & 4294967295)"
DJB = lambda c: f"list_reduce(list_prepend(5381::BIGINT, {UNITS(c)}), lambda h, u: (h * 33 + u) & 4294967295)"
LAST10 = f"SELECT *, row_number() OVER (PARTITION BY chat_id ORDER BY t DESC, msg_id DESC) - 1 AS back FROM ({USABLE} AND trim(mes) <> '')"
QUERY_TEXT = f"SELECT chat_id, string_agg(CASE WHEN coalesce(name, '') <> '' THEN name || ': ' || trim(mes) ELSE trim(mes) END, chr(10) || chr(10) ORDER BY back DESC) AS query FROM ({LAST10}) WHERE back < 10 GROUP BY chat_id"
IN = lambda words: ", ".join(map(_q, words))
#: pieces of a text: words, ends of sentences, opening signs; with place and the piece before
PIECES = """SELECT world, entry_id, i, p, lag(p) OVER (PARTITION BY entry_id ORDER BY i) AS before FROM (
  SELECT world, entry_id, unnest(ps) AS p, unnest(range(len(ps))) AS i FROM (SELECT world, entry_id, regexp_extract_all(content, '[\\p{L}][\\p{L}''’-]*|[.!?…;\\n]|["“”‘’(\\[{*_:—–«»]') AS ps FROM book_entries WHERE content IS NOT NULL))"""
CORES = f"""SELECT world, entry_id, i, before, p, regexp_matches(p, '^\\p{{L}}') AS is_word, core0, regexp_matches(core0, '(?i)[''’]s$') AS owned,
  CASE WHEN regexp_matches(core0, '(?i)[''’]s$') THEN left(core0, length(core0) - 2) ELSE core0 END AS core FROM (SELECT *, regexp_replace(p, '^[''’-]+|[''’-]+$', '', 'g') AS core0 FROM ({PIECES}))"""
#: the sequence of words of a text, '.' for the end of a run
RUNS = f"""SELECT world, entry_id, i, j, w, core FROM (
  SELECT world, entry_id, i, 1 AS j, '.' AS w, NULL AS core FROM ({CORES}) WHERE p IN ('.', '!', '?', '…', ';', chr(10))
  UNION ALL SELECT world, entry_id, i, 0, '.', NULL FROM ({CORES}) WHERE is_word AND owned
  UNION ALL SELECT world, entry_id, i, 1, lower(core), core FROM ({CORES}) WHERE is_word AND core <> ''
  UNION ALL SELECT world, entry_id, i, 2, '.', NULL FROM ({CORES}) WHERE is_word AND owned)"""
BIGRAMS = f"SELECT world, w AS word, coalesce(lead(w) OVER (PARTITION BY entry_id ORDER BY i, j), '.') AS next FROM ({RUNS})"
F2 = lambda on, rows: f"""SELECT scene_id, CASE WHEN p + r > 0 THEN 5 * p * r / (4 * p + r) ELSE 0 END AS f2 FROM (SELECT scene_id,
  coalesce(sum(CASE WHEN {on} THEN CASE WHEN grade >= 3 THEN 1.0::DOUBLE WHEN grade >= 2 THEN 0.5 ELSE 0 END END) / nullif(count(*) FILTER ({on}), 0), 0) AS p,
  coalesce(count(*) FILTER ({on} AND grade >= 3) / nullif(count(*) FILTER (grade >= 3), 0), 0) AS r FROM ({rows}) GROUP BY scene_id)"""  # noqa: E731


def _arms(arms: dict[str, str], base: str) -> str:
    runs = " UNION ALL ".join(f"SELECT '{a}' AS arm, * FROM ({F2(on, SIGNALS)})" for a, on in arms.items())
    return f"""WITH runs AS ({runs}), d AS (SELECT x.arm, x.f2 - b.f2 AS d FROM runs x JOIN runs b USING (scene_id) WHERE b.arm = '{base}' AND x.arm <> '{base}')
      SELECT arm, CAST(count(*) FILTER (d > 1e-9) AS BIGINT) AS plus, CAST(count(*) FILTER (d < -1e-9) AS BIGINT) AS minus, CAST(count(*) FILTER (abs(d) <= 1e-9) AS BIGINT) AS ties, round(avg(d), 6) AS mean FROM d GROUP BY arm"""


def _ndcg(score: str, arm: str) -> str:
    return f"""SELECT '{arm}' AS arm, count(*) AS scenes, round(avg(CASE WHEN ideal > 0 THEN dcg / ideal ELSE 0 END), 6) AS ndcg FROM (
      SELECT scene_id, sum(CASE WHEN a <= 10 THEN grade / log2(a + 1) ELSE 0 END) AS dcg, sum(CASE WHEN b <= 10 THEN grade / log2(b + 1) ELSE 0 END) AS ideal FROM (
        SELECT scene_id, grade, row_number() OVER (PARTITION BY scene_id ORDER BY {score} DESC, item_id) AS a, row_number() OVER (PARTITION BY scene_id ORDER BY grade DESC) AS b FROM ({SIGNALS})) GROUP BY scene_id)"""


CHUNKS = "SELECT entry_id, t, md5(t || '/' || entry_id) AS hash FROM (SELECT entry_id, coalesce(content, '') AS t FROM book_entries)"
HELD = f"SELECT CASE WHEN entry_id % 3 = 0 THEN md5(hash || 'old') ELSE hash END AS hash FROM ({CHUNKS}) WHERE entry_id % 2 = 0"
RERANK = "CASE block WHEN 'sticky' THEN 1 WHEN 'constant' THEN 2 ELSE 0 END"

OPERATOR_ORACLE: dict[str, str] = {
    # --- sources
    "bundle_files": """SELECT capture_id, n, verdicts, coalesce(r, 0) AS raters FROM (SELECT capture_id, count(*) AS n, CAST(sum(coalesce(len(grades), 0)) AS BIGINT) AS verdicts FROM graded_entries GROUP BY capture_id)
      LEFT JOIN (SELECT capture_id, count(*) AS r FROM scene_raters GROUP BY capture_id) USING (capture_id)""",
    "book_files_read": f"SELECT world, count(*) AS n, CAST(sum(length(content)) AS BIGINT) AS chars, CAST(sum(coalesce(len(key), 0)) AS BIGINT) AS keys, min(uid) AS first_uid FROM ({CURRENT}) GROUP BY world",
    "chat_files_scanned": """SELECT (SELECT count(*) FROM chats) + count(*) AS scanned, CAST(0 AS BIGINT) AS unreadable, CAST(count(*) FILTER (is_system) AS BIGINT) AS hidden FROM chat_messages SEMI JOIN chats USING (chat_id)""",
    "chat_heads": "SELECT world_info AS world, count(*) AS chats FROM chats GROUP BY world_info",
    "collections_listed": "SELECT DISTINCT substr(world, 1, 1) AS collection, CAST(1 AS BIGINT) AS files FROM book_entries",
    "lexicon_packed": f"""SELECT lang, zipf, count(*) AS n FROM (SELECT lang, w, round(log10(count(*) * 10.0), 1) AS zipf FROM (SELECT coalesce(lang, '-') AS lang, unnest({tokens("text")}) AS w FROM documents) GROUP BY lang, w) GROUP BY lang, zipf""",
    "stale_packs": "SELECT world AS lang FROM books WHERE tier IS DISTINCT FROM 'memory'",
    "index_sync": f"""SELECT 'add' AS what, count(*) AS n, min(hash) AS first FROM ({CHUNKS}) WHERE hash NOT IN ({HELD}) HAVING count(*) > 0
      UNION ALL SELECT 'drop', count(*), min(hash) FROM ({HELD}) WHERE hash NOT IN (SELECT hash FROM ({CHUNKS})) HAVING count(*) > 0""",
    "adopted_vectors": "SELECT CAST(vec_id AS VARCHAR) AS hash, round(list_sum(list_transform(embedding, lambda x: x::DOUBLE)), 4) AS total FROM embeddings WHERE label % 2 = 0 AND vec_id % 3 <> 0 AND len(embedding) = 64",
    "orphan_collections": """SELECT world AS collection, CAST(sum(length(content)) AS BIGINT) AS bytes FROM book_entries WHERE world NOT IN (SELECT world FROM books WHERE tier = 'reference') GROUP BY ROLLUP (world)""",
    "adopted_hashes": """SELECT world, uid, coalesce(h, e) AS hash FROM (SELECT world, uid, min(entry_id) AS e FROM book_entries GROUP BY world, uid) LEFT JOIN (SELECT book AS world, uid, min(item_id) AS h FROM graded_entries GROUP BY book, uid) USING (world, uid)""",
    "sliced_rows": "SELECT item_id FROM graded_entries WHERE capture_id IN (SELECT capture_id FROM scene_raters WHERE lower(kind) = 'human')",
    "index_fingerprints": f"""SELECT world, count(*) || ':' || sum(len({UNITS("content")})) || ':' || lower(to_hex((CAST(sum({FNV("world || chr(31) || uid || chr(31) || content")}) AS BIGINT)) % 4294967296)) || ':paragraph:1750:120' AS fingerprint
      FROM book_entries WHERE NOT coalesce(disable, false) AND trim(coalesce(content, '')) <> '' GROUP BY world""",
    "string_hashes": f"SELECT world, {FNV('world')} AS fnv, lower(to_hex({DJB('world')})) AS djb FROM books",
    "canonical_hashes": """SELECT world, sha256('{"lang":' || coalesce('"' || lang || '"', 'null') || ',"tier":' || coalesce('"' || tier || '"', 'null') || ',"world":"' || world || '"}') AS sha FROM books""",
    # --- text, keys
    "query_texts": f"SELECT chat_id, length(query) AS chars, md5(query) AS hash FROM ({QUERY_TEXT})",
    "expanded_macros": "SELECT msg_id, replace(replace(mes, '{{user}}', coalesce(user_name, '{{user}}')), '{{char}}', coalesce(character_name, '{{char}}')) AS text FROM chat_messages JOIN chats USING (chat_id) WHERE contains(mes, '{{')",
    "canonical_keys": f"""SELECT entry_id, {fold("array_to_string(regexp_extract_all(k, '[\\p{L}][\\p{L}''’-]+'), ' ')")} AS canon FROM (SELECT entry_id, unnest(key) AS k FROM book_entries) WHERE k IS NOT NULL""",
    "titled_keys": f"""SELECT key, titled FROM (SELECT key, array_to_string(list_transform(w, lambda x, i: CASE WHEN i = 1 OR i = len(w) OR lower(x) NOT IN ({IN(sorted(NAME_PARTICLES))}) THEN upper(left(x, 1)) || x[2:] ELSE x END), ' ') AS titled
      FROM (SELECT DISTINCT key, regexp_split_to_array(key, '\\s+') AS w FROM (SELECT unnest(key) AS key FROM book_entries) WHERE trim(key) <> '' AND NOT starts_with(key, '?') AND NOT starts_with(key, '/'))) WHERE titled <> key""",
    "keys_by_length": """SELECT entry_id, CASE WHEN key IS NOT NULL THEN coalesce(ks, '') END AS keys FROM book_entries LEFT JOIN (SELECT entry_id, string_agg(k, '|' ORDER BY n DESC NULLS FIRST, i) AS ks FROM (
      SELECT entry_id, unnest(key) AS k, unnest(list_transform(key, lambda x: length(x))) AS n, unnest(range(len(key))) AS i FROM book_entries) GROUP BY entry_id) USING (entry_id)""",
    "gated_keys": f"""WITH e AS (SELECT entry_id, coalesce(selective_logic, 0) AS logic, {fold(masked("content"))} AS hay, list_filter(keysecondary, lambda k: trim(coalesce(k, '')) <> '') AS sec FROM book_entries WHERE len(keysecondary) > 0 AND content IS NOT NULL),
      s AS (SELECT *, list_transform(sec, lambda k: contains(hay, {fold("trim(k)")})) AS f FROM e WHERE len(sec) > 0 AND NOT list_bool_or(list_transform(sec, lambda k: regexp_matches(trim(k), '^[?/]') OR contains(k, '-'))))
      SELECT entry_id, logic, CASE logic WHEN 0 THEN list_bool_or(f) WHEN 1 THEN NOT list_bool_and(f) WHEN 2 THEN NOT list_bool_or(f) ELSE list_bool_and(f) END AS open FROM s""",
    "audit_scope": "SELECT entry_id FROM book_entries WHERE NOT coalesce(disable, false) AND NOT coalesce(constant, false)",
    "state_parts": """SELECT entry_id, array_to_string(list_filter([CASE WHEN disable THEN 'disabled' END, CASE WHEN constant THEN 'constant' END, CASE WHEN vectorized THEN 'vector' END, CASE WHEN len(keysecondary) > 0 THEN 'gated' END], lambda x: x IS NOT NULL), ',') AS parts FROM book_entries""",
    "ranked_search": f"""SELECT entry_id, CAST(f AS INTEGER) AS found_in, CAST(row_number() OVER (PARTITION BY world ORDER BY f, uid, entry_id) AS INTEGER) AS place FROM (SELECT entry_id, world, uid,
      CASE WHEN contains({fold("coalesce(comment, '')")}, 'lantern') THEN 0 WHEN contains({fold("array_to_string(coalesce(key, []), chr(10))")}, 'lantern') THEN 1 WHEN contains({fold(masked("coalesce(content, '')"))}, 'lantern') THEN 2 END AS f FROM book_entries) WHERE f IS NOT NULL""",
    "successor_variety": f"SELECT world, word, count(*) AS uses, count(DISTINCT next) AS successors, CASE WHEN count(DISTINCT next) = 1 THEN min(next) END AS only FROM ({BIGRAMS}) WHERE word <> '.' GROUP BY world, word",
    "word_contexts": f"""WITH p AS ({BIGRAMS}), b AS (SELECT world, next AS word, count(*) AS n, count(*) FILTER (word IN ({IN(DETERMINERS)})) AS d, count(*) FILTER (word IN ({IN(PRONOUNS)})) AS s FROM p WHERE next <> '.' GROUP BY ALL),
      a AS (SELECT world, word, count(*) AS n, count(*) FILTER (next IN ({IN(DETERMINERS)})) AS d FROM p WHERE word <> '.' GROUP BY ALL),
      j AS (SELECT world, word, coalesce(b.n, 0) AS before, coalesce(b.d, 0) AS after_determiner, coalesce(b.s, 0) AS after_pronoun, coalesce(a.n, 0) AS followed, coalesce(a.d, 0) AS by_determiner FROM b FULL JOIN a USING (world, word))
      SELECT *, coalesce(before >= 5 AND after_pronoun / nullif(before, 0) > 0.4 AND after_determiner / nullif(before, 0) < 0.1, false) AS verb_head, coalesce(followed >= 2 AND by_determiner / nullif(followed, 0) > 0.5, false) AS takes_object FROM j""",
    "form_votes": f"""SELECT world, word, arg_max(core, (n, CASE WHEN regexp_matches(core, '\\p{{Lu}}{{3,}}') THEN 0 ELSE 1 END, encode(core))) AS form FROM (SELECT world, w AS word, core, count(*) AS n FROM ({RUNS}) WHERE w <> '.' GROUP BY ALL) GROUP BY world, word""",
    "cap_ratio": f"""WITH c AS (SELECT world, entry_id, lower(core) AS word, core, before IS NULL OR NOT regexp_matches(before, '^\\p{{L}}') AS opens FROM ({CORES}) WHERE is_word AND core <> ''),
      n AS (SELECT *, length(core) > 1 AND upper(core) = core AND lower(core) <> core AS shout, regexp_matches(core, '^\\p{{Lu}}') AS up, regexp_matches(core, '^\\p{{Ll}}') AS low FROM c),
      s AS (SELECT world, word, count(DISTINCT entry_id) AS df, count(*) AS cf, count(*) FILTER (low) AS lower, count(*) FILTER (up AND NOT opens) AS caps_mid, count(*) FILTER (shout) AS shouted, count(*) FILTER (NOT shout) AS mixed FROM n GROUP BY world, word)
      SELECT *, (length(word) <= 6 AND shouted > 0 AND mixed = 0) OR (caps_mid > 0 AND caps_mid / (caps_mid + lower) >= 0.95 AND word <> 'i') AS is_name FROM s""",
    "uid_reindex": """WITH c AS (SELECT *, row_number() OVER (PARTITION BY world ORDER BY uid) - 1 AS place FROM (SELECT DISTINCT world, uid FROM book_entries WHERE coalesce(constant, false))), m AS (SELECT world, uid, 10 + place AS target FROM c)
      SELECT world, uid, CAST(target AS BIGINT) AS target, 'move' AS what FROM m
      UNION ALL SELECT world, uid, NULL, 'conflict' FROM (SELECT DISTINCT world, uid FROM book_entries) e WHERE (world, uid) NOT IN (SELECT world, uid FROM c) AND (world, uid) IN (SELECT world, target FROM m)""",
    "state_rekeyed": """WITH r AS (SELECT entry_id AS key, min(uid) AS "at" FROM book_entries GROUP BY entry_id), g AS (SELECT key, "at", CASE WHEN key % 2 = 0 THEN key + 1 END AS target FROM r WHERE key % 5 = 0),
      k AS (SELECT * FROM r WHERE key % 5 <> 0)
      SELECT key, "at", 'kept' AS fate FROM k WHERE key NOT IN (SELECT target FROM g WHERE target IS NOT NULL) UNION ALL SELECT target, "at", 'kept' FROM g WHERE target IS NOT NULL
      UNION ALL SELECT key, "at", 'lost' FROM k WHERE key IN (SELECT target FROM g WHERE target IS NOT NULL) UNION ALL SELECT key, "at", 'lost' FROM g WHERE target IS NULL""",
    # --- activation, delivery
    "gate_verdicts": """SELECT entry_id, CASE WHEN n % 7 = 0 AND n < 10 THEN 'skip' WHEN n % 4 = 3 AND n % 8 = 3 THEN 'skip' WHEN n % 4 = 0 AND n // 2 < 5 THEN 'skip' WHEN n % 4 = 2 THEN 'skip' WHEN n % 4 = 1 AND (n // 2) % 3 <> 0 THEN 'skip' END AS verdict
      FROM (SELECT entry_id, uid % 40 AS n FROM book_entries)""",
    "timed_states": """SELECT entry_id, CASE WHEN 8 < a % 10 THEN 'delayed' WHEN a = 0 OR a >= 8 THEN NULL WHEN 8 < a + a % 4 THEN 'sticky' WHEN 8 < a + a % 4 + a % 3 THEN 'cooldown' END AS state FROM (SELECT entry_id, uid % 12 AS a FROM book_entries)""",
    "inclusion_groups": """SELECT world AS chat_id, entry_group, entry_id FROM book_entries WHERE coalesce(entry_group, '') <> ''
      QUALIFY row_number() OVER (PARTITION BY world, entry_group ORDER BY coalesce(constant, false) DESC, coalesce(vectorized, false) DESC, CASE WHEN vectorized THEN uid ELSE 0 END DESC, entry_id DESC) = 1""",
    "ungrouped_probable": "SELECT entry_id FROM book_entries WHERE coalesce(constant, false) OR uid % 3 <> 0",
    "sources_used": """WITH a AS (SELECT world, bool_or(uid % 50 = 0) AS scenario, bool_or(coalesce(constant, false)) AS notes FROM book_entries GROUP BY world)
      SELECT chat_id, 'scenario' AS source FROM chats JOIN a ON world = world_info WHERE scenario AND coalesce(character_name, '') <> '' UNION ALL SELECT chat_id, 'creator_notes' FROM chats JOIN a ON world = world_info WHERE notes AND coalesce(character_name, '') <> ''""",
    "undecided_shipped": f"SELECT entry_id FROM ({ITEMS}) WHERE block IN ('constant', 'sticky')",
    "grade_ordered": f"SELECT entry_id, CAST(row_number() OVER (PARTITION BY scene ORDER BY {RERANK}, authored, entry_id) - 1 AS INTEGER) AS place FROM ({ITEMS})",
    "host_ordered": """SELECT entry_id, CAST(row_number() OVER (PARTITION BY world ORDER BY coalesce(constant, false) DESC, uid % 3, CASE WHEN coalesce(vectorized, false) THEN -1 ELSE uid END DESC, entry_id) - 1 AS INTEGER) AS place FROM book_entries""",
    "depth_discount": f"SELECT item_id, round(score / (1 + keys % 4), 6) AS score FROM ({SIGNALS})",
    "repeat_curves": """SELECT entry_id, round(CASE WHEN n > 0 THEN 1 + (n - 1) / ((n - 1) + 1.2::DOUBLE) ELSE 0.0 END, 6) AS a, round(CASE WHEN n > 0 THEN 1 + ln(1 + (n - 1) / 1.2::DOUBLE) ELSE 0.0 END, 6) AS b, round(CASE WHEN n > 0 THEN n / (n + 1.2::DOUBLE) ELSE 0.0 END, 6) AS c
      FROM (SELECT entry_id, CAST(uid AS INTEGER) % 9 AS n FROM book_entries)""",
    "relevance_cut": f"SELECT item_id FROM ({ECREDIT}) WHERE round(e, 6) >= 0.4",
    "weighted_credit": f"""SELECT entry_id, round(CASE WHEN e_credit > 0 AND e_credit < 1 AND w <> 0 THEN 1 / (1 + exp(-(ln(e_credit / (1 - e_credit)) + w))) ELSE e_credit END, 6) AS credit FROM (SELECT *, ln(authored % 5 + 1.0::DOUBLE) AS w FROM ({ITEMS}))""",
    "available_entries": "SELECT entry_id FROM book_entries WHERE NOT CASE WHEN uid % 3 = 0 THEN uid >= 20 WHEN uid % 2 = 0 THEN uid > 20 ELSE false END",
    "shared_names": f"""WITH c AS ({CURRENT}), o AS (SELECT world, entry_id, unnest(list_distinct({tokens("content")})) AS term FROM c), d AS (SELECT world, term, count(*) AS df FROM o GROUP BY ALL), n AS (SELECT world, count(*) AS ndoc, min(entry_id) AS first FROM c GROUP BY world),
      w AS (SELECT o.world, o.term FROM o JOIN n ON n.world = o.world AND n.first = o.entry_id)
      SELECT world AS chat_id, entry_id, round(sum(ln((ndoc + 1) / (df + 1))), 5) AS mass FROM w JOIN o USING (world, term) JOIN d USING (world, term) JOIN n USING (world) GROUP BY world, entry_id""",
    # --- grades and studies
    "graded_split": f"SELECT item_id, item_id IN (SELECT item_id FROM ({VERDICTS}) WHERE valid) AS graded FROM graded_entries",
    "merged_passes": f"""WITH v AS (SELECT item_id, rater_id, graded_at, arg_min(grade, (pos, grade)) AS grade FROM ({VERDICTS}) WHERE valid AND rater_id IS NOT NULL AND graded_at IS NOT NULL GROUP BY ALL),
      m AS (SELECT item_id, rater_id, left(graded_at, 10) AS day, arg_min(grade, graded_at) AS grade FROM v GROUP BY ALL)
      SELECT item_id, count(*) AS n, CAST(sum(grade) AS BIGINT) AS total FROM m GROUP BY item_id""",
    "searched_books": "SELECT capture_id, arg_min(book, (-n, book)) AS book FROM (SELECT capture_id, book, count(*) AS n FROM graded_entries WHERE uid % 3 <> 0 AND coalesce(book, '') <> '' GROUP BY ALL) GROUP BY capture_id",
    "grafted_grades": f"""SELECT CASE WHEN e.uid IS NULL THEN 'unknown entry' WHEN e.uid % 7 = 0 THEN 'entry gone' WHEN e.uid % 5 = 0 AND e.comment IS DISTINCT FROM 'changed' THEN 'title changed' WHEN e.uid % 3 = 0 AND e.content IS DISTINCT FROM 'changed' THEN 'content changed' ELSE 'kept' END AS fate, count(*) AS n
      FROM graded_entries g LEFT JOIN ({CURRENT}) e ON e.world = g.book AND e.uid = g.uid GROUP BY ALL""",
    "pool_extension": f"""SELECT item_id, CASE WHEN uid % 20 < 10 AND uid % 15 < 10 THEN 'a,b' WHEN uid % 20 < 10 THEN 'a' ELSE 'b' END AS arms, least(CASE WHEN uid % 20 < 10 THEN uid % 20 END, CASE WHEN uid % 15 < 10 THEN uid % 15 END) AS best_rank FROM graded_entries
      WHERE (uid % 20 < 10 OR uid % 15 < 10) AND item_id NOT IN (SELECT item_id FROM ({VERDICTS}) WHERE valid)""",
    "divergences": f"SELECT item_id, 'over-match' AS kind FROM ({SIGNALS}) WHERE score >= 15 AND grade <= 1 UNION ALL SELECT item_id, 'miss' FROM ({SIGNALS}) WHERE keys > 8 AND NOT score >= 15",
    "paired_arms": _arms({"base": "score >= 15", "low": "score >= 8", "high": "score >= 22"}, "base"),
    "parameter_screen": _arms({"base": "score >= 15", "low": "score >= 8", "keys": "keys >= 8", "text": "text >= 12"}, "base"),
    "holm_adjusted": """SELECT n_nationkey, round(max(s) OVER (PARTITION BY n_regionkey ORDER BY p, n_nationkey ROWS UNBOUNDED PRECEDING), 6) AS p_holm FROM (SELECT *, least(1.0, (count(*) OVER (PARTITION BY n_regionkey) - row_number() OVER (PARTITION BY n_regionkey ORDER BY p, n_nationkey) + 1) * p) AS s
      FROM (SELECT n_nationkey, n_regionkey, (n_nationkey * 7 % 25 + 1) / 250.0::DOUBLE AS p FROM nation))""",
    "parameter_grid": " UNION ALL ".join(_ndcg(f"text + keys * {w}", f"w{w}") for w in (0, 1, 10)),
    "token_offsets": "SELECT lang, count(*) AS n, min(d) AS low, max(d) AS high, min(d) = max(d) AS constant FROM (SELECT lang, n_chars - length(coalesce(text, '')) AS d FROM documents) GROUP BY lang",
    "route_union": f"""WITH i AS ({ITEMS}), r AS (SELECT scene, entry_id, authored, tokens FROM i WHERE block = 'constant' UNION ALL SELECT scene, entry_id, authored, tokens FROM (SELECT *, row_number() OVER (PARTITION BY scene ORDER BY coalesce(e_credit, 0) DESC, entry_id) AS k FROM i WHERE block <> 'constant') WHERE k <= 5)
      SELECT entry_id, CAST(u AS BIGINT) AS upto FROM (SELECT entry_id, sum(tokens) OVER (PARTITION BY scene ORDER BY authored, entry_id ROWS UNBOUNDED PRECEDING) AS u FROM r) WHERE u <= 2000""",
    "cost_curve": " UNION ALL ".join(
        f"""SELECT {c}::DOUBLE AS cutoff, round(avg(t), 4) AS tokens, round(avg(f2), 6) AS f2 FROM (SELECT scene_id, sum(CASE WHEN score >= {c} THEN text + 10 ELSE 0 END) AS t FROM ({SIGNALS}) GROUP BY scene_id) JOIN ({F2(f"score >= {c}", SIGNALS)}) USING (scene_id)"""
        for c in (5.0, 15.0, 25.0)
    ),
    "repaired_tiers": "SELECT entry_id, CASE WHEN coalesce(regexp_matches(comment, '(?i)^\\s*(the|a) '), false) THEN 'memory' ELSE 'reference' END AS tier FROM book_entries",
    "ungated_keys": """WITH k AS (SELECT entry_id, unnest(key) AS key, coalesce(constant, false) AS c FROM book_entries), h AS (SELECT key, count(*) * 3 AS n FROM k WHERE key IS NOT NULL GROUP BY key)
      SELECT CASE WHEN n = 0 THEN '0' WHEN n <= 3 THEN '1-3' WHEN n <= 20 THEN '4-20' WHEN n <= 100 THEN '21-100' ELSE '>100' END AS band, count(*) AS rows, count(DISTINCT key) AS keys FROM h WHERE key NOT IN (SELECT key FROM k WHERE c AND key IS NOT NULL) GROUP BY band""",
    "rated_confusion": f"SELECT a, " + ", ".join(f"count(*) FILTER (b = {g}) AS b{g}" for g in range(5)) + f" FROM ({PAIRS}) GROUP BY a",
    "events_windowed": "SELECT CAST(floor(epoch(ts) / 3600) * 3600 AS BIGINT) AS hour, event_type, count(*) AS n, round(sum(value), 4) AS total FROM events GROUP BY ALL",
    "turn_windows": f"SELECT msg_id, CAST(count(*) OVER w AS INTEGER) AS n, CAST(sum(length(mes)) OVER w AS INTEGER) AS chars FROM ({USABLE}) WINDOW w AS (PARTITION BY chat_id ORDER BY t, msg_id ROWS 2 PRECEDING)",
}

VOCAB = """SELECT entry_id, world, coalesce(regexp_matches(comment, '(?i)^\\s*\\[?\\s*arc\\b'), false) AS arc, list_sort(list_distinct(regexp_extract_all(lower(content), '[\\p{L}][\\p{L}''-]{2,}'))) AS ws FROM book_entries WHERE length(content) > 200"""
BODIES = "SELECT DISTINCT world, md5(lower(trim(regexp_replace(content, '\\s+', ' ', 'g')))) AS h FROM book_entries WHERE coalesce(content, '') <> ''"


def _names(rows: str, key: str, text: str) -> str:
    """(key, term): words that stand capitalised inside a sentence of a text."""
    return f"""SELECT DISTINCT {key}, lower(t) AS term FROM (SELECT {key}, unnest(w[2:]) AS t FROM (SELECT {key}, list_filter(regexp_split_to_array(s, '[^\\p{{L}}\\p{{N}}\\p{{M}}'']+'), lambda x: length(x) > 1) AS w FROM (
      SELECT {key}, trim(unnest(regexp_split_to_array(regexp_replace({text}, '([.!?])\\s+', '\\1' || chr(10), 'g'), '\\n+')), E' \\t\\r\\n') AS s FROM ({rows}))
      WHERE NOT regexp_full_match(s, '#{{1,6}}\\s+\\S.*|\\*\\*[^*]+:?\\*\\*|\\p{{Lu}}[\\p{{L}}'' ]{{0,30}}:'))) WHERE regexp_matches(t, '^\\p{{Lu}}')"""


GAZETTEER = f"SELECT DISTINCT unnest({tokens('x')}) AS term FROM (SELECT unnest(list_concat(list_concat(coalesce(key, []), coalesce(keysecondary, [])), [comment])) AS x FROM book_entries) WHERE x IS NOT NULL"
TEXTS = f"SELECT msg_id, {fold('m')} AS f, {ortho('m')} AS o FROM (SELECT msg_id, {masked('nfc_normalize(mes)')} AS m FROM chat_messages WHERE NOT coalesce(is_system, false) AND coalesce(mes, '') <> '')"
KEYS = f"SELECT DISTINCT key, form, {ortho('nfc_normalize(key)')} AS o FROM ({FORMS})"
STOPS = f"SELECT world, word FROM ({OPERATOR_ORACLE['cap_ratio']}) JOIN (SELECT world, count(*) AS n FROM book_entries GROUP BY world) USING (world) WHERE df / n > 0.3 AND cf / df < 6 AND NOT is_name"
PACK_WORDS = "the a an and or of to in on at for from with by is are was were be it its that this as but not no so than then if he she they i we you his her their my your".split()
SEQ = f"SELECT world, entry_id, w, row_number() OVER (PARTITION BY entry_id ORDER BY i, j) AS pos FROM ({RUNS})"
GRAMS = f"""SELECT world, entry_id, gram, content, nxt FROM (
  WITH RECURSIVE stop AS MATERIALIZED ({STOPS}), q AS MATERIALIZED (SELECT s.world, s.entry_id, s.pos, s.w, s.w IN ({IN(sorted(LINKERS))}) AS link, s.w IN ({IN(sorted(PARTICLES))}) AS part,
      length(s.w) < 2 OR s.w = '.' OR s.w IN ({IN(PACK_WORDS)}) OR stop.word IS NOT NULL AS blocked FROM ({SEQ}) s LEFT JOIN stop ON stop.world = s.world AND stop.word = s.w),
    g AS (SELECT world, entry_id, pos, w AS gram, CASE WHEN link THEN 0 ELSE 1 END AS content, NOT link AS emit FROM q WHERE NOT blocked OR part
      UNION ALL SELECT g.world, g.entry_id, q.pos, g.gram || ' ' || q.w, g.content + CASE WHEN q.link THEN 0 ELSE 1 END, NOT q.link FROM g JOIN q ON q.entry_id = g.entry_id AND q.pos = g.pos + 1 WHERE q.link OR (NOT q.blocked AND g.content < 4))
  SELECT g.world, g.entry_id, gram, content, coalesce(n.w, '.') AS nxt FROM g LEFT JOIN q n ON n.entry_id = g.entry_id AND n.pos = g.pos + 1 WHERE emit)"""
DATED = "regexp_matches(gram, '\\b(?:19|20)\\d{2}\\b') OR regexp_matches(gram, '\\b\\d{1,2}[/.-]\\d{1,2}[/.-]\\d{2,4}\\b') OR (regexp_matches(gram, '\\b(?:jan(?:uary)?|feb(?:ruary)?|mar(?:ch)?|apr(?:il)?|may|june?|july?|aug(?:ust)?|sep(?:t(?:ember)?)?|oct(?:ober)?|nov(?:ember)?|dec(?:ember)?)\\b') AND regexp_matches(gram, '\\d'))"
SCORED = f"""SELECT world, entry_id, gram, tf, df, words, tf * ln((n + 1) / (df + 0.5::DOUBLE)) * (1 + 0.5::DOUBLE * (content - 1)) AS score FROM (SELECT *, len(string_split(gram, ' ')) AS words, sum(tf) OVER b AS cf, count(*) OVER b AS df, min(lo) OVER b AS n1, max(hi) OVER b AS n2 FROM (
    SELECT world, entry_id, gram, any_value(content) AS content, count(*) AS tf, min(nxt) AS lo, max(nxt) AS hi FROM ({GRAMS}) GROUP BY world, entry_id, gram) WINDOW b AS (PARTITION BY world, gram))
  JOIN (SELECT world, count(*) AS n FROM book_entries GROUP BY world) USING (world) WHERE df / n <= 0.35 AND NOT (words > 1 AND cf >= 2 AND n1 = n2 AND n1 <> '.') AND NOT ({DATED})"""
WALKED = f"SELECT w.*, coalesce(e.vectorized, false) AS vector FROM ({WALK}) w JOIN book_entries e USING (entry_id)"

OPERATOR_ORACLE |= {
    "pooled_cosine_all": """WITH mean AS (SELECT list(x ORDER BY i) AS mean FROM (SELECT i, avg(x) AS x FROM (SELECT unnest(embedding)::DOUBLE AS x, unnest(range(len(embedding))) AS i FROM embeddings) GROUP BY i)),
      base AS (SELECT vec_id, label, list_transform(list_zip(embedding, mean), lambda z: z[1]::DOUBLE - z[2]) AS v FROM embeddings, mean)
      SELECT q.vec_id AS query_id, b.label, round(max(round(list_cosine_similarity(q.v, b.v), 9)), 6) AS score, arg_max(b.vec_id, (round(list_cosine_similarity(q.v, b.v), 9), b.vec_id)) AS vec_id FROM base q, base b WHERE q.vec_id % 100 = 0 GROUP BY ALL""",
    "near_duplicates": f"""WITH RECURSIVE v AS MATERIALIZED (SELECT * FROM ({VOCAB}) WHERE len(ws) > 0), r AS MATERIALIZED (SELECT min(entry_id) AS rep, world, arc, ws FROM v GROUP BY world, arc, ws),
      l AS MATERIALIZED (SELECT a.rep AS u, b.rep AS v FROM r a JOIN r b ON a.world = b.world AND a.arc = b.arc AND a.rep <> b.rep WHERE len(list_intersect(a.ws, b.ws)) / (len(a.ws) + len(b.ws) - len(list_intersect(a.ws, b.ws))) >= 0.35),
      c AS (SELECT rep AS node, rep AS root FROM r UNION SELECT l.v, c.root FROM c JOIN l ON l.u = c.node), k AS (SELECT node, min(root) AS class FROM c GROUP BY node), d AS (SELECT u, count(*) AS n FROM l GROUP BY u)
      SELECT e.entry_id, coalesce(k.class, e.entry_id) AS class_id, coalesce(d.n, 0) AS links FROM book_entries e LEFT JOIN v USING (entry_id) LEFT JOIN r ON r.world = v.world AND r.arc = v.arc AND r.ws = v.ws LEFT JOIN k ON k.node = r.rep LEFT JOIN d ON d.u = r.rep""",
    "lineage_components": f"""WITH RECURSIVE s AS MATERIALIZED ({BODIES}), n AS (SELECT world, count(*) AS n FROM s GROUP BY world),
      l AS MATERIALIZED (SELECT a.world AS u, b.world AS v FROM s a JOIN s b ON a.h = b.h AND a.world <> b.world JOIN n x ON x.world = a.world JOIN n y ON y.world = b.world GROUP BY a.world, b.world, x.n, y.n HAVING count(*) / least(x.n, y.n) >= 0.3),
      c AS (SELECT DISTINCT world AS node, world AS root FROM book_entries UNION SELECT l.v, c.root FROM c JOIN l ON l.u = c.node)
      SELECT node AS world, arg_min(root, (length(root), root)) AS lineage FROM c GROUP BY node""",
    "name_idf": f"""SELECT world, term, count(*) AS df, ndoc FROM ({_names(f"SELECT entry_id, {ortho('content')} AS t FROM book_entries WHERE trim(coalesce(content, '')) <> ''", "entry_id", "t")}) JOIN book_entries USING (entry_id)
      JOIN (SELECT world, count(*) AS ndoc FROM book_entries WHERE trim(coalesce(content, '')) <> '' GROUP BY world) USING (world) GROUP BY world, term, ndoc""",
    "name_terms": f"""WITH q AS ({QUERY_TEXT}), t AS (SELECT chat_id, unnest(list_distinct({tokens("query")})) AS term FROM q), n AS ({_names(f"SELECT chat_id, {ortho('query')} AS t FROM q", "chat_id", "t")}), g AS ({GAZETTEER})
      SELECT chat_id, CASE WHEN n.term IS NOT NULL THEN 3.0::DOUBLE ELSE 1.0 END AS weight, count(*) AS n FROM t LEFT JOIN n USING (chat_id, term) WHERE n.term IS NOT NULL OR t.term IN (SELECT term FROM g) GROUP BY ALL""",
    "substring_shares": f"""WITH t AS MATERIALIZED ({TEXTS}), k AS MATERIALIZED ({KEYS}),
      h AS (SELECT key, msg_id, bool_or(regexp_matches(f, '(?:^|[^{CLASS}]|--)' || regexp_escape(form) || '(?:$|[^{CLASS}]|--)')) AS w, bool_or(contains(t.o, k.o) OR (contains(k.o, '-') AND length(trim(replace(k.o, '-', ' '))) = length(k.o) AND contains(t.o, replace(k.o, '-', ' ')))) AS c
        FROM k JOIN t ON contains(f, form) GROUP BY key, msg_id)
      SELECT key, count(*) AS any, CAST(count(*) FILTER (w) AS BIGINT) AS as_word, CAST(count(*) FILTER (c) AS BIGINT) AS in_case FROM h GROUP BY key""",
    "budget_walk_slack": f"""WITH RECURSIVE w AS MATERIALIZED ({WALKED}), r AS (
        SELECT scene, -1 AS walk, CAST(NULL AS BIGINT) AS entry_id, true AS admitted, CAST([] AS VARCHAR[]) AS reasons, 0 AS spent, 0 AS in_prompt, 0 AS dyn, 0 AS vec, false AS used FROM (SELECT DISTINCT scene FROM w)
        UNION ALL SELECT scene, walk, entry_id, ok, CASE WHEN ok THEN CAST([] AS VARCHAR[]) ELSE reasons END, CASE WHEN ok AND NOT exempt THEN spent + tokens ELSE spent END, CASE WHEN ok THEN in_prompt + tokens ELSE in_prompt END,
          dyn + CASE WHEN ok AND NOT exempt AND block = 'dynamic' THEN 1 ELSE 0 END, vec + CASE WHEN ok AND NOT exempt AND vector AND {RANKED} THEN 1 ELSE 0 END, used OR (ok AND NOT exempt AND rescued)
        FROM (SELECT *, len(reasons) = 0 OR exempt AS ok FROM (SELECT w.scene, w.walk, w.entry_id, w.tokens, w.block, w.exempt, w.vector, r.spent, r.in_prompt, r.dyn, r.vec, r.used, r.spent + w.tokens > 1500 AND r.spent + w.tokens <= 1650 AND NOT r.used AS rescued,
          list_filter([CASE WHEN r.spent + w.tokens > 1500 AND NOT (r.spent + w.tokens <= 1650 AND NOT r.used) THEN 'tokens' END, CASE WHEN w.block = 'dynamic' AND r.dyn >= 6 THEN 'dynamic' END, CASE WHEN {RANKED} AND w.vector AND r.vec >= 3 THEN 'vector' END], lambda x: x IS NOT NULL) AS reasons
          FROM r JOIN w ON w.scene = r.scene AND w.walk = r.walk + 1)))
      SELECT entry_id, admitted, reasons, CAST(spent AS BIGINT) AS spent, CAST(in_prompt AS BIGINT) AS in_prompt, NOT admitted AND walk > max(CASE WHEN admitted THEN walk ELSE -1 END) OVER (PARTITION BY scene) AS tail FROM r WHERE walk >= 0""",
    "ngram_tfidf": f"SELECT world, CAST(words AS INTEGER) AS words, count(*) AS n, round(max(score), 5) AS best FROM ({SCORED}) GROUP BY ALL",
    "cohesion_bigram": f"""WITH d AS MATERIALIZED (SELECT DISTINCT world, gram, words, df FROM ({SCORED})), s AS (SELECT world, gram, df, unnest([array_to_string(string_split(gram, ' ')[1:2], ' '), array_to_string(string_split(gram, ' ')[-2:], ' ')]) AS s FROM d WHERE words > 2)
      SELECT s.world, s.gram, coalesce(any_value(s.df) / (2.0::DOUBLE * max(b.df)), 1.0) AS cohesion FROM s LEFT JOIN d b ON b.world = s.world AND b.gram = s.s GROUP BY s.world, s.gram""",
}

NAMED = f"SELECT world, word FROM ({OPERATOR_ORACLE['cap_ratio']}) WHERE is_name"
OPERATOR_ORACLE["key_suggestions"] = f"""WITH named AS MATERIALIZED ({NAMED}), g AS MATERIALIZED ({SCORED}),
  odd AS (SELECT DISTINCT entry_id, gram FROM (SELECT world, entry_id, gram, unnest(string_split(gram, ' ')) AS word FROM g WHERE tf < 2) WHERE word NOT IN ({IN(sorted(LINKERS))}) AND (world, word) NOT IN (SELECT world, word FROM named)),
  r AS MATERIALIZED (SELECT * FROM g ANTI JOIN odd USING (entry_id, gram)), d AS MATERIALIZED (SELECT DISTINCT world, gram, words, df FROM r),
  s AS (SELECT world, gram, df, unnest([array_to_string(string_split(gram, ' ')[1:2], ' '), array_to_string(string_split(gram, ' ')[-2:], ' ')]) AS s FROM d WHERE words > 2),
  k AS (SELECT s.world, s.gram, coalesce(any_value(s.df) / (2.0::DOUBLE * max(b.df)), 1.0) AS cohesion FROM s LEFT JOIN d b ON b.world = s.world AND b.gram = s.s GROUP BY s.world, s.gram),
  c AS MATERIALIZED (SELECT r.*, coalesce(cohesion, 1.0) >= 0.4 OR words < 3 AS cohesive FROM r LEFT JOIN k USING (world, gram)),
  p AS (SELECT l.entry_id, l.gram AS long, s.gram AS short, l.cohesive, s.words FROM c l JOIN c s ON l.entry_id = s.entry_id AND l.tf = s.tf AND l.gram <> s.gram AND contains(' ' || l.gram || ' ', ' ' || s.gram || ' ') WHERE l.words > 1),
  lost AS (SELECT entry_id, short AS gram FROM p WHERE cohesive AND words > 1 UNION SELECT entry_id, long FROM p WHERE NOT cohesive AND words = 2 AND (starts_with(long, short || ' ') OR ends_with(long, ' ' || short))),
  have AS (SELECT entry_id, trim(lower(unnest(key))) AS gram FROM book_entries)
  SELECT world, entry_id, gram, CAST(tf AS INTEGER) AS tf, df, round(score, 6) AS score, CAST(rank AS INTEGER) AS rank FROM (SELECT *, row_number() OVER (PARTITION BY entry_id ORDER BY score DESC, gram) AS rank FROM c WHERE (entry_id, gram) NOT IN (SELECT entry_id, gram FROM lost) AND (entry_id, gram) NOT IN (SELECT entry_id, gram FROM have WHERE gram IS NOT NULL)) WHERE rank <= 10"""

ORACLE.update(OPERATOR_ORACLE)
