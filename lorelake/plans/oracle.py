"""SQL that gives the same rows as the registered queries, for a single-node engine."""

from __future__ import annotations

from ..functions.text import APOSTROPHES, BLOCK_ELEMENTS, COMBINING, DOUBLE_QUOTES, SPELLED


def _q(s: str) -> str:
    return "'" + s.replace("'", "''") + "'"


def ortho(c: str) -> str:
    whole = f"CASE WHEN regexp_matches({c}, {_q(COMBINING)}) THEN nfc_normalize({c}) ELSE coalesce({c}, '') END"
    out = f"translate({whole}, {_q(APOSTROPHES + DOUBLE_QUOTES)}, {_q(chr(39) * len(APOSTROPHES) + chr(34) * len(DOUBLE_QUOTES))})"
    for sign, plain in SPELLED:
        out = f"replace({out}, {_q(sign)}, {_q(plain)})"
    return out


def fold(c: str) -> str:
    return f"lower({ortho(c)})"


def tokens(c: str) -> str:
    return f"list_filter(regexp_split_to_array({fold(c)}, '[^\\p{{L}}\\p{{N}}\\p{{M}}'']+'), lambda t: length(t) > 1)"


def masked(c: str) -> str:
    return f"regexp_replace({c}, '(?s)<!--.*?-->|</?[A-Za-z][^>]*>', ' ', 'g')"


_NAMES = "|".join(BLOCK_ELEMENTS)
_MARKED = (
    f"regexp_replace(regexp_replace(coalesce(mes, ''), '(?i)(<(?:{_NAMES})\\b[^>]*>)', chr(1) || '\\1', 'g'), '(?i)(</(?:{_NAMES})>)', '\\1' || chr(1), 'g')"
)
DATE = """CASE WHEN regexp_full_match(trim(send_date), '\\d{12,14}') THEN try_cast(trim(send_date) AS BIGINT) * 1000
  WHEN regexp_full_match(trim(send_date), '\\d{9,10}') THEN try_cast(trim(send_date) AS BIGINT) * 1000000
  ELSE epoch_us(coalesce(try_strptime(trim(send_date), '%Y-%m-%dT%H:%M:%S.%gZ'), try_strptime(trim(send_date), '%Y-%m-%d@%Hh%Mm%Ss'), try_strptime(trim(send_date), '%B %-d, %Y %-I:%M%p'))) END"""
USABLE = f"SELECT *, coalesce({DATE}, 0) AS t FROM chat_messages WHERE NOT coalesce(is_system, false) AND coalesce(mes, '') <> ''"
CLASS = "\\p{L}\\p{N}\\p{M}\\-''’"
HAY = masked("coalesce(mes, '')")
FHAY = fold(HAY)
VERDICTS = """SELECT v.item_id, v.book, v.pos, r.rater_id, lower(r.kind) AS kind, v.g.grade AS grade, v.g.graded_at AS graded_at, coalesce(v.g.grade BETWEEN 0 AND 4, false) AS valid
  FROM (SELECT item_id, book, capture_id, unnest(grades) AS g, unnest(range(0, len(grades))) AS pos FROM graded_entries) v
  LEFT JOIN scene_raters r ON r.capture_id = v.capture_id AND r.rater = v.g.rater"""
FORCE = f"""SELECT item_id, CAST(CASE WHEN human IS NOT NULL THEN human WHEN n >= 3 THEN med ELSE latest END AS INTEGER) AS grade,
  CASE WHEN human IS NOT NULL THEN 'human' WHEN n >= 3 THEN 'median' ELSE 'latest' END AS rule FROM (
  SELECT item_id, arg_max(grade, pos) FILTER (kind = 'human') AS human, count(*) FILTER (kind = 'llm') AS n,
    quantile_disc(grade, 0.5) FILTER (kind = 'llm') AS med, arg_max(grade, pos) FILTER (kind = 'llm') AS latest
  FROM ({VERDICTS}) WHERE valid AND kind IN ('human', 'llm') GROUP BY item_id)"""
SIGNALS = f"""SELECT i.item_id, i.scene_id, i.book, f.grade, coalesce(length(i.title), 0) AS text, CAST(((i.uid % 17) + 17) % 17 AS INTEGER) AS keys,
  coalesce(length(i.title), 0) * 1.0::DOUBLE + (((i.uid % 17) + 17) % 17) / 100.0::DOUBLE AS score, CAST(f.grade >= 3 AS INTEGER) AS label
  FROM graded_entries i JOIN ({FORCE}) f USING (item_id)"""
ECREDIT = f"""SELECT item_id, label, 0.5 * p2 + 0.5 * least(p3, p2) AS e FROM (
  SELECT *, 1 / (1 + exp(-(-0.4 + 0.8 * zt + 0.3 * zk))) AS p2, 1 / (1 + exp(-(-1.1 + 0.6 * zt + 0.5 * zk))) AS p3 FROM (
  SELECT s.*, (CASE WHEN swap THEN s.keys - mk ELSE s.text - mt END) / (CASE WHEN swap THEN sk WHEN st > 1e-12 THEN st ELSE 1 END) AS zt, (s.keys - mk) / (CASE WHEN sk > 1e-12 THEN sk ELSE 1 END) AS zk
  FROM ({SIGNALS}) s JOIN (SELECT *, st <= 1e-12 AND sk > 1e-12 AS swap FROM (
    SELECT scene_id, avg(text) AS mt, stddev_pop(text) AS st, avg(keys) AS mk, stddev_pop(keys) AS sk FROM ({SIGNALS}) GROUP BY scene_id)) g USING (scene_id)))"""
ITEMS = """SELECT e.world AS scene, e.entry_id, CASE WHEN coalesce(constant, false) THEN 'constant' WHEN coalesce(vectorized, false) THEN 'promoted' ELSE 'dynamic' END AS block,
  CASE WHEN e.entry_id % 5 <> 0 THEN (uid % 97) / 97.0::DOUBLE END AS e_credit, uid AS authored, CAST(b.tier = 'reference' AS INTEGER) AS tier,
  CASE WHEN b.tier = 'reference' THEN 0.8::DOUBLE ELSE 1.0::DOUBLE END AS weight, CAST(round(length(coalesce(content, '')) / 4.91) AS INTEGER) AS tokens, coalesce(disable, false) AS exempt
  FROM book_entries e JOIN books b USING (world)"""
BLOCK = "CASE block WHEN 'constant' THEN 1 WHEN 'sticky' THEN 2 WHEN 'promoted' THEN 3 ELSE 4 END"
RANKED = "block IN ('promoted', 'dynamic')"
WALK = f"""SELECT *, CAST(row_number() OVER (PARTITION BY scene ORDER BY {BLOCK}, CASE WHEN {RANKED} THEN coalesce(e_credit, -1.0) * weight END DESC NULLS LAST, authored, entry_id) - 1 AS INTEGER) AS walk FROM ({ITEMS})"""
FLAG = lambda c: f"coalesce({c}, false)"
EARGS = "PARTITION BY world ORDER BY"
LITERALS = """SELECT DISTINCT world, entry_id, key FROM (SELECT world, entry_id, trim(unnest(key)) AS key FROM book_entries)
  WHERE key <> '' AND NOT starts_with(key, '?') AND NOT regexp_full_match(key, '/[\\s\\S]+/[dgimsuvy]*')"""
KFOLD = fold("nfc_normalize(key)")
FORMS = f"SELECT DISTINCT world, key, {KFOLD} AS typed, unnest(CASE WHEN contains({KFOLD}, '-') AND trim(replace({KFOLD}, '-', ' ')) = replace({KFOLD}, '-', ' ') THEN [{KFOLD}, replace({KFOLD}, '-', ' ')] ELSE [{KFOLD}] END) AS form FROM ({LITERALS})"


def _match(where: str) -> str:
    return f"SELECT msg_id FROM (SELECT msg_id, mes, {FHAY} AS h FROM chat_messages WHERE mes IS NOT NULL) WHERE {where}"


def _word(w: str) -> str:
    return f"regexp_matches(h, '(?:^|[^{CLASS}]|--){w}(?:$|[^{CLASS}]|--)')"


def _count(w: str) -> str:
    return f"((length(h) - length(replace(h, '{w}', ''))) / {len(w)})"


def _topk(centre: bool) -> str:
    mean = "SELECT list(x ORDER BY i) AS mean FROM (SELECT i, avg(x) AS x FROM (SELECT unnest(embedding)::DOUBLE AS x, unnest(range(len(embedding))) AS i FROM embeddings) GROUP BY i)"
    v = "list_transform(list_zip(embedding, mean), lambda z: z[1]::DOUBLE - z[2])" if centre else "list_transform(embedding, lambda x: x::DOUBLE)"
    return f"""WITH base AS (SELECT vec_id, {v} AS v FROM embeddings{f', ({mean})' if centre else ''}),
  s AS (SELECT q.vec_id AS query_id, b.vec_id, list_cosine_similarity(q.v, b.v) AS score FROM base q, base b WHERE q.vec_id % 100 = 0 AND q.vec_id <> b.vec_id),
  r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY round(score, 9) DESC, vec_id) AS rank FROM s)
  SELECT query_id, vec_id, round(score, 6) AS score, CAST(rank AS INTEGER) AS rank FROM r WHERE rank <= 10"""


def _keys(expr: str) -> str:
    return f"SELECT entry_id, array_to_string(k, '|') AS keys, k IS DISTINCT FROM key AS edited FROM (SELECT entry_id, key, {expr} AS k FROM book_entries)"


_NORM = lambda k: f"trim(lower({k}))"
_AT = f"list_position(list_transform(key, lambda k: coalesce({_NORM('k')}, '')), 'night')"

LAST = f"SELECT item_id, rater_id, arg_max(grade, (coalesce(graded_at, ''), pos)) AS grade FROM ({VERDICTS}) WHERE valid AND rater_id IS NOT NULL GROUP BY item_id, rater_id"
PAIRS = f"SELECT x.item_id, x.rater_id AS rater_a, y.rater_id AS rater_b, x.grade AS a, y.grade AS b FROM ({LAST}) x JOIN ({LAST}) y ON x.item_id = y.item_id AND x.rater_id < y.rater_id"

ORACLE: dict[str, str] = {
    "judge_agreement": f"""SELECT rater_a, rater_b, count(*) AS n, round(avg(CAST(a = b AS INTEGER)), 6) AS exact, round(avg(CAST(abs(a - b) <= 1 AS INTEGER)), 6) AS within_one,
      round(count(*) FILTER (a >= 3 AND b >= 3) / nullif(count(*) FILTER (b >= 3), 0), 6) AS precision, round(count(*) FILTER (a >= 3 AND b >= 3) / nullif(count(*) FILTER (a >= 3), 0), 6) AS recall FROM ({PAIRS}) GROUP BY ALL""",
    "tier_recall": f"""WITH s AS (SELECT b.tier, s.book, CAST(grade >= 3 AS INTEGER) AS rel, CAST(score >= 15 AS INTEGER) AS dl FROM ({SIGNALS}) s JOIN books b ON b.world = s.book)
      SELECT tier, book, CAST(sum(rel) AS BIGINT) AS relevant, CAST(sum(rel * dl) AS BIGINT) AS found, round(sum(rel * dl) / nullif(sum(rel), 0), 6) AS recall FROM s GROUP BY ROLLUP (tier, book)""",
    "delivered_f2": f"""WITH s AS (SELECT scene_id, count(*) FILTER (score >= 15) AS n, sum(CASE WHEN score >= 15 THEN CASE WHEN grade >= 3 THEN 1.0 WHEN grade >= 2 THEN 0.5 ELSE 0 END ELSE 0 END) AS c,
        count(*) FILTER (score >= 15 AND grade >= 3) AS hit, count(*) FILTER (grade >= 3) AS rel FROM ({SIGNALS}) GROUP BY scene_id),
      p AS (SELECT scene_id, CASE WHEN n > 0 THEN c / n ELSE 0 END AS p, CASE WHEN rel > 0 THEN hit / rel ELSE 0 END AS r FROM s)
      SELECT scene_id, round(CASE WHEN p > 0 OR r > 0 THEN 5 * p * r / (4 * p + r) ELSE 0 END, 6) AS f2 FROM p""",
    "scan_scenes": f"""WITH m AS (SELECT *, CASE WHEN coalesce(name, '') <> '' THEN name || ': ' || mes ELSE mes END AS s FROM ({USABLE}))
      SELECT chat_id, msg_id, CAST(sum(length(s) + 1) OVER (PARTITION BY chat_id ORDER BY t, msg_id ROWS 9 PRECEDING) - 1 AS INTEGER) AS chars FROM m""",
    "qwk": f"""WITH p AS ({PAIRS}), c AS (SELECT rater_a, rater_b, a, b, count(*) AS o FROM p GROUP BY ALL),
      s AS (SELECT rater_a, rater_b, sum(power(a - b, 2) / 16 * o) AS num, sum(o) AS n FROM c GROUP BY ALL),
      i AS (SELECT rater_a, rater_b, a, sum(o) AS ra FROM c GROUP BY ALL), j AS (SELECT rater_a, rater_b, b, sum(o) AS rb FROM c GROUP BY ALL),
      e AS (SELECT rater_a, rater_b, sum(power(a - b, 2) / 16 * ra * rb) AS den FROM i JOIN j USING (rater_a, rater_b) GROUP BY ALL)
      SELECT rater_a, rater_b, CASE WHEN den > 0 THEN round(1 - num / (den / n), 6) END AS qwk, CAST(n AS BIGINT) AS n FROM s JOIN e USING (rater_a, rater_b)""",
    "sign_test": f"SELECT rater_a, rater_b, CAST(sum(CAST(b > a AS INTEGER)) AS BIGINT) AS plus, CAST(sum(CAST(b < a AS INTEGER)) AS BIGINT) AS minus, CAST(sum(CAST(a = b AS INTEGER)) AS BIGINT) AS ties, round(avg(b - a), 6) AS mean FROM ({PAIRS}) GROUP BY ALL",
    "calibration_bins": f"""WITH s AS (SELECT round(e, 6) AS p, label FROM ({ECREDIT})), g AS (SELECT p, count(*) AS n, sum(label) AS y FROM s GROUP BY p),
      b AS (SELECT *, least((sum(n) OVER (ORDER BY p ROWS UNBOUNDED PRECEDING) - n) * 10 // sum(n) OVER (), 9) AS bin FROM g)
      SELECT CAST(bin AS INTEGER) AS bin, CAST(sum(n) AS BIGINT) AS n, min(p) AS lo, max(p) AS hi, round(sum(p * n) / sum(n), 6) AS mean_p, round(sum(y) / sum(n), 6) AS observed FROM b GROUP BY 1""",
    "key_book_counts": f"""WITH f AS ({FORMS}), c AS (SELECT entry_id, world, {fold(masked('nfc_normalize(content)'))} AS h FROM book_entries WHERE coalesce(content, '') <> ''),
      x AS (SELECT f.world, f.key, c.entry_id, (length(h) - length(replace(h, form, ''))) // length(form) AS n, form = typed AS own FROM f JOIN c ON c.world = f.world AND contains(h, form)),
      e AS (SELECT world, key, entry_id, sum(n) AS n, sum(CASE WHEN own THEN n ELSE 0 END) AS t FROM x GROUP BY ALL)
      SELECT k.world, k.key, count(entry_id) AS df, CAST(coalesce(sum(n), 0) AS BIGINT) AS total, CAST(coalesce(sum(t), 0) AS BIGINT) AS typed FROM (SELECT DISTINCT world, key FROM f) k LEFT JOIN e USING (world, key) GROUP BY k.world, k.key""",
    "key_rename": f"""SELECT entry_id, array_to_string(k, '|') AS keys, k IS DISTINCT FROM key AS edited FROM (SELECT entry_id, key, CASE WHEN coalesce(p, 0) = 0 THEN key
      WHEN len(list_filter(list_zip(key, range(1, len(key) + 1)), lambda z: z[2] <> p AND coalesce({_NORM('z[1]')}, '') = 'midnight')) > 0 THEN list_concat(key[1:p - 1], key[p + 1:])
      ELSE list_concat(list_concat(key[1:p - 1], ['midnight']), key[p + 1:]) END AS k FROM (SELECT entry_id, key, {_AT} AS p FROM book_entries))""",
    "fold_text": f"SELECT entry_id, {fold('content')} AS folded FROM book_entries",
    "doc_len_stats": f"SELECT count(*) AS n_docs, CAST(sum(len({tokens('text')})) AS BIGINT) AS n_tokens, round(avg(len({tokens('text')})), 6) AS avg_len FROM documents",
    "token_df": f"SELECT term, count(DISTINCT doc_id) AS df, count(*) AS tf FROM (SELECT doc_id, unnest({tokens('text')}) AS term FROM documents) GROUP BY term",
    "paragraph_count": f"SELECT msg_id, CAST(len(list_filter(regexp_split_to_array({_MARKED}, '\\n[ \\t]*\\n|\\x01'), lambda p: trim(p) <> '')) AS INTEGER) AS n FROM chat_messages",
    "masked_length": f"SELECT msg_id, CAST(length({masked('mes')}) AS INTEGER) AS n FROM chat_messages",
    "date_like": """SELECT regexp_matches(lower(send_date), '\\b(?:19|20)\\d{2}\\b') OR regexp_matches(lower(send_date), '\\b\\d{1,2}[/.-]\\d{1,2}[/.-]\\d{2,4}\\b')
      OR (regexp_matches(lower(send_date), '\\b(?:jan(?:uary)?|feb(?:ruary)?|mar(?:ch)?|apr(?:il)?|may|june?|july?|aug(?:ust)?|sep(?:t(?:ember)?)?|oct(?:ober)?|nov(?:ember)?|dec(?:ember)?)\\b') AND regexp_matches(send_date, '\\d')) AS dated, count(*) AS n
      FROM chat_messages WHERE send_date IS NOT NULL GROUP BY 1""",
    "normal_names": "SELECT world, trim(regexp_replace(lower(world), '[_\\-\\s]+', ' ', 'g')) AS name FROM books",
    "token_estimates": "SELECT doc_id, CAST(round(length(coalesce(text, '')) / 4.91) AS INTEGER) AS tokens FROM documents",
    "key_kinds": """SELECT CASE WHEN starts_with(k, '?') THEN 'smart' WHEN regexp_full_match(k, '/[\\s\\S]+/[dgimsuvy]*') THEN 'regex' ELSE 'literal' END AS kind, count(*) AS n
      FROM (SELECT trim(unnest(key), E' \\t\\n\\r') AS k FROM book_entries) WHERE k <> '' GROUP BY 1""",
    "bool_and_or_not": _match("contains(h, 'the') AND (contains(h, 'lantern') OR contains(h, 'bridge')) AND NOT contains(h, 'harbor')"),
    "xor_terms": _match("contains(h, 'lantern') <> contains(h, 'bridge')"),
    "whole_word_case": _match(f"{_word('gate')} OR {_word('anvil')}"),
    "regex_term": _match("regexp_matches(mes, '(?i)l[ao]ntern[s]?') AND contains(h, 'the')"),
    "weighted_or_score": f"SELECT msg_id, CAST(s AS DOUBLE) AS score FROM (SELECT msg_id, 2 * {_count('lantern')} + 0.5 * {_count('bridge')} AS s FROM (SELECT msg_id, {fold(masked('nfc_normalize(mes)'))} AS h FROM chat_messages WHERE mes IS NOT NULL)) WHERE s > 0",
    "entry_search": f"""SELECT entry_id, CAST(CASE WHEN contains(a, 'lantern') AND NOT contains(a, 'harbor') THEN 0 WHEN contains(b, 'lantern') AND NOT contains(b, 'harbor') THEN 1 ELSE 2 END AS INTEGER) AS found_in
      FROM (SELECT entry_id, {fold('comment')} AS a, {fold("array_to_string(coalesce(key, []), chr(10))")} AS b, {fold(masked("coalesce(content, '')"))} AS c FROM book_entries)
      WHERE (contains(a, 'lantern') AND NOT contains(a, 'harbor')) OR (contains(b, 'lantern') AND NOT contains(b, 'harbor')) OR (contains(c, 'lantern') AND NOT contains(c, 'harbor'))""",
    "facet_filter": f"SELECT entry_id FROM book_entries WHERE ({FLAG('constant')} OR {FLAG('vectorized')}) AND NOT {FLAG('disable')}",
    "count_window": f"""SELECT chat_id, count(*) AS n, min(msg_id) AS first_msg, CAST(sum(msg_id) AS BIGINT) AS sum_msg FROM (
      SELECT *, row_number() OVER (PARTITION BY chat_id ORDER BY t DESC, msg_id DESC) AS back FROM ({USABLE})) WHERE back <= 10 GROUP BY chat_id""",
    "block_windows": f"""SELECT chat_id, CAST((back - 1) // 10 AS BIGINT) AS block, count(*) AS n FROM (
      SELECT *, row_number() OVER (PARTITION BY chat_id ORDER BY t DESC, msg_id DESC) AS back FROM ({USABLE})) GROUP BY 1, 2""",
    "term_idf": f"""WITH docs AS (SELECT entry_id, {tokens('content')} AS ts FROM book_entries WHERE NOT {FLAG('disable')} AND trim(coalesce(content, '')) <> ''),
      df AS (SELECT term, count(DISTINCT entry_id) AS df FROM (SELECT entry_id, unnest(ts) AS term FROM docs) GROUP BY term)
      SELECT term, df, round(ln(1 + ((SELECT count(*) FROM docs) - df + 0.5) / (df + 0.5)), 6) AS idf FROM df""",
    "bm25_topk": f"""WITH q AS (SELECT DISTINCT item_id, unnest({tokens('text')}) AS term FROM eval_items),
      docs AS (SELECT doc_id, {tokens('text')} AS ts FROM documents),
      st AS (SELECT count(*) AS ndoc, avg(len(ts)) AS avgdl FROM docs),
      tf AS (SELECT doc_id, term, count(*) AS tf, any_value(dl) AS dl FROM (SELECT doc_id, len(ts) AS dl, unnest(ts) AS term FROM docs) GROUP BY doc_id, term),
      df AS (SELECT term, count(*) AS df FROM tf GROUP BY term),
      s AS (SELECT item_id, doc_id, round(sum(ln(1 + (ndoc - df + 0.5) / (df + 0.5)) * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * dl / avgdl))), 5) AS score
        FROM q JOIN tf USING (term) JOIN df USING (term), st WHERE df <= 0.25 * ndoc GROUP BY item_id, doc_id),
      r AS (SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id) AS rank FROM s)
      SELECT item_id, doc_id, score, CAST(rank AS INTEGER) AS rank FROM r WHERE rank <= 10""",
    "corpus_mean": "SELECT CAST(i AS INTEGER) AS i, round(avg(x), 6) AS x FROM (SELECT unnest(embedding)::DOUBLE AS x, unnest(range(len(embedding))) AS i FROM embeddings) GROUP BY i",
    "cosine_topk": _topk(False),
    "centered_cosine_topk": _topk(True),
    "label_centroids": "SELECT label, CAST(i AS INTEGER) AS i, round(avg(x), 6) AS x FROM (SELECT label, unnest(embedding)::DOUBLE AS x, unnest(range(len(embedding))) AS i FROM embeddings) GROUP BY label, i",
    "pooled_cosine": """WITH m AS (SELECT list(x ORDER BY i) AS mean FROM (SELECT i, avg(x) AS x FROM (SELECT unnest(embedding)::DOUBLE AS x, unnest(range(len(embedding))) AS i FROM embeddings) GROUP BY i)),
      c AS (SELECT label, vec_id, list_transform(list_zip(embedding, mean), lambda z: z[1]::DOUBLE - z[2]) AS v FROM embeddings, m),
      s AS (SELECT c.label, c.vec_id, list_cosine_similarity(c.v, q.v) AS score FROM c, (SELECT v FROM c WHERE vec_id = 0) q)
      SELECT label, round(max(score), 6) AS score, arg_max(vec_id, score) AS vec_id FROM s GROUP BY label""",
    "zscore_by_group": """SELECT entry_id, round((coalesce(chars, 0) - mc) / CASE WHEN sc > 1e-12 THEN sc ELSE 1 END, 6) AS z_chars, round((coalesce(nk, 0) - mk) / CASE WHEN sk > 1e-12 THEN sk ELSE 1 END, 6) AS z_n_keys
      FROM (SELECT entry_id, world, length(content) AS chars, len(key) AS nk FROM book_entries) JOIN (
        SELECT world, avg(coalesce(length(content), 0)) AS mc, stddev_pop(coalesce(length(content), 0)) AS sc, avg(coalesce(len(key), 0)) AS mk, stddev_pop(coalesce(len(key), 0)) AS sk FROM book_entries GROUP BY world) USING (world)""",
    "ecredit": f"SELECT item_id, round(e, 6) AS e_credit FROM ({ECREDIT})",
    "grade_in_force": FORCE,
    "auc_midrank": f"""WITH r AS (SELECT book, label, rank() OVER (PARTITION BY book ORDER BY score) + (count(*) OVER (PARTITION BY book, score) - 1) / 2.0 AS rk FROM ({SIGNALS})),
      s AS (SELECT book, CAST(sum(label) AS BIGINT) AS pos, CAST(count(*) - sum(label) AS BIGINT) AS neg, sum(CASE WHEN label = 1 THEN rk END) AS rs FROM r GROUP BY book)
      SELECT book, CASE WHEN pos > 0 AND neg > 0 THEN round((rs - pos * (pos + 1) / 2) / (pos * neg), 6) END AS auc, pos, neg FROM s""",
    "average_precision": f"""WITH r AS (SELECT book, label, row_number() OVER w AS i, sum(label) OVER (w ROWS UNBOUNDED PRECEDING) AS tp FROM ({SIGNALS}) WINDOW w AS (PARTITION BY book ORDER BY score DESC, item_id))
      SELECT book, round(sum(CASE WHEN label = 1 THEN tp / i END) / nullif(sum(label), 0), 6) AS ap, CAST(sum(label) AS BIGINT) AS pos FROM r GROUP BY book""",
    "ndcg_at_k": f"""WITH r AS (SELECT scene_id, grade, row_number() OVER (PARTITION BY scene_id ORDER BY score DESC, item_id) AS a, row_number() OVER (PARTITION BY scene_id ORDER BY grade DESC) AS b FROM ({SIGNALS})),
      s AS (SELECT scene_id, sum(CASE WHEN a <= 10 THEN grade / log2(a + 1) ELSE 0 END) AS dcg, sum(CASE WHEN b <= 10 THEN grade / log2(b + 1) ELSE 0 END) AS ideal FROM r GROUP BY scene_id)
      SELECT scene_id, round(CASE WHEN ideal > 0 THEN dcg / ideal ELSE 0 END, 6) AS ndcg FROM s""",
    "f2_cutoff_sweep": f"""WITH c AS (SELECT unnest([5.0::DOUBLE, 10.0, 15.0, 20.0, 25.0]) AS cutoff),
      a AS (SELECT cutoff, scene_id, score >= cutoff AS kept, CASE WHEN grade >= 3 THEN 1.0 WHEN grade >= 2 THEN 0.5 ELSE 0.0 END AS cr, CAST(grade >= 3 AS INTEGER) AS rel FROM ({SIGNALS}), c),
      e AS (SELECT cutoff, scene_id, sum(CAST(kept AS INTEGER)) AS n, sum(CASE WHEN kept THEN cr END) AS cr, sum(CASE WHEN kept THEN rel ELSE 0 END) AS hit, sum(rel) AS rel FROM a GROUP BY ALL),
      f AS (SELECT cutoff, n, CASE WHEN n > 0 THEN cr / n ELSE 0 END AS p, hit / rel AS r FROM e WHERE rel > 0)
      SELECT cutoff, count(*) AS scenes, round(avg(n), 6) AS delivered, round(avg(p), 6) AS precision, round(avg(r), 6) AS recall, round(avg(CASE WHEN p > 0 OR r > 0 THEN 5 * p * r / (4 * p + r) ELSE 0 END), 6) AS f2 FROM f GROUP BY cutoff""",
    "spearman": f"""WITH r AS (SELECT book, rank() OVER (PARTITION BY book ORDER BY score) + (count(*) OVER (PARTITION BY book, score) - 1) / 2.0 AS x, rank() OVER (PARTITION BY book ORDER BY grade) + (count(*) OVER (PARTITION BY book, grade) - 1) / 2.0 AS y FROM ({SIGNALS}))
      SELECT book, round(CASE WHEN isnan(corr(x, y)) THEN NULL ELSE corr(x, y) END, 6) AS rho, count(*) AS n FROM r GROUP BY book""",
    "eta_squared": f"""WITH g AS (SELECT book, count(grade) AS n, avg(grade) AS m, var_pop(grade) AS v FROM ({SIGNALS}) GROUP BY book),
      s AS (SELECT sum(n * m * m) / sum(n) - power(sum(n * m) / sum(n), 2) AS b, sum(n * v) / sum(n) AS w FROM g) SELECT round(CASE WHEN b + w > 0 THEN b / (b + w) ELSE 0 END, 6) AS eta2 FROM s""",
    "leave_one_out": f"SELECT item_id, CASE WHEN n > 1 THEN round((s - grade) / (n - 1), 6) END AS rest FROM (SELECT item_id, grade, sum(grade) OVER (PARTITION BY scene_id) AS s, count(*) OVER (PARTITION BY scene_id) AS n FROM ({SIGNALS}))",
    "rank_gaps": f"""SELECT scene_id, item_id, CAST(rank AS INTEGER) AS rank, round(gap, 6) AS gap FROM (SELECT scene_id, item_id, row_number() OVER w AS rank, lag(score) OVER w - score AS gap FROM ({SIGNALS}) WINDOW w AS (PARTITION BY scene_id ORDER BY score DESC, item_id)) WHERE rank <= 5""",
    "layout_interleaved": f"SELECT entry_id, walk FROM ({WALK})",
    "layout_sequential": f"""SELECT entry_id, CAST(row_number() OVER (PARTITION BY scene ORDER BY {BLOCK}, CASE WHEN {RANKED} THEN tier END ASC NULLS LAST, CASE WHEN {RANKED} THEN coalesce(e_credit, -1.0) END DESC NULLS LAST, authored, entry_id) - 1 AS INTEGER) AS walk FROM ({ITEMS})""",
    "budget_walk": f"""WITH RECURSIVE w AS ({WALK}), s AS (
      SELECT scene, CAST(-1 AS INTEGER) AS walk, CAST(NULL AS BIGINT) AS entry_id, false AS admitted, CAST(0 AS BIGINT) AS spent, CAST(0 AS BIGINT) AS counted FROM (SELECT DISTINCT scene FROM w)
      UNION ALL SELECT w.scene, w.walk, w.entry_id, w.exempt OR (s.spent + w.tokens <= 1500 AND s.counted < 12),
        s.spent + CASE WHEN NOT w.exempt AND s.spent + w.tokens <= 1500 AND s.counted < 12 THEN w.tokens ELSE 0 END, s.counted + CASE WHEN NOT w.exempt AND s.spent + w.tokens <= 1500 AND s.counted < 12 THEN 1 ELSE 0 END
      FROM s JOIN w ON w.scene = s.scene AND w.walk = s.walk + 1)
      SELECT entry_id, admitted, spent, NOT admitted AND walk > max(CASE WHEN admitted THEN walk ELSE -1 END) OVER (PARTITION BY scene) AS tail FROM s WHERE walk >= 0""",
    "budget_prefix": f"""SELECT entry_id, CAST(upto AS BIGINT) AS upto FROM (SELECT entry_id, scene, walk, sum(tokens) OVER (PARTITION BY scene ORDER BY walk) AS upto FROM ({WALK})) WHERE upto <= 1500""",
    "order_priority": f"""SELECT entry_id, CAST(98999 + row_number() OVER ({EARGS} CASE WHEN {FLAG('disable')} THEN 2 WHEN {FLAG('constant')} THEN 0 ELSE 1 END, uid, entry_id) AS INTEGER) AS prompt_order FROM book_entries""",
    "order_tiered_tokens": f"""SELECT entry_id, CAST(98999 + row_number() OVER ({EARGS} CASE WHEN {FLAG('disable')} THEN 4 WHEN {FLAG('vectorized')} THEN 0 WHEN {FLAG('constant')} THEN 1 ELSE 3 END, length(coalesce(content, '')) DESC, uid, entry_id) AS INTEGER) AS prompt_order FROM book_entries""",
    "key_listed_by": "SELECT world, key, count(*) AS listed FROM (SELECT DISTINCT entry_id, world, trim(lower(k)) AS key FROM (SELECT entry_id, world, unnest(key) AS k FROM book_entries)) WHERE key <> '' GROUP BY world, key",
    "key_chat_counts": f"""WITH f AS (SELECT DISTINCT key, form FROM ({FORMS})), m AS (SELECT msg_id, {fold(masked('nfc_normalize(mes)'))} AS h FROM chat_messages WHERE NOT coalesce(is_system, false) AND coalesce(mes, '') <> ''),
      x AS (SELECT DISTINCT key, msg_id FROM f JOIN m ON contains(h, form)) SELECT f.key, count(DISTINCT x.msg_id) AS messages_with FROM (SELECT DISTINCT key FROM f) f LEFT JOIN x USING (key) GROUP BY f.key""",
    "orphan_grades": "SELECT book, count(*) AS n FROM graded_entries g WHERE NOT EXISTS (SELECT 1 FROM book_entries e WHERE e.world = g.book AND e.uid = g.uid) GROUP BY book",
    "orphan_bindings": "SELECT character_name AS name, count(*) AS chats FROM chats WHERE coalesce(character_name, '') <> '' AND character_name NOT IN (SELECT world FROM books) GROUP BY 1",
    "nearest_name": """WITH m AS (SELECT world AS name, trim(regexp_replace(lower(world), '[_\\-\\s]+', ' ', 'g')) AS m FROM books),
      p AS (SELECT a.name, b.name AS w, starts_with(a.m, b.m) OR starts_with(b.m, a.m) AS pre, least(length(a.m), length(b.m)) AS shared, levenshtein(a.m, b.m) AS d, greatest(2, floor(length(a.m) * 0.2)) AS reach FROM m a JOIN m b ON a.name <> b.name)
      SELECT m.name, coalesce((SELECT w FROM p WHERE p.name = m.name AND pre ORDER BY shared DESC, w LIMIT 1), (SELECT w FROM p WHERE p.name = m.name AND d <= reach ORDER BY d, w LIMIT 1)) AS nearest FROM m""",
    "attached_books": "SELECT DISTINCT chat_id, world_info AS world FROM chats WHERE world_info IN (SELECT world FROM books)",
    "book_chat_bindings": """WITH b AS (SELECT world FROM book_entries GROUP BY world ORDER BY count(*) DESC, world LIMIT 1)
      SELECT CASE WHEN world_info = (SELECT world FROM b) THEN 'chat-bound' END AS why, count(*) AS n FROM chats GROUP BY 1""",
    "book_fingerprints": f"SELECT world, count(*) AS entries, CAST(sum(length(content)) AS BIGINT) AS chars FROM book_entries WHERE NOT {FLAG('disable')} AND trim(coalesce(content, '')) <> '' GROUP BY world",
    "union_arms": f"""WITH v AS (SELECT item_id, kind AS arm, pos AS rank, CASE WHEN valid THEN grade END AS grade FROM ({VERDICTS}) WHERE kind IS NOT NULL)
      SELECT item_id, array_to_string(list_sort(list(DISTINCT arm)), ',') AS arms, CAST(min(rank) AS INTEGER) AS best_rank, first(grade ORDER BY arm, rank) FILTER (grade IS NOT NULL) AS grade FROM v GROUP BY item_id""",
    "delivered_difference": f"""WITH v AS ({VERDICTS}), a AS (SELECT DISTINCT item_id FROM v WHERE valid AND kind = 'human'), b AS (SELECT DISTINCT item_id FROM v WHERE valid AND kind = 'llm')
      SELECT coalesce(a.item_id, b.item_id) AS item_id, CASE WHEN b.item_id IS NULL THEN 'first' WHEN a.item_id IS NULL THEN 'second' ELSE 'both' END AS side FROM a FULL JOIN b ON a.item_id = b.item_id""",
    "verdict_rollup": f"SELECT tier, book, count(*) AS n, round(avg(grade), 6) AS mean_grade FROM ({VERDICTS}) v JOIN books b ON b.world = v.book WHERE valid GROUP BY ROLLUP (tier, book)",
    "job_batches": "SELECT CAST((row_number - 1) // 16 AS BIGINT) AS job, count(*) AS n, min(item_id) AS first_item FROM (SELECT item_id, row_number() OVER (ORDER BY item_id DESC) AS row_number FROM graded_entries) GROUP BY 1",
    "bundle_candidates": "SELECT capture_id, count(*) AS n, CAST(sum(uid) AS BIGINT) AS uids FROM graded_entries GROUP BY capture_id",
    "key_delete": _keys(f"list_filter(key, lambda k: coalesce({_NORM('k')} <> 'night', true))"),
    "key_add_variant": _keys(f"CASE WHEN list_contains(list_transform(key, lambda k: {_NORM('k')}), 'gate') AND NOT list_contains(list_transform(key, lambda k: {_NORM('k')}), 'the gate') THEN list_append(key, 'the gate') ELSE key END"),
    "latch_first_fire": "SELECT CAST(user_id AS VARCHAR) AS chat_id, event_type, CAST(min(floor(epoch(ts))) AS BIGINT) AS at FROM events GROUP BY 1, 2",
    "user_sessions": "SELECT user_id, CAST(sum(CAST(gap IS NULL OR gap >= INTERVAL 30 MINUTE AS INTEGER)) AS BIGINT) AS sessions, count(*) AS n FROM (SELECT user_id, ts - lag(ts) OVER (PARTITION BY user_id ORDER BY ts) AS gap FROM events) GROUP BY user_id",
    "merged_spans": """WITH e AS (SELECT user_id, CAST(floor(epoch(ts)) AS BIGINT) AS a FROM events),
      n AS (SELECT *, CASE WHEN a > max(a + 600) OVER (PARTITION BY user_id ORDER BY a ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) THEN 1 WHEN row_number() OVER (PARTITION BY user_id ORDER BY a) = 1 THEN 1 ELSE 0 END AS fresh FROM e),
      i AS (SELECT *, sum(fresh) OVER (PARTITION BY user_id ORDER BY a ROWS UNBOUNDED PRECEDING) AS island FROM n)
      SELECT user_id, min(a) AS at, max(a + 600) AS until, count(*) AS n FROM i GROUP BY user_id, island""",
}


from . import operator_oracle  # noqa: E402,F401  adds further SQL
