"""Fixed schemas of the documents that the sources read."""

from __future__ import annotations

ENTRY = (
    "world string, uid long, key array<string>, keysecondary array<string>, selective boolean, selectiveLogic int, comment string, content string, constant boolean, "
    "vectorized boolean, disable boolean, `order` int, displayIndex int, position int, depth int, role int, outletName string, scanDepth int, caseSensitive boolean, "
    "matchWholeWords boolean, sticky int, cooldown int, delay int, probability int, useProbability boolean, ignoreBudget boolean, preventRecursion boolean, "
    "excludeRecursion boolean, delayUntilRecursion string, `group` string, groupOverride boolean, groupWeight int, STMB_start int, STMB_end int, stmemorybooks boolean"
)
BOOK = f"name string, entries map<string, struct<{', '.join(f'{n}: {t}' for n, t in (c.rsplit(' ', 1) for c in ENTRY.split(', ')))}>>"
MESSAGE = "name string, is_user boolean, is_system boolean, send_date string, mes string, swipe_id int, extra struct<fileLength: int>"
CHAT_HEAD = "user_name string, character_name string, create_date string, chat_metadata struct<world_info: string>"
VERDICT = "struct<rater: int, grade: int, graded_at: string, why: string>"
CANDIDATE = f"struct<book: string, uid: long, title: string, cosine: double, text: double, keys: double, rank: int, grades: array<{VERDICT}>>"
RATER = "struct<kind: string, rater_id: string, model_name: string, family: string, quant: string>"
BUNDLE = f"version string, capture_id string, scene_id string, query string, depth int, raters array<{RATER}>, arms array<struct<arm: string, rows: array<{CANDIDATE}>>>"
