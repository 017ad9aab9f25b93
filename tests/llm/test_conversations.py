import random

from lorelake.llm import conversations as C

D = "2024-03-01@00h{:02d}m00s"


def _chats(spark, ids):
    return spark.createDataFrame([(i, "clash", 0) for i in ids], "chat_id string, fault string, n int")


ROWS = [
    (1, "ok", True, None, D.format(1), "hi"), (2, "ok", False, False, "March 1, 2024 12:02am", "ho"), (3, "ok", True, False, "1709251380000", "x"), (4, "ok", False, None, "2024-03-01T00:05:00.000Z", "y"),
    (5, "hidden", True, True, D.format(1), "x"), (6, "hidden", True, None, D.format(1), " \n"), (7, "hidden", True, None, D.format(1), None),
    (8, "nouser", None, None, D.format(1), "x"), (9, "nodate", True, None, "Invalid Date", "x"), (10, "nodate2", True, None, "0000-00-00", "x"),
    (11, "one", False, None, D.format(1), "x"), (12, "open", False, None, D.format(1), "x"), (13, "open", True, None, D.format(2), "x"),
    (14, "two", True, None, D.format(1), "x"), (15, "two", True, None, D.format(2), "z"), (16, "two", False, None, D.format(3), "x"),
    (17, "copy", True, None, D.format(1), "x"), (18, "copy", True, None, D.format(1), "x"), (19, "copy", False, None, D.format(2), "y"),
    (20, "tie", False, None, D.format(1), "x"), (21, "tie", True, None, D.format(1), "y"), (22, "long", True, None, D.format(1), "w " * 50_000), (23, "long", False, None, D.format(2), "y"),
]
WANT = {"hidden": "empty", "none": "empty", "nouser": "broken", "nodate": "broken", "nodate2": "broken", "one": "one_sided", "open": "unanswered", "two": "unanswered"}


def test_faults_and_rows(spark, make_messages):
    chats = _chats(spark, [*{r[1] for r in ROWS}, "none"])
    messages = make_messages(ROWS)
    assert {r.chat_id: r.fault for r in C.conversation_faults(chats, messages).collect()} == WANT
    rows = [(r.chat_id, r.msg_id, r.role) for r in C.conversation_rows(chats, messages).collect()]
    assert [r[1] for r in rows if r[0] == "ok"] == [1, 2, 3, 4]
    assert [r[1:] for r in rows if r[0] == "copy"] == [(17, "user"), (19, "assistant")]
    assert not {r[0] for r in rows} & set(WANT)


def test_hot_chat_is_spread(spark, make_messages):
    """One chat over all range partitions: the stretches join up, whatever way it is cut."""
    rows = [(i, "hot", i % 2 == 0, None, str(1709251200000 + i * 1000), f"m{i}") for i in range(400)]
    random.Random(1).shuffle(rows)
    assert C.conversation_faults(_chats(spark, ["hot"]), make_messages(rows)).count() == 0
    broken = [r for r in rows if r[0] != 201]
    assert [r.fault for r in C.conversation_faults(_chats(spark, ["hot"]), make_messages(broken)).collect()] == ["unanswered"]


def test_empty(spark, make_messages):
    assert {r.fault for r in C.conversation_faults(_chats(spark, ["a"]), make_messages([])).collect()} == {"empty"}
    assert C.conversation_rows(_chats(spark, ["a"]), make_messages([])).count() == 0
    assert C.conversation_faults(_chats(spark, []), make_messages(ROWS)).count() == 0


def test_components_against_union_find(spark):
    rng = random.Random(2)
    edges = [(rng.randrange(300), rng.randrange(300)) for _ in range(220)] + [(1000 + i, 1001 + i) for i in range(60)] + [(5, 2000 + i) for i in range(100)] + [(7, 7)]
    parent = {}

    def find(x):
        while parent.setdefault(x, x) != x:
            x = parent[x]
        return x

    for u, v in edges:
        if u != v:
            parent[max(find(u), find(v))] = min(find(u), find(v))
    found = {r.node: r.component for r in C.components(spark.createDataFrame(edges, "u long, v long")).collect()}
    assert found == {x: find(x) for x in {y for e in edges if e[0] != e[1] for y in e}}


def test_lacking_identifiers(spark, make_messages):
    long = "a longer line that others quote in full"
    rows = [
        (1, "c1", True, None, D.format(1), long), (2, None, False, None, D.format(2), f"> {long}\n\nyes"), (3, None, True, None, D.format(3), "alone"),
        (4, None, True, None, D.format(4), "reply to two"), (5, None, True, None, D.format(5), "x"), (6, None, False, None, D.format(6), "y"),
    ]
    replies = spark.createDataFrame([(4, 2), (6, 5), (5, None)], "msg_id long, reply_to long")
    got = {r.msg_id: r.chat_id for r in C.assign_conversations(make_messages(rows), replies).collect()}
    assert got == {1: "c1", 2: "c1", 3: "component-3", 4: "c1", 5: "component-5", 6: "component-5"}


def test_rebuilt_conversations_are_judged_and_returned(spark, make_messages):
    rows = [
        (1, None, True, None, D.format(1), "hi"), (2, None, False, None, D.format(2), "> hi\nho"), (3, None, True, None, D.format(3), "left alone"),
        (4, None, True, None, D.format(4), "same"), (5, None, True, None, D.format(5), "same"), (6, None, False, None, D.format(6), "> same\nx"),
        (7, None, True, None, D.format(7), "asks"), (8, None, False, None, D.format(8), "answers"), (9, "c", True, None, D.format(9), "y"), (10, "c", False, None, D.format(10), "z"),
    ]
    replies = spark.createDataFrame([(8, 7)], "msg_id long, reply_to long")
    got = {(r.chat_id, r.msg_id) for r in C.conversation_rows(_chats(spark, ["c"]), make_messages(rows), replies).collect()}
    assert got == {("component-1", 1), ("component-1", 2), ("component-7", 7), ("component-7", 8), ("c", 9), ("c", 10)}
    faults = {r.chat_id: r.fault for r in C.conversation_faults(_chats(spark, ["c"]), make_messages(rows), replies).collect()}
    assert faults == {f"component-{i}": "one_sided" for i in (3, 4, 5, 6)}
