from __future__ import annotations

import random

from growthlab.llm import queries, quotes, store
from sqlcheck import compare_rows

ROWS = [
    (1, 0, "user", "Hello there.\nHow do I count words?"),
    (1, 1, "assistant", "> How do I count words?\nSplit the text first."),
    (1, 2, "user", "On Monday the assistant wrote:\n> > how  do I count WORDS?\n> Split the text first.\nAnd then?\n\n"),
    (1, 3, "assistant", "Count them."),
    (2, 0, "user", ">>> Count them.\nIs that so?"),
    (2, 1, "user", "> nothing like it\nNo."),
    (2, 5, "user", " > Is that so?\n>No.\nBoth"),
    (3, 0, None, None),
    (3, 1, "user", ""),
    (3, 1, "user", "> Hello there.\n> How do I count words?\nagain"),
    (4, 7, "user", "> > > "),
    (None, 1, "user", "> Count them.\nx"),
    (5, None, "user", "y"),
    (6, 0, "user", "wrote:"),
    (6, 1, "user", "He wrote:\nmore\n> wrote:"),
]
SCHEMA = "conv_id long, turn long, role string, text string, row string, level int, position string"


def table(spark, rows):
    return spark.createDataFrame([(*r, "x", 1, "y") for r in rows], SCHEMA)


def test_links(spark):
    got = {(r["conv_id"], r["turn"], r["own_text"]): r for r in quotes.link(table(spark, ROWS)).collect()}
    at = lambda c, t, own: tuple(got[c, t, own][x] for x in ("quoted_lines", "max_level", "linked", "reply_conv", "reply_turn", "thread_conv", "thread_turn", "position"))
    assert at(1, 1, "Split the text first.") == (1, 1, True, 1, 0, 1, 0, 1)
    assert at(1, 2, "And then?") == (2, 2, True, 1, 1, 1, 0, 2)
    assert at(1, 3, "Count them.") == (0, 0, False, 1, 0, 1, 0, 3)
    assert at(2, 0, "Is that so?") == (1, 3, True, 1, 3, 1, 0, 4)
    assert at(2, 1, "No.") == (1, 1, False, 2, 0, 1, 0, 5)
    assert at(2, 5, "Both") == (2, 1, True, 2, 0, 1, 0, 6)
    assert at(3, 1, "again")[:7] == (2, 1, True, 1, 0, 1, 0)
    assert at(3, 1, "")[:7] == (0, 0, True, 1, 0, 1, 0)
    assert {at(3, 1, "again")[7], at(3, 1, "")[7]} == {7, 8}
    assert at(3, 0, "") == (0, 0, False, None, None, 3, 0, 0)
    assert at(4, 7, "") == (1, 3, False, None, None, 4, 7, 0)
    assert at(None, 1, "x") == (1, 1, None, None, None, None, None, None)
    assert at(6, 1, "He wrote:\nmore")[2:5] == (True, 6, 0)
    assert len(got) == len(ROWS)


def test_against_sql(spark):
    rows = [r for r in ROWS if r[:2] != (3, 1)]  # equal places have no order
    compare_rows(spark, quotes.link(table(spark, rows)), queries.ORACLE_SQL["op4_quotation_linking"], conversations=table(spark, rows))


def test_conversations(spark):
    threads = quotes.conversations(quotes.link(table(spark, ROWS)), 3).orderBy("thread_conv", "part").collect()
    assert [(r["thread_conv"], r["part"], len(r["messages"])) for r in threads] == [(1, 0, 3), (1, 1, 3), (1, 2, 3), (3, 0, 1), (4, 0, 1), (6, 0, 2)]
    assert [m["own_text"] for m in threads[0]["messages"]][1:] == ["Split the text first.", "And then?"]


def test_many_copies(spark):
    """One text in every conversation, quoted in each: rows stay as many."""
    rows = [(c, t, "user", "> ok\nok" if t else "ok") for c in range(40) for t in range(3)]
    got = quotes.link(table(spark, rows))
    assert got.count() == 120 and got.where("linked and reply_conv = conv_id and reply_turn = 0").count() == 80


def test_originals_in_later_conversations(spark):
    """Ids are not times: an original may have a larger conv_id; only real cycles of replies are broken."""
    rows = [
        (3, 0, "user", "opens three"), (3, 1, "user", "> first in seven\nanswer in three"), (7, 0, "user", "first in seven"), (7, 1, "user", "> answer in three\nback"),
        (8, 0, "user", "> end of nine\nstart of eight"), (9, 0, "user", "> start of eight\nend of nine"),
        (10, 0, "user", "> said later\nx"), (10, 1, "user", "said later"), (11, 0, "user", "said later"),
        (12, 0, "user", "open"), (12, 1, "user", "> of thirteen\nof twelve"), (13, 0, "user", "> open\nof thirteen"),
        (14, 0, "user", "> two of fifteen\nzero of fourteen"), (14, 1, "user", "> two of fifteen\none of fourteen"), (15, 2, "user", "> one of fourteen\ntwo of fifteen"),
    ]
    got = {(r["conv_id"], r["turn"]): r for r in quotes.link(table(spark, rows)).collect()}
    at = lambda c, t: tuple(got[c, t][x] for x in ("linked", "reply_conv", "reply_turn", "thread_conv", "thread_turn"))
    assert at(3, 1) == (True, 7, 0, 7, 0) and at(7, 1) == (True, 3, 1, 7, 0)
    assert at(8, 0) == (False, None, None, 8, 0) and at(9, 0) == (True, 8, 0, 8, 0)
    assert at(10, 0) == (True, 11, 0, 11, 0)
    assert at(12, 1) == (True, 13, 0, 12, 0) and at(13, 0) == (True, 12, 0, 12, 0)
    assert at(14, 1) == (False, 14, 0, 14, 0) and at(15, 2) == (True, 14, 1, 14, 0) and at(14, 0) == (False, None, None, 14, 0)
    for r in got.values():
        if r["reply_conv"] is not None:
            assert got[r["reply_conv"], r["reply_turn"]]["position"] < r["position"]


def test_nothing(spark):
    assert quotes.link(table(spark, [])).collect() == []


def test_native(spark):
    plan = quotes.link(table(spark, ROWS))._jdf.queryExecution().toString()
    assert "Python" not in plan and "Arrow" not in plan and "Cartesian" not in plan


def test_ids_of_other_types(spark):
    rows = [("thread-a", 0, "user", "Hello there.", 1), ("thread-a", 1, "user", "> Hello there.\nHi", 1), ("b", 0, "user", "> Hello there.\nlater", 1), (None, 0, "user", "x", 1)]
    got = {(r["conv_id"], r["turn"]): r for r in quotes.link(spark.createDataFrame(rows, "conv_id string, turn int, role string, text string, greatest int")).collect()}
    assert [got["b", 0][c] for c in ("linked", "reply_conv", "thread_conv", "position")] == [True, "thread-a", "thread-a", 1]
    assert [got["thread-a", 1][c] for c in ("reply_conv", "position")] == ["thread-a", 2] and got[None, 0]["thread_conv"] is None


def test_very_long_and_many(spark, monkeypatch):
    """A message of many lines, a line that everybody quotes, and one thread that holds nearly all messages."""
    monkeypatch.setattr(store, "HOT_ROWS", 20)
    long_ = "\n".join(f"line {n} of the long message" for n in range(20_000))
    rows = [(0, 0, "user", long_ + "\nthe common line"), (0, 1, "user", "\n".join(f"> {line}" for line in long_.split("\n")) + "\nall quoted")]
    rows += [(1 + n, t, "user", "> the common line\nok" if t else f"opening {n}") for n in range(60) for t in range(3)]
    got = quotes.link(table(spark, rows)).collect()
    assert len(got) == len(rows) and sum(bool(r["linked"]) and r["reply_conv"] == 0 for r in got) == 121
    assert sorted(r["position"] for r in got if r["thread_conv"] == 0) == list(range(122))
    assert [r["quoted_lines"] for r in got if (r["conv_id"], r["turn"]) == (0, 1)] == [20_000]


def test_many_messages_against_sql(spark):
    """Ten thousand messages with nested quotes of earlier ones, against SQL."""
    rng, rows, texts = random.Random(6), [], []
    for c in range(1500):
        for t in range(rng.randrange(3, 11)):
            own = f"message {rng.randrange(4000)} says {rng.choice(['yes', 'no'])}\nand goes on {rng.randrange(3000)}"
            quoted = rng.choice(texts) if texts and rng.random() < 0.5 else ""
            rows.append((c, t, "user", "".join(f"> {line}\n" for line in quoted.split("\n") if line) + own))
            texts = [*texts[-300:], rows[-1][3]]
    got = quotes.link(table(spark, rows))
    assert got.where("linked").count() > 2000 and got.agg({"max_level": "max"}).first()[0] >= 3
    compare_rows(spark, got, queries.ORACLE_SQL["op4_quotation_linking"], conversations=table(spark, rows))


def test_depth_first(spark, monkeypatch):
    """A message, then each reply with its whole branch; in a deep chain, with one message that many answer, and repeated rows."""
    monkeypatch.setattr(store, "HOT_ROWS", 20)
    rows = [(0, 0, "user", "opening words"), *((1, t, "user", f"> {'opening words' if t == 0 else f'link {t - 1}'}\nlink {t}") for t in range(100)), *((2 + n, 0, "user", f"> opening words\nanswer {n}") for n in range(150)), *((200 + n, 0, "user", f"> answer {n}\nsecond {n}") for n in range(0, 150, 3)), (1, 50, "user", "again")]
    got = quotes.link(table(spark, rows)).collect()
    children = {}
    for r in got:
        if r["reply_conv"] is not None:
            children.setdefault((r["reply_conv"], r["reply_turn"]), set()).add((r["conv_id"], r["turn"]))
    order, stack = [], [(0, 0)]
    while stack:
        order.append(stack.pop())
        stack += sorted(children.get(order[-1], ()), reverse=True)
    placed = [p for p in order for _ in range(2 if p == (1, 50) else 1)]
    assert [(r["conv_id"], r["turn"]) for r in sorted(got, key=lambda r: r["position"])] == placed and len(placed) == len(rows)
    assert max(r["reply_level"] for r in got) == 100


def test_running(spark):
    rng = random.Random(3)
    rows = [(rng.randrange(4), n, rng.randrange(5)) for n in range(500)]
    got = store.running(spark.createDataFrame(rows, "k int, o int, v long").repartition(5), ["k"], ["o"], "v", "before").collect()
    assert {(r["k"], r["o"]): r["before"] for r in got} == {(k, o): sum(v for x, y, v in rows if x == k and y < o) for k, o, _ in rows}
