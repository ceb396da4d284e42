import hashlib
import random
from collections import defaultdict

from tickloom.llm import chat as c


def expected(rows):
    groups = defaultdict(list)
    for conv, turn, role, text in rows:
        groups[conv].append((turn, role or "", text or ""))
    groups[-7] += [(0, "user", c.CONTROL_TEXT), (1, "assistant", c.CONTROL_TEXT)]
    out = {}
    for conv, turns in groups.items():
        turns.sort()
        said = "".join(t for _, r, t in turns if r == "assistant")
        out[conv] = (len(turns), hashlib.sha256("".join(f"{r}\n{t}\n" for _, r, t in turns).encode()).hexdigest(), len(said), hashlib.sha256(said.encode()).hexdigest())
    return out


PARTS = ["\\", "<turn", "</turn>\n", '"', '">', "<", "\n", "é日", "### Assistant:", "a", '<turn role="assistant">', ""]


def test_escaping_is_reversible():
    rng = random.Random(0)
    for _ in range(3000):
        turns = [tuple("".join(rng.choice(PARTS) for _ in range(rng.randint(0, 8))) for _ in range(2)) for _ in range(3)]
        text = "".join(c.render(*t)[0] for t in turns)
        assert [(r, t) for r, t, _, _ in c.parse(text)] == turns
        for r, t in turns:
            formatted, a, b = c.render(r, t)
            assert c.unescape(formatted[a:b]) == t


def test_digests_match(spark):
    rng = random.Random(8)
    rows = [(k % 37, k // 37, rng.choice(["user", "assistant", "system", None]), rng.choice([None, "", *("".join(rng.choice(PARTS) for _ in range(9)) for _ in range(4))])) for k in range(900)]
    rows += [(99, 0, "assistant", "twice")] * 2 + [(5, k + 1000, "assistant", "x" * 50) for k in range(400)]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").selectExpr("*", "1 as seq", "2 as message")
    got = {r.conv_id: tuple(r)[1:5] for r in c.digest(df).collect()}
    assert got == expected(rows)
    small = c.read_back(c.join_turns(c.format_turns(c.log_of(df)), part_chars=300))
    assert {r.conv_id: tuple(r)[1:5] for r in small.collect()} == {k: v for k, v in got.items() if k != -7}
    assert [r.conv_id for r in c.digest(df.limit(0)).collect()] == [-7]


def test_events_fold_into_final_messages(spark):
    log = [
        (1, 10, 0, "message", "user", "hi"), (1, 11, 1, "message", "assistant", ""), (1, 11, 2, "delta", None, "Hel"), (1, 11, 3, "delta", None, "lo"), (1, 11, 4, "regenerate", None, None),
        (1, 11, 5, "delta", None, "Good "), (1, 11, 6, "delta", None, "day"), (1, 10, 7, "edit", None, "hello"), (1, 12, 8, "message", "user", "gone"), (1, 12, 9, "delete", None, None), (2, 1, 0, "delta", "assistant", None),
    ]
    random.Random(1).shuffle(log)
    parts = {r.conv_id: r for r in c.join_turns(c.format_turns(spark.createDataFrame(log, c.EVENTS))).collect()}
    assert parts[1].formatted == '<turn role="user">hello</turn>\n<turn role="assistant">Good day</turn>\n'
    assert [parts[1].formatted[s.start : s.end] for s in parts[1].loss] == ["Good day"]
    assert parts[2].formatted == '<turn role="assistant"></turn>\n'
    assert c.fold(iter([("shout", "user", "x")])) is None and c.fold(iter([("delta", "user", "a"), (None, "x", "b"), ("delta", None, "c")])) == ("user", "ac")


def test_bad_events_are_counted_and_passed_over(spark):
    """Unknown and null types, null conversations and messages, ties and repeated events."""
    log = [(1, 1, 0, "message", "user", "hi"), (1, 1, 1, "shout", "x", "!"), (1, 1, 1, None, None, "?"), (1, 1, 1, None, None, "?"), (None, None, 0, "delta", "user", "a"), (None, None, 0, "delta", "user", "a"), (None, None, 0, "delta", "user", "b"), (3, 1, 0, "delete", None, None)]
    events = spark.createDataFrame([(*r, 1) for r in log], c.EVENTS + ", position int")
    assert sorted((r.type or "", r.n) for r in c.rejected(events).collect()) == [("", 2), ("shout", 1)]
    assert {r.conv_id: r.formatted for r in c.join_turns(c.format_turns(events)).collect()} == {1: '<turn role="user">hi</turn>\n', None: '<turn role="user">aab</turn>\n'}
    assert c.join_turns(c.format_turns(events.limit(0))).count() == 0 and c.rejected(events.limit(0)).count() == 0


def test_log_holds_every_type_of_event(spark):
    kinds = {r.type for r in c.log_of(c.control_turns(spark)).collect()}
    assert kinds == set(c.EVENT_TYPES)
