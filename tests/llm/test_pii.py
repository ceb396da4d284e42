import hashlib
import random
import re
from collections import Counter

from tickloom.llm import pii as p

PLAIN = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+",
    "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    "card": r"[0-9]([\x20-]?[0-9])+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}


def luhn(digits):
    total = 0
    for i, c in enumerate(reversed(digits)):
        v = int(c) * (1 + i % 2)
        total += v - 9 if v > 9 else v
    return total % 10 == 0


def valid(kind, text):
    digits = "".join(c for c in text if c in "0123456789")
    if kind == "ip":
        return all(int(x) <= 255 for x in text.split("."))
    if kind == "card":
        return 16 <= len(digits) <= 19 and luhn(digits)
    return kind == "email" or 8 <= len(digits) <= 15


def base(text):
    found = {k: [m.span() for m in re.finditer(x, text or "") if valid(k, m.group())] for k, x in PLAIN.items()}
    listed = ",".join(f"{k}:{a}:{b}" for k in p.KINDS for a, b in found[k])
    return (*(len(found[k]) for k in p.KINDS), hashlib.sha256(listed.encode()).hexdigest())


def test_base_spans_match_plain_patterns(spark):
    rng = random.Random(11)
    parts = ["a@b.c", "x.y%z@", "_q@r-s.de.", "@", ".", "..", "4111111111111111", "4111 1111-1111 1111", "1.2.3.4", "300.1.1.1", "010.0.0.255", "+1 (988) 555-2485", "+49", "-", " ", "é", "𝔘", "7", "00", "(", ")", "+", "\n", "text "]
    texts = [None, "", "1" * 5000, "a" * 4000 + "@", "1-" * 3000, "+1" + "(" * 2000, "9." * 2000] + ["".join(rng.choice(parts) for _ in range(rng.randint(1, 25))) for _ in range(1500)]
    docs = spark.createDataFrame([(k, t, 1) for k, t in enumerate(texts)], "doc_id long, text string, email int")
    rows = p.digest(p.find(docs)).collect()
    wrong = [(texts[r.doc_id], tuple(r)[1:6], base(texts[r.doc_id])) for r in rows if tuple(r)[1:6] != base(texts[r.doc_id])]
    assert not wrong and len(rows) == len(texts)
    kept = {s for r in rows for s in [r.spans] if s}
    assert kept


def test_looser_spans_are_added_and_redacted(spark):
    good = [(k, f"Please write an email to user{k}@mail.com or call +1 (988) 555-2{k:03d} now") for k in range(100)]
    more = [(200, "call my phone (212) 555-0199 soon"), (201, "mail me: joe [at] site [dot] com ok"), (202, "order 123-456-7890123"), (203, None), (204, "no data"), (204, "no data")]
    docs = spark.createDataFrame(good + more, "doc_id long, text string")
    got = {r.doc_id: r.spans for r in p.digest(p.find(docs)).collect()}
    assert got[200] == "phone:14:28" and got[201] == "email:9:32" and got[202] == got[203] == got[204] == ""
    texts = {r.doc_id: r.text for r in p.redact(docs).collect()}
    assert texts[5] == "Please write an email to <email> or call <phone> now"
    assert texts[200] == "call my phone <phone> soon" and texts[203] is None and texts[204] == "no data"
    assert p.redact(docs).count() == len(good + more)


def test_phone_before_an_address(spark):
    """The strict pattern takes both for one number that is too long; the looser one finds the number."""
    docs = [(k, f"call me on +1 (826) 555-4{k:03d} now") for k in range(60)] + [(100, "write to +1 (826) 555-4081 190.137.223.204 soon")]
    got = {r.doc_id: r.spans for r in p.digest(p.find(spark.createDataFrame(docs, "doc_id long, text string"))).collect()}
    assert got[100] == "ip:27:42,phone:9:26" and got[3] == "phone:11:28"


def test_many_matches_in_one_text(spark):
    text = "mail a@b.co, " * 20_000
    r = p.digest(p.find(spark.createDataFrame([(None, text)], "doc_id long, text string"))).first()
    assert r.doc_id is None and r.n_email == 20_000 and r.spans.startswith("email:5:11,email:18:24,") and r.spans.endswith(f"email:{len(text) - 8}:{len(text) - 2}")


def planted(rng):
    """Texts with looser spans of all kinds and look-alikes that are no personal data: (text, spans)."""
    digits = lambda n: "".join(rng.choice("0123456789") for _ in range(n))
    word = lambda: "".join(rng.choice("abcdefghij") for _ in range(rng.randint(3, 8)))
    personal = {
        "email": [("mail me at ", lambda: f"{word()} [at] {word()} [dot] com"), ("contact: ", lambda: f"{word()}(at){word()}(dot)org")],
        "ip": [("the server address is ", lambda: ":".join(rng.choice(["2001", "db8", "85a3", "8a2e", "370", "7334", "1f", "c0"]) for _ in range(8))), ("host ", lambda: ":".join(rng.choice(["fe80", "1", "abc"]) for _ in range(8)))],
        "card": [("my amex card is ", lambda: amex(rng)), ("credit card: ", lambda: amex(rng))],
        "phone": [("call ", lambda: f"({digits(3)}) 555-{digits(4)}"), ("telephone ", lambda: f"{digits(3)}-555-{digits(4)}")],
    }
    decoys = [("order ", lambda: f"{digits(3)}-{digits(3)}-{digits(4)}"), ("build version ", lambda: f"{digits(3)}.{digits(3)}.{digits(4)}"), ("serial ", lambda: "37" + digits(13)), ("invoice no ", lambda: "34" + digits(13))]
    for _ in range(60):
        for kind, makers in personal.items():
            cue, make = rng.choice(makers)
            head, span = f"{word()} {word()} {cue}", make()
            yield f"{head}{span} and {word()}", [f"{kind}:{len(head)}:{len(head) + len(span)}"]
        cue, make = rng.choice(decoys)
        yield f"{word()} {cue}{make()} and {word()}", []
        yield f"{word()} write to {word()}@{word()}.com, ip 10.1.2.{rng.randint(0, 255)}, card 4111111111111111 or phone +1 (988) 555-{digits(4)}", None


def amex(rng):
    while True:
        n = rng.choice(["34", "37"]) + "".join(rng.choice("0123456789") for _ in range(13))
        if luhn(n):
            return n


def test_recall_and_precision_of_added_spans(spark):
    rows = list(planted(random.Random(5)))
    got = {r.doc_id: r.spans for r in p.digest(p.find(spark.createDataFrame([(k, t) for k, (t, _) in enumerate(rows)], "doc_id long, text string"))).collect()}
    told = Counter()
    for k, (_, spans) in enumerate(rows):
        if spans is not None:
            found = [x for x in got[k].split(",") if x]
            told["right"] += sum(x in found for x in spans)
            told["planted"] += len(spans)
            told["wrong"] += sum(x not in spans for x in found)
    assert (told["right"], told["planted"]) == (240, 240)
    assert told["right"] >= 0.9 * told["planted"] and told["wrong"] <= 0.05 * told["planted"]


def test_empty_table(spark):
    assert p.find(spark.createDataFrame([], "doc_id long, text string")).count() == 0
