import random
import re

from samples import awkward, empty, prose

from elastrain.llm import pii

# The base patterns, as plain regular expressions.
BASE = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+",
    "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    "card": r"[0-9]([\x20-]?[0-9])+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}


def brute(text):
    out = []
    for kind, pattern in BASE.items():
        for m in re.finditer(pattern, text):
            digits = re.sub("[^0-9]", "", m[0])
            good = {
                "email": True,
                "ip": kind == "ip" and all(int(p) <= 255 for p in m[0].split(".")),
                "card": 16 <= len(digits) <= 19 and pii.luhn(digits),
                "phone": 8 <= len(digits) <= 15,
            }[kind]
            if good:
                out.append((kind, *m.span()))
    return out


def base(text):
    return [s[:3] for s in pii.spans_of(text) if s[0] in pii.BASE_KINDS]


def test_base_spans_are_those_of_the_plain_patterns():
    draw = random.Random(4)
    for _ in range(20000):
        text = "".join(draw.choice("@@.. -+()01299aB_%4556737586899855é") for _ in range(draw.randint(0, 70)))
        assert base(text) == brute(text)


def test_checksums():
    assert pii.luhn("4556737586899855") and not pii.luhn("4556737586899856")
    assert pii.mod_97("GB82WEST12345698765432") and not pii.mod_97("GB83WEST12345698765432")


def test_words_nearby_move_the_score_and_decide_on_added_kinds():
    assert pii.spans_of("the iban GB82 WEST 1234 5698 7654 32 THE END") == [("iban", 9, 36, 1.0)]
    assert pii.spans_of("my ssn is 123-45-6789.")[0][:3] == ("ssn", 10, 21)
    assert pii.spans_of("part 123-45-6789.") == []
    assert pii.spans_of("call 555-123-4567 now")[0][0] == "local_phone"
    low, high = (pii.spans_of(t)[0][3] for t in ("version 1.2.3.4", "ip address 1.2.3.4"))
    assert low < pii.PRIOR["ip"] < high


def test_added_kinds_next_to_other_numbers():
    found = lambda text: [(s[0], text[s[1] : s[2]]) for s in pii.spans_of(text)]
    assert found("SSN 123-45-6789 01/02/1980") == [("ssn", "123-45-6789")]
    assert found("ssn 123-45-6789 234-56-7890.") == [("ssn", "123-45-6789"), ("ssn", "234-56-7890")]
    assert found("call 555-123-4567 24 hours") == [("local_phone", "555-123-4567")]
    assert found("call 1-555-123-4567 555.123.4568") == [("local_phone", "555-123-4567"), ("local_phone", "555.123.4568")]
    assert found("ssn 0123-45-6789 123-45-67890, call 5555-123-4567") == []
    assert found("DE89370400440532013000 GB29NWBK60161331926819") == [("iban", "DE89370400440532013000"), ("iban", "GB29NWBK60161331926819")]
    assert found("AB12 GB82 WEST 1234 5698 7654 32") == [("iban", "GB82 WEST 1234 5698 7654 32")]
    assert found("DE12 DE89 3704 0044 0532 0130 00 X") == [("iban", "DE89 3704 0044 0532 0130 00")]
    assert found("xGB82WEST12345698765432 GB82WEST12345698765432x GB83WEST12345698765432") == []


def test_long_texts_take_linear_time():
    for text in ("a" * 300_000, "1" * 300_000, "@" * 300_000, "1." * 150_000, "+1 " * 100_000, "A" * 300_000, "@a.b " * 60_000):
        pii.spans_of(text)


def test_masked():
    text = "write a.b@c.de or +1 (634) 555-2085"
    assert pii.masked(text, pii.spans_of(text)) == "write [email] or [phone]"


def test_table(spark):
    df, rows = awkward(spark, ["mail a@b.cd", "card 4556 7375 8689 9855", "ip 10.0.0.1 and 10.0.0.999", "tel +49 30 1234567", *prose(20)])
    got = sorted(((r.doc_id, [tuple(s) for s in r.spans]) for r in pii.find_personal_data(df).collect()), key=str)
    assert got == sorted(((i, pii.spans_of(t or "")) for i, t in rows), key=str)
    assert pii.find_personal_data(empty(spark)).count() == 0
