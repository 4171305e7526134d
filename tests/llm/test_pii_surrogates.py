import random
import re

from llm_helpers import clashing, documents
from pyspark.sql import functions as F

from claimweave.llm import pii_surrogates as P


def run(spark, texts, key="k"):
    return {r.doc_id: (r.text, [(e.kind, e.start, e.surrogate) for e in r.entities]) for r in P.replace_pii(documents(spark, texts), key).collect()}


def luhn(digits):
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = int(c) * (1 + i % 2)
        total += d - 9 * (d > 9)
    return total % 10 == 0


CASES = [
    "Write to Ana.Diaz7@Mail.example.com or ANA.DIAZ7@MAIL.EXAMPLE.COM&&& now",
    "call +1 (521) 555-6210 or +1-521-555-6210, else (333) 444-5555.",
    "from 10.1.2.3 via 85.3.200.254 not 1.2.3.4.5 nor 300.1.1.1",
    "card 4111 1111 1111 1111 and 4111111111111111 and 4111111111111112!",
    "Mrs Ann Lee met Mr. LEE, Herr Otto Weiß and госпожа Анна Иванова; Dr Lee left.",
    "nothing here 12345 and a@b",
    None,
    "",
]


def test_surrogates_match_type_and_format(spark):
    got = run(spark, CASES)
    for i, text in enumerate(CASES):
        new, entities = got[i]
        if not entities:
            assert new == text
        for _, start, surrogate in entities:
            assert new[start : start + len(surrogate)] == surrogate
    assert [k for k, _, _ in got[0][1]] == ["email", "email"]
    one, two = (s for _, _, s in got[0][1])
    assert two == one.upper() and re.fullmatch(r"[a-z]{3}\.[a-z]{4}\d@[a-z]{4}\.[a-z]{7}\.com", one) and one != "ana.diaz7@mail.example.com"
    shape = lambda s: re.sub(r"\d", "9", s)
    phones = [s for _, _, s in got[1][1]]
    assert [shape(s) for s in phones] == ["+9 (999) 999-9999", "+9-999-999-9999", "(999) 999-9999"]
    digits = [re.sub(r"\D", "", s) for s in phones]
    assert digits[0] == digits[1] != "15215556210" and digits[0][0] == "1"
    inner, outer = (s for _, _, s in got[2][1])
    assert inner.startswith("10.") and inner != "10.1.2.3" and not re.match(r"10\.|127\.|192\.|172\.", outer)
    assert all(0 <= int(o) < 256 for s in (inner, outer) for o in s.split("."))
    cards = [s for _, _, s in got[3][1]]
    assert cards[0].replace(" ", "") == cards[1] and shape(cards[0]) == "9999 9999 9999 9999"
    assert luhn(cards[1]) and not luhn(cards[2]) and cards[1][0] == "4"
    names = [s.split(" ") for _, _, s in got[4][1]]
    assert [n[0] for n in names] == ["Mrs", "Mr.", "Herr", "госпожа", "Dr"]
    assert names[0][2].upper() == names[1][1] and names[4][1] == names[0][2] != "Lee"
    assert names[0][1].endswith("na") and names[2][1].endswith("n") and names[3][1].endswith("на")
    assert re.fullmatch(r"[А-Я][а-я]+", names[3][2])


def test_phone_before_an_address(spark):
    texts = ["call +1 (017) 555-7713 161.17.88.162 now", "+1 (017) 555-7713 or 161.17.88.162", "+49 30 1234 5678 10.1.2.3, +44.20.1234.5678 and +1 (017) 555-7713 16.17"]
    got = run(spark, texts)
    assert [[k for k, _, _ in got[i][1]] for i in range(3)] == [["phone", "ip"], ["phone", "ip"], ["phone", "ip", "phone", "phone"]]
    assert [s for _, _, s in got[0][1]] == [s for _, _, s in got[1][1]]
    assert "161.17" not in got[0][0] and "88.162" not in got[0][0]


def test_one_thing_one_surrogate_and_two_things_two(spark):
    rng = random.Random(3)
    ips = [f"{rng.randrange(11, 99)}.{rng.randrange(256)}.{rng.randrange(256)}.{rng.randrange(256)}" for _ in range(400)]
    short = [f"{a}{b}@q.org" for a in "abcdefghijklmnopqrstuvwxyz" for b in "abcdefghijklmnopqrstuvwxyz"][:600]
    texts = [f"see {rng.choice(ips)} and {s} or {rng.choice(short)}" for s in short for _ in range(2)]
    got = run(spark, texts)
    seen = {}
    for i, text in enumerate(texts):
        for old, (_, _, new) in zip(re.findall(r"\S+@\S+|\d+\.\S+", text), got[i][1], strict=True):
            assert seen.setdefault(old, new) == new != old
    assert len(set(seen.values())) == len(seen)
    assert not set(seen.values()) & set(seen)
    assert run(spark, texts[:3], "other")[0] != run(spark, texts[:3])[0] == run(spark, texts[:3])[0]


def test_crowded_formats_end(spark):
    df = spark.createDataFrame([(f"email:{c}@x.y",) for c in "abcdefghijklmnopqrstuvwxyz0123456789"], "thing string")
    rows = P.surrogate_table(df, "k").collect()
    assert len({r.surrogate for r in rows}) == len(rows) == 36
    assert not {r.surrogate for r in rows} & {r.thing[6:] for r in rows}


def test_nulls_repeats_long_texts_and_no_rows(spark):
    long = "word " * 100_000 + "ip 85.3.200.254 " + "x" * 100_000 + " " + "1" * 50_000
    rows = [(None, "a@b.com"), (None, "85.3.200.254"), (1, "a@b.com"), (1, long), (1, "a@b.com")]
    df = clashing(spark.createDataFrame(rows, "doc_id long, text string"))
    got = P.replace_pii(df).collect()
    assert len(got) == 5 and not any(t in r.text for r in got for t in ("a@b.com", "85.3.200.254"))
    assert len({e.surrogate for r in got for e in r.entities}) == 2
    assert P.replace_pii(df.filter(F.lit(False))).count() == 0
