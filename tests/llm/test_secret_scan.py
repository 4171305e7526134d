import base64
import random
import re
import string
import zlib

from llm_helpers import clashing, documents

from claimweave.llm import secret_scan as S

PLAIN = [
    ("assign", r"""([pP][aA][sS][sS][wW][oO][rR][dD]|[pP][aA][sS][sS][wW][dD]|[sS][eE][cC][rR][eE][tT]|[tT][oO][kK][eE][nN]|[aA][pP][iI]_?[kK][eE][yY])["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""),
    ("access", "AKIA[A-Z0-9]+"),
    ("hex", "[0-9a-f]+"),
]


def plain(text):
    out = []
    for kind, pattern in PLAIN:
        for m in re.finditer(pattern, text or ""):
            size = {"assign": len(m[2]) if kind == "assign" else 0, "access": len(m[0]), "hex": len(m[0])}[kind]
            if size >= {"assign": 6, "access": 20, "hex": 24}[kind]:
                out.append((m.start(), S.KINDS.index(kind), m.end()))
    return sorted(out)


def base_of(text):
    return [s for s in S.scan(text, S.automaton()) if s[1] < 3]


def test_base_spans_equal_plain_expressions():
    rng = random.Random(4)
    parts = ["password", "PassWd", "secret", "token", "api_key", "APIKEY", "ſecret", "toKen", "=", ":", " ", "'", '"', "AKIA", "ABCDEFGHIJ0123456", "akia", "abc", "0123456789abcdef", "ghp_", "é", "İ", "\n", "x", "😀", "tok"]
    for _ in range(3000):
        text = "".join(rng.choice(parts) for _ in range(rng.randrange(14)))
        assert base_of(text) == plain(text), text


def test_given_texts(spark):
    for row in spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("text").collect():
        assert base_of(row.text) == plain(row.text)


def summed(prefix, rng):
    body = "".join(rng.choice(string.ascii_letters + string.digits) for _ in range(30))
    value, out = zlib.crc32(body.encode()), ""
    while value:
        value, d = divmod(value, 62)
        out = S.DIGITS[d] + out
    return prefix + body + out.rjust(6, "0")


def test_checksums():
    rng = random.Random(6)
    good = summed("ghp_", rng)
    bad = good[:-1] + ("a" if good[-1] != "a" else "b")
    npm = summed("npm_", rng)
    head = base64.urlsafe_b64encode(b'{"alg":"HS256","typ":"JWT"}').decode().rstrip("=")
    jwt, fake = f"{head}.{head}.c2ln", "eyJhbGc.eyJhbGc.c2ln"
    der = b"\x30\x82\x01\x00" + bytes(256)
    pem = "-----BEGIN PRIVATE KEY-----\n" + base64.encodebytes(der).decode() + "-----END PRIVATE KEY-----"
    torn = pem.replace("AAAA", "", 1)
    text = " ".join([good, bad, npm, jwt, fake, pem, torn])
    found = [(S.KINDS[k], text[a:b]) for a, k, b in S.scan(text, S.automaton()) if k > 2]
    assert found == [("github", good), ("npm", npm), ("jwt", jwt), ("pem", pem)]


def test_rows(spark):
    texts = [None, "", "token=abcdef", "é token=abcdef " + "x" * 200_000 + " AKIA" + "B" * 16]
    df = clashing(documents(spark, texts))
    got = {r.doc_id: [tuple(s) for s in r.secrets] for r in S.find_secrets(df.unionByName(df)).collect()}
    assert got == {0: [], 1: [], 2: [("assign", 0, 12)], 3: [("assign", 2, 14), ("access", 200_016, 200_036)]}
    assert S.find_secrets(df.limit(0)).count() == 0
    ids = df.sparkSession.createDataFrame([(None, "token=abcdef")], "doc_id long, text string")
    assert S.find_secrets(ids).first().doc_id is None


def test_many_beginnings_of_a_token_are_linear():
    import time

    words = S.automaton()
    for text in ("eyJ" * 350_000, "eyJ" * 150_000 + ".eyJ" + "x" * 100, ("eyJa.eyJb " * 60_000), "eyJ." * 200_000):
        began = time.time()
        assert S.scan(text, words) == []
        assert time.time() - began < 8
