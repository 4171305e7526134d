"""Secret scan: keyword automaton first, anchored expressions near its hits, then embedded checksums."""

from __future__ import annotations

import base64
import binascii
import json
import re
import zlib
from collections.abc import Iterator

import ahocorasick
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from claimweave.llm.common import query, table

KINDS = ("assign", "access", "hex", "github", "npm", "jwt", "pem")
ASSIGN_WORDS = ("password", "passwd", "secret", "token", "api_key", "apikey")
GITHUB_WORDS = ("ghp_", "gho_", "ghu_", "ghs_", "ghr_")
ASSIGN = re.compile(r"""(?ai:password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""")
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
SUMMED = re.compile(r"(?:gh[pousr]|npm)_([0-9A-Za-z]{30})([0-9A-Za-z]{6})(?![0-9A-Za-z])")
JWT = re.compile(r"(eyJ[A-Za-z0-9_-]+)\.(eyJ[A-Za-z0-9_-]+)\.([A-Za-z0-9_-]+)")
PEM = re.compile(r"-----BEGIN ((?:[A-Z0-9]+ )*PRIVATE KEY)-----([A-Za-z0-9+/=\s]+)-----END \1-----")
#: The characters of one part of a token; what follows them decides for every start among them.
JWT_PART = re.compile(r"[A-Za-z0-9_-]+")
DIGITS = "0123456789ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz"
#: Runs of at least 24 hexadecimal digits; a shorter one is never looked at twice.
HEX_RUN = re.compile(r"(?<![0-9a-f])[0-9a-f]{24,}")


def automaton() -> ahocorasick.Automaton:
    words = ahocorasick.Automaton()
    for kind, keys in (("assign", ASSIGN_WORDS), ("access", ("akia",)), ("github", GITHUB_WORDS), ("npm", ("npm_",)), ("jwt", ("eyj",)), ("pem", ("-----begin ",))):
        for key in keys:
            words.add_word(key, (kind, len(key)))
    words.make_automaton()
    return words


def checksum_holds(body: str, tail: str) -> bool:
    """The last six characters are the CRC32 of the body in base 62."""
    value, out = zlib.crc32(body.encode()), ""
    while value:
        value, digit = divmod(value, 62)
        out = DIGITS[digit] + out
    return out.rjust(6, "0") == tail


def header_holds(part: str) -> bool:
    """The first part of the token decodes to a JSON object that names its algorithm."""
    try:
        header = json.loads(base64.urlsafe_b64decode(part + "=" * (-len(part) % 4)))
    except (ValueError, binascii.Error, RecursionError):
        return False
    return isinstance(header, dict) and "alg" in header


def key_holds(body: str) -> bool:
    """The block is base64 of one DER sequence whose stated length is its own (RFC 1421 headers are not)."""
    try:
        raw = base64.b64decode("".join(body.split()), validate=True)
    except (ValueError, binascii.Error):
        return False
    if len(raw) < 2 or raw[0] != 0x30:
        return False
    wide = raw[1] & 0x7F if raw[1] & 0x80 else 0
    return int.from_bytes(raw[2 : 2 + wide] if wide else raw[1:2], "big") == len(raw) - 2 - wide


def scan(text: str | None, words: ahocorasick.Automaton) -> list[tuple[int, int, int]]:
    """(start, place of the kind, end) of every secret in code points, sorted."""
    if not text:
        return []
    # lower case of A-Z only, which keeps every position
    low = text.encode("utf-8", "surrogatepass").lower().decode("utf-8", "surrogatepass")
    hits = sorted((end - size + 1, kind) for end, (kind, size) in words.iter(low))
    spans, past = [], dict.fromkeys(KINDS, 0)
    for start, kind in hits:
        if start < past[kind]:
            continue
        found = None
        if kind == "assign" and (m := ASSIGN.match(text, start)):
            past[kind] = m.end()
            found = len(m[1]) >= 6
        elif kind == "access" and (m := ACCESS.match(text, start)):
            past[kind] = m.end()
            found = m.end() - start >= 20
        elif kind in ("github", "npm") and (m := SUMMED.match(text, start)):
            past[kind] = m.end()
            found = checksum_holds(m[1], m[2])
        elif kind == "jwt":
            end = JWT_PART.match(text, start).end()
            if not text.startswith(".eyJ", end):
                past[kind] = end  # no start before the end of these characters can do better
            elif m := JWT.match(text, start):
                past[kind] = m.end()
                found = header_holds(m[1])
            else:
                past[kind] = end
        elif kind == "pem" and (m := PEM.match(text, start)):
            past[kind] = m.end()
            found = key_holds(m[2])
        if found:
            spans.append((start, KINDS.index(kind), m.end()))
    spans += [(m.start(), KINDS.index("hex"), m.end()) for m in HEX_RUN.finditer(text)]
    return sorted(spans)


def find_secrets(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, secrets array<struct<kind, start, end>>), a row for each row; a null or empty text has none.

    Offsets count code points, the end is exclusive.  One scan, no shuffle; a row is as independent
    of the others as its text is, so repeated rows, null ids and further columns change nothing.
    """
    kind = dict(docs.dtypes)[id_col]
    slim = docs.select(F.col(id_col).alias("_i"), F.col(text_col).alias("_t"))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        words = automaton()
        for batch in batches:
            found = [[{"kind": KINDS[k], "start": a, "end": b} for a, k, b in scan(t, words)] for t in batch["_t"]]
            yield pd.DataFrame({"_i": batch["_i"], "secrets": found})

    out = slim.mapInPandas(run, f"_i {kind}, secrets array<struct<kind: string, start: long, end: long>>")
    return out.withColumnRenamed("_i", id_col)


def _joined(items) -> F.Column:
    said = F.transform(items, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string")))
    return F.array_join(said, ",")


@query("op8_secret_scan")
def op8_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = find_secrets(table(spark, sf_dir, "documents"))
    base = F.filter("secrets", lambda s: s["kind"].isin(*KINDS[:3]))
    count = lambda kind: F.size(F.filter("secrets", lambda s: s["kind"] == kind)).cast("long")
    return found.select(
        "doc_id",
        *[count(kind).alias(f"n_{kind}") for kind in KINDS[:3]],
        F.sha2(_joined(base), 256).alias("base_sha256"),
        _joined(F.col("secrets")).alias("spans"),
    )


