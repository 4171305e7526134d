"""Spelling variants by composing the vocabulary's minimised acceptor with a one-edit transducer and the acceptor again.

A path of the composition reads two words at once: equal letters up to one state, then one edit, then equal letters to the
end.  The composition falls into parts by the state it starts from.  Two words with one edit between them share
the first half of the longer one or else what lies behind it, so a word starts in few parts: behind its first half,
or before its last half with the edit still to come.  Parts with too many words start deeper, by the same rule
on what is left, down to one letter, so no part stays large whatever the words are.  Each part is a task's
work: build the minimised acceptor of what its words have left, and read off the accepted pairs.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from claimweave.llm.common import query, stored, table

#: The letters of a word and the modulus of the deletions.
LETTERS = r"A-Za-zÀ-ÿ"
MODULUS = 31
LEAST_LENGTH = 7
LEAST_COUNT = 2
RATIO = 10
PART = 2_000
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def vocabulary(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", least: int = LEAST_LENGTH) -> DataFrame:
    """(word, n) of the words of at least ``least`` letters that occur twice or more, written once.

    A run with fewer letters can't become such a word, so only longer ones leave the scan.  A null id counts as the empty text.
    """
    runs = F.regexp_extract_all(F.col(text_col), F.lit(f"([{LETTERS}]{{{least},}})"), 1)
    found = docs.select(F.coalesce(F.col(id_col).cast("string"), F.lit("")).alias("i"), F.explode(runs).alias("run"))
    low = found.select("i", F.translate("run", UPPER, LOWER).alias("run"))
    hashed = low.select("run", F.crc32(F.concat("i", F.lit(":"), "run")).alias("h"))
    at = F.pmod(F.col("h"), F.length("run")).cast("int")
    cut = F.concat(F.substring(F.col("run"), F.lit(1), at), F.substring(F.col("run"), at + 2, F.length("run")))
    words = hashed.select(F.when(F.col("h") % MODULUS == 0, cut).otherwise(F.col("run")).alias("word"))
    counts = words.filter(F.length("word") >= least).groupBy("word").agg(F.count(F.lit(1)).alias("n"))
    return stored(counts.filter(F.col("n") >= LEAST_COUNT))


class Acceptor:
    """The minimised acceptor of a sorted list of distinct words; an arc reads all letters up to the next fork or end.

    States with the same words to come are one state.
    """

    def __init__(self, words: list[str]):
        self.final: list[bool] = []
        self.arcs: list[list[tuple[str, int]]] = []
        self._known: dict[tuple, int] = {}
        self.start = self._state(words, 0, len(words), 0)
        self._common: dict[tuple[int, int], list[str]] = {}
        self._edits: dict[int, list[tuple[str, str]]] = {}
        self._fertile: dict[int, bool] = {}

    def _state(self, words: list[str], lo: int, hi: int, depth: int) -> int:
        final = len(words[lo]) == depth
        i, arcs = lo + final, []
        while i < hi:
            letter, j = words[i][depth], i + 1
            while j < hi and words[j][depth] == letter:
                j += 1
            a, b = words[i], words[j - 1]
            end = len(a) if i + 1 == j else _shared(a, b, depth + 1)
            arcs.append((a[depth:end], self._state(words, i, j, end)))
            i = j
        key = (final, *arcs)
        state = self._known.get(key)
        if state is None:
            state = self._known[key] = len(self.arcs)
            self.final.append(final)
            self.arcs.append(arcs)
        return state

    def common(self, p: int, q: int) -> list[str]:
        """The words to come that both states accept."""
        if p > q:
            p, q = q, p
        out = self._common.get((p, q))
        if out is None:
            out = [""] if self.final[p] and self.final[q] else []
            other = {label[0]: (label, t) for label, t in self.arcs[q]}
            for label, t in self.arcs[p]:
                if (arc := other.get(label[0])) is not None:
                    out.extend(self.along(label, t, *arc))
            self._common[p, q] = out
        return out

    def along(self, a: str, p: int, b: str, q: int) -> list[str]:
        """Words accepted both by reading ``a`` and going on from p, and by reading ``b`` and going on from q."""
        if len(a) > len(b):
            a, p, b, q = b, q, a, p
        read = a
        while b.startswith(a):
            b = b[len(a) :]
            if not b:
                return [read + z for z in self.common(p, q)]
            # p is reached while q is still ahead
            for label, t in self.arcs[p]:
                if label[0] == b[0]:
                    break
            else:
                return []
            a, p = label, t
            if len(a) > len(b):
                a, p, b, q = b, q, a, p
            read += a
        return []

    def edits(self, q: int) -> list[tuple[str, str]]:
        """Pairs of words to come that part right at ``q``, one edit from each other, the longer one first."""
        out = self._edits.get(q)
        if out is not None:
            return out
        out = self._edits[q] = []
        arcs = self.arcs[q]
        for i, (a, s) in enumerate(arcs):
            rest = a[1:]
            if self.final[q] and not rest and self.final[s]:
                out.append((a, ""))
            for j, (b, t) in enumerate(arcs):
                if i == j:
                    continue
                if i < j:  # replaced
                    out.extend((a[0] + z, b[0] + z) for z in self.along(rest, s, b[1:], t))
                # the first letter of a put in before what b reads
                out.extend((a[0] + z, z) for z in self.along(rest, s, b, t))
        return out

    def fertile(self, q: int) -> bool:
        """True if a pair parts at ``q`` or behind it."""
        out = self._fertile.get(q)
        if out is None:
            out = self._fertile[q] = any([self.fertile(t) for _, t in self.arcs[q]]) or bool(self.edits(q))
        return out

    def pairs(self, longer: int, reach: int, behind: str = "") -> Iterator[tuple[str, str]]:
        """Pairs one edit apart whose longer word has ``longer`` letters and that part before letter ``reach``.

        All words go on with the letter ``behind``: a word that has it as its one further letter parts from the other one only
        behind it, so that pair belongs to another part.
        """
        paths = [("", self.start)]
        while paths:
            read, q = paths.pop()
            if len(read) >= reach:
                continue
            for u, v in self.edits(q):
                if len(read) + len(u) == longer and (v or u != behind):
                    yield read + u, read + v
            paths.extend((read + a, t) for a, t in self.arcs[q] if len(read) + len(a) < reach and self.fertile(t))


def _shared(a: str, b: str, at: int) -> int:
    end = min(len(a), len(b))
    while at < end and a[at] == b[at]:
        at += 1
    return at


def parts_of_composition(words: DataFrame, least: int = LEAST_LENGTH, largest: int = PART) -> DataFrame:
    """(part, longer, reach, head, tail, mid, n): each word in every part of the composition it starts in, written.

    ``longer`` is the length of the longer word of a pair, ``head`` and ``tail`` are read before the part starts, ``mid`` is what is
    left, and the words of a pair must part before letter ``reach``.  Every pair is accepted in exactly one part.  A part of more than
    ``largest`` words is cut at the middle of what is left: pairs that part later start behind its first half, the
    others lie before its second half.  A cut ends where one letter is left, where a part has no more words than there are letters.
    """
    length = F.length("word")
    whole = words.select("word", "n", F.explode(F.array(length, length + 1)).alias("longer")).filter(F.col("longer") > least - 1)
    open_parts = whole.select(F.lit("").alias("head"), F.lit("").alias("tail"), F.col("word").alias("mid"), "n", "longer", F.col("longer").alias("reach"))
    done = None
    while True:
        cut = stored(_halved(open_parts))
        sizes = cut.groupBy("part").agg(F.count(F.lit(1)).alias("size"), F.max("left").alias("left"))
        crowded = stored(sizes.filter((F.col("size") > largest) & (F.col("left") > 1)).select("part"))
        settled = cut.join(crowded, "part", "left_anti")
        done = settled if done is None else done.unionByName(settled)
        if crowded.isEmpty():
            return done.select("part", "longer", "reach", "head", "tail", "mid", "n")
        open_parts = cut.join(crowded, "part", "left_semi").select("head", "tail", "mid", "n", "longer", "reach")


def _halved(parts: DataFrame) -> DataFrame:
    """Every row behind the first half of what is left and before the rest."""
    read = F.length("head") + F.length("tail")
    left = F.col("longer") - read
    first = F.floor(left / 2).cast("int")
    at = parts.withColumns({"_first": first, "_rest": (left - first).cast("int")})
    size = F.length("mid")
    behind = F.struct(
        F.concat("head", F.substring(F.col("mid"), F.lit(1), F.col("_first"))).alias("head"),
        F.col("tail"),
        F.substring(F.col("mid"), F.col("_first") + 1, size).alias("mid"),
        F.col("reach"),
    )
    before = F.struct(
        F.col("head"),
        F.concat(F.substring(F.col("mid"), size - F.col("_rest") + 1, size), "tail").alias("tail"),
        F.substring(F.col("mid"), F.lit(1), size - F.col("_rest")).alias("mid"),
        F.least("reach", (F.length("head") + F.col("_first")).cast("int")).alias("reach"),
    )
    out = at.select("n", "longer", F.inline(F.array(behind, before)))
    left_now = (F.col("longer") - F.length("head") - F.length("tail")).alias("left")
    return out.select(F.concat_ws(" ", "longer", "reach", "head", F.lit("+"), "tail").alias("part"), "longer", "reach", "head", "tail", "mid", "n", left_now)


PAIRS = "word string, near string, near_n long"


def _compose(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Reads rows sorted by part and puts out both directions of every accepted pair."""
    out: tuple[list, list, list] = ([], [], [])

    def flush() -> pa.RecordBatch:
        made = pa.RecordBatch.from_arrays([pa.array(out[0], pa.string()), pa.array(out[1], pa.string()), pa.array(out[2], pa.int64())], names=["word", "near", "near_n"])
        for column in out:
            column.clear()
        return made

    def settle(head: str, tail: str, longer: int, reach: int, counts: dict[str, int]) -> Iterator[pa.RecordBatch]:
        read = len(head) + len(tail)
        for u, v in Acceptor(sorted(counts)).pairs(longer - read, reach - len(head), tail[:1]):
            for one, other in ((u, v), (v, u)):
                out[0].append(head + one + tail)
                out[1].append(head + other + tail)
                out[2].append(counts[other])
            if len(out[0]) >= 20_000:
                yield flush()

    now, about, counts = None, None, {}
    for batch in batches:
        columns = [batch.column(c).to_pylist() for c in ("part", "longer", "reach", "head", "tail", "mid", "n")]
        for part, longer, reach, head, tail, mid, n in zip(*columns, strict=True):
            if part != now:
                if len(counts) > 1:
                    yield from settle(*about, counts)
                now, about, counts = part, (head, tail, longer, reach), {}
            counts[mid] = n
    if len(counts) > 1:
        yield from settle(*about, counts)
    yield flush()


def near_words(words: DataFrame, least: int = LEAST_LENGTH, largest: int = PART, per_task: int = 50_000) -> DataFrame:
    """(word, near, near_n) for both directions of every pair of words one edit apart, each once."""
    parts = parts_of_composition(words, least, largest)
    spark = words.sparkSession
    tasks = max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-4 * words.count() // per_task))
    dealt = parts.repartition(tasks, "part").sortWithinPartitions("part")
    return dealt.mapInArrow(_compose, PAIRS)


def roots(forms: DataFrame) -> DataFrame:
    """(word, root) of each (word, form): forms followed to the last.

    Each round doubles the steps taken.  Counts grow tenfold a step, so there are few; a form is near few words, so no key is hot.
    """
    now = stored(forms.select("word", F.col("form").alias("root")))
    while True:
        further = now.select(F.col("word").alias("root"), F.col("root").alias("further"))
        after = stored(now.join(further, "root", "left").select("word", F.coalesce("further", "root").alias("root"), F.col("further").isNotNull().alias("went")))
        if after.filter("went").isEmpty():
            return after.select("word", "root")
        now = after.select("word", "root")


def spelling_variants(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", least: int = LEAST_LENGTH, ratio: int = RATIO, largest: int = PART) -> DataFrame:
    """(word, form, root, n, n_near, form_n) of every word of at least ``least`` letters that occurs twice or more.

    A null or empty text has no words.  Equal rows count each for itself.  Words of any length take part, and a word
    without a near one is a row with n_near 0.  No words give no rows; further columns are not looked at.
    """
    words = vocabulary(docs, id_col, text_col, least)
    near = near_words(words, least, largest)
    best = near.groupBy("word").agg(F.count(F.lit(1)).alias("n_near"), F.min(F.struct((-F.col("near_n")).alias("m"), "near")).alias("best"))
    joined = words.join(best, "word", "left")
    enough = -F.col("best.m") >= ratio * F.col("n")
    found = stored(
        joined.select(
            "word", "n", F.coalesce("n_near", F.lit(0).cast("long")).alias("n_near"), F.when(enough, F.col("best.near")).alias("form"), F.when(enough, -F.col("best.m")).alias("form_n")
        )
    )
    last = roots(found.filter("form IS NOT NULL"))
    return found.join(last, "word", "left").select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")


def _sql() -> str:
    """Checksums byte by byte, pairs by equal deletions, roots by recursion."""
    crc_table = (
        "crc0 AS (SELECT i, list_reduce(range(0, 8), lambda c, k: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END, i) AS c"
        " FROM (SELECT unnest(range(0, 256)) AS i)), crc AS (SELECT list(c ORDER BY i) AS t FROM crc0)"
    )
    return rf"""
WITH RECURSIVE {crc_table},
runs AS (
  SELECT doc_id, unnest(regexp_extract_all(text, '[A-Za-z\x{{C0}}-\x{{FF}}]+')) AS run FROM documents),
low AS (
  SELECT doc_id, translate(run, '{UPPER}', '{LOWER}') AS run, count(*) AS times FROM runs WHERE length(run) >= {LEAST_LENGTH} GROUP BY 1, 2),
bytes AS (
  SELECT *, hex(encode(coalesce(doc_id::VARCHAR, '') || ':' || run)) AS x FROM low),
hashed AS (
  SELECT run, times, xor(4294967295, list_reduce(list_transform(range(0, (length(x) // 2)::BIGINT), lambda i: ('0x' || substr(x, 2 * i + 1, 2))::BIGINT),
    lambda c, b: xor(c >> 8, t[(xor(c, b) & 255) + 1]), 4294967295::BIGINT)) AS h FROM bytes, crc),
words AS (
  SELECT word, sum(times)::BIGINT AS n FROM (
    SELECT CASE WHEN h % {MODULUS} = 0 THEN substr(run, 1, h % length(run)) || substr(run, h % length(run) + 2) ELSE run END AS word, times FROM hashed)
  WHERE length(word) >= {LEAST_LENGTH} GROUP BY word HAVING sum(times) >= {LEAST_COUNT}),
cuts AS (
  SELECT word, n, i, substr(word, 1, i - 1) || substr(word, i + 1) AS cut FROM (SELECT word, n, unnest(range(1, length(word) + 1)) AS i FROM words)),
pairs AS (
  SELECT a.word AS word, b.word AS near FROM cuts a JOIN cuts b ON a.cut = b.cut AND a.i = b.i AND a.word <> b.word
  UNION SELECT a.word, w.word FROM cuts a JOIN words w ON a.cut = w.word
  UNION SELECT w.word, a.word FROM cuts a JOIN words w ON a.cut = w.word),
best AS (
  SELECT p.word, count(*) AS n_near, first(p.near ORDER BY o.n DESC, p.near) AS near, max(o.n) AS near_n FROM pairs p JOIN words o ON p.near = o.word GROUP BY p.word),
forms AS (
  SELECT w.word, w.n, coalesce(b.n_near, 0) AS n_near, CASE WHEN b.near_n >= {RATIO} * w.n THEN b.near END AS form,
    CASE WHEN b.near_n >= {RATIO} * w.n THEN b.near_n END AS form_n FROM words w LEFT JOIN best b ON w.word = b.word),
steps AS (
  SELECT word, word AS at, form AS next FROM forms
  UNION ALL SELECT s.word, s.next, f.form FROM steps s JOIN forms f ON s.next = f.word)
SELECT f.word, f.form, s.at AS root, f.n, f.n_near, f.form_n FROM forms f JOIN steps s ON f.word = s.word AND s.next IS NULL
"""


@query("op13_spelling_variants", _sql())
def op13_spelling_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spelling_variants(table(spark, sf_dir, "documents"))
