"""Near-duplicate lines by a deletion-neighbourhood join, with DataFrame operations only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from claimweave.llm.common import query, stored, table

MIN_WORDS = 5


def words_of(line: Column) -> Column:
    """Lower-case words between blanks."""
    return F.filter(F.split(F.lower(line), r"[\t\x0B\f\r ]+"), lambda w: w != "")


def _lines(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(doc, line_no, words) of every line of at least one word."""
    rows = docs.select(F.col(id_col).alias("doc"), F.posexplode_outer(F.split(text_col, "\n")).alias("line_no", "line"))
    # the words pass through a generator, so that a filter on them doesn't cut the line a second time
    return rows.select("doc", "line_no", F.explode_outer(F.array(words_of(F.col("line")))).alias("words"))


def _place(doc: str = "doc", line_no: str = "line_no") -> Column:
    """Order of lines: by document id (null last), then by line."""
    return F.struct(F.col(doc).isNull().alias("no_id"), F.col(doc).alias("doc"), F.col(line_no).alias("line_no"))


def _half_keys() -> Column:
    """Keys of the half that one edit leaves alone.

    Of two lines at most one word edit apart, let the shorter have n words and be cut after n // 2 of
    them: the edit is in one part, and the other part is equal in both.  So a line files its parts once
    for lines of its own length or longer by a word, and once for lines shorter by a word.
    """
    n = F.size("words")
    out = []
    for short in (n, n - 1):
        head = F.floor(short / 2).cast("int")
        tail = short - head
        out.append(F.xxhash64(F.lit("head"), short, F.slice("words", F.lit(1), head)))
        out.append(F.xxhash64(F.lit("tail"), short, F.slice("words", n - tail + 1, tail)))
    return F.array(*out)


def one_edit(a: Column, b: Column) -> Column:
    """True where two word arrays are at most one inserted, deleted or replaced word apart."""
    n, m = F.size(a), F.size(b)
    first = F.array_position(F.zip_with(a, b, lambda x, y: x.eqNullSafe(y)), False).cast("int")
    rest = lambda c, at: F.slice(c, at, F.greatest(F.size(c) - at + 1, F.lit(0)))
    edited = (
        F.when(n == m, rest(a, first + 1) == rest(b, first + 1))
        .when(n == m + 1, rest(a, first + 1) == rest(b, first))
        .when(m == n + 1, rest(a, first) == rest(b, first + 1))
        .otherwise(F.lit(False))
    )
    return F.when(first == 0, F.lit(True)).otherwise(edited)


def _variants(words: DataFrame) -> DataFrame:
    """(key, at, whole, place, line) of each line itself and of each line less one word.

    A line is hashed as the exclusive or of hashes of (word, position), so the hash of the line
    without word i comes from the running value up to i: one pass over the words of a line,
    however long it is.  Lines that meet with the gap at the same place differ in that word only; a
    line that meets another one's variant lacks that word.  Both are one edit, by construction.
    """
    exploded = words.repartition("line").select("line", "place", F.size("words").alias("n"), F.posexplode("words").alias("i", "word"))
    here, moved = F.xxhash64("word", "i"), F.xxhash64("word", F.col("i") - 1)
    keyed = exploded.select("line", "place", "n", "i", here.alias("here"), moved.alias("moved"))
    keyed = keyed.selectExpr(
        "line", "place", "n", "i",
        "bit_xor(here) OVER (PARTITION BY line ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) ^ here AS before",
        "bit_xor(moved) OVER (PARTITION BY line) ^ bit_xor(moved) OVER (PARTITION BY line ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS after",
        "bit_xor(here) OVER (PARTITION BY line) AS all_of_it",
    )
    less = F.col("before").bitwiseXOR(F.col("after"))
    ways = F.array(
        F.struct(F.xxhash64(F.lit("replaced"), "n", "i", less).alias("key"), F.lit(0).alias("role")),
        F.struct(F.xxhash64(F.lit("shorter"), F.col("n") - 1, less).alias("key"), F.lit(1).alias("role")),
    )
    first = F.when(F.col("i") == 0, F.array(F.struct(F.xxhash64(F.lit("shorter"), "n", "all_of_it").alias("key"), F.lit(2).alias("role"))))
    every = F.concat(ways, F.coalesce(first, F.array().cast("array<struct<key: bigint, role: int>>")))
    return keyed.select("line", "place", F.explode(every).alias("way")).select("line", "place", "way.key", "way.role")


def near_duplicate_lines(
    docs: DataFrame, min_words: int = MIN_WORDS, id_col: str = "doc_id", text_col: str = "text", equal_from: int = 1
) -> DataFrame:
    """(doc_id, line_no, kept_doc_id, kept_line_no, edits) of every line that repeats an earlier one.

    Lines are compared as lower-case words: a line goes if a line earlier in (doc_id, line_no) order is
    equal to it (edits 0) or one word edit from it (edits 1).  Edits are looked for between lines of at
    least ``min_words`` words, equal lines among those of at least ``equal_from`` (1: every line with a
    word).
    ``kept`` is the earliest equal line, or the earliest line one edit away if that is
    earlier than all equal ones; with chains of edits that one may itself be gone.  Lines are counted
    from 0; a null or empty text has no line to give.  A null id sorts last.  Rows that share an id
    count as one document, lines at equal places in them as one line.  Further columns are ignored.

    Steps: equal lines collapse by hash (map-side minima, so a line that a third of the documents have
    costs a row a task).  Only lines that share an unchanged half with another line emit their
    deletion variants; that condition is met by every pair one edit apart, so nothing is lost.
    Variants that meet are reduced to the earliest line per key, never to pairs, and the survivor of each line is
    verified word by word.
    """
    docs = docs.select(F.col(id_col).alias(id_col), F.col(text_col).alias(text_col))
    least = min(equal_from, min_words)
    lines = _lines(docs, id_col, text_col).filter(F.size("words") >= least)
    halves = F.when(F.size("words") >= min_words, _half_keys())
    seen = stored(lines.select("doc", "line_no", F.xxhash64(F.size("words"), "words").alias("line"), halves.alias("halves")))
    # a line's half keys are the same wherever it stands; shorter lines have none and emit no variants
    distinct = stored(seen.groupBy("line").agg(F.min(_place()).alias("place"), F.count(F.lit(1)).alias("n"), F.first("halves").alias("halves")))
    halves = distinct.select("line", F.explode("halves").alias("half"))
    shared = halves.groupBy("half").agg(F.count(F.lit(1)).alias("n")).filter("n > 1").select("half")
    asked = halves.join(shared, "half", "left_semi").select("line").distinct()
    asked = stored(distinct.select("line", "place").join(asked, "line", "left_semi"))
    by_doc = asked.groupBy(F.col("place.doc").alias("doc")).agg(F.collect_list(F.struct(F.col("place.line_no").alias("line_no"), "line", "place")).alias("at"))
    wide = docs.join(by_doc, docs[id_col].eqNullSafe(by_doc["doc"])).select(F.split(text_col, "\n").alias("lines"), F.explode("at").alias("at"))
    words = wide.select("at.line", "at.place", words_of(F.get("lines", F.col("at.line_no"))).alias("words"))
    # rows that share an id may differ in text: only the line that was hashed counts
    words = stored(words.filter(F.xxhash64(F.size("words"), "words") == F.col("line")).dropDuplicates(["line"]))
    variants = stored(_variants(words))
    met = variants.groupBy("key").agg(
        F.count(F.lit(1)).alias("n"),
        *[F.min(F.when(F.col("role") == r, F.struct("place", "line"))).alias(f"least_{r}") for r in range(3)],
    )
    met = met.filter("n > 1").drop("n")
    partner = F.when(F.col("role") == 0, F.col("least_0")).when(F.col("role") == 1, F.col("least_2")).otherwise(F.col("least_1"))
    earlier = variants.join(met, "key").select("line", "place", partner.alias("other")).filter(F.col("other.place") < F.col("place"))
    best = earlier.groupBy("line").agg(F.min("other").alias("other"))
    texts = words.select("line", "words")
    checked = best.join(texts, "line").select(F.col("line").alias("gone"), "other", F.col("words").alias("mine"), F.col("other.line").alias("line"))
    checked = checked.join(texts, "line").filter(one_edit(F.col("mine"), F.col("words"))).select(F.col("gone").alias("line"), "other")
    verdicts = distinct.join(stored(checked), "line", "left").filter("n > 1 OR other IS NOT NULL")
    verdicts = verdicts.select(
        "line", "place", F.coalesce(F.col("other.place"), F.col("place")).alias("kept"), F.col("other").isNotNull().cast("int").alias("edits")
    )
    # written, so that the join below stands alone and Spark can split a line that is everywhere
    verdicts = stored(verdicts)
    own = _place()
    gone = seen.select("doc", "line_no", "line").join(verdicts, "line").filter((F.col("edits") == 1) | (own > F.col("place")))
    return gone.select(
        F.col("doc").alias("doc_id"), "line_no", F.col("kept.doc").alias("kept_doc_id"), F.col("kept.line_no").alias("kept_line_no"), "edits"
    ).distinct()


def drop_lines(docs: DataFrame, gone: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """The documents less the given lines, with n_chars counted anew; one that loses all its text goes.

    Documents without such a line, also null and empty ones, stay as they are.
    """
    by_doc = gone.groupBy(F.col("doc_id").alias("_doc")).agg(F.collect_set("line_no").alias("_gone"))
    lines = F.split("text", "\n")
    rest = F.array_join(F.filter(lines, lambda line, i: ~F.array_contains("_gone", i)), "\n")
    joined = docs.join(by_doc, docs[id_col].eqNullSafe(by_doc["_doc"]), "left")
    text = F.when(F.col("_gone").isNull(), F.col("text")).otherwise(rest)
    out = joined.withColumn("_text", text).filter(F.col("_gone").isNull() | F.col("_text").rlike(r"\S"))
    changed = {"text": F.col("_text")}
    if "n_chars" in docs.columns:
        kind = dict(docs.dtypes)["n_chars"]
        changed["n_chars"] = F.when(F.col("_gone").isNull(), F.col("n_chars")).otherwise(F.length("_text").cast(kind))
    return out.withColumns(changed).select(*docs.columns)


def without_repeated_lines(docs: DataFrame) -> DataFrame:
    """The documents less every line that repeats an earlier one, documents told apart by id and text.

    Rows that share an id or have none lose their own repeated lines and no others.  Rows equal in id and text are one
    document, so they lose the same lines.
    """
    at = F.struct(F.col("doc_id").isNull().alias("no_id"), F.col("doc_id").alias("id"), F.xxhash64("text", F.md5("text")).alias("digest"))
    keyed = docs.withColumn("_at", at)
    return drop_lines(keyed, near_duplicate_lines(keyed, id_col="_at"), "_at").select(*docs.columns)


SQL = rf"""
WITH lines AS (
  SELECT doc_id, unnest(range(len(parts))) AS line_no, unnest(parts) AS line
  FROM (SELECT doc_id, string_split(text, chr(10)) AS parts FROM documents WHERE text IS NOT NULL)),
cut AS (
  SELECT doc_id, line_no::INT AS line_no,
    list_filter(regexp_split_to_array(lower(line), '[\t\x0B\f\r ]+'), lambda w: w <> '') AS words FROM lines),
long AS (SELECT *, row_number() OVER (ORDER BY doc_id, line_no) AS place FROM cut WHERE len(words) >= 1),
texts AS (SELECT words, min(place) AS place, count(*) AS n FROM long GROUP BY words),
edited AS (SELECT * FROM texts WHERE len(words) >= {MIN_WORDS}),
gaps AS (SELECT words, place, unnest(range(1, len(words) + 1)) AS i FROM edited),
less AS (SELECT words, place, i, list_concat(words[1:i - 1], words[i + 1:]) AS rest FROM gaps),
pairs AS (
  SELECT words, min(other) AS other FROM (
    SELECT words, place, min(place) OVER (PARTITION BY i, rest) AS other FROM less
    UNION ALL SELECT l.words, l.place, t.place FROM less l JOIN edited t ON l.rest = t.words
    UNION ALL SELECT t.words, t.place, l.place FROM less l JOIN edited t ON l.rest = t.words)
  WHERE other < place GROUP BY words)
SELECT g.doc_id, g.line_no, k.doc_id AS kept_doc_id, k.line_no AS kept_line_no, (p.other IS NOT NULL)::INT AS edits
FROM long g JOIN texts t ON g.words = t.words LEFT JOIN pairs p ON g.words = p.words
JOIN long k ON k.place = coalesce(p.other, t.place)
WHERE p.other IS NOT NULL OR g.place > t.place
"""


@query("op9_line_dedup", SQL)
def op9_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicate_lines(table(spark, sf_dir, "documents"))
