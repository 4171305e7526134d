"""Document fingerprints of closed syncmers, with DataFrame operations only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from claimweave.llm.common import query, stored, table

#: Words in a k-mer and in its inner substrings; anchors that the further column ``sketch`` shows.
K, S, KEPT = 4, 2, 64


def _but(c: Column | str, skip: int, drop: int) -> Column:
    """An array less its first ``skip`` and last ``drop`` entries."""
    return F.slice(c, F.lit(skip + 1), F.greatest(F.size(c) - (skip + drop), F.lit(0)))


def with_pairs(df: DataFrame, text: str, out: str) -> DataFrame:
    """Adds the hashes of the inner substrings (two words each) of a text; shorter texts give their words."""
    words = F.filter(F.split(text, r"[\t-\r ]+"), lambda w: w != "")
    hashed = df.withColumn(out, F.transform(words, lambda w: F.xxhash64(w)))
    pairs = F.zip_with(_but(out, 0, 1), _but(out, 1, 0), lambda a, b: F.xxhash64(a, b))
    return hashed.withColumn(out, F.when(F.size(out) < K, F.col(out)).otherwise(pairs))


def _kmers(pairs: str) -> Column:
    """The hash of each k-mer in order, null where it is no closed syncmer; a text of fewer words gives its words' hash."""
    edges = F.zip_with(_but(pairs, 0, 2), _but(pairs, 2, 0), lambda a, c: F.struct(a.alias("a"), c.alias("c")))
    kmers = F.zip_with(edges, _but(pairs, 1, 1), lambda e, b: F.when(b >= F.least(e["a"], e["c"]), F.xxhash64(e["a"], e["c"])))
    return F.when(F.size(pairs) < K - S + 1, F.when(F.size(pairs) > 0, F.array(F.xxhash64(pairs))).otherwise(F.array().cast("array<bigint>"))).otherwise(kmers)


def anchors(pairs: str) -> Column:
    """The closed syncmers among the k-mers: those whose smallest inner substring is the first or the last.

    Whether a k-mer is chosen depends on its own words alone, so equal passages give equal anchors
    wherever they stand.  Of three inner hashes the middle one must not be the strict minimum.  A text
    of fewer words than a k-mer has one anchor, all its words; an empty one has none.
    """
    return F.array_compact(_kmers(pairs))


def with_marks(df: DataFrame, text: str, out: str) -> DataFrame:
    """Adds all anchors of the whole text in order, as structs (h, at) of hash and word position, and their links in ``<out>_links``.

    A text with words but no closed syncmer, which four words may be, has one anchor, all its words.
    A link is the hash of two anchors that follow each other and of the words between their starts.
    """
    kmers = with_pairs(df, text, "_inner").withColumn("_kmers", _kmers("_inner"))
    placed = F.transform("_kmers", lambda h, i: F.when(h.isNotNull(), F.struct(h.alias("h"), i.alias("at"))))
    whole = F.array(F.struct(F.xxhash64("_inner").alias("h"), F.lit(0).alias("at")))
    marked = kmers.withColumn("_marks", F.array_compact(placed))
    marked = marked.withColumn(out, F.when((F.size("_marks") == 0) & (F.size("_inner") > 0), whole).otherwise(F.col("_marks")))
    links = F.zip_with(_but(out, 0, 1), _but(out, 1, 0), lambda a, b: F.xxhash64(a["h"], b["h"], b["at"] - a["at"]))
    return marked.withColumn(f"{out}_links", links).drop("_inner", "_kmers", "_marks")


def shared_part(a: Column, b: Column) -> Column:
    """Jaccard likeness of two arrays as sets, from all their entries; two empty ones are alike."""
    union = F.size(F.array_union(a, b))
    return F.when(union == 0, F.lit(1.0)).otherwise(F.size(F.array_intersect(a, b)) / union)


def likeness(a: str, b: str) -> Column:
    """Exact Jaccard likeness of two texts' anchors."""
    return shared_part(F.col(a)["h"], F.col(b)["h"])


def placed_likeness(a: str, b: str) -> Column:
    """Likeness by position: of the links between anchors, the part that both texts have, at whatever offset.

    Texts of one anchor at most have no link and go by their anchors.
    """
    one, two = f"{a}_links", f"{b}_links"
    return F.when((F.size(one) == 0) & (F.size(two) == 0), likeness(a, b)).otherwise(shared_part(F.col(one), F.col(two)))


def printed(marks: str) -> Column:
    """SHA-256 over all anchors and their positions; the empty text for no anchor."""
    every = F.array_join(F.transform(marks, lambda m: F.concat_ws("@", m["h"].cast("string"), m["at"].cast("string"))), ",")
    return F.when(F.size(marks) == 0, F.lit("")).otherwise(F.sha2(every, 256))


def sketch(marks: str) -> Column:
    """The ``KEPT`` smallest distinct anchors as text, 16 hexadecimal digits each; nothing else is computed from it."""
    least = F.slice(F.array_sort(F.array_distinct(F.col(marks)["h"])), 1, KEPT)
    return F.array_join(F.transform(least, lambda h: F.lpad(F.lower(F.hex(h)), 16, "0")), "")


def _blocks(ids: DataFrame, parts: int) -> DataFrame:
    """(block, top, above) for ranges of ids with about as many rows each: the largest id in it and the block above it.

    Ids are cut into equally wide ranges first and each of these by its number of rows, so
    clustered ids are cut finer; there are at most twice 16 ``parts`` blocks, the bound of this table.
    The block above the highest one is the lowest one.
    """
    return (
        ids.groupBy("block").agg(F.max("id").alias("top"))
        .selectExpr("block", "top", "coalesce(lag(block) OVER (ORDER BY top DESC), last(block) OVER (ORDER BY top DESC ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING)) AS above")
    )


def with_next(docs: DataFrame, columns: list[str], id_col: str = "id") -> DataFrame:
    """Adds ``next_<column>``: the values of the next row in (id descending, text) order, after the last those of the first.

    Rows are dealt out by block, and the rows of a block's largest id are sent to the block above it as
    well, so each row finds its successor in its own block and moves once.  A null id
    comes last.  ``docs`` has ``id_col`` and ``text``.
    """
    parts = 16 * int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    span = docs.agg(F.min(id_col).cast("long"), F.max(id_col).cast("long"), F.count(F.lit(1))).first()
    low, high, rows = (span[0] or 0) - 1, span[1] or 0, span[2]
    wide = max(1, -(-(high - low + 1) // parts))
    order = F.coalesce(F.col(id_col).cast("long"), F.lit(low))
    coarse = F.expr(f"(coalesce(cast({id_col} as bigint), {low}) - {low}) div {wide}")
    counts = docs.groupBy(coarse.alias("coarse")).agg(F.count(F.lit(1)).alias("n"))
    per = max(1, -(-rows // parts))
    cuts = stored(counts.select("coarse", F.greatest(F.lit(1), F.floor(F.lit(wide) * per / F.col("n"))).cast("long").alias("fine")))
    # at most ``parts`` rows
    placed = docs.withColumn("coarse", coarse).join(F.broadcast(cuts), "coarse")
    fine = F.expr(f"(coalesce(cast({id_col} as bigint), {low}) - {low} - coarse * {wide}) div fine")
    placed = placed.withColumn("block", F.struct("coarse", fine.alias("fine")))
    tops = stored(_blocks(placed.select("block", order.alias("id")), parts))
    sent = placed.join(F.broadcast(tops), "block")
    guest = F.when(order == F.col("top"), F.array(F.struct(F.col("above").alias("block"), F.lit(1).alias("guest"))))
    places = F.concat(F.array(F.struct("block", F.lit(0).alias("guest"))), F.coalesce(guest, F.array().cast("array<struct<block: struct<coarse: bigint, fine: bigint>, guest: int>>")))
    dealt = sent.select(id_col, *columns, order.alias("_order"), F.explode(places).alias("_at"))
    window = "OVER (PARTITION BY _at.block ORDER BY _at.guest, _order DESC, text)"
    led = dealt.selectExpr(id_col, *columns, "_at.guest AS _guest", *[f"lead({c}) {window} AS next_{c}" for c in columns])
    return led.filter("_guest = 0").drop("_guest")


def edited_pairs(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next, placed_edited, placed_next,
    sketch, edited_sketch), a row for each row.

    Fingerprints and likeness are over all closed syncmers of the whole texts; ``placed`` counts those that keep
    their distance to the next one.
    The edited text has the last third (rounded down) of the code points replaced by as many from the
    start of the next document in descending id order, or by all of it where it is shorter.
    A null text counts as empty.  Ids are integers; rows that share one follow each other in the order of
    their texts, a null id comes last, and after the last row comes the first, so a single row is its own
    neighbour.  No rows give no rows; further columns are ignored.
    """
    slim = docs.select(F.col(id_col).alias("id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    # texts move alone: anchors of both sides are made after the exchange
    led = with_next(slim, ["text"])
    n = F.length("text")
    third = F.floor(n / 3).cast("int")
    edited = F.concat(F.substring("text", F.lit(1), n - third), F.substring("next_text", F.lit(1), third))
    led = led.select("id", "text", "next_text", n.cast("long").alias("n_chars"), edited.alias("edited"))
    out = with_marks(with_marks(with_marks(led, "text", "mine"), "next_text", "next"), "edited", "theirs")
    return out.select(
        F.col("id").alias(id_col), "n_chars", F.sha2("edited", 256).alias("edited_sha256"),
        printed("mine").alias("fingerprint"), printed("theirs").alias("edited_fingerprint"),
        likeness("mine", "theirs").alias("near_edited"), likeness("mine", "next").alias("near_next"),
        placed_likeness("mine", "theirs").alias("placed_edited"), placed_likeness("mine", "next").alias("placed_next"),
        sketch("mine").alias("sketch"), sketch("theirs").alias("edited_sketch"),
    )


@query("op5_closed_syncmers")
def op5_closed_syncmers(spark: SparkSession, sf_dir: str) -> DataFrame:
    return edited_pairs(table(spark, sf_dir, "documents"))
