"""Lexicon tables (category, term) and publisher lists (leaning, name, ord)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from claimweave.functions import fixed_values as fixed
from claimweave.scale import contains_join

LEXICON_SCHEMA = "category string, term string"
SOURCES_SCHEMA = "leaning string, name string, ord long"
JSON_SCHEMA = (
    "political_terms string, "
    "media_bias_sources struct<left_leaning:array<string>, right_leaning:array<string>, center:array<string>>, "
    "positive_words array<string>, negative_words array<string>, subjective_words array<string>, "
    "exaggeration_words array<string>, hedging_words array<string>, loaded_phrases array<string>, "
    "clickbait_phrases array<string>, conspiracy_terms array<string>"
)
JSON_CATEGORIES = {
    "positive_words": "positive",
    "negative_words": "negative",
    "subjective_words": "subjective",
    "exaggeration_words": "exaggeration",
    "hedging_words": "hedging",
    "loaded_phrases": "loaded",
    "clickbait_phrases": "clickbait",
    "conspiracy_terms": "conspiracy",
}


def _table(spark: SparkSession, lists: dict[str, list[str]]) -> DataFrame:
    rows = [(category, term) for category, terms in lists.items() for term in dict.fromkeys(terms)]
    return spark.createDataFrame(rows, LEXICON_SCHEMA)


def default_lexicon(spark: SparkSession) -> DataFrame:
    return _table(
        spark,
        {
            "left": fixed.LEFT_TERMS,
            "right": fixed.RIGHT_TERMS,
            "positive": fixed.POSITIVE_WORDS,
            "negative": fixed.NEGATIVE_WORDS,
            "subjective": fixed.SUBJECTIVE_WORDS,
            "exaggeration": fixed.EXAGGERATION_WORDS,
            "hedging": fixed.HEDGING_WORDS,
            "loaded": fixed.LOADED_PHRASES,
            "clickbait": fixed.CLICKBAIT_PHRASES,
        },
    )


def training_lexicon(spark: SparkSession) -> DataFrame:
    return _table(
        spark,
        {
            "positive": fixed.TRAIN_POSITIVE,
            "negative": fixed.TRAIN_NEGATIVE,
            "subjective": fixed.TRAIN_SUBJECTIVE,
            "clickbait": fixed.TRAIN_CLICKBAIT,
            "emotional": fixed.TRAIN_EMOTIONAL,
            "exaggeration": fixed.TRAIN_EXAGGERATION,
        },
    )


def no_sources(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([], SOURCES_SCHEMA)


def merge_lexicons(*lexicons: DataFrame) -> DataFrame:
    """Set union per category."""
    out = lexicons[0].select("category", "term")
    for other in lexicons[1:]:
        out = out.unionByName(other.select("category", "term"))
    return out.distinct()


def lexicon_stats(lexicon: DataFrame) -> DataFrame:
    return lexicon.groupBy("category").agg(F.count_distinct("term").alias("n_terms"))


def parse_mpqa(lines: DataFrame, line_col: str = "value") -> DataFrame:
    """Clue lines of key=value pairs to lexicon rows; comments and blank lines are skipped."""
    rows = lines.filter(~F.col(line_col).startswith("#") & (F.trim(line_col) != ""))

    def value(key: str):
        found = F.regexp_extract(line_col, rf"(?:^|\s){key}=(\S*)", 1)
        present = F.col(line_col).rlike(rf"(?:^|\s){key}=")
        return F.when(present, found)

    parsed = rows.select(
        F.lower(value("word1")).alias("term"), value("priorpolarity").alias("polarity"), value("type").alias("strength")
    ).filter(F.col("term").isNotNull() & F.col("polarity").isNotNull() & F.col("strength").isNotNull())
    categories = F.array_compact(
        F.array(
            F.when(F.col("strength").isin("strongsubj", "weaksubj"), "subjective"),
            F.when(F.col("polarity").isin("positive", "both"), "positive"),
            F.when(F.col("polarity").isin("negative", "both"), "negative"),
        )
    )
    return parsed.select(F.explode(categories).alias("category"), "term").distinct()


def read_mpqa(spark: SparkSession, path: str) -> DataFrame:
    return parse_mpqa(spark.read.text(path))


def read_lexicon_json(spark: SparkSession, path: str, base: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    """Lexicon and publisher tables of one JSON file.

    ``political_terms`` is an object of left and right lists, or a plain list whose terms are put
    on the side of ``base`` (by default the built-in lists) they match more often.
    """
    base = default_lexicon(spark) if base is None else base
    raw = spark.read.json(path, schema=JSON_SCHEMA, multiLine=True)
    flat = F.array(
        *[F.struct(F.lit(name).alias("category"), F.col(key).alias("terms")) for key, name in JSON_CATEGORIES.items()]
    )
    plain = raw.select(F.inline(flat)).select("category", F.explode("terms").alias("term"))
    sides = raw.select(F.from_json("political_terms", "left array<string>, right array<string>").alias("s"))
    both = F.array(*[F.struct(F.lit(x).alias("category"), F.col(f"s.{x}").alias("terms")) for x in ("left", "right")])
    political = sides.select(F.inline(both)).select("category", F.explode("terms").alias("term"))
    legacy = raw.filter(F.ltrim("political_terms").startswith("["))
    legacy = legacy.select(F.explode(F.from_json("political_terms", "array<string>")).alias("term"))
    lexicon = plain.unionByName(political).unionByName(categorize_terms(legacy, base))
    return lexicon.distinct(), _publishers(raw)


def _publishers(raw: DataFrame) -> DataFrame:
    lists = F.array(
        *[
            F.struct(F.lit(i).alias("side"), F.lit(leaning).alias("leaning"), F.col(f"media_bias_sources.{key}").alias("names"))
            for i, (key, leaning) in enumerate(
                (("left_leaning", "left"), ("right_leaning", "right"), ("center", "center"))
            )
        ]
    )
    rows = raw.select(F.inline(lists)).select("side", "leaning", F.posexplode("names").alias("pos", "name"))
    return rows.select("leaning", "name", (F.col("side") * 1_000_000 + F.col("pos")).cast("long").alias("ord"))


def categorize_terms(terms: DataFrame, lexicon: DataFrame) -> DataFrame:
    """Puts unlabelled political terms on the side with more substring matches; a tie drops the term."""
    wanted = terms.select("term").distinct()
    known = lexicon.filter(F.col("category").isin("left", "right")).select("category", F.col("term").alias("known")).distinct()
    inside = contains_join(wanted, known, "term", "known")
    around = contains_join(known, wanted, "known", "term").select(*inside.columns)
    matches = inside.unionByName(around).distinct()
    counts = matches.groupBy("term").agg(
        F.count_if(F.col("category") == "left").alias("l"), F.count_if(F.col("category") == "right").alias("r")
    )
    side = F.when(F.col("l") > F.col("r"), "left").when(F.col("r") > F.col("l"), "right")
    return counts.select(side.alias("category"), "term").filter(F.col("category").isNotNull())
