"""Labelled corpora and plain documents from files."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from claimweave.functions import text as T
from claimweave.operators.features import source_credibility
from claimweave.scale import cut_lineage
from claimweave.sources.quoted_csv import read_quoted_csv

LIAR_SCHEMA = (
    "id string, label string, statement string, subject string, speaker string, job_title string, "
    "state_info string, party_affiliation string, barely_true_counts double, false_counts double, "
    "half_true_counts double, mostly_true_counts double, pants_on_fire_counts double, context string"
)
CORPUS_COLUMNS = [
    "id", "title", "text", "label", "source", "context_info", "subject", "dataset_source",
    "source_credibility", "political_affiliation",
]


def liar_corpus(raw: DataFrame) -> DataFrame:
    """Common columns of fact-check rows (see ``LIAR_SCHEMA``)."""
    named = raw.withColumnsRenamed({"statement": "text", "context": "context_info", "speaker": "source"})
    credibility = source_credibility(
        "mostly_true_counts", "half_true_counts", "false_counts", "barely_true_counts", "pants_on_fire_counts"
    )
    return named.withColumns(
        {
            "dataset_source": F.lit("liar"),
            "title": F.lit(""),
            "source_credibility": credibility,
            "political_affiliation": F.coalesce("party_affiliation", F.lit("")),
        }
    ).select(*CORPUS_COLUMNS)


def read_liar(spark: SparkSession, path: str) -> DataFrame:
    files = [f"{path}/{name}.tsv" for name in ("train", "valid", "test")]
    return liar_corpus(spark.read.csv(files, sep="\t", schema=LIAR_SCHEMA, quote='"', escape='"'))


def isot_corpus(raw: DataFrame, key: Column | None = None) -> DataFrame:
    """Common columns of labelled articles.

    The id is a digest of title and text followed by ``key``, which tells copies apart; without a key
    it is the row's position in its partition of the input, which is fixed by writing the rows first.
    """
    if key is None:
        raw = cut_lineage(raw.withColumn("_position", F.monotonically_increasing_id()))
    key = F.col("_position") if key is None else key
    renames = {}
    for target, other in (("text", "content"), ("title", "headline")):
        if target not in raw.columns and other in raw.columns:
            renames[other] = target
    df = raw.withColumnsRenamed(renames)
    for c in ("title", "text", "subject"):
        if c not in df.columns:
            df = df.withColumn(c, F.lit(""))
    df = df.withColumn("subject", F.coalesce("subject", F.lit("")))
    if "source" not in df.columns:
        df = df.withColumn("source", F.col("subject"))
    return df.withColumns(
        {
            "id": F.concat(F.md5(F.concat(T.text_of("title"), F.lit("‖"), T.text_of("text"))), F.lit("-"), key.cast("string")),
            "dataset_source": F.lit("isot"),
            "context_info": F.lit(""),
            "source_credibility": F.lit(0.5),
            "political_affiliation": F.lit(""),
        }
    ).select(*CORPUS_COLUMNS)


def read_isot(spark: SparkSession, path: str) -> DataFrame:
    """The two files (or folders of files) of articles.

    A quoted text may hold line ends; a file is cut by byte ranges all the same.  The id ends with the file's name and the
    byte the article begins at, so it is the same however the file is cut.
    """

    def one(name: str, label: str) -> DataFrame:
        return read_quoted_csv(spark, f"{path}/{name}.csv").withColumn("label", F.lit(label))

    both = one("Fake", "fake").unionByName(one("True", "real"), allowMissingColumns=True)
    return isot_corpus(both, F.concat("_file", F.lit(":"), "_offset"))


def combine_corpora(*corpora: DataFrame) -> DataFrame:
    out = corpora[0]
    for other in corpora[1:]:
        out = out.unionByName(other)
    return out


def corpus_sizes(corpus: DataFrame) -> DataFrame:
    return corpus.groupBy("dataset_source").agg(F.count(F.lit(1)).alias("n"))


def preprocess_corpus(corpus: DataFrame) -> DataFrame:
    """Adds clean_title, clean_text, clean_text_no_stops (texts over 50 words only) and combined_text."""
    out = corpus.withColumns(
        {"clean_title": T.preprocess_text("title"), "clean_text": T.preprocess_text("text")}
    )
    long = F.size(T.words("clean_text")) > 50
    return out.withColumns(
        {
            "clean_text_no_stops": F.when(long, T.remove_stopwords("clean_text")),
            "combined_text": F.concat(F.col("clean_title"), F.lit(" "), F.col("clean_text")),
        }
    )


def read_text_documents(spark: SparkSession, path: str, claim: str = "") -> DataFrame:
    """Whole text files with an optional claim on top and a preview of 1000 characters."""
    docs = spark.read.text(path, wholetext=True).withColumn("path", F.input_file_name())
    content = F.concat(F.lit(claim + "\n"), F.col("value")) if claim else F.col("value")
    out = docs.select("path", content.alias("content"))
    return out.withColumn("preview", T.truncate("content", 1000))
