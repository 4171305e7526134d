"""Corpora, labels, splits, class balance, TF-IDF and evaluation."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from claimweave.catalog.base import WORD, query, rounded, sql_ratio, sql_words, strings, table, with_ctes
from claimweave.operators import metrics as M
from claimweave.operators import sampling as S
from claimweave.operators import tfidf as V
from claimweave.scale import shared_folder
from claimweave.sources import corpora
from claimweave.sources.store import validate_feature_store

LIAR = ["pants-fire", "false", "barely-true", "half-true", "mostly-true", "true", "other"]

# All documents as fact-check rows, and all once more as labelled articles; copies differ by their key.
LIAR_CTE = f"""
liar AS (
  SELECT doc_id::VARCHAR AS id, '' AS title, text, {strings(LIAR)}[doc_id % 7 + 1] AS label, source, lang AS context_info, 'politics' AS subject,
    'liar' AS dataset_source, (doc_id % 11 + doc_id % 5) / greatest(doc_id % 11 + doc_id % 5 + doc_id % 3 + doc_id % 2 + doc_id % 4, 1)::DOUBLE AS source_credibility,
    CASE WHEN doc_id % 4 = 0 THEN '' ELSE 'party' || doc_id % 4 END AS political_affiliation FROM documents)
"""
ISOT_CTE = """
isot AS (
  SELECT md5(split_part(text, chr(10), 1) || '‖' || text) || '-' || doc_id AS id, split_part(text, chr(10), 1) AS title, text,
    CASE WHEN doc_id % 3 = 0 THEN 'fake' ELSE 'real' END AS label, CASE WHEN doc_id % 5 = 0 THEN '' ELSE lang END AS source, '' AS context_info,
    CASE WHEN doc_id % 5 = 0 THEN '' ELSE lang END AS subject, 'isot' AS dataset_source, 0.5::DOUBLE AS source_credibility, '' AS political_affiliation
  FROM documents)
"""
CORPUS_CTE = f"""
{LIAR_CTE.strip()},
{ISOT_CTE.strip()},
corpus AS (SELECT * FROM liar UNION ALL SELECT * FROM isot),
labelled AS (
  SELECT *, (coalesce(CASE WHEN dataset_source = 'liar' THEN CASE label WHEN 'pants-fire' THEN 0 WHEN 'false' THEN 0 WHEN 'barely-true' THEN 0.25
        WHEN 'half-true' THEN 0.5 WHEN 'mostly-true' THEN 0.75 WHEN 'true' THEN 1 END END,
      CASE label WHEN 'fake' THEN 0 WHEN 'false' THEN 0 WHEN 'pants-fire' THEN 0 WHEN 'barely-true' THEN 0 WHEN 'half-true' THEN 0.5
        WHEN 'mostly-true' THEN 1 WHEN 'true' THEN 1 WHEN 'real' THEN 1 END, 0.5) >= 0.5)::INT AS binary_label FROM corpus)
"""


def _mod(n: int):
    return F.pmod("doc_id", F.lit(n))


def liar_rows(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    label = F.get(F.array(*[F.lit(x) for x in LIAR]), _mod(7).cast("int"))
    party = F.when(_mod(4) != 0, F.concat(F.lit("party"), _mod(4).cast("string")))
    raw = docs.select(
        F.col("doc_id").cast("string").alias("id"), label.alias("label"), F.col("text").alias("statement"), F.lit("politics").alias("subject"),
        F.col("source").alias("speaker"), F.lit("").alias("job_title"), F.lit("").alias("state_info"), party.alias("party_affiliation"),
        _mod(3).cast("double").alias("barely_true_counts"), _mod(2).cast("double").alias("false_counts"), _mod(5).cast("double").alias("half_true_counts"),
        _mod(11).cast("double").alias("mostly_true_counts"), _mod(4).cast("double").alias("pants_on_fire_counts"), F.col("lang").alias("context"),
    )
    return corpora.liar_corpus(raw)


def isot_rows(spark, sf_dir):
    raw = table(spark, sf_dir, "documents").select(
        "doc_id", F.substring_index("text", "\n", 1).alias("headline"), F.col("text").alias("content"),
        F.when(_mod(5) != 0, F.col("lang")).alias("subject"), F.when(_mod(3) == 0, "fake").otherwise("real").alias("label"),
    )
    return corpora.isot_corpus(raw, F.col("doc_id"))


def corpus(spark, sf_dir):
    return corpora.combine_corpora(liar_rows(spark, sf_dir), isot_rows(spark, sf_dir))


def labelled(spark, sf_dir):
    return S.standardize_labels(corpus(spark, sf_dir))


COLUMNS = "id, title, md5(text) AS text, label, source, context_info, subject, dataset_source, round(source_credibility, 6) AS source_credibility, political_affiliation"


@query("liar_corpus", with_ctes(LIAR_CTE) + f" SELECT {COLUMNS} FROM liar")
def liar_corpus(spark, sf_dir):
    return rounded(liar_rows(spark, sf_dir).withColumn("text", F.md5("text")))


@query("isot_corpus", with_ctes(ISOT_CTE) + f" SELECT {COLUMNS} FROM isot")
def isot_corpus(spark, sf_dir):
    return rounded(isot_rows(spark, sf_dir).withColumn("text", F.md5("text")))


@query(
    "read_isot",
    with_ctes(ISOT_CTE)
    + f" SELECT {COLUMNS.removeprefix('id, ')} FROM isot",
)
def read_isot(spark, sf_dir):
    """All documents written as the two quoted files, then read back."""
    folder = f"{shared_folder(spark)}/isot-{uuid.uuid4().hex}"
    docs = table(spark, sf_dir, "documents").select(
        F.substring_index("text", "\n", 1).alias("headline"), F.col("text").alias("content"), F.when(_mod(5) != 0, F.col("lang")).alias("subject"), (_mod(3) == 0).alias("_fake")
    )
    for name, part in (("Fake", F.col("_fake")), ("True", ~F.col("_fake"))):
        docs.filter(part).drop("_fake").write.csv(f"{folder}/{name}.csv", header=True, quoteAll=True, escape='"')
    read = corpora.read_isot(spark, folder).withColumn("text", F.md5("text"))
    return rounded(read.drop("id"))


@query("combine_corpora", with_ctes(CORPUS_CTE) + f" SELECT {COLUMNS} FROM corpus")
def combine_corpora(spark, sf_dir):
    return rounded(corpus(spark, sf_dir).withColumn("text", F.md5("text")))


@query("dataset_counts", with_ctes(CORPUS_CTE) + " SELECT dataset_source, count(*) AS n FROM corpus GROUP BY dataset_source")
def dataset_counts(spark, sf_dir):
    return corpora.corpus_sizes(corpus(spark, sf_dir))


@query("source_counts", with_ctes(CORPUS_CTE) + " SELECT source, count(*) AS n FROM corpus GROUP BY source ORDER BY n DESC, source LIMIT 5")
def source_counts(spark, sf_dir):
    return S.label_counts(corpus(spark, sf_dir), "source", 5)


@query("label_counts", with_ctes(CORPUS_CTE) + " SELECT binary_label, count(*) AS n FROM labelled GROUP BY binary_label")
def label_counts(spark, sf_dir):
    return S.label_counts(labelled(spark, sf_dir), "binary_label")


@query("standardize_labels", with_ctes(CORPUS_CTE) + " SELECT id, dataset_source, label AS fine_grained_label, binary_label FROM labelled")
def standardize_labels(spark, sf_dir):
    return labelled(spark, sf_dir).select("id", "dataset_source", "fine_grained_label", "binary_label")


@query(
    "class_balance",
    """SELECT n0, n1, greatest(n0, n1) AS target_count, CASE WHEN n0 < n1 THEN 0 ELSE 1 END AS minority_class FROM (
      SELECT count(*) FILTER (quality = 0) AS n0, count(*) FILTER (quality = 1) AS n1 FROM labels)""",
)
def class_balance(spark, sf_dir):
    return S.class_balance(table(spark, sf_dir, "labels"), "quality")


SPLIT_CTE = """
split AS (
  SELECT doc_id, quality, CASE WHEN share <= 0.7::DOUBLE THEN 'train' WHEN share <= 0.7::DOUBLE + 0.15::DOUBLE THEN 'val' ELSE 'test' END AS split FROM (
    SELECT doc_id, quality, row_number() OVER (PARTITION BY quality ORDER BY md5('42|' || doc_id), doc_id) / (count(*) OVER (PARTITION BY quality))::DOUBLE AS share
    FROM labels))
"""


@query("stratified_split", with_ctes(SPLIT_CTE) + " SELECT doc_id, quality, split FROM split")
def stratified_split(spark, sf_dir):
    return S.stratified_split(table(spark, sf_dir, "labels"), "doc_id", "quality").select("doc_id", "quality", "split")


@query(
    "augment_minority",
    f"""WITH low AS (SELECT doc_id, text FROM documents JOIN labels USING (doc_id) WHERE quality = 0),
    w AS (SELECT doc_id, unnest(ws) AS w, generate_subscripts(ws, 1) - 1 AS pos, len(ws) AS n FROM (SELECT doc_id, {sql_words('text')} AS ws FROM low) WHERE len(ws) > 10),
    r AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY md5('42|' || doc_id || '|' || pos), pos) AS k FROM w)
    SELECT doc_id, false AS augmented, md5(text) AS text FROM low
    UNION ALL SELECT doc_id, true, md5(string_agg(w, ' ' ORDER BY pos)) FROM r WHERE k > greatest(1, floor(n * 0.1::DOUBLE)) GROUP BY doc_id""",
)
def augment_minority(spark, sf_dir):
    low = table(spark, sf_dir, "documents").join(table(spark, sf_dir, "labels").filter("quality = 0"), "doc_id")
    out = S.augment_minority(low.select("doc_id", "text"), "doc_id")
    return out.select("doc_id", "augmented", F.md5("text").alias("text"))


@query(
    "oversample_minority",
    """WITH m AS (SELECT doc_id, quality, row_number() OVER (ORDER BY md5('42|' || doc_id), doc_id) - 1 AS i FROM labels WHERE quality = 0),
    d AS (SELECT unnest(range((SELECT count(*) FILTER (quality = 1) - count(*) FILTER (quality = 0) FROM labels))) AS copy_no)
    SELECT doc_id, quality, NULL AS copy_no, false AS oversampled FROM labels
    UNION ALL SELECT doc_id, quality, copy_no, true FROM d JOIN m
      ON i = ('0x' || substr(md5('42|draw|' || copy_no), 1, 12))::BIGINT % (SELECT count(*) FROM m)""",
)
def oversample_minority(spark, sf_dir):
    rows = table(spark, sf_dir, "labels").select("doc_id", "quality")
    return S.oversample_minority(rows, "doc_id", "quality")


# --- TF-IDF -------------------------------------------------------------------------------------
ACCENTED, PLAIN = V.accent_table()
TFIDF_CTE = f"""
tw AS (
  SELECT doc_id, CASE WHEN doc_id % 10 < 7 THEN 'train' WHEN doc_id % 10 < 9 THEN 'val' ELSE 'test' END AS split,
    list_filter(regexp_extract_all(translate(lower(text), '{ACCENTED}', '{PLAIN}'), '{WORD}'), lambda w: length(w) >= 2) AS w FROM documents),
tg AS (
  SELECT doc_id, split, unnest(w || list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1])) AS term FROM tw),
tc AS (SELECT doc_id, split, term, count(*) AS c FROM tg GROUP BY ALL),
nd AS (SELECT count(*) AS n_docs FROM tw WHERE split = 'train'),
vocab AS (
  SELECT term, sum(c)::BIGINT AS tf, count(*) AS df, any_value(n_docs) AS n_docs FROM tc, nd WHERE split = 'train' GROUP BY term
  HAVING count(*) >= 5 AND count(*) <= 0.7::DOUBLE * any_value(n_docs) ORDER BY tf DESC, term LIMIT 5000),
weighted AS (SELECT doc_id, term, c * (ln((1 + n_docs) / (1 + df)::DOUBLE) + 1) AS w FROM tc JOIN vocab USING (term))
"""


def _split_docs(spark, sf_dir):
    turn = _mod(10)
    split = F.when(turn < 7, "train").when(turn < 9, "val").otherwise("test")
    return table(spark, sf_dir, "documents").select("doc_id", "text", split.alias("split"))


@query("document_frequency", with_ctes(TFIDF_CTE) + " SELECT term, tf, df, n_docs FROM vocab")
def document_frequency(spark, sf_dir):
    return V.document_frequency(_split_docs(spark, sf_dir).filter("split = 'train'"))


@query(
    "tfidf",
    with_ctes(TFIDF_CTE)
    + " SELECT doc_id, term, round(w / sqrt(sum(w * w) OVER (PARTITION BY doc_id)), 6) AS tfidf FROM weighted",
)
def tfidf(spark, sf_dir):
    return rounded(V.tfidf(_split_docs(spark, sf_dir), "doc_id", "text"))


CHAIN_CTE = f"""
{ISOT_CTE.strip()},
lab AS (SELECT id, text, (label = 'real')::INT AS binary_label FROM isot),
chain AS (
  SELECT id, CASE WHEN share <= 0.7::DOUBLE THEN 'train' WHEN share <= 0.7::DOUBLE + 0.15::DOUBLE THEN 'val' ELSE 'test' END AS split FROM (
    SELECT id, row_number() OVER (PARTITION BY binary_label ORDER BY md5('42|' || id), id) / (count(*) OVER (PARTITION BY binary_label))::DOUBLE AS share FROM lab)),
tw AS (
  SELECT id AS doc_id, split, list_filter(regexp_extract_all(translate(lower(text), '{ACCENTED}', '{PLAIN}'), '{WORD}'), lambda w: length(w) >= 2) AS w
  FROM lab JOIN chain USING (id)),
{TFIDF_CTE[TFIDF_CTE.index("tg AS"):].strip()},
vectors AS (SELECT doc_id, w / sqrt(sum(w * w) OVER (PARTITION BY doc_id)) AS tfidf FROM weighted)
"""


@query(
    "training_chain",
    with_ctes(CHAIN_CTE)
    + """ SELECT split, count(*) AS n_rows, count(DISTINCT id) AS n_ids, sum(n_terms)::BIGINT AS n_terms, round(sum(squares), 4) AS squares
      FROM chain LEFT JOIN (SELECT doc_id AS id, count(*) AS n_terms, sum(tfidf * tfidf) AS squares FROM vectors GROUP BY doc_id) USING (id) GROUP BY split""",
)
def training_chain(spark, sf_dir):
    """Articles, labels, splits and TF-IDF of all documents, copies included."""
    rows = S.stratified_split(S.standardize_labels(isot_rows(spark, sf_dir)), "id", "binary_label").select("id", "text", "split")
    vectors = V.tfidf(rows, "id", "text")
    sums = vectors.groupBy("id").agg(F.count(F.lit(1)).alias("n_terms"), F.sum(F.col("tfidf") * F.col("tfidf")).alias("squares"))
    out = rows.join(sums, "id", "left").groupBy("split").agg(
        F.count(F.lit(1)).alias("n_rows"), F.count_distinct("id").alias("n_ids"), F.sum("n_terms").alias("n_terms"), F.sum("squares").alias("squares")
    )
    return rounded(out, 4)


# --- evaluation of given probabilities --------------------------------------------------------------
PREDS_CTE = """
preds AS (
  SELECT doc_id, model, CASE WHEN doc_id % 3 = 0 THEN 'val' ELSE 'test' END AS split, quality AS label,
    least(1.0, greatest(0.0, 0.7::DOUBLE * (('0x' || substr(md5(model || doc_id), 1, 3))::INT / 4095.0::DOUBLE) + 0.3::DOUBLE * quality)) AS prob
  FROM labels, (SELECT unnest(['deep', 'wide']) AS model))
"""


def predictions(spark, sf_dir):
    rows = table(spark, sf_dir, "labels").select("doc_id", F.col("quality").alias("label"), F.explode(F.array(F.lit("deep"), F.lit("wide"))).alias("model"))
    digest = F.conv(F.substring(F.md5(F.concat("model", F.col("doc_id").cast("string"))), 1, 3), 16, 10).cast("double") / 4095.0
    prob = F.least(F.lit(1.0), F.greatest(F.lit(0.0), 0.7 * digest + 0.3 * F.col("label")))
    split = F.when(_mod(3) == 0, "val").otherwise("test")
    return rows.select("doc_id", "model", split.alias("split"), "label", prob.alias("prob"))


CELLS = ", ".join(
    f"count(*) FILTER (label = {y} AND (prob > 0.5)::INT = {p}) AS {n}" for y, p, n in ((1, 1, "tp"), (0, 1, "fp"), (0, 0, "tn"), (1, 0, "fn"))
)
METRICS = f"""round({sql_ratio('tp + tn', '(tp + fp + tn + fn)')}, 6) AS accuracy, round({sql_ratio('tp', '(tp + fp)')}, 6) AS precision,
  round({sql_ratio('tp', '(tp + fn)')}, 6) AS recall, round({sql_ratio('2 * tp', '(2 * tp + fp + fn)')}, 6) AS f1"""


@query(
    "classification_metrics",
    with_ctes(PREDS_CTE) + f", c AS (SELECT model, split, {CELLS} FROM preds GROUP BY ALL) SELECT model, split, tp + fp + tn + fn AS n, {METRICS} FROM c",
)
def classification_metrics(spark, sf_dir):
    return rounded(M.classification_metrics(predictions(spark, sf_dir), ["model", "split"]))


@query(
    "confusion_matrix",
    with_ctes(PREDS_CTE)
    + f""", c AS (SELECT model, {CELLS} FROM preds GROUP BY ALL)
    SELECT model, 0 AS label, 0 AS pred, tn AS n FROM c UNION ALL SELECT model, 0, 1, fp FROM c
    UNION ALL SELECT model, 1, 0, fn FROM c UNION ALL SELECT model, 1, 1, tp FROM c""",
)
def confusion_matrix(spark, sf_dir):
    return M.confusion_matrix(predictions(spark, sf_dir), ["model"])


BCE = "avg(-(label * ln(greatest(1e-12, least(1 - 1e-12, prob))) + (1 - label) * ln(1 - greatest(1e-12, least(1 - 1e-12, prob)))))"


@query("bce_loss", with_ctes(PREDS_CTE) + f" SELECT model, split, round({BCE}, 6) AS bce FROM preds GROUP BY ALL")
def bce_loss(spark, sf_dir):
    return rounded(M.bce_loss(predictions(spark, sf_dir), ["model", "split"]))


@query(
    "compare_models",
    with_ctes(PREDS_CTE)
    + f""", c AS (SELECT model, {CELLS}, round({BCE}, 6) AS bce FROM preds GROUP BY model), m AS (SELECT model, {METRICS}, bce FROM c)
    UNPIVOT m ON accuracy, precision, recall, f1, bce INTO NAME metric VALUE value""",
)
def compare_models(spark, sf_dir):
    return rounded(M.compare_models(predictions(spark, sf_dir)))


ROC_CTE = f"""
{PREDS_CTE.strip()},
pts AS (SELECT model, prob AS threshold, sum(label) AS pos, sum(1 - label) AS neg FROM preds GROUP BY model, prob),
cum AS (
  SELECT *, sum(pos) OVER w AS cp, sum(neg) OVER w AS cn, sum(pos) OVER (PARTITION BY model) AS tp, sum(neg) OVER (PARTITION BY model) AS tn
  FROM pts WINDOW w AS (PARTITION BY model ORDER BY threshold DESC))
"""


@query(
    "roc_curve",
    with_ctes(ROC_CTE) + " SELECT model, round(threshold, 6) AS threshold, round(cp / tp::DOUBLE, 6) AS tpr, round(cn / tn::DOUBLE, 6) AS fpr FROM cum",
)
def roc_curve(spark, sf_dir):
    return rounded(M.roc_curve(predictions(spark, sf_dir)).select("model", "threshold", "tpr", "fpr"))


@query(
    "auc",
    with_ctes(ROC_CTE)
    + """, seg AS (SELECT model, cp / tp::DOUBLE AS y, cn / tn::DOUBLE AS x, coalesce(lag(cp / tp::DOUBLE) OVER w, 0) AS y0, coalesce(lag(cn / tn::DOUBLE) OVER w, 0) AS x0
      FROM cum WINDOW w AS (PARTITION BY model ORDER BY threshold DESC))
    SELECT model, round(sum((x - x0) * (y + y0) / 2), 6) AS auc FROM seg GROUP BY model""",
)
def auc(spark, sf_dir):
    return rounded(M.auc(predictions(spark, sf_dir)))


HISTORY_CTE = """
history AS (
  SELECT event_type AS model, day(ts) AS epoch, round(count(*) FILTER (value > 5) / count(*)::DOUBLE, 6) AS val_accuracy FROM events GROUP BY ALL)
"""


def history(spark, sf_dir):
    """Event types as models and days as epochs."""
    days = table(spark, sf_dir, "events").groupBy(F.col("event_type").alias("model"), F.dayofmonth("ts").cast("long").alias("epoch"))
    return rounded(days.agg((F.count_if(F.col("value") > 5) / F.count(F.lit(1))).alias("val_accuracy")))


@query(
    "best_epoch",
    with_ctes(HISTORY_CTE)
    + " SELECT model, arg_max(epoch, {'a': val_accuracy, 'e': -epoch}) AS best_epoch, max(val_accuracy) AS best_accuracy FROM history GROUP BY model",
)
def best_epoch(spark, sf_dir):
    return M.best_epoch(history(spark, sf_dir))


@query(
    "best_so_far",
    with_ctes(HISTORY_CTE)
    + """ SELECT model, epoch, val_accuracy, best_before, val_accuracy > best_before AS is_best FROM (
      SELECT *, coalesce(max(val_accuracy) OVER (PARTITION BY model ORDER BY epoch ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS best_before FROM history)""",
)
def best_so_far(spark, sf_dir):
    return M.best_so_far(history(spark, sf_dir))


@query(
    "validate_feature_store",
    with_ctes(SPLIT_CTE)
    + """ SELECT split, count(*) AS n_rows, count(*) AS n_labels, count(vec_id) AS n_vectors, count(vec_id) = count(*) AS matching
      FROM split LEFT JOIN embeddings ON vec_id = doc_id GROUP BY split""",
)
def validated(spark, sf_dir):
    rows = S.stratified_split(table(spark, sf_dir, "labels"), "doc_id", "quality")
    rows = rows.select(F.col("doc_id").alias("id"), F.col("quality").alias("binary_label"), "split")
    return validate_feature_store(rows, table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("id")))
