import random

import corpus_pipeline
from llm_helpers import documents, first_of_groups, prose
from pyspark.sql import functions as F

from claimweave.llm.decontamination import contaminated, drop_contaminated
from claimweave.llm.toxicity import drop_toxic, scores, train


def fixture(spark, folder):
    """Clean texts, toxic ones, exact and near copies, repeated lines, leaks, null and empty texts."""
    rng = random.Random(21)
    line = lambda n=25: " ".join(prose(rng, n, 5000))
    items = [line(30) for _ in range(5)]
    texts, kinds, labels = [], [], []
    for i in range(400):
        text, kind = "\n".join(line() for _ in range(4)), "clean"
        if i % 8 == 1:
            words = text.split(" ")
            for _ in range(6):
                words.insert(rng.randrange(len(words)), rng.choice(["zork", "bliff", "quamp"]))
            text, kind = " ".join(words), "toxic"
        elif i % 25 == 2 and i > 25:
            text, kind = texts[kinds.index("clean")], "copy"
        elif i % 25 == 3:
            text, kind = text + "\n" + items[i % 5], "leak"
        elif i % 25 == 4:
            text, kind = text + "\nthis notice stands under every single page", "notice"
        texts.append(text)
        kinds.append(kind)
        labels.append((i, 1, int(kind == "toxic")))
    texts += [None, ""]
    kinds += ["empty", "empty"]
    documents(spark, texts).write.parquet(f"{folder}/documents.parquet")
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{folder}/labels.parquet")
    spark.createDataFrame(list(enumerate(items)), "item_id long, text string").write.parquet(f"{folder}/benchmark.parquet")
    return kinds


def test_every_stage_takes_effect_and_clean_documents_stay(spark, tmp_path):
    folder = str(tmp_path)
    kinds = fixture(spark, folder)
    docs, seen = spark.read.parquet(f"{folder}/documents.parquet"), []
    columns = docs.columns
    clean = {i for i, k in enumerate(kinds) if k == "clean"}
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, docs, folder)
        assert out.columns == columns and dict(out.dtypes) == dict(docs.dtypes)
        out.write.parquet(f"{folder}/{name}")
        docs = spark.read.parquet(f"{folder}/{name}")
        seen.append({r.doc_id: r.text for r in docs.collect()})
        assert len(seen[-1]) == docs.count() and clean <= set(seen[-1])
    toxic, lines, near, leaks = seen
    of = lambda kind: {i for i, k in enumerate(kinds) if k == kind}
    assert not of("toxic") & set(toxic)
    assert not of("copy") & set(lines)
    notices = [i for i in sorted(of("notice")) if "this notice" in lines[i]]
    assert notices == [min(of("notice"))]
    assert all("\n" not in t or t.split("\n") for t in lines.values() if t)
    assert len(of("empty") & set(near)) == 1
    # a test item is itself a line that repeats, so line de-duplication leaves the first leak of each
    assert not any(i in leaks for i in of("leak") if lines[i].count("\n") == 4)
    packed = corpus_pipeline.STAGES[-1][1](spark, docs, folder).collect()
    assert {r.doc_id for r in packed} == set(leaks)
    whole = corpus_pipeline.run(spark, folder).collect()
    assert sorted((r.doc_id, r.piece, r.length, r.ids_crc32) for r in whole) == sorted((r.doc_id, r.piece, r.length, r.ids_crc32) for r in packed)


def test_stages_keep_what_their_operators_say(spark):
    sf = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    ids = lambda df: {r.doc_id for r in df.select("doc_id").collect()}
    every, stages = ids(docs), dict(corpus_pipeline.STAGES)
    labels, items = (spark.read.parquet(f"{sf}/{t}.parquet") for t in ("labels", "benchmark"))
    assert ids(stages["toxicity"](spark, docs, sf)) == every - ids(scores(docs, train(docs, labels)).filter("predicted = 1"))
    assert ids(stages["decontamination"](spark, docs, sf)) == every - ids(contaminated(docs, items))
    texts = [(r.doc_id, r.text) for r in docs.collect()]
    assert ids(stages["near_duplicates"](spark, docs, sf)) == first_of_groups(texts)


def test_rows_that_share_an_id_or_have_none_go_by_their_texts(spark, tmp_path):
    fixture(spark, str(tmp_path))
    docs = spark.read.parquet(f"{tmp_path}/documents.parquet")
    labels, items = (spark.read.parquet(f"{tmp_path}/{t}.parquet") for t in ("labels", "benchmark"))
    leak = items.first().text
    rng = random.Random(5)
    words = prose(rng, 60, 5000)
    toxic = " ".join([*words, *["zork", "bliff", "quamp"] * 4])
    more = spark.createDataFrame([(i, t) for i in (None, 9000) for t in (" ".join(words), toxic, leak)], "doc_id long, text string")
    every = docs.unionByName(more, allowMissingColumns=True)
    texts = lambda df: sorted((str(r.doc_id), r.text) for r in df.filter("doc_id IS NULL OR doc_id = 9000").collect())
    assert texts(drop_toxic(every, labels)) == sorted((i, t) for i in ("None", "9000") for t in (" ".join(words), leak))
    assert texts(drop_contaminated(every, items)) == sorted((i, t) for i in ("None", "9000") for t in (" ".join(words), toxic))


def test_no_documents(spark, tmp_path):
    docs = documents(spark, ["one"]).filter(F.lit(False))
    for name, empty in (("documents", docs), ("labels", spark.createDataFrame([], "doc_id long, quality int, toxic int")), ("benchmark", spark.createDataFrame([], "item_id long, text string"))):
        empty.write.parquet(f"{tmp_path}/{name}.parquet")
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0
