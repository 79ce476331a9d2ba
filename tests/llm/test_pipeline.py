"""The corpus pipeline, stage by stage, against the operators' own verdicts."""

from collections import Counter

from pyspark.sql import functions as F

import corpus_pipeline
from weftgraph.llm import mcd, mil, simhash

SF = "/root/testdata/sf0.01"


def test_stages(spark, tmp_path):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    columns, kept = docs.columns, []
    for i, (_, stage) in enumerate(corpus_pipeline.STAGES):
        kept.append(docs)
        stage(spark, docs, SF).write.parquet(f"{tmp_path}/{i}.parquet")
        docs = spark.read.parquet(f"{tmp_path}/{i}.parquet")
        assert docs.count() > 0 and (i == len(corpus_pipeline.STAGES) - 1 or docs.columns == columns)
    ids = lambda df: sorted(r.doc_id for r in df.select("doc_id").collect())
    labels = spark.read.parquet(f"{SF}/labels.parquet")
    assert ids(kept[1]) == sorted(r.doc_id for r in mil.classify(kept[0], labels).collect() if r.predicted)
    assert ids(kept[2]) == sorted(r.doc_id for r in mcd.rules(kept[1]).collect() if r.kept)
    assert ids(kept[3]) == sorted({r.component_id for r in simhash.near_duplicates(kept[2]).collect()})
    assert set(ids(kept[4])) <= set(ids(kept[3]))
    # Every document of the mixture is packed whole, as often as it is there.
    pieces = docs.where("piece = 0").collect()
    assert Counter(r.doc_id for r in pieces) == Counter(ids(kept[4]))


def test_clean_documents_stay(spark):
    """Of documents labelled as of high quality with 50 words or more, the filtering stages drop hardly any."""
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    good = {r.doc_id for r in spark.read.parquet(f"{SF}/labels.parquet").where("quality = 1").collect()}
    first = corpus_pipeline.quality_classifier(spark, docs, SF)
    second = corpus_pipeline.quality_rules(spark, first, SF)
    failed = {r.doc_id for r in mcd.rules(docs).collect() if r.base_failed}
    stayed = {r.doc_id for r in second.select("doc_id").collect()}
    assert len((good - failed) - stayed) <= 0.01 * len(good)


def test_run_on_an_empty_table(spark, tmp_path):
    docs = spark.read.parquet(f"{SF}/documents.parquet").limit(0)
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    spark.read.parquet(f"{SF}/labels.parquet").write.parquet(f"{tmp_path}/labels.parquet")
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0


def test_run_on_odd_tables(spark, tmp_path):
    """Nulls in every column, empty, very long and repeated rows, repeated ids, and columns whose names clash."""
    good = [r.text for r in spark.read.parquet(f"{SF}/documents.parquet").where("n_chars between 600 and 2000").orderBy("doc_id").limit(60).collect()]
    rows = [(i, t, "en" if i % 3 else None, "s" if i % 2 else None) for i, t in enumerate(good)]
    rows += [rows[4], rows[4], (4, good[5], "en", "s"), (None, good[6], "en", "s"), (None, None, None, None), (200, "", "en", "s"), (201, None, "en", "s"), (202, " \n ", None, "s"), (203, " ".join(good * 20), "en", "s"), (204, good[7], "en", "s"), (205, good[7] + " tail", "en", "s")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string").withColumn("n_chars", F.char_length("text").cast("long"))
    docs = docs.select("*", *[F.lit(i).alias(c) for i, c in enumerate(("score", "kept", "fp", "n_words", "words", "rate", "copies", "nth", "_id", "c0", "key"))])
    docs.repartition(3).write.parquet(f"{tmp_path}/documents.parquet")
    told = [(i, int(i % 7 > 0), int(i % 5 == 0)) for i in range(60)] + [(None, 1, 0), (3, None, 1), (999, 1, 0)]
    spark.createDataFrame(told, "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    out = corpus_pipeline.run(spark, str(tmp_path)).collect()
    known = {r[0] for r in rows}
    assert out and {r.doc_id for r in out} <= known and {"sequence_id", "offset", "length"} <= set(out[0].asDict())
    held = {}
    for r in out:
        held.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for own in held.values():
        ends = [0] + [a + n for a, n in sorted(own)]
        assert [a for a, _ in sorted(own)] == ends[:-1] and ends[-1] <= 2048


def test_each_stage_on_odd_rows(spark):
    """What the stages' docstrings say of nulls, ties and repeated rows."""
    docs = spark.read.parquet(f"{SF}/documents.parquet").where("n_chars between 600 and 2000").orderBy("doc_id").limit(40)
    rows = [r.asDict() for r in docs.collect()]
    odd = [rows[0], rows[0] | {"lang": "xx"}, rows[1] | {"doc_id": rows[0]["doc_id"]}, rows[2] | {"doc_id": None}, rows[3] | {"text": None}, rows[4] | {"text": ""}, {k: None for k in rows[0]}]
    docs = spark.createDataFrame([tuple(r[c] for c in docs.columns) for r in [*rows, *odd]], docs.schema)
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, docs, SF)
        assert out.count() <= docs.count() * 4 and (name == "best-fit packing" or out.columns == docs.columns)
        if name == "simhash near-dedup":
            found = simhash.near_duplicates(docs).collect()
            groups = []  # by brute force; two groups can have rows of one doc_id
            for f in {r.fp for r in found}:
                met = [g for g in groups if any(((f ^ x) & (2**64 - 1)).bit_count() <= 3 for x in g)]
                groups = [g for g in groups if g not in met] + [set().union({f}, *met)]
            smallest = [min((r.doc_id for r in found if r.fp in g and r.doc_id is not None), default=-1) for g in groups]
            assert sorted(-1 if r.doc_id is None else r.doc_id for r in out.collect()) == sorted(smallest)
        if name == "quality rules":
            assert all(r.text for r in out.collect())
        if name == "best-fit packing":
            assert out.where("piece = 0").count() == docs.count()
