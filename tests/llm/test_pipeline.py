"""The pipeline stage by stage against brute force, on its own inputs."""

import brute
import corpus_pipeline
from tabtaint.llm.common import stored

SF = "/root/testdata/sf0.001"


def ids(df):
    return sorted(r["doc_id"] for r in df.select("doc_id").collect())


def test_stages(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    columns = docs.columns
    names = [n for n, _ in corpus_pipeline.STAGES]
    assert names == ["quality_rules", "near_dedup", "decontamination", "pseudonyms", "tokens"]
    before = docs
    for name, stage in corpus_pipeline.STAGES:
        after = stored(stage(spark, before, SF), name)
        rows = [(r["doc_id"], r["text"]) for r in before.collect()]
        if name != "tokens":
            assert after.columns == columns
        if name == "quality_rules":
            failed = {i for i, *_, bad in brute.quality(rows) if bad}
            assert not failed & set(ids(after)) and after.count() > 0.8 * (len(rows) - len(failed))
        if name == "near_dedup":
            assert ids(after) == sorted(i for i, _, _, kept in brute.near(rows) if kept)
        if name == "decontamination":
            items = [tuple(r) for r in spark.read.parquet(f"{SF}/benchmark.parquet").select("item_id", "text").collect()]
            assert ids(after) == sorted(i for i, *_, bad in brute.decontaminate(rows, items) if not bad)
        if name == "pseudonyms":
            from tabtaint.llm.pii import Pseudonyms
            p = Pseudonyms()
            assert {r["doc_id"]: r["text"] for r in after.collect()} == {i: p.text(t)[0] for i, t in rows}
            assert all(r["n_chars"] == len(r["text"]) for r in after.collect())
        if name == "tokens":
            got = {r["doc_id"]: (r["n_tokens"], r["ids_sha256"], r["decoded_sha256"]) for r in after.collect()}
            assert got == {i: tuple(x) for i, *x in brute.bpe(rows)}
        before = after
    assert ids(corpus_pipeline.run(spark, SF)) == ids(before)


def test_empty_table(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").limit(0)
    for name, stage in corpus_pipeline.STAGES:
        docs = stored(stage(spark, docs, SF), name)
        assert docs.count() == 0


def test_filters_with_clashing_names(spark):
    """Columns named like the filters' own, or like others in another case, come through unchanged."""
    from pyspark.sql import functions as F

    from tabtaint.llm import decontaminate, neardup, quality
    text = " ".join(f"word{i}" for i in range(40))
    names = ["doc_id", "text", "__quality", "__key", "__id", "__row", "row", "first_row", "kept", "component_id", "TEXT"]
    rows = [(i, text if i < 3 else f"{text} {i} " + " ".join(f"own{i}x{k}" for k in range(60)), *range(9)) for i in (0, 1, 1, 4, 5)]
    docs = spark.createDataFrame(rows, ", ".join(f"c{k} {'string' if k == 1 else 'bigint'}" for k in range(11))).toDF(*names)
    items = spark.createDataFrame([(1, " ".join(f"own4x{k}" for k in range(12)))], "item_id bigint, text string")
    for kept, want in ((neardup.keep_first_of_group(docs), {0, 4, 5}), (decontaminate.drop_contaminated(docs, items), {0, 1, 5}),
                       (quality.keep_quality(docs), None)):
        assert kept.columns == names
        got = kept.toDF(*[f"c{k}" for k in range(11)]).select(F.col("c0"), F.array(*[f"c{k}" for k in range(2, 11)]).alias("v")).collect()
        assert all(r["v"] == list(range(9)) for r in got)
        assert want is None or {r["c0"] for r in got} == want
